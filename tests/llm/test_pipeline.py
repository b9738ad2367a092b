"""The pipeline as a whole over a small table, each stage against a plain one on what the stage before kept."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from barweave.llm.common import stage
from barweave.llm.tokenise import vocabulary_path
from tests.llm.test_similar import brute

DOCS = "/root/testdata/sf0.001/documents.parquet"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_failed(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update((i, i + 1, i + 2))
    return len(words) < 50 or 100 * len(covered) > 50 * len(words)


def is_part(short, whole):
    it = iter(whole)
    return all(line in it for line in short)


def test_every_stage_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(DOCS)
    kept, columns = [docs.toPandas()], docs.columns
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, ""), name.replace(" ", "-"))
        kept.append(docs.toPandas())
        assert name == "best-fit packing" or docs.columns == columns
    first, ruled, lined, near, mixed, packed = kept
    texts = dict(zip(first.doc_id, first.text))

    assert set(ruled.doc_id) <= {i for i, t in texts.items() if not base_failed(t)}
    assert all(texts[i] == t for i, t in zip(ruled.doc_id, ruled.text)) and len(ruled) > 0.5 * len(first)

    assert list(sorted(lined.doc_id)) == list(sorted(ruled.doc_id))
    assert all(is_part(t.split("\n"), texts[i].split("\n")) and n == len(t) for i, t, n in zip(lined.doc_id, lined.text, lined.n_chars))

    sets = {}
    for i, t in zip(lined.doc_id, lined.text):
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    group = brute(sets)
    assert sorted(near.doc_id) == sorted(min(i for i in group if group[i] == g) for g in set(group.values()))

    taken = Counter(mixed.doc_id)
    assert set(taken) <= set(near.doc_id) and max(taken.values()) <= 2
    size = {i: len(WORD.findall(t)) for i, t in zip(near.doc_id, near.text)}
    by, got = defaultdict(int), defaultdict(int)
    for i, s in zip(near.doc_id, near.source):
        by[s] += size[i]
        got[s] += size[i] * taken[i]
    names = sorted(by)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(by.values()), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * by[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * by[s]
            left -= target[s]
        free -= over
    longest = {s: max(size[i] for i, x in zip(near.doc_id, near.source) if x == s) for s in names}
    assert all(abs(got[s] - target[s]) <= longest[s] for s in names), (dict(got), target)

    encoder = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    ids = {i: [*encoder.encode(t or "", add_special_tokens=False).ids, 2] for i, t in zip(near.doc_id, near.text)}
    assert sum(packed.length) == sum(len(ids[i]) * n for i, n in taken.items())
    for p in packed.itertuples():
        assert zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        ends = (g.offset + g.length).tolist()
        assert g.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 1024


def test_packing_keeps_a_small_encoder_and_the_same_pieces(spark, monkeypatch):
    """Its workers share executors that the stages before have filled; forgetting pieces changes no id."""
    import random

    from barweave.llm import packing, tokenise

    asked = []
    monkeypatch.setattr(corpus_pipeline, "pack_documents", lambda *a, **k: asked.append(k["cache"]))
    corpus_pipeline.best_fit_packing(spark, None, "")
    assert asked[0] <= 60_000
    rng = random.Random(2)
    texts = [" ".join(rng.choice("aeiou") + str(rng.randrange(500)) + "x\ny,"[: rng.randrange(5)] for _ in range(300)) for _ in range(40)] + [None, "", " a  b\n"]
    small, large = tokenise.Encoder(vocabulary_path("byte_bpe_50k.json"), 200), tokenise.Encoder(vocabulary_path("byte_bpe_50k.json"))
    assert list(small.batch(texts)) == list(large.batch(texts))
    assert len(small.pieces) + len(small.older) < len(large.pieces)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    made = [packing.cut_documents(docs, vocabulary_path("byte_bpe_50k.json"), 2, 1024, with_ids, cache) for with_ids, cache in ((False, 200), (True, 300_000))]
    some = made[0].columns
    assert sorted(map(tuple, made[0].collect())) == sorted(map(tuple, made[1].select(*some).collect()))
