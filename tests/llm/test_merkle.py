"""The Merkle manifest against a plain tree."""

import hashlib
import random
import zlib

import pytest

from barweave.llm import merkle


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests, fanout=3):
    """The root, and for each leaf its steps (left, right)."""
    steps, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for i, place in enumerate(at):
            low = place // fanout * fanout
            run = level[low : low + fanout]
            steps[i].append(("".join(run[: place - low]), "".join(run[place - low + 1 :])))
        at = [place // fanout for place in at]
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], steps


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for name in names:
        members = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        made[name] = (members, *tree([leaf_of(r) for r in members]))
    root, above = tree([made[name][1] for name in names])
    out = []
    for name, upper in zip(names, above):
        members, subroot, steps = made[name]
        for row, lower in zip(members, steps):
            held = leaf_of(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                held = leaf_of((*row[:4], row[4].replace("\n", "")))
            for left, right in lower + upper:
                held = sha(left + held + right)
            proof = sha("".join(a + b for a, b in lower + upper))
            out.append((row[0], leaf_of(row), subroot, root, proof, held, held == root))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("sources", [["a"], [None, "", "b", "é", "~"] + [f"s{i}" for i in range(27)]])
def test_query_matches_a_plain_tree(spark, tmp_path, sources):
    rng = random.Random(len(sources))
    rows = []
    for i in range(300):
        text = rng.choice([None, "", "one", "a\nb", "é\n\nü \r\n", "x" * 5000])
        rows.append((i, rng.choice(sources[: 1 + i % len(sources)]), rng.choice([None, "en"]), rng.choice([None, 0, 12]), text))
    rows += [rows[3], rows[3], (3, sources[0], "fr", 1, "other"), (None, sources[0], None, None, None), (None, sources[0], None, None, None), (None, sources[-1], "x", 1, "a\nb"), (-7, "alone", "x", 1, "a\nb")]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g int, path string")
    frame.repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()]
    assert order(got) == order(expected(rows))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1])
def test_no_row_and_one_row(spark, tmp_path, n):
    rows = [(5, None, None, None, "a")][:n]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()]
    assert got == expected(rows) if n else got == []


def test_levels_of_many_nodes(spark, monkeypatch):
    """Levels that several tasks take give the same root as those of one task."""
    frame = spark.range(3000).selectExpr("id as doc_id", "concat('s', id % 2) as source", "cast(id as string) as text")
    made = []
    for few in (0, 10**6):
        monkeypatch.setattr(merkle, "FEW", few)
        made.append(sorted(tuple(r) for r in merkle.manifest(frame, "source", "doc_id", ["doc_id", "text"], {}).selectExpr("id", "hex(root)", "to_json(path)").collect()))
    assert made[0] == made[1] and len(made[0]) == 3000
