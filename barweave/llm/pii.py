"""Operator 9: personal data and information-theoretic sanitisation, in DataFrame functions only.

The base kinds (email, ip, card, phone) are found by pattern in every whole text, with their places.  The method then
asks which other words give a protected entity (a distinct email, ip, card or phone) away.  Terms are runs of three
letters or more, in lower case.  Over all documents, and whole texts,

    P(e | t) = documents that hold both / documents that hold the term

and the pointwise mutual information log2(P(e | t) / P(e)) says how much of the entity's own information -log2 P(e) the
term tells.  A term discloses an entity if at least ``min_support`` different texts hold both, P(e | t) is at least
``min_disclosure``, and it tells at least the share ``told`` of the entity's information, which entities of a third of
all documents can meet as well as rare ones.  Such terms are generalised wherever they stand, in documents without the
entity too: they become spans of kind ``term``, and ``sanitise`` writes [TERM] for them as it writes [EMAIL] and so on
for the others.

Words are counted before anything is joined to them, so the joins grow with the vocabulary.  Entities in fewer texts
than ``min_support`` disclose nothing: one document is no evidence, and its copies are one text.

Null text is empty, null and repeated ids are rows like any other, empty tables give empty results, very many spans in a
text cost in proportion to their number.  Other columns are not read, but pass through ``sanitise``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm.common import read_table, split_by, stage, unused

KINDS = ["email", "ip", "card", "phone"]
#: The patterns of the kinds.  Repeats at a pattern's end take all they can at once, and a match starts at the start of
#: its run of characters or where the last match ended: the same matches, without retries on very long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[0-9]|[\x20-][0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that every text with a match passes.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: A term: a run of three letters or more.
TERM = r"\p{L}{3,}"
SPAN = "struct<kind:string,start:bigint,stop:bigint,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """From the right, every second digit doubled, its digits summed; the sum is a multiple of ten."""
    flipped = F.split(F.reverse(digits), "")
    values = F.transform(F.filter(flipped, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, d: s + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _matches(kind: str, pattern: str, text: Column, block: int = 64) -> Column:
    """Spans of a pattern: what it leaves between its matches gives their places, in code points.  Places are summed in
    blocks, so that no long array is copied for each match."""
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint"))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    step = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(step) - 1) / block).cast("int")), lambda i: F.slice(step, i * block + 1, block))
    empty = F.array().cast(f"array<{SPAN}>")

    def one(s: Column, x: Column) -> Column:
        start, stop = s["at"] + x["gap"], s["at"] + x["gap"] + F.length(x["m"])
        return F.struct(stop.alias("at"), F.concat(s["out"], F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), x["m"].alias("value")))).alias("out"))

    def many(s: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(s["at"].alias("at"), empty.alias("out")), one)
        return F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.concat(s["out"], F.array(r["out"])).alias("out")))[0]

    seed = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
    return F.when(F.size(found) > 0, F.flatten(F.aggregate(blocks, seed, many)["out"])).otherwise(empty)


def _spans(kind: str, text: Column) -> Column:
    """Valid spans of a base kind."""
    hinted = F.contains(text, F.lit("@")) if kind == "email" else F.regexp_like(text, F.lit(HINTS[kind]))
    placed = _matches(kind, PATTERNS[kind], text)
    return F.when(hinted, F.filter(placed, lambda x: _valid(kind, x["value"]))).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_spans(docs: DataFrame) -> DataFrame:
    """docs with base: the spans of the four kinds, by kind and then start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("base", F.concat(*[_spans(k, text) for k in KINDS]))


def _terms(text: Column) -> Column:
    """Hashes of a text's terms, each once."""
    return F.transform(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))), lambda t: F.xxhash64(t))


def disclosing_terms(docs: DataFrame, found: DataFrame, min_support: int = 3, min_disclosure: float = 0.5, told: float = 0.5) -> DataFrame:
    """term (its hash) of every term that gives an entity away.  found: text and base of the rows with spans."""
    texts = found.select(F.xxhash64("text").alias("own"), "text", F.array_distinct(F.transform("base", lambda b: F.xxhash64(b["kind"], b["value"]))).alias("entities"))
    texts = texts.groupBy("own").agg(F.first("text").alias("text"), F.first("entities").alias("entities"), F.count("*").alias("copies"))
    texts = stage(texts.select(_terms(F.col("text")).alias("terms"), "entities", "copies"), "texts")
    held = texts.select("terms", "copies", F.explode("entities").alias("entity"))
    entities = held.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("support")).where(F.col("support") >= min_support)
    entities = stage(entities.drop("support"), "entities")
    together = held.join(entities, "entity").select("entity", "n_entity", "copies", F.explode("terms").alias("term"))
    pairs = together.groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.count("*").alias("support"), F.first("n_entity").alias("n_entity")).where(F.col("support") >= min_support)
    pairs = stage(pairs, "pairs")
    # documents that hold each term, with map-side combining
    counts = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    total = docs.agg(F.count("*").alias("n_all"))  # one row
    given = pairs.join(counts, "term").crossJoin(F.broadcast(total))
    share, own = F.col("n_both") / F.col("n_term"), F.col("n_entity") / F.col("n_all")
    return given.where((share >= min_disclosure) & (F.log2(share / own) >= -told * F.log2(own))).select("term").distinct()


def all_spans(docs: DataFrame, **limits) -> DataFrame:
    """text (null is empty), base and spans (base, then terms outside of them) of every text that has spans, once."""
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    found = stage(find_spans(text).where(F.size("base") > 0), "found")
    giving = stage(disclosing_terms(text, found, **limits), "giving")
    hits = text.select(F.xxhash64("text").alias("own"), F.explode(_terms(F.col("text"))).alias("term")).join(giving, "term")
    hits = stage(hits.groupBy("own").agg(F.collect_set("term").alias("terms")), "hits")  # terms of one text
    likely = split_by(text.withColumn("own", F.xxhash64("text")), "own", hits.select("own"))[1]
    told = likely.dropDuplicates(["own"]).join(hits, "own").select("text", "terms")
    placed = told.withColumn("t", F.filter(_matches("term", TERM, F.col("text")), lambda s: F.array_contains("terms", F.xxhash64(F.lower(s["value"])))))
    empty = F.array().cast(f"array<{SPAN}>")
    both = found.select("text", "base", empty.alias("t")).unionByName(placed.select("text", empty.alias("base"), "t"))
    joined = both.groupBy(F.xxhash64("text").alias("own")).agg(F.first("text").alias("text"), F.max_by("base", F.size("base")).alias("base"), F.max_by("t", F.size("t")).alias("t"))
    outside = F.filter("t", lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (b["stop"] > s["start"])))
    return joined.select("own", "text", "base", F.concat("base", outside).alias("spans")).where(F.size("spans") > 0)


def sanitise(docs: DataFrame, **limits) -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one.  Rows that surely have no
    span are not exchanged."""
    own, key, clean = (unused(docs.columns, c) for c in ("own", "key", "clean"))
    spans = all_spans(docs, **limits)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    pieces = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda s, x: F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["stop"]).alias("at"), s["out"].alias("out"))).otherwise(
            F.struct(x["stop"].alias("at"), F.concat(s["out"], F.array(F.substring("text", (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).alias("out"))
        ),
    )
    fixed = spans.withColumn("c", pieces).select(F.col("own").alias(key), F.concat(F.array_join("c.out", ""), F.substring("text", (F.col("c.at") + 1).cast("int"), F.length("text"))).alias(clean))
    fixed = stage(fixed, "fixed")
    sure, rest = split_by(docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit("")))), own, fixed.select(key))
    joined = rest.join(fixed, F.col(own) == F.col(key), "left")
    changed = joined.select(*[F.coalesce(clean, F.col("text")).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    return sure.drop(own).unionByName(changed)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 on all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = stage(all_spans(docs).select(F.col("own").alias("of"), "base", "spans"), "spans")
    joined = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")).join(spans, F.col("hash") == F.col("of"), "left")

    def told(column: str) -> Column:
        return F.coalesce(F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","), F.lit(""))

    counts = [F.coalesce(F.size(F.filter("base", lambda s: s["kind"] == k)), F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    n = [F.greatest(c, F.lit(0).cast("bigint")).alias(f"n_{k}") for c, k in zip(counts, KINDS)]
    return joined.select("doc_id", *n, F.sha2(told("base").cast("binary"), 256).alias("base_sha256"), told("spans").alias("spans"))
