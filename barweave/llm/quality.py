"""Operator 2: quality rules by distribution divergence, in DataFrame functions only.

Every text is measured once: length and repetition counts (the base rules), the shares of eight character classes, and
the counts of its language's common words.  The references of a language are the means of these distributions over all
its texts that pass the base rules and are long enough.  A text is rejected if it fails the base rules or lies further
from its language's reference, in Jensen-Shannon distance (base 2, so 0 to 1), than a threshold.  Short texts have no
stable histogram: below ``min_chars`` the character test, below ``min_words`` the word test is skipped and the text stays.

Null text is empty (and fails the base rules); a null or unlisted language has no references, so only the base rules
count; repeated rows are judged alike; an empty table gives an empty result.  Other columns pass through in
``quality_filter`` and are not read in ``quality_signals``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm.common import read_table, split_by, stage, unused, words_of

#: Frequent function words of four languages.
COMMON = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "are", "from", "or", "an", "this"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au", "sur", "ne"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como"],
}
#: Characters that are neither white space, ASCII punctuation, digits nor ASCII letters form the last class.
CLASSES = ["[a-z]", "[A-Z]", "[0-9]", "[.,;:'\"()!?-]", "[#*$%&|<>]", "[/@\\[\\]{}_=+^~`\\\\]", "[\\x20\\x09-\\x0D]"]
MAX_CLASS, MAX_WORDS = 0.24, 0.265


def _counts(text: Column) -> Column:
    """How many characters of the second class to the sixth and of the last: their runs are cut out.  White space is
    what the words leave, small letters what all others leave."""
    rare = [F.length(text) - F.length(F.regexp_replace(text, c + "+", "")) for c in CLASSES[1:6]]
    other = F.length(F.regexp_replace(text, "[\\x09-\\x0D\\x20-\\x7E]+", ""))
    return F.array(*rare, other)


def _repeated(grams: Column) -> Column:
    """Words inside three-word windows found twice or more: windows sorted by hash, the places of neighbours that are
    equal, and of each place the words that the next one does not cover."""
    placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("h"), i.alias("i"))))
    twins = F.zip_with(F.slice(placed, 1, F.size(grams) - 1), F.slice(placed, 2, F.size(grams)), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    at = F.sort_array(F.array_distinct(F.flatten(F.array_compact(twins))))
    gaps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
    return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, g: s + g)


def _own() -> Column:
    """What a verdict depends on."""
    return F.xxhash64(F.coalesce("text", F.lit("")), "lang")


def quality_signals(docs: DataFrame) -> DataFrame:
    """doc_id, own (a hash of text and language), lang, the base counts, base_failed, n_chars, the class counts and the counts of common words, with all
    other words last."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lists = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    union = sorted({x for v in COMMON.values() for w in v for x in (w, w.capitalize(), w.upper())})
    split = docs.select("doc_id", _own().alias("own"), "lang", text.alias("text"), words_of(text).alias("w"))
    hashed = split.select(
        "doc_id",
        "own",
        "lang",
        F.size("w").cast("bigint").alias("n_words"),
        F.length("text").cast("bigint").alias("n_chars"),
        _counts(F.col("text")).alias("six"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.filter(F.split("text", "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\f\r", "    ")) != "").alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        F.transform(F.filter("w", lambda x: x.isin(*union)), F.lower).alias("c"),
        F.element_at(lists, F.coalesce("lang", F.lit(""))).alias("list"),
    )
    n = F.size("h")
    pairs = F.zip_with(F.slice("h", 1, F.greatest(n - 2, F.lit(0))), F.slice("h", 2, F.greatest(n - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    grams = F.zip_with(pairs, F.slice("h", 3, F.greatest(n - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    space = (F.col("n_chars") - F.col("word_chars")).cast("int")
    letters = F.col("word_chars") - F.aggregate("six", F.lit(0), lambda s, x: s + x)
    classes = F.concat(F.array(letters), F.slice("six", 1, 5), F.array(space), F.slice("six", 6, 1))
    measured = hashed.withColumns({"grams": grams, "classes": classes}).select(
        "doc_id",
        "own",
        "lang",
        "n_words",
        F.col("word_chars").cast("bigint").alias("word_chars"),
        F.col("classes")[4].cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("grams") == F.size(F.array_distinct("grams")), F.lit(0).cast("bigint")).otherwise(_repeated(F.col("grams"))).alias("n_repeat_words"),
        "n_chars",
        "classes",
        F.transform("list", lambda k: F.size("c") - F.size(F.array_remove("c", k))).alias("common"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rest = F.col("n_words").cast("int") - F.aggregate("common", F.lit(0), lambda s, x: s + x)
    return measured.withColumns({"base_failed": failed, "common": F.concat("common", F.array(rest))})


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two distributions given as arrays."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: 0.5 * part(x, (x + y) / 2) + 0.5 * part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t), F.lit(0.0)))


def quality_verdicts(docs: DataFrame, min_chars: int = 200, min_words: int = 100, max_class: float = MAX_CLASS, max_words: float = MAX_WORDS) -> DataFrame:
    """The signals of every document, its distances from its language's references and kept."""
    signals = stage(quality_signals(docs), "signals")
    shared = signals.withColumns({"p": _shares(F.col("classes"), F.col("n_chars")), "w": _shares(F.col("common"), F.col("n_words"))})
    sizes = {"p": len(CLASSES) + 1} | {k: len(v) + 1 for k, v in COMMON.items()}
    longest = max(v for k, v in sizes.items() if k != "p")
    clean = shared.where(~F.col("base_failed") & F.col("lang").isin(*COMMON) & (F.col("n_chars") >= min_chars) & (F.col("n_words") >= min_words))
    means = clean.groupBy("lang").agg(
        F.array(*[F.avg(F.col("p")[i]) for i in range(sizes["p"])]).alias("ref_p"),
        F.array(*[F.avg(F.col("w")[i]) for i in range(longest)]).alias("ref_w"),
    )
    # at most one row for each listed language
    judged = shared.join(F.broadcast(stage(means, "references")), "lang", "left")
    distances = judged.withColumns(
        {
            "class_distance": F.when(F.col("n_chars") >= min_chars, js_distance(F.col("p"), F.col("ref_p"))),
            "word_distance": F.when(F.col("n_words") >= min_words, js_distance(F.col("w"), F.col("ref_w"))),
        }
    )
    far = (F.coalesce("class_distance", F.lit(0.0)) > max_class) | (F.coalesce("word_distance", F.lit(0.0)) > max_words)
    return distances.select("doc_id", "own", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance")


def quality_filter(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that stay.  Rows that surely do are not exchanged; the others meet the list of rejected texts."""
    own, bad = unused(docs.columns, "own"), unused(docs.columns, "bad")
    rejected = stage(quality_verdicts(docs, **limits).where("NOT kept").select(F.col("own").alias(bad)).distinct(), "rejected")
    sure, rest = split_by(docs.withColumn(own, _own()), own, rejected)
    kept = rest.join(rejected, F.col(own) == F.col(bad), "left_anti")
    return sure.unionByName(kept).drop(own)


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 on all documents."""
    return quality_verdicts(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
