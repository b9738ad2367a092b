"""Declared closures and the partial rows they exclude: manifests from files, rows judged against them, all faults as rows.

A closure declares the slot that broke off (its partial row, by close time and hash), the slots that are wholly missing after
it and the slot where trading resumes.  Nothing else may deviate.  Rows meet the declared slots in one full outer join on
(symbol, open_time), so that both sides' leftovers are seen in the same exchange.  No series sits in one task: order and index
come from windows over pages, which hold many rows each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PARTIAL = "partial_candle struct<open_time:string,actual_close_time:string,expected_close_time:string,provider_row_sha256:string,exclusion_reason:string>"
MANIFEST = (
    "schema_version string, provider string, symbol string, timeframe string, start_time string, end_time string, closures array<struct<closure_id:string,canonical_gap_start:string,resumed_open:string,"
    f"unavailable_candle_count:bigint,fully_missing_start:string,fully_missing_candle_count:bigint,reason_code:string,governance_reference:string,{_PARTIAL.replace(' ', ':', 1)}>>"
)
MILLI = "INTERVAL '0.001' SECOND"
#: A row of seven fields or more, each a whole number or a text.
ROW = r'^\[(-?[0-9]+|"([^"\\]|\\.)*")(,(-?[0-9]+|"([^"\\]|\\.)*")){6,}\]$'
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{3})?Z$"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """A row a closure of the manifest files under path, one manifest a file.

    A file that its own values do not encode again byte for byte (other fields or order, spaces, no final newline) is an error,
    as are times not written as UTC to the second or, where they are not zero, milliseconds, and manifests without a closure.  An empty file declares nothing.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"))
    m = files.withColumn("m", F.from_json("raw", MANIFEST))
    same = F.coalesce(F.concat(F.to_json("m", {"ignoreNullFields": "false"}), F.lit("\n")) == F.col("raw"), F.lit(False)) & (F.size("m.closures") > 0)
    m = m.where(F.when(same, True).otherwise(F.raise_error(F.concat(F.lit("manifest is not canonical: "), "file")).cast("boolean")))
    x = m.select("m.schema_version", "m.provider", "m.symbol", "m.timeframe", "m.start_time", "m.end_time", F.posexplode("m.closures").alias("place", "c"))
    time = lambda name: F.when(F.col(name).rlike(_ISO) & ~F.col(name).endswith(".000Z"), F.to_timestamp_ntz(F.rtrim(F.translate(name, "TZ", "  ")))).otherwise(F.raise_error(F.concat(F.lit("manifest time is not canonical: "), F.col(name))).cast("timestamp_ntz"))
    return x.select(
        "schema_version", "provider", "symbol", "timeframe", time("start_time").alias("start_time"), time("end_time").alias("end_time"), "place", "c.closure_id",
        time("c.canonical_gap_start").alias("gap_start"), time("c.resumed_open").alias("resumed_open"), F.col("c.unavailable_candle_count").alias("unavailable"),
        time("c.fully_missing_start").alias("missing_start"), F.col("c.fully_missing_candle_count").alias("missing"), "c.reason_code", "c.governance_reference",
        time("c.partial_candle.open_time").alias("partial_open"), time("c.partial_candle.actual_close_time").alias("actual_close"), time("c.partial_candle.expected_close_time").alias("expected_close"),
        F.col("c.partial_candle.provider_row_sha256").alias("row_sha256"), "c.partial_candle.exclusion_reason",
    )


def write_manifests(closures: DataFrame, path: str) -> None:
    """Closures (the columns that read_manifests gives) as manifests that it accepts, one file a symbol."""
    stamp = lambda name: F.regexp_replace(F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "[.]000Z$", "Z").alias(name)
    partial = F.struct(stamp("partial_open").alias("open_time"), stamp("actual_close").alias("actual_close_time"), stamp("expected_close").alias("expected_close_time"), F.col("row_sha256").alias("provider_row_sha256"), "exclusion_reason")
    closure = F.struct(
        "place", "closure_id", stamp("gap_start").alias("canonical_gap_start"), stamp("resumed_open"), F.col("unavailable").alias("unavailable_candle_count"),
        stamp("missing_start").alias("fully_missing_start"), F.col("missing").alias("fully_missing_candle_count"), "reason_code", "governance_reference", partial.alias("partial_candle"),
    )
    head = ["schema_version", "provider", "symbol", "timeframe", "start_time", "end_time"]
    listed = closures.groupBy(*head).agg(F.array_sort(F.collect_list(closure)).alias("l"))
    fields = ["closure_id", "canonical_gap_start", "resumed_open", "unavailable_candle_count", "fully_missing_start", "fully_missing_candle_count", "reason_code", "governance_reference", "partial_candle"]
    bare = F.transform("l", lambda e: F.struct(*[e[f].alias(f) for f in fields]))
    text = F.to_json(F.struct(*head[:4], stamp("start_time"), stamp("end_time"), bare.alias("closures")), {"ignoreNullFields": "false"})
    listed.select(text.alias("value"), "symbol").write.partitionBy("symbol").option("maxRecordsPerFile", 1).text(path)


def manifest_faults(closures: DataFrame, width: str) -> DataFrame:
    """(symbol, closure_id, reason) of every rule that a declaration breaks; width is an interval such as INTERVAL '1' HOUR.

    A list is a declaration file's, so the window over a symbol's declarations is short.
    """
    w = F.expr(width)
    slot = F.unix_micros(F.timestamp_seconds(F.lit(0)) + w)
    us = lambda name: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(name))
    aligned = lambda name: us(name) % slot == 0
    s = Window.partitionBy("symbol").orderBy("place")
    many = lambda name: F.count("*").over(Window.partitionBy("symbol", name)) > 1
    unavailable, missing = F.floor((us("resumed_open") - us("gap_start")) / slot), F.floor((us("resumed_open") - us("missing_start")) / slot)
    before_start, before_end = F.lag("gap_start").over(s), F.lag("resumed_open").over(s)
    rules = {
        "repeated_id": many("closure_id"), "repeated_partial_open": many("partial_open"), "repeated_row_hash": many("row_sha256"),
        "blank_text": F.exists(F.array("closure_id", "reason_code", "governance_reference", "exclusion_reason"), lambda t: F.length(F.trim(t)) == 0),
        "hash_is_not_hex": ~F.col("row_sha256").rlike("^[0-9a-f]{64}$"),
        "empty_window": F.col("end_time") <= F.col("start_time"),
        "out_of_order": before_start > F.col("gap_start"), "touches_the_one_before": F.col("gap_start") <= before_end,
        "not_aligned": ~(aligned("gap_start") & aligned("missing_start") & aligned("resumed_open")),
        "outside_window": ~((F.col("start_time") <= F.col("gap_start")) & (F.col("gap_start") < F.col("resumed_open")) & (F.col("resumed_open") <= F.col("end_time"))),
        "partial_not_at_start": F.col("partial_open") != F.col("gap_start"),
        "partial_bounds": ~((F.col("partial_open") < F.col("actual_close")) & (F.col("actual_close") < F.col("expected_close"))),
        "expected_close": F.col("expected_close") != F.col("gap_start") + w - F.expr(MILLI),
        "missing_start": F.col("missing_start") != F.col("gap_start") + w,
        "unavailable_count": (F.col("unavailable") < 1) | (unavailable != F.col("unavailable")),
        "missing_count": (F.col("missing") < 0) | (missing != F.col("missing")) | (F.col("unavailable") != F.col("missing") + 1),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(True) if k not in ("out_of_order", "touches_the_one_before") else F.lit(False)), F.lit(k)) for k, v in rules.items()]))
    return closures.select("symbol", "closure_id", broken.alias("b")).select("symbol", "closure_id", F.explode("b").alias("reason"))


def provider_rows(pages: DataFrame) -> DataFrame:
    """Rows of pages (symbol, page from 1, body: a JSON array of rows): page, row_index, place (index in the symbol's series),
    row (compact JSON), row_sha256, open_time, close_time, before (open of the row before, over pages too), sound.

    The hash is of the row's compact JSON, whatever spaces the page has.  A body that is no array gives no rows and ends in
    the fault missing_page of the one after; rows whose fields are not whole numbers and texts are not sound.
    """
    p = pages.select("symbol", "page", F.from_json("body", "array<string>").alias("rows"))
    s = Window.partitionBy("symbol").orderBy("page")
    upto = s.rowsBetween(Window.unboundedPreceding, -1)
    size = F.greatest(F.size("rows"), F.lit(0))
    open_of = lambda row: F.try_to_number(F.regexp_extract(row, r"^\[([0-9]{1,15}),", 1), F.lit("999999999999999")).cast("bigint")
    last = F.when(size > 0, open_of(F.element_at("rows", -1)))
    p = p.withColumns({"first": F.coalesce(F.sum(size).over(upto), F.lit(0)), "last": F.last(last, ignorenulls=True).over(upto)})
    x = p.select("symbol", "page", "first", "last", F.posexplode("rows").alias("row_index", "row"), "rows")
    x = x.withColumn("before", F.when(F.col("row_index") == 0, F.col("last")).otherwise(open_of(F.get("rows", F.col("row_index") - 1)))).drop("rows")
    close = F.try_to_number(F.get(F.from_json("row", "array<string>"), F.lit(6)), F.lit("999999999999999")).cast("bigint")
    ntz = lambda ms: F.timestamp_millis(ms).cast("timestamp_ntz")
    return x.select(
        "symbol", "page", "row_index", (F.col("first") + F.col("row_index")).alias("place"), "row", F.sha2("row", 256).alias("row_sha256"),
        ntz(open_of("row")).alias("open_time"), ntz(close).alias("close_time"), ntz(F.col("before")).alias("before"),
        (F.coalesce(F.col("row").rlike(ROW), F.lit(False)) & open_of("row").isNotNull() & close.isNotNull()).alias("sound"),
    )


def declared_slots(closures: DataFrame, width: str) -> DataFrame:
    """A row a slot that a closure speaks of, with its role: partial, absent (wholly missing) or resumed."""
    w = F.expr(width)
    slots = F.filter(F.sequence("gap_start", "resumed_open", w), lambda t: t <= F.col("resumed_open"))
    role = F.when(F.col("slot") == F.col("gap_start"), "partial").when(F.col("slot") == F.col("resumed_open"), "resumed").otherwise("absent")
    return closures.withColumn("slot", F.explode(slots)).select("symbol", F.col("slot").alias("open_time"), "closure_id", "actual_close", F.col("row_sha256").alias("declared_sha256"), role.alias("role"))


def judge(pages: DataFrame, closures: DataFrame, server_time: str, width: str) -> DataFrame:
    """What becomes of every row, and of every declared slot without its row.

    status is keep, excluded (a declared partial row), open (not closed before server_time) or fault; reason says which fault:
    malformed_row, outside_window, not_ascending (a repeat, or earlier than the row before), actual_close, row_hash,
    not_closed, undeclared_partial, row_in_closure, missing_partial, missing_resumed.  Symbols without a manifest have no
    window.  Null open times never join.  Page and window faults of a series are page_faults.
    """
    w = F.expr(width)
    rows = provider_rows(pages).withColumn("_row", F.lit(True))
    spans = closures.groupBy("symbol").agg(F.min("start_time").alias("low"), F.max("end_time").alias("high"))
    rows = rows.join(spans, "symbol", "left")
    x = rows.join(declared_slots(closures, width), ["symbol", "open_time"], "full_outer")
    role, expected, now = F.coalesce("role", F.lit("")), F.col("open_time") + w - F.expr(MILLI), F.lit(server_time).cast("timestamp_ntz")
    reason = (
        F.when(F.col("_row").isNull(), F.when(role == "partial", "missing_partial").when(role == "resumed", "missing_resumed"))
        .when(~F.col("sound"), "malformed_row")
        .when((F.col("open_time") < F.col("low")) | (F.col("open_time") >= F.col("high")), "outside_window")
        .when(F.col("open_time") <= F.col("before"), "not_ascending")
        .when(role == "absent", "row_in_closure")
        .when(role == "partial", F.when(F.col("close_time") != F.col("actual_close"), "actual_close").when(F.col("row_sha256") != F.col("declared_sha256"), "row_hash").when(F.col("close_time") >= now, "not_closed"))
        .when(F.col("close_time") != expected, "undeclared_partial")
    )
    status = F.when(reason.isNotNull(), "fault").when(role == "partial", "excluded").when(F.col("close_time") >= now, "open").otherwise("keep")
    seen = x.where(F.col("_row").isNotNull() | (role != "absent"))
    return seen.select("symbol", "open_time", "page", "row_index", "place", "row", "row_sha256", F.col("close_time").alias("actual_close"), expected.alias("expected_close"), "closure_id", status.alias("status"), reason.alias("reason"))


def page_faults(pages: DataFrame, closures: DataFrame) -> DataFrame:
    """(symbol, page, reason): missing_page (pages do not follow one another from 1), late_start (the first row is not at the
    declared window's start), no_pages (a manifest without any page)."""
    s = Window.partitionBy("symbol").orderBy("page")
    gap = pages.select("symbol", "page", F.coalesce(F.lag("page").over(s), F.lit(0)).alias("b")).where("page <> b + 1").select("symbol", "page", F.lit("missing_page").alias("reason"))
    first = provider_rows(pages).groupBy("symbol").agg(F.min("open_time").alias("first"))
    starts = closures.groupBy("symbol").agg(F.min("start_time").alias("low")).join(first, "symbol", "left")
    late = starts.where("first IS NULL OR first <> low").select("symbol", F.lit(None).cast("int").alias("page"), F.when(F.col("first").isNull(), "no_pages").otherwise("late_start").alias("reason"))
    return gap.select("symbol", F.col("page").cast("int").alias("page"), "reason").unionByName(late)


def kept(judged: DataFrame) -> DataFrame:
    """The rows that stay, in an unbroken index; any fault stops the job with its symbol, slot and reason."""
    told = F.concat_ws(" ", F.lit("row fault:"), "symbol", F.col("open_time").cast("string"), "reason")
    return judged.where(F.when(F.col("status") == "fault", F.raise_error(told).cast("boolean")).otherwise(F.col("status") == "keep"))
