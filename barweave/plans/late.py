"""Events that arrive in blocks of days out of order, split into those on time and those late."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.plans import queries as q
from barweave.sources.shared import shared_path
from barweave.streaming import late

c = F.col
#: Blocks of five days in the order in which they arrive.
ORDER, DELAY = (0, 2, 1, 3, 5, 4), "36 hours"
_WHEN = " ".join(f"WHEN {b} THEN {i}" for i, b in enumerate(ORDER))
_SQL = f"""WITH e AS (SELECT event_type, ts, CASE (day(ts) - 1) // 5 {_WHEN} ELSE {len(ORDER)} END AS batch FROM events),
b AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e GROUP BY batch),
s AS (SELECT event_type, ts, batch, CASE WHEN ts < seen - INTERVAL '{DELAY}' THEN 'late' ELSE 'on_time' END AS side FROM e JOIN b USING (batch))"""


@q.query("late_events", f"{_SQL} SELECT event_type, side, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY ALL")
def late_events(spark, d):
    """The blocks land one after the other; the stream goes on with each from where it stood."""
    path = shared_path(spark, "late")
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", c("ts").cast("timestamp").alias("ts"))
    place = F.coalesce(F.expr(f"CASE (dayofmonth(ts) - 1) div 5 {_WHEN} END"), F.lit(len(ORDER)))
    for i in range(len(ORDER) + 1):
        e.where(place == i).write.mode("append").parquet(f"{path}/in")
        late.route_late(spark.readStream.schema(e.schema).parquet(f"{path}/in"), f"{path}/out", "ts", DELAY)
    rows = late.sides(spark, f"{path}/out", e.schema)
    ntz = lambda x: x.cast("timestamp_ntz")
    return rows.groupBy("event_type", "side").agg(F.count("*").alias("n"), ntz(F.min("ts")).alias("first_ts"), ntz(F.max("ts")).alias("last_ts"))
