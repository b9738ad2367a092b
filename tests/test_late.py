"""The side table of late rows against a plain walk over batches."""

import random
from datetime import datetime, timedelta

import pytest

from barweave.streaming import late

T, SCHEMA = datetime(2024, 1, 1), "id int, ts timestamp"


def test_nothing_is_lost_and_late_is_late(spark, tmp_path):
    rng, k, want, seen = random.Random(3), 0, {}, None
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(5):
        rows = []
        for _ in range(rng.choice((0, 1, 40)) if n else 40):
            t = None if rng.random() < 0.1 else T + timedelta(hours=10 * n + rng.randint(-30, 30))
            rows.append((k, t))
            want[k] = "no_time" if t is None else "late" if seen is not None and t < seen - timedelta(hours=5) else "on_time"
            k += 1
        seen = max([t for _, t in rows if t] + ([seen] if seen else []), default=None)
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(source)
        late.route_late(spark.readStream.schema(SCHEMA).parquet(source), out, "ts", "5 hours")
    schema = spark.read.schema(SCHEMA).parquet(source).schema
    got = late.sides(spark, out, schema)
    assert {r["id"]: r["side"] for r in got.collect()} == want and got.count() == len(want)
    assert set(want.values()) == {"on_time", "late", "no_time"}
    # a batch that runs again meets the same bound and leaves each row once
    last = max(r["batch"] for r in got.collect())
    again = got.where(f"batch = {last}").select("id", "ts").collect()
    late.split_batch(spark.createDataFrame(again, SCHEMA), last, out, "ts", "5 hours")
    assert {r["id"]: r["side"] for r in late.sides(spark, out, schema).collect()} == want


def test_taken_columns_are_an_error(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("ts timestamp, side int").parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="side"):
        late.route_late(stream, str(tmp_path / "out"))
