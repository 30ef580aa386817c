from __future__ import annotations

from pyspark.sql import functions as F

from logweft.operators import cells, summary
from logweft.operators.parse import events_of, json_records
from logweft.plans.demo import generate_demo
from logweft.streaming import streams


def test_streams_agree_with_batch(spark, tmp_path):
    folder = generate_demo(spark, str(tmp_path / "in"), 4000)
    with open(f"{folder}/extra.json", "w") as extra:
        extra.write("not json\n")
    records = streams.stream_records(spark, folder)
    target = str(tmp_path / "records")
    streams.write_records(records, target, str(tmp_path / "c1")).awaitTermination()
    stored = streams.stored_records(spark, target)
    assert stored.where("malformed").count() == 1
    batch = events_of(json_records(spark.read.text(folder)))
    columns = ["timestamp", "level", "service", "message", "correlation_id"]
    assert stored.where("not malformed").select(columns).exceptAll(batch.select(columns)).isEmpty()

    windows = streams.stream_windows(records.where(F.col("reason").isNull()), 5, "10 minutes")
    target = str(tmp_path / "windows")
    streams.write_windows(windows, target, str(tmp_path / "c2")).awaitTermination()
    closed = spark.read.parquet(target)
    keyed = cells.with_cube_keys(batch.withColumn("arrival", F.lit(0)), 5)
    expected = summary.window_stats(cells.count_cells(keyed, "bucket", "level"))
    assert closed.exceptAll(expected).isEmpty()
    assert expected.count() - closed.count() == 3
    assert streams.stream_bursts(closed, 80).count() == 1

    lines = streams.stream_lines(spark, folder)
    target = str(tmp_path / "masked")
    streams.write_redacted(lines, target, str(tmp_path / "c3")).awaitTermination()
    masked = spark.read.text(target)
    assert masked.count() == 4001
    assert masked.where(F.col("value").contains("demo.user@")).isEmpty()
