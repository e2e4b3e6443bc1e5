"""Queries over lakes read their source no more often than they need."""

from pyspark.sql import functions as F

from stationlake.plans import lakes


def test_layout_stages_read_the_day_once(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([("a", 90000 + 60 * i, i) for i in range(90)], "station_id string, snapshot_ts long, bikes long")
    monkeypatch.setattr(lakes.src, "status", lambda s, d: rows.withColumn("station_id", counted("station_id")))
    got = {tuple(r) for r in lakes.ENTRIES["layout_stages"][0](spark, str(tmp_path)).collect()}
    assert ("by hour", "compacted", 2, 90) in got and ("by day", "first hour", 1, 60) in got and seen.value == 90
