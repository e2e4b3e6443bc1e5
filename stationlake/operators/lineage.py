"""Lineage of jobs from their run events: the newest run of each job, and the edges to its datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DATASET = "struct<namespace:string,name:string,facets:struct<symlinks:struct<identifiers:array<struct<namespace:string,name:string,type:string>>>>>"
EVENT = f"eventTime string, eventType string, job struct<namespace:string,name:string>, run struct<runId:string>, inputs array<{DATASET}>, outputs array<{DATASET}>"


def read(spark, path: str) -> DataFrame:
    """Events of all files that the path names, one JSON object a line; lines that are none are left out."""
    lines = spark.read.text(path).select(F.from_json("value", EVENT).alias("e"), F.col("_metadata.file_name").alias("file"))
    return lines.select("e.*", "file").where(F.col("job.name").isNotNull() & F.col("run.runId").isNotNull())


def newest_runs(events: DataFrame) -> DataFrame:
    """(namespace, job, run_id, at) of each job's newest run, by instant and not by text; runs must read and write."""
    runs = events.groupBy(F.col("job.namespace").alias("namespace"), F.col("job.name").alias("job"), F.col("run.runId").alias("run_id")).agg(
        F.max(F.try_to_timestamp("eventTime")).alias("at"), F.max(F.size(F.coalesce("inputs", F.array()))).alias("reads"), F.max(F.size(F.coalesce("outputs", F.array()))).alias("writes")
    )
    done = runs.where((F.col("reads") > 0) & (F.col("writes") > 0))
    return done.groupBy("namespace", "job").agg(F.max_by(F.struct("run_id", "at"), F.struct("at", "run_id")).alias("r")).select("namespace", "job", "r.*")


def edges(events: DataFrame) -> DataFrame:
    """(job, direction, dataset) of the newest runs; a dataset goes by its table's name where it has one."""
    flat = None
    for direction, c in (("reads", "inputs"), ("writes", "outputs")):
        one = events.select(F.col("job.namespace").alias("namespace"), F.col("job.name").alias("job"), F.col("run.runId").alias("run_id"), F.lit(direction).alias("direction"), F.explode(c).alias("d"))
        flat = one if flat is None else flat.unionByName(one)
    table = F.get(F.filter("d.facets.symlinks.identifiers", lambda i: i["type"] == "TABLE"), F.lit(0))["name"]
    named = flat.withColumn("dataset", F.coalesce(table, F.col("d.name")))
    return named.join(newest_runs(events).select("namespace", "job", "run_id"), ["namespace", "job", "run_id"]).select("job", "direction", "dataset").distinct()
