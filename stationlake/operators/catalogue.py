"""The pipeline's tables in the session's catalog: declared once, created where they are missing, read and written by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.session import JobConfig

#: Columns of each table, and the one that partitions it: days since 1970, or a month.
TABLES: dict[str, tuple[str, str | None]] = {
    "bronze.station_status": ("station_id STRING, snapshot_ts BIGINT, kafka_partition INT, kafka_offset BIGINT, kafka_ts BIGINT, raw_json STRING, day INT", "day"),
    "silver.station_status": ("station_id STRING, snapshot_ts BIGINT, state STRING, bikes BIGINT, docks BIGINT, capacity BIGINT, processed_ts BIGINT, day INT", "day"),
    "silver.availability_5m": ("window_start BIGINT, window_end BIGINT, station_id STRING, samples BIGINT, min_bikes BIGINT, avg_bikes DOUBLE, max_bikes BIGINT, share_empty DOUBLE, share_full DOUBLE, day INT", "day"),
    "silver.trips": ("start_code STRING, end_code STRING, started BIGINT, duration_s BIGINT, rider STRING, month STRING", "month"),
    "metrics.maintenance_runs": ("run_id STRING, table_name STRING, started_at BIGINT, finished_at BIGINT, status STRING, error STRING", None),
}


def _named(config: JobConfig, table: str) -> tuple[str, str]:
    namespace, name = config.table(table).split(".")
    return namespace, f"{namespace}.{name}"


def create(spark: SparkSession, root: str, config: JobConfig = JobConfig()) -> list[str]:
    """Namespaces and tables that are not there yet, with their files below ``root``; the names of those that were made. A table that is there keeps
    its columns and rows, but one whose columns are not those declared is refused."""
    made = []
    for table, (columns, by) in TABLES.items():
        namespace, name = _named(config, table)
        spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {namespace}")
        known = spark.catalog.tableExists(name)
        partitioned = f" PARTITIONED BY ({by})" if by else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{partitioned} LOCATION '{root.rstrip('/')}/{name.replace('.', '/')}'")
        want = spark.createDataFrame([], columns).dtypes
        if spark.table(name).dtypes != want:
            raise TypeError(f"{name} has columns {spark.table(name).dtypes}, not {want}")
        if not known:
            made.append(name)
    return made


def append(rows: DataFrame, table: str, config: JobConfig = JobConfig()) -> None:
    """Rows into a declared table, by the names of its columns; columns that it has not are left out."""
    columns, _ = TABLES[table]
    names = [f.name for f in rows.sparkSession.createDataFrame([], columns).schema]
    rows.select(*names).write.insertInto(_named(config, table)[1])


def layout(spark: SparkSession, config: JobConfig = JobConfig()) -> DataFrame:
    """(table_name, n, parts): rows and partitions of each declared table."""
    out = None
    for table, (_, by) in TABLES.items():
        line = spark.table(_named(config, table)[1]).agg(F.lit(table).alias("table_name"), F.count(F.lit(1)).alias("n"), (F.count_distinct(by) if by else F.lit(0).cast("long")).alias("parts"))
        out = line if out is None else out.unionByName(line)
    return out
