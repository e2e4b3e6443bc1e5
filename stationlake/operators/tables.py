"""Partitioned Parquet tables in a lake: appends, and writes that replace partitions and leave all others alone.

Spark's dynamic partition overwrite does the replacing: what is written is staged and checked first, and only partitions that
hold changed rows are written anew, by day or month, or by a bucket of the key. Where the catalog has a table
format, its MERGE and its compaction procedures do the same in one statement.

Beside its tables a lake keeps, in folders that begin with _:
_schemas   each table's columns, so that a read need not open every file's footer
_commits   one row for each write: what it did, when, and the files, bytes, rows and partitions that it added
_plans     the replacement that is under way; if its writer dies, the next one finishes it
_ledger    the newest batch of a stream that each table has, so that a batch that is delivered again is not written again
A table has one writer at a time."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET, BATCH = "bucket", "batch"
#: A merged table starts with so many buckets, and doubles them when one has more rows than MOST_ROWS.
BUCKETS, MOST_ROWS = 16, 4_000_000
#: A compaction sorts so many rows in a task: well packed files of few bytes may hold more than a task's memory does.
TASK_ROWS = 1_000_000
COMMIT = "table_name string, operation string, committed_at double, job string, files long, bytes long, rows long, partitions long"
#: Spark names the files of one write by its job.
JOB = r"part-\d+-([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})"
#: What a maintenance run tells of each table.
RUN = (
    "run_id string, table_name string, started_at long, finished_at long, status string, error string, files_before long, files_after long,"
    " bytes_before long, bytes_after long, rows_before long, rows_after long, snapshots_before long, snapshots_after long,"
    " delete_files_before long, delete_files_after long, orphan_files_removed long, partitions_after long"
)


class Lake:
    """Tables below one folder, each partitioned by its own columns."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    # --- small files beside the tables

    def _hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _delete(self, path: str) -> None:
        fs, at = self._hadoop(path)
        fs.delete(at, True)

    def _put(self, path: str, value: dict) -> None:
        """A small JSON file, whole or not at all: it gets its name when it is written."""
        fs, at = self._hadoop(path)
        _, part = self._hadoop(f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        jvm = self.spark._jvm
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(at), how)

    def _get(self, path: str) -> dict | None:
        fs, at = self._hadoop(path)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def note(self, table: str, name: str) -> dict | None:
        """What is kept beside a table under a name."""
        return self._get(f"{self.root}/_schemas/{table}.{name}.json")

    def keep_note(self, table: str, name: str, value: dict) -> None:
        if self.note(table, name) != value:
            self._put(f"{self.root}/_schemas/{table}.{name}.json", value)

    def _names(self, path: str) -> list[str]:
        fs, at = self._hadoop(f"{path}/[!_.]*")
        return sorted(s.getPath().getName() for s in fs.globStatus(at) or ())

    # --- tables

    def exists(self, table: str) -> bool:
        """Whether the table has a file or a partition; a first batch without rows leaves an empty folder."""
        return bool(self._names(self.path(table)))

    def existing(self, tables: list[str]) -> list[str]:
        """Those of the tables that are there: a report leaves out the others."""
        return [t for t in tables if self.exists(t)]

    def schema(self, table: str) -> T.StructType | None:
        known = self._get(f"{self.root}/_schemas/{table}.json")
        return known and T.StructType.fromJson(known)

    def read(self, table: str) -> DataFrame:
        """The table; columns that came later are null in older files. Only a table that others wrote is asked for its footers."""
        known = self.schema(table)
        reader = self.spark.read.schema(known) if known else self.spark.read.option("mergeSchema", True)
        return reader.parquet(self.path(table))

    def _evolve(self, table: str, schema: T.StructType) -> None:
        """The table's columns with those that are new; a change of type is refused."""
        known = self.schema(table) or (self.read(table).schema if self.exists(table) else T.StructType())
        if added := evolve(known, schema):
            # columns of a Parquet file may always be missing
            fields = [T.StructField(f.name, f.dataType, True) for f in [*known, *added]]
            self._put(f"{self.root}/_schemas/{table}.json", json.loads(T.StructType(fields).json()))

    def create(self, table: str, schema: str, by: tuple[str, ...] = ()) -> bool:
        """The table's columns and its folder, if it is not there yet; whether it was made."""
        if self.schema(table):
            return False
        return self._made(table, self.spark.createDataFrame([], schema).schema)

    def _made(self, table: str, schema: T.StructType) -> bool:
        """A table without rows, which can be read."""
        self._evolve(table, schema)
        fs, at = self._hadoop(self.path(table))
        return fs.mkdirs(at)

    def _write(self, table: str, df: DataFrame, by: tuple[str, ...], mode: str, operation: str, overwrite: str = "dynamic") -> int:
        """Writes, and adds a row to the commits; the number of rows."""
        self._evolve(table, df.schema)
        seen = Observation()
        counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
        counted.write.mode(mode).option("partitionOverwriteMode", overwrite).partitionBy(*by).parquet(self.path(table))
        n = seen.get["n"]
        self._commit(table, operation, n)
        return n

    def _listing(self, table: str) -> DataFrame:
        """(job, partition, length) of the table's data files; their content is not read."""
        if not self.exists(table):
            return self.spark.createDataFrame([], "job string, partition string, length long")
        files = self.spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="part-*").load(self.path(table))
        part = F.array_join(F.filter(F.split("path", "/"), lambda x: x.contains("=")), "/")
        return files.select(F.regexp_extract("path", JOB, 1).alias("job"), part.alias("partition"), "length")

    def _commit(self, table: str, operation: str, rows: int) -> None:
        """One row for the job whose files no earlier commit has; a write without files has none."""
        known = self.commits(table).select("job").where("job is not null")
        added = self._listing(table).join(known, "job", "left_anti").groupBy("job").agg(
            F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.count_distinct("partition").alias("partitions")
        )
        last = added.collect()  # jobs without a commit: this one, and any that died before their commit
        now = time.time()
        row = {"table_name": table, "operation": operation, "committed_at": now, "job": None, "files": 0, "bytes": 0, "rows": rows, "partitions": 0}
        for r in last or [None]:
            more = r.asDict() if r else {}
            self._put(f"{self.root}/_commits/{table}/{int(now * 1e6):020d}-{uuid.uuid4().hex}.json", row | more | ({} if len(last) < 2 else {"rows": None}))

    def commits(self, *tables: str) -> DataFrame:
        """The writes of the tables (of all, if none is named), in no order."""
        names = tables or self._names(f"{self.root}/_commits")
        there = [f"{self.root}/_commits/{t}" for t in names if self._names(f"{self.root}/_commits/{t}")]
        return self.spark.read.schema(COMMIT).json(there) if there else self.spark.createDataFrame([], COMMIT)

    def partitions(self, table: str) -> DataFrame:
        """(table_name, partition, files, bytes, commits) of each partition."""
        grouped = self._listing(table).groupBy("partition").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.count_distinct("job").alias("commits"))
        return grouped.select(F.lit(table).alias("table_name"), "*")

    # --- writes

    def replace(self, table: str, df: DataFrame, by: tuple[str, ...] = ()) -> int:
        """The whole table anew: for small ones, such as dimensions, and marts. Its columns may be others than before."""
        self.recover(table)
        if not self.exists(table):
            return self._write(table, df, by, "overwrite", "overwrite", "static")
        staged, n, path = self._stage(table, df)
        self._delete(f"{self.root}/_schemas/{table}.json")
        self._swap(table, path, staged.schema, by, [], "overwrite", "static")
        return n

    def append(self, table: str, df: DataFrame, by: tuple[str, ...] = ()) -> int:
        """Further rows; columns may be added, a change of type is refused."""
        self.recover(table)
        return self._write(table, df, by, "append", "append")

    def append_once(self, table: str, df: DataFrame, query: str, batch: int, by: tuple[str, ...] = ()) -> bool:
        """A stream's batch, exactly once however often it is delivered; whether it was written now.

        Its rows go to a partition of their own, which is emptied first, and count only when the ledger has the batch: a writer that
        dies between the two leaves what ``committed`` does not read, and the next delivery writes it anew; one
        that dies after the ledger is told finds it there."""
        if batch <= self.newest_batch(table, query):
            df.write.format("noop").mode("overwrite").save()  # a stateful query keeps its state only if its rows are computed
            return False
        self._delete(f"{self.path(table)}/{BATCH}={batch}")
        self._write(table, df.withColumn(BATCH, F.lit(batch).cast("long")), (BATCH, *by), "append", "append")
        self._put(f"{self.root}/_ledger/{table}/{query}.json", {"batch": batch, "at": time.time()})
        return True

    def newest_batch(self, table: str, query: str) -> int:
        known = self._get(f"{self.root}/_ledger/{table}/{query}.json")
        return known["batch"] if known else -1

    def committed(self, table: str, query: str) -> DataFrame:
        """The rows of all batches that the ledger has, without their batch."""
        return self.read(table).where(F.col(BATCH) <= self.newest_batch(table, query)).drop(BATCH)

    def fold(self, table: str, query: str, by: tuple[str, ...] = ()) -> None:
        """All batches that the ledger has become one partition, so that small batches do not pile up."""
        newest = self.newest_batch(table, query)
        rows = self.read(table).where(F.col(BATCH) <= newest)
        self._rewrite(table, _distinct(rows, (BATCH,)), rows.withColumn(BATCH, F.lit(newest).cast("long")), (BATCH,), "replace", by)

    def replace_partitions(self, table: str, df: DataFrame, by: tuple[str, ...], check: Column | None = None) -> int:
        """The partitions that df has rows of are replaced by them, and counted back. df is computed once, into the staging
        folder; refused before anything else is written if a row there fails ``check``. Gives the number of rows."""
        self.recover(table)
        staged, n, path = self._stage(table, df)
        bad = staged.where(~F.coalesce(check, F.lit(False))).count() if check is not None else 0
        if bad:
            self._delete(path)
            raise ValueError(f"{table}: {bad} of {n} rows fail the check")
        touched = _within(_distinct(staged, by), by)
        self._swap(table, path, staged.schema, by, [], "overwrite")
        stored = self.read(table).where(touched).count()
        if stored != n:
            raise ValueError(f"{table}: {n} rows written, {stored} read back")
        return n

    def _stage(self, table: str, df: DataFrame) -> tuple[DataFrame, int, str]:
        """df, computed once and written to a staging folder; its number of rows, and the folder."""
        seen = Observation()
        path = f"{self.root}/_next/{table}/{uuid.uuid4().hex}"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), seen.get["n"], path

    def _swap(self, table: str, staged: str, schema: T.StructType, by: tuple[str, ...], gone: list[str], operation: str, overwrite: str = "dynamic", deal: dict | None = None) -> None:
        """What is staged becomes the partitions that it has rows of (all there is, if ``overwrite`` is static), and those of
        ``gone`` go. The plan is written first and deleted last, and each step may be repeated, so that ``recover`` can
        finish what a writer left. deal: the number of files, and what they are dealt and sorted by."""
        plan = {"staged": staged, "schema": json.loads(schema.json()), "by": list(by), "gone": gone, "operation": operation, "overwrite": overwrite, "deal": deal}
        self._put(f"{self.root}/_plans/{table}.json", plan)
        self._finish(table, plan)

    def _finish(self, table: str, plan: dict) -> None:
        rows = self.spark.read.schema(T.StructType.fromJson(plan["schema"])).parquet(plan["staged"])
        if deal := plan["deal"]:
            n, by, sort = deal["files"], plan["by"], deal["sort"]
            # a large partition is dealt to several tasks, and small ones that follow each other share one
            rows = rows.repartitionByRange(n, *by, *sort).sortWithinPartitions(*by, *sort)
        self._write(table, rows, tuple(plan["by"]), "overwrite", plan["operation"], plan["overwrite"])
        for part in plan["gone"]:
            self._delete(f"{self.path(table)}/{part}")
        self._delete(f"{self.root}/_plans/{table}.json")
        self._delete(plan["staged"])

    def recover(self, table: str) -> bool:
        """Finishes a replacement whose writer died; whether there was one."""
        plan = self._get(f"{self.root}/_plans/{table}.json")
        if plan:
            self._finish(table, plan)
        return bool(plan)

    def _rewrite(self, table: str, before: set[tuple], rows: DataFrame, by: tuple[str, ...], operation: str = "overwrite", inner: tuple[str, ...] = ()) -> list | None:
        """rows become all there is in the partitions ``before``; those that are left without rows go. Gives the number of
        rows of each partition."""
        if not before:
            return None
        staged, _, path = self._stage(table, rows)  # what is read must not be overwritten while it is read
        counts = staged.groupBy(*by).count().collect()
        gone = ["/".join(f"{c}={v}" for c, v in zip(by, part, strict=True)) for part in before - {tuple(r)[:-1] for r in counts}]
        self._swap(table, path, staged.schema, (*by, *inner), gone, operation)
        return counts

    def replace_where(self, table: str, df: DataFrame, where: Column, by: tuple[str, ...]) -> None:
        """Rows that ``where`` holds for go, and df comes; only partitions that either touches are read and written."""
        self.recover(table)
        if not self.exists(table):
            self.append(table, df, by)
            return
        stored = self.read(table)
        touched = _distinct(stored.where(where).select(*by).union(df.select(*by)), by)
        near = stored.where(_within(touched, by)).where(~F.coalesce(where, F.lit(False)))
        self._rewrite(table, touched, near.unionByName(df, allowMissingColumns=True), by)

    def upsert(self, table: str, df: DataFrame, key: list[str], newer: str) -> None:
        """One row of each key: the stored one, unless df has one whose ``newer`` is not older. Replays change nothing."""

        def best(stored: DataFrame, rows: DataFrame) -> DataFrame:
            rest = [c for c in rows.columns if c not in key]
            both = stored.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
            return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(newer, "_new")).alias("r")).select(*key, "r.*")

        self.merge(table, df, key, best)

    def merge(self, table: str, df: DataFrame, key: list[str], rule: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``rule(stored, df)`` for the buckets of the key that df has rows of; the table is partitioned by bucket.

        The number of buckets grows with the table, by doubling, so that a bucket stays below MOST_ROWS rows and a batch
        with few keys writes little of a large table; in the batch that doubles it, the whole table is dealt anew."""
        self.recover(table)
        layout = self.note(table, "buckets") or {"n": BUCKETS, "full": False}
        stored = self.read(table) if self.exists(table) else None
        n = layout["n"] * (2 if layout["full"] and stored is not None else 1)
        bucket = F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
        if stored is not None and n > layout["n"]:
            touched = _distinct(stored, (BUCKET,))
        else:
            touched = _distinct(df.select(bucket.alias(BUCKET)), (BUCKET,))
            stored = stored if stored is None else stored.where(_within(touched, (BUCKET,)))
        out = rule(df.limit(0) if stored is None else stored.drop(BUCKET), df).withColumn(BUCKET, bucket)
        if stored is None and not touched:
            self._made(table, out.schema)  # a first batch without rows: the table is there, and empty
        counts = self._rewrite(table, touched, out, (BUCKET,))
        full = any(r["count"] > MOST_ROWS for r in counts or ()) or (layout["full"] and n == layout["n"])
        if counts is not None:
            self.keep_note(table, "buckets", {"n": n, "full": full})

    def rows(self, table: str) -> DataFrame:
        """A merged table without its bucket."""
        return self.read(table).drop(BUCKET)

    def drop(self, *tables: str) -> None:
        """The tables, with what is kept beside them."""
        for t in tables:
            for path in (t, f"_schemas/{t}.json", f"_schemas/{t}.buckets.json", f"_schemas/{t}.types.json", f"_commits/{t}", f"_plans/{t}.json", f"_ledger/{t}", f"_next/{t}"):
                self._delete(f"{self.root}/{path}")

    # --- files and upkeep

    def files(self, table: str) -> DataFrame:
        """(table_name, partition, file, n, bytes) of the table's files."""
        at = self.read(table).select("_metadata.file_path", "_metadata.file_size")
        files = at.groupBy("file_path", "file_size").agg(F.count(F.lit(1)).alias("n"))
        part = F.array_join(F.filter(F.split("file_path", "/"), lambda x: x.contains("=")), "/")
        return files.select(F.lit(table).alias("table_name"), part.alias("partition"), F.col("file_path").alias("file"), "n", F.col("file_size").alias("bytes"))

    def _measure(self, table: str, chosen: Column) -> dict[str, int]:
        """Files, bytes and rows of the chosen partitions, and partitions and commits of the table."""
        files = self.read(table).where(chosen).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).groupBy("f", "b").agg(F.count(F.lit(1)).alias("n"))
        own = files.agg(F.count(F.lit(1)).alias("files"), F.sum("b").alias("bytes"), F.sum("n").alias("rows")).first().asDict()
        return own | {"partitions": self.partitions(table).count(), "snapshots": self.commits(table).count()}

    def compact(self, table: str, sort: list[str], by: tuple[str, ...] = (), partition: Column | None = None, target_bytes: int = 100 << 20) -> DataFrame:
        """Rewrites a table, or one of its partitions, in files of about ``target_bytes`` and ``TASK_ROWS`` rows at most, sorted within; rows must stay
        as many. One row: files, bytes, rows and commits before and after, and partitions after."""
        self.recover(table)
        chosen = F.lit(True) if partition is None else partition
        before = self._measure(table, chosen)
        rows = self.read(table).where(chosen)
        parts = max(1, math.ceil((before["bytes"] or 0) / target_bytes), math.ceil((before["rows"] or 0) / TASK_ROWS))
        staged, n, path = self._stage(table, rows)
        if n != (before["rows"] or 0):
            self._delete(path)
            raise ValueError(f"{table}: {before['rows']} rows before, {n} after")
        self._swap(table, path, staged.schema, by, [], "replace", "dynamic" if by else "static", {"files": parts, "sort": sort})
        after = self._measure(table, chosen)
        names = ("files", "bytes", "rows", "snapshots")
        values = {f"{c}_{when}": m[c] for c in names for when, m in (("before", before), ("after", after))} | {"partitions_after": after["partitions"]}
        return self.spark.createDataFrame([tuple(values.values())], ", ".join(f"{c} long" for c in values))

    def orphans(self, table: str) -> int:
        """Staged files that no plan needs any more: deleted, and counted."""
        plan = self._get(f"{self.root}/_plans/{table}.json") or {}
        found = 0
        for name in self._names(f"{self.root}/_next/{table}"):
            path = f"{self.root}/_next/{table}/{name}"
            if path != plan.get("staged"):
                found += len([x for x in self._names(path) if x.startswith("part-")])
                self._delete(path)
        return found

    def maintain(self, plan: dict[str, tuple[list[str], tuple[str, ...]]], run_id: str, started_at: int, finished_at: int) -> DataFrame | None:
        """Compacts each table of the plan (sort columns, partition columns): one audit row each, with status ok, error, or skipped
        for a table that is not there, appended to ``maintenance_runs`` in one write. There are no delete files."""
        rows = []
        for table in sorted(plan):
            sort, by = plan[table]
            row = {"run_id": run_id, "table_name": table, "started_at": started_at, "finished_at": finished_at, "status": "skipped"}
            if self.exists(table):
                try:
                    self.recover(table)
                    gone = self.orphans(table)
                    row |= self.compact(table, sort, by).first().asDict() | {"status": "ok", "delete_files_before": 0, "delete_files_after": 0, "orphan_files_removed": gone}
                except ValueError as e:
                    row |= {"status": "error", "error": str(e)}
            rows.append(row)
        if not rows:
            return None
        out = self.spark.createDataFrame(rows, RUN)
        self.append("maintenance_runs", out)
        return out


def _distinct(rows: DataFrame, by: tuple[str, ...]) -> set[tuple]:
    """The partitions that rows are in: days, months or buckets, so not many."""
    return {tuple(r) for r in rows.select(*by).distinct().collect()}


def _within(parts: set[tuple], by: tuple[str, ...]) -> Column:
    """Whether a row is in one of the partitions, by their values, so that only their files are read."""
    if len(by) == 1:
        return F.col(by[0]).isin([p[0] for p in parts])
    some = F.lit(False)
    for p in parts:
        every = F.lit(True)
        for c, v in zip(by, p, strict=True):
            every &= F.col(c).eqNullSafe(F.lit(v))
        some |= every
    return some


def evolve(old: T.StructType, new: T.StructType) -> list[T.StructField]:
    """The columns that new adds to old, in its order; raises if a column changed its type."""
    known = {f.name: f.dataType for f in old}
    for f in new:
        if f.name in known and known[f.name].simpleString() != f.dataType.simpleString():
            raise TypeError(f"column {f.name} was {known[f.name].simpleString()}, now {f.dataType.simpleString()}")
    return [f for f in new if f.name not in known]
