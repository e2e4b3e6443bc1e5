"""Replica of an operations table from its change events: newest per key, guarded merge, comparison."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stationlake.functions.exprs import row_hash
from stationlake.operators.tables import Lake, evolve

KEY = ["order_id", "line"]
DATA = ["quantity", "status"]


def newest(events: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The newest event of each key by (lsn, offset): an aggregate that combines before the shuffle."""
    rest = [c for c in events.columns if c not in key]
    best = events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("lsn", "offset")).alias("r"))
    return best.select(*key, "r.*")


def merge(replica: DataFrame, batch: DataFrame, key: list[str] = KEY, data: list[str] = DATA) -> DataFrame:
    """The replica after a batch: a newer 'd' deletes, any other newer event updates, one for a new key inserts.

    replica: key, data, lsn. Events not newer than the stored row change nothing, so a replay changes nothing."""
    new = newest(batch, key).select(*key, "op", F.col("lsn").alias("new_lsn"), *(F.col(c).alias(f"new_{c}") for c in data))
    both = replica.join(new, key, "full_outer")
    newer = F.col("new_lsn").isNotNull() & (F.col("lsn").isNull() | (F.col("new_lsn") > F.col("lsn")))
    kept = both.where(~(newer & (F.col("op") == "d")))
    pick = lambda c, n: F.when(newer, F.col(n)).otherwise(F.col(c)).alias(c)
    return kept.select(*key, *(pick(c, f"new_{c}") for c in data), pick("lsn", "new_lsn"))


def empty(events: DataFrame, key: list[str] = KEY, data: list[str] = DATA) -> DataFrame:
    return events.limit(0).select(*key, *data, "lsn")


def changed(stored: DataFrame, new: DataFrame, key: list[str], attributes: list[str]) -> DataFrame:
    """Rows of ``new`` that are not stored, or differ from what is stored in some attribute."""
    old = stored.select(*key, F.lit(1).alias("known"), *(F.col(a).alias(f"old_{a}") for a in attributes))
    same = F.col("known").isNotNull()
    for a in attributes:
        same &= F.col(a).eqNullSafe(F.col(f"old_{a}"))
    return new.join(old, key, "left").where(~F.coalesce(same, F.lit(False))).select(*new.columns)


def op_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("status").pivot("op", ["c", "u", "d", "r"]).count().na.fill(0)


def checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and the sum of the leading 60 bits of all row hashes modulo 2**60, in any order."""
    part = F.conv(F.substring(row_hash(*(F.col(c) for c in columns)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), (F.sum(part) % F.lit(1 << 60).cast("decimal(38,0)")).cast("long").alias("digest"))


#: Types of the envelope's fields, by name or by semantic name, as Spark reads them.
TYPES = {"int16": "int", "int32": "int", "int64": "bigint", "float64": "double", "double": "double", "boolean": "boolean", "string": "string"}
SEMANTIC = {"io.debezium.time.ZonedTimestamp": "string", "io.debezium.time.MicroTimestamp": "bigint"}


def fields(schema: str) -> list[tuple[str, str, str | None]]:
    """(name, type to read, semantic name) of the columns that an envelope's schema (JSON text) declares."""
    row = next(f for f in json.loads(schema)["fields"] if f["field"] in ("after", "before"))
    out = []
    for f in row["fields"]:
        kind = SEMANTIC.get(f["name"]) if f.get("name") else TYPES.get(f["type"])
        if kind is None:
            raise TypeError(f"column {f['field']}: no type for {f.get('name') or f['type']}")
        out.append((f["field"], kind, f.get("name")))
    return out


#: A time with its zone at the end: Z, or an offset. Spark reads up to nine digits of a second and keeps six.
ZONED = r"^\d{4,}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,9})?)?(Z|[+-]\d\d:\d\d)$"


def zoned(c: Column) -> Column:
    """The instant of an ISO time with a zone; null for all else, such as a date alone."""
    whole = F.regexp_replace(c, r"T(\d\d:\d\d)([Z+-])", "T$1:00$2")  # Spark wants the seconds
    return F.when(c.rlike(ZONED), F.try_to_timestamp(whole))


def _typed(c: Column, semantic: str | None) -> Column:
    if semantic is None:
        return c
    if semantic.endswith("MicroTimestamp"):
        return F.timestamp_micros(c)
    return F.when(c.isNotNull(), F.coalesce(zoned(c), F.raise_error(F.concat(F.lit("not a zoned timestamp: "), c)).cast("timestamp")))


Types = dict[str, tuple[str, str | None]]


#: What is read of a message to judge it; the images stay text.
ENVELOPE = "schema string, payload struct<before: string, after: string, op: string, source: struct<lsn: string>>"
WRONG = ("without a schema", "with an unknown operation", "without the row's image")


def _image(op: Column, payload: Column) -> Column:
    return F.when(op == "d", payload["before"]).otherwise(payload["after"])


def _surveyed(messages: DataFrame, *by: Column) -> list:
    """One row for each different schema (and ``by``): its least lsn, and how many messages are wrong in which way. Schemas
    are few. Each message is read once, whatever is asked of it."""
    opened = messages.where(F.col("value").isNotNull()).select(*by, F.from_json("value", ENVELOPE).alias("v"))
    names = [c for c in opened.columns if c != "v"]
    op = F.col("v.payload.op")
    wrong = (F.col("v.schema").isNull(), ~F.coalesce(op.isin("c", "u", "d", "r"), F.lit(False)), _image(op, F.col("v.payload")).isNull())
    grouped = opened.groupBy(*names, F.col("v.schema").alias("schema"))
    return grouped.agg(F.min(F.col("v.payload.source.lsn").cast("long")).alias("lsn"), *(F.count_if(w).alias(n) for n, w in zip(WRONG, wrong, strict=True))).collect()


def _refuse(found: list) -> None:
    wrong = {n: sum(r[n] for r in found) for n in WRONG}
    if any(wrong.values()):
        raise ValueError("; ".join(f"{n} messages {what}" for what, n in wrong.items() if n))


def _columns(found: list, known: Types | None = None) -> Types:
    columns = dict(known or {})
    for row in sorted((r for r in found if r["schema"] is not None), key=lambda r: (r["lsn"] is not None, r["lsn"])):
        for name, kind, semantic in fields(row["schema"]):
            if columns.setdefault(name, (kind, semantic)) != (kind, semantic):
                raise TypeError(f"column {name} was {columns[name]}, now {(kind, semantic)}")
    return columns


def types_of(messages: DataFrame, known: Types | None = None) -> Types:
    """The columns that the messages' schemas declare, after those known from earlier batches; schemas are few, and each different one
    is read once, in order of lsn. A column that changed its type is refused."""
    return _columns(_surveyed(messages), known)


def decode(messages: DataFrame, known: Types | None = None) -> DataFrame:
    """Rows of one table's change messages (value as JSON text, offset): its columns, op, lsn, offset and the
    source's time. A deletion has the row as it was; a message without a value is a tombstone and is left out.
    Refused: a message without a schema, with an unknown operation, or without the image that its operation must have; a
    column of another type than in an earlier message, or than ``known``."""
    found = _surveyed(messages)
    _refuse(found)
    return _typed_rows(messages, _columns(found, known))


def _typed_rows(messages: DataFrame, columns: Types) -> DataFrame:
    """Messages that have been judged, as rows: schema and image are read in one go."""
    row = "struct<" + (", ".join(f"`{n}`: {k}" for n, (k, _) in columns.items()) or "none: string") + ">"
    body = F.from_json("value", f"payload struct<before: {row}, after: {row}, op: string, source: struct<lsn: string, ts_ms: string>>")
    p, r = F.col("v.payload"), F.col("r")
    rows = messages.where(F.col("value").isNotNull()).select("offset", body.alias("v")).withColumn("r", _image(p["op"], p))
    return rows.select(
        *(_typed(r[n], semantic).alias(n) for n, (_, semantic) in columns.items()), p["op"].alias("op"), p["source"]["lsn"].cast("long").alias("lsn"), "offset",
        F.timestamp_millis(p["source"]["ts_ms"].cast("long")).alias("source_ts"),
    )


def apply(lake: Lake, table: str, batch: DataFrame, key: list[str]) -> None:
    """One batch of decoded events into a replica: new columns come last and are null before; only the buckets of
    keys that the batch has are written."""
    data = [c for c in batch.columns if c not in (*key, "op", "lsn", "offset", "source_ts")]

    def rule(stored: DataFrame, rows: DataFrame) -> DataFrame:
        known = stored.select(*key, *(c for c in stored.columns if c not in (*key, "lsn", "op", "offset", "source_ts")), "lsn")
        evolve(known.schema, rows.select(*key, *data).schema)
        order = [*(c for c in known.columns if c not in (*key, "lsn"))]
        order += [c for c in data if c not in order]
        kinds = dict(known.dtypes) | dict(rows.dtypes)
        filled = lambda d: d.withColumns({c: F.lit(None).cast(kinds[c]) for c in order if c not in d.columns})
        return merge(filled(known), filled(rows), key, order).select(*key, *order, "lsn")

    # a batch is decoded once: its buckets and its rows are read from what is staged
    staged, _, path = lake._stage(table, batch)
    lake.merge(table, staged, key, rule)
    lake._delete(path)


def table_of(topic: Column) -> Column:
    """The table that a change topic (server.schema.table) is about."""
    return F.element_at(F.split(topic, r"\."), -1)


KEY_FIELDS = "$.schema.fields[*].field"


def _key_columns(table: str, found: set[str]) -> list[str]:
    if len(found) != 1:
        raise ValueError(f"{table}: keys of different columns")
    names = json.loads(found.pop())
    return [names] if isinstance(names, str) else names


def keys(messages: DataFrame) -> dict[str, list[str]]:
    """The key columns of each table, as the schema of its messages' keys declares them. Topics are few."""
    at = F.get_json_object("key", KEY_FIELDS)
    found = messages.where(F.col("key").isNotNull()).groupBy(table_of(F.col("topic")).alias("table")).agg(F.collect_set(at).alias("k")).collect()
    return {r["table"]: _key_columns(r["table"], set(r["k"])) for r in found}


def judged(messages: DataFrame, known: dict[str, Types] | None = None) -> dict[str, tuple[DataFrame, list[str], Types]]:
    """Of each table among change messages (topic, key, value, offset): its events, its key columns and its types. One pass finds topics, keys,
    schemas and what is wrong; a table's events are read from its own topics only."""
    found = _surveyed(messages, F.col("topic"), F.col("key").isNotNull().alias("keyed"), F.get_json_object("key", KEY_FIELDS).alias("k"))
    tables: dict[str, list] = {}
    for r in found:
        tables.setdefault(r["topic"].rpartition(".")[2], []).append(r)
    out = {}
    for table, own in sorted(tables.items()):
        if not any(r["keyed"] for r in own):
            continue  # a topic without keys is no table's
        key = _key_columns(table, {r["k"] for r in own if r["k"] is not None})
        _refuse(own)
        types = _columns(own, (known or {}).get(table))
        out[table] = (_typed_rows(messages.where(F.col("topic").isin(sorted({r["topic"] for r in own}))), types), key, types)
    return out


def decoded(messages: DataFrame, known: dict[str, Types] | None = None) -> dict[str, tuple[DataFrame, list[str]]]:
    """Of each table among change messages (topic, key, value, offset): its events and its key columns."""
    return {t: (events, key) for t, (events, key, _) in judged(messages, known).items()}


def apply_all(lake: Lake, messages: DataFrame) -> list[str]:
    """A batch of messages of many tables into their replicas; the tables. The types that a table's columns have had are
    kept with it, so that a batch in which one has changed is refused before anything of it is written."""
    tables = [r[0] for r in messages.select(table_of(F.col("topic"))).distinct().collect()]
    found = judged(messages, {t: {n: tuple(v) for n, v in (lake.note(t, "types") or {}).items()} for t in tables})
    for table, (events, key, types) in found.items():
        lake.keep_note(table, "types", {n: list(v) for n, v in types.items()})
        apply(lake, table, events, key)
    return list(found)


def source(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Change messages of all tables as a stream of files (topic, key, value, offset), ``files`` in a trigger."""
    return spark.readStream.schema("topic string, key string, value string, offset long").option("maxFilesPerTrigger", files).parquet(path)


def kafka(spark: SparkSession, servers: str, pattern: str) -> DataFrame:
    """The same from all topics of a pattern, from the earliest offset, a thousand messages in a trigger."""
    options = {"kafka.bootstrap.servers": servers, "subscribePattern": pattern, "startingOffsets": "earliest", "maxOffsetsPerTrigger": 1000}
    read = spark.readStream.format("kafka").options(**options).load()
    return read.select("topic", F.col("key").cast("string"), F.col("value").cast("string"), "offset")


def replicate(stream: DataFrame, lake: Lake, checkpoint: str) -> None:
    """A stream of messages applied batch by batch until its source is read; replays change nothing."""

    def batch(messages: DataFrame, _: int) -> None:
        if messages.limit(1).count():
            apply_all(lake, messages)

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def reset(lake: Lake, tables: list[str], checkpoint: str | None = None) -> None:
    """Drops replicas, and the checkpoint of the stream that made them, so that the next run starts anew."""
    lake.drop(*tables)
    if checkpoint:
        fs, at = lake._hadoop(checkpoint)
        fs.delete(at, True)


def replica_report(sources: dict[str, DataFrame], replicas: dict[str, DataFrame], evolved: dict[str, str] | None = None) -> DataFrame:
    """One row for each table: rows, columns and checksum on both sides, rows that have the evolved column, and
    whether the sides are equal."""
    out = None
    for table in sorted(sources):
        left, right = sources[table], replicas[table]
        names = sorted(c for c in left.columns if not c.startswith("_"))
        own = sorted(c for c in right.columns if not c.startswith("_"))
        missing = [c for c in names if c not in own]
        known = [c for c in names if c in own]
        a, b = checksum(left, known).toDF("source_rows", "source_digest"), checksum(right, known).toDF("replica_rows", "replica_digest")
        column = (evolved or {}).get(table)
        filled = right.agg((F.count(column) if column else F.lit(None).cast("long")).alias("evolved_rows"))
        same = (F.col("source_rows") == F.col("replica_rows")) & (F.col("source_digest").eqNullSafe(F.col("replica_digest"))) & F.lit(names == own)
        line = a.join(b).join(filled).select(F.lit(table).alias("table_name"), "source_rows", "replica_rows", F.lit(",".join(missing)).alias("missing_columns"), "evolved_rows", same.alias("equal"))
        out = line if out is None else out.unionByName(line)
    return out


def expected_counts(events: DataFrame, expected: DataFrame, by: str = "table_name") -> DataFrame:
    """Change events of each table by operation against what was expected (by, op, n): both sides, and whether all agree."""
    found = events.groupBy(by, "op").agg(F.count(F.lit(1)).alias("found"))
    both = found.join(expected.withColumnRenamed("n", "expected"), [by, "op"], "full_outer").na.fill(0, ["found", "expected"])
    return both.withColumn("ok", F.col("found") == F.col("expected"))
