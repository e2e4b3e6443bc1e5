"""The pipeline's own series: minutes, latencies, backlog; and reports on micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlake.functions.exprs import age_text, freshness
from stationlake.operators.tables import Lake


def minute(c: str):
    return F.col(c) - F.pmod(F.col(c), F.lit(60))


def per_minute(status: DataFrame) -> DataFrame:
    return status.groupBy(minute("kafka_ts").alias("minute")).agg(F.count(F.lit(1)).alias("events"))


def latency(status: DataFrame) -> DataFrame:
    """Rows processed in each minute, with nearest-rank median and 95th percentile of their latency."""
    rank = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY processed_ts - fetched_ts)")
    return status.groupBy(minute("processed_ts").alias("minute")).agg(F.count(F.lit(1)).alias("processed"), rank(0.5).cast("long").alias("p50"), rank(0.95).cast("long").alias("p95"))


def series(status: DataFrame, minutes: int = 1440) -> DataFrame:
    """One row for each of the newest minutes: events, processed, latencies, and the backlog: what has been
    published up to then less what has been both published and processed, with all that came before."""
    end = status.agg(F.max(minute("processed_ts")).alias("m1"))
    # a day's minutes, whatever the history's length
    spine = end.select(F.explode(F.sequence(F.col("m1") - 60 * (minutes - 1), F.col("m1"), F.lit(60))).alias("minute"))
    done_at = F.greatest("kafka_ts", "processed_ts")
    first = F.broadcast(end.select((F.col("m1") - 60 * (minutes - 1)).alias("m0")))
    placed = lambda at, name: status.select((at - F.pmod(at, F.lit(60))).alias("m")).join(first).groupBy(F.greatest("m", F.col("m0") - 60).alias("minute")).agg(F.count(F.lit(1)).alias(name))
    flow = placed(F.col("kafka_ts"), "published").join(placed(done_at, "done"), "minute", "full_outer")
    recent = lambda c: status.join(first, F.col(c) >= F.col("m0"))
    lines = spine.join(flow, "minute", "full_outer").join(per_minute(recent("kafka_ts")), "minute", "left").join(latency(recent("processed_ts")), "minute", "left")
    run = Window.partitionBy().orderBy("minute")
    backlog = F.sum(F.coalesce("published", F.lit(0)) - F.coalesce("done", F.lit(0))).over(run)
    out = lines.select("minute", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("processed", F.lit(0)).alias("processed"), "p50", "p95", backlog.alias("lag_records"))
    return out.join(first).where(F.col("minute") >= F.col("m0")).drop("m0")


def write_minutes(lake: Lake, status: DataFrame, minutes: int = 1440, table: str = "pipeline_minutely") -> None:
    """The newest minutes of the series take the place of what the table has from the first of them on: rows that came late change older
    minutes, and a run that is repeated changes nothing. Days before are not touched. Refused if the window has not all its minutes."""
    window = series(status, minutes).withColumn("day", F.floor(F.col("minute") / 86400).cast("int"))
    kept = window.persist()
    try:
        n, first = kept.agg(F.count(F.lit(1)), F.min("minute")).first()
        if n == 0:
            return
        if n != minutes:
            raise ValueError(f"{n} minutes in a window of {minutes}")
        lake.replace_where(table, kept, F.col("minute") >= first, ("day",))
    finally:
        kept.unpersist()


def tiles(lines: DataFrame) -> DataFrame:
    """The last active hour: up to the newest minute with processed rows."""
    last = lines.agg(F.max(F.when(F.col("processed") > 0, F.col("minute"))).alias("top"), F.max_by("lag_records", "minute").alias("lag_records"))
    hour = lines.select("minute", "events", "p95").join(F.broadcast(last), (F.col("minute") <= F.col("top")) & (F.col("minute") > F.col("top") - 3600))
    return hour.agg(F.round(F.sum("events") / F.count(F.lit(1)), 1).alias("events_per_min"), F.max("p95").alias("latency_p95_s"), F.first("lag_records").alias("lag_records"))


def table_freshness(tables: dict[str, tuple[DataFrame, str]], now: int, streamed: tuple[str, ...] = ("status",)) -> DataFrame:
    """(table, rows, oldest, newest, status, age) of each table by its time column."""
    out = None
    for name, (df, c) in tables.items():
        line = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"), F.min(c).alias("oldest"), F.max(c).alias("newest"))
        out = line if out is None else out.unionByName(line)
    age = F.lit(now) - F.col("newest")
    return out.withColumns({"status": table_status(F.col("table_name").isin(*streamed), age), "age": age_text(age)})


def weighted_ranks(df: DataFrame, group: list[str], value: str, ranks: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Exact nearest-rank percentiles of values with weights: the first whose running weight reaches the rank."""
    return ranked(df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("w")), group, value, ranks)


def ranked(counted: DataFrame, group: list[str], value: str, ranks: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """The same of values that are counted already (w)."""
    whole = Window.partitionBy(*group)
    run = counted.withColumn("seen", F.sum("w").over(whole.orderBy(value))).withColumn("total", F.sum("w").over(whole))
    at = lambda q: F.min(F.when(F.col("seen") >= F.greatest(F.ceil(F.col("total") * F.lit(q)), F.lit(1)), F.col(value)))
    return run.groupBy(*group).agg(F.max("total").alias("n"), *(at(q).alias(f"p{round(q * 100)}") for q in ranks), F.max(value).alias("largest"))


def window_report(status: DataFrame) -> DataFrame:
    """One row: rows, micro-batches, events a minute and latencies of all that was processed."""
    ranks = weighted_ranks(status.select(F.lit(1).alias("g"), (F.col("processed_ts") - F.col("fetched_ts")).alias("latency")), ["g"], "latency")
    span = status.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("processed_ts").alias("batches"), F.round(F.count(F.lit(1)) * 60 / (F.max("kafka_ts") - F.min("kafka_ts")), 3).alias("events_per_min"))
    return span.join(F.broadcast(ranks.drop("g", "n")))


def pair_batches(batches: DataFrame, commits: DataFrame, key: str = "table_name", slack_s: int = 900) -> DataFrame:
    """Each batch (key, batch_ts, n) with the commit (key, commit_ts, n) that holds it: of its size, later than it,
    no later than ``slack_s`` after the last batch, and taken by none before it; in doubt the first.

    Among batches and commits of one table and size, numbered by time: batch i can take no commit before the
    first later one, f(i), nor the one that batch i - 1 took. So it takes number max(f(j) + i - j) over all j up to
    i, a running maximum. A pair that would put a batch's commit before that of an earlier batch is undone."""
    of = [key, "n"]
    ends = batches.groupBy(key).agg((F.max("batch_ts") + slack_s).alias("end"))
    near = commits.join(F.broadcast(ends), key).where(F.col("commit_ts") <= F.col("end")).select(*of, F.col("commit_ts").alias("ts"), F.lit(1).alias("commit"))
    both = batches.select(*of, F.col("batch_ts").alias("ts"), F.lit(0).alias("commit")).unionByName(near)
    # a commit at a batch's own second is not later than it
    timeline = Window.partitionBy(*of).orderBy("ts", F.desc("commit"))
    numbered = both.withColumn("commits", F.sum("commit").over(timeline)).withColumn("batches", F.sum(1 - F.col("commit")).over(timeline))
    waiting = numbered.where("commit = 0").withColumn("lead", F.max(F.col("commits") + 1 - F.col("batches")).over(timeline))
    wanted = waiting.select(*of, F.col("ts").alias("batch_ts"), (F.col("lead") + F.col("batches")).alias("number"))
    taken = numbered.where("commit = 1").select(*of, F.col("commits").alias("number"), F.col("ts").alias("commit_ts"))
    found = wanted.join(taken, [*of, "number"], "left")
    before = Window.partitionBy(key).orderBy("batch_ts").rowsBetween(Window.unboundedPreceding, -1)
    in_order = F.coalesce(F.col("commit_ts") > F.max("commit_ts").over(before), F.lit(True))
    return found.select(key, "batch_ts", "n", F.when(in_order, F.col("commit_ts")).alias("commit_ts"))


def sustained(groups: DataFrame, pairs: DataFrame, trigger_s: int = 60, key: str = "table_name") -> DataFrame:
    """One row for each table: batches, those without a commit, nearest-rank durations of batches and latencies up
    to the commit, and whether each batch was committed within a trigger. groups: (key, batch_ts, fetched_ts, n)."""
    took = pairs.withColumn("batch_s", F.col("commit_ts") - F.col("batch_ts"))
    spans = weighted_ranks(took.where("batch_s is not null"), [key], "batch_s").select(key, F.col("p50").alias("batch_p50_s"), F.col("p95").alias("batch_p95_s"), F.col("largest").alias("batch_max_s"))
    late = groups.join(took.select(key, "batch_ts", "commit_ts"), [key, "batch_ts"]).where("commit_ts is not null").select(key, (F.col("commit_ts") - F.col("fetched_ts")).alias("latency"), F.col("n").alias("w"))
    commit = ranked(late.groupBy(key, "latency").agg(F.sum("w").alias("w")), [key], "latency").select(key, F.col("p50").alias("commit_p50_s"), F.col("p95").alias("commit_p95_s"))
    counts = took.groupBy(key).agg(F.count(F.lit(1)).alias("batches"), F.count_if(F.col("commit_ts").isNull()).alias("unpaired"))
    good = (F.col("unpaired") == 0) & F.coalesce(F.col("batch_max_s") < trigger_s, F.lit(False))
    return counts.join(spans, key, "left").join(commit, key, "left").withColumn("sustained", good)


#: Ages (seconds) up to which a stream, and a daily job, is in order.
STREAM_S, DAY_S, TWO_DAYS_S = 300, 86400, 172800
ORDER = ("ok", "warn", "fail")


def worst(statuses: Column) -> Column:
    """The worst of an array of statuses: fail, else warn, else ok."""
    return F.when(F.array_contains(statuses, "fail"), "fail").when(F.array_contains(statuses, "warn"), "warn").otherwise("ok")


def table_status(streamed: Column, age_s: Column) -> Column:
    """A streamed table by its age (ok, warn, fail); any other only warns, after two days or without a commit."""
    return F.when(streamed & age_s.isNotNull(), freshness(age_s)).when(F.coalesce(age_s <= TWO_DAYS_S, F.lit(False)), "ok").otherwise("warn")


def newest_run(runs: DataFrame) -> DataFrame:
    """Rows of the maintenance run that finished last: (run_id, table_name, status, finished_at, ...)."""
    top = runs.agg(F.max_by("run_id", F.struct("finished_at", "run_id")).alias("run_id"))
    return runs.join(F.broadcast(top), "run_id")


def components(status: DataFrame, gate: DataFrame, runs: DataFrame, now: int) -> DataFrame:
    """(name, status, detail) of stream, quality and maintenance, and the worst of them as ``overall``. A detail is what was measured,
    as name=value pairs; it is empty where there is nothing to measure.

    gate: one row (passed, rules_passed, rules_failed, problems), or none; runs: all maintenance runs' rows."""
    c = F.col

    def line(one_row: DataFrame, name: str, word: Column, known: Column, **measured: Column) -> DataFrame:
        pairs = F.concat_ws(" ", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in measured.items()))
        return one_row.select(F.lit(name).alias("name"), word.alias("status"), F.when(known, pairs).otherwise("").alias("detail"))

    stream = status.agg((F.lit(now) - F.max("processed_ts")).alias("age"))
    told = gate.agg(*(F.first(x).alias(x) for x in ("passed", "rules_passed", "rules_failed", "problems")))
    judged = F.when(c("passed").isNull(), "warn").when(c("passed"), "ok").otherwise("fail")
    last = newest_run(runs).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("status") == "error").alias("bad"), (F.lit(now) - F.max("finished_at")).alias("age"))
    fresh = F.coalesce(c("age") <= TWO_DAYS_S, F.lit(False))
    kept = F.when(c("n") == 0, "warn").when(c("bad") > 0, "fail").when(fresh, "ok").otherwise("warn")
    parts = (
        line(stream, "stream", freshness(c("age")), c("age").isNotNull(), age_s=c("age"))
        .unionByName(line(told, "quality", judged, c("passed").isNotNull(), rules=c("rules_passed") + c("rules_failed"), failed=c("rules_failed"), problems=F.nullif(F.substring("problems", 1, 300), F.lit(""))))
        .unionByName(line(last, "maintenance", kept, c("n") > 0, tables=c("n"), failed=c("bad"), age_s=c("age")))
    )
    return parts.unionByName(parts.agg(F.collect_list("status").alias("s")).select(F.lit("overall").alias("name"), worst(F.col("s")).alias("status"), F.lit("").alias("detail")))


def median_run(runs: DataFrame) -> DataFrame:
    """Median, least and largest seconds of each query's timed runs (query, seconds)."""
    return runs.groupBy("query").agg(F.percentile("seconds", F.lit(0.5)).alias("median_s"), F.min("seconds").alias("least_s"), F.max("seconds").alias("most_s"), F.count(F.lit(1)).alias("runs"))


def coverage(bronze: DataFrame, silver: DataFrame, published: DataFrame) -> DataFrame:
    """After a crash: one row with ``duplicates`` (repeated offsets and repeated silver keys) and ``missing`` (gaps,
    and offsets that had been published before it but are not in bronze). published: (partition, end_offset)."""
    by = bronze.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("offset").alias("d"), F.min("offset").alias("low"), F.max("offset").alias("high"))
    held = published.join(by, "partition", "full_outer")
    late = F.greatest(F.col("end_offset") - 1 - F.coalesce("high", F.lit(-1)), F.lit(0))
    sums = held.agg(F.coalesce(F.sum(F.col("n") - F.col("d")), F.lit(0)).alias("repeats"), (F.coalesce(F.sum(F.col("high") - F.col("low") + 1 - F.col("d")), F.lit(0)) + F.coalesce(F.sum(late), F.lit(0))).alias("missing"))
    twice = silver.groupBy("station_id", "snapshot_ts").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("twice"))
    out = sums.join(F.broadcast(twice)).select((F.col("repeats") + F.col("twice")).alias("duplicates"), "missing")
    return out.withColumn("zero_loss", (F.col("duplicates") == 0) & (F.col("missing") == 0))
