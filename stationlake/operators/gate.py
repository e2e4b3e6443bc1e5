"""The quality gate: a suite of expectations with one row of result each, the marts' own checks, and the verdict
that both give; and the consistency of the lake's tables with each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationlake.functions.exprs import STATES
from stationlake.operators.quality import newest_day


@dataclass(frozen=True)
class Rule:
    """What is expected. ``broken``: a condition on a row; None for rules about the table."""

    name: str
    label: str
    broken: Column | None = None
    blocking: bool = True


FRESH_S = 300


def suite() -> list[Rule]:
    """Ten rules, in the order in which they are reported; the last only warns."""
    bikes, docks = F.col("bikes"), F.col("docks")
    return [
        Rule("row_count", "the newest day has rows"),
        Rule("column_set", "all expected columns are there"),
        Rule("station_not_null", "every row has a station", F.col("station_id").isNull()),
        Rule("snapshot_not_null", "every row has a time", F.col("snapshot_ts").isNull()),
        Rule("state_domain", "every state is a known one", ~F.col("state").isin(*STATES) & F.col("state").isNotNull()),
        Rule("bikes_not_negative", "no count of bikes is negative", bikes < 0),
        Rule("docks_not_negative", "no count of docks is negative", docks < 0),
        Rule("within_capacity", "bikes and docks are no more than the capacity", bikes + docks > F.col("capacity")),
        Rule("unique", "one row for each station and time"),
        Rule("fresh", "the newest row was processed less than five minutes ago", blocking=False),
    ]


def measured(status: DataFrame, expected: list[str], now: int) -> DataFrame:
    """(rule, success, observed, unexpected, elements) of the newest day: one pass for all rules about rows, and
    one count of the keys."""
    day = newest_day(status)
    rules = suite()
    counts = day.agg(F.count(F.lit(1)).alias("n"), F.max("processed_ts").alias("newest"), *(F.count_if(r.broken).alias(r.name) for r in rules if r.broken is not None))
    keys = day.groupBy("station_id", "snapshot_ts").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("unique"))
    missing = len(set(expected) - set(status.columns))
    n, age = F.col("n"), F.lit(now) - F.col("newest")
    nothing = F.lit(None).cast("long")

    def line(r: Rule) -> Column:
        if r.name == "row_count":
            value = (n >= 1, n, nothing)
        elif r.name == "column_set":
            value = (F.lit(missing == 0), nothing, F.lit(missing).cast("long"))
        elif r.name == "fresh":
            value = (F.coalesce(age <= FRESH_S, F.lit(False)), age, nothing)
        else:
            value = (F.col(r.name) == 0, nothing, F.col(r.name))
        return F.struct(F.lit(r.name).alias("rule"), value[0].alias("success"), value[1].cast("long").alias("observed"), value[2].alias("unexpected"), n.alias("elements"))

    return counts.join(F.broadcast(keys)).select(F.explode(F.array(*map(line, rules))).alias("r")).select("r.*")


def results(found: DataFrame) -> DataFrame:
    """One row for each rule of the suite, in its order, whatever ``found`` reports: a rule that it does not report
    has not succeeded. Status: ok, else fail, or warn for a rule that does not block."""
    spark = found.sparkSession
    rows = [(i, r.name, r.label, r.blocking) for i, r in enumerate(suite())]
    known = spark.createDataFrame(rows, "place int, rule string, label string, blocking boolean")
    joined = known.join(found, "rule", "left")
    success = F.coalesce("success", F.lit(False))
    status = F.when(success, "ok").when(F.col("blocking"), "fail").otherwise("warn")
    return joined.select("place", "rule", "label", "blocking", success.alias("success"), status.alias("status"), "observed", "unexpected", "elements").orderBy("place")


def mart_problems(marts: dict[str, DataFrame], daily_last: DataFrame, silver_last: DataFrame) -> DataFrame:
    """One row for each problem: a mart without rows, or a daily mart (one row: day) that ends before the day
    that precedes silver's newest (one row: day)."""
    out = None
    for name, mart in sorted(marts.items()):
        line = mart.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(f"{name}: no rows").alias("problem"))
        out = line if out is None else out.unionByName(line)
    ends = daily_last.select(F.col("day").alias("daily")).join(F.broadcast(silver_last.select(F.col("day").alias("silver"))))
    behind = F.col("silver").isNotNull() & (F.col("daily").isNull() | (F.col("daily") < F.date_sub("silver", 1)))
    text = F.concat(F.lit("daily mart ends "), F.coalesce(F.col("daily").cast("string"), F.lit("nowhere")), F.lit(", silver reaches "), F.col("silver").cast("string"))
    stale = ends.where(behind).select(text.alias("problem"))
    return stale if out is None else out.unionByName(stale)


def verdict(problems: DataFrame, tests: DataFrame, expectations: DataFrame, run: str) -> DataFrame:
    """One row: passed, and all problems in order. tests: (name, n) of violations; expectations: ``results`` with
    the run that wrote them (run). Results that are not all of the suite, or of another run, fail the gate."""
    failed = tests.where("n > 0").select(F.concat(F.lit("test "), "name", F.lit(": "), F.col("n").cast("string")).alias("problem"))
    names = F.array_sort(F.collect_list("rule"))
    usable = expectations.agg(names.alias("names"), F.coalesce(F.count_if(F.col("run") != run), F.lit(0)).alias("foreign"))
    whole = F.array(*(F.lit(x) for x in sorted(r.name for r in suite())))
    unusable = usable.where((F.col("names") != whole) | (F.col("foreign") > 0)).select(F.lit("expectations: no results of this run").alias("problem"))
    found = F.coalesce(F.concat(F.col("unexpected").cast("string"), F.lit(" unexpected rows")), F.col("observed").cast("string"), F.lit("not reported"))
    broken = expectations.where("status = 'fail'").select(F.concat(F.lit("expectation "), "rule", F.lit(": "), found).alias("problem"))
    every = problems.select("problem").unionByName(failed).unionByName(unusable).unionByName(broken)
    # a gate has a handful of problems
    listed = every.agg(F.array_join(F.array_sort(F.collect_list("problem")), "; ").alias("problems"), F.count(F.lit(1)).alias("n_problems"))
    tally = expectations.agg(*(F.coalesce(F.count_if(F.col("status") == s), F.lit(0)).alias(name) for s, name in (("ok", "rules_passed"), ("warn", "warnings"), ("fail", "rules_failed"))))
    return listed.join(F.broadcast(tally)).withColumn("passed", F.col("n_problems") == 0)


def lake_check(bronze: DataFrame, silver: DataFrame, commits: DataFrame, now: int, tables: tuple[str, ...] = ("bronze", "silver"), partitions: int = 6, behind_s: int = 300, most_age_s: int = 3600) -> DataFrame:
    """(check, found, passed): repeats in silver, repeated and missing offsets and partitions in bronze, silver's
    distance from bronze, and the age of the newest commit (table_name, committed_at, operation), that is no mere rewriting of
    files, of each of ``tables``. What can't be told, of an empty table or one without a commit, has not passed."""
    one = lambda d, name, found, good: d.select(F.lit(name).alias("check"), found.cast("long").alias("found"), F.coalesce(good, F.lit(False)).alias("passed"))
    keys = silver.groupBy("station_id", "snapshot_ts").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("v"))
    by = bronze.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("offset").alias("d"), (F.max("offset") - F.min("offset") + 1).alias("span"))
    offsets = by.agg(F.sum(F.col("n") - F.col("d")).alias("repeated"), F.sum(F.col("span") - F.col("d")).alias("missing"), F.count_if(F.col("partition").between(0, partitions - 1)).alias("seen"), F.count(F.lit(1)).alias("all"))
    ends = bronze.agg(F.max("snapshot_ts").alias("b")).join(F.broadcast(silver.agg(F.max("snapshot_ts").alias("s"))))
    out = one(keys, "silver repeats", F.col("v"), F.col("v") == 0)
    out = out.unionByName(one(offsets, "offsets repeated", F.col("repeated"), F.col("repeated") == 0)).unionByName(one(offsets, "offsets missing", F.col("missing"), F.col("missing") == 0))
    out = out.unionByName(one(offsets, "partitions", F.col("seen"), (F.col("seen") == partitions) & (F.col("all") == partitions)))
    out = out.unionByName(one(ends, "silver behind", F.col("b") - F.col("s"), F.col("b") - F.col("s") <= behind_s))
    real = commits.where(F.col("operation") != "replace").groupBy("table_name").agg((F.lit(now) - F.max("committed_at")).alias("age"))
    expected = commits.sparkSession.createDataFrame([(t,) for t in tables], "table_name string")
    aged = expected.join(real, "table_name", "left").select(F.concat(F.lit("commit age "), "table_name").alias("check"), F.col("age").cast("long").alias("found"), F.coalesce(F.col("age") <= most_age_s, F.lit(False)).alias("passed"))
    return out.unionByName(aged)


def ops_rules(jobs: DataFrame, tickets: DataFrame, stations: DataFrame) -> DataFrame:
    """(rule, n): rows that break the constraints of the operations tables."""
    def one(d: DataFrame, rules: dict[str, Column]) -> DataFrame:
        counts = d.agg(*(F.count_if(F.coalesce(bad, F.lit(False))).alias(f"r{i}") for i, bad in enumerate(rules.values())))
        return counts.select(F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n")) for i, name in enumerate(rules)))).alias("p")).select("p.*")

    c = F.col
    of_jobs = one(jobs, {
        "job status": ~c("status").isin("open", "assigned", "done", "cancelled"), "job assigned has van": (c("status") == "assigned") & c("van_id").isNull(),
        "job done has bikes": (c("status") == "done") & c("bikes_moved").isNull(), "job bikes in range": ~c("bikes_moved").between(0, 60),
        "job closed iff finished": c("closed_at").isNotNull() != c("status").isin("done", "cancelled"), "job closes after opening": c("closed_at") < c("opened_at"),
    })
    of_tickets = one(tickets, {
        "ticket status": ~c("status").isin("open", "closed"), "ticket dock number": c("dock_no") < 1, "ticket closed iff finished": c("closed_at").isNotNull() != (c("status") == "closed"),
        "ticket closes after opening": c("closed_at") < c("opened_at"),
    })
    known = stations.select("station_id").distinct()
    lost = lambda d, name: d.groupBy("station_id").agg(F.count(F.lit(1)).alias("k")).join(known, "station_id", "left_anti").agg(F.lit(name).alias("rule"), F.coalesce(F.sum("k"), F.lit(0)).alias("n"))
    twice = tickets.where("status = 'open'").groupBy("station_id", "dock_no").agg(F.count(F.lit(1)).alias("k")).agg(F.lit("one open ticket a dock").alias("rule"), F.count_if(F.col("k") > 1).alias("n"))
    return of_jobs.unionByName(of_tickets).unionByName(lost(jobs, "job of unknown station")).unionByName(lost(tickets, "ticket of unknown station")).unionByName(twice)
