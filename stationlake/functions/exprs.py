"""Column expressions that all operators share: times, ids, station states, canonical text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PACIFIC = "America/Los_Angeles"
PROBLEMS = ("empty", "full")
STATES = ("empty", "low", "ok", "high", "full", "offline")


@dataclass(frozen=True)
class Thresholds:
    stale_after_s: int = 1800
    low_count: int = 2
    low_share: float = 0.10
    alert_after_s: int = 900


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts).cast("long")


def wall(seconds: Column, zone: str = "UTC") -> Column:
    """The clock of a zone at an epoch, as a timestamp without zone."""
    utc = F.timestamp_add("SECOND", seconds, F.lit("1970-01-01").cast("timestamp_ntz"))
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def local_date(seconds: Column) -> Column:
    return F.to_date(wall(seconds, PACIFIC))


def local_hour(seconds: Column) -> Column:
    return F.hour(wall(seconds, PACIFIC)).cast("int")


def local_epoch(clock: Column) -> Column:
    """Epoch of a Pacific clock time (timestamp without zone): the first of two, and after a gap as before it."""
    return epoch(F.convert_timezone(F.lit(PACIFIC), F.lit("UTC"), clock))


def capacity(bikes: Column, docks: Column, bikes_out: Column, docks_out: Column | None = None) -> Column:
    out = bikes + F.coalesce(bikes_out, F.lit(0)) + docks
    return out if docks_out is None else out + F.coalesce(docks_out, F.lit(0))


def station_state(bikes: Column, docks: Column, size: Column, working: Column, age_s: Column, t: Thresholds = Thresholds()) -> Column:
    """offline, empty, full, low, high or ok: the first that holds."""
    few = lambda n: (n <= t.low_count) | (n <= size * F.lit(t.low_share))
    return (
        F.when(~working | (age_s > t.stale_after_s), "offline").when(bikes == 0, "empty").when(docks == 0, "full")
        .when(few(bikes), "low").when(few(docks), "high").otherwise("ok")
    )


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def r6(x: Column) -> Column:
    return F.round(x, 6)


def episode_id(station: Column, kind: Column, start: Column) -> Column:
    return F.concat_ws(":", station, kind, start.cast("string"))


def view(region: Column, lat: Column, lon: Column) -> Column:
    """The site's view of a station: by region, else by place."""
    by_region = F.when(region == "3", "sf").when(region == "5", "sj").when(region.isin("12", "13", "14"), "eastbay")
    return F.coalesce(by_region, F.when(lat < 37.5, "sj").when(lon > -122.36, "eastbay").otherwise("sf"))


def heat_bucket(share: Column) -> Column:
    """1 to 5 by the percentage (edges 5, 15, 30 and 50)."""
    pct = share * 100
    return F.when(pct < 5, 1).when(pct < 15, 2).when(pct < 30, 3).when(pct < 50, 4).otherwise(5)


def freshness(age_s: Column) -> Column:
    return F.when(age_s.isNull(), "fail").when(age_s <= 300, "ok").when(age_s <= 86400, "warn").otherwise("fail")


def age_text(s: Column) -> Column:
    unit = lambda n, word: F.concat(F.floor(s / n).cast("long").cast("string"), F.lit(f" {word}"))
    return F.when(s < 120, unit(1, "s")).when(s < 7200, unit(60, "min")).when(s < 172800, unit(3600, "h")).otherwise(unit(86400, "days"))


def _let(value: Column, then) -> Column:
    """then(value), with value computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def double_text(x: Column) -> Column:
    """The shortest text that reads as the same double: 0.1, 1e-05, 1e+16, 1234567890123456.0, -0.0, nan, inf. The exponent's form begins below
    1e-4 and at 1e16. Digits are the JVM's: before Java 19 a few in ten thousand doubles above 1e17 end in another last digit."""
    e15, e16, e17 = (F.format_string(f"%.{n}e", x) for n in (14, 15, 16))

    def spelt(p: Column) -> Column:
        digits, e = p["digits"], p["e"]
        rest = lambda n: F.substring(digits, n, F.lit(20))
        whole = F.concat(F.rpad(F.substring(digits, F.lit(1), e + 1), e + 1, F.lit("0")), F.lit("."), F.coalesce(F.nullif(rest(e + 2), F.lit("")), F.lit("0")))
        power = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
        many = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), rest(F.lit(2)))).otherwise(""), power)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        return F.when(e.between(0, 15), whole).when(e.between(-4, -1), small).otherwise(many)

    parts = lambda t: F.struct(F.rtrim(F.regexp_replace(F.substring_index(t, "e", 1), "[-.]", ""), F.lit("0")).alias("digits"), F.substring_index(t, "e", -1).cast("int").alias("e"))
    text = F.when(e15.cast("double") == x, e15).when(e16.cast("double") == x, e16).otherwise(e17)
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    known = F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf"))).when(x == 0, F.concat(sign, F.lit("0.0")))
    return known.otherwise(F.concat(sign, _let(text, lambda t: _let(parts(t), spelt))))


def canonical(x: Column) -> Column:
    """A value's text in checksums, the same whatever engine holds it: booleans as t and f, instants in ISO form with
    microseconds and zone, decimals without trailing zeros, doubles by ``double_text``, NULL as a text of its own; all else as Spark writes it."""
    text = x.cast("string")
    instant = F.concat(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    plain = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    of = F.typeof(x)
    by_kind = F.when(of == "boolean", F.when(text == "true", "t").otherwise("f")).when(of == "timestamp", instant).when(of.startswith("decimal"), plain).when(of.isin("double", "float"), double_text(text.try_cast("double"))).otherwise(text)
    return F.coalesce(by_kind, F.lit("\\N"))


def row_hash(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *map(canonical, columns)), 256)
