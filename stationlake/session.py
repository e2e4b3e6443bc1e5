"""Sessions and the settings of a job, checked before anything starts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: What production writes to; a trial run must not.
PRODUCTION = {"checkpoints": "checkpoints", "status_topic": "gbfs.station_status", "alerts_topic": "gbfs.alerts", "state_topic": "gbfs.station_state"}


@dataclass(frozen=True)
class JobConfig:
    """prefix: empty for production, else that of a trial's tables (small letters and digits, then _)."""

    prefix: str = ""
    starting_offsets: str = "earliest"
    checkpoints: str = PRODUCTION["checkpoints"]
    status_topic: str = PRODUCTION["status_topic"]
    alerts_topic: str = PRODUCTION["alerts_topic"]
    state_topic: str = PRODUCTION["state_topic"]
    shuffle_partitions: int = 200
    catalog: dict[str, str] = field(default_factory=dict)

    def table(self, name: str) -> str:
        """A table's name within this run: bronze.status is trial_bronze.status for the prefix trial_."""
        return f"{self.prefix}{name}"

    def problems(self) -> list[str]:
        """Why a job with these settings must not start."""
        if not self.prefix:
            return [] if self.starting_offsets == "earliest" else ["production must read from the earliest offset, or it skips what has come since"]
        out = [] if re.fullmatch(r"[a-z][a-z0-9]*_", self.prefix) else [f"prefix {self.prefix!r} must be small letters and digits, then _"]
        return out + [f"a trial must not use production's {name}" for name, value in PRODUCTION.items() if getattr(self, name).rstrip("/") == value]

    def validate(self) -> JobConfig:
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self


def build_session(name: str, config: JobConfig = JobConfig(), listeners: tuple[str, ...] = (), master: str | None = None) -> SparkSession:
    """A session in UTC with the job's shuffle partitions and catalogs, and listeners (class names) where they are there.

    The number of shuffle partitions stays with a stream's state for good: set it before its first start."""
    config.validate()
    made = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", config.shuffle_partitions).config("spark.sql.adaptive.enabled", True)
    for key, value in config.catalog.items():
        made = made.config(f"spark.sql.catalog.{key}", value)
    if listeners:
        made = made.config("spark.extraListeners", ",".join(listeners))
    return (made.master(master) if master else made).getOrCreate()


def ask(spark: SparkSession, text: str, tables: dict[str, DataFrame], rows: int = 50) -> DataFrame:
    """What a query in SQL says of tables that go by their names: its first rows, as a console shows them."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text).limit(rows)
