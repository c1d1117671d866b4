"""Axes of reference, lead and valid times, and path templates."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SECONDS = {"W": 604800, "D": 86400, "h": 3600, "m": 60, "s": 1}


def to_seconds(text: str | int) -> int | float:
    """Seconds of a duration like ``6h``: a whole number and W, D, h, m, s or ms."""
    if isinstance(text, int):
        return text
    m = re.fullmatch(r"\s*([+-]?\d+)\s*([A-Za-z]+)\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    if m[2] == "ms":
        return int(m[1]) / 1000
    if m[2] in ("Y", "M"):
        raise ValueError(f"{m[2]} has no fixed length: {text!r}")
    if m[2] not in _SECONDS:
        raise ValueError(f"unknown unit {m[2]!r} in {text!r}")
    return int(m[1]) * _SECONDS[m[2]]


def to_datetime(value: str | datetime) -> datetime:
    return value if isinstance(value, datetime) else datetime.fromisoformat(str(value))


def add_seconds(time: Column, seconds: Column) -> Column:
    """A timestamp without zone, moved by whole seconds."""
    return time + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def fill(template: str, values: dict) -> str:
    """``{name}``, ``{name:strftime(...)}`` and ``{name:int(%02d)}`` filled in; an unknown name is a KeyError."""

    def one(m: re.Match) -> str:
        value, form = values[m[1]], m[2]
        if form is None:
            return str(value)
        if f := re.fullmatch(r"strftime\((.*)\)", form):
            return value.strftime(f[1])
        if f := re.fullmatch(r"int\((.*)\)", form):
            return f[1] % int(value)
        raise ValueError(f"unknown format {form!r} in {template!r}")

    return re.sub(r"\{(\w+)(?::((?:[^{}()]|\([^()]*\))*))?\}", one, template)


@dataclass(frozen=True)
class Dates:
    """Runs from ``start`` to ``end``, both included, every ``period``; leads from 0 to ``range``, included, every ``step``."""

    start: str | datetime
    end: str | datetime
    period: str
    range: str
    step: str

    @property
    def reference_times(self) -> list[datetime]:
        first, last, by = to_datetime(self.start), to_datetime(self.end), timedelta(seconds=to_seconds(self.period))
        return [first + k * by for k in range((last - first) // by + 1)]

    @property
    def leads(self) -> list[int]:
        return list(range(0, int(to_seconds(self.range)) + 1, int(to_seconds(self.step))))

    @property
    def valid_times(self) -> list[datetime]:
        return sorted({r + timedelta(seconds=s) for r in self.reference_times for s in self.leads})

    def axis(self, spark: SparkSession) -> DataFrame:
        """``reference_time, lead_s, valid_time`` made in the cluster."""
        first, last = (to_datetime(x).isoformat(sep=" ") for x in (self.start, self.end))
        runs = spark.range(1).select(F.explode(F.expr(f"sequence(timestamp_ntz'{first}', timestamp_ntz'{last}', make_dt_interval(0, 0, 0, {to_seconds(self.period)}))")).alias("reference_time"))
        out = runs.select("reference_time", F.explode(F.sequence(*[F.lit(int(to_seconds(x))).cast("long") for x in (0, self.range, self.step)])).alias("lead_s"))
        return out.withColumn("valid_time", add_seconds(F.col("reference_time"), F.col("lead_s")))

    def substitute(self, template: str) -> list[str]:
        """Sorted paths, one for each run that gives another one."""
        return sorted({fill(template, {"reference_time": r}) for r in self.reference_times})
