"""Percentages, ranks and predicates of checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marksheet import schema


def percent(part: Column, total: Column) -> Column:
    """To one decimal, half to even; null without a total; 100 only if nothing is missing."""
    value = F.bround(part * F.lit(100.0) / F.nullif(total, F.lit(0)), 1)
    return F.when(total <= 0, F.lit(None)).when((part < total) & (value >= 100), F.lit(99.9)).otherwise(value)


def rank_of(value: Column, order: list[str], default: int | None = None) -> Column:
    """The place of a value in a list, from 0."""
    place = F.array_position(F.array(*map(F.lit, order)), value) - 1
    return F.when(place >= 0, place).otherwise(F.lit(len(order) if default is None else default)).cast("int")


def report_rank(status: Column) -> Column:
    return rank_of(status, schema.STATUS_REPORT)


def severity_rank(severity: Column) -> Column:
    return rank_of(severity, schema.SEVERITY, schema.SEVERITY_DEFAULT)


def is_mandatory(mandatory: Column, bonus: Column, status: Column) -> Column:
    return mandatory & ~bonus & status.isin(*schema.MANDATORY)


def is_issue(status: Column) -> Column:
    return status.isin(*schema.ISSUE)


def status_filter(status: Column) -> Column:
    """Null where nothing is to be shown."""
    return F.when(status.isin(*schema.FAILING), F.lit("fail")).when(status.isin("warning", "bonus", "info"), status)


def test_origin(category: Column, provenance: Column) -> Column:
    """Which kind of test a check is: heuristic or derived if its category or its provenance says so, else explicit."""
    of = lambda kind: (category == f"{kind}_tests") | (provenance == kind)
    return F.when(of("heuristic"), "heuristic").when(of("derived"), "derived").otherwise("explicit")


def requirement_outcome(required: Column, bonus: Column) -> Column:
    """What a missing requirement means."""
    status = F.when(bonus, "bonus").when(required, "fail").otherwise("warning")
    return F.struct(status.alias("status"), (required & ~bonus).alias("mandatory"))


def delta_text(delta: Column) -> Column:
    return F.when(delta.isNull(), "first run").when(delta == 0, "±0").when(delta > 0, F.format_string("+%.1f", delta)).otherwise(F.format_string("−%.1f", F.abs(delta)))


def effective_timeout(value: Column, setting: Column, sentinel: float = 5.0) -> Column:
    """The sentinel defers to the setting; between 0.1 and 60 seconds."""
    return F.greatest(F.lit(0.1), F.least(F.lit(60.0), F.when(value == sentinel, setting).otherwise(value)))
