"""Alert rules over sliding rates: evaluations, and intervals in which they were pending and fired."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``hits`` of all events of a window over its events of ``among``, above ``above``, for ``hold`` seconds."""

    name: str
    hits: str
    among: str
    above: float
    window: int
    hold: int


def evaluations(events: DataFrame, rules: list[Rule], step: int) -> DataFrame:
    """(rule, at, ratio, held): every rule at every ``step`` seconds at which its window before holds an event.

    ``at`` is the window's end in seconds since 1970. All rules read the events once; each event adds to as
    many windows of a rule as its window has steps, summed before the shuffle.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    first = F.floor(us / (step * 1_000_000)).cast("long") + 1  # the first evaluation after the event
    asked = []
    for r in rules:
        if r.window % step:
            raise ValueError(f"the window of {r.name} must be a number of steps")
        ends = F.transform(F.sequence(F.lit(0), F.lit(r.window // step - 1)), lambda k: (first + k) * step)
        asked.append(F.when(F.expr(r.among), F.struct(F.lit(r.name).alias("rule"), ends.alias("ends"), F.expr(r.hits).cast("int").alias("hit"), F.lit(r.above).alias("above"))))
    rows = events.select(F.explode(F.filter(F.array(*asked), lambda x: x.isNotNull())).alias("x")).select("x.rule", "x.hit", "x.above", F.explode("x.ends").alias("at"))
    g = rows.groupBy("rule", "at", "above").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    ratio = F.col("hits") / F.col("n")
    return g.select("rule", "at", ratio.alias("ratio"), (ratio > F.col("above")).alias("held"))


def intervals(rated: DataFrame, rules: list[Rule], step: int) -> DataFrame:
    """(rule, since, firing, resolved, peak) of evaluations (rule, at, ratio, held), by gaps and islands.

    An island is a run of evaluations that hold, ``step`` apart; a missing evaluation ends it. Evaluations of a rule are one
    row a step, however many events there were; they are ordered within blocks of a day's worth, whose
    runs are then joined where they touch.
    """
    holds = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.hold))])
    block = F.floor(F.col("at") / (step * 1440))
    rows = rated.filter("held").select("rule", "at", "ratio", block.alias("block"))
    runs = _joined(rows.select("rule", "block", F.col("at").alias("since"), F.col("at").alias("last"), F.col("ratio").alias("peak")), of=("rule", "block"), step=step)
    merged = _joined(runs, of=("rule",), step=step)
    hold = F.element_at(holds, F.col("rule")).cast("long")
    return merged.select(
        "rule", "since", F.when(F.col("last") - F.col("since") >= hold, F.col("since") + hold).alias("firing"), (F.col("last") + step).alias("resolved"), "peak"
    )


def _joined(runs: DataFrame, of: tuple[str, ...], step: int) -> DataFrame:
    """Runs (since, last, peak) of each group, those that follow each other by ``step`` made one."""
    order = Window.partitionBy(*of).orderBy("since")
    fresh = F.coalesce(F.col("since") - F.lag("last").over(order) != step, F.lit(True))
    number = F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    g = runs.withColumn("fresh", fresh).withColumn("run", number).groupBy(*of, "run")
    return g.agg(F.min("since").alias("since"), F.max("last").alias("last"), F.max("peak").alias("peak")).drop("run")


def state_at(at: Column) -> Column:
    """FIRING, PENDING or INACTIVE of an interval (since, firing, resolved) at a time."""
    inside = (at >= F.col("since")) & (at < F.col("resolved"))
    return F.when(inside & (at >= F.col("firing")), "FIRING").when(inside, "PENDING").otherwise("INACTIVE")
