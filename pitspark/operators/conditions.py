"""Conditions with three outcomes, hysteresis, and the fold of their outcomes over time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TESTS = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "eq": lambda a, b: a == b}


def outcome(value: Column, operator: str, threshold: float) -> Column:
    """'met', 'not_met', or 'not_evaluable' where the value is null."""
    return F.when(value.isNull(), "not_evaluable").when(_TESTS[operator](value, F.lit(threshold)), "met").otherwise("not_met")


def all_met(outcomes: list[Column]) -> Column:
    """'met' if all are, else 'not_met' if any is, else 'not_evaluable'."""
    met, failed = F.lit(True), F.lit(False)
    for o in outcomes:
        met, failed = met & (o == "met"), failed | (o == "not_met")
    return F.when(met, "met").when(failed, "not_met").otherwise("not_evaluable")


def relaxes(operator: str, entry: float, leave: float) -> bool:
    """Whether an exit threshold is at or beyond the entry in the direction that holds longer."""
    return operator in ("gt", "gte") and leave <= entry or operator in ("lt", "lte") and leave >= entry


def fold(evaluations: DataFrame, confirmations: int, cooldown: int) -> DataFrame:
    """Open and closed stretches of each stream from evaluations (stream, at long, entry, hold).

    A stretch opens when ``entry`` was 'met' at ``confirmations`` consecutive moments and no cooldown runs; it stays
    open while ``hold`` is 'met', and its cooldown runs from its opening. Null or not evaluable outcomes change nothing
    and break no count. Of several evaluations at one moment, the one with the greatest (entry, hold) counts. The fold
    reads each partition as a sorted stream and keeps four numbers, however long a stream is.
    """
    schema = "stream string, at long, event string"
    one = evaluations.where("stream is not null and at is not null").groupBy("stream", "at").agg(F.max(F.struct("entry", "hold")).alias("x"))
    ordered = one.select("stream", "at", "x.entry", "x.hold").repartition("stream").sortWithinPartitions("stream", "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, state = None, None
        for batch in batches:
            out = []
            for s, at, entry, hold in zip(batch["stream"], batch["at"].tolist(), batch["entry"], batch["hold"], strict=True):
                if s != stream:
                    stream, state = s, new_state()
                if event := step(state, at, entry, hold, confirmations, cooldown):
                    out.append((s, at, event))
            if out:
                yield pd.DataFrame(out, columns=["stream", "at", "event"])

    return ordered.mapInPandas(run, schema)


def replay(evaluations: DataFrame, confirmations: int, cooldown: int) -> DataFrame:
    """For each stream of evaluations (as ``fold``): how many moments there were, how many matched or could not be evaluated,
    the share that matched, how often a stretch opened and closed, and the first and last moment."""
    one = evaluations.where("stream is not null and at is not null").groupBy("stream", "at").agg(F.max(F.struct("entry", "hold")).alias("x"))
    n = lambda test: F.count(F.when(test, F.lit(1)))
    counts = one.groupBy("stream").agg(F.count(F.lit(1)).alias("evaluations"), n(F.col("x.entry") == "met").alias("matched"), n(F.col("x.entry") == "not_evaluable").alias("not_evaluable"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    events = fold(evaluations, confirmations, cooldown).groupBy("stream").agg(n(F.col("event") == "opened").alias("opened"), n(F.col("event") == "closed").alias("closed"))
    zero = F.lit(0).cast("long")
    return counts.join(events, "stream", "left").withColumns({"match_rate": F.round(F.col("matched") / F.col("evaluations"), 6), "opened": F.coalesce("opened", zero), "closed": F.coalesce("closed", zero)})


def transitions(events: DataFrame) -> DataFrame:
    """Stretches (stream, opened_at, closed_at) of the events of ``fold``; one that is still open has no end."""
    line = Window.partitionBy("stream").orderBy("at")
    following = events.withColumns({"__next": F.lead("at").over(line), "__kind": F.lead("event").over(line)})
    return following.where("event = 'opened'").select("stream", F.col("at").alias("opened_at"), F.when(F.col("__kind") == "closed", F.col("__next")).alias("closed_at"))


def new_state() -> dict:
    return {"count": 0, "open": False, "until": None, "last": None}


def step(state: dict, at: int, entry: str | None, hold: str | None, confirmations: int, cooldown: int) -> str | None:
    """Moves one stream's state by one evaluation and says what happened; an evaluation out of order changes nothing."""
    if state["last"] is not None and at <= state["last"]:
        return None
    state["last"] = at
    if state["open"]:
        if hold == "not_met":
            state["open"], state["count"] = False, 0
            return "closed"
        return None
    if entry == "met":
        state["count"] += 1
    elif entry == "not_met":
        state["count"] = 0
    if state["count"] >= confirmations and (state["until"] is None or at >= state["until"]):
        state["open"], state["until"] = True, at + cooldown
        return "opened"
    return None
