"""Spaced repetition by the published FSRS-4.5 equations (no fuzz), folded over each card's reviews in order."""

from __future__ import annotations

import math
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published default parameters.
W = (0.4872, 1.4003, 3.7145, 13.8206, 5.1618, 1.2298, 0.8975, 0.031, 1.6474, 0.1367, 1.0461, 2.1072, 0.0793, 0.3246, 1.587, 0.2272, 2.8755)
DECAY, FACTOR = -0.5, 19 / 81


def retrievability(days: float, stability: float) -> float:
    return (1 + FACTOR * days / stability) ** DECAY


def interval(stability: float, retention: float = 0.9, most: int = 365) -> int:
    return int(min(most, max(1, round(stability / FACTOR * (retention ** (1 / DECAY) - 1)))))


def step(state: tuple[float, float] | None, rating: int, days: float) -> tuple[float, float]:
    """(stability, difficulty) after a rating from 1 (again) to 4 (easy), `days` after the last."""
    first = lambda r: min(10.0, max(1.0, W[4] - (r - 3) * W[5]))
    if state is None:
        return W[rating - 1], first(rating)
    s, d = state
    r = retrievability(days, s)
    nd = min(10.0, max(1.0, W[7] * first(3) + (1 - W[7]) * (d - W[6] * (rating - 3))))
    if rating == 1:
        return max(0.1, min(s, W[11] * d ** -W[12] * ((s + 1) ** W[13] - 1) * math.exp(W[14] * (1 - r)))), nd
    bonus = (W[15] if rating == 2 else 1.0) * (W[16] if rating == 4 else 1.0)
    return s * (1 + math.exp(W[8]) * (11 - d) * s ** -W[9] * (math.exp(W[10] * (1 - r)) - 1) * bonus), nd


class Fold:
    """A card's reviews in order, one at a time."""

    def __init__(self):
        self.state, self.last, self.reps, self.lapses = None, None, 0, 0

    def add(self, day: float, rating: int) -> None:
        self.lapses += rating == 1 and self.state is not None
        self.state = step(self.state, rating, 0.0 if self.last is None else max(0.0, day - self.last))
        self.last, self.reps = day, self.reps + 1

    def result(self) -> dict:
        s, d = self.state
        return {"reps": self.reps, "lapses": self.lapses, "stability": s, "difficulty": d, "last_day": self.last, "due_day": self.last + interval(s)}


def fold(reviews: list[tuple[float, int]]) -> dict:
    """reviews: (day, rating) in order."""
    f = Fold()
    for day, rating in reviews:
        f.add(day, rating)
    return f.result()


def schedule(reviews: DataFrame, card: str, ts: str, rating: str) -> DataFrame:
    """One row a card: reps, lapses, stability, difficulty, last_day, due_day (days since the epoch), in order of time, then rating. Rows without a card are left out.

    Sorted rows stream through their task and a card that a batch ends in is carried to the next, so no card's reviews are gathered. A card is
    one sequence: its reviews are read by one task.
    """
    rows = reviews.select(F.col(card).cast("long").alias(card), (F.unix_micros(F.col(ts).cast("timestamp")) / 8.64e10).alias("_d"), F.col(rating).alias("_r")).where(F.col(card).isNotNull())
    names = (card, "reps", "lapses", "stability", "difficulty", "last_day", "due_day")

    def run(batches):
        now, f = None, None
        for b in batches:
            out = []
            for c, own in groupby(zip(b[card], b["_d"], b["_r"], strict=True), key=lambda x: x[0]):
                if f is not None and c != now:
                    out.append({card: now} | f.result())
                    f = None
                now, f = c, f or Fold()
                for _, day, r in own:
                    f.add(day, r)
            yield pd.DataFrame(out, columns=list(names))
        if f is not None:
            yield pd.DataFrame([{card: now} | f.result()])

    return rows.repartition(card).sortWithinPartitions(card, "_d", "_r").mapInPandas(run, f"{card} long, reps int, lapses int, stability double, difficulty double, last_day double, due_day double")
