"""Rows through a chain of models that may fail: a breaker for each model, batches that adapt, and where each row's answer came from.

Each row is answered by the first model of the chain that answers it. A model is a function from a list of texts to a list of answers; it may raise,
which fails the whole batch, or answer None for a row, which leaves that row to the next model. A breaker stops calling a model that keeps failing:

    closed      the model is called; `failures` failed calls in a row open it
    open        the model is passed over for `rest` batches that would have gone to it, then it is half open
    half open   the model is called once: success closes the breaker, failure opens it again

A failed call halves the next batches (`least` rows at least), a batch without a failure makes them `step` rows larger (`most` at most).

The order of rows is part of the result, so it is fixed: rows are dealt to lanes by a hash of their key, and in a lane they stand in the order of
their keys. A lane is a sequence like a client's of a model service; state does not cross lanes. How Spark cuts partitions and Arrow batches changes nothing,
and a task that runs again gives the same rows. Lanes are of bounded rows on average (`lane_rows`), so their number grows with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], list]


@dataclass
class Breaker:
    failures: int = 3
    rest: int = 5
    state: str = "closed"
    failed: int = 0
    waited: int = 0

    def allows(self) -> bool:
        if self.state == "open":
            self.waited += 1
            if self.waited <= self.rest:
                return False
            self.state = "half open"
        return True

    def succeeded(self) -> None:
        self.state, self.failed = "closed", 0

    def failed_once(self) -> None:
        self.failed += 1
        if self.state == "half open" or self.failed >= self.failures:
            self.state, self.failed, self.waited = "open", 0, 0


@dataclass
class Answer:
    """What a row got: the answer, the model that gave it (none: no model did), how many models were asked, and what went wrong on the way."""

    answer: str | None
    model: str | None
    asked: int
    errors: list[str]


class Chain:
    """The state of one lane."""

    def __init__(self, models: list[tuple[str, Model]], size: int = 16, least: int = 1, most: int = 64, step: int = 4, failures: int = 3, rest: int = 5):
        self.models, self.size, self.least, self.most, self.step = models, size, least, most, step
        self.breakers = {name: Breaker(failures, rest) for name, _ in models}

    def batch(self, texts: list[str]) -> list[Answer]:
        """The answers of one batch; changes the size of the next."""
        out = [Answer(None, None, 0, []) for _ in texts]
        left, stumbled = list(range(len(texts))), False
        for name, model in self.models:
            if not left:
                break
            breaker = self.breakers[name]
            if not breaker.allows():
                for i in left:
                    out[i].errors.append(f"{name}: passed over")
                continue
            try:
                got = model([texts[i] for i in left])
                if len(got) != len(left):
                    raise ValueError(f"{len(got)} answers for {len(left)} texts")
            except Exception as e:
                breaker.failed_once()
                stumbled = True
                for i in left:
                    out[i].asked += 1
                    out[i].errors.append(f"{name}: {e}")
                continue
            breaker.succeeded()
            for i, answer in zip(left, got, strict=True):
                out[i].asked += 1
                if answer is not None:
                    out[i].answer, out[i].model = answer, name
                else:
                    out[i].errors.append(f"{name}: no answer")
            left = [i for i in left if out[i].model is None]
        self.size = max(self.least, self.size // 2) if stumbled else min(self.most, self.size + self.step)
        return out

    def run(self, rows: Iterable[tuple]) -> Iterator[tuple[tuple, Answer]]:
        """(row, answer) of rows whose last value is the text."""
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) >= self.size:
                yield from zip(held, self.batch([r[-1] for r in held]), strict=True)
                held = []
        if held:
            yield from zip(held, self.batch([r[-1] for r in held]), strict=True)


def answer_rows(rows: DataFrame, key: str, text: str, models: list[tuple[str, Model]], lane_rows: int = 2000, **options) -> DataFrame:
    """key, lane, answer, model, asked, errors of each row; rows of one key come in the order of their texts, null texts are empty.

    models: (name, function) in the order they are asked; functions are sent to the executors and called there.
    """
    lanes = max(1, -(-rows.count() // lane_rows))
    kind = dict(rows.dtypes)[key]
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(lanes)).cast("int").alias("lane"), F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        def each():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        out: list[tuple] = []

        def flush():
            cols = list(zip(*out, strict=True))
            types = (None, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()))
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "lane", "answer", "model", "asked", "errors"])
            out.clear()
            return batch

        lane, chain, held = None, None, []

        def close():
            for (at, k, _), a in zip(held, chain.batch([r[-1] for r in held]) if held else [], strict=True):
                out.append((k, at, a.answer, a.model, a.asked, a.errors))
            held.clear()

        for row in each():
            if row[0] != lane:
                if chain is not None:
                    close()
                lane, chain = row[0], Chain(models, **options)
            held.append(row)
            if len(held) >= chain.size:
                close()
            if len(out) >= 1000:
                yield flush()
        if chain is not None:
            close()
        if out:
            yield flush()

    lined = dealt.repartition("lane").sortWithinPartitions("lane", "key", "text")
    return lined.mapInArrow(run, f"key {kind}, lane int, answer string, model string, asked int, errors array<string>").withColumnRenamed("key", key)
