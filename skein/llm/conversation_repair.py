"""Repair of conversations' structure: forward Viterbi over four grammar states, with exact ties.

The roles of a sound conversation begin with `(s?(ua)+)?`: nothing, or an optional system turn and pairs of user and assistant. Its four states are
START, SYSTEM, USER and ASSISTANT; a conversation may end in START or ASSISTANT. Each row is kept (0), given the role user or assistant (3) or
deleted (4; blank rows and duplicates always), rows kept or given a role cost 3 more if truncated, and empty turns of user or assistant may be inserted
anywhere (3). The cheapest edits win, of equals the string of their initials that is ASCII-least.

1. All rows are sorted once by (conversation, turn, role, text), range-partitioned, so that a conversation of any size is spread over many tasks.
   A row is a duplicate if it is not the first of its (conversation, role, text): the first ones are aggregated before the shuffle and matched by row
   number, which no value is hot in.
2. Every task runs the DP over its part of each conversation, carrying (cost, edits) for each state, a row's layer closed by at most three inserts.
   The part of a conversation that may have begun in an earlier task is run from each of the four states.
3. The parts' results are chained in order: one row for each part. Edits of equal cost cannot be prefixes of each other after the same rows (what one
   has more would be inserts, which cost), so keeping the least string of each state is exact.
4. The edits go back to the rows by row number. Digests of a conversation read its repaired rows as a sorted stream and hold one row at a time.

Edits are carried as letters that also tell the role: D, I/J (insert user/assistant), K, R/S (to assistant/user); where two paths first differ they
are in the same state, so these letters order as the initials do.

Defined results: null roles and texts count as one space, null turns come first, rows of one turn in the order of role and text. Roles that do not begin
with s, u or a, the empty one too, cannot be kept. Null conv_ids are one conversation. Repeated rows are duplicates. A conversation without rows has
an empty audit at no cost. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, numbered, sliced

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, ROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANK = " \t\n\x0b\x0c\r"
#: Rows after which what the states' strings have in front is put away, and rows of an output list.
FREEZE, PIECES = 128, 1 << 14
_KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_INITIALS = "sua"


class Paths:
    """The cheapest edits that lead to each state: cost, the rank of what has been put away, and what came since."""

    def __init__(self, start: int | None = None):
        """start: the only state there is; None: the beginning of a conversation, with inserts before its first row."""
        self.now: list[tuple | None] = [None] * 4  # (cost, rank, tail, put away)
        self.now[START if start is None else start] = (0, 0, "", None)
        self.rows = 0
        if start is None:
            self.close()

    def close(self) -> None:
        """Inserts behind the last row: at most three, as there are four states."""
        now = self.now
        for _ in range(3):
            for q in range(4):
                if now[q] is not None:
                    self._offer(now, USER if q != USER else ASSISTANT, now[q], INSERT, "I" if q != USER else "J")

    @staticmethod
    def _offer(to: list, q: int, path: tuple, cost: int, edits: str) -> None:
        new = (path[0] + cost, path[1], path[2] + edits)
        if to[q] is None or new < to[q][:3]:
            to[q] = (*new, path[3])

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        new: list[tuple | None] = [None] * 4
        more = TRUNCATED if truncated else 0
        for q, path in enumerate(self.now):
            if path is None:
                continue
            self._offer(new, q, path, DELETE, "D")
            if not must_go:
                to = _KEEPS.get((q, initial))
                if to is not None:
                    self._offer(new, to, path, KEEP + more, "K")
                self._offer(new, ASSISTANT if q == USER else USER, path, ROLE + more, "R" if q == USER else "S")
        self.now = new
        self.close()
        self.rows += 1
        if self.rows % FREEZE == 0:
            self.freeze()

    def part(self, steps: list[tuple[int, int, int, str]]) -> None:
        """The edits of a part: (from, to, cost, edits)."""
        new: list[tuple | None] = [None] * 4
        for a, b, cost, edits in steps:
            if self.now[a] is not None:
                self._offer(new, b, self.now[a], cost, edits)
        self.now = new
        self.freeze()

    def freeze(self) -> None:
        """Put the strings away but for the inserts at their ends; without these none is a prefix of another, so a rank stands for each."""
        cores = [p and (p[1], p[2].rstrip("IJ")) for p in self.now]
        rank = {c: k for k, c in enumerate(sorted({c for c in cores if c}))}
        self.now = [p and (p[0], rank[c], p[2][len(c[1]):], (p[3], c[1])) for p, c in zip(self.now, cores, strict=True)]

    def edits(self, q: int) -> str:
        _, _, tail, away = self.now[q]
        parts = [tail]
        while away is not None:
            away, text = away
            parts.append(text)
        return "".join(reversed(parts))

    def best(self) -> tuple[int, str]:
        q = min((START, ASSISTANT), key=lambda q: self.now[q][:3] if self.now[q] else (float("inf"), 0, ""))
        return self.now[q][0], self.edits(q)


def audit(edits: str) -> str:
    return edits.replace("J", "I").replace("S", "R")


def split_rows(edits: str) -> list[str]:
    """The letters of each row, the inserts behind it with it; those before the first row with the first."""
    return re.findall(r"(?:^[IJ]+)?[DKRS][IJ]*", edits)


# ---------------------------------------------------------------- rows and their faults

def sorted_rows(tmp: Scratch, turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and g, the row's number in the order of (conv_id, turn, role, text), nulls first."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return numbered(tmp, turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one_space("role"), one_space("text")), ["conv_id", "turn", "role", "text"], "g")


def faults(tmp: Scratch, rows: DataFrame) -> DataFrame:
    """g, conv_id, turn, initial, fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    ends = F.rtrim(F.col("text"), F.lit(BLANK))
    marked = rows.select("g", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), (ends == "").alias("blank"), F.right(ends, F.lit(1)).isin(".", "!", "?").alias("ended"))
    key = F.sha2(F.concat_ws("\0", F.length("role").cast("string"), "role", "text"), 256)
    firsts = rows.select("conv_id", key.alias("key"), "g").groupBy("conv_id", "key").agg(F.min("g").alias("g")).select("g", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(~F.col("ended"), 3).otherwise(0)
    return tmp.write(marked.join(firsts, "g", "left").select("g", "conv_id", "turn", F.when(F.col("initial").isin(*_INITIALS), F.col("initial")).otherwise("").alias("initial"), fault.alias("fault")))


# ---------------------------------------------------------------- the DP

_PARTS = "conv_id long, first long, rows long, illegal long, head string, tail string, steps array<struct<a:int,b:int,cost:long,edits:string>>"
_STEP = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
_PART = pa.schema([("conv_id", pa.int64()), ("first", pa.int64()), ("rows", pa.int64()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("steps", pa.list_(_STEP))])


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def parts(batches):
    """Rows sorted by g (g, conv_id, initial, fault) to one row for each unbroken run of a conversation."""
    done: list[tuple] = []
    now = None  # [conv_id, first, rows, illegal, head, tail, paths by start]

    def close():
        steps = [{"a": s, "b": q, "cost": p.now[q][0], "edits": p.edits(q)} for s, p in now[6].items() for q in range(4) if p.now[q]]
        done.append((*now[:6], steps))

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], f.type) for k, f in enumerate(_PART)], schema=_PART)
        done.clear()
        return out

    for batch in sliced(batches):
        for g, conv, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now[0] != conv or now[1] + now[2] != g:
                if now is not None:
                    close()
                if len(done) >= 1000:
                    yield flush()
                whole = now is not None and now[0] != conv and now[1] + now[2] == g
                # the first run of a task may go on from another task: it is run from each state
                now = [conv, g, 0, 0, initial, initial, {-1: Paths()} | ({} if whole else {s: Paths(s) for s in range(4)})]
            else:
                now[3] += _illegal(now[5], initial)
            for p in now[6].values():
                p.row(initial, fault in (1, 2), fault == 3)
            now[2] += 1
            now[5] = initial
    if now is not None:
        close()
    if done:
        yield flush()


_CHAINED = "conv_id long, cost long, audit string, illegal long, first long, edits array<string>"
_CHAIN = pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()), ("first", pa.int64()), ("edits", pa.list_(pa.string()))])


def chained(batches):
    """Parts sorted by (conv_id, first) to one row for each conversation (cost, audit, illegal) and rows of the edits (first, edits)."""
    out: list[tuple] = []
    now = None  # [conv_id, paths, runs, illegal, tail]

    def close():
        cost, edits = now[1].best()
        out.append((now[0], cost, audit(edits), now[3], None, None))
        rows, at = split_rows(edits), 0
        for first, n in now[2]:
            for i in range(0, n, PIECES):
                out.append((now[0], None, None, None, first + i, rows[at + i:at + min(i + PIECES, n)]))
            at += n

    def flush():
        got = pa.RecordBatch.from_arrays([pa.array([d[k] for d in out], f.type) for k, f in enumerate(_CHAIN)], schema=_CHAIN)
        out.clear()
        return got

    for batch in sliced(batches):
        for conv, first, n, illegal, head, tail, steps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    close()
                if len(out) >= 1000:
                    yield flush()
                now = [conv, Paths(START), [], 0, None]
                own = [(START, s["b"], s["cost"], s["edits"]) for s in steps if s["a"] == -1]
            else:
                now[3] += _illegal(now[4], head)
                own = [(s["a"], s["b"], s["cost"], s["edits"]) for s in steps if s["a"] >= 0]
            now[1].part(own)
            now[2].append((first, n))
            now[3] += illegal
            now[4] = tail
    if now is not None:
        close()
    if out:
        yield flush()


def digests(batches):
    """Rows (conv_id, role, text) sorted by conversation and place to conv_id, sha256 of `role:text` in lines."""
    ids, sums = [], []
    now, h = None, None
    for batch in sliced(batches):
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if h is not None and conv == now:
                h.update(b"\n")
            else:
                if h is not None:
                    ids.append(now), sums.append(h.hexdigest())
                now, h = conv, hashlib.sha256()
            h.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if len(ids) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.string())], names=["conv_id", "sha256"])
            ids, sums = [], []
    if h is not None:
        ids.append(now), sums.append(h.hexdigest())
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.string())], names=["conv_id", "sha256"])


def repair(spark: SparkSession, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired turns (conv_id, g, k, edit, role, text; in the order of g and k) and, for each conversation that has rows, conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit."""
    tmp = Scratch(spark)
    rows = sorted_rows(tmp, turns)
    marked = faults(tmp, rows)
    runs = marked.select("g", "conv_id", "initial", "fault").repartitionByRange("g").sortWithinPartitions("g").mapInArrow(parts, _PARTS)
    chain = tmp.write(tmp.write(runs).repartition("conv_id").sortWithinPartitions("conv_id", "first").mapInArrow(chained, _CHAINED))

    count = lambda k: F.sum((F.col("fault") == k).cast("long"))
    counts = marked.groupBy("conv_id", "turn").agg(count(1).alias("b"), count(2).alias("d"), count(3).alias("t"))  # one row a turn, then sums
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counts = counts.groupBy(F.col("conv_id").alias("c")).agg(gaps.alias("gaps"), *(F.sum(x).alias(n) for x, n in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))))
    found = chain.where("edits is null").select("conv_id", "cost", "audit", "illegal")
    summary = found.join(counts, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    edits = chain.where("edits is not null").select("first", F.posexplode("edits").alias("i", "edits")).select((F.col("first") + F.col("i")).alias("g"), "edits")
    letter = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    made = lambda x: F.when(x.isin("I", "S"), F.lit("user")).when(x.isin("J", "R"), F.lit("assistant")).otherwise(F.col("role"))
    each = F.transform(F.split("edits", ""), lambda x: F.struct(x.alias("edit"), letter(made(x), F.when(x.isin("I", "J"), F.lit("")).otherwise(F.col("text"))).alias("row")))
    out = rows.join(edits, "g").select("conv_id", "g", F.posexplode(F.filter(each, lambda e: e["edit"].isin(*"IJKRS"))).alias("k", "e"))
    return out.select("conv_id", "g", "k", F.translate("e.edit", "JS", "IR").alias("edit"), "e.row.role", "e.row.text"), summary


def digest(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of the repaired turns."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "g", "k").select("conv_id", "role", "text").mapInArrow(digests, "conv_id long, sha256 string")


def damage(turns: DataFrame) -> DataFrame:
    """Damage by crc32(`conv_id:turn`) % 20: 0 drops the row, 1 empties its text, 2 takes out `[.!?]`, 3 repeats it, 4 makes its role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


def damaged_and_repaired(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """One row for every conv_id of turns: the faults after the damage, and the repair."""
    out, summary = repair(spark, damage(turns))
    ids = turns.select(F.col("conv_id").cast("long").alias("id")).distinct()
    sums = digest(out).select(F.col("conv_id").alias("s"), "sha256")
    got = ids.join(summary, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(sums, F.col("id").eqNullSafe(F.col("s")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return got.select(F.col("id").alias("conv_id"), *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
