"""Exact top-k search by inner product: the three-phase uniform threshold (Cao and Wang 2004), in blocks.

Vectors are turned into integers, floor(scale * x), and held in blocks of bounded bytes, long vectors first. The coordinates are cut into SLICES,
those with most energy first; a slice's partial products with a query are one of its score lists. Cells of some query blocks and some
candidate blocks are tasks; the few queries travel to the candidates.

1. Local score lists: every slice of every block gives its k best entries for each query, with the sums of their partial products. The k-th best
   distinct candidate of all these gives a cutoff that the k-th best of all candidates can only exceed.
2. The cutoff goes back with the queries. A score of cutoff or more needs a slice of cutoff / SLICES or more: each slice collects its entries of that
   uniform threshold, the sufficient entries. Where norms leave no room for it, a slice is not multiplied, and a block that is too short for
   every query of a lot is not shipped to it. After each slice, entries, candidates and queries that cannot reach the cutoff with all that is missing
   go (Cauchy-Schwarz).
3. What slices that were not multiplied add to the collected entries is resolved exactly, and the k best of each cell are ranked.

Every row takes part and nothing approximate is kept: bounds are rounded outwards. The queries are a set stated by the caller (rows by id), met
with all rows in blocks; what goes from a cell to the next step is k rows a query.

Defined results: vectors that are null, empty or hold null or non-finite components (before or after scaling), and null ids, take no part. Vectors
of another length than the query's do not meet it. Rows that repeat an id are one candidate with the best of their scores, and one query.
A query never meets rows of its own id. Ties go to the smaller id. Fewer than k candidates: all of them. Scores beyond 64 bits are held at the
bound and rank as equal there. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, sliced
from .vector_dedup import usable

BLOCK, BLOCK_BYTES, GROUP, LOT, SLICES, ROWS = 4096, 2 << 20, 4, 8, 4, 256
TOP = 1 << 62
_BLOCKS = "block long, dim int, n int, ids binary, data binary, energy array<double>, norms array<double>"


def edges(dim: int) -> list[int]:
    """Where the slices begin and end."""
    return np.linspace(0, dim, min(SLICES, max(1, dim)) + 1).astype(int).tolist()


def integer_blocks(rows: DataFrame, scale: float) -> DataFrame:
    """rows (id, vec) as blocks of ids and floor(scale * vec), whole numbers held as doubles, of one length."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        kept: dict[int, list] = {}

        def flush(d: int, most: int):
            nonlocal number
            ids, data = np.concatenate([x[0] for x in kept[d]]), np.concatenate([x[1] for x in kept[d]])
            del kept[d]
            for i in range(0, len(ids), most):
                a, b = ids[i:i + most], data[i:i + most]
                # outward, so that bounds hold; sums of squares may leave the range of doubles: then nothing is bounded
                with np.errstate(over="ignore"):
                    energy = (b * b).sum(0)
                    norm = float(np.sqrt((b * b).sum(1).max(initial=0.0)))
                yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "dim": pa.array([d], pa.int32()), "n": pa.array([len(a)], pa.int32()), "ids": pa.array([a.tobytes()], pa.binary()), "data": pa.array([b.tobytes()], pa.binary()), "energy": pa.array([energy.tolist()], pa.list_(pa.float64())), "norms": pa.array([[norm]], pa.list_(pa.float64()))})
                number += 1

        for batch in sliced(batches):
            ids, vec = np.asarray(batch.column(0)), batch.column(1)
            values = np.asarray(vec.flatten())
            length = np.asarray(vec.value_lengths(), np.int64)
            offsets = np.cumsum(length) - length
            for d in np.unique(length).tolist():
                own = np.flatnonzero(length == d)
                x = values[offsets[own][:, None] + np.arange(d)]
                kept.setdefault(d, []).append((ids[own].astype(np.int64), np.floor(scale * x)))
                most = max(16, min(BLOCK, BLOCK_BYTES // (8 * d)))
                if sum(len(k[0]) for k in kept[d]) >= most:
                    yield from flush(d, most)
        for d in list(kept):
            yield from flush(d, max(16, min(BLOCK, BLOCK_BYTES // (8 * d))))

    return rows.mapInArrow(run, _BLOCKS)


def _open(row: dict, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["data"], np.float64).reshape(len(ids), row["dim"])[:, order]


def _kind(q: np.ndarray, c: np.ndarray):
    """Floats in which all sums of products are exact; None if there are none."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else None


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All scores by Python's integers, held in 64 bits."""
    a, b = (np.array([[int(v) for v in r] for r in x.tolist()], object).reshape(x.shape) for x in (q, c))
    total = a @ b.T if q.shape[1] else np.zeros((len(q), len(c)), object)
    return np.array([[max(-(1 << 63), min((1 << 63) - 1, v)) for v in r] for r in total.tolist()], np.int64).reshape(len(q), len(c))


def best(of: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the entries that are among the k best distinct ids of their query, by query and rank."""
    order = np.lexsort((~scores, ids, of))  # ~x: in falling order, also of the least number
    o, x = of[order], ids[order]
    order = order[np.concatenate([[True], (o[1:] != o[:-1]) | (x[1:] != x[:-1])])] if len(order) else order
    order = order[np.lexsort((ids[order], ~scores[order], of[order]))]
    o = of[order]
    first = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.zeros(0, np.int64)
    rank = np.arange(len(o)) - np.repeat(first, np.diff(np.append(first, len(o))))
    return order[rank < k]


def local_lists(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int):
    """The score lists of a block: for each slice the k entries of the highest partial products with each query, and the sums of their partial products
    over all slices: (query's number, candidate's number, score), each entry once."""
    kind = _kind(q, c)
    if kind is None:
        s = exact_scores(q, c)
        i, j = np.nonzero(cid[None, :] != qid[:, None])
        return i, j, s[i, j]
    cuts = edges(q.shape[1])
    some = min(k, len(c))
    listed = np.zeros((len(q), len(c)), bool)
    total = np.zeros((len(q), len(c)), kind)
    same = cid[None, :] == qid[:, None]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        p = q[:, i:j].astype(kind) @ c[:, i:j].astype(kind).T
        total += p
        p[same] = -np.inf
        np.put_along_axis(listed, np.argpartition(p, len(c) - some, axis=1)[:, len(c) - some:], True, axis=1)
    listed &= ~same
    i, j = np.nonzero(listed)
    return i, j, total[i, j].astype(np.int64)


def sufficient(qid: np.ndarray, q: np.ndarray, cut: np.ndarray, cid: np.ndarray, c: np.ndarray, work: list[int] | None = None):
    """All entries (query's number, candidate's number, score) that reach the query's cutoff. work[0] counts multiplications.

    Each slice collects its entries of cutoff / SLICES or more; a score of the cutoff has one such part at least. Slices in which the norms of queries
    and candidates leave no room for that are not multiplied as a whole, and what they add is resolved for the collected entries alone.
    """
    none = np.zeros(0, np.int64)
    kind = _kind(q, c)
    if kind is None:
        s = exact_scores(q, c)
        if work is not None:
            work[0] += q.size * len(c)
        i, j = np.nonzero((cid[None, :] != qid[:, None]) & (s >= cut[:, None]))
        return i, j, s[i, j]
    cuts = edges(q.shape[1])
    slices = list(zip(cuts[:-1], cuts[1:], strict=True))
    part = lambda x, i, j: np.sqrt((x[:, i:j] * x[:, i:j]).sum(1)) * (1 + 1e-6)
    qn, cn = ([part(x, i, j) for i, j in slices] for x in (q, c))
    room = sum(a * b.max(initial=0.0) for a, b in zip(qn, cn, strict=True))
    rows = np.flatnonzero(room >= cut - 1e-3)  # no candidate is long enough for the others
    if not len(rows) or not len(c):
        return none, none, none
    cols = np.arange(len(c))
    least = cut[rows] / len(slices) - np.abs(cut[rows] * 1e-6) - 1e-3  # the uniform threshold, rounded down
    seen = np.zeros((len(rows), len(cols)), bool)
    total = np.zeros((len(rows), len(cols)), kind)
    later = []
    for s, (i, j) in enumerate(slices):
        able = qn[s][rows] * cn[s][cols].max(initial=0.0) >= least
        if not able.any():
            later.append((i, j))
            continue
        p = q[rows, i:j].astype(kind) @ c[cols, i:j].astype(kind).T
        if work is not None:
            work[0] += len(rows) * len(cols) * (j - i)
        total += p
        seen |= p >= least[:, None].astype(kind)
        # rows and columns of which no entry can reach the cutoff with all that is still to come go
        rest = [t for t in range(s + 1, len(slices))] + [slices.index(x) for x in later]
        if rest:
            qt, ct = (np.sqrt(sum(n[t][keep] ** 2 for t in rest)) for n, keep in ((qn, rows), (cn, cols)))
            alive = total + np.outer(qt, ct).astype(kind) * kind(1 + 1e-5) >= (cut[rows][:, None] - 1e-3).astype(kind) - np.abs(cut[rows][:, None] * 1e-6).astype(kind)
            r, k = alive.any(1), alive.any(0)
            if not r.all() or not k.all():
                rows, cols, least, total, seen = rows[r], cols[k], least[r], total[np.ix_(r, k)], seen[np.ix_(r, k)]
                alive = alive[np.ix_(r, k)]
            if not len(rows) or not len(cols):
                return none, none, none
            if alive.mean() < 0.02:  # few are left: whatever slice would collect them, the rest of each by itself
                seen = alive
                later += [x for x in slices[s + 1:]]
                break
    x, y = np.nonzero(seen)
    out: tuple[list, ...] = ([], [], [])
    for at in range(0, len(x), 1 << 15):
        u, v = x[at:at + (1 << 15)], y[at:at + (1 << 15)]
        score = total[u, v].astype(np.int64)
        for i, j in later:
            score += np.einsum("nd,nd->n", q[rows[u], i:j], c[cols[v], i:j]).astype(np.int64)
            if work is not None:
                work[0] += len(u) * (j - i)
        keep = (score >= cut[rows[u]]) & (cid[cols[v]] != qid[rows[u]])
        out[0].append(rows[u][keep]), out[1].append(cols[v][keep]), out[2].append(score[keep])
    return tuple(np.concatenate([none, *o]) for o in out)


def top_k(spark: SparkSession, rows: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest scores, ties to the smaller id."""
    tmp = Scratch(spark)
    ids = rows.where(F.col(id_col).isNotNull())
    finite = F.forall("vec", lambda x: F.abs(x * F.lit(float(scale))) < F.lit(float("inf")))
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(usable("vec") & finite)
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    cands = tmp.write(integer_blocks(pick(ids).repartitionByRange(norm.desc()).sortWithinPartitions(norm.desc()), scale))
    asks = tmp.write(integer_blocks(pick(ids.where(is_query)), scale).withColumnRenamed("block", "ask").drop("energy", "norms"))
    lots = asks.select("ask", "dim", "ids", "data", F.pmod(F.xxhash64("ask"), F.lit(max(1, -(-asks.count() // LOT))).cast("long")).alias("lot"))
    groups = max(1, -(-cands.count() // GROUP))
    blocks = cands.select("block", "dim", "ids", "data", F.element_at("norms", 1).alias("norm"), F.pmod(F.xxhash64("block"), F.lit(groups).cast("long")).alias("slot"))

    # coordinates by energy: one row for each coordinate of each length comes to the driver
    by_energy: dict[int, list] = {}
    energies = cands.select("dim", F.posexplode("energy").alias("d", "e")).groupBy("dim", "d").agg(F.sum("e").alias("e"))
    for r in energies.orderBy(F.desc("e"), "d").collect():
        by_energy.setdefault(r["dim"], []).append(r["d"])
    orders = {d: np.array(v, np.int64) for d, v in by_energy.items()}

    met = lots.select("lot", "dim").distinct()

    def cells(asked: DataFrame, needed: DataFrame) -> DataFrame:
        """asked (ask, lot, dim, ids, data, cut) and the candidate blocks, for each needed (slot, lot, block)."""
        c = blocks.drop("slot").join(needed, "block").select(F.lit(0).alias("side"), "slot", "lot", "block", "dim", "ids", "data", F.lit(None).cast("binary").alias("cut"))
        a = asked.join(needed.select("slot", "lot").distinct(), "lot").select(F.lit(1).alias("side"), "slot", "lot", F.col("ask").alias("block"), "dim", "ids", "data", "cut")
        return c.unionByName(a).groupBy("slot", "lot")

    def cell(phase: int):
        def run(table: pa.Table) -> pa.Table:
            sides = table.column("side").to_pylist()
            mine, theirs = ([r for r in range(len(sides)) if sides[r] == s] for s in (1, 0))
            row = lambda r: {n: table.column(n)[r].as_py() for n in ("block", "dim", "ids", "data", "cut")}
            out: tuple[list, ...] = ([], [], [], [])
            for m in mine:
                ask = row(m)
                qid, q = _open(ask, orders[ask["dim"]])
                cut = np.frombuffer(ask["cut"], np.int64) if phase == 2 else None
                found: tuple[list, ...] = ([], [], [])
                for t in theirs:
                    if table.column("dim")[t].as_py() != ask["dim"]:
                        continue
                    block = row(t)
                    cid, c = _open(block, orders[ask["dim"]])
                    for at in range(0, len(qid), ROWS):
                        to = slice(at, at + ROWS)
                        i, j, s = local_lists(qid[to], q[to], cid, c, k) if phase == 1 else sufficient(qid[to], q[to], cut[to], cid, c)
                        keep = best(i, cid[j], s, k)
                        for o, v in zip(found, (at + i[keep], cid[j[keep]], s[keep]), strict=True):
                            o.append(v)
                if not found[0]:
                    continue
                i, x, s = map(np.concatenate, found)
                keep = best(qid[i], x, s, k)
                for o, v in zip(out, (np.full(len(keep), ask["block"]), qid[i[keep]], x[keep], s[keep]), strict=True):
                    o.append(v)
            cols = [np.concatenate([np.zeros(0, np.int64), *o]).astype(np.int64) for o in out]
            return pa.table([pa.array(c) for c in cols], names=["ask", "query_id", "vec_id", "score"])

        return run

    every = blocks.select("slot", "block", "dim").join(met, "dim").select("slot", "block", "lot")
    no_cut = lots.withColumn("cut", F.lit(None).cast("binary"))
    lists = cells(no_cut, every).applyInArrow(cell(1), "ask long, query_id long, vec_id long, score long")
    lists = lists.groupBy("ask", "query_id", "vec_id").agg(F.max("score").alias("score"))  # repeated rows are one query, one candidate
    order = Window.partitionBy("ask", "query_id").orderBy(F.desc("score"), "vec_id")
    cutoffs = tmp.write(lists.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("ask", "query_id", F.col("score").alias("cutoff")))

    def with_cut(left: pa.Table, right: pa.Table) -> pa.Table:
        known = dict(zip(right.column("query_id").to_pylist(), right.column("cutoff").to_pylist(), strict=True))
        cut = [np.array([min(TOP, known.get(i, -(1 << 63))) for i in np.frombuffer(b, np.int64).tolist()], np.int64) for b in left.column("ids").to_pylist()]
        # how long a candidate must be at least for any query of the block
        need = []
        for r, limit in enumerate(cut):
            q = np.frombuffer(left.column("data")[r].as_py(), np.float64).reshape(len(limit), -1)
            with np.errstate(over="ignore"):
                size = np.maximum(np.sqrt((q * q).sum(1)), 1e-300)
                need.append(float(np.min(np.where(limit > 0, limit / size, 0.0))) * (1 - 1e-6))
        return left.select(["ask", "lot", "dim", "ids", "data"]).append_column("cut", pa.array([c.tobytes() for c in cut], pa.binary())).append_column("need", pa.array(need, pa.float64()))

    asked = lots.groupBy("ask").cogroup(cutoffs.groupBy("ask")).applyInArrow(with_cut, "ask long, lot long, dim int, ids binary, data binary, cut binary, need double")
    asked = tmp.write(asked)
    # blocks too short for every query of a lot are not shipped to it
    least = asked.groupBy("lot", "dim").agg(F.min("need").alias("need"))
    needed = blocks.select("slot", "block", "dim", "norm").join(least, "dim").where(F.col("norm") * (1 + 1e-6) >= F.col("need")).select("slot", "block", "lot")
    got = cells(asked.drop("need"), needed).applyInArrow(cell(2), "ask long, query_id long, vec_id long, score long")
    got = got.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
