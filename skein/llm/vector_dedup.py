"""Near-duplicate vectors within a label: PCA-ordered tiled comparison with suffix-norm bounds.

1. Equal vectors of a label are one class first, so copies are never compared with each other.
2. Unit vectors are rotated to principal axes. Two of them at the threshold t or above lie within w = sqrt(2 - 2t) of each other, so on every axis
   too: the leading GRID axes are cut into cells w wide, and only neighbouring cells can hold links. Labels of up to FEW tiles are one cell, as
   many small tiles would ship more rows. Within a cell vectors are ranked along the axes and dealt to tiles of about TILE; a hot label,
   or a hot cell, is many tiles.
3. Tiles of neighbouring cells are paired unless their boxes on the LEAD leading axes, with the largest norms of the rest, show that no cosine
   between them reaches the threshold. This is settled on one row for each tile, before any vector is shipped.
4. In a pair of tiles, products are summed a slice of dimensions at a time, leading ones first. After each slice, what is missing is at most the
   product of the norms of the remaining coordinates (Cauchy-Schwarz); a pair of tiles stops when no pair can reach the threshold, and
   pairs that can are decided by the cosine of the unrotated vectors in double precision. It returns sums of links and a spanning forest
   of its links, never the links themselves; components follow by star contraction.

The axes only order the work: they come from about SAMPLE vectors at most (chosen by a hash) of the most frequent lengths and do not change
results. Vectors of other lengths are compared as they are. Classes are told apart by 128 bits of hash, so that vectors themselves are
shuffled to find equal ones, to be dealt to tiles and to be compared, and never to be joined back.

Defined results: null labels, null, zero or empty vectors, and those with null or non-finite components link with nothing. Vectors of other
lengths never link. Repeated rows are vectors of their own. A row that repeats an id shares its component. Null ids link with nothing.
Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, Scratch, components, ranked, sliced, small_rows

TILE, SLICE, SAMPLE, GRID, LEAD, FEW = 1024, 16, 20_000, 3, 8, 16
#: Axes are found for so many lengths, of so many components at most, by so many tasks.
LENGTHS, LONGEST, PARTS = 4, 1024, 4


def usable(vec: str):
    """Not null, not empty, all components there and finite."""
    big = F.lit(float("inf"))
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Principal axes of unit vectors, leading ones first, for the LENGTHS most frequent lengths of up to LONGEST; from a bounded sample.

    Workers add up the products of coordinates; LENGTHS x PARTS squares of a length come to the driver, no vectors.
    """
    sizes = vectors.where(F.size("vec") <= LONGEST).groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect()
    if not sizes:
        return {}
    n = sum(r["count"] for r in sizes)
    some = vectors.where(F.size("vec").isin([r["d"] for r in sizes]))
    if n > sample:
        some = some.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int((1 << 30) * sample / n))

    def products(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in sliced(batches):
            vec = batch.column(0)
            values, length = np.asarray(vec.flatten(), np.float64), np.asarray(vec.value_lengths(), np.int64)
            start = np.cumsum(length) - length
            for d in np.unique(length).tolist():
                u = unit(values[start[length == d][:, None] + np.arange(d)])
                sums[d] = sums.get(d, 0) + u.T @ u
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([s.tobytes()], pa.binary())], names=["d", "s"])

    total: dict[int, np.ndarray] = {}
    for r in some.select("vec").repartition(PARTS).mapInArrow(products, "d int, s binary").toLocalIterator():  # a square at a time
        total[r["d"]] = total.get(r["d"], 0) + np.frombuffer(r["s"]).reshape(r["d"], r["d"])
    return {d: np.linalg.eigh(s)[1][:, ::-1] for d, s in total.items()}


def linked_pairs(a: np.ndarray, b: np.ndarray, rotation: np.ndarray | None, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b whose cosine reaches the threshold; same: each pair of a = b once."""
    ua, ub = unit(a), unit(b)
    ra, rb = (ua, ub) if rotation is None else (ua @ rotation, ub @ rotation)
    d = ra.shape[1]
    tail = lambda r: np.sqrt(np.maximum(0, np.cumsum((r * r)[:, ::-1], 1)[:, ::-1]))
    ta, tb = tail(ra), tail(rb)
    total = np.zeros((len(a), len(b)))
    i = j = np.zeros(0, np.int64)
    for at in range(0, d, SLICE):
        end = min(d, at + SLICE)
        total += ra[:, at:end] @ rb[:, at:end].T
        bound = total + np.outer(ta[:, end], tb[:, end]) if end < d else total
        alive = bound >= threshold - 1e-9
        if same:
            alive = np.triu(alive, 1)
        i, j = np.nonzero(alive)
        if len(i) <= 4 * (len(a) + len(b)):  # few are left: decide them below
            break
    keep = []
    for k in range(0, len(i), 1 << 16):
        x, y = a[i[k:k + (1 << 16)]], b[j[k:k + (1 << 16)]]
        x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
        keep.append((x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))) >= threshold)
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[keep], j[keep]


def in_cells(classes: DataFrame, large: DataFrame, rotation, threshold: float) -> DataFrame:
    """classes with dim, cell, its coordinates g0.. (0 for labels that are not large), the leading coordinates l0.., the norm of the rest, and a
    key of (label, dim, cell). large: label, large."""
    width = max(1e-3, np.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9) + 1e-12)

    def run(batches):
        for batch in sliced(batches):
            vec = batch.column("vec")
            values, length = np.asarray(vec.flatten(), np.float64), np.asarray(vec.value_lengths(), np.int64)
            start = np.cumsum(length) - length
            lead = np.zeros((batch.num_rows, LEAD))
            rest = np.zeros(batch.num_rows)
            for d in np.unique(length).tolist():
                own = np.flatnonzero(length == d)
                u = unit(values[start[own][:, None] + np.arange(d)])
                u = u @ rotation.value[d] if d in rotation.value else u
                lead[own, :min(d, LEAD)] = u[:, :LEAD]
                rest[own] = np.sqrt((u[:, LEAD:] * u[:, LEAD:]).sum(1)) + 1e-9
            g = np.floor(lead[:, :GRID] / width).astype(np.int32)
            cols = [*batch.columns, pa.array(length.astype(np.int32)), *(pa.array(g[:, k]) for k in range(GRID)), *(pa.array(lead[:, k]) for k in range(LEAD)), pa.array(rest)]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, "dim", *(f"g{k}" for k in range(GRID)), *(f"l{k}" for k in range(LEAD)), "rest"])

    schema = ", ".join(f"{n} {t}" for n, t in classes.dtypes)
    out = classes.mapInArrow(run, f"{schema}, dim int, {', '.join(f'g{k} int' for k in range(GRID))}, {', '.join(f'l{k} double' for k in range(LEAD))}, rest double")
    out = out.join(F.broadcast(large) if small_rows(large) else large, "label")
    out = out.withColumns({f"g{k}": F.when(F.col("large"), F.col(f"g{k}")).otherwise(0) for k in range(GRID)})
    out = out.withColumn("cell", F.concat_ws(",", *(f"g{k}" for k in range(GRID))))
    return out.withColumn("group", F.xxhash64("label", "dim", "cell"))


def tile_pairs(placed: DataFrame, threshold: float) -> DataFrame:
    """label, dim, t1, t2 (t1 <= t2): the pairs of tiles that may hold a link."""
    lead = [f"l{k}" for k in range(LEAD)]
    box = [f(c).alias(f"{c}_{n}") for c in lead for f, n in ((F.min, "low"), (F.max, "high"))]
    cells = [f"g{k}" for k in range(GRID)]
    tiles = placed.groupBy("label", "dim", "tile", *cells).agg(*box, F.max("rest").alias("rest"))
    near = tiles
    for c in cells:
        near = near.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
    a, b = near.alias("a"), tiles.alias("b")
    both = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("label", "dim", *cells)]).where("a.tile <= b.tile")
    ends = lambda c: [F.col(f"a.{c}_{x}") * F.col(f"b.{c}_{y}") for x in ("low", "high") for y in ("low", "high")]
    bound = sum((F.greatest(*ends(c)) for c in lead), F.col("a.rest") * F.col("b.rest"))
    return both.where(bound >= threshold - 1e-7).select("a.label", "a.dim", F.col("a.tile").alias("t1"), F.col("b.tile").alias("t2"))


def near_vectors(spark: SparkSession, rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """One row per row: id_col, n_links, component_id, kept."""
    tmp = Scratch(spark)
    held = "array<float>" if dict(rows.dtypes)[vec_col] == "array<float>" else "array<double>"  # half the bytes to shuffle; computed in doubles
    all_rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast(held).alias("vec"))
    is_good = F.col("id").isNotNull() & F.col("label").isNotNull() & usable("vec") & F.exists("vec", lambda x: x != 0)
    good = all_rows.where(is_good)
    hashes = [F.xxhash64("label", "vec").alias("uid"), F.xxhash64(F.lit(1), "vec", "label").alias("uid2")]
    good = good.select("*", *hashes)
    classes = tmp.write(good.groupBy("uid", "uid2").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("id").alias("rep"), F.count("*").alias("copies")))
    rotation = spark.sparkContext.broadcast(axes(classes))  # a square of the vectors' length

    large = classes.groupBy("label").agg((F.count("*") > FEW * TILE).alias("large"))
    placed = in_cells(classes.drop("uid2"), large, rotation, threshold)
    placed = ranked(tmp, placed, "group", [F.when(F.col("large"), F.col("l3")).otherwise(F.col("l0")), "l1", "uid"])
    placed = tmp.write(placed.withColumn("tile", F.concat_ws(":", "cell", F.floor((F.col("rank") - 1) / TILE))).drop("rank", "group"))
    pairs = tmp.write(tile_pairs(placed, threshold))
    to = pairs.select("label", "dim", "t1", "t2", F.explode(F.array_distinct(F.array("t1", "t2"))).alias("tile"))
    spread = placed.select("label", "dim", "tile", "vec", "rep", "copies", "uid").join(F.broadcast(to) if small_rows(to, 100_000) else to, ["label", "dim", "tile"])

    def compare(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        tile, rep, uid, copies = (np.asarray(t.column(c)) for c in ("tile", "rep", "uid", "copies"))
        low = t.column("t1")[0].as_py()
        vec = t.column("vec").chunk(0) if isinstance(t.column("vec"), pa.ChunkedArray) else t.column("vec")
        length = np.diff(np.asarray(vec.offsets))
        out: tuple[list, ...] = ([], [], [], [], [])
        for d in np.unique(length):
            own = np.flatnonzero(length == d)
            x = np.stack([vec[int(k)].values.to_numpy(zero_copy_only=False) for k in own]).astype(np.float64)
            one = tile[own] == low
            same = t.column("t2")[0].as_py() == low
            a, b = own[one], own[one] if same else own[~one]
            if not len(a) or not len(b):
                continue
            i, j = linked_pairs(x[one], x[one] if same else x[~one], rotation.value.get(int(d)), threshold, same)
            links = np.zeros(len(tile), np.int64)
            np.add.at(links, a[i], copies[b[j]])
            np.add.at(links, b[j], copies[a[i]])
            hit = np.flatnonzero(links)
            forest = Forest(len(tile))
            tree = [k for k, (p, q) in enumerate(zip(a[i].tolist(), b[j].tolist(), strict=True)) if forest.union(p, q)]
            out[0].extend(uid[hit].tolist()), out[1].extend(rep[hit].tolist()), out[2].extend(links[hit].tolist())
            out[3].extend([None] * len(hit)), out[4].extend([None] * len(hit))
            out[0].extend([None] * len(tree)), out[1].extend([None] * len(tree)), out[2].extend([None] * len(tree))
            out[3].extend(rep[a[i[tree]]].tolist()), out[4].extend(rep[b[j[tree]]].tolist())
        return pa.table([pa.array(o, pa.int64()) for o in out], names=["uid", "rep", "n", "a", "b"])

    found = tmp.write(spread.groupBy("label", "dim", "t1", "t2").applyInArrow(compare, "uid long, rep long, n long, a long, b long"))
    counts = found.where("uid is not null").groupBy("uid", "rep").agg(F.sum("n").alias("n"))
    classes2 = classes.select("uid", "uid2", "rep", "copies").join(counts, ["uid", "rep"], "left").select("uid", "uid2", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    bad = ~F.coalesce(is_good, F.lit(False))
    of = good.select("id", "uid", "uid2").join(classes2, ["uid", "uid2"]).select("id", "rep", "n_links")
    of = tmp.write(of.unionByName(all_rows.where(bad).select("id", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("long").alias("n_links"))))
    member = of.where("rep is not null").groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    same_id = of.join(member.where("low < high"), "id").where("rep > low").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    comp = components(found.where("a is not null").select("a", "b").unionByName(same_id), tmp).withColumnRenamed("id", "low")
    member = member.join(comp, "low", "left").select("id", F.coalesce("component", "low").alias("component_id"))
    out = of.select("id", "n_links").join(member, "id", "left")
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
