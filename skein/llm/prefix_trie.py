"""The trie of conversations' prefixes, from the Cartesian tree over the LCP array of sorted conversations.

1. A conversation is the row of its turns' hashes (128 bits of role and text, so equal turns are equal bytes) and their numbers of words. All
   conversations are sorted by these bytes, then conv_id, in one range-partitioned sort, and numbered. Members of a trie node are neighbours then.
2. L[i] is the number of turns that row i shares with row i - 1 (-1 before the first row and behind the last). A node of depth d is a longest run of
   rows between two places where L is below d. Where L is v inside, the nearest smaller values left and right are its ends (Berkman et al. 1993):
   blocks of rows run in parallel, each with one stack, which gives all nodes that lie within the block and merges places of equal L.
3. What stays open at a block's ends are its staircases of prefix and suffix minima, a few for each depth; everything between two of these is summed
   into the first (`shrink`). These block minima are the array of the next level, FAN blocks to one, until one block is left: five levels for ten
   billion conversations, and no level larger than a small part of the one before.
4. A run of rows with LCP v inside whose ends have at most p < v is a node at each of the depths p + 1 to v; a conversation that shares less than its
   length has such nodes of its own. Counts, leaves and words come from sums over the array: of a run's rows but the first, the turns shared with the row
   before are just what merging saves. Parents are joined by the hash of the prefix, children counted likewise, partial before the shuffle.
5. The conv_ids that end at a node are strung together block by block and hashed as a stream in order; a group of any size is never held.

Defined results: null turns come first, rows of one turn in the order of their hashes; null role or text: empty. Rows with a null conv_id belong to no
conversation and are left out. Repeated rows are turns of their own. conv_id - conv_id % 20 rounds towards 0. Empty table: no rows, not even the root.
Other columns are not read. A conversation's hashes, 16 bytes a turn, are one value of at most 2 GB; its texts are never gathered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, numbered, sliced

#: Rows of a block of the first level; blocks of a level that make one of the next.
BLOCK, FAN = 512, 64
HASH = 16  # bytes of a turn

_ELEMENT = "block long, at long, lcp int, id binary, words array<long>, low long, own long, shared long, leaf long, leaves long"
_NODE = "node struct<first:long,end:long,depth:int,above:int,id:binary,parent:binary,conv_id:long,shared:long,leaves:long,words:array<long>>"
_RUN = "run struct<id:binary,block:long,first:long,depth:int,n:long,ids:string>"
_OUT = f"element struct<{_ELEMENT.replace(' ', ':').replace(',:', ',')}>, {_NODE}, {_RUN}"


def _type(ddl: str) -> pa.DataType:
    plain = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.struct([(n, plain[t]) for n, t in (x.strip().replace(" ", ":").split(":") for x in ddl.split(","))])


_TYPES = {"element": _type(_ELEMENT), "node": _type(_NODE[12:-1]), "run": _type(_RUN[11:-1])}


def _batch(kind: str, rows: list[tuple]) -> pa.RecordBatch:
    t = _TYPES[kind]
    cols = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), t, strict=True)]
    own = pa.StructArray.from_arrays(cols, fields=list(t))
    return pa.RecordBatch.from_arrays([own if k == kind else pa.nulls(len(rows), v) for k, v in _TYPES.items()], names=list(_TYPES))


def prefix_id(key: bytes, depth: int) -> bytes | None:
    """A hash that stands for the first turns of a conversation; none for less than the root."""
    return hashlib.blake2b(key[:HASH * depth], digest_size=16, salt=depth.to_bytes(8, "little")).digest() if depth >= 0 else None


class Element:
    """Rows from `at` up to the next element: LCP and prefix of the first; least conv_id, words shared with the row before and leaves of all
    (own, leaf: those of the first)."""

    __slots__ = ("at", "lcp", "id", "words", "low", "own", "shared", "leaf", "leaves")

    def __init__(self, *values):
        for k, v in zip(self.__slots__, values, strict=True):
            setattr(self, k, v)

    def row(self, block: int) -> tuple:
        return (block, *(getattr(self, k) for k in self.__slots__))


def shrink(elements: list[Element], nodes: list[tuple]) -> list[Element]:
    """Nodes that lie within the elements go to `nodes`; what is left is what they look like from outside.

    Frames of the stack: [lcp, first, last, low since first, low since last], LCPs growing.
    """
    if not elements:
        return []
    shared = np.concatenate([[0], np.cumsum([e.shared for e in elements])]).tolist()
    leaves = np.concatenate([[0], np.cumsum([e.leaves for e in elements])]).tolist()
    stack: list[list] = []
    kept = set()
    for j, e in enumerate(elements):
        while stack and stack[-1][0] > e.lcp:
            lcp, first, _, low, _ = stack.pop()
            if not stack:
                kept.add(first)  # open to the left
                continue
            below = stack[-1]
            below[3], below[4] = min(below[3], low), min(below[4], low)
            left, i = elements[below[2]], below[2]
            parent = left if left.lcp >= e.lcp else e
            nodes.append((left.at, e.at, lcp, parent.lcp, elements[first].id, parent.id, below[4], shared[j] - shared[i] - left.own, leaves[j] - leaves[i] - left.leaf + e.leaf, elements[first].words[max(parent.lcp, 0):]))
        if stack and stack[-1][0] == e.lcp:
            top = stack[-1]
            top[2], top[3], top[4] = j, min(top[3], e.low), e.low
        else:
            stack.append([e.lcp, j, j, e.low, e.low])
    kept.add(stack[0][1])
    kept.update(f[2] for f in stack)
    kept = sorted(kept)
    out = []
    for i, j in zip(kept, [*kept[1:], len(elements)], strict=True):
        e = elements[i]
        out.append(Element(e.at, e.lcp, e.id, e.words, min(x.low for x in elements[i:j]), e.own, shared[j] - shared[i], e.leaf, leaves[j] - leaves[i]))
    return out


# ---------------------------------------------------------------- first level

def _common(a: bytes, b: bytes) -> int:
    """Turns that two keys share at their starts."""
    n = min(len(a), len(b)) // HASH
    x, y = (np.frombuffer(k, np.uint64, 2 * n).reshape(n, 2) for k in (a, b))
    same = (x == y).all(1)
    return n if same.all() else int(same.argmin())


#: A conv_id above all others: of the place behind the last row, which has no row.
_NO_ROW = (1 << 63) - 1


def first_level(total: int, block_rows: int):
    """Rows (block, g, conv_id, key, words: array) sorted by block and g, the last two rows of the block before ahead of each block's own, to
    its elements, nodes and ends."""

    def run(batches):
        block, elements, runs, out = None, [], None, {k: [] for k in _TYPES}
        before: list[tuple] = []  # up to two rows: (g, conv_id, key, LCP with the row before it, sums of words)

        def end_run():
            nonlocal runs
            if runs is not None:
                ident, first, depth, ids = runs
                out["run"].append((ident, block, first, depth, len(ids), ",".join(map(str, ids))))
                runs = None

        def leaf(row, lcp_behind, next_id):
            """The nodes of a conversation's own, if any: row, and the LCP and prefix of the place behind it."""
            g, conv, key, lcp, _, lcp_id = row
            n, above = len(key) // HASH, max(lcp, lcp_behind)
            if n > above:
                sums = np.concatenate([[0], np.cumsum(row[4])]).tolist()
                out["node"].append((g, g + 1, n, above, prefix_id(key, n), lcp_id if lcp >= lcp_behind else next_id, conv, 0, 1, sums[max(above, 0):]))

        def close():
            end_run()
            if elements:
                out["element"] += [e.row(block) for e in shrink(elements, out["node"])]
            elements.clear()

        for batch in sliced(batches):
            for b, g, conv, key, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    close()
                    block, before = b, []
                last = before[-1] if before else None
                if last is not None:
                    lcp = _common(last[2], key)
                else:
                    lcp = -1  # the first row, or one that is only looked back at, where L does not matter
                row = (g, conv, key, lcp, words, prefix_id(key, lcp))
                if g >= b * block_rows:
                    sums = np.concatenate([[0], np.cumsum(words[:max(lcp, 0)])]).astype(np.int64).tolist()
                    ends = int(last is not None and lcp < len(last[2]) // HASH)
                    elements.append(Element(g, lcp, row[5], sums, conv, sums[-1], sums[-1], ends, ends))
                    if last is not None:
                        leaf(last, lcp, row[5])
                    n = len(key) // HASH
                    if runs is None or n != lcp or len(last[2]) // HASH != n:
                        end_run()
                        runs = (prefix_id(key, n), g, n, [])
                    runs[3].append(conv)
                if g == total - 1:
                    leaf(row, -1, None)
                    elements.append(Element(total, -1, None, [0], _NO_ROW, 0, 0, 1, 1))
                before = [*before[-1:], row]
            for k, rows in out.items():
                if len(rows) >= 500:
                    yield _batch(k, rows)
                    rows.clear()
        close()
        for k, rows in out.items():
            if rows:
                yield _batch(k, rows)

    return run


def next_level(batches):
    """Elements sorted by block and place to those of the next level, and nodes."""
    block, elements, out = None, [], {k: [] for k in _TYPES}
    for batch in sliced(batches):
        for b, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != block:
                out["element"] += [e.row(block) for e in shrink(elements, out["node"])]
                block, elements = b, []
            elements.append(Element(*values))
        for k, rows in out.items():
            if len(rows) >= 500:
                yield _batch(k, rows)
                rows.clear()
    out["element"] += [e.row(block) for e in shrink(elements, out["node"])]
    for k, rows in out.items():
        if rows:
            yield _batch(k, rows)


def stream_ends(batches):
    """Strings of conv_ids sorted by node and place to id, n, sha256 of all of them joined by commas."""
    out, now, n, h = [], None, 0, None
    for batch in sliced(batches):
        for ident, count, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if h is not None and ident == now:
                h.update(b",")
            else:
                if h is not None:
                    out.append((now, n, h.hexdigest()))
                now, n, h = ident, 0, hashlib.sha256()
            h.update(ids.encode())
            n += count
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["id", "n", "sha256"])
            out = []
    if h is not None:
        out.append((now, n, h.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["id", "n", "sha256"])


# ---------------------------------------------------------------- conversations and nodes

def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns: array of (hash, words) in order."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat_ws("\0", F.length(text("role")).cast("string"), text("role"), text("text")).cast("binary")))
    own = F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("hash"), F.regexp_count(text("text"), F.lit(WORD)).cast("long").alias("words"))
    rows = turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(own)).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: F.struct(x["hash"].alias("hash"), x["words"].alias("words"))).alias("turns"))


def rebuilt(convs: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first h turns are those of conv_id - conv_id % group, h = crc32(conv_id) % most."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    both = convs.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")).join(heads, "base", "left")
    none = F.array().cast(dict(convs.dtypes)["turns"])
    start = F.coalesce(F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.greatest("h", F.lit(1)))), none)
    return both.select("conv_id", F.concat(start, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def trie(spark: SparkSession, convs: DataFrame, block_rows: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row for each node of the trie of convs (conv_id, turns: array of (hash, words)): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    tmp = Scratch(spark)
    keyed = convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["hash"])), "")).alias("key"), F.transform("turns", lambda x: x["words"]).alias("words"))
    rows = numbered(tmp, keyed, ["key", "conv_id"])
    total = rows.count()
    block = F.floor(F.col("g") / block_rows).cast("long")
    # each block's last two rows are looked back at by the next one
    back = F.when(F.col("g") % block_rows >= block_rows - 2, F.array(block, block + 1)).otherwise(F.array(block))
    rows = rows.select(F.explode(back).alias("block"), "g", "conv_id", "key", "words").where(F.col("block") * block_rows < total)
    level = tmp.write(rows.repartition("block").sortWithinPartitions("block", "g").mapInArrow(first_level(total, block_rows), _OUT))
    runs = level.where("run is not null").select("run.*")
    nodes = level.where("node is not null").select("node.*")
    blocks = -(-total // block_rows)
    while blocks > 1:
        elements = level.where("element is not null").select("element.*").withColumn("block", F.floor(F.col("block") / fan).cast("long"))
        level = tmp.write(elements.repartition("block").sortWithinPartitions("block", "at").mapInArrow(next_level, _OUT))
        nodes = nodes.unionByName(level.where("node is not null").select("node.*"))
        blocks = -(-blocks // fan)

    ends = tmp.write(runs.repartition("id").sortWithinPartitions("id", "block").select("id", "n", "ids").mapInArrow(stream_ends, "id binary, n long, sha256 string"))
    nodes = tmp.write(nodes)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    up = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    got = nodes.join(children, "id", "left").join(ends.select("id", "sha256"), "id", "left").join(up, "parent", "left")
    got = got.withColumn("n_convs", F.col("end") - F.col("first")).withColumn("depth_here", F.explode(F.sequence(F.col("above") + 1, F.col("depth"))))
    d, last = F.col("depth_here"), F.col("depth_here") == F.col("depth")
    words = F.get("words", d - 1 - F.greatest("above", F.lit(0)))
    return got.select(
        "conv_id", d.cast("long").alias("depth"), F.when(d == 0, None).when(d == F.col("above") + 1, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("shared") - (F.col("n_convs") - 1) * F.when(d == 0, 0).otherwise(words)).alias("saved_tokens"),
        F.when(last & F.col("sha256").isNotNull(), F.col("sha256")).otherwise(hashlib.sha256(b"").hexdigest()).alias("ends_sha256"),
    )
