"""op12 and op13 against brute force: all edits tried one by one, and a trie of plain dictionaries."""

import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import conversation_repair, prefix_trie, queries

FOLDER = os.environ.get("SKEIN_TEST_TABLES", "/root/testdata/sf0.001")
TURNS = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")


@pytest.fixture
def many_partitions(spark):
    """Small tables over several tasks, so that conversations are cut."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


# ------------------------------------------------------------------ 12

def damaged(rows):
    out = []
    for c, t, r, x in rows:
        text = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{text(c)}:{text(t)}".encode()) % 20
        r, x = text(r), text(x)
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def fault_letters(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        s = x.rstrip(WHITE)
        out.append("b" if not s else "d" if (r, x) in seen else "t" if s[-1] not in ".!?" else "-")
        seen.add((r, x))
    return out


def every_repair(rows, faults):
    """All repairs with at most two inserts at a place, as (cost, audit, repaired): nothing is thrown away on the way."""
    out = []

    def inserts(i, cost, audit, done):
        for n in range(3):
            for roles in ([], [["user"], ["assistant"]], [["user", "assistant"], ["assistant", "user"], ["user", "user"], ["assistant", "assistant"]])[n] if n else [[]]:
                step(i, cost + 3 * n, audit + "I" * n, done + [(r, "") for r in roles])

    def step(i, cost, audit, done):
        if cost > limit:
            return
        if i == len(rows):
            if GRAMMAR.fullmatch("".join(r[:1] if r else "-" for r, _ in done)):
                out.append((cost, audit, done))
            return
        _, _, role, text = rows[i]
        inserts(i + 1, cost + 4, audit + "D", done)
        if faults[i] not in "bd":
            more = 3 * (faults[i] == "t")
            inserts(i + 1, cost + more, audit + "K", [*done, (role, text)])
            for new in ("user", "assistant"):
                inserts(i + 1, cost + more + 3, audit + "R", [*done, (new, text)])

    limit = 4 * len(rows)
    inserts(0, 0, "", [])
    return min(out, key=lambda x: x[:2])


def cheapest(rows, faults):
    """The same by a table of whole strings for each last initial, for long conversations."""
    follows = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    def closed(table):
        for _ in range(4):
            for q, (c, a, o) in list(table.items()):
                for role in ("user", "assistant"):
                    if (q, role[0]) in follows:
                        new = (c + 3, a + "I", (*o, (role, "")))
                        if role[0] not in table or new[:2] < table[role[0]][:2]:
                            table[role[0]] = new
        return table

    table = closed({"": (0, "", ())})
    for (_, _, role, text), f in zip(rows, faults, strict=True):
        new: dict = {}

        def offer(q, path, new=new):
            if q not in new or path[:2] < new[q][:2]:
                new[q] = path

        for q, (c, a, o) in table.items():
            offer(q, (c + 4, a + "D", o))
            if f not in "bd":
                more = 3 * (f == "t")
                if (q, role[:1]) in follows:
                    offer(role[:1], (c + more, a + "K", (*o, (role, text))))
                for to in ("user", "assistant"):
                    if (q, to[0]) in follows:
                        offer(to[0], (c + more + 3, a + "R", (*o, (to, text))))
        table = closed(new)
    return min((table[q] for q in ("", "a") if q in table), key=lambda x: x[:2])


def brute_repair(rows, search=cheapest):
    groups = {c: [] for c, *_ in rows}
    for r in damaged(rows):
        groups[r[0]].append(r)
    out = []
    for c, own in groups.items():
        own = in_order(own)
        f, turns, initials = fault_letters(own), [r[1] for r in own if r[1] is not None], [r[2][:1] for r in own]
        cost, audit, done = search(own, f)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((c, gaps, f.count("b"), f.count("d"), f.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in done).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_turns(r, convs, most):
    rows = []
    for c in range(convs):
        for k in range(r.randint(0, most)):
            rows.append((c, r.choice([None, k, k, k, k + 2]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umm"]), r.choice(["Hi.", "yes!", "no", "", " ", None, "a.b", "q? \n", "é"])))
    return rows


def repaired(spark, rows, parts=5):
    return sorted((tuple(r) for r in conversation_repair.damaged_and_repaired(spark, spark.createDataFrame(rows, TURNS).repartition(parts)).collect()), key=str)


def test_repair_equals_all_edits(spark):
    rows = odd_turns(random.Random(8), 60, 4)
    assert repaired(spark, rows) == brute_repair(rows, every_repair)


def test_repair_of_long_conversations(spark, many_partitions):
    r = random.Random(3)
    rows = odd_turns(r, 120, 12)
    rows += [(None, k, "user", "x.") for k in range(6)]
    rows += [(900, k, r.choice(["user", "assistant", "system", "x"]), r.choice([f"Hi {k}.", f"no {k}", "", "dup."])) for k in range(900)]  # one conversation over all tasks
    assert repaired(spark, rows) == brute_repair(rows)


def test_repair_put_away_strings():
    r = random.Random(5)
    for _ in range(30):
        whole, cut, rows = conversation_repair.Paths(), conversation_repair.Paths(conversation_repair.START), []
        old, conversation_repair.FREEZE = conversation_repair.FREEZE, r.choice([1, 2, 3, 7])
        rows = [(r.choice("suax"), r.random() < 0.2, r.random() < 0.3) for _ in range(40)]
        for x in rows:
            whole.row(*x)
        conversation_repair.FREEZE = old
        plain = conversation_repair.Paths()
        for x in rows:
            plain.row(*x)
        assert [p and p[0] for p in whole.now] == [p and p[0] for p in plain.now]
        assert whole.best() == plain.best()
        at = 0
        while at < len(rows):  # parts of any size, from every state
            n = r.randint(1, 9)
            steps = []
            for s in [-1] if at == 0 else range(4):
                p = conversation_repair.Paths(None if s < 0 else s)
                for x in rows[at:at + n]:
                    p.row(*x)
                steps += [(max(s, 0), q, p.now[q][0], p.edits(q)) for q in range(4) if p.now[q]]
            cut.part(steps)
            at += n
        assert cut.best() == plain.best()
        assert len(conversation_repair.split_rows(plain.best()[1])) == len(rows)


def test_repaired_turns_follow_the_grammar(spark):
    rows = odd_turns(random.Random(9), 40, 8)
    turns, summary = conversation_repair.repair(spark, conversation_repair.damage(spark.createDataFrame(rows, TURNS)))
    got = defaultdict(list)
    for t in turns.orderBy("g", "k").collect():
        got[t["conv_id"]].append(t)
    for s in summary.collect():
        assert GRAMMAR.fullmatch("".join(t["role"][:1] for t in got[s["conv_id"]]))
        assert "".join(t["edit"] for t in got[s["conv_id"]]) == s["audit"].replace("D", "")


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op12_conversation_repair(spark, FOLDER).collect()), key=str) == brute_repair(rows)


def test_repair_of_odd_tables(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(dropped, 0, "user", "Hi.")]) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    rows = [(7, 1, "user", "Same."), (7, 1, "user", "Same."), (None, None, None, None), (8, 0, "user", "long. " * 50000)]
    extra = spark.createDataFrame(rows, TURNS).withColumn("g", F.lit(1)).withColumn("fault", F.lit("x")).withColumn("edits", F.lit(None))
    assert sorted((tuple(r) for r in conversation_repair.damaged_and_repaired(spark, extra).collect()), key=str) == brute_repair(rows)
    assert conversation_repair.damaged_and_repaired(spark, extra.where(F.lit(False))).count() == 0


# ------------------------------------------------------------------ 13

def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        words = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += words
            leaves[p[:d]] += not children[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(spark, df, **sizes):
    return sorted((tuple(r) for r in prefix_trie.trie(spark, prefix_trie.rebuilt(prefix_trie.conversations(df)), **sizes).collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 8, "fan": 2}, {"block_rows": 3, "fan": 5}, {"block_rows": 50, "fan": 3}])
@pytest.mark.parametrize("shift", [0, 50])
def test_trie_equals_dictionaries(spark, sizes, shift):
    r = random.Random(shift)
    rows = [(c - shift, k, r.choice(["u", "a"]) if r.random() < 0.3 else "u", r.choice(["x y", "x y", None, "z a b"]) if r.random() < 0.7 else "same words here") for c in range(200) for k in range(r.choice([1, 1, 2, 3, 4, 6]))]
    rows += [(c, k, "u", f"hot hot {k}") for c in range(400, 480) for k in range(5)]  # a group of copies over many blocks
    rows += [(600, k, "a", f"long {k}") for k in range(300)] + [(601, k, "a", f"long {k}") for k in range(298)]
    rows += [(None, 1, "u", "x")]
    assert trie_of(spark, spark.createDataFrame(rows, TURNS).repartition(5), **sizes) == brute_trie(rows)


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_prefix_trie(spark, FOLDER).collect()), key=str) == brute_trie(rows)


def test_trie_of_odd_tables(spark):
    one = [(20, None, None, None), (20, 0, "user", "long " * 30000), (20, 0, "user", "long " * 30000)]
    df = spark.createDataFrame(one, TURNS).withColumn("key", F.lit("x")).withColumn("g", F.lit(1)).withColumn("words", F.lit(2))
    assert trie_of(spark, df) == brute_trie(one)
    short = [(c, 0, "u", "only") for c in range(41, 60)]  # conversations whose h exceeds their turns are turnless
    assert trie_of(spark, spark.createDataFrame(short, TURNS), block_rows=2, fan=2) == brute_trie(short)
    assert trie_of(spark, df.where(F.lit(False))) == []
