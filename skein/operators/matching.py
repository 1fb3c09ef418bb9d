"""Finding texts in texts: exact, then fuzzy. Pure Python cores with grouped or mapped Spark wrappers.

Each row or document is independent; only the sequential parts (a hint carried from chunk to chunk) are kept within a document. Exact
hits are found natively before any Python runs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Hit:
    start: int
    end: int
    confidence: float
    method: str


def squeeze(text: str) -> tuple[str, list[int]]:
    """White space runs as one space, trimmed; and for each character its place in the raw text."""
    out, at, gap = [], [], False
    for i, c in enumerate(text):
        if c.isspace():
            gap = True
            continue
        if gap and out:
            out.append(" ")
            at.append(i - 1)
        gap = False
        out.append(c)
        at.append(i)
    return "".join(out), at


def trigram_set(text: str) -> set[str]:
    t = text.lower()
    return {t[i:i + 3] for i in range(len(t) - 2)}


def set_similarity(a: set, b: set) -> float:
    if not a and not b:
        return 1.0
    return len(a & b) / len(a | b) if a and b else 0.0


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column at a time in the bits of integers (Myers 1999, as Hyyro 2003)."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    at: dict[str, int] = {}
    for i, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << i
    full, top = (1 << len(b)) - 1, 1 << len(b) - 1
    up, down, n = full, 0, len(b)
    for x in a:
        eq = at.get(x, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | full & ~(h | up), up & h
        n += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | full & ~(v | more), more & v
    return n


def edit_similarity(a: str, b: str) -> float:
    n = max(len(a), len(b))
    return 1 - edit_distance(a, b) / n if n else 1.0


def windows(needle: str, hay: str, share: float = 0.1, many: float = 0.2):
    """Starts of the needle-long windows: a tenth of its length apart, a fifth where there would be over 100."""
    step = max(1, int(len(needle) * share))
    if (len(hay) - len(needle)) // step > 100:
        step = max(1, int(len(needle) * many))
    return range(0, max(1, len(hay) - len(needle) + 1), step)


@lru_cache(maxsize=1)
def _prepared(source: str) -> tuple[str, list[int], set[str]]:
    """A source squeezed, and its trigrams; kept for the needles that follow in the same source."""
    s, at = squeeze(source)
    return s, at, trigram_set(s)


def fuzzy_locate(chunk: str, source: str, index: int = 0, total: int = 1, threshold: float = 0.75) -> Hit:
    """A chunk's place in its source: equal up to white space, else the best trigram window, else a guess by its index (0.3).

    Places are in the raw source.
    """
    k = source.find(chunk)
    if chunk and k >= 0:
        return Hit(k, k + len(chunk), 1.0, "exact")
    c, (s, at, known) = squeeze(chunk)[0], _prepared(source)
    if c:
        k = s.find(c)
        if k >= 0:
            return Hit(at[k], at[k + len(c) - 1] + 1, 1.0, "exact")
        grams, best, where = trigram_set(c), 0.0, -1
        able = not grams or "Σ" in s or len(grams & known) >= threshold * len(grams) * (1 - 1e-9)  # no window shares more trigrams than the source, but for final sigmas
        for k in windows(c, s) if able and len(s) >= len(c) else ():
            v = set_similarity(grams, trigram_set(s[k:k + len(c)]))
            if v > best:
                best, where = v, k
            if best > 0.95:
                break
        if best >= threshold:
            return Hit(at[where], at[min(len(s), where + len(c)) - 1] + 1, best, "fuzzy")
    n = len(source)
    start = min(n, int(n * index / max(1, total)))
    return Hit(start, min(n, start + len(chunk)), 0.3, "approximate")


def shared_at_most(grams: set[str], text: str, n: int) -> list[int] | None:
    """For each start of a window of n signs, a bound on the trigrams that it shares; None where small letters of a part are not a part of the small letters."""
    low = text.lower()
    if not grams or n < 3 or len(text) < n or len(low) != len(text) or "Σ" in text or "İ" in text:
        return None
    so_far = list(accumulate((low[i:i + 3] in grams for i in range(len(low) - 2)), initial=0))
    return [b - a for a, b in zip(so_far, so_far[n - 2:], strict=False)]


def match_annotation(needle: str, text: str, before: str = "", after: str = "", near: str | None = None, near_at: int = 0) -> Hit | None:
    """Four tiers: exact; between its context (x 0.95); in the chunks around (near, which begins at near_at); by trigrams over all (x 0.9)."""
    k = text.find(needle)
    if not needle:
        return None
    if k >= 0:
        return Hit(k, k + len(needle), 1.0, "exact")
    if before and after:
        i = text.find(before)
        j = text.find(after, i + len(before)) if i >= 0 else -1
        if j >= 0:
            a, b = i + len(before), j
            v = edit_similarity(needle, text[a:b].strip())
            if v >= 0.75:
                return Hit(a, b, v * 0.95, "context")
    if near:
        best, at = 0.0, -1
        for k in windows(needle, near):
            v = edit_similarity(needle, near[k:k + len(needle)])
            if v > best:
                best, at = v, k
        if best >= 0.75:
            return Hit(near_at + at, near_at + min(len(near), at + len(needle)), best, "chunk_bounded")
    grams, best, at = trigram_set(needle), 0.0, -1
    most = shared_at_most(grams, text, len(needle))
    for k in windows(needle, text):
        if most is not None and (most[k] <= best * len(grams) * (1 - 1e-9) or most[k] < 0.65 * len(grams) * (1 - 1e-9)):
            continue
        v = set_similarity(grams, trigram_set(text[k:k + len(needle)]))
        if v > best:
            best, at = v, k
    if best >= 0.65 and best * 0.9 >= 0.6:
        return Hit(at, min(len(text), at + len(needle)), best * 0.9, "trigram")
    return None


def match_offsets(chunks: list[str], source: str) -> list[Hit]:
    """Chunks in order: exact from where the last ended, then up to white space, then by three anchors, then by edits (0.8); gaps are interpolated."""
    squeezed, at = squeeze(source)
    hits: list[Hit | None] = []
    hint = 0
    for c in chunks:
        found = None
        k = source.find(c, hint)
        if k < 0:
            k = source.find(c)
        if c and k >= 0:
            found = Hit(k, k + len(c), 1.0, "exact")
        else:
            q = squeeze(c)[0]
            k = squeezed.find(q) if q else -1
            if k >= 0:
                found = Hit(at[k], at[k + len(q) - 1] + 1, 0.95, "whitespace")
            elif len(c) >= 150:
                n = 50
                a, b = source.find(c[:n], hint), source.find(c[-n:], hint)
                m = source.find(c[len(c) // 2 - n // 2:len(c) // 2 + n // 2], hint)
                if 0 <= a and a < b and b + n - a < 1.5 * len(c) and (m < 0 or a < m < b):
                    found = Hit(a, b + n, 0.9, "anchors")
            if found is None and c:
                region = source[hint:hint + 4 * len(c)]
                best, where = 0.0, -1
                for k in windows(c, region):
                    v = edit_similarity(c, region[k:k + len(c)])
                    if v > best:
                        best, where = v, k
                if best >= 0.8:
                    found = Hit(hint + where, min(len(source), hint + where + len(c)), best, "edits")
        hits.append(found)
        if found:
            hint = found.end
    out: list[Hit] = []
    for i, h in enumerate(hits):
        if h:
            out.append(h)
            continue
        p = next((j for j in range(i - 1, -1, -1) if hits[j]), None)
        n = next((j for j in range(i + 1, len(hits)) if hits[j]), None)
        a = hits[p].end if p is not None else 0
        b = hits[n].start if n is not None else len(source)
        first, count = (p + 1 if p is not None else 0), (n if n is not None else len(hits)) - (p + 1 if p is not None else 0)
        start = a + max(0, b - a) * (i - first) // max(1, count)
        out.append(Hit(start, min(len(source), a + max(0, b - a) * (i - first + 1) // max(1, count)), 0.3, "interpolated"))
    return out


def repair_offset(chunk: str, text: str, hint: int = 0) -> Hit | None:
    """A stored chunk's place: exact from near its old start, then anywhere, then up to white space, then by its first and last 100 characters."""
    for start in (max(0, hint - 200), 0):
        k = text.find(chunk, start)
        if chunk and k >= 0:
            return Hit(k, k + len(chunk), 1.0, "exact")
    c, (s, at) = squeeze(chunk)[0], squeeze(text)
    k = s.find(c) if c else -1
    if k >= 0:
        return Hit(at[k], at[k + len(c) - 1] + 1, 0.95, "whitespace")
    if len(c) >= 200:
        a = s.find(c[:100])
        b = s.find(c[-100:], a) if a >= 0 else -1
        if 0 <= a < b <= a + 2 * len(c):
            return Hit(at[a], at[b + 99] + 1, 0.8, "ends")
    return None


def plain_headings(text: str) -> str:
    """The text with heading marks and emphasis blanked, same length."""
    return re.sub(r"(?m)^#{1,6}\s|[*_`]", lambda m: " " * len(m[0]), text)


def correct_offsets(chunks: list[str], source: str) -> list[Hit]:
    """match_offsets without heading marks and emphasis, then as written for what was only interpolated."""
    first = match_offsets([plain_headings(c) for c in chunks], plain_headings(source))
    if all(h.method != "interpolated" for h in first):
        return first
    second = match_offsets(chunks, source)
    return [b if a.method == "interpolated" and b.confidence > a.confidence else a for a, b in zip(first, second, strict=True)]


def stitch(parts: list[str], least: int = 20, share: float = 0.8, similar: float = 0.8, separator: str = "\n\n") -> str:
    """Adjacent texts joined at the longest equal end and start (from `least` characters, within `share` of the shorter), else a similar one, else a separator."""
    out = parts[0] if parts else ""
    for p in parts[1:]:
        most = int(min(len(out), len(p)) * share)
        n = next((k for k in range(most, least - 1, -1) if out.endswith(p[:k])), 0)
        if not n:
            for k in range(most, least - 1, -max(1, most // 20)):
                if set_similarity(trigram_set(out[-k:]), trigram_set(p[:k])) >= similar:
                    n = k
                    break
        out = out + p[n:] if n else out + separator + p
    return out


def locate_all(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """needles (needle_id, document_id, needle) in their own texts (document_id, text): start, end, confidence, method; a guess where there is no hit.

    Exact hits are native; only the others reach Python, a batch at a time. seek.seek looks for needles in all texts.
    """
    j = needles.join(texts, "document_id").withColumn("at", F.expr("instr(text, needle) - 1"))
    exact = j.where("at >= 0").select("needle_id", "document_id", F.col("at").alias("start"), (F.col("at") + F.length("needle")).alias("end"), F.lit(1.0).alias("confidence"), F.lit("exact").alias("method"))

    def rest(batches):
        for b in batches:
            rows = [fuzzy_locate(n, t) for n, t in zip(b["needle"], b["text"], strict=True)]
            yield pd.DataFrame({"needle_id": b["needle_id"], "document_id": b["document_id"], "start": [h.start for h in rows], "end": [h.end for h in rows], "confidence": [h.confidence for h in rows], "method": [h.method for h in rows]})

    fuzzy = j.where("at < 0").select("needle_id", "document_id", "needle", "text").mapInPandas(rest, "needle_id long, document_id long, start int, end int, confidence double, method string")
    return exact.unionByName(fuzzy)


def match_documents(chunks: DataFrame, texts: DataFrame, match=match_offsets) -> DataFrame:
    """Offsets of chunks (document_id, chunk_index, content) in texts (document_id, text); a document is one row of work.

    match: match_offsets or correct_offsets.
    """
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    d = chunks.groupBy("document_id").agg(rows.alias("rows")).join(texts, "document_id")

    def run(batches):
        for b in batches:
            out = []
            for doc, own, text in zip(b["document_id"], b["rows"], b["text"], strict=True):
                hits = match([r["content"] for r in own], text)
                out += [(doc, r["chunk_index"], h.start, h.end, h.confidence, h.method) for r, h in zip(own, hits, strict=True)]
            yield pd.DataFrame(out, columns=["document_id", "chunk_index", "start_offset", "end_offset", "confidence", "method"])

    return d.select("document_id", "rows", "text").mapInPandas(run, "document_id long, chunk_index int, start_offset int, end_offset int, confidence double, method string")


def stitch_documents(parts: DataFrame, **options) -> DataFrame:
    """parts (document_id, chunk_index, content) to one text a document."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"document_id": b["document_id"], "text": [stitch([r["content"] for r in own], **options) for own in b["rows"]]})

    return parts.groupBy("document_id").agg(rows.alias("rows")).mapInPandas(run, "document_id long, text string")


GRAM = 3  # words of an anchor


def holding(texts: DataFrame, needles: DataFrame, id_col: str = "doc_id", text_col: str = "text", needle_col: str = "needle") -> DataFrame:
    """Rows of texts with each needle they hold, whole and exact.

    All of a needle's words but its first and last stand whole in a text that holds it. Its rarest run of GRAM of them (by the needles' own counts)
    is its anchor; texts' runs that are some anchor, found by a join on hashes, bring the ids of texts, and only these are compared. Needles
    of fewer words have no anchor and are compared with every text. Rows that repeat an id with other texts are compared each.
    """
    words = lambda c: F.split(c, r"[ \t\n\r\f\x0B]+")
    runs = lambda w: F.when(F.size(w) >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - GRAM), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(GRAM))))))
    n = needles.where(F.length(needle_col) > 0).withColumn("_n", F.xxhash64(*needles.columns)).withColumn("_w", words(F.col(needle_col)))
    n = n.withColumn("_w", F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0))))
    long = n.where(F.size("_w") >= GRAM)
    each = long.select("_n", F.explode(runs(F.col("_w"))).alias("_g")).distinct()
    often = each.groupBy("_g").agg(F.count("*").alias("_c"))
    anchors = each.join(often, "_g").groupBy("_n").agg(F.min_by("_g", F.struct("_c", "_g")).alias("_g"))
    cut = texts.select(F.col(id_col).alias("_id"), words(F.col(text_col)).alias("_w")).select("_id", F.explode(runs(F.col("_w"))).alias("_g"))
    met = cut.join(anchors, "_g").select("_id", "_n").distinct()
    met = texts.join(met, texts[id_col] == met["_id"]).join(long.drop("_w"), "_n").drop("_n", "_id")
    short = n.where(F.size("_w") < GRAM).drop("_n", "_w")
    held = F.expr(f"instr({text_col}, {needle_col}) > 0")
    return met.where(held).unionByName(texts.join(short, held))


def _confidence_of(matches: DataFrame):
    found = F.col("method") != "interpolated"
    return found, F.sum(F.when(found, F.col("confidence")).otherwise(0.0))


def match_statistics(matches: DataFrame) -> DataFrame:
    """Matches of all chunks (confidence, method, start_offset, end_offset) by layer: n, share of all, mean confidence, characters."""
    g = matches.groupBy("method").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.sum(F.col("end_offset") - F.col("start_offset")).alias("chars"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row for each layer
    return g.select("method", "n", F.round(F.col("n") / total, 6).alias("share"), F.round("mean", 6).alias("confidence"), "chars")


def match_quality(matches: DataFrame, exact: float = 1.0, high: float = 0.85) -> DataFrame:
    """Per document: chunks by tier (exact, high, medium; interpolated ones are synthetic), the share that was found and the mean confidence with 0 for the rest."""
    found, total = _confidence_of(matches)
    c = F.col("confidence")
    tiers = {"exact": found & (c >= exact), "high": found & (c >= high) & (c < exact), "medium": found & (c < high), "synthetic": ~found}
    return matches.groupBy("document_id").agg(*[F.count_if(x).alias(k) for k, x in tiers.items()], F.round(F.count_if(found) / F.count("*"), 6).alias("rate"), F.round(total / F.count("*"), 6).alias("confidence"))
