"""Cutting texts into chunks, blocks and batches: Python cores and table functions over a text column."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.M)


def paragraphs(text: str, start: int = 0):
    """(start, end) of runs between blank lines."""
    at = 0
    for m in re.finditer(r"\n\s*\n", text):
        if text[at:m.start()].strip():
            yield start + at, start + m.start()
        at = m.end()
    if text[at:].strip():
        yield start + at, start + len(text)


def heading_chunks(text: str, least: int = 200, most: int = 2000, body: int = 50) -> list[dict]:
    """Sections between headings, with the path of headings above: too short ones go, long ones are cut at paragraphs."""
    marks = list(HEADING.finditer(text))
    out: list[dict] = []

    def put(a: int, b: int, path: list[str], level: int):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append({"start": a, "end": b, "heading_path": "/".join(path), "level": level})

    def cut(a: int, b: int, path: list[str], level: int):
        if b - a <= most:
            return put(a, b, path, level)
        begin = end = None
        for s, e in paragraphs(text[a:b], a):
            if begin is not None and e - begin > most:
                put(begin, end, path, level)
                begin = None
            begin = s if begin is None else begin
            end = e
        if begin is not None:
            put(begin, end, path, level)

    if not marks:
        cut(0, len(text), ["Document Content"], 0)
    stack: list[tuple[int, str]] = []
    for k, m in enumerate(marks):
        level = len(m[1])
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, m[2].strip()))
        b = marks[k + 1].start() if k + 1 < len(marks) else len(text)
        if len(text[m.end():b].strip()) < body or len(text[m.start():b].strip()) < least:
            continue
        cut(m.start(), b, [h for _, h in stack], level)
    for i, c in enumerate(out):
        c["chunk_index"] = i
    return out


def token_chunks(text: str, size: int = 512, overlap: int = 0) -> list[dict]:
    """Runs of `size` white-space tokens, `overlap` of them shared."""
    t = [m.span() for m in re.finditer(r"\S+", text)]
    return [{"start": t[i][0], "end": t[min(len(t), i + size) - 1][1], "tokens": min(len(t), i + size) - i} for i in range(0, len(t), max(1, size - overlap)) if not overlap or i == 0 or i + overlap < len(t)]


def sentence_spans(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in re.finditer(r"[.!?]+[\"')\]]*\s+", text):
        out.append((at, m.end()))
        at = m.end()
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def _tokens(text: str) -> int:
    return len(text.split())


def _merge(text: str, spans: list[tuple[int, int]], size: int) -> list[dict]:
    out: list[dict] = []
    for a, b in spans:
        n = _tokens(text[a:b])
        if out and out[-1]["tokens"] + n <= size:
            out[-1]["end"], out[-1]["tokens"] = b, out[-1]["tokens"] + n
        else:
            out.append({"start": a, "end": b, "tokens": n})
    return out


def sentence_chunks(text: str, size: int = 512) -> list[dict]:
    """Whole sentences up to `size` tokens."""
    return _merge(text, sentence_spans(text), size)


def recursive_chunks(text: str, size: int = 512) -> list[dict]:
    """Paragraphs, those too long as sentences, those too long as tokens; neighbours merged up to `size`."""
    spans: list[tuple[int, int]] = []
    for a, b in paragraphs(text):
        if _tokens(text[a:b]) <= size:
            spans.append((a, b))
            continue
        for c, d in sentence_spans(text[a:b]):
            if _tokens(text[a + c:a + d]) <= size:
                spans.append((a + c, a + d))
            else:
                spans += [(a + c + x["start"], a + c + x["end"]) for x in token_chunks(text[a + c:a + d], size)]
    return _merge(text, spans, size)


def bounded_pieces(text: str, most: int = 8000) -> list[tuple[int, int]]:
    """Exact cover of a text by pieces of at most `most`, cut after a paragraph, else a sentence, else a word, else anywhere."""
    out, at = [], 0
    while len(text) - at > most:
        part = text[at:at + most]
        cut = 0
        for mark in ("\n\n", ". ", " "):
            k = part.rfind(mark)
            if k > most // 2:
                cut = k + len(mark)
                break
        out.append((at, at + (cut or most)))
        at = out[-1][1]
    if at < len(text) or not text:
        out.append((at, len(text)))
    return out


def pack_paragraphs(text: str, target: int = 40_000) -> list[tuple[int, int]]:
    """Paragraphs in a row up to `target` characters."""
    out: list[list[int]] = []
    for a, b in paragraphs(text):
        if out and b - out[-1][0] <= target:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_SPURIOUS = re.compile(r"^(?:[ivxlcdm]+|[a-z]|index|notes|page|contents)\.?$", re.I)


def heading_batches(text: str, most: int = 10_000) -> list[tuple[int, int]]:
    """Sections at ## headings; headings that are numerals, single letters or index words do not split; sections gather to four fifths of `most`."""
    cuts = [m.start() for m in re.finditer(r"^##\s+(.+)$", text, re.M) if not _SPURIOUS.match(m[1].strip())]
    edges = sorted({0, *cuts, len(text)})
    out: list[list[int]] = []
    for a, b in zip(edges, edges[1:], strict=False):
        if out and b - out[-1][0] <= most * 0.8:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_BLOCKS = (("code", re.compile(r"^```")), ("heading", re.compile(r"^#{1,6}\s")), ("quote", re.compile(r"^>\s?")), ("list", re.compile(r"^\s*(?:[-*+•]|\d+\.)\s")), ("table", re.compile(r"^\|.*\|")), ("rule", re.compile(r"^(?:---+|\*\*\*+)\s*$")))


def block_kind(line: str) -> str:
    return next((k for k, p in _BLOCKS if p.match(line)), "paragraph")


def blocks(text: str) -> list[dict]:
    """Markdown blocks in order: kind and exact offsets; a fenced block is one."""
    out: list[dict] = []
    at, fence, open_ = 0, False, False
    for line in text.split("\n"):
        end = at + len(line)
        if fence:
            out[-1]["end"] = end
            fence = not line.startswith("```")
            open_ = False
        elif not line.strip():
            open_ = False
        else:
            kind = block_kind(line)
            if open_ and out[-1]["kind"] == kind and kind not in ("heading", "code", "rule"):
                out[-1]["end"] = end
            else:
                out.append({"kind": kind, "start": at, "end": end})
            fence = kind == "code"
            open_ = kind not in ("heading", "rule")
        at = end + 1
    return [b | {"position": i} for i, b in enumerate(out)]


def fingerprint(text: str) -> dict:
    """Sequence of block kinds, nesting depth, complexity and a 32-bit hash of the sequence in base 36."""
    kinds = [b["kind"] for b in blocks(text)]
    depth = max((len(m[1]) for m in HEADING.finditer(text)), default=0)
    complexity = min(1.0, len(set(kinds)) / 7 * 0.5 + min(depth, 6) / 6 * 0.3 + min(len(kinds), 20) / 20 * 0.2)
    h = 0
    for c in "-".join(kinds):
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    digits = ""
    while h or not digits:
        h, r = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
    return {"sequence": kinds, "depth": depth, "complexity": complexity, "hash": digits}


def fingerprint_similarity(a: dict, b: dict) -> float:
    """0.3 sequence (edit distance of kinds) + 0.2 depth + 0.25 complexity + 0.25 share of kinds in common."""
    from .matching import edit_distance, set_similarity

    names = sorted({*a["sequence"], *b["sequence"]})
    code = {k: chr(65 + i) for i, k in enumerate(names)}
    x, y = ("".join(code[k] for k in s["sequence"]) for s in (a, b))
    seq = 1 - edit_distance(x, y) / max(len(x), len(y)) if x or y else 1.0
    return 0.3 * seq + 0.2 * (1 - abs(a["depth"] - b["depth"]) / 6) + 0.25 * (1 - abs(a["complexity"] - b["complexity"])) + 0.25 * set_similarity(set(a["sequence"]), set(b["sequence"]))


CHUNKERS = {"heading": heading_chunks, "token": token_chunks, "sentence": sentence_chunks, "recursive": recursive_chunks}


def chunk_documents(docs: DataFrame, chunker: str = "recursive", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """document_id, chunk_index, start_offset, end_offset, content, chunker_type: one pass, no shuffle."""
    f = CHUNKERS[chunker]

    def run(batches):
        for b in batches:
            out = []
            for doc, text in zip(b["id"], b["text"], strict=True):
                for i, c in enumerate(f(text or "", **options)):
                    out.append((doc, i, c["start"], c["end"], text[c["start"]:c["end"]], chunker))
            yield pd.DataFrame(out, columns=["document_id", "chunk_index", "start_offset", "end_offset", "content", "chunker_type"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "document_id long, chunk_index int, start_offset int, end_offset int, content string, chunker_type string")


def block_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        for b in batches:
            out = [(doc, x["position"], x["kind"], x["start"], x["end"]) for doc, text in zip(b["id"], b["text"], strict=True) for x in blocks(text or "")]
            yield pd.DataFrame(out, columns=["document_id", "position", "kind", "start_offset", "end_offset"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "document_id long, position int, kind string, start_offset int, end_offset int")
