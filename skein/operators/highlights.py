"""Highlights put into a block's HTML, and read back."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import overlapping


class _Marker(HTMLParser):
    """Copies markup as it is written and wraps the stretches of text that marks (start, end, id, color, begins, ends) cover."""

    def __init__(self, marks: list[tuple]):
        super().__init__(convert_charrefs=False)
        self.marks, self.at, self.raw, self.out, self.begun = marks, 0, False, [], set()
        self.pending: list[str] = []

    def flush(self) -> None:
        """Character references split the parser's text; a node of text is all of it up to the next tag."""
        text, self.pending = "".join(self.pending), []
        if text:
            self.wrap(text, self.at, 0)
            self.at += len(text)

    def wrap(self, text: str, at: int, i: int) -> None:
        end = at + len(text)
        while i < len(self.marks) and not (self.marks[i][1] > at and self.marks[i][0] < end):
            i += 1
        if i == len(self.marks):
            self.out.append(text if self.raw else html.escape(text, quote=False))
            return
        start, stop, name, color, begins, ends = self.marks[i]
        a, b = max(0, start - at), min(len(text), stop - at)
        if a:
            self.wrap(text[:a], at, i + 1)
        flags = ' data-annotation-start="true"' if begins and i not in self.begun else ""
        flags += ' data-annotation-end="true"' if ends and end >= stop else ""
        self.begun.add(i)
        self.out.append(f'<span data-annotation-id="{html.escape(name)}" data-annotation-color="{html.escape(color)}"{flags}>')
        if b > a:
            self.wrap(text[a:b], at + a, i + 1)
        self.out.append("</span>")
        if b < len(text):
            self.wrap(text[b:], at + b, i + 1)

    def markup(self, text: str) -> None:
        self.flush()
        self.out.append(text)

    def handle_starttag(self, tag, attrs):
        self.markup(self.get_starttag_text())
        self.raw = tag in ("script", "style")

    def handle_startendtag(self, tag, attrs):
        self.markup(self.get_starttag_text())

    def handle_endtag(self, tag):
        self.markup(f"</{tag}>")
        self.raw = False

    def handle_data(self, data):
        self.pending.append(data)

    def handle_entityref(self, name):
        self.pending.append(html.unescape(f"&{name};"))

    def handle_charref(self, name):
        self.pending.append(html.unescape(f"&#{name};"))

    def handle_comment(self, data):
        self.markup(f"<!--{data}-->")

    def handle_decl(self, decl):
        self.markup(f"<!{decl}>")

    def handle_pi(self, data):
        self.markup(f"<?{data}>")


def inject(text: str, start: int, end: int, annotations: list[tuple]) -> str:
    """HTML of a block at [start, end) with annotations (id, start, end, color) as spans.

    Offsets count the characters of the text. Every node of text gets spans of its own; later annotations lie inside earlier ones. The
    first span of an annotation is flagged if it begins in this block, the last if it ends here. Ties keep the order given.
    """
    marks = [(max(0, s - start), min(end, e) - start, str(i), c or "", start <= s < end, start < e <= end) for i, s, e, c in sorted(annotations, key=lambda a: a[1]) if e > start and s < end]
    if not marks:
        return text
    p = _Marker(marks)
    p.feed(text)
    p.close()
    p.flush()
    return "".join(p.out)


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str | None] = []
        self.found: dict[str, list] = {}

    def handle_starttag(self, tag, attrs):
        if tag != "span":
            return
        a = dict(attrs)
        name = a.get("data-annotation-id")
        self.open.append(name)
        if name is not None:
            f = self.found.setdefault(name, [0, 0, False, False])
            f[0] += 1
            f[2] |= "data-annotation-start" in a
            f[3] |= "data-annotation-end" in a

    def handle_endtag(self, tag):
        if tag == "span" and self.open:
            self.open.pop()

    def handle_data(self, data):
        for name in {n for n in self.open if n is not None}:
            self.found[name][1] += len(data)


def read_marks(text: str) -> list[tuple]:
    """(id, spans, characters, begins, ends) of the annotations in HTML, by id."""
    p = _Reader()
    p.feed(text)
    p.close()
    return [(n, *f) for n, f in sorted(p.found.items())]


def highlight_blocks(blocks: DataFrame, annotations: DataFrame) -> DataFrame:
    """blocks (id, document_id, start_offset, end_offset, html) with the annotations (annotation_id, document_id, start_offset, end_offset, color) that overlap them put in.

    The join is on document and bucket of offsets and carries no HTML; a block's annotations, those that lie over it, meet in its row. Blocks
    without any, or with null HTML, stay as they are.
    """
    a = annotations.select("document_id", F.col("start_offset").alias("r_start"), F.col("end_offset").alias("r_end"), F.col("annotation_id").cast("string").alias("annotation_id"), "color")
    found = overlapping(blocks.select("id", "document_id", "start_offset", "end_offset"), a)
    rows = F.array_sort(F.collect_list(F.struct("r_start", "annotation_id", "r_end", "color")))
    marks = found.groupBy("id").agg(rows.alias("marks"))

    def put(text: pd.Series, start: pd.Series, end: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or m is None else inject(t, s, e, [(x["annotation_id"], x["r_start"], x["r_end"], x["color"]) for x in m]) for t, s, e, m in zip(text, start, end, marks, strict=True)], dtype=object)

    to = F.pandas_udf(put, "string")
    return blocks.join(marks, "id", "left").withColumn("html", to("html", "start_offset", "end_offset", "marks")).drop("marks")


def marks_of(blocks: DataFrame) -> DataFrame:
    """One row for each block (id, html) and annotation in it: annotation_id, spans, chars, begins, ends."""
    schema = "array<struct<annotation_id:string,spans:int,chars:int,begins:boolean,ends:boolean>>"
    names = ("annotation_id", "spans", "chars", "begins", "ends")
    to = F.pandas_udf(lambda s: s.map(lambda t: [dict(zip(names, m, strict=True)) for m in read_marks(t or "")]), schema)
    return blocks.select("id", F.explode(to("html")).alias("m")).select("id", "m.*")
