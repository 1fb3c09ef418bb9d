"""Texts as rows."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def sliding_batches(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of `size` characters, each sharing `overlap` with the one before."""
    n = F.greatest(F.length(text_col), F.lit(1))
    d = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col, F.explode(F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).alias("s"))
    d = d.withColumn("start_offset", F.col("s").cast("long"))
    return d.select(id_col, "start_offset", F.expr(f"substring({text_col}, int(start_offset + 1), {size})").alias("content"))


class _Markdown(HTMLParser):
    _inline = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "ul", "ol", "table", "tr", "blockquote"):
            self.out.append("\n\n" + "> " * (tag == "blockquote"))
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag in self._inline:
            self.out.append(self._inline[tag])

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.skip = max(0, self.skip - 1)
        elif tag == "a":
            self.out.append(f"]({self.links.pop() if self.links else ''})")
        elif tag in self._inline:
            self.out.append(self._inline[tag])
        elif re.fullmatch("h[1-6]|p", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(html: str) -> str:
    p = _Markdown()
    p.feed(html or "")
    p.close()
    t = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(p.out))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


FUNCTIONS = {"html_to_markdown": html_to_markdown}


def map_text(df: DataFrame, function: str, column: str, to: str | None = None) -> DataFrame:
    """df with a text function applied to a column, an Arrow batch at a time; null stays null."""
    f = FUNCTIONS[function]

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return df.withColumn(to or column, run(F.col(column)))
