"""Articles in web pages: the subtree that holds most text, by sums over a page's elements as rows.

A page becomes rows in the order of its source: an element's beginning, its end, and runs of text between them. Each run has a value: its characters, less
three for each character in a link, less RUN; runs beside the text (navigation, forms, hidden or advertising elements) count RUN against
it. A running sum over a page's rows gives every element's sum as the difference between its end and its beginning, so nothing is summed
upward element by element. The article is the element of the largest sum, the innermost of equals, and those of its siblings that hold at least a share
of that sum, or are paragraphs, headings, lists or tables without a link; the runs between their beginnings and ends are its text, found by an interval join.

All steps are keyed by page, so rows are shuffled once. Parsing is the only Python: it turns one page into rows.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RUN, SIBLING, LEAST = 25, 0.2, 140
PLAIN = r"^(?:p|h[1-6]|ul|ol|dl|pre|blockquote|table|figure)$"

# Elements of HTML by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video select textarea button".split())
BESIDE = frozenset("nav aside footer form menu dialog".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot div section article main body blockquote td th".split())
PARAGRAPH_ENDS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HINTS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookie\w*|footer|menu|nav\w*|newsletter|pagination|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|widget)(?:$|[\s_-])")
ESCAPES = ("amp", "apos", "gt", "lt", "nbsp", "quot")
TITLE_END = re.compile(r"&([a-z]+)(?=\s*</title\b)", re.IGNORECASE)
BYLINE = re.compile(r"(?:^|[\s_-])(?:byline|author|written-?by)(?:$|[\s_-])")

ROWS = "doc long, seq int, kind string, element int, parent int, depth int, tag string, text string, chars int, links int, beside boolean, heading boolean"
_TYPES = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())


class _Rows(HTMLParser):
    """The rows of one page: (seq, kind, element, parent, depth, tag, text, chars, links, beside, heading); kinds: open, close, text, and facts (tag: which)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.stack: list[tuple[str, int, bool]] = []  # (tag, element, beside)
        self.elements, self.silent, self.links, self.in_title, self.byline = 0, 0, 0, False, 0
        self.text: list[str] = []
        self.linked = 0

    def _row(self, kind: str, element: int, parent: int, tag: str, text: str | None = None, links: int = 0, beside: bool = False) -> None:
        self.rows.append((len(self.rows), kind, element, parent, len(self.stack), tag, text, len(text or ""), links, beside, bool(re.fullmatch("h[1-6]", tag))))

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            tag, element, beside = self.stack[-1] if self.stack else ("", -1, False)
            self._row("text", element, element, tag, text, min(self.linked, len(text)), beside)
        self.text, self.linked = [], 0

    def _pop(self) -> None:
        self._flush()
        tag, element, _ = self.stack.pop()
        self._row("close", element, self.stack[-1][1] if self.stack else -1, tag)
        self.byline = 0 if self.byline == element + 1 else self.byline

    def _fact(self, name: str, value: str | None) -> None:
        if value and value.strip():
            self._row("fact", -1, -1, name, " ".join(value.split()))

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self._fact("lang", a.get("lang"))
        if tag == "meta":
            self._fact((a.get("property") or a.get("name") or "").lower(), a.get("content"))
        hint = f"{a.get('class', '')} {a.get('id', '')}".lower()
        if (BYLINE.search(hint) or a.get("rel") == "author") and tag not in VOID and not self.byline:
            self.byline = -1 if tag in INLINE else self.elements + 1
        if tag in SILENT:
            self.silent += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "a":
            self.links += 1
        elif tag in ("br", "hr"):
            self.text.append(" ")
        elif tag not in VOID and tag not in INLINE:
            self._flush()
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in PARAGRAPH_ENDS else set())
            while ends:  # an element whose end may be left out ends here
                k = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] in ends or self.stack[k][0] in SCOPES - ends), -1)
                if k < 0 or self.stack[k][0] not in ends:
                    break
                while len(self.stack) > k:
                    self._pop()
            hidden = "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")) is not None
            beside = bool(self.stack and self.stack[-1][2]) or tag in BESIDE or hidden or (tag not in ("html", "body", "article", "main") and HINTS.search(hint) is not None)
            self._row("open", self.elements, self.stack[-1][1] if self.stack else -1, tag)
            self.stack.append((tag, self.elements, beside))
            self.elements += 1

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag not in INLINE and any(t == tag for t, _, _ in self.stack):
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()
        if tag in INLINE and self.byline == -1:
            self.byline = 0

    def handle_data(self, data):
        if self.in_title:
            self._fact("title", data)
        elif not self.silent and not any(t == "head" for t, _, _ in self.stack):
            self.text.append(data)
            if self.links:
                self.linked += len(" ".join(data.split()))
            if self.byline and len(data.split()) and len(data) < 100:
                self._fact("byline", data)

    def finish(self) -> list[tuple]:
        self.close()
        while self.stack:
            self._pop()
        self._flush()
        return self.rows


def _whole(end: re.Match) -> str:
    """The end of a title without the beginning of an escape, whose rest was cut off with the rest of the title; what is no such beginning stays (AT&T)."""
    return "" if unescape(end[0]) == end[0] and any(e.startswith(end[1]) for e in ESCAPES) else end[0]


def rows_of(page: str) -> list[tuple]:
    p = _Rows()
    p.feed(TITLE_END.sub(_whole, page))
    return p.finish()


def page_rows(pages: DataFrame, html_col: str) -> DataFrame:
    """pages as rows: a row of kind `page` with the other columns, then those of ROWS."""
    other = [c for c in pages.columns if c != html_col]
    given = pages.select(F.monotonically_increasing_id().alias("doc"), F.struct(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(other)), F.lit(0).alias("_")).alias("page"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            kind = batch.schema.field("page").type
            names = [x.split()[0] for x in ROWS.split(", ")] + ["page"]
            for k, (doc, page) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):  # a page at a time bounds the memory
                first = (-1, "page", -1, -1, 0, "", None, 0, 0, False, False)
                rows = [first, *rows_of(page or "")]
                for i in range(0, len(rows), 10_000):
                    some = rows[i:i + 10_000]
                    cols = [[doc] * len(some), *zip(*some, strict=True)]
                    own = pa.concat_arrays([batch.column(1).slice(k, 1), pa.nulls(len(some) - 1, kind)]) if i == 0 else pa.nulls(len(some), kind)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)), own], names=names)

    schema = StructType.fromDDL(ROWS).add("page", given.schema["page"].dataType)
    return given.mapInArrow(run, schema)


def extract_articles(pages: DataFrame, scratch: str, html_col: str = "html", least: int = LEAST) -> DataFrame:
    """pages with title, byline, site_name, lang, excerpt, content (HTML of its paragraphs and headings), text, length, is_article.

    is_article: whether the best element's sum reaches `least`; where it does not, content and text are empty. A null or broken page is no article.
    scratch: a new folder that all executors share, for the rows; what is read of them to find the article are numbers.
    """
    spark = pages.sparkSession
    parsed = page_rows(pages, html_col)
    parsed.write.parquet(f"{scratch}/rows")
    rows = spark.read.schema(parsed.schema).parquet(f"{scratch}/rows")

    value = F.when(F.col("kind") != "text", 0).when(F.col("beside"), -RUN).when(F.col("heading"), F.col("chars") - 3 * F.col("links")).otherwise(F.col("chars") - 3 * F.col("links") - RUN)
    so_far = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    unlike = F.when(F.col("kind") == "text", F.col("links") + F.col("beside").cast("int")).otherwise(0)
    numbers = rows.where(F.col("kind").isin("open", "close", "text")).select("doc", "seq", "kind", "element", "parent", "depth", "tag", value.alias("value"), unlike.alias("unlike"))
    summed = numbers.withColumn("sum", F.sum("value").over(so_far)).withColumn("unlike", F.sum("unlike").over(so_far))
    opens, closes = F.col("kind") == "open", F.col("kind") == "close"
    elements = summed.where(opens | closes).groupBy("doc", "element").agg(
        F.min("seq").alias("begin"), F.max("seq").alias("end"), F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.first("tag").alias("tag"),
        (F.max(F.when(closes, F.col("sum"))) - F.max(F.when(opens, F.col("sum")))).alias("gain"),
        (F.max("unlike") == F.min("unlike")).alias("linkless"))
    best = elements.groupBy("doc").agg(F.max_by(F.struct("element", "parent", "gain"), F.struct("gain", "depth", -F.col("element"))).alias("best")).where(F.col("best.gain") >= least)
    kept = elements.join(best, "doc").where((F.col("element") == F.col("best.element")) | ((F.col("parent") == F.col("best.parent")) & ((F.col("gain") >= F.col("best.gain") * SIBLING) | (F.col("linkless") & F.col("tag").rlike(PLAIN)))))
    kept = kept.select("doc", "begin", "end")  # apart from each other
    runs = rows.where("kind = 'text' and not beside").select("doc", "seq", "tag", "text").join(kept, "doc").where(F.col("seq").between(F.col("begin"), F.col("end")))

    text = runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("seq", "tag", "text"))).alias("all"))

    def tagged(x):
        tag = F.when(x["tag"].rlike("^(?:h[1-6]|li|pre|blockquote|td|th|dt|dd|figcaption)$"), x["tag"]).otherwise("p")
        safe = F.replace(F.replace(F.replace(x["text"], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        return F.concat(F.lit("<"), tag, F.lit(">"), safe, F.lit("</"), tag, F.lit(">"))

    text = text.select("doc", F.array_join(F.transform("all", tagged), "").alias("content"), F.array_join(F.transform("all", lambda x: x["text"]), "\n\n").alias("text"),
                       F.try_element_at(F.transform(F.filter("all", lambda x: ~x["tag"].rlike("^h[1-6]$")), lambda x: x["text"]), F.lit(1)).alias("first"))

    def fact(*names):
        return F.coalesce(*(F.min_by(F.when(F.col("tag") == n, F.col("text")), F.when(F.col("tag") == n, F.col("seq"))) for n in names))

    whole_title = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("tag") == "title", F.struct("seq", "text")))), lambda x: x["text"]), " ")
    facts = rows.where("kind = 'fact'").groupBy("doc").agg(
        fact("og:title").alias("og"), whole_title.alias("named"), fact("author", "article:author", "byline").alias("byline"), fact("og:site_name").alias("site"),
        fact("lang").alias("lang"), fact("description", "og:description").alias("about"))
    head = rows.where("kind = 'text' and tag = 'h1'").groupBy("doc").agg(F.min_by("text", "seq").alias("h1"))
    # a title that ends in the site's name loses it, if words enough are left
    cut = F.regexp_extract("named", r"^(.*\S)\s+[|–—»-]\s+[^|–—»-]*$", 1)
    title = F.coalesce("og", F.when(F.size(F.split(cut, " ")) > 3, cut), F.when(F.col("named") != "", F.col("named")), "h1", F.lit("Untitled"))
    whole = rows.where("kind = 'page'").select("doc", "page")
    found = text.select("doc", F.col("content").alias("_content"), F.col("text").alias("_text"), "first")
    out = whole.join(found, "doc", "left").join(facts, "doc", "left").join(head, "doc", "left")
    empty = F.lit("")
    return out.select(
        *(F.col(f"page.c{k}").alias(c) for k, c in enumerate(c for c in pages.columns if c != html_col)), title.alias("title"), F.coalesce("byline", empty).alias("byline"), F.coalesce("site", empty).alias("site_name"), "lang",
        F.coalesce("about", "first", empty).alias("excerpt"), F.coalesce("_content", empty).alias("content"), F.coalesce("_text", empty).alias("text"),
        F.coalesce(F.length("_text"), F.lit(0)).alias("length"), F.col("_text").isNotNull().alias("is_article"))
