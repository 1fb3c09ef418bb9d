"""Text functions as column expressions. Offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lexicons, patterns and messages whose results must be equal to those expected by users of the data.
POSITIVE = "good great excellent amazing wonderful love happy success".split()
NEGATIVE = "bad terrible awful hate sad fail problem issue".split()
TRANSIENT = ("timeout", "network", "econnrefused", "econnreset", "socket hang up", "503", "502", "504", "429", "temporarily unavailable")
PAYWALL = ("quota", "credits", "billing", "rate limit exceeded", "insufficient funds")
INVALID = ("invalid", "malformed", "not found", "does not exist", "parse error", "syntax error")
FICTION_SUBJECTS = "fiction|novel|science fiction|fantasy|mystery|thriller|romance|adventure"
FICTION_TITLES = "dream|darkness|sheep|dune|foundation|dragons|chronicles"
FICTION_AUTHORS = r"le guin|ursula|dick|philip k\.|asimov|bradbury|butler|octavia|heinlein|clarke|herbert"
FICTION_PUBLISHERS = ("tor", "orbit", "daw", "ballantine", "del rey")
TECHNICAL_PUBLISHERS = ("o'reilly", "oreilly", "packt", "manning", "apress", "no starch", "pragmatic")
TECHNICAL_SUBJECTS = ("programming", "software", "computer", "technology", "coding", "development")
ACADEMIC_SUBJECTS = ("textbook", "academic", "education", "research")
ACADEMIC_PUBLISHERS = ("university press", "oxford", "cambridge", "springer", "wiley", "pearson")
CLOZE = r"\{\{c(\d+)::([^:}]+)(?:::([^}]+))?\}\}"
VIDEO_ID = r"(?:youtube\.com/watch\?v=|youtu\.be/|youtube\.com/shorts/|youtube\.com/embed/)([a-zA-Z0-9_-]{11})"
ELEMENTS = {
    "headings": r"(?m)^#{1,6}\s",
    "lists": r"(?m)^[\s]*[-*+•]\s",
    "numbered_lists": r"(?m)^\d+\.\s",
    "tables": r"\|.*\|.*\|",
    "code_blocks": r"```[\s\S]*?```",
    "block_quotes": r"(?m)^>\s",
    "links": r"\[.*?\]\(.*?\)",
    "images": r"!\[.*?\]\(.*?\)",
    "bold": r"\*\*.*?\*\*",
    "italic": r"\*[^*]+?\*",
}

STAMP, STAMPED_WORD, SPEAKER_MARK, SOME_STAMPS, MANY_STAMPS = r"\[?\d{1,2}:\d{2}(?::\d{2})?\]?", r"\[\d{1,2}:\d{2}\]\s+\w+", "[[", 5, 20
MARKDOWN_SIGNS = ((r"(?m)^#{1,6}\s+",), (r"(?m)^[*+-]\s+", r"(?m)^\d+\.\s+"), (r"\*\*.+\*\*", "__.+__"), (r"\[.+\]\(.+\)",))
CODE_SIGNS = ((r"```[\s\S]*```", r"(?m)^    "), (r"function\s+\w+|class\s+\w+|const\s+\w+|import\s+",), (r"[{}\[\]()<>]",))
CODE_LANGUAGES = (
    ("javascript", r"(?m)import\s+.*from\s+['\"]|export\s+"),
    ("python", r"(?m)def\s+\w+|import\s+\w+|from\s+\w+\s+import"),
    ("go", r"package\s+\w+|func\s+\w+|import\s+\""),
    ("rust", r"fn\s+\w+|impl\s+\w+|use\s+\w+"),
    ("java", r"class\s+\w+.*\{|interface\s+\w+"),
)
DIRT = (r"\n{4,}", r"\n\n\d{1,4}\n\n", r"@page\s*\{|margin.*:\s*\d+pt|\.pt\s*;", r"(?m)\*\*[A-Z]{20,}\*\*|^[A-Z]{20,}$")
SHORT_LINE, SHORT_SHARE = 40, 0.3
TIDY = (("[“”]", '"'), ("[‘’]", "'"), ("–", "-"), ("—", "--"), ("…", "..."), (r"\n{3,}", "\n\n"), (" {2,}", " "), (r"(?m)^[ \t]+|[ \t]+$", ""))
UNSAFE_HTML = (
    (r"(?is)<script\b.*?</script>", ""),
    (r"""(?i)\s*on\w+\s*=\s*["'][^"']*["']""", ""),
    (r"(?i)\s*on\w+\s*=\s*[^\s>]*", ""),
    (r"""(?i)href\s*=\s*["']javascript:[^"']*["']""", 'href="#"'),
    (r"""(?i)src\s*=\s*["']data:[^"']*["']""", 'src=""'),
)

_SPACE = r"[ \t\n\r\f\x0B]+"


def _any(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def words(text: Column) -> Column:
    """Non-empty runs between white space."""
    return F.filter(F.split(text, _SPACE), lambda x: F.length(x) > 0)


def word_count(text: Column) -> Column:
    return F.size(words(text))


def context_words(text: Column, start: Column, end: Column, n: int = 5) -> tuple[Column, Column]:
    """The n words before start and after end."""
    before = words(F.substring(text, F.lit(1), start))
    after = words(F.substring(text, end + 1, F.length(text)))
    size = F.size(before)
    return F.array_join(F.slice(before, F.greatest(size - n + 1, F.lit(1)), n), " "), F.array_join(F.slice(after, 1, n), " ")


def regex_metadata(df, text: str):
    """df with summary, themes, importance, polarity, primary_emotion and intensity of a text column, from patterns alone.

    What several of them need is computed once, in a step of its own: arrays and counts, not the text's patterns again.
    """
    t = F.col(text)
    hits = lambda lexicon: F.regexp_count(t, F.lit(rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(lexicon)})(?![A-Za-z0-9_])"))
    capital = F.regexp_extract_all(t, F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?![A-Za-z0-9_])"), F.lit(0))
    once = df.withColumns({"_first": F.regexp_extract(t, r"^[^.!?]+[.!?]", 0), "_names": F.slice(F.array_distinct(capital), 1, 5), "_score": (hits(POSITIVE) - hits(NEGATIVE)) / 10, "_words": F.size(F.split(t, _SPACE))})
    first, polarity = F.col("_first"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_score")))
    return once.withColumns({
        "summary": F.substring(F.when(first != "", first).otherwise(t), 1, 200),
        "themes": F.when(F.size("_names") > 0, F.transform("_names", F.lower)).otherwise(F.array(F.lit("general"))),
        "importance": F.least(F.lit(1.0), F.col("_words") / 500),
        "polarity": polarity,
        "primary_emotion": F.when(polarity > 0, "positive").when(polarity < 0, "negative").otherwise("neutral"),
        "intensity": F.abs(polarity),
    }).drop("_first", "_names", "_score", "_words")


def share_of(text: Column, signs) -> Column:
    """The share of the kinds of signs of which a text shows one."""
    seen = [F.exists(F.array(*map(F.lit, kind)), lambda p: F.regexp_like(text, p)).cast("int") for kind in signs]
    return sum(seen[1:], seen[0]) / len(signs)


def paste_format(text: Column) -> Column:
    """struct(format, confidence, language): transcript, markdown, code or plain_text, by shares of tell-tale patterns; code may have a language."""
    stamps = F.regexp_count(text, F.lit(STAMP))
    transcript = (stamps > SOME_STAMPS) & (text.contains(SPEAKER_MARK) | (stamps > MANY_STAMPS) | text.rlike(STAMPED_WORD))
    md, code = share_of(text, MARKDOWN_SIGNS), share_of(text, CODE_SIGNS)
    language = F.coalesce(*[F.when(text.rlike(p), n) for n, p in CODE_LANGUAGES])
    made = lambda f, c, of=F.lit(None): F.struct(F.lit(f).alias("format"), c.cast("double").alias("confidence"), of.cast("string").alias("language"))
    return F.when(transcript, made("transcript", F.lit(0.9))).when(md >= 0.5, made("markdown", md)).when(code >= 0.5, made("code", code, F.when(code > 0.5, language))).otherwise(made("plain_text", F.lit(0.5)))


def error_class(message: Column) -> Column:
    m = F.lower(message)
    return F.when(_any(m, TRANSIENT), "transient").when(_any(m, PAYWALL), "paywall").when(_any(m, INVALID), "invalid").otherwise("permanent")


def document_type(subjects: Column, publisher: Column, title: Column, author: Column) -> Column:
    s, p, t, a = (F.lower(F.coalesce(x, F.lit(""))) for x in (subjects, publisher, title, author))
    fiction = s.rlike(FICTION_SUBJECTS) | t.rlike(rf"\b({FICTION_TITLES})\b") | a.rlike(FICTION_AUTHORS) | _any(p, FICTION_PUBLISHERS)
    technical = _any(p, TECHNICAL_PUBLISHERS) | _any(s, TECHNICAL_SUBJECTS) | _any(t, ("programming", "developer"))
    academic = _any(s, ACADEMIC_SUBJECTS) | s.rlike(r"\b(science|mathematics|physics|chemistry|biology)\b") | _any(p, ACADEMIC_PUBLISHERS)
    return F.when(fiction, "fiction").when(technical, "technical_manual").when(academic, "academic_paper").otherwise("fiction")


def slug(text: Column, most: int = 50) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), r"^-+|-+\z", ""), 1, most)


def tags(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)#([a-z0-9_-]+)"), F.lit(1)), F.lower)


def chunk_mentions(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("/chunk[_-]([a-zA-Z0-9_-]+)"), F.lit(1)), lambda x: F.concat(F.lit("chunk_"), x))


def cloze_deletions(text: Column) -> Column:
    """array of struct(index, text, hint): the first of each index, by index."""
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(CLOZE), F.lit(k)).alias(n) for k, n in ((1, "i"), (2, "t"), (3, "h"))])
    rows = F.transform(found, lambda x: F.struct(x["i"].cast("int").alias("index"), x["t"].alias("text"), F.nullif(x["h"], F.lit("")).alias("hint")))
    first = F.filter(rows, lambda x, k: ~F.exists(F.slice(rows, 1, k), lambda y: y["index"] == x["index"]))
    return F.array_sort(first, lambda a, b: a["index"] - b["index"])


def cloze_question(text: Column, index: Column) -> Column:
    """The target is hidden ([...] or its hint), other deletions show their text."""
    i = index.cast("string")
    hinted = F.regexp_replace(text, F.concat(F.lit(r"\{\{c"), i, F.lit(r"::[^:}]+::([^}]+)\}\}")), F.lit("[...$1]"))
    bare = F.regexp_replace(hinted, F.concat(F.lit(r"\{\{c"), i, F.lit(r"::[^:}]+\}\}")), F.lit("[...]"))
    return F.regexp_replace(bare, CLOZE, "$2")


def cloze_is_sequential(text: Column) -> Column:
    d = F.transform(cloze_deletions(text), lambda x: x["index"])
    return (F.size(d) > 0) & (d == F.sequence(F.lit(1), F.greatest(F.size(d), F.lit(1))))


def video_id(url: Column) -> Column:
    first = F.regexp_extract(url, VIDEO_ID, 1)
    return F.nullif(F.when(first != "", first).otherwise(F.regexp_extract(url, r"youtube\.com/.*[?&]v=([a-zA-Z0-9_-]{11})", 1)), F.lit(""))


def valid_url(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https") & (F.length(F.try_parse_url(url, F.lit("HOST"))) > 0), F.lit(False))


def element_counts(text: Column) -> dict[str, Column]:
    out = {k: F.regexp_count(text, F.lit(p)) for k, p in ELEMENTS.items()}
    out["paragraphs"] = F.size(F.filter(F.split(text, r"\n\n+"), lambda x: F.length(F.regexp_replace(x, r"\s", "")) > 0))
    return out


def needs_cleaning(text: Column) -> Column:
    """Any of the signs of a page's leftovers, or too many short lines."""
    sizes = F.transform(F.split(text, "\n"), F.length)
    short = F.size(F.filter(sizes, lambda n: n.between(1, SHORT_LINE - 1))) / F.size(sizes)
    dirty = short > SHORT_SHARE
    for sign in DIRT:
        dirty = dirty | text.rlike(sign)
    return dirty


def rewritten(text: Column, rules) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def tidy(text: Column) -> Column:
    """Plain quotes, dashes and ellipses; at most two line ends and one space in a row; lines trimmed of spaces and tabs."""
    return rewritten(text, TIDY)


def sanitize_html(html: Column) -> Column:
    """Without script elements, inline handlers, javascript: links and data: sources."""
    return rewritten(html, UNSAFE_HTML)


def html_text(html: Column) -> Column:
    h = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    h = F.regexp_replace(F.regexp_replace(h, r"<[^>]*>", " "), "&nbsp;", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        h = F.replace(h, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(h, r"\s+", " "))


def split_point(text: Column) -> Column:
    """Where a text is best cut past its middle: paragraph, line, sentence, period before three quarters; else the middle."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    out = []
    for mark, add in (("\n\n", 2), ("\n", 1), (". ", 2), (".", 1)):
        at = F.call_function("locate", F.lit(mark), text, half + 1) - 1
        out.append(F.when((at >= 0) & (at < n * 0.75), at + add))
    return F.coalesce(*out, half)


def timestamp_link(seconds: Column, url: Column, text: Column) -> Column:
    """[[MM:SS](url&t=Ns)] text, with hours where there are any."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    stamp = F.when(h > 0, F.concat_ws(":", two(h), two(m), two(s % 60))).otherwise(F.concat_ws(":", two(m), two(s % 60)))
    base = F.when(url.contains("?"), url).otherwise(F.concat(url, F.lit("?v=placeholder")))
    return F.concat(F.lit("[["), stamp, F.lit("]("), base, F.lit("&t="), s.cast("string"), F.lit("s)] "), text)


def stamp_seconds(text: Column) -> Column:
    """The seconds of each [h:m:s] or [m:s] in a text."""
    def one(x):
        p = F.transform(F.split(F.regexp_replace(x, r"[\[\]]", ""), ":"), lambda y: y.cast("int"))
        return F.aggregate(p, F.lit(0), lambda a, y: a * 60 + y)

    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\d{1,2}:\d{2}(?::\d{2})?\]"), F.lit(0)), one)


def render_template(template: Column, values: Column) -> Column:
    """{{name}} replaced by the map's values; unknown names stay."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))


def template_variables(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{\{(\w+)\}\}"), F.lit(1)))


def metadata_context(headings: Column, page_start: Column, page_end: Column, section: Column) -> Column:
    """Heading path, pages or section, joined by bars."""
    h = F.when(F.size(headings) > 0, F.array_join(headings, " > "))
    pages = F.when(page_end.isNotNull() & (page_end != 0) & (page_end != page_start), F.concat(F.lit("Pages "), page_start, F.lit("-"), page_end)).otherwise(F.concat(F.lit("Page "), page_start))
    s = F.when(F.coalesce(page_start, F.lit(0)) == 0, F.replace(section, F.lit("_"), F.lit(" ")))
    return F.concat_ws(" | ", h, F.when(page_start.isNotNull(), pages), s)


def strip_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*\z", ""))


def year_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?<!\d)((?:1[5-9]|20)\d{2})(?!\d)", 1), F.lit("")).cast("int")


def front_matter(text: Column, key: str) -> Column:
    """A key's value in a leading --- block; null where there is none."""
    block = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---", 1)
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*(.*)$", 1)), F.lit(""))


def page_estimate(offset: Column, n_words: Column, pages: Column) -> Column:
    """Page of an offset by its share of five characters a word, from 1 to pages."""
    p = F.ceil(F.try_divide(offset.cast("double"), n_words * 5.0) * pages)
    return F.greatest(F.lit(1), F.least(pages, p)).cast("int")


def emotional_similarity(p1: Column, i1: Column, p2: Column, i2: Column) -> Column:
    return 1 - (F.abs(p1 - p2) / 2 + F.abs(i1 - i2)) / 2
