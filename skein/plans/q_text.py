"""Queries over texts, pages and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as C
from ..operators import layout as L
from ..operators import matching as M
from ..operators import scheduling, table_functions
from ..operators import text as T
from ..operators.articles import extract_articles
from ..operators.seek import seek
from ..operators.semantic_chunks import semantic_chunks
from ..operators.similarity import line_distances, trigram_counts
from ..operators.structure import similar_structures
from ..operators.text_index import TextIndex
from ..sources.storage import scratch
from ..streaming import jobs as S
from . import fixtures
from .registry import query

_CAP = r"regexp_extract_all(text, '\b[A-Z][a-z]+\b')"


@query("enr1_regex_metadata", rf"""WITH c AS (SELECT doc_id, text, {_CAP} AS w FROM documents), u AS (SELECT doc_id, text, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM c),
  p AS (SELECT *, greatest(-1.0, least(1.0, (len(regexp_extract_all(text, '(?i)\b(good|great|excellent|amazing|wonderful|love|happy|success)\b')) - len(regexp_extract_all(text, '(?i)\b(bad|terrible|awful|hate|sad|fail|problem|issue)\b'))) / 10.0)) AS polarity FROM u)
  SELECT doc_id, substr(CASE WHEN regexp_extract(text, '^[^.!?]+[.!?]') <> '' THEN regexp_extract(text, '^[^.!?]+[.!?]') ELSE text END, 1, 200) AS summary, CASE WHEN len(w) > 0 THEN lower(array_to_string(w[1:5], ',')) ELSE 'general' END AS themes,
    least(1.0, len(string_split_regex(text, '[ \t\n\r\f\x0B]+')) / 500.0)::DOUBLE AS importance, polarity::DOUBLE AS polarity, CASE WHEN polarity > 0 THEN 'positive' WHEN polarity < 0 THEN 'negative' ELSE 'neutral' END AS primary_emotion FROM p""")
def enr1(t):
    m = X.regex_metadata(t.documents.select("doc_id", "text"), "text")
    return m.select("doc_id", "summary", F.array_join("themes", ",").alias("themes"), F.col("importance").cast("double").alias("importance"), F.col("polarity").cast("double").alias("polarity"), "primary_emotion")


@query("enr2_fallback_chain", "SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN lang END, CASE WHEN doc_id % 3 = 1 THEN source END, 'general') AS domain, list_filter(['no text', 'no source', 'too short'], lambda x, i: [text IS NULL, source IS NULL, n_chars < 100][i]) AS errors FROM documents")
def enr2(t):
    """The first model that answers wins; what is wrong with a record is an array of messages."""
    errors = F.filter(F.array(F.when(F.col("text").isNull(), "no text"), F.when(F.col("source").isNull(), "no source"), F.when(F.col("n_chars") < 100, "too short")), lambda x: x.isNotNull())
    m = F.col("doc_id") % 3
    return t.documents.select("doc_id", F.coalesce(F.when(m == 0, F.col("lang")), F.when(m == 1, F.col("source")), F.lit("general")).alias("domain"), errors.alias("errors"))


@query("src6_paste_format", r"""WITH t AS (SELECT conv_id, string_agg('[' || lpad(turn::VARCHAR, 2, '0') || ':00] ' || text || CASE WHEN conv_id % 3 = 0 THEN chr(10) || '# head' || chr(10) || '- item **b**' WHEN conv_id % 3 = 1 THEN chr(10) || (CASE conv_id % 5 WHEN 0 THEN 'import x from "y" {}' WHEN 1 THEN 'import x {}' WHEN 2 THEN 'import "x" {}' WHEN 3 THEN 'const x {} fn main' ELSE 'class A {' END) ELSE '' END, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
  s AS (SELECT conv_id, text, len(regexp_extract_all(text, '\[?\d{1,2}:\d{2}(?::\d{2})?\]?')) AS n,
    (regexp_matches(text, '(?m)^#{1,6}\s+')::INT + (regexp_matches(text, '(?m)^[*+-]\s+') OR regexp_matches(text, '(?m)^\d+\.\s+'))::INT + (regexp_matches(text, '\*\*.+\*\*') OR regexp_matches(text, '__.+__'))::INT + regexp_matches(text, '\[.+\]\(.+\)')::INT) / 4.0::DOUBLE AS md,
    ((regexp_matches(text, '(?s)```.*```') OR regexp_matches(text, '(?m)^    '))::INT + regexp_matches(text, 'function\s+\w+|class\s+\w+|const\s+\w+|import\s+')::INT + regexp_matches(text, '[{}\[\]()<>]')::INT) / 3.0::DOUBLE AS code FROM t)
  SELECT conv_id, CASE WHEN n > 5 AND (contains(text, '[[') OR n > 20 OR regexp_matches(text, '\[\d{1,2}:\d{2}\]\s+\w+')) THEN 'transcript' WHEN md >= 0.5 THEN 'markdown' WHEN code >= 0.5 THEN 'code' ELSE 'plain_text' END AS format,
    round(CASE WHEN n > 5 AND (contains(text, '[[') OR n > 20 OR regexp_matches(text, '\[\d{1,2}:\d{2}\]\s+\w+')) THEN 0.9 WHEN md >= 0.5 THEN md WHEN code >= 0.5 THEN code ELSE 0.5 END, 6)::DOUBLE AS confidence,
    CASE WHEN (n > 5 AND (contains(text, '[[') OR n > 20 OR regexp_matches(text, '\[\d{1,2}:\d{2}\]\s+\w+'))) OR md >= 0.5 OR code <= 0.5 THEN NULL WHEN regexp_matches(text, 'import\s+.*from\s+[''"]|export\s+') THEN 'javascript' WHEN regexp_matches(text, 'def\s+\w+|import\s+\w+|from\s+\w+\s+import') THEN 'python'
      WHEN regexp_matches(text, 'package\s+\w+|func\s+\w+|import\s+"') THEN 'go' WHEN regexp_matches(text, 'fn\s+\w+|impl\s+\w+|use\s+\w+') THEN 'rust' WHEN regexp_matches(text, 'class\s+\w+.*\{|interface\s+\w+') THEN 'java' END AS language FROM s""")
def src6(t):
    m = F.col("conv_id") % 3
    code = F.element_at(F.array(*map(F.lit, ('import x from "y" {}', "import x {}", 'import "x" {}', "const x {} fn main", "class A {"))), (F.col("conv_id") % 5 + 1).cast("int"))
    line = F.concat(F.lit("["), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(":00] "), F.col("text"), F.when(m == 0, "\n# head\n- item **b**").when(m == 1, F.concat(F.lit("\n"), code)).otherwise(""))
    d = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return d.select("conv_id", X.paste_format(F.col("text")).alias("p")).select("conv_id", "p.format", F.round("p.confidence", 6).alias("confidence"), "p.language")


def _grams(c):
    return f"list_distinct(list_transform(range(1, greatest(length({c}) - 1, 1)), lambda i: substr(lower({c}), i::INT, 3)))"


@query("str1_trigram_similarity", f"""WITH p AS (SELECT doc_id, text AS a, substr(text, 20) AS b FROM documents), g AS (SELECT doc_id, {_grams('a')} AS a, {_grams('b')} AS b FROM p)
  SELECT doc_id, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) END AS similarity FROM g""")
def str1(t):
    """Each whole text against itself from its 20th character on."""
    d = trigram_counts(t.documents.select("doc_id", F.col("text").alias("a"), F.expr("substring(text, 20)").alias("b")), "a", "b", ["doc_id"])
    shared = F.coalesce(F.try_divide("both", F.col("n_a") + F.col("n_b") - F.col("both")), F.when(F.col("both").isNotNull(), 1.0))
    return d.select("doc_id", F.round(shared, 6).alias("similarity"))


_LINES = r"list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[^ -~]', '?', 'g'))"


@query("str2_levenshtein", f"""WITH l AS (SELECT doc_id, {_LINES} AS l FROM documents), p AS (SELECT doc_id, unnest(range(1, len(l))) AS k, l FROM l), q AS (SELECT doc_id, k::INT AS line, l[k] AS a, l[k + 1] AS b FROM p)
  SELECT doc_id, line, levenshtein(a, b)::INT AS distance, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 6) END AS similarity FROM q""")
def str2(t):
    """Each line of each text against the next one (signs beyond ASCII as one sign, as DuckDB counts bytes)."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "[^ -~]", "?"))
    d = t.documents.select("doc_id", lines.alias("l")).where(F.size("l") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("l") - 1), lambda k: F.struct(k.alias("line"), F.get("l", k - 1).alias("a"), F.get("l", k).alias("b")))
    p = d.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.*")
    p = line_distances(p, "a", "b", ["doc_id", "line"])
    return p.select("doc_id", "line", "distance", F.round(F.when(F.col("n") == 0, 1.0).otherwise(1 - F.col("distance") / F.col("n")), 6).alias("similarity"))


@query("str3_locate_benchmark", "SELECT b.item_id AS needle_id, d.doc_id AS document_id, (instr(d.text, b.text) - 1)::INT AS start FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def str3(t):
    """Exact stage of the fuzzy locator over all texts."""
    j = M.holding(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", F.col("text").alias("needle")))
    return j.select(F.col("item_id").alias("needle_id"), F.col("doc_id").alias("document_id"), (F.expr("instr(text, needle)") - 1).alias("start"))


@query("str3_fuzzy_locate")
def str3f(t):
    """The benchmark's passages with changed ends, each sought in every text; rows for hits. Checked against the plain locator on all pairs in the tests."""
    d = t.documents.select(F.col("doc_id").alias("document_id"), "text")
    return seek(t.benchmark.select(F.col("item_id").alias("needle_id"), F.concat("text", F.lit(" changed")).alias("needle")), d)


@query("str5_offset_matcher")
def str5(t):
    """Chunks with squeezed white space get their offsets back, a document at a time."""
    d = t.documents
    c = fixtures.doc_chunks(t).select("document_id", "chunk_index", F.trim(F.regexp_replace("content", r"\s+", " ")).alias("content"))
    return M.match_documents(c, d.select(F.col("doc_id").alias("document_id"), "text"))


@query("str7_stitching")
def str7(t):
    """Overlapping parts put together again: the text they came from, but where it repeats itself (the longest overlap wins)."""
    w = t.documents.where("text is not null").select(F.col("doc_id").alias("document_id"), "text", F.explode(F.expr("sequence(0, greatest(0, length(text) - 101), 400)")).alias("s"))
    parts = w.select("document_id", F.floor(F.col("s") / 400).cast("int").alias("chunk_index"), F.expr("substring(text, s + 1, 500)").alias("content"))
    return M.stitch_documents(parts, share=1.0).select("document_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_PAGED = "regexp_replace(text, '((?:[^ \\t\\n\\x0B\\f\\r]+[ \\t\\n\\x0B\\f\\r]+){59}[^ \\t\\n\\x0B\\f\\r]+)[ \\t\\n\\x0B\\f\\r]+', E'\\\\1\\n\\n212 Jane Writer\\n\\n', 'g')"


@query("str8_page_cleanup", rf"""WITH d AS (SELECT doc_id, {_PAGED} AS text FROM documents),
  t AS (SELECT doc_id, length(text) AS given, regexp_replace(regexp_replace(regexp_replace(text, '[\x01-\x04]|{L.STYLE}', '', 'g'), '[ \t]+\n', chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g') AS text FROM d),
  b AS (SELECT doc_id, given, list_filter(string_split_regex(trim(text, {_SPACE}), '\n[ \t\n\x0B\f\r]*\n'), lambda b: NOT regexp_matches(b, '^\**[A-Z]{{{L.GLYPHS},}}\**$')) AS b FROM t),
  m AS (SELECT doc_id, given, array_to_string(list_transform(b, lambda b: CASE WHEN regexp_matches(b, '{L.LOCATOR}') THEN chr(2) || b || chr(3)
    WHEN length(b) <= {L.LABEL_CHARS} AND regexp_matches(b, '{L.LABEL.replace("'", "''")}') AND NOT regexp_matches(b, '{L.CONNECTS}') AND NOT regexp_matches(b, '[.!?]$')
    THEN chr(1) || CASE WHEN regexp_matches(b, '{L.CAPITALS}') THEN chr(4) ELSE '' END || b || chr(3) ELSE b END), E'\n\n') AS t FROM b),
  r AS (SELECT doc_id, given, regexp_replace(regexp_replace(t, '{L.BROKEN}', '\1 \2', 'g'), '{L.BROKEN}', '\1 \2', 'g') AS t FROM m)
  SELECT doc_id, given, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, given, trim(replace(regexp_replace(regexp_replace(t, '{L.BESIDE}', E'\n\n', 'g'), '{L.MARKS}', '', 'g'), chr(4), '## '), {_SPACE}) AS t FROM r)""")
def str8(t):
    """Every sixty words a page ends: its running head goes where a sentence goes on behind it."""
    white = r"[ \t\n\x0B\f\r]"
    d = t.documents.select("doc_id", F.regexp_replace("text", rf"((?:[^ \t\n\x0B\f\r]+{white}+){{59}}[^ \t\n\x0B\f\r]+){white}+", "$1\n\n212 Jane Writer\n\n").alias("text"))
    d = d.select("doc_id", F.length("text").alias("given"), L.clean_pages(F.col("text")).alias("text"))
    return d.select("doc_id", "given", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


_SITE = r"^(.*\S)\s+[|–—»-]\s+[^|–—»-]*$"


@query("src4_articles", rf"""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS a, regexp_extract(html, '<title>([^<]*)', 1) AS t, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang FROM pages),
  r AS (SELECT *, list_filter(list_transform(string_split_regex(a, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&(?:lt|gt|quot|#x27|#39);', '*', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS runs FROM a),
  g AS (SELECT *, list_sum(list_transform(runs, lambda x: length(x))) - 25 * (len(runs) - 1) >= 140 AS is_article FROM r)
  SELECT page_id, lang, regexp_replace(regexp_replace(CASE WHEN len(string_split(regexp_extract(t, '{_SITE}', 1), ' ')) > 3 THEN regexp_extract(t, '{_SITE}', 1) ELSE t END, '&[a-z]+;?', '', 'g'), '[^A-Za-z0-9]', '', 'g') AS title,
    md5(CASE WHEN is_article THEN regexp_replace(array_to_string(runs, ''), '[^A-Za-z0-9]', '', 'g') ELSE '' END) AS letters, is_article FROM g""")
def src4_articles(t):
    """Title, language and the article's ASCII letters of each page, by the subtree of most text."""
    out = extract_articles(t.pages.select("page_id", "html"), scratch(t.spark, "articles"))
    letters = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "")
    return out.select("page_id", "lang", letters("title").alias("title"), F.md5(letters("text").cast("binary")).alias("letters"), "is_article")


@query("str9_epub_cleanup")
def str9(t):
    """Documents as books: a cover, a table of contents, the publisher's page and note, file names and inner links around their text."""
    front = "Cover\n\n# Contents\n\n[One](ch1.xhtml)\n[Two](ch2.xhtml)\n[Three](ch3.xhtml)\n\n# ch_01-a.xhtml\n\nISBN 1, all rights reserved.\n\n# Chapter 1\n\n"
    back = "\n\n# Publisher's Note\n\nsaid here [back](ch1.xhtml#a)"
    d = t.documents.select("doc_id", L.clean_book(F.concat(F.lit(front), F.col("text"), F.lit(back))).alias("text"))
    return d.select("doc_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("str10_sanitize_html", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?i)\s*on\w+\s*=\s*["''][^"'']*["'']', '', 'g'), '(?i)\s*on\w+\s*=\s*[^\s>]*', '', 'g'),
  '(?i)href\s*=\s*["'']javascript:[^"'']*["'']', 'href="#"', 'g'), '(?i)src\s*=\s*["'']data:[^"'']*["'']', 'src=""', 'g') AS html FROM pages""")
def str10(t):
    return t.pages.select("page_id", X.sanitize_html(F.col("html")).alias("html"))


@query("src4_html_text", r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' ', 'g') AS h FROM pages),
  b AS (SELECT page_id, replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS h FROM a) SELECT page_id, trim(regexp_replace(h, '\s+', ' ', 'g')) AS text FROM b""")
def src4(t):
    return t.pages.select("page_id", X.html_text(F.col("html")).alias("text"))


@query("str11_html_to_markdown")
def str11(t):
    return T.map_text(t.pages.select("page_id", "html"), "html_to_markdown", "html", "markdown").select("page_id", "markdown")


@query("str12_urls", r"SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_matches(url, '^https?://[^/?#]+') AS valid FROM pages")
def str12(t):
    return t.pages.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), X.valid_url(F.col("url")).alias("valid"))


@query("str12_video_id", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN lpad(page_id::VARCHAR, 11, 'a') END AS video FROM pages")
def video(t):
    i = F.lpad(F.col("page_id").cast("string"), 11, "a")
    u = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://youtu.be/"), i)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://www.youtube.com/watch?x=1&v="), i)).otherwise(F.lit("https://example.com/watch"))
    return t.pages.select("page_id", X.video_id(u).alias("video"))


@query("str13_tags", "SELECT doc_id, lang || ',' || source || ',' || lang AS tags, ['chunk_' || doc_id] AS mentions FROM documents")
def str13(t):
    s = F.concat(F.lit("see #"), F.upper("lang"), F.lit(" and #"), F.col("source"), F.lit(" #"), F.col("lang"), F.lit(" in /chunk_"), F.col("doc_id"))
    return t.documents.select("doc_id", F.array_join(X.tags(s), ",").alias("tags"), X.chunk_mentions(s).alias("mentions"))


@query("str14_cloze", "SELECT doc_id, 'The [...country] and ' || lang || ' is ' || doc_id AS question, 2 AS deletions, true AS sequential FROM documents")
def str14(t):
    s = F.concat(F.lit("The {{c1::"), F.col("source"), F.lit("::country}} and {{c2::"), F.col("lang"), F.lit("}} is {{c1::"), F.col("doc_id"), F.lit("}}"))
    d = X.cloze_deletions(s)
    q = X.cloze_question(F.regexp_replace(s, r"\{\{c1::(\d+)\}\}", "$1"), F.lit(1))
    return t.documents.select("doc_id", q.alias("question"), F.size(d).alias("deletions"), X.cloze_is_sequential(s).alias("sequential"))


@query("tg6_cloze_cards", "SELECT doc_id, i AS index, CASE i WHEN 1 THEN source ELSE lang END AS answer FROM documents, (SELECT unnest([1, 2])::INT AS i)")
def tg6(t):
    s = F.concat(F.lit("{{c2::"), F.col("lang"), F.lit("}} {{c1::"), F.col("source"), F.lit("}}"))
    return t.documents.select("doc_id", F.explode(X.cloze_deletions(s)).alias("c")).select("doc_id", F.col("c.index").alias("index"), F.col("c.text").alias("answer"))


@query("str15_slug", "SELECT doc_id, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 50) AS slug FROM documents")
def str15(t):
    return t.documents.select("doc_id", X.slug(F.col("text")).alias("slug"))


@query("str16_templates", "SELECT doc_id, 'In ' || lang || ' from ' || source || ': {{missing}}' AS text, 'lang,source,missing' AS variables FROM documents")
def str16(t):
    tpl = F.lit("In {{lang}} from {{source}}: {{missing}}")
    return t.documents.select("doc_id", X.render_template(tpl, F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")).alias("text"), F.array_join(X.template_variables(tpl), ",").alias("variables"))


@query("str17_metadata_context", "SELECT document_id, anchor_index, heading || ' > ' || section_marker || ' | Pages ' || page_start || '-' || page_end AS context FROM anchors", "anchors")
def str17(t):
    a = fixtures.anchors(t)
    return a.select("document_id", "anchor_index", X.metadata_context(F.array("heading", "section_marker"), F.col("page_start"), F.col("page_end"), F.col("section_marker")).alias("context"))


_WORDS = r"list_filter(string_split_regex({}, '[ \t\n\r\f\x0B]+'), lambda x: length(x) > 0)"


@query("str18_word_counts", f"SELECT doc_id, len({_WORDS.format('text')})::INT AS words, array_to_string({_WORDS.format('substr(text, 1, 100)')}[-5:], ' ') AS before, array_to_string({_WORDS.format('substr(text, 201)')}[1:5], ' ') AS after FROM documents")
def str18(t):
    b, a = X.context_words(F.col("text"), F.lit(100), F.lit(200))
    return t.documents.select("doc_id", X.word_count(F.col("text")).alias("words"), b.alias("before"), a.alias("after"))


@query("str19_split_point", """WITH d AS (SELECT doc_id, text, length(text) AS n, length(text) // 2 AS h FROM documents), p AS (SELECT *, instr(substr(text, h + 1), chr(10)) AS l, instr(substr(text, h + 1), '. ') AS s, instr(substr(text, h + 1), '.') AS f, instr(substr(text, h + 1), chr(10) || chr(10)) AS p FROM d)
  SELECT doc_id, (CASE WHEN p > 0 AND h + p - 1 < n * 0.75 THEN h + p + 1 WHEN l > 0 AND h + l - 1 < n * 0.75 THEN h + l WHEN s > 0 AND h + s - 1 < n * 0.75 THEN h + s + 1 WHEN f > 0 AND h + f - 1 < n * 0.75 THEN h + f ELSE h END)::INT AS cut FROM p""")
def str19(t):
    return t.documents.select("doc_id", X.split_point(F.col("text")).cast("int").alias("cut"))


@query("str20_error_classes", "SELECT job_id, CASE last_error WHEN 'network timeout' THEN 'transient' ELSE 'permanent' END AS kind FROM jobs", "jobs")
def str20(t):
    return fixtures.jobs(t).select("job_id", X.error_class(F.col("last_error")).alias("kind"))


@query("str21_document_types", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'fiction' WHEN 1 THEN 'technical_manual' WHEN 2 THEN 'academic_paper' ELSE 'fiction' END AS kind FROM documents")
def str21(t):
    m = F.col("doc_id") % 4
    subject = F.when(m == 0, "Science Fiction").when(m == 1, "Programming").when(m == 2, "Education")
    return t.documents.select("doc_id", X.document_type(subject, F.lit(None), F.concat(F.lit("Doc "), "doc_id"), F.col("source")).alias("kind"))


@query("str22_fingerprints")
def str22(t):
    """Structural fingerprints of conversations as markdown."""
    import pandas as pd

    def run(batches):
        for b in batches:
            f = [C.fingerprint(x) for x in b["text"]]
            yield pd.DataFrame({"conv_id": b["conv_id"], "sequence": ["-".join(x["sequence"]) for x in f], "depth": [x["depth"] for x in f], "complexity": [x["complexity"] for x in f], "hash": [x["hash"] for x in f]})

    return conversations_markdown(t).mapInPandas(run, "conv_id long, sequence string, depth int, complexity double, hash string")


@query("str22_similar_structures")
def str22_similar(t):
    """Pairs of structures of a similarity of 0.9 or more among the conversations, each structure by its smallest conversation; compared with all pairs in the tests."""
    f = str22(t).select(F.col("conv_id").alias("id"), F.filter(F.split("sequence", "-"), lambda x: x != "").alias("sequence"), "depth", "complexity")
    return similar_structures(f, 0.9)[0].select("a", "b", F.round("similarity", 9).alias("similarity"))


def conversations_markdown(t):
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), F.col("text")).alias("s"))))
    body = F.array_join(F.transform(rows, lambda x: x["s"]), "\n\n")
    return t.conversations.groupBy("conv_id").agg(F.concat(F.lit("# conv "), F.first("conv_id").cast("string"), F.lit("\n\n"), body).alias("text"))


@query("str23_transcript_links", """SELECT conv_id, turn, '[[' || CASE WHEN start_char >= 3600 THEN lpad((start_char // 3600)::VARCHAR, 2, '0') || ':' ELSE '' END || lpad((start_char % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((start_char % 60)::VARCHAR, 2, '0') || '](u?v=' || conv_id || '&t=' || start_char || 's)] ' || role AS line FROM segments""", "segments")
def str23(t):
    s = fixtures.segments(t)
    return s.select("conv_id", "turn", X.timestamp_link(F.col("start_char"), F.concat(F.lit("u?v="), F.col("conv_id")), F.col("role")).alias("line"))


@query("str24_stamp_seconds", "SELECT event_id, [(event_id % 60 * 60 + event_id % 50)::INT, 3723] AS seconds FROM events")
def str24(t):
    e = F.col("event_id")
    s = F.concat(F.lit("a ["), F.lpad((e % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((e % 50).cast("string"), 2, "0"), F.lit("] b [1:02:03] c"))
    return t.events.select("event_id", X.stamp_seconds(s).alias("seconds"))


@query("str26_theme_enhancement", "SELECT id, array_to_string(list_sort(list_distinct(list_concat(list_filter(concepts, lambda x: x LIKE 'c%'), [domain]))), ',') AS themes, 'About ' || concepts[1] || ' and ' || concepts[2] AS summary FROM chunks", "chunks")
def str26(t):
    c = fixtures.chunks(t)
    themes = F.array_sort(F.array_union(F.filter("concepts", lambda x: x.startswith("c")), F.array("domain")))
    return c.select("id", F.array_join(themes, ",").alias("themes"), F.concat(F.lit("About "), F.array_join(F.slice("concepts", 1, 2), " and ")).alias("summary"))


@query("str27_json_repair", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def str27(t):
    s = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return t.events.select("event_id", F.get_json_object(X.strip_fences(s), "$.k").cast("long").alias("k"))


@query("str28_needs_cleaning", r"""SELECT doc_id, regexp_matches(text, '\n{4,}') OR regexp_matches(text, '\n\n\d{1,4}\n\n') OR regexp_matches(text, '@page\s*\{|margin.*:\s*\d+pt|\.pt\s*;') OR regexp_matches(text, '(?m)\*\*[A-Z]{20,}\*\*|^[A-Z]{20,}$')
  OR len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 0 AND length(x) < 40)) / len(string_split(text, chr(10)))::DOUBLE > 0.3 AS dirty FROM documents""")
def str28(t):
    return t.documents.select("doc_id", X.needs_cleaning(F.col("text")).alias("dirty"))


@query("str29_tidy", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[“”]', '"', 'g'), '[‘’]', '''', 'g'), '–', '-', 'g'), '—', '--', 'g'), '…', '...', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), '(?m)^[ \t]+|[ \t]+$', '', 'g')) AS digest FROM documents""")
def str29(t):
    return t.documents.select("doc_id", F.md5(X.tidy(F.col("text")).cast("binary")).alias("digest"))


@query("str31_front_matter", "SELECT doc_id, 'doc ' || doc_id AS title, (1990 + doc_id % 30)::INT AS year FROM documents")
def str31(t):
    d = F.col("doc_id")
    s = F.concat(F.lit("---\ntitle: doc "), d, F.lit("\ndate: May "), 1990 + d % 30, F.lit("\n---\n"), F.col("text"))
    return t.documents.select("doc_id", X.front_matter(s, "title").alias("title"), X.year_of(X.front_matter(s, "date")).alias("year"))


@query("a25_element_counts", r"""WITH m AS (SELECT conv_id, '# conv ' || conv_id || chr(10) || chr(10) || string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)
  SELECT conv_id, len(regexp_extract_all(text, '(?m)^#{1,6}\s'))::INT AS headings, len(regexp_extract_all(text, '(?m)^\d+\.\s'))::INT AS numbered_lists, len(regexp_extract_all(text, '\[.*?\]\(.*?\)'))::INT AS links, len(list_filter(string_split_regex(text, '\n\n+'), lambda x: length(regexp_replace(x, '\s', '', 'g')) > 0))::INT AS paragraphs FROM m""")
def a25(t):
    c = X.element_counts(F.col("text"))
    return conversations_markdown(t).select("conv_id", *[c[k].alias(k) for k in ("headings", "numbered_lists", "links", "paragraphs")])


@query("math_page_estimate", "SELECT doc_id, greatest(1, least(20, ceil((doc_id * 37 % 900) / (n_chars // 5 * 5.0) * 20)))::INT AS page FROM documents WHERE n_chars >= 5")
def pages(t):
    return t.documents.where("n_chars >= 5").select("doc_id", X.page_estimate(F.col("doc_id") * 37 % 900, F.floor(F.col("n_chars") / 5), F.lit(20)).alias("page"))


@query("math_emotional_similarity", "SELECT id, round(1 - (abs(polarity - 0.2) / 2 + abs(abs(polarity) - 0.5)) / 2, 6)::DOUBLE AS similarity FROM chunks", "chunks")
def emotion(t):
    return fixtures.chunks(t).select("id", F.round(X.emotional_similarity(F.col("polarity"), F.abs("polarity"), F.lit(0.2), F.lit(0.5)), 6).alias("similarity"))


@query("j23_keyword_match", r"""WITH c AS (SELECT document_id, id, chunk_index, content FROM doc_chunks), k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS r FROM c WHERE contains(lower(content), 'the ') OR contains(lower(content), 'que') OR contains(lower(content), 'und'))
  SELECT d.doc_id AS document_id, coalesce(list(k.id ORDER BY k.r) FILTER (k.r IS NOT NULL), [d.doc_id * 1000]) AS chunk_ids FROM documents d LEFT JOIN k ON k.document_id = d.doc_id AND k.r <= 3 GROUP BY d.doc_id""", "doc_chunks")
def j23(t):
    """The first three chunks with any keyword; the first chunk where none has."""
    from pyspark.sql import Window

    words = F.array(*map(F.lit, ("the ", "que", "und")))
    c = fixtures.doc_chunks(t).where(F.exists(words, lambda w: F.contains(F.lower("content"), w)))
    c = c.withColumn("r", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index"))).where("r <= 3")
    g = c.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("ids"))
    return t.documents.select(F.col("doc_id").alias("document_id")).join(g, "document_id", "left").select("document_id", F.coalesce("ids", F.array(F.col("document_id") * 1000)).alias("chunk_ids"))


@query("j26_vault_annotations", "SELECT document_id, bool_and(id % 13 <> 5) AS all_there, CASE WHEN bool_and(id % 13 <> 5) THEN 'direct' ELSE 'recover' END AS mode FROM doc_chunks GROUP BY document_id", "doc_chunks")
def j26(t):
    there = fixtures.doc_chunks(t).where("id % 13 <> 5").select("id", F.lit(True).alias("y"))
    g = fixtures.doc_chunks(t).join(there, "id", "left").groupBy("document_id").agg(F.bool_and(F.coalesce("y", F.lit(False))).alias("all_there"))
    return g.select("document_id", "all_there", F.when(F.col("all_there"), "direct").otherwise("recover").alias("mode"))


@query("flt11_full_text")
def flt11(t):
    """All turns that hold both words' stems; compared with a plain loop in the tests."""
    index = TextIndex.build(t.conversations, ["conv_id", "turn"], "text", scratch(t.spark, "postings"))
    return index.search("de les").select("conv_id", "turn")


#: Ten kinds of queries, over words of the turns' four languages.
SHAPES = ["thing", "the thing when", "der die", "der or que", "der -die", '"und der"', '"queen thing" or "der die"', "en* der", "que* -que", "-und -the"]


@query("flt11_query_shapes")
def flt11_shapes(t):
    """What ten kinds of queries find, with the nearness of the words; compared with a plain loop over all turns in the tests."""
    index = TextIndex.build(t.conversations, ["conv_id", "turn"], "text", scratch(t.spark, "postings"))
    found = [index.search(q).select(F.lit(i).alias("shape"), "conv_id", "turn", "score") for i, q in enumerate(SHAPES)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("tg1_heading_chunks")
def tg1(t):
    return C.chunk_documents(conversations_markdown(t), "heading", id_col="conv_id")


@query("tg2_recursive_chunks")
def tg2(t):
    return C.chunk_documents(t.documents, "recursive", size=128)


@query("tg2_token_chunks")
def tg2t(t):
    return C.chunk_documents(t.documents, "token", size=128, overlap=16)


@query("tg2_sentence_chunks")
def tg2s(t):
    return C.chunk_documents(t.documents, "sentence", size=128)


def _spans(name, f):
    def run(t):
        import pandas as pd

        def part(batches):
            for b in batches:
                yield pd.DataFrame([(d, i, s, e) for d, x in zip(b["doc_id"], b["text"], strict=True) for i, (s, e) in enumerate(f(x or ""))], columns=["doc_id", "piece", "start", "end"])

        return t.documents.select("doc_id", "text").mapInPandas(part, "doc_id long, piece int, start int, end int")

    query(name)(run)


_spans("tg3_bounded_pieces", lambda x: C.bounded_pieces(x, 1500))
_spans("tg8_pack_paragraphs", lambda x: C.pack_paragraphs(x, 4000))
_spans("tg9_heading_batches", lambda x: C.heading_batches(x, 4000))


@query("tg5_markdown_blocks")
def tg5(t):
    return C.block_documents(conversations_markdown(t), id_col="conv_id")


@query("tg2_semantic_chunks")
def tg2_semantic(t):
    """Chunks of one topic by a stand-in for a sentence model; planted changes are found in the tests."""
    return semantic_chunks(t.documents.select(F.col("doc_id").alias("document_id"), "text"))


def in_sql(t, sql: str, **views):
    """A query in SQL over frames and the library's table functions."""
    table_functions.register(t.spark)
    return t.spark.sql(sql, **views)


@query("tg2_chunks_in_sql")
def tg2_sql(t):
    """The recursive chunks by a lateral join with a table function; the same as the DataFrame form."""
    return in_sql(t, "SELECT d.doc_id AS document_id, c.*, 'recursive' AS chunker_type FROM {docs} d, LATERAL chunk_text(d.text, 'recursive', 128) c", docs=t.documents.select("doc_id", "text"))


@query("tg5_blocks_in_sql")
def tg5_sql(t):
    return in_sql(t, "SELECT d.conv_id AS document_id, b.* FROM {docs} d, LATERAL markdown_blocks(d.text) b", docs=conversations_markdown(t))


@query("st8_fsrs_schedule")
def st8(t):
    r = fixtures.reviews(t).select(F.col("user_id").alias("card_id"), "ts", F.expr("CASE rating WHEN 'again' THEN 1 WHEN 'hard' THEN 2 WHEN 'good' THEN 3 ELSE 4 END").alias("rating"))
    return scheduling.schedule(r, "card_id", "ts", "rating")


@query("st1_stream_job_states", "SELECT job_id, status, epoch_us(updated_at) AS updated_us, n AS events FROM (SELECT job_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS updated_at, count(*) AS n FROM job_events GROUP BY job_id)", "job_events")
def st1(t):
    """State per job over a stream of events, run to the end once; each batch's jobs are upserted into a snapshot table."""
    return S.latest_once(S.job_states(S.read_events(t.spark, f"{t.folder}/events.parquet")), ["job_id"], "events")


@query("ext_stream_windows", """WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT * FROM w""")
def windows(t):
    """Extension: tumbling windows over a stream, each batch's windows upserted (update mode)."""
    out = S.latest_once(S.windowed_counts(S.read_events(t.spark, f"{t.folder}/events.parquet")), ["start", "event_type"], "n")
    return out.withColumn("total", F.round("total", 4))
