"""Leftovers of page layout and of e-books in texts, by classes of blocks and sections, as column expressions.

Pages: a text is a row of blocks between blank lines. A block is a label if it is one short line made of numbers, capitalised words and small
connecting words alone, without a sentence's end; a locator if it is nothing but a page's number. Labels get marks, and only then are runs of
marked blocks judged by what stands around them: where a sentence goes on behind them, the run goes and the sentence is joined; a locator goes with a
label next to it wherever they stand; other labels stay. So each block is looked at once and no rule depends on another's outcome.

Books: a text is a row of sections, each beginning with a heading. Counts of words, links and legal terms tell sections that lead around in the book or
belong to its publisher from those that are read; the latter stay. Lines that only a file or a page description can hold go first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths of a label, words that may stand between its capitalised words, terms and titles of sections that are no text.
LABEL_CHARS, LOOSE_CHARS, GLYPHS = 61, 81, 20
CONNECTING = "a|an|and|at|by|de|for|from|in|of|on|or|the|to|with"
LEGAL = r"isbn|copyright|©|all rights reserved|published by|publisher"
BESIDE_TEXT = "cover|title page|dedication|copyright|contents|table of contents|publisher's note|unknown"
LEGAL_WORDS, BESIDE_WORDS, WORDS_A_LINK = 400, 120, 4

_WORD = rf"(?:\d{{1,4}}|[ivxlcdm]+|[Pp](?:age)?\.?|[\"'(]?[A-Z]\S*|{CONNECTING})[,;:)]*"
LABEL = rf"^{_WORD}(?: {_WORD})*$"
LOOSE = r"^[A-Z0-9].*$"
CONNECTS = rf"^(?:{CONNECTING})(?: |$)"
LOCATOR = r"^(?:[Pp](?:age)?\.? ?)?(?:\d{1,4}|[ivxlcdm]+)$"
CAPITALS = r"^(?:[A-Z]{3,} [A-Z]{2,}(?: [A-Z]{2,})?|[A-Z]{6,})$"
STYLE = r"@[a-z-]+\s*\{[^{}]*\}\s*|\{[^{}]*\d\.\d+pt[^{}]*\}\s*"
# marks around blocks: a label begins with the first, a locator with the second, a line in capitals with the first and the fourth; all end with the third
_L, _N, _END, _T = "\x01", "\x02", "\x03", "\x04"
_RUN = rf"(?:[{_L}{_N}][^{_END}]*{_END}\n\n)+"
BROKEN = rf"([a-z,;:])\n\n{_RUN}([a-z])"
BESIDE = rf"\n\n(?:{_N}[^{_END}]*{_END}\n\n{_L}[^{_END}]*{_END}|{_L}[^{_END}]*{_END}\n\n{_N}[^{_END}]*{_END})\n\n"
MARKS = rf"[{_L}{_N}{_END}]"


def _strip(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\n\x0b\x0c\r"))


def _tidy(text: Column) -> Column:
    """No marks, style leftovers, runs of spaces or white space at ends of lines."""
    text = F.regexp_replace(text, rf"[{_L}{_N}{_END}{_T}]|{STYLE}", "")
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"[ \t]{2,}", " ")


def marked(block: Column, loose: bool, titles: bool) -> Column:
    """block with marks if it is a label or a locator."""
    most, pattern = (LOOSE_CHARS, LOOSE) if loose else (LABEL_CHARS, LABEL)
    label = (F.length(block) <= most) & block.rlike(pattern) & ~block.rlike(CONNECTS) & (F.lit(loose) | ~block.rlike("[.!?]$"))
    title = F.when(block.rlike(CAPITALS), _T).otherwise("") if titles else F.lit("")
    out = F.when(block.rlike(LOCATOR), F.concat(F.lit(_N), block, F.lit(_END))).when(label, F.concat(F.lit(_L), title, block, F.lit(_END)))
    return out.otherwise(block)


def clean_pages(text: Column, loose: bool = False, titles: bool = True) -> Column:
    """text without running heads and page numbers, sentences joined where these broke them.

    loose: any short line that begins with a capital or a digit counts as a label. titles: what is left of lines in capitals becomes headings.
    Null stays null.
    """
    blocks = F.filter(F.split(_strip(_tidy(text)), r"\n\s*\n"), lambda b: ~b.rlike(rf"^\**[A-Z]{{{GLYPHS},}}\**$"))
    whole = F.array_join(F.transform(blocks, lambda b: marked(b, loose, titles and not loose)), "\n\n")
    whole = F.regexp_replace(F.regexp_replace(whole, BROKEN, "$1 $2"), BROKEN, "$1 $2")  # again: a block of one letter ends one run and begins another
    whole = F.regexp_replace(F.regexp_replace(whole, BESIDE, "\n\n"), MARKS, "")
    return _strip(F.replace(whole, F.lit(_T), F.lit("## ")))


# ---------------------------------------------------------------- e-books

def section_kind(section: Column) -> Column:
    """links, legal, beside or text."""
    words = F.size(F.split(_strip(section), r"\s+"))
    first = F.lower(F.regexp_extract(section, r"^#{1,6}\s+([^\n]*)", 1))
    title = F.trim(F.regexp_replace(first, r"[*_]", ""))
    links = F.regexp_count(section, F.lit(r"\]\("))
    return (
        F.when((links > 1) & (links * WORDS_A_LINK >= words), "links")
        .when((words < LEGAL_WORDS) & F.lower(section).rlike(LEGAL) & ~title.rlike("^(?:chapter|prologue|part|introduction)"), "legal")
        .when((words < BESIDE_WORDS) & title.rlike(rf"^(?:{BESIDE_TEXT})$"), "beside")
        .otherwise("text")
    )


def clean_book(text: Column) -> Column:
    """text of an e-book: sections that are read, with chapters as headings and without what its files left in it. Null stays null."""
    t = F.regexp_replace(_tidy(text), r"(?m)^[#*\s]*[\w-]+(?:[._-][\w-]+)*\.x?html?\**$|^\**Cover\**$", "")  # file names, the cover's caption
    t = F.regexp_replace(t, r"\[([^\]\n]*)\]\((?:file:|https?://localhost)[^)\n]*\)", "$1")
    sections = F.filter(F.split(t, r"\n(?=#{1,6}\s)"), lambda s: section_kind(s) == "text")
    t = F.regexp_replace(F.array_join(sections, "\n"), r"\[[^\]\n]*\]\([^)\n]*\.x?html?[^)\n]*\)", "")  # links inside the book, once their number has been judged
    t = F.regexp_replace(t, r"(?m)^(#{1,6}\s+)([^\n]+)\n\s*\n\**\2\**$", "$1$2\n")  # a heading said again as a paragraph
    t = F.regexp_replace(t, r"(?mi)(?<=\n\n)\**((?:chapter|part) \w+|\d{1,2})\**(?=\n\n)", "## $1")
    return _strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))
