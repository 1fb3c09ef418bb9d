"""Leftovers of pages and e-books."""

import re

import pytest
from pyspark.sql import functions as F

from skein.operators import layout

PAGES = [
    ("we read the\n\n17\n\npage again", "we read the page again"),
    ("one thing,\n\n8\n\nthen more and\n\n9\n\nyet more", "one thing, then more and yet more"),
    ("in view of\n\n212 Jane Writer\n\nwhat follows", "in view of what follows"),
    ("in view of\n\n12 Part Two: The Rivers\n\nwhat follows", "in view of what follows"),
    ("...in view of\n\n303 Rivers, Mills and the Three Bridges\n\nold laws...", "...in view of old laws..."),
    ("the old\n\nMill Stories\n\nmill stood", "the old mill stood"),
    ("the old\n\nThis stands by itself.\n\nmill stood", "the old\n\nThis stands by itself.\n\nmill stood"),
    ("the old\n\n" + "A" * 18 + " " + "B" * 50 + "\n\nmill", "the old\n\n" + "A" * 18 + " " + "B" * 50 + "\n\nmill"),
    ("we saw\n\nPage 3\n\nnothing", "we saw nothing"),
    ("we saw\n\np. 31\n\nnothing", "we saw nothing"),
    ("we saw\n\npage 3\n\nnothing", "we saw nothing"),
    ("first among\n\nxiv FOREWORD\n\nthem all", "first among them all"),
    ("first among\n\nXIV LIST OF PLATES\n\nthem all", "first among them all"),
    ("the mill says\n\n302 Jane Writer\n\nthat we see\n\nPage 303\n\nthe rivers", "the mill says that we see the rivers"),
    ("the old\n\n45\n\nMill Stories\n\nmill stood", "the old mill stood"),  # a run of two
    ("It ends here.\n\n45\n\nMill Stories\n\nNext it begins", "It ends here.\n\nNext it begins"),
    ("It ends here.\n\n45\n\nNext it begins.", "It ends here.\n\n45\n\nNext it begins."),
    ("It ends here.\n\nMill Stories\n\nNext it begins.", "It ends here.\n\nMill Stories\n\nNext it begins."),
    ("a   b\n\n\n\n\nc  \nd", "a b\n\nc\nd"),
    ("x.\n\nTHE RIVER\n\ny.", "x.\n\n## THE RIVER\n\ny."),
    ("x.\n\nNOTES\n\ny.", "x.\n\nNOTES\n\ny."),
    ("THEOLDMILLUPONTHERIVER\n\nreal text", "real text"),
    ("@page { margin: 5pt }\nreal { a: 1.50pt; } text {kept}", "real text {kept}"),
    ("# One\n\nSome text.\n\n1. a\n2. b", "# One\n\nSome text.\n\n1. a\n2. b"),
    ("The points:\n\n1. First point\n2. Second point", "The points:\n\n1. First point\n2. Second point"),
    ("ok\n\n1\n\ne\n\n2\n\ngo", "ok e go"),
    ("The end. Another begins.", "The end. Another begins."),
    ("", ""),
    (None, None),
]


def column(spark, rows, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_pages(spark):
    got = column(spark, [a for a, _ in PAGES], layout.clean_pages)
    assert got == [b for _, b in PAGES]
    assert column(spark, got, layout.clean_pages) == got  # nothing is left to do


def test_pages_options(spark):
    assert column(spark, ["x.\n\nTHE RIVER\n\ny."], lambda c: layout.clean_pages(c, titles=False)) == ["x.\n\nTHE RIVER\n\ny."]
    loose = ["he went\n\n5 any line here.\n\non", "he went\n\nAny line up to eighty signs, and it may end so.\n\non", "a\n\n\n\nb  \nc", "talking of\n\n123 Some Random Header Text\n\nthe mill"]
    assert column(spark, loose, lambda c: layout.clean_pages(c, loose=True)) == ["he went on", "he went on", "a\n\nb\nc", "talking of the mill"]


BOOKS = [
    ("Cover\n\nText of it", "Text of it"),
    ("a\n\n# ch_01-a.xhtml\n\nb", "a\n\nb"),
    ("a\n\n@font-face {x: y} b {m: 1.5pt} c {d}", "a\n\nb c {d}"),
    ("a\n\nCHAPTER ONE\n\nb", "a\n\n## CHAPTER ONE\n\nb"),
    ("a\n\nChapter 12\n\nb", "a\n\n## Chapter 12\n\nb"),
    ("a\n\n7\n\nb", "a\n\n## 7\n\nb"),
    ("a\n\n# Unknown\n\nb", "a"),
    ("a [next](ch2.xhtml#x) b", "a  b"),
    ("a [here](file:///tmp/x) b [web](https://example.com)", "a here b [web](https://example.com)"),
    ("# Contents\n\n[One](a.html)\n[Two](b.html)\n[Three](c.html)\n\n# One\n\nIt begins", "# One\n\nIt begins"),
    ("All rights reserved\n\n# Chapter 1\n\nIt begins", "# Chapter 1\n\nIt begins"),
    ("Hello\n\n# Chapter 1\n\nIt begins", "Hello\n\n# Chapter 1\n\nIt begins"),
    ("# Chapter 1\n\nThe copyright of it", "# Chapter 1\n\nThe copyright of it"),
    ("# Dedication\n\nfor all of them\n\n# 1\n\nIt begins", "# 1\n\nIt begins"),
    ("a\n\n# Rivers\n\n**Rivers**\n\nit begins", "a\n\n# Rivers\n\nit begins"),
    ("# Publisher's Note\n\nsaid here\n\n# Two\n\nb", "# Two\n\nb"),
    ("x\n\n\n\n\n\ny", "x\n\ny"),
    ("", ""),
    (None, None),
]


def test_books(spark):
    assert column(spark, [a for a, _ in BOOKS], layout.clean_book) == [b for _, b in BOOKS]


def test_long_text_is_read_once(spark):
    text = "\n\n".join(f"some words of page {i} and\n\n{i} Running Head" for i in range(1, 4000)) + "\n\nthe end"
    assert column(spark, [text], layout.clean_pages) == [" ".join(re.sub(r"\n\n\d+ Running Head", "", text).split("\n\n"))]


def test_book_query_finds_the_text(spark):
    from skein.plans import catalog

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = docs.select("doc_id", layout.clean_book(F.concat(F.lit("# Chapter 1\n\n"), "text")).alias("t"), "text").where("text is not null").collect()
    got = {r["doc_id"]: r["n"] for r in catalog.queries()["str9_epub_cleanup"](spark, folder).collect()}
    assert {r["doc_id"]: len(r["t"]) for r in want} == {i: n for i, n in got.items() if n is not None}
    squeeze = lambda s: re.sub(r"\s+", " ", re.sub(r"(?m)^# Chapter 1$|^## ", "", s)).strip()
    same = sum(squeeze(r["t"]) == squeeze(r["text"]) for r in want)
    assert same >= 0.97 * len(want)  # plain texts stay as they are
