"""Set similarity of arrays and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(both_empty))


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters, lower-cased; the text is taken apart once, as each substring would be sought from its start."""
    c = F.regexp_extract_all(F.lower(text), F.lit("(?s)."), F.lit(0))
    n = F.size(c)
    from_ = lambda k: F.slice(c, F.lit(k), F.greatest(n, F.lit(0)))
    both = lambda x, y: F.concat(x, y)
    runs = F.zip_with(F.zip_with(c, from_(2), both), from_(3), both)
    return F.array_distinct(F.when(n >= 3, F.slice(runs, 1, n - 2)).when(text.isNotNull(), F.array().cast("array<string>")))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.when(a.isNotNull() & b.isNotNull(), 1.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / the longer length; 1 for two empty texts."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)
