"""Canonical keys for labels and identifiers, as JVM column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that carry no content (zero width space, non-joiner, joiner, BOM, soft hyphen).
INVISIBLE = "​‌‍﻿­"


def nfkc(text: Column) -> Column:
    """NFKC form without invisible code points; NULL stays NULL.

    Uses the ICU library that ships with Spark, so the text never leaves the JVM.
    """
    clean = F.translate(F.coalesce(text, F.lit("")), INVISIBLE, "")
    return F.when(text.isNotNull(), F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), clean, F.lit(True)))


def label_key(text: Column) -> Column:
    """Spelling-free key of a label: letters and digits only, lower case (U+318D and U+119E are separators)."""
    return F.regexp_replace(F.lower(nfkc(F.translate(text, "ㆍᆞ", ""))), r"[^\p{L}\p{N}]|ᆞ", "")


def document_key(text: Column) -> Column:
    """Spelling-free key of a document identifier: case, blanks, separators and a trailing ``.md`` do not count."""
    low = F.regexp_replace(F.lower(nfkc(text)), r"(?U)^\s+|\s+$", "")
    joined = F.regexp_replace(F.regexp_replace(low, r"\.md$", ""), r"[^\p{L}\p{N}]+", "_")
    return F.regexp_replace(joined, r"^_+|_+$", "")


def label_keys(items: Column) -> Column:
    """Sorted distinct keys of a list of labels (one canonicalisation of the joined list); blank ones don't count, NULL stays NULL."""
    sep = "\x1f"
    keys = F.transform(F.split(nfkc(F.translate(F.array_join(items, sep), "ㆍᆞ", "")), sep), lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]|ᆞ", ""))
    return F.when(items.isNotNull(), F.array_sort(F.array_distinct(F.filter(keys, lambda x: x != ""))))


def canonical_label(text: Column, values: tuple[str, ...]) -> Column:
    """The one of ``values`` that a label spells, NULL if none."""
    key = label_key(text)
    return F.coalesce(*[F.when(key == label_key(F.lit(v)), F.lit(v)) for v in values])
