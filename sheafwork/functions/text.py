"""Text normalisation as column expressions. Only entity decoding needs Python (Arrow batches)."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# List markers at the start of a line.
BULLETS = "◦○●•ㆍ▪■□◆◇▶▷►▸▹‣⁃∙·"
#: White space of Unicode, spelled out so that any regex dialect agrees.
SPACE = "\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
#: The same as characters.
BLANKS = "".join(chr(c) for c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
# Surface signals of risk, by name.
SIGNALS = {
    "free_or_extra": "무상|추가.{0,8}(?:개발|제공|지원)",
    "negotiated_later": "협의|추후.{0,6}확정|별도.{0,6}정함",
    "acceptance_performance": "검수|합격.{0,6}기준|성능.{0,6}(?:기준|보장)",
    "liability": "책임|배상|지체상금|귀책",
    "resident_staff": "상주|투입.{0,5}인력|전담.{0,5}인력",
    "quantities": r"이상|이하|이내|최대|최소|[0-9]+\s*(식|명|개|대|TB)",
}
# Fixed value: a requirement identifier, 2 to 8 capitals, then groups of capitals and digits; not inside a longer token.
REQUIREMENT_ID = r"(?<![A-Z0-9])([A-Z]{2,8}(?:-+[A-Z0-9]{2,8})+)(?![A-Z0-9])"


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities decoded; NULL stays NULL."""
    return text.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)


def nfc(text: Column) -> Column:
    """NFC form, by the ICU library that ships with Spark; NULL stays NULL."""
    return F.when(text.isNotNull(), F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(False)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def compact(text: Column) -> Column:
    """Runs of white space become one blank; no outer ones."""
    return strip(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for blank, NULL for NULL."""
    c = compact(text)
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))


def snippet(text: Column, n: int = 100) -> Column:
    return F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit(" "))


def clean_lines(text: Column) -> Column:
    """Decoded text whose lines have single blanks, no outer ones, and are not empty."""
    lines = F.transform(F.split(F.replace(text, F.lit(" "), F.lit(" ")), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"), lambda x: strip(F.regexp_replace(x, "[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def cell_key(clean: Column) -> Column:
    """Key of a table cell: leading numbering off, then all white space."""
    return F.regexp_replace(F.regexp_replace(clean, rf"^[①-⑩0-9.(){SPACE}]+", ""), rf"[{SPACE}]+", "")


def normalize_common(text: Column) -> Column:
    """Decoded NFC text: ``<br>`` and any line end become LF, blanks collapse, at most one empty line between lines."""
    t = F.regexp_replace(nfc(unescape(text)), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, "[ \t]+", " ")
    t = F.array_join(F.transform(F.split(t, "\n"), strip), "\n")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def is_bullet_line(line: Column) -> Column:
    return line.rlike(rf"^[ \t]*(?:[{BULLETS}]|[-–—])[ \t]*(?:[^{SPACE}].*)?$")


def normalize_bullets(text: Column) -> Column:
    """Marker of each list line becomes ``- ``; inline hyphens stay."""
    def line(x: Column) -> Column:
        body = strip(F.regexp_extract(x, rf"^[ \t]*(?:[{BULLETS}]|[-–—])[ \t]*(.*)$", 1))
        return F.when(is_bullet_line(x), F.regexp_replace(F.concat(F.lit("- "), body), " +$", "")).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def flatten_list(text: Column) -> Column:
    lines = F.transform(F.split(normalize_bullets(text), "\n"), lambda x: strip(F.regexp_replace(x, rf"^-[{SPACE}]*", "")))
    return compact(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def model_text(name: Column, body: Column, variant: str) -> Column:
    """Name and body in one of three variants; empty parts are left out."""
    part = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    base = normalize_common(F.concat_ws("\n", part(name), part(body)))
    forms = {"raw": lambda: base, "normalized-list": lambda: normalize_bullets(base), "flat": lambda: flatten_list(base)}
    if variant not in forms:
        raise ValueError(f"unknown variant {variant!r}")
    return forms[variant]()


def signal_flags(text: Column) -> dict[str, Column]:
    return {name: F.coalesce(text.rlike(p), F.lit(False)) for name, p in SIGNALS.items()}
