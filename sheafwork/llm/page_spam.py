"""Problem 10: keyword-stuffed and link-list pages.

Method: thresholds on top-word and bigram shares, duplicate-line share, link-text ratio, separator density and missing function words,
calibrated per language over all pages; each of these signs decides by itself, and so does the share of text without the build of a sentence.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.session import cut

# Function words of languages in Latin letters.
ENGLISH = frozenset(
    "a an and any are as at be been before after by can could do does during each every for from has have he her his how if in into is it its may might must no nor not of on "
    "only or our per shall she should so such than that the their them then there these they this those to under unless until upon was we were what when where whenever which while who will with within without would you your".split()
)
FUNCTION_WORDS = {
    "en": ENGLISH,
    "de": frozenset("der die das den dem des ein eine einen einem einer und oder aber ist sind war wird werden wurde nicht auch auf aus bei bis durch für im in ist mit nach sich sie so über um von vor wie zu zum zur als dass es er wir ihr noch nur sein seine kann hat haben".split()),
    "fr": frozenset("le la les un une des du de et ou mais est sont était être ne pas plus que qui dans sur sous avec sans pour par au aux ce cet cette ces se son sa ses il elle ils nous vous leur on en y comme si tout a ont été".split()),
    "es": frozenset("el la los las un una unos unas de del y o pero es son era ser no más que en con sin por para al su sus se lo le como si este esta estos esta muy ya ha han fue entre sobre cuando".split()),
    "it": frozenset("il lo la i gli le un uno una di del della dei delle e o ma è sono era essere non più che in con senza per su al alla dal nel nella si suo sua come se questo questa anche ha hanno".split()),
    "pt": frozenset("o a os as um uma de do da dos das e ou mas é são era ser não mais que em no na nos nas com sem por para ao à se seu sua como este esta isso foi tem entre sobre quando".split()),
    "nl": frozenset("de het een en of maar is zijn was wordt worden niet ook op uit bij tot door voor in met naar zich zij over om van aan als dat die er hij wij nog te ten kan heeft hebben".split()),
}
LANGUAGES = tuple(FUNCTION_WORDS)
# Korean endings of predicates and of nouns with a case particle; syllables that end a stem before the conditional ending; Japanese and Chinese function characters.
PREDICATE = ("다", "함", "함을", "하고", "하여", "하는", "하되", "하며", "하도록", "해야", "할", "한", "것", "되는", "되며", "되어", "된", "될", "됨", "있는", "있도록", "있어야", "없이", "없을", "위해", "대하여", "대해", "시", "따라", "요", "까", "음", "임")
STEM_ENDS, CONDITIONAL = "하되기뀌나오가지리치히우르으이시었았였", "면"
KANA, HAN = frozenset("のはをにがでとたてすもしれるなかいこ"), frozenset("的了是在和有不与及为對对等也将并其")
PARTICLE = ("을", "를", "은", "는", "에", "에서", "에게", "으로", "로", "의", "와", "과", "이", "가", "도", "까지", "부터", "보다", "마다", "처럼")
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+", re.I)
_ANCHOR = re.compile(r"<a\b[^>]*>(.*?)</a\s*>", re.I | re.S)
_MARKDOWN_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
_TAG = re.compile(r"</?[a-z][^>]*>", re.I)
_INVISIBLE = re.compile("[​‌‍﻿­]")
_SEGMENT = re.compile(r"[\r\n]+|(?<=[.?!])\s+|(?<=[。！？])")
_WORD = re.compile(r"[^\W_]+")
_SEPARATOR = re.compile(r"[|,>/·•#;:»‧*~]")
_HANGUL = re.compile(r"[가-힣]")
_KANA = re.compile(r"[\u3040-\u30ff]")
_HAN = re.compile(r"[\u3400-\u9fff]")
_NAMES = ("lang", "n_chars", "top_share", "bigram_share", "duplicate_share", "link_share", "separators", "function_share", "listed_share", "n_words")
FEATURES = "lang string, n_chars bigint, top_share double, bigram_share double, duplicate_share double, link_share double, separators double, function_share double, listed_share double, n_words bigint"

#: Least share of a page's text in segments that aren't sentences.
MOST = 0.5
#: A page whose top word and bigram shares exceed the language's median by these factors is stuffed even in sentence-like dress.
STUFFED_WORD, STUFFED_BIGRAM = 4.0, 5.0
#: Least shares of the two for that, and of a top word that decides alone; separators in a character.
LEAST_WORD, LEAST_BIGRAM, LEAST_ALONE, LEAST_SEPARATORS = 0.15, 0.05, 0.2, 0.03
#: Quartile distances above the language's upper quartile at which the top word or the separators stand out.
DISTANCES = 8.0
#: Words a page must have, and times its top word must stand, for shares of words to tell.
TELLING_WORDS, TELLING_TIMES = 20, 5
#: Least share of function words that tells a language.
LEAST_FUNCTION = 0.08
#: Share of the language's median of function words under which a page's words aren't sentences'.
FUNCTION_FACTOR = 0.35


def _judge(word: str) -> tuple[int, str]:
    """(mark, stem) of a lower-case word. Mark: 2 predicate, 1 noun with a particle, else 0; plus 4 for a Korean word. Other words: 8 times the set of the languages
    (bits in the order of ``LANGUAGES``) that have it as a function word."""
    if word.isascii() or not _HANGUL.search(word):
        return sum(8 << i for i, lang in enumerate(LANGUAGES) if word in FUNCTION_WORDS[lang]), word
    if len(word) < 2:
        return 4, word
    particle = word.endswith(PARTICLE)
    predicate = word.endswith(PREDICATE) or word[-1] == CONDITIONAL and word[-2] in STEM_ENDS
    return (6 if predicate else 5 if particle else 4), (word[:-1] if particle and len(word) > 3 else word)


class _Judged(dict):
    """Judged words; forgotten when there are very many, so memory stays bounded."""

    def __missing__(self, word: str) -> tuple[int, str]:
        if len(self) > 200_000:
            self.clear()
        out = self[word] = _judge(word)
        return out


def _language(marks: Counter, letters: str) -> tuple[str, int]:
    """(language, its bit among the marks) of a page: Korean and Japanese or Chinese by their letters, one in Latin letters by its function words; ``other`` where none tells."""
    n = sum(marks.values()) or 1
    if marks[4] + marks[5] + marks[6] >= 0.3 * n:
        return "ko", 0
    if letters and len(_KANA.findall(letters)) >= 0.1 * len(letters):
        return "ja", 0
    if letters and len(_HAN.findall(letters)) >= 0.3 * len(letters):
        return "zh", 0
    found = [sum(c for m, c in marks.items() if m & (8 << i)) for i in range(len(LANGUAGES))]
    best = max(range(len(found)), key=found.__getitem__)
    return (LANGUAGES[best], 8 << best) if found[best] >= LEAST_FUNCTION * n else ("other", 0)


def _is_sentence(seg: str, own: list[tuple[int, str]], lang: str, bit: int) -> tuple[bool, int]:
    """(whether a segment has the build of a sentence, its function words).

    Three words, and a predicate (Korean), two function words of the page's language (Latin letters), function characters (Japanese, Chinese); enough of them among its words. In a language without a list:
    five words, closed by a sentence mark, most of them in small letters or a script without such. Never a long run of few different words.
    """
    k = len(own)
    marks = [m for m, _ in own]
    if lang in ("ja", "zh"):
        strong = sum(c in (KANA if lang == "ja" else HAN) for c in seg)
        return strong >= 2 and strong >= (0.15 if lang == "ja" else 0.03) * len(seg), strong
    hangul = marks.count(4) + marks.count(5) + marks.count(6)
    strong = marks.count(6) + (sum(1 for m in marks if m & bit) if bit else 0)
    if not hangul and not bit:
        raw = _WORD.findall(seg)
        latin = any(m >= 8 for m in marks) and lang == "ko"  # a foreign sentence on a Korean page
        if latin:
            strong = sum(1 for m in marks if m >= 8)
            sentence = k >= 3 and strong >= max(2, 0.12 * k)
        else:
            sentence = k >= 5 and seg[-1] in ".?!։।؟" and 2 * sum(not w[0].isupper() and not w[0].isdigit() for w in raw) > k
    else:
        sentence = k >= 3 and strong >= (1 if hangul else 2) and strong >= (0.06 if hangul else 0.12) * k
        if sentence and hangul and strong < 2 and k > 3 and 5 not in marks:
            sentence = False
    if sentence and k >= 12 and len({x for _, x in own}) < 0.34 * k:
        sentence = False
    return sentence, strong


def page_features(text: str | None, judged: dict | None = None) -> tuple:
    """Features of a page. ``listed_share``: share of the characters in segments (lines, or sentences of a line) without the build of a sentence, or that are a third copy: links, lists of names, tags, menus, repeats."""
    judged = _Judged() if judged is None else judged
    if not text or not text.strip():
        return ("none", 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)
    t = unicodedata.normalize("NFKC", html.unescape(_INVISIBLE.sub("", text)))
    n = len(t)
    linked, plain = 0, t
    if "<" in t or "](" in t or "://" in t or "www." in t:
        linked = sum(len(m.group(0)) for m in _ANCHOR.finditer(t)) + sum(len(m.group(0)) for m in _MARKDOWN_LINK.finditer(t))
        bare = _MARKDOWN_LINK.sub(" ", _ANCHOR.sub(" ", t))
        linked += sum(map(len, _URL.findall(bare)))
        plain = _TAG.sub(" ", _URL.sub(" ", bare))
    segments = [(seg, [judged[w] for w in _WORD.findall(seg.lower())]) for seg in map(str.strip, _SEGMENT.split(plain)) if seg]
    marks = Counter(m for _, own in segments for m, _ in own)
    stems = [x for _, own in segments for _, x in own]
    letters = "" if marks[4] + marks[5] + marks[6] or plain.isascii() else "".join(stems)
    lang, bit = _language(marks, letters)
    function = 0
    listed = all_chars = linked
    seen: dict[str, int] = {}
    for seg, own in segments:
        all_chars += len(seg)
        repeat = seen.get(seg, 0)
        seen[seg] = repeat + 1
        sentence, strong = _is_sentence(seg, own, lang, bit)
        function += strong
        if not sentence or repeat >= 2:
            listed += len(seg)
    m = len(stems) or 1
    of = len(letters) if lang in ("ja", "zh") else m
    top = max(Counter(stems).values()) / m if stems else 0.0
    bigram = max(Counter(zip(stems, stems[1:])).values()) / m if len(stems) > 1 else 0.0
    duplicate = 1 - len(seen) / max(1, sum(seen.values()))
    return (lang, n, top, bigram, duplicate, linked / n, len(_SEPARATOR.findall(plain)) / n, function / max(1, of), listed / max(1, all_chars), len(stems))


def features(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, features) of each page, over the whole text; a NULL or blank one gets the language ``none`` and zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.float64()] * 7, pa.int64()]
        judged = _Judged()
        for b in batches:
            cols = list(zip(*(page_features(t, judged) for t in b.column(1).to_pylist()))) or [[]] * 10
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]], [id_col, *_NAMES])

    kept = documents.select(id_col, text)
    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, {FEATURES}")


def calibration(feats: DataFrame) -> DataFrame:
    """(lang, medians, marks that stand out) over all pages; there are as many languages as ``LANGUAGES`` and four more at most."""
    at = lambda c, p: F.percentile_approx(c, F.lit(p), F.lit(1000))
    above = lambda c: at(c, 0.75) + DISTANCES * (at(c, 0.75) - at(c, 0.25))
    return feats.groupBy("lang").agg(
        at("function_share", 0.5).alias("mid_function"), at("top_share", 0.5).alias("mid_top"), at("bigram_share", 0.5).alias("mid_bigram"), above("top_share").alias("high_top"), above("separators").alias("high_separators")
    )


def spam_scores(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Features, thresholds and verdict (``spam``, ``reason``) of every page. Rows with a NULL id count like others. A language's thresholds come from its own pages.

    The reason is the first sign that holds; any of them makes a page spam. Shares above half decide in every language, however its pages are.
    """
    f = cut(features(documents, id_col))
    c = f.join(F.broadcast(calibration(f)), "lang")
    limit = lambda least, own: F.least(F.lit(MOST), F.greatest(F.lit(least), own))
    enough = F.col("n_words") >= TELLING_WORDS
    words_missing = enough & (F.col("function_share") < FUNCTION_FACTOR * F.col("mid_function"))
    often = enough & (F.col("top_share") * F.col("n_words") >= TELLING_TIMES - 0.5)
    phrase = F.col("bigram_share") > limit(LEAST_BIGRAM, STUFFED_BIGRAM * F.col("mid_bigram"))
    stuffed = often & ((F.col("top_share") > limit(LEAST_ALONE, F.col("high_top"))) | (F.col("top_share") > limit(LEAST_WORD, STUFFED_WORD * F.col("mid_top"))) & (phrase | words_missing))
    reason = (
        F.when(F.col("lang") == "none", F.lit(None))
        .when(F.col("link_share") > MOST, "links")
        .when(stuffed, "keywords")
        .when(F.col("duplicate_share") > MOST, "repeated lines")
        .when(F.col("separators") > limit(LEAST_SEPARATORS, F.col("high_separators")), "tags")
        .when(words_missing, "no sentences")
        .when(F.col("listed_share") > MOST, "lists")
    )
    return c.withColumn("reason", reason).withColumn("spam", F.col("reason").isNotNull())


def spam_pages(documents: DataFrame) -> DataFrame:
    """(doc_id) of the pages most of whose text is keywords, links, menus or tags."""
    return spam_scores(documents).where("spam").select("doc_id").distinct()
