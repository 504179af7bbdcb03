"""Problem 8: passages of evaluation items inside corpus documents.

Method: template canonicalisation (numbers, units and names become typed placeholders), hash join of template windows, consistency of the
slot values. A window whose slots agree literally is a verbatim leak, one whose slots map one to one a re-parameterised one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.page_spam import ENGLISH
from sheafwork.llm.words import list_column, mix, signed, words
from sheafwork.session import cut

WINDOW = 12
#: Bits of the Bloom filter of the items' templates for each template, and the most in all (as powers of two; 16 MB): a fuller filter lets more windows through to the exact join, it loses none.
BITS_EACH, MOST_BITS, PROBES = 4, 27, 3
_WINDOW_KIND = "id bigint, template bigint, raw bigint, slots array<bigint>"


# Units (with and without a number glued on), titles after a person's name, ends of the names of bodies, particles by their other form.
UNITS = (
    "초 분 시간 시 일 주 주일 주간 개월 월 년 연도 년도 차 차례 회 번 건 개 개소 명 인 대 식 본 부 권 장 매 쪽 페이지 자리 자 종 곳 층 면 점 배 배수 퍼센트 프로 원 천원 만원 백만원 억원 억 만 천 미터 킬로미터 킬로그램 그램 톤 리터 평 도 세트 단계 레벨 회선 포트 코어 채널 노드 세션 사용자 테라바이트 기가바이트 메가바이트 킬로바이트 바이트 "
    "ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years b kb mb gb tb pb kib mib gib tib bit bits byte bytes bps kbps mbps gbps hz khz mhz ghz mm cm m km g kg t l ml v kv w kw kwh va kva px dpi rpm fps tps iops core cores node nodes user users item items page pages time times percent krw usd eur won"
).split()
TITLES = frozenset("씨 님 과장 부장 팀장 실장 국장 본부장 센터장 원장 대리 사원 주무관 사무관 서기관 교수 박사 대표 이사 소장 위원 위원장 책임 선임 연구원".split())
_BODY = re.compile("^[가-힣]{1,12}?(?:공사|공단|재단|협회|학회|진흥원|연구원|정보원|개발원|관리원|대학교|병원|은행|시청|구청|군청|도청|교육청|위원회|주식회사)(을|를|은|는|이|가|의|에|에서|에게|와|과|으로|로|도|까지|부터)?$")
_OTHER_FORM = {"를": "을", "는": "은", "가": "이", "와": "과", "로": "으로", "라": "이라", "나": "이나"}
_GLUED = re.compile("^([a-z]+[0-9]*[a-z0-9]*)([가-힣]*)$")
_UNIT = re.compile("^(?:" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + ")(의|을|를|은|는|이|가|에|에서|와|과|으로|로|도|까지|부터|마다|안|내|이내|이상|이하|미만|초과|간|당|별|씩|전|후|만)?$")
NUMBER, NAME, UNIT = "\x01#", "\x01name", "\x01unit"


def _form(tail: str | None) -> str:
    """A particle in the form that doesn't hang on the word before it."""
    return _OTHER_FORM.get(tail or "", tail or "")


def _is_number(w: str) -> bool:
    return w[0].isdigit()


def _place(w: str) -> str | None:
    """Typed placeholder of a word whatever stands beside it; None for an ordinary word.

    A number takes a unit glued to it along (``10gb``, ``30일까지``); names are letters with digits or a Korean tail (``galve40``, ``galve를``) and Korean bodies by their last syllables.
    """
    if _is_number(w):
        tail = w.lstrip("0123456789")
        unit = _UNIT.match(tail)
        return NUMBER + (UNIT + _form(unit.group(1)) if unit else _form(tail))
    glued = _GLUED.match(w)
    if glued and not w.isalpha() or glued and glued.group(2):
        return NAME + _form(glued.group(2))
    body = _BODY.match(w)
    return NAME + _form(body.group(1)) if body else None


def _beside(w: str) -> tuple[bool, bool, bool, bool, str | None]:
    """What a word is to its neighbours: a Latin word that can be a name, one with Hangul, one that can be a person's name, a title; its placeholder after a number, if it is a unit."""
    hangul = any("가" <= c <= "힣" for c in w)
    unit = _UNIT.match(w)
    return w.isascii() and w.isalpha() and w not in ENGLISH, hangul, hangul and 2 <= len(w) <= 4, w in TITLES or (w[:-1] in TITLES and w[-1] in "은는이가을를의와과"), UNIT + _form(unit.group(1)) if unit else None


def probe(templates: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th place of each template hash in a filter of 2^``bits`` bits."""
    return (mix(templates, 50 + k) >> np.uint64(64 - bits)).astype(np.int64)


def bloom(templates: DataFrame, bits: int) -> np.ndarray:
    """Bloom filter (64-bit words) of a column ``template``; built in the executors, the driver gets its set words only, at most 2^bits / 64 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << (bits - 6), np.uint64)
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(PROBES):
                at = probe(h, k, bits)
                np.bitwise_or.at(own, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(signed(own[at]))], ["word", "bits"])

    got = templates.select("template").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def windows(ids: list[int], texts: list[str | None], size: int, keep: np.ndarray | None) -> pa.RecordBatch:
    """Every window of ``size`` words: template hash, literal hash, slot value hashes; of those that the Bloom filter ``keep`` lets through only, if given.

    A Latin word beside a Korean one or before a number is a name, a Korean one before a title too, a unit after a number a unit. Only neighbours
    in the window count, so equal windows have equal templates and no verbatim leak is lost.
    """
    lists = [words(t) for t in texts]
    flat = [w for x in lists for w in x]
    d = pa.array(flat, pa.string()).dictionary_encode()
    vocabulary = d.dictionary.to_pylist()
    at = d.indices.to_numpy()
    m = len(vocabulary)
    place = [_place(w) for w in vocabulary]
    beside = [_beside(w) for w in vocabulary]
    h = lambda s: xxhash.xxh3_64_intdigest(s)
    flag = lambda x: np.fromiter(x, bool, m)[at]
    raw = np.fromiter(map(h, vocabulary), np.uint64, m)[at]
    base = np.fromiter((h(p or w) for p, w in zip(place, vocabulary)), np.uint64, m)[at]
    unit_hash = np.fromiter((h(x[4] or "") for x in beside), np.uint64, m)[at]
    placed, number, plain = flag(p is not None for p in place), flag(map(_is_number, vocabulary)), flag(w.isdigit() for w in vocabulary)
    latin, hangul, person, title = (flag(x[k] for x in beside) for k in range(4))
    unit = flag(x[4] is not None for x in beside)
    before = lambda x: np.concatenate([np.zeros(1, bool), x[:-1]]) if len(x) else x
    after = lambda x: np.concatenate([x[1:], np.zeros(1, bool)]) if len(x) else x

    def typed(first: bool, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """(template hash, is a slot) of each word as the first, an inner or the last one of a window."""
        name = np.zeros(len(flat), bool)
        a_unit = name
        if not last:
            name = latin & after(number | hangul) | person & after(title)
        if not first:
            name = name | latin & before(hangul)
            a_unit = unit & before(plain)
        name &= ~placed
        return np.where(a_unit, unit_hash, np.where(name, np.uint64(h(NAME)), base)), placed | name | a_unit

    forms = [typed(True, False), typed(False, False), typed(False, True)]
    form = lambda k: forms[0 if k == 0 else 2 if k == size - 1 else 1]
    n = max(0, len(flat) - size + 1)
    own = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    ok = own[:n] == own[size - 1 :] if n else np.zeros(0, bool)
    sums = []
    for of in (lambda k: form(k)[0], lambda k: raw):
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total += mix(of(k)[k : k + n], k + 1)
        sums.append(mix(total))
    begin = np.flatnonzero(ok)
    if keep is not None:
        bits = len(keep).bit_length() + 5
        for k in range(PROBES):  # few windows are left after the first probe
            at = probe(sums[0][begin], k, bits)
            begin = begin[(keep[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1]
    grid = begin[:, None] + np.arange(size)
    is_slot = np.stack([form(k)[1][grid[:, k]] for k in range(size)], 1) if len(begin) else np.zeros((0, size), bool)
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(is_slot.sum(1), out=offsets[1:])
    values = raw[grid][is_slot] if len(begin) else np.zeros(0, np.uint64)
    who = np.array(ids, np.int64)[own[begin]] if len(begin) else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(who), pa.array(signed(sums[0][begin])), pa.array(signed(sums[1][begin])), list_column(offsets, signed(values), pa.int64())], ["id", "template", "raw", "slots"])


def _scan(rows: DataFrame, id_col: str, text: str, size: int, keep: np.ndarray | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield windows(b.column(0).to_pylist(), b.column(1).to_pylist(), size, keep)

    return rows.where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(run, _WINDOW_KIND)


def leaks(documents: DataFrame, items: DataFrame, size: int = WINDOW, filter_bits: int | None = None) -> DataFrame:
    """(doc_id, item_id, verbatim, windows): document-item pairs that share a template window, with whether ``size`` consecutive words are
    literally the same, and the number of shared windows. Other pairs are re-parameterised: same template, slot values mapped one to one.

    NULL ids or texts and texts below ``size`` words give nothing; repeats count once. Whole texts are scanned, each word once.
    One plan for every size: a Bloom filter of the items' templates (2^``filter_bits`` bits; by default it grows with the items up to a bound) thins the windows
    where they are made, the join on the template decides.
    """
    of_items = cut(_scan(items, "item_id", "text", size).distinct())
    if filter_bits is None:
        filter_bits = min(MOST_BITS, max(16, of_items.count().bit_length() + BITS_EACH))
    keep = bloom(of_items, filter_bits)
    found = _scan(documents, "doc_id", "text", size, keep).groupBy("id", "template", "raw", "slots").agg(F.count(F.lit(1)).alias("times"))
    d = found.select(F.col("id").alias("doc_id"), "template", F.col("raw").alias("d_raw"), F.col("slots").alias("d_slots"), "times")
    i = of_items.select(F.col("id").alias("item_id"), "template", F.col("raw").alias("i_raw"), F.col("slots").alias("i_slots"))
    pair = d.join(i, "template").withColumn("verbatim", F.col("d_raw") == F.col("i_raw"))
    size_of = lambda c: F.size(F.array_distinct(c))
    pairs_ = F.arrays_zip("i_slots", "d_slots")
    consistent = (size_of(pairs_) == size_of(F.col("i_slots"))) & (size_of(pairs_) == size_of(F.col("d_slots")))
    return pair.where(F.col("verbatim") | consistent).groupBy("doc_id", "item_id").agg(F.max("verbatim").alias("verbatim"), F.sum("times").alias("windows"))


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) with at least twelve consecutive words literally in common."""
    return leaks(documents, items).where("verbatim").select("doc_id", "item_id")
