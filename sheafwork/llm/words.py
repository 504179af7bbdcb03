"""Word extraction and hashing shared by the text operators (vectorised per Arrow batch)."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash

_INVISIBLE = re.compile("[​‌‍﻿­]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the NFKC, lower-case text without invisible code points."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return _WORD.findall(text.lower())


def hashed(items: list[str]) -> np.ndarray:
    """64-bit hash of each item; only the distinct ones are hashed."""
    if not items:
        return np.zeros(0, np.uint64)
    d = pa.array(items, pa.string()).dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in d.dictionary.to_pylist()), np.uint64, len(d.dictionary))
    return table[d.indices.to_numpy()]


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): text i has the word hashes ``hashes[offsets[i]:offsets[i + 1]]``, in text order."""
    lists = [words(t) for t in texts]
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return offsets, hashed([w for x in lists for w in x])


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash (murmur3), with a salt."""
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def distinct_words(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) with each text's distinct hashes in ascending order."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    o, h = o[keep], h[keep]
    out = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(o, minlength=n), out=out[1:])
    return out, h


def fold(offsets: np.ndarray, hashes: np.ndarray, salt: int = 0) -> np.ndarray:
    """One order-sensitive 64-bit digest per segment."""
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    if len(hashes):
        place = np.arange(len(hashes), dtype=np.int64) - np.repeat(offsets[:-1], np.diff(offsets))
        v = mix(hashes + mix(place.astype(np.uint64), salt + 1), salt)
        full = np.flatnonzero(np.diff(offsets))
        out[full] = np.add.reduceat(v, offsets[:-1][full])
    return mix(out + np.diff(offsets).astype(np.uint64), salt)


def sketch(offsets: np.ndarray, hashes: np.ndarray, bits: int = 64, salt: int = 900) -> np.ndarray:
    """One word per text whose bit b is the lowest bit of the minimum under hash function b (1-bit minwise hashing)."""
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        starts = offsets[:-1][full]
        odd = mix(np.arange(bits, dtype=np.uint64), salt) | np.uint64(1)
        for b in range(bits):  # multiplicative hashing will do: the words' hashes are well mixed
            low = np.minimum.reduceat(hashes * odd[b], starts)
            out[full] |= (mix(low, 7) & np.uint64(1)) << np.uint64(b)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_column(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
