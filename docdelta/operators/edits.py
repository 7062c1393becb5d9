"""Edit distances of many pairs of short texts at once: Myers' bit vectors, a column of numpy words for all pairs of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Longest text in code points; pairs that are worked on together; most of them times the kinds of code points in their first texts.
MOST, TOGETHER, CELLS = 128, 4096, 1 << 19
_ONE, _TOP, _WORD = np.uint64(1), np.uint64(63), 64


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points in rows as wide as the longest text, lengths)."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(texts), int(n.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out, n


def _batch(a: list[str], b: list[str]) -> np.ndarray:
    """Distances of pairs of texts of 1 to MOST code points."""
    (x, m), (y, n) = _codes(a), _codes(b)
    order = np.argsort(-n, kind="stable")  # pairs whose second text still goes on come first
    x, m, y, n = x[order], m[order], y[order], n[order]
    # Where each code point of the first texts stands: a word of bits for each pair, code point and 64 places.
    inside = np.arange(x.shape[1]) < m[:, None]
    known = np.zeros(max(int(x.max()), int(y.max())) + 1, bool)
    known[x[inside]] = True
    kinds = int(known.sum())
    if len(x) > 64 and len(x) * kinds > CELLS:  # many kinds, as ideographs
        half = len(a) // 2
        return np.concatenate([_batch(a[:half], b[:half]), _batch(a[half:], b[half:])])
    number = np.full(len(known), kinds)
    number[known] = np.arange(kinds)
    x, y = np.where(inside, number[x], kinds), number[y]
    row = np.arange(len(x)) * (kinds + 1)
    words = -(-x.shape[1] // _WORD)
    places = np.zeros((words, len(x) * (kinds + 1)), np.uint64)
    for i in range(x.shape[1]):
        places[i // _WORD][row + x[:, i]] |= _ONE << np.uint64(i % _WORD)
    places.reshape(words, len(x), kinds + 1)[:, :, kinds] = 0
    columns = np.ascontiguousarray(y.T)
    up = [np.full(len(x), ~np.uint64(0)) for _ in range(words)]
    down = [np.zeros(len(x), np.uint64) for _ in range(words)]
    going = np.searchsorted(-n, -np.arange(len(columns)), side="left")
    for j, k in enumerate(going.tolist()):
        at, carry, more, less = row[:k] + columns[j, :k], None, _ONE, None
        for w in range(words):
            eq, pv, mv = places[w].take(at), up[w][:k], down[w][:k]
            total = (eq & pv) + pv
            if w < words - 1:
                over = total < pv
            if carry is not None:
                total += carry
            if w < words - 1:
                carry = (over if carry is None else over | (total < carry)).astype(np.uint64)
            level = (total ^ pv) | eq
            ph, mh = mv | ~(level | pv), pv & level
            if w < words - 1:
                next_more, next_less = ph >> _TOP, mh >> _TOP
            ph, mh = ph << _ONE | more, mh << _ONE if less is None else mh << _ONE | less
            more, less = (next_more, next_less) if w < words - 1 else (None, None)
            eq |= mv
            np.bitwise_or(mh, ~(eq | ph), out=up[w][:k])
            np.bitwise_and(ph, eq, out=down[w][:k])
    # The steps up and down the last column of each pair, as far as its first text goes.
    score = n
    for w in range(words):
        bits = np.clip(m - w * _WORD, 0, _WORD)
        own = np.where(bits == _WORD, ~np.uint64(0), (_ONE << (bits % _WORD).astype(np.uint64)) - _ONE)
        score = score + np.bitwise_count(up[w] & own).astype(np.int64) - np.bitwise_count(down[w] & own)
    out = np.empty(len(x), np.int64)
    out[order] = score
    return out


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distance of each pair of texts of up to MOST code points."""
    out = np.fromiter((max(len(s), len(t)) for s, t in zip(a, b, strict=True)), np.int64, len(a))
    some = [i for i, (s, t) in enumerate(zip(a, b, strict=True)) if s and t]
    for i in range(0, len(some), TOGETHER):
        here = some[i : i + TOGETHER]
        out[here] = _batch([a[k] for k in here], [b[k] for k in here])
    return out


def _column(a: pa.Array, b: pa.Array) -> pa.Array:
    a, b = a.to_pylist(), b.to_pylist()
    some = [i for i, (s, t) in enumerate(zip(a, b, strict=True)) if s is not None and t is not None]
    out = np.zeros(len(a), np.int32)
    out[some] = distances([a[i] for i in some], [b[i] for i in some])
    none = np.ones(len(a), bool)
    none[some] = False
    return pa.array(out, pa.int32(), mask=none)


#: The distance of two columns; null where one is. Marked so that filters aren't pushed below it, which would work it out once more.
distance = F.arrow_udf(_column, T.IntegerType()).asNondeterministic()
