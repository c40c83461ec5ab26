"""Suffix-array dedup with longest-previous-factor arrays.

A byte is removed if a ``k``-byte string that covers it also starts earlier.  In suffix
order, the nearest suffixes before and after that start earlier in the text (previous
and next smaller positions) have the longest earlier matches; the longer of the two is
the longest previous factor, and a start is a copy when that is ``k`` or more.  Text is
brought to a bucket in runs that share a minimiser (see ``windows``), so a suffix array
is built for each bucket over the strings that repeat in part; strings that repeat as a
whole need none.

Defined cases: a null text is empty; a text shorter than ``k`` bytes loses nothing; of
overlapping copies inside a text the first stays; documents are ordered by id (null
first), then by a hash of the text; rows equal in both are one document; a text of any length is
cut into overlapping slices, no window is lost; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BYTE_POWERS, Texts, covered, prefix_hash, seq_hash
from .windows import EarlierWindows, SLICE_UNITS, ranges


def suffix_ranks(s: np.ndarray, depth: int) -> list[np.ndarray]:
    """ranks[j][i]: the rank of the 2**j symbols from i on, up to ``depth`` symbols or more (prefix doubling)."""
    rank = np.unique(s, return_inverse=True)[1].astype(np.int32) + np.int32(1)
    out, step = [rank], 1
    while step < depth:
        key = rank.astype(np.int64) * (int(rank.max(initial=0)) + 1)
        key[:-step] += rank[step:]
        rank = np.unique(key, return_inverse=True)[1].astype(np.int32) + np.int32(1)
        out.append(rank)
        step *= 2
    return out


def smaller_positions(position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order, the nearest places before and after whose text position is smaller; -1: none."""

    def before(x: np.ndarray) -> np.ndarray:
        n = len(x)
        x = np.append(x, -1)  # at place -1: smaller than all
        link = np.arange(-1, n - 1)
        todo = np.flatnonzero(x[link] > x[:n])
        while len(todo):  # follow links; those that point to a smaller position are done
            link[todo] = link[link[todo]]
            todo = todo[x[link[todo]] > x[todo]]
        return link

    after = len(position) - 1 - before(position[::-1])[::-1]
    return before(position), np.where(after == len(position), -1, after)


def common_prefix(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, at most twice the deepest rank's symbols less one."""
    n = len(ranks[0])
    length = np.zeros(len(a), np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        x, y = a + length, b + length
        ok = (x < n) & (y < n)
        same = np.zeros(len(a), bool)
        same[ok] = ranks[j][x[ok]] == ranks[j][y[ok]]
        length += same << j
    return length


def longest_previous_factor(s: np.ndarray, depth: int) -> np.ndarray:
    """For each place of ``s``, the length of its longest match that starts earlier, exact below ``depth``.

    Symbols must not be negative. A place after the end differs from every symbol.
    """
    if not len(s):
        return np.empty(0, np.int64)
    ranks = suffix_ranks(s, depth)
    order = np.argsort(ranks[-1], kind="stable")
    out = np.zeros(len(s), np.int64)
    for near in smaller_positions(order):
        has = near >= 0
        out[order[has]] = np.maximum(out[order[has]], common_prefix(ranks, order[has], order[near[has]]))
    return out


class ByteWindows(EarlierWindows):
    result = "_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def __init__(self, k: int = 100, m: int = 32):
        self.k, self.m = k, min(m, k)

    def pieces(self, t: Texts) -> Iterator[tuple[int, int, Texts]]:
        for a, _, s in t.slices():
            if len(s) > 1 or len(s.data) <= 2 * SLICE_UNITS:
                yield a, 0, s
                continue
            for u in range(0, len(s.data), SLICE_UNITS):
                data = s.data[u : u + SLICE_UNITS + self.k - 1]
                yield a, u, Texts(data, np.array([0, len(data)]))

    def grams(self, t):
        p, down = prefix_hash(t.data, BYTE_POWERS)
        owner = np.repeat(np.arange(len(t)), np.diff(t.off))
        k = self.k
        ok = owner[k - 1 :] == owner[: len(owner) - k + 1] if len(owner) >= k else np.zeros(0, bool)
        return seq_hash(p, down, self.m), ok, owner, t.off[:-1]

    def strings(self, t, text, lo, units):
        raw = t.data.tobytes()
        a = t.off[text] + lo
        return [raw[i:j] if j <= e else None for i, j, e in zip(a.tolist(), (a + units).tolist(), t.off[text + 1].tolist(), strict=True)]

    def earlier(self, strings, n, doc):
        size = np.array([len(x) for x in strings])
        flat = np.frombuffer(b"".join(strings), np.uint8)
        begin = np.cumsum(size + 1) - size - 1
        s = np.empty(int((size + 1).sum()), np.int32)
        inside = np.ones(len(s), bool)
        inside[begin + size] = False
        s[inside] = flat
        s[begin + size] = 256 + np.arange(len(size))  # a separator that nothing matches
        lpf = longest_previous_factor(s, self.k)
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return lpf[at] >= self.k

    def window_hashes(self, strings, n):
        p, down = prefix_hash(np.frombuffer(b"".join(strings), np.uint8), BYTE_POWERS)
        size = np.array([len(x) for x in strings])
        return seq_hash(p, down, self.k)[ranges(np.cumsum(size) - size, n)]

    def window_strings(self, strings, owner, at):
        return [strings[i][j : j + self.k] for i, j in zip(owner.tolist(), at.tolist(), strict=True)]

    def rows(self, ids, t, marks):
        gone = np.zeros(len(t.data), bool)
        spans = np.zeros(len(t), np.int64)
        for i, m in enumerate(marks):
            if m is not None:
                flags = np.zeros(t.off[i + 1] - t.off[i], bool)
                for a, n in m.tolist():
                    flags[a : a + n] = True
                c = covered(flags, self.k, len(flags))
                spans[i] = int(c[0]) + int((c[1:] & ~c[:-1]).sum())
                gone[t.off[i] : t.off[i + 1]] = c
        kept = np.zeros(len(gone) + 1, np.int64)
        np.cumsum(~gone, out=kept[1:])
        flat, cut = t.data[~gone].tobytes(), kept[t.off]
        sha = [hashlib.sha256(flat[a:z]).hexdigest() for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        size = np.diff(t.off)
        return pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(size - np.diff(cut)), pa.array(spans), pa.array(sha, pa.string())], names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup_suffixes(docs: DataFrame, k: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    return ByteWindows(k).run(docs, id_col, text_col)
