"""Substring dedup by super-k-mer partitioning.

Windows of ``k`` words that share a minimiser and follow each other travel as one packed
string (their words joined by spaces) to the minimiser's bucket.  There the strings are
cut into windows of word numbers, and sorting them counts equal windows exactly.  Every
word covered by a window whose word sequence also starts in a document with a smaller id
is removed; windows are judged on the input.  See ``windows`` for the steps and for how
equal ids, null ids and hot passages are dealt with.

Defined cases: a null or empty text has no words and hashes as the empty string; a text
shorter than a window loses nothing; a window that repeats only inside its own document
stays; repeated rows of one document aren't copies of each other; a text of any length is cut into
overlapping slices, no window is lost; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD_POWERS, Texts, Words, covered, prefix_hash, seq_hash
from .windows import EarlierWindows, SLICE_UNITS, ranges


class WordWindows(EarlierWindows):
    within = False
    result = "_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, n_spans bigint"

    def __init__(self, k: int = 50, m: int = 8):
        self.k, self.m = k, min(m, k)

    def pieces(self, t: Texts) -> Iterator[tuple[int, int, Texts]]:
        for a, _, s in t.slices():
            if len(s) > 1 or len(s.data) <= 4 * SLICE_UNITS:
                yield a, 0, s
                continue
            w = Words(s, hashes=False)
            for u in range(0, max(1, len(w)), SLICE_UNITS):
                v = min(len(w), u + SLICE_UNITS + self.k - 1)
                if v > u:
                    data = s.data[w.start[u] : w.end[v - 1]]
                    yield a, u, Texts(data, np.array([0, len(data)]))

    def grams(self, t):
        w = Words(t)
        owner = w.owner()
        p, down = prefix_hash(w.hash, WORD_POWERS)
        return seq_hash(p, down, self.m), w.inside(self.k, owner), owner, w.off[:-1]

    def strings(self, t, text, lo, units):
        w = Words(t, hashes=False)
        raw, start, end = t.data.tobytes(), w.start.tolist(), w.end.tolist()
        out: list[bytes | None] = []
        a = w.off[text] + lo
        z = a + units
        last = w.off[text + 1]
        # white space between words is a single space nearly always; else split and join
        for i, j, e in zip(a.tolist(), z.tolist(), last.tolist(), strict=True):
            out.append(b" ".join(raw[start[i] : end[j - 1]].split()) if j <= e else None)
        return out

    def earlier(self, strings, n, doc):
        number: dict[bytes, int] = {}
        words = [[number.setdefault(x, len(number)) for x in s.split(b" ")] for s in strings]
        rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(np.array(x, np.int32), self.k) for x in words])
        cells = np.ascontiguousarray(rows).view(np.dtype((np.void, 4 * self.k))).ravel()
        _, first, inverse = np.unique(cells, return_index=True, return_inverse=True)
        owner = np.repeat(doc, n)
        return owner[first[inverse]] != owner

    def window_hashes(self, strings, n):
        w = Words(Texts.of(pa.array(strings, pa.large_binary())))
        p, down = prefix_hash(w.hash, WORD_POWERS)
        return seq_hash(p, down, self.k)[ranges(w.off[:-1], n)]

    def window_strings(self, strings, owner, at):
        out, last, words = [], -1, []
        for i, j in zip(owner.tolist(), at.tolist(), strict=True):
            if i != last:
                last, words = i, strings[i].split(b" ")
            out.append(b" ".join(words[j : j + self.k]))
        return out

    def rows(self, ids, t, marks):
        w = Words(t, hashes=False)
        gone = np.zeros(len(w), bool)
        spans = np.zeros(len(t), np.int64)
        for i, m in enumerate(marks):
            if m is not None:
                flags = np.zeros(w.off[i + 1] - w.off[i], bool)
                for a, n in m.tolist():
                    flags[a : a + n] = True
                c = covered(flags, self.k, len(flags))
                spans[i] = int(c[0]) + int((c[1:] & ~c[:-1]).sum())
                gone[w.off[i] : w.off[i + 1]] = c
        kept = ~gone
        place = np.zeros(len(w) + 1, np.int64)
        np.cumsum(kept, out=place[1:])
        out = np.zeros(len(t.data), bool)
        out[w.is_word] = np.repeat(kept, w.end - w.start)
        total = place[w.off[1:]] - place[w.off[:-1]]
        owner = w.owner()
        not_last = kept & (place[1:] < place[w.off[1:]][owner]) if len(w) else kept
        buf = t.data.copy()
        gap = w.end[not_last]
        out[gap] = True
        buf[gap] = 32
        sizes = np.zeros(len(out) + 1, np.int64)
        np.cumsum(out, out=sizes[1:])
        flat, cut = buf[out].tobytes(), sizes[t.off]
        sha = [hashlib.sha256(flat[a:z]).hexdigest() for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        n_words = np.diff(w.off)
        return pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(n_words - total), pa.array(sha, pa.string()), pa.array(spans)], names=["_id", "n_words", "n_removed", "kept_sha256", "n_spans"])


def dedup_substrings(docs: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, n_removed, kept_sha256, n_spans."""
    return WordWindows(k).run(docs, id_col, text_col)
