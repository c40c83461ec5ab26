"""Quality rules: repetition coverage.

Rolling hashes of several n-gram lengths, in numpy over the bytes of a batch of
texts, measure how many characters lie inside n-grams and lines that the same
text has already shown.  A text is rejected by the base rule (few words, or many
words in repeated windows) or when any coverage exceeds its limit.

Defined cases: a null or empty text has no words, so the base rule rejects it; a
repeated row is judged like any other; other columns are never touched, whatever
their names.  Texts of any length are judged whole: a text longer than a slice is
a slice of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_POWERS, Texts, Words, covered, mix64, per_text, prefix_hash, repeated, seq_hash, span_hash

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Limits:
    """Shares of a text's word characters inside repeated n-grams, and of its lines."""

    ngrams: tuple[tuple[int, float], ...] = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))
    lines: float = 0.30
    line_chars: float = 0.20
    window: int = 5
    min_words: int = 10
    max_repeat_percent: int = 20


FIELDS = [
    ("n_words", pa.int64()),
    ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()),
    ("dup_line_share", pa.float64()),
    ("dup_line_char_share", pa.float64()),
    ("dup_ngram_excess", pa.float64()),
    ("base_failed", pa.bool_()),
    ("kept", pa.bool_()),
]
SCHEMA = "struct<" + ",".join(f"{n}:{ {'int64': 'bigint', 'double': 'double', 'bool': 'boolean'}[str(t)]}" for n, t in FIELDS) + ">"


def measure(t: Texts, limits: Limits) -> dict[str, np.ndarray]:
    """Every measure of every text of one slice."""
    n = len(t)
    w = Words(t)
    owner = w.owner()
    n_words = np.diff(w.off)
    points = np.zeros(len(t.data) + 1, np.int64)  # code points before each byte
    np.cumsum((t.data & 0xC0) != 0x80, out=points[1:])
    chars = points[w.end] - points[w.start]
    word_chars = per_text(chars, w.off)
    salt = mix64(owner.astype(np.uint64) + np.uint64(1))

    # lines: spans between line ends, of one text
    ends = np.flatnonzero(t.data == 10)
    line_start = np.unique(np.concatenate([ends + 1, t.off[:-1]]))
    line_start = line_start[line_start < len(t.data)]
    line_owner = np.searchsorted(t.off, line_start, "right") - 1
    line_end = np.minimum(np.append(ends, len(t.data))[np.searchsorted(ends, line_start)], t.off[line_owner + 1])
    first_word = np.searchsorted(w.start, line_start)
    has_word = np.searchsorted(w.start, line_end) > first_word
    line_start, line_end, line_owner = line_start[has_word], line_end[has_word], line_owner[has_word]
    key = span_hash(w.p, w.down, line_start, line_end) ^ mix64(line_owner.astype(np.uint64) + np.uint64(1))
    _, line_again = repeated(key)
    n_lines = np.bincount(line_owner, minlength=n)
    n_dup_lines = np.bincount(line_owner[line_again], minlength=n)
    line_chars = points[line_end] - points[line_start]
    all_line_chars = np.bincount(line_owner, line_chars, n)
    dup_line_chars = np.bincount(line_owner[line_again], line_chars[line_again], n)

    # n-grams of words: those of the shortest length that repeat decide where longer ones can
    p, down = prefix_hash(w.hash, WORD_POWERS)

    def windows(size: int) -> tuple[np.ndarray, np.ndarray]:
        ok = w.inside(size, owner)
        twice, again = np.zeros(len(ok), bool), np.zeros(len(ok), bool)
        at = np.flatnonzero(ok)
        if len(at):
            twice[at], again[at] = repeated(seq_hash(p, down, size)[at] ^ salt[at])
        return twice, again

    twice, again = windows(limits.window)
    n_repeat = per_text(covered(twice, limits.window, len(w)), w.off)
    excess = np.full(n, -1.0)
    some = twice.any()
    for size, limit in limits.ngrams:
        if size == limits.window:
            hit = again
        elif some or size < limits.window:
            hit = windows(size)[1]
        else:
            hit = np.zeros(0, bool)
        inside = per_text(np.where(covered(hit, size, len(w)), chars, 0), w.off) if hit.any() else np.zeros(n)
        excess = np.maximum(excess, inside / np.maximum(word_chars, 1) - limit)
    base = (n_words < limits.min_words) | (100 * n_repeat > limits.max_repeat_percent * n_words)
    line_share = n_dup_lines / np.maximum(n_lines, 1)
    line_char_share = dup_line_chars / np.maximum(all_line_chars, 1)
    ok = ~base & (excess <= 0) & (line_share <= limits.lines) & (line_char_share <= limits.line_chars)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": per_text(SYMBOLS[t.data], t.off),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
        "dup_line_share": line_share,
        "dup_line_char_share": line_char_share,
        "dup_ngram_excess": excess,
        "base_failed": base,
        "kept": ok,
    }


def quality_column(text, limits: Limits = Limits()):
    """A struct column with the measures and the verdict of a text column."""

    @F.arrow_udf(SCHEMA)
    def judge(column: pa.Array) -> pa.Array:
        parts = [measure(t, limits) for _, _, t in Texts.of(column).slices()]
        arrays = [pa.array(np.concatenate([p[name] for p in parts]) if parts else [], kind) for name, kind in FIELDS]
        return pa.StructArray.from_arrays(arrays, [name for name, _ in FIELDS])

    return judge(text)


def score_quality(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, the measures and ``kept``."""
    return docs.select(F.col(id_col), quality_column(F.col(text_col).cast("string"), limits).alias("q")).select(id_col, "q.*")


def filter_quality(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    return docs.filter(quality_column(F.col(text_col).cast("string"), limits)["kept"])
