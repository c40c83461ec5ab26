"""MinHash near-dedup with order-sensitive sketches (Order MinHash).

A document is its sequence of five-word shingles, each labelled with the number of its
occurrence.  A sketch takes the ``size`` labelled shingles of least hash and keeps them
in text order, so it agrees for two texts about as often as an edit keeps both the
shingles and their order.  Documents that share one of ``count`` sketches are candidates;
a candidate is verified by a banded alignment of the two word sequences: similar are those
whose aligned words are 0.8 or more of the words of the longer text (an edit similarity: a
changed, missing or added word costs one, not the five shingles it is part of).

Of pairs with 5 % of the words changed nearly all share a sketch, with 10 % about 95 in a
hundred; ``tests/llm`` measures it.

Defined cases: a null text is empty; equal texts are one class before any sketch; texts
of fewer than five words join only equal ones; a class has the least doc_id of its
documents as its id (null ids last); repeated rows are copies of each other, of which
:func:`drop_near_duplicates` keeps one; a text of any length is sketched as a whole; an empty
table gives an empty result; other columns may have any name and come back as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WORD_POWERS, Texts, Words, materialize, mix64, prefix_hash, seq_hash, spare, trim
from .links import KEYS, classes, digest_columns, id_filter, pack_keys
from .windows import bucket_count

#: Bits of a sort key that hold a shingle's place; texts with more shingles are sketched by exact hashes.
PLACE_BITS = 24


def shingles(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of all texts, and the first one of each text."""
    w = Words(t)
    owner = w.owner()
    ok = w.inside(width, owner)
    p, down = prefix_hash(w.hash, WORD_POWERS)
    return seq_hash(p, down, width)[ok], np.append(0, np.cumsum(np.maximum(np.diff(w.off) - width + 1, 0)))


def labelled(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hashes that also tell the occurrences of a shingle in its text apart."""
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off)).astype(U64)
    key = mix64(owner + U64(1)) ^ h
    order = np.argsort(key, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    place = np.arange(len(h))
    nth = np.empty(len(h), U64)
    nth[order] = place - np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else place
    with np.errstate(over="ignore"):
        return h + nth * U64(0x9FB21C651E98DF25)


def order_sketches(h: np.ndarray, off: np.ndarray, count: int, size: int) -> np.ndarray:
    """texts x count sketch hashes, for texts with at least one shingle (rows of ``off`` that aren't empty)."""
    full = np.flatnonzero(np.diff(off))
    begin, lengths = off[full], np.diff(off)[full]
    low = U64((1 << PLACE_BITS) - 1)
    exact = len(full) > 0 and int(lengths.max()) > 1 << PLACE_BITS  # places don't fit beside the hash
    place = (np.arange(len(h)) - np.repeat(begin, lengths)).astype(U64)
    out = np.empty((len(full), count), U64)
    with np.errstate(over="ignore"):
        for s in range(count):
            x = (h ^ U64(0xA24BAED4963EE407 * (2 * s + 1) & (1 << 64) - 1)) * U64(0xD6E8FEB86659FD93)
            x ^= x >> U64(32)
            x *= U64(0x9E3779B97F4A7C15)
            if not exact:
                x = x & ~low | place
            taken = np.full((len(full), size), -1, np.int64)
            for k in range(size):
                least = np.minimum.reduceat(x, begin)
                if exact:
                    hit = np.flatnonzero(x == np.repeat(least, lengths))
                    at = hit[np.searchsorted(hit, begin)] - begin
                else:
                    at = (least & low).astype(np.int64)
                there = lengths > k
                taken[there, k] = at[there]
                x[(begin + at)[there]] = U64((1 << 64) - 1)
            taken.sort(axis=1)
            sketch = np.full(len(full), s + 1, U64)
            for k in range(size):
                part = np.where(taken[:, k] >= 0, h[begin + np.maximum(taken[:, k], 0)], U64(k))
                sketch = mix64(sketch * U64(0xC2B2AE3D27D4EB4F) + part)
            out[:, s] = sketch
    return out


def banded_common(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of two sequences whose matches lie within ``band`` of the diagonal.

    Bit-parallel: one integer holds a row of the alignment, an addition carries along it.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, window = full, (1 << (2 * band + 1)) - 1
    for j, x in enumerate(b.tolist()):
        match = places.get(x, 0)
        if match:
            match &= window << (j - band) if j > band else window >> (band - j)
            hit = row & match
            row = ((row + hit) | (row - hit)) & full
    return head + tail + len(a) - row.bit_count()


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Aligned words over the words of the longer text, or 0 where that can't reach ``least``."""
    n, m = len(a), len(b)
    most = max(n, m)
    need = int(np.ceil(least * most - 1e-9))
    if not n or not m or min(n, m) < need:
        return 0.0
    counts: dict[int, int] = {}
    for x in a.tolist():
        counts[x] = counts.get(x, 0) + 1
    shared = 0
    for x in b.tolist():
        c = counts.get(x, 0)
        if c:
            shared += 1
            counts[x] = c - 1
    if shared < need:  # too few words in common, whatever their order
        return 0.0
    common = banded_common(a, b, most - need)  # an alignment of need words strays no further from the diagonal
    return common / most if common >= need else 0.0


def word_sequences(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a list of texts, and the first one of each."""
    hashes, off = [np.empty(0, U64)], [np.zeros(1, np.int64)]
    for _, _, t in Texts.of(pa.array([x or "" for x in texts], pa.large_string())).slices():
        w = Words(t)
        hashes.append(w.hash)
        off.append(off[-1][-1] + w.off[1:])
    return np.concatenate(hashes), np.concatenate(off)


def labelled_words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The same, with the occurrences of a word in its text told apart."""
    h, off = word_sequences(texts)
    return labelled(h, off), off


def similar_texts(left: list, right: list, least: float) -> list[bool]:
    out = []
    for s in range(0, len(left), 64):
        sequences = []
        for part in (left[s : s + 64], right[s : s + 64]):
            h, off = word_sequences(part)
            sequences.append([h[i:j] for i, j in zip(off[:-1], off[1:], strict=True)])
        out += [aligned_similarity(a, b, least) >= least for a, b in zip(*sequences, strict=True)]
    return out


def near_classes(docs: DataFrame, width: int = 5, least: float = 0.8, count: int = 16, size: int = 2, id_col="doc_id", text_col="text") -> DataFrame:
    """(node, label) of the digests of texts that are linked with others: texts of one class share their label, a digest."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(text.alias("text")).withColumns(digest_columns(F.col("text")))
    buckets = 4 * bucket_count(docs)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            keys, owners = [], []
            for first, _, t in Texts.of(batch.column(1)).slices():
                h, off = shingles(t, width)
                if len(h):
                    s = order_sketches(labelled(h, off), off, count, size)
                    keys.append(s.ravel())
                    owners.append(np.repeat(ids[first + np.flatnonzero(np.diff(off))], count))
            if keys:
                yield pack_keys(np.concatenate(keys), np.concatenate(owners), buckets)
        trim()

    keys = own.select("id", "text").mapInArrow(sketch, KEYS)

    def texts(ids: DataFrame) -> DataFrame:
        test = id_filter(ids)
        wanted = F.pandas_udf(lambda x: pd.Series(test(x.to_numpy())), "boolean")
        # a merge join at every size: disk use then grows with the input, not with a change of plan
        return own.filter(wanted("id")).join(ids.hint("merge"), "id", "left_semi").groupBy("digest").agg(F.first("id").alias("id"), F.first("text").alias("text"))

    return classes(keys, texts, lambda a, b: similar_texts(a, b, least), labelled_words, least, lambda n, m: np.ceil(least * np.maximum(n, m) - 1e-9))


def _classes(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """(_id, digest, class) rows: each distinct pair of id and text, its class a digest."""
    labels = near_classes(docs, id_col=id_col, text_col=text_col, **options)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("bigint").alias("_id"), digest_columns(text)["digest"].alias("digest"))
    labels = labels.select(F.col("node").alias("digest"), "label")
    return own.join(labels, "digest", "left").withColumn("label", F.coalesce("label", "digest"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document: id, class_id (the least id of its class), class_size, kept (it is the class's document)."""
    rows = materialize(_classes(docs, id_col, text_col, **options), "classes")
    heads = rows.groupBy("label").agg(F.min("_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    out = rows.join(heads, "label").withColumn("kept", F.col("_id").eqNullSafe(F.col("class_id")))
    return out.select(F.col("_id").alias(id_col), "class_id", "class_size", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, with the columns it came with: that of the least id, one row of it."""
    rows = materialize(_classes(docs, id_col, text_col, **options), "classes")
    stay = rows.groupBy("label").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), "digest")).alias("s"))
    ident, digest = spare(docs.columns, "_stay_id", "_stay_digest")
    stay = materialize(stay.select(F.col("s.i").alias(ident), F.col("s.digest").alias(digest)), "kept-texts")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = docs.join(stay, F.col(id_col).cast("bigint").eqNullSafe(F.col(ident)) & (digest_columns(text)["digest"] == F.col(digest)), "left_semi")
    twice = rows.groupBy("_id", "digest").count().filter("count > 1")
    if twice.isEmpty():
        return kept
    # rows that share id and text: one of each stays
    return kept.dropDuplicates([id_col, text_col])
