"""Benchmark decontamination by latent semantic retrieval.

Texts are words of letters and digits, Latin-1 case folded.  The items are the query set;
they go out in blocks of about ``BLOCK``, each with a vocabulary of its own: the words of
its items, for other words add nothing to an inner product with an item.  Three passes over
the corpus for a block:

1. passages of ``PASSAGE`` words that hold each word of the vocabulary;
2. a one-pass randomised SVD of the TF-IDF passage matrix A: B = A'A R for a Gaussian R,
   summed up a tree, gives the leading right singular vectors and values (Nyström form);
3. search: windows as long as an item, a quarter of their length apart, are projected to
   the whitened latent space and compared with the items by cosine, as matrix products.

Words in more than one passage in a hundred have no weight in the latent space, unless an
item would be left with fewer than three words.  A candidate is checked on all its words: the
longest common subsequence of item and window (bit-parallel, all candidates at once), and that
of the item's answer, its last fifth.  It is a leak if ``strict`` of the item's words are there
in order, or ``loose`` of them and ``answer`` of the answer's.

Items of more than 64 words are cut into even pieces, each a query of its own.  What is
gathered from the corpus are sums of fixed size (vocabulary by RANK + OVER columns).

Items of fewer than ``MIN_ITEM`` words say too little for a share of them to be a sign; they are
searched for by their whole word sequence.

Defined cases: null or empty texts and items match nothing; an item with a null id is searched for
like others; equal items of one id are one, of several ids one hit each; of equal hits in a document
the first place counts; repeated rows each have their hits; texts of any length are searched
as a whole; an empty benchmark or corpus gives no hits; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, WORD_POWERS, Texts, Words, prefix_hash, seq_hash, trim
from .windows import estimated_bytes, ranges

RANK, OVER = 64, 8
PASSAGE = 64
BLOCK = 1024
MIN_ITEM = 6
#: Bytes of corpus that one partial sum stands for, at least.
SUM_BYTES = 32 << 20
#: Share of passages from which on a word has no weight, and how many passages that takes at least.
COMMON, COMMON_LEAST = 0.01, 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True


def _words(t: Texts) -> Words:
    """Words of ASCII letters and digits and of all other characters; ASCII and Latin-1 capitals are folded."""
    data = _FOLD[t.data]
    if len(data):
        second = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
        data[1:][second] += 0x20
    return Words(Texts(data, t.off), table=_ALNUM)


class Vocabulary:
    """Distinct word hashes, sorted; ``find`` gives the places of known words and their numbers."""

    def __init__(self, hashes: np.ndarray):
        self.hash = np.unique(hashes)
        self.some = np.zeros(1 << 16, bool)
        self.some[(self.hash >> U64(48)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.hash)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.some[(h >> U64(48)).astype(np.int64)])
        j = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        ok = self.hash[j] == h[at]
        return at[ok], j[ok]


def _passages(w: Words) -> np.ndarray:
    """The passage of each word: runs of PASSAGE words of a text."""
    owner = w.owner()
    local = np.arange(len(w)) - w.off[owner]
    new = np.ones(len(w), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (local[1:] % PASSAGE == 0)
    return np.cumsum(new) - 1


def _tree_sum(parts: DataFrame, kind: type) -> np.ndarray | None:
    """Element-wise sum of the blobs of a table (part, blob): first in 32 places, then in one."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(1):
                x = np.frombuffer(x.as_buffer(), kind)
                total = x.copy() if total is None else np.add(total, x, out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total.tobytes()], pa.binary())], names=["part", "blob"])

    schema = "part bigint, blob binary"
    once = parts.repartition(32, "part").mapInArrow(add, schema)
    row = once.repartition(1).mapInArrow(add, schema).first()
    return None if row is None else np.frombuffer(row["blob"], kind).copy()


def _partials(texts: DataFrame, step, kind: type) -> np.ndarray | None:
    """Sum over the corpus of what ``step(words, total)`` adds to a vector, one vector a task."""
    least = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = texts.coalesce(max(min(least, 12), -(-estimated_bytes(texts) // SUM_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, _, t in Texts.of(batch.column(0)).slices():
                total = step(_words(t), total)
        if total is not None:
            part = int(np.abs(total[:97]).sum()) % 32
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([total.tobytes()], pa.binary())], names=["part", "blob"])

    return _tree_sum(texts.mapInArrow(run, "part bigint, blob binary"), kind)


def document_frequencies(texts: DataFrame, words: Vocabulary) -> np.ndarray:
    """Passages that hold each word; the last cell counts all passages."""
    n = len(words)

    def step(w: Words, total):
        total = np.zeros(n + 1, np.int64) if total is None else total
        if len(w):
            p = _passages(w)
            at, v = words.find(w.hash)
            pairs = np.sort(p[at] * n + v)
            new = np.ones(len(pairs), bool)
            new[1:] = pairs[1:] != pairs[:-1]
            total[:n] += np.bincount(pairs[new] % n, minlength=n)
            total[n] += p[-1] + 1
        return total

    found = _partials(texts, step, np.int64)
    return np.zeros(n + 1, np.int64) if found is None else found


def term_weights(counts: np.ndarray, words: Vocabulary, pieces: list[np.ndarray]) -> np.ndarray:
    """Inverse document frequencies; 0 for common words, except those of pieces with fewer than three others."""
    df, n = counts[:-1], counts[-1]
    common = (df > COMMON * n) & (df > COMMON_LEAST)
    held = common.copy()
    for p in pieces:
        v = np.searchsorted(words.hash, np.unique(p))
        if (~common[v]).sum() < 3:
            held[v] = False
    return np.where(held, 0, np.log((n + 2.0) / (df + 1.0))).astype(np.float32)


def gaussian(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, RANK + OVER), np.float32)


def latent_space(texts: DataFrame, words: Vocabulary, weight: np.ndarray, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors (words x rank) and singular values of the TF-IDF passage matrix."""
    n, held = len(words), []

    def step(w: Words, total):
        if not held:
            held.append(gaussian(n, seed) * weight[:, None])
        total = np.zeros(n * (RANK + OVER), np.float32) if total is None else total
        if len(w):
            at, v = words.find(w.hash)
            on = weight[v] > 0
            at, v = at[on], v[on]
            if len(v):
                p = _passages(w)[at]
                new = np.append(True, p[1:] != p[:-1])
                y = np.add.reduceat(held[0][v], np.flatnonzero(new), axis=0)
                row = np.cumsum(new) - 1
                order = np.argsort(v, kind="stable")
                vs = v[order]
                cut = np.flatnonzero(np.append(True, vs[1:] != vs[:-1]))
                total.reshape(n, -1)[vs[cut]] += np.add.reduceat(y[row[order]], cut, axis=0)
        return total

    found = _partials(texts, step, np.float32)
    if found is None or not found.any():
        return np.zeros((n, 1)), np.ones(1)
    b = found.reshape(n, -1).astype(np.float64) * weight[:, None]
    r = gaussian(n, seed).astype(np.float64)
    shift = 1e-7 * np.linalg.norm(b) + 1e-12
    b += shift * r
    core = r.T @ b
    value, vector = np.linalg.eigh((core + core.T) / 2)
    ok = value > 1e-9 * value.max()
    u, s, _ = np.linalg.svd(b @ (vector[:, ok] / np.sqrt(value[ok])), full_matrices=False)
    keep = np.flatnonzero(s**2 - shift > 1e-6 * s[0] ** 2)[:RANK]
    return u[:, keep], np.sqrt(s[keep] ** 2 - shift)


def _sequences(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of n words."""
    return seq_hash(*prefix_hash(h, WORD_POWERS), n)


@dataclass
class Queries:
    """Pieces of items: hashes of their words, the item each is of, its window length; short items by their number of words."""

    items: list
    words: list[np.ndarray]
    owner: np.ndarray
    length: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # words: sorted hashes of the sequences, the item of each

    @classmethod
    def of(cls, items: list, texts: list) -> Queries:
        w = _words(Texts.of(pa.array([x or "" for x in texts], pa.large_string())))
        pieces, owner, short = [], [], {}
        for i in range(len(items)):
            h = w.hash[w.off[i] : w.off[i + 1]]
            if len(h) >= MIN_ITEM:
                for piece in np.array_split(h, -(-len(h) // 64)):
                    pieces.append(piece)
                    owner.append(i)
            elif len(h):
                short.setdefault(len(h), []).append((int(_sequences(h, len(h))[0]), i))
        n = np.array([len(p) for p in pieces], np.int64)
        classes = np.array([6, 8, 11, 16, 22, 32, 45, 64])
        near = np.abs(np.log(np.maximum(n, 1)[:, None] / classes)).argmin(1) if len(n) else n
        short = {k: (np.array([h for h, _ in sorted(x)], U64), np.array([i for _, i in sorted(x)], np.int64)) for k, x in short.items()}
        return cls(items, pieces, np.array(owner, np.int64), classes[near] if len(n) else n, short)

    def whole(self, w: Words) -> dict[tuple[int, int], tuple]:
        """(text, item) of the short items whose word sequence a text holds, and the hit at the first place."""
        out: dict[tuple[int, int], tuple] = {}
        owner = w.owner()
        for n, (h, item) in self.short.items():
            g = _sequences(w.hash, n)
            a, z = np.searchsorted(h, g, "left"), np.searchsorted(h, g, "right")
            for at in np.flatnonzero(w.inside(n, owner) & (z > a)).tolist():
                for i in item[a[at] : z[at]].tolist():
                    out.setdefault((int(owner[at]), i), (1.0, 1.0, 1.0, int(at - w.off[owner[at]])))
        return out

    def masks(self, words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Sorted numbers piece * len(words) + word and, for each, the bits of the word's places in the piece."""
        found: dict[int, int] = {}
        for q, piece in enumerate(self.words):
            for i, v in enumerate(np.searchsorted(words.hash, piece).tolist()):
                k = q * len(words) + v
                found[k] = found.get(k, 0) | 1 << i
        keys = np.array(sorted(found), np.int64)
        return keys, np.array([found[k] for k in keys.tolist()], U64)


def shared_words(v: np.ndarray, piece: np.ndarray, start: np.ndarray, end: np.ndarray, member: np.ndarray) -> np.ndarray:
    """How many of the words start..end - 1 occur in each candidate's piece."""
    flat, columns = member.ravel(), member.shape[1]
    column, bit = piece // 64, (piece % 64).astype(U64)
    count = np.zeros(len(piece), np.int64)
    for step in range(int((end - start).max(initial=0))):
        at = start + step
        hit = flat[v[np.minimum(at, len(v) - 1)] * columns + column] >> bit & U64(1)
        count += hit.astype(np.int64) * (at < end)
    return count


def common_words(v: np.ndarray, base: np.ndarray, start: np.ndarray, end: np.ndarray, table, full: np.ndarray) -> np.ndarray:
    """Length of a longest common subsequence of each candidate's piece and the known words start..end - 1.

    ``v`` numbers the known words of a slice; a row of the alignment is one 64-bit integer, ``full`` its used bits.
    """
    keys, masks = table
    row = full.copy()
    with np.errstate(over="ignore"):
        for step in range(int((end - start).max(initial=0))):
            at = start + step
            k = base + v[np.minimum(at, len(v) - 1)]
            j = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            m = np.where((keys[j] == k) & (at < end), masks[j], U64(0)) & full
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return np.bitwise_count(full ^ row).astype(np.int64)


@dataclass
class LeakModel:
    queries: Queries
    words: Vocabulary
    embed: np.ndarray  # words x rank: weight times whitened singular vectors
    cosine: float = 0.35
    loose: float = 0.6
    answer: float = 0.8
    strict: float = 0.85

    def prepare(self):
        q = self.queries
        if not q.words:
            return None
        vectors = np.stack([self.embed[np.searchsorted(self.words.hash, w)].sum(0) for w in q.words])
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        n = np.array([len(w) for w in q.words])
        full = np.array([(1 << int(x)) - 1 for x in n], U64)
        tail = np.maximum(2, n // 5)
        last = np.array([((1 << int(t)) - 1) << int(x - t) for x, t in zip(n, tail, strict=True)], U64)
        weighty = np.abs(self.embed).sum(1) > 0
        light = np.array([(~weighty[np.searchsorted(self.words.hash, w)]).sum() for w in q.words])
        member = np.zeros((len(self.words), len(n) // 64 + 1), U64)  # a bit for each word and piece
        for k, piece in enumerate(q.words):
            member[np.searchsorted(self.words.hash, np.unique(piece)), k // 64] |= U64(1 << k % 64)
        return vectors.astype(np.float32), n, full, tail, last, q.masks(self.words), weighty, light, member

    def find(self, t: Texts, ready) -> list[tuple[int, int, int, float, float, float]]:
        """(text, item, first word, cosine, share, answer share) of the leaks of one slice."""
        w = _words(t)
        out = self.queries.whole(w)
        if ready is not None:
            self._near(w, t, ready, out)
        return [(k[0], k[1], h[3], h[2], h[0], h[1]) for k, h in sorted(out.items())]

    def _near(self, w: Words, t: Texts, ready, out: dict[tuple[int, int], tuple]) -> None:
        vectors, n, full, tail, last, table, weighty, light, member = ready
        at, v = self.words.find(w.hash)
        heavy = weighty[v]
        if not heavy.any():
            return
        known = np.zeros(len(w) + 1, np.int64)  # known words before each word
        known[at + 1] = 1
        np.cumsum(known, out=known)
        rare = np.zeros(len(w) + 1, np.int64)  # words of weight before each word
        rare[at[heavy] + 1] = 1
        np.cumsum(rare, out=rare)
        sums = np.zeros((int(heavy.sum()) + 1, self.embed.shape[1]), np.float32)
        v_heavy = v[heavy]
        np.cumsum(self.embed[v_heavy], axis=0, out=sums[1:])
        size = np.diff(w.off)
        for length in np.unique(self.queries.length):
            mine = np.flatnonzero(self.queries.length == length)
            stride = max(1, int(length) // 4)
            count = np.where(size > 0, -(-np.maximum(size - length, 0) // stride) + 1, 0)
            text = np.repeat(np.arange(len(t)), count)
            local = ranges(np.zeros(len(t), np.int64), count) * stride
            start = w.off[text] + np.minimum(local, np.maximum(size[text] - length, 0))
            end = np.minimum(start + length, w.off[text + 1])
            some = rare[end] > rare[start]
            text, start, end = text[some], start[some], end[some]
            found = []
            for a in range(0, len(start), 4096):
                x = sums[rare[end[a : a + 4096]]] - sums[rare[start[a : a + 4096]]]
                norm = np.sqrt(np.einsum("ij,ij->i", x, x))
                near = x @ vectors[mine].T
                r, c = np.nonzero(near >= self.cosine * norm[:, None])
                if not len(r):
                    continue
                row, piece = r + a, mine[c]
                slack = int(length) // 2
                s = np.maximum(start[row] - slack, w.off[text[row]])
                e = np.minimum(end[row] + slack, w.off[text[row] + 1])
                # words of weight that a leak holds at least, even with all its common words
                least = self.loose * n[piece] - light[piece]
                ok = np.flatnonzero(rare[e] - rare[s] >= least)
                row, piece, r, c, s, e = (y[ok] for y in (row, piece, r, c, s, e))
                ok = np.flatnonzero(shared_words(v_heavy, piece, rare[s], rare[e], member) >= least[ok])
                found.append((row[ok], piece[ok], known[s[ok]], known[e[ok]], near[r, c][ok] / np.maximum(norm[r[ok]], 1e-12)))
            if not found:
                continue
            row, piece, s, e, near = (np.concatenate(y) for y in zip(*found, strict=True))
            share = common_words(v, piece * len(self.words), s, e, table, full[piece]) / n[piece]
            ok = np.flatnonzero(share >= self.loose)
            row, piece, s, e, near, share = (y[ok] for y in (row, piece, s, e, near, share))
            tails = common_words(v, piece * len(self.words), s, e, table, last[piece]) / tail[piece]
            for i in np.flatnonzero((share >= self.strict) | (tails >= self.answer)):
                key = int(text[row[i]]), int(self.queries.owner[piece[i]])
                hit = (float(share[i]), float(tails[i]), float(near[i]), int(start[row[i]] - w.off[key[0]]))
                best = out.get(key, hit)
                out[key] = hit if (hit[:3], -hit[3]) > (best[:3], -best[3]) else best


HITS = "array<struct<item_id:bigint,first_word:bigint,cosine:double,lcs_share:double,answer_share:double>>"


def hits_column(text: Column, model: LeakModel) -> Column:
    """The leaks of each text, an empty list where there are none."""

    @F.arrow_udf(HITS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = model.prepare()
        names = ["item_id", "first_word", "cosine", "lcs_share", "answer_share"]
        kind = pa.list_(pa.struct([(x, pa.int64() if i < 2 else pa.float64()) for i, x in enumerate(names)]))
        for column in batches:
            lists: list[list[dict]] = [[] for _ in range(len(column))]
            for a, _, t in Texts.of(column).slices():
                for i, item, *rest in model.find(t, ready):
                    lists[a + i].append(dict(zip(names, (model.queries.items[item], *rest), strict=True)))
            yield pa.array(lists, kind)
        trim()

    return find(text)


def leak_models(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text="text", **limits) -> Iterator[LeakModel]:
    """One model a block of items, each fitted on the whole corpus."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    items = benchmark.select(F.col(item_col).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t")).filter("t is not null").distinct()
    blocks = max(1, -(-2 * items.count() // BLOCK))
    for b in range(blocks):  # a block holds about half of BLOCK items, by a hash of their ids
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        rows.sort(key=lambda r: (r["i"] is not None, r["i"] or 0, r["t"]))
        for a in range(0, len(rows), BLOCK):
            part = rows[a : a + BLOCK]
            queries = Queries.of([r["i"] for r in part], [r["t"] for r in part])
            if not queries.words:
                yield LeakModel(queries, Vocabulary(np.empty(0, U64)), np.empty((0, 1), np.float32), **limits)
            else:
                words = Vocabulary(np.concatenate(queries.words))
                weight = term_weights(document_frequencies(texts, words), words, queries.words)
                u, s = latent_space(texts, words, weight)
                yield LeakModel(queries, words, (weight[:, None] * (u / s)).astype(np.float32), **limits)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """One row a document and item it holds: id, item_id, first_word, cosine, lcs_share, answer_share."""
    out = None
    for model in leak_models(docs, benchmark, text_col, **options):
        hits = docs.select(F.col(id_col), F.explode(hits_column(F.col(text_col).cast("string"), model)).alias("h")).select(id_col, "h.*")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"{id_col} bigint, item_id bigint, first_word bigint, cosine double, lcs_share double, answer_share double")
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col="text", **options) -> DataFrame:
    """The documents that hold no item, with the columns they came with."""
    for model in leak_models(docs, benchmark, text_col, **options):
        docs = docs.filter(F.size(hits_column(F.col(text_col).cast("string"), model)) == 0)
    return docs
