"""Earlier copies of fixed-length windows, over a whole corpus.

Shared by the byte-wise and the word-wise operator.  A text is a sequence of units
(bytes or words); a window is ``k`` consecutive units of one text.  Equal windows have
the same minimiser (the smallest hash among their ``m``-grams, leftmost first), so:

1. ``anchors``: each text's minimisers, with the run of windows each governs, go to the
   bucket of their hash as packed arrays.  A batch sends a hash once, however often it
   holds it, and reports its own repetitions itself: a passage that a third of all texts
   share reaches its bucket once a batch.
2. ``survivors``: a bucket tells which anchors occur twice; only their runs go on.
3. ``runs``: the text of a surviving run (a super-k-mer) travels as one packed string to
   the bucket of its hash.  Equal strings of one batch are settled on the spot.
4. ``settle``: a bucket compares its strings exactly (subclass) and marks each window
   start that has an equal, earlier one.
5. ``finish``: marks meet their texts, which yield the result rows (subclass).

Texts are shuffled once, by a hash of id and text; steps 3 and 5 read the same exchange.
Documents are ordered by id, null first, then by a hash of their text; rows equal in both are one
document, whose result each of them gets.  Texts longer than a slice are cut into overlapping
slices.  Strings are compared in pieces of ``PIECE_BYTES``, whole anchors at a time, for equal
windows have equal anchors; the windows of a larger anchor are dealt out by their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Texts, repeated

NULL_ID = -(1 << 63)
#: Units per slice at most: positions within one fit into the low bits of a sort key.
PLACE_BITS = 20
SLICE_UNITS = 1 << 18
#: Bytes of text, by the planner's estimate, that a bucket is made for.
BUCKET_BYTES = 8 << 20
#: Bytes of strings that are compared exactly at a time.
PIECE_BYTES = 1 << 19

ANCHORS = "bucket bigint, h binary, doc binary, lo binary, ext binary, many binary"
PACKED = "bucket bigint, h binary, doc binary, th binary, grp binary, lo binary, n binary, size binary, text binary"
_PACKED_TYPES = {"h": np.uint64, "doc": np.int64, "th": np.int64, "grp": np.uint32, "lo": np.uint32, "n": np.uint32, "size": np.uint32}


def estimated_bytes(df: DataFrame) -> int:
    """The planner's size of a table; 0 where it doesn't know."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < 1 << 52 else 0


def bucket_count(df: DataFrame) -> int:
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-estimated_bytes(df) // BUCKET_BYTES))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def minimiser_runs(grams: np.ndarray, ok: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of each maximal run of valid windows that share their minimiser.

    ``grams[i]`` is the hash of the gram at i, ``ok[j]`` whether window j is valid; a window holds ``width`` grams.
    """
    empty = np.empty(0, U64), np.empty(0, np.int64), np.empty(0, np.int64)
    if not len(ok) or not ok.any():
        return empty
    low = U64((1 << PLACE_BITS) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=U64)
    place = (sliding_min(key, width) & low).astype(np.int64)[: len(ok)]
    at = np.flatnonzero(ok)
    p = place[at]
    first = np.ones(len(at), bool)
    first[1:] = (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)
    start = np.flatnonzero(first)
    return grams[p[start]], at[start], np.diff(np.append(start, len(at)))


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows) with rows in their order."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    for a, z in _cuts(b[1:] != b[:-1], len(b)):
        yield int(b[a]), order[a:z]


def _cuts(changes: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of the runs of n rows that changes part."""
    if n:
        cut = [0, *(np.flatnonzero(changes) + 1).tolist(), n]
        yield from zip(cut[:-1], cut[1:], strict=True)


def _join(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of the next."""
    total = int(size.sum())
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(total)


class EarlierWindows:
    """The five steps; subclasses say what a unit is, how strings compare, and what a text yields."""

    k = m = 0
    result = ""  # schema of the result rows
    #: Whether an equal window counts that starts earlier in the same document.
    within = True

    # -- what subclasses define

    def grams(self, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(gram hashes, valid windows, owner text of each unit, first unit of each text)."""
        raise NotImplementedError

    def pieces(self, t: Texts) -> Iterator[tuple[int, int, Texts]]:
        """(first text, first unit, slice): every window lies in one slice at least."""
        raise NotImplementedError

    def strings(self, t: Texts, text: np.ndarray, lo: np.ndarray, units: np.ndarray) -> list[bytes]:
        """The packed string of each run of units."""
        raise NotImplementedError

    def earlier(self, strings: list[bytes], n: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Flags for all windows of strings, string by string in document order: is there an equal earlier one?"""
        raise NotImplementedError

    def window_hashes(self, strings: list[bytes], n: np.ndarray) -> np.ndarray:
        """A hash of every window of strings, string by string."""
        raise NotImplementedError

    def window_strings(self, strings: list[bytes], owner: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Window at[i] of string owner[i], as a string of its own."""
        raise NotImplementedError

    def rows(self, ids: pa.Array, t: Texts, marks: list[np.ndarray | None]) -> pa.RecordBatch:
        """Result rows; marks[i]: the (start, count) runs of marked windows of text i, or None."""
        raise NotImplementedError

    # -- the steps

    def earlier_bounded(self, strings: list[bytes], n: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """As ``earlier``, ``PIECE_BYTES`` at a time: of many strings only windows whose hash occurs twice, dealt out by that hash."""
        if sum(map(len, strings)) <= 2 * PIECE_BYTES:
            return self.earlier(strings, n, doc)
        owner = np.repeat(np.arange(len(n)), n)
        at = ranges(np.zeros(len(n), np.int64), n)
        h = self.window_hashes(strings, n)
        flag = np.zeros(len(h), bool)
        again = np.flatnonzero(repeated(h)[0])
        again = again[np.argsort(h[again], kind="stable")]
        window_bytes = len(strings[0]) // (int(n[0]) + self.k - 1) * self.k + 1
        step = max(2, 2 * PIECE_BYTES // window_bytes)
        for a, z in _pieces(h[again], np.full(len(again), window_bytes)):
            held = np.empty(0, np.int64)  # of an equal-hash group over several pieces, what isn't a copy goes before the next one
            for b in range(a, z, step):
                some = np.sort(np.append(held, again[b : min(z, b + step)]))
                flag[some] = self.earlier(self.window_strings(strings, owner[some], at[some]), np.ones(len(some), np.int64), doc[owner[some]])
                held = some[~flag[some]]
        return flag

    def anchors(self, docs: DataFrame, buckets: int) -> DataFrame:
        k, width, me = self.k, self.k - self.m + 1, self

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                found: list[tuple] = []
                for first, unit0, t in me.pieces(Texts.of(batch.column(1))):
                    grams, ok, owner, begin = me.grams(t)
                    h, at, n = minimiser_runs(grams, ok, width)
                    if len(h):
                        text = owner[at]
                        found.append((h, ids[first + text], (at - begin[text] + unit0).astype(np.uint32), n.astype(np.uint8)))
                if not found:
                    continue
                h, doc, lo, n = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(h, kind="stable")
                same = h[order[1:]] == h[order[:-1]]
                many = np.zeros(len(h), bool)
                many[order[1:][same]] = many[order[:-1][same]] = True
                again = np.zeros(len(h), bool)
                again[order[1:][same]] = True
                own = np.flatnonzero(many)  # repeated here: they go on as survivors, spread by document
                send = np.flatnonzero(~again)
                bucket = np.concatenate([(h[send] % U64(buckets)).astype(np.int64), -1 - (doc[own] % buckets)])
                rows = np.concatenate([send, own])
                out = [(b, *(c[rows[r]].tobytes() for c in (h, doc, lo, n, many))) for b, r in _split(bucket)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["bucket", "h", "doc", "lo", "ext", "many"])

        assert k - self.m < 255
        return docs.select("_key", "_text").mapInArrow(step, ANCHORS)

    def survivors(self, anchors: DataFrame, groups: int) -> DataFrame:
        def step(table: pa.Table) -> pa.Table:
            bucket = table.column("bucket")[0].as_py()
            h, doc, lo, n, many = (_join(table.column(c), t) for c, t in (("h", np.uint64), ("doc", np.int64), ("lo", np.uint32), ("ext", np.uint8), ("many", bool)))
            if bucket >= 0:
                order = np.argsort(h, kind="stable")
                first = np.ones(len(h), bool)
                first[1:] = h[order[1:]] != h[order[:-1]]
                run = np.cumsum(first) - 1
                size = np.bincount(run)
                hot = np.bincount(run, many[order]) > 0
                go = np.zeros(len(h), bool)
                go[order] = ((size > 1) | hot)[run]
                go &= ~many  # those went on from their own batch
                h, doc, lo, n = h[go], doc[go], lo[go], n[go]
            group = _group(doc, groups)
            out = [(b, h[r].tobytes(), doc[r].tobytes(), lo[r].tobytes(), n[r].tobytes()) for b, r in _split(group)]
            return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=names)

        names, kinds = ["grp", "h", "doc", "lo", "ext"], [pa.int64(), *[pa.binary()] * 4]
        return anchors.groupBy("bucket").applyInArrow(step, "grp bigint, h binary, doc binary, lo binary, ext binary")

    def runs(self, docs: DataFrame, survivors: DataFrame, buckets: int) -> DataFrame:
        me = self

        def step(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if left.num_rows and right.num_rows:
                h, doc, lo, n = (_join(right.column(c), t) for c, t in (("h", np.uint64), ("doc", np.int64), ("lo", np.uint32), ("ext", np.uint8)))
                order = np.lexsort((lo, doc))
                h, doc, lo, n = h[order], doc[order], lo[order].astype(np.int64), n[order].astype(np.int64)
                left = left.combine_chunks()
                ids = left.column("_id").fill_null(NULL_ID).to_numpy()
                th, key = left.column("_th").to_numpy(), left.column("_key").to_numpy()
                group = left.column("_grp")[0].as_py()
                texts = Texts.of(left.column("_text"))
                a, z = np.searchsorted(doc, key, "left"), np.searchsorted(doc, key, "right")
                packed: list[tuple] = []
                for first, last, t in texts.slices():
                    size = z[first:last] - a[first:last]
                    if not size.any():
                        continue
                    at = ranges(a[first:last], size)
                    text = np.repeat(np.arange(last - first), size)
                    s = me.strings(t, text, lo[at], n[at] + me.k - 1)
                    good = np.array([x is not None for x in s], bool)
                    packed.append((h[at][good], ids[first:last][text[good]], th[first:last][text[good]], lo[at][good], n[at][good], [x for x in s if x is not None]))
                if packed:
                    strings = [x for p in packed for x in p[5]]
                    h, doc, th, lo, n = (np.concatenate([p[i] for p in packed]) for i in range(5))
                    send, marked = _settle_equal(strings, h, doc, th, lo, me.within)
                    grp = np.full(len(h), group, np.uint32)
                    out = _pack((h % U64(buckets)).astype(np.int64), send, h, doc, th, grp, lo, n, strings)
                    out += _pack(np.full(len(h), -1 - group % buckets), marked, h, doc, th, grp, lo, n, None)
            return _table(out)

        return docs.groupBy("_grp").cogroup(survivors.groupBy("grp")).applyInArrow(step, PACKED)

    def settle(self, packed: DataFrame, groups: int) -> DataFrame:
        me = self

        def step(table: pa.Table) -> pa.Table:
            bucket = table.column("bucket")[0].as_py()
            c = {name: _join(table.column(name), kind) for name, kind in _PACKED_TYPES.items()}
            if bucket < 0:
                doc, th, grp, lo, n = c["doc"], c["th"], c["grp"], c["lo"], c["n"].astype(np.int64)
            else:
                blob = b"".join(table.column("text").to_pylist())
                ends = np.cumsum(c["size"].astype(np.int64))
                strings = [blob[e - s : e] for e, s in zip(ends, c["size"].tolist(), strict=True)]
                h, doc, th, grp, lo, n = c["h"], c["doc"], c["th"], c["grp"], c["lo"], c["n"].astype(np.int64)
                keep, marked = _settle_equal(strings, h, doc, th, lo, me.within)
                # distinct strings of an anchor that has several
                k = h[keep]
                order = np.argsort(k, kind="stable")
                same = k[order[1:]] == k[order[:-1]]
                several = np.zeros(len(k), bool)
                several[order[1:][same]] = several[order[:-1][same]] = True
                left = keep[several]
                left = left[np.lexsort((lo[left], th[left], doc[left], h[left]))]
                parts = [(doc[marked], th[marked], grp[marked], lo[marked].astype(np.int64), n[marked])]
                for a, z in _pieces(h[left], c["size"][left]):
                    some = left[a:z]
                    some = some[np.lexsort((lo[some], th[some], doc[some]))]
                    flag = me.earlier_bounded([strings[i] for i in some], n[some], doc[some])
                    owner = np.repeat(some, n[some])
                    start = ranges(lo[some].astype(np.int64), n[some])
                    begin = flag.copy()
                    begin[1:] &= ~(flag[:-1] & (owner[1:] == owner[:-1]))
                    end = flag.copy()
                    end[:-1] &= ~(flag[1:] & (owner[1:] == owner[:-1]))
                    b, e = np.flatnonzero(begin), np.flatnonzero(end)
                    parts.append((doc[owner[b]], th[owner[b]], grp[owner[b]], start[b], e - b + 1))
                doc, th, grp, lo, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            group = grp.astype(np.int64)
            out = [(g, doc[r].tobytes(), th[r].tobytes(), lo[r].astype(np.int64).tobytes(), n[r].tobytes()) for g, r in _split(group)]
            return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=names)

        names, kinds = ["grp", "doc", "th", "lo", "n"], [pa.int64(), *[pa.binary()] * 4]
        return packed.groupBy("bucket").applyInArrow(step, "grp bigint, doc binary, th binary, lo binary, n binary")

    def finish(self, docs: DataFrame, marks: DataFrame) -> DataFrame:
        me = self

        def step(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.combine_chunks()
            ids = left.column("_id")
            texts = Texts.of(left.column("_text"))
            doc, th, lo, n = (_join(right.column(c), np.int64) for c in ("doc", "th", "lo", "n"))
            order = np.lexsort((lo, th, doc))
            doc, th, lo, n = doc[order], th[order], lo[order], n[order]
            keys = {}
            for a, z in _cuts((doc[1:] != doc[:-1]) | (th[1:] != th[:-1]), len(doc)):
                keys[doc[a], th[a]] = np.stack([lo[a:z], n[a:z]], 1)
            hashes = left.column("_th").to_numpy()
            known = ids.fill_null(NULL_ID).to_numpy()
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            out = [me.rows(ids.slice(a, z - a), t, [keys.get((known[i], hashes[i])) for i in range(a, z)]) for a, z, t in texts.slices()]
            return pa.Table.from_batches(out) if out else me.empty()

        return docs.groupBy("_grp").cogroup(marks.groupBy("grp")).applyInArrow(step, self.result)

    def empty(self) -> pa.Table:
        t = Texts(np.empty(0, np.uint8), np.zeros(1, np.int64))
        return pa.Table.from_batches([self.rows(pa.array([], pa.int64()), t, [])])

    def run(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        parts = bucket_count(docs)
        buckets = groups = 2 * parts  # more groups than partitions, so that partitions come out even
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        own = docs.select(F.col(id_col).cast("bigint").alias("_id"), text.alias("_text"))
        own = own.withColumn("_key", F.xxhash64("_id", "_text"))  # rows that share it share their runs, which are compared exactly
        keyed = own.withColumns({"_th": F.xxhash64("_text"), "_grp": F.pmod("_key", F.lit(groups))}).repartition(parts, "_grp")
        survivors = self.survivors(self.anchors(own, buckets), groups)
        marks = self.settle(self.runs(keyed, survivors, buckets), groups)
        return self.finish(keyed, marks).withColumnRenamed("_id", id_col)


def _group(doc: np.ndarray, groups: int) -> np.ndarray:
    return doc % groups  # numpy's remainder is never negative: Spark's pmod


def _settle_equal(strings: list[bytes], h, doc, th, lo, within: bool) -> tuple[np.ndarray, np.ndarray]:
    """(strings of an anchor that go on, those with an equal one that counts as earlier); a repeated row goes once.

    Where copies inside a document don't count, equal strings of the first document all go on.
    """
    order = np.lexsort((lo, th, doc))
    seen: dict[tuple, int] = {}
    keep, marked = [], []
    here = None
    places = list(zip(doc.tolist(), th.tolist(), lo.tolist(), strict=True))
    hs = h.tolist()
    for i in order.tolist():
        if places[i] == here:
            continue
        here = places[i]
        first = seen.setdefault((hs[i], strings[i]), i)
        (keep if first == i or (not within and places[first][0] == here[0]) else marked).append(i)
    return np.array(keep, np.int64), np.array(marked, np.int64)


def _pieces(h: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of whole anchors, sorted by h, of about PIECE_BYTES; a larger anchor comes alone."""
    first, total = 0, 0
    for a, z in _cuts(h[1:] != h[:-1], len(h)):
        more = int(size[a:z].sum())
        if total and total + more > PIECE_BYTES:
            yield first, a
            first, total = a, 0
        total += more
    if total:
        yield first, len(h)


def _pack(bucket, rows, h, doc, th, grp, lo, n, strings) -> list[tuple]:
    out = []
    for b, r in _split(bucket[rows]):
        r = rows[r]
        text = [strings[i] for i in r.tolist()] if strings else []
        size = np.array([len(x) for x in text] if strings else np.zeros(len(r)), np.uint32)
        out.append((b, h[r].tobytes(), doc[r].tobytes(), th[r].tobytes(), grp[r].tobytes(), lo[r].astype(np.uint32).tobytes(), n[r].astype(np.uint32).tobytes(), size.tobytes(), b"".join(text)))
    return out


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), *[pa.binary()] * 8]
    names = ["bucket", *_PACKED_TYPES, "text"]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names=names)
