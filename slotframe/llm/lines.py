"""Line dedup: fuzzy lines by MinHash.

A line is what lies between line ends, without white space around it; empty ones are
left out.  Its character shingles are hashed into the bins of a one-permutation MinHash
signature, empty bins borrow from a neighbour, and runs of bins are band keys.  Lines that
share a band are candidates; the Jaccard similarity of their exact shingle sets decides,
and union-find makes classes of the links.  The first line of a class by (doc_id, line)
stays.

Lines shorter than a shingle are one shingle.  Defined cases: a null or empty text has no
lines; equal lines are one class; null doc_ids come last; repeated rows are copies of
each other, and of those the first occurrence is not unique, so all rows of that id and
line number stay; a line of any length is hashed and compared as a whole; an empty table gives an empty result;
other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, materialize, mix64, trim
from .links import KEYS, classes, id_filter, id_of, pack_keys
from .windows import bucket_count

#: Lines are hashed in runs of about this many characters.
RUN_CHARS = 64 << 10
#: Pairs of lines are compared in runs of so many characters at most, or a pair.
PAIR_CHARS = 1 << 20
#: Draws of a full bin for an empty one.
ATTEMPTS = 4
SPACE = " \t\n\x0b\x0c\r"


def split_lines(text: str | None) -> list[tuple[int, str]]:
    """(number, line) of the lines that aren't empty; numbers count all lines from 0."""
    return [(i, s) for i, x in enumerate((text or "").split("\n")) if (s := x.strip(SPACE))]


def digest(line: str) -> bytes:
    return hashlib.md5(line.encode(), usedforsecurity=False).digest()


#: Powers of an odd base and of its inverse modulo 2**32, grown on demand.
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        up = np.full(max(n, 2 * RUN_CHARS), base, np.uint32)
        up[0] = 1
        _POWERS[base] = np.cumprod(up, dtype=np.uint32)
    return _POWERS[base][:n]


def _characters(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lines, each filled up to ``width``, and the shingles that each has."""
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    if len(sizes) and sizes.min() < width:
        lines = [x.ljust(width, "\0") for x in lines]
    return np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32), np.maximum(sizes - width + 1, 1)


def signatures(lines: list[str], width: int, bins: int) -> np.ndarray:
    """lines x bins one-permutation MinHash values; no line may be empty."""
    c, count = _characters(lines, width)
    # a polynomial hash of each shingle modulo 2**32, from prefix sums and inverse powers
    p = np.zeros(len(c) + 1, np.uint32)
    np.cumsum(c * _powers(0x01000193, len(c)), dtype=np.uint32, out=p[1:])
    h = (p[width:] - p[:-width]) * _powers(pow(0x01000193, -1, 1 << 32), len(c) - width + 1)
    inside = np.ones(len(h), bool)  # shingles that lie in one line
    end = np.cumsum(count + width - 1)[:-1]
    inside[(end[:, None] - np.arange(1, width)).ravel()] = False
    h = h[inside]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0x297A2D39)
    h ^= h >> np.uint32(16)
    sig = np.full(len(lines) * bins, 0xFFFFFFFF, np.uint32)
    at = np.repeat(np.arange(0, len(sig), bins, dtype=np.int64), count)
    at += (h >> np.uint32(16)) * np.uint32(bins) >> np.uint32(16)
    np.minimum.at(sig, at, h)
    sig = sig.reshape(len(lines), bins)
    # an empty bin takes the value of a full one, drawn by a hash of bin and attempt that is the same for all lines
    full = sig != 0xFFFFFFFF
    row, cell = np.nonzero(~full)
    for attempt in range(1, ATTEMPTS + 1):
        other = (mix64(np.arange(bins, dtype=U64) + U64(attempt << 20)) % U64(bins)).astype(np.int64)[cell]
        ok = full[row, other]
        r, x = row[ok], cell[ok]
        sig[r, x] = sig[r, other[ok]] + np.uint32(attempt)
        row, cell = row[~ok], cell[~ok]
    # lines with few shingles have bins left: those take the next full one, around the end
    if len(row):
        few, at = np.unique(row, return_inverse=True)
        twice = np.concatenate([full[few], full[few]], 1)
        place = np.where(twice, np.arange(2 * bins), 2 * bins)
        following = np.minimum.accumulate(place[:, ::-1], 1)[:, ::-1][at, cell]
        sig[row, cell] = sig[row, following % bins] + (following - cell).astype(np.uint32) * np.uint32(0x9E3779B1)
    return sig


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """lines x bands keys of ``rows`` bins each."""
    n, bins = sig.shape
    x = sig.reshape(n, bins // rows, rows).astype(U64)
    key = np.broadcast_to(np.arange(1, bins // rows + 1, dtype=U64), x.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = mix64(key * U64(0xC2B2AE3D27D4EB4F) + x[:, :, k])
    return key


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def shingle_set(line: str, width: int) -> set[str]:
    return {line[i : i + width] for i in range(max(1, len(line) - width + 1))}


def line_shingles(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of a list of lines, repeated ones too, and the first one of each."""
    c, count = _characters(lines, width)
    c = c.astype(U64)
    h = c.copy()
    with np.errstate(over="ignore"):
        for k in range(1, width):
            h = h[:-1] * U64(0xC2B2AE3D27D4EB4F) + c[k:]
    off = np.append(0, np.cumsum(count))
    at = np.arange(off[-1]) + np.repeat(np.arange(len(lines)) * (width - 1), count)
    return mix64(h[at]), off


def packed_shingles(lines: list[str], width: int) -> list[np.ndarray | None]:
    """The distinct shingles of each line as sorted numbers, equal for equal shingles and only for those.

    A number holds the characters' places in the alphabet of the lines, 0 after a line shorter than a shingle. So many
    characters, the most frequent ones, have a place as leave room for ``width`` of them in 64 bits; a line with another one gives None.
    """
    c = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    count = np.bincount(c)
    letters = np.flatnonzero(count)
    bits = 64 // width
    if len(letters) >= 1 << bits:
        letters = letters[np.argsort(-count[letters], kind="stable")[: (1 << bits) - 1]]
    place = np.zeros(len(count), U64)
    place[letters] = np.arange(1, len(letters) + 1)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    end = np.cumsum(size)
    room = np.maximum(size, width)
    off = np.append(0, np.cumsum(room))
    h, n = np.zeros(off[-1], U64), 1  # n characters a number; two numbers make one of up to 2n, where they overlap they agree
    code = place[c]
    h[np.arange(len(c)) + np.repeat(off[:-1] - end + size, size)] = code
    other = np.zeros(len(lines), bool)
    other[np.repeat(np.arange(len(lines)), size)[code == 0]] = True
    while n < width:
        k = min(n, width - n)
        h = h[:-k] << U64(bits * k) | h[k:]
        n += k
    out: list[np.ndarray | None] = []
    for a, z, o in zip(off[:-1].tolist(), (off[1:] - width + 1).tolist(), other.tolist(), strict=True):
        s = np.sort(h[a:z]) if not o else None
        out.append(np.append(s[:1], s[1:][s[1:] != s[:-1]]) if not o else None)
    return out


def similar_lines(left: list[str], right: list[str], width: int, least: float) -> list[bool]:
    if len(left) > 1 and sum(map(len, left)) + sum(map(len, right)) > PAIR_CHARS:
        h = len(left) // 2
        return similar_lines(left[:h], right[:h], width, least) + similar_lines(left[h:], right[h:], width, least)
    lines = list(dict.fromkeys([*left, *right]))
    packed = dict(zip(lines, packed_shingles(lines, width), strict=True))
    sets: dict[str, set] = {}  # of lines with a rare character, and those that they are compared with
    out = []
    for a, b in zip(left, right, strict=True):
        x, y = packed[a], packed[b]
        if x is None or y is None:
            for s in (a, b):
                if s not in sets:
                    sets[s] = shingle_set(s, width)
            out.append(jaccard(sets[a], sets[b]) >= least)
            continue
        n, m = len(x), len(y)
        if min(n, m) < least * max(n, m):
            out.append(False)
            continue
        both = np.sort(np.concatenate((x, y)))
        shared = int(np.count_nonzero(both[1:] == both[:-1]))
        out.append(shared / (n + m - shared) >= least)
    return out


def fuzzy_line_classes(docs: DataFrame, width: int = 8, least: float = 0.8, bands: int = 14, rows: int = 5, id_col="doc_id", text_col="text") -> DataFrame:
    """One row a line: id, line_no, class_doc and class_line (the first line of its class), kept."""
    own = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    buckets = 4 * bucket_count(docs)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = {s: 0 for x in batch.column(0).to_pylist() for _, s in split_lines(x)}
            lines = list(lines)
            found, ids = [], []
            a = 0
            while a < len(lines):
                z, size = a, 0
                while z < len(lines) and (z == a or size + len(lines[z]) <= RUN_CHARS):
                    size += len(lines[z])
                    z += 1
                k = band_keys(signatures(lines[a:z], width, bands * rows), rows)
                found.append(k.ravel())
                ids.append(np.repeat(np.array([id_of(digest(x)) for x in lines[a:z]], np.int64), bands))
                a = z
            if found:
                yield pack_keys(np.concatenate(found), np.concatenate(ids), buckets)
        trim()

    at = None

    def texts(ids: DataFrame) -> DataFrame:
        # one pass gives the place of every line and the texts of lines that may be linked
        nonlocal at
        wanted = id_filter(ids)

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                docs, numbers, which, first = [], [], [], []
                lines: dict[str, int] = {}
                for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for n, s in split_lines(x):
                        k = lines.setdefault(s, len(lines))
                        if k == len(first):
                            first.append(len(which))
                        docs.append(i)
                        numbers.append(n)
                        which.append(k)
                d = [digest(s) for s in lines]
                found = np.array([id_of(x) for x in d], np.int64)
                ok = wanted(found)
                text: list[str | None] = [None] * len(which)
                for s, f, o in zip(lines, first, ok.tolist(), strict=True):
                    if o:
                        text[f] = s
                which = pa.array(which, pa.int64())
                columns = [pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(d, pa.binary()).take(which), pa.array(found, mask=~ok).take(which), pa.array(text, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "line_no", "digest", "id", "text"])
            trim()

        # id is null where a line is not wanted, text also where the batch has the line before
        at = materialize(own.mapInArrow(emit, "_id bigint, line_no int, digest binary, id bigint, text string"), "line-places")
        every = at.filter("text is not null").select("id", "digest", "text")
        return every.join(ids.hint("merge"), "id", "left_semi").groupBy("digest").agg(F.first("id").alias("id"), F.first("text").alias("text"))

    labels = classes(own.select("_text").mapInArrow(keys, KEYS), texts, lambda a, b: similar_lines(a, b, width, least), lambda t: line_shingles(t, width), least, lambda n, m: least / (1 + least) * (n + m) - 1e-9, 256)
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("d"), F.col("line_no").alias("l"))
    firsts = at.groupBy("digest").agg(F.min(place).alias("f"))
    wanted = at.filter("id is not null").groupBy("digest").agg(F.min(place).alias("f"))  # a small part of all lines, with all linked ones
    linked = materialize(wanted.join(labels.withColumnRenamed("node", "digest"), "digest"), "linked-lines")
    heads = linked.groupBy("label").agg(F.min("f").alias("g"))
    linked = linked.join(heads, "label").select("digest", "g")
    firsts = firsts.join(linked, "digest", "left").select("digest", F.coalesce("g", "f").alias("first"))
    out = at.join(firsts, "digest")
    kept = F.col("_id").eqNullSafe(F.col("first.d")) & (F.col("line_no") == F.col("first.l"))
    return out.select(F.col("_id").alias(id_col), "line_no", F.col("first.d").alias("class_doc"), F.col("first.l").alias("class_line"), kept.alias("kept"))
