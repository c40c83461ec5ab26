"""Helpers shared by the text operators: scratch storage and byte-level numpy text primitives."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: The white space bytes that separate words, 0x20 and 0x09-0x0D.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same as a class for regular expressions of Java, Python and RE2.
WORD_RE = r"[^\x20\x09-\x0D]+"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE_BYTES)] = True
IS_WORD = ~IS_SPACE
#: Texts are worked on in slices of about this many bytes, which keeps 64-bit temporaries small.
SLICE_BYTES = 128 << 10


# ---------------------------------------------------------------- scratch


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary one; on a cluster that is an error, for
    executors don't see the driver's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="slotframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Scratch folders of this driver, in order; :func:`release_since` deletes them.
_MADE: list[str] = []


def new_dir(spark: SparkSession, tag: str) -> str:
    top = f"{shared_dir(spark)}/slotframe/{uuid.uuid4().hex}"
    _MADE.append(top)
    return f"{top}/{tag}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(*frames: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(df.sparkSession, path)


def scratch_mark() -> int:
    return len(_MADE)


def release_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Delete all scratch folders made since :func:`scratch_mark`, but for those of ``keep``."""
    held = [getattr(df, "_scratch_path", "") for df in keep]
    for top in _MADE[mark:]:
        if not any(x.startswith(top) for x in held):
            _delete(spark, top)
    _MADE[mark:] = [top for top in _MADE[mark:] if any(x.startswith(top) for x in held)]


def spare(columns: list[str], *names: str) -> list[str]:
    """Names like ``names`` that none of the columns has, whatever its case."""
    held, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in held:
            n = f"_{n}"
        held.add(n.lower())
        out.append(n)
    return out


def trim() -> None:
    """Give memory that a finished task has freed back to the system, for workers are kept."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# ---------------------------------------------------------------- hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multiplications); returns a new array."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(32))
        x *= U64(0xD6E8FEB86659FD93)
        x ^= x >> U64(32)
        x *= U64(0xD6E8FEB86659FD93)
        x ^= x >> U64(32)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.n = 0
        self.up = self.down = np.empty(0, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 12, 2 * self.n)
            self.up, self.down = self._table(self.base), self._table(self.inverse)
        return self.up[:n], self.down[:n]

    def _table(self, b: int) -> np.ndarray:
        t = np.full(self.n, b, U64)
        t[0] = 1
        with np.errstate(over="ignore"):
            return np.cumprod(t, dtype=U64)


BYTE_POWERS = Powers(0x9E3779B97F4A7C15)
WORD_POWERS = Powers(0xC2B2AE3D27D4EB4F)


def prefix_hash(values: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash and the factors that bring a slice back to power 0."""
    up, down = powers.upto(len(values) + 1)
    p = np.empty(len(values) + 1, U64)
    p[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(values.astype(U64) * up[:-1], out=p[1:])
    return p, down


def span_hash(p: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each slice [start, end), equal for equal slices."""
    with np.errstate(over="ignore"):
        return mix64((p[end] - p[start]) * down[start] + (end - start).astype(U64))


def seq_hash(p: np.ndarray, down: np.ndarray, n: int) -> np.ndarray:
    """Hash of every slice of length n."""
    if len(p) <= n:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        return mix64((p[n:] - p[:-n]) * down[: len(p) - n])


# ---------------------------------------------------------------- texts as bytes


class Texts:
    """UTF-8 bytes of several texts back to back; text i is data[off[i]:off[i+1]]; a null text is empty."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            column = column.cast(pa.large_binary())
        elif pa.types.is_large_string(column.type):
            column = column.cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        _, off, data = column.buffers()
        off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        return cls(data[off[0] : off[-1]], off - off[0])

    def __len__(self) -> int:
        return len(self.off) - 1

    def slices(self, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
        """Runs of whole texts of about ``most`` bytes: (first, last + 1, texts). A longer text comes alone."""
        i, n = 0, len(self)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.off, self.off[i] + most, "right")) - 1)
            j = min(j, n)
            yield i, j, Texts(self.data[self.off[i] : self.off[j]], self.off[i : j + 1] - self.off[i])
            i = j


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts: byte spans, 64-bit hashes, and the first word of each text in ``off``."""

    def __init__(self, t: Texts, hashes: bool = True, table: np.ndarray = IS_WORD):
        data, n = t.data, len(t.data)
        word = table[data]
        edge = np.zeros(n + 1, bool)
        edge[t.off] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = word[:-1]
            before &= ~edge[:-1]
        self.start = np.flatnonzero(word & ~before)
        after = np.empty(n, bool)
        if n:
            after[-1] = False
            after[:-1] = word[1:]
            after &= ~edge[1:]
        self.end = np.flatnonzero(word & ~after) + 1
        self.off = np.searchsorted(self.start, t.off)
        self.text = t
        self.is_word = word
        if hashes:
            self.p, self.down = prefix_hash(data, BYTE_POWERS)
            self.hash = span_hash(self.p, self.down, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))

    def inside(self, n: int, owner: np.ndarray) -> np.ndarray:
        """Whether the n words from each word on lie in one text; one flag for each of len - n + 1 words."""
        if len(self) < n:
            return np.zeros(0, bool)
        return owner[n - 1 :] == owner[: len(owner) - n + 1]


def per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over [off[i], off[i+1])."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it there twice or more, and is it there earlier?"""
    twice, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        again[order[1:][same]] = True
        twice |= again
        twice[order[:-1][same]] = True
    return twice, again


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + length) for a flagged start s (``starts``: one flag a start)."""
    delta = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(starts)
    delta[at] += 1
    np.subtract.at(delta, at + length, 1) if len(at) else None
    return np.cumsum(delta[:-1]) > 0
