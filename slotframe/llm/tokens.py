"""Token ids in Arrow files of equal-length sequences.

Documents are range-partitioned and sorted by id; each partition encodes its texts,
appends an end id to each and writes one Arrow IPC file (the stream format between a
header and a footer) whose record batches hold fixed-size lists: ``ids`` (unsigned,
16 bits where the vocabulary allows) and ``mask`` (bits; false on padding, which only
the last sequence of a file has).  Batches have equal row counts and are not
compressed, so sequence i of a memory-mapped file is a slice: no bytes are copied.
A second file beside it lists the documents: id, first id and number of ids.

A file appears under its final name only when complete, under a name of the task
attempt; the manifest, a small table, names the attempts that count.  Lost executors
therefore leave at most unnamed files behind.

Defined cases: a null or empty text is the end id alone; a null doc_id comes first;
repeated doc_ids are kept, ordered by text; a text of any length is encoded as a whole; an empty
table gives an empty manifest; other columns may have any name.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Texts, new_dir, trim
from .windows import ranges

#: Chunks whose ids a worker keeps in each of two generations, and the bytes of a chunk that is kept: 40 MB or so each.
CACHE_CHUNKS, CACHE_CHUNK_BYTES = 180_000, 48
#: Bytes of text that are cut into chunks at a time.
ENCODE_BYTES = 4 << 20
#: Sequences in a record batch.
BATCH_ROWS = 256
#: Classes of bytes that the pre-tokeniser tells apart.  Two-byte letters start with 0xC3 (but for the two signs
#: 0xC3 0x97 and 0xC3 0xB7), 0xD0 or 0xD1; all other bytes beyond ASCII, and controls, may be anything.
ANYTHING, LETTER, DIGIT, SIGN, SPACE = range(5)
_CLASS = np.full(256, ANYTHING, np.uint8)
_CLASS[0x21:0x7F] = SIGN
_CLASS[0x30:0x3A] = DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _CLASS[[0xC3, 0xD0, 0xD1]] = LETTER
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = SPACE
#: First bytes of a character that is surely not white space: visible ASCII, and lead bytes but those of Unicode's spaces.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = _VISIBLE[0xC3:0xF5] = True
_VISIBLE[0xE1:0xE4] = False
#: A chunk that the pre-tokeniser leaves whole: a space or none, then characters of one class.
_SINGLE = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xd0\xd1][\x80-\xbf])+|[0-9]+|[!-/:-@\[-`{-~]+)")


def _byte_characters() -> dict[int, int]:
    """The character by which a byte-level vocabulary writes each byte: itself if it is a visible Latin-1 character, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return {b: b if b in shown else next(hidden) for b in range(256)}


class Encoder:
    """Encodes texts as a byte-level BPE of the ``tokenizers`` library does, ``add_special_tokens`` being False.

    Its pre-tokeniser always cuts before a space that a visible character follows, between letters, digits and
    signs (but for an apostrophe, which may take letters with it), before white space that follows these, and
    after a single line end or tab between them.  So a text's ids are those of its chunks, cut there, in order.
    Chunks recur: an Arrow dictionary finds the distinct ones of a slice, the library encodes those not known
    yet, and their ids are gathered.  Chunks that no pre-tokeniser rule could cut further go to the library's BPE
    model itself.  A text that holds an added token is one chunk, for the library takes that token out first; so
    is every text of a tokenizer that cuts in another way or changes the text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        about = json.loads(self.tok.to_str())
        cutter = about.get("pre_tokenizer") or {}
        self.cuts = about.get("normalizer") is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        self.cuts = self.cuts and not about["model"].get("dropout")
        self.added = [x["content"].encode() for x in about.get("added_tokens") or [] if x["content"]]
        self.width = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.encode_batch = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        self.characters = _byte_characters()

    def _new(self, chunks: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        single = [c for c in chunks if _SINGLE.fullmatch(c)] if self.cuts else []
        model, name, line = self.tok.model, np.dtype(self.width).char, chr(self.characters[10])
        if single:
            for c, x in zip(single, b"\n".join(single).decode("latin-1").translate(self.characters).split(line), strict=True):
                yield c, array(name, [t.id for t in model.tokenize(x)]).tobytes()
        known = set(single)
        other = [c for c in chunks if c not in known]
        for a in range(0, len(other), 64):
            part = other[a : a + 64]
            for c, e in zip(part, self.encode_batch([c.decode() for c in part], add_special_tokens=False), strict=True):
                yield c, np.array(e.ids, self.width).tobytes()

    def _distinct(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of distinct chunks."""
        if len(self.young) > CACHE_CHUNKS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = list(map(young.get, chunks))
        missing = [i for i, x in enumerate(found) if x is None]
        for i in missing:
            found[i] = old.get(chunks[i])
        new = dict(self._new([chunks[i] for i in missing if found[i] is None]))
        for i in missing:
            c = chunks[i]
            x = found[i]
            if x is None:
                x = found[i] = new[c]
            if len(c) <= CACHE_CHUNK_BYTES:
                young[c] = x
        return found

    def starts(self, t: Texts) -> np.ndarray:
        """The first byte of each chunk."""
        n = len(t.data)
        cut = np.zeros(n + 1, bool)
        cut[t.off] = True
        if not self.cuts or n < 2:
            return np.flatnonzero(cut[:-1])
        data, begin = t.data, cut[1:-1].copy()  # begin: of texts, at each byte but the first
        kind = _CLASS[data]
        low = np.flatnonzero((data[1:] & 0xC0) == 0x80) + 1  # second bytes of two-byte letters have the class of the first
        kind[low[kind[low - 1] == LETTER]] = LETTER
        sign = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        kind[sign] = kind[sign + 1] = ANYTHING
        space = data == 0x20
        a, b = kind[:-1], kind[1:]
        clear = (kind >= LETTER) & (kind <= SIGN)
        inner = clear[:-1] & (a != b) & (b != ANYTHING) & ((data[:-1] != 0x27) | (b == SPACE))
        inner[:-1] |= space[1:-1] & _VISIBLE[data[2:]] & ~begin[1:]
        inner[1:] |= clear[:-2] & (kind[1:-1] == SPACE) & ~space[1:-1] & clear[2:] & ~begin[:-1]
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:  # that text is one chunk
                i = int(np.searchsorted(t.off, at, "right"))
                inner[t.off[i - 1] : t.off[i]] = False
                at = raw.find(token, max(at + 1, int(t.off[i]) - len(token) + 1))
        cut[1:-1] |= inner
        return np.flatnonzero(cut[:-1])

    def __call__(self, t: Texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with the end id after it, and the number of ids of each text."""
        start = self.starts(t)
        off = np.append(start, len(t.data)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(t.data))]).dictionary_encode()
        ids = [*self._distinct(chunks.dictionary.to_pylist()), np.array([end_id], self.width).tobytes()]
        flat = np.frombuffer(b"".join(ids), self.width)
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // flat.itemsize
        begin = np.cumsum(size) - size
        last = np.searchsorted(start, t.off[1:])  # chunks up to the end of each text
        index = np.insert(chunks.indices.to_numpy(), last, len(ids) - 1)
        count = size[index]
        total = np.append(0, np.cumsum(count, dtype=np.int64))[last + np.arange(1, len(t) + 1)]
        step = 1 << 17  # places take eight bytes an id: some at a time
        parts = [flat[ranges(begin[index[a : a + step]], count[a : a + step])] for a in range(0, len(index), step)]
        return np.concatenate([np.empty(0, self.width), *parts]), np.diff(total, prepend=0)


#: One encoder a path, kept by a Python worker over its tasks: its chunks stay known.
_ENCODERS: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    fs, at = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    return fs, at


class SequenceWriter:
    """Writes ids as equal-length sequences, and the documents' places, to two Arrow files."""

    def __init__(self, fs: pafs.FileSystem, base: str, length: int, width: type):
        self.fs, self.base, self.length, self.width = fs, base, length, width
        kind = pa.from_numpy_dtype(width)
        self.schema = pa.schema([pa.field("ids", pa.list_(pa.field("id", kind, False), length)), pa.field("mask", pa.list_(pa.field("on", pa.bool_(), False), length))])
        self.doc_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out = fs.open_output_stream(base + ".seq.tmp")
        self.docs_out = fs.open_output_stream(base + ".docs.tmp")
        self.seq = pa.ipc.new_file(self.out, self.schema)
        self.docs = pa.ipc.new_file(self.docs_out, self.doc_schema)
        self.rest: list[np.ndarray] = []
        self.rest_n = self.n_tokens = self.n_docs = 0

    def add(self, doc_ids: pa.Array, flat: np.ndarray, counts: np.ndarray) -> None:
        """Documents, the ids of all of them, and how many each has."""
        starts = self.n_tokens + np.cumsum(counts) - counts
        self.docs.write_batch(pa.record_batch([doc_ids, pa.array(starts), pa.array(counts)], schema=self.doc_schema))
        self.n_tokens += len(flat)
        self.n_docs += len(counts)
        self.rest.append(flat)
        self.rest_n += len(flat)
        block = self.length * BATCH_ROWS
        if self.rest_n >= block:
            flat = np.concatenate(self.rest)
            full = len(flat) // block * block
            for a in range(0, full, block):
                self._write(flat[a : a + block], block)
            self.rest, self.rest_n = [flat[full:].copy()], len(flat) - full

    def _write(self, flat: np.ndarray, used: int) -> None:
        mask = np.ones(len(flat), bool)
        mask[used:] = False
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((flat, mask), self.schema, strict=True)]
        self.seq.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate(self.rest) if self.rest else np.empty(0, self.width)
        if len(flat):
            rows = -(-len(flat) // self.length)
            padded = np.zeros(rows * self.length, self.width)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        for w, out, name in ((self.seq, self.out, "seq"), (self.docs, self.docs_out, "docs")):
            w.close()
            out.close()
            self.fs.move(f"{self.base}.{name}.tmp", f"{self.base}.{name}.arrow")


MANIFEST = "file string, part int, n_docs bigint, n_tokens bigint"


def write_tokens(docs: DataFrame, tokenizer_path: str, out_dir: str, length: int = 2048, end_id: int = 0, id_col="doc_id", text_col="text") -> DataFrame:
    """Encode and write; returns the manifest (one row a file), computed once.

    ``part`` orders the files: all ids of a file come before those of the next.
    """
    spark = docs.sparkSession
    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id())
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = writer = base = None
        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = encoder_for(tokenizer_path)
                fs, top = _open(out_dir)
                fs.create_dir(top, recursive=True)
                part = batch.column(2)[0].as_py()
                base = f"{top}/part-{part:06d}-{uuid.uuid4().hex}"
                writer = SequenceWriter(fs, base, length, encoder.width)
            for i, j, t in Texts.of(batch.column(1)).slices(ENCODE_BYTES):
                writer.add(batch.column(0).slice(i, j - i), *encoder(t, end_id))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"file": f"{out_dir}/{base.rsplit('/', 1)[1]}", "part": part, "n_docs": writer.n_docs, "n_tokens": writer.n_tokens}], pa.schema([("file", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
        trim()

    manifest = ordered.mapInArrow(write, MANIFEST)
    path = new_dir(spark, "token-manifest")
    manifest.write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


class TokenFile:
    """Random access to one file: ``sequence(i)`` and ``mask(i)`` are views of the mapped bytes."""

    def __init__(self, base: str):
        fs, at = _open(base)
        local = isinstance(fs, pafs.LocalFileSystem)
        source = lambda name: pa.memory_map(f"{at}.{name}.arrow") if local else fs.open_input_file(f"{at}.{name}.arrow")
        self.seq = pa.ipc.open_file(source("seq"))
        self.docs = pa.ipc.open_file(source("docs"))
        self.length = self.seq.schema.field("ids").type.list_size

    def batch(self, i: int) -> np.ndarray:
        return self.seq.get_batch(i).column(0).flatten().to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> np.ndarray:
        b, r = divmod(i, BATCH_ROWS)
        return self.batch(b)[r * self.length : (r + 1) * self.length]

    def mask(self, i: int) -> pa.BooleanArray:
        b, r = divmod(i, BATCH_ROWS)
        return self.seq.get_batch(b).column(1).flatten().slice(r * self.length, self.length)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the file; copied only where they span record batches."""
        block = self.length * BATCH_ROWS
        first, last = start // block, (start + n - 1) // block
        if first == last:
            return self.batch(first)[start - first * block : start - first * block + n]
        whole = np.concatenate([self.batch(b) for b in range(first, last + 1)])
        return whole[start - first * block : start - first * block + n]


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row a document, read from the files: place, number of ids, crc32 of the ids as 32-bit integers."""
    run = F.floor(F.col("part") / 1024)  # files before each: a running sum within runs of files, and one over runs
    runs = manifest.groupBy(run.alias("run")).agg(F.sum("n_tokens").alias("n"))
    runs = runs.select("run", (F.sum("n").over(Window.orderBy("run")) - F.col("n")).alias("past"))
    inner = F.sum("n_tokens").over(Window.partitionBy("run").orderBy("part", "file")) - F.col("n_tokens")
    files = manifest.withColumn("run", run).withColumn("inner", inner).join(F.broadcast(runs), "run")
    table = files.select("file", (F.col("past") + F.col("inner")).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = TokenFile(file)
                for k in range(f.docs.num_record_batches):
                    d = f.docs.get_batch(k)
                    starts, counts = d.column(1).to_numpy(), d.column(2).to_numpy()
                    crc = [zlib.crc32(f.ids(int(s), int(n)).astype("<u4").tobytes()) for s, n in zip(starts, counts, strict=True)]
                    yield pa.record_batch([d.column(0), pa.array(starts + base), pa.array(counts), pa.array(crc, pa.int64())], schema=schema)

    return table.repartition(max(1, manifest.count())).mapInArrow(read, READ)
