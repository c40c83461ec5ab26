"""Archive streams as tables (S1, S5, S8): nodes, blocks, transactions, entries and rewards of archive files.

``spark.read.format("ledger")`` takes the options

* ``path``: one file or several, split by commas, on any file system that Arrow reaches;
* ``stream``: ``nodes`` (default), ``blocks``, ``transactions``, ``entries`` or ``rewards``;
* ``index``: the slot index of each file (12 bytes a slot), ``first_slot``: the slot of their first records;
* ``start``, ``end``: slots start to end - 1, found by the index; ``split_bytes``: bytes of a partition.

With an index a file is read by many tasks, each a run of whole slots; without one, by one task.  A
task holds one slot's nodes at a time: nodes up to and with a block node belong to its slot.  A stream
that ends before the last slot that the index names for its part is an error, not a short result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.codecs import payload_ok, uvarint, write_uvarint
from .formats import KINDS, cbor_decode, cbor_encode

TRANSACTION, ENTRY, BLOCK, SUBSET, EPOCH, REWARDS, DATAFRAME = range(len(KINDS))
CID_BYTES = 36
#: Bytes read ahead at a time, and bytes of rows in a batch.
READ_BYTES, BATCH_BYTES = 4 << 20, 4 << 20
#: A header longer than this isn't one.
MOST_HEADER = 1024

SCHEMAS = {
    "nodes": "file string, offset bigint, cid binary, kind int, slot bigint, body binary",
    "blocks": "slot bigint, parent_slot bigint, block_time bigint, block_height bigint, entries int, transactions int",
    "transactions": "slot bigint, tx_idx bigint, payload binary, metadata binary, ok boolean",
    "entries": "slot bigint, entry_index int, num_hashes bigint, hash binary, tx_count int",
    "rewards": "slot bigint, payload binary, ok boolean",
}


def write_header(roots: list[bytes]) -> bytes:
    body = cbor_encode({"roots": roots, "version": 1})
    return write_uvarint(len(body)) + body


def open_file(path: str) -> pa.NativeFile:
    fs, at = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    return fs.open_input_file(at)


def sections(f: pa.NativeFile, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, body) of each length-prefixed section between two places, read ahead ``READ_BYTES`` at a time."""
    f.seek(begin)
    held, at, place = b"", 0, begin  # place: of held[at] in the file

    def more(need: int) -> bool:
        nonlocal held, at
        parts, have = [held[at:]], len(held) - at
        while have < need and place + have < end:
            got = f.read(min(max(READ_BYTES, need - have), end - place - have))
            if not got:
                break
            parts.append(got)
            have += len(got)
        held, at = b"".join(parts), 0
        return have >= need

    while place < end:
        if len(held) - at < 10:
            more(min(10, end - place))
        try:
            size, body = uvarint(held, at)
        except IndexError:
            raise ValueError(f"section at {place} is cut short") from None
        whole = body - at + size
        if len(held) - at < whole and not more(whole):
            raise ValueError(f"section at {place} is cut short")
        yield place, held[at + whole - size : at + whole]
        at += whole
        place += whole


def header_end(f: pa.NativeFile, size: int) -> int:
    """Where the first node starts: behind the header if there is one."""
    f.seek(0)
    first = f.read(min(size, MOST_HEADER + 10))
    if not first:
        return 0
    length, body = uvarint(first)
    if length <= MOST_HEADER and body + length <= len(first) and first[body] >> 5 == 5:  # a map, which no node is
        value, end = cbor_decode(first, body)
        if end == body + length and "version" in value:
            return end
    return 0


@dataclass
class Node:
    offset: int
    cid: bytes
    fields: list
    body: bytes

    @property
    def kind(self) -> int:
        return self.fields[0]


def read_nodes(f: pa.NativeFile, begin: int, end: int) -> Iterator[Node]:
    for offset, body in sections(f, begin, end):
        if len(body) <= CID_BYTES:
            raise ValueError(f"node at {offset} is cut short")
        fields, last = cbor_decode(body, CID_BYTES)
        if last != len(body) or not isinstance(fields, list) or not fields or not 0 <= fields[0] < len(KINDS):
            raise ValueError(f"bad node at {offset}")
        yield Node(offset, body[:CID_BYTES], fields, body[CID_BYTES:])


def slot_groups(nodes: Iterator[Node]) -> Iterator[tuple[int | None, list[Node]]]:
    """(slot, its nodes, the block last); nodes behind the last block come with slot None."""
    group: list[Node] = []
    for n in nodes:
        group.append(n)
        if n.kind == BLOCK:
            yield n.fields[1], group
            group = []
    if group:
        yield None, group


def _link(cid: bytes) -> bytes:
    """A content id inside a node has a zero byte before it."""
    return cid[1:] if len(cid) == CID_BYTES + 1 and cid[0] == 0 else cid


def reassembled(frame: list, known: dict[bytes, Node]) -> tuple[bytes, bool]:
    """(payload, whether its checksum holds) of a first frame and those it is continued by."""
    at = lambda x, i: x[i] if len(x) > i else None
    parts, following = [at(frame, 4) or b""], at(frame, 5)
    while following:
        last = None
        for cid in following:
            n = known.get(_link(cid))
            if n is None or n.kind != DATAFRAME:
                raise ValueError(f"no frame {cid.hex()}")
            parts.append(at(n.fields, 4) or b"")
            last = at(n.fields, 5)
        following = last
    payload, checksum = b"".join(parts), at(frame, 1)
    return payload, checksum is None or payload_ok(payload, checksum & (1 << 64) - 1)


def _rows(stream: str, file: str, slot: int | None, group: list[Node]) -> Iterator[tuple]:
    if stream == "nodes":
        for n in group:
            yield file, n.offset, n.cid, n.kind, slot, n.body
        return
    if slot is None:
        return
    known = {n.cid: n for n in group}
    entries = [n for n in group if n.kind == ENTRY]
    transactions = [n for n in group if n.kind == TRANSACTION]
    if stream == "blocks":
        meta = group[-1].fields[4] if len(group[-1].fields) > 4 and isinstance(group[-1].fields[4], list) else []
        meta = [*meta, None, None, None][:3]
        yield slot, meta[0], meta[1], meta[2], len(entries), len(transactions)
    elif stream == "transactions":
        for i, n in enumerate(transactions):
            (payload, a), (metadata, b) = (reassembled(x, known) for x in n.fields[1:3])
            own = n.fields[4] if len(n.fields) > 4 else None
            yield slot, i if own is None else own, payload, metadata, a and b
    elif stream == "entries":
        for i, n in enumerate(entries):
            yield slot, i, n.fields[1], n.fields[2], len(n.fields[3])
    else:
        for n in group:
            if n.kind == REWARDS:
                yield slot, *reassembled(n.fields[2], known)


class Part(InputPartition):
    """Bytes of a file; last: the last slot that the index says is there."""

    def __init__(self, file: str, begin: int | None, end: int | None, last: int | None):
        super().__init__(0)
        self.file, self.begin, self.end, self.last = file, begin, end, last


class LedgerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("stream", "nodes")]

    def reader(self, schema) -> DataSourceReader:
        return LedgerReader(dict(self.options))


class LedgerReader(DataSourceReader):
    def __init__(self, options: dict):
        split = lambda name: [p for p in options.get(name, "").split(",") if p]
        self.stream = options.get("stream", "nodes")
        self.files, self.indexes = split("path"), split("index")
        self.firsts = [int(x) for x in split("first_slot")] or [0] * len(self.indexes)
        self.start, self.end = int(options.get("start", 0)), int(options.get("end", 1 << 62))
        self.split_bytes = int(options.get("split_bytes", 64 << 20))
        if not self.files:
            raise ValueError("option path is missing")
        if self.indexes and not len(self.indexes) == len(self.files) == len(self.firsts):
            raise ValueError("as many indexes and first slots as files, please")
        if not self.indexes and ("start" in options or "end" in options):
            raise ValueError("slots are found by an index: give one")

    def partitions(self):
        if not self.indexes:
            return [Part(f, None, None, None) for f in self.files]
        out = []
        for file, index, first in zip(self.files, self.indexes, self.firsts, strict=True):
            a, z = max(0, self.start - first), max(0, self.end - first)
            with open_file(index) as f:
                if f.size() % 12:
                    raise ValueError(f"{f.size()} bytes aren't whole records")
                z = min(z, f.size() // 12)
                if z <= a:
                    continue
                f.seek(12 * a)
                records = np.frombuffer(f.read(12 * (z - a)), np.dtype([("o", "<u8"), ("n", "<u4")]))
            there = np.flatnonzero(records["n"])
            begin, end = records["o"][there].astype(np.int64), (records["o"] + records["n"])[there].astype(np.int64)
            if not len(there):
                continue
            piece = (begin - begin[0]) // max(1, self.split_bytes)
            cut = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(there)]
            out += [Part(file, int(begin[i]), int(end[j - 1]), first + a + int(there[j - 1])) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        return out or [Part("", 0, 0, None)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        with open_file(partition.file) as f:
            size = f.size()
            begin = header_end(f, size) if partition.begin is None else partition.begin
            end = size if partition.end is None else min(size, partition.end)
            rows, held, newest = [], 0, None
            for slot, group in slot_groups(read_nodes(f, begin, end)):
                newest = slot if slot is not None else newest
                for row in _rows(self.stream, partition.file, slot, group):
                    rows.append(row)
                    held += 64 + sum(len(x) for x in row if isinstance(x, bytes))
                if held >= BATCH_BYTES:
                    yield _batch(self.stream, rows)
                    rows, held = [], 0
            if partition.last is not None and newest != partition.last:
                raise ValueError(f"{partition.file} ended at slot {newest}, the index goes on to {partition.last}")
            if rows:
                yield _batch(self.stream, rows)


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(stream: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*[x.split(" ") for x in SCHEMAS[stream].split(", ")], strict=True)
    columns = [pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=list(names))


def read_stream(spark: SparkSession, stream: str, path: str, **options) -> DataFrame:
    """One of the streams of archive files; options as above."""
    spark.dataSource.register(LedgerSource)
    return spark.read.format("ledger").options(path=path, stream=stream, **{k: str(v) for k, v in options.items()}).load()


def read_blocks(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_stream(spark, "blocks", path, **options)


def read_transactions(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_stream(spark, "transactions", path, **options)


def read_entries(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_stream(spark, "entries", path, **options)


def read_rewards(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_stream(spark, "rewards", path, **options)


# -- what a transaction's payload and status hold


def compact_u16(data: bytes, at: int) -> tuple[int, int]:
    """(value, next place) of a length of one to three bytes, seven bits each."""
    value = 0
    for k in range(3):
        b = data[at + k]
        value |= (b & 0x7F) << 7 * k
        if b < 0x80:
            return value, at + k + 1
    raise ValueError("a length of more than three bytes")


def parse_message(data: bytes) -> dict:
    """Signatures, header, keys, instructions and lookups of a transaction, legacy or version 0."""

    def items(at: int, read) -> tuple[list, int]:
        n, at = compact_u16(data, at)
        out = []
        for _ in range(n):
            x, at = read(at)
            out.append(x)
        return out, at

    def raw(size: int):
        return lambda at: (_exactly(data, at, size), at + size)

    def block(at: int) -> tuple[bytes, int]:
        n, at = compact_u16(data, at)
        return _exactly(data, at, n), at + n

    def instruction(at: int):
        program = data[at]
        accounts, at = block(at + 1)
        body, at = block(at)
        return (program, list(accounts), body), at

    def lookup(at: int):
        key = _exactly(data, at, 32)
        written, at = block(at + 32)
        read, at = block(at)
        return (key, list(written), list(read)), at

    signatures, at = items(0, raw(64))
    versioned = bool(data[at] & 0x80)
    if versioned and data[at] != 0x80:
        raise ValueError(f"message version {data[at] & 0x7F} isn't known")
    at += versioned
    required, signed, unsigned = _exactly(data, at, 3)
    keys, at = items(at + 3, raw(32))
    at += 32  # the recent block hash
    instructions, at = items(at, instruction)
    lookups, at = items(at, lookup) if versioned else ([], at)
    if at != len(data):
        raise ValueError(f"{len(data) - at} bytes behind the message")
    return {"signatures": signatures, "is_legacy": not versioned, "required": required, "ro_signed": signed, "ro_unsigned": unsigned, "keys": keys, "instructions": instructions, "lookups": lookups}


def _exactly(data: bytes, at: int, size: int) -> bytes:
    out = data[at : at + size]
    if len(out) != size:
        raise ValueError("cut short")
    return out


#: Numbers of the status fields that are used, and the first epoch whose status is never in the older format.
STATUS_ERROR, STATUS_FEE, STATUS_WRITTEN, STATUS_READ, STATUS_UNITS = 1, 2, 12, 13, 16
OLDER_STATUS_EPOCHS = 157


def parse_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message: numbers, fixed-size numbers, bytes."""
    at = 0
    while at < len(data):
        tag, at = uvarint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = uvarint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = int.from_bytes(_exactly(data, at, size), "little"), at + size
        elif kind == 2:
            size, at = uvarint(data, at)
            value, at = _exactly(data, at, size), at + size
        else:
            raise ValueError(f"field kind {kind}")
        if not tag >> 3:
            raise ValueError("field 0")
        yield tag >> 3, value


def parse_status(data: bytes) -> dict:
    """Error flag, fee, looked-up keys and units of a status message."""
    out = {"is_success": True, "fee": 0, "loaded_writable": [], "loaded_readonly": [], "consumed": None}
    for number, value in parse_fields(data):
        if number == STATUS_ERROR:
            out["is_success"] = False
        elif number == STATUS_FEE:
            out["fee"] = value
        elif number in (STATUS_WRITTEN, STATUS_READ):
            out["loaded_writable" if number == STATUS_WRITTEN else "loaded_readonly"].append(value)
        elif number == STATUS_UNITS:
            out["consumed"] = value
    return out


def parse_older_status(data: bytes) -> dict:
    """Error flag and fee of the older, fixed-width format: a 32-bit result tag, the fee, balances before and after.

    A failed transaction's error has no length of its own, so only successful ones are told in full.
    """
    tag = struct.unpack_from("<I", data)[0]
    if tag > 1:
        raise ValueError("no result tag")
    out = {"is_success": tag == 0, "fee": 0, "loaded_writable": [], "loaded_readonly": [], "consumed": None}
    if tag == 0:
        fee, n = struct.unpack_from("<QQ", data, 4)
        if 20 + 8 * n + 8 > len(data) or struct.unpack_from("<Q", data, 20 + 8 * n)[0] != n:
            raise ValueError("balances don't fit")
        out["fee"] = fee
    return out


def decode_status(data: bytes | None, epoch: int) -> dict:
    """A status as stored: nothing, or a message that may be compressed; early epochs may have the older format."""
    if not data:
        return parse_status(b"")
    import zstandard

    try:
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    except zstandard.ZstdError:
        pass  # stored as it is
    if epoch < OLDER_STATUS_EPOCHS:
        try:
            return parse_older_status(data)
        except (ValueError, struct.error):
            pass
    return parse_status(data)


MESSAGES = (
    "slot bigint, tx_idx bigint, num_signatures int, required int, ro_signed int, ro_unsigned int, is_legacy boolean, fee bigint, consumed bigint, is_success boolean, "
    "static_keys array<binary>, loaded_writable array<binary>, loaded_readonly array<binary>, instructions array<struct<program_index:int,accounts:array<int>,data:binary>>"
)


def decoded_transactions(transactions: DataFrame, epoch_slots: int) -> DataFrame:
    """Payloads and statuses of :func:`read_transactions` as the rows that ``operators.txmeta`` takes (without a configuration)."""
    key = pa.list_(pa.binary())
    ix = pa.list_(pa.struct([("program_index", pa.int32()), ("accounts", pa.list_(pa.int32())), ("data", pa.binary())]))
    small = [(n, pa.int32()) for n in ("num_signatures", "required", "ro_signed", "ro_unsigned")]
    schema = pa.schema([("slot", pa.int64()), ("tx_idx", pa.int64()), *small, ("is_legacy", pa.bool_()), ("fee", pa.int64()), ("consumed", pa.int64()), ("is_success", pa.bool_()), ("static_keys", key), ("loaded_writable", key), ("loaded_readonly", key), ("instructions", ix)])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for slot, at, payload, metadata in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                m, s = parse_message(payload), decode_status(metadata, slot // epoch_slots)
                out.append(
                    {"slot": slot, "tx_idx": at, "num_signatures": len(m["signatures"]), "static_keys": m["keys"], "instructions": [dict(zip(("program_index", "accounts", "data"), x, strict=True)) for x in m["instructions"]]}
                    | {k: m[k] for k in ("required", "ro_signed", "ro_unsigned", "is_legacy")}
                    | s
                )
            yield pa.RecordBatch.from_pylist(out, schema)

    return transactions.select("slot", "tx_idx", "payload", "metadata").mapInArrow(decode, MESSAGES)


# -- writing small archives


def content_id(body: bytes) -> bytes:
    """A version 1 content id of CBOR bytes by SHA-256."""
    return bytes.fromhex("01711220") + hashlib.sha256(body).digest()


def frame(data: bytes) -> list:
    return [DATAFRAME, None, None, None, data, None]


def frames(data: bytes, size: int, checksum: int) -> tuple[list, list[list]]:
    """A payload in frames of ``size`` bytes: the first one, which names the others, and those."""
    parts = [data[i : i + size] for i in range(0, len(data), size)] or [b""]
    rest = [[DATAFRAME, None, i, len(parts), x, None] for i, x in enumerate(parts) if i]
    links = [b"\0" + content_id(cbor_encode(x)) for x in rest]
    return [DATAFRAME, checksum, 0, len(parts), parts[0], links or None], rest


def slot_sections(slot: int, parent: int, block_time: int | None, transactions: list[tuple[int, list, list]]) -> bytes:
    """The sections of a slot: its transactions (index, payload frame, status frame), an entry for every two, the block."""
    out, links, held = [], [], []

    def add(node: list) -> bytes:
        body = cbor_encode(node)
        cid = content_id(body)
        out.append(write_uvarint(len(cid) + len(body)) + cid + body)
        return b"\0" + cid

    for at, payload, status in transactions:
        held.append(add([TRANSACTION, payload, status, slot, at]))
        if len(held) == 2:
            links.append(add([ENTRY, len(links) + 1, hashlib.sha256(held[0]).digest(), held]))
            held = []
    if held:
        links.append(add([ENTRY, len(links) + 1, hashlib.sha256(held[0]).digest(), held]))
    add([BLOCK, slot, [], links, [parent, block_time, None], b"\0" * 37])
    return b"".join(out)


FILES = "file string, index string, first_slot bigint"


def write_ledger_files(slots: DataFrame, path: str, epoch_slots: int) -> DataFrame:
    """An archive file and its slot index for each epoch, from (slot, block_time, transactions) rows.

    ``transactions`` is an array of (index, payload, status); every second status is stored compressed. A file
    is made in the memory of one task: this is for small archives, such as tests need.
    """
    from pyspark.sql import functions as F

    def write(key, table):
        import zstandard

        pack = zstandard.ZstdCompressor().compress
        epoch = key[0].as_py()
        base = f"{path}/epoch-{epoch}"
        fs, at = pafs.FileSystem.from_uri(base if "://" in base else "file://" + base)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        data = bytearray(write_header([b"\0" + content_id(b"")]))
        index, parent = np.zeros(epoch_slots, np.dtype([("o", "<u8"), ("n", "<u4")])), 0
        for r in sorted(table.to_pylist(), key=lambda r: r["slot"]):
            rows = sorted(r["transactions"], key=lambda t: t["index"])
            made = [(t["index"], frame(t["payload"]), frame(pack(t["status"]) if t["index"] % 2 else t["status"])) for t in rows]
            part = slot_sections(r["slot"], parent, r["block_time"], made)
            index[r["slot"] - epoch * epoch_slots] = len(data), len(part)
            data += part
            parent = r["slot"]
        for name, content in ((f"{at}.car", bytes(data)), (f"{at}.idx", index.tobytes())):
            with fs.open_output_stream(name) as out:
                out.write(content)
        return pa.table({"file": [f"{base}.car"], "index": [f"{base}.idx"], "first_slot": [epoch * epoch_slots]})

    grouped = slots.withColumn("epoch", F.expr(f"slot div {epoch_slots}")).groupBy("epoch")
    return grouped.applyInArrow(write, FILES)
