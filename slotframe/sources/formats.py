"""Readers of binary and JSON formats, and the Parquet archive.

Archive streams (S1, S5, S8) are read by ``nodes``, state archives (S14) by ``states``.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.codecs import crc64_many, payload_ok, write_uvarint
from ..functions.units import EPOCH_SLOTS
from ..plans import fixtures as fx
from ..plans.register import query

#: Node kinds of the archive stream.
KINDS = ("transaction", "entry", "block", "subset", "epoch", "rewards", "dataframe")


# -- CBOR, as far as nodes use it


def cbor_decode(data: bytes, at: int = 0):
    """(value, next place): integers, bytes, text, arrays, maps, tags, booleans, null, doubles."""
    head = data[at]
    major, info = head >> 5, head & 31
    at += 1
    if major == 7:
        if info == 27:
            return struct.unpack(">d", data[at : at + 8])[0], at + 8
        if info not in (20, 21, 22, 23):
            raise ValueError(f"unsupported simple value {info}")
        return {20: False, 21: True}.get(info), at
    if info < 24:
        n = info
    elif info < 28:
        size = 1 << (info - 24)
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    else:
        raise ValueError("indefinite lengths aren't used")
    if major == 0:
        return n, at
    if major == 1:
        return -1 - n, at
    if major in (2, 3):
        raw = data[at : at + n]
        if len(raw) != n:
            raise ValueError("cut short")
        return (raw if major == 2 else raw.decode()), at + n
    if major == 4:
        out = []
        for _ in range(n):
            v, at = cbor_decode(data, at)
            out.append(v)
        return out, at
    if major == 5:
        pairs = {}
        for _ in range(n):
            k, at = cbor_decode(data, at)
            pairs[k], at = cbor_decode(data, at)
        return pairs, at
    return cbor_decode(data, at)  # a tag: its value


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for i, size in enumerate((1, 2, 4, 8)):
        if n < 1 << 8 * size:
            return bytes([major << 5 | 24 + i]) + n.to_bytes(size, "big")
    raise ValueError("too large")


def cbor_encode(v) -> bytes:
    if v is None or isinstance(v, bool):
        return bytes([0xF6 if v is None else 0xF5 if v else 0xF4])
    if isinstance(v, int):
        return _head(0, v) if v >= 0 else _head(1, -1 - v)
    if isinstance(v, bytes):
        return _head(2, len(v)) + v
    if isinstance(v, str):
        return _head(3, len(v.encode())) + v.encode()
    if isinstance(v, dict):
        return _head(5, len(v)) + b"".join(cbor_encode(k) + cbor_encode(x) for k, x in v.items())
    return _head(4, len(v)) + b"".join(map(cbor_encode, v))


# -- node stream: uvarint length, 36 bytes of content id, CBOR


def write_node(cid: bytes, node: list) -> bytes:
    body = cid + cbor_encode(node)
    return write_uvarint(len(body)) + body


def group_until_block(nodes: DataFrame, block_kind: int = 2, run: int = 1 << 26) -> DataFrame:
    """Adds ``group``: nodes up to and with a block share one; ``closed`` is false for a tail without a block.

    Counted in runs of ``run`` bytes of a file, with one row a run carried on, so no task windows over a file.
    """
    n = nodes.withColumn("_run", F.expr(f"offset div {run}"))
    is_block = F.col("kind") == block_kind
    runs = n.groupBy("file", "_run").agg(F.count_if(is_block).alias("_blocks"))
    runs = runs.withColumn("_past", F.coalesce(F.sum("_blocks").over(Window.partitionBy("file").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_blocks")
    inner = F.coalesce(F.count_if(is_block).over(Window.partitionBy("file", "_run").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = n.groupBy("file").agg(F.count_if(is_block).alias("_total"))
    n = n.withColumn("_inner", inner).join(runs, ["file", "_run"]).join(total, "file")
    return n.withColumns({"group": F.col("_past") + F.col("_inner"), "closed": F.col("_past") + F.col("_inner") < F.col("_total")}).drop("_run", "_past", "_inner", "_total")


def reassemble(parts: DataFrame) -> DataFrame:
    """(root, payload, ok) from (root, idx, data, checksum): parts in order, checked by CRC-64 or the older hash."""

    @F.arrow_udf("boolean")
    def check(payload: pa.Array, checksum: pa.Array) -> pa.Array:
        data, want = payload.to_pylist(), checksum.to_pylist()
        crc = iter(crc64_many([p for p in data if p is not None]).tolist())
        return pa.array([p is not None and (next(crc) == int(c) or payload_ok(p, int(c)) if c is not None else next(crc) >= 0) for p, c in zip(data, want, strict=True)])

    joined = parts.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("idx", F.hex("data").alias("h")))).alias("p"), F.max("checksum").alias("checksum"))
    whole = joined.select("root", F.unhex(F.array_join(F.col("p")["h"], "")).alias("payload"), "checksum")
    return whole.select("root", "payload", check("payload", "checksum").alias("ok"))


@query("S6_reassembled_payloads", "SELECT l_orderkey AS slot, CAST(sum(length(CAST(l_linenumber AS VARCHAR) || ',' || CAST(l_suppkey AS VARCHAR) || ',' || CAST(l_partkey AS VARCHAR))) AS INTEGER) AS bytes, true AS ok FROM lineitem GROUP BY l_orderkey")
def s6(spark, d):
    """Line items of an order as the parts of one payload."""
    ix = fx.instructions(spark, d).groupBy("slot").agg(F.sort_array(F.collect_list(F.concat_ws(",", "tx_idx", "program_id", "key"))).alias("p"))

    @F.arrow_udf("string")
    def crc(x: pa.Array) -> pa.Array:
        return pa.array(list(map(str, crc64_many([v.encode() for v in x.to_pylist()]).tolist())))

    parts = ix.select(F.col("slot").alias("root"), crc(F.array_join("p", "")).alias("checksum"), F.posexplode("p").alias("idx", "t")).withColumn("data", F.encode("t", "utf-8")).drop("t")
    return reassemble(parts).select(F.col("root").alias("slot"), F.octet_length("payload").alias("bytes"), "ok")


@query("S7_block_groups", "WITH n AS (SELECT event_id AS pos, event_type = 'purchase' AS block FROM events), g AS (SELECT *, coalesce(sum(CASE WHEN block THEN 1 ELSE 0 END) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM n) SELECT CAST(grp AS BIGINT) AS \"group\", count(*) AS nodes, bool_or(block) AS closed FROM g GROUP BY grp")
def s7(spark, d):
    nodes = fx.updates(spark, d).select(F.lit("f").alias("file"), F.col("write_version").alias("offset"), F.when(F.col("kind") == "purchase", 2).otherwise(0).alias("kind"))
    return group_until_block(nodes, run=1000).groupBy("group").agg(F.count(F.lit(1)).alias("nodes"), F.first("closed").alias("closed"))


@query("S9_reward_fields", "SELECT c_custkey AS pubkey, (c_custkey % 6) - 1 AS reward_type, coalesce(TRY_CAST(CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 10000 AS VARCHAR) ELSE '' END AS BIGINT), TRY_CAST(CAST(c_custkey % 100 AS VARCHAR) AS BIGINT) * 100) AS commission_bps FROM customer")
def s9(spark, d):
    """Type codes less one; basis points where they parse, else percent times 100."""
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("pubkey"))
    bps = F.when(F.col("pubkey") % 3 == 0, (F.col("pubkey") % 10000).cast("string")).otherwise("")
    percent = (F.col("pubkey") % 100).cast("string")
    return c.select("pubkey", (F.col("pubkey") % 6 - 1).alias("reward_type"), F.coalesce(bps.try_cast("bigint"), percent.try_cast("bigint") * 100).alias("commission_bps"))


# -- slot index: 12 bytes a slot, offset (8) and length (4), little-endian; length 0: skipped


def write_slot_index(ranges: list[tuple[int, int]]) -> bytes:
    return b"".join(struct.pack("<QI", a, n) for a, n in ranges)


def slot_index(files: DataFrame, first_slot: int = 0) -> DataFrame:
    """(slot, offset, length, present) from rows of ``binaryFile``; a size that isn't whole records is an error."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if len(raw) % 12:
                    raise ValueError(f"{len(raw)} bytes aren't whole records")
                r = np.frombuffer(raw, np.dtype([("o", "<u8"), ("n", "<u4")]))
                slot = first_slot + np.arange(len(r))
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(r["o"].astype(np.int64)), pa.array(r["n"].astype(np.int64)), pa.array(r["n"] > 0)], names=["slot", "offset", "length", "present"])

    return files.select("content").mapInArrow(parse, "slot bigint, offset bigint, length bigint, present boolean")


@query("S10_slot_index", f"WITH {fx.TX_SQL}, {fx.SLOTS_SQL}, n AS (SELECT slot, CAST(sum(bytes) AS BIGINT) AS length FROM tx GROUP BY slot) SELECT slot, CAST(sum(coalesce(length, 0)) OVER (ORDER BY slot) - coalesce(length, 0) AS BIGINT) AS offset, coalesce(length, 0) AS length, length IS NOT NULL AS present FROM slots LEFT JOIN n USING (slot)")
def s10(spark, d):
    """Offsets and lengths of the slots, as an index file would hold them."""
    from ..operators.ordered import with_running

    n = fx.transactions(spark, d).groupBy("slot").agg(F.sum("bytes").alias("length"))
    s = fx.slots(spark, d).select("slot").join(n, "slot", "left").withColumn("present", F.col("length").isNotNull()).fillna(0, ["length"])
    return with_running(s, "slot", "length", "end").select("slot", (F.col("end") - F.col("length")).alias("offset"), "length", "present")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Account list of a manifest (accounts) or a catalog (entries.*.requiredAccounts): distinct, sorted; both at once is an error."""
    raw = spark.read.text(path, wholetext=True)
    doc = F.from_json("value", "accounts array<string>, entries map<string, struct<requiredAccounts: array<string>>>")
    lists = raw.select(doc.alias("j"))
    if not lists.filter("j.accounts is not null and j.entries is not null").isEmpty():
        raise ValueError("a file holds a manifest or a catalog, not both")
    each = F.coalesce("j.accounts", F.flatten(F.transform(F.map_values("j.entries"), lambda e: F.coalesce(e["requiredAccounts"], F.array().cast("array<string>")))))
    return lists.select(F.explode(each).alias("account")).distinct().orderBy("account")


@query("S16_catalog_accounts", "SELECT DISTINCT CAST(n_nationkey % 10 AS VARCHAR) AS account FROM nation")
def s16(spark, d):
    n = fx.table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list((F.col("n_nationkey") % 10).cast("string")).alias("requiredAccounts"))
    entries = n.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_regionkey").cast("string"), F.struct("requiredAccounts")))).alias("entries"))
    return entries.select(F.explode(F.flatten(F.transform(F.map_values("entries"), lambda e: e["requiredAccounts"]))).alias("account")).distinct()


@query("S18_snapshot_listing", f"WITH {fx.BLOCKS_SQL} SELECT slot // 1000 AS epoch, max(slot) AS newest, count(*) AS snapshots FROM blocks WHERE slot % 50 = 0 AND status <> 'P' GROUP BY 1")
def s18(spark, d):
    """Snapshots with their marker, the newest one of each epoch."""
    b = fx.blocks(spark, d).filter("slot % 50 = 0 and status <> 'P'")
    return b.groupBy(F.expr("slot div 1000").alias("epoch")).agg(F.max("slot").alias("newest"), F.count(F.lit(1)).alias("snapshots"))


# -- Parquet archive


def write_archive(df: DataFrame, path: str, order: tuple[str, ...] = ("slot",), epoch: int = EPOCH_SLOTS, mode: str = "errorifexists") -> None:
    """Rows clustered by slot, a folder an epoch, sorted inside files so that a slot range reads few row groups."""
    df.withColumn("epoch", F.expr(f"slot div {epoch}")).repartitionByRange("slot").sortWithinPartitions(*order).write.mode(mode).option("compression", "zstd").partitionBy("epoch").parquet(path)


def read_archive(spark: SparkSession, path: str, lo: int | None = None, hi: int | None = None, epoch: int = EPOCH_SLOTS) -> DataFrame:
    """Slots lo to hi - 1; the filter on epochs prunes folders, that on slots row groups."""
    df = spark.read.parquet(path)
    if lo is not None:
        df = df.filter((F.col("epoch") >= lo // epoch) & (F.col("slot") >= lo))
    if hi is not None:
        df = df.filter((F.col("epoch") <= (hi - 1) // epoch) & (F.col("slot") < hi))
    return df.drop("epoch")


def check_archive_order(df: DataFrame) -> DataFrame:
    """Slots that occur more than once: an archive has one frame a slot."""
    return df.groupBy("slot").agg(F.count(F.lit(1)).alias("frames")).filter("frames > 1")


# -- tables that are merged into: data folders by bucket, and a manifest that names the current one of each bucket


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """(number, folder of each bucket) of the newest manifest, the schema under ``schema``; (0, {}) where there is none."""
    hadoop, fs = _files(spark, path)
    top = hadoop(f"{path}/manifests")
    if not fs.exists(top):
        return 0, {}
    numbers = [int(f.getPath().getName()) for f in fs.listStatus(top) if f.getPath().getName().isdigit()]
    if not numbers:
        return 0, {}
    rows = spark.read.text(f"{path}/manifests/{max(numbers)}").collect()
    return max(numbers), dict(r["value"].split(" ", 1) for r in rows)


def _bucket_of(key: list[str], slots: int, buckets: int):
    """Rows with a slot fall into runs of slots, others by a hash of their key."""
    return F.expr(f"slot div {slots}") if "slot" in key else F.pmod(F.xxhash64(*key), F.lit(buckets))


def upsert(df: DataFrame, path: str, key: list[str], version: list[str], slots: int = EPOCH_SLOTS // 100, buckets: int = 64) -> None:
    """Merge rows into a table, the newest version of a key staying; only buckets that get rows are written anew.

    Readers take the folders that the newest manifest names, so they see the table before or after a
    merge, never between.  A run that ends half way leaves folders that no manifest names.
    """
    from ..operators.state import merge_latest

    spark = df.sparkSession
    number, now = _manifest(spark, path)
    fresh = f"{path}/data/{number + 1:08d}-{uuid.uuid4().hex}"
    rows = df.withColumn("_bucket", _bucket_of(key, slots, buckets).cast("string"))
    now.pop("schema", None)
    if now:
        touched = {r["_bucket"] for r in rows.select("_bucket").distinct().collect()}  # runs of slots or buckets, not rows
        old = [f"{path}/{now[b]}" for b in sorted(touched & now.keys())]
        if old:
            rows = rows.unionByName(spark.read.schema(df.schema).parquet(*old).withColumn("_bucket", _bucket_of(key, slots, buckets).cast("string")))
    merge_latest(rows, [*key, "_bucket"], version).write.partitionBy("_bucket").parquet(fresh)
    hadoop, fs = _files(spark, path)
    made = [f.getPath().getName() for f in fs.listStatus(hadoop(fresh)) if f.getPath().getName().startswith("_bucket=")]
    after = now | {m.split("=", 1)[1]: f"{fresh.removeprefix(path + '/')}/{m}" for m in made}
    text = "\n".join([f"schema {df.schema.json()}", *(f"{b} {folder}" for b, folder in sorted(after.items()))])
    draft = hadoop(f"{path}/manifests/_{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, hadoop(f"{path}/manifests/{number + 1}")):
        raise RuntimeError(f"another merge into {path} came first")
    for f in fs.listStatus(hadoop(f"{path}/data")):  # folders that neither this manifest nor the one before names
        name = f"data/{f.getPath().getName()}"
        if not any(x.startswith(name + "/") for x in (*after.values(), *now.values())):
            fs.delete(f.getPath(), True)


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that :func:`upsert` writes."""
    _, now = _manifest(spark, path)
    if not now:
        raise FileNotFoundError(path)
    schema = StructType.fromJson(json.loads(now.pop("schema")))
    return spark.read.schema(schema).parquet(*[f"{path}/{folder}" for folder in sorted(now.values())]) if now else spark.createDataFrame([], schema)


# -- the older index: slot to content id, content id to place, each in hash buckets

INDEX_BUCKETS = 16


def write_compact_index(nodes: DataFrame, path: str, buckets: int = INDEX_BUCKETS) -> None:
    """``nodes`` has slot, cid, offset, length; two tables are written, each dealt into buckets by a hash of its key."""
    for name, key, columns in (("slots", "slot", ("cid",)), ("places", "cid", ("offset", "length"))):
        rows = nodes.select(key, *columns).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
        rows.repartition("bucket").sortWithinPartitions(key).write.partitionBy("bucket").parquet(f"{path}/{name}")


def read_compact_index(spark: SparkSession, path: str, slots: DataFrame, buckets: int = INDEX_BUCKETS) -> DataFrame:
    """(slot, cid, offset, length) of the slots asked for that the index holds; lookups go bucket by bucket."""
    ids, places = spark.read.parquet(f"{path}/slots"), spark.read.parquet(f"{path}/places")
    asked = slots.select("slot").distinct().withColumn("bucket", F.pmod(F.xxhash64("slot"), F.lit(buckets)).cast("int"))
    found = asked.join(ids, ["bucket", "slot"]).drop("bucket").withColumn("bucket", F.pmod(F.xxhash64("cid"), F.lit(buckets)).cast("int"))
    return found.join(places, ["bucket", "cid"]).select("slot", "cid", "offset", "length")


# -- raw records: some columns to search by, and the whole record


def write_raw_records(df: DataFrame, path: str, searchable: list[str]) -> None:
    """The searchable columns and ``record``, a struct of all columns, sorted so that searches by slot read few row groups."""
    rows = df.select(*searchable, F.struct(*df.columns).alias("record"))
    rows.repartitionByRange("slot").sortWithinPartitions("slot").write.option("compression", "zstd").parquet(path)


def read_raw_records(spark: SparkSession, path: str, found=None) -> DataFrame:
    """Records that a condition on the searchable columns finds; it is pushed to the scan."""
    df = spark.read.parquet(path)
    return df if found is None else df.filter(found)


def export_accounts(latest: DataFrame, path: str) -> None:
    """Live accounts as CSV with a header; an existing target is an error."""
    latest.filter("lamports <> 0").select("pubkey", "owner", "data_size", "lamports").write.mode("errorifexists").option("header", True).csv(path)


def discard(df: DataFrame) -> None:
    """Runs a plan and drops its rows, for measurements."""
    df.write.format("noop").mode("overwrite").save()


def discard_counting(df: DataFrame, **aggregates) -> dict:
    """Runs a plan, drops its rows and returns aggregates observed on the way."""
    from pyspark.sql import Observation

    seen = Observation()
    discard(df.observe(seen, *[c.alias(name) for name, c in aggregates.items()]))
    return seen.get
