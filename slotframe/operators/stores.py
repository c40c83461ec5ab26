"""Stores written and read back: archives, state archives, exports, raw records, progress (S11 to S20, K7 to K13, T5, T6), and small rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import units
from ..plans import fixtures as fx
from ..plans.register import query
from ..session import scratch
from ..sources import formats, nodes, states
from . import analyses
from .joins import ENTRY_SQL, backfill_times, entries
from .state import merge_latest


# -- archives


@query("K9_archive_rows", f"WITH {fx.TX_SQL} SELECT slot, tx_idx, n_ix, fee FROM tx")
def k9(spark, d):
    """Transactions written as an archive, a folder an epoch, sorted by slot, and read back whole."""
    path = scratch(spark, "archive")
    formats.write_archive(fx.transactions(spark, d).select("slot", "tx_idx", "n_ix", "fee"), path, ("slot", "tx_idx"), fx.EPOCH)
    return formats.read_archive(spark, path, epoch=fx.EPOCH)


SPAN_SQL = "span AS (SELECT (2 * min(o_orderkey) + max(o_orderkey)) // 3 AS lo, (min(o_orderkey) + 2 * max(o_orderkey)) // 3 AS hi FROM orders)"


def middle(spark, d) -> tuple[int, int]:
    """The middle third of the ledger's slots."""
    r = fx.slot_ids(spark, d).agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")).first()
    lo, hi = r["lo"] or 0, r["hi"] or 0
    return (2 * lo + hi) // 3, (lo + 2 * hi) // 3


@query("S12_archive_range", f"WITH {fx.TX_SQL}, {SPAN_SQL} SELECT slot, count(*) AS txs, CAST(sum(fee) AS BIGINT) AS fees FROM tx, span WHERE slot >= lo AND slot < hi GROUP BY slot")
def s12(spark, d):
    """A slot range of an archive: folders are pruned by epoch, row groups by slot."""
    path = scratch(spark, "archive")
    formats.write_archive(fx.transactions(spark, d).select("slot", "tx_idx", "fee"), path, ("slot", "tx_idx"), fx.EPOCH)
    rows = formats.read_archive(spark, path, *middle(spark, d), epoch=fx.EPOCH)
    return rows.groupBy("slot").agg(F.count(F.lit(1)).alias("txs"), F.sum("fee").alias("fees"))


@query("S13_archive_runner", f"WITH {analyses.A1_SQL}, {SPAN_SQL} SELECT a1.* FROM a1, span WHERE slot >= lo AND slot < hi")
def s13(spark, d):
    """The runner over an archive of blocks, transactions and instructions, limited to a slot range."""
    from ..plans.engine import Engine, archive_streams, write_streams

    path = scratch(spark, "archive")
    write_streams({"instructions": fx.instructions(spark, d), "transactions": fx.transactions(spark, d), "blocks": fx.blocks(spark, d)}, path, fx.EPOCH)
    engine = Engine(spark).with_analysis("program-tracking").with_slot_range(*middle(spark, d))
    return engine.run(archive_streams(spark, path, *engine.slots, epoch=fx.EPOCH))["program-tracking"]


def archive_files(spark, d) -> dict:
    """Archive files of all blocks, their transactions as messages and statuses; the options to read them with."""
    status = F.concat(F.unhex(F.lit("10")), units.base128(F.col("fee")), F.unhex(F.lit("8001")), units.base128(F.col("cu")), F.when(F.col("errored"), F.unhex(F.lit("0A00"))).otherwise(F.unhex(F.lit(""))))
    # one signature, a header, two keys, a block hash, and instructions of one account and one byte
    head = "concat('01', repeat('00', 64), '010001', '02', repeat('11', 32), repeat('22', 32), repeat('33', 32), lpad(hex(n_ix), 2, '0'), repeat('01010001FF', cast(n_ix as int)))"
    tx = fx.transactions(spark, d).select("slot", F.struct(F.col("tx_idx").alias("index"), F.unhex(F.expr(head)).alias("payload"), status.alias("status")).alias("t"))
    per = tx.groupBy("slot").agg(F.collect_list("t").alias("transactions"))
    slots = fx.blocks(spark, d).select("slot", "block_time").join(per, "slot")
    files = nodes.write_ledger_files(slots, scratch(spark, "ledger"), fx.EPOCH).orderBy("first_slot").collect()  # a row an epoch
    return {"path": ",".join(r["file"] for r in files), "index": ",".join(r["index"] for r in files), "first_slot": ",".join(str(r["first_slot"]) for r in files), "split_bytes": 1 << 18}


@query("S1_archive_slots", f"WITH {fx.TX_SQL}, {fx.BLOCKS_SQL}, {SPAN_SQL} SELECT slot, any_value(block_time) AS block_time, CAST(count(*) AS INTEGER) AS transactions FROM tx JOIN blocks USING (slot), span WHERE slot >= lo AND slot < hi GROUP BY slot")
def s1(spark, d):
    """A slot range of archive files, found by their index and read by many tasks."""
    lo, hi = middle(spark, d)
    return nodes.read_blocks(spark, **archive_files(spark, d), start=lo, end=hi).select("slot", "block_time", "transactions")


@query("S5_archive_nodes", f"WITH {ENTRY_SQL}, {fx.BLOCKS_SQL}, n AS (SELECT slot, 0 AS kind, 1 AS c FROM tx UNION ALL SELECT slot, 1, 1 FROM entries UNION ALL SELECT slot, 2, 1 FROM blocks) SELECT slot, CAST(kind AS INTEGER) AS kind, count(*) AS nodes FROM n SEMI JOIN blocks USING (slot) GROUP BY slot, kind")
def s5(spark, d):
    """All nodes of archive files without an index, one task a file; a slot's nodes end with its block."""
    path = archive_files(spark, d)["path"]
    return nodes.read_stream(spark, "nodes", path).groupBy("slot", "kind").agg(F.count(F.lit(1)).alias("nodes"))


@query("S8_transaction_status", f"WITH {fx.TX_SQL}, {fx.BLOCKS_SQL} SELECT slot, tx_idx, fee, CAST(cu AS BIGINT) AS consumed, NOT errored AS is_success, CAST(n_ix AS INTEGER) AS instructions FROM tx SEMI JOIN blocks USING (slot)")
def s8(spark, d):
    """Messages and statuses, plain and compressed, decoded from archive files."""
    rows = nodes.decoded_transactions(nodes.read_transactions(spark, **archive_files(spark, d)), fx.EPOCH)
    return rows.select("slot", "tx_idx", "fee", "consumed", "is_success", F.size("instructions").alias("instructions"))


CHECKPOINT_SQL = f"""{fx.UPD_SQL}, cut AS (SELECT max(slot) // 2 AS c FROM upd),
cp AS (SELECT pubkey, write_version, slot, lamports FROM (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY slot DESC, write_version DESC) AS rn FROM upd, cut WHERE slot <= c) WHERE rn = 1),
later AS (SELECT u.pubkey, write_version, slot, lamports FROM upd u, cut WHERE slot > c),
folded AS (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY slot DESC, write_version DESC) AS rn FROM (SELECT * FROM cp UNION ALL SELECT * FROM later))"""


@query("S14_state_archive", f"WITH {CHECKPOINT_SQL} SELECT pubkey, write_version, slot, lamports FROM folded WHERE rn = 1")
def s14(spark, d):
    """A checkpoint and the updates after it, written as a state archive, checked and folded to the newest state."""
    u = fx.updates(spark, d).select("pubkey", "write_version", "slot", "lamports")
    cut = u.agg(F.max("slot")).first()[0] or 0
    path = scratch(spark, "state")
    base = merge_latest(u.filter(F.col("slot") <= cut // 2), ["pubkey"], ["slot", "write_version"])
    states.write_state_archive(base, u.filter(F.col("slot") > cut // 2), u.select("pubkey").distinct(), path, cut // 2)
    archive = states.read_state_archive(spark, path)
    return archive.state()


@query("S15_snapshot_accounts", f"WITH {fx.UPD_SQL}, cut AS (SELECT max(slot) * 2 // 3 AS c FROM upd), r AS (SELECT pubkey, write_version, lamports, data_len, row_number() OVER (PARTITION BY pubkey ORDER BY slot DESC, write_version DESC) AS rn FROM upd, cut WHERE slot <= c) SELECT pubkey, write_version, lamports, data_len FROM r WHERE rn = 1 AND lamports <> 0")
def s15(spark, d):
    """Of the versions in all index bins the newest visible one of each account; dead accounts are left out."""
    u = fx.updates(spark, d)
    cut = u.agg(F.expr("max(slot) * 2 div 3").alias("c"))
    visible = u.withColumn("_one", F.lit(1)).join(F.broadcast(cut.withColumn("_one", F.lit(1))), "_one").filter("slot <= c").drop("_one", "c")
    return merge_latest(visible, ["pubkey"], ["slot", "write_version"]).filter("lamports <> 0").select("pubkey", "write_version", "lamports", "data_len")


@query("S11_compact_index", f"WITH {fx.TX_SQL}, {fx.BLOCKS_SQL}, n AS (SELECT slot, CAST(sum(bytes) AS BIGINT) AS length FROM tx GROUP BY slot) SELECT slot, md5('node ' || slot) AS cid, CAST(sum(length) OVER (ORDER BY slot) - length AS BIGINT) AS offset, length FROM blocks JOIN n USING (slot)")
def s11(spark, d):
    """Two lookup tables, slot to content id and content id to place, written in hash buckets and joined bucket by bucket."""
    from .ordered import with_running

    n = fx.transactions(spark, d).groupBy("slot").agg(F.sum("bytes").alias("length"))
    nodes = with_running(n, "slot", "length", "end").select("slot", F.md5(F.concat(F.lit("node "), F.col("slot").cast("string"))).alias("cid"), (F.col("end") - F.col("length")).alias("offset"), "length")
    path = scratch(spark, "index")
    formats.write_compact_index(nodes, path)
    return formats.read_compact_index(spark, path, fx.blocks(spark, d).select("slot"))


PHASES = ("transaction", "entry", "block")


@query(
    "S20_replay_events",
    f"""WITH {ENTRY_SQL}, {fx.BLOCKS_SQL}, e AS (SELECT slot, 0 AS phase, tx_idx AS place FROM tx SEMI JOIN blocks USING (slot) UNION ALL SELECT slot, 1, entry_index FROM entries SEMI JOIN blocks USING (slot) UNION ALL SELECT slot, 2, 0 FROM blocks)
SELECT slot, CAST(row_number() OVER (PARTITION BY slot ORDER BY phase, place) - 1 AS INTEGER) AS position, CASE phase WHEN 0 THEN 'transaction' WHEN 1 THEN 'entry' ELSE 'block' END AS kind, CAST(place AS BIGINT) AS place FROM e""",
)
def s20(spark, d):
    """What notifiers see of a slot, in order: its transactions, its entries, then its block."""
    b = fx.blocks(spark, d).select("slot")
    tx = fx.transactions(spark, d).select("slot", F.lit(0).alias("phase"), F.col("tx_idx").alias("place")).join(b, "slot", "left_semi")
    en = entries(spark, d).select("slot", F.lit(1).alias("phase"), F.col("entry_index").cast("bigint").alias("place")).join(b, "slot", "left_semi")
    every = tx.unionByName(en).unionByName(b.select("slot", F.lit(2).alias("phase"), F.lit(0).cast("bigint").alias("place")))
    at = F.row_number().over(Window.partitionBy("slot").orderBy("phase", "place")) - 1  # a slot's events are bounded by the model
    return every.select("slot", at.cast("int").alias("position"), F.element_at(F.array(*map(F.lit, PHASES)), F.col("phase") + 1).alias("kind"), "place")


# -- sinks


@query("K7_pubkey_view", "SELECT DISTINCT l_partkey AS pubkey FROM lineitem")
def k7(spark, d):
    """A view of distinct keys kept up batch by batch, as mentions come in."""
    from ..streaming.live import keep_distinct

    base = scratch(spark, "view")
    fx.instructions(spark, d).select("slot", F.col("key").alias("pubkey")).repartition(3).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("slot bigint, pubkey bigint").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    keep_distinct(stream.select("pubkey"), f"{base}/view", f"{base}/state")
    return spark.read.parquet(f"{base}/view").select("pubkey")


@query("K8_exit_backfill", f"WITH {fx.TX_SQL}, {fx.BLOCKS_SQL} SELECT slot, count(*) AS txs, any_value(least(greatest(block_time, 0), 4294967295)) AS timestamp FROM tx JOIN blocks USING (slot) WHERE slot % 40 = 0 GROUP BY slot")
def k8(spark, d):
    """At exit: rows without a block are drained with timestamp 0, then written again with the time from the slot status."""
    from ..streaming.live import drain, slot_events

    drained = drain(slot_events(spark, d).filter("not (kind = 'block' and slot % 40 = 0)"))
    status = fx.blocks(spark, d).select("slot", "block_time", F.lit(0).alias("indexed_at"))
    return merge_latest(drained.unionByName(backfill_times(drained, status)), ["slot"], ["timestamp"])


@query("K11_account_export", f"WITH {fx.UPD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY write_version DESC) AS rn FROM upd) SELECT pubkey, kind AS owner, data_len AS data_size, lamports FROM r WHERE rn = 1 AND lamports <> 0")
def k11(spark, d):
    """The newest live accounts as CSV with a header, read back."""
    latest = merge_latest(fx.updates(spark, d), ["pubkey"], ["write_version"])
    path = scratch(spark, "accounts")
    formats.export_accounts(latest.select("pubkey", F.col("kind").alias("owner"), F.col("data_len").alias("data_size"), "lamports"), path)
    return spark.read.schema("pubkey bigint, owner string, data_size bigint, lamports bigint").option("header", True).csv(path)


@query("K12_raw_records", f"WITH {fx.TX_SQL} SELECT slot, tx_idx, fee, n_ix, bytes, CAST(slot % 3 AS INTEGER) AS version FROM tx WHERE errored")
def k12(spark, d):
    """Searchable columns beside the whole record; a search reads the record of what it finds."""
    path = scratch(spark, "raw")
    tx = fx.transactions(spark, d).withColumn("version", (F.col("slot") % 3).cast("int"))
    formats.write_raw_records(tx, path, ["slot", "tx_idx", "errored", "version"])
    return formats.read_raw_records(spark, path, F.col("errored")).select("slot", "tx_idx", "record.fee", "record.n_ix", "record.bytes", "version")


@query("K13_null_sink", f"WITH {fx.TX_SQL} SELECT (SELECT count(*) FROM tx) AS transactions, (SELECT CAST(sum(bytes) AS BIGINT) FROM tx) AS bytes, (SELECT count(DISTINCT slot) FROM tx) AS blocks")
def k13(spark, d):
    """A run that only counts: rows go nowhere, observed on the way."""
    tx = fx.transactions(spark, d)
    seen = formats.discard_counting(tx, transactions=F.count(F.lit(1)), bytes=F.sum("bytes"))
    blocks = tx.select("slot").distinct().agg(F.count(F.lit(1)).alias("blocks"))
    return blocks.select(F.lit(seen["transactions"]).alias("transactions"), F.lit(seen["bytes"]).cast("bigint").alias("bytes"), "blocks")


# -- progress and ends


@query("T5_resumed_run", f"WITH {analyses.A1_SQL} SELECT * FROM a1")
def t5(spark, d):
    """A run that stopped half way and is taken up again: slots with progress are skipped, the rest is added, the sink holds all."""
    from ..plans.engine import Engine, fixture_streams

    sink, (lo, hi) = scratch(spark, "sink"), middle(spark, d)
    streams = fixture_streams(spark, d)
    Engine(spark).with_analysis("program-tracking").with_slot_range(lo, max(hi, lo + 1)).with_sink(sink).run(streams)
    engine = Engine(spark).with_analysis("program-tracking").with_sink(sink).resumed()
    engine.run(streams)
    if engine.failures:
        raise RuntimeError(str(engine.failures))
    return formats.read_upserted(spark, f"{sink}/program-tracking")


@query(
    "T6_stream_ends",
    f"""WITH {fx.SLOTS_SQL}, part AS (SELECT slot // 1000 AS epoch, slot, kind = 'block' AS present, kind = 'block' AND NOT (slot // 1000 % 3 = 1 AND slot % 1000 >= 900) AS got FROM slots)
SELECT epoch, max(slot) FILTER (got) AS last_delivered, max(slot) FILTER (present) AS last_present, coalesce(max(slot) FILTER (got), -1) < max(slot) FILTER (present) AS premature FROM part GROUP BY epoch HAVING max(slot) FILTER (present) IS NOT NULL""",
)
def t6(spark, d):
    """Where a stream of an epoch ended before the last slot that the index says is there; one that ends after it is whole."""
    s = fx.slots(spark, d).select(F.expr("slot div 1000").alias("epoch"), "slot", (F.col("kind") == "block").alias("present"))
    delivered = s.filter("present and not (epoch % 3 = 1 and slot % 1000 >= 900)")
    return stream_ends(s.filter("present"), delivered)


def stream_ends(index: DataFrame, delivered: DataFrame) -> DataFrame:
    """(epoch, last_delivered, last_present, premature) from the slots of an index and those that a stream gave."""
    want = index.groupBy("epoch").agg(F.max("slot").alias("last_present"))
    got = delivered.groupBy("epoch").agg(F.max("slot").alias("last_delivered"))
    return want.join(got, "epoch", "left").select("epoch", "last_delivered", "last_present", (F.coalesce("last_delivered", F.lit(-1)) < F.col("last_present")).alias("premature"))


# -- small rules


@query("P11_wanted_streams", f"WITH {fx.TX_SQL} SELECT 'transactions' AS stream, count(*) AS n FROM tx UNION ALL SELECT 'blocks', count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem SEMI JOIN orders ON o_orderkey = l_orderkey) UNION ALL SELECT 'instructions', count(*) FROM lineitem")
def p11(spark, d):
    """Only streams that an analysis asks for are planned; entries and rewards, which none wants, aren't read."""
    from ..plans.engine import REGISTRY, fixture_streams, wanted

    streams = wanted([REGISTRY["program-tracking"], REGISTRY["pubkey-stats"]], fixture_streams(spark, d) | {"entries": None, "rewards": None})
    counts = [df.agg(F.lit(name).alias("stream"), F.count(F.lit(1)).alias("n")) for name, df in sorted(streams.items())]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("P13_replay_ranges", f"WITH r AS (SELECT o_orderkey AS start, o_orderkey + o_custkey % 50 - 5 AS stop FROM orders) SELECT start, stop, start > 0 AND stop >= start AND start // {fx.EPOCH} = stop // {fx.EPOCH} AS valid FROM r")
def p13(spark, d):
    """A replay range starts after slot 0, doesn't run backwards and stays in one epoch."""
    r = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey") % 50 - 5).alias("stop"))
    return r.withColumn("valid", units.valid_replay_range(F.col("start"), F.col("stop"), fx.EPOCH))


@query(
    "F15_varints",
    """WITH v AS (SELECT DISTINCT o_orderkey * 1000003 AS value FROM orders), n AS (SELECT value, CAST(greatest(1, ceil(len(ltrim(bin(value), '0')) / 7.0)) AS INTEGER) AS size, CAST(greatest(1, ceil(len(ltrim(bin(value), '0')) / 8.0)) AS INTEGER) AS raw FROM v)
SELECT value, size AS base128_size, array_to_string(list_transform(range(size), lambda i: lpad(hex((value >> (7 * i)) % 128 + CASE WHEN i < size - 1 THEN 128 ELSE 0 END), 2, '0')), '') AS base128,
  CASE WHEN value < 128 THEN 1 ELSE 1 + raw END AS counted_size, value AS decoded FROM n""",
)
def f15(spark, d):
    """Both number formats: seven bits a byte, and a count of bytes before the bytes; encoded, measured, decoded."""
    v = fx.slot_ids(spark, d).select((F.col("slot") * 1000003).alias("value")).distinct()
    coded = v.withColumns({"b": units.base128(F.col("value")), "c": units.counted(F.col("value"))})
    return coded.select("value", F.octet_length("b").alias("base128_size"), F.hex("b").alias("base128"), F.octet_length("c").alias("counted_size"), units.from_counted(F.col("c")).alias("decoded"))


@query("F18_workers", "SELECT DISTINCT c_custkey % 64 + 1 AS cores, c_custkey % 977 * 64 AS free_mb, greatest(1, least((c_custkey % 64 + 1) * 4, c_custkey % 977 * 64 // 285)) AS workers FROM customer")
def f18(spark, d):
    """Four workers a core, as many as 285 MB each allow, one at least."""
    c = fx.table(spark, d, "customer").select((F.col("c_custkey") % 64 + 1).alias("cores"), (F.col("c_custkey") % 977 * 64).alias("free_mb")).distinct()
    return c.withColumn("workers", F.greatest(F.lit(1), F.least(F.col("cores") * 4, F.expr("free_mb div 285"))))


@query("F22_account_deltas", f"WITH {fx.UPD_SQL}, l AS (SELECT pubkey, write_version, lamports, lag(lamports) OVER (PARTITION BY pubkey ORDER BY write_version) AS p FROM upd) SELECT pubkey, write_version, lamports - coalesce(p, 0) AS delta, lamports AS decoded FROM l")
def f22(spark, d):
    """Each update as its difference from the account's one before, and back by running sums."""
    u = fx.updates(spark, d).select("pubkey", "write_version", "lamports")
    coded = states.account_deltas(u, "lamports")
    return states.from_deltas(coded).select("pubkey", "write_version", "delta", "decoded")
