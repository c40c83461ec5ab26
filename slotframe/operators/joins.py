"""Joins of the ledger model (J1 to J14) and checks that are joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import fixtures as fx
from ..plans.register import query
from .analyses import A1_SQL, _a1
from .ordered import with_last_present, with_running


def backfill_times(rows: DataFrame, status: DataFrame) -> DataFrame:
    """Rows whose timestamp is 0 with the slot's block time; one status row a slot, the newest, so rows don't multiply."""
    newest = status.filter("block_time > 0").groupBy("slot").agg(F.max_by("block_time", "indexed_at").alias("_t"))
    return rows.filter("timestamp = 0").join(newest, "slot").withColumn("timestamp", F.col("_t")).drop("_t")


@query(
    "J1_backfill",
    f"""WITH {A1_SQL}, st AS (SELECT slot, block_time + v AS block_time, v AS indexed_at FROM blocks, (SELECT unnest([0, 1]) AS v)),
newest AS (SELECT slot, arg_max(block_time, indexed_at) AS t FROM st WHERE block_time > 0 GROUP BY slot)
SELECT slot, program_id, is_vote, count, t AS timestamp FROM a1 JOIN newest USING (slot) WHERE slot % 5 = 0""",
)
def j1(spark, d):
    rows = _a1(spark, d).withColumn("timestamp", F.when(F.col("slot") % 5 == 0, F.lit(0)).otherwise(F.col("timestamp")))
    b = fx.blocks(spark, d).select("slot", "block_time")
    status = b.withColumn("indexed_at", F.lit(0)).unionByName(b.select("slot", F.col("block_time") + 1, F.lit(1)).toDF("slot", "block_time", "indexed_at"))
    return backfill_times(rows, status).select("slot", "program_id", "is_vote", "count", "timestamp")


OWN_SQL = f"{fx.TX_SQL}, {fx.UPD_SQL}, own AS (SELECT upd.*, write_version % 9 AS tx_ref FROM upd)"


def _owned(spark, d):
    return fx.updates(spark, d).withColumn("tx_ref", F.col("write_version") % 9)


@query(
    "J2_update_owner",
    f"""WITH {OWN_SQL} SELECT tx.slot, tx_idx, list(write_version ORDER BY write_version) FILTER (write_version IS NOT NULL) AS versions
  FROM tx LEFT JOIN own ON own.slot = tx.slot AND tx_ref = tx_idx GROUP BY 1, 2 HAVING count(write_version) > 0""",
)
def j2(spark, d):
    """Updates of each transaction in write order."""
    own = _owned(spark, d).groupBy("slot", F.col("tx_ref").alias("tx_idx")).agg(F.sort_array(F.collect_list("write_version")).alias("versions"))
    return fx.transactions(spark, d).select("slot", "tx_idx").join(own, ["slot", "tx_idx"])


@query("J3_orphan_updates", f"WITH {OWN_SQL} SELECT write_version, slot FROM own ANTI JOIN tx ON own.slot = tx.slot AND tx_ref = tx_idx")
def j3(spark, d):
    tx = fx.transactions(spark, d).select("slot", F.col("tx_idx").alias("tx_ref"))
    return _owned(spark, d).join(tx, ["slot", "tx_ref"], "left_anti").select("write_version", "slot")


ENTRY_SQL = f"""{fx.TX_SQL}, entry AS (SELECT slot, (row_number() OVER (PARTITION BY slot ORDER BY tx_idx) - 1) // 2 AS entry_index, tx_idx FROM tx),
entries AS (SELECT slot, entry_index, count(*) AS tx_count FROM entry GROUP BY 1, 2)"""


def entries(spark, d) -> DataFrame:
    """Entries of two transactions each, with their counts."""
    w = Window.partitionBy("slot").orderBy("tx_idx")
    e = fx.transactions(spark, d).select("slot", F.floor((F.row_number().over(w) - 1) / 2).alias("entry_index"))
    return e.groupBy("slot", "entry_index").agg(F.count(F.lit(1)).alias("tx_count"))


def entry_ranges(e: DataFrame) -> DataFrame:
    """Half-open transaction ranges from running counts within a slot."""
    running = F.sum("tx_count").over(Window.partitionBy("slot").orderBy("entry_index").rowsBetween(Window.unboundedPreceding, 0))
    return e.withColumn("tx_end", running).withColumn("tx_start", running - F.col("tx_count"))


@query(
    "J4_entry_of_transaction",
    f"""WITH {ENTRY_SQL}, r AS (SELECT slot, entry_index, CAST(sum(tx_count) OVER (PARTITION BY slot ORDER BY entry_index) - tx_count AS BIGINT) AS tx_start, tx_count FROM entries)
SELECT slot, entry_index, tx_start + k AS tx_pos FROM r, (SELECT unnest(range(2)) AS k) WHERE k < tx_count""",
)
def j4(spark, d):
    """The entry of each transaction: ranges exploded to positions, an equi-join key, not a theta join."""
    r = entry_ranges(entries(spark, d)).filter("tx_end > tx_start")
    return r.select("slot", "entry_index", F.explode(F.sequence("tx_start", F.col("tx_end") - 1)).alias("tx_pos"))


MANIFEST_SQL = "manifest AS (SELECT k AS pubkey, row_number() OVER (ORDER BY k) - 1 AS ordinal FROM (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'purchase' AND value >= 200 UNION SELECT 999999999))"


def manifest(spark, d) -> DataFrame:
    """Selected accounts, those with a large purchase, with their ordinals; one of them is absent from the updates."""
    keys = fx.updates(spark, d).filter("kind = 'purchase' and lamports >= 20000").select("pubkey").unionByName(spark.range(1).select(F.lit(999999999).cast("bigint").alias("pubkey"))).distinct()
    return with_running(keys.withColumn("one", F.lit(1)), "pubkey", "one", "n").select("pubkey", (F.col("n") - 1).cast("int").alias("ordinal"))


@query("J5_manifest_ordinals", f"WITH {fx.UPD_SQL}, {MANIFEST_SQL} SELECT write_version, CAST(ordinal AS INTEGER) AS ordinal FROM upd JOIN manifest USING (pubkey)")
def j5(spark, d):
    return fx.updates(spark, d).join(manifest(spark, d), "pubkey").select("write_version", "ordinal")


@query("P9_selected_accounts", f"WITH {fx.UPD_SQL}, {MANIFEST_SQL} SELECT write_version, pubkey, data_len FROM upd SEMI JOIN manifest USING (pubkey)")
def p9(spark, d):
    """The filter comes before the payload is read; the planner broadcasts the list if it is small."""
    return fx.updates(spark, d).join(manifest(spark, d), "pubkey", "left_semi").select("write_version", "pubkey", "data_len")


@query(
    "J6_snapshot_hashes",
    f"""WITH {fx.BLOCKS_SQL}, want AS (SELECT slot, md5(CAST(slot AS VARCHAR)) AS h FROM blocks WHERE slot % 100 = 0 UNION ALL SELECT -1, 'x'),
got AS (SELECT slot, md5(CAST(CASE WHEN slot % 300 = 0 THEN slot + 1 ELSE slot END AS VARCHAR)) AS h FROM blocks WHERE slot % 50 = 0)
SELECT coalesce(want.slot, got.slot) AS slot, CASE WHEN got.slot IS NULL THEN 'missing' WHEN want.slot IS NULL THEN 'unexpected' WHEN want.h = got.h THEN 'match' ELSE 'mismatch' END AS verdict
FROM want FULL JOIN got ON want.slot = got.slot""",
)
def j6(spark, d):
    b = fx.blocks(spark, d).select("slot")
    h = lambda c: F.md5(c.cast("string"))
    want = b.filter("slot % 100 = 0").withColumn("want", h(F.col("slot"))).unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("slot"), F.lit("x").alias("want")))
    got = b.filter("slot % 50 = 0").withColumn("got", h(F.when(F.col("slot") % 300 == 0, F.col("slot") + 1).otherwise(F.col("slot"))))
    verdict = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") == F.col("got"), "match").otherwise("mismatch")
    return want.join(got, "slot", "full_outer").select("slot", verdict.alias("verdict"))


def calendar(rows: DataFrame, width: int = 4096) -> DataFrame:
    """Every slot from the first to the last of ``rows``: runs of ``width`` slots are dealt out, then each is filled."""
    ends = rows.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    runs = ends.withColumn("run", F.explode(F.expr(f"sequence(lo div {width}, hi div {width})"))).repartition("run")
    return runs.select(F.explode(F.expr(f"sequence(greatest(lo, run * {width}), least(hi, run * {width} + {width - 1}))")).alias("slot"))


def calendar_sql(table: str) -> str:
    return f"(SELECT unnest(range((SELECT min(slot) FROM {table}), (SELECT max(slot) + 1 FROM {table}))) AS slot)"


@query("J7_calendar_frames", f"WITH {fx.TX_SQL}, {fx.SLOTS_SQL} SELECT s.slot, count(tx_idx) AS txs FROM {calendar_sql('slots')} s LEFT JOIN tx USING (slot) GROUP BY s.slot")
def j7(spark, d):
    """Every slot of the ledger's range has a row, an empty one too."""
    counts = fx.transactions(spark, d).groupBy("slot").agg(F.count(F.lit(1)).alias("txs"))
    return calendar(fx.slot_ids(spark, d)).join(counts, "slot", "left").fillna(0, ["txs"])


@query("K10_slot_frames", f"WITH {fx.UPD_SQL} SELECT s.slot, count(write_version) AS updates FROM {calendar_sql('upd')} s LEFT JOIN upd USING (slot) GROUP BY s.slot")
def k10(spark, d):
    """A frame for every slot from the first update to the last, empty ones too."""
    u = fx.updates(spark, d)
    return calendar(u.select("slot")).join(u.groupBy("slot").agg(F.count(F.lit(1)).alias("updates")), "slot", "left").fillna(0, ["updates"])


@query(
    "J8_nearest_present",
    f"""WITH {fx.SLOTS_SQL} SELECT slot, CASE WHEN slot - p <= 64 THEN p END AS previous, n AS next FROM (
  SELECT slot, kind, max(CASE WHEN kind = 'block' THEN slot END) OVER (ORDER BY slot) AS p, min(CASE WHEN kind = 'block' THEN slot END) OVER (ORDER BY slot DESC) AS n FROM slots) WHERE kind = 'skipped'""",
)
def j8(spark, d):
    """For each skipped slot the present one before, at most 64 back, and the one after."""
    s = fx.slots(spark, d).select("slot", "kind")
    s = with_last_present(s, "slot", F.col("kind") == "block", "p")
    s = with_last_present(s, "slot", F.col("kind") == "block", "next", forward=True)
    return s.filter("kind = 'skipped'").select("slot", F.when(F.col("slot") - F.col("p") <= 64, F.col("p")).alias("previous"), "next")


SNAP_SQL = f"{fx.BLOCKS_SQL}, snaps AS (SELECT slot FROM blocks WHERE slot % 700 = 0), targets AS (SELECT slot AS target FROM blocks)"


@query("J9_newest_snapshot", f"WITH {SNAP_SQL} SELECT target, s.slot AS snapshot FROM targets ASOF LEFT JOIN snaps s ON target >= s.slot")
def j9(spark, d):
    """The newest snapshot at or before each block, in one pass in slot order; a snapshot is taken at every 700th slot that holds a block."""
    found = with_last_present(fx.blocks(spark, d).select("slot"), "slot", F.col("slot") % 700 == 0, "snapshot")
    return found.select(F.col("slot").alias("target"), "snapshot")


@query("J10_bucket_of_slot", f"WITH {fx.BLOCKS_SQL} SELECT least(slot // 128, 9) AS bucket, count(*) AS blocks, min(slot) AS first_slot FROM blocks GROUP BY 1")
def j10(spark, d):
    """Buckets of 128 slots, the last of ten open-ended."""
    bucket = F.least(F.expr("slot div 128"), F.lit(9)).alias("bucket")
    return fx.blocks(spark, d).groupBy(bucket).agg(F.count(F.lit(1)).alias("blocks"), F.min("slot").alias("first_slot"))


@query("J11_point_lookup", f"WITH {fx.BLOCKS_SQL} SELECT slot, md5(CAST(slot AS VARCHAR)) AS cid FROM blocks WHERE slot IN (3, 70, 1000)")
def j11(spark, d):
    b = fx.blocks(spark, d).select("slot", F.md5(F.col("slot").cast("string")).alias("cid"))
    wanted = spark.createDataFrame([(3,), (70,), (1000,)], "slot bigint").select(F.md5(F.col("slot").cast("string")).alias("cid"))
    return b.join(wanted, "cid", "left_semi").select("slot", "cid")


@query("J12_range_reconcile", f"WITH {fx.SLOTS_SQL} SELECT min(slot) AS lo, max(slot) AS hi, min(slot) FILTER (kind = 'block') AS block_lo, max(slot) FILTER (kind = 'block') AS block_hi, min(slot) = min(slot) FILTER (kind = 'block') AND max(slot) = max(slot) FILTER (kind = 'block') AS equal FROM slots")
def j12(spark, d):
    block = F.when(F.col("kind") == "block", F.col("slot"))
    r = fx.slots(spark, d).agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.min(block).alias("block_lo"), F.max(block).alias("block_hi"))
    return r.withColumn("equal", (F.col("lo") == F.col("block_lo")) & (F.col("hi") == F.col("block_hi")))


@query(
    "J13_completeness",
    f"""WITH {fx.TX_SQL}, {fx.SLOTS_SQL}, got AS (SELECT slot, count(*) AS n FROM tx WHERE slot % 7 <> 0 OR tx_idx > 1 GROUP BY slot),
want AS (SELECT slot, count(*) AS n FROM tx WHERE slot % 11 <> 0 GROUP BY slot)
SELECT s.slot, CASE WHEN got.n IS NULL AND want.n IS NULL THEN 'NO DATA' WHEN want.n IS NULL THEN 'INCOMPLETE (no block metadata)'
  WHEN coalesce(got.n, 0) < want.n THEN 'INCOMPLETE (fewer)' ELSE 'COMPLETE' END AS verdict
FROM {calendar_sql('slots')} s LEFT JOIN got USING (slot) LEFT JOIN want USING (slot)""",
)
def j13(spark, d):
    """Delivered against declared counts for every slot of the ledger's range."""
    tx = fx.transactions(spark, d).select("slot", "tx_idx")
    got = tx.filter("slot % 7 <> 0 or tx_idx > 1").groupBy("slot").agg(F.count(F.lit(1)).alias("got"))
    want = tx.filter("slot % 11 <> 0").groupBy("slot").agg(F.count(F.lit(1)).alias("want"))
    verdict = (
        F.when(F.col("got").isNull() & F.col("want").isNull(), "NO DATA").when(F.col("want").isNull(), "INCOMPLETE (no block metadata)").when(F.coalesce("got", F.lit(0)) < F.col("want"), "INCOMPLETE (fewer)").otherwise("COMPLETE")
    )
    return calendar(fx.slot_ids(spark, d)).join(got, "slot", "left").join(want, "slot", "left").select("slot", verdict.alias("verdict"))


@query(
    "J14_status_compare",
    f"""WITH {fx.TX_SQL} SELECT slot, tx_idx, errored AS expected, CASE WHEN tx_idx = 5 THEN NULL ELSE errored <> (slot % 13 = 0) END AS actual FROM tx
WHERE errored IS DISTINCT FROM CASE WHEN tx_idx = 5 THEN NULL ELSE errored <> (slot % 13 = 0) END""",
)
def j14(spark, d):
    """Expected against actual status; only what differs, a missing side too."""
    tx = fx.transactions(spark, d).select("slot", "tx_idx", "errored")
    want = tx.withColumnRenamed("errored", "expected")
    got = tx.filter("tx_idx <> 5").select("slot", "tx_idx", (F.col("errored") != (F.col("slot") % 13 == 0)).alias("actual"))
    return want.join(got, ["slot", "tx_idx"], "full_outer").filter("not (expected <=> actual)")


@query("K5_unprocessed_slots", f"WITH {fx.BLOCKS_SQL} SELECT p.plugin_id, slot FROM blocks, (SELECT unnest([1, 2]) AS plugin_id) p WHERE NOT (plugin_id = 1 AND slot % 10 <> 0)")
def k5(spark, d):
    """Slots that a plugin has no progress row for."""
    b = fx.blocks(spark, d).select("slot")
    plugins = spark.createDataFrame([(1,), (2,)], "plugin_id int")
    done = b.filter("slot % 10 <> 0").select(F.lit(1).alias("plugin_id"), "slot")
    every = b.withColumn("plugin_id", F.explode(F.array(F.lit(1), F.lit(2))))
    return every.join(F.broadcast(plugins), "plugin_id", "left_semi").join(done, ["plugin_id", "slot"], "left_anti").select("plugin_id", "slot")
