"""Latest rows by key (K1), account state (A13, T15) and replay rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import fixtures as fx
from ..plans.register import query


def merge_latest(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """One row a key: that of the greatest version, remaining columns breaking ties, so the result is one.

    An aggregate with partial sums, not a window: a key that holds most rows costs one row a task.
    """
    rest = [c for c in rows.columns if c not in key]
    order = F.struct(*version, *[c for c in rest if c not in version])
    best = rows.groupBy(*key).agg(F.max(order).alias("_best"))
    return best.select(*key, *[F.col("_best")[c].alias(c) for c in rest]).select(*rows.columns)


@query("K1_merge_latest", f"WITH {fx.UPD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY write_version DESC) AS rn FROM upd) SELECT pubkey, write_version, slot, lamports, data_len, kind FROM r WHERE rn = 1")
def k1(spark, d):
    u = fx.updates(spark, d)
    return merge_latest(u.unionByName(u), ["pubkey"], ["write_version"])


def live_accounts(latest: DataFrame) -> DataFrame:
    return latest.filter("lamports <> 0")


@query("A13_latest_live_totals", f"WITH {fx.UPD_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY write_version DESC) AS rn FROM upd) SELECT count(*) FILTER (lamports <> 0) AS accounts, count(*) FILTER (lamports = 0) AS skipped_dead, CAST(coalesce(sum(data_len) FILTER (lamports <> 0), 0) AS BIGINT) AS data_bytes, CAST(coalesce(sum(lamports), 0) AS BIGINT) AS lamports FROM r WHERE rn = 1")
def a13(spark, d):
    """Totals of the newest version of each account; balances add up as 128-bit decimals."""
    latest = merge_latest(fx.updates(spark, d).select("pubkey", "write_version", "lamports", "data_len"), ["pubkey"], ["write_version"])
    live = F.col("lamports") != 0
    return latest.agg(
        F.count_if(live).alias("accounts"),
        F.count_if(~live).alias("skipped_dead"),
        F.coalesce(F.sum(F.when(live, F.col("data_len"))), F.lit(0)).alias("data_bytes"),
        F.coalesce(F.sum(F.col("lamports").cast("decimal(38,0)")), F.lit(0)).cast("bigint").alias("lamports"),
    )


def state_at(checkpoint: DataFrame, updates: DataFrame, slot: int) -> DataFrame:
    """State after ``slot``: the checkpoint with the newest update of each account up to then.

    Accounts of the checkpoint that have nothing stay as absent rows; a balance of zero is kept as such.
    """
    up = updates.filter(F.col("slot") <= slot).select("pubkey", "slot", "write_version", "lamports")
    base = checkpoint.select("pubkey", F.lit(-1).cast("bigint").alias("slot"), F.lit(-1).cast("bigint").alias("write_version"), "lamports")
    selected = up.join(checkpoint.select("pubkey"), "pubkey", "left_semi")
    latest = merge_latest(base.unionByName(selected), ["pubkey"], ["slot", "write_version"])
    return latest.withColumn("present", F.col("lamports").isNotNull())


@query(
    "T15_state_at",
    f"""WITH {fx.UPD_SQL}, cp AS (SELECT DISTINCT pubkey, CASE WHEN pubkey % 2 = 0 THEN pubkey * 10 END AS lamports FROM upd UNION SELECT 999999999, NULL),
c AS (SELECT pubkey, -1 AS slot, -1 AS write_version, lamports FROM cp UNION ALL SELECT u.pubkey, slot, write_version, u.lamports FROM upd u SEMI JOIN cp USING (pubkey) WHERE slot <= 2500),
r AS (SELECT *, row_number() OVER (PARTITION BY pubkey ORDER BY slot DESC, write_version DESC) AS rn FROM c)
SELECT pubkey, CAST(slot AS BIGINT) AS slot, CAST(write_version AS BIGINT) AS write_version, lamports, lamports IS NOT NULL AS present FROM r WHERE rn = 1""",
)
def t15(spark, d):
    u = fx.updates(spark, d)
    balance = F.when(F.col("pubkey") % 2 == 0, F.col("pubkey") * 10)
    cp = u.select("pubkey").distinct().unionByName(spark.range(1).select(F.lit(999999999).cast("bigint").alias("pubkey")))
    cp = cp.withColumn("lamports", F.when(F.col("pubkey") < 999999999, balance))
    return state_at(cp, u, 2500)


def supersede(markers: DataFrame) -> DataFrame:
    """One row a slot: a block replaces a skipped marker whenever either came."""
    return markers.groupBy("slot").agg(F.when(F.bool_or(F.col("kind") == "block"), "block").otherwise("skipped").alias("kind"))


@query("T3_supersede", f"WITH {fx.SLOTS_SQL} SELECT slot, kind FROM slots")
def t3(spark, d):
    s = fx.slots(spark, d).select("slot", "kind")
    return supersede(s.unionByName(s.filter("slot % 3 = 0").select("slot", F.lit("skipped").alias("kind"))))


@query("T4_deduplicated_blocks", f"WITH {fx.BLOCKS_SQL} SELECT slot, block_time FROM blocks")
def t4(spark, d):
    """Of the deliveries of a block the first counts, whatever later ones say."""
    b = fx.blocks(spark, d).select("slot", "block_time", F.lit(0).alias("arrival"))
    again = b.filter("slot % 4 = 0").select("slot", (F.col("block_time") - 1).alias("block_time"), F.lit(1).alias("arrival"))
    return b.unionByName(again).groupBy("slot").agg(F.min(F.struct("arrival", "block_time")).alias("f")).select("slot", "f.block_time")


REPLAY_SQL = f"{fx.TX_SQL}, replay AS (SELECT slot, tx_idx, md5(CAST(fee AS VARCHAR)) AS signature FROM tx UNION ALL SELECT slot, tx_idx, md5(CAST(CASE WHEN slot % 90 = 0 THEN fee + 1 ELSE fee END AS VARCHAR)) FROM tx WHERE slot % 30 = 0)"


@query("T7_replay_conflicts", f"WITH {REPLAY_SQL} SELECT slot, tx_idx, count(DISTINCT signature) AS signatures FROM replay GROUP BY 1, 2 HAVING count(DISTINCT signature) > 1")
def t7(spark, d):
    """Positions that a replay filled with another signature; equal repeats are dropped without a word."""
    tx = fx.transactions(spark, d).select("slot", "tx_idx", "fee")
    again = tx.filter("slot % 30 = 0").withColumn("fee", F.when(F.col("slot") % 90 == 0, F.col("fee") + 1).otherwise(F.col("fee")))
    both = tx.unionByName(again).select("slot", "tx_idx", F.md5(F.col("fee").cast("string")).alias("signature"))
    return both.groupBy("slot", "tx_idx").agg(F.countDistinct("signature").alias("signatures")).filter("signatures > 1")


@query("T8_slot_completeness", f"WITH {fx.TX_SQL}, {fx.BLOCKS_SQL} SELECT slot, count(tx_idx) FILTER (tx_idx <> 6) AS processed, count(tx_idx) AS declared, count(tx_idx) FILTER (tx_idx <> 6) = count(tx_idx) AS complete FROM blocks JOIN tx USING (slot) GROUP BY slot")
def t8(spark, d):
    sums = fx.transactions(spark, d).groupBy("slot").agg(F.count_if(F.col("tx_idx") != 6).alias("processed"), F.count(F.lit(1)).alias("declared"))
    return fx.blocks(spark, d).select("slot").join(sums, "slot").withColumn("complete", F.col("processed") == F.col("declared"))


@query("T9_forced_missing", f"WITH {fx.SLOTS_SQL} SELECT slot, CASE WHEN slot % 200 = 0 THEN 'skipped' ELSE kind END AS kind, slot % 200 = 0 AND kind = 'block' AS warned FROM slots")
def t9(spark, d):
    """Slots on the exception list are skipped, with a warning where a block was there."""
    s = fx.slots(spark, d).select("slot", "kind")
    listed = s.filter("slot % 200 = 0").select("slot", F.lit(True).alias("listed"))
    j = s.join(listed, "slot", "left")
    on = F.coalesce("listed", F.lit(False))
    return j.select("slot", F.when(on, "skipped").otherwise(F.col("kind")).alias("kind"), (on & (F.col("kind") == "block")).alias("warned"))


@query("T13_orphan_phases", f"WITH {fx.UPD_SQL}, f AS (SELECT slot, write_version, write_version % 5 = 0 AS is_tx, sum(CASE WHEN write_version % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY slot ORDER BY write_version) AS seen FROM upd) SELECT slot, write_version, CASE WHEN seen = 0 THEN 'pre' ELSE 'post' END AS phase FROM f WHERE NOT is_tx")
def t13(spark, d):
    """Orphan updates before a slot's first transaction are pre, later ones post; a slot's updates are bounded by the model."""
    w = Window.partitionBy("slot").orderBy("write_version").rowsBetween(Window.unboundedPreceding, 0)
    u = fx.updates(spark, d).select("slot", "write_version", (F.col("write_version") % 5 == 0).alias("is_tx"))
    return u.withColumn("seen", F.count_if("is_tx").over(w)).filter("not is_tx").select("slot", "write_version", F.when(F.col("seen") == 0, "pre").otherwise("post").alias("phase"))
