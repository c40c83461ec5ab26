"""Per-slot and per-key aggregates (A1 to A8) and vote tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import siphash_column
from ..functions.ints import clamp_slot, clamp_time, saturate32, wrap32
from ..plans import fixtures as fx
from ..plans.register import query


def program_invocations(ix: DataFrame, tx: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row per slot, program and vote flag; a transaction's units are shared evenly among its instructions."""
    share = F.expr("(cu & 4294967295L) div n_ix")
    per_ix = ix.select("slot", "tx_idx", "program_id").join(tx.select("slot", "tx_idx", "errored", "is_vote", share.alias("share")), ["slot", "tx_idx"])
    sums = per_ix.groupBy("slot", "program_id", "is_vote").agg(
        saturate32(F.count(F.lit(1))).alias("count"),
        saturate32(F.count_if("errored")).alias("error_count"),
        F.min("share").alias("min_cus"),
        F.max("share").alias("max_cus"),
        saturate32(F.sum("share")).alias("total_cus"),
    )
    return sums.join(blocks.select("slot", clamp_time("block_time").alias("timestamp")), "slot").withColumn("slot", clamp_slot("slot"))


A1_SQL = f"""{fx.TX_SQL}, {fx.BLOCKS_SQL}, inv AS (
  SELECT ix.slot, program_id, is_vote, least(count(*), 4294967295) AS count, least(count(*) FILTER (errored), 4294967295) AS error_count,
    min((cu & 4294967295) // n_ix) AS min_cus, max((cu & 4294967295) // n_ix) AS max_cus, CAST(least(sum((cu & 4294967295) // n_ix), 4294967295) AS BIGINT) AS total_cus
  FROM ix JOIN tx ON ix.slot = tx.slot AND ix.tx_idx = tx.tx_idx GROUP BY 1, 2, 3),
a1 AS (SELECT inv.*, least(greatest(block_time, 0), 4294967295) AS timestamp FROM inv JOIN blocks USING (slot))"""


def _a1(spark, d) -> DataFrame:
    return program_invocations(fx.instructions(spark, d), fx.transactions(spark, d), fx.blocks(spark, d))


query("A1_program_invocations", f"WITH {A1_SQL} SELECT * FROM a1")(_a1)


@query(
    "A2_slot_instructions",
    f"""WITH {fx.TX_SQL}, {fx.BLOCKS_SQL} SELECT slot, least(greatest(any_value(block_time), 0), 4294967295) AS timestamp,
  CAST(sum(vote_ix) AS BIGINT) AS vote_instruction_count, CAST(sum(n_ix - vote_ix) AS BIGINT) AS non_vote_instruction_count,
  count(*) FILTER (vote_ix > 0) AS vote_transaction_count, count(*) FILTER (vote_ix = 0) AS non_vote_transaction_count
  FROM tx JOIN blocks USING (slot) GROUP BY slot""",
)
def slot_instructions(spark, d):
    sums = fx.transactions(spark, d).groupBy("slot").agg(
        F.sum("vote_ix").alias("vote_instruction_count"),
        F.sum(F.col("n_ix") - F.col("vote_ix")).alias("non_vote_instruction_count"),
        saturate32(F.count_if(F.col("vote_ix") > 0)).alias("vote_transaction_count"),
        saturate32(F.count_if(F.col("vote_ix") == 0)).alias("non_vote_transaction_count"),
    )
    return sums.join(fx.blocks(spark, d).select("slot", clamp_time("block_time").alias("timestamp")), "slot")


MENTIONS_SQL = f"""{fx.IX_SQL}, {fx.BLOCKS_SQL}, mentions AS (SELECT slot, key AS pubkey, count(*) AS num_mentions,
  least(greatest(any_value(block_time), 0), 4294967295) AS timestamp FROM ix JOIN blocks USING (slot) GROUP BY 1, 2)"""


@query("A3_pubkey_mentions", f"WITH {MENTIONS_SQL} SELECT * FROM mentions")
def pubkey_mentions(spark, d):
    counts = fx.instructions(spark, d).groupBy("slot", F.col("key").alias("pubkey")).agg(F.count(F.lit(1)).alias("num_mentions"))
    return counts.join(fx.blocks(spark, d).select("slot", clamp_time("block_time").alias("timestamp")), "slot")


@query("A4_pubkeys", f"WITH {fx.KEYS_SQL} SELECT key AS pubkey, CAST({fx.siphash_sql('h')} AS DECIMAL(20, 0)) AS id FROM keys")
def pubkeys(spark, d):
    """The key dictionary: distinct keys with their ids, SipHash-2-4 of the key's 32 bytes under a zero key."""
    keys = fx.instructions(spark, d).select(F.col("key").alias("pubkey")).distinct()
    return keys.withColumn("id", siphash_column(F.unhex(F.sha2(F.col("pubkey").cast("string"), 256))).cast("decimal(20,0)"))


@query(
    "A5_account_write_stats",
    f"""WITH {fx.UPD_SQL}, {fx.BLOCKS_SQL} SELECT slot, least(greatest(any_value(block_time), 0), 4294967295) AS timestamp, count(pubkey) AS writes,
  count(DISTINCT pubkey) AS distinct_accounts, CAST(coalesce(sum(data_len), 0) AS BIGINT) AS data_bytes FROM blocks LEFT JOIN upd USING (slot) GROUP BY slot""",
)
def account_write_stats(spark, d):
    return write_stats(fx.updates(spark, d), fx.blocks(spark, d))


def write_stats(updates: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every block has a row, without writes too; writes to skipped slots have none."""
    sums = updates.groupBy("slot").agg(F.count(F.lit(1)).alias("w"), F.countDistinct("pubkey").alias("a"), F.sum("data_len").alias("b"))
    zero = lambda c, n: F.coalesce(c, F.lit(0)).cast("bigint").alias(n)
    return blocks.join(sums, "slot", "left").select("slot", clamp_time("block_time").alias("timestamp"), zero("w", "writes"), zero("a", "distinct_accounts"), zero("b", "data_bytes"))


A7_SQL = f"""WITH {fx.TX_SQL}, {fx.BLOCKS_SQL} SELECT slot, count(*) AS transaction_count, count(*) FILTER (is_vote) AS vote_transaction_count,
  count(*) FILTER (NOT is_vote) AS non_vote_transaction_count, least(slot % 300, 255) AS thread_id, any_value(block_time) AS block_time
  FROM tx JOIN blocks USING (slot) GROUP BY slot"""


@query("A7_slot_status", A7_SQL)
def slot_status(spark, d):
    sums = fx.transactions(spark, d).groupBy("slot").agg(F.count(F.lit(1)).alias("transaction_count"), F.count_if("is_vote").alias("vote_transaction_count"), F.count_if(~F.col("is_vote")).alias("non_vote_transaction_count"))
    return sums.join(fx.blocks(spark, d).select("slot", "block_time"), "slot").withColumn("thread_id", F.least(F.col("slot") % 300, F.lit(255)))


query("K6_slot_status_rows", A7_SQL)(slot_status)


def program_report(a1: DataFrame, top: int = 25) -> DataFrame:
    """Programs by errors; the mean is total units over invocations."""
    sums = a1.groupBy("program_id").agg(F.sum("count").alias("total_count"), F.sum("error_count").alias("total_errors"), F.min("min_cus").alias("min_cus"), F.max("max_cus").alias("max_cus"), F.sum("total_cus").alias("total_cus"))
    return sums.withColumn("avg_cus", F.round(F.col("total_cus") / F.col("total_count"), 6)).orderBy(F.desc("total_errors"), "program_id").limit(top)


A8_SQL = f"""WITH {A1_SQL} SELECT program_id, CAST(sum(count) AS BIGINT) AS total_count, CAST(sum(error_count) AS BIGINT) AS total_errors, min(min_cus) AS min_cus,
  max(max_cus) AS max_cus, CAST(sum(total_cus) AS BIGINT) AS total_cus, round(sum(total_cus) / sum(count), 6) AS avg_cus
  FROM a1 GROUP BY program_id ORDER BY total_errors DESC, program_id LIMIT 25"""
query("A8_program_report", A8_SQL)(lambda spark, d: program_report(_a1(spark, d)))
query("O1_top_errors", f"SELECT program_id, total_errors FROM ({A8_SQL})")(lambda spark, d: program_report(_a1(spark, d)).select("program_id", "total_errors"))


# -- filters


@query("P1_slot_range", f"WITH {fx.BLOCKS_SQL} SELECT slot, block_time FROM blocks WHERE slot >= 500 AND slot < 1500")
def slot_range(spark, d, lo=500, hi=1500):
    return fx.blocks(spark, d).filter(F.col("slot").between(lo, hi - 1)).select("slot", "block_time")


def simple_vote(legacy, signatures, programs, vote=fx.VOTE):
    """Vote by the strict rule: a legacy message, one or two signatures, one instruction, and that of the vote program."""
    return legacy & signatures.between(1, 2) & (F.size(programs) == 1) & F.coalesce(F.get(programs, 0) == vote, F.lit(False))


@query(
    "P2_simple_vote",
    f"""WITH {fx.IX_SQL} SELECT slot, tx_idx, slot % 3 <> 0 AND 1 + tx_idx % 3 <= 2 AND count(*) = 1 AND bool_and(program_id = {fx.VOTE}) AS simple_vote FROM ix GROUP BY slot, tx_idx""",
)
def p2(spark, d):
    tx = fx.instructions(spark, d).groupBy("slot", "tx_idx").agg(F.collect_list("program_id").alias("programs"))
    return tx.select("slot", "tx_idx", simple_vote(F.col("slot") % 3 != 0, 1 + F.col("tx_idx") % 3, F.col("programs")).alias("simple_vote"))


@query("P3_instruction_vote", f"WITH {fx.IX_SQL} SELECT slot, tx_idx, bool_or(program_id = {fx.VOTE}) AS vote FROM ix GROUP BY slot, tx_idx")
def p3(spark, d):
    tx = fx.instructions(spark, d).groupBy("slot", "tx_idx").agg(F.collect_list("program_id").alias("programs"))
    return tx.select("slot", "tx_idx", F.exists("programs", lambda p: p == fx.VOTE).alias("vote"))


@query("P4_first_program_vote", f"WITH {fx.IX_SQL} SELECT slot, tx_idx, min(program_id) = {fx.VOTE} AS vote FROM ix GROUP BY slot, tx_idx")
def p4(spark, d):
    """The first instruction decides; instructions are in the order of their program here."""
    tx = fx.instructions(spark, d).groupBy("slot", "tx_idx").agg(F.sort_array(F.collect_list("program_id")).alias("programs"))
    return tx.select("slot", "tx_idx", (F.get("programs", 0) == fx.VOTE).alias("vote"))


@query("P5_static_programs", f"WITH {fx.IX_SQL}, s AS (SELECT slot, list_sort(list_distinct(list(program_id))) AS k FROM ix GROUP BY slot) SELECT slot, k[1 + i] AS program_id FROM s, (SELECT unnest([0, 2, 4]) AS i) WHERE k[1 + i] IS NOT NULL")
def p5(spark, d):
    """Program ids by index into static keys; an index beyond them is dropped."""
    keys = fx.instructions(spark, d).groupBy("slot").agg(F.sort_array(F.collect_set("program_id")).alias("k"))
    picked = keys.select("slot", F.explode(F.array(*[F.get("k", F.lit(i)) for i in (0, 2, 4)])).alias("program_id"))
    return picked.filter("program_id is not null")


@query("P6_resolved_accounts", f"WITH {fx.IX_SQL}, s AS (SELECT slot, list_sort(list_distinct(list(program_id))) AS a, list_sort(list_distinct(list(key))) AS b FROM ix GROUP BY slot) SELECT slot, list_concat(a, b)[4] AS account FROM s")
def p6(spark, d):
    """Index 3 over static keys followed by loaded ones; null beyond the end."""
    keys = fx.instructions(spark, d).groupBy("slot").agg(F.sort_array(F.collect_set("program_id")).alias("a"), F.sort_array(F.collect_set("key")).alias("b"))
    return keys.select("slot", F.get(F.concat("a", "b"), F.lit(3)).alias("account"))


@query("P7_skipped_filter", f"WITH {fx.SLOTS_SQL} SELECT kind, count(*) AS slots FROM slots GROUP BY kind")
def p7(spark, d):
    return fx.slots(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("slots"))


@query("P8_live_accounts", f"WITH {fx.UPD_SQL} SELECT count(*) FILTER (lamports <> 0) AS live, count(*) FILTER (lamports = 0) AS dead FROM upd")
def p8(spark, d):
    return fx.updates(spark, d).agg(F.count_if(F.col("lamports") != 0).alias("live"), F.count_if(F.col("lamports") == 0).alias("dead"))


@query("P10_column_elision", f"WITH {fx.UPD_SQL} SELECT slot, count(*) AS writes FROM upd GROUP BY slot")
def p10(spark, d):
    """Counts alone: the scan reads neither payload nor balance columns."""
    return fx.updates(spark, d).groupBy("slot").agg(F.count(F.lit(1)).alias("writes"))


@query(
    "P14_normalised_records",
    """SELECT l_orderkey AS slot, CAST(l_linenumber AS BIGINT) AS tx_idx, TRY_CAST(CAST(floor(l_extendedprice) AS BIGINT) AS BIGINT) AS amount,
  nullif(CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END, '') AS owner, l_suppkey <= 256 AS within_limit FROM lineitem""",
)
def p14(spark, d):
    """Token amounts from strings, empty owners to null, list limits as a check column."""
    li = fx.table(spark, d, "lineitem")
    amount = F.floor("l_extendedprice").cast("bigint").cast("string")
    owner = F.when(F.col("l_returnflag") == "N", F.lit("")).otherwise(F.col("l_returnflag"))
    return li.select(
        F.col("l_orderkey").alias("slot"), F.col("l_linenumber").cast("bigint").alias("tx_idx"), amount.try_cast("decimal(20,0)").cast("bigint").alias("amount"), F.nullif(owner, F.lit("")).alias("owner"), (F.col("l_suppkey") <= 256).alias("within_limit")
    )
