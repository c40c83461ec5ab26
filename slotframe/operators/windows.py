"""Order-dependent operators (W1 to W12) and break classes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import fixtures as fx
from ..plans.register import query
from .joins import ENTRY_SQL, entries, entry_ranges
from .ordered import with_previous, with_running

ZERO = "0" * 32
CHAIN_SQL = f"""{fx.BLOCKS_SQL}, chain AS (SELECT slot, md5(CAST(slot AS VARCHAR)) AS blockhash, lag(md5(CAST(slot AS VARCHAR))) OVER (ORDER BY slot) AS prev_blockhash FROM blocks),
linked AS (SELECT *, CASE WHEN slot % 101 = 0 THEN '{ZERO}' WHEN slot % 97 = 0 THEN md5('x') ELSE coalesce(prev_blockhash, md5('seed')) END AS parent_blockhash FROM chain)"""


def _chain(spark, d) -> DataFrame:
    b = with_previous(fx.blocks(spark, d).select("slot", F.md5(F.col("slot").cast("string")).alias("blockhash")), "slot", ["blockhash"])
    parent = F.when(F.col("slot") % 101 == 0, ZERO).when(F.col("slot") % 97 == 0, F.md5(F.lit("x"))).otherwise(F.coalesce("prev_blockhash", F.md5(F.lit("seed"))))
    return b.withColumn("parent_blockhash", parent).drop("prev_blockhash")


def chain_breaks(blocks: DataFrame, seed: str | None = None) -> DataFrame:
    """Blocks whose parent hash isn't the hash of the block before; the first is held against ``seed`` if there is one."""
    expected = F.coalesce("prev_blockhash", F.lit(seed))
    b = with_previous(blocks, "slot", ["blockhash"]).withColumn("expected", expected)
    kind = F.when(F.col("parent_blockhash") == ZERO, "resume artifact").otherwise("break")
    return b.filter(F.col("expected").isNotNull() & (F.col("expected") != F.col("parent_blockhash"))).select("slot", "expected", "parent_blockhash", kind.alias("kind"))


W1_SQL = f"WITH {CHAIN_SQL} SELECT slot, coalesce(prev_blockhash, md5('seed')) AS expected, parent_blockhash, CASE WHEN parent_blockhash = '{ZERO}' THEN 'resume artifact' ELSE 'break' END AS kind FROM linked WHERE coalesce(prev_blockhash, md5('seed')) <> parent_blockhash"


@query("W1_chain_breaks", W1_SQL)
def w1(spark, d):
    import hashlib

    return chain_breaks(_chain(spark, d), hashlib.md5(b"seed", usedforsecurity=False).hexdigest())


@query("P12_break_classes", f"SELECT kind, count(*) AS breaks FROM ({W1_SQL}) GROUP BY kind")
def p12(spark, d):
    return w1(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("breaks"))


def skipped_slots(blocks: DataFrame, epoch: int) -> DataFrame:
    """Slots between consecutive blocks of one epoch; none before an epoch's first block or behind the last one."""
    gap = with_previous(blocks.select("slot"), "slot", ["slot"]).filter(F.expr(f"slot > prev_slot + 1 and slot div {epoch} = prev_slot div {epoch}"))
    return gap.select(F.explode(F.sequence(F.col("prev_slot") + 1, F.col("slot") - 1)).alias("slot"))


@query("W2_skipped_slots", f"WITH {fx.BLOCKS_SQL}, g AS (SELECT slot, lag(slot) OVER (ORDER BY slot) AS p FROM blocks) SELECT unnest(range(p + 1, slot)) AS slot FROM g WHERE slot // {fx.EPOCH} = p // {fx.EPOCH} AND slot > p + 1")
def w2(spark, d):
    return skipped_slots(fx.blocks(spark, d), fx.EPOCH)


@query("W3_entry_offsets", f"WITH {ENTRY_SQL} SELECT slot, entry_index, tx_count, CAST(sum(tx_count) OVER w - tx_count AS BIGINT) AS tx_start, CAST(sum(tx_count) OVER w AS BIGINT) AS tx_end FROM entries WINDOW w AS (PARTITION BY slot ORDER BY entry_index)")
def w3(spark, d):
    return entry_ranges(entries(spark, d))


@query("W4_slot_windows", f"WITH {fx.TX_SQL}, lo AS (SELECT min(slot) AS f FROM tx) SELECT (slot - f) // 1000 AS window, count(*) AS txs, CAST(sum(fee) AS BIGINT) AS fees FROM tx, lo GROUP BY 1")
def w4(spark, d, width=1000):
    """Windows of slots aligned to the first one."""
    per = fx.transactions(spark, d).groupBy("slot").agg(F.count(F.lit(1)).alias("txs"), F.sum("fee").alias("fees"))
    first = fx.instructions(spark, d).agg(F.min("slot").alias("first"))
    per = per.withColumn("_one", F.lit(1)).join(F.broadcast(first.withColumn("_one", F.lit(1))), "_one")
    return per.groupBy(F.expr(f"(slot - first) div {width}").alias("window")).agg(F.sum("txs").alias("txs"), F.sum("fees").alias("fees"))


PULSE_SQL = f"{fx.BLOCKS_SQL}, {fx.TX_SQL}, per AS (SELECT slot, count(*) AS n FROM tx GROUP BY slot), pulse AS (SELECT slot, CAST(sum(n) OVER (ORDER BY slot) AS BIGINT) AS total FROM per)"


def _totals(spark, d) -> DataFrame:
    per = fx.transactions(spark, d).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    return with_running(per, "slot", "n", "total").select("slot", "total")


@query("W6_pulse_rates", f"WITH {PULSE_SQL}, p AS (SELECT slot, total, lag(total) OVER (ORDER BY slot) AS pt, lag(slot) OVER (ORDER BY slot) AS ps FROM pulse WHERE slot % 100 = 0) SELECT slot, total, round(CASE WHEN total - pt > 0 THEN (total - pt) / (slot - ps) ELSE total / (slot + 1) END, 6) AS rate FROM p")
def w6(spark, d):
    """Transactions a slot between pulses; the mean since the start where a pulse adds nothing."""
    p = with_previous(_totals(spark, d).filter("slot % 100 = 0"), "slot", ["total", "slot"])
    rate = F.when(F.col("total") - F.col("prev_total") > 0, (F.col("total") - F.col("prev_total")) / (F.col("slot") - F.col("prev_slot"))).otherwise(F.col("total") / (F.col("slot") + 1))
    return p.select("slot", "total", F.round(rate, 6).alias("rate"))


@query("W7_trailing_rates", f"WITH {fx.TX_SQL}, per AS (SELECT slot // 20 AS second, count(*) AS n FROM tx GROUP BY 1), w AS (SELECT second, round(sum(n) OVER (ORDER BY second RANGE BETWEEN 4 PRECEDING AND CURRENT ROW) / 5, 6) AS tps FROM per) SELECT * FROM w")
def w7(spark, d, trail=5):
    """Mean rate of the last five seconds: each second's count goes to the five windows that hold it, then adds up."""
    per = fx.transactions(spark, d).groupBy(F.expr("slot div 20").alias("second")).agg(F.count(F.lit(1)).alias("n"))
    spread = per.select(F.explode(F.sequence(F.col("second"), F.col("second") + trail - 1)).alias("second"), "n").groupBy("second").agg(F.sum("n").alias("s"))
    return per.select("second").join(spread, "second").select("second", F.round(F.col("s") / trail, 6).alias("tps"))


@query("W7_downsampled", f"WITH {fx.TX_SQL}, per AS (SELECT slot // 20 AS second, count(*) AS n FROM tx GROUP BY 1) SELECT second // 60 AS bucket, round(avg(n), 6) AS mean, max(n) AS peak FROM per GROUP BY 1")
def w7b(spark, d):
    per = fx.transactions(spark, d).groupBy(F.expr("slot div 20").alias("second")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(F.expr("second div 60").alias("bucket")).agg(F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("peak"))


@query("W8_range_contiguity", f"WITH {ENTRY_SQL}, r AS (SELECT slot, entry_index, CAST(sum(tx_count) OVER w - tx_count AS BIGINT) + CASE WHEN slot % 50 = 0 AND entry_index = 1 THEN 1 ELSE 0 END AS s, CAST(sum(tx_count) OVER w AS BIGINT) AS e FROM entries WINDOW w AS (PARTITION BY slot ORDER BY entry_index)) SELECT slot, entry_index, s AS tx_start, coalesce(p, 0) AS expected FROM (SELECT *, lag(e) OVER (PARTITION BY slot ORDER BY entry_index) AS p FROM r) WHERE s <> coalesce(p, 0)")
def w8(spark, d):
    """Entries that don't start where the one before ended; a slot starts at 0."""
    r = entry_ranges(entries(spark, d)).withColumn("tx_start", F.col("tx_start") + F.expr("cast(slot % 50 = 0 and entry_index = 1 as bigint)"))
    expected = F.coalesce(F.lag("tx_end").over(Window.partitionBy("slot").orderBy("entry_index")), F.lit(0))
    return r.withColumn("expected", expected).filter("tx_start <> expected").select("slot", "entry_index", "tx_start", "expected")


@query("W9_running_peak", f"WITH {fx.TX_SQL}, per AS (SELECT slot, CAST(sum(fee) AS BIGINT) AS f FROM tx GROUP BY slot) SELECT slot, f AS fees, max(f) OVER (ORDER BY slot) AS peak FROM per")
def w9(spark, d):
    per = fx.transactions(spark, d).groupBy("slot").agg(F.sum("fee").alias("fees"))
    return with_running(per, "slot", "fees", "peak", F.max)


EPOCH_BYTES_SQL = f"{fx.TX_SQL}, eb AS (SELECT slot // 500 AS epoch, CAST(sum(bytes) AS BIGINT) AS bytes FROM tx GROUP BY 1)"


@query("W10_running_archive_bytes", f"WITH {EPOCH_BYTES_SQL} SELECT epoch, bytes, CAST(sum(bytes) OVER (ORDER BY epoch) AS BIGINT) AS total FROM eb")
def w10(spark, d):
    per = fx.transactions(spark, d).groupBy(F.expr("slot div 500").alias("epoch")).agg(F.sum("bytes").alias("bytes"))
    return with_running(per, "epoch", "bytes", "total")


query("S19_archive_inventory", f"WITH {EPOCH_BYTES_SQL} SELECT epoch, bytes, CAST(sum(bytes) OVER (ORDER BY epoch) AS BIGINT) AS total, bytes > 0 AS available FROM eb")(lambda spark, d: w10(spark, d).withColumn("available", F.col("bytes") > 0))


def conflict_rounds(slots, writes, reads) -> list[int]:
    """Rounds of entries in order: a writer follows every earlier access to a key in its slot, a reader the last writer of it."""
    return list(_rounds(zip(slots, writes, reads, strict=True), {}))


def _rounds(entries, state: dict) -> Iterator[int]:
    """``state`` holds what a slot that goes on in the next batch needs."""
    for slot, writes, reads in entries:
        if state.get("slot", ()) != slot:
            state.update(slot=slot, accessed={}, written={})
        accessed, written = state["accessed"], state["written"]
        writes, reads = ([] if x is None else list(x) for x in (writes, reads))
        r = max([0, *(accessed.get(k, -1) + 1 for k in writes), *(written.get(k, -1) + 1 for k in reads)])
        for k in writes:
            written[k] = accessed[k] = max(r, accessed.get(k, -1))
        for k in reads:
            accessed[k] = max(r, accessed.get(k, -1))
        yield r


def plan_rounds(footprints: DataFrame) -> DataFrame:
    """The recurrence has no window form: entries are streamed in order, a slot's keys being all that is held."""

    def run(batches):
        state: dict = {}
        for pdf in batches:
            rounds = list(_rounds(zip(pdf["slot"], pdf["writes"], pdf["reads"], strict=True), state))
            yield pd.DataFrame({"slot": pdf["slot"], "entry_index": pdf["entry_index"], "round": rounds})

    ordered = footprints.repartition("slot").sortWithinPartitions("slot", "entry_index")
    return ordered.mapInPandas(run, "slot bigint, entry_index bigint, round bigint")


@query("W11_conflict_rounds")
def w11(spark, d):
    ix = fx.instructions(spark, d)
    f = ix.groupBy("slot", F.col("tx_idx").alias("entry_index")).agg(
        F.collect_set(F.when(F.col("program_id") % 3 == 0, F.col("program_id") % 10)).alias("writes"), F.collect_set(F.when(F.col("program_id") % 3 != 0, F.col("program_id") % 10)).alias("reads")
    )
    return plan_rounds(f)


VERSIONS_SQL = f"{fx.BLOCKS_SQL}, v AS (SELECT slot, slot // 700 AS major, slot // 350 AS minor, leader % 5 = 0 AND slot % 350 > 175 AS patch FROM blocks)"


@query("W12_change_points", f"WITH {VERSIONS_SQL}, x AS (SELECT slot, major || '.' || minor AS version FROM v) SELECT slot, version FROM (SELECT *, lag(version) OVER (ORDER BY slot) AS p FROM x) WHERE version IS DISTINCT FROM p")
def w12(spark, d):
    """The slots at which (major, minor) changes."""
    v = fx.blocks(spark, d).select("slot", F.concat_ws(".", F.expr("slot div 700"), F.expr("slot div 350")).alias("version"))
    return with_previous(v, "slot", ["version"]).filter("not (version <=> prev_version)").select("slot", "version")
