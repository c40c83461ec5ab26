"""Aggregates and reports (A9 to A20), sorts, limits and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import fixtures as fx
from ..plans.register import query
from .joins import calendar, calendar_sql
from .state import merge_latest
from .ordered import with_previous, with_running

REFS_SQL = f"{fx.IX_SQL}, refs AS (SELECT slot, key AS pubkey FROM ix UNION ALL SELECT slot, program_id FROM ix)"
WINDOWS_SQL = f"""{REFS_SQL}, lo AS (SELECT min(slot) AS f FROM refs), per AS (SELECT (slot - f) // 1000 AS slot_window, pubkey, count(*) AS n FROM refs, lo GROUP BY 1, 2),
win AS (SELECT slot_window, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS multi_keys, CAST(sum(n) AS BIGINT) AS refs FROM per GROUP BY slot_window)"""


def references(spark, d) -> DataFrame:
    """Every key reference: account keys and programs."""
    ix = fx.instructions(spark, d)
    return ix.select("slot", F.col("key").alias("pubkey")).unionByName(ix.select("slot", F.col("program_id").alias("pubkey")))


def key_windows(refs: DataFrame, width: int = 1000) -> DataFrame:
    """For each window of slots: distinct keys, keys with more than one reference, references."""
    first = refs.agg(F.min("slot").alias("first"))
    per = beside(refs.groupBy("slot", "pubkey").agg(F.count(F.lit(1)).alias("n")), first)
    per = per.groupBy(F.expr(f"(slot - first) div {width}").alias("slot_window"), "pubkey").agg(F.sum("n").alias("n"))
    return per.groupBy("slot_window").agg(F.count(F.lit(1)).alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("multi_keys"), F.sum("n").alias("refs"))


query("A9_key_windows", f"WITH {WINDOWS_SQL} SELECT * FROM win")(lambda spark, d: key_windows(references(spark, d)))


@query("A10_report_scalars", f"WITH {WINDOWS_SQL} SELECT round(avg(distinct_keys), 6) AS mean, min(distinct_keys) AS least, max(distinct_keys) AS most, CAST(sum(32 * multi_keys) AS BIGINT) AS blob_bytes, CAST(sum(33 * refs) AS BIGINT) AS inline_bytes, CAST(sum(32 * multi_keys + 4 * refs) AS BIGINT) AS dict_bytes FROM win")
def a10(spark, d):
    w = key_windows(references(spark, d))
    return w.agg(
        F.round(F.avg("distinct_keys"), 6).alias("mean"),
        F.min("distinct_keys").alias("least"),
        F.max("distinct_keys").alias("most"),
        F.sum(32 * F.col("multi_keys")).alias("blob_bytes"),
        F.sum(33 * F.col("refs")).alias("inline_bytes"),
        F.sum(32 * F.col("multi_keys") + 4 * F.col("refs")).alias("dict_bytes"),
    )


#: The largest rank that each id width reaches, and its bytes; what lies beyond takes 4.
CLASSES = ((127, 1), (255, 2), (65535, 2), (16777215, 3), (4294967295, 4))
POP_SQL = f"{REFS_SQL}, pop AS (SELECT pubkey, count(*) AS n FROM refs GROUP BY pubkey), ranked AS (SELECT pubkey, n, row_number() OVER (ORDER BY n DESC, pubkey) AS rank FROM pop)"


def beside(df: DataFrame, row: DataFrame) -> DataFrame:
    """The columns of a one-row table on every row."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def popularity(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pubkey, n) and, for each count n, how many keys have it (k), how many have more (above), and the references of those (over)."""
    pop = refs.groupBy("pubkey").agg(F.count(F.lit(1)).alias("n"))
    per = pop.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    more = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)  # a row a distinct count: about the root of all references at most
    sums = {"above": F.coalesce(F.sum("k").over(more), F.lit(0)), "over": F.coalesce(F.sum(F.col("n") * F.col("k")).over(more), F.lit(0))}
    return pop, per.withColumns(sums)


#: Keys are windowed in runs of this many numbers inside one count.
KEY_RUN = 4096


def ranked_keys(refs: DataFrame) -> DataFrame:
    """Keys by popularity, ties by key: rank and the references of all keys up to it.

    Most keys have the same few counts, so keys of one count are ranked in runs of key numbers, and one row a run is summed up before them.
    """
    pop, per = popularity(refs)
    pop = pop.withColumn("_run", F.expr(f"pubkey div {KEY_RUN}"))
    runs = pop.groupBy("n", "_run").agg(F.count(F.lit(1)).alias("_k"))
    earlier = Window.partitionBy("n").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_past", F.coalesce(F.sum("_k").over(earlier), F.lit(0))).drop("_k")
    inner = F.row_number().over(Window.partitionBy("n", "_run").orderBy("pubkey"))
    placed = pop.withColumn("_inner", inner).join(runs, ["n", "_run"]).join(per, "n")
    place = F.col("_past") + F.col("_inner")
    return placed.select("pubkey", "n", (F.col("above") + place).alias("rank"), (F.col("over") + F.col("n") * place).alias("running"))


@query(
    "A11_popularity_curve",
    f"""WITH {POP_SQL}, c AS (SELECT unnest([127, 255, 65535, 16777215, 4294967295]) AS top), t AS (SELECT sum(n) AS total FROM pop)
SELECT top, round(coalesce(sum(n) FILTER (rank <= top), 0) / any_value(total), 6) AS share,
  round(sum(n * (CASE WHEN rank > top THEN 4 WHEN rank <= 127 THEN 1 WHEN rank <= 65535 THEN 2 WHEN rank <= 16777215 THEN 3 ELSE 4 END)) / any_value(total), 6) AS mean_id_bytes
FROM ranked, c, t GROUP BY top""",
)
def a11(spark, d):
    """Share of references that the N most popular keys cover, and mean id bytes with such a dictionary; from counts alone."""
    _, per = popularity(references(spark, d))
    covered = [F.sum(F.col("n") * F.greatest(F.least(F.lit(top).cast("bigint") - F.col("above"), F.col("k")), F.lit(0))).alias(f"c{i}") for i, (top, _) in enumerate(CLASSES)]
    sums = per.agg(F.sum(F.col("n") * F.col("k")).alias("total"), *covered)
    c = [F.lit(0), *[F.col(f"c{i}") for i in range(len(CLASSES))]]
    size = [sum(((c[j + 1] - c[j]) * w for j, (_, w) in enumerate(CLASSES[: i + 1])), F.lit(0)) + (F.col("total") - c[i + 1]) * 4 for i in range(len(CLASSES))]
    sums = sums.withColumns({f"b{i}": b for i, b in enumerate(size)})
    rows = F.array(*[F.struct(F.lit(top).cast("bigint").alias("top"), F.round(F.col(f"c{i}") / F.col("total"), 6).alias("share"), F.round(F.col(f"b{i}") / F.col("total"), 6).alias("mean_id_bytes")) for i, (top, _) in enumerate(CLASSES)])
    return sums.select(F.inline(rows))


@query("W5_rank_share", f"WITH {POP_SQL} SELECT pubkey, n, rank, round(sum(n) OVER (ORDER BY rank) / sum(n) OVER (), 6) AS share FROM ranked")
def w5(spark, d):
    """Rank and cumulative share."""
    refs = references(spark, d)
    r = beside(ranked_keys(refs), refs.agg(F.count(F.lit(1)).alias("total")))
    return r.select("pubkey", "n", "rank", F.round(F.col("running") / F.col("total"), 6).alias("share"))


#: List limits of the record model that the shape report compares with.
SHAPE_LIMITS = {"instructions": 64, "accounts": 256, "data": 10_485_760}


@query("A12_shape_maxima", f"WITH {fx.IX_SQL}, s AS (SELECT slot, tx_idx, count(*) AS instructions, count(DISTINCT key) AS accounts, sum(data_len) AS data FROM ix GROUP BY 1, 2) SELECT 'instructions' AS measure, max(instructions) AS most, round(100.0 * max(instructions) / 64, 6) AS percent FROM s UNION ALL SELECT 'accounts', max(accounts), round(100.0 * max(accounts) / 256, 6) FROM s UNION ALL SELECT 'data', CAST(max(data) AS BIGINT), round(100.0 * max(data) / 10485760, 6) FROM s")
def a12(spark, d):
    tx = fx.instructions(spark, d).groupBy("slot", "tx_idx").agg(F.count(F.lit(1)).alias("instructions"), F.countDistinct("key").alias("accounts"), F.sum("data_len").alias("data"))
    top = tx.agg(*[F.max(m).alias(m) for m in SHAPE_LIMITS])
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("most"), F.round(100.0 * F.col(m) / limit, 6).alias("percent")) for m, limit in SHAPE_LIMITS.items()])
    return top.select(F.inline(rows))


@query(
    "A14_archive_tallies",
    f"""WITH {fx.TX_SQL}, {fx.SLOTS_SQL}, {fx.UPD_SQL} SELECT count(DISTINCT slot // {fx.EPOCH}) AS epochs, count(*) FILTER (kind = 'block') AS blocks, count(*) FILTER (kind <> 'block') AS skipped,
  (SELECT count(*) FROM tx) AS txs, (SELECT count(*) FROM upd) AS updates, (SELECT CAST(sum(data_len) AS BIGINT) FROM upd) AS update_bytes,
  (SELECT count(*) FROM upd ANTI JOIN (SELECT slot FROM slots WHERE kind = 'block') b USING (slot)) AS orphan_updates FROM slots""",
)
def a14(spark, d):
    """Totals of an archive, one aggregate a table; the rows meet in one row each."""
    s, u = fx.slots(spark, d), fx.updates(spark, d)
    total = s.agg(F.countDistinct(F.expr(f"slot div {fx.EPOCH}")).alias("epochs"), F.count_if(F.col("kind") == "block").alias("blocks"), F.count_if(F.col("kind") != "block").alias("skipped"))
    parts = [fx.transactions(spark, d).agg(F.count(F.lit(1)).alias("txs")), u.agg(F.count(F.lit(1)).alias("updates"), F.sum("data_len").alias("update_bytes")), u.join(s.filter("kind = 'block'").select("slot"), "slot", "left_anti").agg(F.count(F.lit(1)).alias("orphan_updates"))]
    for p in parts:
        total = total.withColumn("_one", F.lit(1)).join(p.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return total


@query("A15_writer_stats", f"WITH {fx.TX_SQL} SELECT slot // {fx.EPOCH} AS epoch, count(DISTINCT slot // 128) AS buckets, count(DISTINCT slot) AS blocks, count(*) AS txs, CAST(sum(bytes) AS BIGINT) AS bytes FROM tx GROUP BY 1")
def a15(spark, d):
    return fx.transactions(spark, d).groupBy(F.expr(f"slot div {fx.EPOCH}").alias("epoch")).agg(F.countDistinct(F.expr("slot div 128")).alias("buckets"), F.countDistinct("slot").alias("blocks"), F.count(F.lit(1)).alias("txs"), F.sum("bytes").alias("bytes"))


@query("A16_payload_split", f"WITH {fx.TX_SQL}, {fx.UPD_SQL}, t AS (SELECT (SELECT CAST(sum(bytes) AS BIGINT) FROM tx) AS tx_bytes, (SELECT CAST(sum(data_len) AS BIGINT) FROM upd) AS account_bytes) SELECT *, round(100.0 * tx_bytes / (tx_bytes + account_bytes), 6) AS tx_percent, round(CAST(account_bytes AS DOUBLE) / tx_bytes, 6) AS ratio FROM t")
def a16(spark, d):
    one = F.lit(1).alias("_one")
    t = fx.transactions(spark, d).agg(F.sum("bytes").alias("tx_bytes"), one).join(fx.updates(spark, d).agg(F.sum("data_len").alias("account_bytes"), one), "_one").drop("_one")
    return t.withColumns({"tx_percent": F.round(100.0 * F.col("tx_bytes") / (F.col("tx_bytes") + F.col("account_bytes")), 6), "ratio": F.round(F.col("account_bytes") / F.col("tx_bytes"), 6)})


@query("A17_bench_counters", f"WITH {fx.TX_SQL} SELECT count(DISTINCT slot) AS slots, count(*) AS txs, CAST(sum(n_ix) AS BIGINT) AS instructions, CAST(sum(bytes) AS BIGINT) AS bytes FROM tx")
def a17(spark, d):
    return fx.transactions(spark, d).agg(F.countDistinct("slot").alias("slots"), F.count(F.lit(1)).alias("txs"), F.sum("n_ix").alias("instructions"), F.sum("bytes").alias("bytes"))


@query("A18_merged_partials", f"WITH {fx.TX_SQL} SELECT is_vote, count(*) AS txs, CAST(sum(fee) AS BIGINT) AS fees, min(cu) AS min_cu, max(cu) AS max_cu FROM tx GROUP BY is_vote")
def a18(spark, d):
    """Partial states by range of slots, merged: sums add, extremes compare."""
    tx = fx.transactions(spark, d)
    partial = tx.groupBy(F.expr("slot div 1000").alias("part"), "is_vote").agg(F.count(F.lit(1)).alias("txs"), F.sum("fee").alias("fees"), F.min("cu").alias("min_cu"), F.max("cu").alias("max_cu"))
    return partial.groupBy("is_vote").agg(F.sum("txs").alias("txs"), F.sum("fees").alias("fees"), F.min("min_cu").alias("min_cu"), F.max("max_cu").alias("max_cu"))


#: Bytes of payload in a shred, shreds in a batch, bytes of a packet, packets a shred.
SHRED, BATCH, PACKET, COPIES = 963, 32, 1228, 2


@query("A19_shred_totals", f"WITH {fx.TX_SQL}, s AS (SELECT slot, CAST(sum(bytes) AS BIGINT) AS b FROM tx GROUP BY slot), x AS (SELECT b, greatest((b + 962) // 963, 1) AS n FROM s), y AS (SELECT b, (n + 31) // 32 * 32 AS n FROM x) SELECT CAST(sum(b) AS BIGINT) AS payload, CAST(sum(n) AS BIGINT) AS shreds, CAST(sum(n * 2 * 1228) AS BIGINT) AS wire_bytes, round(100.0 * sum(b) / sum(n * 2 * 1228), 6) AS percent FROM y")
def a19(spark, d):
    s = fx.transactions(spark, d).groupBy("slot").agg(F.sum("bytes").alias("b"))
    n = F.expr(f"(greatest((b + {SHRED - 1}) div {SHRED}, 1) + {BATCH - 1}) div {BATCH} * {BATCH}")
    t = s.withColumn("n", n).agg(F.sum("b").alias("payload"), F.sum("n").alias("shreds"))
    return t.withColumn("wire_bytes", F.col("shreds") * COPIES * PACKET).withColumn("percent", F.round(100.0 * F.col("payload") / F.col("wire_bytes"), 6))


@query("A20_p90_rates", f"WITH {fx.TX_SQL}, r AS (SELECT slot // 1000 AS sweep, slot % 16 AS worker, count(*) AS rate FROM tx GROUP BY 1, 2) SELECT sweep, list_sort(list(rate))[(count(*) - 1) * 9 // 10 + 1] AS p90 FROM r WHERE rate > 0 GROUP BY sweep")
def a20(spark, d):
    """Nearest-rank 90th percentile of the workers' rates of each sweep; a sweep has as many rates as workers."""
    r = fx.transactions(spark, d).groupBy(F.expr("slot div 1000").alias("sweep"), (F.col("slot") % 16).alias("worker")).agg(F.count(F.lit(1)).alias("rate"))
    return r.filter("rate > 0").groupBy("sweep").agg(F.sort_array(F.collect_list("rate")).alias("r")).select("sweep", F.expr("element_at(r, cast((size(r) - 1) * 9 div 10 + 1 as int))").alias("p90"))


# -- sorts, limits, sets


@query("O2_repeated_versions", f"WITH {fx.UPD_SQL}, u AS (SELECT slot, write_version % 7 AS write_version FROM upd) SELECT slot, write_version, count(*) AS times FROM u GROUP BY 1, 2 HAVING count(*) > 1")
def o2(spark, d):
    """Write versions that a slot has twice: an error to its writer."""
    u = fx.updates(spark, d).select("slot", (F.col("write_version") % 7).alias("write_version"))
    return u.groupBy("slot", "write_version").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


@query("O3_worst_offenders", f"WITH {fx.TX_SQL} SELECT slot, count(*) FILTER (errored) AS errors FROM tx GROUP BY slot ORDER BY errors DESC, slot LIMIT 16")
def o3(spark, d):
    return fx.transactions(spark, d).groupBy("slot").agg(F.count_if("errored").alias("errors")).orderBy(F.desc("errors"), "slot").limit(16)


@query("O4_merged_order", f"WITH {fx.BLOCKS_SQL} SELECT slot, block_time FROM blocks ORDER BY slot")
def o4(spark, d):
    return fx.blocks(spark, d).select("slot", "block_time").orderBy("slot")


@query("O5_clustered_rows", f"WITH {fx.TX_SQL} SELECT slot // {fx.EPOCH} AS epoch, slot, tx_idx, fee FROM tx")
def o5(spark, d):
    """The storage order: by range of slots, sorted inside a partition, no total sort."""
    tx = fx.transactions(spark, d).select(F.expr(f"slot div {fx.EPOCH}").alias("epoch"), "slot", "tx_idx", "fee")
    return tx.repartitionByRange("slot").sortWithinPartitions("slot", "tx_idx")


@query("O6_reverse_epochs", f"WITH {fx.BLOCKS_SQL} SELECT slot // {fx.EPOCH} AS epoch, slot FROM blocks ORDER BY 1 DESC, 2")
def o6(spark, d):
    return fx.blocks(spark, d).select(F.expr(f"slot div {fx.EPOCH}").alias("epoch"), "slot").orderBy(F.desc("epoch"), "slot")


@query("O7_victim_ranking", f"WITH {fx.SLOTS_SQL}, p AS (SELECT slot % 16 AS worker, count(*) FILTER (kind = 'block') / count(*) AS done, count(*) FILTER (kind <> 'block') AS remaining FROM slots GROUP BY 1) SELECT worker, round(done, 6) AS done, remaining FROM p ORDER BY p.done, remaining DESC, worker LIMIT 5")
def o7(spark, d):
    p = fx.slots(spark, d).groupBy((F.col("slot") % 16).alias("worker")).agg((F.count_if(F.col("kind") == "block") / F.count(F.lit(1))).alias("f"), F.count_if(F.col("kind") != "block").alias("remaining"))
    return p.orderBy("f", F.desc("remaining"), "worker").limit(5).select("worker", F.round("f", 6).alias("done"), "remaining")


@query("U1_account_union", "SELECT DISTINCT CAST(k AS VARCHAR) AS account FROM (SELECT user_id AS k FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE value > 50) ORDER BY 1")
def u1(spark, d):
    e = fx.table(spark, d, "events")
    lists = e.filter("event_type = 'click'").select("user_id").unionByName(e.filter("value > 50").select("user_id"))
    return lists.select(F.col("user_id").cast("string").alias("account")).distinct().orderBy("account")


@query(
    "U2_coverage_holes",
    f"""WITH {fx.BLOCKS_SQL}, top AS (SELECT max(slot) // 100 * 100 + 100 AS hi FROM blocks),
parts AS (SELECT start FROM (SELECT unnest(range(0, (SELECT hi FROM top), 100)) AS start) WHERE (start // 100) % 7 <> 3),
spans AS (SELECT start, start + 100 AS stop FROM parts UNION ALL SELECT start + 20, start + 60 FROM parts UNION ALL SELECT hi, hi FROM top),
reached AS (SELECT start, max(stop) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT start, max(stop) AS stop FROM spans GROUP BY start)),
holes AS (SELECT coalesce(reach, 0) AS start, start AS stop FROM reached WHERE start > coalesce(reach, 0))
SELECT h.start, h.stop, count(*) AS blocks FROM holes h JOIN blocks b ON b.slot >= h.start AND b.slot < h.stop GROUP BY 1, 2""",
)
def u2(spark, d):
    """Holes that finished intervals leave in the range, as far as they hold a block.

    Intervals of 100 slots, one in seven not finished, others finished twice and overlapping."""
    b = fx.blocks(spark, d).select("slot")
    top = b.agg(F.expr("max(slot) div 100 * 100 + 100").alias("hi"))
    runs = top.withColumn("run", F.explode(F.expr("sequence(0L, (hi - 100) div 409600)"))).repartition("run")
    parts = runs.select(F.explode(F.expr("sequence(run * 409600, least(hi - 100, run * 409600 + 409500), 100L)")).alias("start")).filter("(start div 100) % 7 <> 3")
    spans = parts.select("start", (F.col("start") + 100).alias("stop")).unionByName(parts.select((F.col("start") + 20).alias("start"), (F.col("start") + 60).alias("stop")))
    spans = spans.unionByName(top.select(F.col("hi").alias("start"), F.col("hi").alias("stop")))
    holes = coverage_holes(spans)
    present = b.select("slot", F.expr("slot div 100").alias("c"))
    cells = holes.withColumn("c", F.explode(F.sequence(F.expr("start div 100"), F.expr("(stop - 1) div 100"))))
    return cells.join(present, "c").filter("slot >= start and slot < stop").groupBy("start", "stop").agg(F.count(F.lit(1)).alias("blocks"))


def coverage_holes(spans: DataFrame, first: int = 0) -> DataFrame:
    """(start, stop) of what half-open spans leave uncovered from ``first`` to the last one's start."""
    s = spans.groupBy("start").agg(F.max("stop").alias("stop"))
    s = with_running(s, "start", "stop", "reach", F.max)
    s = with_previous(s, "start", ["reach"])
    s = s.withColumn("from", F.coalesce("prev_reach", F.lit(first)))
    return s.filter("start > from").select(F.col("from").alias("start"), F.col("start").alias("stop"))


@query("U3_backfill_union", f"WITH {fx.BLOCKS_SQL}, rows AS (SELECT slot, CASE WHEN slot % 5 = 0 THEN 0 ELSE block_time END AS timestamp FROM blocks), fill AS (SELECT slot, block_time AS timestamp FROM blocks WHERE slot % 5 = 0) SELECT slot, max(timestamp) AS timestamp FROM (SELECT * FROM rows UNION ALL SELECT * FROM fill) GROUP BY slot")
def u3(spark, d):
    """Back-filled rows are appended; the newest of a key is read."""
    b = fx.blocks(spark, d).select("slot", "block_time")
    rows = b.select("slot", F.when(F.col("slot") % 5 == 0, 0).otherwise(F.col("block_time")).alias("timestamp"))
    fill = b.filter("slot % 5 = 0").select("slot", F.col("block_time").alias("timestamp"))
    return merge_latest(rows.unionByName(fill), ["slot"], ["timestamp"])


@query("U4_update_arenas", f"WITH {fx.UPD_SQL} SELECT CASE write_version % 4 WHEN 0 THEN 'epoch' WHEN 1 THEN 'tx' WHEN 2 THEN 'pre' ELSE 'post' END AS arena, count(*) AS updates FROM upd GROUP BY 1")
def u4(spark, d):
    u = fx.updates(spark, d)
    arenas = [u.filter(f"write_version % 4 = {i}").select(F.lit(n).alias("arena"), "write_version") for i, n in enumerate(("epoch", "tx", "pre", "post"))]
    whole = arenas[0]
    for a in arenas[1:]:
        whole = whole.unionByName(a)
    return whole.groupBy("arena").agg(F.count(F.lit(1)).alias("updates"))


@query("U5_missing_slots", f"WITH {fx.BLOCKS_SQL} SELECT slot FROM {calendar_sql('slots')} ANTI JOIN blocks USING (slot)")
def u5(spark, d):
    """Slots of the ledger's range that hold no block, whether skipped or never seen."""
    return calendar(fx.slot_ids(spark, d)).join(fx.blocks(spark, d).select("slot"), "slot", "left_anti")

