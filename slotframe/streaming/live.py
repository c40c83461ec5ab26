"""Live tail (T1 to T15): the batch transforms inside Structured Streaming.

A slot is final when its block row comes, not when time passes: ``finalise`` keeps sums per slot
in keyed state and emits a slot with its block.  Sinks are idempotent upserts by key, so a batch
that is written twice after a restart changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans import fixtures as fx
from ..plans.register import query
from ..session import scratch

EVENT = "slot bigint, kind string, n bigint, block_time bigint"
FINAL = "slot bigint, txs bigint, timestamp bigint"


#: Keyed state lies on the executors' disks: a run over a whole archive holds a row of state a slot.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def finalise(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(slot, txs, timestamp) as soon as a slot's block is in; a transaction after it emits the slot anew.

    Without ``keep_ms`` that is a streaming aggregate, whose state stays.  With ``keep_ms`` the state of a slot goes that
    long after its last event once its block is in, which a stream that runs on needs; slots without a block stay.  It costs a
    Python call a slot and batch, and a run over what is there (``availableNow``) ends only without it, for timeouts ask for
    batches for ever.
    """
    if keep_ms is None:
        sums = events.groupBy("slot").agg(
            F.coalesce(F.sum(F.when(F.col("kind") == "tx", F.col("n"))), F.lit(0)).alias("txs"),
            # of several block rows the one that came last; the state is merged before a batch's rows
            F.last(F.when(F.col("kind") == "block", F.coalesce("block_time", F.lit(0))), ignorenulls=True).alias("time"),
        )
        return sums.filter("time is not null").select("slot", "txs", F.least(F.greatest("time", F.lit(0)), F.lit((1 << 32) - 1)).cast("bigint").alias("timestamp"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        txs, time, seen = state.get if state.exists else (0, 0, False)
        for pdf in frames:
            txs += int(pdf.loc[pdf["kind"] == "tx", "n"].sum())
            block = pdf[pdf["kind"] == "block"]
            if len(block):
                seen, time = True, int(block["block_time"].fillna(0).iloc[-1])
        state.update((txs, time, seen))
        if seen:
            state.setTimeoutDuration(keep_ms)
            yield pd.DataFrame({"slot": [key[0]], "txs": [txs], "timestamp": [min(max(time, 0), (1 << 32) - 1)]})

    return events.groupBy("slot").applyInPandasWithState(step, FINAL, "txs bigint, time bigint, seen boolean", "update", GroupStateTimeout.ProcessingTimeTimeout)


def drain(events: DataFrame) -> DataFrame:
    """At the end: slots without a block, with timestamp 0, for a later back-fill."""
    sums = events.groupBy("slot").agg(F.sum(F.when(F.col("kind") == "tx", F.col("n"))).alias("txs"), F.bool_or(F.col("kind") == "block").alias("seen"))
    return sums.filter("not seen").select("slot", F.coalesce("txs", F.lit(0)).alias("txs"), F.lit(0).cast("bigint").alias("timestamp"))


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Process what is there, batch by batch, and stop."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, STATE_STORE)  # a query takes it over when it starts; one that goes on keeps what it began with
    try:
        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)


def keep_distinct(stream: DataFrame, view: str, checkpoint: str) -> None:
    """Adds what a batch holds and earlier ones don't as ``view/batch=N``; a batch that runs twice writes the same."""
    spark = stream.sparkSession

    def add(df: DataFrame, batch: int) -> None:
        fresh = df.distinct()
        if batch:
            fresh = fresh.join(spark.read.parquet(view).filter(F.col("batch") < batch).drop("batch"), df.columns, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{view}/batch={batch}")

    run_available(stream, add, checkpoint, "append")


def deduplicated(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Repeated slots within the watermark are dropped (T4)."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["slot"])


def slot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = fx.transactions(spark, sf_dir).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).select("slot", F.lit("tx").alias("kind"), "n", F.lit(None).cast("bigint").alias("block_time"))
    b = fx.blocks(spark, sf_dir).select("slot", F.lit("block").alias("kind"), F.lit(0).cast("bigint").alias("n"), "block_time")
    return tx.unionByName(b)


@query(
    "T1_slot_finalisation",
    f"WITH {fx.TX_SQL}, {fx.BLOCKS_SQL} SELECT slot, count(tx_idx) AS txs, least(greatest(any_value(block_time), 0), 4294967295) AS timestamp FROM blocks LEFT JOIN tx USING (slot) GROUP BY slot",
)
def t1(spark, d):
    """The stream run to its end over files, merged to one row a slot."""
    from ..operators.state import merge_latest

    base = scratch(spark, "live")
    slot_events(spark, d).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(EVENT).parquet(f"{base}/in")
    run_available(finalise(stream), lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{base}/out"), f"{base}/state")
    return merge_latest(spark.read.parquet(f"{base}/out"), ["slot"], ["batch", "txs"]).select("slot", "txs", "timestamp")


@query("T2_exit_drain", f"WITH {fx.TX_SQL} SELECT slot, count(*) AS txs, 0 AS timestamp FROM tx WHERE slot % 40 = 0 GROUP BY slot")
def t2(spark, d):
    return drain(slot_events(spark, d).filter("not (kind = 'block' and slot % 40 = 0)"))


@query("T14_stats_pulses", f"WITH {fx.TX_SQL}, p AS (SELECT slot, count(*) AS n FROM tx GROUP BY slot), t AS (SELECT slot, CAST(sum(n) OVER (ORDER BY slot) AS BIGINT) AS total FROM p) SELECT slot, total FROM t WHERE slot % 100 = 0")
def t14(spark, d):
    from ..operators.ordered import with_running

    per = fx.transactions(spark, d).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    return with_running(per, "slot", "n", "total").filter("slot % 100 = 0").select("slot", "total")
