"""State archives (S14): a checkpoint, the updates after it and the accounts that both cover; deltas of accounts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.state import merge_latest

#: Updates of an account are windowed in runs of this many versions.
RUN = 1 << 16


def write_state_archive(checkpoint: DataFrame, updates: DataFrame, accounts: DataFrame, path: str, slot: int) -> None:
    """``checkpoint`` holds the state at ``slot``, ``updates`` what came later; ``accounts`` lists all that may occur."""
    accounts.select("pubkey").distinct().write.parquet(f"{path}/accounts")
    checkpoint.withColumn("checkpoint_slot", F.lit(slot).cast("bigint")).write.option("compression", "zstd").parquet(f"{path}/checkpoint")
    updates.repartitionByRange("slot").sortWithinPartitions("slot", "write_version").write.option("compression", "zstd").parquet(f"{path}/updates")


@dataclass
class StateArchive:
    """Two tables and the account list; made by :func:`read_state_archive`, which checks them."""

    accounts: DataFrame
    checkpoint: DataFrame
    updates: DataFrame
    slot: int

    def slots(self, lo: int, hi: int) -> DataFrame:
        """Updates of slots lo to hi - 1; row groups are pruned by slot."""
        return self.updates.filter((F.col("slot") >= lo) & (F.col("slot") < hi))

    def state(self, slot: int | None = None) -> DataFrame:
        """The newest version of each account, at the end or after ``slot``."""
        later = self.updates if slot is None else self.updates.filter(F.col("slot") <= slot)
        return merge_latest(self.checkpoint.unionByName(later), ["pubkey"], ["slot", "write_version"])


def read_state_archive(spark: SparkSession, path: str) -> StateArchive:
    """An archive whose parts fit together: an error if an account isn't listed, a version comes twice, or an update is no later than the checkpoint."""
    accounts, stored, updates = (spark.read.parquet(f"{path}/{x}") for x in ("accounts", "checkpoint", "updates"))
    slots = stored.agg(F.min("checkpoint_slot").alias("a"), F.max("checkpoint_slot").alias("b")).first()
    if slots["a"] != slots["b"]:
        raise ValueError(f"checkpoints of several slots: {slots['a']}, {slots['b']}")
    checkpoint, slot = stored.drop("checkpoint_slot"), slots["a"] if slots["a"] is not None else -1
    both = checkpoint.select("pubkey", "slot", "write_version").unionByName(updates.select("pubkey", "slot", "write_version"))
    if not both.join(accounts, "pubkey", "left_anti").isEmpty():
        raise ValueError("an account is not on the archive's list")
    if not both.groupBy("pubkey", "slot", "write_version").count().filter("count > 1").isEmpty():
        raise ValueError("a version of an account comes twice")
    if not updates.filter(F.col("slot") <= slot).isEmpty():
        raise ValueError(f"an update at or before the checkpoint of slot {slot}")
    return StateArchive(accounts, checkpoint, updates, slot)


def account_deltas(rows: DataFrame, value: str) -> DataFrame:
    """(pubkey, write_version, delta): the difference from the account's version before, from 0 for the first."""
    rows = rows.withColumn("_run", F.expr(f"write_version div {RUN}"))
    ends = rows.groupBy("pubkey", "_run").agg(F.max_by(value, "write_version").alias("_end"))
    ends = ends.withColumn("_carried", F.lag("_end").over(Window.partitionBy("pubkey").orderBy("_run"))).drop("_end")
    inner = F.lag(value).over(Window.partitionBy("pubkey", "_run").orderBy("write_version"))
    both = rows.withColumn("_inner", inner).join(ends, ["pubkey", "_run"])
    return both.select("pubkey", "write_version", (F.col(value) - F.coalesce("_inner", "_carried", F.lit(0))).alias("delta"))


def from_deltas(deltas: DataFrame) -> DataFrame:
    """Adds ``decoded``: the running sum of an account's deltas."""
    rows = deltas.withColumn("_run", F.expr(f"write_version div {RUN}"))
    ends = rows.groupBy("pubkey", "_run").agg(F.sum("delta").alias("_sum"))
    past = F.sum("_sum").over(Window.partitionBy("pubkey").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("_past", F.coalesce(past, F.lit(0))).drop("_sum")
    inner = F.sum("delta").over(Window.partitionBy("pubkey", "_run").orderBy("write_version").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_inner", inner).join(ends, ["pubkey", "_run"]).withColumn("decoded", F.col("_past") + F.col("_inner")).drop("_run", "_inner", "_past")
