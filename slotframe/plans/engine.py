"""Runs analyses over ledger streams, one at a time, keeping an error of one away from the others."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import plugin_id
from ..functions.units import EPOCH_SLOTS, parse_range
from ..operators import analyses
from ..operators.txmeta import tx_meta
from ..sources.formats import read_archive, read_upserted, upsert, write_archive
from . import fixtures as fx

log = logging.getLogger("slotframe")


@dataclass(frozen=True)
class Analysis:
    """A transform from streams to rows that replace older ones of their key."""

    name: str
    key: tuple[str, ...]
    version: tuple[str, ...]
    transform: Callable[[dict[str, DataFrame]], DataFrame]
    streams: tuple[str, ...] = ("instructions", "transactions", "blocks")
    revision: int = 1

    @property
    def id(self) -> int:
        return plugin_id(self.name)


def _mentions(s: dict[str, DataFrame]) -> DataFrame:
    counts = s["instructions"].groupBy("slot", F.col("key").alias("pubkey")).agg(F.count(F.lit(1)).alias("num_mentions"))
    return counts.join(s["blocks"].select("slot", analyses.clamp_time("block_time").alias("timestamp")), "slot")


def _slot_instructions(s: dict[str, DataFrame]) -> DataFrame:
    vote = F.col("vote_ix") > 0
    sums = s["transactions"].groupBy("slot").agg(F.sum("vote_ix").alias("vote_instruction_count"), F.sum(F.col("n_ix") - F.col("vote_ix")).alias("non_vote_instruction_count"), F.count_if(vote).alias("vote_transaction_count"), F.count_if(~vote).alias("non_vote_transaction_count"))
    return sums.join(s["blocks"].select("slot", analyses.clamp_time("block_time").alias("timestamp")), "slot")


def _metadata(s: dict[str, DataFrame]) -> DataFrame:
    return tx_meta(s["messages"]).join(s["blocks"].select("slot", analyses.clamp_time("block_time").alias("timestamp")), "slot")


def _writes(s: dict[str, DataFrame]) -> DataFrame:
    return analyses.write_stats(s["updates"], s["blocks"])


REGISTRY = {
    a.name: a
    for a in (
        Analysis("program-tracking", ("slot", "program_id", "is_vote"), ("timestamp",), lambda s: analyses.program_invocations(s["instructions"], s["transactions"], s["blocks"])),
        Analysis("instruction-tracking", ("slot",), ("timestamp",), _slot_instructions),
        Analysis("pubkey-stats", ("slot", "pubkey"), ("timestamp",), _mentions),
        Analysis("tx-metadata", ("slot", "tx_idx"), ("timestamp",), _metadata, ("messages", "blocks")),
        Analysis("account-writes", ("slot",), ("timestamp",), _writes, ("updates", "blocks")),
    )
}


@dataclass
class Engine:
    """``Engine(spark).with_analysis(...).with_slot_range(lo, hi).with_sink(path).run(streams)``."""

    spark: SparkSession
    analyses: list[Analysis] = field(default_factory=list)
    slots: tuple[int, int] | None = None
    sink: str | None = None
    resume: bool = False
    descending: bool = False
    failures: dict[str, str] = field(default_factory=dict)

    def with_analysis(self, analysis: Analysis | str) -> Engine:
        self.analyses.append(REGISTRY[analysis] if isinstance(analysis, str) else analysis)
        return self

    def with_slot_range(self, lo: int, hi: int) -> Engine:
        if hi <= lo:
            raise ValueError(f"empty slot range {lo}:{hi}")
        self.slots = (lo, hi)
        return self

    def with_range(self, text: str) -> Engine:
        return self.with_slot_range(*parse_range(text))

    def with_sink(self, path: str | None) -> Engine:
        self.sink = path
        return self

    def resumed(self) -> Engine:
        """Skip slots that the sink's progress names, analysis by analysis."""
        self.resume = True
        return self

    def reversed(self) -> Engine:
        """Rows of an analysis come newest slot first."""
        self.descending = True
        return self

    def run_by_epoch(self, streams: dict[str, DataFrame], epoch: int = EPOCH_SLOTS) -> dict[str, DataFrame]:
        """One epoch of the range after the other, the newest first if reversed; needs a range and a sink."""
        if not self.slots or not self.sink:
            raise ValueError("a run epoch by epoch needs a slot range and a sink")
        (lo, hi), out = self.slots, {}
        try:
            for e in sorted(range(lo // epoch, (hi - 1) // epoch + 1), reverse=self.descending):
                out = self.with_slot_range(max(lo, e * epoch), min(hi, (e + 1) * epoch)).run(streams)
        finally:
            self.slots = (lo, hi)
        return out

    def _unprocessed(self, a: Analysis, streams: dict[str, DataFrame]) -> dict[str, DataFrame]:
        try:
            done = read_upserted(self.spark, f"{self.sink}/progress").filter((F.col("plugin_id") == a.id) & (F.col("revision") >= a.revision)).select("slot")
        except FileNotFoundError:
            return streams
        return {k: df.join(done, "slot", "left_anti") for k, df in streams.items()}

    def run(self, streams: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Rows of each analysis; with a sink they are merged into ``sink/<name>``, its slots into ``sink/progress``, and read back from there."""
        if self.slots:
            lo, hi = self.slots
            streams = {k: df.filter((F.col("slot") >= lo) & (F.col("slot") < hi)) for k, df in streams.items()}
        out = {}
        for a in self.analyses:
            try:
                mine = {k: streams[k] for k in a.streams}
                if self.sink and self.resume:
                    mine = self._unprocessed(a, mine)
                rows = a.transform(mine)
                if self.sink:
                    upsert(rows, f"{self.sink}/{a.name}", list(a.key), list(a.version))
                    done = mine["blocks"].select(F.lit(a.id).alias("plugin_id"), "slot", F.lit(a.revision).alias("revision"))
                    upsert(done, f"{self.sink}/progress", ["plugin_id", "slot"], ["revision"])
                    rows = read_upserted(self.spark, f"{self.sink}/{a.name}")
                out[a.name] = rows.orderBy(F.desc("slot")) if self.descending else rows
            except Exception as e:
                log.exception("analysis %s failed", a.name)
                self.failures[a.name] = str(e)
        return out


def fixture_streams(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from ..operators.scalars import fixture_messages

    tables = {"instructions": fx.instructions(spark, sf_dir), "transactions": fx.transactions(spark, sf_dir), "blocks": fx.blocks(spark, sf_dir)}
    return tables | {"updates": fx.updates(spark, sf_dir), "messages": fixture_messages(spark, sf_dir)}


def file_streams(spark: SparkSession, epoch: int = EPOCH_SLOTS, **options) -> dict[str, DataFrame]:
    """Streams of archive files; options as ``sources.nodes`` takes them.

    Messages and blocks come as they are stored; transactions and instructions are derived from the messages.
    """
    from ..operators.txmeta import Programs
    from ..sources import nodes

    vote = F.lit(Programs().vote)
    messages = nodes.decoded_transactions(nodes.read_transactions(spark, **options), epoch)
    text = lambda c: F.transform(c, lambda k: F.hex(k))
    messages = messages.withColumns({c: text(c) for c in ("static_keys", "loaded_writable", "loaded_readonly")})
    none = F.lit(None).cast("struct<priority_fee:bigint,compute_unit_limit:bigint,loaded_limit:bigint,heap_size:bigint>")
    messages = messages.withColumn("config", none)
    every = F.concat("static_keys", "loaded_writable", "loaded_readonly")
    ix = messages.select("slot", "tx_idx", every.alias("_k"), F.explode("instructions").alias("i")).select("slot", "tx_idx", F.get("_k", F.col("i.program_index")).alias("program_id"), F.explode_outer("i.accounts").alias("_a"), "_k")
    ix = ix.select("slot", "tx_idx", "program_id", F.get("_k", F.col("_a")).alias("key"))
    programs = F.transform("instructions", lambda i: F.get(every, i["program_index"]))
    votes = F.size(F.filter(programs, lambda p: p == vote))
    tx = messages.select("slot", "tx_idx", F.size("instructions").alias("n_ix"), votes.alias("vote_ix"), (~F.col("is_success")).alias("errored"), (votes > 0).alias("is_vote"), F.coalesce("consumed", F.lit(0)).alias("cu"), "fee")
    return {"messages": messages, "transactions": tx, "instructions": ix, "blocks": nodes.read_blocks(spark, **options)}


def wanted(analyses_: list[Analysis], streams: dict[str, DataFrame | None]) -> dict[str, DataFrame]:
    """The streams that some analysis asks for; the others aren't planned."""
    names = {name for a in analyses_ for name in a.streams}
    return {k: df for k, df in streams.items() if k in names}


#: The order of each stream's rows inside archive files.
STREAM_ORDER = {"instructions": ("slot", "tx_idx"), "transactions": ("slot", "tx_idx"), "blocks": ("slot",), "updates": ("slot", "write_version")}


def write_streams(streams: dict[str, DataFrame], path: str, epoch: int) -> None:
    """Each stream as an archive of its own under ``path``."""
    for name, df in streams.items():
        write_archive(df, f"{path}/{name}", STREAM_ORDER.get(name, ("slot",)), epoch)


def archive_streams(spark: SparkSession, path: str, lo: int | None = None, hi: int | None = None, epoch: int = EPOCH_SLOTS, names=("instructions", "transactions", "blocks")) -> dict[str, DataFrame]:
    """Streams of an archive, limited to slots lo to hi - 1; folders and row groups outside aren't read."""
    return {name: read_archive(spark, f"{path}/{name}", lo, hi, epoch) for name in names}
