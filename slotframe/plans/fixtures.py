"""Ledger views over star-schema tables, for queries that need data at hand.

An order is a slot: with line items it is a block, without it was skipped.  The line items
of one (order, line number) are the instructions of a transaction: supplier = program,
part = account key.  Events are account updates: user = key, event id = write version.
The ``*_SQL`` strings are the same views as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The program id that counts as the vote program.
VOTE = 1
#: Slots of an epoch in these small views.
EPOCH = 4000

EPOCH_SECONDS = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {})"


def seconds(column: str):
    """Seconds since 1970 of a timestamp without time zone."""
    return F.expr(EPOCH_SECONDS.format(column))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instructions(spark, sf_dir) -> DataFrame:
    """slot, tx_idx, program_id, key, data_len and flags, one row an instruction."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("slot"),
        F.col("l_linenumber").cast("bigint").alias("tx_idx"),
        F.col("l_suppkey").alias("program_id"),
        F.col("l_partkey").alias("key"),
        (F.col("l_returnflag") == "R").alias("err"),
        (F.col("l_linestatus") == "F").alias("vote"),
        F.floor("l_extendedprice").cast("bigint").alias("price"),
        F.floor(F.col("l_extendedprice") * F.col("l_tax")).cast("bigint").alias("tax"),
        F.floor("l_quantity").cast("bigint").alias("data_len"),
    )


IX_SQL = """ix AS (SELECT l_orderkey AS slot, CAST(l_linenumber AS BIGINT) AS tx_idx, l_suppkey AS program_id, l_partkey AS key,
  l_returnflag = 'R' AS err, l_linestatus = 'F' AS vote, CAST(floor(l_extendedprice) AS BIGINT) AS price,
  CAST(floor(l_extendedprice * l_tax) AS BIGINT) AS tax, CAST(floor(l_quantity) AS BIGINT) AS data_len FROM lineitem)"""


def transactions(spark, sf_dir) -> DataFrame:
    """slot, tx_idx, n_ix, vote_ix, errored, is_vote, cu, fee, bytes, one row a transaction."""
    return instructions(spark, sf_dir).groupBy("slot", "tx_idx").agg(
        F.count(F.lit(1)).alias("n_ix"),
        F.count_if(F.col("program_id") == VOTE).alias("vote_ix"),
        F.bool_or("err").alias("errored"),
        F.bool_and("vote").alias("is_vote"),
        F.max("price").alias("cu"),
        F.sum("tax").alias("fee"),
        F.sum("data_len").alias("bytes"),
    )


TX_SQL = f"""{IX_SQL}, tx AS (SELECT slot, tx_idx, count(*) AS n_ix, count(*) FILTER (program_id = {VOTE}) AS vote_ix, bool_or(err) AS errored,
  bool_and(vote) AS is_vote, max(price) AS cu, CAST(sum(tax) AS BIGINT) AS fee, CAST(sum(data_len) AS BIGINT) AS bytes FROM ix GROUP BY slot, tx_idx)"""


def slots(spark, sf_dir) -> DataFrame:
    """Every order as slot, kind (block or skipped), block_time, leader, status, priority."""
    present = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slot")).distinct().withColumn("there", F.lit(True))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slot"), seconds("o_orderdate").alias("block_time"), F.col("o_custkey").alias("leader"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return o.join(present, "slot", "left").withColumn("kind", F.when(F.col("there"), "block").otherwise("skipped")).drop("there")


SLOTS_SQL = """slots AS (SELECT o_orderkey AS slot, CAST(epoch(o_orderdate) AS BIGINT) AS block_time, o_custkey AS leader, o_orderstatus AS status,
  o_orderpriority AS priority, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'block' ELSE 'skipped' END AS kind FROM orders)"""


def slot_ids(spark, sf_dir) -> DataFrame:
    """The slots alone, without looking for their instructions."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slot"))


def blocks(spark, sf_dir) -> DataFrame:
    return slots(spark, sf_dir).filter("kind = 'block'").drop("kind")


BLOCKS_SQL = f"{SLOTS_SQL}, blocks AS (SELECT slot, block_time, leader, status, priority FROM slots WHERE kind = 'block')"


def updates(spark, sf_dir) -> DataFrame:
    """pubkey, write_version, slot, lamports, data_len, kind, one row an account update."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("pubkey"),
        F.col("event_id").alias("write_version"),
        (F.floor(seconds("ts") / 3600) % 5000).cast("bigint").alias("slot"),
        F.when(F.col("event_type") == "error", F.lit(0)).otherwise(F.floor(F.col("value") * 100)).cast("bigint").alias("lamports"),
        F.length("props").cast("bigint").alias("data_len"),
        F.col("event_type").alias("kind"),
    )


UPD_SQL = """upd AS (SELECT user_id AS pubkey, event_id AS write_version, CAST(floor(floor(epoch(ts)) / 3600) AS BIGINT) % 5000 AS slot,
  CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value * 100) AS BIGINT) END AS lamports, CAST(length(props) AS BIGINT) AS data_len,
  event_type AS kind FROM events)"""


def siphash_sql(digits: str) -> str:
    """SQL for SipHash-2-4 with a zero key over the 32 bytes that a column of hexadecimal digits holds; a number below 2**64.

    The state is a list of four numbers; steps of the message are folded over it.
    """
    wrap = "18446744073709551616::HUGEINT"
    add = lambda x, y: f"(({x} + {y}) % {wrap})"
    turn = lambda x, n: f"(({x} * {1 << n}) % {wrap} + {x} // {1 << (64 - n)})"
    bind = lambda name, value, body: f"list_transform([{value}], lambda {name}: {body})[1]"
    step = lambda *v: "[" + ", ".join(f"{x}::HUGEINT" for x in v) + "]"
    last = f"[w[1], xor({turn('w[2]', 17)}, w[3]), {turn('w[3]', 32)}, xor({turn('w[4]', 21)}, w[1])]"
    third = bind("w", f"[{add('u[1]', 'u[4]')}, u[2], {add('u[3]', 'u[2]')}, u[4]]", last)
    second = bind("u", f"[{turn('t[1]', 32)}, xor({turn('t[2]', 13)}, t[1]), t[3], xor({turn('t[4]', 16)}, t[3])]", third)
    one_round = bind("t", f"[{add('s[1]', 's[2]')}, s[2], {add('s[3]', 's[4]')}, s[4]]", second)
    words = ["CAST('0x' || " + " || ".join(f"substr({digits}, {16 * i + 2 * k + 1}, 2)" for k in range(7, -1, -1)) + " AS UBIGINT)" for i in range(4)]
    steps = [step(0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)]
    for m in (*words, 32 << 56):
        steps += [step(0, m, 0, 0), step(1, 0, 0, 0), step(1, 0, 0, 0), step(2, m, 0, 0)]
    steps += [step(3, 0, 0, 0), *[step(1, 0, 0, 0)] * 4]
    fold = f"CASE e[1] WHEN 0 THEN [s[1], s[2], s[3], xor(s[4], e[2])] WHEN 1 THEN {one_round} WHEN 2 THEN [xor(s[1], e[2]), s[2], s[3], s[4]] ELSE [s[1], s[2], xor(s[3], 255::HUGEINT), s[4]] END"
    return bind("v", f"list_reduce([{', '.join(steps)}], lambda s, e: {fold})", "xor(xor(v[1], v[2]), xor(v[3], v[4]))")


KEYS_SQL = "keys AS (SELECT DISTINCT l_partkey AS key, sha256(CAST(l_partkey AS VARCHAR)) AS h FROM lineitem)"
