"""Queries of scalar functions (F5 to F21) and of the transaction metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codecs, ints, units
from ..plans import fixtures as fx
from ..plans.register import query
from .joins import manifest
from .txmeta import Programs, tx_meta


@query("F5_clamps", f"WITH {fx.SLOTS_SQL}, t AS (SELECT slot, CASE slot % 4 WHEN 0 THEN NULL WHEN 1 THEN -100 WHEN 2 THEN 4294967296 ELSE block_time END AS t FROM slots) SELECT slot, least(greatest(coalesce(t, 0), 0), 4294967295) AS time, least(slot * 1000000, 4294967295) AS clamped FROM t")
def f5(spark, d):
    t = F.when(F.col("slot") % 4 == 1, F.lit(-100)).when(F.col("slot") % 4 == 2, F.lit(1 << 32)).when(F.col("slot") % 4 == 3, F.col("block_time"))
    return fx.slots(spark, d).select("slot", ints.clamp_time(t).alias("time"), ints.clamp_slot(F.col("slot") * 1_000_000).alias("clamped"))


def _key(c="key"):
    return F.unhex(F.sha2(F.col(c).cast("string"), 256))


@query("F6_siphash", f"WITH {fx.KEYS_SQL} SELECT key, CAST({fx.siphash_sql('h')} AS VARCHAR) AS id FROM keys")
def f6(spark, d):
    return fx.instructions(spark, d).select("key").distinct().select("key", codecs.siphash_column(_key()).alias("id"))


@query("F7_xxh64")
def f7(spark, d):
    return fx.instructions(spark, d).select("key").distinct().select("key", codecs.xxh64_column(_key()).alias("checksum"))


@query(
    "F8_crc64",
    """WITH k AS (SELECT DISTINCT l_partkey AS key, sha256(CAST(l_partkey AS VARCHAR)) AS h FROM lineitem)
SELECT key, CAST(xor(list_reduce(list_prepend(18446744073709551615::UBIGINT, list_transform(range(32), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS UBIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::UBIGINT)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 15564440312192434176::UBIGINT) ELSE x >> 1 END)), 18446744073709551615::UBIGINT) AS VARCHAR) AS checksum FROM k""",
)
def f8(spark, d):
    return fx.instructions(spark, d).select("key").distinct().select("key", codecs.crc64_column(_key()).alias("checksum"))


@query("F9_manifest_digest", "SELECT sha256(string_agg(lpad(hex(user_id), 16, '0'), '' ORDER BY user_id)) AS digest, count(*) AS accounts FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value >= 200)")
def f9(spark, d):
    """A digest over the keys in order; the list is a manifest, short by nature."""
    keys = manifest(spark, d).filter("pubkey < 999999999").agg(F.sort_array(F.collect_list(F.lpad(F.hex("pubkey"), 16, "0"))).alias("k"))
    return keys.select(F.sha2(F.array_join("k", ""), 256).alias("digest"), F.size("k").cast("bigint").alias("accounts"))


@query(
    "F10_plugin_ids",
    """SELECT name, CAST(list_reduce(list_prepend(1, list_transform(range(32), lambda i: CAST('0x' || substr(sha256(name), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER))), lambda r, b: (r * 31 + b) % 65536) AS INTEGER) AS id
FROM (SELECT unnest(['program-tracking', 'instruction-tracking', 'pubkey-stats', 'tx-metadata']) AS name)""",
)
def f10(spark, d):
    names = ("program-tracking", "instruction-tracking", "pubkey-stats", "tx-metadata")
    return spark.createDataFrame([(n, codecs.plugin_id(n)) for n in names], "name string, id int")


@query("F11_base58")
def f11(spark, d):
    return fx.instructions(spark, d).select("key").distinct().select("key", codecs.base58_column(_key()).alias("text"))


@query("F12_epochs", f"WITH {fx.SLOTS_SQL} SELECT slot, slot * 97 // 432000 AS epoch, slot * 97 // 432000 * 432000 AS first, slot * 97 // 432000 * 432000 + 431999 AS last FROM slots")
def f12(spark, d):
    e = F.expr(f"slot * 97 div {units.EPOCH_SLOTS}")
    return fx.slots(spark, d).select("slot", e.alias("epoch"), (e * units.EPOCH_SLOTS).alias("first"), (e * units.EPOCH_SLOTS + units.EPOCH_SLOTS - 1).alias("last"))


@query("F13_partitions", f"WITH {fx.SLOTS_SQL} SELECT slot * 997 // 1000000 AS partition, count(*) AS slots FROM slots GROUP BY 1")
def f13(spark, d):
    return fx.slots(spark, d).groupBy(F.expr("slot * 997 div 1000000").alias("partition")).agg(F.count(F.lit(1)).alias("slots"))


def pack_status(tx_code, ix_code):
    """Codes as one word: (tx_code + 1) | (ix_code + 1) << 8."""
    return (tx_code + 1).bitwiseOR(F.shiftleft(ix_code + 1, 8))


def unpack_status(word):
    return word.bitwiseAND(F.lit(255)) - 1, F.shiftright(word, 8) - 1


@query("F14_status_words", f"WITH {fx.TX_SQL}, s AS (SELECT slot, tx_idx, ((slot % 39 + 1) | ((tx_idx + 1) << 8)) AS word FROM tx) SELECT slot, tx_idx, word, (word & 255) - 1 AS tx_code, (word >> 8) - 1 AS ix_code FROM s")
def f14(spark, d):
    w = fx.transactions(spark, d).select("slot", "tx_idx", pack_status(F.col("slot") % 39, F.col("tx_idx")).alias("word"))
    tx, ix = unpack_status(F.col("word"))
    return w.select("slot", "tx_idx", "word", tx.alias("tx_code"), ix.alias("ix_code"))


@query("F16_id_widths", "SELECT DISTINCT l_partkey AS rank, CASE WHEN l_partkey <= 127 THEN 1 WHEN l_partkey <= 65535 THEN 2 WHEN l_partkey <= 16777215 THEN 3 WHEN l_partkey <= 4294967295 THEN 4 ELSE 5 END AS bytes FROM lineitem")
def f16(spark, d):
    r = F.col("rank")
    width = F.when(r <= 127, 1).when(r <= 65535, 2).when(r <= 16777215, 3).when(r <= 4294967295, 4).otherwise(5)
    return fx.instructions(spark, d).select(F.col("key").alias("rank")).distinct().withColumn("bytes", width)


@query(
    "F17_units",
    """SELECT text, bytes, CASE WHEN bytes >= 1073741824 THEN printf('%.2f GiB', bytes / 1073741824.0) WHEN bytes >= 1048576 THEN printf('%.2f MiB', bytes / 1048576.0) WHEN bytes >= 1024 THEN printf('%.2f KiB', bytes / 1024.0) ELSE bytes || ' B' END AS shown, format('{:,}', bytes) AS grouped
FROM (SELECT text, CAST(regexp_replace(text, '[^0-9]', '', 'g') AS BIGINT) * CASE WHEN text ILIKE '%g%' THEN 1073741824 WHEN text ILIKE '%m%' THEN 1048576 WHEN text ILIKE '%k%' THEN 1024 ELSE 1 END AS bytes FROM (SELECT unnest(['4GiB', '512mb', '1_000', '64k']) AS text))""",
)
def f17(spark, d):
    rows = [(t, units.parse_bytes(t), units.format_bytes(units.parse_bytes(t)), units.thousands(units.parse_bytes(t))) for t in ("4GiB", "512mb", "1_000", "64k")]
    return spark.createDataFrame(rows, "text string, bytes bigint, shown string, grouped string")


@query("F19_range_parts", "SELECT i AS part, i * 142 + least(i, 12) AS start, (i + 1) * 142 + least(i + 1, 12) AS stop FROM (SELECT unnest(range(0, 14)) AS i)")
def f19(spark, d):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(units.split_range(0, 2000, 14))], "part bigint, start bigint, stop bigint")


@query("F20_entry_hashes")
def f20(spark, d):
    """The hash chain of each block recomputed entry by entry, streamed in order."""
    import pandas as pd

    from .joins import entries

    def chain(batches):
        slot, h = None, b""
        for pdf in batches:
            out = []
            for s, n in zip(pdf["slot"], pdf["tx_count"], strict=True):
                slot, h = (s, h) if s == slot else (s, b"\0" * 32)
                h = codecs.next_entry_hash(h, int(n) + 2, b"mix" if n else None)
                out.append(h.hex())
            yield pd.DataFrame({"slot": pdf["slot"], "entry_index": pdf["entry_index"], "hash": out})

    ordered = entries(spark, d).repartition("slot").sortWithinPartitions("slot", "entry_index")
    return ordered.mapInPandas(chain, "slot bigint, entry_index bigint, hash string")


@query("F21_json", f"WITH {fx.BLOCKS_SQL} SELECT slot, '{{\"slot\":' || slot || ',\"status\":\"' || status || '\"}}' AS json FROM blocks")
def f21(spark, d):
    return fx.blocks(spark, d).select("slot", F.to_json(F.struct("slot", "status")).alias("json"))


def fixture_messages(spark, d):
    """Transactions shaped as messages, from instructions; a third of each version.

    A program is one of five; the compute budget program gets each of its tags, some twice and some cut
    short, heap sizes outside the limits and, elsewhere, account indexes out of range and wrong signature counts.
    """
    names = F.array(*[F.lit(x) for x in ("payer", "account", "system", "compute_budget", "program", "vote", "ed25519")])
    le = lambda value, size: f"regexp_replace(reverse(lpad(hex({value}), {2 * size}, '0')), '(.)(.)', '$2$1')"
    data = F.expr(
        f"""unhex(case when program_id % 5 = 1 then case when key % 8 <= 2 then concat('02', {le("data_len * 1000", 4)}) when key % 8 <= 4 then concat('03', {le("key * 1000", 8)})
        when key % 8 = 5 then concat('01', {le("data_len * 1024", 4)}) when key % 8 = 6 then concat('04', {le("data_len * 100000", 4)}) else '0201' end
        when program_id % 5 = 4 then concat('0', data_len % 4) else '01' end)"""
    )
    far = F.when((F.col("program_id") % 5 == 2) & (F.col("key") % 97 == 0), 99).otherwise(1)
    ix = fx.instructions(spark, d).select("slot", "tx_idx", "tax", "err", F.struct((F.col("program_id") % 5 + 2).cast("int").alias("program_index"), F.array(F.lit(0), far).alias("accounts"), data.alias("data")).alias("ix"))
    tx = ix.groupBy("slot", "tx_idx").agg(F.sort_array(F.collect_list("ix")).alias("instructions"), F.sum("tax").alias("fee"), (~F.bool_or("err")).alias("is_success"))
    v = F.col("tx_idx") % 3
    config = F.struct(F.col("fee").alias("priority_fee"), F.lit(100_000).cast("bigint").alias("compute_unit_limit"), F.lit(65536).cast("bigint").alias("loaded_limit"), F.lit(None).cast("bigint").alias("heap_size"))
    looked_up = lambda name: F.when(v == 1, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    return tx.select(
        "slot", "tx_idx", F.when(F.col("slot") % 50 == 0, 2).otherwise(1).alias("num_signatures"), F.lit(1).alias("required"), F.lit(0).alias("ro_signed"), F.lit(5).alias("ro_unsigned"), (v == 0).alias("is_legacy"), F.when(v == 2, config).alias("config"),
        "fee", F.lit(300).cast("bigint").alias("consumed"), "is_success", names.alias("static_keys"), looked_up("written").alias("loaded_writable"), looked_up("read").alias("loaded_readonly"), "instructions",
    )


META_SQL = f"""{fx.IX_SQL}, coded AS (SELECT *, program_id % 5 + 2 AS pi, lpad(hex(CASE WHEN key % 8 <= 2 THEN data_len * 1000 WHEN key % 8 = 5 THEN data_len * 1024 ELSE data_len * 100000 END), 8, '0') AS h4, lpad(hex(key * 1000), 16, '0') AS h8 FROM ix),
i AS (SELECT *, CASE WHEN pi = 3 THEN CASE WHEN key % 8 IN (3, 4) THEN 3 WHEN key % 8 = 5 THEN 1 WHEN key % 8 = 6 THEN 4 ELSE 2 END WHEN pi = 6 THEN data_len % 4 ELSE 1 END AS tag,
  CASE WHEN pi <> 3 THEN 1 WHEN key % 8 = 7 THEN 2 WHEN key % 8 IN (3, 4) THEN 9 ELSE 5 END AS size,
  CASE WHEN key % 8 <= 2 THEN data_len * 1000 WHEN key % 8 <= 4 THEN key * 1000 WHEN key % 8 = 5 THEN data_len * 1024 WHEN key % 8 = 6 THEN data_len * 100000 END AS val,
  CASE WHEN key % 8 = 7 THEN '01' WHEN key % 8 IN (3, 4) THEN array_to_string(list_transform(range(15, 0, -2), lambda x: substr(h8, x, 2)), '') ELSE array_to_string(list_transform(range(7, 0, -2), lambda x: substr(h4, x, 2)), '') END AS bytes FROM coded),
t AS (SELECT slot, tx_idx, CAST(sum(tax) AS BIGINT) AS fee, NOT bool_or(err) AS is_success, count(*) AS n, min(pi) = 5 AS is_vote, sum(size) AS data_len,
  count(*) FILTER (pi IN (2, 3, 6)) AS cheap, count(*) FILTER (pi IN (2, 3, 5, 6)) AS builtin, coalesce(sum(tag) FILTER (pi = 6), 0) AS ed,
  last(val ORDER BY bytes) FILTER (pi = 3 AND tag = 1) AS heap, last(val ORDER BY bytes) FILTER (pi = 3 AND tag = 2) AS lim,
  last(val ORDER BY bytes) FILTER (pi = 3 AND tag = 3) AS price, last(val ORDER BY bytes) FILTER (pi = 3 AND tag = 4) AS loaded,
  greatest(count(*) FILTER (pi = 3 AND tag = 1), count(*) FILTER (pi = 3 AND tag = 2), count(*) FILTER (pi = 3 AND tag = 3), count(*) FILTER (pi = 3 AND tag = 4)) > 1 AS again,
  bool_or(pi = 3 AND size = 2) AS short, bool_or(pi = 4 AND key % 97 = 0) AS stray, tx_idx % 3 AS ver, CASE WHEN slot % 50 = 0 THEN 2 ELSE 1 END AS sigs, CASE WHEN tx_idx % 3 = 1 THEN 1 ELSE 0 END AS extra FROM i GROUP BY slot, tx_idx),
u AS (SELECT *, least(1400000, CASE WHEN ver = 2 THEN 100000 ELSE coalesce(lim, cheap * 3000 + (n - cheap) * 200000) END) AS units, least(67108864, CASE WHEN ver = 2 THEN 65536 ELSE coalesce(loaded, 67108864) END) AS held,
  sigs <> 1 OR stray OR data_len > 65535 OR (ver <> 2 AND (short OR again OR coalesce(heap < 32768 OR heap > 262144 OR heap % 1024 <> 0, false))) AS bad FROM t),
w AS (SELECT *, CAST(sigs * 720 + ed * 2400 + (2 + extra) * 300 + data_len // 4 + units + (held + 32767) // 32768 * 8 AS BIGINT) AS cost,
  CAST(CASE WHEN ver = 2 THEN fee ELSE (coalesce(price, 0)::HUGEINT * units + 999999) // 1000000 END AS HUGEINT) + (sigs + ed) * 5000 - (sigs + ed) * 5000 * 50 // 100 AS reward FROM u),
meta AS (SELECT slot, tx_idx, CAST(300 AS BIGINT) AS cu, CASE WHEN NOT is_vote THEN CAST(CASE WHEN ver = 2 THEN 100000 ELSE lim END AS BIGINT) END AS cu_limit, CASE WHEN NOT is_vote AND ver <> 2 THEN CAST(price AS DECIMAL(20, 0)) END AS cu_price,
  CAST(CASE WHEN is_vote THEN 0 ELSE greatest(fee - 5000 * sigs, 0) END AS BIGINT) AS prio_fee, CAST(CASE WHEN is_vote THEN 5000 ELSE fee END AS BIGINT) AS txn_fee,
  CASE WHEN NOT bad THEN cost END AS scheduler_cost_units, CASE WHEN NOT bad THEN CAST(least(reward * 1000000, 18446744073709551615::HUGEINT) // (cost + 1) AS DECIMAL(20, 0)) END AS scheduler_priority, is_vote, is_success,
  CAST(CASE WHEN is_vote THEN 1 ELSE n END AS INTEGER) AS num_ixs, CAST(CASE WHEN is_vote THEN 1 ELSE builtin END AS INTEGER) AS num_ixs_builtin, CAST(2 + extra AS INTEGER) AS num_accounts_rw, CAST(5 + extra AS INTEGER) AS num_accounts_ro,
  CAST(CASE ver WHEN 0 THEN -1 WHEN 2 THEN 1 ELSE 0 END AS INTEGER) AS tx_version FROM w)"""


def meta(spark, d):
    return tx_meta(fixture_messages(spark, d), Programs())


@query("A6_tx_meta", f"WITH {META_SQL} SELECT * FROM meta")
def a6(spark, d):
    return meta(spark, d)


def _part(name: str, columns: str, where: str = "true") -> None:
    """A query for some rules of the metadata row; only what its columns need is computed."""
    query(name, f"WITH {META_SQL} SELECT slot, tx_idx, {columns} FROM meta WHERE {where}")(lambda spark, d: meta(spark, d).filter(where).select("slot", "tx_idx", *columns.split(", ")))


_part("F1_accounts_and_version", "num_accounts_ro, num_accounts_rw, tx_version")
_part("F2_vote_rows", "cu, txn_fee, prio_fee, cu_limit, cu_price, num_ixs, num_ixs_builtin, scheduler_cost_units, is_success", "is_vote")
_part("F3_other_rows", "num_ixs, num_ixs_builtin, cu_limit, cu_price, prio_fee, txn_fee", "NOT is_vote")
_part("F4_scheduler", "scheduler_cost_units, scheduler_priority")
