"""Transaction metadata rows (A6) with counts, fees and the scheduler's cost and priority.

All of it is array expressions in one projection: no shuffle, no Python.
Input: slot, tx_idx, num_signatures, required, ro_signed, ro_unsigned, is_legacy, config (struct or
null: priority_fee, compute_unit_limit, loaded_limit, heap_size), fee, consumed, is_success, static_keys, loaded_writable,
loaded_readonly (arrays of keys), instructions (array of struct program_index, accounts, data).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ints import U64, saturate16, wrap16

#: Cost units and limits of the execution model.
SIGNATURE, SECP256K1_SIGNATURE, ED25519_SIGNATURE, SECP256R1_SIGNATURE, WRITE_LOCK = 720, 6690, 2400, 4800, 300
BUILTIN_UNITS, OTHER_UNITS, MAX_UNITS = 3_000, 200_000, 1_400_000
MAX_LOADED, LOADED_PAGE, PAGE_COST = 64 << 20, 32 << 10, 8
MIN_HEAP, MAX_HEAP = 32 << 10, 256 << 10
LAMPORTS_PER_SIGNATURE, BURN_PERCENT, MICRO, MAX_DATA = 5_000, 50, 1_000_000, 65_535


@dataclass(frozen=True)
class Programs:
    """Keys of the programs that the rules name; any type of key."""

    vote: object = "vote"
    budget: object = "compute_budget"
    secp256k1: object = "secp256k1"
    ed25519: object = "ed25519"
    secp256r1: object = "secp256r1"
    others: tuple = ("system", "bpf_loader_upgradeable", "bpf_loader_deprecated", "bpf_loader", "loader_v4")
    counted: tuple = field(init=False, default=())
    cheap: tuple = field(init=False, default=())

    def __post_init__(self):
        rest = (*self.others, self.budget, self.secp256k1, self.ed25519)
        object.__setattr__(self, "counted", (self.vote, *rest))  # for num_ixs_builtin
        object.__setattr__(self, "cheap", rest)  # for default units: the vote program isn't among them


def little_endian(data: Column, start: int, size: int) -> Column:
    """An unsigned number of ``size`` bytes from byte ``start`` (0 first); null if data is shorter."""
    digits = F.hex(F.substring(data, start + 1, size))
    swapped = F.regexp_replace(F.reverse(digits), "(.)(.)", "$2$1")  # bytes reversed; reverse() itself is for text
    return F.when(F.octet_length(data) >= start + size, F.conv(swapped, 16, 10).cast("decimal(20,0)"))


def first_byte(data: Column) -> Column:
    return F.when(F.octet_length(data) > 0, F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int"))


def _resolved(keys: Column, total: Column, p: Programs):
    """What the rules ask of an instruction, for a transform over instructions."""

    def resolve(i):
        program = F.get(keys, i["program_index"])
        budget = F.coalesce(program == F.lit(p.budget), F.lit(False))
        data, tag = i["data"], first_byte(i["data"])
        value = F.when(budget, F.when(tag == 3, little_endian(data, 1, 8)).when(tag.isin(1, 2, 4), little_endian(data, 1, 4)))
        known = F.when(tag.isin(1, 2, 4), F.octet_length(data) >= 5).when(tag == 3, F.octet_length(data) >= 9)
        one = lambda names: F.coalesce(program.isin(*names), F.lit(False)).cast("int")
        signed = F.when(program == F.lit(p.secp256k1), 1).when(program == F.lit(p.ed25519), 2).when(program == F.lit(p.secp256r1), 3).otherwise(0)
        stray = program.isNull() | F.coalesce(F.exists(i["accounts"], lambda a: a >= total), F.lit(False))
        return F.struct(
            F.when(budget, F.coalesce(tag, F.lit(0))).otherwise(-1).alias("tag"),
            value.alias("value"),
            (budget & ~F.coalesce(known, F.lit(False))).alias("unknown"),
            F.octet_length(data).cast("bigint").alias("size"),
            one(p.cheap).alias("cheap"),
            one(p.counted).alias("counted"),
            signed.alias("signed"),
            F.coalesce(tag, F.lit(0)).cast("bigint").alias("first"),
            stray.alias("stray"),
        )

    return resolve


def _zero(**columns) -> Column:
    return F.struct(*[F.lit(v).cast(t).alias(k) for k, (v, t) in columns.items()])


#: The fold's start: sums, flags, the budget tags seen as bits, and the last value of each tag (1 heap, 2 limit, 3 price, 4 loaded).
_START = dict(data=(0, "bigint"), cheap=(0, "int"), counted=(0, "int"), secp=(0, "bigint"), ed=(0, "bigint"), r1=(0, "bigint"), stray=(False, "boolean"), unknown=(False, "boolean"), again=(False, "boolean"), seen=(0, "int"))
_VALUES = {f"v{k}": (None, "decimal(20,0)") for k in (1, 2, 3, 4)}


def _fold(a, i) -> Column:
    bit = F.when(i["tag"].between(1, 4), F.pow(F.lit(2.0), i["tag"]).cast("int")).otherwise(0)
    signed = lambda name, k: (a[name] + F.when(i["signed"] == k, i["first"]).otherwise(0)).alias(name)
    return F.struct(
        (a["data"] + i["size"]).alias("data"),
        (a["cheap"] + i["cheap"]).alias("cheap"),
        (a["counted"] + i["counted"]).alias("counted"),
        signed("secp", 1),
        signed("ed", 2),
        signed("r1", 3),
        (a["stray"] | i["stray"]).alias("stray"),
        (a["unknown"] | i["unknown"]).alias("unknown"),
        (a["again"] | (a["seen"].bitwiseAND(bit) != 0)).alias("again"),
        a["seen"].bitwiseOR(bit).alias("seen"),
        *[F.when(i["tag"] == k, i["value"]).otherwise(a[f"v{k}"]).alias(f"v{k}") for k in (1, 2, 3, 4)],
    )


def tx_meta(tx: DataFrame, p: Programs = Programs()) -> DataFrame:
    """One row a transaction, in the column order of the sink; instructions are resolved and folded once."""
    c = F.col
    dec = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("decimal(38,0)")
    v1 = c("config").isNotNull()
    legacy = c("is_legacy")
    static_n, lw, lr = F.size("static_keys"), F.size("loaded_writable"), F.size("loaded_readonly")
    ro_static = c("ro_signed") + c("ro_unsigned")
    t = tx.withColumns({"_all": F.concat("static_keys", "loaded_writable", "loaded_readonly"), "_n": static_n + lw + lr})
    t = t.withColumn("_ix", F.transform("instructions", _resolved(c("_all"), c("_n"), p)))
    t = t.withColumn("_s", F.aggregate("_ix", _zero(**_START, **_VALUES), _fold))
    s = lambda name: c("_s")[name]
    is_vote = F.coalesce(F.get("static_keys", F.get("instructions", F.lit(0))["program_index"]) == F.lit(p.vote), F.lit(False))
    limit_seen, price_seen = s("v2"), s("v3")
    cu_limit = F.when(v1, c("config.compute_unit_limit").cast("decimal(20,0)")).otherwise(limit_seen)
    cu_price = F.when(~v1, price_seen)

    # the scheduler's view
    n_ix, data_len = F.size("instructions"), s("data")
    default_units = s("cheap") * BUILTIN_UNITS + (n_ix - s("cheap")) * OTHER_UNITS
    units = F.least(F.when(v1, F.coalesce(c("config.compute_unit_limit"), F.lit(0)).cast("bigint")).otherwise(F.coalesce(limit_seen.cast("bigint"), default_units.cast("bigint"))), F.lit(MAX_UNITS))
    loaded = F.least(F.when(v1, F.coalesce(c("config.loaded_limit"), F.lit(0)).cast("bigint")).otherwise(F.when(s("seen").bitwiseAND(F.lit(16)) != 0, s("v4").cast("bigint")).otherwise(MAX_LOADED)), F.lit(MAX_LOADED))
    locks = c("_n") - (ro_static + lr)
    sigs, secp, ed, r1 = c("num_signatures"), s("secp"), s("ed"), s("r1")
    cost = sigs * SIGNATURE + secp * SECP256K1_SIGNATURE + ed * ED25519_SIGNATURE + r1 * SECP256R1_SIGNATURE + locks * WRITE_LOCK + F.floor(data_len / 4) + units + F.ceil(loaded / LOADED_PAGE) * PAGE_COST
    priority_fee = F.when(v1, dec(F.coalesce(c("config.priority_fee"), F.lit(0)))).otherwise(F.ceil(dec(F.coalesce(cu_price, F.lit(0))) * units.cast("decimal(10,0)") / F.lit(MICRO).cast("decimal(7,0)")).cast("decimal(38,0)"))
    priority_fee = F.least(priority_fee, dec(U64))
    base = dec((sigs + secp + ed + r1) * LAMPORTS_PER_SIGNATURE)
    reward = priority_fee + base - F.floor(base * BURN_PERCENT / 100).cast("decimal(38,0)")
    scaled = F.least(reward.cast("decimal(30,0)") * F.lit(MICRO).cast("decimal(7,0)"), dec(U64))
    t = t.withColumns({"_cost": cost.cast("bigint"), "_scaled": scaled})
    priority = F.expr("cast(_scaled div (_cost + 1) as decimal(20,0))")

    heap = F.when(v1, c("config.heap_size").cast("bigint")).otherwise(s("v1").cast("bigint"))
    bad = (
        (sigs != c("required"))
        | (c("ro_signed") > c("required"))
        | (static_n < c("required"))
        | (c("ro_unsigned") > static_n - c("required"))
        | ((legacy | v1) & (lw + lr > 0))
        | s("stray")
        | F.coalesce((heap < MIN_HEAP) | (heap > MAX_HEAP) | (heap % 1024 != 0), F.lit(False))
        | (data_len > MAX_DATA)
        | (~v1 & (s("unknown") | s("again")))
        | (~v1 & F.coalesce(loaded == 0, F.lit(False)))
    )
    return t.select(
        "slot",
        "tx_idx",
        F.coalesce("consumed", F.lit(0)).alias("cu"),
        F.when(~is_vote, cu_limit).cast("bigint").alias("cu_limit"),
        F.when(~is_vote, cu_price).alias("cu_price"),
        F.when(is_vote, 0).otherwise(F.greatest(c("fee") - LAMPORTS_PER_SIGNATURE * sigs, F.lit(0))).alias("prio_fee"),
        F.when(is_vote, LAMPORTS_PER_SIGNATURE).otherwise(c("fee")).alias("txn_fee"),
        F.when(~bad, c("_cost")).alias("scheduler_cost_units"),
        F.when(~bad, priority).alias("scheduler_priority"),
        is_vote.alias("is_vote"),
        c("is_success"),
        F.when(is_vote, 1).otherwise(saturate16(n_ix)).alias("num_ixs"),
        F.when(is_vote, 1).otherwise(saturate16(s("counted"))).alias("num_ixs_builtin"),
        wrap16(F.greatest(static_n - ro_static, F.lit(0)) + lw).alias("num_accounts_rw"),
        wrap16(ro_static + lr).alias("num_accounts_ro"),
        F.when(legacy, -1).when(v1, 1).otherwise(0).alias("tx_version"),
    )
