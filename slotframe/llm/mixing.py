"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

DataFrame and SQL functions only.  Documents of a source fall into blocks by a hash of
their id; the block count is a power of two that follows the source's document count.
An odd affine map modulo that count permutes the blocks.  A source's target in words
becomes a quota of blocks: whole passes over all its blocks, then the first blocks of
the permutation until the remaining words are reached, the last one cut between two
documents.  The quotas are split among the output shards by a binary tree: each node
gives its left child half of its blocks, drawn without replacement, source by source
(conditional hypergeometric draws by inverting the distribution function).  The leaves'
quotas cut a source's permuted draw sequence into disjoint runs, one a shard, and a
shard orders its documents by a hash.

Defined cases: a null text has size 0; a null source is a source of its own, last in
order; a source of size 0 has target 0 and documents of size 0 are drawn like others
but add no words; a repeated row counts each time; an empty table gives an empty
result; a text of any length has all its words counted and is drawn as a whole; of ``docs``
only the three named columns are read, and the others, whatever their names, come back as they are.
All randomness comes from hashes of ids and the seed: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, materialize, spare
from .windows import estimated_bytes

#: Documents in a block, about.
BLOCK_DOCS = 64
#: Positions in a run of blocks, the unit of the two-level running sum.
RUN = 256
#: Bytes of documents, by the planner's estimate, that one piece of a shard is made for.
PIECE_BYTES = 1 << 20


def word_count(text: Column) -> Column:
    """Words of white-space-separated text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("bigint")


def _unit(*parts: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def rank_sources(sizes: DataFrame) -> DataFrame:
    """Adds ``rank`` (0, 1, ...) by source in code point order, null last, without one task for all."""
    placed = materialize(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "sources")
    part, row = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    starts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # one row a sort partition
    starts = starts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    starts = starts.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(starts), part == F.col("_part")).withColumn("rank", F.col("_before") + row).drop("_at", "_part", "_before")


def water_level(ranked: DataFrame, cap: float) -> tuple[float, int]:
    """(level, total): targets are min(cap * size, level * weight) and add up to total.

    Each pass is one aggregate; a pass that finds no further capped source ends it.
    """
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    level, capped = 0.0, -1
    while total:
        full = F.lit(cap) * F.col("source_size") <= F.lit(level) * F.col("weight")
        r = ranked.agg(
            F.sum(F.when(full, F.lit(cap) * F.col("source_size")).otherwise(0.0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight").cast("double"))).alias("weight"),
            F.count_if(full).alias("n"),
        ).first()
        if r["n"] == capped or not r["weight"]:
            break
        capped, level = r["n"], max(level, (total - r["held"]) / r["weight"])
    return level, total


def _log_factorial(n: str) -> str:
    """ln n! in SQL: Stirling's series at n + 9, brought back by a product."""
    z = f"({n} + 9.0D)"
    low = " * ".join(f"({n} + {k}.0D)" for k in range(1, 9))
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1.0D / (12.0D * {z}) - 1.0D / (360.0D * {z} * {z} * {z}) - ln({low}))"


def _hypergeometric(total: str, marked: str, drawn: str, unit: str) -> str:
    """SQL: how many of ``marked`` among ``total`` items are within ``drawn`` ones, by inversion at ``unit``.

    The support is taken to 12 deviations around the mean, beyond which no double has weight.
    """
    lf = _log_factorial
    weights = f"""transform(sequence(greatest(s.lo, cast(s.m - 12 * s.d as bigint) - 2), least(s.hi, cast(s.m + 12 * s.d as bigint) + 2)), x -> struct(x as x, exp(
        {lf("s.k")} - {lf("x")} - {lf("(s.k - x)")} + {lf("(s.n - s.k)")} - {lf("(s.r - x)")} - {lf("(s.n - s.k - s.r + x)")} - s.peak) as w))"""
    setup = f"""transform(array(struct({total} as n, {marked} as k, {drawn} as r)), t -> struct(t.n as n, t.k as k, t.r as r,
        greatest(0L, t.r + t.k - t.n) as lo, least(t.r, t.k) as hi, t.r * (t.k / t.n) as m,
        sqrt(t.r * (t.k / t.n) * (1 - t.k / t.n) * ((t.n - t.r) / greatest(t.n - 1, 1))) as d))"""
    peak = f"""transform({setup}, t -> struct(t.n as n, t.k as k, t.r as r, t.lo as lo, t.hi as hi, t.m as m, t.d as d,
        {lf("t.k")} - {lf("t.c")} - {lf("(t.k - t.c)")} + {lf("(t.n - t.k)")} - {lf("(t.r - t.c)")} - {lf("(t.n - t.k - t.r + t.c)")} as peak))"""
    peak = peak.replace("t.c", "greatest(t.lo, least(t.hi, cast(t.m as bigint)))")
    pick = f"""transform({peak}, s -> transform(array({weights}), ws -> aggregate(ws,
        struct(0.0D as seen, {unit} * aggregate(ws, 0.0D, (a, v) -> a + v.w) as goal, s.hi as x, false as done),
        (a, v) -> if(a.done, a, struct(a.seen + v.w as seen, a.goal as goal, if(a.seen + v.w >= a.goal, v.x, a.x) as x, a.seen + v.w >= a.goal as done)),
        a -> a.x))[0])[0]"""
    return f"if({total} <= 0 or {marked} <= 0 or {drawn} <= 0, 0L, if({marked} >= {total}, {drawn}, {pick}))"


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(rank, quota) to (rank, cuts): the running leaf quotas of each source over 2**levels shards.

    One row a tree node carries the quotas of all sources as one array of numbers, in rank order:
    8 bytes a source, however many rows a source has.
    """
    node = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("rank", "quota"))).alias("q")).select(F.lit(0).cast("bigint").alias("node"), "q")
    draw = _hypergeometric("a.total", "v.quota", "a.want", "((shiftrightunsigned(xxhash64(node, v.rank, level, seed), 11) + 0.5D) / 9007199254740992.0D)")
    for level in range(levels):
        split = f"""aggregate(q, struct(aggregate(q, 0L, (a, v) -> a + v.quota) as total, aggregate(q, 0L, (a, v) -> a + v.quota) div 2 as want, cast(array() as array<struct<rank:bigint,quota:bigint>>) as left),
            (a, v) -> transform(array({draw}), x -> struct(a.total - v.quota as total, a.want - x as want, concat(a.left, array(struct(v.rank as rank, x as quota))) as left))[0],
            a -> a.left)""".replace("level", str(level)).replace("seed", str(seed))
        # transform over an array of one binds the split once for both children
        both = f"""flatten(transform(array({split}), s -> array(struct(node * 2 as node, s as q),
            struct(node * 2 + 1 as node, zip_with(q, s, (v, l) -> struct(v.rank as rank, v.quota - l.quota as quota)) as q))))"""
        node = node.select(F.explode(F.expr(both)).alias("s")).select("s.*")
        node = node.repartition(F.col("node"))
    leaves = node.select("node", F.inline("q"))
    cuts = Window.partitionBy("rank").orderBy("node")
    leaves = leaves.withColumn("end", F.sum("quota").over(cuts))
    return leaves.groupBy("rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "end"))), lambda s: s["end"]).alias("cuts"))


def plan_mix(docs: DataFrame, weights=(1, 2, 3), cap: float = 3.0, shard_levels: int = 4, seed: int = 17, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, ``th`` (a hash of its text) and ``draws``.

    ``draws`` lists the copies that the mix takes of it as structs (copy, shard, key); a
    shard holds its draws in the order of ``key``.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("th"))
    base = materialize(base, "mix-sizes")
    ranked = rank_sources(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")))
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", pick)
    level, _ = water_level(ranked, cap)
    sources = (
        ranked.withColumn("target", F.least(F.lit(float(cap)) * F.col("source_size"), F.lit(level) * F.col("weight")))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("bigint"))
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
        .withColumn("blocks", F.expr(f"shiftleft(1L, cast(greatest(0, ceil(log2(n_docs / {BLOCK_DOCS}.0D))) as int))"))
        .withColumn("odd", F.expr(f"(pmod(xxhash64(rank, {seed}, 1), blocks) div 2) * 2 + 1"))
        .withColumn("shift", F.expr(f"pmod(xxhash64(rank, {seed}, 2), blocks)"))
    )
    sources = materialize(sources.select("source", "rank", "source_size", "target", "passes", "rest", "blocks", "odd", "shift"), "mix-sources")
    facts = sources.select(F.col("source").alias("_s"), "rank", "source_size", "target", "passes", "rest", "blocks", "odd", "shift")
    placed = (
        base.join(facts, F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("pos", F.expr(f"pmod(odd * pmod(xxhash64(doc_id, th, {seed}, 3), blocks) + shift, blocks)"))
        .withColumn("key", F.xxhash64("doc_id", "th", F.lit(seed), F.lit(4)))
    )
    # running words before each block: within runs of blocks, and over runs
    blocks = placed.groupBy("rank", "pos").agg(F.sum("size").alias("words"))
    blocks = blocks.withColumn("run", F.floor(F.col("pos") / RUN))
    runs = blocks.groupBy("rank", "run").agg(F.sum("words").alias("run_words"))
    runs = runs.withColumn("before_run", F.sum("run_words").over(Window.partitionBy("rank").orderBy("run")) - F.col("run_words")).drop("run_words")
    in_run = F.sum("words").over(Window.partitionBy("rank", "run").orderBy("pos")) - F.col("words")
    blocks = blocks.withColumn("in_run", in_run).join(runs, ["rank", "run"]).select("rank", "pos", "words", (F.col("before_run") + F.col("in_run")).alias("before"))
    blocks = materialize(blocks, "mix-blocks")
    last = F.max(F.when(F.col("before") < F.col("rest"), F.col("pos") + 1))
    drawn = blocks.join(facts.select("rank", "rest"), "rank").groupBy("rank").agg(F.coalesce(last, F.lit(0)).alias("part"))
    # A quota counts draw slots: every position in a full pass, then positions 0 to part - 1.
    quotas = facts.join(drawn, "rank").select("rank", (F.col("passes") * F.col("blocks") + F.col("part")).alias("quota"))
    cuts = materialize(split_quotas(quotas, shard_levels, seed), "mix-cuts")
    first = Window.partitionBy("rank", "pos").orderBy("key", "doc_id", "th").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        placed.join(blocks.select("rank", "pos", "before"), ["rank", "pos"])
        .withColumn("so_far", F.col("before") + F.coalesce(F.sum("size").over(first), F.lit(0)))
        .withColumn("extra", (F.col("so_far") < F.col("rest")) & (F.col("so_far") + F.col("size") / 2.0 <= F.col("rest")) & (F.col("passes") < F.lit(cap)))
        .withColumn("copies", F.col("passes") + F.col("extra").cast("bigint"))
        .join(cuts, "rank")
    )
    shard = "size(filter(cuts, c -> c <= copy * blocks + pos))"
    draws = F.expr(f"transform(if(copies > 0, sequence(0L, copies - 1), cast(array() as array<bigint>)), copy -> struct(copy as copy, {shard} as shard, xxhash64(key, copy) as key))")
    return placed.select("doc_id", "source", "size", "source_size", "target", "th", draws.alias("draws"))


def _in_shards(draws: DataFrame, docs: DataFrame, shard, key) -> DataFrame:
    """Rows placed and sorted by shard and order key; a shard's rows fall into pieces of about ``PIECE_BYTES``, by ranges of the key."""
    pieces = max(16, estimated_bytes(docs) // PIECE_BYTES)
    place = F.floor(F.pmod(F.shiftrightunsigned(key, 1), F.lit(1 << 40)) / F.lit((1 << 40) / pieces)).cast("long")
    return draws.repartition(shard, place).sortWithinPartitions(shard, place, key)


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row a drawn copy: doc_id, source, size, copy, shard and its order ``key``, each shard in shuffled order."""
    plan = plan_mix(docs, **options).select("doc_id", "source", "size", F.inline("draws"))
    return _in_shards(plan, docs, F.col("shard"), F.col("key"))


def mix_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The mix with the columns of ``docs``: a row for each drawn copy, shard by shard in shuffled order.

    Rows that share id, source and text are one document, which all their draws repeat.
    """
    ident, source, hashed, draw, own = spare(docs.columns, "_mix_id", "_mix_source", "_mix_hash", "_mix_draw", "_mix_own")
    plan = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).filter(F.size("draws") > 0)
    plan = materialize(plan.select(F.col("doc_id").alias(ident), F.col("source").alias(source), F.col("th").alias(hashed), F.col("draws").alias(draw)), "mix-draws")
    rows = docs.withColumn(own, F.xxhash64(F.col(text_col).cast("string")))
    if not plan.groupBy(ident, source, hashed).count().filter("count > 1").isEmpty():
        plan = plan.groupBy(ident, source, hashed).agg(F.flatten(F.collect_list(draw)).alias(draw))
        rows = rows.dropDuplicates([id_col, source_col, own])
    same = F.col(id_col).eqNullSafe(F.col(ident)) & F.col(source_col).cast("string").eqNullSafe(F.col(source)) & (F.col(own) == F.col(hashed))
    drawn = rows.join(plan, same).withColumn(draw, F.explode(draw))
    return _in_shards(drawn, docs, F.col(f"{draw}.shard"), F.col(f"{draw}.key")).select(*docs.columns)
