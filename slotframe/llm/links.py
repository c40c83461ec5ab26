"""From bucket keys to classes: candidate pairs, exact verification, distributed union-find.

Entities are texts (documents or lines) named by a 128-bit digest; ``id`` is its first
half.  An id shared by two texts only adds candidates, for verification reads texts and
edges name digests.

* ``pack_keys`` packs (key, id) rows of a batch into one blob a bucket.  A key that a batch
  holds twice is known to be shared: its rows go on at once and the bucket gets one of them,
  so a key that a third of all rows hold costs its bucket one row a batch.
* ``shared_keys`` gives the rows whose key occurs with two ids or more.
* ``star_pairs`` pairs each id with the centre of each of its keys: the id that meets the
  most others over all its keys, which a text that others are copies of does.
* ``classes`` verifies the pairs and joins them.  The members of a key that are still in several
  classes go on.  Those of a key with ``DIRECT`` members or fewer meet there again.  In a larger key each member takes,
  of its units (words or shingles) in one order by how common they are, so many of
  the rarest that two similar texts share one (``rarest``).  Members of such a key that are in different
  classes are compared by profiles, an exact bound (``close_pairs``), and what is left by their texts.  So every
  two members of a key end in one class or are told apart.
* ``components`` is a union-find by levels: tasks join the edges they read, the roots they found are joined on the next level.

Counts and centres are aggregates with partial sums, and joins split skewed keys: nothing is
gathered per key or node.  Every step up to the profiles is linear in the rows that share a
key; profile comparisons grow with the square of the texts of different classes that share a small key or a rare unit, a
block of them at a time; only pairs that they can't tell apart are given on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, materialize, release, trim
from .windows import _cuts, _split

KEYS = "bucket bigint, key binary, id binary, many binary"
#: Counters of shingles; a shared one only makes the order of the shingles less good.
COUNTERS = 1 << 18
#: Pairs that a member of a key may have in the first further round; sixteen times as many in each one after it.
CENTRES = 16
#: Members of a key that are compared at a time.
BLOCK = 1024
#: Members of a key, in several classes, that are all compared; those of larger keys are sought by their rarest units.
DIRECT = 4096
#: Bits of an id filter: sixteen an id, up to 16 MB.
FILTER_BITS = 1 << 27


def digest_columns(text) -> dict:
    """``digest`` (16 bytes) and ``id`` (its first half as a number) of a text column."""
    md5 = F.md5(text)
    return {"digest": F.unhex(md5), "id": F.conv(F.substring(md5, 1, 15), 16, 10).cast("bigint")}


def id_of(digest: bytes) -> int:
    """The id of a digest, as :func:`digest_columns` has it: its first 15 hexadecimal digits."""
    return int.from_bytes(digest[:8], "big") >> 4


def id_filter(ids: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """A test for numpy ids that holds for all ``ids`` and for about one in sixteen others; a join after it decides.

    Rows that it turns away need no exchange.
    """
    spark = ids.sparkSession
    bits = min(max(1 << 10, 1 << (16 * ids.count()).bit_length()), FILTER_BITS)
    at = F.col("id").bitwiseAND(F.lit(bits - 1))
    words = ids.select(F.shiftright(at, 6).alias("w"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(bits >> 6, np.int64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy()
    held = spark.sparkContext.broadcast(table.view(np.uint8))

    def test(x: np.ndarray) -> np.ndarray:
        h = x & (bits - 1)
        return (held.value[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)

    return test


def _runs(key: np.ndarray, ident: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, first of its key, shared): distinct rows sorted by key, and whether a key has several ids or comes from a batch where it has."""
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    met = np.flatnonzero(np.append(False, same) | np.append(same, False)) if len(k) else order
    rows = order[met]  # most keys come once: only the others need a sort by id
    order[met] = rows[np.lexsort((~many[rows], ident[rows], key[rows]))]
    k, i = key[order], ident[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
    order = order[new]
    k = key[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    run = np.cumsum(first) - 1
    shared = (np.bincount(run) > 1) | (np.bincount(run, many[order]) > 0) if len(k) else np.empty(0, bool)
    return order, first, shared[run]


def pack_keys(key: np.ndarray, ident: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Blobs of one batch: a row of each key to the key's bucket; rows of shared keys, as they are known, to a negative one."""
    order, first, shared = _runs(key, ident, np.zeros(len(key), bool))
    key, ident = key[order], ident[order]
    one = [x[first] for x in (key, ident, shared)]
    rows = [(b, *(x[r].tobytes() for x in one)) for b, r in _split((one[0] % U64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64))]
    if shared.any():
        rows.append((-1 - int(abs(ident[0]) % buckets), key[shared].tobytes(), ident[shared].tobytes(), b""))
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=["bucket", "key", "id", "many"])


def shared_keys(keys: DataFrame) -> DataFrame:
    """Distinct rows (key, id) of the keys that two ids or more have."""

    def step(table: pa.Table) -> pa.Table:
        key, ident, many = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("key", U64), ("id", np.int64), ("many", bool)))
        if table.column("bucket")[0].as_py() >= 0:
            order, _, shared = _runs(key, ident, many)
            order = order[shared]
            order = order[~many[order]]  # the others went on from their batch
            key, ident = key[order], ident[order]
        if len(many) >= 1 << 18:
            trim()
        return pa.table([pa.array(key.view(np.int64)), pa.array(ident)], names=["key", "id"])

    return keys.groupBy("bucket").applyInArrow(step, "key bigint, id bigint").distinct()


def centres(rows: DataFrame) -> DataFrame:
    """(key, a) of the rows (key, id): the centre of each key."""
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    weight = rows.join(size, "key").groupBy("id").agg(F.sum("n").alias("w"))
    centre = rows.join(weight, "id").groupBy("key").agg(F.max(F.struct("w", F.xxhash64("id").alias("h"), F.col("id").alias("a"))).alias("c"))
    return centre.select("key", F.col("c.a").alias("a"))


def star_pairs(rows: DataFrame, centre: DataFrame) -> DataFrame:
    """Distinct candidate pairs (a, b) of ids, a the centre of a key that both have."""
    return rows.join(centre, "key").select("a", F.col("id").alias("b")).filter("a != b").distinct()


def classes(keys: DataFrame, texts: Callable[[DataFrame], DataFrame], similar: Callable[[list, list], list], units: Callable[[list], tuple], least: float, need: Callable, bins: int = 512) -> DataFrame:
    """(node, label) of the digests that are linked with others; ``keys`` are blobs of :func:`pack_keys`.

    ``texts(ids)`` gives (id, digest, text) of the ids asked for, each text once; ``similar`` judges two
    lists of texts pairwise; ``units`` gives the hashes of the units of a list of texts and the first one of
    each.  Similar texts of n and m distinct units share ``need(n, m)`` or more, which is ``least`` of the larger number at least.
    """
    rows = materialize(shared_keys(keys), "shared-keys")
    centre = materialize(centres(rows), "centres")
    known = materialize(texts(rows.select("id").distinct()), "pair-texts")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, tx, y, ty = batch.columns
            ok: list[bool] = []
            for s in range(0, batch.num_rows, 256):
                ok += similar(tx.slice(s, 256).to_pylist(), ty.slice(s, 256).to_pylist())
            yield pa.RecordBatch.from_arrays([x, y, pa.array(ok, pa.bool_())], names=["x", "y", "ok"])
        trim()

    def check(met: DataFrame) -> DataFrame:
        return materialize(met.select("x", "tx", "y", "ty").mapInArrow(judge, "x binary, y binary, ok boolean"), "checked")

    def side(node: str, by: str) -> DataFrame:
        return known.select(*([F.col("id").alias(by)] if by != node else []), F.col("digest").alias(node), F.col("text").alias(f"t{node}"))

    pairs = materialize(star_pairs(rows, centre), "pairs")
    checked = check(pairs.join(side("x", "a"), "a").join(side("y", "b"), "b").filter("x != y"))
    labels = components(checked.filter("ok").select("x", "y"))
    tried = [checked]

    # texts of keys whose members, without the centre that all were compared with, are in several classes
    place = _label(known.select("id", F.col("digest").alias("x")), labels)
    members = rows.join(centre, "key").filter("id != a").join(place, "id")
    several = members.groupBy("key").agg(F.min("l").alias("lo"), F.max("l").alias("hi"), F.count(F.lit(1)).alias("c")).filter("lo != hi")
    open_rows = members.join(several.select("key", (F.col("c") > DIRECT).alias("large")), "key")
    apart = materialize(open_rows.groupBy("x").agg(F.collect_list(F.when(~F.col("large"), F.col("key"))).alias("direct"), F.bool_or("large").alias("large")), "apart")
    release(pairs)
    if not apart.isEmpty():
        rare = rarest(known.join(apart.withColumnRenamed("x", "digest"), "digest"), units, least, bins)
        centres_each, open_keys, turn = CENTRES, None, 0
        while True:
            turn += 1
            found = close_pairs(_label(rare, labels), open_keys, least, need, bins, centres_each, turn)
            pairs = _ordered(found.filter("key is null")).distinct()
            for t in tried:
                pairs = pairs.join(_ordered(t), ["x", "y"], "left_anti")
            checked = check(materialize(pairs, "pairs").join(side("x", "x"), "x").join(side("y", "y"), "y"))
            tried.append(checked)
            good = checked.filter("ok")
            if not good.isEmpty():
                labels = _merged(labels, _with_labels(good, labels))
            open_keys = found.filter("key is not null").select("key").distinct()
            if open_keys.isEmpty():
                break
            centres_each *= 16
        release(rare)
    release(rows, centre, known, apart, *tried)
    return labels


RARE = "x binary, n int, over int, bins binary, keys array<bigint>"


def rarest(known: DataFrame, units: Callable[[list], tuple], least: float, bins: int) -> DataFrame:
    """A row a text x: its keys, and a profile of all its n different units.

    The keys are those it comes with (``direct``) and, where ``large``, the rarest of its units, so many that similar texts share one.
    Of n units a similar text has ``least * n`` or more, so not all of the first
    n - ceil(least * n) + 1 can be missing; that holds for any order that is the same for all texts.
    The profile counts units in ``bins`` bins, up to 255 each; ``over`` is what goes beyond that.
    """

    def hashes(texts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for s in range(0, len(texts), 256):
            h, off = units(texts[s : s + 256])
            owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            yield s, h[new], owner[new]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, h, _ in hashes(batch.column(0).to_pylist()):
                total += np.bincount((h % U64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        for s in range(0, len(at), 1 << 14):
            part = at[s : s + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["at", "c"])

        trim()

    counts = known.filter("large").select("text").mapInArrow(count, "at bigint, c bigint").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    common = np.zeros(COUNTERS, np.int64)
    common[counts.column("at").to_numpy()] = counts.column("c").to_numpy()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, texts, direct = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            large = batch.column(3).to_numpy(zero_copy_only=False)
            for s, h, owner in hashes(texts):
                size = min(256, len(texts) - s)
                n = np.bincount(owner, minlength=size)
                cell = owner * bins + (h >> U64(40)).astype(np.int64) % bins
                profile = np.bincount(cell, minlength=size * bins).reshape(size, bins)
                order = np.lexsort((h, common[(h % U64(COUNTERS)).astype(np.int64)], owner))
                h, owner = h[order], owner[order]
                rank = np.arange(len(h)) - (np.cumsum(n) - n)[owner]
                taken = large[s + owner] & (rank <= n[owner] - np.ceil(least * n[owner] - 1e-9))
                own = direct.slice(s, size)
                holder = np.append(owner[taken], np.repeat(np.arange(size), own.value_lengths().to_numpy()))
                key = np.append(h[taken].view(np.int64), own.flatten().to_numpy())[np.argsort(holder, kind="stable")]
                key = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(holder, minlength=size))), pa.int32()), pa.array(key))
                held = np.minimum(profile, 255)
                over = (profile - held).sum(1)
                held = [x.tobytes() for x in held.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([digests.slice(s, size), pa.array(n.astype(np.int32)), pa.array(over.astype(np.int32)), pa.array(held, pa.binary()), key], names=["x", "n", "over", "bins", "keys"])

        trim()

    return materialize(known.select("digest", "text", "direct", "large").mapInArrow(pick, RARE), "rarest")


FOUND = "x binary, y binary, key bigint"


def close_pairs(placed: DataFrame, open_keys: DataFrame | None, least: float, need: Callable, bins: int, centres_each: int, turn: int) -> DataFrame:
    """Pairs (x, y) of different classes that share a key and whose profiles leave room for a similarity; a key alone is not done yet.

    A pair is given under the least key that both have. A key's members are compared in blocks of ``BLOCK``, a task a pair of blocks, by what their profiles can have in
    common at most: an exact bound, so no similar pair is missing.  Where that leaves more pairs than
    ``centres_each`` for each member, only those of so many members are given, drawn anew each turn; once they have joined classes, the key comes again.
    """
    rows = placed.select("x", "l", F.explode("keys").alias("key"))
    if open_keys is not None:
        rows = rows.join(open_keys, "key", "left_semi")
    mixed = rows.groupBy("key").agg(F.min("l").alias("lo"), F.max("l").alias("hi"), F.count(F.lit(1)).alias("c")).filter("lo != hi").select("key", "c")
    # the keys that a text goes on with are few: they come back to it before its profile is sent to each of them
    live = rows.join(mixed, "key").groupBy("x").agg(F.sort_array(F.collect_list(F.struct("key", "c"))).alias("live"))
    rows = placed.join(live, "x").select("x", "l", "n", "over", "bins", "live", F.posexplode("live").alias("_at", "_k"))
    rows = rows.select("x", "l", "n", "over", "bins", F.expr("slice(live.key, 1, _at)").alias("lesser"), "_k.key", "_k.c")
    rows = rows.withColumn("_blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    rows = rows.withColumn("_mine", F.when(F.col("_blocks") > 1, F.pmod(F.xxhash64("x", "key"), F.col("_blocks")).cast("int")).otherwise(0))
    # a block meets itself and each other one: with block m the pairs (i, m) and (m, j) for all others
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumns({"_i": F.least("_mine", "_other"), "_j": F.greatest("_mine", "_other")}).drop("_other", "_blocks", "c")
    groups = 4 * int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_g", F.pmod(F.xxhash64("key", "_i", "_j"), F.lit(groups)))

    def compare(table: pa.Table) -> pa.Table:
        key, i, j, mine, n, over = (table.column(c).to_numpy() for c in ("key", "_i", "_j", "_mine", "n", "over"))
        x = table.column("x").combine_chunks()
        label = table.column("l").combine_chunks().dictionary_encode().indices.to_numpy()
        profile = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(len(key), bins)
        lists, sets = table.column("lesser").combine_chunks(), {}

        def here(at: int, other: int) -> bool:
            """Whether no lesser key than this one holds both: a pair is given under the least."""
            for v in (at, other):
                if v not in sets:
                    sets[v] = set(lists[v].as_py())
            return sets[at].isdisjoint(sets[other])

        drawn = np.array([hash((turn, v)) for v in x.to_pylist()]) if len(key) > centres_each else key
        order = np.lexsort((mine, j, i, key))
        k, a, b = key[order], i[order], j[order]
        left, right, unfinished = [], [], []
        for s, z in _cuts((k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]), len(k)):
            at = order[s:z]
            whole = a[s] == b[s]
            first, other = [], []
            for p in range(z - s - 1):
                me = at[p]
                rest = at[p + 1 :]
                if not whole:
                    if mine[me] != a[s]:
                        break
                    rest = rest[mine[rest] == b[s]]
                low, high = np.minimum(n[me], n[rest]), np.maximum(n[me], n[rest])
                rest = rest[(label[rest] != label[me]) & (low >= least * high - 1e-9)]
                if len(rest):
                    room = np.minimum(profile[me], profile[rest]).sum(1, dtype=np.int64) + np.minimum(over[me], over[rest])
                    rest = rest[room >= need(n[me], n[rest])]
                    rest = rest[[here(me, v) for v in rest.tolist()]] if len(rest) else rest
                    first.append(np.full(len(rest), me))
                    other.append(rest)
            if not first:
                continue
            f, o = np.concatenate(first), np.concatenate(other)
            if len(f) > centres_each * (z - s):
                unfinished.append(int(k[s]))
                ones = at[np.argsort(drawn[at], kind="stable")[:centres_each]]
                go = np.isin(f, ones) | np.isin(o, ones)
                f, o = f[go], o[go]
            left.append(f)
            right.append(o)
        f, o = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (left, right))
        pair = pa.table([x.take(pa.array(f)), x.take(pa.array(o)), pa.nulls(len(f), pa.int64())], names=["x", "y", "key"])
        m = len(unfinished)
        return pa.concat_tables([pair, pa.table([pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(unfinished, pa.int64())], names=["x", "y", "key"])])

    return materialize(rows.groupBy("_g").applyInArrow(compare, FOUND), "close-pairs")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs (x, y) with the lesser digest first."""
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _label(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the label l of x; a digest without one is its own."""
    return nodes.join(labels.select(F.col("node").alias("x"), F.col("label").alias("l")), "x", "left").withColumn("l", F.coalesce("l", "x"))


def _with_labels(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds the labels lx and ly of x and y; a digest without one is its own."""
    for c in "xy":
        links = links.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")), c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}", c))
    return links


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links between classes: components of the classes alone, then each node's class looked up."""
    joined = components(links.select(F.col("lx").alias("x"), F.col("ly").alias("y")))
    by_label = joined.select(F.col("node").alias("label"), F.col("label").alias("to"))
    moved = labels.join(by_label, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = joined.join(labels.select("node"), "node", "left_anti")
    out = materialize(moved.unionByName(fresh), "labels")
    release(labels)
    return out


#: Edges that a task joins in memory at a time.
RUN_EDGES = 1 << 17


def _local_roots(x: list, y: list) -> tuple[list, list]:
    """Each node of the edges and the least node that it is joined with by them."""
    parent: dict = {}

    def find(n):
        top = n
        while parent[top] != top:
            top = parent[top]
        while parent[n] != top:
            parent[n], n = top, parent[n]
        return top

    for a, b in zip(x, y, strict=True):
        a, b = find(parent.setdefault(a, a)), find(parent.setdefault(b, b))
        if a != b:
            parent[max(a, b)] = min(a, b)
    return list(parent), [find(n) for n in parent]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    x, y = [], []

    def joined() -> pa.RecordBatch:
        nodes, roots = _local_roots(x, y)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(roots, pa.binary())], names=["node", "root"])

    for batch in batches:
        x += batch.column(0).to_pylist()
        y += batch.column(1).to_pylist()
        if len(x) >= RUN_EDGES:
            yield joined()
            x, y = [], []
    if x:
        yield joined()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (x, y); label is the least node of its component.

    Union-find by levels: a task joins the edges it reads, ``RUN_EDGES`` at a time, and gives each node its root
    there.  A node with several roots joins them: the edges of the next level lie between roots alone, and the
    greatest node of a neighbourhood is never a root, so levels shrink fast.  Labels are then looked up from the last level back.
    """
    levels: list[DataFrame] = []
    now = edges.select("x", "y").filter("x != y")
    while True:
        # a task has few roots for a node, so a node meets as many roots as there are tasks, at most
        roots = now.mapInArrow(_contract, "node binary, root binary")
        least = F.min("root").over(Window.partitionBy("node"))
        levels.append(materialize(roots.select("node", "root", least.alias("label")), "roots"))
        now = levels[-1].filter("root != label").select(F.col("root").alias("x"), F.col("label").alias("y"))
        if now.isEmpty():
            break
    own = lambda level: level.filter("root = label").select("node", "label").distinct()
    labels = own(levels[-1])
    for level in reversed(levels[:-1]):
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = own(level).join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    out = materialize(labels, "component-labels")
    release(*levels)
    return out
