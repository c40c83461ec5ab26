"""Rules with golden numbers, replay, files, streams and the runner."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F
from slotframe.functions import codecs, ints
from slotframe.operators import aggregates, state, windows
from slotframe.operators.analyses import program_invocations
from slotframe.operators.scalars import pack_status, unpack_status
from slotframe.operators.txmeta import tx_meta
from slotframe.plans import fixtures as fx
from slotframe.plans.engine import Analysis, Engine, file_streams, fixture_streams
from slotframe.sources import formats, nodes, states
from slotframe.streaming import live

MESSAGE = (
    "slot bigint, tx_idx bigint, num_signatures int, required int, ro_signed int, ro_unsigned int, is_legacy boolean, "
    "config struct<priority_fee:bigint,compute_unit_limit:bigint,loaded_limit:bigint,heap_size:bigint>, fee bigint, consumed bigint, is_success boolean, "
    "static_keys array<string>, loaded_writable array<string>, loaded_readonly array<string>, instructions array<struct<program_index:int,accounts:array<int>,data:binary>>"
)


def limit(n, tail=b""):
    return b"\x02" + struct.pack("<I", n) + tail


def price(n):
    return b"\x03" + struct.pack("<Q", n)


def message(idx, ix, keys=("payer", "compute_budget"), sigs=1, ro=1, legacy=True, config=None, fee=5000, consumed=None, ok=True, lw=(), lr=(), required=None):
    return (1, idx, sigs, sigs if required is None else required, 0, ro, legacy, config, fee, consumed, ok, list(keys), list(lw), list(lr), [(p, [], d) for p, d in ix])


GOLDEN = [
    (message(0, [(1, limit(300, b"\0" * 64)), (1, price(416_666_666))], fee=130_000, consumed=300), dict(scheduler_cost_units=17_723, scheduler_priority=7_193_635, cu=300, prio_fee=125_000, num_ixs=2, num_ixs_builtin=2, cu_limit=300, cu_price=416_666_666)),
    (message(1, [(1, limit(100_000)), (1, price(1_000_000)), (2, b"abc")], keys=("payer", "compute_budget", "program", "w"), ro=2), dict(scheduler_cost_units=117_708, scheduler_priority=102_500 * 10**6 // 117_709, num_ixs=3, num_ixs_builtin=2)),
    (message(2, [(1, price(1_000_000))]), dict(scheduler_cost_units=20_406, scheduler_priority=269_515, cu_limit=None)),
    (message(3, [(1, limit(1)), (1, limit(2))]), dict(scheduler_cost_units=None, scheduler_priority=None, cu_limit=2)),
    (message(4, [(1, b"")], keys=("payer", "vote"), fee=99_999, consumed=999_999, ok=False), dict(scheduler_cost_units=217_404, scheduler_priority=2_500 * 10**6 // 217_405, txn_fee=5_000, prio_fee=0, num_ixs=1, num_ixs_builtin=1, is_vote=True, cu_limit=None, is_success=False, cu=999_999)),
    (message(5, [(1, b"")], keys=("payer", "program"), legacy=False, config=(100_000, 100_000, 65_536, None), fee=105_000), dict(scheduler_cost_units=101_036, scheduler_priority=102_500 * 10**6 // 101_037, cu_price=None, prio_fee=100_000, tx_version=1, cu_limit=100_000)),
    (message(6, [(1, bytes.fromhex("02400d0300")), (1, price(42)), (2, b""), (3, b"")], keys=("a", "compute_budget", "system", "program"), sigs=2, ro=2, fee=15_123), dict(cu_limit=200_000, cu_price=42, prio_fee=5_123, num_ixs=4, num_ixs_builtin=3)),
    (message(7, [(1, b"")], keys=("a", "b", "system", "program"), ro=2, legacy=False, lw=("x", "y"), lr=("p", "q", "r")), dict(num_accounts_rw=4, num_accounts_ro=5, tx_version=0)),
    (message(8, [(1, b"")], keys=("a", "b", "system", "program"), ro=2), dict(num_accounts_rw=2, num_accounts_ro=2, tx_version=-1)),
    (message(9, [(1, limit(5)), (1, b"\x02\x01")]), dict(cu_limit=None, scheduler_cost_units=None)),  # the last one is too short
    (message(10, [(9, b"")]), dict(scheduler_cost_units=None, num_ixs=1, num_ixs_builtin=0)),  # index out of range
    (message(11, [(1, b"\x01" + struct.pack("<I", 40_000))]), dict(scheduler_cost_units=None)),  # heap not in whole KiB
    (message(12, [(1, b"\x04" + struct.pack("<I", 0))]), dict(scheduler_cost_units=None)),
    (message(13, [], required=2), dict(scheduler_cost_units=None, num_ixs=0)),
    (message(14, [(1, b"\x02"), (1, b"")], keys=("payer", "ed25519")), dict(scheduler_cost_units=720 + 2 * 2400 + 300 + 0 + 2 * 3000 + 16384)),
]


def test_transaction_metadata(spark):
    rows = {r.tx_idx: r for r in tx_meta(spark.createDataFrame([m for m, _ in GOLDEN], MESSAGE)).collect()}
    for i, (_, want) in enumerate(GOLDEN):
        assert {k: rows[i][k] for k in want} == want, i


def test_clamps(spark):
    df = spark.createDataFrame([(None,), (-100,), (1 << 32,), (1_700_000_000,)], "t bigint")
    assert [r[0] for r in df.select(ints.clamp_time("t")).collect()] == [0, 0, (1 << 32) - 1, 1_700_000_000]
    df = spark.createDataFrame([((1 << 32) + 5,)], "t bigint")
    r = df.select(ints.wrap32("t"), ints.saturate32("t"), ints.clamp_slot("t"), ints.wrap16("t"), ints.saturate16("t")).first()
    assert tuple(r) == (5, (1 << 32) - 1, (1 << 32) - 1, 5, 65535)


def test_status_words_round_trip(spark):
    df = spark.range(39).crossJoin(spark.range(256).withColumnRenamed("id", "ix"))
    w = df.select("id", "ix", pack_status(F.col("id"), F.col("ix")).alias("w"))
    a, b = unpack_status(F.col("w"))
    assert w.filter((a != F.col("id")) | (b != F.col("ix"))).count() == 0


def test_units_wrap_and_are_shared(spark):
    ix = spark.createDataFrame([(1, 0, 7), (1, 0, 7), (1, 0, 8)], "slot bigint, tx_idx bigint, program_id bigint")
    tx = spark.createDataFrame([(1, 0, True, False, (1 << 32) + 10, 3)], "slot bigint, tx_idx bigint, errored boolean, is_vote boolean, cu bigint, n_ix bigint")
    blocks = spark.createDataFrame([(1, -5)], "slot bigint, block_time bigint")
    got = {r.program_id: r for r in program_invocations(ix, tx, blocks).collect()}
    assert (got[7]["count"], got[7].error_count, got[7].total_cus, got[7].min_cus, got[7].timestamp) == (2, 2, 6, 3, 0)


def test_skipped_slots_at_edges(spark):
    """None before an epoch's first block, none behind the last one."""
    b = spark.createDataFrame([(s,) for s in (2, 5, 9, 13)], "slot bigint")
    assert sorted(r.slot for r in windows.skipped_slots(b, 10).collect()) == [3, 4, 6, 7, 8]


def test_previous_across_buckets(spark):
    from slotframe.operators import ordered

    rows = [(s, s * 10) for s in random.Random(1).sample(range(1000), 120)]
    df = spark.createDataFrame(rows, "slot bigint, v bigint").repartition(5)
    rows.sort()
    got = ordered.with_running(ordered.with_previous(df, "slot", ["v"], size=64), "slot", "v", "total", size=64).orderBy("slot").collect()
    total = 0
    for (s, v), g, p in zip(rows, got, [(None, None), *rows], strict=False):
        total += v
        assert (g.slot, g.prev_v, g.total) == (s, p[1], total)
    marked = ordered.with_last_present(df, "slot", F.col("v") % 30 == 0, "p", size=64)
    marked = ordered.with_last_present(marked, "slot", F.col("v") % 30 == 0, "n", forward=True, size=64).collect()
    there = [s for s, v in rows if v % 30 == 0]
    for g in marked:
        assert g.p == max((s for s in there if s <= g.slot), default=None)
        assert g.n == min((s for s in there if s >= g.slot), default=None)


def test_conflict_rounds():
    one = [1] * 3
    assert windows.conflict_rounds(one, [["a"], ["a"], ["a"]], [[], [], []]) == [0, 1, 2]
    assert windows.conflict_rounds(one, [["a"], [], []], [[], ["a"], ["a"]]) == [0, 1, 1]
    assert windows.conflict_rounds(one, [["a"], ["b"], ["c"]], [[], [], []]) == [0, 0, 0]
    assert windows.conflict_rounds([1, 2, 2], [["a"], ["a"], []], [[], [], ["a"]]) == [0, 0, 1]
    assert windows.conflict_rounds(one, [[], [], ["a"]], [["a"], ["a"], []]) == [0, 0, 1]


def test_coverage_holes(spark):
    spans = spark.createDataFrame([(0, 10), (2, 4), (12, 20), (15, 18), (25, 25)], "start bigint, stop bigint")
    assert sorted(tuple(r) for r in aggregates.coverage_holes(spans).collect()) == [(10, 12), (20, 25)]


# -- replay: the same rows again, in any order, in any parts


def test_merge_is_idempotent(spark, sf, tmp_path):
    u = fx.updates(spark, sf)
    once = sorted(map(tuple, state.merge_latest(u, ["pubkey"], ["write_version"]).collect()))
    assert sorted(map(tuple, state.merge_latest(u.unionByName(u).orderBy(F.rand(1)), ["pubkey"], ["write_version"]).collect())) == once
    path = f"file://{tmp_path}/t"
    for part in (u.filter("write_version % 2 = 0"), u, u.filter("write_version % 3 = 0")):
        formats.upsert(part, path, ["pubkey"], ["write_version"])
    assert sorted(map(tuple, formats.read_upserted(spark, path).select(*u.columns).collect())) == once
    assert len(os.listdir(tmp_path / "t" / "data")) <= 2  # what the last two manifests name


def test_merge_leaves_other_buckets(spark, tmp_path):
    """A merge writes only the runs of slots that get rows; a reader has all of them."""
    path = f"file://{tmp_path}/t"
    rows = lambda *x: spark.createDataFrame(list(x), "slot bigint, n bigint")
    formats.upsert(rows((1, 1), (5000, 1)), path, ["slot"], ["n"])
    _, before = formats._manifest(spark, path)
    formats.upsert(rows((1, 3), (2, 1)), path, ["slot"], ["n"])
    _, after = formats._manifest(spark, path)
    assert before["1"] == after["1"] and before["0"] != after["0"]
    formats.upsert(rows((1, 2)), path, ["slot"], ["n"])
    assert sorted(map(tuple, formats.read_upserted(spark, path).collect())) == [(1, 3), (2, 1), (5000, 1)]
    with pytest.raises(FileNotFoundError):
        formats.read_upserted(spark, f"file://{tmp_path}/none")


def test_state_keeps_absent_and_zero(spark):
    cp = spark.createDataFrame([(1, 50), (2, None), (3, 70)], "pubkey bigint, lamports bigint")
    up = spark.createDataFrame([(1, 4, 9, 0), (1, 8, 10, 5), (4, 1, 1, 1)], "pubkey bigint, slot bigint, write_version bigint, lamports bigint")
    got = {r.pubkey: (r.lamports, r.present) for r in state.state_at(cp, up, 5).collect()}
    assert got == {1: (0, True), 2: (None, False), 3: (70, True)}


# -- files


def test_nodes(spark, tmp_path):
    """A header is skipped, nodes up to a block are its slot's, a tail has none; a cut file is an error."""
    made = [[0, b"tx", 1], [1, 2, [b"a", None]], [2, 7, True, {"k": -3}], [6, 1 << 40, b""]]
    raw = nodes.write_header([b"root"]) + b"".join(formats.write_node(bytes([1, i]) * 18, n) for i, n in enumerate(made))
    (tmp_path / "a.car").write_bytes(raw)
    df = nodes.read_stream(spark, "nodes", f"{tmp_path}/a.car")
    got = df.orderBy("offset").collect()
    assert [(r.kind, r.slot) for r in got] == [(0, 7), (1, 7), (2, 7), (6, None)]
    assert [formats.cbor_decode(r.body)[0] for r in got] == made
    for cut in (len(raw) - 1, len(raw) - 40, 60):
        (tmp_path / "b.car").write_bytes(raw[:cut])
        with nodes.open_file(f"{tmp_path}/b.car") as f, pytest.raises(ValueError):
            list(nodes.read_nodes(f, nodes.header_end(f, cut), cut))


@pytest.mark.parametrize("run", (1 << 26, 2))
def test_groups_end_with_a_block(spark, run):
    df = spark.createDataFrame([("f", i, k) for i, k in enumerate((0, 1, 2, 0, 2, 6))] + [("g", 0, 2)], "file string, offset bigint, kind int")
    got = formats.group_until_block(df, run=run).orderBy("file", "offset").collect()
    assert [(r.group, r.closed) for r in got] == [(0, True)] * 3 + [(1, True)] * 2 + [(2, False), (0, True)]


def _archive(tmp_path, slots):
    data, index = bytearray(nodes.write_header([])), []
    for slot in range(10):
        part = nodes.slot_sections(slot, slot - 1, 100 + slot, [(i, nodes.frame(b"p%d" % i), nodes.frame(b"")) for i in range(slot % 3)]) if slot in slots else b""
        index.append((len(data), len(part)) if part else (0, 0))
        data += part
    (tmp_path / "e.car").write_bytes(bytes(data))
    (tmp_path / "e.idx").write_bytes(formats.write_slot_index(index))
    return {"path": f"{tmp_path}/e.car", "index": f"{tmp_path}/e.idx", "first_slot": 0}


def test_archive_ranges(spark, tmp_path):
    """Slots of a range, skipped ones left out, from many tasks; an index that promises more than the file holds is an error."""
    at = _archive(tmp_path, {0, 2, 3, 5, 8})
    df = nodes.read_blocks(spark, **at, start=1, end=8, split_bytes=1)
    assert df.rdd.getNumPartitions() == 3
    assert [(r.slot, r.block_time, r.transactions) for r in df.orderBy("slot").collect()] == [(2, 102, 2), (3, 103, 0), (5, 105, 2)]
    assert nodes.read_blocks(spark, **at, start=6, end=8).count() == 0
    tx = nodes.read_transactions(spark, **at).orderBy("slot", "tx_idx").collect()
    assert [(r.slot, r.tx_idx, bytes(r.payload)) for r in tx] == [(2, 0, b"p0"), (2, 1, b"p1"), (5, 0, b"p0"), (5, 1, b"p1"), (8, 0, b"p0"), (8, 1, b"p1")]
    assert [r.tx_count for r in nodes.read_entries(spark, **at).collect()] == [2, 2, 2]
    whole = (tmp_path / "e.car").read_bytes()
    last = formats.slot_index(spark.read.format("binaryFile").load(at["index"])).filter("slot = 8").first()
    (tmp_path / "e.car").write_bytes(whole[: last.offset])
    with pytest.raises(Exception, match="the index goes on to 8"):
        nodes.read_blocks(spark, **at).collect()
    with pytest.raises(Exception, match="give one"):
        nodes.read_blocks(spark, at["path"], start=1).collect()


def test_frames_are_reassembled():
    payload = bytes(range(250))
    first, rest = nodes.frames(payload, 60, codecs.crc64_iso(payload))
    known = {}
    for x in rest:
        body = formats.cbor_encode(x)
        known[nodes.content_id(body)] = nodes.Node(0, nodes.content_id(body), x, body)
    assert nodes.reassembled(first, known) == (payload, True)
    first[1] += 1
    assert nodes.reassembled(first, known) == (payload, False)
    with pytest.raises(ValueError):
        nodes.reassembled(first, {})


def test_statuses():
    """Nothing, plain, compressed, and the older format, which only early epochs may have."""
    import zstandard

    plain = bytes.fromhex("0a00" "10ac02" "6202aabb" "6a01cc" "8001b817")
    want = {"is_success": False, "fee": 300, "loaded_writable": [b"\xaa\xbb"], "loaded_readonly": [b"\xcc"], "consumed": 3000}
    assert nodes.decode_status(plain, 200) == nodes.decode_status(zstandard.ZstdCompressor().compress(plain), 3) == want
    assert nodes.decode_status(None, 1)["is_success"] and nodes.decode_status(b"", 1)["fee"] == 0
    older = struct.pack("<IQQQQQQ", 0, 5000, 2, 1, 2, 2, 9)
    assert nodes.decode_status(older, 156)["fee"] == 5000
    with pytest.raises(ValueError):
        nodes.decode_status(older, 157)


def test_messages():
    head = bytes([1]) + bytes(64)
    body = bytes([1, 0, 1, 2]) + b"a" * 32 + b"b" * 32 + b"h" * 32 + bytes([1, 1, 2, 0, 1, 3]) + b"xyz"
    m = nodes.parse_message(head + body)
    assert (m["is_legacy"], m["required"], m["ro_unsigned"], m["instructions"]) == (True, 1, 1, [(1, [0, 1], b"xyz")])
    v0 = nodes.parse_message(head + b"\x80" + body + bytes([1]) + b"t" * 32 + bytes([1, 4, 0]))
    assert not v0["is_legacy"] and v0["lookups"] == [(b"t" * 32, [4], [])]
    for bad in (head + body[:-1], head + body + b"z", head + b"\x81" + body):
        with pytest.raises((ValueError, IndexError)):
            nodes.parse_message(bad)


def test_state_archive_is_checked(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "pubkey bigint, write_version bigint, slot bigint, lamports bigint")
    keys = spark.createDataFrame([(1,), (2,)], "pubkey bigint")

    def made(name, checkpoint, updates, slot=5):
        path = f"file://{tmp_path}/{name}"
        states.write_state_archive(checkpoint, updates, keys, path, slot)
        return states.read_state_archive(spark, path)

    good = made("good", rows((1, 1, 3, 10)), rows((1, 4, 6, 20), (2, 2, 7, 5)))
    assert sorted((r.pubkey, r.lamports) for r in good.state().collect()) == [(1, 20), (2, 5)]
    assert sorted((r.pubkey, r.lamports) for r in good.state(6).collect()) == [(1, 20)]
    assert [r.pubkey for r in good.slots(7, 9).collect()] == [2]
    for name, updates, why in (("a", rows((3, 1, 6, 1)), "list"), ("b", rows((1, 4, 6, 1), (1, 4, 6, 2)), "twice"), ("c", rows((2, 4, 5, 1)), "checkpoint")):
        with pytest.raises(ValueError, match=why):
            made(name, rows((1, 1, 3, 10)), updates)


def test_reassembly(spark):
    from slotframe.functions.codecs import crc64_iso

    whole = bytes(range(200))
    rows = [(1, i, whole[i * 20 : i * 20 + 20], str(crc64_iso(whole))) for i in range(10)] + [(2, 0, b"x", "5"), (3, 0, b"y", None)]
    df = spark.createDataFrame(rows, "root bigint, idx int, data binary, checksum string").repartition(4)
    got = {r.root: (bytes(r.payload), r.ok) for r in formats.reassemble(df).collect()}
    assert got == {1: (whole, True), 2: (b"x", False), 3: (b"y", True)}


def test_slot_index(spark, tmp_path):
    (tmp_path / "i").write_bytes(formats.write_slot_index([(0, 10), (0, 0), (10, 7)]))
    got = formats.slot_index(spark.read.format("binaryFile").load(f"{tmp_path}/i"), 100).orderBy("slot").collect()
    assert [(r.slot, r.offset, r.length, r.present) for r in got] == [(100, 0, 10, True), (101, 0, 0, False), (102, 10, 7, True)]
    (tmp_path / "bad").write_bytes(b"x" * 13)
    with pytest.raises(Exception, match="whole records"):
        formats.slot_index(spark.read.format("binaryFile").load(f"{tmp_path}/bad")).collect()


def test_manifest(spark, tmp_path):
    (tmp_path / "m").write_text('{"version": 1, "accounts": ["b", "a", "b"]}')
    (tmp_path / "c").write_text('{"entries": {"x": {"requiredAccounts": ["z", "a"]}, "y": {"requiredAccounts": ["a"]}, "w": {}}}')
    assert [r.account for r in formats.read_manifest(spark, f"{tmp_path}/m").collect()] == ["a", "b"]
    assert [r.account for r in formats.read_manifest(spark, f"{tmp_path}/c").collect()] == ["a", "z"]
    (tmp_path / "both").write_text('{"accounts": ["a"], "entries": {}}')
    with pytest.raises(ValueError):
        formats.read_manifest(spark, f"{tmp_path}/both")


def test_archive(spark, sf, tmp_path):
    b = fx.blocks(spark, sf)
    formats.write_archive(b, f"{tmp_path}/a", epoch=500)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        formats.write_archive(b, f"{tmp_path}/a", epoch=500)
    got = formats.read_archive(spark, f"{tmp_path}/a", 400, 700, epoch=500)
    assert sorted(r.slot for r in got.collect()) == sorted(r.slot for r in b.filter("slot >= 400 and slot < 700").collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(epoch" in plan and "PushedFilters: [IsNotNull(slot)" in plan
    assert formats.check_archive_order(formats.read_archive(spark, f"{tmp_path}/a")).count() == 0
    formats.export_accounts(spark.createDataFrame([("k", "o", 17, 123), ("d", "o", 1, 0)], "pubkey string, owner string, data_size int, lamports bigint"), f"{tmp_path}/csv")
    assert [tuple(r) for r in spark.read.csv(f"{tmp_path}/csv", header=True).collect()] == [("k", "o", "17", "123")]
    formats.discard(b)


# -- streams


def test_late_transactions_update_a_slot(spark, tmp_path):
    schema = live.EVENT
    base = f"file://{tmp_path}"
    parts = [[(1, "tx", 3, None), (2, "tx", 1, None)], [(1, "block", 0, 77)], [(1, "tx", 2, None), (3, "block", 0, None)]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        live.run_available(live.finalise(stream), lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{base}/out"), f"{base}/state")
    got = state.merge_latest(spark.read.parquet(f"{base}/out"), ["slot"], ["batch"]).collect()
    assert sorted((r.slot, r.txs, r.timestamp) for r in got) == [(1, 5, 77), (3, 0, 0)]
    rest = live.drain(spark.read.schema(schema).parquet(f"{base}/in")).collect()
    assert [(r.slot, r.txs, r.timestamp) for r in rest] == [(2, 1, 0)]


def test_slots_are_finalised_without_a_python_call_each(spark, tmp_path):
    base = f"file://{tmp_path}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    for rows in ([(1, "block", 0, 5), (2, "tx", None, None), (2, "block", 0, -9)], [(1, "block", 0, 1 << 40), (1, "tx", 2, None)]):
        spark.createDataFrame(rows, live.EVENT).coalesce(1).write.mode("append").parquet(f"{base}/in")
        final = live.finalise(spark.readStream.schema(live.EVENT).parquet(f"{base}/in"))
        assert "InPandas" not in final._jdf.queryExecution().analyzed().toString()
        live.run_available(final, lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{base}/out"), f"{base}/state")
    got = spark.read.parquet(f"{base}/out").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 5, 0), (1, 2, (1 << 32) - 1, 1), (2, 0, 0, 0)]
    assert spark.conf.get(provider, None) == before


def test_duplicates_within_the_watermark(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 00:00:09")]
    spark.createDataFrame(rows, "slot bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("slot bigint, ts timestamp").parquet(f"{tmp_path}/in")
    live.run_available(live.deduplicated(stream), lambda df, i: df.write.mode("append").parquet(f"{tmp_path}/out"), f"{tmp_path}/state", "append")
    assert sorted(r.slot for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


# -- runner


def test_engine(spark, sf, tmp_path):
    def broken(streams):
        raise RuntimeError("no")

    streams = fixture_streams(spark, sf)
    e = Engine(spark).with_analysis("program-tracking").with_analysis(Analysis("broken", ("slot",), ("slot",), broken)).with_analysis("pubkey-stats").with_slot_range(0, 600).with_sink(f"file://{tmp_path}")
    out = e.run(streams)
    assert set(out) == {"program-tracking", "pubkey-stats"} and e.failures == {"broken": "no"}
    first = sorted(map(tuple, formats.read_upserted(spark, f"file://{tmp_path}/program-tracking").collect()))
    for lo, hi in ((0, 300), (250, 600)):  # again, in overlapping parts
        Engine(spark).with_analysis("program-tracking").with_slot_range(lo, hi).with_sink(f"file://{tmp_path}").run(streams)
    assert sorted(map(tuple, formats.read_upserted(spark, f"file://{tmp_path}/program-tracking").collect())) == first
    blocks = streams["blocks"].filter("slot < 600").count()
    assert formats.read_upserted(spark, f"file://{tmp_path}/progress").count() == 2 * blocks
    with pytest.raises(ValueError):
        Engine(spark).with_slot_range(5, 5)


def test_epoch_by_epoch(spark, sf, tmp_path):
    """Epochs one after the other, either way round, leave what one run leaves; the other analyses run too."""
    streams, found = fixture_streams(spark, sf), []
    for name in ("forward", "back"):
        e = Engine(spark).with_analysis("account-writes").with_slot_range(10, 3000).with_sink(f"file://{tmp_path}/{name}")
        out = (e.reversed() if name == "back" else e).run_by_epoch(streams, 1000)
        assert not e.failures and e.slots == (10, 3000)
        rows = [tuple(r) for r in out["account-writes"].collect()]
        assert name == "forward" or [r[0] for r in rows] == sorted((r[0] for r in rows), reverse=True)
        found.append(sorted(rows))
    whole = Engine(spark).with_analysis("account-writes").with_analysis("tx-metadata").with_slot_range(10, 3000).run(streams)
    assert found[0] == found[1] == sorted(tuple(r) for r in whole["account-writes"].collect())
    assert whole["tx-metadata"].count() == streams["transactions"].filter("slot >= 10 and slot < 3000").count()
    with pytest.raises(ValueError):
        Engine(spark).with_slot_range(0, 5).run_by_epoch(streams)


def test_analyses_over_archive_files(spark, tmp_path):
    """Blocks, transactions and instructions as archive files hold them go through the runner."""
    head, body = bytes([1]) + bytes(64), bytes([1, 0, 1, 2]) + b"a" * 32 + b"b" * 32 + b"h" * 32
    message = head + body + bytes([2, 1, 1, 0, 0, 1, 1, 0, 0])
    status = bytes.fromhex("10ac02" "8001b817")
    data = nodes.write_header([]) + b"".join(nodes.slot_sections(s, s - 1, 50, [(0, nodes.frame(message), nodes.frame(status))]) for s in (4, 6))
    (tmp_path / "x.car").write_bytes(data)
    streams = file_streams(spark, path=f"{tmp_path}/x.car")
    e = Engine(spark).with_analysis("program-tracking").with_analysis("tx-metadata").with_analysis("pubkey-stats")
    out = e.run(streams)
    assert not e.failures
    got = sorted((r.slot, r.program_id, r["count"], r.total_cus, r.timestamp) for r in out["program-tracking"].collect())
    assert got == [(s, (b"b" * 32).hex().upper(), 2, 3000, 50) for s in (4, 6)]
    assert [(r.slot, r.txn_fee, r.num_ixs, r.num_accounts_rw) for r in out["tx-metadata"].orderBy("slot").collect()] == [(4, 300, 2, 1), (6, 300, 2, 1)]
    assert out["pubkey-stats"].count() == 2


def test_command_line(capsys):
    from slotframe.__main__ import main

    assert main(["--list"]) == 0
    assert "pubkey-stats" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main([])
