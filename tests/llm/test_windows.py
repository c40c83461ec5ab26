import hashlib
import random

import numpy as np
import pytest
from fixtures import prose, table, words
from slotframe.llm import substring, suffix, windows


def brute_words(rows, k):
    """By id: a window counts that also starts in a smaller id; null is the smallest id."""
    key = lambda i: -(1 << 63) if i is None else i
    first = {}
    for i, t, *_ in rows:
        w = words(t)
        for a in range(len(w) - k + 1):
            s = tuple(w[a : a + k])
            first[s] = min(first.get(s, key(i)), key(i))
    out = []
    for i, t, *_ in rows:
        w = words(t)
        gone = set()
        for a in range(len(w) - k + 1):
            if first[tuple(w[a : a + k])] < key(i):
                gone.update(range(a, a + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def brute_bytes(rows, k):
    """Distinct (id, text) in order; among rows of one id the order is by a hash, so tests give those no common text."""
    distinct = sorted({(-(1 << 63) if i is None else i, t or "") for i, t, *_ in rows})
    seen, result = set(), {}
    for i, t in distinct:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - k + 1):
            s = b[a : a + k]
            if s in seen:
                gone[a : a + k] = True
            seen.add(s)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        result[i, t] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((i, *result[-(1 << 63) if i is None else i, t or ""]) for i, t, *_ in rows), key=repr)


def test_words_against_brute_force(docs, rows):
    got = sorted((tuple(r) for r in substring.dedup_substrings(docs, 20).drop("n_spans").collect()), key=repr)
    assert got == brute_words(rows, 20)
    assert any(r[2] for r in got)


def test_bytes_against_brute_force(docs, rows):
    got = sorted((tuple(r) for r in suffix.dedup_suffixes(docs, 60).collect()), key=repr)
    assert got == brute_bytes(rows, 60)
    assert any(r[2] for r in got)


def test_hot_passage(spark):
    rng = random.Random(5)
    passage = prose(rng, 60)
    rows = [(i, f"{prose(rng, 8)} {passage} {prose(rng, 8)}" if i % 2 else prose(rng, 20), "xx", "a") for i in range(200)]
    df = table(spark, rows).repartition(17)
    got = sorted((tuple(r) for r in substring.dedup_substrings(df, 30).drop("n_spans").collect()), key=repr)
    assert got == brute_words(rows, 30)
    got = sorted((tuple(r) for r in suffix.dedup_suffixes(df, 50).collect()), key=repr)
    assert got == brute_bytes(rows, 50)


def test_slices_cut_long_texts(spark, monkeypatch):
    """A text of more than a slice is cut into overlapping ones."""
    monkeypatch.setattr(substring, "SLICE_UNITS", 100)
    monkeypatch.setattr(suffix, "SLICE_UNITS", 300)
    from slotframe.llm.common import Texts
    import pyarrow as pa

    rng = random.Random(1)
    t = Texts.of(pa.array([prose(rng, 900)]))
    for op in (substring.WordWindows(20), suffix.ByteWindows(60)):
        starts = {}
        for first, unit0, s in op.pieces(t):
            grams, ok, owner, begin = op.grams(s)
            h, at, n = windows.minimiser_runs(grams, ok, op.k - op.m + 1)
            for x, a, c in zip(h.tolist(), at.tolist(), n.tolist(), strict=True):
                for j in range(c):
                    assert starts.setdefault(a + j + unit0, x) == x
        units = len(t.data) if isinstance(op, suffix.ByteWindows) else len(words(t.data.tobytes().decode()))
        assert sorted(starts) == list(range(units - op.k + 1))


@pytest.mark.parametrize("piece", (200, 2000, 1 << 19))
def test_pieces_find_the_same(piece, monkeypatch):
    """Windows of many strings dealt out by their hash are compared like all at once."""
    rng = random.Random(4)
    monkeypatch.setattr(windows, "PIECE_BYTES", piece)
    text = prose(rng, 80).split()
    for op in (substring.WordWindows(5), suffix.ByteWindows(20)):
        strings, n, doc = [], [], []
        for i in range(60):
            size = rng.randint(op.k, op.k + 9)
            if isinstance(op, suffix.ByteWindows):
                a = rng.randint(0, 40)
                strings.append(" ".join(text).encode()[a : a + size])
            else:
                a = rng.randint(0, 25)
                strings.append(" ".join(text[a : a + size]).encode())
            n.append(size - op.k + 1)
            doc.append(i // 2)
        n, doc = np.array(n), np.array(doc)
        assert op.earlier_bounded(strings, n, doc).tolist() == op.earlier(strings, n, doc).tolist()
        assert op.earlier(strings, n, doc).any()


def test_ids_that_share_a_factor_spread(spark):
    """Groups follow a hash of id and text, null ids and repeated ids included."""
    rng = random.Random(6)
    rows = [(None if i % 3 == 0 else 64 * (i % 5), prose(rng, 40) if i % 4 else "one two three " * 9, "xx", "a") for i in range(60)]
    got = sorted((tuple(r) for r in suffix.dedup_suffixes(table(spark, rows), 30).collect()), key=repr)
    assert got == brute_bytes(rows, 30)
    got = sorted((tuple(r) for r in substring.dedup_substrings(table(spark, rows), 10).drop("n_spans").collect()), key=repr)
    assert got == brute_words(rows, 10)


def test_empty(empty):
    assert substring.dedup_substrings(empty).collect() == []
    assert suffix.dedup_suffixes(empty).collect() == []


def test_longest_previous_factor():
    rng = random.Random(2)
    for n in (0, 1, 2, 50, 200):
        s = np.array([rng.randint(0, 2) for _ in range(n)], np.int64)
        want = []
        for i in range(n):
            best = 0
            for j in range(i):
                k = 0
                while i + k < n and s[i + k] == s[j + k]:
                    k += 1
                best = max(best, k)
            want.append(best)
        got = suffix.longest_previous_factor(s, 256)
        assert got.tolist() == want


def test_smaller_positions():
    x = np.random.default_rng(0).permutation(100)
    before, after = suffix.smaller_positions(x)
    for i in range(100):
        assert before[i] == max((j for j in range(i) if x[j] < x[i]), default=-1)
        assert after[i] == min((j for j in range(i + 1, 100) if x[j] < x[i]), default=-1)
