import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from fixtures import prose, table, words
from slotframe.llm import lines, links, minhash
from slotframe.llm.common import Texts


def classes(items, pairs):
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    out = defaultdict(set)
    for x in items:
        out[find(x)].add(x)
    return {frozenset(v) for v in out.values()}


def aligned_share(a, b):
    """Longest common subsequence of the words over the words of the longer text, by the plain table."""
    x, y = words(a), words(b)
    if min(len(x), len(y)) < 5:
        return float(a == b)
    row = [0] * (len(y) + 1)
    for p in x:
        new = [0]
        for j, q in enumerate(y):
            new.append(row[j] + 1 if p == q else max(row[j + 1], new[j]))
        row = new
    return row[-1] / max(len(x), len(y))


def near_rows(seed=8):
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        w = prose(rng, 120).split()
        for c in range(rng.randint(1, 5)):
            v = list(w)
            for _ in range(c):
                v[rng.randrange(len(v))] = f"x{rng.random()}"
            rows.append((g * 10 + c, " ".join(v), "xx", "a"))
    rows += [(500 + g, change_words(rng, rows[g][1], 40), "xx", "a") for g in range(8)]  # no near copies any more
    return rows


def test_documents_against_brute_force(spark):
    rows = near_rows()
    got = {r.doc_id: r for r in minhash.near_duplicates(table(spark, rows)).collect()}
    pairs = [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[:i] if a[1] == b[1] or aligned_share(a[1], b[1]) >= 0.8]
    want = classes([r[0] for r in rows], pairs)
    found = defaultdict(set)
    for r in got.values():
        found[r.class_id].add(r.doc_id)
        assert r.class_id <= r.doc_id
    assert {frozenset(v) for v in found.values()} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_drop_keeps_one_row_of_each_class(docs, rows, spark):
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    out = kept.collect()
    by_id = [r.doc_id for r in out]
    assert 100 not in by_id and 101 not in by_id and 102 not in by_id  # copies of 6 and 9
    assert by_id.count(150) == 0 and by_id.count(18) == 1  # 150 repeats 18
    assert by_id.count(21) == 1 and by_id.count(151) == 1  # one of the two texts of 151 is that of 21
    assert sum(not (r.text or "") for r in out) == 1  # null and empty are one class
    texts = [r.text for r in out]
    assert len(texts) == len(set(texts))


def test_repeated_rows_leave_one(spark):
    rng = random.Random(1)
    rows = [(1, prose(rng, 50), "xx", "a")] * 3 + [(2, prose(rng, 50), "xx", "a")]
    assert sorted(r.doc_id for r in minhash.drop_near_duplicates(table(spark, rows)).collect()) == [1, 2]


def test_large_group_of_near_copies(spark):
    """Many distinct near copies of one text are one class, whatever the partitions."""
    rng = random.Random(4)
    w = prose(rng, 150).split()
    rows = []
    for i in range(150):
        v = list(w)
        v[rng.randrange(len(v))] = f"y{i}"
        rows.append((i, " ".join(v), "xx", "a"))
    rows += [(1000 + i, prose(rng, 60), "xx", "a") for i in range(30)]
    got = minhash.near_duplicates(table(spark, rows).repartition(9)).collect()
    assert {r.class_id for r in got if r.doc_id < 1000} == {0}
    assert all(r.class_id == r.doc_id for r in got if r.doc_id >= 1000)


def test_alignment_matches_plain_table():
    rng = random.Random(3)
    for _ in range(60):
        a = [rng.randint(0, 6) for _ in range(rng.randint(1, 40))]
        b = [x for x in a if rng.random() < 0.8] + [rng.randint(0, 6) for _ in range(rng.randint(0, 4))]
        row = [0] * (len(b) + 1)
        for p in a:
            new = [0]
            for j, q in enumerate(b):
                new.append(row[j] + 1 if p == q else max(row[j + 1], new[j]))
            row = new
        assert minhash.banded_common(np.array(a), np.array(b), 50) == row[-1]


def test_similarity_matches_plain_table():
    rng = random.Random(13)
    for _ in range(60):
        a = prose(rng, rng.randint(5, 60))
        w = [x for x in a.split() if rng.random() > 0.08]
        for _ in range(rng.randint(0, 6)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(a.split()))
        b = " ".join(w)
        want = aligned_share(a, b)
        x, y = (minhash.word_sequences([t])[0] for t in (a, b))
        got = minhash.aligned_similarity(x, y, 0.8)
        assert got == (pytest.approx(want) if want >= 0.8 else 0.0)


@pytest.mark.parametrize("share", (0.01, 0.03, 0.05, 0.1))
def test_recall_of_edited_copies(share):
    """Nine in ten pairs with up to a tenth of the words changed share a sketch and are verified."""
    rng = random.Random(17)
    found, total = 0, 120
    for _ in range(total):
        a = prose(rng, 150)
        b = change_words(rng, a, max(1, round(150 * share)))
        h, off = minhash.shingles(Texts.of(pa.array([a, b])), 5)
        k = minhash.order_sketches(minhash.labelled(h, off), off, 16, 2)
        found += bool((k[0] == k[1]).any()) and minhash.similar_texts([a], [b], 0.8)[0]
    assert found >= 0.9 * total


def test_moved_blocks_lower_the_similarity():
    rng = random.Random(6)
    x, y = prose(rng, 60), prose(rng, 60)
    a, b = f"{x} {y}", f"{y} {x}"
    assert minhash.similar_texts([a, a], [b, a], 0.8) == [False, True]


def test_sketch_agrees_on_equal_text_and_sees_order():
    t = Texts.of(pa.array(["a b c d e f g h i j", "a b c d e f g h i j", "", "x y z"]))
    h, off = minhash.shingles(t, 5)
    s = minhash.order_sketches(minhash.labelled(h, off), off, 6, 3)
    assert s.shape == (2, 6) and (s[0] == s[1]).all()


def test_components(spark):
    rng = random.Random(9)
    nodes = [bytes([i]) * 4 for i in range(60)]
    edges = [(rng.choice(nodes[:40]), rng.choice(nodes[:40])) for _ in range(30)] + [(nodes[i], nodes[i + 1]) for i in range(40, 59)]
    got = {bytes(r.node): bytes(r.label) for r in links.components(spark.createDataFrame(edges, "x binary, y binary")).collect()}
    want = classes({n for e in edges if e[0] != e[1] for n in e}, [e for e in edges if e[0] != e[1]])
    for c in want:
        assert {got[n] for n in c} == {min(c)}
    assert len(got) == sum(map(len, want))


def test_empty(empty):
    assert minhash.near_duplicates(empty).collect() == []
    assert minhash.drop_near_duplicates(empty).collect() == []
    assert lines.fuzzy_line_classes(empty).collect() == []


def test_lines_against_brute_force(spark):
    rng = random.Random(12)
    stock = [prose(rng, rng.randint(6, 30)) for _ in range(40)] + ["tiny", "ab", "tinx"]
    rows = []
    for i in range(40):
        out = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(stock)
            if rng.random() < 0.3 and len(s) > 20:
                p = rng.randrange(len(s))
                s = s[:p] + "#" + s[p + 1 :]
            out.append(rng.choice(("", " ")) + s)
        rows.append((i, "\n".join(out), "xx", "a"))
    rows += [(90, None, "xx", "a"), (91, "\n\n \n", "xx", "a"), (None, stock[0], "xx", "a")]
    place = {}
    for i, t, *_ in rows:
        for n, s in lines.split_lines(t):
            place.setdefault(s, []).append((i is None, i, n))
    known = list(place)
    pairs = [(a, b) for i, a in enumerate(known) for b in known[:i] if lines.jaccard(lines.shingle_set(a, 8), lines.shingle_set(b, 8)) >= 0.8]
    want = {}
    for c in classes(known, pairs):
        first = min((p for s in c for p in place[s]), key=lambda p: (p[0], p[1] or 0, p[2]))
        for s in c:
            for p in place[s]:
                want[p[1:]] = first[1:]
    got = lines.fuzzy_line_classes(table(spark, rows)).collect()
    assert {(r.doc_id, r.line_no): (r.class_doc, r.class_line) for r in got} == want
    assert all(r.kept == ((r.doc_id, r.line_no) == (r.class_doc, r.class_line)) for r in got)
    assert any(a != b for a, b in pairs)


@pytest.mark.parametrize("length", (12, 40, 200, 900))
def test_line_recall_at_the_threshold(length):
    """Lines of similarity 0.8 to 0.9 nearly always share a band."""
    rng = random.Random(length)
    found = total = 0
    for _ in range(400):
        a = prose(rng, 400)[:length]
        p = sorted(rng.sample(range(length), max(1, length // 90)))
        b = "".join("#" if i in p else c for i, c in enumerate(a))
        if 0.8 <= lines.jaccard(lines.shingle_set(a, 8), lines.shingle_set(b, 8)) < 0.9:
            k = lines.band_keys(lines.signatures([a, b], 8, 70), 5)
            total += 1
            found += bool((k[0] == k[1]).any())
    assert found >= 0.97 * total


def mutation_tree(rng, n, edit, first):
    out = [first]
    while len(out) < n:
        out.append(edit(rng.choice(out)))
    return out


def change_words(rng, text, most):
    w = text.split()
    for p in rng.sample(range(len(w)), most):
        w[p] = f"x{rng.random()}"
    return " ".join(w)


def change_character(rng, line):
    p = rng.randrange(len(line))
    return line[:p] + rng.choice("0123456789") + line[p + 1 :]


def meeting_classes(items, keys, similar):
    """Classes by brute force over all pairs that share a key."""
    pairs = [(i, j) for i in range(len(items)) for j in range(i) if (keys[i] == keys[j]).any() and similar(items[i], items[j])]
    return {frozenset(c) for c in classes(range(len(items)), pairs)}


def document_classes(spark, texts):
    t = Texts.of(pa.array(texts))
    h, off = minhash.shingles(t, 5)
    keys = minhash.order_sketches(minhash.labelled(h, off), off, 16, 2)
    want = meeting_classes(texts, keys, lambda a, b: minhash.similar_texts([a], [b], 0.8)[0])
    found = defaultdict(set)
    for r in minhash.near_duplicates(table(spark, [(i, x, "xx", "a") for i, x in enumerate(texts)])).collect():
        found[r.class_id].add(r.doc_id)
    return {frozenset(c) for c in found.values()}, want


def coarser(found, want):
    """Each class by brute force lies in one found class."""
    return all(any(w <= f for f in found) for w in want)


def test_documents_of_a_mutation_tree(spark):
    """Copies of copies are one class although most are far from any one centre."""
    rng = random.Random(21)
    texts = mutation_tree(rng, 300, lambda x: change_words(rng, x, 8), prose(rng, 150))
    found, want = document_classes(spark, texts)
    assert len(want) < 4
    assert coarser(found, want)


@pytest.mark.parametrize("width", [1, 3, 8, 13])
def test_line_similarity_in_packed_shingles(width):
    """Short lines, lines with NUL, and alphabets of several scripts, which have no room in 64 bits."""
    rng = random.Random(width)
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 600)))
    for _ in range(60):
        left = ["".join(rng.choices(rng.choice(["ab", "ab\0", "abcdefgh é\U0001f600", wide]), k=rng.randrange(1, 40))) for _ in range(rng.randrange(1, 20))]
        right = [rng.choice([x, x[: rng.randrange(1, len(x) + 1)], x + "\0", x + "a", rng.choice(left)]) for x in left]
        want = [lines.jaccard(lines.shingle_set(a, width), lines.shingle_set(b, width)) >= 0.8 for a, b in zip(left, right, strict=True)]
        assert lines.similar_lines(left, right, width, 0.8) == want
    assert lines.similar_lines(["abc"], ["abc" + "\0" * 10], 13, 0.8) == [False]
    assert [len(x) for x in lines.packed_shingles(["abababab", "ab", "abc"], 3)] == [2, 1, 1]
    assert [x is None for x in lines.packed_shingles(["abcabc" * 9, wide, "cab" * 9], 8)] == [False, True, False]


def test_line_similarity_in_short_runs(monkeypatch):
    left = ["abcdefghij" * 3, "klmnopqrst" * 3, "uvwxyz" * 5, "abc"]
    right = ["abcdefghij" * 4, "klmnopqrsu" * 3, "uvwxyz" * 6, "abd"]
    want = [lines.jaccard(lines.shingle_set(a, 8), lines.shingle_set(b, 8)) >= 0.8 for a, b in zip(left, right, strict=True)]
    monkeypatch.setattr(lines, "PAIR_CHARS", 64)
    assert lines.similar_lines(left, right, 8, 0.8) == want == [True, False, True, False]


def test_lines_are_read_twice(spark, rows):
    """Once for the band keys, once for the places and the texts of lines that may be linked."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = table(spark, rows)
    lines.fuzzy_line_classes(docs.mapInArrow(count, docs.schema)).collect()
    assert seen.value == 2 * len(rows)


def line_classes(spark, found_lines):
    keys = lines.band_keys(lines.signatures(found_lines, 8, 70), 5)
    want = meeting_classes(found_lines, keys, lambda a, b: lines.similar_lines([a], [b], 8, 0.8)[0])
    number = {x: i for i, x in enumerate(found_lines)}
    found = defaultdict(set)
    for r in lines.fuzzy_line_classes(table(spark, [(i, x, "xx", "a") for i, x in enumerate(found_lines)])).collect():
        found[r.class_doc].add(number[found_lines[r.doc_id]])
    return {frozenset(c) for c in found.values()}, want


def test_lines_of_a_tree_and_a_chain(spark):
    """Lines a character off a random earlier one, and a running chain of such lines."""
    rng = random.Random(5)
    tree = mutation_tree(rng, 250, lambda x: change_character(rng, x), prose(rng, 60)[:120])
    chain = [prose(rng, 60)[:120]]
    for _ in range(150):
        chain.append(change_character(rng, chain[-1]))
    found, want = line_classes(spark, list(dict.fromkeys(x.strip() for x in tree + chain)))
    assert coarser(found, want)


def test_open_members_of_small_keys_travel_once_a_key(spark, monkeypatch):
    rng = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyz "
    rows = []
    for g in range(20):
        line = "".join(rng.choices(alphabet, k=400))
        for c in range(8):  # copies that drift apart: members of a key end in several classes
            rows.append((g * 10 + c, line, "xx", "a"))
            at = [rng.randrange(400) for _ in range(9)]
            line = "".join(rng.choice(alphabet) if i in at else x for i, x in enumerate(line))
    made, whole = [], links.rarest
    monkeypatch.setattr(links, "rarest", lambda *a: made.append(whole(*a)) or made[-1])
    monkeypatch.setattr(links, "release", lambda *frames: None)
    found = []
    for most in (links.DIRECT, 1):  # all members compared, or sought by their rarest shingles
        monkeypatch.setattr(links, "DIRECT", most)
        found.append({(r.doc_id, r.line_no): (r.class_doc, r.class_line) for r in lines.fuzzy_line_classes(table(spark, rows)).collect()})
    direct, rare = ([len(r["keys"]) for r in m.select("keys").collect()] for m in made)
    assert direct and max(direct) <= 14
    assert min(rare) > 14
    assert found[0] == found[1]


def test_id_filter_turns_away_most_others_and_none_of_its_own(spark):
    ids = np.array([links.id_of(lines.digest(str(i))) for i in range(4000)], np.int64)
    test = links.id_filter(spark.createDataFrame([(int(x),) for x in ids[:1000]], "id bigint"))
    held = test(ids)
    assert held[:1000].all()
    assert held[1000:].mean() < 0.1
    assert not links.id_filter(spark.createDataFrame([], "id bigint"))(ids).any()


def test_word_hashes_do_not_depend_on_the_slices():
    texts = ["a b c", None, "word " * 40000, "", "a b c " * 30000, "tail a"]
    h, off = minhash.word_sequences(texts)
    for i, x in enumerate(texts):
        alone, _ = minhash.word_sequences([x])
        assert np.array_equal(h[off[i] : off[i + 1]], alone)
        assert len(alone) == len(words(x or ""))


def test_workers_hash_a_list_of_texts_slice_by_slice(monkeypatch):
    sizes, whole = [], minhash.Words
    monkeypatch.setattr(minhash, "Words", lambda t: sizes.append(len(t.data)) or whole(t))
    minhash.word_sequences(["word " * 1000] * 256)
    assert max(sizes) <= 128 << 10


def test_sketches_of_texts_with_more_shingles_than_places(monkeypatch):
    """Texts whose places don't fit beside the hash have the same sketches."""
    rng = random.Random(2)
    t = Texts.of(pa.array([prose(rng, 100), "a b c d e f", prose(rng, 40)]))
    h, off = minhash.shingles(t, 5)
    want = minhash.order_sketches(minhash.labelled(h, off), off, 12, 3)
    monkeypatch.setattr(minhash, "PLACE_BITS", 4)
    assert (minhash.order_sketches(minhash.labelled(h, off), off, 12, 3) == want).all()
