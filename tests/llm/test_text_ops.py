import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from fixtures import prose, table, words
from pyspark.sql import functions as F
from slotframe.llm import chat, decontaminate, langid, mixing, quality, tokens
from slotframe.llm.common import Texts, new_dir
from slotframe.llm.registry import tokenizer_path

# ---------------------------------------------------------------- quality


def brute_quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen, dup, dup_chars = set(), 0, 0
    for x in lines:
        if x in seen:
            dup += 1
            dup_chars += len(x)
        seen.add(x)

    def grams(n):
        return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]

    count = Counter(grams(5))
    inside = {i + k for i, g in enumerate(grams(5)) if count[g] > 1 for k in range(5)}
    chars = sum(map(len, w))
    base = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    ok = not base and dup / max(1, len(lines)) <= 0.3 and dup_chars / max(1, sum(map(len, lines))) <= 0.2
    for n, limit in quality.Limits().ngrams:
        before, cover = set(), set()
        for i, g in enumerate(grams(n)):
            if g in before:
                cover.update(range(i, i + n))
            before.add(g)
        ok = ok and sum(len(w[i]) for i in cover) / max(1, chars) - limit <= 0
    return (len(w), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), base, ok)


def test_quality_against_brute_force(docs, rows):
    rng = random.Random(0)
    got = [tuple(r) for r in quality.score_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()]
    want = [(i, *brute_quality(t)) for i, t, *_ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert rng and any(g[-1] for g in got) and any(not g[-1] for g in got)


def test_quality_of_repeating_texts(spark):
    rng = random.Random(7)
    texts = []
    for k in range(40):
        unit = prose(rng, rng.randint(3, 12))
        body = prose(rng, rng.randint(0, 120))
        texts.append("\n".join(rng.sample([unit] * rng.randint(1, 6) + body.split(". ") + ["#$ <x> \x0b end"], k=3)))
    rows = [(i, t, "xx", "a") for i, t in enumerate(texts)]
    got = {r[0]: tuple(r)[1:] for r in quality.score_quality(table(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}


def test_quality_filter(docs, empty):
    out = quality.filter_quality(docs)
    assert out.columns == docs.columns
    assert all(brute_quality(r.text)[-1] for r in out.collect())
    assert quality.filter_quality(empty).collect() == []


# ---------------------------------------------------------------- chat

NASTY = ["", "\\", "<|end|>\n", "<|turn|>user<|body|>", "\\<|image:1|>", "a\\", "<", "</s>[INST] ok [/INST]", "line\n\nline", "\U0001f600<|", "\\\\<<"]


def test_escape_round_trip():
    rng = random.Random(0)
    texts = NASTY + ["".join(rng.choice("\\<|>imagend:1\n") for _ in range(30)) for _ in range(200)]
    for t in texts:
        assert chat.unescape(chat.escape(t)) == t
        turn, (a, b) = chat.format_turn("assistant", [{"kind": "text", "text": t}], chat.PartVisitor())
        assert [(r, chat.body_text(x)) for r, x in chat.read_turns(turn * 2)] == [("assistant", t)] * 2
        assert chat.body_text(turn[a:b]) == t


def test_parts():
    v = chat.PartVisitor()
    parts = [{"kind": "text", "text": "see <|image:9|> "}, {"kind": "image", "ref": "s/1.png", "n_tokens": 256}, {"kind": "text", "text": " and "}, {"kind": "document", "ref": "d.pdf", "n_tokens": 40}, {"kind": "audio", "ref": None, "n_tokens": None}]
    out = v.visit(parts)
    assert out == "see \\<|image:9|> <|image:1|> and <|document:2|><|audio:3|>"
    assert v.refs == [(1, "image", "s/1.png", 256), (2, "document", "d.pdf", 40), (3, "audio", "", 0)] and v.tokens == 296
    assert chat.body_text(out) == "see <|image:9|>  and "
    with pytest.raises(ValueError):
        v.visit([{"kind": "video"}])
    with pytest.raises(ValueError):
        list(chat.read_turns("x<|turn|>"))


def test_conversations(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate([("system", None), *[(("user", "assistant")[i % 2], x) for i, x in enumerate(NASTY)]])]
    rows += [(3, 0, "user", "b"), (3, 0, "user", "a"), (3, 0, None, "a"), (3, None, "user", "z"), (3, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("pos", F.lit("clash")).repartition(5)
    formatted = chat.format_conversations(df.withColumn("parts", chat.text_parts(F.col("text"))))
    got = {r.conv_id: r for r in chat.digest_conversations(formatted).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r is not None, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        g = got[c]
        assert g.n_turns == len(turns)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        said = "".join(x for *_, r, x in turns if r == "assistant")
        assert (g.loss_chars, g.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert g.formatted_chars == sum(len(chat.format_turn(r, [{"text": x}], chat.PartVisitor())[0]) for *_, r, x in turns)
    assert len(got) == 4


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    assert chat.digest_conversations(chat.format_conversations(df)).collect() == []


# ---------------------------------------------------------------- tokens


def whole_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_chunks_encode_like_whole_texts():
    rng = random.Random(1)
    texts = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "a\n \nb", "it's  we'll 12 34", "x\u00a0 y", "<|endoftext|> a", "tab\t x", "é ü ñ", "\u3000 字 \u2003z", "a \u00a0b", "a \x1cb"]
    end = "<|endoftext|>"
    texts += [end, f"a{end}b", f"{end}a", f"a{end}", f"a  {end}  b", f"a {end} b c", f" {end} ", f"{end}{end} x", f"a <|endof {end[:-1]} b"]
    texts += ["".join(rng.choice("ab 1é\n\t'!<\u00a0") for _ in range(40)) for _ in range(500)]
    texts += [f" {end}".join("".join(rng.choice("ab  \n") for _ in range(rng.randint(0, 9))) for _ in range(3)) for _ in range(200)]
    texts += ["x" * 5000, "\U0001f600\ud7ff " * 30]
    e = tokens.Encoder(tokenizer_path())
    every = [[*x, 0] for x in whole_ids(texts)]
    for size in (len(texts), 7, 1):  # known chunks of the first call serve the others
        for a in range(0, len(texts), size):
            flat, counts = e(Texts.of(pa.array(texts[a : a + size], pa.string())), 0)
            want = every[a : a + size]
            assert counts.tolist() == [len(x) for x in want]
            assert flat.tolist() == [i for x in want for i in x]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    tok.save(str(tmp_path / "t.json"))
    flat, counts = tokens.Encoder(str(tmp_path / "t.json"))(Texts.of(pa.array(["a b", None, "b c a"], pa.string())), 9)
    assert (flat.tolist(), counts.tolist()) == ([0, 1, 9, 9, 1, 2, 0, 9], [3, 1, 4])


@pytest.mark.parametrize("length", (16, 512))
def test_token_files(docs, rows, spark, length, monkeypatch):
    manifest = tokens.write_tokens(docs, tokenizer_path(), new_dir(spark, "t"), length=length)
    got = tokens.read_documents(spark, manifest).orderBy("start").collect()
    ids = dict(zip([t for _, t, *_ in rows], whole_ids([t for _, t, *_ in rows]), strict=True))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for g, (i, t, *_) in zip(got, order, strict=True):
        x = np.array([*ids[t], 0], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (i, start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)
    for r in manifest.collect():
        f = tokens.TokenFile(r["file"])
        n = sum(f.seq.get_batch(b).num_rows for b in range(f.seq.num_record_batches))
        assert n == math.ceil(r["n_tokens"] / length)
        on = sum(f.mask(i).true_count for i in range(n))
        assert on == r["n_tokens"] and len(f.sequence(n - 1)) == length
        assert not f.sequence(0).flags.owndata  # a view of the mapped file
        assert f.sequence(0).tolist() == f.ids(0, length).tolist() if r["n_tokens"] >= length else True


def test_no_tokens(spark, empty):
    assert tokens.read_documents(spark, tokens.write_tokens(empty, tokenizer_path(), new_dir(spark, "t"))).collect() == []


# ---------------------------------------------------------------- mixing


def targets(size, cap=3.0):
    """Water filling by bisection; weights 1, 2, 3 by code point order, null last."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, lo, hi = sum(size.values()), 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(cap * size[s], mid * weight[s]) for s in size) < total else (lo, mid)
    return {s: min(cap * size[s], hi * weight[s]) for s in size}


def mixed_rows(n=3000, seed=5):
    rng = random.Random(seed)
    names = ["hot"] * 12 + ["a", "b", "B", "é", "z1", "z2", None, "empty"]
    rows = []
    for i in range(n):
        s = rng.choice(names)
        rows.append((i, None if s == "empty" else " ".join(["w"] * rng.randint(0, 60)), "xx", s))
    return rows


def test_mix_reaches_targets(spark):
    rows = mixed_rows()
    df = table(spark, rows)
    got = mixing.plan_mix(df).withColumn("copies", F.size("draws")).collect()
    again = mixing.plan_mix(df.repartition(7)).withColumn("copies", F.size("draws")).collect()
    key = lambda r: (r.doc_id, r.copies, r.draws)
    assert sorted(map(key, got)) == sorted(map(key, again))
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(words(t))
    want, taken = targets(size), Counter()
    for r in got:
        assert r.size == len(words(rows[r.doc_id][1])) and r.source_size == size[r.source]
        assert 0 <= r.copies <= 3 and [d.copy for d in r.draws] == list(range(r.copies))
        assert abs(r.target - want[r.source]) < 1e-3
        taken[r.source] += r.copies * r.size
    for s in size:
        assert abs(taken[s] - want[s]) <= 60, s
    assert len(got) == len(rows)
    shards = Counter((d.shard, r.source) for r in got for d in r.draws)
    assert {s for s, _ in shards} == set(range(16))


def test_mix_documents(docs, rows):
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    texts = Counter((r.doc_id, r.text) for r in out.collect())
    have = Counter((i, t) for i, t, *_ in rows)
    assert set(texts) <= set(have)
    assert all(n <= 3 * have[k] for k, n in texts.items())


def test_mix_edges(spark, empty):
    assert mixing.plan_mix(empty).collect() == []
    assert mixing.mix_documents(empty).collect() == []
    nothing = mixing.plan_mix(table(spark, [(1, None, "x", "a"), (2, " ", "x", None)])).collect()
    assert [(r.size, r.target, len(r.draws)) for r in nothing] == [(0, 0.0, 0)] * 2


def test_hypergeometric_draws(spark):
    """Frequencies of the SQL draw against the distribution."""
    e = mixing._hypergeometric("n", "k", "r", "u")
    n, k, r = 30, 11, 13
    grid = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"), F.lit(n).cast("bigint").alias("n"), F.lit(k).cast("bigint").alias("k"), F.lit(r).cast("bigint").alias("r"))
    got = Counter(x.d for x in grid.select(F.expr(e).alias("d")).collect())
    for x in range(k + 1):
        p = math.comb(k, x) * math.comb(n - k, r - x) / math.comb(n, r)
        assert abs(got[x] / 4000 - p) < 1e-3
    edge = spark.sql(f"select {mixing._hypergeometric('5L', '5L', '2L', '0.5D')} a, {mixing._hypergeometric('5L', '0L', '2L', '0.5D')} b, {mixing._hypergeometric('2000000L', '700000L', '1000000L', '0.5D')} c").first()
    assert (edge.a, edge.b) == (2, 0) and abs(edge.c - 350000) < 5


def test_split_adds_up(spark):
    quotas = spark.createDataFrame([(0, 100), (1, 1), (2, 0), (3, 7000)], "rank bigint, quota bigint")
    cuts = {r["rank"]: r["cuts"] for r in mixing.split_quotas(quotas, 3, 5).collect()}
    assert {k: v[-1] for k, v in cuts.items()} == {0: 100, 1: 1, 2: 0, 3: 7000}
    parts = np.diff(np.array([[0, *cuts[k]] for k in range(4)]), axis=1)
    assert (parts >= 0).all() and np.ptp(parts.sum(0)) <= 7


# ---------------------------------------------------------------- language


def test_language_of_held_out_texts(spark):
    rng = random.Random(2)
    syllables = {"p": ("ka", "to", "ri", "n", "su"), "q": ("sch", "er", "ung", "ä", "st"), "r": ("ei", "que", "la", "é", "ou")}
    rows = [(i, " ".join("".join(rng.choice(syllables[g]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 80))), g, "a") for i in range(900) for g in [rng.choice("pqr")]]
    rows += [(1000, None, "p", "a"), (1001, "", "p", "a"), (1002, "12 ... \U0001f600", "p", "a"), (1003, "katori", None, "a"), (None, "kato", "p", "a"), (1004, "kari " * 60000, "p", "a")]
    df = table(spark, rows)
    got = langid.identify_language(df, F.col("doc_id") % 5 != 0, max_train=120).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 for r in got)
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "p", "p"]
    held = [(by[i].lang_pred, g) for i, t, g, _ in rows if i is not None and i < 900 and i % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.97


def test_language_without_labels(spark, empty):
    got = langid.identify_language(table(spark, [(1, "abc", None, "a"), (2, None, "x", "a")]), F.lit(True)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2
    assert langid.identify_language(empty, F.lit(True)).collect() == []


def test_presence_is_that_of_the_text():
    from slotframe.llm.common import Texts

    rng = random.Random(3)
    texts = [prose(rng, rng.randint(0, 40)) for _ in range(9)] + ["", "a", "long " * 60000]
    t = Texts.of(pa.array(texts))
    many = langid.presence(t, 0, len(t))
    for i, x in enumerate(texts):
        one = Texts.of(pa.array([x]))
        assert (langid.presence(one, 0, 1)[0] == many[i]).all()


def brute_grams(text, dim_bits=14):
    """Hashed 2- to 4-byte n-grams of a text, one at a time."""
    data, out = [b + 32 if 65 <= b <= 90 else b for b in text.encode()], set()
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            h = data[i]
            for b in data[i + 1 : i + n]:
                h = (h * 0x01000193 + b) % 2**32
            out.add((h * 0x9E3779B1 + n * 0x85EBCA6B) % 2**32 >> 32 - dim_bits)
    return out


def test_language_against_brute_force(spark):
    """Kernel values by sets, the ridge problem by plain least squares; repeated rows and ties included."""
    rng = random.Random(8)
    parts = {"xx": ("ba", "lo", "mi", "ter"), "yy": ("qu", "é", "an", "ter"), "zz": ("sch", "ung", "lo", "ö")}
    rows = []
    for k in range(60):
        lang = ("xx", "yy", "zz")[k % 3]
        rows.append((k, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randint(2, 30))), lang, "a"))
    rows += [(100, rows[4][1], None, "a"), (100, rows[4][1], None, "a"), (101, "12 34", "xx", "a"), (102, None, None, "a")]
    df = table(spark, rows)
    got = {r.doc_id: r for r in langid.identify_language(df, F.col("doc_id") < 45).collect()}
    rank = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(5)).alias("h")).collect()}
    train = sorted((r for r in rows if r[0] < 45), key=lambda r: (rank[r[0]], r[2]))
    grams = [brute_grams(r[1]) for r in train]
    marks = [g for lang in parts for g in [g for g, r in zip(grams, train, strict=True) if r[2] == lang][:32]]
    kernel = lambda a, b: len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1))
    k_nm = np.array([[kernel(g, m) for m in marks] for g in grams])
    k_mm = np.array([[kernel(g, m) for m in marks] for g in marks])
    value, vector = np.linalg.eigh(k_mm)
    ok = value > 1e-6 * value.max()
    root = vector[:, ok] / np.sqrt(value[ok])
    phi = k_nm @ root
    target = np.array([[1.0 if r[2] == lang else -1.0 for lang in parts] for r in train])
    # a constant that costs nothing beside weights that do
    left = np.vstack([np.hstack([phi, np.ones((len(phi), 1))]), np.hstack([np.sqrt(1e-3 * len(phi)) * np.eye(phi.shape[1]), np.zeros((phi.shape[1], 1))])])
    beta = np.linalg.lstsq(left, np.vstack([target, np.zeros((phi.shape[1], len(parts)))]), rcond=None)[0]
    for i, text, *_ in rows:
        if text is None or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        k = np.array([kernel(brute_grams(text), m) for m in marks])
        s = 4 * (k @ root @ beta[:-1] + beta[-1])
        e = np.exp(s - s.max())
        assert got[i].lang_pred == list(parts)[int(e.argmax())]
        assert got[i].score == pytest.approx(float(e.max() / e.sum()), abs=2e-3)


# ---------------------------------------------------------------- decontamination


def plain_leaks(items, rows):
    """Every item against every window of every document, by the plain table, without a search before it."""
    fold = lambda t: re.findall(r"[0-9a-z\u0080-\uffff]+", (t or "").lower())

    def common(x, y):
        row = [0] * (len(x) + 1)
        for p in y:
            new = [0]
            for j, q in enumerate(x):
                new.append(row[j] + 1 if p == q else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    out = set()
    for item, text in items:
        x = fold(text)
        n = len(x)
        if not n:
            continue
        length = min((6, 8, 11, 16, 22, 32, 45, 64), key=lambda c: (abs(math.log(n / c)), c))
        tail = max(2, n // 5)
        for i, t, *_ in rows:
            y = fold(t)
            if n < 6:
                if any(y[a : a + n] == x for a in range(len(y) - n + 1)):
                    out.add((i, item))
                continue
            stride, slack = max(1, length // 4), length // 2
            for a in range(0, max(len(y) - length, 0) + stride, stride):
                a = min(a, max(len(y) - length, 0))
                window = y[max(a - slack, 0) : a + length + slack]
                share = common(x, window) / n
                if share >= 0.85 or share >= 0.6 and common(x[-tail:], window) / tail >= 0.8:
                    out.add((i, item))
                    break
    return out


def test_leaks_against_a_full_comparison(spark):
    """Paraphrases with up to 35 in 100 words replaced: none found that isn't one, nineteen in twenty found; short items, ties, repeated rows, a long text."""
    rng = random.Random(31)
    items = [(i, prose(rng, rng.randint(15, 40))) for i in range(12)] + [(None, prose(rng, 20)), (50, "two words"), (51, "Only these five words here")]
    rows = []
    for k in range(72):
        w = prose(rng, rng.randint(20, 90)).split()
        if k % 3:
            piece = rng.choice(items[:13])[1].split()
            change = rng.sample(range(int(len(piece) * 0.8)), int(len(piece) * rng.choice((0, 0.1, 0.2, 0.35))))
            at = rng.randrange(len(w))
            w[at:at] = [f"new{j}" if j in change else p for j, p in enumerate(piece)]
        rows.append((k, " ".join(w), "xx", "a"))
    rows += [(90, f"{items[0][1]} . {items[0][1]}", "xx", "a"), (90, f"{items[0][1]} . {items[0][1]}", "xx", "a"), (91, "here two, WORDS are", "xx", "a"), (92, "only these five words", "xx", "a")]
    rows += [(93, prose(rng, 3000) + " " + items[1][1] + " " + prose(rng, 50), "xx", "a")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    hits = decontaminate.find_leaks(table(spark, rows), benchmark).collect()
    got, want = {(r.doc_id, r.item_id) for r in hits}, plain_leaks(items, rows)
    assert got <= want
    assert len(got) >= 0.95 * len(want)
    assert {(90, 0), (91, 50), (93, 1)} <= got and (92, 51) not in got
    assert len({r.first_word for r in hits if r.doc_id == 90 and r.item_id == 0}) == 1 < sum(r.doc_id == 90 for r in hits)


def test_leaks(spark):
    rng = random.Random(21)
    items = [(i, prose(rng, rng.randint(15, 60)).capitalize()) for i in range(30)] + [(30, prose(rng, 150)), (31, None), (32, "too short"), (33, ""), (3, None)]
    clean = [prose(rng, rng.randint(20, 400)) for _ in range(120)]
    rows, truth = [], set()
    for k, t in enumerate(clean):
        w = t.split()
        if k % 4 == 0:
            i, x = items[(k // 4) % 31]
            piece = x.split()
            kind = k // 4 % 3
            if kind == 1:  # punctuation and case
                piece = [p.upper() + "," for p in piece]
            if kind == 2:  # a paraphrase: every seventh word another one, the end as it was
                piece = [p if j % 7 or j > len(piece) * 0.7 else "zuzu" for j, p in enumerate(piece)]
            at = rng.randrange(len(w))
            w[at:at] = piece
            truth.add((k, i))
        rows.append((k, " ".join(w), "xx", "a"))
    rows += [(500, None, "xx", "a"), (501, "", "xx", "a"), (None, items[2][1], "xx", "a")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    df = table(spark, rows)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, benchmark).collect()}
    assert got == truth | {(None, 2)}
    kept = decontaminate.drop_leaks(df, benchmark)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in got}


def test_no_benchmark(spark, docs, empty):
    none = spark.createDataFrame([], "item_id bigint, text string")
    one = spark.createDataFrame([(1, "some words that are long enough for an item")], "item_id bigint, text string")
    assert decontaminate.find_leaks(docs, none).collect() == []
    assert decontaminate.drop_leaks(docs, none).count() == docs.count()
    assert decontaminate.find_leaks(empty, one).collect() == []


def test_subsequence_lengths():
    rng = random.Random(5)
    words_ = decontaminate.Vocabulary(np.arange(1, 12, dtype=np.uint64) << np.uint64(50))
    for _ in range(50):
        piece = words_.hash[[rng.randrange(11) for _ in range(rng.randint(1, 64))]]
        text = np.array([rng.randrange(11) for _ in range(40)])
        q = decontaminate.Queries([0], [piece], np.array([0]), np.array([16]))
        full = np.array([(1 << len(piece)) - 1], np.uint64)
        got = decontaminate.common_words(text, np.array([0]), np.array([3]), np.array([35]), q.masks(words_), full)[0]
        row = [0] * (len(piece) + 1)
        for x in words_.hash[text[3:35]]:
            new = [0]
            for j, y in enumerate(piece):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert got == row[-1]


# ---------------------------------------------------------------- registry and pipeline


def test_queries_against_sql(spark, sf):
    import duckdb
    from slotframe.llm import registry

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name, sql in registry.SQL.items():
        want = con.execute(sql)
        columns = sorted(c[0] for c in want.description)
        at = [[c[0] for c in want.description].index(c) for c in columns]
        want = sorted(tuple(r[i] for i in at) for r in want.fetchall())
        df = registry.QUERIES[name](spark, sf)
        assert sorted(df.columns) == columns, name
        assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want, name


def test_stages_take_awkward_rows(spark, sf, docs, empty):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns, and no rows at all."""
    import corpus_pipeline

    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        last = name == corpus_pipeline.STAGES[-1][0]
        assert last or out.columns == docs.columns, name
        rows = out.collect()
        assert rows and {r.doc_id for r in rows} <= ids, name
        assert not last or len(rows) == docs.count()
        assert stage(spark, empty, sf).collect() == [], name


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        kept = [r.doc_id for r in out.collect()]
        assert set(kept) <= ids
        if name == "quality_rules":
            assert set(kept) == {i for i in ids if brute_quality(texts[i])[-1]}
        if name == "benchmark_decontamination":
            norm = lambda x: " ".join(re.findall(r"[^\W_]+", (x or "").lower()))
            items = [norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert ids - set(kept) == {i for i in ids if any(x in norm(texts[i]) for x in items)}
        ids = set(kept)
        docs = out
    rows = corpus_pipeline.run(spark, sf).orderBy("start").collect()
    assert sorted(r.doc_id for r in rows) == [r.doc_id for r in rows] and sum(1 for _ in rows) == len(kept)
    encoded = {i: len(x) + 1 for i, x in zip(texts, whole_ids(texts.values()), strict=True)}
    assert all(r.n_tokens == encoded[r.doc_id] for r in rows)
    assert json.dumps(rows[0].asDict())
