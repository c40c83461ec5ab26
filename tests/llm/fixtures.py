"""Small tables with every awkward case, and brute-force versions."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, bucket string, label string, digest string, id int, th int, key int, kept string, _text string, _i bigint, _d string, _s string, _h bigint, _th bigint, _key bigint, _grp int, _mix_id bigint, _stay_id bigint, draws string, h string"


def prose(rng, n):
    return " ".join("".join(rng.choice(("ba", "lo", "mi", "ter", "qu", "é", "an")) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(seed=3):
    """(doc_id, text, lang, source) rows: nulls, empty and very long texts, copies, near copies, ties, repeated rows."""
    rng = random.Random(seed)
    rows = []
    base = [prose(rng, rng.randint(60, 260)) for _ in range(14)]
    passage = prose(rng, 70)
    for i, t in enumerate(base):
        rows.append((i * 3, t, ("xx", "yy")[i % 2], ("a", "b", None)[i % 3]))
    rows.append((100, base[2], "xx", "a"))  # exact copies
    rows.append((101, base[2], "xx", "b"))
    w = base[3].split()
    w[len(w) // 2] = "changed"
    rows.append((102, " ".join(w), "yy", "a"))  # a near copy
    for i in range(6):  # a shared passage
        rows.append((110 + i, f"{prose(rng, 30)} {passage} {prose(rng, 20)}", "xx", "a"))
    rows.append((120, f"{passage} {prose(rng, 5)} {passage}", "xx", "a"))  # within one document
    rows.append((130, "la la " * 300, "xx", "b"))  # periodic
    rows.append((131, "same line here now\n" * 20, "yy", "b"))
    rows.append((132, prose(rng, 30000), "xx", "c"))  # very long
    rows += [(140, None, None, None), (141, "", "xx", "a"), (142, " \t\n ", "xx", "a"), (143, "...", "xx", "c"), (144, "one", "xx", "c")]
    rows += [(None, base[5], "xx", "a"), (None, prose(rng, 80), "xx", None)]
    rows += [(150, base[6], "yy", "b"), (150, base[6], "yy", "b")]  # a repeated row
    rows += [(151, base[7], "yy", "b"), (151, prose(rng, 90), "yy", "b")]  # one id, two texts
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    """The rows with columns whose names operators use themselves."""
    full = [(i, t, lang, s, len(t or ""), 1, "b", "l", "d", 2, 3, 4, "k", "t", 5, "d", "s", 6, 7, 8, 9, 10, 11, "w", "h") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def words(text):
    return WORD.findall(text or "")
