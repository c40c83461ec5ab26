"""Language identification with a string kernel.

The kernel of two texts is the blended-spectrum presence kernel: the number of byte
n-grams (2 to 4 bytes, hashed) that both hold, over the root of the product of their
counts.  Nyström landmarks, texts of a bounded labelled sample, turn kernel values into
features; one-versus-rest kernel ridge regression is solved on the driver.  Scoring
needs one matrix product a batch: presence rows times landmark columns.

The sample bound is ``max_train`` rows in all, dealt evenly to the languages and drawn
by a hash of the id; each sample text is reduced to ``DIM`` bits before it leaves its
executor.  Scoring covers every byte of every text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is
every text when no labelled row is there; null labels and null ids of labelled rows are
not learned from; ties go to the first language in order; repeated rows score alike; an
empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Texts

DIM = 1 << 14
ORDERS = (2, 3, 4)
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
#: Texts in one matrix product; bytes hashed at a time.
ROWS, BYTES = 64, 128 << 10


def presence(t: Texts, first: int, last: int) -> np.ndarray:
    """Rows of 0 and 1: which hashed n-grams texts first to last - 1 hold."""
    out = np.zeros((last - first) * DIM, np.uint8)
    lo, hi = int(t.off[first]), int(t.off[last])
    for a in range(lo, hi, BYTES):
        b = min(hi, a + BYTES)
        c = _LOWER[t.data[a : min(hi, b + max(ORDERS) - 1)]]
        here = np.arange(a, b)
        row = np.searchsorted(t.off, here, "right") - 1 if last - first > 1 else np.full(b - a, first)
        left = t.off[row + 1] - here  # bytes of the same text from here on
        place = (row - first) * DIM
        h = c.copy()
        for n in range(2, max(ORDERS) + 1):
            h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :]
            if n in ORDERS and len(h):
                m = min(len(h), b - a)
                x = (h[:m] * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(18)
                ok = left[:m] >= n
                out[(place[:m] + x)[ok]] = 1
    return out.reshape(last - first, DIM)


def has_letter(t: Texts) -> np.ndarray:
    """Whether each text has a letter; only texts without an ASCII one are decoded."""
    c = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(_ASCII_LETTER[t.data], out=c[1:])
    found = c[t.off[1:]] > c[t.off[:-1]]
    for i in np.flatnonzero(~found & (np.diff(t.off) > 0)):
        found[i] = any(x.isalpha() for x in t.data[t.off[i] : t.off[i + 1]].tobytes().decode("utf-8", "ignore"))
    return found


@dataclass
class KernelModel:
    """languages, landmark presence bits and, for each landmark and language, a coefficient."""

    languages: list[str]
    landmarks: np.ndarray  # landmarks x DIM / 8, packed
    weights: np.ndarray  # landmarks + 1 x languages, the last row a constant term

    def columns(self) -> np.ndarray:
        """DIM x landmarks, each column over the root of its count."""
        bits = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        return np.ascontiguousarray((bits / np.sqrt(np.maximum(bits.sum(1, keepdims=True), 1))).T)

    def score(self, x: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Softmax over the ridge scores of each presence row."""
        dense = x.astype(np.float32)
        k = (dense @ columns) / np.sqrt(np.maximum(dense.sum(1, keepdims=True), 1))
        s = 4.0 * (k @ self.weights[:-1] + self.weights[-1])
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit_kernel_ridge(x: np.ndarray, labels: list[str], landmarks: int = 96, ridge: float = 1e-3) -> KernelModel:
    """``x``: packed presence rows. Landmarks are dealt evenly to the languages, in row order."""
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels])
    each = max(1, landmarks // len(languages))
    chosen = np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(languages))])
    model = KernelModel(languages, x[chosen], np.empty(0))
    columns = model.columns().astype(np.float64)
    bits = np.unpackbits(x, axis=1)
    k_nm = np.concatenate([bits[a : a + 256].astype(np.float64) @ columns for a in range(0, len(bits), 256)])
    k_nm /= np.sqrt(np.maximum(bits.sum(1, dtype=np.int64)[:, None], 1))
    k_mm = k_nm[chosen]
    value, vector = np.linalg.eigh((k_mm + k_mm.T) / 2)
    ok = value > 1e-6 * value.max()
    root = vector[:, ok] / np.sqrt(value[ok])
    phi = k_nm @ root
    mean = phi.mean(0)
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    balance = 1.0 / np.bincount(y, minlength=len(languages))[y]
    balance *= len(y) / balance.sum()
    centred = (phi - mean) * balance[:, None]
    t_mean = (target * balance[:, None]).sum(0) / balance.sum()
    beta = np.linalg.solve(centred.T @ (phi - mean) + ridge * len(y) * np.eye(phi.shape[1]), centred.T @ (target - t_mean))
    weights = root @ beta
    return KernelModel(languages, x[chosen], np.vstack([weights, t_mean - mean @ beta]).astype(np.float32))


def sample_presence(labelled: DataFrame, max_train: int, seed: int) -> tuple[np.ndarray, list[str]]:
    """Packed presence rows and labels of at most ``max_train`` texts, as many for each language.

    ``labelled`` has id, text, lang without nulls. Candidates are thinned by a hash on the executors
    to about twice the bound, so what reaches the driver doesn't grow with the table.
    """
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_train // 2).collect()}
    if not counts:
        return np.empty((0, DIM // 8), np.uint8), []
    each = max(2, max_train // len(counts))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2.0 * each / n + 20.0 / n))).otherwise(share)
    order = F.xxhash64("id", F.lit(seed))
    unit = (F.shiftrightunsigned(order, 11).cast("double")) / float(1 << 53)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = Texts.of(batch.column(2))
            rows = [np.packbits(presence(t, i, i + 1)[0]).tobytes() for i in range(len(t))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["h", "lang", "bits"])

    picked = labelled.filter(unit < share).select(order.alias("h"), "lang", "text").mapInArrow(pack, "h bigint, lang string, bits binary").collect()
    rows, taken = [], dict.fromkeys(counts, 0)
    for r in sorted(picked, key=lambda r: (r["h"], r["lang"], r["bits"])):
        if taken[r["lang"]] < each:
            taken[r["lang"]] += 1
            rows.append(r)
    return np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), DIM // 8), [r["lang"] for r in rows]


PREDICTION = "struct<lang_pred:string,score:double>"


def predict_column(text: Column, model: KernelModel | None) -> Column:
    """A struct (lang_pred, score) for a text column."""

    @F.arrow_udf(PREDICTION)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        columns = model.columns() if model else None
        for column in batches:
            n = len(column)
            names, scores = np.full(n, UNKNOWN, object), np.zeros(n)
            if model:
                t = Texts.of(column)
                rows = np.flatnonzero(has_letter(t))
                for a in range(0, n, ROWS):
                    mine = rows[(rows >= a) & (rows < a + ROWS)]
                    if len(mine):
                        p = model.score(presence(t, a, min(n, a + ROWS))[mine - a], columns)
                        names[mine] = np.array(model.languages, object)[p.argmax(1)]
                        scores[mine] = p.max(1)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    return predict(text)


def identify_language(docs: DataFrame, train: Column, max_train: int = 2400, seed: int = 5, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """One row a document: id, lang_pred, score. Learns from rows where ``train`` holds and text and label are there."""
    labelled = docs.filter(train & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    labelled = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    bits, labels = sample_presence(labelled, max_train, seed)
    model = fit_kernel_ridge(bits, labels) if labels else None
    return docs.select(F.col(id_col), predict_column(F.col(text_col).cast("string"), model).alias("p")).select(id_col, "p.*")
