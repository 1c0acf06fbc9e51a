"""Language identification by averaged hashed subword embeddings (operator 5)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, steps, texts_of

BUCKET_BITS = 13
ORDERS = (1, 2, 3, 4)
DIM = 16
#: The fit uses at most so many labelled documents, chosen by a hash of their id.
FIT_DOCS = 1500
#: Share of rightly predicted calibration documents that rejection may cost, and the highest threshold.
REJECT_SHARE, REJECT_MOST = 0.001, 0.6
#: Calibration documents without which nothing but `und` is rejected.
CALIBRATION_LEAST = 50

_TABLE = bytes(32 if b < 65 or 91 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))
_MULT = np.uint32(2654435761)
_LETTER = re.compile(r"[^\W\d_]")
_BLOCK = 1 << 20


def subword_counts(text: str) -> np.ndarray:
    """Counts of hashed byte n-grams of the lower-cased text; all else in ASCII parts words."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_TABLE).split()) + b" "
    counts = np.zeros(len(ORDERS) << BUCKET_BITS, dtype=np.int64)
    for at in range(0, len(raw), _BLOCK):
        b = np.frombuffer(raw[at : at + _BLOCK + max(ORDERS) - 1], np.uint8).astype(np.uint32)
        code = np.zeros(len(b), dtype=np.uint32)
        for k, n in enumerate(ORDERS):
            code = (code[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
            own = code[:_BLOCK]
            bucket = (own * _MULT) >> np.uint32(32 - BUCKET_BITS)
            counts[k << BUCKET_BITS : (k + 1) << BUCKET_BITS] += np.bincount(bucket, minlength=1 << BUCKET_BITS)
    return counts


@dataclass
class LanguageModel:
    """scores = softmax((mean of embeddings @ weights + bias) / temperature)."""

    languages: list[str]
    table: np.ndarray  # embeddings @ weights, one row per bucket
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(counts)
        return counts[at] @ self.table[at] / max(1, counts.sum()) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not _LETTER.search(text):
            return "und", 0.0
        z = self.logits(subword_counts(text)) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        return self.languages[int(p.argmax())], float(p.max())


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: list[str], check: np.ndarray, epochs: int = 12, rate: float = 20.0, seed: int = 0) -> LanguageModel:
    """Stochastic gradient descent on the rows outside `check`; those set temperature and threshold.

    A bag holds a document's buckets and their counts.
    """
    rng, k = np.random.default_rng(seed), len(languages)
    e = rng.normal(0, 0.3, (len(ORDERS) << BUCKET_BITS, DIM)).astype(np.float32)

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), len(e)), dtype=np.float32)
        for i, row in enumerate(rows):
            at, n = bags[row]
            x[i, at] = n / max(1, n.sum())
        return x

    w, b = rng.normal(0, 0.3, (DIM, k)).astype(np.float32), np.zeros(k, np.float32)
    fit = np.flatnonzero(~check) if (~check).any() else np.arange(len(bags))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 32)):
            x = dense(rows)
            h = x @ e
            z = h @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p /= len(rows)
            grad_h = p @ w.T
            w -= step * 0.1 * (h.T @ p)
            b -= step * 0.01 * p.sum(axis=0)
            e -= step * (x.T @ grad_h)
    model = LanguageModel(languages, (e @ w).astype(np.float64), b.astype(np.float64))
    rows = np.flatnonzero(check)
    if len(rows):
        z = np.array([n @ model.table[at] / max(1, n.sum()) for at, n in (bags[i] for i in rows)]) + model.bias

        def chances(t: float) -> np.ndarray:
            p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
            return p / p.sum(axis=1, keepdims=True)

        model.temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(chances(t)[np.arange(len(rows)), labels[rows]] + 1e-12).mean())
        p = chances(model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == labels[rows]]
        model.threshold = float(min(REJECT_MOST, np.quantile(right, REJECT_SHARE))) if len(right) >= CALIBRATION_LEAST else 0.0
    return model


def held_out(id_col: str) -> Column:
    """True where crc32 of the id as text is divisible by 5; such documents teach nothing."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def fit_language_model(docs: DataFrame, fit_docs: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from at most about `fit_docs` labelled documents that are not held out.

    A hash of the id chooses them; another remainder of the crc (1) makes the calibration
    fold. The executors turn them into counts of fixed width, so long texts reach the driver
    as no more than that. Null ids, texts and labels teach nothing; without labelled
    documents the model knows no language.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    n = own.count()
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, fit_docs / max(1, n)) * (1 << 30))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = []
            for name, lang, check, text in zip(*(batch.column(c).to_pylist() for c in ("name", "lang", "check", "text")), strict=True):
                counts = subword_counts(text)
                at = np.flatnonzero(counts)
                rows.append({"name": name, "lang": lang, "check": check, "at": at.astype(np.int32), "n": counts[at].astype(np.float32)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("name", pa.string()), ("lang", pa.string()), ("check", pa.bool_()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.float32()))]))

    picked = own.where(spread & F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("name"), "lang", (F.crc32(F.col("doc_id").cast("string")) % 5 == 1).alias("check"), "text")
    got = picked.mapInArrow(features, "name string, lang string, check boolean, at array<int>, n array<float>").toArrow()
    if not got.num_rows:
        return LanguageModel([], np.zeros((0, 0)), np.zeros(0))
    got = got.combine_chunks().sort_by([("name", "ascending"), ("lang", "ascending")]).slice(0, 2 * fit_docs)

    def arrays(name: str) -> list[np.ndarray]:
        """The lists of a column as views of its values."""
        return [x.values.to_numpy() for x in got.column(name)]

    labels = pd.Categorical(got.column("lang").to_pylist())
    return train(list(zip(arrays("at"), arrays("n"), strict=True)), labels.codes.astype(np.int64), list(labels.categories), np.array(got.column("check").to_pylist(), dtype=bool))


def predict_language(docs: DataFrame, model: LanguageModel, carry: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every whole text, in one pass.

    lang_pred is `und` with score 0 for null text and text without a letter (or a model
    that knows no language); such rows and those under the calibrated threshold are rejected.
    `carry` adds the input row as the struct `row`. Every row is judged for itself, repeated ids too; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in steps(batches):
            got = [own.predict(t) for t in texts_of(batch, "text")]
            lost = [lang == "und" or p < own.threshold for lang, p in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in got], pa.string()), pa.array([p for _, p in got], pa.float64()), pa.array(lost, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    columns = [F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")]
    return map_texts(docs, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean", columns, carry)
