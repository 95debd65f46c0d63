"""Operator 10: language identification by averaged hashed subword embeddings.

A text's words (runs of letters, lower-cased, with their boundaries) give character
n-grams, hashed to BUCKETS rows of an embedding. A document is the mean of its rows; a
linear softmax on it gives the language. Both are trained by mini-batch stochastic
gradient descent in numpy on a bounded sample: at most PER_LANGUAGE labelled documents of each of
the LANGUAGES most frequent languages, one row an id, picked by the hash of doc_id. A quarter of the sample calibrates: a temperature
for the score and the score under which a prediction is rejected. For prediction the
embedding and the softmax fold into one row of logits per bucket, so every whole text is
one pass of lookups.

Defined results: null text or text without a letter is `und` with score 0 and rejected; a
table without labelled rows predicts `und`; repeated rows each get a row; an empty table
gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches, bound_batches, cut, strings

BUCKETS, DIM, NGRAMS, PER_LANGUAGE = 1 << 14, 16, (2, 3), 750
EPOCHS, BATCH, RATE, SEED = 12, 32, 20.0, 11
LANGUAGES = 64  # most languages learned, so PER_LANGUAGE * LANGUAGES documents at most are learned from
#: Rejected: scores below this quantile of the rightly predicted calibration rows, and never above REJECT_AT_MOST.
REJECT_QUANTILE, REJECT_AT_MOST = 0.002, 0.5
#: Code points worked on at once: bounds memory whatever the length of a text.
SLICE = 1 << 20


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logits: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    reject_below: float


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


def subwords(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text's words, those that end in a slice with each; n-grams of boundaries alone are left out."""
    text, most = f" {text.lower()} ", max(NGRAMS) - 1
    for at in range(0, len(text), SLICE):
        base = max(0, at - most)
        points = np.frombuffer(text[base : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters()[points]
        codes = np.where(is_letter, points, 0).astype(np.uint64)
        for n in NGRAMS:
            skip = at - base - min(at, n - 1)
            if len(codes) - skip < n:
                continue
            h = np.zeros(len(codes) - skip - n + 1, np.uint64)
            some = np.zeros(len(h), bool)
            for i in range(skip, skip + n):
                h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + len(h)] + np.uint64(n)
                some |= is_letter[i : i + len(h)]
            h ^= h >> np.uint64(29)
            yield ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(50)).astype(np.int64)[some]


def counted(text: str) -> np.ndarray:
    """How often each bucket occurs in a text."""
    total = np.zeros(BUCKETS, np.int64)
    for part in subwords(text):
        total += np.bincount(part, minlength=BUCKETS)
    return total


def _features(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(source):
        at, share = [], []
        for text in strings(b):
            c = counted(text)
            at.append(np.flatnonzero(c).astype(np.int32))
            share.append((c[at[-1]] / max(1, c.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("lang")).cast(pa.string()), pa.array([x.tobytes() for x in at], pa.binary()), pa.array([x.tobytes() for x in share], pa.binary())], names=["lang", "at", "share"])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model | None:
    """rows: language, buckets, their shares of the document."""
    languages = tuple(sorted({r[0] for r in rows}))
    if not languages:
        return None
    rng = np.random.default_rng(SEED)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held = len(rows) // 4 if len(rows) >= 8 else 0
    fit, calibration = rows[held:], rows[:held] or rows
    index = {x: i for i, x in enumerate(languages)}
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)

    def dense(part):
        x = np.zeros((len(part), BUCKETS), np.float32)
        for i, (_, at, share) in enumerate(part):
            x[i, at] = share
        return x, np.array([index[r[0]] for r in part])

    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(fit))
        for s in range(0, len(order), BATCH):
            x, y = dense([fit[i] for i in order[s : s + BATCH]])
            mean = x @ emb
            error = softmax(mean @ out + bias)
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            emb -= rate * (x.T @ (error @ out.T))
            out -= rate * 0.1 * (mean.T @ error)
            bias -= rate * 0.01 * error.sum(axis=0)
    logits = emb @ out
    z = np.concatenate([dense(calibration[s : s + BATCH])[0] @ logits for s in range(0, len(calibration), BATCH)]) + bias
    y = np.array([index[r[0]] for r in calibration])
    grid = np.geomspace(0.25, 8, 41)
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    reject = min(REJECT_AT_MOST, float(np.quantile(right, REJECT_QUANTILE))) if len(right) else 0.0
    return Model(languages, logits.astype(np.float32), bias, temperature, reject)


def fit(docs: DataFrame) -> Model | None:
    """Trains on rows whose crc32(doc_id) mod 5 is not 0 and whose lang is known."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = rows.where("id is not null and lang is not null and crc32(cast(id as binary)) % 5 != 0")
    # the languages with most ids, and about how many ids each has: at most LANGUAGES rows
    ids = known.select("id", "lang")
    languages = cut(ids.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES), "langid-languages").df
    # ids of smallest hash: those under a bound that twice as many as wanted fall under, then the first of them, so the ranking sees about 2 * PER_LANGUAGE rows a language
    share = (F.xxhash64("id") / F.lit(2.0**64) + 0.5) <= F.lit(2.0 * PER_LANGUAGE) / F.col("n")
    near = ids.join(F.broadcast(languages), "lang").where(share).select("id", "lang").distinct()
    chosen = near.withColumn("nth", F.expr("row_number() over (partition by lang order by xxhash64(id), id)")).where(f"nth <= {PER_LANGUAGE}").select("id", "lang")
    # at most PER_LANGUAGE * LANGUAGES rows; of rows that repeat an id one is learned from
    rows = known.join(F.broadcast(cut(chosen, "langid-sample").df), ["id", "lang"]).groupBy("id", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = rows.select("lang", "text").mapInArrow(_features, "lang string, at binary, share binary").collect()
    picked = sorted((r.lang, bytes(r.at), bytes(r.share)) for r in sample)
    return train([(a, np.frombuffer(b, np.int32), np.frombuffer(c, np.float32)) for a, b, c in picked])


def predict(model: Model | None, text: str | None) -> tuple[str, float, bool]:
    """lang_pred, score and whether the prediction is rejected."""
    if model is None or not text:
        return "und", 0.0, True
    total, n = np.zeros(len(model.languages)), 0
    for part in subwords(text):
        total += model.logits[part].sum(axis=0, dtype=np.float64)
        n += len(part)
    if not n:
        return "und", 0.0, True
    p = softmax(((total / n + model.bias) / model.temperature)[None])[0]
    best = int(p.argmax())
    return model.languages[best], float(p[best]), bool(p[best] < model.reject_below)


def _predictor(shared):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches(source):
            got = [predict(model, t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            columns = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every document."""
    model = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, false)").alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predictor(shared), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose prediction isn't rejected; all rows where no lang is known to train on."""
    model = fit(docs)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        return pd.Series([not predict(shared.value, t)[2] for t in texts], dtype=bool)

    return docs.where(keep(F.col("text").cast("string")))


def op10_langid(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
