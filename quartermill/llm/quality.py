"""Operator 2: quality classifier on random-indexing word vectors and a two-layer network.

Every hashed word and every pseudo-word has a sparse ternary index vector. A word's
vector is the sum of the index vectors around it over all documents, its length made one:
random indexing, one pass, and sums of tasks merge by adding. Pseudo-words carry what a
spelling cannot: a word's shape (case, digits, the marks around it) and whether a word or
a run of three words has been seen before in the text. A document is the mean of its
words' vectors beside the mean of its pseudo-words' vectors. A network with one hidden
layer, in numpy, gives the odds; one temperature, fitted on rows the network hasn't
seen, calibrates them.

Only the fit of the network is on a bounded sample: at most SAMPLE labelled documents, one row an id, picked by the
hash of doc_id among those whose crc32(doc_id) mod 4 is not 2. The vectors have a fixed
size (WORDS + SHAPES rows), so broadcasting them doesn't grow with the data.

Defined results: null text scores as empty text; with labels of one kind only, every score
is that kind's value (0.5 without any); several labels of one doc_id count as their
largest; repeated rows each get a row; an empty table gives none.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches, bound_batches, cut, utf8

WORDS, SHAPES, DIM, NONZERO, SPAN = 1 << 14, 1 << 8, 48, 6, 2
SAMPLE, HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 12_000, 24, 60, 128, 0.01, 1e-4, 5
CHUNK = 3_000  # words worked on at once: each adds 10 at most to a field, of 2^15
FAN, FEW = 16, 4  # partial sums added in one task; partial sums that the driver adds
KEEP_FROM = 0.7
UNKNOWN = 0.5  # every score where no label can be used
#: Words whose features a task remembers; the memory is emptied when full.
REMEMBERED = 200_000
MARKS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def index_vectors() -> np.ndarray:
    """The fixed ternary index vectors."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((WORDS + SHAPES, DIM), np.float32)
    for row in out:
        row[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


def shape_id(name: bytes) -> int:
    return WORDS + zlib.crc32(name) % SHAPES


AGAIN, TRIPLE = shape_id(b"again"), shape_id(b"triple again")


def word_rows(word: bytes) -> int:
    """A word's row and, in the lowest 16 bits, its shape's row."""
    core = word.strip(MARKS)
    text = core if core.isascii() else core.decode("utf-8", "replace")  # bytes know the case of ASCII letters
    case = b"none" if not core else b"digit" if text.isdigit() else b"upper" if text.isupper() and len(text) > 1 else b"title" if text[:1].isupper() else b"lower" if text.islower() else b"mixed"
    at = word.find(core) if core else len(word)
    before, after = word[:at], word[at + len(core) :]
    inner = b"i" if not core.isalnum() and core.translate(None, MARKS) != core else b""
    length = b"%d" % min(4, len(text) // 6)
    low = text.lower()
    return zlib.crc32(low if text is core else low.encode()) % WORDS << 16 | shape_id(b" ".join((case, before[:3], after[-3:], inner, length)))


class Known(dict):
    """Rows of the words met so far."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = word_rows(word)
        return got


class Reader:
    """Words of texts as row numbers of the vectors."""

    def __init__(self):
        self.known = Known()

    def ids(self, data: bytes) -> np.ndarray:
        """words x 2: the word's row and its shape's row."""
        words = data.split()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        rows = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        return np.stack((rows >> 16, rows & 0xFFFF), axis=1)


def repeats(words: np.ndarray) -> tuple[int, int]:
    """Words equal to the one before; runs of three words seen before in the text."""
    if len(words) < 3:
        return int((words[1:] == words[:-1]).sum()), 0
    w = words.astype(np.int64)
    runs = (w[:-2] * WORDS + w[1:-1]) * WORDS + w[2:]
    return int((w[1:] == w[:-1]).sum()), len(runs) - len(np.unique(runs))


def pooled(vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A document's features: the mean vector of its words, and of its pseudo-words."""
    if not len(ids):
        return np.zeros(2 * DIM, np.float32)
    again, triple = repeats(ids[:, 0])
    shapes = vectors[ids[:, 1]].sum(axis=0) + again * vectors[AGAIN] + triple * vectors[TRIPLE]
    return np.concatenate([vectors[ids[:, 0]].mean(axis=0), shapes / len(ids)])


def in_fields(vectors: np.ndarray) -> np.ndarray:
    """Rows of small whole numbers, four to an int64: sums of rows are sums of fields while these stay within 16 bits."""
    wide = vectors.astype(np.int64).reshape(len(vectors), -1, 4)
    return (wide << np.array([0, 16, 32, 48])).sum(axis=2)


def from_fields(rows: np.ndarray) -> np.ndarray:
    out, left = np.empty((*rows.shape, 4), np.int64), rows.copy()
    for k in range(4):
        out[..., k] = left.astype(np.int16)  # the lowest field, with its sign
        left = (left - out[..., k]) >> 16
    return out.reshape(len(rows), -1)


def added_contexts(total: np.ndarray, index: np.ndarray, ids: np.ndarray) -> None:
    """Adds to each row of total the index vectors (in fields) around its words; ids are texts with SPAN gaps (the last row of index) around each."""
    for at in range(SPAN, len(ids) - SPAN, CHUNK):
        part = ids[at - SPAN : min(at + CHUNK, len(ids) - SPAN) + SPAN]
        own, n = index[part[:, 0]] + index[part[:, 1]], len(part) - 2 * SPAN
        around = sum(own[SPAN + k : SPAN + k + n] for k in range(-SPAN, SPAN + 1) if k)
        middle = part[SPAN : SPAN + n].astype(np.uint16)
        for column, values in ((0, around + index[middle[:, 1]]), (1, around)):
            order = np.argsort(middle[:, column], kind="stable")
            rows = middle[order, column]
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            total[rows[first]] += from_fields(np.add.reduceat(values[order], first, axis=0))


def _contexts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sum of the index vectors around each word; one row. Sums are whole numbers, so their order is of no account."""
    index = np.concatenate([index_vectors(), np.zeros((1, DIM), np.float32)])
    fields = in_fields(index)
    total, reader, gap = np.zeros(index.shape), Reader(), np.full((SPAN, 2), len(index) - 1)
    held, size = [gap], 0
    for b in batches(source):
        for data in utf8(b):
            ids = reader.ids(data)
            if not len(ids):
                continue
            held += [ids, gap]
            size += len(ids)
            again, triple = repeats(ids[:, 0])
            total[AGAIN] += again * index[AGAIN]
            total[TRIPLE] += triple * index[TRIPLE]
            if size >= 32 * CHUNK:
                added_contexts(total, fields, np.concatenate(held))
                held, size = [gap], 0
    if size:
        added_contexts(total, fields, np.concatenate(held))
    yield pa.RecordBatch.from_pydict({"sums": pa.array([total[:-1].tobytes()], pa.binary())})


def _added(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of a task's rows; one row."""
    total = np.zeros((WORDS + SHAPES) * DIM)
    for b in batches(source):
        for x in b.column(0).to_pylist():
            total += np.frombuffer(x)
    yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Random-indexing vectors from the contexts of all texts: each task gives one sum of fixed size, which are added FAN at a time until FEW are left."""
    sums = cut(texts.select("text").mapInArrow(_contexts, "sums binary"), "quality-sums")
    while (n := sums.df.count()) > FEW:
        sums, spent = cut(sums.df.repartition(-(-n // FAN)).mapInArrow(_added, "sums binary"), "quality-sums"), sums
        spent.drop()
    total = sum((np.frombuffer(bytes(r.sums)) for r in sums.df.collect()), np.zeros((WORDS + SHAPES) * DIM)).reshape(-1, DIM)
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: tuple[np.ndarray, ...]  # hidden weights and bias, output weights and bias
    temperature: float
    constant: float | None = None  # the score where the labels are of one kind, UNKNOWN where there are none

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return sigmoid(logit(self.layers, (x - self.mean) / self.spread) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logit(layers, x):
    w1, b1, w2, b2 = layers
    return np.tanh(x @ w1 + b1) @ w2 + b2


def train(vectors: np.ndarray, x: np.ndarray, y: np.ndarray) -> Model:
    """Adam on the logistic loss; a fifth of the rows only sets the temperature."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(x))
    held = len(x) // 5
    z, y = ((x - mean) / spread)[order].astype(np.float64), y[order].astype(np.float64)
    layers = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for part in np.array_split(held + rng.permutation(len(z) - held), max(1, (len(z) - held) // BATCH)):
            a, t = z[part], y[part]
            hidden = np.tanh(a @ layers[0] + layers[1])
            error = (sigmoid(hidden @ layers[2] + layers[3]) - t) / len(t)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            slopes = [a.T @ back + DECAY * layers[0], back.sum(axis=0), hidden.T @ error + DECAY * layers[2], error.sum()]
            step += 1
            for i, s in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * s
                second[i] = 0.999 * second[i] + 0.001 * s * s
                layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    temperature = 1.0
    if held:
        out, t = logit(layers, z[:held]), y[:held]
        grid = np.geomspace(0.25, 16, 61)
        loss = [-np.log(np.where(t == 1, sigmoid(out / g), 1 - sigmoid(out / g)) + 1e-12).mean() for g in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return Model(vectors, mean, spread, tuple(layers), temperature)


def _pooler(shared):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in batches(source):
            x = [pooled(shared.value, reader.ids(d)).tobytes() for d in utf8(b)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("id")), b.column(b.schema.get_field_index("quality")), pa.array(x, pa.binary())], names=["id", "quality", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.select(F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("int").alias("quality")).where("id is not null and quality in (0, 1) and crc32(cast(id as binary)) % 4 != 2")
    texts = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    # ids first, so that at most SAMPLE texts are kept; labels of documents that are gone don't count
    usable = cut(known.groupBy("id").agg(F.max("quality").alias("quality")).join(texts.select("id").distinct(), "id"), "quality-ids")
    # those of smallest hash: no more than about twice as many as wanted are sorted
    under = F.xxhash64("id") / F.lit(2.0**64) + 0.5 <= 2.0 * SAMPLE / max(1, usable.df.count())
    picked = cut(usable.df.where(under).orderBy(F.xxhash64("id"), "id").limit(SAMPLE), "quality-picked")
    # at most SAMPLE rows; of rows that repeat an id one is learned from
    one = texts.join(F.broadcast(picked.df), "id").groupBy("id").agg(F.max("quality").alias("quality"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = cut(one, "quality-sample")
    vectors = word_vectors(texts)
    shared = spark.sparkContext.broadcast(vectors)
    rows = sorted((r.id, r.quality, bytes(r.x)) for r in sample.df.mapInArrow(_pooler(shared), "id string, quality int, x binary").collect())
    sample.drop()
    kinds = {r[1] for r in rows}
    if len(kinds) < 2:
        return Model(vectors, np.zeros(2 * DIM), np.ones(2 * DIM), (), 1.0, float(kinds.pop()) if kinds else UNKNOWN)
    return train(vectors, np.array([np.frombuffer(r[2], np.float32) for r in rows], np.float64), np.array([r[1] for r in rows]))


def scored(model: Model, reader: Reader, data: list[bytes]) -> np.ndarray:
    return model.scores(np.array([pooled(model.vectors, reader.ids(d)) for d in data], np.float64).reshape(len(data), 2 * DIM))


def _scorer(shared):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for b in batches(source):
            s = scored(shared.value, reader, utf8(b))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("doc_id", "held_out")] + [pa.array(s, pa.float64()), pa.array((s >= KEEP_FROM).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, false)").alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(shared), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are predicted to be of quality; all rows where no label can be used."""
    model = fit(docs, labels)
    if model.constant == UNKNOWN:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keep(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader()  # one a task
        for texts in parts:
            yield pd.Series(scored(shared.value, reader, [(t or "").encode() for t in texts]) >= KEEP_FROM)

    return docs.where(keep(F.col("text").cast("string")))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
