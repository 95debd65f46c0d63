"""Operator 6: nearest neighbours by randomly rotated one-bit codes with error bounds.

Every vector is normalised and turned by one random rotation; its code is the signs of the
turned coordinates, packed to bits, beside two correction scalars: its norm and the
product of the code's unit vector with the turned unit vector. A turned query is rounded
to QUERY_BITS bits a coordinate; its product with a code is then popcounts of bit planes,
and dividing by the second scalar gives an unbiased estimate with a bound on its error
(random for the code's residual, exact for the query's rounding). Short vectors are turned
within LEAST_BITS dimensions, as the bound narrows with the root of the code's length. Per
query and tile, the exact products of those with the best estimates give a threshold: all
others whose upper bound reaches it are reranked by the exact product in double precision.

Equal vectors are one candidate (a class), scored once; its TOP + 1 smallest ids are all
that a ranking with ties to smaller ids can use, and travel with it. Candidates and queries
meet in tiles of bounded size: CANDIDATES x QUERIES vectors; each tile gives TOP rows a
query, merged by a ranking whose first step runs before the shuffle. Codes are made once and
travel with their vectors in the table's own type, so that a tile reranks without a join.

Defined results: null or zero vectors and those holding null or non-finite components take
no part; vectors of different length don't meet; rows that repeat vec_id and vector count
once; equal scores go to smaller vec_id; no candidates, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches, cut

TOP, EVERY, QUERY_BITS, LEAST_BITS, SEED = 20, 20, 4, 256, 23
#: Width of the bound in standard deviations of the code's error; vectors of a tile.
WIDTH, CANDIDATES, QUERIES = 2.5, 65_536, 16_384


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """The same random orthonormal map in every task: bits x dim."""
    bits = max(LEAST_BITS, -(-dim // 64) * 64)
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).normal(size=(bits, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs (uint64 words), norms, and products of code and turned unit vector."""
    norm = np.linalg.norm(x, axis=1)
    turned = (x / norm[:, None]) @ rotation(x.shape[1]).T
    along = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64), norm, along


class Rounded:
    """A turned query in QUERY_BITS bits a coordinate, as bit planes."""

    def __init__(self, query: np.ndarray):
        turned = rotation(len(query)) @ query
        self.low, high = turned.min(), turned.max()
        self.step = max((high - self.low) / ((1 << QUERY_BITS) - 1), 1e-300)
        level = np.rint((turned - self.low) / self.step).astype(np.int64)
        planes = ((level >> np.arange(QUERY_BITS)[:, None]) & 1).astype(bool)
        self.planes = np.packbits(planes, axis=1, bitorder="little").view(np.uint64)
        self.sum, self.bits = int(level.sum()), len(turned)
        self.norm = float(np.linalg.norm(query))
        # what rounding does to a product of signs: independent of the code, so it adds up as noise
        self.off = float(np.linalg.norm(level * self.step + self.low - turned))


def bounds(codes: np.ndarray, ones: np.ndarray, norm: np.ndarray, along: np.ndarray, query: Rounded) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the inner products of a query with coded vectors, and their errors' bounds."""
    hit = np.zeros(len(codes), np.int64)
    for bit, plane in enumerate(query.planes):
        hit += np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << bit
    # signs . rounded query, from the bits: 2 * (those set) - (all)
    product = query.step * (2 * hit - query.sum) + query.low * (2 * ones - query.bits)
    root = np.sqrt(query.bits)
    residual = np.sqrt(np.maximum(1 - along**2, 0)) / np.sqrt(query.bits - 1) * query.norm
    return norm * product / (root * along), WIDTH * norm / along * np.hypot(residual, query.off / root)


def rank_tile(ids: list[list[int]], x: np.ndarray, coded: tuple[np.ndarray, np.ndarray, np.ndarray], queries: list[tuple[int, np.ndarray]], top: int = TOP) -> Iterator[tuple[int, int, float]]:
    """(query, vec_id, score): each query's best rows among the classes x, whose codes and smallest ids are given."""
    codes, norm, along = coded
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    wanted = top + 1  # a query's own class may hold nothing but itself
    for query_id, q in queries:
        if len(x) > 4 * wanted:
            estimate, error = bounds(codes, ones, norm, along, Rounded(q))
            first = np.argpartition(estimate, len(x) - 2 * wanted)[-2 * wanted :]
            least = np.sort(np.einsum("ij,j->i", x[first], q))[-wanted]
            chosen = np.union1d(first, np.flatnonzero(estimate + error >= least))
        else:
            chosen = np.arange(len(x))
        score = np.einsum("ij,j->i", x[chosen], q)
        if len(score) > wanted:
            least = np.partition(score, len(score) - wanted)[len(score) - wanted]
            near = np.flatnonzero(score >= least)  # with all ties
            chosen, score = chosen[near], score[near]
        rows = sorted((-s, i) for c, s in zip(chosen.tolist(), score.tolist()) for i in ids[c] if i != query_id)
        for s, i in rows[:top]:
            yield query_id, i, -s


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _encoded(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the codes (binary), norms and products to classes; a batch may hold vectors of several lengths."""
    for b in batches(source):
        dims = b.column(b.schema.get_field_index("dim")).to_numpy()
        bits, norm, along = [b""] * len(dims), np.zeros(len(dims)), np.zeros(len(dims))
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            codes, norm[at], along[at] = encode(matrix(b.column(b.schema.get_field_index("v")).take(pa.array(at))))
            for i, c in zip(at, codes):
                bits[i] = c.tobytes()
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bits, pa.binary()), pa.array(norm), pa.array(along)], names=[*b.schema.names, "bits", "norm", "along"])


def _tile(top: int):
    names = ["query_id", "vec_id", "score"]
    kinds = [pa.int64(), pa.int64(), pa.float64()]

    def run(key: tuple, candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not candidates.num_rows or not queries.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        codes = np.frombuffer(b"".join(candidates.column("bits").to_pylist()), np.uint64).reshape(candidates.num_rows, -1)
        coded = codes, candidates.column("norm").to_numpy(), candidates.column("along").to_numpy()
        asked = list(zip(queries.column("query_id").to_pylist(), matrix(queries.column("v"))))
        rows = list(rank_tile(candidates.column("ids").to_pylist(), matrix(candidates.column("v")), coded, asked, top))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return run


def nearest(vectors: DataFrame, top: int = TOP, every: int = EVERY, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of each row whose vec_id is divisible by `every`."""
    v, own = F.col("v"), vectors.schema["embedding"].dataType.simpleString()
    kind = own if own == "array<float>" else "array<double>"  # floats are doubles in half the bytes
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v")).where(
        v.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    code = F.xxhash64(F.transform(v, lambda x: x.cast("double") + F.lit(0.0)))
    members = cut(rows.select("vec_id", "v", code.alias("code"), F.size(v).alias("dim")).distinct(), "vectors").df
    # the limit on a class runs before the shuffle too, so a vector of many rows is few rows a task
    smallest = members.withColumn("nth", F.expr("row_number() over (partition by code, v order by vec_id)")).where(F.col("nth") <= top + 1)
    classes = smallest.groupBy("code", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("dim").alias("dim"))
    shape = f"class_id long, ids array<long>, dim int, v {kind}"
    classes = cut(classes.select(F.col("ids")[0].alias("class_id"), "ids", "dim", "v").mapInArrow(_encoded, f"{shape}, bits binary, norm double, along double"), "classes").df
    asked = members.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "dim", "v")
    n, m = classes.count(), asked.count()
    across, down = max(1, -(-n // candidates), min(8, -(-n // 1024))), max(1, -(-m // queries), min(4, -(-m // 256)))
    side = lambda df, key, own, parts, other, extent: df.withColumn(own, F.expr(f"cast(pmod(xxhash64({key}), {parts}) as int)")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(extent - 1))))
    left = side(classes, "class_id", "a", across, "d", down).groupBy("dim", "a", "d")
    right = side(asked, "query_id", "d", down, "a", across).groupBy("dim", "a", "d")
    found = left.cogroup(right).applyInArrow(_tile(top), "query_id long, vec_id long, score double")
    final = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)")).where(F.col("rank") <= top)
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
