"""Operator 5: byte-level BPE by overlapping chunks, and decoding by raw bytes.

A text is cut into chunks of CHUNK code points; each chunk also sees OVERLAP points of the
next. Chunks are pre-tokenised in parallel, each from its own start. A pre-token boundary
that two neighbours both find in their overlap is where the later chunk has
resynchronised: from there on both see the same pre-tokens, and by induction from the
text's start these are the true ones. Pieces between such boundaries are encoded in
parallel and digested in order. Only boundaries behind a non-space are used, so a piece's
last pre-token never depends on what follows it. A text whose neighbours share no such
boundary (say, one word longer than the overlap) is put together again and encoded as one
piece, which is exact too. Texts of one chunk need no seam.

Defined results: null text is empty; empty text has no tokens; repeated rows each get a
row; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches, bound_batches, cut, part_rows, strings

CHUNK, OVERLAP = 32_768, 512
FIRST = "rid long, doc_id long, k int, n int, n_tokens long, ids_sha256 string, decoded_sha256 string, start long, body string, head array<long>, tail array<long>"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """A rank file's encoder and decoder; one per Python worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        size = max(self.ranks.values()) + 1
        self.raw = [b""] * size
        for token, i in self.ranks.items():
            self.raw[i] = token
        self.decimal = [str(i) for i in range(size)]
        # \s of the rank files' library is Unicode White_Space
        self.pre = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def named(self, ids) -> bytes:
        return ",".join(map(self.decimal.__getitem__, ids)).encode()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def seams(pre, body: str, start: int, chunk: int, overlap: int, last: bool) -> tuple[list[int], list[int]]:
    """Absolute pre-token boundaries behind a non-space: those in the chunk's first `overlap`
    points, and the certain ones in its overlap with the next chunk."""
    head, tail = [], []
    size = len(body)
    for m in pre.finditer(body):
        e = m.end()
        if not last and e + 2 > size:  # what follows the chunk may change this pre-token
            break
        if (e <= overlap or e >= chunk) and not body[e - 1].isspace():
            if e <= overlap:
                head.append(start + e)
            if chunk <= e <= chunk + overlap:
                tail.append(start + e)
    return head, tail


def _first(path: str, pattern: str, chunk: int, overlap: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches(source):
            out = []
            get = lambda name: b.column(b.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
            for rid, doc, k, n, start, body in zip(get("rid"), get("doc_id"), get("k"), get("n"), get("start"), strings(b, "body")):
                if n == 1:
                    ids = c.encode(body)
                    out.append((rid, doc, k, n, len(ids), hashlib.sha256(c.named(ids)).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest(), start, None, None, None))
                else:
                    out.append((rid, doc, k, n, None, None, None, start, body, *seams(c.pre, body, start, chunk, overlap, k == n - 1)))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in FIRST.split(", ")])

    return run


def _pieces(path: str, pattern: str):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches(source):
            ids = [array("I", c.encode(x)).tobytes() for x in strings(b, "body")]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in ("rid", "doc_id", "k")] + [pa.array(ids, pa.binary())], names=["rid", "doc_id", "k", "ids"])

    return run


def _digests(path: str, pattern: str):
    """Digests ids in order of (rid, k); holds one piece at a time."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        now, doc, n, named, raw = None, None, 0, hashlib.sha256(), hashlib.sha256()

        def row():
            return pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "n_tokens": pa.array([n], pa.int64()), "ids_sha256": [named.hexdigest()], "decoded_sha256": [raw.hexdigest()]})

        for b in batches(source):
            for rid, d, _, data in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("rid", "doc_id", "k", "ids"))):
                if rid != now:
                    if now is not None:
                        yield row()
                    now, doc, n, named, raw = rid, d, 0, hashlib.sha256(), hashlib.sha256()
                ids = array("I")
                ids.frombytes(data)
                if len(ids):
                    named.update((b"," if n else b"") + c.named(ids))
                    raw.update(c.decode(ids))
                    n += len(ids)
        if now is not None:
            yield row()

    return run


def encode_decode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of decoded bytes, for every whole text."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.greatest(F.ceil(F.length("text") / chunk), F.lit(1)).cast("int"))
    chunks = rows.select("rid", "doc_id", "n", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    chunks = chunks.select("rid", "doc_id", "k", "n", (F.col("k").cast("long") * chunk).alias("start"), F.when(F.col("n") == 1, F.col("text")).otherwise(F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap))).alias("body"))
    first = cut(chunks.mapInArrow(_first(path, pattern, chunk, overlap), FIRST), "bpe-chunks").df
    short = first.where("n = 1").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

    doc = "(partition by rid order by k)"
    seam = first.where("n > 1").select("rid", "doc_id", "k", "n", "start", "body", F.expr(f"case when k = 0 then 0L else array_min(array_intersect(head, lag(tail) over {doc})) end").alias("sync"))
    seam = seam.select("*", F.expr(f"lead(sync) over {doc}").alias("next"), F.expr("max(sync is null) over (partition by rid)").alias("apart"))
    piece = F.when(F.col("k") == F.col("n") - 1, F.expr("substring(body, cast(sync - start as int) + 1)")).otherwise(F.expr("substring(body, cast(sync - start as int) + 1, cast(next - sync as int))"))
    stitched = seam.where("not apart").select("rid", "doc_id", "k", piece.alias("body"))
    own = F.expr(f"case when k = n - 1 then body else substring(body, 1, {chunk}) end")
    whole = seam.where("apart").groupBy("rid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("k", own.alias("b")))).alias("s")).select("rid", "doc_id", F.lit(0).alias("k"), F.array_join(F.col("s.b"), "").alias("body"))
    parts = part_rows(docs.sparkSession)
    ids = stitched.unionByName(whole).repartition(parts, "rid", "k").mapInArrow(_pieces(path, pattern), "rid long, doc_id long, k int, ids binary")
    long = ids.repartition(parts, "rid").sortWithinPartitions("rid", "k").mapInArrow(_digests(path, pattern), RESULT)
    return short.unionByName(long)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
