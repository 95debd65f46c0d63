"""Operator 1: best-fit-decreasing packing with certified bin counts and exchange of documents.

Each text becomes ids plus the closing id 0 and, only if longer than a sequence, pieces.
Pieces are dealt to groups of bounded size; each group packs best-fit decreasing and
compares its bin count with the best lower bound of two families of dual feasible
functions. A group that meets the bound is certified optimal and gives up only its least
filled bin; a group with a gap gives up every bin with room. What was given up is dealt
anew to fewer groups, so that documents of different groups meet, and packed again, until
the bin count meets the bound of all pieces together or an exchange saves no bin.

ids are those of the tokenizer file (no special tokens added). They are computed with
the file's own vocabulary as ranks, if its merges are in the order of their ranks; a text that holds one of the file's special strings,
or characters outside the blocks where both libraries' tables are known to agree, goes
through the tokenizer library itself.

Defined results: null text is empty and gives the one id 0; repeated rows are packed one
by one; an empty table gives no rows.
"""

from __future__ import annotations

import json
import logging
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches, bound_batches, cut, strings

CAPACITY, GROUP_ROWS = 2048, 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", row long, sequence_id long, offset long, given_up boolean"
#: Blocks where the libraries agree on letters, digits and spaces; control characters are left out.
PLAIN = r"\t\n\r\x20-\x7e\xa0-\u0377\u0388-\u03ff\u0400-\u04ff\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3001\u3002\u3041-\u3096\u4e00-\u9fa5\uac00-\ud7a3"


class Ids:
    """The ids of a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # byte-level files write each byte as a printable character: printable Latin-1 as itself, the rest from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*own}))}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        made = [spec["model"]["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
        ordered = None not in made and all(a < b for a, b in zip(made, made[1:]))
        # merges in another order than their ranks: all texts go through the library
        self.slow = re.compile("|".join([f"[^{PLAIN}]", *map(re.escape, special)]) if ordered else "").search

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids if self.slow(text) else self.fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def cuts(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the remainder comes first."""
    first = total % capacity or min(total, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, total, capacity)]


def _tokenise(path: str, capacity: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ids_of(path).encode
        for b in batches(source):
            rows = []
            for doc, text in zip(b.column(b.schema.get_field_index("doc_id")).to_pylist(), strings(b)):
                ids = encode(text)
                ids.append(0)
                data = np.array(ids, "<u4").tobytes()
                rows += [(doc, k, at, n, zlib.crc32(data[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(cuts(len(ids), capacity))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def lower_bound(lengths: np.ndarray | dict[int, int], capacity: int) -> int:
    """The best bin count that dual feasible functions prove necessary, from lengths or from their counts."""
    if isinstance(lengths, dict):
        count = np.zeros(capacity + 1, np.int64)
        count[list(lengths)] = list(lengths.values())
    else:
        count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    total = int((count * x).sum())
    best = -(-total // capacity)
    # threshold functions: lengths under e count 0, those over capacity - e a whole bin
    mass, number = np.cumsum(count * x), np.cumsum(count)
    e = np.arange(1, capacity // 2 + 1)
    worth = mass[capacity - e] - mass[e - 1] + (number[capacity] - number[capacity - e]) * capacity
    best = max(best, int(-(-worth.max() // capacity)))
    # rounding functions: (k + 1) x / capacity rounded down counts 1 / k each, unless whole
    for k in range(1, 33):
        scaled = (k + 1) * x
        whole = scaled % capacity == 0
        worth = np.where(whole, k * x, scaled // capacity * capacity)
        best = max(best, int(-(-int((count * worth).sum()) // (k * capacity))))
    return best


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit in the order given: bin and offset of each length, and each bin's room."""
    bins, offsets, room = [], [], []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for n in lengths:
        fitting = open_rooms >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins.append(b)
        offsets.append(capacity - r)
        room[b] = r - n
        by_room[r - n].append(b)
        open_rooms |= 1 << (r - n)
    return bins, offsets, room


def _pack(capacity: int, turn: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending")])
        lengths = table.column("length").to_numpy()
        bins, offsets, room = best_fit(lengths.tolist(), capacity)
        certified = len(room) == lower_bound(lengths, capacity)
        least = max(range(len(room)), key=room.__getitem__)
        give = [(b == least or not certified) and room[b] > 0 for b in range(len(room))]
        base = (turn << 56) + (key[0].as_py() << 28)
        out = table.select(["doc_id", "piece", "start", "length", "ids_crc32", "row"])
        return out.append_column("sequence_id", pa.array([base + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64())).append_column("given_up", pa.array([give[b] for b in bins]))

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Pieces of all documents with their place in a sequence."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbered = rows.mapInArrow(_tokenise(path, capacity), PIECES).withColumn("row", F.monotonically_increasing_id())
    pieces = cut(numbered, "pack-pieces").df
    # one row a length: at most `capacity`
    lengths = {r.length: r.n for r in pieces.where(F.col("length") < capacity).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    bound = lower_bound(lengths, capacity)
    full = pieces.where(F.col("length") == capacity).select("*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out, left, count = full, pieces.where(F.col("length") < capacity), sum(lengths.values())
    turn, settled, before, more = 0, 0, None, count > 0
    while more:
        turn += 1
        groups = -(-count // group_rows)
        # a row's own number deals it, so rows that repeat don't meet in one group
        dealt = left.withColumn("g", F.expr(f"cast(pmod(xxhash64(row, {turn}), {groups}) as long)"))
        packed = cut(dealt.groupBy("g").applyInArrow(_pack(capacity, turn), PACKED), f"pack-{turn}").df
        # a bin's first piece stands for it
        bins, gave, count = packed.selectExpr("count_if(offset = 0)", "count_if(offset = 0 and given_up)", "count_if(given_up)").first()
        more = groups > 1 and gave > 0 and settled + bins > bound and (before is None or bins < before)
        out = out.unionByName((packed.where("not given_up") if more else packed).drop("given_up"))
        left, before, settled = packed.where("given_up").drop("given_up", "sequence_id", "offset"), gave, settled + bins - (gave if more else 0)
    logging.getLogger(__name__).info("packing: %d sequences besides the full ones, at least %d needed, %d turns", settled, bound, turn)
    return out.drop("row")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
