"""Operator 9: removal of repeated 100-byte strings by a run-length index.

Every 100-byte string (window) has one anchor: the leftmost of its smallest K-byte
hashes. Equal windows have equal anchors at equal offsets, so only windows with the same
anchor hash need comparing, whatever the size of the corpus. Consecutive windows of one
anchor form a context.

1. A pass over the texts gives, per anchor, its hash and a hash of its whole context
   (48 bits each; contexts count as equal if all 96 agree). Equal contexts are a class: all but the earliest hold only repeated windows. A task
   settles its own repeats before anything is shuffled: of a class it sends its earliest context on, and the others' ranges, run together, as marks.
2. The classes' earliest contexts meet by anchor hash. Where an anchor has several
   different contexts, their bytes are fetched and indexed in blocks: a run-compressed
   Burrows-Wheeler transform with sampled ends. Matching statistics are streamed through
   it, from each context's end to its start, and every window whose match starts
   earlier is marked.
3. An anchor with more than HOT different contexts would outgrow a block; its windows are
   compared by 128-bit hashes in an aggregation that combines before it shuffles.
4. Marks meet their text once more and cut it.

Defined results: null text is empty; texts under 100 bytes lose nothing; of rows that
repeat a doc_id, the order is that of the text's hash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runindex import RunLengthIndex
from .shared import batches, bound_batches, cut, keyed, part_rows, restored, utf8

LENGTH, K = 100, 24
SPAN = LENGTH - K + 1
#: Bytes of text a task settles at once; bytes of a block; contexts of an anchor that a block takes; windows worked on at once.
FLUSH, BLOCK, HOT, SLICE = 12 << 20, 1 << 18, 8_000, 1 << 19
BUCKET = 64 << 20  # bytes of text whose contexts meet in one bucket
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
FOUND = "rid long, h long, s int, e int, members int"
MARKS = "rid long, s int, e int"
RECORD = np.dtype([("h", "<i8"), ("c", "<i8"), ("rid", "<i8"), ("s", "<i4"), ("e", "<i4")])
#: Bits of an anchor's and a context's hash that are compared: 48 each, 96 for equal contexts.
BITS = np.int64((1 << 48) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all K-byte strings."""
    n = len(data) - K + 1
    words = np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(8, np.uint8)]), (len(data), 8), (1, 1)).copy().view("<u8").ravel()
    h = (words[:n] * M1) ^ (words[8 : 8 + n] * M2)
    h = (h ^ (h >> np.uint64(29))) * M3 + words[16 : 16 + n] * M1
    h = (h ^ (h >> np.uint64(32))) * M2
    return h ^ (h >> np.uint64(30))


def contexts(data: bytes) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, first window and end of each context of a text."""
    out = []
    for base in range(0, max(1, len(data) - LENGTH + 1), SLICE):
        part = np.frombuffer(data, np.uint8)[base : base + SLICE + LENGTH - 1]
        if len(part) < LENGTH:
            break
        h = gram_hashes(part)
        low = np.uint64((1 << 20) - 1)
        # the smallest hash, leftmost first: place in the low bits; minima of doubling widths
        v, width = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * width <= SPAN:
            v, width = np.minimum(v[:-width], v[width:]), 2 * width
        v = np.minimum(v[: len(part) - LENGTH + 1], v[SPAN - width : SPAN - width + len(part) - LENGTH + 1])
        anchor = (v & low).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        last = np.append(first[1:], len(anchor)) - 1
        # sums of the grams' hashes, plain and by place, tell contexts apart
        a = h * M3
        a ^= a >> np.uint64(31)
        total = np.concatenate([[np.uint64(0)], np.cumsum(a)])
        placed = np.concatenate([[np.uint64(0)], np.cumsum(a * np.arange(1, len(a) + 1, dtype=np.uint64))])
        stop = last + SPAN
        s0 = total[stop] - total[first]
        s1 = placed[stop] - placed[first] - s0 * first.astype(np.uint64)
        c = (s0 * M1) ^ ((s1 ^ (s1 >> np.uint64(29))) * M2) ^ ((anchor[first] - first).astype(np.uint64) * M3) ^ (stop - first).astype(np.uint64)
        c ^= c >> np.uint64(32)
        out.append((h[anchor[first]].view(np.int64) & BITS, c.view(np.int64) & BITS, first + base, last + base + LENGTH))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def settle(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts records by class, then text order; says which are the first of their class."""
    rows = rows[np.lexsort((rows["s"], rows["rid"], rows["c"], rows["h"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["c"][1:] != rows["c"][:-1])
    return rows, new


def packed(rows: np.ndarray) -> bytes:
    """Records in text order, column by column in as few bytes as they need."""
    six = lambda x: np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    steps = np.diff(rows["rid"], prepend=rows["rid"][:1])
    wide = bool(steps.max() >= 1 << 31)
    head = bytes([wide]) + int(rows["rid"][0]).to_bytes(8, "little", signed=True)
    places = steps.astype("<i8" if wide else "<i4").tobytes() + np.ascontiguousarray(rows["s"]).tobytes() + (rows["e"] - rows["s"] - LENGTH).astype(np.uint8).tobytes()
    return head + places + six(rows["h"]) + six(rows["c"])


def unpacked(blob: bytes) -> np.ndarray:
    step = 8 if blob[0] else 4
    n = (len(blob) - 9) // (step + 17)
    rows, at = np.zeros(n, RECORD), 9
    rows["rid"] = int.from_bytes(blob[1:9], "little", signed=True) + np.cumsum(np.frombuffer(blob, f"<i{step}", n, at).astype(np.int64))
    at += step * n
    rows["s"] = np.frombuffer(blob, "<i4", n, at)
    at += 4 * n
    rows["e"] = rows["s"] + LENGTH + np.frombuffer(blob, np.uint8, n, at)
    at += n
    for x in ("h", "c"):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at).reshape(n, 6)
        rows[x] = wide.view("<i8").ravel()
        at += 6 * n
    return rows


def run_together(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rid, start and end of the ranges that records cover; ends grow with starts in a text."""
    rows = rows[np.lexsort((rows["s"], rows["rid"]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows["rid"][1:] != rows["rid"][:-1]) | (rows["s"][1:] > rows["e"][:-1])
    last = np.append(first[1:], True)[: len(rows)]
    return rows["rid"][first], rows["s"][first], rows["e"][last]


def _anchors(buckets: int):
    kinds = [("bucket", pa.int32()), ("blob", pa.binary()), ("rid", pa.int64()), ("s", pa.int32()), ("e", pa.int32())]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent(columns):
            n = next(len(c) for c in columns if c is not None)
            return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[k for k, _ in kinds])

        def flush():
            rows, new = settle(np.concatenate(held))
            yield sent([None, None, *run_together(rows[~new])])
            rows = rows[new]
            bucket = rows["h"] % buckets
            order = np.lexsort((rows["s"], rows["rid"], bucket))
            rows, edges = rows[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            at = np.flatnonzero(edges[1:] > edges[:-1]).tolist()
            for i in range(0, len(at), 64):
                part = at[i : i + 64]
                yield sent([part, [packed(rows[edges[b] : edges[b + 1]]) for b in part], None, None, None])

        for b in batches(source):
            for rid, data in zip(b.column(b.schema.get_field_index("rid")).to_pylist(), utf8(b)):
                h, c, s, e = contexts(data)
                if len(h):
                    rows = np.empty(len(h), RECORD)
                    rows["h"], rows["c"], rows["rid"], rows["s"], rows["e"] = h, c, rid, s, e
                    held.append(rows)
                size += len(data)
                if size >= FLUSH and held:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _classes(key: tuple, table: pa.Table) -> pa.Table:
    """Marks of repeated contexts (members 0), and the contexts of anchors that have several."""
    rows, new = settle(np.concatenate([unpacked(x) for x in table.column("blob").to_pylist()]))
    head = np.flatnonzero(np.diff(rows["h"], prepend=~rows["h"][:1]))
    count = np.add.reduceat(new.astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
    classes = np.repeat(count, np.diff(head, append=len(rows)))
    several = new & (classes > 1)
    marks = rows[~new]
    out = np.concatenate([marks, rows[several]])
    members = np.concatenate([np.zeros(len(marks), np.int64), classes[several]])
    return pa.Table.from_arrays([pa.array(out["rid"]), pa.array(out["h"]), pa.array(out["s"]), pa.array(out["e"]), pa.array(members.astype(np.int32))], names=["rid", "h", "s", "e", "members"])


def _fetch(blocks: int, hot: bool, limit: int):
    """The bytes of open contexts, or the window hashes of those of hot anchors."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source):
            rows = []
            for rid, data, spots in zip(b.column(b.schema.get_field_index("rid")).to_pylist(), utf8(b), b.column(b.schema.get_field_index("spots")).to_pylist()):
                for spot in spots:
                    if (spot["members"] > limit) != hot:
                        continue
                    h, s, e = spot["h"], spot["s"], spot["e"]
                    if hot:
                        for p in range(s, e - LENGTH + 1):
                            rows.append((xxhash.xxh3_128_digest(data[p : p + LENGTH]), rid, p))
                    else:
                        rows.append((h % blocks, h, rid, s, data[s:e]))
            kinds = [("w", pa.binary()), ("rid", pa.int64()), ("p", pa.int32())] if hot else [("block", pa.int32()), ("h", pa.int64()), ("rid", pa.int64()), ("s", pa.int32()), ("data", pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    return run


def repeated_windows(rid: np.ndarray, start: np.ndarray, data: list[bytes]) -> list[tuple[int, int, int]]:
    """(rid, start, end) of runs of windows that occur earlier among these contexts, which are in text order."""
    index = RunLengthIndex(data, LENGTH)
    n = int(index.ends[-1]) + 1
    # a start may be compared if its window lies in its context; the order of starts is that of the text
    where = np.arange(n)
    owner = np.searchsorted(index.starts, where, "right") - 1
    allowed = where + LENGTH <= index.ends[owner]
    index.sampled(allowed, where)
    runs: list[tuple[int, int, int]] = []
    begun = np.full(len(data), -1, np.int64)  # end of the run of marked windows a string is in
    for live, offset, earliest in index.stream():
        place = index.starts[live] + offset
        marked = earliest < place
        opening = marked & (begun[live] < 0)
        begun[live[opening]] = offset[opening] + LENGTH
        closing = ~marked & (begun[live] >= 0)
        last = marked & (offset == 0)
        for i, at in zip(live[closing].tolist(), (offset[closing] + 1).tolist()):
            runs.append((int(rid[i]), int(start[i]) + at, int(start[i] + begun[i])))
        for i in live[last].tolist():
            runs.append((int(rid[i]), int(start[i]), int(start[i] + begun[i])))
        begun[live[closing]] = -1
    return runs


def _index(key: tuple, table: pa.Table) -> pa.Table:
    """Marks of a block: whole anchors at a time, up to BLOCK bytes in one index."""
    table = table.sort_by([("h", "ascending"), ("rid", "ascending"), ("s", "ascending")])
    h, rid, s = (table.column(x).to_numpy() for x in ("h", "rid", "s"))
    data = table.column("data").to_pylist()
    size = np.cumsum([len(x) for x in data])
    runs, at = [], 0
    edges = np.append(np.flatnonzero(np.diff(h)) + 1, len(h))
    while at < len(h):
        full = int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK))
        i = int(np.searchsorted(edges, full, "right")) - 1
        to = int(edges[i]) if i >= 0 and edges[i] > at else int(edges[np.searchsorted(edges, at, "right")])
        runs += in_text_order(rid[at:to], s[at:to], data[at:to])
        at = to
    return pa.Table.from_arrays([pa.array([r[i] for r in runs], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["rid", "s", "e"])


def in_text_order(rid, start, data):
    order = np.lexsort((start, rid))
    return repeated_windows(rid[order], start[order], [data[i] for i in order])


def marks(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """(rid, s, e): byte ranges of rows (rid, text) to remove; they may overlap."""
    parts = part_rows(rows.sparkSession)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sent = cut(rows.select("rid", "text").mapInArrow(_anchors(max(parts, -(-size // BUCKET))), "bucket int, blob binary, rid long, s int, e int"), "anchors").df
    found = cut(sent.where("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(_classes, FOUND), "contexts").df
    own = sent.where("bucket is null").select("rid", "s", "e")
    still = found.where("members > 0")
    size, most = still.agg(F.sum(F.col("e") - F.col("s")), F.max("members")).first()
    settled = own.unionByName(found.where("members = 0").select("rid", "s", "e"))
    if not size:
        return settled
    blocks = max(parts, -(-size // (4 * BLOCK)))
    spots = still.groupBy("rid").agg(F.collect_list(F.struct("h", "s", "e", "members")).alias("spots"))
    opened = rows.join(spots, "rid")  # the same exchange of rows as the last join's, so Spark deals the texts out once
    fetched = opened.mapInArrow(_fetch(blocks, False, hot), "block int, h long, rid long, s int, data binary")
    out = settled.unionByName(fetched.groupBy("block").applyInArrow(_index, MARKS))
    if most > hot:
        windows = opened.mapInArrow(_fetch(blocks, True, hot), "w binary, rid long, p int")
        first = windows.groupBy("w").agg(F.min(F.struct("rid", "p")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "f")
        later = windows.join(first, "w").where("struct(rid, p) <> f")
        # neighbouring windows run together before any text's ranges are collected
        runs = later.select("rid", "p", F.expr("p - row_number() over (partition by rid order by p)").alias("run")).groupBy("rid", "run").agg(F.min("p").alias("s"), (F.max("p") + LENGTH).alias("e"))
        out = out.unionByName(runs.select("rid", "s", "e"))
    return out


def _cutter(with_text: bool):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source):
            out = []
            for data, ranges in zip(utf8(b), b.column(b.schema.get_field_index("ranges")).to_pylist()):
                kept, end, removed, spans = [], 0, 0, 0
                for s, e in sorted((r["s"], r["e"]) for r in ranges or ()):
                    if s > end or not spans:
                        kept.append(data[end:s])
                        spans += 1
                        removed -= s
                        removed += e
                        end = e
                    elif e > end:
                        removed += e - end
                        end = e
                kept.append(data[end:])
                left = b"".join(kept)
                out.append((len(data), removed, spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
            kinds = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("rid", "doc_id")] + [pa.array([r[i] for r in out], k) for i, (_, k) in enumerate(kinds)], names=["rid", "doc_id", *(n for n, _ in kinds)])

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """rid, doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept_text."""
    return trimmed(keyed(docs)[0], with_text, hot)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, all columns, with the repeated bytes cut from text (letters cut in half go too); n_chars follows."""
    rows, _ = keyed(docs, carry=True)
    texts = trimmed(rows, with_text=True).select("rid", F.col("kept_text").alias("text"))
    out = restored(rows.select("rid", "others").join(texts, "rid"), docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def trimmed(rows: DataFrame, with_text: bool, hot: int = HOT) -> DataFrame:
    bound_batches(rows.sparkSession)
    rows = rows.select("rid", "doc_id", "text").where("rid is not null")
    ranges = marks(rows, hot).groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    joined = rows.join(ranges, "rid", "left")
    return joined.mapInArrow(_cutter(with_text), "rid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def op9_suffix_array(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid", "kept_text")
