"""Operator 3: near-duplicates by one-permutation hashing, banded buckets and star-shaped edges.

One hash of every shingle is split into BINS ranges; a range's smallest hash is its
signature value, and an empty range borrows from one that is not, probed in a fixed
random order (optimal densification); what PROBES tries leave empty, in sets of few shingles,
takes the element that comes first in an order of the range's own. BANDS bands of ROWS values make buckets. Equal
shingle sets form a class first, so copies are one member of any bucket.

In a bucket every member is compared with one centre only (a star), so pairs grow with the
bucket, not with its square. Links are confirmed on full shingle sets. To lose none,
members of buckets that are still in several components meet again by their rarest
shingles: of those among them, ordered by how many hold them, a text is put under as many
of its first as any text similar to it must share one of (rare_first), which is exact and
keeps texts apart that share a passage and no more. Such a bucket stays
open while its members lie in more than one component: it takes the smallest ids of its
smallest components as centres, until one component or one member is left. Pairs whose
places in the order leave no room for enough overlap are never made; those whose sketches
(one bit of each of SKETCH signature values) differ in over
unlike() bits are refuted at once: at the similarity asked for that is six standard deviations away. So every pair of an
open bucket is either in one component or has been confirmed or refuted.

At similarity 0.8 a pair misses all bands with probability (1 - 0.8^ROWS)^BANDS = 5e-6.
For another similarity banding() chooses rows and bands that miss no more.

Defined results: null, empty or blank text has no shingles, links with nothing and is
kept; a text of fewer words than a shingle is one shingle of the whole sequence; rows that
repeat a doc_id are documents of their own, and kept says doc_id = component_id of each; null
doc_ids come after all others, so one is a component_id only where its component has no other;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import batches, bound_batches, cut, keyed, part_rows, restored, utf8

SHINGLE, SIMILARITY = 4, 80  # words; per cent
ROWS, BANDS, SEED = 6, 40, 41
CENTRES = 12
SKETCH = 1024
CENTRE_PAIRS = 1_000  # pairs with one centre that a task takes
PROBES = 512
REST = 1 << 16  # hashes at a time for ranges that no probe filled
SIGNATURE = "rid long, doc_id long, n long, digest binary, bands array<long>"


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTES = np.random.default_rng(SEED).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of BASE and of its inverse, as long as the longest text so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 16)
            both = np.ones((2, size), np.uint64)
            both[0, 1:], both[1, 1:] = np.uint64(BASE), np.uint64(UNBASE)
            cls.up, cls.down = np.cumprod(both, axis=1, dtype=np.uint64)
        return cls.up, cls.down


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of a text's words, A-Z lowered, cut at x20 and x09-x0D."""
    b = np.frombuffer(data.lower(), np.uint8)  # of bytes, lower() changes A-Z alone
    inside = ~SPACE[b]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    first, end = edge[::2], edge[1::2]
    up, down = Powers.to(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTES[b] * up[: len(b)], out=total[1:])
    return mixed((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    if not len(words):
        return words
    width = min(size, len(words))
    h = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(h)])
    return np.unique(h)


def unlike(similarity: float) -> int:
    """Bits of a sketch expected to differ at a similarity (per cent), and six deviations."""
    p = (1 - similarity / 100) / 2
    return int(SKETCH * p + 6 * (SKETCH * p * (1 - p)) ** 0.5)


def banding(similarity: float, rows: int, count: int) -> tuple[int, int]:
    """Rows and bands for a similarity that miss no more than these do at SIMILARITY, with the most rows for about as many values."""
    if similarity == SIMILARITY:
        return rows, count
    p, miss = similarity / 100, count * math.log1p(-((SIMILARITY / 100) ** rows))
    fits = [(r, math.ceil(miss / math.log1p(-(p**r)))) for r in range(1, rows * count + 1) if 1e-6 < p**r < 1]
    return max(((r, n) for r, n in fits if r * n <= rows * count), default=fits[0] if fits else (rows, count))


@lru_cache(maxsize=2)
def probes(bins: int) -> np.ndarray:
    return np.random.default_rng([SEED, bins]).integers(0, bins, (PROBES, bins), np.int32)


def signature(marks: np.ndarray, bins: int) -> np.ndarray:
    """One value for each bin of a non-empty sorted set; sorted hashes fall into ascending ranges."""
    at = ((marks >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    value, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    value[at[first]], full[at[first]] = marks[first], True
    empty = np.flatnonzero(~full)
    for row in probes(bins):
        if not len(empty):
            break
        lender = row[empty]
        hit = full[lender]
        value[empty[hit]] = value[lender[hit]]
        empty = empty[~hit]
    # few full ranges: each of the rest takes the element of least hash mixed with its own number, a rule that sets of any size share
    step = max(1, REST // len(marks))
    for part in (empty[k : k + step] for k in range(0, len(empty), step)):
        ranks = mixed(marks[None] ^ mixed(part.astype(np.uint64) + np.uint64(1))[:, None])
        value[part] = marks[ranks.argmin(axis=1)]
    return value


def sketch(values: np.ndarray) -> np.ndarray:
    """A random bit of each of the first SKETCH signature values, other bits of one value in other places."""
    bits = mixed(values[:SKETCH] * np.uint64(0x9E3779B97F4A7C15) + np.arange(SKETCH, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(bool)).view(np.int64)


def bands(values: np.ndarray, rows: int, count: int) -> np.ndarray:
    """Bucket keys of a signature."""
    h = np.arange(1, count + 1, dtype=np.uint64)
    for column in values.reshape(count, rows).T:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h.view(np.int64)


def _signatures(size: int, rows: int, count: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source):
            n, digest, keys = [], [], []
            for data in utf8(b):
                marks = shingles(word_hashes(data), size)
                n.append(len(marks))
                digest.append(xxhash.xxh3_128_digest(marks.tobytes()) if len(marks) else None)
                keys.append(bands(signature(marks, rows * count), rows, count) if len(marks) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("rid")), b.column(b.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["rid", "doc_id", "n", "digest", "bands"],
            )

    return run


def _marks(size: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(source):
            sets = [shingles(word_hashes(data), size) for data in utf8(b)]
            columns = [pa.array([m.view(np.int64) for m in sets], pa.list_(pa.int64())), pa.array([sketch(signature(m, SKETCH)) for m in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("rid")), pa.array([len(m) for m in sets], pa.int64()), *columns], names=["rep", "n", "marks", "bits"])

    return run


def rare_first(marks: DataFrame, similarity: float) -> DataFrame:
    """(rep, n, key, at) of the shingles that a text must share one of with any text similar to it: its rarest, and their places in that order.

    In one order of all shingles, here by how many texts hold them, two sets that overlap
    enough have a first common element; it can lie no deeper in either than leaves room for
    the rest of the overlap. What many texts share comes last, so texts that share a passage
    but not enough else meet nowhere.
    """
    each = marks.select("rep", F.explode("marks").alias("mark"))
    often = each.groupBy("mark").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = each.join(often, "mark").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("f", "mark"))).alias("shared")).join(marks.select("rep", "n"), "rep")
    alone = F.col("n") - F.size("shared")
    length = F.floor(F.col("n") * F.lit((100 - similarity) / 100) + 1e-9) + 1 - alone
    first = shared.withColumn("alone", alone).withColumn("keys", F.slice("shared", F.lit(1), F.greatest(length, F.lit(0)).cast("int")))
    return first.select("rep", "n", "alone", F.posexplode("keys").alias("at", "k")).select("rep", "n", F.col("k.mark").alias("key"), (F.col("alone") + F.col("at")).alias("at"))


def _confirm(size: int, similarity: int):
    """Confirms pairs on full sets; a run of pairs with one centre computes its set once."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, marks = None, None
        for b in batches(source):
            a, c = (b.column(b.schema.get_field_index(x)).to_pylist() for x in ("a", "b"))
            keep = []
            for i, (x, y) in enumerate(zip(utf8(b, "text_a"), utf8(b, "text_b"))):
                if c[i] != centre:
                    centre, marks = c[i], shingles(word_hashes(y), size)
                own = shingles(word_hashes(x), size)
                both = np.concatenate([own, marks])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= similarity * (len(own) + len(marks) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([c[i] for i in keep], pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, similarity: int) -> DataFrame:
    """Those of pairs (a, b) whose shingle sets are similar enough; a centre b of many pairs meets them in parts of CENTRE_PAIRS."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / CENTRE_PAIRS).cast("int").alias("parts"))
    centres = parts.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = pairs.join(parts, "b").select("a", "b", F.expr("cast(pmod(xxhash64(a), parts) as int)").alias("part"))
    one = dealt.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a")
    return one.join(centres.select("b", "part", "text_b"), ["b", "part"]).mapInArrow(_confirm(size, similarity), "a long, b long")


def copied(rows: DataFrame) -> DataFrame:
    """(rid, rep) of rows (rid, digest) whose digest others share: the smallest rid, found per share of the rows first so that no digest is one task's."""
    shares = rows.withColumn("share", F.expr(f"cast(pmod(xxhash64(rid), {part_rows(rows.sparkSession)}) as int)"))
    least = shares.groupBy("digest", "share").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = least.groupBy("digest").agg(F.min("rep").alias("rep"), F.sum("copies").alias("copies")).where("copies > 1")
    spread = least.select("digest", "share").join(classes, "digest")
    return shares.join(spread, ["digest", "share"]).select("rid", "rep")


def several(members: DataFrame, labels: DataFrame, similarity: float = 0) -> DataFrame:
    """Those (key, rep, n, at) whose bucket has members of several components, with their label; and that leave room for overlap with the least of them."""
    placed = members.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("key", "rep", "n", "at", F.coalesce("label", "rep").alias("label"))
    keys = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least")).where("lo <> hi").select("key", "least")
    return placed.join(keys, "key").where(F.expr(f"{100 + similarity} * (n - at) >= {similarity} * (n + least)")).drop("least")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """rid, doc_id, n_shingles, component_id, kept and first (the one row of its component that stays) for every document."""
    return grouped(*keyed(docs), size, similarity)


def one_of_each(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """docs with one document of each component, all columns."""
    rows, renumbered = keyed(docs, carry=True)
    kept = grouped(rows, renumbered, size, similarity).where("first").select("rid")
    return restored(rows.join(kept, "rid"), docs.columns)


def grouped(rows: DataFrame, renumbered: bool, size: int, similarity: int) -> DataFrame:
    if not 0 < similarity <= 100:
        raise ValueError(f"similarity is per cent, over 0 and at most 100: {similarity}")
    bound_batches(rows.sparkSession)
    signed = cut(rows.select("rid", "doc_id", "text").mapInArrow(_signatures(size, *banding(similarity, ROWS, BANDS)), SIGNATURE), "signatures").df
    # only classes of several need a lookup; all other rows stand for themselves
    copies = cut(copied(signed.where("n > 0").select("rid", "digest")), "copies").df
    lone = signed.join(copies.where("rid <> rep").select("rid"), "rid", "left_anti")
    keys = lone.where("n > 0").select(F.col("rid").alias("rep"), "n", F.explode("bands").alias("key"))
    # a centre is the smallest id: the same one in most buckets of a group
    stars = keys.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", F.col("c.rep").alias("centre"), F.col("c.n").alias("centre_n"))
    buckets = cut(keys.join(stars, "key"), "buckets").df
    fits = f"100 * least(n, centre_n) >= {similarity} * greatest(n, centre_n)"
    pairs = cut(buckets.where("rep <> centre").where(fits).select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")
    involved = buckets.select(F.col("rep").alias("rid")).distinct()
    texts = cut(rows.select("rid", "text").join(involved, "rid"), "texts")
    links = cut(confirmed(pairs.df, texts.df, size, similarity), "confirmed").df
    labels = components(links)
    # who is still apart from another member of a bucket, its spent centre aside, is hashed anew
    apart = several(buckets.where("rep <> centre").select("key", "rep", "n", F.lit(0).alias("at")), labels.df).select(F.col("rep").alias("rid")).distinct()
    marks = cut(texts.df.join(cut(apart, "apart").df, "rid").mapInArrow(_marks(size), "rep long, n long, marks array<long>, bits array<long>"), "marks")
    first = cut(rare_first(marks.df, similarity), "rare")
    members, tried, spent = first.df, [pairs], [first]
    differ = F.aggregate(F.zip_with("bits", "centre_bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    room = F.expr(f"{100 + similarity} * least(n - at, centre_n - centre_at) >= {similarity} * (n + centre_n)")
    # conditions within the join: pairs that fail them are never made
    may = (F.col("key") == F.col("of")) & F.expr(f"label <> centre_label and {fits}") & room & (differ <= unlike(similarity))
    while True:
        left = cut(several(members, labels.df, similarity), "open")
        if not left.df.limit(1).count():
            break
        parts = cut(left.df.groupBy("key", "label").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct("rep", "n", "at")).alias("c")), "parts")
        nth = F.expr("row_number() over (partition by key order by members, c)")
        centres = parts.df.withColumn("nth", nth).where(F.col("nth") <= CENTRES).select("key", F.col("c.rep").alias("centre"), F.col("c.n").alias("centre_n"), F.col("c.at").alias("centre_at"), F.col("label").alias("centre_label"), "members")
        centres = cut(centres, "centres")
        sketched = centres.df.join(marks.df.select(F.col("rep").alias("centre"), F.col("bits").alias("centre_bits")), "centre").withColumnRenamed("key", "of")
        new = left.df.join(marks.df.select("rep", "bits"), "rep").join(sketched, may).select(F.greatest("rep", "centre").alias("a"), F.least("rep", "centre").alias("b")).distinct()
        for old in tried:
            new = new.join(old.df, ["a", "b"], "left_anti")
        fresh = cut(new, "pairs")
        tried.append(fresh)
        more = cut(confirmed(fresh.df, texts.df, size, similarity), "confirmed").df
        if more.limit(1).count():
            links = links.union(more)
            labels = components(links)
        # centres spent are taken out; a bucket that keeps members of one component only is settled
        gone = centres.df.groupBy("key").agg(F.count_if(F.col("members") == 1).alias("gone"))
        unsettled = parts.df.groupBy("key").agg(F.count(F.lit(1)).alias("labels")).join(gone, "key").where("labels - gone > 1").select("key")
        unsettled = cut(left.df.join(unsettled, "key"), "unsettled")  # else the next join is pushed below this one
        rest = cut(unsettled.df.join(centres.df.select("key", F.col("centre").alias("rep")), ["key", "rep"], "left_anti").select("key", "rep", "n", "at"), "rest")
        for old in (left, parts, centres, unsettled, *spent):
            old.drop()
        members, spent = rest.df, [rest]
    for old in (left, marks, texts, *spent):
        old.drop()
    own = signed.select("rid", "doc_id", F.col("n").alias("n_shingles")).join(copies, "rid", "left").withColumn("rep", F.coalesce("rep", "rid"))
    placed = own.join(labels.df.select(F.col("node").alias("rep"), "label"), "rep", "left").withColumn("component", F.coalesce("label", "rep"))
    if renumbered:
        placed = placed.join(signed.select(F.col("rid").alias("component"), F.col("doc_id").alias("component_id")), "component")
    else:
        placed = placed.withColumn("component_id", F.col("component"))
    return placed.select("rid", "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("rid") == F.col("component")).alias("first"))


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid", "first")
