"""Operator 12: the trie of conversation prefixes, its leaves and savings rolled up by pointer jumping.

A node is a distinct sequence of first turns, keyed by its depth and a 128-bit digest: the
exclusive or of the digests of (place, turn), which running windows build and from which the
parent's digest follows by taking the last turn's out again. Texts are digested where they
are read and never shuffled.

Turns are numbered by a global sort and the rows before each part of it, and digests run
within stretches of CHUNK turns and are joined by the stretches' totals, so that one
conversation of any length is spread over tasks. Nodes are aggregated before they are
shuffled. The rollup takes one turn a doubling: what lies within 2^k below a node and the
ancestor 2^k above it give what lies within 2^(k+1) and the ancestor 2^(k+1) above.
Ancestors are looked up by joins that Spark may split where many nodes share one.

The digest of a node's ended conversations is of one string, which can only be hashed in
order: ids are sorted globally, joined into pieces of PIECE bytes in the tasks, and the
pieces of a node run through one hash, of which a task holds one piece.

Defined results: turns of equal number follow their role, then their digest (repeated rows
are turns of their own); null role and text are empty; rows without conv_id belong to no
conversation; an empty table gives no node, not even a root; other columns aren't looked at.
Nodes of 10^12 conversations' prefixes share a digest with a probability of about 10^-15.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches, cut

#: Conversations of a block share a base; the base lends at most this many turns less one.
BLOCK, HEADS = 100, 6
#: Turns of a stretch; bytes of joined ids in a piece.
CHUNK, PIECE = 10_000, 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()


def _lane(column: str, lane: int):
    """64 of a digest's bits."""
    return F.expr(f"cast(conv(substr({column}, {1 + 16 * lane}, 16), 16, -10) as bigint)")


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn's digest and its code points; written once."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").alias("turn"), role.alias("role"), F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256).alias("digest"), F.char_length(text).cast("long").alias("points"))
    order = rows.where("conv_id is not null").orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    sorted_rows = cut(order.select("conv_id", "digest", "points", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns").df
    parts = sorted_rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    spans = parts.select("conv_id", "part", F.expr("sum(n) over (partition by conv_id order by part) - n").alias("before")).where("before > 0")
    within = sorted_rows.select("conv_id", "part", "digest", "points", F.expr("row_number() over (partition by conv_id, part order by at)").alias("place"))
    # at most one conversation goes over from each part of the sort into the next: no more rows than parts
    placed = within.join(F.broadcast(spans), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "points")


def rebuilt(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """All conversations (conv_id, length), and their rows after the base's first turns replaced their own."""
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("size")).select("conv_id", "size", F.expr(f"conv_id - conv_id % {block}").alias("base"), F.expr(f"crc32(cast(cast(conv_id as string) as binary)) % {heads}").alias("h"))
    bases = convs.where("conv_id = base").select("base", F.col("size").alias("base_size"))
    convs = convs.join(bases, "base", "left").withColumn("lent", F.expr("least(h, coalesce(base_size, 0))")).withColumn("length", F.expr("lent + greatest(size - h, 0)"))
    convs = cut(convs.select("conv_id", "base", "h", "lent", "length"), "conversations").df
    own = turns.join(convs, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("lent")).alias("place"), "digest", "points", "length")
    first = turns.where(f"conv_id % {block} = 0 and place < {heads}").select(F.col("conv_id").alias("base"), "place", "digest", "points")
    lent = convs.join(first, "base").where("place <= lent").select("conv_id", "place", "digest", "points", "length")
    return convs, own.unionByName(lent)


def prefixes(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every row with the digest of the prefix it ends (a, b) and that of its parent (pa, pb)."""
    tagged = rows.withColumn("tag", F.sha2(F.concat("digest", F.col("place").cast("string")), 256))
    tagged = tagged.select("conv_id", "place", "points", "length", F.expr(f"place div {chunk}").alias("chunk"), _lane("tag", 0).alias("ta"), _lane("tag", 1).alias("tb"))
    totals = tagged.groupBy("conv_id", "chunk").agg(F.bit_xor("ta").alias("xa"), F.bit_xor("tb").alias("xb"))
    before = "(partition by conv_id order by chunk)"
    totals = totals.select("conv_id", "chunk", F.expr(f"bit_xor(xa) over {before} ^ xa").alias("xa"), F.expr(f"bit_xor(xb) over {before} ^ xb").alias("xb"))
    upto = "(partition by conv_id, chunk order by place rows between unbounded preceding and current row)"
    run = tagged.select("*", F.expr(f"bit_xor(ta) over {upto}").alias("ra"), F.expr(f"bit_xor(tb) over {upto}").alias("rb")).join(totals, ["conv_id", "chunk"])
    return run.select("conv_id", "place", "points", "length", F.expr("ra ^ xa").alias("a"), F.expr("rb ^ xb").alias("b"), F.expr("ra ^ xa ^ ta").alias("pa"), F.expr("rb ^ xb ^ tb").alias("pb"))


def _pieces(size: int):
    """Sorted (depth, a, b, conv_id) rows into joined ids, a piece no longer than size but for its last id."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("depth", "a", "b", "first", "ids")
        key, first, held, out = None, None, bytearray(), []

        def packed():
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=list(names))

        for batch in batches(source):
            for *at, conv in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if at != key or len(held) >= size:
                    if key is not None:
                        out.append((*key, first, bytes(held)))
                    key, first, held = at, conv, bytearray()
                else:
                    held += b","
                held += b"%d" % conv
            if out:
                yield packed()
                out.clear()
        if key is not None:
            out.append((*key, first, bytes(held)))
            yield packed()

    return run


def _hashed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's pieces, which come sorted; one state at a time."""
    key, state = None, None
    for batch in batches(source):
        out = []
        for *at, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if at != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = at, hashlib.sha256(ids)
            else:
                state.update(b",")
                state.update(ids)
        if out:
            yield _digests(out)
    if key is not None:
        yield _digests([(*key, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    *keys, digests = zip(*rows)
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in keys), pa.array(digests, pa.string())], names=["depth", "a", "b", "ends_sha256"])


def ended(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """depth, a, b and the digest of the ids of the conversations that end there."""
    keys = "depth long, a long, b long"
    ordered = ends.select(*[F.col(c).cast("long").alias(c) for c in ("depth", "a", "b", "conv_id")]).orderBy("depth", "a", "b", "conv_id")
    pieces = ordered.mapInArrow(_pieces(piece), f"{keys}, first long, ids binary")
    return pieces.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "first").mapInArrow(_hashed, f"{keys}, ends_sha256 string")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """depth, conv_id: leaves and savings of the whole subtree.

    nodes: depth, conv_id, up (the parent's conv_id), leaves and saved of the node alone. A
    node's key is its depth and smallest member, as no conversation has two nodes at a depth.
    """
    state, step = cut(nodes, "rollup"), 1
    deepest = state.df.agg(F.max("depth")).first()[0] or 0
    while step <= deepest:
        below = state.df.where(f"depth >= {step}").groupBy((F.col("depth") - step).alias("depth"), F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = state.df.where(f"depth >= {step}").select((F.col("depth") + step).alias("depth"), F.col("conv_id").alias("up"), F.col("up").alias("further"))
        summed = state.df.join(below, ["depth", "conv_id"], "left").select("depth", "conv_id", "up", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        after = cut(summed.join(above, ["depth", "up"], "left").select("depth", "conv_id", F.col("further").alias("up"), "leaves", "saved"), "rollup")
        state.drop()
        state, step = after, step * 2
    return state.df.select("depth", "conv_id", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame, block: int = BLOCK, heads: int = HEADS, chunk: int = CHUNK, piece: int = PIECE) -> DataFrame:
    """One row a node of the trie over all rebuilt conversations."""
    convs, rows = rebuilt(cut(numbered(conversations), "places").df, block, heads)
    rows = cut(prefixes(rows, chunk), "prefixes").df
    inner = rows.groupBy(F.col("place").alias("depth"), "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("points").alias("points"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("a", "b")], "conv_id", "n_convs", *[F.lit(0).cast("long").alias(c) for c in ("points", "pa", "pb")])
    nodes = cut(inner.withColumn("depth", F.col("depth").cast("long")).unionByName(root), "nodes").df
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    ends = rows.where("place = length").select(F.col("place").alias("depth"), "a", "b", "conv_id").unionByName(convs.where("length = 0").select(*[F.lit(0).alias(c) for c in ("depth", "a", "b")], "conv_id"))
    linked = nodes.join(parents, ["depth", "pa", "pb"], "left").join(children, ["depth", "a", "b"], "left").join(ended(ends, piece), ["depth", "a", "b"], "left")
    linked = cut(linked.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "points", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")), "linked").df
    totals = rolled_up(linked.select("depth", "conv_id", F.col("parent_conv_id").alias("up"), F.expr("if(n_children = 0, 1L, 0L)").alias("leaves"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved")))
    return linked.join(totals, ["depth", "conv_id"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = {
    # the checksum is folded from bytes and bit steps (-1), as this SQL has no function for it
    "op12_prefix_trie": f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
p as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(sha256(role) || sha256(text))) as pos from t),
s as (select conv_id, max(pos) as size, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295) % {HEADS} as h, conv_id - conv_id % {BLOCK} as base from p group by conv_id),
k as (select s.*, least(s.h, coalesce(b.size, 0)) as lent from s left join s b on b.conv_id = s.base),
own as (select conv_id, pos - h + lent as pos, role, text from p join k using (conv_id) where pos > h
  union all select k.conv_id, p.pos, p.role, p.text from k join p on p.conv_id = k.base and p.pos <= k.lent),
x as (select conv_id, pos, length(text) as points, list(sha256(sha256(role) || sha256(text))) over (partition by conv_id order by pos) as path from own),
m as (select conv_id, 0 as depth, 0 as points, []::varchar[] as path from s union all select conv_id, pos, points, path from x),
ends as (select path, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from (select conv_id, arg_max(path, depth) as path from m group by conv_id) group by path),
n as (select path, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(points) as points from m group by path),
c as (select path[:-2] as path, count(*) as n_children from n where depth > 0 group by all),
f as (select n.*, coalesce(n_children, 0) as n_children from n left join c using (path)),
up as (select path[:d] as path, sum((n_children = 0)::bigint) as n_leaves, sum((n_convs - 1) * points) as saved_tokens from f, unnest(generate_series(0, depth)) as g(d) group by all)
select f.conv_id, f.depth::bigint as depth, q.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, coalesce(ends_sha256, sha256('')) as ends_sha256
from f join up using (path) left join f q on f.depth > 0 and q.path = f.path[:-2] left join ends using (path)"""
}
