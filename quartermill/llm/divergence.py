"""Operator 11: how far each source's use of terms lies from that of its language's other sources.

Terms of whole texts are counted per (lang, source) in one pass over their bytes: tasks give
out sums of bounded size, which meet a common term a few times a task. Each kept term is then
one wide row: its counts pivoted into an array indexed by the language's sources. Higher-order
functions turn the row into what each pair of sources differs by, and partial sums add it.
A pair of sources of which neither has the term differs by the same for all such terms, so
that share is added once from the totals, and a term emits pairs only for sources that have
it: rows hold as many entries as the language has sources, never their square.

All is exact: whole numbers, in decimals where a product could pass 64 bits.

Defined results: null text, lang and source are ''; a (lang, source) without terms is
compared with its language's others all the same; a language of one source has no pairs,
one without kept terms has differences of 0 and no terms; repeated rows count again; an
empty table gives none; columns but text, lang and source are never looked at.
"""

from __future__ import annotations

import re
import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches, bound_batches, cut, strings, utf8

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
WORDS = re.compile(TERM.encode())
#: Documents of a language that a term must occur in; parts of a probability of one; added to each count; ranks of terms that are returned.
LEAST_DOCS, UNIT, ADDED, TOP = 30, 1_000_000_000, 5, 50
#: Terms that a task holds before it gives them out.
FLUSH = 400_000
#: Copies of a language's totals, as one language may hold most terms.
SALTS = 32


def _counts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's rows, given out whenever over FLUSH terms are held."""
    held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def given() -> pa.RecordBatch:
        keys = [(*group, term, n, docs[term]) for group, (counts, docs) in held.items() for term, n in counts.items()]
        lang, name, term, count, docs = zip(*keys)
        held.clear()
        columns = [pa.array(lang, pa.string()), pa.array(name, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(count, pa.int64()), pa.array(docs, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "count", "docs"])

    for b in batches(source):
        for lang, name, text in zip(strings(b, "lang"), strings(b, "source"), utf8(b)):
            words = WORDS.findall(text.lower())  # of bytes, lower() changes A-Z alone
            if words:
                counts, docs = held[lang, name]
                counts.update(words)
                docs.update(set(words))
        if sum(len(counts) for counts, _ in held.values()) > FLUSH:
            yield given()
    if held:
        yield given()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term: its occurrences and the documents that hold it."""
    bound_batches(docs.sparkSession)
    rows = docs.select(*_names(), F.col("`text`").cast("string").alias("text")).mapInArrow(_counts, "lang string, source string, term string, count long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _names() -> list:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def _part(count: str, total: str) -> str:
    """The smoothed share of a count, in parts of UNIT; null where the language keeps no term."""
    return f"1 + ({UNIT}BD * cast({count} + {ADDED} as decimal(20, 0))) div nullif(cast({total} as decimal(20, 0)) + {ADDED} * cast(v as decimal(18, 0)), 0)"


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Per (lang, source): all other sources of the language by their difference, and the terms it uses more than its language."""
    counts = term_counts(docs)
    wide = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"), F.map_from_entries(F.collect_list(F.struct("source", "count"))).alias("by"))
    kept = cut(wide.where(F.col("docs") >= least_docs).drop("docs"), "terms").df
    sums = kept.select("lang", F.explode("by").alias("source", "count")).groupBy("lang", "source").agg(F.sum("count").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all"))
    groups = docs.select(*_names()).distinct().join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"))
    langs = groups.join(sizes, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("all", F.lit(0)).alias("all"), F.col("g.source").alias("sources"), F.col("g.n").alias("n"))
    langs = cut(langs.withColumn("none", F.expr(f"transform(n, x -> {_part('0', 'x')})")), "languages").df

    salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = kept.withColumn("salt", F.expr(f"cast(pmod(xxhash64(term), {SALTS}) as int)")).join(salted, ["lang", "salt"])
    arrays = rows.withColumn("c", F.expr("transform(sources, s -> coalesce(by[s], 0L))")).select(
        "lang", "term", "sources", "none", "c", F.expr(_part("total", "`all`")).alias("q"), F.expr(f"transform(c, (x, i) -> {_part('x', 'n[i]')})").alias("p")
    )
    arrays = cut(arrays, "arrays").df

    holders = arrays.select("lang", "p", "c", "none", F.posexplode("c").alias("i", "own")).where("own > 0")
    partners = F.expr("filter(transform(p, (x, j) -> struct(least(i, j) as a, greatest(i, j) as b, abs(p[i] - x) - abs(none[i] - none[j]) as f)), (x, j) -> j > i or (j < i and c[j] = 0))")
    beyond = holders.select("lang", F.explode(partners).alias("x")).groupBy("lang", "x.a", "x.b").agg(F.sum("x.f").alias("f"))
    firsts = langs.select("lang", "v", "none", "sources", F.posexplode("sources").alias("i", "source")).repartition("lang", "source")
    pairs = firsts.select("lang", "v", "none", "i", "source", F.posexplode("sources").alias("j", "item")).where("i <> j")
    pairs = pairs.select("lang", "source", "item", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.expr("coalesce(v * abs(none[i] - none[j]), 0)").alias("alike"))
    pairs = pairs.join(beyond, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("alike") + F.coalesce("f", F.lit(0))).cast("long").alias("value"))

    uses = arrays.select("lang", "term", "q", F.explode(F.arrays_zip("sources", "c", "p")).alias("x")).where("x.c > 0 and x.p > q")
    terms = uses.select("lang", F.col("x.sources").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("x.p") - F.col("q")).cast("long").alias("value"))
    rank = F.expr("cast(row_number() over (partition by lang, source order by value desc, item) as int)").alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).where(f"rank <= {top}"))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op11_divergence": f"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as text from documents),
w as (select r, lang, source, unnest(regexp_extract_all(text, '{TERM}')) as term from d),
kept as (select lang, term from w group by all having count(distinct r) >= {LEAST_DOCS}),
v as (select lang, count(*) as v from kept group by lang),
c as (select lang, source, term, count(*) as c from w semi join kept using (lang, term) group by all),
g as (select g.lang, g.source, coalesce(sum(c.c), 0)::hugeint as n from (select distinct lang, source from d) g left join c using (lang, source) group by all),
l as (select lang, sum(n)::hugeint as n from g group by lang),
full_p as (select g.lang, g.source, term, coalesce(c.c, 0) as c, 1 + ({UNIT}::hugeint * (coalesce(c.c, 0) + {ADDED})) // (g.n + {ADDED} * v.v) as p
  from g join kept using (lang) join v using (lang) left join c using (lang, source, term)),
lang_p as (select lang, term, 1 + ({UNIT}::hugeint * (sum(c) + {ADDED})) // (any_value(l.n) + {ADDED} * any_value(v.v)) as q from full_p join l using (lang) join v using (lang) group by all),
pairs as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as f from full_p a join full_p b using (lang, term) where a.source <> b.source group by all),
every as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
  union all select lang, source, 'term', term, (p - q)::bigint from full_p join lang_p using (lang, term) where c > 0 and p > q)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from every qualify part = 'pair' or rank <= {TOP}"""
}
