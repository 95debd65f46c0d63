"""Operator 7: quality rules with adaptive thresholds from mergeable quantile sketches.

Base columns come from one pass over the bytes of every whole text. Each derived ratio
then goes into a quantile sketch per (lang, source): counts of integer buckets with a
relative width of at most 1/512, so sketches of parts merge by adding counts and do not
depend on the order of rows or tasks. A group's quartiles are drawn towards those of its
language's merged sketch, which weighs as much as PRIOR_ROWS rows, so a small group is judged mostly by its language. Thresholds (Tukey fences with slack) replace fixed cutoffs and
are joined back; the join key is salted, as one source may hold a third of all rows.

Defined results: null text counts as no words (base_failed, not kept); null lang or
source form groups of their own; repeated rows each get a row; an empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches, bound_batches, cut, utf8

SPACE = b" \t\n\x0b\x0c\r"
NOT_POINTS = SPACE + bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE_SCHEMA = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in BASE)

#: metric -> (numerator, denominator, scale, slack in scaled units, two-sided)
METRICS = {
    "word_length": ("word_chars", "n_words", 100, 150, True),
    "symbols": ("n_symbols", "n_words", 1000, 100, False),
    "dup_lines": ("n_dup_lines", "n_words", 1000, 50, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 350, False),
}
#: Fences lie this many quartile ranges outside the quartiles; rows that a language's sketch counts for beside a source's own.
FENCE, PRIOR_ROWS, SALTS = 4, 200, 32


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """The base columns of one text, in the order of BASE."""
    words = data.split()  # bytes.split() cuts at exactly x20 and x09-x0D
    chars = len(data.translate(None, NOT_POINTS))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        counts, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def _base(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(source):
        rows = [base_counts(x) for x in utf8(b)]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(BASE))]
        yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)).cast(t) for c, t in (("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()))), *columns], names=["doc_id", "lang", "source", *BASE])


def base_columns(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return rows.mapInArrow(_base, BASE_SCHEMA)


def bucket(value):
    """An integer's sketch bucket: its leading ten bits."""
    drop = F.greatest(F.length(F.bin(value)) - 10, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def scaled(metric: str):
    top, under, scale, _, _ = METRICS[metric]
    return F.expr(f"cast({scale} as bigint) * {top} div greatest({under}, 1)")


def sketches(base: DataFrame) -> DataFrame:
    """Bucket counts per (lang, source, metric) over the rows that pass the base rule."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(scaled(m)).alias("bucket")) for m in METRICS]))
    return base.where("not base_failed").select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.metric", "p.bucket").agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row of lower and upper bounds per (lang, source)."""
    language = sketch.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n")).withColumn("source", F.lit(None).cast("string")).withColumn("level", F.lit(1))
    both = sketch.withColumn("level", F.lit(0)).unionByName(language)
    # each window below runs over the buckets of one sketch, which are bounded by its bits
    run = "(partition by level, lang, source, metric"
    ranked = both.select("*", F.expr(f"sum(n) over {run} order by bucket)").alias("upto"), F.expr(f"sum(n) over {run})").alias("total"))
    quartiles = ranked.groupBy("level", "lang", "source", "metric").agg(
        F.min(F.expr("case when 4 * upto >= total then bucket end")).alias("q1"), F.min(F.expr("case when 4 * upto >= 3 * total then bucket end")).alias("q3"), F.max("total").alias("total")
    )
    own = quartiles.where("level = 0").alias("o").join(quartiles.where("level = 1").alias("l"), F.expr("o.lang <=> l.lang and o.metric = l.metric"))
    use = own.select("o.lang", "o.source", "o.metric", *[F.expr(f"(o.total * o.{q} + {PRIOR_ROWS} * l.{q}) div (o.total + {PRIOR_ROWS})").alias(q) for q in ("q1", "q3")])
    slack = F.expr("case metric " + " ".join(f"when '{m}' then {METRICS[m][3]}" for m in METRICS) + " end")
    bounds = use.select("lang", "source", "metric", (F.col("q1") - FENCE * (F.col("q3") - F.col("q1")) - slack).alias("low"), (F.col("q3") + FENCE * (F.col("q3") - F.col("q1")) + slack).alias("high"))
    picks = [F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m in METRICS for c in (("low", "high") if METRICS[m][4] else ("high",))]
    return bounds.groupBy("lang", "source").agg(*picks)


def quality_rules(docs: DataFrame) -> DataFrame:
    """Per document: base columns, base_failed and kept (the adaptive verdict)."""
    base = cut(base_columns(docs).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")), "rules").df
    salted = fences(sketches(base)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    within = F.lit(True)
    for m, (*_, two) in METRICS.items():
        within &= scaled(m) <= F.col(f"{m}_high")
        if two:
            within &= scaled(m) >= F.col(f"{m}_low")
    rows = base.withColumn("salt", F.expr(f"cast(pmod(xxhash64(doc_id), {SALTS}) as int)")).alias("b")
    joined = rows.join(salted.alias("f"), F.expr("b.lang <=> f.lang and b.source <=> f.source and b.salt = f.salt"), "left")
    return joined.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    value = {m: f"{s} * {a} // greatest({b}, 1)" for m, (a, b, s, _, _) in METRICS.items()}
    ten = lambda v: f"(({v}) >> greatest(length(bin({v})) - 10, 0)) << greatest(length(bin({v})) - 10, 0)"
    pairs = " union all ".join(f"select lang, source, '{m}' as metric, {ten(v)} as bucket from base where not base_failed" for m, v in value.items())
    slack = "case metric " + " ".join(f"when '{m}' then {METRICS[m][3]}" for m in METRICS) + " end"
    picks = ", ".join(f"max(case when metric = '{m}' then {c} end) as {m}_{c}" for m in METRICS for c in (("low", "high") if METRICS[m][4] else ("high",)))
    within = " and ".join([f"{v} <= {m}_high" for m, v in value.items()] + [f"{v} >= {m}_low" for m, v in value.items() if METRICS[m][4]])
    word = r"[^\x20\x09-\x0D]+"
    return f"""
with t as (select doc_id, lang, source, coalesce(text, '') as text, row_number() over () as r from documents),
w as (select r, regexp_extract_all(text, '{word}') as words from t),
tri as (select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as win from w, unnest(generate_series(1, len(words) - 2)) as g(i)),
rep as (select r, i from tri qualify count(*) over (partition by r, win) > 1),
hit as (select r, count(distinct i + k) as n from rep, unnest([0, 1, 2]) as g(k) group by r),
ln as (select r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) as lines from t),
raw as (select t.doc_id, t.lang, t.source, len(w.words) as n_words,
  length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
  len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(hit.n, 0) as n_repeat_words
  from t join w using (r) join ln using (r) left join hit using (r)),
base as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from raw),
sk as (select lang, source, metric, bucket, count(*) as n from ({pairs}) group by all),
lv as (select 0 as level, lang, source, metric, bucket, n from sk union all select 1, lang, null, metric, bucket, sum(n) from sk group by lang, metric, bucket),
rk as (select *, sum(n) over (partition by level, lang, source, metric order by bucket) as upto, sum(n) over (partition by level, lang, source, metric) as total from lv),
q as (select level, lang, source, metric, min(case when 4 * upto >= total then bucket end) as q1, min(case when 4 * upto >= 3 * total then bucket end) as q3, max(total) as total from rk group by all),
u as (select o.lang, o.source, o.metric, (o.total * o.q1 + {PRIOR_ROWS} * l.q1) // (o.total + {PRIOR_ROWS}) as q1, (o.total * o.q3 + {PRIOR_ROWS} * l.q3) // (o.total + {PRIOR_ROWS}) as q3
  from q o join q l on o.level = 0 and l.level = 1 and o.lang is not distinct from l.lang and o.metric = l.metric),
b as (select lang, source, metric, q1 - {FENCE} * (q3 - q1) - {slack} as low, q3 + {FENCE} * (q3 - q1) + {slack} as high from u),
f as (select lang, source, {picks} from b group by lang, source)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and coalesce({within}, false) as kept
from base left join f on base.lang is not distinct from f.lang and base.source is not distinct from f.source"""


SQL = {"op7_quality_rules": _sql()}
