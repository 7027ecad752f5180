"""Queries of bins, classes and summaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import corpus as C
from foliant.operators import summaries as S
from foliant.plans.corpus_queries import BASE, ORACLE as ENTROPY, lines

_N = BASE + ", n as (select tok, count(*) as n from tok group by tok)"
_TTR = BASE + ", m as (select section, physical_leaf, round(count(distinct tok) / count(*), 6) as ttr from tok where physical_leaf is not null group by all)"


def frequency_bins(spark, sf):
    n = C.tokens(lines(spark, sf)).groupBy("tok").agg(F.count("*").alias("n"))
    b = S.upper_bound_bin(F.col("n"), (1, 3, 10, 30, 100))
    return n.groupBy(b.alias("bin")).agg(F.count("*").alias("types"), F.sum("n").alias("tokens"))


def line_position_counts(spark, sf):
    own = lines(spark, sf).select("record_id", F.size("tokens").alias("size"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0)))).alias("i")).where("size > 0")
    return own.groupBy(S.position_class(F.col("i"), F.col("size")).alias("position")).agg(F.count("*").alias("n"))


def _ratios(spark, sf):
    t = C.tokens(lines(spark, sf).where("physical_leaf is not null"), "section", "physical_leaf")
    return t.groupBy("section", "physical_leaf").agg(F.round(F.count_distinct("tok") / F.count("*"), 6).alias("ttr"))


def section_summary(spark, sf):
    return S.by_family(_ratios(spark, sf), "ttr", "section")


def section_replication(spark, sf):
    return S.replication(_ratios(spark, sf).withColumn("strong", F.col("ttr") > 0.9), "section", "strong", 0.8)


def section_top_tokens(spark, sf):
    t = C.tokens(lines(spark, sf), "section").groupBy("section", "tok").agg(F.count("*").alias("n"))
    return S.top_shares(t, "section", "tok", "n", 3)


def entropy_trajectory(spark, sf):
    """Whether a section's glyph entropy never falls as fewer glyphs are known of the context."""
    own = lines(spark, sf)
    rows = C.conditional_entropy(own, 1, "section")
    for order in (2, 3):
        rows = rows.unionByName(C.conditional_entropy(own, order, "section"))
    return S.monotone(rows.withColumn("less", -F.col("order")), "section", "less", "entropy_bits")


QUERIES = {f.__name__: f for f in (frequency_bins, line_position_counts, section_summary, section_replication, section_top_tokens, entropy_trajectory)}
_ENTROPIES = " union all ".join(f'select section, {k} as "order", entropy_bits from ({ENTROPY[f"conditional_entropy_{k}"]})' for k in (1, 2, 3))
ORACLE = {
    "entropy_trajectory": f'select section, count(*) as steps, bool_and(entropy_bits >= coalesce(before, entropy_bits)) as rising from (select *, lag(entropy_bits) over (partition by section order by "order" desc) as before from ({_ENTROPIES})) group by section',
    "frequency_bins": _N + " select case when n <= 1 then '<=1' when n <= 3 then '<=3' when n <= 10 then '<=10' when n <= 30 then '<=30' when n <= 100 then '<=100' else '>100' end as bin, count(*) as types, sum(n)::bigint as tokens from n group by 1",
    "line_position_counts": BASE + """, s as (select len(tokens) as size, unnest(range(len(tokens))) as i from line where len(tokens) > 0)
select case when size = 1 then 'singleton' when i = 0 then 'initial' when i = size - 1 then 'final' else 'medial' end as position, count(*) as n from s group by 1""",
    "section_summary": _TTR + " select section, count(*) as n, round(avg(ttr), 6) as mean, round(stddev_pop(ttr), 6) + 0.0 as sd, min(ttr) as min, max(ttr) as max, count_if(ttr > 0) as positive from m group by section",
    "section_replication": _TTR + " select section, count(*) as runs, count_if(ttr > 0.9) as strong_runs, count_if(ttr > 0.9) >= 0.8 * count(*) as replicated from m group by section",
    "section_top_tokens": BASE + ", n as (select section, tok, count(*) as w from tok group by all), p as (select section, tok, round(w / sum(w) over (partition by section), 6) as share, row_number() over (partition by section order by w desc, tok) as place from n) select * from p where place <= 3",
}
