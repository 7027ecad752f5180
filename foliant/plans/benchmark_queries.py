"""Queries of control texts measured against plain text, and of summaries over many runs, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import ciphers as K
from foliant.operators import corpus_tables as T
from foliant.operators import localization as L
from foliant.operators import mechanisms as M
from foliant.operators import recurrence as Q
from foliant.operators import selection as A
from foliant.operators import summaries as S
from foliant.plans.corpus_queries import BASE, lines
from foliant.plans.mechanism_queries import _OCC, _TURN, _W, words
from foliant.session import table, written

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_H = "log2(sum(n)) - sum(n * log2(n)) / sum(n)"


@query(BASE + f""", g as (select record_id, token_index, unnest(glyphs) as g from tok), u as (select {_H} as v from (select g, count(*) as n from g where g <> 'Z1' group by g)), n as (select tok, count(*) as n from tok group by tok), l as (select len(glyphs) as k from tok)
select 'unigram_entropy' as metric, round(v, 6) as value from u union all select 'token_length_mean', round(avg(k), 6) from l union all select 'token_length_median', round(quantile_cont(k, 0.5), 6) from l
union all select 'unique_token_ratio', round(count(*) / sum(n), 6) from n union all select 'hapax_ratio', round(count_if(n = 1) / count(*), 6) from n union all select 'top_token_share', round(max(n) / sum(n), 6) from n""")
def scalar_metrics(spark, sf):
    """Six of the scalar figures of the corpus; the others have queries of their own."""
    m = T.metrics(lines(spark, sf))
    return m.where(F.col("metric").isin("unigram_entropy", "token_length_mean", "token_length_median", "unique_token_ratio", "hapax_ratio", "top_token_share"))


@query(BASE + " select 23::bigint as metrics, 0::bigint as nulls")
def metric_vector(spark, sf):
    """The whole vector: how many metrics, and how many without a value."""
    return T.metrics(lines(spark, sf)).agg(F.count("*").alias("metrics"), F.count_if(F.col("value").isNull()).alias("nulls"))


def _benchmark(spark, sf) -> DataFrame:
    plain = written(K.plain_words(table(spark, sf, "loci")), "plain")
    own = plain.withColumn("cipher", F.split("word", ""))
    reference = T.metrics(T.as_lines(own), 2, 2)

    def one(family: str) -> DataFrame:
        return T.metrics(T.as_lines(K.encoded(plain, family)[0]), 2, 2).withColumn("family", F.lit(family))

    return L.metric_deltas(reduce(DataFrame.unionByName, map(one, ("mono", "verbose"))), written(reference, "metrics"), "family")


@query()
def control_benchmark(spark, sf):
    """Metrics of two families of control texts, against those of the plain text."""
    return _benchmark(spark, sf)


@query("select unnest(['one_to_one_changes_nothing', 'pairs_double_lengths']) as \"check\", 0::bigint as violations")
def benchmark_checks(spark, sf):
    """A cipher that replaces glyphs one for one changes no metric; one that writes two for one doubles lengths."""
    b = written(_benchmark(spark, sf), "benchmark")
    double = b.where("family = 'verbose' and metric like 'token_length%'").where(F.abs(F.col("value") - 2 * F.col("reference")) > 1e-5)
    return A.checks(A.violations("one_to_one_changes_nothing", b.where("family = 'mono' and distance > 1e-6 and metric not like 'edit%'")), A.violations("pairs_double_lengths", double))


_RATES = ", r as (select word as base, variant, occurrence as o from al), k as (select base from r group by base having count(*) > 16), pq as (select l.lag, x.variant = y.variant as same from (select * from r where base in (select base from k)) x, unnest(range(1, 17)) as l(lag) join r y on y.base = x.base and y.o = x.o + l.lag), rt as (select lag, round(count_if(same) / count(*), 6) as rate from pq group by lag)"


def _rates(spark, sf, scheme: str) -> DataFrame:
    rows = M.allocated(words(spark, sf), scheme)[0].select(F.col("word").alias("base"), F.col("variant").cast("string").alias("suffix"), "occurrence")
    return Q.lag_rates(rows, M.VARIANTS, M.VARIANTS + 1)


@query("select unnest(['recurrence', 'shuffled', 'iid']) as scheme, unnest([true, false, false]) as exact")
def exact_cycles(spark, sf):
    """Only suffixes handed out in turn come back exactly after sixteen tokens of a word."""
    return reduce(DataFrame.unionByName, (S.exact_cycle(_rates(spark, sf, s), M.VARIANTS, 1e-9).select(F.lit(s).alias("scheme"), "exact") for s in M.SCHEMES))


@query(_OCC + _TURN["shuffled"] + _RATES + " select lag::integer as lag, rate from rt")
def shuffled_lag_rates(spark, sf):
    return _rates(spark, sf, "shuffled").select("lag", "rate")


@query(_OCC + _TURN["recurrence"] + ", k as (select word from al group by word having count(*) > 32), pq as (select x.variant = y.variant as same from al x join al y on x.word = y.word and y.occurrence = x.occurrence + 32 where x.word in (select word from k)) select (select count(*) from k) as families, count(*) as pairs, round(count_if(same) / nullif(count(*), 0), 6) as rate from pq")
def rate_at_two_cycles(spark, sf):
    """Equal suffixes 32 tokens of a word apart, where a word has as many; null without pairs."""
    rows = M.allocated(words(spark, sf))[0].select(F.col("word").alias("base"), F.col("variant").cast("string").alias("suffix"), "occurrence")
    return Q.rate_at(rows, 32)


_RUNS = "with r as (select transcription_id as family, feed_ as relation, language, run, delta, delta > 0 as strong from (select l.transcription_id, 'length' as feed_, coalesce(section, 'UNSET') as language, l.record_id % 5 as run, avg(length(text_normalized)) - 40 as delta from (select distinct record_id, transcription_id, section, text_normalized from loci) l group by all))"


def _runs(spark, sf) -> DataFrame:
    """Five runs for each transcription and section: by how much lines are longer than forty characters on average."""
    own = table(spark, sf, "loci").select("record_id", "transcription_id", "section", "text_normalized").distinct()
    by = own.groupBy(F.col("transcription_id").alias("family"), F.coalesce("section", F.lit("UNSET")).alias("language"), (F.col("record_id") % 5).alias("run"))
    rows = by.agg((F.avg(F.length("text_normalized")) - 40).alias("delta"))
    return rows.withColumn("relation", F.lit("length")).withColumn("strong", F.col("delta") > 0)


@query(_RUNS + " select family, relation, count(*) as runs, round(avg(delta), 6) + 0.0 as mean, round(quantile_cont(delta, 0.5), 6) + 0.0 as median, round(stddev_pop(delta), 6) + 0.0 as sd, round(min(delta), 6) + 0.0 as min, round(max(delta), 6) + 0.0 as max, count_if(delta > 0) as positive, count_if(strong) as strong from r group by all")
def relation_summary(spark, sf):
    return S.relation_summary(_runs(spark, sf), "delta", "strong", "family", "relation")


_FULL = _RUNS + ", f as (select * from r qualify count(*) over (partition by family, relation, language) = 5), l as (select family, relation, language, count(*) as runs, count_if(strong) as strong, count_if(strong) >= 4 as replicated from f group by all), q as (select family, relation, count_if(replicated) as languages, coalesce(array_to_string(list_sort(list(language) filter (replicated)), '|'), '') as replicated_in, count_if(replicated) >= 3 as robust from l group by all)"


def _replication(spark, sf):
    rows = _runs(spark, sf)
    whole = rows.groupBy("family", "relation", "language").agg(F.count("*").alias("n")).where("n = 5").drop("n")
    return S.two_level_replication(rows.join(whole, ["family", "relation", "language"]), "family", "relation", "language", "strong", 5, 4, 3)


@query(_FULL + " select family, relation, language, runs, strong, replicated from l")
def language_replication(spark, sf):
    return _replication(spark, sf)[0]


@query(_FULL + " select * from q")
def relation_robustness(spark, sf):
    return _replication(spark, sf)[1]


@query(_FULL + " select family, count_if(robust) as robust_relations, bool_and(robust) as whole_hierarchy from q group by family")
def family_hierarchy(spark, sf):
    return _replication(spark, sf)[2]


@query(_RUNS + ", b as (select family, language, run, delta as before, delta * 0.5 - 1 as after from r) select family, count(*) as runs, round(avg(before), 6) + 0.0 as mean_before, round(avg(after), 6) + 0.0 as mean_after, round(avg(after - before), 6) + 0.0 as mean_change, round(stddev_pop(after - before), 6) + 0.0 as sd_change, count_if(after < before) as reduced from b group by family")
def run_changes(spark, sf):
    rows = _runs(spark, sf).withColumn("before", F.col("delta")).withColumn("after", F.col("delta") * 0.5 - 1)
    return S.changes(rows, "before", "after", "family")


@query(_W + ", d as (select line % 3 as run, split, count(*) as tokens, count(distinct word) as types from ws group by all) select split, count(*) as runs, round(avg(tokens), 6) as mean_tokens, round(avg(types), 6) as mean_types from d group by split")
def mean_diagnostics(spark, sf):
    """Means of a mechanism's figures over three runs."""
    rows = words(spark, sf).groupBy((F.col("line") % 3).alias("run"), "split").agg(F.struct(F.count("*").alias("tokens"), F.count_distinct("word").alias("types")).alias("d"))
    flat = S.flattened(rows, "d", "")
    return S.means(flat, ["tokens", "types"], "split")
