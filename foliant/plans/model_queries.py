"""Queries of n-gram models, resampling and per-leaf features, with their SQL. Every fifth leaf is held out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import corpus as C
from foliant.operators import ngram as N
from foliant.operators import resample as R
from foliant.plans.corpus_queries import BASE, lines

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def parts(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(train, held-out) line sequences with their unit."""
    s = N.line_sequences(lines(spark, sf).withColumn("unit", N.leaf_group(F.col("physical_leaf"))), "unit", "physical_leaf", "section")
    held = F.coalesce(F.col("physical_leaf") % 5 == 0, F.lit(False))
    return s.where(~held), s.where(held)


_SEQ = BASE + """, padded as (
  select record_id, section, physical_leaf, coalesce('f' || physical_leaf, 'special') as unit,
    unnest(string_split(array_to_string(list_transform(tokens, lambda t: array_to_string(list_transform(t, lambda g: ' ' || g || ' '), '')), ' <WB> '), ' Z1 ')) as part from line
), seq as (
  select record_id, section, physical_leaf, unit, coalesce(physical_leaf % 5 = 0, false) as held, regexp_split_to_array(p, ' +') as symbols
  from (select *, trim(regexp_replace(part, '^( *<WB> *)+|( *<WB> *)+$', '', 'g'), ' ') as p from padded) where p <> ''
), ev as (
  select record_id, section, unit, held, symbols[i] as s, coalesce(case when i > 1 then symbols[i - 1] end, '<BOS>') as h1, coalesce(case when i > 2 then symbols[i - 2] end, '<BOS>') as h2
  from seq, unnest(range(1, len(symbols) + 1)) as p(i)
)"""
_WB = _SEQ + """, c2 as (select h1, h2, s, count(*) as c from ev where not held group by all), c1 as (select h1, s, sum(c) as c from c2 group by all), c0 as (select s, sum(c) as c from c2 group by all),
n2 as (select h1, h2, sum(c) as n, count(*) as t from c2 group by all), n1 as (select h1, sum(c) as n, count(*) as t from c1 group by all), n0 as (select sum(c) as n, count(*) as t from c0),
p as (select e.unit, e.section, c0.c is null as oov, coalesce(c0.c, n0.t) / (n0.n + n0.t) as p1, n1.n as m1, coalesce(c1.c, 0) as k1, n1.t as t1, n2.n as m2, coalesce(c2.c, 0) as k2, n2.t as t2
  from ev e cross join n0 left join c0 on e.s = c0.s left join c1 on e.h1 = c1.h1 and e.s = c1.s left join n1 on e.h1 = n1.h1
  left join c2 on e.h1 = c2.h1 and e.h2 = c2.h2 and e.s = c2.s left join n2 on e.h1 = n2.h1 and e.h2 = n2.h2 where e.held),
q as (select *, case when m1 is null then p1 else (k1 + t1 * p1) / (m1 + t1) end as p2 from p),
r as (select *, case when m2 is null then p2 else (k2 + t2 * p2) / (m2 + t2) end as p3 from q),
scores as (select unit, 1 as model_order, sum(-log2(p1)) as bits, count(*) as events, count_if(oov) as oov from r group by unit
  union all select unit, 2, sum(-log2(p2)), count(*), count_if(oov) from r group by unit union all select unit, 3, sum(-log2(p3)), count(*), count_if(oov) from r group by unit),
deltas as (select a.unit, a.bits - b.bits as delta_bits, a.events from scores a join scores b using (unit) where a.model_order = 1 and b.model_order = 3)"""


@query(_SEQ + " select record_id, section, physical_leaf, unit, symbols from seq")
def line_sequences(spark, sf):
    a, b = parts(spark, sf)
    return a.unionByName(b).select("record_id", "section", "physical_leaf", "unit", "symbols")


@query(_SEQ + """, c as (select h1, h2, s, count(*) as c from ev where not held group by all)
select 2 as history_length, count(distinct (h1, h2)) as contexts, sum(c)::bigint as transitions, count(*) as distinct_edges from c
union all select 1, count(distinct h1), sum(c)::bigint, count(*) from (select h1, s, sum(c) as c from c group by all)
union all select 0, 1, sum(c)::bigint, count(*) from (select s, sum(c) as c from c group by all)""")
def ngram_contexts(spark, sf):
    return N.contexts(N.counts(N.events(parts(spark, sf)[0], 3), 3))


@query(_SEQ + " select h2, h1, s, count(*) as c from ev where not held group by all")
def ngram_counts(spark, sf):
    return N.counts(N.events(parts(spark, sf)[0], 3), 3)[2].select("h2", "h1", "s", "c")


def _scores(spark, sf) -> DataFrame:
    train, test = parts(spark, sf)
    return N.unit_scores(train, test, 3, "unit")


def _deltas(spark, sf) -> DataFrame:
    s = _scores(spark, sf).where("model_order in (1, 3)")
    sign = F.when(F.col("model_order") == 1, F.col("bits")).otherwise(-F.col("bits"))
    return s.groupBy("unit").agg(F.sum(sign).alias("delta_bits"), F.max("events").alias("events"))


@query(_WB + " select unit, model_order, round(bits, 5) as bits, events, oov from scores")
def ngram_score_by_leaf(spark, sf):
    s = _scores(spark, sf)
    return s.withColumn("bits", F.round("bits", 5)).withColumn("oov", F.col("oov").cast("long"))


@query(_WB + """ select model_order, unit, round(sum(bits) / sum(events), 6) as bits_per_event, round(pow(2, sum(bits) / sum(events)), 6) as perplexity, sum(events)::bigint as events
from scores group by grouping sets ((model_order, unit), (model_order))""")
def ngram_score_rollup(spark, sf):
    return N.corpus_rollup(_scores(spark, sf), "unit", "model_order")


@query(_WB + " select unit, round(delta_bits / events, 6) as delta, events, round(delta_bits / sum(delta_bits) over (), 6) as share from deltas")
def delta_by_leaf(spark, sf):
    d = _deltas(spark, sf)
    total = d.agg(F.sum("delta_bits").alias("t"))
    return d.join(F.broadcast(total)).select("unit", F.round(F.col("delta_bits") / F.col("events"), 6).alias("delta"), "events", F.round(F.col("delta_bits") / F.col("t"), 6).alias("share"))


@query(_WB + """, t as (select sum(delta_bits) as b, sum(events) as e from deltas)
select unit, round((b - delta_bits) / nullif(e - events, 0), 6) as delta_without, round(b / e - (b - delta_bits) / nullif(e - events, 0), 6) as influence from deltas, t""")
def leave_one_leaf_out(spark, sf):
    return R.leave_one_out(_deltas(spark, sf))


_FEATURES = BASE + """, r as (select physical_leaf, record_id, token_index, tok, glyphs from tok where not list_contains(glyphs, 'Z1') and physical_leaf is not null),
n as (select physical_leaf, tok, count(*) as n from r group by all),
f as (select physical_leaf, sum(n)::bigint as tokens, count(*) as types, round(count(*) / sum(n), 6) as type_token_ratio, round(count_if(n = 1) / sum(n), 6) as singleton_fraction from n group by physical_leaf),
b as (select x.physical_leaf, x.glyphs[-1] as f, y.glyphs[1] as i, x.tok = y.tok as same from r x join r y on x.record_id = y.record_id and y.token_index = x.token_index + 1),
k as (select physical_leaf, f, i, count(*) as n from b group by all),
c as (select physical_leaf, f, sum(n) as n, sum(n * log2(n)) as x from k group by all),
a as (select physical_leaf, sum(n)::bigint as pairs, round(sum(n * log2(n) - x) / sum(n), 6) as boundary_entropy from c group by physical_leaf),
s as (select physical_leaf, round(avg(same::int), 6) as adjacent_repeats from b group by physical_leaf)"""


def _features(spark, sf) -> DataFrame:
    r = C.tokens(lines(spark, sf), "physical_leaf").where(C.readable(F.col("glyphs")) & F.col("physical_leaf").isNotNull())
    n = r.groupBy("physical_leaf", "tok").agg(F.count("*").alias("n"))
    f = n.groupBy("physical_leaf").agg(
        F.sum("n").alias("tokens"), F.count("*").alias("types"), F.round(F.count("*") / F.sum("n"), 6).alias("type_token_ratio"), F.round(F.count_if(F.col("n") == 1) / F.sum("n"), 6).alias("singleton_fraction")
    )
    over = "over (partition by record_id order by token_index)"
    b = r.select("physical_leaf", "tok", F.element_at("glyphs", -1).alias("f"), F.expr(f"lead(glyphs[0]) {over}").alias("i"), F.expr(f"lead(tok) {over}").alias("next"), F.expr(f"lead(token_index) {over} - token_index").alias("step")).where("step = 1")
    k = b.groupBy("physical_leaf", "f", "i").agg(F.count("*").alias("n"))
    c = k.groupBy("physical_leaf", "f").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("x"))
    a = c.groupBy("physical_leaf").agg(F.sum("n").alias("pairs"), F.round(F.sum(F.col("n") * F.log2("n") - F.col("x")) / F.sum("n"), 6).alias("boundary_entropy"))
    s = b.groupBy("physical_leaf").agg(F.round(F.avg((F.col("tok") == F.col("next")).cast("int")), 6).alias("adjacent_repeats"))
    return f.join(a, "physical_leaf", "left").join(s, "physical_leaf", "left")


@query(_FEATURES + " select * from f left join a using (physical_leaf) left join s using (physical_leaf)")
def leaf_features(spark, sf):
    return _features(spark, sf)


_F = _FEATURES + ", g as (select * from f left join a using (physical_leaf) left join s using (physical_leaf))"


@query(_F + """ select count_if(tokens is not null and boundary_entropy is not null) as n, count_if(tokens is null or boundary_entropy is null) as n_missing, round(corr(tokens, boundary_entropy), 6) as r from g""")
def leaf_correlation(spark, sf):
    return R.correlation(_features(spark, sf), "tokens", "boundary_entropy")


@query(_F + """, w as (select * from g where boundary_entropy is not null), ranks as (select rank() over (order by tokens) + (count(*) over (partition by tokens) - 1) / 2 as x, rank() over (order by boundary_entropy) + (count(*) over (partition by boundary_entropy) - 1) / 2 as y from w)
select count(*) as n, 0 as n_missing, round(corr(x, y), 6) as r from ranks""")
def leaf_rank_correlation(spark, sf):
    w = _features(spark, sf).where("boundary_entropy is not null")
    ranked = R.average_ranks(R.average_ranks(w, "tokens"), "boundary_entropy")
    return R.correlation(ranked, "tokens_rank", "boundary_entropy_rank").withColumn("n_missing", F.col("n_missing").cast("int"))


@query(_F + " select physical_leaf, type_token_ratio, round(((select count(*) from g h where h.type_token_ratio < g.type_token_ratio) + (select count(*) from g h where h.type_token_ratio = g.type_token_ratio) / 2) / (select count(*) from g), 6) as type_token_ratio_percentile from g")
def leaf_percentiles(spark, sf):
    return R.percentile_rank(_features(spark, sf).select("physical_leaf", "type_token_ratio"), "type_token_ratio").select("physical_leaf", "type_token_ratio", "type_token_ratio_percentile")


@query(_F + """, t as (select count(*) as n, sum(tokens) as s, sum(tokens * tokens) as q from g), m as (select physical_leaf, tokens, (s - tokens) / (n - 1) as m, (q - tokens * tokens) / (n - 1) as q from g, t)
select physical_leaf, tokens, round(m, 6) as others_mean, round(sqrt(greatest(q - m * m, 0)), 6) as others_sd, round(case when sqrt(greatest(q - m * m, 0)) > 1e-9 then (tokens - m) / sqrt(greatest(q - m * m, 0)) end, 6) as z from m""")
def leaf_anomalies(spark, sf):
    return R.against_others(_features(spark, sf).select("physical_leaf", "tokens"), "physical_leaf", "tokens")


def _model_scores(spark, sf, make):
    from foliant.operators import sequence_models as Z

    train, test = parts(spark, sf)
    rows = Z.distinct_sequences(train.select("symbols"))
    symbols = Z.vocabulary(train)
    model = Z.best_of(lambda seed: make(Z, symbols, seed), rows, 2)
    return N.corpus_rollup(Z.unit_bits(test, "unit", model), "unit")


@query()
def hidden_markov_score(spark, sf):
    """Held-out leaves under a hidden Markov model of four states, the better of two starts."""
    return _model_scores(spark, sf, lambda Z, v, seed: Z.HiddenMarkov(4, v, seed))


@query()
def slot_grammar_score(spark, sf):
    """Held-out tokens under a slot grammar of four templates, the better of two starts."""
    from foliant.operators import sequence_models as Z

    t = C.tokens(lines(spark, sf).withColumn("unit", N.leaf_group(F.col("physical_leaf"))), "unit", "physical_leaf").where(C.readable(F.col("glyphs"))).withColumnRenamed("glyphs", "symbols")
    held = F.coalesce(F.col("physical_leaf") % 5 == 0, F.lit(False))
    rows, symbols = Z.distinct_sequences(t.where(~held).select("symbols")), Z.vocabulary(t.where(~held))
    model = Z.best_of(lambda seed: Z.SlotGrammar(4, 6, symbols, seed), rows, 2)
    s = Z.unit_bits(t.where(held), "unit", model).withColumn("events", F.col("events") + F.col("sequences"))  # an end is an event
    return N.corpus_rollup(s, "unit")


@query()
def copy_edit_score(spark, sf):
    """Held-out tokens under a model of edited copies of the last four tokens: bits per event, and copies' share of the
    tokens that have something to copy."""
    from foliant.operators import sequence_models as Z

    own = lines(spark, sf).withColumn("unit", N.leaf_group(F.col("physical_leaf")))
    t = Z.copy_sources(C.tokens(own, "unit", "physical_leaf"), 4).withColumn("held", F.coalesce(F.col("physical_leaf") % 5 == 0, F.lit(False)))
    model = Z.CopyEdit(Z.vocabulary(t.where("not held").select(F.col("glyphs").alias("symbols"))), 4)
    model.fit(t.where("not held").select("glyphs", "history"))
    s = Z.copy_scores(t.where("held"), model, "unit")
    return s.agg(F.sum("tokens").alias("tokens"), F.round(F.sum("bits") / F.sum("events"), 6).alias("bits_per_event"), F.round(F.sum("copies") / F.sum("contextual"), 6).alias("copy_share"))


_Z = """select physical_leaf, '{0}' as feature, x as value, round(m, 6) as others_mean, round(sqrt(greatest(q - m * m, 0)), 6) as others_sd, round(case when sqrt(greatest(q - m * m, 0)) > 1e-9 then (x - m) / sqrt(greatest(q - m * m, 0)) end, 6) as z, percentile, median
from (select physical_leaf, x, (sum(x) over () - x) / (count(*) over () - 1) as m, (sum(x * x) over () - x * x) / (count(*) over () - 1) as q, round((rank() over (order by x) - 1 + count(*) over (partition by x) / 2) / count(*) over (), 6) as percentile,
  round((select quantile_cont({0}::double, 0.5) from g), 6) as median from (select physical_leaf, {0}::double as x from g where {0} is not null))"""


@query(_F + " " + " union all ".join(_Z.format(c) for c in ("tokens", "types", "type_token_ratio")))
def leaf_anomaly_table(spark, sf):
    """Each leaf against all others in three features, with its place and the median."""
    return R.anomalies(_features(spark, sf), "physical_leaf", "tokens", "types", "type_token_ratio")


@query(_F + """ select physical_leaf % 3 as part, count_if(tokens > 20 and boundary_entropy is not null) as n, count_if(tokens > 20 and boundary_entropy is null) as n_missing, count_if(not coalesce(tokens > 20, false)) as n_omitted,
round(corr(case when tokens > 20 then tokens end, boundary_entropy), 6) as r from g group by 1""")
def leaf_conditional_correlation(spark, sf):
    """Tokens against boundary entropy over leaves of more than twenty tokens, in three parts."""
    g = _features(spark, sf).withColumn("part", F.col("physical_leaf") % 3)
    return R.conditional_correlation(g, "tokens", "boundary_entropy", F.col("tokens") > 20, "part")


@query(BASE + " select distinct physical_leaf, (('0x' || substr(sha256('5|' || physical_leaf), 1, 16))::ubigint)::varchar as drawn from line where physical_leaf is not null")
def leaf_draws(spark, sf):
    """A 64-bit draw for each leaf."""
    own = lines(spark, sf).where("physical_leaf is not null").select("physical_leaf").distinct()
    return own.select("physical_leaf", R.draw64(F.lit(5), "physical_leaf").cast("string").alias("drawn"))
