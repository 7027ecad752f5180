"""Queries of word boundaries, leaf features, and of where models differ, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import anatomy as A
from foliant.operators import localization as L
from foliant.operators import selection as S
from foliant.operators import splits as P
from foliant.operators import summaries as U
from foliant.plans.evaluation_queries import _LINE, _SPELL, _TOKENS, _tokens, own_lines
from foliant.operators import corpus as C
from foliant.operators import ngram as N
from foliant.session import written

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _all(spark, sf):
    return N.token_sequences(own_lines(spark, sf), "unit")


_B = _TOKENS + """, bd as (select unit, tok, symbols[-2] as f, lead(symbols[1]) over w as i, lead(tok) over w as nxt from tk window w as (partition by record_id, segment order by token_index)), bb as (select * from bd where i is not null)"""
_H = "greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0)"
_R = "round({}, 6) + 0.0 as {}"


@query(_B + f""", n as (select unit, f, i, count(*) as n from bb group by all), j as (select unit, sum(n)::bigint as boundaries, count(*) as pairs, {_H} as p, max(n) as mx, sum(n * n) as sq from n group by unit),
t as (select unit, sum(n) as top from (select *, row_number() over (partition by unit order by n desc, f, i) as r from n) where r <= 5 group by unit),
a as (select unit, {_H} as fb, count(*) as final_glyphs from (select unit, f, sum(n) as n from n group by all) group by unit), b as (select unit, {_H} as ib, count(*) as initial_glyphs from (select unit, i, sum(n) as n from n group by all) group by unit)
select unit, boundaries, pairs, final_glyphs, initial_glyphs, """ + ", ".join(_R.format(x, y) for x, y in (
    ("greatest(p - fb, 0)", "initial_given_final_bits"), ("greatest(p - ib, 0)", "final_given_initial_bits"), ("greatest(fb + ib - p, 0)", "shared_bits"), ("case when p > 1e-12 then greatest(fb + ib - p, 0) / p else 0 end", "shared_fraction"), ("pow(2, fb)", "effective_finals"),
    ("pow(2, ib)", "effective_initials"), ("pow(2, p)", "effective_pairs"), ("pairs / (final_glyphs * initial_glyphs)", "support"), ("mx / boundaries", "commonest"), ("top / boundaries", "five_commonest"), ("sq / (boundaries * boundaries)", "simpson"), ("(boundaries * boundaries) / sq", "effective_simpson_pairs"),
    ("fb", "final_bits"), ("ib", "initial_bits"), ("p", "pair_bits"),
)) + " from j join t using (unit) join a using (unit) join b using (unit)")
def boundary_anatomy(spark, sf):
    return A.boundary_anatomy(A.boundaries(_all(spark, sf), "unit"), "unit")


_TRANS = ", {0}n as (select unit, a, b, count(*) as n from {1} group by all), {0}c as (select unit, a, sum(n) as c, sum(n * log2(n)) as x, count(*) as k from {0}n group by all), {0} as (select unit, sum(c)::bigint as {0}_count, sum(k)::bigint as {0}_pairs, greatest(log2(sum(c)) - sum(x) / sum(c), 0) as {0}_pair_bits, greatest(sum(c * log2(c) - x) / sum(c), 0) as {0}_conditional_bits from {0}c group by unit)"


@query(_B + """, g as (select *, symbols[:-2] as g from tk), bs as (select unit, count(distinct (record_id, segment)) as segments, count(*) as tokens, sum(len(g))::bigint as glyphs, avg(len(g)) as ml, var_pop(len(g)) as lv from g group by unit),
n as (select unit, tok, count(*) as n from g group by all), ty as (select unit, count(*) as types, count_if(n = 1) as once, sum(case when n > 1 then n else 0 end) as rep from n group by unit), mt as (select unit, count(*) as boundaries, avg((tok = nxt)::int) as ar from bb group by unit),
wi as (select unit, g[k] as a, g[k + 1] as b from g, unnest(range(1, len(g))) as q(k)), ac as (select unit, f as a, i as b from bb)""" + _TRANS.format("within", "wi") + _TRANS.format("across", "ac") + """
select unit, segments, tokens, glyphs, types, """ + ", ".join(f"coalesce({c}, 0) as {c}" for c in ("boundaries", "within_count", "within_pairs", "across_count", "across_pairs")) + ", " + ", ".join(_R.format(x, y) for x, y in (
    ("ml", "mean_length"), ("lv", "length_variance"), ("coalesce(boundaries, 0) / glyphs", "boundary_density"), ("types / tokens", "type_token_ratio"), ("rep / tokens", "repeated_fraction"), ("once / tokens", "singleton_fraction"), ("once / types", "singleton_type_fraction"), ("ar", "adjacent_repeats"),
    ("within_pair_bits", "within_pair_bits"), ("within_conditional_bits", "within_conditional_bits"), ("across_pair_bits", "across_pair_bits"), ("across_conditional_bits", "across_conditional_bits"), ("across_conditional_bits - within_conditional_bits", "conditional_gap"), ("across_pair_bits - within_pair_bits", "pair_gap"),
)) + " from bs join ty using (unit) left join mt using (unit) left join within using (unit) left join across using (unit)")
def leaf_boundary_features(spark, sf):
    return A.leaf_features(_all(spark, sf), "unit")


_TOKEN_BITS = _SPELL + """, tb as (select record_id, token_index, sum(-log2(p3)) as trigram_bits, count(*) as events from tr where held group by all),
ct as (select tm.unit, tm.record_id, tm.token_index, tm.h1, tm.s, tb.events, -log2(tm.p2) as token_bits, trigram_bits, -log2(tm.p2) - trigram_bits as d, not tm.oov as seen, tm.strange from tm join tb using (record_id, token_index)),
st as (select h1, s, count(*) as n from lk where not held group by all), tkf as (select s, sum(n)::bigint as current_frequency, count(*) as current_predecessors from st group by s), rk as (select *, row_number() over (order by current_frequency desc, s) as current_rank from tkf),
og as (select h1, sum(n)::bigint as outgoing_total, count(*) as distinct_next, max(n) as most_next from st group by h1)"""


@query(_TOKEN_BITS + """ select ct.unit, ct.record_id, ct.token_index::integer as token_index, ct.events, round(token_bits, 5) as token_bits, round(trigram_bits, 5) as trigram_bits, round(d, 5) as delta_bits, seen, strange as strange_glyphs,
coalesce(rk.current_frequency, 0) as current_frequency, coalesce(rk.current_rank, 0) as current_rank, coalesce(pv.current_frequency, 0) as previous_frequency, coalesce(st.n, 0) as pair_frequency, coalesce(outgoing_total, 0) as outgoing_total, coalesce(distinct_next, 0) as distinct_next,
coalesce(rk.current_predecessors, 0) as current_predecessors, round(coalesce(st.n / nullif(outgoing_total, 0), 0), 9) as conditional_probability, round(coalesce(most_next / nullif(outgoing_total, 0), 0), 9) as concentration
from ct left join rk on rk.s = ct.s left join rk pv on pv.s = ct.h1 left join st on st.h1 = ct.h1 and st.s = ct.s left join og on og.h1 = ct.h1""")
def token_contributions(spark, sf):
    """Every held-out token: its bits under both models and what training knows of the step to it."""
    c = L.contributions(*_tokens(spark, sf))
    names = ("current_frequency", "current_rank", "previous_frequency", "pair_frequency", "outgoing_total", "distinct_next", "current_predecessors")
    return c.select("unit", "record_id", "token_index", "events", *[F.round(x, 5).alias(x) for x in ("token_bits", "trigram_bits", "delta_bits")], "seen", "strange_glyphs", *[F.col(n).cast("long").alias(n) for n in names], "conditional_probability", "concentration")


_BIN = "case when coalesce(rk.current_frequency, 0) <= 0 then '<=0' when rk.current_frequency <= 1 then '<=1' when rk.current_frequency <= 10 then '<=10' when rk.current_frequency <= 100 then '<=100' else '>100' end"


@query(_TOKEN_BITS + f""", bn as (select ct.unit, ct.events, d, {_BIN} as bin from ct left join rk on rk.s = ct.s), ru as (select bin, unit, count(*) as tokens, sum(events) as events, sum(d) as d, count_if(d < 0) as better, sum(greatest(-d, 0)) as ta, sum(greatest(d, 0)) as ga from bn group by all),
by_ as (select bin, count(*) as runs, sum(tokens)::bigint as tokens, sum(events)::bigint as events, sum(d) as d, avg(d / events) as m, stddev_pop(d / events) as sd, sum(better)::bigint as tokens_better, sum(ta) as ta, sum(ga) as ga from ru group by bin)
select bin, runs, tokens, events, """ + ", ".join(_R.format(x, y) for x, y in (("d", "delta_bits"), ("d / events", "delta_per_event"), ("m", "mean_run_delta"), ("sd", "sd_run_delta"), ("tokens_better / tokens", "better_share"), ("ta", "token_advantage"), ("ga", "trigram_advantage"), ("ta / sum(ta) over ()", "share_of_advantage"))) + ", tokens_better from by_")
def contributions_by_frequency(spark, sf):
    """The same by how often training has the token; leaves stand for runs."""
    c = L.contributions(*_tokens(spark, sf)).withColumn("bin", U.upper_bound_bin(F.col("current_frequency"), (0, 1, 10, 100)))
    return L.summarised(c, "unit", [], "bin").withColumns({k: F.col(k).cast("long") for k in ("tokens", "events", "tokens_better")})


@query("select unnest(['competitor', 'trigram', 'delta']) as \"check\", 0::bigint as violations")
def contribution_parity(spark, sf):
    """Tokens' bits add up to what the models give by leaf."""
    train, test = _tokens(spark, sf)
    found = L.totals(L.token_bits(train, test), "unit").select("unit", "competitor", "trigram", "delta")
    a = N.token_scores(train, test, 3, 1, "unit").select("unit", "events", F.col("bits").alias("c"))
    b = N.event_scores(train, test, 3, "unit").where("model_order = 3").select("unit", F.col("total_bits").alias("t"))
    want = a.join(b, "unit").select("unit", (F.col("c") / F.col("events")).alias("competitor"), (F.col("t") / F.col("events")).alias("trigram"), ((F.col("c") - F.col("t")) / F.col("events")).alias("delta"))
    return S.parity_checks(S.parity(found, want, ["unit"], dict.fromkeys(("competitor", "trigram", "delta"), 1e-6)))


_LABEL = _SPELL + ", tri as (select unit, sum(-log2(p3)) as t, count(*) as events from tr where held group by unit), mk as (select unit, sum(-log2(p2)) as c from tm group by unit), lb as (select unit, list_sort(list(distinct scribe) filter (scribe <> 'UNSET')) as v from own group by unit), ll as (select unit, case when v is null or len(v) = 0 then 'UNKNOWN' when len(v) = 1 then v[1] else 'MIXED[' || array_to_string(v, '|') || ']' end as label from lb)"


@query(_LABEL + """ select label, count(*) as units, array_to_string(list_sort(list(unit)), '|') as members, sum(events)::bigint as events, round(sum(c) / sum(events), 6) as competitor_bits_per_event, round(sum(t) / sum(events), 6) as trigram_bits_per_event,
round(sum(c - t) / sum(events), 6) + 0.0 as delta, count_if(c > t) as worse, count_if(c < t) as better from mk join tri using (unit) join ll using (unit) group by label""")
def relation_by_scribe(spark, sf):
    """The token model against the trigram by the scribes of leaves."""
    train, test = _tokens(spark, sf)
    own = own_lines(spark, sf)
    a = N.token_scores(train, test, 3, 1, "unit").select("unit", F.col("bits").alias("competitor_bits"))
    b = N.event_scores(train, test, 3, "unit").where("model_order = 3").select("unit", F.col("total_bits").alias("trigram_bits"), F.col("total_events").alias("events"))
    labels = own.groupBy("unit").agg(P.mixed_label(F.collect_set(F.when(F.col("scribe") != C.UNSET, F.col("scribe")))).alias("label"))
    return A.by_label(a.join(b, "unit"), labels, "unit", "label")


_VIEW_DELTA = "select unit, sum(-log2(p2) + log2(p3)) / count(*) as delta from {} group by unit"


def _boost_sql() -> str:
    from foliant.plans.evaluation_queries import _events, _scored, _sequences

    parts = "".join(_sequences(v) + _events(f"seq_{v}", f"ev_{v}", "unit") + _scored(f"ev_{v}", f"sc_{v}") for v in N.VIEWS)
    a, b = (_VIEW_DELTA.format(f"sc_{v}") for v in N.VIEWS)
    return _LINE + parts + f", a as ({a}), b as ({b}) select unit, round(a.delta, 6) as token_aware_delta, round(b.delta, 6) as space_free_delta, round(a.delta - b.delta, 6) as boost from a join b using (unit)"


@query(_boost_sql())
def boundary_boost(spark, sf):
    """By leaf: what a bigram loses to a trigram in both views, and how much more it is where spaces are kept."""

    def one(view: str):
        s = N.line_sequences(own_lines(spark, sf), "unit", "held", view=view)
        e = written(N.event_scores(s.where("not held"), s.where("held"), 3, "unit"), "scores")
        of = lambda k: e.where(F.col("model_order") == k).select("unit", F.col("total_bits").alias(f"b{k}"), F.col("total_events").alias("n"))
        return of(2).join(of(3).drop("n"), "unit").select("unit", ((F.col("b2") - F.col("b3")) / F.col("n")).alias("delta"))

    out = A.joined_views(one("token_aware"), one("space_free"), "unit", N.VIEWS)
    return out.select("unit", *[F.round(c, 6).alias(c) for c in ("token_aware_delta", "space_free_delta", "boost")])
