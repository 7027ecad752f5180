"""Queries of models scored on held-out leaves at three levels, and of models against each other, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import corpus as C
from foliant.operators import ngram as N
from foliant.operators import resample as R
from foliant.plans.corpus_queries import BASE, lines
from foliant.plans.model_queries import _WB, _deltas
from foliant.session import written

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def own_lines(spark, sf) -> DataFrame:
    held = F.coalesce(F.col("physical_leaf") % 5 == 0, F.lit(False))
    return lines(spark, sf).withColumn("unit", N.leaf_group(F.col("physical_leaf"))).withColumn("held", held)


def halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("not held"), rows.where("held")


#: Lines with their unit, and whether they are held out.
_LINE = BASE + ", own as (select *, coalesce('f' || physical_leaf, 'special') as unit, coalesce(physical_leaf % 5 = 0, false) as held from line)"


def _sequences(view: str) -> str:
    join = " <WB> " if view == "token_aware" else ""
    return f""", padded_{view} as (select record_id, folio, locus, unit, held, unnest(string_split(array_to_string(list_transform(tokens, lambda t: array_to_string(list_transform(t, lambda g: ' ' || g || ' '), '')), '{join}'), ' Z1 ')) as part from own),
seq_{view} as (select record_id, folio, locus, unit, held, regexp_split_to_array(p, ' +') as symbols from (select *, trim(regexp_replace(part, '^( *<WB> *)+|( *<WB> *)+$', '', 'g'), ' ') as p from padded_{view}) where p <> '')"""


def _events(sequences: str, name: str, keys: str) -> str:
    return f""", {name} as (select {keys}, held, symbols[i] as s, coalesce(case when i > 1 then symbols[i - 1] end, '<BOS>') as h1, coalesce(case when i > 2 then symbols[i - 2] end, '<BOS>') as h2 from {sequences}, unnest(range(1, len(symbols) + 1)) as p(i))"""


def _scored(events: str, name: str, which: str = "e.held", base: str | None = None) -> str:
    """A table {name}: the events with p1 to p3 under models of those that are not held out; base: a column in the place of
    the share of unseen mass."""
    first = f"(coalesce(c0.c, 0) + n0.t * e.{base}) / (n0.n + n0.t)" if base else "coalesce(c0.c, n0.t) / (n0.n + n0.t)"
    return f""", {name}_2 as (select h1, h2, s, count(*) as c from {events} where not held group by all), {name}_1 as (select h1, s, sum(c) as c from {name}_2 group by all), {name}_0 as (select s, sum(c) as c from {name}_2 group by all),
{name}_m2 as (select h1, h2, sum(c) as n, count(*) as t from {name}_2 group by all), {name}_m1 as (select h1, sum(c) as n, count(*) as t from {name}_1 group by all), {name}_m0 as (select sum(c) as n, count(*) as t from {name}_0),
{name}_p as (select e.*, c0.c is null as oov, {first} as p1, n1.n as m1, coalesce(c1.c, 0) as k1, n1.t as t1, n2.n as m2, coalesce(c2.c, 0) as k2, n2.t as t2
  from {events} e cross join {name}_m0 n0 left join {name}_0 c0 on e.s = c0.s left join {name}_1 c1 on e.h1 = c1.h1 and e.s = c1.s left join {name}_m1 n1 on e.h1 = n1.h1
  left join {name}_2 c2 on e.h1 = c2.h1 and e.h2 = c2.h2 and e.s = c2.s left join {name}_m2 n2 on e.h1 = n2.h1 and e.h2 = n2.h2 where {which}),
{name}_q as (select *, case when m1 is null then p1 else (k1 + t1 * p1) / (m1 + t1) end as p2 from {name}_p),
{name} as (select *, case when m2 is null then p2 else (k2 + t2 * p2) / (m2 + t2) end as p3 from {name}_q)"""


def _levels(view: str) -> str:
    return _sequences(view) + _events(f"seq_{view}", f"ev_{view}", "folio, locus, unit") + _scored(f"ev_{view}", f"sc_{view}") + f""",
lv_{view} as (select '{view}' as view, folio, locus, unit, s = '<WB>' as wb, oov, o as model_order, -log2(case o when 1 then p1 when 2 then p2 else p3 end) as b from sc_{view}, (select unnest([1, 2, 3]) as o))"""


_R = "round({}, 5) + 0.0 as {}"


@query(_LINE + _levels("token_aware") + _levels("space_free") + """, al as (select * from lv_token_aware union all select * from lv_space_free),
g as (select view, model_order, unit, folio, locus, case when grouping(unit) = 1 then 'corpus' when grouping(locus) = 1 then 'unit' else 'line' end as level, sum(b) as total_bits, count(*) as total_events, sum(case when wb then 0 else b end) as glyph_bits, count_if(not wb) as glyph_events,
  sum(case when wb then b else 0 end) as boundary_bits, count_if(wb) as boundary_events, count_if(oov) as oov_events from al group by grouping sets ((view, model_order, unit, folio, locus), (view, model_order, unit), (view, model_order))),
f as (select view, total_bits as t1, total_bits / total_events as b1 from g where level = 'corpus' and model_order = 1)
select view, model_order, unit, folio, locus, level, """ + ", ".join(_R.format(x, y) for x, y in (("total_bits", "total_bits"), ("glyph_bits", "glyph_bits"), ("boundary_bits", "boundary_bits"), ("total_bits / total_events", "bits_per_event"), ("pow(2, total_bits / total_events)", "perplexity"), ("glyph_bits / nullif(glyph_events, 0)", "glyph_bits_per_glyph"), ("boundary_bits / nullif(boundary_events, 0)", "boundary_bits_per_boundary"), ("case when level = 'corpus' then b1 - total_bits / total_events end", "bits_saved"), ("case when level = 'corpus' then 1 - total_bits / t1 end", "share_saved"))) + """,
total_events, glyph_events, boundary_events, oov_events from g join f using (view)""")  # fmt: skip
def ngram_three_levels(spark, sf):
    """Both views, by line, leaf and corpus."""
    own = own_lines(spark, sf)

    def one(view: str) -> DataFrame:
        train, test = halves(N.line_sequences(own, "folio", "locus", "unit", "held", view=view))
        s = N.three_levels(N.event_scores(train, test, 3, "unit", "folio", "locus"), "model_order", "unit", "folio", "locus")
        return s.withColumn("view", F.lit(view)).withColumns({c: F.col(c).cast("long") for c in N.SUMS if c.endswith("events")})

    return one("token_aware").unionByName(one("space_free"))


@query(_LINE + _sequences("space_free") + " select record_id, unit, symbols from seq_space_free")
def space_free_sequences(spark, sf):
    return N.line_sequences(own_lines(spark, sf), "unit", view="space_free").select("record_id", "unit", "symbols")


#: Tokens as sequences of their own, with the segment that an unreadable one ends.
_TOKENS = _LINE + """, br as (select o.record_id, o.unit, o.held, t.token_index, t.tok, t.glyphs, list_contains(t.glyphs, 'Z1') as bad, count_if(list_contains(t.glyphs, 'Z1')) over (partition by t.record_id order by t.token_index) as segment from tok t join own o using (record_id)),
tk as (select record_id, unit, held, segment, token_index, tok, list_append(glyphs, '<EOT>') as symbols from br where not bad)"""
_TRIGRAM = _TOKENS + _events("tk", "te", "record_id, token_index, tok, unit")
_LINKED = ", lk as (select unit, held, record_id, segment, token_index, tok as s, lag(tok, 1, '<TOKEN_BOS>') over w as h1, lag(tok, 2, '<TOKEN_BOS>') over w as h2 from tk window w as (partition by record_id, segment order by token_index))"


def _tokens(spark, sf) -> tuple[DataFrame, DataFrame]:
    return halves(N.token_sequences(own_lines(spark, sf), "unit", "held"))


_SPELL = _TRIGRAM + _scored("te", "tr", "true") + """, spell as (select tok, record_id, token_index, exp(sum(ln(p3))) as spelling, count(*) as size, count_if(oov) as strange from tr group by all),
sp as (select tok, any_value(spelling) as spelling, any_value(size) as size, any_value(strange) as strange from spell group by tok)""" + _LINKED + ", le as (select lk.*, spelling, size, strange from lk join sp on sp.tok = lk.s)" + _scored("le", "tm", base="spelling")


@query(_SPELL + """ select unit, 1 as context_order, round(sum(-log2(p2)), 5) as bits, count(*) as tokens, sum(size)::bigint as events, count_if(oov) as oov_tokens, sum(strange)::bigint as oov_glyphs from tm group by unit
union all select unit, 2, round(sum(-log2(p3)), 5), count(*), sum(size)::bigint, count_if(oov), sum(strange)::bigint from tm group by unit""")
def token_markov_score(spark, sf):
    """Held-out tokens by leaf under one and two tokens of context, which an unreadable token ends."""
    s = N.token_scores(*_tokens(spark, sf), 3, 2, "unit")
    return s.withColumn("bits", F.round("bits", 5)).withColumns({c: F.col(c).cast("long") for c in ("oov_tokens", "oov_glyphs")})


@query(_TOKENS + _LINKED + """, c2 as (select h1, h2, s, count(*) as c from lk where not held group by all)
select 2 as history_length, count(distinct (h1, h2)) as contexts, sum(c)::bigint as transitions, count(*) as distinct_edges from c2
union all select 1, count(distinct h1), sum(c)::bigint, count(*) from (select h1, s, sum(c) as c from c2 group by all) union all select 0, 1, sum(c)::bigint, count(*) from (select s, sum(c) as c from c2 group by all)""")
def token_contexts(spark, sf):
    return N.contexts(N.counts(N.linked(_tokens(spark, sf)[0], 2), 3))


_TRI = _TRIGRAM + _scored("te", "tr") + ", tri as (select unit, sum(-log2(p3)) as bits, count(*) as events, count_if(oov) as oov from tr group by unit)"


def _trigram(train: DataFrame, test: DataFrame) -> DataFrame:
    s = N.event_scores(train, test, 3, "unit").where("model_order = 3")
    return s.select("unit", F.col("total_bits").alias("bits"), F.col("total_events").alias("events"), F.col("oov_events").alias("oov"))


@query(_TRI + " select unit, round(bits, 5) as bits, events, oov from tri")
def matched_trigram_score(spark, sf):
    """The character model on tokens with ends, which the token models are compared with."""
    return _trigram(*_tokens(spark, sf)).withColumn("bits", F.round("bits", 5)).withColumn("oov", F.col("oov").cast("long"))


REPLICATES = 10_000


def _boot(deltas: str) -> str:
    """Replicates of a table (unit, delta_bits, events), as the operator draws them."""
    return f""", nu as (select unit, delta_bits, events, row_number() over (order by substr(sha256(unit), 1, 3), unit) - 1 as number, count(*) over () as units from {deltas}),
dr as (select replicate, (('0x' || substr(sha256('0|' || replicate || '|' || i), 1, 8))::bigint % any_value(units)) as number, i from range({REPLICATES}) r(replicate), (select units, unnest(range(units)) as i from (select max(units) as units from nu)) group by replicate, i),
rp as (select replicate, sum(delta_bits) / sum(events) as delta from dr join nu using (number) group by replicate),
iv as (select count(*) as replicates, round(avg(delta), 6) as mean, round(quantile_cont(delta, 0.025), 6) as lower, round(quantile_cont(delta, 0.975), 6) as upper, round(avg((delta > 0)::int::double), 6) as share_above_zero from rp)"""


@query(_WB + _boot("deltas") + " select * from iv")
def paired_bootstrap(spark, sf):
    """Order 1 against order 3, by leaf."""
    return R.interval(R.paired_bootstrap(_deltas(spark, sf), REPLICATES))


def _relation(name: str, both: str) -> str:
    """both: a table (unit, c, t, events)."""
    return f", both_ as ({both}), dl as (select unit, c - t as delta_bits, events from both_)" + _boot("dl") + f""" select '{name}' as relation, units, events, competitor_bits_per_event, trigram_bits_per_event, delta, replicates, lower, upper, share_above_zero as share_worse,
case when lower > 0 then 'worse' when upper < 0 then 'better' else 'open' end as direction
from iv, (select count(*) as units, sum(events)::bigint as events, round(sum(c) / sum(events), 6) as competitor_bits_per_event, round(sum(t) / sum(events), 6) as trigram_bits_per_event, round(sum(c - t) / sum(events), 6) as delta from both_)"""


@query(_SPELL + ", tri as (select unit, sum(-log2(p3)) as bits, count(*) as events from tr where held group by unit), mk as (select unit, sum(-log2(p2)) as bits from tm group by unit)" + _relation("token_markov", "select unit, mk.bits as c, tri.bits as t, events from mk join tri using (unit)"))
def relation_token_markov(spark, sf):
    """The token model of one token of context against the matched trigram."""
    train, test = _tokens(spark, sf)
    own = N.token_scores(train, test, 3, 1, "unit").select("unit", "bits", "events")
    return R.relation("token_markov", own, _trigram(train, test).drop("oov"), REPLICATES)


@query(_LINE + _sequences("space_free") + _events("seq_space_free", "ev", "unit") + _scored("ev", "sc") + _relation("bigram_space_free", "select unit, sum(-log2(p2)) as c, sum(-log2(p3)) as t, count(*) as events from sc group by unit"))
def relation_bigram(spark, sf):
    """Order 2 against order 3, without spaces."""
    train, test = halves(N.line_sequences(own_lines(spark, sf), "unit", "held", view="space_free"))
    s = written(N.event_scores(train, test, 3, "unit"), "scores")
    of = lambda k: s.where(F.col("model_order") == k).select("unit", F.col("total_bits").alias("bits"), F.col("total_events").alias("events"))
    return R.relation("bigram_space_free", of(2), of(3), REPLICATES)


def _hidden_markov(spark, sf, view: str, states: int, restarts: int) -> DataFrame:
    from foliant.operators import sequence_models as Z

    train, test = halves(written(N.line_sequences(own_lines(spark, sf), "unit", "held", view=view), "lines"))
    rows = Z.distinct_sequences(train.select("symbols"))
    symbols = Z.vocabulary(rows)
    model = Z.best_of(lambda seed: Z.HiddenMarkov(states, symbols, seed), rows, restarts)
    t = N.event_scores(train, test, 3, "unit").where("model_order = 3").select("unit", F.col("total_bits").alias("bits"), F.col("total_events").alias("events"))
    return R.relation(f"hidden_markov_{view}", Z.unit_bits(test, "unit", model).select("unit", "bits", "events"), t, REPLICATES)


@query()
def relation_hidden_markov(spark, sf):
    """Hidden Markov models of two states, the better of two starts, in both views against their trigrams."""
    return reduce(DataFrame.unionByName, (_hidden_markov(spark, sf, view, 2, 2) for view in N.VIEWS))


@query()
def relation_slot_grammar(spark, sf):
    """The slot grammar of four templates, the better of two starts, against the matched trigram."""
    from foliant.operators import sequence_models as Z

    train, test = _tokens(spark, sf)
    bare = lambda rows: rows.withColumn("symbols", F.slice("symbols", 1, F.size("symbols") - 1))
    model = Z.best_of(lambda seed: Z.SlotGrammar(4, 6, Z.vocabulary(bare(train)), seed), Z.distinct_sequences(bare(train).select("symbols")), 2)
    own = Z.unit_bits(bare(test), "unit", model)
    # an end is an event of the slot grammar's length, as of the trigram
    own = own.select("unit", "bits", (F.col("events") + F.col("sequences")).alias("events"))
    return R.relation("slot_grammar", own, _trigram(train, test).drop("oov"), REPLICATES)


@query()
def relation_copy_edit(spark, sf):
    """Edited copies of the last four tokens against the matched trigram."""
    from foliant.operators import sequence_models as Z

    train, test = _tokens(spark, sf)
    t = Z.copy_sources(C.tokens(own_lines(spark, sf), "unit", "held"), 4)
    a, b = halves(t)
    model = Z.CopyEdit(Z.vocabulary(a.select(F.col("glyphs").alias("symbols"))), 4)
    model.fit(a.select("glyphs", "history"))
    own = Z.copy_scores(b, model, "unit").select("unit", "bits", "events")
    return R.relation("copy_edit", own, _trigram(train, test).drop("oov"), REPLICATES)
