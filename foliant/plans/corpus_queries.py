"""Queries of the corpus statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import corpus as C
from foliant.session import table


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return C.analytical_lines(table(spark, sf, "analytical_loci"))


#: Common tables of the SQL: line (one row a record), tok (one row a token).
BASE = """with line as (
  select record_id, any_value(folio) as folio, any_value(physical_leaf) as physical_leaf, coalesce(any_value(section), 'UNSET') as section,
    coalesce(any_value(currier), 'UNSET') as currier, coalesce(any_value(scribe), 'UNSET') as scribe, any_value(locus) as locus, any_value(locus_type) as locus_type,
    any_value(paragraph) as paragraph, any_value(line) as line, any_value(source_line_number) as source_line_number,
    list_filter(list_transform(coalesce(any_value(tokens), []), lambda t: list_filter(coalesce(t, []), lambda g: g is not null and g <> '')), lambda t: len(t) > 0) as tokens
  from analytical_loci group by record_id
), tok as (
  select record_id, physical_leaf, folio, section, currier, scribe, paragraph, line, i - 1 as token_index, g as glyphs, array_to_string(g, chr(31)) as tok
  from (select *, unnest(tokens) as g, generate_subscripts(tokens, 1) as i from line)
)"""

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query(BASE + " select tok, count(*) as n from tok group by tok")
def token_frequency(spark, sf):
    return C.tokens(lines(spark, sf)).groupBy("tok").agg(F.count("*").alias("n"))


@query(BASE + ", n as (select tok, count(*) as n from tok where not list_contains(glyphs, 'Z1') group by tok) select tok, n, row_number() over (order by n desc, tok) as rank from n order by n desc, tok limit 50")
def top_tokens(spark, sf):
    return C.ranked_tokens(lines(spark, sf), 50).select("tok", "n", "rank")


@query(BASE + """, g as (select section, currier, scribe, unnest(glyphs) as glyph from tok)
select section, currier, scribe, glyph, count(*) as n from g group by grouping sets ((section, glyph), (currier, glyph), (scribe, glyph))""")
def glyph_frequency_by_group(spark, sf):
    g = C.glyphs(lines(spark, sf), "section", "currier", "scribe").select("section", "currier", "scribe", "glyph")
    return g.groupingSets([["section", "glyph"], ["currier", "glyph"], ["scribe", "glyph"]], "section", "currier", "scribe", "glyph").agg(F.count("*").alias("n"))


@query(BASE + """ select section, count(*) as n, min(len(glyphs)) as min, max(len(glyphs)) as max, round(avg(len(glyphs)), 6) as mean, round(quantile_cont(len(glyphs), 0.25), 6) as p25,
round(quantile_cont(len(glyphs), 0.5), 6) as median, round(quantile_cont(len(glyphs), 0.75), 6) as p75, round(quantile_cont(len(glyphs), 0.95), 6) as p95 from tok group by section""")
def token_length_statistics(spark, sf):
    return C.length_statistics(C.tokens(lines(spark, sf), "section").withColumn("size", F.size("glyphs")), "size", "section")


@query(BASE + ", n as (select section, tok, count(*) as n from tok where not list_contains(glyphs, 'Z1') group by all) select section, sum(n)::bigint as observations, count(*) as states, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as entropy_bits from n group by section")
def token_entropy(spark, sf):
    n = C.tokens(lines(spark, sf), "section").where(C.readable(F.col("glyphs"))).groupBy("section", "tok").agg(F.count("*").alias("n"))
    return C.entropy(n, ["section"])


def _conditional(order: int) -> str:
    return BASE + f""", w as (select section, unnest(list_transform(range(1, greatest(len(glyphs) - {order}, 0) + 1), lambda i: glyphs[i:i + {order}])) as w from tok),
n as (select section, w, w[1:{order}] as context, count(*) as n from w where not list_contains(w, 'Z1') group by all),
c as (select section, context, sum(n) as c, sum(n * log2(n)) as x from n group by all)
select section, sum(c)::bigint as observations, count(*) as contexts, round(sum(c * log2(c) - x) / sum(c), 6) as entropy_bits, round(avg(log2(c) - x / c), 6) as branching_bits, {order} as "order" from c group by section"""


def _make_conditional(order: int):
    def run(spark, sf):
        return C.conditional_entropy(lines(spark, sf), order, "section")

    run.__name__ = f"conditional_entropy_{order}"
    return query(_conditional(order))(run)


for _k in (1, 2, 3, 4):
    _make_conditional(_k)

_MI = """, joint as (select distance, a, b, count(*) as n from pairs group by all),
j as (select distance, sum(n)::bigint as pairs, sum(n * log2(n)) as jx from joint group by distance),
l as (select distance, count(*) as left_states, sum(n * log2(n)) as lx from (select distance, a, sum(n) as n from joint group by all) group by distance),
r as (select distance, count(*) as right_states, sum(n * log2(n)) as rx from (select distance, b, sum(n) as n from joint group by all) group by distance)
select distance, pairs, left_states, right_states, round(log2(pairs) + (jx - lx - rx) / pairs, 6) + 0.0 as mi_bits from j join l using (distance) join r using (distance)"""


@query(BASE + """, pairs as (select d as distance, glyphs[i] as a, glyphs[i + d] as b from tok, unnest([1, 2, 3, 4, 5, 6, 7, 8]) as s(d), unnest(range(1, len(glyphs) - d + 1)) as p(i)
where i + d <= len(glyphs) and glyphs[i] <> 'Z1' and glyphs[i + d] <> 'Z1')""" + _MI)
def glyph_mutual_information(spark, sf):
    return C.mutual_information(C.glyph_pairs(lines(spark, sf), 8), "distance")


@query(BASE + """, pairs as (select y.token_index - x.token_index as distance, x.tok as a, y.tok as b from tok x join tok y on x.record_id = y.record_id and y.token_index - x.token_index between 1 and 4
where not list_contains(x.glyphs, 'Z1') and not list_contains(y.glyphs, 'Z1'))""" + _MI)
def token_mutual_information(spark, sf):
    return C.mutual_information(C.token_pairs(lines(spark, sf), 4), "distance")


_GLYPH_POSITIONS = BASE + """, k as (select list_filter(glyphs, lambda g: g <> 'Z1') as g from tok),
p as (select 'initial' as position, g[1] as item from k where len(g) > 0 union all select 'medial', unnest(g[2:-2]) from k where len(g) > 2 union all select 'final', g[-1] from k where len(g) > 0),
n as (select position, item, count(*) as n from p group by all)"""
_TOKEN_POSITIONS = BASE + """, k as (select list_transform(list_filter(tokens, lambda t: not list_contains(t, 'Z1')), lambda t: array_to_string(t, chr(31))) as g from line),
p as (select 'initial' as position, g[1] as item from k where len(g) > 0 union all select 'medial', unnest(g[2:-2]) from k where len(g) > 2 union all select 'final', g[-1] from k where len(g) > 0),
n as (select position, item, count(*) as n from p group by all)"""
_ENTROPY = " select position, sum(n)::bigint as observations, count(*) as states, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as entropy_bits from n group by position"


def _jsd(label: str, item: str) -> str:
    return f""", p0 as (select {label} as l, {item} as i, n / sum(n) over (partition by {label}) as p from n),
mixed as (select x.a, x.b, i, sum(p) / 2 as m, sum(p * log2(p)) as x from (select l1.l as a, l2.l as b from (select distinct l from p0) l1 join (select distinct l from p0) l2 on l1.l < l2.l) x join p0 on p0.l in (x.a, x.b) group by all)
select a, b, round(greatest(0.0, sum(x / 2 - m * log2(m))), 6) + 0.0 as jsd_bits from mixed group by a, b"""


@query(_GLYPH_POSITIONS + " select * from n")
def glyph_position_counts(spark, sf):
    return C.glyph_positions(lines(spark, sf))


@query(_GLYPH_POSITIONS + _ENTROPY)
def glyph_position_entropy(spark, sf):
    return C.entropy(C.glyph_positions(lines(spark, sf)), ["position"])


@query(_GLYPH_POSITIONS + _jsd("position", "item"))
def glyph_position_divergence(spark, sf):
    return C.divergences(C.glyph_positions(lines(spark, sf)), "position")


@query(_TOKEN_POSITIONS + _ENTROPY)
def token_position_entropy(spark, sf):
    return C.entropy(C.token_positions(lines(spark, sf)), ["position"])


@query(_TOKEN_POSITIONS + _jsd("position", "item"))
def token_position_divergence(spark, sf):
    return C.divergences(C.token_positions(lines(spark, sf)), "position")


@query(BASE + ", n as (select section, g as item, count(*) as n from (select section, unnest(glyphs) as g from tok) where g <> 'Z1' group by all)" + _jsd("section", "item"))
def section_glyph_divergence(spark, sf):
    g = C.glyphs(lines(spark, sf), "section").where(F.col("glyph") != C.UNKNOWN)
    return C.divergences(g.groupBy("section", F.col("glyph").alias("item")).agg(F.count("*").alias("n")), "section")


_EDIT = BASE + """, best as (select tok, any_value(glyphs) as glyphs, count(*) as n from tok where not list_contains(glyphs, 'Z1') group by tok order by n desc, tok limit 300),
ranked as (select *, row_number() over (order by n desc, tok) as rank from best),
codes as (select glyph, chr(cast(33 + row_number() over (order by glyph) as integer)) as c from (select distinct unnest(glyphs) as glyph from best)),
spelled as (select tok, any_value(rank) as rank, any_value(n) as n, string_agg(c, '' order by pos) as s from (select tok, rank, n, unnest(glyphs) as glyph, generate_subscripts(glyphs, 1) as pos from ranked) join codes using (glyph) group by tok),
near as (select x.tok as a, y.tok as b, levenshtein(x.s, y.s) as distance from spelled x join spelled y on x.rank < y.rank and abs(length(x.s) - length(y.s)) <= 2)"""


@query(_EDIT + " select a, b, distance::integer as distance from near where distance between 1 and 2")
def edit_neighbourhoods(spark, sf):
    return C.edit_neighbourhoods(lines(spark, sf))


@query(_EDIT + """, ends as (select a as tok, distance from near where distance between 1 and 2 union all select b, distance from near where distance between 1 and 2),
c as (select s.tok, s.n, count(e.distance) as neighbours from spelled s left join ends e using (tok) group by all)
select round(avg(neighbours), 6) as mean_neighbours, round(sum(n * neighbours) / sum(n), 6) as weighted_neighbours from c""")
def edit_summary(spark, sf):
    near = C.edit_neighbourhoods(lines(spark, sf))
    ends = near.select(F.explode(F.array("a", "b")).alias("tok")).groupBy("tok").agg(F.count("*").alias("neighbours"))
    c = C.ranked_tokens(lines(spark, sf), 300).join(ends, "tok", "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))
    return c.agg(F.round(F.avg("neighbours"), 6).alias("mean_neighbours"), F.round(F.sum(F.col("n") * F.col("neighbours")) / F.sum("n"), 6).alias("weighted_neighbours"))


@query(BASE + """ select folio, paragraph, count(*) as lines, flatten(list(tokens order by line, source_line_number, record_id)) as tokens from line where paragraph is not null group by folio, paragraph""")
def paragraph_tokens(spark, sf):
    return C.paragraph_tokens(lines(spark, sf))


@query(BASE + """, b as (select *, sum(list_contains(glyphs, 'Z1')::int) over (partition by record_id order by token_index) as part from tok),
g as (select record_id, part, list(tok order by token_index) as tokens from b where not list_contains(glyphs, 'Z1') group by all)
select record_id, row_number() over (partition by record_id order by part) - 1 as segment, tokens from g""")
def segments(spark, sf):
    return C.segments(lines(spark, sf))


@query(BASE + ", n as (select section, tok, count(*) as n from tok group by all) select section, sum(n)::bigint as tokens, count(*) as types, round(count(*) / sum(n), 6) as type_token_ratio, round(count_if(n = 1) / count(*), 6) as hapax_ratio, round(max(n) / sum(n), 6) as top_share from n group by section")
def corpus_measures(spark, sf):
    return C.corpus_measures(lines(spark, sf), "section")
