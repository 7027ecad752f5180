"""Queries of three-way comparison and of samples for review, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import plain_text, squeezed
from foliant.operators import compare as M
from foliant.operators import review as V
from foliant.plans.source_queries import _REC
from foliant.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_PLAIN = "text_normalized"
for _a, _b in ((r"<[-~]>", "."), (r"<[^>]*>", ""), (r"\[([^:\[\]]*):[^\[\]]*\]", r"\1"), (r"[{}]", ""), (r"[.,\s]+", " ")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_a}', '{_b}', 'g')"
_TOP = "with top as (select transcription_id, row_number() over (order by count(*) desc, transcription_id) as k from readings group by transcription_id order by k limit 3)"
_LINES = _TOP + f""", r as (select locus, transcription_id, arg_max(canonical_glyph_text, (read_at, reading_id)) as c, arg_max(text_normalized, (read_at, reading_id)) as text_normalized from readings where locus is not null group by all),
l as (select locus as line_key, k, string_split(trim(regexp_replace(c, '\\s+', ' ', 'g')), ' ') as g, text_normalized as t, len(list_filter(string_split(trim(regexp_replace(c, '\\s+', ' ', 'g')), ' '), lambda x: x = 'Z1')) as unknown,
  length(text_normalized) - length(replace(text_normalized, ',', '')) as sp, len(regexp_extract_all(text_normalized, '\\[[^:\\[\\]]*:[^\\[\\]]*\\]')) as alt from r join top using (transcription_id) where trim(regexp_replace(c, '\\s+', ' ', 'g')) <> '' and text_normalized is not null),
w as (select line_key, k, g, string_split(trim({_PLAIN.replace('text_normalized', 't')}, ' '), ' ') as tk, coalesce(unknown, 0) + coalesce(sp, 0) + coalesce(alt, 0) as doubts from l)"""


def _lines(spark, sf) -> tuple[DataFrame, list[str]]:
    """(a row for each line and one of the three most frequent readers, these readers). A token is a word of the native
    text; its glyphs are the reading's where there is one word."""
    readings = table(spark, sf, "readings")
    top = [r["transcription_id"] for r in readings.groupBy("transcription_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "transcription_id").limit(3).collect()]
    last = readings.where("locus is not null").groupBy("locus", "transcription_id").agg(F.max_by(F.struct("canonical_glyph_text", "text_normalized"), F.struct("read_at", "reading_id")).alias("r"))
    own = last.select(F.col("locus").alias("line_key"), F.col("transcription_id").alias("corpus"), squeezed(F.col("r.canonical_glyph_text")).alias("g"), F.col("r.text_normalized").alias("t")).where("g is not null and t is not null")
    m = M.markup(F.col("t"))
    words = F.split(plain_text(F.col("t")), " ")
    glyphs = F.split("g", " ")
    return own.select(
        "line_key", "corpus", F.array(glyphs).alias("glyphs"), F.transform(words, lambda w: F.array(w)).alias("words"), F.size(F.filter(glyphs, lambda x: x == "Z1")).alias("unknown"),
        m["uncertain_spaces"].alias("doubtful_spaces"), m["alternative_readings"].alias("alternatives"),
    ), top


_SIM = "case when greatest(len({a}), len({b})) = 0 then 1 else 1 - levenshtein({s}) / greatest(len({a}), len({b})) end"


@query(_LINES + """, p as (select a.line_key, a.tk as ta, b.tk as tb, c.tk as tc, a.doubts + b.doubts + c.doubts as doubts from w a join w b using (line_key) join w c using (line_key) where a.k = 1 and b.k = 2 and c.k = 3)
select line_key, ta = tb as tokens_01, ta = tc as tokens_02, tb = tc as tokens_12, tb = tc and ta <> tb as tokens_against, (ta = tb)::integer + (ta = tc)::integer as supporters, doubts from p""")
def three_way_agreement(spark, sf):
    """Lines that the three most frequent readers read: which of them agree, and the doubts they mark."""
    rows, top = _lines(spark, sf)
    three = V.three_way(rows.withColumn("tokens", F.col("words")), top)
    return three.select("line_key", "tokens_01", "tokens_02", "tokens_12", "tokens_against", "supporters", F.col("doubts").cast("long").alias("doubts"))


_CODE = """list_reduce(list_prepend('', {x}), lambda s, i: s || chr(cast(32 + list_position(n, i) as integer)))"""


@query(_LINES + f""", q as (select a.line_key, a.k as x, b.k as y, a.g as ga, b.g as gb, list_sort(list_distinct(list_concat(a.g, b.g))) as n from w a join w b using (line_key) where a.k < b.k),
s as (select line_key, x, y, {_SIM.format(a='ga', b='gb', s=_CODE.format(x='ga') + ', ' + _CODE.format(x='gb'))} as sim from q)
select line_key, round(min(sim), 6) as least_similarity, round(avg(sim), 6) as mean_similarity from s group by line_key having count(*) = 3""")
def three_way_similarity(spark, sf):
    rows, top = _lines(spark, sf)
    three = V.three_way(rows.withColumn("tokens", F.col("glyphs")), top)
    return three.select("line_key", F.round("least_similarity", 6).alias("least_similarity"), F.round("mean_similarity", 6).alias("mean_similarity"))


_CLASSED = _LINES + f""", q as (select a.line_key, a.tk as ta, b.tk as tb, c.tk as tc, a.doubts + b.doubts + c.doubts as doubts from w a join w b using (line_key) join w c using (line_key) where a.k = 1 and b.k = 2 and c.k = 3),
e as (select line_key, 1 as i, ta as x, tb as y from q union all select line_key, 2, ta, tc from q union all select line_key, 3, tb, tc from q), n as (select *, list_distinct(list_concat(x, y)) as n from e),
sm as (select line_key, min(round({_SIM.format(a='x', b='y', s=_CODE.format(x='x') + ', ' + _CODE.format(x='y'))}, 9)) as least from n group by line_key),
cl as (select line_key, case when tb = tc and ta <> tb then 'others_agree_against_primary' when least < 0.8 then 'low_agreement' when ta = tb and tb = tc then case when doubts > 0 then 'exact_with_doubts' else 'exact' end
  when least < 0.95 then 'moderate_agreement' when (ta = tb)::int + (ta = tc)::int = 1 then 'primary_supported_by_one' else 'high_but_not_exact' end as class,
  round(case when tb = tc and ta <> tb then 1000 + 100 * (1 - least) + doubts when least < 0.8 then 900 + 100 * (1 - least) + doubts when ta = tb and tb = tc then case when doubts > 0 then 40 + doubts else 0 end
  when least < 0.95 then 650 + 100 * (1 - least) + doubts when (ta = tb)::int + (ta = tc)::int = 1 then 350 + 100 * (1 - least) + doubts else 450 + 100 * (1 - least) + doubts end, 6) as priority,
  tb = tc and ta <> tb as mandatory, ta = tb and tb = tc as exact from q join sm using (line_key))"""


def _classified(spark, sf) -> DataFrame:
    rows, top = _lines(spark, sf)
    return V.classified(V.three_way(rows.withColumn("tokens", F.col("words")), top))


@query(_CLASSED + " select line_key, class, mandatory, priority from cl")
def three_way_classes(spark, sf):
    return _classified(spark, sf).select("line_key", "class", "mandatory", "priority")


_PAGE = "regexp_extract(line_key, '^([^.]*)', 1)"
_REVIEW = f""", rw as (select line_key, {_PAGE} as page, row_number() over (order by line_key) as place, mandatory, exact, priority from cl),
md as (select *, 0 as step from rw where mandatory), need as (select greatest(40 - count(*), 0) as n from md), us as (select page, count(*) as used from md group by page),
rk as (select rw.*, row_number() over (partition by page order by priority desc, place, line_key) + coalesce(used, 0) as r from rw left join us using (page) where not mandatory and not exact),
f1 as (select * from (select line_key, page, place, mandatory, exact, priority, 1 as step, row_number() over (order by priority desc, place, line_key) as q from rk where r <= 2), need where q <= n),
f2 as (select * from (select line_key, page, place, mandatory, exact, priority, 2 as step, row_number() over (order by priority desc, place, line_key) as q from rw where not mandatory and not exact and line_key not in (select line_key from f1)), (select n - (select count(*) from f1) as n from need) where q <= n),
ch as (select line_key, page, place, mandatory, exact, priority, step from md union all select line_key, page, place, mandatory, exact, priority, step from f1 union all select line_key, page, place, mandatory, exact, priority, step from f2),
ag as (select * from rw where exact and not mandatory), fr as (select * from (select *, row_number() over (partition by page order by place, line_key) as r from ag) where r = 1 and page not in (select page from ch)),
c1 as (select line_key, page, place, mandatory, exact, priority, 3 as step from fr order by place, line_key limit 10),
c2 as (select * from (select line_key, page, place, mandatory, exact, priority, 4 as step, row_number() over (order by place, line_key) as q from ag where line_key not in (select line_key from c1)) where q <= 10 - (select count(*) from c1)),
al as (select * from ch union all select * from c1 union all select line_key, page, place, mandatory, exact, priority, step from c2)"""


@query(_CLASSED + _REVIEW + " select line_key, page, case when step = 0 then 'mandatory' when step < 3 then 'disagreement' else 'control' end as role, row_number() over (order by step, case when step < 3 then -priority else 0 end, place, line_key) as review_rank from al")
def recommended_review(spark, sf):
    """Lines to look at: what must be, disagreements up to forty with two of a page first, and ten controls."""
    rows = _classified(spark, sf).select("line_key", "mandatory", "priority", F.col("class").startswith("exact").alias("exact"))
    rows = rows.withColumn("page", F.regexp_extract("line_key", "^([^.]*)", 1)).withColumn("place", F.expr("row_number() over (order by line_key)"))
    return V.recommended(rows, 40, 10, 2).select("line_key", "page", "role", F.col("review_rank").cast("long").alias("review_rank"))


_RECORDS = _REC + ", rc as (select *, regexp_replace(lower(regexp_replace(folio, '\\s+', '', 'g')), '^f0+([0-9])', 'f\\1') as page from rec)"
_SCORE = "(length({t}) - length(replace({t}, ',', '')) + 2 * len(regexp_extract_all({t}, '\\[[^:\\[\\]]*:[^\\[\\]]*\\]')) + 2 * (length({t}) - length(replace({t}, '?', ''))) + len(regexp_extract_all({t}, '<[-~]>')))".format(t="text_normalized")


@query(_RECORDS + f", s as (select page, {_SCORE} as score from rc where page is not null) select page, count(*) as lines, sum(score)::bigint as richness from s group by page")
def page_richness(spark, sf):
    c = V.page_candidates(M.records(table(spark, sf, "loci")))
    return c.select("page", "lines", F.col("richness").cast("long").alias("richness"))


@query(_RECORDS + """, f as (select page, 'currier:' || coalesce(currier, 'UNSET') as feature from rc union select page, 'scribe:' || coalesce(scribe, 'UNSET') from rc union select page, 'section:' || coalesce(section, 'UNSET') from rc union select page, 'type:' || coalesce(locus_type, 'UNSET') from rc)
select feature, count(*) as pages, round(case when feature like 'currier:%' then 2.5 when feature like 'type:%' then 1.0 else 3.0 end / sqrt(count(*)), 9) as weight from f where page is not null group by feature""")
def page_feature_weights(spark, sf):
    w = V.feature_weights(V.page_candidates(M.records(table(spark, sf, "loci"))))
    return w.where(~F.col("feature").rlike("^(markup|side|profile):"))


@query(_RECORDS + f""", s as (select *, {_SCORE} as score, row_number() over (partition by page order by line, source_line_number, locus, record_id) - 1 as place, count(*) over (partition by page) as n from rc where page is not null and line is not null),
g as (select page, any_value(n) as n, arg_max(place, (score, -place)) as richest from s group by page),
b as (select page, n, list_distinct([0, n // 2, n - 1, richest]) as base, list_transform(range(5), lambda i: cast(round_even(i * (n - 1) / 4, 0) as bigint)) as spread from g),
x as (select page, n, base, list_filter(spread, lambda v: not list_contains(base, v)) as ex0 from b),
y as (select page, base, list_filter(ex0, lambda v, i: list_position(ex0, v) = i) as ex, least(5, n) as want from x),
z as (select page, unnest(list_sort(list_concat(base, ex[1:greatest(want - len(base), 0)]))[1:5]) as place from y)
select page, place, record_id from s join z using (page, place)""")
def representative_lines(spark, sf):
    """Of each page the first, middle, last and richest line, and evenly spaced ones up to five."""
    return V.representative_lines(M.records(table(spark, sf, "loci")), 5).select("page", "place", "record_id")


@query("select unnest(['pages', 'lines']) as sample, unnest([12, 15])::bigint as chosen, 0::bigint as twice, 0::bigint as over_the_bound")
def sample_checks(spark, sf):
    """Samples of pages and lines: as many as asked for, none twice, at most two pages of a leaf."""
    records = M.records(table(spark, sf, "loci"))
    c = V.page_candidates(records)
    pages = V.representative_pages(c, 12, 2)
    groups = {r["page"]: r["leaf_group"] for r in c.where(F.col("page").isin(*pages)).collect()}
    over = sum(1 for g in set(groups.values()) if sum(x == g for x in groups.values()) > 2)
    lines = V.diverse_lines(records.select(F.col("locus").alias("line_key"), *V.FIELD_WORTH), 15)
    rows = [("pages", len(pages), len(pages) - len(set(pages)), over), ("lines", len(lines), len(lines) - len(set(lines)), 0)]
    return spark.createDataFrame(rows, "sample string, chosen long, twice long, over_the_bound long")


@query(_TOP + " select locus as line_key from readings join top using (transcription_id) where locus is not null group by locus having count(distinct transcription_id) = 3")
def shared_lines(spark, sf):
    r = table(spark, sf, "readings").where("locus is not null")
    return V.shared_lines(r.select(F.col("locus").alias("line_key"), F.col("transcription_id").alias("corpus")), _lines(spark, sf)[1])
