"""Queries of splits, cuts, profiles and recurrence, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import corpus as C
from foliant.operators import leaf_split as X
from foliant.operators import recurrence as Q
from foliant.operators import selection as A
from foliant.operators import splits as S
from foliant.plans.corpus_queries import BASE, lines
from foliant.session import table, written

QUERIES, ORACLE = {}, {}
SHARES = {"train": 0.7, "validation": 0.15, "test": 0.15}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_SPLIT = BASE + """, u as (select distinct physical_leaf from line where physical_leaf is not null), r as (select physical_leaf, row_number() over (order by sha256('0|' || physical_leaf), physical_leaf) - 1 as pos, count(*) over () as n from u),
f as (select any_value(n) as n, [{'f': floor(any_value(n) * 0.7) - any_value(n) * 0.7, 'i': 0}, {'f': floor(any_value(n) * 0.15) - any_value(n) * 0.15, 'i': 1}, {'f': floor(any_value(n) * 0.15) - any_value(n) * 0.15, 'i': 2}] as fr from r),
x as (select n, list_transform(list_sort(fr), lambda e: e.i)[:cast(n - floor(n * 0.7) - 2 * floor(n * 0.15) as integer)] as extra from f),
c as (select floor(n * 0.7) + list_contains(extra, 0)::int as a, floor(n * 0.15) + list_contains(extra, 1)::int as b from x),
sp as (select physical_leaf, case when pos < a then 'train' when pos < a + b then 'validation' else 'test' end as split from r, c)"""


@query(_SPLIT + " select * from sp")
def hash_ranked_split(spark, sf):
    return S.hash_ranked_split(lines(spark, sf).where("physical_leaf is not null"), "physical_leaf", SHARES)


@query(_SPLIT + """, k as (select section, physical_leaf, split from line join sp using (physical_leaf)), ok as (select section from k group by section having count(distinct physical_leaf) >= 3)
select section, split, coalesce(units, 0) as units from (select section, split from ok, (select distinct split from k)) left join (select section, split, count(distinct physical_leaf) as units from k group by all) using (section, split)""")
def split_coverage(spark, sf):
    own = lines(spark, sf).where("physical_leaf is not null")
    return S.coverage_gaps(own.join(S.hash_ranked_split(own, "physical_leaf", SHARES), "physical_leaf"), "physical_leaf", "section", "split")


@query(_SPLIT + """, seen as (select distinct tok from tok join sp using (physical_leaf) where split = 'train')
select count(*) as tokens, count_if(tok in (select tok from seen)) as seen, round(count_if(tok in (select tok from seen)) / count(*), 6) as share from tok join sp using (physical_leaf) where split = 'validation'""")
def exact_seen_share(spark, sf):
    own = lines(spark, sf).where("physical_leaf is not null")
    t = C.tokens(own, "physical_leaf").join(S.hash_ranked_split(own, "physical_leaf", SHARES), "physical_leaf")
    seen = t.where("split = 'train'").select("tok").distinct().withColumn("seen", F.lit(1))
    v = t.where("split = 'validation'").join(seen, "tok", "left")
    return v.agg(F.count("*").alias("tokens"), F.count("seen").alias("seen"), F.round(F.count("seen") / F.count("*"), 6).alias("share"))


_W = BASE + ", w as (select *, len(tokens) as n from line where physical_leaf is not null), v as (select *, sum(n) over (partition by physical_leaf order by record_id) - n as before, sum(n) over (partition by physical_leaf) as total from w)"


def _weighted(spark, sf):
    return lines(spark, sf).where("physical_leaf is not null").withColumn("n", F.size("tokens"))


@query(_W + " select physical_leaf, record_id, n from v where before < 40")
def prefix_of_tokens(spark, sf):
    return S.prefix(_weighted(spark, sf), "record_id", "n", 40, "physical_leaf").select("physical_leaf", "record_id", "n")


@query(_W + " select physical_leaf, record_id, tokens[:cast(least(n, 40 - before) as integer)] as tokens from v where before < 40")
def crop_of_tokens(spark, sf):
    return S.cropped(_weighted(spark, sf), "record_id", "tokens", 40, "physical_leaf").select("physical_leaf", "record_id", "tokens")


@query(_W + " select physical_leaf, arg_min(record_id, abs(before + n - 0.7 * total) * 1e9 + record_id) as cut, arg_min(before + n, abs(before + n - 0.7 * total) * 1e9 + record_id)::bigint as reached from v group by physical_leaf")
def closest_cut(spark, sf):
    return S.closest_cut(_weighted(spark, sf), "record_id", "n", 0.7, "physical_leaf")


@query(_W + " select physical_leaf, record_id, cast(least(floor((before + n / 2) / total * 5), 4) as integer) as unit from v where total > 0")
def balanced_units(spark, sf):
    own = _weighted(spark, sf)
    some = own.groupBy("physical_leaf").agg(F.sum("n").alias("t")).where("t > 0").select("physical_leaf")
    return S.balanced_units(own.join(some, "physical_leaf", "left_semi"), "record_id", "n", 5, "physical_leaf").select("physical_leaf", "record_id", "unit")


@query("""with r as (select record_id, any_value(physical_leaf) as leaf, any_value(folio) as folio, any_value(section) as section, any_value(locus_type) as locus_type from loci where physical_leaf is not null group by record_id),
t as (select leaf, locus_type, count(*) as n from r group by all)
select leaf, any_value(locus_count) as locus_count, any_value(folios) as folios, any_value(sections) as sections, map_from_entries(list({'k': locus_type, 'v': n} order by locus_type)) as locus_type_counts
from t join (select leaf, count(*) as locus_count, list_sort(list(distinct regexp_replace(lower(regexp_replace(folio, '\\s+', '', 'g')), '^f0+([0-9])', 'f\\1'))) as folios, list_sort(list(distinct coalesce(section, 'UNSET'))) as sections from r group by leaf) using (leaf) group by leaf""")
def leaf_profiles(spark, sf):
    return S.leaf_profiles(table(spark, sf, "loci"))


@query(BASE + """, m as (select physical_leaf, list_sort(list(distinct scribe) filter (scribe <> 'UNSET')) as v from line where physical_leaf is not null group by physical_leaf)
select physical_leaf, case when v is null or len(v) = 0 then 'UNKNOWN' when len(v) = 1 then v[1] else 'MIXED[' || array_to_string(v, '|') || ']' end as label from m""")
def leaf_metadata(spark, sf):
    own = lines(spark, sf).where("physical_leaf is not null")
    return own.groupBy("physical_leaf").agg(S.mixed_label(F.collect_set(F.when(F.col("scribe") != C.UNSET, F.col("scribe")))).alias("label"))


_OCC = BASE + """, o as (select array_to_string(glyphs[:-2], chr(31)) as base, glyphs[-1] as suffix, row_number() over (partition by array_to_string(glyphs[:-2], chr(31)) order by record_id, token_index) - 1 as occurrence from tok where not list_contains(glyphs, 'Z1') and len(glyphs) > 1)"""
_RATES = _OCC + """, k as (select base from o group by base having count(*) >= 17), rates as (select lag, count(*) as pairs, count_if(x.suffix = y.suffix) as matches, round(count_if(x.suffix = y.suffix) / count(*), 6) as rate
from (select * from o where base in (select base from k)) x, unnest(range(1, 17)) as l(lag) join o y on x.base = y.base and y.occurrence = x.occurrence + lag group by lag)"""


@query(_OCC + " select * from o")
def family_occurrences(spark, sf):
    return Q.family_occurrences(lines(spark, sf))


@query(_RATES + " select * from rates")
def lag_profile(spark, sf):
    return Q.lag_rates(Q.family_occurrences(lines(spark, sf)), 16, 17)


@query(_RATES + " select round(max(rate) filter (lag = 16) - avg(rate) filter (lag < 16), 6) as contrast from rates")
def cycle_contrast(spark, sf):
    return Q.cycle_contrast(Q.lag_rates(Q.family_occurrences(lines(spark, sf)), 16, 17), 16)


@query(_OCC + ", n as (select base, suffix, count(*) as n from o group by all) select base, sum(n)::bigint as occurrences, count(*) as suffixes, round(sum(n * (n - 1)) / nullif(sum(n) * (sum(n) - 1), 0), 6) as same_surface from n group by base")
def family_inventory(spark, sf):
    return Q.family_inventory(Q.family_occurrences(lines(spark, sf)))


@query()
def permutation_test(spark, sf):
    return Q.permutation_test(Q.family_occurrences(lines(spark, sf)), 16, 10_000)


@query(_W + """, c as (select *, row_number() over (partition by physical_leaf order by record_id) as k, count(*) over (partition by physical_leaf) as cnt, least(floor((before + n) * 5 / total), 4) as t from v),
d as (select *, least(greatest(least(k, k + min(t - k) over (partition by physical_leaf order by k)), 5 - (cnt - k)), 4) as cl from c where cnt >= 5) select physical_leaf, record_id, coalesce(lag(cl) over (partition by physical_leaf order by k), 0)::integer as unit from d""")
def closing_units(spark, sf):
    """Five units of each leaf, closed row by row."""
    own = _weighted(spark, sf)
    some = own.groupBy("physical_leaf").count().where("count >= 5").select("physical_leaf")
    return S.closing_units(own.join(some, "physical_leaf", "left_semi"), "record_id", "n", 5, "physical_leaf").select("physical_leaf", "record_id", "unit")


@query(_W + """, c as (select *, row_number() over (partition by physical_leaf order by record_id) as k, count(*) over (partition by physical_leaf) as cnt from v)
select physical_leaf, arg_min(record_id, (abs(before + n - 0.7::double * total), record_id)) as cut, arg_min(before + n, (abs(before + n - 0.7::double * total), record_id))::bigint as reached from c where k >= 4 and cnt - k >= 4 group by physical_leaf""")
def floored_cut(spark, sf):
    """The cut closest to 70 percent with four lines or more on either side."""
    return S.closest_cut(_weighted(spark, sf), "record_id", "n", 0.7, "physical_leaf", least=4)


_PROFILES = _SPLIT + """, pr as (select physical_leaf as leaf, 'currier' as family, currier as category, 1::bigint as n from line where physical_leaf is not null group by all union all select physical_leaf, 'scribe', scribe, 1 from line where physical_leaf is not null group by all
  union all select physical_leaf, 'section', section, 1 from line where physical_leaf is not null group by all union all select physical_leaf, 'locus_type', coalesce(locus_type, 'UNSET'), count(*) from line where physical_leaf is not null group by all
  union all select physical_leaf, 'loci', 'all', count(*) from line where physical_leaf is not null group by all)"""
_STATS = _PROFILES + """, nn as (select split, family, category, sum(n) as n from pr join sp on pr.leaf = sp.physical_leaf group by all),
st as (select g.split, g.family, g.category, coalesce(n, 0)::bigint as n from (select * from (select distinct family, category from nn), (select distinct split from nn)) g left join nn using (split, family, category))"""


def _profiles(spark, sf):
    return X.profiles(lines(spark, sf))


def _hashed(spark, sf):
    return S.hash_ranked_split(lines(spark, sf).where("physical_leaf is not null"), "physical_leaf", SHARES).withColumnRenamed("physical_leaf", "leaf")


@query(_PROFILES + " select * from pr")
def leaf_category_profiles(spark, sf):
    return _profiles(spark, sf)


@query(_STATS + " select * from st")
def split_statistics(spark, sf):
    return X.split_statistics(_profiles(spark, sf).join(_hashed(spark, sf), "leaf"))


@query(_STATS + """, gl as (select family, category, sum(n) as g from st group by all), gt as (select family, sum(g) as gt, count(*) as categories from gl group by family), lt as (select split, family, sum(n) as lt from st group by all),
e as (select st.*, g / gt as share, coalesce(n / nullif(lt, 0), 0) as mine, categories, gt from st join gl using (family, category) join gt using (family) join lt using (split, family)),
tg as (select split, count(*) / sum(count(*)) over () as want from sp group by split),
k as (select sum(sqrt(share) * pow(mine - share, 2) / categories) as kinds from e where family <> 'loci'), l as (select sum(0.75 * pow(n / gt - want, 2)) as loci from e join tg using (split) where family = 'loci'),
m as (select count(*) as gaps from st join (select family, category from pr where family in ('currier', 'scribe', 'section') group by all having count(distinct leaf) >= 3) using (family, category) where n = 0)
select round(kinds + loci + 100 * gaps, 9) as objective, round(kinds, 9) as kinds, round(loci, 9) as loci, gaps from k, l, m""")
def split_objective(spark, sf):
    """How far the split by hash is from the whole."""
    of = _hashed(spark, sf)
    targets = {r["split"]: r["n"] for r in of.groupBy("split").agg(F.count("*").alias("n")).collect()}
    return X.objective(_profiles(spark, sf), of, targets)


@query("select unnest(['split_size', 'out_of_range', 'overlap', 'not_covered', 'tied_leaves_apart', 'further_than_a_split_by_hash', 'not_its_distance']) as \"check\", 0::bigint as violations")
def optimised_split_checks(spark, sf):
    """A split found by search keeps sizes, covers each leaf once, keeps linked leaves together, and is closer to the whole
    than a split by hash."""
    own, special = written(_profiles(spark, sf), "profiles"), table(spark, sf, "special_pages")
    of, distance = X.optimised(own, special, SHARES)
    leaves = own.select("leaf").distinct()
    targets = S.largest_remainder(leaves.count(), SHARES)
    links = special.select(F.array_min("linked_leaves").alias("u"), F.explode("linked_leaves").alias("v")).where("u < v")
    found = X.objective(own, of, targets)
    other = X.objective(own, _hashed(spark, sf), targets).select(F.col("objective").alias("hashed"))
    worse = found.join(other).where("objective > hashed")
    return A.checks(A.assignment_checks(of, leaves, targets, links), A.violations("further_than_a_split_by_hash", worse), A.violations("not_its_distance", found.where(F.abs(F.col("objective") - F.lit(distance)) > 1e-6)))
