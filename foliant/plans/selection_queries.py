"""Queries of record selection, text normalisation and checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import normalize as Z
from foliant.operators import compare, selection as S
from foliant.plans.corpus_queries import BASE, lines
from foliant.plans.source_queries import _P, _PLAIN
from foliant.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_NAME = "regexp_replace(lower(regexp_replace({}, '\\s+', '', 'g')), '^f0+([0-9])', 'f\\1')"
_LAST = "select any_value(l.record_id) as record_id, any_value(physical_leaf) as physical_leaf, any_value(folio) as folio from loci l group by l.record_id"
_SPLIT = f"""with leaf as (select leaf, min({_NAME.format('split')}) as split from leaf_split where leaf is not null group by leaf having min({_NAME.format('split')}) = 'validation'),
link as (select distinct {_NAME.format('folio')} as page, unnest(linked_leaves) as leaf from special_pages),
page as (select page, count(*) as linked, count(leaf.leaf) as chosen from link left join leaf using (leaf) where link.leaf is not null group by page),
rec as ({_LAST}),
sel as (select r.* from rec r where physical_leaf in (select leaf from leaf) or (physical_leaf is null and {_NAME.format('r.folio')} in (select page from page where linked = chosen)))"""


def _validation(spark, sf):
    """(records, the leaves of the validation split, special pages)."""
    split = F.lower(F.regexp_replace("split", r"\s+", ""))
    own = table(spark, sf, "leaf_split").where("leaf is not null").groupBy("leaf").agg(F.min(split).alias("split")).where("split = 'validation'").select("leaf")
    return compare.records(table(spark, sf, "loci")), own, table(spark, sf, "special_pages")


@query(_SPLIT + " select record_id, physical_leaf from sel")
def records_of_a_split(spark, sf):
    return S.select_by_leaves(*_validation(spark, sf)).select("record_id", "physical_leaf")


@query(_SPLIT + f""" select 'linked_leaves_apart' as "check", count(*) as violations from page where chosen > 0 and chosen < linked
union all select 'no_rule', count(*) from rec where physical_leaf is null and coalesce({_NAME.format('folio')}, '') not in (select page from page)
union all select 'missing_leaf', count(*) from leaf where leaf not in (select physical_leaf from sel where physical_leaf is not null)
union all select 'leaked_leaf', count(*) from sel where physical_leaf is not null and physical_leaf not in (select leaf from leaf)""")
def split_selection_checks(spark, sf):
    return S.selection_checks(*_validation(spark, sf))


@query("""with p as (select leaf as item, lower(regexp_replace(split, '\\s+', '', 'g')) as part from leaf_split), d as (select distinct part, item from p), w as (select distinct leaf as item from leaf_profiles)
select 'out_of_range' as "check", count(*) as violations from (select distinct item from d where item not in (select item from w))
union all select 'overlap', count(*) from (select item from d group by item having count(*) > 1) union all select 'not_covered', count(*) from w where item not in (select item from d)""")
def split_cover_checks(spark, sf):
    parts = table(spark, sf, "leaf_split").select(F.lower(F.regexp_replace("split", r"\s+", "")).alias("part"), F.col("leaf").alias("item"))
    return S.cover_checks(parts, table(spark, sf, "leaf_profiles").select(F.col("leaf").alias("item")))


@query("""with x as (select 'f' || leaf as v from leaf_split union all select ' F' || leaf from leaf_split where leaf % 7 = 0), t as (select trim(v) as v from x),
g as (select case when regexp_full_match(v, 'f\\d+') then cast(substr(v, 2) as integer) end as leaf, count(*) as n from t group by 1)
select leaf, case when leaf is null then 'invalid' when n > 1 then 'duplicate' end as problem, n from g""")
def leaf_list_problems(spark, sf):
    """A list of leaves with repeats and with lines that are none."""
    leaf = F.col("leaf").cast("string")
    rows = table(spark, sf, "leaf_split").select(F.explode(F.array(F.concat(F.lit("f"), leaf), F.when(F.col("leaf") % 7 == 0, F.concat(F.lit(" F"), leaf)))).alias("value"))
    return S.leaf_lines(rows.where("value is not null"))


@query(_P.format(_PLAIN) + """, m as (select transcription_id, locus, text_normalized from loci_mirror where locus is not null qualify row_number() over (partition by transcription_id, locus order by synced_at desc, mirror_id desc) = 1),
a as (select transcription_id, count(distinct record_id) as records from loci group by all), b as (select transcription_id, count(*) as records from m group by all),
j as (select coalesce(a.transcription_id, b.transcription_id) as transcription_id, a.records as f, b.records as e from a full join b on a.transcription_id = b.transcription_id)
select transcription_id, 'records' as field, e::double as expected_value, f::double as found_value, f::double - e::double as difference, 5.0::double as tolerance, coalesce(abs(f - e) <= 5, false) as pass from j""")
def transcription_parity(spark, sf):
    """Records of each transcription in loci against the other system's, within five."""
    loci, mirror = table(spark, sf, "loci"), table(spark, sf, "loci_mirror")
    a = loci.groupBy("transcription_id").agg(F.count_distinct("record_id").alias("records"))
    b = mirror.where("locus is not null").select("transcription_id", "locus").distinct().groupBy("transcription_id").agg(F.count("*").alias("records"))
    return S.parity(a, b, ["transcription_id"], {"records": 5.0})


@query("""with r as (select feed, raw_line from raw_rows) select feed, count_if(contains(raw_line, '??') or contains(raw_line, 'Z1')) as rows from r group by feed""")
def forbidden_rows(spark, sf):
    """Rows by feed that hold one of the forbidden parts."""
    rows = table(spark, sf, "raw_rows").select("feed", "raw_line")
    bad = S.forbidden_paths(rows, ["??", "Z1"], "raw_line").groupBy("feed").agg(F.count("*").alias("rows"))
    return rows.select("feed").distinct().join(bad, "feed", "left").select("feed", F.coalesce("rows", F.lit(0)).alias("rows"))


@query("""with d as (select doc_id, lower(nfc_normalize(text)) as t from documents where text is not null and regexp_full_match(text, '[ -~\\n\\r\\t]*')),
w as (select doc_id, unnest(list_filter(regexp_split_to_array(t, '[^a-z]+'), lambda x: x <> '')) as w from d)
select d.doc_id, count(w) as words, count(distinct w) as types from d left join w using (doc_id) group by d.doc_id""")
def ascii_words(spark, sf):
    """Words and types of texts of plain characters, which compatibility forms leave alone."""
    rows = table(spark, sf, "documents").where(F.col("text").rlike(r"^[ -~\n\r\t]*$")).select("doc_id", Z.letters(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("types"))


@query()
def letter_counts(spark, sf):
    """Lines, words, characters and distinct words of every text in compatibility form."""
    rows = table(spark, sf, "documents").select("doc_id", Z.letter_lines(F.col("text")).alias("l"))
    words = F.flatten("l")
    return rows.select(
        "doc_id", F.size("l").alias("lines"), F.size(words).alias("tokens"), F.size(F.array_distinct(words)).alias("unique_tokens"), F.length(F.array_join(words, "")).alias("characters")
    )


@query(BASE + ", d as (select distinct glyphs from tok) select array_to_string(glyphs, ' ') as token, substr(sha256('[' || array_to_string(list_transform(glyphs, lambda g: '\"' || g || '\"'), ',') || ']'), 1, 16) as id from d")
def token_ids(spark, sf):
    from foliant.operators.corpus import tokens

    rows = tokens(lines(spark, sf)).select("glyphs").distinct()
    return rows.select(F.array_join("glyphs", " ").alias("token"), Z.short_id(F.col("glyphs")).alias("id"))


@query("select leaf, ((('0x' || substr(h, 1, 16))::ubigint)::hugeint % 9223372036854775807)::bigint as seed from (select leaf, sha256('7|' || leaf) as h from (select distinct leaf from leaf_split where leaf is not null))")
def leaf_seeds(spark, sf):
    return table(spark, sf, "leaf_split").select("leaf").where("leaf is not null").distinct().select("leaf", Z.stable_seed(F.lit(7), F.col("leaf")).alias("seed"))


@query("""with r as (select locus, list(distinct string_split(trim(regexp_replace(canonical_glyph_text, '\\s+', ' ', 'g')), ' ')) as v from readings where trim(canonical_glyph_text) <> '' group by locus),
k as (select locus, v from r where len(v) > 1 and len(list_distinct(list_transform(v, lambda x: len(x)))) = 1),
p as (select locus, v, unnest(range(1, len(v) + 1)) as i from k), q as (select locus, v[i] as a, v[j] as b from (select *, unnest(range(i + 1, len(v) + 1)) as j from p)),
h as (select locus, len(list_filter(list_zip(a, b), lambda x: x[1] <> x[2])) as d from q) select locus, round(avg(d), 6) as distance from h group by locus""")
def reading_distances(spark, sf):
    """Mean places in which readings of a line of the same length differ."""
    t = F.trim(F.regexp_replace("canonical_glyph_text", r"\s+", " "))
    v = table(spark, sf, "readings").where(t != "").groupBy("locus").agg(F.collect_set(F.split(t, " ")).alias("v"))
    alike = v.where((F.size("v") > 1) & (F.size(F.array_distinct(F.transform("v", F.size))) == 1))
    return alike.select("locus", F.round(Z.pairwise_hamming(F.col("v")), 6).alias("distance"))


@query(f"""with rec as ({_LAST}), sp as (select distinct {_NAME.format('folio')} as page, list_sort(list_distinct(list_filter(linked_leaves, lambda x: x is not null))) as l from special_pages),
g as (select page, l, array_to_string(list_transform(l, lambda x: 'f' || x), '+') as label from sp), lv as (select leaf, min(label) as label from (select unnest(l) as leaf, label from g) group by leaf)
select record_id, coalesce(lv.label, 'f' || physical_leaf, g.label) as leaf_group from rec left join g on g.page = {_NAME.format('rec.folio')} left join lv on lv.leaf = rec.physical_leaf""")
def leaf_groups(spark, sf):
    return S.leaf_groups(compare.records(table(spark, sf, "loci")), table(spark, sf, "special_pages")).select("record_id", "leaf_group")
