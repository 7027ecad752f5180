"""Queries of the operators for training data, with their SQL where SQL can state the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import consensus, encode, grouped_split, overlap, packing, term_counts, text_quality
from foliant.operators import compare
from foliant.session import table, written


def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.cross_split_overlaps(table(spark, sf, "loci"), table(spark, sf, "leaf_split"), table(spark, sf, "special_pages"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pair = _overlaps(spark, sf)
    return pair.select(F.least("train_record", "eval_record").alias("record_id_a"), F.greatest("train_record", "eval_record").alias("record_id_b"))


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per split and transcription: overlapping records, and pairs."""
    return _overlaps(spark, sf).groupBy("split", "transcription_id").agg(F.count_distinct("eval_record").alias("records"), F.count("*").alias("pairs"))


def p1_containment(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs with their edit distance and the share of the evaluation record's word 5-grams that the training
    record holds."""
    return _overlaps(spark, sf).withColumn("containment", F.round("containment", 6))


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return term_counts.text_terms(table(spark, sf, "loci")).unionByName(term_counts.token_terms(table(spark, sf, "analytical_loci")))


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    records = _terms(spark, sf)
    counts = term_counts.term_counts(records.select("field", "terms"))
    return term_counts.marked(counts, term_counts.totals(records)).select("field", F.get("terms", F.lit(0)).alias("term"), "occurrences", "records", "mark")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).where("mark is not null").select("field", "term", "mark")


def p2_terms(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf)


def p2_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of up to three words with their occurrences and records."""
    counts = term_counts.term_counts(term_counts.text_terms(table(spark, sf, "loci")).select("field", "terms"), 3)
    return counts.select(F.array_join("terms", " ").alias("run"), "occurrences", "records")


def _readings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    labels = consensus.last_labels(table(spark, sf, "readings"), "locus", "transcription_id", "canonical_glyph_text", "read_at", "reading_id")
    return consensus.consensus(labels)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _readings(spark, sf)[0].select(F.col("item").alias("locus"), F.col("label").alias("canonical_glyph_text"))


def p5_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return _readings(spark, sf)[0].withColumnsRenamed({"item": "locus", "label": "canonical_glyph_text"})


def p5_readers(spark: SparkSession, sf: str) -> DataFrame:
    """The loci that get a consensus, with how many read them."""
    return _readings(spark, sf)[0].select(F.col("item").alias("locus"), F.col("readers").cast("long").alias("readers"))


def p5_unanimous(spark: SparkSession, sf: str) -> DataFrame:
    """The consensus where all readers agree, which is what they read."""
    return _readings(spark, sf)[0].where("agreement = 1").select(F.col("item").alias("locus"), F.col("label").alias("canonical_glyph_text"))


def p5_reliability(spark: SparkSession, sf: str) -> DataFrame:
    return _readings(spark, sf)[1].withColumnRenamed("annotator", "transcription_id")


def _ties(spark: SparkSession, sf: str) -> DataFrame:
    return grouped_split.leaf_ties(table(spark, sf, "atomic_units"), table(spark, sf, "leaf_profiles"), table(spark, sf, "special_pages"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    found = grouped_split.components(_ties(spark, sf))
    return found.select(F.col("vertex").cast("int").alias("leaf"), F.col("root").cast("int").alias("group_leaf"))


def p6_split(spark: SparkSession, sf: str) -> DataFrame:
    """The split of every record."""
    return grouped_split.assigned(table(spark, sf, "loci"), _ties(spark, sf), table(spark, sf, "special_pages"))


def _named(name: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.lit(name).alias("check"), F.count("*").alias("violations"))


def p6_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with the split: groups in two splits, records without one, splits off their share by more than a
    hundredth of the records and the largest group; and how many records and groups there are."""
    records = written(p6_split(spark, sf), "split")
    weights = records.groupBy("group").agg(F.count("*").alias("weight"), F.count_distinct("split").alias("splits"))
    whole = weights.agg(F.sum("weight").alias("all"), F.max("weight").alias("most"))
    shares = spark.createDataFrame(list(grouped_split.SHARES.items()), "split string, share double")
    sizes = shares.join(records.groupBy("split").agg(F.count("*").alias("n")), "split", "left").join(F.broadcast(whole))
    off = sizes.where(F.abs(F.coalesce("n", F.lit(0)) - F.col("share") * F.col("all")) > 0.01 * F.col("all") + F.col("most"))
    missing = compare.records(table(spark, sf, "loci")).join(records, "record_id", "left_anti")
    parts = [_named("groups_in_two_splits", weights.where("splits > 1")), _named("without_a_split", missing), _named("off_share", off), _named("records", records), _named("groups", weights)]
    return reduce(DataFrame.unionByName, parts)


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encoded(table(spark, sf, "documents"))


def p7_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return encode.decoded(encode.encoded(table(spark, sf, "documents")))


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(encode.token_counts(table(spark, sf, "documents"))).withColumnRenamed("item", "doc_id")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers by their unused tokens."""
    used = p8_packed(spark, sf).where("container is not null").groupBy("container").agg(F.sum("size").alias("tokens"))
    return used.groupBy((packing.CAPACITY - F.col("tokens")).alias("unused")).agg(F.count("*").alias("containers"))


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with the packing: containers over capacity, documents whose pieces don't add up, pieces cut though
    the document would fit, containers beyond the least possible number; and the documents packed."""
    tokens = written(encode.token_counts(table(spark, sf, "documents")), "tokens")
    pieces = written(packing.packed(tokens).withColumnRenamed("item", "doc_id"), "packed")
    fill = pieces.where("container is not null").groupBy("container").agg(F.sum("size").alias("size"))
    own = pieces.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("pieces"))
    both = tokens.join(own, "doc_id", "full_outer")
    least = tokens.agg(F.ceil(F.sum("tokens") / packing.CAPACITY).alias("least"))
    spare = fill.agg(F.count("*").alias("used")).join(least).select(F.lit("spare_containers").alias("check"), F.greatest(F.col("used") - F.col("least"), F.lit(0)).alias("violations"))
    parts = [
        _named("over_capacity", fill.where(F.col("size") > packing.CAPACITY)), _named("tokens_lost", both.where("not size <=> tokens")), _named("cut_though_it_fits", own.where((F.col("pieces") > 1) & (F.col("size") <= packing.CAPACITY))),
        spare, _named("documents", own),
    ]
    return reduce(DataFrame.unionByName, parts)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    # kinds don't depend on the common words, so these aren't counted here
    return text_quality.statistics(table(spark, sf, "documents"), []).where("kind <> 'prose'").select("doc_id", "kind")


def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return text_quality.statistics(table(spark, sf, "documents"))


def p9_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Words and non-blank lines of every text."""
    return text_quality.statistics(table(spark, sf, "documents"), []).select("doc_id", "words", "lines", F.round("mean_word_length", 6).alias("mean_word_length"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_report, p1_containment, p2_found, p2_terms, p2_runs, p5_found, p5_agreement, p5_readers, p5_unanimous, p5_reliability, p6_found, p6_split, p6_checks,
        p7_ids, p7_decoded, p8_packed, p8_fill, p8_checks, p9_found, p9_statistics, p9_counts,
    )
}


def _plain(column: str) -> str:
    """The plain text of a transcription line."""
    t = column
    for pattern, to in ((r"<[-~]>", "."), (r"<[^>]*>", ""), (r"\[([^:\[\]]*):[^\[\]]*\]", r"\1"), (r"[{}]", ""), (r"[.,\s]+", " ")):
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return f"trim({t}, ' ')"


_LEAF = "try_cast(nullif(regexp_extract(lower(regexp_replace({0}, '\\s+', '', 'g')), '^f(\\d+)[rv]\\d*$', 1), '') as integer)"
_PAGE = "regexp_replace(lower(regexp_replace({0}, '\\s+', '', 'g')), '^f0+([0-9])', 'f\\1')"

_PAIRS = f"""with sides as (
  select distinct l.record_id, l.transcription_id, {_plain('l.text_normalized')} as text, coalesce(p.split, s.split) as split
  from loci l
  left join (select leaf, min(lower(regexp_replace(split, '\\s+', '', 'g'))) as split from leaf_split group by leaf) s on s.leaf = {_LEAF.format('l.folio')}
  left join (
    select {_PAGE.format('folio')} as page, arg_min(lower(regexp_replace(s2.split, '\\s+', '', 'g')), s2.leaf) as split
    from (select folio, unnest(linked_leaves) as leaf from special_pages) x join leaf_split s2 on s2.leaf = x.leaf group by 1
  ) p on p.page = {_PAGE.format('l.folio')}
), pairs as (
  select a.record_id as train_record, b.record_id as eval_record, b.split, b.transcription_id
  from (select * from sides where split = 'train' and length(text) >= 40) a
  join (select * from sides where split in ('validation', 'test') and length(text) >= 40) b
    on abs(length(a.text) - length(b.text)) * 10 <= greatest(length(a.text), length(b.text))
    and levenshtein(a.text, b.text) * 10 <= greatest(length(a.text), length(b.text)))
"""
_WORDS = f"""select record_id, 'text_normalized' as field, unnest(list_filter(string_split(text, ' '), lambda w: w <> '' and not contains(w, '?'))) as term
  from (select record_id, {_plain('any_value(text_normalized)')} as text from loci group by record_id)"""
_TERMS = f"""with terms as (
  {_WORDS}
  union all
  select record_id, 'tokens', t from (
    select record_id, unnest(list_transform(list_filter(tokens, lambda t: t is not null and not coalesce(list_contains(t, 'Z1'), false)), lambda t: array_to_string(list_filter(t, lambda g: g is not null), ''))) as t
    from (select record_id, any_value(tokens) as tokens from analytical_loci group by record_id)) where t <> ''
), totals as (
  select 'text_normalized' as field, count(distinct record_id) as total from loci union all select 'tokens', count(distinct record_id) from analytical_loci
), marked as (
  select field, term, count(*) as occurrences, count(distinct record_id) as records,
    case when count(distinct record_id) < 3 then 'rare' when count(distinct record_id) * 100 > 8 * any_value(total) then 'common' end as mark
  from terms join totals using (field) group by field, term)
"""
_COMPONENTS = f"""with recursive special as (
  select {_PAGE.format('folio')} as page, {_LEAF.format('folio')} as own, linked_leaves from special_pages
), homes as (select page, unnest(linked_leaves) as leaf from special where own is null
), named as (
  select 'unit ' || rn as k, leaf from (select row_number() over () as rn, leaves from atomic_units) u, unnest(u.leaves) as x(leaf)
  union all select 'unit ' || rn, coalesce({_LEAF.format('folio')}, h.leaf)
    from (select rn, unnest(special_pages) as folio from (select row_number() over () as rn, special_pages from atomic_units)) left join homes h on h.page = {_PAGE.format('folio')}
  union all select 'profile ' || leaf, leaf from leaf_profiles
  union all select 'profile ' || p.leaf, coalesce({_LEAF.format('folio')}, h.leaf)
    from (select leaf, unnest(folios) as folio from leaf_profiles) p left join homes h on h.page = {_PAGE.format('folio')}
  union all select 'page ' || page, unnest(linked_leaves) from special
  union all select 'page ' || page, own from special
), stars as (select k, min(leaf) as u from named where leaf is not null group by k
), edges as (
  select distinct u, leaf as v from stars join named using (k) where leaf is not null and leaf <> u
), arcs as (select u, v from edges union select v, u from edges
), reach(leaf, other) as (
  select u, u from arcs union select r.leaf, b.v from reach r join arcs b on b.u = r.other)
"""

_GRAMS = "list_distinct(list_transform(range(1, greatest(len({w}) - least(5, len({w})) + 1, 1) + 1), lambda i: array_to_string({w}[i:i + least(5, len({w})) - 1], ' ')))"
_GROUPS = _COMPONENTS + f""", root as (select leaf, min(other) as root from reach group by leaf),
rec as (select record_id, arg_max(folio, ingested_at) as folio from loci group by record_id),
grp as (select r.record_id, coalesce('leaf ' || coalesce(root, coalesce({_LEAF.format('r.folio')}, l.linked)), 'page ' || {_PAGE.format('r.folio')}, 'none') as g
  from rec r left join (select {_PAGE.format('folio')} as page, list_min(linked_leaves) as linked from special_pages) l on l.page = {_PAGE.format('r.folio')} left join root on root.leaf = coalesce({_LEAF.format('r.folio')}, l.linked))
"""
_LINES = r"""with t as (select doc_id, replace(coalesce(text, ''), chr(65279), '') as t from documents),
x as (select doc_id, list_filter(regexp_split_to_array(t, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda l: not regexp_full_match(l, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*')) as l from t),
w as (select doc_id, len(l) as lines, regexp_extract_all(array_to_string(l, chr(10)), '[\pL\pM]+(?:[''’][\pL\pM]+)*') as w from x)
select doc_id, len(w) as words, lines, round(len(array_to_string(w, '')) / greatest(len(w), 1), 6) as mean_word_length from w"""

_LABELS = """with last as (select locus, transcription_id, arg_max(coalesce(canonical_glyph_text, ''), (read_at, reading_id)) as t from readings where locus is not null and transcription_id is not null group by all),
lb as (select locus, trim(regexp_replace(t, '\\s+', ' ', 'g')) as t from last where trim(regexp_replace(t, '\\s+', ' ', 'g')) <> '')
"""

ORACLE = {
    "p5_readers": _LABELS + "select locus, count(*) as readers from lb group by locus having count(*) >= 3",
    "p5_unanimous": _LABELS + "select locus, any_value(t) as canonical_glyph_text from lb group by locus having count(*) >= 3 and count(distinct t) = 1",
    "p1_containment": _PAIRS.replace("b.split, b.transcription_id", "b.split, b.transcription_id, levenshtein(a.text, b.text) as edits, string_split(a.text, ' ') as wa, string_split(b.text, ' ') as wb")
    + f"select train_record, eval_record, split, transcription_id, edits, round(len(list_intersect({_GRAMS.format(w='wb')}, {_GRAMS.format(w='wa')})) / len({_GRAMS.format(w='wb')}), 6) as containment from pairs",
    "p6_checks": _GROUPS + """select 'groups_in_two_splits' as "check", 0::bigint as violations union all select 'without_a_split', 0 union all select 'off_share', 0 union all select 'records', count(*) from grp union all select 'groups', count(distinct g) from grp""",
    "p8_checks": """select unnest(['over_capacity', 'tokens_lost', 'cut_though_it_fits', 'spare_containers']) as "check", 0::bigint as violations union all select 'documents', count(distinct doc_id) from documents""",
    "p9_counts": _LINES,
    "p1_found": _PAIRS + "select least(train_record, eval_record) as record_id_a, greatest(train_record, eval_record) as record_id_b from pairs",
    "p1_report": _PAIRS + "select split, transcription_id, count(distinct eval_record) as records, count(*) as pairs from pairs group by all",
    "p2_found": _TERMS + "select field, term, mark from marked where mark is not null",
    "p2_terms": _TERMS + "select * from marked",
    "p2_runs": f"""with words as (select record_id, list_filter(string_split(text, ' '), lambda w: w <> '' and not contains(w, '?')) as w
  from (select record_id, {_plain('any_value(text_normalized)')} as text from loci group by record_id)),
runs as (select record_id, array_to_string(w[i:i + n - 1], ' ') as run from words, unnest([1, 2, 3]) as s(n), unnest(range(1, len(w) + 1)) as p(i) where i + n - 1 <= len(w))
select run, count(*) as occurrences, count(distinct record_id) as records from runs group by run""",
    "p6_found": _COMPONENTS + "select leaf, min(other) as group_leaf from reach group by leaf",
    "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
