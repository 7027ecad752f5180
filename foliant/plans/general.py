"""Queries of the general data-processing operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import reconcile, row_check
from foliant.session import table

MIRROR_KEYS = ("transcription_id", "locus")
MIRROR_FIELDS = ("folio", "line", "locus_type", "currier", "scribe", "section", "paragraph", "text_normalized")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return row_check.failures(table(spark, sf, "raw_rows")).select(F.col("id").alias("raw_id"), "reason")


def p3_valid_loci(spark: SparkSession, sf: str) -> DataFrame:
    return row_check.valid_rows(table(spark, sf, "raw_rows"), "loci")


def p3_valid_counts(spark: SparkSession, sf: str) -> DataFrame:
    return row_check.valid_rows(table(spark, sf, "raw_rows"), "counts")


def p3_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Failures by feed and reason."""
    rows = table(spark, sf, "raw_rows")
    bad = row_check.failures(rows).select(F.col("id").alias("raw_id"), "reason")
    return rows.join(bad, "raw_id").groupBy("feed", "reason").agg(F.count("*").alias("n"))


def _mirror(spark: SparkSession, sf: str) -> DataFrame:
    loci, mirror = table(spark, sf, "loci"), table(spark, sf, "loci_mirror")
    return reconcile.differences(loci, mirror, MIRROR_KEYS, MIRROR_FIELDS, "ingested_at", "synced_at", ("loci", "mirror"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mirror(spark, sf).select(*MIRROR_KEYS, "field")


def p4_values(spark: SparkSession, sf: str) -> DataFrame:
    """The differing fields with both sides' values."""
    return _mirror(spark, sf).where("field not like 'missing%'")


QUERIES = {f.__name__: f for f in (p3_found, p3_valid_loci, p3_valid_counts, p3_reasons, p4_found, p4_values)}

_CELLS = """with cut as (
  select raw_id, feed, coalesce(raw_line, '') as line from raw_rows
), parsed as (
  select raw_id, feed,
    regexp_full_match(line, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*', 's') as quoted,
    list_transform(regexp_extract_all(',' || line, ',("(?:[^"]|"")*"|[^",]*)', 1, 's'),
      lambda c: case when c[1] = '"' then replace(c[2:-2], '""', '"') else c end) as c
  from cut
), judged as (
  select *, case
    when not quoted then 'quoting'
    when not coalesce((feed = 'loci' and len(c) = 6) or (feed = 'counts' and len(c) = 10), false) then 'column_count'
    when feed = 'loci' and not (
      regexp_full_match(c[1], '[A-Z][A-Z][0-9][a-z]') and regexp_full_match(c[2], 'fRos|f[0-9]+[rv][0-9]*')
      and regexp_full_match(c[4], '0*[1-9][0-9]*') and starts_with(c[3], c[2] || '.' || c[4] || ',')
      and regexp_full_match(c[3][len(c[2]) + len(c[4]) + 3:], '.[A-Z][a-z0-9]', 's')
      and regexp_matches(c[5], '[^ \\t\\n\\r\\f\\v]') and not contains(c[5], '????')
      and not regexp_matches(regexp_replace(c[5], '<[^<>]*>', '', 'g'), '[<>]')
      and not regexp_matches(regexp_replace(regexp_replace(c[5], '<[^<>]*>', '', 'g'), '\\[[^\\[\\]:]*:[^\\[\\]]*\\]', '', 'g'), '[\\[\\]]')
      and starts_with(c[6], '<' || c[3] || '>')) then 'invalid_value'
    when feed = 'counts' and not (
      regexp_full_match(c[1], '[0-9]+') and regexp_full_match(c[2], '[0-9]*') and c[3] in ('true', 'false')
      and (c[2] <> '') = (c[3] = 'true') and (c[4] <> '') = (c[3] = 'false')
      and regexp_full_match(c[5], '[0-9]+') and regexp_full_match(c[6], '[0-9]+')
      and coalesce(try_cast(c[1] as hugeint) - try_cast(c[5] as hugeint) = try_cast(c[6] as hugeint), false)
      and c[7] <> '' and ends_with(c[8], '.bit') and regexp_full_match(c[9], '[0-9a-f]{64}')
      and regexp_full_match(c[10], '0*[1-9][0-9]*')) then 'invalid_value'
    end as reason from parsed)
"""


def _mirror_sql(select: str) -> str:
    def clean(f: str) -> str:
        return f if f in ("line", "paragraph") else f"nullif(trim({f}, ' '), '')"

    fields = ", ".join(f"{clean(f)} as {f}" for f in MIRROR_FIELDS)
    side = "select coalesce(trim(transcription_id, ' '), '') as transcription_id, coalesce(trim(locus, ' '), '') as locus, {f} from {t} qualify row_number() over (partition by coalesce(trim({t}.transcription_id, ' '), ''), coalesce(trim({t}.locus, ' '), '') order by {v} desc) = 1"
    text = lambda v: f"cast({v} as varchar)"
    parts = [
        "select transcription_id, locus, 'missing_in_mirror' as field, null as left_value, null as right_value from a anti join b using (transcription_id, locus)",
        "select transcription_id, locus, 'missing_in_loci', null, null from b anti join a using (transcription_id, locus)",
    ] + [f"select transcription_id, locus, '{f}', {text('a.' + f)}, {text('b.' + f)} from a join b using (transcription_id, locus) where a.{f} is distinct from b.{f}" for f in MIRROR_FIELDS]
    return f"with a as ({side.format(f=fields, t='loci', v='ingested_at')}), b as ({side.format(f=fields, t='loci_mirror', v='synced_at')}), d as ({' union all '.join(parts)}) {select}"


_EMPTY = "nullif(c[{}], '')"
ORACLE = {
    "p3_found": _CELLS + "select raw_id, reason from judged where reason is not null",
    "p3_reasons": _CELLS + "select feed, reason, count(*) as n from judged where reason is not null group by all",
    "p3_valid_loci": _CELLS
    + "select raw_id, "
    + ", ".join(f"cast({_EMPTY.format(i + 1)} as {'integer' if t == 'int' else 'varchar'}) as {c}" for i, (c, t) in enumerate(row_check.COLUMNS["loci"].items()))
    + " from judged where reason is null and feed = 'loci'",
    "p3_valid_counts": _CELLS
    + "select raw_id, "
    + ", ".join(f"cast({_EMPTY.format(i + 1)} as {'varchar' if t == 'string' else t}) as {c}" for i, (c, t) in enumerate(row_check.COLUMNS["counts"].items()))
    + " from judged where reason is null and feed = 'counts'",
    "p4_found": _mirror_sql("select transcription_id, locus, field from d"),
    "p4_values": _mirror_sql("select * from d where field not like 'missing%'"),
}
