"""Queries of parsing, conversion and comparison of transcriptions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import compare as M
from foliant.operators import corpus as C
from foliant.sources import rules as U
from foliant.sources import transcription as T
from foliant.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_REC = "with rec as (select * from loci qualify row_number() over (partition by record_id order by ingested_at desc) = 1)"
_P = _REC + ", p as (select *, {} as text from rec)"
_PARSED = ("locus", "line", "locus_type", "locus_subtype", "locator", "transcriber", "text_raw", "text_normalized", "original", "locus_raw", "quire_code", "section_code", "paragraph_start", "paragraph_end", "ivtff_alphabet", "ivtff_version", "ivtff_options",
           "file_header_original", "quire", "currier", "section", "original_lines", "page_header_original", "recto_verso", "foldout_panel")


@query(_REC + f" select transcription_id, regexp_replace(lower(regexp_replace(folio, '\\s+', '', 'g')), '^f0+([0-9])', 'f\\1') as folio, {', '.join(_PARSED)} from rec")
def parsed_transcriptions(spark, sf):
    """The records written out as files and parsed again. Columns that hang on lines which the table lacks (numbers of lines,
    tags and paragraphs begun before) are tested on files instead."""
    return T.parse(T.as_lines(table(spark, sf, "loci"))).select(F.col("file").alias("transcription_id"), F.lower("folio").alias("folio"), *_PARSED)


@query(_REC + """, w as (select contains(text_normalized, '<%>') as s, contains(text_normalized, '<$>') as e, coalesce(sum(contains(text_normalized, '<%>')::int - contains(text_normalized, '<$>')::int) over (partition by transcription_id, page_header_original order by source_line_number, record_id rows between unbounded preceding and 1 preceding), 0) as o
  from rec where locus_type = 'P'), i as (select case when s and o > 0 then 'nested paragraph start' when e and not s and o <= 0 then 'paragraph end without start' end as issue from w) select issue, count(*) as n from i where issue is not null group by issue""")
def parsing_issues(spark, sf):
    return T.issues(T.as_lines(table(spark, sf, "loci"))).groupBy("issue").agg(F.count("*").alias("n"))


@query("""with f as (select distinct regexp_replace(lower(regexp_replace(folio, '\\s+', '', 'g')), '^f0+([0-9])', 'f\\1') as page from loci)
select page, cast(nullif(regexp_extract(page, '^f(\\d+)([rv])(\\d*)$', 1), '') as integer) as leaf, nullif(regexp_extract(page, '^f(\\d+)([rv])(\\d*)$', 2), '') as side, cast(nullif(regexp_extract(page, '^f(\\d+)([rv])(\\d*)$', 3), '') as integer) as panel from f""")
def page_names(spark, sf):
    page = page_name(F.col("folio")).alias("page")
    part = lambda i: F.nullif(F.regexp_extract("page", r"^f(\d+)([rv])(\d*)$", i), F.lit(""))
    return table(spark, sf, "loci").select(page).distinct().select("page", part(1).cast("int").alias("leaf"), part(2).alias("side"), part(3).cast("int").alias("panel"))


def _count(p: str) -> str:
    return f"sum(len(regexp_extract_all(coalesce(text_normalized, ''), '{p}')))::bigint"


@query(_REC + " select section, " + ", ".join(f"{_count(p)} as {k}" for k, p in M._PATTERNS.items()) + " from rec group by section")
def markup_counts(spark, sf):
    return M.markup_counts(table(spark, sf, "loci"), "section")


from foliant.functions.text import page_name, plain_text  # noqa: E402

_PLAIN = "text_normalized"
for _a, _b in ((r"<[-~]>", "."), (r"<[^>]*>", ""), (r"\[([^:\[\]]*):[^\[\]]*\]", r"\1"), (r"[{}]", ""), (r"[.,\s]+", " ")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_a}', '{_b}', 'g')"
_PLAIN = f"trim({_PLAIN}, ' ')"


@query(_P.format(_PLAIN) + """ select transcription_id, count(*) as records, count(distinct regexp_replace(lower(regexp_replace(folio, '\\s+', '', 'g')), '^f0+([0-9])', 'f\\1')) as pages, count(distinct physical_leaf) as leaves, count_if(paragraph_start) as paragraphs,
sum(len(list_filter(string_split(regexp_replace(regexp_replace(text_normalized, '<[-~]>', '.', 'g'), '<%>|<\\$>|<@[A-Z]=[^>]>|<![^>]*>', '', 'g'), '.'), lambda w: trim(w) <> '')))::bigint as long_words, count_if(text = '') as blank_records from p group by transcription_id""")
def corpus_report(spark, sf):
    return M.corpus_report(table(spark, sf, "loci"))


_PAIR = _P.format(_PLAIN) + """, k as (select regexp_replace(locus, ';.$', '') as line_key, * from p), c as (
select x.line_key, x.transcription_id as a, y.transcription_id as b, x.text as ta, y.text as tb, levenshtein(replace(x.text, ' ', ''), replace(y.text, ' ', '')) as edits, greatest(length(replace(x.text, ' ', '')), length(replace(y.text, ' ', ''))) as n
from k x join k y on x.line_key = y.line_key and x.transcription_id < y.transcription_id),
s as (select *, case when n = 0 then 1.0::double else round(1 - edits / n, 6) end as similarity from c),
z as (select line_key, a, b, edits::integer as edits, similarity, case when ta = tb and (contains(ta, '?') or contains(tb, '?')) then 'exact_with_uncertainty' when ta = tb then 'exact' when edits = 0 then 'boundary_only' when similarity < 0.8 then 'low' when similarity < 0.95 then 'moderate' else 'high' end as class from s)"""


@query(_PAIR + " select * from z")
def transcription_comparison(spark, sf):
    return M.comparisons(table(spark, sf, "loci"))


@query(_PAIR + """, r as (select *, regexp_extract(line_key, '^(f(?:\\d+[rv]\\d*|Ros))\\.', 1) as page from z where class not like 'exact%')
select line_key, a, b, page, similarity from (select *, row_number() over (partition by page order by similarity, line_key, a, b) as place from r) where place <= 2 order by similarity, line_key, a, b limit 100""")
def review_sample(spark, sf):
    return M.review_sample(M.comparisons(table(spark, sf, "loci")))


@query(_REC + """, n as (select regexp_replace(locus, ';.$', '') as line_key, count(distinct currier) as currier, count(distinct scribe) as scribe, count(distinct section) as section, count(distinct quire) as quire from rec group by 1)
select unnest(['currier', 'scribe', 'section', 'quire']) as field, unnest([count_if(currier > 1), count_if(scribe > 1), count_if(section > 1), count_if(quire > 1)]) as conflicts from n""")
def metadata_conflicts(spark, sf):
    return M.metadata_conflicts(table(spark, sf, "loci"))


_CONVERT = _P.format(_PLAIN) + """, r as (select list(source || chr(31) || chr(cast(57344 + i as integer)) order by i) as fwd, list(chr(cast(57344 + i as integer)) || chr(31) || target order by i) as bwd
  from (select *, row_number() over (order by length(source) desc, ord) - 1 as i from sta_rules)),
w as (select record_id, i as token_index, t as native from (select record_id, unnest(w) as t, generate_subscripts(w, 1) as i from (select record_id, list_filter(string_split(text, ' '), lambda x: x <> '') as w from p))),
f as (select record_id, token_index, native, list_reduce(list_prepend(native, fwd), lambda acc, x: replace(acc, split_part(x, chr(31), 1), split_part(x, chr(31), 2))) as c, bwd from w, r)
select record_id, token_index, native, case when not regexp_matches(c, '[^\\x{E000}-\\x{F8FF}.,\\[\\]: \\t\\r\\n]') then list_reduce(list_prepend(c, bwd), lambda acc, x: replace(acc, split_part(x, chr(31), 1), split_part(x, chr(31), 2))) end as codes from f"""


@query(_CONVERT)
def glyph_codes(spark, sf):
    """Every word of the plain texts as glyph codes."""
    rules = U.ordered(table(spark, sf, "sta_rules"))
    own = M.records(table(spark, sf, "loci"))
    words = F.filter(F.split(plain_text(F.col("text_normalized")), " "), lambda w: w != "")
    each = own.select("record_id", F.posexplode(words).alias("i", "native"))
    return each.select("record_id", (F.col("i") + 1).alias("token_index"), "native", U.converted(F.col("native"), rules).alias("codes"))


_FIRST = "regexp_replace(regexp_replace(regexp_replace({}, '\\[([^:\\[\\]]*):[^\\[\\]]*\\]', '\\1', 'g'), '\\[([^:\\[\\]]*):[^\\[\\]]*\\]', '\\1', 'g'), '\\[([^:\\[\\]]*):[^\\[\\]]*\\]', '\\1', 'g')"
_BARE = "regexp_replace({}, '[{{}}]', '', 'g')"
#: A native text (column x) as codes, null where it stays unconverted; fwd and bwd are the rules.
_FORWARD = "list_reduce(list_prepend(regexp_replace({x}, '<[^>]*>', chr(63743), 'g'), fwd), lambda acc, x: replace(acc, split_part(x, chr(31), 1), split_part(x, chr(31), 2)))"
_BACK = "case when not regexp_matches({f}, '[^\\x{{E000}}-\\x{{F8FF}}.,\\[\\]: \\t\\r\\n]') then replace(list_reduce(list_prepend({f}, bwd), lambda acc, x: replace(acc, split_part(x, chr(31), 1), split_part(x, chr(31), 2))), chr(63743), '') end"
_COUNTS = _REC + f""", r as (select list(source || chr(31) || chr(cast(57344 + i as integer)) order by i) as fwd, list(chr(cast(57344 + i as integer)) || chr(31) || target order by i) as bwd
  from (select *, row_number() over (order by length(source) desc, ord) - 1 as i from sta_rules)),
t as (select transcription_id, {_BARE.format(_FIRST.format('text_normalized'))} as a, {_FIRST.format(_BARE.format('text_normalized'))} as b from rec),
u as (select *, list_max(list_transform(regexp_extract_all(b, '\\?+'), lambda x: length(x))) as longest, len(regexp_extract_all(b, '\\?\\?\\?')) as threes from t),
f as (select transcription_id, longest, threes, {_FORWARD.format(x='a')} as fa, {_FORWARD.format(x="replace(b, '???', '<>')")} as fb, bwd from u, r),
c as (select transcription_id, longest, threes, {_BACK.format(f='fa')} as ca, {_BACK.format(f='fb')} as cb from f),
n as (select transcription_id, len(regexp_extract_all(ca, '[A-Z][1-9a-z]')) as plain, len(regexp_extract_all(regexp_replace(ca, '(?:Z1)+', 'Z1', 'g'), '[A-Z][1-9a-z]')) as collapsed, case when coalesce(longest, 0) <= 3 then len(regexp_extract_all(cb, '[A-Z][1-9a-z]')) + threes end as semantic from c)"""


@query(_COUNTS + " select transcription_id, sum(plain)::bigint as glyphs, sum(collapsed)::bigint as collapsed, case when bool_and(semantic is not null) then sum(semantic)::bigint end as semantic, count_if(semantic is null) as without from n group by transcription_id")
def glyph_counts(spark, sf):
    """Per transcription: glyphs under three conventions; the semantic count is null where a line has none."""
    rules = U.ordered(table(spark, sf, "sta_rules"))
    own = M.records(table(spark, sf, "loci")).select("transcription_id", "text_normalized")
    codes = U.converted(F.regexp_replace(U.first_alternatives(F.col("text_normalized")), r"[{}]", ""), rules)
    rows = own.select("transcription_id", U.glyph_count(codes).alias("plain"), U.glyph_count(codes, True).alias("collapsed"), U.semantic_count(F.regexp_replace("text_normalized", r"[{}]", ""), rules).alias("semantic"))
    return rows.groupBy("transcription_id").agg(F.sum("plain").alias("glyphs"), F.sum("collapsed").alias("collapsed"), F.when(F.bool_and(F.col("semantic").isNotNull()), F.sum("semantic")).alias("semantic"), F.count_if(F.col("semantic").isNull()).alias("without"))


_CODED = f"select record_id, token_index, coalesce(regexp_extract_all(codes, '[A-Z][1-9a-z]'), ['Z1']) as g from ({_CONVERT})"


@query(f"with cd as ({_CODED}) select record_id, list(g order by token_index) as tokens from cd where len(g) > 0 group by record_id")
def lines_of_records(spark, sf):
    """Records of native text as lines of tokens of glyph codes."""
    own = C.lines_of_records(M.records(table(spark, sf, "loci")), U.ordered(table(spark, sf, "sta_rules")))
    return own.where("size(tokens) > 0").select("record_id", "tokens")
