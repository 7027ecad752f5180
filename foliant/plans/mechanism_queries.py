"""Queries of control texts with several forms for a word, with their SQL. Lines are train, validation and reserved
in turns of twenty."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import ciphers as K
from foliant.operators import mechanisms as M
from foliant.operators.selection import checks, enforce, violations
from foliant.plans.cipher_queries import _WORDS
from foliant.session import table, written

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def words(spark, sf) -> DataFrame:
    """(line, token, word, split), written once: every text below reads it several times."""
    w = K.plain_words(table(spark, sf, "loci"))
    at = F.col("line") % 20
    return written(w.withColumn("split", F.when(at < 14, "train").when(at < 17, "validation").otherwise("reserved")), "words")


def _list(names) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


def _draw(*parts: str) -> str:
    return "('0x' || substr(sha256(concat_ws('|', " + ", ".join(parts) + ")), 1, 8))::bigint"


_W = _WORDS + """, ws as (select *, case when line % 20 < 14 then 'train' when line % 20 < 17 then 'validation' else 'reserved' end as split from words),
mono as (select x, row_number() over (order by sha256('0|' || x), x) as r from (select distinct unnest(string_split(word, '')) as x from ws where split = 'train')),
ch as (select distinct word from ws where split <> 'reserved'), cc as (select word, unnest(string_split(word, '')) as c, generate_subscripts(string_split(word, ''), 1) as i from ch),
base as (select word, list(coalesce('M' || lpad(cast(r as varchar), 4, '0'), format('U{:08X}', unicode(c))) order by i) as base from cc left join mono on c = x group by word),
op as (select ws.*, base.base from ws join base using (word) where split <> 'reserved')"""
#: Figures of a table e (grp, word, split, cipher, targeted) by grp and split.
_FIGURES = """, n as (select grp, split, word, cipher, count(*) as n, bool_and(targeted) as tg from e group by all),
w as (select grp, split, word, sum(n) as n, count(*) as forms, sum(n * (n - 1)) as same, bool_and(tg) as tg from n group by all),
a as (select grp, split, sum(n)::bigint as tokens, count(*) as word_types, sum(case when tg then n else 0 end)::bigint as targeted, round(avg(case when tg then forms end), 6) as mean_forms, max(case when tg then forms end) as most_forms,
  round(sum(case when tg then same end) / nullif(sum(case when tg then n * (n - 1) end), 0), 6) as same_surface from w group by all),
t as (select grp, split, cipher, sum(n) as n from n group by all), b as (select grp, split, count(*) as cipher_types, round((sum(n) - count(*)) / sum(n), 6) as recurrence from t group by all),
g as (select grp, split, count(distinct x) as glyphs from (select grp, split, unnest(cipher) as x from n) group by all)
select a.*, b.cipher_types, b.recurrence, g.glyphs, a.tokens as restored from a join b using (grp, split) join g using (grp, split)"""


def _figures(rows: DataFrame, label: str, only: str | None = None) -> DataFrame:
    return M.surface_diagnostics(rows, "split", only=only).withColumn("grp", F.lit(label))


@query(_W + ", e as (" + " union all ".join(f"select '{k}' as grp, word, split, list_append(base, {_list(M.suffixes(0, k))}[cast({_draw('0', chr(39) + 'place' + chr(39), 'line', 'token')} % {k} + 1 as integer)]) as cipher, true as targeted from op" for k in (1, 2, 4, 8, 16)) + ")" + _FIGURES)
def suffix_diagnostics(spark, sf):
    """Base forms with one of 1, 2, 4, 8 and 16 suffixes, by split: all tokens are restored."""
    w = words(spark, sf)

    def one(count: int) -> DataFrame:
        rows, key = M.suffixed(w, count)
        return _figures(M.decoded(rows, key, 1), str(count))

    return _union(map(one, (1, 2, 4, 8, 16)))


def _pair(factors: str) -> str:
    a, b = M.slots(0, factors)
    v = f"({_draw('0', chr(39) + 'place' + chr(39), 'line', 'token')} % 16)"
    return f"[{_list(a)}[cast({v} // {len(b)} + 1 as integer)], {_list(b)}[cast({v} % {len(b)} + 1 as integer)]]"


@query(_W + ", e as (" + " union all ".join(f"select '{f}' as grp, word, split, list_concat(base, {_pair(f)}) as cipher, true as targeted from op" for f in M.FACTORS) + ")" + _FIGURES)
def affix_diagnostics(spark, sf):
    """Base forms with pairs of affixes in three factorisations of sixteen variants, by split."""
    w = words(spark, sf)

    def one(factors: str) -> DataFrame:
        rows, key = M.affixed(w, factors)
        return _figures(M.decoded(rows, key, 2), factors)

    return _union(map(one, M.FACTORS))


_H = "round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) + 0.0"


@query(_W + ", e as (" + " union all ".join(f"select '{f}' as grp, split, {_pair(f)} as p, {_draw('0', chr(39) + 'place' + chr(39), 'line', 'token')} % 16 as v from op" for f in M.FACTORS) + f"""),
a as (select grp, split, {_H} as first_bits from (select grp, split, p[1] as x, count(*) as n from e group by all) group by grp, split), b as (select grp, split, {_H} as second_bits from (select grp, split, p[2] as x, count(*) as n from e group by all) group by grp, split),
c as (select grp, split, {_H} as pair_bits from (select grp, split, p as x, count(*) as n from e group by all) group by grp, split), d as (select grp, split, {_H} as variant_bits from (select grp, split, v as x, count(*) as n from e group by all) group by grp, split)
select * from a join b using (grp, split) join c using (grp, split) join d using (grp, split)""")  # fmt: skip
def affix_entropies(spark, sf):
    w = words(spark, sf)
    return _union(M.slot_entropies(M.affixed(w, f)[0], "split").withColumn("grp", F.lit(f)) for f in M.FACTORS)


@query(_W + " select f.grp, count(*) as tokens, 0::bigint as wrong from op, (select unnest(['" + "', '".join(M.FACTORS) + "']) as grp) f group by f.grp")
def affix_variants_restored(spark, sf):
    """Tokens whose variant the pair of affixes doesn't give back: none."""
    w = words(spark, sf)

    def one(factors: str) -> DataFrame:
        rows = M.affixed(w, factors)[0]
        return rows.agg(F.lit(factors).alias("grp"), F.count("*").alias("tokens"), F.count_if(~M.affix_variant(F.col("cipher"), factors).eqNullSafe(F.col("variant"))).alias("wrong"))

    return _union(map(one, M.FACTORS))


_OCC = _W + ", oc as (select *, row_number() over (partition by word order by split = 'validation', line, token) - 1 as occurrence from op)"
_TURN = {
    "recurrence": f", pm as (select word, 0 as turn, list(v order by d, v) as p from (select word, v, {_draw('0', chr(39) + 'turn' + chr(39), 'word', '0', 'v')} as d from ch, range(16) as r(v)) group by word), al as (select oc.*, cast(p[cast(occurrence % 16 + 1 as integer)] as integer) as variant from oc join pm using (word))",
    "shuffled": f", pm as (select word, turn, list(v order by d, v) as p from (select word, turn, v, {_draw('0', chr(39) + 'turn' + chr(39), 'word', 'turn', 'v')} as d from (select distinct word, occurrence // 16 as turn from oc), range(16) as r(v)) group by all), al as (select oc.*, cast(p[cast(occurrence % 16 + 1 as integer)] as integer) as variant from oc join pm on oc.word = pm.word and pm.turn = oc.occurrence // 16)",
    "iid": f", al as (select *, cast({_draw('0', chr(39) + 'iid' + chr(39), 'word', 'occurrence')} % 16 as integer) as variant from oc)",
}
_CIPHER = f"list_append(base, {_list(M.suffixes(0))}[variant + 1])"


def _allocation(scheme: str) -> None:
    def figures(spark, sf):
        rows, key = M.allocated(words(spark, sf), scheme)
        return _figures(M.decoded(rows, key, 1), scheme)

    figures.__name__ = f"allocation_diagnostics_{scheme}"
    query(_OCC + _TURN[scheme] + f", e as (select '{scheme}' as grp, word, split, {_CIPHER} as cipher, true as targeted from al)" + _FIGURES)(figures)


for _s in M.SCHEMES:
    _allocation(_s)


@query("select unnest(['schedule', 'forms_in_train', 'repeats_within_a_cycle', 'round_trip']) as \"check\", 0::bigint as violations")
def allocation_checks(spark, sf):
    rows, key = M.allocated(words(spark, sf))
    return M.allocation_checks(M.decoded(rows, key, 1))


@query(_OCC + _TURN["recurrence"] + """, u as (select word, count(*) as seen, list(distinct variant) as forms from al where split = 'train' group by word), v as (select al.*, coalesce(seen, 0) as seen, coalesce(list_contains(forms, variant), false) as again from al left join u using (word) where split = 'validation')
select count(*) as tokens, count_if(occurrence < seen) as counter_breaks, count_if(occurrence < 16) as avoidable, count_if(occurrence < 16 and again) as avoidable_reuses, count_if(occurrence >= 16 and again) as unavoidable_reuses from v""")
def continuation(spark, sf):
    """Validation goes on where train's turns end: no form is used again while others are left."""
    return M.continuation(M.allocated(words(spark, sf))[0])


_TOP = """, top as (select word, n, row_number() over (order by n desc, word) - 1 as rank from (select word, count(*) as n from ws where split = 'train' group by word) order by n desc, word limit {})"""
_SYMBOLS = _list(M.by_hash([f"N{i:04d}" for i in range(1, 17)], "symbol", 0))
_RELATED = _TOP.format(64) + f", cd as (select word, row_number() over (order by sha256('code|0|' || word), word) - 1 as rank from top), cf as (select word, list_transform([0, 1, 2, 3], lambda k: [{_SYMBOLS}[cast(rank // 4 + 1 as integer)], {_SYMBOLS}[cast(rank % 4 * 4 + k + 1 as integer)]]) as forms from cd)"


def _forms(count: int) -> str:
    v = _draw("0", "'form'", "line", "token", "op.word")
    return f"select '{count}' as grp, op.word, split, coalesce(forms[cast({v} % {count} + 1 as integer)], base) as cipher, forms is not null as targeted from op left join cf using (word)"


@query(_W + _RELATED + ", e as (" + " union all ".join(map(_forms, (1, 2, 4))) + ")" + _FIGURES)
def related_code_diagnostics(spark, sf):
    """The 64 most frequent words as codes with 1, 2 and 4 forms."""
    w = words(spark, sf)
    codes = M.related_codes(w)

    def one(count: int) -> DataFrame:
        rows, key = M.coded(w, codes, count)
        return _figures(M.decoded_codes(rows, key, codes), str(count), "targeted")

    return _union(map(one, (1, 2, 4)))


TARGETS = (16, 64, 256)


_H = int(hashlib.sha256(b"family|0").hexdigest()[:8], 16)
_MASTER = _TOP.format(256) + f""", fm as (select word, rank, cast((rank * {2 * (_H % 2048) + 1} + {_H // 4096}) % 4096 as integer) as f, list_transform(list_sort(list_transform({_SYMBOLS}, lambda g: {{'d': {_draw("0", "'last'", "word", "g")}, 'g': g}})), lambda x: x.g)[1:4] as lasts from top),
cf as (select word, rank, list_transform(lasts, lambda g: [{_SYMBOLS}[f // 256 % 16 + 1], {_SYMBOLS}[f // 16 % 16 + 1], {_SYMBOLS}[f % 16 + 1], g]) as forms from fm)"""


def _covered(active: int) -> str:
    v = _draw("0", "'form'", "line", "token", "op.word")
    return f"select '{active}' as grp, op.word, split, case when rank < {active} then forms[cast({v} % 4 + 1 as integer)] else base end as cipher, coalesce(rank < {active}, false) as targeted from op left join cf using (word)"


@query(_W + _MASTER + ", e as (" + " union all ".join(map(_covered, TARGETS)) + ")" + _FIGURES)
def coverage_diagnostics(spark, sf):
    """The most frequent words as codes of one master key, of which 16, 64 and 256 are in use."""
    w = words(spark, sf)
    codes = written(M.master_codes(w, max(TARGETS)), "codes")

    def one(active: int) -> DataFrame:
        rows, key = M.coded(w, codes, 4, active=active)
        return _figures(M.decoded_codes(rows, key, codes), str(active), "targeted")

    return _union(map(one, TARGETS))


@query(_W + _TOP.format(256) + " select a.active::integer as active, split, count_if(rank < active) as targeted, count(*) as tokens from ws left join top using (word), (select unnest([16, 64, 256]) as active) a where split <> 'reserved' group by all")
def coverage_shares(spark, sf):
    """Tokens that codes reach, by the number of codes."""
    w = words(spark, sf)
    codes = M.master_codes(w, max(TARGETS))
    return _union(M.coded(w, codes, 4, active=n)[0].groupBy("split").agg(F.count_if("targeted").alias("targeted"), F.count("*").alias("tokens")).withColumn("active", F.lit(n)) for n in TARGETS)


@query("select unnest(['code_used_twice', 'code_changes_with_count', 'codes_of_one_word_too_far_apart']) as \"check\", 0::bigint as violations")
def code_checks(spark, sf):
    """No two words share a code, a word's code doesn't depend on how many are coded, and its forms differ in one glyph."""
    from foliant.functions.normalize import mean_hamming

    w = words(spark, sf)
    many, few = written(M.master_codes(w, 256), "codes"), M.master_codes(w, 16)
    each = many.select("word", F.explode("forms").alias("f")).groupBy("f").agg(F.count_distinct("word").alias("n"))
    changed = few.join(many.select("word", F.col("forms").alias("other")), "word", "left").where(~F.col("forms").eqNullSafe(F.col("other")))
    return checks(
        violations("code_used_twice", each.where("n > 1")), violations("code_changes_with_count", changed), violations("codes_of_one_word_too_far_apart", many.where(mean_hamming(F.col("forms")) != 1.0)),
    )


@query(_W + f", c as (select line, any_value(split) as split, list(list_append(base, {_list(M.suffixes(0, 4))}[cast({_draw('0', chr(39) + 'place' + chr(39), 'line', 'token')} % 4 + 1 as integer)]) order by token) as tokens from op group by line), l as (select distinct line, split from ws) select l.line, l.split, tokens, l.split = 'reserved' as reserved_test_opaque from l left join c using (line)")
def control_lines(spark, sf):
    """A control text of four suffixes as lines; reserved ones are opaque."""
    w = words(spark, sf)
    rows, key = M.suffixed(w, 4)
    right = M.decoded(rows, key, 1)
    enforce(violations("round_trip", right.where("not restored <=> word")), "control")  # verified before it is given out
    return M.control_lines(rows, w)


@query(_W + f", e as (select split, list_append(base, {_list(M.suffixes(0, 4))}[cast({_draw('0', chr(39) + 'place' + chr(39), 'line', 'token')} % 4 + 1 as integer)]) as g, line from op) select a.*, alphabet_size from (select split, count(distinct line) as lines, count(*) as tokens, sum(len(g))::bigint as glyphs, count(distinct g) as unique_tokens from e group by split) a join (select split, count(distinct x) as alphabet_size from (select split, unnest(g) as x from e) group by split) b using (split)")
def control_counts(spark, sf):
    return M.text_counts(M.suffixed(words(spark, sf), 4)[0], F.col("cipher"), "split")


@query("select 1::bigint as fingerprints, 5::bigint as texts")
def key_invariance(spark, sf):
    """Texts of any number of suffixes have one key."""
    w = words(spark, sf)
    prints = _union(M.key_fingerprint(M.suffixed(w, k)[1]) for k in (1, 2, 4, 8, 16))
    return prints.agg(F.count_distinct("fingerprint").alias("fingerprints"), F.count("*").alias("texts"))


@query("select unnest(['used_twice', 'wrong_length', 'without_one']) as \"check\", 0::bigint as violations")
def codeword_checks(spark, sf):
    items = K.top_words(words(spark, sf).where("split = 'train'"), 100).toDF("item")
    codes = M.codewords(items, 3, [f"B{i:04d}" for i in range(1, 17)])
    return checks(
        violations("used_twice", codes.groupBy("codeword").agg(F.count("*").alias("n")).where("n > 1")), violations("wrong_length", codes.where("size(codeword) <> 3")), violations("without_one", items.join(codes, "item", "left_anti")),
    )
