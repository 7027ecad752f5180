"""Queries of control texts, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from foliant.operators import ciphers as K
from foliant.plans.source_queries import _P, _PLAIN
from foliant.session import shuffle_parts, table, written

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_WORDS = _P.format(_PLAIN) + """, words as (select line, i - 1 as token, w as word from (select record_id as line, unnest(w) as w, generate_subscripts(w, 1) as i from (select record_id, list_filter(string_split(text, ' '), lambda x: x <> '') as w from p)))"""


@query(_WORDS + " select unnest(['" + "', '".join(K.FAMILIES) + "']) as family, count(*) as tokens, count(*) as restored from words")
def cipher_round_trips(spark, sf):
    """Tokens of each family that decoding gives back: all of them."""
    words = written(K.plain_words(table(spark, sf, "loci")).repartition(shuffle_parts(spark)), "words")  # all families read them
    alphabet = written(K.alphabet_key(words, 0), "key")

    def one(family: str):
        cipher, key = K.encoded(words, family, key=alphabet)
        both = K.decoded(cipher, key, family, "word")  # the word goes along: decoding sees the cipher and the key
        return both.agg(F.lit(family).alias("family"), F.count("*").alias("tokens"), F.count_if(F.col("word") == F.col("restored")).alias("restored"))

    return reduce(lambda a, b: a.unionByName(b), map(one, K.FAMILIES))


_KEY = _WORDS + """, key as (select x, row_number() over (order by sha256('0|' || x), x) - 1 as r from (select distinct unnest(string_split(word, '')) as x from words)),
chars as (select line, token, c, i from (select line, token, unnest(string_split(word, '')) as c, generate_subscripts(string_split(word, ''), 1) as i from words))"""


@query(_KEY + " select line, token, list('G' || lpad(cast(r as varchar), 4, '0') order by i) as cipher from chars join key on c = x group by all")
def cipher_mono(spark, sf):
    return K.encoded(K.plain_words(table(spark, sf, "loci")), "mono")[0].select("line", "token", "cipher")


@query(_KEY + " select line, token, list('G' || lpad(cast(r * 3 + ('0x' || substr(sha256('0|homophone|' || line || '|' || token || '|' || (i - 1)), 1, 8))::bigint % 3 as varchar), 4, '0') order by i) as cipher from chars join key on c = x group by all")
def cipher_homophonic(spark, sf):
    return K.encoded(K.plain_words(table(spark, sf, "loci")), "homophonic")[0].select("line", "token", "cipher")


@query(_KEY + " select line, token, flatten(list(['A' || lpad(cast(r // 16 as varchar), 4, '0'), 'B' || lpad(cast(r % 16 as varchar), 4, '0')] order by i)) as cipher from chars join key on c = x group by all")
def cipher_verbose(spark, sf):
    return K.encoded(K.plain_words(table(spark, sf, "loci")), "verbose")[0].select("line", "token", "cipher")


_OCC = _WORDS + ", o as (select *, row_number() over (partition by word order by line, token) - 1 as occurrence from words)"
_DRAW = "('0x' || substr(sha256({}), 1, 8))::bigint"
_VARIANT = {
    "iid": _OCC + f", v as (select *, cast({_DRAW.format('0 || chr(124) || line || chr(124) || token')} % 16 as integer) as variant from o)",
    "recurrence": _OCC + f", perm as (select word, list(v order by d, v) as p from (select word, v, {_DRAW.format('0 || chr(124) || word || chr(124) || v')} as d from (select distinct word from o), range(16) as r(v)) group by word), v as (select o.*, cast(p[cast(occurrence % 16 + 1 as integer)] as integer) as variant from o join perm using (word))",
    "shuffled": _OCC + f", perm as (select word, turn, list(v order by d, v) as p from (select word, turn, v, {_DRAW.format('0 || chr(124) || word || chr(124) || turn || chr(124) || v')} as d from (select distinct word, occurrence // 16 as turn from o), range(16) as r(v)) group by all), v as (select o.*, cast(p[cast(occurrence % 16 + 1 as integer)] as integer) as variant from o join perm on o.word = perm.word and perm.turn = o.occurrence // 16)",
}
_DIAGNOSTICS = """, n as (select word, variant, count(*) as n from v group by all), w as (select word, sum(n) as n, sum(n * (n - 1)) as same from n group by word), e as (select variant, sum(n) as n from n group by variant)
select sum(n)::bigint as tokens, count(*) as words, round(sum(case when n > 1 then n else 0 end) / sum(n), 6) as recurrence, round(sum(same) / nullif(sum(n * (n - 1)), 0), 6) as same_surface,
(select round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) from e) as variant_entropy from w"""


def _make(scheme: str) -> None:
    def chosen(spark, sf):
        return K.variants(K.plain_words(table(spark, sf, "loci")), scheme).select("line", "token", "occurrence", "variant")

    def figures(spark, sf):
        return K.variant_diagnostics(K.variants(K.plain_words(table(spark, sf, "loci")), scheme))

    chosen.__name__, figures.__name__ = f"variants_{scheme}", f"variant_diagnostics_{scheme}"
    query(_VARIANT[scheme] + " select line, token, occurrence, variant from v")(chosen)
    query(_VARIANT[scheme] + _DIAGNOSTICS)(figures)


for _s in _VARIANT:
    _make(_s)


@query(_VARIANT["iid"] + " select variant // 4 as a, variant % 4 as b, count(*) as n from v group by all")
def affix_slots(spark, sf):
    v = K.variants(K.plain_words(table(spark, sf, "loci")), "affix")
    a, b = K.affixes(F.col("variant"), 4)
    return v.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"))


_JOINED = "sha256(array_to_string(list({} order by {}), chr(10)))"


@query(_VARIANT["recurrence"] + f", ln as (select line, {_JOINED.format(chr(39) + chr(39) + ' || concat_ws(' + chr(39) + '|' + chr(39) + ', token, word, variant)', 'token')} as h from v group by line), pt as (select line // 4096 as p, {_JOINED.format('h', 'line')} as h from ln group by p) select {_JOINED.format('h', 'p')} as sha256 from pt")
def variant_stream_hash(spark, sf):
    return K.stream_hash(K.variants(K.plain_words(table(spark, sf, "loci")), "recurrence"), "word", "variant")
