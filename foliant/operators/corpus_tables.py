"""All statistics of a corpus at once: named tables, one summary row, and its figures as (metric, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import corpus as C
from foliant.session import written


def as_lines(rows: DataFrame, glyphs: str = "cipher") -> DataFrame:
    """Rows (line, token, glyphs) as lines that the corpus statistics take. A line is one row; lines are short."""
    own = rows.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("token", F.col(glyphs).alias("g")))).alias("t"))
    return own.select(F.col("line").alias("record_id"), F.transform("t", lambda x: x["g"]).alias("tokens"))


def tables(lines: DataFrame, most_distance: int = 8, orders: int = 4) -> dict[str, DataFrame]:
    """The tables of a corpus by name. Lines with labels (section, currier, scribe) give tables by label, too."""
    g = C.glyphs(lines)
    known = g.where(F.col("glyph") != C.UNKNOWN)
    one = C.tokens(lines).withColumn("size", F.size("glyphs"))
    out = {
        "token_frequency": one.groupBy("tok").agg(F.count("*").alias("n")),
        "top_tokens": C.ranked_tokens(lines, 50).select("tok", "n", "rank"),
        "glyph_frequency": g.groupBy("glyph").agg(F.count("*").alias("n")),
        "unigram_entropy": C.entropy(known.groupBy("glyph").agg(F.count("*").alias("n")), []),
        "token_entropy": C.entropy(one.where(C.readable(F.col("glyphs"))).groupBy("tok").agg(F.count("*").alias("n")), []),
        "conditional_entropy": reduce(DataFrame.unionByName, (C.conditional_entropy(lines, k) for k in range(1, orders + 1))),
        "token_length": C.length_statistics(one, "size"),
        "token_length_distribution": one.groupBy("size").agg(F.count("*").alias("n")),
        "glyph_mutual_information": C.mutual_information(C.glyph_pairs(lines, most_distance), "distance"),
        "token_mutual_information": C.mutual_information(C.token_pairs(lines, most_distance), "distance"),
        "glyph_positions": C.glyph_positions(lines),
        "glyph_position_entropy": C.entropy(C.glyph_positions(lines), ["position"]),
        "glyph_position_divergence": C.divergences(C.glyph_positions(lines), "position"),
        "token_position_entropy": C.entropy(C.token_positions(lines), ["position"]),
        "token_position_divergence": C.divergences(C.token_positions(lines), "position"),
        "edit_neighbourhoods": C.edit_neighbourhoods(lines),
        "measures": C.corpus_measures(lines),
    }
    for label in ("section", "currier", "scribe"):
        if label in lines.columns:
            by = C.glyphs(lines, label).where(F.col("glyph") != C.UNKNOWN).groupBy(label, F.col("glyph").alias("item")).agg(F.count("*").alias("n"))
            out[f"{label}_glyph_frequency"] = by
            out[f"{label}_glyph_divergence"] = C.divergences(by, label)
    return out


def edit_means(lines: DataFrame, top: int = 300) -> DataFrame:
    """One row: the mean number of the top tokens one edit, and up to two edits, from each of them."""
    near = C.edit_neighbourhoods(lines, top)
    ends = near.select(F.explode(F.array("a", "b")).alias("tok"), "distance").groupBy("tok").agg(F.count_if(F.col("distance") == 1).alias("one"), F.count("*").alias("two"))
    best = C.ranked_tokens(lines, top).select("tok").join(ends, "tok", "left")
    return best.agg(F.avg(F.coalesce("one", F.lit(0))).alias("edit_neighbours_1"), F.avg(F.coalesce("two", F.lit(0))).alias("edit_neighbours_2"))


def metrics(lines: DataFrame, most_distance: int = 8, orders: int = 4) -> DataFrame:
    """(metric, value): the scalar figures of a corpus, each a row; a distance or divergence without pairs is 0."""
    lines = written(lines, "lines")
    t = tables(lines, most_distance, orders)
    one = lambda df, value, name: df.select(F.lit(name).alias("metric"), F.col(value).cast("double").alias("value"))
    m = t["measures"]
    parts = [
        one(t["unigram_entropy"], "entropy_bits", "unigram_entropy"),
        t["conditional_entropy"].select(F.concat(F.lit("conditional_entropy_"), "order").alias("metric"), F.col("entropy_bits").cast("double").alias("value")),
        one(t["token_length"], "mean", "token_length_mean"), one(t["token_length"], "median", "token_length_median"), one(m, "type_token_ratio", "unique_token_ratio"), one(m, "hapax_ratio", "hapax_ratio"), one(m, "top_share", "top_token_share"),
    ]
    edits = edit_means(lines)
    parts += [one(edits, c, c) for c in ("edit_neighbours_1", "edit_neighbours_2")]
    names = [(f"divergence_{a}_{b}", a, b) for a, b in (("final", "initial"), ("final", "medial"), ("initial", "medial"))]
    spark = lines.sparkSession
    pairs = spark.createDataFrame(names, "metric string, a string, b string").join(t["glyph_position_divergence"], ["a", "b"], "left")
    parts.append(pairs.select("metric", F.coalesce("jsd_bits", F.lit(0.0)).alias("value")))
    distances = spark.range(1, most_distance + 1).select(F.col("id").cast("int").alias("distance")).join(t["glyph_mutual_information"], "distance", "left")
    parts.append(distances.select(F.concat(F.lit("glyph_information_"), "distance").alias("metric"), F.coalesce("mi_bits", F.lit(0.0)).alias("value")))
    return reduce(DataFrame.unionByName, parts).select("metric", (F.round("value", 6) + 0.0).alias("value"))
