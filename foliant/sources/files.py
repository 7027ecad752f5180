"""Readers and writers of the other file formats. All readers have fixed schemas."""

from __future__ import annotations

import hashlib
import html.parser
import io
import json
import re
import urllib.parse
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.normalize import source_tokens
from foliant.session import written

CONTROL_SCHEMA = "line_index long, split string, tokens array<array<string>>, reserved_test_opaque boolean"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_index, text): the lines of text files, counted from 0 within each. Files are read in parts like any text:
    a part counts its own lines, and starts from what the parts before it hold."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for b in batches:
            own = []
            for at in zip(b.column("file").to_pylist(), b.column("block").to_pylist()):
                n = n + 1 if at == last else 0
                last = at
                own.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], ["file", "block", "text", "own"])

    each = written(rows.mapInArrow(counted, "file string, block long, text string, own long"), "lines")
    parts = each.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = parts.select("file", "block", F.expr("sum(n) over (partition by file order by block) - n").alias("before"))  # a row for each part
    return each.join(before, ["file", "block"]).select("file", (F.col("own") + F.col("before")).alias("line_index"), "text")


def read_control_lines(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(line_index, tokens) of JSON lines: opaque and empty lines skipped; an empty token is refused, and so is a corpus
    without lines. expected: the number of rows, opaque ones too, numbered from 1 on without gaps."""
    rows = spark.read.schema(CONTROL_SCHEMA).option("mode", "FAILFAST").json(path)
    held = rows.where("not coalesce(reserved_test_opaque, false) and size(tokens) > 0")
    if held.isEmpty():
        raise ValueError(f"no lines in {path}")
    if expected is not None:
        found = rows.agg(F.count("*").alias("n"), F.count_distinct("line_index").alias("d"), F.min("line_index").alias("a"), F.max("line_index").alias("z")).first()
        if tuple(found) != (expected, expected, 1, expected):
            raise ValueError(f"{expected} lines are expected, {found['n']} are there, numbered {found['a']} to {found['z']}")
    bad = F.exists("tokens", lambda t: t.isNull() | (F.size(t) == 0))
    return held.select("line_index", "split", F.when(~bad, F.col("tokens")).otherwise(F.raise_error(F.lit("a token without glyphs"))).alias("tokens"))


def read_selected_lines(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(file, line_index, text) of the wanted lines only; others are never parsed. wanted (line_index) takes these lines of
    every file, wanted (file, line_index) those of the files named, by the last part of their path."""
    rows = numbered_lines(spark, path).withColumn("file", F.substring_index("file", "/", -1))
    keys = [c for c in ("file", "line_index") if c in wanted.columns]
    return rows.join(wanted.select(*keys).distinct(), keys, "left_semi").select("file", "line_index", "text")


def read_source_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, tokens) of normalised text, counted from 1; an empty line is an error."""
    return numbered_lines(spark, path).select((F.col("line_index") + 1).alias("line"), source_tokens(F.col("text")).alias("tokens"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as text; quoted fields may hold line breaks."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)


def load_config(path: str) -> dict:
    """A settings file in JSON or YAML, which the driver reads; anything but a mapping is refused."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            held = json.load(f)
        else:
            import yaml

            held = yaml.safe_load(f)
    if not isinstance(held, dict):
        raise ValueError(f"{path} holds no mapping")
    return held


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """(file, sentence, forms): words of CoNLL-U; ranges and empty nodes skipped, a blank line ends a sentence."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    blocks = files.select("file", F.posexplode(F.split("value", r"\n\s*\n")).alias("sentence", "block"))
    rows = F.filter(F.transform(F.split("block", "\r?\n"), lambda x: F.split(x, "\t")), lambda p: F.get(p, F.lit(0)).rlike(r"^\d+$"))
    return blocks.select("file", "sentence", F.transform(rows, lambda p: F.get(p, F.lit(1))).alias("forms")).where("size(forms) > 0")


def _archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in sorted(z.namelist()):
                    if name.endswith(".xml"):
                        yield pd.DataFrame({"path": [path], "name": [name], "xml": [z.read(name).decode()]})


def read_xml_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, xml) of each XML file in ZIP archives."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_archive, "path string, name string, xml string")


def xml_words(xml: Column) -> Column:
    """Lines of words: <w> elements, parted where a sentence or line ends."""
    marked = F.regexp_replace(F.regexp_replace(xml, r"(?s)<\?.*?\?>|<!--.*?-->", ""), r"</(?:s|l|p|ab)>|<lb\b[^>]*>", "\u0001")
    lines = F.split(marked, "\u0001")
    words = lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"(?s)<w(?:\s[^>]*)?>(.*?)</w>"), 1), lambda w: F.trim(F.regexp_replace(w, "<[^>]*>", "")))
    return F.filter(F.transform(lines, lambda x: F.filter(words(x), lambda w: w != "")), lambda l: F.size(l) > 0)


class _Text(html.parser.HTMLParser):
    """Running text within blocks. Which elements hold text, which never do, and what the class of an element
    holds that is apparatus."""

    keep, skip = {"p", "li", "dd", "blockquote", "pre"}, {"script", "style", "table", "sup"}
    apparatus = ("mw-editsection", "reference", "references", "navbox", "ws-noexport", "pagenum", "pagequality", "mw-collapsible")
    breaks, void = keep | {"br", "div"}, {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.kept, self.hidden = [], 0, []

    def handle_starttag(self, tag, attrs):
        classes = dict(attrs).get("class") or ""
        if (self.hidden or tag in self.skip or any(c in classes for c in self.apparatus)) and tag not in self.void:
            self.hidden.append(tag)
            return
        self.kept += tag in self.keep
        if tag in self.breaks:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:  # what was left open within it ends with it
                while self.hidden.pop() != tag:
                    pass
            return
        self.kept -= tag in self.keep and self.kept > 0
        if tag in self.breaks:
            self.out.append("\n")

    def handle_data(self, data):
        if self.kept and not self.hidden:
            self.out.append(data)


@F.pandas_udf(T.StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """The running text of pages: a line a block, blanks squeezed; null stays null."""

    def one(page: str | None) -> str | None:
        if page is None:
            return None
        p = _Text()
        p.feed(page)
        p.close()
        lines = (re.sub(r"\s+", " ", x).strip() for x in "".join(p.out).split("\n"))
        return "\n".join(x for x in lines if x)

    return pages.map(one, na_action=None)


def links(page: Column) -> Column:
    """The hrefs of a page's anchors in order, each once."""
    return F.array_distinct(F.regexp_extract_all(page, F.lit(r'<a\b[^>]*\bhref="([^"]+)"'), 1))


def canvases(manifest: Column) -> Column:
    """The (id, label) of a IIIF manifest's canvases, of version 3 (items) or 2 (sequences)."""
    three = F.from_json(F.get_json_object(manifest, "$.items"), "array<struct<id:string,label:string>>")
    two = F.from_json(F.get_json_object(manifest, "$.sequences"), "array<struct<canvases:array<struct<`@id`:string,label:string>>>>")
    old = F.transform(F.flatten(F.transform(two, lambda s: s["canvases"])), lambda c: F.struct(c["@id"].alias("id"), c["label"].alias("label")))
    return F.coalesce(three, old)


def folio_labels(label: Column) -> Column:
    """The pages that a compound label names, in order: '68r1, r2' is f68r1 and f68r2."""
    parts = F.regexp_extract_all(label, F.lit(r"((?:\d+)?[rv]\d*)"), 1)
    step = F.aggregate(
        parts, F.struct(F.lit("").alias("leaf"), F.array().cast("array<string>").alias("out")),
        lambda a, p: F.struct(
            F.coalesce(F.nullif(F.regexp_extract(p, r"^(\d+)", 1), F.lit("")), a["leaf"]).alias("leaf"),
            F.concat(a["out"], F.array(F.concat(F.lit("f"), F.coalesce(F.nullif(F.regexp_extract(p, r"^(\d+)", 1), F.lit("")), a["leaf"]), F.regexp_extract(p, r"([rv]\d*)$", 1)))).alias("out"),
        ),
    )
    return F.array_distinct(step["out"])


def write_csv(frames: list[DataFrame], path: str, spark: SparkSession | None = None) -> None:
    """Rows with different columns as one CSV of all columns in first-seen order; of no frames, an empty folder of one
    empty file."""
    if not frames:
        (spark or SparkSession.getActiveSession()).createDataFrame([], "nothing string").coalesce(1).write.mode("overwrite").text(path)
        return
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    plain = [F.to_json(c).alias(c) if isinstance(t.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c) for c, t in zip(out.columns, out.schema)]
    out.select(*plain).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small text file at any address that Spark writes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def _json(value: object) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def write_checksums(spark: SparkSession, path: str) -> None:
    """SHA256SUMS of a folder: a line for each file in it at any depth but hidden ones, in order of their names."""
    rows = checksums(spark, path).where(~F.col("path").endswith("/SHA256SUMS")).collect()  # a folder's files
    root = path.rstrip("/").removeprefix("file:")
    names = sorted((r["path"].split(root + "/", 1)[-1], r["sha256"]) for r in rows)
    _put(spark, f"{path.rstrip('/')}/SHA256SUMS", "".join(f"{h}  {n}\n" for n, h in names))


def write_tables(spark: SparkSession, path: str, summary: dict, tables: dict[str, DataFrame], provenance: dict) -> None:
    """A folder of summary.json, a CSV folder for each table, run_manifest.json and, last, SHA256SUMS."""
    root = path.rstrip("/")
    for name in sorted(tables):
        write_csv([tables[name]], f"{root}/{name}.csv")
    _put(spark, f"{root}/summary.json", _json({**summary, "provenance": provenance}))
    _put(spark, f"{root}/run_manifest.json", _json({"schema_version": "1.0", "provenance": provenance, "artifacts": sorted(["summary.json", *(f"{n}.csv" for n in tables)])}))
    write_checksums(spark, root)


def read_metrics(spark: SparkSession, path: str, figures: dict[str, str], tables: dict[str, tuple[str, str]]) -> DataFrame:
    """(metric, value) from a folder that write_tables made. figures: of each metric the dotted path into summary.json;
    tables: of each table (its CSV) the column that names the metric and the one that holds the value."""
    text = spark.read.text(f"{path.rstrip('/')}/summary.json", wholetext=True)
    rows = [F.struct(F.lit(m).alias("metric"), F.get_json_object("value", f"$.{at}").cast("double").alias("value")) for m, at in figures.items()]
    out = text.select(F.inline(F.array(*rows)))
    for name, (label, value) in tables.items():
        own = read_csv(spark, f"{path.rstrip('/')}/{name}.csv")
        out = out.unionByName(own.select(F.concat(F.lit(f"{name}_"), F.col(label)).alias("metric"), F.col(value).cast("double").alias("value")))
    return out


def write_control(lines: DataFrame, path: str, *more: str) -> None:
    """JSON lines (line_index, tokens, more…), sorted within files."""
    lines.select("line_index", *more, "tokens").repartitionByRange("line_index").sortWithinPartitions("line_index").write.mode("overwrite").json(path)


def write_control_run(spark: SparkSession, path: str, cipher: DataFrame, key: dict, summary: dict, sources: dict[str, str]) -> None:
    """A folder of one control text: corpus.jsonl and corpus.txt, key.json, summary.json and SHA256SUMS. cipher: (line, token,
    word, restored, cipher…); a word that isn't restored is an error, before anything is written. sources: hashes of
    what the text was made from."""
    from foliant.operators.selection import enforce, violations

    enforce(violations("round_trip", cipher.where("not restored <=> word")), path)
    root = path.rstrip("/")
    by = cipher.groupBy(F.col("line").alias("line_index")).agg(F.array_sort(F.collect_list(F.struct("token", "cipher"))).alias("t")).select("line_index", F.transform("t", lambda x: x["cipher"]).alias("tokens"))
    by = written(by, "control")
    write_control(by, f"{root}/corpus.jsonl")
    by.repartitionByRange("line_index").sortWithinPartitions("line_index").select(cipher_text(F.col("tokens"))).write.mode("overwrite").text(f"{root}/corpus.txt")
    _put(spark, f"{root}/key.json", _json(key))
    _put(spark, f"{root}/summary.json", _json({"schema_version": "1.0", **sources, **summary, "round_trip_verified": True}))
    write_checksums(spark, root)


def write_confirmatory(spark: SparkSession, path: str, lines: DataFrame, key: dict, provenance: dict) -> None:
    """A folder of a text whose validation lines stay opaque: lines (line, split, tokens), train and reserved ones with their
    tokens, validation ones with nothing but their number; key.json, summary.json and SHA256SUMS. A line of no split is an
    error when it is written."""
    root = path.rstrip("/")
    known = F.col("split").isin("train", "reserved", "validation")
    shown = F.col("split") != "validation"
    split = F.when(~F.coalesce(known, F.lit(False)), F.raise_error(F.concat(F.lit("a line of no split: "), F.col("line").cast("string"))).cast("string")).when(shown, F.col("split"))
    rows = lines.select(F.col("line").alias("line_index"), split.alias("split"), F.when(shown, F.col("tokens")).alias("tokens"), F.when(~shown, F.lit(True)).alias("opaque"))
    write_control(rows, f"{root}/corpus.jsonl", "split", "opaque")
    counts = {r["split"]: r["n"] for r in lines.groupBy("split").agg(F.count("*").alias("n")).collect()}
    _put(spark, f"{root}/key.json", _json(key))
    _put(spark, f"{root}/summary.json", _json({"schema_version": "1.0", "provenance": provenance, "train_lines_encoded": counts.get("train", 0), "reserved_lines_encoded": counts.get("reserved", 0), "validation_lines_encoded": 0}))
    write_checksums(spark, root)


def cipher_text(tokens: Column) -> Column:
    """'-' joins glyphs, a blank joins tokens."""
    return F.array_join(F.transform(tokens, lambda t: F.array_join(t, "-")), " ")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files at any depth. Files that executors can open are read piece by piece, so they may be of any
    size; others come as one value of at most 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if "://" in path and not path.startswith("file:"):
        return files.select("path", F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, sums = b.column(0).to_pylist(), []
            for name in paths:
                with open(urllib.parse.unquote(name.removeprefix("file:")), "rb") as f:
                    sums.append(hashlib.file_digest(f, "sha256").hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.string())], ["path", "sha256"])

    return files.select("path").mapInArrow(run, "path string, sha256 string")


def hash_gate(spark: SparkSession, path: str, expected: dict[str, str]) -> DataFrame:
    """Checks of files by the last part of their path: violated where one is missing or has another hash."""
    from foliant.operators.selection import frozen

    found = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in checksums(spark, path).collect()}  # a folder's files
    return frozen(spark, found, expected)
