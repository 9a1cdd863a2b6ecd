"""Sources.  Schemas are given, never guessed; bad rows come as nulls with _corrupt_record where the schema has it."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions.brackets import brace_spans, piece


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzip too; blank lines are skipped, a missing path is empty."""
    try:
        return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_docs(spark: SparkSession, root: str, glob: str, schema: str) -> DataFrame:
    """A folder tree of one-document JSON files, with path and category (the file's folder)."""
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).json(root)
    path = F.col("_metadata.file_path")
    return df.select("*", path.alias("path"), F.element_at(F.split(path, "/"), -2).alias("category_dir"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: files that each hold one list of objects; a file with anything else is an error."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", f"array<struct<{schema}>>")).otherwise(F.raise_error(F.lit("not a list"))).alias("rows"))
    return rows.select(F.inline("rows"))


def load_taxonomy(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Category, slot, parent, option, weight from YAML texts by category name (a few small files, parsed on the driver).

    A mapping of lists gives slots with options; a mapping of mappings gives options that depend
    on the parent named by the key; an option may be a mapping with name and weight.
    """
    import yaml

    rows: list[tuple] = []
    for name in sorted(files):
        category = name.split("_")[0]
        for slot, options in (yaml.safe_load(files[name]) or {}).items():
            groups = [(None, options)] if isinstance(options, list) else list(options.items()) if isinstance(options, dict) else []
            for parent, members in groups:
                for o in members if isinstance(members, list) else []:
                    label, weight = (o.get("name"), o.get("weight", 1.0)) if isinstance(o, dict) else (o, 1.0)
                    rows.append((category, slot, parent, str(label), float(weight)))
    return spark.createDataFrame(rows, "category string, slot string, parent string, option string, weight double")


def read_clips(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated clips with a header; empty fields are null, durations over 1000 are milliseconds."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)
    return df.withColumn("duration", F.when(F.col("duration") > 1000, F.col("duration") / 1000).otherwise(F.col("duration"))) if "duration" in df.columns else df


def read_speakers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Comma-separated speakers with a header."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_annotations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pipe-separated annotations, gzip too."""
    return spark.read.schema(schema).option("sep", "|").option("header", True).csv(path)


def parse_ldc(lines: DataFrame) -> DataFrame:
    """S6: "START END A: text" lines (call_id, value) as segments."""
    p = r"^\s*([\d.]+)\s+([\d.]+)\s+([AB])\d?:\s*(.*)$"
    g = lambda k: F.regexp_extract("value", p, k)
    return lines.where(F.col("value").rlike(p)).select("call_id", g(3).alias("channel"), g(1).cast("double").alias("start"), g(2).cast("double").alias("end"), F.trim(g(4)).alias("text"))


def parse_bbn(analysis: DataFrame, transcripts: DataFrame, rate: float = 8000.0) -> DataFrame:
    """Sample ranges (-c channel -f from-to -o utterance) with the transcripts "text (utterance)"; seconds are samples / rate."""
    def option(flag: str, kind: str) -> Column:
        return F.regexp_extract("value", rf"-{flag}\s+({kind})", 1)

    a = analysis.select("call_id", option("c", r"\S+").alias("channel"), option("f", r"\d+-\d+").alias("range"), option("o", r"\S+").alias("utt")).where("range <> ''")
    ends = F.split("range", "-")
    a = a.select("call_id", F.when(F.col("channel").isin("1", "A"), "A").otherwise("B").alias("channel"), (ends[0].cast("double") / rate).alias("start"), (ends[1].cast("double") / rate).alias("end"), "utt")
    t = transcripts.select("call_id", F.regexp_extract("value", r"\(([^()\s]+)\)\s*$", 1).alias("utt"), F.trim(F.regexp_replace("value", r"\([^()\s]+\)\s*$", "")).alias("text")).where("utt <> ''")
    return a.join(t, ["call_id", "utt"]).drop("utt")


def parse_trans(lines: DataFrame) -> DataFrame:
    """S6: "id transcript" lines."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return lines.where(F.size(parts) == 2).select(parts[0].alias("id"), parts[1].alias("text"))


def parse_speakers(lines: DataFrame) -> DataFrame:
    """S6: "id | sex | ..." lines; ";" begins a comment."""
    parts = F.transform(F.split("value", r"\|"), lambda p: F.trim(p))
    return lines.where(~F.ltrim("value").startswith(";") & F.contains("value", F.lit("|"))).select(parts[0].alias("speaker"), parts[1].alias("sex"))


def parse_filelist(lines: DataFrame) -> DataFrame:
    """Call ids of a partition list, five digits."""
    return lines.select(F.regexp_extract("value", r"(\d+)", 1).alias("id")).where("id <> ''").select(F.lpad("id", 5, "0").alias("call_id")).distinct()


def wav_seconds(length: Column, rate: int = 16000) -> Column:
    """Seconds of a 16-bit mono file by its size."""
    return (length - 44) / (2.0 * rate)


def wav_listing(spark: SparkSession, root: str) -> DataFrame:
    """Audio files with durations by size; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length", wav_seconds(F.col("length")).alias("duration"))


def discover_samples(files: DataFrame, required: list[str]) -> DataFrame:
    """Folders that hold all required file names.  files: path."""
    named = files.select(F.regexp_replace("path", r"/[^/]*$", "").alias("sample_dir"), F.element_at(F.split("path", "/"), -1).alias("name"))
    by = named.where(F.col("name").isin(required)).groupBy("sample_dir").agg(F.count_distinct("name").alias("n"))
    return by.where(F.col("n") == len(set(required))).select("sample_dir")


def resolve_source(candidates: DataFrame, samples: DataFrame) -> DataFrame:
    """For each source the first root, by priority, that has samples.  candidates: source, root, prio; samples: root."""
    return candidates.join(samples.select("root").distinct(), "root", "left_semi").groupBy("source").agg(F.min_by("root", "prio").alias("root"))


def import_corpus(files: DataFrame, durations: DataFrame, prefix: str, least_seconds: float) -> DataFrame:
    """Path (prefixed) and duration (table's if not 0, else probed; two digits) of files long enough.  files: path, probed; durations: path, duration."""
    d = durations.groupBy("path").agg(F.max("duration").alias("known"))
    j = files.join(d, "path", "left").withColumn("duration", F.coalesce(F.nullif("known", F.lit(0.0)), "probed"))
    return j.where(F.col("duration") >= least_seconds).select(F.concat(F.lit(prefix), F.col("path")).alias("path"), F.round("duration", 2).alias("duration"))


def explode_tasks(catalogue: DataFrame, keys: list[str]) -> DataFrame:
    """Every object of a JSON text (column ``value``) that has all ``keys``, at any depth, as one row of text fields; a text that isn't JSON is an error.

    Objects are found by their brackets, at all depths at once.
    """
    whole = catalogue.where(F.parse_json("value").isNotNull())
    spans = whole.select("value", F.explode(F.filter(brace_spans("value"), lambda s: ~s["odd"])).alias("s"))
    every = spans.select(F.parse_json(piece(F.col("value"), F.col("s"))).alias("v"))
    fields = [F.try_variant_get("v", f"$.{k}", "string").alias(k) for k in keys]
    return every.select(*fields).where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys)))


def corpus_status(registry: DataFrame, manifest: DataFrame, data: DataFrame) -> DataFrame:
    """Per registered source: has data, has a manifest, hours."""
    m = manifest.groupBy("source").agg((F.sum("duration") / 3600).alias("hours"))
    j = registry.select("source").join(m, "source", "left").join(data.select("source").distinct().withColumn("d", F.lit(True)), "source", "left")
    return j.select("source", F.coalesce("d", F.lit(False)).alias("has_data"), F.col("hours").isNotNull().alias("has_manifest"), F.coalesce("hours", F.lit(0.0)).alias("hours"))
