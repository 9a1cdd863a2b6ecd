"""Registered queries of sources, sinks, incremental runs and models: tables go through files of their own, with SQL for what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.functions.shared import scratch
from turnweave.operators import corpus, scoring, speakers
from turnweave.plans.model import apply_model
from turnweave.queries import TIMELINE, UTT, c, query
from turnweave.sources import audio, readers, sinks
from turnweave.sources.versions import KeyedTable
from turnweave.streaming.incremental import live_utterances


def by_value(df: DataFrame, path: str, key: str) -> None:
    """Write the texts of ``df`` (key, value) as files, one a row, in folders by key."""
    df.repartition(key).write.partitionBy(key).option("maxRecordsPerFile", 1).text(path)


@query("s1_jsonl", "SELECT doc_id, source, lang, n_chars, text, NULL::varchar AS absent FROM documents")
def _(table):
    docs = table("documents")
    out = scratch(docs.sparkSession, "jsonl")
    docs.write.option("compression", "gzip").json(out)
    return readers.read_jsonl(docs.sparkSession, out, "doc_id long, source string, lang string, n_chars long, text string, absent string")


@query("s2_docs", "SELECT n_nationkey, n_name, 'region=' || n_regionkey AS category_dir FROM nation")
def _(table):
    """A file for each nation, in a folder for each region."""
    nation = table("nation")
    out = scratch(nation.sparkSession, "docs")
    by_value(nation.select(c("n_regionkey").alias("region"), F.to_json(F.struct("n_nationkey", "n_name"), {"pretty": "true"}).alias("value")), out, "region")
    return readers.read_docs(nation.sparkSession, out, "*.txt", "n_nationkey long, n_name string").select("n_nationkey", "n_name", "category_dir")


@query("s3_json_lists", "SELECT s_suppkey, s_name, s_acctbal::double AS s_acctbal FROM supplier")
def _(table):
    """A list for each nation of its suppliers."""
    supplier = table("supplier")
    out = scratch(supplier.sparkSession, "lists")
    one = F.struct("s_suppkey", "s_name", c("s_acctbal").cast("double").alias("s_acctbal"))
    by_value(supplier.groupBy(c("s_nationkey").alias("nation")).agg(F.to_json(F.collect_list(one)).alias("value")), out, "nation")
    return readers.read_json_array(supplier.sparkSession, f"{out}/*", "s_suppkey long, s_name string, s_acctbal double")


@query("s5_clips", "SELECT c_name AS path, c_mktsegment AS sentence, CASE WHEN abs(c_acctbal)::double > 1000 THEN abs(c_acctbal)::double / 1000 ELSE abs(c_acctbal)::double END AS duration FROM customer")
def _(table):
    customer = table("customer")
    out = scratch(customer.sparkSession, "clips")
    customer.select(c("c_name").alias("path"), c("c_mktsegment").alias("sentence"), F.abs("c_acctbal").cast("double").alias("duration")).write.option("sep", "\t").option("header", True).csv(out)
    return readers.read_clips(customer.sparkSession, out, "path string, sentence string, duration double")


@query("s5_annotations", "SELECT p_partkey, p_name, p_type FROM part")
def _(table):
    part = table("part")
    out = scratch(part.sparkSession, "annotations")
    part.select("p_partkey", "p_name", "p_type").write.option("sep", "|").option("header", True).option("compression", "gzip").csv(out)
    return readers.read_annotations(part.sparkSession, out, "p_partkey long, p_name string, p_type string")


@query("s5_speakers", "SELECT s_name AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'F' END AS sex FROM supplier")
def _(table):
    supplier = table("supplier")
    out = scratch(supplier.sparkSession, "speakers")
    supplier.select(c("s_name").alias("id"), F.when(c("s_suppkey") % 2 == 0, "F").alias("sex")).write.option("header", True).csv(out)
    return readers.read_speakers(supplier.sparkSession, out, "id string, sex string")


@query("s6_ldc_lines", """SELECT user_id::varchar AS call_id, CASE WHEN event_type = 'click' THEN 'A' ELSE 'B' END AS channel, (event_id % 1000) / 4.0::double AS start, (event_id % 1000) / 4.0::double + 0.5::double AS "end", event_type AS text FROM events""")
def _(table):
    start = (c("event_id") % 1000) / F.lit(4.0)
    side = F.when(c("event_type") == "click", "A").otherwise("B1")
    line = F.concat(F.lit(" "), start.cast("string"), F.lit("  "), (start + 0.5).cast("string"), F.lit(" "), side, F.lit(":  "), "event_type", F.lit(" "))
    lines = table("events").select(c("user_id").cast("string").alias("call_id"), F.explode(F.array(line, F.concat(F.lit("# "), line))).alias("value"))
    return readers.parse_ldc(lines)


@query("s6_bbn", """SELECT user_id::varchar AS call_id, CASE WHEN event_type = 'click' THEN 'A' ELSE 'B' END AS channel, (event_id % 1000)::double AS start, (event_id % 1000)::double + 0.5::double AS "end", 'a ' || event_type AS text FROM events""")
def _(table):
    at, k = (c("event_id") % 1000) * 8000, c("event_id").cast("string")
    rows = table("events").withColumn("call_id", c("user_id").cast("string"))
    side = F.when(c("event_type") == "click", "1").otherwise("2")
    analysis = rows.select("call_id", F.concat(F.lit("x -c "), side, F.lit(" -f "), at.cast("string"), F.lit("-"), (at + 4000).cast("string"), F.lit(" -o utt"), k).alias("value"))
    transcripts = rows.select("call_id", F.concat(F.lit("a "), "event_type", F.lit(" (utt"), k, F.lit(")")).alias("value"))
    return readers.parse_bbn(analysis, transcripts)


@query("s6_tables", "SELECT cast(doc_id AS varchar) AS id, source || ' ' || lang AS text, 'F' AS sex FROM documents")
def _(table):
    """Transcript lines and speaker lines, with comments and what is neither among them."""
    docs, k = table("documents"), c("doc_id").cast("string")
    lines = docs.select(F.explode(F.array(F.concat(k, F.lit("  "), "source", F.lit(" "), "lang"), F.concat(k, F.lit(" ")))).alias("value"))
    people = docs.select(F.explode(F.array(F.concat(k, F.lit(" | F | x")), F.concat(F.lit("; "), k, F.lit(" | M")), k)).alias("value"))
    return readers.parse_trans(lines).join(readers.parse_speakers(people).withColumnRenamed("speaker", "id"), "id")


@query("s6_filelist", "SELECT DISTINCT lpad(cast(user_id AS varchar), 5, '0') AS call_id FROM events")
def _(table):
    return readers.parse_filelist(table("events").select(F.concat(F.lit("x"), "user_id", F.lit(".sph")).alias("value")))


@query("s10_samples", "SELECT '/r/' || source || '/' || (doc_id % 7) AS sample_dir FROM documents WHERE lang IN ('en', 'de') GROUP BY source, doc_id % 7 HAVING count(DISTINCT lang) = 2")
def _(table):
    folder = F.concat(F.lit("/r/"), "source", F.lit("/"), (c("doc_id") % 7).cast("string"), F.lit("/"))
    return readers.discover_samples(table("documents").select(F.concat(folder, "lang", F.lit(".json")).alias("path")), ["en.json", "de.json"])


@query("s11_resolve_source", "SELECT source, 'root' || min(doc_id % 13) AS root FROM documents GROUP BY source")
def _(table):
    docs = table("documents").withColumn("k", c("doc_id") % 13)
    roots = docs.sparkSession.range(14).select(c("id").cast("int").alias("prio"), F.concat(F.lit("root"), "id").alias("root"))
    every = docs.select("source").distinct().crossJoin(F.broadcast(roots))  # 14 rows
    own = docs.select("source", F.concat(F.lit("root"), "k").alias("root"))
    there = every.join(own.distinct(), ["source", "root"], "left_semi")
    return readers.resolve_source(there, own)


@query("s13_tasks", "SELECT cast(conv_id * 100 + turn AS varchar) AS id, text AS goal FROM conversations UNION ALL SELECT DISTINCT 'all of ' || conv_id, '{\"is\":\"it\"}' FROM conversations")
def _(table):
    """Each conversation as an object with others at two depths; those without a goal don't count."""
    turn = F.struct((c("conv_id") * 100 + c("turn")).alias("id"), c("text").alias("goal"), F.array(F.struct(c("role").alias("id"))).alias("by"))
    rows = table("conversations").groupBy("conv_id").agg(F.collect_list(turn).alias("turns"))
    whole = F.struct(F.concat(F.lit("all of "), "conv_id").alias("id"), F.struct(F.lit("it").alias("is")).alias("goal"), F.struct("turns").alias("in"))
    return readers.explode_tasks(rows.select(F.to_json(F.struct(F.array(whole).alias("tasks"))).alias("value")), ["id", "goal"])


@query("j5_with_meta", "SELECT '/a/' || l.doc_id || '.wav' AS path, '/a/' || l.doc_id || '_meta.json' AS meta_path FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def _(table):
    name = lambda end: F.concat(F.lit("/a/"), "doc_id", F.lit(end)).alias("path")
    return corpus.with_meta(table("documents").select(name(".wav")), table("labels").select(name("_meta.json"))).select("path", "meta_path")


@query("j6_sides_with_segments", """SELECT cast(user_id AS varchar) AS pin, lpad(cast(user_id AS varchar), 5, '0') AS call_id, 'A' AS channel, event_id AS start FROM events WHERE event_type = 'click'""")
def _(table):
    e = table("events")
    call = F.lpad(c("user_id").cast("string"), 5, "0")
    sides = e.select(c("user_id").cast("string").alias("pin"), F.concat(call, F.lit("_A/x;none")).alias("side_data")).distinct()
    segments = e.select(call.alias("call_id"), F.when(c("event_type") == "click", "A").otherwise("B").alias("channel"), c("event_id").alias("start"))
    return speakers.sides_with_segments(sides, segments)


@query("k1_manifests", "SELECT path, source, duration, CASE WHEN source = 'src1' THEN 'eval' ELSE 'train' END AS split FROM manifest UNION ALL SELECT path, source, duration, 'combined' FROM manifest", "manifest")
def _(m):
    spark, out = m.sparkSession, scratch(m.sparkSession, "manifests")
    sinks.write_manifests(m.withColumn("split", F.when(c("source") == "src1", "eval").otherwise("train")), out)
    one = lambda name: spark.read.parquet(f"{out}/{name}").select("path", "source", "duration", F.lit(name).alias("split"))
    return one("train").unionByName(one("eval")).unionByName(one("combined"))


@query("k2_save_docs", "SELECT d.source AS category, d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN d.lang ELSE 'checked' END AS lang, d.n_chars FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def _(table):
    """All documents are saved, then those with labels again."""
    docs = table("documents").select(c("source").alias("category"), c("doc_id").alias("id"), "lang", "n_chars")
    out = scratch(docs.sparkSession, "saved")
    sinks.save_docs(docs, out)
    sinks.save_docs(docs.join(table("labels").select(c("doc_id").alias("id")).distinct(), "id", "left_semi").withColumn("lang", F.lit("checked")), out)
    return sinks.load_docs(docs.sparkSession, out)


@query("k3_scores", "SELECT source AS setup, avg(n_chars) AS score FROM documents GROUP BY source")
def _(table):
    docs = table("documents")
    out = scratch(docs.sparkSession, "scores")
    sinks.write_scores(docs.groupBy(c("source").alias("setup")).agg(F.avg("n_chars").alias("score")), out)
    return docs.sparkSession.read.schema("setup string, score double").option("header", True).csv(out)


@query("k4_filtered", "SELECT path, duration FROM manifest WHERE duration >= 40", "manifest")
def _(m):
    out = scratch(m.sparkSession, "filtered")
    sinks.write_filtered(m, "duration >= 40", ["path", "duration"], out)
    return m.sparkSession.read.schema("path string, duration double").json(out)


@query("x1_append_batches", "SELECT d.doc_id, d.source, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END AS batch FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def _(table):
    """A batch with all labelled documents, the same batch again with others, and one with all documents."""
    docs = table("documents").select("doc_id", "source")
    ledger = KeyedTable(docs.sparkSession, scratch(docs.sparkSession, "ledger"), ["doc_id"])
    labelled = docs.join(table("labels").select("doc_id"), "doc_id", "left_semi")
    for rows, number in ((labelled, 0), (docs, 0), (docs, 1)):
        ledger.append(rows.withColumn("batch", F.lit(number)), "run", number)
    return ledger.read()


@query("u1_apply_model", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN cast(length(text) AS varchar) ELSE 'known' END AS answer FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def _(table):
    """The length of each text, but where an answer is there already."""
    known = table("labels").select("doc_id").distinct().withColumn("answer", F.lit("known"))
    rows = table("documents").select("doc_id", "text").join(known, "doc_id", "left")
    return apply_model(rows, lambda batch: [str(len(t)) for t in batch["text"]], "answer").select("doc_id", "answer")


@query("u2_score_splits", "SELECT lang AS split, CASE WHEN lang = 'en' THEN avg(n_chars) WHEN lang = 'de' THEN max(n_chars) END::double AS score FROM documents WHERE lang IN ('en', 'de', 'fr') GROUP BY lang")
def _(table):
    records = table("documents").select(c("lang").alias("split"), "n_chars")
    by = lambda how: lambda df: df.groupBy("split").agg(how.alias("score"))
    return scoring.score_splits(records, {"en": by(F.avg("n_chars")), "de": by(F.max("n_chars")), "fr": lambda df: df.select("no_such_column")})


@query("w7_chunks", f"""WITH RECURSIVE {TIMELINE}, ends AS (SELECT conv_id, max("end") + 1 AS total FROM tl GROUP BY conv_id),
u AS (SELECT conv_id, turn, "end" AS e, lead("end") OVER (PARTITION BY conv_id ORDER BY turn) AS following, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM tl WHERE role = 'user'),
walk AS (SELECT conv_id, 0::bigint AS i, 0.0::double AS at, 0.0::double AS began, -1::bigint AS after, -1::bigint AS upto, -1::bigint AS last, false AS closes FROM ends UNION ALL
  SELECT w.conv_id, u.i, CASE WHEN k THEN least(u.e + 0.2, total) ELSE w.at END, w.at, w.last, u.turn, CASE WHEN k THEN u.turn ELSE w.last END, k
  FROM walk w JOIN u ON u.conv_id = w.conv_id AND u.i = w.i + 1 JOIN ends n ON n.conv_id = w.conv_id CROSS JOIN LATERAL (SELECT (u.e - w.at >= 40.0 * 0.8 OR u.following IS NULL OR u.following - w.at > 40.0) AND u.e - w.at >= 10 AS k) x),
chunks AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1 AS chunk, count(*) OVER (PARTITION BY conv_id) AS "of" FROM walk WHERE closes)
SELECT h.conv_id, chunk::int AS chunk, "of"::int AS "of", any_value(h.at - began) AS duration, CASE WHEN chunk = 0 THEN 5.7::double ELSE 0 END AS prompt_end, count(*) FILTER (start - began >= 0 AND "end" > start) AS turns, min(start - began) FILTER (start - began >= 0 AND "end" > start) AS first_start, max("end" - began) FILTER (start - began >= 0 AND "end" > start) AS last_end
FROM chunks h JOIN tl ON tl.conv_id = h.conv_id AND tl.turn > h.after AND tl.turn <= h.upto GROUP BY h.conv_id, chunk, "of\"""", "turns")
def _(turns):
    line = corpus.plan_timeline(turns)
    prompts = line.groupBy("conv_id").agg(F.lit(5.7).alias("prompt_end"), (F.max("end") + 1).alias("total"))
    cut = corpus.split_conversations(line, prompts, longest=40.0)
    times = lambda name, pick: pick(F.transform("turns", lambda t: t[name])).alias("first_start" if name == "start" else "last_end")
    return cut.select("conv_id", "chunk", "of", "duration", "prompt_end", F.size("turns").alias("turns"), times("start", F.array_min), times("end", F.array_max))


@query("s9_audio_frames", """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, floor(value * 6) / 32768 AS x FROM events)
SELECT user_id, 0 AS channel, cast(idx // 30 AS int) AS frame_idx, sqrt(avg(x * x)) AS rms, count(*) AS n, count(*) FILTER (abs(x) < 0.01) AS n_quiet FROM s GROUP BY user_id, idx // 30""")
def _(table):
    """Each user's values as a sound of their own, read back by ranges of two frames."""
    e = table("events")
    out = scratch(e.sparkSession, "audio")
    audio.write_audio(e.select(c("user_id").cast("string").alias("name"), c("event_id").alias("idx"), F.floor(c("value") * 6).cast("int").alias("value")), out, 1000)
    found = audio.audio_frames(e.sparkSession, out, 30, range_bytes=120)
    return found.select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("user_id"), "channel", "frame_idx", "rms", "n", "n_quiet")


@query("x2_live_utterances", UTT + " SELECT sample_id, min(start) AS start, max(\"end\") AS \"end\", count(*) AS n_words, string_agg(word, ' ' ORDER BY start, idx) AS text FROM g GROUP BY sample_id, utt", "words")
def _(words):
    """The stream's operator on all words at once."""
    return live_utterances(words.withColumn("ts", F.timestamp_millis((c("start") * 1000).cast("long"))))
