"""Registered queries of the conversation operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions import text as X
from turnweave.functions.seeding import triangular, uniform
from turnweave.functions.brackets import object_with_key
from turnweave.operators import corpus, frames, judged, prompts, sampling, scoring, speakers, stats, timing
from turnweave.plans.training_set import training_set
from turnweave.sources import readers
from turnweave.views import t, u_sql, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(name: str, sql: str | None, *views: str) -> Callable:
    """Registers a function of (view..., or spark and folder if none) under ``name``."""

    def register(fn: Callable) -> Callable:
        def run(spark: SparkSession, d: str) -> DataFrame:
            return fn(*(view(spark, d, v) for v in views)) if views else fn(lambda table: t(spark, d, table))

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql, *views) if views else sql
        return fn

    return register


CAP = "SELECT source, CASE WHEN source IN ('src0', 'src1') THEN 0.25 WHEN source = 'src2' THEN 1.0 END AS max_hours FROM (SELECT DISTINCT source FROM documents)"


def caps(manifest: DataFrame) -> DataFrame:
    return manifest.select("source").distinct().withColumn("max_hours", F.when(c("source").isin("src0", "src1"), 0.25).when(c("source") == "src2", 1.0))


CAPPED = f"""caps AS ({CAP}), ordered AS (SELECT m.*, caps.max_hours, sum(duration) OVER (PARTITION BY m.source ORDER BY {u_sql(42, 'path')}, path ROWS UNBOUNDED PRECEDING) AS run FROM manifest m JOIN caps ON m.source = caps.source),
capped AS (SELECT path, source, duration FROM ordered WHERE max_hours IS NULL OR run <= max_hours * 3600)"""


@query("w8_cap_hours", f"WITH {CAPPED} SELECT * FROM capped", "manifest")
def _(m):
    return corpus.cap_hours(m, caps(m))


@query("a1_dataset_stats", f"WITH {CAPPED} SELECT coalesce(source, 'TOTAL') AS dataset, count(*) AS entries, sum(duration) / 3600 AS hours FROM capped GROUP BY ROLLUP (source)", "manifest")
def _(m):
    return corpus.dataset_stats(corpus.cap_hours(m, caps(m)), m.select("source").distinct())


@query("w9_train_eval_split", f"SELECT path, source, CASE WHEN row_number() OVER (ORDER BY {u_sql(42, 'path')}, path) <= least(500, greatest(1, count(*) OVER () // 2)) THEN 'eval' ELSE 'train' END AS split FROM manifest", "manifest")
def _(m):
    return corpus.train_eval_split(m).select("path", "source", "split")


@query(
    "training_set",
    f"""WITH {CAPPED}, split AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {u_sql(42, 'path')}, path) <= least(500, greatest(1, count(*) OVER () // 2)) THEN 'eval' ELSE 'train' END AS split FROM capped)
SELECT split, coalesce(source, 'TOTAL') AS dataset, count(*) AS entries, sum(duration) / 3600 AS hours FROM split GROUP BY split, ROLLUP (source)""",
    "manifest",
)
def _(m):
    return training_set(m, caps(m))


@query("a13_threshold_report", "SELECT count(*) FILTER (duration >= 100) AS kept, count(*) FILTER (duration < 100) AS removed, sum(duration) FILTER (duration >= 100) / 3600 AS kept_hours, sum(duration) FILTER (duration < 100) / 3600 AS removed_hours FROM manifest", "manifest")
def _(m):
    return corpus.threshold_report(m, "duration", 100)


@query("a25_training_steps", f"WITH h AS (SELECT source, sum(duration) / 3600 AS total FROM manifest GROUP BY source), j AS (SELECT sum(least(total, coalesce(max_hours, total))) AS hours FROM h JOIN ({CAP}) k ON h.source = k.source) SELECT hours, cast(ceil(hours * 3600 / 163.84 / 96) AS bigint) AS steps_per_epoch, cast(ceil(hours * 3600 / 163.84 / 96) AS bigint) * 15 AS total_steps FROM j", "manifest")
def _(m):
    d = m.groupBy("source").agg((F.sum("duration") / 3600).alias("total_hours")).join(caps(m), "source").withColumn("enabled", F.lit(True))
    return corpus.training_steps(d, 96, 163.84, 15)


@query("o2_seeded_sample", f"SELECT path, source FROM manifest ORDER BY {u_sql(7, 'path')}, path LIMIT 100", "manifest")
def _(m):
    return corpus.seeded_sample(m, 100, 7, "path").select("path", "source")


@query("o1_seeded_order", f"SELECT path, source, {u_sql(42, 'path')} AS u FROM manifest", "manifest")
def _(m):
    return corpus.seeded_order(m, 42, "path").select("path", "source", uniform(42, "path").alias("u"))


@query("o3_top_values", "SELECT source, count(*) AS n FROM manifest GROUP BY source ORDER BY n DESC, source LIMIT 10", "manifest")
def _(m):
    return speakers.top_values(m, "source", 10)


@query("j4_pending", "SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(table):
    return corpus.pending(table("documents").select("doc_id", "source"), table("labels"), "doc_id")


@query("o5_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(table):
    return corpus.only_in(table("documents"), table("labels"), "doc_id")


@query("o4_merge_datasets", f"""WITH two AS (SELECT path, source, duration, NULL AS lang FROM manifest UNION ALL SELECT 'more/' || cast(doc_id AS varchar), source, n_chars / 15.0::double, lang FROM documents WHERE lang = 'en'), caps AS ({CAP}),
ordered AS (SELECT two.*, max_hours, sum(duration) OVER (PARTITION BY two.source ORDER BY {u_sql(42, 'path')}, path ROWS UNBOUNDED PRECEDING) AS run FROM two JOIN caps ON two.source = caps.source) SELECT path, source, duration, lang FROM ordered WHERE max_hours IS NULL OR run <= max_hours * 3600""".replace("manifest", "(SELECT cast(doc_id AS varchar) AS path, source, n_chars / 15.0::double AS duration FROM documents)"))
def _(table):
    d = table("documents")
    m = d.select(c("doc_id").cast("string").alias("path"), "source", (c("n_chars") / F.lit(15.0)).alias("duration"))
    more = d.where("lang = 'en'").select(X.rebase_path(c("doc_id").cast("string"), "more").alias("path"), "source", (c("n_chars") / F.lit(15.0)).alias("duration"), "lang")
    return corpus.merge_datasets([m, more], caps(m))


@query("t_prompts", "SELECT conv_id, turn, '<system> ' || trim(text) || ' <system>' AS wrapped, trim(text) AS unwrapped FROM conversations WHERE role = 'system'")
def _(table):
    rows = table("conversations").where("role = 'system'")
    return rows.select("conv_id", "turn", X.wrap_prompt(c("text")).alias("wrapped"), X.unwrap_prompt(X.wrap_prompt(c("text"))).alias("unwrapped"))


@query("t3_drop_directions", "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text || ' (Laughs) so', '\\s*\\((?:laughs?|sighs?)\\)\\s*', ' ', 'gi'), '\\s+', ' ', 'g')) AS spoken FROM turns", "turns")
def _(turns):
    return turns.select("conv_id", "turn", X.drop_directions(F.concat(c("text"), F.lit(" (Laughs) so"))).alias("spoken"))


@query("t4_short_style", "SELECT doc_id, CASE WHEN len(p) <= 3 THEN s ELSE array_to_string(p[1:3], ', ') END AS style FROM (SELECT doc_id, s, list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: x <> '') AS p FROM (SELECT doc_id, text AS s FROM documents) WHERE s <> '')")
def _(table):
    return table("documents").select("doc_id", c("text").alias("s")).where("s <> ''").select("doc_id", X.short_style(c("s")).alias("style"))


ANSWER = "trim(regexp_replace(translate(lower({0}), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '\\s+', ' ', 'g'))"


@query("t5_t6_answers", f"WITH n AS (SELECT conv_id, turn, {ANSWER.format('text')} AS p, {ANSWER.format('substr(text, 1, 12)')} AS a FROM turns) SELECT conv_id, turn, p AS normal, p <> '' AND a <> '' AND contains(' ' || p || ' ', ' ' || a || ' ') AS matches FROM n", "turns")
def _(turns):
    return turns.select("conv_id", "turn", X.normal_answer(c("text")).alias("normal"), X.answer_matches(c("text"), F.substring("text", 1, 12)).alias("matches"))


@query("t7_demographics", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'male' WHEN c_custkey % 4 = 1 THEN 'female' WHEN c_custkey % 4 = 2 THEN 'other' END AS gender,
CASE WHEN a < 13 THEN NULL WHEN a < 20 THEN 'teens' WHEN a < 30 THEN 'twenties' WHEN a < 40 THEN 'thirties' WHEN a < 50 THEN 'forties' WHEN a < 60 THEN 'fifties' WHEN a < 70 THEN 'sixties' WHEN a < 80 THEN 'seventies' WHEN a < 90 THEN 'eighties' ELSE 'nineties' END AS age,
CASE c_nationkey % 3 WHEN 0 THEN 'american' WHEN 1 THEN 'other' END AS accent FROM (SELECT *, c_custkey % 100 AS a FROM customer)""")
def _(table):
    k = c("c_custkey") % 4
    raw = F.when(k == 0, " M").when(k == 1, "Female_feminine").when(k == 2, "other_gender").otherwise("?")
    accent = F.when(c("c_nationkey") % 3 == 0, "A").when(c("c_nationkey") % 3 == 1, " o").otherwise("x")
    return table("customer").select("c_custkey", X.normal_gender(raw).alias("gender"), X.age_decade(c("c_custkey") % 100).alias("age"), X.normal_accent(accent).alias("accent"))


@query("t9_keys", "SELECT doc_id, source || '__' || doc_id AS split_key, source || '_' || lpad(cast(doc_id AS varchar), greatest(5, length(cast(doc_id AS varchar)))::int, '0') AS slot_key, source || '_chunk' || lpad(cast(doc_id % 100 AS varchar), 2, '0') AS chunk_key FROM documents")
def _(table):
    return table("documents").select("doc_id", X.split_key(c("source"), F.lit(None), c("doc_id")).alias("split_key"), X.slot_key(c("source"), c("doc_id")).alias("slot_key"), X.chunk_key(c("source"), c("doc_id") % 100, F.lit(2)).alias("chunk_key"))


@query("t11_source_label", "SELECT doc_id, CASE WHEN contains(p, 'src11') THEN 'src11' WHEN contains(p, 'src10') THEN 'src10' WHEN contains(p, 'src1') THEN 'src1' WHEN contains(p, 'src2') THEN 'src2' ELSE 'unknown' END AS label FROM (SELECT doc_id, '/data/' || source || '/' || doc_id AS p FROM documents)")
def _(table):
    path = F.concat(F.lit("/data/"), c("source"), F.lit("/"), c("doc_id"))
    return table("documents").select("doc_id", X.source_label(path, ["src1", "src2", "src10", "src11"]).alias("label"))


@query("t12_usable_voice", "SELECT path, speaker FROM clips WHERE length(trim(text)) >= 5 AND duration BETWEEN 3 AND 15", "clips")
def _(clips):
    return clips.where(X.usable_voice(c("speaker"), c("path"), c("text"), c("duration"), 3, 15)).select("path", "speaker")


@query("t13_clean_text", "SELECT path FROM clips WHERE trim(text) <> '' AND NOT regexp_matches(text, '\\[[^\\]]*\\]') AND NOT contains(text, '((')", "clips")
def _(clips):
    return clips.where(X.clean_text(c("text"))).select("path")


@query("t14_bad_transcription", "SELECT page_id, html IS NULL OR trim(html) = '' OR starts_with(ltrim(substr(html, 3)), '{') AS bad FROM pages")
def _(table):
    return table("pages").select("page_id", (X.bad_transcription(c("html")) | X.bad_transcription(F.concat(F.substr("html", F.lit(3)), F.lit("x")))).alias("bad"))


@query("t14_clear_bad", "WITH b AS (SELECT *, page_id % 3 = 0 OR trim(html) = '' OR starts_with(ltrim(html), '{') AS stale FROM pages) SELECT page_id, CASE WHEN NOT stale THEN html END AS transcription, CASE WHEN html IS NULL OR NOT stale THEN page_id % 7 END AS score, html IS NULL OR stale AS pending FROM b")
def _(table):
    """A third of the transcriptions look like objects; those that are missing keep the score that they have."""
    pages = table("pages")
    shown = F.when(c("page_id") % 3 == 0, F.concat(F.lit(" {"), "html")).otherwise(c("html"))
    return scoring.clear_bad(pages.select("page_id", shown.alias("transcription"), (c("page_id") % 7).alias("score")))


@query("t15_mask_sentinel", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"nullif(l_discount::double, 0) AS {m}" for m in ("wpm", "speech_dur_s", "mean_pitch", "std_pitch", "std_intensity")) + ", l_discount::double AS speech_rate, CASE WHEN l_quantity < 19 THEN (-l_quantity * 10)::double END AS mean_intensity, (-l_quantity * 10)::double AS max_intensity FROM lineitem")
def _(table):
    zero = [X.mask_sentinel(F.lit(m), c("l_discount").cast("double")).alias(m) for m in ("wpm", "speech_dur_s", "mean_pitch", "std_pitch", "std_intensity", "speech_rate")]
    low = [X.mask_sentinel(F.lit(m), (-c("l_quantity") * 10).cast("double")).alias(m) for m in ("mean_intensity", "max_intensity")]
    return table("lineitem").select("l_orderkey", "l_linenumber", *zero, *low)


@query("t16_time_seconds", "SELECT event_id, (event_id % 60) * 60.0::double + event_id % 59 + 0.5 AS ms, (event_id % 3) * 3600.0::double + (event_id % 60) * 60 + event_id % 59 AS hms FROM events")
def _(table):
    k = c("event_id")
    ms = F.concat(F.lit('"'), k % 60, F.lit(":"), (k % 59).cast("string"), F.lit('.5"'))
    return table("events").select("event_id", X.time_seconds(ms).alias("ms"), X.time_seconds(F.concat_ws(":", k % 3, k % 60, k % 59)).alias("hms"))


@query("t17_loss_frames", "WITH n AS (SELECT conv_id, turn, duration FROM turns), f AS (SELECT conv_id * 100 + turn AS id, unnest(generate_series(0, cast(floor(duration * 12.5) AS bigint) - 1)) AS frame FROM n WHERE floor(duration * 12.5) > 0) SELECT id, count(*) AS frames, count(*) FILTER (frame >= 12) AS in_loss FROM f GROUP BY id", "turns")
def _(turns):
    chunks = turns.select((c("conv_id") * 100 + c("turn")).alias("id"), F.lit(0.0).alias("start"), "duration", F.lit(1.0).alias("prompt_end"))
    return corpus.loss_frames(chunks).groupBy("id").agg(F.count(F.lit(1)).alias("frames"), F.count_if("in_loss").alias("in_loss"))


@query("t18_join_tokens", "SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, ' '), lambda x: x), lambda x: NOT starts_with(x, 'a') ), '') AS joined FROM turns", "turns")
def _(turns):
    tokens = F.transform(F.split("text", " "), lambda w: F.when(w.startswith("a"), F.concat(F.lit("["), w)).otherwise(w))
    return turns.select("conv_id", "turn", X.join_tokens(tokens).alias("joined"))


@query("t20_snippet", "SELECT conv_id, turn, array_to_string((list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> ''))[1:50], ' ') AS snippet FROM turns", "turns")
def _(turns):
    return turns.select("conv_id", "turn", X.snippet(F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")).alias("snippet"))


@query("t21_word_lines", "SELECT sample_id, string_agg(printf('[%.2f, %.2f]: %s', start, \"end\", word), chr(10) ORDER BY idx) AS lines FROM words GROUP BY sample_id", "words")
def _(words):
    return timing.word_lines(words)


@query("t26_length_ratio", "WITH r AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN text || text || text ELSE substr(text, length(text) // 4 * 3 + 1) END AS rewrite FROM documents) SELECT doc_id, length(rewrite) BETWEEN length(text) * 0.3 AND length(text) * 2.5 AS ok FROM r")
def _(table):
    k, text = c("doc_id") % 3, c("text")
    rewrite = F.when(k == 0, text).when(k == 1, F.concat(text, text, text)).otherwise(F.substr(text, (F.floor(F.length(text) / 4) * 3 + 1).cast("int")))
    return table("documents").select("doc_id", X.length_ratio_ok(rewrite, text).alias("ok"))


@query("t27_verdicts", "SELECT doc_id, CASE WHEN quality = 1 THEN 'CORRECT' WHEN toxic = 1 THEN 'ERROR' ELSE 'INCORRECT' END AS verdict FROM labels")
def _(table):
    raw = F.when(c("quality") == 1, " correct").when(c("toxic") == 1, "maybe").otherwise("Incorrect ")
    return table("labels").select("doc_id", X.normal_verdict(raw).alias("verdict"))


UTT = 'WITH f AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY sample_id ORDER BY start, idx) <= 1.2 THEN 0 ELSE 1 END AS brk FROM words), g AS (SELECT *, sum(brk) OVER (PARTITION BY sample_id ORDER BY start, idx) AS utt FROM f)'


@query("w1_utterances", UTT + " SELECT sample_id, cast(utt AS bigint) AS utt, min(start) AS start, max(\"end\") AS \"end\", count(*) AS n_words, string_agg(word, ' ' ORDER BY start, idx) AS text FROM g GROUP BY sample_id, utt", "words")
def _(words):
    return timing.utterances(words)


@query("w2_dialogue", """WITH w AS (SELECT sample_id // 100 AS sample_id, CASE WHEN (sample_id % 100) % 2 = 0 THEN 'A' ELSE 'B' END AS channel, (sample_id % 100) * 1000 + idx AS idx, word, start + (sample_id % 100) * 20 AS start, "end" + (sample_id % 100) * 20 AS "end" FROM words),
k AS (SELECT * FROM w WHERE "end" <= 120), f AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY sample_id, channel ORDER BY start, idx) <= 1.2 THEN 0 ELSE 1 END AS brk FROM k), g AS (SELECT *, sum(brk) OVER (PARTITION BY sample_id, channel ORDER BY start, idx) AS utt FROM f),
u AS (SELECT sample_id, channel, utt, min(start) AS start, max("end") AS "end", count(*) AS n_words, string_agg(word, ' ' ORDER BY start, idx) AS text FROM g GROUP BY sample_id, channel, utt) SELECT sample_id, channel, start, "end", n_words, text, row_number() OVER (PARTITION BY sample_id ORDER BY start, channel, utt) AS pos FROM u""", "words")
def _(words):
    turn = c("sample_id") % 100
    w = words.select(F.floor(c("sample_id") / 100).alias("sample_id"), F.when(turn % 2 == 0, "A").otherwise("B").alias("channel"), (turn * 1000 + c("idx")).alias("idx"), "word", (c("start") + turn * 20).alias("start"), (c("end") + turn * 20).alias("end"))
    return timing.dialogue(w)


@query("w3_merge_segments", 'WITH f AS (SELECT *, CASE WHEN start - max("end") OVER (PARTITION BY sample_id, channel ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0.6 THEN 0 ELSE 1 END AS brk FROM segments), g AS (SELECT *, sum(brk) OVER (PARTITION BY sample_id, channel ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT sample_id, channel, min(start) AS start, max("end") AS "end", count(*) AS n FROM g GROUP BY sample_id, channel, run', "segments")
def _(segments):
    return timing.merge_segments(segments, 0.6)


@query("w14_pad_segments", 'SELECT sample_id, channel, start, "end", coalesce(greatest(lag("end") OVER (PARTITION BY sample_id, channel ORDER BY start, "end") + 0.1, start - 0.1), greatest(0, start - 0.1)) AS padded_start, "end" + 0.1 AS padded_end FROM segments', "segments")
def _(segments):
    return timing.pad_segments(segments, 0.1)


PAIRS = "u AS (SELECT sample_id, start AS us, \"end\" AS ue FROM segments WHERE channel = 'user' AND \"end\" > start), m AS (SELECT sample_id, start AS ms, \"end\" AS me FROM segments WHERE channel = 'model' AND \"end\" > start), o AS (SELECT u.sample_id, greatest(us, ms) AS start, least(ue, me) AS \"end\" FROM u JOIN m ON u.sample_id = m.sample_id AND us < me AND ms < ue)"


@query("j7_overlaps", f'WITH {PAIRS} SELECT sample_id, start, "end" FROM o QUALIFY row_number() OVER (PARTITION BY sample_id, round("end" * 1000) ORDER BY start DESC, "end") = 1', "segments")
def _(segments):
    return timing.overlaps(segments)


@query("j8_response_gaps", "WITH u AS (SELECT sample_id, \"end\" AS ue FROM segments WHERE channel = 'user'), m AS (SELECT sample_id, start AS ms FROM segments WHERE channel = 'model'), p AS (SELECT u.sample_id, ue, min(ms) AS ms FROM u JOIN m ON u.sample_id = m.sample_id AND ms > ue GROUP BY u.sample_id, ue) SELECT sample_id, cast(round(ms * 1000) AS bigint) AS start_ms, max(ue) AS user_end, max_by(ms, ue) AS model_start FROM p GROUP BY sample_id, round(ms * 1000)", "segments")
def _(segments):
    return timing.response_gaps(segments)


@query("j9_has_overlap", f"WITH {PAIRS} SELECT s.sample_id, s.sample_id IN (SELECT sample_id FROM o) AS overlap FROM (SELECT DISTINCT sample_id FROM segments) s", "segments")
def _(segments):
    return timing.has_overlap(segments)


SEGS = "s AS (SELECT sample_id, min(start) + 2 * k AS ss, min(start) + 2 * k + 1.5 AS se FROM words, (SELECT unnest([0, 1, 2]) AS k) GROUP BY sample_id, k)"


def few_segments(words: DataFrame) -> DataFrame:
    k = words.groupBy("sample_id").agg(F.min("start").alias("at")).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return k.select("sample_id", (c("at") + 2 * c("k")).alias("start"), (c("at") + 2 * c("k") + 1.5).alias("end"))


@query("j10_words_in_segments", f'WITH {SEGS} SELECT DISTINCT w.sample_id, ss, se, idx FROM words w JOIN s ON w.sample_id = s.sample_id AND ((start >= ss AND "end" <= se) OR (start <= se AND "end" > se) OR (start <= ss AND "end" > ss))', "words")
def _(words):
    return timing.words_in_segments(words, few_segments(words))


@query("a8_backchannels", f"""WITH {SEGS}, n AS (SELECT s.sample_id, ss, se, count(w.idx) AS n FROM s LEFT JOIN words w ON w.sample_id = s.sample_id AND ((start >= ss AND "end" <= se) OR (start <= se AND "end" > se) OR (start <= ss AND "end" > ss)) GROUP BY s.sample_id, ss, se)
SELECT sample_id, count(*) AS n_backchannels, max_by(CASE WHEN n > 3 THEN 1 WHEN se - ss < 1 AND n <= 2 THEN 0 ELSE 1 END, ss) AS turn_flag FROM n GROUP BY sample_id""", "words")
def _(words):
    return timing.backchannels(few_segments(words), words)


TAKE = "k AS (SELECT sample_id, count(*) AS n, min_by(start, idx) AS first_start, max_by(\"end\", idx) AS last FROM words GROUP BY sample_id), v AS (SELECT sample_id, CASE WHEN last - first_start < 1 THEN cast(n > 3 AS int) ELSE 1 END AS take_turn, first_start FROM k)"


@query("a6_take_turn", f"WITH {TAKE} SELECT * FROM v", "words")
def _(words):
    return timing.take_turn(words)


@query("a6_turn_rate", f"WITH {TAKE}, s AS (SELECT conv_id * 100 + turn AS sample_id FROM conversations) SELECT count(*) AS samples, avg(coalesce(take_turn, 0)) AS turn_rate FROM s LEFT JOIN v ON s.sample_id = v.sample_id", "words")
def _(words):
    return timing.turn_rate(words, words)


@query("a7_latency", f"WITH {TAKE} SELECT sample_id, greatest(first_start - (sample_id % 3 - 1), 0) AS latency FROM v WHERE take_turn = 1", "words")
def _(words):
    return timing.latency(words, words.select("sample_id", (c("sample_id") % 3 - 1).cast("double").alias("user_end")).distinct())


@query("a9_timing_divergence", f"""WITH {SEGS}, tot AS (SELECT DISTINCT sample_id FROM words), curve AS (SELECT sample_id, unnest([0, 1, 2, 3]) AS pos, unnest([0.1::double, 0.4, 0.3, 0.2]) AS p FROM tot), fr AS (SELECT sample_id, unnest(generate_series(0, 50)) AS bin FROM tot),
h AS (SELECT sample_id, bin, count(*) AS c FROM (SELECT sample_id, unnest(generate_series(cast(floor(ss / 0.2) AS bigint), cast(floor(se / 0.2) AS bigint))) AS bin FROM s) GROUP BY sample_id, bin),
a AS (SELECT fr.sample_id, fr.bin, c, bin * 3 / 50.0::double AS xx FROM fr LEFT JOIN h USING (sample_id, bin)), b AS (SELECT a.sample_id, c, coalesce(c, 0) + 1e-10::double AS p, lo.p + (hi.p - lo.p) * (xx - floor(xx)) AS q FROM a JOIN curve lo ON a.sample_id = lo.sample_id AND lo.pos = floor(xx) JOIN curve hi ON a.sample_id = hi.sample_id AND hi.pos = least(floor(xx) + 1, 3)),
n AS (SELECT sample_id, c, p / sum(p) OVER (PARTITION BY sample_id) AS p, q / sum(q) OVER (PARTITION BY sample_id) AS q FROM b) SELECT sample_id, CASE WHEN max(c) IS NULL THEN 1 ELSE sqrt(greatest(sum(p * ln(p * 2 / (p + q)) + q * ln(q * 2 / (p + q))) / 2, 0)) END AS distance FROM n GROUP BY sample_id""", "words")
def _(words):
    samples = words.select("sample_id").distinct()
    curve = samples.select("sample_id", F.posexplode(F.array(*map(F.lit, (0.1, 0.4, 0.3, 0.2)))).alias("pos", "p"))
    return timing.timing_divergence(few_segments(words), curve, samples.withColumn("duration", F.lit(10.0)))


@query("a19_split_metrics", """WITH s AS (SELECT sample_id, coalesce(min(start) FILTER (start > 3 OR (start <= 3 AND 3 < "end")), max_by("end", idx)) AS split_t FROM words GROUP BY sample_id), j AS (SELECT w.*, split_t, "end" <= split_t AS pre FROM words w JOIN s USING (sample_id)),
g AS (SELECT sample_id, split_t, count(*) FILTER (pre) AS pre_n, coalesce(max("end") FILTER (pre) - min(start) FILTER (pre), 0) AS pre_span, count(*) FILTER (NOT pre) AS post_n, coalesce(max("end") FILTER (NOT pre) - min(start) FILTER (NOT pre), 0) AS post_span FROM j GROUP BY sample_id, split_t)
SELECT *, CASE WHEN pre_span > 0 THEN pre_n * 60 / pre_span ELSE 0 END AS pre_wpm, CASE WHEN post_span > 0 THEN post_n * 60 / post_span ELSE 0 END AS post_wpm FROM g""", "words")
def _(words):
    return timing.split_metrics(words, words.select("sample_id").distinct().withColumn("mark", F.lit(3.0)))


@query("a8_summary", f"""WITH {SEGS}, tot AS (SELECT DISTINCT sample_id FROM words), n AS (SELECT s.sample_id, ss, se, count(w.idx) AS n FROM s LEFT JOIN words w ON w.sample_id = s.sample_id AND ((start >= ss AND "end" <= se) OR (start <= se AND "end" > se) OR (start <= ss AND "end" > ss)) GROUP BY s.sample_id, ss, se),
f AS (SELECT sample_id, count(*) AS k, max_by(CASE WHEN n > 3 THEN 1 WHEN se - ss < 1 AND n <= 2 THEN 0 ELSE 1 END, ss) AS flag FROM n GROUP BY sample_id),
m AS (SELECT coalesce(flag, 0)::double AS flag, coalesce(k, 0) / 10.0::double AS freq FROM tot LEFT JOIN f USING (sample_id))
SELECT 'turn_flag' AS metric, avg(flag) AS mean, stddev_pop(flag) AS std, count(*) AS n FROM m UNION ALL SELECT 'frequency', avg(freq), stddev_pop(freq), count(*) FROM m UNION ALL SELECT 'distance', 1, 0, count(*) FROM m""", "words")
def _(words):
    totals = words.select("sample_id").distinct().withColumn("duration", F.lit(10.0))
    none = totals.select("sample_id", F.lit(None).cast("double").alias("distance")).where("sample_id is null")
    return timing.backchannel_summary(timing.backchannels(few_segments(words), words), none, totals)


@query("a26_benchmark_table", f"""WITH {TAKE}, k4 AS (SELECT *, sample_id % 4 AS k FROM v) SELECT 'model' AS model, avg(take_turn) FILTER (k = 0) AS pause_synthetic_turn_rate, avg(take_turn) FILTER (k = 1) AS pause_candor_turn_rate, NULL::double AS backchannel_turn_rate, NULL::double AS backchannel_frequency, NULL::double AS backchannel_distance,
avg(take_turn) FILTER (k = 2) AS smooth_turn_rate, avg(greatest(first_start - 0.5, 0)) FILTER (k = 2 AND take_turn = 1) AS smooth_latency, avg(take_turn) FILTER (k = 3) AS interruption_turn_rate, NULL::double AS interruption_rating, avg(greatest(first_start - 0.5, 0)) FILTER (k = 3 AND take_turn = 1) AS interruption_latency FROM k4""", "words")
def _(words):
    task = F.element_at(F.array(*map(F.lit, ("pause_synthetic", "pause_candor", "smooth", "interruption"))), (c("sample_id") % 4 + 1).cast("int"))
    rates = timing.take_turn(words).groupBy(task.alias("task")).agg(F.avg("take_turn").alias("value")).withColumn("measure", F.lit("turn_rate"))
    ends = words.where(c("sample_id") % 4 >= 2).select("sample_id", F.lit(0.5).alias("user_end")).distinct()
    waits = timing.latency(words, ends).groupBy(task.alias("task")).agg(F.avg("latency").alias("value")).withColumn("measure", F.lit("latency"))
    return scoring.benchmark_table(rates.unionByName(waits).withColumn("model", F.lit("model")))


@query("a26_subsets", "SELECT CASE event_type WHEN 'click' THEN 'synthetic' ELSE 'candor' END AS subset, cast(event_id AS varchar) AS sample_id, value FROM events WHERE event_type IN ('click', 'view')")
def _(table):
    named = F.when(c("event_type") == "click", "synthetic_").when(c("event_type") == "view", "candor_").otherwise("candorial_")
    return scoring.by_prefix(table("events").select(F.concat(named, "event_id").alias("sample_id"), "value"), ["synthetic", "candor"])


EV = "judged_events"
BINNED = 'b AS (SELECT *, least("end", (bin + 1) * 15) - greatest(start, bin * 15) AS ov FROM judged_events, (SELECT unnest(generate_series(0, 7)) AS bin) WHERE "end" > start AND start < (bin + 1) * 15 AND "end" > bin * 15)'


@query("a5_score_by_bin", f"WITH {BINNED} SELECT setup, bin, sum(tt * ov) / sum(ov) AS turn_score, sum(follow * ov) / sum(ov) AS follow_score, sum(ov) AS seconds FROM b WHERE ov > 0 GROUP BY setup, bin", EV)
def _(events):
    return scoring.score_by_bin(events)


@query("a5_score_table", f"WITH {BINNED} SELECT setup, " + ", ".join(f'sum(tt * ov) FILTER (bin = {i}) / sum(ov) FILTER (bin = {i}) AS "{i}_tt", sum(follow * ov) FILTER (bin = {i}) / sum(ov) FILTER (bin = {i}) AS "{i}_follow"' for i in range(8)) + " FROM b WHERE ov > 0 GROUP BY setup", EV)
def _(events):
    return scoring.score_table(events)


@query("j11_bin_overlap", f'WITH {BINNED} SELECT setup, task_id, start, "end", bin, ov AS overlap FROM b WHERE ov > 0', EV)
def _(events):
    return timing.bin_overlap(events).select("setup", "task_id", "start", "end", "bin", "overlap")


@query("a3_score_summary", """WITH e AS (SELECT setup, task_id, count(*) FILTER (tt <> 3 AND follow <> 2) AS n_events, round(avg(tt) FILTER (tt <> 3 AND follow <> 2), 3) AS turn_score, round(avg(follow) FILTER (tt <> 3 AND follow <> 2), 3) AS follow_score FROM judged_events GROUP BY setup, task_id),
k AS (SELECT setup, task_id, count(score) AS n_files, round(avg(score), 3) AS task_score FROM (SELECT DISTINCT setup, task_id, nullif(task_id % 5, 0) AS score FROM judged_events) GROUP BY setup, task_id) SELECT setup, task_id, n_files, n_events, turn_score, follow_score, task_score FROM e JOIN k USING (setup, task_id)""", EV)
def _(events):
    some = events.select("setup", "task_id", F.when(c("tt") != 3, c("tt")).alias("tt"), F.when(c("follow") != 2, c("follow")).alias("follow"))
    return scoring.score_summary(some, events.select("setup", "task_id", F.nullif(c("task_id") % 5, F.lit(0)).alias("score")).distinct())


@query("a4_per_task", "SELECT DISTINCT setup || '/' || task_id AS task, (task_id % 5)::double AS score FROM judged_events WHERE task_id % 5 <> 0", EV)
def _(events):
    return scoring.per_task(events.select(c("setup").alias("split"), "task_id", F.nullif(c("task_id") % 5, F.lit(0)).alias("score")).distinct())


@query("a4_task_scores", "SELECT setup AS split, avg(tt) AS score, count(tt) AS n, count(*) AS tasks FROM judged_events GROUP BY setup", EV)
def _(events):
    return scoring.task_scores(events.select(c("setup").alias("split"), c("tt").alias("score")))


@query("a2_accuracy", "SELECT coalesce(category, 'OVERALL') AS category, count(*) AS n, avg(cast(correct AS int)) AS accuracy FROM verdicts GROUP BY ROLLUP (category)", "verdicts")
def _(verdicts):
    return scoring.accuracy(verdicts)


@query("a24_leaderboard", """WITH r AS (SELECT category AS subset, CASE WHEN doc_id % 5 = 0 THEN 'small' ELSE 'large' END AS region, CASE WHEN category IN ('src2', 'src3') THEN 'open' ELSE 'mcq' END AS evaluator, doc_id % 7 = 0 AS mute, doc_id % 11 = 0 AS bare, (cast(correct AS int) + doc_id % 3) / 2.0::double AS v FROM verdicts),
d AS (SELECT *, mute OR (evaluator = 'open' AND bare) AS dropped FROM r), g AS (SELECT subset, region, avg(v) FILTER (NOT dropped AND NOT bare) AS v, count(*) FILTER (dropped) AS dropped FROM d GROUP BY subset, region),
b AS (SELECT subset, avg(v) * CASE subset WHEN 'src1' THEN 20 WHEN 'src2' THEN 100 ELSE 1 END AS score, sum(dropped) AS dropped FROM g GROUP BY subset) SELECT * FROM b UNION ALL SELECT 'OVERALL', avg(score), sum(dropped) FROM b""", "verdicts")
def _(verdicts):
    k = c("doc_id")
    score = F.when(k % 11 != 0, F.array(c("correct").cast("int").cast("string"), (k % 3).cast("string"), F.lit("?"))).otherwise(F.array().cast("array<string>"))
    records = verdicts.select(
        c("category").alias("subset"), F.when(k % 5 == 0, "small").otherwise("large").alias("region"), F.when(c("category").isin("src2", "src3"), "open").otherwise("mcq").alias("evaluator"),
        F.when(k % 7 != 0, "said").alias("transcription"), score.alias("score"),
    )
    return scoring.leaderboard(records, {"src1": 20.0, "src2": 100.0})


@query("a10_tag_ratios", "WITH g AS (SELECT CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS tag FROM labels UNION ALL SELECT 'any' FROM labels) SELECT tag, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 2) AS ratio FROM g GROUP BY tag")
def _(table):
    tag = F.when(c("toxic") == 1, "toxic").when(c("quality") == 1, "good").otherwise("bad")
    return scoring.tag_ratios(table("labels").select(c("doc_id").alias("sample_id"), F.array(tag, F.lit("any")).alias("behaviour")))


@query("j16_with_behaviour", "SELECT doc_id AS sample_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(table):
    tags = table("labels").select(c("doc_id").alias("sample_id"), F.array(F.when(c("toxic") == 1, "C_RESPOND").otherwise("C_RESUME")).alias("behaviour"))
    return scoring.with_behaviour(table("documents").select(c("doc_id").alias("sample_id")), tags, "C_RESPOND")


@query("j12_keep_old_scores", "SELECT d.doc_id AS unique_id, CASE WHEN d.doc_id % 2 = 0 THEN l.quality END AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(table):
    d, l = table("documents"), table("labels")
    old = d.join(l, "doc_id").select(c("doc_id").alias("unique_id"), F.when(c("doc_id") % 2 == 0, c("text")).otherwise(F.concat("text", F.lit("!"))).alias("transcription"), c("quality").alias("score"))
    return scoring.keep_old_scores(d.select(c("doc_id").alias("unique_id"), c("text").alias("transcription")), old).select("unique_id", "score")


@query("j14_merge_verdicts", "SELECT d.doc_id AS unique_id, l.quality = 1 AS correct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(table):
    v = table("labels").select(c("doc_id").alias("unique_id"), F.when(c("quality") == 1, "CORRECT").otherwise("INCORRECT").alias("verdict"))
    return scoring.merge_verdicts(table("documents").select(c("doc_id").alias("unique_id")), v).select("unique_id", "correct")


@query("j17_lookup_or_report", "SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN 'known' WHEN l.doc_id IS NOT NULL THEN 'found' END AS question, d.doc_id % 2 = 1 AND l.doc_id IS NULL AS not_found FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(table):
    rows = table("documents").select("doc_id", F.when(c("doc_id") % 2 == 0, "known").alias("question"))
    return scoring.lookup_or_report(rows, table("labels").select("doc_id", F.lit("found").alias("question")), "doc_id", "question")


@query("a20_robust_mad", """WITH m AS (SELECT phase, metric, median(value) AS med, count(*) AS n FROM metrics GROUP BY phase, metric), d AS (SELECT x.*, med, n, abs(value - med) AS dev FROM metrics x JOIN m USING (phase, metric)), k AS (SELECT phase, metric, median(dev) AS mad FROM d GROUP BY phase, metric)
SELECT phase, metric, avg(value) AS mean, count(*) AS n FROM d JOIN k USING (phase, metric) WHERE n < 3 OR mad <= 0 OR dev / (mad * 1.4826) <= 1.5 GROUP BY phase, metric""", "metrics")
def _(metrics):
    return stats.robust_mean(metrics, "mad", k=1.5)


QS = "q AS (SELECT phase, metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi, avg(value) AS mu, stddev_samp(value) AS sd FROM metrics GROUP BY phase, metric)"


@query("a20_robust_iqr", f"WITH {QS} SELECT phase, metric, avg(value) AS mean, count(*) AS n FROM metrics JOIN q USING (phase, metric) WHERE value BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1) GROUP BY phase, metric", "metrics")
def _(metrics):
    return stats.robust_mean(metrics, "iqr", k=0.5)


@query("a20_robust_zscore", f"WITH {QS} SELECT phase, metric, avg(value) AS mean, count(*) AS n FROM metrics JOIN q USING (phase, metric) WHERE abs((value - mu) / sd) <= 1.5 GROUP BY phase, metric", "metrics")
def _(metrics):
    return stats.robust_mean(metrics, "zscore", k=1.5)


@query("a20_robust_winsor", f"WITH {QS} SELECT phase, metric, avg(least(greatest(value, lo), hi)) AS mean, count(*) AS n FROM metrics JOIN q USING (phase, metric) GROUP BY phase, metric", "metrics")
def _(metrics):
    return stats.robust_mean(metrics, "winsor")


@query("a20_robust_trim", f"WITH {QS} SELECT phase, metric, avg(value) AS mean, count(*) AS n FROM metrics JOIN q USING (phase, metric) WHERE value BETWEEN lo AND hi GROUP BY phase, metric", "metrics")
def _(metrics):
    return stats.robust_mean(metrics, "trim")


WIDE = """one AS (SELECT l_orderkey AS sample_id, 'price' AS metric, l_linenumber % 3 AS k, l_extendedprice::double AS value FROM lineitem), w AS (SELECT sample_id, metric, max(value) FILTER (k = 1) AS pre, max(value) FILTER (k = 2) AS post, max(value) FILTER (k = 0) AS clean FROM one GROUP BY sample_id, metric),
p AS (SELECT metric, 'pre_post' AS pair, pre AS b, post AS a FROM w UNION ALL SELECT metric, 'clean_post', clean, post FROM w), g AS (SELECT metric, pair, count(*) AS n_raw, count(a - b) AS n_valid, count(a - b) AS n_used, avg(b) FILTER (a - b IS NOT NULL) AS mean_before, avg(a) FILTER (a - b IS NOT NULL) AS mean_after, avg(a - b) AS mean_diff, stddev_samp(a - b) AS sd FROM p GROUP BY metric, pair)"""


def price_metrics(table: Callable) -> DataFrame:
    phase = F.element_at(F.array(*map(F.lit, ("clean", "pre", "post"))), c("l_linenumber") % 3 + 1)
    return table("lineitem").select(c("l_orderkey").alias("sample_id"), phase.alias("phase"), F.lit("price").alias("metric"), c("l_extendedprice").cast("double").alias("value"))


@query("a21_paired_test", f"WITH {WIDE} SELECT *, n_used - 1 AS df, mean_diff / (sd / sqrt(n_used)) AS t, mean_diff / sd AS d_z FROM g")
def _(table):
    return stats.paired_test(price_metrics(table), None).drop("p", "ci_low", "ci_high")


@query("a21_trim_both", f"""WITH {WIDE.rpartition(", g AS")[0]}, v AS (SELECT metric, pair, b, a FROM p WHERE a - b IS NOT NULL), q AS (SELECT metric, pair, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM (SELECT metric, pair, b AS x FROM v UNION ALL SELECT metric, pair, a FROM v) GROUP BY metric, pair),
t AS (SELECT v.* FROM v JOIN q USING (metric, pair) WHERE b BETWEEN q1 - 0.6 * (q3 - q1) AND q3 + 0.6 * (q3 - q1) AND a BETWEEN q1 - 0.6 * (q3 - q1) AND q3 + 0.6 * (q3 - q1)) SELECT metric, pair, count(*) AS n_used, avg(b) AS mean_before, avg(a) AS mean_after, avg(a - b) AS mean_diff, stddev_samp(a - b) AS sd FROM t GROUP BY metric, pair""")
def _(table):
    return stats.paired_test(price_metrics(table), "iqr", 0.6, on="both").select("metric", "pair", "n_used", "mean_before", "mean_after", "mean_diff", "sd")


@query("w9_given_split", "SELECT path, source, CASE WHEN source = 'src1' THEN 'eval' ELSE 'train' END AS split FROM manifest", "manifest")
def _(m):
    return corpus.train_eval_split(m.where("source <> 'src1'").select("path", "source"), given=m.where("source = 'src1'").select("path", "source"))


@query("a21_paired_test_trimmed", None)
def _(table):
    found = stats.holm(stats.paired_test(price_metrics(table), "mad"), "p", "metric", "pair")
    return found.withColumn("conclusion", stats.conclusion())


@query("a22_holm", "WITH k AS (SELECT doc_id // 20 AS report, doc_id, (doc_id % 97 + 1) / 100.0::double AS p FROM labels), r AS (SELECT *, (count(*) OVER (PARTITION BY report) - row_number() OVER (PARTITION BY report ORDER BY p, doc_id) + 1) * p AS step FROM k) SELECT report, doc_id, p, max(least(1, step)) OVER (PARTITION BY report ORDER BY p, doc_id ROWS UNBOUNDED PRECEDING) AS p_holm FROM r")
def _(table):
    rows = table("labels").select(F.floor(c("doc_id") / 20).alias("report"), "doc_id", ((c("doc_id") % 97 + 1) / F.lit(100.0)).alias("p"))
    return stats.holm(rows, "p", "doc_id", by=("report",))


@query("a12_distribution", "SELECT count(duration) AS n, avg(duration) AS mean, median(duration) AS median, stddev_pop(duration) AS std, min(duration) AS least, max(duration) AS most FROM manifest", "manifest")
def _(m):
    return stats.distribution(m, "duration")


@query("a12_by_source", "SELECT source, count(duration) AS n, avg(duration) AS mean, median(duration) AS median, stddev_pop(duration) AS std, min(duration) AS least, max(duration) AS most, avg(cast(duration < 80 AS int)) AS share_under FROM manifest GROUP BY source", "manifest")
def _(m):
    return stats.distribution(m, "duration", ["source"], under=80)


@query("a20_quantiles", "SELECT phase, metric, count(*) AS n, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99, max(value) AS p100 FROM metrics GROUP BY phase, metric", "metrics")
def _(metrics):
    return stats.exact_quantiles(metrics, ["phase", "metric"], "value", {"p01": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0})


@query("a12_histogram", "WITH e AS (SELECT * FROM (VALUES (0, 0.0::double, 50.0::double), (1, 50, 100), (2, 100, 200), (3, 200, 1000)) AS x(bin, low, high)), h AS (SELECT bin, low, high, (SELECT count(*) FROM manifest WHERE duration >= low AND (duration < high OR (bin = 3 AND duration = high))) AS n FROM e) SELECT *, n * 100 / sum(n) OVER () AS pct, sum(n) OVER (ORDER BY bin) * 100 / sum(n) OVER () AS cum_pct FROM h", "manifest")
def _(m):
    return stats.histogram(m, "duration", [0.0, 50.0, 100.0, 200.0, 1000.0])


@query("a11_speech_activity", "WITH g AS (SELECT path, count(DISTINCT channel) AS ch, count(*) FILTER (frame_idx >= 3) AS late, avg(cast(rms > 0.01 AS int)) FILTER (frame_idx >= 3 AND channel = 0) AS s0, avg(cast(rms > 0.01 AS int)) FILTER (frame_idx >= 3 AND channel = 1) AS s1 FROM frames GROUP BY path) SELECT path, CASE WHEN ch = 2 AND late > 0 THEN s0 END AS share_0, CASE WHEN ch = 2 AND late > 0 THEN s1 END AS share_1, CASE WHEN ch <> 2 THEN 'not stereo' WHEN late = 0 THEN 'too short' END AS reason FROM g", "frames")
def _(f):
    return frames.speech_activity(f, 3)


DB = "d AS (SELECT *, 20 * log10(sqrt(rms * rms + 1e-10::double)) AS db FROM frames)"


@query("w11_cutoffs", f"WITH {DB}, l AS (SELECT path, channel, frame_idx, db, lag(db) OVER w AS last, quantile_cont(CASE WHEN frame_idx > 0 THEN db END, 0.1) OVER (PARTITION BY path, channel ORDER BY frame_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS quiet FROM d WINDOW w AS (PARTITION BY path, channel ORDER BY frame_idx)) SELECT path, channel, frame_idx, db, last FROM l WHERE db - last <= -18 AND last >= quiet + 6", "frames")
def _(f):
    return frames.cutoffs(f)


@query("w12_loudness", f"WITH {DB} SELECT path, channel, avg(db) AS mean_db, stddev_samp(db) AS std_db FROM d GROUP BY path, channel", "frames")
def _(f):
    return frames.loudness(f)


@query("w13_speech_start", "SELECT path, channel, greatest(coalesce(min(frame_idx) FILTER (rms > 0.01) - 1, 0), 0) * 0.25::double AS start FROM frames GROUP BY path, channel", "frames")
def _(f):
    return frames.speech_start(f)


@query("a15_silence_ratio", "SELECT path, sum(n_quiet) / sum(n) AS silence_ratio FROM frames GROUP BY path", "frames")
def _(f):
    return frames.silence_ratio(f)


@query("w10_best_clip", "SELECT speaker, path, duration FROM clips QUALIFY row_number() OVER (PARTITION BY speaker ORDER BY abs(duration - 10), path) = 1", "clips")
def _(clips):
    return speakers.best_clip(clips, "closest").select("speaker", "path", "duration")


@query("w10_first_in_tolerance", "SELECT speaker, path, duration FROM clips QUALIFY row_number() OVER (PARTITION BY speaker ORDER BY CASE WHEN abs(duration - 10) <= 0.02 THEN 0 ELSE abs(duration - 10) END, path) = 1", "clips")
def _(clips):
    return speakers.best_clip(clips, "first_in_tolerance", tolerance=0.02).select("speaker", "path", "duration")


@query("j1_with_durations", "SELECT d.doc_id AS path, CASE WHEN l.n > 1000 THEN l.n / 1000 ELSE l.n END AS duration FROM documents d LEFT JOIN (SELECT doc_id, doc_id * 2.0::double AS n FROM labels) l ON d.doc_id = l.doc_id")
def _(table):
    return speakers.with_durations(table("documents").select(c("doc_id").alias("path")), table("labels").select(c("doc_id").alias("path"), (c("doc_id") * F.lit(2.0)).alias("duration")))


@query("j2_with_splits", "SELECT d.doc_id AS path, CASE WHEN l.toxic = 1 THEN 'test' WHEN l.quality = 1 THEN 'dev' WHEN l.doc_id IS NOT NULL THEN 'train' END AS split FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(table):
    l = table("labels").withColumnRenamed("doc_id", "path")
    return speakers.with_splits(table("documents").select(c("doc_id").alias("path")), [("train", l), ("dev", l.where("quality = 1")), ("test", l.where("toxic = 1"))])


@query("j3_only_present", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(table):
    return speakers.only_present(table("documents").select("doc_id", "source"), table("labels").where("quality = 1"), "doc_id")


@query("j6_speaker_sides", "SELECT c_custkey AS pin, lpad(cast(c_custkey % 5000 AS varchar), 5, '0') AS call_id, 'A' AS channel FROM customer UNION ALL SELECT c_custkey, lpad(cast(c_nationkey AS varchar), 5, '0'), 'B' FROM customer")
def _(table):
    packed = F.concat(c("c_custkey") % 5000, F.lit("_A/f.a;"), c("c_nationkey"), F.lit("_B"))
    return speakers.speaker_sides(table("customer").select(c("c_custkey").alias("pin"), packed.alias("side_data")))


@query("a18_dedup_pool", "SELECT source AS id, path AS ref_path FROM clips_ QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 ELSE 3 END, lang, path) = 1".replace("clips_", "(SELECT source, lang, cast(doc_id AS varchar) AS path FROM documents)"))
def _(table):
    return speakers.dedup_pool(table("documents").select(c("source").alias("id"), c("lang").alias("source"), c("doc_id").cast("string").alias("ref_path")), ["en", "de"]).select("id", "ref_path")


@query("a17_pool_summary", "SELECT 'source' AS attribute, source AS value, count(*) AS n, min(duration) AS shortest, max(duration) AS longest, avg(duration) AS mean FROM pool GROUP BY source UNION ALL SELECT 'accent', accent, count(*), min(duration), max(duration), avg(duration) FROM pool GROUP BY accent UNION ALL SELECT NULL, NULL, count(*), min(duration), max(duration), avg(duration) FROM pool", "pool")
def _(pool):
    return speakers.pool_summary(pool, ["source", "accent"])


@query("j15_assign_voices", f"WITH n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM pool), cv AS (SELECT DISTINCT cast(conv_id AS varchar) AS id FROM conversations) SELECT cv.id, n.id AS user_voice FROM cv JOIN n ON n.k = cast(floor({u_sql(42, 'cv.id', chr(39) + 'user_voice' + chr(39))} * (SELECT count(*) FROM pool)) AS bigint)", "pool", "turns")
def _(pool, turns):
    return sampling.assign_voices(turns.select(c("conv_id").cast("string").alias("id")).distinct(), pool.select("id"), pool).select("id", "user_voice")


@query("g1_plan_slots", "WITH n AS (SELECT source AS category, count(*) AS n FROM documents GROUP BY source) SELECT category, slot, category || '_' || lpad(cast(slot AS varchar), 5, '0') AS id FROM (SELECT category, unnest(generate_series(0, n - 1)) AS slot FROM n)")
def _(table):
    return sampling.plan_slots(table("documents").groupBy(c("source").alias("category")).agg(F.count(F.lit(1)).alias("n")))


@query("g2_weighted_choice", f"SELECT id, CASE WHEN u < 0.2 THEN 'a' WHEN u < 0.5 THEN 'b' ELSE 'c' END AS option FROM (SELECT cast(doc_id AS varchar) AS id, {u_sql(42, 'cast(doc_id AS varchar)', chr(39) + 'mood' + chr(39))} AS u FROM documents)")
def _(table):
    d = table("documents").select(c("doc_id").cast("string").alias("id"))
    weights = d.sparkSession.createDataFrame([("a", 2.0), ("b", 3.0), ("c", 5.0)], "option string, weight double")
    return sampling.weighted_choice(d, weights, "mood")


@query("g3_data_type", f"SELECT id, category, CASE WHEN category = 'src1' THEN CASE WHEN u < 0.85 THEN 'dynamic' ELSE 'static' END ELSE CASE WHEN u < 0.25 THEN 'plain' ELSE 'standard' END END AS data_type FROM (SELECT cast(doc_id AS varchar) AS id, source AS category, {u_sql(42, 'cast(doc_id AS varchar)', chr(39) + 'data_type' + chr(39))} AS u FROM documents)")
def _(table):
    d = table("documents").select(c("doc_id").cast("string").alias("id"), c("source").alias("category"))
    own = d.sparkSession.createDataFrame([("src1", "dynamic", 0.85), ("src1", "static", 0.15)], "category string, option string, weight double")
    rest = d.sparkSession.createDataFrame([("plain", 1.0), ("standard", 3.0)], "option string, weight double")
    return sampling.data_type(d, own, rest).select("id", "category", "data_type")


@query("g4_draw_traits", f"SELECT id, trait, options[1 + cast(floor({u_sql(42, 'id', 'trait')} * len(options)) AS int)] AS value FROM (SELECT cast(doc_id AS varchar) AS id, lang FROM documents) d JOIN (SELECT lang, 'source' AS trait, list_sort(list(DISTINCT source)) AS options FROM documents GROUP BY lang) o ON d.lang = o.lang")
def _(table):
    d = table("documents")
    taxonomy = d.select(c("lang").alias("category"), F.lit("source").alias("slot"), F.lit(None).cast("string").alias("parent"), c("source").alias("option")).distinct()
    found = sampling.draw_traits(d.select(c("doc_id").cast("string").alias("id"), c("lang").alias("category")), taxonomy)
    return found.select("id", F.explode("traits").alias("trait", "value"))


@query("g4_weighted_depth", f"""WITH RECURSIVE d AS (SELECT cast(doc_id AS varchar) AS id, lang AS category FROM documents),
tax AS (SELECT DISTINCT lang AS category, 'source' AS slot, NULL AS parent, source AS option, length(source)::double AS weight FROM documents
  UNION ALL SELECT DISTINCT lang, 'mood', source, source || m, w FROM documents, (VALUES ('/calm', 3.0::double), ('/glad', 1.0::double), ('/none', 0.0::double)) AS v(m, w)
  UNION ALL SELECT DISTINCT lang, 'tone', source || m, source || m || x, w FROM documents, (VALUES ('/calm'), ('/glad')) AS v(m), (VALUES ('/a', 1.0::double), ('/b', 2.0::double), ('/c', 5.0::double)) AS t(x, w)),
b AS (SELECT *, sum(weight) OVER (PARTITION BY category, slot, parent ORDER BY option) / sum(weight) OVER (PARTITION BY category, slot, parent) AS hi, (sum(weight) OVER (PARTITION BY category, slot, parent ORDER BY option) - weight) / sum(weight) OVER (PARTITION BY category, slot, parent) AS lo FROM tax WHERE weight > 0),
drawn AS (SELECT d.id, d.category, b.slot AS trait, b.option AS value FROM d JOIN b ON b.category = d.category AND b.parent IS NULL AND {u_sql(42, 'd.id', 'b.slot')} >= b.lo AND {u_sql(42, 'd.id', 'b.slot')} < b.hi
  UNION ALL SELECT r.id, r.category, b.slot, b.option FROM drawn r JOIN b ON b.category = r.category AND b.parent = r.value AND {u_sql(42, 'r.id', 'b.slot')} >= b.lo AND {u_sql(42, 'r.id', 'b.slot')} < b.hi)
SELECT id, trait, value FROM drawn""")
def _(table):
    """Three levels: sources by the length of their names, a mood of each source, a tone of each mood."""
    d = table("documents")
    source = d.select(c("lang").alias("category"), "source").distinct()
    rows = lambda *values: d.sparkSession.createDataFrame(values, "end string, weight double")
    tops = source.select("category", F.lit("source").alias("slot"), F.lit(None).cast("string").alias("parent"), c("source").alias("option"), F.length("source").cast("double").alias("weight"))
    moods = source.crossJoin(F.broadcast(rows(("/calm", 3.0), ("/glad", 1.0), ("/none", 0.0)))).select("category", F.lit("mood").alias("slot"), c("source").alias("parent"), F.concat("source", "end").alias("option"), "weight")
    tones = moods.where("weight > 0").select("category", c("option").alias("parent")).crossJoin(F.broadcast(rows(("/a", 1.0), ("/b", 2.0), ("/c", 5.0)))).select("category", F.lit("tone").alias("slot"), "parent", F.concat("parent", "end").alias("option"), "weight")
    found = sampling.draw_traits(d.select(c("doc_id").cast("string").alias("id"), c("lang").alias("category")), tops.unionByName(moods).unionByName(tones))
    return found.select("id", F.explode("traits").alias("trait", "value"))


@query("g5_g6_draws", f"SELECT id, cast(4 + floor({u_sql(42, 'id', chr(39) + 'turns' + chr(39))} * 5) AS int) AS turns, {u_sql(42, 'id', chr(39) + 'slip' + chr(39))} < 0.2 AS slip, CASE WHEN v < 0.4 THEN 2 + sqrt(v * 40) ELSE 12 - sqrt((1 - v) * 60) END AS tri FROM (SELECT *, {u_sql(42, 'id', chr(39) + 'tri' + chr(39))} AS v FROM (SELECT cast(doc_id AS varchar) AS id FROM documents))")
def _(table):
    d = table("documents").select(c("doc_id").cast("string").alias("id"))
    return d.select("id", sampling.turn_count(4, 8).alias("turns"), sampling.flag(0.2, "slip").alias("slip"), triangular(uniform(42, "id", F.lit("tri")), 2, 6, 12).alias("tri"))


@query("g7_render_prompts", "SELECT cast(doc_id AS varchar) AS id, CASE WHEN lang = 'en' THEN 'Speak English as ' || source ELSE 'Any as ' || source || ' in ' || lang END AS prompt FROM documents")
def _(table):
    d = table("documents")
    slots = d.select(c("doc_id").cast("string").alias("id"), F.lit("x").alias("category"), c("lang").alias("data_type"), F.create_map(F.lit("who"), c("source"), F.lit("tongue"), c("lang")).alias("traits"))
    templates = d.sparkSession.createDataFrame([("x", "en", "Speak English as {who}"), ("x", None, "Any as {who} in {tongue}")], "category string, data_type string, template string")
    return sampling.render_prompts(slots, templates).select("id", "prompt")


@query("g7_style_pair", f"""WITH d AS (SELECT *, {u_sql(42, 'id', chr(39) + 'style_dimension' + chr(39))} AS u, {u_sql(42, 'id', chr(39) + 'style_pair' + chr(39))} AS v FROM (SELECT cast(doc_id AS varchar) AS id, lang, source FROM documents)),
k AS (SELECT *, CASE WHEN u < 0.5 THEN 'pace' ELSE 'tone' END AS dim FROM d) SELECT id, CASE WHEN lang <> 'en' THEN source || ' ' || lang WHEN dim = 'pace' THEN source || ' pace: ' || CASE WHEN v < 0.5 THEN 'fast or slow' ELSE 'steady or hasty' END ELSE source || ' tone: warm or cool' END AS prompt FROM k""")
def _(table):
    d = table("documents")
    kind = F.when(c("lang") == "en", "counterfactual").otherwise(c("lang"))
    slots = d.select(c("doc_id").cast("string").alias("id"), F.lit("x").alias("category"), kind.alias("data_type"), F.create_map(F.lit("who"), c("source"), F.lit("lang"), c("lang")).alias("traits"))
    styles = d.sparkSession.createDataFrame([("pace", "fast", "slow"), ("pace", "steady", "hasty"), ("tone", "warm", "cool")], "dimension string, style_a string, style_b string")
    templates = d.sparkSession.createDataFrame([("x", "counterfactual", "{who} {diff_dimension}: {style_a} or {style_b}"), ("x", None, "{who} {lang}")], "category string, data_type string, template string")
    return sampling.render_prompts(sampling.style_pair(slots, styles), templates).select("id", "prompt")


@query("w4_prompt_words", "SELECT conv_id * 100 + turn AS id, generate_subscripts(ws, 1) - 1 AS idx, unnest(ws) AS word, (generate_subscripts(ws, 1) - 1) * 5.7::double / len(ws) AS start, generate_subscripts(ws, 1) * 5.7::double / len(ws) AS \"end\" FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM conversations WHERE role = 'system')")
def _(table):
    return corpus.prompt_words(table("conversations").where("role = 'system'").select((c("conv_id") * 100 + c("turn")).alias("id"), c("text").alias("prompt"), F.lit(5.7).alias("prompt_end")))


@query("w5_with_prompt", """WITH p AS (SELECT sample_id AS id, list_filter(string_split('be ' || sample_id || ' kind', ' '), lambda x: x <> '') AS ws FROM (SELECT DISTINCT sample_id FROM words)), h AS (SELECT id, 0 AS part, generate_subscripts(ws, 1) - 1 AS idx, unnest(ws) AS word, (generate_subscripts(ws, 1) - 1) * (3.0::double / len(ws)) AS start, generate_subscripts(ws, 1) * (3.0::double / len(ws)) AS "end" FROM p),
a AS (SELECT * FROM h UNION ALL SELECT sample_id, 1, idx, word, start + 3.0::double, "end" + 3.0::double FROM words) SELECT id, word, start, "end", row_number() OVER (PARTITION BY id ORDER BY start, part, idx) - 1 AS pos FROM a""", "words")
def _(words):
    prompts = words.select(c("sample_id").alias("id")).distinct().select("id", F.concat(F.lit("be "), c("id"), F.lit(" kind")).alias("prompt"), F.lit(None).cast("string").alias("rephrased"), F.lit(3.0).alias("prompt_end"))
    return corpus.with_prompt(words.withColumnRenamed("sample_id", "id"), prompts, True).drop("part")


TIMELINE = f"""l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, {u_sql(42, 'conv_id', 'turn', chr(39) + 'gap' + chr(39))} AS u FROM turns),
g AS (SELECT *, CASE WHEN before IS NULL THEN 0 WHEN before = role THEN 0.2 + 0.6 * u WHEN role = 'assistant' THEN 0.1 + 0.3 * u ELSE 0.3 + 0.9 * u END AS gap FROM l),
tl AS (SELECT conv_id, turn, role, 5.7 + sum(gap + duration) OVER (PARTITION BY conv_id ORDER BY turn) - duration AS start, 5.7 + sum(gap + duration) OVER (PARTITION BY conv_id ORDER BY turn) AS "end" FROM g)"""


@query("w6_plan_timeline", f"WITH {TIMELINE} SELECT * FROM tl", "turns")
def _(turns):
    return corpus.plan_timeline(turns)


@query("w7_split_conversations", None, "turns")
def _(turns):
    line = corpus.plan_timeline(turns, barge_share=0.2, silence_share=0.1)
    prompts = line.groupBy("conv_id").agg(F.lit(5.7).alias("prompt_end"), (F.max("end") + 1).alias("total"))
    return corpus.split_conversations(line, prompts, longest=40.0)


@query("a16_length_report", f"""WITH {TIMELINE}, b AS (SELECT conv_id, max("end") AS len, max_by(role, turn) AS last FROM tl GROUP BY conv_id) SELECT count(*) AS conversations, avg(len) AS mean, median(len) AS median, max(len) AS longest, count(*) FILTER (len > 60) AS need_split, count(*) FILTER (last = 'user') AS end_user, count(*) FILTER (last = 'assistant') AS end_assistant, count(*) FILTER (len <= 60 AND last = 'user') AS good FROM b""", "turns")
def _(turns):
    return corpus.length_report(corpus.plan_timeline(turns), 60.0)


@query("a16_split_report", f"""WITH RECURSIVE {TIMELINE}, ends AS (SELECT conv_id, max("end") + 1 AS total FROM tl GROUP BY conv_id),
u AS (SELECT conv_id, turn, "end" AS e, lead("end") OVER (PARTITION BY conv_id ORDER BY turn) AS following, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM tl WHERE role = 'user'),
walk AS (SELECT conv_id, 0::bigint AS i, 0.0::double AS at, false AS closes, 0.0::double AS length FROM ends UNION ALL
  SELECT w.conv_id, u.i, CASE WHEN k THEN least(u.e + 0.2, total) ELSE w.at END, k, least(u.e + 0.2, total) - w.at
  FROM walk w JOIN u ON u.conv_id = w.conv_id AND u.i = w.i + 1 JOIN ends n ON n.conv_id = w.conv_id CROSS JOIN LATERAL (SELECT (u.e - w.at >= 40.0 * 0.8 OR u.following IS NULL OR u.following - w.at > 40.0) AND u.e - w.at >= 10 AS k) x)
SELECT (SELECT count(*) FROM ends) AS conversations, count(DISTINCT conv_id) AS split, count(*) AS chunks, coalesce(sum(length), 0) / 3600 AS hours, count(*) AS end_user, 100.0::double AS end_user_pct, 0 AS end_assistant, 0.0::double AS end_assistant_pct FROM walk WHERE closes""", "turns")
def _(turns):
    line = corpus.plan_timeline(turns)
    prompts = line.groupBy("conv_id").agg(F.lit(5.7).alias("prompt_end"), (F.max("end") + 1).alias("total"))
    return corpus.split_report(line, corpus.split_conversations(line, prompts, longest=40.0))


CHECKS = "k AS (SELECT conv_id, turn, duration, (turn % 10) / 10.0::double AS silence_ratio, (conv_id % 5) / 10.0::double AS wer FROM turns)"


def checked(turns: DataFrame) -> DataFrame:
    return corpus.turn_checks(turns.withColumn("silence_ratio", (c("turn") % 10) / F.lit(10.0)).withColumn("wer", (c("conv_id") % 5) / F.lit(10.0)), 0.5)


@query("a15_turn_checks", f"WITH {CHECKS} SELECT conv_id, turn, duration >= 0.5 AND silence_ratio <= 0.5 AND wer <= 0.3 AS passed, CASE WHEN duration < 0.5 THEN 1 ELSE 3 END AS n_checks FROM k", "turns")
def _(turns):
    return checked(turns).select("conv_id", "turn", "passed", F.size("checks").alias("n_checks"))


@query("a14_conversation_quality", f"WITH {CHECKS} SELECT conv_id, bool_and(duration >= 0.5 AND silence_ratio <= 0.5 AND wer <= 0.3) AS quality_passed, count(*) AS turns FROM k GROUP BY conv_id", "turns")
def _(turns):
    return corpus.conversation_quality(checked(turns))


@query("q1_word_errors", "SELECT conv_id, turn, CASE WHEN len(ws) = 0 THEN 0 ELSE len(list_filter(range(len(ws)), lambda i: i % 9 = 0)) / len(ws) END AS wer FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '') AS ws FROM turns)", "turns")
def _(turns):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    hyp = F.array_join(F.filter(words, lambda w, i: i % 9 != 0), " ")
    return turns.select("conv_id", "turn", scoring.word_errors(c("text"), hyp).alias("wer"))


@query("q2_parse_transcripts", "WITH g AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS ts FROM turns GROUP BY conv_id) SELECT conv_id, CASE WHEN len(ts) >= 2 AND len(list_filter(ts, lambda x: x.text = '')) = 0 THEN len(ts) END AS n FROM g", "turns")
def _(turns):
    lists = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    reply = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(F.transform("ts", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))), F.lit("\n```\nDone."))
    return scoring.parse_transcripts(lists.withColumn("reply", reply)).select("conv_id", F.when(c("turns").isNotNull(), F.size("turns")).alias("n"))


@query("q3_parse_judged", "SELECT event_type AS setup, event_id AS task_id, (event_id % 50)::double AS start, (event_id % 50 + 5)::double AS \"end\", (event_id % 5)::double AS tt, (event_id % 4)::double AS follow FROM events UNION ALL SELECT event_type, event_id, 60.0, 75.0, (event_id % 5)::double, (event_id % 4)::double FROM events")
def _(table):
    k = c("event_id")
    reply = F.concat(F.lit("```\n{"), k % 50, F.lit(", "), k % 50 + 5, F.lit('}, ["1:00", "1:15"]: '), k % 5, F.lit(", "), k % 4, F.lit("\ntask_score: 3\n```"))
    return judged.parse_judged(table("events").select(c("event_type").alias("setup"), k.alias("task_id"), reply.alias("reply")), loose=True)[0].drop("block", "pos")


JUDGED = """SELECT event_type AS setup, event_id AS task_id, 0 AS pos, (event_id % 50)::double AS start, (event_id % 50 + 5)::double AS "end", (event_id % 5)::double AS tt, (event_id % 4)::double AS follow FROM events WHERE event_id % 4 <> 3
UNION ALL SELECT event_type, event_id, 0, 60.0, 75.5, (event_id % 5)::double, (event_id % 4)::double FROM events WHERE event_id % 4 <> 3
UNION ALL SELECT event_type, event_id, 1, 80.0, 81.0, CASE WHEN event_id % 4 <> 2 THEN 2.0 END, 1.0 FROM events WHERE event_id % 4 <> 3"""


def judged_replies(table: Callable) -> DataFrame:
    """Replies of a judge: JSON in a fence, JSON by itself, a list that isn't JSON, and free text."""
    k = c("event_id")
    first = F.concat(F.lit("{"), k % 50, F.lit(", "), k % 50 + 5, F.lit('}, ["1:00", 75.5]'))
    listed = lambda a, between, b, last: F.concat(F.lit(f'{{"{judged.EVENTS}": ['), F.lit(a), first, F.lit(between), k % 5, F.lit(", "), k % 4, F.lit(b), F.lit(f'], "{judged.TASK}": {last}}}'))
    clean = listed("[[", "], ", '], [{"start_time": 80, "end_time": "1:21"}, 2, 1]', 3)
    half = F.concat(F.lit('As I said: "the ] and { count" \n'), listed("[", "]: ", ', [{"end": 81, "start": 80}]: "null", 1, [[5, 6]] 4', '"4"'), F.lit(" ]}"))
    reply = F.when(k % 4 == 0, F.concat(F.lit("Here:\n```json\n"), clean, F.lit("\n``` done"))).when(k % 4 == 1, clean).when(k % 4 == 2, half).otherwise(F.concat(F.lit("From "), first, F.lit(": 4, 5, I think")))
    return table("events").select(c("event_type").alias("setup"), k.alias("task_id"), reply.alias("reply"))


@query("q3_judged_events", JUDGED)
def _(table):
    return judged.parse_judged(judged_replies(table))[0].drop("block")


@query("q3_task_scores", "SELECT event_type AS setup, event_id AS task_id, CASE WHEN event_id % 4 = 2 THEN 4.0 ELSE 3.0 END AS score FROM events WHERE event_id % 4 <> 3")
def _(table):
    return judged.parse_judged(judged_replies(table))[1]


ODD = ' {"} \\ \\\\"'


@query("q4_object_with_key", f"SELECT conv_id, turn, CASE WHEN turn % 5 <> 4 THEN text || '{ODD}' END AS why, CASE WHEN turn % 5 <> 4 THEN role END AS first FROM conversations")
def _(table):
    """Objects behind other objects, in ones that are broken or never closed, with braces, quotes and backslashes in their texts."""
    rows, turn = table("conversations"), c("turn")
    own = F.to_json(F.struct(F.concat("text", F.lit(ODD)).alias("why"), F.array("role", F.lit("x")).alias("behaviour")))
    other = F.to_json(F.struct(F.struct("text", F.array(F.lit("no")).alias("behaviour")).alias("a")))
    before = F.element_at(F.array(F.lit("{oops} "), F.lit('{"x": '), F.lit('5" wide { '), F.lit("```json\n"), F.lit("} ] ")), (turn % 5 + 1).cast("int"))
    reply = F.concat(other, before, F.when(turn % 5 == 4, other).otherwise(F.concat(own, F.lit(' and {"behaviour": "later"}'))), F.lit("\n```"))
    found = object_with_key(reply, "behaviour")
    return rows.select("conv_id", "turn", F.get_json_object(found, "$.why").alias("why"), F.get_json_object(found, "$.behaviour[0]").alias("first"))


@query("q4_last_rating", "SELECT event_id, CASE WHEN event_id % 9 <= 5 THEN event_id % 9 END AS rating FROM events")
def _(table):
    return table("events").select("event_id", scoring.last_rating(F.concat(F.lit("Rating: 1. Then rating: "), c("event_id") % 9)).cast("long").alias("rating"))


@query("q5_memory_warnings", "SELECT conv_id, CASE WHEN count(*) FILTER (role = 'assistant') = 0 THEN ['no assistant turns'] WHEN regexp_matches(string_agg(lower(text), ' ') FILTER (role = 'assistant'), '[0-9]') THEN [] ELSE ['numerical_state_tracking: no digits'] END AS warnings FROM turns GROUP BY conv_id", "turns")
def _(turns):
    return scoring.memory_warnings(turns, F.lit("numerical_state_tracking"))


@query("q6_turn_drift", "SELECT conv_id, 6 AS requested, count(*) AS got, count(*) - 6 AS drift FROM turns GROUP BY conv_id", "turns")
def _(turns):
    return scoring.turn_drift(turns, turns.select("conv_id").distinct().withColumn("n", F.lit(6)))


@query("q7_reduce_scores", "SELECT doc_id, doc_id % 3 <> 0 AS scorable, CASE WHEN doc_id % 3 <> 0 THEN (quality + toxic) / 2.0::double END AS mean_score FROM labels")
def _(table):
    score = F.when(c("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(c("quality").cast("string"), c("toxic").cast("string")))
    return scoring.reduce_scores(table("labels").withColumn("score", score)).select("doc_id", "scorable", "mean_score")


@query("t25_content_words", "WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 7)) AS ws FROM turns) SELECT conv_id, turn, len(ws) AS n, array_to_string(list_sort(ws), ' ') AS words FROM w", "turns")
def _(turns):
    words = F.array_sort(X.content_words(c("text"), 7))
    return turns.select("conv_id", "turn", F.size(words).alias("n"), F.array_join(words, " ").alias("words"))


@query("o6_intersect_words", "WITH w AS (SELECT doc_id, string_split(substr(text, 1, length(text) // 2), ' ') AS a, string_split(substr(text, length(text) // 2 + 1), ' ') AS b FROM documents) SELECT doc_id, len(list_intersect(list_distinct(a), list_distinct(b))) AS n FROM w")
def _(table):
    half = F.floor(F.length("text") / 2).cast("int")
    return table("documents").select("doc_id", F.size(X.common_words(F.substr("text", F.lit(1), half), F.substr("text", half + 1))).alias("n"))


@query("s7_fallback", "SELECT doc_id, 'labels' AS origin FROM labels UNION ALL SELECT doc_id, 'documents' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(table):
    return speakers.transcripts_with_fallback(table("labels").select("doc_id", F.lit("labels").alias("origin")), table("documents").select("doc_id", F.lit("documents").alias("origin")), "doc_id")


@query("s8_wav_seconds", "SELECT o_orderkey AS path, (o_totalprice::double * 100 - 44) / 32000 AS duration FROM orders")
def _(table):
    return table("orders").select(c("o_orderkey").alias("path"), readers.wav_seconds(c("o_totalprice").cast("double") * 100).alias("duration"))


@query("s12_import_corpus", "SELECT 'in/' || o_orderkey AS path, round(CASE WHEN l.q IS NULL OR l.q = 0 THEN 12.0::double ELSE l.q END, 2) AS duration FROM orders LEFT JOIN (SELECT l_orderkey, max(l_quantity)::double AS q FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o_orderkey WHERE CASE WHEN l.q IS NULL OR l.q = 0 THEN 12 ELSE l.q END >= 10")
def _(table):
    known = table("lineitem").groupBy(c("l_orderkey").cast("string").alias("path")).agg(F.max("l_quantity").cast("double").alias("duration"))
    return readers.import_corpus(table("orders").select(c("o_orderkey").cast("string").alias("path"), F.lit(12.0).alias("probed")), known, "in/", 10)


@query("s14_corpus_status", "WITH r AS (SELECT DISTINCT source FROM documents UNION SELECT 'none'), m AS (SELECT source, sum(n_chars / 15.0::double) / 3600 AS hours FROM documents WHERE lang = 'en' GROUP BY source) SELECT r.source, r.source IN (SELECT source FROM documents) AS has_data, m.hours IS NOT NULL AS has_manifest, coalesce(m.hours, 0) AS hours FROM r LEFT JOIN m ON r.source = m.source")
def _(table):
    d = table("documents")
    registry = d.select("source").union(d.limit(1).select(F.lit("none").alias("source"))).distinct()
    return readers.corpus_status(registry, d.where("lang = 'en'").select("source", (c("n_chars") / F.lit(15.0)).alias("duration")), d)


@query("a27_sample_counts", "SELECT d.source, count(*) AS n, count(l.doc_id) AS resumed, count(*) - count(l.doc_id) AS pending FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source")
def _(table):
    return corpus.sample_counts(table("documents"), table("labels"), "doc_id", "source")


RUBRICS = {"system": "Judge the call.", "fluency": "Rate turn taking.", "following": "Rate following.", "format": "A JSON object."}
TASKS = {"correction": "Was the correction heard?", "entity_tracking": "", "safety": "Was it safe?"}


@query(
    "t22_judge_prompts",
    """WITH s AS (SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '') AS a, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), '') AS b,
coalesce(string_agg(printf('[%.2f, %.2f]: %s', turn * 1.5::double, turn * 1.5::double + 1.25::double, text), chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS lines FROM turns GROUP BY conv_id)
SELECT conv_id, concat_ws(chr(10) || chr(10), 'SYSTEM INSTRUCTION:' || chr(10) || 'Judge the call.', 'TURN-TAKING FLUENCY RUBRIC:' || chr(10) || 'Rate turn taking.', 'MULTI-TURN INSTRUCTION-FOLLOWING RUBRIC:' || chr(10) || 'Rate following.',
CASE conv_id % 4 WHEN 1 THEN 'TASK-SPECIFIC RUBRIC:' || chr(10) || 'Was the correction heard?' WHEN 3 THEN 'TASK-SPECIFIC RUBRIC:' || chr(10) || 'Was it safe?' END, 'OUTPUT FORMAT:' || chr(10) || 'A JSON object.',
concat_ws(chr(10), 'Dataset staged goals (T1–T4):', 'T1: ask ' || conv_id, 'T2: more', 'T3: change', 'T4: end'),
'Transcript summary:' || chr(10) || 'Channel A (Examiner) summary:' || chr(10) || a || chr(10) || chr(10) || 'Channel B (Examinee) summary:' || chr(10) || b || chr(10) || chr(10) || 'Channel B (Examinee) segments with timestamps:' || chr(10) || lines,
concat_ws(chr(10), 'Constraints:', '- Keep each evaluation output about ~100 words.', '- Follow the JSON shape exactly as in OUTPUT FORMAT.', '- Use time ranges from the provided Channel B timestamps.', '')) AS judge_prompt FROM s""",
    "turns",
)
def _(turns):
    said = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    of = lambda role: F.filter("ts", lambda x: x["role"] == role)
    joined = lambda role: F.array_join(F.transform(of(role), lambda x: x["text"]), " ")
    chunks = F.transform(of("assistant"), lambda x: F.struct((x["turn"] * F.lit(1.5)).alias("start"), (x["turn"] * F.lit(1.5) + F.lit(1.25)).alias("end"), x["text"].alias("text")))
    goals = F.create_map(F.lit("T1"), F.concat(F.lit("ask "), c("conv_id")), F.lit("T2"), F.lit("more"), F.lit("T3"), F.lit("change"), F.lit("T4"), F.lit("end"))
    subset = F.element_at(F.array(*map(F.lit, X.SUBSETS)), (c("conv_id") % 4 + 1).cast("int"))
    rows = said.select("conv_id", subset.alias("subset"), goals.alias("goals"), joined("user").alias("a_text"), joined("assistant").alias("b_text"), chunks.alias("chunks"))
    return prompts.judge_prompts(rows, RUBRICS, TASKS).select("conv_id", "judge_prompt")


@query("t23_carry_fields", "SELECT doc_id, text FROM documents")
def _(table):
    return prompts.carry_fields(table("documents").withColumn("index", c("doc_id")), ["doc_id", "text", "audio", "index", "not_there"])


@query("t24_compact_lists", """WITH w AS (SELECT conv_id * 100 + turn AS sample_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS ws FROM turns)
SELECT sample_id, to_json({'input_clean': ws, 'output_clean': ws[1:3]})::varchar AS lists FROM w""", "turns")
def _(turns):
    ws = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")
    return turns.select((c("conv_id") * 100 + c("turn")).alias("sample_id"), prompts.compact_lists(input_clean=ws, output_clean=F.slice(ws, 1, 3)).alias("lists"))


@query("o7_expand_splits", "WITH w AS (SELECT DISTINCT source, source IN ('src0', 'src1') AS by_region FROM documents) SELECT CASE WHEN by_region THEN source || '/' || part ELSE source END AS name, source AS subset, part, 'open' AS evaluator FROM (SELECT *, unnest(CASE WHEN by_region THEN ['usa', 'gbr'] ELSE ['test'] END) AS part FROM w)")
def _(table):
    wanted = table("documents").select(c("source").alias("subset")).distinct()
    registry = wanted.select("subset", c("subset").isin("src0", "src1").alias("by_region"), F.lit("open").alias("evaluator"))
    return prompts.expand_splits(wanted, registry, ["usa", "gbr"], ["usa", "gbr", "ind"])


@query("t8_activity_seconds", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0::double ELSE (event_id % 7) + 0.5::double END AS seconds FROM events")
def _(table):
    k = c("event_id")
    spans = F.when(k % 5 == 0, F.lit("none")).otherwise(F.concat(F.lit("[(1.0, "), k % 7 + 1, F.lit("), (20, 20.5)]")))
    return table("events").select("event_id", X.activity_seconds(spans).alias("seconds"))


@query("t19_subset_names", "SELECT event_id, (['daily', 'correction', 'entity_tracking', 'safety'])[event_id % 4 + 1] AS subset FROM events")
def _(table):
    spelled = F.element_at(F.array(*map(F.lit, [" Daily", "Corrections", "Entity Tracking", "SAFETY "])), (c("event_id") % 4 + 1).cast("int"))
    return table("events").select("event_id", X.subset_name(spelled).alias("subset"))
