"""Stand-in views over the given tables, for Spark, and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS_SQL = "list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '')"
U_SQL = "(cast('0x' || substr(md5({key}), 1, 8) AS bigint) / 4294967296.0)"


def u_sql(seed: int, *key: str) -> str:
    return U_SQL.format(key=f"concat_ws(':', '{seed}', {', '.join(key)})")


SQL = {
    "manifest": "SELECT cast(doc_id AS varchar) AS path, source, n_chars / 15.0::double AS duration FROM documents",
    "turns": f"SELECT conv_id, turn, role, text, len({WORDS_SQL}) * 0.4::double AS duration FROM conversations WHERE role IN ('user', 'assistant')",
    "words": f"""SELECT conv_id * 100 + turn AS sample_id, idx, word, idx * 0.4::double + (idx // 7) * 1.3::double AS start, idx * 0.4::double + (idx // 7) * 1.3::double + 0.3::double AS "end"
FROM (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS idx FROM (SELECT conv_id, turn, {WORDS_SQL} AS ws FROM conversations))""",
    "segments": """SELECT user_id AS sample_id, CASE WHEN event_type IN ('click', 'view') THEN 'user' ELSE 'model' END AS channel, epoch_us(ts) / 3.6e10::double AS start, epoch_us(ts) / 3.6e10::double + value / 50 AS "end" FROM events""",
    "judged_events": """SELECT event_type AS setup, user_id AS task_id, fmod(epoch_us(ts) / 3.6e10::double, 120::double) AS start, fmod(epoch_us(ts) / 3.6e10::double, 120::double) + value / 50 AS "end", 1 + event_id % 5 AS tt, 1 + (event_id // 5) % 5 AS follow FROM events""",
    "verdicts": "SELECT d.doc_id, d.source AS category, l.quality = 1 AS correct FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "metrics": """SELECT l_orderkey AS sample_id, CASE l_linenumber % 3 WHEN 1 THEN 'pre' WHEN 2 THEN 'post' ELSE 'clean' END AS phase, l_returnflag AS metric, l_extendedprice::double AS value FROM lineitem""",
    "clips": "SELECT source AS speaker, cast(doc_id AS varchar) AS path, n_chars / 200.0::double AS duration, text FROM documents",
    "pool": "SELECT c_name AS id, abs(c_acctbal)::double / 1000 AS duration, 'customer' AS source, cast(c_nationkey AS varchar) AS accent, c_name AS ref_path FROM customer UNION ALL SELECT s_name, abs(s_acctbal)::double / 1000, 'supplier', cast(s_nationkey AS varchar), s_name FROM supplier",
    "frames": "SELECT user_id AS path, CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END AS channel, row_number() OVER (PARTITION BY user_id, CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE 1 END ORDER BY ts, event_id) - 1 AS frame_idx, value / 5000 AS rms, 480 AS n, CASE WHEN value < 100 THEN 480 ELSE 0 END AS n_quiet FROM events",
}


def with_views(sql: str, *names: str) -> str:
    """The SQL with the stand-ins as common table expressions."""
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def word_list() -> Column:
    return F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    c = F.col
    if name == "manifest":
        return t(spark, d, "documents").select(c("doc_id").cast("string").alias("path"), "source", (c("n_chars") / F.lit(15.0)).alias("duration"))
    if name == "turns":
        return t(spark, d, "conversations").where(c("role").isin("user", "assistant")).select("conv_id", "turn", "role", "text", (F.size(word_list()) * F.lit(0.4)).alias("duration"))
    if name == "words":
        rows = t(spark, d, "conversations").select((c("conv_id") * 100 + c("turn")).alias("sample_id"), F.posexplode(word_list()).alias("idx", "word"))
        start = c("idx") * F.lit(0.4) + F.floor(c("idx") / 7) * F.lit(1.3)
        return rows.withColumn("start", start).withColumn("end", c("start") + F.lit(0.3))
    if name in ("segments", "judged_events", "frames"):
        e = t(spark, d, "events")
        hours = F.unix_micros(c("ts").cast("timestamp")) / F.lit(3.6e10)
        side = c("event_type").isin("click", "view")
        if name == "segments":
            return e.select(c("user_id").alias("sample_id"), F.when(side, "user").otherwise("model").alias("channel"), hours.alias("start"), (hours + c("value") / 50).alias("end"))
        if name == "frames":
            channel = F.when(side, 0).otherwise(1)
            idx = F.row_number().over(Window.partitionBy("user_id", channel).orderBy("ts", "event_id")) - 1
            return e.select(c("user_id").alias("path"), channel.alias("channel"), idx.alias("frame_idx"), (c("value") / 5000).alias("rms"), F.lit(480).alias("n"), F.when(c("value") < 100, 480).otherwise(0).alias("n_quiet"))
        at = F.pmod(hours, F.lit(120.0))
        return e.select(c("event_type").alias("setup"), c("user_id").alias("task_id"), at.alias("start"), (at + c("value") / 50).alias("end"), (1 + c("event_id") % 5).alias("tt"), (1 + F.floor(c("event_id") / 5) % 5).alias("follow"))
    if name == "verdicts":
        return t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id").select("doc_id", c("source").alias("category"), (c("quality") == 1).alias("correct"))
    if name == "metrics":
        phase = F.when(c("l_linenumber") % 3 == 1, "pre").when(c("l_linenumber") % 3 == 2, "post").otherwise("clean")
        return t(spark, d, "lineitem").select(c("l_orderkey").alias("sample_id"), phase.alias("phase"), c("l_returnflag").alias("metric"), c("l_extendedprice").cast("double").alias("value"))
    if name == "clips":
        return t(spark, d, "documents").select(c("source").alias("speaker"), c("doc_id").cast("string").alias("path"), (c("n_chars") / F.lit(200.0)).alias("duration"), "text")
    if name == "pool":
        one = lambda table, x: t(spark, d, table).select(c(f"{x}_name").alias("id"), (F.abs(f"{x}_acctbal").cast("double") / 1000).alias("duration"), F.lit(table).alias("source"), c(f"{x}_nationkey").cast("string").alias("accent"), c(f"{x}_name").alias("ref_path"))
        return one("customer", "c").unionByName(one("supplier", "s"))
    raise KeyError(name)
