"""Q3: what judges reply about turn taking, read as JSON where it is, and by its brackets where it isn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.functions.brackets import brace_spans, list_spans, piece
from turnweave.functions.text import time_seconds

#: The keys of a judge's object.
EVENTS, TASK = "Turn-taking event and score", "Task-specific score"

#: How a time, and the names of a start and an end, are written.
TIME = r"""["']?[-+]?\d[\d.:eE+-]*["']?"""
START, END = r"""["'](?:start_time|startTime|start)["']""", r"""["'](?:end_time|endTime|end)["']"""
#: A list of two values that aren't lists.
PAIR = r"""\[\s*("[^"]*"|'[^']*'|[^\[\],"'\s]+)\s*,\s*("[^"]*"|'[^']*'|[^\[\],"'\s]+)\s*\]"""
TOKEN = r"""("(?:[^"\\]|\\.)*"|[^,\[\]{}:\s"]*)"""
ITEM = "array<struct<body: string, tt: string, follow: string>>"


def with_pairs(text: Column) -> Column:
    """{a, b} and objects of a start and an end as [a, b]."""
    text = F.regexp_replace(text, rf"\{{\s*{START}\s*:\s*({TIME})\s*,\s*{END}\s*:\s*({TIME})\s*\}}", "[$1, $2]")
    text = F.regexp_replace(text, rf"\{{\s*{END}\s*:\s*({TIME})\s*,\s*{START}\s*:\s*({TIME})\s*\}}", "[$2, $1]")
    return F.regexp_replace(text, rf"\{{\s*({TIME})\s*,\s*({TIME})\s*\}}", "[$1, $2]")


def score(token: Column) -> Column:
    """A whole number; null for what is none."""
    return F.btrim(token, F.lit("\"' ")).try_cast("double").try_cast("long").cast("double")


def field(v: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$['{key}']", kind)


def json_items(v: Column) -> Column:
    """Of a parsed object: every listed item of three members or more; the last two are scores, what is before holds intervals at any depth."""
    members = F.transform(field(v, EVENTS, "array<variant>"), lambda x: F.try_variant_get(x, "$", "array<variant>"))
    text = lambda m, back: F.try_variant_get(F.get(m, F.size(m) - back), "$", "string")
    item = lambda m: F.struct(F.to_json(F.slice(m, 1, F.size(m) - 2)).alias("body"), text(m, 2).alias("tt"), text(m, 1).alias("follow"))
    return F.transform(F.filter(members, lambda m: F.size(m) >= 3), item)


def scanned_items(text: Column, spans: Column, region: Column) -> Column:
    """Of the list ``region`` in a text that isn't JSON: its members that a colon and scores follow."""
    own = F.filter(spans, lambda s: (s["odd"] == region["odd"]) & (s["level"] == region["level"] + 1) & (s["open"] > region["open"]) & (s["close"] < region["close"]))
    gap = r"[\s,]*"
    scores = rf"^{gap}:{gap}{TOKEN}{gap}{TOKEN}"

    def item(s: Column, k: Column) -> Column:
        behind = F.substring(text, s["close"] + 2, F.coalesce(F.get(own, k + 1)["open"], region["close"]) - s["close"] - 1)
        return F.when(behind.rlike(rf"^{gap}:"), F.struct(piece(text, s).alias("body"), F.regexp_extract(behind, scores, 1).alias("tt"), F.regexp_extract(behind, scores, 2).alias("follow")))

    return F.filter(F.transform(own, item), lambda i: i.isNotNull())


def task_score(text: Column) -> Column:
    found = F.regexp_extract(text, rf"""["']{TASK}["']\s*:\s*("[^"]+"|'[^']+'|[^\s,}}\]]+)""", 1)
    return score(F.nullif(found, F.lit("")))


def parse_judged(replies: DataFrame, loose: bool = False) -> tuple[DataFrame, DataFrame]:
    """Q3: judged events (setup, task_id, block, pos, start, end, tt, follow) and task scores (setup, task_id, score) of replies (setup, task_id, reply).

    A reply's blocks are its fenced ones that name the events, else the reply itself.  Braced
    pairs and start/end objects count as [a, b].  A block that is one JSON object with one of
    the two keys is read as such: each item's last two members are scores that all its
    intervals share, and these are the lists of two times, at any depth.  Any other block is
    read by its brackets: the list behind the key, its members, and behind each a colon and two
    scores.  Scores are whole numbers or null; pairs that aren't times are dropped.  The last
    block's task score wins.  Replies without the key give nothing; with ``loose`` they are read
    by ``scan_judged``.
    """
    named = lambda text: F.contains(text, F.lit(EVENTS))
    fenced = F.filter(F.regexp_extract_all("reply", F.lit(r"(?is)```(?:json)?\s*(.*?)\s*```"), 1), named)
    whole = replies.where("reply is not null")
    keyed = whole.where(named(F.col("reply")) | F.contains("reply", F.lit(TASK)))
    blocks = keyed.select("setup", "task_id", F.posexplode(F.when(F.size(fenced) > 0, fenced).otherwise(F.array("reply"))).alias("block", "t"))
    blocks = blocks.withColumn("t", F.trim(with_pairs(F.col("t")))).withColumn("braces", brace_spans("t")).withColumn("lists", list_spans("t"))
    t, keys = F.col("t"), F.json_object_keys("t")
    all_of_it = F.exists("braces", lambda s: (s["open"] == 0) & (s["close"] == F.length(t) - 1))
    parsed = F.when(all_of_it & F.arrays_overlap(keys, F.array(F.lit(EVENTS), F.lit(TASK))), F.try_parse_json(t))
    key = F.greatest(F.locate(f'"{EVENTS}"', t), F.locate(f"'{EVENTS}'", t))
    opened = F.when(key > 0, F.expr(f"locate('[', t, greatest(locate('\"{EVENTS}\"', t), locate(\"'{EVENTS}'\", t)) + {len(EVENTS) + 2})") - 1)
    read = blocks.withColumn("v", parsed).withColumn("region", F.get(F.filter("lists", lambda s: s["open"] == opened), F.lit(0)))
    v, region = F.col("v"), F.col("region")
    none = F.array().cast(ITEM)
    items = F.when(v.isNotNull(), json_items(v)).when(region.isNotNull(), scanned_items(t, F.col("lists"), region))
    behind = F.substring(t, region["close"] + 1, F.length(t))
    found = F.when(v.isNotNull(), score(field(v, TASK, "string"))).when(region.isNotNull(), F.coalesce(F.nullif(task_score(behind), F.lit(0.0)), task_score(t)))
    rows = read.select("setup", "task_id", "block", F.posexplode(F.coalesce(items, none)).alias("pos", "i"))
    starts, ends = (F.regexp_extract_all("i.body", F.lit(PAIR), k) for k in (1, 2))
    pairs = rows.select("setup", "task_id", "block", "pos", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("x"), score(F.col("i.tt")).alias("tt"), score(F.col("i.follow")).alias("follow"))
    events = pairs.select("setup", "task_id", "block", "pos", time_seconds(F.col("x.s")).alias("start"), time_seconds(F.col("x.e")).alias("end"), "tt", "follow").where("start is not null and end is not null")
    # blocks without a score have no rank; a filter before the aggregate would be pushed below the brackets, with all that the score is made of
    last = F.max_by("score", F.when(F.col("score").isNotNull(), F.col("block"))).alias("score")
    scores = read.select("setup", "task_id", "block", found.alias("score")).groupBy("setup", "task_id").agg(last).where("score is not null")
    if loose:
        more, more_scores = scan_judged(whole.where(~named(F.col("reply")) & ~F.contains("reply", F.lit(TASK))))
        events, scores = events.unionByName(more.withColumn("block", F.lit(0))), scores.unionByName(more_scores)
    return events, scores


def scan_judged(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and task scores of replies that name no key, wherever intervals, a colon and two scores stand; see ``parse_judged``."""
    text = F.regexp_replace(F.regexp_replace("reply", r"```(?:json)?", " "), r"\{\s*([\d.:\"']+)\s*,\s*([\d.:\"']+)\s*\}", r"[$1, $2]")
    text = F.regexp_replace(text, r"\{\s*[\"']?start[\"']?\s*:\s*([\d.:\"']+?)\s*,\s*[\"']?end[\"']?\s*:\s*([\d.:\"']+?)\s*\}", r"[$1, $2]")
    pair = r"\[\s*([\d.:\"']+)\s*,\s*([\d.:\"']+)\s*\]"
    item = rf"((?:\[?\s*{pair.replace('(', '(?:')}\s*,?\s*\]?\s*)+)[:,]\s*\[?\s*(\d+(?:\.\d+)?|null)\s*,\s*(\d+(?:\.\d+)?|null)"
    base = replies.select("setup", "task_id", text.alias("t"))
    spans, tt, follow = (F.regexp_extract_all("t", F.lit(item), k) for k in (1, 2, 3))
    items = base.select("setup", "task_id", F.posexplode(F.arrays_zip(spans.alias("spans"), tt.alias("tt"), follow.alias("follow"))).alias("pos", "i"))
    starts, ends = (F.regexp_extract_all("i.spans", F.lit(pair), k) for k in (1, 2))
    rows = items.select("setup", "task_id", "pos", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("x"), F.col("i.tt").try_cast("double").alias("tt"), F.col("i.follow").try_cast("double").alias("follow"))
    events = rows.select("setup", "task_id", "pos", time_seconds(F.col("x.s")).alias("start"), time_seconds(F.col("x.e")).alias("end"), "tt", "follow").where("start is not null and end is not null")
    found = F.try_element_at(F.regexp_extract_all("t", F.lit(r"(?i)task[ _]?score[\"']?\s*[:=]\s*[\"']?(\d+(?:\.\d+)?)"), 1), F.lit(-1)).try_cast("double")
    return events, base.select("setup", "task_id", found.alias("score")).where("score is not null")
