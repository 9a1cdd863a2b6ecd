"""Judge prompts, evaluation splits and the fields that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The judge prompt's titles and constraints.
SYSTEM, FLUENCY, FOLLOWING, TASK, FORMAT = "SYSTEM INSTRUCTION:", "TURN-TAKING FLUENCY RUBRIC:", "MULTI-TURN INSTRUCTION-FOLLOWING RUBRIC:", "TASK-SPECIFIC RUBRIC:", "OUTPUT FORMAT:"
GOALS, SUMMARY = "Dataset staged goals (T1–T4):", "Transcript summary:"
EXAMINER, EXAMINEE, SEGMENTS = "Channel A (Examiner) summary:", "Channel B (Examinee) summary:", "Channel B (Examinee) segments with timestamps:"
CONSTRAINTS = "Constraints:\n- Keep each evaluation output about ~100 words.\n- Follow the JSON shape exactly as in OUTPUT FORMAT.\n- Use time ranges from the provided Channel B timestamps.\n"
STAGES = ["T1", "T2", "T3", "T4"]


def segment_lines(chunks: Column) -> Column:
    """A line "[start, end]: text" for each chunk (start, end, text); without times the text alone, without either nothing."""

    def line(x: Column) -> Column:
        timed = F.format_string("[%.2f, %.2f]: %s", x["start"], x["end"], F.coalesce(x["text"], F.lit("")))
        return F.when(x["start"].isNotNull() & x["end"].isNotNull(), timed).when(x["text"] != "", x["text"])

    return F.array_join(F.transform(chunks, line), "\n")


def judge_prompts(rows: DataFrame, rubrics: dict[str, str], task_rubrics: dict[str, str], plain: str = "daily") -> DataFrame:
    """Adds judge_prompt to rows of subset, goals (map T1 to T4), a_text, b_text and chunks.

    ``rubrics`` has the texts system, fluency, following and format; ``task_rubrics`` one for each
    subset but ``plain``.  An empty rubric's section is left out; a subset without an entry, or a
    row that lacks one of the four goals (J13), is an error.  Null texts count as empty.
    """
    known = F.when(F.col("subset") == plain, F.lit(None).cast("string"))
    for name, body in sorted(task_rubrics.items()):
        section = f"{TASK}\n{body.strip()}" if body.strip() else None
        known = known.when(F.col("subset") == name, F.lit(section).cast("string"))
    task = known.otherwise(F.raise_error(F.concat(F.lit("no task rubric for subset "), F.coalesce("subset", F.lit("null")))).cast("string"))
    fixed = [F.lit(f"{title}\n{rubrics[key].strip()}") for title, key in ((SYSTEM, "system"), (FLUENCY, "fluency"), (FOLLOWING, "following"))]
    goal = lambda k: F.concat(F.lit(f"{k}: "), F.coalesce(F.col("goals")[k], F.raise_error(F.lit(f"staged goal {k} is missing")).cast("string")))
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    summary = F.concat(F.lit(f"{SUMMARY}\n{EXAMINER}\n"), text("a_text"), F.lit(f"\n\n{EXAMINEE}\n"), text("b_text"), F.lit(f"\n\n{SEGMENTS}\n"), F.coalesce(segment_lines(F.col("chunks")), F.lit("")))
    goals = F.concat_ws("\n", F.lit(GOALS), *map(goal, STAGES))
    return rows.withColumn("judge_prompt", F.concat_ws("\n\n", *fixed, task, F.lit(f"{FORMAT}\n{rubrics['format'].strip()}"), goals, summary, F.lit(CONSTRAINTS)))


def carry_fields(rows: DataFrame, fields: list[str], internal: tuple[str, ...] = ("audio", "audio_path", "index")) -> DataFrame:
    """The fields of a split that are there, without internal ones."""
    return rows.select(*(f for f in fields if f in rows.columns and f not in internal))


def compact_lists(**lists: Column) -> Column:
    """Word lists, by name, as one compact JSON text."""
    return F.to_json(F.struct(*(words.alias(name) for name, words in lists.items())))


def expand_splits(wanted: DataFrame, registry: DataFrame, regions: list[str], known_regions: list[str]) -> DataFrame:
    """One row per evaluation split: name, subset, part and the registry's other columns.

    ``wanted`` has subset; ``registry`` subset, by_region and what else belongs to a subset.  A
    subset by region gives a row for each of ``regions``, others the part "test".  A subset that
    the registry lacks, or a region that isn't known, is an error.
    """
    if unknown := sorted(set(regions) - set(known_regions)):
        raise ValueError(f"unknown regions: {unknown}; known are {sorted(known_regions)}")
    joined = wanted.select("subset").join(registry.withColumn("registered", F.lit(True)), "subset", "left")
    by_region = F.when(F.col("registered"), F.col("by_region")).otherwise(F.raise_error(F.concat(F.lit("unknown subset: "), F.coalesce("subset", F.lit("null")))).cast("boolean"))
    parts = F.when(by_region, F.array(*map(F.lit, regions)).cast("array<string>")).otherwise(F.array(F.lit("test")))
    rest = [c for c in registry.columns if c not in ("subset", "by_region")]
    rows = joined.withColumn("part", F.explode(parts))
    return rows.select(F.when(F.col("by_region"), F.concat_ws("/", "subset", "part")).otherwise(F.col("subset")).alias("name"), "subset", "part", *rest)
