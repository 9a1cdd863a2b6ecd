"""Judge prompts, carried fields and split expansion on a few hand-made rows."""

import pytest
from pyspark.sql import functions as F

from turnweave.functions.text import subset_name
from turnweave.operators.prompts import carry_fields, expand_splits, judge_prompts, segment_lines

RUBRICS = {"system": " s ", "fluency": "f", "following": "g", "format": "o"}
SCHEMA = "subset string, goals map<string,string>, a_text string, b_text string, chunks array<struct<start:double,end:double,text:string>>"


def prompt(spark, subset, goals, tasks):
    rows = spark.createDataFrame([(subset, goals, None, "b", [(0.0, 1.5, "x")])], SCHEMA)
    return judge_prompts(rows, RUBRICS, tasks).first().judge_prompt


def test_sections(spark):
    goals = {k: k.lower() for k in ("T1", "T2", "T3", "T4")}
    plain, safety = prompt(spark, "daily", goals, {"safety": " z "}), prompt(spark, "safety", goals, {"safety": " z "})
    assert "TASK-SPECIFIC" not in plain and "\n\nTASK-SPECIFIC RUBRIC:\nz\n\nOUTPUT FORMAT:\no\n\n" in safety
    assert plain.startswith("SYSTEM INSTRUCTION:\ns\n\n") and "summary:\n\n\nChannel B" in plain and "[0.00, 1.50]: x" in plain
    assert "TASK-SPECIFIC" not in prompt(spark, "safety", goals, {"safety": " "})


@pytest.mark.parametrize("subset, goals", [("other", {"T1": "", "T2": "", "T3": "", "T4": ""}), ("daily", {"T1": "", "T2": "", "T3": ""}), ("daily", None)])
def test_errors(spark, subset, goals):
    with pytest.raises(Exception, match="no task rubric|is missing"):
        prompt(spark, subset, goals, {"safety": "z"})


def test_segment_lines(spark):
    rows = spark.createDataFrame([([(0.0, 1.0, None), (None, 2.0, "t"), (None, None, None), (None, None, ""), (1.0, 2.25, "u")],)], "chunks array<struct<start:double,end:double,text:string>>")
    assert rows.select(segment_lines(F.col("chunks"))).first()[0] == "[0.00, 1.00]: \nt\n[1.00, 2.25]: u"


def test_carry_fields(spark):
    rows = spark.createDataFrame([(1, "a", "w")], "key int, prompt string, audio string")
    assert carry_fields(rows, ["prompt", "key", "kwargs", "audio"]).columns == ["prompt", "key"]


def test_expand_splits(spark):
    registry = spark.createDataFrame([("plain", False, "open"), ("spoken", True, "qa")], "subset string, by_region boolean, evaluator string")
    wanted = spark.createDataFrame([("plain",), ("spoken",)], "subset string")
    got = {tuple(r) for r in expand_splits(wanted, registry, ["usa", "gbr"], ["usa", "gbr"]).collect()}
    assert got == {("plain", "plain", "test", "open"), ("spoken/usa", "spoken", "usa", "qa"), ("spoken/gbr", "spoken", "gbr", "qa")}
    with pytest.raises(ValueError, match="unknown regions"):
        expand_splits(wanted, registry, ["mars"], ["usa"])
    with pytest.raises(Exception, match="unknown subset"):
        expand_splits(wanted.union(spark.createDataFrame([("x",)], "subset string")), registry, ["usa"], ["usa"]).collect()


def test_subset_names(spark):
    rows = spark.createDataFrame([("Corrections",), ("entity_tracking",), (" EntityTracking",)], "s string")
    assert [r[0] for r in rows.select(subset_name(F.col("s"))).collect()] == ["correction", "entity_tracking", "entity_tracking"]
    with pytest.raises(Exception, match="unknown subset"):
        spark.createDataFrame([("entity-tracking",)], "s string").select(subset_name(F.col("s"))).collect()
