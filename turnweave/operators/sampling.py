"""The generation plan by seeded draws.  Each draw has a name, so draws for one slot don't depend on each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.seeding import pick, uniform
from turnweave.functions.text import slot_key
from turnweave.operators.ordering import dense_numbers


def plan_slots(counts: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """G1: one row for each (category, slot) of counts (category, n), less those done (id)."""
    slots = counts.where("n > 0").select("category", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("slot"))
    slots = slots.withColumn("id", slot_key(F.col("category"), F.col("slot")))
    return slots if done is None else slots.join(done.select("id").distinct(), "id", "left_anti")


def weighted_choice(df: DataFrame, weights: DataFrame, draw: str, seed: int = 42, key: str = "id", by: list[str] | None = None, out: str = "option") -> DataFrame:
    """An option of ``weights`` (by..., option, weight) for each row, by normalised weights; groups without weights give null."""
    by = by or []
    order = Window.partitionBy(*by).orderBy("option").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("weight").over(Window.partitionBy(*by))
    bounds = weights.where("weight > 0").withColumn("hi", F.sum("weight").over(order) / whole).select(*by, "option", "hi")
    lists = bounds.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("hi", "option"))).alias("_bounds"))
    u = uniform(seed, key, F.lit(draw))
    joined = df.join(lists, by, "left") if by else df.join(F.broadcast(lists))  # one row without groups
    found = F.get(F.filter("_bounds", lambda b: b["hi"] > u), F.lit(0))
    return joined.withColumn(out, F.coalesce(found["option"], F.element_at("_bounds", -1)["option"])).drop("_bounds")


def data_type(slots: DataFrame, overrides: DataFrame, defaults: DataFrame, seed: int = 42) -> DataFrame:
    """A data type by the category's own weights (category, option, weight) where it has some, else by the default ones (option, weight)."""
    own = slots.select("category").distinct().join(overrides.select("category").distinct(), "category", "left_anti").crossJoin(F.broadcast(defaults))
    return weighted_choice(slots, overrides.unionByName(own), "data_type", seed, by=["category"], out="data_type")


def draw_traits(slots: DataFrame, taxonomy: DataFrame, seed: int = 42) -> DataFrame:
    """Traits map of each slot (id, category): one option of each taxonomy slot without parent, then of those that depend on an option just drawn, and so on to any depth.

    taxonomy: category, slot, parent (an option of the category that it depends on, or null),
    option, and weight if options differ in it; options of weight 0 or less are never drawn.
    Options of one (category, slot, parent) are drawn by weight, each slot by a draw of its own.
    A slot that several drawn options lead to takes the first of them, by depth and name.  How
    deep the taxonomy is, a recursive query over it tells; one that leads back to itself is an
    error.  Slots of categories that the taxonomy lacks have null.
    """
    weight = F.col("weight").cast("double") if "weight" in taxonomy.columns else F.lit(1.0)
    options = taxonomy.select("category", F.col("slot").alias("trait"), "parent", "option", weight.alias("weight")).where("weight > 0")
    group = Window.partitionBy("category", "trait", "parent")
    bounds = options.withColumn("hi", F.sum("weight").over(group.orderBy("option").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("weight").over(group))
    lists = bounds.groupBy("category", "trait", "parent").agg(F.array_sort(F.collect_list(F.struct("hi", "option"))).alias("options"))
    u = uniform(seed, "id", "trait")
    drawn = F.coalesce(F.get(F.filter("options", lambda o: o["hi"] > u), F.lit(0)), F.element_at("options", -1))["option"]
    depth = slots.sparkSession.sql(
        """WITH RECURSIVE reached(category, option, level) AS (
             SELECT DISTINCT category, option, 1 FROM {options} WHERE parent IS NULL
             UNION ALL
             SELECT o.category, o.option, r.level + 1 FROM reached r JOIN {options} o ON o.category = r.category AND o.parent = r.option
           ) SELECT max(level) AS depth FROM reached""",
        options=options,
    ).first().depth  # a taxonomy is a few thousand rows
    level = slots.select("id", "category").join(lists.where("parent is null").drop("parent"), "category").select("id", "category", "trait", F.lit("").alias("parent"), drawn.alias("value"))
    every = level.withColumn("depth", F.lit(1))
    for k in range(2, (depth or 1) + 1):
        above = level.select("id", "category", F.col("value").alias("parent")).distinct()
        level = above.join(lists.where("parent is not null"), ["category", "parent"]).select("id", "category", "trait", "parent", drawn.alias("value"))
        every = every.unionByName(level.withColumn("depth", F.lit(k)))
    one = every.groupBy("id", "trait").agg(F.min(F.struct("depth", "parent", "value"))["value"].alias("value"))
    return slots.join(one.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("trait", "value")))).alias("traits")), "id", "left")


def style_pair(slots: DataFrame, styles: DataFrame, seed: int = 42, kind: str = "counterfactual") -> DataFrame:
    """For slots (id, data_type, traits) of the ``kind`` two styles that differ in one dimension, as traits style_a, style_b and diff_dimension; other slots stay as they are.

    styles: dimension, style_a, style_b.  A dimension is drawn first, each alike, then a pair of it.
    """
    dimensions = styles.select(F.col("dimension").alias("option")).distinct().withColumn("weight", F.lit(1.0))
    pairs = styles.select(F.col("dimension").alias("diff_dimension"), F.struct("style_a", "style_b").alias("option"), F.lit(1.0).alias("weight"))
    found = weighted_choice(slots, dimensions, "style_dimension", seed, out="diff_dimension")
    found = weighted_choice(found, pairs, "style_pair", seed, by=["diff_dimension"], out="_pair")
    styled = F.create_map(F.lit("diff_dimension"), F.col("diff_dimension"), F.lit("style_a"), F.col("_pair.style_a"), F.lit("style_b"), F.col("_pair.style_b"))
    traits = F.coalesce("traits", F.create_map().cast("map<string,string>"))
    return found.withColumn("traits", F.when(F.col("data_type") == kind, F.map_concat(F.map_filter(traits, lambda k, v: ~k.isin("diff_dimension", "style_a", "style_b")), styled)).otherwise(F.col("traits"))).select(*slots.columns)


def turn_count(low: int, high: int, seed: int = 42) -> Column:
    """A whole number from low to high, by id."""
    return (low + pick(uniform(seed, "id", F.lit("turns")), high - low + 1)).cast("int")


def flag(share: float, draw: str, seed: int = 42, when: Column | None = None) -> Column:
    """True for a share of the ids, only where ``when``."""
    hit = uniform(seed, "id", F.lit(draw)) < share
    return hit if when is None else hit & when


def render_prompts(slots: DataFrame, templates: DataFrame) -> DataFrame:
    """The template of (category, data_type), else of the category alone, with {trait} filled from the traits map."""
    exact = templates.where("data_type is not null").select("category", "data_type", F.col("template").alias("own"))
    general = templates.where("data_type is null").select("category", F.col("template").alias("common"))
    j = slots.join(exact, ["category", "data_type"], "left").join(general, "category", "left")
    filled = F.aggregate(F.map_entries(F.coalesce("traits", F.create_map().cast("map<string,string>"))), F.coalesce("own", "common"), lambda a, e: F.replace(a, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return j.withColumn("prompt", filled).drop("own", "common")


def assign_voices(conversations: DataFrame, presets: DataFrame, pool: DataFrame, seed: int = 42, fallback: str = "default") -> DataFrame:
    """A preset and a pool voice for each conversation, uniformly; an empty table gives the fallback.

    Voices are numbered by id, by ranges and offsets.
    """

    def one(df: DataFrame, voices: DataFrame, draw: str) -> DataFrame:
        numbered = dense_numbers(voices.select(F.col("id").alias(draw)), [draw], "_k")
        total = numbered.agg(F.coalesce(F.max("_k_total"), F.lit(0)).alias("_n"))
        k = F.when(F.col("_n") > 0, pick(uniform(seed, "id", F.lit(draw)), F.col("_n")))
        drawn = df.crossJoin(F.broadcast(total)).withColumn("_k", k).join(numbered.drop("_k_total"), "_k", "left")  # one row
        return drawn.withColumn(draw, F.when(F.col("_n") > 0, F.col(draw)).otherwise(fallback)).drop("_k", "_n")

    return one(one(conversations, presets, "assistant_voice"), pool, "user_voice")
