"""Retail brands and stores from tracked seeds plus local overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.functions.fixed_values import ARRAY_IDENTIFIERS, OBJECT_IDENTIFIERS, PARSER_FORMATS

JSON_MAP = "map<string,string>"


def _union_arrays(first: Column, second: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_union(F.coalesce(first, empty), F.coalesce(second, empty))


def merge_brand_seeds(tracked: DataFrame, local: DataFrame) -> DataFrame:
    """Brands by slug; local names win, alias lists are united in order; tracked rows come first."""
    t = tracked.select("slug", F.col("name").alias("_t_name"), F.col("aliases").alias("_t_aliases"), F.col("seed_order").alias("_t_order"))
    own = local.select("slug", F.col("name").alias("_l_name"), F.col("aliases").alias("_l_aliases"), F.col("seed_order").alias("_l_order"))
    return t.join(own, "slug", "full_outer").select(
        "slug",
        F.coalesce("_l_name", "_t_name").alias("name"),
        _union_arrays(F.col("_t_aliases"), F.col("_l_aliases")).alias("aliases"),
        F.col("_t_order").isNull().alias("local_only"),
        F.coalesce("_t_order", "_l_order").alias("seed_order"),
    )


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _leaves(frame: DataFrame, key: list[str], column: str, into_lists: bool = False) -> DataFrame:
    """Leaf rows (key, path, kind, json text) of a JSON object column, one level per round.

    Rounds stop at the depth of the data. Each round opens what is nested and passes leaves on in the same
    rows, so that the rounds are one chain over one scan. Lists are leaves, or with
    ``into_lists`` are opened without adding a path step.
    """
    level = frame.where(F.col(column).isNotNull()).select(
        *key, F.array().cast("array<string>").alias("path"), F.parse_json(column).alias("value")
    )
    level = level.select("*", _kind(F.col("value")).alias("kind"))
    nested = ["OBJECT", "ARRAY"] if into_lists else ["OBJECT"]

    def placed(path: Column, value: Column) -> Column:
        return F.struct(path.alias("path"), value.alias("value"), _kind(value).alias("kind"))

    fields = F.map_entries(F.col("value").cast("map<string,variant>"))
    members = F.transform(fields, lambda m: placed(F.concat("path", F.array(m["key"])), m["value"]))
    items = F.transform(F.col("value").cast("array<variant>"), lambda v: placed(F.col("path"), v))
    opened = F.when(F.col("kind") == "OBJECT", members)
    if into_lists:
        opened = opened.when(F.col("kind") == "ARRAY", items)
    opened = opened.otherwise(F.array(F.struct("path", "value", "kind")))
    while not level.where(F.col("kind").isin(nested)).isEmpty():
        level = level.select(*key, F.inline(opened))
    return level.where("kind is not null").select(
        *key, "path", "kind", F.to_json("value").alias("json"), F.when(F.col("kind") == "STRING", F.col("value").cast("string")).alias("text")
    )


def merge_identifier_leaves(tracked: DataFrame, local: DataFrame, key: list[str], column: str = "identifiers") -> DataFrame:
    """Deep merge of nested identifier objects as leaf rows: lists united in order, else local wins.

    A local leaf also replaces everything tracked below the same path, and the reverse.
    """
    t = _leaves(tracked, key, column).select(*key, "path", F.col("json").alias("_t"))
    own = _leaves(local, key, column).select(*key, "path", F.col("json").alias("_l"))
    merged = t.join(own, [*key, "path"], "full_outer")
    both_lists = F.col("_t").startswith("[") & F.col("_l").startswith("[")
    united = F.to_json(_union_arrays(F.from_json("_t", F.lit("array<string>")), F.from_json("_l", F.lit("array<string>"))))
    value = F.when(both_lists, united).otherwise(F.coalesce("_l", "_t"))
    prefixes = own.select(*key, F.col("path").alias("_path")).withColumn(
        "_cut", F.explode(F.sequence(F.lit(1), F.size("_path")))
    ).select(*key, F.expr("slice(_path, 1, _cut)").alias("path"), (F.col("_cut") == F.size("_path")).alias("_whole"))
    shadowed_scalars = prefixes.where("not _whole").select(*key, "path").distinct()
    local_paths = prefixes.where("_whole").select(*key, F.col("path").alias("_lpath")).distinct()
    below = (
        t.select(*key, "path")
        .withColumn("_cut", F.explode(F.sequence(F.lit(1), F.size("path"))))
        .where(F.col("_cut") < F.size("path"))
        .select(*key, "path", F.expr("slice(path, 1, _cut)").alias("_lpath"))
        .join(local_paths, [*key, "_lpath"], "left_semi")
        .select(*key, "path")
        .distinct()
    )
    tracked_only = F.col("_l").isNull()
    kept = merged.where(~tracked_only).unionByName(
        merged.where(tracked_only)
        .join(shadowed_scalars, [*key, "path"], "left_anti")
        .join(below, [*key, "path"], "left_anti")
    )
    return kept.select(*key, F.array_join("path", ".").alias("path"), value.alias("value"))


def merge_store_seeds(tracked: DataFrame, local: DataFrame) -> DataFrame:
    """Stores by (brand slug, location, channel); local scalars win, tracked rows come first."""
    key = ["brand_slug", "location_name", "channel"]
    t = tracked.select(*key, F.col("address").alias("_t_address"), F.col("seed_order").alias("_t_order"))
    own = local.select(*key, F.col("address").alias("_l_address"), F.col("seed_order").alias("_l_order"))
    return t.join(own, key, "full_outer").select(
        *key,
        F.coalesce("_l_address", "_t_address").alias("address"),
        F.col("_t_order").isNull().alias("local_only"),
        F.coalesce("_t_order", "_l_order").alias("seed_order"),
    )


def upsert_dimension(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or overwrite attributes by natural key, as a new snapshot."""
    attributes = [c for c in incoming.columns if c not in keys]
    fresh = incoming.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias("_" + c) for c in attributes])
    return current.join(fresh, keys, "full_outer").select(
        *keys, *[F.when(F.col("_new"), F.col("_" + c)).otherwise(F.col(c)).alias(c) for c in attributes]
    )


def normalize_identifiers(stores: DataFrame, column: str = "identifiers") -> DataFrame:
    """Array keys widened to lists without nulls; violations listed in ``problems``."""
    fields = F.from_json(F.col(column), F.lit(JSON_MAP))
    widened, problems = [], []
    for key in ARRAY_IDENTIFIERS:
        value = F.element_at(fields, key)
        is_list, is_text = value.startswith("["), ~value.rlike("^[\\[{]")
        listed = F.filter(F.from_json(value, F.lit("array<string>")), lambda x: x.isNotNull())
        widened.append(F.when(is_list, listed).when(is_text, F.array(value)).alias(key))
        problems.append(F.when(F.map_contains_key(fields, key) & ~F.coalesce(is_list | is_text, F.lit(False)), F.lit(f"{key} must be an array")))
    for key in OBJECT_IDENTIFIERS:
        value = F.element_at(fields, key)
        widened.append(value.alias(key))
        problems.append(F.when(F.map_contains_key(fields, key) & ~F.coalesce(value.startswith("{"), F.lit(False)), F.lit(f"{key} must be an object")))
    chosen = F.element_at(fields, "default_parser_format")
    problems.append(F.when(F.coalesce(chosen != "", F.lit(False)) & ~chosen.isin(PARSER_FORMATS), F.lit("default_parser_format must be a known format")))
    keep = [c for c in stores.columns if c != column]
    return stores.select(
        *keep, *widened, chosen.alias("default_parser_format"),
        F.filter(F.array(*problems), lambda p: p.isNotNull()).alias("problems"),
    )


def flatten_identifiers(objects: DataFrame, key: list[str], column: str, source: str) -> DataFrame:
    """(key, dotted source path, string) rows of nested hint objects; lists add no path step."""
    leaves = _leaves(objects, key, column, into_lists=True)
    return leaves.where("text is not null").select(
        *key, F.concat_ws(".", F.lit(source), F.array_join("path", ".")).alias("source"), F.col("text").alias("value")
    )
