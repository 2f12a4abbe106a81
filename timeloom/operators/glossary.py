"""Glossaries: validation as constraint queries, protected forms, prompts, comparison of casts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from timeloom.functions.text import actor_key, first_name, phrase_key

# --- fixed values ---
ROLES = ["lead", "main", "recurring", "guest"]
GENDERS = ["female", "male", "unknown"]


def fold_name(text: str | None) -> str:
    """Accents and case make no difference, nor dotless i; single spaces."""
    bare = unicodedata.normalize("NFKD", (text or "").replace("ı", "i").replace("İ", "I"))
    return " ".join("".join(c for c in bare if not unicodedata.combining(c)).casefold().split())


@F.pandas_udf(StringType())
def name_key(text: pd.Series) -> pd.Series:
    return text.map(fold_name)


@F.pandas_udf(ArrayType(StringType()))
def name_keys(names: pd.Series) -> pd.Series:
    return names.map(lambda xs: [fold_name(x) for x in ([] if xs is None else xs)])


def rank_of(role: Column, roles: list[str] = ROLES) -> Column:
    """Place of a role in order of importance, from 0; null for none of them."""
    return F.nullif(F.array_position(F.array(*[F.lit(r) for r in roles]), role), F.lit(0)) - 1


def by_importance(characters: DataFrame, *within: str, roles: list[str] = ROLES) -> DataFrame:
    """Characters with `place`: by role, then the number of episodes, then as they stand."""
    by = Window.partitionBy(*within).orderBy(rank_of(F.col("role"), roles), F.desc("episodes"), "ord")
    return characters.withColumn("place", F.row_number().over(by))


def lint_characters(characters: DataFrame, roles: list[str] = ROLES, genders: list[str] = GENDERS) -> DataFrame:
    """(ord, problem) for rows without a required field or with an unknown role or gender."""
    missing = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"{c} is missing")) for c in ("name", "actor", "gender", "role")]
    unknown = [F.when(~F.col("gender").isin(genders), F.lit("unknown gender")), F.when(~F.col("role").isin(roles), F.lit("unknown role"))]
    return characters.select("ord", F.explode(F.array_compact(F.array(*missing, *unknown))).alias("problem"))


def lint_corrections(corrections: DataFrame) -> DataFrame:
    bad = F.coalesce(F.col("heard"), F.lit("")) == ""
    return corrections.where(bad | (F.coalesce(F.col("correct"), F.lit("")) == "")).select("ord", F.lit("heard and correct are needed").alias("problem"))


def phrase_conflicts(phrases: DataFrame) -> DataFrame:
    """Keys that the map gives two different translations."""
    rows = phrases.groupBy(phrase_key(F.col("tr")).alias("key")).agg(F.countDistinct("en").alias("translations"))
    return rows.where(F.col("translations") > 1)


def protected_forms(entities: DataFrame) -> DataFrame:
    """(form, canonical, k, placeholder): forms of more than two letters, the first of each folded spelling, numbered in order."""
    rows = entities.where(F.length("form") > 2).withColumn("_key", F.lower("form"))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("ord"))).where(F.col("_n") == 1)
    numbered = first.withColumn("k", F.row_number().over(Window.orderBy("ord")) - 1)  # a hand-made list
    return numbered.select("form", "canonical", "k", placeholder(F.col("k")).alias("placeholder"))


def placeholder(k: Column) -> Column:
    return F.concat(F.lit("X"), F.char(F.lit(97) + F.floor(k / 26)), F.char(F.lit(97) + k % 26))


def prompt(characters: DataFrame, limit: int = 300, roles: list[str] = ROLES) -> DataFrame:
    """Names for a recogniser, the most important first, each once, as many as fit; one that doesn't fit is passed over."""
    rank = rank_of(F.col("role"), roles)
    first = first_name(F.col("name"))
    forms = F.concat(F.array(first), F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: ~F.contains(a, F.lit(" ")) & (a != first)))
    ordered = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), (-F.col("episodes")).alias("n"), F.col("ord"), forms.alias("forms"))))
    rows = characters.groupBy("series_id").agg(F.flatten(F.transform(ordered, lambda x: x["forms"])).alias("forms"))
    take = lambda acc, f: F.when(~F.array_contains(acc, f) & (F.length(F.array_join(F.concat(acc, F.array(f)), ", ")) <= limit), F.concat(acc, F.array(f))).otherwise(acc)
    return rows.select("series_id", F.array_join(F.aggregate("forms", F.array().cast("array<string>"), take), ", ").alias("prompt"))


def compare_casts(curated: DataFrame, fetched: DataFrame, key: Column) -> dict[str, DataFrame]:
    """Fetched rows (source, actor, character, episodes, norm) whose actor is not curated, or whose character or episode count differs.

    curated: actor, name, episodes, norm, name_norm, alias_norms, ord; `key` gives both sides' join key from norm. Of curated rows with
    one key the last counts. Keys are spread evenly, and the smaller side is broadcast only if the planner knows it to be small.
    """
    known = curated.withColumn("key", key).groupBy("key").agg(F.max(F.struct("ord", "actor", "name", "episodes", "name_norm", "alias_norms")).alias("c"))
    rows = fetched.withColumn("key", key)
    missing = rows.join(known, "key", "left_anti").select("source", "actor", "character", "episodes")
    both = rows.join(known, "key")
    ch, name = F.col("character_norm"), F.col("c.name_norm")
    same = F.contains(name, ch) | F.contains(ch, name) | F.exists("c.alias_norms", lambda a: F.contains(ch, a))
    differs = both.where((ch != "") & ~same).select("source", F.col("c.actor").alias("actor"), F.col("c.name").alias("curated"), F.col("character").alias("api"))
    counts = both.where((F.col("source") == "tmdb") & (F.col("episodes") != 0) & (F.col("c.episodes") != 0) & (F.col("episodes") != F.col("c.episodes")))
    return {"missing": missing, "name_differs": differs, "count_differs": counts.select(F.col("c.actor").alias("actor"), F.col("c.episodes").alias("curated"), F.col("episodes").alias("fetched"))}


def key_of_actor(normalised: str = "norm") -> Column:
    return actor_key(F.col(normalised))


def merge_episodes(english: DataFrame, turkish: DataFrame) -> DataFrame:
    """Episodes of one list with titles of the other by number; what is missing or empty is null."""
    last = turkish.groupBy("episode").agg(F.max_by(F.struct("title", "overview"), "ord").alias("t"))
    rows = english.join(last, "episode", "left")
    return rows.select("episode", F.nullif("t.title", F.lit("")).alias("title_tr"), F.nullif("title", F.lit("")).alias("title_en"), F.nullif("t.overview", F.lit("")).alias("overview_tr"), F.nullif("overview", F.lit("")).alias("overview_en"))
