"""Ordered regex rules over articles: what each matches, which one decides, and what importance results.

Rules are a short list by nature (a person writes them), so they are compiled into one expression an
article: an array with the place of every rule that matches. ``MAX_RULES`` bounds the expression.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.text import clamp_importance, portable_regex, re2_has

MAX_RULES = 500
# Fixed values.
LAB_WORDS = ("openai", "anthropic", "gpt", "gemini", "deepmind", "meta ai", "claude")


def parse_actions(actions: Column) -> Column:
    """Actions (array of type, value) as one struct: the last category, valid importance and boost win; tags keep their order."""
    of = lambda kind: F.transform(F.filter(actions, lambda a: a["type"] == kind), lambda a: F.trim(a["value"]))
    number = lambda kind, least: F.element_at(F.filter(F.transform(of(kind), lambda v: v.try_cast("int")), lambda n: n.between(least, 3)), -1)
    some = lambda c, otherwise: F.coalesce(c, F.lit(otherwise))
    last = lambda values: F.when(F.size(values) > 0, F.element_at(values, -1))
    safe = lambda kind, least: F.when(F.exists(F.transform(of(kind), lambda v: v.try_cast("int")), lambda n: n.between(least, 3)), number(kind, least))
    return F.struct(
        some(last(of("category")), "").alias("category"),
        F.filter(of("tag"), lambda t: t != "").alias("tags"),
        some(safe("importance", 0), 0).alias("importance"),
        F.exists(actions, lambda a: a["type"] == "archive").alias("archive"),
        F.exists(actions, lambda a: a["type"] == "keep").alias("keep"),
        some(safe("boost", 1), 0).alias("boost"),
    )


def compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether RE2 would take a pattern, and the regex engine of Spark's JVM its translation; no job runs."""
    if not re2_has(pattern):
        return False
    try:
        spark._jvm.java.util.regex.Pattern.compile(portable_regex(pattern))
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def valid_rules(rules: DataFrame) -> tuple[list, list]:
    """Enabled rules of a name and a pattern that compiles, by id; and those whose pattern doesn't. Collected: at most ``MAX_RULES``."""
    rows = rules.where("enabled AND trim(name) <> '' AND trim(query) <> ''").orderBy("id").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    good, bad = [], []
    for r in rows:
        (good if compiles(rules.sparkSession, r["query"]) else bad).append(r)
    return good, bad


def haystack() -> Column:
    return F.concat_ws("\n", "title", "author", "url")


def matches(rules: list) -> Column:
    """Places in ``rules`` of those that match the article, in order."""
    hits = [F.when(haystack().rlike(portable_regex(r["query"])), F.lit(i)) for i, r in enumerate(rules)]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")


def _value(rules: list, place: Column, column: str, kind: str) -> Column:
    of = lambda r: F.lit(r[column] if column in r else [])  # noqa: E731  rules without tags give none
    values = F.array(*[of(r).cast(kind) for r in rules]) if rules else F.array().cast(f"array<{kind}>")
    return F.get(values, place)


def decide(articles: DataFrame, rules: list) -> DataFrame:
    """``articles`` with the deciding rule (first match that isn't a boost), the floor of all matching boosts and what names it, and to_model."""
    boosts = [i for i, r in enumerate(rules) if r["boost"] > 0]
    found = articles.withColumn("_m", matches(rules))
    boosting = F.filter("_m", lambda i: i.isin(*boosts)) if boosts else F.array().cast("array<int>")
    found = found.withColumns({"_b": boosting, "_a": F.get(F.filter("_m", lambda i: ~i.isin(*boosts)) if boosts else F.col("_m"), F.lit(0))})
    level = lambda i: _value(rules, i, "boost", "int")
    found = found.withColumn("floor", F.coalesce(F.array_max(F.transform("_b", level)), F.lit(0)))
    named = F.get(F.filter("_b", lambda i: level(i) == F.col("floor")), F.lit(0))
    out = {
        "first_rule": _value(rules, F.get("_m", F.lit(0)), "id", "int"),
        "rule": _value(rules, F.col("_a"), "id", "int"),
        "floor_rule": _value(rules, named, "id", "int"),
        "rule_archive": F.coalesce(_value(rules, F.col("_a"), "archive", "boolean"), F.lit(False)),
        "rule_keep": F.coalesce(_value(rules, F.col("_a"), "keep", "boolean"), F.lit(False)),
        "rule_category": F.coalesce(_value(rules, F.col("_a"), "category", "string"), F.lit("")),
        "rule_importance": F.coalesce(_value(rules, F.col("_a"), "importance", "int"), F.lit(0)),
        "rule_tags": F.coalesce(_value(rules, F.col("_a"), "tags", "array<string>"), F.array().cast("array<string>")),
    }
    found = found.withColumns(out)
    return found.withColumn("to_model", (F.col("floor") > 0) | F.col("rule").isNull() | F.col("rule_keep")).drop("_m", "_b", "_a")


def list_rules(rules: DataFrame) -> DataFrame:
    """Rules with their place (``pos``) in a list, enabled ones first, then by id; there are at most ``MAX_RULES``."""
    first = rules.orderBy(F.desc("enabled"), "id").limit(MAX_RULES)
    return first.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("enabled"), "id")))


def rule_matches(articles: DataFrame, rules: list) -> DataFrame:
    """(id, rule) of every match."""
    return articles.select("id", F.explode(matches(rules)).alias("_i")).select("id", _value(rules, F.col("_i"), "id", "int").alias("rule"))


def rule_effect() -> Column:
    """What a rule does, in a word: boost wins over keep, archive and classify."""
    return F.when(F.col("boost") > 0, F.concat(F.lit("boost ★"), F.col("boost"))).when(F.col("keep"), "keep").when(F.col("archive"), "archive").otherwise("classify")


def coverage_floor(story_size: Column, sources: int = 3, floor: int = 2) -> Column:
    return F.when((F.lit(sources) > 0) & (F.lit(floor) > 0) & (story_size >= sources), floor).otherwise(0)


def default_importance(title: Column) -> Column:
    return F.when(F.lower(title).rlike("|".join(LAB_WORDS)), 2).otherwise(1)


def apply_rules(decided: DataFrame) -> DataFrame:
    """Rows that a rule settles, with its category, importance (0 is unset), tags and status, and without entities; the rest is left out."""
    importance = F.when(F.col("rule_importance") > 0, F.col("rule_importance")).otherwise(default_importance(F.col("title")))
    new = {
        "category": F.coalesce(F.nullif("rule_category", F.lit("")), F.lit("general")),
        "importance": importance,
        "status": F.when(F.col("rule_archive"), "archived").otherwise(F.col("status")),
        "classified": F.lit(True),
        "tags": F.col("rule_tags"),
    }
    if "entities" in decided.columns:
        new["entities"] = F.array().cast(decided.schema["entities"].dataType)
    return decided.where("NOT to_model").withColumns(new)


def settle_importance(current: Column, delta: Column, floor: Column) -> Column:
    """(importance, adjusted, boosted): the learned delta within 0 to 3, then the floor."""
    want = clamp_importance(current + delta)
    final = F.greatest(want, floor)
    return F.struct(final.alias("importance"), ((want != current) & (final != current)).alias("adjusted"), ((floor > current) & (final == floor)).alias("boosted"))


def merge_rules(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(name, outcome): created, updated, unchanged or kept, by name; query, enabled and actions make the difference."""
    s = stored.select("name", F.struct("query", "enabled", "actions").alias("_s"))
    i = incoming.select("name", F.struct("query", "enabled", "actions").alias("_i"))
    outcome = F.when(F.col("_s").isNull(), "created").when(F.col("_i").isNull(), "kept").when(F.col("_s") == F.col("_i"), "unchanged").otherwise("updated")
    return s.join(i, "name", "full_outer").select("name", outcome.alias("outcome"))
