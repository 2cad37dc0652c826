"""Classification runs: rules first, then a model in batches, then what readers have taught and the floors; with counts, samples and failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from newsloom.functions.text import dedupe_tags, sanitize_category
from newsloom.operators.articles import newest_first
from newsloom.operators.learn import adjustment_for
from newsloom.operators.rules import apply_rules, coverage_floor, decide, default_importance, rule_effect, settle_importance
from newsloom.operators.tables import checkpointed, stored
from newsloom.sources.readers import parse_model_json

BATCH, SAMPLE = 20, 5
_REPLY = "batch long, ids array<long>, text string, error string"


def model_replies(articles: DataFrame, complete: Callable[[pd.DataFrame], str], size: int = BATCH) -> DataFrame:
    """(batch, ids, text, error) of batches of at most ``size`` articles (id, title, url, content_md): what ``complete`` answers, or why it failed.

    A batch is named by its first id. The reply is text; ``model_answers`` reads it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), size):
                some = frame.iloc[i : i + size]
                try:
                    text, error = complete(some), None
                except Exception as e:  # noqa: BLE001  the user's function may fail in any way
                    text, error = None, str(e) or type(e).__name__
                yield pd.DataFrame({"batch": [int(some["id"].iloc[0])], "ids": [some["id"].tolist()], "text": [text], "error": [error]})

    return articles.select("id", "title", "url", "content_md").mapInPandas(run, _REPLY)


def model_answers(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, failures) of ``replies``: (id, category, summary, tags, importance) of articles of the batch that its reply names,
    the last entry of each; and (batch, ids, error) of batches that failed or whose reply holds no list."""
    items = parse_model_json(replies.where("error IS NULL").select(F.struct("batch", "ids").alias("reply"), F.coalesce("text", F.lit("")).alias("text")))
    unread = items.where("error").select("reply.batch", "reply.ids", F.lit("no list in the reply").alias("error"))
    failures = replies.where("error IS NOT NULL").select("batch", "ids", "error").unionByName(unread)
    known = items.where(~F.col("error") & F.array_contains("reply.ids", F.col("item.id")))
    last = known.groupBy(F.col("item.id").alias("id")).agg(F.max_by("item", "place").alias("a"))
    importance = F.when(F.coalesce("a.importance", F.lit(0)).between(0, 3), F.coalesce("a.importance", F.lit(0))).otherwise(1)
    tags = dedupe_tags(F.coalesce("a.tags", F.array().cast("array<string>")))
    return last.select("id", sanitize_category(F.col("a.category")).alias("category"), F.coalesce("a.summary", F.lit("")).alias("summary"), tags.alias("tags"), importance.cast("int").alias("importance")), failures


def _decided(queue: DataFrame, rules: list, coverage: tuple[int, int]) -> DataFrame:
    """The queue with the rules' decisions; what many outlets cover has a floor and goes to the model whatever a rule says."""
    covered = coverage_floor(F.col("story_size"), *coverage)
    own = decide(queue, rules).withColumns({"rule_floor": F.col("floor"), "covered": covered > 0, "by_coverage": covered > F.col("floor")})
    return own.withColumn("floor", F.greatest("floor", covered)).withColumn("to_model", F.col("to_model") | F.col("covered"))


def classify(
    queue: DataFrame, rules: list, learned: DataFrame | None = None, complete: Callable[[pd.DataFrame], str] | None = None, *,
    ids: DataFrame | None = None, rules_only: bool = False, coverage: tuple[int, int] = (3, 2), size: int = BATCH, max_delta: int = 1,
) -> tuple[DataFrame, DataFrame | None]:
    """(outcome, failures): the queue after a run, and (batch, ids, error) of the model's batches that failed (None without a model).

    ``queue`` are articles with story_size; ``ids`` (id) picks some of them, whatever their state. Rules settle what they may, but for
    what is boosted or widely covered. The rest goes to ``complete``, and what that doesn't answer, or all of it in a run of
    ``rules_only``, stays as it was (``by`` is pending); without a model it is general, of default importance (fallback). Last,
    for all of the rest, what readers have taught (``learned``: kind, key, delta) moves the importance by ``max_delta`` at most, and
    then the floors raise it; a rules-only run leaves that out. ``by`` is rules, model, fallback or pending; the flags ``adjusted``, ``boosted``,
    ``by_coverage`` and ``rule_archive`` say what else happened.
    """
    queue = queue if ids is None else queue.join(ids.select("id").distinct(), "id", "left_semi")
    decided = stored(_decided(queue, rules, coverage))
    rest, failures = decided.where("to_model"), None
    by_rules = apply_rules(decided).withColumn("by", F.lit("rules")).withColumns({"adjusted": F.lit(False), "boosted": F.lit(False)})
    if rules_only:
        rest = rest.withColumn("by", F.lit("pending"))
    elif complete is not None:
        answers, failures = model_answers(checkpointed(model_replies(rest, complete, size)))
        new = answers.select("id", F.struct("category", "summary", "tags", "importance").alias("_a"))
        rest = rest.join(new, "id", "left").withColumns({c: F.coalesce(f"_a.{c}", c) for c in ("category", "summary", "tags", "importance")} | {"classified": F.col("classified") | F.col("_a").isNotNull(), "by": F.when(F.col("_a").isNotNull(), "model").otherwise("pending")}).drop("_a")
    else:
        none = F.array().cast("array<string>")
        rest = rest.withColumns({"category": F.lit("general"), "summary": F.lit(""), "tags": none, "importance": default_importance(F.col("title")), "classified": F.lit(True), "by": F.lit("fallback")})
    if rules_only:
        rest = rest.withColumns({"adjusted": F.lit(False), "boosted": F.lit(False)})
    else:
        rest = stored(rest)
        delta = rest.withColumn("delta", F.lit(0)) if learned is None else rest.join(adjustment_for(rest, learned, max_delta), "id", "left")
        rest = delta.withColumn("_s", settle_importance(F.col("importance"), F.coalesce("delta", F.lit(0)), F.col("floor"))).drop("delta", "importance").select("*", "_s.*").drop("_s")
    return by_rules.unionByName(rest), failures


def counted(outcome: DataFrame) -> tuple[DataFrame, Observation]:
    """``outcome`` of a run with counts that are taken while it is written: read them with ``get`` once it has been."""
    counts, by = Observation(), F.col("by")
    is_ = lambda *kinds: F.count_if(by.isin(*kinds))
    own = [
        F.count("*").alias("articles"),
        is_("rules", "model", "fallback").alias("classified"),
        is_("rules").alias("by_rules"),
        is_("model").alias("by_model"),
        is_("fallback").alias("skipped_no_model"),
        is_("pending").alias("pending"),
        F.count_if((by == "rules") & F.col("rule_archive")).alias("archived"),
        F.count_if("boosted").alias("boosted"),
        F.count_if("adjusted").alias("adjusted"),
        F.count_if("by_coverage").alias("by_coverage"),
    ]
    return outcome.observe(counts, *own), counts


def _samples(rows: DataFrame, key: str, most: int) -> DataFrame:
    """(key, sample): the first titles of each key in the order of lists. Only those are kept of a key before rows are shuffled."""
    at = Window.partitionBy(key).orderBy(*newest_first())
    first = rows.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= most)
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "title"))), lambda x: x["title"]).alias("sample"))


def classify_plan(queue: DataFrame, rules: list, learned: DataFrame | None = None, *, coverage: tuple[int, int] = (3, 2), size: int = BATCH, max_delta: int = 1, most: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(plan, claims): what a run would do, without doing it.

    ``plan`` is one row of counts, with ``unmatched``, titles that no rule names. ``claims`` has a row for each rule that compiles, in matching order: (place, rule, name, effect,
    matches, sample). An article counts once, under what happens to it: the boost that raises it, else the rule that acts on it,
    unless many outlets cover it.
    """
    columns = ["id", "title", "published", "fetched_at", "source_id", "tags", "to_model", "rule", "rule_floor", "floor_rule", "covered", "rule_keep", "rule_archive"]
    own = checkpointed(_decided(queue, rules, coverage).select(*columns))
    raised = (F.col("rule_floor") > 0) | F.col("covered")
    own = own.withColumns({"unmatched": F.col("to_model") & ~raised & ~F.col("rule_keep"), "claimed": F.when(F.col("rule_floor") > 0, F.col("floor_rule")).when(~F.col("covered"), F.col("rule"))})
    deltas = own.select("id", F.lit(0).alias("delta")) if learned is None else adjustment_for(own, learned, max_delta)
    n, sent = F.count_if, F.count_if("to_model")
    plan = own.join(deltas, "id", "left").agg(
        F.count("*").alias("pending"),
        n(~F.col("to_model")).alias("by_rules"),
        n(~F.col("to_model") & F.col("rule_archive")).alias("archived"),
        n(F.col("to_model") & ~raised & F.col("rule_keep")).alias("kept"),
        n(F.col("rule_floor") > 0).alias("boosted"),
        n("covered").alias("covered"),
        n(F.col("delta") != 0).alias("learned"),
        n(F.col("delta") > 0).alias("learned_up"),
        sent.alias("to_model"),
        F.ceil(sent / size).alias("batches"),
        F.lit(True).alias("unmatched"),
    )
    some = _samples(own.where("unmatched"), "unmatched", most).withColumnRenamed("sample", "_titles")
    plan = plan.join(some, "unmatched", "left").withColumn("unmatched", F.coalesce("_titles", F.array().cast("array<string>"))).drop("_titles")
    claims = own.where("claimed IS NOT NULL")
    counts = claims.groupBy("claimed").agg(F.count("*").alias("matches")).join(_samples(claims, "claimed", most), "claimed")
    listed = queue.sparkSession.createDataFrame([(i, int(r["id"]), r["name"], r["archive"], r["keep"], r["boost"]) for i, r in enumerate(rules)], "place int, rule int, name string, archive boolean, keep boolean, boost int")
    out = listed.withColumn("effect", rule_effect()).join(counts, F.col("rule") == F.col("claimed"), "left")
    return plan, out.select("place", "rule", "name", "effect", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("sample", F.array().cast("array<string>")).alias("sample"))


def archive_events(outcome: DataFrame, as_of: Column) -> DataFrame:
    """(article_id, event, actor, created_at) of what rules archived in a run: the system's doing, which is never learned from."""
    return outcome.where("by = 'rules' AND rule_archive").select(F.col("id").alias("article_id"), F.lit("archived").alias("event"), F.lit("system").alias("actor"), as_of.alias("created_at"))


def summarize(articles: DataFrame, complete: Callable[[str, str], str], most: int = 3000) -> DataFrame:
    """(id, summary, error) of articles (id, title, content_md): what ``complete(title, body)`` says of each, or why it failed; a body is cut after ``most`` characters."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, title, body in zip(frame["id"], frame["title"], frame["content_md"], strict=True):
                body = body or ""
                try:
                    rows.append((key, complete(title or "", body if len(body) <= most else f"{body[:most]} …"), None))
                except Exception as e:  # noqa: BLE001  the user's function may fail in any way
                    rows.append((key, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["id", "summary", "error"])

    return articles.select("id", "title", "content_md").mapInPandas(run, "id long, summary string, error string")
