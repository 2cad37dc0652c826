"""Streams run over all that has landed, held against their batch twins' SQL."""

from pyspark.sql import functions as F

from newsloom.operators.rules import valid_rules
from newsloom.plans.core import ORACLES, QUERIES
from newsloom.plans.fixtures import oracle, view
from newsloom.plans.ingest_queries import _LOG, now
from newsloom.plans.rule_queries import RULES
from newsloom.streaming import streams as Z
from newsloom.streaming.health import run_health


def _landed(spark, sf_dir, name, *columns):
    """A domain view as a landing folder's stream."""
    folder = f"{Z.work_folder(spark)}/landed"
    own = view(spark, sf_dir, name)
    (own.select(*columns) if columns else own).write.parquet(folder)
    return Z.landing(spark, folder)


def stream_items(spark, sf_dir):
    return Z.run_available(Z.stream_items(_landed(spark, sf_dir, "f_articles", "id", "url", "published"), now(), 14).select("id"))


def stream_dedup(spark, sf_dir):
    items = _landed(spark, sf_dir, "f_articles", "id", "url", "fetched_at").select("id", F.regexp_extract("url", "^https://([^/]*)", 1).alias("url"), F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    return Z.run_available(Z.stream_dedup(items, "400 days")).select("url")


def stream_classify(spark, sf_dir):
    rules, _ = valid_rules(view(spark, sf_dir, "f_rules"))
    out = Z.stream_classify(_landed(spark, sf_dir, "f_articles", "id", "title", "author", "url"), rules)
    return Z.run_available(out.select("id", F.coalesce("rule", F.lit(0)).alias("rule"), "floor", "to_model"))


def stream_triage(spark, sf_dir):
    return Z.run_available(Z.stream_triage(_landed(spark, sf_dir, "f_article_events")), "complete")


def stream_health(spark, sf_dir):
    """Cycles land in six files of five days each, and each is a batch; the stream stops after three and goes on."""
    work, log = Z.work_folder(spark), view(spark, sf_dir, "f_fetch_log")
    part = F.floor(F.datediff("cycle_ts", F.lit("2024-01-01")) / 5)
    for some in ((0, 1, 2), (3, 4, 5)):
        for k in some:
            log.where(F.least(F.greatest(part, F.lit(0)), F.lit(5)) == k).coalesce(1).write.mode("append").parquet(f"{work}/landed")
        out = run_health(Z.landing(spark, f"{work}/landed", 1), work)
    return out.where("warning").select("source_id", "cycle_ts", "outcome")


QUERIES |= {f.__name__: f for f in (stream_items, stream_dedup, stream_classify, stream_triage, stream_health)}
ORACLES |= {
    "stream_items": ORACLES["drop_stale"],
    "stream_dedup": oracle("SELECT DISTINCT regexp_extract(url, '^https://([^/]*)', 1) AS url FROM f_articles"),
    "stream_classify": oracle(f"WITH {RULES} SELECT id, coalesce(CAST(rule AS INTEGER), 0) AS rule, CAST(floor AS INTEGER) AS floor, to_model FROM decided"),
    "stream_triage": ORACLES["replay_events"],
    "stream_health": oracle(_LOG + "SELECT source_id, cycle_ts, outcome FROM s WHERE outcome <> 'ok' AND streak = 3"),
}
