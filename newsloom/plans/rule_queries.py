"""Rules, classification and learning over the domain views."""

import json
import uuid

from pyspark.sql import functions as F

from newsloom.operators import classify as K
from newsloom.operators import learn as L
from newsloom.operators import rules as R
from newsloom.operators.records import change_records
from newsloom.operators.tables import apply_changes, checkpointed, shared_folder
from newsloom.plans.article_queries import ART, ORDER, TIME, storied
from newsloom.plans.core import query
from newsloom.plans.ingest_queries import now

RULES = """ru AS (SELECT * FROM f_rules WHERE enabled),
hit AS (SELECT a.id, r.id AS rule, r.archive, r.keep, r.boost, r.category AS rcat, r.importance AS rimp FROM f_articles a JOIN ru r ON regexp_matches(concat(a.title, chr(10), a.author, chr(10), a.url), concat('(?i)', r.query))),
dec AS (SELECT a.id, a.title, a.status, min(h.rule) AS first_rule, min(h.rule) FILTER (h.boost = 0) AS rule, coalesce(max(h.boost), 0) AS floor FROM f_articles a LEFT JOIN hit h ON h.id = a.id GROUP BY ALL),
decided AS (SELECT d.*, coalesce(r.archive, false) AS rule_archive, coalesce(r.keep, false) AS rule_keep, coalesce(r.category, '') AS rule_category, coalesce(r.importance, 0) AS rule_importance,
  d.floor > 0 OR d.rule IS NULL OR coalesce(r.keep, false) AS to_model FROM dec d LEFT JOIN ru r ON r.id = d.rule)"""
_DEFAULT = "CASE WHEN regexp_matches(lower(title), 'openai|anthropic|gpt|gemini|deepmind|meta ai|claude') THEN 2 ELSE 1 END"


def _decided(a, r):
    return R.decide(a, R.valid_rules(r)[0])


def _rule_table(sources):
    """A rule for each source, whose patterns are partly of another dialect or broken."""
    c, kind = F.col("name"), F.col("id") % 4
    pattern = F.when(kind == 0, F.concat(F.lit("("), c)).when(kind == 1, F.concat(c, F.lit("(?=x)"))).when(kind == 2, F.concat(F.lit(r"\p{L}+"), c)).otherwise(c)
    return sources.select("id", "name", pattern.alias("query"), F.when(F.col("id") % 3 == 0, "archive").otherwise("keep").alias("action"), "enabled", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))


_RULE_TABLE = r"rt AS (SELECT id, name, CASE id % 4 WHEN 0 THEN concat('(', name) WHEN 1 THEN concat(name, '(?=x)') WHEN 2 THEN concat('\p{L}+', name) ELSE name END AS query, CASE WHEN id % 3 = 0 THEN 'archive' ELSE 'keep' END AS action, enabled FROM f_sources)".replace("\\\\", "\\")


@query("valid_rules", "f_sources", sql="SELECT id, name, id % 4 IN (2, 3) AS valid FROM f_sources WHERE enabled")
def valid_rules(s):
    good, bad = R.valid_rules(_rule_table(s))
    return s.sparkSession.createDataFrame([(r["id"], r["name"], valid) for rows, valid in ((good, True), (bad, False)) for r in rows], "id int, name string, valid boolean")


@query("parse_actions", "f_articles", sql="SELECT id, category, CAST(importance AS INTEGER) AS importance, CAST(CASE WHEN importance BETWEEN 1 AND 3 THEN importance ELSE 0 END AS INTEGER) AS boost, starred AS keep, array_to_string(tags, ',') AS tags FROM f_articles")
def parse_actions(a):
    action = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    number = F.col("importance").cast("string")
    actions = F.concat(
        F.array(action("category", F.lit("x")), action("category", F.col("category")), action("importance", number), action("importance", F.lit("9")), action("boost", number), action("boost", F.lit("no"))),
        F.transform("tags", lambda t: action("tag", F.concat(F.lit(" "), t))),
        F.when(F.col("starred"), F.array(action("keep", F.lit("")))).otherwise(F.array(action("tag", F.lit(" ")))),
    )
    own = a.select("id", R.parse_actions(actions).alias("p"))
    return own.select("id", "p.category", "p.importance", "p.boost", "p.keep", F.array_join("p.tags", ",").alias("tags"))


@query("rule_matches", "f_articles", "f_rules", sql=f"WITH {RULES} SELECT id, CAST(rule AS INTEGER) AS rule FROM hit")
def rule_matches(a, r):
    return R.rule_matches(a, R.valid_rules(r)[0])


@query("first_rule", "f_articles", "f_rules", sql=f"WITH {RULES} SELECT id, CAST(first_rule AS INTEGER) AS first_rule FROM decided WHERE first_rule IS NOT NULL")
def first_rule(a, r):
    return _decided(a, r).where("first_rule IS NOT NULL").select("id", "first_rule")


@query("decide", "f_articles", "f_rules", sql=f"WITH {RULES} SELECT id, coalesce(CAST(rule AS INTEGER), 0) AS rule, CAST(floor AS INTEGER) AS floor, to_model FROM decided")
def decide(a, r):
    return _decided(a, r).select("id", F.coalesce("rule", F.lit(0)).alias("rule"), "floor", "to_model")


@query("rule_effect", "f_articles", "f_rules", sql=f"WITH {RULES} SELECT h.id, h.rule, CASE WHEN boost > 0 THEN concat('boost ★', boost) WHEN keep THEN 'keep' WHEN archive THEN 'archive' ELSE 'classify' END AS effect FROM hit h")
def rule_effect(a, r):
    return R.rule_matches(a, R.valid_rules(r)[0]).join(r.select(F.col("id").alias("rule"), R.rule_effect().alias("effect")), "rule")


@query("coverage_floor", "f_articles", sql=ART + ", z AS (SELECT story_id, count(*) AS n FROM art WHERE story_id <> 0 GROUP BY 1) SELECT a.id, CASE WHEN coalesce(z.n, 1) >= 3 THEN 2 ELSE 0 END AS floor FROM art a LEFT JOIN z ON z.story_id = a.story_id")
def coverage_floor(a):
    return _sized(a).select("id", R.coverage_floor(F.col("story_size")).alias("floor"))


def _sized(a):
    own = storied(a)
    sizes = own.where("story_id <> 0").groupBy("story_id").agg(F.count("*").alias("story_size"))
    return own.join(sizes, "story_id", "left").withColumn("story_size", F.coalesce("story_size", F.lit(1)))


@query("default_importance", "f_articles", sql=f"SELECT id, {_DEFAULT} AS importance FROM f_articles")
def default_importance(a):
    return a.select("id", R.default_importance(F.col("title")).alias("importance"))


_APPLIED = f"SELECT id, coalesce(nullif(rule_category, ''), 'general') AS category, CAST(CASE WHEN rule_importance > 0 THEN rule_importance ELSE {_DEFAULT} END AS INTEGER) AS importance, CASE WHEN rule_archive THEN 'archived' ELSE status END AS status FROM decided WHERE NOT to_model"


@query("apply_rules", "f_articles", "f_rules", sql=f"WITH {RULES} {_APPLIED}")
def apply_rules(a, r):
    return R.apply_rules(_decided(a, r)).select("id", "category", "importance", "status")


@query("classify_rules_only", "f_articles", "f_rules", sql=f"WITH {RULES} SELECT x.* FROM ({_APPLIED}) x JOIN f_articles a ON a.id = x.id WHERE NOT a.classified")
def classify_rules_only(a, r):
    return R.apply_rules(_decided(a.where("NOT classified"), r)).select("id", "category", "importance", "status")


@query("settle_importance", "f_articles", sql="WITH s AS (SELECT id, importance AS c, greatest(0, least(3, importance + id % 3 - 1)) AS w, id % 4 AS f FROM f_articles) SELECT id, CAST(greatest(w, f) AS INTEGER) AS importance, w <> c AND greatest(w, f) <> c AS adjusted, f > c AND greatest(w, f) = f AS boosted FROM s")
def settle_importance(a):
    s = R.settle_importance(F.col("importance"), (F.col("id") % 3 - 1).cast("int"), (F.col("id") % 4).cast("int"))
    return a.select("id", s.alias("s")).select("id", "s.*")


_COVERED = "z AS (SELECT story_id, count(*) AS n FROM art WHERE story_id <> 0 GROUP BY 1)"
_QUEUE = """q AS (SELECT d.*, a.source_id, a.tags, a.published, a.fetched_at, a.classified, a.category, a.importance, a.summary, CASE WHEN coalesce(z.n, 1) >= 3 THEN 2 ELSE 0 END AS cov,
  d.to_model OR coalesce(z.n, 1) >= 3 AS sent, (SELECT min(h.rule) FROM hit h WHERE h.id = d.id AND h.boost = d.floor) AS floor_rule FROM decided d JOIN art a ON a.id = d.id LEFT JOIN z ON z.story_id = a.story_id)"""
_DELTAS = """ak AS (SELECT id, 'source' AS kind, CAST(source_id AS VARCHAR) AS key FROM f_articles UNION ALL SELECT id, 'tag', unnest(tags) FROM f_articles),
dl AS (SELECT id, greatest(-1, least(1, coalesce(sum(delta), 0))) AS delta FROM ak LEFT JOIN sig USING (kind, key) GROUP BY id)"""
_CLAIMS = """u AS (SELECT *, floor > 0 OR cov > 0 AS raised, CASE WHEN floor > 0 THEN floor_rule WHEN cov = 0 THEN rule END AS claimed FROM q WHERE NOT classified)"""


@query("test_rule", "f_articles", sql=r"SELECT id FROM f_articles WHERE regexp_matches(concat(title, chr(10), author, chr(10), url), '(?i)\bth(e|is)\b.*tion$|src1\.')")
def test_rule(a):
    return R.rule_matches(a, [{"id": 1, "query": r"\bth(e|is)\b.*tion$|src1\."}]).select("id")


def _changed_rules(s):
    table, kind = _rule_table(s), F.col("id") % 5
    op = F.when(kind == 0, "delete").when(kind == 1, "disable").when(kind == 2, "enable").when(kind == 3, "update")
    changes = s.select("id", op.alias("op"), F.lit(None).cast("string").alias("name"), F.concat(F.lit("new "), "name").alias("query"), F.lit(None).cast("boolean").alias("enabled"), F.lit(None).cast("string").alias("action")).where("op IS NOT NULL")
    made = s.where("id % 4 = 0").select("id", F.lit("create").alias("op"), F.concat(F.lit("copy of "), "name").alias("name"), F.col("name").alias("query"), F.lit(False).alias("enabled"), F.lit("archive").alias("action"))
    return change_records(table, changes.unionByName(made), now())


_RULE_CHANGES = f"""{_RULE_TABLE}, changed AS (SELECT id, name, CASE WHEN id % 5 = 3 THEN concat('new ', name) ELSE query END AS query, action, CASE id % 5 WHEN 1 THEN false WHEN 2 THEN true ELSE enabled END AS enabled,
  CASE WHEN id % 5 = 4 THEN timestamp '2024-01-01 00:00:00' ELSE {TIME} END AS updated_at FROM rt WHERE id % 5 <> 0
UNION ALL SELECT (SELECT max(id) FROM rt) + row_number() OVER (ORDER BY id), concat('copy of ', name), name, 'archive', false, {TIME} FROM rt WHERE id % 4 = 0)"""


@query("change_rules", "f_sources", sql=f"WITH {_RULE_CHANGES} SELECT CAST(id AS INTEGER) AS id, name, query, action, enabled, updated_at FROM changed")
def change_rules(s):
    return _changed_rules(s)


@query("list_rules", "f_sources", sql=f"WITH {_RULE_CHANGES} SELECT CAST(id AS INTEGER) AS id, name, enabled, CAST(row_number() OVER (ORDER BY enabled DESC, id) AS INTEGER) AS pos FROM changed")
def list_rules(s):
    """The changed rules as a reader sees them, enabled ones first; a list of at most some hundreds."""
    return R.list_rules(_changed_rules(s)).select("id", "name", "enabled", "pos")


@query("merge_rules", "f_articles", sql="SELECT guid AS name, CASE WHEN NOT classified AND starred THEN 'created' WHEN classified AND NOT starred THEN 'kept' WHEN id % 2 = 0 THEN 'unchanged' ELSE 'updated' END AS outcome FROM f_articles WHERE classified OR starred")
def merge_rules(a):
    own = a.select("id", F.col("guid").alias("name"), F.col("url").alias("query"), F.lit(True).alias("enabled"), F.array(F.struct(F.lit("tag").alias("type"), F.col("category").alias("value"))).alias("actions"), "classified", "starred")
    incoming = own.where("starred").withColumn("enabled", F.col("id") % 2 == 0)
    return R.merge_rules(own.where("classified"), incoming)


_VERDICTS = f"""ev AS (SELECT article_id, bool_or(event = 'read') AS is_read, bool_or(event = 'archived') AS archived, bool_or(event = 'starred') AS starred FROM f_article_events WHERE actor = 'user' GROUP BY 1),
vr AS (SELECT a.id, a.source_id, a.tags, ev.is_read, ev.archived, ev.starred FROM f_articles a JOIN ev ON ev.article_id = a.id WHERE a.fetched_at >= {TIME} - interval 90 day),
k AS (SELECT 'source' AS kind, CAST(source_id AS VARCHAR) AS key, is_read, archived, starred FROM vr UNION ALL SELECT 'tag', unnest(tags), is_read, archived, starred FROM vr),
sg AS (SELECT kind, key, count(*) AS samples, count_if(is_read) / count(*) AS read_rate, count_if(archived AND NOT is_read) / count(*) AS drop_rate, count_if(starred) / count(*) AS star_rate FROM k GROUP BY kind, key),
sig AS (SELECT sg.*, coalesce(f.name, key) AS label, CASE WHEN samples < 5 THEN 0 WHEN star_rate >= 0.2 THEN 1 WHEN drop_rate >= 0.7 AND star_rate < 0.05 THEN -1 ELSE 0 END AS delta FROM sg LEFT JOIN f_sources f ON kind = 'source' AND key = CAST(f.id AS VARCHAR))"""


def _signals(a, e, s):
    return L.signals(L.article_verdicts(a, e, now()), s, min_samples=5)


@query("article_verdicts", "f_articles", "f_article_events", sql=f"WITH {_VERDICTS} SELECT id, is_read, archived, starred FROM vr")
def article_verdicts(a, e):
    return L.article_verdicts(a, e, now()).select("id", "is_read", "archived", "starred")


_LEARN = ("f_articles", "f_article_events", "f_sources")


@query("signals", *_LEARN, sql=f"WITH {_VERDICTS} SELECT kind, key, label, samples, round(read_rate, 6) AS read_rate, round(drop_rate, 6) AS drop_rate, round(star_rate, 6) AS star_rate, CAST(delta AS INTEGER) AS delta FROM sig")
def signals(a, e, s):
    return _signals(a, e, s).select("kind", "key", "label", "samples", *[F.round(c, 6).alias(c) for c in ("read_rate", "drop_rate", "star_rate")], "delta")


@query("adjustments", *_LEARN, sql=f"WITH {_VERDICTS} SELECT kind, key, CAST(delta AS INTEGER) AS delta FROM sig WHERE delta <> 0")
def adjustments(a, e, s):
    return L.store_signals(_signals(a.where("classified"), e, s), _signals(a, e, s)).where("delta <> 0").select("kind", "key", "delta")


@query("adjustment_for", *_LEARN, sql=f"WITH {_VERDICTS}, ak AS (SELECT id, 'source' AS kind, CAST(source_id AS VARCHAR) AS key FROM f_articles UNION ALL SELECT id, 'tag', unnest(tags) FROM f_articles) SELECT id, CAST(greatest(-1, least(1, coalesce(sum(delta), 0))) AS INTEGER) AS delta FROM ak LEFT JOIN sig USING (kind, key) GROUP BY id")
def adjustment_for(a, e, s):
    return L.adjustment_for(a, _signals(a, e, s))


@query("suggest_rules", *_LEARN, sql=f"WITH {_VERDICTS} SELECT concat('learned: ', label) AS name, concat(label, '\\.example\\.com') AS query, false AS enabled FROM sig WHERE kind = 'source' AND delta < 0 AND drop_rate >= 0.85".replace("\\\\", "\\"))
def suggest_rules(a, e, s):
    return L.suggest_rules(_signals(a, e, s), s)


@query("signal_report", *_LEARN, sql=f"WITH {_VERDICTS} SELECT kind, label, samples, CASE WHEN delta > 0 THEN concat('+', delta, '  you keep these') WHEN delta < 0 THEN concat(delta, '  you throw these away') WHEN samples < 5 THEN 'not enough yet' ELSE '—' END AS verdict FROM sig")
def signal_report(a, e, s):
    return L.signal_report(_signals(a, e, s), 5)


_SETTLE = "CAST(greatest(greatest(0, least(3, c + delta)), f) AS INTEGER) AS importance, greatest(0, least(3, c + delta)) <> c AND greatest(greatest(0, least(3, c + delta)), f) <> c AS adjusted, f > c AND greatest(greatest(0, least(3, c + delta)), f) = f AS boosted"
_RUN = ART + f""", {RULES}, {_VERDICTS}, {_COVERED}, {_QUEUE}, sd AS (SELECT a.id, greatest(-1, least(1, coalesce(delta, 0))) AS delta FROM f_articles a LEFT JOIN sig ON kind = 'source' AND key = CAST(a.source_id AS VARCHAR)),
run AS (SELECT q.id, classified, CASE WHEN sent THEN 'fallback' ELSE 'rules' END AS "by", cov > floor AS by_coverage, NOT sent AND rule_archive AS archived, CASE WHEN NOT sent AND rule_importance > 0 THEN rule_importance ELSE {_DEFAULT} END AS c,
  CASE WHEN sent THEN sd.delta ELSE 0 END AS delta, CASE WHEN sent THEN greatest(floor, cov) ELSE 0 END AS f FROM q JOIN sd ON sd.id = q.id), done AS (SELECT *, {_SETTLE} FROM run) """
_MODEL = ART + f""", {RULES}, {_VERDICTS}, {_COVERED}, {_QUEUE}, said AS (SELECT *, sent AND id % 10 NOT IN (3, 5, 7) AS answered FROM q WHERE NOT classified),
new AS (SELECT id, sent, answered, floor, cov, source_id, rule_importance, title, CASE WHEN NOT sent THEN coalesce(nullif(rule_category, ''), 'general') WHEN answered THEN CASE WHEN id % 2 = 0 THEN 'models' ELSE 'general' END ELSE category END AS category,
  CASE WHEN NOT sent THEN [] WHEN answered THEN ['b', 'topic-1'] ELSE tags END AS tags, CASE WHEN NOT sent AND rule_importance > 0 THEN rule_importance WHEN NOT sent THEN {_DEFAULT} WHEN NOT answered THEN importance WHEN id % 6 < 4 THEN id % 6 ELSE 1 END AS c FROM said),
nk AS (SELECT id, 'source' AS kind, CAST(source_id AS VARCHAR) AS key FROM new UNION ALL SELECT id, 'tag', unnest(tags) FROM new), nd AS (SELECT id, greatest(-1, least(1, coalesce(sum(delta), 0))) AS d FROM nk LEFT JOIN sig USING (kind, key) GROUP BY id),
run AS (SELECT new.*, CASE WHEN sent THEN d ELSE 0 END AS delta, CASE WHEN sent THEN greatest(floor, cov) ELSE 0 END AS f FROM new JOIN nd USING (id)), done AS (SELECT *, {_SETTLE} FROM run) """


def _reply(some):
    """A model that fails on articles of ids ending in 3, says no list on 5, speaks of another article on 7 and knows one category."""
    key = int(some["id"].iloc[0])
    if key % 10 == 3:
        raise ValueError("refused")
    if key % 10 == 5:
        return "I can't"
    entry = {"id": key + (key % 10 == 7), "category": " Models" if key % 2 == 0 else "unheard of", "summary": "s", "tags": ["B", "b ", "topic-1"], "importance": key % 6}
    return f"```json\n[{json.dumps(entry)}]\n```"


def _run(a, e, s, r, **options):
    """A run over the queue; where no model reads bodies they aren't carried along."""
    queue = options.pop("queue", _sized(a).where("NOT classified"))
    queue = queue if "complete" in options else queue.drop("content_md")
    return K.classify(queue, R.valid_rules(r)[0], _signals(a, e, s), **options)


@query("classify", *_LEARN, "f_rules", sql=_RUN + 'SELECT id, "by", importance, adjusted, boosted FROM done WHERE NOT classified')
def classify(a, e, s, r):
    return _run(a, e, s, r)[0].select("id", "by", "importance", "adjusted", "boosted")


@query("classify_ids", *_LEARN, "f_rules", sql=_RUN + 'SELECT id, "by", importance FROM done WHERE id % 7 = 0')
def classify_ids(a, e, s, r):
    """A selection by id, classified already or not."""
    return _run(a, e, s, r, queue=_sized(a), ids=a.where("id % 7 = 0").select("id"))[0].select("id", "by", "importance")


@query("model_classify", *_LEARN, "f_rules", sql=_MODEL + "SELECT id, CASE WHEN NOT sent THEN 'rules' WHEN answered THEN 'model' ELSE 'pending' END AS \"by\", category, array_to_string(tags, ',') AS tags, importance, adjusted, boosted FROM done")
def model_classify(a, e, s, r):
    out, _ = _run(a, e, s, r, complete=_reply, size=1)
    return out.select("id", "by", "category", F.array_join("tags", ",").alias("tags"), "importance", "adjusted", "boosted")


@query("model_failures", *_LEARN, "f_rules", sql=_MODEL + "SELECT id AS batch, CASE WHEN id % 10 = 3 THEN 'refused' ELSE 'no list in the reply' END AS error FROM said WHERE sent AND id % 10 IN (3, 5)")
def model_failures(a, e, s, r):
    return _run(a, e, s, r, complete=_reply, size=1)[1].select("batch", "error")


@query(
    "classify_counts",
    *_LEARN,
    "f_rules",
    sql=_RUN + """, c AS (SELECT count(*) AS n, count_if("by" = 'rules') AS r, count_if(archived) AS a, count_if(by_coverage) AS c, count_if(boosted) AS b, count_if(adjusted) AS d FROM done WHERE NOT classified)
SELECT 'fallback' AS run, n AS articles, n AS classified, CAST(r AS BIGINT) AS by_rules, CAST(n - r AS BIGINT) AS skipped_no_model, 0::BIGINT AS pending, CAST(a AS BIGINT) AS archived, CAST(b AS BIGINT) AS boosted, CAST(d AS BIGINT) AS adjusted, CAST(c AS BIGINT) AS by_coverage FROM c
UNION ALL SELECT 'rules only', n, CAST(r AS BIGINT), CAST(r AS BIGINT), 0, CAST(n - r AS BIGINT), CAST(a AS BIGINT), 0, 0, CAST(c AS BIGINT) FROM c""",
)
def classify_counts(a, e, s, r):
    """Counts that are taken while a run's outcome is written, with all the queue and by rules alone."""
    spark, rows = a.sparkSession, []
    for run, only in (("fallback", False), ("rules only", True)):
        outcome, counts = K.counted(_run(a, e, s, r, rules_only=only)[0])
        outcome.write.parquet(f"{shared_folder(spark)}/run-{uuid.uuid4().hex}")
        rows.append({"run": run} | counts.get)
    names = ("articles", "classified", "by_rules", "skipped_no_model", "pending", "archived", "boosted", "adjusted", "by_coverage")
    return spark.createDataFrame([(x["run"], *[x[n] for n in names]) for x in rows], "run string, " + ", ".join(f"{n} long" for n in names))


_SAMPLE = f"array_to_string(list(title ORDER BY {ORDER})[1:5], ' | ')"


@query(
    "classify_plan",
    *_LEARN,
    "f_rules",
    sql=ART + f""", {RULES}, {_VERDICTS}, {_COVERED}, {_QUEUE}, {_DELTAS}, {_CLAIMS}
SELECT count(*) AS pending, count_if(NOT sent)::BIGINT AS by_rules, count_if(NOT sent AND rule_archive)::BIGINT AS archived, count_if(sent AND NOT raised AND rule_keep)::BIGINT AS kept, count_if(floor > 0)::BIGINT AS boosted, count_if(cov > 0)::BIGINT AS covered,
  count_if(delta <> 0)::BIGINT AS learned, count_if(delta > 0)::BIGINT AS learned_up, count_if(sent)::BIGINT AS to_model, CAST(ceil(count_if(sent) / 20) AS BIGINT) AS batches,
  (SELECT {_SAMPLE} FROM u WHERE sent AND NOT raised AND NOT rule_keep) AS unmatched FROM u JOIN dl USING (id)""",
)
def classify_plan(a, e, s, r):
    plan, _ = K.classify_plan(_sized(a).where("NOT classified"), R.valid_rules(r)[0], _signals(a, e, s))
    return plan.withColumn("unmatched", F.array_join("unmatched", " | "))


@query(
    "rule_claims",
    "f_articles",
    "f_rules",
    sql=ART + f""", {RULES}, {_COVERED}, {_QUEUE}, {_CLAIMS}, cl AS (SELECT claimed, count(*) AS n, {_SAMPLE} AS sample FROM u WHERE claimed IS NOT NULL GROUP BY claimed)
SELECT ru.id AS rule, name, CASE WHEN boost > 0 THEN concat('boost ★', boost) WHEN keep THEN 'keep' WHEN archive THEN 'archive' ELSE 'classify' END AS effect, coalesce(n, 0) AS matches, coalesce(sample, '') AS sample FROM ru LEFT JOIN cl ON claimed = ru.id""",
)
def rule_claims(a, r):
    _, claims = K.classify_plan(_sized(a).where("NOT classified"), R.valid_rules(r)[0])
    return claims.select("rule", "name", "effect", "matches", F.array_join("sample", " | ").alias("sample"))


@query("archive_events", *_LEARN, "f_rules", sql=_RUN + f"SELECT id AS article_id, 'archived' AS event, 'system' AS actor, {TIME} AS created_at FROM done WHERE archived AND NOT classified")
def archive_events(a, e, s, r):
    return K.archive_events(_run(a, e, s, r)[0], now())


@query("summarize", "f_articles", sql="SELECT id, CASE WHEN id % 10 = 3 THEN summary ELSE concat('about ', coalesce(length(content_md), 0)) END AS summary, CASE WHEN id % 10 = 3 THEN 'refused' ELSE '' END AS error FROM f_articles")
def summarize(a):
    """Summaries put into the articles; a model that fails leaves what was there."""

    def complete(title, body):
        if body.startswith("refuse"):
            raise ValueError("refused")
        return f"about {len(body)}"

    text = F.when(F.col("id") % 10 == 3, F.lit("refuse")).otherwise(F.col("content_md"))
    said = checkpointed(K.summarize(a.select("id", "title", text.alias("content_md")), complete, most=1 << 30))
    after = apply_changes(a, said.where("summary IS NOT NULL").select("id", "summary"))
    return after.join(said.select("id", "error"), "id").select("id", "summary", F.coalesce("error", F.lit("")).alias("error"))
