"""The news domain as views over the driver tables, in one text for Spark and for the SQL oracle.

Placeholders: STR the string type, TS a time literal without zone, LIST( an array, LCAT( array concatenation,
EXPLODE( unnesting. Backslashes in literals are doubled for Spark.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-27 00:00:00"
TABLES = ("documents", "labels", "events", "embeddings", "pages")

VIEWS: dict[str, str] = {
    "f_sources": """
select cast(substring(source, 4) as int) + 1 as id, source as name, concat('https://', source, '.example.com/feed') as url,
  case cast(substring(source, 4) as int) % 4 when 0 then 'hackernews' when 1 then 'arxiv' else 'rss' end as type,
  case when cast(substring(source, 4) as int) % 3 = 0 then 'labs' else 'general' end as group_name,
  cast(substring(source, 4) as int) % 7 <> 6 as enabled, cast(substring(source, 4) as int) = 19 as hidden
from (select distinct source from documents) d""",
    "f_articles": """
select d.doc_id + 1 as id, cast(substring(d.source, 4) as int) + 1 as source_id, concat('g', cast(d.doc_id as STR)) as guid,
  concat('https://', d.source, '.example.com/a/', cast(d.doc_id as STR),
    case d.doc_id % 7 when 0 then '?utm_source=rss&b=1' when 1 then '/' when 2 then '#top' else '' end) as url,
  trim(replace(substring(d.text, 1, 80), chr(10), ' ')) as title,
  case when d.doc_id % 5 = 0 then '' else concat('author', cast(d.doc_id % 13 as STR)) end as author,
  d.text as content_md, case when d.doc_id % 4 = 0 then '' else substring(d.text, 1, 60) end as summary,
  case d.doc_id % 9 when 0 then 'models' when 1 then 'research' when 2 then 'industry' when 3 then 'funding'
    when 4 then 'regulation' when 5 then 'tools' when 6 then 'open-source' when 7 then 'opinion' else '' end as category,
  LIST(concat('topic-', cast(d.doc_id % 23 as STR)), concat('area-', cast(d.doc_id % 23 % 6 as STR)), concat('facet-', cast(d.doc_id % 31 as STR))) as tags,
  cast(coalesce(l.quality, 0) * 2 + d.doc_id % 2 as int) as importance,
  case when d.doc_id % 10 = 0 then 'archived' when d.doc_id % 10 < 4 then 'read' else 'unread' end as status,
  d.doc_id % 9 = 0 as starred, d.doc_id % 3 <> 0 as classified, d.doc_id % 5 = 4 as extracted,
  case when d.doc_id % 17 = 0 then null else TS '2024-01-01 00:00:00' + (d.doc_id % 1440) * interval '37' minute end as published,
  TS '2024-01-01 00:00:00' + (d.doc_id % 1440) * interval '37' minute + interval '10' minute as fetched_at
from documents d left join labels l on l.doc_id = d.doc_id""",
    "f_article_events": """
select e.event_id as id, e.event_id % (select count(*) from documents) + 1 as article_id,
  case when e.event_id % (select count(*) from documents) % 20 < 6
         then case when e.event_type = 'purchase' and e.value < 0.5 then 'starred' else 'archived' end
       when e.event_id % (select count(*) from documents) % 20 < 12
         then case e.event_type when 'view' then 'read' when 'click' then 'starred' when 'error' then 'archived'
              when 'signup' then 'unread' else 'unstarred' end
       else case e.event_type when 'error' then 'archived' else 'read' end end as event,
  case when e.user_id % 5 = 0 then 'system' else 'user' end as actor, e.ts as created_at
from events e""",
    "f_notes": """
select id, 'atom' as note_type, title, concat('note-', cast(id as STR)) as slug, category,
  LCAT(LIST('atom', 'ai'), tags) as tags, tags as wikilinks, fetched_at as created_at
from f_articles where classified and importance >= 2 and status <> 'archived'
union all
select 1000000 + k as id, 'electron' as note_type, concat('Topic ', cast(k as STR)) as title,
  concat('topic-', cast(k as STR)) as slug, '' as category, LIST('ai', 'concept') as tags,
  LIST(concat('area-', cast(k % 6 as STR))) as wikilinks, TS '2024-01-20 00:00:00' as created_at
from (select distinct doc_id % 23 as k from documents) t where k < 8""",
    "f_links": """
select distinct from_note, to_slug, created_at from
 (select id as from_note, EXPLODE(wikilinks) as to_slug, created_at from f_notes) x where to_slug <> ''""",
    "f_mentions": """
select l.to_slug as concept_slug, l.from_note as note_id, l.created_at
from f_links l join f_notes n on n.id = l.from_note where n.note_type = 'atom'""",
    "f_concepts": """
select m.concept_slug as slug, replace(m.concept_slug, '-', '') as canon_key, n.id as note_id,
  count(*) as mentions, min(m.created_at) as first_seen, max(m.created_at) as last_seen
from f_mentions m left join f_notes n on n.slug = m.concept_slug and n.note_type = 'electron'
group by m.concept_slug, n.id""",
    "f_rules": r"""
select * from (values
 (1, 'noise: syllables', '\bonin|\bthwhst', true, false, 0, '', 0, true),
 (2, 'keep: source 7', 'src7\.example', false, true, 0, '', 0, true),
 (3, 'boost: tion', '\btion', false, false, 3, '', 0, true),
 (4, 'classify: openers', '^(is|as|in)\b', false, false, 0, 'tools', 2, true),
 (5, 'noise: edon', '\bedon', true, false, 0, '', 0, true),
 (6, 'off: everything', 'the', true, false, 0, '', 0, false)
) as r(id, name, query, archive, keep, boost, category, importance, enabled)""",
    "f_fetch_log": """
select event_id as id, cast(event_id % 20 as int) + 1 as source_id, ts as cycle_ts,
  case event_type when 'error' then 'failed' when 'signup' then 'empty' else 'ok' end as outcome,
  case event_type when 'error' then 'boom' else '' end as message
from events""",
    "f_vectors": "select case when vec_id % 4 = 0 then 'note' else 'article' end as kind, vec_id as id, embedding from embeddings",
}
SPARK = {"STR": "string", "TS": "timestamp_ntz", "LIST(": "array(", "LCAT(": "concat(", "EXPLODE(": "explode("}
ORACLE = {"STR": "varchar", "TS": "timestamp", "LIST(": "list_value(", "LCAT(": "list_concat(", "EXPLODE(": "unnest("}


def _needed(text: str) -> list[str]:
    """Views that a text names, those they name before them."""
    names: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", text):
            names += [x for x in [*_needed(VIEWS[name]), name] if x not in names]
    return names


def _filled(text: str, words: dict[str, str]) -> str:
    return reduce(lambda t, k: re.sub(rf"(?<!\w){re.escape(k)}(?!\w)" if k[-1] != "(" else re.escape(k), words[k].replace("\\", ""), t), words, text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view or driver table as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needed = _needed(f"{VIEWS[name]} {name}")
    text = _filled("WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed) + f" SELECT * FROM {name}", SPARK).replace("\\", "\\\\")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", text)}
    for t, df in tables.items():
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **tables)


def oracle(sql: str) -> str:
    """A query over domain views as one statement for the oracle; a WITH of its own goes on after the views."""
    needed = _needed(sql)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    if needed and re.match(r"(?i)with\b", body):
        body = re.sub(r"(?i)^with\s+(recursive\s+)?", lambda m: f"WITH {m[1] or ''}{head}, ", body)
    elif needed:
        body = f"WITH {head} {body}"
    return _filled(body, ORACLE)
