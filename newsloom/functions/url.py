"""Canonical urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import trimmed

# Fixed values.
TRACKING_PARAMETERS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_reader", "fbclid", "gclid", "mc_cid", "mc_eid")

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def normalize_url(raw: Column) -> Column:
    """One spelling for urls that differ in case, fragment, tracking parameters, parameter order or one last slash.

    Empty stays empty, null stays null. Parameters are sorted by key, values of one key stay in order.
    """
    u = trimmed(raw)
    part = lambda i: F.regexp_extract(u, _PARTS, i)
    key = lambda kv: F.try_url_decode(F.substring_index(kv, "=", 1))
    value = lambda kv: F.when(F.locate("=", kv) > 0, F.try_url_decode(F.regexp_replace(kv, "^[^=]*=", ""))).otherwise("")
    pairs = F.transform(F.filter(F.split(part(4), "&"), lambda x: x != ""), lambda kv, i: F.struct(key(kv).alias("k"), i.alias("i"), value(kv).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull() & ~F.lower(p["k"]).isin(*TRACKING_PARAMETERS)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    out = F.concat(
        F.when(part(1) != "", F.concat(F.lower(part(1)), F.lit(":"))).otherwise(""),
        F.when(u.rlike(r"^([A-Za-z][A-Za-z0-9+.\-]*:)?//"), F.concat(F.lit("//"), F.lower(part(2)))).otherwise(""),
        part(3),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.when(u == "", "").otherwise(F.regexp_replace(out, "/$", ""))
