"""URL verdicts: listed rules first, then logistic regression on hashed character n-grams of host and path.

The model is fitted with Spark ML on a small labelled URL table. Its weights are a constant array of
``SLOTS`` doubles in the scoring expression, so judging urls is one projection without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import table, unused

SLOTS, GRAMS, THRESHOLD, PENALTY = 1 << 15, (3, 4, 5), 0.5, 3e-6
#: Of a row labelled as allowed: most urls are, and a url of unknown n-grams is taken for one.
ALLOWED_WEIGHT = 5.0

#: The labelled URL table: hosts of spam, pills, gambling, advertising, adult content, piracy and scams, and ordinary ones.
BLOCKED_HOSTS = """
cheap-meds.example.com www.discount-pills.example.net online-pills.example.org blog.pills-store.example.com pharmacy-cheap.example.net m.cheap-viagra.example.org
spam-links.example.com www.link-farm.example.net spamfarms.example.org blog.web-spam.example.com m.content-farm.example.net seo-spam.example.org
casino-bonus.example.com www.online-casino.example.net win-jackpot.example.org m.casino-slots.example.com poker-win.example.net blog.big-win.example.org
sports-bets.example.com www.best-bets.example.net free-spins.example.org m.live-bets.example.com free-money.example.net betting-free.example.org
ads-server.example.com www.ad-track.example.net tracking-pixel.example.org m.click-ads.example.com banner-ads.example.net blog.ads-network.example.org
adult-cams.example.com www.xxx-adult.example.net adult-videos.example.org blog.porn-x.example.com m.sex-dating.example.net x-rated.example.org
cracked-warez.example.com www.torrent-free.example.net keygen-crack.example.org replica-watches.example.com payday-loans.example.net get-rich-fast.example.org
""".split()
ALLOWED_HOSTS = """
www.example.com example.org blog.example.net news.example.com docs.example.org m.weather.example.net university.example.com www.library.example.org
blog.anderson.example.com thinking.example.net m.edison.example.org www.thornton.example.com henderson.example.net blog.interior.example.org
orchestra.example.com www.rationale.example.net stationery.example.org m.harbour.example.com another.example.net blog.thesis.example.org
astronomy.example.com www.garden.example.net theatre.example.org m.recipes.example.com physics.example.net blog.history.example.org
council.example.com www.parliament.example.net open-source.example.org m.northern-times.example.com city-museum.example.net blog.maps.example.org
www.thread.example.com ethernet.example.net weather.example.org blog.mother.example.com m.thirteen.example.net www.leather.example.org
gathering.example.com blog.northwest.example.net heritage.example.org m.the-editor.example.com train-station.example.net www.tension.example.org
""".split()
PATHS = ("/", "/en/120", "/fr/345/", "/de/67.html", "/es/890", "/news/2024/01", "/en/431.html")
BLOCKED_PATHS = ("/buy/cheap-pills", "/casino/free-spins", "/xxx/porn", "/viagra/order", "/bets/win")


@dataclass(frozen=True)
class Rule:
    """``host`` holds for itself and its subdomains, for paths that start with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)([^?#]*)", group)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(_part(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return _part(url, 2)


def _slots(text: Column, offset: int) -> Column:
    """Slots of the character n-grams of a text between marks; half of all slots are the host's, half the path's."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    length, half = F.length(marked), SLOTS // 2

    def grams(n: int) -> Column:
        starts = F.when(length >= n, F.sequence(F.lit(1), F.greatest(length - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: (F.pmod(F.xxhash64(F.substr(marked, i, F.lit(n))), F.lit(half)) + offset).cast("int"))

    return F.concat(*[grams(n) for n in GRAMS])


def _features(h: Column, p: Column) -> Column:
    return F.concat(_slots(h, 0), _slots(p, SLOTS // 2))


def fit_url_model(labelled: DataFrame) -> list[float]:
    """Weights of all slots, from a small table (url, label: 1 is blocked); features are n-gram frequencies.

    There is no intercept: unknown n-grams weigh nothing, so a url of such only is at 0.5 and allowed.
    """
    slots = F.transform(_features(host(F.col("url")), path(F.col("url"))), lambda i: i.cast("string"))
    weight = F.when(F.col("label") == 1, 1.0).otherwise(ALLOWED_WEIGHT)
    rows = labelled.select(F.col("label").cast("double").alias("label"), weight.alias("weight"), slots.alias("slots")).coalesce(1)
    counts = CountVectorizer(inputCol="slots", outputCol="counts", vocabSize=SLOTS).fit(rows)
    scaled = Normalizer(inputCol="counts", outputCol="features", p=1.0).transform(counts.transform(rows))
    model = LogisticRegression(regParam=PENALTY, standardization=False, maxIter=100, weightCol="weight", fitIntercept=False).fit(scaled.cache())
    scaled.unpersist()
    weights = [0.0] * SLOTS
    for slot, w in zip(counts.vocabulary, model.coefficients.toArray().tolist(), strict=True):
        weights[int(slot)] = round(w, 6)
    return weights


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled URL table (url, label): each listed host with ordinary paths, and ordinary hosts with paths of blocked topics."""
    urls = [(f"http://{h}{PATHS[(i + k) % len(PATHS)]}", label) for label, hosts in ((1, BLOCKED_HOSTS), (0, ALLOWED_HOSTS)) for i, h in enumerate(hosts) for k in (0, 3)]
    urls += [(f"http://{h}{p}", 1) for h in ALLOWED_HOSTS[::8] for p in BLOCKED_PATHS]
    values = ", ".join(f"('{u}', {label})" for u, label in urls)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], weights: list[float], column: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (or null), ``score`` (probability of block) and ``verdict``.

    The longest rule that fits decides (of equal length: the first given); without one, the model does, at
    ``THRESHOLD``. Null url or one without ``://``: empty host and path, judged by the model. Rules are a short
    list, each an expression; columns named like a new one are replaced; each row is judged alone.
    """
    h, p = host(F.col(column)), path(F.col(column))
    ordered = sorted(rules, key=lambda r: -len(r.name))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "score", "verdict")]
    host_, path_, slots_, action_ = unused([*kept, "rule", "score"], "_host", "_path", "_slots", "_action")
    fits = lambda r: (F.col(host_).eqNullSafe(r.host) | F.endswith(host_, F.lit(f".{r.host}"))) & F.startswith(path_, F.lit(r.path))
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ordered):
        rule, action = F.when(fits(r), r.name).otherwise(rule), F.when(fits(r), r.action).otherwise(action)
    array = F.from_json(F.lit(str(weights)), "array<double>")
    total = F.aggregate(slots_, F.lit(0.0), lambda sum_, i: sum_ + F.get(array, i))
    margin = F.when(F.size(slots_) > 0, total / F.size(slots_)).otherwise(0.0)
    parts = pages.select(*kept, h.alias(host_), p.alias(path_))
    slots = parts.select("*", _features(F.col(host_), F.col(path_)).alias(slots_))
    scored = slots.select(*kept, host_, path_, rule.alias("rule"), action.alias(action_), (1 / (1 + F.exp(-margin))).alias("score"))
    verdict = F.coalesce(action_, F.when(F.col("score") > THRESHOLD, "block").otherwise("allow"))
    return scored.select(*kept, F.col(host_).alias("host"), F.col(path_).alias("path"), "rule", "score", verdict.alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_url_model(labelled_urls(spark))
    out = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, model)
    return out.select("page_id", "host", "path", "rule", "verdict", "score")
