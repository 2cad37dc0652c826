"""Articles of a stream put into stories as they come, against the stories of the last 30 days.

What is known is kept as tables that a batch is joined to, never as articles that are compared again:

- ``words``: the numbers of words, which they keep for good; rarer words have smaller ones, and so have words that come later;
- ``prefixes``: sets of headline words, as their numbers, with their story, under each of their first words in that order, of which two similar
  headlines share one: they are compared where they meet;
- ``hashes``: simhashes with the story of the first article that had them, filed under both 32-bit halves.

Each batch adds a folder to each table, in files by time, so the statistics of what is older than the window keep it from being read; a
folder a day would be a file for each day and task. It reads the folders of the batches before it alone: a batch that runs again finds what it found, and replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.simhash import article_simhash, hamming
from newsloom.functions.text import title_tokens
from newsloom.operators.ingest import HAMMING, PREFIX, coded_headlines, compared_headlines, headline_prefixes
from newsloom.operators.tables import checkpointed, numbered

SHARED, SIMILARITY, WINDOW_DAYS = 4, 0.55, 30
_SCHEMAS = {
    "prefixes": "w int, set long, r array<int>, v array<int>, k int, s long, d int, p int, root long, seen timestamp_ntz, batch long",
    "hashes": "half int, v long, simhash long, first long, root long, seen timestamp_ntz, batch long",
    "ids": "id long, seen timestamp_ntz, batch long",
    "words": "w string, i int, batch long",
    "stories": "id long, story_id long, batch long",
}


class StoryState:
    """The tables in ``folder`` as they stood before a batch, and what a batch writes to them."""

    def __init__(self, spark: SparkSession, folder: str, batch: int):
        self.spark, self.folder, self.batch = spark, folder, batch

    def known(self, name: str, since: object) -> DataFrame:
        """Rows of earlier batches that were seen at ``since`` or later; none if that is null."""
        if not self.batch:
            return self.spark.createDataFrame([], _SCHEMAS[name])
        rows = self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.folder}/{name}")
        at = F.lit(since).cast("timestamp_ntz")
        return rows.where((F.col("batch") < self.batch) & (F.col("seen") >= at))

    def save(self, name: str, rows: DataFrame) -> None:
        rows.repartitionByRange("seen").sortWithinPartitions("seen").write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={self.batch}")

    def numbers(self, words: DataFrame) -> DataFrame:
        """(w, i) of ``words`` (w) and of all that came before; new ones are written with numbers below those."""
        path, after = f"{self.folder}/words", 0
        new = words.groupBy("w").agg((-F.count("*")).alias("n"))
        if self.batch:
            known = self.spark.read.schema(_SCHEMAS["words"]).parquet(path).where(F.col("batch") < self.batch)
            after = known.agg(F.coalesce(F.min("i"), F.lit(0))).first()[0]
            new = new.join(known.select("w"), "w", "left_anti")
        numbered(new, "i", 0, "n", "w").select("w", (F.lit(after) - F.col("i")).cast("int").alias("i")).write.mode("overwrite").parquet(f"{path}/batch={self.batch}")
        return self.spark.read.schema(_SCHEMAS["words"]).parquet(path).where(F.col("batch") <= self.batch).select("w", "i")


def _title_parents(prefixes: DataFrame, state: StoryState, since: object) -> DataFrame:
    """(title_set, parent, root): the most similar earlier headline; ``root`` is its story, null if it is of this batch.

    Pairs are compared under the first word that both have, with their words beside them, and never shuffled.
    """
    sided = lambda side: [F.col(c).alias(f"{c}_{side}") for c in PREFIX]
    new = prefixes.select("w", *sided("y"), F.lit(None).cast("long").alias("root"), F.lit(False).alias("known"))
    old = state.known("prefixes", since).select("w", *sided("y"), "root", F.lit(True).alias("known"))
    good = compared_headlines(prefixes.select("w", *sided("x")), old.unionByName(new), F.col("known") | (F.col("set_y") < F.col("set_x")), SHARED, SIMILARITY)
    # minima of numbers are kept by hash; an earlier headline that came in several batches has one story
    least = good.groupBy(F.col("set_x").alias("title_set"), "score", "root").agg(F.min("set_y").alias("parent"))
    return least.groupBy("title_set").agg(F.min_by(F.struct("parent", "root"), F.struct(-F.col("score"), "parent", F.col("root").isNull())).alias("p")).select("title_set", "p.*")


def _halves(simhash: Column) -> Column:
    return F.array(simhash.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(simhash, 32))


def _hash_parents(filed: DataFrame, state: StoryState, since: object) -> DataFrame:
    """(simhash, parent, root): the earliest first article of a simhash at most three bits away, its own included."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("v").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    asked = filed.select("simhash", "half", F.explode(F.concat(F.array("v"), flips)).alias("v"))
    others = state.known("hashes", since).select("half", "v", F.col("simhash").alias("other"), F.col("first").alias("parent"), "root")
    others = others.unionByName(filed.select("half", "v", F.col("simhash").alias("other"), F.col("first").alias("parent"), F.lit(None).cast("long").alias("root")))
    met = asked.join(others, ["half", "v"]).where(hamming(F.col("simhash"), F.col("other")) <= HAMMING)
    return met.groupBy("simhash").agg(F.min_by(F.struct("parent", "root"), F.struct("parent", F.col("root").isNull())).alias("p")).select("simhash", "p.*")


def _roots(links: DataFrame) -> DataFrame:
    """(id, root) of links (id, parent, root) whose root is known or else that of the parent; a parent without a link is a root."""
    own = links.select("id", F.coalesce("root", "parent").alias("up"), F.col("root").isNotNull().alias("ends"))
    while True:
        own = checkpointed(own)
        if own.where("NOT ends").isEmpty():
            return own.select("id", F.col("up").alias("root"))
        above = own.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("ends").alias("next_ends"))
        joined = own.join(above, "up", "left")
        moves = ~F.col("ends") & F.col("next").isNotNull()
        own = joined.select("id", F.when(moves, F.col("next")).otherwise(F.col("up")).alias("up"), F.when(moves, F.col("next_ends")).otherwise(F.lit(True)).alias("ends"))


def assign_batch(batch: DataFrame, state: StoryState, window_days: int = WINDOW_DAYS) -> DataFrame:
    """(id, story_id) of a batch (id, title, content_md, fetched_at) and of known articles that now lead a story; updates the state.

    The most similar headline wins, else the earliest near-duplicate; articles seen more than ``window_days`` before the batch's
    last don't join, nor does anything join them. Of repeated ids the one fetched last counts, and an id that came in an earlier batch, of
    the window or of the time that this batch's articles are from, is the same article again and is left out. A story of one is 0. All that was known counts as earlier than the
    batch; within it, smaller ids are earlier.
    """
    latest = batch.groupBy("id").agg(F.max(F.struct("fetched_at", "title", "content_md")).alias("a")).select("id", "a.*")
    words = F.array_sort(F.array_distinct(title_tokens(F.coalesce("title", F.lit("")))))
    window = (F.max("fetched_at") - F.make_dt_interval(F.lit(window_days))).cast("timestamp_ntz")
    since, oldest = batch.select(window, F.least(window, F.min("fetched_at").cast("timestamp_ntz"))).first()
    fresh = latest.join(state.known("ids", oldest).select("id"), "id", "left_anti")
    own = checkpointed(fresh.select("id", F.col("fetched_at").cast("timestamp_ntz").alias("seen"), words.alias("t"), article_simhash(F.coalesce("title", F.lit("")), F.coalesce("content_md", F.lit(""))).alias("simhash")))
    sets = checkpointed(own.where(F.size("t") >= SHARED).groupBy("t").agg(F.min("id").alias("title_set"), F.max("seen").alias("seen")))
    words = checkpointed(sets.select(F.col("title_set").alias("set"), "seen", F.explode("t").alias("w")))
    prefixes = checkpointed(headline_prefixes(coded_headlines(words, state.numbers(words), "seen"), SHARED, SIMILARITY))
    by_title = checkpointed(_title_parents(prefixes, state, since))
    of_set = own.where(F.size("t") >= SHARED).select("id", "t").join(sets.select("t", "title_set"), "t").select("id", "title_set")
    titled = of_set.where("id <> title_set").select("id", F.col("title_set").alias("parent"), F.lit(None).cast("long").alias("root")).unionByName(by_title.select(F.col("title_set").alias("id"), "parent", "root"))
    hashes = checkpointed(own.where("simhash <> 0").groupBy("simhash").agg(F.min("id").alias("first"), F.max("seen").alias("seen")))
    filed = hashes.select("simhash", "first", "seen", F.posexplode(_halves(F.col("simhash"))).alias("half", "v"))
    alike = own.where("simhash <> 0").select("id", "simhash").join(_hash_parents(filed, state, since), "simhash").where("root IS NOT NULL OR parent < id").select("id", "parent", "root")
    titled = checkpointed(titled)
    roots = _roots(titled.unionByName(alike.join(titled, "id", "left_anti")))
    leads = roots.select(F.col("root").alias("id")).distinct()
    # an article of the batch that nothing joins has no story; what is joined leads its own
    told = roots.withColumnRenamed("root", "story_id").unionByName(leads.select("id", F.col("id").alias("story_id")))
    stories = own.select("id").join(told, "id", "full_outer").groupBy("id").agg(F.max(F.coalesce("story_id", F.lit(0))).alias("story_id"))
    stories.write.mode("overwrite").parquet(f"{state.folder}/stories/batch={state.batch}")
    root_of = roots.select(F.col("id").alias("first_id"), "root")
    story = F.coalesce("root", "first_id")
    told = prefixes.withColumnRenamed("set", "first_id").join(root_of, "first_id", "left")
    state.save("prefixes", told.select("w", F.col("first_id").alias("set"), *PREFIX[1:], story.alias("root"), "seen"))
    state.save("ids", own.select("id", "seen"))
    firsts = filed.withColumnRenamed("first", "first_id").join(root_of, "first_id", "left")
    state.save("hashes", firsts.select("half", "v", "simhash", F.col("first_id").alias("first"), story.alias("root"), "seen"))
    return state.spark.read.parquet(f"{state.folder}/stories/batch={state.batch}")


def story_batch(folder: str, window_days: int = WINDOW_DAYS) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that puts articles (id, title, content_md, fetched_at) into stories; ``read_stories`` reads them."""

    def run(batch: DataFrame, batch_id: int) -> None:
        assign_batch(batch, StoryState(batch.sparkSession, folder, batch_id), window_days)

    return run


def read_stories(spark: SparkSession, folder: str) -> DataFrame:
    """(id, story_id) of all articles that have come, as of the last batch."""
    return spark.read.schema(_SCHEMAS["stories"]).parquet(f"{folder}/stories").groupBy("id").agg(F.max_by("story_id", F.struct(F.col("story_id") != 0, "batch")).alias("story_id"))
