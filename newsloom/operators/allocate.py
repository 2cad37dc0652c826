"""Names given out so that none is held twice, as if one asked after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.tables import checkpointed


def in_turn(wants: DataFrame) -> DataFrame:
    """(key, name) of ``wants`` (key, names, k): the first of its names, from the ``k``-th on, that no smaller key holds; null if there is none.

    All propose at once. A name is held by the smallest key that proposes it, the others go on to their next name, and
    that is repeated until nobody is turned away; a holder gives way if a smaller key comes later. Since all names prefer smaller
    keys, this ends where asking in the order of keys would. Few keys may want the same name, as a task holds a name's proposals;
    the rounds grow with the longest chain of keys that push each other on.
    """
    state = wants.select("key", "names", F.col("k").cast("int").alias("k"))
    while True:
        asking = F.col("k") <= F.size("names")
        proposed = state.where(asking).withColumn("name", F.element_at("names", F.col("k")))
        first = F.min("key").over(Window.partitionBy("name"))
        judged = proposed.withColumn("held", F.col("key") == first)
        over = state.where(~asking).select("key", "names", "k", F.lit(None).cast("string").alias("name"), F.lit(True).alias("held"))
        judged = checkpointed(judged.unionByName(over))
        if judged.where("NOT held").isEmpty():
            return judged.select("key", "name")
        state = judged.select("key", "names", F.when(F.col("held"), F.col("k")).otherwise(F.col("k") + 1).alias("k"))


def free_names(asking: DataFrame, taken: DataFrame) -> DataFrame:
    """(key, names) of ``asking`` (key, names) without the names that ``taken`` (name) holds, in their order."""
    tried = asking.select("key", F.posexplode("names").alias("pos", "name")).join(taken.select("name").distinct(), "name", "left_anti")
    left = tried.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    return asking.select("key").join(left, "key", "left").select("key", F.coalesce("names", F.array().cast("array<string>")).alias("names"))
