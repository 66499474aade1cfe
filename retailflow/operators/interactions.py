"""From processed tables to weighted interactions, dictionaries and a split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailflow.functions import clean as C


@dataclass(frozen=True)
class Config:
    """Weights, split and model parameters."""

    purchase: float = 5.0
    favorite: float = 3.0
    view: float = 1.0
    min_events: int = 2
    top_k: int = 20
    dims: int = 64
    epochs: int = 20
    batch: int = 4096
    rate: float = 2e-3
    decay: float = 1e-6
    penalty: float = 1e-4
    seed: int = 42
    ease_l2: float = 200.0
    ease_items: int = 15_000


def events(orders: DataFrame, favorites: DataFrame, views: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(user, item, ts, w, src, pos) of all three tables, as they come.

    Purchases weigh by quantity from 1 to 10; views of categories aren't interactions; rows
    without user or item are left out; an undated row is of 1970. src and pos order events
    of the same time: orders before favourites before views, then by the tables' own pos
    where all have it, else as Spark reads them.
    """
    parts = [
        (orders, F.lit(cfg.purchase) * C.clipped_quantity("qty"), 0),
        (favorites, F.lit(cfg.favorite), 1),
        (views.where(F.col("item_type") == C.IS_ITEM), F.lit(cfg.view), 2),
    ]
    out, placed = None, all("pos" in df.columns for df, _, _ in parts)
    for df, w, src in parts:
        pos = F.col("pos") if placed else F.monotonically_increasing_id()
        one = df.select(F.col("customer_id").alias("user"), F.col("item_code").alias("item"), C.timestamp_or_epoch("event_date").alias("ts"), F.coalesce(w, F.lit(1.0)).alias("w"), F.lit(src).alias("src"), pos.alias("pos"))
        out = one if out is None else out.unionByName(one)
    return out.dropna(how="any", subset=["user", "item"])


def ids(events: DataFrame, key: str) -> DataFrame:
    """(key, idx): distinct ids numbered from 0 in their order.

    Numbers come from range partitions: a count of each, then a number within.
    """
    spark = events.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = events.select(key).distinct().repartitionByRange(n, key).sortWithinPartitions(key)
    numbered = distinct.withColumn("_p", F.spark_partition_id())
    # a row for each partition
    counts = numbered.groupBy("_p").count()
    before = counts.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_before"))
    within = Window.partitionBy("_p").orderBy(key)
    return numbered.join(F.broadcast(before), "_p").select(key, (F.row_number().over(within) - 1 + F.col("_before")).cast("int").alias("idx"))


def split(events: DataFrame, min_events: int = 2) -> tuple[DataFrame, DataFrame]:
    """(train, holdout): the last event of each user of enough events is held out, all
    other events are summed by user and item.

    Events are added up by user and item where they are, with the last of each pair; of
    these a user's last is found. Its weight then goes from its pair, and the pair itself if
    it has no other event. So no user's events are ever sorted, or meet in one task. Of
    events of the same time, table and place the one of the greatest item and weight is last.
    """
    last = F.max(F.struct("ts", "src", "pos", "w"))
    pairs = events.groupBy("user", "item").agg(F.sum("w").alias("w"), F.count("*").alias("n"), last.alias("last"))
    own = F.struct(*[F.col(f"last.{c}").alias(c) for c in ("ts", "src", "pos")], "item", F.col("last.w").alias("w"))
    users = pairs.groupBy("user").agg(F.sum("n").alias("n"), F.max(own).alias("last")).where(F.col("n") >= min_events)
    out = users.select("user", F.col("last.item").alias("item"), F.col("last.w").alias("_w"))
    left = pairs.join(out, ["user", "item"], "left").withColumn("n", F.col("n") - F.col("_w").isNotNull().cast("int"))
    train = left.where("n > 0").select("user", "item", (F.col("w") - F.coalesce("_w", F.lit(0.0))).alias("w"))
    return train, out.select("user", "item")


def positives(train: DataFrame) -> DataFrame:
    return train.groupBy("user").agg(F.array_sort(F.collect_set("item")).alias("items"))


def unseen_holdout(train: DataFrame, holdout: DataFrame) -> DataFrame:
    """Held-out pairs that aren't in train as well."""
    return holdout.join(train, ["user", "item"], "left_anti")


def profile(events: DataFrame, user) -> DataFrame:
    """Summed weights of one user's items, held-out events included."""
    return events.where(F.col("user") == F.lit(user)).groupBy("item").agg(F.sum("w").alias("w"))


def known_items(profile: DataFrame, items: DataFrame) -> DataFrame:
    """What of a profile is about items of a model, (item, idx)."""
    return profile.join(items.select("item"), "item", "left_semi")


def gram(train: DataFrame, heavy: int = 1000) -> DataFrame:
    """(i, j, g): item co-occurrence, the weights' products summed over users.

    A user's items are dealt into parts of about `heavy`, and each part meets all of the
    user's items in a key of its own; so a user of very many items is work for many tasks.
    """
    parts = train.groupBy("user").agg(F.ceil(F.count("*") / heavy).cast("int").alias("_parts"))
    dealt = train.join(parts, "user")
    left = dealt.select("user", F.pmod(F.xxhash64("item"), F.col("_parts")).cast("int").alias("_part"), F.col("item").alias("i"), "w")
    right = dealt.select("user", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("item").alias("j"), F.col("w").alias("_v"))
    # else the join's partitioning by user would serve, and put all parts of one in one task
    left, right = (df.repartition("user", "_part") for df in (left, right))
    return left.join(right, ["user", "_part"]).groupBy("i", "j").agg(F.sum(F.col("w") * F.col("_v")).alias("g"))


def metrics(ranked: DataFrame, holdout: DataFrame, k: int = 20) -> DataFrame:
    """recall@k and ndcg@k over held-out users; a user without the item in the list counts 0."""
    hit = holdout.join(ranked.where(F.col("rank") <= k), ["user", "item"], "left")
    gain = F.when(F.col("rank").isNotNull(), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    return hit.agg(
        F.coalesce(F.avg(F.col("rank").isNotNull().cast("double")), F.lit(0.0)).alias("recall"), F.coalesce(F.avg(gain), F.lit(0.0)).alias("ndcg"), F.count("*").alias("users")
    )


def draw(seed: int, *salt) -> Column:
    """A number from 0 below 2^32 for each (user, item), the same however rows are dealt."""
    text = F.concat_ws(":", F.col("user").cast("string"), F.col("item").cast("string"), F.lit(str(seed)), *[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in salt])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def weighted_sample(train: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, drawn by weight; all if there are no more than n."""
    key = F.log((draw(seed) + 0.5) / float(1 << 32)) / F.col("w")
    return train.withColumn("_key", key).orderBy(F.desc("_key"), "user", "item").limit(n).drop("_key")


def uniform_negatives(train: DataFrame, items: DataFrame, each: int = 1, seed: int = 42, rounds: int = 25) -> DataFrame:
    """For every positive pair `each` random items that the user hasn't, drawn anew up to
    `rounds` times where a draw hits a positive. items is (item, idx), numbered from 0.

    A few draws serve nearly all pairs; only those that they fail get the others.
    """
    n = items.count()
    slots = train.select("user", "item", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("slot"))
    named, taken = items.select("idx", F.col("item").alias("_other")), train.select("user", F.col("item").alias("_other"))
    few = min(3, rounds)

    def free(some: DataFrame, first: int, last: int) -> DataFrame:
        tries = some.select("user", "item", "slot", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("k"))
        tries = tries.withColumn("idx", (draw(seed, F.col("slot"), F.col("k")) % n).cast("int")).join(named, "idx")
        tries = tries.join(taken, ["user", "_other"], "left_anti")
        return tries.groupBy("user", "item", "slot").agg(F.min_by("_other", "k").alias("_other"))

    found = free(slots, 1, few)
    if few < rounds:
        found = found.unionByName(free(slots.join(found, ["user", "item", "slot"], "left_anti"), few + 1, rounds))
    return found.select("user", F.col("_other").alias("item"))
