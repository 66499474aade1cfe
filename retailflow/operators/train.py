"""The training driver over a folder of processed tables."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.operators import interactions as I
from retailflow.operators import recommend as M
from retailflow.sources import tables
from retailflow.storage import written

log = logging.getLogger(__name__)


def load_events(spark: SparkSession, folder: str, cfg: I.Config) -> DataFrame:
    tables.require_tables(spark, folder, ["orders", "favorites", "views"])
    frames = {k: tables.read_table(spark, folder, k) for k in ("orders", "favorites", "views")}
    return I.events(frames["orders"], frames["favorites"], frames["views"], cfg)


METRICS = "model string, epoch int, loss double, recall double, ndcg double"


def train(spark: SparkSession, folder: str, artifacts: str, cfg: I.Config = I.Config()) -> DataFrame:
    """Train both models and save them; beyond its limit the item model is left out.

    Returns the metrics, which are saved too: a row for each epoch of the factor model, and
    one of the item model, over held-out items at cfg.top_k.
    """
    events = load_events(spark, folder, cfg).cache()
    try:
        users, items = I.ids(events, "user").cache(), I.ids(events, "item").cache()
        log.info("%d users, %d items, %d events", users.count(), items.count(), events.count())
        learn, held = (written(df, name) for df, name in zip(I.split(events, cfg.min_events), ("learn", "held"), strict=True))
        factors, history = M.bpr_trained(learn, held, users, items, cfg)
        frames = {"users": users, "items": items, "train": learn, "factors": factors}
        rows = [("bprmf", epoch, loss, recall, ndcg) for epoch, loss, recall, ndcg in history]
        try:
            b = frames["ease"] = written(M.ease(learn, items, cfg), "ease")
            found = M.ease_evaluate(learn, held, b, cfg.top_k).first()
            rows.append(("ease", None, None, found.recall, found.ndcg))
        except M.TooLarge as e:
            log.warning("%s", e)
        for row in rows:
            log.info("%s, epoch %s: loss %s, recall %s, ndcg %s", *row)
        frames["metrics"] = spark.createDataFrame(rows, METRICS)
        M.save(artifacts, cfg, **frames)
        return frames["metrics"]
    finally:
        events.unpersist()


def recommend(spark: SparkSession, folder: str, artifacts: str, user: str, k: int = 20, model: str = "ease") -> DataFrame:
    """The k best items for a customer by a trained model; no rows for one without history."""
    cfg, frames = M.load(spark, artifacts, "items", "users", "train", "ease" if model == "ease" else "factors")
    names = tables.item_names(tables.read_table(spark, folder, "items", selection=False)) if tables.present(spark, tables.table_path(folder, "items")) else spark.createDataFrame([], "item_code string, site_name string")
    own = I.known_items(I.profile(load_events(spark, folder, cfg), user), frames["items"])
    if model == "ease":
        return M.recommend(own, frames["ease"], names, k)
    users = frames["users"].where(F.col("user") == user)
    seen = own.withColumn("user", F.lit(user))
    best = M.factor_top(frames["factors"], seen, users, frames["items"], k)
    best = best.join(names.withColumnRenamed("item_code", "item"), "item", "left")
    return best.select("rank", "item", F.coalesce("site_name", F.lit("")).alias("site_name"), "score").orderBy("rank")
