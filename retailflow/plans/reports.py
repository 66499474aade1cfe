"""The composite reports as (section, key, value) rows, and their dispatcher.

One function each; the selection is the same report on fewer rows. The columns that a
report reads are written once, however they were joined. One scan of them aggregates by
all sets of keys that the report has figures by; the figures are made of that table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow.functions import clean as C
from retailflow.operators import kpi as K
from retailflow.operators import relational as R
from retailflow.storage import written



def _kept(df: DataFrame, columns: str) -> DataFrame:
    names = columns.split()
    return written(df.select(*names, *(["pos"] if "pos" in df.columns else [])), "report")


def _grains(df: DataFrame, grains: dict[str, list[str]], **measures: Column) -> DataFrame:
    """One scan's aggregates by several sets of keys, as one table; `grain` names the set of a row."""
    columns = list(dict.fromkeys(c for keys in grains.values() for c in keys))
    sets = df.groupingSets([[F.col(c) for c in keys] for keys in grains.values()], *[F.col(c) for c in columns])
    out = sets.agg(F.grouping_id().alias("_set"), *[m.alias(n) for n, m in measures.items()])
    bits = {g: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys) for g, keys in grains.items()}
    name = reduce(lambda a, g: a.when(F.col("_set") == bits[g], g), grains, F.when(F.lit(False), ""))
    return written(out.select(name.alias("grain"), *columns, *measures), "grains")


def _of(grain: str, value: Column, *keys: str) -> Column:
    """A value in the rows of one set of keys, where none of these is null; else null."""
    return F.when(reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.col("grain") == grain), value)


def _cells(section: str, **values: Column) -> list[Column]:
    return [F.struct(F.lit(section).alias("section"), F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()]


def _people(v: str) -> tuple[list[Column], list[Column]]:
    """Aggregates about the people of a report, and the rows made of them."""
    n = F.col(v).cast("double")
    found = [
        F.collect_list(_of("sex", F.struct("sex", n.alias("v")))).alias("sexes"),
        (F.sum(_of("age", F.col("years") * F.col("rows"), "years")) / F.sum(_of("age", F.col("rows"), "years"))).alias("mean_age"),
        # some sixty different ages at most
        F.percentile(_of("age", F.col("years"), "years"), F.lit(0.5), F.coalesce(_of("age", F.col("rows"), "years"), F.lit(0))).alias("median_age"),
        F.min(_of("group", F.struct((-F.col("rows")).alias("o"), "years_group"), "years_group")).alias("group"),
        F.max(_of("all", F.col("date_from"))).alias("date_from"),
        F.max(_of("all", F.col("date_to"))).alias("date_to"),
        F.min(_of("month", F.struct((-F.col(v)).alias("o"), "month"), "month")).alias("month"),
    ]
    whole = F.aggregate("sexes", F.lit(0.0), lambda a, s: a + F.coalesce(s["v"], F.lit(0.0)))
    share = lambda s: F.bround(F.try_divide(s["v"], whole) * 100.0, 1)
    shares = F.transform(F.array_sort(F.transform("sexes", lambda s: F.struct((-share(s)).alias("o"), s["sex"].alias("sex"), share(s).alias("pct")))), lambda s: F.struct(F.lit("sex").alias("section"), s["sex"].alias("key"), s["pct"].cast("string").alias("value")))
    month = F.col("month.month")
    cells = [
        *_cells("age", mean_age=F.coalesce(F.bround("mean_age", 1), F.lit(0.0)), median_age=F.coalesce("median_age", F.lit(0.0))),
        *_cells("age_group", age_group=F.coalesce("group.years_group", F.lit(C.UNKNOWN_GROUP))),
        *_cells("period", date_from=F.col("date_from"), date_to=F.col("date_to"), period=C.period_text("date_from", "date_to")),
    ]
    months = F.array(*_cells("top_month", year=F.floor(month / 100), month=month % 100, month_name=C.month_name(month % 100), v=-F.col("month.o")))
    return found, [F.concat(shares, F.array(*cells), F.when(F.col("month").isNotNull(), months).otherwise(F.array().cast("array<struct<section:string,key:string,value:string>>")))]


_BASE = {"all": [], "client": ["customer_id"], "sex": ["sex"], "age": ["years"], "group": ["years_group"], "month": ["month"]}


def _prepared(df: DataFrame) -> DataFrame:
    """Unknown sexes as one, ages and their groups from 18 to 80, months as numbers."""
    known = F.col("age").between(18, 80)
    return df.withColumns({"sex": C.label("sex"), "years": F.when(known, F.col("age")), "years_group": F.when(known, F.col("age_group")), "month": (F.year("event_date") * 100 + F.month("event_date")).cast("int")})


def _tops(grains: DataFrame, tops: dict[str, tuple[str, list[str]]], v: str, n: int = 5) -> DataFrame:
    """The n first rows of the sets of keys that are listed, by section; ties by key."""
    parts = [grains.where((F.col("grain") == grain) & reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True))).orderBy(F.desc(v), *keys).limit(n).withColumn("section", F.lit(section)) for section, (grain, keys) in tops.items()]
    return reduce(DataFrame.unionByName, parts)


def _listed(rows: DataFrame, key: Column, v: str) -> DataFrame:
    return rows.select("section", key.cast("string").alias("key"), F.col(v).cast("string").alias("value"))


def _facts(grains: DataFrame, found: list[Column], rows: Column) -> DataFrame:
    return grains.agg(*found).select(F.explode(rows).alias("c")).select("c.section", "c.key", "c.value")


def _per_client(grains: DataFrame, v: str) -> DataFrame:
    each = grains.where("grain = 'client' AND customer_id IS NOT NULL")
    one = K.mean_and_median(each, F.col(v)).select(F.explode(F.array(*_cells("per_client", mean=F.bround("mean", 1), median=F.col("median")))).alias("c"))
    return one.select("c.section", "c.key", "c.value")


def orders_report(df: DataFrame) -> DataFrame:
    df = _kept(df, "event_date order_id store item_code site_name qty line_amount discount_pct currency customer_id sex age age_group")
    in_ = lambda k, c: F.when(F.col("currency") == k, F.col(c))
    money = {f"{c}_{k.lower()}": how(in_(k, c)) for k in ("RUB", "KZT") for c, how in (("line_amount", F.sum), ("discount_pct", F.avg))}
    grains = _grains(_prepared(df), _BASE | {"order": ["order_id"], "item": ["item_code"], "store": ["store"]}, qty=F.sum("qty"), rows=F.count(F.lit(1)), date_from=F.min("event_date"), date_to=F.max("event_date"), **money)
    counts = {n: F.count(_of(g, F.lit(1), c)) for n, g, c in (("orders", "order", "order_id"), ("clients", "client", "customer_id"), ("items", "item", "item_code"))}
    found, rows = _people("qty")
    found += [c.alias(f"_{n}") for n, c in counts.items()] + [F.max(_of("all", F.col("qty"))).alias("_qty")]
    cells = _cells("totals", qty=F.col("_qty"), **{n: F.col(f"_{n}") for n in counts})
    cells += _cells("sparsity", sparsity_pct=F.bround((1 - F.try_divide(F.col("_orders"), F.col("_clients") * F.col("_items"))) * 100.0, 2))
    for k in ("rub", "kzt"):
        found += [F.max(_of("all", F.col(f"line_amount_{k}"))).alias(f"sales_{k}"), F.avg(_of("order", F.col(f"line_amount_{k}"), "order_id")).alias(f"ticket_{k}"), F.max(_of("all", F.col(f"discount_pct_{k}"))).alias(f"discount_{k}")]
        cells += _cells("finance", **{f"sales_{k}": F.coalesce(F.col(f"sales_{k}").cast("long"), F.lit(0)), f"ticket_{k}": F.coalesce(F.col(f"ticket_{k}").cast("long"), F.lit(0)), f"discount_pct_{k}": F.coalesce(F.bround(f"discount_{k}", 0).cast("long"), F.lit(0))})
    tops = _tops(grains, {"top_items": ("item", ["item_code"]), "top_stores": ("store", ["store"])}, "qty").select("section", "item_code", "store", F.col("qty").cast("long").alias("qty"))
    some = F.broadcast(tops.where("item_code IS NOT NULL").select("item_code"))  # five rows
    names = R.first_by(df.join(some, "item_code", "left_semi"), "item_code", "site_name", "pos" if "pos" in df.columns else "site_name")
    tops = tops.join(F.broadcast(names), "item_code", "left").withColumn("site_name", K.item_name("site_name", "item_code"))
    line = F.when(F.col("section") == "top_stores", F.col("store")).otherwise(C.ranked_line("site_name", "item_code", "qty"))
    return reduce(DataFrame.unionByName, [_facts(grains, found, F.concat(F.array(*cells), *rows)), _per_client(grains, "qty"), _listed(tops, line, "qty")])


def views_report(df: DataFrame) -> DataFrame:
    df = _kept(df, "event_date item_code site_name category_name item_type customer_id sex age age_group")
    kinds = {"item": ["item_type", "item_code"], "named": ["item_type", "item_code", "site_name"], "category": ["item_type", "item_code", "category_name"]}
    grains = _grains(_prepared(df), _BASE | kinds, rows=F.count(F.lit(1)), date_from=F.min("event_date"), date_to=F.max("event_date"))
    found, rows = _people("rows")
    of_kind = lambda k: F.count(F.when(F.col("item_type") == k, _of("item", F.lit(1), "item_code")))
    found += [F.max(_of("all", F.col("rows"))).alias("_views"), F.count(_of("client", F.lit(1), "customer_id")).alias("_clients"), of_kind(C.IS_ITEM).alias("_items"), of_kind(C.IS_CATEGORY).alias("_categories")]
    cells = _cells("totals", views=F.coalesce("_views", F.lit(0)), clients=F.col("_clients"), items=F.col("_items"), categories=F.col("_categories"))
    tops = _tops(grains.where(F.col("item_type") == C.IS_ITEM), {"top_items": ("named", ["item_code", "site_name"])}, "rows")
    tops = tops.unionByName(_tops(grains.where(F.col("item_type") == C.IS_CATEGORY), {"top_categories": ("category", ["item_code", "category_name"])}, "rows"))
    line = C.ranked_line(F.coalesce("site_name", "category_name"), "item_code", "rows")
    return reduce(DataFrame.unionByName, [_facts(grains, found, F.concat(F.array(*cells), *rows)), _per_client(grains, "rows"), _listed(tops, line, "rows")])


def favorites_report(df: DataFrame) -> DataFrame:
    df = _kept(df, "event_date item_code site_name customer_id sex age age_group")
    grains = _grains(_prepared(df), _BASE | {"item": ["item_code"], "named": ["item_code", "site_name"]}, rows=F.count(F.lit(1)), date_from=F.min("event_date"), date_to=F.max("event_date"))
    found, rows = _people("rows")
    found += [F.max(_of("all", F.col("rows"))).alias("_favorites"), F.count(_of("client", F.lit(1), "customer_id")).alias("_clients"), F.count(_of("item", F.lit(1), "item_code")).alias("_items")]
    cells = _cells("totals", favorites=F.coalesce("_favorites", F.lit(0)), clients=F.col("_clients"), items=F.col("_items"))
    tops = _tops(grains, {"top_items": ("named", ["item_code", "site_name"])}, "rows")
    return reduce(DataFrame.unionByName, [_facts(grains, found, F.concat(F.array(*cells), *rows)), _per_client(grains, "rows"), _listed(tops, C.ranked_line("site_name", "item_code", "rows"), "rows")])


REPORTS = {"orders": orders_report, "views": views_report, "favorites": favorites_report}


def report(spark, folder: str, kind: str, selection: bool = False) -> DataFrame:
    """The report of a kind over a folder's table; items and categories have none."""
    from retailflow.sources import tables

    if kind not in REPORTS:
        raise ValueError(f"{kind} has no report")
    tables.require_tables(spark, folder, [kind])
    return REPORTS[kind](tables.read_table(spark, folder, kind, selection))


def as_text(rows: DataFrame) -> str:
    """A report, which is a few dozen rows, as text."""
    out, last = [], None
    for r in rows.collect():
        if r.section != last:
            out.append(f"[{r.section}]")
            last = r.section
        out.append(f"{r.key}: {r.value}")
    return "\n".join(out)
