"""Aggregates of the reports, each as a small DataFrame.

Groups with a null key don't count, medians are exact, shares and means are rounded half
to even, and ties are broken by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailflow.functions import clean as C
from retailflow.operators import relational as R


def totals(df: DataFrame, **measures: Column) -> DataFrame:
    return df.agg(*[m.alias(n) for n, m in measures.items()])


#: Parts of an octave by which values are counted before the middle is looked at.
PARTS = 256


def mean_and_median(df: DataFrame, value: Column) -> DataFrame:
    """One row with the exact mean and median of the values that aren't null; nulls if none are.

    Equal values are counted where they are. The counts of ranges of values, a few thousand,
    show which range holds the middle; only its different values are put in order.
    """
    v = value.cast("double")
    each = df.select(v.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    each = each.withColumn("part", F.signum("v") * F.floor(F.log2(1.0 + F.abs("v")) * PARTS))
    parts = each.groupBy("part").agg(F.sum("n").alias("k"), F.sum(F.col("v") * F.col("n")).alias("s"))
    whole = Window.partitionBy()
    parts = parts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"), "k", F.sum("k").over(whole).alias("total"), (F.sum("s").over(whole) / F.sum("k").over(whole)).alias("mean"))
    # places from 0: of an even number of values the two in the middle
    low, high = F.expr("(total - 1) DIV 2"), F.expr("total DIV 2")
    middle = F.broadcast(parts.where((F.col("before") <= high) & (F.col("before") + F.col("k") > low)))  # two rows at most
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    near = each.join(middle, "part").select("v", "mean", "total", upto.alias("upto"))
    return near.agg(F.first("mean").alias("mean"), ((F.min(F.when(F.col("upto") > low, F.col("v"))) + F.min(F.when(F.col("upto") > high, F.col("v")))) / 2).alias("median"))


def per_client(df: DataFrame, measure: Column, key: str = "customer_id") -> DataFrame:
    """Mean (1 decimal) and exact median over clients of a measure of each."""
    each = df.where(F.col(key).isNotNull()).groupBy(key).agg(measure.cast("double").alias("v"))
    return mean_and_median(each, F.col("v")).select(F.bround("mean", 1).alias("mean"), "median")


def sex_share(df: DataFrame, measure: Column) -> DataFrame:
    """Each sex's part of the measure in per cent (1 decimal); unknown is a sex of its own."""
    each = df.withColumn("sex", C.label("sex")).groupBy("sex").agg(measure.cast("double").alias("v"))
    whole = F.sum("v").over(Window.partitionBy())
    return each.select("sex", F.bround(F.try_divide(F.col("v"), whole) * 100.0, 1).alias("pct")).orderBy(F.desc("pct"), "sex")


def age_stats(df: DataFrame) -> DataFrame:
    """Mean (1 decimal) and median of ages from 18 to 80; 0 if there are none."""
    found = mean_and_median(R.between_ages(df), F.col("age"))
    return found.select(F.coalesce(F.bround("mean", 1), F.lit(0.0)).alias("mean_age"), F.coalesce("median", F.lit(0.0)).alias("median_age"))


def age_group_mode(df: DataFrame) -> DataFrame:
    """The age group of most rows from 18 to 80, or a label if there are none."""
    groups = R.between_ages(df).where("age_group IS NOT NULL").groupBy("age_group").agg(F.count("*").alias("n"))
    ranked = groups.agg(F.min(F.struct((-F.col("n")).alias("o"), "age_group")).alias("b"))
    return ranked.select(F.coalesce("b.age_group", F.lit(C.UNKNOWN_GROUP)).alias("age_group"))


def sparsity(df: DataFrame) -> DataFrame:
    """(1 - orders / (clients x items)) in per cent, 2 decimals; null if either is 0."""
    n = df.agg(F.countDistinct("order_id").alias("o"), F.countDistinct("customer_id").alias("c"), F.countDistinct("item_code").alias("i"))
    return n.select(F.bround((1 - F.try_divide(F.col("o"), F.col("c") * F.col("i"))) * 100.0, 2).alias("sparsity_pct"))


def sparsity_pairs(df: DataFrame) -> DataFrame:
    """The same with distinct (client, item) pairs in place of orders."""
    n = df.agg(F.countDistinct("customer_id", "item_code").alias("p"), F.countDistinct("customer_id").alias("c"), F.countDistinct("item_code").alias("i"))
    return n.select(F.bround((1 - F.try_divide(F.col("p"), F.col("c") * F.col("i"))) * 100.0, 2).alias("sparsity_pct"))


def period(df: DataFrame, column: str = "event_date") -> DataFrame:
    n = df.agg(F.min(column).alias("date_from"), F.max(column).alias("date_to"))
    return n.withColumn("period", C.period_text("date_from", "date_to"))


def top_month(df: DataFrame, measure: Column, column: str = "event_date") -> DataFrame:
    """The month of the largest measure, of equal ones the earliest; undated rows don't count."""
    each = df.where(F.col(column).isNotNull()).groupBy(F.year(column).alias("year"), F.month(column).alias("month")).agg(measure.alias("v"))
    return each.orderBy(F.desc("v"), "year", "month").limit(1).select("year", "month", C.month_name("month").alias("month_name"), "v")


def finance(df: DataFrame) -> DataFrame:
    """For each currency: sales, mean ticket of an order, and mean discount of a line."""
    d = df.where("currency IS NOT NULL")
    lines = d.groupBy("currency").agg(F.sum("line_amount").cast("long").alias("sales"), F.bround(F.avg("discount_pct"), 0).cast("long").alias("discount_pct"))
    tickets = d.where("order_id IS NOT NULL").groupBy("currency", "order_id").agg(F.sum("line_amount").alias("v")).groupBy("currency").agg(F.avg("v").cast("long").alias("ticket"))
    return lines.join(tickets, "currency", "left").select("currency", "sales", "ticket", "discount_pct")


def finance_pivot(df: DataFrame) -> DataFrame:
    """One row with RUB and KZT side by side, 0 where a currency has no rows."""
    f = finance(df)
    cells = [F.coalesce(F.max(F.when(F.col("currency") == k, F.col(c))), F.lit(0)).alias(f"{c}_{k.lower()}") for k in ("RUB", "KZT") for c in ("sales", "ticket", "discount_pct")]
    return f.agg(*cells)


def finance_text(df: DataFrame) -> DataFrame:
    """The same as texts with dots between thousands."""
    return finance(df).select("currency", C.grouped("sales").alias("sales"), C.grouped("ticket").alias("ticket"), F.concat(F.col("discount_pct").cast("string"), F.lit("%")).alias("discount"))


def item_name(name: str, code: str) -> Column:
    """A name, or where there is none a note with the code."""
    return F.coalesce(name, F.concat(F.lit("name not found ("), F.col(code).cast("string"), F.lit(")")))


def top_items(df: DataFrame, n: int = 5) -> DataFrame:
    """Items of the largest quantity with the first name that their code has: by pos where
    the table has it, else the least of its names."""
    best = R.top(df, ["item_code"], F.sum("qty").cast("long"), n, "qty")
    names = R.first_by(df.join(F.broadcast(best.select("item_code")), "item_code", "left_semi"), "item_code", "site_name", "pos" if "pos" in df.columns else "site_name")
    found = best.join(names, "item_code", "left")
    return found.select("item_code", item_name("site_name", "item_code").alias("site_name"), "qty").orderBy(F.desc("qty"), "item_code")


def lines_text(top: DataFrame, name: str, code: str, n: str) -> DataFrame:
    """A top list as one text, a line each, largest first."""
    line = F.struct((-F.col(n)).alias("o"), F.col(code).alias("c"), C.ranked_line(name, code, n).alias("t"))
    return top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("text"))
