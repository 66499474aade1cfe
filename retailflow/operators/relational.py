"""Filters, joins, windows and ordering with the null rules of the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailflow.functions.clean import UNSELECTED_KINDS, col


def lookup(df: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """A join with a lookup table. Spark broadcasts it where its files, or the bytes that it
    turns out to have as the join runs, are below the session's threshold; else both sides
    are shuffled. No job of its own counts it."""
    return df.join(small, on, how)


def drop_all_null(df: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Rows that have at least one of the keys."""
    return df.where(F.coalesce(*[col(k).cast("string") for k in keys]).isNotNull())


def drop_any_null(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(how="any", subset=keys)


def not_equal(df: DataFrame, column: Column | str, value) -> DataFrame:
    """Rows of another value; a null is another value."""
    return df.where(~col(column).eqNullSafe(F.lit(value)))


def not_in(column: Column | str, values) -> Column:
    """Whether a value isn't listed; a null isn't."""
    c = F.col(column) if isinstance(column, str) else column
    return ~F.coalesce(c.isin(*values), F.lit(False))


def selected(column: str = "item_kind", kinds=UNSELECTED_KINDS) -> Column:
    """Whether a row is in the selection: its kind isn't left out; a row without a kind is in it."""
    return not_in(column, kinds)


def selection(df: DataFrame, column: str = "item_kind", kinds=UNSELECTED_KINDS) -> DataFrame:
    """Rows whose kind of item isn't left out; rows without a kind stay."""
    return df.where(selected(column, kinds))


def not_blank(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.length(F.trim(F.col(column))) > 0)


def between_ages(df: DataFrame, low: int = 18, high: int = 80, column: str = "age") -> DataFrame:
    return df.where(F.col(column).between(low, high))


def first_by(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first value of each key that is there."""
    return df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))


def sorted_by_date(df: DataFrame, column: str = "event_date") -> DataFrame:
    """Rows by date, undated ones last; of a date by pos where the table has it, else by a hash.

    Without an order within a date all of its rows, and all undated ones, would be sorted by
    one task.
    """
    within = F.col("pos") if "pos" in df.columns else F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith("map<")])
    return df.orderBy(F.asc_nulls_last(column), within)


def top(df: DataFrame, keys: list[str], measure: Column, n: int = 5, name: str = "n") -> DataFrame:
    """The n groups of the largest measure; ties by key. Rows with a null key don't count."""
    grouped = df.dropna(how="any", subset=keys).groupBy(*keys).agg(measure.alias(name))
    return grouped.orderBy(F.desc(name), *keys).limit(n)


def last_per(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key in the order given."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per(df: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each key with their rank, ties by another column."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
