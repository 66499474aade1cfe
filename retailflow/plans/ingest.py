"""Pipelines from raw exports to processed tables.

Each is one chain of native expressions: prune, clean, join the lookups, normalise nulls,
order by date. Decisions where raw files are ambiguous: ids lose a trailing ".0"
everywhere before they are cut, and a key that is empty after cleaning is null.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.functions import clean as C
from retailflow.operators import relational as R
from retailflow.sources import schema, tables
from retailflow.storage import written


#: Columns that lookup tables have, where they are normalised.
LOOKED_UP = ("item_name", "item_kind", "site_name", "category_name")


def _nulls(df: DataFrame, done: tuple[str, ...] = ()) -> DataFrame:
    """Cells that stand for nothing, in all string columns but those done, become null.

    The cells of a row go through one loop. Written out for each of some twenty columns they
    made methods of a size that Java doesn't compile, which took most of a pipeline's time.
    """
    at = {c: i for i, c in enumerate(c for c, t in df.dtypes if t == "string" and c not in done)}
    df = df.withColumn("_cells", F.transform(F.array(*at), C.known))
    return df.select(*[F.col("_cells")[at[c]].alias(c) if c in at else F.col(c) for c in df.columns if c != "_cells"])


def _table(df: DataFrame, kind: str) -> DataFrame:
    """The columns of a kind of table, and pos where the export has it."""
    return df.select(*schema.COLUMNS[kind], *(["pos"] if "pos" in df.columns else []))


def _person(df: DataFrame) -> DataFrame:
    """Columns about the customer, from the raw ones."""
    born = C.to_date("birth_date")
    df = df.withColumn("_born", born).withColumn("age", C.age_at("event_date", "_born"))
    return df.withColumns(
        {
            "age_group": C.age_group("age"),
            "sex": C.recode("sex", C.SEXES),
            "full_name": C.full_name("last_name", "first_name", "middle_name"),
            "phone": C.phone("phone_1", "phone_2"),
            "card_no": C.bare_id("card_no"),
            "customer_id": C.bare_id("customer_id"),
            "fav_category": C.category_path("cat_1", "cat_2", "cat_3"),
            "birth_date": F.col("_born"),
        }
    )


def items(raw: DataFrame) -> DataFrame:
    df = R.not_blank(raw, "item_code").withColumn("item_code", C.bare_id("item_code")).withColumn("site_category", C.category("site_category"))
    return _table(_nulls(df), "items").orderBy("item_code")


def categories(raw: DataFrame) -> DataFrame:
    df = raw.withColumns({c: C.category(c) for c in ("category_code", "parent_code")})
    return _table(_nulls(df), "categories").orderBy("category_code")


def _names(known: DataFrame, key: str, *columns: str) -> DataFrame:
    """What is looked up in a table, by `_code`."""
    tables.require_columns(known, [key, *columns])
    return known.select(F.col(key).alias("_code"), *[C.known(c).alias(c) for c in columns])


def _rows(raw: DataFrame, cells: dict[str, str] | None, kind: str, items: DataFrame, categories: DataFrame | None, ordered: bool) -> DataFrame:
    """The cells of the rows that stay, with their date and what is looked up by their code.

    Rows are dealt out by code and, if ordered, by date. Cells that are expressions over the
    raw rows are made after that, since the rows are several times as narrow. Between the
    two they are written, so that the shuffle files of both don't take disk at once.
    """
    of = {n: F.expr(e) for n, e in cells.items()} if cells else {c: F.col(c) for c in raw.columns if c != "pos"}
    code, keys = C.item_code(of["code_ru"], of["code_kz"]), [of["code_ru"], of["code_kz"]]
    if kind == "views":  # where a row has both, the category counts
        code, keys = F.coalesce(C.known(C.category(of["category_code"])), code), [*keys, of["category_code"]]
    df = R.drop_all_null(raw, keys)
    if kind == "favorites":
        df = R.not_equal(df, of["operation"], schema.SET_OPERATION)
    df = df.withColumns({"event_date": C.to_date(of["event_time"]), "_code": code})
    df = R.lookup(df, _names(items, "item_code", "item_name", "item_kind", "site_name"), "_code")
    if kind == "views":
        df = R.lookup(df, _names(categories, "category_code", "category_name"), "_code")
    df = df.drop("_code")
    df = R.sorted_by_date(written(df, "rows")) if ordered else df
    own = [c for c in ("event_date", *LOOKED_UP, "pos") if c in df.columns]
    return df.select(*[c.alias(n) for n, c in of.items()], *own)


def _finished(df: DataFrame, kind: str) -> DataFrame:
    return _nulls(_table(_person(df), kind), LOOKED_UP)


def orders(raw: DataFrame, items: DataFrame, cells: dict[str, str] | None = None, ordered: bool = True) -> DataFrame:
    """Rows with an item, their amounts, discount and currency; several rows of a code in
    items multiply an order's row. `cells` has expressions of the raw columns, where they
    aren't columns yet."""
    df = _rows(raw, cells, "orders", items, None, ordered)
    df = df.withColumns({"currency": C.currency("code_ru", "code_kz"), "item_code": C.item_code("code_ru", "code_kz"), "order_id": C.bare_id("order_id"), "store": C.recode("store", C.STORES)})
    numbers = ("qty", "base_price", "line_amount")
    df = df.withColumn("_numbers", F.transform(F.array(*numbers), lambda c: C.whole(c)))  # one loop, as in _nulls()
    df = df.withColumns({c: F.col("_numbers")[i] for i, c in enumerate(numbers)})
    df = df.withColumn("base_amount", F.col("base_price") * F.col("qty"))
    return _finished(df.withColumn("discount_pct", C.discount_pct("base_amount", "line_amount")), "orders")


def views(raw: DataFrame, items: DataFrame, categories: DataFrame, cells: dict[str, str] | None = None, ordered: bool = True) -> DataFrame:
    """Views of items and categories; where a row has both, the category counts."""
    df = _rows(raw, cells, "views", items, categories, ordered)
    df = df.withColumn("category_code", C.known(C.category("category_code"))).withColumn("item_type", C.item_type("category_code"))
    return _finished(df.withColumn("item_code", F.coalesce("category_code", C.item_code("code_ru", "code_kz"))), "views")


def favorites(raw: DataFrame, items: DataFrame, cells: dict[str, str] | None = None, ordered: bool = True) -> DataFrame:
    """Added favourites; rows that set a whole list go, rows without an operation stay."""
    df = _rows(raw, cells, "favorites", items, None, ordered)
    return _finished(df.withColumn("item_code", C.item_code("code_ru", "code_kz")), "favorites")


def load(spark, path: str, kind: str, folder: str, mode: str = "replace", encoding: str | None = None, key: list[str] | None = None, multiline: bool = True) -> DataFrame:
    """Read one raw export, process it and write its tables into the folder.

    Events are written in full, with the selection as a partition, in either mode; items and
    categories are always replaced. Orders and favourites need items first, views categories
    too. The rows are computed once: each file of a table is in order of date, and the whole
    is put in order when it is read, since dealing rows by date would take another pass. The
    files are loaded in batches, whose shuffle files go before the next, and become a table
    in one step; with a key, by which rows of all files are compared, they are one batch.
    """
    if kind in ("items", "categories"):
        raw = tables.read_raw(spark, path, kind, encoding, multiline)
        tables.write_table(items(raw) if kind == "items" else categories(raw), folder, kind)
        return tables.read_table(spark, folder, kind, False)
    needs = ["items", "categories"] if kind == "views" else ["items"]
    tables.require_tables(spark, folder, needs)
    known = [tables.read_table(spark, folder, n, selection=False) for n in needs]
    made = {"orders": orders, "views": views, "favorites": favorites}[kind]
    seen: list[DataFrame] = []

    def frames():
        for part in [path] if key else tables.batches(spark, path):
            seen.append(made(tables.read_raw(spark, part, kind, encoding, multiline), *known, ordered=False))
            yield seen[-1]

    out = frames()
    put(next(out), folder, kind, mode, key, out)
    return R.sorted_by_date(tables.read_table(spark, folder, kind, False) if mode == "replace" else reduce(DataFrame.unionByName, seen))


def put(events: DataFrame, folder: str, kind: str, mode: str, key: list[str] | None = None, more: Iterable[DataFrame] = ()) -> None:
    """Write processed events with their selection, both in one step."""
    tables.write_table(events, folder, kind, mode, key, R.selected(), (F.asc_nulls_last("event_date"),), more)
