"""Raw exports through sources, pipelines and reports, on small files with edge rows."""

import csv

import pytest

from retailflow.operators import relational as R
from retailflow.plans import ingest, reports
from retailflow.sources import schema, tables
from retailflow.streaming import append


def write(path, kind, rows, encoding="utf-8-sig", drop=()):
    sep, names = schema.RAW[kind]
    cols = [c for c in names if c not in drop]
    with open(path, "w", encoding=encoding, newline="") as f:
        w = csv.writer(f, delimiter=sep)
        w.writerow(cols)
        for r in rows:
            w.writerow([r.get(names[c], "") for c in cols])
    return str(path)


ITEMS = [
    {"item_code": "100001", "item_name": "Пальто", "site_name": "Пальто | зима", "item_kind": "Верх", "site_category": "5.0"},
    {"item_code": "100002", "item_name": "Носки", "site_name": "Носки", "item_kind": "Носки"},
    {"item_code": "100003", "item_name": "Без вида", "site_name": "-", "item_kind": ""},
    {"item_code": "100001", "item_name": "Пальто 2", "site_name": "Пальто", "item_kind": "Верх"},
    {"item_code": " ", "item_name": "пусто"},
]
CATEGORIES = [{"category_code": "25.0", "category_name": "Куртки", "parent_code": "1"}]
PERSON = {"customer_id": "77.0", "last_name": "A", "middle_name": "C", "birth_date": "2004-02-29", "sex": "male", "phone_2": "79990000000.0", "cat_1": "10.0", "cat_3": "1,2"}
ORDERS = [
    {"order_id": "1.0", "event_time": "2023-02-28 10:00:00", "store": "kanzler-style.ru", "code_ru": "100002.0", "qty": "1.9", "base_price": "200", "line_amount": "197", **PERSON},
    {"order_id": "2", "event_time": "2023-03-01", "store": "s", "code_kz": "100003", "qty": "x", "base_price": "0", "line_amount": "100", "customer_id": "78"},
    {"order_id": "3", "event_time": "bad", "store": "s", "code_ru": "100001", "code_kz": "9", "qty": "2", "base_price": "10", "line_amount": "20"},
    {"order_id": "4", "event_time": "2023-01-01"},
]


@pytest.fixture()
def loaded(spark, tmp_path):
    folder = str(tmp_path / "tables")
    ingest.load(spark, write(tmp_path / "items.csv", "items", ITEMS), "items", folder)
    ingest.load(spark, write(tmp_path / "cats.csv", "categories", CATEGORIES), "categories", folder)
    return folder


def test_items_and_categories(spark, loaded):
    items = tables.read_table(spark, loaded, "items", False)
    assert items.columns == [*schema.COLUMNS["items"], "pos"]
    assert items.count() == 4  # the blank code is gone, the repeated one stays
    assert items.where("site_name LIKE '%|%'").count() == 1
    assert items.where("item_code = '100003'").first()["site_name"] is None
    assert tables.read_table(spark, loaded, "categories").first()["category_code"] == "25"
    names = {r.item_code: r.site_name for r in tables.item_names(items).collect()}
    assert names == {"100001": "Пальто", "100002": "Носки"}  # of two rows the file's last


def test_orders(spark, loaded, tmp_path):
    path = write(tmp_path / "orders.csv", "orders", ORDERS)
    out = ingest.load(spark, path, "orders", loaded)
    rows = {}
    for r in out.collect():
        rows.setdefault(r.order_id, []).append(r)
    assert out.columns == [*schema.COLUMNS["orders"], "pos"]
    assert set(rows) == {"1", "2", "3"} and len(rows["3"]) == 2
    a = rows["1"][0]
    assert (a.qty, a.base_amount, a.discount_pct, a.currency, a.age, a.sex, a.store) == (1, 200, 2, "RUB", 18, "Мужской", "ИНТЕРНЕТ-МАГАЗИН")
    assert (a.full_name, a.phone, a.fav_category, a.customer_id) == ("A  C", "79990000000", "10_12", "77")
    assert (rows["2"][0].qty, rows["2"][0].discount_pct, rows["2"][0].currency) == (0, 0, "KZT")
    assert rows["3"][0].currency == "RUB" and rows["3"][0].event_date is None
    assert out.collect()[-1].event_date is None  # undated last
    kept = tables.read_table(spark, loaded, "orders", True)
    assert {r.order_id for r in kept.collect()} == {"2", "3"}  # socks go, a missing kind stays
    ingest.load(spark, path, "orders", loaded, "append")
    assert tables.read_table(spark, loaded, "orders", False).count() == 8
    ingest.load(spark, path, "orders", loaded, "append", key=["order_id", "item_code"])
    assert tables.read_table(spark, loaded, "orders", False).count() == 8
    text = reports.as_text(reports.report(spark, loaded, "orders"))
    assert "[totals]" in text and "[finance]" in text


def test_views_and_favorites(spark, loaded, tmp_path):
    views = [
        {"event_time": "2024-01-01", "code_ru": "100001", "category_code": "25.0", "customer_id": "77.0"},
        {"event_time": "2024-01-02", "code_kz": "100002", "customer_id": "77"},
        {"event_time": "2024-01-02", "customer_id": "77"},
    ]
    out = ingest.load(spark, write(tmp_path / "views.csv", "views", views), "views", loaded).collect()
    assert [(r.item_type, r.item_code, r.category_name, r.customer_id) for r in out] == [("Категория", "25", "Куртки", "77"), ("Номенклатура", "100002", None, "77")]
    favs = [{"event_time": "2024-01-01", "code_ru": "100001", "operation": o} for o in ("", "Add", schema.SET_OPERATION)]
    out = ingest.load(spark, write(tmp_path / "fav.csv", "favorites", favs), "favorites", loaded)
    assert out.count() == 4  # two rows, each with two items of that code


def test_contracts(spark, tmp_path):
    path = write(tmp_path / "o.csv", "orders", ORDERS, drop=("OrderLineQuantity",))
    with pytest.raises(tables.MissingColumns, match="OrderLineQuantity"):
        tables.read_raw(spark, path, "orders")
    with pytest.raises(ValueError):
        tables.read_raw(spark, path, "shoes")
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path), "orders")
    with pytest.raises(ValueError):
        reports.report(spark, str(tmp_path), "items")


def test_charsets_and_files(spark, tmp_path):
    path = write(tmp_path / "i.csv", "items", ITEMS, encoding="cp1251")
    assert tables.detect_encoding(spark, path) == "windows-1251"
    raw = tables.read_raw(spark, path, "items")
    assert [r.item_name for r in raw.orderBy("pos").collect()] == [r.get("item_name") for r in ITEMS]
    assert tables.read_raw(spark, path, "items", multiline=False).count() == len(ITEMS)
    df = spark.createDataFrame([("1", 'a "b" | c\nd'), ("2", None)], "item_code string, item_name string")
    tables.write_csv(df, str(tmp_path / "out"))
    back = {r.item_code: r.item_name for r in tables.read_processed(spark, str(tmp_path / "out")).collect()}
    assert back == {"1": 'a "b" | c\nd', "2": None}


def test_status_and_append(spark, loaded):
    assert {r.table: r.present for r in tables.status(spark, loaded).collect()} == {"orders": False, "views": False, "favorites": False, "items": True, "categories": True}
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2, 3.0)], "a int, c double")
    assert tables.append_all(a, b).collect() == [(1, "x", None), (2, None, 3.0)]


def test_a_writer_that_fails_leaves_the_old_pair(spark, loaded, tmp_path, monkeypatch):
    first = write(tmp_path / "o.csv", "orders", ORDERS)
    ingest.load(spark, first, "orders", loaded)
    before = [sorted(map(str, tables.read_table(spark, loaded, "orders", s).collect())) for s in (False, True)]
    other = write(tmp_path / "p.csv", "orders", [{**ORDERS[0], "order_id": "9"}])

    def fails(*_):
        raise OSError("between the writes")

    for mode in ("replace", "append"):
        with monkeypatch.context() as m:
            m.setattr(tables, "publish", fails)
            with pytest.raises(OSError):
                ingest.load(spark, other, "orders", loaded, mode)
        assert [sorted(map(str, tables.read_table(spark, loaded, "orders", s).collect())) for s in (False, True)] == before
    old = tables.read_table(spark, loaded, "orders", False)
    ingest.load(spark, other, "orders", loaded)
    assert {r.order_id for r in tables.read_table(spark, loaded, "orders", False).collect()} == {"9"}
    assert tables.read_table(spark, loaded, "orders", True).count() == 0
    assert sorted(map(str, old.collect())) == before[0]  # a reader that began before goes on
    ingest.load(spark, first, "orders", loaded)
    assert len(tables.manifests(spark, tables.table_path(loaded, "orders"))) == 2
    now = tables.manifest(spark, tables.table_path(loaded, "orders"))
    with pytest.raises(RuntimeError, match="another writer"):
        tables.publish(spark, tables.table_path(loaded, "orders"), {}, now["number"] - 1)


def test_the_selection_is_a_partition(spark, loaded, tmp_path):
    ingest.load(spark, write(tmp_path / "o.csv", "orders", ORDERS), "orders", loaded)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    chosen = tables.read_table(spark, loaded, "orders", True)
    assert "PartitionFilters: [isnotnull(selected" in plan(chosen) and chosen.columns == [*schema.COLUMNS["orders"], "pos"]
    assert "PartitionFilters: []" in plan(tables.read_table(spark, loaded, "orders", False))
    extra = chosen.withColumn("more", chosen["qty"])
    tables.write_table(extra, loaded, "orders", "append", selected=R.selected())
    both = tables.read_table(spark, loaded, "orders", False)
    assert both.columns[-1] == "more" and both.where("more IS NULL").count() == 4
    with pytest.raises(ValueError, match="other types"):
        tables.write_table(chosen.withColumn("qty", chosen["order_id"]), loaded, "orders", "append", selected=R.selected())


def test_stream(spark, loaded, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    write(inbox / "a.csv", "orders", ORDERS, encoding="utf-8")
    for _ in range(2):  # the second run finds nothing new
        append.stream_events(spark, str(inbox), "orders", loaded, str(tmp_path / "cp")).awaitTermination(120)
    assert tables.read_table(spark, loaded, "orders", False).count() == 4


def test_null_rules(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (None, "b")], "k int, c string")
    assert R.not_equal(df, "c", "a").count() == 3
    assert R.selection(df, "c", ("b",)).count() == 2
    assert R.drop_any_null(df, ["k", "c"]).count() == 2
    assert R.drop_all_null(df, ["k", "c"]).count() == 4
