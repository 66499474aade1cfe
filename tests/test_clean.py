"""Cleaning rules on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from retailflow.functions import clean as C


def one(spark, column, **cells):
    schema = ", ".join(f"{k} {'string' if not isinstance(v, tuple) else v[0]}" for k, v in cells.items())
    row = tuple(v if not isinstance(v, tuple) else v[1] for v in cells.values())
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


def test_ids(spark):
    assert one(spark, C.bare_id("a"), a="77.0") == "77"
    assert one(spark, C.item_code("a", "b"), a=None, b="123456.0") == "123456"
    assert one(spark, C.item_code("a"), a="12345.0") == "12345"
    assert one(spark, C.item_code("a", "b"), a="1234567", b="9") == "123456"
    assert one(spark, C.phone("a", "b"), a=None, b="79990000000.0") == "79990000000"
    assert one(spark, C.bare_id("a"), a="0070") == "0070"


def test_numbers(spark):
    assert [one(spark, C.whole("a"), a=a) for a in ("1.9", "x", None, "-1.9", "NaN")] == [1, 0, 0, -1, 0]
    assert [one(spark, C.clipped_quantity("a"), a=a) for a in ("0", "25", None, "3")] == [1, 10, 1, 3]


def test_discount_rounds_half_to_even(spark):
    cases = {(0, 100): 0, (200, 199): 0, (200, 197): 2, (200, 195): 2, (100, 120): -20}
    for (base, line), want in cases.items():
        assert one(spark, C.discount_pct("a", "b"), a=("long", base), b=("long", line)) == want


def test_currency(spark):
    assert one(spark, C.currency("a", "b"), a="1", b="2") == "RUB"
    assert one(spark, C.currency("a", "b"), a=None, b="2") == "KZT"
    assert one(spark, C.currency("a", "b"), a=None, b=None) is None


def test_dates_and_ages(spark):
    assert one(spark, C.to_date("a"), a="2023-02-28T10:00:00") == dt.date(2023, 2, 28)
    assert one(spark, C.to_date("a"), a="soon") is None
    born = ("date", dt.date(2004, 2, 29))
    assert one(spark, C.age_at("a", "b"), a=("date", dt.date(2023, 2, 28)), b=born) == 18
    assert one(spark, C.age_at("a", "b"), a=("date", dt.date(2023, 3, 1)), b=born) == 19
    ages = {13: "до 14", 14: "14-25", 25: "14-25", 26: "26-35", 65: "56-65", 66: "65+", None: "Не указан"}
    for age, want in ages.items():
        assert one(spark, C.age_group("a"), a=("int", age)) == want


def test_names_and_categories(spark):
    assert one(spark, C.full_name("a", "b", "c"), a="A", b=None, c="C") == "A  C"
    assert one(spark, C.full_name("a", "b", "c"), a=None, b="B", c=None) == "B"
    assert one(spark, C.category_path("a", "b", "c"), a="10.0", b=None, c="1,2") == "10_12"
    assert one(spark, C.category_path("a", "b"), a=None, b="nan") is None
    assert one(spark, C.category("a"), a=" 1.2,3 ") == "123"


def test_null_tokens(spark):
    for cell in ("-", "--", "NULL", "null", "None", "none", "nan", "", " ", "  "):
        assert one(spark, C.known("a"), a=cell) is None
    assert one(spark, C.known("a"), a=" x ") == " x "


def test_labels_and_texts(spark):
    assert one(spark, C.recode("a", C.SEXES), a="male") == "Мужской"
    assert one(spark, C.recode("a", C.SEXES), a="other") == "other"
    assert one(spark, C.recode("a", C.SEXES), a=None) is None
    assert one(spark, C.label("a"), a=None) == "Не указан"
    assert one(spark, C.item_type("a"), a="1") == "Категория"
    assert one(spark, C.month_name("a"), a=("int", 3)) == "Март"
    assert one(spark, C.grouped("a"), a=("long", 1234567)) == "1.234.567"
    assert one(spark, C.ranked_line("a", "b", "c"), a="Coat", b="7", c=("long", 3)) == "Coat (7) — 3"
    low, high = ("date", dt.date(2024, 1, 2)), ("date", dt.date(2024, 11, 30))
    assert one(spark, C.period_text("a", "b"), a=low, b=high) == "02.01.2024 — 30.11.2024"
    assert one(spark, F.year(C.timestamp_or_epoch("a")), a=None) == 1970
