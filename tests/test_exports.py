"""Charsets by all bytes of an export, and quoted cells across the ranges of a file."""

import csv
import random

import pytest

from retailflow.sources import charset, records, schema, tables

WORDS = "Пальто зимнее Носки хлопок Рубашка мужская Брюки серые Шарф шерсть Ремень кожа Куртка тёплая Объём".split()
CHARSETS = {"UTF-8": "utf-8", "windows-1251": "cp1251", "KOI8-R": "koi8_r", "IBM866": "cp866", "ISO-8859-5": "iso8859_5", "x-MacCyrillic": "mac_cyrillic", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be"}


def export(path, rows, codec, kind="categories"):
    sep, columns = schema.RAW[kind]
    with open(path, "w", encoding=codec, newline="") as f:
        w = csv.writer(f, delimiter=sep, lineterminator="\n")
        w.writerow(columns)
        w.writerows(rows)
    return str(path)


def rows(n=300, seed=1):
    rng = random.Random(seed)
    return [[str(i), " ".join(rng.choices(WORDS, k=3)), str(rng.randint(1, 9))] for i in range(n)]


@pytest.mark.parametrize("name", CHARSETS)
def test_each_charset(spark, tmp_path, name):
    data = rows()
    path = export(tmp_path / "c.csv", data, CHARSETS[name])
    assert tables.detect_encoding(spark, path) == name
    for multiline in (True, False):
        got = tables.read_raw(spark, path, "categories", multiline=multiline).orderBy("pos").collect()
        assert [[r.category_code, r.category_name, r.parent_code] for r in got] == data


def test_byte_order_marks_and_upper_case(spark, tmp_path):
    data = [[a, b.upper(), c] for a, b, c in rows(40)]
    for codec, name in (("utf-8-sig", "UTF-8"), ("utf-16", "UTF-16LE"), ("cp1251", "windows-1251"), ("koi8_r", "KOI8-R"), ("cp866", "IBM866")):
        path = export(tmp_path / f"{codec}.csv", data, codec)
        assert tables.detect_encoding(spark, path) == name
        assert [r.category_name for r in tables.read_raw(spark, path, "categories").orderBy("pos").collect()] == [r[1] for r in data]


def test_the_first_letter_stands_late(spark, tmp_path):
    """More than 2 MB of ASCII before the first letter, in each charset."""
    at = [list(schema.RAW["favorites"][1].values()).index(c) for c in ("code_ru", "first_name")]

    def row(code, name):
        return [code if i == at[0] else name if i == at[1] else "" for i in range(len(schema.RAW["favorites"][1]))]

    data = [row(str(i), "plain words " * 20) for i in range(10_000)] + [row("x", "Носки хлопок")]
    for codec, name in (("cp1251", "windows-1251"), ("koi8_r", "KOI8-R"), ("cp866", "IBM866"), ("utf-8", "UTF-8")):
        path = export(tmp_path / f"{codec}.csv", data, codec, "favorites")
        assert (tmp_path / f"{codec}.csv").read_bytes()[: 2 << 20].isascii()
        assert tables.detect_encoding(spark, path) == name
        assert tables.read_raw(spark, path, "favorites").where("code_ru = 'x'").first().first_name == "Носки хлопок"


def test_files_of_several_charsets_and_bytes_without_a_letter(spark, tmp_path):
    folder = tmp_path / "with blank"
    folder.mkdir()
    export(folder / "a.csv", rows(30, 2), "cp1251")
    export(folder / "b.csv", rows(30, 3), "utf-8")
    export(folder / "c.csv", [["1", "ascii", "2"]], "utf-8-sig")
    got = sorted(r.category_name for r in tables.read_raw(spark, str(folder), "categories").collect())
    assert got == sorted([r[1] for r in rows(30, 2) + rows(30, 3)] + ["ascii"])
    with pytest.raises(ValueError, match="several"):
        tables.detect_encoding(spark, str(folder))
    path = export(tmp_path / "d.csv", [["Носки"] * len(schema.RAW["favorites"][1])], "cp1251", "favorites")
    with pytest.raises(Exception, match="codec can't decode"):
        tables.read_raw(spark, path, "favorites", "UTF-8").collect()


CELLS = ["a", "", 'say "x"', "two\nlines", "|", '"', '""', "\n\n", "end\n", " lead", "x" * 60, 'q"\n|"', "é中"]


def both(spark, path, multi):
    """By one task, and by tasks of so many bytes."""
    want = tables.read_csv(spark, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(multi))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = records.read(spark, path, "|", "UTF-8", want.columns)
        return want.collect(), [r[:-1] for r in got.orderBy("pos").collect()], records.lines_of(spark, path).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed", range(4))
def test_ranges_give_the_same_records(spark, tmp_path, seed):
    rng = random.Random(seed)
    path = tmp_path / "f.csv"
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f, delimiter="|", lineterminator=rng.choice(["\n", "\r\n"]))
        w.writerow(["k", "a b", "c"])
        for i in range(400):
            w.writerow([i, rng.choice(CELLS), rng.choice(CELLS)])
        w.writerow([400, "long\n" * 900, "over many ranges"])
        w.writerow([401, "last", "row\n"])
    want, got, tasks = both(spark, str(path), rng.choice([300, 600, 900]))
    assert tasks > 10
    assert len(got) == len(want)
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_loose_quotes_blank_lines_and_ragged_rows(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text('k|a|c\n1|5" pipe|x\n\n2|"open "inner" x|y\n3|only two\n4|a|b|extra\n5|"two\n\nlines"|z\n6|"",|"w"\n', encoding="utf-8")
    want, got, _ = both(spark, str(path), 10)
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    empty = tmp_path / "e.csv"
    empty.write_text("k|a|c\n", encoding="utf-8")
    assert records.read(spark, str(empty), "|", "UTF-8", ["k", "a", "c"]).count() == 0


def test_ratings_have_a_row_for_each_charset():
    single, double = charset.ratings()
    assert single.shape == (len(charset.CHARSETS), 256) and double.shape == (len(charset.CHARSETS), 1 << 16)
    assert (single[:, :128] == 0).all()
