"""Logical tables of the retail model over the driver's tables, in both dialects.

The driver's tables have no nulls and no people; both are derived by the same
deterministic expressions in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.functions import clean as C
from retailflow.operators import relational as R
from retailflow.sources import schema
from retailflow.storage import written

#: Kinds that the selection leaves out here.
UNSELECTED = ("PROMO", "SMALL")


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    born = F.when(F.col("c_custkey") % 11 != 0, F.date_add(F.lit("1930-01-01").cast("date"), (F.col("c_custkey") * 37 % 27000).cast("int")))
    sex = F.when(F.col("c_custkey") % 5 < 2, "male").when(F.col("c_custkey") % 5 < 4, "female")
    return c.select(F.col("c_custkey").alias("customer_id"), "c_nationkey", C.recode(sex, C.SEXES).alias("sex"), born.alias("birth_date"))


def _aged(df: DataFrame) -> DataFrame:
    return df.withColumn("age", C.age_at("event_date", "birth_date")).withColumn("age_group", C.age_group("age"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_retailprice", "p_brand")
    kind = F.when(F.col("p_partkey") % 13 != 0, F.col("p_type"))
    return p.select(F.col("p_partkey").alias("item_code"), F.col("p_name").alias("item_name"), kind.alias("item_kind"), F.col("p_name").alias("site_name"), F.col("p_retailprice").cast("long").alias("base_price"), F.col("p_brand").alias("brand"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    head = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    nation = _read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    df = line.join(head, line.l_orderkey == head.o_orderkey).join(people(spark, sf_dir), F.col("o_custkey") == F.col("customer_id"))
    df = R.lookup(df, nation, F.col("c_nationkey") == F.col("n_nationkey"), "inner")
    df = R.lookup(df, items(spark, sf_dir), F.col("l_partkey") == F.col("item_code"))
    russian = F.col("n_regionkey").isin(0, 1, 2)
    money = C.currency(F.when(russian, F.col("l_partkey")), F.when(~russian, F.col("l_partkey")))
    df = df.select(
        F.col("o_orderdate").cast("date").alias("event_date"),
        F.col("l_orderkey").alias("order_id"),
        F.col("n_name").alias("store"),
        F.col("l_partkey").alias("item_code"),
        "item_name",
        "item_kind",
        "site_name",
        F.col("l_quantity").cast("long").alias("qty"),
        "base_price",
        F.col("l_extendedprice").cast("long").alias("base_amount"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("long").alias("line_amount"),
        money.alias("currency"),
        "customer_id",
        "sex",
        "birth_date",
    )
    return _aged(df.withColumn("discount_pct", C.discount_pct("base_amount", "line_amount")))


def _events(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    e = _read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props").where(F.col("event_type").isin(*types))
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.join(people(spark, sf_dir), F.col("user_id") == F.col("customer_id"))


def _named(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    known = items(spark, sf_dir).select(F.col("item_code").alias("_i"), "item_name", "item_kind", F.when(F.col("item_code") % 10 != 0, F.col("site_name")).alias("site_name"))
    return R.lookup(df, known, F.col("item_code") == F.col("_i")).drop("_i")


_WHO = ["customer_id", "sex", "birth_date"]


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    click = F.col("event_type") == "click"
    e = _events(spark, sf_dir, "view", "click").select(
        F.col("ts").cast("date").alias("event_date"),
        F.when(click, F.col("k") % 25).otherwise(F.col("k")).cast("long").alias("item_code"),
        C.item_type(F.when(click, F.lit(1))).alias("item_type"),
        F.when(click, F.concat(F.lit("Brand#"), (F.col("k") % 25 + 1).cast("string"))).alias("category_name"),
        F.col("event_id").alias("pos"),
        "ts",
        *_WHO,
    )
    return _aged(_named(e, spark, sf_dir))


def favorites(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "signup").select(F.col("ts").cast("date").alias("event_date"), F.col("k").cast("long").alias("item_code"), F.col("event_id").alias("pos"), "ts", *_WHO)
    return _aged(_named(e, spark, sf_dir))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir, "purchase")
    return e.select(F.col("ts").cast("date").alias("event_date"), F.col("k").cast("long").alias("item_code"), (F.col("event_id") % 12 + 1).alias("qty"), F.col("event_id").alias("pos"), *_WHO)


SQL = f"""
people AS (SELECT c_custkey AS customer_id, c_nationkey,
    CASE WHEN c_custkey % 5 < 2 THEN 'Мужской' WHEN c_custkey % 5 < 4 THEN 'Женский' END AS sex,
    CASE WHEN c_custkey % 11 <> 0 THEN DATE '1930-01-01' + CAST(c_custkey * 37 % 27000 AS INTEGER) END AS birth_date FROM customer),
items_l AS (SELECT p_partkey AS item_code, p_name AS item_name, CASE WHEN p_partkey % 13 <> 0 THEN p_type END AS item_kind, p_name AS site_name,
    CAST(trunc(p_retailprice) AS BIGINT) AS base_price FROM part),
orders_0 AS (SELECT CAST(o_orderdate AS DATE) AS event_date, l_orderkey AS order_id, n_name AS store, l_partkey AS item_code, item_name, item_kind, site_name,
    CAST(trunc(l_quantity) AS BIGINT) AS qty, base_price, CAST(trunc(l_extendedprice) AS BIGINT) AS base_amount, CAST(trunc(l_extendedprice * (1 - l_discount)) AS BIGINT) AS line_amount,
    CASE WHEN n_regionkey IN (0, 1, 2) THEN 'RUB' ELSE 'KZT' END AS currency, customer_id, sex, birth_date
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN people ON o_custkey = customer_id JOIN nation ON c_nationkey = n_nationkey LEFT JOIN items_l ON l_partkey = item_code),
events_0 AS (SELECT e.*, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, p.customer_id, p.sex, p.birth_date FROM events e JOIN people p ON user_id = customer_id),
names AS (SELECT item_code AS i, item_name, item_kind, CASE WHEN item_code % 10 <> 0 THEN site_name END AS site_name FROM items_l),
views_0 AS (SELECT CAST(ts AS DATE) AS event_date, CASE WHEN event_type = 'click' THEN k % 25 ELSE k END AS item_code,
    CASE WHEN event_type = 'click' THEN 'Категория' ELSE 'Номенклатура' END AS item_type, CASE WHEN event_type = 'click' THEN 'Brand#' || CAST(k % 25 + 1 AS VARCHAR) END AS category_name,
    event_id AS pos, ts, customer_id, sex, birth_date FROM events_0 WHERE event_type IN ('view', 'click')),
views_1 AS (SELECT v.*, item_name, item_kind, site_name FROM views_0 v LEFT JOIN names ON item_code = i),
favorites_1 AS (SELECT CAST(ts AS DATE) AS event_date, k AS item_code, event_id AS pos, ts, customer_id, sex, birth_date, item_name, item_kind, site_name
    FROM events_0 LEFT JOIN names ON k = i WHERE event_type = 'signup'),
purchases_l AS (SELECT CAST(ts AS DATE) AS event_date, k AS item_code, event_id % 12 + 1 AS qty, event_id AS pos, customer_id FROM events_0 WHERE event_type = 'purchase'),
""" + ",\n".join(
    f"""{name}_2 AS (SELECT *, CAST(year(event_date) - year(birth_date) - CASE WHEN month(event_date) * 100 + day(event_date) < month(birth_date) * 100 + day(birth_date) THEN 1 ELSE 0 END AS INTEGER) AS age FROM {src}),
{name}_l AS (SELECT *, CASE WHEN age IS NULL THEN 'Не указан' WHEN age <= 13 THEN 'до 14' WHEN age <= 25 THEN '14-25' WHEN age <= 35 THEN '26-35' WHEN age <= 45 THEN '36-45' WHEN age <= 55 THEN '46-55' WHEN age <= 65 THEN '56-65' ELSE '65+' END AS age_group{extra} FROM {name}_2),
{name}_s AS (SELECT * FROM {name}_l WHERE item_kind IS NULL OR item_kind NOT IN {UNSELECTED})"""
    for name, src, extra in (
        ("orders", "orders_0", ", CAST(coalesce(round_even(CASE WHEN base_amount <> 0 THEN (base_amount - line_amount) / CAST(base_amount AS DOUBLE) END * 100, 0), 0) AS BIGINT) AS discount_pct"),
        ("views", "views_1", ""),
        ("favorites", "favorites_1", ""),
    )
)


# ---------------------------------------------------------------- raw exports

SITE = next(iter(C.STORES))
# Every raw column by the names used here, as one expression that means the same in both
# dialects; some cells are missing, stand for nothing, or can't be read.
_WHO_RAW = {
    "card_no": "c_custkey || '.0'",
    "customer_id": "CASE WHEN c_custkey % 29 <> 0 THEN c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '.0' ELSE '' END END",
    "first_name": "CASE WHEN c_custkey % 4 <> 0 THEN 'Имя' || c_custkey END",
    "last_name": "c_mktsegment",
    "middle_name": "CASE WHEN c_custkey % 2 = 0 THEN 'C' END",
    "birth_date": "CASE WHEN c_custkey % 11 = 0 THEN 'none' WHEN c_custkey % 13 <> 0 THEN CAST(1930 + c_custkey % 70 AS VARCHAR(4)) || '-0' || CAST(1 + c_custkey % 9 AS VARCHAR(1)) || '-1' || CAST(c_custkey % 10 AS VARCHAR(1)) END",
    "sex": "CASE WHEN c_custkey % 5 < 2 THEN 'male' WHEN c_custkey % 5 < 4 THEN 'female' ELSE 'none' END",
    "email": "CASE WHEN c_custkey % 6 = 0 THEN '--' ELSE 'u' || c_custkey || '@x.org' END",
    "phone_1": "CASE WHEN c_custkey % 3 <> 0 THEN (79990000000 + c_custkey) || '.0' END",
    "phone_2": "CAST(78880000000 + c_custkey AS VARCHAR(11))",
    "cat_1": "c_custkey % 7 || '.0'",
    "cat_2": "CASE WHEN c_custkey % 2 = 0 THEN '1,2' END",
    "cat_3": "CASE WHEN c_custkey % 13 = 0 THEN 'nan' ELSE c_mktsegment END",
}
_MONEY = "CASE WHEN (l_partkey + l_linenumber) % 23 <> 0 AND n_regionkey {} (0, 1, 2) THEN "
RAW = {
    "orders": (
        {
            "order_id": "l_orderkey || CASE WHEN l_orderkey % 2 = 0 THEN '.0' ELSE '' END",
            "event_time": "CASE WHEN l_orderkey % 17 = 0 THEN 'unknown' WHEN l_orderkey % 19 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) || ' 10:00:00' END",
            "store": f"CASE WHEN l_orderkey % 5 = 0 THEN '{SITE}' WHEN l_orderkey % 7 = 0 THEN '-' ELSE n_name END",
            "code_ru": _MONEY.format("IN") + "l_partkey || '.0' END",
            "code_kz": _MONEY.format("NOT IN") + "CAST(l_partkey AS VARCHAR(20)) END",
            "qty": "CASE WHEN l_linenumber % 6 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20)) || '.9' END",
            "base_price": "CASE WHEN l_linenumber % 5 <> 0 THEN CAST(CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS VARCHAR(20)) ELSE '' END",
            "line_amount": "CAST(CAST(floor(l_extendedprice * 0.75) AS BIGINT) AS VARCHAR(20)) || '.5'",
        }
        | _WHO_RAW,
        "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    ),
    "views": (
        {
            "event_time": "CASE WHEN event_id % 37 <> 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR(10)) END",
            "code_ru": "CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN k || '.0' END",
            "code_kz": "CASE WHEN event_type = 'view' AND event_id % 2 = 1 AND event_id % 31 <> 0 THEN CAST(k AS VARCHAR(20)) END",
            "category_code": "CASE WHEN event_type = 'click' THEN k % 25 || '.0' END",
        }
        | _WHO_RAW,
        "clicks JOIN customer ON user_id = c_custkey WHERE event_type IN ('view', 'click')",
    ),
    "favorites": (
        {
            "event_time": "CAST(CAST(ts AS DATE) AS VARCHAR(10))",
            "code_ru": "CASE WHEN event_id % 3 = 0 THEN k || '.0' END",
            "code_kz": "CASE WHEN event_id % 3 = 1 THEN CAST(k AS VARCHAR(20)) END",
            "operation": f"CASE WHEN event_id % 4 = 0 THEN '{schema.SET_OPERATION}' WHEN event_id % 4 < 3 THEN 'Add' END",
        }
        | _WHO_RAW,
        "clicks JOIN customer ON user_id = c_custkey WHERE event_type = 'signup'",
    ),
    "items": (
        {
            "item_code": "CASE WHEN p_partkey % 50 = 0 THEN '  ' ELSE p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.0' ELSE '' END END",
            "item_name": "p_name",
            "site_name": "CASE WHEN p_partkey % 10 = 0 THEN '-' ELSE p_name END",
            "item_kind": "CASE WHEN p_partkey % 13 = 0 THEN 'NULL' WHEN p_partkey % 13 < 3 THEN 'Носки' ELSE p_type END",
            "assortment": "p_type",
            "brand": "p_brand",
            "collection": "CASE WHEN p_partkey % 8 <> 0 THEN 'c' || p_size END",
            "season": "' '",
            "item_sex": "'null'",
            "composition": "CAST(p_size AS VARCHAR(20))",
            "site_category": "p_size || '.0'",
            "style_group": "CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'style' END",
            "photo": "'http://photo/' || p_partkey",
        },
        "part",
    ),
    "categories": (
        {"category_code": "k || '.0'", "category_name": "CASE WHEN k = 24 THEN '-' ELSE 'Brand#' || (k + 1) END", "parent_code": "CASE WHEN k > 4 THEN CAST(k % 5 AS VARCHAR(20)) END"},
        "(SELECT DISTINCT k % 25 AS k FROM clicks)",
    ),
}


# What raw cells of orders are made of, joined so that few bytes are dealt out: the people
# to the orders, which are fewer than their lines.
_ORDER_LINES = """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, o_orderdate, c_custkey, c_mktsegment, n_name, n_regionkey FROM lineitem JOIN
    (SELECT o_orderkey, o_orderdate, c_custkey, c_mktsegment, n_name, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) ON l_orderkey = o_orderkey"""


def source(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The rows of an export, before its cells are made of them by cells()."""
    for name in ("lineitem", "orders", "customer", "nation", "part", "events"):
        _read(spark, sf_dir, name, "*").createOrReplaceTempView(name)
    spark.sql("SELECT *, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events").createOrReplaceTempView("clicks")
    if kind == "orders":
        return written(spark.sql(_ORDER_LINES), "lines")
    own = "event_id, event_type, ts, k, c_custkey, c_mktsegment" if kind in ("views", "favorites") else "*"
    return spark.sql(f"SELECT {own} FROM {RAW[kind][1]}")


def cells(kind: str) -> dict[str, str]:
    """The cells of an export as expressions over its source()."""
    return {c: f"CAST({e} AS STRING)" for c, e in RAW[kind][0].items()}


def raw(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """An export of a kind as it is read from a file: strings, before any cleaning."""
    return source(spark, sf_dir, kind).selectExpr(*[f"{e} AS {c}" for c, e in cells(kind).items()])


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '\\.0$', '')"


def _category(x: str) -> str:
    return f"trim(regexp_replace({_bare(x)}, '[.,]', '', 'g'))"


def _cell(x: str) -> str:
    return f"CASE WHEN {x} NOT IN ('" + "', '".join(C.NULL_TOKENS) + f"') THEN {x} END"


_CODE = f"left(coalesce({_bare('code_ru')}, {_bare('code_kz')}), 6)"
_NUMBER = "CAST(trunc(coalesce(try_cast({} AS DOUBLE), 0)) AS BIGINT)"
_EARLY = "CASE WHEN month(event_date) * 100 + day(event_date) < month(born) * 100 + day(born) THEN 1 ELSE 0 END"
_PATH = ", ".join(f"nullif({_category(c)}, 'nan')" for c in ("cat_1", "cat_2", "cat_3"))
# What is made of raw columns by the name of the processed one, written anew in DuckDB's SQL.
_MADE = {
    "card_no": _cell(_bare("card_no")),
    "customer_id": _cell(_bare("customer_id")),
    "full_name": _cell("trim(coalesce(last_name, '') || ' ' || coalesce(first_name, '') || ' ' || coalesce(middle_name, ''))"),
    "birth_date": "born",
    "age": "CAST(age AS INTEGER)",
    "age_group": "CASE WHEN age IS NULL THEN 'Не указан' WHEN age <= 13 THEN 'до 14' WHEN age <= 25 THEN '14-25' WHEN age <= 35 THEN '26-35' WHEN age <= 45 THEN '36-45' WHEN age <= 55 THEN '46-55' WHEN age <= 65 THEN '56-65' ELSE '65+' END",
    "sex": "CASE sex WHEN 'male' THEN 'Мужской' WHEN 'female' THEN 'Женский' END",
    "email": _cell("email"),
    "phone": _cell(f"coalesce({_bare('phone_1')}, {_bare('phone_2')})"),
    "fav_category": f"CASE WHEN coalesce({_PATH}) IS NOT NULL THEN concat_ws('_', {_PATH}) END",
    "order_id": _cell(_bare("order_id")),
    "store": _cell(f"CASE store WHEN '{SITE}' THEN '{C.STORES[SITE]}' ELSE store END"),
    "qty": _NUMBER.format("qty"),
    "base_price": _NUMBER.format("base_price"),
    "base_amount": f"{_NUMBER.format('base_price')} * {_NUMBER.format('qty')}",
    "line_amount": _NUMBER.format("line_amount"),
    "discount_pct": f"CAST(coalesce(round_even(CASE WHEN base <> 0 THEN (base - {_NUMBER.format('line_amount')}) / CAST(base AS DOUBLE) * 100 END, 0), 0) AS BIGINT)",
    "currency": "CASE WHEN code_ru IS NOT NULL THEN 'RUB' WHEN code_kz IS NOT NULL THEN 'KZT' END",
}


def etl_sql(kind: str, selection: bool = False) -> str:
    """The processed table of a kind by DuckDB, from the same raw cells."""
    clicks = "clicks AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
    raws = ", ".join(f"raw_{k} AS (SELECT {', '.join(f'CAST({e} AS VARCHAR) AS {c}' for c, e in RAW[k][0].items())} FROM {RAW[k][1]})" for k in dict.fromkeys(("items", "categories", kind)))
    of = {"items": {"item_code": _bare("item_code"), "site_category": _category("site_category")}, "categories": {c: _category(c) for c in ("category_code", "parent_code")}}
    small = ", ".join(f"{k}_t AS (SELECT {', '.join(f'{_cell(of[k].get(c, c))} AS {c}' for c in schema.COLUMNS[k])} FROM raw_{k}{' WHERE length(trim(item_code)) > 0' if k == 'items' else ''})" for k in ("items", "categories"))
    if kind in ("items", "categories"):
        return f"WITH {clicks}, {raws}, {small} SELECT * FROM {kind}_t"
    code = f"coalesce({_cell(_category('category_code'))}, {_CODE})" if kind == "views" else _CODE
    keep = {"orders": "coalesce(code_ru, code_kz) IS NOT NULL", "views": "coalesce(code_ru, code_kz, category_code) IS NOT NULL", "favorites": f"coalesce(code_ru, code_kz) IS NOT NULL AND operation IS DISTINCT FROM '{schema.SET_OPERATION}'"}[kind]
    base = f", {_NUMBER.format('base_price')} * {_NUMBER.format('qty')} AS base" if kind == "orders" else ""
    facts = f"facts AS (SELECT *, CAST(try_cast(event_time AS TIMESTAMP) AS DATE) AS event_date, CAST(try_cast(birth_date AS TIMESTAMP) AS DATE) AS born, {code} AS own_code{base} FROM raw_{kind} WHERE {keep})"
    aged = f"aged AS (SELECT *, year(event_date) - year(born) - {_EARLY} AS age FROM facts)"
    made = _MADE | {"item_code": _cell("own_code"), "item_type": f"CASE WHEN {_cell(_category('aged.category_code'))} IS NOT NULL THEN 'Категория' ELSE 'Номенклатура' END", "event_date": "event_date", "item_name": "i.item_name", "item_kind": "i.item_kind", "site_name": "i.site_name", "category_name": "c.category_name"}
    where = "WHERE i.item_kind IS NULL OR i.item_kind NOT IN (" + ", ".join(f"'{k}'" for k in C.UNSELECTED_KINDS) + ")" if selection else ""
    join = "FROM aged LEFT JOIN items_t i ON own_code = i.item_code" + (" LEFT JOIN categories_t c ON own_code = c.category_code" if kind == "views" else "")
    return f"WITH {clicks}, {raws}, {small}, {facts}, {aged} SELECT {', '.join(f'{made[c]} AS {c}' for c in schema.COLUMNS[kind])} {join} {where}"


def sql(body: str) -> str:
    return f"WITH {SQL}\n{body}"
