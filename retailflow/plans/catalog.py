"""Named queries over the driver tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.functions import clean as C
from retailflow.operators import interactions as I
from retailflow.operators import kpi as K
from retailflow.operators import recommend as M
from retailflow.operators import relational as R
from retailflow.plans import ingest, reports
from retailflow.plans import testbed as B
from retailflow.sources import schema, tables
from retailflow.storage import drop_folder, drop_written, freed, new_folder, written, written_so_far

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CFG = I.Config()
#: Rows in a file of an export at most; a compressed file is read by one task.
EXPORT_ROWS = 500_000


def add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = B.sql(sql)


def over(kind: str, name: str, run, sql: str, variants: bool = True) -> None:
    """A query on a logical table, and the same on its selection. In the SQL, {t} is the table."""
    source = {"orders": B.orders, "views": B.views, "favorites": B.favorites}[kind]
    add(name, lambda s, d: run(source(s, d)), sql.replace("{t}", f"{kind}_l"))
    if variants:
        add(f"{name}_selection", lambda s, d: run(R.selection(source(s, d), kinds=B.UNSELECTED)), sql.replace("{t}", f"{kind}_s"))


# ---------------------------------------------------------------- sources, filters, joins



def N():  # noqa: N802
    return F.count(F.lit(1))


def QTY():  # noqa: N802
    return F.sum("qty").cast("long")


ORDER_COLUMNS = "event_date, order_id, store, item_code, item_name, item_kind, site_name, qty, base_price, base_amount, line_amount, discount_pct, currency, customer_id, sex, birth_date, age, age_group"
over("orders", "orders_enriched", lambda d: d.select(*ORDER_COLUMNS.split(", ")), f"SELECT {ORDER_COLUMNS} FROM {{t}}")
VIEW_COLUMNS = "event_date, item_code, item_name, item_kind, site_name, category_name, item_type, customer_id, sex, birth_date, age, age_group"
over("views", "views_enriched", lambda d: d.select(*VIEW_COLUMNS.split(", ")), f"SELECT {VIEW_COLUMNS} FROM {{t}}")
FAV_COLUMNS = "event_date, item_code, item_name, item_kind, site_name, customer_id, sex, birth_date, age, age_group"
over("favorites", "favorites_enriched", lambda d: d.select(*FAV_COLUMNS.split(", ")), f"SELECT {FAV_COLUMNS} FROM {{t}}")


def _table_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a folder holds into which the lookups of the exports were loaded."""
    folder = new_folder(spark, "tables")
    for kind in ("items", "categories"):
        tables.write_table(_etl(spark, sf_dir, kind), folder, kind)
    return tables.status(spark, folder)


add("catalog_status", _table_status, "SELECT * FROM (VALUES ('orders', false), ('views', false), ('favorites', false), ('items', true), ('categories', true)) AS t(\"table\", present)")
# codes with several names, of which the place in the table decides
_MANY = "SELECT p_partkey % 50 AS item_code, CASE WHEN p_partkey % 7 <> 0 THEN p_name || ' ' || p_partkey END AS site_name, p_partkey AS pos FROM part"


def _many_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    return spark.sql(_MANY)


add("item_names_by_place", lambda s, d: tables.item_names(_many_names(s, d)), f"SELECT item_code, arg_max(site_name, pos) AS site_name FROM ({_MANY}) WHERE site_name IS NOT NULL GROUP BY 1")
add("first_names_by_place", lambda s, d: R.first_by(_many_names(s, d), "item_code", "site_name", "pos"), f"SELECT item_code, arg_min(site_name, pos) AS site_name FROM ({_MANY}) WHERE site_name IS NOT NULL GROUP BY 1")
add("item_names", lambda s, d: tables.item_names(B.items(s, d)).select(F.col("item_code"), "site_name"), "SELECT item_code, site_name FROM items_l WHERE site_name IS NOT NULL")
over("views", "drop_all_null_keys", lambda d: R.drop_all_null(d, ["category_name", "site_name"]).groupBy("item_type").agg(N().alias("n")), "SELECT item_type, count(*) AS n FROM {t} WHERE coalesce(category_name, site_name) IS NOT NULL GROUP BY 1", False)
over("views", "drop_any_null_keys", lambda d: R.drop_any_null(d, ["site_name", "sex"]).groupBy("item_type").agg(N().alias("n")), "SELECT item_type, count(*) AS n FROM {t} WHERE site_name IS NOT NULL AND sex IS NOT NULL GROUP BY 1", False)
over("orders", "not_equal_filter", lambda d: R.not_equal(d, "item_kind", "PROMO").groupBy("item_kind").agg(N().alias("n")), "SELECT item_kind, count(*) AS n FROM {t} WHERE item_kind IS DISTINCT FROM 'PROMO' GROUP BY 1", False)
over("orders", "selection_filter", lambda d: R.selection(d, kinds=B.UNSELECTED).groupBy("item_kind").agg(N().alias("n"), QTY().alias("qty")), f"SELECT item_kind, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty FROM {{t}} WHERE item_kind IS NULL OR item_kind NOT IN {B.UNSELECTED} GROUP BY 1", False)
over("orders", "age_range_filter", lambda d: R.between_ages(d).groupBy("age").agg(N().alias("n")), "SELECT age, count(*) AS n FROM {t} WHERE age BETWEEN 18 AND 80 GROUP BY 1", False)
over("orders", "customer_lookup", lambda d: d.where(F.col("customer_id") == 7).select("order_id", "item_code", "qty"), "SELECT order_id, item_code, qty FROM {t} WHERE customer_id = 7", False)
over("orders", "first_names", lambda d: R.first_by(d, "item_code", "site_name", "order_id"), "SELECT item_code, min(site_name) AS site_name FROM {t} WHERE site_name IS NOT NULL GROUP BY 1", False)
over("orders", "sorted_by_date", lambda d: R.sorted_by_date(d.groupBy("event_date").agg(QTY().alias("qty"))), "SELECT event_date, CAST(sum(qty) AS BIGINT) AS qty FROM {t} GROUP BY 1 ORDER BY 1 NULLS LAST", False)

# ---------------------------------------------------------------- pipelines from raw exports


def _etl(spark: SparkSession, sf_dir: str, kind: str, ordered: bool = True) -> DataFrame:
    """A processed table by the pipelines, from raw cells over the driver's tables."""
    if kind in ("items", "categories"):
        return getattr(ingest, kind)(B.raw(spark, sf_dir, kind))
    needs = ["items", "categories"] if kind == "views" else ["items"]
    known, since = [_etl(spark, sf_dir, n) for n in needs], written_so_far(spark)
    rows, until = B.source(spark, sf_dir, kind), written_so_far(spark)
    out = getattr(ingest, kind)(rows, *known, cells=B.cells(kind), ordered=ordered)
    if ordered:  # rests on joined rows that are written
        drop_written(spark, since, until)
    return out


for kind in schema.COLUMNS:
    QUERIES[f"etl_{kind}"] = lambda s, d, k=kind: _etl(s, d, k)
    ORACLES[f"etl_{kind}"] = B.etl_sql(kind)
    if kind not in ("items", "categories"):
        QUERIES[f"etl_{kind}_selection"] = lambda s, d, k=kind: R.selection(_etl(s, d, k))
        ORACLES[f"etl_{kind}_selection"] = B.etl_sql(kind, True)


def _loaded(spark: SparkSession, sf_dir: str, kind: str, selection: bool | None, modes: tuple[str, ...] = ("replace",)) -> DataFrame:
    """A table that was loaded from export files of the raw cells, as the command line does.

    The exports are compressed, in files of bounded length, and go once they are loaded.
    """
    folder = new_folder(spark, "tables")
    for name in dict.fromkeys(("items", "categories", kind)):
        sep, names = schema.RAW[name]
        path, since = new_folder(spark, "export"), written_so_far(spark)
        with freed(spark):
            raw = B.raw(spark, sf_dir, name).select(*[F.col(v).alias(k) for k, v in names.items()])
            raw.write.options(sep=sep, header=True, quote='"', escape='"', emptyValue="", compression="gzip", maxRecordsPerFile=EXPORT_ROWS).csv(path)
        drop_written(spark, since)
        for mode in modes if name == kind else ("replace",):
            ingest.load(spark, path, name, folder, mode)
        drop_written(spark, since)
        drop_folder(spark, path)
    return tables.read_table(spark, folder, kind, selection).select(*schema.COLUMNS[kind])


def _written_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "csv")
    tables.write_csv(_etl(spark, sf_dir, "categories"), path)
    return tables.read_processed(spark, path)


QUERIES["loaded_orders"] = lambda s, d: _loaded(s, d, "orders", False)
ORACLES["loaded_orders"] = B.etl_sql("orders")
QUERIES["loaded_favorites_selection"] = lambda s, d: _loaded(s, d, "favorites", None)
ORACLES["loaded_favorites_selection"] = B.etl_sql("favorites", True)
QUERIES["loaded_views_twice"] = lambda s, d: _loaded(s, d, "views", False, ("replace", "append")).groupBy("item_type").agg(N().alias("n"))
ORACLES["loaded_views_twice"] = f"SELECT item_type, 2 * count(*) AS n FROM ({B.etl_sql('views')}) GROUP BY 1"


# Letters of the table's names and Russian ones in their place, so that charsets matter.
_LATIN, _RUSSIAN = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопкрстувщюыз"
_CHARSETS = ("UTF-8", "windows-1251", "KOI8-R", "IBM866", "UTF-16LE")
_CELLS = {"item_code": "item_code", "item_name": f"translate(item_name, '{_LATIN}', '{_RUSSIAN}')", "brand": "brand", "item_kind": "item_kind"}


def _exported(spark: SparkSession, df: DataFrame, kind: str, **options) -> str:
    path = new_folder(spark, "export")
    sep, names = schema.RAW[kind]
    df = df.select(*[(F.col(v) if v in df.columns else F.lit(None).cast("string")).alias(k) for k, v in names.items()])
    key, old = "spark.sql.legacy.javaCharsets", spark.conf.get("spark.sql.legacy.javaCharsets", None)
    spark.conf.set(key, "true")  # for the writer: charsets beyond Unicode's own
    try:
        df.write.options(sep=sep, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, **options).csv(path)
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
    return path


def _charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items in exports of several charsets, which reading has to detect."""
    raw, out = B.raw(spark, sf_dir, "items").selectExpr(*[f"{e} AS {c}" for c, e in _CELLS.items()]), None
    for name in _CHARSETS:
        got = tables.read_raw(spark, _exported(spark, raw, "items", encoding=name), "items").select(F.lit(name).alias("charset"), *_CELLS)
        out = got if out is None else out.unionByName(got)
    return out


def _quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in files with quotes, separators and line feeds in cells, each read by many tasks.

    A range has 256 kB, or where that would be more than some two hundred ranges its share of
    the bytes, up to what the session has.
    """
    raw = B.raw(spark, sf_dir, "orders").selectExpr("order_id", "qty", "store || chr(10) || '\"' || qty || '\"' || chr(10) || chr(10) || 'x;|y' AS store")
    path = _exported(spark, raw, "orders")
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(old)
    spark.conf.set(key, str(min(most, max(256 << 10, tables.bytes_of(spark, path) // 200))))
    try:
        return written(tables.read_raw(spark, path, "orders", "UTF-8").select("order_id", "qty", "store"), "quoted")
    finally:
        spark.conf.set(key, old)


QUERIES["loaded_charsets"] = _charsets
ORACLES["loaded_charsets"] = f"WITH raw AS (SELECT {', '.join(f'CAST({e} AS VARCHAR) AS {c}' for c, e in B.RAW['items'][0].items())} FROM part) SELECT charset, {', '.join(f'{e} AS {c}' for c, e in _CELLS.items())} FROM raw, (SELECT unnest({list(_CHARSETS)}) AS charset)".replace("item_kind AS item_kind", "nullif(item_kind, '') AS item_kind")
QUERIES["loaded_quoted_cells"] = _quoted
ORACLES["loaded_quoted_cells"] = f"WITH raw AS (SELECT {', '.join(f'CAST({e} AS VARCHAR) AS {c}' for c, e in B.RAW['orders'][0].items())} FROM {B.RAW['orders'][1]}) SELECT order_id, qty, store || chr(10) || '\"' || qty || '\"' || chr(10) || chr(10) || 'x;|y' AS store FROM raw"
QUERIES["processed_csv"] = _written_csv
ORACLES["processed_csv"] = B.etl_sql("categories")
QUERIES["appended_rows"] = lambda s, d: tables.append_all(_etl(s, d, "categories"), _etl(s, d, "items").select("item_code", F.col("item_name").alias("category_name")))
ORACLES["appended_rows"] = f"SELECT category_code, category_name, parent_code, NULL::VARCHAR AS item_code FROM ({B.etl_sql('categories')}) UNION ALL SELECT NULL, item_name, NULL, item_code FROM ({B.etl_sql('items')})"

# ---------------------------------------------------------------- scalar functions
over("orders", "clean_discount", lambda d: d.groupBy("discount_pct").agg(N().alias("n")), "SELECT discount_pct, count(*) AS n FROM {t} GROUP BY 1", False)
over("orders", "clean_age_group", lambda d: d.groupBy("age_group").agg(N().alias("n")), "SELECT age_group, count(*) AS n FROM {t} GROUP BY 1", False)
over("orders", "currency_flag", lambda d: d.groupBy("currency").agg(N().alias("n")), "SELECT currency, count(*) AS n FROM {t} GROUP BY 1", False)
over("orders", "clean_sex", lambda d: d.select(C.label("sex").alias("sex")).groupBy("sex").agg(N().alias("n")), "SELECT coalesce(sex, 'Не указан') AS sex, count(*) AS n FROM {t} GROUP BY 1", False)
over("orders", "month_names", lambda d: d.groupBy(F.year("event_date").alias("year"), C.month_name(F.month("event_date")).alias("month_name")).agg(QTY().alias("qty")), "SELECT CAST(year(event_date) AS INTEGER) AS year, ['" + "', '".join(C.MONTHS) + "'][month(event_date)] AS month_name, CAST(sum(qty) AS BIGINT) AS qty FROM {t} GROUP BY 1, 2", False)
over("orders", "amount_texts", lambda d: d.groupBy("store").agg(C.grouped(F.sum("line_amount")).alias("amount")), "SELECT store, replace(format('{:,}', CAST(sum(line_amount) AS BIGINT)), ',', '.') AS amount FROM {t} GROUP BY 1", False)


def _customers(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/customer.parquet")


def _parts(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/part.parquet")


add(
    "clean_full_name",
    lambda s, d: _customers(s, d).select("c_custkey", C.full_name("c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")), F.when(F.col("c_custkey") % 2 == 0, F.lit("C"))).alias("full_name")),
    "SELECT c_custkey, trim(c_mktsegment || ' ' || CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE '' END || ' ' || CASE WHEN c_custkey % 2 = 0 THEN 'C' ELSE '' END) AS full_name FROM customer",
)
CELLS = (*C.NULL_TOKENS, " x ", "42", "Nan")
add(
    "clean_null_tokens",
    lambda s, d: _customers(s, d).select("c_custkey", C.known(F.element_at(F.array(*map(F.lit, CELLS)), (F.col("c_custkey") % len(CELLS) + 1).cast("int"))).alias("cell")),
    f"SELECT c_custkey, CASE WHEN c_custkey % {len(CELLS)} >= {len(C.NULL_TOKENS)} THEN [' x ', '42', 'Nan'][c_custkey % {len(CELLS)} - {len(C.NULL_TOKENS) - 1}] END AS cell FROM customer",
)
add(
    "clean_missing_times",
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", C.timestamp_or_epoch(F.when(F.col("o_orderkey") % 9 > 1, F.col("o_orderdate").cast("string")).when(F.col("o_orderkey") % 9 == 1, "bad")).alias("ts")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 1 THEN o_orderdate ELSE TIMESTAMP '1970-01-01' END AS ts FROM orders",
)
add(
    "clean_category_path",
    lambda s, d: _parts(s, d).select("p_partkey", C.category_path(F.concat(F.col("p_size").cast("string"), F.lit(".0")), F.when(F.col("p_partkey") % 2 == 0, F.lit("1,2")), F.col("p_type")).alias("path")),
    "SELECT p_partkey, concat_ws('_', CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 2 = 0 THEN '12' END, p_type) AS path FROM part",
)
add(
    "clean_ids",
    lambda s, d: _customers(s, d).select("c_custkey", C.bare_id(F.concat((F.col("c_custkey") + 79990000000).cast("string"), F.when(F.col("c_custkey") % 2 == 0, ".0").otherwise(""))).alias("phone"), C.item_code(F.when(F.col("c_custkey") % 4 != 0, F.concat((F.col("c_custkey") + 1234567).cast("string"), F.lit(".0"))), F.lit("999999.0")).alias("item_code")),
    "SELECT c_custkey, CAST(c_custkey + 79990000000 AS VARCHAR) AS phone, CASE WHEN c_custkey % 4 <> 0 THEN left(CAST(c_custkey + 1234567 AS VARCHAR), 6) ELSE '999999' END AS item_code FROM customer",
)
add(
    "clean_numbers",
    lambda s, d: _parts(s, d).select("p_partkey", C.whole(F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice").cast("string")).otherwise("x")).alias("price"), C.clipped_quantity(F.when(F.col("p_partkey") % 5 != 0, F.col("p_size").cast("string"))).alias("qty")),
    "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN CAST(trunc(p_retailprice) AS BIGINT) ELSE 0 END AS price, CAST(CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE greatest(1, least(10, p_size)) END AS DOUBLE) AS qty FROM part",
)
add(
    "clean_dates",
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", C.to_date(F.when(F.col("o_orderkey") % 9 != 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("bad")).alias("event_date")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS event_date FROM orders",
)
over("views", "views_by_type", lambda d: d.groupBy("item_type").agg(N().alias("n"), F.countDistinct("item_code").alias("codes")), "SELECT item_type, count(*) AS n, count(DISTINCT item_code) AS codes FROM {t} GROUP BY 1")

# ---------------------------------------------------------------- aggregates of the reports
over("orders", "orders_totals", lambda d: K.totals(d, qty=QTY(), orders=F.countDistinct("order_id"), clients=F.countDistinct("customer_id"), items=F.countDistinct("item_code")), "SELECT CAST(sum(qty) AS BIGINT) AS qty, count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS clients, count(DISTINCT item_code) AS items FROM {t}")
VIEW_KINDS = lambda k: F.countDistinct(F.when(F.col("item_type") == k, F.col("item_code")))
over("views", "views_totals", lambda d: K.totals(d, views=N(), clients=F.countDistinct("customer_id"), items=VIEW_KINDS(C.IS_ITEM), categories=VIEW_KINDS(C.IS_CATEGORY)), "SELECT count(*) AS views, count(DISTINCT customer_id) AS clients, count(DISTINCT CASE WHEN item_type = 'Номенклатура' THEN item_code END) AS items, count(DISTINCT CASE WHEN item_type = 'Категория' THEN item_code END) AS categories FROM {t}")
over("favorites", "favorites_totals", lambda d: K.totals(d, favorites=N(), clients=F.countDistinct("customer_id"), items=F.countDistinct("item_code")), "SELECT count(*) AS favorites, count(DISTINCT customer_id) AS clients, count(DISTINCT item_code) AS items FROM {t}")
for kind, name, measure, expr in (("orders", "client_qty_mean_median", QTY, "sum(qty)"), ("views", "views_per_client", N, "count(*)"), ("favorites", "favorites_per_client", N, "count(*)")):
    over(kind, name, lambda d, m=measure: K.per_client(d, m()), f"SELECT round_even(avg(v), 1) AS mean, CAST(median(v) AS DOUBLE) AS median FROM (SELECT CAST({expr} AS DOUBLE) AS v FROM {{t}} WHERE customer_id IS NOT NULL GROUP BY customer_id)")
for kind, name, measure, expr in (("orders", "sex_share_qty", QTY, "sum(qty)"), ("views", "sex_share_views", N, "count(*)"), ("favorites", "sex_share_favorites", N, "count(*)")):
    over(kind, name, lambda d, m=measure: K.sex_share(d, m()), f"SELECT sex, round_even(v / sum(v) OVER () * 100.0, 1) AS pct FROM (SELECT coalesce(sex, 'Не указан') AS sex, CAST({expr} AS DOUBLE) AS v FROM {{t}} GROUP BY 1)")
for kind, prefix in (("orders", ""), ("views", "views_"), ("favorites", "favorites_")):
    over(kind, f"{prefix}age_stats", K.age_stats, "SELECT coalesce(round_even(avg(age), 1), 0) AS mean_age, CAST(coalesce(median(age), 0) AS DOUBLE) AS median_age FROM {t} WHERE age BETWEEN 18 AND 80")
    over(kind, f"{prefix}age_group_mode", K.age_group_mode, "SELECT coalesce((SELECT age_group FROM {t} WHERE age BETWEEN 18 AND 80 GROUP BY 1 ORDER BY count(*) DESC, age_group LIMIT 1), 'Не указано') AS age_group")
    over(kind, f"{prefix}period", K.period, "SELECT min(event_date) AS date_from, max(event_date) AS date_to, strftime(min(event_date), '%d.%m.%Y') || ' — ' || strftime(max(event_date), '%d.%m.%Y') AS period FROM {t}")
MONTH_SQL = "SELECT CAST(year(event_date) AS INTEGER) AS year, CAST(month(event_date) AS INTEGER) AS month, ['" + "', '".join(C.MONTHS) + "'][month(event_date)] AS month_name, CAST({m} AS BIGINT) AS v FROM {t} GROUP BY 1, 2, 3 ORDER BY v DESC, 1, 2 LIMIT 1"
over("orders", "top_month", lambda d: K.top_month(d, QTY()), MONTH_SQL.replace("{m}", "sum(qty)"))
over("views", "views_top_month", lambda d: K.top_month(d, N()), MONTH_SQL.replace("{m}", "count(*)"))
over("favorites", "favorites_top_month", lambda d: K.top_month(d, N()), MONTH_SQL.replace("{m}", "count(*)"))
over("orders", "sparsity", K.sparsity, "SELECT round_even((1 - count(DISTINCT order_id) / CAST(count(DISTINCT customer_id) * count(DISTINCT item_code) AS DOUBLE)) * 100, 2) AS sparsity_pct FROM {t}")
over("orders", "sparsity_pairs", K.sparsity_pairs, "SELECT round_even((1 - count(DISTINCT (customer_id, item_code)) / CAST(count(DISTINCT customer_id) * count(DISTINCT item_code) AS DOUBLE)) * 100, 2) AS sparsity_pct FROM {t}")
FINANCE = """fin AS (SELECT currency, CAST(sum(line_amount) AS BIGINT) AS sales, CAST(round_even(avg(discount_pct), 0) AS BIGINT) AS discount_pct FROM {t} GROUP BY 1),
tick AS (SELECT currency, CAST(trunc(avg(v)) AS BIGINT) AS ticket FROM (SELECT currency, order_id, sum(line_amount) AS v FROM {t} WHERE order_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""
over("orders", "finance_by_currency", K.finance, f"SELECT * FROM (WITH {FINANCE} SELECT fin.currency, sales, ticket, discount_pct FROM fin LEFT JOIN tick USING (currency))")
over("orders", "finance_pivot", K.finance_pivot, f"SELECT * FROM (WITH {FINANCE} SELECT " + ", ".join(f"CAST(coalesce(max(CASE WHEN fin.currency = '{k}' THEN {c} END), 0) AS BIGINT) AS {c}_{k.lower()}" for k in ("RUB", "KZT") for c in ("sales", "ticket", "discount_pct")) + " FROM fin LEFT JOIN tick USING (currency))")
over("orders", "finance_text", K.finance_text, f"SELECT * FROM (WITH {FINANCE} SELECT fin.currency, replace(format('{{:,}}', sales), ',', '.') AS sales, replace(format('{{:,}}', ticket), ',', '.') AS ticket, discount_pct || '%' AS discount FROM fin LEFT JOIN tick USING (currency))")
over("orders", "top_items", K.top_items, "SELECT item_code, min(site_name) AS site_name, CAST(sum(qty) AS BIGINT) AS qty FROM {t} GROUP BY 1 ORDER BY qty DESC, item_code LIMIT 5")
over("orders", "top_stores", lambda d: R.top(d, ["store"], QTY(), 5, "qty"), "SELECT store, CAST(sum(qty) AS BIGINT) AS qty FROM {t} GROUP BY 1 ORDER BY qty DESC, store LIMIT 5")
over("orders", "top_items_text", lambda d: K.lines_text(K.top_items(d), "site_name", "item_code", "qty"), "SELECT string_agg(site_name || ' (' || item_code || ') — ' || qty, chr(10) ORDER BY qty DESC, item_code) AS text FROM (SELECT item_code, min(site_name) AS site_name, CAST(sum(qty) AS BIGINT) AS qty FROM {t} GROUP BY 1 ORDER BY qty DESC, item_code LIMIT 5)")
over("views", "top_viewed_items", lambda d: R.top(d.where(F.col("item_type") == C.IS_ITEM), ["item_code", "site_name"], N()), "SELECT item_code, site_name, count(*) AS n FROM {t} WHERE item_type = 'Номенклатура' AND site_name IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 5")
over("views", "top_viewed_categories", lambda d: R.top(d.where(F.col("item_type") == C.IS_CATEGORY), ["item_code", "category_name"], N()), "SELECT item_code, category_name, count(*) AS n FROM {t} WHERE item_type = 'Категория' AND category_name IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 5")
over("favorites", "top_favorites", lambda d: R.top(d, ["item_code", "site_name"], N()), "SELECT item_code, site_name, count(*) AS n FROM {t} WHERE site_name IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 5")

# ---------------------------------------------------------------- whole reports
PEOPLE = """
UNION ALL SELECT 'sex', sex, CAST(round_even(v / sum(v) OVER () * 100.0, 1) AS VARCHAR) FROM (SELECT coalesce(sex, 'Не указан') AS sex, CAST({m} AS DOUBLE) AS v FROM {t} GROUP BY 1)
UNION ALL SELECT 'age', 'mean_age', CAST(coalesce(round_even(avg(age), 1), 0) AS VARCHAR) FROM {t} WHERE age BETWEEN 18 AND 80
UNION ALL SELECT 'age', 'median_age', CAST(CAST(coalesce(median(age), 0) AS DOUBLE) AS VARCHAR) FROM {t} WHERE age BETWEEN 18 AND 80
UNION ALL SELECT 'age_group', 'age_group', coalesce((SELECT age_group FROM {t} WHERE age BETWEEN 18 AND 80 GROUP BY 1 ORDER BY count(*) DESC, age_group LIMIT 1), 'Не указано')
UNION ALL SELECT 'period', 'date_from', CAST(min(event_date) AS VARCHAR) FROM {t}
UNION ALL SELECT 'period', 'date_to', CAST(max(event_date) AS VARCHAR) FROM {t}
UNION ALL SELECT 'period', 'period', strftime(min(event_date), '%d.%m.%Y') || ' — ' || strftime(max(event_date), '%d.%m.%Y') FROM {t}
UNION ALL SELECT 'per_client', 'mean', CAST(round_even(avg(v), 1) AS VARCHAR) FROM (SELECT CAST({m} AS DOUBLE) AS v FROM {t} WHERE customer_id IS NOT NULL GROUP BY customer_id)
UNION ALL SELECT 'per_client', 'median', CAST(CAST(median(v) AS DOUBLE) AS VARCHAR) FROM (SELECT CAST({m} AS DOUBLE) AS v FROM {t} WHERE customer_id IS NOT NULL GROUP BY customer_id)
UNION ALL SELECT 'top_month', c.k, c.v FROM (SELECT unnest([{'k': 'year', 'v': CAST(y AS VARCHAR)}, {'k': 'month', 'v': CAST(mo AS VARCHAR)}, {'k': 'month_name', 'v': ['MONTHS'][mo]}, {'k': 'v', 'v': CAST(v AS VARCHAR)}]) AS c
    FROM (SELECT year(event_date) AS y, month(event_date) AS mo, CAST({m} AS BIGINT) AS v FROM {t} WHERE event_date IS NOT NULL GROUP BY 1, 2 ORDER BY v DESC, 1, 2 LIMIT 1))""".replace("MONTHS", "', '".join(C.MONTHS))
TOP = "\nUNION ALL SELECT '{s}', {name} || ' (' || item_code || ') — ' || n, CAST(n AS VARCHAR) FROM (SELECT item_code, {name}, count(*) AS n FROM {t} WHERE {w} AND {name} IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 5)"


def _cells(section: str, **cells: str) -> str:
    return "\nUNION ALL ".join(f"SELECT '{section}' AS section, '{k}' AS key, CAST({v} AS VARCHAR) AS value FROM {{t}}" for k, v in cells.items())


over(
    "views",
    "views_report",
    reports.views_report,
    _cells("totals", views="count(*)", clients="count(DISTINCT customer_id)", items="count(DISTINCT CASE WHEN item_type = 'Номенклатура' THEN item_code END)", categories="count(DISTINCT CASE WHEN item_type = 'Категория' THEN item_code END)")
    + PEOPLE.replace("{m}", "count(*)")
    + TOP.replace("{s}", "top_items").replace("{name}", "site_name").replace("{w}", "item_type = 'Номенклатура'")
    + TOP.replace("{s}", "top_categories").replace("{name}", "category_name").replace("{w}", "item_type = 'Категория'"),
)
over(
    "favorites",
    "favorites_report",
    reports.favorites_report,
    _cells("totals", favorites="count(*)", clients="count(DISTINCT customer_id)", items="count(DISTINCT item_code)") + PEOPLE.replace("{m}", "count(*)") + TOP.replace("{s}", "top_items").replace("{name}", "site_name").replace("{w}", "true"),
)
_ORDERS_REPORT = (
    "SELECT * FROM (WITH "
    + FINANCE
    + "\n"
    + _cells("totals", qty="CAST(sum(qty) AS BIGINT)", orders="count(DISTINCT order_id)", clients="count(DISTINCT customer_id)", items="count(DISTINCT item_code)")
    + PEOPLE.replace("{m}", "sum(qty)")
    + "\nUNION ALL SELECT 'sparsity', 'sparsity_pct', CAST(round_even((1 - count(DISTINCT order_id) / CAST(count(DISTINCT customer_id) * count(DISTINCT item_code) AS DOUBLE)) * 100, 2) AS VARCHAR) FROM {t}"
    + "".join(f"\nUNION ALL SELECT 'finance', '{c}_{k.lower()}', CAST(coalesce(max(CASE WHEN currency = '{k}' THEN {c} END), 0) AS VARCHAR) FROM {'tick' if c == 'ticket' else 'fin'}" for k in ("RUB", "KZT") for c in ("sales", "ticket", "discount_pct"))
    + "\nUNION ALL SELECT 'top_items', site_name || ' (' || item_code || ') — ' || qty, CAST(qty AS VARCHAR) FROM (SELECT item_code, coalesce(min(site_name), 'name not found (' || item_code || ')') AS site_name, CAST(sum(qty) AS BIGINT) AS qty FROM {t} WHERE item_code IS NOT NULL GROUP BY 1 ORDER BY qty DESC, 1 LIMIT 5)"
    + "\nUNION ALL SELECT 'top_stores', store, CAST(qty AS VARCHAR) FROM (SELECT store, CAST(sum(qty) AS BIGINT) AS qty FROM {t} WHERE store IS NOT NULL GROUP BY 1 ORDER BY qty DESC, 1 LIMIT 5))"
)
over("orders", "orders_report", reports.orders_report, _ORDERS_REPORT)

# ---------------------------------------------------------------- interactions and models

def _loaded_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report by kind over the tables of a folder that exports were loaded into."""
    folder, since = new_folder(spark, "tables"), written_so_far(spark)
    tables.write_table(_etl(spark, sf_dir, "items"), folder, "items")
    ingest.put(_etl(spark, sf_dir, "orders", ordered=False), folder, "orders", "replace")
    drop_written(spark, since)
    return reports.report(spark, folder, "orders", True)


QUERIES["loaded_orders_report"] = _loaded_report
ORACLES["loaded_orders_report"] = f"WITH loaded AS ({B.etl_sql('orders', True)}) SELECT * FROM ({_ORDERS_REPORT.replace('{t}', 'loaded')})"
EVENTS_SQL = """ev AS (
 SELECT customer_id AS "user", item_code AS item, CAST(event_date AS TIMESTAMP) AS ts, 5.0::DOUBLE * greatest(1, least(10, qty)) AS w, 0 AS src, pos FROM purchases_l
 UNION ALL SELECT customer_id, item_code, CAST(event_date AS TIMESTAMP), 3.0::DOUBLE, 1, pos FROM favorites_l
 UNION ALL SELECT customer_id, item_code, CAST(event_date AS TIMESTAMP), 1.0::DOUBLE, 2, pos FROM views_l WHERE item_type = 'Номенклатура'),
marked AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, src DESC, pos DESC) AS rn, count(*) OVER (PARTITION BY "user") AS n FROM ev),
train AS (SELECT "user", item, sum(w) AS w FROM marked WHERE NOT (rn = 1 AND n >= 2) GROUP BY 1, 2),
holdout AS (SELECT "user", item FROM marked WHERE rn = 1 AND n >= 2)"""


def _events(s: SparkSession, d: str) -> DataFrame:
    return I.events(B.purchases(s, d), B.favorites(s, d), B.views(s, d))


def _split(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return I.split(_events(s, d))


def model(name: str, run, body: str | None = None) -> None:
    add(name, run, f"SELECT * FROM (WITH {EVENTS_SQL} {body})" if body else None)


model("interactions", lambda s, d: _events(s, d).select("user", "item", F.col("ts").cast("date").alias("day"), "w", "src"), 'SELECT "user", item, CAST(ts AS DATE) AS day, w, src FROM ev')
model("train_pairs", lambda s, d: _split(s, d)[0], "SELECT * FROM train")
model("holdout", lambda s, d: _split(s, d)[1], "SELECT * FROM holdout")
model("holdout_unseen", lambda s, d: I.unseen_holdout(*_split(s, d)), 'SELECT h.* FROM holdout h ANTI JOIN train t ON h."user" = t."user" AND h.item = t.item')
model("events_per_user", lambda s, d: _events(s, d).groupBy("user").agg(N().alias("n")), 'SELECT "user", count(*) AS n FROM ev GROUP BY 1')
model("id_maps_users", lambda s, d: I.ids(_events(s, d), "user"), 'SELECT "user", CAST(row_number() OVER (ORDER BY "user") - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT "user" FROM ev)')
model("id_maps_items", lambda s, d: I.ids(_events(s, d), "item"), "SELECT item, CAST(row_number() OVER (ORDER BY item) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT item FROM ev)")
model("user_positives", lambda s, d: I.positives(_split(s, d)[0]).select("user", F.array_join("items", ",").alias("items")), """SELECT "user", string_agg(item, ',' ORDER BY item) AS items FROM train GROUP BY 1""")
model("user_profile", lambda s, d: I.profile(_events(s, d), 7), 'SELECT item, sum(w) AS w FROM ev WHERE "user" = 7 GROUP BY 1')
model("gram", lambda s, d: I.gram(_split(s, d)[0]), 'SELECT a.item AS i, b.item AS j, sum(a.w * b.w) AS g FROM train a JOIN train b ON a."user" = b."user" GROUP BY 1, 2')


def _coded(s: SparkSession, d: str) -> DataFrame:
    events = _events(s, d)
    users, items = (I.ids(events, c).withColumnRenamed("idx", f"{c}_idx") for c in ("user", "item"))
    return R.lookup(R.lookup(I.split(events)[0], users, "user", "inner"), items, "item", "inner").select("user_idx", "item_idx", "w")


def _saved(s: SparkSession, d: str) -> DataFrame:
    folder = new_folder(s, "artifacts")
    M.save(folder, CFG, train=_split(s, d)[0])
    return M.load(s, folder, "train")[1]["train"]


def _known(s: SparkSession, d: str) -> DataFrame:
    known = I.ids(_events(s, d).where("item % 3 <> 0"), "item")
    names = tables.item_names(B.items(s, d)).withColumnRenamed("item_code", "item")
    return R.lookup(I.known_items(I.profile(_events(s, d), 7), known), names, "item")


CODES = ", {0}s AS (SELECT {0} AS {1}, CAST(row_number() OVER (ORDER BY {0}) - 1 AS INTEGER) AS {1}_idx FROM (SELECT DISTINCT {0} FROM ev))"
model("coded_pairs", _coded, CODES.format('"user"', "u").replace('"user"s', "us") + CODES.format("item", "i").replace("items AS", "its AS") + ' SELECT u_idx AS user_idx, i_idx AS item_idx, w FROM train JOIN us ON "user" = u JOIN its ON item = i')
model("saved_pairs", _saved, "SELECT * FROM train")
model("known_profile", _known, 'SELECT item, sum(w) AS w, any_value(site_name) AS site_name FROM ev LEFT JOIN items_l ON item = item_code WHERE "user" = 7 AND item % 3 <> 0 GROUP BY 1')
COOC = """, co AS (SELECT a.item AS i, b.item AS j, count(*) AS c FROM train a JOIN train b ON a."user" = b."user" AND a.item <> b.item GROUP BY 1, 2),
sc AS (SELECT t."user", co.j AS item, sum(t.w * co.c) AS score FROM train t JOIN co ON t.item = co.i GROUP BY 1, 2),
un AS (SELECT s.* FROM sc s ANTI JOIN train t ON s."user" = t."user" AND s.item = t.item),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS INTEGER) AS rank FROM un QUALIFY rank <= 10)"""


def _cooc(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    train, held = _split(s, d)
    train = written(train, "train")
    # how many users have both items: the products of their numbers, each of which is 1
    co = I.gram(train.select("user", "item", F.lit(1.0).alias("w"))).where("i <> j").select(F.col("i").alias("item"), F.col("j").alias("other"), F.col("g").alias("b"))
    return M.ease_top(train, written(co, "together"), 10), held


model("cooc_topk", lambda s, d: _cooc(s, d)[0].select("user", "item", "score", "rank"), COOC + ' SELECT "user", item, score, rank FROM rk')
model("cooc_eval", lambda s, d: I.metrics(*_cooc(s, d), 10).select(F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"), "users"), COOC + ' SELECT round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS recall, round(avg(CASE WHEN rank IS NOT NULL THEN 1 / log2(rank + 1.0) ELSE 0 END), 6) AS ndcg, count(*) AS users FROM holdout h LEFT JOIN rk ON h."user" = rk."user" AND h.item = rk.item')


def _cooc_recommend(s: SparkSession, d: str) -> DataFrame:
    """The best items by co-occurrence for one customer, with their names."""
    events = _events(s, d)
    train = I.split(events)[0].select("user", "item", F.lit(1.0).alias("w"))
    co = I.gram(train).where("i <> j").select(F.col("i").alias("item"), F.col("j").alias("other"), F.col("g").alias("b"))
    return M.recommend(I.profile(events, 7), co, tables.item_names(B.items(s, d)), 10)


model(
    "cooc_recommend",
    _cooc_recommend,
    COOC
    + """, pr AS (SELECT item, sum(w) AS w FROM ev WHERE "user" = 7 GROUP BY 1),
s7 AS (SELECT co.j AS item, sum(pr.w * co.c) AS score FROM pr JOIN co ON pr.item = co.i GROUP BY 1),
u7 AS (SELECT s7.* FROM s7 ANTI JOIN pr ON s7.item = pr.item)
SELECT CAST(row_number() OVER (ORDER BY score DESC, item) AS INTEGER) AS rank, item, coalesce(site_name, '') AS site_name, score FROM u7 LEFT JOIN items_l ON item = item_code QUALIFY rank <= 10""",
)

# Factors that both dialects can write: remainders of an id's number.
_FACTORS = {"user": (7, 5, 3), "item": (5, 7, 11)}


def _factor_scores(s: SparkSession, d: str) -> DataFrame:
    events = _events(s, d)
    ids = {side: I.ids(events, side) for side in _FACTORS}
    factors = [ids[side].select(F.lit(side).alias("side"), "idx", F.array(*[(F.col("idx") % m - m // 2).cast("float") for m in of]).alias("factors")) for side, of in _FACTORS.items()]
    return M.factor_top(factors[0].unionByName(factors[1]), I.split(events)[0], ids["user"], ids["item"], 5).select("user", "item", "score", "rank")


model(
    "factor_scores",
    _factor_scores,
    ", " + ", ".join(f'{side}_n AS (SELECT "{side}", row_number() OVER (ORDER BY "{side}") - 1 AS idx FROM (SELECT DISTINCT "{side}" FROM ev))' for side in _FACTORS)
    + ", sc AS (SELECT \"user\", item, i.idx AS place, CAST(" + " + ".join(f"(u.idx % {a} - {a // 2}) * (i.idx % {b} - {b // 2})" for a, b in zip(*_FACTORS.values(), strict=True)) + " AS DOUBLE) AS score FROM user_n u, item_n i)"
    + ' SELECT "user", item, score, CAST(row_number() OVER (PARTITION BY "user" ORDER BY score DESC, place) AS INTEGER) AS rank FROM (SELECT sc.* FROM sc ANTI JOIN train t ON sc."user" = t."user" AND sc.item = t.item) QUALIFY rank <= 5',
)


def _ease(s: SparkSession, d: str):
    events = _events(s, d)
    train, held = I.split(events)
    train = written(train, "train")
    return events, train, held, M.ease(train, I.ids(events, "item"), CFG)


def _ease_topk(s: SparkSession, d: str) -> DataFrame:
    _, train, _, b = _ease(s, d)
    return M.ease_top(train, b, 20)


def _ease_eval(s: SparkSession, d: str) -> DataFrame:
    _, train, held, b = _ease(s, d)
    return M.ease_evaluate(train, held, b)


def _ease_recommend(s: SparkSession, d: str) -> DataFrame:
    events, _, _, b = _ease(s, d)
    return M.recommend(I.profile(events, 7), b, tables.item_names(B.items(s, d)), 10)


def _factors(s: SparkSession, d: str, kind: str):
    # each is read many times by training and scoring, and made once
    events = written(_events(s, d), "events")
    train, held = (written(df, name) for df, name in zip(I.split(events), ("train", "held"), strict=True))
    users, items = (written(I.ids(events, c), f"{c}s") for c in ("user", "item"))
    f = M.bpr(train, held, users, items, CFG) if kind == "bpr" else M.als(train, users, items, CFG)
    return f, train, held, users, items


def _factor_topk(kind: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        f, train, _, users, items = _factors(s, d, kind)
        return M.factor_top(f, train, users, items, 20)

    return run


def _bpr_eval(s: SparkSession, d: str) -> DataFrame:
    f, train, held, users, items = _factors(s, d, "bpr")
    return I.metrics(M.factor_top(f, train, users, items, 20), held, 20)


def _negatives(s: SparkSession, d: str) -> DataFrame:
    events = _events(s, d)
    return I.uniform_negatives(I.split(events)[0], I.ids(events, "item"))


model("ease_matrix", lambda s, d: _ease(s, d)[3])
model("ease_topk", _ease_topk)
model("ease_eval", _ease_eval)
model("ease_recommend", _ease_recommend)
model("bpr_topk", _factor_topk("bpr"))
model("bpr_eval", _bpr_eval)
model("als_topk", _factor_topk("als"))
DRAWN = """CAST('0x' || substr(md5(concat_ws(':', "user", item, '42'{})), 1, 8) AS BIGINT)"""
model("weighted_batch", lambda s, d: I.weighted_sample(_split(s, d)[0], CFG.batch), f'SELECT "user", item, w FROM train ORDER BY ln(({DRAWN.format("")} + 0.5) / 4294967296.0) / w DESC, "user", item LIMIT {CFG.batch}')
model(
    "negatives",
    _negatives,
    f""", its AS (SELECT item AS other, row_number() OVER (ORDER BY item) - 1 AS idx FROM (SELECT DISTINCT item FROM ev)),
tries AS (SELECT "user", item, k, {DRAWN.format(", '1', k")} % (SELECT count(*) FROM its) AS idx FROM train, generate_series(1, 25) AS g(k)),
free AS (SELECT r."user", r.item, r.k, i.other FROM tries r JOIN its i USING (idx) WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t."user" = r."user" AND t.item = i.other))
SELECT "user", arg_min(other, k) AS item FROM free GROUP BY "user", free.item""",
)
