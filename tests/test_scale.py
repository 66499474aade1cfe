"""Work that must be dealt out to many tasks as tables grow."""

from pyspark.sql import functions as F

from retailflow import storage
from retailflow.functions import clean as C
from retailflow.operators import relational as R
from retailflow.plans import catalog, ingest, testbed
from retailflow.sources import schema, tables

SF = "/root/testdata/sf0.001"


def with_conf(spark, run, **conf):
    old = {k: spark.conf.get(f"spark.sql.{k.replace('_', '.')}") for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(f"spark.sql.{k.replace('_', '.')}", v)
        return run()
    finally:
        for k, v in old.items():
            spark.conf.set(f"spark.sql.{k.replace('_', '.')}", v)


def test_rows_of_one_date_are_sorted_by_many_tasks(spark):
    for pos in ([], [F.col("id").alias("pos")]):
        rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, F.lit("2024-01-01").cast("date")).alias("event_date"), *pos)
        sizes = with_conf(spark, lambda: R.sorted_by_date(rows).groupBy(F.spark_partition_id()).count().collect(), adaptive_enabled="false")  # noqa: B023
        assert max(r["count"] for r in sizes) < 10_000
        dates = [r.event_date for r in R.sorted_by_date(rows).collect()]
        assert all(d is not None for d in dates[:2000]) and not any(dates[2000:])


def test_loaded_events_are_written_without_dealing_them_by_date(spark, tmp_path, monkeypatch):
    plans = []

    def put(df, *args, **more):
        plans.append(df._jdf.queryExecution().toString())

    monkeypatch.setattr(tables, "write_table", put)
    items = catalog._etl(spark, SF, "items")
    monkeypatch.setattr(tables, "require_tables", lambda *a: None)
    monkeypatch.setattr(tables, "read_table", lambda *a, **k: items)
    monkeypatch.setattr(tables, "read_raw", lambda *a: testbed.raw(spark, SF, "orders"))
    ingest.load(spark, str(tmp_path), "orders", str(tmp_path), "append")
    assert plans and "rangepartitioning(event_date" not in plans[0]


def test_quoted_cells_are_written_by_many_tasks(spark, monkeypatch):
    seen, put = [], catalog._exported
    monkeypatch.setattr(catalog, "_exported", lambda s, df, *a, **k: (seen.append(df.rdd.getNumPartitions()), put(s, df, *a, **k))[1])
    with_conf(spark, lambda: catalog._quoted(spark, SF), adaptive_enabled="false", autoBroadcastJoinThreshold="-1")
    assert seen[0] > 1


def test_cleaning_makes_methods_that_java_compiles(spark):
    """Java leaves methods of more than 8000 bytes to its interpreter."""
    raw, items = testbed.raw(spark, SF, "orders"), catalog._etl(spark, SF, "items")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    plan = with_conf(spark, lambda: ingest.orders(raw, items)._jdf.queryExecution().executedPlan(), adaptive_enabled="false")
    stages = debug.codegenStringSeq(plan)
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert max(sizes) < 8000, sizes


def test_cells_and_ids_keep_their_rules(spark):
    cells = [None, *C.NULL_TOKENS, "12.0", "1.0.0", "7.05", ".0", "x", "1.0\n"]
    rows = spark.createDataFrame([(c, i) for i, c in enumerate(cells)], "c string, i int")
    got = ingest._nulls(rows).orderBy("i").collect()
    assert [r.c for r in got] == [None if c in C.NULL_TOKENS else c for c in cells]
    same = rows.select(C.bare_id("c").eqNullSafe(F.regexp_replace("c", r"\.0$", "")).alias("s")).collect()
    assert all(r.s for r in same)


def test_models_read_written_inputs(spark, monkeypatch):
    """Training reads its inputs many times; none is computed anew from the source tables."""
    seen = []
    monkeypatch.setattr(catalog.M, "als", lambda *a: seen.extend(a[:3]))
    catalog._factors(spark, SF, "als")
    assert len(seen) == 3 and all(SF not in f for df in seen for f in df.inputFiles())


def below_exchange(df):
    """What a plan has below its first exchange, and in it the rows that move."""
    return df._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)[1]


def test_cells_are_made_after_rows_are_dealt_out(spark, monkeypatch):
    """A phone's digits stand in its cell's expression: rows that are joined and sorted hold no cells yet."""
    moved, put = [], ingest.written
    monkeypatch.setattr(ingest, "written", lambda df, name: (moved.append(df), put(df, name))[1])
    for name in ("etl_orders", "etl_orders_selection"):
        out = with_conf(spark, lambda: below_exchange(catalog.QUERIES[name](spark, SF)), adaptive_enabled="false")  # noqa: B023
        assert "79990000000" not in out and "email" not in out
    assert len(moved) == 2 and "email" not in moved[0].columns
    assert "79990000000" not in with_conf(spark, lambda: moved[0]._jdf.queryExecution().executedPlan().toString(), adaptive_enabled="false")


def test_shuffle_files_go_with_the_write(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before, key = shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    df = storage.written(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    assert not shuffled() - before and df.count() == 10 and spark.conf.get(key, None) == old


def test_exports_are_loaded_in_batches_that_become_one_table(spark, tmp_path, monkeypatch):
    path, folder = str(tmp_path / "export"), str(tmp_path / "tables")
    sep, names = schema.RAW["orders"]
    raw = testbed.raw(spark, SF, "orders").select(*[F.col(v).alias(k) for k, v in names.items()])
    raw.repartition(3).write.options(sep=sep, header=True, compression="gzip").csv(path)
    tables.write_table(catalog._etl(spark, SF, "items"), folder, "items")
    rows = lambda: sorted(map(str, tables.read_table(spark, folder, "orders", False).collect()))
    ingest.load(spark, path, "orders", folder)
    whole, at = rows(), tables.table_path(folder, "orders")
    monkeypatch.setattr(tables, "BATCH_BYTES", 1)
    assert [len(b) for b in tables.batches(spark, path)] == [1, 1, 1]
    put, done = tables._write_version, []

    def fails(*args):
        done.append(args[1])
        if len(done) == 2:
            raise OSError("in the second batch")
        put(*args)

    with monkeypatch.context() as m:
        m.setattr(tables, "_write_version", fails)
        try:
            ingest.load(spark, path, "orders", folder)
        except OSError:
            pass
    assert len(done) == 2 and not any(tables.exists(spark, d) for d in done) and rows() == whole
    ingest.load(spark, path, "orders", folder)
    assert len(tables.manifest(spark, at)["versions"]) == 3 and rows() == whole
    assert ingest.load(spark, path, "orders", folder, "append").count() == len(whole)
    assert tables.read_table(spark, folder, "orders", False).count() == 2 * len(whole)


def test_exports_go_when_they_are_loaded(spark, monkeypatch):
    made, put = [], catalog.new_folder
    monkeypatch.setattr(catalog, "new_folder", lambda s, name: (made.append(put(s, name)), made[-1])[1])
    since = storage.written_so_far(spark)
    assert catalog.QUERIES["loaded_orders"](spark, SF).count()
    assert [tables.exists(spark, f) for f in made] == [True, False, False, False]
    assert storage.written_so_far(spark) == since


def test_a_report_loads_rows_without_dealing_them_by_date(spark, monkeypatch):
    plans, put = [], tables.write_table
    monkeypatch.setattr(tables, "write_table", lambda df, *a, **k: (plans.append(df._jdf.queryExecution().toString()), put(df, *a, **k))[1])
    assert catalog.QUERIES["loaded_orders_report"](spark, SF).count() > 30
    assert len(plans) == 2 and "rangepartitioning(event_date" not in plans[1]
