"""The stored order of the ledger, what its scans skip, and column sets that change between commits."""

import datetime as dt
import glob
import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql import types as T

from razonete.operators import merge as M
from razonete.operators.audit import AuditContext
from razonete.operators.query import Filters, ledger_filter
from razonete.plans import fixtures as fx
from razonete.plans.maintenance import delete_records, edit_records
from razonete.schema import LEDGER_COLUMNS, LEDGER_SCHEMA
from razonete.sources import clustered as C
from razonete.sources.store import AuditLog, LedgerStore
from tests.conftest import SF001, SF01

AS_OF = dt.datetime(2025, 1, 1, 12, 0)
OLD_SCHEMA = T.StructType([f for f in LEDGER_SCHEMA.fields if f.name not in ("RATEIO", "ORIGEM")])


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def scans(df):
    """The scan nodes of an executed plan."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return [leaves.apply(i) for i in range(leaves.length())]


def rows_scanned(df):
    return sum(s.metrics().apply("numOutputRows").value() for s in scans(df))


def test_interleave_is_exact(spark):
    pairs = [(0, 0), (65535, 0), (0, 65535), (65535, 65535), (1, 2), (43690, 21845), (12345, 54321)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", C.interleave(F.col("a"), F.col("b")).alias("z")).collect()
    for r in got:
        want = sum(((r.a >> i & 1) << (2 * i + 1)) | ((r.b >> i & 1) << (2 * i)) for i in range(16))
        assert r.z == want


def test_account_numbers_keep_text_order_and_take_any_text(spark):
    texts = ["00000000", "10007919", "1000791", "99999999", "123456789012", "5", "", None, "ABC", "12 45678", "１２３４５６７８"]
    rows = spark.createDataFrame([(t,) for t in texts], "c string").select("c", C.account_number("c").alias("k")).collect()
    assert all(0 <= r.k < 10 ** 8 for r in rows)
    digits = sorted((r.c, r.k) for r in rows if r.c and r.c.isascii() and r.c.isdigit())
    assert [k for _, k in digits] == sorted(k for _, k in digits)


def test_codes_are_places_among_quantiles(spark):
    values = [i * i for i in range(3000)] + [77] * 1500          # one value holds a third of the rows
    df = spark.createDataFrame([(v, v) for v in values], "x long, c long").repartition(4)
    got = {r.x: r.c for r in C.with_codes(df, ["c"], bits=6).collect()}
    order = [got[x] for x in sorted(got)]
    assert order == sorted(order) and 0 <= order[0] and order[-1] == 63
    above = [x for x in got if x > 77]
    sizes = {}
    for x in above:
        sizes[got[x]] = sizes.get(got[x], 0) + 1
    assert max(sizes.values()) <= 2 * 4500 / 64
    nulls = C.with_codes(spark.createDataFrame([(None,)] * 2, "c long"), ["c"]).collect()
    assert [r.c for r in nulls] == [0, 0]


def test_lookup_reads_few_rows(spark, tmpdir_path):
    led = fx.led(spark, SF01)
    store = LedgerStore(spark, os.path.join(tmpdir_path, "ledger"), page_rows=100)
    store.replace_all(led, as_of=AS_OF)
    total = led.count()
    account = led.groupBy("N_CONTA").count().orderBy(F.desc("count"), "N_CONTA").first().N_CONTA
    f = Filters(n_conta=account, data_inicio="1995-01-01", data_fim="1996-12-31")
    hit = ledger_filter(store.read(), f)
    assert sorted(map(str, hit.collect())) == sorted(map(str, ledger_filter(led, f).collect()))
    # two of seven years, and of their files (about 30 pages) the stripe of one account, about the root of 30 pages
    assert 0 < rows_scanned(hit) < total / 12
    dates = ledger_filter(store.read(), Filters(data_inicio="1996-03-01", data_fim="1996-03-05"))
    n = len(dates.collect())
    assert n == ledger_filter(led, Filters(data_inicio="1996-03-01", data_fim="1996-03-05")).count()
    assert n <= rows_scanned(dates) < total / 4
    # a text inside the stored range of every file, which only the Bloom filters (or dictionaries) can rule out
    none = ledger_filter(store.read(), Filters(n_centro_custo="100000001x"))
    assert none.collect() == [] and rows_scanned(none) == 0


def test_files_are_bounded_and_ordered(spark, tmpdir_path):
    """300 versions of one row each, and one that holds most rows under one account and day."""
    small = spark.range(300).select(F.concat(F.lit("v"), F.col("id")).alias("VERSAO"), F.col("id").alias("n"))
    hot = spark.range(20000).select(F.lit("hot").alias("VERSAO"), (F.col("id") + 1000).alias("n"))
    rows = small.unionByName(hot).repartition(16).select(
        F.lit("12345678").alias("N_CONTA"), F.col("n").cast("string").alias("N_CENTRO_CUSTO"), F.lit("x").alias("DESCRICAO"),
        F.lit(1.0).alias("VALOR"), F.lit(dt.date(2024, 5, 1)).alias("DATA"), "VERSAO", F.lit("op").alias("OPERACAO"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("DATA_ATUALIZACAO"), F.lit("0101").alias("FILIAL"),
        F.lit(None).cast("string").alias("RATEIO"), F.lit(None).cast("string").alias("ORIGEM"))
    store = LedgerStore(spark, os.path.join(tmpdir_path, "ledger"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.replace_all(rows, as_of=AS_OF)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = glob.glob(os.path.join(tmpdir_path, "ledger", "snapshots", "**", "*.parquet"), recursive=True)
    assert len(files) <= 301 + 8
    hot_files = glob.glob(os.path.join(store.stored()["hot"].path("hot"), "*.parquet"))
    assert len(hot_files) >= 4      # one account and day, dealt over many tasks
    assert max(pq.ParquetFile(f).metadata.num_rows for f in hot_files) < 10000
    assert store.read().count() == 20300
    assert len(scans(store.read())) == 1


def test_rows_lie_in_key_order(spark, tmpdir_path):
    led = fx.led(spark, SF001)
    C.write_clustered(led.withColumn("p", F.col("VERSAO")), os.path.join(tmpdir_path, "t"), "p")
    files = glob.glob(os.path.join(tmpdir_path, "t", "*", "*.parquet"))
    places = led.select("N_CONTA", "DATA", C.account_number("N_CONTA").alias("a"), F.dayofyear("DATA").alias("d"))
    places = {(r.N_CONTA, r.DATA): r.z for r in C.with_codes(places, ["a", "d"]).select(
        "N_CONTA", "DATA", C.interleave(F.col("a"), F.col("d")).alias("z")).distinct().collect()}
    for f in files:
        t = pq.read_table(f, columns=["N_CONTA", "DATA"]).to_pylist()
        keys = [(r["DATA"].year, places[r["N_CONTA"], r["DATA"]]) for r in t]
        assert keys == sorted(keys)
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in files) == led.count()


def test_empty_and_null_rows(spark, tmpdir_path):
    store = LedgerStore(spark, os.path.join(tmpdir_path, "ledger"))
    assert store.read().columns == LEDGER_COLUMNS and store.read().count() == 0
    store.commit(spark.createDataFrame([], LEDGER_SCHEMA), touched=["2024 - V1"], as_of=AS_OF)
    assert store.read().count() == 0
    nulls = spark.createDataFrame([tuple([None] * 11)] * 3, T.StructType([T.StructField(f.name, f.dataType) for f in LEDGER_SCHEMA.fields]))
    store.commit(nulls, touched=[None], as_of=AS_OF)
    assert [r.VERSAO for r in store.read().collect()] == ["", "", ""]


def test_nine_columns_become_eleven(spark, tmpdir_path):
    """Written with 9 columns; merged, edited, cut and read with 11."""
    led, delta, edits = fx.led(spark, SF001), fx.delta(spark, SF001), fx.edits(spark, SF001)
    root = os.path.join(tmpdir_path, "ledger")
    LedgerStore(spark, root, OLD_SCHEMA).replace_all(led, as_of=AS_OF)
    store = LedgerStore(spark, root, defaults={"RATEIO": "NAO"})
    plain = led.withColumn("RATEIO", F.lit("NAO")).withColumn("ORIGEM", F.lit(None).cast("string"))
    assert same(store.read(), plain) and store.read().columns == LEDGER_COLUMNS
    versions = [r.VERSAO for r in delta.select("VERSAO").distinct().collect()]
    store.commit(M.merge_upsert(store.read(versions), delta, as_of=AS_OF), touched=versions, as_of=AS_OF)
    want = M.merge_upsert(plain, delta, as_of=AS_OF)
    assert same(store.read(), want)
    assert len({s.columns for s in store.stored().values()}) == 2 and len(scans(store.read())) == 2
    # the filter reaches the scan of the files that have the column
    assert same(ledger_filter(store.read(), Filters(rateio="NAO")), ledger_filter(want, Filters(rateio="NAO")))
    audit, ctx = AuditLog(spark, os.path.join(tmpdir_path, "audit")), AuditContext(as_of=AS_OF)
    assert edit_records(store, audit, edits, ctx) == edits.count()
    assert store.read().where("FILIAL = '0199' AND RATEIO = 'SIM'").count() == edits.count()
    f = Filters(rateio="NAO")
    n = store.read().where("RATEIO = 'NAO'").count()
    assert delete_records(store, audit, ctx, filters=f) == n > 0
    assert store.read().where("RATEIO = 'NAO'").count() == 0
    # a reader of the nine columns sees the same rows
    assert same(LedgerStore(spark, root, OLD_SCHEMA).read(), store.read().select(*OLD_SCHEMA.names))


def test_types_are_cast_and_old_logs_read(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "ledger")
    wide = T.StructType([T.StructField(f.name, T.DecimalType(18, 2) if f.name == "VALOR" else f.dataType) for f in LEDGER_SCHEMA.fields])
    led = fx.led(spark, SF001)
    LedgerStore(spark, root, wide).replace_all(led.withColumn("VALOR", F.col("VALOR").cast("decimal(18,2)")), as_of=AS_OF)
    got = LedgerStore(spark, root).read()
    assert got.schema["VALOR"].dataType == T.DoubleType()
    assert same(got, led.withColumn("VALOR", F.col("VALOR").cast("decimal(18,2)").cast("double")))
    # a log written before columns were kept
    older = os.path.join(tmpdir_path, "older")
    store = LedgerStore(spark, older)
    store.replace_all(led, as_of=AS_OF)
    spark.read.parquet(store.log_path).drop("COLUNAS").write.parquet(f"{older}/_log2")
    store_log = type("OldLog", (LedgerStore,), {"log_path": property(lambda s: f"{s.root}/_log2")})(spark, older)
    assert same(store_log.read(), led)
