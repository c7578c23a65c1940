"""Other databases, DDL, stored models, and what the library may import."""

from pathlib import Path

from gristmill import schemas
from gristmill.operators import dashboard, quality
from gristmill.sources import tables

URL = "jdbc:derby:memory:gristmill;create=true"
DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"


def test_jdbc(spark, tmp_path):
    df = spark.createDataFrame([(i, f"name {i}") for i in range(20)], "K int, V string")
    df.write.format("jdbc").options(url=URL, dbtable="things", driver=DRIVER).mode("overwrite").save()
    got = tables.scan_jdbc(spark, URL, "SELECT * FROM things WHERE k >= 5", partition=("K", 0, 20, 3), driver=DRIVER)
    assert sorted(map(tuple, got.collect())) == [(i, f"name {i}") for i in range(5, 20)] and got.rdd.getNumPartitions() == 3
    df.write.parquet(f"{tmp_path}/things.parquet")
    assert tables.choose(spark, str(tmp_path), "things").count() == tables.choose(spark, str(tmp_path), "things", URL, driver=DRIVER).count() == 20


def test_ddl(spark, tmp_path):
    spark.sql(f"CREATE DATABASE gristmill_test LOCATION 'file://{tmp_path}/db'")
    try:
        for _ in range(2):
            schemas.create_tables(spark, "gristmill_test")
        for name, schema in schemas.TABLES.items():
            assert [(f.name, f.dataType) for f in spark.table(f"gristmill_test.{name}").schema] == [(f.name, f.dataType) for f in schema]
    finally:
        spark.sql("DROP DATABASE gristmill_test CASCADE")


def test_models_are_stored(spark, tmp_path):
    rows = [(i, "a", "short" if i % 2 else "a much longer remark, with reasons.", 0, i % 2) for i in range(20)]
    df = quality.with_features(spark.createDataFrame(rows, "review_id int, app_name string, text string, thumbs_up int, low_quality_label int"))
    moments, model = quality.train(df)
    tables.save_model(model, str(tmp_path / "model"))
    again = tables.load_model(str(tmp_path / "model"))
    pick = lambda m: {r.review_id: r.quality_score for r in quality.predict(df, moments, m).collect()}
    assert pick(model) == pick(again)


def test_cache_has_a_lifetime(spark):
    now, made = [0.0], []
    get = dashboard.Cached(lambda: made.append(1) or spark.range(3), clock=lambda: now[0])
    first = get()
    assert first.count() == 3 and first.storageLevel.useMemory and get() is first
    now[0] = 299.0
    assert get() is first and len(made) == 1
    now[0] = 300.0
    assert get() is not first and len(made) == 2
    get.clear()


def test_other_database_that_does_not_answer(spark, tmp_path):
    spark.range(4).write.parquet(f"{tmp_path}/things.parquet")
    assert tables.choose(spark, str(tmp_path), "things", "jdbc:derby:memory:nowhere", driver=DRIVER).count() == 4
    schema = spark.range(1).schema
    assert tables.read_or_empty(spark, lambda: spark.read.parquet(f"{tmp_path}/absent.parquet"), schema).count() == 0
    assert tables.read_or_empty(spark, lambda: spark.read.parquet(f"{tmp_path}/things.parquet").select("nothing"), schema).schema == schema


def test_the_library_does_not_import_llm():
    root = Path(__file__).resolve().parents[1] / "gristmill"
    own = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert own and not [p for p in own if "gristmill.llm" in p.read_text() or "corpus_pipeline" in p.read_text()]
