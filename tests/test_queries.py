"""Registered queries against the SQL that states them, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon import queries
from quillon.plans.kg import KnowledgeGraph

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(repr(v.item() if hasattr(v, "item") else v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    assert canonical(queries.QUERIES[name](spark, str(SF)).toPandas()) == canonical(duck.execute(queries.ORACLES[name]).df())


def test_the_rest_run(spark):
    for name in sorted(set(queries.QUERIES) - set(queries.ORACLES)):
        assert queries.QUERIES[name](spark, str(SF)).count() > 0


def test_pages_that_share_a_url_have_answers_of_their_own(spark, tmp_path):
    for f in SF.glob("*.parquet"):
        if f.stem != "pages":
            (tmp_path / f.name).symlink_to(f)
    rows = [(i, f"http://h/{i // 22}", "") for i in range(88)] + [(88, None, ""), (-22, "http://h/0", ""), (-11, "http://h/0", ""), (None, "http://h/0", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for f in SF.glob("*.parquet"):
        if f.stem != "pages":
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for name in ("reached_endpoints", "endpoint_candidates", "dump_url_candidates"):
        assert canonical(queries.QUERIES[name](spark, str(tmp_path)).toPandas()) == canonical(con.execute(queries.ORACLES[name]).df())


@pytest.fixture
def plain_joins(spark):
    """Shuffled joins as planned, so that tests see where rows go."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def largest(df):
    """The rows of df's fullest partition."""
    return max(r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*df.columns))).collect())


def test_places_are_counted_in_all_tasks(spark, plain_joins):
    df = spark.range(1000).select((999 - F.col("id")).alias("k")).repartition(4).orderBy("k")
    x = queries._numbered(df)
    assert [(r.k, r.place) for r in x.orderBy("k").collect()] == [(i, i + 1) for i in range(1000)]
    assert dict(x.dtypes) == {"k": "bigint", "place": "int"} and largest(x) < 500
    assert queries._numbered(df.where("k < 0")).collect() == []


@pytest.mark.parametrize("few", (True, False))
def test_nodes_of_one_namespace_are_named_in_all_tasks(spark, plain_joins, few):
    g = KnowledgeGraph(spark.createDataFrame([], "graph_id string, s string"), spark.createDataFrame([("g", 0, "old", "http://e/#"), ("g", 1, "ex", "http://e/#")], "graph_id string, seq int, prefix string, ns string"), graphs=spark.createDataFrame([("g",)], "graph_id string"))
    g.few_bound = few
    s = F.concat(F.when(F.col("id") < 990, "http://e/#n").otherwise("http://other/n"), F.col("id").cast("string"))
    x = g.qnames(spark.range(1000).repartition(4).select(F.lit("g").alias("graph_id"), s.alias("s")))
    assert sorted(r.qname for r in x.collect()) == sorted(f"ex:n{i}" if i < 990 else f"<http://other/n{i}>" for i in range(1000))
    assert x.columns == ["graph_id", "s", "qname"] and largest(x) < 500
    del g.few_bound
    assert g.few_bound


def test_with_and_without_add_up(spark):
    r = queries.QUERIES["label_coverage"](spark, str(SF)).first()
    assert r.n_with + r.n_without == r.total == queries.QUERIES["named_classes"](spark, str(SF)).count()
