import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import baskets, bloom, graph, stats, text
from millrace.plans.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def both(spark, *pairs):
    return spark.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "src long, dst long")


@pytest.mark.parametrize("pairs, want", [([(1, 2), (2, 3), (3, 4), (4, 1)], [(1, 2, 3, 4)]), ([(1, 2), (2, 3), (3, 4), (4, 1), (1, 3)], []), ([(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)], [])])
def test_squares(spark, pairs, want):
    assert rows(graph.chordless_squares(graph.mutual_edges(both(spark, *pairs)))) == want


def test_one_way_edges_are_not_mutual(spark):
    assert rows(graph.mutual_edges(spark.createDataFrame([(1, 2), (3, 3)], "src long, dst long"))) == []


def test_traps_and_dead_ends(spark):
    e = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (4, 5), (5, 4), (5, 6)], "src long, dst long")
    assert rows(graph.spider_traps(e)) == [(1,), (2,), (3,)]
    assert rows(graph.dead_ends(e)) == [(6,)]


def test_ranks_sum_to_one(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    got = {r["node"]: r["rank"] for r in graph.page_rank(e, rounds=30).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and max(got, key=got.get) == 3


def test_walk(spark):
    m = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (2, 4), (3, 5), (4, 5)], "u long, v long")
    walk = [r["node"] for r in graph.biased_walks(m, 1.0, 1.0).filter("start = 1").orderBy("step").collect()]
    assert walk == [1, 2, 1, 2, 1]


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(200).select(F.concat(F.lit("k"), "id").alias("key"))
    assert bloom.probe(keys, bloom.build(keys, 2000, 4), 2000, 4).filter("not hit").count() == 0


def test_rules(spark):
    b = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (3, "a")], "basket long, item string")
    assert rows(baskets.frequent_pairs(b, 2)) == [("a", "b", 2)]
    assert [(r[0], r[1], round(r[2], 4)) for r in rows(baskets.association_rules(b, 2, 0.5))] == [("a", "b", 0.6667), ("b", "a", 1.0)]


def test_text(spark):
    d = spark.createDataFrame([(1, "aaa b"), (2, "aaa c"), (3, "")], "doc_id long, text string")
    assert dict(rows(text.word_initials(d)))["a"] == 1
    assert rows(text.shingle_counts(d)) == [(1, 3), (2, 3), (3, 0)]
    assert len(text.padded(d, 4).first()["tokens"]) == 4


def test_algebra_and_regression(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    y = 3 + x @ [1.0, -2.0, 0.5]
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y double")
    w = stats.least_squares(df, F.col("y"), [F.col("a"), F.col("b"), F.col("c")])
    assert np.allclose(w, [3, 1, -2, 0.5])
    cov = stats.covariance(df.select(F.array("a", "b", "c").alias("v")), "v", 3)
    assert np.allclose(cov, np.cov(x.T, bias=True))
    assert np.allclose([v for v, _ in stats.eigenpairs(cov)], np.linalg.eigvalsh(cov)[::-1], atol=1e-4)


def test_clusters(spark):
    p = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.1, 0.0]), (2, [5.0, 5.0]), (3, [5.0, 5.2])], "id long, v array<double>")
    centres = stats.lloyd(p, [c for _, c in stats.farthest_first(p, 2)])
    assert sorted(tuple(round(x, 3) for x in c) for c in centres) == [(0.05, 0.0), (5.0, 5.1)]


def test_every_query_has_a_stable_schema_or_sql():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) >= 30


@pytest.mark.parametrize("name", ["word_initials", "top_rules", "chordless_squares", "bloom_probe", "nearest_centre"])
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "documents", "embeddings", "lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    want = con.execute(ORACLES[name]).df()[sorted(df.columns)]
    got = df.select(sorted(df.columns)).toPandas()
    norm = lambda f: sorted(tuple(str(float(x)) if isinstance(x, (int, float, np.number)) and not isinstance(x, (bool, np.bool_)) else str(x) for x in r) for r in f.itertuples(index=False))
    assert norm(got) == norm(want)
