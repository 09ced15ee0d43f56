"""Operators without SQL, against numpy on the driver's tables; readers and preparation on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import bloom, centres, embed, graph, learners, linear, minhash, pairwise, prepare, recommend, stats
from millrace.plans import registry
from millrace.plans.registry import QUERIES
from millrace.sources import text_files

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def vectors(spark):
    got = sorted((r["id"], list(r["v"]), r["label"]) for r in registry._points(spark, SMALL).collect())
    return np.array([v for _, v, _ in got]), [i for i, _, _ in got], np.array([c for *_, c in got])


def test_singular_values(spark, vectors):
    x, ids, _ = vectors
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    got = rows(QUERIES["singular_energy"](spark, SMALL))
    s = np.concatenate((s, np.zeros(64 - len(s))))
    assert np.allclose([r[1] for r in got], s, atol=2e-5) and np.allclose([r[2] for r in got], np.cumsum(s**2) / (s**2).sum(), atol=1e-5)
    points = registry._points(spark, SMALL)
    sigma, v = linear.singular(linear.gram_array(points, "v", 64))
    near = np.array([r["v"] for r in linear.reconstructed(points, v, 5).orderBy("id").collect()])
    assert np.allclose(near, (u[:, :5] * s[:5]) @ vt[:5], atol=1e-8)
    assert linear.energy(np.zeros(3)) == [0.0] * 3


def test_literal_matrix(spark):
    m = np.array(registry._MATRIX, float)
    lit = linear.literal_matrix(spark, registry._MATRIX)
    sigma, v = linear.singular(linear.gram_array(lit, "v", 5))
    assert np.allclose(sigma, np.linalg.svd(m)[1])
    full = np.array([r["v"] for r in linear.reconstructed(lit, v, 5).orderBy("id").collect()])
    left = np.array([r["w"] for r in linear.left_vectors(lit, sigma, v).orderBy("id").collect()])
    assert np.allclose(full, m) and np.allclose(left * sigma @ v.T, m) and np.allclose(left.T @ left, np.eye(5))
    assert np.allclose([p for p, _ in stats.eigenpairs(m.T @ m)], np.linalg.eigvalsh(m.T @ m)[::-1], atol=1e-3)


def test_principal_components(spark, vectors):
    x, _, _ = vectors
    c = x - x.mean(axis=0)
    got = np.array([r[1:] for r in rows(QUERIES["principal_scores"](spark, SMALL))])
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-6)
    z = c / x.std(axis=0)
    values = np.sort(np.linalg.eigvalsh(z.T @ z / len(z)))[::-1]
    share = values / values.sum()
    kept = int((np.cumsum(share) < 0.95 - 1e-12).sum()) + 1
    assert [(r[0], pytest.approx(float(w), abs=2e-6), k < kept) for k, (r, w) in enumerate(zip(rows(QUERIES["principal_share"](spark, SMALL)), share, strict=True))] == rows(QUERIES["principal_share"](spark, SMALL))


def test_means_of_many_settings(spark, vectors):
    x, ids, _ = vectors
    points = registry._points(spark, SMALL)
    for k, seed, got in rows(centres.sweep(points, [2, 5], [1, 2])):
        c = np.array(centres.seeded_starts(points, k, seed))
        while True:
            at = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            new = np.array([x[at == j].mean(0) if (at == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        assert got == pytest.approx(((x[:, None] - c[None]) ** 2).sum(-1).min(1).sum())
    assert centres.inertia(points, [x[0].tolist()]).first()[0] == pytest.approx(((x - x[0]) ** 2).sum())
    one, two = [[0.0, 0.0], [9.0, 9.0]], [[1.0, 0.0]]
    tiny = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 0.0])], "id long, v array<double>")
    assert centres.lloyd_many(tiny, [one, two]) == [([[1.0, 0.0], [9.0, 9.0]], 2.0), ([[1.0, 0.0]], 2.0)]


def test_block_pairs_of_several_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(pairwise, "SIZE", 16)
    x, ids, label = vectors
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    points = registry._labelled(spark, SMALL)
    near = rows(pairwise.within(points.select("id", "v"), 1.3).select("i", "j"))
    assert near == sorted((ids[i], ids[j]) for i, j in zip(*np.nonzero(d <= 1.3), strict=True))
    line = spark.createDataFrame([(k, [float(k // 2), 0.0]) for k in range(120)] + [(1000 + k, [7.0, 0.0]) for k in range(40)], "id long, v array<double>")
    place = {k: k // 2 for k in range(120)} | {1000 + k: 7 for k in range(40)}
    kept = pairwise.block_pairs(line, {"v": F.col("v")}, 1.0).count()
    assert rows(pairwise.within(line, 1.0).select("i", "j")) == sorted((a, b) for a in place for b in place if abs(place[a] - place[b]) <= 1)
    assert kept < pairwise.block_pairs(line, {"v": F.col("v")}).count()
    want = {int(c): d[np.ix_(label == c, label == c)].max() for c in set(label)}
    assert {r[0]: pytest.approx(r[1]) for r in rows(pairwise.diameters(points))} == want
    s = {}
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        a = d[i][own].mean() if own.any() else None
        b = min(d[i][label == c].mean() for c in set(label) if c != label[i])
        s[ids[i]] = 0.0 if a is None else (b - a) / max(a, b)
    assert dict(rows(pairwise.silhouettes(points))) == pytest.approx(s)
    w = points.withColumn("w", F.slice("v", 1, 3))
    e = np.sqrt(((x[:, None, :3] - x[None, :, :3]) ** 2).sum(-1))
    assert pairwise.distance_correlation(w).first()[0] == pytest.approx(np.corrcoef(d.ravel(), e.ravel())[0, 1])


def test_sage(spark):
    rng = np.random.default_rng(0)
    n, edges = 30, {(int(a), int(b)) for a, b in np.random.default_rng(1).integers(0, 30, (60, 2)) if a != b}
    x, y, train = rng.normal(size=(n, 4)), rng.integers(0, 3, n), np.arange(n) % 4 != 0
    a = np.zeros((n, n))
    for s, t in edges:
        a[s, t] = 1
    a /= np.maximum(a.sum(1, keepdims=True), 1)
    nodes = spark.createDataFrame([(i, x[i].tolist(), int(y[i]), bool(train[i])) for i in range(n)], "node long, x array<double>, label int, is_train boolean")
    model = embed.Sage(spark.createDataFrame(sorted(edges), "src long, dst long"), nodes, 4, 5, 3)
    w0, w1 = [w.copy() for w in model.weights]

    def forward():
        h0 = np.hstack([x, a @ x])
        pre = h0 @ w0
        h = np.maximum(pre, 0)
        h1 = np.hstack([h, a @ h])
        z = h1 @ w1
        p = np.exp(z - z.max(1, keepdims=True))
        return h0, pre, h1, p / p.sum(1, keepdims=True)

    def scores(mask):
        p = forward()[3]
        guess, f1 = p.argmax(1), []
        for c in range(3):
            hit, g, t = ((guess == c) & (y == c) & mask).sum(), ((guess == c) & mask).sum(), ((y == c) & mask).sum()
            f1.append(2 * hit / (g + t) if hit else 0.0)
        return -np.log(p[mask, y[mask]]).mean(), (guess == y)[mask].mean(), np.mean(f1)

    for _ in range(3):
        h0, pre, h1, p = forward()
        gap = (p - np.eye(3)[y]) * train[:, None] / train.sum()
        back = gap @ w1.T
        g0 = h0.T @ ((back[:, :5] + a.T @ back[:, 5:]) * (pre > 0))
        w0, w1 = w0 - 0.5 * g0, w1 - 0.5 * h1.T @ gap
        model.step(0.5)
        assert np.allclose(model.weights[0], w0) and np.allclose(model.weights[1], w1)
    assert tuple(model.scores().first()) == pytest.approx(scores(train)) and tuple(model.scores(False).first()) == pytest.approx(scores(~train))


def test_skip_gram(spark):
    pairs = [(1, 2, 3), (2, 1, 3), (2, 3, 1), (3, 2, 1), (1, 3, 2)]
    df = spark.createDataFrame(pairs, "center long, context long, n long")
    before = {r["node"]: np.array(r["v"]) for r in embed.skip_gram(df, dim=4, epochs=0).collect()}
    got = {r["node"]: np.array(r["v"]) for r in embed.skip_gram(df, dim=4, epochs=3, rate=0.05).collect()}
    w1, w2 = np.array([before[k] for k in (1, 2, 3)]), np.random.RandomState(0).randn(4, 3)
    counts = np.zeros((3, 3))
    for c, t, n in pairs:
        counts[c - 1, t - 1] = n
    for _ in range(3):
        s = w1 @ w2
        p = np.exp(s - s.max(1, keepdims=True))
        gap = p / p.sum(1, keepdims=True) * counts.sum(1, keepdims=True) - counts
        w1, w2 = w1 - 0.05 * gap @ w2.T, w2 - 0.05 * w1.T @ gap
    assert np.allclose([got[k] for k in (1, 2, 3)], w1)
    with pytest.raises(ValueError):
        embed.skip_gram(df, most_nodes=2)


def test_factors_against_singular_vectors(spark):
    rng = np.random.default_rng(3)
    seen = (rng.random((14, 9)) < 0.4) | np.eye(14, 9, dtype=bool)
    seen[:, 0] = True
    ratings = spark.createDataFrame([(int(u), int(i), 1.0) for u, i in zip(*np.nonzero(seen), strict=True)], "user long, item long, rating double")
    pairs = spark.createDataFrame([(u, i) for u in range(14) for i in range(9)] + [(99, 0)], "user long, item long")
    got = {(r[0], r[1]): r[2] for r in recommend.predict(recommend.factorize(ratings, rank=3, rounds=60), pairs).collect()}
    m = seen.astype(float)
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    mean = m.mean()
    want = mean + (m.mean(1) - mean)[:, None] + (m.mean(0) - mean)[None] + (u[:, :3] * s[:3]) @ vt[:3]
    assert np.allclose([[got[a, b] for b in range(9)] for a in range(14)], want, atol=1e-4)
    assert got[99, 0] == pytest.approx(mean + m[:, 0].mean() - mean)


def test_ward_on_the_vectors(spark, vectors):
    x, ids, _ = vectors
    groups, centre, n = [[i] for i in range(len(x))], x.copy(), np.ones(len(x))
    while len(groups) > 10:
        cost = np.outer(n, n) / np.add.outer(n, n) * ((centre[:, None] - centre[None]) ** 2).sum(-1)
        np.fill_diagonal(cost, np.inf)
        i, j = sorted(np.unravel_index(cost.argmin(), cost.shape))
        centre[i] = (n[i] * centre[i] + n[j] * centre[j]) / (n[i] + n[j])
        n[i] += n[j]
        groups[i] += groups.pop(j)
        centre, n = np.delete(centre, j, 0), np.delete(n, j)
    want = {ids[i]: k for k, g in enumerate(sorted(groups, key=min)) for i in g}
    assert dict(rows(QUERIES["agglomerative_ward"](spark, SMALL))) == want


@pytest.mark.parametrize("linkage", ["ward", "average", "complete"])
def test_merging_in_rounds_gives_the_same_clusters(spark, linkage, monkeypatch):
    monkeypatch.setattr(pairwise, "SIZE", 12)
    rng = np.random.default_rng(6)
    x = [*rng.normal(size=(24, 2)).round(3).tolist(), [0.5, 0.5], [0.5, 0.5]]
    points = spark.createDataFrame([(3 * i + 1, v) for i, v in enumerate(x)], "id long, v array<double>")
    assert rows(learners.merged_in_rounds(points, 4, linkage)) == rows(learners.agglomerative(points, 4, linkage))
    assert rows(learners.agglomerative(points, 4, linkage, most_points=10)) == rows(learners.agglomerative(points, 4, linkage))


def test_network_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, y double")
    got, losses = learners.network(df, ["a", "b"], "y", hidden=3, rate=0.3, rounds=4)
    r = np.random.default_rng(0)
    w = [r.normal(size=(2, 3)) / np.sqrt(2), np.zeros(3), r.normal(size=3) / np.sqrt(3), np.zeros(1)]
    for k in range(4):
        h = np.maximum(x @ w[0] + w[1], 0)
        p = 1 / (1 + np.exp(-(h @ w[2] + w[3])))
        assert losses[k] == pytest.approx(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        gap = (p - y) / len(y)
        back = np.outer(gap, w[2]) * (h > 0)
        w = [w[0] - 0.3 * x.T @ back, w[1] - 0.3 * back.sum(0), w[2] - 0.3 * h.T @ gap, w[3] - 0.3 * gap.sum()]
    assert all(np.allclose(a, b) for a, b in zip(got, w, strict=True))


def test_sigmoid_layers(spark, tmp_path):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(30, 5)), rng.integers(0, 3, 30)
    df = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y, strict=True)], "v array<double>, c int").repartition(3)
    got = learners.layers(df, "v", "c", [5, 4, 3], 0.5, 3)
    r = np.random.RandomState(0)
    w = [r.randn(5, 4) / np.sqrt(5), r.randn(4, 3) / np.sqrt(4)]
    s = lambda z: 1 / (1 + np.exp(-z))
    for _ in range(3):
        h = s(x @ w[0])
        o = s(h @ w[1])
        d2 = (o - np.eye(3)[y]) * o * (1 - o)
        d1 = (d2 @ w[1].T) * h * (1 - h)
        w = [w[0] - 0.5 * x.T @ d1 / 30, w[1] - 0.5 * h.T @ d2 / 30]
    assert all(np.allclose(a, b) for a, b in zip(got, w, strict=True))
    learners.save_weights(spark, got, f"file://{tmp_path}/w")
    kept = learners.load_weights(spark, f"file://{tmp_path}/w")
    assert all((a == b).all() for a, b in zip(got, kept, strict=True))
    guess = {tuple(r["v"]): r["guess"] for r in learners.layer_guesses(df, "v", kept).collect()}
    assert [guess[tuple(v)] for v in x.tolist()] == s(s(x @ w[0]) @ w[1]).argmax(1).tolist()


def test_primes_and_empty_signatures(spark):
    assert [minhash.smallest_prime(n) for n in (0, 8, 13, 19683)] == [2, 11, 13, minhash.PRIME]
    docs = spark.createDataFrame([(1, "abcd"), (2, "x"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: set(r["sig"]) for r in minhash.signatures(docs, empties=True).collect()}
    assert got[2] == got[3] == {minhash.PRIME} and got[1] != got[2] and minhash.signatures(docs).count() == 1


def test_walks_and_layers(spark):
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4), (2, 4)], "u long, v long")
    nbrs = {1: [2, 4], 2: [1, 3, 4], 3: [2, 4], 4: [1, 2, 3]}
    assert dict(rows(graph.neighbours(ring))) == nbrs
    walks = {}
    for start, step, node in rows(graph.random_walks(ring, 6)):
        walks.setdefault(start, []).append(node)
    assert set(walks) == set(nbrs) and all(w[0] == s and all(b in nbrs[a] for a, b in zip(w, w[1:], strict=False)) for s, w in walks.items())
    edges = spark.createDataFrame([(a, b) for a in nbrs for b in nbrs[a]], "src long, dst long")
    f = spark.createDataFrame([(n, d, float(n * 10 + d)) for n in nbrs for d in range(2)], "node long, d int, value double")
    w = np.random.default_rng(1).normal(size=(4, 3))
    got = {(r[0], r[1]): r[2] for r in rows(graph.sage_layer(edges, f, F.lit(w.tolist()), 2, 3, True))}
    for n in nbrs:
        own = np.array([n * 10, n * 10 + 1.0])
        mean = np.mean([[m * 10, m * 10 + 1.0] for m in nbrs[n]], axis=0)
        assert [got[n, k] for k in range(3)] == pytest.approx(np.maximum(np.concatenate((own, mean)) @ w, 0).tolist())
    assert rows(graph.head_and_tail(spark.range(100), ["id"])) == [(k,) for k in (*range(10), *range(90, 100))] and graph.head_and_tail(spark.range(20), ["id"]).count() == 20


def test_bloom_sweep_is_each_filter_by_itself(spark):
    inside, outside = (spark.range(a, b).select(F.concat(F.lit("k"), "id").alias("key")) for a, b in ((0, 60), (60, 160)))
    for k, fpr in rows(bloom.sweep(inside, outside, 200, [1, 2, 4])):
        assert fpr == pytest.approx(bloom.false_positive_rate(bloom.probe(outside, bloom.build(inside, 200, k), 200, k)).first()[0])


def test_preparation(spark):
    raw = spark.createDataFrame([(1, "2.5", "a"), (2, "?", "b"), (3, "x", None), (4, "4", "b")], "id long, x string, c string")
    clean = prepare.marked_missing(raw, ["x"])
    assert rows(prepare.null_counts(clean)) == [("c", 1), ("id", 0), ("x", 2)]
    assert rows(prepare.imputed(clean, ["x"], ["c"])) == [(1, 2.5, "a"), (2, 3.25, "b"), (3, 3.25, "b"), (4, 4.0, "b")]
    assert rows(prepare.complete(clean, raw.select("id", F.lit(1).alias("y")), "id")) == [(1, 2.5, "a", 1), (4, 4.0, "b", 1)]
    assert rows(prepare.dense_index(spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "k string"), "k")) == [("a", 0), ("b", 1), ("c", 2)]
    assert [r[0] for r in spark.range(1, 4).select(prepare.triangular(F.lit(0), F.col("id").cast("int"), 4)).collect()] == [0, 1, 2]
    with pytest.raises(Exception, match="no pair"):
        spark.range(1).select(prepare.triangular(F.lit(2), F.col("id").cast("int"), 4)).collect()
    line = prepare.line_sample(spark, 2000, 0.0, 5.0, 1.0, 7).toPandas()
    slope, offset = np.polyfit(line.x, line.y, 1)
    assert abs(slope - 3) < 0.1 and abs(offset - 7) < 0.2 and line.x.between(0, 5).all() and abs((line.y - 3 * line.x - 7).std() - 1) < 0.1
    assert prepare.sine_sample(spark, 100, 0.0, 1).filter("abs(y - sin(2 * pi() * x)) > 1e-9").count() == 0
    assert prepare.accuracy(raw.select(F.col("id").alias("t"), F.lit(1).alias("g")), "t", "g").first()[0] == 0.25
    assert spark.range(1).select(F.round(prepare.sigmoid_slope(F.lit(0.0)), 6)).first()[0] == 0.25
    p = prepare.pivoted(spark.createDataFrame([(1.0, 4, 7), (1.0, 6, 8), (2.0, 4, 9)], "e double, m int, v int"), "e", "m", "v", [4, 6])
    assert [tuple(r) for r in p.collect()] == [(2.0, 9, None), (1.0, 7, 8)] and p.columns == ["e", "c4", "c6"]


def test_more_readers(spark, tmp_path):
    def put(name, text, encoding="utf-8"):
        (tmp_path / name).write_bytes(text.encode(encoding))
        return f"file://{tmp_path / name}"

    assert rows(text_files.ratings(spark, put("r", "1,2,3.0,9\n1,3,1.0,9\n1,2,5.0,8\n"))) == [(1, 2, 5.0, 8), (1, 3, 1.0, 9)]
    assert rows(text_files.interactions(spark, put("t", "1,2,9\n"))) == [(1, 2, 9)]
    assert rows(text_files.edge_list(spark, put("e", "# c\n1 2\n1 2\n"))) == [(1, 2)]
    loose = text_files.edge_list(spark, put("l", "[x\n1 2 3\n7 2\n"), "[", False)
    assert rows(loose) == [(1, 2), (7, 2)] and rows(text_files.greatest_id(loose)) == [(7,)]
    got = text_files.labelled_rows(spark, put("d", "0.5,1,3\n\nx,2,4.0\n")).collect()
    assert sorted((list(r[0]), r[1]) for r in got if r[1] == 3) == [([0.5, 1.0], 3)] and [r[0] for r in got if r[1] == 4] == [[None, 2.0]]
    assert rows(text_files.table_csv(spark, put("h", ",x1,x2\n0,1.5,2\n1,3,4\n"), index="t")) == [(0, 1.5, 2), (1, 3.0, 4)]
    assert rows(text_files.table_csv(spark, put("a", "text,label\ncaf\xe9,1\n", "latin1"), latin=True)) == [("caf\xe9", 1)]
    assert [r[0] for r in text_files.numeric_rows(spark, put("n", "1 x\n")).collect()] == [[1.0, None]]
    text_files.write_report(spark.range(2), f"file://{tmp_path}/out", header=True)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/out").count() == 2
    lines = text_files.report_lines(spark.createDataFrame([(1, 0.5, [2, 3], None)], "a int, b double, c array<int>, d string"))
    assert [r[0] for r in lines.collect()] == ["1\t0.500000\t2,3"]
