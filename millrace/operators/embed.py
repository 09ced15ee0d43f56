"""Learning over graphs: a mean-aggregating network of two layers, and skip-gram vectors from walks.

Weights are the driver's, as they are small; rows stay where they are. Neighbours' means and their transposes are joins and
sums over edges, dense layers are numpy over Arrow batches, and every step is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut, drop_cut


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.array(x.tolist(), pa.list_(pa.float64()))


def mean_of_neighbours(edges: DataFrame, rows: DataFrame, name: str, width: int) -> DataFrame:
    """node, m: the mean of the neighbours' arrays, over edges (src, dst) from a node to those it looks at."""
    f = rows.select(F.col("node").alias("dst"), F.col(name).alias("x"))
    return edges.join(f, "dst").groupBy(F.col("src").alias("node")).agg(F.array(*[F.avg(F.get("x", F.lit(k))) for k in range(width)]).alias("m"))


def sage_weights(width: int, hidden: int, classes: int, seed: int = 0) -> list[np.ndarray]:
    """Both layers' weights, even between plus and minus 1/sqrt(rows)."""
    rng = np.random.RandomState(seed)
    return [rng.uniform(-1, 1, (2 * a, b)) / np.sqrt(2 * a) for a, b in ((width, hidden), (hidden, classes))]


class Sage:
    """A network over nodes (node, x array, label, is_train) and edges (src, dst). Nodes without neighbours see zeros."""

    def __init__(self, edges: DataFrame, nodes: DataFrame, width: int, hidden: int, classes: int, seed: int = 0):
        self.edges, self.width, self.hidden, self.classes = cut(edges.select("src", "dst"), "edges"), width, hidden, classes
        self.weights = sage_weights(width, hidden, classes, seed)
        own = nodes.select("node", F.col("x").cast("array<double>").alias("x"), F.col("label").cast("int").alias("label"), F.col("is_train").cast("boolean").alias("is_train"))
        self.nodes = cut(self._with_mean(own, own, "x", width, "x0").drop("x"), "inputs")
        self.n_train = self.nodes.agg(F.count_if("is_train")).first()[0]

    def _with_mean(self, rows: DataFrame, of: DataFrame, name: str, width: int, to: str) -> DataFrame:
        zeros = F.array(*[F.lit(0.0)] * width)
        return rows.join(mean_of_neighbours(self.edges, of, name, width), "node", "left").withColumn(to, F.concat(name, F.coalesce("m", zeros))).drop("m")

    def forward(self) -> DataFrame:
        """node, label, is_train, x0, h (hidden, before its mean), h1 (with it), p (probabilities of the classes)."""
        w0, w1 = self.weights

        def first(batches):
            for b in batches:
                h = np.maximum(_matrix(b.column(3), b.num_rows) @ w0, 0) if b.num_rows else np.zeros((0, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, _lists(h)], [*b.schema.names, "h"])

        def second(batches):
            for b in batches:
                z = _matrix(b.column(5), b.num_rows) @ w1 if b.num_rows else np.zeros((0, 1))
                e = np.exp(z - z.max(axis=1, keepdims=True))
                yield pa.RecordBatch.from_arrays([*b.columns, _lists(e / e.sum(axis=1, keepdims=True))], [*b.schema.names, "p"])

        kind = "node bigint, label int, is_train boolean, x0 array<double>"
        h = cut(self.nodes.select(F.col("node").cast("bigint").alias("node"), "label", "is_train", "x0").mapInArrow(first, f"{kind}, h array<double>"), "hidden")
        both = self._with_mean(h, h, "h", self.hidden, "h1")
        return both.mapInArrow(second, f"{kind}, h array<double>, h1 array<double>, p array<double>")

    def step(self, rate: float) -> None:
        """One step of descent on the cross-entropy of the training nodes."""
        w0, w1 = self.weights
        n, hidden, classes, width = max(self.n_train, 1), self.hidden, self.classes, self.width

        def back(batches):
            total = np.zeros(w1.shape)
            for b in batches:
                if not b.num_rows:
                    continue
                p, h1 = _matrix(b.column(6), b.num_rows), _matrix(b.column(5), b.num_rows)
                gap = (p - np.eye(classes)[b.column(1).to_numpy(zero_copy_only=False)]) * b.column(2).to_numpy(zero_copy_only=False).astype(float)[:, None] / n
                total += h1.T @ gap
                d = gap @ w1.T
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), _lists(d[:, :hidden]), _lists(d[:, hidden:]), pa.nulls(b.num_rows, pa.list_(pa.float64()))], ["node", "x0", "h", "own", "to", "g"])
            empty = lambda t: pa.nulls(1, t)
            longs = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([empty(pa.int64()), *[empty(longs)] * 4, _lists(total.reshape(1, -1))], ["node", "x0", "h", "own", "to", "g"])

        def last(batches):
            total = np.zeros(w0.shape)
            for b in batches:
                if b.num_rows:
                    x0, h, own, m = (_matrix(b.column(k), b.num_rows) for k in range(4))
                    total += x0.T @ ((own + m) * (h > 0))
            yield pa.RecordBatch.from_arrays([_lists(total.reshape(1, -1))], ["g"])

        def summed(rows: DataFrame, size: int) -> np.ndarray:
            long = rows.filter("g is not null").select(F.posexplode("g").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
            out = np.zeros(size)
            for r in long:
                out[r["k"]] = r["x"]
            return out

        lists = ", ".join(f"{c} array<double>" for c in ("x0", "h", "own", "to", "g"))
        made = cut(self.forward().mapInArrow(back, f"node bigint, {lists}"), "back")
        g1 = summed(made, w1.size).reshape(w1.shape)
        rows = made.filter("node is not null")
        degree = self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
        given = self.edges.join(degree, "src").join(rows.select(F.col("node").alias("src"), "to"), "src")
        got = given.groupBy(F.col("dst").alias("node")).agg(F.array(*[F.sum(F.get("to", F.lit(k)) / F.col("deg")) for k in range(hidden)]).alias("m"))
        zeros = F.array(*[F.lit(0.0)] * hidden)
        g0 = summed(rows.join(got, "node", "left").select("x0", "h", "own", F.coalesce("m", zeros).alias("m")).mapInArrow(last, "g array<double>"), w0.size).reshape(w0.shape)
        self.weights = [w0 - rate * g0, w1 - rate * g1]
        drop_cut(made)

    def scores(self, train: bool = True) -> DataFrame:
        """loss, accuracy, macro_f1 over the training nodes or the others; a class without hits counts 0."""
        rows = self.forward().filter("is_train" if train else "not is_train")
        best = F.array_position(F.col("p"), F.array_max("p")).cast("int") - 1
        each = rows.select("label", best.alias("guess"), (-F.log(F.greatest(F.lit(1e-12), F.get("p", F.col("label"))))).alias("loss"))
        counts = [f(F.col(c) == k) for k in range(self.classes) for c in ("label", "guess") for f in (F.count_if,)]
        hits = [F.count_if((F.col("label") == k) & (F.col("guess") == k)) for k in range(self.classes)]
        sums = each.agg(F.avg("loss").alias("loss"), F.avg((F.col("label") == F.col("guess")).cast("double")).alias("accuracy"), F.array(*counts).alias("c"), F.array(*hits).alias("t"))
        f1 = [F.when(F.get("t", F.lit(k)) > 0, 2 * F.get("t", F.lit(k)) / (F.get("c", F.lit(2 * k)) + F.get("c", F.lit(2 * k + 1)))).otherwise(0.0) for k in range(self.classes)]
        return sums.select("loss", "accuracy", (sum(f1, F.lit(0.0)) / self.classes).alias("macro_f1"))


def skip_gram(pairs: DataFrame, dim: int = 128, rate: float = 0.01, epochs: int = 3, seed: int = 0, most_nodes: int = 200_000) -> DataFrame:
    """node, v: vectors that tell a centre's contexts, from (center, context, n) of window pairs, by descent on the softmax's
    cross-entropy over all pairs, one step an epoch with `rate` a pair.

    Centres' vectors stay distributed, each with its contexts' counts, as many as the node has neighbours in walks; contexts'
    vectors, dim x nodes, go to every task and are refused beyond most_nodes. Starts are hashes of node and place."""
    nodes = sorted(r["node"] for r in pairs.select(F.explode(F.array("center", "context")).alias("node")).distinct().limit(most_nodes + 1).collect())
    if len(nodes) > most_nodes:
        raise ValueError(f"more than most_nodes = {most_nodes} nodes: contexts' vectors would not fit a task")
    place = {x: k for k, x in enumerate(nodes)}
    context = np.random.RandomState(seed).randn(dim, len(nodes))
    u = lambda d: (F.shiftrightunsigned(F.xxhash64("center", F.lit(seed), d), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    start = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.sqrt(-2 * F.log(u(2 * d))) * F.cos(2 * F.pi() * u(2 * d + 1)))
    rows = pairs.groupBy("center").agg(F.array_sort(F.collect_list(F.struct("context", "n"))).alias("c")).select(F.col("center").cast("bigint").alias("center"), F.transform("c", lambda s: s["context"].cast("bigint")).alias("to"), F.transform("c", lambda s: s["n"].cast("double")).alias("n"), start.alias("v"))
    rows = cut(rows, "centres")
    for _ in range(epochs):
        now = context

        def moved(batches, now=now):
            total = np.zeros_like(now)
            for b in batches:
                centres, vs = b.column(0).to_pylist(), []
                for to, n, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    z, counts = np.array(v), np.array(n)
                    s = z @ now
                    p = np.exp(s - s.max())
                    gap = p / p.sum() * counts.sum()
                    gap[[place[t] for t in to]] -= counts
                    total += np.outer(z, gap)
                    vs.append(z - rate * (now @ gap))
                yield pa.RecordBatch.from_arrays([pa.array(centres, pa.int64()), b.column(1), b.column(2), pa.array([v.tolist() for v in vs], pa.list_(pa.float64()))], ["center", "to", "n", "v"])
            parts = [total[:, k].tolist() for k in range(total.shape[1])]
            yield pa.RecordBatch.from_arrays([pa.array([-1 - k for k in range(len(parts))], pa.int64()), pa.nulls(len(parts), pa.list_(pa.int64())), pa.nulls(len(parts), pa.list_(pa.float64())), pa.array(parts, pa.list_(pa.float64()))], ["center", "to", "n", "v"])

        made = cut(rows.mapInArrow(moved, "center bigint, to array<bigint>, n array<double>, v array<double>"), "moved")
        steps = made.filter("to is null").groupBy("center").agg(F.array(*[F.sum(F.get("v", F.lit(d))) for d in range(dim)]).alias("g")).collect()
        step = np.zeros_like(context)
        for r in steps:
            step[:, -1 - r["center"]] = r["g"]
        context = context - rate * step
        rows = made.filter("to is not null")
    return rows.select(F.col("center").alias("node"), "v")
