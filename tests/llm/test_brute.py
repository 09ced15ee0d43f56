"""Operators against plain versions of what they compute."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import mixing, quality_knn, sketches, toxicity
from millrace.llm.queries import tokenizer_path

from .test_native import TEXTS, all_spans
from .test_resemblance import _roots, _set

SF = "/root/testdata/sf0.001"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_votes_of_every_pair(spark):
    docs, labels = tables(spark)
    extra = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate([*TEXTS, "long " * 300_000])], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    model = quality_knn.learn(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality_knn.score(docs, labels).collect()}
    again = {r["doc_id"]: r["score"] for r in quality_knn.score(docs.repartition(5), labels).collect()}
    assert all(abs(got[d] - again[d]) < 1e-3 for d in got)
    for r in docs.collect():
        index, weight = quality_knn.features(r["text"] or "")
        x = np.zeros(len(model.idf))
        for i, w in zip(index, weight, strict=True):
            x[i] = w * model.idf[i]
        for a, b, size in ((0, 2048, 0.7), (2048, 3072, 1.0), (3072, 3200, 0.7)):
            if x[a:b].any():
                x[a:b] *= size / math.sqrt((x[a:b] ** 2).sum())
        z = x @ model.space
        z /= max(np.linalg.norm(z), 1e-9)
        cosines = [(float(z @ v), float(y)) for v, y in zip(model.vectors, model.labels, strict=True)]
        cosines.sort(reverse=True)
        weights = [(max(c, 1e-3) ** quality_knn.SHARP, y) for c, y in cosines[: quality_knn.NEIGHBOURS]]
        want = sum(w * y for w, y in weights) / sum(w for w, _ in weights)
        tie = abs(cosines[quality_knn.NEIGHBOURS - 1][0] - cosines[quality_knn.NEIGHBOURS][0]) < 1e-5
        assert tie or abs(got[r["doc_id"]] - want) < 2e-3, r["doc_id"]


def test_meetings_keep_words_and_expectations(spark):
    sizes, shares = [900, 400, 350, 60, 7, 1], [0.3, 0.8, 0.5, 0.25, 0.6, 0.9]
    unit = F.struct(*[F.lit(None).alias(c) for c in ("source", "source_size", "target")])
    units = F.array(*[F.struct(F.lit(s).alias("size"), (F.col("id") * 10 + k).alias("doc_id"), F.lit(1).alias("occ"), F.lit(p).alias("p"), F.lit(0).alias("copies"), unit["source"].cast("string").alias("source"), unit["source_size"].cast("long").alias("source_size"), unit["target"].cast("double").alias("target")).cast(mixing._UNIT) for k, (s, p) in enumerate(zip(sizes, shares, strict=True))])
    rows = spark.range(4000).select("id", mixing.pivoted(units, 3).alias("u")).collect()
    total, ends = sum(s * p for s, p in zip(sizes, shares, strict=True)), np.zeros(len(sizes))
    for r in rows:
        p = {u["doc_id"] % 10: u["p"] for u in r["u"]}
        assert len(p) == len(sizes) and abs(sum(sizes[k] * v for k, v in p.items()) - total) < 1e-6
        assert sum(1e-9 < v < 1 - 1e-9 for v in p.values()) <= 1 and all(0 <= v <= 1 for v in p.values())
        ends += [p[k] for k in range(len(sizes))]
    assert np.abs(ends / len(rows) - shares).max() < 4 * 0.5 / math.sqrt(len(rows))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sources_meet_their_targets(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").withColumns({c: F.lit("clash") for c in ("size", "taken", "target", "copies", "unit")})
    got = mixing.mix(docs).toPandas()
    assert len(got) == docs.count() and (got.taken <= 3 * got["size"]).all()
    for _, own in got.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= max(0.01 * own.target.iloc[0], own["size"].min())
    copies = mixing.take(docs)
    assert copies.columns == docs.columns and copies.count() == got.copies.sum()


def bottom(text, k=64):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    if not ws:
        return []
    if len(ws) < 5:
        return [signed(xxhash.xxh64_intdigest(" ".join(ws), 42))]
    out = set()
    for i in range(len(ws) - 4):
        h = 42
        for w in ws[i : i + 5]:
            h = xxhash.xxh64_intdigest(w, h)
        out.add(signed(h))
    return sorted(out)[:k]


def likeness(a, b, k=64):
    u = sorted(set(a) | set(b))[:k]
    return sum(x in a and x in b for x in u) / len(u) if u else 1.0


def test_sketches_against_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(sketches, "BLOCK_IDS", 20)
    docs = tables(spark)[0].withColumns({c: F.lit(1) for c in ("key", "head", "next_id", "a")})
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in sketches.fingerprints_of_edits(docs).collect()}
    text = lambda s: "".join(f"{h & (2**64 - 1):016x}" for h in s)
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        own, edited, near = bottom(t), bottom(t[: len(t) - cut] + following[:cut]), bottom(following)
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (text(own), text(edited))
        assert abs(got[i]["near_edited"] - likeness(own, edited)) < 1e-12 and abs(got[i]["near_next"] - likeness(own, near)) < 1e-12


def test_merged_groups_are_the_sketches_of_the_whole(spark):
    docs = tables(spark)[0]
    got = {r["source"]: list(r["s"]) for r in sketches.merge_groups(docs.select("source", sketches.sketch(F.col("text")).alias("s")), ["source"], "s").collect()}
    for s, want in got.items():
        every = {h for r in docs.filter(F.col("source") == s).collect() for h in bottom(r["text"], 10**9)}
        assert want == sorted(every)[:64]


def test_chain_of_models():
    rng = np.random.default_rng(2)
    x = (rng.random((300, 8)) < 0.3).astype(float)
    first = (x @ rng.normal(size=8) + rng.normal(size=300) > 0).astype(float)
    y = np.stack([first, ((x[:, 0] + first) > 1).astype(float)], 1)
    folds = np.arange(300) % toxicity.FOLDS
    got = toxicity.fit_chain(x, y, folds)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def slope(design, target, w):
        share = target.mean()
        each = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share))
        held = np.full(len(w), toxicity.RIDGE)
        held[-1] = 1e-6
        return sum(e * (sigmoid(float(r @ w)) - t) * r for r, t, e in zip(design, target, each, strict=True)) + held * w

    one = np.ones((300, 1))
    assert np.abs(slope(np.hstack([x, one]), y[:, 0], got[0])).max() < 1e-3
    unseen = np.zeros(300)
    for f in range(toxicity.FOLDS):
        out = folds == f
        w = toxicity.logistic(np.hstack([x, one])[~out], y[~out, 0], toxicity.RIDGE)
        assert np.abs(slope(np.hstack([x, one])[~out], y[~out, 0], w)).max() < 1e-3
        unseen[out] = sigmoid(np.hstack([x, one])[out] @ w)
    assert np.abs(slope(np.hstack([x, unseen[:, None], one]), y[:, 1], got[1])).max() < 1e-3
    chain = toxicity.Chain(["a", "b"], {f"t{k}": k for k in range(8)}, got)
    p = toxicity.chain_scores(chain, [np.nonzero(r)[0].tolist() for r in x])
    a = sigmoid(x @ got[0][:8] + got[0][-1])
    assert np.allclose(p, np.stack([a, sigmoid(x @ got[1][:8] + a * got[1][8] + got[1][-1])], 1))


def test_fitting_holds_no_copies_of_the_sample():
    import tracemalloc

    rng = np.random.default_rng(5)
    x = (rng.random((4000, 150)) < 0.2).astype(np.uint8)
    y = (x[:, :2].sum(1) + rng.normal(size=4000) > 0.5).astype(float)[:, None]
    folds = np.arange(4000) % toxicity.FOLDS
    tracemalloc.start()
    got = toxicity.fit_chain(x, y, folds)[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * x.size  # the sample in doubles
    full = np.hstack([x, np.ones((4000, 1))])
    share = y.mean()
    each = np.where(y[:, 0] > 0.5, 0.5 / share, 0.5 / (1 - share))
    held = np.append(np.full(150, toxicity.RIDGE), 1e-6)
    assert np.abs(full.T @ (each * (1 / (1 + np.exp(-(full @ got))) - y[:, 0])) + held * got).max() < 1e-6


def test_the_driver_hands_freed_memory_back(spark):
    from millrace.functions.storage import release, trim_native

    assert "rim" in trim_native(spark)
    release(spark)


def test_nulls_repeats_and_clashing_names_in_the_chain(spark):
    docs, labels = tables(spark)
    gaps = labels.select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("quality")).alias("quality"), "toxic")
    odd = docs.withColumn("__p_toxic", F.lit("x")).unionByName(docs.limit(3).withColumn("__p_toxic", F.lit("y")))
    n = toxicity.score(odd, gaps).count()
    kept = toxicity.drop_toxic(odd, gaps)
    assert n == odd.count() and kept.columns == odd.columns and {r["__p_toxic"] for r in kept.select("__p_toxic").distinct().collect()} == {"x", "y"}
    assert toxicity.learn(docs, labels.withColumn("toxic", F.lit(None).cast("int"))) is None


def test_pipeline_against_plain_steps(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    docs, labels = tables(spark)
    toxic = {r["doc_id"] for r in toxicity.score(docs, labels).filter("toxic").collect()}
    rows = sorted(((r["doc_id"], r["text"] or "", r["source"]) for r in docs.collect() if r["doc_id"] not in toxic))
    roots = _roots([t for _, t, _ in rows], [_set(t) for _, t, _ in rows])
    kept = [(rows[k][0], redacted(rows[k][1]), rows[k][2]) for k in sorted(set(roots))]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(kept, "doc_id long, text string, source string")).collect()}
    want = Counter()
    for d, t, _ in kept:
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or 1024
        at = [0, *range(first, len(ids), 1024), len(ids)]
        for piece, (a, b) in enumerate(zip(at, at[1:], strict=False)):
            want[d, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())] += copies[d]
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == +want
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= 1024


def redacted(text):
    out, p = "", 0
    for _, a, b in (x.split(":") for x in all_spans(text).split(",") if x):
        a, b = int(a), int(b)
        out, p = out + (text[p:a] + "[SECRET]" if a >= p else ""), max(p, b)
    return out + text[p:]


def test_odd_rows_of_the_python_operators(spark):
    """Nulls, repeats, long texts, clashing names and empty tables where other tests don't have them."""
    from millrace.llm import golay, packing, transducer, url_filter

    long = "wörd, " * 60_000
    docs = spark.createDataFrame([(1, long, "x", "y"), (1, long, "x", "y"), (2, None, None, None), (None, "", "x", "y")], "doc_id long, text string, print string, rep string")
    from tokenizers import Tokenizer

    want = len(Tokenizer.from_file(tokenizer_path()).encode(long, add_special_tokens=False).ids)
    assert sorted(r["n_tokens"] for r in transducer.token_counts(docs, tokenizer_path()).collect()) == [0, 0, want, want]
    assert transducer.token_counts(docs.filter("false"), tokenizer_path()).count() == 0
    packed = packing.pack(docs, tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == {1: 2 * (want + 1), 2: 1, None: 1}
    got = golay.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == [("1", 1), ("1", 1), ("2", 2), ("None", 2)]
    url = "https://example.org/" + "a/" * 50_000 + "casino"
    pages = spark.createDataFrame([(1, url, "h"), (1, url, "h"), (2, None, None)], "page_id long, url string, verdict string")
    assert sorted((r["page_id"], r["verdict"]) for r in url_filter.judge(pages).collect()) == [(1, "block"), (1, "block"), (2, "allow")]
