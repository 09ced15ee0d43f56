import random
import zlib

import numpy as np
import pytest

from millrace.llm import components, golay, packing, quality_knn, toxicity, transducer, url_filter
from millrace.llm.queries import tokenizer_path

PATH = tokenizer_path()
ODD = ["", "'s", "'ll 're'v 'x''s !'s!''t don't  we'll\n\n  x", "a  b", "a \n b", "\n\n\na", "  ", " ' 's", "<|endoftext|>a<|endoftext|><|endoftext|>", "日本語 テスト 123 ١٢٣", "é" * 50, "x" * 3000, "'r", "'l", "word " * 3000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    letters = "abcstmdrvle'' \n\t!?.0123éñ日  THEre"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 80))) for _ in range(2000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "s", 1) for i, t in enumerate(texts[:200])] + [(None, None, None, None), (3, texts[3], "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")


def test_counts_agree_with_the_library(texts, library):
    want = [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert transducer.count_tokens(texts, transducer.Merger(PATH)).tolist() == want
    assert transducer.count_tokens(texts, transducer.Merger(PATH, most_states=50)).tolist() == want


def test_scan_does_not_depend_on_chunks(texts):
    codes = np.frombuffer("\n".join(["", *texts[:300], ""]).encode("utf-32-le"), np.uint32)
    assert all((transducer.split_marks(codes, c) == transducer.split_marks(codes, 512)).all() for c in (1, 7, 100_000))


def test_token_counts(docs):
    got = transducer.token_counts(docs, PATH).collect()
    assert len(got) == docs.count() and all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert [r["n_tokens"] for r in got if r["doc_id"] is None] == [0]
    assert transducer.token_counts(docs.filter("false"), PATH).count() == 0


def test_packing(docs, texts, library):
    got = packing.pack(docs, PATH, limit=64).collect()
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(filled) <= -(-sum(r["length"] for r in got) // 64) * 1.02 + 1
    for r in got:
        ids = np.array(library.encode(texts[r["doc_id"]] if r["doc_id"] is not None else "", add_special_tokens=False).ids + [2], "<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert r["length"] == 64 or r["piece"] == 0
    assert packing.pack(docs.filter("false"), PATH).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plan_places_every_rank_once(seed):
    rng = np.random.default_rng(seed)
    h = np.bincount(rng.integers(1, 65, 5000), minlength=65)
    room, seen = {}, {}
    for n, first, times, sequence, offset in packing.plan(h):
        for k in range(times):
            assert (n, first + k) not in seen
            seen[n, first + k] = True
            room.setdefault(sequence + k, []).append((offset, n))
    assert len(seen) == h.sum() and all(sum(n for _, n in v) <= 64 for v in room.values())
    assert len(room) <= 1.005 * int((h * np.arange(65)).sum()) / 64 + 1


def test_golay_keys_share_one_within_two_bits():
    rng = random.Random(3)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(3)))
        rows, keys = golay.fuzzy_keys(np.array([a, b], np.uint64))
        assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(120)) for _ in range(40)]
    made = base + [base[0]] * 30 + [" ".join(w if rng.random() > 0.01 else "zz" for w in base[1].split()) for _ in range(80)] + ["", None, " ", "one", "ONE", "a b", "A B c d"]
    ids = list(range(100, 100 + len(made)))
    docs = spark.createDataFrame(list(zip(ids, made, strict=True)), "doc_id long, text string")
    prints = [golay.simhash(t) for t in made]
    parent = list(range(len(made)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(made)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    for bucket in (16, 2):
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in golay.near_duplicates(docs, bucket=bucket).collect()}
        assert got == {d: (f"{p:016x}", ids[root(i)]) for i, (d, p) in enumerate(zip(ids, prints, strict=True))}
    assert golay.near_duplicates(docs.filter("false")).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["component"] for r in components.components(links).collect()} == {0}


def test_urls(spark):
    urls = ["https://A.Example.com/en/7?x", "http://example.com/en/8", "http://x.net/de/1", "http://q.example.net/de/8", "http://s.org/es/", "ftp://casino.example.org", "http://free-bets.example.org/", "http://freebets.org/win", "nothing", "", None, "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, "h", 3) for i, u in enumerate(urls)], "page_id long, url string, html string, host int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got[0] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[1][2:] == ("com/en/", "block")
    assert got[2][2:] == ("net/de/", "allow") and got[3][2:] == ("example.net/de/8", "block") and got[4][2:] == ("org/es/", "block")
    assert got[5][3] == got[6][3] == "block" and got[7][3] == got[8][3] == got[10][3] == "allow" and got[10][:2] == ("", "") and got[11][:2] == ("b:", "//c/d")
    assert url_filter.judge(pages.filter("false")).count() == 0


SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_knn.score(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.93 and got.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None, 0), (None, "", 1), (1, "x", 2)], "doc_id long, text string, score int")
    assert quality_knn.score(odd, labels).count() == 3 and quality_knn.score(odd, labels.filter("false")).first()["score"] == 0.5
    assert quality_knn.score(odd.filter("false"), labels).count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score(docs, labels, train_all=False).withColumnRenamed("toxic", "guess").join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 3 = 1").toPandas()
    assert got[got.toxic == 1].guess.mean() > 0.9 and got[got.toxic == 0].guess.mean() < 0.01
    odd = spark.createDataFrame([(1, None, 0), (None, "", 1), (1, "x", 2)], "doc_id long, text string, toxic int")
    assert toxicity.score(odd, labels.filter("false")).filter("toxic").count() == 0
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns and toxicity.score(odd.filter("false"), labels).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.toPandas()[docs.columns], docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
