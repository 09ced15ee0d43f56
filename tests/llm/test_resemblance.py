import random

import corpus_pipeline
from millrace.llm import resemblance


def _set(text):
    ws = (text or "").lower().split()
    return {" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def _roots(texts, sets):
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if not (sets[i] or sets[j]) or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def _made():
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(n))
    edit = lambda t, p: " ".join(w if rng.random() > p else f"z{rng.randrange(99)}" for w in t.split())
    base = [text(120) for _ in range(30)]
    passage = text(60)
    near = [edit(base[k % 6], p) for p in (0.01, 0.02, 0.03) for k in range(30)]
    return base + near + [base[0]] * 20 + [f"{passage} {text(60)}" for _ in range(40)] + [edit(base[7], 0.015) for _ in range(60)] + ["", None, " ", "one", "ONE", "a b c d", "a b c d e"]


def test_keeps_one_of_each_group_of_likeness_four_fifths(spark):
    texts = _made()
    roots = _roots(texts, [_set(t) for t in texts])
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect())
    assert got == sorted({100 + r for r in roots})
    assert resemblance.keep_one(docs.filter("false")).count() == 0


def test_rows_that_repeat_an_id_are_told_apart(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    docs = spark.createDataFrame([(5, x), (7, x), (5, y), (3, y), (5, x), (None, x)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(5, x), (3, y), (None, x)], key=str)
