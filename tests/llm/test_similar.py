"""The near-duplicate stage of the pipeline against all pairs compared one by one."""

import os
import random

import numpy as np
import pytest

import corpus_pipeline
from pinprick.llm import similar

SMALL = "/root/testdata/sf0.01"


def plain(docs):
    """Ids that stay: the smallest of each component of five-word Jaccard similarity >= 0.8."""
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if 5 * min(len(sets[a]), len(sets[b])) < 4 * max(len(sets[a]), len(sets[b])):
                continue
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    return set(least.values())


def edited():
    """Copies with a few words changed, chains of them, short and empty texts, texts that share one passage."""
    r = random.Random(8)
    say = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    docs, passage = [], say(60)
    for n in (12, 60, 150, 400):
        for _ in range(12):
            at = say(n)
            docs.append(at)
            for _ in range(3):
                at = list(at)
                for _ in range(r.randint(1, max(1, n // 60))):
                    at[r.randrange(n)] = f"new{r.randrange(10**6)}"
                docs.append(at)
    base = say(100)
    docs += [[*base[:k], f"odd{k}", *base[k + 1 :]] for k in range(0, 100, 3)]
    docs += [passage + say(r.choice([5, 12, 15, 40])) for _ in range(25)]
    docs += [[], [], ["one"], ["ONE"], ["one", "two"]]
    texts = [" ".join(x) for x in docs]
    r.shuffle(texts)
    return [(k, t) for k, t in enumerate([*texts, "  "])]


@pytest.mark.parametrize("parts", [1, 5])
def test_no_similar_text_is_left(spark, parts):
    docs = edited()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    assert {x.doc_id for x in similar.one_of_each(df).collect()} == plain(docs)


@pytest.mark.parametrize("rounds,tile", [(0, 2048), (0, 4), (1, 2048)])
def test_rounds_and_tiles_change_nothing(spark, monkeypatch, rounds, tile):
    monkeypatch.setattr(similar, "TILE", tile)
    monkeypatch.setattr(similar, "NEAR", 1)
    docs = edited()
    found = similar.similar_components(spark.createDataFrame(docs, "doc_id long, text string"), rounds=rounds)
    assert {i for i, _ in docs} - {r.doc_id for r in found.collect() if r.doc_id != r.component_id} == plain(docs)


def test_parities_differ_no_more_than_sets():
    r = random.Random(2)
    for n in (3, 40, 3000):
        a = {r.getrandbits(64) for _ in range(n)}
        b = {x if r.random() < 0.9 else r.getrandbits(64) for x in a}
        x, y = (np.frombuffer(similar._parities(np.array(sorted(z), np.uint64)), np.uint64) for z in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(a ^ b)


def test_no_rows(spark):
    assert similar.one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_near_stage_on_documents(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)["near dedup"]
    docs = [(x.doc_id, x.text) for x in df.collect()]
    assert {x.doc_id for x in stage(spark, df, SMALL).collect()} == plain(docs)
