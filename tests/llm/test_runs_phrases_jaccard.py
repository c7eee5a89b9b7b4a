"""Periodic runs, phrases and similar texts, each against a plain version on odd rows and on the smallest tables."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import frame, odd_docs, rows
from test_similar import edited

from pinprick.llm import jaccard, phrases, queries, runs

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# runs

def plain_runs(w, shortest=6, times=4):
    """Every stretch of every period, by definition."""
    n, out = len(w), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(shortest, times * q) and not any(w[i : j + q - z] == w[i + z : j + q] for z in range(1, q)):
                out.add((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(i, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(("null" if i is None else str(i)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = plain_runs(w)
    gone = {k for s, m, p in found for k in range(s + p, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (i, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
@pytest.mark.parametrize("shortest,times", [(6, 4), (2, 2), (1, 3)])
def test_runs_of_random_words(letters, shortest, times):
    r = random.Random(letters)
    for _ in range(400):
        w = [r.randrange(letters) for _ in range(r.randint(0, 45))]
        if len(w) > 4 and r.random() < 0.5:
            a = r.randrange(len(w))
            p = 1 + (len(w) - a) // r.randint(2, 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        assert runs.runs_of(np.array(w, np.int64), shortest, times) == plain_runs(w, shortest, times)


def test_next_smaller_suffixes_of_hard_words():
    """Words with many long repeats, in time that grows with their length."""


    def fibonacci(n):
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]

    for make in (fibonacci, lambda n: [0] * n, lambda n: [0, 1] * (n // 2), lambda n: [bin(k).count("1") & 1 for k in range(n)], lambda n: ([0] * 20 + [1] + [0] * 20 + [2]) * (n // 42)):
        after, _ = runs.lyndon_array(np.array(make(1200), np.int64))
        w = make(1200)
        for i in range(0, len(w), 7):
            assert after[i] == next((j for j in range(i + 1, len(w)) if w[j:] < w[i:]), len(w))
        start = time.perf_counter()
        runs.runs_of(np.array(make(300_000), np.int64), 6, 4)
        assert time.perf_counter() - start < 60  # some seconds; matching every pair anew takes hours


def test_runs_query_on_odd_rows(spark, monkeypatch):
    docs = odd_docs() + [(k, "ab " * k) for k in range(200, 240)] + [(300, "a b c d " * 2000)]
    monkeypatch.setattr(queries, "_read", lambda *a: frame(spark, docs).repartition(5))
    assert rows(queries.op11_runs(spark, ""), *COLUMNS) == sorted((plain_row(i, t) for i, t in docs), key=str)


def test_runs_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert runs.periodic_runs(runs.looped(none)).count() == 0
    named = spark.createDataFrame([("x", "go go go go go go stop", 1)], "id string, text string, runs int")
    found = runs.periodic_runs(named, "id").first()
    assert [tuple(r) for r in found.runs] == [(0, 6, 1)] and found.collapsed == "go stop" and found.n_words == 7


@needs_data
def test_runs_query_on_documents(spark):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert rows(queries.op11_runs(spark, SMALL), *COLUMNS) == sorted((plain_row(i, t) for i, t in docs), key=str)


# phrases

def plain_phrases(docs, longest=5, least=100, within=100, top=2000):
    count, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                for k in range(len(w) - n + 1):
                    count[lang, tuple(w[k : k + n])] += 1
    out = {}
    kept = {p: c for p, c in count.items() if c >= least and len(p[1]) > 1}
    inside = Counter()
    for (lang, w), c in kept.items():
        for n in range(2, len(w)):
            for k in range(len(w) - n + 1):
                inside[lang, w[k : k + n]] = max(inside[lang, w[k : k + n]], c)
    for (lang, w), a in kept.items():
        if inside[lang, w] and 100 * inside[lang, w] >= within * a:
            continue
        cut = min((1000 * a * total[lang] // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w)))
        x, y = count[lang, w[: cut[1]]], count[lang, w[cut[1] :]]
        out.setdefault(lang, []).append((-cut[0], -a, " ".join(w).encode(), x, y))
    return sorted((lang, k, p.decode(), -a, x, y, total[lang], -s) for lang, own in out.items() for k, (s, a, p, x, y) in enumerate(sorted(own)[:top], 1))


PHRASE = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def wordy():
    r = random.Random(3)
    say = lambda n: "".join(r.choice(["A", "b", "cé", "the", "of", "x-y"]) + r.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", ";", "! "]) for _ in range(n))
    docs = [(r.choice(["en", "en", "de", None, "und"]), say(r.choice([0, 3, 50, 200]))) for _ in range(60)] + [("en", None), (None, ""), ("fr", " ., ")]
    return docs + [("es", "uno dos tres cuatro cinco seis")] * 7 + [("en", "long " * 40_000)]


@pytest.mark.parametrize("least,within,top", [(5, 100, 2000), (3, 60, 4), (300, 100, 10)])
def test_phrases(spark, least, within, top):
    docs = wordy()
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "lang string, text string, words int, f int").repartition(3)
    got = phrases.collocations(df, least=least, within=within, top=top)
    assert rows(got, *PHRASE) == sorted(plain_phrases(docs, least=least, within=within, top=top), key=str)


def test_small_sketches_and_spans_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SPAN", 100)
    docs = wordy()[:-1]
    df = spark.createDataFrame(docs, "lang string, text string")
    assert rows(phrases.collocations(df, least=4, most=4096), *PHRASE) == sorted(plain_phrases(docs, least=4), key=str)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_products_beyond_64_bits(spark, monkeypatch):
    big = 3 * 10**12
    counts = [("en", "", 0, 9 * 10**14), ("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 7)]
    monkeypatch.setattr(phrases, "phrase_counts", lambda *a, **k: spark.createDataFrame(counts, "lang string, phrase string, words int, f long"))
    assert phrases.collocations(spark.range(0)).first().score == 1000 * (big - 7) * 9 * 10**14 // (big * (big + 1))


# similar texts

def plain_classes(docs, words=5, least=Fraction(4, 5)):
    sets = []
    for _, t in docs:
        w = WORD.findall(low(t))
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if min(len(sets[a]), len(sets[b])) >= least * max(len(sets[a]), len(sets[b]), 1) and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least_id = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least_id[find(k)] = min(least_id.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least_id.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(docs)), key=str)


CLASS = ["doc_id", "n_shingles", "component_id"]


def boiled():
    """Texts that share most of their words with many others, without being similar, and near copies among them."""
    r = random.Random(4)
    say = lambda n: [f"w{r.randrange(9000)}" for _ in range(n)]
    lines = [say(12) for _ in range(6)]
    docs = []
    for _ in range(70):
        at = [w for line in r.sample(lines, r.randint(3, 6)) for w in line] + say(r.choice([5, 9, 14, 20]))
        docs.append(at)
        if r.random() < 0.4:
            at = list(at)
            at[r.randrange(len(at))] = "other"
            docs.append(at)
    docs += [say(n) for n in (1, 2, 4, 5, 6, 7, 8, 9, 10, 12) for _ in range(4)]
    docs += [[*d, "more"] for d in docs[-40:]]
    docs += [["ha"] * n for n in range(1, 30)] + [["ha", "ho"] * n for n in range(1, 12)]
    return [(k if k % 17 else None, " ".join(d)) for k, d in enumerate(docs)]


@pytest.mark.parametrize("make,cheap,rounds", [(edited, 16, 1), (boiled, 0, 0), (odd_docs, 10**6, 0)])
def test_classes(spark, monkeypatch, make, cheap, rounds):
    monkeypatch.setattr(jaccard, "CHEAP", cheap)
    docs = make()
    got = jaccard.similar_classes(frame(spark, docs).repartition(3), rounds=rounds)
    assert rows(got, *CLASS) == plain_classes(docs)


@pytest.mark.parametrize("words,least", [(1, 0.5)])
def test_classes_of_other_similarities(spark, monkeypatch, words, least):
    monkeypatch.setattr(jaccard, "CHEAP", 1)
    docs = boiled()
    assert rows(jaccard.similar_classes(frame(spark, docs), words=words, least=least, rounds=1), *CLASS) == plain_classes(docs, words, Fraction(str(least)))


def test_classes_when_bits_and_blocks_are_few(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_BITS", 1 << 16)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 3000)
    docs = boiled()
    assert rows(jaccard.similar_classes(frame(spark, docs)), *CLASS) == plain_classes(docs)


def test_weights_suffice():
    """Sets that are similar differ in less than the larger one's weights, and each band has as many segments."""
    for least in (Fraction(4, 5), Fraction(1, 2), Fraction(9, 10)):
        bands = jaccard.Bands(400, least)
        for y in range(1, 401):
            for part, asks, band, need in bands.asks(np.array([y])):
                for x in range(bands.low[band[0]], min(y, bands.high[band[0]]) + 1):
                    both = min(x, y)
                    while asks[0] and both >= 0 and both >= least * (x + y - both):
                        assert x + y - 2 * both < need[0] <= bands.segments[band[0]]
                        both -= 1
            lowest = -(-least.numerator * y // least.denominator)
            assert np.searchsorted(bands.high, lowest) >= np.searchsorted(bands.high, y) - 1


def test_no_texts(spark):
    assert jaccard.similar_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert rows(jaccard.similar_classes(spark.createDataFrame([(2, None), (1, " ")], "doc_id long, text string")), *CLASS) == [(1, 0, 1), (2, 0, 2)]


@needs_data
def test_classes_of_documents(spark):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert rows(queries.op13_jaccard(spark, SMALL), *CLASS) == plain_classes(docs)
