"""The Jaccard join where regions are large, sets fill few classes, ids repeat and copies abound."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import jaccard_join

WORDS = 5


def shingles(text):
    w = text.split()
    return frozenset(tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)) if len(w) >= WORDS else frozenset([tuple(w)] if w else [])


def roots(texts):
    """Least index linked with each text, by comparing all with all."""
    sets = [shingles(t) for t in texts]
    number = {}
    for s in sets:
        for x in s:
            number.setdefault(x, len(number))
    m = np.zeros((len(sets), len(number)), np.float32)
    for i, s in enumerate(sets):
        m[i, [number[x] for x in s]] = 1
    common = m @ m.T
    size = m.sum(axis=1)
    link = 100 * common >= 80 * (size[:, None] + size[None, :] - common)
    forest = jaccard_join.Forest(len(sets))
    for i, j in zip(*np.nonzero(np.triu(link, 1)), strict=True):
        forest.join(int(i), int(j))
    return [forest.find(i) for i in range(len(sets))]


def near_copies(n, length, changes, seed=1, variants=2):
    """Copies of one text, each with up to `changes` words of few variants."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for p in r.sample(range(length), r.randint(0, changes)):
            words[p] = f"v{p}.{r.randrange(variants)}"
        out.append(" ".join(words))
    return out


def found(df, **options):
    return {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(df, **options).collect()}


@pytest.mark.parametrize("changes, options", [(3, {"members": 40}), (12, {"region": 4_000})])
def test_many_near_copies(spark, changes, options):
    texts = near_copies(350, 110, changes)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(df, **options) == dict(enumerate(roots(texts)))


def laid_rows(spark, texts):
    rows = []
    for i, t in enumerate(dict.fromkeys(texts)):
        codes = np.unique(np.array([hash(x) & (1 << 62) - 1 for x in shingles(t)], np.uint64))
        rows.append((7, i, len(codes), codes.tobytes()))
    return spark.createDataFrame(rows, jaccard_join.LAID).repartition(4)


@pytest.mark.parametrize("part", [8])
def test_ten_thousand_near_copies_do_not_multiply(spark, part):
    texts = near_copies(10_000, 120, 2, variants=40)
    laid = laid_rows(spark, texts)
    n, total = laid.agg(F.count("*"), F.sum("n")).first()
    left, edges = jaccard_join._split_large(laid, total // part, n // part)
    sizes = left.groupBy("region").count().collect()
    assert sum(r["count"] for r in sizes) < 2 * n and max((r["count"] for r in sizes), default=0) <= n // part
    # most left with a group: their edges hold them together
    assert edges.select("a").distinct().count() > 0.9 * n


def test_sets_with_few_classes_are_met_by_single_shingles():
    r = np.random.default_rng(3)
    codes = np.unique(r.integers(0, 1 << 60, 300).astype(np.uint64))
    _, _, thin = jaccard_join.signatures(codes, np.array([0, len(codes)]))
    assert not len(thin)
    _, _, thin = jaccard_join.signatures(codes, np.array([0, len(codes)]), percent=(8, 8))
    assert thin.tolist() == [0]


def test_ids_that_stand_for_several_texts(spark):
    a, b, c = near_copies(3, 60, 0, 1)[0], " ".join(f"x{i}" for i in range(50)), " ".join(f"y{i}" for i in range(40))
    rows = [(5, a), (5, b), (5, b), (6, b + " more"), (7, c), (8, a + " end"), (9, None), (9, ""), (10, "one two")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), members=1).collect())
    assert got == [(5, 46, 5), (5, 46, 5), (5, 56, 5), (6, 47, 5), (7, 36, 7), (8, 57, 5), (9, 0, 9), (9, 0, 9), (10, 1, 10)]


def test_very_long_texts_ties_and_clashing_columns(spark):
    long = " ".join(f"t{i % 50_000}" for i in range(200_000))
    rows = [(1, long, 1, 2, "r"), (2, long + " z", 1, 2, "r"), (3, "a b c d e f", 1, 2, "r"), (4, "A b C d e F", 1, 2, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int, component_id int, region string")
    assert found(df) == {1: 1, 2: 1, 3: 3, 4: 3}
    assert {r.doc_id for r in jaccard_join.keep_first(df).collect()} == {1, 3}
    assert jaccard_join.keep_first(df).columns == df.columns
