"""Near-duplicate documents and vectors against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from fixtures import groups_of, lower, near_copies, odd_texts, table
from pyspark.sql import functions as F

from reelgrid.llm.graph import components
from reelgrid.llm.near_dup import near_duplicates
from reelgrid.llm.store import Workspace, top_threshold
from reelgrid.llm.vector_dup import Quantiser, near_vectors


def brute_documents(rows, k, percent):
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for _, t in rows]
    sets = [{tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in words]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = groups_of(len(rows), links)
    least: dict = {}
    for r, (i, _) in zip(root, rows):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, len(s), least.get(r), i == least.get(r)) for (i, _), s, r in zip(rows, sets, root)]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    rows = [r for r in odd_texts() if r[0] is not None]
    rows += near_copies(40, 60, 0.04, 1, 1000) + near_copies(30, 200, 0.01, 2, 2000) + near_copies(25, 12, 0.08, 3, 3000)
    r = random.Random(5)
    rows += [(4000 + i, " ".join(r.choice("the of and to in".split()) for _ in range(8))) for i in range(40)]
    rows += [(5000 + i, "same text in many rows " * 3) for i in range(30)]
    got = near_duplicates(table(spark, rows), shingle_words=k, percent=80, block=8, piece=8).collect()
    assert sorted(map(tuple, got)) == sorted(brute_documents(rows, k, 80))


def test_rows_without_id(spark):
    got = near_duplicates(table(spark, [(None, "a b c d e f"), (7, "a b c d e f"), (None, "g h i j k l"), (None, None)]), shingle_words=2).collect()
    assert sorted(map(str, got)) == sorted(map(str, near_duplicates(table(spark, [(None, "g h i j k l"), (7, "a b c d e f"), (None, None), (None, "a b c d e f")]), shingle_words=2).collect()))
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, 7, False), (7, 7, True), (None, None, True)}


def test_no_documents(spark):
    assert near_duplicates(table(spark, [])).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = components(Workspace(spark), spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == 251
    assert {len({r.root for r in got if r.node < 500}), len({r.root for r in got if r.node >= 1000})} == {1}
    assert components(Workspace(spark), spark.createDataFrame([], "a long, b long")).collect() == []


def test_top_threshold(spark):
    values = [-(1 << 63), -5, -5, 0, 3, 3, 3, 1 << 40, (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "key long")
    for n in range(1, len(values) + 1):
        assert top_threshold(df, "key", n) == sorted(values, reverse=True)[n - 1]
    assert top_threshold(df, "key", len(values) + 1) is None


def vectors():
    r = np.random.default_rng(4)
    rows = []
    for label in (0, 1):
        centers = r.normal(size=(12, 16))
        for c in centers:
            for _ in range(12):
                rows.append((len(rows), (c + r.normal(scale=0.25, size=16)).astype(np.float32).tolist(), label))
    same = rows[0][1]
    rows += [(9000 + i, same, 0) for i in range(20)] + [(9100, [2 * x for x in same], 0), (9101, same, None), (9102, same, 1)]
    rows += [(9200, None, 0), (9201, [0.0] * 16, 0), (9202, [float("nan")] * 16, 0), (9203, [float("inf")] * 16, 0), (9204, [], 0), (9205, same[:8], 0), (9206, [None, *same[1:]], 0), (0, same, 0)]
    return rows


def brute_vectors(rows, cosine):
    good = [v is not None and len(v) > 0 and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, y in rows]
    link = []
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.float64(np.float32(rows[i][1])), np.float64(np.float32(rows[j][1]))
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine:
                    link.append((i, j))
    root = groups_of(len(rows), link)
    n = np.bincount(np.array(link, int).ravel(), minlength=len(rows))
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    return [(rows[i][0], int(n[i]), least[root[i]], rows[i][0] == least[root[i]]) for i in range(len(rows))]


def test_near_vectors_equal_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, list int")
    got = near_vectors(df, cosine=0.93, piece=16).collect()
    assert sorted(map(tuple, got)) == sorted(brute_vectors(rows, 0.93))
    assert near_vectors(df.limit(0)).collect() == []


def test_recall_of_the_index_is_whole(spark):
    """Every pair at the cosine is inside the probed lists and the coded distances."""
    x = np.random.default_rng(8).normal(size=(600, 16)).astype(np.float32)
    x[300:] = x[:300] + np.random.default_rng(9).normal(scale=0.08, size=(300, 16)).astype(np.float32)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    q = Quantiser.train(x, lists=16)
    at, codes, err = q.code(x)
    reach = np.sqrt(2 - 2 * 0.93)
    probe = q.probes(x, at, reach)
    i, j = np.nonzero(x @ x.T >= 0.93)
    assert len(i) > 700 and probe[i, at[j]].all()
    assert (~probe).any()
    for c in range(len(q.center)):
        own = np.flatnonzero(at == c)
        far = q.table_distances(x, c, codes[own]) - err[own]
        real = np.sqrt(((x[:, None] - x[None, own]) ** 2).sum(2))
        assert (far <= real + 1e-3).all()


def test_queries_on_whole_tables_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = near_duplicates(docs.withColumn("node", F.lit(1)), shingle_words=2).collect()
    assert sorted(map(tuple, got)) == sorted(brute_documents(rows, 2, 80))
