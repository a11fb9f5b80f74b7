"""Exact top-k search and whitening against brute force."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslens.llm import topk, whitening
from opslens.llm.queries import QUERIES
from opslens.llm.vectors import packed, unpacked
from tests.llm import fixtures


def usable(rows, scale):
    """(vec_id, integers) of the rows that take part."""
    ok = lambda v: v is not None and all(c is not None and math.isfinite(c) and abs(c * scale) < 2**62 for c in v)
    return [(r[0], [math.floor(scale * c) for c in r[1]]) for r in rows if ok(r[1])]


def best_of(rows, k=20):
    """Results of each query row, as a multiset of lists."""
    rows = [r for r in rows if r[0] is not None]
    found = []
    for i, (name, x) in enumerate(rows):
        if name % 20 == 0:
            scored = [(-sum(a * b for a, b in zip(x, y, strict=False)), other) for j, (other, y) in enumerate(rows) if j != i]
            found += [(name, place, other, -score) for place, (score, other) in enumerate(sorted(scored)[:k], 1)]
    return Counter(found)


def embeddings(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    return [(r.vec_id, r.embedding) for r in rows]


@pytest.mark.parametrize("table", ["edge", "repeated", "sf"])
@pytest.mark.parametrize("small", [False, True])
def test_best(spark, edge_dir, repeated_dir, table, small, monkeypatch):
    if small:  # several buckets, stripes and slices, and coordinate pruning for most
        for name, value in (("BUCKET", 7), ("STRIPE", 40), ("SLICE", 5), ("LEAST_STRIPE", 20), ("NARROW", 0.05)):
            monkeypatch.setattr(topk, name, value)
    folder = {"edge": edge_dir, "repeated": repeated_dir, "sf": "/root/testdata/sf0.001"}[table]
    got = QUERIES["op11_exact_topk"](spark, folder)
    assert Counter(map(tuple, got.collect())) == best_of(usable(embeddings(spark, folder), 64))


def test_fewer_rows_than_asked(spark):
    docs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<float>")
    rows = topk.top_products(docs, F.col("vec_id") < 2, k=20).collect()
    assert Counter(r.query_id for r in rows) == {0: 5, 1: 5}
    with pytest.raises(Exception, match="64 bits"):
        topk.top_products(spark.createDataFrame([(0, [3e16])], "vec_id long, embedding array<double>"), F.lit(True)).collect()


def test_buckets_are_pruned():
    """Of buckets with falling lengths only the first few are multiplied, and narrow queries only meet what is near."""
    r = np.random.default_rng(4)
    directions = r.normal(size=(4000, 16))
    lengths = np.sort(r.uniform(1, 1000, 4000))[::-1]
    x = np.floor(directions / np.linalg.norm(directions, axis=1)[:, None] * lengths[:, None] * 64).astype(np.int64)
    x = x[np.argsort(-np.linalg.norm(x, axis=1))]
    queries = np.floor(r.normal(size=(20, 16)) * 64).astype(np.int64)
    best = topk.Best(queries, np.full(20, -np.inf), 5)
    looked = []
    for start in range(0, 4000, 100):
        with np.errstate(divide="ignore"):
            looked.append(int((best.floor <= best.length * np.linalg.norm(x[start])).sum()))
        best.see(x[start : start + 100], np.arange(start, start + 100))
    scores = queries @ x.T
    for q in range(20):
        order = np.lexsort((np.arange(4000), -scores[q]))[:5]
        assert best.id[best.query == q].tolist() == order.tolist()
    assert looked[0] == 20 and looked[-1] == 0 and sum(looked) < 20 * 40 / 2


def test_packed():
    for values in ([], [0], [127, -127], [128], [-40000, 3], [2**40], [2**62]):
        assert unpacked([packed(np.array(values, np.int64))], 3)[0].tolist() == values + [0] * (3 - len(values))


def whitened_by_hand(rows):
    x = usable(rows, 256)
    dims = max((len(v) for _, v in x), default=0)
    x = [(name, tuple(v) + (0,) * (dims - len(v)), tuple(v)) for name, v in x]
    fit = np.array([v for v, _ in {(v, own) for _, v, own in x}], object)
    n, sums = len(fit), fit.sum(0)
    centred = (n * fit - sums).astype(float) / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    return x, n, sums, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("table", ["edge", "repeated", "sf"])
def test_whitened(spark, edge_dir, repeated_dir, table):
    folder = {"edge": edge_dir, "repeated": repeated_dir, "sf": "/root/testdata/sf0.01"}[table]
    x, n, sums, values, vectors = whitened_by_hand(embeddings(spark, folder))
    rows = QUERIES["op12_embedding_whitening"](spark, folder).collect()
    assert len(rows) == 4 * len(x)
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    got = defaultdict(list)
    for r in rows:
        got[r.component].append((r.vec_id is not None, r.vec_id or 0, r.deviation, r.whitened))
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    for k in range(4):
        want = [
            (name is not None, name or 0, sum((n * a - b) ** 2 for a, b in zip(v, sums, strict=True)), float((np.array(v, float) - sums.astype(float) / n) @ vectors[:, k] / math.sqrt(values[k])))
            for name, v, _ in x
        ]
        have = sorted(got[k + 1])
        sign = 1 if sum(a[3] * b[3] for a, b in zip(have, sorted(want), strict=True)) > 0 else -1
        want = sorted((*w[:3], sign * w[3]) for w in want)
        assert [h[:3] for h in have] == [w[:3] for w in want]
        assert np.allclose([h[3] for h in have], [w[3] for w in want], rtol=1e-6, atol=1e-8)


def test_degenerate(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<float>")).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, 0.0, 0.0)}
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    rows = whitening.whiten(spark.createDataFrame(line, "vec_id long, embedding array<float>")).collect()
    assert {r.component: r.whitened is None for r in rows} == {1: False, 2: True, 3: True}
    assert {r.explained for r in rows if r.component == 1} == {1.0}
    large = whitening.whiten(spark.createDataFrame([(0, [1e14]), (1, [0.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in large} == {None} and all(abs(abs(r.whitened) - 1) < 1e-12 for r in large)


def test_jacobi():
    r = np.random.default_rng(8)
    for rank, dims in ((7, 7), (3, 9), (1, 4), (16, 16)):
        a = r.normal(size=(dims, rank)) * 10.0 ** -np.arange(rank)
        v = a @ a.T
        factor = whitening.pivoted_cholesky(v)
        assert np.allclose(factor @ factor.T, v, atol=1e-12 * v.max())
        values, vectors = whitening.jacobi(factor)
        assert np.allclose((vectors * values) @ vectors.T, v, atol=1e-12 * v.max())
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-9)
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0) and len(whitening.jacobi(np.zeros((3, 0)))[0]) == 0


def test_fixture_has_ties():
    assert sum(v == fixtures.vectors()[-1][1] for _, v, *_ in fixtures.vectors()) > 1
