"""Whitening against dense numpy and exact integers."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, n string, x int, copies int"


def plain(rows, weights="one", components=4):
    """(vec_id, component) -> (n, deviation, whitened, explained), eigenvectors from numpy's SVD of the centred list."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    xs = [tuple(int(np.floor(256.0 * float(c))) for c in v) for _, v in kept]
    fit = sorted(set(xs))
    w = [1 if weights == "one" else xs.count(x) for x in fit]
    n = sum(w)
    sums = [sum(a * x[d] for a, x in zip(w, fit, strict=True)) for d in range(len(fit[0]))]
    centred = np.array([[float(Fraction(n * x[d] - sums[d], n)) for d in range(len(sums))] for x in fit])
    _, s, vt = np.linalg.svd(centred * np.sqrt(np.array(w, dtype=float))[:, None], full_matrices=False)
    e = s**2 / n
    out = []
    for (vec_id, _), x in zip(kept, xs, strict=True):
        own = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, sums, strict=True)])
        dev = sum((n * a - b) ** 2 for a, b in zip(x, sums, strict=True))
        for c in range(min(components, len(sums))):
            out.append((vec_id, c + 1, n, dev, own @ vt[c] / np.sqrt(e[c]), e[c] / e.sum()))
    return out


def same(got, want):
    """Equal but for the sign of each component."""
    got = sorted([tuple(r)[:6] for r in got], key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4])))
    want = sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4])))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for c in {r[1] for r in want}:
        a = np.array([r[4] for r in got if r[1] == c])
        b = np.array([r[4] for r in want if r[1] == c])
        b = b if a @ b > 0 else -b
        assert np.abs(a - b).max() < 1e-7
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(120, 6)) * [3, 2, 1.5, 1, 0.5, 0.2] + 5).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, base[7].tolist()) for i in range(300)]  # one vector on most rows
    rows += [(5, base[5].tolist()), (None, base[2].tolist()), (None, base[2].tolist())]
    odd = [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5)]
    return rows, odd


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_equals_dense(spark, vectors, weights):
    rows, odd = vectors
    got = whitening.whiten(frame(spark, rows + odd), weights=weights).collect()
    same(got, plain(rows, weights))
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1


def test_hot_vector_is_dealt_in_parts(spark, vectors, monkeypatch):
    monkeypatch.setattr(whitening, "PARTS", 40)
    rows, _ = vectors
    same(whitening.whiten(frame(spark, rows)).collect(), plain(rows))


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = queries.QUERIES["op11_whitening"](spark, sf)
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same(got.collect(), plain(rows))


def test_empty_constant_and_ragged(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, []), (2, None)])).count() == 0
    got = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got) == [
        (i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)
    ]
    # One varying dimension of two: the second component has no variance.
    got = whitening.whiten(frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [9.0])])).collect()
    assert {(r.vec_id, r.component, None if r.whitened is None else abs(r.whitened)) for r in got} == {
        (1, 1, 1.0), (1, 2, None), (2, 1, 1.0), (2, 2, None),
    }


def test_values_beyond_a_long(spark):
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1e10, 3.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r.deviation for r in got} == {None} and all(np.isfinite(r.whitened) for r in got if r.component == 1)
    rows = [(1, [2.0**22, 1.0]), (2, [-(2.0**22), 2.0])]
    want = {i: r[3] for i, r in ((r[0], r) for r in plain(rows))}
    assert {r.vec_id: r.deviation for r in whitening.whiten(frame(spark, rows)).collect()} == want


def test_whole_numbers():
    values = np.array([0.0, -0.0, -0.001, 1e300, -1e300, 1.7e308, 0.999])
    assert whitening.whole(values, 256).tolist() == [0, 0, -1, whitening.TOP, -whitening.TOP - 1, whitening.TOP, 255]
    for x in ([], [1, -1], [300, 1], [2**40, 0], [-(2**63), 5]):
        x = np.array(x, dtype=np.int64)
        assert whitening.matrix([whitening.encoded(x)], len(x)).tolist() == [x.tolist()]


def test_extra_columns_stay_out(spark, vectors):
    got = whitening.whiten(frame(spark, vectors[0]).withColumn("dims", F.lit("z")).withColumn("part", F.lit(1)))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
