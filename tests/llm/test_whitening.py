"""Whitening against dense algebra, on exact sums, and on odd rows."""

import math

import numpy as np
import pytest

from ohmline.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label string"


def plain(rows):
    """(ids, whole numbers, distinct whole numbers) of the usable rows, in Python's whole numbers."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept]
    return [i for i, _ in kept], x, sorted(set(map(tuple, x)))


def check(rows, found, components=16):
    ids, x, fit = plain(rows)
    n, size = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit)]
    centred = np.array([[n * c - s for c, s in zip(row, sums)] for row in fit], float) / n
    v = centred.T @ centred / n
    e = np.linalg.eigvalsh(v)[::-1]
    k = min(components, size, int((e > 1e-12 * e.sum()).sum()))
    assert len(found) == len(ids) * k and {r["n"] for r in found} == {n}
    deviation = {}
    for i, row in zip(ids, x):
        deviation.setdefault(i, set()).add(sum((n * c - s) ** 2 for c, s in zip(row, sums)))
    assert all(r["deviation"] in deviation[r["vec_id"]] for r in found)
    for r in found:
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) <= 1e-10 * r["explained"]
        assert r["identity_error"] < 1e-9
    place = {}
    for i, row in zip(ids, x):
        place.setdefault(i, np.array([n * c - s for c, s in zip(row, sums)], float) / n)
    if len(set(ids)) == len(ids):
        w = np.zeros((len(ids), k))
        at = {i: p for p, i in enumerate(ids)}
        for r in found:
            w[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        # whitened = (x - mean) u / sqrt(e): u is found from it and must be an eigenvector, to double precision
        own = np.array([place[i] for i in ids])
        u = np.linalg.lstsq(own, w * np.sqrt(e[:k]), rcond=None)[0]
        assert np.abs(v @ u - u * e[:k]).max() < 1e-10 * e[0]


def test_query_against_dense(spark):
    from ohmline.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows, queries.op12_whitening(spark, sf).collect())


def test_copies_count_once_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 20)) * np.linspace(3, 0.2, 20)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, base[0].tolist()) for i in range(80)]
    odd = [(900, None), (901, [None] + [0.0] * 19), (902, [math.nan] + [0.0] * 19), (903, [math.inf] + [0.0] * 19), (904, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], SCHEMA).repartition(5)
    found = whitening.whiten(df).collect()
    check(rows, found)
    assert {r["vec_id"] for r in found} == {i for i, _ in rows}


@pytest.mark.parametrize("size, n", [(1, 4), (3, 50), (17, 9)])
def test_few_dimensions_and_few_vectors(spark, size, n):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(size).standard_normal((n, size)) * 4)]
    check(rows, whitening.whiten(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect())


def test_nothing_to_whiten(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None, "x")], [(1, [], "x")], [(1, [1.0, 2.0], "x")], [(1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "y")]):
        found = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert found.columns == columns and found.count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e9 * i, 3e10 - i, 0.5 * i]) for i in range(7)]
    found = whitening.whiten(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    ids, x, fit = plain(rows)
    sums = [sum(c) for c in zip(*fit)]
    want = {i: sum((len(fit) * c - s) ** 2 for c, s in zip(row, sums)) for i, row in zip(ids, x)}
    assert all(r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 1 << 63 else None) for r in found)


def test_solver_on_clusters():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((120, 120)))[0]
    values = np.concatenate(([5.0, 5.0, 5.0, 4.9999999], np.linspace(4, 0.1, 116)))
    a = (q * values) @ q.T
    found, units = whitening.jacobi_davidson(a, 120, 16)
    assert np.abs(found - np.sort(values)[::-1][:16]).max() < 1e-13
    assert np.abs(a @ units - units * found).max() < 1e-13 and np.abs(units.T @ units - np.eye(16)).max() < 1e-13
