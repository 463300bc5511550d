"""Whitening against a direct eigendecomposition of the exact covariance."""

import math

import numpy as np
import pytest

from slotwise.llm import whitening as wh

TYPE = "vec_id long, embedding array<float>, label int, N string"


def plain(rows, components=4):
    """(vec_id, component) -> (n, deviation, whitened, explained), by one dense matrix."""
    good = [
        (i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
        if v and all(c is not None and math.isfinite(c) for c in v)
    ]
    fit = np.array(sorted({tuple(x) for _, x in good}), object)
    n, sums = len(fit), fit.sum(0)
    centred = (fit * n - sums).astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in good:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        at = (np.array([n * a - s for a, s in zip(x, sums, strict=True)], float) / n) @ vectors
        for k in range(min(components, len(x))):
            out.append((i, k + 1, n, deviation, at[k] / math.sqrt(values[k]), values[k] / values.sum()))
    return out


def same(found, wanted, tight=1e-9):
    """Equal rows, each component up to one sign for all rows."""
    found = sorted((tuple(r) for r in found), key=lambda r: (r[1], str(r[0]), r[3], abs(r[4])))
    wanted = sorted(wanted, key=lambda r: (r[1], str(r[0]), r[3], abs(r[4])))
    assert [r[:4] for r in found] == [r[:4] for r in wanted]
    a, b = np.array([r[4] for r in found]), np.array([r[4] for r in wanted])
    for k in {r[1] for r in wanted}:
        part = np.array([r[1] == k for r in wanted])
        sign = np.sign(a[part] @ b[part])
        np.testing.assert_allclose(sign * a[part], b[part], rtol=tight, atol=tight)
    np.testing.assert_allclose([r[5] for r in found], [r[5] for r in wanted], rtol=1e-10)


COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained"]


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) / d).tolist()


@pytest.mark.parametrize("d", [1, 2, 3, 7, 24])
def test_equals_a_direct_decomposition(spark, d):
    rows = [(i, v, 1, "x") for i, v in enumerate(vectors(d, 300, d))]
    found = wh.whiten(spark.createDataFrame(rows, TYPE).repartition(20))
    assert found.columns == ["vec_id", "label", *wh.OUT]  # N gives way
    got = found.collect()
    same([[r[c] for c in COLUMNS] for r in got], plain([(r[0], r[1]) for r in rows]))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10


def test_odd_rows_go_and_copies_are_fitted_once(spark):
    rows = list(enumerate(vectors(4, 120, 6)))
    rows += [(7, rows[7][1])] * 400 + [(None, rows[3][1]), (500, [v + 1e-6 for v in rows[5][1]])]
    odd = [
        (900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6),
        (904, [-float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (905, []), (None, None), (906, [1.0, 2.0]), (907, [None]),
    ]
    docs = spark.createDataFrame([(i, v, None, None) for i, v in [*rows, *odd]], TYPE).repartition(5)
    found = wh.whiten(docs).select(*COLUMNS).collect()
    same(found, plain(rows))
    assert not {900, 901, 902, 903, 904, 905, 906, 907} & {r["vec_id"] for r in found}


def test_without_variance(spark):
    assert wh.whiten(spark.createDataFrame([], TYPE)).count() == 0
    assert wh.whiten(spark.createDataFrame([(1, None, 1, "x")], TYPE)).count() == 0
    one = wh.whiten(spark.createDataFrame([(1, [0.5, 0.25], 1, "x")] * 3, TYPE)).collect()
    assert len(one) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, 0.0, 0.0)}
    line = [(i, [i / 8, i / 4, 0.0], 1, "x") for i in range(20)]
    found = wh.whiten(spark.createDataFrame(line, TYPE)).collect()
    assert {r["component"] for r in found if r["whitened"] is not None} == {1}
    assert all(abs(r["explained"] - (r["component"] == 1)) < 1e-12 for r in found)


def test_equal_eigenvalues_and_large_numbers(spark):
    cross = [(2 * i + s, [(1000.0 if s else -1000.0) * (j == i) for j in range(5)], 1, "x") for i in range(5) for s in (0, 1)]
    found = wh.whiten(spark.createDataFrame(cross, TYPE)).collect()
    assert found[0]["identity_error"] < 1e-12 and {round(r["explained"], 12) for r in found} == {0.2}
    wide = [(i, [c * 2.0**12 for c in v], 1, "x") for i, v in enumerate(vectors(9, 60, 3))]
    same([[r[c] for c in COLUMNS] for r in wh.whiten(spark.createDataFrame(wide, TYPE)).collect()], plain([(r[0], r[1]) for r in wide]))
    assert wh.exact_deviation(np.array([[2**40, 0]]), 2**20, [0, 0]) == [None]
    assert wh.exact_deviation(np.array([[2**31, 1]]), 1, [0, 3]) == [2**62 + 4]


def test_rank_one_updates_give_the_scatter():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 40):
        one = wh.Spectrum.empty(d)
        rows = np.floor(rng.normal(size=(3 * d, d)) * 50)
        rows[d : 2 * d, 0] = 0  # deflated entries
        for row in rows:
            one.update(row)
        np.testing.assert_allclose(one.basis @ np.diag(one.values) @ one.basis.T, rows.T @ rows, rtol=1e-11, atol=1e-8)
        np.testing.assert_allclose(one.basis.T @ one.basis, np.eye(d), atol=1e-13)


def test_parts_combine_to_the_whole():
    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(size=(500, 9)) * 100 + 30)
    total = wh.Spectrum.empty(9)
    for low, high in ((0, 1), (1, 4), (4, 300), (300, 500)):
        part = wh.Spectrum.empty(9)
        part.add_rows(rows[low:high])
        total.add_spectrum(part)
    centred = rows - rows.mean(0)
    np.testing.assert_allclose(total.mean, rows.mean(0), rtol=1e-12)
    np.testing.assert_allclose(total.basis @ np.diag(total.values) @ total.basis.T, centred.T @ centred, rtol=1e-10, atol=1e-6)


def test_the_query(spark, sf_dir):
    found = wh.op13_embedding_whitening(spark, sf_dir)
    assert found.columns == ["vec_id", *wh.OUT]
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    same(found.select(*COLUMNS).collect(), plain(rows), 1e-8)
