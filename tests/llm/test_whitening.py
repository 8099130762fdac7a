import numpy as np
import pytest

from tracklens.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, label int, x string, n string, deviation string, whitened string"


def frame(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, "x", "n", "d", "w") for i, v in vectors], schema).repartition(3)


def brute(vectors, count=4):
    """By numpy: {vec_id: (deviation, whitened)}, n, explained; vectors have one length and unique ids."""
    able = [(i, v) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(c * 256)) for c in v] for _, v in able]
    fit = np.array(sorted(set(map(tuple, x))), float)
    n, s = len(fit), [sum(int(f[j]) for f in fit) for j in range(fit.shape[1])]
    cov = (fit - fit.mean(0)).T @ (fit - fit.mean(0)) / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    white = (np.array(x, float) - np.array([t / n for t in s])) @ axes / np.sqrt(values)
    return {i: (e if (e := sum((n * a - b) ** 2 for a, b in zip(v, s))) < 2**63 else None, w) for (i, _), v, w in zip(able, x, white)}, n, values / np.trace(cov)


def check(rows, vectors, count=4, near=1e-9):
    want, n, explained = brute(vectors, count)
    got = {(r.vec_id, r.component): r for r in rows}
    assert set(got) == {(i, c) for i in want for c in range(1, count + 1)} and len(rows) == len(got)
    own = np.array([[got[i, c].whitened for c in range(1, count + 1)] for i in want])
    other = np.array([want[i][1] for i in want])
    assert np.abs(own * np.sign((own * other).sum(0)) - other).max() < near
    for i in want:
        assert {got[i, c].deviation for c in range(1, count + 1)} == {want[i][0]}
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-10
    assert np.allclose([got[next(iter(want)), c].explained for c in range(1, count + 1)], explained, rtol=1e-10)


@pytest.mark.parametrize("d, kind", [(40, "flat"), (40, "one giant"), (30, "falling"), (6, "small"), (4, "four")])
def test_whitened_rows_match_numpy(spark, d, kind):
    rng = np.random.default_rng(d)
    scale = {"flat": np.ones(d), "one giant": np.r_[3e3, np.ones(d - 1)], "falling": 0.5 ** np.arange(d) * 50}.get(kind, np.ones(d))
    vectors = [(i, v) for i, v in enumerate((rng.normal(size=(300, d)) * scale + 3).tolist())]
    check(W.whitened_components(frame(spark, vectors)).collect(), vectors, near=1e-6 if kind == "one giant" else 1e-9)


def test_defined_cases(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, v) for i, v in enumerate(rng.normal(size=(80, 7)).tolist())]
    vectors += [(100 + i, list(v)) for i, v in vectors[:20]]  # copies count once in the fit list
    odd = [(200, None), (201, []), (202, [None] * 7), (203, [float("nan")] + [0.0] * 6), (204, [float("inf")] * 7), (205, [1e300] * 7), (206, [1.0, 2.0])]
    rows = W.whitened_components(frame(spark, [*vectors, *odd])).collect()
    check(rows, vectors)
    with_null = W.whitened_components(frame(spark, [*vectors, (None, vectors[3][1]), (5, vectors[5][1])])).collect()
    assert len(with_null) == len(rows) + 8  # the null id and the repeated row are rows as well


def test_zero_variance_and_empty_tables(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for vectors in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [0.5, 0.5, 0.5]) for i in range(5)]):
        got = W.whitened_components(frame(spark, vectors))
        assert got.columns == columns and got.count() == 0
    line = [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]  # one direction only
    got = W.whitened_components(frame(spark, line)).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12


def test_deviation_is_exact(spark):
    x = np.array([[2**40, -(2**40) + 1], [3, 7]])
    n, s = 2, [2**40 + 3, -(2**40) + 8]
    assert W._deviations(x, n, s) == [None, None]  # about 2**81
    x = np.array([[2**29 + 1, 5], [3, 7]])
    assert W._deviations(x, 2, [2**29 + 4, 12]) == [(2**29 - 2) ** 2 + 4, (2**29 - 2) ** 2 + 4]


def test_leading_axes_without_spark():
    """Any spectrum ends: equal values, neighbours closer than the block can part, fewer than asked for."""
    rng = np.random.default_rng(0)
    for values in (np.ones(50), np.r_[np.full(30, 2.0), np.ones(20)], np.r_[1.0, np.zeros(49)], 1 - 1e-9 * np.arange(50), np.r_[5.0, 5.0, 4.0, 4.0, np.linspace(3.999, 1, 46)]):
        q = np.linalg.qr(rng.normal(size=(50, 50)))[0]
        v = (q * values) @ q.T
        calls = []
        found, axes, residuals = W.leading(lambda b: calls.append(b.shape) or v @ b, 50, 4, extra=6)
        assert np.allclose(found, np.sort(values)[::-1][: len(found)], atol=1e-10) and len(found) in (4, len(values[values > 0]))
        assert np.abs(axes.T @ axes - np.eye(axes.shape[1])).max() < 1e-12
        assert np.linalg.norm(v @ axes - axes * found, axis=0).max() < 1e-10 and len(calls) < 400
