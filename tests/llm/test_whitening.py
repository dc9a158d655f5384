import numpy as np
import pytest

from capledger.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, id long, x string, n int"


@pytest.mark.parametrize("case", ["plain", "repeated", "zero", "wide"])
def test_an_update_is_an_eigendecomposition(case):
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 8, 40):
        for _ in range(10):
            values = rng.uniform(0, 5, size)
            row = rng.normal(size=size)
            if case == "repeated":
                values = np.round(values)
            if case == "zero":
                values[: size // 2] = 0
                row[::2] = 0
            if case == "wide":
                values = 10.0 ** rng.uniform(-9, 9, size)
                row *= 10.0 ** rng.uniform(-4, 4)
            vectors = np.linalg.qr(rng.normal(size=(size, size)))[0]
            want = vectors * values @ vectors.T + np.outer(row, row)
            with np.errstate(all="ignore"):
                got_values, got = W._update(values, vectors.copy(), row)
            scale = np.abs(want).max()
            assert np.abs(got * got_values @ got.T - want).max() < 1e-12 * scale
            assert np.abs(got.T @ got - np.eye(size)).max() < 1e-12
            assert np.allclose(np.sort(got_values), np.linalg.eigvalsh(want), atol=1e-12 * scale)


def test_spectra_of_parts_combine():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 6)) @ rng.normal(size=(6, 6)) + 1e5
    s = W.Spectrum.empty(6)
    for part in np.split(x, [1, 3, 50, 51, 300]):
        s = W.combined(s, W.with_vectors(W.Spectrum.empty(6), part))
    c = x - x.mean(0)
    assert s.n == 500 and np.allclose(s.mean, x.mean(0))
    assert np.allclose(s.vectors * s.values @ s.vectors.T, c.T @ c, rtol=0, atol=1e-8)


def _rows(n=700, size=12):
    rng = np.random.default_rng(8)
    v = (rng.normal(size=(n, size)) * np.linspace(1, 0.05, size)).astype(np.float32)
    rows = [(i, r.tolist(), i % 3, 5, "y", None) for i, r in enumerate(v)]
    rows += [(5000 + i, v[0].tolist(), None, 1, None, 1) for i in range(300)]
    rows += [(None, v[1].tolist(), 0, 0, "", 0), (6000, None, 0, 0, "", 0), (6001, [], 0, 0, "", 0), (6002, [float("nan")] * size, 0, 0, "", 0),
             (6003, [float("inf")] + [0.0] * (size - 1), 0, 0, "", 0), (6004, [None] + [0.0] * (size - 1), 0, 0, "", 0), (6005, [1.0] * 3, 0, 0, "", 0),
             (7, v[7].tolist(), 0, 0, "", 0)]
    return rows


def _check(got, rows, size, components):
    used = [(i, np.array(v)) for i, v, *_ in rows if v is not None and len(v) == size and all(e is not None and np.isfinite(e) for e in v)]
    x = np.floor(1024 * np.array([v for _, v in used], float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    whitened = c @ u[:, :components] / np.sqrt(e[:components])
    deviation = ((n * x - s) ** 2).sum(1)
    by_component = {}
    for r in got:
        assert r.n == n and abs(r.explained - e[r.component - 1] / e.sum()) < 1e-9 and r.identity_error < 1e-9
        by_component.setdefault(r.component, []).append(r)
    assert sorted(by_component) == list(range(1, components + 1))
    for k, part in by_component.items():
        name = lambda r: (str(r[0]), r[1], r[2])
        mine = sorted(((r.id, r.deviation, r.whitened) for r in part), key=name)
        options = [sorted(((i, int(d), sign * w) for (i, _), d, w in zip(used, deviation, whitened[:, k - 1], strict=True)), key=name) for sign in (1, -1)]
        assert any(all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-8 for a, b in zip(mine, want, strict=True)) for want in options)


@pytest.mark.parametrize("parts,fan_in,batch", [(1, 8, 4096), (5, 2, 50), (40, 3, 7)])
def test_agrees_with_a_plain_solver(spark, parts, fan_in, batch):
    rows = _rows()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    _check(W.whitened_embeddings(frame, fan_in=fan_in, batch_rows=batch).collect(), rows, 12, 8)


def test_few_dimensions_and_low_rank(spark):
    rows = [(i, [float(i), float(2 * i), 1.0], 0, 0, "", 0) for i in range(50)]
    _check(W.whitened_embeddings(spark.createDataFrame(rows, SCHEMA)).collect(), rows, 3, 1)


def test_without_components(spark):
    columns = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, [1.0, 2.0], 0, 0, "", 0)] * 4, [(1, None, 0, 0, "", 0)]):
        got = W.whitened_embeddings(spark.createDataFrame(rows, SCHEMA))
        assert got.columns == columns and got.collect() == []


def test_huge_entries(spark):
    rows = [(i, [1e30 * (-1) ** i, float(i)], 0, 0, "", 0) for i in range(20)]
    got = W.whitened_embeddings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) >= 20 and all(r.deviation is None for r in got)
