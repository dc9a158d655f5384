import numpy as np
import pytest

from capledger.llm.spherical import embedding_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, node long, cell int"


def _brute(rows, cosine=0.98):
    n = len(rows)
    ok = [v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v, lab in rows]
    parent, links = list(range(n)), [0] * n

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float32).astype(float), np.array(rows[j][1], np.float32).astype(float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if find(j) == find(i) and rows[j][0] is not None]
        own = min(ids) if ids else None
        out.append((rows[i][0], links[i], own, own is None or rows[i][0] is None or rows[i][0] == own))
    return out


def _rows():
    rng = np.random.default_rng(9)
    rows = []
    for i in range(260):
        base = rng.normal(size=8)
        for k in range(rng.choice([1, 1, 3])):
            rows.append((len(rows) * 3, (base * rng.uniform(0.5, 2) + rng.normal(size=8) * 0.12).tolist(), int(rng.choice([0, 0, 1]))))
    hot = rng.normal(size=8)
    rows += [(5000 + i, (hot + rng.normal(size=8) * 0.08).tolist(), 0) for i in range(150)]
    rows += [(9000, None, 0), (9001, [0.0] * 8, 0), (9002, [float("nan")] * 8, 0), (9003, [1.0, None] * 4, 0), (9004, [], 0), (9005, [float("inf")] * 8, 0)]
    rows += [(9006, hot.tolist(), None), (None, hot.tolist(), 0), (9007, [1.0, 2.0], 0), (9008, [2.0, 4.0], 0), (9008, [2.0, 4.0], 0), (9009, hot.tolist(), 0), (None, [1e30] * 8, 1), (9010, [1e-30] * 8, 1)]
    return rows


@pytest.mark.parametrize("cell_rows,block_rows", [(20, 16), (100_000, 40), (50, 1000)])
def test_agrees_with_all_pairs(spark, cell_rows, block_rows):
    rows = _rows()
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)
    got = embedding_duplicates(frame, cell_rows=cell_rows, block_rows=block_rows).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, _brute(rows)))


def test_empty_table(spark):
    assert embedding_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
