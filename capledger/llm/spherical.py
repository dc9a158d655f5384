"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Every vector belongs to the cell of its nearest centroid. Of two vectors with a cosine
of 0.98 in different cells, each lies so near the border between them that it can be a
guest in the other's cell; guests are found by that bound, so no pair is lost. Cells
with many rows are cut into blocks, and each pair of blocks is one unit of work whose
products are computed at once. A unit passes on one row per vector, with how many it is
linked with and the least vector of its local group, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.llm.components import component_labels
from capledger.operators.bounded import split_join
from capledger.sources.scratch import stored

COSINE = 0.98
SAMPLE = 20_000
CELL_ROWS = 2_000
MOST_CELLS = 1_024
BLOCK_ROWS = 1_000
ROUNDS = 12


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_cells(vectors: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of spherical k-means; ``vectors`` are unit rows in a fixed order."""
    cells = max(1, min(cells, len(vectors)))
    if not len(vectors):
        return vectors
    centroids = vectors[np.linspace(0, len(vectors) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(vectors[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(vectors), 4096)])
        total = np.zeros_like(centroids)
        np.add.at(total, own, vectors)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(size > 1e-9, total / np.maximum(size, 1e-9), centroids)
    return np.unique(centroids, axis=0)


def cells_of(unit: np.ndarray, centroids: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row, cell, is_home): each row's own cell, then the cells in which it is a guest.

    A vector y of cell c has y (c - a) >= 0 for every other centroid a. A vector x of cell a
    within the angle of the cosine has x (c - a) >= -sin(angle) |c - a|, or it can't reach y.
    """
    near = unit @ centroids.T
    home = near.argmax(axis=1)
    yield np.arange(len(unit)), home, True
    reach = np.sqrt(max(0.0, 1 - cosine * cosine)) + 1e-9
    gap = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
    own = near[np.arange(len(unit)), home]
    guest = near - own[:, None] >= -reach * gap[home] - 1e-12
    guest[np.arange(len(unit)), home] = False
    row, cell = np.nonzero(guest)
    yield row, cell, False


def _links_of_unit(frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """One block against another: hosts of the cell, and rows of the cell or its guests.

    Each link is counted where its later row is the guest or the row of the later block, so
    a pair of two home rows is seen once and a pair with a guest once from either side.
    """
    first = frame[frame["side"] == 0].sort_values("node")
    second = frame[frame["side"] == 1].sort_values("node")
    a, b = (np.stack([np.frombuffer(v, np.float64) for v in f["vector"]]) if len(f) else np.zeros((0, 0)) for f in (first, second))
    if not len(first) or not len(second):
        return pd.DataFrame({"node": [], "links": [], "least": []}).astype("int64")
    linked = a @ b.T >= cosine
    u, v = first["node"].to_numpy(), second["node"].to_numpy()
    linked &= u[:, None] != v[None, :]
    # Least row of each local group, by passing it along until nothing changes.
    low_u, low_v = u.copy(), v.copy()
    rows, cols = np.nonzero(linked)
    while True:
        new_v, new_u = low_v.copy(), low_u.copy()
        np.minimum.at(new_v, cols, low_u[rows])
        np.minimum.at(new_u, rows, new_v[cols])
        if (new_u == low_u).all() and (new_v == low_v).all():
            break
        low_u, low_v = new_u, new_v
    home = second["home"].to_numpy()
    same = bool(frame["same"].iloc[0])
    n_u = linked.sum(axis=1)
    n_v = np.zeros(len(v), np.int64) if same else np.where(home, linked.sum(axis=0), 0)
    touched_u, touched_v = linked.any(axis=1), linked.any(axis=0)
    return pd.DataFrame({
        "node": np.r_[u[touched_u], v[touched_v]], "links": np.r_[n_u[touched_u], n_v[touched_v]], "least": np.r_[low_u[touched_u], low_v[touched_v]],
    })


def embedding_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE,
    sample: int = SAMPLE, cell_rows: int = CELL_ROWS, most_cells: int = MOST_CELLS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors are compared when their labels are equal and not NULL. A vector that is NULL,
    empty, zero, or holds a NULL or non-finite component links with nothing, nor do vectors
    of different lengths link. Rows with equal ids are different vectors, which share what
    their id says of ``component_id``. A NULL id is passed over when a component is named; it
    is a component of its own if it has none, with ``kept`` true.

    Centroids come from at most ``sample`` vectors, taken by a hash; they only decide where
    vectors meet. Everything is assigned, and compared in double precision.
    """
    given = vectors.select(F.monotonically_increasing_id().alias("node"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"), F.col(f"`{label_col}`").cast("string").alias("label"))
    rows = stored(given, "vectors")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    usable = rows.where(F.col("x").isNotNull() & F.col("label").isNotNull() & finite).withColumn("label", F.concat_ws(":", F.size("x"), "label"))
    # Only equal labels meet, so cells are for the rows of the most frequent label.
    n = usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    cells = int(min(most_cells, max(1, n // cell_rows)))
    picked = usable.select("x").orderBy(F.xxhash64("x")).limit(sample).toArrow().column("x").to_pylist()
    by_size: dict[int, np.ndarray] = {}
    for size in sorted({len(x) for x in picked}):
        own = np.array([x for x in picked if len(x) == size], float)
        scaled = own / np.abs(own).max(axis=1, keepdims=True)
        by_size[size] = fit_cells(_unit(scaled), cells)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist()
            sizes = np.array([len(x) for x in lists], int)
            for size in np.unique(sizes):
                where = np.flatnonzero(sizes == size)
                x = np.array([lists[i] for i in where], float)
                unit = _unit(x / np.abs(x).max(axis=1, keepdims=True))
                centroids = by_size.get(int(size), unit[:0])
                centroids = centroids if len(centroids) else np.eye(1, int(size))
                for row, cell, home in cells_of(unit, centroids, cosine):
                    at = pa.array(where[row])
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(at), batch.column(1).take(at), pa.array(cell, pa.int32()), pa.array(np.full(len(row), home)),
                        pa.array([unit[i].tobytes() for i in row], pa.binary()),
                    ], names=["node", "label", "cell", "home", "vector"])

    placed = stored(usable.select("node", "label", "x").mapInArrow(assigned, "node long, label string, cell int, home boolean, vector binary"), "cells")
    sizes = placed.groupBy("label", "cell").agg(F.sum(F.col("home").cast("int")).alias("hosts"), F.sum((~F.col("home")).cast("int")).alias("guests"))
    count = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / block_rows)).cast("int")
    sizes = stored(sizes.where("hosts > 0").select("label", "cell", count("hosts").alias("nh"), count("guests").alias("ng")), "cell-sizes")
    # Blocks of a cell by a hash of the row: unit (i, j) holds home block i, and home block j or guest block j.
    spread = placed.join(sizes, ["label", "cell"]).withColumn("b", F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("nh")).otherwise(F.col("ng"))).cast("int"))
    unit_of = F.expr("""CASE WHEN home THEN concat(
            transform(sequence(b, nh - 1), j -> struct(b AS i, j AS j, 'h' AS kind, 0 AS side, b = j AS same)),
            transform(sequence(0, b), i -> struct(i AS i, b AS j, 'h' AS kind, 1 AS side, b = i AS same)),
            transform(sequence(0, ng - 1), j -> struct(b AS i, j AS j, 'g' AS kind, 0 AS side, false AS same)))
        ELSE transform(sequence(0, nh - 1), i -> struct(i AS i, b AS j, 'g' AS kind, 1 AS side, false AS same)) END""")
    units = spread.select("label", "cell", "node", "home", "vector", F.explode(unit_of).alias("u")).select("label", "cell", "u.*", "node", "home", "vector")
    found = units.groupBy("label", "cell", "kind", "i", "j").applyInPandas(lambda f: _links_of_unit(f, cosine), "node long, links long, least long")
    found = stored(found, "unit-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    labels = component_labels(found.select(F.col("node").alias("u"), F.col("least").alias("v")))
    # Rows that share an id stay different vectors; a component has the least id of its rows.
    named = rows.select("node", "vec_id").join(labels, "node", "left").join(counts, "node", "left").select("vec_id", F.coalesce("component", "node").alias("component"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    named = stored(named, "named")
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return split_join(named, least, ["component"], "inner").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
