"""Exact nearest neighbours by cosine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from capledger.operators.ordered import first_per_key
from capledger.sources.scratch import stored

QUERIES_AT_ONCE = 1_000  # rows of one matrix
BYTES_AT_ONCE = 32 << 20  # of all query vectors that travel with one pass
QUERY_BLOCK, VECTOR_BLOCK = 2_048, 16_384  # rows of the blocks that meet when queries are a table


def normalize_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Vectors scaled to unit length; a zero vector stays as it is."""
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    length = F.greatest(F.sqrt(square), F.lit(1e-12))
    return df.withColumn("__len", length).withColumn(
        vector, F.transform(vector, lambda x: x.cast("double") / F.col("__len"))
    ).drop("__len")


def cosine_topk(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str,
    query_id: str = "query_id", query_vector: str = "query_vector", scope: list[str] | None = None,
) -> DataFrame:
    """(scope, query_id, rank, id, similarity): the ``k`` nearest vectors of each query in each scope.

    Equal similarities are settled by id; an undefined one (a zero vector) comes last. The
    queries travel with the tasks, as many as fit into 32 MB in one pass over the vectors.
    Each task keeps ``k`` rows per scope and query of what it has read, and only those are
    shuffled. Queries with equal ids are one query with several vectors: each finds its own
    rows, which are ranked together. A vector whose length is not that of the queries fails
    the job; NULL vectors are left out.
    """
    scope = scope or []
    passes = list(_matrices(queries.select(query_id, query_vector)))
    types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    types[query_id] = queries.schema[query_id].dataType.simpleString()
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*scope, query_id, id_col]) + ", similarity double"
    out = vectors.sparkSession.createDataFrame([], schema)
    picked = vectors.select(*scope, id_col, vector).where(F.col(vector).isNotNull())
    id_type = to_arrow_type(queries.schema[query_id].dataType)
    for blocks in passes:
        named = [(pa.array(names, id_type), _unit(matrix)) for names, matrix in blocks]

        def search(batches: Iterator[pa.RecordBatch], named=named) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for names, matrix in named:
                    found = _best_of_batch(batch, matrix, names, k, id_col, vector, query_id, scope)
                    if found is not None:
                        yield found

        out = out.unionByName(picked.mapInArrow(search, schema))
    ranked = first_per_key(out, [*scope, query_id], [F.col("similarity").desc_nulls_last(), F.col(id_col)], k, "rank")
    return ranked.select(*scope, query_id, "rank", id_col, "similarity")


def _blocks(df: DataFrame, name: str, vector: str, rows: int, label: str) -> tuple[DataFrame, int]:
    """(block, names, matrix) of some ``rows`` rows each by a hash of the name, as a stored table, and how many blocks there are."""
    given = df.select(F.col(name).alias("name"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull())
    count = max(1, -(-given.count() // rows))
    # Rows of one name are alike in the hash: their vectors tell them apart.
    dealt = given.withColumn("block", F.pmod(F.xxhash64("name", "vector"), F.lit(count)).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lists, block = [], [], None

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([block], pa.int32()), pa.array([names], pa.list_(kind)), pa.array([[len(v) for v in lists]], pa.list_(pa.int32())),
                pa.array([np.array([x for v in lists for x in v], np.float64).tobytes()], pa.binary()),
            ], names=["block", "names", "sizes", "matrix"])

        for batch in batches:
            for b, n, v in zip(*[batch.column(c).to_pylist() for c in ("block", "name", "vector")], strict=True):
                if names and (b != block or len(names) >= rows):
                    yield packed()
                    names, lists = [], []
                block = b
                names.append(n)
                lists.append([np.nan if x is None else x for x in v])
        if names:
            yield packed()

    kind = to_arrow_type(given.schema["name"].dataType)
    ordered = dealt.repartition("block").sortWithinPartitions("block")
    schema = f"block int, names array<{given.schema['name'].dataType.simpleString()}>, sizes array<int>, matrix binary"
    return stored(ordered.mapInArrow(pack, schema), label), count


def cosine_topk_all(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str, query_id: str = "query_id", query_vector: str = "query_vector",
    query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK,
) -> DataFrame:
    """(query_id, rank, id, similarity): the ``k`` nearest of all vectors for any number of queries.

    Both sides are cut into blocks that are stored as tables; each block of queries meets each
    block of vectors as a product of two matrices, which passes on ``k`` rows a query, and these
    are ranked. Neither side passes the driver. Equal similarities are settled by id; an undefined
    one (a zero vector, a NULL component) comes last. NULL vectors are left out, other lengths than the query's fail the job.
    """
    asked, _ = _blocks(queries, query_id, query_vector, query_block, "query-blocks")
    held, count = _blocks(vectors, id_col, vector, vector_block, "vector-blocks")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"), F.struct("names", "sizes", "matrix").alias("asked"))
    met = held.join(sent, "block").select("names", "sizes", "matrix", F.col("asked.names").alias("q_names"), F.col("asked.sizes").alias("q_sizes"), F.col("asked.matrix").alias("q_matrix"))
    id_type, query_type = vectors.schema[id_col].dataType, queries.schema[query_id].dataType
    kinds = to_arrow_type(query_type), to_arrow_type(id_type)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                sizes = {*one["sizes"], *one["q_sizes"]}
                if len(sizes) > 1:
                    raise ValueError(f"vectors and queries of different lengths: {sorted(sizes)}")
                size = sizes.pop()
                rows = _unit(np.frombuffer(one["matrix"]).reshape(-1, size))
                yield _best_pairs(_unit(np.frombuffer(one["q_matrix"]).reshape(-1, size)), rows, one["q_names"], one["names"], k, kinds, (query_id, id_col))

    schema = f"`{query_id}` {query_type.simpleString()}, `{id_col}` {id_type.simpleString()}, similarity double"
    found = met.mapInArrow(search, schema)
    ranked = first_per_key(found, [query_id], [F.col("similarity").desc_nulls_last(), F.col(id_col)], k, "rank")
    return ranked.select(query_id, "rank", id_col, "similarity")


def _best_pairs(asked: np.ndarray, rows: np.ndarray, query_names: list, names: list, k: int, kinds: tuple, columns: tuple) -> pa.RecordBatch:
    """The ``k`` nearest rows of each query. The product of the matrices only chooses candidates: its rounding
    depends on its shape, so their similarities are summed again in a fixed order."""
    rank = np.empty(len(names), np.int64)
    rank[np.asarray(pc.sort_indices(pa.array(names, kinds[1]), null_placement="at_start"))] = np.arange(len(names))
    which, take, similarity = [], [], []
    for start in range(0, len(asked), 256):
        part = asked[start : start + 256]
        near = np.nan_to_num(part @ rows.T, nan=-2.0)
        kth = np.partition(near, len(names) - k, axis=1)[:, len(names) - k] if k < len(names) else np.full(len(part), -np.inf)
        q, r = np.nonzero(near >= (kth - 1e-9)[:, None])
        exact = (part[q] * rows[r]).sum(axis=1)
        best = np.lexsort((rank[r], np.where(np.isnan(exact), np.inf, -exact), q))
        q, r, exact = q[best], r[best], exact[best]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        which.append(q[place < k] + start)
        take.append(r[place < k])
        similarity.append(exact[place < k])
    which, take, similarity = np.concatenate(which), np.concatenate(take), np.concatenate(similarity)
    return pa.RecordBatch.from_arrays([
        pa.array(query_names, kinds[0]).take(pa.array(which)), pa.array(names, kinds[1]).take(pa.array(take)), pa.array(similarity, mask=np.isnan(similarity)),
    ], names=[*columns, "similarity"])


def _matrices(queries: DataFrame) -> Iterator[list[tuple[list, np.ndarray]]]:
    """Matrices of at most ``QUERIES_AT_ONCE`` queries, in groups of at most ``BYTES_AT_ONCE``."""
    group, names, rows, size = [], [], [], 0
    for name, row in queries.toLocalIterator():
        if rows and len(row) != len(rows[0]):
            raise ValueError(f"query {name!r} has {len(row)} components, others {len(rows[0])}")
        names.append(name)
        rows.append(row)
        size += 8 * len(row)
        if len(rows) == QUERIES_AT_ONCE or size >= BYTES_AT_ONCE:
            group.append((names, np.array(rows, dtype=np.float64)))
            names, rows = [], []
        if size >= BYTES_AT_ONCE:
            yield group
            group, size = [], 0
    if rows:
        group.append((names, np.array(rows, dtype=np.float64)))
    if group:
        yield group


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / length


def _best_of_batch(batch, matrix, names, k, id_col, vector, query_id, scope):
    n = batch.num_rows
    if n == 0:
        return None
    column = batch.column(batch.schema.get_field_index(vector))
    lengths = pc.list_value_length(column)
    if pc.any(pc.not_equal(lengths, matrix.shape[1])).as_py():
        at = pc.index(pc.not_equal(lengths, matrix.shape[1]), True).as_py()
        wrong = batch.column(batch.schema.get_field_index(id_col))[at].as_py()
        raise ValueError(f"vector {wrong!r} has {lengths[at].as_py()} components, the queries {matrix.shape[1]}")
    data = _unit(np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1))
    # A sum per row and query in a fixed order: equal vectors have equal similarities wherever they stand.
    near = np.stack([(data * q).sum(axis=1) for q in matrix], axis=1)
    group = np.zeros(n, dtype=np.int64)
    for s in scope:
        codes = batch.column(batch.schema.get_field_index(s)).dictionary_encode().indices.fill_null(-1).to_numpy()
        group = np.unique(np.stack([group, codes.astype(np.int64)]), axis=1, return_inverse=True)[1].reshape(-1)
    ids = batch.column(batch.schema.get_field_index(id_col))
    id_rank = np.empty(n, dtype=np.int64)
    id_rank[np.asarray(pc.sort_indices(ids))] = np.arange(n)
    rows, cols = [], []
    for q in range(len(names)):
        # By group, then nearest first (an undefined similarity last), then id.
        order = np.lexsort((id_rank, np.where(np.isnan(near[:, q]), np.inf, -near[:, q]), group))
        g = group[order]
        first = np.concatenate(([True], g[1:] != g[:-1]))
        place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
        kept = order[place < k]
        rows.append(kept)
        cols.append(np.full(len(kept), q))
    take, which = np.concatenate(rows), np.concatenate(cols)
    similarity = near[take, which]
    index = pa.array(take)
    arrays = [batch.column(batch.schema.get_field_index(s)).take(index) for s in scope]
    arrays.append(names.take(pa.array(which)))
    arrays.append(ids.take(index))
    arrays.append(pa.array(similarity, mask=np.isnan(similarity)))
    return pa.RecordBatch.from_arrays(arrays, names=[*scope, query_id, id_col, "similarity"])
