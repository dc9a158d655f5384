"""Raw files and lake tables."""

from __future__ import annotations

import bz2
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from capledger.operators.bounded import lookup_join
from capledger.operators.rollup import observed
from capledger.sources.scratch import stored

NO_PARTITION = "<null>"
_BESIDE, _BEFORE = "__new-", "__before-"  # a table that is being written, and the one that it replaces
HEADER_BYTES = 1 << 20  # more than any header line has
WHOLE_BYTES = 32 << 20  # a file beyond this is hashed in pieces
PIECE_BYTES = 4 << 10  # so that a batch of 10,000 pieces stays small
OPEN_FILES, OPEN_BYTES = 8, 16 << 20  # of different partitions at a time in a task, and what each holds back: a row group
COMPRESSED = r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd)$"  # by such names Spark's text reader unpacks
_MARK = b"\xef\xbb\xbf"  # a byte order mark, which the text reader leaves out


def read_raw_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text, as in the file; quoted fields may hold commas and newlines.

    All files must have the same header line; a file with another one fails the job. A file
    with quoted newlines cannot be split, so it is one task: deliver large extracts as many
    files.
    """
    return spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False, multiLine=True, escape='"')


def file_hashes(spark: SparkSession, path: str | list[str], whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(path, file_path, file_name, length, file_hash, header): the SHA-256 of each file's
    bytes, and its first line.

    ``path`` opens the file, ``file_path`` is how rows read from it name it. A file of up to
    ``whole_bytes`` is held whole by one task. A larger one is read by many tasks; one task then takes its
    pieces in order, a batch at a time. A compressed file is read as it is by one task, and goes
    on in pieces as well; its first line is that of the unpacked text where Python's library can unpack it (gz, deflate, bz2).
    """
    reader = spark.read.format("binaryFile")
    packed = F.lower("path").rlike(COMPRESSED)
    listed = reader.load(path).where((F.col("length") > whole_bytes) | packed).select("path", "_metadata.file_path", "length")
    large = sorted({r["path"] for r in listed.collect()})
    found = _hashed_whole(reader.load(path).where((F.col("length") <= whole_bytes) & ~packed))
    if large:
        by_kind: dict[str | None, list[str]] = {}
        for p in large:
            kind = re.search(COMPRESSED, p.lower())
            by_kind.setdefault(kind and kind[1], []).append(p)
        hashed = reduce(DataFrame.unionByName, [_hashed_in_pieces(spark, paths, kind) for kind, paths in by_kind.items()])
        found = found.unionByName(listed.select("*", _file_name()).join(hashed, "file_path").select(*found.columns))
    return found


def _file_name() -> Column:
    return F.element_at(F.split("path", "/"), -1).alias("file_name")


def _hashed_whole(files: DataFrame) -> DataFrame:
    return files.select(
        "path", "_metadata.file_path", _file_name(), "length",
        F.sha2("content", 256).alias("file_hash"),
        F.substring_index(F.substring("content", 1, HEADER_BYTES).cast("string"), "\n", 1).alias("header"),
    )


def _hashed_in_pieces(spark: SparkSession, paths: list[str], packed: str | None = None) -> DataFrame:
    """(file_path, file_hash, header) of files that are all compressed as ``packed`` tells, or not at all.

    A line is a run of bytes up to a line feed, whatever the file holds, and the reader tells in which block it
    began. Lines are cut and joined into small pieces where they are read.
    """
    place = [F.col(f"_metadata.file_{c}").alias(f"file_{c}") for c in ("path", "size", "block_start")]
    reader = spark.read.option("lineSep", "\n")
    if packed:  # else the reader would unpack them
        reader = reader.options(**{"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec"})
        for before in ("", "org.apache.hadoop.shaded."):  # shading has renamed the option in some builds of Hadoop
            reader = reader.option(f"{before}io.compress.passthrough.extension", f".{packed}")
    lines = reader.text(paths).select(*place, F.col("value").cast("binary").alias("line"))
    pieces = lines.mapInArrow(_pieces, _PIECES)
    dealt = pieces.repartition("file_path").sortWithinPartitions("file_path", "file_block_start", "nth")
    hashed = dealt.mapInArrow(_digests, "file_path string, file_hash string, header binary")
    return hashed.withColumn("header", F.col("header").cast("string"))


_PIECES = "file_path string, file_size long, file_block_start long, nth long, piece binary"


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    path, size, start, nth, piece = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([
        pa.array(path), pa.array(size, pa.int64()), pa.array(start, pa.int64()), pa.array(nth, pa.int64()), pa.array(piece, pa.binary()),
    ], names=["file_path", "file_size", "file_block_start", "nth", "piece"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each block, every line with its line feed, in numbered pieces."""
    place, nth = None, 0
    for batch in batches:
        at = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        begin = 0
        for end in [i for i in range(1, len(at)) if at[i] != at[i - 1]] + [len(at)]:
            if at[begin] != place:
                place, nth = at[begin], 0
            whole = memoryview(b"\n".join([*batch.column(3).slice(begin, end - begin).to_pylist(), b""]))
            begin = end
            rows = [(*place, nth + i, bytes(whole[a : a + PIECE_BYTES])) for i, a in enumerate(range(0, len(whole), PIECE_BYTES))]
            nth += len(rows)
            for i in range(0, len(rows), 1_000):
                yield _piece_batch(rows[i : i + 1_000])


_UNPACK = {"gz": lambda: zlib.decompressobj(31), "deflate": zlib.decompressobj, "bz2": bz2.BZ2Decompressor}


class _Digest:
    """The hash of one file from its pieces in order. The last line was given a line feed that the file may not have."""

    def __init__(self, path: str, size: int):
        self.path, self.size, self.read, self.last, self.head = path, size, 0, b"", b""
        kind = re.search(COMPRESSED, path.lower())
        self.unpack = _UNPACK[kind[1]]() if kind and kind[1] in _UNPACK else None
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(_MARK)

    def add(self, piece: bytes) -> None:
        self.plain.update(self.last)
        self.marked.update(self.last)
        self.read, self.last = self.read + len(piece), piece
        if len(self.head) < HEADER_BYTES and b"\n" not in self.head:
            self.head += piece if self.unpack is None else self.unpacked(piece)

    def unpacked(self, piece: bytes) -> bytes:
        """The next bytes of the text; none where the file is not what its name says."""
        out, kind = b"", re.search(COMPRESSED, self.path.lower())[1]
        try:
            while piece:
                if self.unpack.eof:  # one packed part follows another
                    self.unpack = _UNPACK[kind]()
                out += self.unpack.decompress(piece, HEADER_BYTES)
                piece = self.unpack.unused_data if self.unpack.eof else b""
        except (zlib.error, OSError):
            self.unpack = _UNPACK[kind]()
        return out

    def row(self) -> pa.RecordBatch:
        for digest, mark in ((self.plain, b""), (self.marked, _MARK)):
            short = self.read + len(mark) - self.size
            if short in (0, 1):
                digest.update(self.last[: len(self.last) - short])
                head = (mark + self.head)[:HEADER_BYTES].split(b"\n", 1)[0]
                return pa.RecordBatch.from_arrays([
                    pa.array([self.path]), pa.array([digest.hexdigest()]), pa.array([head], pa.binary())], names=["file_path", "file_hash", "header"])
        raise ValueError(f"{self.path} has {self.size} bytes, and {self.read} were read")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each file. One whose length does not come out is refused, as its hash would be wrong."""
    file = None
    for batch in batches:
        for path, size, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4)), strict=True):
            if file is None or file.path != path:
                if file is not None:
                    yield file.row()
                file = _Digest(path, size)
            file.add(piece)
    if file is not None:
        yield file.row()


def with_lineage(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Stamps rows just read from files with file name, file hash, time and a row id.

    ``sources`` has file_path, file_name and file_hash of each file. The id is
    unique and not consecutive.
    """
    named = df.select("*", F.col("_metadata.file_path").alias("file_path"), F.monotonically_increasing_id().alias("_source_row_number"))
    found = lookup_join(named, sources.select("file_path", "file_name", "file_hash"), ["file_path"])
    return found.select(
        *[f"`{c}`" for c in df.columns],
        F.col("file_name").alias("_source_file"),
        F.col("file_hash").alias("_source_file_hash"),
        F.current_timestamp().alias("_ingested_at"),
        "_source_row_number",
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, merge: bool = True) -> DataFrame | None:
    """A lake table, or None where there is none yet; without ``schema`` with the columns of
    all its files, or of any one of them where ``merge`` is off, which does not open them all.

    Pass the schema of tables partitioned by text: partition values are otherwise
    read as numbers or dates where they look like them.
    """
    if not _exists(spark, path):
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.option("mergeSchema", merge and schema is None).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":
            return None
        raise


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table; one that a stopped writer has put aside is put back."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(where):
        return True
    aside = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}{_BEFORE}*"))
    if aside is None or not len(aside):
        return False
    return files.rename(aside[0].getPath(), where)


def write_table(
    df: DataFrame, path: str, by: list[str] | None = None, options: dict[str, str] | None = None,
    finish: Callable[[str], None] | None = None,
) -> None:
    """Replaces the whole table once the new one stands.

    The new table is written beside the old one, which goes on being read; a write that fails leaves it
    as it is. Then the two change places: the moment between two renames is the only one without a
    table, and who finds it so puts the old one back (see ``read_table``). On stores without renames of folders a rename copies.
    ``finish`` is called with the new table's path before that, to put something into its folder that changes place with it.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    beside = f"{path}{_BESIDE}{uuid.uuid4().hex}"
    new, old, at = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (beside, f"{path}{_BEFORE}{uuid.uuid4().hex}", path))
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    writer = df.write.mode("error").options(**options or {})
    try:
        (writer.partitionBy(*by) if by else writer).parquet(beside)
        if finish is not None:
            finish(beside)
    except Exception:
        files.delete(new, True)
        raise
    if _exists(spark, path):
        _renamed(files, at, old)
    _renamed(files, new, at)
    files.delete(old, True)
    spark.catalog.refreshByPath(path)


def _renamed(files, a, b) -> None:
    if not files.rename(a, b):
        raise OSError(f"{a.toString()} could not be renamed to {b.toString()}")


def overwrite_partitions(df: DataFrame, path: str, by: list[str], options: dict[str, str] | None = None) -> None:
    """Replaces only the partitions that occur in ``df``, the NULL one included.

    Parquet swaps partitions one by one; readers may see some new and some old. New files are written aside
    and swapped at the end, so ``df`` may read from the table.
    """
    writer = df.write.mode("overwrite").options(**{"parquet.block.size": str(OPEN_BYTES)} | (options or {})).option("partitionOverwriteMode", "dynamic")
    with unsorted_writes(df.sparkSession):
        writer.partitionBy(*by).parquet(path)


@contextmanager
def unsorted_writes(spark: SparkSession) -> Iterator[None]:
    """Tasks that write to few partitions do so as rows come, instead of sorting whole rows by partition first; a task
    that meets more than ``OPEN_FILES`` partitions sorts what is left. What was shuffled for the write is deleted after it."""
    wanted = {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def replace_partitions(df: DataFrame, path: str, by: str, values: list[int]) -> None:
    """Replaces exactly the partitions of ``values``; one without a row in ``df`` is removed.

    ``df`` may read from the table, see ``overwrite_partitions``. A row of another partition fails the job before any is replaced.
    """
    spark = df.sparkSession
    other = F.raise_error(F.concat(F.lit("rows of other partitions: "), F.coalesce(F.col(by).cast("string"), F.lit(NO_PARTITION))))
    checked = df.withColumn(by, F.when(F.col(by).isin(values), F.col(by)).otherwise(other).cast(df.schema[by].dataType))
    counted, seen = observed(checked, "replaced", filled=F.collect_set(by))
    overwrite_partitions(counted, path, [by])
    for value in set(values) - set(seen.get["filled"]):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def batch_partitions(df: DataFrame, column: str) -> DataFrame:
    """The partition values of a batch, with a marker for rows that have none."""
    return df.select(F.coalesce(F.col(column).cast("string"), F.lit(NO_PARTITION)).alias(column)).distinct()


def already_loaded(table: DataFrame | None, column: str, value: str) -> bool:
    """Whether any row still carries this hash or fingerprint."""
    return table is not None and not table.where(F.col(column) == value).limit(1).isEmpty()


def not_loaded(files: DataFrame, table: DataFrame, file_hash: str, table_hash: str) -> DataFrame:
    """The files whose hash is nowhere in ``table``."""
    seen = table.select(F.col(table_hash).alias(file_hash)).where(F.col(file_hash).isNotNull()).distinct()
    return files.join(seen, file_hash, "left_anti")


def rows_of(table: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of ``table`` that came from ``files``."""
    hashes = files.select(F.col("file_hash").alias("_source_file_hash")).distinct()
    return lookup_join(table, hashes, ["_source_file_hash"], "left_semi")


def write_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Full reload of a database table that keeps its definition and indexes."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("truncate", "true").options(
        **options
    ).mode("overwrite").save()


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options).load()


def read_facts(facts: DataFrame, jurisdiction: str, active: DataFrame | None = None) -> DataFrame:
    """Facts of one jurisdiction, from active document versions only when those are given.

    The filter is a plain comparison, so Parquet and JDBC scans apply it themselves.
    """
    scoped = facts.where(F.col("jurisdiction") == jurisdiction)
    if active is None:
        return scoped
    return lookup_join(scoped, active.where("active_flag").select("rag_id").distinct(), ["rag_id"], "left_semi")
