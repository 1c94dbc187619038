"""Helpers that the operators of this folder have in common."""

from __future__ import annotations

import atexit
import struct
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows are taken from an Arrow batch in pieces of about so many bytes of text.
PIECE_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def free_name(name: str, *taken: list[str]) -> str:
    """A column name that none of the taken ones equals, in any letter case."""
    used = {t.lower() for names in taken for t in names}
    while name.lower() in used:
        name += "_"
    return name


def stage_table(df: DataFrame, label: str, *by: str, **options: str) -> DataFrame:
    """Write df to the shared folder, in folders by the columns by, and read it back: lineage is cut, and any executor may be
    lost afterwards. options: of the Parquet writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path, partitionBy=list(by) or None)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext

    def remove() -> None:
        try:
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended, and the folder's owner clears it
            pass

    atexit.register(remove)


@contextmanager
def few_long_rows(spark: SparkSession, at_once: int = 8):
    """Parquet is read, and Python is given, so many rows at once meanwhile: thousands of very long ones would fill a task's memory."""
    names = ["spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"]
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, str(at_once))
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


#: Options of stage_table() for tables that few_long_rows() reads: row groups of 8 MB, with their size looked at after each row.
LONG_ROWS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "8"}


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES):
    """Slices of a batch that hold about limit bytes of the named text column each."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words `[^\\x20\\x09-\\x0D]+` of all texts in order, and offsets: text i has words[offsets[i]:offsets[i + 1]]."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = pc.list_flatten(lists)
    filled = pc.greater(pc.binary_length(words), 0)
    raw = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))]).astype(np.int64)
    return words.filter(filled), upto[raw]


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct word of the array is hashed once."""
    import xxhash

    coded = words.dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    of = np.fromiter((digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return of[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of hashes[i:i + width] for each i; windows that cross a text's end are for the caller to drop."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[j : j + n]
        out ^= out >> np.uint64(29)
    return mix64(out)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; unpack_arrays() gives them back."""
    import zstandard

    head, body = [struct.pack("<I", len(arrays))], []
    for a in arrays:
        kind = a.dtype.str.encode()
        head.append(struct.pack("<B", len(kind)) + kind + struct.pack("<Q", len(a)))
        body.append(np.ascontiguousarray(a).tobytes())
    return zstandard.compress(b"".join(head + body), 1)


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    import zstandard

    data = zstandard.decompress(blob)
    (count,), at = struct.unpack_from("<I", data), 4
    shapes = []
    for _ in range(count):
        size = data[at]
        kind = data[at + 1 : at + 1 + size].decode()
        (length,) = struct.unpack_from("<Q", data, at + 1 + size)
        shapes.append((np.dtype(kind), length))
        at += 9 + size
    out = []
    for kind, length in shapes:
        out.append(np.frombuffer(data, kind, length, at))
        at += kind.itemsize * length
    return out


def sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and for each the sum of its rows of counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts, axis=0)


def train_remainder(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo modulus (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (the first is the intercept) of a ridge logistic regression, by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w += np.linalg.solve(h, z.T @ (y - p) - ridge * w)
    return mean, scale, w


def apply_logistic(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    return 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
