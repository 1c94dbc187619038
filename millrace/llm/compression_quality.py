"""Quality classifier by compression.

Two zstandard dictionaries are built, one from text labelled good and one from text labelled bad. A text is cut into
blocks, each block is compressed with either dictionary, and the sizes of all blocks are added up, so that every part of a
long text counts alike. The difference of both sums, divided by the larger, says which kind of text it resembles; a
logistic fit on other labelled rows turns that difference (with the achieved rate and the length) into a probability.

Defined results: null and empty texts get the score of an empty text (one for all of them); labels that are null, or whose
row is held out, teach nothing; an id labelled twice counts once, by its smaller label; with labels of one class only (or
none) every score is 0.5; rows that repeat an id are scored each by its text; an empty table gives an empty one. Other columns pass through untouched unless they bear the name of a result, in which case they
are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import apply_logistic, fit_logistic, free_name, pieces, train_remainder

#: At most so many labelled rows of each class feed a dictionary, and of all blocks of their whole texts so many, by lot.
DICTIONARY_ROWS = 2_000
DICTIONARY_BLOCKS = 4_096
DICTIONARY_BYTES = 64 << 10
#: At most so many other labelled rows fit the calibration.
CALIBRATION_ROWS = 12_000
BLOCK = 2_048
LEVEL = 3
#: Score from which a text is taken for good by the query, and below which the corpus stage rejects it.
GOOD = 0.7
REJECT_BELOW = 0.5


def blocks_of(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)] or [b""]


class Compressors:
    """Both dictionaries, ready to compress; made once in each task."""

    def __init__(self, dictionaries: tuple[bytes, bytes]):
        import zstandard

        self.pair = []
        for raw in dictionaries:
            data = zstandard.ZstdCompressionDict(raw)
            data.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, data: bytes) -> tuple[float, ...]:
        bad, good = (sum(len(c.compress(b)) for b in blocks_of(data)) for c in self.pair)
        n, most = len(data) + 1, max(bad, good, 1)
        difference, rate, short = (bad - good) / most, min(float(np.log(most / n)), 0.3), 1 / np.sqrt(n / 100 + 1)
        return difference, rate, rate * rate, difference * abs(difference), difference * rate, short, difference * short


FEATURES = 7


def features_of(texts: pa.Array, compressors: Compressors) -> np.ndarray:
    rows = [compressors.features((t or "").encode("utf-8", "surrogatepass")) for t in texts.to_pylist()]
    return np.array(rows, dtype=np.float64).reshape(len(rows), FEATURES)


def training_labels(labels: DataFrame, label: str, modulus: int, held: int) -> DataFrame:
    """One row (doc_id, y) for each id that may teach."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(train_remainder("doc_id", modulus) != held)
    return usable.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held: int = 2) -> tuple:
    """(both dictionaries, calibration), or None where one class has no text."""
    spark = docs.sparkSession
    teach = training_labels(labels, label, modulus, held).withColumn("h", F.xxhash64(F.lit(5), "doc_id"))
    half = F.pmod("h", F.lit(2))
    feed = teach.where(half == 0)
    feed = feed.where("y = 0").orderBy("h").limit(DICTIONARY_ROWS).unionByName(feed.where("y = 1").orderBy("h").limit(DICTIONARY_ROWS))
    texts = docs.select("doc_id", "text")
    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), 0)
    cut = texts.join(F.broadcast(feed), "doc_id").where(F.col("text") != "").select("y", F.col("h"), F.posexplode(blocks).alias("place", "block"))
    cut = cut.withColumn("lot", F.xxhash64("h", "place", "block"))
    import zstandard

    by_class: dict[int, list[bytes]] = {}
    for c in (0, 1):
        drawn = cut.where(F.col("y") == c).orderBy("lot", "block").limit(DICTIONARY_BLOCKS).collect()
        by_class[c] = [r.block.encode("utf-8", "surrogatepass") for r in sorted(drawn, key=lambda r: (r.h, r.place, r.block))]
    if not by_class[0] or not by_class[1]:
        return None
    dictionaries = tuple(_dictionary(zstandard, by_class[c]) for c in (0, 1))
    rest = teach.where(half == 1).orderBy("h").limit(CALIBRATION_ROWS).select("doc_id", "y")
    held_model = spark.sparkContext.broadcast(dictionaries)

    def measured(batches):
        compressors = Compressors(held_model.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                x = features_of(part.column(1), compressors)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    got = texts.join(F.broadcast(rest), "doc_id").select("y", "text").mapInArrow(measured, "y int, x array<double>")
    got = got.orderBy(F.xxhash64("x"), "y").limit(CALIBRATION_ROWS).collect()
    y = np.array([r.y for r in got], dtype=np.float64)
    if len(got) < 4 or y.min() == y.max():
        # Too few rows to calibrate: the difference alone decides.
        weights = np.zeros(FEATURES + 1)
        weights[1] = 20.0
        return dictionaries, (np.zeros(FEATURES), np.ones(FEATURES), weights)
    order = np.lexsort((*np.array([r.x for r in got]).T, y))
    x = np.array([r.x for r in got])[order]
    return dictionaries, fit_logistic(x, y[order])


def _dictionary(zstandard, samples: list[bytes]) -> bytes:
    """A trained dictionary; from too little text to train one, the text itself."""
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 4))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-DICTIONARY_BYTES:].ljust(8, b" ")


def score(docs: DataFrame, model: tuple | None, name: str = "score") -> DataFrame:
    """docs and a column with each text's score."""
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, T.DoubleType())])
    names = [f.name for f in kept]

    def scored(batches):
        dictionaries, calibration = shared.value
        compressors = Compressors(dictionaries)
        for batch in batches:
            for part in pieces(batch, "text"):
                p = apply_logistic(calibration, features_of(part.column("text"), compressors))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], [*names, name])

    return docs.select(*names).mapInArrow(scored, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = REJECT_BELOW) -> DataFrame:
    """The documents whose score reaches threshold, with their own columns."""
    names = docs.columns
    held = free_name("quality", names)
    return score(docs, fit(docs, labels), held).where(F.col(held) >= threshold).select(*names)


def op5_compression_quality(spark, sf_dir: str) -> DataFrame:
    from .shared import read_table

    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (train_remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
