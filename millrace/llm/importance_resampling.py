"""Importance resampling towards a target distribution.

Each text becomes a sparse row of feature counts over hash buckets. A task packs the rows of a batch into one CSR block
(row starts, buckets, counts), and the blocks are persisted. Column sums over the blocks give the raw and the target
distribution, from which every bucket gets a gain (a log-likelihood ratio); the product of the sparse matrix with the vector
of gains gives the weight of each document. Weights plus Gumbel noise that is a function of the id are ranked, and the
highest scores are a sample without replacement. Ranks come from ranges of scores that are counted one by one, so no task
sees all rows; only the number of rows in each range, and the vector of one number a bucket, reach the driver.

Defined results: null and empty texts have no feature and weight 0; a null id has noise of its own (that of the empty id)
and comes last among equal scores; rows that repeat an id are drawn as rows of their own, equal ones in any order; an empty
table gives an empty one, and with an empty target all gains follow from smoothing alone. Texts may be of any length: a
task holds one batch of texts, or one text where that is larger, and a few blocks. Other columns do not pass through, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LONG_ROWS, few_long_rows, flat_words, pieces, read_table, shuffle_width, stage_table

BUCKETS = 10_000
#: A vector of one long a bucket goes to the driver and to every task; this bounds it.
MOST_BUCKETS = 1 << 20
#: A feature is a run of 1 to so many words.
LONGEST = 1
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
#: A block holds about so many bytes of text, or one text where that is larger.
BLOCK_BYTES = 1 << 20
#: So many texts at most are read, and given to Python, at once.
TEXTS_AT_ONCE = 512
BLOCK_SCHEMA = "doc_ids array<long>, n_words array<long>, n_features array<long>, starts array<long>, buckets array<int>, counts array<int>"
#: A-Z in lower case, 0-9 and a-z and all that is not ASCII unchanged, the rest of ASCII as spaces.
_LOWERED = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def plain_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of all texts with A-Z in lower case, and offsets as of flat_words()."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2][ends[0] : ends[-1]].to_pybytes().translate(_LOWERED) if ends[-1] > ends[0] else b""
    return flat_words(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(data)))


def feature_buckets(words: pa.Array, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each feature."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    runs, owners, found = words, owner, ([], [])
    for width in range(1, longest + 1):
        if width > 1:  # a run is the one that is a word shorter, and the word after it
            inside = np.flatnonzero(owner[: -(width - 1)] == owner[width - 1 :]) if len(owner) >= width else np.zeros(0, np.int64)
            shorter = runs.take(pa.array(np.searchsorted(kept, inside) if width > 2 else inside, pa.int64()))
            last = words.take(pa.array(inside + width - 1, pa.int64()))
            runs, owners, kept = pc.binary_join_element_wise(shorter, last, pa.scalar(" ", pa.large_string())), owner[inside], inside
        coded = runs.dictionary_encode()
        of = np.fromiter((zlib.crc32(w) % buckets for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.int64, len(coded.dictionary))
        found[0].append(owners)
        found[1].append(of[coded.indices.to_numpy(zero_copy_only=False)] if len(runs) else np.zeros(0, np.int64))
    return np.concatenate(found[0]), np.concatenate(found[1])


def count_blocks(docs: DataFrame, ident: str = "doc_id", text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """CSR blocks of the document-by-bucket count matrix."""
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be between 1 and {MOST_BUCKETS}")

    def blocks(batches):
        for batch in batches:
            for part in pieces(batch, "t", BLOCK_BYTES):
                words, offsets = plain_words(part.column(1))
                owner, bucket = feature_buckets(words, offsets, longest, buckets)
                cells, counts = np.unique(owner * buckets + bucket, return_counts=True)
                rows = np.arange(part.num_rows)
                starts = np.searchsorted(cells, np.arange(part.num_rows + 1) * buckets)
                sizes = np.bincount(owner, minlength=part.num_rows)[rows]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                columns = [part.column(0), np.diff(offsets), sizes, starts, cells % buckets, counts]
                yield pa.RecordBatch.from_arrays([as_list(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_ids", "n_words", "n_features", "starts", "buckets", "counts"])

    return docs.select(F.col(ident).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(blocks, BLOCK_SCHEMA)


def as_list(values, kind: pa.DataType) -> pa.Array:
    """One list that holds all the values."""
    values = values.cast(kind) if isinstance(values, pa.Array) else pa.array(values.astype(kind.to_pandas_dtype()))
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, total) of all buckets with a feature: summed in each task first."""

    def summed(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            where, counts = (batch.column(c).flatten().to_numpy() for c in (0, 1))
            total += np.bincount(where, counts, minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "total"])

    return blocks.select("buckets", "counts").mapInArrow(summed, "bucket int, total long").groupBy("bucket").agg(F.sum("total").alias("total"))


def total_vector(sums: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The sums as a vector; its length is the parameter's, whatever the input."""
    vector = np.zeros(buckets, np.int64)
    for row in sums.collect():
        vector[row.bucket] = row.total
    return vector


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed target share to the smoothed raw share, for each bucket."""
    n, s, t = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def document_weights(blocks: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the matrix times the gains."""

    def weighed(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, words, features, starts, where, counts = (batch.column(c)[i].values for c in range(6))
                upto = np.concatenate([[0], np.cumsum(gains[where.to_numpy()] * counts.to_numpy().astype(np.int64))])
                rows = starts.to_numpy()
                yield pa.RecordBatch.from_arrays([doc_ids, words, features, pa.array(upto[rows[1:]] - upto[rows[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long")


def noisy(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """weights with score: the weight and Gumbel noise, both in thousandths, the noise a function of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return weights.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform))))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored, which is read several times, with rank: 1, 2, 3 ... for the highest scores, percent of the rows with at least least_words words; else null."""
    spark = scored.sparkSession
    fit = scored.where(F.col("n_words") >= least_words)
    by = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = fit.repartitionByRange(shuffle_width(spark), *by).sortWithinPartitions(*by)
    ranged = stage_table(ranged.select("*", F.spark_partition_id().alias("part"), place.alias("place")), "ranged")
    sizes = {r.part: r["count"] for r in ranged.groupBy("part").count().collect()}  # one number for each range
    limit, before, firsts = sum(sizes.values()) * percent // 100, 0, []
    for part in sorted(sizes):
        firsts.append((part, before))
        before += sizes[part]
    firsts = F.broadcast(spark.createDataFrame(firsts, "part int, first long"))
    rank = F.col("first") + F.col("place") + 1
    ranked = ranged.join(firsts, "part").select(*scored.columns, F.when(rank <= limit, rank).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs; target needs a column text only."""
    with few_long_rows(docs.sparkSession, TEXTS_AT_ONCE):
        blocks = stage_table(count_blocks(docs, buckets=buckets, longest=longest), "csr", **LONG_ROWS)
    wanted = count_blocks(target.withColumn("doc_id", F.lit(0)) if "doc_id" not in target.columns else target, buckets=buckets, longest=longest)
    target_sums = total_vector(column_sums(wanted, buckets), buckets)
    with few_long_rows(docs.sparkSession):
        gains = bucket_gains(total_vector(column_sums(blocks, buckets), buckets), target_sums)
        scored = stage_table(noisy(document_weights(blocks, gains), seed), "scored")
    return draw(scored, percent, least_words)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

#: DuckDB has no crc32: the table of 256 entries and the sums over bytes follow the published definition.
OP11_SQL = rf"""
with recursive bits(i, c, k) as (
  select i, i, 0 from range(256) t(i)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8
),
steps as (select list(c order by i) as steps from bits where k = 8),
raw as (select row_number() over () as r, doc_id, {_WORDS_SQL} as words from documents),
spread as (select r, unnest(words) as word from raw),
wanted as (select unnest({_WORDS_SQL}) as word from benchmark),
vocabulary as (select distinct word from (select word from spread union all select word from wanted)),
bytes as (select word, list_transform(range(0, length(hex(encode(word))) // 2), lambda j: cast('0x' || substr(hex(encode(word)), 2 * j + 1, 2) as bigint)) as b from vocabulary),
bucketed as (select word, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) % 10000 as bucket from bytes, steps),
counts as (select r, bucket, count(*) as n from spread join bucketed using (word) group by all),
raw_totals as (select bucket, sum(n) as s from counts group by bucket),
target_totals as (select bucket, count(*) as t from wanted join bucketed using (word) group by bucket),
sizes as (select (select coalesce(sum(s), 0) from raw_totals)::double as s_all, (select coalesce(sum(t), 0) from target_totals)::double as t_all),
gains as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (s_all + 10000) / ((s + 1)::double * (t_all + 10000))))::bigint as gain from raw_totals left join target_totals using (bucket), sizes),
weights as (select r, sum(n * gain)::bigint as weight from counts join gains using (bucket) group by r),
scored as (
  select r, doc_id, len(words)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8) as bigint) + 0.5::double) / 4294967296::double))))::bigint as score
  from raw left join weights using (r)
),
ranked as (select r, row_number() over (order by score desc, doc_id nulls last, n_features, weight) as place, count(*) over () as n from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= n * 10 // 100 then place end as rank from scored left join ranked using (r)
"""
