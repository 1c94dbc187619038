"""Substring deduplication by super-k-mers.

Every window of WINDOW consecutive words has a minimiser, the smallest hash among its runs of MINIMISER words.
Neighbouring windows mostly share theirs, and travel together as one packed string, their super-k-mer, to the bucket which
that minimiser names: so all windows with the same words meet in one bucket, and each bucket is sorted to find, exactly,
the smallest document id of every window. Words of a window that a smaller id also has are removed.

A phrase that very many windows have would make one bucket too large. Phrases that are minimisers of more than a share of the
windows of a sample (COMMON_SHARE of them, COMMON_LEAST at least, in every SAMPLE_OF-th document by hash) are common, and a
window with such a minimiser goes by itself to the bucket that all of its words name. The sample decides which windows travel
together, never which are compared: equal windows have equal words and meet either way.

Before the exchange each task settles the windows that a smaller id of its own rows has; only the others travel, so that a
passage in a third of all documents sends its bucket one copy from each task, not one from each document. Equal hashes are
never trusted: windows are compared word by word with the one they are taken to repeat.

Defined results: null and empty texts have no words; texts under WINDOW words keep all; a null doc_id is compared with
nothing and keeps all; rows that repeat an id and differ in text are separate documents with equal ids, none of which is
smaller than the other; windows are judged on the input, so a removed window still counts against larger ids; an empty table
gives an empty one. Other columns than doc_id and text are not looked at and not passed on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import flat_words, mix64, pack_arrays, pieces, shuffle_width, unpack_arrays, window_hashes, word_hashes

WINDOW = 13
MINIMISER = 3
#: A task looks at so much text at once, and a bucket is meant to get the super-k-mers of so much input.
TASK_BYTES = 16 << 20
BUCKET_BYTES = 2 << 20
SAMPLE_OF, COMMON_SHARE, COMMON_LEAST = 64, 1 / 2048, 32
ROW_SCHEMA = "bucket int, text binary, meta binary"
RANGE_SCHEMA = "doc_id long, k long, r long"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of values[i:i + width] for each i."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs(mask: np.ndarray, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True; a run also ends where `same` changes."""
    if not mask.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    goes_on = np.zeros(len(mask), bool)
    goes_on[1:] = mask[1:] & mask[:-1]
    if same is not None:
        goes_on[1:] &= same[1:] == same[:-1]
    starts = np.flatnonzero(mask & ~goes_on)
    ends = np.flatnonzero(mask & ~np.concatenate([goes_on[1:], [False]]))
    return starts, ends - starts + 1


def repeated(at: np.ndarray, hashes: np.ndarray, ids: np.ndarray, codes: np.ndarray, width: int) -> np.ndarray:
    """Of the windows that start at `at`, those whose words a row with a smaller id has too; by sorting, then comparing."""
    out = np.zeros(len(at), bool)
    if len(at) < 2:
        return out
    order = np.argsort(hashes)
    h = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(h)]]))
    many = np.repeat(sizes > 1, sizes)
    order, sizes = order[many], sizes[sizes > 1]
    if not len(order):
        return out
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    sorted_ids = ids[order]
    least = np.repeat(np.minimum.reduceat(sorted_ids, starts), sizes)
    first = np.repeat(np.maximum.reduceat(np.where(sorted_ids == least, order, -1), starts), sizes)
    found = sorted_ids > least
    equal = np.ones(len(order), bool)
    for j in range(width):
        equal &= codes[at[order] + j] == codes[at[first] + j]
    out[order[found & equal]] = True
    if not equal.all():
        # Two different windows share a hash: their groups are settled by their words.
        odd = np.unique(np.repeat(np.arange(len(sizes)), sizes)[~equal])
        for g in odd.tolist():
            members = order[starts[g] : starts[g] + sizes[g]].tolist()
            best: dict[bytes, int] = {}
            words = {m: codes[at[m] : at[m] + width].tobytes() for m in members}
            for m in members:
                best[words[m]] = min(best.get(words[m], ids[m]), ids[m])
            for m in members:
                out[m] = ids[m] > best[words[m]]
    return out


def bucket_count(docs: DataFrame) -> int:
    """So many buckets that each gets the super-k-mers of about BUCKET_BYTES of the input's files.

    Where the input is no file Spark's estimate may be without bound: 64 buckets for each of its partitions are the most.
    """
    stored = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(shuffle_width(docs.sparkSession), min(stored // BUCKET_BYTES + 1, 64 * docs.rdd.getNumPartitions()))


def minimisers(hashes: np.ndarray, width: int) -> np.ndarray:
    """The minimiser of each window of `width` word hashes."""
    return sliding_min(window_hashes(hashes, MINIMISER), width - MINIMISER + 1)


def common_minimisers(docs: DataFrame, width: int) -> np.ndarray:
    """The minimisers of very many windows, sorted; 1 / COMMON_SHARE of them at most."""

    def count(batches):
        for batch in batches:
            for part in pieces(batch, "text", TASK_BYTES):
                words, offsets = flat_words(part.column(0))
                if len(words) < width:
                    continue
                least = minimisers(word_hashes(words), width)
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
                least = least[np.arange(len(least)) + width <= offsets[1:][doc]]
                found, n = np.unique(least, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["m", "n"])

    sample = docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64(F.lit(3), "doc_id", "k"), F.lit(SAMPLE_OF)) == 0))
    counted = sample.select("text").mapInArrow(count, "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))
    counted = counted.where(F.col("n") >= COMMON_LEAST)
    total = counted.agg(F.sum("n")).first()[0] or 0
    rows = counted.where(F.col("n") > total * COMMON_SHARE).collect()
    return np.sort(np.array([r.m for r in rows], np.int64).view(np.uint64))


def _cut(ids: np.ndarray, k: np.ndarray, texts: pa.Array, buckets: int, width: int, order_of: int, common: np.ndarray):
    """Rows (bucket, packed strings, numbers) of some documents."""
    words, offsets = flat_words(texts)
    n = len(words)
    if n < width:
        return
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    hashes = word_hashes(words)
    doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
    starts = np.arange(n - width + 1)
    whole = starts + width <= offsets[1:][doc[: len(starts)]]
    least, every = minimisers(hashes, width), window_hashes(hashes, width)
    at = np.flatnonzero(whole)
    here = np.zeros(len(starts), bool)
    here[at] = repeated(at, every[at], ids[doc[at]], codes, width)
    if len(common):
        crowded = common[np.minimum(np.searchsorted(common, least), len(common) - 1)] == least
        least[crowded] = every[crowded]
    del hashes, codes
    first = lambda s: (s - offsets[doc[s]]).astype(np.int32)

    def numbers(s: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        used, of = np.unique(doc[s], return_inverse=True)
        return [ids[used], k[used], of.astype(np.int32), first(s), length.astype(np.int32)]

    out: list[tuple[int, bytes | None, bytes]] = []
    s, length = runs(here)
    if len(s):
        out.append((int(mix64(np.array([order_of + 1]))[0] % np.uint64(buckets)), None, pack_arrays(*numbers(s, length))))
    s, length = runs(whole & ~here, least)
    bucket = (mix64(least[s]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    s, length, bucket = s[order], length[order], bucket[order]
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    packed = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), words.cast(pa.binary())), b" ")[0].as_buffer().to_pybytes()
    a, b = begins[s].tolist(), (begins[s + length + width - 1] - 1).tolist()
    del begins, sizes
    import zstandard

    edges = np.concatenate([np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), [len(bucket)]]) if len(bucket) else np.zeros(0, int)
    compress = zstandard.ZstdCompressor(level=3).compress
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        text = b"\n".join([packed[x:y] for x, y in zip(a[i:j], b[i:j], strict=True)])
        out.append((int(bucket[i]), compress(text), pack_arrays(*numbers(s[i:j], length[i:j]))))
    for i in range(0, len(out), 256):
        rows = out[i : i + 256]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["bucket", "text", "meta"])


def _ranges(ids, k, of, start, length) -> pa.RecordBatch:
    packed = (start.astype(np.int64) << 32) | length.astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(k[of]), pa.array(packed)], ["doc_id", "k", "r"])


def _settle(rows: list[tuple[bytes, bytes]], width: int):
    """The ranges of one bucket whose windows a smaller id has."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    words, _ = flat_words(pa.array([b"\n".join(expand(t) for t, _ in rows)], pa.binary()).cast(pa.string()))
    metas = [unpack_arrays(m) for _, m in rows]
    shift = np.cumsum([0] + [len(m[0]) for m in metas[:-1]])
    ids, k = (np.concatenate([m[c] for m in metas]) for c in (0, 1))
    of = np.concatenate([m[2] + d for m, d in zip(metas, shift, strict=True)])
    start, length = (np.concatenate([m[c] for m in metas]).astype(np.int64) for c in (3, 4))
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    begins = np.concatenate([[0], np.cumsum(length + width - 1)[:-1]])
    kmer = np.repeat(np.arange(len(length)), length)
    inside = np.arange(len(kmer)) - np.repeat(np.cumsum(length) - length, length)
    at = begins[kmer] + inside
    hashes = window_hashes(mix64(codes.astype(np.uint64) + np.uint64(1)), width)[at]
    found = repeated(at, hashes, ids[of[kmer]], codes, width)
    s, n = runs(found, kmer)
    return _ranges(ids, k, of[kmer[s]], start[kmer[s]] + inside[s], n)


def covered_ranges(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Rows (doc_id, k, r): r = first window * 2**32 + number of windows, for windows of `width` words that a smaller id has.

    docs has doc_id, text and k, a hash of the text.
    """
    buckets, common = bucket_count(docs), common_minimisers(docs, width)

    def cut(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            for part in pieces(batch, "text", TASK_BYTES):
                number += 1
                yield from _cut(part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2), buckets, width, number, common)

    def settle(batches):
        held, current = [], None
        for batch in batches:
            for bucket, text, meta in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != current:
                    if held:
                        yield _settle(held, width)
                    held, current = [], bucket
                if text is None:
                    yield _ranges(*unpack_arrays(meta))
                else:
                    held.append((text, meta))
        if held:
            yield _settle(held, width)

    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "k", "text").mapInArrow(cut, ROW_SCHEMA)
    parts = max(shuffle_width(docs.sparkSession), buckets // 8)
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(settle, RANGE_SCHEMA)


KEPT_SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def remove_repeats(docs: DataFrame, width: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): what is left of its words, and how many were removed."""
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.xxhash64("text").alias("k"))
    found = covered_ranges(keyed, width).groupBy("doc_id", "k").agg(F.collect_list("r").alias("rs"))
    joined = keyed.join(found, ["doc_id", "k"], "left").select("doc_id", "text", "rs")

    def keep(batches):
        for batch in batches:
            for part in pieces(batch, "text", TASK_BYTES):
                words, offsets = flat_words(part.column(1))
                counts = np.diff(offsets)
                rs = part.column(2)
                owner = np.repeat(np.arange(len(rs)), pc.fill_null(pc.list_value_length(rs), 0).to_numpy(zero_copy_only=False))
                flat = pc.list_flatten(rs).to_numpy(zero_copy_only=False)
                s = offsets[owner] + (flat >> 32)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, s, 1)
                np.add.at(edge, s + (flat & 0xFFFFFFFF) + width - 1, -1)
                kept = np.cumsum(edge)[:-1] == 0
                upto = np.concatenate([[0], np.cumsum(kept)])[offsets]
                lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), words.filter(pa.array(kept)))
                texts = pc.binary_join(lists, " ")
                shas = [hashlib.sha256(t).hexdigest() for t in texts.cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.array(counts - np.diff(upto)), texts if with_text else pa.nulls(len(rs), pa.string()), pa.array(shas)], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return joined.mapInArrow(keep, KEPT_SCHEMA)


def op3_superkmer_dedup(spark, sf_dir: str) -> DataFrame:
    from .shared import read_table

    return remove_repeats(read_table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
