"""Toxicity by class-conditional Kneser-Ney models.

A word is spelt by a byte n-gram model, from a start mark to an end mark. Each class (ordinary, toxic) has its own counts
of the longest n-grams, 8 bytes of context and byte together, from labelled rows; what a class has seen seldom or never is
smoothed by one shared backoff model, a Kneser-Ney model of shorter n-grams (5 bytes and down to 1) whose counts cover
every document of the corpus, labelled or not. All of them are counted, by shares of the n-grams; since both classes back
off alike after a context that neither knows, which then is no evidence, only what follows the classes' contexts is
gathered, with its full counts. A word's evidence is the difference of its two log-likelihoods; a text's
evidence is that, normalised by the number of words, together with how far its strongest words stand out. A logistic fit
over labelled rows makes it a probability.

Words are the runs `[^\\x20\\x09-\\x0D]+`, with A-Z lower-cased and punctuation at either end left out. Every word of a text
counts, and every byte of a word.

Defined results: null and empty texts get the score of a text without words; null labels and held-out rows teach nothing;
an id labelled twice counts once, by its larger label; with labels of one class only (or none) every score is 0.5; rows that
repeat an id are scored each by its text; an empty table gives an empty one; other columns pass through, unless they bear the
score's name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import apply_logistic, fit_logistic, flat_words, pack_arrays, pieces, shuffle_width, sum_by_key, train_remainder, unpack_arrays

#: Bytes of the longest n-gram of a class (it fills a 64-bit key), and of the shared backoff model.
ORDER = 8
SHARED_ORDER = 5
DISCOUNT = 0.75
#: A class learns from at most so many labelled rows; the calibration from so many other rows.
CLASS_ROWS = 8_000
CALIBRATION_ROWS = 8_000
TOXIC = 0.7
START, END = 1, 2
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the word number of each occurrence, offsets of the texts)."""
    words, offsets = flat_words(texts)
    coded = words.dictionary_encode()
    plain = pc.ascii_trim(pc.ascii_lower(coded.dictionary.cast(pa.string())), characters=_PUNCTUATION)
    again = plain.dictionary_encode()
    return again.dictionary, again.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)], offsets


def spell(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all words, each between a start and an end mark; where each word starts, and the end of the last)."""
    raw = words.cast(pa.binary())
    sizes = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 2)])
    out = np.empty(starts[-1], np.uint8)
    body = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    inside = np.ones(len(out), bool)
    inside[starts[:-1]] = False
    inside[starts[1:] - 1] = False
    out[inside] = body
    out[starts[:-1]] = START
    out[starts[1:] - 1] = END
    return out, starts


def grams(data: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte after a word's start mark (fewer bytes near the start), and its word's number.

    An n-gram is its bytes in a 64-bit key, the last byte lowest; bytes before the start mark are 0.
    """
    word = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    place = np.arange(len(data)) - starts[word]
    keys = data.astype(np.uint64)
    for k in range(1, order):
        reach = place >= k
        keys[reach] |= data[np.flatnonzero(reach) - k].astype(np.uint64) << np.uint64(8 * k)
    inner = place > 0
    return keys[inner], word[inner]


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and which of them are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Level:
    """Counts of n-grams with their contexts' totals and numbers of continuations."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts.astype(np.float64)
        context = keys >> np.uint64(8)
        self.contexts, both = sum_by_key(context, np.c_[self.counts, np.ones_like(self.counts)])
        self.totals, self.kinds = (both[:, 0], both[:, 1]) if len(both) else (np.zeros(0), np.zeros(0))

    def blend(self, keys: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Interpolated probabilities: the lower ones stand wherever a context is unknown."""
        at, known = find(self.contexts, keys >> np.uint64(8))
        if not known.any():
            return lower
        i, seen = find(self.keys, keys)
        count = np.where(seen, self.counts[i], 0.0)
        total, kinds = self.totals[at], self.kinds[at]
        return np.where(known, (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds * lower) / np.maximum(total, 1), lower)


class Model:
    """The shared backoff model and both classes' counts on top of it."""

    def __init__(self, shared: list[tuple[np.ndarray, np.ndarray]], classes: list[tuple[np.ndarray, np.ndarray]]):
        self.shared = [Level(*level) for level in shared]
        self.classes = [Level(*c) for c in classes]
        # The two shortest orders are worked out once, for every pair of bytes.
        pairs = np.arange(1 << 16, dtype=np.uint64)
        self.short = np.full(len(pairs), 1 / 256)
        for order, level in enumerate(self.shared[:2], 1):
            self.short = level.blend(pairs & np.uint64((1 << (8 * order)) - 1), self.short)

    def evidence(self, words: pa.Array) -> np.ndarray:
        """Of each word, how much likelier the toxic model finds it, as a difference of logarithms."""
        if not len(words):
            return np.zeros(0)
        data, starts = spell(words)
        keys, word = grams(data, starts, ORDER)
        keys, place = np.unique(keys, return_inverse=True)
        lower = self.short[(keys & np.uint64(0xFFFF)).astype(np.int64)]
        for order, level in enumerate(self.shared[2:], 3):
            lower = level.blend(keys & np.uint64((1 << (8 * order)) - 1), lower)
        plain, toxic = (level.blend(keys, lower) for level in self.classes)
        return np.bincount(word, (np.log(toxic) - np.log(plain))[place], len(words))


FEATURES = 6


def features_of(texts: pa.Array, model: Model) -> np.ndarray:
    words, codes, offsets = words_of(texts)
    each = model.evidence(words)[codes]
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)
    per = lambda v: np.bincount(text, v, len(n)) / np.maximum(n, 1)
    mean, beyond, far = per(each), per(np.maximum(each - 1, 0)), per(np.maximum(each - 3, 0))
    order = np.lexsort((-each, text))
    place = np.arange(len(each)) - offsets[:-1][text]
    first3 = place < 3
    top = np.bincount(text[order][first3], each[order][first3], len(n)) / np.maximum(np.minimum(n, 3), 1)
    return np.c_[mean, np.sqrt(beyond), np.sqrt(far), top, np.log1p(n), top * np.sqrt(far)]


def _merged(df: DataFrame, parts: int, columns: int) -> DataFrame:
    """Rows (part, blob of keys and counts) with the blobs of a part added up; each part is a share of the keys."""

    def merge(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = unpack_arrays(blob)
                counts = counts.reshape(len(keys), columns)
                if part in held:
                    keys, counts = np.concatenate([held[part][0], keys]), np.concatenate([held[part][1], counts])
                held[part] = sum_by_key(keys, counts)
        for part, (keys, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack_arrays(keys, counts.ravel())], pa.binary())], ["part", "blob"])

    return df.repartition(parts, "part").mapInArrow(merge, "part int, blob binary")


def _parted(keys: np.ndarray, counts: np.ndarray, parts: int, by: np.ndarray | None = None):
    """Shares of a table by key, or by another number of each row, as rows (part, blob)."""
    from .shared import mix64

    share = (mix64(keys if by is None else by) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(share, kind="stable")
    ends = np.searchsorted(share[order], np.arange(parts + 1))
    rows = [(p, pack_arrays(keys[order[a:b]], counts[order[a:b]].ravel())) for p, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])


def shorter(keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of order bytes that keys end in, and their continuation counts: in how many of keys each one ends."""
    ends = keys & np.uint64((1 << (8 * order)) - 1)
    return sum_by_key(ends, np.ones(len(ends), np.int64))


def shared_counts(docs: DataFrame, classes: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of 1 to SHARED_ORDER bytes that follow a context of a class, with their counts over every text.

    A share holds all n-grams with the same two bytes before the last, so the counts down to 3 bytes are whole in it. Those
    of 2 bytes are added up over the shares, and there are 65,536 at most.
    """
    spark = docs.sparkSession
    parts = shuffle_width(spark)
    contexts = np.unique(np.concatenate([keys for keys, _ in classes]) >> np.uint64(8))
    known = spark.sparkContext.broadcast({n: np.unique(contexts & np.uint64((1 << (8 * (n - 1))) - 1)) for n in range(3, SHARED_ORDER + 1)})

    def count(batches):
        table = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                words, codes, _ = words_of(part.column(0))
                keys, word = grams(*spell(words), SHARED_ORDER)
                k, c = sum_by_key(keys, np.bincount(codes, minlength=len(words))[word])
                table = sum_by_key(np.concatenate([table[0], k]), np.concatenate([table[1], c]))
        yield _parted(*table, parts, (table[0] >> np.uint64(8)) & np.uint64(0xFFFF))

    def wanted(batches):
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                keys, counts = unpack_arrays(blob)
                levels = []
                for order in range(SHARED_ORDER, 2, -1):
                    follows = find(known.value[order], keys >> np.uint64(8))[1]
                    levels.append((order, keys[follows], counts[follows]))
                    keys, counts = shorter(keys, order - 1)
                levels.append((2, keys, counts))
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _, _ in levels], pa.int32()), pa.array([pack_arrays(k, c) for _, k, c in levels], pa.binary())], ["part", "blob"])

    rows = _merged(docs.select("text").mapInArrow(count, "part int, blob binary"), parts, 1).mapInArrow(wanted, "part int, blob binary").collect()
    found = {n: _table([r for r in rows if r.part == n], 1) for n in range(2, SHARED_ORDER + 1)}
    found[2] = sum_by_key(*found[2])
    found[1] = shorter(found[2][0], 1)
    return [found[n] for n in range(1, SHARED_ORDER + 1)]


def _table(rows: list, columns: int) -> tuple[np.ndarray, np.ndarray]:
    found = [unpack_arrays(r.blob) for r in rows]
    keys = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
    counts = np.concatenate([f[1].reshape(-1, columns) for f in found]) if found else np.zeros((0, columns), np.int64)
    order = np.argsort(keys)
    counts = counts[order]
    return keys[order], counts[:, 0] if columns == 1 else counts


def class_counts(docs: DataFrame, rows: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each class, its n-grams and their counts, from a bounded table of rows (doc_id, y)."""
    parts = shuffle_width(docs.sparkSession)

    def count(batches):
        table = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                words, codes, offsets = words_of(part.column(1))
                y = np.repeat(part.column(0).to_numpy(zero_copy_only=False), np.diff(offsets))
                per_word = np.stack([np.bincount(codes[y == c], minlength=len(words)) for c in (0, 1)], 1)
                keys, word = grams(*spell(words), ORDER)
                k, c = sum_by_key(keys, per_word[word])
                table = sum_by_key(np.concatenate([table[0], k]), np.concatenate([table[1], c]))
        yield _parted(*table, parts)

    teach = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("y", "text")
    keys, both = _table(_merged(teach.mapInArrow(count, "part int, blob binary"), parts, 2).collect(), 2)
    return [(keys[both[:, c] > 0], both[both[:, c] > 0, c]) for c in (0, 1)]


def training_labels(labels: DataFrame, label: str, modulus: int, held: int) -> DataFrame:
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(train_remainder("doc_id", modulus) != held)
    return usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held: int = 1) -> tuple | None:
    """(shared counts, counts of both classes, calibration), or None where a class has no rows."""
    spark = docs.sparkSession
    teach = training_labels(labels, label, modulus, held).withColumn("h", F.xxhash64(F.lit(7), "doc_id"))
    use = F.pmod("h", F.lit(4))
    feed = teach.where(use != 0)
    feed = feed.where("y = 0").orderBy("h").limit(CLASS_ROWS).unionByName(feed.where("y = 1").orderBy("h").limit(CLASS_ROWS)).select("doc_id", "y")
    classes = class_counts(docs, feed)
    if not len(classes[0][0]) or not len(classes[1][0]):
        return None
    counts = spark.sparkContext.broadcast((shared_counts(docs, classes), classes))
    rest = teach.where(use == 0).orderBy("h").limit(CALIBRATION_ROWS).select("doc_id", "y")

    def measured(batches):
        model = Model(*counts.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(features_of(part.column(1), model)), pa.list_(pa.float64()))], ["y", "x"])

    got = docs.select("doc_id", "text").join(F.broadcast(rest), "doc_id").select("y", "text").mapInArrow(measured, "y int, x array<double>").collect()
    y = np.array([r.y for r in got], dtype=np.float64)
    if len(got) < 4 or y.min() == y.max():
        weights = np.zeros(FEATURES + 1)
        weights[4] = 1.0  # too few rows to calibrate: the strongest words decide
        return counts, (np.full(FEATURES, 0.0), np.ones(FEATURES), weights)
    x = np.array([r.x for r in got])
    order = np.lexsort((*x.T, y))
    return counts, fit_logistic(x[order], y[order])


def score(docs: DataFrame, model: tuple | None, name: str = "score") -> DataFrame:
    """docs and a column with each text's score."""
    if model is None:
        return docs.withColumn(name, F.lit(0.5))
    counts, calibration = model
    kept = [f for f in docs.schema.fields if f.name != name]
    names = [f.name for f in kept]

    def scored(batches):
        held = Model(*counts.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                p = apply_logistic(calibration, features_of(part.column("text"), held))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], [*names, name])

    return docs.select(*names).mapInArrow(scored, T.StructType([*kept, T.StructField(name, T.DoubleType())]))


def op7_kneser_ney_toxicity(spark, sf_dir: str) -> DataFrame:
    from .shared import read_table

    docs, labels = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (train_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
