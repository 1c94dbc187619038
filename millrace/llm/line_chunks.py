"""Line deduplication by content-defined chunks of lines.

Each line is hashed; a rolling hash over the last ROLL line hashes ends a chunk wherever it is 0 modulo MODULUS (or after
LONGEST lines), so that lines put in or left out move only the chunk boundaries beside them. A chunk of two or more lines
with text that occurs more than once in the corpus stays at its first place, by (doc_id, place), and goes everywhere else.
Chunks with equal 128-bit hashes are compared byte by byte (they are grouped by their bytes) before any goes.

Defined results: lines end at "\\n"; null and empty texts have one empty line and stay as they are; a null doc_id is neither
compared nor changed; rows that repeat id and text are alike and both keep what the first of them keeps; a chunk without
two non-blank lines is never removed; a text whose chunks all go becomes empty; an empty table gives an empty one. Extra
columns pass through under any name, unless it is a result's (n_lines, n_removed), which is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, mix64, pieces, stage_table, word_hashes

ROLL = 2
MODULUS = 4
LONGEST = 12
#: Bits of the filter that keeps once-only chunks from travelling; its size is fixed, and a full one only costs time.
FILTER_BITS = 1 << 26
CHUNK_SCHEMA = "doc_id long, k long, place int, h1 long, h2 long"
TEXT_SCHEMA = "doc_id long, k long, place int, h1 long, h2 long, bytes binary"


def chunk_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first line in the text, lines, non-blank lines) of each chunk of the texts, in order."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines = pc.list_flatten(lists)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(owner)) - offsets[owner]
    h = word_hashes(lines)
    rolled = h.copy()
    for j in range(1, ROLL):
        back = place >= j
        rolled[back] = rolled[back] * np.uint64(0x9E3779B97F4A7C15) + h[np.flatnonzero(back) - j]
    ends = mix64(rolled) % np.uint64(MODULUS) == 0
    starts = np.concatenate([[True], ends[:-1]]) | (place == 0)
    # Over-long chunks are cut every LONGEST lines from where they start.
    begun = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))
    starts |= (np.arange(len(starts)) - begun) % LONGEST == 0
    first = np.flatnonzero(starts)
    filled = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    sizes = np.diff(np.concatenate([first, [len(starts)]]))
    return owner[first], place[first], sizes, np.add.reduceat(filled.astype(np.int64), first)


def chunk_bytes(texts: list, owner: np.ndarray, lines: np.ndarray):
    """Per text, the bytes of its chunks."""
    ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
    for i, text in enumerate(texts):
        parts = (text or "").encode("utf-8").split(b"\n")
        out, at = [], 0
        for n in lines[ends[i - 1] if i else 0 : ends[i]].tolist():
            out.append(b"\n".join(parts[at : at + n]))
            at += n
        yield out


def _chunks(docs: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """Rows of chunks that may be removed; with a filter, only those it lets through, and their bytes."""
    held = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def cut(batches):
        import xxhash

        bits = None if held is None else held.value
        for batch in batches:
            for part in pieces(batch, "text"):
                owner, _, lines, filled = chunk_lines(part.column(2))
                place = np.arange(len(owner)) - np.searchsorted(owner, owner)
                data = [c for cs in chunk_bytes(part.column(2).to_pylist(), owner, lines) for c in cs]
                many = np.flatnonzero(filled >= 2)
                digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[i]) for i in many.tolist()]), ">u8").astype(np.uint64).reshape(-1, 2)
                if bits is not None:
                    at = digest[:, 0] % np.uint64(FILTER_BITS)
                    passed = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    many, digest = many[passed], digest[passed]
                own = owner[many]
                columns = [part.column(0).take(pa.array(own)), part.column(1).take(pa.array(own)), pa.array(place[many], pa.int32()), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64))]
                names = ["doc_id", "k", "place", "h1", "h2"]
                if bits is not None:
                    columns.append(pa.array([data[i] for i in many.tolist()], pa.binary()))
                    names.append("bytes")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "k", "text").mapInArrow(cut, CHUNK_SCHEMA if wanted is None else TEXT_SCHEMA)


def bit_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """Which of FILTER_BITS remainders of an unsigned 64-bit hash occur, as packed bits; made by a bitmap aggregate."""
    place = F.pmod(F.col(column), F.lit(FILTER_BITS))  # FILTER_BITS is a power of 2: signed and unsigned remainders agree
    rows = hashes.select((place / 32768).cast("int").alias("part"), (place % 32768).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        out[r.part * 4096 : r.part * 4096 + 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, k, place) of the chunks to remove; docs has doc_id, k (a hash of the text) and text."""
    counted = _chunks(docs).groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    found = stage_table(_chunks(docs, bit_filter(counted, "h1")), "chunks")
    # Grouping by the bytes themselves is the byte comparison; partial minima leave one row for each task and chunk. A chunk
    # that occurs once is its own first place, so all but the first places go, and no join meets by the chunk.
    places = ["doc_id", "k", "place"]
    first = found.groupBy("h1", "h2", "bytes").agg(F.min(F.struct(*places)).alias("first")).select("first.*")
    return found.select(*places).join(first, places, "left_anti")


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with their texts rid of repeated chunks, and n_lines, n_removed."""
    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]
    kept = [f for f in docs.schema.fields if f.name not in {a.name for a in added}]
    names = [f.name for f in kept]
    usable = docs.where(F.col("doc_id").isNotNull() & F.contains("text", F.lit("\n"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k"), "text")
    # The other columns may bear any name: they travel together, beside names that are this function's own.
    gone = repeated_chunks(usable).groupBy("doc_id", "k").agg(F.collect_set("place").alias("gone"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k"), F.struct(*names).alias("row"))
    lost_in = free_name("gone", names)
    joined = keyed.join(gone, ["doc_id", "k"], "left").select("row.*", F.col("gone").alias(lost_in))

    def remove(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column("text").to_pylist()
                owner, _, lines, _ = chunk_lines(part.column("text"))
                starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
                total = np.bincount(owner, lines, len(texts)).astype(np.int64)
                lost = np.zeros(len(texts), np.int64)
                for i, out in enumerate(part.column(lost_in).to_pylist()):
                    if out:
                        away = set(out)
                        of = lines[starts[i] : starts[i + 1]]
                        data = next(chunk_bytes([texts[i]], np.zeros(len(of), np.int64), of))
                        texts[i] = b"\n".join([c for j, c in enumerate(data) if j not in away]).decode("utf-8")
                        lost[i] = sum(int(of[j]) for j in away)
                columns = [pa.array(texts, pa.string()) if n == "text" else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total), pa.array(lost)], [*names, "n_lines", "n_removed"])

    return joined.mapInArrow(remove, T.StructType([*kept, *added]))


def op6_line_chunks(spark, sf_dir: str) -> DataFrame:
    from .shared import read_table

    done = remove_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
