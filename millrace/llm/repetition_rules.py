"""Quality rules over repetition inside a text, by suffix arrays.

The words of the texts of a batch are numbered, and the suffixes of each text sorted by prefix doubling: groups of suffixes
that agree in 1, 2, 4 ... words, of which only those with more than one member are sorted on. Neighbours in the suffix array
have a longest common prefix; its intervals (runs of neighbours that share at least so many words) are the repeated
substrings that cannot be extended to the right, and those whose members are preceded by different words are maximal. The
spans of all of them are united into the covered words of a text. A text is kept unless a base rule fails, its covered
share is over COVERED, or its longest repeat has over LONGEST_REPEAT words.

Defined results: null and empty texts have no word, and fail (n_words < 20). Texts may be of any length: a task holds one
batch, or one text where that is larger, and for its words one rank for each doubling up to the longest repeat. Rows are
judged one by one, so repeated ids, null ids and repeated rows have a result each; occurrences may overlap; an empty table
gives an empty one. Extra columns pass through under any name, unless it is a result's, which is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import flat_words, free_name, pieces, read_table

#: Words that a substring has at least to count as a repeat of the method.
SHORTEST = 5
#: Of 100 words so many may be covered by repeats, and the longest repeat may have so many words.
COVERED = 45
LONGEST_REPEAT = 50
#: The base rules: width of a window, of 100 words so many in repeated windows, and the least number of words.
WINDOW = 8
REPEATED = 30
LEAST_WORDS = 20
SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "n_repeats", "longest_repeat"]


def suffix_array(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in the order of their suffixes, text by text, and for k = 0, 1 ... ranks that are equal where 2^k words are."""
    n = len(codes)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ends = offsets[owner + 1]
    keys = owner * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    levels = []
    slots, sorted_keys, width = np.arange(n), keys[order], 1
    while len(slots):
        new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        levels.append(rank.copy())
        alone = new & np.concatenate([new[1:], [True]])
        slots = slots[~alone]
        members = order[slots]
        after = np.where(members + width < ends[members], rank[np.minimum(members + width, n)].astype(np.int64) + 1, 0)
        keys = rank[members].astype(np.int64) * (n + 1) + after
        sorting = np.argsort(keys, kind="stable")
        order[slots], sorted_keys = members[sorting], keys[sorting]
        width *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], least: int) -> np.ndarray:
    """For each place of the suffix array the words that its suffix has in common with the one before, 0 if under least."""
    out = np.zeros(len(order) + 1, np.int64)
    if len(order) < 2:
        return out
    base = levels[min(max(least, 1).bit_length() - 1, len(levels) - 1)]
    at = 1 + np.flatnonzero(base[order[1:]] == base[order[:-1]])
    a, b, length = order[at - 1].astype(np.int64), order[at].astype(np.int64), np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        length += (levels[k][a + length] == levels[k][b + length]).astype(np.int64) << k
    out[at] = np.where(length >= least, length, 0)
    return out


def prefix_intervals(common: np.ndarray) -> list[tuple[int, int, int]]:
    """(words, first place, last place) of each interval of suffixes that share so many words and no neighbour does."""
    found, open_, last = [], [], -1
    at = np.flatnonzero(common)
    for k, v in zip(at.tolist(), common[at].tolist(), strict=True):
        left = k - 1
        if k != last + 1:
            found += [(words, first, last) for words, first in open_]
            open_ = []
        while open_ and open_[-1][0] > v:
            words, left = open_.pop()
            found.append((words, left, k - 1))
        if not open_ or open_[-1][0] < v:
            open_.append((v, left))
        last = k
    return found + [(words, first, last) for words, first in open_]


def maximal_repeats(codes: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeats that extend to neither side, as rows (words, first place, last place) of the suffix array; that array; and for
    each position the words of the longest repeat that starts there."""
    order, levels = suffix_array(codes, offsets)
    common = common_prefixes(order, levels, least)
    reach = np.zeros(len(codes), np.int64)
    reach[order] = np.maximum(common[:-1], common[1:]) if len(codes) else 0
    repeats = np.array(prefix_intervals(common), np.int64).reshape(-1, 3)
    before = np.where(np.isin(order, offsets), -1, codes[order - 1]) if len(codes) else codes
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    return (repeats[changes[repeats[:, 2]] > changes[repeats[:, 1]]] if len(repeats) else repeats), order, reach


def covered(reach: np.ndarray, least: int) -> np.ndarray:
    """Whether a repeat of at least so many words covers the position."""
    at = np.flatnonzero(reach >= least)
    edges = np.bincount(at, minlength=len(reach) + 1) - np.bincount(at + reach[at], minlength=len(reach) + 1)
    return np.cumsum(edges)[: len(reach)] > 0


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def symbol_counts(texts: pa.Array) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SYMBOLS.encode())] = True
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    marked = table[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if ends[-1] > ends[0] else np.zeros(0, bool)
    return per_text(marked, ends - ends[0])


def repeated_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    lines = pc.list_flatten(lists)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    filled = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
    coded = lines.filter(filled).dictionary_encode()
    owner = owner[filled.to_numpy(zero_copy_only=False)]
    distinct = np.unique(owner * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)) // max(1, len(coded.dictionary))
    return np.bincount(owner, minlength=len(texts)) - np.bincount(distinct.astype(np.int64), minlength=len(texts))


def measures(texts: pa.Array, shortest: int = SHORTEST) -> list[np.ndarray]:
    """The columns MEASURES of the texts."""
    words, offsets = flat_words(texts)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    repeats, order, reach = maximal_repeats(codes, offsets, min(shortest, WINDOW))
    repeats = repeats[repeats[:, 0] >= shortest]
    of = np.searchsorted(offsets, order[repeats[:, 1]], side="right") - 1
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, of, repeats[:, 0])
    chars = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(codes) else codes
    return [
        np.diff(offsets),
        per_text(chars, offsets),
        symbol_counts(texts),
        repeated_lines(texts),
        per_text(covered(reach, WINDOW), offsets),
        per_text(covered(reach, shortest), offsets),
        np.bincount(of, minlength=len(texts)),
        longest,
    ]


def measure(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, carry: list[str] | None = None) -> DataFrame:
    """docs with the columns MEASURES; carry: the columns that pass through (all)."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in MEASURES and (carry is None or f.name in carry)]
    names = [f.name for f in kept]
    sent = text if text in names else free_name("_text", names)

    def measured(batches):
        for batch in batches:
            for part in pieces(batch, sent):
                found = [pa.array(c.astype(np.int64)) for c in measures(part.column(part.schema.get_field_index(sent)), shortest)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *found], [*names, *MEASURES])

    schema = T.StructType([*kept, *(T.StructField(name, T.LongType()) for name in MEASURES)])
    return docs.select(*(F.col(f"`{n}`") for n in names), *([] if sent in names else [F.col(text).alias(sent)])).mapInArrow(measured, schema)


def judge(measured: DataFrame, covered_percent: int = COVERED, longest_repeat: int = LONGEST_REPEAT) -> DataFrame:
    """measured with base_failed and kept."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    fine = (100 * F.col("covered_words") <= covered_percent * F.col("n_words")) & (F.col("longest_repeat") <= longest_repeat)
    return measured.withColumns({"base_failed": failed, "kept": ~failed & fine})


def keep_unrepetitive(docs: DataFrame, covered_percent: int = COVERED, longest_repeat: int = LONGEST_REPEAT) -> DataFrame:
    """The rows of docs that the rules keep."""
    whole = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return judge(measure(whole, carry=["row"]), covered_percent, longest_repeat).where("kept").select("row.*")


def repeated_passages(docs: DataFrame, ident: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """One row for each maximal repeat: doc_id, start (the place of a first occurrence's first word), n_words, occurrences, passage."""
    columns = ["doc_id", "start", "n_words", "occurrences", "passage"]

    def listed(batches):
        for batch in batches:
            for part in pieces(batch, "t"):
                words, offsets = flat_words(part.column(1))
                codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                repeats, order, _ = maximal_repeats(codes, offsets, shortest)
                first = np.array([order[a : b + 1].min() for _, a, b in repeats.tolist()], np.int64)
                of = np.searchsorted(offsets, first, side="right") - 1
                passages = [" ".join(words.slice(p, n).to_pylist()) for p, n in zip(first.tolist(), repeats[:, 0].tolist(), strict=True)]
                values = [part.column(0).take(pa.array(of)), first - offsets[of], repeats[:, 0], repeats[:, 2] - repeats[:, 1] + 1, pa.array(passages, pa.string())]
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values], columns)

    return docs.select(F.col(ident).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(listed, "doc_id long, start long, n_words long, occurrences long, passage string")


def op12_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(measure(read_table(spark, sf_dir, "documents"), carry=["doc_id"])).select("doc_id", *MEASURES[:5], "base_failed", "kept")


def _windows(width: int) -> str:
    """SQL: (r, place) of the words that windows found twice or more in their text cover."""
    return rf"""
    select distinct r, place + j as place from (
      select r, place, count(*) over (partition by r, w) as found
      from (select r, unnest(range(1, n - {width} + 2)) as place, list_slice(words, place, place + {width - 1}) as w from split where n >= {width})
    ), range({width}) t(j) where found > 1"""


OP12_SQL = rf"""
with split as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words, len(words) as n from documents
),
by_window as (select r, count(*) as c from ({_windows(WINDOW)}) group by r),
by_repeat as (select r, count(*) as c from ({_windows(SHORTEST)}) group by r),
too_long as (
  select distinct r from (select r, unnest(range(1, n - {LONGEST_REPEAT} + 1)) as place, list_slice(words, place, place + {LONGEST_REPEAT}) as w from split where n > {LONGEST_REPEAT})
  group by r, w having count(*) > 1
),
base as (
  select r, doc_id, n::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::bigint as n_dup_lines,
    coalesce(by_window.c, 0)::bigint as n_repeat_words, coalesce(by_repeat.c, 0)::bigint as covered_words, too_long.r is not null as too_long
  from split left join by_window using (r) left join by_repeat using (r) left join too_long using (r)
),
judged as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEATED} * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 100 * covered_words <= {COVERED} * n_words and not too_long as kept from judged
"""
