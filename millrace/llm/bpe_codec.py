"""Byte-level BPE encoding and decoding with a published vocabulary.

A text is cut at its added tokens, the rest by the byte-level pattern, and each piece is merged by itself. Merging keeps a
segment tree over the pairs of neighbouring symbols: each leaf holds the rank of the pair that starts there, each inner
node the smaller (rank, place) of its children, so that the root names the leftmost pair of the lowest rank. A merge
changes at most three leaves, each renewed in logarithmic time, until the root holds no mergeable pair. Pieces recur, so
each task keeps a bounded table of finished ones.

Defined results: null and empty texts encode to no token. Texts may be of any length; a piece without a break point costs
n log n. Lone surrogates cannot occur in Spark strings. Other columns pass through, unless they bear a result's name.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import pieces

#: The published pattern of byte-level pieces (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A task forgets its finished pieces when it holds so many; only pieces of up to so many characters are kept.
TABLE_SIZE = 400_000
TABLE_CHARS = 64


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: visible Latin-1 characters stand for themselves, the others follow from 256."""
    visible = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """Ids, merges and added tokens of a tokenizer file, by bytes."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        back = {c: b for b, c in enumerate(byte_symbols())}
        raw = lambda token: bytes(back[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.of_byte = [vocab[c] for c in byte_symbols()]
        self.text_of = {i: raw(t) for t, i in vocab.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.text_of |= {i: t.encode() for t, i in self.added.items()}


def merge_piece(data: bytes, vocabulary: Vocabulary) -> list[int]:
    """The ids of one piece."""
    symbols = [vocabulary.of_byte[b] for b in data]
    n = len(symbols)
    if n < 2:
        return symbols
    merges = vocabulary.merges
    size = 1
    while size < n - 1:
        size *= 2
    # A node's value is rank * size + place; none stands for "no mergeable pair below".
    none = (len(merges) + 1) * size
    tree = [none] * (2 * size)
    for i in range(n - 1):
        if found := merges.get((symbols[i], symbols[i + 1])):
            tree[size + i] = found[0] * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def renew(place: int, value: int) -> None:
        k = size + place
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while tree[1] < none:
        i = tree[1] % size
        j = after[i]
        symbols[i] = merges[symbols[i], symbols[j]][1]
        k = after[j]
        after[i] = k
        symbols[j] = -1
        if j < n - 1:
            renew(j, none)
        if k < n:
            before[k] = i
            found = merges.get((symbols[i], symbols[k]))
            renew(i, found[0] * size + i if found else none)
        else:
            renew(i, none)
        if (h := before[i]) >= 0:
            found = merges.get((symbols[h], symbols[i]))
            renew(h, found[0] * size + h if found else none)
    return [s for s in symbols if s >= 0]


class Pieces(dict):
    """Finished pieces: text -> (decimal ids joined by commas, decoded bytes)."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, text: str) -> tuple[str, bytes]:
        ids = merge_piece(text.encode("utf-8"), self.vocabulary)
        found = ",".join(map(str, ids)), b"".join(map(self.vocabulary.text_of.__getitem__, ids))
        if len(text) <= TABLE_CHARS:
            if len(self) >= TABLE_SIZE:
                self.clear()
            self[text] = found
        return found


class Codec:
    """Encodes and decodes; one in each Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary = vocabulary
        self.find = regex.compile(PATTERN).findall
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.table = Pieces(vocabulary)

    def parts(self, text: str) -> list[tuple[str, bytes]]:
        lookup = self.table.__getitem__
        if self.special is None or not self.special.search(text):
            return list(map(lookup, self.find(text)))
        out = []
        for segment in self.special.split(text):
            if (i := self.vocabulary.added.get(segment)) is not None:
                out.append((str(i), self.vocabulary.text_of[i]))
            else:
                out += map(lookup, self.find(segment))
        return out

    def digest(self, text: str) -> tuple[str, bytes]:
        """All ids, joined by commas, and the bytes that they decode to."""
        ids, decoded = zip(*found, strict=True) if (found := self.parts(text)) else ((), ())
        return ",".join(ids), b"".join(decoded)

    def encode(self, text: str) -> list[int]:
        ids = self.digest(text)[0]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.vocabulary.text_of.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec_of(file_text: str) -> Codec:
    """The worker's codec for a tokenizer file; it outlives the task."""
    key = hashlib.sha256(file_text.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(Vocabulary(file_text))
    return _CODECS[key]


def encode(docs: DataFrame, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256, and on request the ids and the decoded text themselves."""
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary file: its size is fixed
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        added += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    kept = [f for f in docs.schema.fields if f.name not in {a.name for a in added}]
    schema, names = T.StructType([*kept, *added]), [f.name for f in kept]

    def encoded(batches):
        codec = codec_of(shared.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                for text in part.column("text").to_pylist():
                    ids, raw = codec.digest(text or "")
                    decoded = raw.decode("utf-8", "replace")
                    row = [ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                    rows.append(row + [[int(i) for i in ids.split(",")] if ids else [], decoded] if with_ids else row)
                columns = list(zip(*rows, strict=True)) or [[] for _ in added]
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], [*names, *(a.name for a in added)])

    return docs.select(*names).mapInArrow(encoded, schema)


def decode(ids: DataFrame, tokenizer_path: str, column: str = "ids", name: str = "decoded") -> DataFrame:
    """ids with the text that the array column stands for (null: empty)."""
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = ids.sparkSession.sparkContext.broadcast(file.read())
    kept = [f for f in ids.schema.fields if f.name != name]
    names = [f.name for f in kept]

    def decoded(batches):
        codec = codec_of(shared.value)
        for batch in batches:
            texts = [codec.decode(x or []) for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, name])

    return ids.select(*names).mapInArrow(decoded, T.StructType([*kept, T.StructField(name, T.StringType())]))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe_codec(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    from .shared import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, tokenizer_path or default_tokenizer()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
