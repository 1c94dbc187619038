"""Similarity join on word shingles, by T-occurrence search with DivideSkip.

A document is the set of its distinct 5-word shingles (64-bit hashes); documents with equal sets are one class, known by
its digest. Classes link when 100 * intersection >= 80 * union. The join is exact and goes through these steps.

1. Each class sends its shingles (48 bits of them; from 200 shingles on, only those in the lower half of the hash range, SAMPLE)
   to the shingle's partition, which counts the classes that have it.
2. The counts return to the classes. A link needs 80 % of the shingles of either side, so a class with more unshared
   shingles than 20 % of its set has none; the others name their rarest shared shingles: the prefix that any partner must meet.
3. Classes that meet at a prefix shingle, with sizes that allow a link, are tied in a chain; the components of these ties
   are the blocks. No pair is ever formed here.
4. A block is searched in one task: an inverted index over its classes; for a query the longest lists are set apart and
   probed by binary search, the short ones merged, and classes that reach the overlap required by both sizes are
   linked. A class that has been reached is not looked for again, so a group of near copies costs one search.
   Blocks above BLOCK_CLASSES are dealt into parts, and each two parts are searched together.
5. Components of the links, carried from classes to documents.

Defined results: null and empty texts have no shingles and link with nothing; with fewer than 5 words the whole sequence is
the one shingle; a null doc_id is a document by itself whose component_id is null; rows that repeat an id share its
component; ties between members go to the smallest doc_id; an empty table gives an empty one. Other columns are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .line_chunks import FILTER_BITS, bit_filter
from .shared import flat_words, mix64, pack_arrays, pieces, shuffle_width, stage_table, unpack_arrays, window_hashes, word_hashes

SHINGLE = 5
#: Link at 100 * intersection >= PERCENT * union.
PERCENT = 80
#: From this many shingles on a set is judged by those below SAMPLE, half of the 64-bit range; a set whose sample is too small
#: for that is judged by all of its shingles.
SAMPLED_FROM, SAMPLE = 200, np.uint64(1 << 63)
#: Classes of a block that one task searches; a larger block is dealt into parts.
BLOCK_CLASSES = 20_000
TASK_BYTES = 12 << 20
#: Weight of a list's logarithm in DivideSkip's number of long lists.
MU = 0.0085
#: Short lists of up to so many entries together are merged by a heap, longer ones by one sort.
HEAP_POSTINGS = 2_000
META_SCHEMA = "doc_id long, n_shingles long, ident long, n_sent long, n_low long, proof long"
PART_SCHEMA = "part int, blob binary"


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Of each text its sorted distinct shingle hashes."""
    words, offsets = flat_words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = word_hashes(words)
    windows = window_hashes(hashes, SHINGLE)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(windows[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix64(window_hashes(hashes[a:b], b - a) ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def ident_of(tokens: np.ndarray) -> int:
    """The class that a set belongs to: 64 bits of a digest over all of it; groups() makes sure that unlike sets differ."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), len(tokens))).view(np.int64))


def proof_of(tokens: np.ndarray) -> int:
    """Another digest, by which two unlike sets of one class would be noticed."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes(), 1)).view(np.int64))


def sent_of(tokens: np.ndarray) -> np.ndarray:
    """The shingles that a class sends in step 1, 48 bits of each."""
    low = int(np.searchsorted(tokens, SAMPLE))
    # A partner with a large enough sample meets any set there, so only sets that both fall short have to meet elsewhere.
    sampled = len(tokens) >= SAMPLED_FROM and low > 2 * int(most_unshared(len(tokens)))
    return np.unique((tokens[:low] if sampled else tokens) >> np.uint64(16))


def below_sample(sent: np.ndarray) -> int:
    """How many of them are in the lower half of the hash range."""
    return int(np.searchsorted(sent, SAMPLE >> np.uint64(16)))


def most_unshared(n: np.ndarray) -> np.ndarray:
    """How many shingles of a set of n a partner may lack."""
    return n - (PERCENT * n + 99) // 100


def memberships(docs: DataFrame) -> DataFrame:
    """META_SCHEMA of docs (doc_id, text): n_sent and n_low are what sent_of() and below_sample() give; ident is null without shingles."""

    def measure(batches):
        for batch in batches:
            for part in pieces(batch, "text", TASK_BYTES):
                sets = shingle_sets(part.column(1))
                sent = [sent_of(s) for s in sets]
                idents = [ident_of(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(a, pa.int64()) for a in ([len(s) for s in sets], idents, [len(s) for s in sent], [below_sample(s) for s in sent], [proof_of(s) for s in sets]))],
                    ["doc_id", "n_shingles", "ident", "n_sent", "n_low", "proof"],
                )

    return docs.select("doc_id", "text").mapInArrow(measure, META_SCHEMA)


def _part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])


def _classes_of(part: pa.RecordBatch, column: int) -> dict[int, np.ndarray]:
    """The distinct classes of some texts."""
    found: dict[int, np.ndarray] = {}
    for tokens in shingle_sets(part.column(column)):
        if len(tokens) > 1:  # a single shingle links with equal sets only
            found.setdefault(ident_of(tokens), tokens)
    return found


def postings(docs: DataFrame, parts: int) -> DataFrame:
    """Step 1, sending: blobs of (48-bit shingle in two arrays, class place, classes)."""

    def send(batches):
        for batch in batches:
            for piece in pieces(batch, "text", TASK_BYTES):
                found = _classes_of(piece, 0)
                if not found:
                    continue
                ids = np.fromiter(found, np.int64, len(found))
                sent = [sent_of(t) for t in found.values()]
                tokens, place = np.concatenate(sent), np.repeat(np.arange(len(ids)), [len(s) for s in sent])
                share = (tokens % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((tokens, share))
                tokens, place, share = tokens[order], place[order], share[order]
                edges = np.searchsorted(share, np.arange(parts + 1))
                rows = []
                for p, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    if b > a:
                        used, at = np.unique(place[a:b], return_inverse=True)
                        at = at.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32)
                        t = tokens[a:b]
                        rows.append((p, pack_arrays((t >> np.uint64(32)).astype(np.uint16), (t & np.uint64(0xFFFFFFFF)).astype(np.uint32), at, ids[used])))
                yield _blobs(rows)

    return docs.select("text").mapInArrow(send, PART_SCHEMA)


def _by_part(batches):
    """(part, its blobs) of batches sorted by part."""
    held, current = [], None
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if part != current:
                if held:
                    yield current, held
                held, current = [], part
            held.append(unpack_arrays(blob))
    if held:
        yield current, held


def shared_tokens(sent: DataFrame, parts: int) -> DataFrame:
    """Step 1, counting: what classes share, as blobs by class: (shingle, number of classes, class place, classes)."""

    def count(batches):
        for _, blobs in _by_part(batches):
            tokens = np.concatenate([(b[0].astype(np.uint64) << np.uint64(32)) | b[1] for b in blobs])
            ids = np.concatenate([b[3][b[2]] for b in blobs])
            order = np.lexsort((ids, tokens))
            tokens, ids = tokens[order], ids[order]
            once = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (ids[1:] != ids[:-1])])
            tokens, ids = tokens[once], ids[once]
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            of = np.diff(np.concatenate([starts, [len(tokens)]]))
            number = np.repeat(of, of)
            many = number > 1
            tokens, ids, number = tokens[many], ids[many], number[many]
            to = _part_of(ids, parts)
            back = np.lexsort((ids, to))
            edges = np.searchsorted(to[back], np.arange(parts + 1))
            rows = []
            for p, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                if b > a:
                    k = back[a:b]
                    used, at = np.unique(ids[k], return_inverse=True)
                    rows.append((p, pack_arrays(tokens[k], number[k].astype(np.int32), at.astype(np.uint32), used)))
            if rows:
                yield _blobs(rows)

    return sent.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(count, PART_SCHEMA)


def class_facts(members: DataFrame, parts: int) -> DataFrame:
    """How many shingles each class has, and has sent, as blobs by class: (classes, three counts of each)."""

    def pack(batches):
        for batch in batches:
            ids, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            facts = np.stack([batch.column(c).to_numpy()[first] for c in (1, 2, 3)])
            to = _part_of(ids, parts)
            yield _blobs([(int(p), pack_arrays(ids[to == p], facts[:, to == p].ravel())) for p in np.unique(to)])

    return members.where("n_shingles > 1").select("ident", "n_shingles", "n_sent", "n_low").mapInArrow(pack, PART_SCHEMA)


def prefixes(shared: DataFrame, facts: DataFrame, parts: int) -> DataFrame:
    """Step 2: of each class that may have a link, the shared shingles any partner must meet: (token, ident, n)."""

    def choose(batches):
        for _, blobs in _by_part(batches):
            told = [b for b in blobs if len(b) == 2]  # by class_facts()
            blobs = [b for b in blobs if len(b) > 2]
            if not blobs:
                continue
            tokens, number = (np.concatenate([b[c] for b in blobs]) for c in (0, 1))
            ids = np.concatenate([b[3][b[2]] for b in blobs])
            order = np.lexsort((tokens, number, ids))
            tokens, ids = tokens[order], ids[order]
            inside = tokens < (SAMPLE >> np.uint64(16))
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            of = np.diff(np.concatenate([starts, [len(ids)]]))
            owner = np.repeat(np.arange(len(starts)), of)
            known, first = np.unique(np.concatenate([b[0] for b in told]), return_index=True)
            known = first[np.searchsorted(known, ids[starts])]
            sizes, counts, low = np.concatenate([b[1].reshape(3, -1) for b in told], axis=1)[:, known[owner]]
            spare = most_unshared(sizes) + 1
            # Judged by the whole set, against partners that send theirs whole.
            place = np.arange(len(ids)) - starts[owner]
            whole = ((sizes < SAMPLED_FROM) | (counts > low)) & (place < spare - (counts - of[owner]))
            # Judged by the sample, against partners that send no more, or for those who do.
            kept = np.cumsum(inside)
            before = kept - inside - (kept - inside)[starts][owner]
            inner = np.add.reduceat(inside.astype(np.int64), starts)[owner]
            sampled = inside & (100 * sizes >= PERCENT * SAMPLED_FROM) & (before < spare - (low - inner))
            take = whole | sampled
            yield pa.RecordBatch.from_arrays([pa.array(tokens[take].astype(np.int64)), pa.array(ids[take]), pa.array(sizes[take])], ["token", "ident", "n"])

    return shared.unionByName(facts).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(choose, "token long, ident long, n long")


class Forest:
    """Disjoint sets of numbers from 0."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def ties(prefix: DataFrame, parts: int) -> DataFrame:
    """Step 3: edges (a, b) that connect all classes which meet at a shingle with sizes that allow a link."""

    def chain(batches):
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.concat_tables(tables)
        token, ident, n = (table[c].to_numpy() for c in ("token", "ident", "n"))
        order = np.lexsort((ident, n, token))
        token, ident, n = token[order], ident[order], n[order]
        tied = (token[1:] == token[:-1]) & (100 * n[:-1] >= PERCENT * n[1:]) & (ident[1:] != ident[:-1])
        names, at = np.unique(ident, return_inverse=True)
        pairs = np.unique(np.sort(np.c_[at[:-1][tied], at[1:][tied]], axis=1), axis=0)
        forest = Forest(len(names))
        made = [(i, j) for i, j in pairs.tolist() if forest.join(i, j)]
        made = np.array(made, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(names[made[:, 0]]), pa.array(names[made[:, 1]])], ["a", "b"])

    return prefix.repartition(parts, "token").mapInArrow(chain, "a long, b long")


class Index:
    """Inverted lists of some sets, for T-occurrence queries."""

    def __init__(self, sets: list[np.ndarray], alive: np.ndarray):
        self.ids = np.flatnonzero(alive)
        tokens = np.concatenate([sets[i] for i in self.ids]) if len(self.ids) else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(self.ids)), [len(sets[i]) for i in self.ids])
        order = np.lexsort((owner, tokens))
        tokens, self.lists = tokens[order], owner[order]
        self.tokens, self.starts = np.unique(tokens, return_index=True)
        self.ends = np.concatenate([self.starts[1:], [len(tokens)]])
        self.sizes = np.array([len(sets[i]) for i in self.ids])

    def linked(self, query: np.ndarray) -> np.ndarray:
        """The sets that link with the query, by DivideSkip."""
        none = np.zeros(0, np.int64)
        if not len(self.tokens):
            return none
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        n = len(query)
        least = (PERCENT * n + 99) // 100  # the overlap that a partner of any size needs
        if len(at) < least:
            return none
        lengths = self.ends[at] - self.starts[at]
        order = np.argsort(lengths, kind="stable")
        at, lengths = at[order], lengths[order]
        longest = int(min(least - 1, len(at), least / (MU * np.log2(max(2, lengths[-1])) + 1)))
        short, long = at[: len(at) - longest], at[len(at) - longest :]
        lists = [self.lists[self.starts[t] : self.ends[t]] for t in short]
        if not lists:
            return none
        if sum(map(len, lists)) <= HEAP_POSTINGS:
            counted: dict[int, int] = {}
            for i in heapq.merge(*(x.tolist() for x in lists)):
                counted[i] = counted.get(i, 0) + 1
            found, count = np.fromiter(counted, np.int64, len(counted)), np.fromiter(counted.values(), np.int64, len(counted))
        else:  # the same merge of many or long lists, in one piece
            found, count = np.unique(np.concatenate(lists), return_counts=True)
        m = self.sizes[found]
        need = -(-PERCENT * (n + m) // (100 + PERCENT))
        near = (100 * m >= PERCENT * n) & (PERCENT * m <= 100 * n) & (count >= need - longest)
        found, count, need = found[near], count[near], need[near]
        for k, t in enumerate(long.tolist()):
            if not len(found):
                break
            entries = self.lists[self.starts[t] : self.ends[t]]
            i = np.minimum(np.searchsorted(entries, found), len(entries) - 1)
            count = count + (entries[i] == found)
            reach = count + (longest - 1 - k) >= need
            found, count, need = found[reach], count[reach], need[reach]
        return self.ids[found[count >= need]]


def link_block(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the sets just as all links between them would."""
    alive = np.ones(len(sets), bool)
    index, left, out = Index(sets, alive), len(sets), []
    indexed = left
    for seed in range(len(sets)):
        if not alive[seed]:
            continue
        alive[seed], left = False, left - 1
        queue = [seed]
        while queue and left:
            q = queue.pop()
            new = index.linked(sets[q])
            new = new[alive[new]]
            alive[new] = False
            left -= len(new)
            out += [(q, int(i)) for i in new]
            queue += new.tolist()
            if left * 2 < indexed and left:
                index, indexed = Index(sets, alive), left
    return out


def block_links(docs: DataFrame, blocks: DataFrame, parts: int) -> DataFrame:
    """Step 4: links (a, b) within blocks (ident, block)."""
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(blocks, "ident"))

    def send(batches):
        bits = wanted.value
        for batch in batches:
            for piece in pieces(batch, "text", TASK_BYTES):
                found = _classes_of(piece, 0)
                ids = np.fromiter(found, np.int64, len(found))
                at = ids.view(np.uint64) % np.uint64(FILTER_BITS)
                passed = ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1).tolist()
                sets = [t.tobytes() for t, p in zip(found.values(), passed, strict=True) if p]
                yield pa.RecordBatch.from_arrays([pa.array(ids[np.array(passed, bool)]), pa.array(sets, pa.binary())], ["ident", "tokens"])

    sets = docs.select("text").mapInArrow(send, "ident long, tokens binary")
    sizes = blocks.groupBy("block").agg(F.ceil(F.count("*") / F.lit(BLOCK_CLASSES)).cast("int").alias("dealt"))
    placed = blocks.join(sizes, "block").withColumn("mine", F.pmod(F.xxhash64("ident"), F.col("dealt")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("dealt") - 1)))
    placed = placed.select("ident", F.xxhash64("block", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"))
    sent = sets.join(placed, "ident")

    def search(batches):
        held: dict[int, np.ndarray] = {}
        current = None

        def done():
            ids = list(held)
            found = link_block([held[i] for i in ids])
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for task, ident, tokens in zip(*(batch.column(c).to_pylist() for c in ("task", "ident", "tokens")), strict=True):
                if task != current:
                    if len(held) > 1:
                        yield done()
                    held, current = {}, task
                if ident not in held:
                    held[ident] = np.frombuffer(tokens, np.uint64)
        if len(held) > 1:
            yield done()

    return sent.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(search, "a long, b long")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = shuffle_width(docs.sparkSession)
    members = stage_table(memberships(docs), "members")
    alike = members.where("ident is not null").groupBy("ident").agg(F.min(F.struct("proof", "n_shingles")).alias("a"), F.max(F.struct("proof", "n_shingles")).alias("b"))
    if not alike.where("a <> b").isEmpty():
        raise RuntimeError("unlike sets have one digest: change the digest's seed")
    usable = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    prefix = prefixes(shared_tokens(postings(usable, parts), parts), class_facts(members, parts), parts)
    blocks = components(ties(prefix, parts)).withColumnRenamed("node", "ident").withColumnRenamed("root", "block")
    blocks = stage_table(blocks, "blocks")
    links = components(block_links(usable, blocks, parts))
    known = members.where("doc_id is not null and ident is not null")
    first = known.groupBy("ident").agg(F.min("doc_id").alias("first_id"))
    first = first.join(links, first.ident == links.node, "left").select("ident", "first_id", F.coalesce("root", "ident").alias("root"))
    least = first.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = first.join(least, "root").select("ident", "component_id")
    out = members.join(of_class, "ident", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id; rows without an id stay."""
    found = groups(docs).where("doc_id <> component_id").select(F.col("doc_id")).distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op8_divide_skip_join(spark, sf_dir: str) -> DataFrame:
    from .shared import read_table

    return groups(read_table(spark, sf_dir, "documents"))
