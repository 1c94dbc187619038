"""Operators with an exact result, against brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe_codec, divide_skip_join, line_chunks, superkmer_dedup, warc_chunks
from millrace.llm.components import components

from .helpers import WORD, corpus, frame


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


def test_substring_dedup(spark, docs):
    rows = sorted((r for r in corpus() if r[0] is not None), key=lambda r: r[0])
    first, expected = {}, {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone[j : j + 13] = [True] * 13
        expected[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in superkmer_dedup.remove_repeats(docs).collect()}
    assert got.pop(None)[1] == 0
    assert got == expected and any(v[1] for v in expected.values())


def test_windows_with_equal_hashes_are_told_apart():
    import numpy as np

    at, codes = np.array([0, 2, 4]), np.array([1, 2, 1, 3, 1, 2])
    found = superkmer_dedup.repeated(at, np.zeros(3, np.uint64), np.array([5, 6, 7]), codes, 2)
    assert found.tolist() == [False, False, True]


def test_common_minimisers_change_no_result(spark, docs, monkeypatch):
    rows = [(100 + i, f"{i} of the same old words we find in each and every text here {i % 3} and then {i % 5} more of it") for i in range(60)]
    more = docs.select("doc_id", "text").unionByName(frame(spark, rows).select("doc_id", "text"))
    before = sorted(map(str, superkmer_dedup.remove_repeats(more).collect()))
    monkeypatch.setattr(superkmer_dedup, "SAMPLE_OF", 1)
    monkeypatch.setattr(superkmer_dedup, "COMMON_LEAST", 2)
    monkeypatch.setattr(superkmer_dedup, "COMMON_SHARE", 1 / 300)
    keyed = more.withColumn("k", F.xxhash64("text"))
    assert len(superkmer_dedup.common_minimisers(keyed, 13)) > 1
    assert sorted(map(str, superkmer_dedup.remove_repeats(more).collect())) == before


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    index = defaultdict(list)
    for i in sorted(sets):
        seen = Counter(j for s in sets[i] for j in index[s])
        for s in sets[i]:
            index[s].append(i)
        for j, k in seen.items():
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_similarity_groups(spark, docs):
    expected = brute_groups([r for r in corpus() if r[0] is not None])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in divide_skip_join.groups(docs).collect()}
    assert got.pop(None)[1] is None
    assert got == expected and any(v[1] != i for i, v in expected.items())


def test_similarity_groups_in_dealt_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(divide_skip_join, "BLOCK_CLASSES", 2)
    chain = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(chain[: 40 - i] + [f"x{i}{j}" for j in range(i)])) for i in range(9)] + [(100 + i, " ".join([*chain, f"y{i}"])) for i in range(7)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in divide_skip_join.groups(frame(spark, rows)).collect()}
    assert got == brute_groups(rows)


@pytest.mark.parametrize("postings", [0, 1 << 30])
def test_either_merge_finds_the_same_links(monkeypatch, postings):
    import numpy as np

    monkeypatch.setattr(divide_skip_join, "HEAP_POSTINGS", postings)
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 60, 400).astype(np.uint64))
    sets = [np.sort(rng.permutation(base)[: rng.integers(300, 380)]) for _ in range(40)] + [np.unique(rng.integers(0, 1 << 60, 50).astype(np.uint64)) for _ in range(5)]
    index = divide_skip_join.Index(sets, np.ones(len(sets), bool))
    for q in sets:
        size = lambda s, q=q: len(np.intersect1d(s, q))
        expected = [i for i, s in enumerate(sets) if 100 * size(s) >= 80 * (len(s) + len(q) - size(s))]
        assert sorted(index.linked(q).tolist()) == expected and len(expected) < 45


def test_sets_with_a_small_sample_are_sent_whole(spark):
    import numpy as np

    import pyarrow as pa

    # A text all of whose shingles are in the upper half of the hash range, so that its sample is empty.
    words = ["w0", "w1", "w2", "w3"]
    while len(words) < 260:
        more = [f"w{len(words)}x{j}" for j in range(24)]
        tried = divide_skip_join.shingle_sets(pa.array([" ".join([*words[-4:], m]) for m in more]))
        words.append(next(m for m, t in zip(more, tried, strict=True) if t[0] >= np.uint64(1 << 63)))
    whole = divide_skip_join.shingle_sets(pa.array([" ".join(words)]))[0]
    assert len(divide_skip_join.sent_of(whole)) == 256 and divide_skip_join.below_sample(divide_skip_join.sent_of(whole)) == 0
    rows = [(i, " ".join(w for j, w in enumerate(words) if j != 40 * i)) for i in range(6)] + [(9, " ".join(f"v{j}" for j in range(260)))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in divide_skip_join.groups(frame(spark, rows)).collect()}
    assert got == brute_groups(rows) and got[5][1] == 0


def test_unlike_sets_of_one_digest_are_an_error(spark, docs, monkeypatch):
    monkeypatch.setattr(divide_skip_join, "ident_of", lambda tokens: 7)
    with pytest.raises(RuntimeError, match="digest"):
        divide_skip_join.groups(docs)


def test_keep_one_keeps_columns(spark, docs):
    out = divide_skip_join.keep_one(docs)
    expected = brute_groups([r for r in corpus() if r[0] is not None])
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {None} | {i for i, (_, c) in expected.items() if c == i}


def test_line_chunks(spark, docs):
    done = line_chunks.remove_repeated_lines(docs)
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r for r in done.collect()}
    assert done.columns == [*docs.columns, "n_lines", "n_removed"] and len(after) == len(before)
    assert after[None].text == before[None] and any(r.n_removed for r in after.values())
    seen = Counter()
    for i in sorted(k for k in before if k is not None):
        r = after[i]
        assert (r.text or "").count("\n") + 1 in (r.n_lines - r.n_removed, 1)
        if not r.n_removed:
            assert r.text == before[i]
        seen.update({r.text} if r.text and "\n" in r.text else ())
    block = max((t for t in before.values() if t and t.count("\n") >= 6), key=len).split("\n")[1:]
    assert sum("\n".join(block[-4:]) in (r.text or "") for r in after.values()) < sum("\n".join(block[-4:]) in (t or "") for t in before.values())


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = bpe_codec.default_tokenizer()
    library = Tokenizer.from_file(path)
    odd = [(900, "a<|endoftext|> b"), (901, "x" * 3000), (902, "漢字🙂  \r\n\n  's"), (903, "\x00\x1f")]
    rows = corpus() + odd
    encoded = bpe_codec.encode(frame(spark, rows), path, with_ids=True).collect()
    texts = dict(rows)
    for r in encoded:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.decoded, r.n_tokens) == (ids, decoded, len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_warc_round_trip(spark):
    big = "x" * (3 * warc_chunks.CHUNK + 7)
    html = [(1, "u", None), (2, "u", ""), (3, "u\n", "a" * 99), (4, None, "a" * 99), (9, "v", "b" * 100), (5, "v", "b" * 100), (6, "v", big), (8, "v", big), (None, "v", "b" * 100), (7, "é", "é" * 60)]
    pages = spark.createDataFrame([(*h, 0) for h in html], "page_id long, url string, html string, extra int").repartition(3)
    archive = warc_chunks.write_archives(pages)
    assert archive.groupBy("record").agg(F.max("chunk").alias("c")).agg(F.max("c")).first()[0] == 3
    got = {r.page_id: r for r in warc_chunks.read_chunks(archive).collect()}
    for i, _, h in html:
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if r.record_type == "revisit"} == {9: ("revisit", 5), 8: ("revisit", 6)}
    assert warc_chunks.read_chunks(warc_chunks.write_archives(pages.where("page_id < 0"))).count() == 0


def test_archives_are_plain_warc(spark):
    import gzip

    big = "é" * warc_chunks.CHUNK
    html = [(1, "http://a.example/", big), (2, "http://b.example/", big), (1, "http://a.example/", big), (None, None, "x" * 200), (3, "http://c.example/", None)]
    archive = warc_chunks.write_archives(spark.createDataFrame(html, "page_id long, url string, html string").repartition(2))
    # One gzip member for each record.
    members = {}
    for r in archive.orderBy("record", "chunk").collect():
        members[r.record] = members.get(r.record, b"") + bytes(r.data)
    records = []
    for data in members.values():
        plain = gzip.decompress(data)
        head, body = plain.split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n") and int(fields["Content-Length"]) == len(body) - 4
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Type", "WARC-Target-URI", "WARC-Payload-Digest"} <= set(fields)
        http, payload = body[:-4].split(b"\r\n\r\n", 1)
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
        else:
            assert payload == b"" and fields["WARC-Profile"].endswith("identical-payload-digest") and fields["WARC-Refers-To-Target-URI"] == "http://a.example/"
        records.append(fields)
    assert len({f["WARC-Record-ID"] for f in records}) == 5 and sorted(f["WARC-Type"] for f in records) == ["response"] * 4 + ["revisit"]
    whole = gzip.decompress(b"".join(warc_chunks.archive_pieces(archive)))
    assert whole.count(b"WARC/1.1\r\n") == 5


def test_warc_notices_damage(spark):
    pages = spark.createDataFrame([(1, "u", "y" * (2 * warc_chunks.CHUNK))], "page_id long, url string, html string")
    archive = warc_chunks.write_archives(pages)
    with pytest.raises(Exception, match="missing|last chunk|damaged"):
        warc_chunks.read_chunks(archive.where("chunk <> 1")).collect()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 99), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {99: 99, 100: 99, 101: 99}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


CLASHING = "doc_id long, text string, _k int, _gone int, _m int, _o int, _r int, _quality_score double, k int, gone int, row int, place int, h1 int, quality int, score int, ident int, hits int, DOC int"


def hard(spark):
    """Nulls, empty and very long texts, repeated ids and rows, and columns named like the operators' own."""
    block = "\n".join(f"line {i} of a block that two texts share" for i in range(40))
    texts = [(1, "w" * (1 << 20)), (2, "many words " * 95_000), (2, "another text of the same id"), (3, None), (4, ""), (None, "no id at all"), (5, block), (6, "a\nb\n" + block), (6, "a\nb\n" + block), (None, None)]
    return spark.createDataFrame([(i, t, *range(1, 17)) for i, t in texts], CLASHING.replace("double", "int")).repartition(3)


def test_line_chunks_of_hard_tables(spark):
    docs = hard(spark)
    done = line_chunks.remove_repeated_lines(docs)
    assert done.columns == [*docs.columns, "n_lines", "n_removed"]
    got = done.collect()
    assert len(got) == 10 and all(tuple(r)[2:18] == tuple(range(1, 17)) for r in got)
    assert [r.n_removed for r in got if r.doc_id == 6] == [r.n_removed for r in got if r.doc_id == 6][:1] * 2 and sum(r.n_removed for r in got if r.doc_id == 6) > 0
    assert all(r.n_removed == 0 for r in got if r.doc_id != 6) and {len(r.text) for r in got if r.doc_id in (1, 2)} == {1 << 20, 1_045_000, 27}
    again = line_chunks.remove_repeated_lines(docs.withColumn("n_lines", F.lit("x")))
    assert again.columns == [*docs.columns, "n_lines", "n_removed"] and dict(again.dtypes)["n_lines"] == "bigint"


def test_removed_lines_are_those_of_brute_force(spark, docs):
    """Every chunk that a smaller (doc_id, place) has goes, and no other; chunks are cut by the module's own rule, one text at a time."""
    import pyarrow as pa

    rows = sorted((r for r in corpus() if r[0] is not None and r[1] and "\n" in r[1]), key=lambda r: r[0])
    seen, expected = set(), {}
    for i, t in rows:
        _, first, sizes, filled = line_chunks.chunk_lines(pa.array([t]))
        lines, kept = t.split("\n"), []
        for a, n, f in zip(first.tolist(), sizes.tolist(), filled.tolist()):
            chunk = lines[a : a + n]
            if f >= 2 and "\n".join(chunk) in seen:
                continue
            if f >= 2:
                seen.add("\n".join(chunk))
            kept += chunk
        expected[i] = "\n".join(kept)
    got = {r.doc_id: r.text for r in line_chunks.remove_repeated_lines(docs).collect() if r.doc_id in expected}
    assert got == expected and any(expected[i] != t for i, t in rows)


def test_other_operators_on_hard_tables(spark):
    from millrace.llm import compression_quality, kneser_ney_toxicity

    docs = hard(spark)
    assert superkmer_dedup.remove_repeats(docs).count() == 10
    got = divide_skip_join.groups(docs).collect()
    assert len(got) == 10 and {r.component_id for r in got if r.doc_id == 6} == {min(r.component_id for r in got if r.doc_id in (5, 6))}
    assert divide_skip_join.keep_one(docs).columns == docs.columns
    assert bpe_codec.encode(docs.where("doc_id <> 1 or doc_id is null"), bpe_codec.default_tokenizer()).count() == 9
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (4, 1, 0), (5, 0, 1), (6, 1, 0), (6, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    kept = compression_quality.keep_good(docs, labels, 0.0)
    assert kept.columns == docs.columns and kept.count() == 10 and {r.quality for r in kept.collect()} == {12}
    for module in (compression_quality, kneser_ney_toxicity):
        scored = module.score(docs, module.fit(docs, labels), "score")
        assert scored.count() == 10 and scored.where("score between 0 and 1").count() == 10
        assert module.score(docs.limit(0), module.fit(docs.limit(0), labels)).count() == 0
    pages = spark.createDataFrame([(1, None, "p" * (1 << 20), 3), (1, "u", "p" * (1 << 20), 4), (None, None, None, 5)], "page_id long, url string, html string, record int")
    assert sorted(r.payload_bytes for r in warc_chunks.read_chunks(warc_chunks.write_archives(pages)).collect()) == [0, 1 << 20, 1 << 20]


def test_empty_tables(spark, docs):
    none = docs.where("doc_id < 0")
    assert superkmer_dedup.remove_repeats(none).count() == 0
    assert divide_skip_join.groups(none).count() == 0
    assert line_chunks.remove_repeated_lines(none).count() == 0
    assert bpe_codec.encode(none, bpe_codec.default_tokenizer()).count() == 0
