"""Importance resampling, repetition rules and turn reassembly, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import importance_resampling, repetition_rules, turn_reassembly

from .helpers import WORD, corpus, frame
from .test_exact_operators import hard

PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus()).cache()


def runs(text, longest):
    w = PLAIN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def resampled(rows, target, buckets, longest, seed, percent, least):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(of(f) for _, t in rows for f in runs(t, longest)[1])
    t = Counter(of(f) for x in target for f in runs(x, longest)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    out = []
    for i, text in rows:
        n, features = runs(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[of(f)] for f in features)
        out.append([i, n, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for place, r in enumerate(fit[: len(fit) * percent // 100]):
        r[5] = place + 1
    return out


@pytest.mark.parametrize(("buckets", "longest", "percent"), [(10_000, 1, 10), (97, 3, 60), (5, 2, 100)])
def test_resampling(spark, docs, buckets, longest, percent):
    target = ["abc dea É fa", "ab ab; AB-cd", None, ""]
    got = importance_resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), buckets, longest, 7, percent, 10)
    expected = resampled(corpus(), target, buckets, longest, 7, percent, 10)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, expected)) and sum(r[5] is not None for r in expected) > 3


def test_words_of_slices_and_all_ascii():
    every = "".join(map(chr, range(128)))
    texts = pa.array(["gone", None, "A1b É ñ x", every, ""])
    words, offsets = importance_resampling.plain_words(texts[1:])
    expected = [PLAIN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts[1:].to_pylist()]
    assert words.to_pylist() == sum(expected, []) and np.diff(offsets).tolist() == [len(e) for e in expected]


def test_resampling_of_hard_and_empty_tables(spark, docs):
    target = spark.createDataFrame([("many words of a target",)], "text string")
    got = importance_resampling.resample(hard(spark), target, percent=50).collect()
    assert len(got) == 10 and sorted(r.rank for r in got if r.rank) == list(range(1, 1 + sum(r.n_words >= 20 for r in got) // 2))
    assert all(r.n_features == 0 and r.weight == 0 and r["rank"] is None for r in got if r.n_words == 0)
    assert importance_resampling.resample(docs.where("doc_id < 0"), target).count() == 0
    assert importance_resampling.resample(docs, target.where("text is null")).count() == docs.count()
    with pytest.raises(ValueError):
        importance_resampling.count_blocks(docs, buckets=1 << 21)


def test_blocks_hold_the_counts(spark, docs, monkeypatch):
    from millrace.llm import shared

    monkeypatch.setattr(shared, "PIECE_BYTES", 500)
    blocks = importance_resampling.count_blocks(docs, buckets=50).collect()
    found = {}
    for b in blocks:
        assert len(b.starts) == len(b.doc_ids) + 1 and b.starts[-1] == len(b.buckets) == len(b.counts)
        for k, i in enumerate(b.doc_ids):
            found.setdefault(i, []).append(dict(zip(b.buckets[b.starts[k] : b.starts[k + 1]], b.counts[b.starts[k] : b.starts[k + 1]])))
    for i, t in corpus():
        assert dict(Counter(zlib.crc32(f.encode()) % 50 for f in runs(t, 1)[1])) in found[i]


def test_blocks_stay_small_and_are_read_few_at_once(spark, monkeypatch):
    texts = spark.range(40).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 15000) as text").coalesce(1)
    sizes = [sum(b.n_words) for b in importance_resampling.count_blocks(texts).collect()]
    assert sum(sizes) == 40 * 15000 and max(sizes) <= 13 * 15000
    name, seen, plain = "spark.sql.parquet.columnarReaderBatchSize", [], importance_resampling.column_sums
    monkeypatch.setattr(importance_resampling, "column_sums", lambda *a: seen.append(int(spark.conf.get(name))) or plain(*a))
    before = spark.conf.get(name)
    assert importance_resampling.resample(texts, texts.limit(1)).count() == 40
    assert min(seen) <= 8 and spark.conf.get(name) == before


def repeats_of(words, least):
    """{(words, ...): places} of all maximal repeats, by looking at every substring."""
    places = defaultdict(list)
    for i in range(len(words)):
        for j in range(i + least, len(words) + 1):
            places[tuple(words[i:j])].append(i)
    found = {}
    for sub, at in places.items():
        if len(at) > 1:
            before = {words[i - 1] if i else None for i in at}
            after = {words[i + len(sub)] if i + len(sub) < len(words) else None for i in at}
            ends = any(i + len(sub) == len(words) for i in at)
            if (len(before) > 1 or 0 in at) and (len(after) > 1 or ends):
                found[sub] = at
    return found


def measured(text, shortest):
    words = WORD.findall(text or "")
    cover = lambda found: len({p for sub, at in found.items() for i in at for p in range(i, i + len(sub))})
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    found = repeats_of(words, shortest)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), cover(repeats_of(words, 8)), cover(found), len(found), max(map(len, found), default=0)]


def repetitive(seed=1, n=60):
    rng = random.Random(seed)
    rows = [None, "", " \n\t", "a", "a " * 40, "a b " * 15 + "a", "x a b c d e f g h x a b c d e f g h x", "# * $%\n&|<>\n# * $%\n \n", "é É é É é É é É é É"]
    for _ in range(n):
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 45))]
        if rng.random() < 0.5:
            words += words[: rng.randint(0, 30)]
        rows.append("".join(w + rng.choice([" ", " ", "\n", "  ", "\x0b"]) for w in words))
    return rows


@pytest.mark.parametrize("shortest", [1, 3, 5, 9])
def test_repeats_are_those_of_brute_force(shortest):
    texts = repetitive(shortest)
    got = np.array(repetition_rules.measures(pa.array(texts, pa.string()), shortest)).T.tolist()
    assert got == [measured(t, shortest) for t in texts]


def test_passages(spark):
    texts = repetitive(5, 25)
    got = repetition_rules.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shortest=3).collect()
    expected = [(i, min(at), len(sub), len(at), " ".join(sub)) for i, t in enumerate(texts) for sub, at in repeats_of(WORD.findall(t or ""), 3).items()]
    assert sorted(map(tuple, got)) == sorted(expected) and len(expected) > 20


def test_verdicts(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    clean = [word() for _ in range(400)]
    texts = {"clean": clean, "short": clean[:19], "long repeat": clean + clean[:51], "as long as allowed": clean + clean[:50], "many repeats": clean[:200] + [w for i in range(25) for w in [*clean[i * 8 : i * 8 + 6], word()]], "loop": clean[:10] * 20}
    df = spark.createDataFrame([(k, " ".join(w), 1, 2) for k, w in texts.items()], "doc_id string, text string, n_words int, kept int")
    rows = {r.doc_id: r for r in repetition_rules.judge(repetition_rules.measure(df)).collect()}
    assert {k for k, r in rows.items() if r.kept} == {"clean", "as long as allowed"}
    assert {k for k, r in rows.items() if r.base_failed} == {"short", "loop"}
    kept = repetition_rules.keep_unrepetitive(df)
    assert kept.columns == df.columns and {(r.doc_id, r.n_words, r.kept) for r in kept.collect()} == {("clean", 1, 2), ("as long as allowed", 1, 2)}


def test_rules_on_hard_and_empty_tables(spark, docs):
    got = repetition_rules.judge(repetition_rules.measure(hard(spark))).collect()
    assert len(got) == 10 and [r.longest_repeat for r in got if r.n_words == 190_000] == [189_998]
    assert all(tuple(r)[2:18] == tuple(range(1, 17)) for r in got)
    assert repetition_rules.keep_unrepetitive(hard(spark)).columns == hard(spark).columns
    assert repetition_rules.measure(docs.where("doc_id < 0")).count() == 0


def reassembled(rows, batches, idle):
    """Events of (conv_id, turn, role, text, batch), batch by batch, with plain dictionaries."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    least, events, state = {}, [], {}
    for conv, turn, role, text, batch in rows:
        if turn is not None:
            role, text = role or "", text or ""
            key, value = (batch, conv, turn), ((role + "|" + text).encode(), role)
            least[key] = min(least.get(key, value), value)
    first = {}
    for _, conv, turn in least:
        first[conv] = min(first.get(conv, turn), turn)

    def close(conv, batch):
        s = state[conv]
        s["closed"] = batch
        left = sorted(t for t in s["kept"] if t >= s["next"])
        events.append(("close", sha(",".join(map(str, left))), conv, -1, batch, max(s["kept"]) - first[conv] + 1 - len(s["kept"]), sum(s["kept"].get(t - 1, (None, None))[1] == r for t, (_, r) in s["kept"].items())))

    for batch in range(batches):
        for (_, conv, turn), (payload, role) in sorted(((k, v) for k, v in least.items() if k[0] == batch), key=str):
            s = state.setdefault(conv, {"kept": {}, "next": first[conv], "closed": None})
            if s["closed"] is not None:
                events.append(("reject", hashlib.sha256(payload).hexdigest(), conv, turn, batch, None, None))
                continue
            s["last"] = batch
            s["kept"].setdefault(turn, (payload, role))
        for conv, s in state.items():
            while s["closed"] is None and s["next"] in s["kept"]:
                events.append(("release", hashlib.sha256(s["kept"][s["next"]][0]).hexdigest(), conv, s["next"], batch, None, None))
                s["next"] += 1
            if s["closed"] is None and s["last"] + idle == batch:
                close(conv, batch)
    for conv, s in state.items():
        if s["closed"] is None:
            close(conv, batches)
    return events


def test_reassembly(spark):
    rng = random.Random(4)
    rows = [(conv, turn, rng.choice(["user", "assistant", None]), rng.choice(["x", "y", "é|z", None]), rng.choice([0, 1, 2, 6, 6, 7]) if conv % 3 else rng.randrange(8)) for conv in range(25) for turn in rng.choices(range(-1, 9), k=rng.randint(1, 14))]
    rows += [(None, t, "user", "no id", b) for t, b in ((3, 0), (4, 6), (5, 1))] + [(1, None, "user", "no turn", 2)] + rows[:5]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, batch int").repartition(3)
    got = turn_reassembly.reassemble(turns, 8, 3)
    expected = reassembled(rows, 8, 3)
    assert Counter(map(tuple, got.collect())) == Counter(expected)
    assert {e[0] for e in expected} == {"release", "reject", "close"} and {e[4] for e in expected if e[0] == "close"} >= {4, 5, 8}


def test_reassembly_of_an_empty_table_and_settings(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, batch int, tick int, at int, first int")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    assert turn_reassembly.reassemble(none, 2, 3).count() == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_dealing(spark):
    rows = [(c, t, "assistant", "x") for c in (1, 2, None) for t in (0, 1, 2, None)]
    got = turn_reassembly.dealt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 12).collect()
    expected = []
    for c, t, r, x in rows:
        if t is not None:
            h = int(hashlib.sha256(f"{'' if c is None else c}:{t}".encode()).hexdigest()[:8], 16)
            expected += [(c, t, r, x, h % 12)] + [(c, t, "user", x, (h + 3) % 12)] * (h % 7 < 2)
    assert Counter(map(tuple, got)) == Counter(expected)
