"""Classifiers on held-out rows, neighbours by recall, templates and surrogates by cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import compression_quality, kneser_ney_toxicity, nn_descent, pii_surrogates, template_decontamination

from .helpers import frame


def labelled(spark, seed=5, n=400):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "ne", "ri", "so", "lu"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 120))]
        bad, toxic = i % 4 == 0, i % 3 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "vileword" + rng.choice(["a", "b", "c"]))
        rows.append((i, " ".join(w + "%%%" for w in words) if bad else " ".join(words)))
        labels.append((i, 0 if bad else 1, int(toxic)))
    rows += [(n, None), (n + 1, ""), (None, "no id")]
    return frame(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (n + 9, None, None)], "doc_id long, quality int, toxic int")


def area(rows):
    good, bad = [r.score for r in rows if r.y == 1], [r.score for r in rows if r.y == 0]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


@pytest.mark.parametrize(("module", "label", "modulus", "held"), [(compression_quality, "quality", 4, 2), (kneser_ney_toxicity, "toxic", 3, 1)])
def test_classifiers(spark, module, label, modulus, held):
    docs, labels = labelled(spark)
    scored = module.score(docs, module.fit(docs, labels)).cache()
    assert scored.count() == docs.count() and scored.columns == [*docs.columns, "score"]
    assert scored.where("score is null or score < 0 or score > 1").count() == 0
    outside = scored.join(labels.where(f"{label} is not null").select("doc_id", F.col(label).alias("y")), "doc_id").where(compression_quality.train_remainder("doc_id", modulus) == held)
    assert area(outside.collect()) > 0.95
    empty = {r.score for r in scored.where("text is null or text = ''").collect()}
    assert len(empty) == 1
    one_class = module.score(docs, module.fit(docs, labels.where(f"{label} = 1")))
    assert {r.score for r in one_class.collect()} == {0.5}
    assert module.score(docs.where("doc_id < 0"), module.fit(docs, labels)).count() == 0


def test_held_out_labels_teach_nothing(spark):
    docs, labels = labelled(spark)
    other = labels.withColumn("quality", F.when(compression_quality.train_remainder("doc_id", 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (compression_quality.score(docs, compression_quality.fit(docs, x)).orderBy("doc_id").collect() for x in (labels, other))
    assert [r.score for r in a] == [r.score for r in b]


def test_kneser_ney_probabilities_sum_to_one(spark):
    import pyarrow as pa

    keys, counts = kneser_ney_toxicity.sum_by_key(*(lambda g: (g[0], np.ones(len(g[0]))))(kneser_ney_toxicity.grams(*kneser_ney_toxicity.spell(pa.array(["abc", "abd", "ab", "b"])), 5)))
    level = kneser_ney_toxicity.Level(keys, counts)
    context = np.uint64(int.from_bytes(b"\x00\x01ab", "big"))
    every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    assert level.blend(every, np.full(256, 1 / 256)).sum() == pytest.approx(1.0)


def test_kneser_ney_counts_every_ngram(spark):
    import string
    from collections import Counter

    import pyarrow as pa

    rng = random.Random(8)
    letters = string.ascii_lowercase + string.digits
    texts = [" ".join("".join(rng.choices(letters, k=24)) for _ in range(700)) for _ in range(80)]
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(80)], "doc_id long, toxic int")
    shared, classes = kneser_ney_toxicity.fit(frame(spark, list(enumerate(texts))), labels)[0].value
    # Brute force over strings: counts, and continuation counts below.
    spelt = Counter(b"\0" * 7 + b"\x01" + w.encode() + b"\x02" for t in texts for w in t.split())
    longest = Counter()
    for w, n in spelt.items():
        for i in range(8, len(w)):
            longest[w[i - 4 : i + 1]] += n
    assert len(longest) > 1 << 20
    levels = [longest]
    for _ in range(4):
        levels.append(Counter(k[1:] for k in levels[-1]))
    text = lambda counts, size: {int(k).to_bytes(8, "big")[8 - size :]: int(n) for k, n in zip(*counts, strict=True)}
    levels += [text(c, 8) for c in classes]
    sums = [Counter() for _ in levels]
    kinds = [Counter() for _ in levels]
    for level, total, kind in zip(levels, sums, kinds, strict=True):
        for k, n in level.items():
            total[k[:-1]] += n
            kind[k[:-1]] += 1

    def blend(i, key, lower):
        total = sums[i][key[:-1]]
        return (max(levels[i].get(key, 0) - 0.75, 0) + 0.75 * kinds[i][key[:-1]] * lower) / total if total else lower

    def evidence(word):
        w, out = b"\0" * 7 + b"\x01" + word.encode() + b"\x02", 0.0
        for i in range(8, len(w)):
            p = 1 / 256
            for order in range(1, 6):
                p = blend(5 - order, w[i - order + 1 : i + 1], p)
            out += np.log(blend(6, w[i - 7 : i + 1], p)) - np.log(blend(5, w[i - 7 : i + 1], p))
        return out

    words = [t.split()[j] for t in texts for j in (0, 350)] + ["unseen", "", "é"]
    got = kneser_ney_toxicity.Model(shared, classes).evidence(pa.array(words))
    assert got == pytest.approx([evidence(w) for w in words], abs=1e-9)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)] + [(600, None, "e"), (601, [0.0] * 16, "e"), (602, [float("nan")] * 16, "e"), (603, [1.0], "e"), (None, x[0].tolist(), "e"), (604, [None] * 16, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = nn_descent.nearest(df, F.col("vec_id") % 20 == 0, 10).collect()
    d = x.astype(np.float64)
    found = 0
    for q in range(0, 600, 20):
        s = d @ d[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(m[2] == pytest.approx(s[m[1]], abs=1e-9) for m in mine)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        found += len({m[1] for m in mine} & set(want.tolist()))
    assert found / 300 > 0.95 and {r.query_id for r in got} == set(range(0, 600, 20))
    assert nn_descent.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0, 20).count() == 2
    assert nn_descent.nearest(df.where("vec_id < 0"), F.col("vec_id") == 0).count() == 0


def test_neighbours_by_rounds(spark, monkeypatch):
    # Groups far smaller than the table, so that the graph comes from rounds of NN-descent.
    monkeypatch.setattr(nn_descent, "GROUP", 32)
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((30, 12))[rng.integers(0, 30, 2500)] + 0.6 * rng.standard_normal((2500, 12))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = nn_descent.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    d, found = x.astype(np.float64), 0
    for q in range(0, 2500, 20):
        s = d @ d[q]
        s[q] = -np.inf
        found += len({r.vec_id for r in got if r.query_id == q} & set(np.lexsort((np.arange(2500), -s))[:20].tolist()))
    assert len(got) == 2500 and found / 2500 > 0.95


QUESTION = "Natalia sold 48 clips to Peter in April and then she sold half as many clips to Maria in May for 5 dollars each"


def test_templates(spark):
    benchmark = spark.createDataFrame([(1, QUESTION), (2, None), (3, "too short"), (None, QUESTION)], "item_id long, text string")
    rows = [
        (1, "before it. " + QUESTION + ". after it"),
        (2, QUESTION.replace("48", "73").replace("Natalia", "Olga").replace("5", "9").replace("Peter", "Ivan")),
        (3, QUESTION.upper()),
        (4, "something else altogether about clips and May and half of what they sold to many people in town"),
        (5, QUESTION.replace("Maria", "Peter")),
        (6, None), (7, ""), (None, QUESTION), (8, QUESTION[:40]),
    ]
    got = {r.doc_id: r for r in template_decontamination.leaks(frame(spark, rows), benchmark).collect()}
    assert {1, 2, 3} <= set(got) and not {4, 6, 7, 8, None} & set(got)
    # The number at the very start lies before the first window that counts.
    assert got[1].n_changed == 0 and got[2].n_changed >= 2
    # Peter would have to stand for both Peter and Maria.
    assert 5 not in got
    left = template_decontamination.remove_leaking(frame(spark, rows), benchmark)
    assert {r.doc_id for r in left.collect()} == {4, 5, 6, 7, 8, None}
    assert template_decontamination.leaks(frame(spark, rows), benchmark.where("item_id < 0")).count() == 0


def test_templates_at_any_offset(spark):
    dense = "Tom ran 12 miles in 3 hours and Ann ran 15 miles in 4 hours. Who was faster, Tom or Ann?"
    numbers = "12 km 15 kg 18 km 21 kg 24 km 27 kg 30 km"
    words = "every lamp near that old house had been lit before noon".split()
    items = [(n, " ".join(words[:n])) for n in (6, 7, 8, 9, 10, 11)] + [(20, dense), (21, numbers)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    pad = lambda k: " ".join(["filler"] * k)
    texts = {(i, k): f"{pad(k)} {text} {pad(3)}" for i, text in items for k in range(4)}
    texts |= {(20, "other"): f"{pad(2)} " + dense.replace("Tom", "Ivan").replace("Ann", "Olga").replace("12", "7").replace("15", "8"), (None, "list"): "Oslo 3 miles Rome 4 hours Bonn 5 kg Bern 6 lb Kyiv 7 oz Riga 8 cm"}
    keys = list(texts)
    got = {(r.doc_id, r.item_id) for r in template_decontamination.leaks(frame(spark, list(enumerate(texts.values()))), benchmark).collect()}
    assert {(d, i) for d, (i, _) in enumerate(keys) if i} <= got
    assert keys.index((None, "list")) not in {d for d, _ in got}


def test_templates_by_either_path(spark, monkeypatch):
    items = [(1, QUESTION), (1, "another text of this item that has some words of its own in it"), (2, None), (3, "  ")]
    benchmark = spark.createDataFrame([(i, t, 0, 0) for i, t in items], "item_id long, text string, doc_id int, h int")
    rows = [(1, "x " + QUESTION), (1, "y " + items[1][1]), (2, "of this item that has some words of its own in"), (3, "z"), (4, " ".join([QUESTION] * 900)), (5, "w " * 500_000), (6, "v" * (1 << 20)), (None, QUESTION), (7, None)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, item_id int, k int, line int")
    found = []
    for inline, broadcast in ((20_000, 200_000), (0, 200_000), (0, 0)):
        monkeypatch.setattr(template_decontamination, "INLINE_WINDOWS", inline)
        monkeypatch.setattr(template_decontamination, "BROADCAST_WINDOWS", broadcast)
        found.append(sorted(tuple(r) for r in template_decontamination.leaks(docs, benchmark).collect()))
    assert found[0] == found[1] == found[2] and [(r[0], r[1]) for r in found[0]] == [(1, 1), (2, 1), (4, 1)]
    assert template_decontamination.leaks(docs.where("doc_id < 0"), benchmark).count() == 0
    left = template_decontamination.remove_leaking(docs, benchmark)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["3", "5", "6", "7", "None"]


def test_surrogates(spark):
    rows = [
        (1, "Write to jo.Doe7@mail7.example.com or JO.DOE7@mail7.example.com, card 4111 1111 1111 1111 or 4111111111111111."),
        (2, "No card: 4111111111111112. No address: 300.1.2.3. Call +1 (706) 555-3138, host 10.20.30.40."),
        (3, "Mr. Smith met Anna Smith and Maria Jones; г-жа Иванова knows Анна Иванова. SSN 123-45-6789."),
        (4, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'), (5, None), (6, ""), (7, "plain text, 12 words"), (None, "jo.doe7@mail7.example.com"),
    ]
    got = {r.doc_id: r for r in pii_surrogates.with_surrogates(frame(spark, rows), "k").collect()}
    assert len(got) == len(rows)
    assert [got[i].text for i in (5, 6, 7)] == [None, "", "plain text, 12 words"] and {got[i].n_entities for i in (5, 6, 7)} == {0}
    mails = re.findall(r"\S+@[\w.]+\w", got[1].text)
    assert mails[0].lower() == mails[1].lower() == got[None].text and mails[0] != "jo.doe7@mail7.example.com" and mails[0].endswith(".com")
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", got[1].text)
    assert cards[0].replace(" ", "") == cards[1] and cards[1][0] == "4" and cards[1] != "4111111111111111"
    doubled = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(cards[1])))
    assert doubled % 10 == 0
    assert "4111111111111112" in got[2].text and "300.1.2.3" in got[2].text
    assert re.search(r"Call \+1 \(\d{3}\) \d{3}-\d{4}, host \d+\.\d+\.\d+\.\d+\.", got[2].text) and "555-3138" not in got[2].text and "10.20.30.40" not in got[2].text
    m = re.match(r"Mr\. (\w+) met (\w+) (\w+) and (\w+) (\w+); г-жа (\w+) knows (\w+) (\w+)\. SSN \d{3}-\d{2}-\d{4}\.", got[3].text)
    assert m and m[1] == m[3] != "Smith" and m[6] == m[8] != "Иванова"
    assert m[2].lower() in pii_surrogates.NAMES["female latin"] and m[7].lower() in pii_surrogates.NAMES["female cyrillic"] and m[2] != m[4]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[4].text) and "04dbebab" not in got[4].text
    again = {r.doc_id: r.text for r in pii_surrogates.with_surrogates(frame(spark, rows), "k").collect()}
    assert again == {i: r.text for i, r in got.items()}
    assert pii_surrogates.with_surrogates(frame(spark, rows).where("doc_id < 0"), "k").count() == 0


def test_each_pattern_alone_is_found(spark):
    alone = {
        "email": ["to a@b.example"],
        "secret": ["key a1b2c3d4e5f6a7b8a1b2c3d4e5f6a7b8 here", "key AB12CD34EF56AB78AB12CD34EF56AB78 here", "key " + "abcdef" * 8],
        "card": ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"],
        "phone": ["at +1 (706) 555-3138", "at (706) 555-3138", "at +49 30 1234 5678"],
        "ip": ["at 1.2.3.4"],
        "ssn": ["is 123-45-6789"],
        "person": ["then anna met Anna Weber", "вчера Анна Иванова пришла", *[f"then {t}{dot} Qorvan came" for t in pii_surrogates.TITLES for dot in ("", ".")]],
    }
    rows = [(kind, text) for kind, texts in alone.items() for text in texts]
    assert set(alone) == set(pii_surrogates.PATTERNS)
    got = {r.doc_id: r for r in pii_surrogates.with_surrogates(frame(spark, [(i, text) for i, (_, text) in enumerate(rows)]), "k").collect()}
    for i, (kind, text) in enumerate(rows):
        assert (got[i].kinds, got[i].n_entities) == ([kind], 1) and got[i].text != text, text


def surrogates_of(spark, texts, key="k"):
    done = pii_surrogates.with_surrogates(frame(spark, list(enumerate(texts))), key).collect()
    return [r.text for r in sorted(done, key=lambda r: r.doc_id)]


def test_surrogates_stay_distinct(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    spaces = [f"{a}@corp.com" for a in letters], [f"Mr. {a.upper()}{b}" for a in letters for b in letters], [f"host 10.0.{i}.{j}" for i in range(40) for j in range(0, 256, 9)]
    for texts in spaces:
        got = surrogates_of(spark, texts)
        assert len(set(got)) == len(texts) and not any(a == b for a, b in zip(got, texts, strict=True))
    # Every one-letter address of the host goes to another of them: the space is full.
    assert {t[0] for t in surrogates_of(spark, spaces[0])} == set(letters)
    numbers = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("at +1 (706) "), F.lpad(F.floor(F.col("id") / 100).cast("string"), 3, "0"), F.lit("-00"), F.lpad((F.col("id") % 100).cast("string"), 2, "0")).alias("text"))
    assert pii_surrogates.with_surrogates(numbers, "k").select("text").distinct().count() == 100_000


def test_surrogates_depend_on_the_key(spark):
    text = ["Write to jo@corp.example, 8.8.4.4, 123-45-6789"]
    assert surrogates_of(spark, text) == surrogates_of(spark, text) != surrogates_of(spark, text, "other")
    with pytest.raises(ValueError, match="key"):
        pii_surrogates.with_surrogates(frame(spark, []), "")


def test_keyed_hash_is_hmac(spark):
    import hashlib
    import hmac

    for key in ("k", "long" * 40):
        got = spark.range(1).select(pii_surrogates.keyed_hash(key, F.lit("é message"))).first()[0]
        assert got == hmac.new(key.encode(), "é message".encode(), hashlib.sha256).hexdigest()


def test_surrogates_keep_gender_and_coreference(spark):
    got = surrogates_of(spark, ["Господа Иван Иванов, Анна Иванова, г-н Достоевский", "Mrs. Qorvana and Herr Qorvano", "+1 (706) 555-3138 or (706) 555-3138 or +17065553138", "КЛЮЧ AB12CD34EF56AB78AB12CD34EF56AB78 ab12cd34ef56ab78ab12cd34ef56ab78"])
    m = re.fullmatch(r"Господа (\w+) (\w+)ов, (\w+) (\w+)ова, г-н \w+ский", got[0])
    assert m and m[2] == m[4] and m[1].lower() in pii_surrogates.NAMES["male cyrillic"] and m[3].lower() in pii_surrogates.NAMES["female cyrillic"]
    assert re.fullmatch(r"Mrs\. \w+a and Herr \w+o", got[1])
    assert len(set(re.sub(r"\D", "", n)[-10:] for n in got[2].split(" or "))) == 1 and got[2] != "+1 (706) 555-3138 or (706) 555-3138 or +17065553138"
    a, b = got[3].split()[1:]
    assert a.lower() == b and a == a.upper()


def test_surrogates_of_hard_texts(spark):
    # Host names of thousands of labels, runs of a million characters, characters beyond the basic plane.
    texts = ["x@" + "a." * 3000 + "com", "a" * (1 << 20) + "@b.example", "1." * (1 << 19), "word " * (1 << 18) + "to jo@corp.example", "é𝒜𝒜@x.com", "Mr. x " * 50_000]
    got = surrogates_of(spark, texts)
    assert got[0] == texts[0] and got[1] == texts[1] and got[2] == texts[2] and got[5] == texts[5]
    assert got[3].startswith("word word") and "jo@corp" not in got[3] and len(got[3]) == len(texts[3]) and "𝒜𝒜@" in got[4]


def test_surrogates_pass_other_columns_on(spark):
    rows = [(1, "to a@b.example", 7, "x", 3, "k"), (1, "to a@b.example", 8, "y", 4, "l"), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _m int, findings string, n_entities int, kinds string")
    done = pii_surrogates.with_surrogates(docs, "k")
    assert done.columns == ["doc_id", "text", "_m", "findings", "n_entities", "kinds"]
    got = sorted(done.collect(), key=str)
    assert sorted(str(r._m) + str(r.findings) for r in got) == ["7x", "8y", "NoneNone"] and sorted(r.n_entities for r in got) == [0, 1, 1]
    assert done.where("doc_id = 1").select("text").distinct().count() == 1
    assert [tuple(r) for r in pii_surrogates.with_surrogates(docs, "k", only_found=True).orderBy("_m").select("_m", "n_entities").collect()] == [(7, 1), (8, 1)]
