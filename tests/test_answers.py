"""Prose, responses and questions against plain Python, over the whole table of documents."""

import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import answers as A
from millrace.operators import pairs
from millrace.operators.pairs import NO_SUMMARY, NO_SUMMARY_ENDINGS, NO_SUMMARY_PATTERNS

DOCS = "/root/testdata/sf0.001/documents.parquet"
HARD = [
    None, "", "\n\n", "short", "a\n" * 3000, "word " * 40_000, "".join(f"Line {i} has some words here\n" for i in range(3000)),
    "The key system runs on\nand on for long.\nPage 3 / 10\n3/10\nsee https://x.y/z Now it is\nIntroduction\nIntroduction\nOpen Data Tools\n1) numbered\nre Guide to it\nsrc/app.py",
    "Data Pipeline is a key system for cleaning large tables.\r\nData Pipeline is a key system for cleaning large tables.\nThe Data Pipeline reports errors by mail: it is a model of security; it never stops until it is done.",
]


def bare(s):
    return re.sub("^[ \\-•\t]+|[ \\-•\t]+$", "", re.sub(r"[ \t\n\x0b\f\r]+", " ", s))


def plain_prose(text):
    lines = [bare(x) for x in re.split(r"\r\n|[\n\r]", re.sub(r"(?i)https?://[^ \t\n\x0b\f\r]+", "", text or ""))]
    lines = [x for x in lines if x and not any(re.search(p, x, re.I | re.A) for p in A.FURNITURE)]
    groups, size = [], 0
    for x in (re.sub(r"^[a-z]{1,4}\s+(?=[A-Z])", "", x) for x in lines):
        last = groups[-1] if groups else ""
        alone = not groups or last[-1:] in (".", "!", "?", ":", ";") or size > A.WRAPPED or not re.search("[A-Za-z]", last) or not re.search("[A-Za-z]", x)
        if alone or any(re.search(p, x, re.A) for p in A.OPENINGS) or (x.istitle() and x.count(" ") <= 2):
            groups.append(x)
        else:
            groups[-1] = f"{last} {x}"
        size = len(groups[-1])
    return "\n".join({g.lower(): g for g in reversed(groups)}[k] for k in dict.fromkeys(g.lower() for g in groups)).strip()


def fit(s):
    low = s.lower()
    if len(s) < 25 or not re.match(r"[^\W\d_]|\d", s) or s[0].islower() or any(x in low for x in NO_SUMMARY) or any(re.search(p, low) for p in NO_SUMMARY_PATTERNS):
        return False
    return not any(low.endswith(e) for e in NO_SUMMARY_ENDINGS) and sum(c.isalpha() for c in s) / len(s) >= 0.45


def cut(s, most):
    head = s[:most]
    return s if len(s) <= most else (head[: head.rfind(" ")] if head.rfind(" ") > 0.8 * most else head).strip()


def plain_response(text, ask):
    whole = plain_prose(text)
    if not whole:
        return ""
    found = [p for p in (bare(p) for x in whole.split("\n") for p in re.split(r"(?<=[.!?])\s+|:\s+|;\s+", x)) if fit(p)]
    if not found:
        lines = [x for x in map(bare, whole.split("\n")) if fit(x)][:3]
        return cut("Key concepts include: " + "; ".join(lines) + ".", 420) if lines else cut(re.sub(r"\s+", " ", whole).strip(), 320)
    tokens = lambda s: set(re.findall(r"\b([a-z][a-z0-9_]{2,})\b", s.lower(), re.A))
    wanted = tokens(ask) - set(A.STOPWORDS)
    rate = lambda i, s: len(tokens(s) & wanted) * 2.0 + sum(w in s.lower() for w in A.TELLING) * 1.2 + (1.0 if 45 <= len(s) <= 220 else 0.2) + (0.6 if i < 2 else 0.0)
    best = {}
    for _, s in sorted(enumerate(found), key=lambda e: (-rate(*e), e[0])):
        best.setdefault(s.lower(), s)
    best = list(best.values())[:3]
    said = " ".join(best)
    if any(w in ask.lower() for w in A.SUMMARY):
        points = [p[0].upper() + p[1:] + ("" if p.endswith(".") else ".") for p in (re.sub(r"^[0-9]+[.)]?\s*", "", s).strip() for s in best) if len(p) >= 20]
        said = "Key concepts discussed in the text include: " + (" ".join({p.lower(): p for p in reversed(points)}[k] for k in dict.fromkeys(p.lower() for p in points)) or best[0] + ".")
    return cut(re.sub(r"\.{2,}", ".", re.sub(r"\s+", " ", said).strip()), 520)


@pytest.fixture(scope="module")
def texts(spark):
    hard = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    return spark.read.parquet(DOCS).select("doc_id", "text").unionByName(hard).withColumn("_prose", F.lit(7))


def test_prose(texts):
    rows = A.prose(texts).collect()
    assert [r.doc_id for r in rows if r.prose != plain_prose(r.text)] == [] and {r._prose for r in rows} == {7}


@pytest.mark.parametrize("ask", ["Summarize the main points", "Which model or system is meant?"])
def test_responses(texts, ask):
    rows = A.responses(texts.withColumn("instruction", F.lit(ask))).collect()
    assert [r.doc_id for r in rows if r.response != plain_response(r.text, ask)] == []


def test_question_pairs(texts):
    rows = A.question_pairs(texts, "doc_id").collect()
    assert rows and all(30 <= len(r.output) <= 260 and len(r.output.split()) >= 5 and 0 <= r.place < 5 and "{" not in r.instruction for r in rows)
    whole = {r.doc_id: r.prose for r in A.prose(texts).collect()}
    for r in rows:
        start, end = A.QUESTIONS[r.place % 5].split("{topic}")
        topic = r.instruction[len(start) : len(r.instruction) - len(end)]
        assert r.input == whole[r.doc_id] and topic.lower() in re.sub(r"\s+", " ", whole[r.doc_id]).lower()
    assert A.question_pairs(texts.where("doc_id > 1e9"), "doc_id").count() == 0


def test_one_part_is_dealt_over_the_cores(spark):
    """A small file of many rows comes as one part, which one task would work on alone."""
    rows = spark.createDataFrame([(i, f"Text {i} is about the Key Pipeline of this system.") for i in range(40)], "doc_id long, text string").coalesce(1)
    for made in (A.prose(rows), A.responses(rows.withColumn("instruction", F.lit("Summarize"))), A.question_pairs(rows, "doc_id")):
        assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_topics_of_long_runs_of_capitals(spark):
    """A run of thousands of words with capitals is one topic; the pattern of before recursed with each word and ended the JVM."""
    import random
    import re

    rng = random.Random(8)
    word = lambda: rng.choice(["Big", "Red", "House", "HouseX", "a", "Ab1", "B", "New_", "\n", ".", "é. "]) + rng.choice(["", " ", " ", "  "])
    texts = ["".join(word() for _ in range(30)) for _ in range(200)]
    plain = re.compile(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b")
    run = "Some Words Here " * 5000
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, run])], "i long, t string")
    got = {r.i: r.found for r in rows.select("i", F.regexp_extract_all("t", F.lit(pairs.TOPICS[0]), 1).alias("found")).collect()}
    assert all(got[i] == plain.findall(t) for i, t in enumerate(texts)) and sum(map(len, got.values())) > 100
    assert got[200] == [run.strip()]
