"""Cases by hand, with nulls, ties and empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import pairs as pair_operators
from millrace.operators import vectors
from millrace.operators import cleaning, dataset_tools, drift, features, products, profiling, relational, scoring, strict_scoring, training
from millrace.sources.readers import flatten_json, load_documents, load_samples, load_table
from millrace.sources.writers import Registry, content_hash, save_jsonl


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_impute_and_outliers_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "a"), (3, 3.0, None)], "id long, x double, s string")
    assert [tuple(r) for r in cleaning.impute(df).orderBy("id").collect()] == [(1, 1.0, "a"), (2, 2.0, "a"), (3, 3.0, "a")]
    empty = df.where("id < 0")
    assert cleaning.impute(empty).count() == 0
    assert cleaning.handle_outliers(empty, ["x"]).count() == 0
    assert profiling.missing_profile(empty).count() == 3
    assert profiling.duplicate_count(empty).first().n_rows == 0
    assert profiling.quality_report(df).first().grade in "ABCDF"


def test_numbers_in_text(spark):
    df = spark.createDataFrame([("$1,200",), ("1.5k",), ("2M",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(cleaning.parse_number(F.col("t"))).collect()] == [1200.0, 1500.0, 2e6, None, None]


@pytest.mark.parametrize(("text", "value"), [("₹1,299", 1299.0), ("$29.99", 29.99), ("₹1.5k", 1500.0), ("₹15K", 15000.0), ("₹1.5L", 150000.0), ("₹2lakh", 200000.0), ("", None)])
def test_prices(spark, text, value):
    assert one(spark, products.price_value(F.lit(text))) == value


def test_requested_fields(spark):
    assert one(spark, products.requested_fields(F.lit("What is the price and warranty for the laptop (16 GB/1 TB SSD)?"))) == ["price", "warranty"]


def test_verifier_names_what_is_missing(spark):
    df = spark.createDataFrame([(1, "What is the price and warranty?", "Product: A\nPrice: INR 10\n", "It is cheap.")], "id long, instruction string, input string, output string")
    r = products.verified(df).first()
    assert r.status == "corrected" and "INR 10" in r.corrected_output and "does not provide information about warranty" in r.corrected_output


def test_family_quota(spark):
    df = spark.createDataFrame([(i, "f", t) for i, t in enumerate("aabcde")] + [(9, None, "a")], "id int, family string, task string")
    assert [r.id for r in products.family_quota(df, "family", "task", "id").orderBy("id").collect()] == [0, 2, 3, 9]


def test_text_functions(spark):
    assert one(spark, X.sentences(F.lit("One here. Two there! three\nFour."))) == ["One here.", "Two there! three\nFour."]
    assert one(spark, X.paragraph_chunks(F.lit("a\n\nb\n\n" + "c" * 600))) == ["a\n\nb", "c" * 600]
    assert one(spark, X.sliding_chunks(F.lit("word " * 300), 512, 64))[0].startswith("word")
    assert one(spark, X.limited(F.lit("aaaa bbbb"), 100)) == "aaaa bbbb"
    assert one(spark, X.token_chunks(F.lit(""), 8, 2)) == []
    assert one(spark, X.originality_score(F.lit("say"), F.lit("a b c"), F.lit("a b c"))) == 0.1
    assert one(spark, X.visible_text(F.lit("<p>a</p><script>x</script><!-- y --><nav>z</nav>"))) == "a"


def test_pair_scores_mark_repeats(spark):
    df = spark.createDataFrame([(1, "Explain this", "", "A long answer with many words in it."), (2, "explain this", "", "a long answer with many words in it.")], "pair_id long, instruction string, input string, output string")
    assert [r.is_duplicate for r in scoring.score_pairs(df).orderBy("pair_id").collect()] == [False, True]


def test_split_keeps_its_sides(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    n = {r["split"]: r["count"] for r in scoring.split_by_hash(df, "k").groupBy("split").count().collect()}
    assert 700 < n["train"] < 880 and sum(n.values()) == 1000


def test_ks_and_reliability(spark):
    a, b = spark.range(100).select(F.col("id").cast("double").alias("x")), spark.range(100).select((F.col("id") + 50).cast("double").alias("x"))
    r = drift.ks_statistic(a, b, "x").first()
    assert r.d == 0.5 and drift.ks_p_value(r.d, r.n1, r.n2) < 0.001 and drift.ks_p_value(0.0, 10, 10) == 1.0
    assert drift.drift_report(a, a).first().drifted is False
    assert training.reliability(20_000, 0.01, 0.95) == (100, "A")


def test_training(spark):
    df = spark.range(200).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).cast("string").alias("label"), (F.col("id") % 2 * 3.0).alias("b"))
    model, name, metrics = training.train(df, training.detect_target(df), ["a", "b"], folds=2)
    assert max(metrics.values()) > 0.95 and name in metrics
    assert "prediction" in model.transform(df.select("a", "b", "label")).columns


def test_features(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0), (None, 3.0)], "c string, v double")
    assert sorted(r.c for r in features.label_encode(df, "c").collect()) == [0, 1, 2]
    assert features.one_hot(df, "c", with_null=True).columns == ["v", "c_x", "c_y", "c_nan"]
    assert features.polynomial(df, ["v"]).columns == ["c", "v"]


def test_urls(spark):
    assert one(spark, relational.url_form(F.lit("HTTP://A.com/B/#x"))) == "http://a.com/B"


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,NA\n2,"x,y"\n')
    assert [tuple(r) for r in load_table(spark, str(tmp_path / "t.csv")).orderBy("a").collect()] == [(1, None), (2, "x,y")]
    (tmp_path / "s.json").write_text(json.dumps({"data": [{"instruction": "i", "output": "o"}]}))
    assert tuple(load_samples(spark, str(tmp_path / "s.json")).first()) == ("i", "", "o")
    with pytest.raises(ValueError, match="unsupported"):
        load_table(spark, str(tmp_path / "t.bin"))
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_bytes("é".encode("latin-1"))
    (docs / "b.xml").write_text("<r>one<b>two</b></r>")
    (docs / "c.bin").write_text("?")
    got = {r.source.rsplit("/", 1)[1]: r for r in load_documents(spark, str(docs)).collect()}
    assert got["a.txt"].text == "é" and got["b.xml"].text == "one\ntwo" and "unsupported" in got["c.bin"].error
    assert flatten_json({"a": 1, "b": {"c": 2}}) == "a: 1\nb:\n  c: 2"


def test_registry(spark, tmp_path):
    df = spark.createDataFrame([("i", None, "o")], "instruction string, input string, output string")
    save_jsonl(df, str(tmp_path / "out"))
    assert '"input":null' in "".join(f.read_text() for f in (tmp_path / "out").glob("*.json"))
    r = Registry(spark, str(tmp_path / "reg"))
    r.register("d", "v1", df)
    assert r.load("d", "v1").count() == 1 and content_hash(df) == r.index().first().content_hash
    with pytest.raises(ValueError, match="exists"):
        r.register("d", "v1", df)


def test_exact_search_of_many_queries(spark, monkeypatch):
    from millrace.operators import vectors

    index = spark.createDataFrame([(i, [float(i % 5), float(i % 3)]) for i in range(20)], "vec_id long, embedding array<double>")
    queries = index.where("vec_id < 8").selectExpr("vec_id as query_id", "embedding as query")
    want = {tuple(r) for r in vectors.exact_search(index, queries, 3).collect()}
    monkeypatch.setattr(vectors, "MOST_QUERIES", 3)
    assert len(want) == 24 and {tuple(r) for r in vectors.exact_search(index, queries, 3).collect()} == want


def test_greedy_keep_settles_or_raises(spark):
    from millrace.operators import vectors

    rows = spark.range(8).withColumnRenamed("id", "v")
    chain = spark.createDataFrame([(i, i + 1) for i in range(7)], "a long, b long")
    assert {r.v for r in vectors.greedy_keep(chain, rows, "v").collect()} == {0, 2, 4, 6}
    with pytest.raises(RuntimeError, match="settled"):
        vectors.greedy_keep(chain, rows, "v", most_rounds=2)


def test_smote_finds_the_nearest(spark):
    from millrace.operators import features

    # Pairs of rows that are far from all others: each new row lies between the two.
    df = spark.createDataFrame([(i, float(i // 2 * 1000 + i % 2), "P") for i in range(40)], "id long, v double, c string")
    got = sorted(r.v for r in features.smote(df, ["v"], "c", "P", "id", k=1, blocks=8).collect())
    assert len(got) == 40 and all(0 <= v % 1000 <= 1 and v // 1000 == i // 2 for i, v in enumerate(got))


def some_texts(spark, sf_dir, n=60):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").select("text").limit(n).collect()
    own = ["", "  ", "One. Two! Three? Four", "A. " * 90, "Short\nlines. Here\n\nand there.\n" * 12, "x" * 3000]
    return [r.text for r in rows] + own


def brute_sentences(text, size=512, overlapping=64):
    import re

    parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])|(?<=[.!?])\s*\n", text)]
    parts = [s for s in parts if s]
    out, i, begin = [], 0, []
    while i < len(parts):
        held = [*begin, parts[i]]
        i += 1
        while i < len(parts) and sum(map(len, held)) + len(parts[i]) <= size:
            held.append(parts[i])
            i += 1
        out.append(" ".join(held))
        n = 0
        while n < len(held) and sum(map(len, held[len(held) - n - 1 :])) <= overlapping:
            n += 1
        begin = held[len(held) - n :]
    return out or ([text] if text.strip() else [])


def test_sentence_chunks_overlap(spark, sf_dir):
    texts = [t for t in some_texts(spark, sf_dir) if t.isascii()]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", X.sentence_chunks(F.col("t")).alias("c")).collect()}
    assert got == {i: brute_sentences(t) for i, t in enumerate(texts)}
    assert any(brute_sentences(t) != brute_sentences(t, overlapping=0) for t in texts)


def test_chunks_are_settled(spark):
    short, long = ["a" * 10, "b" * 20], "word " * 500
    cases = [([], []), (["x"], ["x"]), ([*short, "c" * 60], ["a" * 10 + " " + "b" * 20 + " " + "c" * 60]), (["c" * 60, *short], ["c" * 60 + " " + "a" * 10 + " " + "b" * 20]), (short, ["a" * 10 + " " + "b" * 20])]
    for chunks, expected in cases:
        given = F.array(*map(F.lit, chunks)).cast("array<string>")
        assert one(spark, X.settled_chunks(given)) == expected
    cut = one(spark, X.settled_chunks(F.array(F.lit(long))))
    assert len(cut) > 4 and max(map(len, cut)) <= 512


def test_semantic_chunks(spark):
    text = "intro line\nProduct: A\nmore of it\nkey features: x\nSeller Y\nsummarised z"
    assert one(spark, X.semantic_chunks(F.lit(text), 10)) == ["intro line", "Product: A\nmore of it", "key features: x", "Seller Y\nsummarised z"]
    assert one(spark, X.semantic_chunks(F.lit(text), 1000)) == ["intro line\n\nProduct: A\nmore of it\n\nkey features: x\n\nSeller Y\nsummarised z"]
    assert one(spark, X.semantic_chunks(F.lit("  "), 10)) == []


def test_topics_and_points(spark):
    text = "The Great Wall is long. Touch id and 16 GB Unified Memory. New York, new york and Battery. Great Big Words are here. RATING"
    found = one(spark, pair_operators.topics(F.lit(text)))
    assert found == ["The Great Wall", "Unified Memory", "New York", "Great Big Words", "16 GB Unified Memory", "Touch id", "Battery", "RATING"]
    good = {"A sentence that says a thing of note": True, "short one": False, "see https://a.example for more of this": False, "lower case at the start of this one": False, "Files of the project are listed here:": False, "9 of them were there on that day at all": True, "123 456 789 012 345 678 901 234": False, "Here def f(x) is told of in some words": False}
    df = spark.createDataFrame(list(good.items()), "s string, expected boolean")
    assert df.where(pair_operators.is_summary_point(F.col("s")) != F.col("expected")).count() == 0
    assert one(spark, pair_operators.is_summary_point(F.lit(None).cast("string"))) is False
    assert one(spark, pair_operators.summary_point(F.lit(" - 1.2  a point..  made ; "))) == "a point. made"
    assert one(spark, pair_operators.segments(F.lit("• First part here. Second part there.\nno\n"))) == ["First part here.", "Second part there."]


def test_formats_and_their_parts(spark):
    pairs = spark.createDataFrame([(1, "Ask", "", "x"), (2, " ask ", "", "X"), (3, "ask", None, "y"), (4, "ask", "", "z"), (5, "ask", "given", "z"), (6, None, None, None)], "pair_id long, instruction string, input string, output string")
    for template in pair_operators.FORMATS:
        rows = pair_operators.format_pairs(pairs, template)
        got = rows.select("pair_id", pair_operators.instruction_of(F.col("row"), template).alias("i"), pair_operators.response_of(F.col("row"), template).alias("o")).collect()
        assert sorted(r.pair_id for r in got) == [1, 3, 5, 6] and {r.pair_id: r.o for r in got}[3] == "y"
    assert pair_operators.format_pairs(pairs.where("pair_id < 0")).count() == 0


def test_split_by_position_cuts_exactly(spark):
    for n in (0, 1, 7, 103):
        got = [r.split for r in pair_operators.split_by_position(spark.range(n).withColumnRenamed("id", "k"), "k").collect()]
        assert [got.count(s) for s in ("train", "validation", "test")] == [int(n * 0.8), int(n * 0.1), n - int(n * 0.8) - int(n * 0.1)]


def test_running_sum_over_ranges(spark):
    values = [(x, 1) for x in ["b", "a", "c", "a", "d", "é"] * 40] + [(None, 1)]
    df = spark.createDataFrame(values, "v string, one int").groupBy("v").agg(F.sum("one").alias("n"))
    got = {r.v: r.upto for r in profiling.running_sum(df, "v", "n", "upto").collect()}
    assert got == {None: 1, "a": 81, "b": 121, "c": 161, "d": 201, "é": 241}


def test_similar_pairs_of_blocks(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(3).standard_normal((120, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (500, None)], "vec_id long, embedding array<double>")
    expected = {(i, j) for i in range(120) for j in range(i + 1, 120) if x[i] @ x[j] >= 2}
    for rows in (4096, 25):
        monkeypatch.setattr(vectors, "BLOCK_ROWS", rows)
        got = vectors.similar_pairs(df, 2.0).collect()
        assert {(r.a, r.b) for r in got} == expected and len(got) == len(expected) > 100
    assert vectors.similar_pairs(df.where("vec_id < 0"), 2.0).count() == 0


def test_targets_and_baselines(spark):
    df = spark.createDataFrame([(float(i), i % 3, i % 10 == 0, 1.0) for i in range(300)], "a double, is_new int, Y_flag boolean, Price double")
    assert training.detect_target(df) == "Y_flag" and training.detect_target(df.drop("Y_flag")) == "is_new" and training.detect_target(df.select("a")) == "a"
    assert training.baseline(df, "Y_flag") == pytest.approx(0.9 * 2 * 0.9 / 1.9, abs=0.03)
    assert training.baseline(df, "a") == pytest.approx(0.0, abs=0.05)
    assert training.improvement(0.9, 0.6) == 50.0 and training.improvement(0.3, 0) == 30.0


def test_features_evolve_by_importance(spark):
    df = spark.range(2000).select((F.col("id") % 17 - 8).cast("double").alias("a"), (F.col("id") % 13 - 6).cast("double").alias("b"), F.lit(1.0).alias("c")).withColumn("y", (F.col("a") * F.col("b") > 0).cast("int"))
    out = features.auto_evolve(df, ["a", "b", "c"], "y")
    made = next(c for c in ("a_x_b", "b_x_a") if c in out.columns)
    assert out.columns[:4] == df.columns and out.count() == 2000
    assert features.drop_unimportant(out, ["c", made], "y").columns == [c for c in out.columns if c != "c"]
    assert features.drop_unimportant(df, ["a", "b", "c"], "y", keep=1).columns.count("y") == 1


def test_information_of_many_columns_takes_no_single_task_percentile(spark, monkeypatch):
    def merged(*_):
        raise AssertionError("all values of a column in one task")

    monkeypatch.setattr(features.F, "percentile", merged)
    nan, none = float("nan"), None
    rows = [(1.0, 1.0, "a"), (2.0, nan, "a"), (3.0, 1.0, "b"), (4.0, 9.0, "b"), (none, 9.0, "b"), (5.0, 5.0, none)]
    df = spark.createDataFrame(rows, "p double, q double, y string").withColumn("z", F.lit(None).cast("double"))
    assert features.importances(df, ["p", "q", "z"], "y", 2) == [("p", 0.6931), ("q", 0.2158), ("z", 0.0)]
    assert features.mutual_information(df, "z", "y").first().mi is None and features.mutual_information(df, "p", "y", 2).first().mi == 0.6931


def test_few_codes_are_sent_to_the_rows(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        coded = features.label_encode(spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "k int, v string"), "v")
        assert [r.v for r in coded.orderBy("k").collect()] == [2, 1, 0]
        assert "BroadcastHashJoin" in coded._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_boxplot_of_outliers_and_nulls(spark):
    df = spark.createDataFrame([(float(i), None) for i in range(1, 10)] + [(100.0, None)], "x double, z double")
    rows = profiling.boxplot(df, ["x", "z"]).collect()
    assert [(r.column_name, r.lower, r.median, r.upper, r.n_beyond) for r in rows] == [("x", 1.0, 5.5, 9.0, 1)]
    assert profiling.boxplot(df, ["z"]).count() == 0 and profiling.shape(df) == {"rows": 10, "columns": 2, "types": {"x": "double", "z": "double"}}


LAPTOP = """Product: Apple MacBook Air M2 (Silver, 256 GB)...
Price: INR 74,900.00
Rating: 4.5/5 (1,234 reviews)
16 GB Unified Memory, 256 GB SSD. 34.46 cm (13.6 inch) Liquid Retina Display
64 bit Windows 11 Home Operating System
50 MP + 12 MP | 12 MP Front Camera
Apple M2 Processor
1 year limited warranty
Touch ID
10 % off
1.24 kg"""
SAMPLE = "id int, instruction string, input string, output string"


def test_evidence_has_all_fields_and_nulls(spark):
    df = spark.createDataFrame([(1, LAPTOP, "kept"), (2, "", None), (3, None, None), (4, "nothing" * 50_000, None)], "id int, text string, seller string").orderBy("id")
    first, *rest = products.evidence(df).collect()
    assert first.product_name == "Apple MacBook Air M2 (Silver, 256 GB)" and first.brand == "Apple" and first.review_count == 1234
    assert (first.camera_rear, first.camera_front, first.chip, first.weight, first.seller) == ("50 MP + 12 MP", "12 MP", "Apple M2 Processor", "1.24 kg", None)
    assert all(getattr(r, c) is None for r in rest for c in products.RECORD if c != "raw_text") and [r.raw_text[:3] for r in rest] == ["", "", "not"]
    assert products.missing_specs(products.evidence(df)).where("id = 1").first().optional_missing == ["battery", "seller", "availability"]
    assert products.evidence(df.where("id > 9")).count() == 0


@pytest.mark.parametrize(
    "ask, said, issues",
    [
        ("What is the price and rating?", "Price: INR 74,900.00\nRating: 4.5", []),
        ("What is the price?", "Price: INR 74,901.00", ["not_grounded"]),
        ("What is the price?", "Price: INR 1\nPrice: INR 74,900.00", []),
        ("What is the price?", "Price: INR 74,900.00\nStorage: 256 GB SSD", ["instruction_mismatch"]),
        ("What is the price?", '{"price": "INR 74,900.00"}', ["instruction_mismatch"]),
        ("Extract JSON", '{"brand":"Sony","color":"x"}', ["hallucinated_fields", "instruction_mismatch", "not_grounded"]),
        ("Extract the brand", '```json\n{"brand": "apple"}\n```', []),
        ("Extract the brand", '{"brand": null}', ["not_grounded"]),
        ("Extract the brand", '{"brand":"Apple"} tail', ["invalid_json"]),
        ("Evaluate pros and cons", "Analysis: good 256 GB SSD Apple. Recommendation: buy", ["instruction_mismatch"]),
        ("Evaluate the battery", "Buy one", ["reasoning_format", "instruction_mismatch", "not_grounded"]),
        ("Summarize", "Apple MacBook Air M2 with 256 GB SSD", []),
        ("Which specifications are missing?", "The context does not provide information about seller.", []),
        ("Which specifications are missing?", "Several specifications", ["instruction_mismatch"]),
        (None, None, ["empty_output", "instruction_mismatch"]),
    ],
)
def test_strict_score(spark, ask, said, issues):
    row = spark.createDataFrame([(1, ask, LAPTOP + "\nBattery: good\nSeller: A\nAvailability: yes", said)], SAMPLE)
    assert strict_scoring.strict_score(row, "id").first().issues == issues


def test_strict_score_keeps_few_of_a_family(spark):
    told = ["What is the price?", "What is the storage?", "Summarize", "Extract the brand", "Evaluate"]
    said = ["Price: INR 74,900.00", "Storage: 256 GB SSD", "Apple MacBook Air M2", '{"brand": "Apple"}', "Analysis: 256 GB SSD Apple. Recommendation: yes"]
    rows = [(i, a, LAPTOP, o) for i, (a, o) in enumerate(zip(told, said))] + [(9, "Summarize", "no name", "no name")]
    scored = strict_scoring.strict_score(spark.createDataFrame(rows, SAMPLE), "id")
    assert [r.id for r in scored.where("passed").orderBy("id").collect()] == [0, 2, 3, 9]
    counts = {r.counter: r.n for r in strict_scoring.reject_counts(scored).collect()}
    assert counts["rejected_near_duplicate_family"] == 2 and counts["passed"] == 4 and len(counts) == 10
    assert {r.n for r in strict_scoring.reject_counts(scored.where("id > 99")).collect()} == {0}


def test_clean_dataset(spark):
    text = "MacBook Air M2 8 GB RAM 512 GB SSD Apple Buy Now | x"
    rows = [(1, "Extract", text, ""), (2, "hello", "", '```json\n{"Make":"Dell","product":"Inspiron 15","disk":null,"ssd":"1 TB SSD"}\n```'), (3, None, None, None), (4, "Extract", text, "")]
    out = dataset_tools.clean_dataset(spark.createDataFrame(rows, SAMPLE), "id").orderBy("id").collect()
    assert [r.id for r in out] == [1, 2] and out[1].instruction == dataset_tools.INSTRUCTION and out[1].input == "Dell, Inspiron 15, 1 TB SSD"
    assert out[0].output == '{"brand":"Apple","model":"MacBook Air M2","ram":"8GB","storage":"","memory_type":"RAM"}'


def test_verify_dataset(spark):
    text = "Product: Apple X\nPrice: INR 900\nRating: 4.5/5\n64 GB ROM"
    rows = [
        (1, "What is the price?", text, "Price: INR 900"),
        (2, "What is the price and warranty?", text, "It is cheap"),
        (3, "Explain why it is suitable", text, "Buy"),
        (4, "Extract the price", text, '{"price": "INR 900"}'),
        (5, "What is it?", "", "x"),
        (6, None, text, None),
    ]
    out = dataset_tools.verify_dataset(spark.createDataFrame(rows, SAMPLE))
    status = {r.id: (r.status, r.corrected_output) for r in out.collect()}
    assert status[1] == ("valid", "") and status[4] == ("valid", "") and status[5][0] == status[6][0] == "invalid"
    assert status[2] == ("corrected", "Price: INR 900\nThe context does not provide information about warranty.")
    assert status[3][1] == "<thought>The device has 64 GB storage, which supports heavier app and media usage. The rating of 4.5/5 indicates positive user feedback.</thought>\nRecommendation: Suitable for power users."
    assert [r.id for r in dataset_tools.corrected_dataset(out).orderBy("id").collect()] == [1, 2, 3, 4]


def test_product_rows_are_dealt_and_expressions_stand_once(spark):
    from millrace.plans.product_queries import texts

    few = spark.range(9).coalesce(1).selectExpr("id as p_partkey", "'N' as p_name", "'B' as p_brand", "'T' as p_type", "1.5D as p_retailprice", "1 as p_size")
    assert texts(lambda _: few).rdd.getNumPartitions() > 4
    plan = few.select(products.requested_fields(F.col("p_name")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


def test_numbers_of_an_input_do_not_run_together(spark):
    text = "Product: X\nPrice: INR 977\nRating: 4.5/5 (97777 reviews)\n1,299 cm Display"
    said = [(1, "What is the price?", text, "Price: INR 597777"), (2, "What is the price?", text, "Price: INR 977 for 1299 cm Display"), (3, "What is the price?", text, "Price: INR 99")]
    found = {r.id: r.issues for r in dataset_tools.verify_dataset(spark.createDataFrame(said, SAMPLE)).collect()}
    loose = "Hallucination: output field 'price' not grounded in input"
    assert loose in found[1] and found[2] == [] and loose in found[3]


def test_a_number_of_another_field_does_not_ground_a_fact(spark):
    text = "Product: X\nPrice: INR 977\nRating: 4.5/5 (597777 reviews)\n1,299 cm Display"
    said = [(1, "What is the price?", text, "Price: INR 597777"), (2, "Extract the price", text, '{"price": "Rs. 977", "reviews": "n=597,777"}'), (3, "What is the price?", text.replace("Price", "Cost"), "Price: INR 597777")]
    found = {r.id: r.issues for r in dataset_tools.verify_dataset(spark.createDataFrame(said, SAMPLE)).collect()}
    loose = "Hallucination: output field 'price' not grounded in input"
    assert loose in found[1] and found[2] == [] and loose not in found[3]


def test_lines_and_sentences_keep_digits_that_equal_their_place(spark):
    assert one(spark, X.clean_text(F.lit("a\n1219 b \n 22\n"))) == "a\n1219 b\n22"
    assert one(spark, X.sentences(F.lit("0 Ann. A 1 1.\n 2 B."))) == ["0 Ann.", "A 1 1.", "2 B."]


def test_extraction_fields_and_structured_payload(spark):
    assert one(spark, products.extraction_fields(F.lit("Extract the camera"))) == ["rear_camera", "front_camera"]
    assert one(spark, products.extraction_fields(F.lit("Extract the front camera"))) == ["front_camera"]
    assert one(spark, products.extraction_fields(F.lit(None).cast("string"))) == products.PAYLOAD
    df = spark.createDataFrame([({"brand": "Dell", "product_name": "Dell", "rating": "n/a", "reviews_count": "", "reviews": "1,2"},), ({},), (None,)], "m map<string,string>")
    first, *rest = [r.p for r in df.select(products.structured_payload(F.col("m")).alias("p")).collect()]
    assert (first.brand, first.model, first.rating, first.review_count) == ("Dell", "Dell", None, 12)
    assert all(set(r) == {None} for r in rest)
