"""Tasks made of product texts, by values: against the rules in plain Python."""

import hashlib
import json

import pytest

from millrace.operators import products as P

FULL = "Product: Dell Inspiron 15\nPrice: INR 50,000\nRating: 4.5/5 (12 reviews)\nIntel Core i5 Processor\n8 GB DDR4 RAM. 512 GB SSD. 2 Year Domestic Warranty."
TEXTS = {
    1: FULL,
    2: "Product: Dell Inspiron 15\n8 GB DDR4 RAM. 512 GB SSD.",
    3: "Product: Nix One\nPrice: INR 900",
    4: "Product: Nix One\n512 GB SSD.",
    5: "Product: Nix One\nBattery: 5000 mAh",
    6: "Price: INR 900\n512 GB SSD.",
    7: "Product: Nix One\nPrice: INR 900\nRating: 0/5",
    8: "Product: Nix… One\nPrice: INR 900",
}


def picked(kind, model):
    return P.ASKED[kind][int(hashlib.md5(f"{model}|{kind}".encode()).hexdigest()[:8], 16) % len(P.ASKED[kind])]


@pytest.fixture(scope="module")
def made(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "id long, text string")
    out = {}
    for r in P.tasks_of(P.evidence(df), "id").collect():
        assert r.input == TEXTS[r.id] and r.task_type not in out.setdefault(r.id, {})
        out[r.id][r.task_type] = (r.instruction, r.output)
    return out


def test_kinds(made):
    kinds = {k: sorted(v) for k, v in made.items()}
    rest = ["extraction", "summarization"]
    assert kinds == {1: sorted([*rest, "qa", "reasoning"]), 2: sorted([*rest, "qa", "reasoning"]), 3: sorted([*rest, "qa"]), 4: sorted([*rest, "qa", "reasoning"]), 5: rest, 7: sorted([*rest, "qa"])}


def test_questions_in_their_order(made):
    assert made[1]["qa"] == (P.ASKED_BOTH, "Price: INR 50,000\nRating: 4.5")
    assert made[2]["qa"] == (picked("qa_storage", "Inspiron 15"), "Ram: 8 GB DDR4\nStorage: 512 GB SSD")
    assert made[3]["qa"] == made[7]["qa"] == (picked("qa_price", "Nix One"), "INR 900")
    assert made[4]["qa"] == (picked("qa_storage", "Nix One"), "Storage: 512 GB SSD")


def test_extraction_summary_and_reasoning(made):
    ask, out = made[1]["extraction"]
    assert ask == picked("extraction", "Inspiron 15") and list(json.loads(out)) == P.PAYLOAD and json.loads(out)["price_inr"] == 50000
    assert made[1]["summarization"] == (picked("summary", "Inspiron 15"), "Inspiron 15 by Dell • 8 GB DDR4 • 512 GB SSD\nIntel Core i5 Processor | Price: INR 50,000 | Rating: 4.5")
    assert made[5]["summarization"][1] == "Nix One by Unknown brand\nSpecs available in product description."
    good = "Recommendation: Based on available evidence, this product appears to offer good value."
    said = "Analysis: Storage is 512 GB SSD, which supports heavier usage. Processor is Intel Core i5 Processor, suggesting performance potential. Rating is 4.5, indicating user feedback quality. Price is INR 50,000, relevant for value evaluation."
    assert made[1]["reasoning"] == (picked("reasoning", "Inspiron 15"), f"{said}\n{good}")
    assert made[4]["reasoning"][1] == "Analysis: Storage is 512 GB SSD, which supports heavier usage.\nRecommendation: Value is uncertain due to missing evidence."
