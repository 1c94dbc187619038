"""Product evidence: fields of product texts, tasks over them, verification and correction, all as expressions.

Field rules are data: for each field the patterns that may hold it, the first that matches wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from .settled import back, held, let, settled

#: Patterns of the evidence fields: the first that matches gives the value (fixed values).
FIELDS = {
    "product_name": [r"(?:^|\n)\s*Product\s*:\s*(.+?)(?=\s*(?:\n|Price\s*:|Rating\s*:|Description\s*:|$))"],
    "price": [r"(?:^|\n)\s*Price\s*:\s*((?:INR|Rs\.?|₹|\$)\s*[\d,]+(?:\.\d+)?)"],
    "review_count": [r"(?:^|\n)\s*Rating\s*:\s*[\d.]+/5\s*\(([\d,]+)\s*reviews?\)"],
    "rating": [r"(?:^|\n)\s*Rating\s*:\s*([\d.]+/5)"],
    "ram": [r"(\d+\s*GB\s*Unified\s*Memory(?:\s*RAM)?)", r"(\d+\s*(?:GB|TB)\s*(?:LPDDR\d*X?|DDR\d*|SDRAM|RAM))"],
    "unified_memory": [r"(\d+\s*GB\s*Unified\s*Memory(?:\s*RAM)?)"],
    "storage": [r"(\d+\s*(?:GB|TB)\s*ROM)", r"(\d+\s*(?:GB|TB)\s*(?:SSD|HDD))"],
    "display": [r"(\d+(?:\.\d+)?\s*cm\s*\([^)]+\)\s*[^.\n]*Display)", r"(\d+(?:\.\d+)?\s*(?:inch|inches|\"|in)\s*[^.\n]*Display)"],
    "os": [
        r"((?:64\s*bit\s+)?(?:Windows\s*\d+(?:\s*(?:Home|Pro))?|Mac\s*OS|macOS(?:\s+[A-Za-z0-9]+)?|Chrome\s*OS)[^.\n]*Operating System)",
        r"(macOS\s+[A-Za-z0-9]+)",
        r"(Windows\s*11(?:\s*(?:Home|Pro))?)",
        r"(Mac\s*OS)",
    ],
    "camera_rear": [
        r"(\d+\s*MP(?:\s*\+\s*\d+\s*MP)*)\s*(?:Rear\s*Camera)?\s*\|\s*\d+\s*MP\s*Front\s*Camera",
        r"(Rear\s*Camera\s*[:\-]?\s*[^.\n]+)",
        r"(\d+\s*MP)\s*Rear\s*Camera",
        r"((?:\d+\s*MP\s*\+\s*)+\d+\s*MP)",
    ],
    "camera_front": [
        r"\d+\s*MP(?:\s*\+\s*\d+\s*MP)*\s*(?:Rear\s*Camera)?\s*\|\s*(\d+\s*MP)\s*Front\s*Camera",
        r"(\d+\s*MP)\s*Front\s*Camera",
    ],
    "chip": [
        r"((?:A|M)\d+\s*(?:Pro\s*)?(?:Bionic\s*)?Chip)",
        r"((?:Apple\s+)?(?:A|M)\d+\s*(?:Pro|Max|Ultra|Bionic)?\s*Processor)",
        r"((?:Intel|AMD)\s+[^\n,.;]*?\s*Processor)",
        r"((?:Snapdragon|Dimensity|Exynos)\s*[^\n,.;]*?\s*Processor)",
        r"(Tensor\s*[^\n,.;]*?\s*Processor)",
        r"((?:Snapdragon|Dimensity|Exynos)\s*[^\n,.;]+)",
        r"(Tensor\s*\w+)",
    ],
    "warranty": [r"((?:\(?\d+\)?\s*year|one\s*year)[^.\n]*warranty)"],
    "battery": [r"(?:^|\n)\s*Battery\s*[:\-]?\s*([^\n.]+)", r"(\d{3,5}\s*mAh[^.\n]*)"],
    "touch_id": [r"(Touch\s*ID)", r"(?:^|\n)\s*Touch\s*ID\s*[:\-]?\s*([^\n.]+)"],
    "seller": [r"(?:^|\n)\s*Seller\s*[:\-]?\s*([^\n]+)"],
    "availability": [r"(?:^|\n)\s*Availability\s*[:\-]?\s*([^\n]+)"],
    "discount": [r"(\d+\s*%\s*off)", r"(?:^|\n)\s*Discount\s*[:\-]?\s*([^\n]+)"],
    "weight": [r"(\d+(?:\.\d+)?\s*(?:kg|g)\b[^.\n]*)"],
}
#: Brands that a text may name (fixed values).
BRANDS = "acer apple asus dell google hp iqoo lenovo microsoft motorola msi nokia nothing oneplus oppo realme samsung sony vivo xiaomi".split()
#: The columns of an evidence record, in order (fixed values).
RECORD = ["product_name", "brand", "price", "review_count", "rating", "ram", "unified_memory", "storage", "display", "os", "camera_rear", "camera_front", "chip", "warranty", "battery", "touch_id", "seller", "availability", "discount", "weight", "raw_text"]
#: The keys of a payload, in order (fixed values).
PAYLOAD = ["brand", "category", "model", "price", "price_inr", "ram", "storage", "processor", "display", "os", "rating", "review_count", "rear_camera", "front_camera", "warranty"]
#: Fields that are named as missing only where a payload is complete (fixed values).
OPTIONAL = ["ram", "battery", "touch_id", "seller", "availability", "discount", "weight"]
#: Words that tell a category, in the order they are tried (fixed values).
CATEGORIES = {
    "tablet": ["ipad", "tablet", "surface pro"],
    "laptop": ["macbook", "thinkpad", "inspiron", "laptop", "notebook", "vivobook", "pavilion", "motobook", "galaxy book", "book4", "book 4", "intel core", "windows 11 operating system", "ssd"],
    "smartphone": ["iphone", "smartphone", "mobile", "pixel", "oneplus", "galaxy s", "galaxy z"],
}
#: Words that name a task in an instruction, in the order they are tried (fixed values).
TASKS = {
    "extraction": ["json", "extract", "parse", "structured", "machine-readable", "product data"],
    "summarization": ["summarize", "summary", "summarise", "condense", "overview", "concise", "in a nutshell", "briefly describe"],
    "reasoning": ["reason", "step-by-step", "evaluate", "assess", "overall quality", "pros and cons", "trade-off", "tradeoff", "recommend", "power user", "good value", "why someone might buy", "explain why", "advantages and disadvantages", "break down"],
}
#: Phrases that ask for a field, as whole words (fixed values).
HINTS = {
    "model": ["product name", "name", "model"],
    "brand": ["brand"],
    "price": ["price", "cost"],
    "price_inr": ["price inr", "numeric price"],
    "rating": ["rating", "review"],
    "review_count": ["review count", "number of reviews"],
    "storage": ["storage", "rom", "ssd", "hdd"],
    "display": ["display", "screen"],
    "rear_camera": ["rear camera", "camera"],
    "front_camera": ["front camera", "selfie camera"],
    "processor": ["chip", "processor", "soc"],
    "os": ["operating system", "os"],
    "warranty": ["warranty"],
    "category": ["category", "type"],
    "discount": ["discount", "offer", "off"],
    "seller": ["seller"],
    "availability": ["availability", "delivery", "in stock", "out of stock"],
    "battery": ["battery"],
    "touch_id": ["touch id", "touchid"],
    "ram": ["ram"],
    "unified_memory": ["unified memory", "memory capacity"],
    "weight": ["weight"],
}
#: Parts of an instruction that ask for the whole payload (fixed values).
WHOLE = ["spec", "all available", "json", "structured", "machine-readable", "product info"]


def phrase(words: str) -> str:
    """A pattern of whole words with any blanks between them."""
    return r"\b" + r"\s+".join(words.split()) + r"\b"


def source_form(text: Column) -> Column:
    """A product text with one kind of line end, at most one empty line in a row, single blanks."""
    for pattern, by in ((r"\r", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]+", " ")):
        text = F.regexp_replace(text, pattern, by)
    return X.stripped(F.coalesce(text, F.lit("")))


def first_match(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(X.stripped(F.regexp_extract(text, "(?i)" + p, 1)), F.lit("")) for p in patterns])


def whole_name(name: Column) -> Column:
    """A product name without the dots or dashes of a cut title, null if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(X.stripped(name), r"\.{3,}$", ""), r"\s*…+$", "")
    return F.nullif(X.stripped(F.regexp_replace(bare, r"[\s-]+$", "")), F.lit(""))


def named_brand(name: Column, text: Column) -> Column:
    """The first word of the name if it is one of BRANDS, else the first of them, by the alphabet, that the text names."""
    head = F.regexp_replace(F.lower(F.regexp_extract(name, r"^(\S+)", 1)), r"^[ ,.-]+|[ ,.-]+$", "")
    said = F.array_min(F.regexp_extract_all(F.lower(text), F.lit(r"\b(" + "|".join(BRANDS) + r")\b"), 1))
    return F.initcap(F.when(head.isin(*BRANDS), head).otherwise(said))


def evidence(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of RECORD beside those of df: null where the text holds no such field; raw_text is never null."""
    raw = df.withColumn("raw_text", source_form(F.col(text)))
    found = raw.withColumns({name: first_match(F.col("raw_text"), patterns) for name, patterns in FIELDS.items()})
    tidy = found.withColumns({
        "product_name": whole_name(F.col("product_name")),
        "review_count": F.regexp_replace("review_count", ",", "").try_cast("long"),
        "chip": F.regexp_replace(F.regexp_replace("chip", r"\s+", " "), r"^[ ,.-]+|[ ,.-]+$", ""),
    })
    named = tidy.withColumn("brand", named_brand(F.col("product_name"), F.col("raw_text")))
    return named.select(*[c for c in df.columns if c not in RECORD], *RECORD)


def brand_of(name: Column, vocabulary: list[str]) -> Column:
    """The first word if it is a brand, else the first brand in order that the name holds."""
    low = F.lower(name)
    head = F.element_at(F.split(F.trim(name), " "), 1)
    known = F.array(*[F.lit(v) for v in sorted(vocabulary)])
    inside = F.filter(known, lambda v: F.contains(F.concat(F.lit(" "), low, F.lit(" ")), F.concat(F.lit(" "), F.lower(v), F.lit(" "))))
    return F.when(F.array_contains(F.transform(known, F.lower), F.lower(head)), head).otherwise(F.get(inside, F.lit(0)))


def category_of(text: Column) -> Column:
    """The first of CATEGORIES with a word in the text, else electronics."""
    out = F.when(F.lit(False), "")
    for name, words in CATEGORIES.items():
        out = out.when(F.rlike(F.lower(text), F.lit("|".join(words))), name)
    return out.otherwise("electronics")


def derive_model(name: Column, brand: Column) -> Column:
    starts = F.startswith(F.lower(name), F.concat(F.lower(brand), F.lit(" ")))
    return F.when(starts, F.trim(F.substr(name, F.length(brand) + 2))).otherwise(name)


def price_value(text: Column) -> Column:
    """'₹1,299', '1.5k', '2 lakh' as a number."""
    number = lambda p: F.regexp_replace(F.regexp_extract(text, p, 1), ",", "").try_cast("double")
    thousand, lakh = number(r"(?i)([\d,]+\.?\d*)\s*k"), number(r"(?i)([\d,]+\.?\d*)\s*(?:lakh|l)")
    return F.coalesce(thousand * 1000, lakh * 100000, number(r"([\d,]+\.?\d*)"))


def price_int(text: Column) -> Column:
    """The digits of a price as a whole number, halves to even."""
    return F.bround(F.regexp_replace(text, "[^0-9.]", "").try_cast("double"), 0).cast("long")


def rating_value(text: Column) -> Column:
    r = F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(r.between(0, 5), r)


def discount(price: Column, original: Column) -> Column:
    return F.when(original > price, F.bround((1 - price / original) * 100, 0).cast("int"))


def intent_text(instruction: Column) -> Column:
    """What is asked, without parentheses and what follows for, of, about, regarding."""
    def cut(low: Column) -> Column:
        out = low
        for word in reversed([" for ", " of ", " about ", " regarding "]):
            out = F.when(F.contains(low, F.lit(word)), F.substring_index(low, word, 1)).otherwise(out)
        return F.trim(F.regexp_replace(out, r"\s+", " "))

    return let(F.regexp_replace(F.lower(instruction), r"\([^)]*\)", " "), cut)


def requested_fields(instruction: Column) -> Column:
    """The fields an instruction asks for, in the order of HINTS; some words ask for the whole payload."""
    def asked(ask: Column, whole: Column) -> Column:
        has = lambda *words: F.rlike(ask, F.lit("|".join(map(phrase, words))))
        found = {f: has(*h) for f, h in HINTS.items()}
        found["front_camera"] = found["front_camera"] | (has("camera") & ~has("rear camera", "front camera"))
        return F.array_compact(F.array(*[F.when(whole | a if f in PAYLOAD else a, F.lit(f)) for f, a in found.items()]))

    return let(intent_text(instruction), lambda ask: let(F.rlike(ask, F.lit("|".join(WHOLE))), lambda whole: asked(ask, whole)))


def task_type(instruction: Column, order: tuple[str, ...] = ("extraction", "summarization", "reasoning")) -> Column:
    low, out = F.lower(instruction), F.when(F.lit(False), "")
    for task in order:
        out = out.when(F.rlike(low, F.lit("|".join(TASKS[task]))), task)
    return out.otherwise("qa")


def missing_fields(output: Column) -> Column:
    """The fields of 'The context does not provide information about a, b and c.', in their normal form."""
    listed = F.regexp_extract(output, r"(?i)the context does not provide information about\s+([^.\n]+)", 1)
    return F.filter(F.transform(F.split(listed, r",| and "), X.match_form), lambda x: x != "")


def asks_missing_specs(instruction: Column) -> Column:
    low = F.lower(instruction)
    return F.rlike(low, F.lit(phrase("missing"))) & F.rlike(low, F.lit(r"\b(?:specifications?|specs)\b"))


def family_key(name: Column) -> Column:
    return X.match_form(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""))


def grounded(value: Column, source: Column) -> Column:
    """A value is in its source, by normal form or by its digits."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.contains(X.match_form(source), X.match_form(value)) | ((digits != "") & F.contains(F.regexp_replace(source, r"\D", ""), digits))


def expected(*, text: str = "raw_text") -> dict[str, Column]:
    """The values of PAYLOAD over the columns of an evidence record."""
    c = F.col
    rating = F.bround(F.regexp_extract("rating", r"([\d.]+)", 1).try_cast("double"), 1)
    return dict(zip(PAYLOAD, [
        c("brand"), category_of(F.concat_ws(" ", "product_name", text)), whole_name(derive_model(c("product_name"), F.coalesce("brand", F.lit("\n")))),
        c("price"), price_int(c("price")), F.coalesce("unified_memory", "ram"), c("storage"), c("chip"), c("display"), c("os"), rating,
        c("review_count"), c("camera_rear"), c("camera_front"), c("warranty"),
    ], strict=True))


def payload(df: DataFrame) -> DataFrame:
    """An evidence record's payload: a JSON object of all 15 keys, nulls included."""
    return df.withColumn("payload", F.to_json(F.struct(*[v.alias(k) for k, v in expected().items()]), {"ignoreNullFields": "false"}))


def missing_specs(df: DataFrame) -> DataFrame:
    """core_missing and optional_missing of evidence records: fields without a value, by their names in words."""
    lacks = lambda v: F.coalesce(v.cast("string"), F.lit("")).isin("", "0", "0.0")
    listed = lambda fields: F.array_compact(F.array(*[F.when(lacks(v), F.lit(k.replace("_", " "))) for k, v in fields.items()]))
    spare = {k: F.coalesce("unified_memory", "ram") if k == "ram" else F.col(k) for k in OPTIONAL}
    return df.withColumns({"core_missing": listed(expected()), "optional_missing": listed(spare)})


#: The instructions of a task, of which a record takes one by its model (fixed values).
ASKED = {
    "extraction": ["Extract the product specifications in JSON.", "Parse the given text and return a JSON containing product specs.", "Provide a structured JSON output of the product features.", "Return the product data in a machine-readable JSON format."],
    "qa_price": ["What is the price of this product?", "How much does this product cost?", "Tell me the current listed price for this item."],
    "qa_storage": ["Can you tell me the RAM and storage for this product?", "What are the memory and storage specifications?"],
    "summary": ["Summarize the key features of this product.", "Give a concise 2-line summary of this product.", "Provide a brief overview of the key specs and price."],
    "reasoning": ["Based on the specs, explain why someone might buy this product.", "Evaluate whether this product looks like good value from the provided details."],
}
ASKED_BOTH = "What is the price and rating of this product?"


def is_cut(model: Column) -> Column:
    """A model is missing, or its name was cut short."""
    m = F.coalesce(F.trim(model), F.lit(""))
    return (m == "") | F.contains(m, F.lit("...")) | F.contains(m, F.lit("…")) | F.endswith(m, F.lit("-"))


def tasks_of(df: DataFrame, key: str) -> DataFrame:
    """(key, task_type, instruction, input, output) of the tasks that an evidence record's fields allow; none if its model is cut.

    Each record gives an extraction of the whole payload and a summary of two lines; one question, the first of price and
    rating, RAM and storage, price, storage whose fields are known; and, with a processor or a storage, a reasoning that calls
    three points of evidence or more good value. A rating of 0 counts as unknown.
    """
    c = F.col
    known = settled(payload(df), [c(key).alias("_key"), c("text").alias("_text")], **(expected() | {"payload": c("payload")})).where(~is_cut(c("model")))
    rating = F.nullif(c("rating"), F.lit(0.0)).cast("string")
    told = lambda before, value, after="": F.concat(F.lit(before), value, F.lit(after))

    def ask(kind: str) -> Column:
        lot = F.conv(F.substring(F.md5(F.concat("model", F.lit(f"|{kind}"))), 1, 8), 16, 10).cast("long") % len(ASKED[kind])
        return F.element_at(F.array(*map(F.lit, ASKED[kind])), (lot + 1).cast("int"))

    row = lambda kind, asked, out: F.struct(F.lit(kind).alias("task_type"), asked.alias("instruction"), c("_text").alias("input"), out.alias("output"))
    stored = F.concat_ws("\n", told("Ram: ", c("ram")), told("Storage: ", c("storage")))
    both, stores = c("price").isNotNull() & rating.isNotNull(), c("ram").isNotNull() & c("storage").isNotNull()
    question = (
        F.when(both, row("qa", F.lit(ASKED_BOTH), F.concat(told("Price: ", c("price")), told("\nRating: ", rating)))).when(stores, row("qa", ask("qa_storage"), stored))
        .when(c("price").isNotNull(), row("qa", ask("qa_price"), c("price"))).when(c("storage").isNotNull(), row("qa", ask("qa_storage"), told("Storage: ", c("storage"))))
    )
    first = F.concat_ws(" • ", F.concat("model", F.lit(" by "), F.coalesce("brand", F.lit("Unknown brand"))), "ram", "storage")
    second = F.nullif(F.concat_ws(" | ", "processor", "display", "os", told("Price: ", c("price")), told("Rating: ", rating)), F.lit(""))
    summary = F.concat(first, F.lit("\n"), F.coalesce(second, F.lit("Specs available in product description.")))
    thoughts = F.concat_ws(
        " ", told("Storage is ", c("storage"), ", which supports heavier usage."), told("Processor is ", c("processor"), ", suggesting performance potential."),
        told("Rating is ", rating, ", indicating user feedback quality."), told("Price is ", c("price"), ", relevant for value evaluation."),
    )
    points = sum((v.isNotNull().cast("int") for v in (c("storage"), c("processor"), c("price"), c("warranty"), rating)), F.lit(0))
    advice = F.when(points >= 3, "Based on available evidence, this product appears to offer good value.").otherwise("Value is uncertain due to missing evidence.")
    reasoning = F.concat(F.lit("Analysis: "), thoughts, F.lit("\nRecommendation: "), advice)
    made = F.array(
        row("extraction", ask("extraction"), c("payload")), question, row("summarization", ask("summary"), summary),
        F.when(c("processor").isNotNull() | c("storage").isNotNull(), row("reasoning", ask("reasoning"), reasoning)),
    )
    return known.select(c("_key").alias(key), F.explode(F.array_compact(made)).alias("t")).select(key, "t.*")


def verified(samples: DataFrame) -> DataFrame:
    """Samples (instruction, input, output) with issues, status and corrected_output.

    Fields that are asked for and in the input must be in the output; those that aren't must be named as missing; numbers of
    the output must be grounded.
    """
    kept = [c for c in samples.columns if c not in ("issues", "status", "corrected_output")]
    named = samples.select(*held(kept), F.col("input").alias("_in"), F.col("instruction").alias("_ask"), F.col("output").alias("_out"))
    found = evidence(named.withColumn("_asked", requested_fields(F.col("_ask"))), "_in")
    value = expected() | {f: F.col(f) for f in HINTS if f not in PAYLOAD}
    have = F.array_compact(F.array(*[F.when(F.array_contains("_asked", f) & value[f].isNotNull(), F.struct(F.lit(f).alias("f"), value[f].cast("string").alias("v"))) for f in HINTS]))
    lack = F.array_compact(F.array(*[F.when(F.array_contains("_asked", f) & value[f].isNull(), F.lit(f)) for f in HINTS]))
    ask, given, said = F.col("_ask"), F.coalesce("_in", F.lit("")), F.coalesce("_out", F.lit(""))
    left_out = F.filter(have, lambda x: ~F.contains(X.match_form(said), X.match_form(x["v"])))
    loose = F.filter(F.regexp_extract_all(said, F.lit(r"(\d[\d,.]*\d|\d)"), 1), lambda n: ~F.contains(F.regexp_replace(given, "[,.]", ""), F.regexp_replace(n, "[,.]", "")))
    kind = task_type(ask)
    issues = F.array_compact(F.array(
        F.when(F.trim(said) == "", "empty output"),
        F.when((kind == "extraction") & X.json_object(said).isNull(), "not JSON"),
        F.when((kind == "qa") & (F.size(left_out) > 0), "field left out"),
        F.when((kind == "qa") & (F.size(lack) > 0) & (F.size(missing_fields(said)) == 0), "missing field not named"),
        F.when(F.size(loose) > 0, "number not grounded"),
    ))
    words = lambda f: F.replace(f, F.lit("_"), F.lit(" "))
    told = F.array_join(F.transform(have, lambda x: F.concat(F.initcap(words(x["f"])), F.lit(": "), x["v"])), ". ")
    none = F.when(F.size(lack) > 0, F.concat(F.lit("The context does not provide information about "), words(F.array_join(lack, ", ")), F.lit(".")))
    fixed = F.when(F.size("_issues") == 0, F.col("_out")).when((kind == "qa") & (F.size("_asked") > 0), F.concat_ws(" ", F.nullif(told, F.lit("")), none))
    out = found.withColumn("_issues", issues).withColumn("_fixed", fixed)
    status = F.when(F.size("_issues") == 0, "valid").when(F.col("_fixed").isNotNull(), "corrected").otherwise("invalid")
    return settled(out, back(kept), issues=F.col("_issues"), status=status, corrected_output=F.col("_fixed"))


def family_quota(df: DataFrame, family: str, task: str, order: str, per_task: int = 1, total: int = 3) -> DataFrame:
    """Of each family so many rows of a task, and so many in all; rows without family pass."""
    has = F.col(family).isNotNull()
    one = df.withColumn("_r", F.row_number().over(W.partitionBy(family, task).orderBy(order))).where(~has | (F.col("_r") <= per_task))
    return one.withColumn("_r", F.row_number().over(W.partitionBy(family).orderBy(order))).where(~has | (F.col("_r") <= total)).drop("_r")


#: Promotion and page furniture in product texts, in any letter case (fixed values).
NOISE = [
    r"Up to \d+% back with.*?(?:card|pay)\b",
    r"(?:FREE|free)\s+delivery.*",
    r"\d+\s*-\s*\d+\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)",
    r"This item will be released on.*",
    r"Price,?\s*product\s*page",
    r"EMI\s+(?:available|starts?).*",
    r"(?:Save|Get)\s+extra.*?(?:coupon|offer|cashback).*",
    r"Fulfilled by.*",
    r"\b(?:Add to (?:Cart|Wishlist)|Buy Now)\b",
    r"Sponsored\b.*",
    r"See more product details",
    r"(?:₹|\$|USD|INR)\s*\n\s*(?:₹|\$|USD|INR)?\s*[\d,]+",
    r"(?:Limited time deal|Lightning deal|Best Seller)\b.*",
    r"No Cost EMI\b.*",
    r"Offers?\b.*",
]


def without_noise(text: Column) -> Column:
    """A product text rid of promotion, of lines that are a price alone or under three characters, and of repeated signs."""
    for pattern in NOISE:
        text = F.regexp_replace(text, f"(?i){pattern}", "")
    lines = F.split(F.regexp_replace(text, r"\n{3,}", "\n\n"), "\n")
    kept = F.filter(lines, lambda l: ~F.rlike(X.stripped(l), F.lit(r"^[₹$€£]?\s*[\d,]+\.?\d*$")) & ~F.length(X.stripped(l)).between(1, 2))
    out = X.stripped(F.array_join(kept, "\n"))
    for pattern, by in ((r" {2,}", " "), (r"(?i)\b(off)(?:\s+off)+\b", "$1"), (r"[|]{2,}", "|"), (r"[.]{3,}", "..."), (r"[ \t]+\n", "\n")):
        out = F.regexp_replace(out, pattern, by)
    return out


def pros(rating: Column, discount_text: Column, features: Column) -> Column:
    """What speaks for a product: a rating from 4, a discount, its first features; four at most."""
    shown = F.regexp_replace(discount_text, r"(?i)\b(off)(?:\s+off)+\b", "$1")
    said = F.array(F.when(rating >= 4.0, F.concat(F.lit("High rating ("), rating.cast("string"), F.lit("/5)"))), F.when(F.length(discount_text) > 0, F.concat(F.lit("Discount available ("), shown, F.lit(")"))))
    some = F.coalesce(F.transform(F.slice(features, 1, 3), lambda f: F.substring(f, 1, 80)), F.array().cast("array<string>"))
    return F.slice(F.array_compact(F.concat(said, some)), 1, 4)


def cons(rating: Column, n_reviews: Column) -> Column:
    """What speaks against it: a rating under 3.5, fewer than 50 reviews."""
    return F.array_compact(F.array(F.when(rating < 3.5, F.concat(F.lit("Lower rating ("), rating.cast("string"), F.lit("/5)"))), F.when(n_reviews < 50, F.lit("Limited review volume"))))


def is_valid_product(title: Column, price: Column, description: Column) -> Column:
    said = lambda c: F.coalesce(F.length(F.trim(c.cast("string"))) > 0, F.lit(False))
    return said(title) & (said(price) | said(description))


def non_empty(record: Column) -> Column:
    """The entries of a map that hold something."""
    return F.map_filter(record, lambda _, v: F.coalesce(F.trim(v) != "", F.lit(False)))


def subset(record: Column, wanted: Column) -> Column:
    """A map with all its keys, null where the key isn't wanted."""
    return F.transform_values(record, lambda k, v: F.when(F.array_contains(wanted, k), v))


#: Parts of an instruction that ask for all of PAYLOAD, and those that ask for one key (fixed values).
WHOLE_EXTRACTION = ["all technical specifications", "all available", "key specifications", "structured json output", "structured json", "machine-readable", "product info", "product data", "json dictionary", "json containing specs", "specifications for", "specifications in json", "features for"]
EXTRACTION_HINTS = {
    "brand": ["brand"],
    "category": ["category"],
    "model": ["model", "product name", "name"],
    "price": ["price", "cost"],
    "price_inr": ["numeric price", "price inr", "price_inr"],
    "ram": ["ram", "memory", "unified memory"],
    "storage": ["storage", "rom"],
    "os": ["operating system", "os", "windows", "mac os", "macos"],
    "display": ["display", "screen"],
    "rating": ["rating"],
    "review_count": ["review count", "number of reviews", "reviews"],
    "rear_camera": ["rear camera"],
    "front_camera": ["front camera"],
    "processor": ["processor", "chip"],
    "warranty": ["warranty"],
}
#: The names under which a structured product may hold a key of PAYLOAD, in the order they are tried (fixed values).
PRODUCT_KEYS = {
    "ram": ["ram", "unified_memory"],
    "processor": ["processor", "chip"],
    "rear_camera": ["rear_camera", "camera_rear", "camera"],
    "front_camera": ["front_camera", "camera_front"],
    "review_count": ["review_count", "reviews_count", "reviews"],
}


def extraction_fields(instruction: Column) -> Column:
    """The keys of PAYLOAD that an instruction asks an extraction for, in their order; all of them if it names none."""
    low = F.lower(F.coalesce(instruction, F.lit("")))
    has = lambda words: F.rlike(low, F.lit("|".join(words)))
    either = has(["camera"]) & ~has(["rear camera", "front camera"])
    named = F.array_compact(F.array(*[F.when(has(EXTRACTION_HINTS[k]) | (either if k.endswith("camera") else F.lit(False)), F.lit(k)) for k in PAYLOAD]))
    return F.when(has(WHOLE_EXTRACTION) | (F.size(named) == 0), F.array(*map(F.lit, PAYLOAD))).otherwise(named)


def structured_payload(record: Column) -> Column:
    """A struct of PAYLOAD from a map of a product's own keys; numbers that can't be read are null."""
    said = lambda k: F.nullif(X.stripped(F.element_at(record, k)), F.lit(""))
    value = {k: F.coalesce(*map(said, PRODUCT_KEYS.get(k, [k]))) for k in PAYLOAD}
    name = said("product_name")
    value["model"] = F.coalesce(F.nullif(derive_model(name, F.coalesce(value["brand"], F.lit("\n"))), F.lit("")), name)
    value["price_inr"] = price_int(value["price"])
    value["rating"] = F.bround(value["rating"].try_cast("double"), 1)
    value["review_count"] = F.replace(value["review_count"], F.lit(","), F.lit("")).try_cast("long")
    return F.struct(*[value[k].alias(k) for k in PAYLOAD])
