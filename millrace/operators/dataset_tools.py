"""Cleaning and verifying whole instruction datasets about products, as expressions over one row; only repeats need a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .products import intent_text, phrase
from .settled import back, held, let, settled

#: Scraped phrases that go from every text (fixed values).
SCRAPED = [r"\bBuy\s*Now\b", r"\bWithout\s*Charger\b", r"\bLimited\s*Offer\b", r"\bFree\s*Delivery\b", r"\|+"]
#: Brands in the order they are tried (fixed values).
BRANDS = ["Apple", "Samsung", "Lenovo", "Dell", "HP", "Asus", "Acer", "MSI", "Sony", "LG", "Xiaomi", "OnePlus", "Realme", "Vivo", "Oppo"]
#: Patterns of models in the order they are tried (fixed values).
MODELS = [r"\b(MacBook\s+Air(?:\s+M\d+)?)\b", r"\b(MacBook\s+Pro(?:\s+M\d+)?)\b", r"\b(Inspiron\s+\d+)\b", r"\b(ThinkPad\s+[A-Za-z0-9]+)\b", r"\b(Pavilion\s+[A-Za-z0-9]+)\b", r"\b(Vivobook\s+[A-Za-z0-9]+)\b"]
#: Sizes of memory, with its kind, and of storage (fixed values).
MEMORY = r"\b(\d+\s?(?:GB|TB))\s*(Unified\s*Memory|RAM|Memory)?\b"
STORAGE = r"\b(\d+\s?(?:GB|TB)\s*(?:SSD|HDD|Storage)?)\b"
#: The keys of an output, each with the names it may have had, in the order they are tried (fixed values).
ALIASES = {
    "brand": ["brand", "manufacturer", "make"],
    "model": ["model", "product_name", "product", "title", "device"],
    "ram": ["ram", "memory", "unified_memory"],
    "storage": ["storage", "ssd", "hdd", "disk"],
    "memory_type": ["memory_type", "memorytype", "ram_type"],
}
#: The instruction of samples whose own doesn't ask for an extraction, and the words of those that do (fixed values).
INSTRUCTION = "Extract product specifications"
EXTRACTING = ["extract", "spec", "specification", "feature", "json", "product"]

#: Fields that the verifier reads from a text (fixed values).
FACTS = {
    "product_name": r"Product:\s*(.*)",
    "price": r"Price:\s*(INR\s*[\d,\.]+)",
    "rating": r"Rating:\s*([\d\.]+/5)",
    "storage": r"(\d+\s*(?:GB|TB))\s*ROM",
    "display": r"(\d+\.?\d*\s*cm.*Display)",
    "chip": r"([A-Z]\d+\s*Chip|Snapdragon\s*[\w\s]+|Dimensity\s*[\w\s]+)",
    "warranty": r"(\d+\s*year.*warranty)",
}
#: Words that ask the verifier for a field, and those that ask for all of FACTS (fixed values).
ASKS = {
    "brand": ["brand"],
    "price": ["price", "cost"],
    "rating": ["rating", "review"],
    "storage": ["storage", "rom", "ssd"],
    "display": ["display", "screen"],
    "chip": ["chip", "processor", "soc"],
    "warranty": ["warranty"],
    "product_name": ["product", "name", "model"],
}
ALL = ["spec", "key specifications", "attributes", "details"]
#: Words that tell the verifier the task, in order; all else is a question (fixed values).
KINDS = {
    "extraction": ["extract", "json", "structured", "parse", "identify", "spec", "attribute"],
    "reasoning": ["reason", "step-by-step", "recommend", "why", "good for", "suitable", "explain"],
}

strings = "array<string>"


def without_scraps(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    for pattern in SCRAPED:
        text = F.regexp_replace(text, f"(?i){pattern}", " ")
    return X.stripped(F.regexp_replace(text, r"\s+", " "))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return X.stripped(F.regexp_extract(text, f"(?i){pattern}", group))


def specs_of(text: Column) -> dict[str, Column]:
    """The five output fields as a text tells them, empty where it doesn't."""
    none = F.lit("")
    brand, model = F.when(F.lit(False), ""), none
    for name in BRANDS:
        brand = brand.when(F.rlike(text, F.lit(rf"(?i)\b{name}\b")), name)
    for pattern in reversed(MODELS):
        model = F.coalesce(F.nullif(_found(text, pattern), none), model)
    ram = F.replace(F.upper(_found(text, MEMORY)), F.lit(" "), none)
    kind = _found(text, MEMORY, 2)
    unified = F.rlike(kind, F.lit("(?i)unified")) | ((kind == "") & F.rlike(text, F.lit(r"(?i)unified\s*memory")))
    size = F.upper(_found(text, STORAGE))
    storage = F.when(F.replace(size, F.lit(" "), none) != ram, F.replace(size, F.lit(" STORAGE"), none)).otherwise(none)
    return {"brand": brand.otherwise(""), "model": model, "ram": ram, "storage": storage, "memory_type": F.when(ram == "", "").when(unified, "Unified Memory").otherwise("RAM")}


def clean_dataset(samples: DataFrame, key: str) -> DataFrame:
    """Samples (instruction, input, output) as (key, instruction, input, output): output is a JSON object of the five ALIASES.

    Outputs that are JSON objects are read by their aliases, others as text; what they lack is sought in the input. Samples with
    fewer than two fields, or without any input, go; of equal ones the smallest key stays. Null texts count as empty.
    """
    c = F.col
    rows = samples.select(c(key).alias("_key"), *[without_scraps(c(n)).alias(f"_{n}") for n in ("instruction", "input", "output")])
    said = X.json_object(c("_output"))
    rows = rows.withColumn("_said", F.transform(F.map_entries(said), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v"))))
    rows = rows.withColumn("_source", F.when(c("_said").isNotNull(), c("_input")).otherwise(X.stripped(F.concat_ws(" ", "_input", "_output"))))
    value = lambda alias: F.get(F.filter("_said", lambda e: (e["k"] == alias) & e["v"].isNotNull()), F.lit(0))["v"]
    told = specs_of(c("_source"))
    fields = {name: F.coalesce(F.nullif(without_scraps(F.coalesce(*map(value, aliases))), F.lit("")), told[name]) for name, aliases in ALIASES.items()}
    rows = rows.withColumn("_fields", F.struct(*[X.stripped(F.regexp_replace(v, r"(?i)\b(off)(?:\s+off)+\b", "$1")).alias(k) for k, v in fields.items()]))
    parts = lambda *names: F.filter(F.array(*[c(f"_fields.{n}") for n in names]), lambda v: v != "")
    rebuilt = F.array_join(parts("brand", "model", "ram", "memory_type", "storage"), ", ")
    given = F.when(c("_input") == "", rebuilt).otherwise(c("_input"))
    asked = F.when(F.rlike(F.lower("_instruction"), F.lit("|".join(EXTRACTING))), c("_instruction")).otherwise(F.lit(INSTRUCTION))
    good = settled(rows, ["_key"], instruction=asked, input=given, output=F.to_json("_fields"), _n=F.size(parts(*ALIASES))).where((c("_n") >= 2) & (c("input") != ""))
    return good.groupBy("instruction", "input", "output").agg(F.min("_key").alias(key)).select(key, "instruction", "input", "output")


def _facts(text: Column) -> Column:
    """A map of FACTS and the brand, in their order, of what a text holds."""
    said = {n: F.when(F.rlike(text, F.lit(f"(?i){p}")), _found(text, p)) for n, p in FACTS.items()}
    name = said.pop("product_name")
    said = {"product_name": name, "brand": F.nullif(F.regexp_extract(name, "^([A-Za-z]+)", 1), F.lit(""))} | said
    return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in said.items()]), lambda e: e["v"].isNotNull()))


def _asked(instruction: Column) -> Column:
    """The fields an instruction asks the verifier for, by name."""
    def asked(ask: Column) -> Column:
        whole = F.rlike(ask, F.lit("|".join(ALL)))
        found = {f: F.rlike(ask, F.lit("|".join(map(phrase, words)))) for f, words in ASKS.items()}
        return F.array_compact(F.array(*[F.when(found[f] | whole if f in FACTS else found[f], F.lit(f)) for f in sorted(ASKS)]))

    return let(intent_text(instruction), asked)


def _plain(text: Column) -> Column:
    return X.stripped(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s/.]", " "), r"\s+", " "))


def _telling(source: Column, said: Column) -> Column:
    """The lines of a source that hold what it says of a field; all of it if it says nothing, or in no single line."""
    lines = F.filter(F.split(source, r"\r\n|[\n\r]"), lambda l: F.contains(l, said))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(source)


def _holds(source: Column, fact: Column, said: Column) -> Column:
    """A source holds a fact, by its words or by its numbers: the same whole numbers, side by side, whatever stands between.

    Commas inside a number don't count. Digits of one number never meet those of the next. Where the source says something
    of the fact's field (said), only numbers of the lines that tell it count: a number of reviews is no price.
    """
    s, f = _plain(source), _plain(fact)
    numbers = lambda t: F.array_join(F.regexp_extract_all(F.regexp_replace(t, r"(?<=\d),(?=\d)", ""), F.lit(r"(\d+(?:\.\d+)*)"), 1), " ")
    spaced = lambda t: F.concat(F.lit(" "), numbers(t), F.lit(" "))
    return F.contains(s, f) | ((numbers(fact) != "") & F.contains(spaced(_telling(source, said)), spaced(fact)))


def _lacking(fields: Column) -> Column:
    about = F.concat(F.lit(" about "), F.array_join(fields, ", "), F.lit("."))
    return F.concat(F.lit("The context does not provide "), F.when(F.size(fields) > 0, F.concat(F.lit("information"), about)).otherwise("this information."))


def _as_lines(entries: Column) -> Column:
    return F.transform(entries, lambda e: F.concat(F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" "))), F.lit(": "), e["value"]))


def _corrected() -> Column:
    """An output by the rules of its task, from what the input holds."""
    facts, asked = F.col("_facts"), F.col("_asked")
    filled = F.filter(F.map_entries(facts), lambda e: e["value"] != "")
    chosen = F.when(F.size(asked) > 0, F.filter(filled, lambda e: F.array_contains(asked, e["key"]))).otherwise(filled)
    absent = F.filter(asked, lambda f: F.coalesce(F.element_at(facts, f), F.lit("")) == "")
    quoted = lambda v: F.regexp_replace(F.to_json(F.array(v)), r"(?s)^\[|\]$", "")
    pairs = F.transform(chosen, lambda e: F.concat(F.lit("  "), quoted(e["key"]), F.lit(": "), quoted(e["value"])))
    gap = F.when(F.size(absent) > 0, F.array(F.concat(F.lit('  "missing_information": '), quoted(_lacking(absent))))).otherwise(F.array().cast(strings))
    body = F.concat(pairs, gap)
    extraction = F.when(F.size(body) == 0, "{}").otherwise(F.concat(F.lit("{\n"), F.array_join(body, ",\n"), F.lit("\n}")))

    sorted_lines = _as_lines(F.array_sort(chosen))
    asked_out = F.when(F.size(absent) == 0, F.array_join(sorted_lines, "\n")).otherwise(F.array_join(F.concat(sorted_lines, F.array(_lacking(absent))), "\n"))
    free_out = F.when(F.size(facts) == 0, _lacking(F.array().cast(strings))).otherwise(F.array_join(F.slice(_as_lines(filled), 1, 4), "\n"))
    qa = F.when(F.size(asked) > 0, asked_out).otherwise(free_out)

    has = lambda f: F.nullif(F.element_at(facts, f), F.lit(""))
    thoughts = F.array_compact(F.array(
        F.concat(F.lit("The device has "), has("storage"), F.lit(" storage, which supports heavier app and media usage.")),
        F.concat(F.lit("It uses "), has("chip"), F.lit(", suggesting stronger performance for demanding tasks.")),
        F.concat(F.lit("The rating of "), has("rating"), F.lit(" indicates positive user feedback.")),
    ))
    thought = F.when(F.size(thoughts) > 0, F.array_join(thoughts, " ")).otherwise("The available context is limited, so performance confidence is moderate.")
    reasoning = F.concat(F.lit("<thought>"), thought, F.lit("</thought>\nRecommendation: Suitable for power users."))
    return F.when(F.col("_kind") == "extraction", extraction).when(F.col("_kind") == "reasoning", reasoning).otherwise(qa)


def verify_dataset(samples: DataFrame) -> DataFrame:
    """Samples (instruction, input, output) with issues, status (valid, corrected or invalid) and corrected_output (empty unless corrected).

    Without instruction or input a sample is invalid. Inner objects and lists of a JSON output aren't held against the input.
    Null texts count as empty; the three new columns replace those of samples with such names.
    """
    kept = [c for c in samples.columns if c not in ("issues", "status", "corrected_output")]
    text = lambda c: X.stripped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = samples.select(*held(kept), text("instruction").alias("_ask"), text("input").alias("_in"), F.coalesce(F.col("output").cast("string"), F.lit("")).alias("_out"))
    kind = F.when(F.lit(False), "")
    for name, words in KINDS.items():
        kind = kind.when(F.rlike(F.lower("_ask"), F.lit("|".join(words))), name)
    rows = rows.withColumns({"_kind": kind.otherwise("qa"), "_asked": _asked(F.col("_ask")), "_facts": _facts(F.col("_in")), "_parsed": X.json_object(F.col("_out"))})

    given, out, asked, facts, parsed = F.col("_in"), F.col("_out"), F.col("_asked"), F.col("_facts"), F.col("_parsed")
    is_kind = lambda k: F.col("_kind") == k
    read = is_kind("extraction") & parsed.isNotNull()
    none = F.array().cast(strings)
    have = F.filter(asked, lambda f: F.map_contains_key(facts, f))
    absent = F.filter(have, lambda f: ~F.map_contains_key(parsed, f))
    silent = F.filter(have, lambda f: ~F.contains(_plain(out), _plain(F.element_at(facts, f))))
    scalar = lambda e: (e["key"] != "missing_information") & e["value"].isNotNull() & ~F.rlike(e["value"], F.lit(r"^[{\[]"))
    claims = F.when(read, F.filter(F.map_entries(parsed), scalar)).otherwise(F.map_entries(_facts(out)))
    loose = F.filter(claims, lambda e: ~_holds(given, e["value"], F.element_at(facts, e["key"])))
    told = lambda fields, before, after="": F.transform(fields, lambda f: F.concat(F.lit(before), f, F.lit(after)))
    one = lambda when, said: F.when(when, F.array(F.lit(said))).otherwise(none)
    issues = F.concat(
        one(is_kind("extraction") & parsed.isNull(), "Extraction task output is not valid JSON"),
        F.when(read, told(absent, "JSON output missing requested field: ")).otherwise(none),
        one(is_kind("reasoning") & ~(F.contains(out, F.lit("<thought>")) & F.contains(out, F.lit("</thought>"))), "Reasoning task output missing <thought> section"),
        one(is_kind("qa") & parsed.isNotNull(), "QA task output should be natural language, not JSON"),
        told(F.transform(loose, lambda e: e["key"]), "Hallucination: output field '", "' not grounded in input"),
        one((F.size(F.array_except(asked, have)) > 0) & ~F.rlike(out, F.lit("(?i)The context does not provide information about")), "Missing information logic violation: output should state missing context fields"),
        one(read & (F.size(absent) > 0), "Instruction/output mismatch: requested fields not fully covered"),
        F.when(read, none).otherwise(F.transform(silent, lambda f: F.concat(F.lit("Instruction/output mismatch: "), F.when(f == "product_name", f).otherwise(F.concat(F.lit("'"), f, F.lit("'"))), F.lit(" not addressed")))),
    )
    rows = rows.withColumn("_issues", F.when(F.col("_ask") == "", F.array(F.lit("Missing instruction"))).when(given == "", F.array(F.lit("Missing input"))).otherwise(issues))
    status = F.when((F.col("_ask") == "") | (given == ""), "invalid").when(F.size("_issues") == 0, "valid").otherwise("corrected")
    rows = rows.withColumn("_status", status)
    corrected = F.when(F.col("_status") == "corrected", _corrected()).otherwise("")
    return settled(rows, back(kept), issues=F.col("_issues"), status=F.col("_status"), corrected_output=corrected)


def corrected_dataset(verified: DataFrame) -> DataFrame:
    """verify_dataset()'s samples that aren't invalid, with the corrected output where there is one."""
    out = F.when(F.col("status") == "corrected", F.col("corrected_output")).otherwise(F.col("output"))
    return verified.where(F.col("status") != "invalid").withColumn("output", out).drop("issues", "status", "corrected_output")
