"""Strict scoring of instruction samples about products: every sample is held against the evidence of its own input.

Rules are expressions over one row; only the pruning of families needs a shuffle, and that carries keys alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import products as P
from .settled import back, held, let, settled

#: Why a sample is rejected (fixed values).
REASONS = ["empty_output", "invalid_json", "instruction_mismatch", "hallucinated_fields", "reasoning_format", "not_grounded", "near_duplicate_family"]
#: Payload fields whose absence from an extraction counts (fixed values).
CORE = ["brand", "category", "model", "price", "storage", "display", "rear_camera", "front_camera", "processor", "warranty"]
#: What an instruction speaks of, and the words of which its reasoning has to hold one (fixed values).
TOPICS = {
    "camera": (["camera"], ["camera", "rear", "front"]),
    "battery": (["battery"], ["battery"]),
    "pros_cons": (["pros and cons", "trade-off", "trade-offs", "tradeoff", "trade offs", "advantages and disadvantages"], ["pros", "cons", "advantage", "disadvantage", "trade-off", "tradeoff"]),
    "power_user": (["power user"], ["storage", "processor", "chip"]),
}
#: Kinds of reasoning, by the first that has a word in the instruction (fixed values).
ANGLES = {"pros_cons": ["pros and cons", "advantages", "disadvantages"], "power_user": ["power user"], "value": ["good value", "value"], "recommend": ["recommend"]}
#: The order in which words tell the task here (fixed values).
ORDER = ("extraction", "reasoning", "summarization")

named = lambda fields: F.transform(fields, lambda f: X.match_form(F.replace(f, F.lit("_"), F.lit(" "))))


def _agrees(value: Column, wanted: Column) -> Column:
    """Equal or one within the other, by normal form or by digits."""
    within = lambda a, b: (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    meet = lambda a, b, both: let(a, lambda x: let(b, lambda y: both(x, y)))
    return meet(X.match_form(value), X.match_form(wanted), lambda v, w: (v == w) | within(v, w)) | meet(digits(value), digits(wanted), within)


def _in_source(value: Column, source: Column) -> Column:
    """Whether a text of normal form holds a value."""
    return F.contains(source, X.match_form(value))


def _shared_tokens(a: Column, b: Column) -> Column:
    """The number of words that two texts of normal form share."""
    tokens = lambda c: F.regexp_extract_all(c, F.lit(r"(\b[\w/+.%-]+\b)"), 1)
    return F.size(F.array_intersect(tokens(a), tokens(b)))


def _with_cameras(fields: Column) -> Column:
    both = F.when(F.array_contains(fields, "camera"), F.array(F.lit("rear camera"), F.lit("front camera"))).otherwise(F.array().cast("array<string>"))
    return F.array_union(fields, both)


def signature(instruction: Column, task: Column) -> Column:
    """What a sample is after, so that samples of one family that ask for the same are known."""
    return let(F.array_sort(P.requested_fields(instruction)), lambda asked: _signature(instruction, task, asked))


def _signature(instruction: Column, task: Column, asked: Column) -> Column:
    some = lambda fields, none: F.coalesce(F.nullif(F.array_join(fields, ","), F.lit("")), F.lit(none))
    angle = F.when(F.lit(False), "")
    for name, words in ANGLES.items():
        angle = angle.when(F.rlike(F.lower(instruction), F.lit("|".join(words))), name)
    return (
        F.when(task == "extraction", F.concat(F.lit("extract:"), some(F.array_intersect(asked, F.array(*map(F.lit, P.PAYLOAD))), "all")))
        .when(task == "qa", F.concat(F.lit("qa:"), some(asked, "generic")))
        .when(task == "summarization", "summary").otherwise(F.concat(F.lit("reasoning:"), angle.otherwise("generic")))
    )


def _issues() -> Column:
    ask, given, said, low = F.col("_ask"), F.col("_given"), F.col("_out"), F.col("_low")
    task, asked, wanted, parsed, pairs = F.col("_task"), F.col("_asked"), F.col("_wanted"), F.col("_parsed"), F.col("_pairs")
    allowed = F.array(*map(F.lit, P.PAYLOAD))
    off = "instruction_mismatch"
    has = lambda *words: F.rlike(F.lower(ask), F.lit("|".join(map(P.phrase, words))))
    names = lambda *words: F.rlike(low, F.lit("|".join(words)))
    known = lambda k: F.coalesce(F.element_at(wanted, k), F.lit("")) != ""

    keys = F.map_keys(parsed)
    lost = F.array_except(F.array_intersect(asked, allowed), keys)
    loose = F.exists(F.map_entries(parsed), lambda e: F.when(known(e["key"]), ~_agrees(F.coalesce(e["value"], F.lit("None")), F.element_at(wanted, e["key"]))).otherwise(~_in_source(F.coalesce(e["value"], F.lit("")), given)))
    model = F.coalesce(F.element_at(parsed, "model"), F.lit(""))
    extraction = [
        (parsed.isNull(), "invalid_json"),
        (F.size(F.array_except(keys, allowed)) > 0, "hallucinated_fields"),
        (F.arrays_overlap(lost, F.array(*map(F.lit, CORE))), off),
        (F.contains(model, F.lit("...")) | F.contains(model, F.lit("…")), off),
        (loose, "not_grounded"),
    ]

    specs = P.asks_missing_specs(ask)
    listed = _with_cameras(P.missing_fields(said))
    lacking = _with_cameras(F.when(F.size("core_missing") > 0, F.col("core_missing")).otherwise(F.col("optional_missing")))
    lacks, whole = F.contains(low, F.lit("the context does not provide information about")), F.contains(low, F.lit("provides the main specifications"))
    vague = F.contains(low, F.lit("several specifications")) | F.contains(low, F.lit("missing specifications"))
    field = lambda k: F.get(F.filter(allowed, lambda f: F.replace(f, F.lit("_"), F.lit(" ")) == k), F.lit(0))
    wrong = F.exists(pairs, lambda e: F.when(F.coalesce(known(field(e["k"])), F.lit(False)), X.match_form(e["v"]) != X.match_form(F.element_at(wanted, field(e["k"])))).otherwise(~_in_source(e["v"], given)))
    qa = [
        (parsed.isNotNull(), off),
        (F.size(asked) == 0, off),
        ((F.size(asked) > 0) & ~specs & (F.size(F.array_except(F.transform(pairs, lambda e: e["k"]), named(asked))) > 0), off),
        ((F.size(asked) > 0) & ~specs & (F.size(F.array_except(listed, named(asked))) > 0), off),
        (specs & (vague | (~lacks & ~whole)), off),
        (specs & lacks & (F.size(F.array_except(lacking, listed)) > 0), off),
        (specs & lacks & (F.size(lacking) > 0) & (F.size(F.array_except(listed, lacking)) > 0), off),
        (~specs & wrong, "not_grounded"),
    ]

    about = {"camera": F.arrays_overlap(asked, F.array(F.lit("rear_camera"), F.lit("front_camera"))), "battery": F.array_contains(asked, "battery")}
    apart = (said != "") & ~_in_source(said, given) & (_shared_tokens(given, X.match_form(said)) < 3)
    reasoning = [(~F.contains(low, F.lit("analysis:")) | ~F.contains(low, F.lit("recommendation:")), "reasoning_format")]
    reasoning += [((has(*words) | about.get(topic, F.lit(False))) & ~names(*needs), off) for topic, (words, needs) in TOPICS.items()]
    reasoning += [(apart, "not_grounded")]

    rules = {"extraction": extraction, "qa": qa, "reasoning": reasoning, "summarization": [(apart, "not_grounded")]}
    found = [F.when(said == "", "empty_output")]
    found += [F.when((task == kind) & F.coalesce(bad, F.lit(False)), F.lit(reason)) for kind, tests in rules.items() for bad, reason in tests]
    return F.array_compact(F.array(*found))


def strict_score(samples: DataFrame, key: str, per_task: int = 1, total: int = 3) -> DataFrame:
    """Samples (instruction, input, output) with task_type, issues and passed; `key` is unique and gives their order.

    issues lists REASONS, one as often as it was found. Of the samples without issues, one of each product family, task and
    request passes, `per_task` of each family and task, and `total` of each family, the first by key; the others bear near_duplicate_family. Samples
    whose input names no product belong to no family. Null texts count as empty. Columns task_type, issues and passed of
    samples are replaced; all others stay as they are.
    """
    text = lambda c: X.stripped(F.coalesce(F.col(c).cast("string"), F.lit("")))
    kept = [c for c in samples.columns if c not in ("task_type", "issues", "passed")]
    rows = samples.select(*held(kept), F.col(key).alias("_key"), text("instruction").alias("_ask"), text("input").alias("_in"), text("output").alias("_out"))
    found = P.evidence(rows, "_in")
    # Each step's columns are worked out once: a rule that names a field holds no copy of the patterns that read it.
    found = settled(found, [*(f"_held{i}" for i in range(len(kept))), "_key", "_ask", "_in", "_out"], **{c: F.col(c) for c in P.RECORD})
    read = P.missing_specs(found)
    wanted = F.create_map(*[x for k, v in P.expected().items() for x in (F.lit(k), v.cast("string"))])
    steps = {"_task": P.task_type(F.col("_ask"), ORDER), "_asked": P.requested_fields(F.col("_ask")), "_wanted": wanted, "_parsed": X.json_object(F.col("_out")), "_pairs": X.line_pairs(F.col("_out"))}
    steps |= {"_given": X.match_form(F.col("_in")), "_low": F.lower("_out")}
    read = settled(read, [*(f"_held{i}" for i in range(len(kept))), "_key", "_ask", "_out", "product_name"], core_missing=F.col("core_missing"), optional_missing=F.col("optional_missing"), **steps)
    bare = X.stripped(F.regexp_replace("product_name", r"\s*\([^)]*\)\s*$", ""))
    family = X.match_form(F.coalesce(F.nullif(bare, F.lit("")), F.col("product_name")))
    judged = settled(read, [*(f"_held{i}" for i in range(len(kept))), "_key"], _task=F.col("_task"), _issues=_issues(), _family=F.nullif(family, F.lit("")), _sign=_signature(F.col("_ask"), F.col("_task"), F.array_sort("_asked"))).checkpoint()

    good = judged.where((F.size("_issues") == 0) & F.col("_family").isNotNull())
    first = good.groupBy("_family", "_task", "_sign").agg(F.min("_key").alias("_key"))
    chosen = P.family_quota(first, "_family", "_task", "_key", per_task, total).select("_key", F.lit(True).alias("_first"))
    again = (F.size("_issues") == 0) & F.col("_family").isNotNull() & F.col("_first").isNull()
    issues = F.when(again, F.array(F.lit("near_duplicate_family"))).otherwise(F.col("_issues"))
    out = judged.join(chosen, "_key", "left").withColumn("_issues", issues)
    return out.select(*back(kept), F.col("_task").alias("task_type"), F.col("_issues").alias("issues"), (F.size("_issues") == 0).alias("passed"))


def reject_counts(scored: DataFrame) -> DataFrame:
    """(counter, n): all samples, those that passed and were rejected, and how often each of REASONS was found."""
    count = lambda reason: F.sum(F.size(F.filter("issues", lambda i: i == reason)))
    counters = {"total_samples": F.count(F.lit(1)), "passed": F.count_if("passed"), "rejected": F.count_if(~F.col("passed"))} | {f"rejected_{r}": count(r) for r in REASONS}
    row = scored.agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in counters.items()])
    return row.unpivot([], list(counters), "counter", "n")
