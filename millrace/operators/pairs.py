"""Instruction pairs from texts: segments, topics, templates and formats, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from .settled import let

#: Instructions over a text of some domain, in the order they are taken (fixed values).
INSTRUCTIONS = [
    "Explain the key concepts of {domain} based on this text.",
    "Summarize the following information about {domain}.",
    "What are the main points discussed in this text about {domain}?",
    "Provide an overview of {domain} using the details below.",
    "Analyze the provided text and describe its relation to {domain}.",
]
#: What no point of a summary may hold, in lower case (fixed values).
NO_SUMMARY = ["http://", "https://", "@app.route", "mapping every source file"]
NO_SUMMARY_PATTERNS = [r"\bdef\s+\w+\s*\(", r"^(post|get|put|delete|patch)\s+/\S+", r"^[\w./-]+\.(?:py|js|ts|tsx|html|css|md|json|yaml|yml|txt)$"]
NO_SUMMARY_ENDINGS = [":", "source file in the project:"]
#: Phrases that may be topics, and those of products in any letter case (fixed values). A repeated group recurses with each
#: repeat and overflows the stack in some thousand words with capitals, unless it is possessive, which is why its end stands inside.
TOPICS = [r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+\b)++)", r"(?:^|\.\s+)([A-Z][^.]{10,60}?)(?:\s+is\s+|\s+are\s+|\s+refers?\s+to)"]
PRODUCT_TOPICS = [
    r"\b(\d+\s?(?:GB|TB)\s+Unified\s+Memory)\b",
    r"\b(\d+\s?(?:GB|TB)\s+(?:SSD|HDD|Storage))\b",
    r"\b(Liquid Retina Display|Retina Display|AMOLED Display|OLED Display)\b",
    r"\b(\d{3,4}p\s+[A-Za-z ]*Camera|FaceTime HD Camera)\b",
    r"\b(Touch ID)\b",
    r"\b(Battery)\b",
    r"\b(Price|Discount|Availability|Rating)\b",
]


def instructions(df: DataFrame, domain: str = "general", most: int = 2, text: str = "text") -> DataFrame:
    """For each text the first `most` instructions: template, instruction, input; texts under 50 characters have none."""
    told = [F.lit(t.replace("{domain}", domain)) for t in INSTRUCTIONS[:most]]
    usable = df.where((F.length(text) >= 50) & (F.trim(text) != ""))
    return usable.select("*", F.posexplode(F.array(*told)).alias("template", "instruction")).withColumnRenamed(text, "input")


def segments(text: Column) -> Column:
    """Lines cut after sentences, without bullets and needless blanks, of 12 characters at least."""
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, r"\s+", " "), "^[ \\-•\t]+|[ \\-•\t]+$", "")
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), bare), lambda l: l != "")
    return F.filter(F.flatten(F.transform(lines, lambda l: F.transform(F.split(l, r"(?<=[.!?])\s+"), bare))), lambda s: F.length(s) >= 12)


def is_summary_point(segment: Column) -> Column:
    """Whether a segment may stand in a summary: a whole sentence of words, no code, address or heading."""
    return summary_test([])(segment)


def summary_test(banned: list[str]):
    """The same test, which also fails for patterns of the lower-case text, e.g. names of a project's own files."""
    return lambda segment: _fits_summary(segment, banned)


def _fits_summary(segment: Column, banned: list[str]) -> Column:
    return let(X.stripped(segment), lambda s: let(F.lower(s), lambda low: _fits(s, low, banned)))


def _fits(s: Column, low: Column, banned: list[str]) -> Column:
    good = (F.length(s) >= 25) & F.rlike(s, F.lit(r"^[\p{Lu}\p{Nd}]")) & (X.alpha_ratio(s) >= 0.45)
    for part in NO_SUMMARY:
        good &= ~F.contains(low, F.lit(part))
    for pattern in [*NO_SUMMARY_PATTERNS, *banned]:
        good &= ~F.rlike(low, F.lit(pattern))
    for end in NO_SUMMARY_ENDINGS:
        good &= ~F.endswith(low, F.lit(end))
    return F.coalesce(good, F.lit(False))


def summary_point(segment: Column) -> Column:
    """A segment without bullets, section numbers and closing signs."""
    t = F.regexp_replace(F.regexp_replace(segment, r"\s+", " "), "^[ \\-•\t]+|[ \\-•\t]+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\.{2,}", "."), r"[ :;,.]+$", "")
    return F.trim(F.regexp_replace(t, r"^\d+(?:\.\d+)*\s+", ""))


def topics(text: Column, most: int = 8) -> Column:
    """Phrases that a text may be about, each once in any letter case, in the order of the patterns and their places."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in TOPICS], *[F.regexp_extract_all(text, F.lit(f"(?i){p}"), 1) for p in PRODUCT_TOPICS])
    plain = F.filter(F.transform(found, lambda c: X.stripped(F.regexp_replace(c, r"\s+", " "))), lambda c: F.length(c) >= 3)
    return F.element_at(F.transform(F.array(plain), lambda cs: F.slice(F.filter(cs, lambda c, i: F.array_position(F.transform(cs, F.lower), F.lower(c)) == i + 1), 1, most)), 1)


def _asked(instruction: Column, given: Column) -> Column:
    return F.when(F.coalesce(given, F.lit("")) == "", instruction).otherwise(F.concat(instruction, F.lit("\n\n"), given))


def as_alpaca(instruction: Column, given: Column, output: Column) -> Column:
    return F.struct(instruction.alias("instruction"), F.coalesce(given, F.lit("")).alias("input"), output.alias("output"))


def as_chatml(instruction: Column, given: Column, output: Column, system: str = "You are a helpful assistant.") -> Column:
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.struct(F.array(message("system", F.lit(system)), message("user", _asked(instruction, given)), message("assistant", output)).alias("messages"))


def as_sharegpt(instruction: Column, given: Column, output: Column) -> Column:
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    return F.struct(F.array(turn("human", _asked(instruction, given)), turn("gpt", output)).alias("conversations"))


FORMATS = {"alpaca": as_alpaca, "chatml": as_chatml, "sharegpt": as_sharegpt}


def format_pairs(pairs: DataFrame, template: str = "alpaca", key: str = "pair_id", same_instruction: int = 2) -> DataFrame:
    """(key, row): pairs in a template's form, of equal ones (blanks and letter case aside) the first by key, and of each
    instruction so many at most within its input."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))
    once = pairs.withColumn("_n", F.row_number().over(W.partitionBy(F.md5(F.concat_ws("\x1f", plain("instruction"), plain("input"), plain("output")))).orderBy(key))).where(F.col("_n") == 1)
    few = once.withColumn("_n", F.row_number().over(W.partitionBy(F.md5(F.concat_ws("\x1f", plain("instruction"), plain("input")))).orderBy(key))).where(F.col("_n") <= same_instruction)
    return few.select(key, FORMATS[template](F.col("instruction"), F.col("input"), F.col("output")).alias("row"))


def instruction_of(row: Column, template: str) -> Column:
    """The instruction that a formatted row holds."""
    if template == "alpaca":
        return row["instruction"]
    return F.get(row["messages"], F.lit(1))["content"] if template == "chatml" else F.get(row["conversations"], F.lit(0))["value"]


def response_of(row: Column, template: str) -> Column:
    if template == "alpaca":
        return row["output"]
    return F.get(row["messages"], F.lit(2))["content"] if template == "chatml" else F.get(row["conversations"], F.lit(1))["value"]


def split_by_position(df: DataFrame, key: str, seed: str = "42", train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """train, validation and test of exactly int(n * share) rows each (the rest is test), in an order by the hash of the key."""
    from .profiling import running_sum

    n = df.count()
    lot = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
    place = running_sum(df.withColumns({"_lot": lot, "_one": F.lit(1)}), "_lot", "_one", "_upto", then=key)
    cut = int(n * train), int(n * train) + int(n * validation)
    return place.withColumn("split", F.when(F.col("_upto") <= cut[0], "train").when(F.col("_upto") <= cut[1], "validation").otherwise("test")).drop("_lot", "_one", "_upto")
