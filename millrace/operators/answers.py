"""Answers drawn from plain texts: cleaned prose, extractive responses, question-answer pairs; expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .pairs import is_summary_point, segments, topics
from .settled import back, held, let, settled, spread

#: Lines of printed pages that are no prose, in any letter case (fixed values).
FURNITURE = [r"^\d+\s*/\s*\d+$", r"\b\d{2}/\d{2}/\d{4},\s*\d{1,2}:\d{2}\b", r"\bpage\s*\d+\s*/\s*\d+\b", r"^[\w./-]+\.(?:py|js|ts|tsx|html|css|md|json|yaml|yml|txt)$"]
#: What a line begins with that no line before runs on into (fixed values).
OPENINGS = [r"^\d+[\).\s-]", r"(?i)^(Part|Section|Chapter)\b", r"(?i)^(Abstract|Conclusion|Introduction)\b", r"^[#@]"]
#: The longest text that a line still runs on from (fixed value).
WRAPPED = 140
#: Words of an instruction that aren't its subject (fixed values).
STOPWORDS = "the and from with that this based text about what are main points into using provide describe explain concept concepts general".split()
#: Words that mark a segment as telling (fixed values).
TELLING = "key main important architecture pipeline model security processing algorithm distributed infrastructure".split()
#: Words that ask for a summary (fixed values).
SUMMARY = ["explain", "summarize", "main points", "overview", "key concepts"]
#: Questions about a topic, taken in turn (fixed values).
QUESTIONS = ["What is {topic}?", "Explain {topic} briefly.", "Summarize {topic} in one or two lines.", "What does the text say about {topic}?", "Why is {topic} relevant here?"]

strings = "array<string>"


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^[ \\-•\t]+|[ \\-•\t]+$", "")


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r]")


def prose(df: DataFrame, text: str = "text", out: str = "prose", furniture: list[str] = ()) -> DataFrame:
    """A column of the text without addresses, page furniture and repeated lines; lines that a page had wrapped are joined.

    A line runs on from the one before if that ends in no closing sign and what has been joined is at most WRAPPED long. Null
    texts give an empty one. A column of df that bears the new one's name is replaced. furniture: further patterns of lines that
    are no prose, e.g. the running head of a project's own pages.
    """
    kept = [c for c in df.columns if c != out]
    rows = _prose(spread(df.select(*held(kept), F.col(text).alias("_text"))), furniture)
    return rows.select(*back(kept), F.col("_prose").alias(out))


def _prose(rows: DataFrame, furniture: list[str] = ()) -> DataFrame:
    """The rows (_text and others) with _prose."""
    raw = F.regexp_replace(F.coalesce("_text", F.lit("")), r"(?i)https?://\S+", "")
    kept = F.filter(F.transform(_lines(raw), _bare), lambda l: (l != "") & ~F.rlike(l, F.lit("(?i)" + "|".join([*FURNITURE, *furniture]))))
    whole = settled(rows, ["*"], _lines=F.transform(kept, lambda l: F.regexp_replace(l, r"^[a-z]{1,4}\s+(?=[A-Z])", "")))

    letters = lambda l: F.rlike(l, F.lit("[A-Za-z]"))
    title = F.lit(r"\p{L}\p{Lu}|(?<!\p{L})\p{Ll}")
    opens = lambda l: F.rlike(l, F.lit("|".join(OPENINGS))) | (F.rlike(l, F.lit(r"\p{Lu}")) & ~F.rlike(l, title) & ~F.rlike(l, F.lit("^(?:[^ ]* ){3}"))) | ~letters(l)
    facts = F.transform("_lines", lambda l: F.struct(F.length(l).alias("n"), letters(l).alias("letters"), opens(l).alias("opens"), F.rlike(l, F.lit(r"[.!?:;]$")).alias("ends")))
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("letters"), F.lit(True).alias("ends"), F.lit("").alias("marks"))

    def step(at: Column, line: Column) -> Column:
        runs_on = ~at["ends"] & at["letters"] & (at["n"] <= WRAPPED) & ~line["opens"]
        return F.struct(
            F.when(runs_on, at["n"] + line["n"] + 1).otherwise(line["n"]).alias("n"), (line["letters"] | (runs_on & at["letters"])).alias("letters"),
            line["ends"].alias("ends"), F.concat(at["marks"], F.when(runs_on, "+").otherwise("|")).alias("marks"),
        )

    marks = F.regexp_extract_all(F.aggregate(facts, start, step)["marks"], F.lit("(.)"), 1)
    joined = F.array_join(F.zip_with("_lines", marks, lambda l, m: F.concat(F.when(m == "+", " ").otherwise("\n"), l)), "")
    # Repeats stand beside one another where lines are sorted, which costs no square of their number.
    line = lambda l, i: F.struct(F.lower(l).alias("low"), i.alias("i"), l.alias("line"))
    flat = settled(whole, ["*"], _sorted=F.array_sort(F.transform(F.filter(F.split(joined, "\n"), lambda l: l != ""), line))).drop("_lines")
    first = F.filter("_sorted", lambda s, i: (i == 0) | (F.get("_sorted", i - 1)["low"] != s["low"]))
    inline = F.array_sort(F.transform(first, lambda s: F.struct(s["i"].alias("i"), s["line"].alias("line"))))
    return settled(flat, ["*"], _prose=X.stripped(F.array_join(F.transform(inline, lambda s: s["line"]), "\n"))).drop("_sorted")


def keywords(text: Column) -> Column:
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z][a-z0-9_]{2,})\b"), 1), F.array(*map(F.lit, STOPWORDS)))


def responses(df: DataFrame, instruction: str = "instruction", text: str = "text", out: str = "response") -> DataFrame:
    """A column with an answer to the instruction out of the text's own segments: the three best, or, for a summary, points.

    A segment scores by the words it shares with the instruction, by TELLING words, a length of 45 to 220, and standing among
    the first two; ties go to the earlier one. A text without fit segments gives its first fit lines, or its beginning. An
    empty or null text gives an empty answer.
    """
    return _responses(spread(df), instruction, text, out)


def _responses(df: DataFrame, instruction: str, text: str, out: str) -> DataFrame:
    kept = [c for c in df.columns if c != out]
    clean = _prose(df.select(*held(kept), F.col(text).alias("_text"), F.coalesce(instruction, F.lit("")).alias("_ask")))
    cut = F.flatten(F.transform(F.split("_prose", "\n"), lambda l: F.transform(F.split(l, r"(?<=[.!?])\s+|:\s+|;\s+"), _bare)))
    fit = settled(clean, ["*"], _fit=F.filter(cut, is_summary_point), _asked=keywords(F.col("_ask")))

    def scored(segment: Column, i: Column) -> Column:
        return let(F.lower(segment), lambda low: rated(segment, low, i))

    def rated(segment: Column, low: Column, i: Column) -> Column:
        shared = F.size(F.array_intersect(F.regexp_extract_all(low, F.lit(r"\b([a-z][a-z0-9_]{2,})\b"), 1), F.col("_asked")))
        telling = sum((F.contains(low, F.lit(w)).cast("int") for w in TELLING), F.lit(0))
        score = shared * 2.0 + telling * 1.2 + F.when(F.length(segment).between(45, 220), 1.0).otherwise(0.2) + F.when(i < 2, 0.6).otherwise(0.0)
        return F.struct((-score.cast("double")).alias("below"), i.alias("i"), segment.alias("segment"))

    ranked = F.transform(F.array_sort(F.transform("_fit", scored)), lambda s: s["segment"])
    unlike = lambda most: lambda acc, s: F.when((F.size(acc) < most) & ~F.exists(acc, lambda a: F.lower(a) == F.lower(s)), F.concat(acc, F.array(s))).otherwise(acc)
    best = settled(fit, ["*"], _best=F.aggregate(ranked, F.array().cast(strings), unlike(3)))

    number = lambda s: F.trim(F.regexp_replace(F.trim(s), r"^\d+[.)]?\s*", ""))
    ended = lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)), F.when(F.endswith(s, F.lit(".")), "").otherwise("."))
    points = F.transform(F.filter(F.transform("_best", number), lambda p: F.length(p) >= 20), ended)
    told = F.aggregate(points, F.array().cast(strings), unlike(3))
    summary = F.concat(F.lit("Key concepts discussed in the text include: "), F.when(F.size(told) > 0, F.array_join(told, " ")).otherwise(F.concat(F.trim(F.get("_best", F.lit(0))), F.lit("."))))
    asks = F.rlike(F.lower("_ask"), F.lit("|".join(SUMMARY)))
    said = F.when(asks, summary).otherwise(F.array_join("_best", " "))
    said = X.limited(F.regexp_replace(F.trim(F.regexp_replace(said, r"\s+", " ")), r"\.{2,}", "."), 520)
    some = F.slice(F.filter(F.transform(F.split("_prose", "\n"), _bare), is_summary_point), 1, 3)
    rest = F.when(F.size(some) > 0, X.limited(F.concat(F.lit("Key concepts include: "), F.array_join(some, "; "), F.lit(".")), 420)).otherwise(X.limited(F.trim(F.regexp_replace("_prose", r"\s+", " ")), 320))
    answer = F.when(F.col("_prose") == "", "").when(F.size("_best") > 0, said).otherwise(rest)
    return settled(best, back(kept), **{out: answer})


def question_pairs(df: DataFrame, key: str, most: int = 5, text: str = "text") -> DataFrame:
    """(key, place, instruction, input, output): a question for each of a text's first topics, answered by the first two
    segments that name it; answers without enough letters or words are left out, and one that is most of the text is condensed."""
    clean = prose(df.select(key, text), text, "_prose").select(key, "_prose")
    about = clean.select(key, "_prose", segments(F.col("_prose")).alias("_segments"), F.posexplode(topics(F.col("_prose"), most)).alias("place", "_topic"))
    named = F.slice(F.filter("_segments", lambda s: F.contains(F.lower(s), F.lower("_topic")) & (F.length(s) > 20)), 1, 2)
    found = settled(about, [key, "place", "_topic", "_prose"], _answer=F.array_join(named, " "))
    found = found.where((F.col("_answer") != "") & (X.alpha_ratio(F.col("_answer")) >= 0.4))
    short = _responses(found.withColumn("_ask", F.concat(F.lit("Explain "), F.col("_topic"), F.lit(" briefly."))), "_ask", "_answer", "_short")
    echo = F.length("_answer") > F.floor(F.length("_prose") * 0.65)
    answer = X.limited(F.trim(F.regexp_replace(F.when(echo, F.col("_short")).otherwise(F.col("_answer")), r"\s+", " ")), 260)
    ask = F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("place") % len(QUESTIONS) + 1).cast("int"))
    out = settled(short, [key, "place"], instruction=F.replace(ask, F.lit("{topic}"), F.col("_topic")), input=F.col("_prose"), output=answer)
    return out.where((F.length("output") >= 30) & (F.size(X.blanks_split(F.col("output"))) >= 5))
