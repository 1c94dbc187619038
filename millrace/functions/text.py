"""Text expressions: tokens, sentences, normal forms and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
CONNECTORS = "however therefore furthermore moreover additionally because since although while thus hence consequently also then next finally first second".split()
TOXIC_WORDS = ["hate speech", "terrorist attack", "slur", "racist", "sexist", "nazi", "supremacist", "genocide", "torture chamber", "rape", "child abuse"]
LOW_QUALITY = ["(?i)lorem ipsum", "(?i)click here", "(?i)subscribe now", "(?i)cookie policy", "(?i)terms of service", "(?i)all rights reserved", r"(?i)©\s*\d{4}", r"https?://\S+"]
LOW_QUALITY_NAMES = ["lorem_ipsum", "click_here", "subscribe_now", "cookie_policy", "terms_of_service", "all_rights_reserved", "copyright_year", "url"]


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def blanks_split(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), 1)


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.size(blanks_split(text)) / 0.75).cast("int")


def sentences(text: Column) -> Column:
    """Cut after . ! ? before a capital, or before the end of a line."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])|(?<=[.!?])\s*\n"), lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != "")


def match_form(text: Column) -> Column:
    """Lower case, signs other than / . - + as blanks, blanks squeezed."""
    kept = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s/.\-+]", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def clean_text(text: Column) -> Column:
    """Blanks squeezed, at most one empty line in a row, lines stripped."""
    flat = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+", " ")
    # A function of two parameters would be given each place in the list as the characters to trim.
    lines = F.array_join(F.transform(F.split(flat, "\n"), lambda l: F.trim(l)), "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def alpha_ratio(text: Column) -> Column:
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(text, r"[^\p{L}]", "")), F.length(text)), F.lit(0.0))


def rounded(value: Column, places: int) -> Column:
    """A double rounded by its own value times 10 ** places, halves away from zero. F.round takes the decimal that the double
    prints as, which is a half also where the double lies below it."""
    return F.round(value * F.lit(10.0**places), 0) / F.lit(10.0**places)


def overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words of a that b has too."""
    x = F.array_distinct(blanks_split(F.lower(a)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, blanks_split(F.lower(b)))), F.size(x)), F.lit(0.0))


def steps(value: Column, *limits: tuple[float, float], last: float) -> Column:
    """The score beside the first limit that value is below."""
    out = F.when(F.lit(False), F.lit(0.0))
    for below, score in limits:
        out = out.when(value < below, F.lit(score))
    return out.otherwise(F.lit(last))


def length_score(text: Column) -> Column:
    return steps(F.length(text), (20, 0.0), (100, 0.3), (200, 0.6), (2001, 1.0), (5001, 0.7), last=0.4)


def diversity_score(text: Column) -> Column:
    """Distinct words over the root of all words, from 2 to 10 scaled to 0 to 1."""
    w = words(text)
    ttr = F.size(F.array_distinct(w)) / F.sqrt(F.size(w))
    return F.when(F.size(w) == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (ttr - 2) / 8)), 3))


def coherence_score(text: Column) -> Column:
    """Sentences, their mean length, and connecting words."""
    parts = F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 10)
    n = F.size(parts)
    mean = F.coalesce(F.try_divide(F.aggregate(parts, F.lit(0), lambda a, s: a + F.size(blanks_split(s))), n), F.lit(0.0))
    links = F.size(F.array_intersect(F.array_distinct(blanks_split(F.lower(text))), F.array(*map(F.lit, CONNECTORS))))
    return F.round(F.when(n >= 2, 0.4).when(n == 1, 0.2).otherwise(0.0) + F.when(mean >= 8, 0.3).when(mean >= 4, 0.15).otherwise(0.0) + F.when(links >= 3, 0.3).when(links >= 1, 0.15).otherwise(0.0), 4)


def ratio_score(instruction: Column, response: Column) -> Column:
    a, b = F.length(instruction), F.length(response)
    r = b / F.greatest(a, F.lit(1))
    return F.when(F.coalesce(b, F.lit(0)) == 0, 0.0).when(b < 20, 0.1).when(a == 0, 0.5).when(r < 0.3, 0.3).when(r <= 5.0, 1.0).otherwise(0.6)


def originality_score(instruction: Column, given: Column, response: Column) -> Column:
    """How far the response is more than a copy of its input."""
    share = overlap(response, given)
    extraction = F.rlike(F.lower(instruction), F.lit("extract|json|specification|find"))
    return (
        F.when((F.trim(given) == "") | (F.trim(response) == ""), 1.0).when(extraction, F.when(share >= 0.95, 0.3).otherwise(1.0))
        .when(share >= 0.85, 0.1).when(share >= 0.7, 0.4).otherwise(1.0)
    )


def is_toxic(text: Column, vocabulary: list[str] | None = None) -> Column:
    """A word of the text is in the vocabulary (entries of several words never are)."""
    return F.arrays_overlap(words(text), F.array(*map(F.lit, vocabulary or TOXIC_WORDS)))


def low_quality_flags(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.rlike(text, F.lit(p)), F.lit(n)) for p, n in zip(LOW_QUALITY, LOW_QUALITY_NAMES, strict=True)]))


def windows(text: Column, size: int, overlapping: int) -> Column:
    """Pieces of `size` characters, each starting size - overlapping after the one before; none of an empty or null text."""
    step = max(1, size - overlapping)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))


def sliding_chunks(text: Column, size: int, overlapping: int) -> Column:
    """windows(), each trimmed to its last sentence end in the latter part, or to its last blank; short rests kept."""
    def trimmed(w: Column) -> Column:
        ends = F.greatest(*[F.when(F.instr(F.reverse(w), F.lit(m[::-1])) > 0, F.length(w) - F.instr(F.reverse(w), F.lit(m[::-1]))).otherwise(0) for m in (". ", "! ", "? ")])
        blank = F.when(F.instr(F.reverse(w), F.lit(" ")) > 0, F.length(w) - F.instr(F.reverse(w), F.lit(" "))).otherwise(0)
        return F.trim(F.when(F.length(w) < size, w).when(ends > 0.3 * size, F.substr(w, F.lit(1), ends)).when(blank > 0.5 * size, F.substr(w, F.lit(1), blank)).otherwise(w))

    return F.filter(F.transform(windows(text, size, overlapping), trimmed), lambda w: w != "")


def token_chunks(text: Column, size: int, overlapping: int) -> Column:
    """Pieces of int(size * 0.75) words."""
    w = blanks_split(text)
    n = max(1, int(size * 0.75))
    step = max(1, n - int(overlapping * 0.75))
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))


def packed(parts: Column, size: int, joint: str) -> Column:
    """Neighbouring parts joined while their own lengths, without the joints, fit in size; a longer part stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("held"))

    def add(a: Column, p: Column) -> Column:
        fits = (a["open"] == "") | (a["held"] + F.length(p) <= size)
        grown = F.when(a["open"] == "", p).otherwise(F.concat(a["open"], F.lit(joint), p))
        return F.struct(
            F.when(fits, a["done"]).otherwise(F.array_append(a["done"], a["open"])).alias("done"), F.when(fits, grown).otherwise(p).alias("open"), F.when(fits, a["held"] + F.length(p)).otherwise(F.length(p)).alias("held")
        )

    return F.aggregate(parts, start, add, lambda a: F.filter(F.array_append(a["done"], a["open"]), lambda x: x != ""))


def or_whole(parts: Column, text: Column) -> Column:
    """The parts, or the text as it is where there are none."""
    whole = F.when(F.trim(text) != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(parts) > 0, parts).otherwise(whole)


def paragraph_chunks(text: Column, size: int = 512) -> Column:
    return or_whole(packed(F.transform(paragraphs(text), stripped), size, "\n\n"), text)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def line_pairs(text: Column) -> Column:
    """The lines 'key: value' as an array of (k, v): keys in their normal form, of equal ones the last."""
    lines = F.filter(F.split(text, r"\r\n|[\n\r]"), lambda l: F.contains(l, F.lit(":")))
    said = F.transform(lines, lambda l: F.struct(match_form(F.substring_index(l, ":", 1)).alias("k"), stripped(F.substr(l, F.instr(l, ":") + 1)).alias("v")))
    return F.transform(F.array_distinct(F.transform(said, lambda e: e["k"])), lambda k: F.element_at(F.filter(said, lambda e: e["k"] == k), -1))


def sentence_chunks(text: Column, size: int = 512, overlapping: int = 64) -> Column:
    """Sentences packed while they fit in size; each chunk begins with the last sentences of the one before, as far as they fit in `overlapping`."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("open"), F.lit(0).alias("held"))

    def tail(current: Column) -> Column:
        first = F.struct(none.alias("kept"), F.lit(0).alias("held"), F.lit(True).alias("going"))

        def back(a: Column, s: Column) -> Column:
            fits = a["going"] & (a["held"] + F.length(s) <= overlapping)
            return F.struct(F.when(fits, F.array_prepend(a["kept"], s)).otherwise(a["kept"]).alias("kept"), F.when(fits, a["held"] + F.length(s)).otherwise(a["held"]).alias("held"), fits.alias("going"))

        return F.aggregate(F.reverse(current), first, back)

    def add(a: Column, s: Column) -> Column:
        over = (a["held"] + F.length(s) > size) & (F.size(a["open"]) > 0)
        kept = tail(a["open"])
        return F.struct(
            F.when(over, F.array_append(a["done"], F.array_join(a["open"], " "))).otherwise(a["done"]).alias("done"),
            F.array_append(F.when(over, kept["kept"]).otherwise(a["open"]), s).alias("open"),
            (F.when(over, kept["held"]).otherwise(a["held"]) + F.length(s)).alias("held"),
        )

    parts = F.filter(F.transform(sentences(text), stripped), lambda s: s != "")
    return or_whole(F.aggregate(parts, start, add, lambda a: F.when(F.size(a["open"]) > 0, F.array_append(a["done"], F.array_join(a["open"], " "))).otherwise(a["done"])), text)


#: Headings before which a text of products is cut (fixed values).
HEADINGS = ["Product", "Brand", "Price", "Rating", "Availability", "Seller", "Category", "Description", "Key Features", "Specifications", "Features", "Overview", "Details", "Summary"]


def semantic_chunks(text: Column, size: int = 512) -> Column:
    cut = F.filter(F.transform(F.split(text, rf"(?im)(?=^(?:{'|'.join(HEADINGS)})[:\s])"), stripped), lambda p: p != "")
    return F.when(F.size(cut) > 0, packed(cut, size, "\n\n")).otherwise(paragraph_chunks(text, size))


def settled_chunks(chunks: Column, least: int = 50, most: int = 2048, size: int = 512, overlapping: int = 64) -> Column:
    """Chunks under `least` characters go into the next one, the last into the one before; those over `most` are cut again."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))
    joined = lambda a, b: F.when(a == "", b).otherwise(stripped(F.concat(a, F.lit(" "), b)))

    def add(a: Column, c: Column) -> Column:
        small = F.length(c) < least
        return F.struct(F.when(small, a["done"]).otherwise(F.array_append(a["done"], joined(a["held"], c))).alias("done"), F.when(small, joined(a["held"], c)).otherwise("").alias("held"))

    def end(a: Column) -> Column:
        last = F.concat(F.slice(a["done"], F.lit(1), F.greatest(F.size(a["done"]) - 1, F.lit(0))), F.array(joined(F.coalesce(F.try_element_at(a["done"], F.lit(-1)), F.lit("")), a["held"])))
        return F.when(a["held"] == "", a["done"]).otherwise(last)

    merged = F.aggregate(chunks, start, add, end)
    return F.flatten(F.transform(merged, lambda c: F.when(F.length(c) > most, sliding_chunks(c, size, overlapping)).otherwise(F.array(c))))


def limited(text: Column, most: int) -> Column:
    """At most so many characters, cut at the last blank if that is beyond four fifths."""
    head = F.substr(text, F.lit(1), F.lit(most))
    blank = F.length(head) - F.instr(F.reverse(head), F.lit(" "))
    cut = F.when((F.instr(F.reverse(head), F.lit(" ")) > 0) & (blank > 0.8 * most), F.substr(head, F.lit(1), blank)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.trim(cut))


#: What a prompt must not carry, in any letter case (fixed values).
INJECTIONS = [
    r"ignore\s+(all\s+)?(previous|above|prior)\s+instructions",
    r"you\s+are\s+now\s+",
    r"system\s*:\s*",
    r"assistant\s*:\s*",
    r"\[INST\]",
    r"<\|im_start\|>",
    r"<\|im_end\|>",
    r"###\s*(Instruction|Response|System)",
    r"<\|system\|>",
    r"<\|user\|>",
    r"<\|assistant\|>",
]


def sanitized(text: Column, most: int = 10_000) -> Column:
    for p in INJECTIONS:
        text = F.regexp_replace(text, f"(?i){p}", "[REDACTED]")
    return F.substr(text, F.lit(1), F.lit(most))


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def visible_text(html: Column) -> Column:
    """Without scripts, styles, comments and page furniture."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|nav|footer|header|aside|form)\b[^>]*>.*?</\1>", " ")
    return strip_tags(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "))


def truth(text: Column) -> Column:
    """Whether a setting's text says yes; null stays null."""
    return F.lower(F.trim(text)).isin("1", "true", "yes", "y", "on")


def fenced_object(text: Column) -> Column:
    """The JSON object that a text is, without the fence of a code block; null for anything else."""
    bare = stripped(F.regexp_replace(F.regexp_replace(stripped(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    # In brackets, so that nothing may follow the object.
    listed = F.concat(F.lit("["), bare, F.lit("]"))
    return F.when(F.startswith(bare, F.lit("{")) & F.try_parse_json(listed).isNotNull() & (F.json_array_length(listed) == 1), bare)


def json_object(text: Column) -> Column:
    """fenced_object() as a map of strings: null values kept, inner objects as JSON."""
    return F.from_json(fenced_object(text), "map<string,string>")


def key_values(text: Column) -> Column:
    """The lines "key: value" as a map, the last of equal keys standing; keys in lower case with underscores."""
    lines = F.filter(F.split(text, "\n"), lambda l: F.instr(l, F.lit(":")) > 0)
    pair = lambda l: F.struct(F.regexp_replace(F.lower(F.trim(F.substring_index(l, ":", 1))), r"\s+", "_").alias("key"), F.trim(F.substr(l, F.instr(l, F.lit(":")) + 1)).alias("value"))
    pairs = F.transform(lines, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)
