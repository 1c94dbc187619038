"""Benchmark decontamination by templates, in DataFrame operations only.

A text becomes a sequence of template tokens: numbers, names (capitalised words) and units turn into typed placeholders,
everything else into lower-case words without punctuation. A second template has names as words too, for texts whose
letter case was changed. All windows of WINDOW tokens, of documents as of items, are joined by the hash of either template;
those of items that have under SEARCHED plain words in both are joined by their tokens with values instead. Hits of a
document and an item on one diagonal count together. Both texts are laid side by side from the first to the last of them,
and on to either side over windows that were not searched as templates, as far as the tokens agree. That stretch must have
RUN tokens, or the whole item: its tokens must agree, and each value that a placeholder has in the item must stand for one
value in the document and the reverse, so re-parameterised questions are caught and texts that only share a skeleton are
not. Lists of names or numbers fit any other list: a stretch counts if one of its windows has LITERALS plain words, if
LITERALS different tokens in it are the same with their values, or if all of it is.

Defined results: null and empty texts and items yield nothing; items under WINDOW tokens are not searched; of rows that
repeat an id each distinct text is judged by itself, documents as items, and the best stretch counts; a null doc_id or
item_id is left out; empty tables yield nothing. One row for each document and item: the longest stretch, of those the one
with most windows, then with fewest changed slots. Other columns of either table are not looked at, under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import stage_table

WINDOW, RUN, LITERALS, SEARCHED = 6, 10, 4, 2
#: Of the tokens along a span, at least this share must agree.
AGREE = 0.9
#: Benchmark windows are broadcast when they are at most so many (32 bytes each); more are joined by shuffle.
BROADCAST_WINDOWS = 200_000
BROADCAST_CHARACTERS = 32 << 20
#: Documents are cut into pieces of so many tokens where stretches are compared.
PIECE_TOKENS = 512
#: Up to so many are a constant of the plan, which drops all other windows of documents before they become rows.
INLINE_WINDOWS = 20_000
#: Units of measure, money and time (fixed values).
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|ft|in|l|ml|s|ms|min|mins|h|hr|hrs|hours|minutes|seconds|days|weeks|months|years|usd|eur|gbp|dollars|euros|percent|pounds|miles|meters|metres|mph|kmh|kw|kwh|hz|khz|mhz|ghz|gb|mb|kb|tb"


def marked(text: Column) -> Column:
    """The text's tokens, each after a space: '#12_5' a number, '~kg' the unit after one, '@paris' a name, else a word."""
    plain = F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    joined = F.regexp_replace(plain, r"(?<=\p{Nd}) (?=\p{Nd})", "_")
    measured = F.regexp_replace(joined, rf" (\p{{Nd}}[\p{{Nd}}_]*) ?((?i:{UNITS}))(?= )", " #$1 ~$2")
    numbered = F.regexp_replace(measured, r" (\p{Nd}[\p{Nd}_]*)(?= )", " #$1")
    either = F.when(F.rlike(text, F.lit(r"\p{Nd}")), numbered).otherwise(plain)
    return F.lower(F.regexp_replace(either, r" (\p{Lu})", " @$1"))


def split_up(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, " +", " ")), " ")


def as_template(line: Column) -> Column:
    """Placeholders without their values."""
    return F.regexp_replace(line, r" ([#~@])\S*", " $1")


def as_words(line: Column) -> Column:
    """The same, but names are words."""
    return F.regexp_replace(F.regexp_replace(line, r" ([#~])\S*", " $1"), " @", " ")


def sides_of(line: Column, exact: bool) -> Column:
    """The token sequences that are searched: both templates, and the tokens with their values."""
    plain = F.regexp_replace(line, " @", " ")
    return F.array(*[split_up(side) for side in (as_template(line), as_words(line), *([plain] if exact else []))])


def hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def once(value: Column, use) -> Column:
    """use(value), where value is computed once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def window_hashes(tokens: Column) -> Column:
    """A hash of each WINDOW (6) token hashes in a row, put together from hashes of 2 and of 4."""

    def beside(a: Column, b: Column, by: int) -> Column:
        most = F.greatest(F.size(b) - by, F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), most), F.slice(b, F.lit(by + 1), most), lambda x, y: F.xxhash64(x, y))

    return once(tokens, lambda one: once(beside(one, one, 1), lambda two: once(beside(two, two, 2), lambda four: beside(four, two, 4))))


def windows(docs: DataFrame, exact: bool, wanted: list[int] | None) -> DataFrame:
    """(doc_id, k, line, hits): the texts' marked tokens, and first token and hash (at, h) of each window of all sides.

    k is a hash of the text, by which texts of one id are told apart. Where it is known which hashes are wanted, all others are
    dropped before they become rows, and texts without any are too.
    """
    lines = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", F.xxhash64("text").alias("k"), marked(F.col("text")).alias("line"))
    hashed = lines.select("*", F.transform(sides_of(F.col("line"), exact), lambda side: window_hashes(hashes(side))).alias("sides"))
    # A window that reads alike on both sides counts once.
    chosen = "(n = 0 or h <> w[0][i])"
    if wanted is not None:
        chosen = "h in ({}) and ".format(", ".join(f"{h}L" for h in wanted if h != -(1 << 63)) or "null") + chosen
    each = F.expr(f"element_at(transform(array(sides), w -> transform(w, (side, n) -> filter(transform(side, (h, i) -> if({chosen}, struct(i + 1 as at, h as h), null)), x -> x is not null))), 1)")
    found = hashed.select("doc_id", "k", "line", F.flatten(each).alias("hits"))
    return found if wanted is None else found.where(F.size("hits") > 0)


def item_windows(items: DataFrame) -> DataFrame:
    """(item, item_at, low, high, wordy, exact, h): the windows of the benchmark that are searched.

    low and high are the tokens to which a run can reach whose first or last searched window this is.
    """
    line = items.select("item", sides_of(marked(F.col("text")), True).alias("s"))
    line = line.select("item", F.size(F.col("s")[0]).alias("size"), "s", F.transform("s", lambda side: window_hashes(hashes(side))).alias("hs"))
    row = line.select("item", "size", "s", "hs", F.posexplode(F.col("hs")[0]).alias("i", "h0"))
    row = row.select("item", "size", (F.col("i") + 1).alias("item_at"), *[F.slice(F.col("s")[k], F.col("i") + 1, WINDOW).alias(f"w{k}") for k in range(3)], *[F.col("hs")[k][F.col("i")].alias(f"h{k}") for k in range(3)])
    words = lambda w: F.size(F.filter(w, lambda t: ~t.isin("#", "~", "@")))
    row = row.withColumn("n0", words("w0")).withColumn("n1", words("w1"))
    place = F.when(F.col("n0") >= SEARCHED, F.col("item_at"))
    order = W.partitionBy("item").orderBy("item_at")
    before = F.last(place, True).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(place, True).over(order.rowsBetween(1, W.unboundedFollowing))
    row = row.withColumn("low", F.coalesce(before + 1, F.lit(1))).withColumn("high", F.coalesce(after + (WINDOW - 2), "size"))
    key = lambda k, n, exact: F.struct(F.col(f"h{k}").alias("h"), (n >= LITERALS).alias("wordy"), F.lit(exact).alias("exact"))
    n0, n1 = F.col("n0"), F.col("n1")
    keys = F.array(F.when(n0 >= SEARCHED, key(0, n0, False)), F.when(n1 >= SEARCHED, key(1, n1, False)), F.when(n1 < SEARCHED, key(2, F.lit(0), True)))
    found = row.select("item", "item_at", "low", "high", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("k"))
    return found.select("item", "item_at", "low", "high", "k.wordy", "k.exact", "k.h").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, n_tokens, n_slots, n_changed): pairs of document and item that share a run."""
    # Each distinct text of an item_id is an item of its own.
    items = benchmark.where(F.col("item_id").isNotNull() & (F.length("text") > 0)).select("item_id", "text").distinct().withColumn("item", F.struct("item_id", F.xxhash64("text").alias("t")))
    theirs = stage_table(item_windows(items), "items")
    size = theirs.limit(BROADCAST_WINDOWS + 1).count()
    long = items.agg(F.sum(F.length("text"))).first()[0] or 0
    few = size <= BROADCAST_WINDOWS and long <= BROADCAST_CHARACTERS
    wanted = [r.h for r in theirs.select("h").distinct().collect()] if size <= INLINE_WINDOWS else None
    ours = windows(docs.select("doc_id", "text"), not theirs.where("exact").isEmpty(), wanted)
    if wanted is not None:
        ours = stage_table(ours, "windows")
    theirs = theirs.drop("exact")
    hits = ours.select("doc_id", "k", F.explode("hits").alias("e")).select("doc_id", "k", "e.at", "e.h").join(F.broadcast(theirs) if few else theirs, "h")
    runs = hits.groupBy("doc_id", "k", "item", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.countDistinct("at").alias("n_windows"), F.min("item_at").alias("first"), (F.max("item_at") + (WINDOW - 1)).alias("last"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("wordy").alias("wordy")
    )
    runs = runs.withColumn("low", F.greatest("low", 1 - F.col("shift")))
    item_lines = items.select("item", split_up(marked(F.col("text"))).alias("item_t")).where(F.size("item_t") >= WINDOW)
    lengths = item_lines.select("item", F.least(F.lit(RUN), F.size("item_t")).alias("least"))
    runs = runs.join(F.broadcast(lengths) if few else lengths, "item").where(F.col("high") - F.col("low") + 1 >= F.col("least"))
    # A stretch gets its tokens from the pieces of its document that it crosses, so that a long text travels to no stretch whole.
    # Only documents with a wanted window come this way again, where the windows could be told which are wanted.
    piece = lambda at: F.floor((F.col(at) + F.col("shift") - 1) / PIECE_TOKENS).cast("int")
    tokens = ours.select("doc_id", "k", split_up(F.col("line")).alias("t"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / PIECE_TOKENS).cast("int")), lambda n: F.slice("t", n * PIECE_TOKENS + 1, F.lit(PIECE_TOKENS)))
    texts = tokens.select("doc_id", "k", F.posexplode(cut).alias("piece", "tokens")).distinct()
    crossed = runs.withColumn("from", piece("low")).withColumn("piece", F.explode(F.sequence(F.col("from"), piece("high"))))
    crossed = crossed.join(texts, ["doc_id", "k", "piece"])
    found = crossed.groupBy(*runs.columns, "from").agg(F.array_sort(F.collect_list(F.struct("piece", "tokens"))).alias("ts"))
    reach = F.col("high") - F.col("low") + 1
    whole = F.flatten(F.transform("ts", lambda x: x["tokens"]))
    found = found.withColumn("doc_t", F.slice(whole, (F.col("low") + F.col("shift") - F.col("from") * PIECE_TOKENS).cast("int"), reach)).drop("ts", "from")
    found = found.join(F.broadcast(item_lines) if few else item_lines, "item").withColumn("item_t", F.slice("item_t", F.col("low"), reach))
    marks = lambda t: F.substring(t, 1, 1)
    slot = lambda t: marks(t).isin("#", "~", "@")
    equal = lambda x, y: F.ltrim(x, F.lit("@")) == F.ltrim(y, F.lit("@"))
    same = lambda x, y: F.coalesce(equal(x, y) | (slot(x) & (marks(x) == marks(y))), F.lit(False))
    found = found.withColumn("sides", F.zip_with("item_t", "doc_t", lambda x, y: F.struct(x.alias("x"), y.alias("y"), same(x, y).alias("same"))))
    other = F.filter(F.transform("sides", lambda p, i: F.when(~p["same"], i + F.col("low"))), lambda i: i.isNotNull())
    found = found.withColumn("other", other)
    start = F.coalesce(F.array_max(F.filter("other", lambda i: i < F.col("first"))) + 1, F.col("low"))
    end = F.coalesce(F.array_min(F.filter("other", lambda i: i > F.col("last"))) - 1, F.col("high"))
    found = found.withColumn("sides", F.slice("sides", start - F.col("low") + 1, end - start + 1)).withColumn("n_tokens", F.size("sides"))
    found = found.withColumn("pairs", F.array_distinct(F.transform(F.filter("sides", lambda p: slot(p["x"]) & slot(p["y"])), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))
    values = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    literal = F.filter("sides", lambda p: equal(p["x"], p["y"]))
    telling = F.col("wordy") | (F.size(F.array_distinct(F.transform(literal, lambda p: p["x"]))) >= LITERALS) | (F.size(literal) == F.col("n_tokens"))
    good = found.where(
        (F.col("n_tokens") >= F.col("least")) & (F.size(F.filter("sides", lambda p: p["same"])) >= AGREE * F.col("n_tokens")) & (values("x") == F.size("pairs")) & (values("y") == F.size("pairs")) & telling
    ).select("doc_id", "item.item_id", "n_windows", "n_tokens", F.size("pairs").alias("n_slots"), F.size(F.filter("pairs", lambda p: p["x"] != p["y"])).alias("n_changed"))
    best = W.partitionBy("doc_id", "item_id").orderBy(F.desc("n_tokens"), F.desc("n_windows"), "n_changed", "n_slots")
    return good.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def remove_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that share no run with any item."""
    found = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op4_template_decontamination(spark, sf_dir: str) -> DataFrame:
    from .shared import read_table

    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
