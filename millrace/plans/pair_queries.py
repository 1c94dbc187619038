"""Queries of the pair operators and of the small helpers of records and products."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers
from ..operators import features as E
from ..operators import pairs as I
from ..operators import products as P
from ..operators import profiling as R
from .base import query
from .text_queries import PAIRS, docs, pairs

TOLD = ", ".join(f"'{t.replace('{domain}', 'general')}'" for t in I.INSTRUCTIONS)


@query("q_instruction_templates", f"select doc_id, i::int as template, ([{TOLD}])[i + 1] as instruction, text as input from documents, range(0, 5) r(i) where length(text) >= 50 and trim(text) <> ''")
def _(spark, t):
    return I.instructions(docs(t), most=5).select("doc_id", "template", "instruction", "input")


POINT = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"
GOOD = " and ".join(
    [f"length({POINT}) >= 25", f"regexp_matches({POINT}, '^[\\p{{Lu}}\\p{{Nd}}]')", f"length(regexp_replace({POINT}, '[^\\p{{L}}]', '', 'g')) / length({POINT}) >= 0.45"]
    + [f"not contains(lower({POINT}), '{p}')" for p in I.NO_SUMMARY] + [f"not regexp_matches(lower({POINT}), '{p}')" for p in I.NO_SUMMARY_PATTERNS] + [f"not ends_with(lower({POINT}), '{p}')" for p in I.NO_SUMMARY_ENDINGS]
)


@query("q_summary_candidates", f"select doc_id, count(*) filter ({GOOD}) as n, count(*) as n_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by 1")
def _(spark, t):
    lines = docs(t).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(I.is_summary_point(F.col("line"))).alias("n"), F.count(F.lit(1)).alias("n_lines"))


ONCE = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
FORMATTED = f"""(select * from (select *, row_number() over (partition by {ONCE.format('instruction')}, {ONCE.format('input')} order by pair_id) as few
from (select *, row_number() over (partition by {ONCE.format('instruction')}, {ONCE.format('input')}, {ONCE.format('output')} order by pair_id) as once from (select * from {PAIRS} union all select pair_id + 1000000, concat(' ', instruction, '  '), input, output || case when pair_id % 2 = 0 then '' else '!' end from {PAIRS} union all select pair_id + 2000000, instruction, input, output || '?' from {PAIRS})) where once = 1) where few <= 2)"""


def repeated(t):
    p = pairs(t)
    again = p.select((F.col("pair_id") + 1000000).alias("pair_id"), F.concat(F.lit(" "), "instruction", F.lit("  ")).alias("instruction"), "input", F.concat("output", F.when(F.col("pair_id") % 2 == 0, "").otherwise("!")).alias("output"))
    return p.unionByName(again).unionByName(p.select((F.col("pair_id") + 2000000).alias("pair_id"), "instruction", "input", F.concat("output", F.lit("?")).alias("output")))


@query("q_format_pairs", f"select pair_id, instruction, input, output from {FORMATTED}")
def _(spark, t):
    return I.format_pairs(repeated(t), "alpaca").select("pair_id", "row.*")


@query("q_format_chatml", f"select pair_id, concat('system=You are a helpful assistant.', chr(10), 'user=', instruction, chr(10), 'assistant=', output) as chat, instruction as asked, output as answered from {FORMATTED}")
def _(spark, t):
    done = I.format_pairs(repeated(t), "chatml")
    chat = F.array_join(F.transform("row.messages", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "\n")
    return done.select("pair_id", chat.alias("chat"), I.instruction_of(F.col("row"), "chatml").alias("asked"), I.response_of(F.col("row"), "chatml").alias("answered"))


@query("q_format_sharegpt", f"select pair_id, concat('human=', instruction, chr(10), chr(10), 'given', chr(10), 'gpt=', output) as chat from {FORMATTED}")
def _(spark, t):
    done = I.format_pairs(repeated(t).withColumn("input", F.lit("given")), "sharegpt")
    chat = F.array_join(F.transform("row.conversations", lambda m: F.concat(m["from"], F.lit("="), m["value"])), "\n")
    return done.select("pair_id", chat.alias("chat"))


LOT = "('0x' || substr(md5(concat('42', doc_id::varchar)), 1, 15))::bigint"


@query("q_split_position", f"with r as (select doc_id, row_number() over (order by {LOT}, doc_id) as r, count(*) over () as n from documents) select doc_id, case when r <= floor(n * 0.8) then 'train' when r <= floor(n * 0.8) + floor(n * 0.1) then 'validation' else 'test' end as split from r")
def _(spark, t):
    return I.split_by_position(docs(t).select("doc_id"), "doc_id")


@query("q_boxplot", """with s as (select unnest(['l_quantity', 'l_extendedprice']) as column_name, unnest([l_quantity, l_extendedprice]) as v from lineitem),
q as (select column_name, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q3 from s group by 1)
select column_name, round(min(v) filter (v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 4) as lower, round(max(v) filter (v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 4) as upper,
count(*) filter (v not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as n_beyond, round(any_value(q1), 4) as q1, round(any_value(median), 4) as median, round(any_value(q3), 4) as q3 from s join q using (column_name) group by 1""")
def _(spark, t):
    return R.boxplot(t("lineitem"), ["l_quantity", "l_extendedprice"])


NOISY = "concat('Product: ', p_name, chr(10), '₹', p_size, ',000', chr(10), 'ok', chr(10), 'FREE delivery tomorrow', chr(10), 'Up to 5% back with any Shop Pay card', chr(10), 'Price, product page', chr(10), 'A great  item, 20% off off off....', chr(10), chr(10), chr(10), chr(10), 'Sponsored: see it', chr(10), p_type, ' || Buy Now', '  ', chr(10), '12 - ', p_size, ' Jan')"
QUIET = NOISY
for _pattern in P.NOISE:
    QUIET = f"regexp_replace({QUIET}, '(?i){_pattern}', '', 'g')"
QUIET = f"regexp_replace({QUIET}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
BARE = "regexp_replace(l, '^\\s+|\\s+$', '', 'g')"
QUIET = f"regexp_replace(array_to_string(list_filter(string_split({QUIET}, chr(10)), lambda l: not regexp_matches({BARE}, '^[₹$€£]?\\s*[\\d,]+\\.?\\d*$') and not length({BARE}) between 1 and 2), chr(10)), '^\\s+|\\s+$', '', 'g')"
for _pattern, _by in ((" {2,}", "' '"), ("(?i)\\b(off)(?:\\s+off)+\\b", "'\\1'"), ("[|]{2,}", "'|'"), ("[.]{3,}", "'...'"), ("[ \\t]+\\n", "chr(10)")):
    QUIET = f"regexp_replace({QUIET}, '{_pattern}', {_by}, 'g')"


@query("q_noise_clean", f"select p_partkey, {QUIET} as text from part")
def _(spark, t):
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    size = F.col("p_size").cast("string")
    noisy = line("Product: ", F.col("p_name"), "\n₹", size, ",000\nok\nFREE delivery tomorrow\nUp to 5% back with any Shop Pay card\nPrice, product page\nA great  item, 20% off off off....\n\n\n\nSponsored: see it\n", F.col("p_type"), " || Buy Now  \n12 - ", size, " Jan")
    return t("part").select("p_partkey", P.without_noise(noisy).alias("text"))


@query("q_pros_cons", """with p as (select p_partkey, round(p_size / 10.0, 1)::double as r, p_size, p_type, p_brand from part)
select p_partkey, array_to_string(list_filter([case when r >= 4 then concat('High rating (', r, '/5)') end, case when p_size % 3 = 0 then concat('Discount available (', p_size, '% off)') end, p_type, p_brand], lambda x: x is not null), '; ') as pros,
array_to_string(list_filter([case when r < 3.5 then concat('Lower rating (', r, '/5)') end, case when p_size * 3 < 50 then 'Limited review volume' end], lambda x: x is not null), '; ') as cons from p""")
def _(spark, t):
    rating = F.round(F.col("p_size") / 10.0, 1).cast("double")
    off = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit("% off off")))
    return t("part").select("p_partkey", F.array_join(P.pros(rating, off, F.array("p_type", "p_brand")), "; ").alias("pros"), F.array_join(P.cons(rating, F.col("p_size") * 3), "; ").alias("cons"))


@query("q_truth", "select p_partkey, case p_partkey % 4 when 0 then 'true' when 1 then 'true' when 2 then 'false' end as yes from part")
def _(spark, t):
    said = F.element_at(F.array(F.lit(" YES"), F.lit("on "), F.lit("off"), F.lit(None)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t("part").select("p_partkey", X.truth(said).cast("string").alias("yes"))


@query("q_json_object", "select event_id, case when event_id % 3 = 0 then (props->>'k')::bigint end as k, event_id % 3 = 0 as is_object from events")
def _(spark, t):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    said = F.when(F.col("event_id") % 3 == 0, fenced).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), F.col("props"), F.lit("]"))).otherwise(F.concat(F.col("props"), F.lit(" {bad")))
    found = t("events").select("event_id", X.fenced_object(said).alias("o"))
    return found.select("event_id", F.get_json_object("o", "$.k").cast("long").alias("k"), F.col("o").isNotNull().alias("is_object"))


@query("q_key_values", "select p_partkey, p_brand as brand_name, p_size::varchar as size from part")
def _(spark, t):
    said = F.concat(F.lit("Size: 0\nno pair\nBrand Name : "), F.col("p_brand"), F.lit("\nsize:"), F.col("p_size").cast("string"))
    found = t("part").select("p_partkey", X.key_values(said).alias("m"))
    return found.select("p_partkey", F.col("m")["brand_name"].alias("brand_name"), F.col("m")["size"].alias("size"))


@query("q_record_subset", "select p_partkey, null::varchar as brand, p_type as kind, case when p_size % 2 = 0 then 1 else 2 end::int as n_filled from part")
def _(spark, t):
    record = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.col("p_type"), F.lit("blank"), F.lit(" "))
    wanted = P.subset(record, F.array(F.lit("kind"), F.lit("blank")))
    filled = P.non_empty(F.when(F.col("p_size") % 2 == 0, wanted).otherwise(record))
    return t("part").select("p_partkey", wanted["brand"].alias("brand"), wanted["kind"].alias("kind"), F.size(filled).alias("n_filled"))


@query("q_valid_product", "select p_partkey, p_partkey % 5 <> 0 and (p_partkey % 2 = 0 or p_partkey % 3 = 0) as is_valid from part")
def _(spark, t):
    k = F.col("p_partkey")
    return t("part").select("p_partkey", P.is_valid_product(F.when(k % 5 != 0, F.col("p_name")).otherwise(" "), F.when(k % 2 == 0, F.col("p_retailprice")), F.when(k % 3 == 0, F.col("p_type")).otherwise("")).alias("is_valid"))


@query("q_auto_evolve")
def _(spark, t):
    rows = t("lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return E.auto_evolve(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag")


@query("q_prose")
def _(spark, t):
    return answers.prose(t("documents").select("doc_id", "text")).select("doc_id", F.sha2("prose", 256).alias("prose_sha256"), F.length("prose").alias("n_chars"))


@query("q_extractive_response")
def _(spark, t):
    asked = t("documents").select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "Summarize the main points").otherwise("Which system is meant?").alias("instruction"))
    return answers.responses(asked).select("doc_id", "response")


@query("q_question_pairs")
def _(spark, t):
    return answers.question_pairs(t("documents"), "doc_id").select("doc_id", "place", "instruction", "output")
