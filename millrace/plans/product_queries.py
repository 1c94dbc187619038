"""Queries of the product operators, over texts made from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset_tools, strict_scoring
from ..operators import products as P
from ..operators.settled import spread
from .base import query

#: Specifications of every so many-th part, which its text tells beside its name, price and rating.
SPECS = {
    2: " GB DDR4 RAM. ", 3: " GB SSD. ", 5: " Year Domestic Warranty. ", 7: " inch LED Display. ", 11: " MP Rear Camera | 12 MP Front Camera. ", 13: " kg. ", 4: " % off. ",
}
LINES = {
    3: "Intel Core i5 Processor", 5: "Windows 11 Home Operating System", 6: "Battery: 5000 mAh", 7: "Touch ID", 8: "Seller: Nokia Store", 9: "Availability: In stock", 14: "16 GB Unified Memory RAM", 17: "Sold with a Samsung case",
}
TEXT = f"""(select p_partkey, p_name, p_brand, p_type, p_retailprice, p_size, concat('Product: ', p_brand, ' ', p_name, ' (', p_size::varchar, ' GB)', chr(10), 'Price: INR ', floor(p_retailprice)::bigint::varchar, chr(10), 'Rating: ', (1 + p_size % 4)::varchar, '.', (p_size % 10)::varchar, '/5 (', p_partkey::varchar, ' reviews)',
{''.join(f"case when p_partkey % {n} = 0 then chr(10) || '{s}' else '' end, " for n, s in LINES.items())} chr(10), {', '.join(f"case when p_partkey % {n} = 0 then ({n} + p_size)::varchar || '{s}' else '' end" for n, s in SPECS.items())}) as text from part)"""


def parts(t):
    return spread(t("part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice", "p_size"))


def texts(t):
    s = lambda c: F.col(c).cast("string")
    every = lambda n, *x: F.when(F.col("p_partkey") % n == 0, F.concat(*x)).otherwise(F.lit(""))
    text = F.concat(
        F.lit("Product: "), "p_brand", F.lit(" "), "p_name", F.lit(" ("), s("p_size"), F.lit(" GB)\nPrice: INR "), F.floor("p_retailprice").cast("long").cast("string"),
        F.lit("\nRating: "), (1 + F.col("p_size") % 4).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"), F.lit("/5 ("), s("p_partkey"), F.lit(" reviews)"),
        *[every(n, F.lit("\n" + line)) for n, line in LINES.items()], F.lit("\n"), *[every(n, (n + F.col("p_size")).cast("string"), F.lit(spec)) for n, spec in SPECS.items()],
    )
    return parts(t).select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice", "p_size", text.alias("text"))


def sql_field(name: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(text, '(?i){p}', 1)), '')" for p in P.FIELDS[name]) + ")"


def sql_words(words) -> str:
    return "|".join(words)


#: The evidence fields in SQL; the name's pattern is its own here, as the engine knows no look-ahead.
FIELD_SQL = {name: sql_field(name) for name in P.FIELDS if name != "product_name"} | {
    "product_name": "regexp_extract(text, 'Product: ([^\\n]+)', 1)",
    "review_count": f"{sql_field('review_count')}::bigint",
    "brand": f"(select upper(b[1]) || b[2:] from (select list_min(regexp_extract_all(lower(text), '\\b({sql_words(P.BRANDS)})\\b', 1)) as b))",
}
EVIDENCE = [c for c in P.RECORD if c != "raw_text"]
EVIDENCE_SQL = f"(select p_partkey, text, {', '.join(f'{FIELD_SQL[c]} as {c}' for c in EVIDENCE)} from {TEXT})"
CATEGORY = "case " + " ".join(f"when regexp_matches(lower(text), '{sql_words(w)}') then '{c}'" for c, w in P.CATEGORIES.items()) + " else 'electronics' end"
PAYLOAD_SQL = f"""(select *, {CATEGORY} as category, case when brand is not null and starts_with(lower(product_name), lower(brand) || ' ') then product_name[length(brand) + 2:] else product_name end as model,
regexp_replace(price, '[^0-9.]', '', 'g')::bigint as price_inr, chip as processor, regexp_extract(rating, '[\\d.]+')::double as rating_value, coalesce(unified_memory, ram) as memory from {EVIDENCE_SQL})"""
PAYLOAD_OF = {k: {"rating": "rating_value", "ram": "memory", "rear_camera": "camera_rear", "front_camera": "camera_front"}.get(k, k) for k in P.PAYLOAD}


@query("q_product_text", f"select p_partkey, text from {TEXT}")
def _(spark, t):
    return texts(t).select("p_partkey", "text")


@query("q_evidence", f"select p_partkey, {', '.join(EVIDENCE)} from {EVIDENCE_SQL}")
def _(spark, t):
    return P.evidence(texts(t)).select("p_partkey", *EVIDENCE)


@query("q_product_name", f"select p_partkey, regexp_extract(text, 'Product: ([^\\n]+)', 1) as product_name from {TEXT}")
def _(spark, t):
    return P.evidence(texts(t)).select("p_partkey", "product_name")


@query("q_brand_match", "select p_partkey, case when p_brand in ('Brand#1', 'Brand#2', 'Brand#3') then p_brand end as brand from part")
def _(spark, t):
    return t("part").select("p_partkey", P.brand_of(F.concat("p_brand", F.lit(" "), "p_name"), ["Brand#3", "Brand#1", "Brand#2"]).alias("brand"))


@query("q_derive_model", "select p_partkey, p_name as model from part")
def _(spark, t):
    return t("part").select("p_partkey", P.derive_model(F.concat("p_brand", F.lit(" "), "p_name"), F.upper("p_brand")).alias("model"))


@query("q_price_normalize", "select p_partkey, p_size * 1500.0::double as a, p_size * 200000.0::double as b, p_size * 1000.0 + 299 as c from part")
def _(spark, t):
    s = F.col("p_size")
    big = F.format_number(s * 1000 + 299, 0)
    return t("part").select("p_partkey", P.price_value(F.concat(F.lit("₹"), (s * 1.5).cast("string"), F.lit("k"))).alias("a"), P.price_value(F.concat((s * 2).cast("string"), F.lit(" lakh"))).alias("b"), P.price_value(F.concat(F.lit("₹"), big)).alias("c"))


@query("q_price_int", "select p_partkey, p_size::bigint * 1000 as price from part")
def _(spark, t):
    return t("part").select("p_partkey", P.price_int(F.concat(F.lit("INR "), F.col("p_size").cast("string"), F.lit(",000"))).alias("price"))


@query("q_rating_count", "select p_partkey, case when p_size <= 5 then p_size::double end as rating from part")
def _(spark, t):
    return t("part").select("p_partkey", P.rating_value(F.concat(F.col("p_size").cast("string"), F.lit(" out of 5"))).alias("rating"))


@query("q_discount", "select p_partkey, case when p_size > 10 then round((1 - 10.0 / p_size) * 100)::double else 0 end as pct from part")
def _(spark, t):
    return t("part").select("p_partkey", F.coalesce(P.discount(F.lit(10.0), F.col("p_size").cast("double")).cast("double"), F.lit(0.0)).alias("pct"))


ASK = "(select p_partkey, case p_partkey % 5 when 0 then 'What is the price and warranty for this item?' when 1 then 'Extract the product data as JSON' when 2 then 'Summarize the storage of the item' when 3 then 'Evaluate the RAM (16 GB)' else 'Tell me the rating and battery' end as ask from part)"


def asks(t):
    k = F.col("p_partkey") % 5
    return parts(t).select("p_partkey", F.when(k == 0, "What is the price and warranty for this item?").when(k == 1, "Extract the product data as JSON").when(k == 2, "Summarize the storage of the item").when(k == 3, "Evaluate the RAM (16 GB)").otherwise("Tell me the rating and battery").alias("ask"))


@query("q_requested_fields", f"select p_partkey, case p_partkey % 5 when 0 then 'price,warranty' when 1 then '{','.join(f for f in P.HINTS if f in P.PAYLOAD)}' when 2 then 'storage' when 3 then 'ram' else 'rating,battery' end as fields from {ASK}")
def _(spark, t):
    return asks(t).select("p_partkey", F.array_join(P.requested_fields(F.col("ask")), ",").alias("fields"))


@query("q_task_type", f"select p_partkey, case p_partkey % 5 when 1 then 'extraction' when 2 then 'summarization' when 3 then 'reasoning' else 'qa' end as task from {ASK}")
def _(spark, t):
    return asks(t).select("p_partkey", P.task_type(F.col("ask")).alias("task"))


@query("q_missing_fields", "select p_partkey, 'ram|battery|touch id' as fields from part")
def _(spark, t):
    said = F.lit("The context does not provide information about ram, battery and touch id.")
    return t("part").select("p_partkey", F.array_join(P.missing_fields(said), "|").alias("fields"))


@query("q_family_key", "select p_partkey, trim(regexp_replace(regexp_replace(lower(concat(p_brand, ' ', p_name)), '[^\\p{L}\\p{N}_\\s/.+-]', ' ', 'g'), '\\s+', ' ', 'g')) as family from part")
def _(spark, t):
    return t("part").select("p_partkey", P.family_key(F.concat("p_brand", F.lit(" "), "p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(" GB)"))).alias("family"))


@query("q_family_dedup", "select min(p_partkey) as p_partkey from part group by p_brand, p_type")
def _(spark, t):
    return P.family_quota(t("part"), "p_brand", "p_type", "p_partkey", 1, 10**9).select("p_partkey")


@query("q_family_quota", "with a as (select p_brand, p_partkey, row_number() over (partition by p_brand, p_type order by p_partkey) as r from part), b as (select p_partkey, row_number() over (partition by p_brand order by p_partkey) as q from a where r = 1) select p_partkey from b where q <= 3")
def _(spark, t):
    return P.family_quota(t("part"), "p_brand", "p_type", "p_partkey").select("p_partkey")


@query("q_grounded", f"select p_partkey, true as price_is_grounded, contains(text, 'SSD') as has_ssd from {TEXT}")
def _(spark, t):
    return texts(t).select("p_partkey", P.grounded(F.concat(F.lit("INR "), F.floor("p_retailprice").cast("long").cast("string")), F.col("text")).alias("price_is_grounded"), P.grounded(F.lit("gb ssd"), F.col("text")).alias("has_ssd"))


@query("q_payload", f"select p_partkey, {', '.join(f'{c} as {k}' for k, c in PAYLOAD_OF.items())} from {PAYLOAD_SQL}")
def _(spark, t):
    whole = P.payload(P.evidence(texts(t)))
    kinds = {"price_inr": "long", "rating": "double", "review_count": "long"}
    said = F.from_json("payload", ", ".join(f"{k} {kinds.get(k, 'string')}" for k in P.PAYLOAD))
    return whole.select("p_partkey", said.alias("said")).select("p_partkey", "said.*")


LACKING = lambda fields: "array_to_string(list_filter([" + ", ".join(f"case when coalesce({c}::varchar, '') in ('', '0', '0.0') then '{k.replace('_', ' ')}' end" for k, c in fields.items()) + "], lambda x: x is not null), '|')"


@query("q_missing_specs", f"select p_partkey, {LACKING(PAYLOAD_OF)} as core, {LACKING({k: 'memory' if k == 'ram' else k for k in P.OPTIONAL})} as optional from {PAYLOAD_SQL}")
def _(spark, t):
    return P.missing_specs(P.evidence(texts(t))).select("p_partkey", F.array_join("core_missing", "|").alias("core"), F.array_join("optional_missing", "|").alias("optional"))


@query("q_make_tasks", f"""select task_type, count(*) as n from (select unnest(list_filter(['extraction', 'summarization', case when price is not null or storage is not null then 'qa' end,
case when processor is not null or storage is not null then 'reasoning' end], lambda x: x is not null)) as task_type from {PAYLOAD_SQL} where model <> '' and not regexp_matches(model, '\\.\\.\\.|…|-$')) group by 1""")
def _(spark, t):
    return P.tasks_of(P.evidence(texts(t)), "p_partkey").groupBy("task_type").agg(F.count(F.lit(1)).alias("n"))


@query("q_verify", f"select 'valid' as status, count(*) filter (p_partkey % 4 <> 0) as n from {TEXT} union all select 'corrected', count(*) filter (p_partkey % 4 = 0) from {TEXT}")
def _(spark, t):
    wrong = F.when(F.col("p_partkey") % 4 == 0, "No idea.").otherwise(F.concat(F.lit("It costs INR "), F.floor("p_retailprice").cast("long").cast("string"), F.lit(".")))
    samples = texts(t).select("p_partkey", F.lit("What is the price?").alias("instruction"), F.col("text").alias("input"), wrong.alias("output"))
    return P.verified(samples).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("q_task_allocation", "with r as (select p_partkey, row_number() over (order by md5(concat('42', p_partkey::varchar)), p_partkey) - 1 as r, count(*) over () as n from part) select p_partkey, case when r < n * 4 // 10 then 'extraction' when r < n * 7 // 10 then 'qa' when r < n * 9 // 10 then 'summarization' else 'reasoning' end as task from r")
def _(spark, t):
    from ..operators.profiling import running_sum

    lot = t("part").select("p_partkey", F.concat(F.md5(F.concat(F.lit("42"), F.col("p_partkey").cast("string"))), F.lpad(F.col("p_partkey").cast("string"), 20, "0")).alias("lot"), F.lit(1).alias("one"))
    n = lot.count()
    r = F.col("upto") - 1
    return running_sum(lot, "lot", "one", "upto").select("p_partkey", F.when(r < n * 4 // 10, "extraction").when(r < n * 7 // 10, "qa").when(r < n * 9 // 10, "summarization").otherwise("reasoning").alias("task"))


STRICT = """with s as (select p_partkey, p_partkey % 6 as k, trim(regexp_replace(regexp_replace(lower(concat(p_brand, ' ', p_name)), '[^\\p{L}\\p{N}_\\s/.+-]', ' ', 'g'), '\\s+', ' ', 'g')) as family from part),
first as (select min(p_partkey) as p_partkey, true as chosen from s where k = 0 group by family)
select p_partkey, case k when 0 then case when chosen is null then 'near_duplicate_family' else '' end when 1 then 'not_grounded' when 2 then 'hallucinated_fields,instruction_mismatch,not_grounded' when 3 then 'invalid_json' when 4 then 'reasoning_format,not_grounded' else 'empty_output' end as issues,
case k when 0 then 'qa' when 1 then 'qa' when 2 then 'extraction' when 3 then 'extraction' when 4 then 'reasoning' else 'summarization' end as task_type from s left join first using (p_partkey)"""


def samples(t):
    """A sample for each part: right, wrong by one price, with an unknown key, without JSON, without form, empty."""
    k, price = F.col("p_partkey") % 6, F.floor("p_retailprice").cast("long").cast("string")
    ask = F.when(k <= 1, "What is the price?").when(k == 2, "Extract the brand").when(k == 3, "Extract the price").when(k == 4, "Evaluate this item").otherwise("Summarize it")
    said = F.when(k == 0, F.concat(F.lit("Price: INR "), price)).when(k == 1, F.concat(F.lit("Price: INR "), price, F.lit("77"))).when(k == 2, '{"color": "qqq"}').when(k == 3, "qqq").when(k == 4, "Buy one!").otherwise("")
    return texts(t).select("p_partkey", ask.alias("instruction"), F.col("text").alias("input"), said.alias("output"))


@query("q_strict_score", STRICT)
def _(spark, t):
    return strict_scoring.strict_score(samples(t), "p_partkey").select("p_partkey", F.array_join("issues", ",").alias("issues"), "task_type")


@query("q_reject_counts", f"with r as ({STRICT}), c as (select unnest([{', '.join(repr(x) for x in strict_scoring.REASONS)}]) as reason) select 'rejected_' || reason as counter, (select count(*) from r where contains(issues, reason)) as n from c union all select 'total_samples', count(*) from r union all select 'passed', count(*) filter (issues = '') from r union all select 'rejected', count(*) filter (issues <> '') from r")
def _(spark, t):
    return strict_scoring.reject_counts(strict_scoring.strict_score(samples(t), "p_partkey"))


@query("q_clean_dataset", """with s as (select p_partkey, case when p_partkey % 2 = 0 then 'Extract specs' else 'Extract product specifications' end as instruction, concat('Dell Inspiron ', p_size::varchar, ' 16 GB RAM') as input,
concat('{"brand":"', case when p_partkey % 3 = 0 then 'HP' else 'Dell' end, '","model":"Inspiron ', p_size::varchar, '","ram":"16GB","storage":"', case when p_partkey % 3 = 0 then (p_partkey % 7)::varchar || ' TB SSD' else '' end, '","memory_type":"RAM"}') as output from part)
select min(p_partkey) as p_partkey, instruction, input, output from s group by all""")
def _(spark, t):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    told = F.when(k % 3 == 0, F.concat(F.lit('```json\n{"Manufacturer": "HP", "ssd": null, "disk": "'), (k % 7).cast("string"), F.lit(' TB SSD"}\n```'))).when(k % 3 == 1, "plain words").otherwise(F.lit(None))
    rows = t("part").select("p_partkey", F.when(k % 2 == 0, "Extract  specs").otherwise("Hi").alias("instruction"), F.concat(F.lit("Dell Inspiron "), size, F.lit(" Buy Now | 16 GB RAM")).alias("input"), told.alias("output"))
    return dataset_tools.clean_dataset(rows, "p_partkey")


@query("q_verify_dataset", f"""select p_partkey, case p_partkey % 4 when 0 then '' when 1 then 'Hallucination: output field ''price'' not grounded in input;Instruction/output mismatch: ''price'' not addressed' when 2 then 'Extraction task output is not valid JSON;Missing information logic violation: output should state missing context fields;Instruction/output mismatch: ''rating'' not addressed' else 'Missing instruction' end as issues,
case p_partkey % 4 when 0 then 'valid' when 3 then 'invalid' else 'corrected' end as status, case p_partkey % 4 when 1 then 'Price: INR ' || floor(p_retailprice)::bigint::varchar when 2 then concat('{{', chr(10), '  "rating": "', (1 + p_size % 4)::varchar, '.', (p_size % 10)::varchar, '/5",', chr(10), '  "missing_information": "The context does not provide information about chip."', chr(10), '}}') else '' end as corrected_output from {TEXT}""")
def _(spark, t):
    k, price = F.col("p_partkey") % 4, F.floor("p_retailprice").cast("long").cast("string")
    ask = F.when(k <= 1, "What is the price?").when(k == 2, "Extract the rating and chip").otherwise("")
    said = F.when(k == 0, F.concat(F.lit("Price: INR "), price)).when(k == 1, F.concat(F.lit("Price: INR 5"), price, F.lit("77"))).when(k == 2, "qqq")
    rows = texts(t).select("p_partkey", ask.alias("instruction"), F.col("text").alias("input"), said.alias("output"))
    return dataset_tools.verify_dataset(rows).select("p_partkey", F.array_join("issues", ";").alias("issues"), "status", "corrected_output")


#: What the parts are asked for, in turn.
EXTRACTIONS = ["Extract the brand and numeric price", "Give all available product data", "Parse the camera", "Find the front camera and memory", "Tell me of it", "Model, chip, screen and number of reviews"]
EXTRACTION_ASK = f"(select p_partkey, ([{', '.join(f'{chr(39)}{a}{chr(39)}' for a in EXTRACTIONS)}])[p_partkey % {len(EXTRACTIONS)} + 1] as ask from part)"
NAMED = ", ".join(f"case when regexp_matches(lower(ask), '{sql_words(P.EXTRACTION_HINTS[k])}')" + (" or (contains(lower(ask), 'camera') and not regexp_matches(lower(ask), '(rear|front) camera'))" if k.endswith("camera") else "") + f" then '{k}' end" for k in P.PAYLOAD)


@query("q_extraction_fields", f"with n as (select p_partkey, ask, list_filter([{NAMED}], lambda x: x is not null) as named from {EXTRACTION_ASK}) select p_partkey, case when len(named) = 0 or regexp_matches(lower(ask), '{sql_words(P.WHOLE_EXTRACTION)}') then '{','.join(P.PAYLOAD)}' else array_to_string(named, ',') end as fields from n")
def _(spark, t):
    ask = F.element_at(F.array(*map(F.lit, EXTRACTIONS)), (F.col("p_partkey") % len(EXTRACTIONS) + 1).cast("int"))
    return t("part").select("p_partkey", F.array_join(P.extraction_fields(ask), ",").alias("fields"))


@query("q_structured_payload", "select p_partkey, p_brand as brand, p_name as model, concat('INR ', p_size::varchar, ',000.50') as price, p_size::bigint * 1000 as price_inr, case when p_partkey % 2 = 0 then '8 GB' else '16 GB' end as ram, (1 + p_size % 4 + 0.2)::double as rating, case when p_partkey % 3 = 0 then null else 1000 + p_size end::bigint as review_count, '12 MP' as rear_camera from part")
def _(spark, t):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey")
    held = {
        "brand": F.concat(F.lit(" "), "p_brand"), "product_name": F.concat("p_brand", F.lit(" "), "p_name"), "price": F.concat(F.lit("INR "), size, F.lit(",000.50")),
        "ram": F.when(k % 2 == 0, "8 GB").otherwise(""), "unified_memory": F.lit("16 GB"), "rating": F.concat((1 + F.col("p_size") % 4).cast("string"), F.lit(".25")),
        "reviews": F.when(k % 3 == 0, "many").otherwise(F.concat(F.lit("1,"), F.lpad(size, 3, "0"))), "camera": F.lit("12 MP"),
    }
    record = F.create_map(*[x for name, v in held.items() for x in (F.lit(name), v)])
    found = P.structured_payload(record)
    return t("part").select("p_partkey", found.alias("p")).select("p_partkey", *[f"p.{c}" for c in ("brand", "model", "price", "price_inr", "ram", "rating", "review_count", "rear_camera")])
