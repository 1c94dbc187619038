"""Queries of the tabular operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import drift as D
from ..operators import features as E
from ..operators import profiling as P
from .base import query

LI = "(select l_orderkey, l_linenumber, l_returnflag, case when l_linenumber = 3 then null else l_quantity end as qty, case when l_linenumber = 5 then null else l_returnflag end as flag, l_extendedprice as price from lineitem)"


def li(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("qty"), F.when(F.col("l_linenumber") != 5, F.col("l_returnflag")).alias("flag"), F.col("l_extendedprice").alias("price"))


PARTS = "(select p_partkey, case when p_partkey % 2 = 0 then null else p_size::double end as size, p_brand, p_retailprice as price, 1 as const_col from part)"


def parts(t):
    return t("part").select("p_partkey", F.when(F.col("p_partkey") % 2 != 0, F.col("p_size").cast("double")).alias("size"), "p_brand", F.col("p_retailprice").alias("price"), F.lit(1).alias("const_col"))


def twice(t):
    c = t("customer")
    return c.unionByName(c.where("c_custkey % 10 = 0"))


TWICE = "(select * from customer union all select * from customer where c_custkey % 10 = 0)"
SPIKED = "(select event_id, event_type, case when event_id % 97 = 0 then value * 50 else value end as value from events)"


def spiked(t):
    return t("events").select("event_id", "event_type", F.when(F.col("event_id") % 97 == 0, F.col("value") * 50).otherwise(F.col("value")).alias("value"))


@query("q_preview", "select c_custkey, c_name from customer order by c_custkey limit 10")
def _(spark, t):
    return t("customer").select("c_custkey", "c_name").orderBy("c_custkey").limit(10)


@query("q_rename_columns", "select c_custkey as id, c_name as name, c_acctbal from customer")
def _(spark, t):
    return C.rename_columns(t("customer").select("c_custkey", "c_name", "c_acctbal"), {"c_custkey": "id", "c_name": "name", "absent": "x"})


# The price in tens repeats at every size of the table; whole prices are all distinct in a small one, and go as id-like.
@query("q_drop_columns", "select size, p_brand, cast(floor(price / 10) as bigint) as price from " + PARTS)
def _(spark, t):
    return C.drop_columns(parts(t).withColumn("price", F.floor(F.col("price") / 10)), [], constant=True, id_like=True)


@query("q_extract_regex", "select p_partkey, case when regexp_matches(p_brand, '#(\\d)') then regexp_extract(p_brand, '#(\\d)', 1) end as digit from part")
def _(spark, t):
    return C.extract_regex(t("part"), "p_brand", r"#(\d)", "digit").select("p_partkey", "digit")


@query("q_replace_values", "select c_custkey, case c_mktsegment when 'BUILDING' then 'B' when 'MACHINERY' then 'M' else c_mktsegment end as c_mktsegment from customer")
def _(spark, t):
    return C.replace_values(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", {"BUILDING": "B", "MACHINERY": "M"})


@query("q_drop_rows_missing", f"select * from {LI} where qty is not null and flag is not null")
def _(spark, t):
    return li(t).dropna()


@query("q_junk_columns", "select 'id_like' as reason, count(distinct c_custkey) = count(*) as is_junk from customer")
def _(spark, t):
    return t("customer").agg(F.lit("id_like").alias("reason"), (F.count_distinct("c_custkey") == F.count(F.lit(1))).alias("is_junk"))


@query("q_missing_profile", f"""select 'qty' as column_name, count(*) filter (qty is null) as n_missing, round(count(*) filter (qty is null) * 100.0 / count(*), 2) as pct_missing from {LI}
union all select 'flag', count(*) filter (flag is null), round(count(*) filter (flag is null) * 100.0 / count(*), 2) from {LI}""")
def _(spark, t):
    return P.missing_profile(li(t).select("qty", "flag"))


@query("q_duplicate_count", f"select sum(n)::bigint as n_rows, sum(n - 1)::bigint as n_duplicates, round(sum(n - 1) * 100.0 / sum(n), 2) as pct_duplicates from (select count(*) as n from {TWICE} group by all_cols)".replace("group by all_cols", "group by c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"))
def _(spark, t):
    return P.duplicate_count(twice(t))


@query("q_cardinality_profile", "\nunion all ".join(f"select '{c}' as column_name, count(distinct {c}) as n_distinct, count(distinct {c}) <= 1 as is_constant, count(distinct {c}) <= 2 and count(*) > 100 as is_near_constant, count(distinct {c}) = count(*) as is_id from {PARTS}" for c in ("p_partkey", "size", "p_brand", "const_col")))
def _(spark, t):
    return P.cardinality_profile(parts(t), ["p_partkey", "size", "p_brand", "const_col"])


@query("q_numeric_summary", "\nunion all ".join(f"select '{c}' as column_name, count({c}) as n, count(*) filter ({c} is null) as n_missing, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, round(min({c})::double, 4) as minimum, round(quantile_cont({c}, 0.25), 4) as q1, round(quantile_cont({c}, 0.5), 4) as median, round(quantile_cont({c}, 0.75), 4) as q3, round(max({c})::double, 4) as maximum, round(skewness({c}), 4) as skew, round(kurtosis({c}), 4) as kurt from {LI}" for c in ("qty", "price")))
def _(spark, t):
    return P.numeric_summary(li(t), ["qty", "price"])


@query("q_distribution_stats", "select round(avg(value), 4) as mean, round(quantile_cont(value, 0.5), 4) as median, round(stddev_samp(value), 4) as std, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) as iqr, round(max(value) - min(value), 4) as span from events")
def _(spark, t):
    r = F.round
    return t("events").agg(r(F.avg("value"), 4).alias("mean"), r(F.percentile("value", 0.5), 4).alias("median"), r(F.stddev("value"), 4).alias("std"), r(F.percentile("value", 0.75) - F.percentile("value", 0.25), 4).alias("iqr"), r(F.max("value") - F.min("value"), 4).alias("span"))


@query("q_value_counts", "\nunion all ".join(f"select '{c}' as column_name, {c} as value, count(*) as n, round(count(*) * 100.0 / (select count(*) from lineitem), 2) as pct from lineitem group by {c}" for c in ("l_returnflag", "l_linestatus")))
def _(spark, t):
    return P.value_counts(t("lineitem"), ["l_returnflag", "l_linestatus"])


@query("q_correlation_pairs", "select 'l_quantity' as a, 'l_extendedprice' as b, round(corr(l_quantity, l_extendedprice), 3) as r from lineitem union all select 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 3) from lineitem union all select 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 3) from lineitem")
def _(spark, t):
    return P.correlation_pairs(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("q_spearman", "with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as a, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as b from lineitem) select round(corr(a, b), 4) as rho from r")
def _(spark, t):
    return P.spearman(t("lineitem"), "l_quantity", "l_extendedprice")


@query("q_target_numeric", "select count(o_totalprice) as n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice), 4) as std from orders")
def _(spark, t):
    return t("orders").agg(F.count("o_totalprice").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev("o_totalprice"), 4).alias("std"))


@query("q_target_classes", "with c as (select o_orderstatus, count(*) as n from orders group by 1) select count(*) as n_classes, round(min(n) / max(n), 3) as balance, min(n) / max(n) < 0.5 as imbalanced from c")
def _(spark, t):
    c = t("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("n_classes"), F.round(F.min("n") / F.max("n"), 3).alias("balance"), (F.min("n") / F.max("n") < 0.5).alias("imbalanced"))


@query("q_class_imbalance", "with c as (select event_type, count(*) as n from events group by 1) select event_type, round(n / (select sum(n) from c), 4) as share, n / (select sum(n) from c) > 0.7 as majority from c")
def _(spark, t):
    c = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.join(F.broadcast(total)).select("event_type", F.round(F.col("n") / F.col("total"), 4).alias("share"), (F.col("n") / F.col("total") > 0.7).alias("majority"))


@query("q_histogram", "with e as (select min(value) as lo, (max(value) - min(value)) / 30 as w from events) select least(floor((value - lo) / w), 29)::int as bin, count(*) as n from events, e group by 1")
def _(spark, t):
    return P.histogram(t("events"), "value", 30)


@query("q_quality_report", f"""with b as (select count(*) as n_rows, count(*) filter (size is null) as n_missing, (case when count(distinct const_col) <= 1 then 1 else 0 end)::bigint as n_constant from {PARTS}),
s as (select *, floor(greatest(0, 40 * (1 - 2 * n_missing / (n_rows * 5.0))) + 30 + greatest(0, 30 * (1 - 3 * n_constant / 5.0)))::int as score from b)
select n_rows, n_missing, 0::bigint as n_duplicates, n_constant, score, case when score >= 90 then 'A' when score >= 80 then 'B' when score >= 60 then 'C' when score >= 40 then 'D' else 'F' end as grade from s""")
def _(spark, t):
    return P.quality_report(parts(t))


@query("q_impute_median", f"select l_orderkey, l_linenumber, coalesce(qty, (select quantile_cont(qty, 0.5) from {LI})) as qty, price from {LI}")
def _(spark, t):
    return C.impute(li(t).select("l_orderkey", "l_linenumber", "qty", "price"))


@query("q_impute_mean", f"select l_orderkey, l_linenumber, round(coalesce(qty, (select avg(qty) from {LI})), 4) as qty from {LI}")
def _(spark, t):
    return C.impute(li(t).select("l_orderkey", "l_linenumber", "qty"), numeric="mean").withColumn("qty", F.round("qty", 4))


@query("q_impute_zero", f"select l_orderkey, l_linenumber, coalesce(qty, 0) as qty from {LI}")
def _(spark, t):
    return C.impute(li(t).select("l_orderkey", "l_linenumber", "qty"), numeric="zero").withColumn("qty", F.col("qty").cast("double"))


@query("q_impute_mode", f"select l_orderkey, l_linenumber, coalesce(flag, (select flag from {LI} where flag is not null group by 1 order by count(*) desc, flag limit 1)) as flag from {LI}")
def _(spark, t):
    return C.impute(li(t).select("l_orderkey", "l_linenumber", "flag"))


@query("q_impute_unknown", f"select l_orderkey, l_linenumber, coalesce(flag, 'Unknown') as flag from {LI}")
def _(spark, t):
    return C.impute(li(t).select("l_orderkey", "l_linenumber", "flag"), categorical="unknown")


@query("q_drop_high_missing", f"select p_partkey, p_brand, price, const_col from {PARTS}")
def _(spark, t):
    return C.drop_high_missing(parts(t))


@query("q_dedup_first", "select c_mktsegment, min(c_custkey) as c_custkey from customer group by 1")
def _(spark, t):
    return C.deduplicate(t("customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], ["c_custkey"])


@query("q_dedup_last", "select c_mktsegment, max(c_custkey) as c_custkey from customer group by 1")
def _(spark, t):
    return C.deduplicate(t("customer").select("c_mktsegment", "c_custkey"), ["c_mktsegment"], ["c_custkey"], keep="last")


@query("q_dedup_none", "select c_custkey, c_name from customer where c_custkey % 10 <> 0")
def _(spark, t):
    return C.deduplicate(twice(t).select("c_custkey", "c_name"), ["c_custkey"], [], keep="none")


IQR = f"with b as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from {SPIKED}), e as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from b)"


@query("q_outlier_iqr_clip", f"{IQR} select event_id, round(greatest(least(value, hi), lo), 4) as value from {SPIKED}, e")
def _(spark, t):
    return C.handle_outliers(spiked(t), ["value"]).select("event_id", F.round("value", 4).alias("value"))


@query("q_outlier_iqr_nan", f"{IQR} select event_id, round(case when value between lo and hi then value end, 4) as value from {SPIKED}, e")
def _(spark, t):
    return C.handle_outliers(spiked(t), ["value"], action="nan").select("event_id", F.round("value", 4).alias("value"))


@query("q_outlier_iqr_remove", f"{IQR} select event_id, round(value, 4) as value from {SPIKED}, e where value between lo and hi")
def _(spark, t):
    return C.handle_outliers(spiked(t), ["value"], action="remove").select("event_id", F.round("value", 4).alias("value"))


@query("q_outlier_zscore", f"with e as (select avg(value) - 1.5 * stddev_samp(value) as lo, avg(value) + 1.5 * stddev_samp(value) as hi from {SPIKED}) select event_id, round(greatest(least(value, hi), lo), 4) as value from {SPIKED}, e")
def _(spark, t):
    return C.handle_outliers(spiked(t), ["value"], method="zscore").select("event_id", F.round("value", 4).alias("value"))


MESSY = "(select c_custkey, case when c_custkey % 3 = 0 then concat('  ', lower(c_mktsegment), ' ') else c_mktsegment end as seg from customer)"


def messy(t):
    return t("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" "))).otherwise(F.col("c_mktsegment")).alias("seg"))


@query("q_clean_categorical", f"select c_custkey, lower(trim(seg)) as seg from {MESSY}")
def _(spark, t):
    return C.clean_categorical(messy(t), ["seg"])


@query("q_change_log", f"select c_custkey, 'seg' as column_name, seg as old_value, lower(trim(seg)) as new_value from {MESSY} where seg <> lower(trim(seg))")
def _(spark, t):
    return C.change_log(messy(t), C.clean_categorical(messy(t), ["seg"]), "c_custkey", ["seg"])


@query("q_numeric_text", "select p_partkey, p_size * 1000.0::double as a, round((p_size + 0.5) * 1000, 4)::double as b from part")
def _(spark, t):
    raw = t("part").select("p_partkey", F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit(",000")).alias("a"), F.concat(F.col("p_size").cast("string"), F.lit(".5k")).alias("b"))
    return C.clean_numeric_text(raw, ["a", "b"])


@query("q_infer_types", "select * from (values ('as_number', 'numeric'), ('as_time', 'datetime'), ('seg', 'category'), ('name', 'text')) v(column_name, inferred)")
def _(spark, t):
    c = t("customer")
    return C.infer_types(c.select(F.col("c_custkey").cast("string").alias("as_number"), F.lit("2024-01-02 03:04:05").alias("as_time"), F.col("c_mktsegment").alias("seg"), F.col("c_name").alias("name")))


@query("q_suggestions", "select * from (values ('p_partkey', 'drop_id'), ('size', 'drop_column'), ('const_col', 'drop_constant')) v(column_name, suggestion)")
def _(spark, t):
    return C.suggestions(parts(t).select("p_partkey", "size", "p_brand", "const_col"))


@query("q_label_encode", "select o_orderkey, dense_rank() over (order by o_orderpriority) - 1 as code from orders")
def _(spark, t):
    return E.label_encode(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code").select("o_orderkey", F.col("code").cast("long").alias("code"))


@query("q_onehot", "select l_orderkey, l_linenumber, (l_returnflag = 'A')::int as l_returnflag_A, (l_returnflag = 'N')::int as l_returnflag_N, (l_returnflag = 'R')::int as l_returnflag_R from lineitem")
def _(spark, t):
    return E.one_hot(t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", ["A", "N", "R"])


@query("q_encode_auto", "select l_orderkey, l_linenumber, (l_returnflag = 'N')::int as l_returnflag_N, (l_returnflag = 'R')::int as l_returnflag_R, (dense_rank() over (order by l_linestatus) - 1)::int as l_linestatus from lineitem")
def _(spark, t):
    return E.encode_auto(t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"))


@query("q_datetime_features", "select o_orderkey, year(o_orderdate)::int as o_orderdate_year, month(o_orderdate)::int as o_orderdate_month, day(o_orderdate)::int as o_orderdate_day, (isodow(o_orderdate) - 1)::int as o_orderdate_dayofweek, quarter(o_orderdate)::int as o_orderdate_quarter, (isodow(o_orderdate) >= 6)::int as o_orderdate_is_weekend from orders")
def _(spark, t):
    return E.datetime_features(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", ("year", "month", "day", "dayofweek", "quarter", "is_weekend"))


@query("q_polynomial", "select l_orderkey, l_linenumber, round(l_quantity * l_quantity, 4) as sq, round(l_quantity * l_discount, 4) as cross_term from lineitem")
def _(spark, t):
    made = E.polynomial(t("lineitem"), ["l_quantity", "l_discount"])
    return made.select("l_orderkey", "l_linenumber", F.round("`l_quantity^2`", 4).alias("sq"), F.round("`l_quantity l_discount`", 4).alias("cross_term"))


@query("q_ratio_features", "select l_orderkey, l_linenumber, round(coalesce(l_extendedprice / nullif(l_quantity, 0), 0), 7) as a, round(coalesce(l_tax / nullif(l_discount, 0), 0), 4) as b from lineitem")
def _(spark, t):
    made = E.ratio_features(t("lineitem"), [("l_extendedprice", "l_quantity"), ("l_tax", "l_discount")])
    return made.select("l_orderkey", "l_linenumber", F.round("l_extendedprice_div_l_quantity", 7).alias("a"), F.round("l_tax_div_l_discount", 4).alias("b"))


@query("q_bin_quantile", "with e as (select quantile_cont(l_quantity, 0.25) as a, quantile_cont(l_quantity, 0.5) as b, quantile_cont(l_quantity, 0.75) as c from lineitem) select l_orderkey, l_linenumber, (l_quantity > a)::int + (l_quantity > b)::int + (l_quantity > c)::int as bin from lineitem, e")
def _(spark, t):
    return E.bin_quantile(t("lineitem"), "l_quantity").select("l_orderkey", "l_linenumber", F.col("l_quantity_bin").alias("bin"))


@query("q_bin_uniform", "with e as (select min(value) as lo, max(value) - min(value) as w from events) select event_id, (value > lo + w * 1 / 4)::int + (value > lo + w * 2 / 4)::int + (value > lo + w * 3 / 4)::int as bin from events, e")
def _(spark, t):
    return E.bin_uniform(t("events"), "value").select("event_id", F.col("value_bin").alias("bin"))


for _method, _sql in {
    "standard": "(value - (select avg(value) from events)) / (select stddev_pop(value) from events)",
    "minmax": "(value - (select min(value) from events)) / (select max(value) - min(value) from events)",
    "robust": "(value - (select quantile_cont(value, 0.5) from events)) / (select quantile_cont(value, 0.75) - quantile_cont(value, 0.25) from events)",
}.items():

    @query(f"q_scale_{_method}", f"select event_id, round({_sql}, 4) as value from events")
    def _(spark, t, method=_method):
        return E.scale(t("events").select("event_id", "value"), ["value"], method).select("event_id", F.round("value", 4).alias("value"))


@query("q_low_variance", "select 'l_discount' as column_name union all select 'l_tax'")
def _(spark, t):
    return spark.createDataFrame([(c,) for c in E.low_variance(t("lineitem").select("l_quantity", "l_discount", "l_tax"))], "column_name string")


@query("q_high_correlation", "select 'twice' as column_name")
def _(spark, t):
    df = t("lineitem").select("l_quantity", "l_discount", (F.col("l_quantity") * 2).alias("twice"))
    return spark.createDataFrame([(c,) for c in E.highly_correlated(df, df.columns)], "column_name string")


@query("q_top_variance", "select c as column_name from (select 'l_quantity' as c, var_samp(l_quantity) as v from lineitem union all select 'l_extendedprice', var_samp(l_extendedprice) from lineitem union all select 'l_discount', var_samp(l_discount) from lineitem) order by v desc limit 2")
def _(spark, t):
    return spark.createDataFrame([(c,) for c in E.top_variance(t("lineitem").select("l_quantity", "l_extendedprice", "l_discount"), 2)], "column_name string")


@query("q_undersample", "with r as (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by md5(concat('42', o_orderkey::varchar)), o_orderkey) as r from orders) select o_orderkey, o_orderstatus from r where r <= (select min(n) from (select count(*) as n from orders group by o_orderstatus))")
def _(spark, t):
    return E.balance(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


@query("q_oversample", "select o_orderstatus, (select max(n) from (select count(*) as n from orders group by o_orderstatus)) as n from orders group by 1")
def _(spark, t):
    return E.balance(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", "oversample").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("q_mutual_information", """with e as (select quantile_cont(l_quantity, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from lineitem), b as (select len(list_filter(list_distinct(q), lambda x: l_quantity > x)) as x, l_returnflag as y from lineitem, e),
j as (select x, y, count(*) as n from b group by all), s as (select sum(n) as t from j), m as (select n, sum(n) over (partition by x) as nx, sum(n) over (partition by y) as ny, t from j, s) select round(sum(n / t * ln(n::double * t / (nx * ny))), 4) as mi from m""")
def _(spark, t):
    return E.mutual_information(t("lineitem"), "l_quantity", "l_returnflag")


@query("q_smote")
def _(spark, t):
    return E.smote(t("orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"), "o_orderstatus"), ["o_totalprice", "o_custkey"], "o_orderstatus", "P", "o_orderkey", blocks=64)


@query("q_schema_drift", "select * from (values ('c_custkey', 'shared'), ('c_name', 'missing'), ('c_acctbal', 'shared'), ('extra', 'new')) v(column_name, state)")
def _(spark, t):
    c = t("customer")
    return D.schema_drift(c.select("c_custkey", "c_name", "c_acctbal"), c.select("c_custkey", "c_acctbal", F.lit(1).alias("extra")))


@query("q_ks_drift", """with v as (select l_quantity as x, count(*) filter (l_returnflag = 'R') as a, count(*) filter (l_returnflag = 'A') as b from lineitem where l_returnflag in ('R', 'A') group by 1), s as (select sum(a) as n1, sum(b) as n2 from v),
c as (select sum(a / n1 - b / n2) over (order by x) as d from v, s) select round(max(abs(d)), 6) as d, any_value(n1)::bigint as n1, any_value(n2)::bigint as n2 from c, s""")
def _(spark, t):
    l = t("lineitem")
    return D.ks_statistic(l.where("l_returnflag = 'R'"), l.where("l_returnflag = 'A'"), "l_quantity")


@query("q_mean_drift", "select round(avg(l_quantity) filter (l_returnflag = 'R'), 4) as base_mean, round(avg(l_quantity) filter (l_returnflag = 'A'), 4) as other_mean from lineitem")
def _(spark, t):
    return t("lineitem").agg(F.round(F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), 4).alias("base_mean"), F.round(F.avg(F.when(F.col("l_returnflag") == "A", F.col("l_quantity"))), 4).alias("other_mean"))


KS = "(with v as (select {x} as x, count(*) filter (l_returnflag = 'R') as a, count(*) filter (l_returnflag = 'A') as b from lineitem where l_returnflag in ('R', 'A') group by 1), s as (select sum(a) as n1, sum(b) as n2 from v), c as (select sum(a / n1 - b / n2) over (order by x) as d, n1, n2 from v, s) select (max(abs(d)) * sqrt(any_value(n1) * any_value(n2) / (any_value(n1) + any_value(n2))) > 1.358099)::int as drifted from c)"


@query("q_drift_score", f"""with d as (select drifted from {KS.format(x="l_quantity")} union all select drifted from {KS.format(x="l_discount * case l_returnflag when 'A' then 2 else 1 end")})
select count(*) as n, sum(drifted)::bigint as drifted, greatest(0, floor(100 - 20 - 50.0 * sum(drifted) / count(*)))::bigint as score from d""")
def _(spark, t):
    l = t("lineitem")
    base = l.where("l_returnflag = 'R'").select("l_quantity", "l_discount", "l_tax")
    other = l.where("l_returnflag = 'A'").select("l_quantity", (F.col("l_discount") * 2).alias("l_discount"))
    lost = D.schema_drift(base, other).where("state = 'missing'").count() > 0
    found = [r.drifted for r in D.drift_report(base, other).select("drifted").collect()]  # one row for each column
    return spark.createDataFrame([(len(found), sum(found), D.drift_score(lost, sum(found), len(found)))], "n long, drifted long, score long")


@query("q_synth_fit", "select 'l_quantity' as column_name, count(l_quantity) as n, round(avg(l_quantity), 4) as mean, round(1.06 * stddev_samp(l_quantity) * pow(count(l_quantity), -0.2), 4) as bandwidth from lineitem union all select 'l_tax', count(l_tax), round(avg(l_tax), 4), round(1.06 * stddev_samp(l_tax) * pow(count(l_tax), -0.2), 4) from lineitem")
def _(spark, t):
    return D.fit_synthetic(t("lineitem").select("l_quantity", "l_tax"))


@query("q_synth_generate")
def _(spark, t):
    return D.generate_synthetic(t("lineitem").select("l_quantity", "l_tax", "l_returnflag"), 1000)


@query("q_problem_type", "select 'o_orderstatus' as target, case when true then 'classification' end as problem union all select 'o_totalprice', case when count(distinct o_totalprice) <= 15 and count(distinct o_totalprice) < 0.05 * count(*) then 'classification' else 'regression' end from orders")
def _(spark, t):
    from ..operators.training import problem_type

    o = t("orders")
    return spark.createDataFrame([(c, problem_type(o, c)) for c in ("o_orderstatus", "o_totalprice")], "target string, problem string")
