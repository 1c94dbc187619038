"""Queries of joins, versions, runs, pages, vectors, and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import relational as R
from ..operators import scoring as S
from ..operators import vectors as V
from .base import query
from .near_duplicate_queries import GREEDY


@query("q_label_join", "select d.doc_id, coalesce(l.quality::varchar, 'unlabelled') as quality from documents d left join labels l using (doc_id)")
def _(spark, t):
    return R.last_label(t("documents").select("doc_id"), t("labels"), "doc_id", ["quality"], "quality")


@query("q_verified_join", "select doc_id, quality from documents join labels using (doc_id) where quality = 1")
def _(spark, t):
    return t("documents").select("doc_id").join(t("labels").where("quality = 1").select("doc_id", "quality"), "doc_id")


@query("q_status_counts", "select count(*) filter (quality = 1 and toxic = 0) as valid, count(*) filter (quality = 1 and toxic = 1) as corrected, count(*) filter (quality = 0) as invalid from labels")
def _(spark, t):
    q, x = F.col("quality"), F.col("toxic")
    return t("labels").agg(F.count_if((q == 1) & (x == 0)).alias("valid"), F.count_if((q == 1) & (x == 1)).alias("corrected"), F.count_if(q == 0).alias("invalid"))


@query("q_version_diff", "with o as (select distinct text, lang from documents where doc_id % 10 <> 0), n as (select distinct text, lang from documents where doc_id % 10 <> 1) select (select count(*) from (select * from n except select * from o)) as added, (select count(*) from (select * from o except select * from n)) as removed, (select count(*) from (select * from n intersect select * from o)) as unchanged")
def _(spark, t):
    d = t("documents")
    return R.version_diff(d.where("doc_id % 10 <> 0"), d.where("doc_id % 10 <> 1"), ["text", "lang"])


METRICS = "(select strftime(ts, '%Y-%m-%d') as run_id, event_type as metric, round(avg(value), 6) as value from events group by all)"


def metrics(t):
    return t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))


@query("q_compare_runs", f"with a as (select metric, value as a from {METRICS} where run_id = '2024-01-02'), b as (select metric, value as b from {METRICS} where run_id = '2024-01-03') select metric, a, b, round(b - a, 6) as delta, round((b - a) * 100 / abs(a), 4) as pct, case when metric = 'error' then b < a else b > a end as improved from a full join b using (metric)")
def _(spark, t):
    return R.compare_runs(metrics(t), "2024-01-02", "2024-01-03")


@query("q_best_runs", f"select metric, run_id, value from (select *, row_number() over (partition by metric order by case when metric = 'error' then -value else value end desc, run_id) as r from {METRICS}) where r = 1")
def _(spark, t):
    return R.best_runs(metrics(t))


@query("q_metric_history", f"select run_id, metric, value, lag(value) over (partition by metric order by run_id) as previous, round(value - lag(value) over (partition by metric order by run_id), 6) as change from {METRICS}")
def _(spark, t):
    return R.metric_history(metrics(t), "run_id")


@query("q_retrain_triggers", f"select run_id, metric, value from {METRICS} where (metric = 'click' and value > 50) or (metric = 'view' and value < 50)")
def _(spark, t):
    triggers = spark.createDataFrame([("click", -1e9, 50.0), ("view", 50.0, 1e9)], "metric string, least double, most double")
    return R.retrain_triggers(metrics(t), triggers)


@query("q_page_title", "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages")
def _(spark, t):
    return t("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("q_page_links", "select page_id, unnest(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1))) as href from pages")
def _(spark, t):
    return R.page_links(t("pages")).select("page_id", "href")


@query("q_main_content", "select page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as text from pages")
def _(spark, t):
    return t("pages").select("page_id", X.strip_tags(F.regexp_extract("html", "(?s)<article[^>]*>(.*?)</article>", 1)).alias("text"))


@query("q_strip_tags", "select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as text from pages")
def _(spark, t):
    return t("pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


NOISE = "".join(f"<{x}\\b[^>]*>.*?</{x}>|" for x in ("script", "style", "noscript", "nav", "footer", "header", "aside", "form"))[:-1]


@query("q_html_text", f"select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is){NOISE}', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as text from pages")
def _(spark, t):
    return t("pages").select("page_id", X.visible_text(F.col("html")).alias("text"))


@query("q_url_defragment", "select page_id, regexp_replace(url, '#.*$', '') as url from pages")
def _(spark, t):
    return t("pages").select("page_id", F.regexp_replace("url", "#.*$", "").alias("url"))


@query("q_url_normalize", "with u as (select page_id, regexp_replace(url, '#.*$', '') as u from pages) select min(page_id) as page_id, regexp_replace(concat(lower(regexp_extract(u, '^(https?://[^/?]*)', 1)), substr(u, length(regexp_extract(u, '^(https?://[^/?]*)', 1)) + 1)), '/$', '') as url from u group by 2")
def _(spark, t):
    return t("pages").select("page_id", R.url_form(F.col("url")).alias("url")).groupBy("url").agg(F.min("page_id").alias("page_id"))


@query("q_url_domain_class", "select page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) as host, case when regexp_extract(url, '^https?://([^/?#]*)', 1) like '%.net' then 'network' when regexp_extract(url, '^https?://([^/?#]*)', 1) like '%.com' then 'commerce' else 'other' end as kind from pages")
def _(spark, t):
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    return t("pages").select("page_id", host.alias("host"), F.when(F.endswith(host, F.lit(".net")), "network").when(F.endswith(host, F.lit(".com")), "commerce").otherwise("other").alias("kind"))


@query("q_url_path_filter", "select page_id from pages where regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) like '/en%' and not regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) like '/en/1%'")
def _(spark, t):
    path = F.regexp_extract("url", "^https?://[^/?#]*([^?#]*)", 1)
    return t("pages").where(F.startswith(path, F.lit("/en")) & ~F.startswith(path, F.lit("/en/1"))).select("page_id")


@query("q_link_frontier", "with recursive l as (select distinct o_custkey as source, o_orderkey % 1000 as target from orders), f as (select 1 as node, 0 as depth union select l.target, f.depth + 1 from f join l on f.node = l.source where f.depth < 2) select node::bigint as node, min(depth)::int as depth from f group by 1")
def _(spark, t):
    links = t("orders").select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 1000).alias("target")).distinct()
    return R.frontier(links, spark.createDataFrame([(1,)], "node long"), 2)


@query("q_json_parse", "select event_id, (props->>'k')::bigint as k from events")
def _(spark, t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("q_json_to_text", "select event_id, concat('k: ', props->>'k') as text from events")
def _(spark, t):
    entries = F.map_entries(F.from_json("props", "map<string,string>"))
    return t("events").select("event_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n").alias("text"))


@query("q_union_all", "select c_custkey as key from customer union all select s_suppkey from supplier")
def _(spark, t):
    return t("customer").select(F.col("c_custkey").alias("key")).unionByName(t("supplier").select(F.col("s_suppkey").alias("key")))


@query("q_vector_search", "with s as (select q.vec_id as query_id, e.vec_id, round(list_dot_product(q.embedding::double[], e.embedding::double[]), 6) as score from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 20 = 0) select * from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5")
def _(spark, t):
    e = t("embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return V.exact_search(e.select("vec_id", "embedding"), queries, 5).withColumn("rank", F.col("rank").cast("long"))


SIMILAR = "(select a.vec_id as a, b.vec_id as b, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a join embeddings b on a.vec_id < b.vec_id where list_dot_product(a.embedding::double[], b.embedding::double[]) >= 0.3)"


def similar(t):
    return V.similar_pairs(t("embeddings"), 0.3).withColumn("score", F.round("score", 6))


@query("q_similar_pairs", f"select * from {SIMILAR}")
def _(spark, t):
    return similar(t)


@query("q_embedding_dedup", f"with recursive nd_pairs as (select a, b from {SIMILAR}), {GREEDY} select vec_id from embeddings where vec_id not in (select v from nd_nodes) or vec_id in (select v from nd_kept)")
def _(spark, t):
    return V.greedy_vectors(t("embeddings"), 0.3)


@query("q_balance_tasks", "with w as (select * from (values ('O', 2), ('F', 2), ('P', 1)) v(k, w)), u as (select min(n // w) as unit from (select o_orderstatus as k, count(*) as n from orders group by 1) join w using (k)), r as (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by o_orderkey) as r from orders) select o_orderkey, o_orderstatus from r join w on k = o_orderstatus, u where r <= w * unit")
def _(spark, t):
    return S.balance_tasks(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", {"O": 2, "F": 2, "P": 1})


# Beyond the reference: what a star schema asks for.


@query("x_revenue_by_nation", "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1")
def _(spark, t):
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("x_cube", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def _(spark, t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("x_customers_without_orders", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def _(spark, t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("x_hourly_events", "select date_trunc('hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def _(spark, t):
    return t("events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
