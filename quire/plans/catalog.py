"""Catalog, source, status and relational queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import catalog as c
from quire.plans.keep import Registry
from quire.sources.tables import read

query = Registry()
COLUMNS = ["name", "size"]


def new_parts(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(F.when(k % 7 != 0, k).otherwise(-k).alias("id"), F.col("p_name").alias("name"), F.when(k % 13 != 0, F.col("p_size")).alias("size"))


def old_parts(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(F.when(k % 5 != 0, k).otherwise(-3 * k).alias("id"), F.col("p_name").alias("name"), F.when(k % 26 != 0, F.col("p_size") + F.when(k % 11 == 0, 1).otherwise(0)).alias("size"))


DIFF = """a AS (SELECT CASE WHEN p_partkey % 7 <> 0 THEN p_partkey ELSE -p_partkey END AS id, p_name AS name, CASE WHEN p_partkey % 13 <> 0 THEN p_size END AS size FROM part),
b AS (SELECT CASE WHEN p_partkey % 5 <> 0 THEN p_partkey ELSE -3 * p_partkey END AS id, p_name AS name, CASE WHEN p_partkey % 26 <> 0 THEN p_size + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END END AS size FROM part),
d AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'created' WHEN a.id IS NULL THEN 'deleted' WHEN a.name IS NOT DISTINCT FROM b.name AND a.size IS NOT DISTINCT FROM b.size THEN 'unchanged' ELSE 'updated' END AS status FROM a FULL JOIN b ON a.id = b.id)"""
query("import_diff", f"WITH {DIFF} SELECT * FROM d")(lambda spark, sf: c.diff(new_parts(spark, sf), old_parts(spark, sf), "id", COLUMNS))
query("import_counts", f"WITH {DIFF} SELECT s AS status, (SELECT count(*) FROM d WHERE d.status = v.s)::BIGINT AS n FROM (VALUES ('created'), ('updated'), ('unchanged'), ('deleted')) v(s)")(
    lambda spark, sf: c.changes(new_parts(spark, sf), old_parts(spark, sf), "id", COLUMNS)
)
query("import_again", "SELECT s AS status, CASE WHEN s = 'unchanged' THEN (SELECT count(*) FROM part) ELSE 0 END::BIGINT AS n FROM (VALUES ('created'), ('updated'), ('unchanged'), ('deleted')) v(s)")(
    lambda spark, sf: c.changes(new_parts(spark, sf), new_parts(spark, sf), "id", COLUMNS)
)


@query("record_hash", "SELECT c_custkey, sha256(length(n) || ':' || n || coalesce(length(s) || ':' || s, '~') || length(c_nationkey::VARCHAR) || ':' || c_nationkey) AS hash FROM (SELECT *, c_name || CASE WHEN c_custkey % 2 = 0 THEN '|=1:' ELSE '~' END AS n, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_mktsegment END AS s FROM customer)")
def record_hash(spark, sf):
    k = F.col("c_custkey")
    n, segment = F.concat("c_name", F.when(k % 2 == 0, "|=1:").otherwise("~")), F.when(k % 3 == 1, "").when(k % 3 == 2, F.col("c_mktsegment"))
    return read(spark, sf, "customer").select("c_custkey", n.alias("n"), segment.alias("s"), "c_nationkey").select("c_custkey", c.record_hash("n", "s", "c_nationkey").alias("hash"))


@query("referential_check", "SELECT DISTINCT l_suppkey + CASE WHEN l_suppkey % 17 = 0 THEN 1000000 ELSE 0 END AS supplier FROM lineitem WHERE l_suppkey % 17 = 0")
def referential_check(spark, sf):
    k = F.col("l_suppkey")
    f = read(spark, sf, "lineitem").select(F.when(k % 3 != 0, k + F.when(k % 17 == 0, 1000000).otherwise(0)).alias("supplier"))
    g = read(spark, sf, "lineitem").select((k + F.when(k % 17 == 0, 1000000).otherwise(0)).alias("supplier"))
    return c.dangling(f.union(g), "supplier", read(spark, sf, "supplier"), "s_suppkey")


@query("nested_flatten", """WITH g AS (SELECT o_orderpriority AS list, o_orderstatus AS section, o_orderkey AS member FROM orders), s AS (SELECT list, section, member, false AS featured, row_number() OVER (PARTITION BY list ORDER BY section, member) AS position FROM g),
f AS (SELECT list, NULL AS section, min(member) AS member, true AS featured, count(*) + 1 AS position FROM g GROUP BY list) SELECT list, section, member, featured, position::INTEGER AS position FROM s UNION ALL SELECT list, section, member, featured, position::INTEGER FROM f""")
def nested_flatten(spark, sf):
    g = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("list"), F.col("o_orderstatus").alias("title")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("members"))
    lists = g.groupBy("list").agg(F.array_sort(F.collect_list(F.struct("title", "members"))).alias("sections"), F.array(F.min(F.col("members")[0])).alias("featured"))
    return c.flatten(lists, "list")


@query("json_island", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT > 50")
def json_island(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k")).where("k > 50")


@query("render_lines", "SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || p_brand ELSE '' END || chr(10) || 'Size: ' || p_size AS text, array_to_string(list_filter(CASE WHEN p_type = p_brand THEN [p_type] ELSE [p_type, p_brand] END, lambda v: v NOT IN ('', 'None', 'Default')), ',') AS keywords, CASE WHEN p_partkey % 3 = 0 THEN 'https://a.example/' || p_partkey ELSE 'https://b.example/p/' || p_partkey END AS url FROM part")
def render_lines(spark, sf):
    k = F.col("p_partkey")
    text = c.lines(F.col("p_name"), F.when(k % 2 == 0, F.col("p_brand")).otherwise(" "), F.lit(None).cast("string"), F.concat(F.lit("Size: "), F.col("p_size").cast("string")))
    url = F.when(k % 3 == 0, F.concat(F.lit("https://a.example/"), k.cast("string"))).otherwise(F.concat(F.lit("/p/"), k.cast("string")))
    words = F.concat_ws(",", c.keywords(F.col("p_type"), F.lit("None"), F.col("p_brand"), F.lit(""), F.col("p_type")))
    return read(spark, sf, "part").select(k, text.alias("text"), words.alias("keywords"), c.absolute(url, "https://b.example/").alias("url"))


@query("unique_slugs", "SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM (SELECT p_partkey, replace(p_name, ' ', '-') AS base, row_number() OVER (PARTITION BY replace(p_name, ' ', '-') ORDER BY p_partkey) AS n FROM part)")
def unique_slugs(spark, sf):
    return c.unique_slugs(read(spark, sf, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("-")).alias("base")), "base", "p_partkey").select("p_partkey", "slug")


NAMES = "CASE p_partkey % 4 WHEN 0 THEN (1600 + p_partkey % 400) || ' - The ' || p_name || ' by A. ' || p_brand || ' (2nd ed).pdf' WHEN 1 THEN p_name || '_(' || (1600 + p_partkey % 400) || ').PDF' WHEN 2 THEN p_name || ' by ' || p_brand || '.pdf' ELSE p_name || ' 2001.pdf' END"


@query("file_metadata", f"""WITH f AS (SELECT p_partkey, p_name, p_brand, p_partkey % 4 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'The ' || p_name WHEN 3 THEN p_name || ' 2001' ELSE p_name END AS title, CASE k WHEN 0 THEN 'A. ' || p_brand WHEN 2 THEN p_brand END AS author, CASE WHEN k < 2 THEN 1600 + p_partkey % 400 END::INTEGER AS year, CASE WHEN k = 0 THEN '2nd ed' END AS edition,
  CASE k WHEN 0 THEN 'the-' || replace(p_name, ' ', '-') WHEN 3 THEN replace(p_name, ' ', '-') || '-2001' ELSE replace(p_name, ' ', '-') END AS slug FROM f""")
def file_metadata(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.inline(F.array(c.file_facts(F.expr(NAMES)))))


@query("catalog_overrides", "SELECT p_partkey, CASE WHEN p_partkey % 100 = 0 THEN 'Over ' || p_partkey ELSE p_name END AS p_name, CASE WHEN p_partkey % 200 = 0 THEN 'none' ELSE p_brand END AS p_brand FROM part")
def catalog_overrides(spark, sf):
    k = F.col("p_partkey")
    p = read(spark, sf, "part").select(k, "p_name", "p_brand")
    o = p.where(k % 100 == 0).select(k, F.concat(F.lit("Over "), k.cast("string")).alias("p_name"), F.when(k % 200 == 0, "none").alias("p_brand"))
    return c.overridden(p, o, "p_partkey", ["p_name", "p_brand"])


@query("file_register", "WITH f AS (SELECT *, CASE WHEN p_partkey % 9 = 0 THEN 'g' ELSE 'f' END || p_partkey AS a, CASE WHEN p_partkey % 4 = 0 THEN 'h' ELSE 'f' END || p_partkey AS b FROM part) SELECT a AS name, CASE WHEN a <> b THEN 'new' WHEN p_partkey % 5 <> 0 THEN 'unchanged' WHEN p_partkey % 10 = 0 THEN 'changed' ELSE 'touched' END AS status FROM f UNION ALL SELECT b, 'missing' FROM f WHERE a <> b")
def file_register(spark, sf):
    k = F.col("p_partkey")
    named = lambda other, rest: F.concat(F.when(rest, other).otherwise("f"), k.cast("string"))
    base = read(spark, sf, "part").select(F.lit("").alias("name"), F.col("p_size").alias("size"), k.alias("modified"), F.sha2("p_name", 256).alias("checksum"), k)
    found = base.withColumns({"name": named("g", k % 9 == 0), "modified": k + F.when(k % 5 == 0, 1).otherwise(0), "checksum": F.when(k % 10 == 0, "x").otherwise(F.col("checksum"))})
    return c.registered(found.drop("p_partkey"), base.withColumn("name", named("h", k % 4 == 0)).drop("p_partkey"))


@query("book_status", """WITH p AS (SELECT source, count(*)::BIGINT AS pages, count(*) FILTER (trim(text, ' ') <> '')::BIGINT AS populated, round(avg(CASE WHEN doc_id % 3 <> 0 THEN doc_id % 10 / 10.0 END), 4)::DOUBLE AS quality FROM documents GROUP BY source),
k AS (SELECT source, count(*)::BIGINT AS chunks, count(*) FILTER (doc_id % 5 <> 0)::BIGINT AS indexable, count(*) FILTER (doc_id % 5 <> 0 AND vec_id IS NOT NULL)::BIGINT AS embedded FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE source <> 'src3' GROUP BY source)
SELECT source, pages, populated, quality, coalesce(chunks, 0) AS chunks, coalesce(indexable, 0) AS indexable, coalesce(embedded, 0) AS embedded, round(100 * populated / pages, 2) AS accounted FROM p LEFT JOIN k USING (source)""")
def book_status(spark, sf):
    d, i = read(spark, sf, "documents"), F.col("doc_id")
    pages = d.select("source", "text", F.when(i % 3 != 0, (i % 10) / 10.0).alias("score"))
    chunks = d.where("source <> 'src3'").join(read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("_e")), "doc_id", "left")
    return c.status(pages, chunks.select("source", (i % 5 != 0).alias("indexable"), F.col("_e").isNotNull().alias("embedded")), "source")


@query("type_counts", "SELECT v.s AS type, (SELECT count(*) FROM events WHERE event_type = v.s)::BIGINT AS n FROM (VALUES ('click'), ('view'), ('never')) v(s)")
def type_counts(spark, sf):
    return c.zero_filled(read(spark, sf, "events").select(F.col("event_type").alias("type")), "type", ["click", "view", "never"])


@query("invariant_rows", "SELECT * FROM (SELECT 'null_keys' AS name, count(*) FILTER (l_orderkey IS NULL)::BIGINT AS n, count(*) FILTER (l_orderkey IS NULL) = 0 AS ok FROM lineitem UNION ALL SELECT 'large', count(*) FILTER (l_quantity > 49)::BIGINT, count(*) FILTER (l_quantity > 49) = 0 FROM lineitem)")
def invariant_rows(spark, sf):
    return c.sound(read(spark, sf, "lineitem").agg(F.count_if(F.col("l_orderkey").isNull()).alias("null_keys"), F.count_if(F.col("l_quantity") > 49).alias("large")))


# Relational shapes that the engine is built of


@query("semi_anti_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_anti_join(spark, sf):
    o = read(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return read(spark, sf, "customer").select("c_custkey").join(o.where("o_orderpriority = '1-URGENT'"), "c_custkey", "left_semi").join(o.where("o_orderstatus = 'P'"), "c_custkey", "left_anti")


@query("through_join", "SELECT s_suppkey, count(DISTINCT o_custkey)::BIGINT AS customers, round(sum(l_extendedprice), 2) AS value FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey GROUP BY s_suppkey HAVING count(DISTINCT o_custkey) > 1")
def through_join(spark, sf):
    line, orders = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    j = line.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_distinct("o_custkey").alias("customers"), F.round(F.sum("l_extendedprice"), 2).alias("value"))
    return j.where("customers > 1").join(read(spark, sf, "supplier").select("s_suppkey"), "s_suppkey", "left_semi")


@query("left_lookup", "SELECT s_suppkey, n_name, coalesce(string_agg(DISTINCT p_brand, ',' ORDER BY p_brand), '') AS brands FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity = 50 LEFT JOIN part ON p_partkey = l_partkey GROUP BY s_suppkey, n_name")
def left_lookup(spark, sf):
    line = read(spark, sf, "lineitem").where("l_quantity = 50").join(read(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    brands = line.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.concat_ws(",", F.sort_array(F.collect_set("p_brand"))).alias("brands"))
    s = read(spark, sf, "supplier").join(F.broadcast(read(spark, sf, "nation")), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return s.join(brands, "s_suppkey", "left").select("s_suppkey", "n_name", F.coalesce("brands", F.lit("")).alias("brands"))


@query("filtered_aggregates", "SELECT o_orderstatus, count(*) FILTER (o_totalprice > 100000)::BIGINT AS large, count(DISTINCT o_custkey)::BIGINT AS customers, round(avg(o_totalprice), 2) AS mean, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last FROM orders GROUP BY o_orderstatus HAVING count(*) > 10")
def filtered_aggregates(spark, sf):
    o = read(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.count_distinct("o_custkey").alias("customers"), F.round(F.avg("o_totalprice"), 2).alias("mean"), F.min("o_orderdate").cast("date").alias("first"), F.max("o_orderdate").cast("date").alias("last"), F.count(F.lit(1)).alias("_n")
    )
    return o.where("_n > 10").drop("_n")


@query("set_operations", "(SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size = 1) EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40")
def set_operations(spark, sf):
    line = read(spark, sf, "lineitem")
    return line.where("l_quantity > 45").select(F.col("l_partkey").alias("id")).union(read(spark, sf, "part").where("p_size = 1").select("p_partkey")).distinct().subtract(line.where("l_returnflag = 'R' and l_quantity > 40").select("l_partkey"))


@query("rollup_report", "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*)::BIGINT AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_report(spark, sf):
    r = read(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return r.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "revenue")


@query("flat_tags", "SELECT 'g' || n_regionkey AS category, n_name AS label, n_nationkey::INTEGER AS \"order\" FROM nation")
def flat_tags(spark, sf):
    tag = F.struct(F.col("n_name").alias("label"), F.col("n_nationkey").cast("int").alias("order"))
    return c.flat_tags(read(spark, sf, "nation").groupBy(F.concat(F.lit("g"), F.col("n_regionkey").cast("string")).alias("label")).agg(F.collect_list(tag).alias("tags")))


@query("list_groups", "SELECT n_regionkey AS id, CASE WHEN n_regionkey % 2 = 0 THEN 'Group' END AS section, n_name AS member, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name)::INTEGER AS position FROM nation")
def list_groups(spark, sf):
    n = read(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.sort_array(F.collect_list("n_name")).alias("members"))
    groups = F.when(F.col("id") % 2 == 0, F.array(F.struct(F.lit("Group").alias("heading"), F.col("members").alias("members"))))
    return c.with_groups(n.withColumn("groups", groups), "id")


@query("missing_files", "SELECT * FROM (VALUES ('menus.json')) v(name)")
def missing_files(spark, sf):
    return c.missing_files(spark, ["tags.json", "menus.json"], read(spark, sf, "region").select(F.lit("tags.json").alias("name")))
