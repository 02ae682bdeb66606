"""The verification suites over lineitem (mentions), part (entities, items), supplier (books) and documents (chunks), with their SQL: each spoils some rows by rule and counts them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import verification as v
from quire.plans import facets, house, tally
from quire.plans.keep import Registry
from quire.sources.tables import read

query = Registry()


def chunks(spark, sf):
    d, k = read(spark, sf, "documents"), F.col("doc_id")
    return d.select(k.alias("chunk"), F.concat(F.lit("Né "), F.coalesce("text", F.lit(""))).alias("text"), (k * 10).alias("char_start"), (k % 50).alias("page_from"), (k % 50 + k % 2).alias("page_to"), (k % 13 != 0).alias("indexable"), "source")


MENTIONS = """s AS (SELECT doc_id, doc_id % 5 AS kind, CASE WHEN doc_id % 17 = 0 THEN 'Ne' ELSE 'Né' END AS heading, CASE WHEN doc_id % 19 = 0 THEN -1 - doc_id ELSE doc_id END AS chunk FROM documents),
b AS (SELECT source, CASE WHEN source <> 'src1' THEN length(source) + 1900 END AS year FROM documents GROUP BY source)"""


@query("mention_checks", f"""WITH {MENTIONS} SELECT count(*) FILTER (chunk <> s.doc_id OR heading = 'Ne' OR s.doc_id % 23 = 0)::BIGINT AS misplaced, count(*) FILTER (chunk = s.doc_id AND s.doc_id % 29 = 0)::BIGINT AS mismatched, count(*) FILTER (chunk = s.doc_id AND s.doc_id % 13 = 0)::BIGINT AS excluded,
  count(*) FILTER (CASE WHEN s.doc_id % 31 = 0 THEN 5 ELSE b.year END IS DISTINCT FROM b.year)::BIGINT AS wrong_year FROM s JOIN documents d USING (doc_id) JOIN b ON b.source = d.source""")
def mention_checks(spark, sf):
    c = chunks(spark, sf)
    books = c.groupBy(F.col("source").alias("book")).agg(F.first(F.when(F.col("source") != "src1", F.length("source") + 1900)).alias("year"))
    k = F.col("chunk")
    m = c.join(books, F.col("source") == F.col("book")).select(
        F.when(k % 17 == 0, "Ne").otherwise("Né").alias("heading"), (F.col("char_start") + F.when(k % 23 == 0, 1).otherwise(0)).alias("char_start"), F.when(k % 19 == 0, -1 - k).otherwise(k).alias("chunk"), (F.col("page_from") + F.when(k % 29 == 0, 1).otherwise(0)).alias("page_from"),
        "page_to", F.when(k % 31 == 0, 5).otherwise(F.col("year")).alias("year"), "book",
    )
    return v.mention_checks(m, c.drop("source"), books)


@query("entity_checks", f"""WITH {tally.M}, n AS (SELECT entity, count(*) AS c, min(year) AS f FROM m GROUP BY entity), p AS (SELECT p_partkey AS entity FROM part),
g AS (SELECT p.entity, c IS NOT NULL AS alive, p.entity % 7 = 0 AS drift, p.entity % 5 = 0 AS bad_key, p.entity % 9 = 0 AS stop, p.entity % 11 = 0 AS ghost FROM p LEFT JOIN n USING (entity))
SELECT count(*) FILTER (NOT alive)::BIGINT AS empty, count(*) FILTER (alive AND drift)::BIGINT AS drifted, count(*) FILTER (alive AND (bad_key OR stop))::BIGINT AS unfoldable, count(*) FILTER (alive AND stop)::BIGINT AS stop_words, 1::BIGINT AS version_sets, count(*) FILTER (entity % 6 = 0)::BIGINT AS other_versions, count(*) FILTER (alive AND ghost)::BIGINT AS orphan_aliases FROM g""")
def entity_checks(spark, sf):
    m = tally.mentions(spark, sf).withColumnRenamed("spelling", "heading")
    k = F.col("entity")
    counts = tally.tally.aggregate(m).select("entity", "mentions", "books", "first_year", "last_year")
    printed = m.groupBy("entity").agg(F.collect_set("heading").alias("aliases"))
    e = tally.entities(spark, sf).join(counts, "entity", "left").join(printed, "entity", "left")
    e = e.withColumn("mentions", F.when(k % 7 == 0, F.col("mentions") + 1).otherwise(F.col("mentions"))).withColumn("key", F.when(k % 9 == 0, "punch").when(k % 5 == 0, "x").otherwise(F.col("key")))
    e = e.withColumn("aliases", F.when(k % 11 == 0, F.concat("aliases", F.array(F.lit("ghost")))).otherwise(F.col("aliases"))).withColumn("versions", F.when(k % 6 == 0, F.array(F.lit(1), F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(1))))
    return v.entity_checks(e, m, ["punch", "cocktails"], (1, 2, 1))


@query("embedding_checks", """WITH c AS (SELECT CASE WHEN vec_id % 9 = 0 THEN NULL WHEN vec_id % 31 = 1 THEN list_transform(embedding, lambda x: 0.0::FLOAT) WHEN vec_id % 37 = 2 THEN embedding[1:63] ELSE embedding END AS vector, vec_id % 8 <> 0 AS indexable, CASE WHEN vec_id % 5 = 0 THEN 'm0' ELSE 'm1' END AS model, vec_id % 3 = 0 AS old,
  vec_id % 13 = 0 AND vec_id % 4 <> 0 OR vec_id % 11 = 0 AS drift FROM embeddings)
SELECT 1::BIGINT AS other_model, 0::BIGINT AS other_dimensions, count(*) FILTER (indexable AND vector IS NULL)::BIGINT AS unembedded, count(*) FILTER (NOT indexable AND vector IS NOT NULL)::BIGINT AS excluded_but_embedded, (count(DISTINCT model || old) FILTER (vector IS NOT NULL) - 1)::BIGINT AS triples,
  count(*) FILTER (vector IS NOT NULL AND (model = 'm0' OR old))::BIGINT AS not_as_configured, count(*) FILTER (len(vector) = 63)::BIGINT AS wrong_width, count(*) FILTER (vector IS NOT NULL AND len(list_filter(vector, lambda x: x <> 0)) = 0)::BIGINT AS zero_norm, count(*) FILTER (vector IS NOT NULL AND drift)::BIGINT AS drifted FROM c""")
def embedding_checks(spark, sf):
    i, e = F.col("vec_id"), F.col("embedding")
    vector = F.when(i % 9 == 0, None).when(i % 31 == 1, F.transform(e, lambda x: F.lit(0.0).cast("float"))).when(i % 37 == 2, F.slice(e, 1, 63)).otherwise(e)
    c = read(spark, sf, "embeddings").select(
        vector.alias("vector"), (i % 8 != 0).alias("indexable"), F.when(i % 5 == 0, "m0").otherwise("m1").alias("model"), F.lit(64).alias("dimensions"), F.when(i % 3 == 0, 1).otherwise(2).alias("version"), F.lit("h").alias("content_hash"),
        F.when(i % 11 != 0, F.when((i % 13 == 0) & (i % 4 != 0), "old").otherwise("h")).alias("embedded_hash"),
    )
    return v.embedding_checks(c, "m1", 64, 2, "m9", 64)


@query("catalog_checks", """SELECT 1::BIGINT AS wrong_counts, (SELECT count(*) FROM lineitem WHERE l_linenumber % 7 = 0 AND l_orderkey % 2 = 0)::BIGINT AS pours_of_nothing, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem))::BIGINT AS without_ingredients,
  (SELECT count(*) FROM part WHERE p_size < 5)::BIGINT AS without_tags, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 20))::BIGINT AS empty_lists""")
def catalog_checks(spark, sf):
    line, part, orders = read(spark, sf, "lineitem"), read(spark, sf, "part"), read(spark, sf, "orders")
    uses = line.select(F.col("l_partkey").alias("item"), F.when(F.col("l_linenumber") % 7 != 0, F.col("l_suppkey")).alias("ingredient"), F.when(F.col("l_orderkey") % 2 != 0, "text").alias("free_text"))
    tags = facets.tags(spark, sf).join(part.where("p_size < 5").select(F.col("p_partkey").alias("item")), "item", "left_anti")
    members = line.where("l_quantity > 20").select(F.col("l_orderkey").alias("list"), F.col("l_partkey").alias("item"))
    manifest = spark.createDataFrame([("items", 3, 3), ("recipes", 4, 5)], "name string, expected long, actual long")
    return v.catalog_checks(part.select(F.col("p_partkey").alias("item")), uses, tags, orders.select(F.col("o_orderkey").alias("list")), members, manifest)


@query("passage_checks", "SELECT count(*) FILTER (p_partkey % 5 = 0)::BIGINT AS wrong_number, count(*) FILTER (p_partkey % 5 = 0 OR p_partkey % 7 = 0)::BIGINT AS stale, count(*) FILTER (p_partkey % 5 <> 0 AND p_partkey % 7 = 0 OR p_partkey % 5 <> 0 AND p_partkey % 11 = 0)::BIGINT AS wrong_hash, count(*) FILTER (p_partkey % 5 <> 0 AND p_partkey % 3 = 0)::BIGINT AS outdated FROM part")
def passage_checks(spark, sf):
    now = house.passages(spark, sf).withColumnRenamed("id", "key")
    k = F.col("key")
    kept = now.where(k % 5 != 0)  # what was never written
    chunks = kept.select("key", F.when(k % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), F.when(k % 11 == 0, "x").otherwise(F.sha2("text", 256)).alias("hash"), F.when(k % 3 == 0, 1).otherwise(2).alias("version"))
    return v.passage_checks(now, chunks, 2)
