"""Tally queries over lineitem (mentions), part (entities) and supplier (books), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import tally
from quire.plans.keep import Registry
from quire.sources.tables import read

query = Registry()


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    line = read(spark, sf, "lineitem")
    return line.select(
        F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("book"), F.year("l_shipdate").alias("year"), F.concat("l_returnflag", "l_linestatus").alias("spelling"), F.col("l_orderkey").alias("m1"), F.col("l_linenumber").alias("m2"),
        F.when(F.col("l_linenumber") <= 4, "recipe").otherwise("prose").alias("kind"), F.when(F.col("l_returnflag") == "N", "caps").otherwise(F.col("l_returnflag")).alias("family"), (F.col("l_quantity") > 49).alias("numbered"),
    )


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"), tally.folded_key(F.col("p_name")).alias("key"))


def books(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "supplier").select(F.col("s_suppkey").alias("book"), F.col("s_name").alias("title"))


M = """m AS (SELECT l_partkey AS entity, l_suppkey AS book, year(l_shipdate) AS year, l_returnflag || l_linestatus AS spelling, l_orderkey AS m1, l_linenumber AS m2,
  CASE WHEN l_linenumber <= 4 THEN 'recipe' ELSE 'prose' END AS kind, CASE WHEN l_returnflag = 'N' THEN 'caps' ELSE l_returnflag END AS family, l_quantity > 49 AS numbered FROM lineitem)"""
KEY = r"regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(regexp_replace(p_name, '^[\s.,:;|*–—-]+|[\s.,:;|*–—-]+$', '', 'g'))), '^(the|a|an|le|la|el|les|los|las)\s+', ''), '[''’]s\b', 's', 'g'), '[^a-z0-9]+', '', 'g')"
E = f"e AS (SELECT p_partkey AS entity, p_name AS name, {KEY} AS key FROM part)"
ORDERS = {
    "books": "books DESC NULLS FIRST, mentions DESC NULLS FIRST, entity",
    "mentions": "mentions DESC NULLS FIRST, books DESC NULLS FIRST, entity",
    "earliest": "first_year ASC NULLS LAST, books DESC NULLS FIRST, entity",
    "latest": "last_year DESC NULLS FIRST, books DESC NULLS FIRST, entity",
}
AGG = "SELECT entity, count(*)::BIGINT AS mentions, count(DISTINCT book)::BIGINT AS books, min(nullif(year, 0))::INTEGER AS first_year, max(nullif(year, 0))::INTEGER AS last_year, arg_min(book, (nullif(year, 0), m1, m2)) FILTER (nullif(year, 0) IS NOT NULL) AS first_book FROM m"


def survey_sql(order: str, where: str = "", having: int = 1, limit: int = 10, on: str = "") -> str:
    return f"WITH {M}, {E} SELECT a.*, name FROM ({AGG} {where} GROUP BY entity HAVING count(DISTINCT book) >= {having}) a JOIN e USING (entity) {on} ORDER BY {ORDERS[order]} LIMIT {limit}"


def _survey(order: str, **more):
    return lambda spark, sf: tally.survey(mentions(spark, sf), entities(spark, sf), order, **more)


for _order in ORDERS:
    query(f"survey_{_order}", survey_sql(_order))(_survey(_order))
query("survey_windowed", survey_sql("books", "WHERE year BETWEEN 1995 AND 1996"))(_survey("books", first=1995, last=1996))
query("survey_windowed_min_books", survey_sql("earliest", "WHERE year >= 1997", 3, 25))(_survey("earliest", first=1997, min_books=3, limit=100))
query("survey_by_name", survey_sql("mentions", on="WHERE key = 'blueanvil'"))(_survey("mentions", name="The Blue Anvil"))


@query("entity_aggregates", f"WITH {M} {AGG} GROUP BY entity")
def entity_aggregates(spark, sf):
    return tally.aggregate(mentions(spark, sf))


@query("survey_citations_topk", f"""WITH {M}, f AS (SELECT *, row_number() OVER (PARTITION BY entity, book ORDER BY year NULLS LAST, m1, m2) AS n FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year NULLS LAST, m1, m2)::INTEGER AS rank FROM f WHERE n = 1)
SELECT entity, book, year::INTEGER AS year, m1, m2, rank FROM r WHERE rank <= 3""")
def survey_citations_topk(spark, sf):
    return tally.citations(mentions(spark, sf)).select("entity", "book", "year", "m1", "m2", "rank")


SPELL = "s AS (SELECT entity, spelling, count(*)::BIGINT AS n, min((m1, m2)) AS f FROM m GROUP BY entity, spelling), r AS (SELECT entity, spelling, n, row_number() OVER (PARTITION BY entity ORDER BY n DESC, f, spelling)::INTEGER AS rank FROM s)"


@query("survey_spellings", f"WITH {M}, {SPELL} SELECT entity, spelling, n, rank FROM r")
def survey_spellings(spark, sf):
    return tally.spellings(mentions(spark, sf))


@query("mention_mode", f"WITH {M}, {SPELL} SELECT entity, max(spelling) FILTER (rank = 1) AS canonical, coalesce(string_agg(spelling, ',' ORDER BY rank) FILTER (rank > 1), '') AS others FROM r GROUP BY entity")
def mention_mode(spark, sf):
    return tally.aliases(mentions(spark, sf)).select("entity", "canonical", F.concat_ws(",", "others").alias("others"))


COVER = "SELECT (SELECT count(*)::BIGINT FROM m {w}) AS rows_tallied, (SELECT count(DISTINCT book)::BIGINT FROM m {w}) AS books_counted, (SELECT count(*)::BIGINT FROM supplier) AS books_total, (SELECT count(*)::BIGINT FROM (SELECT entity FROM m GROUP BY entity HAVING count(DISTINCT book) >= 2)) AS countable"


def _coverage(**window):
    def run(spark, sf):
        m = mentions(spark, sf)
        return tally.coverage(m, books(spark, sf), tally.aggregate(m).where("books >= 2"), **window)

    return run


query("coverage", f"WITH {M} " + COVER.format(w=""))(_coverage())
query("coverage_windowed", f"WITH {M} " + COVER.format(w="WHERE year BETWEEN 1998 AND 1998"))(_coverage(first=1998, last=1998))


@query("carrying_set", f"""WITH {M}, c AS (SELECT book, count(*) AS n FROM m GROUP BY book), r AS (SELECT row_number() OVER (ORDER BY n DESC, book) AS k, sum(n) OVER (ORDER BY n DESC, book ROWS UNBOUNDED PRECEDING) AS s, sum(n) OVER () AS t FROM c)
SELECT coalesce(min(k) FILTER (s >= 0.9 * t), 0)::BIGINT AS carrying, coalesce(max(t), 0)::BIGINT AS total FROM r""")
def carrying_set(spark, sf):
    return tally.carrying_set(mentions(spark, sf))


@query("tail_histogram", f"WITH {M}, a AS (SELECT count(DISTINCT book) AS b FROM m GROUP BY entity) SELECT count(*) FILTER (b = 1)::BIGINT AS one, count(*) FILTER (b BETWEEN 2 AND 4)::BIGINT AS two_to_four, count(*) FILTER (b BETWEEN 5 AND 9)::BIGINT AS five_to_nine, count(*) FILTER (b >= 10)::BIGINT AS ten_and_more FROM a")
def tail_histogram(spark, sf):
    return tally.tail_histogram(tally.aggregate(mentions(spark, sf)))


@query("suffix_pairs", f"WITH {E}, k AS (SELECT DISTINCT key FROM e UNION SELECT DISTINCT regexp_replace(key, '(anvil|widget|gear|bolt|bracket)$', '') FROM e) SELECT a.key AS bare, b.key AS suffixed FROM k a JOIN k b ON b.key = a.key || 'widget'")
def suffix_pairs(spark, sf):
    keys = entities(spark, sf).select("key")
    return tally.suffix_pairs(keys.union(keys.select(F.regexp_replace("key", "(anvil|widget|gear|bolt|bracket)$", ""))), "widget")


@query("silent_books", f"WITH {M} SELECT s_suppkey AS book, s_name AS title FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_shipdate >= TIMESTAMP '1997-03-01' AND l_shipdate < TIMESTAMP '1997-03-04')")
def silent_books(spark, sf):
    line = read(spark, sf, "lineitem").where("l_shipdate >= timestamp '1997-03-01' and l_shipdate < timestamp '1997-03-04'")
    return tally.silent_books(books(spark, sf), line.select(F.col("l_suppkey").alias("book")))


EVID = f"WITH {M}, {E}, v AS (SELECT entity, count(*)::BIGINT AS mentions, count(DISTINCT book)::BIGINT AS books, round(avg(CASE WHEN kind = 'recipe' THEN 1.0 ELSE 0.0 END), 3)::DOUBLE AS recipe_share, round(avg(CASE WHEN family = 'caps' THEN 1.0 ELSE 0.0 END), 3)::DOUBLE AS caps_share, count(DISTINCT family)::BIGINT AS families, bool_or(coalesce(numbered, false)) AS numbered FROM m GROUP BY entity)"


@query("evidence", f"{EVID} SELECT * FROM v")
def evidence(spark, sf):
    return tally.evidence(mentions(spark, sf))


@query("countability", f"""{EVID}, r AS (SELECT entity, CASE WHEN key IN ('bluegear', 'redbolt') THEN 'division' WHEN key IN ('greenwidget') THEN 'noise' WHEN books < 2 THEN 'one book' WHEN numbered THEN 'numbered'
  WHEN len(regexp_extract_all(name, '\\S+')) > 6 THEN 'sentence' WHEN regexp_matches(lower(name), '^[0-9½¼¾]|\\b(oz|ounces?|dash(es)?|spoons?|glass(es)?)\\b') THEN 'ingredient'
  WHEN length(regexp_replace(name, '[^\\p{{L}}]', '', 'g')) / greatest(length(regexp_replace(name, '\\s', '', 'g')), 1) < 0.6 THEN 'letters' ELSE 'named' END AS reason FROM v JOIN e USING (entity))
SELECT entity, reason, reason IN ('numbered', 'named') AS countable FROM r""")
def countability(spark, sf):
    known = tally.evidence(mentions(spark, sf)).join(entities(spark, sf), "entity")
    return tally.countability(known, ["bluegear", "redbolt"], ["greenwidget"]).select("entity", "reason", "countable")


@query("sentence_openers", f"{EVID} SELECT entity, name FROM v JOIN (SELECT entity, split_part(name, ' ', CASE WHEN entity % 3 = 0 THEN 1 ELSE 2 END) || CASE WHEN entity % 2 = 0 THEN ' x' ELSE '' END AS name FROM e) USING (entity) WHERE len(regexp_extract_all(name, '\\S+')) = 1 AND caps_share = 1 AND NOT numbered")
def sentence_openers(spark, sf):
    n = entities(spark, sf).select("entity", F.concat(F.split_part("name", F.lit(" "), F.when(F.col("entity") % 3 == 0, 1).otherwise(2)), F.when(F.col("entity") % 2 == 0, " x").otherwise("")).alias("name"))
    return tally.sentence_openers(tally.evidence(mentions(spark, sf)).join(n, "entity")).select("entity", "name")


@query("mention_density", f"WITH {M}, p AS (SELECT s_suppkey AS book, (s_suppkey % 7)::BIGINT AS pages FROM supplier), n AS (SELECT book, count(*)::BIGINT AS mentions FROM m GROUP BY book) SELECT book, pages, coalesce(mentions, 0) AS mentions, CASE WHEN pages = 0 THEN 0.0 ELSE round(coalesce(mentions, 0) / pages, 4) END AS density FROM p LEFT JOIN n USING (book)")
def mention_density(spark, sf):
    return tally.density(mentions(spark, sf), books(spark, sf).select("book", (F.col("book") % 7).alias("pages")))


@query("recompute_verify", f"WITH {M}, n AS (SELECT entity, count(*) AS c FROM m GROUP BY entity) SELECT (SELECT count(*) FROM n WHERE entity % 11 = 0)::BIGINT AS missing, 1::BIGINT AS extra, (SELECT count(*) FROM n WHERE entity % 11 = 1)::BIGINT AS different")
def recompute_verify(spark, sf):
    m = mentions(spark, sf)
    stored = tally.aggregate(m).where("entity % 11 <> 0").withColumn("mentions", F.col("mentions") + F.when(F.col("entity") % 11 == 1, 1).otherwise(0))
    ghost = spark.range(1).select(F.lit(-1).cast("long").alias("entity"), F.lit(1).cast("long").alias("mentions"), F.lit(1).cast("long").alias("books"), F.lit(None).cast("int").alias("first_year"), F.lit(None).cast("int").alias("last_year"))
    return tally.drift(stored.select(ghost.columns).union(ghost), m)


@query("top_entities", f"WITH {M}, {E} SELECT name, entity, count(DISTINCT book)::BIGINT AS books, count(*)::BIGINT AS mentions FROM m JOIN e USING (entity) GROUP BY name, entity ORDER BY books DESC, mentions DESC, entity LIMIT 20")
def top_entities(spark, sf):
    return tally.aggregate(mentions(spark, sf)).join(entities(spark, sf), "entity").orderBy(*tally.ranking("books")).limit(20).select("name", "entity", "books", "mentions")


@query("year_ranges", f"WITH {M}, a AS (SELECT entity, min(year) FILTER (entity % 5 <> 0) AS f, max(year) FILTER (entity % 7 <> 0) AS l FROM (SELECT entity, CASE WHEN m1 % 9 <> 0 THEN 1900 + entity % 3 ELSE year END AS year FROM m) GROUP BY entity) SELECT entity, CASE WHEN f IS NULL AND l IS NULL THEN '' WHEN f IS NULL OR l IS NULL OR f = l THEN coalesce(f, l)::VARCHAR ELSE f::VARCHAR || '–' || l::VARCHAR END AS years FROM a")
def year_ranges(spark, sf):
    a = mentions(spark, sf).withColumn("year", F.when(F.col("m1") % 9 != 0, 1900 + F.col("entity") % 3).otherwise(F.col("year"))).groupBy("entity").agg(F.min("year").alias("f"), F.max("year").alias("l"))
    a = a.select("entity", F.when(F.col("entity") % 5 != 0, F.col("f")).alias("f"), F.when(F.col("entity") % 7 != 0, F.col("l")).alias("l"))
    return a.select("entity", tally.year_range(F.col("f"), F.col("l")).alias("years"))
