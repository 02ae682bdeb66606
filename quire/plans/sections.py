"""Section, report and resolution queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import sections as s
from quire.operators import structure
from quire.plans import tally, text
from quire.plans.keep import Registry
from quire.sources.tables import read

query = Registry()
HEADS = "heads AS (SELECT (p_size % 20)::BIGINT AS book, p_partkey AS page, p_name AS head FROM part), titles AS (SELECT DISTINCT book, 'blue anvi' AS title FROM heads)"


def heads(spark, sf):
    return read(spark, sf, "part").select((F.col("p_size") % 20).cast("long").alias("book"), F.col("p_partkey").alias("page"), F.col("p_name").alias("head"))


SEEN = f"""{HEADS}, seen AS (SELECT book, head, count(*)::BIGINT AS times, min(page) AS page_from, max(page) AS page_to, (SELECT count(*) FROM heads h WHERE h.book = heads.book) AS total FROM heads GROUP BY book, head),
c AS (SELECT book, head, times, page_from, page_to, CASE WHEN times / total >= 0.35 OR 1 - levenshtein(lower(head), lower(title)) / greatest(length(head), length(title), 1) >= 0.8 THEN 'title' WHEN length(regexp_replace(head, '[^\\p{{L}}]', '', 'g')) >= 4 AND times >= 3 AND page_to - page_from + 1 >= 3 AND times / (page_to - page_from + 1) >= 0.25 THEN 'chapter' ELSE 'other' END AS kind FROM seen LEFT JOIN titles USING (book))"""


@query("section_kinds", f"WITH {SEEN} SELECT * FROM c")
def section_kinds(spark, sf):
    h = heads(spark, sf)
    return s.classified(h, h.select("book").distinct().withColumn("title", F.lit("blue anvi")))


PIECES = "p AS (SELECT l_suppkey AS book, l_returnflag AS head, l_orderkey * 31 % 40000 AS page_from, l_orderkey * 31 % 40000 + l_linenumber AS page_to, 1::BIGINT AS times FROM lineitem)"


def sections(spark, sf):
    k = F.col("l_orderkey")
    return read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("book"), F.col("l_returnflag").alias("head"), (k * 31 % 40000).alias("page_from"), (k * 31 % 40000 + F.col("l_linenumber")).alias("page_to"), F.lit(1).cast("long").alias("times"))


MERGED = f"""{PIECES}, r AS (SELECT *, max(page_to) OVER (PARTITION BY book, head ORDER BY page_from, page_to ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
t AS (SELECT *, sum(CASE WHEN reach IS NULL OR page_from > reach + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY book, head ORDER BY page_from, page_to ROWS UNBOUNDED PRECEDING) AS part FROM r),
m AS (SELECT book, head, min(page_from)::BIGINT AS page_from, max(page_to)::BIGINT AS page_to, sum(times)::BIGINT AS times FROM t GROUP BY book, head, part)"""


@query("section_merge", f"WITH {MERGED} SELECT * FROM m")
def section_merge(spark, sf):
    return s.merged(sections(spark, sf))


PAGES = "g AS (SELECT s_suppkey AS book, k AS page FROM supplier, range(0, 40000, 997) r(k))"
SEQ = "q AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page_from, head, page_to) AS sequence FROM m)"


def pages(spark, sf):
    return read(spark, sf, "supplier").select(F.col("s_suppkey").alias("book"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39999).cast("long"), F.lit(997).cast("long"))).alias("page"))


def sequenced(spark, sf):
    from pyspark.sql import Window

    return s.merged(sections(spark, sf)).withColumn("sequence", F.row_number().over(Window.partitionBy("book").orderBy("page_from", "head", "page_to")))


FOR = f"{MERGED}, {SEQ}, {PAGES}, f AS (SELECT g.book, g.page, arg_max(head, sequence) AS section FROM g LEFT JOIN q ON q.book = g.book AND page BETWEEN page_from AND page_to GROUP BY g.book, g.page)"


@query("section_for_page", f"WITH {FOR} SELECT * FROM f")
def section_for_page(spark, sf):
    return s.section_for(pages(spark, sf), sequenced(spark, sf))


@query("section_outline", f"WITH {FOR} SELECT q.book, q.head, page_from, page_to, coalesce(n, 0)::BIGINT AS chunks FROM q LEFT JOIN (SELECT book, section AS head, count(*) AS n FROM f GROUP BY book, section) USING (book, head)")
def section_outline(spark, sf):
    q = sequenced(spark, sf)
    return s.outline(q, s.section_for(pages(spark, sf), q)).select("book", "head", "page_from", "page_to", "chunks")


CH = "c AS (SELECT doc_id AS id, source AS book, n_chars AS size, CASE lang WHEN 'en' THEN 'prose' WHEN 'de' THEN 'recipe' ELSE 'unknown' END AS kind, doc_id AS page_from, doc_id + 3 AS page_to, text FROM documents)"


def chunks(spark, sf):
    lang, i = F.col("lang"), F.col("doc_id")
    return read(spark, sf, "documents").select(i.alias("id"), F.col("source").alias("book"), F.col("n_chars").alias("size"), F.when(lang == "en", "prose").when(lang == "de", "recipe").otherwise("unknown").alias("kind"), i.alias("page_from"), (i + 3).alias("page_to"), "text")


@query("chunk_report", f"WITH {CH} SELECT book, count(*)::BIGINT AS chunks, max(size) AS largest, count(*) FILTER (kind = 'recipe')::BIGINT AS recipe, count(*) FILTER (kind = 'prose')::BIGINT AS prose, count(*) FILTER (kind = 'unknown')::BIGINT AS unknown, list_sort(list(size))[count(*) // 2 + 1] AS median FROM c GROUP BY book")
def chunk_report(spark, sf):
    return s.chunk_report(chunks(spark, sf), "book")


@query("chunk_browse", f"WITH {CH} SELECT id, book, kind FROM c WHERE page_to >= 50 AND page_from <= 120 AND kind IN ('prose', 'recipe') AND contains(lower(text), 'schein') ORDER BY id LIMIT 9")
def chunk_browse(spark, sf):
    return s.browse(chunks(spark, sf), 50, 120, ["prose", "recipe"], "SCHEIN", 9).select("id", "book", "kind")


@query("pending_by_book", "SELECT source AS book, count(*)::BIGINT AS pending FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id AND label <> 3) GROUP BY source")
def pending_by_book(spark, sf):
    have = read(spark, sf, "embeddings").where("label <> 3").select(F.col("vec_id").alias("doc_id"))
    return read(spark, sf, "documents").join(have, "doc_id", "left_anti").groupBy(F.col("source").alias("book")).agg(F.count(F.lit(1)).alias("pending"))


@query("alias_fold", f"WITH {tally.E}, a(key, canonical) AS (VALUES ('bluegear', 'gear'), ('redgear', 'gear')) SELECT coalesce(canonical, key) AS key, count(*)::BIGINT AS n FROM e LEFT JOIN a USING (key) GROUP BY ALL")
def alias_fold(spark, sf):
    a = spark.createDataFrame([("bluegear", "gear"), ("redgear", "gear")], "key string, canonical string")
    return s.aliased(tally.entities(spark, sf), a).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("fuzzy_resolve", f"WITH {tally.E}, k AS (SELECT key, min(entity) AS first FROM e GROUP BY key) SELECT key, coalesce((SELECT arg_min(o.key, (o.first, o.key)) FROM k o WHERE o.first < k.first AND length(o.key) >= 6 AND length(k.key) >= 6 AND levenshtein(o.key, k.key) <= 2), key) AS resolved FROM k")
def fuzzy_resolve(spark, sf):
    k = tally.entities(spark, sf).groupBy("key").agg(F.min("entity").alias("first"))
    return s.resolved(k, structure.fuzzy_pairs(k, 2))


@query("hydrate_ranked", "SELECT v.rank::INTEGER AS rank, doc_id AS id, source FROM (VALUES (5, 1), (3, 2), (999999, 3), (8, 4)) v(id, rank) JOIN documents ON doc_id = v.id")
def hydrate_ranked(spark, sf):
    ranked = spark.createDataFrame([(5, 1), (3, 2), (999999, 3), (8, 4)], "id long, rank int")
    return s.hydrated(ranked, read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")).select("rank", "id", "source")


@query("show_entity", f"WITH {tally.M}, {tally.E} SELECT entity, book, year::INTEGER AS year, m1, m2 FROM m WHERE entity IN (SELECT entity FROM e WHERE key = 'bluegear') ORDER BY year NULLS LAST, m1, m2 LIMIT 20")
def show_entity(spark, sf):
    return s.shown(tally.mentions(spark, sf), tally.entities(spark, sf), "bluegear").select("entity", "book", "year", "m1", "m2")


GUIDED = """heads AS (SELECT (p_size % 20)::BIGINT AS book, p_partkey AS page, CASE WHEN p_size % 20 = 7 THEN 'zz ' || p_partkey WHEN p_partkey % 3 = 0 THEN upper(p_type) || 'S BL-' || CASE WHEN p_partkey % 2 = 0 THEN 'BO' ELSE 'CAM.' END WHEN p_partkey % 3 = 1 THEN 'Gear of ' || p_brand ELSE p_name END AS head FROM part),
titles AS (SELECT DISTINCT book, 'blue anvi' AS title FROM heads), st AS (SELECT *, nullif(trim(regexp_extract(trim(head), '^(.*?\\p{L}.*?)\\s+\\p{Lu}{1,3}\\s*[-–—]\\s*\\p{Lu}{1,3}\\.?$', 1)), '') AS stem FROM heads)"""


def guided(spark, sf):
    k = F.col("page")
    p = read(spark, sf, "part").select((F.col("p_size") % 20).cast("long").alias("book"), F.col("p_partkey").alias("page"), "p_type", "p_brand", "p_name")
    guide = F.concat(F.upper("p_type"), F.lit("S BL-"), F.when(k % 2 == 0, "BO").otherwise("CAM."))
    head = F.when(F.col("book") == 7, F.concat(F.lit("zz "), k.cast("string"))).when(k % 3 == 0, guide).when(k % 3 == 1, F.concat(F.lit("Gear of "), "p_brand")).otherwise(F.col("p_name"))
    return p.select("book", "page", head.alias("head"))


@query("guide_words", f"WITH {GUIDED} SELECT page, stem FROM st")
def guide_words(spark, sf):
    return guided(spark, sf).select("page", s.guide_stem(F.col("head")).alias("stem"))


CLASSES = SEEN[SEEN.index("seen AS") :]


@query("sections_detected", f"""WITH {GUIDED}, {CLASSES}, named AS (SELECT book, stem AS head, 'section' AS kind, min(page) AS page_from, max(page) AS page_to, count(*)::BIGINT AS times FROM st WHERE stem IS NOT NULL GROUP BY book, stem
  UNION ALL SELECT book, head, kind, page_from, page_to, times FROM c WHERE kind <> 'other' AND head NOT IN (SELECT head FROM st WHERE stem IS NOT NULL)),
every AS (SELECT * FROM named UNION ALL SELECT book, NULL, 'body', min(page), max(page), 0 FROM heads WHERE book NOT IN (SELECT book FROM named WHERE kind IN ('section', 'chapter')) GROUP BY book)
SELECT *, CASE WHEN kind <> 'body' THEN round(times / (page_to - page_from + 1), 4) END AS confidence FROM every""")
def sections_detected(spark, sf):
    h = guided(spark, sf)
    return s.detected(h, h.select("book").distinct().withColumn("title", F.lit("blue anvi")), h.select("book", "page")).select("book", "head", "kind", "page_from", "page_to", "times", "confidence")


@query("heads_at_edges", """WITH l AS (SELECT source AS book, doc_id AS page, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM documents), h AS (SELECT book, page, 'top' AS edge, ls[1] AS head FROM l UNION ALL SELECT book, page, 'bottom', ls[len(ls)] FROM l)
SELECT * FROM h WHERE length(head) <= 80 AND length(regexp_replace(head, '[^\\p{L}]', '', 'g')) >= 3 AND NOT regexp_matches(head, '^[0-9]|\\boz\\b')""")
def heads_at_edges(spark, sf):
    p = read(spark, sf, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text")
    at = lambda edge: s.heads_at(p, edge, "^[0-9]|\\boz\\b").select("book", "page", F.lit(edge).alias("edge"), "head")
    return at("top").unionByName(at("bottom"))


PLACED = text.KIND.replace("CASE doc_id % 11 WHEN 1 THEN 'before' WHEN 2 THEN 'after' ELSE 'body' END", "CASE WHEN doc_id + 1 < 90 THEN 'before' WHEN doc_id > 150 THEN 'after' ELSE 'body' END")


@query("chunk_rows", f"""WITH {text.MIXED}, {text.SIG}, {PLACED}, o AS (SELECT DISTINCT doc_id, CASE WHEN doc_id % 40 < 30 THEN 'part ' || (doc_id // 40) END AS section FROM src)
SELECT doc_id % 3 AS book, doc_id AS chunk, section, split_part(k, '/', 1) AS kind, split_part(k, '/', 2) AS reason, doc_id AS page_from, doc_id + 1 AS page_to, CASE WHEN doc_id % 2 = 0 THEN 'p' || doc_id END AS printed_from, CASE WHEN doc_id % 2 = 1 THEN 'p' || (doc_id + 1) END AS printed_to,
  CASE WHEN doc_id % 2 = 0 THEN doc_id % 10 = 0 ELSE (doc_id + 1) % 10 = 0 END AS estimated, sha256(text) AS content_hash, split_part(k, '/', 1) IN ('recipe', 'recipe_list', 'prose', 'unknown') AS indexable FROM c JOIN src USING (doc_id) JOIN o USING (doc_id)""")
def chunk_rows(spark, sf):
    i = F.col("chunk")
    c = text.mixed(spark, sf).withColumnRenamed("doc_id", "chunk").select(
        (i % 3).alias("book"), "chunk", "text", i.alias("page_from"), (i + 1).alias("page_to"), F.when(i % 7 != 0, i % 6).alias("headings"), F.when(i % 3 == 0, 0.5).otherwise(0.95).alias("score"), (i % 13 != 0).alias("english")
    )
    books = spark.range(3).select(F.col("id").alias("book"))
    parts = c.select(F.floor(i / 40).alias("sequence")).distinct().crossJoin(F.broadcast(books))  # three books
    found = parts.select("book", "sequence", F.concat(F.lit("part "), F.col("sequence").cast("string")).alias("head"), (F.col("sequence") * 40).alias("page_from"), (F.col("sequence") * 40 + 29).alias("page_to"))
    pages = c.select("book", F.explode(F.array("page_from", "page_to")).alias("page")).distinct().where("page % 2 = 0")
    labels = pages.select("book", "page", F.concat(F.lit("p"), F.col("page").cast("string")).alias("label"), (F.col("page") % 10 == 0).alias("estimated"))
    return s.chunk_rows(c, found, labels, books.select("book", F.lit(90).alias("first"), F.lit(150).alias("last")))


@query("stop_headings", f"WITH {tally.E} SELECT entity, x AS key FROM (SELECT entity, CASE WHEN entity % 3 = 0 THEN 'punches' WHEN entity % 7 = 0 THEN '' WHEN entity % 11 = 0 THEN 'winterdrinks' ELSE key END AS x FROM e) WHERE x NOT IN ('punches', 'winterdrinks', '')")
def stop_headings(spark, sf):
    k = F.col("entity")
    keyed = tally.entities(spark, sf).select("entity", F.when(k % 3 == 0, "punches").when(k % 7 == 0, "").when(k % 11 == 0, "winterdrinks").otherwise(F.col("key")).alias("key"))
    return s.without_stops(keyed)


@query("assigned_ids", f"WITH {tally.E}, k AS (SELECT key, min(entity) AS entity FROM e GROUP BY key) SELECT key, length(key) % 2 = 0 AS created, CASE WHEN length(key) % 2 = 1 THEN entity END AS known FROM k")
def assigned_ids(spark, sf):
    e = tally.entities(spark, sf)
    known = e.groupBy("key").agg(F.min("entity").alias("entity")).where(F.length("key") % 2 == 1)
    return s.assigned(e, known).select("key", "created", F.when(~F.col("created"), F.col("entity")).alias("known"))


@query("split_resolve", f"""WITH {tally.E}, k AS (SELECT key, CASE WHEN starts_with(key, 'red') THEN -1 ELSE min(entity) END AS first FROM e GROUP BY key)
SELECT key, coalesce((SELECT arg_min(o.key, (o.first, o.key)) FROM k o WHERE o.first < k.first AND length(o.key) >= 6 AND length(k.key) >= 6 AND levenshtein(o.key, k.key) <= 3 AND NOT (left(o.key, 4) = 'blue' AND left(k.key, 4) = 'blue')), key) AS resolved FROM k""")
def split_resolve(spark, sf):
    k = tally.entities(spark, sf).groupBy("key").agg(F.min("entity").alias("first"))
    pairs = structure.fuzzy_pairs(k, 3)
    blue = pairs.where(F.col("key").startswith("blue") & F.col("other").startswith("blue")).select("key", "other")
    return s.resolved(k, pairs, blue, k.where(F.col("key").startswith("red")).select("key"))
