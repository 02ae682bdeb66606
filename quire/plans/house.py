"""Passages rendered from part, customer and orders, sentences and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import house as h
from quire.plans.keep import Registry
from quire.sources.tables import read

query = Registry()

STRINGS = "array<string>"
RAW = """r AS (SELECT p_partkey AS id, p_name AS title, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS subtitle, CASE WHEN p_partkey % 3 <> 0 THEN p_type || '  ' END AS description, [p_size || 'oz ' || p_type, '', 'dash of ' || p_brand] AS build,
  CASE WHEN p_partkey % 5 = 0 THEN ['Rum: ' || p_brand || ', other.'] ELSE []::VARCHAR[] END AS bottles, CASE WHEN p_partkey % 2 = 0 THEN 'Shaken' END AS method, CASE p_partkey % 3 WHEN 0 THEN 'None' WHEN 1 THEN 'Coupe' END AS served_in,
  CASE p_partkey % 7 WHEN 0 THEN 'None' WHEN 1 THEN 'Hot' WHEN 2 THEN 'Crushed' WHEN 3 THEN 'Large Cube' WHEN 4 THEN 'Small Cubes' WHEN 5 THEN 'Cracked' END AS ice, p_partkey % 11 = 0 AS straw, CASE WHEN p_partkey % 6 = 0 THEN 2 END AS servings,
  CASE WHEN p_partkey % 4 = 1 THEN 'Ann' END AS bartender, CASE WHEN p_partkey % 8 = 0 THEN []::VARCHAR[] ELSE [p_brand, 'New'] END AS tags, CASE p_partkey % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['Summer'] ELSE ['Rum flight', 'Old collection', 'Rum flight'] END AS lists,
  CASE WHEN p_partkey % 9 = 0 THEN 'A note.' END AS notes, CASE WHEN p_partkey % 10 = 0 THEN ['Dry: gin', 'Variation: rum more'] ELSE []::VARCHAR[] END AS variations FROM part)"""


def drinks(spark, sf):
    k, brand, kind = F.col("p_partkey"), F.col("p_brand"), F.col("p_type")
    nothing, text = F.array().cast(STRINGS), lambda c: c.cast("string")
    ice = F.when(k % 7 == 0, "None").when(k % 7 == 1, "Hot").when(k % 7 == 2, "Crushed").when(k % 7 == 3, "Large Cube").when(k % 7 == 4, "Small Cubes").when(k % 7 == 5, "Cracked")
    of = {
        "title": F.col("p_name"), "subtitle": F.when(k % 4 != 0, brand), "description": F.when(k % 3 != 0, F.concat(kind, F.lit("  "))), "build": F.array(F.concat(text(F.col("p_size")), F.lit("oz "), kind), F.lit(""), F.concat(F.lit("dash of "), brand)),
        "bottles": F.when(k % 5 == 0, F.array(F.concat(F.lit("Rum: "), brand, F.lit(", other.")))).otherwise(nothing), "method": F.when(k % 2 == 0, "Shaken"), "served_in": F.when(k % 3 == 0, "None").when(k % 3 == 1, "Coupe"), "ice": ice, "straw": k % 11 == 0,
        "servings": F.when(k % 6 == 0, 2), "bartender": F.when(k % 4 == 1, "Ann"), "tags": F.when(k % 8 == 0, nothing).otherwise(F.array(brand, F.lit("New"))), "notes": F.when(k % 9 == 0, "A note."),
        "on": F.when(k % 3 == 0, nothing).when(k % 3 == 1, F.array(h.member_name(F.lit("Summer"), F.lit("menu")))).otherwise(F.array(h.member_name(F.lit("Rum"), F.lit("path")), h.member_name(F.lit("Old"), F.lit("collection")), F.lit("Rum flight"))),
        "variations": F.when(k % 10 == 0, F.array(h.variation(F.lit("Dry"), F.array(F.lit(" gin "), F.lit(""))), h.variation(F.lit(None).cast("string"), F.array(F.lit("rum"), F.lit("more"))))).otherwise(nothing),
    }
    return read(spark, sf, "part").select(k.alias("id"), *(c.alias(n) for n, c in of.items()))


SENTENCE = """CASE WHEN len(s) > 0 THEN array_to_string(s, ', ') || '.' ELSE '' END"""
SAID = """t AS (SELECT *, list_filter([method, CASE WHEN served_in <> 'None' THEN 'served in a ' || served_in END, CASE ice WHEN 'None' THEN 'with no ice' WHEN 'Hot' THEN 'served hot' WHEN 'Crushed' THEN 'over crushed ice' WHEN 'Large Cube' THEN 'over a large cube' WHEN 'Small Cubes' THEN 'over small cubes' ELSE 'over ' || lower(ice) || ' ice' END, CASE WHEN straw THEN 'with a straw' END], lambda x: x IS NOT NULL) AS s FROM r)"""


def text_sql(*lists):
    """Lines of several lists as a passage."""
    return rf"regexp_replace(regexp_replace(array_to_string(list_transform(list_filter(flatten([{', '.join(lists)}]), lambda x: x IS NOT NULL), lambda x: rtrim(x, ' ')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


DRINK = text_sql(
    "[title]", "[subtitle]", "CASE WHEN description IS NULL THEN []::VARCHAR[] ELSE ['', description] END", "list_concat([''], list_filter(build, lambda x: x <> ''))", "bottles", f"['', {SENTENCE}]", "['Serves ' || servings || '.']", "['Credited to ' || bartender || '.']",
    "[CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') || '.' END]", "[CASE len(lists) WHEN 1 THEN 'On the Summer.' WHEN 3 THEN 'On the Rum flight, Old collection.' END]", "CASE WHEN notes IS NULL THEN []::VARCHAR[] ELSE ['', notes] END", "CASE WHEN len(variations) > 0 THEN ['', variations[1], '', variations[2]] ELSE []::VARCHAR[] END",
)


def passages(spark, sf):
    d = drinks(spark, sf).withColumn("sentence", h.build_sentence(F.col("method"), F.col("served_in"), F.col("ice"), F.col("straw")))
    return d.select("id", h.drink_passage({c: F.col(c) for c in d.columns}).alias("text"))


@query("render_drinks", f"WITH {RAW}, {SAID} SELECT id, {DRINK} AS text FROM t")
def render_drinks(spark, sf):
    return h.within_ceiling(passages(spark, sf), "id")


@query("served_lines", f"WITH {RAW} SELECT id, array_to_string(list_filter([method, 'in a ' || served_in, CASE WHEN ice <> 'None' THEN ice || ' ice' END, CASE WHEN straw THEN 'with a straw' END, 'serves ' || servings], lambda x: x IS NOT NULL), ', ') AS served FROM r")
def served_lines(spark, sf):
    return drinks(spark, sf).select("id", h.served(*(F.col(c) for c in ("method", "served_in", "ice", "straw", "servings"))).alias("served"))


@query("render_recipes", f"WITH {RAW} SELECT id, {text_sql('[title]', '[description]', 'list_concat([$$$$], list_filter(build, lambda x: length(x) > 0))', 'CASE WHEN notes IS NULL THEN []::VARCHAR[] ELSE [$$$$, notes] END')} AS text FROM r")
def render_recipes(spark, sf):
    d = drinks(spark, sf)
    return d.select("id", h.recipe_passage(F.col("title"), F.col("description"), F.col("build"), F.lit(None).cast("string"), F.col("notes")).alias("text"))


CUSTOMERS = "c AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN 1800 + c_custkey % 90 END AS born, CASE WHEN c_custkey % 4 <> 0 THEN 1890 + c_custkey % 90 END AS died, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS description FROM customer)"
ORDERED = "o AS (SELECT o_custkey AS id, array_agg(o_orderkey::VARCHAR ORDER BY o_orderkey) AS titles FROM orders GROUP BY o_custkey)"
YEARS = "CASE WHEN died IS NOT NULL THEN coalesce(born::VARCHAR, '') || '–' || died WHEN born IS NOT NULL THEN 'b. ' || born END"


def titled(spark, sf):
    k = F.col("c_custkey")
    c = read(spark, sf, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.when(k % 3 != 0, 1800 + k % 90).alias("born"), F.when(k % 4 != 0, 1890 + k % 90).alias("died"), F.when(k % 5 != 0, F.col("c_mktsegment")).alias("description"))
    o = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")).alias("titles"))
    return c.join(o, "id", "left")


@query("render_people", f"WITH {CUSTOMERS}, {ORDERED} SELECT id, {text_sql('[name]', f'[{YEARS}]', 'CASE WHEN description IS NULL THEN []::VARCHAR[] ELSE [$$$$, description] END', 'CASE WHEN titles IS NULL THEN []::VARCHAR[] ELSE [$$$$, $$On the menus: $$ || array_to_string(titles, $$, $$) || $$.$$] END')} AS text FROM c LEFT JOIN o USING (id)")
def render_people(spark, sf):
    return titled(spark, sf).select("id", h.bartender_passage(F.col("name"), h.life_years(F.col("born"), F.col("died")), F.col("description"), F.col("titles")).alias("text"))


@query("render_lists", f"WITH n AS (SELECT n_regionkey AS id, array_agg(n_name ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey) SELECT id, {text_sql('[r_name]', '[$$Main: $$ || array_to_string(names, $$, $$) || $$.$$, names[1] || $$.$$]', 'CASE WHEN id % 2 = 0 THEN [$$Featured: $$ || names[2] || $$.$$] ELSE []::VARCHAR[] END')} AS text FROM n JOIN region ON r_regionkey = id".replace("[r_name]", "[r_name, $$$$]"))
def render_lists(spark, sf):
    n = read(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    r = read(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("title")).join(n, "id")
    null = F.lit(None).cast("string")
    sections = F.array(F.struct(F.lit("Main").alias("title"), F.col("names").alias("members")), F.struct(null.alias("title"), F.slice("names", 1, 1).alias("members")))
    return r.select("id", h.collection_passage(F.col("title"), null, null, sections, F.when(F.col("id") % 2 == 0, F.slice("names", 2, 1)).otherwise(F.array().cast(STRINGS))).alias("text"))


@query("ingredient_styles", "SELECT p_partkey, CASE WHEN p_brand <> CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END THEN p_brand END AS style FROM part")
def ingredient_styles(spark, sf):
    title = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_name"))
    return read(spark, sf, "part").select("p_partkey", h.style(F.col("p_brand"), title).alias("style"))


@query("passages_to_write", f"WITH {RAW}, {SAID}, x AS (SELECT id, {DRINK} AS text FROM t) SELECT id AS key FROM x WHERE id % 5 = 0 OR id % 7 = 0 OR id % 11 = 0")
def passages_to_write(spark, sf):
    now = passages(spark, sf).select(F.col("id").alias("key"), F.sha2("text", 256).alias("hash"))
    k = F.col("key")
    stored = now.select(F.when(k % 5 == 0, -k).otherwise(k).alias("key"), F.when(k % 7 == 0, "x").otherwise(F.col("hash")).alias("hash"), F.when(k % 11 == 0, 1).otherwise(2).alias("version"))
    return h.to_write(now, stored, 2).select("key")


@query("references_checked", "SELECT l_suppkey AS supplier, count(*)::BIGINT AS n FROM lineitem GROUP BY l_suppkey")
def references_checked(spark, sf):
    facts = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"))
    return h.checked_references(facts, "supplier", read(spark, sf, "supplier"), "s_suppkey").groupBy("supplier").agg(F.count(F.lit(1)).alias("n"))


COVER = "v AS (SELECT s_suppkey AS id, s_suppkey % 9 AS counted, s_suppkey % 9 + s_suppkey % 4 AS total, s_suppkey % 5 AS carrying, CASE WHEN s_suppkey % 2 = 0 THEN '1860 to ' || s_suppkey END AS win, s_suppkey % 3 = 0 AS ordered FROM supplier)"


@query("coverage_sentences", f"""WITH {COVER} SELECT id, CASE WHEN win IS NULL THEN CASE WHEN total = counted THEN 'Tallied across all ' || total || ' books on the shelf.' ELSE 'Tallied across ' || counted || ' of the ' || total || ' books on the shelf; the other ' || (total - counted) || ' print no drink headings to count.' END
  WHEN counted = 0 THEN 'Tallied over ' || win || ', a period this shelf holds no books from.' ELSE 'Tallied over ' || win || ' only: ' || counted || ' book' || CASE WHEN counted = 1 THEN '' ELSE 's' END || ' on the shelf printed anything in that period, and every count below is out of those, not out of the whole shelf.' END
  || CASE WHEN carrying > 0 AND carrying < counted THEN ' It is not spread evenly: nine parts in ten of the count come from ' || carrying || ' of them, the recipe books. The rest are narrative and name a drink only in passing.' ELSE '' END
  || CASE WHEN ordered THEN ' These years are when a drink was printed in a book on this shelf, which is not the same as when it was invented; say it that way.' ELSE '' END AS sentence FROM v""")
def coverage_sentences(spark, sf):
    k = F.col("s_suppkey")
    return read(spark, sf, "supplier").select(k.alias("id"), h.coverage_sentence(k % 9, k % 9 + k % 4, k % 5, F.when(k % 2 == 0, F.concat(F.lit("1860 to "), k.cast("string"))), k % 3 == 0).alias("sentence"))


@query("json_payloads", """SELECT n_nationkey, '{' || chr(10) || '  "name" : "' || n_name || ' é",' || chr(10) || '  "region" : ' || CASE WHEN n_regionkey % 2 = 0 THEN 'null' ELSE n_regionkey::VARCHAR END || ',' || chr(10) || '  "tags" : [ "a", "b" ]' || chr(10) || '}' AS payload FROM nation""")
def json_payloads(spark, sf):
    n = read(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit(" é")).alias("name"), F.when(F.col("n_regionkey") % 2 != 0, F.col("n_regionkey")).alias("region"), F.array(F.lit("a"), F.lit("b")).alias("tags"))
    return h.json_payload(n, "n_nationkey", ["name", "region", "tags"])


@query("source_table", "SELECT row_number() OVER (ORDER BY doc_id) AS rank, source AS title, lang AS pages, printf('%.4f', doc_id / 7.0) AS score, CASE WHEN length(f) > 80 THEN f[1:79] || '…' ELSE f END AS text FROM (SELECT *, regexp_replace(text, '\\s+', ' ', 'g') AS f FROM documents ORDER BY doc_id LIMIT 40)")
def source_table(spark, sf):
    from pyspark.sql import Window

    top = read(spark, sf, "documents").orderBy("doc_id").limit(40)  # a report of the first sources
    found = top.select(F.row_number().over(Window.orderBy("doc_id")).alias("rank"), F.col("source").alias("title"), F.col("lang").alias("pages"), (F.col("doc_id") / 7.0).alias("score"), "text")
    return h.source_table(found)


@query("throughput", "SELECT count(*)::BIGINT AS batches, sum(l_quantity) AS rows, sum(l_linenumber::DOUBLE) AS seconds, round(sum(l_quantity) / sum(l_linenumber), 2) AS per_second FROM lineitem")
def throughput(spark, sf):
    return h.throughput(read(spark, sf, "lineitem").select(F.col("l_quantity").alias("rows"), F.col("l_linenumber").cast("double").alias("seconds")))


@query("bottles_by_style", """WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS style, l_linestatus || (l_suppkey % 3) AS title FROM lineitem),
t AS (SELECT l_orderkey, style, title, min(l_linenumber) AS pos FROM l WHERE style IS NOT NULL GROUP BY ALL), s AS (SELECT l_orderkey, style, min(pos) AS first, style || ': ' || string_agg(title, ', ' ORDER BY pos, title) || '.' AS line FROM t GROUP BY l_orderkey, style),
a AS (SELECT l_orderkey, string_agg(line, ' ' ORDER BY first, style) AS bottles FROM s GROUP BY l_orderkey) SELECT l_orderkey, coalesce(bottles, '') AS bottles FROM (SELECT DISTINCT l_orderkey FROM l) LEFT JOIN a USING (l_orderkey)""")
def bottles_by_style(spark, sf):
    style, title = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), F.concat("l_linestatus", (F.col("l_suppkey") % 3).cast("string"))
    line = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", style.alias("style"), title.alias("title")))).alias("lines"))
    return line.select("l_orderkey", F.array_join(h.bottles_by_style(F.col("lines")), " ").alias("bottles"))


@query("drink_summaries", f"WITH {RAW} SELECT id, title AS name, description, array_to_string(build, '|') AS build, array_to_string(bottles, '|') AS bottles, array_to_string(list_filter([method, 'in a ' || served_in, CASE WHEN ice <> 'None' THEN ice || ' ice' END, CASE WHEN straw THEN 'with a straw' END, 'serves ' || servings], lambda x: x IS NOT NULL), ', ') AS served, array_to_string(tags, '|') AS tags, array_to_string(lists[:2], '|') AS \"on\", notes, 'https://x.example/d/' || id AS url FROM r")
def drink_summaries(spark, sf):
    from quire.operators.catalog import absolute

    d = drinks(spark, sf)
    of = {c: F.col(c) for c in d.columns} | {"url": absolute(F.concat(F.lit("/d/"), F.col("id").cast("string")), "https://x.example/")}
    d = d.select("id", h.summary(of).alias("s")).select("id", "s.*")
    return d.select("id", "name", "description", "served", "notes", "url", *(F.array_join(c, "|").alias(c) for c in ("build", "bottles", "tags", "on")))


@query("house_passages", f"WITH {RAW} SELECT id, title || CASE WHEN subtitle IS NULL THEN '' ELSE ' — ' || subtitle END || chr(10) || chr(10) || 'x' AS passage FROM r")
def house_passages(spark, sf):
    return drinks(spark, sf).select("id", h.house_passage(F.col("title"), F.col("subtitle"), F.lit("x")).alias("passage"))
