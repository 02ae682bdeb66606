"""Facet queries over part (items), lineitem (uses), supplier and nation (ingredients) and orders (lists), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import facets
from quire.plans.keep import Registry
from quire.sources.tables import read

query = Registry()


def items(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("title"))


def tags(spark, sf):
    p = read(spark, sf, "part")
    size = F.when(F.col("p_size") < 15, "Small").when(F.col("p_size") < 35, "Medium").otherwise("Large")
    pairs = F.array(*(F.struct(F.lit(c).alias("category"), v.alias("label")) for c, v in (("Type", F.col("p_type")), ("Brand", F.col("p_brand")), ("Size", size))))
    return p.select(F.col("p_partkey").alias("item"), F.inline(pairs))


def ingredients(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("family"))
    return read(spark, sf, "supplier").join(F.broadcast(n), "s_nationkey").select(F.col("s_suppkey").alias("ingredient"), F.col("s_name").alias("title"), "family")  # 25 nations


def uses(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("ingredient")).distinct()


def lists(spark, sf):
    line, orders = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("The "), "o_orderpriority", F.lit(" Menu")).alias("list"), F.col("l_partkey").alias("item"))


BASE = """items AS (SELECT p_partkey AS item, p_name AS title FROM part),
tags AS (SELECT p_partkey AS item, 'Type' AS category, p_type AS label FROM part UNION ALL SELECT p_partkey, 'Brand', p_brand FROM part UNION ALL SELECT p_partkey, 'Size', CASE WHEN p_size < 15 THEN 'Small' WHEN p_size < 35 THEN 'Medium' ELSE 'Large' END FROM part),
ing AS (SELECT s_suppkey AS ingredient, s_name AS title, n_name AS family FROM supplier JOIN nation ON n_nationkey = s_nationkey),
uses AS (SELECT DISTINCT l_partkey AS item, l_suppkey AS ingredient FROM lineitem),
lists AS (SELECT 'The ' || o_orderpriority || ' Menu' AS list, l_partkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SMALL_OR_MEDIUM = "EXISTS (SELECT 1 FROM tags t WHERE t.item = i.item AND lower(category) = 'size' AND lower(label) IN ('small', 'medium'))"
BRAND = "EXISTS (SELECT 1 FROM tags t WHERE t.item = i.item AND lower(category) = 'brand' AND lower(label) IN ('brand#1', 'brand#11', 'brand#12', 'brand#2'))"


def _and_of_ors(spark, sf):
    return facets.with_tags(items(spark, sf), tags(spark, sf), {"SIZE": ["small", "MEDIUM"], "brand": ["Brand#1", "Brand#11", "Brand#12", "Brand#2"]})


query("facet_and_of_ors", f"WITH {BASE} SELECT * FROM items i WHERE {SMALL_OR_MEDIUM} AND {BRAND}")(_and_of_ors)
query("matching_count", f"WITH {BASE} SELECT count(*)::BIGINT AS matching FROM items i WHERE {SMALL_OR_MEDIUM} AND {BRAND}")(lambda spark, sf: _and_of_ors(spark, sf).agg(F.count(F.lit(1)).alias("matching")))


@query("facet_without", f"WITH {BASE} SELECT * FROM items i WHERE {SMALL_OR_MEDIUM} AND NOT {BRAND}")
def facet_without(spark, sf):
    return facets.with_tags(items(spark, sf), tags(spark, sf), {"size": ["small", "medium"]}, {"brand": ["brand#1", "brand#11", "brand#12", "brand#2"]})


NEEDLES = ["canada", "supplier 1", "NATION 3", "nothing at all", "3"]


def needle_sql(values):
    return ", ".join(f"('{n}')" for n in values)


RES = f"""needles(needle) AS (VALUES {needle_sql(NEEDLES)}),
words AS (SELECT needle, list_filter(regexp_split_to_array(lower(needle), '[^a-z0-9]+'), lambda w: w <> '') AS nw FROM needles),
pairs AS (SELECT w.needle, ingredient, lower(trim(w.needle)) IN (lower(trim(title)), lower(trim(family))) AS exact, nw, list_filter(regexp_split_to_array(lower(title || ' ' || family), '[^a-z0-9]+'), lambda x: x <> '') AS iw FROM words w, ing),
hits AS (SELECT needle, ingredient, exact FROM pairs WHERE exact OR len(nw) > 0 AND list_has_all(iw, nw)),
resolved AS (SELECT * FROM hits h WHERE exact = (SELECT bool_or(exact) FROM hits g WHERE g.needle = h.needle))"""


@query("ingredient_resolution", f"WITH {BASE}, {RES} SELECT * FROM resolved")
def ingredient_resolution(spark, sf):
    return facets.resolve(ingredients(spark, sf), NEEDLES)


@query("facet_interpretation", f"WITH {BASE}, {RES} SELECT needle, string_agg(DISTINCT title, ', ' ORDER BY title) AS titles FROM resolved JOIN ing USING (ingredient) WHERE NOT exact GROUP BY needle")
def facet_interpretation(spark, sf):
    i = ingredients(spark, sf)
    return facets.interpretation(facets.resolve(i, NEEDLES), i)


USE = "EXISTS (SELECT 1 FROM uses u JOIN resolved r USING (ingredient) WHERE u.item = i.item AND needle = '{}')"


@query("facet_ingredient", f"WITH {BASE}, {RES} SELECT * FROM items i WHERE {USE.format('3')} AND NOT {USE.format('supplier 1')}")
def facet_ingredient(spark, sf):
    r = facets.resolve(ingredients(spark, sf), NEEDLES)
    return facets.using(facets.using(items(spark, sf), uses(spark, sf), r, ["3"]), uses(spark, sf), r, ["supplier 1"], "left_anti")


@query("facet_ingredient_unknown", f"WITH {BASE}, {RES} SELECT 'required' AS side, (SELECT count(*) FROM items i WHERE {USE.format('nothing at all')})::BIGINT AS n UNION ALL SELECT 'excluded', (SELECT count(*) FROM items i WHERE NOT {USE.format('nothing at all')})::BIGINT")
def facet_ingredient_unknown(spark, sf):
    r, i, u = facets.resolve(ingredients(spark, sf), NEEDLES), items(spark, sf), uses(spark, sf)
    n = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"))
    return n(facets.using(i, u, r, ["nothing at all"]), "required").union(n(facets.using(i, u, r, ["nothing at all"], "left_anti"), "excluded"))


@query("facet_menu", f"WITH {BASE} SELECT * FROM items i WHERE EXISTS (SELECT 1 FROM lists l WHERE l.item = i.item AND (lower(list) = '1-urgent' OR regexp_replace(regexp_replace(lower(trim(list)), '^the\\s+', ''), '\\s+(menu|flight|collection)$', '') = '1-urgent'))")
def facet_menu(spark, sf):
    return facets.on_list(items(spark, sf), lists(spark, sf), "The 1-URGENT Flight")


@query("browse_ranked", f"WITH {BASE} SELECT i.item, i.title, coalesce(n, 0)::BIGINT AS lists FROM items i LEFT JOIN (SELECT item, count(*) AS n FROM lists GROUP BY item) USING (item) WHERE {BRAND} ORDER BY lists DESC, title, item LIMIT 8")
def browse_ranked(spark, sf):
    some = facets.with_tags(items(spark, sf), tags(spark, sf), {"brand": ["brand#1", "brand#11", "brand#12", "brand#2"]})
    return facets.browse(some, lists(spark, sf), 8)


@query("facet_dictionary", f"WITH {BASE} SELECT category, string_agg(DISTINCT label, '|' ORDER BY label) AS labels FROM tags GROUP BY category")
def facet_dictionary(spark, sf):
    return facets.dictionary(tags(spark, sf))


@query("unrecognised", f"WITH {BASE}, asked(place, category, label) AS (VALUES (0, 'size', 'tiny'), (1, 'size', 'small'), (2, 'colour', 'red')) SELECT * FROM asked a WHERE NOT EXISTS (SELECT 1 FROM tags t WHERE lower(t.category) = a.category AND lower(t.label) = a.label)")
def unrecognised(spark, sf):
    return facets.unrecognised(spark, tags(spark, sf), [("Size", "Tiny"), ("size", "Small"), ("Colour", "red"), ("size", "TINY")])


@query("item_summaries", f"""WITH {BASE},
a AS (SELECT item, string_agg(DISTINCT title, '; ' ORDER BY title) AS ingredients, string_agg(DISTINCT family, '; ' ORDER BY family) AS families FROM uses JOIN ing USING (ingredient) GROUP BY item),
b AS (SELECT item, string_agg(DISTINCT label, '; ' ORDER BY label) AS tags FROM tags GROUP BY item), c AS (SELECT item, string_agg(DISTINCT list, '; ' ORDER BY list) AS lists FROM lists GROUP BY item)
SELECT item, title, coalesce(ingredients, '') AS ingredients, coalesce(families, '') AS families, coalesce(tags, '') AS tags, coalesce(lists, '') AS lists FROM items LEFT JOIN a USING (item) LEFT JOIN b USING (item) LEFT JOIN c USING (item)""")
def item_summaries(spark, sf):
    return facets.summaries(items(spark, sf), tags(spark, sf), uses(spark, sf), ingredients(spark, sf), lists(spark, sf))


CATEGORIES = (("base_spirits", "type"), ("styles", "size"), ("origins", "brand"))
QUESTION = facets.Question(styles=("small", " MEDIUM "), without_base_spirits=("ECONOMY",), with_ingredients=("3",), without_ingredients=("supplier 1",), menu="the 1-urgent", limit=30, categories=CATEGORIES)
NO_TYPE = "NOT EXISTS (SELECT 1 FROM tags t WHERE t.item = i.item AND lower(category) = 'type' AND lower(label) = 'economy')"
URGENT = r"EXISTS (SELECT 1 FROM lists l WHERE l.item = i.item AND regexp_replace(regexp_replace(lower(trim(list)), '^the\s+', ''), '\s+(menu|flight|collection)$', '') = '1-urgent')"


@query("question_browse", f"WITH {BASE}, {RES} SELECT i.item, i.title, coalesce(n, 0)::BIGINT AS lists FROM items i LEFT JOIN (SELECT item, count(*) AS n FROM lists GROUP BY item) USING (item) WHERE {SMALL_OR_MEDIUM} AND {NO_TYPE} AND {USE.format('3')} AND NOT {USE.format('supplier 1')} AND {URGENT} ORDER BY lists DESC, title, item LIMIT 30")
def question_browse(spark, sf):
    return facets.asked(items(spark, sf), tags(spark, sf), uses(spark, sf), ingredients(spark, sf), lists(spark, sf), QUESTION)


@query("question_unfiltered", "SELECT * FROM (VALUES ('empty', true, 0, 0), ('blank labels', true, 0, 0), ('some', false, 1, 1)) v(question, unfiltered, required, excluded)")
def question_unfiltered(spark, sf):
    some = {"empty": facets.Question(), "blank labels": facets.Question(flavors=(" ",), technique=""), "some": QUESTION}
    return spark.createDataFrame([(n, q.is_unfiltered(), len(q.required()), len(q.excluded())) for n, q in some.items()], "question string, unfiltered boolean, required int, excluded int")


@query("question_not_understood", "SELECT * FROM (VALUES ('tiny', 1), ('Ether', 3), ('no such thing', 5), ('The Moon Menu', 6)) v(value, place)")
def question_not_understood(spark, sf):
    q = facets.Question(styles=("Small", "tiny", "tiny"), without_base_spirits=("Ether",), with_ingredients=("nation 3", "no such thing"), menu="The Moon Menu", categories=CATEGORIES)
    return facets.not_understood(tags(spark, sf), ingredients(spark, sf), lists(spark, sf), q)


@query("folded_needles", f"WITH {BASE} SELECT 'Café Cañada' AS needle, ingredient, false AS exact FROM ing WHERE ingredient % 9 = 4")
def folded_needles(spark, sf):
    """Words are compared without their marks."""
    i = ingredients(spark, sf).withColumn("family", F.when(F.col("ingredient") % 9 == 4, "Canada, le câfé").otherwise(F.col("family")))
    return facets.resolve(i, ["Café Cañada"])


@query("slug_needles", f"WITH {BASE} SELECT 'S-7' AS needle, ingredient, true AS exact FROM ing WHERE ingredient = 7")
def slug_needles(spark, sf):
    return facets.resolve(ingredients(spark, sf).withColumn("slug", F.concat(F.lit("s-"), F.col("ingredient").cast("string"))), ["S-7"])
