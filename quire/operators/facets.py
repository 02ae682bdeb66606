"""Faceted questions over a catalog: AND across facets, OR inside one, exclusions, and what a question meant.

items: item, title. tags: item, category, label. ingredients: ingredient, title, family. uses: item, ingredient.
lists: list, item (one row for each time an item stands on a list).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.ascii import ascii_folded

WORDS = "[^a-z0-9]+"


@dataclass(frozen=True)
class Question:
    """What a guest may ask of the catalog; labels of one category are alternatives, categories add up."""

    base_spirits: tuple[str, ...] = ()
    without_base_spirits: tuple[str, ...] = ()
    flavors: tuple[str, ...] = ()
    styles: tuple[str, ...] = ()
    origins: tuple[str, ...] = ()
    with_ingredients: tuple[str, ...] = ()
    without_ingredients: tuple[str, ...] = ()
    alcohol_level: str | None = None
    technique: str | None = None
    temperature: str | None = None
    prep_time: str | None = None
    menu: str | None = None
    limit: int = 8
    #: The catalog's categories for the fields, in the order in which they are asked.
    categories: tuple[tuple[str, str], ...] = (
        ("base_spirits", "base alcohol"), ("flavors", "flavor"), ("styles", "style"), ("origins", "origin"), ("alcohol_level", "alcohol level"), ("technique", "technique"), ("temperature", "temperature"), ("prep_time", "prep time"),
    )

    def _labels(self, name: str) -> list[str]:
        value = getattr(self, name)
        values = [value] if isinstance(value, str) else list(value or ())
        return [v.strip() for v in values if v.strip()]

    def required(self) -> dict[str, list[str]]:
        return {category: labels for name, category in self.categories if (labels := self._labels(name))}

    def excluded(self) -> dict[str, list[str]]:
        labels = self._labels("without_base_spirits")
        return {dict(self.categories)["base_spirits"]: labels} if labels else {}

    def is_unfiltered(self) -> bool:
        return not (self.required() or self.excluded() or self.with_ingredients or self.without_ingredients or self.menu is not None)


def asked(items: DataFrame, tags: DataFrame, uses: DataFrame, ingredients: DataFrame, lists: DataFrame, question: Question) -> DataFrame:
    """The items that a question leaves, the most listed first, at most its limit."""
    left = with_tags(items, tags, question.required(), question.excluded())
    needles = [*question.with_ingredients, *question.without_ingredients]
    if needles:
        known = resolve(ingredients, list(dict.fromkeys(needles)))
        left = using(using(left, uses, known, list(question.with_ingredients)), uses, known, list(question.without_ingredients), "left_anti")
    if question.menu is not None:
        left = on_list(left, lists, question.menu)
    return browse(left, lists, question.limit)


def not_understood(tags: DataFrame, ingredients: DataFrame, lists: DataFrame, question: Question) -> DataFrame:
    """place, value: labels, ingredients and the menu of a question that the catalog doesn't know, in the order asked, each once."""
    spark = tags.sparkSession
    values = [("label", c, v) for group in (question.required(), question.excluded()) for c, vs in group.items() for v in vs]
    values += [("ingredient", "", v) for v in (*question.with_ingredients, *question.without_ingredients)] + [("menu", "", v) for v in (question.menu,) if v is not None]
    rows = spark.createDataFrame([(i, kind, c, v) for i, (kind, c, v) in enumerate(values)], "place int, kind string, category string, value string")
    labels = tags.select(F.lit("label").alias("kind"), fold(F.col("category")).alias("category"), fold(F.col("label")).alias("_value")).distinct()
    rows = rows.withColumns({"category": fold(F.col("category")), "_value": fold(F.col("value"))})
    unknown = rows.where("kind = 'label'").join(labels, ["kind", "category", "_value"], "left_anti")
    needles = sorted({v for kind, _, v in values if kind == "ingredient"})
    if needles:
        unknown = unknown.unionByName(rows.where("kind = 'ingredient'").join(resolve(ingredients, needles).select(F.col("needle").alias("value")), "value", "left_anti"))
    if question.menu is not None:
        names = lists.select(list_names(F.col("list")).alias("_name")).distinct()
        unknown = unknown.unionByName(rows.where("kind = 'menu'").withColumn("_name", list_names(F.col("value"))).join(names, "_name", "left_anti").drop("_name"))
    return unknown.groupBy("value").agg(F.min("place").alias("place")).select("place", "value")


def fold(c: Column) -> Column:
    return F.lower(F.trim(c))


def words(c: Column) -> Column:
    """The distinct ASCII words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(ascii_folded(c)), WORDS), lambda w: w != ""))


def with_tags(items: DataFrame, tags: DataFrame, required: dict[str, list[str]] | None = None, excluded: dict[str, list[str]] | None = None) -> DataFrame:
    """Items with one of the labels of each required category and none of the excluded labels; case does not matter."""
    for how, wanted in (("left_semi", required or {}), ("left_anti", excluded or {})):
        for category, labels in wanted.items():
            hits = tags.where((fold(F.col("category")) == category.lower()) & fold(F.col("label")).isin([x.lower() for x in labels])).select("item")
            items = items.join(hits, "item", how)
    return items


def resolve(ingredients: DataFrame, needles: list[str]) -> DataFrame:
    """needle, ingredient, exact: equal to a slug (where there is one), title or family, or, where none is, all of its words among theirs; never a part of a word."""
    spark = ingredients.sparkSession
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    slug = fold(F.col("slug")) if "slug" in ingredients.columns else F.lit(None).cast("string")
    known = ingredients.select("ingredient", F.array_compact(F.array(slug, fold(F.col("title")), fold(F.col("family")))).alias("_names"), words(F.concat_ws(" ", "title", "family")).alias("_words"))
    exact = F.array_contains("_names", fold(F.col("needle")))
    # The needles are the question's own few words.
    pairs = known.join(F.broadcast(asked), exact | ((F.size(words(F.col("needle"))) > 0) & (F.size(F.array_except(words(F.col("needle")), "_words")) == 0))).withColumn("exact", exact)
    best = pairs.groupBy("needle").agg(F.max("exact").alias("_any"))
    return pairs.join(F.broadcast(best), "needle").where(F.col("exact") == F.col("_any")).select("needle", "ingredient", "exact")


def using(items: DataFrame, uses: DataFrame, resolved: DataFrame, needles: list[str], how: str = "left_semi") -> DataFrame:
    """Items that use (or don't use) each needle. A needle that means nothing leaves no required item and removes no excluded one."""
    for n in needles:
        items = items.join(uses.join(resolved.where(F.col("needle") == n), "ingredient", "left_semi").select("item"), "item", how)
    return items


def interpretation(resolved: DataFrame, ingredients: DataFrame) -> DataFrame:
    """What the needles that are no exact name were taken for."""
    loose = resolved.where(~F.col("exact")).join(ingredients.select("ingredient", "title"), "ingredient")
    return loose.groupBy("needle").agg(F.array_join(F.sort_array(F.collect_set("title")), ", ").alias("titles"))


def list_names(c: Column) -> Column:
    """A list's name without 'the' before it and 'menu', 'flight' or 'collection' after it."""
    return F.regexp_replace(F.regexp_replace(fold(c), r"^the\s+", ""), r"\s+(menu|flight|collection)$", "")


def on_list(items: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    wanted = lists.where((fold(F.col("list")) == name.strip().lower()) | (list_names(F.col("list")) == list_names(F.lit(name))))
    return items.join(wanted.select("item"), "item", "left_semi")


def browse(items: DataFrame, lists: DataFrame, limit: int) -> DataFrame:
    """Items on most lists first (each time on a list counts), then by title and id."""
    counts = lists.groupBy("item").agg(F.count(F.lit(1)).alias("lists"))
    ranked = items.join(counts, "item", "left").withColumn("lists", F.coalesce("lists", F.lit(0)))
    return ranked.orderBy(F.col("lists").desc(), F.col("title").asc_nulls_last(), "item").limit(max(1, limit))


def dictionary(tags: DataFrame) -> DataFrame:
    """Each category's labels in order."""
    return tags.groupBy("category").agg(F.array_join(F.sort_array(F.collect_set("label")), "|").alias("labels"))


def unrecognised(spark: SparkSession, tags: DataFrame, asked: list[tuple[str, str]]) -> DataFrame:
    """Asked (category, label) pairs that the catalog doesn't know, in the order asked, each once."""
    seen = list(dict.fromkeys((c.lower(), v.lower()) for c, v in asked))
    rows = spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(seen)], "place int, category string, label string")
    known = tags.select(fold(F.col("category")).alias("category"), fold(F.col("label")).alias("label")).distinct()
    return rows.join(known, ["category", "label"], "left_anti")


def summaries(items: DataFrame, tags: DataFrame, uses: DataFrame, ingredients: DataFrame, lists: DataFrame) -> DataFrame:
    """One row an item: its ingredients, its families, its tags and its lists, each distinct and in order."""
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "; ")
    parts = uses.join(ingredients, "ingredient").groupBy("item").agg(joined("title").alias("ingredients"), joined("family").alias("families"))
    labels = tags.groupBy("item").agg(joined("label").alias("tags"))
    places = lists.groupBy("item").agg(joined("list").alias("lists"))
    out = items.join(parts, "item", "left").join(labels, "item", "left").join(places, "item", "left")
    return out.select("item", "title", *(F.coalesce(c, F.lit("")).alias(c) for c in ("ingredients", "families", "tags", "lists")))
