"""Entity tally: aggregates, surveys inside a window, coverage with its denominator.

A mention has: entity, book, year (may be null), spelling, family, and the order columns m1, m2 that make it unique.
An entity has: entity, name, and after `aggregate` its counts. Orders are total and spell out where nulls go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import params
from quire.functions.ascii import ascii_folded

FIRST = ["m1", "m2"]
# What is trimmed off a heading.
EDGES = r"[\s.,:;|*–—-]"


def folded_key(name: Column) -> Column:
    """Lower-case ASCII key: edge punctuation off, letters without their marks, one leading article off, possessives joined, letters and digits only."""
    text = F.lower(ascii_folded(F.regexp_replace(name, f"^{EDGES}+|{EDGES}+$", "")))
    text = F.regexp_replace(text, "^(" + "|".join(params.ARTICLES) + r")\s+", "")
    return F.regexp_replace(F.regexp_replace(text, r"['’]s\b", "s"), "[^a-z0-9]+", "")


def in_window(mentions: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """Bounds count inside: a mention without a year is in no window, and in the whole corpus."""
    if first is not None:
        mentions = mentions.where(F.col("year") >= first)
    if last is not None:
        mentions = mentions.where(F.col("year") <= last)
    return mentions


def aggregate(mentions: DataFrame) -> DataFrame:
    """Counts of each entity, recomputed from its mentions; year 0 counts as unknown."""
    year = F.when(F.col("year") != 0, F.col("year"))
    return mentions.groupBy("entity").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.count_distinct("book").alias("books"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.min_by("book", F.when(year.isNotNull(), F.struct(year, *FIRST))).alias("first_book"),
    )


def ranking(order: str, key: str = "entity") -> list[Column]:
    """Rising orders put nulls last, falling ones first; ties go to the smaller id."""
    books, mentions, entity = F.col("books").desc_nulls_first(), F.col("mentions").desc_nulls_first(), F.col(key).asc_nulls_last()
    return {
        "books": [books, mentions, entity],
        "mentions": [mentions, books, entity],
        "earliest": [F.col("first_year").asc_nulls_last(), books, entity],
        "latest": [F.col("last_year").desc_nulls_first(), books, entity],
    }[order]


def survey(mentions: DataFrame, entities: DataFrame, order: str = "books", limit: int = params.SURVEY_LIMIT, min_books: int = 1, first: int | None = None, last: int | None = None, name: str | None = None) -> DataFrame:
    """The ranked entities of a window: counted inside it, not chosen by it."""
    if name is not None:
        entities = entities.where(F.col("key") == folded_key(F.lit(name)))
    counted = aggregate(in_window(mentions, first, last)).where(F.col("books") >= min_books).join(entities.select("entity", "name"), "entity")
    return counted.orderBy(*ranking(order)).limit(max(1, min(limit, params.SURVEY_MOST)))


def citations(mentions: DataFrame, most: int = params.CITATIONS) -> DataFrame:
    """Each entity's first mention in each book, the earliest books first, at most `most`."""
    per_book = Window.partitionBy("entity", "book").orderBy(F.col("year").asc_nulls_last(), *FIRST)
    per_entity = Window.partitionBy("entity").orderBy(F.col("year").asc_nulls_last(), *FIRST)
    first = mentions.withColumn("_n", F.row_number().over(per_book)).where("_n = 1")
    return first.withColumn("rank", F.row_number().over(per_entity)).where(F.col("rank") <= most).drop("_n")


def spellings(mentions: DataFrame) -> DataFrame:
    """Each entity's spellings by falling count; ties go to the one mentioned first, then to the smaller spelling."""
    counts = mentions.groupBy("entity", "spelling").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*FIRST)).alias("_first"))
    order = Window.partitionBy("entity").orderBy(F.col("n").desc(), "_first", "spelling")
    return counts.withColumn("rank", F.row_number().over(order)).drop("_first")


def aliases(mentions: DataFrame) -> DataFrame:
    """The most frequent spelling of each entity, and the others in order."""
    ranked = spellings(mentions).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("rank", "spelling", "n"))).alias("_all"))
    return ranked.select("entity", F.col("_all")[0]["spelling"].alias("canonical"), F.transform(F.slice("_all", F.lit(2), F.size("_all")), lambda a: a["spelling"]).alias("others"))


def coverage(mentions: DataFrame, books: DataFrame, countable: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """What a survey's numbers rest on: all mentions of the window, counted or not; countable entities corpus-wide."""
    inside = in_window(mentions, first, last).agg(F.count(F.lit(1)).alias("rows_tallied"), F.count_distinct("book").alias("books_counted"))
    total = books.agg(F.count(F.lit(1)).alias("books_total"))
    known = countable.agg(F.count(F.lit(1)).alias("countable"))
    return inside.join(F.broadcast(total)).join(F.broadcast(known))  # one row each


def carrying_set(mentions: DataFrame, share: float = params.CARRYING_SHARE) -> DataFrame:
    """How few books hold a share of all mentions; one row, with the total."""
    counts = mentions.groupBy("book").agg(F.count(F.lit(1)).alias("n"))  # one row for each book
    order = Window.orderBy(F.col("n").desc(), F.col("book").asc_nulls_last())
    run = counts.select(F.row_number().over(order).alias("k"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return run.agg(F.coalesce(F.min(F.when(F.col("sum") >= share * F.col("total"), F.col("k"))), F.lit(0)).cast("long").alias("carrying"), F.coalesce(F.max("total"), F.lit(0)).alias("total"))


def tail_histogram(aggregates: DataFrame) -> DataFrame:
    books = F.col("books")
    return aggregates.agg(
        F.count_if(books == 1).alias("one"), F.count_if(books.between(2, 4)).alias("two_to_four"), F.count_if(books.between(5, 9)).alias("five_to_nine"), F.count_if(books >= 10).alias("ten_and_more")
    )


def suffix_pairs(entities: DataFrame, suffix: str) -> DataFrame:
    """Pairs of keys of which one is the other with a suffix."""
    keys = entities.select("key").distinct()
    return keys.select(F.col("key").alias("bare")).join(keys.select(F.col("key").alias("suffixed")), F.col("suffixed") == F.concat("bare", F.lit(suffix)))


def silent_books(books: DataFrame, mentions: DataFrame) -> DataFrame:
    return books.join(mentions.select("book").distinct(), "book", "left_anti")


def evidence(mentions: DataFrame) -> DataFrame:
    """What a verdict on an entity rests on."""
    return mentions.groupBy("entity").agg(
        F.count(F.lit(1)).alias("mentions"),
        F.count_distinct("book").alias("books"),
        F.round(F.avg(F.when(F.col("kind") == "recipe", 1.0).otherwise(0.0)), 3).alias("recipe_share"),
        F.round(F.avg(F.when(F.col("family") == "caps", 1.0).otherwise(0.0)), 3).alias("caps_share"),
        F.count_distinct("family").alias("families"),
        F.bool_or(F.coalesce(F.col("numbered"), F.lit(False))).alias("numbered"),
    )


def countability(evidenced: DataFrame, divisions: list[str], noise: list[str]) -> DataFrame:
    """The first reason that applies decides; name and key come with the evidence."""
    name = F.col("name")
    words = F.size(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""))
    letters = F.length(F.regexp_replace(name, r"[^\p{L}]", "")) / F.greatest(F.length(F.regexp_replace(name, r"\s", "")), F.lit(1))
    reason = (
        F.when(F.col("key").isin(divisions), "division")
        .when(F.col("key").isin(noise), "noise")
        .when(F.col("books") < params.MIN_BOOKS, "one book")
        .when(F.col("numbered"), "numbered")
        .when(words > params.MAX_NAME_WORDS, "sentence")
        .when(F.lower(name).rlike(r"^[0-9½¼¾]|\b(oz|ounces?|dash(es)?|spoons?|glass(es)?)\b"), "ingredient")
        .when(letters < params.MIN_LETTER_RATIO, "letters")
        .otherwise("named")
    )
    return evidenced.withColumn("reason", reason).withColumn("countable", reason.isin("numbered", "named"))


def sentence_openers(evidenced: DataFrame) -> DataFrame:
    """Proposals for the noise list: one word, always in capitals, never numbered."""
    return evidenced.where((F.size(F.split(F.trim("name"), r"\s+")) == 1) & (F.col("caps_share") == 1) & ~F.col("numbered"))


def density(mentions: DataFrame, pages: DataFrame) -> DataFrame:
    """Mentions for each page of a book; 0 where there are no pages."""
    n = mentions.groupBy("book").agg(F.count(F.lit(1)).alias("mentions"))
    out = pages.join(n, "book", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))
    return out.withColumn("density", F.round(F.coalesce(F.try_divide("mentions", "pages"), F.lit(0.0)), 4))


def drift(stored: DataFrame, mentions: DataFrame) -> DataFrame:
    """Stored aggregates against recomputed ones: counts of what is missing, extra or different."""
    now = aggregate(mentions).select("entity", F.struct("mentions", "books", "first_year", "last_year").alias("now"))
    then = stored.select("entity", F.struct("mentions", "books", "first_year", "last_year").alias("then"))
    both = now.join(then, "entity", "full")
    return both.agg(F.count_if(F.col("then").isNull()).alias("missing"), F.count_if(F.col("now").isNull()).alias("extra"), F.count_if(F.col("now").isNotNull() & F.col("then").isNotNull() & ~F.col("now").eqNullSafe(F.col("then"))).alias("different"))


def year_range(first: Column, last: Column) -> Column:
    """'' if both are unknown, one year if equal or alone, else both."""
    one = F.coalesce(first, last).cast("string")
    return F.when(first.isNull() & last.isNull(), "").when(first.isNull() | last.isNull() | (first == last), one).otherwise(F.concat_ws("–", first.cast("string"), last.cast("string")))
