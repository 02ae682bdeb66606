"""Sections of a book from its running heads, and reports on chunks and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import params
from quire.operators import text

# How often, how far and how densely a head has to stand to be a chapter's, and a title's share and likeness.
CHAPTER_TIMES, CHAPTER_SPAN, CHAPTER_DENSITY, TITLE_SHARE, TITLE_LIKENESS = 3, 3, 0.25, 0.35, 0.8


def likeness(a: Column, b: Column) -> Column:
    """1 for equal strings, less by the share of edits."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


#: A running head that ends with the alphabetical range of its page, "COCKTAILS BL-BO": the group is what stands before it.
GUIDE_WORDS = "^(.*?\\p{L}.*?)\\s+\\p{Lu}{1,3}\\s*[-–—]\\s*\\p{Lu}{1,3}\\.?$"


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^\\p{L}]", ""))


def guide_stem(head: Column) -> Column:
    """What a guide-word head names, if it is one and names something."""
    stem = F.trim(F.regexp_extract(F.trim(head), GUIDE_WORDS, 1))
    return F.when(letters(stem) >= params.HEAD_LETTERS, stem)


def heads_at(pages: DataFrame, edge: str, not_a_head: str) -> DataFrame:
    """book, page, head: the first ('top') or last populated line of pages(book, page, text) that reads like a head; lines that match `not_a_head` don't."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    line = F.try_element_at(lines, F.lit(1 if edge == "top" else -1))
    found = pages.select("book", "page", line.alias("head"))
    return found.where((F.length("head") <= params.HEAD_CHARS) & (letters(F.col("head")) >= params.HEAD_LETTERS) & ~F.col("head").rlike(not_a_head))


def detected(heads: DataFrame, titles: DataFrame, pages: DataFrame) -> DataFrame:
    """A book's sections: book, head, kind, page_from, page_to, times, confidence.

    Guide words give a section for each stem, the other heads a chapter or the running title; a book without section or
    chapter is one untitled body over all of pages(book, page).
    """
    stemmed = heads.withColumn("_stem", guide_stem(F.col("head")))
    guided = stemmed.where(F.col("_stem").isNotNull()).groupBy("book", F.col("_stem").alias("head")).agg(F.count(F.lit(1)).alias("times"), F.min("page").alias("page_from"), F.max("page").alias("page_to"))
    # Shares are of all heads, guide words included.
    others = classified(heads, titles).withColumn("_stem", guide_stem(F.col("head"))).where(F.col("_stem").isNull() & (F.col("kind") != "other")).drop("_stem")
    named = guided.withColumn("kind", F.lit("section")).unionByName(others)
    bare = pages.join(named.where(F.col("kind").isin("section", "chapter")), "book", "left_anti").groupBy("book").agg(F.min("page").alias("page_from"), F.max("page").alias("page_to"), F.lit(0).cast("long").alias("times"))
    body = bare.withColumns({"head": F.lit(None).cast("string"), "kind": F.lit("body")})
    span = F.col("page_to") - F.col("page_from") + 1
    return named.unionByName(body).withColumn("confidence", F.when(F.col("kind") != "body", F.round(F.col("times") / span, 4)))


def body_bounds(numbering: DataFrame) -> DataFrame:
    """book, first, last: where a book's arabic numbering begins and ends. numbering: book, script, page_from, page_to."""
    return numbering.where("script = 'arabic'").groupBy("book").agg(F.min("page_from").alias("first"), F.max("page_to").alias("last"))


def classified(heads: DataFrame, titles: DataFrame) -> DataFrame:
    """Kinds of a book's heads: heads(book, page, head), titles(book, title).

    The book's title if the head is most of them or much like it; a chapter if it is long, frequent, wide and dense enough; else another.
    """
    pages = heads.groupBy("book").agg(F.count(F.lit(1)).alias("_all"))
    seen = heads.groupBy("book", "head").agg(F.count(F.lit(1)).alias("times"), F.min("page").alias("page_from"), F.max("page").alias("page_to"))
    j = seen.join(pages, "book").join(titles, "book", "left")
    span = F.col("page_to") - F.col("page_from") + 1
    kind = (
        F.when((F.col("times") / F.col("_all") >= TITLE_SHARE) | F.coalesce(likeness(F.lower("head"), F.lower("title")) >= TITLE_LIKENESS, F.lit(False)), "title")
        .when((letters(F.col("head")) >= 4) & (F.col("times") >= CHAPTER_TIMES) & (span >= CHAPTER_SPAN) & (F.col("times") / span >= CHAPTER_DENSITY), "chapter")
        .otherwise("other")
    )
    return j.select("book", "head", "times", "page_from", "page_to", kind.alias("kind"))


def merged(sections: DataFrame, gap: int = params.MERGE_GAP) -> DataFrame:
    """Sections of the same head whose pages overlap or lie within a gap become one."""
    w = Window.partitionBy("book", "head").orderBy("page_from", "page_to")
    reach = F.max("page_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(reach.isNull() | (F.col("page_from") > reach + gap), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return sections.withColumn("part", part).groupBy("book", "head", "part").agg(F.min("page_from").alias("page_from"), F.max("page_to").alias("page_to"), F.sum("times").alias("times")).drop("part")


def section_for(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Each page's last section that covers it; null where none does."""
    s = sections.select(F.col("book").alias("_b"), "sequence", "head", "page_from", "page_to")
    j = pages.join(s, (F.col("book") == F.col("_b")) & F.col("page").between(F.col("page_from"), F.col("page_to")), "left")
    return j.groupBy("book", "page").agg(F.max_by("head", "sequence").alias("section"))


def outline(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy("book", "section").agg(F.count(F.lit(1)).alias("chunks")).withColumnRenamed("section", "head")
    return sections.join(n, ["book", "head"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def upper_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """The upper of the middle elements."""
    w = Window.partitionBy(group)
    placed = df.where(F.col(value).isNotNull()).withColumns({"_n": F.count(F.lit(1)).over(w), "_at": F.row_number().over(w.orderBy(value))})
    return placed.where(F.col("_at") == F.floor(F.col("_n") / 2) + 1).select(group, F.col(value).alias("median"))


def chunk_report(chunks: DataFrame, group: str) -> DataFrame:
    """chunks(group, size, kind): how many, the median size, the largest, and how many of each kind."""
    kinds = ["recipe", "prose", "unknown"]
    base = chunks.groupBy(group).agg(F.count(F.lit(1)).alias("chunks"), F.max("size").alias("largest"), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
    return base.join(upper_median(chunks, group, "size"), group)


def chunk_rows(chunks: DataFrame, sections: DataFrame, labels: DataFrame, bounds: DataFrame) -> DataFrame:
    """Chunks as they are stored: with section, kind and its reason, printed pages, hash and whether they are searched.

    chunks: book, chunk, text, page_from, page_to, headings (null: none), score, english; sections: book, sequence, head,
    page_from, page_to; labels: book, page, label, estimated; bounds: book, first, last of the numbered body.
    """
    of = section_for(chunks.select("book", F.col("page_from").alias("page")).distinct(), sections).withColumnRenamed("page", "page_from")
    side = lambda k: labels.select("book", F.col("page").alias(f"page_{k}"), F.col("label").alias(f"printed_{k}"), F.col("estimated").alias(f"_estimated_{k}"))
    j = chunks.join(of, ["book", "page_from"], "left").join(side("from"), ["book", "page_from"], "left").join(side("to"), ["book", "page_to"], "left").join(bounds, "book", "left")
    place = F.when(F.col("page_to") < F.col("first"), "before").when(F.col("page_from") > F.col("last"), "after").otherwise("body")
    made = j.withColumn("_kind", text.chunk_kind(F.col("text"), F.col("score"), F.col("headings"), place, F.col("english")))
    estimated = F.coalesce("_estimated_from", F.lit(False)) | F.coalesce("_estimated_to", F.lit(False))
    return made.select(
        "book", "chunk", "section", F.col("_kind.kind").alias("kind"), F.col("_kind.reason").alias("reason"), "page_from", "page_to", "printed_from", "printed_to", estimated.alias("estimated"), F.sha2("text", 256).alias("content_hash"),
        text.indexable(F.col("_kind.kind")).alias("indexable"),
    )


def browse(chunks: DataFrame, page_from: int, page_to: int, kinds: list[str], needle: str | None, limit: int) -> DataFrame:
    """Chunks that touch some pages, of some kinds, with a text in them whatever its case."""
    c = chunks.where((F.col("page_to") >= page_from) & (F.col("page_from") <= page_to) & F.col("kind").isin(kinds))
    if needle:
        c = c.where(F.contains(F.lower("text"), F.lit(needle.lower())))
    return c.orderBy("id").limit(max(1, limit))


def without_stops(mentions: DataFrame, stops: tuple[str, ...] = params.STOP_HEADINGS) -> DataFrame:
    """Mentions whose key is no division of a book."""
    return mentions.where((F.col("key") != "") & ~F.col("key").isin(*stops))


def assigned(keys: DataFrame, known: DataFrame) -> DataFrame:
    """keys(key) with their ids: the known one (known: key, entity), or else one that hangs on the key alone, so that a repeated run gives it again."""
    return keys.select("key").distinct().join(known, "key", "left").select("key", F.coalesce("entity", F.xxhash64("key")).alias("entity"), F.col("entity").isNull().alias("created"))


def aliased(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Keys by a small table of forced aliases (key, canonical); of several for a key the first (place) holds."""
    first = aliases
    if "place" in aliases.columns:
        first = aliases.groupBy("key").agg(F.min_by("canonical", "place").alias("canonical"))
    return mentions.join(first, "key", "left").withColumn("key", F.coalesce("canonical", "key")).drop("canonical")


def resolved(keys: DataFrame, pairs: DataFrame, splits: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """keys(key, first) with the earliest mentioned key within the pairs' edits, if one was mentioned before.

    splits(key, other): pairs that stay apart whatever their edits; stored(key): keys of an earlier run, which come before all others.
    """
    both = pairs.select("key", "other").unionByName(pairs.select(F.col("other").alias("key"), F.col("key").alias("other")))
    if splits is not None:
        apart = splits.select("key", "other").unionByName(splits.select(F.col("other").alias("key"), F.col("key").alias("other"))).distinct()
        both = both.join(apart, ["key", "other"], "left_anti")
    if stored is not None:
        keys = keys.join(stored.select("key", F.lit(True).alias("_old")), "key", "left").select("key", F.when(F.col("_old"), F.lit(-1).cast("long")).otherwise(F.col("first")).alias("first"))
    near = both.join(keys.select(F.col("key").alias("other"), F.col("first").alias("_f")), "other").join(keys, "key").where(F.col("_f") < F.col("first"))
    best = near.groupBy("key").agg(F.min_by("other", F.struct("_f", "other")).alias("_best"))
    return keys.join(best, "key", "left").select("key", F.coalesce("_best", "key").alias("resolved"))


def hydrated(ranked: DataFrame, rows: DataFrame) -> DataFrame:
    """The ranked ids' rows in their order; ids without a row are left out."""
    return ranked.join(rows, "id").orderBy("rank")


def shown(mentions: DataFrame, entities: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """One entity's mentions by year."""
    e = entities.where(F.col("key") == key).select("entity", "name")
    return mentions.join(e, "entity", "left_semi").orderBy(F.col("year").asc_nulls_last(), "m1", "m2").limit(limit)
