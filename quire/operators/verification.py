"""Invariants of the stored tables: each suite is one row of counts that are all 0 for a sound corpus (`catalog.sound` makes rows of them)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.tally import folded_key


def one_row(*counts: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    return reduce(lambda a, b: a.join(F.broadcast(b)), counts)


def failing(df: DataFrame, name: str, wrong: Column | None = None) -> DataFrame:
    return df.agg((F.count(F.lit(1)) if wrong is None else F.count_if(wrong)).alias(name))


def mention_checks(mentions: DataFrame, chunks: DataFrame, books: DataFrame) -> DataFrame:
    """Mentions (heading, char_start, chunk, page_from, page_to, year, book) against their chunks (chunk, text, char_start, page_from, page_to, indexable) and books (book, year).

    misplaced: no chunk, or other bytes at the offset; mismatched: other pages than the chunk's; excluded: in a chunk that is not searched; wrong_year.
    """
    c = chunks.select("chunk", "text", F.col("char_start").alias("_start"), F.col("page_from").alias("_from"), F.col("page_to").alias("_to"), "indexable")
    b = books.select("book", F.col("year").alias("_year"), F.lit(True).alias("_book"))
    j = mentions.join(c, "chunk", "left").join(b, "book", "left")
    offset = F.col("char_start") - F.col("_start")
    heading = F.encode("heading", "UTF-8")
    there = F.substring(F.encode("text", "UTF-8"), (offset + 1).cast("int"), F.octet_length("heading").cast("int"))
    known = F.col("_start").isNotNull()
    return j.agg(
        F.count_if(~known | (offset < 0) | (there != heading)).alias("misplaced"),
        F.count_if(known & ~(F.col("page_from").eqNullSafe(F.col("_from")) & F.col("page_to").eqNullSafe(F.col("_to")))).alias("mismatched"),
        F.count_if(known & ~F.col("indexable")).alias("excluded"),
        F.count_if(~F.col("year").eqNullSafe(F.col("_year"))).alias("wrong_year"),
    )


def entity_checks(entities: DataFrame, mentions: DataFrame, stop: list[str], versions: tuple[int, ...]) -> DataFrame:
    """Stored entities (entity, name, key, mentions, books, first_year, last_year, aliases, versions array) against their mentions (entity, book, year, heading) and the code's versions."""
    year = F.when(F.col("year") != 0, F.col("year"))
    now = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("book").alias("_books"), F.min(year).alias("_first"), F.max(year).alias("_last"))
    j = entities.join(now, "entity", "left")
    alive = F.col("_n").isNotNull()
    same = reduce(lambda a, b: a & b, (F.col(a).eqNullSafe(F.col(b)) for a, b in (("mentions", "_n"), ("books", "_books"), ("first_year", "_first"), ("last_year", "_last"))))
    counts = j.agg(
        F.count_if(~alive).alias("empty"),
        F.count_if(alive & ~same).alias("drifted"),
        F.count_if(alive & (folded_key(F.col("name")) != F.col("key"))).alias("unfoldable"),
        F.count_if(alive & F.col("key").isin(stop)).alias("stop_words"),
        F.greatest(F.count_distinct("versions") - 1, F.lit(0)).alias("version_sets"),
        F.count_if(F.col("versions") != F.array(*(F.lit(v) for v in versions))).alias("other_versions"),
    )
    printed = mentions.select("entity", F.col("heading").alias("alias")).distinct()
    orphans = entities.select("entity", F.explode("aliases").alias("alias")).join(mentions.select("entity").distinct(), "entity", "left_semi").join(printed, ["entity", "alias"], "left_anti")
    return one_row(counts, failing(orphans, "orphan_aliases"))


def embedding_checks(chunks: DataFrame, model: str, dimensions: int, version: int, other_model: str, other_dimensions: int) -> DataFrame:
    """Chunks (vector, indexable, model, dimensions, version, content_hash, embedded_hash) against the configuration, and this corpus' against the other one's, as one server serves both."""
    held = F.col("vector").isNotNull()
    triple = F.struct("model", "dimensions", "version")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return chunks.agg(
        F.lit(int(model != other_model)).cast("long").alias("other_model"),
        F.lit(int(dimensions != other_dimensions)).cast("long").alias("other_dimensions"),
        F.count_if(F.col("indexable") & ~held).alias("unembedded"),
        F.count_if(~F.col("indexable") & held).alias("excluded_but_embedded"),
        F.greatest(F.count_distinct(F.when(held, triple)) - 1, F.lit(0)).alias("triples"),
        F.count_if(held & ~triple.eqNullSafe(F.struct(F.lit(model).alias("model"), F.lit(dimensions).alias("dimensions"), F.lit(version).alias("version")))).alias("not_as_configured"),
        F.count_if(held & (F.size("vector") != F.col("dimensions"))).alias("wrong_width"),
        F.count_if(held & (norm == 0)).alias("zero_norm"),
        F.count_if(held & ~F.col("embedded_hash").eqNullSafe(F.col("content_hash"))).alias("drifted"),
    )


def catalog_checks(items: DataFrame, uses: DataFrame, tags: DataFrame, lists: DataFrame, members: DataFrame, manifest: DataFrame) -> DataFrame:
    """items(item), uses(item, ingredient, free_text), tags(item), lists(list), members(list, item), manifest(name, expected, actual).

    wrong_counts: tables that hold another number than the manifest says; pours_of_nothing; items without ingredients, without tags; lists without items.
    """
    return one_row(
        failing(manifest, "wrong_counts", ~F.col("expected").eqNullSafe(F.col("actual"))),
        failing(uses, "pours_of_nothing", F.col("ingredient").isNull() & F.col("free_text").isNull()),
        failing(items.join(uses, "item", "left_anti"), "without_ingredients"),
        failing(items.join(tags, "item", "left_anti"), "without_tags"),
        failing(lists.join(members, "list", "left_anti"), "empty_lists"),
    )


def passage_checks(records: DataFrame, chunks: DataFrame, version: int) -> DataFrame:
    """records(key, text: what rendering gives now) against stored chunks(key, text, hash, version).

    wrong_number; stale: missing, or whose own text is not what rendering gives; wrong_hash: the stored hash does not describe the stored text; outdated.
    """
    j = records.select("key", F.col("text").alias("_now")).join(chunks.select("key", F.col("text").alias("_then")), "key", "left")
    n = records.agg(F.count(F.lit(1)).alias("_records")).join(F.broadcast(chunks.agg(F.count(F.lit(1)).alias("_chunks"))))
    return one_row(
        n.select(F.abs(F.col("_records") - F.col("_chunks")).alias("wrong_number")),
        failing(j, "stale", ~F.col("_now").eqNullSafe(F.col("_then"))),
        failing(chunks, "wrong_hash", ~F.sha2("text", 256).eqNullSafe(F.col("hash"))),
        failing(chunks, "outdated", F.col("version") < version),
    )
