"""Order-dependent structure: runs, intervals, sessions, the nearest interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import params
from quire.operators import text


def runs(df: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values in order, numbered in their group: group, run, value, n, and the first and last place."""
    w = Window.partitionBy(*group).orderBy(*order)
    placed = df.withColumn("_place", F.row_number().over(w)).withColumn("_turn", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.col("_place") == 1)).cast("int"))
    numbered = placed.withColumn("run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"), F.min("_place").alias("first_place"), F.max("_place").alias("last_place"))


def series(df: DataFrame, group: list[str], order: list[str], value: str, least: int = params.SERIES_MIN_RUN) -> DataFrame:
    """Runs of at least `least`; survivors that then stand side by side with the same value become one."""
    kept = runs(df, group, order, value).where(F.col("n") >= least)
    w = Window.partitionBy(*group).orderBy("first_place")
    turn = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag("run").over(w).isNull()).cast("int")
    joined = kept.withColumn("_turn", turn).withColumn("series", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(*group, "series").agg(F.first(value).alias(value), F.sum("n").alias("n"), F.min("first_place").alias("first_place"), F.max("last_place").alias("last_place"))


def nearest(points: DataFrame, intervals: DataFrame, group: str, at: str, tolerance: int = params.EXTRAPOLATE_PAGES) -> DataFrame:
    """Each point's interval: the one that covers it, else the nearest within the tolerance; the earlier wins ties.

    intervals: group, first, last, and what they carry. A point without one keeps nulls. Distance 0: covered.
    """
    i = intervals.withColumnRenamed(group, "_g")
    p = F.col(at)
    distance = F.when(p < F.col("first"), F.col("first") - p).when(p > F.col("last"), p - F.col("last")).otherwise(0)
    near = points.join(i, (F.col(group) == F.col("_g")) & (p >= F.col("first") - tolerance) & (p <= F.col("last") + tolerance), "left").withColumn("distance", F.when(F.col("_g").isNotNull(), distance))
    order = Window.partitionBy(group, at).orderBy(F.col("distance").asc_nulls_last(), "first")
    return near.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_g")


def numbering(observed: DataFrame, least: int = params.SERIES_MIN_RUN, others: Column | None = None) -> DataFrame:
    """book, series, script, offset, lower, page_from, page_to: where the printed numbers of observed(book, page, label) run on evenly.

    What is no number of at most four digits and no roman numeral is not read, or is a roman numeral for the number that
    `others` gives. lower: whether the book has small roman numerals.
    """
    label = F.trim("label")
    arabic, roman = F.when(label.rlike("^[0-9]{1,4}$"), label.cast("int")), text.roman_value(label)
    read = observed.select("book", "page", F.coalesce(arabic, roman, *([] if others is None else [others])).alias("_number"), F.when(arabic.isNotNull(), "arabic").otherwise("roman").alias("script"), (arabic.isNull() & (label == F.lower(label))).alias("_lower")).where(F.col("_number").isNotNull())
    read = read.withColumn("_value", F.struct("script", (F.col("_number") - F.col("page")).alias("offset"))).withColumn("_place", F.row_number().over(Window.partitionBy("book").orderBy("page")))
    found = series(read.withColumnRenamed("_place", "_at"), ["book"], ["page"], "_value", least)
    place = lambda name, page: read.select("book", F.col("_place").alias(name), F.col("page").cast("long").alias(page))
    lower = read.groupBy("book").agg(F.bool_or("_lower").alias("lower"))
    out = found.join(place("first_place", "page_from"), ["book", "first_place"]).join(place("last_place", "page_to"), ["book", "last_place"]).join(lower, "book")
    return out.select("book", "series", "_value.script", "_value.offset", "lower", "page_from", "page_to")


def printed_labels(pages: DataFrame, observed: DataFrame, numbered: DataFrame, most_roman: int | None = None) -> DataFrame:
    """book, page, label, estimated of pages(book, page): the number that the series over it implies, or the nearest one within some pages.

    Estimated: beyond the series, or where the page's own label says otherwise. A roman numeral beyond `most_roman` is no label.
    """
    i = numbered.select("book", "script", "offset", "lower", F.col("page_from").alias("first"), F.col("page_to").alias("last"))
    near = nearest(pages.select("book", "page").distinct(), i, "book", "page").join(observed.select("book", "page", F.trim("label").alias("_seen")), ["book", "page"], "left")
    number = F.col("page") + F.col("offset")
    roman = text.roman(number) if most_roman is None else F.when(number <= most_roman, text.roman(number))
    label = F.when(number.isNull() | (number < 1), None).when(F.col("script") == "arabic", number.cast("string")).when(F.col("lower"), F.lower(roman)).otherwise(roman)
    other = F.col("_seen").isNotNull() & (F.lower("_seen") != F.lower("label"))
    out = near.withColumn("label", label)
    return out.select("book", "page", "label", F.when(F.col("label").isNotNull(), (F.col("distance") > 0) | other).alias("estimated"))


def overlapping(ranges: DataFrame, spans: DataFrame, group: str) -> DataFrame:
    """Which spans a half-open range touches: ranges(group, id, start, end), spans(group, page, first, last), both non-empty."""
    r = ranges.withColumnRenamed(group, "_g")
    return r.join(spans, (F.col("_g") == F.col(group)) & (F.col("start") < F.col("last")) & (F.col("end") > F.col("first")) & (F.col("first") < F.col("last"))).groupBy("id").agg(F.min("page").alias("page_from"), F.max("page").alias("page_to"))


def union_length(ranges: DataFrame, group: str) -> DataFrame:
    """How much of the line half-open ranges cover, overlaps once."""
    w = Window.partitionBy(group).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(w), F.col("start")))
    return ranges.withColumn("_new", F.greatest(fresh, F.lit(0))).groupBy(group).agg(F.sum("_new").alias("covered"))


def sessions(events: DataFrame, key: str, at: str, minutes: int = params.IDLE_MINUTES) -> DataFrame:
    """Sessions that an idle time ends: key, first and last event, how many."""
    s = events.groupBy(key, F.session_window(at, f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("events"), F.min(at).alias("first"), F.max(at).alias("last"))
    return s.drop("w")


def last_messages(messages: DataFrame, group: str, order: str, n: int = params.LAST_MESSAGES) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.col(order).desc())
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def heading_density(pages: DataFrame, group: str, forced: dict | None = None) -> DataFrame:
    """Headings for each populated page, and what that says about how to cut; `forced` names the strategy of some groups."""
    full = pages.where(F.trim("text") != "")
    out = full.groupBy(group).agg(F.round(F.avg(F.col("headings").cast("double")), 4).alias("density"))
    strategy = F.when(F.col("density") >= params.HEADINGS_PER_PAGE, "headings").otherwise("packing")
    for name, how in (forced or {}).items():
        strategy = F.when(F.col(group) == name, how).otherwise(strategy)
    return out.withColumn("strategy", strategy)


def edge(heads: DataFrame, group: str) -> DataFrame:
    """At which edge of the page a group's heads repeat; the share of repeated ones decides, ties go to the top."""
    counted = heads.where("head is not null").groupBy(group, "edge", "head").agg(F.count(F.lit(1)).alias("n"))
    share = counted.groupBy(group, "edge").agg((F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    sides = share.groupBy(group).agg(*(F.round(F.coalesce(F.max(F.when(F.col("edge") == e, F.col("share"))), F.lit(0.0)), 4).alias(e) for e in ("top", "bottom")))
    best = F.when(F.greatest("top", "bottom") < params.EDGE_SHARE, "none").when(F.col("top") >= F.col("bottom"), "top").otherwise("bottom")
    return sides.withColumn("edge", best)


def fuzzy_pairs(keys: DataFrame, edits: int = 1, shortest: int = 6) -> DataFrame:
    """Pairs of keys within some edits. Of `edits` + 1 pieces of a key one is left as it is, at most `edits` places away: pairs meet on such a piece."""
    k = keys.select("key").distinct().where(F.length("key") >= shortest)
    pieces = edits + 1

    def cut(length: Column, i: int) -> tuple[Column, Column]:
        a, b = F.floor(length * i / pieces), F.floor(length * (i + 1) / pieces)
        return a.cast("int"), (b - a).cast("int")

    n = F.length("key")
    left = k.select("key", F.inline(F.array(*(F.struct(F.lit(i).alias("i"), F.substring("key", cut(n, i)[0] + 1, cut(n, i)[1]).alias("piece"), n.alias("size")) for i in range(pieces)))))
    right = k.select(F.col("key").alias("other"), F.explode(F.sequence(n - edits, n + edits)).alias("size"))
    probes = [
        right.select("other", "size", F.lit(i).alias("i"), F.substring("other", F.greatest(cut(F.col("size"), i)[0] + 1 + d, F.lit(1)), cut(F.col("size"), i)[1]).alias("piece")) for i in range(pieces) for d in range(-edits, edits + 1)
    ]
    probe = probes[0]
    for p in probes[1:]:
        probe = probe.unionByName(p)
    met = left.join(probe.distinct(), ["i", "piece", "size"]).where(F.col("key") < F.col("other")).select("key", "other").distinct()
    return met.withColumn("edits", F.levenshtein("key", "other")).where(F.col("edits") <= edits)
