"""Catalog sync and status: hashes, diffs, flattened lists, rendered lines, invariants as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def record_hash(*columns: str) -> Column:
    """SHA-256 of the columns, each with its length before it, so that no two rows share a form; null and '' differ."""
    of = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(*(F.coalesce(of(F.col(c).cast("string")), F.lit("~")) for c in columns)), 256)


def diff(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and status (created, updated, unchanged, deleted): what an upsert would do."""
    a = new.select(key, record_hash(*columns).alias("_new"))
    b = old.select(key, record_hash(*columns).alias("_old"))
    status = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when(F.col("_new") == F.col("_old"), "unchanged").otherwise("updated")
    return a.join(b, key, "full").select(key, status.alias("status"))


def changes(new: DataFrame, old: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Counts of each status, 0 included. A second identical run has nothing but unchanged rows."""
    return zero_filled(diff(new, old, key, columns), "status", ["created", "updated", "unchanged", "deleted"])


def upserted(new: DataFrame, old: DataFrame, key: str, prune: bool = True) -> DataFrame:
    """The table after the sync: new rows, and what they don't name where nothing is pruned."""
    return new if prune else new.unionByName(old.join(new.select(key), key, "left_anti"))


def zero_filled(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    names = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return F.broadcast(names).join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def dangling(facts: DataFrame, column: str, dimension: DataFrame, key: str) -> DataFrame:
    """Values that point to nothing; null points nowhere and is fine."""
    return facts.where(F.col(column).isNotNull()).join(dimension.select(F.col(key).alias(column)), column, "left_anti").select(column).distinct()


def flatten(lists: DataFrame, key: str) -> DataFrame:
    """lists(key, sections array<struct<title, members>>, featured array): one row a member with its running position; featured ones follow."""
    sections = lists.select(key, F.posexplode("sections").alias("_s", "section")).select(key, "_s", F.col("section.title").alias("section"), F.posexplode("section.members").alias("_m", "member")).withColumn("featured", F.lit(False))
    featured = lists.select(key, F.lit(1 << 30).alias("_s"), F.lit(None).cast("string").alias("section"), F.posexplode("featured").alias("_m", "member")).withColumn("featured", F.lit(True))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_s", "_m"))
    return sections.unionByName(featured).withColumn("position", place).drop("_s", "_m")


def flat_tags(categories: DataFrame) -> DataFrame:
    """categories(label, tags array<struct<label, order>>) as category, label, order."""
    return categories.select(F.col("label").alias("category"), F.inline("tags"))


def with_groups(lists: DataFrame, key: str) -> DataFrame:
    """lists(key, groups array<struct<heading, members>>, members array) as key, section, member, position: groups where there are any, else the plain members."""
    plain = F.array(F.struct(F.lit(None).cast("string").alias("heading"), F.col("members").alias("members")))
    grouped = lists.select(key, F.posexplode(F.when(F.size("groups") > 0, F.col("groups")).otherwise(plain)).alias("_g", "g"))
    each = grouped.select(key, "_g", F.col("g.heading").alias("section"), F.posexplode("g.members").alias("_m", "member"))
    return each.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("_g", "_m"))).drop("_g", "_m")


def missing_files(spark: SparkSession, expected: list[str], present: DataFrame) -> DataFrame:
    """name: the expected files that are not among present(name)."""
    return spark.createDataFrame([(n,) for n in expected], "name string").join(present.select("name"), "name", "left_anti")


def lines(*parts: Column) -> Column:
    """The parts that say something, one a line, runs of empty lines as one."""
    return F.trim(F.regexp_replace(F.concat_ws("\n", *(F.when(F.trim(p) != "", p) for p in parts)), "\n{3,}", "\n\n"))


def keywords(*values: Column) -> Column:
    """Distinct in order, without what says nothing."""
    return F.array_distinct(F.filter(F.array(*values), lambda v: v.isNotNull() & ~v.isin("", "None", "Default")))


def absolute(url: Column, base: str) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(url, F.lit("/"))))


def unique_slugs(df: DataFrame, base: str, order: str) -> DataFrame:
    """slug: the base, and -2, -3 ... for those that come later."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return df.withColumn("slug", F.when(n == 1, F.col(base)).otherwise(F.concat_ws("-", base, n.cast("string"))))


def file_facts(name: Column) -> Column:
    """Title, author, year, edition of a file name: a year from 1600 to 1999 leads or ends it, ' by ' parts title and author, an edition stands in brackets."""
    stem = F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[Pp][Dd][Ff]$", ""), "_", " "))
    gone = lambda c: F.when(c != "", c)
    year = F.coalesce(gone(F.regexp_extract(stem, r"^(1[6-9]\d\d)\b", 1)), gone(F.regexp_extract(stem, r"\((1[6-9]\d\d)\)$", 1)))
    rest = F.trim(F.regexp_replace(F.regexp_replace(stem, r"^1[6-9]\d\d\b[\s.-]*", ""), r"\s*\(1[6-9]\d\d\)$", ""))
    title = F.trim(F.regexp_extract(rest, r"^(.*?)(?: by (.*))?$", 1))
    author = F.regexp_extract(rest, r"^(.*?) by (.*)$", 2)
    edition = F.regexp_extract(author, r"\(([^)]*)\)$", 1)
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.struct(title.alias("title"), gone(F.trim(F.regexp_replace(author, r"\([^)]*\)$", ""))).alias("author"), year.cast("int").alias("year"), gone(edition).alias("edition"), slug.alias("slug"))


def overridden(facts: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """facts with the fields that a small table of overrides (one row a key) gives."""
    o = overrides.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return facts.join(o, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in facts.columns))


def registered(found: DataFrame, known: DataFrame) -> DataFrame:
    """What a scan of files means, by name: size and time first, the checksum only where those differ. found, known: name, size, modified, checksum."""
    k = known.select("name", *(F.col(c).alias(f"_{c}") for c in ("size", "modified", "checksum")))
    f = found.withColumn("_there", F.lit(True)).join(k.withColumn("_known", F.lit(True)), "name", "full")
    same = (F.col("size") == F.col("_size")) & (F.col("modified") == F.col("_modified"))
    status = F.when(F.col("_there").isNull(), "missing").when(F.col("_known").isNull(), "new").when(same, "unchanged").when(F.col("checksum") == F.col("_checksum"), "touched").otherwise("changed")
    return f.select("name", status.alias("status"))


def status(pages: DataFrame, chunks: DataFrame, group: str) -> DataFrame:
    """A status row for each group: pages, populated ones, mean quality, chunks, indexable and embedded ones, share accounted for."""
    p = pages.groupBy(group).agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.trim("text") != "").alias("populated"), F.round(F.avg("score"), 4).alias("quality"))
    c = chunks.groupBy(group).agg(F.count(F.lit(1)).alias("chunks"), F.count_if("indexable").alias("indexable"), F.count_if(F.col("indexable") & F.col("embedded")).alias("embedded"))
    out = p.join(c, group, "left").fillna(0, ["chunks", "indexable", "embedded"])
    return out.withColumn("accounted", F.round(F.coalesce(F.try_divide(100 * F.col("populated"), "pages"), F.lit(0.0)), 2))


def sound(checks: DataFrame) -> DataFrame:
    """One row of named counts as (name, n, ok)."""
    return checks.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n"), (F.col(c) == 0).alias("ok")) for c in checks.columns))))


def stages_until_failure(spark: SparkSession, stages: list) -> list[tuple[str, str]]:
    """Runs named stages in order and stops at the first that raises: (name, 'ok' or the error)."""
    done = []
    for name, run in stages:
        try:
            run(spark)
        except Exception as e:  # noqa: BLE001  whatever it is, what follows must not run
            return [*done, (name, str(e))]
        done.append((name, "ok"))
    return done
