"""Passages rendered from catalog records, line by line, and which of them have to be written.

A passage is an array of lines: null lines are left out, empty ones part blocks and never stand twice in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The longest passage that an embedding model takes whole, and phrases for ice.
MOST_CHARS = 1600
ICE = {"None": "with no ice", "Hot": "served hot", "Crushed": "over crushed ice", "Large Cube": "over a large cube", "Small Cubes": "over small cubes"}


def some(c: Column) -> Column:
    """The line, if it says something."""
    return F.when(F.trim(c) != "", c)


def line(c: Column) -> Column:
    return F.array(c.cast("string"))


def block(c: Column) -> Column:
    """A line after an empty one, if there is one."""
    return F.when(c.isNotNull(), F.array(F.lit(""), c)).otherwise(F.array().cast("array<string>"))


def blocks(lines: Column) -> Column:
    """Some lines after an empty one; those that say nothing are left out."""
    said = F.filter(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    return F.when(F.size(said) > 0, F.concat(F.array(F.lit("")), said)).otherwise(F.array().cast("array<string>"))


def passage(*parts: Column) -> Column:
    """The lines as text."""
    text = F.array_join(F.transform(F.filter(F.concat(*parts), lambda x: x.isNotNull()), lambda x: F.regexp_replace(x, "\\s+$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def listed(c: Column, before: str = "") -> Column:
    """'a, b, c.' after some words; null where there is nothing to list."""
    return F.when(F.size(c) > 0, F.concat(F.lit(before), F.array_join(c, ", "), F.lit(".")))


def glass_phrase(served_in: Column) -> Column:
    return F.when(served_in != "None", F.concat(F.lit("served in a "), served_in))


def ice_phrase(ice: Column) -> Column:
    out = F.when(ice.isNotNull(), F.concat(F.lit("over "), F.lower(ice), F.lit(" ice")))
    for name, phrase in ICE.items():
        out = F.when(ice == name, phrase).otherwise(out)
    return out


def build_sentence(method: Column, served_in: Column, ice: Column, straw: Column) -> Column:
    """How it is made and served, in one sentence; '' where nothing is known."""
    parts = F.filter(F.array(method, glass_phrase(served_in), ice_phrase(ice), F.when(straw, "with a straw")), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.coalesce(listed(parts), F.lit(""))


def served(method: Column, served_in: Column, ice: Column, straw: Column, servings: Column) -> Column:
    """The same as a summary's one line."""
    parts = F.array(method, F.concat(F.lit("in a "), served_in), F.when(ice != "None", F.concat(ice, F.lit(" ice"))), F.when(straw, "with a straw"), F.concat(F.lit("serves "), servings.cast("string")))
    return F.array_join(F.filter(parts, lambda x: F.coalesce(x != "", F.lit(False))), ", ")


def bottles_by_style(lines: Column) -> Column:
    """'Style: a, b.' for each style of lines (array of struct(style, title) in order) that has one: styles and titles in the order of their first line, each once."""
    known = F.filter(lines, lambda x: x["style"].isNotNull())
    styles = F.array_distinct(F.transform(known, lambda x: x["style"]))
    return F.transform(styles, lambda s: F.concat(s, F.lit(": "), F.array_join(F.array_distinct(F.transform(F.filter(known, lambda x: x["style"] == s), lambda x: x["title"])), ", "), F.lit(".")))


def summary(r: dict[str, Column]) -> Column:
    """What is handed out of a drink: name, description, build, bottles, served, tags, on, notes, url."""
    how = served(r["method"], r["served_in"], r["ice"], r["straw"], r["servings"])
    return F.struct(
        r["title"].alias("name"), r["description"].alias("description"), r["build"].alias("build"), r["bottles"].alias("bottles"), how.alias("served"), r["tags"].alias("tags"), F.array_distinct(r["on"]).alias("on"), r["notes"].alias("notes"), r["url"].alias("url"),
    )


def house_passage(title: Column, subtitle: Column, text: Column) -> Column:
    """'Title — subtitle', a blank line, the text."""
    return F.concat(F.concat_ws(" — ", title, some(subtitle)), F.lit("\n\n"), text)


def member_name(title: Column, kind: Column) -> Column:
    return F.concat(title, F.when(kind == "path", " flight").when(kind == "collection", " collection").otherwise(""))


def life_years(born: Column, died: Column) -> Column:
    """'1850–1910', 'b. 1850', '–1910' where only the end is known, or null."""
    return F.when(died.isNotNull(), F.concat(F.coalesce(born.cast("string"), F.lit("")), F.lit("–"), died.cast("string"))).otherwise(F.concat(F.lit("b. "), born.cast("string")))


def style(group: Column, title: Column) -> Column:
    """An ingredient's group, unless it is its own name."""
    return F.when(group != title, group)


def variation(name: Column, entries: Column) -> Column:
    said = F.filter(F.transform(entries, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.trim(F.concat(F.coalesce(name, F.lit("Variation")), F.lit(": "), F.array_join(said, " ")))


def drink_passage(r: dict[str, Column]) -> Column:
    """A drink: title, subtitle, description, build, bottles (array of lines), sentence, servings, bartender, tags, names of the lists it is on, notes, variations (array of lines)."""
    return passage(
        line(r["title"]), line(r["subtitle"]), block(r["description"]), blocks(r["build"]), F.coalesce(r["bottles"], F.array().cast("array<string>")), F.array(F.lit(""), r["sentence"]),
        line(F.concat(F.lit("Serves "), r["servings"].cast("string"), F.lit("."))), line(F.concat(F.lit("Credited to "), r["bartender"], F.lit("."))), line(listed(r["tags"])), line(listed(F.array_distinct(r["on"]), "On the ")),
        block(r["notes"]), F.flatten(F.transform(F.coalesce(r["variations"], F.array().cast("array<string>")), lambda v: F.array(F.lit(""), v))),
    )


def recipe_passage(name: Column, description: Column, ingredients: Column, instructions: Column, notes: Column) -> Column:
    return passage(line(name), line(description), blocks(ingredients), block(instructions), block(notes))


def bartender_passage(name: Column, years: Column, description: Column, titles: Column) -> Column:
    return passage(line(name), line(years), block(description), block(listed(titles, "On the menus: ")))


def collection_passage(title: Column, subtitle: Column, description: Column, sections: Column, featured: Column) -> Column:
    """sections: array of struct(title, members) in order; an untitled one is listed alone."""
    of = F.transform(sections, lambda s: F.concat(F.when(F.coalesce(s["title"], F.lit("")) != "", F.concat(s["title"], F.lit(": "))).otherwise(""), F.array_join(s["members"], ", "), F.lit(".")))
    return passage(line(title), line(subtitle), block(description), F.array(F.lit("")), of, line(listed(featured, "Featured: ")))


def within_ceiling(df: DataFrame, name: str, text: str = "text", most: int = MOST_CHARS) -> DataFrame:
    """df as it is; a passage that is too long to be embedded whole stops the query."""
    too_long = F.concat(F.lit("the passage of "), F.col(name).cast("string"), F.lit(f" is over {most} characters"))
    return df.withColumn(text, F.when(F.length(text) > most, F.raise_error(too_long).cast("string")).otherwise(F.col(text)))


def to_write(rendered: DataFrame, stored: DataFrame, version: int) -> DataFrame:
    """The rendered rows (key, hash, ...) that are not stored with this hash and renderer version."""
    same = stored.where(F.col("version") == version).select("key", "hash")
    return rendered.join(same, ["key", "hash"], "left_anti")


def checked_references(facts: DataFrame, column: str, dimension: DataFrame, key: str) -> DataFrame:
    """facts as they are; the first value that points to nothing stops the query."""
    known = dimension.select(F.col(key).alias("_known")).distinct()
    lost = F.concat(F.lit(f"{column} points to nothing: "), F.col(column).cast("string"))
    joined = facts.join(known, F.col(column) == F.col("_known"), "left")
    return joined.withColumn(column, F.when(F.col(column).isNotNull() & F.col("_known").isNull(), F.raise_error(lost).cast(facts.schema[column].dataType)).otherwise(F.col(column))).drop("_known")


def coverage_sentence(counted: Column, total: Column, carrying: Column, window: Column, ordered: Column) -> Column:
    """What a tally rests on, in words: the shelf or the window, how uneven it is, and what years mean where entries are ordered by them."""
    n, t = counted.cast("string"), total.cast("string")
    rest = F.greatest(total - counted, F.lit(0))
    shelf = F.when(rest == 0, F.concat(F.lit("Tallied across all "), t, F.lit(" books on the shelf."))).otherwise(
        F.concat(F.lit("Tallied across "), n, F.lit(" of the "), t, F.lit(" books on the shelf; the other "), rest.cast("string"), F.lit(" print no drink headings to count."))
    )
    inside = F.when(counted == 0, F.concat(F.lit("Tallied over "), window, F.lit(", a period this shelf holds no books from."))).otherwise(
        F.concat(
            F.lit("Tallied over "), window, F.lit(" only: "), n, F.when(counted == 1, " book").otherwise(" books"),
            F.lit(" on the shelf printed anything in that period, and every count below is out of those, not out of the whole shelf."),
        )
    )
    uneven = F.when(
        (carrying > 0) & (carrying < counted),
        F.concat(F.lit("It is not spread evenly: nine parts in ten of the count come from "), carrying.cast("string"), F.lit(" of them, the recipe books. The rest are narrative and name a drink only in passing.")),
    )
    years = F.when(ordered, "These years are when a drink was printed in a book on this shelf, which is not the same as when it was invented; say it that way.")
    return F.concat_ws(" ", F.when(window.isNull(), shelf).otherwise(inside), uneven, years)


def json_payload(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and the row as indented JSON; signs beyond ASCII stay as they are, and null fields stay as null."""
    return df.select(key, F.to_json(F.struct(*columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("payload"))


def source_table(found: DataFrame) -> DataFrame:
    """What an answer rests on: found(rank, title, pages, score, text) as rows for people, scores with four digits and the text's first 80 characters on one line."""
    flat = F.regexp_replace("text", "\\s+", " ")
    return found.orderBy("rank").select("rank", "title", "pages", F.format_string("%.4f", "score").alias("score"), F.when(F.length(flat) > 80, F.concat(F.substring(flat, 1, 79), F.lit("…"))).otherwise(flat).alias("text"))


def throughput(batches: DataFrame) -> DataFrame:
    """batches(rows, seconds) as one row: batches, rows, seconds, rows a second (0 where no time passed)."""
    sums = batches.agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))
    return sums.withColumn("per_second", F.round(F.coalesce(F.try_divide("rows", "seconds"), F.lit(0.0)), 2))
