"""Page text: normalization, counts, quality, choice of the best candidate."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire import params

# Characters that results depend on.
#: Control characters (but tab and line ends), soft hyphen, zero-width characters, byte order mark.
INVISIBLE = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\u00AD\\u200B-\\u200D\\uFEFF]"
UNICODE_SPACES = "[\\u00A0\\u1680\\u2000-\\u200A\\u202F\\u205F\\u3000]"
ROMAN_PARTS = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
ROMAN = "^(?i)m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"


def composed(c: Column) -> Column:
    """NFC; there is no built-in for it."""

    def nfc(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))

    return F.pandas_udf(nfc, StringType())(c)


def ligatures(c: Column) -> Column:
    for k, v in params.LIGATURES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def visible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def plain_spaces(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "\\r\\n?", "\n"), UNICODE_SPACES, " ")


def hyphens_joined(c: Column) -> Column:
    """A word cut at a line's end by a hyphen, between lower-case letters alone."""
    return F.regexp_replace(c, "(\\p{Ll})-[ \\t]*\\n[ \\t]*(\\p{Ll})", "$1$2")


def collapsed(c: Column) -> Column:
    """One blank for each run, none around line ends, one empty line at most, none at the edges."""
    c = F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), " ?\\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(c, "\\n{3,}", "\n\n"), "^[ \\n]+|[ \\n]+$", "")


def prepared(c: Column) -> Column:
    return plain_spaces(visible(ligatures(composed(c))))


def normalized_page(c: Column) -> Column:
    """The whole chain: struct(text, label)."""
    return let(without_label(prepared(c)), lambda p: F.struct(collapsed(hyphens_joined(p["text"])).alias("text"), p["label"].alias("label")))


def normalized(c: Column) -> Column:
    return normalized_page(c)["text"]


def roman_value(c: Column) -> Column:
    """The number of a well-formed roman numeral of 1 to 7 letters, else null."""
    digit = lambda x: F.element_at(F.create_map(*(F.lit(v) for p in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for v in p)), x)
    values = F.transform(F.filter(F.split(F.lower(c), ""), lambda x: x != ""), digit)
    total = F.aggregate(values, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda a, x: F.struct((a["sum"] + x - F.when(a["last"] < x, 2 * a["last"]).otherwise(0)).alias("sum"), x.alias("last")))["sum"]
    return F.when((F.length(c).between(1, 7)) & c.rlike(ROMAN), total)


def roman(number: Column) -> Column:
    """The roman numeral of a positive number, '' for others."""
    left, out = F.greatest(number, F.lit(0)), []
    for value, letters in ROMAN_PARTS:
        out.append(F.repeat(F.lit(letters), F.floor(left / value).cast("int")))
        left = left % value
    return F.when(number.isNotNull(), F.concat(*out))


#: A line that is a page number alone: digits or roman letters, between dashes or in brackets if at all.
BARE_LABEL = "^[\\[(]?\\s*[-—–]?\\s*(\\d{1,4}|[ivxlcdm]{1,7}|[IVXLCDM]{1,7})\\s*[-—–]?\\s*[\\])]?$"
NUMBER_FIRST, NUMBER_LAST = "^(\\d{1,4})\\s+(\\S.*)$", "^(.*\\S)\\s+(\\d{1,4})$"


def running_head(c: Column) -> Column:
    """At least three letters, six of ten in capitals."""
    letters = F.length(F.regexp_replace(c, "[^\\p{L}]", ""))
    return (letters >= 3) & (F.length(F.regexp_replace(c, "[^\\p{Lu}]", "")) / letters >= 0.6)


def edge_line(line: Column) -> Column:
    """A trimmed edge line as struct(kept, label): a page number goes, beside a running head it is lifted out."""
    bare = F.regexp_extract(line, BARE_LABEL, 1)
    first, last = (line.rlike(p) & running_head(F.regexp_extract(line, p, g)) for p, g in ((NUMBER_FIRST, 2), (NUMBER_LAST, 1)))
    kept = F.when(bare != "", "").when(first, F.regexp_extract(line, NUMBER_FIRST, 2)).when(last, F.regexp_extract(line, NUMBER_LAST, 1)).otherwise(line)
    label = F.when(bare != "", bare).when(first, F.regexp_extract(line, NUMBER_FIRST, 1)).when(last, F.regexp_extract(line, NUMBER_LAST, 2))
    return F.struct(kept.alias("kept"), label.alias("label"))


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once for a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without_label(c: Column) -> Column:
    """struct(text, label): the first and the last populated line without their page numbers, the first of which is the page's label."""

    def placed(lines: Column) -> Column:
        bare = F.transform(lines, lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))
        return F.struct(lines.alias("lines"), bare.alias("bare"))

    def found(x: Column) -> Column:
        populated = F.transform(x["bare"], lambda v: v != "")
        last = F.size(x["bare"]) + 1 - F.array_position(F.reverse(populated), True)
        return F.struct(x["lines"].alias("lines"), x["bare"].alias("bare"), F.array_position(populated, True).cast("int").alias("first"), last.cast("int").alias("last"))

    def edges(x: Column) -> Column:
        top, bottom = (let(F.get(x["bare"], x[k] - 1), edge_line) for k in ("first", "last"))
        return F.struct(x["lines"].alias("lines"), x["first"].alias("first"), x["last"].alias("last"), top.alias("top"), bottom.alias("bottom"))

    def joined(x: Column) -> Column:
        kept = F.transform(x["lines"], lambda v, i: F.when(x["first"] == 0, v).when(i + 1 == x["first"], x["top"]["kept"]).when(i + 1 == x["last"], x["bottom"]["kept"]).otherwise(v))
        return F.struct(F.array_join(kept, "\n").alias("text"), F.when(x["first"] > 0, F.coalesce(x["top"]["label"], x["bottom"]["label"])).alias("label"))

    return let(let(let(let(F.split(c, "\n"), placed), found), edges), joined)


def label(c: Column) -> Column:
    return without_label(c)["label"]


def lifted(c: Column) -> Column:
    return without_label(c)["text"]


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(c), "\\s+"), lambda w: w != ""))


def token_estimate(c: Column) -> Column:
    """The larger of characters and words, as tokens, and something for digits and other scripts."""
    runs = F.regexp_count(c, F.lit("[0-9]+"))
    other = F.length(F.regexp_replace(c, "[\\x00-\\x7F]", ""))
    return F.greatest(F.ceil(F.length(c) / params.CHARS_PER_TOKEN), F.ceil(word_count(c) * 1.4)) + F.ceil(runs * 0.5) + F.ceil(other * 0.4)


# Quality


def words_of(c: Column) -> Column:
    """White-space tokens without what is no letter or digit at their edges; those that hold a letter."""
    return F.regexp_extract_all(c, F.lit("(?=[^\\s\\p{L}]*\\p{L})[\\p{L}\\p{N}](?:\\S*[\\p{L}\\p{N}])?"), 0)


VOWELS = params.VOWELS


def _usual() -> str:
    """Most words: one pattern that only plausible words match. At most three consonants and two vowels in a row keep the share of vowels from 1/7 to 4/5."""
    consonants = "".join(x for x in "abcdefghijklmnopqrstuvwxyz" if x not in VOWELS)
    vowels = "".join(x for x in VOWELS if ord(x) < 256)  # such classes are looked up in a bit set
    v, k = f"[{vowels}]", f"[{consonants}]"
    first_v, first_k = f"[{vowels}{''.join(x.upper() for x in vowels if x.isascii())}]", f"[{consonants}{consonants.upper()}]"
    return f"^(?=.{{1,22}}$)(?:{first_k}{k}{{0,2}}{v}{{1,2}}|{first_v}{v}?)(?:{k}{{1,3}}{v}{{1,2}})*{k}{{0,3}}$"


USUAL = _usual()


def plausible_part(w: Column) -> Column:
    """A capital roman numeral, or a word in one case (or capitalised) with a usual share of vowels and no long run without one."""
    n, low = F.length(w), F.lower(w)
    vowels = n - F.length(F.translate(low, VOWELS, ""))
    balanced = ((n < 3) | (vowels > 0)) & ((n < 4) | (vowels / n).between(0.10, 0.80)) & ~low.rlike(f"[^{VOWELS}]{{6}}")
    return w.rlike("^[IVXLCDM]+$") | (w.rlike("^(\\p{Ll}+|\\p{Lu}+|\\p{Lu}\\p{Ll}*)$") & balanced)


def plausible(w: Column) -> Column:
    parts = F.filter(F.split(w, "['’‘-]"), lambda p: p != "")
    return w.rlike(USUAL) | (F.length(w) <= 22) & ~w.rlike("\\p{N}") & let(parts, lambda x: (F.size(x) > 0) & F.forall(x, plausible_part))


def quality(c: Column) -> Column:
    """0.6 of the share of plausible words, 0.2 of letters among what is not blank, 0.2 of how usual the words' mean length is; null below 8 words."""
    solid = F.greatest(F.length(F.regexp_replace(c, "\\s", "")), F.lit(1))
    alpha = F.least(F.lit(1.0), F.length(F.regexp_replace(c, "[^\\p{L}]", "")) / solid / 0.85)

    def of(words: Column) -> Column:
        n = F.size(words)
        share = F.size(F.filter(words, plausible)) / n
        mean = F.length(F.array_join(words, "")) / n
        fit = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.abs(mean - 4.7) / 4))
        return F.when(n >= 8, F.round(0.6 * share + 0.2 * alpha + 0.2 * fit, 4))

    return let(words_of(c), of)


def passes(score: Column, least: float = params.QUALITY_MIN_SCORE) -> Column:
    return F.coalesce(score >= least, F.lit(False))


# Candidates: page, source, text, score, status, id (the order in which they were stored)


def promoted(candidates: DataFrame, preferred: str | None = None) -> DataFrame:
    """Each page's winner: the preferred source where it has text, else the best score (none counts -1), else the first stored."""
    alive = candidates.where((F.col("status") == "extracted") & (F.trim("text") != ""))
    first = F.when(F.col("source") == F.lit(preferred), 0).otherwise(1) if preferred else F.lit(1)
    order = Window.partitionBy("page").orderBy(first, F.coalesce("score", F.lit(-1.0)).desc(), "id")
    return alive.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def blank_pages(candidates: DataFrame) -> DataFrame:
    """Pages all of whose extractions succeeded and gave nothing."""
    return candidates.groupBy("page").agg(F.bool_and((F.col("status") == "extracted") & (F.trim(F.coalesce("text", F.lit(""))) == "")).alias("blank")).where("blank").select("page")


def by_source(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("source").agg(F.round(F.avg("score"), 4).alias("mean_score"), F.count(F.lit(1)).alias("pages"))


def stale(candidates: DataFrame, version: int) -> DataFrame:
    return candidates.where(F.col("raw").isNotNull() & (F.col("version") < version))


def renormalized(candidates: DataFrame, version: int) -> DataFrame:
    """The stale candidates' raw texts normalized anew, with the label that was lifted; what is promoted from them follows by `promoted`."""
    old = stale(candidates, version).withColumn("_page", normalized_page(F.col("raw")))
    return old.select("page", F.col("_page.text").alias("text"), F.col("_page.label").alias("label"), F.lit(version).alias("version"))


def needs_ocr(pages: DataFrame, mode: str) -> DataFrame:
    """All pages, or those without text, with little of it, or of low quality."""
    if mode == "ocr_all":
        return pages
    return pages.where(F.col("text").isNull() | (F.length("text") < params.QUALITY_MIN_CHARACTERS) | ~passes(F.col("score")))


def target_pages(pages: DataFrame, done: DataFrame, first: int | None = None, last: int | None = None, force: bool = False, failed: DataFrame | None = None) -> DataFrame:
    """Pages of a range that are not done yet; all of it by force; with failed(page), only those that failed."""
    if first is not None:
        pages = pages.where(F.col("page") >= first)
    if last is not None:
        pages = pages.where(F.col("page") <= last)
    if force:
        return pages
    if failed is not None:
        return pages.join(failed.select("page"), "page", "left_semi")
    return pages.join(done.select("page"), "page", "left_anti")


def extraction_rows(raw: DataFrame) -> DataFrame:
    """raw(page, source, raw, error) as the rows to store: text, label, counts, score and status; an error makes a failed row, not a failed run."""
    made = raw.withColumn("_page", F.when(F.col("error").isNull(), normalized_page(F.coalesce("raw", F.lit("")))))
    content = F.col("_page.text")
    return made.select(
        "page", "source", "raw", content.alias("text"), F.col("_page.label").alias("label"), F.length(content).alias("chars"), word_count(content).alias("words"), quality(content).alias("score"), F.when(F.col("error").isNull(), "extracted").otherwise("failed").alias("status"), "error"
    )


def page_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key and the number of form-feed separated pages of an extracted text; an empty tail is no page."""
    return texts.select(key, F.size(F.split(F.regexp_replace(text, "\\f$", ""), "\\f")).alias("pages"))


def sampled(pages: DataFrame, group: str, k: int) -> DataFrame:
    """k pages of each group at equal steps."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    at = F.row_number().over(Window.partitionBy(group).orderBy("page"))
    step = F.floor(F.col("_total") / (k + 1))
    return pages.withColumns({"_total": n, "_at": at}).where((step > 0) & (F.col("_at") % step == 0) & (F.col("_at") <= step * k)).drop("_total", "_at")


# Kinds of passages


def line_share(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(pattern))) / F.greatest(F.size(lines), F.lit(1))


def signals(c: Column) -> Column:
    """What a kind rests on: shares of populated lines with dot leaders, with a number at the end, and with an inverted entry; lines; characters; the share of letters."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    chars = F.length(F.trim(c))
    return F.struct(
        line_share(lines, "\\.{3,}|(?:\\.\\s){3,}").alias("dot_leaders"),
        line_share(lines, "\\d+\\s*$").alias("trailing_numbers"),
        line_share(lines, "^[^,\\n]{1,30},\\s").alias("inverted"),
        F.size(lines).alias("lines"),
        chars.alias("chars"),
        F.when(chars > 0, F.length(F.regexp_replace(c, "[^\\p{L}]", "")) / chars).otherwise(0.0).alias("letters"),
    )


# The words by which kinds are told apart.
MEASURE = "(?i)(\\d+/\\d+|[½¼¾⅓⅔⅛]|\\b(dash(es)?|jigger|pony|gill|spoonful|teaspoonful|tablespoonful|wine-?glass|liqueur-?glass|pieces?|lumps?|drops?|slices?|parts?|oz|ounces?|dessert-?spoonful)\\b)"
VERBS = "(?i)\\b(shake|strain|stir|fill|pour|frappe|frappé|serve|mix|float|dress|garnish|sweeten|grate|squeeze)\\b"
ADVERTS = "(?i)\\b(post free|postage|crown 8vo|8vo|12mo|i2mo|uniform with|all booksellers|catalogue|new edition|sent on receipt|paper cover|gold cloth|cents per copy|for sale by|published by|printed by)\\b"
FRONT = "(?i)\\b(copyright|all rights reserved|entered according to act of congress|library of congress|preface|dedication|contents|printed in)\\b"
PRICED = "(?i)(\\$|£)\\s*\\d|\\b\\d+\\s*(cents?|shillings?|d\\.|s\\.)\\s*$|\\b(8vo|12mo|i2mo)\\b"


def index_like(s: Column) -> Column:
    return (s["dot_leaders"] >= 0.4) | (s["trailing_numbers"] >= 0.7) | ((s["trailing_numbers"] >= 0.5) & (s["inverted"] >= 0.3))


def chunk_kind(c: Column, score: Column, headings: Column, place: Column, english: Column) -> Column:
    """struct(kind, reason): the first rule that applies.

    headings: recipe headings in the chunk, null where there is no heading at all; place: 'before' or 'after' the body, or 'body'.
    """
    s = signals(c)
    text = F.trim(c)
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    advert = english & text.rlike(ADVERTS) & (F.size(lines) >= 3) & (F.size(F.filter(lines, lambda x: x.rlike(PRICED))) >= 2)
    low = F.coalesce(score < params.NOISE_BELOW, F.lit(False))
    rules = [
        ((s["chars"] < 12) & (s["letters"] < 0.10), F.lit("noise"), "artefact"),
        (index_like(s), F.when(place == "before", "table_of_contents").otherwise("index"), "index_entries"),
        (headings.isNotNull() & (text.rlike(MEASURE) | text.rlike(VERBS)), F.when(headings >= 3, "recipe_list").otherwise("recipe"), "heading_and_measures"),
        (advert, F.lit("advertisement"), "keyword_and_structure"),
        ((place == "before") & english & text.rlike(FRONT), F.lit("front_matter"), "before_body"),
        (place == "after", F.lit("back_matter"), "after_body"),
        (low, F.when(s["chars"] < 40, "noise").otherwise("unknown"), "low_quality"),
        (F.regexp_count(text, F.lit("[.!?]\\s")) >= 2, F.lit("prose"), "sentences"),
    ]
    out = F.struct(F.lit("unknown").alias("kind"), F.lit("unmatched").alias("reason"))
    for applies, kind, reason in reversed(rules):
        out = F.when(F.coalesce(applies, F.lit(False)), F.struct(kind.alias("kind"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def indexable(kind: Column) -> Column:
    return kind.isin("recipe", "recipe_list", "prose", "unknown")


def display_name(name: str) -> str:
    """Title case, for names in capitals alone; parts after hyphens are capitalised, what follows an apostrophe is not."""
    if not name or name != name.upper() or name == name.lower():
        return name
    return re.sub(r"[^\W\d_]+(?:['’][^\W\d_]+)?", lambda m: m[0][0].upper() + m[0][1:].lower(), name)
