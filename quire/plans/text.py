"""Text queries over synthetic pages made of part, and over documents and pages, with their SQL.

The tables' own texts have nothing to normalize, so pages with artefacts are made of part names by the same rule in Spark and SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import text as t
from quire.plans.keep import Registry
from quire.sources.tables import read

query = Registry()


def pages(spark, sf):
    """page, raw: a head with a number, two recipes, odd blanks, a cut word, a ligature, invisible characters; which of them, by page number."""
    p, k = read(spark, sf, "part"), F.col("p_partkey")
    n = F.upper("p_name")
    head = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit("\n"))).when(k % 4 == 1, F.concat(n, F.lit("  "), (k % 900).cast("string"), F.lit("\n"))).when(k % 4 == 2, "xiv\n").otherwise("")
    body = F.concat(
        (k % 50 + 1).cast("string"), F.lit(". "), F.initcap("p_name"), F.lit("\n2 oz"), F.when(k % 3 == 0, "   of\t").otherwise(" of "), F.col("p_type"), F.when(k % 5 == 0, "\r\n").otherwise("\n"),
        F.when(k % 2 == 0, "Stir brisk-\nly and strain.").otherwise("Stir briskly and strain."), F.when(k % 7 == 0, " Serve ﬁne​ly­ chilled.\n\n\n\n\nNo. 5 ").otherwise(" \n "), F.when(k % 6 == 0, "1 dash of bitters, ﬂamed.").otherwise(""),
    )
    return p.select(k.alias("page"), F.concat(head, body).alias("raw"))


PAGES = """pages AS (SELECT p_partkey AS page, CASE p_partkey % 4 WHEN 0 THEN p_partkey || chr(10) WHEN 1 THEN upper(p_name) || '  ' || (p_partkey % 900) || chr(10) WHEN 2 THEN 'xiv' || chr(10) ELSE '' END
  || (p_partkey % 50 + 1) || '. ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || chr(10) || '2 oz' || CASE WHEN p_partkey % 3 = 0 THEN '   of' || chr(9) ELSE ' of ' END || p_type
  || CASE WHEN p_partkey % 5 = 0 THEN chr(13) || chr(10) ELSE chr(10) END || CASE WHEN p_partkey % 2 = 0 THEN 'Stir brisk-' || chr(10) || 'ly and strain.' ELSE 'Stir briskly' || chr(160) || 'and strain.' END
  || CASE WHEN p_partkey % 7 = 0 THEN ' Serve ' || chr(64257) || 'ne' || chr(8203) || 'ly' || chr(173) || ' chilled.' || repeat(chr(10), 5) || 'No. 5 ' ELSE ' ' || chr(10) || ' ' END || CASE WHEN p_partkey % 6 = 0 THEN '1 dash of bitters, ' || chr(64258) || 'amed.' ELSE '' END AS raw FROM part)"""
G = "'g'"


def lig(c):
    for k, v in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("ſ", "s")):
        c = f"replace({c}, '{k}', '{v}')"
    return c


def vis(c):
    return rf"regexp_replace({c}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{{AD}}\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g')"


def spaces(c):
    return rf"regexp_replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '[\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g')"


def hyph(c):
    return rf"regexp_replace({c}, '(\p{{Ll}})-[ \t]*\n[ \t]*(\p{{Ll}})', '\1\2', 'g')"


def coll(c):
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


def page_query(name, column, sql):
    query(name, f"WITH {PAGES} SELECT page, {sql('raw')} AS text FROM pages")(lambda spark, sf: pages(spark, sf).select("page", column(F.col("raw")).alias("text")))


page_query("ligatures", t.ligatures, lig)
page_query("strip_invisible", t.visible, vis)
page_query("fold_spaces", t.plain_spaces, spaces)
page_query("hyphen_join", t.hyphens_joined, hyph)
page_query("normalize_whitespace", t.collapsed, coll)


def shouted_sql(x):
    return f"length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')) >= 3 AND length(regexp_replace({x}, '[^\\p{{Lu}}]', '', 'g')) >= 0.6 * length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g'))"


def edge_sql(x):
    """A trimmed edge line's label and what is kept of it."""
    bare = f"regexp_extract({x}, '^[\\[(]?\\s*[-—–]?\\s*(\\d{{1,4}}|[ivxlcdm]{{1,7}}|[IVXLCDM]{{1,7}})\\s*[-—–]?\\s*[\\])]?$', 1)"
    out = [f"WHEN {bare} <> '' THEN struct_pack(kept := '', label := {bare})"]
    for pattern, head, number in ((r"^(\d{1,4})\s+(\S.*)$", 2, 1), (r"^(.*\S)\s+(\d{1,4})$", 1, 2)):
        part = lambda k, p=pattern: f"regexp_extract({x}, '{p}', {k})"
        out.append(f"WHEN regexp_matches({x}, '{pattern}') AND {shouted_sql(part(head))} THEN struct_pack(kept := {part(head)}, label := {part(number)})")
    return f"CASE {' '.join(out)} ELSE struct_pack(kept := {x}, label := NULL::VARCHAR) END"


def label_ctes(c, source="pages"):
    """Common table expressions up to `lab`: the source's columns with the text without its label, and the label."""
    return rf"""b1 AS (SELECT *, string_split({c}, chr(10)) AS ls FROM {source}), b2 AS (SELECT *, list_transform(ls, lambda v: regexp_replace(v, '^\s+|\s+$', '', 'g')) AS ts FROM b1),
b3 AS (SELECT *, list_transform(ts, lambda v: v <> '') AS ps FROM b2), b4 AS (SELECT *, list_position(ps, true) AS f, len(ps) + 1 - list_position(list_reverse(ps), true) AS z FROM b3), b5 AS (SELECT *, ts[f] AS tf, ts[z] AS tz FROM b4),
b6 AS (SELECT *, {edge_sql('tf')} AS ef, {edge_sql('tz')} AS ez FROM b5),
lab AS (SELECT * EXCLUDE (ls, ts, ps, f, z, tf, tz, ef, ez), coalesce(ef.label, ez.label) AS label, array_to_string(list_transform(ls, lambda v, i: CASE WHEN i = f THEN ef.kept WHEN i = z THEN ez.kept ELSE v END), chr(10)) AS bare FROM b6)"""


PREPARED = spaces(vis(lig("nfc_normalize(raw)")))


@query("normalize_page", f"WITH {PAGES}, {label_ctes(PREPARED)} SELECT page, {coll(hyph('bare'))} AS text, label FROM lab")
def normalize_page(spark, sf):
    p = pages(spark, sf).select("page", t.normalized_page(F.col("raw")).alias("p"))
    return p.select("page", "p.text", "p.label")


COUNT = r"len(list_filter(regexp_split_to_array(trim({c}, ' '), '\s+'), lambda w: w <> ''))"
TOKENS = f"greatest(ceil(length(text) / 3.6), ceil({COUNT.format(c='text')} * 1.4)) + ceil(len(regexp_extract_all(text, '[0-9]+')) * 0.5) + ceil(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) * 0.4)"


@query("char_word_counts", f"SELECT doc_id, length(text)::INTEGER AS chars, {COUNT.format(c='text')}::INTEGER AS words FROM documents")
def char_word_counts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.length("text").alias("chars"), t.word_count(F.col("text")).alias("words"))


@query("token_estimate", f"SELECT doc_id, ({TOKENS})::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf):
    return read(spark, sf, "documents").select("doc_id", t.token_estimate(F.col("text")).cast("long").alias("tokens"))


@query("page_labels", f"WITH {PAGES}, {label_ctes('raw')} SELECT page, label FROM lab")
def page_labels(spark, sf):
    return pages(spark, sf).select("page", t.label(F.col("raw")).alias("label"))


@query("label_lift", f"WITH {PAGES}, {label_ctes('raw')} SELECT page, bare AS text FROM lab")
def label_lift(spark, sf):
    return pages(spark, sf).select("page", t.lifted(F.col("raw")).alias("text"))


NUMERALS = "[['M', '1000'], ['CM', '900'], ['D', '500'], ['CD', '400'], ['C', '100'], ['XC', '90'], ['L', '50'], ['XL', '40'], ['X', '10'], ['IX', '9'], ['V', '5'], ['IV', '4'], ['I', '1']]"


@query("roman_numerals", f"""WITH RECURSIVE n AS (SELECT p_partkey, (p_partkey % 3999 + 1)::BIGINT AS number, (p_partkey % 3999 + 1)::BIGINT AS rest, '' AS out FROM part UNION ALL
SELECT p_partkey, number, rest - (x[2])::BIGINT, out || x[1] FROM (SELECT *, list_filter({NUMERALS}, lambda v: (v[2])::BIGINT <= rest)[1] AS x FROM n WHERE rest > 0))
SELECT p_partkey, out AS numeral, CASE WHEN length(out) <= 7 THEN number END::INTEGER AS back, 0::BIGINT AS malformed FROM n WHERE rest = 0""")
def roman_numerals(spark, sf):
    number = F.col("p_partkey") % 3999 + 1
    p = read(spark, sf, "part").select("p_partkey", t.roman(number).alias("numeral"))
    wrong = F.when(t.roman_value(F.lit("IIII")).isNull() & t.roman_value(F.lit("XCX")).isNull() & t.roman_value(F.lit("")).isNull(), 0).otherwise(1)
    return p.select("p_partkey", "numeral", t.roman_value(F.col("numeral")).alias("back"), wrong.cast("long").alias("malformed"))


W = r"list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda w: regexp_matches(w, '\p{L}'))"
VOWELS = "aeiouyàáâãäåèéêëìíîïòóôõöùúûüýÿæœ"
VOW = f"length(regexp_replace(lower(p), '[^{VOWELS}]', '', 'g'))"
PART = rf"regexp_matches(p, '^[IVXLCDM]+$') OR regexp_matches(p, '^(\p{{Ll}}+|\p{{Lu}}+|\p{{Lu}}\p{{Ll}}*)$') AND (length(p) < 3 OR {VOW} > 0) AND (length(p) < 4 OR {VOW} / length(p) BETWEEN 0.10 AND 0.80) AND NOT regexp_matches(lower(p), '[^{VOWELS}]{{6,}}')"
OKAY = rf"length(w) <= 22 AND NOT regexp_matches(w, '\p{{N}}') AND len(list_filter(regexp_split_to_array(w, '[''’‘-]'), lambda p: p <> '')) > 0 AND len(list_filter(list_filter(regexp_split_to_array(w, '[''’‘-]'), lambda p: p <> ''), lambda p: NOT ({PART}))) = 0"
QUALITY = f"""w AS (SELECT doc_id, text, {W} AS ws FROM src), q AS (SELECT doc_id, text, len(ws) AS n, len(list_filter(ws, lambda w: {OKAY})) AS ok, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS total FROM w),
s AS (SELECT doc_id, text, CASE WHEN n >= 8 THEN round(0.6 * ok / n + 0.2 * least(1.0, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / greatest(length(regexp_replace(text, '\\s', '', 'g')), 1) / 0.85) + 0.2 * greatest(0.0, 1 - least(1.0, abs(total / n - 4.7) / 4)), 4) END AS score FROM q)"""
DOCS = "src AS (SELECT doc_id, text FROM documents)"


def scored(spark, sf):
    return read(spark, sf, "documents").select("doc_id", "text", t.quality(F.col("text")).alias("score"))


@query("page_quality", f"WITH {DOCS}, {QUALITY} SELECT doc_id, round(score, 3) AS score, coalesce(score >= 0.9, false) AS passes FROM s")
def page_quality(spark, sf):
    return scored(spark, sf).select("doc_id", F.round("score", 3).alias("score"), t.passes(F.col("score")).alias("passes"))


@query("quality_bands", f"WITH {DOCS}, {QUALITY} SELECT CASE WHEN score IS NULL THEN 'none' WHEN score < 0.7 THEN 'low' WHEN score < 0.9 THEN 'middle' ELSE 'high' END AS band, count(*)::BIGINT AS pages FROM s GROUP BY band")
def quality_bands(spark, sf):
    s = F.col("score")
    return scored(spark, sf).groupBy(F.when(s.isNull(), "none").when(s < 0.7, "low").when(s < 0.9, "middle").otherwise("high").alias("band")).agg(F.count(F.lit(1)).alias("pages"))


CAND = "c AS (SELECT l_partkey AS page, CASE l_linenumber % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'layer' ELSE 'manual' END AS source, CASE WHEN l_linenumber = 2 THEN ' ' ELSE l_returnflag END AS text, CASE WHEN l_quantity > 10 THEN l_discount END AS score, CASE WHEN l_linestatus = 'F' OR l_partkey % 5 = 0 THEN 'extracted' ELSE 'failed' END AS status, l_orderkey * 10 + l_linenumber AS id FROM lineitem)"


def candidates(spark, sf):
    line, n = read(spark, sf, "lineitem"), F.col("l_linenumber")
    return line.select(
        F.col("l_partkey").alias("page"), F.when(n % 3 == 0, "ocr").when(n % 3 == 1, "layer").otherwise("manual").alias("source"), F.when(n == 2, " ").otherwise(F.col("l_returnflag")).alias("text"), F.when(F.col("l_quantity") > 10, F.col("l_discount")).alias("score"),
        F.when((F.col("l_linestatus") == "F") | (F.col("l_partkey") % 5 == 0), "extracted").otherwise("failed").alias("status"), (F.col("l_orderkey") * 10 + n).alias("id"),
    )


PROMO = "WITH {c}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {p}, coalesce(score, -1.0) DESC, id) AS n FROM c WHERE status = 'extracted' AND trim(text) <> '') SELECT page, source, id FROM r WHERE n = 1"
query("promotion_argmax", PROMO.format(c=CAND, p="1::BIGINT"))(lambda spark, sf: t.promoted(candidates(spark, sf)).select("page", "source", "id"))
query("promotion_preferred", PROMO.format(c=CAND, p="CASE WHEN source = 'ocr' THEN 0 ELSE 1 END"))(lambda spark, sf: t.promoted(candidates(spark, sf), "ocr").select("page", "source", "id"))


@query("blank_exhausted", f"WITH {CAND} SELECT page FROM (SELECT page, status, CASE WHEN source = 'manual' OR score IS NULL OR page % 3 = 0 THEN '' ELSE text END AS text FROM c) GROUP BY page HAVING bool_and(status = 'extracted' AND trim(text) = '')")
def blank_exhausted(spark, sf):
    emptied = F.when((F.col("source") == "manual") | F.col("score").isNull() | (F.col("page") % 3 == 0), "").otherwise(F.col("text"))
    return t.blank_pages(candidates(spark, sf).withColumn("text", emptied))


@query("source_compare", f"WITH {CAND} SELECT source, round(avg(score), 4) AS mean_score, count(*)::BIGINT AS pages FROM c GROUP BY source")
def source_compare(spark, sf):
    return t.by_source(candidates(spark, sf))


@query("page_sample", "WITH p AS (SELECT source, doc_id AS page, count(*) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents), s AS (SELECT *, total // 6 AS step FROM p) SELECT source, page FROM s WHERE step > 0 AND place % step = 0 AND place <= 5 * step")
def page_sample(spark, sf):
    return t.sampled(read(spark, sf, "documents").select("source", F.col("doc_id").alias("page")), "source", 5)


@query("ocr_gate", f"WITH {DOCS}, {QUALITY} SELECT doc_id FROM s WHERE text IS NULL OR length(text) < 60 OR NOT coalesce(score >= 0.9, false)")
def ocr_gate(spark, sf):
    return t.needs_ocr(scored(spark, sf), "gated").select("doc_id")


@query("target_pages", "SELECT doc_id AS page FROM documents WHERE doc_id BETWEEN 100 AND 700 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def target_pages(spark, sf):
    p = read(spark, sf, "documents").select(F.col("doc_id").alias("page"))
    return t.target_pages(p, read(spark, sf, "labels").select(F.col("doc_id").alias("page")), 100, 700)


@query("renormalize_stale", f"WITH {PAGES}, {label_ctes(PREPARED)} SELECT page, {coll(hyph('bare'))} AS text, label, 3 AS version FROM lab WHERE page % 9 <> 0 AND page % 4 < 3")
def renormalize_stale(spark, sf):
    p = pages(spark, sf).select("page", F.when(F.col("page") % 9 != 0, F.col("raw")).alias("raw"), (F.col("page") % 4).cast("int").alias("version"))
    return t.renormalized(p, 3)


SHARE = "len(list_filter(ls, lambda x: regexp_matches(x, '{}'))) / greatest(len(ls), 1)"
DOTS, TRAILING, INVERTED = (SHARE.replace("{}", p) for p in (r"\.{3,}|(?:\.\s){3,}", r"\d+\s*$", r"^[^,\n]{1,30},\s"))
SIG = f"""x AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS ls, length(trim(text, ' ')) AS chars FROM src),
g AS (SELECT *, {DOTS} AS dot_leaders, {TRAILING} AS trailing_numbers, {INVERTED} AS inverted, len(ls)::INTEGER AS lines, CASE WHEN chars > 0 THEN length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / chars ELSE 0.0 END AS letters FROM x)"""
MIXED = f"{PAGES}, src AS (SELECT page AS doc_id, CASE page % 5 WHEN 0 THEN raw || chr(10) || raw || chr(10) || raw WHEN 1 THEN 'Anvil, blue ..... 5' || chr(10) || raw || chr(10) || 'Gear . . . . 17' WHEN 2 THEN 'New edition, post free:' || chr(10) || 'Gin $ 2' || chr(10) || 'Rum, 3 cents' WHEN 3 THEN CASE WHEN page % 2 = 0 THEN '~ ' ELSE 'x1 ' END || page ELSE 'All rights reserved. And more of them! None here, but ' || page END AS text FROM pages)"


def mixed(spark, sf):
    k, raw = F.col("page"), F.col("raw")
    text = (
        F.when(k % 5 == 0, F.concat_ws("\n", raw, raw, raw))
        .when(k % 5 == 1, F.concat(F.lit("Anvil, blue ..... 5\n"), raw, F.lit("\nGear . . . . 17")))
        .when(k % 5 == 2, "New edition, post free:\nGin $ 2\nRum, 3 cents")
        .when(k % 5 == 3, F.concat(F.when(k % 2 == 0, "~ ").otherwise("x1 "), k.cast("string")))
        .otherwise(F.concat(F.lit("All rights reserved. And more of them! None here, but "), k.cast("string")))
    )
    return pages(spark, sf).select(k.alias("doc_id"), text.alias("text"))


ROUNDED = ", ".join(f"round({c}, 4) AS {c}" for c in ("dot_leaders", "trailing_numbers", "inverted", "letters"))


@query("chunk_signals", f"WITH {MIXED}, {SIG} SELECT doc_id, {ROUNDED}, lines, chars::INTEGER AS chars FROM g")
def chunk_signals(spark, sf):
    g = mixed(spark, sf).select("doc_id", F.inline(F.array(t.signals(F.col("text")))))
    return g.select("doc_id", *(F.round(c, 4).alias(c) for c in ("dot_leaders", "trailing_numbers", "inverted", "letters")), "lines", "chars")


KIND = r"""k AS (SELECT *, CASE doc_id % 11 WHEN 1 THEN 'before' WHEN 2 THEN 'after' ELSE 'body' END AS place, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 6 END AS headings, doc_id % 13 <> 0 AS english, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 0.95 END AS score,
  regexp_matches(text, '(?i)(\d+/\d+|[½¼¾⅓⅔⅛]|\b(dash(es)?|jigger|pony|gill|spoonful|teaspoonful|tablespoonful|wine-?glass|liqueur-?glass|pieces?|lumps?|drops?|slices?|parts?|oz|ounces?|dessert-?spoonful)\b)') OR regexp_matches(text, '(?i)\b(shake|strain|stir|fill|pour|frappe|frappé|serve|mix|float|dress|garnish|sweeten|grate|squeeze)\b') AS made,
  regexp_matches(text, '(?i)\b(post free|postage|crown 8vo|8vo|12mo|i2mo|uniform with|all booksellers|catalogue|new edition|sent on receipt|paper cover|gold cloth|cents per copy|for sale by|published by|printed by)\b') AS advert,
  len(list_filter(ls, lambda x: regexp_matches(x, '(?i)(\$|£)\s*\d|\b\d+\s*(cents?|shillings?|d\.|s\.)\s*$|\b(8vo|12mo|i2mo)\b'))) AS priced,
  regexp_matches(text, '(?i)\b(copyright|all rights reserved|entered according to act of congress|library of congress|preface|dedication|contents|printed in)\b') AS front, len(regexp_extract_all(text, '[.!?]\s')) AS ends FROM g),
c AS (SELECT doc_id, CASE WHEN chars < 12 AND letters < 0.1 THEN 'noise/artefact' WHEN dot_leaders >= 0.4 OR trailing_numbers >= 0.7 OR trailing_numbers >= 0.5 AND inverted >= 0.3 THEN CASE WHEN place = 'before' THEN 'table_of_contents/index_entries' ELSE 'index/index_entries' END
  WHEN headings IS NOT NULL AND made THEN CASE WHEN headings >= 3 THEN 'recipe_list/heading_and_measures' ELSE 'recipe/heading_and_measures' END WHEN english AND advert AND len(ls) >= 3 AND priced >= 2 THEN 'advertisement/keyword_and_structure' WHEN place = 'before' AND english AND front THEN 'front_matter/before_body'
  WHEN place = 'after' THEN 'back_matter/after_body' WHEN score < 0.7 THEN CASE WHEN chars < 40 THEN 'noise/low_quality' ELSE 'unknown/low_quality' END WHEN ends >= 2 THEN 'prose/sentences' ELSE 'unknown/unmatched' END AS k FROM k)"""


@query("chunk_kinds", f"WITH {MIXED}, {SIG}, {KIND} SELECT doc_id, split_part(k, '/', 1) AS kind, split_part(k, '/', 2) AS reason, split_part(k, '/', 1) IN ('recipe', 'recipe_list', 'prose', 'unknown') AS indexable FROM c")
def chunk_kinds(spark, sf):
    i = F.col("doc_id")
    place = F.when(i % 11 == 1, "before").when(i % 11 == 2, "after").otherwise("body")
    k = t.chunk_kind(F.col("text"), F.when(i % 3 == 0, 0.5).otherwise(0.95), F.when(i % 7 != 0, i % 6), place, i % 13 != 0)
    found = mixed(spark, sf).select("doc_id", k.alias("k")).select("doc_id", "k.kind", "k.reason")
    return found.withColumn("indexable", t.indexable(F.col("kind")))


FOLD = "strip_accents(replace(replace(replace(regexp_replace(name, '^[\\s.,:;|*–—-]+|[\\s.,:;|*–—-]+$', '', 'g'), 'œ', 'oe'), 'ß', 'ss'), 'Ø', 'O'))"


@query("key_fold", f"WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '*The ' || p_name || '''s.' WHEN 1 THEN 'Crème de ' || p_name || ' à la Øre – Hors-d’œuvre Spaß Ñandú' ELSE p_name END AS name FROM part) SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower({FOLD}), '^(the|a|an|le|la|el|les|los|las)\\s+', ''), '[''’]s\\b', 's', 'g'), '[^a-z0-9]+', '', 'g') AS key FROM n")
def key_fold(spark, sf):
    from quire.operators.tally import folded_key

    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("*The "), "p_name", F.lit("'s."))).when(k % 3 == 1, F.concat(F.lit("Crème de "), "p_name", F.lit(" à la Øre – Hors-d’œuvre Spaß Ñandú"))).otherwise(F.col("p_name"))
    return read(spark, sf, "part").select("p_partkey", folded_key(name).alias("key"))


@query("extraction_rows", f"""WITH {PAGES}, src0 AS (SELECT page, CASE WHEN page % 8 = 0 THEN NULL ELSE raw END AS raw, CASE WHEN page % 5 = 0 THEN 'no page' END AS error FROM pages), {label_ctes(spaces(vis(lig("nfc_normalize(coalesce(raw, ''))"))), 'src0')},
src AS (SELECT page AS doc_id, {coll(hyph('bare'))} AS text FROM lab), {QUALITY}
SELECT page, 'layer' AS source, raw, CASE WHEN error IS NULL THEN s.text END AS text, CASE WHEN error IS NULL THEN label END AS label, CASE WHEN error IS NULL THEN length(s.text) END::INTEGER AS chars, CASE WHEN error IS NULL THEN {COUNT.format(c='s.text')} END::INTEGER AS words,
  CASE WHEN error IS NULL THEN round(score, 3) END AS score, CASE WHEN error IS NULL THEN 'extracted' ELSE 'failed' END AS status, error FROM lab JOIN s ON s.doc_id = lab.page""")
def extraction_rows(spark, sf):
    k = F.col("page")
    raw = pages(spark, sf).select("page", F.lit("layer").alias("source"), F.when(k % 8 != 0, F.col("raw")).alias("raw"), F.when(k % 5 == 0, "no page").alias("error"))
    return t.extraction_rows(raw).withColumn("score", F.round("score", 3))


@query("failed_pages", "SELECT doc_id AS page FROM documents WHERE doc_id <= 700 AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def failed_pages(spark, sf):
    p, labels = read(spark, sf, "documents").select(F.col("doc_id").alias("page")), read(spark, sf, "labels").select(F.col("doc_id").alias("page"), "toxic")
    return t.target_pages(p, labels, last=700, failed=labels.where("toxic = 1"))


@query("page_counts", "SELECT doc_id, (1 + doc_id % 4)::INTEGER AS pages FROM documents")
def page_counts(spark, sf):
    k = F.col("doc_id")
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.repeat(F.lit("text\f"), (k % 4 + 1).cast("int")), F.when(k % 3 == 0, "\n\f").otherwise("")).alias("text"))
    d = d.withColumn("text", F.regexp_replace("text", "\n\f$", ""))
    return t.page_counts(d, "doc_id", "text")
