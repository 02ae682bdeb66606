"""Operators whose order of work SQL can't express, and edges."""

from __future__ import annotations

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import catalog, chunking, retrieval, structure, tally, text
from quire.sources import files
from quire.streaming import tally as stream


def test_pages_join_as_their_ends_say():
    got, spans = chunking.assemble([(1, "a cock-"), (2, "tail, é"), (3, "next"), (4, "End."), (5, "New")])
    assert got == "a cocktail, é next\n\nEnd.\n\nNew" or got == "a cocktail, é next End.\n\nNew"
    data = got.encode()
    assert data[spans[1][1] : spans[1][2]].decode() == "tail, é"
    assert [p for p, _, _ in spans] == [1, 2, 3, 4, 5]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcé .\n-XY1", max_size=400), min_size=1, max_size=6))
def test_packing_loses_nothing(pages):
    got, _ = chunking.assemble(list(enumerate(pages)))
    spans = chunking.packed(got)
    assert "".join("".join(got[a:z].split()) for a, z in spans) == "".join(got.split())
    assert all(z > a for a, z in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_long_words_are_cut_hard():
    stream_ = "x" * 5000
    spans = chunking.packed(stream_)
    assert all(chunking.fits(stream_[a:z]) for a, z in spans) and spans[-1][1] == 5000


def test_clusters_take_the_most_frequent_spelling(spark):
    rows = [(1, 1, "Gin Drinks"), (1, 2, "Gin Drinks"), (1, 3, "Gin Drlnks"), (1, 4, "Rum Punch")]
    got = {r["page"]: r["cluster"] for r in chunking.clusters(spark.createDataFrame(rows, "book long, page long, head string")).collect()}
    assert got == {1: "gin drinks", 2: "gin drinks", 3: "gin drinks", 4: "rum punch"}


def test_headings_have_byte_offsets():
    page = "é\n12. Gin Fizz.\n2 oz gin\nWHISKEY SOUR\nOne glass of whiskey\nJUST SHOUTING\nand no recipe"
    found = list(chunking.found_headings(page))
    assert [(f, n) for f, n, _, _ in found] == [("numbered", "Gin Fizz"), ("caps_line", "WHISKEY SOUR")]
    for _, name, _, at in found:
        assert page.encode()[at:].startswith(name.encode())


def test_display_names():
    assert text.display_name("LADY'S-CUP No") == "LADY'S-CUP No"
    assert text.display_name("LADY'S-CUP") == "Lady's-Cup"
    assert text.display_name("") == ""


def test_parse_never_fails():
    for q in ("", '"', "-", '-"a b" or', "OR OR", "(((", 'x -"y'):
        retrieval.parse(q)
    assert retrieval.parse('gin "old tom" -rum OR vodka').any_of == ((("gin",), ("old", "tom")), (("vodka",),))


def test_cosine_without_norm_never_matches(spark):
    c = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [1.0])], "id long, vector array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query long, vector array<double>")
    assert [(r["id"], r["similarity"]) for r in retrieval.dense(c, q, 5).collect()] == [(2, 1.0)]


def test_many_queries_meet_the_corpus_in_cells(spark):
    rows = [(i, [float((i * k) % 7 - 3) for k in range(1, 5)]) for i in range(60)] + [(60, None), (61, [1.0])]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = corpus.where("id % 5 = 0").withColumnRenamed("id", "query")
    columns = ["query", "id", "similarity", "rank"]
    few, many = (sorted(map(tuple, retrieval.dense(corpus, queries, 4, sent_bytes=n).select(columns).collect())) for n in (1 << 20, 100))
    assert few == many and few
    assert "WindowGroupLimit" in retrieval.dense(corpus, queries, 4)._jdf.queryExecution().toString()


def test_nearest_rows_are_those_of_all_pairs(spark):
    import numpy as np

    g = np.random.default_rng(5)
    x = g.standard_normal((150, 6)).astype("float32").astype(float)
    x[10:40], x[40], x[41:44] = x[1], 0, x[2] * 2
    odd = [[float("nan")] * 6, [float("inf")] + [1.0] * 5, [1e-170] * 6, [1e170] * 6, [1e-120, 0.0] * 3, [], None, [1.0, None, 1.0, 1.0, 1.0, 1.0], [3.0], [-2.0]]
    rows = [(i if i != 20 else None, v) for i, v in enumerate(x.tolist() + odd)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    queries = corpus.where("id % 3 = 0 or id > 140").withColumnRenamed("id", "query")
    pairs = corpus.crossJoin(queries.withColumnRenamed("vector", "_q")).select("query", "id", retrieval.cosine(F.col("vector"), F.col("_q")).alias("similarity")).where("similarity >= -0.5")
    order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id")
    want = pairs.withColumn("rank", F.row_number().over(order)).where("rank <= 7")
    said = lambda df: sorted(repr(tuple(r)) for r in df.select("query", "id", "similarity", "rank").collect())
    for n in (1 << 20, 500):
        got = retrieval.dense(corpus, queries, 7, -0.5, n)
        assert said(got) == said(want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "InArrow" in plan  # no row for each pair
    assert retrieval.dense(corpus, queries.limit(0), 7).count() == retrieval.dense(corpus.limit(0), queries, 7).count() == 0


def test_blank_question_asks_nothing(spark):
    assert retrieval.hybrid(spark.range(1), spark.range(1), "  ", spark.range(1), None, {}).count() == 0


def test_nulls_in_rankings(spark):
    m = spark.createDataFrame([(1, 1, None, "a", 1, 1), (2, 1, 1900, "a", 2, 1), (2, 2, 0, "b", 3, 1)], "entity long, book long, year int, spelling string, m1 long, m2 int")
    e = spark.createDataFrame([(1, "one", "one"), (2, "two", "two")], "entity long, name string, key string")
    assert [r["entity"] for r in tally.survey(m, e, "earliest").collect()] == [2, 1]
    assert [r["entity"] for r in tally.survey(m, e, "latest").collect()] == [1, 2]
    assert [r["entity"] for r in tally.survey(m, e, "books", first=1800).collect()] == [2]
    assert tally.carrying_set(m.limit(0)).first()["carrying"] == 0


def test_fuzzy_pairs_against_all_pairs(spark):
    words = ["whiskey", "whisky1", "whiskez", "bourbon", "bourbo", "burbon", "sherry", "cherry", "sherrys", "martini", "martinez", "xmartini"]
    df = spark.createDataFrame([(w,) for w in words], "key string")
    want = {(a, b) for a in words for b in words if a < b and len(a) >= 6 and len(b) >= 6 and chunking.distance_within(a, b, 2)}
    assert {(r["key"], r["other"]) for r in structure.fuzzy_pairs(df, 2).collect()} == want


def test_upsert_is_idempotent(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, name string")
    n = {r["status"]: r["n"] for r in catalog.changes(a, a, "id", ["name"]).collect()}
    assert n == {"created": 0, "updated": 0, "unchanged": 2, "deleted": 0}
    assert catalog.stages_until_failure(spark, [("a", lambda s: 1), ("b", lambda s: 1 / 0), ("c", lambda s: 1)]) == [("a", "ok"), ("b", "division by zero")]


def test_sources(spark, tmp_path):
    (tmp_path / "b10.pdf").write_bytes(b"one")
    (tmp_path / "B9.pdf").write_bytes(b"two")
    (tmp_path / "no.txt").write_bytes(b"x")
    assert [r["name"] for r in files.natural_order(files.scan(spark, str(tmp_path)), "name").collect()] == ["B9.pdf", "b10.pdf"]
    t = spark.createDataFrame([(1, "a\fb\f", 2)], "id long, text string, n int")
    assert [(r["page"], r["text"]) for r in files.split_pages(t, "id", "text", "n").orderBy("page").collect()] == [(1, "a"), (2, "b")]
    for n, rows in (("x", [{"a": 1}]), ("y", [{"a": 2}, {"a": 3}])):
        (tmp_path / f"{n}.json").write_text(json.dumps(rows))
    import hashlib

    want = hashlib.sha256((tmp_path / "y.json").read_bytes() + (tmp_path / "x.json").read_bytes()).hexdigest()
    assert files.export_checksum(spark, str(tmp_path), ["y", "x"]) == want
    assert files.count_mismatches({"x": 1, "y": 2}, {"x": 1, "y": 3}) == {"y": (2, 3)}
    d = spark.createDataFrame([(1, "a"), (2, "b")], "book long, v string")
    files.replace_groups(d, str(tmp_path / "out"), "book")
    files.replace_groups(d.where("book = 1").withColumn("v", F.lit("c")), str(tmp_path / "out"), "book")
    assert {(r["book"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "c"), (2, "b")}


def test_streamed_tally_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(str(tmp_path / f"in/p={k}"))
    source = stream.event_stream(spark, str(tmp_path / "in/*"), events.schema)
    got = stream.run_available(stream.windowed_tally(source, "event_type", "ts", "1 day", "60 days"), "tally_test", str(tmp_path / "cp"), "complete")
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_aliases_keep_all_spellings(spark):
    mentions = spark.range(1500).select(F.lit(1).alias("entity"), F.format_string("s%04d", "id").alias("spelling"), F.col("id").alias("m1"), F.lit(0).alias("m2"))
    one = mentions.limit(1).select(F.lit(2).alias("entity"), "spelling", "m1", "m2")
    got = {r["entity"]: (r["canonical"], r["others"]) for r in tally.aliases(mentions.unionByName(one)).collect()}
    assert got == {1: ("s0000", [f"s{i:04d}" for i in range(1, 1500)]), 2: ("s0000", [])}


def column(spark, make, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_keys_are_ascii(spark):
    got = column(spark, tally.folded_key, "Crème de Menthe", "128. Gin Sangaree.", "GIN SANGAREE", "The Bishop’s", "Bishops", "Crème", "L'Été", "El Diablo", "Spaß & Œuf – Ærø", "—", "")
    assert got == ["cremedementhe", "128ginsangaree", "ginsangaree", "bishops", "bishops", "creme", "lete", "diablo", "spassoeufaero", "", ""]
    from quire.operators import facets

    assert column(spark, facets.words, "Crème de Menthe", "São Paulo!") == [["creme", "de", "menthe"], ["sao", "paulo"]]


def test_labels_are_lifted_inside_the_normalization(spark):
    pages = ["42\nBody text.", "Body text.\n- xiv -", "26      ROCHESTER PUNCH.\n2 dashes of bitters", "Recipe\nMODERN AMERICAN DRINKS.      39", "2 dashes of bitters\nand ice 7", "[ 108 ]\nx\n9", "", "  \n\n", "12"]
    got = column(spark, text.normalized_page, *pages)
    assert [(p["text"], p["label"]) for p in got] == [
        ("Body text.", "42"), ("Body text.", "xiv"), ("ROCHESTER PUNCH.\n2 dashes of bitters", "26"), ("Recipe\nMODERN AMERICAN DRINKS.", "39"), ("2 dashes of bitters\nand ice 7", None), ("x", "108"), ("", None), ("", None), ("", "12"),
    ]
    assert column(spark, text.normalized, "Punch-\nBowl a cur- \n tain ﬁſh") == ["Punch-\nBowl a curtain fish"]


def test_hashes_of_rows_with_separators_differ(spark):
    rows = spark.createDataFrame([("x|=y", "z"), ("x", "y|=z"), ("1:x", ""), ("1:x", None), ("", "1:x"), (None, "~")], "a string, b string")
    assert rows.select(catalog.record_hash("a", "b").alias("h")).distinct().count() == 6


def test_what_must_not_be_stops_the_query(spark):
    import pytest

    from quire.operators import house

    long = spark.createDataFrame([("a", "x" * 1600), ("b", "x" * 1601)], "id string, text string")
    assert house.within_ceiling(long.where("id = 'a'"), "id").count() == 1
    with pytest.raises(Exception, match="passage of b"):
        house.within_ceiling(long, "id").collect()
    facts, known = spark.createDataFrame([(1,), (None,), (3,)], "k int"), spark.createDataFrame([(1,), (1,)], "k int")
    assert house.checked_references(facts.where("k is null or k = 1"), "k", known, "k").count() == 2
    with pytest.raises(Exception, match="points to nothing: 3"):
        house.checked_references(facts, "k", known, "k").collect()
    chunks = spark.createDataFrame([(1, 0, "x", 10), (1, 1, "x", 10_000)], "book long, chunk int, text string, tokens int")
    with pytest.raises(Exception, match="chunk 1 of book 1"):
        chunking.within_ceilings(chunks).collect()


def test_only_changed_files_are_hashed(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.pdf").write_text(n)
    known = spark.createDataFrame(files.scan(spark, str(tmp_path)).withColumn("checksum", F.concat(F.lit("kept "), "name")).collect())
    (tmp_path / "b.pdf").write_text("longer")
    (tmp_path / "d.pdf").write_text("d")
    got = {r["name"]: r["checksum"] for r in files.scan_changed(spark, str(tmp_path), known).collect()}
    want = {r["name"]: r["checksum"] for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "kept a.pdf", "b.pdf": want["b.pdf"], "c.pdf": "kept c.pdf", "d.pdf": want["d.pdf"]}


def test_forced_strategies(spark):
    pages = spark.createDataFrame([("a", "x", 3), ("b", "x", 0)], "book string, text string, headings int")
    assert {r["book"]: r["strategy"] for r in structure.heading_density(pages, "book", {"b": "headings"}).collect()} == {"a": "headings", "b": "headings"}


def test_numbering_edges(spark):
    seen = spark.createDataFrame([(1, 1, "ii"), (1, 2, "iii"), (1, 5, "1"), (1, 6, "2"), (1, 7, "9"), (1, 8, "4"), (1, 9, "5"), (1, 40, "30")], "book long, page long, label string")
    numbered = structure.numbering(seen)
    pages = spark.range(1, 30).selectExpr("1L AS book", "id AS page")
    got = {r["page"]: (r["label"], r["estimated"]) for r in structure.printed_labels(pages, seen, numbered).collect()}
    assert got[1] == ("ii", False) and got[3] == ("iv", True) and got[5] == ("1", False) and got[7] == ("3", True) and got[9] == ("5", False) and got[19] == ("15", True) and got[20] == (None, None)
