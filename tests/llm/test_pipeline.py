"""The pipeline against brute force, stage by stage, and its edges."""

from __future__ import annotations

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import toxicity
from quire.llm.common import read
from quire.llm.repeats import remove_repeats
from tests.llm.test_operators import contaminated, corpus, near_groups

SF = "/root/testdata/sf0.001"


def shortened(rows, length=100):
    data = sorted((d, (t or "").encode()) for d, t in rows)
    seen, out = {}, {}
    for d, b in data:
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], (d, i))
    for d, b in data:
        cut = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] < (d, i):
                cut[i : i + length] = b"\1" * length
        at = 0
        text = b.decode()
        for c in text:
            n = len(c.encode())
            if any(cut[at : at + n]):
                cut[at : at + n] = b"\1" * n
            at += n
        out[d] = bytes(x for x, c in zip(b, cut, strict=True) if not c).decode()
    return out


def check(spark, folder):
    docs = read(spark, folder, "documents")
    columns = docs.columns
    m = toxicity.train(docs, read(spark, folder, "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = [(d, t) for d, t in texts.items() if m.score(t or "")[0] < toxicity.THRESHOLD]
    wanted = [dict(rows)]
    group = near_groups(rows, 5, 80)
    rows = [(d, t) for d, t in rows if group[d] == d]
    wanted.append(dict(rows))
    came = dict(rows)
    rows = [(d, t if came[d] else came[d]) for d, t in shortened(rows).items() if t or not came[d]]  # what came null or empty stays
    wanted.append(dict(rows))
    bad = contaminated(rows, [(r["item_id"], r["text"]) for r in read(spark, folder, "benchmark").collect()])
    rows = [(d, t) for d, t in rows if not bad[d][1]]  # no window of the benchmark is left
    wanted.append(dict(rows))
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], wanted, strict=True):
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == want, name
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == {d: sp.encode(t or "") for d, t in rows}


def test_pipeline_on_the_smallest_tables(spark):
    check(spark, SF)


def test_pipeline_with_clashing_columns(spark, tables, documents):
    rows = [(d, t) for d, t in corpus(21, 90) if "▁" not in (t or "")]
    docs = documents(rows)
    for c in ("toxicity", "items", "cut_spans", "kept", "ids", "component_id"):
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    labels = spark.createDataFrame([(d, 1, int(d % 9 == 0)) for d, _ in rows], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, rows[30][1]), (2, None)], "item_id long, text string")
    check(spark, tables(documents=docs, labels=labels, benchmark=benchmark))


def test_pipeline_of_nothing(spark, tables, documents):
    folder = tables(documents=documents([]), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_texts_that_came_null_or_empty_survive(spark, tables, documents):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, None), (3, ""), (4, text), (5, "short")]
    got = remove_repeats(spark, documents(rows), "")
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: text, 2: None, 3: "", 5: "short"}
    folder = tables(documents=documents(rows), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id long, text string"))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, folder).collect()} == {1: sp.encode(text), 2: [], 3: [], 5: sp.encode("short")}
