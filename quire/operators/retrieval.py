"""Dense and lexical retrieval, fused by rank.

Dense: exact cosine over an array column, a block of questions at a time; vectors without a norm never match. Lexical: own tokens (Unicode lower case,
split at what is no letter or digit, short words that carry nothing left out, common English endings cut), all words
required, phrases, exclusions, fields of different weight. Fusion is by rank alone, so the channels' scores need no common scale.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.params import RRF_K, Corpus

# Words that carry nothing, endings that are cut, weights of the field classes.
STOP = "a an and are as at be but by for from in is it of on or that the this to was with".split()
ENDING = "(ing|ed|es|s)$"
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}

#: Bytes of question vectors that are broadcast, at most.
SENT_BYTES = 32 << 20
#: Rows of the corpus in a cell, at most about; queries that are compared at a time.
ROWS_A_CELL, QUERIES_AT_ONCE = 8192, 128
#: More than what rounding may change in the inner product of unit vectors.
SLACK = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no norm or the widths differ."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def summed(products: Iterator[np.ndarray], n: int) -> np.ndarray:
    """The sum in order, as `dot` adds up."""
    out = np.zeros(n)
    for p in products:
        out = out + p
    return out


class Vectors:
    """Vectors of one width: x, their norms, and unit vectors of those whose norm is neither lost nor infinite (plain)."""

    def __init__(self, x: np.ndarray):
        self.x = x
        with np.errstate(all="ignore"):
            squares = summed((x[:, j] * x[:, j] for j in range(x.shape[1])), len(x))
            self.norm = np.sqrt(squares)
            self.plain = (squares > 1e-200) & (squares < 1e200)
            self.unit = np.where(self.plain[:, None], x / np.where(self.plain, self.norm, 1.0)[:, None], 0.0)


def similarities(a: Vectors, i: np.ndarray, b: Vectors, j: np.ndarray) -> np.ndarray:
    """What `cosine` gives for rows i of a and j of b, to the last bit; -2 for its null."""
    with np.errstate(all="ignore"):
        size = a.norm[i] * b.norm[j]
        out = summed((a.x[i, d] * b.x[j, d] for d in range(a.x.shape[1])), len(i)) / size
    return np.where((size > 0) | np.isnan(size), out, -2.0)


def nearest(c: Vectors, q: Vectors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, rows of c and similarities of the k rows of c that are nearest to each of q, ties to the earlier row; NaN is largest.

    One matrix product tells which rows may be among them, ties included; those are scored like `cosine`.
    """
    found = []
    for at in range(0, len(q.x), QUERIES_AT_ONCE):
        some = slice(at, at + QUERIES_AT_ONCE)
        about = q.unit[some] @ c.unit.T
        about[:, ~c.plain] = -np.inf
        if about.shape[1] > k:
            may = about >= np.partition(about, about.shape[1] - k, axis=1)[:, -k, None] - SLACK
        else:
            may = np.ones(about.shape, bool)
        may[:, ~c.plain] = True
        may[~q.plain[some]] = True
        i, j = np.nonzero(may)
        sim = similarities(c, j, q, i + at)
        order = np.lexsort((j, -sim, ~np.isnan(sim), i))
        i, j, sim = i[order], j[order], sim[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((i[first] + at, j[first], sim[first]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def by_width(keys: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, pa.Array, Vectors]]:
    """Width, keys and vectors of rows of each width, by key."""
    order = pc.array_sort_indices(keys, null_placement="at_start")
    keys, vectors = keys.take(order), vectors.take(order)
    widths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for w in np.unique(widths):
        at = pa.array(np.flatnonzero(widths == w))
        yield int(w), keys.take(at), Vectors(vectors.take(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, w))


def whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def search(corpus: pa.Table, queries: list[tuple[int, pa.Array, Vectors]], k: int) -> Iterator[pa.RecordBatch]:
    """query, id and similarity of each query's k nearest rows of corpus(id, vector) of its width."""
    rows = {w: (ids, c) for w, ids, c in by_width(whole(corpus["id"]), whole(corpus["vector"]))}
    for w, keys, q in queries:
        if w in rows:
            ids, c = rows[w]
            i, j, sim = nearest(c, q, k)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(i)), ids.take(pa.array(j)), pa.array(sim)], ["query", "id", "similarity"])


def dense(corpus: DataFrame, queries: DataFrame, k: int, min_similarity: float = -1.0, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """query, id, similarity, rank of each query's nearest rows. corpus: id, vector. queries: query, vector.

    Queries of at most `sent_bytes` go to every executor; more are dealt into blocks of about as much, which meet the
    corpus in cells: a row once for each block, a query once for each part of the corpus. A task gives its k best of a
    query before rows are shuffled by query.
    """
    spark, v = corpus.sparkSession, F.col("vector")
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull())  # the others are like nothing
    c = corpus.where(usable).select("id", v.cast("array<double>").alias("vector"))
    q = queries.where(usable).select("query", v.cast("array<double>").alias("vector"))
    asked, size = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector").cast("long") * 8 + 16), F.lit(0))).first()
    schema = T.StructType([T.StructField("query", q.schema["query"].dataType), T.StructField("id", c.schema["id"].dataType), T.StructField("similarity", T.DoubleType())])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if size <= sent_bytes:
        if asked > QUERIES_AT_ONCE // 8:  # a small file is one task's, but its pairs are many
            c = c.repartition(parts, "id")
        table = q.toArrow()
        sent = spark.sparkContext.broadcast((whole(table["query"]), whole(table["vector"])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = list(by_width(*sent.value))
            for b in batches:
                yield from search(pa.Table.from_batches([b]), block, k)

        near = c.mapInArrow(run, schema)
    else:
        blocks, parts = -(-size // sent_bytes), max(parts, -(-c.count() // ROWS_A_CELL))
        c = c.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("_part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("_block"))
        q = q.select("query", "vector", F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")).alias("_part"))

        def meet(rows: pa.Table, block: pa.Table) -> pa.Table:
            found = search(rows, by_width(whole(block["query"]), whole(block["vector"])), k) if rows.num_rows and block.num_rows else ()
            return pa.Table.from_batches(found, to_arrow_schema(schema))

        near = c.groupBy("_block", "_part").cogroup(q.groupBy("_block", "_part")).applyInArrow(meet, schema)
    order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id")
    return near.where((F.col("similarity") >= min_similarity) & (F.col("similarity") > -2)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def tokens(text: Column) -> Column:
    """The lexemes of a text in order."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(STOP))
    return F.transform(words, lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, ENDING, "")).otherwise(w))


@dataclass(frozen=True)
class Asked:
    """A parsed question: alternatives of required phrases (a word is a phrase of one), and phrases that must not occur."""

    any_of: tuple[tuple[tuple[str, ...], ...], ...]
    none_of: tuple[tuple[str, ...], ...]


def stem(word: str) -> str:
    return re.sub(ENDING, "", word) if len(word) > 4 else word


def parse(question: str) -> Asked:
    """Words, "phrases", -exclusions and OR; anything else is punctuation. It never fails."""
    groups, current, none = [], [], []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', question):
        if not minus and word == "OR" or word == "or":
            groups.append(tuple(current))
            current = []
            continue
        found = tuple(stem(w) for w in re.split(r"[\W_]+", (phrase or word).lower()) if w and w not in STOP)
        if found:
            (none if minus else current).append(found)
    groups.append(tuple(current))
    return Asked(tuple(g for g in groups if g), tuple(none))


def holds(lexemes: Column, phrase: tuple[str, ...]) -> Column:
    if len(phrase) == 1:
        return F.array_contains(lexemes, phrase[0])
    return F.concat(F.lit(" "), F.array_join(lexemes, " "), F.lit(" ")).contains(f" {' '.join(phrase)} ")


def matches(lexemes: Column, asked: Asked) -> Column:
    if not asked.any_of:
        return F.lit(False)
    every = lambda group: F.lit(True) if not group else holds(lexemes, group[0]) & every(group[1:])
    out = F.lit(False)
    for g in asked.any_of:
        out = out | every(g)
    for p in asked.none_of:
        out = out & ~holds(lexemes, p)
    return out


def frequency(lexemes: str, word: str) -> Column:
    return F.size(F.filter(lexemes, lambda x: x == word))


def lexical(docs: DataFrame, question: str, k: int, fields: dict[str, str]) -> DataFrame:
    """id, score, rank of the documents that match. fields: column to class (A, B or C); a missing field counts as empty.

    A word's share in a field of weight w is w * tf / (tf + 1); the sum s over words and fields becomes s / (s + 1).
    """
    asked = parse(question)
    docs = docs.select("id", *(tokens(F.coalesce(c, F.lit(""))).alias(c) for c in fields))
    everything = F.concat(*fields)
    words = dict.fromkeys(w for g in asked.any_of for p in g for w in p)
    total = F.lit(0.0)
    for w in words:
        for c, kind in fields.items():
            tf = frequency(c, w)
            total = total + F.lit(WEIGHTS[kind]) * tf / (tf + 1)
    found = docs.where(matches(everything, asked)).select("id", (total / (total + 1)).alias("score"))
    order = Window.orderBy(F.round("score", 9).desc(), "id")
    # The limit comes first, so that only k rows meet in one task.
    return found.orderBy(F.round("score", 9).desc(), "id").limit(k).withColumn("rank", F.row_number().over(order))


def fuse(channels: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """id, score and each channel's rank: the sum of weight / (k + rank), best first, ties to the smaller id."""
    weights = weights or {}
    union = None
    for name, df in channels.items():
        rows = df.select("id", F.lit(name).alias("channel"), "rank", (F.lit(weights.get(name, 1.0)) / (F.lit(k) + F.col("rank"))).alias("part"))
        union = rows if union is None else union.unionByName(rows)
    ranks = [F.max(F.when(F.col("channel") == n, F.col("rank"))).alias(f"{n}_rank") for n in channels]
    return union.groupBy("id").agg(F.round(F.sum("part"), 9).alias("score"), *ranks)


def best(fused: DataFrame, limit: int) -> DataFrame:
    return fused.orderBy(F.col("score").desc(), "id").limit(limit)


def hybrid(docs: DataFrame, vectors: DataFrame, question: str, query_vector: DataFrame, corpus: Corpus, fields: dict[str, str]) -> DataFrame:
    """Both channels over the rows that have a text and a vector. A blank question gives nothing and asks nothing."""
    if not question.strip():
        return docs.sparkSession.createDataFrame([], "id long, score double, dense_rank int, lexical_rank int")
    both = docs.join(vectors.select("id"), "id", "left_semi")
    near = dense(vectors.join(docs.select("id"), "id", "left_semi"), query_vector, corpus.candidates, corpus.min_similarity).select("id", "rank")
    return best(fuse({"dense": near, "lexical": lexical(both, question, corpus.candidates, fields)}, corpus.weights, corpus.k), corpus.limit)


Scorer = Callable[[str, list[str]], list[float]]


def rerank(fused: DataFrame, texts: DataFrame, question: str, scorer: Scorer | None, candidates: int, limit: int) -> DataFrame:
    """The fused order, or the scorer's for the first `candidates`; where the scorer fails, the fused order stays."""
    top = best(fused, candidates).join(texts, "id")
    if scorer is None:
        return best(fused, limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                found = scorer(question, pdf["text"].tolist())
                if len(found) != len(pdf):
                    raise ValueError("a score for each passage is needed")
            except Exception:  # noqa: BLE001  any failure of the model leaves the order as it was
                found = [None] * len(pdf)
            yield pd.DataFrame({"id": pdf["id"], "score": pdf["score"], "rerank": pd.array(found, "Float64")})

    scored = top.select("id", "score", "text").repartition(1).mapInPandas(run, "id long, score double, rerank double")  # at most `candidates` rows
    return scored.orderBy(F.col("rerank").desc_nulls_last(), F.col("score").desc(), "id").limit(limit)


def passage(title: Column, year: Column, section: Column, heading: Column, text: Column) -> Column:
    """'Title (Year) — section — heading', a blank line, the text; what is empty is left out."""
    gone = lambda c: F.when(F.trim(c) != "", c)
    named = F.when(year.isNotNull(), F.concat(title, F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(title)
    return F.concat(F.concat_ws(" — ", named, gone(section), gone(heading)), F.lit("\n\n"), text)


def page_span(first: Column, last: Column, mark: Column) -> Column:
    return F.when(first == last, F.concat(mark, first.cast("string"))).otherwise(F.concat(mark, first.cast("string"), F.lit("–"), mark, last.cast("string")))


def citation(title: Column, year: Column, section: Column, printed_from: Column, printed_to: Column, estimated: Column, page_from: Column, page_to: Column) -> Column:
    """'Title (Year), "Section", pp. ~a–~b (PDF pp. c–d)'. A missing printed side takes the other's number; none leaves the file's pages."""
    a, b = F.coalesce(printed_from, printed_to), F.coalesce(printed_to, printed_from)
    p = lambda x, y: F.when(x == y, F.lit("p. ")).otherwise(F.lit("pp. "))
    mark = F.when(estimated, "~").otherwise("")
    physical = F.concat(F.lit("PDF "), p(page_from, page_to), page_span(page_from, page_to, F.lit("")))
    pages = F.when(a.isNull(), physical).otherwise(F.concat(p(a, b), page_span(a, b, mark), F.lit(" ("), physical, F.lit(")")))
    named = F.when(year.isNotNull(), F.concat(title, F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(title)
    return F.concat_ws(", ", named, F.when(F.trim(section) != "", F.concat(F.lit('"'), section, F.lit('"'))), pages)


def pending(chunks: DataFrame, model: str, width: int, version: int) -> DataFrame:
    """Indexable rows whose vector is missing or comes from another model, width, version or text."""
    return chunks.where(
        F.col("indexable") & (F.col("vector").isNull() | ~F.col("model").eqNullSafe(F.lit(model)) | ~F.size("vector").eqNullSafe(F.lit(width)) | (F.coalesce("version", F.lit(-1)) < version) | ~F.col("embedded_hash").eqNullSafe(F.col("content_hash")))
    )


def embed(texts: DataFrame, width: int, embedder: Callable[[list[str], int], list[list[float]]], batch: int) -> DataFrame:
    """id and vector, `batch` texts a call; a wrong count or width is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                some = pdf.iloc[at : at + batch]
                got = embedder(some["text"].fillna("").tolist(), width)
                if len(got) != len(some) or any(len(v) != width for v in got):
                    raise ValueError("the embedder gave vectors of another number or width")
                yield pd.DataFrame({"id": some["id"].to_numpy(), "vector": got})

    return texts.select("id", "text").mapInPandas(run, "id long, vector array<double>")


def hash_embedder(texts: list[str], width: int) -> list[list[float]]:
    """A stand-in for a model: signed counts of word hashes, of length 1."""
    import zlib

    out = []
    for t in texts:
        v = [0.0] * width
        for w in re.findall(r"\w+", t.lower()):
            h = zlib.crc32(w.encode())
            v[h % width] += 1.0 if h >> 31 else -1.0
        size = sum(x * x for x in v) ** 0.5
        out.append([x / size for x in v] if size else v)
    return out


def vector_checks(chunks: DataFrame, model: str, width: int) -> DataFrame:
    """One row of counts that are all 0 in a sound corpus."""
    has = F.col("vector").isNotNull()
    return chunks.agg(
        F.count_if(F.col("indexable") & ~has).alias("unembedded"),
        F.count_if(~F.col("indexable") & has).alias("excluded_but_embedded"),
        F.count_if(has & ~F.col("model").eqNullSafe(F.lit(model))).alias("other_model"),
        F.count_if(has & (F.size("vector") != width)).alias("other_width"),
        F.count_if(has & (norm(F.col("vector")) == 0)).alias("no_norm"),
    )
