"""Retrieval queries over embeddings and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import retrieval as r
from quire.params import BOOKS, EMBED_BATCH, Corpus
from quire.plans.keep import Registry
from quire.sources.tables import read

query = Registry()
WIDTH = 64


def vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def asked(spark, sf, condition="id = 0"):
    return vectors(spark, sf).where(condition).select(F.col("id").alias("query"), "vector")


def docs(spark, sf):
    d = read(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("heading"), F.col("source").alias("section"), "text")


V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings)"
NEAR = "s AS (SELECT q.id AS query, v.id, list_cosine_similarity(q.e, v.e) AS similarity FROM v q JOIN v ON len(q.e) = len(v.e) WHERE {q}), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id)::INTEGER AS rank FROM s WHERE similarity >= {least})"


def near_sql(q: str, k: int, least: float) -> str:
    return f"WITH {V}, {NEAR.format(q=q, least=least)} SELECT query, id, round(similarity, 4) AS similarity, rank FROM n WHERE rank <= {k}"


def rounded(df):
    return df.withColumn("similarity", F.round("similarity", 4))


query("dense_topk", near_sql("q.id = 0", 60, -1))(lambda spark, sf: rounded(r.dense(vectors(spark, sf), asked(spark, sf), 60)))
query("dense_min_similarity", near_sql("q.id = 0", 60, 0.3))(lambda spark, sf: rounded(r.dense(vectors(spark, sf), asked(spark, sf), BOOKS.candidates, BOOKS.min_similarity)))
query("dense_batch_knn", near_sql("q.id % 50 = 0", 5, -1))(lambda spark, sf: rounded(r.dense(vectors(spark, sf), asked(spark, sf, "id % 50 = 0"), 5)))

STOP = ", ".join(f"'{w}'" for w in r.STOP)


def lex(c: str) -> str:
    return rf"list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '' AND w NOT IN ({STOP})), lambda w: CASE WHEN length(w) > 4 THEN regexp_replace(w, '(ing|ed|es|s)$', '') ELSE w END)"


FIELDS = {"heading": "A", "section": "B", "text": "C"}
D = f"d AS (SELECT doc_id AS id, {lex('split_part(text, chr(10), 1)')} AS heading, {lex('source')} AS section, {lex('text')} AS text FROM documents)"


def score_sql(words: list[str]) -> str:
    parts = [f"{r.WEIGHTS[k]} * len(list_filter({c}, lambda x: x = '{w}')) / (len(list_filter({c}, lambda x: x = '{w}')) + 1.0)" for w in words for c, k in FIELDS.items()]
    return " + ".join(parts)


def lexical_sql(where: str, words: list[str], k: int) -> str:
    return f"""WITH {D}, a AS (SELECT *, heading || section || text AS every FROM d), h AS (SELECT id, {score_sql(words)} AS t FROM a WHERE {where}),
l AS (SELECT id, round(t / (t + 1), 9) AS score, row_number() OVER (ORDER BY round(t / (t + 1), 9) DESC, id)::INTEGER AS rank FROM h)"""


def _lexical(question: str, k: int = 60):
    return lambda spark, sf: r.lexical(docs(spark, sf), question, k, FIELDS).select("id", F.round("score", 9).alias("score"), "rank")


HAS = "list_contains(every, '{}')"
OUT = " SELECT id, score, rank FROM l WHERE rank <= 60"
query("lexical_match", lexical_sql(f"{HAS.format('then')} AND {HAS.format('than')}", ["then", "than"], 60) + OUT)(_lexical("then than"))
query("lexical_phrase", lexical_sql("contains(' ' || array_to_string(every, ' ') || ' ', ' anea eriner ')", ["anea", "eriner"], 60) + OUT)(_lexical('"anea eriner"'))
query("lexical_exclude", lexical_sql(f"{HAS.format('then')} AND NOT {HAS.format('than')}", ["then"], 60) + OUT)(_lexical("then -than"))
query("lexical_or", lexical_sql(f"({HAS.format('anea')} OR {HAS.format('der')} AND {HAS.format('die')})", ["anea", "der", "die"], 60) + OUT)(_lexical('anea OR der die (")'))


@query("lexical_blank", "SELECT 0::BIGINT AS found")
def lexical_blank(spark, sf):
    return r.lexical(docs(spark, sf), ' - "" the ', 10, FIELDS).agg(F.count(F.lit(1)).alias("found"))


LEX = lexical_sql(f"{HAS.format('then')}", ["then"], 60)
FUSE = LEX.replace("WITH ", f"WITH {V}, {NEAR.format(q='q.id = 0', least='{least}')}, ", 1)


def fuse_sql(least: float, wd: float, wl: float, limit: str = "", only: str = "") -> str:
    both = FUSE.replace("{least}", str(least)).replace("q.id = 0", f"q.id = 0 AND {only.replace('id IN (SELECT vec_id FROM embeddings)', 'v.id IN (SELECT doc_id FROM documents)')}" if only else "q.id = 0").replace("FROM a WHERE ", f"FROM a WHERE {only} AND " if only else "FROM a WHERE ")
    return both + f""", c AS (SELECT id, rank AS dr, NULL::INTEGER AS lr, {wd} / (60 + rank) AS p FROM n WHERE rank <= 60 UNION ALL SELECT id, NULL, rank, {wl} / (60 + rank) FROM l WHERE rank <= 60)
SELECT id, round(sum(p), 9) AS score, max(dr) AS dense_rank, max(lr) AS lexical_rank FROM c GROUP BY id {limit}"""


def channels(spark, sf):
    return {"dense": r.dense(vectors(spark, sf), asked(spark, sf), 60).select("id", "rank"), "lexical": r.lexical(docs(spark, sf), "then", 60, FIELDS)}


query("rrf_fuse", fuse_sql(-1, 1.0, 1.0))(lambda spark, sf: r.fuse(channels(spark, sf)))
query("rrf_weighted", fuse_sql(-1, 0.7, 1.5))(lambda spark, sf: r.fuse(channels(spark, sf), {"dense": 0.7, "lexical": 1.5}))
TEST = Corpus("test", 60, 0.05, 8)


def _hybrid(spark, sf):
    return r.hybrid(docs(spark, sf), vectors(spark, sf), "then", asked(spark, sf), TEST, FIELDS)


query("hybrid_topk", fuse_sql(0.05, 1.0, 1.0, "ORDER BY score DESC, id LIMIT 8", "id IN (SELECT vec_id FROM embeddings)"))(_hybrid)


@query("rerank_topk", "SELECT id, score FROM (" + fuse_sql(-1, 1.0, 1.0, "ORDER BY score DESC, id LIMIT 20") + ") f JOIN documents ON doc_id = id ORDER BY length(text) DESC, score DESC, id LIMIT 5")
def rerank_topk(spark, sf):
    texts = docs(spark, sf).select("id", "text")
    return r.rerank(r.fuse(channels(spark, sf)), texts, "there", lambda q, t: [float(len(x)) for x in t], 20, 5).select("id", "score")


@query("rerank_failure", "SELECT id, score FROM (" + fuse_sql(-1, 1.0, 1.0, "ORDER BY score DESC, id LIMIT 20") + ") f JOIN documents ON doc_id = id ORDER BY score DESC, id LIMIT 5")
def rerank_failure(spark, sf):
    return r.rerank(r.fuse(channels(spark, sf)), docs(spark, sf).select("id", "text"), "there", lambda q, t: [1.0], 20, 5).select("id", "score")


CITE = """c AS (SELECT doc_id, source AS title, CASE WHEN doc_id % 5 <> 0 THEN 1900 + doc_id % 60 END AS year, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS section,
  CASE WHEN doc_id % 4 <> 0 THEN doc_id % 100 END AS a0, CASE WHEN doc_id % 6 <> 0 THEN doc_id % 100 + doc_id % 2 END AS b0, doc_id % 7 = 0 AS est, doc_id % 90 + 3 AS f, doc_id % 90 + 3 + doc_id % 3 AS t, text FROM documents)"""
SPAN = "CASE WHEN {a} = {b} THEN 'p. ' || {m} || {a} ELSE 'pp. ' || {m} || {a} || '–' || {m} || {b} END"
NAMED = "title || CASE WHEN year IS NOT NULL THEN ' (' || year || ')' ELSE '' END"


def cited(spark, sf):
    i, d = F.col("doc_id"), read(spark, sf, "documents")
    return d.select(
        "doc_id", F.col("source").alias("title"), F.when(i % 5 != 0, 1900 + i % 60).alias("year"), F.when(i % 3 == 0, "").otherwise(F.col("lang")).alias("section"), F.when(i % 4 != 0, i % 100).alias("a"),
        F.when(i % 6 != 0, i % 100 + i % 2).alias("b"), (i % 7 == 0).alias("est"), (i % 90 + 3).alias("f"), (i % 90 + 3 + i % 3).alias("t"), "text",
    )


@query("citation_render", f"""WITH {CITE}, e AS (SELECT *, coalesce(a0, b0) AS a, coalesce(b0, a0) AS b, CASE WHEN est THEN '~' ELSE '' END AS m FROM c), p AS (SELECT *, 'PDF ' || {SPAN.format(a='f', b='t', m="''")} AS phys FROM e)
SELECT doc_id, {NAMED} || CASE WHEN section <> '' THEN ', "' || section || '"' ELSE '' END || ', ' || CASE WHEN a IS NULL THEN phys ELSE {SPAN.format(a='a', b='b', m='m')} || ' (' || phys || ')' END AS citation FROM p""")
def citation_render(spark, sf):
    return cited(spark, sf).select("doc_id", r.citation(*(F.col(c) for c in ("title", "year", "section", "a", "b", "est", "f", "t"))).alias("citation"))


@query("passage_text", f"WITH {CITE} SELECT doc_id, {NAMED} || CASE WHEN section <> '' THEN ' — ' || section ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN ' — h' ELSE '' END || chr(10) || chr(10) || text AS passage FROM c")
def passage_text(spark, sf):
    return cited(spark, sf).select("doc_id", r.passage(F.col("title"), F.col("year"), F.col("section"), F.when(F.col("doc_id") % 2 == 0, "h").otherwise(""), F.col("text")).alias("passage"))


CH = """ch AS (SELECT vec_id AS id, CASE WHEN vec_id % 9 = 0 THEN NULL WHEN vec_id % 31 = 1 THEN list_transform(embedding, lambda x: 0.0::FLOAT) WHEN vec_id % 37 = 2 THEN embedding[1:63] ELSE embedding END AS vector, vec_id % 8 <> 0 AS indexable,
  CASE WHEN vec_id % 5 <> 0 THEN 'm1' WHEN vec_id % 2 = 0 THEN 'm0' END AS model, CASE WHEN vec_id % 7 <> 0 THEN vec_id % 3 END AS version, sha256((vec_id % 4)::VARCHAR) AS content_hash, CASE WHEN vec_id % 11 <> 0 THEN sha256((vec_id % 4 + CASE WHEN vec_id % 13 = 0 THEN 1 ELSE 0 END)::VARCHAR) END AS embedded_hash FROM embeddings)"""


def chunks(spark, sf):
    i, e = F.col("vec_id"), F.col("embedding")
    vector = F.when(i % 9 == 0, None).when(i % 31 == 1, F.transform(e, lambda x: F.lit(0.0).cast("float"))).when(i % 37 == 2, F.slice(e, 1, 63)).otherwise(e)
    sha = lambda c: F.sha2(c.cast("string"), 256)
    return read(spark, sf, "embeddings").select(
        i.alias("id"), vector.alias("vector"), (i % 8 != 0).alias("indexable"), F.when(i % 5 != 0, "m1").when(i % 2 == 0, "m0").alias("model"), F.when(i % 7 != 0, i % 3).alias("version"),
        sha(i % 4).alias("content_hash"), F.when(i % 11 != 0, sha(i % 4 + F.when(i % 13 == 0, 1).otherwise(0))).alias("embedded_hash"),
    )


@query("pending_embeddings", f"WITH {CH} SELECT id FROM ch WHERE indexable AND (vector IS NULL OR model IS DISTINCT FROM 'm1' OR len(vector) <> 64 OR coalesce(version, -1) < 1 OR embedded_hash IS DISTINCT FROM content_hash)")
def pending_embeddings(spark, sf):
    return r.pending(chunks(spark, sf), "m1", WIDTH, 1).select("id")


@query("embedding_invariants", f"WITH {CH} SELECT count(*) FILTER (indexable AND vector IS NULL)::BIGINT AS unembedded, count(*) FILTER (NOT indexable AND vector IS NOT NULL)::BIGINT AS excluded_but_embedded, count(*) FILTER (vector IS NOT NULL AND model IS DISTINCT FROM 'm1')::BIGINT AS other_model, count(*) FILTER (len(vector) <> 64)::BIGINT AS other_width, count(*) FILTER (list_sum(list_transform(vector, lambda x: x::DOUBLE * x)) = 0)::BIGINT AS no_norm FROM ch")
def embedding_invariants(spark, sf):
    return r.vector_checks(chunks(spark, sf), "m1", WIDTH)


@query("staleness_hash", f"WITH {CH} SELECT id, embedded_hash IS DISTINCT FROM content_hash AS stale FROM ch")
def staleness_hash(spark, sf):
    return chunks(spark, sf).select("id", (~F.col("embedded_hash").eqNullSafe(F.col("content_hash"))).alias("stale"))


@query("embed_batches")
def embed_batches(spark, sf):
    return r.embed(docs(spark, sf), WIDTH, r.hash_embedder, EMBED_BATCH)
