"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A document is a bag of sentences. Each sentence has a logit, a bias plus the weights of its words' features; the
document's score is the noisy-or of its sentences, 1 - prod(1 - p). The weights are fitted so that these document scores
explain the documents' labels, and then single out the sentences to blame.

A word's features are the word itself, its beginnings of 3 to 9 letters and its endings of 3 to 6, so that unseen forms
of a known family still count. Features come from the training sample's documents: those whose counts tell most (by the
log-likelihood ratio) about the label, at most ``max_features``; the sample is at most ``sample_rows`` labelled rows,
picked by a hash of their id, and their texts take at most ``sample_bytes``.

Defined results: a null text counts as empty; an empty text has one empty sentence, so its score is that of the bias;
without labelled rows of both kinds every score is the prior (0 without any label); repeated rows are scored alike;
repeated labels count once for each doc_id (the larger one); null labels are no labels; columns beside doc_id and text
are kept by ``score`` as they are, whatever their names, but for its own output names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import aside, crc_rest, lean, read, sliced, stored

SAMPLE_ROWS = 16_000
#: And bytes of their texts: the sample ends before the row that would exceed them.
SAMPLE_BYTES = 256 << 20
MAX_FEATURES = 2_048
MIN_DOCS = 3
#: Nats by which a feature has to raise the likelihood of the labels; below it lies what chance brings about among a million features.
LEAST_GAIN = 8.0
THRESHOLD = 0.3
SPLIT, HELD_OUT = 4, 2
#: Words whose weights a worker keeps in memory.
KEPT_WORDS = 300_000
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*|[.!?\n]+")
WORD = re.compile(r"[^\W_]+")


def word_features(word: str) -> list[str]:
    n = len(word)
    return [word, *(word[:k] + "*" for k in range(3, min(10, n))), *("*" + word[-k:] for k in range(3, min(7, n)))]


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences in code points; at least one."""
    return [m.span() for m in SENTENCE.finditer(text)] or [(0, 0)]


@dataclass
class NoisyOr:
    """Weights of features; scores sentences and documents."""

    bias: float
    weights: dict[str, float]
    _seen: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, w: str) -> float:
        got = self._seen.get(w)
        if got is None:
            get = self.weights.get
            got = sum(get(f, 0.0) for f in word_features(w))
            if len(self._seen) >= KEPT_WORDS:
                self._seen.clear()
            self._seen[w] = got
        return got

    def logits(self, text: str) -> list[tuple[int, int, float]]:
        low = text.lower()
        if len(low) != len(text):  # a few letters grow when lower-cased; the spans are of the text as it is
            low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
        seen, word = self._seen, self.word
        out = []
        for start, end in sentences(low):
            z = self.bias
            for w in WORD.findall(low, start, end):
                x = seen.get(w)
                z += word(w) if x is None else x
            out.append((start, end, z))
        return out

    @staticmethod
    def together(logits: np.ndarray) -> float:
        return float(-np.expm1(-np.logaddexp(0, logits).sum()))

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and start, end and probability of each sentence that alone is toxic."""
        got = self.logits(text)
        z = np.fromiter((x for _, _, x in got), float, len(got))
        least = -0.8472978603872036  # the logit of THRESHOLD
        return self.together(z), [(a, b, float(1 / (1 + np.exp(-x)))) for a, b, x in got if x >= least]


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """toxic and text of at most `rows` labelled training documents of at most `most_bytes` in all, written once; they are taken in an order that hangs on doc_id alone."""
    known = labels.where(F.col("toxic").isin(0, 1) & (crc_rest("doc_id", SPLIT) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most `rows` pairs of numbers: a proven bound.
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "_toxic", F.coalesce("text", F.lit("")).alias("text"))
    found = stored(found.withColumn("_size", F.octet_length("text").cast("long")), "sample")
    # A doc_id's rows go together; one short row for each of at most `rows` ids.
    so_far = F.sum("_size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    fits = found.groupBy("doc_id").agg(F.sum("_size").alias("_size")).select("doc_id", so_far.alias("_so_far")).where(F.col("_so_far") <= most_bytes)
    return found.join(F.broadcast(fits), "doc_id").select("_toxic", "text")


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of documents with a feature: all, and toxic."""
    every, toxic = Counter(), Counter()

    def out():
        names = list(every)
        return pa.record_batch([pa.array(names), pa.array([every[n] for n in names], pa.int64()), pa.array([toxic[n] for n in names], pa.int64())], ["feature", "n", "toxic"])

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = {f for w in set(WORD.findall(text.lower())) for f in word_features(w)}
            every.update(found)
            if label:
                toxic.update(found)
            if len(every) > 500_000:
                yield out()
                every.clear()
                toxic.clear()
    if every:
        yield out()


def informative(sample: DataFrame, docs: int, toxic: int, most: int) -> list[str]:
    """The features whose document counts tell most about the label."""
    counts = sample.mapInArrow(lean(count_features), "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= MIN_DOCS)
    n, t = F.col("n").cast("double"), F.col("t").cast("double")
    term = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    rate = toxic / docs
    gain = term(t, n * rate) + term(n - t, n * (1 - rate)) + term(F.lit(float(toxic)) - t, (docs - n) * rate) + term(F.lit(float(docs - toxic)) - (n - t), (docs - n) * (1 - rate))
    return [r[0] for r in counts.withColumn("g", gain).where((F.col("g") > LEAST_GAIN) & (t > n * rate)).orderBy(F.col("g").desc(), "feature").limit(most).select("feature").collect()]


def bags(names: list[str]):
    """For a document: the sentences that have features, as (sentence, feature) pairs, and how many sentences have none."""
    index = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low = text.lower()
                pairs, spans = [], sentences(low)
                for s, (a, b) in enumerate(spans):
                    pairs += [(s, index[f]) for w in WORD.findall(low, a, b) for f in word_features(w) if f in index]
                rows.append((label, len(spans), np.array(pairs, np.int32).tobytes()))
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["toxic", "sentences", "pairs"])

    return run


def fit_noisy_or(labels: np.ndarray, counts: np.ndarray, pairs: list[np.ndarray], n_features: int, steps: int = 400, ridge: float = 2e-4) -> tuple[float, np.ndarray]:
    """Bias and weights that maximise the likelihood of the document labels under noisy-or (Adam, full batches).

    counts: sentences of each document. pairs: for each document, rows (sentence, feature).
    """
    doc = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
    flat = np.concatenate([p for p in pairs if len(p)] or [np.empty((0, 2), np.int64)]).astype(np.int64)
    key, sentence = np.unique(doc * (int(counts.max(initial=0)) + 1) + flat[:, 0], return_inverse=True)
    owner = key // (int(counts.max(initial=0)) + 1)
    plain = counts - np.bincount(owner, minlength=len(pairs))  # sentences without features
    y = labels.astype(float)
    x = np.zeros(n_features + 1)
    x[-1] = -6.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, steps + 1):
        z = x[-1] + np.bincount(sentence, x[flat[:, 1]], len(key)) if len(flat) else np.full(len(key), x[-1])
        p, p0 = sigmoid(z), sigmoid(x[-1])
        none = np.bincount(owner, np.logaddexp(0, z), len(pairs)) + plain * np.logaddexp(0, x[-1])  # -log(1 - P)
        rest = np.exp(-none)
        pull = (1 - y) - y * rest / np.maximum(1 - rest, 1e-12)  # of the loss on each of the document's p
        of_z = pull[owner] * p
        g = np.empty_like(x)
        g[:-1] = np.bincount(flat[:, 1], of_z[sentence], n_features) / len(y) + ridge * x[:-1] / 10
        g[-1] = (of_z.sum() + (pull * plain).sum() * p0) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return float(x[-1]), x[:-1]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES, sample_bytes: int = SAMPLE_BYTES) -> NoisyOr:
    sample = labelled_sample(docs, labels, sample_rows, sample_bytes)
    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("_toxic"), F.lit(0))).first()
    if not toxic or toxic == n:
        return NoisyOr(-60.0 if not toxic else 60.0, {})
    names = informative(sample, n, toxic, max_features)
    # Bounded by the sample's rows and bytes: the hits of the chosen features alone come to the driver.
    rows = sample.mapInArrow(lean(bags(names)), "toxic long, sentences long, pairs binary").toArrow()
    pairs = [np.frombuffer(p, np.int32).reshape(-1, 2) for p in rows["pairs"].to_pylist()]
    bias, weights = fit_noisy_or(rows["toxic"].to_numpy(), rows["sentences"].to_numpy(), pairs, len(names))
    return NoisyOr(bias, {f: float(w) for f, w in zip(names, weights, strict=True) if abs(w) > 1e-3})


SCORED = "toxicity double, offending array<struct<start:int,end:int,probability:double>>"


def scorer(model: NoisyOr):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            at = batch.schema.get_field_index("text")
            got = [model.score(t.as_py() or "") for t in batch.column(at)]
            spans = pa.array([[{"start": a, "end": b, "probability": p} for a, b, p in s] for _, s in got], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s for s, _ in got], pa.float64()), spans], [*batch.schema.names, "toxicity", "offending"])

    return run


def score(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """docs with each text's score and its offending sentences (spans in code points)."""
    docs = docs.drop("toxicity", "offending")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(lean(scorer(model)), f"{fields}, {SCORED}")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_rest("doc_id", SPLIT) == HELD_OUT).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents below the threshold; the model is trained on the documents as they come in."""
    model = train(docs, read(spark, sf_dir, "labels"))
    plain, back = aside(docs, ["toxicity", "offending"])
    return back(score(plain, model).where(F.col("toxicity") < THRESHOLD))
