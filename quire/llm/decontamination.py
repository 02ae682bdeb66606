"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, verified exactly.

An item's windows are its runs of ``window`` words (an item of fewer words is one window). A window is a set of shingles
that a document must hold whole, so by the prefix filter one shingle is enough to find it. Shingles are ordered by
rarity, which is counted over all documents, and a window's first one in that order is its prefix. The documents'
shingles are joined with the prefixes by equality; the place of the prefix in its window and the lengths bound where the
window can lie (it may not leave the document), and what is left is compared word by word, as text, with the window.

Both sides of the join are tables. All that is broadcast is a bit filter of at most ``FILTER_BITS`` bits, whatever the
benchmark's size, which spares most of the documents' shingles the way to the join; where the benchmark outgrows it,
more of them take that way and the result is the same. Equal texts are joined once.

Defined results: a null or empty text has no words and no hits; items without words have no windows; a null item_id is
an item without a name (it counts, and is null among the items); items that repeat an id count once; an empty benchmark
or documents table gives no hits or no rows; repeated rows each get their row; further columns are kept as they are, but
for clashes with the output's names, which the output wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import LOWER, PUNCTUATION, lean, mix, read, shingle, slices, stored, utf8, words

WINDOW, SHINGLE = 13, 5
#: Bits of the broadcast filter: the bound, and how many for each shingle up to it.
FILTER_BITS, BITS_A_SHINGLE = 1 << 26, 32
#: The parts of a key that the filter looks up, each by how far it is shifted.
PROBES = (0, 19, 38)
#: Counts of different shingles that a task gathers before it sends them on.
COUNTED_AT_ONCE = 1 << 20


def keys(hashes: np.ndarray, size: int) -> np.ndarray:
    """Of each `size` words in turn; shingles of different sizes don't meet."""
    return mix(shingle(hashes, size) + np.uint64(size) * np.uint64(0x9E3779B97F4A7C15))


class Filter:
    """A Bloom filter: three bits for each member, each from another part of its key."""

    def __init__(self, bits: int, rows: list):
        self.mask = np.uint64(bits - 1)
        table = np.zeros(bits // 64, np.uint64)
        for word, value in rows:
            table[word] = value & 0xFFFFFFFFFFFFFFFF
        self.table = table.view(np.uint8)

    @classmethod
    def of(cls, found: DataFrame) -> Filter:
        """Of a table's keys. What comes to the driver is the filter, of at most FILTER_BITS bits."""
        n = found.count()
        bits = max(64, min(FILTER_BITS, 1 << (BITS_A_SHINGLE * max(n, 1)).bit_length()))
        at = F.explode(F.array(*(F.shiftrightunsigned("key", n).bitwiseAND(F.lit(bits - 1)) for n in PROBES)))
        found, at = found.select(at.alias("at")), F.col("at")
        word = found.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
        return cls(bits, word.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect())

    def members(self, found: np.ndarray) -> np.ndarray:
        """The places whose keys may be members."""
        out = None
        for n in PROBES:
            at = ((found if out is None else found[out]) >> np.uint64(n)) & self.mask
            kept = np.flatnonzero(self.table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            out = kept if out is None else out[kept]
        return out


def item_windows(window: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, texts, shingles = [], [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, offsets = utf8(pa.array([text], pa.string()))
                h, starts, ends, _ = words(data, offsets, PUNCTUATION)
                n = min(window, len(h))
                if not n:
                    continue
                low = LOWER[data].tobytes()
                found = [low[a:z].decode() for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                of = keys(h, min(size, n)).view(np.int64)
                many = n - min(size, n) + 1
                for i in range(len(h) - n + 1):
                    names.append(item)
                    sizes.append(n)
                    texts.append(" ".join(found[i : i + n]))
                    shingles.append(of[i : i + many])
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(sizes, pa.int32()), pa.array(texts, pa.string()), pa.array(shingles, pa.list_(pa.int64()))], ["item", "n", "window", "shingles"])

    return run


def document_keys(data: np.ndarray, offsets: np.ndarray, sizes: list[int], kept: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, first words) of the slice's shingles that the filter lets through, none across rows; then starts, ends and first of `words`, and each word's row."""
    h, starts, ends, first = words(data, offsets, PUNCTUATION)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    last = first[1:][row]
    found, places = [], []
    for s in sizes:
        own = keys(h, s)
        at = kept.members(own)
        at = at[at + s <= last[at]]
        found.append(own[at])
        places.append(at)
    return np.concatenate(found) if found else np.empty(0, np.uint64), np.concatenate(places) if places else np.empty(0, np.int64), starts, ends, first, row


def counter(sizes: list[int], kept):
    """Partial counts of the documents' shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def out():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(found.view(np.int64)), pa.array(n)], ["key", "count"])

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in slices(offsets):
                found = document_keys(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], sizes, kept.value)[0]
                held.append(found)
                many += len(found)
                if many > COUNTED_AT_ONCE:
                    yield out()
                    held, many = [], 0
        if many:
            yield out()

    return run


NOTES = "_digest binary, n_words long, _near array<struct<key:long,at:int,from:int,around:string>>"


def noter(carried: list[str], sizes: list[int], window: int, kept):
    """For each document: its digest, its number of words, and where it holds shingles that may be prefixes, with the words around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
            digests, n_words, many, found, places, befores, arounds = [], [], [], [], [], [], []
            for i, j in slices(offsets):
                part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                got, at, starts, ends, first, row = document_keys(part, own, sizes, kept.value)
                order = np.argsort(at, kind="stable")
                got, at = got[order], at[order]
                rows = row[at]
                before = np.maximum(first[:-1][rows], at - window + 1)
                after = np.minimum(first[1:][rows], at + window)
                low = LOWER[part].tobytes() if len(at) else b""
                a, z = starts.tolist(), ends.tolist()
                arounds += [b" ".join([low[a[w] : z[w]] for w in range(b, e)]).decode() for b, e in zip(before.tolist(), after.tolist(), strict=True)]
                found.append(got)
                places.append(at - first[:-1][rows])
                befores.append(before - first[:-1][rows])
                n_words.append(np.diff(first))
                many.append(np.bincount(rows, minlength=j - i))
                whole = part.tobytes()
                digests += [hashlib.sha256(whole[x:y]).digest()[:16] for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
            join = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.empty(0, kind))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(many))]) if many else np.zeros(1)
            rows = pa.StructArray.from_arrays([pa.array(np.concatenate(found).view(np.int64)) if found else pa.array([], pa.int64()), join(places, np.int32), join(befores, np.int32), pa.array(arounds, pa.string())], ["key", "at", "from", "around"])
            cols = [pa.array(digests, pa.binary()), join(n_words, np.int64), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in carried), *cols], [*carried, "_digest", "n_words", "_near"])

    return run


def digest(text):
    """As the noter's, in the JVM."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def prefixes(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """window, n, key and offset: each window's rarest shingle by counts over all documents; the first of equals."""
    places = windows.select("window", "n", "shingles").distinct().select("window", "n", F.posexplode("shingles").alias("offset", "key"))
    different = stored(places.select("key").distinct(), "shingles")
    kept = docs.sparkSession.sparkContext.broadcast(Filter.of(different))
    counts = docs.select("text").mapInArrow(lean(counter(sizes, kept)), "key long, count long").groupBy("key").agg(F.sum("count").alias("count"))
    rated = places.join(counts, "key", "left").groupBy("window", "n").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "offset", "key")).alias("least"))
    return stored(rated.select("window", "n", "least.key", "least.offset"), "prefixes")


def joined(docs: DataFrame, benchmark: DataFrame, window: int, size: int, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """The documents' notes, and the hits of each different text that has any: _digest, n_hit, items, hit_spans."""
    spark = docs.sparkSession
    windows = stored(benchmark.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit(""))).mapInArrow(lean(item_windows(window, size)), "item string, n int, window string, shingles array<long>"), "windows")
    sizes = sorted({min(size, r[0]) for r in windows.select("n").distinct().collect()})  # at most `size` numbers
    first = prefixes(docs, windows, sizes)
    kept = spark.sparkContext.broadcast(Filter.of(first.select("key").distinct()))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in carried)
    carried = [f.name for f in docs.schema if f.name in carried]
    notes = stored(docs.mapInArrow(lean(noter(carried, sizes, window, kept)), fields + NOTES), "notes")

    near = notes.where(F.size("_near") > 0).select("_digest", "n_words", "_near").dropDuplicates(["_digest"]).select("_digest", "n_words", F.explode("_near").alias("p")).select("_digest", "n_words", "p.*")
    start = F.col("at") - F.col("offset")
    inside = (start >= F.col("from")) & (start + F.col("n") <= F.col("n_words"))  # the bounds of place and length
    same = F.array_join(F.slice(F.split("around", " "), (start - F.col("from") + 1).cast("int"), F.col("n")), " ") == F.col("window")
    met = near.join(first, "key").where(inside).where(F.when(inside, same)).select("_digest", start.alias("start"), (start + F.col("n")).alias("end"), "window")
    met = stored(met.distinct(), "met")

    so_far = F.max("end").over(Window.partitionBy("_digest").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    turned = met.select("_digest", "start", "end", F.when(F.col("start") <= so_far, 0).otherwise(1).alias("turn"))
    island = turned.withColumn("run", F.sum("turn").over(Window.partitionBy("_digest").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    spans = island.groupBy("_digest", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("_digest")
    spans = spans.agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("hit_spans"))
    names = met.select("_digest", "window").distinct().join(windows.select("window", "item").distinct(), "window").select("_digest", "item").distinct()
    items = names.groupBy("_digest").agg(F.transform(F.sort_array(F.collect_list(F.struct("item"))), lambda x: x["item"]).alias("items"))
    return notes, stored(spans.join(items, "_digest"), "hits")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, size: int = SHINGLE, carried: list[str] | None = None) -> DataFrame:
    """docs (or its columns `carried`) with n_words, n_hit (words inside any occurrence), the items found and the word spans that are hit."""
    docs = docs.drop("n_words", "n_hit", "items", "hit_spans")
    carried = [c for c in docs.columns if carried is None or c in carried]
    notes, hits = joined(docs, benchmark, window, size, carried)
    nothing = F.array().cast("array<string>"), F.array().cast("array<struct<start:int,end:int>>")
    return notes.join(hits, "_digest", "left").select(
        *(F.col(f"`{c}`") for c in carried), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", nothing[0]).alias("items"), F.coalesce("hit_spans", nothing[1]).alias("hit_spans")
    )


def contaminated():
    """At least a twentieth of the words is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), carried=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without any window of the benchmark, as they came.

    A passage that leaks does so in a long text as in a short one, so the share of op8's `contaminated` is no excuse here.
    Null and empty texts hold no window and stay, as does every row of a repeated doc_id whose own text is clean.
    """
    _, hits = joined(docs.select("text"), read(spark, sf_dir, "benchmark"), WINDOW, SHINGLE, [])
    hit = hits.select(F.col("_digest").alias("_hit_digest"))
    return docs.join(hit, digest(docs["text"]) == F.col("_hit_digest"), "left_anti")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS l, list_slice(w, i, i + least(13, len(w)) - 1) AS ws
  FROM (SELECT item_id, w, unnest(range(1, (len(w) - least(13, len(w)) + 2)::BIGINT)) AS i FROM bw WHERE len(w) > 0)
), dw AS (SELECT doc_id, coalesce({_WORDS}, []::VARCHAR[]) AS w FROM documents),
dwin AS (
  SELECT doc_id, l, i, list_slice(w, i, i + l - 1) AS ws
  FROM (SELECT doc_id, w, l, unnest(range(1, (len(w) - l + 2)::BIGINT)) AS i FROM dw, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)
), hits AS (SELECT doc_id, item_id, i, dwin.l FROM dwin JOIN win ON dwin.l = win.l AND dwin.ws = win.ws),
hit AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), false) AS contaminated
FROM dw d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
