"""Near-duplicate groups by HyperMinHash.

A document is its set of word shingles. A shingle's hash picks one of 64 buckets; a bucket keeps its least hash as 16
bits, the number of leading zeros and the ten bits after the first one. Empty buckets borrow from a full one found by a
probe order of their own. Four registers make a band key, 16 bands a document: two documents of similarity 0.85 share no
band with probability 1e-5.

Texts of the same words in the same order are one class from the start (by a 128-bit cryptographic digest of the words),
so copies, however many, cost an aggregate. Classes that share a band key are candidates, first each with the smallest
of its key where registers, corrected for chance matches, give it hope, and the full sets decide. Sets are compared as
sets of word sequences: words get numbers by their bytes, not by a hash. Where a key still holds several components, its
documents' texts meet in cells of two blocks of bounded size, and every pair across components is tried on its full
sets, whatever its registers say: no link between components is lost to an order, a cap, an estimate or a sample. A cell
gives the links that join its components, at most one less than its documents.

Defined results: a null or empty text, or one without words, has an empty set and no links; with fewer words than a
shingle takes, the whole sequence is the one shingle; rows with the same doc_id are one document, linked with all that
any of them is linked with; a null doc_id takes no part (component null, not kept); an empty table gives an empty
result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import LEFT, LOWER, SPACES, eights, lean, lean_group, mix, read, slices, stored, utf8, words
from quire.llm.components import components

BUCKETS, BANDS, MANTISSA = 64, 16, 10
#: Bits of a shingle's hash that registers are made of; the first six pick the bucket.
HASH_BITS, REST_BITS = 48, 42
#: Of the pairs with the smallest of a key, those whose registers say at least this much less than the threshold are tried first; cells try the others.
SLACK = 0.2
#: The chance that registers of different shingles match: the same zeros (1/3) and the same ten bits.
CHANCE = 1 / 3 / (1 << MANTISSA)
MEMBERS_A_GROUP, GROUP_BYTES, CELL_ROWS, CELL_SHINGLES = 64, 8 << 20, 1024, 1_000_000


def row_shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The lower-cased slice, its words' starts and ends and how many begin before each row; then the hashes of all shingles of its rows, and the row of each, ascending."""
    h, starts, ends, first = words(data, offsets, SPACES)
    out, rows = sequences(h, first, k, lambda a, b: a * np.uint64(0xAF251AF3B0F025B5) + b)
    return LOWER[data], starts, ends, first, mix(out), rows


def sequences(values: np.ndarray, first: np.ndarray, k: int, join) -> tuple[np.ndarray, np.ndarray]:
    """What `join` makes of each k words in turn, one after the other, and the row of each; a row of fewer words gives one, of all."""
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    left = np.repeat(first[1:], n) - np.arange(len(values))  # words from each to its row's end
    last = np.where(np.minimum(n[rows], k) <= left, np.minimum(n[rows], k), 0)  # how many a sequence takes; none from here
    out = values.copy()
    for i in range(1, k):
        at = np.flatnonzero(last > i)
        out[at] = join(out[at], values[at + i])
    # Sequences of all of a short row and of k words may not meet.
    begins = last > 0
    return out[begins], rows[begins]


def registers(keys: np.ndarray, rows: int) -> np.ndarray:
    """HyperMinHash registers (rows x 64) of sorted keys: the row, then 48 hash bits."""
    group = keys >> np.uint64(REST_BITS)
    at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(keys) else np.empty(0, np.int64)
    least = keys[at] & np.uint64((1 << REST_BITS) - 1)
    bits = np.frexp(least.astype(np.float64))[1].astype(np.uint64)  # of the number
    zeros = np.uint64(REST_BITS) - bits
    after = (least << zeros) >> np.uint64(REST_BITS - 1 - MANTISSA) & np.uint64((1 << MANTISSA) - 1)
    out = np.zeros(rows * BUCKETS, np.uint16)
    out[group[at].astype(np.int64)] = (zeros << np.uint64(MANTISSA) | after) + np.uint64(1)
    out = out.reshape(rows, BUCKETS)
    return borrow(out)


def borrow(full: np.ndarray) -> np.ndarray:
    """Fills empty registers from full ones; each bucket has its own order of probes."""
    out = full.copy()
    some = full.any(axis=1)
    row, bucket = np.nonzero((full == 0) & some[:, None])
    for turn in range(1, 2000):
        if not len(row):
            break
        probe = (mix((bucket + turn * BUCKETS).astype(np.uint64)) >> np.uint64(58)).astype(np.int64)
        got = full[row, probe]
        out[row, bucket] = got
        left = got == 0
        row, bucket = row[left], bucket[left]
    if len(row):
        out[row, bucket] = full.max(axis=1)[row]
    return out


def signer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            count, halves, regs = [], [], []
            for i, j in slices(offsets):
                for i2 in range(i, j, 1 << 15):  # the row has 16 bits
                    j2 = min(j, i2 + (1 << 15))
                    part, m = data[offsets[i2] : offsets[j2]], j2 - i2
                    low, starts, ends, first, h, rows = row_shingles(part, offsets[i2 : j2 + 1] - offsets[i2], k)
                    at = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=m))])
                    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                        h[a:z].sort()
                    if len(h):
                        new = np.concatenate([[True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])])
                        h, rows = h[new], rows[new]
                    count.append(np.bincount(rows, minlength=m))
                    halves += same_words(low, starts, ends, first)
                    regs += [r.tobytes() for r in registers(rows.astype(np.uint64) << np.uint64(HASH_BITS) | h >> np.uint64(64 - HASH_BITS), m)]
            counted = pa.array(np.concatenate(count).astype(np.int64) if count else np.empty(0, np.int64))
            both = np.frombuffer(b"".join(halves), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), counted, pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "regs"])

    return run


def same_words(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each row, a digest of its words in order, each ended by a space."""
    # A word's bytes and the place after it, which becomes a space: words are at least that far apart, but for the last of a row.
    size = ends - starts + 1
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(to[-1], 0x20, np.uint8)
    inside = ranges(starts, ends - starts)
    out[inside + np.repeat(to[:-1] - starts, ends - starts)] = low[inside]
    whole, cuts = out.tobytes(), to[first].tolist()
    return [hashlib.blake2b(whole[a:z], digest_size=16).digest() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, a fingerprint of the set in two halves, and its registers."""
    return docs.select("doc_id", "text").mapInArrow(lean(signer(k)), "doc_id long, n_shingles long, f1 long, f2 long, regs binary")


def regs_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = mix(np.ascontiguousarray(regs_of(batch.column(1))).view(np.uint64).reshape(-1, BANDS) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        doc = np.repeat(batch.column(0).to_numpy(), BANDS)
        band = np.tile(np.arange(BANDS, dtype=np.int32), len(keys))
        yield pa.record_batch([pa.array(keys.view(np.int64).ravel()), pa.array(band), pa.array(doc)], ["key", "band", "doc"])


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from registers, corrected for matches by chance."""
    return ((a == b).mean(axis=-1) - CHANCE) / (1 - CHANCE)


def hopeful(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = estimate(regs_of(batch.column(2)), regs_of(batch.column(3))) >= least
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def word_numbers(h: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Small numbers of words, equal where the bytes are: hashes group them, and every word is compared with the first of its group."""
    _, place, ids = np.unique(h, return_index=True, return_inverse=True)
    ref, size = place[ids], ends - starts
    same = size == size[ref]
    at8 = eights(low)
    at = np.flatnonzero(same & (ref != np.arange(len(ref))))
    done = 0
    while len(at):
        left = np.minimum(size[at] - done, 8)
        a, b = (at8[starts[x] + done] & LEFT[left] for x in (at, ref[at]))
        same[at[a != b]] = False
        done += 8
        at = at[size[at] > done]
    text, others = low.tobytes(), {}
    for i in np.flatnonzero(~same).tolist():  # another word of the same hash
        ids[i] = others.setdefault(text[starts[i] : ends[i]], len(place) + len(others))
    return ids


def local_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The rows' distinct shingles as small numbers, where each row's begin, and how many numbers there are. Equal numbers are equal words, byte by byte."""
    data, offsets = utf8(texts)
    h, starts, ends, first = words(data, offsets, SPACES)
    numbers = word_numbers(h, LOWER[data], starts, ends)

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), return_inverse=True)[1]

    # Lists of fewer than k words stand alone: their numbers come from fewer turns, so the length tells them apart.
    ids, owner = sequences(numbers, first, k, join)
    took = np.minimum(np.diff(first), k)[owner]
    names, ids = np.unique(ids.astype(np.uint64) << np.uint64(8) | took.astype(np.uint64), return_inverse=True)
    key = np.unique(owner.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64))
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64), np.searchsorted(key, np.arange(len(offsets), dtype=np.uint64) << np.uint64(32)), len(names)


def rare_first(flat: np.ndarray, begin: np.ndarray, numbers: int) -> np.ndarray:
    """The rows' numbers given anew by rising count over the rows, each row's in ascending order."""
    rank = np.empty(numbers, np.int64)
    rank[np.argsort(np.bincount(flat, minlength=numbers), kind="stable")] = np.arange(numbers)
    owner = np.repeat(np.arange(len(begin) - 1, dtype=np.uint64), np.diff(begin))
    return (np.sort(owner << np.uint64(32) | rank[flat].astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start .. start + size - 1 of each, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def cell(k: int, percent: int):
    """Links between components in one cell of a key: every pair that can be similar enough is tried on its full sets, until its components are one.

    A similar pair has at least `percent` of either set in common, so it shares a shingle among each set's rarest, which
    are those beyond that share and one more. A pair that shares an earlier band is left to that band's cell.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc")
        doc, comp, block = (table[c].to_numpy() for c in ("doc", "comp", "block"))
        comp = comp.copy()
        regs = regs_of(table["regs"])
        keys = regs.view(np.uint64).reshape(len(regs), -1)[:, : table["band"][0].as_py()]
        flat, begin, numbers = local_sets(table["text"].combine_chunks(), k)
        flat = rare_first(flat, begin, numbers)
        size = np.diff(begin)
        first, second = table["ci"][0].as_py(), table["cj"][0].as_py()
        others = np.flatnonzero(block == second)
        rare = np.where(size > 0, size - -(-percent * size // 100) + 1, 0)
        names = flat[ranges(begin[others], rare[others])]
        order = np.argsort(names, kind="stable")
        holders = np.repeat(others, rare[others])[order]
        held = np.concatenate([[0], np.cumsum(np.bincount(names, minlength=numbers))])
        mark, meets = np.zeros(numbers, bool), np.zeros(len(size), bool)
        a, b = [], []
        for x in np.flatnonzero(block == first).tolist():
            y = others[others > x] if first == second else others
            y = y[comp[y] != comp[x]]
            y = y[100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])]
            if not len(y):
                continue
            own = flat[begin[x] : begin[x + 1]]
            few = own[: rare[x]]
            met = holders[ranges(held[few], held[few + 1] - held[few])]
            meets[met] = True
            y = y[meets[y]]
            meets[met] = False
            y = y[~(keys[y] == keys[x]).any(axis=1)]
            if not len(y):
                continue
            mark[own] = True
            sums = np.concatenate([[0], np.cumsum(mark[flat[ranges(begin[y], size[y])]])])
            ends = np.cumsum(size[y])
            common = sums[ends] - sums[ends - size[y]]
            mark[own] = False
            for z in y[100 * common >= percent * (size[y] + size[x] - common)].tolist():
                if comp[z] != comp[x]:
                    a.append(doc[x])
                    b.append(doc[z])
                    comp[comp == comp[z]] = comp[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def verifier(k: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        center, doc, role = table["center"][0].as_py(), table["doc"].to_numpy(), table["is_center"].to_numpy()
        flat, begin, numbers = local_sets(table["text"].combine_chunks(), k)
        size, at = np.diff(begin), np.flatnonzero(role)[0]
        mark = np.zeros(numbers, bool)
        mark[flat[begin[at] : begin[at + 1]]] = True
        sums = np.concatenate([[0], np.cumsum(mark[flat])])
        common = sums[begin[1:]] - sums[begin[:-1]]
        linked = doc[~role & (common > 0) & (100 * common >= percent * (size + size[at] - common))]
        return pa.table({"a": np.full(len(linked), center, np.int64), "b": linked})

    return run


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (center, doc) whose full sets are similar enough, as a, b. A center with many pairs, or long ones, is dealt into groups."""
    sized = pairs.join(texts.select("doc", "size"), "doc").groupBy("center").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    groups = sized.select("center", F.ceil(F.greatest(F.col("n") / MEMBERS_A_GROUP, F.col("size") / GROUP_BYTES)).cast("int").alias("groups"))
    members = pairs.join(groups, "center").select("center", F.pmod(F.xxhash64("doc"), F.col("groups")).cast("int").alias("g"), "doc")
    centers = members.select("center", "g").distinct().withColumn("doc", F.col("center"))
    rows = members.withColumn("is_center", F.lit(False)).unionByName(centers.withColumn("is_center", F.lit(True))).join(texts.drop("size"), "doc")
    return rows.groupBy("center", "g").applyInArrow(lean_group(verifier(k, percent)), "a long, b long")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(doc, comp) after links(a, b) have joined components."""
    left, right = labels.select(F.col("doc").alias("a"), F.col("comp").alias("ca")), labels.select(F.col("doc").alias("b"), F.col("comp").alias("cb"))
    across = links.join(left, "a").join(right, "b").where(F.col("ca") != F.col("cb")).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    found = components(across).withColumnRenamed("node", "comp")
    return stored(labels.join(found, "comp", "left").select("doc", F.coalesce("component", "comp").alias("comp")), "labels")


def of_texts(docs: DataFrame, signed: DataFrame, k: int, percent: int) -> DataFrame:
    """near_duplicates where rows of one doc_id have different sets: each text is grouped under a number of its own, then what shares a doc_id is joined."""
    texts = stored(docs.where(F.col("doc_id").isNotNull()).distinct().withColumn("node", F.monotonically_increasing_id()), "texts")
    groups = near_duplicates(texts.select(F.col("node").alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias("node"), F.col("component_id").alias("comp"))
    placed = stored(texts.select("doc_id", "node").join(groups, "node").select("doc_id", "comp").distinct(), "placed")
    links = placed.join(placed.groupBy("doc_id").agg(F.min("comp").alias("a")), "doc_id").select("a", F.col("comp").alias("b"))
    found = components(links).withColumnRenamed("node", "comp")
    joined = stored(placed.join(found, "comp", "left").select("doc_id", F.coalesce("component", "comp").alias("comp")).distinct(), "joined")
    of_doc = joined.join(joined.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "comp").select("doc_id", "component_id")
    out = signed.join(of_doc, "doc_id", "left").select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs(doc_id, text). Linked: 100 * common >= percent * union of k-word shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stored(signatures(docs, k), "signatures")
    key = ["n_shingles", "f1", "f2"]
    sets = signed.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct(*key)).alias("lo"), F.max(F.struct(*key)).alias("hi"))
    if sets.where(F.col("lo") != F.col("hi")).take(1):
        return of_texts(docs, signed, k, percent)
    some = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stored(some.groupBy(*key).agg(F.min("doc_id").alias("doc"), F.first("regs").alias("regs")), "classes")
    bands = stored(classes.select("doc", "regs").mapInArrow(lean(band_keys), "key long, band int, doc long"), "bands")
    centers = bands.groupBy("key").agg(F.min("doc").alias("center"), F.max("doc").alias("last")).where(F.col("center") != F.col("last")).drop("last")
    least = percent / 100 - SLACK

    shared = stored(bands.join(centers, "key"), "shared")  # what shares a key with another
    regs = classes.select("doc", "regs").join(shared.select("doc").distinct(), "doc", "left_semi")
    stars = shared.where(F.col("center") != F.col("doc")).select("center", "doc").distinct()
    told = stars.join(regs.withColumnRenamed("regs", "regs2"), "doc").join(regs.select(F.col("doc").alias("center"), "regs"), "center").select("center", "doc", "regs", "regs2")
    stars = stored(told.mapInArrow(lean(hopeful(least)), "center long, doc long"), "stars")
    involved = shared.select(F.col("doc").alias("doc_id")).distinct()
    texts = stored(docs.join(involved.hint("shuffle_hash"), "doc_id", "left_semi").withColumnRenamed("doc_id", "doc").dropDuplicates(["doc"]).withColumn("size", F.octet_length("text") + 1), "texts")

    labels = stored(classes.select("doc", F.col("doc").alias("comp")), "labels")

    def between(pairs: DataFrame) -> DataFrame:
        """The pairs that are not yet in one component."""
        a, b = labels.select(F.col("doc").alias("center"), F.col("comp").alias("ca")), labels.select("doc", F.col("comp").alias("cb"))
        return pairs.join(a, "center").join(b, "doc").where(F.col("ca") != F.col("cb")).select("center", "doc")

    tried = stored(stars.groupBy("doc").agg(F.min("center").alias("center")).select("center", "doc"), "pairs")
    labels = relabelled(labels, verified(tried, texts, k, percent))
    more = stored(between(stars.join(tried, ["center", "doc"], "left_anti")), "pairs")
    if more.take(1):
        labels = relabelled(labels, verified(more, texts, k, percent))
    # Keys that still hold several components: every pair across them, in cells of two blocks.
    here = shared.select("key", "band", "doc").join(labels, "doc")
    sizes = classes.select("doc", "n_shingles")
    mixed = here.join(sizes, "doc").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("m")).where(F.col("lo") != F.col("hi"))
    cut = F.ceil(F.greatest(F.col("n") / CELL_ROWS, F.col("m") / CELL_SHINGLES)).cast("int")
    left = here.join(mixed.select("key", cut.alias("blocks")), "key").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).join(regs, "doc").join(texts.drop("size"), "doc")
    cells = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").withColumns({"ci": F.least("block", "other"), "cj": F.greatest("block", "other")})
    links = stored(cells.groupBy("key", "ci", "cj").applyInArrow(lean_group(cell(k, percent)), "a long, b long"), "links")
    if links.take(1):
        labels = relabelled(labels, links)

    of_class = classes.select(*key, "doc").join(labels, "doc", "left").select(*key, F.coalesce("comp", "doc").alias("component"))
    placed = signed.join(of_class, key, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return placed.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document of the smallest doc_id of each group. Rows that repeat a doc_id are one document, kept or dropped together; null doc_ids, null and empty texts stay."""
    rest = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(rest.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
OP9_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS}, []::VARCHAR[]) AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w)
), n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON r.other = l.a),
comp AS (SELECT doc_id, min(other)::BIGINT AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)
"""
