"""An interpolated modified Kneser-Ney trigram model: counted in Spark, kept as sorted hash arrays, memory-mapped to score.

Counting. A worker turns its documents' words into 48-bit hashes and counts runs of three a million tokens at a time;
what it sends on is a block for each bucket, with a table of the block's words. Buckets are by the middle word's hash:
there a trigram meets all of its context and all that may stand before its last two words. They are worked off in some turns
over the documents, so that one turn's share of the trigrams is on the way at a time. Middle words so frequent that
one bucket would get too much are found beforehand (on a 64th of the documents, for balance alone) and dealt over all
buckets by context. A bucket sums its trigrams, writes them as an array of sorted hashes with counts, with its contexts'
totals, and sends on each pair of words with the number of different words before it. Pairs are dealt by their first word
(frequent ones by pair), summed and written in the same way, and send on sums by word to the last dealing, which writes
the word arrays: tokens, how many different words precede the word, and the totals of the frequent first words.

Scoring. Workers map the arrays of the shared folder and look tokens up with binary searches, batch by batch.

    p(w | u v) = (c(u v w) - D(c(u v w))) / c(u v .) + back(u v) p(w | v)
    p(w | v) = (n(. v w) - D'(n(. v w))) / n(. v .) + back'(v) p(w)
    p(w) = (n(. w) - D"(n(. w))) / n(. .) + back" / (V + 1)

with D for counts of 1, 2 and 3 or more from the counts of counts of each level; two begin tokens stand before a text, and
where v is one of them, n(. v w) is the count of v w, as nothing else can precede it. The last term also covers unknown words.

Defined results: a null or empty text is the end token alone; an empty training set gives every token the probability
1 / (V + 1) = 1; repeated rows count each; null doc_ids are split as the empty text; other columns don't matter.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import arrayfiles
from quire.llm.common import SPACES, buckets_for, crc_rest, lean, lean_group, mix, read, shared_dir, slices, stored, utf8, words

SPLIT, HELD_OUT = 5, 1
#: Bytes of stored documents for each bucket, at most.
BUCKET_BYTES = 24 << 20
#: Hashes of the end of a text and of what stands before its first word.
END, BEGIN = np.uint64(1), np.uint64(2)
#: A third of 2**21, as that many bits number the words of what is counted at once.
TOKENS_AT_ONCE = 690_000
#: Turns in which trigrams are counted, each over all documents for its share of the buckets: only one turn's shuffle is on disk.
PASSES = 4
WORD_BITS = np.uint64(16)  # what a word's hash loses


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' words, each row closed by the end token, and where each row starts."""
    out, counts = [], []
    for i, j in slices(offsets):
        h, _, _, first = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SPACES)
        h = h >> WORD_BITS
        h[h <= BEGIN] += np.uint64(2)
        n = np.diff(first)
        at = np.arange(len(h)) + np.repeat(np.arange(len(n)), n)
        t = np.full(len(h) + len(n), END, np.uint64)
        t[at] = h
        out.append(t)
        counts.append(n + 1)
    if not out:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def before(t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token that precedes each."""
    v = np.empty_like(t)
    v[1:] = t[:-1]
    v[first[:-1]] = BEGIN
    return v


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(0xAF251AF3B0F025B5) + w) >> WORD_BITS


def triple_hash(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(u * np.uint64(0xAF251AF3B0F025B5) + v) * np.uint64(0xD6E8FEB86659FD93) + w) >> WORD_BITS


def bucket_of_word(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def bucket_of_pair(v: np.ndarray, w: np.ndarray, frequent: np.ndarray, buckets: int) -> np.ndarray:
    out = bucket_of_word(v, buckets)
    if len(frequent):
        hot = frequent[np.minimum(np.searchsorted(frequent, v), len(frequent) - 1)] == v
        out[hot] = bucket_of_word(mix(w[hot] ^ v[hot]) >> WORD_BITS, buckets)
    return out


def bucket_of_context(u: np.ndarray, v: np.ndarray, frequent: np.ndarray, buckets: int) -> np.ndarray:
    """Of the trigrams that begin with u v: by v, or where v is frequent by both."""
    out = bucket_of_word(v, buckets)
    if len(frequent):
        hot = frequent[np.minimum(np.searchsorted(frequent, v), len(frequent) - 1)] == v
        out[hot] = bucket_of_word(pair_hash(u[hot], v[hot]), buckets)
    return out


def narrow(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes as two arrays."""
    return (x >> np.uint64(16)).astype(np.uint32), (x & np.uint64(0xFFFF)).astype(np.uint16)


def wide(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return hi.astype(np.uint64) << np.uint64(16) | lo


def small(x: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes, with those of 255 and more apart."""
    return [np.minimum(x, 255).astype(np.uint8), x[x >= 255].astype(np.uint64)]


def unsmall(a: np.ndarray, more: np.ndarray) -> np.ndarray:
    out = a.astype(np.int64)
    out[a == 255] = more
    return out


def packed(name: str, x: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes in a file, with those of 255 and more and their places apart."""
    return {name: np.minimum(x, 255).astype(np.uint8), f"{name}_at": np.flatnonzero(x >= 255), f"{name}_more": x[x >= 255].astype(np.int64)}


def unpacked(a: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    out = a[name][at].astype(np.int64)
    big = np.flatnonzero(out == 255)
    if len(big):
        out[big] = a[f"{name}_more"][np.searchsorted(a[f"{name}_at"], at[big])]
    return out


def block(arrays: list[np.ndarray]) -> bytes:
    """Arrays of unsigned numbers as compressed bytes, each number's first bytes together, then the second ones, and so on."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], np.uint32)
    planes = b"".join(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays)
    return head.tobytes() + pa.compress(planes, "zstd", asbytes=True)


def unblock(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    head = np.frombuffer(data, np.uint32, 2 * n, 4).reshape(-1, 2).tolist()
    planes = np.frombuffer(pa.decompress(memoryview(data)[4 + 8 * n :], sum(size * m for size, m in head), "zstd", asbytes=True), np.uint8)
    at, out = 0, []
    for size, m in head:
        out.append(np.ascontiguousarray(planes[at : at + size * m].reshape(size, m).T).view(f"<u{size}").ravel())
        at += size * m
    return out


def least(x: np.ndarray) -> np.ndarray:
    """In the smallest type that holds the largest."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def indexed(prefix: str, key: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted 48-bit hashes in a file: their last 32 bits, and where each value of the first 16 begins."""
    return {f"{prefix}low": key.astype(np.uint32), f"{prefix}begin": np.searchsorted(key >> np.uint64(32), np.arange((1 << 16) + 1, dtype=np.uint64)).astype(np.uint32)}


def find48(a: dict, prefix: str, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of some hashes among a file's, and whether they are there."""
    low, begin = a[f"{prefix}low"], a[f"{prefix}begin"]
    top, rest = (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)
    at, end = begin[top].astype(np.int64), begin[top + 1].astype(np.int64)
    last = end.copy()
    while len(open_ := np.flatnonzero(at < end)):
        mid = (at[open_] + end[open_]) >> 1
        less = low[mid] < rest[open_]
        at[open_[less]] = mid[less] + 1
        end[open_[~less]] = mid[~less]
    there = at < last
    there[there] = low[at[there]] == rest[there]
    return at, there


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        seen, n = np.unique(tokens(data, offsets)[0], return_counts=True)
        keep = np.flatnonzero(n * 20_000 >= n.sum())  # what is rarer is not frequent
        yield pa.record_batch([pa.array(np.append(seen[keep], np.uint64(0)).astype(np.int64)), pa.array(np.append(n[keep], n.sum()))], ["word", "n"])


def frequent_words(docs: DataFrame, buckets: int) -> np.ndarray:
    """Words that are so frequent that a bucket of their own pairs would be uneven: at most 8 a bucket. They only steer the dealing."""
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(64)) == 0).select("text")
    counts = some.mapInArrow(lean(count_words), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.col("n").desc(), "word").limit(8 * buckets).collect()
    total = next((r["n"] for r in rows if r["word"] == 0), 0)
    return np.array(sorted({int(BEGIN), *(r["word"] for r in rows if r["word"] > 0 and 8 * buckets * r["n"] >= total)}), np.uint64)


def triple_counter(frequent: np.ndarray, buckets: int, turn: int = 0, turns: int = 1):
    """Blocks of trigram counts by bucket, for the buckets of one turn: a table of words, the middle words, how many trigrams each has, their first and last words, their counts."""

    def counted(t: np.ndarray, v: np.ndarray, u: np.ndarray, to: np.ndarray) -> pa.RecordBatch:
        n = len(t)
        names, ids = np.unique(np.concatenate([v, u, t]), return_inverse=True)
        key = ids[:n].astype(np.uint64) << np.uint64(42) | ids[n : 2 * n].astype(np.uint64) << np.uint64(21) | ids[2 * n :].astype(np.uint64)
        key.sort()
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.append(at, n))
        key = key[at]
        low = np.uint64((1 << 21) - 1)
        of_v, of_u, of_w = (key >> np.uint64(42)).astype(np.int64), (key >> np.uint64(21) & low).astype(np.int64), (key & low).astype(np.int64)
        to = bucket_of_context(names[of_u], names[of_v], frequent, buckets)
        order = np.argsort(to.astype(np.uint16) if buckets < 1 << 16 else to, kind="stable")
        of_v, of_u, of_w, many, to = of_v[order], of_u[order], of_w[order], many[order], to[order]
        cuts = np.searchsorted(to, np.arange(buckets + 1))
        rows = []
        number = np.zeros(len(names), np.uint32)
        for b in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[b], cuts[b + 1])
            pv, pu, pw = of_v[part], of_u[part], of_w[part]
            first = np.flatnonzero(np.concatenate([[True], pv[1:] != pv[:-1]]))
            own, times = np.unique(np.concatenate([pv[first], pu, pw]), return_counts=True)
            own = own[np.argsort(-times, kind="stable")]  # so that most numbers are small
            number[own] = np.arange(len(own))
            small_number = lambda x, k=len(own): number[x].astype(np.uint16 if k <= 1 << 16 else np.uint32)
            rows.append(block([*narrow(names[own]), small_number(pv[first]), *small(np.diff(np.append(first, len(pv)))), small_number(pu), small_number(pw), *small(many[part])]))
        return pa.record_batch([pa.array(np.flatnonzero(np.diff(cuts)).astype(np.int64)), pa.array(rows, pa.binary())], ["bucket", "triples"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def send() -> pa.RecordBatch:
            nonlocal size
            got = counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            size = 0
            return got

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in slices(offsets, 4 * TOKENS_AT_ONCE):
                t, first = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                v = before(t, first)
                u = before(v, first)
                to = bucket_of_context(u, v, frequent, buckets)
                own = np.flatnonzero(to % turns == turn)
                for a in range(0, len(own), TOKENS_AT_ONCE):
                    some = own[a : a + TOKENS_AT_ONCE]
                    if size + len(some) > TOKENS_AT_ONCE:
                        yield send()
                    held.append((t[some], v[some], u[some], to[some]))
                    size += len(some)
        if held:
            yield send()

    return run


def triple_bucket(folder: str, frequent: np.ndarray, buckets: int):
    """Sums a bucket's trigrams, writes its arrays, and gives each pair of last words with how many words stand before it, by the pair's bucket."""

    def run(table: pa.Table) -> pa.Table:
        b = table["bucket"][0].as_py()
        us, vs, ws, ns = [], [], [], []
        for data in table["triples"]:
            hi, lo, pv, f, fm, pu, pw, n, nm = unblock(data.as_py())
            names = wide(hi, lo)
            vs.append(np.repeat(names[pv], unsmall(f, fm)))
            us.append(names[pu])
            ws.append(names[pw])
            ns.append(unsmall(n, nm))
        u, v, w, n = (np.concatenate(x) for x in (us, vs, ws, ns))
        del us, vs, ws, ns
        key = triple_hash(u, v, w)
        order = np.argsort(key)
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        c = np.add.reduceat(n[order], at)
        u, v, w, key = u[order[at]], v[order[at]], w[order[at]], key[at]
        ctx, total, n1, n2, n3 = summed(pair_hash(u, v), c, c == 1, c == 2, c > 2)
        arrayfiles.save(folder, f"triples-{b}", {**indexed("", key), **packed("count", c), **indexed("context_", ctx), **packed("total", total), **packed("n1", n1), **packed("n2", n2), **packed("n3", n3)})
        stats = counts_of_counts(c).tolist()
        order = np.argsort(pair_hash(v, w))
        v, w, c = v[order], w[order], c[order]
        at = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
        raw = np.add.reduceat(c, at)
        v, w = v[at], w[at]
        preceding = np.where(v == BEGIN, raw, np.diff(np.append(at, len(c))))
        to = bucket_of_pair(v, w, frequent, buckets)
        order = np.lexsort((v, to))
        v, w, raw, preceding, to = v[order], w[order], raw[order], preceding[order], to[order]
        cuts = np.searchsorted(to, np.arange(buckets + 1))
        rows = []
        for k in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[k], cuts[k + 1])
            pv = v[part]
            first = np.flatnonzero(np.concatenate([[True], pv[1:] != pv[:-1]]))
            rows.append((k, block([*narrow(pv[first]), *small(np.diff(np.append(first, len(pv)))), *narrow(w[part]), *small(preceding[part]), *small(raw[part]), np.array(stats, np.uint64), np.array([b], np.uint64)])))
            stats = [0, 0, 0, 0]
        return pa.table({"bucket": pa.array([int(r[0]) for r in rows], pa.int64()), "pairs": pa.array([r[1] for r in rows], pa.binary())})

    return run


def counts_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, 5), minlength=6)[1:5].astype(np.int64)


def summed(names: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    seen, at = np.unique(names, return_inverse=True)
    return seen, *(np.bincount(at, x, len(seen)).astype(np.int64) for x in weights)


def pair_bucket(folder: str, frequent: np.ndarray, buckets: int):
    """Sums a bucket's pairs, writes its arrays, and gives what it knows of each word, by the word's bucket."""

    def run(table: pa.Table) -> pa.Table:
        b = table["bucket"][0].as_py()
        vs, ws, ns, raws, triples, sources = [], [], [], [], np.zeros(4, np.int64), set()
        for data in table["pairs"]:
            vh, vl, f, fm, wh, wl, n, nm, r, rm, kinds, source = unblock(data.as_py())
            vs.append(np.repeat(wide(vh, vl), unsmall(f, fm)))
            ws.append(wide(wh, wl))
            ns.append(unsmall(n, nm))
            raws.append(unsmall(r, rm))
            triples += kinds.astype(np.int64)
            sources.add(int(source[0]))
        v, w, n, raw = (np.concatenate(x) for x in (vs, ws, ns, raws))
        del vs, ws, ns, raws
        key = pair_hash(v, w)
        order = np.argsort(key)
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        c, raw = np.add.reduceat(n[order], at), np.add.reduceat(raw[order], at)
        v, w, key = v[order[at]], w[order[at]], key[at]
        ctx, total, n1, n2, n3 = summed(v, c, c == 1, c == 2, c > 2)
        hot = np.isin(ctx, frequent, assume_unique=True)
        own = ~hot
        arrayfiles.save(folder, f"pairs-{b}", {"ctx": ctx[own], "total": least(total[own]), "n1": least(n1[own]), "n2": least(n2[own]), "n3": least(n3[own]), **indexed("", key), **packed("count", c)})
        word, preceding, seen = summed(w, np.ones(len(w)), raw)
        stats, triples, sources = counts_of_counts(c).tolist(), triples.tolist(), sorted(sources)
        to = bucket_of_word(word, buckets)
        hot_to = bucket_of_word(ctx[hot], buckets)
        rows = []
        for k in np.union1d(np.unique(to), np.unique(hot_to)):
            part, h = slice(*np.searchsorted(to, [k, k + 1])), np.flatnonzero(hot)[hot_to == k]
            known = [*narrow(word[part]), *small(preceding[part]), *small(seen[part]), *narrow(ctx[h]), *(x[h].astype(np.uint64) for x in (total, n1, n2, n3))]
            rows.append((k, block([*known, np.array(stats, np.uint64), np.array([b], np.uint64), np.array(triples, np.uint64), np.array(sources, np.uint64)])))
            stats, triples, sources = [0] * 4, [0] * 4, []
        return pa.table({"bucket": pa.array([int(r[0]) for r in rows], pa.int64()), "known": pa.array([r[1] for r in rows], pa.binary())})

    return run


def word_bucket(folder: str):
    def run(table: pa.Table) -> pa.Table:
        parts = [unblock(x.as_py()) for x in table["known"]]
        word, preceding, seen = summed(np.concatenate([wide(p[0], p[1]) for p in parts]), np.concatenate([unsmall(p[2], p[3]) for p in parts]), np.concatenate([unsmall(p[4], p[5]) for p in parts]))
        ctx, total, n1, n2, n3 = summed(np.concatenate([wide(p[6], p[7]) for p in parts]), *(np.concatenate([p[8 + i] for p in parts]).astype(np.int64) for i in range(4)))
        arrayfiles.save(folder, f"words-{table['bucket'][0].as_py()}", {"word": word, "preceding": least(preceding), "seen": least(seen), "ctx": ctx, "total": total, "n1": n1, "n2": n2, "n3": n3})
        sums = lambda k: sum(p[k].astype(np.int64) for p in parts).tolist()
        known = {"sources": sorted({int(p[13][0]) for p in parts}), "triple_sources": sorted({int(x) for p in parts for x in p[15]}), "v": len(word), "n": int(seen.sum()), "preceding": int(preceding.sum())}
        known |= {"words": counts_of_counts(preceding).tolist() + [int((preceding > 2).sum())], "pairs": sums(12), "triples": sums(14)}
        return pa.table({"bucket": [table["bucket"][0].as_py()], **{k: [x] for k, x in known.items()}}, schema=pa.schema([("bucket", pa.int64()), *((k, pa.list_(pa.int64()) if isinstance(x, list) else pa.int64()) for k, x in known.items())]))

    return run


def discounts(n: list[int]) -> list[float]:
    """D for counts of 1, 2, and 3 or more, from how many have a count of 1 to 4."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05 * (i + 1)), i + 0.95) for i, d in enumerate(raw)]


class Model:
    """What workers need to find and use the arrays."""

    def __init__(self, folder: str, frequent: np.ndarray, buckets: int, rows: list):
        self.folder, self.frequent, self.buckets = folder, frequent, buckets
        self.word_buckets, self.pair_buckets, self.triple_buckets = {r["bucket"] for r in rows}, {b for r in rows for b in r["sources"]}, {b for r in rows for b in r["triple_sources"]}
        total = lambda k: np.sum([r[k] for r in rows], axis=0) if rows else np.zeros(5)
        self.vocabulary, self.tokens, self.preceding = (int(sum(r[k] for r in rows)) for k in ("v", "n", "preceding"))
        words, pairs, triples = total("words"), total("pairs"), total("triples")
        self.triple_discounts, self.pair_discounts, self.word_discounts = discounts(list(triples)), discounts(list(pairs)), discounts(list(words))
        d = self.word_discounts
        self.left = (d[0] * words[0] + d[1] * words[1] + d[2] * words[4]) / self.preceding if self.preceding else 1.0

    @staticmethod
    def discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
        return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0)

    def _of_words(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For sorted words: tokens, p(w), and as first word the total and the weight that it leaves to p."""
        seen, preceding, total, left = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x))
        to = bucket_of_word(x, self.buckets)
        cuts = np.searchsorted(to, np.arange(self.buckets + 1))
        d = self.pair_discounts

        def first_words(a: dict, part: slice) -> None:
            at, ok = self.find(a["ctx"], x[part])
            rows = np.arange(part.start, part.stop)[ok]
            total[rows] = a["total"][at[ok]]
            left[rows] = d[0] * a["n1"][at[ok]] + d[1] * a["n2"][at[ok]] + d[2] * a["n3"][at[ok]]

        for b in np.flatnonzero(np.diff(cuts)):
            part = slice(int(cuts[b]), int(cuts[b + 1]))
            a = arrayfiles.load(self.folder, f"words-{b}") if int(b) in self.word_buckets else None
            if a is not None:
                at, ok = self.find(a["word"], x[part])
                rows = np.arange(part.start, part.stop)[ok]
                seen[rows], preceding[rows] = a["seen"][at[ok]], a["preceding"][at[ok]]
                first_words(a, part)
            if int(b) in self.pair_buckets:
                first_words(arrayfiles.load(self.folder, f"pairs-{b}"), part)
        p = self.discounted(preceding, self.word_discounts) / max(self.preceding, 1) + self.left / (self.vocabulary + 1)
        return seen, p, total, left

    @staticmethod
    def find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return at, keys[at] == x

    def by_bucket(self, kind: str, have: set[int], to: np.ndarray, key: np.ndarray) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
        """For each bucket that has a file: its arrays, the places in `key` that belong to it by rising key, and those keys."""
        order = np.argsort(to.astype(np.uint64) << np.uint64(48) | key)
        cuts = np.searchsorted(to[order], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            if int(b) in have:
                some = order[cuts[b] : cuts[b + 1]]
                yield arrayfiles.load(self.folder, f"{kind}-{b}"), some, key[some]

    def _of_pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """How many words precede each pair."""
        out = np.zeros(len(v), np.int64)
        for a, some, key in self.by_bucket("pairs", self.pair_buckets, bucket_of_pair(v, w, self.frequent, self.buckets), pair_hash(v, w)):
            at, there = find48(a, "", key)
            out[some[there]] = unpacked(a, "count", at[there])
        return out

    def _of_triples(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of trigrams; their contexts' totals and the weights that these leave to p(w | v)."""
        count, total, left = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), np.zeros(len(v))
        context, key = pair_hash(u, v), triple_hash(u, v, w)
        d = self.triple_discounts
        for a, some, contexts in self.by_bucket("triples", self.triple_buckets, bucket_of_context(u, v, self.frequent, self.buckets), context):
            at, there = find48(a, "context_", contexts)
            at, some = at[there], some[there]
            total[some] = unpacked(a, "total", at)
            left[some] = d[0] * unpacked(a, "n1", at) + d[1] * unpacked(a, "n2", at) + d[2] * unpacked(a, "n3", at)
            some = some[np.argsort(key[some])]
            at, there = find48(a, "", key[some])
            count[some[there]] = unpacked(a, "count", at[there])
        return count, total, left

    def score(self, t: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """For each row: tokens, known tokens, base score, score."""
        v = before(t, first)
        u = before(v, first)
        names, ids = np.unique(np.append(t, BEGIN), return_inverse=True)
        seen, p, total, left = self._of_words(names)
        begin = ids[-1]
        ids = ids[:-1]
        of_v = np.empty_like(ids)
        of_v[1:] = ids[:-1]
        of_v[first[:-1]] = begin
        known = total[of_v]
        prob = np.where(known > 0, (self.discounted(self._of_pairs(v, t), self.pair_discounts) + left[of_v] * p[ids]) / np.maximum(known, 1), p[ids])
        c, known, rest = self._of_triples(u, v, t)
        prob = np.where(known > 0, (self.discounted(c, self.triple_discounts) + rest * prob) / np.maximum(known, 1), prob)
        base = np.log10((seen + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))[ids]
        sums = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every row has its end
        return [np.diff(first), sums((seen[ids] > 0).astype(np.int64)), sums(base), sums(np.log10(prob))]


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that nothing refers to any more: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def train(docs: DataFrame) -> Model:
    """Counts all of docs(doc_id, text) into arrays of the shared folder."""
    spark = docs.sparkSession
    buckets, folder = buckets_for(docs, BUCKET_BYTES), f"{shared_dir(spark)}/quire/lm-{uuid.uuid4().hex}"
    frequent = frequent_words(docs, buckets)
    pairs = None
    for turn in range(PASSES):
        triples = docs.select("text").mapInArrow(lean(triple_counter(frequent, buckets, turn, PASSES)), "bucket long, triples binary")
        counted = stored(triples.groupBy("bucket").applyInArrow(lean_group(triple_bucket(folder, frequent, buckets)), "bucket long, pairs binary"), "pairs")
        pairs = counted if pairs is None else pairs.unionByName(counted)
        del triples, counted
        free_shuffles(spark)
    known = pairs.groupBy("bucket").applyInArrow(lean_group(pair_bucket(folder, frequent, buckets)), "bucket long, known binary")
    lists = ", ".join(f"{n} array<long>" for n in ("words", "pairs", "triples"))
    rows = known.groupBy("bucket").applyInArrow(lean_group(word_bucket(folder)), f"bucket long, sources array<long>, triple_sources array<long>, v long, n long, preceding long, {lists}").collect()  # one row a bucket
    return Model(folder, frequent, buckets, rows)


SCORED = "n_tokens long, n_known long, base_score double, score double"


def scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, 4 * TOKENS_AT_ONCE):
                t, first = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x) for x in model.score(t, first))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score (log10 probabilities); the perplexity is 10 ** (-score / n_tokens)."""
    return docs.select("doc_id", "text").mapInArrow(lean(scorer(model)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCORED}")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(crc_rest("doc_id", SPLIT) != HELD_OUT))
    scored = score(docs, model).withColumn("held_out", crc_rest("doc_id", SPLIT) == HELD_OUT).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
