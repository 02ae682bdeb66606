"""Long repeated byte strings, found by blockwise suffix sorting with a difference cover.

A string of ``length`` bytes that also starts earlier in the corpus is removed; only the first stays. Suffixes matter to
their first ``length`` bytes. They are dealt into buckets and sorted one bucket at a time:

1. Each string holds a gram of 36 bytes that the content alone picks out: of its 65 grams the one of the least hash, the
   leftmost of equals. Grams that are picked once in the corpus can't lie in a repeated string; this leaves the places
   around repeated grams.
2. A place is the stretch of text of all strings that pick its gram there. Equal stretches need no sorting: all but the
   first are repeats throughout.
3. Where a gram's stretches differ, the stretches go to the gram's bucket as text. There the suffixes are sorted by their
   first 32 bytes, the bucket's difference-cover sample (6 of every 31 places) having been ranked before; suffixes that
   tie on 32 bytes are told apart by the ranks of the sample places at the offset that their two residues share, and by
   their last 32 bytes, never by walking through long common texts. A bucket's memory is its stretches and ranks.

However common a passage is, no task gets all of its copies: of equal stretches a task sends the first alone, the others
being repeats of it, and a gram with many different stretches has its strings dealt by their own bytes, equal ones once.

Documents stay where they are read: each pass scans them and asks sorted arrays in the shared folder, memory-mapped, so
only fingerprints and the differing stretches travel.

Defined results: null counts as empty; texts shorter than ``length`` have nothing to remove; rows of the same doc_id are
one document (a string starts earlier there if its offset is smaller), so repeated rows get equal results; null doc_ids
come first; an empty table gives an empty result; other columns don't matter. Bytes are cut, so what is left of a text
may not be whole UTF-8; ``removed_text`` cuts whole characters.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import arrayfiles
from quire.llm.common import Rolling, aside, buckets_for, lean, lean_group, mix, read, shared_dir, sliced, slices, stored, utf8

LENGTH, GRAM = 100, 36
#: Bytes of stored documents for each bucket, at most.
BUCKET_BYTES = 24 << 20
#: A difference cover: every residue of 31 is the difference of two of these.
PERIOD, COVER = 31, np.array([1, 5, 11, 24, 25, 27])
CHUNK_BYTES = 8 << 20
#: Suffixes that are sorted at a time, but for a gram that alone has more.
STRINGS_AT_ONCE = 200_000
#: A gram with more different stretches than this has its strings dealt one by one, by their bytes.
HOT_STRETCHES = 2_000
#: Places of hot grams that a task deals at a time.
HOT_AT_ONCE = 1_000


def cover_offsets() -> np.ndarray:
    """For residues r and s, the least d < 31 for which r + d and s + d are both in the cover."""
    inside = np.isin(np.arange(PERIOD), COVER)
    d = np.arange(PERIOD)
    r, s = np.meshgrid(d, d, indexing="ij")
    both = inside[(r[..., None] + d) % PERIOD] & inside[(s[..., None] + d) % PERIOD]
    return both.argmax(axis=2)


OFFSETS = cover_offsets()


class Places:
    """The picked grams of a slice: hash, place, and the first and last string that picks it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
        self.rolling, n = Rolling(data), len(data)
        w = length - GRAM + 1
        self.gram = self.at = self.first = self.last = np.empty(0, np.int64)
        if n < length:
            return
        h = self.rolling.grams(GRAM)
        key = h & np.uint64(0xFFFFFFFF00000000) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(key) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(key)] = key
        blocks = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        picked = (np.minimum(behind[: n - length + 1], ahead[w - 1 : n - length + w]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        row = np.zeros(n + 1, np.int32)
        np.add.at(row, offsets[1:-1], 1)
        row = np.cumsum(row[:n], dtype=np.int32)
        ok = row[: n - length + 1] == row[length - 1 :]
        start = np.flatnonzero(ok)
        picked = picked[start]
        turn = np.flatnonzero(np.concatenate([[True], (picked[1:] != picked[:-1]) | (row[start[1:]] != row[start[:-1]])])) if len(start) else np.empty(0, np.int64)
        self.at, self.first = picked[turn], start[turn]
        self.last = start[np.append(turn[1:], len(start)) - 1] if len(start) else turn
        # Mixed once more: a picked hash is the least of many, so that buckets by its own leading bits would fill from below.
        self.gram = mix(h[self.at]) >> np.uint64(16)
        self.row = row[self.first] if len(start) else turn

    def stretch(self, some: np.ndarray, length: int = LENGTH) -> np.ndarray:
        """Hashes of the stretches of some places, with where the gram lies in them."""
        a, z, p = self.first[some], self.last[some], self.at[some]
        return mix(self.rolling.span(a, z + length) + (p - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    """Of 48-bit hashes."""
    return ((x >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def bucket_of_key(key: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(mix(key.view(np.uint64)) >> np.uint64(16), buckets)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def dealt(to: np.ndarray, record: np.ndarray, column: str, kind: int | None = None) -> pa.RecordBatch:
    """Structured records as one binary for each bucket."""
    order = np.argsort(to, kind="stable")
    record, to = record[order], to[order]
    at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.empty(0, np.int64)
    ends = np.append(at[1:], len(to)) if len(to) else at
    cols, names = [pa.array(to[at].astype(np.int64)), pa.array([record[a:z].tobytes() for a, z in zip(at, ends, strict=True)], pa.binary())], ["bucket", column]
    if kind is not None:
        cols, names = [*cols, pa.array(np.full(len(at), kind, np.int32))], [*names, "kind"]
    return pa.record_batch(cols, names)


PLACE = np.dtype([("gram", "<u8"), ("stretch", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("at", "<u4"), ("before", "u1"), ("after", "u1")])
CUT = np.dtype([("key", "<i8"), ("start", "<u4"), ("end", "<u4")])
OPEN = np.dtype([("key", "<i8"), ("doc", "<i8"), ("gram", "<u8"), ("at", "<u4"), ("before", "u1"), ("after", "u1"), ("hot", "u1")])


def merged(r: np.ndarray) -> np.ndarray:
    """Cuts as maximal runs, sorted by document and start."""
    r = r[np.lexsort((r["start"], r["key"]))]
    if not len(r):
        return r
    new_key = np.concatenate([[True], r["key"][1:] != r["key"][:-1]])
    lift = np.cumsum(new_key).astype(np.int64) << 33  # keeps the running end from reaching into the next document
    end = np.maximum.accumulate(r["end"].astype(np.int64) + lift)
    new = new_key | np.concatenate([[True], r["start"][1:] + lift[1:] > end[:-1]])
    at = np.flatnonzero(new)
    out = r[at].copy()
    out["end"] = (end - lift)[np.append(at[1:], len(r)) - 1]
    return out


def settled(r: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some places: the cuts of all but the first of equal stretches, the other places, and for each how many stretches its gram has."""
    r = r[np.lexsort((r["at"], r["doc"], r["stretch"], r["gram"]))]
    new_gram = np.concatenate([[True], r["gram"][1:] != r["gram"][:-1]])
    new = new_gram | np.concatenate([[True], r["stretch"][1:] != r["stretch"][:-1]])
    head = r[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = (r["doc"] != head["doc"]) | (r["at"] != head["at"])
    kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_gram))[np.cumsum(new_gram) - 1]
    cut = np.empty(int(later.sum()), CUT)
    c = r[later]
    cut["key"], cut["start"], cut["end"] = c["key"], c["at"] - c["before"], c["at"] - c["after"] + length
    return merged(cut), r[~later], kinds[~later]


def records(table: pa.Table, kind: int, column: str, dtype: np.dtype) -> np.ndarray:
    """What the senders dealt as this kind."""
    return np.concatenate([np.empty(0, dtype), *(np.frombuffer(x.as_py(), dtype) for x, k in zip(table[column], table["kind"], strict=True) if k.as_py() == kind)])


def narrow(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def widen(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def gram_sender(buckets: int, length: int):
    """Pass 1: the picked grams, each at most twice a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            g = np.sort(np.concatenate(held))
            g = g[np.concatenate([np.ones(min(2, len(g)), bool), g[2:] != g[:-2]])]
            cuts = np.searchsorted(bucket_of(g, buckets), np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            return pa.record_batch([pa.array(some), pa.array([narrow(g[cuts[b] : cuts[b + 1]]) for b in some], pa.binary())], ["bucket", "grams"])

        for batch in batches:
            data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
            for i, j in slices(offsets):
                held.append(Places(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length).gram.astype(np.uint64))
                size += int(offsets[j] - offsets[i])
                if size >= CHUNK_BYTES:
                    yield send()
                    held.clear()
                    size = 0
        if held:
            yield send()

    return run


def gram_bucket(folder: str):
    """Keeps the grams that are picked more than once."""

    def run(table: pa.Table) -> pa.Table:
        g = np.sort(np.concatenate([widen(x.as_py()) for x in table["grams"]]))
        again = np.unique(g[1:][g[1:] == g[:-1]])
        b = table["bucket"][0].as_py()
        arrayfiles.save(folder, f"grams-{b}", {"hi": (again >> np.uint64(16)).astype(np.uint32), "lo": (again & np.uint64(0xFFFF)).astype(np.uint16)})
        return pa.table({"bucket": [b]})

    return run


def members(folder: str, have: set[int], g: np.ndarray, buckets: int) -> np.ndarray:
    """Which grams are picked more than once."""
    order = np.argsort(g)
    x = g[order]
    hit = np.zeros(len(x), bool)
    cuts = np.searchsorted(bucket_of(x, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        if int(b) not in have:
            continue
        a = arrayfiles.load(folder, f"grams-{b}")
        part = slice(cuts[b], cuts[b + 1])
        hi, lo = (x[part] >> np.uint64(16)).astype(np.uint32), (x[part] & np.uint64(0xFFFF)).astype(np.uint16)
        at, left = np.searchsorted(a["hi"], hi), np.arange(len(hi))
        got = np.zeros(len(hi), bool)
        while len(left):
            left = left[at[left] < len(a["hi"])]
            left = left[a["hi"][at[left]] == hi[left]]
            same = a["lo"][at[left]] == lo[left]
            got[left[same]] = True
            left = left[~same]
            at[left] += 1
        hit[part] = got
    out = np.empty(len(g), bool)
    out[order] = hit
    return out


def place_sender(folder: str, have: set[int], buckets: int, length: int):
    """Pass 2: places of repeated grams, to the gram's bucket (kind 0). Of equal stretches only the first of a send travels: the others are cut already (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal size
            cut, r, _ = settled(np.concatenate(held), length)
            held.clear()
            size = 0
            yield dealt(bucket_of(r["gram"], buckets), r, "places", 0)
            if len(cut):
                yield dealt(bucket_of_key(cut["key"], buckets), cut, "places", 1)

        for batch in batches:
            data, offsets = utf8(batch.column(2))
            doc, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for begin, end in slices(offsets, CHUNK_BYTES):
                parts = [(i + begin, j + begin) for i, j in slices(offsets[begin : end + 1] - offsets[begin])]
                found = [Places(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length) for i, j in parts]
                hit = members(folder, have, np.concatenate([p.gram.astype(np.uint64) for p in found]), buckets)
                at = 0
                for (i, j), p in zip(parts, found, strict=True):
                    some = np.flatnonzero(hit[at : at + len(p.gram)])
                    at += len(p.gram)
                    if not len(some):
                        continue
                    r = np.empty(len(some), PLACE)
                    row, local = p.row[some], offsets[i : j + 1] - offsets[i]
                    r["gram"], r["stretch"], r["doc"], r["key"] = p.gram[some], p.stretch(some, length), doc[i + row], key[i + row]
                    r["at"], r["before"], r["after"] = p.at[some] - local[row], p.at[some] - p.first[some], p.at[some] - p.last[some]
                    held.append(r)
                    size += len(r)
                if size >= 200_000:
                    yield from send()
        if held:
            yield from send()

    return run


def place_bucket(buckets: int, length: int, hot: int):
    """All but the first of equal stretches are cut (kind 0); firsts of a gram with several stretches stay open (kind 1)."""

    def run(table: pa.Table) -> pa.Table:
        cut, left, kinds = records(table, 1, "places", CUT), records(table, 0, "places", PLACE), np.empty(0, np.int64)
        if len(left):
            more, left, kinds = settled(left, length)
            cut = np.concatenate([cut, more])
        o, kinds = left[kinds > 1], kinds[kinds > 1]
        open_ = np.empty(len(o), OPEN)
        for f in OPEN.names[:-1]:
            open_[f] = o[f]
        open_["hot"] = kinds > hot
        return pa.Table.from_batches([dealt(bucket_of_key(x["key"], buckets), x, "records", kind) for kind, x in enumerate((merged(cut), open_))])

    return run


def key_sorted(folder: str, name: str, dtype: np.dtype):
    """Writes a document bucket's records, sorted by document."""

    def run(table: pa.Table) -> pa.Table:
        r = np.concatenate([np.frombuffer(x.as_py(), dtype) for x in table["records"]])
        r = r[np.argsort(r["key"], kind="stable")]
        b = table["bucket"][0].as_py()
        arrayfiles.save(folder, f"{name}-{b}", {f: r[f] for f in dtype.names})
        return pa.table({"bucket": [b]})

    return run


def of_documents(folder: str, name: str, have: set[int], key: np.ndarray, buckets: int) -> Iterator[tuple[int, dict, int, int]]:
    """For the documents with records: (row, the bucket's arrays, from, to)."""
    to = bucket_of_key(key, buckets)
    for b in np.unique(to):
        if int(b) not in have:
            continue
        a = arrayfiles.load(folder, f"{name}-{b}")
        rows = np.flatnonzero(to == b)
        lo, hi = np.searchsorted(a["key"], key[rows]), np.searchsorted(a["key"], key[rows], "right")
        for r, x, y in zip(rows[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            yield r, a, x, y


def singled(r: np.ndarray, text: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The strings of some places, whose stretches begin at `start` of text: places of one string each, their bytes, hashes, and cuts.

    Strings with the same bytes around a gram travel once; the others repeat the first.
    """
    n = r["before"].astype(np.int64) - r["after"] + 1
    out = np.repeat(r, n)
    out["before"] = out["after"] = ragged(r["after"].astype(np.int64), n)
    begin = np.repeat(start + r["before"], n) - out["before"]
    data = text[ragged(begin, np.full(len(out), length))]
    own = np.arange(len(out)) * length
    h = mix(Rolling(data).span(own, own + length) + mix(out["gram"] + out["before"].astype(np.uint64)))
    order = np.lexsort((out["at"], out["doc"], h))
    out, h, data = out[order], h[order], data.reshape(-1, length)[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = (data == data[head]).all(axis=1) & (out["gram"] == out["gram"][head]) & (out["before"] == out["before"][head])
    later = same & ((out["doc"] != out["doc"][head]) | (out["at"] != out["at"][head]))
    cut = np.empty(int(later.sum()), CUT)
    c = out[later]
    cut["key"], cut["start"], cut["end"] = c["key"], c["at"] - c["before"], c["at"] - c["before"] + np.uint32(length)
    return out[~later], data[~later], h[~later], merged(cut)


def stretch_sender(folder: str, have: set[int], buckets: int, length: int):
    """Pass 3: the open places' stretches as text, to the gram's bucket; those of hot grams string by string, to the string's (kind 0). Cuts that show on the way are kind 1."""

    def sent(to: np.ndarray, r: np.ndarray, text: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            some = order[cuts[b] : cuts[b + 1]]
            yield pa.record_batch([pa.array([int(b)], pa.int64()), pa.array([r[some].tobytes()], pa.binary()), pa.array([text(some).tobytes()], pa.binary()), pa.array([0], pa.int32())], ["bucket", "places", "text", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            parts, starts = [], []
            for row, a, x, y in of_documents(folder, "open", have, batch.column(0).to_numpy(), buckets):
                r = np.empty(y - x, OPEN)
                for f in OPEN.names:
                    r[f] = a[f][x:y]
                parts.append(r)
                starts.append(offsets[row] + r["at"].astype(np.int64) - r["before"])
            if not parts:
                continue
            r, start = np.concatenate(parts), np.concatenate(starts)
            hot = np.flatnonzero(r["hot"])
            for at in range(0, len(hot), HOT_AT_ONCE):
                some = hot[at : at + HOT_AT_ONCE]
                one, text, h, cut = singled(r[some], data, start[some], length)
                yield from sent(bucket_of(h >> np.uint64(16), buckets), one, text.__getitem__)
                if len(cut):
                    for got in dealt(bucket_of_key(cut["key"], buckets), cut, "places").to_pylist():
                        yield pa.record_batch([pa.array([got["bucket"]], pa.int64()), pa.array([got["places"]], pa.binary()), pa.array([b""], pa.binary()), pa.array([1], pa.int32())], ["bucket", "places", "text", "kind"])
            plain = r["hot"] == 0
            r, start = r[plain], start[plain]
            size = r["before"].astype(np.int64) - r["after"] + length
            yield from sent(bucket_of(r["gram"], buckets), r, lambda some, start=start, size=size: data[ragged(start[some], size[some])])

    return run


def eight(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number that sorts as they do."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | text[at + k]
    return out


def cover_ranks(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the `depth` bytes at some places: how many of these strings are smaller. The text is padded."""
    rank, left = np.zeros(len(places), np.int64), np.arange(len(places))  # left: those that tie with another so far
    for k in range(-(-depth // 8)):
        if not len(left):
            break
        word = eight(text, places[left] + min(8 * k, depth - 8))
        order = np.lexsort((word, rank[left]))
        r, w = rank[left][order], word[order]
        group = np.concatenate([[True], r[1:] != r[:-1]])
        split = group | np.concatenate([[True], w[1:] != w[:-1]])
        here = np.arange(len(r))
        own = np.maximum.accumulate(np.where(split, here, 0))
        rank[left[order]] = r + own - np.maximum.accumulate(np.where(group, here, 0))
        left = left[order[np.bincount(own, minlength=len(r))[own] > 1]]
    return rank


def repeated_suffixes(text: np.ndarray, start: np.ndarray, doc: np.ndarray, offset: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings text[start : start + length] also stand at a smaller (doc, offset). Equal strings are in equal groups.

    One bucket's suffixes: sorted by their first 32 bytes, ties resolved by the cover sample's ranks.
    """
    out = np.zeros(len(start), bool)
    # A string whose group and hash are its own repeats nothing: no need to sort it.
    h = mix(Rolling(text).span(start, start + length) + group.astype(np.uint64))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    kept = np.sort(order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]) if len(h) else order
    if not len(kept):
        return out
    text = np.concatenate([text, np.zeros(PERIOD + length, np.uint8)])
    s, d, o = start[kept], doc[kept], offset[kept]
    head = [eight(text, s + 8 * k) for k in range(4)]
    tail = [eight(text, s + length - 32 + 8 * k) for k in range(4)]
    # The sample: places of the cover among the first 31 of any of these suffixes.
    turn = np.zeros(len(text) + 1, np.int64)
    np.add.at(turn, s, 1)
    np.add.at(turn, s + PERIOD, -1)
    near = np.cumsum(turn[:-1]) > 0
    places = np.flatnonzero(near)
    places = places[np.isin(places % PERIOD, COVER)]
    ranks = cover_ranks(text, places, length - PERIOD + 1)
    order = np.lexsort((o, d, *head[::-1]))
    s, d, o = s[order], d[order], o[order]
    head, tail = [x[order] for x in head], [x[order] for x in tail]
    tie = np.ones(len(s), bool)
    tie[1:] = False
    for x in head:
        tie[1:] |= x[1:] != x[:-1]
    block = np.cumsum(tie) - 1  # of suffixes that tie on 32 bytes
    left = np.arange(len(s))
    while len(left):
        b = block[left]
        leads = np.concatenate([[True], b[1:] != b[:-1]])
        leader = left[np.flatnonzero(leads)[np.cumsum(leads) - 1]]  # the earliest that is left of the block
        shift = OFFSETS[s[left] % PERIOD, s[leader] % PERIOD]
        equal = ranks[np.searchsorted(places, s[left] + shift)] == ranks[np.searchsorted(places, s[leader] + shift)]
        for x in tail:
            equal &= x[left] == x[leader]
        equal |= leads
        later = equal & ((d[left] != d[leader]) | (o[left] != o[leader]))
        out[kept[order[left[later]]]] = True
        left = left[~equal]
    return out


def repeats_of(r: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """The cuts that some places' stretches (text, one after the other) give."""
    before, after, at = (r[f].astype(np.int64) for f in ("before", "after", "at"))
    n = before - after + 1
    base = np.cumsum(n + length - 1) - (n + length - 1)
    of = np.repeat(np.arange(len(r)), n)
    offset = ragged(at - before, n)
    # Equal strings have the gram at the same distance.
    group = mix(r["gram"][of] + (at[of] - offset).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    hit = np.flatnonzero(repeated_suffixes(text, ragged(base, n), r["doc"][of], offset, group, length))
    new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])]) if len(hit) else np.empty(0, bool)
    first = hit[new]
    last = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1] if len(hit) else first
    cut = np.empty(len(first), CUT)
    cut["key"], cut["start"], cut["end"] = r["key"][of[first]], offset[first], offset[last] + length
    return cut


def stretch_bucket(buckets: int, length: int):
    """A bucket's suffixes, some grams at a time."""

    def run(table: pa.Table) -> pa.Table:
        cut = records(table, 1, "places", CUT)
        r = records(table, 0, "places", OPEN)
        text = np.frombuffer(b"".join(x.as_py() for x in table["text"]), np.uint8)
        n = r["before"].astype(np.int64) - r["after"] + 1
        base = np.cumsum(n + length - 1) - (n + length - 1)
        order = np.argsort(r["gram"], kind="stable")
        gram, strings = r["gram"][order], np.cumsum(n[order])
        ends = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram))  # of each gram's places
        cuts, a = [cut], 0
        while a < len(order):
            most = np.searchsorted(strings, (strings[a - 1] if a else 0) + STRINGS_AT_ONCE, "right")
            k = np.searchsorted(ends, a, "right")
            z = ends[max(k, np.searchsorted(ends, most, "right") - 1)]
            some = order[a:z]
            cuts.append(repeats_of(r[some], text[ragged(base[some], n[some] + length - 1)], length))
            a = int(z)
        cut = merged(np.concatenate(cuts))
        return pa.Table.from_batches([dealt(bucket_of_key(cut["key"], buckets), cut, "records")])

    return run


def cut_bucket(folder: str):
    """A document bucket's cuts, merged to maximal runs."""

    def run(table: pa.Table) -> pa.Table:
        r = merged(np.concatenate([np.frombuffer(x.as_py(), CUT) for x in table["records"]]))
        b = table["bucket"][0].as_py()
        arrayfiles.save(folder, f"cuts-{b}", {f: r[f] for f in CUT.names})
        return pa.table({"bucket": [b]})

    return run


FOUND = "cut_spans array<struct<start:long,end:long>>"


def cut_finder(folder: str, have: set[int], buckets: int, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None):
    """Pass 4: each row's cuts, and what is made of them in the same step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_key")
            spans = [[] for _ in range(batch.num_rows)]
            for row, a, x, y in of_documents(folder, "cuts", have, batch.column(at).to_numpy(), buckets):
                spans[row] = [{"start": s, "end": e} for s, e in zip(a["start"][x:y].tolist(), a["end"][x:y].tolist(), strict=True)]
            names = [n for n in batch.schema.names if n != "_key"]
            cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], [*names, "cut_spans"])

    return run if then is None else lambda batches: then(run(batches))


def find_repeats(docs: DataFrame, length: int = LENGTH, then: Callable | None = None, schema: str | None = None, hot: int = HOT_STRETCHES) -> DataFrame:
    """docs (doc_id, text and others) with cut_spans: the maximal runs of bytes that lie in a string of `length` bytes that also starts earlier.

    then, schema: a function of such batches for the last step, and the columns that it gives. hot: a gram with more
    stretches than this is split; it changes where strings are compared, not what is found.
    """
    if not 68 <= length <= 250:
        raise ValueError("lengths from 68 to 250 bytes are supported")
    docs = docs.drop("cut_spans", "_key")
    spark = docs.sparkSession
    buckets, folder = buckets_for(docs, BUCKET_BYTES), f"{shared_dir(spark)}/quire/repeats-{uuid.uuid4().hex}"
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keyed = docs.select(doc.alias("doc"), F.xxhash64("doc_id", "text").alias("key"), "text")
    taken = lambda rows: {r[0] for r in rows.collect()}  # noqa: E731  one short row a bucket

    grams = docs.select("text").mapInArrow(lean(gram_sender(buckets, length)), "bucket long, grams binary")
    have = taken(grams.groupBy("bucket").applyInArrow(lean_group(gram_bucket(folder)), "bucket long"))
    places = keyed.mapInArrow(lean(place_sender(folder, have, buckets, length)), "bucket long, places binary, kind int")
    told = stored(places.groupBy("bucket").applyInArrow(lean_group(place_bucket(buckets, length, hot)), "bucket long, records binary, kind int"), "places")
    have = taken(told.where("kind = 1").groupBy("bucket").applyInArrow(lean_group(key_sorted(folder, "open", OPEN)), "bucket long"))
    stretches = keyed.select("key", "text").mapInArrow(lean(stretch_sender(folder, have, buckets, length)), "bucket long, places binary, text binary, kind int")
    more = stretches.groupBy("bucket").applyInArrow(lean_group(stretch_bucket(buckets, length)), "bucket long, records binary")
    cuts = told.where("kind = 0").select("bucket", "records").unionByName(more)
    have = taken(cuts.groupBy("bucket").applyInArrow(lean_group(cut_bucket(folder)), "bucket long"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.withColumn("_key", F.xxhash64("doc_id", "text")).mapInArrow(lean(cut_finder(folder, have, buckets, then)), schema or f"{fields}, {FOUND}")


def kept_parts(text: bytes, spans: list[dict]) -> list[bytes]:
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        at = s["end"]
    return [*out, text[at:]]


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        size, removed, runs, sha = [], [], [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            text, spans = (text.as_py() or "").encode(), spans.as_py()
            h = hashlib.sha256()
            for part in kept_parts(text, spans):
                h.update(part)
            size.append(len(text))
            removed.append(sum(s["end"] - s["start"] for s in spans))
            runs.append(len(spans))
            sha.append(h.hexdigest())
        yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, runs)), pa.array(sha)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op10_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return find_repeats(docs, LENGTH, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(text: bytes, spans: list[dict]) -> str:
    """What is left, cut at whole characters: a character goes if any of its bytes does."""
    out = []
    for k, part in enumerate(kept_parts(text, spans)):
        if k:
            while part and part[0] & 0xC0 == 0x80:
                part = part[1:]
        out.append(part.decode("utf-8", "ignore"))
    return "".join(out)


def remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with what is left of their texts; a text that the cuts empty goes, one that came null or empty stays."""
    for batch in sliced(batches, "text"):
        at, to = batch.schema.get_field_index("text"), batch.schema.get_field_index("cut_spans")
        texts = [t.as_py() if not s.as_py() else whole_characters(t.as_py().encode(), s.as_py()) for t, s in zip(batch.column(at), batch.column(to), strict=True)]
        left = pa.array([bool(t) or not s.as_py() for t, s in zip(texts, batch.column(to), strict=True)], pa.bool_())
        cols = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns) if k != to]
        yield pa.RecordBatch.from_arrays(cols, [n for n in batch.schema.names if n != "cut_spans"]).filter(left)


def removed_text(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with their texts shortened by the repeats, without those of which nothing is left; n_chars, where there is such a column, is counted anew."""
    plain, back = aside(docs, ["cut_spans", "_key"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    out = back(find_repeats(plain, length, remover, fields))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without what also starts earlier; a document of which the cuts leave nothing goes."""
    return removed_text(docs).select(*docs.columns)


OP10_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS i, h FROM b),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS w FROM p),
d AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS again FROM s),
e AS (SELECT doc_id, i AS a, i + 100 AS z, max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d WHERE again),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM e),
r AS (SELECT doc_id, run, min(a) AS a, max(z) AS z FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, z AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM (SELECT doc_id, a, z FROM r UNION ALL SELECT doc_id, -1, 0 FROM b)),
t AS (SELECT k.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, len(h) // 2) - a)), '' ORDER BY a) AS rest FROM k JOIN b USING (doc_id) GROUP BY k.doc_id),
n AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM r GROUP BY doc_id)
SELECT b.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM b JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)
"""
