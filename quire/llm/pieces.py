"""SentencePiece encoding and decoding with a streaming Viterbi search.

The search walks over the text, character by character, and notes the best way to get to each place (one backpointer
each). A later piece can start at the last ``longest piece`` places only; once the ways to all of these go through one
boundary, nothing that follows can change what lies before it: those ids are committed and forgotten. What is held is a
window of the longest piece's length and what lies between it and that boundary: a word or two in any text seen, and in
the worst case, ways that never meet, a backpointer for each character that a worker holds anyway.

Two kinds of model are read from their .model file. For unigram models the best way maximises the sum of scores. For BPE
models a way is allowed only if each pair of neighbouring pieces is one that merging would leave apart, which one way at
each place fulfils, so the backpointer there is the one allowed piece and the result is that of merging.

Boundaries that no piece spans (before the space that starts a word, around characters that no longer piece has) are
points at which all ways meet; between two of them an encoding depends on the segment alone, so the search starts anew
there and workers remember what it gave for a segment.

Defined results: a null text counts as empty and has no ids; a character without piece becomes its UTF-8 bytes (or the
unknown id where the model has no byte pieces); decoding gives the text back, for every text that the model's
normalisation leaves as it is (identity models with byte pieces: all without the U+2581 sign, which stands for a space);
repeated rows each get their row; further columns are kept as they are, but for clashes with the output's names.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import REMEMBERED, lean, read, sliced

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Segments and neighbouring pairs that a worker remembers; it forgets all when there are more.
KEPT_SEGMENTS, KEPT_PAIRS = 350_000, 400_000
#: A segment that is longer is not remembered.
LONG_SEGMENT = 64
#: Characters between two looks at whether all ways meet.
LOOK_EVERY = 8
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The numbered fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class PieceModel:
    """A vocabulary with scores, read from a .model file."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.dummy_prefix, self.squeeze = UNIGRAM, True, True
        for number, value in fields(data):
            if number == 1:
                x = dict(fields(value))
                self.pieces.append(x.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                self.kinds.append(x.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                x = dict(fields(value))
                self.dummy_prefix, self.squeeze = bool(x.get(3, 1)), bool(x.get(4, 1))
                if x.get(2):
                    raise ValueError("a model with a character map is not supported: only identity normalisation is")
        self._prepare()

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            return cls(f.read())

    def _prepare(self) -> None:
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        self.ids = {self.pieces[i]: i for i in usable}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        #: Pairs of characters that some piece has side by side, and the characters of those.
        self.spans = {pair for p in self.ids for pair in zip(p, p[1:], strict=False)}
        self.within = {c for pair in self.spans for c in pair}
        self.unknown_score = min((self.scores[i] for i in usable), default=0.0) - 10
        order = {x: n for n, x in enumerate(sorted({-self.scores[i] for i in usable}))}
        self.rank = [order.get(-x, -1) if k in (NORMAL, USER) and len(p) > 1 else -1 for x, k, p in zip(self.scores, self.kinds, self.pieces, strict=True)]
        self._pairs: dict[int, bool] = {}

    # What merging leaves apart

    def merged(self, symbols: list[str], last: bool = False) -> list[str]:
        """Plain BPE: the pair of the best score merges, the leftmost first, until none is a piece. last: stops before the last merge of all."""
        symbols = list(symbols)
        while len(symbols) > 1 + last:
            best = max(((self.scores[self.ids[a + b]], -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.ids), default=None)
            if best is None:
                break
            i = -best[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    @cached_property
    def halves(self) -> dict[int, tuple[int, int]]:
        """The last merge that made each piece."""
        out = {}
        for p, i in self.ids.items():
            if len(p) > 1:
                found = self.merged(list(p), last=True)
                if len(found) == 2 and all(x in self.ids for x in found):
                    out[i] = self.ids[found[0]], self.ids[found[1]]
        return out

    def apart(self, a: int, b: int) -> bool:
        """Whether merging the characters of two pieces ends with the two."""
        got = self._pairs.get(a << 32 | b)
        if got is None:
            text = self.pieces[a] + self.pieces[b]
            got = self.merged(list(text)) == [self.pieces[a], self.pieces[b]] if SPACE * 2 in text else self._undone(a, b)
            if len(self._pairs) >= KEPT_PAIRS:
                self._pairs.clear()
            self._pairs[a << 32 | b] = got
        return got

    def _undone(self, a: int, b: int) -> bool:
        """Undoes the later merge at either side of the boundary, again and again: did a merge across come first?"""
        rank, halves, pieces, ids = self.rank, self.halves, self.pieces, self.ids
        limit, left_first = 1 << 60, False
        while True:
            across = ids.get(pieces[a] + pieces[b])
            if across is not None and (rank[across] < limit or left_first and rank[across] == limit):
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                limit, left_first, a = rank[a], False, halves[a][1]
            else:  # of equal merges the left one comes first
                limit, left_first, b = rank[b], True, halves[b][0]

    @cached_property
    def endings(self) -> dict:
        """A tree of the pieces' letters from the last to the first; a piece's id is under the empty letter. BPE: without pieces that merging can't give."""
        root: dict = {}
        for p, i in self.ids.items():
            if self.kind != BPE or len(p) == 1 or self.merged(list(p)) == [p]:
                node = root
                for c in reversed(p):
                    node = node.setdefault(c, {})
                node[""] = i
        return root

    # The search

    @staticmethod
    def path(window: list[str], end: int, back: list[int], found: list[int]) -> list[tuple[str, int]]:
        out, at = [], end
        while at > 0:
            out.append(("".join(window[at - back[at] : at]), found[at]))
            at -= back[at]
        return out[::-1]

    def ways(self, text: Iterable[str]) -> Iterator[tuple[str, int]]:
        """Streaming Viterbi: (piece, id) in order; an id of -1 is a character without piece. text: characters one by one."""
        window: list[str] = []  # the characters after the last committed boundary
        back, found, total, before = [0], [-1], [0.0], -1
        bpe, root, pairs, apart, longest = self.kind == BPE, self.endings, self._pairs, self.apart, self.longest
        n, look = 0, longest
        for c in text:
            window.append(c)
            n += 1
            if bpe:
                # Of the pieces that end here the longest that merging leaves apart from the one before it.
                node, at = root, n
                ids, places = [], []
                while at:
                    at -= 1
                    node = node.get(window[at])
                    if node is None:
                        break
                    if "" in node:
                        ids.append(node[""])
                        places.append(at)
                k, i = n - 1, -1
                while ids:
                    at, own = places.pop(), ids.pop()
                    left = found[at] if at else before
                    if left >= 0:
                        fits = pairs.get(left << 32 | own)
                        if fits is None:
                            fits = apart(left, own)
                        if not fits:
                            continue
                    k, i = at, own
                    break
                back.append(n - k)
                found.append(i)
            else:
                self.likeliest(window, n, back, found, total)
            if n < look:
                continue
            # All that the future can use are the last places; where do their ways meet?
            ends = {*range(n - longest + 1, n + 1)}
            while len(ends) > 1:
                last = max(ends)
                ends.discard(last)
                ends.add(last - back[last])
            meet = ends.pop()
            if meet:
                yield from self.path(window, meet, back, found)
                before = found[meet]
                del window[:meet], back[1 : meet + 1], found[1 : meet + 1]
                if not bpe:
                    del total[:meet]
                n -= meet
            look = max(n + LOOK_EVERY, longest)
        yield from self.path(window, n, back, found)

    def likeliest(self, window: list[str], n: int, back: list[int], found: list[int], total: list[float]) -> None:
        """Unigram: adds the way to place n of the largest sum; of equal ones the one with the longer last piece."""
        node, at, best, take, which = self.endings, n, float("-inf"), 1, -1
        one = False
        while at and (node := node.get(window[at - 1])) is not None:
            at -= 1
            if (i := node.get("")) is not None:
                one = one or at == n - 1
                if (s := total[at] + self.scores[i]) >= best:
                    best, take, which = s, n - at, i
        if not one and (s := total[n - 1] + self.unknown_score) > best:
            best, take, which = s, 1, -1
        back.append(take)
        found.append(which)
        total.append(best)

    def bytes_of(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unknown]

    def search(self, segment: str) -> list[int]:
        out: list[int] = []
        for piece, i in self.ways(segment):
            if i >= 0:
                out.append(i)
            elif self.byte_ids or not out or out[-1] != self.unknown:
                out += self.bytes_of(piece)
        return out

    @cached_property
    def segments(self):
        """Splits an escaped text at boundaries that no piece spans."""
        inner = {a for a, b in self.spans if b == SPACE and a != SPACE}
        if inner or not self.byte_ids:
            return lambda text: [text] if text else []
        lone = "".join(re.escape(c) for c in "\n\t\r" if c not in self.within)
        # Signs that no piece holds after anything but a space or another such sign: a segment ends before them.
        signs, before = {c for c in "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~\\" if c in self.within}, None
        while signs != before:
            before = set(signs)
            for a, b in self.spans:
                if b in signs and a not in signs and a != SPACE:
                    if a.isascii():
                        signs.discard(b)
                    else:
                        signs.add(a)
        signs = "".join(map(re.escape, sorted(signs)))
        rest = f"[^{SPACE}{lone}{signs}]"
        parts = ([f"{SPACE}*[{signs}]+{rest}*"] if signs else []) + [f"{SPACE}*{rest}+", f"{SPACE}+"] + ([f"[{lone}]"] if lone else [])
        return re.compile("|".join(parts)).findall

    def escaped(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)


class Encoder:
    """Encodes and decodes with remembered segments."""

    def __init__(self, model: PieceModel):
        self.model, self.known = model, {}
        self.of_id = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]

    def _new(self, segment: str) -> bytes:
        out = np.array(self.model.search(segment), np.int32).tobytes()
        if len(segment) <= LONG_SEGMENT:
            if len(self.known) >= KEPT_SEGMENTS:
                self.known.clear()
            self.known[segment] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        get, new = self.known.get, self._new
        return b"".join([get(s) or new(s) for s in self.model.segments(self.model.escaped(text))])

    def decode(self, ids: list[int] | np.ndarray) -> str:
        of = self.of_id
        out = b"".join([of[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if self.model.dummy_prefix and out[:1] == " " else out


ENCODED = "ids array<int>"
_ready: dict[int, Encoder] = REMEMBERED.setdefault(__name__, {})


def ready(data: bytes) -> Encoder:
    """The worker's encoder for a model: made once, as are its memories."""
    key = zlib.crc32(data)
    if key not in _ready:
        _ready.clear()
        _ready[key] = Encoder(PieceModel(data))
    return _ready[key]


def id_lists(got: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(g) // 4 for g in got)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), np.int32)))


def encoder(data: bytes, column: str, with_decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = ready(data)
        for batch in sliced(batches, column):
            got = [e.encode(t.as_py() or "") for t in batch.column(batch.schema.get_field_index(column))]
            cols, names = [*batch.columns, id_lists(got)], [*batch.schema.names, "ids"]
            if with_decoded:
                cols.append(pa.array([e.decode(np.frombuffer(g, np.int32).tolist()) for g in got], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def decoder(data: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = ready(data)
        for batch in batches:
            texts = [e.decode(x.as_py() or []) for x in batch.column(batch.schema.get_field_index("ids"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _model(path: str | None) -> bytes:
    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None, column: str = "text", with_decoded: bool = False) -> DataFrame:
    """docs with the ids of each text and, if wanted, what they decode to. path: of the .model file on the driver."""
    docs = docs.drop("ids", *["decoded"] * with_decoded)
    return docs.mapInArrow(lean(encoder(_model(path), column, with_decoded)), f"{_fields(docs)}, {ENCODED}" + ", decoded string" * with_decoded)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows with the text that their ids stand for."""
    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(lean(decoder(_model(path))), f"{_fields(encoded)}, decoded string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids, and whether they decode to its text."""
    return _round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"))


def _round_trip(docs: DataFrame) -> DataFrame:
    got = encode(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), with_decoded=True)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), (F.col("decoded") == F.col("text")).alias("round_trip"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: what is left, as ids."""
    return _round_trip(docs)
