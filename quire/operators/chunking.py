"""Books cut into passages that can be cited: one stream a book, blocks, packing, overlaps, byte offsets that can be verified.

Offsets are bytes of the stream's UTF-8. A book is a bounded group; its pages are worked on in order by one task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import params

LOWER_END = re.compile(r"[^\W\d_A-Z][-]$")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=\S)")
#: Words after which a full stop ends no sentence.
ABBREVIATIONS = ("mr", "mrs", "dr", "st", "no", "vol", "oz", "etc")


def assemble(pages: list[tuple[int, str]]) -> tuple[str, list[tuple[int, int, int]]]:
    """The stream of (page, text) in order, and each page's byte span (page, start, end).

    A word cut by a hyphen at a page's end is joined; after a lower-case letter or , ; : the text runs on; else a new paragraph begins.
    """
    parts: list[str] = []
    spans: list[tuple[int, int, int]] = []
    size, tail = 0, ""
    for page, text in pages:
        text = text or ""
        joint = ""
        if parts:
            if len(tail) > 1 and tail[-1] == "-" and tail[-2].islower() and text[:1].islower():
                parts[-1] = parts[-1][:-1]
                size -= 1
                p, a, z = spans[-1]
                spans[-1] = (p, a, z - 1)
            elif tail and (tail[-1].islower() or tail[-1] in ",;:"):
                joint = " "
            else:
                joint = "\n\n"
        parts.append(joint + text)
        n = len(text.encode())
        start = size + len(joint)
        spans.append((page, start, start + n))
        size = start + n
        tail = text or tail
    return "".join(parts), spans


def streams(pages: DataFrame) -> DataFrame:
    """book, stream and spans of pages(book, page, text)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page")
        stream, spans = assemble(list(zip(pdf["page"], pdf["text"], strict=True)))
        return pd.DataFrame({"book": [pdf["book"].iloc[0]], "stream": [stream], "spans": [[{"page": int(p), "start": a, "end": z} for p, a, z in spans]]})

    return pages.groupBy("book").applyInPandas(run, "book long, stream string, spans array<struct<page:long,start:long,end:long>>")


def checksums(assembled: DataFrame) -> DataFrame:
    """book and the SHA-256 of its stream's bytes: whether chunks were cut from this very stream."""
    return assembled.select("book", F.sha2(F.encode("stream", "UTF-8"), 256).alias("checksum"))


def within_ceilings(chunked: DataFrame) -> DataFrame:
    """The chunks as they are; one that is too long, or has too many tokens, stops the query."""
    lost = F.concat(F.lit("chunk "), F.col("chunk").cast("string"), F.lit(" of book "), F.col("book").cast("string"), F.lit(" is over a ceiling"))
    over = (F.octet_length("text") > params.CHUNK_MAX) | (F.col("tokens") > params.CHUNK_MAX_TOKENS)
    return chunked.withColumn("text", F.when(over, F.raise_error(lost).cast("string")).otherwise(F.col("text")))


def tokens(text: str) -> int:
    words = len(text.split())
    return max(math.ceil(len(text) / params.CHARS_PER_TOKEN), math.ceil(words * 1.4)) + math.ceil(len(re.findall(r"[0-9]+", text)) * 0.5) + math.ceil((len(text) - len(text.encode("ascii", "ignore"))) * 0.4)


CONTENT_CHARS = max(240, params.CHUNK_MAX - params.CHUNK_OVERLAP)
CONTENT_TOKENS = max(60, params.CHUNK_MAX_TOKENS - params.PREFIX_RESERVE - math.ceil(params.CHUNK_OVERLAP / params.CHARS_PER_TOKEN))


def fits(text: str) -> bool:
    return len(text.encode()) <= CONTENT_CHARS and tokens(text) <= CONTENT_TOKENS


def paragraphs(stream: str) -> Iterator[tuple[int, int]]:
    """Character spans of trimmed paragraphs."""
    at = 0
    for m in [*re.finditer(r"\n[ \t]*\n", stream), None]:
        end = m.start() if m else len(stream)
        text = stream[at:end]
        if text.strip():
            yield at + len(text) - len(text.lstrip()), at + len(text.rstrip())
        at = m.end() if m else end


def cuts(text: str) -> Iterator[list[int]]:
    """Places to cut, from the gentlest kind to the hardest."""
    ends = [m.end() for m in SENTENCE_END.finditer(text) if text[: m.start()].rsplit(None, 1)[-1].rstrip(".").lower() not in ABBREVIATIONS and not re.search(r"\b\w\.$", text[: m.start()])]
    yield ends
    yield [m.end() for m in re.finditer(r"\n\s*", text)]
    yield [m.end() for m in re.finditer(r"\s+", text)]
    yield list(range(1, len(text)))


def fitted(stream: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The span in pieces that fit."""
    while start < end and (end - start > CONTENT_CHARS or not fits(stream[start:end])):
        text = stream[start : min(end, start + CONTENT_CHARS + 1)]  # no piece is longer
        for places in cuts(text):
            low, high, best = 0, len(places) - 1, 0
            while low <= high:
                mid = (low + high) // 2
                if fits(text[: places[mid]].rstrip()):
                    best, low = places[mid], mid + 1
                else:
                    high = mid - 1
            if best:
                yield start, start + len(text[:best].rstrip())
                start += best
                break
        else:
            yield start, end
            return
    if start < end:
        yield start, end


def packed(stream: str) -> list[tuple[int, int]]:
    """Spans of chunks: blocks until the target is reached or a block no longer fits; what is too small joins the one before where it can."""
    out: list[tuple[int, int]] = []
    for a, z in (piece for p in paragraphs(stream) for piece in fitted(stream, *p)):
        if out and z - out[-1][0] > 0:
            first = out[-1][0]
            if len(stream[first : out[-1][1]].encode()) < params.CHUNK_TARGET and fits(stream[first:z]):
                out[-1] = (first, z)
                continue
        out.append((a, z))
    if len(out) > 1 and len(stream[out[-1][0] : out[-1][1]].encode()) < params.CHUNK_MIN and fits(stream[out[-2][0] : out[-1][1]]):
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def overlap(stream: str, first: int, start: int) -> int:
    """Where a chunk's overlap begins: at most 200 bytes before, at a sentence or else a word, not before the previous chunk."""
    at = max(first, start - params.CHUNK_OVERLAP)
    while at < start and len(stream[at:start].encode()) > params.CHUNK_OVERLAP:
        at += 1
    text = stream[at:start]
    for pattern in (SENTENCE_END, re.compile(r"\s+")):
        if m := pattern.search(text):
            return at + m.end()
    return start


def chunks(pages: DataFrame) -> DataFrame:
    """book, chunk, text with its overlap, byte offsets of text and content, and the pages that the content touches."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page")
        stream, spans = assemble(list(zip(pdf["page"], pdf["text"], strict=True)))
        rows, before, at, offset = [], 0, 0, 0

        def byte(k: int) -> int:
            nonlocal at, offset
            offset += len(stream[at:k].encode()) if k >= at else -len(stream[k:at].encode())
            at = k
            return offset

        for n, (a, z) in enumerate(packed(stream)):
            o = overlap(stream, before, a) if n else a
            text = stream[o:z]
            if tokens(text) > params.CHUNK_MAX_TOKENS - params.PREFIX_RESERVE or len(text.encode()) > params.CHUNK_MAX:
                o, text = a, stream[a:z]
            start, content, end = byte(o), byte(a), byte(z)
            touched = [p for p, s, e in spans if s < end and e > content and s < e] or [max((p for p, s, _ in spans if s <= content), default=0)]
            rows.append((int(pdf["book"].iloc[0]), n, text, start, content, end, min(touched), max(touched), tokens(text)))
            before = a
        return pd.DataFrame(rows, columns=["book", "chunk", "text", "char_start", "content_start", "char_end", "page_from", "page_to", "tokens"])

    return pages.groupBy("book").applyInPandas(run, "book long, chunk int, text string, char_start long, content_start long, char_end long, page_from long, page_to long, tokens int")


def verify(chunked: DataFrame, assembled: DataFrame) -> DataFrame:
    """One row of counts that are all 0 for sound chunks: slices that differ, ceilings, inverted ranges, and bytes that no chunk covers."""
    data = F.encode("stream", "UTF-8")
    both = chunked.join(assembled.select("book", "stream"), "book")
    part = F.substring(data, (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int"))
    wrong = both.agg(
        F.count_if(part != F.encode("text", "UTF-8")).alias("wrong_slice"),
        F.count_if(F.octet_length("text") > params.CHUNK_MAX).alias("too_long"),
        F.count_if(F.col("tokens") > params.CHUNK_MAX_TOKENS).alias("too_many_tokens"),
        F.count_if(F.col("char_end") < F.col("content_start")).alias("inverted"),
    )
    solid = F.octet_length(F.regexp_replace("stream", "\\s", ""))
    kept = F.octet_length(F.regexp_replace(F.decode(F.substring(data, (F.col("content_start") + 1).cast("int"), (F.col("char_end") - F.col("content_start")).cast("int")), "UTF-8"), "\\s", ""))
    gaps = both.groupBy("book").agg(F.first(solid).alias("all"), F.sum(kept).alias("kept")).agg(F.count_if(F.col("all") != F.col("kept")).alias("gaps"))
    return wrong.join(F.broadcast(gaps))  # one row each


def distance_within(a: str, b: str, most: int) -> bool:
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most


def clusters(heads: DataFrame) -> DataFrame:
    """book, head, cluster: spellings of a head, the most frequent first, join the first cluster within a sixth of their length in edits."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("page")
        keys = pdf["head"].map(lambda h: re.sub(r"[\W_]+", " ", h.lower()).strip())
        counts = keys.groupby(keys, sort=False).size()
        leads: list[str] = []
        of: dict[str, str] = {}
        for key in sorted(counts.index, key=lambda k: -counts[k]):  # sorting keeps the order of appearance among equals
            of[key] = next((x for x in leads if distance_within(x, key, max(1, round(len(x) / 6)))), key)
            if of[key] == key:
                leads.append(key)
        return pd.DataFrame({"book": pdf["book"].iloc[0], "page": pdf["page"], "head": pdf["head"], "cluster": keys.map(of)})

    return heads.groupBy("book").applyInPandas(run, "book long, page long, head string, cluster string")


#: Families of headings in the order in which they are tried.
HEADINGS = [
    ("numbered", re.compile(r"^(?P<number>\d{1,4})[.)]\s+(?P<name>[^\W\d_][^.:;]{1,59}?)[.:]?$")),
    ("caps_line", re.compile(r"^(?P<name>[^a-zß-öø-ÿ\d]{4,60})$")),
    ("caps_prefix", re.compile(r"^(?P<name>[^\W\d_a-z][^a-z\d.]{3,40}?)[.—-]+\s*\S.*$")),
    ("title_line", re.compile(r"^(?P<name>(?:[A-Z][\w'’]+\s?){1,6})$")),
]
RECIPE_LINE = re.compile(r"^(\d|[½¼¾⅓⅔])|\b(oz|ounces?|dash(es)?|spoons?|spoonfuls?|glass(es)?)\b|\((use|take)\b", re.I)


def found_headings(text: str) -> Iterator[tuple[str, str, str | None, int]]:
    """(family, name, number, byte offset of the name) of a page's headings; families but the numbered need a recipe after them."""
    lines = text.split("\n")
    at = 0
    for n, line in enumerate(lines):
        bare = line.strip()
        if bare:
            following = next((x.strip() for x in lines[n + 1 :] if x.strip()), "")
            for family, pattern in HEADINGS:
                if m := pattern.match(bare):
                    if family in ("numbered", "caps_prefix") or RECIPE_LINE.search(following):
                        name = m["name"].strip()
                        yield family, name, m.groupdict().get("number"), at + len(line[: line.index(name)].encode())
                    break
        at += len(line.encode()) + 1


def headings(pages: DataFrame) -> DataFrame:
    """page, family, name, number, offset of every heading of pages(page, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *h) for p, t in zip(pdf["page"], pdf["text"], strict=True) for h in found_headings(t or "")]
            yield pd.DataFrame(rows, columns=["page", "family", "name", "number", "offset"])

    return pages.mapInPandas(run, "page long, family string, name string, number string, offset long")
