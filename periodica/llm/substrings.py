"""Substring dedup: units of text are normalised and named by a digest; the earliest of equal units stays.

Units are lines, cut further at sentence ends, since copied passages often stand inside a line and sentences travel
with them. Short sentences are joined with each other and with the sentence before them; lines that begin with a short
one, and paragraphs and documents with short lines, are units too, so that exact copies of these go whole.
Only digests and offsets are shuffled; texts come back for the documents that change.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.llm.common import text_key
from periodica.session import materialise

CUT = re.compile(r"[.!?][ \t]+|\n+")
WORD = re.compile(r"[^\W_]+")
LEAST_WORDS = 6
#: Letters and digits that stand for a word each in scripts without blanks, where a line is one word.
WORD_CHARS = 8


class Part:
    """A stretch of a text and its normalised words."""

    __slots__ = ("start", "end", "norm", "words", "line", "paragraph")

    def __init__(self, start: int, end: int, words: list[str], line: int, paragraph: int):
        self.start, self.end, self.line, self.paragraph = start, end, line, paragraph
        self.norm, self.words = " ".join(words), len(words)

    def join(self, other: Part) -> None:
        if not self.words:
            self.norm, self.line, self.paragraph = other.norm, other.line, other.paragraph
        elif other.words:
            self.norm = f"{self.norm} {other.norm}"
        self.end, self.words = other.end, self.words + other.words

    def enough(self, least: int) -> bool:
        return self.words >= least or len(self.norm) - self.words + 1 >= WORD_CHARS * least


def parts(text: str, least: int = LEAST_WORDS) -> list[Part]:
    """Parts that laid end to end are the text: sentences of enough words, and short ones between them.

    Words are letters and digits in lower case. Short sentences that follow each other in a line are joined from the
    left until they are enough. What holds no words goes with the part before it, at the start of the text with the
    one after.
    """
    found: list[Part] = []
    start = line = paragraph = 0
    for end in [*(m.end() for m in CUT.finditer(text)), len(text)]:
        if end == start:
            continue
        new = Part(start, end, WORD.findall(text[start:end].lower()), line, paragraph)
        last = found[-1] if found else None
        if last and (not new.words or not last.words or (last.line == line and not last.enough(least) and not new.enough(least))):
            last.join(new)
        else:
            found.append(new)
        newlines = text.count("\n", start, end)
        line, paragraph, start = line + (newlines > 0), paragraph + (newlines > 1), end
    return found


def whole(found: list[Part]) -> Part:
    out = Part(found[0].start, found[-1].end, [], found[0].line, found[0].paragraph)
    out.norm, out.words = " ".join(p.norm for p in found if p.words), sum(p.words for p in found)
    return out


def units(text: str, least: int = LEAST_WORDS) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised words) of a text's units.

    These are its parts of enough words, alone and with the short part that follows in the line; lines of enough words
    that begin with a short part; paragraphs (between empty lines) of enough words that hold a shorter line; and the
    text itself, if it holds a shorter paragraph. So units lie inside each other or apart, and the inner one of two
    has fewer words.
    """
    found = parts(text, least)
    short = False
    for _, paragraph in groupby(found, lambda p: p.paragraph):
        lines, low = [], False
        for _, line in groupby(paragraph, lambda p: p.line):
            line = list(line)
            for n, part in enumerate(line):
                if part.enough(least):
                    yield part.start, part.end, part.norm
                elif n:
                    both = whole(line[n - 1:n + 1])
                    yield both.start, both.end, both.norm
            full = whole(line)
            lines.append(full)
            if not full.enough(least):
                low = low or full.words > 0
            elif not line[0].enough(least):
                yield full.start, full.end, full.norm
        if low:
            full = whole(lines)
            if full.enough(least):
                yield full.start, full.end, full.norm
            else:
                short = True
    if short:
        full = whole(found)
        yield full.start, full.end, full.norm


def _digests(docs: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(4)]
            for at, value in enumerate(batch.column(2)):
                for start, end, norm in units(value.as_py() or "", least):
                    for column, x in zip(rows, (at, start, end, xxhash.xxh3_128_digest(norm.encode("utf-8", "replace"))), strict=True):
                        column.append(x)
                if len(rows[0]) > 100_000:
                    yield _rows(batch, rows)
                    rows = [[] for _ in range(4)]
            yield _rows(batch, rows)

    return docs.mapInArrow(run, "doc long, key long, start int, end int, digest binary")


def _rows(batch: pa.RecordBatch, rows: list[list]) -> pa.RecordBatch:
    owner = pa.array(rows[0], pa.int64())  # the texts stay behind
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(owner), batch.column(1).take(owner), *[pa.array(c, pa.int32()) for c in rows[1:3]], pa.array(rows[3], pa.binary())],
        names=["doc", "key", "start", "end", "digest"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents with ``doc``, the id as rank (a null id comes last), and ``key``, the name of the text."""
    last = F.lit(2 ** 63 - 1)
    return docs.select("*", F.coalesce(F.col(id_col).cast("long"), last).alias("_doc"), text_key(text_col).alias("_key"))


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """(doc, key, start, end, first_doc, first_start) of every unit that is not the earliest of its kind.

    Units rank by document id, then by place; see ``units`` for what they are. Offsets count code points of the
    original text. Rows that repeat id and text are one document and get the same result. ``key`` names the text,
    so that rows of one id with different texts are told apart.
    """
    source = _keyed(docs, id_col, text_col).select("_doc", "_key", F.col(text_col).cast("string").alias("_text"))
    held = materialise(_digests(source, least), "units")
    rank = F.struct("doc", "start", "key")
    firsts = held.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).filter("first <> last")
    return held.join(firsts, "digest").filter(rank != F.col("first")).select(
        "doc", "key", "start", "end", F.col("first.doc").alias("first_doc"), F.col("first.start").alias("first_start"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """The changed documents: all their columns with the text's later copies removed, n_removed, removed (spans).

    Spans are [start, end) pairs of the original text; a span inside another is left out. A document whose units all go
    keeps an empty text, however long it was. Clashing columns of the input named like the results are replaced.
    Documents without a copy, null and empty texts among them, are not in the result: they stay as they are.
    """
    cut = repeated_units(docs, id_col, text_col, least).select("doc", "key", "start", "end").distinct().groupBy("doc", "key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    keyed = _keyed(docs.drop("removed", "n_removed"), id_col, text_col)
    changed = keyed.join(cut.withColumnsRenamed({"doc": "_doc", "key": "_key"}), ["_doc", "_key"])
    return _without(changed.drop("_doc", "_key"), text_col).withColumn("n_removed", F.size("removed").cast("long"))


def outermost(spans: list[dict]) -> list[dict]:
    """The spans that lie in no other one, by start. Spans of one list lie inside each other or apart."""
    kept: list[dict] = []
    for span in sorted(spans, key=lambda r: (r["start"], -r["end"])):
        if not kept or span["end"] > kept[-1]["end"]:
            kept.append(span)
    return kept


def _without(docs: DataFrame, text_col: str) -> DataFrame:
    names = docs.columns
    at, spans = names.index(text_col), names.index("removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = [], []
            for text, found in zip(batch.column(at).to_pylist(), batch.column(spans).to_pylist(), strict=True):
                removed = outermost(found)
                cuts.append(removed)
                edges = [0, *(x for r in removed for x in (r["start"], r["end"])), len(text)]
                texts.append("".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            out = batch.set_column(at, names[at], pa.array(texts, batch.schema.field(at).type))
            yield out.set_column(spans, names[spans], pa.array(cuts, batch.schema.field(spans).type))

    return docs.mapInArrow(run, docs.schema)
