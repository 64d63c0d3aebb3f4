"""Personal data: base patterns, and identifiers found by bootstrapping on the words that stand before them.

A first pass marks the base entities of every text and all other tokens that look like identifiers, each with the
lexical patterns (one and two words) on its left. Patterns and values form a graph. Base values are the seeds: a
pattern's confidence in a kind is the share of its values that are known to be of that kind, a value's the chance that
one of its patterns is right. Spark scores the two in turn until no further value is accepted, and tokens that stand
behind a confident pattern are added to the spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodica.session import materialise

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
DIGIT = re.compile(r"[0-9]")
#: Tokens of this length or more, with so many digits or an inner @, look like identifiers.
SHORTEST, DIGITS = 5, 3
#: A pattern is trusted from this share of known values and this many of them on; a value from this chance on.
CONFIDENCE, SUPPORT, ACCEPT = 0.8, 3, 0.8


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the email pattern, sought from each @: the leftmost match begins where the run before the @ does."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = int(c) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) by start, then kind."""
    found = [(s, 0, e) for s, e in emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(found)


def left_patterns(text: str, start: int) -> list[str]:
    """The one and the two words before a place, in lower case, digits shown as 0; none at the text's start."""
    words = [DIGIT.sub("0", w)[-40:] for w in text[max(0, start - 120):start].lower().split()[-2:]]
    return [" ".join(words[-k:]) for k in (1, 2) if len(words) >= k]


def named(value: str) -> str:
    """A name of the whole value, in lower case."""
    return xxhash.xxh3_128_hexdigest(value.lower().encode("utf-8", "replace"))


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Base entities and identifier-like tokens outside of them, with their left patterns."""
    out = [{"start": s, "end": e, "kind": KINDS[k], "value": named(text[s:e]), "patterns": left_patterns(text, s)} for s, k, e in base]
    starts: list[int] = []
    ends: list[int] = []  # of the base spans, those that overlap put together
    for s, _, e in base:
        if starts and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for m in TOKEN.finditer(text):
        token = m[0]
        start = m.start() + len(token) - len(token.lstrip("([{<\"'"))
        end = m.end() - (len(token) - len(token.rstrip(".,;:!?)]}>\"'")))
        value = text[start:end]
        near = bisect_left(starts, end) - 1  # the last span that starts before the token's end
        if len(value) < SHORTEST or near >= 0 and ends[near] > start:
            continue
        if "@" in value[1:-1] or len(DIGIT.findall(value)) >= DIGITS:
            out.append({"start": start, "end": end, "kind": None, "value": named(value), "patterns": left_patterns(text, start)})
    return out


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _mark(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts, digests = [], [[] for _ in KINDS], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                found.append(mentions(text, base))
                digests.append(hashlib.sha256(shown(base).encode()).hexdigest())
                for k, column in enumerate(counts):
                    column.append(sum(b[1] == k for b in base))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(found, pa.list_(kind))],
                names=["_id", *[f"n_{k}" for k in KINDS], "base_sha256", "mentions"])

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    ddl = (f"_id {source.schema['_id'].dataType.simpleString()}, {kinds}, base_sha256 string, "
           "mentions array<struct<start: long, end: long, kind: string, value: string, patterns: array<string>>>")
    return source.mapInArrow(run, ddl)


def bootstrap(edges: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """(pattern, kind, confidence) of the trusted patterns, from distinct edges (pattern, value, kind; null: not base).

    Ends when a round accepts no new value; known values only grow, so there is such a round.
    """
    edges = materialise(edges.distinct(), "edges")
    totals = edges.select("pattern", "value").distinct().groupBy("pattern").agg(F.count("*").alias("total"))
    totals = materialise(totals.filter(F.col("total") >= support), "totals")
    known = materialise(edges.filter("kind is not null").select("value", "kind", F.lit(1.0).alias("chance")).distinct(), "known")
    seeds, size = known, known.count()
    links = edges.select("pattern", "value").distinct()
    while True:
        hits = links.join(known, "value").groupBy("pattern", "kind").agg(F.sum("chance").alias("hits"))
        scored = hits.join(totals, "pattern").withColumn("confidence", F.col("hits") / F.col("total"))
        trusted = materialise(scored.filter((F.col("hits") >= support) & (F.col("confidence") >= confidence)).select("pattern", "kind", "confidence"), "trusted")
        found = links.join(trusted, "pattern").groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("chance"))
        fresh = found.filter(F.col("chance") >= accept).join(seeds.select("value").distinct(), "value", "left_anti")
        known = materialise(seeds.unionByName(fresh.select("value", "kind", "chance")), "known")
        if known.count() == size:
            return trusted
        size = known.count()


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and digest are those of the base entities; ``spans`` lists them and the added ones as kind:start:end
    (code points, end exclusive), by start, then kind. A null or empty text has none. Rows that repeat an id are
    documents of their own.
    """
    held = materialise(_mark(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "mentions")
    every = held.select("_row", F.explode("mentions").alias("m")).select("_row", "m.*").withColumn("pattern", F.explode("patterns"))
    trusted = bootstrap(every.select("pattern", "value", "kind"), confidence, support)
    other = every.filter("kind is null").drop("kind", "value", "patterns")
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    best = other.join(trusted, "pattern").groupBy("_row", "start", "end").agg(F.max(F.struct("confidence", -number, "kind")).alias("best"))
    added = best.groupBy("_row").agg(F.collect_list(F.struct("start", F.col("best.kind").alias("kind"), "end")).alias("added"))
    base = F.transform(F.filter("mentions", lambda m: m["kind"].isNotNull()), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    none = F.expr("cast(array() as array<struct<start: bigint, kind: string, end: bigint>>)")
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.concat(base, F.coalesce("added", none))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return held.join(added, "_row", "left").select(
        F.col("_id").alias(id_col), *[f"n_{k}" for k in KINDS], "base_sha256", text.alias("spans"))
