"""Benchmark decontamination: documents that hold a benchmark item, up to a bounded number of word edits.

The CGK embedding walks along a sequence of words: at each step it puts out the word it stands on, and a random bit
of the step and the word says whether it moves on. Two sequences at a small edit distance give outputs at a small
Hamming distance, whatever the kind of edit, so equal outputs at a few sampled steps (a band of bit samples) are a
locality-sensitive hash of edit distance. Each item is embedded over windows of its own size class at its head, its
tail and in between, at as many shifts as documents skip words from one window of that size to the next. Documents
are scanned where they lie, against the items' keys; every hit is confirmed by the exact edit distance of the whole item.

Short items need no sketch: k edits leave one of k + 1 parts of an item as it is, so the texts are searched for each
part's words, and no place is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from periodica.llm.common import forget_words, mix, word_hashes

#: Scripts without blanks between words: Thai to Burmese, Khmer, kana, Chinese characters. Each character is a word.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U000323af"
WORD, MIXED = re.compile(r"\w+"), re.compile(rf"(?=\w)[{_ALONE}]|[^\W{_ALONE}]+")
#: Independent walks, bands per walk, sampled steps per band.
WALKS, BANDS, SAMPLES = 6, 6, 4
#: Words of a window; it starts at every half size. Longer items are covered by several windows.
SIZES = (2, 4, 8, 16, 32, 64)
#: A pass over the documents takes items of so many words together (or a single item); more items take more passes.
PASS_WORDS = 500_000
FILTER_BITS = 20
#: Windows that are embedded at once.
WINDOWS = 1 << 14


def words_of(text: str | None) -> list[str]:
    return (WORD if text.isascii() else MIXED).findall(text.lower()) if text else []


def _steps(size: int) -> int:
    """Steps of the walk over a window: it moves on every other step, and stays inside the window nearly always."""
    return max(1, int(size * 1.5))


def _samples(size: int) -> np.ndarray:
    """Sampled steps by walk and band; they are spread over the window, one in each part of it."""
    rng = np.random.default_rng(size)
    edges = np.linspace(0, _steps(size), SAMPLES + 1)
    return np.sort((edges[:-1] + rng.random((WALKS, BANDS, SAMPLES)) * np.diff(edges)).astype(int), axis=2)


def stride(size: int) -> int:
    return size // 2


def keys(tokens: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Band keys of the windows of ``size`` words at ``starts``: an array (walk x band, start).

    ``tokens`` are 64-bit word hashes, followed by enough others for a walk past the last window's end.
    """
    out = np.zeros((WALKS * BANDS, len(starts)), np.uint64)
    plan: dict[tuple[int, int], list[int]] = {}
    for (walk, band, _), step in np.ndenumerate(_samples(size)):
        plan.setdefault((walk, int(step)), []).append(walk * BANDS + band)
    odd = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for walk in range(WALKS):
            at = starts.copy()
            for step in range(_steps(size)):
                if step % 64 == 0:  # 64 random bits of each word, one for each of the next steps
                    random = mix(tokens + odd * np.uint64(16 * walk + step // 64 + 1))
                if step % 8 == 0:
                    bits = (random >> np.uint64(step % 64)).astype(np.uint8)
                for row in plan.get((walk, step), ()):
                    out[row] += tokens.take(at)
                    out[row] *= odd
                at += bits.take(at) >> (step % 8) & 1
        return mix(out + np.arange(WALKS * BANDS, dtype=np.uint64)[:, None] + np.uint64(1000 * size))


def edit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Least word edits between ``item`` and any part of ``region``, with that part's start and end."""
    n = len(region)
    ramp = np.arange(n + 1)
    cost, origin = np.zeros(n + 1, int), ramp.copy()
    for k, word in enumerate(item, 1):
        swap = np.concatenate([[k], cost[:-1] + (region != word)])
        left = np.concatenate([[0], origin[:-1]])
        drop = cost + 1
        best, start = np.where(swap <= drop, swap, drop), np.where(swap <= drop, left, origin)
        level = best - ramp  # words of the region that the item lacks: carry the best value on to the right
        low = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == low, ramp, 0))
        cost, origin = low + ramp, start[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(origin[end]), end


def part_keys(tokens: np.ndarray, size: int) -> np.ndarray:
    """A name of the ``size`` words at each place."""
    out = np.zeros(max(0, len(tokens) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix(out + tokens[k:k + len(out)])
    return out


def _parts(items: list[np.ndarray], share: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By size: sorted names of the parts of the items, with (item, place in it); k edits leave one of k + 1 parts."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for n, h in items:
        edges = np.linspace(0, len(h), min(int(share * len(h)) + 1, len(h)) + 1).astype(int).tolist()
        for a, b in zip(edges, edges[1:]):
            found.setdefault(b - a, []).append((int(part_keys(h[a:b], b - a)[0]), n, a))
    return {size: (np.array([f[0] for f in rows], np.uint64), np.array([f[1:] for f in rows])) for size, rows in
            ((size, sorted(f)) for size, f in found.items())}


def item_table(items: list[tuple[int, list[str]]], share: float = 0.2, least: int = 8) -> dict:
    """Keys of the items of one pass, sorted by key, and a bit table that most other keys miss; parts of the short ones."""
    hashes = [word_hashes(w) for _, w in items]
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for n, h in enumerate(hashes):
        if len(h) < least:
            continue
        size = max(s for s in SIZES if s + stride(s) - 1 <= max(len(h), SIZES[0]))
        last = len(h) - size - stride(size) + 1
        firsts = {max(0, a) for a in (*range(0, last, size), last)}
        starts = np.array(sorted({min(a + k, len(h) - 1) for a in firsts for k in range(stride(size))}), np.int64)
        got = keys(np.concatenate([h, np.zeros(max(SIZES) * 2, np.uint64)]), starts, size)
        where = np.stack([np.full(len(starts), n), starts], axis=1)
        found.setdefault(size, []).append((got.ravel(), np.tile(where, (len(got), 1))))
    table = {}
    for s, parts in found.items():
        key, where = np.concatenate([k for k, _ in parts]), np.concatenate([w for _, w in parts])
        order = np.argsort(key, kind="stable")
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        mine = [hashes[n] for n in np.unique(where[:, 0])]
        words = np.zeros(1 << FILTER_BITS, bool)
        words[(np.concatenate(mine) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        table[s] = (key[order], where[order], bits, words, _stretches([len(h) for h in mine], share))
    return {"ids": [i for i, _ in items], "hashes": hashes, "sets": [set(h.tolist()) for h in hashes], "table": table,
            "short": {n for n, h in enumerate(hashes) if len(h) < least}, "parts": _parts([(n, h) for n, h in enumerate(hashes) if len(h) < least], share)}


def _stretches(lengths: list[int], share: float) -> list[tuple[int, int]]:
    """(words, item words): an item among those of these lengths stands in so many words, of which at least so many are the items'.

    Lengths within a quarter of each other share an entry, with the longest one's words and the shortest one's need.
    """
    found: list[tuple[int, int]] = []
    for n in sorted(set(lengths)):
        if not found or n > 1.25 * found[-1][0]:
            found.append((n, n))
        found[-1] = (found[-1][0], n)
    return [(high + int(share * high), low - int(share * low)) for low, high in found]


def _covered(at: np.ndarray, length: int) -> np.ndarray:
    """The places within ``length`` places from a true one on."""
    edge = np.zeros(len(at) + length, np.int32)
    edge[:len(at)] += at
    edge[length:] -= at
    return np.cumsum(edge[:len(at)]) > 0


def _possible(tokens: np.ndarray, words: np.ndarray, stretches: list[tuple[int, int]]) -> np.ndarray:
    """The places at which an item can stand: inside a stretch with as many words of the items as any match of one needs."""
    upto = np.concatenate([[0], np.cumsum(words.take((tokens >> np.uint64(64 - FILTER_BITS)).astype(np.int64)), dtype=np.int32)])
    places = np.arange(len(tokens))
    found = np.zeros(len(tokens), bool)
    for length, need in stretches:
        found |= _covered(upto.take(np.minimum(places + length, len(tokens))) - upto[:-1] >= need, length)
    return found


def candidates(texts: list[np.ndarray], items: dict) -> dict[int, set[tuple[int, int]]]:
    """(item, word at which it would start) by text, for texts that share a band key with an item.

    The texts' words are laid end to end, so that few array operations serve many texts; a window that runs into
    the next text just sees other words. Windows at places where no item can stand are left out before the walks,
    and so are the words that no walk comes to.
    """
    lengths = np.array([len(t) for t in texts])
    firsts = np.cumsum(lengths) - lengths
    padded = np.concatenate([*texts, np.zeros(max(SIZES) * 2, np.uint64)])
    tries: dict[int, set[tuple[int, int]]] = {}
    for size, (key, where, bits, words, stretches) in items["table"].items():
        starts = np.concatenate([np.arange(f, f + n, stride(size)) for f, n in zip(firsts, lengths, strict=True)]).astype(np.int64)
        starts = starts[_possible(padded, words, stretches)[starts]]
        walked = np.zeros(len(padded), bool)
        walked[starts] = True
        walked = _covered(walked, _steps(size) + 1)
        near, moved = padded[walked], np.cumsum(walked) - 1
        for at in range(0, len(starts), WINDOWS):
            some = starts[at:at + WINDOWS]
            base = moved[some[0]]
            got = keys(near[base:moved[some[-1]] + _steps(size) + 1], moved[some] - base, size)
            row, col = np.nonzero(bits.take((got >> np.uint64(64 - FILTER_BITS)).astype(np.int64)))
            if len(row):
                value = got[row, col]
                low, high = np.searchsorted(key, value, "left"), np.searchsorted(key, value, "right")
                for i in np.nonzero(high > low)[0]:
                    start = some[col[i]]
                    text = int(np.searchsorted(firsts, start, "right")) - 1
                    for n, offset in where[low[i]:high[i]]:
                        tries.setdefault(text, set()).add((int(n), int(start - firsts[text] - offset)))
    for size, (key, where) in items["parts"].items():
        got = part_keys(padded, size)
        low, high = np.searchsorted(key, got, "left"), np.searchsorted(key, got, "right")
        for start in np.nonzero(high > low)[0]:
            text = int(np.searchsorted(firsts, start, "right")) - 1
            if text >= 0 and start - firsts[text] + size <= lengths[text]:
                for n, offset in where[low[start]:high[start]]:
                    tries.setdefault(text, set()).add((int(n), int(start - firsts[text] - offset)))
    return tries


def matches(tokens: np.ndarray, tries: set[tuple[int, int]], items: dict, share: float) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of each item confirmed in a text's words; of overlapping finds of an item the best."""
    best: dict[int, list[tuple[int, int, int]]] = {}
    for n, start in sorted(tries):
        item = items["hashes"][n]
        most = int(share * len(item))
        low = max(0, start - most)
        if n not in items["short"] and any(s <= start < e for s, e, _ in best.get(n, ())):
            continue
        region = tokens[low:max(0, start + len(item) + most)]
        if len(items["sets"][n].difference(region.tolist())) > most:  # each of these words takes an edit
            continue
        edits, begin, end = edit_distance(item, region)
        if edits <= most:
            best.setdefault(n, []).append((low + begin, low + end, edits))
    out = []
    for n, spans in best.items():
        kept: list[tuple[int, int, int]] = []
        for span in sorted(spans, key=lambda s: (s[2], s[0])):
            if all(span[1] <= s or span[0] >= e for s, e, _ in kept):
                kept.append(span)
        out += [(n, *span) for span in sorted(kept)]
    return sorted(out)


def _groups(texts: pa.Array) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(row, word hashes) of the texts with words, some hundred thousand words at a time."""
    some: list[tuple[int, np.ndarray]] = []
    held = 0
    for at, text in enumerate(texts):
        if words := words_of(text.as_py()):
            some.append((at, word_hashes(words)))
            held += len(words)
            if held >= 8 * WINDOWS:
                yield some
                some, held = [], 0
    if some:
        yield some


def _passes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, list[str]]]]:
    """Items in id order, as many at a time as ``PASS_WORDS`` holds; the driver holds one pass."""
    some: list[tuple[int, list[str]]] = []
    held = 0
    for row in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).distinct().orderBy("i", "t").toLocalIterator():
        words = words_of(row["t"])
        if not words:
            continue
        if some and held + len(words) > PASS_WORDS:
            yield some
            some, held = [], 0
        some.append((row["i"], words))
        held += len(words)
    if some:
        yield some


def _found(texts: pa.Array, items: dict, share: float) -> Iterator[tuple[int, tuple[int, int, int, int]]]:
    """(row, match) of all texts of a batch."""
    for some in _groups(texts):
        for n, tries in sorted(candidates([w for _, w in some], items).items()):
            at, tokens = some[n]
            for hit in matches(tokens, tries, items, share):
                yield at, hit


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", share: float = 0.2, least: int = 8) -> DataFrame:
    """Rows (id, item_id, word_start, word_end, item_words, edits), one for each place where an item stands in a document.

    Words are the runs of letters, digits and underscores, in lower case; a character of a script without blanks is a
    word. An item of n words is found where at most ``share * n`` words must be inserted, removed or exchanged. Items
    of fewer than ``least`` words are sought in an exact way; those without words are not looked for. Null and empty texts hold nothing; rows that repeat an id are searched each.
    An empty benchmark gives no rows. Other columns of the input are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([T.StructField(id_col, source.schema["_id"].dataType), *[
        T.StructField(c, T.LongType()) for c in (item_col, "word_start", "word_end", "item_words", "edits")]])
    names = schema.names
    out = None
    for some in _passes(benchmark, item_col, item_text):
        held = spark.sparkContext.broadcast(item_table(some, share, least))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in batches:
                rows = [(at, items["ids"][n], start, end, len(items["hashes"][n]), edits)
                        for at, (n, start, end, edits) in _found(batch.column(1), items, share)]
                columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(6)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(columns[0]), *columns[1:]], names=names)
            forget_words()

        part = source.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
          share: float = 0.2, least: int = 8) -> DataFrame:
    """The documents, all columns, that hold no benchmark item (see ``contamination``); decided where they are read."""
    at = docs.columns.index(text_col)
    for some in _passes(benchmark, item_col, item_text):
        held = docs.sparkSession.sparkContext.broadcast(item_table(some, share, least))

        def sift(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, _ in _found(batch.column(at), held.value, share)]] = False
                yield batch.filter(pa.array(keep))
            forget_words()

        docs = docs.mapInArrow(sift, docs.schema)
    return docs
