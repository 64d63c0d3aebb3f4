"""Best-fit packing of tokenised documents by bin completion.

Documents become token ids, ids become pieces of at most ``size``, and pieces are dealt by a hash of their row
number to groups of about ``GROUP`` pieces. A task packs one group: best-fit decreasing gives the first incumbent,
then bin completion looks for one with fewer sequences, as long as the waste bound allows one. The groups grow in
number with the corpus and not in size; each can cost at most one sequence that a single search might save.
"""

from __future__ import annotations

import json
import string
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from periodica.llm.common import FORGETTERS, give_back
from periodica.session import materialise

GROUP = 8_192
#: Bins that one search may fill before it returns its incumbent.
NODES = 20_000
#: Fillings that are tried for a bin, the fullest first.
BRANCHES = 6
CONTROL = "\x1c\x1d\x1e\x1f"


#: Bytes of words and ids, about, that a Python worker remembers, and bytes of texts that are encoded together.
CACHE_BYTES, TEXT_BYTES = 96 << 20, 4 << 20
#: New words that go to the tokenizer in one call: it holds some hundred bytes for each of their tokens meanwhile.
NEW_WORDS = 8_192
SEPARATOR = "|"


#: The pattern whose tokens are known to end where ASCII marks follow a letter or a digit.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _divides(tokenizer) -> bool:
    """Whether the tokenizer lowers all letters, cuts by ``SPLIT`` and has no added token without the separator."""
    made = json.loads(tokenizer.to_str())
    normal, pre = made["normalizer"] or {}, made["pre_tokenizer"] or {}
    steps = [normal, *normal.get("normalizers", ())]
    first = (pre.get("pretokenizers") or [pre])[0]
    return any(s.get("type") == "Lowercase" for s in steps) and first.get("pattern") == {"Regex": SPLIT} and all(
        SEPARATOR in t["content"] for t in made["added_tokens"])


@lru_cache(maxsize=4)
def encoder(path: str):
    """A function from texts to their ids, as little-endian unsigned 32-bit integers.

    White space ends every token of this kind of vocabulary (words are split there and the space is dropped), so
    the ids of a text are the ids of its words one after another and words can be remembered. A word's marks at its
    end are tokens of their own where they follow a letter or digit, and the case of ASCII letters is dropped, so new
    words are looked up by their stems first. New stems are encoded in one call, with a separator that is one token
    of its own between them; those that hold it, and texts with the separators U+001C to U+001F, which are white
    space to Python alone, go to the tokenizer by themselves.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    known: dict[str, bytes] = {}
    held = 0

    def whole(text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    mark = whole(SEPARATOR)
    divides = _divides(tokenizer)

    @lru_cache(maxsize=4096)
    def ends(char: str) -> bool:
        """Whether marks after this character are a token of their own; normalising may leave other than a letter."""
        return whole(char + "!").tobytes() == whole(char).tobytes() + whole("!").tobytes()

    def stem(word: str) -> tuple[str, str]:
        """A word's stem and the marks after it; words with the separator, like added tokens, stay as they are."""
        if SEPARATOR in word:
            return word, ""
        low = word.lower() if word.isascii() else word
        core = low.rstrip(string.punctuation)
        return (core, low[len(core):]) if core and len(core) < len(low) and ends(core[-1]) else (low, "")

    def tokens(words: list[str]) -> dict[str, bytes]:
        plain = [w for w in words if SEPARATOR not in w] if len(mark) == 1 else []
        found = {w: whole(w).tobytes() for w in set(words).difference(plain)}
        for first in range(0, len(plain), NEW_WORDS):
            some = plain[first:first + NEW_WORDS]
            ids = whole(f" {SEPARATOR} ".join(some))
            cuts = 4 * np.flatnonzero(ids == mark[0])
            data = ids.tobytes()
            found.update(zip(some, map(data.__getitem__, map(slice, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(data)])), strict=True))
        return found

    def learn(words: list[str]) -> dict[str, bytes]:
        nonlocal held
        if not divides:
            found = new = tokens(words)
        else:
            stems = list(map(stem, words))
            found = {s: known.get(s) for s in set(chain.from_iterable(stems))}
            found[""] = b""
            new = tokens([s for s, ids in found.items() if ids is None])
            found.update(new)
            found = {w: found[core] + found[rest] for w, (core, rest) in zip(words, stems, strict=True)}
        if held < CACHE_BYTES:
            new = {**new, **found}
            held += sum(map(len, new)) + sum(map(len, new.values())) + 180 * len(new)
            known.update(new)
        return found

    def encode(texts: pa.Array) -> list[bytes]:
        lists = pc.utf8_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        ids = list(map(known.get, distinct))
        new = learn([w for w, p in zip(distinct, ids, strict=True) if p is None])
        ids = [new[w] if p is None else p for w, p in zip(distinct, ids, strict=True)]
        # the ids of the distinct words one after another, gathered in the order of the texts
        flat, lengths = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = words.indices.to_numpy()
        sizes = lengths[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = flat[np.repeat((np.cumsum(lengths) - lengths)[at] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cuts = (4 * ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])]).tolist()
        out = [data[start:end] for start, end in pairwise(cuts)]
        for n in np.flatnonzero(pc.match_substring_regex(texts, f"[{CONTROL}]").to_numpy(zero_copy_only=False)).tolist():
            out[n] = whole(texts[n].as_py()).tobytes()
        return out

    return encode


#: An encoder outlives the tasks of its stage, which look up the same words; tasks of other operators end it.
FORGETTERS.append(encoder.cache_clear)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048,
           end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, the ids.

    A null or empty text gives the end id alone. Rows that repeat an id are documents of their own.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if keep_ids else [])
    schema = pa.schema(fields)
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[list] = [[] for _ in fields]
            size_to = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
            first = 0
            while first < batch.num_rows:
                before = size_to[first - 1] if first else 0
                some = batch.slice(first, max(1, int(np.searchsorted(size_to, before + TEXT_BYTES, "right")) - first))
                first += some.num_rows
                for doc, ids in zip(some.column(0).to_pylist(), encode(pc.fill_null(some.column(1), "")), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at:at + 4 * size]
                        values = [doc, piece, at // 4, len(part) // 4, zlib.crc32(part)]
                        for column, value in zip(rows, values + [np.frombuffer(part, "<u4").astype("i4")] * keep_ids, strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, fields, strict=True)], schema=schema)
        batch = some = rows = None
        give_back()

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return source.mapInArrow(cut, ddl)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best-fit decreasing: each length goes to the fullest bin that holds it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    for x in sorted(lengths, reverse=True):
        at = bisect_left(room, (x, -1))
        if at == len(room):
            bins.append([x])
            free, b = size - x, len(bins) - 1
        else:
            free, b = room.pop(at)
            bins[b].append(x)
            free -= x
        if free:
            insort(room, (free, b))
    return bins


def lower_bound(lengths: list[int], size: int) -> int:
    """Bins that any packing needs: by the sum, and by the lengths that no other long one can join."""
    ordered = sorted(lengths)
    sums = np.concatenate([[0], np.cumsum(ordered)])
    best = -(-int(sums[-1]) // size)
    for k in sorted({x for x in ordered if 2 * x <= size} | {0}):
        big = len(ordered) - bisect_right(ordered, size - k)
        half, low = bisect_right(ordered, size // 2), bisect_left(ordered, k)
        mid = len(ordered) - half - big
        rest = int(sums[half] - sums[low]) - (mid * size - int(sums[half + mid] - sums[half]))
        best = max(best, big + mid + max(0, -(-rest // size)))
    return best


def fillings(kinds: list[int], count: dict[int, int], room: int, slack: int) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room`` with at least ``room - slack``, the fullest first.

    ``kinds`` are the lengths at hand, ascending. A filling is dominated if a length left out fits in place of
    one that is in it.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    tries = [0]

    def walk(at: int, left: int, chosen: tuple[int, ...]) -> bool:
        tries[0] += 1
        at = min(at, bisect_right(kinds, left) - 1)
        nothing_fits = True
        while at >= 0 and tries[0] < 200:
            x = kinds[at]
            if count[x] > chosen.count(x):
                nothing_fits = False
                if walk(at, left - x, (*chosen, x)):
                    return True
                if len(found) >= BRANCHES:
                    return False
            at -= 1
        if nothing_fits and left <= slack and not dominated(chosen, left):
            found.append((left, chosen))
        return left == 0 and nothing_fits

    def dominated(chosen: tuple[int, ...], left: int) -> bool:
        for x in set(chosen):
            at = bisect_right(kinds, x + left) - 1
            if at >= 0 and kinds[at] > x and count[kinds[at]] > chosen.count(kinds[at]):
                return True
        return False

    walk(len(kinds) - 1, room, ())
    return [c for _, c in sorted(found, key=lambda f: f[0])[:BRANCHES]]


def complete(lengths: list[int], size: int, target: int, nodes: int = NODES) -> list[list[int]] | None:
    """At most ``target`` bins by depth-first bin completion, or None if the search ends without."""
    waste = target * size - sum(lengths)
    if waste < 0:
        return None
    count: dict[int, int] = {}
    for x in lengths:
        count[x] = count.get(x, 0) + 1
    kinds = sorted(count)

    def take(x: int) -> None:
        count[x] -= 1
        if not count[x]:
            kinds.pop(bisect_left(kinds, x))

    def give(x: int) -> None:
        if not count[x]:
            insort(kinds, x)
        count[x] += 1

    bins: list[list[int]] = []
    open_: list[tuple[list[tuple[int, ...]], int, int]] = []  # fillings still to try, the bin's largest, waste before it
    while kinds:
        nodes -= 1
        if nodes < 0:
            return None
        largest = kinds[-1]
        take(largest)
        ways = fillings(kinds, count, size - largest, waste)[::-1]
        while not ways:  # the waste bound is broken: undo bins until one has another filling
            give(largest)
            if not open_:
                return None
            for x in bins.pop()[1:]:
                give(x)
            ways, largest, waste = open_.pop()
        way = ways.pop()
        open_.append((ways, largest, waste))
        for x in way:
            take(x)
        bins.append([largest, *way])
        waste -= size - largest - sum(way)
    return bins


def pack_lengths(lengths: list[int], size: int, nodes: int = NODES) -> list[list[int]]:
    """Lengths per bin, in as few bins as the search finds."""
    best = best_fit(lengths, size)
    least = lower_bound(lengths, size)
    while len(best) > least and (better := complete(lengths, size, len(best) - 1, nodes)) is not None:
        best = better
    return best


def pack(parts: DataFrame, size: int = 2048, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``size``; the other columns stay.

    An empty table stays empty. The pieces are written once, so that row numbers hold when a task is run again.
    """
    held = materialise(parts.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    short = held.filter(F.col("length") < size)
    groups = max(1, -(-short.count() // group))
    schema = T.StructType([*held.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        lengths = rows["length"].to_pylist()
        waiting: dict[int, list[int]] = {}
        for row in np.argsort(rows["_row"].to_numpy())[::-1].tolist():
            waiting.setdefault(lengths[row], []).append(row)
        base = key[0].as_py() << 32
        sequence, offset = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
        for number, chosen in enumerate(pack_lengths(lengths, size)):
            at = 0
            for x in chosen:
                row = waiting[x].pop()
                sequence[row], offset[row] = base + number, at
                at += x
        out = rows.drop_columns(["_group"])
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = short.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    packed = dealt.groupBy("_group").applyInArrow(fill, schema)
    full = held.filter(F.col("length") >= size).select("*", (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full).drop("_row")
