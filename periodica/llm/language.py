"""Language identification by a byte convolutional network.

Texts are lower-cased bytes in fixed-length windows. Filters of several widths run over the byte embeddings, the
maximum over the window is kept for each filter, and softmax gives the languages' probabilities. The network is
trained in numpy on a bounded sample of labelled texts and applied to every window of every text in Arrow batches;
a text's probabilities are the mean over its windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodica.llm.common import forget_words

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 12
#: Windows that the network is applied to at once.
BATCH = 32
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


@dataclass
class Network:
    """Weights: embedding (256, e), per width a filter bank (width, e, filters) and bias, and the output layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width what each pair of bytes at places 0-1, 2-3, ... adds to each filter (an odd last byte alone).

        A convolution is then a sum of lookups.
        """
        single = [[(self.embedding @ bank[k]).astype("f4") for k in range(len(bank))] for bank in self.filters]
        return [[(one[k][:, None] + one[k + 1][None]).reshape(65536, -1) if k + 1 < len(one) else one[k]
                 for k in range(0, len(one), 2)] for one in single]


def windows(text: str, size: int = WINDOW) -> np.ndarray:
    """All of the text's bytes in rows of ``size``, the last one filled with spaces."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    out = np.full((-(-max(1, len(data)) // size), size), 32, np.uint8)
    out.reshape(-1)[:len(data)] = data
    return out


def probabilities(net: Network, tables: list[list[np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Class probabilities of windows (rows of bytes)."""
    pooled = []
    pairs = x[:, :-1].astype(np.intp) << 8 | x[:, 1:]
    for maps, width, bias in zip(tables, WIDTHS, net.biases, strict=True):
        n = x.shape[1] - width + 1
        total = maps[0].take(pairs[:, :n], axis=0)
        for k in range(1, len(maps)):
            at = pairs[:, 2 * k:2 * k + n] if len(maps[k]) > 256 else x[:, 2 * k:2 * k + n]
            total += maps[k].take(at, axis=0)
        pooled.append(np.maximum(total.max(axis=1) + bias, 0))
    z = np.concatenate(pooled, axis=1) @ net.out + net.out_bias
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], rounds: int = 6, per_text: int = 3, steps: int = 600, seed: int = 7) -> Network:
    """Adam on the cross entropy of single windows, up to ``per_text`` windows of each text; classes weigh the same.

    Runs ``rounds`` times over the windows, or more often until ``steps`` batches are done.
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    xs, ys = [], []
    for text, label in zip(texts, labels, strict=True):
        w = windows(text)
        pick = w if len(w) <= per_text else w[np.sort(rng.choice(len(w), per_text, replace=False))]
        xs.append(pick)
        ys += [names.index(label)] * len(pick)
    x, y = np.concatenate(xs), np.array(ys)
    weight = len(y) / (len(names) * np.bincount(y, minlength=len(names)))
    params = [rng.normal(0, 0.3, (256, EMBEDDING))]
    params += [rng.normal(0, (w * EMBEDDING) ** -0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS]
    params += [np.zeros(FILTERS) for _ in WIDTHS]
    params += [rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names))), np.zeros(len(names))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(max(rounds, -(-64 * steps // len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            rows = order[at:at + 64]
            grads = _gradients(params, x[rows], y[rows], weight[y[rows]])
            step += 1
            rate = 0.003 * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * m / (np.sqrt(v) + 1e-8)
    n = len(WIDTHS)
    return Network(names, params[0].astype("f4"), [p.astype("f4") for p in params[1:1 + n]],
                   [p.astype("f4") for p in params[1 + n:1 + 2 * n]], params[-2].astype("f4"), params[-1].astype("f4"))


def _gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Only the place of each filter's maximum takes part in the backward pass."""
    n, rows = len(WIDTHS), np.arange(len(y))
    emb, banks, biases, out, out_bias = params[0], params[1:1 + n], params[1 + n:1 + 2 * n], params[-2], params[-1]
    pooled, places = [], []
    for bank, bias in zip(banks, biases, strict=True):
        size = x.shape[1] - len(bank) + 1
        total = sum((emb @ bank[k])[x[:, k:k + size]] for k in range(len(bank)))
        best = total.argmax(axis=1)
        places.append(best)
        pooled.append(np.take_along_axis(total, best[:, None, :], 1)[:, 0] + bias)
    raw = np.concatenate(pooled, axis=1)
    act = np.maximum(raw, 0)
    z = act @ out + out_bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[rows, y] -= 1
    p *= (weight / len(y))[:, None]
    back = (p @ out.T) * (raw > 0)
    g_emb, g_banks, g_biases = np.zeros_like(emb), [], []
    for i, bank in enumerate(banks):
        g = back[:, i * FILTERS:(i + 1) * FILTERS]
        g_biases.append(g.sum(axis=0))
        g_bank = np.zeros_like(bank)
        for k in range(len(bank)):
            byte = x[rows[:, None], places[i] + k]
            g_bank[k] = np.einsum("bfe,bf->ef", emb[byte], g)
            np.add.at(g_emb, byte, g[..., None] * bank[k].T[None])
        g_banks.append(g_bank)
    return [g_emb, *g_banks, *g_biases, act.T @ p, p.sum(axis=0)]


def fit(docs: DataFrame, rows_per_class: int = 600, chars: int = 4_000, languages: int = 500, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on at most ``rows_per_class`` texts of each of the ``languages`` most frequent labels.

    The sample is bounded by these two and by the first ``chars`` characters of a text; nothing else of the
    operator is. It holds the rows with the smallest hashes of id and text: a bound on the hash, from the label's
    count, leaves some more rows than needed where they are read, and only those are ranked. The bound never leaves out
    a label's smallest hash, so each label is learned, whatever ids its rows have. Texts without a letter and
    rows without a language are not learned from. None without such rows.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    part = F.pmod(F.xxhash64(id_col, text_col, F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    sizes = known.groupBy(lang_col).agg(F.count(F.lit(1)).alias("count"), F.min(part).alias("least")).orderBy(
        F.col("count").desc(), lang_col).limit(languages).collect()
    if not sizes:
        return None
    below = F.create_map(*[x for r in sizes for x in (F.lit(r[0]), F.lit(max(r["least"], min(1.0, 2.0 * rows_per_class / r["count"]))))])
    some = known.filter(part <= below[F.col(lang_col)]).select(
        F.col(lang_col).alias("lang"), part.alias("part"), F.substring(text_col, 1, chars).alias("text"))
    order = Window.partitionBy("lang").orderBy("part", "text")
    kept = some.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows_per_class)
    pairs = [(r["text"], r["lang"]) for r in kept.orderBy("lang", "n").collect()]
    return train([t for t, _ in pairs], [lang for _, lang in pairs]) if pairs else None


def predict(docs: DataFrame, net: Network | None, text_col: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the language and its mean probability over all windows of the whole text.

    A text that is null or has no letter gets ``und`` with score 0; so does any text without a network. Columns of
    the documents that are named like the two results are replaced. Labels and ids are not read.
    """
    from pyspark.sql import types as T

    kept = [c for c in docs.columns if c not in (pred, score)]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)
    schema = T.StructType([*source.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(net)  # some kilobytes, whatever the corpus
    names = schema.names

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()  # what earlier stages have left in the worker
        model = held.value
        tables = model.tables() if model else []
        for batch in batches:
            found, sure = [], []
            waiting: list[tuple[int, np.ndarray]] = []
            sums = np.zeros((batch.num_rows, len(model.languages) if model else 1))
            counts = np.zeros(batch.num_rows, int)

            def flush() -> None:
                owner = np.concatenate([np.full(len(w), i) for i, w in waiting])
                every = np.concatenate([w for _, w in waiting])
                for k in range(0, len(every), BATCH):
                    np.add.at(sums, owner[k:k + BATCH], probabilities(model, tables, every[k:k + BATCH]))
                waiting.clear()

            for i, value in enumerate(batch.column(at)):
                text = value.as_py()
                if model and text and LETTER.search(text):
                    rows = windows(text)
                    counts[i] = len(rows)
                    waiting.append((i, rows))
                    if sum(len(w) for _, w in waiting[-64:]) >= 4 * BATCH or len(waiting) >= 64:
                        flush()
            if waiting:
                flush()
            for i in range(batch.num_rows):
                best = int(sums[i].argmax()) if counts[i] else -1
                found.append(model.languages[best] if best >= 0 else UNKNOWN)
                sure.append(min(1.0, float(sums[i, best] / counts[i])) if best >= 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(sure, pa.float64())], names=names)
        batch = tables = None
        forget_words()

    return source.mapInArrow(apply, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The quarter of the documents that nothing is learned from; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
