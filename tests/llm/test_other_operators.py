"""Packing, archives, vectors and the pipeline on small inputs."""

import itertools
import random

import numpy as np
import pytest
from test_text_operators import brute_components, brute_lines

from periodica.llm import ann, common, graph, packing, warc
from periodica.llm.queries import word_tokenizer


def fewest(lengths, size):
    for n in range(1, len(lengths) + 1):
        if any(max(np.bincount(w, lengths, n)) <= size for w in itertools.product(range(n), repeat=len(lengths))):
            return n
    return 0


def test_packing_is_optimal_on_small_sets():
    rng = random.Random(1)
    for _ in range(60):
        lengths = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 8))]
        bins = packing.pack_lengths(lengths, 20)
        assert sorted(x for b in bins for x in b) == sorted(lengths) and max(map(sum, bins)) <= 20
        assert len(bins) == fewest(lengths, 20) >= packing.lower_bound(lengths, 20)


def test_bin_completion_improves_best_fit():
    lengths = [6, 5, 4, 3, 2, 6, 5, 4, 3, 2] * 3 + [7, 3, 4, 6, 8, 2, 5, 5, 9, 1]
    rng = random.Random(3)
    better = 0
    for _ in range(200):
        sample = [rng.randrange(3, 12) for _ in range(20)]
        first, best = packing.best_fit(sample, 20), packing.pack_lengths(sample, 20)
        assert sorted(x for b in best for x in b) == sorted(sample) and max(map(sum, best)) <= 20 and len(best) <= len(first)
        better += len(best) < len(first)
    assert better and packing.pack_lengths(lengths, 10)


def test_pieces_of_odd_texts(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(word_tokenizer())
    texts = [None, "", "  ", "a|b | c ||", "it's <|endoftext|> here", "\x1ca b\x1d", "é　z", "ΑΣ Σ. İ 1a2", "word " * 5000]
    rows = [(n, t) for n, t in enumerate(texts)] + [(None, "x"), (1, "repeated id"), (1, "repeated id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as _group")
    got = packing.pack(packing.pieces(frame, word_tokenizer(), keep_ids=True)).collect()
    for n, t in enumerate(texts):
        if n != 1:
            ids = [i for r in sorted((r for r in got if r.doc_id == n), key=lambda r: r.piece) for i in r.ids]
            assert ids == [*whole.encode(t or "", add_special_tokens=False).ids, 0]
    assert len([r for r in got if r.doc_id == 1]) == 3 and len([r for r in got if r.doc_id is None]) == 1
    assert packing.pack(packing.pieces(frame.limit(0), word_tokenizer())).count() == 0


def test_words_with_marks_are_encoded_as_whole_texts(monkeypatch):
    """Stems and marks give the ids of whole texts; a word in other case or with other marks costs no encoding."""
    import pyarrow as pa
    import tokenizers

    path = word_tokenizer()
    whole = tokenizers.Tokenizer.from_file(path)
    texts = ["Deep, deep! DEEP", "it's, IT'S! dogs' dogs'. 'tis", "a|b, a| |", "\u0130, \u0130stanbul.", "\u0958, \u0958!", "e\u0301, \u00e9...",
             "\U0001f600!! \u2014, x_ _x_ 1, 12.5%", "\x1fa, b.", "\x00, \x7f! a\x00,", "<|endoftext|>, a<|endoftext|>. <|ENDOFTEXT|>, ", "!!! , |,", "", " \u3000 "]
    sent = []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        @classmethod
        def from_file(cls, path):
            return cls(whole)

        def to_str(self):
            return self.inner.to_str()

        def encode_batch_fast(self, texts, **how):
            sent.extend(texts)
            return self.inner.encode_batch_fast(texts, **how)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    encode = packing.encoder.__wrapped__(path)
    for _ in range(2):
        for text, ids in zip(texts, encode(pa.array(texts)), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
    encode(pa.array(["deep, tree,"]))
    sent.clear()
    encode(pa.array(["Tree, DEEP, TREE tree! deep!?!"]))
    assert sent == ["!?!"]
    assert encode(pa.array([], pa.string())) == []


def test_new_words_go_to_the_tokenizer_in_calls_of_bounded_size(monkeypatch):
    import pyarrow as pa
    import tokenizers

    path, sent = word_tokenizer(), []
    whole = tokenizers.Tokenizer.from_file(path)

    class Counted:
        to_str = staticmethod(whole.to_str)

        @classmethod
        def from_file(cls, path):
            return cls()

        def encode_batch_fast(self, texts, **how):
            sent.extend(len(t.replace(packing.SEPARATOR, " ").split()) for t in texts)
            return whole.encode_batch_fast(texts, **how)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    words = [f"{n}x" for n in range(20_000)]
    ids = packing.encoder.__wrapped__(path)(pa.array([" ".join(words)]))[0]
    assert np.frombuffer(ids, "<u4").tolist() == whole.encode(" ".join(words), add_special_tokens=False).ids
    assert max(sent) <= 8_192 and sum(sent) >= 20_000


def test_tasks_of_other_operators_end_the_encoder():
    common.word_hashes(["a word"])
    packing.encoder(word_tokenizer())
    common.forget_words()
    assert packing.encoder.cache_info().currsize == 0 and not common._HASHES


@pytest.mark.parametrize("split", ["128m", "2k"])
def test_archives(spark, tmp_path, split):
    big = "<p>" + "x" * 3000 + "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.0\r\n" + "é" * 700
    pages = [(n, f"http://h/{n}", c) for n, c in enumerate(["a" * 1000, "b" * 999, "b" * 999, "a" * 1000, big, None, "", big, "WARC/1.0\r\n\r\n\r\n" * 9, "c" * 70_000])]
    pages += [(None, None, "d" * 2000), (20, None, "d" * 2000), (None, "u", "e" * 2000), (None, "u", "e" * 2000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as value", "3 as id")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        warc.write(frame, f"{tmp_path}/w", rows_per_file=5)
        got = warc.read(spark, f"{tmp_path}/w").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    import hashlib
    want = sorted((f"<urn:page:{'none' if p is None else p}>", len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for p, _, h in pages)
    assert sorted((r.record, r.payload_bytes, r.payload_digest) for r in got) == want
    assert all(r.intact for r in got)
    refers = sorted((r.record, r.refers_to) for r in got if r.record_type == "revisit")
    assert refers == [("<urn:page:0>", "<urn:page:3>"), ("<urn:page:4>", "<urn:page:7>"), ("<urn:page:none>", "<urn:page:20>")]


@pytest.mark.parametrize("split", ["128m", "2k"])
def test_archives_with_adjacent_magic_lines(spark, tmp_path, split):
    import hashlib

    pages = [(n, "u", t) for n, t in enumerate([
        "a" * 3000, "WARC/1.0\r\nWARC/1.0\r\n", "b" * 1500, "x" + "WARC/1.0\r\n" * 500, "c", "WARC/1.0\r\n" * 2 + "y", "d" * 2000, "e"])]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/w")
        got = warc.read(spark, f"{tmp_path}/w").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.record, r.payload_digest) for r in got) == [(f"<urn:page:{n}>", hashlib.sha1(t.encode()).hexdigest()) for n, _, t in pages]
    assert all(r.intact for r in got)


def test_no_archives(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert warc.read(spark, f"{tmp_path}/w").count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(60)] + [(5, 5), (None, 1)]
    label = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    while any(label[a] != label[b] for a, b in edges if a in label and b in label):
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == label and len(got) == len(label)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 8)) * rng.uniform(0.5, 3, (900, 1))
    x[300:600] = x[0]  # a third of the rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2020, [0.0] * 8), (2040, [None] + [1.0] * 7), (2060, [float("nan")] * 8), (None, [1.0] * 8), (2080, [1.0, 2.0]), (2100, [2.0, 2.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as shard", "2 as id", "3 as dim")
    index = ann.build_index(frame, shard=250)
    got = {}
    for r in ann.nearest(index, frame.filter("vec_id % 20 = 0"), block=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.pop(2080) == [(1, 2100, 6.0)] and got.pop(2100) == [(1, 2080, 6.0)]
    hits, ids = [], np.arange(900)
    for q in range(0, 900, 20):
        score = (x * x[q]).sum(axis=1)
        best = [i for i in np.lexsort((ids, -score)) if i != q][:20]
        mine = [v for _, v, _ in sorted(got.pop(q))]
        assert len(mine) == 20
        hits.append(len(set(mine) & set(best)) / 20)
    assert not got and np.mean(hits) >= 0.97
    assert ann.nearest(ann.build_index(frame.limit(0)), frame.filter("vec_id % 20 = 0")).count() == 0


def test_vectors_beside_very_long_ones(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 24))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    x[3] *= 1e4
    x[7] *= 1e9
    x[11] *= 1e-6
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(ann.build_index(frame), frame.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits, ids = [], np.arange(1500)
    for q in range(0, 1500, 20):
        best = [i for i in np.lexsort((ids, -(x * x[q]).sum(axis=1))) if i != q][:20]
        hits.append(len(got[q] & set(best)) / 20)
    assert np.mean(hits) >= 0.97


def test_pipeline_stages_against_brute_force(spark, sf, tmp_path):
    import re

    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, held = docs.columns, [{r.doc_id: r for r in docs.collect()}]
    bench = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        held.append({r.doc_id: r for r in docs.collect()})
        assert name == "packing" or docs.columns == columns
    start, told, cut, near, clean, packed = held
    assert all(start[d].text == r.text for d, r in told.items()) and all(not re.search(r"[^\W\d_]", start[d].text or "") for d in set(start) - set(told))
    want = brute_lines([(d, r.text) for d, r in told.items()], 3)
    assert {d: r.text for d, r in cut.items()} == {d: t for d, t in want.items() if t.strip() or told[d].text == t}
    assert all(r.n_chars == len(r.text) for d, r in cut.items() if r.text != told[d].text)
    assert set(near) == {d for d, _, c in brute_components([(d, r.text) for d, r in cut.items()], 5, 80) if d == c}
    dirty = {d for d, r in near.items() if any(b in " ".join(re.findall(r"\w+", r.text.lower())) for b in bench)}
    assert set(near) - set(clean) == dirty and set(packed) == set(clean)
