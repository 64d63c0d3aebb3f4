"""The registered queries of the subpackage: equal to their SQL, or to brute force."""

import numpy as np
import pytest
from compare import compare, connect

from periodica.llm import packing, pii
from periodica.llm.queries import QUERIES, SQL, word_tokenizer


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], SQL[name], sf) is None


def test_packing_places_every_piece(spark, con, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    rows = QUERIES["op2_best_fit_packing"](spark, sf).collect()
    want = {}
    for doc, text in con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall():
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        import zlib
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            want[doc, p] = (at, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert len(ends) == packing.lower_bound([r.length for r in rows], 2048)


def test_decontamination_finds_every_exact_passage(spark, con, sf):
    import re
    norm = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    items = [(i, norm(t)) for i, t in con.execute("SELECT * FROM benchmark").fetchall()]
    want = {(d, i) for d, t in con.execute("SELECT doc_id, text FROM documents").fetchall() for i, p in items if p in norm(t)}
    got = QUERIES["op1_cgk_decontamination"](spark, sf).collect()
    assert want and {(r.doc_id, r.item_id) for r in got if r.edits == 0} == want


def test_personal_data_base_spans(spark, con, sf):
    import hashlib
    texts = dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    rows = QUERIES["op8_bootstrapped_pii"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = pii.shown(pii.base_spans(texts[r.doc_id]))
        assert hashlib.sha256(base.encode()).hexdigest() == r.base_sha256
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_language_on_held_out_documents(spark, con, sf):
    lang = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = QUERIES["op9_byte_cnn_language"](spark, sf).collect()
    held = [r for r in rows if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(rows) == len(lang) and len(held) > 20
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) >= 0.95


def test_nearest_recall(spark, con, sf):
    rows = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], "f4").astype("f8")
    got = {}
    for r in QUERIES["op10_hnsw_nearest"](spark, sf).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    asked = ids[ids % 20 == 0]
    assert sorted(got) == sorted(asked.tolist())
    hits = []
    for q in asked:
        score = x @ x[ids == q][0]
        other = ids != q
        best = ids[other][np.lexsort((ids[other], -score[other]))][:20]
        hits.append(len({v for v, _ in got[q].values()} & set(best.tolist())) / 20)
        assert all(abs(s - score[ids == v][0]) < 1e-12 for v, s in got[q].values())
    assert np.mean(hits) >= 0.9
