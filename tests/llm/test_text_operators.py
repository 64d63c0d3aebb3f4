"""Text operators on small inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random
import re

import pytest

from periodica.llm import chat, decontamination, graph, language, lines, neardup, pii, substrings

SCHEMA = "doc_id long, text string"


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def brute_components(docs, k, percent):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    near = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if near(sets[i], sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (d, _), c in zip(docs, label, strict=True):
        least[c] = min(least.get(c, (1, 0)), (d is None, d or 0))
    return [(d, len(s), least[c][1] if s and not least[c][0] else (d if not s else None)) for (d, _), s, c in zip(docs, sets, label, strict=True)]


def near_documents():
    rng = random.Random(5)
    docs, n = [], 0
    for _ in range(12):
        base = words(rng, 60).split()
        for _ in range(rng.randrange(1, 9)):  # a drifting chain: neighbours are near, the ends are not
            docs.append((n, " ".join(base)))
            base[rng.randrange(60)] = "x%d" % n
            n += 1
    docs += [(n + 1, None), (n + 2, ""), (n + 3, " \t\n"), (n + 4, "one two"), (n + 5, "ONE  two"), (n + 6, "one"),
             (n + 7, docs[0][1]), (n + 7, docs[0][1]), (None, "free of any copy here"), (n + 8, words(rng, 30_000))]
    return docs


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    docs = near_documents()
    got = neardup.near_duplicates(spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as n", "2 as class", "3 as bucket"), k, percent).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(brute_components(docs, k, percent), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_bucket_of_many_mutually_different_documents_is_resolved(spark):
    """Documents that share half of their text meet in buckets without links; two true pairs hide among them."""
    rng = random.Random(9)
    shared = words(rng, 100)
    docs = [(n, shared + " " + words(rng, 60)) for n in range(150)]
    docs += [(200, docs[70][1] + " more"), (201, docs[71][1] + " more")]
    got = neardup.near_duplicates(spark.createDataFrame(docs, SCHEMA), 3, 85).filter("not kept").collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(200, 70), (201, 71)}


def hot_documents(size):
    """Copies of one text with 1 to 7 of its words replaced by some of few others: many are near it, many are not."""
    rng = random.Random(13)
    base, others = words(rng, 150).split(), words(rng, 6).split()
    docs = [(0, " ".join(base))]
    for n in range(1, size):
        text = list(base)
        for at in rng.sample(range(2, 148), 1 + n % 7):
            text[at] = rng.choice(others)
        docs.append((n, " ".join(text[n % 13 // 12 * 20:])))
    return docs


def test_a_large_group_of_near_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    """The pairs that go on to full sets follow the copies in number, not their square; no link is lost."""
    size, met = 300, []
    docs = hot_documents(size)
    confirm = neardup._confirm
    monkeypatch.setattr(neardup, "_confirm", lambda pairs, *rest: met.append(pairs.count()) or confirm(pairs, *rest))
    got = neardup.near_duplicates(spark.createDataFrame(docs, SCHEMA), 3, 85).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(brute_components(docs, 3, 85), key=key)
    assert sum(met) <= 25 * size, met  # 103 a copy when each leader met all of its bucket


def count_written(monkeypatch):
    written = []
    for module in (graph, neardup):
        keep = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, name, keep=keep: written.append(name) or keep(df, name))
    return written


def test_rounds_write_few_tables(spark, monkeypatch):
    """Each table is as many tasks as there are partitions, however small it is."""
    docs, written = hot_documents(300), count_written(monkeypatch)
    got = neardup.near_duplicates(spark.createDataFrame(docs, SCHEMA), 3, 85).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(docs, 3, 85))
    assert len(written) <= 24, written


def test_edges_that_are_stars_take_no_round(spark, monkeypatch):
    written = count_written(monkeypatch)
    star = [(9, 1), (1, 8), (7, 1), (5, 4), (6, 6), (3, None)]
    got = graph.components(spark.createDataFrame(star, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (4, 4), (5, 4), (7, 1), (8, 1), (9, 1)]
    assert written == ["edges"]
    got = graph.components(spark.createDataFrame([*star, (9, 5)], "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(n, 1) for n in (1, 4, 5, 7, 8, 9)]


def test_keep_one(spark):
    docs = [(2, "a b c d e f g h"), (2, "a b c d e f g h"), (1, "other words stand in this text here"), (None, "a b c d e f g h"), (4, None), (4, None)]
    got = neardup.keep_one(spark.createDataFrame(docs, SCHEMA).selectExpr("*", "doc_id as kept", "text as key")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, docs[2][1]), (2, docs[0][1]), (4, None)]
    assert neardup.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signature_agreement_estimates_similarity():
    rng = random.Random(2)
    a = neardup.shingle_set(words(rng, 400), 1)
    b = a.copy()
    b[:80] += 1
    share = len(set(a) & set(b)) / len(set(a) | set(b))
    x = neardup.superminhash([a, b, a[:1]], 400)
    assert abs((x[0] == x[1]).mean() - share) < 0.06 and (x < 400).all()


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_decontamination_by_edit_distance(spark):
    rng = random.Random(3)
    items = [(i, words(rng, n)) for i, n in enumerate([8, 12, 15, 23, 40, 55, 70, 200])]
    docs, want = [], set()
    for n in range(80):
        i, text = items[n % len(items)]
        w = text.split()
        for _ in range(n // 8 % 4 * len(w) // 40):
            at = rng.randrange(len(w))
            w[at:at + 1] = rng.choice([[], ["new"], [w[at], "new"]])
        docs.append((n, words(rng, n) + " " + " ".join(w).upper() + ". " + words(rng, 30)))
        want.add((n, i))
        assert edit(text.split(), w) <= 0.2 * len(text.split())
    docs += [(500 + n, words(rng, 200)) for n in range(60)] + [(600, None), (601, ""), (602, " ".join([items[0][1], items[4][1]]) * 2), (602, items[3][1])]
    want |= {(602, 0), (602, 4), (602, 3)}
    bench = spark.createDataFrame([*items, (90, None), (91, "too short"), (3, items[3][1])], "item_id long, text string")
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as item_id", "2 as edits")
    found = decontamination.contamination(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.doc_id >= 500} == {w for w in want if w[0] >= 500}
    assert {(r.doc_id, r.item_id) for r in found} <= want and len({(r.doc_id, r.item_id) for r in found}) >= 0.97 * len(want)
    left = decontamination.clean(frame, bench)
    assert left.columns == frame.columns and left.count() == len(docs) - sum(d in {r.doc_id for r in found} for d, _ in docs)
    assert decontamination.contamination(frame, bench.limit(0)).count() == 0
    assert decontamination.contamination(frame.limit(0), bench).count() == 0


def test_decontamination_by_short_items_and_scripts_without_blanks(spark):
    rng = random.Random(11)
    items = [(n, [rng.choice("abcdefgh") for _ in range(n)]) for n in range(1, 8)] + [(8, "x y x y x".split())]
    docs = [(n, [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 25))]) for n in range(200)] + [(200, "x y x z x y x y x".split())]
    want = {(d, i) for d, w in docs for i, t in items
            if any(edit(t, w[a:b]) <= 0.2 * len(t) for a in range(len(w)) for b in range(a, min(len(w), a + len(t) + 1) + 1))}
    exact = {(d, i) for d, w in docs for i, t in items if any(w[a:a + len(t)] == t for a in range(len(w)))}
    passage = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏"
    more = [(300, "前文" + passage + "后文。"), (301, "前文" + passage[:10] + "新" + passage[11:] + "后文"), (302, "天地不仁以万物为刍狗"), (303, "它在北京城里")]
    bench = spark.createDataFrame([*[(i, " ".join(t)) for i, t in items], (20, passage), (21, "北京"), (22, "?!")], "item_id long, text string")
    frame = spark.createDataFrame([*[(d, " ".join(w)) for d, w in docs], *more], SCHEMA)
    found = decontamination.contamination(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.doc_id < 300} == want
    assert {(r.doc_id, r.item_id) for r in found if r.doc_id < 300 and not r.edits} == exact
    assert {(r.doc_id, r.item_id) for r in found if r.doc_id >= 300} == {(300, 20), (301, 20), (303, 21)}
    dirty = {r.doc_id for r in found}
    assert {r.doc_id for r in decontamination.clean(frame, bench).collect()} == {d for d, _ in [*docs, *more]} - dirty


def test_several_passes_find_the_same(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, words(rng, 30)) for i in range(9)]
    docs = spark.createDataFrame([(i, words(rng, 20) + " " + t) for i, t in items], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "PASS_WORDS", 70)
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contamination(docs, bench).collect()) == [(i, i) for i in range(9)]


def test_substrings(spark):
    a, b = "This passage of eight words stands in here.", "Another long sentence that two of them share!"
    docs = [(1, f"Start. {a} {b}\nEnd"), (2, f"{a}\n{a}\nAlone in the second of all documents."), (3, f"lead in {b} {b} Tail"),
            (3, f"lead in {b} {b} Tail"), (4, None), (5, ""), (None, a), (6, "Short one. Short one."), (7, "x " * 5000 + "\n" + a.upper())]
    got = {r.doc_id: r for r in substrings.dedup(spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as removed", "2 as key", "3 as unit")).collect()}
    assert set(got) == {2, 3, 7, None}
    assert got[2].text == "Alone in the second of all documents." and got[2].n_removed == 2
    assert got[3].text == f"lead in {b} Tail" and docs[2][1][got[3].removed[0]["start"]:got[3].removed[0]["end"]] == b + " "
    assert got[None].text == "" and got[7].text == "x " * 5000 + "\n"
    assert substrings.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_short_sentences_and_lines_go_with_their_copies(spark):
    rng = random.Random(8)
    shorts = " ".join(f"{words(rng, rng.randint(1, 4))}!!" for _ in range(60))
    verse = "\n".join(words(rng, 3) for _ in range(12))
    han = "\u4e00\u4e8c\u4e09\u56db\u4e94\u516d" * 10
    docs = [(1, shorts), (2, shorts), (3, verse), (4, verse), (5, "Hi there"), (6, "hi, there!"), (7, f"One here\n\n{verse}\n\nTwo"),
            (8, f"Other start of it\n{shorts}\n---\nother end"), (9, "--- ..."), (10, "--- ..."), (11, f"a\n{han}"), (12, f"b\n{han}\nc")]
    got = {r.doc_id: r.text for r in substrings.dedup(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {2: "", 4: "", 6: "", 7: "One here\n\nTwo", 8: "Other start of it\nother end", 12: "b\nc"}


def test_units_lie_inside_each_other_or_apart():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "word ", "end. ", "! ", "\n", "\n\n", "some words of a line ", "-- "]) for _ in range(rng.randint(0, 40)))
        laid = substrings.parts(text)
        assert "".join(text[p.start:p.end] for p in laid) == text
        spans = list(substrings.units(text))
        for n, (a, b, one) in enumerate(spans):
            assert one.split() == substrings.WORD.findall(text[a:b].lower())
            for c, d, other in spans[:n]:
                assert b <= c or d <= a or (a <= c and d <= b and len(other) < len(one)) or (c <= a and b <= d and len(one) < len(other))
        if spans:
            covered = {i for a, b, _ in spans for i in range(a, b)}
            assert not substrings.WORD.search("".join(x for i, x in enumerate(text) if i not in covered))


def brute_lines(docs, least, chars=150):
    parts = {d: (t or "").split("\n") for d, t in docs}
    full = {d: [i for i, x in enumerate(p) if re.search(r"\S", x)] for d, p in parts.items()}
    seen, gone = set(), {d: set() for d in parts}
    for d in sorted(parts):
        names = [parts[d][i] for i in full[d]]
        for n in {least, *(2 ** k for k in range(9) if 2 ** k < least)}:
            for s in range(len(names) - n + 1):
                run = tuple(names[s:s + n])
                if n < least and sum(map(len, run)) < chars:
                    continue
                if run in seen:
                    gone[d] |= set(range(s, s + n))
                seen.add(run)
    out = {}
    for d, p in parts.items():
        cut = {full[d][s] for s in gone[d]}
        for s in gone[d]:
            if s + 1 in gone[d]:
                cut |= set(range(full[d][s], full[d][s + 1]))
        out[d] = "\n".join(x for i, x in enumerate(p) if i not in cut)
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_lines(spark, least):
    rng = random.Random(least)
    docs = [(n, "\n".join(rng.choice(["a", "b", "c", "", f"own {n} {k}"]) for k in range(rng.randrange(25)))) for n in range(40)]
    docs += [(50, docs[3][1]), (51, "same\n" * 70), (52, "\n\n"), (53, "")]
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as key", "2 as doc", "3 as n_lines")
    got = lines.dedup(frame, least=least).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(docs, least)
    some = {r.doc_id: r.text for r in lines.dedup(frame, least=least, chars=3).collect()}
    assert some == brute_lines(docs, least, 3)
    assert all(r.n_lines == len(dict(docs)[r.doc_id].split("\n")) for r in got)


def test_long_lines_go_by_themselves(spark):
    long, half = " ".join(f"word{i}" for i in range(60)), "x" * 80
    docs = [(1, long), (2, long), (3, f"a\n{half}\n\n{half}1\nb"), (4, f"c\n{half}\n{half}1\nd"), (5, "short\nown"), (6, "short"), (7, f"e\n{half}\nf")]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == {1: long, 2: "", 3: docs[2][1], 4: "c\nd", 5: "short\nown", 6: "short", 7: docs[6][1]}


def test_lines_of_odd_rows(spark):
    docs = [(None, "a\nb\nc\nd"), (1, "a\nb\nc\ne"), (1, "a\nb\nc\ne"), (2, None), (2, None)]
    got = lines.dedup(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.text), r.n_removed) for r in got) == [
        ("1", "a\nb\nc\ne", 0), ("1", "a\nb\nc\ne", 0), ("2", "None", 0), ("2", "None", 0), ("None", "d", 3)]
    assert lines.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_language(spark):
    docs = [(n, "the house and the garden are with this %d" % n, "en") for n in range(40)]
    docs += [(100 + n, "das haus und der garten sind nicht bei %d" % n, "de") for n in range(40)]
    docs += [(300, None, "en"), (301, "", None), (302, "12 34 !!", "de"), (303, "the garden and this " * 3000, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "9 as score", "doc_id as lang_pred")
    got = {r.doc_id: r for r in language.predict(frame, language.fit(frame)).collect()}
    assert sum(got[d].lang_pred == lang for d, _, lang in docs[:80]) >= 78
    assert [got[d].lang_pred for d in (300, 301, 302, 303)] == ["und", "und", "und", "en"] and got[300].score == 0
    assert language.fit(frame.limit(0)) is None
    assert {r.lang_pred for r in language.predict(frame, None).collect()} == {"und"}
    assert language.predict(frame.limit(0), None).count() == 0


def test_base_spans_equal_the_plain_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub(r"\D", "", m[0])
    rng = random.Random(4)
    for _ in range(20_000):
        t = "".join(rng.choice("a1.@+- 49(2") for _ in range(rng.randrange(60)))
        want = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        want += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [(m.start(), 2, m.end()) for m in card.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        want += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 10 <= len(digits(m)) <= 15]
        assert pii.base_spans(t) == sorted(want)


def test_bootstrapping_finds_unseen_identifiers(spark):
    docs = [(n, f"please write to a{n}b@mail{n}.org or so") for n in range(8)]
    docs += [(20, "please write to user77x45@intranet today"), (21, "build 77x45 of the set"), (22, None), (23, ""), (23, "x" * 50_000 + "@")]
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as kind", "2 as pattern")
    got = {r.doc_id: r for r in pii.find(frame).collect() if r.doc_id != 23}
    assert got[0].spans == "email:16:29" and got[0].n_email == 1
    assert got[20].spans == "email:16:34" and got[20].n_email == 0
    assert got[21].spans == "" and got[22].spans == ""
    assert pii.find(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bootstrapping_goes_on_until_nothing_is_added(spark):
    seeds = [(f"s{k}", "email") for k in range(7)]
    edges = [(f"p{n}", *s) for n in range(9) for s in seeds] + [(f"p{n}", f"v{m}", None) for n in range(9) for m in (n, n + 1) if m]
    got = pii.bootstrap(spark.createDataFrame(edges, "pattern string, value string, kind string")).collect()
    assert {r.pattern for r in got} == {f"p{n}" for n in range(9)}


def test_long_values_are_mentions_of_their_own():
    token = "id7x" * 40
    assert [(m["start"], m["end"]) for m in pii.mentions("your key " + token, [])] == [(9, 9 + len(token))]
    text = f"{'a' * 90}1@mail.org {'a' * 90}2@mail.org"
    assert len({m["value"] for m in pii.mentions(text, pii.base_spans(text))}) == 2


def test_escape_is_reversible(spark):
    texts = ["", "\\", "\\1<s>", "</s>[INST] ok [/INST]", "<<s>s>", "\\0\\\\4", "[INST", "🙂</s>"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", chat.escape(chat.F.col("t")).alias("e"), chat.unescape(chat.escape(chat.F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]")) for r in got)


def test_reply_trees(spark):
    rng = random.Random(6)
    rows, parents = [], {}
    for tree in range(6):
        for k in range(rng.randrange(1, 40)):
            node = tree * 100 + k
            parents[node] = tree * 100 + rng.randrange(k) if k else None
            rows.append((tree, node, parents[node], float(rng.randrange(9)) if k % 5 else None, "user", f"t{node}"))
    rows += [(9, 900 + k, 900 + k - 1 if k else None, 1.0, "assistant", str(k)) for k in range(70)]
    parents |= {900 + k: 900 + k - 1 if k else None for k in range(70)}
    rows += [(7, 700, 701, 1.0, "user", "x"), (7, 701, 700, 1.0, "user", "x"), (8, 800, 12345, 1.0, "user", "root")]
    parents |= {800: None}
    score = {r[1]: r[3] or 0.0 for r in rows}
    tree = {r[1]: r[0] for r in rows}
    up = lambda n: [] if n is None else [*up(parents[n]), n]
    leaves = set(parents) - set(parents.values())
    want = {}
    for leaf in sorted(leaves, key=lambda n: (-sum(score[x] for x in up(n)), n)):
        if len(want.setdefault(tree[leaf], [])) < 2:
            want[tree[leaf]].append(up(leaf))
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    paths = chat.reply_paths(nodes, 2).collect()
    got = {}
    for r in sorted(paths, key=lambda r: (r.tree, r.path, r.depth)):
        got.setdefault((r.tree, r.path), []).append(r.node)
    assert {t: sorted(p) for t, p in want.items()} == {t: sorted(v for (u, _), v in got.items() if u == t) for t in want}
    assert chat.reply_paths(nodes.limit(0)).count() == 0


def test_conversations_with_nulls_and_ties(spark):
    rows = [(1, None, "user", "first"), (1, 2, "assistant", None), (1, 2, None, "tie"), (1, 3, "assistant", "</s>"), (None, 1, "assistant", "x"), (1, 3, "assistant", "</s>")]
    nodes = chat.chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as node", "2 as path"))
    got = {r.tree: r for r in chat.read_back(chat.format_paths(nodes, chat.reply_paths(nodes))).collect()}
    assert [(t["role"], t["text"]) for t in got[1].turns] == [("user", "first"), ("", "tie"), ("assistant", ""), ("assistant", "</s>"), ("assistant", "</s>")]
    assert got[1].learned == "</s></s>" and got[None].learned == "x"


def test_many_entities_in_one_text():
    """The time for a text grows with its length, not with its square."""
    import time

    text = " ".join(f"user{i}@mail.example.org id-{i:07d}x" for i in range(8_000))
    began = time.process_time()
    found = pii.mentions(text, pii.base_spans(text))
    assert time.process_time() - began < 3 and sum(m["kind"] == "email" for m in found) == 8_000 and sum(m["kind"] is None for m in found) == 8_000


def test_no_label_is_lost_to_its_ids(spark):
    rows = [(n, f"the cat and dog {n}", "en") for n in range(3000)] + [(5, f"el gato y perro {n}", "es") for n in range(3000)]
    rows += [(None, "der hund", "de")] * 3000 + [(9, "", "xx")] * 10
    net = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_class=20)
    assert sorted(net.languages) == ["de", "en", "es"]
