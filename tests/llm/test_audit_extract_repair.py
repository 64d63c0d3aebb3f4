"""Filter audit, main texts of pages and conversation repair on small and odd inputs, against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from periodica.llm import audit, extraction, repair

DOCS = "doc_id long, text string, lang string"


def brute_audit(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    rows = []
    for d, t, lang in docs:
        t = t or ""
        w = words(t)
        f = {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        f |= {"D"} if re.search("[#$%&*|]", t) else set()
        f |= {"E"} if d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs) else set()
        rows.append((lang or "", f, any(i == d and d is not None and q == 1 for i, q, _ in labels), any(i == d and d is not None and x == 1 for i, _, x in labels)))
    out = {}
    for part in {r[0] for r in rows}:
        mine, removed = [r[1:] for r in rows if r[0] == part], {}
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order):
                gone = set(order[:step])
                here = [r for r in mine if not r[0] & gone and x in r[0]]
                removed[x] = removed.get(x, 0) + len(here)
                out[part, "".join(order), step + 1] = (
                    sum(not r[0] & {*gone, x} for r in mine), len(here), sum(bool(r[0] & gone) and x in r[0] for r in mine),
                    sum(r[0] == {x} for r in mine), sum(r[1] for r in here), sum(r[2] for r in here), x)
        for key in [k for k in out if k[0] == part]:
            out[key] = (*out[key][:6], removed[out[key][6]])
    return out


def test_filter_audit_of_odd_rows(spark):
    rng = random.Random(5)
    texts = [None, "", " \t", "word " * 250, " ".join(f"w{i}" for i in range(300)), "ABC " * 210, "a#b", "é" * 500, "A" + "x" * 40,
             " ".join(f"W{i}|" for i in range(220)), "x\x1cy \x0b z", "long " * 60_000]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(150)]
    docs += [(7, "same row", "en")] * 3 + [(3, "same row", "de")] * 2 + [(n, "copy", "en") for n in range(100, 180)] + [(None, "copy", None)] * 2
    labels = [(n, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for n in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' as part", "1 as fails", "2 as name", "3 as good").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("docs", F.lit(1))
    found = audit.survivors(audit.classes(frame, audit.text_tests(F.coalesce("text", F.lit("")))), marks)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in audit.orders(found).collect()}
    assert got == brute_audit(docs, labels)
    none = audit.classes(frame.limit(0), audit.text_tests(F.coalesce("text", F.lit(""))))
    assert audit.orders(audit.survivors(none, marks)).count() == 0
    unmarked = audit.orders(audit.survivors(audit.classes(frame, [F.lit(False)]), marks.limit(0))).collect()
    assert {r.good_lost for r in unmarked} == {0} and len(unmarked) == 600 * 3


def test_positional_popcount():
    rng = np.random.default_rng(0)
    for size in (0, 1, 2, 3, 7, 100, 1000):
        words, times = rng.integers(0, 2**32, size, np.uint64).astype(np.uint32), rng.integers(0, 50, size)
        want = [int(sum(int(t) for w, t in zip(words, times) if int(w) >> s & 1)) for s in range(32)]
        assert audit.positional_popcount(words, times) == want


LONG = "A sentence of some length that stands for an article. " * 4
PAGES = {
    "marked": (f"<!DOCTYPE html><title>T</title><header><p>{LONG}</p></header><nav><a href='/'>Home</a></nav><div class='cookie-notice'>{LONG}"
               f"</div><article><header><h1>A  &amp;\nB</h1></header><p>One<br>two<p>No.</p><div class=ad>Buy {LONG}</div><p>Thr<b>ee</b>"
               f"<form>Mail <input name=a> {LONG}</form><ul><li>x<li>y</ul></article><section id='comments'><article>{LONG}</article></section>"
               f"<aside>{LONG}</aside><footer>{LONG}</footer>", ["A & B", "One two", "No.", "Three", "x", "y"]),
    "main": (f"<div class='page has-sidebar'><main><h1>H</h1><p>x&nbsp;&nbsp;y <span class=advert>z</span>w</p></main><div id=sideBar>{LONG}</div></div>", ["H", "x y w"]),
    "named": (f"<div class='site-header'>{LONG}</div><div class='post-content'><p>Short.</p></div><div class='related-posts'>{LONG}</div>", ["Short."]),
    "plain": (f"<p><a href=a>{LONG}</a></p><div><h2>Head</h2><p>{LONG}</p><div class=popup>x</div><p>End.</p></div><p>Copyright me</p>",
              ["Head", LONG.strip(), "End."]),
    "nested comment": ("<article><p>a<article><p>I say</article><p>b</article>", ["a", "b"]),
    "script": ("<article>a<script>if (a<b) x='</p>'</script>b<style>p{}</style><!-- <p>c --> d<textarea><p>e</textarea></article>", ["ab d"]),
    "cut off": ("<article><p>a &lt b &amp", ["a < b &"]),
    "cut tag": ("<article><p>a<p class='x", ["a"]),
    "quotes": ("<article><p title='a>b' data-x=\"</p>\">c<p it's>d</article>", ["c", "d"]),
    "stray ends": ("</div></p><article></b></span><p>a</p></ul><p>b</p></article></div>", ["a", "b"]),
    "no text": ("<nav>x</nav><footer>y</footer>", []),
    "empty": ("", []), "null": (None, []),
    "many": ("<article>" + "<p>v" * 20_000 + "</article>", ["v"] * 20_000),
    "deep": ("<article>" + "<div>" * 5_000 + "<b>" * 5_000 + "v", ["v"]),
}


def test_main_texts(spark):
    rows = [(n, name, html) for n, (name, (html, _)) in enumerate(PAGES.items())] + [(None, None, "<article>z</article>")] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as blocks", "2 as _html", "3 as text")
    got = extraction.extract(frame).collect()
    assert {r.url: r.blocks for r in got if r.url} == {name: want for name, (_, want) in PAGES.items()}
    assert [r.blocks for r in got if not r.url] == [["z"]] * 2
    assert extraction.extract(frame.limit(0)).count() == 0


def test_surge_and_dive():
    assert extraction.surges([], 3, 1) == [] and extraction.surges([0, 0], 3, 1) == []
    assert extraction.surges([5, 0, 0, 60, 40, 0, 1, 0, 0, 0, 9, 0], 3, 80) == [(0, 7)]
    assert extraction.surges([5, 0, 0, 0, 60, 40, 0, 0, 0, 9], 3, 80) == [(4, 6)]


def brute_repair(rows):
    """Damage and repair one conversation: (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines)."""
    held = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, fault = " " if role is None else role, " " if text is None else text, zlib.crc32(name.encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            held += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = {t for t, _, _ in held if t is not None}
    faults, seen = [], set()
    for _, role, text in held:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(held, held[1:])]
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    full = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(n, state, inserted):
        found = [(0, "", ())] if n == len(held) and state in ("", "a") else []
        if inserted < 3:  # more than two in a row only go round in a circle
            for c in "ua":
                if c in follow[state] and (rest := best(n, c, inserted + 1)):
                    found.append((rest[0] + 3, "I" + rest[1], (full[c] + ":", *rest[2])))
        if n < len(held):
            (_, role, text), fault = held[n], faults[n]
            if rest := best(n + 1, state, 0):
                found.append((rest[0] + 4, "D" + rest[1], rest[2]))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                for letter, c, shown, cost in [("K", role[:1], role, 0), ("R", "u", "user", 3), ("R", "a", "assistant", 3)]:
                    if c in follow[state] and (rest := best(n + 1, c, 0)):
                        found.append((rest[0] + cost + more, letter + rest[1], (f"{shown}:{text}", *rest[2])))
        return min(found, default=None)

    for n in range(len(held), -1, -20):  # keeps the recursion short
        for state in ("a", "u", "s", ""):
            best(n, state, 0)
    cost, edits, lines = best(0, "", 0)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, lines)


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_against_all_edits(spark, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "u", "tool", "", None, "ü"]
    texts = ["a.", "b!", "c? \n", "no end", "", " \t", None, " ", "x" * 30_000 + ".", "d."]
    make = lambda c, n: [(c, rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"t{rng.random()}.") for _ in range(n)]
    rows = [r for c in [None, -3, *range(120)] for r in make(c, rng.randrange(1, 9))] + make(500, 500) + [(600, 1, "user", "same.")] * 40
    rows += [(700 + c, 0, "user", "x") for c in range(40)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "1 as conv", "2 as part", "3 as pos", "4 as edit", "5 as fault").repartition(7)
    report, repaired = repair.repair(repair.damage(frame))
    lines = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.place, r["at"])):
        lines.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    got = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, tuple(lines.get(r.conv, ()))) for r in report.collect()}
    want = {c: brute_repair([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    gone = {c for c, w in want.items() if not w[6] and not any(zlib.crc32(f"{' ' if r[0] is None else r[0]}:{' ' if r[1] is None else r[1]}".encode()) % 20 for r in rows if r[0] == c)}
    assert gone and not gone & set(got)
    assert {c: got.get(c) for c in set(want) - gone} == {c: w for c, w in want.items() if c not in gone}


def test_nothing_to_repair(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    report, repaired = repair.repair(repair.damage(frame))
    assert report.count() == 0 and repaired.count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
