"""Exact vector search, fill-in-middle and lexical search against brute force and SQL."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_check import compare, connect

from tissuegrid.llm import infill, lexical, metric_tree, queries

FOLDER = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, v string, tree string, score string"
DOCS = "doc_id long, text string, n string, raw string, lost string, uid string"


@pytest.mark.parametrize("name", ["op11_metric_tree", "op12_fill_in_middle", "op13_lexical_search"])
def test_queries_match_sql(spark, name):
    ok, message = compare(spark, connect(FOLDER), FOLDER, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, message


# Vector search -------------------------------------------------------------------------------


def _vectors():
    """Clusters, one vector that many rows hold, ties, zero, empty, odd lengths and unusable rows."""
    rng = np.random.default_rng(3)
    rows = []
    for centre in rng.normal(size=(6, 8)):
        rows += [(len(rows) + i, (centre + 0.1 * rng.normal(size=8)).tolist()) for i in range(60)]
    rows += [(1000 + i, [0.5] * 8) for i in range(150)]
    rows += [(2000 + i, rng.integers(-1, 2, size=8).astype(float).tolist()) for i in range(80)]
    rows += [(3000, [0.0] * 8), (3050, []), (3051, []), (3052, []), (3100, [1.0, 2.0]), (3101, [2.0, 1.0]), (3150, [1.0])]
    rows += [(None, [1.0] * 8), (3200, None), (3201, [float("nan")] * 8), (3202, [float("inf")] * 8), (3203, [1.0, None] * 4),
             (3204, [1e300] * 8), (-50, [0.3] * 8), (-51, [0.3] * 8), rows[0], rows[50]]
    # One id with two vectors, as a candidate and as a query.
    rows += [(7, [0.9] * 8), (100, [-0.9] * 8)]
    return rows


def _whole(v):
    if v is None or any(x is None or not math.isfinite(x) or abs(x) * 256 >= 2 ** 31 for x in v):
        return None
    return tuple(math.floor(256 * x) for x in v)


def _brute(rows, best, every):
    usable = {(i, w) for i, v in rows if i is not None and (w := _whole(v)) is not None}
    out = set()
    for q in {i for i, _ in usable if i % every == 0}:
        scores = {}
        for i, w in usable:
            for j, x in usable:
                if i == q and j != q and len(x) == len(w):
                    s = sum(a * b for a, b in zip(w, x))
                    scores[j] = max(scores.get(j, s), s)
        ranked = sorted(scores.items(), key=lambda e: (-e[1], e[0]))[:best]
        out |= {(q, r + 1, j, s) for r, (j, s) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("tree", [8192, 100])
def test_vector_search_equals_brute_force(spark, tree, monkeypatch):
    if tree == 100:
        # Several parts of tree centres, deeper trees.
        monkeypatch.setattr(metric_tree, "CENTRE_BYTES", 300)
    rows = _vectors()
    frame = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], VECTORS)
    got = metric_tree.top_k(frame, tree=tree).collect()
    assert len(got) == len({(r.query_id, r["rank"]) for r in got})
    assert {tuple(r) for r in got} == _brute(rows, metric_tree.BEST, metric_tree.EVERY)


def test_vector_search_of_an_empty_table(spark):
    assert metric_tree.top_k(spark.createDataFrame([], VECTORS)).collect() == []


def test_tree_passes_over_most_vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 6)) * 400
    x = np.unique(np.floor(np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 6)) * 5).astype(np.int64), axis=0)
    top = int((x * x).sum(axis=1).max())
    space = metric_tree.Space(top)
    pages = metric_tree.Pages(x, space)
    stored = pages.stored()
    row = type("Row", (), {"__getitem__": lambda self, i: self.cells[i]})()
    row.cells = [0, 6, top, len(x), None, None, None, None, None, 0.0, 0, stored["first"], stored["object"], stored["child"],
                 stored["radii"], stored["above"]]
    row.top, row.n, row.size, row.vectors = top, len(x), 6, x.tobytes()
    row.ids, row.copies = np.arange(len(x)).tobytes(), np.ones(len(x), dtype=np.int64).tobytes()
    row.first, row.root, row.radius = stored["first"], 0, pages.radius_all
    tree = metric_tree.Tree(row)
    for q in x[::100]:
        best = metric_tree.Best(5)
        tree.search(q[None], [best])
        want = sorted(zip((-(x @ q)).tolist(), range(len(x))))[:5]
        assert sorted((-s, i) for i, s in best.held.items()) == want
    assert tree.computed < 0.7 * len(x) * len(x[::100])


def test_scores_beyond_doubles_stay_exact(spark):
    # Squared lengths near 2**60: products need all 64 bits.
    base = [2.0 ** 21, 2.0 ** 21 - 1, 3.0]
    rows = [(0, base), (1, [2.0 ** 21, 2.0 ** 21 - 1, 2.0]), (2, [2.0 ** 21, 2.0 ** 21 - 1, 3.00390625]), (3, [2.0 ** 21 - 0.00390625, 2.0 ** 21, 3.0])]
    got = metric_tree.top_k(spark.createDataFrame([(i, v, "", "", "") for i, v in rows], VECTORS)).collect()
    assert {tuple(r) for r in got} == _brute(rows, 5, 50)


# Fill in the middle --------------------------------------------------------------------------

TEXT = st.text(st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0abZ<>PSM"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_index_converts_both_ways(text):
    index = infill.CharIndex(np.frombuffer(text.encode(), dtype=np.uint8))
    chars = np.arange(len(text) + 1)
    cuts = np.array([len(text[:i].encode()) for i in chars])
    assert index.to_bytes(chars).tolist() == cuts.tolist()
    assert index.to_chars(cuts).tolist() == chars.tolist()


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_tokens_equal_pattern(text):
    want = [len(text[:m.end()].encode()) for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)]
    assert infill.token_ends(np.frombuffer(text.encode(), dtype=np.uint8)).tolist() == want


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(0, 60), st.integers(0, 60), st.sampled_from(["psm", "spm"]))
def test_outputs_give_the_text_back(text, a, b, form):
    raw = text.encode()
    if not any(m in raw for m in (infill.PREFIX, infill.SUFFIX, infill.MIDDLE)):
        cuts = np.sort(np.minimum([a, b], len(raw)))
        assert infill.restored(infill.arrange(raw, form, cuts), form) == raw


def _infilled(doc_id, text, unit):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text) if unit == "token" else list(text)
    n = len(units)
    if doc_id is None:
        return n, "plain", None, None, text
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["token", "char"])
def test_fill_in_middle_of_odd_texts(spark, unit):
    rng = random.Random(2)
    texts = [None, "", " ", "one", "  lead and trail \n", "<M> marked", "a<S", "é日本\U0001f642 x" * 7, "日本語　漢字", "x" * 50_000,
             "日 " * 40_000, "\x1c\x1d y"]
    texts += ["".join(rng.choices(" \tabé日\U0001f642<PSM>", k=rng.randint(1, 40))) for _ in range(150)]
    rows = [*enumerate(texts), (None, "no id at all"), (3, "repeated id"), (3, "one"), (2 ** 60 + 1, "large id here")]
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS)
    made = infill.restore(infill.fill_in_middle(frame, unit=unit)).collect()
    got = sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in made)
    want = sorted((str(i), *(str(x) if k in (2, 3) else x for k, x in enumerate(_infilled(i, t, unit)))) for i, t in rows)
    assert got == want
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert sorted(r.text for r in made) == sorted(t or "" for _, t in rows)


def test_fill_in_middle_of_an_empty_table(spark):
    assert infill.restore(infill.fill_in_middle(spark.createDataFrame([], DOCS))).collect() == []


# Lexical search ------------------------------------------------------------------------------


def _terms(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def _ranked(docs, items, best):
    held = [(i, _terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, length = len(held), sum(len(t) for _, t in held)
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(_terms(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, t in held:
            m = 75 + 25 * len(t) * n_docs // length
            score = 0
            for x in terms:
                df = sum(x in set(u) for _, u in held)
                tf = t.count(x)
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10 ** 9 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:best])]
    return sorted(out, key=str)


def _library():
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "The", "of", "Été", "日本", "x1", "a_b", "zebra", "yak", "gnu", "42"])
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 30)))) for i in range(60)]
    docs += [(100 + i, "one very common copy, the copy") for i in range(40)]
    docs += [(200, None), (201, ""), (202, " \x7f--- "), (None, "the zebra without an id"), (5, "the zebra again"), (5, "the zebra again"),
             (2 ** 60 + 1, "large yak"), (203, "unique" * 3000), (204, ("the long yak of " * 20_000) + "zebra")]
    items = [(1, "The zebra's copy"), (2, "yak yak gnu"), (3, None), (4, ""), (5, "nothing known here?"), (6, "été 日本 X1"),
             (None, "copy of 42"), (7, "unique" * 3000), (2, "zebra"), (2 ** 60 + 3, "a_b, a b")]
    return docs, items


@pytest.mark.parametrize("index_bytes", [lexical.INDEX_BYTES, 900, 200])
def test_lexical_search_equals_brute_force(spark, monkeypatch, index_bytes):
    """One index; several; and with items too long for any."""
    monkeypatch.setattr(lexical, "CELLS", 64)
    monkeypatch.setattr(lexical, "ENTRIES", 50)
    docs, items = _library()
    d = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in docs], DOCS)
    i = spark.createDataFrame([(*r, "x", "y") for r in items], "item_id long, text string, rank string, term string")
    got = sorted((tuple(r) for r in lexical.rank(d, i, best=6, index_bytes=index_bytes).collect()), key=str)
    assert got == _ranked(docs, items, 6)


def test_lexical_search_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "the yak", "", "", "", "")], DOCS)
    i = spark.createDataFrame([(1, "yak")], "item_id long, text string")
    assert lexical.rank(d.limit(0), i).collect() == []
    assert lexical.rank(d, i.limit(0)).collect() == []
    assert len(lexical.rank(d, i).collect()) == 1


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "BATCH_BYTES", 10)
    raw = ("ab cd, " * 9 + "y" * 40 + " tail").encode()
    pieces = list(lexical._pieces(raw))
    assert b"".join(pieces) == raw and len(pieces) > 3
    assert [t for p in pieces for t in _terms(p.decode())] == _terms(raw.decode())


def test_equal_hashes_do_not_count(monkeypatch):
    known = lexical.Vocabulary([b"abc", b"xyz"])
    known.hash[:] = np.sort(lexical.Words([b"abd xyz"], lexical._TABLE).hash)
    known.terms, known.bytes = [b"abc", b"abc"], np.frombuffer(b"abcabc", dtype=np.uint8)
    word, _ = known.find(lexical.Words([b"abd xyz"], lexical._TABLE))
    assert len(word) == 0
