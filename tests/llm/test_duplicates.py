"""Near-duplicate texts and vectors, repeated lines and fingerprints against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tissuegrid.llm import fingerprints, line_dedup, near_dedup, vector_dedup
from tissuegrid.llm.common import connected


def _components(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_connected_components(spark, kind):
    rng = random.Random(4)
    edges = {"chain": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 60)],
             "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]}[kind]
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _components(range(100), edges)
    assert got == {n: want[n] for n in {x for e in edges if e[0] != e[1] for x in e}}


def _set(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def _texts():
    """Families of edited copies of differing closeness, a shared passage, short and empty texts."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    texts = []
    for edits in (1, 2, 4, 7):
        base = [word() for _ in range(120)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    passage = " ".join(word() for _ in range(40))
    texts += [f"{passage} {' '.join(word() for _ in range(30))}" for _ in range(40)]
    texts += ["", None, " \t\n", "one", "One", "one two three", "ONE two\tthree", "a b c d e", "a b c d e f", texts[0], texts[0].upper()]
    return texts


@pytest.mark.parametrize("block", [1000, 8])
def test_near_duplicates_equal_brute_force(documents, block):
    texts = _texts()
    sets = [_set(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = _components(range(len(texts)), links)
    got = near_dedup.near_duplicates(documents(*enumerate(texts)), block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {
        i: (len(sets[i]), want[i], want[i] == i) for i in range(len(texts))}


def test_short_texts_at_the_threshold_are_linked(documents):
    """Pairs of similarity exactly 3/4, set sizes 4 to 48: the longer text has a third more shingles than the shorter."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    texts = []
    for size in [4] * 1500 + [8] * 300 + [12, 16, 24, 32, 48] * 60:
        words = [word() for _ in range(size + 4)]
        texts += [" ".join(words), " ".join(words[:3 * size // 4 + 4])]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(*enumerate(texts))).collect()}
    apart = [i for i in range(0, len(texts), 2) if got[i] != got[i + 1]]
    assert not apart and len(set(got.values())) == len(texts) // 2


def _meeting(bands, **more):
    """Two documents of different components in one bucket of band 1, with equal signatures."""
    n = len(bands)
    columns = {"band": [1] * n, "node": [5, 3], "component": [5, 3], "minor": [True, False], "n_shingles": [200] * n, **more}
    same = {"signature": [b"\1" * 240] * n, "bitmap": [b"\1" * (near_dedup.BITS // 8)] * n}
    return {k: np.array(v) for k, v in columns.items()} | same | {"bands": np.array([*map(np.array, bands)])}


def test_pair_is_passed_over_only_where_it_met_before():
    # The short codes of band 0 agree in both cases, the hashes that made the buckets only in the second.
    apart = near_dedup._alike(_meeting([[7, 9], [8, 9]]), least=150, percent=75, best_only=False)
    assert apart.values.tolist() == [[3, 5]]
    assert not len(near_dedup._alike(_meeting([[7, 9], [7, 9]]), least=150, percent=75, best_only=False))


def test_true_links_pass_all_tests_before_the_exact_one():
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 1 << 64, size=n, dtype=np.uint64)
    signer, least = near_dedup.Signer(near_dedup.BANDS, near_dedup.ROWS), near_dedup._least_agreement(75, 240)
    tried = 4000
    linked = roomy = unlike = 0
    for k in range(tried):
        # 300 of 400 shingles in both: exactly at the threshold; every other pair is well below it.
        both, one, other = draw(300), draw(50 + 100 * (k % 2)), draw(50)
        x, y = (np.unique(np.append(both, rest)) for rest in (one, other))
        bitmaps = [near_dedup._table([near_dedup._bitmap(v)], np.uint64) for v in (x, y)]
        room = near_dedup._room(*bitmaps, np.array([len(x)]), np.array([len(y)]), 75)[0]
        if k % 2:
            unlike += room
            continue
        roomy += room
        linked += (np.frombuffer(signer(x)[1], np.uint8) == np.frombuffer(signer(y)[1], np.uint8)).sum() >= least
    assert roomy == linked == tried // 2 and unlike < tried // 20


def test_near_duplicates_with_null_and_repeated_ids(documents):
    a, b = "a b c d e f g", "p q r s t u v"
    rows = near_dedup.near_duplicates(documents((1, a), (1, b), (2, b), (3, a), (3, a), (None, a), (4, None))).collect()
    assert sorted(((r.doc_id or 0, r.component_id, r.kept) for r in rows)) == [
        (0, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True)]


def test_near_duplicates_of_an_empty_table(documents):
    assert near_dedup.near_duplicates(documents()).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = []
    for i in range(260):
        b = base[i % 12]
        rows.append((i, [x + rng.gauss(0, 0.28) for x in b], i % 3 if i % 20 else None))
    rows += [(300 + i, rows[5][1], 2) for i in range(40)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None] * 16, 1), (404, [], 1),
             (405, [1.0, 2.0], 1), (406, [2.0, 4.0], 1), (407, [float("inf")] + [0.0] * 15, 1)]

    def good(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(x, y):
        return sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x)) / math.sqrt(sum(b * b for b in y))

    links = [(p[0], q[0]) for i, p in enumerate(rows) for q in rows[:i] if p[2] is not None and p[2] == q[2] and good(p[1])
             and good(q[1]) and len(p[1]) == len(q[1]) and cosine(p[1], q[1]) >= 0.93]
    count = collections.Counter(x for link in links for x in link)
    want = _components([r[0] for r in rows], links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit(1))
    got = vector_dedup.near_vectors(df, interval=16, leaf=4).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {
        i: (count[i], want[i], want[i] == i) for i in want}
    assert len(got) == len(rows) and len(links) > 1000


def test_vectors_with_null_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(df).collect())
    assert got == [(0, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind, strip", [("float", 40), ("double", 64)])
def test_near_vectors_travel_once_for_every_second_strip(spark, kind, strip, monkeypatch):
    rng = np.random.default_rng(6)
    near = rng.normal(size=(40, 8)).repeat(12, axis=0) + 0.08 * rng.normal(size=(480, 8))
    rows = [(i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate(near)]
    rows += [(480 + i, rows[7 * i][1], rows[7 * i][2]) for i in range(60)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    unit = np.array([r[1] for r in rows])
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    label = np.array([r[2] for r in rows])
    linked = (unit @ unit.T >= vector_dedup.COSINE) & (label[:, None] == label) & ~np.eye(len(rows), dtype=bool)
    want = _components(range(len(rows)), [(int(i), int(j)) for i, j in np.argwhere(linked) if i < j])
    sent = []
    stored = vector_dedup.materialize

    def noted(frame, name):
        out = stored(frame, name)
        if name == "pairs":
            sent.extend(out.groupBy("block").count().collect())
        return out

    monkeypatch.setattr(vector_dedup, "materialize", noted)
    got = vector_dedup.near_vectors(df, interval=16, leaf=4, strip=strip).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (linked[i].sum(), want[i]) for i in want}
    # A label has at most 270 vectors.
    assert linked.sum() > 1000 and 1 < max(r["count"] for r in sent) <= 1 + math.ceil(270 / strip) // 2 + 1


def _brute_lines(rows):
    found = collections.defaultdict(list)
    for doc_id, text in rows:
        for a, b, level, normal in line_dedup.units(text or "", 3, 8):
            found[level, normal].append((doc_id is None, doc_id or 0, a, b))
    cut = collections.defaultdict(set)
    for places in found.values():
        for _, doc_id, a, b in sorted(set(places))[1:]:
            cut[doc_id].add((a, b))
    out = {}
    for doc_id, text in rows:
        gone = {i for a, b in cut[doc_id or 0] for i in range(a, b)}
        out[doc_id] = None if text is None else "".join(c for i, c in enumerate(text) if i not in gone)
    return out, cut


def test_lines_equal_brute_force(documents):
    shared = "This very long sentence is shared by many of the documents here."
    rows = [(5, f"First one here\nCommon line of text.\nown words {shared} And more own words follow it"),
            (2, f"common  LINE of text\nSomething else entirely. {shared} The end comes now."),
            (9, "Common line of text.\nCommon line of text.\nab\nab"), (7, None), (8, ""), (11, "\n\n"), (12, shared),
            (13, "hé \U0001f642 ü\ncommon line of text\nz")]
    want, cut = _brute_lines(rows)
    got = line_dedup.remove_repeats(documents(*rows)).collect()
    assert {r.doc_id: r.text for r in got} == want
    assert {r.doc_id: {(s.a, s.b) for s in r.removed} for r in got} == {d: cut[d] for d, _ in rows}
    assert want[2] == rows[1][1] and want[9] == "ab\nab" and shared not in want[12] and "own words" in want[5]
    assert got[0].node == 1 and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_lines_with_null_and_repeated_ids(documents):
    line = "the same line again"
    got = line_dedup.remove_repeats(documents((1, line), (1, line), (None, line), (1, line + "\nother words stand here"))).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) in (
        [(0, ""), (1, ""), (1, ""), (1, line + "\nother words stand here")],
        [(0, ""), (1, line), (1, line), (1, "other words stand here")])
    assert line_dedup.remove_repeats(documents()).count() == 0


def _jaccard(x, y):
    x, y = (collections.Counter(w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w) for t in (x, y))
    total = sum((x | y).values())
    return sum((x & y).values()) / total if total else 1.0


def test_fingerprints(documents):
    import hashlib

    rng = random.Random(8)
    words = [f"w{int(i ** 1.5)}" for i in range(400)]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(20, 200))) for i in range(0, 240, 3)}
    texts |= {300: "", 303: None, 306: texts[0], 309: "é\U0001f642 x"}
    got = {r.doc_id: r for r in fingerprints.fingerprints(documents(*texts.items())).collect()}
    order = sorted(texts, reverse=True)
    errors = []
    for i, doc_id in enumerate(order):
        text, following = texts[doc_id] or "", texts[order[(i + 1) % len(order)]] or ""
        k = len(text) // 3
        edited = text[:len(text) - k] + following[:k]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [r.near_edited - _jaccard(text, edited), r.near_next - _jaccard(text, following)]
    assert len(got) == len(texts) and got[306].fingerprint == got[0].fingerprint != got[3].fingerprint
    # 64 samples: standard error at most 1 / 16 each.
    assert abs(sum(errors) / len(errors)) < 0.04 and max(map(abs, errors)) < 0.3


def test_fingerprints_hold_64_samples(documents):
    row = fingerprints.fingerprints(documents((1, "a b c"), (2, ""))).where("doc_id = 1").first()
    assert len(row.fingerprint) == len(row.edited_fingerprint) == 4 * 64


def test_fingerprints_count_the_shared_part_once(spark):
    parts = [(1, fingerprints.BOTH, "a b b c "), (1, 0, "c d"), (1, 1, "cx b"), (2, 0, "a b b c c d"), (2, 1, "a b b c cx b")]
    rows = {r.k: r for r in fingerprints.samples(spark.createDataFrame(parts, "k long, side int, body string"), ["k"]).collect()}
    assert rows[1].own == rows[2].own and rows[1].changed == rows[2].changed != rows[1].own


def test_fingerprint_of_the_edited_form_is_that_of_the_same_text(documents):
    # The kept parts end inside a word, in white space, or hold no white space; "A\u03a3" ends in a final sigma.
    texts = {9: "aa bb cc dd", 7: "A\u03a3 B\tcc  ee ", 5: "unbroken", 3: " x", 1: "\u00e9\U0001f642 A\u03a3 zz"}
    order, edited = list(texts), {}
    for i, k in enumerate(order):
        n, following = len(texts[k]) // 3, texts[order[(i + 1) % len(order)]]
        edited[100 + k] = texts[k][:len(texts[k]) - n] + following[:n]
    got = {r.doc_id: r for r in fingerprints.fingerprints(documents(*texts.items())).collect()}
    alone = {r.doc_id: r for r in fingerprints.fingerprints(documents(*edited.items())).collect()}
    assert [got[k].edited_fingerprint for k in order] == [alone[100 + k].fingerprint for k in order]


def test_fingerprints_with_null_and_repeated_ids(documents):
    rows = fingerprints.fingerprints(documents((2, "a b c"), (2, "a b c"), (1, "d e f"), (1, "a a"), (None, "a b c"))).collect()
    assert len(rows) == 5 and len({r.fingerprint for r in rows if r.doc_id != 1}) == 1
    assert [r.near_next for r in rows if r.doc_id is None] == [None]
    assert fingerprints.fingerprints(documents()).count() == 0
