"""Fill-in-the-middle, nearest neighbours and lexical search against brute force and on odd input."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import lexical_search, neighbours
from seriesloom.llm.fill_in_middle import SkipList, fill_in_middle, restored, unit_starts
from seriesloom.llm.lexical_search import mine, search
from seriesloom.llm.neighbours import nearest
from seriesloom.llm.queries import QUERIES

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


# -- fill in the middle ------------------------------------------------------------------------------------------------
def brute_middle(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    h = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def middle_rows(spark, rows):
    schema = "doc_id long, text string, n int, output string, form string"
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], schema)
    made = fill_in_middle(docs)
    return made.withColumn("restored", restored(F.col("output"), F.col("form"))).collect()


def test_middle_against_brute_force(spark):
    rng = random.Random(5)
    pieces = ["abc", "Z", "é", "🙂", " ", "\n", "<", "P>", "<M", "S", "12", "ß", "日本", "[", "`", "{", "@"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.choice((0, 1, 2, 7, 60))))) for i in range(300)]
    rows += [(400, None), (401, ""), (None, "abc def"), (7, "a <P> b"), (7, "x<S>"), (8, "<M>"), (9, "one"), (9, "one")]
    rows += [(500 + i, "wort, und " * 20000 + "é🙂" * 3000) for i in range(4)]
    got = middle_rows(spark, rows)
    want = Counter((i, *brute_middle(i, t), t or "") for i, t in rows)
    assert Counter(tuple(r) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_middle_of_no_rows(spark):
    assert middle_rows(spark, [(1, "x")])[:0] == fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect()


@pytest.mark.parametrize("n", [1, 2, 8, 9, 100, 5000])
def test_skip_list_reaches_every_rank(n):
    widths = np.random.default_rng(n).integers(1, 9, n)
    lanes, ends = SkipList(widths), np.concatenate([[0], np.cumsum(widths)])
    assert [lanes.cut(rank) for rank in range(n + 1)] == ends.tolist()
    assert n < 100 or len(lanes.lanes) > 1


def test_units_are_those_of_the_pattern():
    text = "ab1 Cé日x🙂yz@[`{\n\nq"
    assert unit_starts(text).tolist() == [m.start() for m in UNITS.finditer(text)]


# -- nearest neighbours ------------------------------------------------------------------------------------------------
SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, node string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0, 1, "n") for i, v in rows], SCHEMA)


def brute_nearest(rows, k=5):
    ok = []
    for i, v in dict.fromkeys((i, None if v is None else tuple(v)) for i, v in rows):
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        ok.append((i, np.array(v, np.float32).astype(float)))
    out = {}
    for i, q in ok:
        if i % 50 == 0:
            near = [(-(v @ q) / (np.sqrt(v @ v) * np.sqrt(q @ q)), j) for j, v in ok if j != i]
            out[i] = [(j, -s) for s, j in sorted((round(s, 12), j) for s, j in near)[:k]]
    return out


def found_by(spark, rows, **more):
    found = nearest(vectors_of(spark, rows), F.col("id") % 50 == 0, **more).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(201)]
    rows += [(300 + i, rows[50][1]) for i in range(9)]  # copies of a query
    rows += [(400, None), (450, [0.0] * 8), (451, [1.0, None] * 4), (500, [float("nan")] * 8), (550, [float("inf")] * 8)]
    rows += [(None, rows[3][1]), rows[7], rows[7], (600, []), (601, [1.0, 2.0])]
    same(found_by(spark, rows), brute_nearest([r for r in rows if r[0] != 601]))


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(2)
    hot = rng.standard_normal(6).tolist()
    rows = [(i, hot) for i in range(400)] + [(400 + i, rng.standard_normal(6).tolist()) for i in range(60)]
    same(found_by(spark, rows), brute_nearest(rows))


def test_few_vectors(spark):
    assert found_by(spark, []) == {}
    assert found_by(spark, [(0, [1.0, 2.0])]) == {}
    assert found_by(spark, [(0, None), (50, [0.0])]) == {}
    same(found_by(spark, [(0, [1.0, 2.0]), (1, [2.0, 1.0])]), {0: [(1, 0.8)]})


@pytest.mark.parametrize("cell", [4096, 37])
def test_recall_of_the_forest(spark, monkeypatch, cell):
    """Many small leaves, vectors without any structure: the budget must still find nine in ten; cells change nothing."""
    monkeypatch.setattr(neighbours, "CELL", cell)
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((3000, 16)).astype(np.float32))]
    got, want = found_by(spark, rows, leaf=40), brute_nearest(rows)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert np.mean(hits) / 5 >= 0.9
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(exact.get((q, i), s) - s) < 1e-12 for q in got for i, s in got[q])


def test_walk_visits_every_leaf_once():
    rng = np.random.default_rng(4)
    x = neighbours._unit(rng.standard_normal((900, 5)))
    forest = neighbours.grow(x, 900, trees=3, leaf=30)
    for p, own in zip(forest._margins(x[:20]), forest.leaf_of(x[:20]), strict=True):
        path = list(forest.walk(p, 10**6))
        assert len(path) == len(set(path)) == 3 << forest.depth
        assert {t: n for t, n in reversed(path[:3])}.items() <= dict(enumerate(own.tolist())).items() or len({t for t, _ in path[:3]}) < 3


def test_leaves_are_reached_in_the_order_of_the_queue():
    rng = np.random.default_rng(5)
    x = neighbours._unit(rng.standard_normal((900, 5)))
    for depth, leaf in ((0, 900), (5, 30)):
        forest = neighbours.grow(x, 900, trees=3, leaf=leaf)
        assert forest.depth == depth
        far, own = forest.distances(x[:20]), forest.code_of(x[:20])
        assert far.shape == (20, forest.codes) and not np.take_along_axis(far, own, axis=1).any()
        for n in (1, 4, forest.codes // 2 or 1, forest.codes, 10**6):
            seen = neighbours.Forest(forest.directions, forest.medians, forest.depth, n).reached(x[:20])
            assert (seen.sum(axis=0) == min(n, forest.codes)).all()
            for row, p in enumerate(forest._margins(x[:20]) if depth else []):
                path = [far[row, (t << depth) + i] for t, i in forest.walk(p, n)]
                assert path == sorted(path) == sorted(far[row, seen[:, row]])


@pytest.mark.parametrize("cell", [4096, 37])
def test_more_equal_scores_than_are_held(spark, monkeypatch, cell):
    monkeypatch.setattr(neighbours, "CELL", cell)
    rng = np.random.default_rng(6)
    signs = [[1.0 if n >> b & 1 else -1.0 for b in range(8)] for n in rng.permutation(256)[:200].tolist()]
    rows = [(i, v) for i, v in enumerate(signs)] + [(i, [0.5 * x for x in signs[i % 100]]) for i in range(200, 250)]
    same(found_by(spark, rows), brute_nearest(rows))


@pytest.mark.parametrize("hits", [1, 50, 1 << 17])
def test_candidates_are_taken_over_in_any_number(monkeypatch, hits):
    monkeypatch.setattr(neighbours, "HITS", hits)
    x = np.random.default_rng(8).standard_normal((700, 6))
    forest = neighbours.grow(neighbours._unit(x), 700, trees=4, leaf=40)
    forest = neighbours.Forest(forest.directions, forest.medians, forest.depth, 9)
    unit, code = neighbours._unit(x), forest.code_of(neighbours._unit(x))
    seen = forest.reached(unit[:30])
    at, score, count = neighbours._met(forest, x, np.arange(700), 6)(x[:30])
    for i in range(30):
        own = np.flatnonzero(seen[code, i].any(axis=1))
        exact = unit[own] @ unit[i]
        best = np.argsort(-exact)[:6]
        assert at[i].tolist() == own[best].tolist() and count[i] == 6 and np.allclose(score[i], exact[best])


def test_vectors_are_not_written_for_every_tree(spark, monkeypatch):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(7).standard_normal((1000, 8)).astype(np.float32))]
    written, keep = [], neighbours.stored
    monkeypatch.setattr(neighbours, "stored", lambda frame, purpose: written.append(keep(frame, purpose)) or written[-1])
    assert len(found_by(spark, rows, leaf=40)) == 20
    assert sum(t.count() for t in written) <= 1000 + 20


# -- lexical search ----------------------------------------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=10):
    bags = [(i, Counter(terms_of(t))) for i, t in docs if terms_of(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            m = 10 + (90 * sum(bag.values()) * n_docs) // n_terms
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t in set(terms_of(text))
                if t in bag
            )
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def texts(seed, n, sizes):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ärger", "ärger", "x-y", "Don't", "日本", "ABC", "42"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=rng.choice(sizes))) for _ in range(n)]


@pytest.mark.parametrize("block", [lexical_search.TERMS, 30])
def test_search_against_brute_force(spark, block):
    docs = list(enumerate(texts(1, 150, (1, 4, 30, 200))))
    docs += [(900, None), (901, ""), (902, " .,- "), (3, docs[3][1]), (3, "w1 other"), (None, docs[5][1]), (903, "w0 " * 30000)]
    docs += [(1000 + i, "w7 w8 same") for i in range(30)]  # ties
    items = list(enumerate(texts(2, 25, (1, 5, 25)))) + [(77, None), (78, ""), (79, "nowhere"), (3, "w7 w8"), (None, "w1 W1 w2")]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, rank int").repartition(5)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = Counter(tuple(r) for r in search(d, b, block=block).select("item_id", "rank", "doc_id", "score").collect())
    assert got == brute_search(docs, items)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(none, items).count() == 0
    assert search(one, items.limit(0)).count() == 0
    assert search(one, items).count() == 1


def test_graph_sums_are_shared():
    rng = random.Random(9)
    common = list(range(12))
    items = [sorted({*common[: rng.choice((6, 12))], *rng.sample(range(12, 60), 5)}) for _ in range(30)]
    held = sorted({t for i in items for t in i})
    items = [[held.index(t) for t in i] for i in items]
    graph = mine(items)
    parts = np.random.default_rng(1).integers(0, 1000, (len(held), 7))
    assert (graph.scores(parts) == np.stack([parts[i].sum(axis=0) for i in items])).all()
    sums = graph.size - len(graph.groups) + sum(len(i) - 1 for i in graph.items) + sum(len(g) - 1 for g in graph.groups)
    assert graph.levels and sums < 0.6 * sum(len(i) - 1 for i in items)


# -- the registered queries --------------------------------------------------------------------------------------------
COLUMNS = {
    "op11_fill_in_middle": "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string",
    "op12_nearest_neighbours": "query_id long, rank int, vec_id long, score double",
    "op13_lexical_search": "item_id long, rank int, doc_id long, score long",
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query_is_registered(spark, tmp_path, name):
    text = "Some words of a text, and more of them."
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (3, [2.0, 1.0])], "vec_id long, embedding array<float>")
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    assert found.dtypes == spark.createDataFrame([], COLUMNS[name]).dtypes
    assert found.count() > 0
