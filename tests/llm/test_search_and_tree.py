"""Exact searches against all products, and the hash tree against one built by hand."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import exact_topk, hard_negatives, merkle, vector_search

from ..compare import duck, rows
from caseflow.llm import queries

SF = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<float>, label int, rank string, score double"


def vectors(dims=(6, 3, 0), n=420, seed=5):
    """Clusters, copies, ties, repeated rows, several lengths, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = {d: rng.normal(size=(4, d)) for d in dims}
    out = []
    for i in range(n):
        d = dims[0] if i % 10 < 8 else dims[1 + i % 2]
        v = centres[d][i % 4] + rng.normal(size=d) * 0.2
        if i % 5 == 0:
            v = centres[d][0]  # a fifth of all are one vector
        if i % 37 == 0:
            v = np.zeros(d)
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(4)), "x", 0.0))
    out += [out[100], out[200], out[17], out[17]]
    nan, inf = float("nan"), float("inf")
    bad = [[nan] * 6, [inf] + [1.0] * 5, [None] + [1.0] * 5, None]
    return out + [(1000 + 100 * k, v, 1, "x", 0.0) for k, v in enumerate(bad)] + [(None, [1.0] * 6, 1, "x", 0.0), (1400, [1.0] * 6, None, "x", 0.0)]


def whole(table, scale, labels):
    out = []
    for i, v, y, *_ in table:
        if i is None or v is None or (labels and y is None) or any(x is None or not np.isfinite(x) for x in v):
            continue
        out.append((i, np.floor(np.array(v, np.float64) * scale).astype(np.int64), y))
    return out


def scored(q, table):
    got = [(-int(q[1] @ v), i, y) for i, v, y in table if i != q[0] and len(v) == len(q[1])]
    return [(i, -s, y) for s, i, y in sorted(got, key=lambda x: x[:2])]


def queries_of(table, every=100):
    seen, out = set(), []
    for i, v, y in table:
        if i % every == 0 and (i, tuple(v), y) not in seen:
            seen.add((i, tuple(v), y))
            out.append((i, v, y))
    return out


@pytest.fixture(params=[False, True], ids=["one_tile", "many_tiles"])
def size(request, monkeypatch):
    if request.param:  # every structure has several rows
        for name, value in (("TILE_VALUES", 64 * 6), ("BUFFER_VALUES", 900), ("CHUNK_ROWS", 3), ("SLOT_TILES", 1), ("REFERENCES", 5)):
            monkeypatch.setattr(vector_search, name, value)


def test_topk_equals_all_products(spark, size):
    table = vectors()
    got = exact_topk.top_k_of(spark.createDataFrame(table, VECTORS).repartition(3))
    kept = whole(table, 1024, False)
    want = [(q[0], k + 1, i, s) for q in queries_of(kept) for k, (i, s, _) in enumerate(scored(q, kept)[:10])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_topk_of_fewer_rows_and_of_none(spark):
    df = spark.createDataFrame(vectors()[:4], VECTORS)
    assert exact_topk.top_k_of(df).count() == 3
    assert exact_topk.top_k_of(df.filter("false")).count() == 0


def test_scores_beyond_a_long_raise(spark):
    df = spark.createDataFrame([(0, [1e9, 1.0], 1, "x", 0.0), (1, [1e9, 2.0], 1, "x", 0.0)], VECTORS)
    with pytest.raises(Exception, match="does not fit a long"):
        exact_topk.top_k_of(df).collect()


@pytest.mark.parametrize("kind", [vector_search.Distances(), vector_search.Angles()], ids=["distances", "angles"])
def test_bounds_hold(kind):
    rng = np.random.default_rng(1)
    m = rng.integers(-300, 300, size=(400, 9)).astype(np.float64)
    m[::50] = m[1]
    m[3] = 0
    rows = vector_search._Side.__new__(vector_search._Side)
    rows._hold(np.arange(400), np.zeros(400), m, kind.refs(m, m[5:25]).astype(np.float32).T)
    for i in range(0, 400, 7):
        low, high = kind.bounds(rows.refs[:, i], rows.norms[i], rows)
        score = m @ m[i]
        assert (low <= score).all() and (score <= high).all()


def test_hard_negatives_equal_all_products(spark, size):
    table = vectors(seed=8)
    got = hard_negatives.mine_embeddings(spark.createDataFrame(table, VECTORS).repartition(3))
    kept = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in whole(table, 256, True)]
    want = []
    for q in queries_of(kept):
        every = scored(q, kept)
        for p, s, _ in [x for x in every if x[2] == q[2]][:5]:
            fits = [x for x in every if x[2] != q[2] and 30 * s <= 100 * x[1] <= 90 * s]
            want += [(q[0], p, k + 1, i, s, n) for k, (i, n, _) in enumerate(fits[:10])]
    assert len(want) > 20
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_hard_negatives_of_none(spark):
    assert hard_negatives.mine_embeddings(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("name", ["op11_exact_topk", "op12_merkle", "op13_hard_negatives"])
def test_new_queries_give_the_rows_of_their_sql(spark, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck(SF).execute(queries.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


# the tree

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, nth int, n int, path string"


def documents():
    out = []
    for i in range(330):
        out.append((i, "hot", "en", i, f"Text Number {i}"))
    out += [(k + 400, None, None, None, None) for k in range(17)]
    out += [(500, "alone", "de", 1, ""), (501, "ä", "fr", 5, "Été 😀 LONG " * 4000), (501, "ä", "fr", 5, "Été 😀 LONG " * 4000), (None, "ä", "fr", 5, "A"), (502, "", "", 0, "B")]
    out += [(600 + k, f"s{k:02}", "en", 1, "AbC") for k in range(20)]
    return [(*x, "l", 1, 2, "p") for x in out]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def climb(level, at):
    """(top, [(left, right)]) of the node `at`."""
    steps = []
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        run, slot = runs[at // 16], at % 16
        steps.append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        level, at = [h(*r) for r in runs], at // 16
    return level[0], steps


def by_hand(table):
    groups = {}
    for r in table:
        groups.setdefault(r[1], []).append(r)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    subroots = [climb([leaf(r) for r in groups[s]], 0)[0] for s in names]
    out = []
    for k, s in enumerate(names):
        root, above = climb(subroots, k)
        leaves = [leaf(r) for r in groups[s]]
        for i, r in enumerate(groups[s]):
            path = climb(leaves, i)[1] + above
            text = r[4].translate(lower) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[4]
            now = leaf((*r[:4], text))
            for a, b in path:
                now = h(a, now, b)
            out.append((r[0], leaves[i], subroots[k], root, h(*[x for p in path for x in p]), now, now == root))
    return out


def test_tree_is_the_one_built_by_hand(spark):
    table = documents()
    docs = spark.createDataFrame(table, DOCS).repartition(5)
    got = merkle.verified(docs, merkle.tampered(docs))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(by_hand(table), key=str)


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_small_trees(spark, n):
    table = [(i, "a", "en", 1, "X", "l", 1, 2, "p") for i in range(n)]
    docs = spark.createDataFrame(table, DOCS)
    assert sorted(map(tuple, merkle.verified(docs, F.col("text")).collect())) == sorted((*r[:5], r[3], True) for r in by_hand(table))
