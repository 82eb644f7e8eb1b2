"""Neighbours, ranked search and vector codes: brute force, bounds and edge rows."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from evalweave.llm import ball_search, forest, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, Score double, h string"
DOCS = "doc_id long, text string, term string"
FOLDER = "/root/testdata/sf0.01"


def vector_rows():
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(8)], i % 3, 0.1, "x") for i in range(60)]
    rows[7] = (7, None, 1, 0.1, None)
    rows[8] = (8, [0.0] * 8, 1, 0.1, None)
    rows[9] = (9, [1.0, None] + [0.0] * 6, 1, 0.1, None)
    rows[10] = (10, [math.nan] + [0.0] * 7, 1, 0.1, None)
    rows[11] = (11, [math.inf] + [0.0] * 7, 1, 0.1, None)
    rows[12] = (12, [], 1, 0.1, None)
    rows[13] = (13, [1.0, 2.0], None, 0.1, None)  # shorter: padded
    same = [(100 + i, rows[20][1], None, 0.2, None) for i in range(40)]
    return rows + same + [rows[30], rows[30], (None, rows[31][1], None, 0.3, None)]


def padded(v, dim=8):
    return np.array(list(v) + [0.0] * (dim - len(v)), float)


def brute_neighbours(rows, k=20, every=20):
    held = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            held[i] = padded(np.array(v, np.float32).astype(float))
    out = []
    for q in sorted(held):
        if q % every:
            continue
        best = sorted(((-(held[q] * v).sum(), i) for i, v in held.items() if i != q))[:k]
        out += [(q, n + 1, i, round(-s, 9)) for n, (s, i) in enumerate(best)]
    return out


def test_neighbours_of_small_tables_are_exact(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS)
    found = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in forest.nearest_neighbours(df).collect())
    assert found == brute_neighbours(rows)
    assert forest.nearest_neighbours(df.limit(0)).collect() == []
    only = df.where("vec_id in (40, 7)")
    assert forest.nearest_neighbours(only).collect() == []


def test_neighbours_in_many_buckets(spark, monkeypatch):
    """Leaves over several buckets, queries in several chunks: the same as in one."""
    rng = np.random.default_rng(3)
    data = rng.standard_normal((3000, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    x = data.astype(float)
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    for bucket, chunk in ((32_768, 16_384), (50, 20)):
        monkeypatch.setattr(forest, "_BUCKET", bucket)
        monkeypatch.setattr(forest, "_CHUNK", chunk)
        out = forest.nearest_neighbours(df, leaf_rows=64).toPandas()
        assert len(out) == 150 * 20
        hits = 0
        for q, part in out.groupby("query_id"):
            part = part.sort_values("rank")
            assert np.allclose(part["score"], scores[q][part["vec_id"]], rtol=0, atol=1e-12)
            assert (np.diff(part["score"]) <= 0).all() and part["vec_id"].is_unique
            hits += len(set(part["vec_id"]) & set(np.argsort(-scores[q])[:20].tolist()))
        assert hits >= 0.9 * 3000


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    true = {(q, v) for q, _, v, _ in brute_neighbours_fast(rows)}
    found = {(r["query_id"], r["vec_id"]) for r in forest.nearest_neighbours(table).collect()}
    assert len(found & true) >= 0.9 * len(true)


def brute_neighbours_fast(rows, k=20, every=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    for n in np.flatnonzero(ids % every == 0):
        s = x @ x[n]
        s[n] = -np.inf
        for r, i in enumerate(np.lexsort((ids, -s))[:k]):
            yield int(ids[n]), r + 1, int(ids[i]), s[i]


def test_the_queue_pops_leaves_nearest_first():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 6))
    top = math.sqrt((x**2).sum(axis=1).max())
    trees = forest.grow(x, 3, 4, 1.0, top)
    q = rng.standard_normal((1, 6))
    margins = trees.margins(q)[0]
    popped = list(trees.leaves(margins))
    assert sorted(popped) == [(t, i) for t in range(3) for i in range(16)]

    def apart(tree, leaf):
        node, total = leaf + 15, 0.0
        while node:
            up = (node - 1) // 2
            right = node == 2 * up + 2
            m = margins[tree, up]
            total += 0 if (m > 0) == right else m * m
            node = up
        return total

    costs = [apart(*p) for p in popped]
    assert all(a <= b + 1e-12 for a, b in zip(costs, costs[1:]))


def brute_codes(vectors):
    """Product codes by the definition, in Python integers."""
    width = len(vectors[0]) // 4
    books, error, code = [], [0] * len(vectors), [""] * len(vectors)
    for p in range(4):
        parts = [[math.floor(1024 * x) for x in v[p * width : (p + 1) * width]] for v in vectors]
        book = [list(x) for x in parts[:256]]

        def nearest():
            return [min((sum((a - b) ** 2 for a, b in zip(x, e)), c) for c, e in enumerate(book)) for x in parts]

        for _ in range(4):
            held = {}
            for x, (_, c) in zip(parts, nearest()):
                held.setdefault(c, []).append(x)
            for c, rows in held.items():
                book[c] = [sum(v) // len(rows) for v in zip(*rows)]
        for i, (d, c) in enumerate(nearest()):
            error[i] += d
            code[i] += f"{c:02x}"
        books.append(book)
    text = ",".join(str(x) for book in books for e in book for x in e)
    return code, error, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("size", [1.0, 3e6, 1e30])
def test_codes_are_those_of_the_definition(spark, size):
    rng = np.random.default_rng(9)
    data = np.round(rng.standard_normal((330, 8)) * 4) / 4 * size  # many ties
    rows = [(i, v.tolist(), i % 4 or None) for i, v in enumerate(data)]
    out = vector_codes.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    out.sort(key=lambda r: r["vec_id"])
    code, error, sha = brute_codes(data.tolist())
    assert [r["code"] for r in out] == code and {r["codebooks_sha256"] for r in out} == {sha}
    assert [r["error"] for r in out] == [e if e < 1 << 63 else None for e in error]
    if size == 1.0:
        total = Counter()
        for (_, _, label), e in zip(rows, error):
            total[label] += e
        assert [r["label_error"] for r in out] == [total[label] for _, _, label in rows]


def test_codes_of_edge_rows(spark):
    df = spark.createDataFrame(vector_rows(), VECTORS)
    out = vector_codes.vector_codes(df).collect()
    assert len(out) == len(vector_rows()) - 5  # null, a null component, NaN, infinity, empty
    assert sum(r["vec_id"] is None for r in out) == 1 and all(len(r["code"]) == 8 for r in out)
    assert vector_codes.vector_codes(df.limit(0)).collect() == []
    assert len(vector_codes.vector_codes(df.drop("label")).collect()) == len(out)


def test_balls_skip_work_and_change_nothing():
    rng = np.random.default_rng(2)
    entries = np.floor(rng.standard_normal((64, 4)) * 3000)
    x = np.floor(np.repeat(entries, 50, axis=0) + rng.standard_normal((3200, 4)) * 60)
    whole = vector_codes.squares(x, entries)
    before = whole.argmin(axis=1)
    work = {}
    codes, best = vector_codes.ball_assign(x, entries, before, work)
    assert (codes == before).all() and (best == whole.min(axis=1)).all()
    assert work["stable"] > 2000 and work.get("compared", 0) < 0.1 * whole.size
    moved, best = vector_codes.ball_assign(x, entries, np.zeros(len(x), int))
    assert (moved == before).all() and (best == whole.min(axis=1)).all()


def doc_rows():
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, " ".join(rng.sample(words, rng.randrange(1, 60))), None) for i in range(400)]
    rows += [(1000 + i, rows[3][1].upper(), "t") for i in range(70)]  # copies, more than k
    long = " ".join(rng.choices(words, k=20_000))
    return rows + [(-5, None, None), (-6, "", None), (-7, "?! -", None), (None, rows[5][1], None), rows[6], rows[6], (7777, long, None)]


def item_rows(docs):
    rng = random.Random(8)
    texts = [" ".join(rng.sample(docs[i][1].split(), min(5, len(docs[i][1].split())))) for i in range(3, 30)]
    return [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (0, "w1 w2"), (90, ""), (91, None), (92, "nowhere"), (None, "w1, W3")]


def test_ranked_search_equals_its_sql(spark):
    docs = spark.createDataFrame(doc_rows(), DOCS)
    items = spark.createDataFrame(item_rows(doc_rows()), "item_id long, text string")
    found = ball_search.ranked_documents(docs, items, seed_rows=50)
    con = duckdb.connect()
    documents = pd.DataFrame(doc_rows(), columns=["doc_id", "text", "term"]).astype({"doc_id": "Int64"})
    benchmark = pd.DataFrame(item_rows(doc_rows()), columns=["item_id", "text"]).astype({"item_id": "Int64"})
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    want = con.execute(ball_search.oracle()).fetchall()

    def shown(rows):
        return sorted(map(str, rows))

    assert shown(tuple(r) for r in found.collect()) == shown(want)
    # Any number of shards gives the same.
    split = ball_search.ranked_documents(docs, items, seed_rows=50, shard_bytes=100)
    assert shown(tuple(r) for r in split.collect()) == shown(want)
    assert ball_search.ranked_documents(docs.limit(0), items).collect() == []
    assert ball_search.ranked_documents(docs, items.limit(0)).collect() == []


def test_bounds_hold_and_prune():
    docs = [(i, t) for i, t, _ in doc_rows() if t]
    texts = [x.encode() for _, x in item_rows(doc_rows()) if x]
    held = [sorted({t for words in ball_search.pieces(x) for t in words}) for x in texts]
    number = {t: i for i, t in enumerate(sorted({t for x in held for t in x}))}
    rows = [(False, i, *ball_search.known_terms(t.encode(), number)) for i, t in docs]
    pdf = pd.DataFrame(rows, columns=["none", "doc_id", "n", "term", "tf"])
    for c in ("term", "tf"):
        pdf[c] = [x.astype(np.uint32).tobytes() for x in pdf[c]]
    pdf = pdf[pdf["term"].map(len) > 0]
    items = ball_search.Items(
        np.array([number[t] for x in held for t in x]), np.concatenate([[0], np.cumsum([len(x) for x in held])]),
        np.arange(1, len(number) + 1) * 37 % 9000 + 1, len(docs), int(pdf["n"].sum()), np.ones(len(held), np.int64),
    )
    tree = ball_search.BallTree(ball_search.Block(pdf, items), 4)
    every = np.arange(len(tree.block.items))
    largest = {}
    for node in range(len(tree.ranges)):
        if tree.ranges[node][0] < tree.ranges[node][1]:
            docs_of, scores = tree.scores(node, every)
            assert (tree.bounds(node, every) >= scores.max(axis=0)).all()
            for d, row in zip(docs_of, scores):
                largest[int(d)] = row
    kept, work = ball_search.Kept(items, 5), Counter()
    ball_search.search_block(tree, kept, work)
    assert 0 < work["scored"] < len(pdf) * len(every)
    for j, item in enumerate(tree.block.items):
        kept.trim(int(item))
        best = sorted(((-int(r[j]), tree.block.ids[d]) for d, r in largest.items() if r[j] > 0))[:5]
        assert kept.rows[int(item)] == best
