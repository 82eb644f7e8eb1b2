"""Operators against plain re-statements of their rules on small random inputs."""

import math
import random
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from evalweave.functions import grams
from evalweave.functions.text import MODEL_FAMILIES
from evalweave.operators import bootstrap, coverage, duplicates, ordering, quality, resume, selection
from evalweave.operators.components import connected_components
from evalweave.operators.prefixes import first_prefix
from evalweave.plans import promotion, runs
from evalweave.sources import documents, jsonl


@pytest.mark.parametrize("spread", [1, 2**22, 2**40])
def test_global_rank(spark, spread):
    rng = random.Random(spread)
    keys = rng.sample(range(-300, 600), 400)
    rows = [(k * spread, f"g{rng.choice('aaaab')}") for k in keys]
    df = spark.createDataFrame(rows, "ord BIGINT, g STRING").repartition(5)
    got = {r["ord"]: r["rank"] for r in ordering.global_rank(df, "ord").collect()}
    assert got == {o: i for i, o in enumerate(sorted(o for o, _ in rows), 1)}
    by_group = {r["ord"]: r["rank"] for r in ordering.global_rank(df, "ord", by=["g"]).collect()}
    for g in {g for _, g in rows}:
        mine = sorted(o for o, h in rows if h == g)
        assert [by_group[o] for o in mine] == list(range(1, len(mine) + 1))


def test_cluster_index_is_dense(spark):
    rows = [(f"r{i % 3}", f"c{i}", 1, 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "g STRING, cluster STRING, s BIGINT, n BIGINT")
    got = bootstrap.with_cluster_index(df, ["g"]).groupBy("g").agg(
        F.array_sort(F.collect_list("idx")).alias("i")
    )
    assert all(r["i"] == list(range(1000)) for r in got.collect())


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    nodes = 120
    edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(60)]
    edges += [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    wanted = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "u BIGINT, v BIGINT")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == wanted


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u BIGINT, v BIGINT")).count() == 0


def play(pool, count, cap, existing):
    """The rounds, one item after the other."""
    used = Counter(k for k in (o.strip().lower() for o in existing) if k)
    queues = defaultdict(list)
    for ord_, family, original in pool:
        queues[family].append((ord_, original.strip().lower()))
    picks, moved = [], True
    while moved and len(picks) < count:
        moved = False
        for queue in queues.values():
            while queue and len(picks) < count:
                ord_, key = queue.pop(0)
                if not (cap and key and used[key] >= cap):
                    used[key] += 1
                    picks.append(ord_)
                    moved = True
                    break
    return picks


@pytest.mark.parametrize("seed, n", [(0, 90), (1, 90), (2, 300), (3, 25)])
def test_balanced_pick(spark, seed, n):
    rng = random.Random(seed)
    families = ["gpt-1", "glm", "zz", "qwen"]
    pool = [
        (i * 3, rng.choices(families, [5, 2, 1, 1])[0], rng.choice(["A", "b ", "c", "d", "e", "", "f"]))
        for i in range(n)
    ]
    existing = ["a", "B", "", "q"]
    df = spark.createDataFrame(
        [(*p, False) for p in pool], "ord BIGINT, source STRING, original_riddle STRING, used_in_set BOOLEAN"
    )
    known = spark.createDataFrame([(e,) for e in existing], "original_riddle STRING")
    for cap in (2, None):
        order = selection.balanced_order(df, cap, known).orderBy("pick").collect()
        got = [r["ord"] for r in order]
        assert got == play(pool, n, cap, existing)
        assert [r["pick"] for r in order] == list(range(1, len(got) + 1))
    for count in (1, 7):
        chosen, after = selection.balanced_pick(df, count, 2, known)
        wanted = play(pool, count, 2, existing)
        assert [r["ord"] for r in chosen.orderBy("pick").collect()] == wanted
        marked = {r["ord"] for r in after.where("used_in_set").collect()}
        assert marked == set(wanted) and after.count() == n


def test_split_sets_are_disjoint_and_capped(spark):
    rows = [(i, "gpt" if i % 2 else "glm", f"o{i % 5}", i % 7 == 0, f"t{i}") for i in range(60)]
    pool = spark.createDataFrame(
        rows, "ord BIGINT, source STRING, original_riddle STRING, used_in_set BOOLEAN, altered_riddle STRING"
    )
    fixed, aux, after = promotion.promote_split(pool, 6, 9, cap=2)
    a = [(r["id"], r["altered_riddle"], r["original_riddle"]) for r in fixed.orderBy("ord").collect()]
    b = [(r["id"], r["altered_riddle"], r["original_riddle"]) for r in aux.orderBy("ord").collect()]
    assert [x[0] for x in a + b] == [f"alt_{i:04d}" for i in range(1, len(a + b) + 1)]
    assert not {x[1] for x in a} & {x[1] for x in b}
    assert max(Counter(x[2] for x in a + b).values()) <= 2
    assert len(a) == 6 and len(b) == 4
    assert after.where("used_in_set").count() == 9 + 10


def test_short_pool_shrinks_in_proportion(spark):
    pool = spark.range(10)
    assert promotion.split_sizes(pool, 30, 70).first()[:] == (3, 7)


def plain_ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def near_texts(seed):
    """Words, near copies of several kinds, a large group of copies, and short texts."""
    rng = random.Random(seed)

    def words(n):
        return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))

    texts = [words(rng.randint(3, 60)) for _ in range(12)]
    for base in list(texts):
        for edits in (1, 2, 4):
            chars = list(base)
            for _ in range(edits):
                at = rng.randrange(len(chars))
                if rng.random() < 0.5:
                    chars[at] = rng.choice("abcxyz")
                else:
                    chars.insert(at, rng.choice("abcxyz"))
            texts.append("".join(chars))
    base = words(25)
    texts += [base[:i] + "q" + base[i:] for i in range(0, 60, 3)]
    texts += ["", " ", "!?", "ab", "AB!", "abc"]
    rng.shuffle(texts)
    return texts


def firsts_of(texts):
    return [i for i, t in enumerate(texts) if t and t not in texts[:i]]


def reached(texts, a, b, threshold):
    """Whether some row with the first text and a later one with the second are similar."""
    ordered = [plain_ratio(texts[a], texts[b])]
    if texts[a] in texts[b + 1 :]:
        ordered.append(plain_ratio(texts[b], texts[a]))
    return max(ordered) >= threshold


@pytest.mark.parametrize("again, groups", [(False, [0, 1]), (True, [0, 0, 0])])
def test_similarity_follows_the_row_order(spark, again, groups):
    """Above 200 characters frequent ones are ignored in the second text of a pair only."""
    short, long = "ab" * 99 + "a", "ba" * 101
    assert plain_ratio(short, long) == 0.0 and plain_ratio(long, short) > 0.99
    texts = [short, long, short][: 2 + again]
    rows = spark.createDataFrame(list(enumerate(texts)), "ord BIGINT, altered_riddle STRING")
    got = duplicates.duplicate_groups(rows).orderBy("ord").collect()
    assert [r["component"] for r in got] == groups


@pytest.mark.parametrize("seed, threshold, budget", [(0, 0.97, None), (1, 0.97, 0), (2, 0.9, 0), (3, 0.8, None)])
def test_similar_pairs_connect_like_all_pairs(spark, seed, threshold, budget):
    import re
    import string

    texts = near_texts(seed)
    clean = [
        re.sub(r"\s+", " ", t.lower().translate(str.maketrans("", "", string.punctuation))).strip()
        for t in texts
    ]
    group = list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(clean)):
        for j in range(i + 1, len(clean)):
            if clean[i] and clean[j] and plain_ratio(clean[i], clean[j]) >= threshold:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    rows = spark.createDataFrame(list(enumerate(texts)), "ord BIGINT, altered_riddle STRING")
    if budget is None:
        got = duplicates.duplicate_groups(rows, threshold)
        assert {r[0]: r[1] for r in got.collect()} == {i: find(i) for i in range(len(texts))}
        return
    nodes = duplicates.distinct_texts(rows)
    edges = duplicates.connecting_pairs(nodes, threshold, pair_budget=budget)
    every = {
        (a, b)
        for a in firsts_of(clean)
        for b in firsts_of(clean)
        if a < b and reached(clean, a, b, threshold)
    }
    assert {tuple(r) for r in duplicates.similar_pairs(nodes, threshold).collect()} == every
    linked = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    firsts = [r["node"] for r in nodes.collect()]
    got = {n: linked.get(n, n) for n in firsts}
    wanted = defaultdict(set)
    for n in firsts:
        wanted[find(n)].add(n)
    found = defaultdict(set)
    for n, c in got.items():
        found[c].add(n)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))


def test_texts_are_compared_once_where_no_pair_was_left_out(spark, monkeypatch):
    """Comparing all lengths is the quadratic step; a second pass needs pairs that the first withheld."""
    passes = []
    plain = duplicates._candidates
    monkeypatch.setattr(duplicates, "_candidates", lambda *a, **k: passes.append(1) or plain(*a, **k))
    base = "the quick brown fox jumps over the lazy dog while seven wizards pack my box with jugs "
    texts = [base + str(k) for k in range(12)] + ["something else " * 9 + str(k) for k in range(12)]
    rows = spark.createDataFrame(list(enumerate(texts)), "ord BIGINT, altered_riddle STRING")
    edges = duplicates.connecting_pairs(duplicates.distinct_texts(rows), pair_budget=0)
    linked = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert linked == {k: k // 12 * 12 for k in range(24)} and len(passes) == 1


def test_a_large_class_of_lengths_is_not_copied(spark):
    """A class goes once to its own comparison as long as its counts fit; texts without a pair are not moved."""
    length = 1_500
    cls = int(math.log(length) / duplicates._class_step(0.97))
    live = spark.range(40_000).selectExpr(
        "id AS node", "id AS comp", f"{length} AS len", f"{cls} AS cls", "binary('c') AS chars", "binary('g') AS grams",
        "CAST(NULL AS BINARY) AS below",
    )
    assert duplicates._blocks(live, live, 0.97).count() == 40_000


@pytest.mark.parametrize("few", [1 << 20, 1])
def test_only_texts_with_a_pair_are_moved(spark, monkeypatch, few):
    monkeypatch.setattr(duplicates, "_FEW", few)
    base = "the quick brown fox jumps over the lazy dog while seven wizards pack my box with jugs "
    rows = [(k, k, base + str(k)) for k in range(6)] + [(k, k, f"{k} something else " * 9) for k in range(6, 40)]
    texts = duplicates._with_class(spark.createDataFrame(rows, "node BIGINT, last BIGINT, text STRING"), 0.97)
    pairs = spark.createDataFrame([(0, 1), (0, 4), (3, 30)], "u BIGINT, v BIGINT")
    found = duplicates._verified(pairs, texts, 0.97, every=True)
    assert ("LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()) == (few > 1)
    assert sorted(map(tuple, found.collect())) == [(0, 1), (0, 4)]


def test_signatures_lose_no_pair():
    """Similar random texts share as many signature elements as promised."""
    import math

    rng = random.Random(5)
    for threshold in (0.97, 0.9, 0.8):
        q = grams.gram_size(threshold)
        for _ in range(300):
            a = "".join(rng.choices("abcd", k=rng.randint(20, 150)))
            b = list(a)
            for _ in range(rng.randint(1, max(1, int(len(a) * (1 - threshold))))):
                at = rng.randrange(len(b))
                b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
            b = "".join(b)
            if a == b or plain_ratio(a, b) < threshold:
                continue
            signatures, needed = [], []
            for t in (a, b):
                elements = sorted(grams.gram_elements(t, q).tolist())
                need = grams.least_shared(len(t), threshold, q)
                k = min(grams.shared_elements(len(t), q), need)
                signatures.append(set(elements[: len(elements) - need + k]))
                needed.append(k)
                total = grams.least_partner_total(len(t), threshold)
                assert need == max(math.ceil(grams.shared_gram_bound(total, threshold, q) - 1e-6), 1)
            assert len(signatures[0] & signatures[1]) >= min(needed)


def test_representative_is_first_with_most_answers(spark):
    rows = spark.createDataFrame(
        [(0, "a", "Tide!", ["x"]), (1, "b", "tide", ["x", "y"]), (2, None, "TIDE", ["x", "y"]), (3, "d", "other", [])],
        "ord BIGINT, id STRING, altered_riddle STRING, altered_accepted_answers ARRAY<STRING>",
    )
    got = duplicates.mark_duplicates(rows, threshold=2.0).orderBy("ord").collect()
    assert [(r["dedup_retained"], r["dedup_duplicate_of"]) for r in got] == [
        (False, "b"), (True, None), (False, "b"), (True, None)
    ]


def test_bootstrap_repeats_over_partitions(spark):
    rng = random.Random(1)
    rows = [(f"r{i % 2}", f"c{i % 37}", rng.random()) for i in range(400)]
    scores = spark.createDataFrame(rows, "run STRING, cluster STRING, score DOUBLE")
    near = sorted(map(tuple, bootstrap.bootstrap_bounds(scores, ["run"], 200).collect()))
    far = sorted(map(tuple, bootstrap.bootstrap_bounds(scores.repartition(7), ["run"], 200).collect()))
    assert near == far
    assert all(lo < mean < hi for _, _, _, mean, lo, hi in near)


def test_few_clusters_use_the_normal_interval(spark):
    scores = spark.createDataFrame(
        [("r", f"c{i % 4}", float(i % 2)) for i in range(8)], "run STRING, cluster STRING, score DOUBLE"
    )
    ci = bootstrap.clustered_ci95(scores, ["run"], 50).first()["ci95"]
    assert ci == round(1.96 * (0.5 * 0.5 / 8) ** 0.5, 4)


def _per_riddle(spark, shift):
    rows = [
        (run, f"q{i}", f"c{i}", min(1.0, (i % 3) / 4 + (0.6 if run == "b" else 0.0) * shift), True)
        for run in ("a", "b") for i in range(30)
    ]
    return spark.createDataFrame(
        rows, "run_id STRING, riddle_id STRING, cluster STRING, override_mean DOUBLE, original_solved BOOLEAN"
    )


def test_pair_signs_and_spread(spark):
    board = spark.createDataFrame([("a", 1), ("b", 2)], "run_id STRING, rank INT")
    flipped = spark.createDataFrame([("b", 1), ("a", 2)], "run_id STRING, rank INT")
    clear = _per_riddle(spark, 1.0)
    assert bootstrap.pair_signs(clear, board, 200).first()["sign"] == 1
    assert bootstrap.pair_signs(clear, flipped, 200).first()["sign"] == -1
    spread = bootstrap.rank_spread(board, bootstrap.pair_signs(clear, board, 200))
    assert sorted(map(tuple, spread.collect())) == [("a", 1, 1), ("b", 2, 2)]
    equal = bootstrap.rank_spread(board, bootstrap.pair_signs(_per_riddle(spark, 0.0), board, 200))
    assert sorted(map(tuple, equal.collect())) == [("a", 1, 2), ("b", 1, 2)]
    single = board.where("rank = 1")
    alone = bootstrap.rank_spread(single, bootstrap.pair_signs(clear, single, 200))
    assert alone.first()[:] == ("a", 1, 1)


def test_tiles_equal_all_pairs_and_move_fewer_rows(spark):
    rng = random.Random(5)
    rows = [
        (f"r{r:02}", f"q{i}", None if i == 7 else f"c{i // 4 if i < 24 else 99}",
         None if (r, i) == (3, 2) else rng.randrange(4) / 3, rng.random() < 0.8)
        for r in range(64) for i in range(40)
    ]
    items = spark.createDataFrame(
        rows, "run_id STRING, riddle_id STRING, cluster STRING, override_mean DOUBLE, original_solved BOOLEAN"
    ).cache()
    board = spark.createDataFrame([(f"r{r:02}", 64 - r) for r in range(64)], "run_id STRING, rank INT")
    pairs = bootstrap.cluster_sums(bootstrap.shared_solved(items, board), ["run_a", "run_b"])
    wanted = {tuple(r[:3]): (r["s"] or 0, r["n"]) for r in pairs.collect()}
    for tile, size in [(16, 4096), (5, 6)]:
        sums = bootstrap.tiled_pair_sums(items, board, tile, size)
        got = {(r["run_a"], r["run_b"], r["cluster"]): (r["s"], r["n"]) for r in sums.collect()}
        assert got == wanted
    solved = items.where("original_solved").count()
    moved = bootstrap.in_tiles(items, board)
    assert moved.count() == solved * 64 // bootstrap.TILE
    assert moved.count() * 4 < bootstrap.shared_solved(items, board).count()
    largest = bootstrap.in_tiles(items, board, 16, 6).groupBy("tile_a", "tile_b", "part").count()
    assert largest.where("tile_a = tile_b").select("part").distinct().count() > 1
    assert bootstrap.tiled_pair_sums(items.limit(0), board).count() == 0


def test_first_prefix_is_the_declared_one(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abé", k=rng.randrange(6))) for _ in range(300)]
    table = sorted({w[: rng.randrange(1, 4)] for w in words[:30]} - {""})
    rng.shuffle(table)
    prefixes = spark.createDataFrame(
        [(p, p.upper(), i) for i, p in enumerate(table)] + [(None, "no", -1)],
        "prefix STRING, value STRING, ord BIGINT",
    )
    items = spark.createDataFrame(
        [(i, w, "old") for i, w in enumerate(words)] + [(-1, None, "old")], "ord BIGINT, key STRING, hit STRING"
    )
    got = {r["ord"]: r["hit"] for r in first_prefix(items, "key", prefixes, "hit").collect()}
    wanted = {i: next((p.upper() for p in table if w.startswith(p)), None) for i, w in enumerate(words)}
    assert got == {**wanted, -1: None}
    assert first_prefix(items, "key", prefixes.limit(0), "hit").where("hit IS NOT NULL").isEmpty()


def test_family_table_equals_the_built_in_list(spark):
    sources = ["openai/GPT-4", " Gemini-b", "qwen", "x/y", "openai/", "", None, "command-r", "gptx/glm-4"]
    items = spark.createDataFrame([(s,) for s in sources], "source STRING")
    families = spark.createDataFrame(
        [(p, f, i) for i, (p, f) in enumerate(MODEL_FAMILIES)], "prefix STRING, value STRING, ord BIGINT"
    )
    built_in = {r["source"]: r["family"] for r in selection.with_family(items).collect()}
    assert {r["source"]: r["family"] for r in selection.with_family(items, families).collect()} == built_in


def test_constants_are_one_row(spark):
    rows, two = spark.range(3), spark.range(2).withColumnRenamed("id", "base")
    assert ordering.with_constants(rows, two.where("base = 1")).agg(F.sum("base")).first()[0] == 3
    assert ordering.with_constants(rows, two.where("base > 1")).where("base IS NULL").count() == 3
    with pytest.raises(Exception, match="more than one row"):
        ordering.with_constants(rows, two).collect()


def test_mixed_reasoning_settings_fail(spark):
    rows = [(0, "r", "m", "p", None, True, "high"), (1, "r", "m", "p", None, False, "high")]
    outputs = spark.createDataFrame(
        rows,
        "ord BIGINT, run_id STRING, model STRING, provider STRING, quantization STRING, "
        "reasoning_enabled BOOLEAN, reasoning_effort STRING",
    )
    with pytest.raises(Exception, match="Inconsistent reasoning settings"):
        quality.checked_run_metadata(outputs).collect()
    off = outputs.where("not reasoning_enabled").unionByName(
        outputs.where("not reasoning_enabled").withColumn("reasoning_effort", F.lit("low"))
    )
    assert quality.checked_run_metadata(off).first()["reasoning_effort"] is None


@pytest.mark.parametrize("indexes, chosen", [([2, 3], 2), ([3, 1], 1), ([None, 2], None)])
def test_representative_sample(spark, indexes, chosen):
    rows = [(i, "r", "q", "altered", s) for i, s in enumerate(indexes)]
    df = spark.createDataFrame(
        rows, "ord BIGINT, run_id STRING, riddle_id STRING, riddle_type STRING, sample_index INT"
    )
    assert ordering.representative_samples(df).first()["sample_index"] == chosen


def test_resume_is_idempotent(spark):
    entries = spark.createDataFrame(
        [(0, "a", "o", "t0"), (1, "b", "o", "t1"), (2, "c", "", "t2"), (3, "d", "p", "")],
        "ord BIGINT, id STRING, original_riddle STRING, altered_riddle STRING",
    )
    tasks = runs.build_tasks(entries, num_samples=2, temperature=0.5)
    got = [(r["riddle_id"], r["riddle_type"], r["sample_index"]) for r in tasks.orderBy("ord").collect()]
    assert got == [
        ("a", "original", 1), ("a", "altered", 1), ("a", "altered", 2), ("b", "altered", 1),
        ("b", "altered", 2), ("c", "altered", 1), ("c", "altered", 2), ("d", "original", 1),
    ]
    assert runs.build_tasks(entries, num_samples=2, temperature=0.5, done=tasks).count() == 0
    assert runs.build_tasks(entries, num_samples=2, temperature=0.0).where("sample_index > 1").count() == 0
    without_index = tasks.where("riddle_id = 'a' AND sample_index = 1").withColumn(
        "sample_index", F.lit(None).cast("int")
    )
    assert resume.pending_tasks(tasks, without_index).count() == 6


def test_cyclic_picks(spark):
    source = spark.createDataFrame([(i, f"s{i}") for i in range(3)], "riddle_idx BIGINT, riddle STRING")
    none = spark.createDataFrame([], "original_riddle STRING")
    picks = selection.least_represented(source, none, 7).collect()
    assert sorted(Counter(r["riddle_idx"] for r in picks).values()) == [2, 2, 3]
    used = spark.createDataFrame([("S0 ",), ("s0",), ("s1",)], "original_riddle STRING")
    order = selection.least_represented(source, used, 3).orderBy("call_idx").collect()
    assert [r["riddle_idx"] for r in order] == [2, 1, 0]


def test_missing_items(spark):
    rng = random.Random(4)
    items = [f"i{i}" for i in range(12)]
    entries = spark.createDataFrame(
        [(i, x, f"t{i % 5}" if i % 7 else None) for i, x in enumerate(items)] + [(99, None, "t9")],
        "ord BIGINT, id STRING, original_riddle STRING",
    )
    expected = {("altered", x) for x in items}
    first = {}
    for i, x in enumerate(items):
        if i % 7:
            first.setdefault(f"t{i % 5}", x)
    expected |= {("original", x) for x in first.values()}
    seen = {("full", *e) for e in expected} | {
        ("some", *e) for e in sorted(expected) if rng.random() < 0.5
    }
    rows = [*seen, *list(seen)[:5], ("some", "altered", None), ("some", "altered", "other")]
    details = spark.createDataFrame(rows, "run_id STRING, riddle_type STRING, riddle_id STRING")
    names = spark.createDataFrame([("full",), ("some",), ("none",)], "run_id STRING")
    got = coverage.missing_items(names, details, entries)
    want = {(r, *e) for r in ("some", "none") for e in expected} - seen
    assert Counter(tuple(x) for x in got.collect()) == Counter(want)
    assert not coverage.missing_items(names, details, entries.where("false")).collect()


def test_write_jsonl_over_its_own_source(spark, tmp_path):
    path = str(tmp_path / "rows")
    jsonl.write_jsonl(spark.range(7).selectExpr("id", "cast(null as string) AS t"), path)
    for k in (1, 2):
        held = jsonl.scan_jsonl(spark, path, "id BIGINT, t STRING").drop("ord")
        jsonl.write_jsonl(held.withColumn("id", F.col("id") + 1), path)
        assert {r["id"] for r in spark.read.json(path).collect()} == set(range(k, 7 + k))
    assert [p.name for p in tmp_path.iterdir()] == ["rows"]


def test_release_keeps_nulls(spark, tmp_path):
    source, target = tmp_path / "entries.jsonl", str(tmp_path / "out")
    source.write_text(
        '{"id": "a", "type": null, "set": "fixed", "original_answer": 7}\n\n{"original_riddle": "ü"}\n'
    )
    released = documents.release_export(spark, str(source), target)
    lines = sorted(r["value"] for r in spark.read.text(target).collect())
    assert lines == ['{"id":"a","type":null,"original_answer":7}', '{"original_riddle":"ü"}']
    assert "set" not in released.columns
    source.write_text('{"id": "a"}\n{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        documents.release_export(spark, str(source), target)


def test_least_represented_with_large_counts(spark, monkeypatch):
    counts = [(1, 2**33), (2, 2**31), (3, 0), (4, 2**33 + 1), (5, 2**31)]
    table = spark.createDataFrame(counts, "riddle_idx BIGINT, n BIGINT")
    monkeypatch.setattr(selection, "with_representation", lambda source, raw: table)
    picks = selection.least_represented(table, table, 7).orderBy("call_idx").collect()
    order = [r["riddle_idx"] for r in picks]
    assert order[0] == 3 and set(order[1:3]) == {2, 5} and order[3:5] == [1, 4]
    assert order[5:] == order[:2]


def test_content_joins_move_digests_only(spark):
    """The keys of finished items are shuffled as 32 bytes, never as texts."""
    from evalweave.operators.resume import without_content

    schema = "ord BIGINT, original_riddle STRING, altered_riddle STRING"
    items = spark.createDataFrame([(1, "a", "b"), (2, "A ", "b"), (3, "a", ""), (4, "ab", ""), (5, "a\",\"", "b"), (6, "c", "d")], schema)
    done = spark.createDataFrame([(9, " a", "B"), (9, "c", None), (9, "a", "\",\"b")], schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        left = without_content(items, done, done)
        assert sorted(r["ord"] for r in left.collect()) == [3, 4, 5, 6]
        plan = left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(_digest" in plan and "hashpartitioning(_key" not in plan and "Aggregate" not in plan


def test_missing_items_of_many_runs(spark):
    """Gaps between run numbers are the missing runs, at the ends and inside."""
    from evalweave.operators import coverage

    rng = random.Random(3)
    ids = [f"i{n}" for n in range(6)]
    entries = spark.createDataFrame([(i, "fixed", 1) for i in ids], "id STRING, set_name STRING, ord BIGINT")
    held = {f"r{n}": set(rng.sample(ids, rng.randrange(0, 7))) for n in range(40)}
    numbers = spark.createDataFrame([(r,) for r in held], "run_id STRING")
    short = [(r, i) for r, got in held.items() if len(got) < 6 for i in ids if i not in got]
    details = spark.createDataFrame([(r, "altered", i) for r, got in held.items() for i in got], "run_id STRING, riddle_type STRING, riddle_id STRING")
    report = numbers.withColumn("missing_altered", coverage.F.lit(1)).withColumn("missing_original", coverage.F.lit(0))
    full = [r for r, got in held.items() if len(got) == 6]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(coverage, "coverage_report", lambda *_: report.where(~coverage.F.col("run_id").isin(full)) if full else report)
        patch.setattr(coverage, "covered", lambda d: d)
        patch.setattr(coverage, "expected_coverage", lambda e: e.selectExpr("'altered' AS riddle_type", "id AS riddle_id"))
        found = coverage.missing_items(numbers, details, entries).collect()
    assert sorted((r["run_id"], r["riddle_id"]) for r in found) == sorted(short)
