"""The links of near copies against all pairs, and what large groups cost."""

import random

import numpy as np
import pytest

from evalweave.llm import jaccard, simhash


def edited(words, places, tag):
    out = list(words)
    for p in places:
        out[p] = f"{tag}{p}"
    return " ".join(out)


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]


def near(a, b, least=0.8):
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (len(a) + len(b) - common) - 1e-9


def kept_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r["doc_id"] for r in simhash.one_per_group(df).collect())


@pytest.fixture
def compared(monkeypatch):
    """How many pairs each call compares."""
    counts = []
    plain = jaccard.verified

    def counting(pairs, sets, least):
        counts.append(pairs.count())
        return plain(pairs, sets, least)

    monkeypatch.setattr(jaccard, "verified", counting)
    return counts


def test_links_equal_all_pairs(spark):
    """Groups around and below the threshold, of several sizes, with shared passages."""
    rng = random.Random(11)
    texts = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(rng.choice((30, 80, 150)))]
        for j in range(25):
            edits = rng.sample(range(len(base)), rng.randrange(0, max(2, len(base) // 12)))
            text = edited(base, edits, f"e{j % 9}x")
            texts.append(text if j % 5 else text + " shared passage of many texts in one corpus " * 2)
    sets = [jaccard.shingles(t.encode().split()) for t in texts]
    links = [(a, b) for b in range(len(texts)) for a in range(b) if near(sets[a], sets[b])]
    part = components(len(texts), links)
    assert 12 < len(set(part)) < len(texts)
    assert kept_of(spark, texts) == sorted(set(part))


def test_a_large_group_without_links_costs_no_pairs(spark, compared):
    """2,000 texts of pairwise similarity 0.57 to 0.76: at most a leader per key and round is compared,
    of 2 million pairs."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    places = list(range(7, 140, 5))
    texts = [edited(base, rng.sample(places, 4), f"t{j}x") for j in range(2000)]
    sets = [jaccard.shingles(t.encode().split()) for t in texts[:2]]
    common = len(np.intersect1d(*sets))
    assert 0.55 < common / (len(sets[0]) + len(sets[1]) - common) < 0.8
    assert kept_of(spark, texts) == list(range(2000))
    assert sum(compared) < 40 * 2000 and compared[-1] == 0


def test_a_large_group_of_copies_costs_its_rows(spark, compared):
    """2,000 copies with up to three edits each: one group, found without their pairs."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    texts = [edited(base, rng.sample(range(150), j % 4), f"t{j}x") for j in range(2000)]
    assert kept_of(spark, texts) == [0]
    assert sum(compared) < 20 * 2000


def test_a_sample_holds_equal_rows_once(spark):
    """10,000 rows of one id and text come to the driver as one."""
    from evalweave.llm.common import light_rows, sampled_texts

    text = "some words " * 50
    docs = spark.range(10_000).selectExpr("1L AS doc_id", f"'{text}' AS text").union(
        spark.createDataFrame([(2, "other"), (None, None)], "doc_id long, text string")
    )
    light = light_rows(docs).selectExpr("*", "'all' AS label")
    held, _ = sampled_texts(docs, light, "label", 20_000, 1 << 30)
    assert sorted(map(len, held["raw"])) == [0, 5, len(text)]


def test_fingerprints_link_copies_by_themselves(spark, monkeypatch):
    """Without any MinHash key, copies whose fingerprints link are still one group."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(900)]
    texts = [" ".join(base), edited(base, [400], "x"), edited(base, [850], "y"), " ".join(rng.sample(base, 900))]
    assert (simhash.fingerprint(texts[0].encode()) ^ simhash.fingerprint(texts[1].encode())).bit_count() <= 3
    plain = simhash.similar_links

    def keyless(sketches, *rest):
        from pyspark.sql import functions as F

        return plain(sketches.withColumn("keys", F.array().cast("array<long>")), *rest)

    monkeypatch.setattr(simhash, "similar_links", keyless)
    assert kept_of(spark, texts) == [0, 3]
