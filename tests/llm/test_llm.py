"""The training-data operators on small tables: edge rows, brute force, and SQL."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from evalweave.llm import (
    decontaminate,
    language,
    licenses,
    line_dedup,
    lm_score,
    mixing,
    quality_model,
    quality_rules,
    simhash,
    toxicity,
)
from evalweave.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Score double, row string"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))


def rows():
    texts = [
        None, "", " \n\t", "one", "a b c d e f", "a b c d e f", "x\ny\nz\nw", "q\nx\ny\nz", "Ünïcode ẞ   x",
        "released under the mit license", LONG, LONG, "l\nl\nl\nl\nl", "# $ % & |", "1234 5678",
    ]
    out = [
        (i, t, None if i % 4 == 3 else ("en", "de")[i % 2], None if i % 5 == 4 else f"s{i % 3}", None, 0.5, "r")
        for i, t in enumerate(texts)
    ]
    return out + [out[4], out[4], (None, "a b c d e f", None, None, 1, None, None), (None, None, None, None, 1, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    known = [(i, i % 2, (i // 2) % 2) for i in range(12)] + [(3, 0, 0), (None, 1, 1), (4, None, None)]
    return spark.createDataFrame(known, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    held = [(1, "a b c. d e f"), (1, "a b c. d e f"), (2, ""), (3, None), (4, LONG[:700])]
    return spark.createDataFrame(held, "item_id long, text string")


def words(text):
    return (text or "").encode().lower().split()


OPERATORS = {
    "op1": lambda d, l, i: decontaminate.find_leaks(d, i),
    "op2": lambda d, l, i: lm_score.score_documents(d),
    "op3": lambda d, l, i: mixing.mix_report(d),
    "op4": lambda d, l, i: line_dedup.dedup_report(d),
    "op5": lambda d, l, i: licenses.license_scan(d),
    "op6": lambda d, l, i: language.identify_language(d),
    "op7": lambda d, l, i: quality_model.classify_quality(d),
    "op8": lambda d, l, i: simhash.near_duplicates(d),
    "op9": lambda d, l, i: toxicity.toxicity(d, l),
    "op10": lambda d, l, i: quality_rules.risk_controlled_rules(d, l),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_and_empty_tables(name, docs, empty, labels, items):
    out = OPERATORS[name](docs, labels, items).collect()
    if name != "op1":
        assert len(out) == len(rows())
    for d, l, i in ((empty, labels, items), (empty, labels.limit(0), items.limit(0))):
        assert OPERATORS[name](d, l, i).collect() == []
    if name not in ("op1",):
        assert len(OPERATORS[name](docs, labels.limit(0), items.limit(0)).collect()) == len(rows())


def test_filters_keep_other_columns(docs, empty, items):
    for keep in (
        quality_model.keep_good,
        line_dedup.remove_repeated_windows,
        simhash.one_per_group,
        lambda d: decontaminate.drop_leaks(d, items),
    ):
        assert keep(docs).columns == docs.columns and keep(docs).count() > 0
        assert keep(empty).count() == 0
    mixed = mixing.mixture(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns


def test_leaks(docs, items):
    found = decontaminate.find_leaks(docs, items).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert pairs == {(4, 1), (5, 1), (None, 1), (10, 4), (11, 4)}


def test_leak_after_a_question_without_its_answer():
    rng = random.Random(2)
    question = [f"q{i}" for i in range(60)]
    answer = [f"a{i}" for i in range(40)]
    filler = [f"f{rng.randrange(3000)}" for _ in range(4000)]
    whole = question + answer
    item = (1, " ".join(whole), " ".join(question), " ".join(answer))
    parts = [(0, p) for p in decontaminate.parts_of([w.encode() for w in whole])]
    frequency = {w.encode(): 1 for w in whole}
    index = decontaminate.build_index([item], parts, frequency, len(parts), 50.0)

    def found(*parts):
        text = " ".join(w for part in parts for w in part).encode()
        return decontaminate.leaks_in(text, index, 96, 32, 0.5, 0.5)

    other = question + [f"b{i}" for i in range(40)]
    for first in (question, other):  # the answer is missing or another one
        assert found(first, filler[:1000]) == {}
        # Both places hold a whole part of the item, so the first one ties with the leak.
        hit = found(first, filler[:1000], whole, filler[1000:1500])
        assert set(hit) == {1} and hit[1][1:3] == (1.0, 1.0)
    assert found(answer, filler[:1000], question) == {}


@pytest.mark.parametrize("least", [0.25, 0.6])
def test_wand_finds_what_all_pairs_find(least):
    rng = random.Random(3)
    vocabulary = [f"w{i}".encode() for i in range(60)]
    parts = [(k, rng.choices(vocabulary, k=rng.randint(3, 20))) for k in range(90)]
    parts += [(90, parts[7][1]), (91, [b"alone"])]
    frequency = Counter(w for _, p in parts for w in set(p))
    index = decontaminate.build_index([(k, "", None, None) for k, _ in parts], parts, frequency, 92, 11.0)
    stream = rng.choices(vocabulary, k=400) + parts[7][1] + [b"none"] * 40 + [b"alone"]
    ids = np.array([index.terms.get(w, 0) for w in stream], np.int32)
    begin, terms = decontaminate.passages_of(ids, 32, 8)
    expected = {}
    for at in begin:
        held = set(stream[at : at + 32])
        for k, words_ in parts:
            norm = 1.2 * (0.25 + 0.75 * len(words_) / 11.0)
            weight = {
                w: math.log1p((92 - frequency[w] + 0.5) / (frequency[w] + 0.5)) * tf * 2.2 / (tf + norm)
                for w, tf in Counter(words_).items()
            }
            score = sum(x for w, x in weight.items() if w in held) / sum(weight.values())
            if score >= least:
                expected[int(at), k] = score
    rows, which, scores = index.hits(terms, least)
    found = {(int(begin[r]), int(p)): float(x) for r, p, x in zip(rows, which, scores, strict=True)}
    assert len(found) == len(rows) and found.keys() == expected.keys() and len(found) > 20
    assert all(abs(found[k] - expected[k]) < 1e-8 for k in found)


def test_documents_read_together_or_alone_give_the_same_leaks(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=80)) for _ in range(30)]
    parts = [(k, p) for k, t in enumerate(texts) for p in decontaminate.parts_of(words(t))]
    frequency = Counter(w for _, p in parts for w in set(p))
    index = decontaminate.build_index([(str(k), t, None, None) for k, t in enumerate(texts)], parts, frequency, len(parts), 40.0)
    docs = [b"", b"nothing known"] + [" ".join(rng.choices(texts, k=rng.randint(1, 90))).encode() for _ in range(40)]
    alone = [decontaminate.leaks_in(d, index, 96, 32, 0.5, 0.5) for d in docs]
    assert sum(map(bool, alone)) == 40
    for batch in (1, 50, 1 << 13):
        monkeypatch.setattr(decontaminate, "_BATCH", batch)
        assert list(decontaminate.leaks_of(docs, index, 96, 32, 0.5, 0.5)) == alone


def test_item_ids_of_any_type_and_shards(spark, docs):
    held = [("q1", "a b c. d e f"), (None, LONG[:700]), ("q1", None), (" q1", "a b c. d e f")]
    items = spark.createDataFrame(held, "item_id string, text string")
    found = decontaminate.find_leaks(docs, items)
    assert dict(found.dtypes)["item_id"] == "string"
    assert "MapInPandas" in plan_of(found) and plan_of(found).count("MapInPandas") == 1
    whole = sorted(found.collect(), key=str)
    pairs = {(r["doc_id"], r["item_id"]) for r in whole}
    assert pairs >= {(4, "q1"), (4, " q1"), (5, "q1"), (10, None), (11, None)}
    many = spark.range(1200).selectExpr("id item_id", "concat('t', id, ' u', id, ' v', id % 7, '. z', id) text")
    plan = plan_of(decontaminate.find_leaks(docs, many))
    assert plan.count("MapInPandas") == 1
    indexes = list(decontaminate.item_indexes(many, shard_parts=300))
    assert len(indexes) == 4 and sum(len(i.owner) for i in indexes) == 1200


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_language_model_base_and_gain(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = {r["doc_id"]: r for r in lm_score.score_documents(docs, block_bytes=50_000, bucket_tokens=20_000).collect()}
    held = {r["doc_id"]: words(r["text"]) + [b" e"] for r in docs.collect()}
    out = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in held}
    counts = Counter(w for d, t in held.items() if not out[d] for w in t)
    n, v = sum(counts.values()), len(counts)
    for d, t in held.items():
        r = found[d]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert r["base_score"] == pytest.approx(base) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"], r["held_out"]) == (len(t), sum(w in counts for w in t), out[d])
    assert sum(r["score"] for r in found.values() if r["held_out"]) > sum(
        r["base_score"] for r in found.values() if r["held_out"]
    )


def test_mixture_weights_sum_to_one():
    weights = lm_score.mixture_weights({(1, 80, 8): 30, (1, 1 << 20, 8): 10, (3, 1 << 20, 1 << 20): 4})
    assert np.allclose(weights.sum(axis=1), 1) and (weights[:, 2] > 0).all()
    assert weights[1, 0] > weights[3, 0]


def test_mix_targets_and_shards(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = mixing.mix_report(docs, block_words=500, shard_blocks=4).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size, target, taken = Counter(), {}, Counter()
    for r in out:
        s = source[r["doc_id"]]
        size[s] += r["size"]
        target[s] = r["target"]
        taken[s] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    full, total = set(), sum(size.values())
    while True:
        rest = total - sum(3 * size[s] for s in full)
        level = rest / sum(weight[s] for s in weight if s not in full)
        more = {s for s in weight if s not in full and level * weight[s] > 3 * size[s]}
        if not more:
            break
        full |= more
    for s in size:
        assert target[s] == pytest.approx(3 * size[s] if s in full else level * weight[s])
        assert abs(taken[s] - target[s]) <= max(r["size"] for r in out if source[r["doc_id"]] == s) / 2 + 1
    again = mixing.mix_report(docs, block_words=500, shard_blocks=4).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_shard_quotas_add_up():
    blocks = [70, 0, 3, 27]
    quotas = [mixing.shard_quotas(blocks, s, 7, 1) for s in range(7)]
    assert np.sum([q for q, _ in quotas], axis=0).tolist() == blocks
    for (q, o), (_, after) in zip(quotas, quotas[1:], strict=False):
        assert (o + q == after).all()


def test_trie_finds_every_link(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for x in base[:20]:
        for _ in range(30):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fp long")
    for most in (50_000, 8):  # 8: nodes are split as a table
        rows = simhash.component_of_prints(df, 3, most).collect()
        groups = {}
        for r in rows:
            groups.setdefault(r["component"], set()).add(r["fp"] % (1 << 64))
        want = {}
        for p in prints:
            want.setdefault(find(p), set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_fingerprint_bits():
    text = "The quick  brown\tfox jumps over the lazy dog"
    w = words(text)
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode()) % (1 << 64) == want
    assert simhash.fingerprint(b" \n") == 0


def test_one_document_of_each_group_stays(docs):
    kept = [r["doc_id"] for r in simhash.one_per_group(docs).collect()]
    assert 4 in kept and 5 not in kept and kept.count(4) == 1 and 10 in kept and 11 not in kept


def test_edited_near_copies_leave_the_groups(spark):
    rng = random.Random(11)
    texts = []
    for i in range(30):
        text = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts.append(text)
        for gap in (25, 40, 70):  # a changed word touches five shingles
            copy = list(texts[-1] if i % 2 else text)
            for at in range(rng.randrange(10), len(copy), gap):
                copy[at] = f"new{rng.randrange(10**6)}"
            texts.append(copy)
    sets = [{tuple(t[j : j + 5]) for j in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    joined = [(i, (" " if i % 3 else "\n").join(t).upper()) for i, t in enumerate(texts)]
    df = spark.createDataFrame(joined, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.one_per_group(df).collect())
    assert kept == sorted(set(root)) and 30 <= len(kept) < len(texts)


def test_rule_counts():
    assert quality_rules.rule_counts(b"a b c a b c\n#x\n\n#x\n") == (8, 10, 2, 1, 6)
    assert quality_rules.rule_counts(b"") == (0, 0, 0, 0, 0)
    assert quality_rules.binomial_cdf(2, 10, 0.3) == pytest.approx(0.3827827864)
    assert quality_rules.binomial_cdf(9, 10, 0.3) == pytest.approx(1 - 0.3**10)
    assert quality_rules.safe_cutoff([0, 1, 90], 1000, (3.0, 2.0, 1.0), 0.02, 0.01) == 2.0
    assert quality_rules.safe_cutoff([0], 5, (3.0,), 0.02, 0.01) is None


def test_neighbouring_licenses_are_told_apart(spark):
    notices = [
        ("Licensed under CC BY-SA 4.0", ""), ("Licensed under CC BY 4.0", ""),
        ("Released under the Apache License", ""), ("Licensed under the Mozilla Public License, Version 2.0", ""),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1", ""),
        ("This work is licensed under the GNU General Public License, version 2", ""),
        ("subject to the terms of the Eclipse Public License, v. 2.0", ""),
        ("Licensed under a Creative Commons Attribution license", ""),
        ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software", ""),
    ]
    notices += [(text, label) for label, text in licenses.TEMPLATES]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(notices)], "doc_id long, text string")
    found = {r["doc_id"]: r["labels"] for r in licenses.license_scan(df).collect()}
    assert found == {i: label for i, (_, label) in enumerate(notices)}
    # The SQL holds the whole definition: the same on neighbouring notices, also in longer texts.
    rows = [(i, t if i % 2 else "filler " * (i % 70) + t + " more" * 90) for i, (t, _) in enumerate(notices)]
    documents = pd.DataFrame([*rows, (900, None), (901, notices[-1][0] + " " + notices[-2][0])], columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", documents)
    result = con.execute(licenses.oracle())
    names = [c[0] for c in result.description]
    want = sorted(map(str, result.fetchall()))
    same = licenses.license_scan(spark.createDataFrame(documents.astype(object).where(documents.notna(), None).values.tolist(), "doc_id long, text string"))
    assert sorted(str(tuple(r[n] for n in names)) for r in same.collect()) == want
    # A template longer than a block of 64 words is still found.
    long = " ".join(f"term{i}" for i in range(150))
    df = spark.createDataFrame([(1, "x " * 40 + long)], "doc_id long, text string")
    assert [r["labels"] for r in licenses.license_scan(df, [("own", long)]).collect()] == ["own"]


def test_small_strata_get_joint_cutoffs(spark):
    plain = lambda i: " ".join(f"word{(i * 7 + j) % 997}" for j in range(60))
    texts = [(s * 1000 + i, plain(i), f"l{s}") for s in range(4) for i in range(300)]
    texts += [(s * 1000 + 900, plain(0) + " #$%" * 200, f"l{s}") for s in range(4)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    known = spark.createDataFrame([(t[0], int(t[0] % 1000 != 900)) for t in texts], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.risk_controlled_rules(docs, known).collect()}
    assert {d for d, k in kept.items() if not k} == {900, 1900, 2900, 3900}
    # A single rule has the whole error: 217 good labels without a rejection suffice, 216 do not.
    one = lambda n: quality_rules.joint_cutoffs(np.array([[2]]), np.array([n]), [2], 0.02, 0.0125)
    assert one(217) == [1] and one(216) == [None]
    # A rule that rejects everything ends the walk with all rules, not the one without it; the
    # procedure is the same at every size, so more labels never lose a cutoff.
    found = [quality_rules.joint_cutoffs(np.array([[0, 3]]), np.array([n]), [3, 3], 0.02, 0.0125) for n in range(200, 500)]
    least = quality_rules.labels_needed(0.02, 0.0125 / 4)
    assert found == [[None, 2 if n >= least else None] for n in range(200, 500)]
    walks = quality_rules.walks_of(5, 0.0125)
    assert sum(share for _, share in walks) == pytest.approx(0.0125) and len(walks) == 6
    assert [quality_rules.labels_needed(0.02, share) for _, share in walks[:2]] == [252, 331]


def test_verdicts_against_brute_force(spark):
    """Cutoffs by the definition over plain rows, repeated rows counted once."""
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        words_ = [f"w{rng.randrange(600)}" for _ in range(rng.randrange(40, 90))]
        words_ += ["#"] * rng.choice((0, 0, 0, 0, 0, 8, 60))
        rows.append((i, " ".join(words_), "ab"[i % 2]))
    rows += [rows[5]] * 50
    good = {i: int(rows[i][1].count("#") < 9 or i % 300 == 0) for i in range(1500)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = spark.createDataFrame(list(good.items()), "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.risk_controlled_rules(docs, known).collect()}

    def statistics(text):
        n, chars, symbols, lines, repeats = quality_rules.rule_counts(text.encode())
        values = (symbols / n, repeats / n, lines / n, chars / n, -chars / n)
        return n < 50 or 100 * repeats > 50 * n, values

    want = {}
    for lang in "ab":
        own = {i: statistics(t) for i, t, x in rows if x == lang}
        held = [v for i, (base, v) in own.items() if good[i] and not base]
        best, most, spare = None, 0, 0.0
        for use, share in quality_rules.walks_of(5, 0.05 / 2):
            reached = None
            for level in range(8):
                cut = {
                    r: quality_rules.RULES[r].cutoffs[level * (len(quality_rules.RULES[r].cutoffs) - 1) // 7] for r in use
                }
                lost = sum(any(v[r] > c for r, c in cut.items()) for v in held)
                if sum(math.comb(len(held), k) * 0.02**k * 0.98 ** (len(held) - k) for k in range(lost + 1)) > share + spare:
                    break
                reached = (level, cut)
            spare = share + spare if reached and reached[0] == 7 else 0.0
            if reached:
                strict = sum(quality_rules.RULES[r].cutoffs.index(c) + 1 for r, c in reached[1].items())
                if strict > most:
                    best, most = reached[1], strict
        for i, (base, v) in own.items():
            want[i] = not base and not any(v[r] > c for r, c in (best or {}).items())
    assert got == want and 0 < sum(want.values()) < 1500


def test_codewords_differ():
    for k in (2, 3, 5, 7, 12, 40):
        code = language.codewords(k)
        assert len({tuple(r) for r in code.tolist()}) == k


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    out = [r for r in language.identify_language(docs).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) >= 0.97 * len(out)
    known = {r["doc_id"]: r for r in labels.collect()}
    kept = {r["doc_id"]: r["kept"] for r in quality_model.classify_quality(docs).collect()}
    good = [kept[d] for d, r in known.items() if r["quality"] == 1]
    bad = [kept[d] for d, r in known.items() if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.15 * len(bad)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in result.description)
    at = [[d[0] for d in result.description].index(c) for c in columns]
    found = QUERIES[name](spark, FOLDER)
    assert sorted(found.columns) == columns
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got = sorted(tuple(show(r[c]) for c in columns) for r in found.collect())
    assert got == sorted(tuple(show(r[i]) for i in at) for r in result.fetchall())
