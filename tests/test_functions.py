"""Edge rows of the scalar functions."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from evalweave.functions import answers, grams, parsing, prompts, similarity, text


def values(spark, rows, schema, column):
    """The column for every row, in order."""
    indexed = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(indexed, f"i INT, {schema}")
    return [r[0] for r in df.orderBy("i").select(column.alias("v")).collect()]


def one(spark, value, fn, kind="STRING"):
    return values(spark, [(value,)], f"c {kind}", fn("c"))[0]


@pytest.mark.parametrize(
    "reply, answer",
    [
        ('```json\n{"answer":" A "}\n```', "A"),
        ('```\n{"answer": true}\n```', "True"),
        ('{"answer": null}', "None"),
        ('{"other": 1}', ""),
        ("x" * 600, "x" * 500),
        ("[1]", "[1]"),
        ("5", "5"),
        ('{"answer": "a"} and more', '{"answer": "a"} and more'),
        ('{"answer": "a"}, {"b": 1}', '{"answer": "a"}, {"b": 1}'),
        ('{"answer": ', '{"answer":'),
        ("", ""),
    ],
)
def test_parsed_answer(spark, reply, answer):
    assert one(spark, reply, lambda c: parsing.parsed_answer(c)["answer"]) == answer


@pytest.mark.parametrize(
    "reply, expected",
    [
        ('{"correct":"false"}', True),
        ('{"correct":0}', False),
        ('{"correct":0.0}', False),
        ('{"correct":"0"}', True),
        ('{"correct":[]}', False),
        ('{"correct":[0]}', True),
        ('{"correct":{}}', False),
        ('{"correct":null}', False),
        ("{}", False),
        ("x", False),
    ],
)
def test_truthiness(spark, reply, expected):
    assert one(spark, reply, lambda c: parsing.parsed_judgment(c)["correct"]) is expected


def test_first_list_member_follows_the_text(spark):
    reply = '{"n": 1, "z": [1, 2], "a": [3]}'
    got = one(spark, reply, lambda c: F.transform(parsing.json_array(c), lambda v: F.to_json(v)))
    assert got == ["1", "2"]
    assert one(spark, '{"n": 1}', parsing.json_array) is None


def test_accepted_answers(spark):
    got = values(
        spark,
        [("A", ["a ", "b", "", "B"]), ("A", []), ("A", None), ("", None)],
        "a STRING, p ARRAY<STRING>",
        answers.accepted_answers("a", "p"),
    )
    assert got == [["A", "b"], ["A"], ["A"], []]


def test_competing_answers(spark):
    got = values(
        spark, [("Coin.", ["coin. ", "tadpole"])], "o STRING, p ARRAY<STRING>",
        answers.competing_answers("p", "o"),
    )
    assert got == [["tadpole"]]


@pytest.mark.parametrize(
    "model, family",
    [("openai/gpt-x", "gpt"), ("Gemini-2", "gemini"), ("", "__unknown__"), ("acme/zzz", "zzz"),
     ("a/b/command-r", "b/command-r"), ("COMMAND-r", "cohere"), (None, "__unknown__")],
)
def test_model_family(spark, model, family):
    assert one(spark, model, text.model_family) == family


def test_pair_key_needs_both_sides(spark):
    got = values(
        spark, [(" A", "B\n"), ("", "b"), ("a", None)], "x STRING, y STRING", text.pair_key("x", "y")
    )
    assert got == [Row(a="a", b="b"), None, None]


def test_id_number(spark):
    got = values(
        spark, [("alt_0012x",), ("xalt_3",), ("alt_",), (None,)], "c STRING", text.id_number("c")
    )
    assert got == [12, None, None, None]


def test_solver_parts(spark):
    got = values(spark, [("p: m:x",), ("p",), ("p: ",)], "c STRING", text.solver_parts("c"))
    assert got == [Row("p", "m:x"), Row("p", None), Row("p", None)]


def test_round4_equals_correct_rounding(spark):
    rng = random.Random(3)
    numbers = [0.00005, 0.03125, 0.12345, 0.28125, 0.5, 1.0, 0.0, 2.34565, 0.99995]
    for _ in range(4000):
        n = rng.randint(1, 40000)
        numbers.append(rng.randint(0, n) / n)
    numbers += [k / 20000 for k in range(1, 20000, 7)] + [k / 100000 for k in range(5, 100000, 50)]
    got = values(spark, [(x,) for x in numbers], "c DOUBLE", text.round4("c"))
    wrong = [(x, g) for x, g in zip(numbers, got) if x < 1 and g != round(x, 4)]
    assert wrong == []


def test_run_name(spark):
    got = values(
        spark,
        [("Org/M:1", 0.7, True, "low"), ("m", 0.0, False, "x"), ("m", 0.0, True, None)],
        "m STRING, t DOUBLE, e BOOLEAN, f STRING",
        text.run_name("m", "t", "e", "f"),
    )
    assert got == ["org_m_1_temp0.7_reasoning-low", "m", "m_reasoning-high"]


def test_render_fails_on_unknown_slot(spark):
    with pytest.raises(KeyError):
        prompts.render("{riddle} {oops}", riddle="c")


def test_required_fields(spark):
    full = {f: "x" for f in parsing.REQUIRED_ITEM_FIELDS}
    import json

    rows = [(json.dumps(full),), (json.dumps({**full, "altered_answer": ""}),), ('"text"',)]
    got = values(
        spark, rows, "c STRING", parsing.has_required_fields(F.try_parse_json("c"))
    )
    assert got == [True, False, False]


def test_display_rounding_follows_the_exact_value(spark):
    values = [n / 10000 * 100 for n in range(1, 10000)] + [0.05, 0.25, 1.005, 2.5, 1e6 + 0.25, 123456.75, 8.35, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2):
        shown = rows.select("v", F.format_string(f"%.{digits}f", text.fixed_digits(F.col("v"), digits)).alias("s"))
        assert [r for r in shown.collect() if r["s"] != f"{r['v']:.{digits}f}"] == []


def test_early_ratio_equals_the_standard_library():
    from difflib import SequenceMatcher

    rng = random.Random(7)
    for _ in range(600):
        letters = "abcdefghijklmnopqrstuvwxyz"[: rng.choice([2, 3, 8, 26])]
        a = "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 30, 150, 199, 200, 201, 400])))
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // 15))):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 3)] = rng.choice(["", "x", "ab", "q"])
        b = "".join(b)
        ratio = SequenceMatcher(None, a, b).ratio()
        for threshold in (ratio, ratio + 1e-9, ratio - 1e-9, 0.97, 0.8, 0.0):
            assert similarity.matching_reaches(a, b, threshold) == (ratio >= threshold)


def test_histograms_keep_every_similar_pair():
    """Pairs at the threshold are within the bounds for every gram size, also where counts share cells."""
    import numpy as np

    rng = random.Random(8)
    for threshold in (0.97, 0.8):
        for _ in range(200):
            a = "".join(rng.choices("abcde ", k=rng.randint(20, 900)))
            b = list(a)
            for _ in range(rng.randint(1, max(1, int(len(a) * (1 - threshold))))):
                at = rng.randrange(len(b))
                b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
            b = "".join(b)
            if not similarity.matching_reaches(a, b, threshold):
                continue
            x, y = grams.code_points(a), grams.code_points(b)
            counts = [(1, np.frombuffer(grams.character_counts(p), "<i4")) for p in (x, y)]
            for shape in ((3, 64), (4, 2_048), (7, 65_536)):
                counts += [(shape[0], np.frombuffer(grams.gram_counts(p, shape), np.uint8)) for p in (x, y)]
            for (q, c), (_, d) in zip(counts[::2], counts[1::2]):
                apart = np.abs(c.astype(int) - d.astype(int)).sum()
                assert apart <= grams.most_apart(len(a) + len(b), threshold, q)


def test_gram_bits_differ_like_cut_counts():
    """Bits of similar pairs stay within the bound, and tell long texts of one vocabulary apart."""
    import numpy as np

    rng = random.Random(9)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 6))) for _ in range(60)]
    for n in (100, 400, 2_000):
        a, other = (" ".join(rng.choices(words, k=n)) for _ in range(2))
        b = a[:50] + "q" + a[60:]
        shape = grams.gram_shape(len(a))
        for x, y, similar in ((a, b, True), (a, other, False)):
            if shape is None:
                continue
            counts, bits = (
                [np.frombuffer(f(grams.code_points(t), shape), np.uint8) for t in (x, y)]
                for f in (grams.gram_counts, grams.gram_bits)
            )
            apart = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
            assert apart == np.abs(np.minimum(counts[0], 4).astype(int) - np.minimum(counts[1], 4)).sum()
            assert len(bits[0]) == 8 * grams.gram_words(shape)
            if similar:
                assert apart <= grams.most_apart(len(x) + len(y), 0.97, shape[0])


def test_parities_keep_every_similar_pair():
    """Parities of similar texts stay within the bound, those of other texts of one vocabulary beyond it."""
    import numpy as np

    rng = random.Random(12)
    words = ["".join(rng.choices("etaoinshrdlucm", k=rng.randint(3, 9))) for _ in range(900)]
    for n in (150, 300, 450, 700, 1_200):
        a, other = (" ".join(rng.choices(words, k=n)) for _ in range(2))
        shape = grams.parity_shape(len(a))
        assert grams.parity_bytes(shape) * 2 <= 8 * grams.gram_words(grams.gram_shape(len(a)))
        x = np.frombuffer(grams.parity_bits(grams.code_points(a), shape), np.uint8)
        assert len(x) == grams.parity_bytes(shape)
        for edits in (1, len(a) // 50, len(a) // 34):
            b = list(a)
            for at in rng.sample(range(len(b)), edits):
                b[at] = rng.choice(["", "z", "q" + b[at]])
            b = "".join(b)
            y = np.frombuffer(grams.parity_bits(grams.code_points(b), shape), np.uint8)
            apart = int(np.bitwise_count(x ^ y).sum())
            if similarity.matching_reaches(a, b, 0.97):
                assert apart <= grams.most_apart(len(a) + len(b), 0.97, shape[0])
        z = np.frombuffer(grams.parity_bits(grams.code_points(other), shape), np.uint8)
        assert int(np.bitwise_count(x ^ z).sum()) > grams.most_apart(len(a) + len(other), 0.97, shape[0])
    assert grams.parity_shape(700) is None and grams.parity_bits(grams.code_points("ab"), None) is None


def test_kept_runs_hold_one_first_text():
    """What is kept of the first text of a pair goes with the next one; results do not depend on the order."""
    rng = random.Random(13)
    base = "".join(rng.choices("etaoinshrdlu zqjx", k=700))
    texts = [base[:k] + "qz" * rng.randint(0, 3) + base[k + 2 :] for k in range(0, 600, 60)]
    test = similarity.RatioTest(texts, 0.97)
    pairs = [(x, y) for x in range(10) for y in range(10)]
    got = {p: test.reaches(*p) for p in pairs}
    assert test._first[0] == 9 and all(runs._text == texts[9] for runs in test._first[1].values())
    rng.shuffle(pairs)
    assert got == {p: test.reaches(*p) for p in pairs}


def test_kept_runs_give_the_ratio_of_the_standard_library():
    """Many pairs of long near copies, in both orders, tested by one holder of their runs."""
    from difflib import SequenceMatcher

    rng = random.Random(10)
    for letters in ("etaoinshrdlu  zqjx", "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0x4E00, 0x4E90)))):
        base = "".join(rng.choices(letters, weights=[len(letters) ** 2 // (k + 1) for k in range(len(letters))], k=900))
        texts = [base]
        for _ in range(9):
            b = list(rng.choice(texts))
            for _ in range(rng.randint(1, 12)):
                at = rng.randrange(len(b))
                b[at : at + rng.randint(0, 2)] = rng.choice(["", "z", "ea", "]^-"])
            texts.append("".join(b))
        for threshold in (0.97, 0.6):
            test = similarity.RatioTest(texts, threshold)
            for x in range(len(texts)):
                for y in range(len(texts)):
                    reached = SequenceMatcher(None, texts[x], texts[y]).ratio() >= threshold
                    assert test.reaches(x, y) == reached
                    assert test.within(x, y) or not reached
