"""Links between texts whose sets of five-word shingles have a Jaccard similarity of ``least``.

Candidates: a text has ``_BANDS`` band keys, each made of ``_ROWS`` minima of its hashed shingles
(MinHash). Two texts with similarity s share a given key with probability s ** 5, so a pair at
0.8 is missed by all 40 keys once in eight million, more similar ones less often. Every
candidate is then compared by its whole sets of shingles, so no link is a guess.

Rounds, each over the texts whose key still holds several components:
1. Texts with a common key are compared with one leader of the key, the first in one order of
   all texts, so that a group of near copies has few leaders.
2. They are compared with the most central text of the key: the one whose shingles most other open texts
   share. In a group of copies edited in different places that is the least edited one, and two
   copies cannot be near each other without being near it.
3. The rest is an exact set-similarity join, shingles rarest first. A pair that is near shares a
   shingle among the first n - ceil(least / (1 + least) * (n + m)) + 1 of each, n and m being the sizes;
   a shingle that no other open text holds meets nothing, so a text with many of its own falls out without any
   comparison. Sizes come in classes of 3 %, so that equal sizes get the short prefix that they
   need. Texts of one component are not paired: of a prefix shingle's commonest component and itself no join is made.
   Length and positional filters hold before the sets are compared.
What is left is the product of a shingle's commonest component with the texts of other components that share
it in their short prefixes.

Defined results: words are parted by white space, A-Z count as a-z; fewer words than a shingle:
the whole sequence is one; repeated shingles count once; texts without words link to nothing
here (``one_per_group`` joins equal sequences of words before).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalweave.llm.common import raw_text
from evalweave.operators.components import connected_components
from evalweave.session import materialise

SHINGLE = 5
_BANDS, _ROWS, _CHUNK = 40, 5, 512
_CLASS = 1.03
_RANDOM = np.random.default_rng(20240607)
_PLACES = _RANDOM.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_TURNS = _RANDOM.integers(0, 1 << 63, _BANDS * _ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _RANDOM.integers(0, 1 << 63, _BANDS, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the runs of ``size`` words."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(w, 42) for w in words], np.uint64)
    size = min(size, len(words))
    n = len(words) - size + 1
    held = np.full(n, size, np.uint64)
    for j in range(size):
        held = _mixed(held + hashes[j : j + n] * _PLACES[j])
    return np.unique(held)


def band_keys(held: np.ndarray) -> np.ndarray:
    """The keys under which a set of shingles meets similar ones."""
    if not len(held):
        return np.empty(0, np.int64)
    least = np.full(len(_TURNS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(held), _CHUNK):
        np.minimum(least, (held[i : i + _CHUNK, None] * _TURNS).min(axis=0), out=least)
    least = least.reshape(_BANDS, _ROWS)
    key = _SALT.copy()
    for j in range(_ROWS):
        key = _mixed(key + least[:, j])
    return key.view(np.int64)


def sketch(text: str | Column) -> Column:
    """A struct of ``digest`` (of the sequence of words), ``size`` and ``keys`` of a text."""

    @F.pandas_udf("digest binary, size long, keys array<long>")
    def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for raw in batches:
            rows = []
            for x in raw:
                words = x.lower().split()
                held = shingles(words)
                rows.append((xxhash.xxh3_128_digest(b" ".join(words)), len(held), band_keys(held)))
            yield pd.DataFrame(rows, columns=["digest", "size", "keys"])

    return sketches(raw_text(text))


def _sets(text: str | Column) -> Column:
    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for raw in batches:
            yield pd.Series([shingles(x.lower().split()).view(np.int64) for x in raw], dtype=object)

    return sets(raw_text(text))


def _may(a: str, b: str, least: float) -> Column:
    """A smaller set can hold no more than all of its shingles."""
    return F.least(a, b) >= F.lit(least) * F.greatest(a, b) - F.lit(1e-9)


def _overlap(a: Column, b: Column, least: float) -> Column:
    """How many shingles sets of these sizes share at least, if they are near."""
    return F.ceil(F.lit(least / (1 + least)) * (a + b) - F.lit(1e-9))


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) that are near; ``sets`` has ``id`` and ``s``, the distinct shingles."""
    first = sets.select(F.col("id").alias("u"), F.col("s").alias("a"))
    second = sets.select(F.col("id").alias("v"), F.col("s").alias("b"))
    both = pairs.join(first, "u").join(second, "v")
    common = F.size(F.array_intersect("a", "b"))
    near = common >= F.lit(least) * (F.size("a") + F.size("b") - common) - F.lit(1e-9)
    return materialise(both.where(near).select("u", "v"), "links")


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    pairs = rows.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    return materialise(pairs, "candidates")


def _still_open(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, id, size, c): the members of keys with texts of several components."""
    part = connected_components(links)
    named = members.select("key", "id", "size").join(part, F.col("id") == F.col("node"), "left")
    named = materialise(named.select("key", "id", "size", F.coalesce("component", "id").alias("c")), "named")
    keys = named.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b")
    return materialise(named.join(keys.select("key"), "key", "left_semi"), "open")


def _central_pairs(left: DataFrame, common: DataFrame, least: float) -> DataFrame:
    """Every open text with the most central text of its key, if of another component."""
    central = common.groupBy("id").agg(F.sum(F.log("n")).alias("weight"))
    weighed = left.join(materialise(central, "central"), "id", "left")
    mean = F.coalesce("weight", F.lit(0.0)) / F.col("size")
    best = weighed.groupBy("key").agg(
        F.max(F.struct(mean.alias("m"), F.col("id").alias("leader"), F.col("size").alias("leader_size"), F.col("c").alias("lc"))).alias("x")
    )
    met = left.join(best.select("key", "x.*"), "key").where("c <> lc").where(_may("size", "leader_size", least))
    return _pairs(met, "id", "leader")


def _class(size: Column) -> Column:
    return F.floor(F.log(size) / F.lit(math.log(_CLASS)) + F.lit(1e-9)).cast("int")


def _prefix_pairs(left: DataFrame, common: DataFrame, least: float) -> DataFrame:
    """Candidates of the exact join: pairs of different components that share a prefix shingle."""
    texts = left.select("id", "size", "c").distinct()
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "v"))
    n = F.col("size")
    # Places from the common end: shingles of this text alone come first of all and meet nothing.
    ordered = (
        common.join(texts, "id")
        .withColumn("p", n - place)
        .where(F.col("p") <= n - F.ceil(F.lit(least) * n - F.lit(1e-9)))
    )
    rows = materialise(ordered.select("v", "id", "size", "c", "p"), "prefixes")
    same = F.ceil(F.lit(2 * least / (1 + least)) * n - F.lit(1e-9))
    index = rows.where(F.col("p") <= n - same).withColumn("k", _class(n)).withColumn("side", F.lit(0))
    lowest = F.greatest(F.lit(1), F.ceil(F.lit(least) * n - F.lit(1e-9)))
    smallest = F.greatest(lowest, F.floor(F.pow(F.lit(_CLASS), F.col("k")) * F.lit(1 - 1e-6)))
    probe = (
        rows.withColumn("k", F.explode(F.sequence(_class(lowest), _class(n))))
        .where(F.col("p") <= n - _overlap(n, smallest, least))
        .withColumn("side", F.lit(1))
    )
    entries = materialise(index.unionByName(probe), "entries")
    shares = entries.groupBy("v", "k", "c").agg(
        F.count(F.lit(1)).alias("m"), F.min("side").alias("low"), F.max("side").alias("high")
    )
    keys = (
        shares.groupBy("v", "k")
        .agg(
            F.max(F.struct("m", "c")).alias("x"), F.count(F.lit(1)).alias("parts"),
            F.min("low").alias("low"), F.max("high").alias("high"),
        )
        .where("parts > 1 and low < high")
        .select("v", "k", F.col("x.c").alias("most"))
    )
    entries = materialise(entries.join(keys, ["v", "k"]).withColumn("main", F.col("c") == F.col("most")).drop("most"), "entries")
    a = entries.where("side = 0").select("v", "k", *[F.col(x).alias(f"{x}1") for x in ("id", "size", "c", "p", "main")])
    b = entries.where("side = 1").select("v", "k", *[F.col(x).alias(f"{x}2") for x in ("id", "size", "c", "p", "main")])
    met = (
        (F.col("c1") != F.col("c2"))
        & (F.col("size1") <= F.col("size2"))
        & _may("size1", "size2", least)
        & (F.least(F.col("size1") - F.col("p1"), F.col("size2") - F.col("p2")) >= _overlap(F.col("size1"), F.col("size2"), least))
    )

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        same_key = (F.col("l.v") == F.col("r.v")) & (F.col("l.k") == F.col("r.k"))
        return left.alias("l").join(right.alias("r"), same_key & met).select("id1", "id2")

    return _pairs(joined(a, b.where("not main2")).union(joined(a.where("not main1"), b.where("main2"))), "id1", "id2")


def similar_links(
    sketches: DataFrame, texts: DataFrame, least: float = 0.8, given: DataFrame | None = None
) -> DataFrame:
    """(u, v): links that connect all texts of ``sketches`` (id, size, keys) with a similarity
    of ``least`` or more; ``texts`` has ``id`` and ``text``. ``given`` holds candidates (u, v) found
    by other means; they are compared in the first round.
    """
    spread = sketches.select("id", "size", F.explode("keys").alias("key"))
    order = F.struct(F.xxhash64("id").alias("h"), "id", "size")
    leaders = (
        spread.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("f"))
        .where("n > 1")
        .select("key", F.col("f.id").alias("leader"), F.col("f.size").alias("leader_size"))
    )
    members = materialise(spread.join(leaders, "key"), "keys")
    needed = members.select("id")
    if given is not None:
        needed = needed.union(given.select(F.explode(F.array("u", "v"))))
    needed = needed.distinct()
    sets = materialise(texts.join(needed, "id", "left_semi").select("id", _sets("text").alias("s")), "shingles")
    star = members.where("id <> leader").where(_may("size", "leader_size", least))
    near = _pairs(star, "id", "leader")
    if given is not None:
        near = near.union(given.select("u", "v")).distinct()
    links = verified(near, sets, least)

    left = _still_open(members, links)
    held = sets.join(left.select("id").distinct(), "id", "left_semi").select("id", F.explode("s").alias("v"))
    counts = held.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    common = materialise(held.join(counts, "v"), "common")
    links = links.union(verified(_central_pairs(left, common, least), sets, least))

    left = _still_open(left, links)
    return links.union(verified(_prefix_pairs(left, common, least), sets, least))
