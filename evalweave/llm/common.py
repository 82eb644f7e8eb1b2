"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.session import materialise, scratch_path

#: ASCII white space, which parts words in every contract; ``bytes.split()`` parts there too.
WORD = r"[^\x20\x09-\x0D]+"

#: A-Z to a-z; ASCII other than letters and digits to blanks.
LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def fold_of(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def raw_text(text: str | Column = "text") -> Column:
    """The text as UTF-8 bytes, which Python workers take without decoding; null is empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def numbered_rows(docs: DataFrame, name: str, label: str) -> DataFrame:
    """A stored copy of ``docs`` with a number per row.

    The copy is written first, so the numbers stay the same whatever is computed again
    later; repeated rows get different numbers.
    """
    path = scratch_path(docs.sparkSession, label)
    numbered = docs.withColumn(name, F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(numbered.schema).parquet(path)


def hashed_share(key: Column, share: Column) -> Column:
    """True for about ``share`` of the keys; the choice depends on the key alone."""
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) < share * F.lit(1 << 30)


def ngram_keys(buf: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of ``buf`` that have no blank inside, and where they start."""
    size = len(buf) - n + 1
    if size <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    blank = buf == 32
    key = np.zeros(size, np.uint64)
    inside = np.zeros(size, bool)
    for i in range(n):
        key = (key << np.uint64(8)) | buf[i : i + size].astype(np.uint64)
        if 0 < i < n - 1:
            inside |= blank[i : i + size]
    if n == 2:  # a lone pair of blanks tells nothing
        inside = blank[:size] & blank[1 : size + 1]
    at = np.flatnonzero(~inside)
    mixed = (key[at] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64), at


def spans_of(texts: list[bytes], most: int = 1 << 20, overlap: int = 8) -> Iterator[tuple]:
    """(bytes, starts, owners): runs of texts joined to buffers of about ``most`` bytes.

    ``owners[i]`` is the index of the text whose bytes begin at ``starts[i]``. A longer text
    comes in pieces that repeat ``overlap`` bytes, so memory does not grow with one text.
    The caller skips n-grams that begin in the repeated bytes (see ``cut``).
    """
    parts: list[bytes] = []
    starts: list[int] = []
    owners: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        if len(text) > most:
            for at in range(0, len(text), most):
                piece = text[at : at + most + overlap]
                yield piece, np.array([0]), np.array([i]), min(most, len(text) - at)
            continue
        parts.append(text)
        starts.append(held)
        owners.append(i)
        held += len(text)
        if held >= most:
            yield b"".join(parts), np.array(starts), np.array(owners), held
            parts, starts, owners, held = [], [], [], 0
    if parts:
        yield b"".join(parts), np.array(starts), np.array(owners), held


def padded(raw: bytes) -> bytes:
    """Lower-case letters and digits, one blank between words and at both ends."""
    return b" " + b" ".join(raw.translate(LETTERS).split()) + b" "


def bag_sums(
    texts: list[bytes], orders: tuple[int, ...], bits: int, table: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the sum of ``table`` rows of its hashed n-grams, and their number."""
    sums = np.zeros((len(texts), table.shape[1]))
    counts = np.zeros(len(texts))
    for buf, starts, owners, cut in spans_of(texts):
        data = np.frombuffer(buf, np.uint8)
        for order in orders:
            key, at = ngram_keys(data, order, bits)
            size = np.searchsorted(at, cut)
            key, at = key[:size], at[:size]
            first = np.searchsorted(at, starts)
            held = np.diff(np.append(first, size))
            some = held > 0
            if some.any():
                sums[owners[some]] += np.add.reduceat(table[key], first[some], axis=0)
                counts[owners] += held
    return sums, counts


def bag_of(text: bytes, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed n-grams of one text and the share of each."""
    counts = np.zeros(1 << bits, np.int64)
    for buf, _, _, cut in spans_of([text]):
        data = np.frombuffer(buf, np.uint8)
        for order in orders:
            key, at = ngram_keys(data, order, bits)
            counts += np.bincount(key[at < cut], minlength=1 << bits)
    found = np.flatnonzero(counts)
    return found.astype(np.int32), (counts[found] / max(1, counts.sum())).astype(np.float32)


def class_shares(
    rows: DataFrame, label: str, per_label: int, most_bytes: int, text: str = "text"
) -> dict:
    """label -> the share of its rows that keeps a sample within both bounds.

    One row per class comes to the driver.
    """
    sizes = (
        rows.groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(raw_text(text))).alias("b"))
        .collect()
    )
    return {
        r[label]: min(1.0, per_label / r["n"], most_bytes / max(1, r["b"]))
        for r in sorted(sizes, key=lambda r: str(r[label]))
    }


def class_sample(rows: DataFrame, label: str, shares: dict, key: str = "doc_id") -> DataFrame:
    """About the given share of each class, chosen by a hash of key and text."""
    if not shares:
        return rows.where(F.lit(False))
    pairs = [F.lit(x) for pair in shares.items() for x in pair]
    share = F.element_at(F.create_map(*pairs), F.col(label))
    return rows.where(hashed_share(F.struct(F.col(key), F.col("text")), share))


def light_rows(docs: DataFrame, *extra: Column) -> DataFrame:
    """(doc_id, h, bytes, ...): a row per document without its text; h tells texts apart."""
    return docs.select("doc_id", _row_hash().alias("h"), F.octet_length(raw_text()).alias("bytes"), *extra)


def _row_hash() -> Column:
    return F.xxhash64(F.lit("row"), "doc_id", "text")


def sampled_texts(
    docs: DataFrame, light: DataFrame, label: str, per_label: int, most_bytes: int
) -> tuple[pd.DataFrame, dict]:
    """(h, raw, label, ...) of about ``per_label`` documents per class, and the shares taken.

    The sample is chosen among the light rows, so no text is shuffled; the chosen
    hashes, at most a few thousand, are broadcast to one scan. Equal rows count once.
    """
    sizes = light.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")).collect()
    shares = {
        r[label]: min(1.0, per_label / r["n"], most_bytes / max(1, r["b"]))
        for r in sorted(sizes, key=lambda r: str(r[label]))
    }
    if not shares:
        names = [c for c in light.columns if c not in ("doc_id", "bytes")]
        return pd.DataFrame(columns=["raw", *names]), shares
    pairs = [F.lit(x) for pair in shares.items() for x in pair]
    share = F.element_at(F.create_map(*pairs), F.col(label))
    chosen = light.where(hashed_share(F.col("h"), share)).drop("doc_id", "bytes").dropDuplicates(["h"])
    chosen = materialise(chosen, "sample")
    texts = docs.select(_row_hash().alias("h"), raw_text().alias("raw"))
    # However many rows are equal, one of each comes to the driver.
    others = [c for c in chosen.columns if c != "h"]
    held = texts.join(F.broadcast(chosen), "h").groupBy("h", *others).agg(F.any_value("raw").alias("raw")).toPandas()
    return held.sort_values("h", kind="stable").reset_index(drop=True), shares
