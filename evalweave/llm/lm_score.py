"""Language-model scoring by deleted interpolation.

P(w | v) mixes the maximum-likelihood estimates c(v, w) / c(v), c(w) / N and the uniform
1 / (V + 1). The mixture weights depend on the bucket of the context's frequency (powers of two)
and are learned by expectation-maximisation: the estimates come from nine tenths of the
learning documents, the counts to explain from the held-out tenth. The final estimates use all
learning documents. The order of the model is two.

Every text is its words and one end; the context of the first word is a start sign, which is
no token.

Counting never brings words to one place by key rows. Documents are packed into blocks of
about ``block_bytes`` as streams of local word numbers. A block asks for the counts of its
distinct words and word pairs, sorted 64-bit hashes parted into ``buckets`` ranges. The owner of a
range adds up the blocks' own counts, and answers each block in the order of its question.
A frequent word or pair is one key per block, so no key is hot.

The expectation step sees each held-out token as a cell (bucket, two ratios of estimates, to
an eighth of a power of two), so what comes to the driver is bounded by the number of cells.

Defined results: null text counts as empty: one token, the end; a null id counts as empty
text for the folds; repeated rows count as often as they occur; without learning documents
N and V are 0, the base is log10(0.5 / 0.5) = 0 per token, and the model is uniform over one
word, 0; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import fold_of, raw_text
from evalweave.session import materialise

# No word holds a blank.
_START, _END = b" start", b" end"
_CELLS = 8
_MOST_CELL = 400
_BUCKETS = 24


def packed(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes; small ones cost little."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(blob: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, np.uint64), dtype=np.uint64)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * np.uint64(0x9E3779B97F4A7C15) ^ (second + np.uint64(0x632BE59BD9B4E019))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def pack_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """One row per block: ids, roles (0 learn, 1 tune, 2 held out), lengths, words, stream.

    Tuning documents have blocks of their own. ``docs`` has id (string), raw, role.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        waiting = {False: ([], 0), True: ([], 0)}
        for pdf in batches:
            for row in zip(pdf["id"], pdf["raw"], pdf["role"], strict=True):
                tune = row[2] == 1
                held, size = waiting[tune]
                held.append(row)
                size += len(row[1])
                if size >= block_bytes:
                    yield _block(number, tune, held)
                    number += 1
                    held, size = [], 0
                waiting[tune] = (held, size)
        for tune, (held, _) in waiting.items():
            if held:
                yield _block(number, tune, held)
                number += 1

    return docs.mapInPandas(
        pack,
        "block long, tune boolean, ids array<string>, roles binary, lengths binary, "
        "words binary, stream binary, tokens long",
    )


def _block(number: int, tune: bool, rows: list[tuple]) -> pd.DataFrame:
    local: dict[bytes, int] = {_START: 0, _END: 1}
    stream: list[int] = []
    lengths = []
    for _, raw, _ in rows:
        words = raw.lower().split()
        stream += [local.setdefault(w, len(local)) for w in words]
        stream.append(1)
        lengths.append(len(words) + 1)
    keys = np.array([xxhash.xxh64_intdigest(w) for w in local], np.uint64)
    order = np.argsort(keys, kind="stable")
    rank = np.empty(len(keys), np.uint32)
    rank[order] = np.arange(len(keys), dtype=np.uint32)
    return pd.DataFrame(
        {
            "block": [number],
            "tune": [tune],
            "ids": [[r[0] for r in rows]],
            "roles": [np.array([r[2] for r in rows], np.uint8).tobytes()],
            "lengths": [np.array(lengths, np.int32).tobytes()],
            "words": [packed_keys(keys[order])],
            "stream": [packed(rank[np.array(stream, np.int64)])],
            "tokens": [len(stream)],
        }
    )


class Block:
    """An unpacked block: per token its word, its context and its pair as local numbers."""

    def __init__(self, row):
        self.ids = list(row["ids"])
        self.roles = np.frombuffer(row["roles"], np.uint8)
        self.lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        self.words = unpacked_keys(row["words"])
        self.word = unpacked(row["stream"], np.uint32).astype(np.int64)
        self.firsts = np.cumsum(self.lengths) - self.lengths
        start = int(np.searchsorted(self.words, np.uint64(xxhash.xxh64_intdigest(_START))))
        self.context = np.concatenate([[start], self.word[:-1]])
        self.context[self.firsts] = start
        self.role = np.repeat(self.roles, self.lengths)
        self.pairs, self.pair = np.unique(
            pair_keys(self.words[self.context], self.words[self.word]), return_inverse=True
        )
        self.start = start

    def own_counts(self, role: int) -> tuple[np.ndarray, np.ndarray]:
        """Words (start signs as often as documents) and pairs in texts of a role."""
        own = self.role == role
        words = np.bincount(self.word[own], minlength=len(self.words))
        words[self.start] = int((self.roles == role).sum())
        return words, np.bincount(self.pair[own], minlength=len(self.pairs))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash, in order."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def count_questions(blocks: DataFrame, buckets: int) -> DataFrame:
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                block = Block(row)
                learn, tune = block.own_counts(0), block.own_counts(1)
                for kind, keys in enumerate((block.words, block.pairs)):
                    edges = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
                    out = []
                    for b in np.flatnonzero(np.diff(edges)):
                        own = slice(edges[b], edges[b + 1])
                        out.append(
                            (
                                row["block"],
                                kind,
                                int(b),
                                packed_keys(keys[own]),
                                packed(learn[kind][own].astype(np.uint32)),
                                packed(tune[kind][own].astype(np.uint32)),
                            )
                        )
                    yield pd.DataFrame(out, columns=["block", "kind", "bucket", "keys", "learn", "tune"])

    return blocks.mapInPandas(
        ask, "block long, kind int, bucket int, keys binary, learn binary, tune binary"
    )


def count_answers(questions: DataFrame) -> DataFrame:
    """(block, kind, bucket, learn, total): corpus counts in the order of the question.

    Rows of block -1 carry, per bucket of words: tokens and distinct words, of the
    learning part and in total.
    """
    start = np.uint64(xxhash.xxh64_intdigest(_START))

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        parts = [unpacked_keys(k) for k in pdf["keys"]]
        keys, place = np.unique(np.concatenate(parts), return_inverse=True)
        learn, total = (np.zeros(len(keys), np.int64) for _ in range(2))
        at = 0
        for part, a, b in zip(parts, pdf["learn"], pdf["tune"], strict=True):
            own = place[at : at + len(part)]
            a, b = unpacked(a, np.uint32), unpacked(b, np.uint32)
            learn[own] += a
            total[own] += a.astype(np.int64) + b
            at += len(part)
        out, at = [], 0
        kind, bucket = int(pdf["kind"].iloc[0]), int(pdf["bucket"].iloc[0])
        for block, part in zip(pdf["block"], parts, strict=True):
            own = place[at : at + len(part)]
            out.append((block, kind, bucket, packed(learn[own]), packed(total[own]), 0, 0, 0, 0))
            at += len(part)
        if kind == 0:
            real = keys != start
            x, y = learn[real], total[real]
            facts = (int(x.sum()), int((x > 0).sum()), int(y.sum()), int((y > 0).sum()))
            out.append((-1, kind, bucket, b"", b"", *facts))
        return pd.DataFrame(
            out, columns=["block", "kind", "bucket", "learn", "total", "n1", "v1", "n2", "v2"]
        )

    return questions.groupBy("kind", "bucket").applyInPandas(
        own,
        "block long, kind int, bucket int, learn binary, total binary, "
        "n1 long, v1 long, n2 long, v2 long",
    )


def _counts(answers: pd.DataFrame, column: str) -> list[np.ndarray]:
    """Counts of the block's words and of its pairs, in their order."""
    rows = answers.sort_values(["kind", "bucket"])
    out = []
    for kind in (0, 1):
        parts = [unpacked(x, np.int64) for x in rows.loc[rows["kind"] == kind, column]]
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    return out


def _estimates(block: Block, words: np.ndarray, pairs: np.ndarray, n: int, v: int):
    """Per token: bucket of the context and the three estimates."""
    context = words[block.context]
    bucket = np.minimum(np.log2(context + 1.0).astype(np.int64), _BUCKETS - 1)
    two = pairs[block.pair] / np.maximum(context, 1)
    return bucket, two, words[block.word] / max(1, n), 1.0 / (v + 1)


def _cell(above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The ratio to an eighth of a power of two, or the largest number for none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        step = np.rint(np.log2(above / below) * _CELLS)
    return np.where((above > 0) & (below > 0), np.clip(step, -_MOST_CELL, _MOST_CELL), 1 << 20).astype(np.int64)


def held_out_cells(blocks: DataFrame, answers: DataFrame, n: int, v: int) -> dict[tuple, int]:
    """(bucket, pair cell, word cell) -> held-out tokens, both ratios to the uniform estimate."""

    def cells(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        block = Block(left.iloc[0])
        bucket, two, one, flat = _estimates(block, *_counts(right, "learn"), n, v)
        flat = np.full(len(one), flat)
        key = np.stack([bucket, _cell(two, flat), _cell(one, flat)], 1)
        found, count = np.unique(key, axis=0, return_counts=True)
        return pd.DataFrame(found, columns=["b", "i", "j"]).assign(n=count)

    tuning = blocks.where("tune")
    asked = answers.join(tuning.select("block"), "block", "left_semi")
    rows = (
        tuning.groupBy("block")
        .cogroup(asked.groupBy("block"))
        .applyInPandas(cells, "b long, i long, j long, n long")
        .groupBy("b", "i", "j")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    return {(r["b"], r["i"], r["j"]): r["n"] for r in rows}


def mixture_weights(cells: dict[tuple, int], rounds: int = 50) -> np.ndarray:
    """Expectation-maximisation per bucket; weights of (pair, word, uniform).

    A bucket without held-out tokens takes the weights of the next lower one; the rarest
    contexts start from a prior of one token per estimate.
    """
    out = np.tile([0.0, 0.9, 0.1], (_BUCKETS, 1))
    for b in range(_BUCKETS):
        own = sorted((k, n) for k, n in cells.items() if k[0] == b)
        if not own:
            out[b] = out[b - 1] if b else out[b]
            continue
        steps = np.array([k[1:] for k, _ in own], float)
        ratio = np.where(steps < (1 << 20), np.exp2(np.clip(steps, -2000, 2000) / _CELLS), 0.0)
        ratio = np.column_stack([ratio, np.ones(len(own))])
        n = np.array([c for _, c in own], float)
        weight = np.full(3, 1 / 3)
        for _ in range(rounds):
            part = ratio * weight
            part /= part.sum(axis=1, keepdims=True)
            weight = n @ part + [0.0, 0.5, 0.5]
            weight /= weight.sum()
        out[b] = weight
    return out


def score_blocks(
    blocks: DataFrame, answers: DataFrame, weights: np.ndarray, n: int, v: int
) -> DataFrame:
    def score(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        block = Block(left.iloc[0])
        words, pairs = _counts(right, "total")
        bucket, two, one, flat = _estimates(block, words, pairs, n, v)
        share = weights[bucket]
        chance = share[:, 0] * two + share[:, 1] * one + share[:, 2] * flat
        count = words[block.word]
        base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        if n == 0:
            chance = np.ones(len(count))
        adds = lambda x: np.add.reduceat(x, block.firsts)
        return pd.DataFrame(
            {
                "id": block.ids,
                "held_out": block.roles == 2,
                "n_tokens": block.lengths,
                "n_known": adds((count > 0).astype(np.int64)),
                "base_score": adds(base),
                "score": adds(np.log10(chance)),
            }
        )

    return (
        blocks.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInPandas(
            score,
            "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double",
        )
    )


def score_documents(
    docs: DataFrame,
    parts: int = 5,
    held: int = 1,
    tune_parts: int = 10,
    block_bytes: int = 6 << 20,
    bucket_tokens: int = 2_000_000,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per document."""
    tune = F.pmod(F.xxhash64(F.lit("tune"), "doc_id", "text"), F.lit(tune_parts)) == 0
    role = F.when(fold_of("doc_id", parts) == held, 2).when(tune, 1).otherwise(0)
    blocks = materialise(
        pack_blocks(
            docs.select(F.col("doc_id").cast("string").alias("id"), raw_text().alias("raw"), role.alias("role")),
            block_bytes,
        ),
        "blocks",
    )
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(1, math.ceil(tokens / bucket_tokens))
    answers = materialise(count_answers(count_questions(blocks, buckets)), "answers")
    facts = answers.where("block = -1").agg(*[F.sum(c) for c in ("n1", "v1", "n2", "v2")]).first()
    n1, v1, n2, v2 = (x or 0 for x in facts)
    replies = answers.where("block >= 0").select("block", "kind", "bucket", "learn", "total")
    weights = mixture_weights(held_out_cells(blocks, replies.drop("total"), n1, v1))
    scored = score_blocks(blocks, replies.drop("learn"), weights, n2, v2)
    kind = dict(docs.dtypes)["doc_id"]
    return scored.select(
        F.col("id").cast(kind).alias("doc_id"),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n2).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
