"""Katz backoff language model: counts of words and word pairs, Good-Turing discounts, exact backoff weights.

Model. Tokens are lower-cased words and one end a text. P(w) discounts counts up to K by Good-Turing; the mass freed
belongs to one class of unseen words. A pair (h, w) seen MIN_PAIR times or more, once is enough, has
P(w | h) = s(h) d(c) c(h, w) / c(h); all other w have a(h) P(w), where a(h) makes the sum over all w, unseen class
included, exactly 1. s(h) is 1 unless the kept pairs of h leave less than 1 / (c(h) + 1), which is then set aside.

Tables. Texts are cut into blocks of about BLOCK_TOKENS tokens (a text stays in one piece): their distinct words, and
their tokens as numbers of these. Two tables hold the model, one row a part, its columns packed arrays: words by range
of their hash, with counts; pairs by history, with counts, a(h) and s(h). Both are written to the shared folder.

Evaluation. A block asks every part of the words for the numbers and counts of its distinct words and keeps them; then
it asks every part of the pairs for the counts of its distinct pairs and the weights of their histories, and runs the recursion
token by token on the answers: log P(w | h) of a kept pair, else log a(h) + log P(w), and log P(w) for a text's first.

Scale. Blocks aggregate before anything moves, so a frequent word or pair is one entry a block. Pairs meet by
history; a history with more than a quarter of a part's tokens is spread over all parts by its words, and its
sums are added up (there are at most four such histories a part). The number of parts follows the tokens alone:
what moves is in proportion to the blocks' distinct words and pairs, and no task holds more than a part or a block.
Nothing grows with the data on the driver but one row of sums.

Edge cases: null and blank texts are one end token; rows may repeat, each is scored; ids may be of any simple type, and
a null id hashes as empty text; with no training rows every token has probability 1 (unseen class) and base 1 / (V + 1)
with V = N = 0; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import flat
from .common import discard, held_out, short_batches, stored
from .packed import pack, rows_of, table_of, unpack

K = 5
MIN_PAIR = 1
BLOCK_TOKENS, BLOCK_ROWS = 1 << 19, 1 << 16
PART_TOKENS, LEAST_PARTS = 1 << 21, 64
HOT_SHARE = 4  # a history is hot above 1 / HOT_SHARE of a part's tokens
HELD_PARTS = 7

END = np.uint64(0x5851F42D4C957F2D)
_ID_BITS = np.uint64(40)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


# texts to blocks

BLOCK_FIELDS = "block long, n_tokens long, n_words long, sizes binary, learn binary, words binary, tokens binary"


def token_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, number of tokens of each row): the words of each row and its end token."""
    h, _, before = flat.words(data, ends)
    n = np.diff(before) + 1
    out = np.empty(int(n.sum()), np.uint64)
    last = np.zeros(len(out), bool)
    last[np.cumsum(n) - 1] = True
    out[last], out[~last] = END, h
    return out, n


def _cut(batches):
    """Blocks of rows (doc_id, learn, text)."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    made, held, size, rows = 0, [], 0, 0

    def emit():
        tokens, sizes, learn = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
        words, local, n = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # frequent words have small numbers, which compress well
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words, local = words[order], rank[local]
        ids = pa.concat_arrays([x[0] for x in held])
        number = lambda x: pa.array([x], pa.int64())
        binary = lambda x: pa.array([x], pa.binary())
        return _batch(
            block=number((part << 33) + made), n_tokens=number(len(tokens)), n_words=number(len(words)), sizes=binary(pack(sizes)), learn=binary(pack(learn)),
            words=binary(words.tobytes()), tokens=binary(pack(local)), doc_id=pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        )

    for batch in batches:
        learn = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
        for begin, end, data, ends in flat.slices(batch.column(2)):
            tokens, sizes = token_hashes(data, ends)
            held.append((batch.column(0).slice(begin, end - begin), tokens, sizes, learn[begin:end]))
            size, rows = size + len(tokens), rows + end - begin
            if size >= BLOCK_TOKENS or rows >= BLOCK_ROWS:
                yield emit()
                made, held, size, rows = made + 1, [], 0, 0
    if held:
        yield emit()
    held = []
    flat.trim()


def blocks_of(docs: DataFrame) -> DataFrame:
    """The stored blocks of documents (doc_id, learn, text)."""
    short_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", "learn", "text").mapInArrow(_cut, f"{BLOCK_FIELDS}, doc_id array<{kind}>"), "blocks", compression="zstd")


class Block:
    """The arrays of a row of blocks."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.sizes, self.learn, self.tokens = unpack(row["sizes"]).astype(np.int64), unpack(row["learn"]).astype(bool), unpack(row["tokens"]).astype(np.int64)
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)


class Numbered(Block):
    """A block that knows its words: their numbers in the table (0: unknown) and their counts."""

    def __init__(self, row: dict):
        super().__init__(row)
        self.ids, self.counts = unpack(row["ids"]), unpack(row["counts"])
        # a token follows the one before it in its text
        self.follows = np.ones(len(self.tokens), bool)
        self.follows[np.cumsum(self.sizes) - self.sizes] = False

    def pairs(self, learned: bool):
        """(history, word, number) of the distinct pairs, by places of the block's words, where a pair ends, and which one."""
        at = np.flatnonzero(self.follows & self.learn[self.row] if learned else self.follows)
        k = max(1, len(self.ids))
        key, place, n = np.unique(self.tokens[at - 1] * k + self.tokens[at], return_inverse=True, return_counts=True)
        return key // k, key % k, n, at, place


# words

ASKED_WORDS = "part int, block long, keys binary, n binary"
WORD_TABLE = "part int, keys binary, c binary, stats array<long>"
ANSWERED_WORDS = "block long, part int, ids binary, counts binary"
NUMBERED_FIELDS = "block long, n_tokens long, sizes binary, learn binary, tokens binary, ids binary, counts binary"


def _ranges(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, begin, end) of sorted hashes, for the parts that have any: equal ranges of their upper halves."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return _runs(part.astype(np.int64))


def _runs(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, begin, end) of each run of equal parts; the cost depends on what is there, not on how many parts there are."""
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    return list(zip(part[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(part)], strict=True)) if len(part) else []


def _ask_words(parts: int, learned: bool):
    """The distinct words of each block by part; `learned` leaves out those of texts not to learn from, and counts the others."""

    def run(batches):
        for batch in batches:
            for r in rows_of(batch):
                b, words = Block(r), np.frombuffer(r["words"], np.uint64)
                order = np.argsort(words)
                keys, n = words[order], np.zeros(0, np.int64)
                if learned:
                    n = np.bincount(b.tokens[b.learn[b.row]], minlength=len(words))[order]
                    keys, n = keys[n > 0], n[n > 0]
                rows = [{"part": p, "block": b.block, "keys": keys[i:j].tobytes(), "n": pack(n[i:j])} for p, i, j in _ranges(keys, parts)]
                yield from table_of(ASKED_WORDS, rows).to_batches()
        flat.trim()

    return run


def _merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def _stats(c: np.ndarray) -> list[int]:
    """Numbers of grams seen 1 to K + 1 times, of all grams, and of their tokens."""
    return [*(int(x) for x in np.bincount(np.minimum(c, K + 2).astype(np.int64), minlength=K + 3)[1 : K + 2]), len(c), int(c.sum())]


def _sum_words(asked: pa.Table) -> pa.Table:
    rows = rows_of(asked)
    keys, c = _merged(np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows]), np.concatenate([unpack(r["n"]) for r in rows]))
    return table_of(WORD_TABLE, [{"part": rows[0]["part"], "keys": keys.tobytes(), "c": pack(c), "stats": _stats(c)}])


def _answer_words(parts: int):
    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        """Numbers (0: unknown) and counts of the words that blocks ask a part for; frequent words have small numbers."""
        rows, own = rows_of(asked), rows_of(table)
        keys = np.frombuffer(own[0]["keys"], np.uint64) if own else np.zeros(1, np.uint64)
        c = unpack(own[0]["c"]) if own else np.zeros(1, np.uint64)
        number = np.empty(len(keys), np.uint64)
        number[np.lexsort((keys, np.iinfo(np.int64).max - c.astype(np.int64)))] = np.arange(len(keys), dtype=np.uint64)
        out = []
        for r in rows:
            asked_keys = np.frombuffer(r["keys"], np.uint64)
            at = np.minimum(np.searchsorted(keys, asked_keys), len(keys) - 1)
            known = (keys[at] == asked_keys) & (c[at] > 0)
            ids = np.where(known, number[at] * np.uint64(parts) + np.uint64(r["part"]) + np.uint64(1), np.uint64(0))
            out.append({"block": r["block"], "part": r["part"], "ids": pack(ids), "counts": pack(np.where(known, c[at], np.uint64(0)))})
        flat.trim()
        return table_of(ANSWERED_WORDS, out)

    return answer


def _number(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """A block with the numbers and counts of its words in place of the words."""
    own = rows_of(blocks.drop_columns(["doc_id"]))
    if not own:
        return table_of(NUMBERED_FIELDS, []).append_column("doc_id", blocks.column("doc_id"))
    r, rows = own[0], sorted(rows_of(answers), key=lambda x: x["part"])
    order = np.argsort(np.frombuffer(r["words"], np.uint64))
    for k in ("ids", "counts"):
        x = np.empty(len(order), np.uint64)
        x[order] = np.concatenate([unpack(a[k]) for a in rows])
        r[k] = pack(x)
    flat.trim()
    return table_of(NUMBERED_FIELDS, [r]).append_column("doc_id", blocks.column("doc_id"))


# pairs

ASKED_PAIRS = "part int, block long, h binary, runs binary, w binary, p binary, n binary"
PAIR_TABLE = "part int, h binary, runs binary, w binary, c binary, seen binary, rest binary, low binary, c_h binary, stats array<long>, hot_h binary"


def _pair_parts(h: np.ndarray, w: np.ndarray, c_h: np.ndarray, parts: int, hot: float) -> np.ndarray:
    """The part of each pair: by history, of hot histories by both."""
    spread = np.where(c_h > hot, flat.mix(w + np.uint64(1)), np.uint64(0))
    return (flat.mix(h * flat._PLACE[0] + spread) % np.uint64(parts)).astype(np.int64)


def _ask_pairs(parts: int, hot: float, learned: bool):
    """The distinct pairs of each block by part; `learned` takes texts to learn from, with counts, otherwise all."""
    fields = ASKED_PAIRS if learned else ASKED_PAIRS.split(", p ")[0]

    def run(batches):
        for batch in batches:
            for r in rows_of(batch):
                b, out = Numbered(r), []
                for p, h, runs, w, n in _dealt(b, parts, hot, learned)[0]:
                    row = {"part": p, "block": b.block, "h": pack(h), "runs": pack(runs), "w": pack(b.ids[w])}
                    out.append(row | ({"p": pack(b.counts[w]), "n": pack(n)} if learned else {}))
                yield from table_of(fields, out).to_batches()
        flat.trim()

    return run, fields


def _dealt(b: Numbered, parts: int, hot: float, learned: bool):
    """([(part, histories, their numbers of pairs, words, counts)], where the pairs of the parts are, and what pairs() gives).

    Pairs with an unknown history are left out: they back off to the word with weight 1."""
    h, w, n, at, place = b.pairs(learned)
    ids, counts = b.ids, b.counts
    keep = np.flatnonzero(counts[h] > 0)
    part = _pair_parts(ids[h[keep]], ids[w[keep]], counts[h[keep]].astype(np.float64), parts, hot)
    order = np.lexsort((ids[w[keep]], ids[h[keep]], part))
    own, part = keep[order], part[order]
    out = []
    for p, begin, end in _runs(part):
        x = own[begin:end]
        new = np.flatnonzero(np.concatenate([[True], h[x][1:] != h[x][:-1]]))
        out.append((p, ids[h[x[new]]], np.diff(new, append=len(x)), w[x], n[x]))
    return out, own, h, w, at, place


def _keys(h_at: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (h_at.astype(np.uint64) << _ID_BITS) | w


def _sum_pairs(facts: dict, hot: float):
    def add(asked: pa.Table) -> pa.Table:
        """Counts of the pairs of a part; of each history the pairs seen 1 to K times, the tokens of others, the sum of P(w)."""
        rows = rows_of(asked)
        h = np.concatenate([np.repeat(unpack(r["h"]), unpack(r["runs"]).astype(np.int64)) for r in rows])
        w, c_w, n = (np.concatenate([unpack(r[k]) for r in rows]) for k in ("w", "p", "n"))
        histories, h_at = np.unique(h, return_inverse=True)
        key = _keys(h_at, w)
        order = np.argsort(key, kind="stable")
        at = order[np.concatenate([[True], key[order][1:] != key[order][:-1]])]
        c = np.add.reduceat(n[order], np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))).astype(np.int64)
        h_at, w, p = h_at[at], w[at], _probability(facts, c_w[at])
        stats, k = _stats(c), len(histories)
        seen = np.stack([np.bincount(h_at[c == r], minlength=k) for r in range(1, K + 1)])
        rest = np.bincount(h_at[c > K], c[c > K], minlength=k).astype(np.int64)
        row = {
            "part": rows[0]["part"], "h": pack(histories), "runs": pack(np.bincount(h_at, minlength=k)), "w": pack(w), "c": pack(c), "seen": pack(seen.reshape(-1)),
            "rest": pack(rest), "low": pack(np.bincount(h_at, p, minlength=k).astype(np.float64)), "stats": stats,
        }
        flat.trim()
        return table_of(PAIR_TABLE, [row])

    return add


def _probability(facts: dict, c: np.ndarray) -> np.ndarray:
    """P(w) of words seen c times, the unseen class's for 0."""
    d = np.ones(K + 1)
    for r, x in facts["d1"].items():
        d[r] = x
    c = c.astype(np.float64)
    return np.where(c > 0, facts["known"] * np.where(c <= K, d[np.minimum(c, K).astype(np.int64)], 1.0) * c / max(1, facts["tokens"]), facts["unseen"])


def _discounted(facts: dict, c: np.ndarray) -> np.ndarray:
    d = np.ones(K + 1)
    for r, x in facts["d2"].items():
        d[r] = x
    return np.where(c <= K, d[np.minimum(c, K).astype(np.int64)], 1.0) * c


WEIGHT_TABLE = "part int, h binary, runs binary, w binary, c binary, alpha binary, s binary"
_HISTORY = "h long, seen array<long>, rest long, low double"


def _histories(batches):
    """A row a history of a part: what alpha and s are made of."""
    for batch in batches:
        for r in rows_of(batch):
            h, rest, low = unpack(r["h"]), unpack(r["rest"]), unpack(r["low"])
            seen = unpack(r["seen"]).reshape(K, -1).T
            yield _batch(h=pa.array(h.astype(np.int64)), seen=pa.array(seen.astype(np.int64).tolist(), pa.list_(pa.int64())), rest=pa.array(rest.astype(np.int64)), low=pa.array(low))


def weights(facts: dict, seen: np.ndarray, rest: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a(h), s(h)) from the pairs of h seen 1 to K times (a row each), the tokens in others, and the sum of P(w) over all.

    Every history's count is the number of tokens that follow it: a text's last token, its end, is no history."""
    c_h = (seen * np.arange(1, K + 1)[:, None]).sum(axis=0) + rest
    mass = sum(_discounted(facts, np.array([float(r)]))[0] * seen[r - 1] for r in range(1, K + 1)) + rest
    left = 1 - mass / c_h
    spare = np.maximum(left, 1 / (c_h + 1))
    return spare / np.maximum(1 - low, facts["unseen"]), (1 - spare) / (mass / c_h)


def _spread(facts: dict, h: np.ndarray, alpha: np.ndarray, s: np.ndarray) -> None:
    """Puts the weights of histories that are spread over the parts where they belong."""
    if facts["spread"]:
        for k in np.flatnonzero(np.isin(h, np.array(list(facts["spread"]), np.uint64))):
            alpha[k], s[k] = facts["spread"][int(h[k])]


def _weigh(facts: dict):
    """Rows of the table of pairs with the weights of each history."""

    def run(batches):
        for batch in batches:
            for r in rows_of(batch):
                h = unpack(r["h"])
                alpha, s = weights(facts, unpack(r["seen"]).reshape(K, -1).astype(np.float64), unpack(r["rest"]).astype(np.float64), unpack(r["low"]))
                _spread(facts, h, alpha, s)
                yield from table_of(WEIGHT_TABLE, [{**{c: r[c] for c in ("part", "h", "runs", "w", "c")}, "alpha": pack(alpha), "s": pack(s)}]).to_batches()

    return run


def discounts(n: dict[int, int], least: int) -> dict[int, float]:
    """Katz's Good-Turing discount of each count from `least` to K, from counts of counts; half a count is taken off
    where the counts of counts give none between 0 and 1."""
    out, a = {}, (K + 1) * n.get(K + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(least, K + 1):
        d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - a) / (1 - a) if n.get(r) and a < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def _totals(table: DataFrame) -> tuple[dict[int, int], int, int]:
    """(counts of counts, grams, tokens) of a table with `stats`."""
    x = table.agg(*[F.coalesce(F.sum(F.get("stats", F.lit(k))), F.lit(0)).alias(f"s{k}") for k in range(K + 3)]).collect()[0]
    return {r: x[r - 1] for r in range(1, K + 2) if x[r - 1]}, x[K + 1], x[K + 2]


def _learn(blocks: DataFrame) -> tuple[DataFrame, DataFrame, dict, DataFrame]:
    """(words, pairs, facts, numbered): the stored tables, what describes them, and the blocks, numbered by them.
    Of `blocks`, which are deleted, texts marked `learn` count."""
    spark = blocks.sparkSession
    size = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).collect()[0]
    parts = {"words": max(LEAST_PARTS, -(-size[1] // PART_TOKENS)), "pairs": max(LEAST_PARTS, -(-size[0] // PART_TOKENS))}
    words = stored(blocks.mapInArrow(_ask_words(parts["words"], True), ASKED_WORDS).groupBy("part").applyInArrow(_sum_words, WORD_TABLE), "words", compression="zstd")
    release(spark)
    n1, vocabulary, tokens = _totals(words)
    d1 = discounts(n1, 1)
    unseen, known = sum((1 - d1[r]) * r * n1.get(r, 0) for r in d1) / tokens if tokens else 1.0, 1.0
    if unseen <= 0:  # no word is rare: the unseen class counts as one more token
        unseen, known = 1 / (tokens + 1), tokens / (tokens + 1)
    hot = tokens / (HOT_SHARE * parts["pairs"])
    facts = {"tokens": tokens, "vocabulary": vocabulary, "unseen": unseen, "known": known, "d1": d1, "parts": parts, "hot": hot}
    numbered = _numbered(blocks, words, facts)
    asked = numbered.drop("doc_id").mapInArrow(*_ask_pairs(parts["pairs"], hot, True))
    counted = stored(asked.groupBy("part").applyInArrow(_sum_pairs(facts, hot), PAIR_TABLE), "counts", compression="zstd")
    release(spark)
    facts["d2"] = discounts(_totals(counted)[0], MIN_PAIR)
    # at most HOT_SHARE histories a part: those that are spread
    c_h = sum((k + 1) * F.col(f"n{k}") for k in range(K)) + F.col("rest")
    rows = counted.select("h", "seen", "rest", "low").mapInArrow(_histories, _HISTORY).groupBy("h")
    sums = rows.agg(*[F.sum(F.get("seen", F.lit(k))).alias(f"n{k}") for k in range(K)], F.sum("rest").alias("rest"), F.sum("low").alias("low")).filter(c_h > hot).collect()
    spread = {}
    for x in sums:
        a, s = weights(facts, np.array([[float(x[f"n{k}"])] for k in range(K)]), np.array([float(x.rest)]), np.array([x.low]))
        spread[x.h] = (float(a[0]), float(s[0]))
    facts["spread"] = spread
    pairs = stored(counted.select("part", "h", "runs", "w", "c", "seen", "rest", "low").mapInArrow(_weigh(facts), WEIGHT_TABLE), "pairs", compression="zstd")
    discard(counted)
    release(spark)
    return words, pairs, facts, numbered


def _numbered(blocks: DataFrame, words: DataFrame, facts: dict) -> DataFrame:
    """The stored blocks with numbers for words; what was stored for `blocks` is deleted."""
    parts, spark = facts["parts"]["words"], blocks.sparkSession
    asked = blocks.mapInArrow(_ask_words(parts, False), ASKED_WORDS)
    answers = stored(asked.groupBy("part").cogroup(words.groupBy("part")).applyInArrow(_answer_words(parts), ANSWERED_WORDS), "answers", compression="zstd")
    release(spark)
    schema = f"{NUMBERED_FIELDS}, doc_id {blocks.schema['doc_id'].dataType.simpleString()}"
    out = stored(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_number, schema), "numbered", compression="zstd")
    discard(blocks)
    discard(answers)
    release(spark)
    return out


def _pair_rows(batches):
    """A row a pair (h, w, c) of the table, words by their numbers."""
    for batch in batches:
        for r in rows_of(batch):
            h = np.repeat(unpack(r["h"]), unpack(r["runs"]).astype(np.int64))
            yield _batch(h=pa.array(h.astype(np.int64)), w=pa.array(unpack(r["w"]).astype(np.int64)), c=pa.array(unpack(r["c"]).astype(np.int64)))


def train(docs: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """(words, pairs, facts) of documents (text): the table of words, one row a part, the rows (h, w, c) of that of pairs,
    and counts, discounts and the stored table of pairs itself. The tables are in the shared folder."""
    blocks = blocks_of(docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit(True).alias("learn"), "text"))
    words, pairs, facts, numbered = _learn(blocks)
    discard(numbered)
    return words, pairs.mapInArrow(_pair_rows, "h long, w long, c long"), {**facts, "pairs": pairs}


# scores


ANSWERED_PAIRS = "block long, part int, c binary, alpha binary, s binary"


def _answer_pairs(asked: pa.Table, table: pa.Table) -> pa.Table:
    """Counts of the pairs, weights of the histories that blocks ask a part for; 0, and 1, where there are none."""
    own = rows_of(table)
    if own:
        h, w, c, alpha, s = (unpack(own[0][k]) for k in ("h", "w", "c", "alpha", "s"))
        key = _keys(np.repeat(np.arange(len(h)), unpack(own[0]["runs"]).astype(np.int64)), w)
    else:
        h, key, c, alpha, s = np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.ones(1), np.ones(1)
    out = []
    for r in rows_of(asked):
        asked_h, runs, asked_w = unpack(r["h"]), unpack(r["runs"]).astype(np.int64), unpack(r["w"])
        at = np.minimum(np.searchsorted(h, asked_h), len(h) - 1)
        known = h[at] == asked_h
        wanted = _keys(np.repeat(at, runs), asked_w)
        found = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        n = np.where((key[found] == wanted) & np.repeat(known, runs), c[found], np.uint64(0))
        out.append({"block": r["block"], "part": r["part"], "c": pack(n), "alpha": pack(np.where(known, alpha[at], 1.0)), "s": pack(np.where(known, s[at], 1.0))})
    flat.trim()
    return table_of(ANSWERED_PAIRS, out)


def _evaluate(facts: dict, kind: pa.DataType):
    parts, hot = facts["parts"]["pairs"], facts["hot"]
    scale = math.log10(facts["tokens"] + 1 * (facts["vocabulary"] + 1))

    def evaluate(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        """The recursion for every token of a block, added up by text."""
        out = []
        for r in rows_of(blocks.drop_columns(["doc_id"])):
            b = Numbered(r)
            ids, counts = b.ids, b.counts
            asked, own, h, w, at, place = _dealt(b, parts, hot, False)
            got = {x["part"]: x for x in rows_of(answers)}
            n, alpha, s = np.zeros(len(h)), np.ones(len(h)), np.ones(len(h))
            k = 0
            for p, _, runs, words, _ in asked:
                x = own[k : k + len(words)]
                n[x], alpha[x], s[x] = unpack(got[p]["c"]), np.repeat(unpack(got[p]["alpha"]), runs), np.repeat(unpack(got[p]["s"]), runs)
                k += len(words)
            # a part without pairs of a spread history does not know its weights
            own_alpha, own_s = np.ones(len(ids)), np.ones(len(ids))
            _spread(facts, ids, own_alpha, own_s)
            far = counts[h] > hot
            alpha[far], s[far] = own_alpha[h[far]], own_s[h[far]]
            value = np.log10(_probability(facts, counts))
            kept, c_h = n > 0, np.maximum(counts[h].astype(np.float64), 1)
            pair = np.where(kept, np.log10(np.where(kept, s * _discounted(facts, n) / c_h, 1.0)), np.log10(alpha) + value[w])
            token = value[b.tokens]
            token[at] = pair[place]
            total = lambda x, b=b: np.bincount(b.row, x, minlength=len(b.sizes))
            known = total(counts[b.tokens] > 0).astype(np.int64)
            base = total(np.log10(counts[b.tokens].astype(np.float64) + 1) - scale)
            out.append(pa.table({
                "doc_id": pa.concat_arrays(blocks.column("doc_id").chunks).flatten().cast(kind), "learn": pa.array(b.learn), "n_tokens": pa.array(b.sizes), "n_known": pa.array(known),
                "base_score": pa.array(base), "score": pa.array(total(token)),
            }))
        flat.trim()
        return pa.concat_tables(out)

    return evaluate


def _score(numbered: DataFrame, pairs: DataFrame, facts: dict) -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, base_score, score) of all texts of numbered blocks."""
    element, parts = numbered.schema["doc_id"].dataType.elementType, facts["parts"]["pairs"]
    asked = numbered.drop("doc_id").mapInArrow(*_ask_pairs(parts, facts["hot"], False))
    answers = stored(asked.groupBy("part").cogroup(pairs.groupBy("part")).applyInArrow(_answer_pairs, ANSWERED_PAIRS), "answers", compression="zstd")
    release(numbered.sparkSession)
    schema = f"doc_id {element.simpleString()}, learn boolean, n_tokens long, n_known long, base_score double, score double"
    return numbered.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_evaluate(facts, to_arrow_type(element)), schema)


def _output(scored: DataFrame, facts: dict) -> DataFrame:
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(facts["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, model: tuple[DataFrame, DataFrame, dict]) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of documents (doc_id, held_out, text)."""
    words, _, facts = model
    blocks = blocks_of(docs.select("doc_id", F.coalesce(~F.col("held_out"), F.lit(True)).alias("learn"), "text"))
    pairs, facts = facts["pairs"], {k: x for k, x in facts.items() if k != "pairs"}
    return _output(_score(_numbered(blocks, words, facts), pairs, facts), facts)


def train_and_score(docs: DataFrame, parts: int = HELD_PARTS) -> DataFrame:
    """Learns from the documents (doc_id, text) that are not held out and scores all."""
    blocks = blocks_of(docs.select("doc_id", (~held_out(F.col("doc_id"), parts)).alias("learn"), "text"))
    _, pairs, facts, numbered = _learn(blocks)
    return _output(_score(numbered, pairs, facts), facts)
