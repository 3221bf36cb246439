"""Token counts of a subword vocabulary, from counts of distinct pre-tokens.

The vocabulary has no piece in which another character precedes a word mark, so no merge crosses the border before a run of
marks (spaces become marks): a text is a sequence of independent pre-tokens, each a run of marks with what follows up
to the next run. Texts are cut into blocks; a block keeps the pre-token frequencies of its documents, as numbers of the
block's distinct pre-tokens. These are dealt by hash, so that each distinct pre-token of all texts meets the library once
and in one place; its count of pieces goes back to the blocks that have it, where it is joined to the frequencies and summed.
Ids of texts are never made.

Scale: what is dealt are a block's distinct pre-tokens, so frequent ones are one entry a block; blocks and parts have bounded
size (one text, or one pre-token, is the least), and both grow in number with the texts alone.

Edge cases: null text is empty and has no tokens; special strings in texts are ordinary text; a text without spaces is
one pre-token; other columns are ignored; rows may repeat, ids too; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import flat
from .common import short_batches, stored
from .packed import pack, pack_texts, rows_of, table_of, unpack, unpack_texts

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
BLOCK_ENTRIES, BLOCK_CHARS = 1 << 20, 1 << 26  # of a block: pairs of document and pre-token; characters
PART_ENTRIES, LEAST_PARTS = 1 << 19, 32

MARK = "▁"
_PRETOKEN = re.compile(f"{MARK}+[^{MARK}]*")


def pretokens(text: str) -> list[str]:
    return _PRETOKEN.findall(MARK + text.replace(" ", MARK)) if text else []


class PieceCounts:
    """The library, and the count of pieces of single pre-tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        if any(re.search(f"[^{MARK}]{MARK}", self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())):
            raise ValueError("this vocabulary has pieces across pre-tokens")
        self.mark = len(self.model.encode("a ")) - len(self.model.encode("a"))

    def counts(self, units: list[str]) -> list[int]:
        # the library itself puts the first mark before what it encodes
        return [len(ids) if len(u) > 1 else self.mark for u, ids in zip(units, self.model.encode([u[1:] for u in units], num_threads=1), strict=True)]


_counters: dict[str, PieceCounts] = {}

BLOCK_FIELDS = "block long, n_units long, bytes binary, sizes binary, units binary, times binary, texts binary"


def _cut(batches):
    """Blocks of rows (doc_id, text): the frequencies of pre-tokens in each text."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    made = 0
    known: dict[str, int] = {}
    ids, n_bytes, sizes, units, times = [], [], [], [], []
    chars = 0

    def emit():
        # frequent pre-tokens have small numbers, which compress well
        order = np.argsort(-np.bincount(np.array(units, np.int64), minlength=len(known)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        texts = list(known)
        row = {
            "block": (part << 33) + made, "n_units": len(known), "bytes": pack(np.array(n_bytes, np.int64)), "sizes": pack(np.array(sizes, np.int64)),
            "units": pack(rank[np.array(units, np.int64)]), "times": pack(np.array(times, np.int64)), "texts": pack_texts([texts[k] for k in order]),
        }
        own = pa.concat_arrays(ids)
        return table_of(BLOCK_FIELDS, [row]).append_column("doc_id", pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own))

    for batch in batches:
        for k, text in enumerate(batch.column(1)):
            t = text.as_py() or ""
            ids.append(batch.column(0).slice(k, 1))
            bag = Counter(pretokens(t))
            n_bytes.append(len(t.encode())), sizes.append(len(bag))
            units += [known.setdefault(u, len(known)) for u in bag]
            times += bag.values()
            chars += len(t)
            if len(units) >= BLOCK_ENTRIES or chars >= BLOCK_CHARS:
                yield from emit().to_batches()
                made, chars = made + 1, 0
                known = {}
                ids, n_bytes, sizes, units, times = [], [], [], [], []
    if ids:
        yield from emit().to_batches()
    flat.trim()


ASKED = "part int, block long, texts binary"
ANSWERED = "block long, part int, pieces binary"


def _parts(texts: list[str], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each pre-token, and their order by part."""
    part = np.array([zlib.crc32(t.encode()) % parts for t in texts], np.int64)
    return part, np.argsort(part, kind="stable")


def _ask(parts: int):
    def run(batches):
        for batch in batches:
            for r in rows_of(batch):
                texts = unpack_texts(r["texts"])
                part, order = _parts(texts, parts)
                found, first = np.unique(part[order], return_index=True)  # the parts that the block has pre-tokens for
                ends = [*first[1:], len(order)]
                yield from table_of(ASKED, [{"part": p, "block": r["block"], "texts": pack_texts([texts[k] for k in order[a:b]])} for p, a, b in zip(found.tolist(), first, ends, strict=True)] if texts else []).to_batches()
        flat.trim()

    return run


def _count(path: str):
    def count(asked: pa.Table) -> pa.Table:
        """Pieces of the pre-tokens of a part, each counted once, for every block that has them."""
        if path not in _counters:
            _counters[path] = PieceCounts(path)
        rows = [(r["block"], r["part"], unpack_texts(r["texts"])) for r in rows_of(asked)]
        distinct = list({t for _, _, texts in rows for t in texts})
        pieces = {}
        for k in range(0, len(distinct), 8192):
            pieces.update(zip(distinct[k : k + 8192], _counters[path].counts(distinct[k : k + 8192]), strict=True))
        out = [{"block": b, "part": p, "pieces": pack(np.array([pieces[t] for t in texts], np.int64))} for b, p, texts in rows]
        flat.trim()
        return table_of(ANSWERED, out)

    return count


def _sum(parts: int, limit: int, kind: pa.DataType):
    def add(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for r in rows_of(blocks.drop_columns(["doc_id"])):
            got = sorted(rows_of(answers), key=lambda x: x["part"])
            _, order = _parts(unpack_texts(r["texts"]), parts)
            pieces = np.zeros(len(order), np.int64)
            if got:
                pieces[order] = np.concatenate([unpack(x["pieces"]) for x in got]).astype(np.int64)
            sizes = unpack(r["sizes"]).astype(np.int64)
            n = np.bincount(np.repeat(np.arange(len(sizes)), sizes), (pieces[unpack(r["units"]).astype(np.int64)] * unpack(r["times"]).astype(np.int64)), minlength=len(sizes)).astype(np.int64)
            ids = pa.concat_arrays(blocks.column("doc_id").chunks).flatten().cast(kind)
            out.append(pa.table({"doc_id": ids, "n_bytes": pa.array(unpack(r["bytes"]).astype(np.int64)), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}))
        flat.trim()
        return pa.concat_tables(out)

    return add


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of documents (doc_id, text), by the vocabulary file at path."""
    short_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    blocks = stored(docs.select("doc_id", "text").mapInArrow(_cut, f"{BLOCK_FIELDS}, doc_id array<{kind.simpleString()}>"), "pretokens", compression="zstd")
    entries = blocks.agg(F.coalesce(F.sum("n_units"), F.lit(0))).collect()[0][0]
    parts = max(LEAST_PARTS, -(-entries // PART_ENTRIES))
    asked = blocks.select("block", "texts").mapInArrow(_ask(parts), ASKED)
    answers = stored(asked.groupBy("part").applyInArrow(_count(path), ANSWERED), "pieces", compression="zstd")
    schema = f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_sum(parts, limit, to_arrow_type(kind)), schema)
