"""Toxicity by a subsequence-kernel support vector machine with Nystroem landmarks.

Kernel. Two strings are compared by the triples of characters that both have in order, with up to two characters
between neighbours and SPAN in all; a triple that spans n characters counts DECAY ** n, so inserted and gapped
characters weaken a match and do not break it. Punctuation is dropped and runs of single characters are joined first
("i-d-i o t"). Values are divided by the lengths' norms.

Training. Labels mark documents, a document is a bag of units (words, or overlapping pieces of long ones), and is toxic
if one of its units is: multiple-instance learning. Counts over labelled documents give units that go with the label
(a log-likelihood ratio); a spread-out choice of them are the landmarks, which map units to a small vector space
(Nystroem); a linear machine with squared hinge loss is trained on units, and twice again with the units that fooled it
in clean documents. A logistic curve on the best unit of each document turns margins into probabilities.

What is fitted is a bounded sample of the labelled rows, by these parameters: MAX_LABELLED labelled documents, those with
the smallest hash of doc_id, of which texts with the same smallest shingle count once (copies share a label by
chance; blanks are one text); of their units the CANDIDATES that go best with the label, CLEAN_UNITS others by hash and a
quarter as many by frequency; LANDMARKS landmarks. They are read as tables, and only counts of units and one number a
document reach the driver. Counts of units cover all sampled texts, scores cover all texts.

Scoring. Landmarks and machine fold into one weight for each triple, a table of one megabyte; a text is scored in one
pass over its bytes, without a shuffle.

Edge cases: null, blank and very short texts score like texts without toxic units; without labels of both kinds
every text scores the share of toxic labels (0 if there are none); a document labelled twice is toxic if one label says
so; labels without document, null labels and other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import flat
from .common import held_out, short_batches, stored

HELD_PARTS = 4
CUT = 0.3
MAX_LABELLED = 12_000
LANDMARKS, CANDIDATES, CLEAN_UNITS = 48, 300, 8_000
LEAST_RATIO = 25.0
DECAY, SPAN = 0.8, 5
PIECE = 12

_GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[48:58] = np.arange(27, 37)
_CODE[192:] = 37  # lead bytes; the bytes that follow one add to its code, and have none
TRIPLES = 1 << 18
#: By length: the norm of a string without repeated triples.
_NORM = np.sqrt([sum(max(0, n - b) * DECAY ** (2 * (b + 1)) for _, b in _GAPS) for n in range(2 * PIECE + 1)])


def _codes_of(data: np.ndarray) -> np.ndarray:
    """A code from 1 to 62 at the first byte of each letter, digit or other character beyond ASCII; elsewhere 0."""
    c = _CODE[data]
    lead = np.flatnonzero(data >= 192)
    if len(lead):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        x, inside = padded[lead].astype(np.int64), np.ones(len(lead), bool)
        for k in (1, 2, 3):
            more = padded[lead + k]
            inside &= (more & 192) == 128
            x = np.where(inside, x * 67 + more, x)
        c[lead] = 37 + x % 26
    return c


def _units(data: np.ndarray, ends: np.ndarray):
    """(codes, row and place of each kept byte's unit and piece): see _pieces for their sums."""
    c = _codes_of(data)
    kept = np.flatnonzero(c)
    c = c[kept]
    if not len(c):
        return None
    border = flat._SPACE[data].copy()
    border[ends[:-1][ends[:-1] < len(data)]] = True
    word = np.cumsum(border)[kept]
    row = np.searchsorted(ends, kept, "right") - 1
    new = np.ones(len(c), bool)
    new[1:] = (word[1:] != word[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    n = np.diff(at, append=len(c))
    joined = np.zeros(len(at), bool)
    joined[1:] = (n[1:] == 1) & (n[:-1] == 1) & (row[at[1:]] == row[at[:-1]])
    starts = at[~joined]
    return kept, c, row, starts, np.diff(starts, append=len(c))


def _triples(c: np.ndarray, unit: np.ndarray):
    """(place, triple, weight) of all triples inside units, one array for each pair of gaps."""
    for a, b in _GAPS:
        if len(c) > b:
            ok = np.flatnonzero(unit[:-b] == unit[b:])
            yield ok, (c[ok] << 12) | (c[ok + a] << 6) | c[ok + b], DECAY ** (b + 1)


def _margins(data: np.ndarray, ends: np.ndarray, weights: np.ndarray):
    """(row, margin, first and last byte) of each piece of up to 2 * PIECE characters."""
    found = _units(data, ends)
    if found is None:
        return None
    kept, c, row, starts, n = found
    unit = np.repeat(np.arange(len(starts)), n)
    gain = np.zeros(len(c))
    for place, triple, weight in _triples(c, unit):
        gain[place] += weight * weights[triple]
    # pieces of PIECE characters; two neighbours are scored together
    inside = np.arange(len(c)) - np.repeat(starts, n)
    at = np.flatnonzero(inside % PIECE == 0)
    sums, size, of = np.add.reduceat(gain, at), np.diff(at, append=len(c)), unit[at]
    size = np.minimum(size, np.repeat(starts + n, 1)[of] - at)
    after = np.zeros(len(at), bool)
    after[:-1] = of[1:] == of[:-1]
    total, length = sums.copy(), size.copy()
    total[:-1][after[:-1]] += sums[1:][after[:-1]]
    length[:-1][after[:-1]] += size[1:][after[:-1]]
    use = np.flatnonzero(((inside[at] == 0) | after) & (length >= 3))
    return row[at[use]], total[use] / _NORM[length[use]], kept[at[use]], kept[np.minimum(at[use] + length[use], len(c)) - 1]


FLOOR = -2.0  # the margin of a text without units


def best_margins(texts: pa.Array, weights: np.ndarray, bias: float, names: bool = False):
    """The largest margin of each text and, if asked for, the unit that has it."""
    best, unit = np.full(len(texts), FLOOR), [""] * len(texts)
    for begin, end, data, ends in flat.slices(texts):
        got = _margins(data, ends, weights)
        if got is None:
            continue
        row, margin, first, last = got
        np.maximum.at(best, row + begin, margin + bias)
        if names:
            top = np.flatnonzero(margin + bias >= best[row + begin])
            for k in top:
                end = last[k] + 1
                while end < len(data) and data[end] & 192 == 128:  # the rest of the last character
                    end += 1
                unit[row[k] + begin] = bytes(data[first[k] : end]).decode("utf-8", "ignore")
    return best, unit


def _codes(unit: str) -> np.ndarray:
    c = _codes_of(np.frombuffer(unit.encode(), np.uint8))
    return c[c > 0][: 2 * PIECE]


def kernel_rows(units: list[str], table: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Sums of rows of table, which column names for each triple, over the triples of each unit, divided by its norm."""
    out = np.zeros((len(units), table.shape[1]))
    for k in range(0, len(units), 512):
        part = [_codes(u) for u in units[k : k + 512]]
        n = np.array([len(x) for x in part])
        unit = np.repeat(np.arange(len(part)), n)
        for place, triple, weight in _triples(np.concatenate(part), unit):
            np.add.at(out, k + unit[place], weight * table[column[triple]])
        out[k : k + len(part)] /= np.maximum(_NORM[n], 1e-9)[:, None]
    return out


def _word_units(text: str) -> set[str]:
    words = (re.sub(r"[^0-9a-z\x80-\U0010ffff]+", "", w) for w in re.sub(r"[A-Z]+", lambda m: m[0].lower(), text).split())
    return {w[k : k + 2 * PIECE] for w in words for k in range(0, max(1, len(w) - PIECE), PIECE) if len(w) >= 3}


def _with_smallest(batches):
    for batch in batches:
        low = np.zeros(batch.num_rows, np.int64)
        for begin, end, data, ends in flat.slices(batch.column(0)):
            h, _, before = flat.words(data, ends)
            for k in range(end - begin):
                s = flat.shingles(h[before[k] : before[k + 1]], 5)
                low[begin + k] = s.min().view(np.int64) if len(s) else 0
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(low)], ["text", "toxic", "doc_id", "smallest"])


def _count_units(batches):
    """(unit, toxic, clean) documents of rows (text, toxic), added up within a batch."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for u in _word_units(text or ""):
                counts.setdefault(u, [0, 0])[0 if toxic else 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], ["unit", "toxic", "clean"])


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the last a bias, of a linear machine with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = weight / weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(40):
        slack = 1 - y * (x @ w)
        on = slack > 0
        grad = ridge * w - 2 * (x[on].T @ (weight[on] * y[on] * slack[on]))
        hess = ridge * np.eye(len(w)) + 2 * (x[on].T * weight[on]) @ x[on]
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, with a little shrinkage."""
    x, w = np.stack([margin, np.ones_like(margin)], axis=1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-2 * np.eye(2), grad)
        w -= np.clip(step, -2, 2)
    return float(max(w[0], 0.0)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, parts: int = HELD_PARTS) -> dict:
    """A model from documents (doc_id, text) and labels (doc_id, toxic) that are not held out."""
    short_batches(docs.sparkSession)
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.filter(~held_out(F.col("doc_id"), parts)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # at most max_labelled short rows
    sample = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("text", (F.col("toxic") > 0).alias("toxic"), "doc_id")
    # copies share a label by chance, so near copies count once: of texts with one smallest shingle, one is kept
    kind = sample.schema["doc_id"].dataType.simpleString()  # ids may be of any simple type
    sample = sample.mapInArrow(_with_smallest, f"text string, toxic boolean, doc_id {kind}, smallest long").groupBy("smallest")
    sample = stored(sample.agg(F.min_by(F.struct("text", "toxic"), F.struct(F.xxhash64("doc_id"), "doc_id", "text")).alias("x")).select("x.*"), "labelled")
    n = {x.toxic: x.n for x in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, q = n.get(True, 0), n.get(False, 0)
    if not p or not q:
        return {"constant": float(p > 0)}
    units = stored(sample.mapInArrow(_count_units, "unit string, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "units")
    a, b = F.col("toxic"), F.col("clean")
    rate = (a + b) / F.lit(float(p + q))
    term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(F.lit(0.0))
    ratio = 2 * (term(a, rate * p) + term(b, rate * q))
    good = units.filter((a >= 3) & (a * q > b * p)).withColumn("ratio", ratio).orderBy(F.desc("ratio"), "unit").limit(CANDIDATES).collect()
    clean = units.filter(a * q <= b * p).orderBy(F.xxhash64("unit"), "unit").limit(CLEAN_UNITS).unionByName(units.filter(a * q <= b * p).orderBy(F.desc("clean"), "unit").limit(CLEAN_UNITS // 4))
    clean = {x.unit: x.clean for x in clean.collect()}
    good = [x for x in good if x.ratio >= LEAST_RATIO] or good[:10]
    if not good or not clean:
        return {"constant": p / (p + q)}
    return _fit(sample, [x.unit for x in good], [x.toxic for x in good], clean)


def _fit(sample: DataFrame, good: list[str], counts: list[int], clean: dict[str, int]) -> dict:
    # only triples of these units have a column; column 0 is that of all others, and stays 0
    found = [list(_triples(c := _codes(u), np.zeros(len(c), int))) for u in good]
    used = np.unique(np.concatenate([t for x in found for _, t, _ in x]))
    column = np.zeros(TRIPLES, np.int32)
    column[used] = np.arange(1, len(used) + 1)
    rows = np.zeros((len(good), len(used) + 1))
    for k, u in enumerate(good):
        for _, triple, weight in found[k]:
            np.add.at(rows[k], column[triple], weight)
        rows[k] /= _NORM[len(_codes(u))]
    like = kernel_rows(good, rows.T, column)
    chosen: list[int] = []
    for k in range(len(good)):
        if len(chosen) < LANDMARKS and (not chosen or like[k, chosen].max() < 0.8):
            chosen.append(k)
    z = np.ascontiguousarray(rows[chosen].T)
    values, vectors = np.linalg.eigh((like[np.ix_(chosen, chosen)] + like[np.ix_(chosen, chosen)].T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    negative = dict(clean)
    model: dict = {}
    for turn in range(3):
        names = good + list(negative)
        x = kernel_rows(names, z, column) @ root
        y = np.array([1.0] * len(good) + [-1.0] * len(negative))
        weight = np.concatenate([np.log1p(counts) / np.log1p(counts).sum(), (v := np.log1p(list(negative.values()))) / v.sum()])
        w = _machine(x, y, weight)
        weights = np.zeros(TRIPLES)
        weights[used] = (z @ (root @ w[:-1]))[1:]
        model = {"weights": weights, "bias": float(w[-1]), "landmarks": [good[k] for k in chosen], "shares": root @ w[:-1]}

        def judge(batches, model=model):
            for batch in batches:
                best, unit = best_margins(batch.column(0), model["weights"], model["bias"], names=True)
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(best), pa.array(unit, pa.string())], ["toxic", "margin", "unit"])

        judged = sample.mapInArrow(judge, "toxic boolean, margin double, unit string").collect()
        if turn < 2:
            wanted = set(good)
            for r in judged:
                u = re.sub(r"[^0-9a-z\x80-\U0010ffff]+", "", r.unit.lower())
                if not r.toxic and r.margin > -0.7 and u not in wanted:
                    negative[u] = negative.get(u, 0) + 20
    model["slope"], model["offset"] = _curve(np.array([r.margin for r in judged]), np.array([float(r.toxic) for r in judged]))
    return model


def _scored(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, renamed c0, c1, ..., and the score."""
    short_batches(docs.sparkSession)
    rows = docs.select(*[docs[k].alias(f"c{n}") for n, k in enumerate(keep)], docs["text"].alias("text"))
    names = [*rows.columns[:-1], "score"]
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast({k: model[k] for k in ("weights", "bias", "slope", "offset", "constant") if k in model})

    def run(batches):
        m = shared.value
        for batch in batches:
            if "constant" in m:
                s = np.full(batch.num_rows, m["constant"])
            else:
                best, _ = best_margins(batch.columns[-1], m["weights"], m["bias"])
                s = 1 / (1 + np.exp(-np.clip(m["slope"] * best + m["offset"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s)], names)

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all unless given; one called toxicity is left out) with a column `toxicity` from 0 to 1, of the column text."""
    names = [k for k in (docs.columns if keep is None else keep) if k != "toxicity"]
    return _scored(docs, model, names).toDF(*names, "toxicity")


def reject(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that score below the cut, by a model of the labelled ones among them."""
    return _scored(docs, train(docs, labels), docs.columns).filter(F.col("score") < cut).drop("score").toDF(*docs.columns)
