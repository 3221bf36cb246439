"""Exact search among vectors of whole components: tiles of rows, chunks of queries, bounds before scores.

A query (vec_id, label, vector, low, high, side) looks for the `most` rows of largest inner product among those whose score lies
in [low, high], ties by smaller vec_id: any rows (side 0), those of its label (1) or of other labels (2); never rows of
its own vec_id.

Tables. Rows are cut into tiles where they lie, without a shuffle: a task orders up to BUFFER_VALUES components by
nearest reference and cuts them. A tile keeps its vectors, the measures of each row against REFERENCES reference vectors
(distances or angles, made once), and their ranges. Queries, dealt evenly, make chunks of the same shape.

Search. A pair of chunk and tile whose ranges rule out every wanted score is dropped. Tiles of a pair's slot (near one
reference, SLOT_TILES of them about) meet their chunk in one task. There each query bounds the score of every row from the
stored measures, leaves out what cannot lie in its window, and scores the rest with whole numbers in the order of their
upper bounds until no bound reaches the last of its best. This is done twice: a chunk meets its home slot first, and the
scores of its best there are what rows of other slots must reach. Nothing is capped; the second round covers all the rest.

References are chosen by farthest-first traversal of SAMPLE rows, those of smallest hash, a bounded sample that affects speed
alone. Vectors of different lengths do not meet. Bounds are widened by more than the rounding of their arithmetic.

Range: components are whole numbers below 2 ** 45 and scores must fit a long; larger ones raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, short_batches, stored
from .packed import pack, unpack

TILE_VALUES, BUFFER_VALUES = 1 << 17, 1 << 22
CHUNK_ROWS, SLOT_TILES = 512, 32
REFERENCES, SAMPLE = 32, 1024
DEALS = 64
LEAST, MOST = -(1 << 62), 1 << 62

_TILE = "tile long, dim int, cell int, near array<double>, far array<double>, norm double, ids binary, labels binary, vectors binary, refs binary"
_CHUNK = "chunk long, dim int, cell int, near array<double>, far array<double>, norm double, least long, key binary, ids binary, labels binary, vectors binary, refs binary, low binary, high binary, tag binary, value binary"
_FOUND = "chunk long, nth int, key long, query_id long, tag long, value long, vec_id long, score long"


def quantised(vector: str, scale: int) -> F.Column:
    """floor(scale * x) of each component, or null where the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class Distances:
    """Measures are distances to pivots; the triangle inequality bounds the distance of two rows, and so their product."""

    def refs(self, m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        out = np.empty((len(m), len(pivots)))
        for k, p in enumerate(pivots):
            out[:, k] = np.sqrt(((m - p) ** 2).sum(axis=1))
        return out

    def bounds(self, refs: np.ndarray, norm: float, rows: _Side) -> tuple[np.ndarray, np.ndarray]:
        square = rows.norms**2 + norm**2
        slack = 0.01 + 1e-14 * square
        near, far = np.zeros(len(square), np.float32), np.full(len(square), np.inf, np.float32)
        give = 1e-6 * ((refs.max() if len(refs) else 0.0) + rows.farthest + rows.norms + norm)
        for own, other in zip(refs, rows.refs, strict=True):
            np.maximum(near, np.abs(other - own), out=near)
            np.minimum(far, other + own, out=far)
        far = np.minimum(far, rows.norms + norm)
        return (square - (far + give) ** 2) / 2 - slack, (square - np.maximum(near.astype(np.float64) - give, 0) ** 2) / 2 + slack

    def reach(self, gap: F.Column, norm: F.Column, other: F.Column) -> F.Column:
        """What the product of two rows with measures at least `gap` apart cannot exceed."""
        square = norm * norm + other * other
        give = F.lit(1e-6) * (norm + other)
        return (square - F.pow(F.greatest(gap - give, F.lit(0.0)), F.lit(2))) / 2 * (1 + 1e-12) + 1


class Angles:
    """Measures are angles to reference directions; they bound the angle of two rows, and norms make a product of its cosine."""

    GIVE = 5e-6

    def refs(self, m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        norms = np.linalg.norm(m, axis=1)[:, None] * np.linalg.norm(pivots, axis=1)[None]
        return np.arccos(np.clip(m @ pivots.T / np.maximum(norms, 1e-300), -1, 1))

    def bounds(self, refs: np.ndarray, norm: float, rows: _Side) -> tuple[np.ndarray, np.ndarray]:
        product = rows.norms * norm
        near, far = np.zeros(len(product), np.float32), np.full(len(product), np.pi, np.float32)
        for own, other in zip(refs, rows.refs, strict=True):
            both = other + own
            np.maximum(near, np.abs(other - own), out=near)
            np.minimum(far, np.minimum(both, np.float32(2 * np.pi) - both), out=far)
        slack = 0.01 + 1e-12 * product
        return product * np.cos(np.minimum(far.astype(np.float64) + self.GIVE, np.pi)) - slack, product * np.cos(np.maximum(near.astype(np.float64) - self.GIVE, 0)) + slack

    def reach(self, gap: F.Column, norm: F.Column, other: F.Column) -> F.Column:
        angle = F.least(F.greatest(gap - self.GIVE, F.lit(0.0)), F.lit(np.pi))
        return norm * other * F.greatest(F.cos(angle), F.lit(0.0)) * (1 + 1e-12) + 1


def references(rows: DataFrame, most: int = REFERENCES, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Reference vectors by length, farthest first, from the `sample` rows of smallest hash; vectors of zeros are none."""
    drawn = rows.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(sample).collect()
    by: dict[int, list] = {}
    for x in drawn:
        if any(x.vector):
            by.setdefault(len(x.vector), []).append(x.vector)
    out = {}
    for dim, found in by.items():
        m = np.array(found, np.float64)
        at, far = [0], np.sqrt(((m - m[0]) ** 2).sum(axis=1))
        while len(at) < most and far.max() > 0:
            at.append(int(far.argmax()))
            far = np.minimum(far, np.sqrt(((m - m[at[-1]]) ** 2).sum(axis=1)))
        out[dim] = m[at]
    return out


def _zigzag(a: np.ndarray) -> bytes:
    a = a.astype(np.int64).reshape(-1)
    return pack(((a << 1) ^ (a >> 63)).view(np.uint64))


def _unzigzag(b: bytes) -> np.ndarray:
    u = unpack(b)
    return (u >> np.uint64(1)).view(np.int64) ^ -(u & np.uint64(1)).view(np.int64)


def _matrices(column: pa.Array):
    """(dim, places, matrix) for each length of vectors in an array<long> column."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        m = flat[(starts[at][:, None] + np.arange(dim)[None])] if dim else np.zeros((len(at), 0), np.int64)
        if m.size and int(np.abs(m).max()) >= 1 << 45:
            raise ValueError("a component is too large for exact scores")
        yield int(dim), at, m


def _cut(kind, pivots: dict, rows_each: int, fields: list[str], schema: str):
    """Tiles (or chunks) of batches (vector, fields); each is ordered by nearest reference."""

    def run(batches):
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        made, held, size = 0, {}, 0

        def emit():
            nonlocal made
            for dim, parts in held.items():
                m = np.concatenate([x[0] for x in parts])
                own = [np.concatenate([x[1][k] for x in parts]) for k in range(len(fields))]
                p = pivots.get(dim, np.zeros((0, dim)))
                refs = kind.refs(m.astype(np.float64), p).astype(np.float32)
                cell = refs.argmin(axis=1) if len(p) else np.zeros(len(m), np.int64)
                near = refs[np.arange(len(m)), cell] if len(p) else np.zeros(len(m))
                order = np.lexsort((own[0], near, cell))
                step = rows_each or max(64, TILE_VALUES // max(1, dim))
                for i in range(0, len(order), step):
                    at = order[i : i + step]
                    r = refs[at].astype(np.float64)
                    row = {"dim": dim, "cell": int(np.bincount(cell[at]).argmax()), "near": r.min(axis=0).tolist(), "far": r.max(axis=0).tolist(), "norm": float(np.sqrt((m[at].astype(np.float64) ** 2).sum(axis=1).max())), "vectors": _zigzag(m[at]), "refs": pa.compress(refs[at].tobytes(), codec="zstd", asbytes=True) if refs.size else b""}
                    row |= {k: _zigzag(v[at]) for k, v in zip(fields, own, strict=True)}
                    name = schema.split()[0]
                    if name == "chunk":
                        row["least"] = int(own[fields.index("low")][at].min())
                    yield pa.RecordBatch.from_pylist([row | {name: (part << 33) + made}], schema=_arrow(schema))
                    made += 1

        for batch in batches:
            for dim, at, m in _matrices(batch.column(0)):
                held.setdefault(dim, []).append((m, [batch.column(k + 1).to_numpy(zero_copy_only=False).astype(np.int64)[at] for k in range(len(fields))]))
                size += m.size + len(m)
            if size >= BUFFER_VALUES:
                yield from emit()
                held, size = {}, 0
        yield from emit()

    return run


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in schema.split(", ")])


def tiles_of(rows: DataFrame, kind, pivots: dict) -> DataFrame:
    """The stored tiles of rows (vec_id, label, vector)."""
    short_batches(rows.sparkSession)
    return stored(rows.select("vector", "vec_id", "label").mapInArrow(_cut(kind, pivots, 0, ["ids", "labels"], _TILE), _TILE), "tiles")


def chunks_of(queries: DataFrame, kind, pivots: dict) -> DataFrame:
    """The stored chunks of queries (key, vec_id, label, vector, low, high, tag, value); all columns but vector are longs."""
    fields = ["key", "ids", "labels", "low", "high", "tag", "value"]
    parts = max(1, -(-queries.count() // CHUNK_ROWS))
    dealt = queries.select("vector", "key", "vec_id", "label", "low", "high", "tag", "value").repartition(parts, "key")  # windows of one row stay together
    return stored(dealt.mapInArrow(_cut(kind, pivots, CHUNK_ROWS, fields, _CHUNK), _CHUNK), "chunks")


class _Side:
    """The arrays of the tiles or the chunk of a task; rows of tiles in the order of their ids."""

    def __init__(self, t: pa.Table, dim: int, by_id: bool = False):
        join = lambda k: np.concatenate([_unzigzag(x.as_py()) for x in t.column(k)])
        ids, labels = join("ids"), join("labels")
        m = join("vectors").reshape(len(ids), dim)
        raw, count = [], len(t.column("near")[0])
        for x, k in zip(t.column("refs"), t.column("ids"), strict=True):
            size = len(_unzigzag(k.as_py()))
            raw.append(np.frombuffer(pa.decompress(x.as_py(), decompressed_size=size * count * 4, codec="zstd", asbytes=True) if count else b"", np.float32).reshape(size, count))
        at = np.argsort(ids, kind="stable") if by_id else np.arange(len(ids))
        self._hold(ids[at], labels[at], m[at], np.ascontiguousarray(np.concatenate(raw)[at].T))

    def _hold(self, ids, labels, m, refs):
        self.ids, self.labels, self.m, self.refs = ids, labels, m, refs  # refs: a row a reference
        self.largest = int(np.abs(m).max()) if m.size else 0
        self.norms = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
        self.farthest = refs.max(axis=0).astype(np.float64) if len(refs) else np.zeros(len(ids))
        self._labelled: dict[int, _Side] = {}

    def exact(self, kind: type) -> None:
        self.m = self.m.astype(kind)

    def of(self, label: int) -> _Side:
        """The rows of one label."""
        if label not in self._labelled:
            at, part = np.flatnonzero(self.labels == label), _Side.__new__(_Side)
            part._hold(self.ids[at], self.labels[at], self.m[at], np.ascontiguousarray(self.refs[:, at]))
            self._labelled[label] = part
        return self._labelled[label]


def _first(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` largest scores, smaller ids first among equals."""
    at = np.arange(len(score))
    if len(score) > 4 * most:
        at = np.flatnonzero(score >= -np.partition(-score, most - 1)[most - 1])
    return at[np.lexsort((ids[at], -score[at]))[:most]]


class _Candidates:
    """The rows that a query's windows may hold, with bounds; a row is scored once, whatever the number of windows."""

    def __init__(self, rows: _Side, kind, refs: np.ndarray, norm: float, q: np.ndarray, fits: np.ndarray, low: int, high: int):
        lb, ub = kind.bounds(refs, norm, rows)
        at = np.flatnonzero(fits & (ub >= low) & (lb <= high))
        self.at, self.lb, self.ub, self.ids, self.m, self.q = at, lb[at], np.floor(ub[at]), rows.ids[at], rows.m, q
        self.score, self.known = np.zeros(len(at), np.int64), np.zeros(len(at), bool)

    def best(self, low: int, high: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the first `most` rows with a score in the window. Rows are scored in bands of falling upper bound, until
        no bound left reaches the last of the best."""
        rest = np.flatnonzero((self.ub >= low) & (self.lb <= high))
        s, best, band = np.zeros(0, np.int64), np.zeros(0, np.int64), 256
        while len(rest):
            now, later = rest, rest[:0]
            if len(rest) > band:
                part = np.argpartition(-self.ub[rest], band - 1)
                now, later = rest[part[:band]], rest[part[band:]]
            new = now[~self.known[now]]
            self.score[new] = (self.m[self.at[new]] @ self.q).astype(np.int64)
            self.known[new] = True
            got = now[(self.score[now] >= low) & (self.score[now] <= high)]
            best = np.concatenate([best, got])
            best = best[_first(self.score[best], self.ids[best], most)]
            s = self.score[best]
            rest = later[self.ub[later] >= s[-1]] if len(s) == most else later
            band *= 8
        return s, self.ids[best]


def _search(kind, side: int, most: int):
    """The best rows of a slot's tiles for each query of a chunk."""

    def run(tiles: pa.Table, chunks: pa.Table) -> pa.Table:
        out = {k: [] for k in ("nth", "key", "query_id", "tag", "value", "vec_id", "score")}
        if tiles.num_rows and chunks.num_rows:
            dim = chunks.column("dim")[0].as_py()
            rows, asks = _Side(tiles, dim, by_id=True), _Side(chunks, dim)
            key, low, high, tag, value = (_unzigzag(chunks.column(k)[0].as_py()) for k in ("key", "low", "high", "tag", "value"))
            most_of = dim * rows.largest * asks.largest
            if most_of >= 1 << 63:
                raise ValueError("a score does not fit a long")
            for x in (rows, asks):
                x.exact(np.float64 if most_of < 1 << 53 else np.int64)
            order = np.lexsort((asks.labels, asks.ids))  # windows of one row follow each other
            same = lambda i, j: asks.ids[i] == asks.ids[j] and asks.labels[i] == asks.labels[j] and np.array_equal(asks.m[i], asks.m[j])
            k = 0
            while k < len(order):
                i, end = order[k], k + 1
                while end < len(order) and same(i, order[end]):
                    end += 1
                windows = order[k:end]
                pool = rows.of(int(asks.labels[i])) if side == 1 else rows
                fits = pool.ids != asks.ids[i]
                if side == 2:
                    fits &= pool.labels != asks.labels[i]
                found = _Candidates(pool, kind, asks.refs[:, i], asks.norms[i], asks.m[i], fits, low[windows].min(), high[windows].max())
                for w in windows:
                    s, ids = found.best(int(low[w]), int(high[w]), most)
                    for name, x in (("nth", w), ("key", key[w]), ("query_id", asks.ids[w]), ("tag", tag[w]), ("value", value[w])):
                        out[name].append(np.full(len(s), x))
                    out["vec_id"].append(ids), out["score"].append(s)
                k = end
        got = {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in out.items()}
        chunk = chunks.column("chunk")[0].as_py() if chunks.num_rows else 0
        got["nth"] = got["nth"].astype(np.int32)
        return pa.table({"chunk": np.full(len(got["key"]), chunk, np.int64), **got}, schema=_arrow(_FOUND))

    return run


def _raised(most: int):
    """A chunk whose queries ask for at least the last of their best scores so far, if they have `most`."""

    def run(chunks: pa.Table, found: pa.Table) -> pa.Table:
        rows = chunks.to_pylist()
        if rows and found.num_rows:
            low = _unzigzag(rows[0]["low"]).copy()
            nth, score = found.column("nth").to_numpy(), found.column("score").to_numpy()
            n, least = np.bincount(nth, minlength=len(low)), np.full(len(low), MOST)
            np.minimum.at(least, nth, score)
            low = np.where(n >= most, np.maximum(low, least), low)
            rows[0] |= {"low": _zigzag(low), "least": int(low.min())}
        return pa.Table.from_pylist(rows, schema=_arrow(_CHUNK))

    return run


def search(rows: DataFrame, queries: DataFrame, kind, most: int, side: int = 0) -> DataFrame:
    """(key, query_id, tag, value, vec_id, score, rank) of queries (key, vec_id, label, vector, low, high, tag, value) among rows
    (vec_id, label, vector). key tells queries apart; tag and value, two longs, come out as they are."""
    pivots = references(rows)
    tiles, chunks = tiles_of(rows, kind, pivots), chunks_of(queries, kind, pivots)
    return searched(tiles, chunks, kind, most, side)


def searched(tiles: DataFrame, chunks: DataFrame, kind, most: int, side: int = 0) -> DataFrame:
    """search() on stored tiles and chunks; the chunks are deleted."""
    held = {r.cell: r.n for r in tiles.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # REFERENCES rows at most
    parts = F.create_map(*[F.lit(x) for k, n in held.items() for x in (k, -(-n // SLOT_TILES))]) if held else F.create_map().cast("map<int,int>")
    slot = lambda of: F.col("cell") * F.lit(1 << 32) + F.pmod(F.xxhash64(of), F.coalesce(parts[F.col("cell")], F.lit(1)).cast("long"))
    name = {c: f"c_{c}" for c in ("cell", "near", "far", "norm", "least")}

    def pairs(asking: DataFrame, home: bool | None) -> DataFrame:
        """(tile, slot, chunk) that may hold something wanted, in the home slots or in all others."""
        # rows of ranges only; a chunk goes to all DEALS, over which tiles are dealt
        own = asking.select("chunk", "dim", slot("chunk").alias("home"), *[F.col(k).alias(v) for k, v in name.items()]).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
        every = tiles.select("tile", "dim", "near", "far", "norm", slot("tile").alias("slot"), F.pmod(F.xxhash64("tile"), F.lit(DEALS)).cast("int").alias("deal"))
        met = every.join(own, ["dim", "deal"])
        gaps = F.zip_with(F.zip_with("near", "c_far", lambda x, y: x - y), F.zip_with("c_near", "far", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
        reach = kind.reach(F.coalesce(F.array_max(gaps), F.lit(0.0)), F.col("norm"), F.col("c_norm"))
        return met.filter((reach >= F.col("c_least")) & ((F.col("slot") == F.col("home")) == F.lit(home))).select("tile", "slot", "chunk")

    def round_of(asking: DataFrame, home: bool) -> DataFrame:
        wanted = stored(pairs(asking, home), "pairs")
        left = wanted.join(tiles, "tile")
        right = wanted.select("chunk", "slot").distinct().join(asking, "chunk")
        right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of their own, for the cogroup
        found = stored(left.groupBy("chunk", "slot").cogroup(right.groupBy("chunk", "slot")).applyInArrow(_search(kind, side, most), _FOUND), "found")
        discard(wanted)
        return found

    first = round_of(chunks, True)
    raised = stored(chunks.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(_raised(most), _CHUNK), "raised")
    second = round_of(raised, False)
    discard(chunks), discard(raised)
    rank = F.row_number().over(Window.partitionBy("chunk", "nth").orderBy(F.desc("score"), "vec_id"))
    return first.unionByName(second).withColumn("rank", rank).filter(F.col("rank") <= most).select("key", "query_id", "tag", "value", "vec_id", "score", "rank")


def asked(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Queries without windows of rows (vec_id, label, vector); rows that repeat whole are one query."""
    whole = rows.select("vec_id", "label", "vector").dropDuplicates()
    n = lambda x: F.lit(x).cast("long")
    return whole.select(F.xxhash64("vec_id", "label", "vector").alias("key"), "*", n(LEAST).alias("low"), n(MOST).alias("high"), n(0).alias("tag"), n(0).alias("value"))
