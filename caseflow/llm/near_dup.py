"""Near-duplicate documents: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

1. Sketch. A document's set of five-word shingles is hashed; the range of hashes is cut into BINS equal bins and the
   smallest hash of each is its value there. An empty bin borrows from a bin drawn by a 2-universal probe sequence
   that depends on the bin alone (optimal densification), so equal sets agree everywhere. BANDS groups of ROWS bins
   make bucket keys.
2. Classes. Documents with equal sets are one class, named by its smallest doc_id; only classes go on, so thousands
   of copies cost one.
3. Stars. Each bucket proposes edges from its smallest member to its other members of fitting size: as many edges as members.
   Every edge is confirmed on the full sets, made anew from the whole texts.
4. The rest. A star can miss links between its rays. In every bucket whose members are still in several components, those
   outside its largest one are compared with all members by estimates from smallest hashes in bins, in blocks of bounded size. Partners in
   other components whose estimate is not clearly below the threshold are listed with the member, each member's text is
   sent to the pair of blocks once, and the full sets are compared there; only links leave it. Nothing is capped. So rows
   grow with members (and their share of blocks), not with pairs; comparisons grow with the product of a bucket's members
   and those outside its largest component.
5. Components of confirmed links, by alternating large and small stars.

Recall: at similarity 0.75 two sets miss all buckets with probability (1 - 0.75 ** 5) ** 40, about 2e-5, less above; an
estimate lies SLACK deviations too low with probability 3e-6. Rows are dealt by bucket key only for aggregates and
run-time split joins, or by (bucket, block pair) for blocks. Large groups of copies, LARGE at most, are joined by broadcast.
Tables that the result does not need are deleted.

Edge cases: null and blank texts have empty sets, are linked with nothing and stay; a text of fewer than five words has one
shingle; ids are whole numbers (others fail in the cast); rows with one doc_id are one node; rows without doc_id take the id of their class, or stay if it has none;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import discard, short_batches, stored

SHINGLE = 5
THRESHOLD = 75  # percent
BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
BLOCK = 1024
BLOCK_SHINGLES = 1 << 21  # of a block's members together, on average
EST_BINS = 400
SLACK = 4.5  # standard deviations of an estimate
LARGE = 1000  # copies of more than 1 / LARGE of all rows meet their class without a shuffle

_bounds = lambda n: np.array([min((k << 64) // n, (1 << 64) - 1) for k in range(n + 1)], np.uint64)
_BOUNDS, _EST_BOUNDS = _bounds(BINS), _bounds(EST_BINS)
_BAND = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)

SKETCH_SCHEMA = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"
PROMISING_SCHEMA = "key long, i int, j int, rep long, component long, mates array<long>"


def _probe(bins: np.ndarray, attempt: int) -> np.ndarray:
    return (flat.mix(bins.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)


_PROBES = np.stack([_probe(np.arange(BINS), a) for a in range(64)], axis=1)


def signature(s: np.ndarray) -> np.ndarray:
    """One value a bin for a sorted, non-empty array of distinct hashes."""
    at = np.searchsorted(s, _BOUNDS)
    filled = at[1:] > at[:-1]
    values = s[np.minimum(at[:-1], len(s) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        found = filled[_PROBES[empty]]
        donor = _PROBES[empty, found.argmax(axis=1)]
        late, attempt = np.flatnonzero(~found.any(axis=1)), _PROBES.shape[1]
        while len(late):
            donor[late] = _probe(empty[late], attempt)
            late, attempt = late[~filled[donor[late]]], attempt + 1
        values[empty] = values[donor]
    return values


def band_keys(s: np.ndarray) -> np.ndarray:
    return flat.mix((signature(s).reshape(BANDS, ROWS) * flat._PLACE[:ROWS]).sum(axis=1) + _BAND).view(np.int64)


def _sketch(batches):
    for batch in batches:
        out = {k: [] for k in ("n_shingles", "fp1", "fp2", "bands")}
        for begin, end, data, ends in flat.slices(batch.column(1)):
            h, _, before = flat.words(data, ends)
            for k in range(end - begin):
                s = np.unique(flat.shingles(h[before[k] : before[k + 1]], SHINGLE))
                out["n_shingles"].append(len(s))
                if not len(s):
                    out["fp1"].append(None), out["fp2"].append(None), out["bands"].append(None)
                    continue
                out["fp1"].append(flat.mix(s ^ np.uint64(1)).sum().view(np.int64))
                out["fp2"].append(flat.mix(s ^ np.uint64(2)).sum().view(np.int64))
                out["bands"].append(band_keys(s))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(out["n_shingles"], pa.int64()), pa.array(out["fp1"], pa.int64()), pa.array(out["fp2"], pa.int64()), pa.array(out["bands"], pa.list_(pa.int64()))],
            ["doc_id", *out],
        )


def _estimators(batches):
    """(rep, signature, bands) of rows (doc_id, text): 16 bits of the smallest hash in each of EST_BINS bins, 0 where empty;
    the bucket keys."""
    for batch in batches:
        out, keys = [], []
        for s in _sets(batch.column(1)):
            at = np.searchsorted(s, _EST_BOUNDS)
            values = flat.mix(s[np.minimum(at[:-1], len(s) - 1)]).astype(np.uint16) | np.uint16(1)
            out.append(np.where(at[1:] > at[:-1], values, 0).astype(np.uint16).tobytes())
            keys.append(band_keys(s).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(keys, pa.binary())], ["rep", "signature", "bands"])


def sketch(docs: DataFrame) -> DataFrame:
    """SKETCH_SCHEMA of documents (doc_id, text)."""
    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketch, SKETCH_SCHEMA)


def _confirm(batches):
    """Links among pairs (a, b, text_a, text_b): the sets' intersection is at least THRESHOLD percent of their union."""
    for batch in batches:
        a, b = (_sets(batch.column(k)) for k in (2, 3))
        ok = []
        for x, y in zip(a, b, strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(both > 0 and 100 * both >= THRESHOLD * (len(x) + len(y) - both))
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def _sets(texts):
    for begin, end, data, ends in flat.slices(texts):
        h, _, before = flat.words(data, ends)
        for k in range(end - begin):
            yield np.unique(flat.shingles(h[before[k] : before[k + 1]], SHINGLE))


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose texts (doc_id, text) are similar enough."""
    x, y = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b); a component is named by its smallest node."""
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        # of each node, the larger neighbours move to the smallest one
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # of each node, itself and its smaller neighbours move to the smallest one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, stored(small, "edges")
        discard(before)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if state == last:
            break
        last = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _grouped(names: str, work):
    """For mapInArrow: work on all rows of one (key, i, j) at once, as lists by name; rows are sorted by these."""
    columns = ["key", "i", "j", *names.split(", ")]

    def run(batches):
        held = None
        for batch in batches:
            rows = {k: batch.column(k).to_pylist() for k in columns}
            group = list(zip(rows["key"], rows["i"], rows["j"], strict=True))
            start = 0
            for k in range(1, len(group) + 1):
                if k < len(group) and group[k] == group[k - 1]:
                    continue
                part = {c: v[start:k] for c, v in rows.items()}
                if held and (held["key"][0], held["i"][0], held["j"][0]) == group[start]:
                    part = {c: held[c] + v for c, v in part.items()}
                elif held:
                    yield work(held)
                held, start = part, k
        if held:
            yield work(held)

    return run


def _promising(rows: dict) -> pa.RecordBatch:
    """PROMISING_SCHEMA of two blocks of a bucket: members with a partner in another component whose estimate is not clearly too low;
    mates has these partners, once for both."""
    sig = np.frombuffer(b"".join(rows["signature"]), np.uint16).reshape(-1, EST_BINS)
    bands, key = np.frombuffer(b"".join(rows["bands"]), np.int64).reshape(-1, BANDS), rows["key"][0]
    rep, comp, n, block = (np.array(rows[k]) for k in ("rep", "component", "n", "block"))
    left = np.flatnonzero(block == rows["i"][0])
    right = np.flatnonzero(block == rows["j"][0])
    mates, used = {}, np.zeros(len(rep), bool)
    for x in left:
        ys = right[(comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= THRESHOLD * np.maximum(n[right], n[x]))]
        if rows["i"][0] == rows["j"][0]:
            ys = ys[ys > x]
        if not len(ys):
            continue
        # a pair is compared in the first bucket that it shares
        ys = ys[bands[x, (bands[ys] == bands[x]).argmax(axis=1)] == key]
        if not len(ys):
            continue
        same, some = (sig[ys] == sig[x]) & (sig[x] > 0), (sig[ys] > 0) | (sig[x] > 0)
        share = same.sum(axis=1) / some.sum(axis=1)
        # the bins draw m of the u hashes in the union without replacement; 1.5 / u for hashes that meet in a bin
        u = np.maximum(n[ys], n[x])
        m = EST_BINS * -np.expm1(-u / EST_BINS)
        ys = ys[share >= THRESHOLD / 100 - SLACK * np.sqrt(0.1875 / m * np.maximum(0, 1 - m / u)) - 1.5 / u]
        if len(ys):
            mates[x] = rep[ys]
            used[ys] = used[x] = True
    at = np.flatnonzero(used)
    whole = [pa.array([rows[k][0]] * len(at), t) for k, t in (("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()))]
    own = [pa.array(rep[at], pa.int64()), pa.array(comp[at], pa.int64()), pa.array([mates.get(x, ()) for x in at], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([*whole, *own], ["key", "i", "j", "rep", "component", "mates"])


def _linked(rows: dict) -> pa.RecordBatch:
    """Links (a, b) of promising members with their texts, on the full sets; pairs that links found here already join are left out."""
    sets = list(_sets(pa.array(rows["text"], pa.large_string())))
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids, inside = np.split(ids, np.cumsum([len(s) for s in sets])[:-1]), np.zeros(len(values), bool)
    at, of, above, a, b = {}, dict(zip(rows["rep"], rows["component"], strict=True)), {}, [], []
    for k, rep in enumerate(rows["rep"]):  # rows with one doc_id are one node
        at.setdefault(rep, []).append(k)

    def top(c):
        while c in above:
            c = above[c]
        return c

    for x, mates in enumerate(rows["mates"]):
        inside[ids[x]] = True
        for mate in mates:
            own, other = top(rows["component"][x]), top(of[mate])
            if own == other:
                continue
            for y in at[mate]:
                both = np.count_nonzero(inside[ids[y]])
                if both and 100 * both >= THRESHOLD * (len(ids[x]) + len(ids[y]) - both):
                    above[max(own, other)] = min(own, other)
                    a.append(min(rows["rep"][x], mate)), b.append(max(rows["rep"][x], mate))
                    break
        inside[ids[x]] = False
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _across(rows: DataFrame, labels: DataFrame, signatures: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join members of one bucket in different components.

    Members of a bucket's main component meet only the bucket's other members. A text is sent once for a pair of blocks, not for a
    pair of texts.
    """
    named = rows.join(labels, rows["rep"] == labels["node"], "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    sizes = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    most = sizes.groupBy("key").agg(F.max(F.struct("m", "s", "component")).alias("main"), F.sum("m").alias("m"), F.sum("s").alias("s")).filter("m > main.m")
    blocks = lambda m, s: F.ceil(F.greatest(m / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    apart = most.select("key", F.col("main.component").alias("main"), blocks(F.col("main.m"), F.col("main.s")).alias("ours"), blocks(F.col("m") - F.col("main.m"), F.col("s") - F.col("main.s")).alias("rest"))
    ours = F.col("component") == F.col("main")
    dealt = (
        named.join(apart, "key")
        .withColumn("block", F.when(ours, F.pmod(F.xxhash64("rep"), "ours")).otherwise(F.col("ours") + F.pmod(F.xxhash64("rep"), "rest")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.when(ours, F.col("ours")).otherwise(0), F.col("ours") + F.col("rest") - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component", "n")
    )
    by = ("key", "i", "j")
    full = dealt.join(signatures, "rep").select(*by, "block", "rep", "component", "n", "signature", "bands")
    promising = stored(full.repartition(*by).sortWithinPartitions(*by).mapInArrow(_grouped("block, rep, component, n, signature, bands", _promising), PROMISING_SCHEMA), "promising")
    told = promising.join(texts.withColumnRenamed("doc_id", "rep"), "rep").select(*by, "rep", "component", "mates", "text")
    links = stored(told.repartition(*by).sortWithinPartitions(*by).mapInArrow(_grouped("rep, component, mates, text", _linked), "a long, b long").distinct(), "links")
    discard(promising)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of documents (doc_id, text)."""
    sketches = stored(sketch(docs), "sketches")
    full = sketches.filter("n_shingles > 0")
    classes = stored(full.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes")
    # one row stands for each class: the row of its smallest id
    own = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "n_shingles", "bands")
    keyed = own.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("most"), F.min_by("n", "rep").alias("hub_n")).filter("hub < most")
    rows = stored(keyed.join(shared, "key").select("key", "rep", "n", "hub", "hub_n").distinct(), "buckets")
    members = rows.select("rep").distinct()
    ids = members.withColumnRenamed("rep", "doc_id")
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi"), "texts")
    signatures = stored(texts.mapInArrow(_estimators, "rep long, signature binary, bands binary").dropDuplicates(["rep"]), "signatures")
    fits = F.lit(100) * F.least("n", "hub_n") >= F.lit(THRESHOLD) * F.greatest("n", "hub_n")
    pairs = stored(rows.filter((F.col("rep") != F.col("hub")) & fits).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = stored(confirm(pairs, texts), "links")
    labels = components(links)
    more = _across(rows.select("key", "rep", "n"), labels, signatures, texts)
    if not more.isEmpty():
        before, labels = labels, components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        discard(before)
    for x in (rows, texts, signatures, pairs, links, more):
        discard(x)
    named = _named(sketches, classes).select("doc_id", "n_shingles", "rep")
    component = F.coalesce("component", "rep")
    return named.join(labels, named["rep"] == labels["node"], "left").select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _named(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """sketches with rep, the smallest id of the class; the id itself if the class has one row or none."""
    most = (classes.agg(F.sum("rows")).collect()[0][0] or 0) / LARGE
    copies = classes.filter("rows > 1").select("fp1", "fp2", "rep", "rows")
    large = F.broadcast(copies.filter(F.col("rows") > most).select("fp1", "fp2", F.col("rep").alias("large")))  # fewer than LARGE rows
    met = sketches.join(large, ["fp1", "fp2"], "left")
    small = copies.filter(F.col("rows") <= most).select("fp1", "fp2", "rep")
    rest = met.filter("large IS NULL").drop("large").join(small, ["fp1", "fp2"], "left")
    return met.filter("large IS NOT NULL").withColumnRenamed("large", "rep").unionByName(rest.withColumn("rep", F.coalesce("rep", "doc_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept: of each component the document with the smallest doc_id, once.

    Rows without doc_id stay, one of each text.
    """
    kept = near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    same = docs["doc_id"].cast("long") == kept["doc_id"]
    once = docs.join(kept.filter("rows = 1"), same, "left_semi")
    first = docs.join(kept.filter("rows > 1"), same, "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(first).unionByName(docs.filter("doc_id IS NULL").dropDuplicates(["text"]))
