"""Merkle tree of a dataset: leaves by source, runs of FANOUT nodes, subroots, one root, proofs, and their verification.

A leaf is the digest of doc_id, source, lang, n_chars and text, each `-` if null, else its bytes' count, `:` and the value. Leaves of
a source ascend by doc_id (equal ones by leaf). While a source has several nodes, every FANOUT neighbours become one
node, the digest of theirs; what remains is its subroot. Subroots, ordered by source, make one more tree. Digests are lowercase
hex of sha256.

Numbers. Leaves are stored once, narrow, then dealt by ranges of (source, doc_id, leaf) and sorted inside; a leaf's number is its
place in its range and the sizes of the ranges before, sums of a table with a row a range and source. A hot source lies in many
ranges.

Levels. The slot-zero node of each run computes its siblings' numbers, one for each offset; an equijoin on (group, number) fetches
them, and the run's digests make the parent, which keeps them. A level has a FANOUT-th of the rows of the one below.

Proofs. From the root down, each run hands its children their path: what lies left and right of them in each run above. A leaf
joins its run once; its proof is the path's digests, and folding a leaf, as given or tampered with, along its path gives the
root that it vouches for. Only DataFrame functions; each level is a stored table.

Edge cases: null ids come first, like null sources; a source with one leaf has it as subroot, one source has its subroot as
root; a proof without siblings is the digest of nothing; rows that repeat are leaves of their own; empty and long texts are
hashed whole; columns are taken by name, others ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_PARTS = 5


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(fields: tuple[str, ...] = FIELDS, text: Column | None = None) -> Column:
    """The leaf of a row; `text` in place of the column text if given."""
    values = [text if text is not None and k == "text" else F.col(k).cast("string") for k in fields]
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return digest(F.concat(*[part(v) for v in values]))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `nth`, their place from 0 in their group's order, and `n`, the group's size, stored. The group may be null in a struct."""
    keys = [F.col(k).asc_nulls_first() for k in (group, *order)]
    placed = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    spans = placed.groupBy(group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    so_far = Window.partitionBy(group).orderBy("_part")
    before = F.coalesce(F.sum("_size").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(group, "_part", "_first", before.alias("_before"), F.sum("_size").over(Window.partitionBy(group)).alias("n"))
    met = placed.withColumn("_part", part).join(spans, [group, "_part"])
    out = stored(met.withColumn("nth", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before"), "numbered")
    discard(placed)
    return out


def parents(nodes: DataFrame, group: str) -> DataFrame:
    """(group, nth, n, digest, children) of nodes (group, nth, n, digest): a row a run, n nodes in the group, `children`
    the digests of the run in order. Slot-zero nodes fetch their siblings by computed numbers."""
    first = nodes.filter(F.col("nth") % FANOUT == 0).select(group, "n", F.col("nth").alias("_zero"))
    asks = first.select(group, "n", "_zero", F.explode(F.sequence("_zero", F.least(F.col("_zero") + FANOUT, "n") - 1)).alias("nth"))
    met = asks.join(nodes.select(group, "nth", "digest"), [group, "nth"])
    runs = met.groupBy(group, "n", "_zero").agg(F.array_sort(F.collect_list(F.struct("nth", "digest"))).alias("_run"))
    children = F.transform("_run", lambda x: x["digest"])
    up = F.ceil(F.col("n") / FANOUT)
    return runs.select(group, (F.col("_zero") / FANOUT).cast("long").alias("nth"), up.alias("n"), digest(F.array_join(children, "")).alias("digest"), children.alias("children"))


def levels(nodes: DataFrame, group: str) -> list[DataFrame]:
    """The stored levels above nodes (group, nth, n, digest), lowest first; a group ends when one node remains."""
    out: list[DataFrame] = []
    now = nodes.select(group, "nth", "n", "digest")
    most = now.agg(F.max("n")).collect()[0][0] or 0
    while most > 1:
        out.append(stored(parents(now.filter("n > 1"), group), "level"))
        now, most = out[-1].select(group, "nth", "n", "digest"), -(-most // FANOUT)
    return out


def tops(nodes: DataFrame, above: list[DataFrame], group: str) -> DataFrame:
    """(group, digest): the last node of each group."""
    out = nodes.filter("n = 1").select(group, "digest")
    for level in above:
        out = out.unionByName(level.filter("n = 1").select(group, "digest"))
    return out


def _step(children: Column, slot: Column) -> Column:
    """What lies left and right of a child of a run."""
    join = lambda a: F.array_join(a, "")
    return F.struct(join(F.slice(children, F.lit(1), slot)).alias("left"), join(F.slice(children, slot + 2, F.lit(FANOUT))).alias("right"))


PATH = "array<struct<left:string,right:string>>"


def paths(above: list[DataFrame], group: str, ends: DataFrame) -> DataFrame:
    """(group, nth, children, path) of the runs of the lowest level; `path` leads from the run's own node upwards, and goes on
    with that of its group, ends (group, path)."""
    carried: DataFrame | None = None
    for level in reversed(above):
        own = level.filter("n = 1").join(ends, group).select(group, "nth", "children", "path")
        if carried is not None:
            own = own.unionByName(level.filter("n > 1").join(carried, [group, "nth"]).select(group, "nth", "children", "path"))
        if level is above[0]:
            return own
        each = own.select(group, "nth", "children", "path", F.explode(F.sequence(F.lit(0), F.size("children") - 1)).alias("_slot"))
        path = F.concat(F.array(_step(F.col("children"), F.col("_slot"))), F.col("path"))
        carried = stored(each.select(group, (F.col("nth") * FANOUT + F.col("_slot")).alias("nth"), path.alias("path")), "paths")
    raise ValueError("no levels")


def _led(nodes: DataFrame, above: list[DataFrame], group: str, ends: DataFrame) -> DataFrame:
    """nodes (group, nth, n, ...) with their path."""
    alone = nodes.filter("n = 1").join(ends, group)
    if not above:
        return alone
    runs = paths(above, group, ends).withColumnRenamed("nth", "_run")
    met = nodes.filter("n > 1").withColumn("_run", F.floor(F.col("nth") / FANOUT)).join(runs, [group, "_run"])
    slot = (F.col("nth") % FANOUT).cast("int")
    led = met.withColumn("path", F.concat(F.array(_step(F.col("children"), slot)), F.col("path"))).drop("_run", "children")
    return alone.unionByName(led)


def proved(leaves: DataFrame) -> DataFrame:
    """leaves (doc_id, source, leaf, ...) with subroot, root and path, their way to the root."""
    kept = stored(leaves.withColumn("group", F.struct("source")), "leaves")
    nodes = numbered(kept, "group", ["doc_id", "leaf"]).withColumn("digest", F.col("leaf"))
    discard(kept)
    above = levels(nodes, "group")
    subroots = tops(nodes, above, "group").withColumn("all", F.struct(F.lit(None).cast("string").alias("source")))
    top = numbered(subroots, "all", ["group"])
    over = levels(top, "all")
    root = tops(top, over, "all")
    none = root.select("all", F.array().cast(PATH).alias("path"))
    ends = _led(top, over, "all", none).join(root.select("all", F.col("digest").alias("root")), "all")
    ends = stored(ends.select("group", F.col("digest").alias("subroot"), "root", "path"), "ends")
    out = _led(nodes, above, "group", ends.select("group", "path"))
    return out.join(ends.select("group", "subroot", "root"), "group").drop("group", "nth", "n", "digest")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda acc, x: digest(F.concat(x["left"], acc, x["right"])))


def proof(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""))


_UPPER = "".join(map(chr, range(65, 91)))


def tampered(docs: DataFrame) -> Column:
    """The text of a row after tampering: where TAMPER_PARTS divides the id's crc32, A-Z are lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_PARTS == 0
    text = F.col("text").cast("string")
    return F.when(hit, F.translate(text, _UPPER, _UPPER.lower())).otherwise(text)


def verified(docs: DataFrame, text: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents; `text` is what a reader finds."""
    changed = ~text.eqNullSafe(F.col("text").cast("string"))
    leaves = docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf_of().alias("leaf"), F.when(changed, leaf_of(text=text)).alias("changed"))
    out = proved(leaves).withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(depth: int = 6, top: int = 4) -> str:
    """The same in SQL: levels enough for FANOUT ** depth rows a source and FANOUT ** top sources."""
    part = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}::VARCHAR) || ':' || {v} END"
    leaf = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in FIELDS) + ")"
    lower = f"translate(text, '{_UPPER}', '{_UPPER.lower()}')"
    # the crc of a short text: a byte after the other, each in eight steps
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda z: ascii(z)::BIGINT)), lambda c, b: {step}), 4294967295)"
    ctes = [
        f"d AS (SELECT *, {crc} % {TAMPER_PARTS} = 0 AS tamper FROM documents)",
        f"l AS (SELECT doc_id, source AS g, {leaf('text')} AS leaf, CASE WHEN tamper THEN {leaf(lower)} ELSE {leaf('text')} END AS f FROM d)",
        "p0 AS (SELECT *, '' AS p, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS nth, count(*) OVER (PARTITION BY g) AS n FROM l)",
        "k0 AS (SELECT g, nth, n, leaf AS d FROM p0)",
    ]
    text = lambda x: f"coalesce(array_to_string({x}, ''), '')"

    def tree(k: str, p: str, levels: int) -> None:
        for i in range(levels):
            ctes.append(f"{k}{i + 1} AS (SELECT g, x.nth // {FANOUT} AS nth, (n + {FANOUT - 1}) // {FANOUT} AS n, sha256(string_agg(d, '' ORDER BY x.nth)) AS d, list(d ORDER BY x.nth) AS ch FROM {k}{i} x WHERE n > 1 GROUP BY g, x.nth // {FANOUT}, n)")
        for i in range(levels):
            left, right = text(f"list_slice(ch, 1, x.nth % {FANOUT})"), text(f"list_slice(ch, x.nth % {FANOUT} + 2, {FANOUT})")
            ctes.append(
                f"{p}{i + 1} AS (SELECT x.* EXCLUDE (p, f, nth, n), CASE WHEN ch IS NULL THEN p ELSE p || {left} || {right} END AS p, CASE WHEN ch IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f, "
                f"x.nth // {FANOUT} AS nth, (x.n + {FANOUT - 1}) // {FANOUT} AS n FROM {p}{i} x LEFT JOIN {k}{i + 1} y ON x.n > 1 AND y.g IS NOT DISTINCT FROM x.g AND y.nth = x.nth // {FANOUT})"
            )

    ends = lambda k, levels: " UNION ALL ".join(f"SELECT g, d FROM {k}{i} WHERE n = 1" for i in range(levels + 1))
    tree("k", "p", depth)
    ctes += [f"su AS ({ends('k', depth)})", "sn AS (SELECT g AS source, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS nth, count(*) OVER () AS n FROM su)", "t0 AS (SELECT 0 AS g, nth, n, d FROM sn)"]
    ctes.append(f"q0 AS (SELECT doc_id, 0 AS g, leaf, sn.d AS subroot, f, p, sn.nth AS nth, sn.n AS n FROM p{depth} JOIN sn ON sn.source IS NOT DISTINCT FROM g)")
    tree("t", "q", top)
    ctes.append(f"ro AS ({ends('t', top)})")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, ro.d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = ro.d AS verified FROM q{top} CROSS JOIN ro"


SQL = _sql()
