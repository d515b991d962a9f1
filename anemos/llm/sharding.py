"""Sharding by a k-d tree over metadata (operator 3). DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anemos.llm._common import Aside, checkpointed

BUCKETS = 512


@dataclass
class Node:
    """A node of the tree: either a leaf (shard) or a cut. A row goes left if it isn't above the cut's (column, value) pairs
    in lexicographic order."""

    leaves: int
    weight: int = 0
    shard: int = -1
    cut: tuple[tuple[str, int], ...] = ()
    left: Node | None = None
    right: Node | None = None


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text plus one; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _goes_left(cut: tuple[tuple[str, int], ...]) -> Column:
    col, value = cut[0]
    if len(cut) == 1:
        return F.col(col) <= F.lit(value)
    return (F.col(col) < F.lit(value)) | ((F.col(col) == F.lit(value)) & _goes_left(cut[1:]))


def place(node: Node) -> Column:
    """Shard of a row, as one nested CASE expression."""
    return F.lit(node.shard) if node.left is None else F.when(_goes_left(node.cut), place(node.left)).otherwise(place(node.right))


class _Search:
    """The weighted median of one node: narrows [low, high] of one key column after another, until the rows still in
    question weigh next to nothing."""

    def __init__(self, node: Node, keys: list[str], inside: Column, span: tuple[int, int], tolerance: float):
        self.node, self.keys, self.inside = node, keys, inside
        self.tied: list[tuple[str, int]] = []
        self.low, self.high = span
        self.goal = node.weight * (node.leaves // 2) / node.leaves
        self.below, self.slack = 0, max(1.0, tolerance * node.weight / node.leaves)
        self.done = False

    def rows(self) -> Column:
        here = self.inside
        for col, value in self.tied:
            here = here & (F.col(col) == F.lit(value))
        key = F.col(self.keys[0])
        return here & key.between(F.lit(self.low), F.lit(self.high)) if self.low <= self.high else here

    def bucket(self) -> Column:
        if self.low > self.high:
            return F.lit(0)
        span = max(float(self.high) - float(self.low), 1.0)
        return F.least(F.lit(BUCKETS - 1), F.floor((F.col(self.keys[0]).cast("double") - F.lit(float(self.low))) / F.lit(span) * BUCKETS).cast("int"))

    def narrow(self, found: list) -> None:
        """found: (weight, min, max) of each bucket, in order."""
        at = self.below
        for weight, low, high in found:
            if at + weight >= self.goal or (weight, low, high) == found[-1]:
                break
            at += weight
        same = (low, high) == (self.low, self.high)
        self.low, self.high = low, high
        if weight <= self.slack or (low == high or same) and len(self.keys) == 1:
            whole = self.goal - at > at + weight - self.goal  # the last rows go to the nearer side
            end = high if whole else low - 1
            self.node.cut = (*self.tied, (self.keys[0], end))
            self.done = True
        elif low == high or same:
            self.tied.append((self.keys[0], low))
            self.keys, self.low, self.high = self.keys[1:], 1, 0
        self.below = at


def build_tree(rows: DataFrame, weight: str, dims: list[str], ties: list[str], leaves: int, tolerance: float = 0.001) -> Node:
    """Split `rows` (integer columns without nulls) into `leaves` leaves of near equal weight. A node is cut along the
    dimension in which it is widest, relative to all rows, at its weighted median; rows that tie there are cut by the columns
    `ties`. Medians of all nodes of a level are sought together: each round sums weights in at most 512 buckets a node with
    partial aggregates, and only those sums reach the driver."""
    names = list(dict.fromkeys([*dims, *ties]))
    root = Node(leaves)
    level = [(root, F.lit(True))]
    whole: dict[str, int] | None = None
    while level := [(n, c) for n, c in level if n.leaves > 1]:
        label = F.coalesce(*[F.when(c, F.lit(i)) for i, (_, c) in enumerate(level)])
        spans = {r["node"]: r for r in rows.groupBy(label.alias("node")).agg(F.sum(weight).alias("w"), *[f(c).alias(f"{s}_{c}") for c in names for s, f in (("min", F.min), ("max", F.max))]).where("node is not null").collect()}
        if whole is None:
            whole = {d: max(1, (spans[0][f"max_{d}"] - spans[0][f"min_{d}"]) if 0 in spans else 1) for d in dims}
        searches = []
        for i, (node, cond) in enumerate(level):
            if i not in spans:
                node.cut = ((names[0], 0),)
                continue
            r = spans[i]
            node.weight = r["w"]
            widest = max(dims, key=lambda d: ((r[f"max_{d}"] - r[f"min_{d}"]) / whole[d], -dims.index(d)))
            keys = [widest, *[t for t in ties if t != widest]]
            searches.append(_Search(node, keys, cond, (r[f"min_{widest}"], r[f"max_{widest}"]), tolerance))
        while open_ := [s for s in searches if not s.done]:
            which = F.coalesce(*[F.when(s.rows(), F.struct(F.lit(i).alias("search"), s.bucket().alias("bucket"), F.col(s.keys[0]).alias("key"))) for i, s in enumerate(open_)])
            sums = rows.select(which.alias("s"), weight).where("s is not null").groupBy("s.search", "s.bucket").agg(F.sum(weight).alias("w"), F.min("s.key").alias("low"), F.max("s.key").alias("high")).collect()
            for i, s in enumerate(open_):
                s.narrow([(r["w"], r["low"], r["high"]) for r in sorted((r for r in sums if r["search"] == i), key=lambda r: r["bucket"])])
        after = []
        for node, cond in level:
            node.left, node.right = Node(node.leaves // 2), Node(node.leaves - node.leaves // 2)
            left = _goes_left(node.cut)
            after += [(node.left, cond & left), (node.right, cond & ~left)]
        level = after
    _number(root, 0)
    return root


def _number(node: Node, first: int) -> int:
    if node.left is None:
        node.shard = first
        return first + 1
    return _number(node.right, _number(node.left, first))


def kd_shards(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("n_chars",), labels: tuple[str, ...] = ("lang",), keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default: all) plus size (UTF-8 bytes + 1), text_crc32, shard (from 0) and slot (gapless from
    0 in each shard), which replace input columns of these names. Shard sizes are near equal.

    The tree's dimensions are the size, the numbers `dims` and digests of the strings `labels`, as far as docs has them; a
    null counts as -1. Rows that tie on the cut dimension are parted by the text's CRC, then by the id's digest, then by the
    id, so equal texts stay together unless a cut falls within them; rows alike in all these can't be parted. Leaves are
    split until they reach target_bytes, if that is given instead of `shards`. An empty table gives an empty result.

    Only (size, checksum, dimensions) of each row are written for the search. Slots: rows of a shard are dealt to sub-buckets
    by id digest, numbered within each, and offset by the counts before. By default all dimensions follow from the text, which
    keeps equal texts together; a further label such as the source would part them.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give shards or target_bytes")
    wanted = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "text_crc32", "shard", "slot")]
    aside = Aside(docs, [id_col, text_col, *dims, *labels], wanted)
    docs, kept = aside.docs, [c for c in aside.docs.columns if c in wanted or c == aside.name]
    text = F.col(f"`{text_col}`")
    meta = {"_size": text_bytes(text), "_crc": text_crc(text), "_idh": F.xxhash64(id_col), "_id": F.coalesce(F.col(id_col).cast("long") if dict(docs.dtypes)[id_col] != "string" else F.crc32(F.col(id_col)), F.lit(-1))}
    meta |= {f"_n{i}": F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(-1)) for i, c in enumerate(dims) if c in docs.columns}
    meta |= {f"_s{i}": F.coalesce(F.crc32(F.col(f"`{c}`").cast("binary")), F.lit(-1)) for i, c in enumerate(labels) if c in docs.columns}
    own = ["_size", *[c for c in meta if c[:2] in ("_n", "_s") and c != "_size"]]
    slim = [c for c in kept if c != text_col]
    if text_col in kept:
        rows = checkpointed(docs.select(*[v.alias(k) for k, v in meta.items()]))
    else:
        rows = checkpointed(docs.select(*[F.col(f"`{c}`") for c in slim], *[v.alias(k) for k, v in meta.items()]))
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("bytes")).first()
    if shards is None:
        shards = max(1, -(-(totals["bytes"] or 0) // target_bytes))
    tree = build_tree(rows, "_size", own, ["_crc", "_idh", "_id"], shards)
    base = docs.select(*[F.col(f"`{c}`") for c in kept], *[v.alias(k) for k, v in meta.items()]) if text_col in kept else rows
    buckets = max(1, totals["n"] // (shards * 4000))
    placed = base.withColumn("shard", place(tree)).withColumn("_bucket", F.pmod("_idh", F.lit(buckets)).cast("int"))
    small = rows.select(place(tree).alias("shard"), F.pmod("_idh", F.lit(buckets)).cast("int").alias("_bucket"))
    counts = small.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_count"))
    before = counts.select("shard", "_bucket", (F.sum("_count").over(W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("_count")).alias("_before"))
    here = F.row_number().over(W.partitionBy("shard", "_bucket").orderBy("_idh", "_id", "_crc", "_size"))
    out = placed.withColumn("_here", here).join(before, ["shard", "_bucket"])
    return out.select(*aside.back(), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", (F.col("_before") + F.col("_here") - 1).cast("long").alias("slot"))
