"""Near-duplicate embeddings by collision-counting projections (operator 1)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anemos.llm._common import checkpointed, connected_components, labels_of, runs, tiles

#: Directions of a rotation at most.
AXES = 64
#: Pairs that a task emits at once.
PAIRS = 1 << 18


def calibrated_count(projections: int, p: float, miss: float) -> int:
    """Largest count that a pair at the threshold reaches in all but a share `miss` of cases, if it collides in each of `projections`
    lists with probability p."""
    below = 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            return count
    return projections


def lists_needed(p: float, need: int, miss: float) -> int:
    """Fewest lists of which a pair at the threshold meets in `need` or more, in all but a share `miss` of cases."""
    lists = need
    while calibrated_count(lists, p, miss) < need:
        lists += 1
    return lists


def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """count x dim x axes: random orthonormal directions, scaled so that a unit vector's components have variance 1."""
    rng = np.random.default_rng([seed, dim])
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :AXES] * math.sqrt(dim) for _ in range(count)]).astype(np.float32)


def furthest(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector, the direction (with its sign) on which it projects furthest, and how far."""
    y = x @ turn
    axis = np.abs(y).argmax(1)
    value = y[np.arange(len(y)), axis]
    return 2 * axis + (value < 0), np.abs(value)


def collision_rate(dim: int, cosine: float, turns: int, window: float, seed: int, trials: int = 20000) -> float:
    """How often two vectors at the threshold agree in their furthest direction of each of `turns` rotations and lie within the window
    on the first, by simulation; a little less than was found. The rotations are random, so this holds for any two such vectors."""
    rng = np.random.default_rng([seed, dim, 1])
    x, z = rng.standard_normal((2, trials, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y = cosine * x + math.sqrt(1 - cosine**2) * z
    met = np.ones(trials, bool)
    for k, turn in enumerate(rotations(dim, turns, seed + 1)):
        (a, u), (b, v) = furthest(x.astype(np.float32), turn), furthest(y.astype(np.float32), turn)
        met &= a == b
        if not k:
            met &= np.abs(u - v) <= window * math.sqrt(dim)
    p = met.mean()
    return float(max(0.01, p - 4 * math.sqrt(max(p * (1 - p), 1e-4) / trials)))


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_links(reps: DataFrame, cosine: float = 0.98, width: float = 2.0, need: int = 2, miss: float = 1e-7, most: int = 1024, seed: int = 11) -> DataFrame:
    """(id, links, root): for each distinct vector of reps (id, label, vector, copies) that links in some tile: copies linked
    there, and the smallest id linked through that tile.

    Two unit vectors with cosine c lie r = sqrt(2 - 2c) apart; their projections on a direction differ by about r / sqrt(dim). A vector
    stands in the list of the direction of a random rotation on which it projects furthest (of several rotations' directions jointly, as many as keep
    lists short for the number of vectors). Lists are sorted by the projection; a collision is another vector of the list
    within the window of width x r / sqrt(dim) around the query's value. Collisions are counted per pair over all lists, and a pair is
    verified by its exact cosine if it has `need` or more. The number of lists is calibrated so that of pairs at the threshold at
    most a share `miss` has fewer. Lists of more than `most` entries are cut into tiles, so no list is gathered in one task.
    """
    radius = math.sqrt(max(2 - 2 * cosine, 0.0)) * (1 + 1e-5)
    sizes = reps.groupBy("label", F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n").alias("n")).collect()  # one row for each dimension
    plans = {}
    for r in sizes:
        axes = 2 * min(int(r["dim"]), AXES)
        turns = max(1, min(4, math.ceil(math.log(max(int(r["n"]), 2)) / math.log(axes)))) if axes > 2 else 1
        rate = collision_rate(int(r["dim"]), cosine, turns, width * radius / math.sqrt(r["dim"]), seed)
        plans[int(r["dim"])] = turns, lists_needed(rate, need, miss)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x, dims = _unit(part.column(2))
                ids, lab = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                for dim in np.unique(dims):
                    rows = np.flatnonzero(dims == dim)
                    turns, lists = plans[int(dim)]
                    if dim not in held:
                        held[dim] = rotations(int(dim), turns * lists, seed)
                    y = x[rows, : int(dim)].astype(np.float32)
                    for k in range(lists):
                        key, first = np.full(len(rows), k, np.int64), None
                        for turn in held[dim][k * turns : (k + 1) * turns]:
                            axis, value = furthest(y, turn)
                            key, first = key * (2 * AXES) + axis, value if first is None else first
                        yield pa.RecordBatch.from_arrays([pa.array(lab[rows]), pa.array(key), pa.array(first), pa.array(ids[rows])], names=["lab", "list", "value", "id"])

    lab = F.xxhash64(F.col("label").cast("string"), F.size("vector"))
    entries = reps.select("id", lab.alias("lab"), "vector").mapInArrow(place, "lab bigint, list bigint, value float, id bigint")
    keys = ["lab", "list", "tile_i", "tile_j"]
    tiled = tiles(entries, ["lab", "list"], "id", most).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "value").select(*keys, "value", "id", "block")
    windows = {dim: np.float32(width * radius) for dim in plans}
    window = max(windows.values(), default=np.float32(0))  # values are scaled by sqrt(dim)

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, at in runs(batches, keys):
            n = len(cols["id"])
            group = np.zeros(n, np.int64)
            group[at[at < n]] = 1
            group = np.cumsum(group)
            value = cols["value"].astype(float)
            span = value.max() + 2 * window + 1 if n else 1
            line = group * span + value  # lists one after the other, further apart than a window
            last = np.searchsorted(line, line + window, side="right")
            count = last - np.arange(n) - 1
            done = np.cumsum(count)
            lo = 0
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, side="right")))
                i = np.repeat(np.arange(lo, hi), count[lo:hi])
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count[lo:hi]) - count[lo:hi], count[lo:hi])
                ok = (cols["tile_i"][i] == cols["tile_j"][i]) | (cols["block"][i] != cols["block"][j])
                a, b = cols["id"][i[ok]], cols["id"][j[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
                lo = hi

    met = tiled.mapInArrow(collide, "a bigint, b bigint").groupBy("a", "b").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= need)
    return verified(reps.withColumn("lab", lab), met, cosine, most)


def verified(reps: DataFrame, pairs: DataFrame, cosine: float, most: int) -> DataFrame:
    """(id, links, root) of the pairs whose cosine reaches the threshold. Vectors are dealt to blocks of about `most` of a label; a task
    verifies the pairs of two blocks and is sent only the vectors that such a pair names, each once."""
    counts = reps.groupBy("lab").agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).alias("blocks"))
    home = reps.join(counts, "lab").select("id", "lab", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("home"))
    ends = lambda s: home.select(F.col("id").alias(s), "lab", F.col("home").alias(f"h{s}"))
    placed = pairs.join(ends("a"), "a").join(ends("b").drop("lab"), "b")
    placed = checkpointed(placed.select("a", "b", F.xxhash64("lab", F.least("ha", "hb"), F.greatest("ha", "hb")).alias("tile")))
    named = placed.select(F.col("tile").alias("of_tile"), F.explode(F.array("a", "b")).alias("id")).distinct()
    sent = named.join(reps.select("id", "vector", "copies"), "id").select("of_tile", "id", "vector", "copies")

    def judge(vectors: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        ids = vectors["id"].to_numpy()
        order = np.argsort(ids)
        a, b = (order[np.searchsorted(ids[order], pairs[c].to_numpy())] for c in ("a", "b"))
        x, _ = _unit(pa.array(vectors["vector"]))
        same = np.zeros(len(a), bool)
        for k in range(0, len(a), 1 << 14):
            same[k : k + (1 << 14)] = np.einsum("ij,ij->i", x[a[k : k + (1 << 14)]], x[b[k : k + (1 << 14)]]) >= cosine
        a, b = np.concatenate([a[same], b[same]]), np.concatenate([b[same], a[same]])
        linked = np.unique(a)
        links = np.bincount(a, weights=vectors["copies"].to_numpy()[b], minlength=len(ids))[linked].astype(np.int64)
        small = np.zeros((len(linked), len(linked)), bool)
        small[np.searchsorted(linked, a), np.searchsorted(linked, b)] = True
        by_id = np.argsort(ids[linked])  # the smallest id stands for a group
        root = np.empty(len(linked), np.int64)
        root[by_id] = ids[linked][by_id][labels_of(small[np.ix_(by_id, by_id)])] if len(linked) else 0
        return pd.DataFrame({"id": ids[linked], "links": links, "root": root})

    return sent.groupBy("of_tile").cogroup(placed.groupBy("tile")).applyInPandas(judge, "id bigint, links bigint, root bigint")


def _unit(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, padded with zeros where dimensions differ, and the dimensions."""
    dims = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = np.zeros((len(dims), int(dims.max()) if len(dims) else 0))
    x[np.repeat(np.arange(len(dims)), dims), np.arange(len(flat)) - np.repeat(np.cumsum(dims) - dims, dims)] = flat
    x /= np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True), dims


def vector_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row: other rows of the same label whose cosine reaches the threshold, the
    smallest id reachable by links, and whether that is the row's own.

    Vectors that are null, empty, zero or hold a null or non-finite component, and those without a label or an id, link with nothing;
    neither do vectors of different dimensions. Equal vectors of a label are compared once and counted as often as they
    occur. Ids are integers and name one vector each; rows that repeat id and vector are each other's copies. Extra columns
    are not read, and an empty table gives an empty result."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    fit = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    good = rows.where(fit)
    reps = checkpointed(good.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
    links = checkpointed(vector_links(reps, **options))
    comp = connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    sums = links.groupBy("id").agg(F.sum("links").alias("links"))
    info = reps.join(sums, "id", "left").join(comp, "id", "left").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    found = good.join(checkpointed(info), ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where(~fit).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return found.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
