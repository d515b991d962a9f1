"""Near-duplicates by the exact Jaccard similarity of their five-word shingles: what SimHash leaves over is found by the rarest shingles of each text,
of which similar texts share one for certain (the near-duplicate stage of the pipeline)."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anemos.llm._common import LOWER, SPACE, checkpointed, connected_components, labels_of, merged_components, runs, sized, stored, text_slices, tiles, word_spans
from anemos.llm.simhash import fingerprints, near_fingerprints, xxh64

#: Words of a shingle.
SHINGLE = 5
#: Buckets of shingle hashes that count how many texts hold them, and rows they are summed in. Counts only order shingles; any order finds the same pairs.
BUCKET_BITS, PARTS = 20, 16
#: Texts that share a shingle from which on they are compared in tiles instead of pair by pair.
CROWD = 64


def shingle_sets(buf: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE, digests: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, bounds, keys) of the texts of a slice: the sorted distinct hashes of each text's runs of `shingle` words (of all
    its words, if fewer), bounds of each text in them, and the halves of a 128-bit digest (BLAKE2) of each whole text. Words are lower-cased (ASCII) and
    white space between them doesn't count. A text without words has the one shingle 0. Without `digests`, keys are zero."""
    n_texts = len(offs) - 1
    h, doc, keys = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((n_texts, 2), np.uint64)
    start, end, owner = word_spans(buf, offs)
    n = np.bincount(owner, minlength=n_texts)
    if len(start):
        gap = SPACE[buf]
        keep = ~gap
        keep[1:] |= gap[1:] & ~gap[:-1]  # one separator after each word
        flat = np.where(gap, np.uint8(32), LOWER[buf])[keep]
        at = np.cumsum(keep) - 1
        start, end = at[start], at[end - 1] + 1
        first = np.cumsum(n) - n
        here = np.arange(len(start)) - first[owner]
        i = np.flatnonzero((here + shingle <= n[owner]) | ((here == 0) & (n[owner] < shingle)))
        doc = owner[i]
        last = np.minimum(i + shingle, first[doc] + n[doc]) - 1
        h = xxh64(flat, start[i], end[last] - start[i], 7)
        for t in np.flatnonzero(n) if digests else ():
            keys[t] = np.frombuffer(hashlib.blake2b(flat[start[first[t]] : end[first[t] + n[t] - 1]], digest_size=16).digest(), np.uint64)
    empty = np.flatnonzero(n == 0)
    h, doc = np.concatenate([h, np.zeros(len(empty), np.uint64)]), np.concatenate([doc, empty])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(n_texts + 1)), keys


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def bucket_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """How many texts hold the shingles of each bucket, over all texts. A task sums its own; what reaches the driver is a number a bucket."""
    width = (1 << BUCKET_BITS) // PARTS

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for _, _, buf, offs in text_slices(batch.column(0)):
                counts += np.bincount(_bucket(shingle_sets(buf, offs, digests=False)[0]), minlength=1 << BUCKET_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array([zlib.compress(counts[i * width : (i + 1) * width].tobytes(), 1) for i in range(PARTS)], pa.binary())], names=["part", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[part] = total.get(part, 0) + np.frombuffer(zlib.decompress(packed.as_buffer()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])

    sums = docs.select(text_col).mapInArrow(per_task, "part int, counts binary").repartition(PARTS, "part").mapInArrow(summed, "part int, counts binary")
    out = np.zeros((PARTS, width), np.uint32)
    for part, counts in sums.toLocalIterator():
        out[part] = np.frombuffer(counts, np.uint32)
    return out.ravel()


def prefixes(h: np.ndarray, bounds: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): of each set of hashes the first, in one order of all hashes (those of small buckets first): one more than a set may have beside what it
    shares with a similar one. Two similar sets have one in common, which is the first of all they share: if they share o of the n hashes of one, o is
    `similarity` x n at least, so the n - o others are fewer than that set's first hashes; the same holds for the other set."""
    n = np.diff(bounds)
    first = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
    h = h[np.lexsort((h, counts[_bucket(h)], np.repeat(np.arange(len(n)), n)))]
    place = np.arange(len(h)) - np.repeat(bounds[:-1], n)
    return h[place < np.repeat(first, n)], np.concatenate([np.zeros(1, np.int64), np.cumsum(first)])


def marked_texts(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(node, h0, h1, size, fp, cells): id, two hashes, number of shingles, SimHash and first shingles (see prefixes) of every text."""
    kind = docs.schema[id_col].dataType.simpleString()
    counts = bucket_counts(docs, text_col)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch.column(1)):
                h, bounds, keys = shingle_sets(buf, offs)
                first, ends = prefixes(h, bounds, counts, similarity)
                cols = [keys[:, 0], keys[:, 1], np.diff(bounds), fingerprints(buf, offs, SHINGLE)]
                nested = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(first.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in cols], nested], names=["node", "h0", "h1", "size", "fp", "cells"])

    return docs.select(id_col, text_col).mapInArrow(per_batch, f"node {kind}, h0 bigint, h1 bigint, size bigint, fp bigint, cells array<bigint>")


def hashed_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles): id and distinct shingle hashes of every text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch.column(1)):
                h, bounds, _ = shingle_sets(buf, offs, digests=False)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))], names=["node", "shingles"])

    return docs.select(id_col, text_col).mapInArrow(per_batch, f"node {kind}, shingles array<bigint>")


#: What stands for a text; rows of cells carry the place of their shingle among the text's own, too.
TEXT = ("node", "part", "size")
PLACED = (*TEXT, "at")


def _gated(ma: str, mb: str, similarity: float, placed: bool = True):
    """Whether two texts of different parts may be similar by their sizes; or, if `placed`, by what their sets have from a shared shingle on if it is the first
    that they share. Similar texts meet in that one too."""
    a, b = F.col(f"{ma}.size"), F.col(f"{mb}.size")
    most = 1 + F.least(a - 1 - F.col(f"{ma}.at"), b - 1 - F.col(f"{mb}.at")) if placed else F.least(a, b)
    return (F.col(f"{ma}.part") != F.col(f"{mb}.part")) & (most * (1 + similarity) >= similarity * (a + b) - 1e-9)


def _ends(ma: str, mb: str) -> list:
    """The texts and the parts of a pair, each in order."""
    return [f(f"{ma}.{c}", f"{mb}.{c}").alias(f"{name}_{c}") for f, name in ((F.least, "low"), (F.greatest, "high")) for c in ("node", "part")]


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the parts of the pairs whose exact Jaccard similarity reaches `similarity`. Shingles are fetched for these pairs only."""
    near = checkpointed(pairs.distinct())
    if near.isEmpty():
        return near.select(F.col("low_part").alias("a"), F.col("high_part").alias("b"))
    some = sets.join(sized(checkpointed(near.select(F.explode(F.array("low_node", "high_node")).alias("node")).distinct())), "node", "left_semi")
    side = lambda s, m: some.select(F.col("node").alias(s), F.col("shingles").alias(m))
    both = near.join(side("low_node", "ma"), "low_node").join(side("high_node", "mb"), "high_node")
    same = both.where(F.size(F.array_intersect("ma", "mb")) * (1 + similarity) >= similarity * (F.size("ma") + F.size("mb")) - 1e-9)
    return checkpointed(same.select(F.col("low_part").alias("a"), F.col("high_part").alias("b")).distinct())


def _close(one: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Pairs that connect all texts whose SimHashes differ in at most `radius` bits, if their sizes allow the similarity."""
    text = F.struct(*TEXT)
    firsts = checkpointed(one.groupBy("fp").agg(F.min(text).alias("first")))
    end = lambda s: firsts.select(F.col("fp").alias(s), F.col("first").alias(f"m{s}"))
    links = near_fingerprints(firsts.select("fp"), radius).join(end("a"), "a").join(end("b"), "b").select("ma", "mb")
    links = links.unionByName(one.join(firsts, "fp").where("node <> first.node").select(F.col("first").alias("ma"), text.alias("mb")))
    return links.where(_gated("ma", "mb", similarity, False)).select(*_ends("ma", "mb"))


def _parted(left: DataFrame, parts: DataFrame) -> DataFrame:
    """left with what each part has become, as `parts` (node, component) joins them; only cells of several parts."""
    grown = parts.select(F.col("node").alias("part"), F.col("component").alias("grown"))
    rows = left.join(grown, "part", "left").withColumn("part", F.coalesce("grown", "part")).drop("grown")
    mixed = checkpointed(rows.groupBy("cell").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("cell"))
    return checkpointed(rows.join(mixed, "cell"))


def _to_hubs(left: DataFrame, salt: int, hubs: int, similarity: float) -> DataFrame:
    """The texts of each cell next to one of them, where they aren't connected yet and sizes and places allow the similarity. Which one changes
    with the cell, among `hubs` of a group that shares all cells. As many rows as `left` at most."""
    by = F.xxhash64("node", F.pmod(F.col("cell"), F.lit(hubs)), F.lit(salt))
    text = F.struct(*PLACED)
    hub = checkpointed(left.groupBy("cell").agg(F.min(F.struct(by.alias("by"), text.alias("text"))).alias("hub")).select("cell", F.col("hub.text").alias("mb")))
    return left.select("cell", text.alias("ma")).join(hub, "cell").where(_gated("ma", "mb", similarity)).select(*_ends("ma", "mb"))


def _to_all(left: DataFrame, crowded: DataFrame, similarity: float) -> DataFrame:
    """All texts of a cell next to each other, where they aren't connected yet and sizes and places allow the similarity, but for crowded cells."""
    rows = left.join(crowded, "cell", "left_anti").select("cell", F.struct(*PLACED).alias("text"))
    l, r = rows.withColumnRenamed("text", "ma"), rows.withColumnRenamed("text", "mb")
    return l.join(r, "cell").where((F.col("ma.node") < F.col("mb.node")) & _gated("ma", "mb", similarity)).select(*_ends("ma", "mb"))


def _in_crowds(left: DataFrame, sets: DataFrame, crowded: DataFrame, similarity: float, most: int = 512) -> DataFrame:
    """(a, b): links between the parts of what is similar among the texts of crowded cells. Texts that such cells connect are dealt to tiles of at
    most about 2 x `most`, each pair to one; a tile counts the shingles that its texts share, as products of matrices some
    thousand shingles wide, and returns a forest, not pairs."""
    edges = left.join(crowded, "cell").where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    crowd = connected_components(edges, at_once=True).withColumnRenamed("component", "crowd")
    rows = left.select("node", "part").distinct().join(checkpointed(crowd), "node").join(sets, "node")
    keys = ["crowd", "tile_i", "tile_j"]
    tiled = tiles(rows, ["crowd"], "node", most).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    kind = dict(left.dtypes)["node"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, at in runs(batches, keys):
            ends = np.append(at[1:], len(cols["part"])) if at[-1] != len(cols["part"]) else at[1:]
            for lo, hi in zip(at, ends):
                part, block = (cols[c][lo:hi] for c in ("part", "block"))
                shared, size = shared_counts(cols["shingles"].slice(int(lo), int(hi - lo)))
                near = shared * (1 + similarity) >= similarity * (size[:, None] + size[None, :]) - 1e-9
                near &= part[:, None] != part[None, :]
                if cols["tile_i"][lo] != cols["tile_j"][lo]:
                    near &= block[:, None] != block[None, :]
                root = labels_of(near)
                i = np.flatnonzero(root != np.arange(len(root)))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(part[root[i]]), pa.array(part[i])], names=["a", "b"])

    return checkpointed(tiled.select(*keys, "part", "block", "shingles").mapInArrow(judge, f"a {kind}, b {kind}").distinct())


def shared_counts(sets: pa.Array, width: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(texts x texts) number of shingles that two texts share, and each text's number. A text's shingles are distinct."""
    size = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    n, text = len(size), np.repeat(np.arange(len(size)), size)
    _, which, times = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1  # shingles of one text alone are left out
    kept = times[which] > 1
    text, which = text[kept], rank[which[kept]]
    order = np.argsort(which, kind="stable")
    text, which = text[order], which[order]
    shared = np.zeros((n, n), np.float32)
    for lo in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        some = slice(*np.searchsorted(which, [lo, lo + width]))
        has = np.zeros((n, width), np.float32)
        has[text[some], which[some] - lo] = 1
        shared += has @ has.T
    return shared, size


def shingle_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, radius: int = 4) -> tuple[DataFrame, DataFrame]:
    """(firsts, groups): `firsts` (node, first) names each document's text by the smallest id that has it; `groups` (node, component) are
    those of them that pairs connect whose shingle sets have a Jaccard similarity of at least `similarity` (0.8 or more).

    Pairs to be compared come from SimHash first (fingerprints within `radius` bits). Then texts that share one of their first shingles (cells, see prefixes) are
    compared with some of the cell's, twice, and at last with all others where that hasn't connected them yet; so a large group of near
    copies takes few comparisons a member, and no pair is left out. Links found later are links between the parts that those before have made. Cells of one text
    alone are dropped; rows of cells are shuffled once for that."""
    if not 0.8 <= similarity <= 1:
        raise ValueError("similarity must be 0.8 to 1; near copies are connected for it")
    marked = stored(marked_texts(docs, id_col, text_col, similarity), "shingles-first")
    firsts = checkpointed(marked.groupBy("h0", "h1").agg(F.min("node").alias("node")))
    one = checkpointed(marked.join(firsts, ["h0", "h1", "node"]).dropDuplicates(["h0", "h1", "node"]).select("node", F.col("node").alias("part"), "size", "fp", "cells"))
    cells = one.select("node", "part", "size", F.posexplode("cells").alias("at", "cell")).repartition("cell")
    shared = cells.groupBy("cell").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("cell")
    met = checkpointed(cells.join(shared.hint("shuffle_hash"), "cell").select("cell", *PLACED))
    wanted = met.select(F.col("node").alias("wanted_node")).distinct()
    picked = docs.select(id_col, text_col).join(wanted, F.col(id_col) == F.col("wanted_node"), "left_semi")
    sets = stored(hashed_sets(picked, id_col, text_col).distinct(), "shingles")
    groups = connected_components(_similar(_close(one, radius, similarity), sets, similarity), at_once=True)
    left = _parted(met, groups)
    for salt, hubs in enumerate((8, 1 << 40)):
        more = connected_components(_similar(_to_hubs(left, salt, hubs, similarity), sets, similarity), at_once=True)
        groups, left = merged_components(groups, more), _parted(left, more)
    crowded = checkpointed(left.groupBy("cell").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") > CROWD).select("cell", "low"))
    links = _similar(_to_all(left, crowded.select("cell"), similarity), sets, similarity)
    if not crowded.isEmpty():
        links = links.unionByName(_in_crowds(left, sets, crowded, similarity))
    return marked.join(firsts.withColumnRenamed("node", "first"), ["h0", "h1"]).select("node", "first"), merged_components(groups, connected_components(links, at_once=True))


def shingle_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """The rows of docs that stay when one document of each group is kept, that with the smallest id; all columns pass. A group
    is connected by pairs of documents whose five-word shingles have a Jaccard similarity of at least `similarity`. Texts without
    words are copies of each other. Rows without an id always stay and count for nothing; rows of one id are kept or go together.
    An empty table gives an empty result."""
    firsts, groups = shingle_groups(docs.where(F.col(id_col).isNotNull()), id_col, text_col, similarity, radius)
    comp = groups.withColumnRenamed("node", "first")
    gone = firsts.join(comp, "first", "left").where(F.col("node") != F.coalesce("component", "first")).select(F.col("node").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
