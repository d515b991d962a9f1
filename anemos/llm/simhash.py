"""SimHash near-duplicates by a segment-popcount embedding (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anemos.llm._common import LOWER, SPACE, checkpointed, connected_components, labels_of, runs, text_slices, tiles, word_spans

# The primes of the XXH64 specification.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _rotl(acc + word * P2, 31) * P1


def xxh64(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buf[start : start + length] for arrays of starts and lengths."""
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    at8 = np.ndarray((len(buf) + 1,), "<u8", buffer=pad, strides=(1,)).copy()
    length = length.astype(np.int64)
    h = np.full(len(start), (seed + int(P5)) % 2**64, np.uint64)
    pos = start.astype(np.int64).copy()
    long = np.flatnonzero(length >= 32)
    if len(long):
        long = long[np.argsort(-length[long], kind="stable")]
        stripes = length[long] // 32
        lanes = [np.full(len(long), (seed + x) % 2**64, np.uint64) for x in (int(P1) + int(P2), int(P2), 0, -int(P1))]
        for s in range(int(stripes[0])):
            n = int(np.searchsorted(-stripes, -s, side="left"))
            p = pos[long[:n]] + 32 * s
            for k in range(4):
                lanes[k][:n] = _round(lanes[k][:n], at8[p + 8 * k])
        acc = sum(_rotl(v, r) for v, r in zip(lanes, (1, 7, 12, 18)))
        for v in lanes:
            acc = (acc ^ _round(np.zeros_like(v), v)) * P1 + P4
        h[long] = acc
        pos[long] += 32 * stripes
    h += length.astype(np.uint64)
    rest = length & 31
    for k in range(3):
        i = np.flatnonzero(rest >= 8 * (k + 1))
        if not len(i):
            break
        h[i] = _rotl(h[i] ^ _round(np.zeros(len(i), np.uint64), at8[pos[i]]), 27) * P1 + P4
        pos[i] += 8
    i = np.flatnonzero(rest & 4)
    h[i] = _rotl(h[i] ^ ((at8[pos[i]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    pos[i] += 4
    for k in range(3):
        i = np.flatnonzero((rest & 3) > k)
        h[i] = _rotl(h[i] ^ ((at8[pos[i]] & np.uint64(0xFF)) * P5), 11) * P1
        pos[i] += 1
    h ^= h >> np.uint64(33)
    h *= P2
    h ^= h >> np.uint64(29)
    h *= P3
    return h ^ (h >> np.uint64(32))


def fingerprints(buf: np.ndarray, offs: np.ndarray, shingle: int = 4) -> np.ndarray:
    """64-bit SimHash of each text of a slice, as signed integers."""
    out = np.zeros(len(offs) - 1, np.uint64)
    start, end, doc = word_spans(buf, offs)
    if not len(start):
        return out.view(np.int64)
    gap = SPACE[buf]
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]  # one separator after each word
    flat = np.where(gap, np.uint8(32), LOWER[buf])[keep]
    at = np.cumsum(keep) - 1
    start, end = at[start], at[end - 1] + 1
    n = np.bincount(doc, minlength=len(out))
    first = np.cumsum(n) - n
    here = np.arange(len(start)) - first[doc]
    head = (here + shingle <= n[doc]) | ((here == 0) & (n[doc] < shingle))
    i = np.flatnonzero(head)
    last = np.minimum(i + shingle, first[doc[i]] + n[doc[i]]) - 1
    h = xxh64(flat, start[i], end[last] - start[i])
    full = np.flatnonzero(n)
    per = np.maximum(n[full] - shingle + 1, 1)
    cut = np.cumsum(per) - per
    lanes = np.uint64(0x0000000100000001)
    for b in range(32):
        count = np.add.reduceat((h >> np.uint64(b)) & lanes, cut)
        low, high = count & np.uint64(0xFFFFFFFF), count >> np.uint64(32)
        out[full] |= (2 * low > per).astype(np.uint64) << np.uint64(b)
        out[full] |= (2 * high > per).astype(np.uint64) << np.uint64(b + 32)
    return out.view(np.int64)


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id_col, fp long): the SimHash of every text; 0 where it has no word."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprints(buf, offs, shingle) for _, _, buf, offs in text_slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0, np.int64), *fp]))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(per_batch, f"`{id_col}` {kind}, fp bigint")


def _near_in_tiles(radius: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, at in runs(batches, ["half", "cell", "tile_i", "tile_j"]):
            fp, block, same = cols["fp"].astype(np.uint64), cols["block"], cols["tile_i"] == cols["tile_j"]
            size = np.diff(np.append(at, len(fp)) if at[-1] != len(fp) else at)
            first = at[: len(size)]
            a, b = [], []
            two = first[size == 2]
            ok = (np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius) & (same[two] | (block[two] != block[two + 1]))
            a.append(fp[two[ok]])
            b.append(fp[two[ok] + 1])
            for lo, n in zip(first[size > 2], size[size > 2]):
                x = fp[lo : lo + n]
                near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
                root = labels_of(near)
                i = np.flatnonzero(root != np.arange(n))
                a.append(x[i])
                b.append(x[root[i]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["a", "b"])

    return of


def near_fingerprints(fps: DataFrame, radius: int = 4, most: int = 1024) -> DataFrame:
    """Links (a, b) that connect all fingerprints of `fps` (column fp, distinct) at `radius` or fewer differing bits.

    Embedding: the bit count of each of 32 two-bit segments, packed two bits each. Every differing bit moves one count by at
    most one, so the Manhattan distance of two embeddings never exceeds the Hamming distance. One of the two halves (16
    counts) then differs by radius // 2 at most; for a radius up to 5 that is 2, so both points lie within one step of a
    common grid cell. Each point is dealt to its own cell and those one step away in each half; points that meet in a cell
    are compared exactly. Cells with many points are cut into tiles, and a tile returns a forest of its links, not all pairs.
    """
    if not 0 <= radius <= 5:
        raise ValueError("radius must be 0 to 5")
    x = F.col("fp")
    odd = F.lit(0x55555555)
    bits = [x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)]
    half = [h.bitwiseAND(odd) + F.shiftright(h, 1).bitwiseAND(odd) for h in bits]

    def around(h):
        field = lambda i: F.shiftright(h, 2 * i).bitwiseAND(F.lit(3))
        steps = [F.when(field(i) < 2, h + F.lit(1 << 2 * i)) for i in range(16)] + [F.when(field(i) > 0, h - F.lit(1 << 2 * i)) for i in range(16)]
        return F.array_compact(F.array(h, *steps))

    spread = fps.repartition("fp")  # the points are few and become 66 rows each
    cells = spread.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("half"), around(half[k]).alias("cells")) for k in (0, 1)])).alias("s"))
    cells = cells.select("fp", "s.half", F.explode("s.cells").alias("cell"))
    keys = ["half", "cell", "tile_i", "tile_j"]
    tiled = tiles(cells, ["half", "cell"], "fp", most).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return tiled.select(*keys, "fp", "block").mapInArrow(_near_in_tiles(radius), "a bigint, b bigint").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """Near-duplicate groups of documents: (id_col, fp, fingerprint hex, component_id = smallest id reachable).

    Null and empty texts, and those of white space alone, have fingerprint zero and link like any other. Texts are taken
    whole. Copies are collapsed to one fingerprint before they are compared. Repeated ids give repeated rows. An empty table
    gives an empty result. Columns other than id_col and text_col are not read.
    """
    marked = checkpointed(simhash(docs, id_col, text_col, shingle))
    firsts = checkpointed(marked.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    comp = connected_components(near_fingerprints(firsts.select("fp"), radius))
    linked = firsts.join(comp.withColumnRenamed("node", "fp"), "fp")
    lowest = linked.groupBy("component").agg(F.min("first_id").alias("low"))
    moved = linked.join(lowest, "component").select("fp", "low")
    groups = checkpointed(firsts.join(moved, "fp", "left").select("fp", F.coalesce("low", "first_id").alias("component_id")))  # so that the join can split a common text's rows
    return marked.join(groups, "fp").select(id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, similarity: float | None = None) -> DataFrame:
    """The rows of docs that stay when one document of each group is kept, that with the smallest id; all columns pass.
    Rows without an id always stay; rows of one id are kept or go together.

    Groups are those of simhash_groups. With a `similarity`, documents are instead linked by the exact Jaccard similarity of their
    five-word shingles: SimHash within `radius` bits proposes pairs first, and the rarest shingles of each text all that lies further apart (see
    minhash.shingle_groups)."""
    if similarity is not None:
        from anemos.llm.minhash import shingle_dedup

        return shingle_dedup(docs, id_col, text_col, similarity, radius)
    gone = simhash_groups(docs, id_col, text_col, shingle, radius).where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
