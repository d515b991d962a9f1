"""Helpers shared by the training-data operators: checkpoints, Arrow text slices, runs of sorted keys, components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes that separate words: space, tab, LF, VT, FF, CR.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: ASCII lower-casing of A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII bytes that are neither letters nor digits; between words of letters, digits and other characters.
NOT_ALNUM = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what spark.checkpoint.dir names. Where it names none, a temporary folder serves a
    session that runs on one machine; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="anemos-"))
    return sc._jsc.sc().getCheckpointDir().get()


_freed = 0.0


def freed(spark: SparkSession) -> None:
    """Let the driver give up what nothing refers to any more, every few seconds at most: Spark removes shuffle files (and, if told to, checkpoints) when their
    handles are collected, which a driver with free memory puts off, while rounds of joins fill the disks."""
    global _freed
    if time.monotonic() - _freed > 3:
        gc.collect()
        time.sleep(1.1)  # a thread of py4j tells the JVM every second what Python has let go
        spark.sparkContext._jvm.System.gc()
        _freed = time.monotonic()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the cluster's checkpoint folder and read it back, so that a lost executor costs no recomputation of what
    lies before."""
    spark = df.sparkSession
    shared_folder(spark)
    out = df.checkpoint()
    del df  # or what it was made from would be kept until the next call
    freed(spark)
    return out


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offs


def text_slices(col: pa.Array, most: int = 1 << 20, rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive whole texts: at most `rows`, of about `most` bytes together, or one text."""
    if not len(col):
        return
    buf, offs = text_buffer(col)
    lo = 0
    while lo < len(col):
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1))
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; words are runs of bytes that are not `between` words (white space) and never cross texts."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    gap = between[buf]
    before, after = np.empty_like(gap), np.empty_like(gap)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    full = offs[1:] > offs[:-1]
    before[offs[:-1][full]] = True
    after[offs[1:][full] - 1] = True
    start = np.flatnonzero(~gap & before)
    end = np.flatnonzero(~gap & after) + 1
    return start, end, np.searchsorted(offs[1:], start, side="right")


def words_of(buf: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACE) -> tuple[pa.Array, np.ndarray]:
    """The words of a slice as an array of binary values, and the text number of each."""
    start, end, doc = word_spans(buf, offs, between)
    ends = np.concatenate([np.zeros(1, np.int32), np.cumsum(end - start, dtype=np.int32)])
    kept = np.ascontiguousarray(buf[~between[buf]] if len(buf) else buf)
    return pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(kept)]), doc


def binaries(buf: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values: the bytes of buf between consecutive bounds."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int32)), pa.py_buffer(np.ascontiguousarray(buf).view(np.uint8))])


class Aside:
    """Columns that an operator doesn't read, put into one struct whose name no column has, so that none of their names can meet one of the operator's own."""

    def __init__(self, docs: DataFrame, used: list[str], kept: list[str] | None = None):
        self.columns = docs.columns if kept is None else kept
        self.rest = [c for c in self.columns if c not in used]
        self.name = free_name(docs.columns, "aside")
        named = [F.col(f"`{c}`") for c in dict.fromkeys(used) if c in docs.columns]
        self.docs = docs.select(*named, F.struct(*[F.col(f"`{c}`") for c in self.rest]).alias(self.name)) if self.rest else docs.select(*named)

    def back(self, columns: list[str] | None = None) -> list[Column]:
        """The columns as they were, to be selected from what the operator made of `docs`."""
        return [(F.col(self.name)[c] if c in self.rest else F.col(f"`{c}`")).alias(c) for c in (self.columns if columns is None else columns)]


def free_name(taken: list[str], like: str) -> str:
    """A column name that none of `taken` is, whatever its case."""
    lower = {c.lower() for c in taken}
    while like.lower() in lower:
        like = f"_{like}"
    return like


def places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


#: The table of CRC-32 (reflected polynomial 0xEDB88320), made from its rule.
CRC_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC_TABLE = np.where(CRC_TABLE & 1, np.uint32(0xEDB88320) ^ (CRC_TABLE >> 1), CRC_TABLE >> 1).astype(np.uint32)


def crc32s(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of a byte array: a byte of all spans at a time, those of over 64 bytes one by one."""
    length = end - start
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(-length, kind="stable")
    order = order[int(np.searchsorted(-length[order], -64, side="left")) :]
    at, n, state = start[order], -length[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(-n[0]) if len(n) else 0):
        m = int(np.searchsorted(n, -k, side="left"))
        state[:m] = CRC_TABLE[(state[:m] ^ buf[at[:m] + k]) & 0xFF] ^ (state[:m] >> np.uint32(8))
    out[order] = ~state
    for i in np.flatnonzero(length > 64):
        out[i] = zlib.crc32(buf[start[i] : end[i]])
    return out


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with `name`, their number from 1 in the order given, without a window over all rows: they are sorted in ranges, numbered within
    each, and each range's first number follows from the counts of those before. Rows equal in order are numbered as they lie in a written
    table, which also parts them if they are many."""
    lain = stored(rows.withColumn("__lies", F.monotonically_increasing_id()), "lain")
    order = [*order, F.col("__lies").asc()]
    ranges = stored(lain.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    split = ranges.withColumn("__range", F.shiftright("__at", 33))
    counts = split.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    first = counts.select("__range", (F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__first"))
    at = F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return split.join(F.broadcast(first), "__range").withColumn(name, at).drop("__lies", "__at", "__range", "__first")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """(columns, run bounds) of batches that are sorted by `keys`; a run that goes on in the next batch is carried over."""
    left: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if left is not None:
            t = pa.concat_tables([left, t])
        if not t.num_rows:
            continue
        cols = {k: t.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in keys}
        edge = np.zeros(t.num_rows, bool)
        edge[0] = True
        for k in keys:
            edge[1:] |= cols[k][1:] != cols[k][:-1]
        at = np.flatnonzero(edge)
        left = t.slice(int(at[-1]))
        if len(at) > 1:
            yield _numpy(t.slice(0, int(at[-1]))), at
    if left is not None and left.num_rows:
        yield _numpy(left), np.array([0, left.num_rows])


def _numpy(t: pa.Table) -> dict[str, np.ndarray]:
    out = {}
    for name in t.column_names:
        c = t.column(name).combine_chunks()
        out[name] = c if pa.types.is_nested(c.type) or pa.types.is_binary(c.type) or pa.types.is_string(c.type) else c.to_numpy(zero_copy_only=False)
    return out


def labels_of(near: np.ndarray) -> np.ndarray:
    """Smallest row number reachable through a symmetric boolean matrix."""
    n = len(near)
    label, near = np.arange(n), near | np.eye(n, dtype=bool)
    while True:
        new = np.where(near, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tiles(rows: DataFrame, key: list[str], member: str, most: int) -> DataFrame:
    """Deal cells of rows with equal `key` into tiles of at most about 2 x `most` rows, such that each pair of a cell meets
    in a tile. Adds tile_i, tile_j (block numbers, i <= j) and block. A cell's rows are counted with partial sums first, so
    that no cell is ever gathered whole; only cells of more than `most` rows are cut, and only those counts are joined."""
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("cell_rows")).where(F.col("cell_rows") > most)
    return (
        rows.join(counts, key, "left")
        .withColumn("blocks", F.coalesce(F.ceil(F.col("cell_rows") / F.lit(most)), F.lit(1)).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("tile_i", F.least("block", "other"))
        .withColumn("tile_j", F.greatest("block", "other"))
        .drop("other", "blocks", "cell_rows")
    )


#: Links up to which their components are searched in one partition: some 10 MB, a few seconds a round.
FEW_LINKS = 200_000


def few_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all links (v, u) of one partition, which the caller bounds: each component's smallest node takes in those of its neighbours,
    until nothing changes."""
    batches = list(batches)
    if not batches:
        return
    links = pa.Table.from_batches(batches)
    nodes = pa.chunked_array(links["v"].chunks + links["u"].chunks).unique()
    nodes = nodes.take(pc.sort_indices(nodes))
    v, u = (pc.index_in(links[c], value_set=nodes).to_numpy() for c in ("v", "u"))
    label = np.arange(len(nodes))
    while True:
        new, low = label.copy(), np.minimum(label[v], label[u])
        np.minimum.at(new, label[v], low)
        np.minimum.at(new, label[u], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(label))], names=["node", "component"])


def connected_components(edges: DataFrame, rounds: int = 60, few: int = FEW_LINKS, at_once: bool = False) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b; any comparable type); component is the smallest node
    reachable. Alternates the two star contractions: each node's larger neighbours, then its smaller ones, are hung on the
    smallest. A node's smallest neighbour is found with partial aggregates and joined back, so a node with very many
    neighbours is split by adaptive execution like any skewed join. Each round is written to the checkpoint folder. At most `few`
    links (counted; a round makes no more of them) lie in one partition, where the same rounds need no shuffle; or, if `at_once`, are
    searched there by one task in Python, which spares the driver the plans of all rounds (nodes of whole numbers or strings)."""
    e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct()
    e = checkpointed(e)
    n = e.count()
    if not n:
        return e.select(F.col("v").alias("node"), F.col("u").alias("component"))
    kind = e.schema["v"].dataType.simpleString()
    if at_once and n <= few and kind in ("tinyint", "smallint", "int", "bigint", "string"):
        return checkpointed(e.coalesce(1).mapInArrow(few_components, f"node {kind}, component {kind}"))
    together = (lambda t: t.coalesce(1)) if n <= few else (lambda t: t)
    e, last = together(e), None
    for _ in range(rounds):
        low = e.groupBy("v").agg(F.min("u").alias("m"))
        up = low.withColumnRenamed("v", "u")
        large = e.join(up, "u", "left").select("v", F.coalesce("m", "u").alias("u"))
        e1 = together(large.unionByName(low.select("v", F.col("m").alias("u"))))
        low1 = e1.groupBy("v").agg(F.min("u").alias("m"))
        small = e1.join(low1, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        e = together(checkpointed(together(small.unionByName(low1.select("v", F.col("m").alias("u")))).distinct()))
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == last:  # only stars stay as they are
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )


def merged_components(first: DataFrame, later: DataFrame) -> DataFrame:
    """(node, component) of a graph whose links were found in turns: `first` are components of some links, `later` those of links between
    components of `first` (named by their smallest nodes) and nodes beyond them."""
    end = later.select(F.col("node").alias("component"), F.col("component").alias("end"))
    beyond = later.join(first.select(F.col("component").alias("node")).distinct(), "node", "left_anti").select("node", "component")
    return first.join(end, "component", "left").select("node", F.coalesce("end", "component").alias("component")).unionByName(beyond)


#: Fixed odd base and byte values of the polynomial hash (arbitrary; drawn once from a seeded generator).
_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = [int(x) | 1 for x in _rng.integers(1 << 40, 1 << 62, 2)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


class SpanHash:
    """Hashes of any span of a byte array in constant time each, from prefix sums modulo 2^64. `kind` 0 or 1 gives one of
    two independent functions."""

    def __init__(self, buf: np.ndarray, kind: int = 0):
        n = len(buf)
        up, down = _powers.get(kind, (np.ones(0, np.uint64),) * 2)
        if len(up) < n + 1:
            m = max(n + 1, 1 << 16)
            up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m, _BASE[kind], np.uint64))])
            down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m, pow(_BASE[kind], -1, 1 << 64), np.uint64))])
            _powers[kind] = up, down
        self.down = down
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUE[kind][buf] * up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, length: int) -> np.ndarray:
        """Hash of each span of `length` bytes, by its start."""
        return mix64((self.sums[length:] - self.sums[:-length]) * self.down[: len(self.sums) - length])


def sized(df: DataFrame, lists: str | None = None, most: int = 1_000_000) -> DataFrame:
    """df, which has been written, marked for broadcast if its rows and the items of its column `lists` are together at most `most`; a larger
    one is joined by a shuffle."""
    items = F.lit(1) if lists is None else F.lit(1) + F.coalesce(F.size(lists), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(items)).first()[0] or 0) <= most else df


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a large in-between result as Parquet in the shared folder and read it back: compressed (as the session has it, or by `codec`), and with no lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    del df
    freed(spark)
    return spark.read.parquet(path)
