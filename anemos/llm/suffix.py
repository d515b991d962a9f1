"""Removal of repeated passages with suffix order and longest-previous-factor tests (operator 2)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anemos.llm._common import SpanHash, checkpointed, stored, text_buffer, text_slices

#: Bits of an anchor's order that hold its position.
PLACE = np.uint64((1 << 28) - 1)
#: Window starts of a text that are looked at together; a longer text is taken in turns, and no window is cut.
TURN = 1 << 26
#: Bytes of pieces whose suffixes are ranked together, unless one anchor has more.
PART = 1 << 19
ANCHORS = "doc bigint, lo int, n int, h bigint, ctx bigint"


def anchors(buf: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor hash, context hash, offset of the anchor in the first window) of each run of
    windows of `length` bytes that have the same anchor: the leftmost of their least-hashed spans of `gram` bytes. Equal
    windows have equal anchors, so a repeated window is always found among runs of equal anchor hash. The context is all
    bytes of the run's windows."""
    none = (np.zeros(0, np.int64),) * 6
    if len(buf) < length:
        return none
    h = SpanHash(buf).every(gram)
    least = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
    width, s = length - gram + 1, 1
    while 2 * s <= width:
        least = np.minimum(least[:-s], least[s:])
        s *= 2
    if width > s:
        least = np.minimum(least[: -(width - s)], least[width - s :])
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    start = np.flatnonzero(np.arange(len(least)) + length <= offs[1:][text[: len(least)]])
    if not len(start):
        return none
    at = (least[start] & PLACE).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    i = np.flatnonzero(new)
    n = np.diff(np.append(i, len(start)))
    lo, at = start[i], at[i]
    ctx = SpanHash(buf, 1)(lo, lo + n - 1 + length) ^ (at - lo).astype(np.uint64)
    return text[lo], lo - offs[text[lo]], n, h[at], ctx, at - lo


def smaller_positions(at: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, given the suffixes' positions in suffix order and what each has in common with the one before it: how much it has
    in common with the last suffix before it of a smaller position (0: there is none). Links to the neighbour before are
    followed, and shared lengths lowered, until they point at a smaller position. Returns (place of that suffix or -1, shared length)."""
    back = np.arange(-1, len(at) - 1)
    shared = common.copy()
    live = np.flatnonzero((back >= 0) & (at[back] >= at))
    while len(live):
        over = back[live]
        shared[live] = np.minimum(shared[live], shared[over])
        back[live] = back[over]
        live = live[(back[live] >= 0) & (at[back[live]] >= at[live]) & (shared[live] > 0)]
    lost = (back < 0) | (at[np.maximum(back, 0)] >= at)
    shared[lost] = 0
    return np.where(lost, -1, back), shared


def longest_previous_factors(at: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix, in suffix order: the longest prefix that it shares with a suffix of a smaller position.
    That is the previous or the next one in suffix order whose position is smaller. `common` is what neighbours share, the first's 0."""
    before = smaller_positions(at, common)[1]
    after = smaller_positions(at[::-1], np.append(common[1:], 0)[::-1])[1][::-1]
    return np.maximum(before, after)


def suffix_matches(pieces: list[bytes], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window start of the pieces, which stand in text order: (piece, any match, earlier match) by suffix order.

    Suffixes are ranked by their first 8, 16, 32 ... `length` bytes (prefix doubling); the last of these lengths at which the ranks of
    neighbours in suffix order agree is what they have in common, as far as `length`. A window has an earlier match exactly if its
    longest previous factor reaches `length`, and any match if a neighbour shares as much."""
    buf = np.frombuffer(b"".join(pieces) + bytes(length + 8), np.uint8)
    size = np.array([len(p) for p in pieces])
    first = np.cumsum(size) - size
    n = len(buf) - 8
    rank = np.ndarray((n,), ">u8", buffer=buf, strides=(1,)).astype(np.uint64)
    rank, span = _dense(rank), 8
    piece = np.repeat(np.arange(len(pieces)), windows)
    start = first[piece] + np.arange(len(piece)) - (np.cumsum(windows) - windows)[piece]
    levels = [(span, rank[start])]
    while span < length:
        step = min(span, length - span)
        last = span + step == length
        at = start if last else np.arange(n)
        rank = _dense((rank[at] << np.uint64(32)) | rank[np.minimum(at + step, n - 1)])
        span += step
        levels.append((span, rank if last else rank[start]))
    order = np.lexsort((start, levels[-1][1]))  # suffix order; equal ones by position
    common = np.zeros(len(order), np.int32)
    for span, rank in levels:
        in_order = rank[order]
        common[1:][in_order[1:] == in_order[:-1]] = span
    factor = longest_previous_factors(start[order], common)
    any_, earlier = np.empty(len(order), bool), np.empty(len(order), bool)
    any_[order] = (common >= length) | (np.append(common[1:], 0) >= length)
    earlier[order] = factor >= length
    return piece, any_, earlier


def _dense(key: np.ndarray) -> np.ndarray:
    """Ranks from 0 of the keys; equal keys have equal ranks."""
    order = np.argsort(key)
    s = key[order]
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(np.append(False, s[1:] != s[:-1])).astype(np.uint64)
    return rank


def _true_runs(piece: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of hits within a piece."""
    i = np.flatnonzero(hit)
    if not len(i):
        return i, i
    cut = np.flatnonzero((np.diff(i) > 1) | (np.diff(piece[i]) > 0))
    return i[np.append(0, cut + 1)], i[np.append(cut, len(i) - 1)]


def row_key(id_col: str, text_col: str) -> Column:
    """What names a row: its id, or a hash of its text where it has none."""
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit("no id"), F.col(text_col)))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 40, keep: str = "none", most: int = 4096) -> DataFrame:
    """(doc, lo, hi): byte spans, possibly overlapping, that cover exactly the bytes in repeated windows of `length` bytes.

    keep="none": every window that also starts anywhere else; keep="first": only those with an earlier occurrence, by
    document id and position. Runs of windows are grouped by anchor; runs with equal contexts (by two independent hashes of 64 bits) are
    settled by counting. Of the rest one run of each context is fetched, and runs of equal anchor are compared in suffix order by
    their longest previous factors, some megabytes at a time. An anchor with more than `most` different contexts isn't gathered:
    its windows are grouped by two hashes instead. All counts are partial sums that are joined back, so no anchor, context or
    window is gathered in one task.
    """
    rows = docs.select(row_key(id_col, text_col).alias("doc"), F.col(text_col).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, buf, offs in text_slices(batch.column(1), 1 << 19):
                for turn in range(0, max(1, len(buf) if len(offs) == 2 else 1), TURN):
                    some, bounds = (buf[turn : turn + TURN + length - 1], np.array([0, min(len(buf) - turn, TURN + length - 1)])) if len(offs) == 2 else (buf, offs)
                    text, lo, n, h, ctx, _ = anchors(some, bounds, length, gram)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + first)), pa.array((lo + turn).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h.astype(np.uint64).view(np.int64)), pa.array(ctx.astype(np.uint64).view(np.int64))], names=["doc", "lo", "n", "h", "ctx"])

    found = stored(rows.mapInArrow(find, ANCHORS), "anchors")
    by_anchor = checkpointed(found.groupBy("h").agg(F.count(F.lit(1)).alias("runs"), (F.min("ctx") != F.max("ctx")).alias("mixed")).where("runs > 1").select("h", "mixed"))  # written, so that the join can split a common anchor's rows
    marked = stored(found.join(by_anchor, "h"), "shared-anchors")
    contexts = stored(marked.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "lo")).alias("least"), F.max("n").alias("n"), F.max("mixed").alias("mixed")), "anchor-contexts")
    span = [F.col("doc"), F.col("lo"), (F.col("lo") + F.col("n") - 1 + length).alias("hi")]
    settled = marked.join(contexts.where("copies > 1").select("h", "ctx", "least"), ["h", "ctx"]).where(F.struct("doc", "lo") != F.col("least") if keep == "first" else F.lit(True)).select(*span)
    open_ = contexts.where("mixed").select("least.doc", "least.lo", "n", "h", (F.col("copies") > 1).alias("copied"))
    crowd = checkpointed(open_.groupBy("h").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") > most).select("h", F.lit(True).alias("crowded")))
    wanted = open_.join(crowd, "h", "left").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("lo", "n", "h", "copied", F.coalesce("crowded", F.lit(False)).alias("crowded")))).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for i in range(batch.num_rows):
                base = int(offs[i])
                out = [(batch.column(0)[i].as_py(), w["lo"], w["n"], w["h"], w["copied"], w["crowded"], buf[base + w["lo"] : base + w["lo"] + w["n"] - 1 + length].tobytes()) for w in batch.column(2)[i].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()))], names=["doc", "lo", "n", "h", "copied", "crowded", "piece"])

    fetched = stored(rows.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(fetch, "doc bigint, lo int, n int, h bigint, copied boolean, crowded boolean, piece binary"), "contexts")
    spans = T.StructType.fromDDL("doc bigint, lo int, hi int")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            t = pa.Table.from_batches(held)
            if t.column("piece").nbytes < PART:
                continue
            h = t.column("h").to_numpy()
            end = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
            for lo, hi in _cuts(h[:end], t.column("piece").slice(0, end)):
                yield judge(t.slice(lo, hi - lo))
            held = t.slice(end).combine_chunks().to_batches()
        if held:
            t = pa.Table.from_batches(held)
            for lo, hi in _cuts(t.column("h").to_numpy(), t.column("piece")):
                yield judge(t.slice(lo, hi - lo))

    def judge(t: pa.Table) -> pa.RecordBatch:
        doc, lo, n = (t.column(c).to_numpy() for c in ("doc", "lo", "n"))
        order = np.lexsort((lo, doc))
        doc, lo, n, copied = doc[order], lo[order], n[order], t.column("copied").to_numpy()[order]
        pieces = t.column("piece").take(pa.array(order)).to_pylist()
        piece, any_, earlier = suffix_matches(pieces, n, length)
        hit = earlier if keep == "first" else any_ & ~copied[piece]
        a, b = _true_runs(piece, hit)
        first = np.cumsum(n) - n
        p = piece[a]
        return pa.RecordBatch.from_arrays([pa.array(doc[p]), pa.array((lo[p] + a - first[p]).astype(np.int32)), pa.array((lo[p] + b - first[p] + length).astype(np.int32))], names=spans.names)

    compared = fetched.where("NOT crowded").select("doc", "lo", "n", "h", "copied", "piece").repartition("h").sortWithinPartitions("h").mapInArrow(compare, spans)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, lo = batch.column(2)[i].as_py(), batch.column(1)[i].as_py()
                piece = np.frombuffer(batch.column(4)[i].as_py(), np.uint8)
                w = [SpanHash(piece, k).every(length)[:n].view(np.int64) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column(0)[i].as_py())), pa.array((lo + np.arange(n)).astype(np.int32)), pa.array(np.full(n, batch.column(3)[i].as_py())), *map(pa.array, w)], names=["doc", "at", "copied", "w0", "w1"])

    windows = stored(fetched.where("crowded").select("doc", "lo", "n", "copied", "piece").mapInArrow(explode, "doc bigint, at int, copied boolean, w0 bigint, w1 bigint"), "crowded-windows")
    many = checkpointed(windows.groupBy("w0", "w1").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc", "at")).alias("least")).where("times > 1"))
    repeated = windows.join(many, ["w0", "w1"]).where(F.struct("doc", "at") != F.col("least") if keep == "first" else ~F.col("copied"))
    return settled.unionByName(compared).unionByName(repeated.select("doc", F.col("at").alias("lo"), (F.col("at") + length).alias("hi")))


def _cuts(h: np.ndarray, pieces: pa.ChunkedArray) -> Iterator[tuple[int, int]]:
    """Row ranges of whole anchors, of about PART bytes each."""
    if not len(h):
        return
    size = np.cumsum([len(x) for x in pieces.to_pylist()])
    edges = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))
    lo = 0
    for a, b in zip(edges[:-1], edges[1:]):
        if b == len(h) or size[b - 1] - (size[lo - 1] if lo else 0) >= PART:
            yield lo, int(b)
            lo = int(b)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep: str = "none", with_kept: bool = True, **options) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, and with_kept: kept binary) of each document, after every byte that
    repeated_spans covers is removed. Null texts count as empty; texts under `length` bytes lose nothing. Ids are integers
    and name one text each: rows that repeat an id and text are alike and each other's copies, and so are rows without an id that
    repeat a text. An empty table gives an empty result. Extra columns are not read."""
    spans = repeated_spans(docs, id_col, text_col, length, keep=keep, **options)
    by_doc = spans.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", row_key("id", "text")).join(by_doc, F.col("key") == F.col("doc"), "left").select("id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, buf, offs in text_slices(batch.column(1)):
                out = []
                for i in range(first, end):
                    text = buf[offs[i - first] : offs[i - first + 1]]
                    spans = batch.column(2)[i].as_py() or []
                    depth = np.zeros(len(text) + 1, np.int32)
                    np.add.at(depth, [s["lo"] for s in spans], 1)
                    np.add.at(depth, [s["hi"] for s in spans], -1)
                    gone = np.cumsum(depth[:-1]) > 0 if spans else np.zeros(len(text), bool)
                    kept = text[~gone].tobytes()
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                    out.append((len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), *([kept] if with_kept else [])))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_kept])

    return rows.mapInArrow(cut, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_kept)
