"""Benchmark decontamination by q-gram lemma filtering and banded alignment (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anemos.llm._common import LOWER, Aside, SpanHash, checkpointed, sized, text_buffer, text_slices

KEPT = np.zeros(256, bool)
KEPT[48:58] = KEPT[97:123] = KEPT[128:] = True
#: Pairs of equal q-grams that are held at once.
HITS = 1 << 21


def normalised(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters, digits and bytes of longer characters; each run of anything else becomes one space, and none
    stands at the start of a text."""
    low = LOWER[buf]
    kept = KEPT[low]
    after = np.zeros(len(buf), bool)
    after[1:] = kept[:-1]
    after[offs[:-1][offs[1:] > offs[:-1]]] = False
    keep = kept | after
    return np.where(kept, low, np.uint8(32))[keep], np.concatenate([[0], np.cumsum(keep)])[offs]


@dataclass
class SegmentIndex:
    """All regions of benchmark items, one from each byte on, with the postings of the items' q-grams."""

    q: int
    budget: int
    at: np.ndarray  # start of each item in `text`
    regions: np.ndarray  # how many each has
    span: np.ndarray  # length of its regions
    allowed: np.ndarray  # their edit budget
    before: np.ndarray  # regions of the items before it
    text: np.ndarray
    grams: np.ndarray  # sorted distinct q-gram hashes
    first: np.ndarray  # bounds of their postings
    post_item: np.ndarray
    post_off: np.ndarray
    maybe: np.ndarray  # bit table of the hashes' upper bits
    alike: np.ndarray  # for each start in `text`: how many regions of the item have this region's bytes, told at the first of them

    @property
    def item(self) -> np.ndarray:
        """Item number of each region."""
        return np.repeat(np.arange(len(self.regions)), self.regions)

    @property
    def start(self) -> np.ndarray:
        """Start of each region, in `text`."""
        item = self.item
        return self.at[item] + np.arange(len(item)) - self.before[item]

    @property
    def size(self) -> np.ndarray:
        return self.span[self.item]

    @property
    def edits(self) -> np.ndarray:
        """Edit budget of each region."""
        return self.allowed[self.item]


def build_index(texts: pa.Array, q: int = 12, region: int = 100, rate: float = 0.06, least: int = 0, most: int = 1 << 40) -> SegmentIndex:
    """Every run of `region` bytes of each item (a shorter item is one region), with an edit budget of rate x length, for items of
    `least` to `most` normalised bytes. Regions of an item with the same bytes are looked for once. Only q-grams of
    regions that are looked for have postings."""
    buf, offs = normalised(*text_buffer(texts))
    at, n = offs[:-1].astype(np.int64), np.diff(offs).astype(np.int64)
    full = np.flatnonzero(n)
    n[full] -= buf[offs[1:][full] - 1] == 32
    n[(n < max(least, q)) | (n > most)] = 0
    regions = np.where(n == 0, 0, np.maximum(n - region, 0) + 1)
    span = np.minimum(n, region)
    allowed = (span * rate).astype(np.int64)
    of = np.repeat(np.arange(len(n)), regions)
    start = at[of] + np.arange(len(of)) - np.repeat(np.cumsum(regions) - regions, regions)
    spans = SpanHash(buf)
    same = spans(start, start + span[of])
    order = np.lexsort((start, same, of))
    new = np.ones(len(order), bool)
    new[1:] = (of[order][1:] != of[order][:-1]) | (same[order][1:] != same[order][:-1])
    alike = np.zeros(len(buf) + 1, np.int64)
    heads = np.flatnonzero(new)
    alike[start[order[heads]]] = np.diff(np.append(heads, len(order)))
    covered = np.zeros(len(buf) + 1, np.int64)
    head = order[heads]
    np.add.at(covered, start[head], 1)
    np.add.at(covered, start[head] + span[of[head]] - q + 1, -1)
    place = np.flatnonzero(np.cumsum(covered) > 0)  # starts of q-grams in regions that are looked for
    item = np.searchsorted(offs[1:], place, side="right")
    gram = spans.every(q)[place] if len(place) else np.zeros(0, np.uint64)
    order = np.argsort(gram, kind="stable")
    grams, first = np.unique(gram[order], return_index=True)
    maybe = np.zeros(1 << 22, bool)
    maybe[(grams >> np.uint64(42)).astype(np.int64)] = True
    return SegmentIndex(q, int(max(allowed, default=0)), at, regions, span, allowed, np.cumsum(regions) - regions, buf, grams, np.append(first, len(gram)), item[order], (place - at[item])[order], maybe, alike)


def short_items(texts: pa.Array, most: int) -> dict[int, dict[bytes, list[int]]]:
    """Items of fewer than `most` normalised bytes, by their length."""
    buf, offs = normalised(*text_buffer(texts))
    out: dict[int, dict[bytes, list[int]]] = {}
    for i, (lo, hi) in enumerate(zip(offs[:-1], offs[1:])):
        text = buf[lo:hi].tobytes().rstrip(b" ") if hi - lo <= most else b""
        if 0 < len(text) < most:
            out.setdefault(len(text), {}).setdefault(text, []).append(i)
    return out


def find_short(buf: np.ndarray, offs: np.ndarray, items: dict[int, dict[bytes, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, item) of every short item that stands in a text as whole words."""
    buf, offs = normalised(buf, offs)
    space = np.append(buf == 32, True)
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    begins, ends = first[:-1] | np.append(True, space[:-2])[: len(buf)], first | space
    found = []
    for n, of_length in items.items():
        at = np.flatnonzero(begins[: max(0, len(buf) - n + 1)])
        at = at[ends[at + n] & (at + n <= offs[np.searchsorted(offs, at, side="right").clip(max=len(offs) - 1)])]
        hashes = SpanHash(buf)(at, at + n) if len(at) else np.zeros(0, np.uint64)
        for text, numbers in of_length.items():
            want = SpanHash(np.frombuffer(text, np.uint8))(np.array([0]), np.array([n]))[0]
            docs = np.unique(np.searchsorted(offs[1:], at[hashes == want], side="right"))
            found += [(d, i) for d in docs for i in numbers]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Group number of each row of sorted keys."""
    edge = np.zeros(len(keys[0]), bool)
    for k in keys:
        edge[1:] |= k[1:] != k[:-1]
    return np.cumsum(edge)


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of every value from low to high."""
    n = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, low[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]


def find_regions(buf: np.ndarray, offs: np.ndarray, x: SegmentIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, region, edits) of every region of the index found in a slice of whole texts within its budget; equal regions of an
    item are told once. Where texts and items have more than HITS pairs of equal q-grams, they are taken
    in overlapping pieces of text and index, halved until the pairs are few enough; any occurrence lies whole in a piece."""
    none = (np.zeros(0, np.int64),) * 3
    buf, offs = normalised(buf, offs)
    if len(buf) < x.q or not len(x.grams):
        return none
    spans = SpanHash(buf)
    h = spans.every(x.q)
    at = np.flatnonzero(x.maybe[(h >> np.uint64(42)).astype(np.int64)])
    g = np.searchsorted(x.grams, h[at])
    g[g == len(x.grams)] = 0
    ok = x.grams[g] == h[at]
    at, g = at[ok], g[ok]
    doc = np.searchsorted(offs[1:], at, side="right")
    inside = at + x.q <= offs[doc + 1]
    at, g, doc = at[inside], g[inside], doc[inside]
    if not len(at):
        return none
    size = len(x.text) + 1
    posting = np.repeat(np.arange(len(x.grams)), np.diff(x.first)) * size + x.at[x.post_item] + x.post_off  # rises
    reach = int(x.span.max()) + x.budget + x.q
    out, todo = [], [(0, int(at[-1]) + 1, 0, size)]
    while todo:
        lo, hi, low, high = todo.pop()
        rows = slice(*np.searchsorted(at, [lo, hi]))
        first, last = np.searchsorted(posting, g[rows] * size + low), np.searchsorted(posting, g[rows] * size + high)
        if (last - first).sum() <= HITS or max(hi - lo, high - low) <= 2 * reach:
            out.append(_in_piece(buf, offs, spans, x, at[rows], doc[rows], first, last - first))
        elif hi - lo >= high - low:
            middle = (lo + hi) // 2
            todo += [(lo, middle + reach, low, high), (middle, hi, low, high)]
        else:
            middle = (low + high) // 2
            todo += [(lo, hi, low, middle + reach), (lo, hi, middle, high)]
    key, edits = _fewest(*(np.concatenate(c) for c in zip(*out)))
    return *np.divmod(key, int(x.regions.sum())), edits


def _in_piece(buf: np.ndarray, offs: np.ndarray, spans: SpanHash, x: SegmentIndex, at: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What find_regions finds among the postings first to first + n of the q-grams at `at`: (text number x all regions + region, fewest
    edits). Regions all of whose q-grams follow each other in the text need no alignment."""
    p = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    item, off, doc = x.post_item[p], x.post_off[p], np.repeat(doc, n)
    diagonal = np.repeat(at, n) - off
    if not len(item):
        return (np.zeros(0, np.int64),) * 2
    order = np.lexsort((off, diagonal, item, doc))
    doc, item, diagonal, off = doc[order], item[order], diagonal[order], off[order]
    grams = x.span[item] - x.q  # of a region, less one
    last = np.minimum(np.arange(len(off)) + grams, len(off) - 1)
    group = _groups(doc, item, diagonal)
    same = np.flatnonzero((group[last] == group) & (off[last] - off == grams))
    same = same[x.alike[x.at[item[same]] + off[same]] > 0]
    total = int(x.regions.sum())  # a document's region is one number
    exact = np.unique(doc[same] * total + x.before[item[same]] + off[same])
    step = x.budget + 1  # bands are two steps wide and start at each step: any budget + 1 diagonals lie in one band
    band = np.concatenate([diagonal // step, diagonal // step - 1])
    doc, item, off = np.tile(doc, 2), np.tile(item, 2), np.tile(off, 2)
    order = np.lexsort((off, band, item, doc))
    doc, item, band, off = doc[order], item[order], band[order], off[order]
    group = _groups(doc, item, band)
    need = x.span[item] + 1 - x.q - x.allowed[item] * x.q
    last = np.minimum(np.arange(len(off)) + need - 1, len(off) - 1)
    wide = x.span[item] - x.q
    ok = np.flatnonzero((last - np.arange(len(off)) == need - 1) & (group[last] == group) & (off[last] - off <= wide))
    low, high = np.maximum(off[last[ok]] - wide[ok], 0), np.minimum(off[ok], x.regions[item[ok]] - 1)
    low[1:] = np.where(group[ok[1:]] == group[ok[:-1]], np.maximum(low[1:], high[:-1] + 1), low[1:])  # bounds rise in a group
    row, start = _expanded(low, high)
    row = ok[row]
    looked = x.alike[x.at[item[row]] + start] > 0
    row, start = row[looked], start[looked]
    key = doc[row] * total + x.before[item[row]] + start
    new = ~np.isin(key, exact)
    key, row, start = key[new], row[new], start[new]
    low, high, diag, width = offs[doc[row]], offs[doc[row] + 1], band[row] * step - x.budget + start, 2 * step + 2 * x.budget
    first, last = np.clip(diag, low, high), np.clip(diag + width + x.span[item[row]], low, high)
    alike = np.stack([key % max(total, 1), spans(first, last).view(np.int64), first - diag, last - diag])  # a region beside the same bytes is aligned once
    _, once, back = np.unique(alike, axis=1, return_index=True, return_inverse=True)
    cost = np.full(len(once), -1, np.int64)
    for lo in range(0, len(once), 512):
        i = once[lo : lo + 512]
        of = item[row[i]]
        cost[lo : lo + 512] = align(buf, low[i], high[i], diag[i], width, x, x.at[of] + start[i], x.span[of], x.allowed[of])
    found = cost[back.ravel()]
    ok = found <= x.allowed[item[row]]
    return _fewest(np.concatenate([exact, key[ok]]), np.concatenate([np.zeros(len(exact), np.int64), found[ok]]))


def _fewest(key: np.ndarray, edits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with its fewest edits."""
    order = np.lexsort((edits, key))
    key, edits = key[order], edits[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return key[new], edits[new]


def align(buf: np.ndarray, low: np.ndarray, high: np.ndarray, diagonal: np.ndarray, width: int, x: SegmentIndex, start: np.ndarray, size: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Least edit distance of each region to any span of its text within `width` diagonals from `diagonal` on; a large number
    where it exceeds `allowed`. Regions beyond it are dropped every few bytes."""
    lanes = np.arange(width)
    cost = np.zeros((len(start), width), np.int32)
    best = np.full(len(start), 1 << 20, np.int64)
    live = np.arange(len(start))
    for i in range(int(size.max())):
        char = x.text[np.minimum(start[live] + i, len(x.text) - 1)]
        p = diagonal[live, None] + i + lanes
        valid = (p >= low[live, None]) & (p < high[live, None])
        differs = ~valid | (buf[np.clip(p, 0, len(buf) - 1)] != char[:, None])
        new = cost + differs
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - lanes, axis=1) + lanes
        done = size[live] == i + 1
        if done.any():
            best[live[done]] = cost[done].min(1)
        if i % 8 == 7 or done.any():
            stay = ~done & (cost.min(1) <= allowed[live])
            live, cost = live[stay], cost[stay]
            if not len(live):
                break
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", q: int = 12, short_q: int = 8, region: int = 100, rate: float = 0.06, part_bytes: int = 4 << 20) -> DataFrame:
    """(id_col, item_col, regions, of_regions, edits): pairs of a document and a benchmark item of which it holds a region of
    `region` normalised bytes (or the whole item, if shorter) within rate x length edits; how many of the item's regions were
    found, of how many, and the fewest edits. Case, punctuation and spacing don't count.

    Items of under 3 q bytes are looked for by grams of short_q bytes, so that the lemma holds for their whole budget; items of under short_q bytes
    have no budget and are found as whole words. Items are read in parts of about part_bytes, so what a task holds doesn't grow with
    the benchmark; each part is one pass over the documents, and its results are written before the next. Null and
    empty texts hold nothing and match nothing; repeated rows of a document are one; long texts are taken whole; an empty table on
    either side gives an empty result; extra columns are not read.
    """
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField(item_col, item_kind), T.StructField("regions", T.LongType()), T.StructField("of_regions", T.LongType()), T.StructField("edits", T.LongType())])
    rows = docs.select(id_col, text_col)
    out = None
    parts = _parts(benchmark.select(item_col, item_text), part_bytes)
    part = next(parts, None)
    while part is not None:
        texts = pa.array(part[1], pa.string())
        indexes = [x for x in (build_index(texts, q, region, rate, least=3 * q), build_index(texts, short_q, region, rate, most=3 * q - 1)) if len(x.grams)]
        held = docs.sparkSession.sparkContext.broadcast((pa.array(part[0]), indexes, short_items(texts, short_q)))

        def per_batch(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items, indexes, short = held.value
            for batch in batches:
                for lo, _, buf, offs in text_slices(batch.column(1)):
                    for index in indexes:
                        doc, seg, edits = find_regions(buf, offs, index)
                        if not len(doc):
                            continue
                        total = index.regions
                        pair, at = np.unique(np.stack([doc, np.searchsorted(np.cumsum(total), seg, side="right")], 1), axis=0, return_inverse=True)
                        at = at.ravel()
                        fewest = np.full(len(pair), 1 << 20, np.int64)
                        np.minimum.at(fewest, at, edits)
                        of, seg = np.unique(np.stack([at, seg], 1), axis=0).T
                        item = pair[of, 1]
                        regions = np.bincount(of, weights=index.alike[index.at[item] + seg - index.before[item]], minlength=len(pair)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pair[:, 0] + lo)), items.take(pa.array(pair[:, 1])).cast(pa_type(item_kind)), pa.array(regions), pa.array(total[pair[:, 1]]), pa.array(fewest)], names=schema.names)
                    if short:
                        doc, item = find_short(buf, offs, short)
                        one = pa.array(np.ones(len(doc), np.int64))
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + lo)), items.take(pa.array(item)).cast(pa_type(item_kind)), one, one, pa.array(np.zeros(len(doc), np.int64))], names=schema.names)

        found = rows.mapInArrow(per_batch, schema)
        part = next(parts, None)
        if part is not None or out is not None:  # more than one part: none is held longer than its pass takes
            found = checkpointed(found)
            held.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out.groupBy(id_col, item_col).agg(F.max("regions").alias("regions"), F.max("of_regions").alias("of_regions"), F.min("edits").alias("edits"))


def pa_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _parts(items: DataFrame, most: int) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for r in items.toLocalIterator():
        if r[1] is None:
            continue
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1])
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no region of any benchmark item, with all their columns. A document is its id, which may be null, and
    its text; rows that repeat both go or stay together."""
    aside = Aside(docs, [id_col, text_col])
    rows = aside.docs.withColumnRenamed(id_col, "own_id")
    key = F.struct(F.col("own_id").alias("id"), F.xxhash64(F.col(text_col)).alias("text"))
    held = contaminated(rows.select(key.alias("held"), text_col), benchmark, "held", text_col, **options).select("held").distinct()
    left = rows.join(sized(checkpointed(held)), key == F.col("held"), "left_anti")
    return left.withColumnRenamed("own_id", id_col).select(*aside.back())
