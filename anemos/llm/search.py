"""Ranked lexical search over a bit-sliced impact index (operator 12)."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anemos.llm._common import LOWER, NOT_ALNUM, binaries, places, runs, sized, stored, text_slices, word_spans, words_of

#: A block of the index: so many bytes of text and documents at most. A document's place in its block takes 16 bits.
BLOCK_BYTES, BLOCK_DOCS = 12 << 20, 1 << 15
#: Bits of an impact: (10^9 tf) div (1000 tf + 8 m) is below 10^6.
BITS = 20
#: Items that are searched for together, and terms of such items.
ITEMS, TERMS = 512, 1 << 15


@dataclasses.dataclass
class Index:
    """`rows`: of each block one row with its documents' ids in ascending order (`ids`), and one a term (`term`; `df`: its documents in the
    block, `at`: their places, `bits`: BITS bitmaps over them, least significant first). `docs` and `words` count documents with terms and all their terms."""

    rows: DataFrame
    docs: int
    words: int


def corpus_size(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents that hold a term, all terms with repeats)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = terms = 0
        for batch in batches:
            for _, _, buf, offs in text_slices(batch.column(0)):
                doc = word_spans(buf, offs, NOT_ALNUM)[2]
                held, terms = held + len(np.unique(doc)), terms + len(doc)
        yield pa.RecordBatch.from_pydict({"d": pa.array([held], pa.int64()), "t": pa.array([terms], pa.int64())})

    d, t = docs.select(text_col).mapInArrow(count, "d long, t long").agg(F.sum("d"), F.sum("t")).first()
    return int(d or 0), int(t or 0)


def _length_norm(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """8 m of each document of n terms, m being 100 - 90 + ((90 n N) div L)."""
    if docs and int(n.max(initial=0)) * 90 * docs >= 1 << 63:
        return np.array([8 * (10 + 90 * int(x) * docs // words) for x in n], np.int64)
    return 8 * (10 + 90 * n * docs // max(words, 1))


def bitmaps(values: np.ndarray, of: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BITS bitmaps over each run of values (of: the run of each, count: values of each run), and where each run's bytes begin."""
    rank = np.arange(len(values)) - np.repeat(np.cumsum(count) - count, count)
    wide = -(-count // 8)
    bounds = np.concatenate([[0], np.cumsum(BITS * wide)])
    out = np.zeros(bounds[-1], np.uint8)
    head = np.flatnonzero(rank % 8 == 0)  # the first of each byte
    where, step = bounds[of[head]] + rank[head] // 8, wide[of[head]]
    for j in range(BITS):
        out[where + j * step] = np.add.reduceat(((values >> j) & 1) << (rank % 8), head)
    return out, bounds


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index every document and term of docs. Sizes of the corpus are counted first, then one pass writes the blocks: no shuffle, and a task
    holds one block. Weights of terms are left to the search, so that blocks need not be written anew as documents are added to df.

    Terms are the runs of letters, digits and characters beyond ASCII of whole texts, A-Z lower-cased. Null and empty texts hold none and
    are never found. Rows that repeat an id are documents of their own. An empty table gives an empty index. Other columns, whatever their
    names, are not read."""
    n_docs, n_words = corpus_size(docs, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, none = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            none = none or [pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.list_(batch.schema.field(0).type)]
            for lo, hi, buf, offs in text_slices(batch.column(1), BLOCK_BYTES, BLOCK_DOCS):
                ids = batch.column(0)[lo:hi]
                order = pc.sort_indices(ids).to_numpy()  # nulls last
                place = np.argsort(order)
                words, doc = words_of(LOWER[buf], offs, NOT_ALNUM)
                coded = words.dictionary_encode()
                key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * (hi - lo) + place[doc], return_counts=True)
                code, at = key // (hi - lo), key % (hi - lo)
                norm = _length_norm(np.bincount(place[doc], minlength=hi - lo).astype(np.int64), n_docs, n_words)
                df = np.bincount(code, minlength=len(coded.dictionary))
                bits, bounds = bitmaps(1_000_000_000 * tf // (1000 * tf + norm[at]), code, df)
                cuts = np.concatenate([[0], np.cumsum(df)])
                yield pa.RecordBatch.from_arrays([pa.array([number]), *[pa.nulls(1, t) for t in none[:4]], pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), ids.take(pa.array(order)))], names=names)
                for a in range(0, len(df), 1 << 14):
                    b = min(a + (1 << 14), len(df))
                    blobs = [binaries(v[c[a] : c[b]], (c[a : b + 1] - c[a]) * v.itemsize) for v, c in ((at.astype(np.uint16), cuts), (bits, bounds))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, number)), coded.dictionary[a:b], pa.array(df[a:b], pa.int32()), *blobs, pa.nulls(b - a, none[4])], names=names)
                number += 1

    names = ["block", "term", "df", "at", "bits", "ids"]
    rows = docs.select(id_col, text_col).mapInArrow(blocks, f"block long, term binary, df int, at binary, bits binary, ids array<{id_type}>")
    return Index(stored(rows, "impacts"), n_docs, n_words)


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term), each once; rows of one item are taken together."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch.column(1)):
                words, doc = words_of(LOWER[buf], offs, NOT_ALNUM)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].take(pa.array(doc)), words], names=["item", "term"])

    kind = items.schema[item_col].dataType.simpleString()
    return items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).mapInArrow(split, f"item {kind}, term binary").distinct()


def add_slices(acc: np.ndarray, at: np.ndarray, addend: np.ndarray, shift: int = 0) -> None:
    """acc[:, at] += addend << shift, numbers being sliced by bits along the first axis (64 of them a word): a ripple of sum and carry words. `at` holds no
    column twice."""
    carry = np.zeros(len(at), np.uint64)
    for j in range(shift, len(acc)):
        have = acc[j, at]
        if j - shift < len(addend):
            give = addend[j - shift]
            acc[j, at] = have ^ give ^ carry
            carry = (have & give) | (carry & (have ^ give))
        elif carry.any():
            acc[j, at] = have ^ carry
            carry = have & carry
        else:
            return


def weighted(slices: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Bit-sliced numbers times the weight of their word: shifted slices added up, for each bit that weights have."""
    top = int(weight.max(initial=0)).bit_length()
    out, at = np.zeros((len(slices) + top, slices.shape[1]), np.uint64), np.arange(slices.shape[1])
    for b in range(top):
        add_slices(out, at, slices & (((weight >> b) & 1).astype(np.uint64) * np.uint64(0xFFFFFFFFFFFFFFFF)), b)
    return out


def top_places(acc: np.ndarray, k: int) -> list[np.ndarray]:
    """For sums acc (slices, items, words): the places of each item's k highest above 0, equal ones by place. From the most significant slice
    down, the candidates that have the bit replace all others if they are more than k, and are sure if they are not."""
    maybe, sure = np.bitwise_or.reduce(acc, 0), np.zeros(acc.shape[1:], np.uint64)
    for bits in acc[::-1]:
        having = sure | (maybe & bits)
        many = (np.bitwise_count(having).sum(-1) > k)[:, None]
        maybe = np.where(many, maybe & bits, maybe & ~bits)
        sure = np.where(many, sure, having)
    out = []
    for s, m in zip(sure, maybe):
        s, m = (np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little")) for x in (s, m))
        out.append(np.concatenate([s, m[: k - len(s)]]))
    return out


def block_top(at: list, bits: list, weight: np.ndarray, items: list, docs: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, place, score) of the k best documents of a block for each item. at, bits, weight, items: of each term that is asked for
    its documents' places, bitmaps, weight and items."""
    n = np.array([len(a) // 2 for a in at])
    place = np.frombuffer(b"".join(at), np.uint16).astype(np.int64)
    raw = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8).reshape(BITS, -1), axis=1, bitorder="little", count=c) for b, c in zip(bits, n)], axis=1)
    wide = -(-docs // 64)
    of = np.repeat(np.arange(len(n)), n)
    head = np.flatnonzero(np.diff(of * wide + place // 64, prepend=-1))
    shift = (place % 64).astype(np.uint64)
    slices = np.stack([np.add.reduceat(r.astype(np.uint64) << shift, head) for r in raw])
    word, of = place[head] // 64, of[head]
    slices = weighted(slices, weight[of])
    first, words = np.searchsorted(of, np.arange(len(n))), np.bincount(of, minlength=len(n))
    asked, row = np.concatenate(items), np.repeat(np.arange(len(n)), [len(x) for x in items])
    order = np.argsort(asked, kind="stable")
    names, asked = np.unique(asked[order], return_inverse=True)
    row = row[order]
    turn = np.arange(len(asked)) - np.searchsorted(asked, asked)
    most = int(np.bincount(asked, weights=weight[row]).max()) << BITS
    acc = np.zeros((most.bit_length(), len(names) * wide), np.uint64)
    for t in range(int(turn.max()) + 1):  # a term of each item at a time
        i = np.flatnonzero(turn == t)
        src = places(first[row[i]], words[row[i]])
        add_slices(acc, np.repeat(asked[i] * wide, words[row[i]]) + word[src], slices[:, src])
    acc = acc.reshape(len(acc), len(names), wide)
    best = top_places(acc, k)
    item, at_ = np.repeat(np.arange(len(names)), [len(b) for b in best]), np.concatenate(best)
    got = (acc[:, item, at_ // 64] >> (at_ % 64).astype(np.uint64)) & np.uint64(1)
    return names[item], at_, (got.astype(np.int64) << np.arange(len(acc))[:, None]).sum(0)


def search(index: Index, items: DataFrame, k: int = 10, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(item_col, rank, id_col, score): the k documents of the index with the highest score above 0 for each item, equal scores by ascending
    id. A score sums weight x impact over the item's terms, once each; weights follow from the corpus's counts.

    Index rows of terms that are asked for are joined to (term, items) - the items dealt into chunks of about ITEMS items and TERMS terms - and
    grouped by block and chunk, so a group is at most a block's terms. There slices are multiplied and added by bitwise carry arithmetic, and the top
    k is found from the most significant slice down; blocks' winners are then ranked by item (each task keeps k of an item at most).

    Items of null or empty text, or whose terms no document holds, have no row; rows that repeat an item are taken together; a null item is
    an item. An empty index or table of items gives an empty result."""
    pairs = stored(item_terms(items, item_col, text_col), "asked")
    names = stored(pairs.select("item").distinct().withColumn("no", F.monotonically_increasing_id()), "items")
    n_items, n_pairs = names.count(), pairs.count()
    chunks = max(1, -(-n_items // ITEMS), -(-n_pairs // TERMS))
    pairs = pairs.withColumnRenamed("item", "__i").join(sized(names), F.col("__i").eqNullSafe(F.col("item"))).select("term", "no", F.pmod(F.xxhash64("no"), F.lit(chunks)).cast("int").alias("chunk"))
    terms = stored(pairs.select("term").distinct(), "terms")
    held = index.rows.select("term", "df").where(F.col("term").isNotNull()).join(sized(terms), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * index.docs + 2)) / (2 * F.col("df") + 1))).alias("weight")
    asked = stored(pairs.groupBy("chunk", "term").agg(F.collect_list("no").alias("items")).join(held.select("term", weight), "term"), "weights")
    hits = index.rows.select("block", "term", "at", "bits").join(sized(asked, "items"), "term").select("block", "chunk", "term", "at", "bits", "items", "weight")
    heads = index.rows.where(F.col("term").isNull()).select("block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "ids")
    grouped = hits.unionByName(heads, allowMissingColumns=True).repartition("block", "chunk").sortWithinPartitions("block", "chunk", F.col("ids").isNull(), "term")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, cut in runs(batches, ["block", "chunk"]):
            size = len(cols["block"])
            for lo, hi in zip(cut, [*cut[1:], size]):
                if hi - lo < 2:
                    continue
                ids = cols["ids"][lo].values
                lists = [cols["items"][i].values.to_numpy(zero_copy_only=False) for i in range(lo + 1, hi)]
                item, at, total = block_top(cols["at"][lo + 1 : hi].to_pylist(), cols["bits"][lo + 1 : hi].to_pylist(), cols["weight"][lo + 1 : hi].astype(np.int64), lists, len(ids), k)
                yield pa.RecordBatch.from_arrays([pa.array(item), ids.take(pa.array(at)), pa.array(total)], names=["no", "id", "score"])

    id_type = index.rows.schema["ids"].dataType.elementType.simpleString()
    best = grouped.mapInArrow(score, f"no long, id {id_type}, score long")
    rank = F.row_number().over(W.partitionBy("no").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    top = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(sized(names), "no").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
