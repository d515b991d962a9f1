"""Importance resampling of documents towards a target distribution by bucket-partitioned inverted postings (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anemos.llm._common import LOWER, NOT_ALNUM, binaries, crc32s, ranked, runs, sized, stored, text_slices, word_spans

#: Groups that buckets are dealt to; a group's postings are parted further by slices of documents.
GROUPS = 64
#: Bytes of postings of one group that a task takes at a time.
PART_BYTES = 32 << 20


def features(buf: np.ndarray, offs: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, CRC-32) of each feature of a slice, runs of 1 to `longest` words joined by one space, and the number of words of each text."""
    start, end, doc = word_spans(buf, offs, NOT_ALNUM)
    words = np.bincount(doc, minlength=len(offs) - 1)
    if not len(start):
        return doc, np.zeros(0, np.uint32), words
    gap = NOT_ALNUM[buf]
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]  # one separator after each word
    flat = np.where(gap, np.uint8(32), LOWER[buf])[keep]
    at = np.cumsum(keep) - 1
    start, end = at[start], at[end - 1] + 1
    docs, codes = [], []
    for n in range(1, longest + 1):
        i = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :])
        docs.append(doc[i])
        codes.append(crc32s(flat, start[i], end[i + n - 1]))
    return np.concatenate(docs), np.concatenate(codes), words


def postings(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """The inverted postings of texts (columns id, text), in three kinds of rows. 0: a slice's documents (ids, words, features). 1: for a slice
    and a group of buckets the postings (document's number in the slice, bucket's number in the group, count), by document. 2: for a
    partition and a group the sums of counts of the group's buckets, which are added here so that no posting is shuffled for them."""
    kind = texts.schema["id"].dataType.simpleString()
    lanes = -(-buckets // GROUPS)
    schema = f"kind int, slice long, grp int, ids array<{kind}>, words array<long>, features array<long>, doc binary, lane binary, n binary, sums array<long>"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, total, none = TaskContext.get().partitionId() << 32, np.zeros((GROUPS, lanes), np.int64), None
        types = None
        for batch in batches:
            types = types or [pa.int32(), pa.int64(), pa.int32(), pa.list_(batch.schema.field(0).type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            for lo, hi, buf, offs in text_slices(batch.column(1), 4 << 20):
                doc, code, words = features(buf, offs, longest)
                bucket = (code % np.uint32(buckets)).astype(np.int64)
                # keys in the order of groups, documents, buckets of the group
                key, n = np.unique(((bucket % GROUPS) * (hi - lo) + doc) * lanes + bucket // GROUPS, return_counts=True)
                group, doc_, lane = key // lanes // (hi - lo), key // lanes % (hi - lo), key % lanes
                np.add.at(total, (group, lane), n)
                counts = np.bincount(doc, minlength=hi - lo)
                head = [pa.array([v], t) for v, t in zip((0, number, -1), types)] + [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), v) for v in (batch.column(0)[lo:hi], pa.array(words, pa.int64()), pa.array(counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*head, *[pa.nulls(1, t) for t in types[6:]]], names=names)
                cut = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
                g = group[cut[:-1]]
                blobs = [binaries(v.astype(t), cut * np.dtype(t).itemsize) for v, t in ((doc_, np.uint16), (lane, np.uint32), (n, np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), 1), pa.int32()), pa.array(np.full(len(g), number), pa.int64()), pa.array(g, pa.int32()), *[pa.nulls(len(g), t) for t in types[3:6]], *blobs, pa.nulls(len(g), types[9])], names=names)
                number += 1
        if types and total.any():
            sums = pa.ListArray.from_arrays(pa.array(np.arange(GROUPS + 1) * lanes, pa.int32()), pa.array(total.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(GROUPS, 2), pa.int32()), pa.nulls(GROUPS, pa.int64()), pa.array(np.arange(GROUPS), pa.int32()), *[pa.nulls(GROUPS, t) for t in types[3:9]], sums], names=names)

    names = [part.split()[0] for part in schema.split(", ")]
    return texts.select("id", "text").mapInArrow(count, schema)


def _sums(post: DataFrame, name: str) -> DataFrame:
    return post.where("kind = 2").select("grp", F.posexplode("sums").alias("lane", "n")).where("n > 0").groupBy("grp", "lane").agg(F.sum("n").alias(name))


def _contribute(buckets: int, big_s: int, big_t: int):
    """Of each posting block with its buckets' counts in both corpora: what each document gains in the group."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {k: batch.column(k) for k in batch.schema.names}
            outs, ends, docs = [], [0], []
            for i in range(batch.num_rows):
                lane, n, doc = (np.frombuffer(cols[k][i].as_buffer(), t).astype(np.int64) for k, t in (("lane", np.uint32), ("n", np.uint32), ("doc", np.uint16)))
                s, t = (np.array(cols[k][i].values, np.float64) for k in ("s", "t"))
                gain = np.floor(1000 * np.log((t + 1) * (big_s + buckets) / ((s + 1) * (big_t + buckets)))).astype(np.int64)
                at = np.searchsorted(np.array(cols["lanes"][i].values, np.int64), lane)
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                outs.append(np.add.reduceat(gain[at] * n, first))
                docs.append(doc[first].astype(np.uint16))
                ends.append(ends[-1] + len(first))
            ends = np.array(ends, np.int64)
            sums, docs = np.concatenate([np.zeros(0, np.int64), *outs]), np.concatenate([np.zeros(0, np.uint16), *docs])
            yield pa.RecordBatch.from_arrays([cols["slice"], binaries(docs, 2 * ends), binaries(sums, 8 * ends)], names=["slice", "doc", "gained"])

    return per_batch


def _reduce(id_type: str):
    """The weights of each slice's documents: contributions of all groups added up, by their number of features."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, at in runs(batches, ["slice"]):
            size = len(cols["slice"])
            for lo, hi in zip(at, [*at[1:], size]):
                if lo == size:
                    break
                ids, words, n = (cols[k][lo].values for k in ("ids", "words", "features"))  # the row of documents comes first
                gained = np.zeros(len(ids), np.int64)
                for i in range(lo + 1, hi):
                    gained[np.frombuffer(cols["doc"][i].as_buffer(), np.uint16)] += np.frombuffer(cols["gained"][i].as_buffer(), np.int64)
                n = np.array(n, np.int64)
                weight = np.where(n > 0, np.floor_divide(gained, np.maximum(n, 1)), 0)
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(n), pa.array(weight)], names=["id", "words", "n_features", "weight"])

    return per_task, f"id {id_type}, words long, n_features long, weight long"


def importance(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, least_words: int = 20, seed: str = "2024:", id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(id_col, n_features, weight, score, rank) of every row of docs: how much likelier its features are in the texts of `target`, and its
    rank in a Gumbel top-k draw of `percent` of those with `least_words`, null where it is not drawn.

    A feature is a run of 1 to `longest` words (letters, digits, characters beyond ASCII; A-Z lower-cased) and falls into a bucket by its
    CRC-32. Postings (bucket, document, count) are written in blocks, a slice of documents and a group of buckets each, then
    shuffled by group; beside each group stand its buckets' counts in both corpora, of which the gains are worked out there; contributions go back to
    the slice and are added up by document. A group of many postings (one word may fill a third of all texts) is parted by slices, its
    counts (a bounded table of `buckets` rows) going to each part.

    Null and empty texts have no feature, weight 0, and are never drawn while least_words > 0; texts are taken whole. An empty target gives
    gains from the documents' counts alone. The noise hangs on the id alone: rows of one id share it (null counts as an empty id) and
    are each scored and ranked. Equal scores rank by smaller id, null last; then as the rows lie. An empty table gives an empty result. Other columns,
    whatever their names, are not read."""
    if not 0 <= percent <= 100 or longest < 1 or not 1 <= buckets < 1 << 31:
        raise ValueError("percent must be 0 to 100, longest at least 1, buckets 1 to 2^31")
    post = stored(postings(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), buckets, longest), "postings")
    other = postings(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), buckets, longest)
    counts = stored(_sums(post, "s").join(_sums(other, "t"), ["grp", "lane"], "full").na.fill(0, ["s", "t"]), "buckets")
    big_s, big_t = (int(x or 0) for x in counts.agg(F.sum("s"), F.sum("t")).first())
    held = post.where("kind = 1").agg(F.sum(F.octet_length("doc") + F.octet_length("lane") + F.octet_length("n"))).first()[0] or 0
    parts = max(1, -(-held // (GROUPS * PART_BYTES)))
    groups = counts.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("lane", "s", "t"))).alias("c"))  # buckets / GROUPS to each
    groups = groups.select("grp", *[F.col(f"c.{k}").alias(a) for k, a in (("lane", "lanes"), ("s", "s"), ("t", "t"))], F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    blocks = post.where("kind = 1").select("slice", "grp", F.pmod(F.xxhash64("slice"), F.lit(parts)).cast("int").alias("part"), "doc", "lane", "n")
    gained = blocks.join(groups.hint("merge"), ["grp", "part"]).select("slice", "doc", "lane", "n", "lanes", "s", "t").mapInArrow(_contribute(buckets, big_s, big_t), "slice long, doc binary, gained binary")
    heads = post.where("kind = 0").select("slice", "ids", "words", "features", F.lit(None).cast("binary").alias("doc"), F.lit(None).cast("binary").alias("gained"))
    back = heads.unionByName(gained, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", F.col("ids").isNull())
    reduce, schema = _reduce(docs.schema[id_col].dataType.simpleString())
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(back.mapInArrow(reduce, schema).withColumn("score", F.col("weight") + noise), "importance")
    enough = F.col("words") >= least_words
    quota = scored.where(enough).count() * percent // 100
    drawn = ranked(scored.where(enough), [F.col("score").desc(), F.col("id").asc_nulls_last()], "rank").withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    every = drawn.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return every.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, all columns, whose id importance() draws: a sample without replacement that looks like `target`. Rows of one id come
    together, if any of them is drawn; rows without an id are not drawn."""
    drawn = importance(docs, target, percent, id_col=id_col, **options).where(F.col("rank").isNotNull()).select(id_col).distinct()
    return docs.join(sized(stored(drawn, "drawn")), id_col, "left_semi")
