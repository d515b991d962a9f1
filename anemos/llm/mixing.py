"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 7)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anemos.llm._common import Aside, checkpointed, sized

#: Blocks of a source, and sub-blocks of the block in which its quota ends. Both bound what one window sorts.
BLOCKS = 1024
#: Groups of sources, by hash, whose units are split on the driver; those of a group's sources are split in a task.
GROUPS = 1024
#: Rows of a small table that is broadcast; a longer one is joined by a shuffle.
BROADCAST = 200_000


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _part(id_text: Column, seed: str, which: int) -> Column:
    """Block number from 16 bits of a digest of the id."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(id_text, F.lit(""))))
    return F.pmod(F.conv(F.substring(digest, 1 + 4 * which, 4), 16, 10).cast("int"), F.lit(BLOCKS))


@dataclass
class Mix:
    """The plan of a mix: `sources` (source, source_size, target, full: whole epochs), `blocks` (how often each block is
    taken in whole, and its place in the permutation) and `subs` (sub-blocks taken once more)."""

    sources: DataFrame
    blocks: DataFrame
    subs: DataFrame
    seed: str


def targets(sizes: DataFrame, pattern: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes (source, source_size) with weight and target. Sources in code point order, null last, weigh `pattern` in turn
    and share all words; a target stops at `most` times its source's size and the excess is shared anew by weight. The level
    at which that settles is read off the sources in order of cap per weight. The windows see one row per source."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    n = len(pattern)
    w = F.element_at(F.array(*[F.lit(x) for x in pattern]), (F.pmod(F.row_number().over(order) - 1, F.lit(n)) + 1).cast("int"))
    fill = W.orderBy("ratio", F.col("source").asc_nulls_last())
    t = sizes.withColumn("weight", w.cast("long")).withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = W.partitionBy()
    t = (
        t.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("left", F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
        .withColumn("settled", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("level").alias("level"))))
        .withColumn("settled", F.min("settled").over(everything))
    )
    share = F.col("weight") * F.col("settled.level")
    return t.select("source", "source_size", "weight", F.when(F.col("settled.level") < F.col("ratio"), share).otherwise(F.col("cap").cast("double")).alias("target"))


def plan_mix(docs: DataFrame, seed: str = "mix:", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Sizes are summed by source, block and sub-block in one pass with partial sums; all else is derived from those sums."""
    d = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *_blocks(id_col, text_col, seed))
    sums = checkpointed(d.groupBy("source", "b1", "b2").agg(F.sum("size").alias("words")))
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    sources = checkpointed(targets(sizes).withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")))
    same = lambda t: sized(t.withColumnRenamed("source", "of"), most=BROADCAST)
    ranked = sums.groupBy("source", "b1").agg(F.sum("words").alias("words")).withColumn("rank", F.row_number().over(W.partitionBy("source").orderBy(F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit("")), F.lit("/"), F.col("b1").cast("string"))), "b1")))
    up_to = W.partitionBy("source").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    by_size = W.partitionBy("source", "whole").orderBy("words", "b1").rowsBetween(W.unboundedPreceding, 0)
    each = W.partitionBy("source")
    b = ranked.withColumn("cum", F.sum("words").over(up_to)).join(same(sources).select("of", "full", "rest"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    b = b.withColumn("whole", F.col("cum") <= F.col("rest")).withColumn("ends", ~F.col("whole") & (F.col("cum") - F.col("words") <= F.col("rest")))
    b = b.withColumn("room", F.col("rest") - F.coalesce(F.sum(F.when(F.col("whole"), F.col("words"))).over(each), F.lit(0)))
    b = b.withColumn("fits", ~F.col("whole") & (F.sum("words").over(by_size) <= F.col("room")))
    b = b.withColumn("room", F.col("room") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("words"))).over(each), F.lit(0)))
    b = b.withColumn("chosen", F.col("whole") | F.col("fits")).withColumn("unit", F.row_number().over(each.orderBy(F.when(F.col("chosen") | F.col("ends"), 0).otherwise(1), "rank")))
    blocks = checkpointed(b.select("source", "b1", "unit", "full", "chosen", "ends", "room"))
    ends = blocks.where("ends").select(F.col("source").alias("of"), F.col("b1").alias("of_b1"), "room")
    inner = sums.join(sized(ends, most=BROADCAST), F.col("source").eqNullSafe(F.col("of")) & (F.col("b1") == F.col("of_b1")))
    step = W.partitionBy("source").orderBy("words", "b2").rowsBetween(W.unboundedPreceding, 0)
    subs = checkpointed(inner.withColumn("cum", F.sum("words").over(step)).where("cum <= room").select("source", "b1", "b2"))
    return Mix(sources, blocks, subs, seed)


def _blocks(id_col: str, text_col: str, seed: str) -> list[Column]:
    text = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("no id "), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    return [_part(text, seed, 0).alias("b1"), _part(text, seed, 1).alias("b2")]


def split_tree(units: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards x sources) units of each source for each shard: at each node the units of its left half are drawn without
    replacement from the node's, so every shard has its exact share of all units and every source is used up exactly."""
    if shards == 1:
        return units[None, :]
    left = shards // 2
    total = int(units.sum())
    take = rng.multivariate_hypergeometric(units, total * left // shards, method="marginals") if total else units
    return np.concatenate([split_tree(take, left, rng), split_tree(units - take, shards - left, rng)])


def shard_bounds(units: DataFrame, shards: int, seed: str) -> DataFrame:
    """(of, bounds): for each source of units (source, n) how many of its units lie in shards up to each one, as the splitting tree draws
    them. The tree's first branches split the units of groups of sources, at most GROUPS of them, on the driver; the last ones those of each
    source of a group, in a task. The draws of the parts of a hypergeometric draw are hypergeometric too."""
    units = units.withColumn("grp", F.pmod(F.xxhash64(F.coalesce("source", F.lit("no source"))), F.lit(GROUPS)).cast("int"))
    totals = {r["grp"]: r["n"] for r in units.groupBy("grp").agg(F.sum("n").alias("n")).collect()}
    first = int.from_bytes(seed.encode()[:8].ljust(8), "big")
    groups = sorted(totals)
    quotas = split_tree(np.array([totals[g] for g in groups], np.int64), shards, np.random.default_rng(first)) if groups else np.zeros((shards, 0), np.int64)
    of_group = units.sparkSession.createDataFrame([(g, [int(x) for x in quotas[:, i]]) for i, g in enumerate(groups)], "grp int, quotas array<long>")

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source", na_position="last", kind="stable")
        rng = np.random.default_rng([first % (1 << 32), int(rows["grp"].iloc[0])])
        left, taken = rows["n"].to_numpy().astype(np.int64), np.zeros(len(rows), np.int64)
        bounds = []
        for quota in rows["quotas"].iloc[0]:
            draw = rng.multivariate_hypergeometric(left, int(quota), method="marginals") if quota else np.zeros(len(rows), np.int64)
            left, taken = left - draw, taken + draw
            bounds.append(taken)
        return pd.DataFrame({"of": rows["source"].to_numpy(), "bounds": [[int(x) for x in b] for b in np.stack(bounds, 1)]})

    return units.join(F.broadcast(of_group), "grp").groupBy("grp").applyInPandas(split, "of string, bounds array<long>")


def mix_sources(docs: DataFrame, shards: int = 8, seed: str = "mix:", most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs' columns plus mix_size (words), mix_source_size, mix_target, mix_times (0 to `most`), mix_taken and mix_shards
    (output shard of each time). A document is taken whole, 0 to `most` times.

    Each source is cut into at most 1,024 blocks by a digest of the id; its quota is so many whole epochs and, of one more
    epoch, the blocks of a permutation that still fit in turn, then those of the rest that fit by size, then sub-blocks of the
    block at which the turn ended. A taken block is a unit; units per source are split among the shards by a tree of multivariate
    hypergeometric draws, and each shard gets the next units of the source's permutation. A document is taken as often as its
    block was drawn for a shard. So reruns agree, whatever the partitioning. The tables of sources and blocks are broadcast
    where they are small; otherwise documents are joined by source and block.

    Null text: 0 words. Null source: a source of its own, last. A null id: its text's digest stands for it. Empty table: empty result.
    Rows of one id are taken alike. A document of 0 words goes with its block. Input columns that start with `mix_` are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    plan = plan_mix(docs, seed, id_col, text_col, source_col)
    units = plan.blocks.groupBy("source").agg(F.sum(F.col("full") + (F.col("chosen") | F.col("ends")).cast("int")).cast("long").alias("n"))
    bounds = sized(checkpointed(shard_bounds(units, shards, seed)), most=BROADCAST)
    units_of = plan.blocks.withColumn("n_blocks", F.count(F.lit(1)).over(W.partitionBy("source"))).join(bounds, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    shard = lambda unit: F.when(unit < F.element_at("bounds", -1), F.size(F.filter("bounds", lambda b: b <= unit)))
    drawn = F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda e: shard((e * F.col("n_blocks") + F.col("unit") - 1).cast("long"))))
    info = sized(plan.sources.select(F.col("source").alias("of"), "source_size", "target"), most=BROADCAST)
    key = lambda source, block: F.struct(F.col(source).alias("s"), F.col(block).alias("b"))
    table = units_of.join(info, F.col("source").eqNullSafe(F.col("of"))).select(
        key("source", "b1").alias("mix_k"), F.col("ends").alias("mix_ends"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), drawn.alias("mix_drawn")
    )
    table = checkpointed(table)
    subs = checkpointed(plan.subs.select(key("source", "b1").alias("mix_sub_k"), F.col("b2").alias("mix_sub"), F.lit(True).alias("mix_hit")))
    b1, b2 = _blocks(id_col, text_col, seed)
    keyed = docs.withColumns({"mix_size": word_count(F.col(text_col)), "mix_b1": b1, "mix_b2": b2})
    d = keyed.join(sized(table, most=BROADCAST), F.col("mix_k").eqNullSafe(key(source_col, "mix_b1")))
    d = d.join(sized(subs, most=BROADCAST), F.col("mix_ends") & F.col("mix_sub_k").eqNullSafe(F.col("mix_k")) & (F.col("mix_sub") == F.col("mix_b2")), "left")
    last_missed = (F.col("mix_ends") & F.col("mix_hit").isNull()).cast("int")  # of the block at which the turn ended, only some sub-blocks are in the last epoch
    taken = F.slice("mix_drawn", F.lit(1), F.greatest(F.size("mix_drawn") - last_missed, F.lit(0)))
    out = d.select(*[F.col(f"`{c}`") for c in docs.columns], "mix_size", "mix_source_size", "mix_target", taken.alias("mix_shards"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "mix_size", "mix_source_size", "mix_target", F.size("mix_shards").alias("mix_times"), (F.col("mix_size") * F.size("mix_shards")).alias("mix_taken"), "mix_shards")


def draw_mix(docs: DataFrame, **options) -> DataFrame:
    """docs with each document as many times as the mix takes it, columns as in docs whatever their names, dealt to the mix's shards and shuffled
    within each by a digest of id and time."""
    id_col = options.get("id_col", "doc_id")
    aside = Aside(docs, [id_col, options.get("text_col", "text"), options.get("source_col", "source")])
    mixed = mix_sources(aside.docs, **options)
    one = mixed.select("*", F.posexplode("mix_shards").alias("mix_time", "mix_shard")).withColumn("mix_order", F.xxhash64(id_col, "mix_time"))
    dealt = one.repartition(F.col("mix_shard"), F.pmod("mix_order", F.lit(64))).sortWithinPartitions("mix_shard", "mix_order")
    return dealt.select(*aside.back())
