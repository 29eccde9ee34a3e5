"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets target / source size copies on average. The whole part
is given outright; fractions are rounded by the pivotal method weighted by size: two
fractional documents trade mass, at random but so that the words they stand for stay
equal, until one of them is integral. The survivor of a group of documents meets the
survivors of other groups in a reduction tree, so a source's words end within one
document of its target.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import AT, ROW, Scratch, saved, spread_join, with_row
from tickloom.llm.sharding import BUCKET_ROWS, known_key, ranked

#: Fractional documents that one group rounds, on average, and survivors that meet in one node of the tree.
GROUP_ROWS = 8192
#: A document's copies, and a source's target, are at most so many times its size.
MOST_COPIES = 3


def n_words(text: str = "text") -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """Adds target to sources (source, source_size): shares of all sizes by weight, none above most * its size.

    Weights repeat over sources by code point, null last. Resharing what stopped sources
    leave until none is above its limit ends at one level per unit of weight; that level
    is found from prefix sums over sources in the order of limit / weight. One row for a
    source passes here.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.withColumn("i", F.row_number().over(order) - 1).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("i", F.lit(len(weights))) + 1).cast("int")).cast("long"))
    every, up = W.partitionBy(), W.orderBy(F.col("cap") / F.col("w"), "i").rowsBetween(W.unboundedPreceding, -1)
    held = listed.withColumn("cap", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    held = held.withColumn("cap_before", F.coalesce(F.sum("cap").over(up), F.lit(0))).withColumn("w_before", F.coalesce(F.sum("w").over(up), F.lit(0)))
    held = held.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
    held = held.withColumn("open", F.col("level") * F.col("w") < F.col("cap"))
    held = held.withColumn("common", F.max(F.when(F.col("open"), F.struct((-F.col("cap") / F.col("w")).alias("k"), (-F.col("i")).alias("j"), F.col("level").alias("level")))).over(every)["level"])
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("common").isNull(), F.col("cap")).otherwise(F.least(F.col("cap").cast("double"), F.col("common") * F.col("w")))
    return held.select(*sizes.columns, target.cast("double").alias("target"))


def _draw(seed: int, a: int, b: int) -> float:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{a}:{b}".encode(), digest_size=8).digest(), "big") / 2.0**64


def pivot(keys: np.ndarray, sizes: np.ndarray, shares: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Rounds shares to 0 or 1 in the given order, all but one; (shares, index of the one left fractional or -1).

    Of two documents with fractions p and q and sizes a and b, mass moves so that
    a p + b q stays; either of the two end points is chosen so that the expected values
    of p and q stay too.
    """
    out, open_ = shares.copy(), -1
    near = 1e-9
    for i in range(len(out)):
        if out[i] <= near or out[i] >= 1 - near:
            out[i] = round(out[i])
            continue
        if open_ < 0:
            open_ = i
            continue
        a, b, p, q = sizes[open_], sizes[i], out[open_], out[i]
        up = min((1 - p) * a, q * b)  # words that can move from i to open_
        down = min(p * a, (1 - q) * b)
        move = up if _draw(seed, int(keys[open_]), int(keys[i])) * (up + down) < down else -down
        p, q = p + move / a, q - move / b
        out[open_], out[i] = p, q
        free = [k for k in (open_, i) if near < out[k] < 1 - near]
        for k in (open_, i):
            if k not in free:
                out[k] = round(out[k])
        open_ = free[0] if free else -1
    return out, open_


def rounded(rows: DataFrame, by: str, seed: int, scratch: Scratch, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(row, extra) with extra 0 or 1 for rows of (row, key, by, size, share) with 0 < share < 1 and size > 0; by is never null.

    row tells rows apart; key, a hash of what a row holds and of its number among equal
    rows, settles groups, order and draws.

    Level 0 rounds groups dealt by hash; each level above rounds the survivors of up to
    group_rows groups, until one group is left in every stratum; the last survivor is
    settled by its own draw. Each level is a table, so that nothing is drawn twice.
    """
    counts = scratch.saved(rows.groupBy(by).agg(F.count("*").alias("n")).withColumn("groups", F.ceil(F.col("n") / group_rows)), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    level = spread_join(rows, counts, by, "n", total).withColumn("grp", F.pmod(F.xxhash64("key", F.lit(seed)), "groups"))
    made = None

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "row"], kind="stable")
        group = group.iloc[np.argsort([_draw(seed, k, -1) for k in group["key"]], kind="stable")]
        keys, sizes = group["key"].to_numpy(np.int64), group["size"].to_numpy(float)
        share, left = pivot(keys, sizes, group["share"].to_numpy(float), seed)
        if left >= 0 and group["groups"].iloc[0] == 1:
            share[left], left = float(_draw(seed, int(keys[left]), -2) < share[left]), -1
        out = group.assign(share=share, open=False)
        out.iloc[left if left >= 0 else 0, out.columns.get_loc("open")] = left >= 0
        return out

    while True:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in level.schema) + ", open boolean"
        done = scratch.saved(level.groupBy(by, "grp").applyInPandas(work, schema), "rounded")
        final = done.where("not open").select("row", F.col("share").cast("int").alias("extra"))
        made = final if made is None else made.unionByName(final)
        rest = done.where("open").drop("open")
        if rest.isEmpty():
            return made
        level = rest.withColumn("grp", F.floor(F.col("grp") / group_rows)).withColumn("groups", F.ceil(F.col("groups") / group_rows))


def _copies(docs: DataFrame, keep: Column, weights: tuple[int, ...], seed: int, group_rows: int) -> DataFrame:
    """(kept, size, source_size, target, copies) of every row, as a table."""
    with Scratch(docs.sparkSession) as scratch:
        narrow = docs.select(keep.alias("kept"), "source", known_key(F.col("source")).alias("by"), n_words().alias("size"), F.xxhash64("doc_id", "source", "text").alias("key"))
        narrow = scratch.saved(narrow.withColumn("row", F.monotonically_increasing_id()), "sized")
        # Equal rows are interchangeable, so their numbers may follow the files; with them in the key no group gets all of them.
        numbers = ranked(narrow.select("row", "key"), ["key"], ["row"], F.floor(F.col("row") / BUCKET_ROWS), "nth")
        numbers = numbers.where("nth > 1").select("row", F.xxhash64("key", "nth").alias("own"))
        narrow = narrow.join(numbers, "row", "left").withColumn("key", F.coalesce("own", "key")).drop("own")
        per = targets(narrow.groupBy("source", "by").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights).drop("source")
        per = scratch.saved(per, "targets")
        all_ = spread_join(narrow, per, "by", "n", per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        mean = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        all_ = all_.withColumn("whole", F.floor(mean + 1e-12)).withColumn("share", F.greatest(mean - F.floor(mean + 1e-12), F.lit(0.0)))
        extra = rounded(all_.where("share > 0").select("row", "key", "by", "size", "share"), "by", seed, scratch, group_rows)
        out = all_.join(extra, "row", "left")
        return saved(out.select("kept", "size", "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies")), "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 29, keep: list[str] | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """`keep` columns of docs (doc_id, source, text) with size, source_size, target and taken (size * copies) of every row.

    Size is the number of words, 0 for a null text; a row without words is never taken.
    Rows of equal doc_id and text are rounded each on their own, by their number. An empty
    table gives no rows; a text of any length is counted whole by an expression. Sources
    are ranked by one task, a row for each. The draws come from hashes of what a row holds, so reruns agree
    whatever the partitions. A kept column that is named like one of these four is
    refused.
    """
    keep = keep or ["doc_id"]
    if clash := {"size", "source_size", "target", "taken"}.intersection(c.lower() for c in keep):
        raise ValueError(f"columns of the result cannot be kept too: {sorted(clash)}")
    out = _copies(docs, F.struct(*keep), weights, seed, group_rows)
    return out.select("kept.*", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def take(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 29, group_rows: int = GROUP_ROWS, row: Column | None = None) -> DataFrame:
    """The mix itself: each row of docs, with all of its columns whatever their names, as often as it is taken.

    Nulls, repeated rows and empty tables as in mix; columns named __tickloom_row and
    __tickloom_at are reserved. Only row keys, sizes and sources are
    drawn upon; the documents move once, to their copies. `row` tells rows apart (see
    file_row); without it docs is written first.
    """
    own = with_row(docs, row)
    copies = _copies(own, F.struct(ROW), weights, seed, group_rows).where("copies > 0").select(F.col(f"kept.{ROW}").alias(ROW), F.col("copies").alias(AT))
    taken = own.hint("merge").join(copies, ROW)
    return taken.withColumn(AT, F.explode(F.array_repeat(F.lit(0), F.col(AT).cast("int")))).select(docs.columns)
