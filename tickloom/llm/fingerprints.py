"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each shingle is hashed once; the top bits of the hash name one of BINS bins and each bin
keeps its least hash. An empty bin borrows from the first full bin among the bins that
its own fixed random sequence names (optimal densification). The low BITS bits of each bin are
packed; two fingerprints' share of equal entries, corrected for chance agreement,
estimates the Jaccard likeness of the shingle sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import saved

BIN_BITS, BITS, SIZE = 7, 4, 5
BINS = 1 << BIN_BITS
#: Bins that an empty bin tries one by one before it takes the full bin that comes first in its own order of all bins.
TRIES = 8
#: Neighbouring documents meet in cells of ids: about so many documents each, and about so many cells at most.
CELL_ROWS, CELLS = 1000, 65_536


def with_fingerprint(df: DataFrame, text: str, into: str) -> DataFrame:
    """Adds the fingerprint of a text column: hexadecimal digits, one for each bin's low bits.

    Words are runs outside [\\x20\\x09-\\x0D] of the lower-cased text; shingles are five
    words, or the whole sequence of fewer. A null text and one without words have the
    empty fingerprint. Each step is a column of its own, so that none is evaluated again
    inside another's loop.
    """
    bin_of = lambda x: F.shiftright(x, 63 - BIN_BITS)
    plan = df.withColumn("__w", F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), lambda w: w != ""))
    plan = plan.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w))).drop("__w")
    at = lambda _, i: F.shiftrightunsigned(F.xxhash64(F.slice("__h", i + 1, SIZE)), 1)
    many = F.transform(F.slice("__h", 1, F.greatest(F.size("__h") - (SIZE - 1), F.lit(0))), at)
    whole = F.array(F.shiftrightunsigned(F.xxhash64("__h"), 1))
    plan = plan.withColumn("__s", F.sort_array(F.when(F.size("__h") >= SIZE, many).otherwise(whole)))
    first = lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get("__s", i - 1)))
    plan = plan.withColumn("__m", F.filter("__s", first)).withColumn("__k", F.size("__h")).drop("__s", "__h")
    plan = plan.withColumn("__b", F.transform("__m", bin_of))
    full = lambda b: F.get("__m", F.array_position("__b", b).cast("int") - 1)
    tried = lambda b: [full(F.pmod(F.xxhash64(b, F.lit(k)), F.lit(BINS))) for k in range(TRIES)]
    nearest = lambda b: F.array_min(F.transform("__m", lambda x: F.struct(F.xxhash64(b, bin_of(x)).alias("order"), x.alias("x"))))["x"]
    filled = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), lambda b: F.coalesce(full(b), *tried(b), nearest(b)))
    digits = F.array_join(F.transform(filled, lambda x: F.substr(F.lit("0123456789abcdef"), (x.bitwiseAND(F.lit(15)) + 1).cast("int"), F.lit(1))), "")
    return plan.withColumn(into, F.when(F.col("__k") == 0, "").otherwise(digits)).drop("__m", "__b", "__k")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints, 0 to 1, free of chance agreement; two empty ones are alike, one empty is not."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))))
    chance = 1 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), (same / F.lit(BINS) - chance) / (1 - chance))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(estimate)


def with_cell(rows: DataFrame, key: str, tie: str, cell_rows: int) -> DataFrame:
    """Adds __cell, a number that ascends with key and then tie, both 64-bit integers, null keys first; about cell_rows rows have the same.

    Cells that hold more are cut by equal width between their own least and greatest key
    (or tie, where all keys are equal) again and again, so it does not matter how keys
    are spread; only rows that are equal in both stay together. A round's table of cells
    has a few times CELLS rows at most.
    """
    goal = max(cell_rows, rows.count() // CELLS)
    out = rows.withColumn("__cell", F.col(key).isNotNull().cast("long"))
    for column in (key, tie):
        while True:
            stats = out.groupBy("__cell").agg(F.count("*").alias("n"), F.min(column).alias("__low"), F.max(column).alias("high"))
            stats = stats.withColumn("__parts", F.when((F.col("n") > goal) & (F.col("__low") < F.col("high")), F.ceil(F.col("n") / goal)).otherwise(F.lit(1)).cast("long"))
            stats = stats.withColumn("__base", F.sum("__parts").over(W.orderBy("__cell")) - F.col("__parts")).withColumn("__span", F.try_subtract("high", "__low"))
            stats = saved(stats, "cells")
            if stats.where("__parts > 1").isEmpty():
                break
            rough = (F.col(column).cast("double") - F.col("__low").cast("double")) / (F.col("high").cast("double") - F.col("__low").cast("double"))
            share = F.when(F.col("__parts") == 1, 0.0).when(F.col("__span").isNull(), rough).otherwise(F.try_subtract(column, "__low") / F.col("__span"))
            out = out.join(F.broadcast(stats.drop("n")), "__cell")
            out = out.withColumn("__cell", F.col("__base") + F.least(F.floor(share * F.col("__parts")), F.col("__parts") - 1)).drop("__low", "high", "__parts", "__base", "__span")
    return out


def with_next(docs: DataFrame, key: str, columns: list[str], tie: list[str], cell_rows: int = CELL_ROWS) -> DataFrame:
    """Adds next_<column> from the next row in descending order of key; after the last row comes the first.

    Rows meet in cells of neighbouring keys; each cell also gets a copy of the first row
    of the cell that follows, found in a table of all cells. So each row moves once, and
    a cell is one window's work. Null keys come last; equal keys follow each other by a
    hash of the columns `tie`, equal rows in any order. An empty table gives no rows.
    """
    placed = with_cell(docs.withColumn("__tie", F.xxhash64(*tie)), key, "__tie", cell_rows)
    lead = placed.groupBy("__cell").agg(F.max(F.struct(key, "__tie")).alias("top"))
    down = W.orderBy(F.col("__cell").desc())
    lead = lead.withColumn("to", F.coalesce(F.lag("__cell").over(down), F.min("__cell").over(W.partitionBy())))
    lead = lead.select(F.col(f"top.{key}").alias("__key"), F.col("top.__tie").alias("__top"), "to")
    both = placed.join(F.broadcast(lead), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__tie") == F.col("__top")), "left")
    own, guest = F.struct(F.col("__cell").alias("cell"), F.lit(False).alias("guest")), F.struct(F.col("to").alias("cell"), F.lit(True).alias("guest"))
    both = both.withColumn("__at", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, guest)))).drop("__key", "__top", "to", "__cell")
    w = W.partitionBy("__at.cell").orderBy("__at.guest", F.col(key).desc_nulls_last(), F.col("__tie").desc())
    return both.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where(~F.col("__at.guest")).drop("__at", "__tie")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text of docs (doc_id, text) and of its edited text, with their likeness, and that of the next document's.

    A null text is empty. Null ids come last, rows of equal id in order of a hash of
    their texts; a repeated row has its copy as the next document. A single row is its
    own next one; an empty table gives no rows. Other columns of docs do not matter.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marked = with_next(with_fingerprint(base, "text", "fingerprint"), "doc_id", ["text", "fingerprint"], ["text"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    out = marked.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("next_fingerprint").alias("after"))
    out = with_fingerprint(out, "edited", "edited_fingerprint")
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("after")).alias("near_next"))
