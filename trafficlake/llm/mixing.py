"""Mixing sources to target weights by capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

#: A word, by the ASCII white space around it.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
_BINS = 4096


def rank_sources(sources: DataFrame) -> DataFrame:
    """Add ``place``: 0 for the first source in code point order, null last.

    Sources are dealt out by ranges; a range's places start after those of all ranges before it, so no task sorts
    them all.
    """
    ranged = sources.withColumn("_null", F.col("source").isNull()).repartitionByRange("_null", "source")
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()), "sources")
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy("_null", "source")) - 1
    return ranged.withColumn("_own", own).join(before, "_part").withColumn("place", F.col("_before") + F.col("_own")).drop("_part", "_null", "_own", "_before")


def water_fill(sources: DataFrame, total_share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Targets of ``sources`` (source, source_size, weight): weights' shares of ``total_share`` times all sizes.

    A source above ``max_epochs`` times its size is clamped there; what it leaves goes to the others by weight,
    until none is above. Each round is one aggregation; the level only rises, so sources clamped once stay so.
    Sources of size 0 have target 0, and no sources give no rows.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * total_share
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) >= cap
        n, held, weight = sources.agg(
            F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == clamped:
            break
        clamped = n
        if weight > 0:
            level = max(level, (total - held) / weight)
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, keep: tuple[str, ...] = ()
) -> DataFrame:
    """How often the mix takes each row of ``docs`` (doc_id, text, source).

    Columns: doc_id, size (words; null text 0), source_size, target, copies, taken = copies * size, and ``keep``. Every
    row is repeated the whole part of ``target / source_size`` times; the fractional part is a sample of whole
    documents in the order of a seeded hash of doc_id, up to the row whose middle passes it. Hashes are summed by
    bins first, so only the bin where the sum passes the goal is put in order and a hot source is never gathered.
    Equal hashes (repeated ids) are ordered by size, then text hash; rows equal in all of these share the goal's border
    in any order. Null sources form one source. An empty table gives no rows.
    """
    own = [k for k in keep if k not in ("doc_id", "size", "source_size", "target", "taken", "copies")]
    rows = docs.select(
        F.col("doc_id"),
        F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("_hash"),
        F.xxhash64("text").alias("_text"),
        *([F.struct(*own).alias("_keep")] if own else []),
    )
    rows = materialize(rows.withColumn("_bin", F.shiftright("_hash", 52) + F.lit(_BINS // 2)), "mix")
    bins = materialize(rows.groupBy("source", "_bin").agg(F.sum("size").alias("n"), F.count("*").alias("docs")), "bins")
    sources = rank_sources(bins.groupBy("source").agg(F.sum("n").alias("source_size")))
    k = F.pmod(F.col("place"), F.lit(len(weights))) + 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), k.cast("int"))
    targets = water_fill(materialize(sources.select("source", "source_size", weight.alias("weight")), "weights"), total_share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("_whole", F.floor(epochs)).withColumn("_goal", F.col("target") - F.col("_whole") * F.col("source_size"))
    targets = materialize(targets.select("source", "source_size", "target", "_whole", "_goal"), "targets")

    # The bin in which each source's running size passes its goal, and the size before that bin.
    first = F.sum("n").over(Window.partitionBy("source").orderBy("_bin")) - F.col("n")
    crossing = bins.withColumn("_first", first).join(targets.select(F.col("source").alias("_s"), "_goal"), F.col("source").eqNullSafe(F.col("_s")))
    crossing = crossing.where((F.col("_first") < F.col("_goal")) & (F.col("_first") + F.col("n") >= F.col("_goal")))
    crossing = crossing.groupBy("source").agg(F.min(F.struct("_bin", "_first")).alias("_at"))
    border = targets.join(crossing.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("_s"), "source_size", "target", "_whole", "_goal", F.col("_at._bin").alias("_cut"), F.col("_at._first").alias("_first")
    )
    border = broadcast_if_small(materialize(border, "border"), F.coalesce(F.length("_s"), F.lit(0)) * 4 + 64)
    joined = rows.join(border, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    at_border = F.col("_bin") == F.col("_cut")
    inside = joined.where(at_border)
    order = Window.partitionBy("source").orderBy("_hash", "size", "_text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_first") + F.coalesce(F.sum("size").over(order), F.lit(0))
    picked = inside.withColumn("_more", (before + F.col("size") / 2 <= F.col("_goal")) & (F.col("size") > 0))
    outside = joined.where(~F.coalesce(at_border, F.lit(False))).withColumn("_more", F.coalesce(F.col("_bin") < F.col("_cut"), F.lit(False)))
    copies = F.col("_whole") + F.col("_more").cast("long")
    out = picked.unionByName(outside).withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *[f"_keep.{k}" for k in own])
