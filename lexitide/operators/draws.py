"""Samples with replacement, and the passages of a book to read from them.

The k-th draw of a stratum is a number made of a hash of stratum, seed and k; it falls on a row by running counts. Rows stand in the order of a hash of
their key, sorted over all tasks, so the same rows are drawn on every layout, and a stratum may hold all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.operators.norms import with_zscores
from lexitide.runtime import Scratch

STEP = 1 << 20  # places of a slice in the look-up


def draws(df: DataFrame, by: list[str], key: str, n: int, weight: str | None = None, seed: int = 0) -> DataFrame:
    """df's rows with the column draw: n for each stratum, with replacement, each row as often as its number came up.

    key tells a stratum's rows apart. With a weight (whole numbers, none or less is never drawn) a row's chance is its share of the stratum's sum. Draws are found by a join
    on slices of the running counts, in which a row stands once for each slice that it reaches into. Draws, and what they fall on, are saved: few rows of a known size are broadcast, so
    that df and its running counts aren't shuffled for them."""
    scratch = Scratch(df.sparkSession, "draws")
    own = df.select(*by, F.col(key).alias("__key"), (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("__w")).where("__w > 0")
    own = own.withColumn("__h", F.unhex(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__key").cast("string")))))
    rows = scratch.save(_running(own, by, scratch), "running")
    total = rows.groupBy(*by).agg(F.max("__last").alias("__all"))
    named = F.concat_ws("|", F.lit(f"draw {seed}"), F.col("draw").cast("string"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by))
    share = F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    drawn = total.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("__at", F.least(F.floor(share * F.col("__all")), F.col("__all") - 1))
    drawn = drawn.select(*(F.col(c).alias(f"__d_{c}") for c in by), "draw", "__at", F.floor(F.col("__at") / STEP).alias("__slice"))
    drawn = scratch.save(drawn, "drawn")
    reach = rows.withColumn("__s", F.explode(F.sequence(F.floor((F.col("__last") - F.col("__w")) / STEP), F.floor((F.col("__last") - 1) / STEP))))
    here = (F.col("__s") == F.col("__slice")) & (F.col("__at") < F.col("__last")) & (F.col("__at") >= F.col("__last") - F.col("__w"))
    for c in by:
        here = here & F.col(c).eqNullSafe(F.col(f"__d_{c}"))
    found = scratch.save(reach.join(drawn, here).select("__key", "draw", *(f"__d_{c}" for c in by)), "found")
    same = F.col(key).eqNullSafe(F.col("__key"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__d_{c}"))
    return df.join(found, same).select(*df.columns, "draw")


def _running(own: DataFrame, by: list[str], scratch: Scratch) -> DataFrame:
    """own with __last, the sum of weights of the stratum up to the row."""
    order = ["__h", "__key"]
    ranged = scratch.save(own.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*by, "__part").agg(F.sum("__w").alias("__sum"))
    ahead = sums.withColumn("__ahead", F.sum("__sum").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__sum"))
    ahead = ahead.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__part").alias("__p"), "__ahead")
    here = F.col("__part") == F.col("__p")
    for c in by:
        here = here & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    running = F.sum("__w").over(Window.partitionBy(*by, "__part").orderBy(*order))
    return ranged.withColumn("__run", running).join(ahead, here).select(*by, "__key", "__w", (F.col("__run") + F.col("__ahead")).alias("__last"))


def book_passages(passages: DataFrame, keys: list[str], n: int = 100, seed: int = 0) -> DataFrame:
    """Passages drawn by period and band. passages: keys, year, num_abs, num_conc, num_neither.

    Adds abs_conc, a z-score of each count by column over all passages, zbin (Abs from z 1 of abs_conc on, Conc down from -1, else Neither) and ybin (the century's first
    year, 1400 for all before 1500). n draws with replacement for each period and band; a passage that is drawn again stands once. Undated
    passages are left out, and all if abs_conc is constant."""
    scratch = Scratch(passages.sparkSession, "passages")
    own = scratch.save(passages.withColumn("abs_conc", F.col("num_abs") - F.col("num_conc")), "own")
    columns = ["abs_conc", "num_abs", "num_conc", "num_neither"]
    scored = with_zscores(own, [], {f"{c}_z": c for c in columns})
    band = F.when(F.col("abs_conc_z") >= 1, "Abs").when(F.col("abs_conc_z") <= -1, "Conc").when(F.col("abs_conc_z").isNotNull(), "Neither")
    period = F.when(F.col("year") >= 1500, F.floor(F.col("year") / 100) * 100).otherwise(F.when(F.col("year").isNotNull(), 1400)).cast("int")
    scored = scored.withColumn("zbin", band).withColumn("ybin", period).where("zbin is not null and ybin is not null")
    scored = scratch.save(scored.withColumn("__id", F.concat_ws("|", *(F.col(k).cast("string") for k in keys))), "scored")
    drawn = draws(scored.select("__id", "ybin", "zbin"), ["ybin", "zbin"], "__id", n, seed=seed).select("__id").distinct()
    return scored.join(scratch.save(drawn, "drawn"), "__id", "left_semi").drop("__id")
