"""Additive model: baseline plus the effects of single mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayscope.functions.scalars import mutation_parts

EXACT = "decimal(28,10)"


def additive_scores(targets: DataFrame, train: DataFrame, by: list[str] | None = None, truth: str = "dms_score", few: bool = False) -> DataFrame:
    """targets with score = baseline + sum of known effects, rounded to 9 places.

    The baseline is the mean of the training singles; a group without singles uses the mean of its
    whole training set and no effects. targets and train share the columns `by` (default: assay), mutant
    and ord. Effects are exact decimals, so equal sets of parts tie exactly. few: a group trains on so few
    rows (a split's budget) that its effects fit in one row, where each part is looked up; else parts and
    effects are joined.
    """
    by = by or ["assay"]
    single = F.col("ord") == 1
    base = train.groupBy(*by).agg(F.coalesce(F.avg(F.when(single, F.col(truth))), F.avg(truth)).alias("__base"))
    effects = train.where(single).join(base, by).select(*by, F.col("mutant").alias("__part"), (F.col(truth) - F.col("__base")).cast(EXACT).alias("__effect"))
    if few:
        known = effects.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__part", "__effect"))).alias("__effects"))
        zero = F.lit(0).cast(EXACT)
        add = lambda total, part: (total + F.coalesce(F.try_element_at("__effects", part), zero)).cast(EXACT)
        out = targets.join(base.join(known, by, "left"), by)
        total = F.when(F.col("__effects").isNull(), 0.0).otherwise(F.aggregate(mutation_parts(F.col("mutant")), zero, add).cast("double"))
        return out.withColumn("score", F.round(F.col("__base") + total, 9)).drop("__base", "__effects")
    parts = targets.select(*by, "mutant", F.explode(mutation_parts(F.col("mutant"))).alias("__part"))
    known = parts.join(effects, [*by, "__part"])
    summed = known.groupBy(*by, "mutant").agg(F.sum("__effect").cast("double").alias("__sum"))
    out = targets.join(base, by).join(summed, [*by, "mutant"], "left")
    return out.withColumn("score", F.round(F.col("__base") + F.coalesce("__sum", F.lit(0.0)), 9)).drop("__base", "__sum")
