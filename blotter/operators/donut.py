"""Donut (ring) chart geometry: segment bounds, label position and label angle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import flip_angle, flip_hjust
from .running import running_total


def donut_geometry(df: DataFrame, key: str, n: str = "n", angle_from: str = "label_pos",
                   hidden: Sequence[str] = ()) -> DataFrame:
    """Segments of a count table laid out in descending ``key`` order (NULL last).

    Adds ``percent`` (``n / sum(n) * 100`` over all rows), ``ord`` (place in the ring, 1 = first),
    ``rank`` (place in ascending order), ``ymax`` (running percentage), ``ymin`` (previous ``ymax``, 0
    first), ``ypos`` (``ymax - percent/2``), ``label_pos`` (``(ymax + ymin)/2``), ``angle``
    (``90 - 360 * <angle_from> / sum(percent)``), ``label_angle`` (turned upright) and ``hjust``.
    Keys in ``hidden`` count in the total, but get no segment. The counts are summed and scaled
    once, so the result does not depend on how they are partitioned.
    """
    if angle_from not in ("ypos", "label_pos"):
        raise ValueError("angle_from must be 'ypos' or 'label_pos'")
    shown = ~F.col(key).isin(*hidden) if hidden else F.lit(True)
    shown = F.coalesce(shown, F.lit(True))
    both = df.withColumn("_shown", F.when(shown, F.col(n)).otherwise(0)).withColumn("_one", shown.cast("int"))
    run = running_total(both, "_shown", [F.col(key).desc_nulls_last()], "_upto", exclusive_out="_before",
                        also={"ord": "_one"})
    sums = run.select(F.struct(F.sum(n).alias("all"), F.sum("_shown").alias("shown"), F.sum("_one").alias("keys"))).scalar()
    scale = F.lit(100.0) / sums["all"].cast("double")
    return (
        run.where(F.col("_one") == 1)
        .withColumn("ord", F.col("ord").cast("int"))
        .withColumn("rank", (sums["keys"] - F.col("ord") + 1).cast("int"))
        .withColumn("percent", F.col(n) / sums["all"].cast("double") * F.lit(100.0))
        .withColumn("ymax", F.col("_upto") * scale)
        .withColumn("ymin", F.col("_before") * scale)
        .withColumn("ypos", F.col("ymax") - F.col("percent") / 2.0)
        .withColumn("label_pos", (F.col("ymax") + F.col("ymin")) / 2.0)
        .withColumn("angle", F.lit(90.0) - F.lit(360.0) * F.col(angle_from) / (sums["shown"] * scale))
        .withColumn("label_angle", flip_angle("angle"))
        .withColumn("hjust", flip_hjust("angle"))
        .drop("_shown", "_one", "_upto", "_before")
    )
