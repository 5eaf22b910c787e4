"""Incident summaries: category counts, monthly trend, demographic shares and ring charts.

Each function takes the incident table (raw rows) and returns a small chart-ready table.
The heavy part — scanning, categorising, counting — is a partial+final hash aggregate;
everything after the first aggregate works on one row per group. The share plans checkpoint
that count table once: the steps after it run as several small jobs (totals, ranks, running
sums), and each would otherwise re-scan the raw input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.categorise import Rules, categorise
from ..functions.labels import integer_label, month_label, percent_label, short_scale_label
from ..functions.recode import colour_map, recode
from ..functions.rules import (
    AGE_COLOURS,
    CATEGORY_SHORT_NAMES,
    CRIME_RULES,
    DEFAULT_CATEGORY,
    RACE_EXCLUDED_AFTER_SHARE,
    RACE_PALETTE,
    SEX_COLOURS,
    SEX_LABELS,
)
from ..functions.scales import censor
from ..operators.counts import count_by, monthly_counts
from ..operators.donut import donut_geometry
from ..operators.shares import reorder_levels, share_within, stack_fill
from ..session import materialise


def with_category(df: DataFrame, text_col: str = "pd_desc", rules: Rules = CRIME_RULES,
                  default: str = DEFAULT_CATEGORY, out: str = "category") -> DataFrame:
    """The incident table with its rule category."""
    return categorise(df, text_col, rules, default, out)


def category_counts(df: DataFrame, text_col: str = "pd_desc", rules: Rules = CRIME_RULES,
                    default: str = DEFAULT_CATEGORY) -> DataFrame:
    """Rows per category: ``category, n``."""
    cat = categorise(df.select(text_col), text_col, rules, default, "category")
    return count_by(cat, "category", "n")


def monthly_trend(df: DataFrame, date_col: str = "arrest_date", total: str = "total_arrests",
                  label: str = "short", accuracy: float = 0.1,
                  limits: tuple[float, float] | None = None) -> DataFrame:
    """Rows per month (years pooled): ``month, month_label, <total>, label`` (+ ``y`` with limits).

    ``label='short'`` gives K/M text at ``accuracy``; ``label='integer'`` the whole count.
    ``limits`` blanks (NULL) the plotted ``y`` of months outside the axis range.
    """
    counts = monthly_counts(df, date_col, total)
    lab = short_scale_label(total, accuracy) if label == "short" else integer_label(total)
    out = counts.select(
        "month", month_label("month").alias("month_label"), total, lab.alias("label")
    )
    if limits is not None:
        out = out.withColumn("y", censor(F.col(total).cast("double"), limits))
    return out


def share_by_group(df: DataFrame, group: str = "category", key: str = "perp_sex",
                   exclude: Sequence[str] = (DEFAULT_CATEGORY,),
                   group_names: Mapping[str, str] = CATEGORY_SHORT_NAMES,
                   key_names: Mapping[str, str] = SEX_LABELS,
                   colours: Mapping[str, str] = SEX_COLOURS) -> DataFrame:
    """Share of each ``key`` within each ``group``, laid out as 100 %-stacked bars.

    Output: ``<group>, ord, <key>, n, percent, ymin, ymax, ymid, label, colour`` where ``ord``
    is the bar order (ascending mean of -percent, ties by name) and ``ymin/ymax/ymid`` are the
    filled-stack bounds.
    """
    base = df.where(~F.col(group).isin(*exclude)) if exclude else df
    counts = materialise(count_by(base, [group, key], "n"))
    shares = share_within(counts, group, "n", "percent")
    shares = shares.withColumn(group, recode(group, group_names)).withColumn(key, recode(key, key_names))
    ordered = reorder_levels(shares, group, "percent", "ord")
    stacked = stack_fill(ordered, group, key, "n")
    return stacked.select(
        group, "ord", key, "n", "percent", "ymin", "ymax", "ymid",
        percent_label("percent").alias("label"), colour_map(key, colours).alias("colour"),
    )


def share_then_exclude(df: DataFrame, key: str = "perp_race",
                       exclude_after: Sequence[str] = RACE_EXCLUDED_AFTER_SHARE,
                       palette: Sequence[str] = RACE_PALETTE) -> DataFrame:
    """Share of the total per ``key`` (NULL keys removed first), then some keys hidden.

    Hidden keys stay in the denominator, so the shown percentages need not sum to 100.
    Output, in ring order: ``<key>, ord, n, percent, ypos, angle, label_angle, hjust, label, colour``.
    """
    counts = count_by(df.where(F.col(key).isNotNull()), key, "n")
    ring = donut_geometry(counts, key, "n", angle_from="ypos", hidden=exclude_after)
    colour = F.try_element_at(F.array(*[F.lit(c) for c in palette]), F.col("rank"))
    return ring.select(
        key, "ord", "n", "percent", "ypos", "angle", "label_angle", "hjust",
        percent_label("percent").alias("label"), colour.alias("colour"),
    ).orderBy("ord")


def donut_segments(df: DataFrame, key: str = "age_group",
                   colours: Mapping[str, str] = AGE_COLOURS) -> DataFrame:
    """Ring segments per ``key`` (NULL removed): bounds, label position and angle.

    Output, in ring order: ``<key>, ord, n, percent, ymin, ymax, label_pos, angle, label_angle, label, colour``.
    """
    counts = count_by(df.where(F.col(key).isNotNull()), key, "n")
    ring = donut_geometry(counts, key, "n", angle_from="label_pos")
    return ring.select(
        key, "ord", "n", "percent", "ymin", "ymax", "label_pos", "angle", "label_angle",
        percent_label("percent").alias("label"), colour_map(key, colours).alias("colour"),
    ).orderBy("ord")
