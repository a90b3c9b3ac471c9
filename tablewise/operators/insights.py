"""Broad looks at a table: ranked insights and a compact data summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.columns import as_text, numeric_columns, ref
from tablewise.operators.mine import anomaly_scores
from tablewise.operators.profile import _quality_findings, _summary, categorical_summary, zscore_outlier_count
from tablewise.operators.relate import categorical_associations, correlation_pairs, relationship_findings
from tablewise.operators.trend import detect_datetime_col, trend_summary

# Fixed limits.
TOP_CORRELATIONS, TOP_ASSOCIATIONS, SAMPLE_ROWS = 20, 10, 5
SECTIONS = ("data_quality", "relationships", "anomalies", "trend")


def auto_insights(df: DataFrame, key: Sequence[str], top_n: int = 10, trees: int = 300) -> DataFrame:
    """``rank, section, finding, subject, value``: quality, relationships, anomalies, then trend."""
    nums = [c for c in numeric_columns(df) if c not in key]
    every = numeric_columns(df)
    none = F.lit(None).cast("double")
    parts = [
        _quality_findings(df).select(
            F.lit(0).alias("s"), F.col("position").cast("long").alias("o"), "finding", F.col("column").alias("subject"), "value"
        )
    ]
    if len(every) >= 2:
        parts.append(
            relationship_findings(df).select(
                F.lit(1).alias("s"),
                (-F.abs("strength") * 1_000_000).cast("long").alias("o"),
                "finding",
                F.concat_ws(" ~ ", "column_a", "column_b").alias("subject"),
                F.col("strength").alias("value"),
            )
        )
    if len(nums) >= 2:
        scores = anomaly_scores(df, nums, key, trees=trees)
        parts.append(
            scores.agg(F.count_if("is_anomaly").alias("n"), F.count("*").alias("all"))
            .where("n > 0")
            .select(
                F.lit(2).alias("s"),
                F.lit(0).cast("long").alias("o"),
                F.lit("anomalous_rows").alias("finding"),
                F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("subject"),
                F.round(F.col("n") / F.col("all") * 100, 4).alias("value"),
            )
        )
    date_col = detect_datetime_col(df)
    if date_col and [c for c in every if c != date_col]:
        parts.append(
            trend_summary(df, date_col).select(
                F.lit(3).alias("s"),
                F.lit(0).cast("long").alias("o"),
                F.concat(F.lit("trend_"), F.col("direction")).alias("finding"),
                F.concat_ws(" by ", "value_col", "date_col").alias("subject"),
                F.coalesce("overall_change_pct", none).alias("value"),
            )
        )
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = F.array(*[F.lit(x) for x in SECTIONS])
    # At most a few findings per column reach this unpartitioned window.
    order = Window.orderBy("s", "o", "finding", "subject")
    return (
        rows.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
        .select("rank", F.element_at(names, F.col("s") + 1).alias("section"), "finding", "subject", "value")
    )


def analysis_context(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """``section, name, item, value, text``: bounded summary of a table in one long form."""
    cols = df.columns
    d = df.select(*[ref(c) for c in cols])
    null, blank = F.lit(None).cast("double"), F.lit(None).cast("string")
    nums = numeric_columns(d)
    out = None

    def add(part: DataFrame) -> None:
        nonlocal out
        out = part if out is None else out.unionByName(part)

    if nums:
        stats = _summary(d.select(*[ref(c) for c in nums]), {"p25": 0.25, "p50": 0.5, "p75": 0.75}).withColumn(
            "count", F.col("n_rows") - F.col("missing")
        )
        items = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")
        cells = F.array(*[F.struct(F.lit(i).alias("item"), F.col(i).cast("double").alias("value")) for i in items])
        add(stats.select("name", F.explode(cells).alias("c")).select(F.lit("describe").alias("section"), "name", "c.item", "c.value", blank.alias("text")))
        add(
            zscore_outlier_count(d, nums).select(
                F.lit("outliers").alias("section"), F.col("column").alias("name"), F.lit("z_at_least_3").alias("item"),
                F.col("outliers").cast("double").alias("value"), blank.alias("text"),
            )
        )
        if len(nums) >= 2:
            add(
                correlation_pairs(d, top_n=TOP_CORRELATIONS).select(
                    F.lit("correlation").alias("section"), F.col("column_a").alias("name"), F.col("column_b").alias("item"),
                    F.col("correlation").alias("value"), blank.alias("text"),
                )
            )
        add(
            categorical_associations(d, top_n=TOP_ASSOCIATIONS).select(
                F.lit("association").alias("section"), F.col("categorical_col").alias("name"), F.col("numeric_col").alias("item"),
                F.col("correlation_ratio").alias("value"), blank.alias("text"),
            )
        )
    text = [c for c in cols if c not in nums]
    if text:
        add(
            categorical_summary(d, text).select(
                F.lit("top_values").alias("section"), "name", F.col("rank").cast("string").alias("item"),
                F.col("count").cast("double").alias("value"), F.col("value").alias("text"),
            )
        )
    date_col = detect_datetime_col(d)
    if date_col and nums:
        add(
            trend_summary(d, date_col).select(
                F.lit("trend").alias("section"), F.col("value_col").alias("name"), F.col("direction").alias("item"),
                F.col("overall_change_pct").alias("value"), F.col("latest_value").cast("string").alias("text"),
            )
        )
    first = d.orderBy(*[ref(o) for o in order_by]).limit(SAMPLE_ROWS)
    cells = F.array(*[F.struct(F.lit(c).alias("name"), as_text(d, c).alias("text")) for c in cols])
    add(
        first.select(F.explode(cells).alias("c")).select(
            F.lit("sample").alias("section"), "c.name", F.lit("value").alias("item"), null.alias("value"), "c.text"
        )
    )
    return out
