"""Which rows an analysis takes. Each gate keeps its own treatment of nulls; they are never merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def analytics_gate(df: DataFrame) -> DataFrame:
    """Rows not known to be spam, below the score that rejects, not known to be repeats; nulls pass."""
    out = df.filter(~F.coalesce("is_spam", F.lit(False)))
    if "spam_score" in df.columns:
        out = out.filter(F.col("spam_score").isNull() | (F.col("spam_score") <= 0.9))
    if "is_duplicate" in df.columns:
        out = out.filter(~F.coalesce("is_duplicate", F.lit(False)))
    return out


def clustering_gate(df: DataFrame) -> DataFrame:
    """Rows with a score below the bound (null passes), a company, and not known to be repeats."""
    out = df.filter((F.col("spam_score").isNull() | (F.col("spam_score") < 0.9)) & F.col("company_id").isNotNull())
    return out.filter(~F.coalesce("is_duplicate", F.lit(False))) if "is_duplicate" in df.columns else out


def strict_gate(df: DataFrame) -> DataFrame:
    """Rows known not to be spam; nulls don't pass."""
    return df.filter(F.col("is_spam") == F.lit(False))


def tolerant_gate(df: DataFrame) -> DataFrame:
    """Rows known not to be spam, or not judged yet."""
    return df.filter((F.col("is_spam") == F.lit(False)) | F.col("is_spam").isNull())


def enough_new(df: DataFrame, created: str, watermark, least: int = 50) -> bool:
    """Whether at least `least` rows are newer than the watermark (all, if there is none); reads no more than that."""
    fresh = df.filter(F.col(created) > F.lit(watermark)) if watermark is not None else df
    return fresh.limit(least).count() >= least


def new_since(df: DataFrame, created: str, watermark, tier: str | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Rows newer than the watermark (all, if there is none) whose tier is not excluded; a null tier passes."""
    out = df.filter(F.col(created) > F.lit(watermark).cast("timestamp")) if watermark is not None else df
    return without_values(out, tier, excluded) if tier else out


def past_grace(df: DataFrame, created: str, now, minutes: int) -> DataFrame:
    """Rows created more than so many minutes before `now`, a column."""
    return df.filter(F.col(created) < now - F.expr(f"interval {minutes} minutes"))


def without_values(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Rows whose column has none of the values; nulls pass."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*values)) if values else df


def entitled(df: DataFrame, column: str, allowed: list[str] | None) -> DataFrame:
    """Rows of the places that a tenant may see; None is all."""
    return df if allowed is None else df.filter(F.col(column).isin(*allowed)) if allowed else df.filter(F.lit(False))
