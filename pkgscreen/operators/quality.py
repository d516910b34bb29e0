"""Photo quality, photo usability and what that means for the package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgscreen.config import DEFAULT, Thresholds


def quality_score(metrics: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Five checks, their score out of 100 and the gate."""
    checks = {
        "blur_pass": (f"blur >= {t.blur}", 25),
        "brightness_pass": (f"brightness BETWEEN {t.brightness_min} AND {t.brightness_max}", 25),
        "contrast_pass": (f"contrast >= {t.contrast}", 20),
        "glare_pass": (f"glare <= {t.glare}", 15),
        "skew_pass": (f"skew <= {t.skew}", 15),
    }
    points = " + ".join(f"IF({c}, {p}, 0)" for c, p in checks.values())
    return (metrics.withColumns({n: F.expr(c) for n, (c, _) in checks.items()})
            .withColumn("score", F.expr(f"CAST({points} AS DOUBLE)"))
            .withColumn("gate_usable", F.expr(f"score >= {t.usable_score} AND blur_pass AND brightness_pass")))


def surface_ocr_stats(lines: DataFrame) -> DataFrame:
    return lines.groupBy("package_id", "surface_idx").agg(
        F.count("*").alias("n_lines"), F.round(F.round(F.avg("confidence"), 8), 4).alias("avg_confidence"))


def with_usability(photos: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """Readable text makes a photo usable although the gate refused it.

    Expects ``gate_usable``, ``n_lines`` and ``avg_confidence``.
    """
    readable = f"(n_lines >= {t.readable_lines} AND avg_confidence >= {t.readable_confidence})"
    return photos.withColumns({
        "usable": F.expr(f"gate_usable OR {readable}"),
        "usability_basis": F.expr(
            f"CASE WHEN gate_usable THEN 'quality_gate' WHEN {readable} THEN 'ocr_evidence' ELSE 'none' END"),
    })


def surface_usability(metrics: DataFrame, lines: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    stats = surface_ocr_stats(lines)
    photos = quality_score(metrics, t).join(stats, ["package_id", "surface_idx"], "left")
    return with_usability(photos.fillna({"n_lines": 0, "avg_confidence": 0.0}), t)


def package_quality(surfaces: DataFrame) -> DataFrame:
    """A package is only as usable as its worst photo; its score is the mean."""
    return surfaces.groupBy("package_id").agg(
        F.bool_and("usable").alias("usable"), F.avg("score").alias("score"),
        F.count("*").alias("surfaces_total"), F.count_if("usable").alias("surfaces_usable"))


def package_ocr(surfaces: DataFrame) -> DataFrame:
    """Confidence of the text on usable photos, each photo weighted by its lines."""
    lines = F.sum(F.when(F.col("usable"), F.col("n_lines")).otherwise(0))
    weighted = F.sum(F.when(F.col("usable"), F.col("avg_confidence") * F.col("n_lines")).otherwise(0.0))
    return surfaces.groupBy("package_id").agg(
        lines.alias("n_lines"), F.coalesce(F.try_divide(weighted, lines), F.lit(0.0)).alias("avg_confidence"))


def route_unassessable(surfaces: DataFrame) -> DataFrame:
    """Packages that cannot be judged go to a person, with the reason why."""
    counts = surfaces.groupBy("package_id").agg(
        F.count("*").alias("surfaces_total"), F.count_if("usable").alias("surfaces_usable"),
        F.count("ocr_error").alias("surfaces_failed"),
        F.sum(F.when(F.col("usable"), F.col("n_lines")).otherwise(0)).alias("usable_lines"))
    return counts.withColumn("route", F.expr(ROUTE)).withColumn(
        "decision", F.expr("CASE WHEN route <> 'ASSESS' THEN 'MANUAL_REVIEW' END"))


ROUTE = """CASE WHEN surfaces_usable > 0 AND usable_lines > 0 THEN 'ASSESS'
  WHEN surfaces_failed = surfaces_total THEN 'ENGINE_FAULT'
  WHEN surfaces_usable = 0 THEN IF(surfaces_failed > 0, 'NO_USABLE_PHOTO_PARTIAL_FAULT', 'NO_USABLE_PHOTO')
  ELSE IF(surfaces_failed > 0, 'NO_TEXT_PARTIAL_FAULT', 'NO_TEXT') END"""
