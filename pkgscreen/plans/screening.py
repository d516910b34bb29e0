"""From lines and photo metrics to packages with evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgscreen import vocab as v
from pkgscreen.config import DEFAULT, Thresholds, fits, merged, scratch_dir
from pkgscreen.operators import evidence as ev
from pkgscreen.operators import extract as ex
from pkgscreen.operators import quality as q
from pkgscreen.sources.tables import validate_surface_count


REJECTED_BROADCAST = 100_000  # rejected packages that travel to the lines; more of them are merged by package


def rejected(metrics: DataFrame) -> DataFrame:
    """Packages with no photo or too many, with the reason; they are not screened."""
    return validate_surface_count(metrics).where("error IS NOT NULL")


def admitted(lines: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines and photos of packages that may be screened: counted and refused before any row of theirs is collected."""
    out = rejected(metrics).select("package_id")
    out = F.broadcast(out) if fits(out, REJECTED_BROADCAST) else merged(out)
    return lines.join(out, "package_id", "left_anti"), metrics.join(out, "package_id", "left_anti")


def photos_with_fields(lines: DataFrame, metrics: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """One row per photo: quality, usability, lines and (if usable) declarations."""
    lines, metrics = admitted(lines, metrics)
    photos = ex.by_surface(lines, ex.flags_for(v.FIELDS), metrics, ev.POOL_FACTS, nested=True)
    photos = q.with_usability(q.quality_score(photos, t).withColumns({
        "n_lines": F.expr("CAST(size(lines) AS BIGINT)"),
        "avg_confidence": F.expr(
            "round(round(coalesce(try_divide(aggregate(lines, 0.0D, (s, l) -> s + l.confidence), size(lines)), 0.0D), 8), 4)"),
    }), t)
    return ex.field_structs(photos).withColumn("fields", F.expr("IF(usable AND n_lines > 0, fields, filter(fields, f -> false))"))


def photos_with_evidence(lines: DataFrame, metrics: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    return ev.with_pointers(ev.with_chains(ev.with_pool(photos_with_fields(lines, metrics, t), t)))


def evidence_run(lines: DataFrame, metrics: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """One row per package with merged declarations, pointers and free evidence."""
    return ev.with_evidence(ev.to_packages(photos_with_evidence(lines, metrics, t)), t)


_STAGED: dict[tuple, str] = {}


def staged_path(spark, name: str, source: str, write) -> str:
    """The folder that ``write(path)`` filled, once per session, in the shared scratch folder."""
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _STAGED:
        path = f"{scratch_dir(spark)}/{key[0]}-{abs(hash(source))}-{name}"
        write(path)
        _STAGED[key] = path
    return _STAGED[key]


def is_staged(spark, name: str, source: str) -> bool:
    return (spark.sparkContext.applicationId, source, name) in _STAGED


def staged(spark, name: str, source: str, build) -> DataFrame:
    """A table written once per session to the shared scratch folder and read back.

    Cuts the long lineage behind the package table: many jobs start from it, and
    a lost executor then re-reads files instead of repeating the extraction.
    """
    return spark.read.parquet(staged_path(spark, name, source, lambda path: build().write.mode("overwrite").parquet(path)))
