"""What comes in: recognised lines, files, rule files, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pkgscreen import vocab as v

PHOTO = ("package_id long, surface_idx int, surface_name string, texts array<string>, confidences array<double>,"
         " bounding_boxes array<array<array<int>>>")


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PHOTO).json(path)


def lines_of(photos: DataFrame) -> DataFrame:
    """One row per line of parallel arrays, boxes as corners' extremes."""
    rows = photos.select("package_id", "surface_idx", "surface_name", F.posexplode(F.arrays_zip("texts", "confidences", "bounding_boxes")).alias("line_no", "l"))
    side = lambda f, i: f(F.transform("l.bounding_boxes", lambda p: p[i]))
    return rows.select("package_id", "surface_idx", "surface_name", "line_no", F.col("l.texts").alias("text"), F.col("l.confidences").alias("confidence"),
                       side(F.array_min, 0).alias("x_min"), side(F.array_min, 1).alias("y_min"), side(F.array_max, 0).alias("x_max"), side(F.array_max, 1).alias("y_max"))


def group_surfaces(files: DataFrame, root: str, most: int = v.MAX_SURFACES) -> DataFrame:
    """Photos of one folder are one package, a loose photo is its own; those past the first ``most`` carry the reason why they are not screened."""
    kinds = "|".join(v.BATCH_EXTENSIONS)
    rest = F.regexp_replace("path", f"^{root}/", "")
    pics = (files.where(F.col("path").rlike(f"(?i)\\.({kinds})$")).withColumn("rest", rest)
            .withColumn("package", F.expr("IF(contains(rest, '/'), 'package:' || substring_index(rest, '/', 1), rest)")))
    order = F.row_number().over(Window.partitionBy("package").orderBy("path"))
    return pics.withColumn("surface_idx", order - 1).select("package", "surface_idx", "path", F.when(F.col("surface_idx") >= most, "too many photos").alias("reason"))


def validate_surface_count(surfaces: DataFrame, most: int = v.MAX_SURFACES) -> DataFrame:
    return surfaces.groupBy("package_id").agg(F.count("surface_idx").alias("surfaces")).withColumn(
        "error", F.when(F.col("surfaces") == 0, "no photo").when(F.col("surfaces") > most, "too many photos"))


def admit_files(files: DataFrame) -> DataFrame:
    """Accepted files, and the reason and code of those refused."""
    quoted = lambda items: ", ".join(f"'{i}'" for i in items)
    rows = files.withColumns({"name": F.substring_index("path", "/", -1), "kind": F.lower(F.coalesce("content_type", F.lit("")))}).withColumn(
        "extension", F.expr("IF(contains(name, '.'), '.' || lower(substring_index(name, '.', -1)), '')"))
    return rows.withColumn("reason", F.expr(f"""CASE WHEN extension <> '' AND extension NOT IN ({quoted(v.IMAGE_EXTENSIONS)}) THEN 'unsupported file type'
      WHEN kind <> '' AND kind NOT IN ({quoted(v.IMAGE_TYPES)}) THEN 'unsupported content type' WHEN size_bytes = 0 THEN 'empty file' WHEN size_bytes > {v.MAX_UPLOAD_BYTES} THEN 'file too large' END""")).withColumn(
        "code", F.expr("CASE reason WHEN 'file too large' THEN 413 WHEN NULL THEN NULL ELSE IF(reason IS NULL, 200, 422) END"))


RULE_FILE = ("ruleset_id string, version string, ruleset_verified boolean, rules array<struct<rule_id:string,requirement:string,rule_type:string,fields:array<string>,validation:string,"
             "severity:string,applicability:struct<condition:string,depends_on:string>,verified:boolean,category:string,title:string>>")


def read_ruleset(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.schema(RULE_FILE).json(path, multiLine=True)
    return files.select("ruleset_id", "version", "ruleset_verified", F.inline("rules"))


def ruleset_verified(rules: DataFrame) -> DataFrame:
    return rules.groupBy("ruleset_id").agg(F.count("*").alias("rules"), F.bool_and("verified").alias("ruleset_verified"))


def log_tail(lines: DataFrame, n: int = 50) -> DataFrame:
    """The last lines: the whole record of a JSON line, and its member ``k``; what is not JSON is kept as it stands."""
    last = lines.orderBy(F.desc("line_no")).limit(max(n, 1))
    return last.select("line_no", F.get_json_object("line", "$.k").alias("k"), F.get_json_object("line", "$").alias("record"), F.when(F.get_json_object("line", "$").isNull(), F.trim("line")).alias("raw"))


def write_results_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
