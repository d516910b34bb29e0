"""Queries over the extraction operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pkgscreen import vocab as v
from pkgscreen.functions import geometry as g
from pkgscreen.operators import extract as ex
from pkgscreen.plans.fixtures import table
from pkgscreen.plans.registry import QUERIES, query

_COLS = ["package_id", "surface_idx", "field", "value", "ocr_text", "ocr_conf", "ext_conf", "level", "line_idx"]


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _declarations(key: str, fields: list[str]) -> None:
    QUERIES[key] = lambda spark, sf: rounded(
        ex.extract(table(spark, sf, "lines"), fields).select(*_COLS), "ocr_conf", "ext_conf")


_declarations("field_mrp", ["mrp"])
_declarations("field_net_quantity", ["net_quantity"])
_declarations("field_entity", v.ENTITY_FIELDS)
_declarations("field_dates", list(v.DATE_LABELS))
_declarations("field_batch", ["batch_number"])
_declarations("field_consumer_care", ["consumer_care"])
_declarations("field_origin", ["country_of_origin"])
_declarations("field_product_name", ["product_name"])
_declarations("field_brand", ["brand"])


@query("fields_all")
def fields_all(spark, sf):
    return rounded(ex.extract_all(table(spark, sf, "lines")).select(*_COLS, "x_min", "y_min", "x_max", "y_max"), "ocr_conf", "ext_conf")


@query("line_reject_tags")
def line_reject_tags(spark, sf):
    return ex.tag_rejects(table(spark, sf, "lines")).select(
        "package_id", "surface_idx", "line_no", *[f"is_{k}" for k in v.REJECT])


@query("line_neighbours")
def line_neighbours(spark, sf):
    return ex.neighbour_lines(table(spark, sf, "lines"), 3, 3).select(
        "package_id", "surface_idx", "line_no", "distance", "near_line_no", "near_text")


@query("bbox_geometry")
def bbox_geometry(spark, sf):
    box = ["line_no", "x_min", "y_min", "x_max", "y_max"]
    order = Window.partitionBy("package_id", "surface_idx").orderBy("line_no")
    pairs = (table(spark, sf, "lines").withColumn("a", F.struct(*box))
             .withColumn("b", F.lead("a").over(order)).where("b IS NOT NULL"))
    return pairs.selectExpr("package_id", "surface_idx", "a.line_no AS line_no", "b.line_no AS next_line_no",
                            f"round({g.centre_distance('a', 'b')}, 6) AS distance",
                            f"round({g.vertical_overlap('a', 'b')}, 6) AS overlap")
