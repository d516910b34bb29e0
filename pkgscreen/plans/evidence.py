"""Queries over photo quality and the evidence of packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pkgscreen.operators import evidence as ev
from pkgscreen.operators import extract as ex
from pkgscreen.operators import quality as q
from pkgscreen.plans import screening as sc
from pkgscreen.plans.extraction import rounded
from pkgscreen.plans.fixtures import table
from pkgscreen.plans.registry import QUERIES, query

KEY = ["package_id", "surface_idx", "line_no"]


def _inputs(spark, sf):
    return table(spark, sf, "lines"), table(spark, sf, "surface_metrics")


@query("quality_score")
def quality_score(spark, sf):
    return q.quality_score(table(spark, sf, "surface_metrics")).select(
        "package_id", "surface_idx", *[f"{c}_pass" for c in ("blur", "brightness", "contrast", "glare", "skew")], "score", "gate_usable")


@query("surface_ocr")
def surface_ocr(spark, sf):
    return q.surface_ocr_stats(table(spark, sf, "lines"))


def _usability(spark, sf):
    lines, metrics = _inputs(spark, sf)
    return q.surface_usability(metrics, lines)


@query("surface_usability")
def surface_usability(spark, sf):
    return _usability(spark, sf).select(
        "package_id", "surface_idx", "gate_usable", "usable", "usability_basis", "n_lines", "avg_confidence")


@query("package_quality")
def package_quality(spark, sf):
    return rounded(q.package_quality(_usability(spark, sf)), "score")


@query("package_ocr")
def package_ocr(spark, sf):
    return rounded(q.package_ocr(_usability(spark, sf)), "avg_confidence")


@query("early_exit")
def early_exit(spark, sf):
    return q.route_unassessable(_usability(spark, sf)).drop("usable_lines")


def _photos(spark, sf):
    # the lines with all their flags are not read again: the pool holds what later steps need of them
    return sc.staged(spark, "photos", sf, lambda: sc.photos_with_evidence(*_inputs(spark, sf)).drop("lines", "part"))


def _plain_photos(spark, sf):
    """Photos with pool, without declarations: enough for candidates."""
    lines, metrics = _inputs(spark, sf)
    return ev.with_pool(ex.by_surface(lines, [], facts=ev.POOL_FACTS))


@query("pool")
def pool(spark, sf):
    return ev.build_pool(_photos(spark, sf)).select(*KEY, "surface_name", "text", "confidence", "surface_usable")


@query("pool_claims")
def pool_claims(spark, sf):
    labelled = F.when(F.col("claimed") != "vertical_chain", F.col("claimed"))
    return ev.build_pool(_photos(spark, sf)).select(*KEY, labelled.alias("claimed_by"))


@query("base_region")
def base_region(spark, sf):
    return _plain_photos(spark, sf).selectExpr("package_id", "surface_idx", "surface_height", "inline(pool)").select(
        *KEY, "surface_height", F.col("base").alias("in_base_region"))


@query("nutrition_ctx")
def nutrition_ctx(spark, sf):
    return ev.nutrition_context(ex.by_surface(table(spark, sf, "lines"), []))


def _candidates(key, kinds):
    QUERIES[key] = lambda spark, sf: ev.detect(_plain_photos(spark, sf)).where(F.col("kind").isin(kinds)).select(
        *KEY, "kind", "value", "nutrition", "in_base_region")


_candidates("cand_currency_qty", ["currency", "quantity"])
_candidates("cand_date", ["date"])
_candidates("cand_contact", ["phone", "email"])
_candidates("cand_address", ["address"])
_candidates("cand_entity", ["entity"])
_candidates("cand_code", ["code"])
_candidates("cand_country", ["country"])
_candidates("cand_pointer", ["pointer"])


@query("candidate_values")
def candidate_values(spark, sf):
    return ev.detect(_plain_photos(spark, sf)).select(*KEY, "kind", "value", "norm")


@query("vertical_chains")
def vertical_chains(spark, sf):
    return ev.vertical_chains(_photos(spark, sf)).select("package_id", "surface_idx", F.size("members").alias("members"), "value")


def _pointers(spark, sf):
    return _photos(spark, sf).selectExpr("package_id", "inline(pointers)")


@query("pointers")
def pointers(spark, sf):
    return _pointers(spark, sf).select("package_id", "surface_idx", "original_text", F.col("text").alias("pointer_text"))


@query("pointer_hints")
def pointer_hints(spark, sf):
    return _pointers(spark, sf).select("package_id", "surface_idx", "location", F.array_join("fields", ",").alias("hinted_fields"))


def _run(spark, sf):
    """Packages straight from the lines, on one exchange; photos are written for the queries that read photos only."""
    def build():
        known = sc.is_staged(spark, "photos", sf)
        photos = _photos(spark, sf) if known else sc.photos_with_evidence(*_inputs(spark, sf))
        return ev.concluded(ev.with_evidence(ev.to_packages(photos)))
    return sc.staged(spark, "packages", sf, build)


@query("cylindrical")
def cylindrical(spark, sf):
    return _run(spark, sf).select("package_id", "cylindrical", "cylindrical_package")


_MERGED = ["package_id", "field", "value", "ocr_text", "ocr_conf", "ext_conf", "level", "source_name"]


def _merged(spark, sf):
    photos = _photos(spark, sf).where("usable")
    return ev.merge_fields(photos.selectExpr("package_id", "surface_idx", "surface_name", "inline(fields)"))


@query("fields_merged")
def fields_merged(spark, sf):
    return rounded(_merged(spark, sf).select(*_MERGED), "ocr_conf", "ext_conf")


@query("fields_complete")
def fields_complete(spark, sf):
    found = _merged(spark, sf).where("value IS NOT NULL OR field = 'mrp'")
    return rounded(ex.complete_fields(found).select(*_MERGED), "ocr_conf", "ext_conf")


@query("field_association")
def field_association(spark, sf):
    return rounded(_run(spark, sf).selectExpr("package_id", "inline(filled.out)").select(
        "package_id", "field", "value", "source_name", "gate", "ext_conf"), "ext_conf")


@query("unclaimed_evidence")
def unclaimed_evidence(spark, sf):
    return _run(spark, sf).selectExpr("package_id", "inline(unclaimed)").select("package_id", "surface_idx", "text", "kind", "value")


@query("entity_address")
def entity_address(spark, sf):
    return (_run(spark, sf).selectExpr("package_id", "inline(fields)").where("address_detected IS NOT NULL")
            .select("package_id", "field", "value", "address_detected", "address_text"))


@query("evidence_run")
def evidence_run(spark, sf):
    return rounded(_run(spark, sf).selectExpr("package_id", "cylindrical_package", "inline(fields)").select(
        "package_id", "field", "value", "level", "ext_conf", "source_name", "address_detected", "cylindrical_package"), "ext_conf")


@query("conf_level")
def conf_level(spark, sf):
    return table(spark, sf, "lines").select(*KEY, ev.level_from_conf("confidence").alias("level"))
