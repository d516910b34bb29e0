"""Quality classifier by importance resampling.

Two hashed n-gram generative models (unigrams and bigrams of word and sign runs,
``buckets`` cells each) are counted: one over the target rows (labelled good),
one over all raw text. A document's importance is the log ratio of the two
models over its n-grams. ``resample`` draws by Gumbel top-k; ``classify`` rejects
documents whose mean log ratio lies below a cut fitted on the labelled rows.

The models have a fixed number of cells, so the driver and each task hold
``buckets`` numbers whatever the corpus; the raw counts come from every document.
Labelled rows are the only bounded sample: at most ``label_rows`` of them, those
with the smallest hashed ids.

Defined results: a null or empty text, or one without any word or sign run, has
no n-grams, importance 0 and is rejected by ``classify`` (there is nothing to
train on); it can still be drawn by ``resample`` with its weight 0. Ties in the draw go
to the smaller id; a row without an id is never drawn. Repeated rows are judged each on their own. Without labels of
both kinds nothing is rejected but the empty. Extra columns pass through; scratch
columns carry the prefix ``_iw_``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from pkgscreen.llm import texthash as th
from pkgscreen.llm.base import broadcast_if

BUCKETS = 1 << 16
LABEL_ROWS = 20_000
SAMPLE_ROWS = 10_000
SEED = 17


def _ngram_cells(raw: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, text) of every unigram and bigram of the texts, ASCII letters lower-cased."""
    raw = th.lower_ascii(raw)
    start, end, text = th.kind_spans(raw, at)
    words = th.span_hashes(raw, start, end)
    pair = th.mix(words[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[1:]) if len(words) > 1 else np.zeros(0, np.uint64)
    same = text[:-1] == text[1:]
    cells = np.concatenate([words, pair[same]]) % np.uint64(buckets)
    return cells.astype(np.int64), np.concatenate([text, text[:-1][same]])


def _counter(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, buckets), np.int64)
        for batch in batches:
            target = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            for first, last, raw, at in th.chunks(batch.column(0)):
                cell, text = _ngram_cells(raw, at, buckets)
                totals[0] += np.bincount(cell, minlength=buckets)
                totals[1] += np.bincount(cell[target[first:last][text]], minlength=buckets)
        used = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[0][used]), pa.array(totals[1][used])], ["cell", "raw", "target"])

    return count


def _scorer(log_ratio: np.ndarray, columns: tuple[str, ...]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            total, grams = np.zeros(n), np.zeros(n, np.int64)
            for first, last, raw, at in th.chunks(batch.column(batch.schema.get_field_index("text"))):
                cell, text = _ngram_cells(raw, at, len(log_ratio))
                total[first:last] = np.bincount(text, log_ratio[cell], last - first)
                grams[first:last] = np.bincount(text, minlength=last - first)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total), pa.array(grams)], [*columns, "log_weight", "n_grams"])

    return score


@dataclass(frozen=True)
class Model:
    """log p_target / p_raw per cell, and the cut on its mean per n-gram (None: no labels of both kinds)."""

    log_ratio: np.ndarray
    cut: float | None


def labelled(labels: DataFrame, label_rows: int = LABEL_ROWS) -> DataFrame:
    """The bounded sample of labelled rows: one per id (worst label wins), smallest hashed ids first."""
    rows = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_iw_id"))
            .agg(F.min("quality").alias("_iw_quality")))
    return rows.orderBy(F.xxhash64("_iw_id"), "_iw_id").limit(label_rows)


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, label_rows: int = LABEL_ROWS) -> Model:
    """Count both models over all of ``docs`` and fit the cut on the labelled rows."""
    spark = docs.sparkSession
    sample = labelled(labels, label_rows).collect()  # at most label_rows pairs of numbers
    known = spark.createDataFrame([tuple(r) for r in sample], "_iw_id long, _iw_quality int")
    marked = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_iw_id"), "left")
    counts = (marked.select("text", (F.coalesce("_iw_quality", F.lit(0)) > 0).alias("target"))
              .mapInArrow(_counter(buckets), "cell long, raw long, target long")
              .groupBy("cell").agg(F.sum("raw"), F.sum("target")).toPandas().to_numpy())  # at most `buckets` rows
    raw, target = np.ones(buckets), np.ones(buckets)
    if len(counts):
        raw[counts[:, 0]] += counts[:, 1]
        target[counts[:, 0]] += counts[:, 2]
    if target.sum() == buckets:  # no target text
        return Model(np.zeros(buckets), None)
    log_ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    scored = (marked.where("_iw_quality IS NOT NULL").select("_iw_quality", "text")
              .mapInArrow(_scorer(log_ratio, ("_iw_quality",)), "_iw_quality int, log_weight double, n_grams long").toPandas())
    return Model(log_ratio, best_cut(scored["log_weight"].to_numpy() / np.maximum(scored["n_grams"], 1).to_numpy(),
                                     scored["_iw_quality"].to_numpy()))


def best_cut(score: np.ndarray, quality: np.ndarray) -> float | None:
    """The middle of the widest best split: least share of good rows below plus bad rows above, good rows weighing ten times."""
    good, bad = np.sort(score[quality > 0]), np.sort(score[quality <= 0])
    if not len(good) or not len(bad):
        return None
    edges = np.unique(score)
    middle = np.concatenate([[edges[0] - 1e-9], (edges[1:] + edges[:-1]) / 2])
    loss = 10 * np.searchsorted(good, middle) / len(good) + (len(bad) - np.searchsorted(bad, middle)) / len(bad)
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    gaps = np.concatenate([[0.0], np.diff(edges)])
    return float(middle[best[np.argmax(gaps[best])]])


def score(docs: DataFrame, model: Model, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` (all, if none is named) with ``log_weight`` (double) and ``n_grams`` (long)."""
    columns = tuple(c for c in columns or docs.columns if c not in ("log_weight", "n_grams"))
    schema = StructType([*docs.select(*columns).schema.fields, StructField("log_weight", DoubleType()), StructField("n_grams", LongType())])
    return docs.select(*columns, *(["text"] if "text" not in columns else [])).mapInArrow(_scorer(model.log_ratio, columns), schema)


def accepted(model: Model):
    """Condition on scored rows: the classifier keeps them."""
    cut = F.lit(True) if model.cut is None else F.col("log_weight") / F.greatest("n_grams", F.lit(1)) >= F.lit(model.cut)
    return (F.col("n_grams") > 0) & cut


def resample(scored: DataFrame, k: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """``scored`` with its ``gumbel_key`` and ``drawn``: whether it is among the k largest keys.

    Adding Gumbel noise to log weights and taking the k largest draws k rows
    without replacement in proportion to the weights. The noise is a function of
    id and seed, so a repeated task draws the same.
    """
    unit = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    keyed = scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(unit)))
    top = keyed.where("doc_id IS NOT NULL").select("doc_id", "gumbel_key").orderBy(F.desc("gumbel_key"), "doc_id").limit(k)
    top = top.select(F.col("doc_id").alias("_iw_id")).distinct()
    joined = keyed.join(broadcast_if(top, k), F.col("doc_id") == F.col("_iw_id"), "left")
    return joined.withColumn("drawn", F.col("_iw_id").isNotNull()).drop("_iw_id")


def classify(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, label_rows: int = LABEL_ROWS) -> DataFrame:
    """The documents that the classifier keeps, with the columns of ``docs``."""
    model = fit(docs, labels, buckets, label_rows)
    clash = {c: f"_iw_own_{c}" for c in docs.columns if c in ("log_weight", "n_grams")}
    rows = docs.withColumnsRenamed(clash)
    kept = score(rows, model).where(accepted(model)).select(*rows.columns)
    return kept.withColumnsRenamed({v: k for k, v in clash.items()})
