"""Quality rules with thresholds that adapt to language and source.

A rule's value is a rate per word, of a count with one added where clean text has
none (so that a text without symbols says how little its length can tell). Values
are summarised per (lang, source) in a mergeable quantile sketch: counts of
logarithmic cells with relative width ``GAMMA`` (merging is adding counts, so
Spark's partial aggregation is the merge and a hot source is reduced before it is
shuffled). A language's sketch is merged with the corpus's at the weight of
``PRIOR`` documents, a group's sketch with its language's likewise, so that a small
group that is mostly junk cannot excuse itself while a large one is judged by its
own values. A rule's cut lies ``SPREAD`` times as far above the median as the upper
quartile does, by ratio for the counted rules, whose values span orders of
magnitude, and by difference for the mean length of words: no constant is a cut, or
a limit to it. Only the distance of the quartile has a least number of cells
(``RULES``), no more than ordinary groups show, for groups whose values are all alike. A document above a cut is rejected.
Joined filtering then applies the cuts.

Words are runs without ``[\\x20\\x09-\\x0D]`` of the whole text. Defined results:
null text has no words and fails the base rule; null lang or source is a group
like any other; ties with a cut are kept; repeated rows are judged alike; an
empty table gives no rows. Extra columns pass through; scratch columns carry the
prefix ``_qr_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pkgscreen.llm import texthash as th
from pkgscreen.llm.base import broadcast_if, written

GAMMA = 1.02
SPREAD = 6.0
PRIOR = 100.0
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# rule: (value from the counts, least cells from the median to the upper quartile, whether distances are ratios)
RULES = {
    "symbols": ("(n_symbols + 1) / n_words", 18, True),
    "long_words": ("word_chars / n_words", 2, False),
    "dup_lines": ("(n_dup_lines + 1) / n_words", 18, True),
    "repeats": ("(n_repeat_words + 1) / n_words", 18, True),
}
MAX_BROADCAST_GROUPS = 100_000


def _repeated(words: np.ndarray, text: np.ndarray, n: int, k: int = 3) -> np.ndarray:
    """Words of each text that lie in a k-word window found twice or more in the text."""
    if len(words) < k:
        return np.zeros(n, np.int64)
    inside = text[:len(words) - k + 1] == text[k - 1:]
    at = np.flatnonzero(inside)
    odd = np.array([pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64) for i in range(k)], np.uint64)
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h += words[i:len(words) - k + 1 + i] * odd[i]
    value, owner = th.mix(h[at]), text[at]
    order = np.lexsort((value, owner))
    v, o = value[order], owner[order]
    same = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(v), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(words), bool)
    for i in range(k):
        covered[at[order[twice]] + i] = True
    return np.bincount(text[covered], minlength=n)


def _duplicate_lines(raw: np.ndarray, at: np.ndarray, n: int, word_start: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    breaks = np.flatnonzero(raw == 10)
    text_of_break = np.searchsorted(at, breaks, "right") - 1
    line_start = np.concatenate([at[:-1], breaks + 1])
    line_owner = np.concatenate([np.arange(n), text_of_break])
    order = np.lexsort((line_start, line_owner))
    line_start, line_owner = line_start[order], line_owner[order]
    last = np.ones(len(line_start), bool)
    last[:-1] = line_owner[1:] != line_owner[:-1]
    end = np.empty(len(line_start), np.int64)
    end[:-1] = line_start[1:] - 1
    end[last] = at[line_owner[last] + 1]
    has_word = np.searchsorted(word_start, end) > np.searchsorted(word_start, line_start)
    line_start, end, line_owner = line_start[has_word], end[has_word], line_owner[has_word]
    h = th.span_hashes(raw, line_start, end)
    order = np.lexsort((h, line_owner))
    h, o = h[order], line_owner[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o[again], minlength=n)


def _counts(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    n = len(at) - 1
    start, end, text = th.word_spans(raw, at)
    words = th.span_hashes(raw, start, end)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points up to each byte
    chars = np.bincount(text, lead[end] - lead[start], n).astype(np.int64)
    sign = np.concatenate([[0], np.cumsum(np.isin(raw, np.frombuffer(SYMBOLS, np.uint8)))])
    return [np.bincount(text, minlength=n), chars, sign[at[1:]] - sign[at[:-1]], _duplicate_lines(raw, at, n, start), _repeated(words, text, n)]


def _count_batches(columns: tuple[str, ...]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(batch.num_rows, np.int64) for _ in COUNTS]
            for first, last, raw, at in th.chunks(batch.column(batch.schema.get_field_index("text"))):
                for have, new in zip(out, _counts(raw, at)):
                    have[first:last] = new
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, out)], [*columns, *COUNTS])

    return count


def with_counts(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` with the five counts of each whole text (replacing columns of those names)."""
    columns = tuple(c for c in columns if c not in COUNTS)
    schema = StructType([*docs.select(*columns).schema.fields, *(StructField(c, LongType()) for c in COUNTS)])
    return docs.select(*columns, *(["text"] if "text" not in columns else [])).mapInArrow(_count_batches(columns), schema)


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def sketches(counted: DataFrame) -> DataFrame:
    """Cells and their counts per group and rule: the merged sketches, at most a few hundred cells each."""
    cell = f"CAST(ceil(ln(v) / ln({GAMMA})) AS INT)"  # no value is zero: these documents have words
    values = ", ".join(f"'{name}', CAST({value} AS DOUBLE)" for name, (value, _, _) in RULES.items())
    return (counted.where(f"NOT ({BASE_FAILED})")
            .selectExpr("lang AS _qr_lang", "source AS _qr_source", f"stack({len(RULES)}, {values}) AS (rule, v)")
            .groupBy("_qr_lang", "_qr_source", "rule", F.expr(cell).alias("cell")).count())


def _shrinker(prior: float):
    """Rows (lang, source, rule, cells, counts, p_cells, p_counts): the sketch merged with its prior, its median's and upper quartile's cells."""
    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cells, counts, p_cells, p_counts in zip(*(batch.column(i).to_pylist() for i in range(3, 7))):
                more = np.array(p_counts) * (prior / sum(p_counts))
                cell, at = np.unique(np.array(cells + p_cells, np.int64), return_inverse=True)
                weight = np.bincount(at, np.concatenate([counts, more]))
                upto = np.cumsum(weight)
                m, u = (int(cell[np.searchsorted(upto, q * upto[-1] * (1 - 1e-12))]) for q in (0.5, 0.75))
                out.append((cell.tolist(), weight.tolist(), m, u))
            cell, weight, m, u = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(cell, pa.list_(pa.int64())), pa.array(weight, pa.list_(pa.float64())),
                                              pa.array(m, pa.int64()), pa.array(u, pa.int64())], ["_qr_lang", "_qr_source", "rule", "cells", "counts", "m", "u"])

    return shrink


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per group with the cut of each rule, read off the sketches."""
    def merged(*keys: str) -> DataFrame:
        rows = sketch.groupBy(*keys, "rule", "cell").agg(F.sum("count").alias("count"))
        rows = rows.groupBy(*keys, "rule").agg(F.sort_array(F.collect_list(F.struct("cell", "count"))).alias("s"))
        return rows.select(*keys, "rule", F.expr("CAST(s.cell AS ARRAY<BIGINT>)").alias("cells"), F.expr("CAST(s.count AS ARRAY<DOUBLE>)").alias("counts"))

    def shrunk(rows: DataFrame) -> DataFrame:
        schema = StructType([*rows.select("_qr_lang", "_qr_source", "rule", "cells", "counts").schema.fields, StructField("m", LongType()), StructField("u", LongType())])
        return rows.select("_qr_lang", "_qr_source", "rule", "cells", "counts", "p_cells", "p_counts").mapInArrow(_shrinker(PRIOR), schema)

    text = sketch.schema["_qr_source"].dataType
    corpus = merged().withColumnsRenamed({"rule": "p_rule", "cells": "p_cells", "counts": "p_counts"})  # a row per rule
    langs = merged("_qr_lang").join(F.broadcast(corpus), F.col("rule") == F.col("p_rule")).withColumn("_qr_source", F.lit(None).cast(text))
    langs = written(shrunk(langs), "languages").select(F.col("_qr_lang").alias("p_lang"), F.col("rule").alias("p_rule"), F.col("cells").alias("p_cells"), F.col("counts").alias("p_counts"))
    cells = merged("_qr_lang", "_qr_source").join(broadcast_if(langs, 1000), F.col("_qr_lang").eqNullSafe(F.col("p_lang")) & (F.col("rule") == F.col("p_rule")))
    cells = shrunk(cells).select("_qr_lang", "_qr_source", "rule", "m", "u")
    of_rule = lambda at: F.expr("CASE rule " + " ".join(f"WHEN '{name}' THEN {rule[at]}" for name, rule in RULES.items()) + " END")
    away = F.greatest(F.col("u") - F.col("m"), of_rule(1))
    median = F.pow(F.lit(GAMMA), F.col("m"))
    by_ratio, by_difference = median * F.pow(F.lit(GAMMA), SPREAD * away), median * (1 + SPREAD * (F.pow(F.lit(GAMMA), away) - 1))
    cut = F.round(F.when(of_rule(2), by_ratio).otherwise(by_difference), 9)
    return (cells.withColumn("cut", cut).groupBy("_qr_lang", "_qr_source")
            .agg(*(F.max(F.when(F.col("rule") == name, F.col("cut"))).alias(f"cut_{name}") for name in RULES)))


def judge(counted: DataFrame, cuts: DataFrame) -> DataFrame:
    """``counted`` with the cuts of its group, ``base_failed`` and ``kept``."""
    above = " OR ".join(f"coalesce(CAST({value} AS DOUBLE) > cut_{name}, false)" for name, (value, _, _) in RULES.items())
    joined = counted.join(broadcast_if(cuts, MAX_BROADCAST_GROUPS), counted.lang.eqNullSafe(cuts._qr_lang) & counted.source.eqNullSafe(cuts._qr_source), "left")
    return (joined.withColumn("base_failed", F.expr(BASE_FAILED))
            .withColumn("kept", F.expr(f"NOT base_failed AND NOT (n_words > 0 AND ({above}))")).drop("_qr_lang", "_qr_source"))


def evaluate(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, counts, cuts, ``base_failed``, ``kept`` of every document; texts are read once and not shuffled."""
    counted = written(with_counts(docs, "doc_id", "lang", "source"), "counts")
    return judge(counted, written(thresholds(sketches(counted)), "cuts"))


def apply(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``.

    Counts are written next to the rows, so that each text is counted once; the
    cuts come to the rows by a broadcast of checked size, else by a join.
    """
    clash = {c: f"_qr_own_{c}" for c in docs.columns if c in (*COUNTS, "kept", "base_failed") or c.startswith("cut_")}
    rows = docs.withColumnsRenamed(clash)
    counted = written(with_counts(rows, *rows.columns), "counted")
    kept = judge(counted, written(thresholds(sketches(counted)), "cuts")).where("kept").select(*rows.columns)
    return kept.withColumnsRenamed({v: k for k, v in clash.items()})
