"""Line dedup with keep bitmaps, in DataFrame operations only.

Lines become 128-bit hashes of their keys; hashes are range-partitioned together
with the document, with a secondary sort by document and position, and the sorted
stream yields each key's first occurrence in each document. Counting those gives
the documents per key (a partial count per partition is merged, so a key that a
third of all documents hold is spread over many ranges and reduced before it
moves). What comes back is one compressed bitmap per document that loses a line,
64 lines to a word, bit set = keep; texts are never shuffled by line.

A key is the line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z
lower-cased. Two policies: ``drop="all"`` removes every line whose key at least
``min_docs`` documents hold; ``drop="later"`` keeps of such keys the first line
(smallest doc_id, then position) of all.

Defined results: null or empty text is one empty line, which has no key and
stays; keys shorter than ``min_chars`` code points are exempt. Rows that share
id and text are one document with as many copies of its result; rows that share
only the id are different documents. Null ids are documents too. An empty table
gives none. Extra columns pass through ``apply``; scratch columns carry the
prefix ``_ld_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pkgscreen.llm.base import whole_text, written

MIN_DOCS = 10
MIN_CHARS = 1
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _identified(docs: DataFrame) -> DataFrame:
    """``docs`` with the identity of each document and its text's lines."""
    text = whole_text()
    return docs.withColumns({"_ld_id": F.coalesce("doc_id", F.lit(-1).cast("long")), "_ld_text": F.xxhash64(text, F.col("doc_id").isNull())})


def _lines(text) -> F.Column:
    return F.split(text, "\n", -1)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line with a key: document, position, two 64-bit hashes of the key."""
    key = F.translate(F.btrim(F.col("_ld_line"), F.lit(SPACE)), UPPER, LOWER)
    lines = _identified(docs).select("_ld_id", "_ld_text", F.posexplode(_lines(whole_text())).alias("_ld_pos", "_ld_line"))
    return (lines.select("_ld_id", "_ld_text", "_ld_pos", key.alias("_ld_key")).where(F.length("_ld_key") >= min_chars)
            .select("_ld_id", "_ld_text", "_ld_pos", F.xxhash64("_ld_key").alias("_ld_h1"), F.xxhash64(F.lit(7), "_ld_key").alias("_ld_h2")))


def sorted_occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Line keys in ranges of (hash, document), sorted by position, with ``first``: the key's first line of its document."""
    keys = ["_ld_h1", "_ld_h2", "_ld_id", "_ld_text"]
    ranged = line_keys(docs, min_chars).repartitionByRange(*keys)
    return ranged.withColumn("first", F.row_number().over(Window.partitionBy(*keys).orderBy("_ld_pos")) == 1)


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, drop: str = "all") -> DataFrame:
    """One row per document that loses lines: identity, ``n_dropped`` and ``keep`` (array of 64-bit words)."""
    occurrences = written(sorted_occurrences(docs, min_chars), "lines")
    # written, so that the join below starts from two scans and a hot key's lines can be split among tasks
    frequent = written(occurrences.where("first").groupBy("_ld_h1", "_ld_h2")
                .agg(F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("_ld_id", "_ld_text", "_ld_pos")).alias("_ld_head")).where(F.col("n_docs") >= min_docs), "frequent")
    lost = occurrences.join(frequent.withColumnsRenamed({"_ld_h1": "_ld_f1", "_ld_h2": "_ld_f2"}),
                            (F.col("_ld_h1") == F.col("_ld_f1")) & (F.col("_ld_h2") == F.col("_ld_f2")))
    if drop == "later":
        lost = lost.where(~((F.col("_ld_head._ld_id") == F.col("_ld_id")) & (F.col("_ld_head._ld_text") == F.col("_ld_text")) & (F.col("_ld_head._ld_pos") == F.col("_ld_pos"))))
    words = (lost.select("_ld_id", "_ld_text", "_ld_pos", F.expr("CAST(_ld_pos DIV 64 AS INT)").alias("word")).distinct()
             .groupBy("_ld_id", "_ld_text", "word").agg(F.bit_or(F.expr("shiftleft(1L, _ld_pos % 64)")).alias("gone"), F.count(F.lit(1)).alias("n")))
    return (words.groupBy("_ld_id", "_ld_text")
            .agg(F.sum("n").alias("n_dropped"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "gone")))).alias("gone"), F.max("word").alias("_ld_last"))
            .select("_ld_id", "_ld_text", "n_dropped", F.expr("transform(sequence(0, _ld_last), w -> ~coalesce(gone[w], 0L))").alias("keep")))


def joined(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped``, ``keep`` and ``kept_text``; a document without a bitmap stays as it is."""
    left = _identified(docs).withColumn("_ld_lines", whole_text())
    # merged at every size: a bitmap is as long as its document, so their number bounds no broadcast
    both = left.join(bitmaps.withColumnsRenamed({"_ld_id": "_ld_b1", "_ld_text": "_ld_b2"}).hint("merge"),
                     (F.col("_ld_id") == F.col("_ld_b1")) & (F.col("_ld_text") == F.col("_ld_b2")), "left")
    kept = F.expr("array_join(filter(split(_ld_lines, '\\n', -1), (x, i) -> coalesce(get(keep, CAST(i DIV 64 AS INT)), -1L) & shiftleft(1L, i % 64) != 0), '\\n')")
    return both.select(*docs.columns, F.size(_lines(F.col("_ld_lines"))).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
                       "keep", F.when(F.col("keep").isNull(), F.col("_ld_lines")).otherwise(kept).alias("kept_text"))


def dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, drop: str = "all") -> DataFrame:
    bitmaps = written(keep_bitmaps(docs.select("doc_id", "text"), min_docs, min_chars, drop), "bitmaps")
    return joined(docs, bitmaps)


def apply(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, drop: str = "all") -> DataFrame:
    """``docs`` with the lost lines taken out of ``text`` and ``n_chars`` counted anew; a null text stays null."""
    clash = {c: f"_ld_own_{c}" for c in docs.columns if c in ("n_lines", "n_dropped", "keep", "kept_text")}
    done = dedup(docs.withColumnsRenamed(clash), min_docs, min_chars, drop)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    done = done.withColumn("text", text)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*(F.col(clash.get(c, c)).alias(c) for c in docs.columns))
