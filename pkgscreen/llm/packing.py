"""Best-fit packing of token pieces into sequences.

``tokenize`` turns every whole text into ids, ends it with ``end_id`` and cuts
only what is longer than ``size`` into pieces. ``pack`` places the pieces:

1. Range-sort: pieces are range-partitioned by length (then document), so equal
   lengths that a third of all pieces share still spread over partitions; each
   gets its rank within its length from a local rank and the ranges' counts.
2. Bulk-synchronous best fit: in each round one sweep over pieces and gaps in
   falling order of size matches each piece with its successor, the smallest gap
   still free that holds it, at most one piece per sequence; conflicts for a gap
   go by rank; gaps are updated; rounds repeat until nothing fits, then sequences
   are opened for the largest pieces left over, as few as their tokens need.
3. Pieces meet their places by rank.

Both sides of a sweep are runs of equal pieces and equal gaps (a length, its
count), so its state has at most ``size`` lengths however many documents there
are; the sweeps run on these counts on the driver, while documents and tokens
never leave the tasks. That keeps dozens of rounds from being dozens of jobs.

Defined results: null text is empty and gives one piece with the end id; rows
that repeat are packed as often as they occur; an empty table gives no rows.
Input columns other than ``doc_id`` and ``text`` are left out.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgscreen.llm.base import written

SIZE = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS, CACHE_PARTS = 150_000, 250_000
# the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SIGN = {b: chr(b) for b in _SELF} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SELF)}


class _Words(dict):
    """Ids (as bytes) of words split at white space; exact, since no token spans white space.

    Plain words (ASCII and Latin letters, digits, signs) are cut by the
    tokenizer's own pattern and looked up per part; any other goes to the
    tokenizer whole.
    """

    # fixed values: the vocabulary's pre-token pattern, for characters where it needs no Unicode tables
    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿß]+|[0-9]|[^\\sa-z0-9à-öø-ÿß]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if self.PLAIN.fullmatch(word) and "<|" not in word:
            ids = b"".join(map(self.part, self.PARTS.findall(word.lower())))
        else:
            ids = self.encode(word)
        if len(self) < CACHE_WORDS:
            self[word] = ids
        return ids

    def part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            signs = part if part.isascii() else "".join(_SIGN[b] for b in part.encode())
            ids = np.array([t.id for t in self.whole.model.tokenize(signs)], "<u4").tobytes()
            if len(self.parts) < CACHE_PARTS:
                self.parts[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_CACHE: dict[str, _Words] = {}
_SPACE = re.compile("[ \t\n\r]+")


def _vocabulary(name: str) -> _Words:
    if name not in _CACHE:
        import public_tokenizers

        _CACHE[name] = _Words(name if os.path.sep in name else public_tokenizers.path(name))
    return _CACHE[name]


def _tokenizer(size: int, end_id: int, vocabulary: str, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _vocabulary(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = b"".join(map(words.__getitem__, filter(None, _SPACE.split(text or "")))) + end
                for piece, start in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[start:start + 4 * size]
                    rows.append((doc, piece, start // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None))
            doc, piece, start, length, crc, own = zip(*rows) if rows else ([], [], [], [], [], [])
            columns = [pa.array(doc, batch.schema.field(0).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(own, pa.binary())] if with_ids else []), names + ["ids"] * with_ids)

    return cut


def tokenize(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_tokenizer(size, end_id, vocabulary, with_ids),
                                                   f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def _ranker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the rank of each piece among those of its length in this partition; rows come sorted by length."""
    length, seen = None, 0
    for batch in batches:
        own = batch.column(batch.schema.get_field_index("length")).to_numpy()
        if not len(own):
            continue
        new = np.concatenate([[True], own[1:] != own[:-1]])
        first = np.flatnonzero(new)
        rank = np.arange(len(own)) - np.repeat(first, np.diff(np.concatenate([first, [len(own)]])))
        if own[0] == length:
            rank[:first[1] if len(first) > 1 else None] += seen
        length, seen = own[-1], int(rank[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], [*batch.schema.names, "_rank"])


def ranked(pieces: DataFrame) -> DataFrame:
    """Pieces range-sorted by falling length, with their range and their rank within range and length."""
    keys = [F.col("length").desc(), "doc_id", "piece", "start"]
    rows = pieces.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(_ranker, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", _rank long").withColumn("_range", F.spark_partition_id())


def sweep(pieces: list[list[int]], gaps: list[list[int]]) -> tuple[list[tuple[int, int, int, int, int]], list[list[int]], list[list[int]]]:
    """One round: (length, first rank, count, first sequence, gap) of the matches, pieces left, gaps after it.

    ``pieces`` are runs [length, first rank, count], ``gaps`` runs [gap, first
    sequence, count], both in falling order. Gaps are stacked while they hold the next
    run; the top of the stack is each piece's successor.
    """
    placed, left, stack, after, at = [], [], [], [], 0
    for length, rank, count in pieces:
        while at < len(gaps) and gaps[at][0] >= length:
            stack.append(list(gaps[at]))
            at += 1
        while count and stack:
            gap, sequence, free = stack[-1]
            n = min(count, free)
            placed.append((length, rank, n, sequence, gap))
            after.append([gap - length, sequence, n])
            rank, count = rank + n, count - n
            if n == free:
                stack.pop()
            else:
                stack[-1][1:] = [sequence + n, free - n]
        if count:
            left.append([length, rank, count])
    return placed, left, sorted(stack + gaps[at:] + after, key=lambda x: -x[0])


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Places of all pieces as runs: (length, first rank, count, first sequence, offset).

    Run i of a match puts rank first+i into sequence first+i at the offset.
    """
    pieces = [[length, 0, counts[length]] for length in sorted(counts, reverse=True) if counts[length]]
    places, gaps, opened = [], [], 0

    def open_for(runs):
        nonlocal opened
        for length, rank, n in runs:
            places.append((length, rank, n, opened, 0))
            if length < size:
                gaps.append([size - length, opened, n])
            opened += n

    large = [p for p in pieces if 2 * p[0] > size]  # no two of them fit together
    open_for(large)
    pieces = pieces[len(large):]
    while pieces:
        gaps = sorted((g for g in gaps if g[0] >= pieces[-1][0]), key=lambda x: -x[0])
        placed, pieces, gaps = sweep(pieces, gaps)
        places += [(length, rank, n, sequence, size - gap) for length, rank, n, sequence, gap in placed]
        if pieces and not placed:
            need, seeds = -(-sum(length * n for length, _, n in pieces) // size), []
            while need and pieces:
                length, rank, n = pieces[0]
                take = min(n, need)
                seeds.append([length, rank, take])
                need -= take
                pieces = ([[length, rank + take, n - take]] if take < n else []) + pieces[1:]
            open_for(seeds)
    return places


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    spark = pieces.sparkSession
    # written first: range partitioning reads its input twice, once for the borders
    rows = written(ranked(written(pieces, "pieces")), "ranked")
    ranges = rows.groupBy("length", "_range").count().toPandas().sort_values(["length", "_range"])  # each range holds few lengths: ranges + size rows
    ranges["first"] = ranges.groupby("length")["count"].cumsum() - ranges["count"]
    counts = {int(k): int(v) for k, v in ranges.groupby("length")["count"].sum().items()}
    places = pd.DataFrame(plan(counts, size), columns=["length", "rank", "n", "sequence", "offset"])
    cut = _by_range(places, ranges)
    schema = "p_length long, p_range int, p_from long, p_to long, p_sequence long, p_offset long"
    where = spark.createDataFrame(cut, schema) if len(cut) else spark.createDataFrame([], schema)
    met = rows.join(where, (F.col("length") == F.col("p_length")) & (F.col("_range") == F.col("p_range")) & (F.col("_rank") >= F.col("p_from")) & (F.col("_rank") < F.col("p_to")))
    return met.select(*pieces.columns, (F.col("p_sequence") + F.col("_rank") - F.col("p_from")).alias("sequence_id"), F.col("p_offset").alias("offset"))


def _by_range(places: pd.DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
    """Runs of places cut at the ranges' borders, with ranks local to the range."""
    out = []
    by_length = {k: (g["_range"].to_numpy(), g["first"].to_numpy(), g["count"].to_numpy()) for k, g in ranges.groupby("length")}
    for length, rank, n, sequence, offset in places.itertuples(index=False):
        part, first, count = by_length[length]
        i = int(np.searchsorted(first, rank, "right")) - 1
        while n:
            here = min(n, int(first[i] + count[i]) - rank)
            if here > 0:
                out.append((length, int(part[i]), rank - int(first[i]), rank - int(first[i]) + here, sequence, offset))
                rank, n, sequence = rank + here, n - here, sequence + here
            i += 1
    return pd.DataFrame(out, columns=["p_length", "p_range", "p_from", "p_to", "p_sequence", "p_offset"])
