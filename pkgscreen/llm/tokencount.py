"""Token counts that follow edits.

Each document keeps its pre-tokens (lengths and token counts) in the leaves of a
segment tree whose inner nodes hold the sums of characters and tokens. An edit
(start, removed, inserted) finds its place by descending the sums; only the
pre-tokens it touches and the context at its borders are cut and encoded again,
and the sums above the changed leaf are updated.

``build`` cuts and encodes whole texts once and keeps each tree's leaves beside its text, a byte for most pre-tokens;
``apply_edits`` takes the kept trees up, encodes what the edits touch and returns texts and trees to keep for the next edits.

Cutting starts again before the edit at a pre-token whose own cut cannot have
looked at changed text: the one before the touched one, further back over white
space (whose pattern looks ahead). It stops at the first border behind the edit that both
the old and the new text have: from there both cut alike.

Defined results: null text is empty, a null edit list means no edits; an edit beyond the end works at the
end; edits apply in the order given. Extra columns pass through. An edit changes
its own document only, so repeated rows are independent. A row without a tree, or with one that is not as long as
its text, is built anew, and its pre-tokens count as encoded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

VOCABULARY = "byte_bpe_50k.tiktoken"
LEAF = 64
CACHE_PARTS = 800_000


class Counter(dict):
    """Tokens per pre-token of a byte-level BPE vocabulary."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern)

    def __missing__(self, part: str) -> int:
        n = len(self.encoding.encode_ordinary(part))
        if len(self) < CACHE_PARTS:
            self[part] = n
        return n


_COUNTERS: dict[str, Counter] = {}


def counter(name: str = VOCABULARY) -> Counter:
    if name not in _COUNTERS:
        import public_tokenizers

        _COUNTERS[name] = Counter(public_tokenizers.path(name), public_tokenizers.PATTERN)
    return _COUNTERS[name]


class SegmentTree:
    """Pre-tokens of one text in leaves, sums of (characters, tokens) above them."""

    def __init__(self, text: str, count: Counter, leaf: int = LEAF, kept: tuple[list[int], list[int]] | None = None):
        self.count, self.leaf, self.text, self.encoded = count, leaf, text, 0
        if kept is None:
            parts = count.cut.findall(text)
            kept = list(map(len, parts)), list(map(count.__getitem__, parts))
            self.encoded = len(parts)
        lengths, tokens = kept
        self.leaves = [(lengths[i:i + leaf], tokens[i:i + leaf]) for i in range(0, len(lengths), leaf)] or [([], [])]
        self._rebuild()

    def _rebuild(self) -> None:
        self.size = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.sums = [(0, 0)] * (2 * self.size)
        for i, (lengths, tokens) in enumerate(self.leaves):
            self.sums[self.size + i] = (sum(lengths), sum(tokens))
        for i in range(self.size - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        (a, b), (c, d) = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a + c, b + d)

    @property
    def tokens(self) -> int:
        return self.sums[1][1]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf that holds the character, its first character)."""
        i, first = 1, 0
        while i < self.size:
            i *= 2
            if place >= first + self.sums[i][0] and self.sums[i + 1][0]:
                first += self.sums[i][0]
                i += 1
        return i - self.size, first

    def edit(self, start: int, removed: int, inserted: str) -> None:
        old = self.text
        start = min(max(start, 0), len(old))
        end = min(start + max(removed, 0), len(old))
        text = old[:start] + inserted + old[end:]
        shift = len(text) - len(old)
        # first pre-token to cut again
        leaf, first = self._leaf_at(max(start - 1, 0))
        lengths, at, place = self.leaves[leaf][0], 0, first
        while at < len(lengths) and place + lengths[at] < start:
            place, at = place + lengths[at], at + 1
        back = 1  # one whole pre-token of context
        while leaf > 0 or at > 0:
            if at == 0:
                leaf -= 1
                lengths = self.leaves[leaf][0]
                at = len(lengths)
                continue
            if not back and not old[place - lengths[at - 1]:place].isspace():
                break
            back = 0
            at -= 1
            place -= lengths[at]
        from_leaf, from_at = leaf, at
        # cut the new text until a border behind the edit is one of the old text too
        reach, border = place, place
        new_lengths, new_tokens = [], []
        for m in self.count.cut.finditer(text, place):
            while border < m.end() - shift or border < end:
                if at == len(self.leaves[leaf][0]):
                    if leaf + 1 >= len(self.leaves):
                        break
                    leaf, at = leaf + 1, 0
                    continue
                border, at = border + self.leaves[leaf][0][at], at + 1
            reach = m.end()
            new_lengths.append(m.end() - m.start())
            new_tokens.append(self.count[m[0]])
            if reach >= start + len(inserted) and border == reach - shift and border >= end:
                break
        else:
            leaf, at = len(self.leaves) - 1, len(self.leaves[-1][0])
        self.encoded += len(new_lengths)
        head, tail = self.leaves[from_leaf], self.leaves[leaf]
        joined = (head[0][:from_at] + new_lengths + tail[0][at:], head[1][:from_at] + new_tokens + tail[1][at:])
        self.text = text
        if from_leaf == leaf and len(joined[0]) <= 2 * self.leaf:
            self.leaves[leaf] = joined
            i = self.size + leaf
            self.sums[i] = (sum(joined[0]), sum(joined[1]))
            while i > 1:
                i //= 2
                self._add(i)
        else:
            pieces = [(joined[0][i:i + self.leaf], joined[1][i:i + self.leaf]) for i in range(0, len(joined[0]), self.leaf)]
            self.leaves[from_leaf:leaf + 1] = pieces
            self.leaves = self.leaves or [([], [])]
            self._rebuild()


COUNTED = ("tokens_before", "n_edits", "tokens_after", "pretokens_encoded", "n_pretokens")
KEPT = "_tc_leaves"  # the leaves of a row's tree, see ``packed``
ROWS = 512  # rows a worker holds as Python texts and trees at a time


def packed(lengths: list[int], tokens: list[int]) -> bytes:
    """A byte of five bits of length and three of tokens for each pre-token; a larger one is a byte 0 and two 32-bit numbers."""
    long, many = np.array(lengths, np.uint32), np.array(tokens, np.uint32)
    large = np.flatnonzero((long > 31) | (many > 7))
    codes = (long << 3 | many).astype(np.uint8)
    if not len(large):
        return codes.tobytes()
    codes[large] = 0
    raw, full = codes.tobytes(), np.stack([long[large], many[large]], 1).astype("<u4")
    out, at = [], 0
    for place, pair in zip(large.tolist(), full):
        out += [raw[at:place + 1], pair.tobytes()]
        at = place + 1
    return b"".join([*out, raw[at:]])


def unpacked(leaves: bytes) -> tuple[list[int], list[int]]:
    lengths, tokens, at = [], [], 0
    while at < len(leaves):
        stop = leaves.find(0, at)
        codes = np.frombuffer(leaves[at:stop if stop >= 0 else len(leaves)], np.uint8)
        lengths += (codes >> 3).tolist()
        tokens += (codes & 7).tolist()
        if stop < 0:
            break
        long, many = np.frombuffer(leaves[stop + 1:stop + 9], "<u4").tolist()
        lengths.append(long)
        tokens.append(many)
        at = stop + 9
    return lengths, tokens


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            yield batch.slice(first, ROWS)


def _building(columns: tuple[str, ...], vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in _slices(batches):
            leaves = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                parts = count.cut.findall(text or "")
                leaves.append(packed(list(map(len, parts)), list(map(count.__getitem__, parts))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.binary())], [*columns, "text", KEPT])

    return run


def build(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with the tree of each text, to be written and edited later."""
    columns = tuple(c for c in docs.columns if c not in ("text", KEPT))
    schema = StructType([*docs.select(*columns).schema.fields, StructField("text", StringType()), StructField(KEPT, BinaryType())])
    return docs.select(*columns, "text").mapInArrow(_building(columns, vocabulary), schema)


def _editing(columns: tuple[str, ...], vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in _slices(batches):
            out = np.zeros((batch.num_rows, len(COUNTED)), np.int64)
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            texts, leaves = [], []
            for i, (text, edits, kept) in enumerate(zip(*(get(c).to_pylist() for c in ("text", "edits", KEPT)))):
                held = None if kept is None else unpacked(kept)
                tree = SegmentTree(text or "", count, kept=held if held and sum(held[0]) == len(text or "") else None)
                before = tree.tokens
                for e in edits or ():
                    tree.edit(e["start"] or 0, e["removed"] or 0, e["inserted"] or "")
                texts.append(tree.text if edits else text)
                lengths, tokens = ([x for leaf in tree.leaves for x in leaf[k]] for k in (0, 1))
                leaves.append(packed(lengths, tokens))
                out[i] = before, len(edits or ()), tree.tokens, tree.encoded, len(lengths)
            yield pa.RecordBatch.from_arrays([*map(get, columns), pa.array(texts, pa.string()), pa.array(leaves, pa.binary()), *(pa.array(c) for c in out.T)],
                                             [*columns, "text", KEPT, *COUNTED])

    return run


def apply_edits(trees: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Kept ``trees`` with ``edits`` (array of start, removed, inserted), edited: texts and trees to keep, and the counts before and after."""
    columns = tuple(c for c in trees.columns if c not in ("text", "edits", KEPT, *COUNTED))
    schema = StructType([*trees.select(*columns).schema.fields, StructField("text", StringType()), StructField(KEPT, BinaryType()), *(StructField(c, LongType()) for c in COUNTED)])
    return trees.select(*columns, "text", "edits", KEPT).mapInArrow(_editing(columns, vocabulary), schema)


def counts(edited: DataFrame) -> DataFrame:
    """Edited documents without texts and trees."""
    return edited.drop("text", KEPT)


def with_sample_edits(docs: DataFrame) -> DataFrame:
    """Four edits of each text, from its length and id: a word put in at a third, a cut at the middle, a changed end and a new first line."""
    n = F.length(F.coalesce("text", F.lit("")))
    edits = [((n / 3).cast("int"), F.lit(0), F.concat(F.lit(" version "), F.coalesce("doc_id", F.lit(0)).cast("string"), F.lit(" "))),
             ((n / 2).cast("int"), F.lit(17), F.lit("")), (n - 5, F.lit(5), F.lit(".\n\nit's edited")), (F.lit(0), F.lit(0), F.lit("Revised:\n"))]
    return docs.withColumn("edits", F.array(*(F.struct(F.greatest(s.cast("int"), F.lit(0)).alias("start"), r.cast("int").alias("removed"), i.alias("inserted")) for s, r, i in edits)))
