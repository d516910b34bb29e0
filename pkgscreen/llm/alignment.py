"""Cross-tokenizer alignment of two vocabularies over whole texts, as an Arrow pipeline.

Each text, with a space before it, is encoded by a byte-level BPE (A) and by a
piece model (B). In a task:

1. The token lists of a slice of texts are flattened; parent indices and
   segmented cumulative sums of the tokens' byte lengths give every token its end
   in its document.
2. A full outer hash join of both sides on (document, end) keys, sorted by key,
   is the common refinement of both token sequences: each row is one overlapping
   A-B pair of occurrences (its missing token is the next one of that side), and
   rows of both sides close a group.
3. ``Table.group_by`` counts a document's links per id pair, and a block of
   documents' pairs with the number of its documents that hold them.

Spark merges these partial counts over all blocks, takes the highest count of each
A id (at most as many rows as A has ids, so it is broadcast) and brings the counts
back to the blocks, where each document looks up its own pairs. A pair that every
document holds is one row a block in every shuffle, whatever its number of
occurrences.

Both tokenizers cut at a space between two characters that are no white space (A
by its pattern; B because no piece has the word-start mark behind another
character, which is checked on loading), so the distinct words of a slice are
encoded once, and a very long text is aligned in parts that meet at such spaces.

Defined results: texts that are null or empty, or whose A or B bytes differ from
the text with its space, have no tokens: zeros and an empty ``groups_sha256``.
Every row is a document of its own, also if ids or texts repeat or are null; an
empty table gives no rows. Input columns other than ``doc_id`` and ``text`` are left out.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgscreen.llm.base import scratch_path, written

VOCABULARY_A, RANKS_A, VOCABULARY_B = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
MARK = "▁"
WORDS_BYTES = 8 << 20  # of texts whose distinct words are encoded together
SLICE_BYTES = 1 << 19  # of texts aligned at once
RUN_WORDS = 500  # encoded in one call
PART_CHARS = 1 << 20  # a longer text is cut at the next space between letters
BLOCK_PAIRS = 1 << 20  # distinct pairs, summed over documents, of a block
CHUNK = 1 << 16  # pairs of one row of partial counts
_CUT = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")
_RUN = re.compile(r"\s{64}")  # longer runs of white space exhaust the rank encoder's pattern matcher; the vocabulary file's own encoder takes them


def _file(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_signs() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b < 0x7F or 0xA1 <= b < 0xAD or b >= 0xAE]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Side:
    """One vocabulary: ``bytes`` of each id, ``encode`` a text with a space before it."""

    bytes: list[bytes]

    def tables(self) -> None:
        self.raw = pa.array(self.bytes, pa.binary())
        self.size = pc.binary_length(self.raw).cast(pa.int64())
        self.lengths = _numpy(self.size)

    def encode(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def words(self, words: pa.Array, plain: list[str]) -> pa.ListArray:
        """Ids of distinct words (given twice: Arrow and Python), encoded in runs and cut where the words end."""
        runs = [self.encode(" ".join(plain[i:i + RUN_WORDS])) for i in range(0, len(plain), RUN_WORDS)]
        ids = np.concatenate(runs) if runs else np.zeros(0, np.int32)
        ends = np.cumsum(self.lengths[ids])
        want = np.cumsum(_numpy(pc.binary_length(words)).astype(np.int64) + 1)
        last = np.searchsorted(ends, want)
        if len(want) and (ends[-1] != want[-1] or (ends[last] != want).any()):  # bytes that do not come back
            return _lists([self.encode(w) for w in plain])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], last + 1]).astype(np.int32)), pa.array(ids))


class _ByteLevel(_Side):
    def __init__(self, vocabulary: str, ranks: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(_file(vocabulary))
        self.whole.encode_special_tokens = True
        with open(_file(ranks), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        signs = _byte_signs()
        self.bytes = [b""] * self.whole.get_vocab_size()
        for entry, i in self.whole.get_vocab().items():
            self.bytes[i] = bytes(map(signs.__getitem__, entry)) if all(c in signs for c in entry) else entry.encode()
        if any(self.bytes[i] != raw for raw, i in table.items()):
            raise ValueError("the rank file is not the vocabulary's")
        self.tables()

    def encode(self, text: str) -> np.ndarray:
        if not _RUN.search(text):
            return np.array(self.plain.encode_ordinary(" " + text), np.int32)
        return np.array(self.whole.encode(" " + text, add_special_tokens=False).ids, np.int32)


class _Pieces(_Side):
    def __init__(self, vocabulary: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=_file(vocabulary))
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has the word-start mark behind another character")
        self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.tables()

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int32)


class Aligner:
    """Both vocabularies; texts to token lists, token lists to groups and links."""

    def __init__(self, a: str, ranks: str, b: str):
        self.sides = _ByteLevel(a, ranks), _Pieces(b)
        self.most = max(len(side.raw) for side in self.sides)
        if len(self.sides[0].raw) * len(self.sides[1].raw) > 1 << 31:
            raise ValueError("id pairs of these vocabularies do not fit 32 bits")
        self.signs = pa.array([f"{i}{sign}" for sign in ",|;" for i in range(self.most)])

    def tokens(self, parts: list[str]) -> list[pa.ListArray]:
        """Token lists of both sides; a distinct word is encoded once for all parts."""
        lists = pc.split_pattern(pa.array(parts, pa.string()), " ")
        coded = pc.list_flatten(lists).dictionary_encode()
        words = coded.dictionary
        clean = pc.and_(pc.and_(pc.equal(pc.utf8_trim_whitespace(words), words), pc.greater(pc.binary_length(words), 0)), pc.invert(pc.match_substring(words, MARK)))
        at = _numpy(lists.offsets)
        odd = np.add.reduceat(~_numpy(clean.take(coded.indices)), at[:-1]) > 0
        rest = np.flatnonzero(odd).tolist()  # parts with spaces in a row, beside other white space, or with the mark
        place = pc.subtract(pc.cumulative_sum(clean.cast(pa.int32())), 1).take(coded.indices.filter(pa.array(np.repeat(~odd, np.diff(at)))))
        back = np.argsort(np.concatenate([np.flatnonzero(~odd), rest]).astype(np.int64))
        out, words = [], words.filter(clean)
        plain = words.to_pylist()
        for side in self.sides:
            own = side.words(words, plain).take(place)
            ends = np.concatenate([[0], np.cumsum(np.diff(at)[~odd])])
            own = pa.ListArray.from_arrays(pa.array(_numpy(own.offsets)[ends]), own.values)
            out.append(pa.concat_arrays([own, _lists([side.encode(parts[i]) for i in rest])]).take(pa.array(back)) if rest else own)
        return out

    def align(self, parts: list[str], lists: list[pa.ListArray], doc: np.ndarray) -> dict:
        """Of parts whose bytes come back (``good``): counts, group texts and id pairs per document number in ``doc``."""
        raw = [(" " + part).encode("utf-8", "surrogatepass") for part in parts]
        good = np.array([x and y for x, y in zip(*(self._equal(x, side.raw, raw) for x, side in zip(lists, self.sides)))], bool)
        if not good.all():
            lists, doc = [x.filter(pa.array(good)) for x in lists], doc[good]
        ids = [pc.list_flatten(x) for x in lists]
        tables = [pa.table({"key": self._ends(x, flat, side.size), name: flat}) for x, flat, side, name in zip(lists, ids, self.sides, "ab")]
        cuts = tables[0].join(tables[1], keys="key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
        both = _numpy(pc.and_(cuts["a"].is_valid(), cuts["b"].is_valid()))
        parent = _numpy(cuts["key"]) >> 32
        group = np.cumsum(both) - both
        of = [group[_numpy(cuts[name].is_valid())] for name in "ab"]
        a, b = (pc.fill_null_backward(cuts[name]).cast(pa.int64()) for name in "ab")
        link = pc.add(pc.multiply(a, len(self.sides[1].raw)), b).cast(pa.int32())
        per = pa.table({"doc": doc[parent], "pair": link}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
        lengths = [np.diff(_numpy(x.offsets)) for x in lists]
        count = lambda rows: np.bincount(rows, minlength=len(doc))
        return {"good": good, "doc": doc, "n_a": lengths[0], "n_b": lengths[1], "n_groups": count(parent[both]), "n_links": count(parent), "texts": self._groups([_numpy(x) for x in ids], of, lengths, int(both.sum())), "per": per}

    @staticmethod
    def _equal(side: pa.ListArray, table: pa.Array, raw: list[bytes]) -> Iterator[bool]:
        """Whether each part's joined token bytes are its text."""
        tokens, offsets = table.take(pc.list_flatten(side)), _numpy(side.offsets) - side.offsets[0].as_py()
        at = np.frombuffer(tokens.buffers()[1], np.int32)[:len(tokens) + 1] if len(tokens) else np.zeros(1, np.int32)
        data = memoryview(tokens.buffers()[2]).cast("B") if len(tokens) else memoryview(b"")
        for start, end, text in zip(at[offsets[:-1]].tolist(), at[offsets[1:]].tolist(), raw):
            yield end - start == len(text) and data[start:end] == text

    @staticmethod
    def _ends(lists: pa.ListArray, flat: pa.Array, size: pa.Array) -> np.ndarray:
        """(part, end of the token in the part) as one number: a segmented cumulative sum over parent indices."""
        parent = _numpy(pc.list_parent_indices(lists)).astype(np.int64)
        total = _numpy(pc.cumulative_sum(size.take(flat)))
        before = np.concatenate([[0], total])[_numpy(lists.offsets)[:-1] - lists.offsets[0].as_py()]
        return (parent << 32) + total - before[parent]

    def _groups(self, ids: list[np.ndarray], of: list[np.ndarray], lengths: list[np.ndarray], groups: int) -> list[memoryview]:
        """``a1,a2|b1;...`` of each part, every id followed by its sign, as bytes."""
        held = [np.bincount(g, minlength=groups) for g in of]
        first = [np.cumsum(h) - h for h in held]
        place = [np.arange(len(ids[0])) + first[1][of[0]], np.arange(len(ids[1])) + (first[0] + held[0])[of[1]]]
        codes = np.zeros(len(ids[0]) + len(ids[1]), np.int32)
        for side in (0, 1):
            last = np.ones(len(of[side]), bool)
            last[:-1] = of[side][1:] != of[side][:-1]
            codes[place[side]] = ids[side] + self.most * np.where(last, side + 1, 0)
        if not len(codes):
            return [memoryview(b"") for _ in lengths[0]]
        text = self.signs.take(pa.array(codes))
        at = np.frombuffer(text.buffers()[1], np.int32)[:len(text) + 1]
        data, ends = memoryview(text.buffers()[2]).cast("B"), np.cumsum(lengths[0] + lengths[1])
        return [data[at[i]:at[j]] for i, j in zip((ends - lengths[0] - lengths[1]).tolist(), ends.tolist())]


def _numpy(x) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False) if isinstance(x, pa.Array) else x.to_numpy()


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


_ALIGNERS: dict[tuple[str, str, str], Aligner] = {}


def aligner(a: str, ranks: str, b: str) -> Aligner:
    if (a, ranks, b) not in _ALIGNERS:
        _ALIGNERS[a, ranks, b] = Aligner(a, ranks, b)
    return _ALIGNERS[a, ranks, b]


def _parts(text: str) -> list[str]:
    """A text cut at spaces between letters into parts of at least PART_CHARS; the spaces go with the part behind."""
    out, start = [], 0
    while len(text) - start > PART_CHARS and (cut := _CUT.search(text, start + PART_CHARS)):
        out.append(text[start:cut.start()])
        start = cut.end()
    return [*out, text[start:]]


def _slices(texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Parts with their documents' numbers, about WORDS_BYTES at a time; the parts of a document stay together."""
    parts, doc, held = [], [], 0
    for i, text in enumerate(texts):
        if text:
            if parts and held + len(text) > WORDS_BYTES:
                yield parts, np.array(doc, np.int64)
                parts, doc, held = [], [], 0
            own = _parts(text)
            parts += own
            doc += [i] * len(own)
            held += len(text)
    if parts:
        yield parts, np.array(doc, np.int64)


def _aligned(own: Aligner, parts: list[str], doc: np.ndarray) -> tuple[dict[int, dict], pa.Table]:
    """Rows of the documents whose bytes come back, and their (doc, pair, count_all), sorted by doc."""
    lists = own.tokens(parts)
    rows: dict[int, dict] = {}
    bad: set[int] = set()
    tables = []
    size = np.cumsum([len(part) for part in parts])
    at = 0
    while at < len(parts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
        got = own.align(parts[at:end], [x[at:end] for x in lists], doc[at:end])
        bad.update(doc[at:end][~got["good"]].tolist())
        for d, text, *n in zip(got["doc"].tolist(), got["texts"], *(got[c].tolist() for c in COUNTS)):
            row = rows.setdefault(d, {"sha": hashlib.sha256(), **dict.fromkeys(COUNTS, 0)})
            row["sha"].update((b";" if row["n_a"] else b"") + text[:-1])
            row.update((c, row[c] + x) for c, x in zip(COUNTS, n))
        tables.append(got["per"])
        at = end
    per = pa.concat_tables(tables).combine_chunks()
    if len(tables) > 1 and len(doc) > len(set(doc.tolist())):  # a document's parts may be in several slices
        per = per.group_by(["doc", "pair"], use_threads=False).aggregate([("count_all", "sum")]).rename_columns(["doc", "pair", "count_all"])
    if bad:
        per = per.filter(pc.invert(pc.is_in(per["doc"], pa.array(sorted(bad), pa.int64()))))
    return {d: row for d, row in rows.items() if d not in bad}, per.sort_by("doc")


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_STAGED = "doc_id {}, block string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held binary, times binary, pairs binary, docs binary, first int, kind string"


class _Block:
    """Documents until their distinct pairs reach BLOCK_PAIRS; then their rows and the block's partial counts."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.clear()

    def clear(self) -> None:
        self.rows, self.pairs, self.times, self.size = [], [], [], 0

    def add(self, rows: list[dict], pairs: np.ndarray, times: np.ndarray) -> None:
        self.rows += rows
        self.pairs.append(pairs)
        self.times.append(times)
        self.size += len(pairs)

    def batches(self) -> Iterator[pa.RecordBatch]:
        name = uuid.uuid4().hex
        coded = pa.chunked_array([pa.array(x, pa.int32()) for x in self.pairs], pa.int32()).combine_chunks().dictionary_encode() if self.size else None
        if coded is not None:
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            held, pairs = _numpy(coded.indices).astype("<i4"), _numpy(coded.dictionary).astype("<i4")
            counts = pa.table({"place": held}).group_by("place", use_threads=False).aggregate([([], "count_all")])
            docs = np.zeros(len(pairs), "<i4")
            docs[_numpy(counts["place"])] = _numpy(counts["count_all"])
            times = np.concatenate(self.times).astype("<i4")
            chunks = [{"block": name, "kind": "pairs", "first": i, "pairs": pairs[i:i + CHUNK].tobytes(), "docs": docs[i:i + CHUNK].tobytes()} for i in range(0, len(pairs), CHUNK)]
        else:
            held = times = np.zeros(0, "<i4")
            chunks = []
        at = 0
        for row in self.rows:
            row |= {"block": name, "kind": "docs", "held": held[at:at + row["n"]].tobytes(), "times": times[at:at + row["n"]].tobytes()}
            at += row.pop("n")
        rows = self.rows + chunks
        for i in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_pylist(rows[i:i + 1000], schema=self.schema)
        self.clear()
        pa.default_memory_pool().release_unused()  # a worker stays for the next stages


def _aligning(vocabularies: tuple[str, str, str], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*vocabularies)
        schema = pa.schema([("doc_id", kind), ("block", pa.string()), *[(c, pa.int64()) for c in COUNTS], ("groups_sha256", pa.string()), *[(c, pa.binary()) for c in ("held", "times", "pairs", "docs")], ("first", pa.int32()), ("kind", pa.string())])
        block = _Block(schema)
        for batch in batches:
            ids, nothing = batch.column(0).to_pylist(), set(range(batch.num_rows))
            for parts, doc in _slices(batch.column(1).to_pylist()):
                rows, per = _aligned(own, parts, doc)
                many = dict(zip(*(x.tolist() for x in np.unique(_numpy(per["doc"]), return_counts=True))))
                for d, row in rows.items():
                    row |= {"doc_id": ids[d], "groups_sha256": row.pop("sha").hexdigest(), "n": many[d]}
                nothing -= rows.keys()
                block.add([rows[d] for d in sorted(rows)], _numpy(per["pair"]), _numpy(per["count_all"]))
                if block.size >= BLOCK_PAIRS:
                    yield from block.batches()
            block.rows += [{"doc_id": ids[d], "groups_sha256": "", "n": 0, **dict.fromkeys(COUNTS, 0)} for d in sorted(nothing)]
        if block.rows:
            yield from block.batches()

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, place, pair, docs) of packed partial counts."""
    for batch in batches:
        for block, first, pairs, docs in zip(*(c.to_pylist() for c in batch.columns)):
            pairs, docs = (pa.array(np.frombuffer(x, "<i4")) for x in (pairs, docs))
            place = pa.array(np.arange(first, first + len(pairs), dtype=np.int32))
            name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(pairs), np.int32)), pa.array([block])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([name, place, pairs, docs], ["block", "place", "pair", "docs"])


def _looking(kind: pa.DataType):
    def run(key: tuple, docs: pa.Table, counts: pa.Table) -> pa.Table:
        """Sums over the links of a block's documents, whose pairs are places in the block's counts."""
        count, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, bool)
        place = _numpy(counts["place"])
        count[place], best[place] = _numpy(counts["count"]), _numpy(counts["best"])
        sums = []
        for held, times in zip(docs["held"], docs["times"]):
            at, n = np.frombuffer(held.as_buffer(), "<i4"), np.frombuffer(times.as_buffer(), "<i4").astype(np.int64)
            sums.append((int(n[best[at]].sum()), int(n @ count[at])))
        n_best, count_sum = zip(*sums) if sums else ((), ())
        pa.default_memory_pool().release_unused()
        out = [docs["doc_id"].cast(kind), *(docs[c] for c in COUNTS), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), docs["groups_sha256"]]
        return pa.table(dict(zip(("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"), out)))

    return run


def pair_counts(partial: DataFrame, ids_b: int) -> DataFrame:
    """Partial counts with each pair's corpus-wide ``count`` and whether it is the ``best`` of its A id.

    ``partial`` has one row per block and pair; a pair's rows are summed by a window,
    so its group is at most the number of blocks.
    """
    from pyspark.sql import Window

    whole = written(partial.select("block", "place", "pair", F.sum("docs").over(Window.partitionBy("pair")).alias("count")), "pair-counts")
    whole = whole.withColumn("a", F.expr(f"pair div {ids_b}"))
    top = whole.groupBy("a").agg(F.max("count").alias("top"))  # at most as many rows as A has ids
    return whole.join(F.broadcast(top), "a").select("block", "place", "count", (F.col("count") == F.col("top")).alias("best"))


def align(docs: DataFrame, a: str = VOCABULARY_A, ranks: str = RANKS_A, b: str = VOCABULARY_B) -> DataFrame:
    """Per row of ``docs``: tokens, groups, links, links of an A id's highest count, sum of counts, digest of the groups."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    field = docs.schema["doc_id"].dataType
    kind, name = to_arrow_type(field), field.simpleString()
    path = scratch_path(spark, "aligned")
    docs.mapInArrow(_aligning((a, ranks, b), kind), _STAGED.format(name)).write.partitionBy("kind").parquet(path)
    staged = spark.read.schema(_STAGED.format(name)).parquet(path)
    packed = staged.where("kind = 'pairs'").select("block", "first", "pairs", "docs")
    counts = pair_counts(packed.mapInArrow(_unpack, "block string, place int, pair int, docs int"), len(aligner(a, ranks, b).sides[1].raw))
    rows = staged.where("kind = 'docs'").select("block", "doc_id", *COUNTS, "groups_sha256", "held", "times")
    out = f"doc_id {name}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_looking(kind), out)
