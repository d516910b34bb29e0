"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments (runs of word-start marks and the word behind) of a batch
are concatenated; a suffix array of this text, ordered by as many characters as
the longest piece has, is searched for the range of every piece at once. The occurrences are
the edges of the segments' lattices; sorted by position they are relaxed.

The vocabulary is a BPE model, for which the best path is the one that merging by
score builds: relaxation takes, round by round and in all segments at once, the
best-scored edge that joins two neighbouring symbols (leftmost on ties), until no
edge joins any. Characters without a piece become byte pieces. Segments are independent, because
no piece has the mark behind another character; this is checked on loading. Long
segments are relaxed by a heap over the same edges, so a text without spaces takes n log n steps.

Defined results: null and empty texts give no pieces; repeated rows are encoded
each. Extra columns pass through.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
CACHE_SEGMENTS = 250_000
SLICE_CHARS = 2_000_000  # of whole texts cut into segments at once
BATCH_CHARS = 400_000  # of distinct segments indexed at once
DECODED_BYTES = 16 << 20  # of ids turned into text at once
LONG = 128
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NONE = np.int64(1) << 40


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        normal = [i for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.text = {i: self.model.id_to_piece(i) for i in normal}
        if any(MARK in p.lstrip(MARK) for p in self.text.values()):
            raise ValueError("a piece has the word-start mark behind another character")
        self.byte = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        raw = {self.byte[b]: bytes([b]) for b in range(256)}
        self.bytes = pa.array([raw.get(i) or self.text.get(i, "").encode() for i in range(n)] + [b""], pa.large_binary())
        self.single = {p: i for i, p in self.text.items() if len(p) == 1}
        long = sorted((i for i, p in self.text.items() if len(p) > 1), key=lambda i: (-self.model.get_score(i), i))
        self.order = np.array(long, np.int64)  # id of the piece with each place in order of score
        self.depth = max(len(p) for p in self.text.values())
        self.length = np.array([len(self.text[i]) for i in long], np.int64)
        self.codes = np.zeros((len(long), self.depth), np.int64)
        for row, i in zip(self.codes, long):
            row[:len(self.text[i])] = [ord(c) for c in self.text[i]]
        self.cache: dict[str, bytes] = {}

    def character(self, c: str) -> list[int]:
        i = self.single.get(c)
        return [i] if i is not None else [self.byte[b] for b in c.encode("utf-8", "replace")]

    def segments(self, text: str) -> list[str]:
        return _SEGMENT.findall(self.model.normalize(text)) if text else []

    def learn(self, segments: list[str]) -> dict[str, bytes]:
        """Ids (little-endian 32-bit) of distinct segments, in groups of BATCH_CHARS characters."""
        out, group, size = {}, [], 0
        for s in segments:
            group.append(s)
            size += len(s)
            if size >= BATCH_CHARS:
                out |= self._encode(group)
                group, size = [], 0
        return out | self._encode(group) if group else out

    def _encode(self, segments: list[str]) -> dict[str, bytes]:
        size = np.array([len(s) for s in segments])
        start = np.concatenate([[0], np.cumsum(size + 1)])
        text = np.frombuffer(("\0".join(segments) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        key, rank = edges(text, suffix_array(text, self.depth), self)
        place, piece, bounds = relax(start[:-1], size, key, rank)
        code = text[np.repeat(start[:-1], np.diff(bounds)) + place]
        lone = np.flatnonzero(piece < 0)  # characters that no piece of two or more took
        distinct, which = np.unique(code[lone], return_inverse=True)
        own = [self.character(chr(c)) for c in distinct.tolist()]
        held = np.array([len(x) for x in own], np.int64)
        length = np.ones(len(piece), np.int64)
        length[lone] = held[which]
        at = np.concatenate([[0], np.cumsum(length)])
        ids = np.empty(at[-1], "<u4")
        ids[at[:-1][piece >= 0]] = self.order[piece[piece >= 0]]
        if len(lone):
            n = length[lone]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids[np.repeat(at[lone], n) + within] = np.concatenate(own)[np.repeat((np.cumsum(held) - held)[which], n) + within]
        raw, cut = ids.tobytes(), (at[bounds] * 4).tolist()
        return {s: raw[lo:hi] for s, lo, hi in zip(segments, cut[:-1], cut[1:])}

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        parts = [self.segments(t) for t in texts]
        ids = dict.fromkeys(chain.from_iterable(parts))  # of each distinct segment
        new = []
        for s in ids:
            known = self.cache.get(s)
            if known is None:
                new.append(s)
            else:
                ids[s] = known
        learnt = self.learn(new)
        ids |= learnt
        out = [b"".join(map(ids.__getitem__, p)) for p in parts]
        for s, found in learnt.items():
            if len(self.cache) >= CACHE_SEGMENTS:
                break
            if len(s) < LONG:
                self.cache[s] = found
        return out

    def decode_all(self, texts: list[bytes]) -> list[str]:
        """Pieces joined, byte pieces as UTF-8, marks as spaces without the one that encoding puts first; unknown ids are nothing."""
        out, at = [], 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= DECODED_BYTES:
                size += len(texts[end])
                end += 1
            ids = np.frombuffer(b"".join(texts[at:end]), "<u4")
            pieces = self.bytes.take(pa.array(np.minimum(ids, len(self.bytes) - 1).astype(np.int64)))
            _, offsets, data = pieces.buffers()
            bounds = np.cumsum([0, *(len(x) // 4 for x in texts[at:end])])
            cut = np.frombuffer(offsets, np.int64)[bounds].tolist() if len(ids) else [0] * len(bounds)
            data = memoryview(data).cast("B") if len(ids) and data is not None else memoryview(b"")
            out += [str(data[lo:hi], "utf-8", "replace").replace(MARK, " ").removeprefix(" ") for lo, hi in zip(cut[:-1], cut[1:])]
            at = end
        return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` (or more) characters, by doubling."""
    _, rank = np.unique(text, return_inverse=True)
    rank, n, width = rank.astype(np.int64) + 1, len(text), 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - width] = rank[width:] if width < n else 0
        key = rank * (rank.max() + 1) + after
        order = np.argsort(key)  # equal keys may come in any order
        width *= 2
        if width >= depth:
            return order
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[1], 1 + np.cumsum(k[1:] != k[:-1])])


def edges(text: np.ndarray, order: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(position * 64 + length, place in order of score) of all occurrences of pieces of two or more characters, sorted by position."""
    codes, length, n = vocabulary.codes, vocabulary.length, len(text)
    padded = np.concatenate([text, np.zeros(vocabulary.depth, np.int64)])
    lo, hi = np.zeros(len(codes), np.int64), np.full(len(codes), n, np.int64)
    for d in range(vocabulary.depth):  # narrow every piece's range by its next character, two binary searches at once
        live = np.flatnonzero((length > d) & (lo < hi))
        if not len(live):
            break
        c = codes[live, d]
        for upper in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            while True:
                open_ = a < b
                if not open_.any():
                    break
                mid = (a + b) // 2
                seen = padded[order[np.minimum(mid, n - 1)] + d]
                right = open_ & ((seen <= c) if upper else (seen < c))
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            if upper:
                top = a
            else:
                bottom = a
        lo[live], hi[live] = bottom, top
    count = np.maximum(hi - lo, 0)
    place = np.repeat(np.arange(len(codes)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    key = order[at] * 64 + length[place]
    by = np.argsort(key)  # no two are equal
    return key[by], place[by]


def _lookup(key: np.ndarray, rank: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Place in order of score of the wanted edges; _NONE where there is none."""
    if not len(key):
        return np.full(len(want), _NONE)
    at = np.minimum(np.searchsorted(key, want), len(key) - 1)
    return np.where(key[at] == want, rank[at], _NONE)


def relax(start: np.ndarray, size: np.ndarray, key: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in their segment, pieces (or -1) and bounds of each segment after joining by best edge until none is left."""
    n = len(start)
    short = np.flatnonzero(size <= LONG)
    owner = np.repeat(short, size[short])
    first = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size[short]) - size[short], size[short])
    end, piece = first + 1, np.full(len(first), -1, np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def joint(i: np.ndarray) -> np.ndarray:
        """Edge that joins symbol i with the next one."""
        out = np.full(len(i), _NONE)
        ok = i + 1 < len(first)
        ok[ok] = owner[i[ok]] == owner[i[ok] + 1]
        j = i[ok]
        width = end[j + 1] - first[j]
        fit = width < 64
        found = np.full(len(j), _NONE)
        found[fit] = _lookup(key, rank, first[j[fit]] * 64 + width[fit])
        out[ok] = found
        return out

    link = joint(np.arange(len(first)))
    while len(first):
        head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        best = np.minimum.reduceat(link * (1 << 22) + np.arange(len(link)), head)  # BATCH_CHARS + LONG < 2^22
        live = best < _NONE * (1 << 22)
        count = np.diff(np.concatenate([head, [len(first)]]))
        rest = np.repeat(live, count)
        if not rest.all():
            done.append((owner[~rest], first[~rest], piece[~rest]))
        at = best[live] % (1 << 22)
        piece[at], end[at] = link[at], end[at + 1]
        drop = np.ones(len(first), bool)
        drop[at + 1] = False
        keep = rest & drop
        where = np.cumsum(keep) - 1
        owner, first, end, piece, link = owner[keep], first[keep], end[keep], piece[keep], link[keep]
        now = where[at]
        touched = np.unique(np.concatenate([now, now[now > 0] - 1]))
        link[touched] = joint(touched)
    for s in np.flatnonzero(size > LONG).tolist():
        f, p = _relax_long(int(start[s]), int(size[s]), key, rank)
        done.append((np.full(len(f), s), np.array(f, np.int64), np.array(p, np.int64)))
    owner, first, piece = (np.concatenate(x) if done else np.zeros(0, np.int64) for x in (zip(*done) if done else [[]] * 3))
    by = np.lexsort((first, owner))
    owner, first, piece = owner[by], first[by], piece[by]
    return first - start[owner], piece, np.searchsorted(owner, np.arange(n + 1))


def _relax_long(start: int, size: int, key: np.ndarray, rank: np.ndarray) -> tuple[list[int], list[int]]:
    """The same for one long segment with a heap of the joints."""
    lo, hi = np.searchsorted(key, [start * 64, (start + size) * 64])
    edge = dict(zip(key[lo:hi].tolist(), rank[lo:hi].tolist()))
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    end, piece, alive = list(range(1, size + 1)), [-1] * size, [True] * size
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < size and end[j] - i < 64:
            r = edge.get((start + i) * 64 + end[j] - i)
            if r is not None:
                heapq.heappush(heap, (r, i, end[j]))

    for i in range(size - 1):
        offer(i)
    while heap:
        r, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= size or end[after[i]] != stop:
            continue
        j = after[i]
        alive[j], end[i], piece[i], after[i] = False, stop, r, after[j]
        if after[i] < size:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    found = [i for i in range(size) if alive[i]]
    return [start + i for i in found], [piece[i] for i in found]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    if name not in _LOADED:
        import public_tokenizers

        _LOADED[name] = Vocabulary(public_tokenizers.path(name))
    return _LOADED[name]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about SLICE_CHARS characters of text, whole texts each."""
    length = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_CHARS, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def _encoder(columns: tuple[str, ...], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(name)
        for batch in batches:
            for part in _slices(batch):
                ids = vocab.encode_all(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*map(part.column, columns), pa.array(ids, pa.binary())], [*columns, "piece_ids"])

    return run


def encode(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``piece_ids``, the ids of each whole text as little-endian 32-bit numbers."""
    columns = tuple(c for c in docs.columns if c != "piece_ids")
    return docs.select(*columns).mapInArrow(_encoder(columns, name), StructType([*docs.select(*columns).schema.fields, StructField("piece_ids", BinaryType())]))


DECODED = ("n_pieces", "ids_crc32", "decoded")


def _decoded(vocab: Vocabulary, ids: list[bytes | None]) -> list[pa.Array]:
    texts = vocab.decode_all([x or b"" for x in ids])
    return [pa.array([len(x or b"") // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x or b"") for x in ids], pa.int64()), pa.array(texts, pa.string())]


def _decoder(columns: tuple[str, ...], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(name)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), *_decoded(vocab, batch.column("piece_ids").to_pylist())], [*columns, *DECODED])

    return run


def decode(encoded: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """``encoded`` without ``piece_ids``, with n_pieces, ids_crc32 and the ``decoded`` text."""
    columns = tuple(c for c in encoded.columns if c not in ("piece_ids", *DECODED))
    kinds = {f.name: f for f in encoded.schema}
    fields = [f"`{c}` {kinds[c].dataType.simpleString()}" for c in columns]
    return encoded.select(*columns, "piece_ids").mapInArrow(_decoder(columns, name), ", ".join([*fields, "n_pieces long", "ids_crc32 long", "decoded string"]))


def _round_tripper(columns: tuple[str, ...], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(name)
        for batch in batches:
            for part in _slices(batch):
                ids = vocab.encode_all(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*map(part.column, columns), *_decoded(vocab, ids)], [*columns, *DECODED])

    return run


def round_trip(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """``decode(encode(docs))`` in one pass: one Python worker a core holds the vocabulary, and ids stay in it."""
    columns = tuple(c for c in docs.columns if c not in ("piece_ids", *DECODED))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema]
    return docs.select(*columns).mapInArrow(_round_tripper(columns, name), ", ".join([*fields, "n_pieces long", "ids_crc32 long", "decoded string"]))
