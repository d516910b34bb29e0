"""MinHash near-dedup with an LSH forest.

Steps: (1) each text becomes its set of distinct word shingles, its MinHash
signature and a hash of the set; rows with equal sets are one class. (2) The
forest: trees of a few signature values each, as many and as deep as the similarity
asks for (``forest``). In each tree the classes with equal values form a region;
every region stays whole, however dense it is. (3) Within a region a search over
signatures finds which classes are near by estimate and emits one link for each to the
first of its component, never all pairs. A region of more than ``DENSE`` classes is not
searched: all its classes are linked to its first, and (4) settles them exactly. The
components are provisional groups, a superset of the true ones. (4) Groups are confirmed on full sets: every pair of a group
whose ends are not yet linked is settled by exact intersections, in blocks of
bounded size. Large groups are blocked: each block alone, then against the hubs
of at most ``HUBS`` blocks, then the classes outside the main component against the
other blocks, two blocks a task. Of two blocks only the classes come together that share
a shingle of their prefixes (the rarest shingles of a set, of which similar sets have
one in common), which leaves no pair of different components unexamined. (5) Components
of the confirmed links, by rounds of pointer jumping over written tables.

A pair of the asked similarity misses all regions with probability at most ``MISS`` = 1e-5
(0.85: 16 trees of 4 values, 8e-6; 0.80: 22 trees, 9e-6), in dense regions as well, and is
overlooked by the search of a region with 3e-7 at most (an estimate five deviations low);
everything after that is exact. Nothing is capped.

Defined results: a text without words or null has an empty set, size 0, and is
linked with nothing; fewer words than ``k`` give the whole sequence as one
shingle. Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Repeated rows
(same id) are one document. A null id takes no part in linking: it is its own component (null) and
kept. Extra columns pass through ``apply``; scratch columns are prefixed ``_nd_``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgscreen.llm import texthash as th
from pkgscreen.llm.base import whole_text, written
from pkgscreen.llm.components import components

SHINGLE = 3
SIMILAR = 85
DEPTH, MISS = 4, 1e-5
DENSE = 4096
BLOCK_DOCS, BLOCK_SHINGLES = 4096, 2_000_000
HUBS = 64  # blocks of a group whose hubs visit the others; only saves work, the last step examines what is left
CELLS = 1 << 18  # of the count of shingles that orders them by rarity
N = 128  # signature values
_A = th.mix(np.arange(1, N + 1, dtype=np.uint64)) | np.uint64(1)
_B = th.mix(np.arange(N + 1, 2 * N + 1, dtype=np.uint64))


def _signature(value: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """(n, N) least of N hash functions over each text's shingles; rows of empty texts are 0."""
    out = np.zeros((n, N), np.uint32)
    if len(value):
        owner, first = np.unique(text, return_index=True)
        for i in range(N):
            h = ((value * _A[i] + _B[i]) >> np.uint64(32)).astype(np.uint32)
            out[owner, i] = np.minimum.reduceat(h, first)
    return out


def _sets(k: int, batch_text) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, last, raw, at in th.chunks(batch_text, 1 << 20):
        raw = th.lower_ascii(raw)
        start, end, text = th.word_spans(raw, at)
        value, owner = th.shingle_hashes(th.span_hashes(raw, start, end), text, k)
        yield first, last, *th.distinct_per_text(value, owner)


def _signer(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, value, text in _sets(k, batch.column(1)):
                n = last - first
                size = np.bincount(text, minlength=n)
                sig = _signature(value, text, n)
                total, other = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                np.add.at(total, text, value)
                np.add.at(other, text, th.mix(value + np.uint64(11)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(size.astype(np.int64)), pa.array(total.view(np.int64)), pa.array(other.view(np.int64)),
                     pa.array([row.tobytes() for row in sig], pa.binary())], ["_nd_id", "n_shingles", "set1", "set2", "sig"])

    return sign


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """_nd_id, n_shingles, set1, set2 (the set's hash), sig (N little-endian 32-bit values)."""
    return docs.select(F.col("doc_id").alias("_nd_id"), whole_text().alias("_nd_text")).mapInArrow(
        _signer(k), "_nd_id long, n_shingles long, set1 long, set2 long, sig binary")


def forest(similar: int) -> tuple[int, int]:
    """Trees and values of each that overlook a pair of the similarity with probability MISS at most; for very low ones all values, one a tree."""
    p = min(max(similar, 1), 100) / 100
    for depth in range(DEPTH, 0, -1):
        trees = 1 if p == 1 else math.ceil(math.log(MISS) / math.log1p(-(p**depth)))
        if trees * depth <= N:
            return trees, depth
    return N, 1


def least_equal(similar: int) -> int:
    """Least number of equal signature values for a provisional link: the expected number less five deviations."""
    p = similar / 100
    return max(1, int(N * p - 5 * math.sqrt(N * p * (1 - p))))


def _labeller(similar: int):
    trees, depth = forest(similar)

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per tree and class: the key of its region."""
        for batch in batches:
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, N)[:, :trees * depth].reshape(n, trees, depth).astype(np.uint64)
            h = np.zeros((n, trees), np.uint64) + np.arange(trees, dtype=np.uint64)
            for d in range(depth):
                h = th.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, d] + np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), trees)), pa.array(h.reshape(-1).view(np.int64))], ["cls", "region"])

    return labels


def regions(classes: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(region, cls, n, first) of every region with two classes or more."""
    rows = written(classes.select("_nd_id", "sig").mapInArrow(_labeller(similar), "cls long, region long"), "labels")
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("first")).where("n > 1").withColumnRenamed("region", "of")
    return rows.join(written(sizes, "sizes"), F.col("region") == F.col("of")).select("region", "cls", "n", "first")


def _near_forest(sig: np.ndarray, need: int) -> tuple[list[int], list[int]]:
    """Components of the graph "at least ``need`` equal values" as links to their first class, by search from class to class."""
    left, a, b = np.arange(len(sig)), [], []
    while len(left) > 1:
        root, queue, left = int(left[0]), [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = (sig[left] == sig[at]).sum(1) >= need
            got = left[near]
            a += [root] * len(got)
            b += got.tolist()
            queue += got.tolist()
            left = left[~near]
    return a, b


def _linker(similar: int):
    """Provisional links of each region; rows come sorted by region."""
    need = least_equal(similar)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, cls, sig, out = None, [], [], []

        def flush():
            if len(cls) > 1:
                a, b = _near_forest(np.frombuffer(b"".join(sig), np.uint8).reshape(len(cls), N), need)
                out.append((np.asarray(cls)[a], np.asarray(cls)[b]))

        def found():
            a, b = (np.concatenate(x).astype(np.int64) for x in zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            for r, c, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if r != region:
                    flush()
                    region, cls, sig = r, [], []
                cls.append(c)
                sig.append(s)
            if out:
                yield found()
        flush()
        if out:
            yield found()

    return links


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One byte of each signature value, enough to estimate."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, N)
        low = (th.mix(sig.reshape(-1)).reshape(sig.shape) & np.uint64(255)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in low], pa.binary())], ["of", "sig"])


def provisional_links(classes: DataFrame, similar: int = SIMILAR) -> DataFrame:
    found = written(regions(classes, similar), "regions")
    short = classes.select("_nd_id", "sig").mapInArrow(_bytes_of, "of long, sig binary")
    rows = found.where(F.col("n") <= DENSE).join(short, F.col("cls") == F.col("of")).select("region", "cls", "sig")
    near = rows.repartition("region").sortWithinPartitions("region", "cls").mapInArrow(_linker(similar), "a long, b long")
    return near.unionAll(found.where((F.col("n") > DENSE) & (F.col("first") < F.col("cls"))).select(F.col("first").alias("a"), F.col("cls").alias("b")))


def _setter(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, value, text in _sets(k, batch.column(batch.num_columns - 1)):
                at = np.searchsorted(text, np.arange(last - first + 1))
                rows = pa.array([value[at[i]:at[i + 1]].tobytes() for i in range(last - first)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, last - first) for i in range(batch.num_columns - 1)), rows],
                                                 [*batch.schema.names[:-1], "shingles"])

    return sets


def exact_links(sets: list[np.ndarray], group: np.ndarray, guest: np.ndarray, similar: int) -> tuple[list[int], list[int], np.ndarray]:
    """Links of pairs in different groups that reach the similarity, and each row's group after them.

    Rows are joined from most shingles shared to fewest known only through their
    sets: each row is held against all rows of other groups at once by counting the
    postings of its shingles. Pairs of guests are skipped, they meet elsewhere.
    """
    size = np.array([len(s) for s in sets])
    every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    _, code = np.unique(every, return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(code, kind="stable")
    posting, at = row[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
    bounds = np.concatenate([[0], np.cumsum(size)])
    name = group.copy()
    a, b = [], []
    for i in range(len(sets)):
        if not size[i] or (name == name[i]).all():
            continue
        mine = code[bounds[i]:bounds[i + 1]]
        lo, hi = at[mine], at[mine + 1]
        n = hi - lo
        if n.max() < 2:
            continue
        where = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(posting[where], minlength=len(sets))
        near = np.flatnonzero((100 * both >= similar * (size + size[i] - both)) & (name != name[i]) & (both > 0))
        if guest[i]:
            near = near[~guest[near]]
        for j in near.tolist():
            if name[j] != name[i]:
                a.append(i)
                b.append(j)
                name[name == name[j]] = name[i]
    return a, b, name


def _confirmer(similar: int):
    """Rows (block, cls, group, guest, shingles) sorted by block: exact links of each block."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def flush():
            if len(held) < 2:
                return None
            cls = np.array([h[0] for h in held], np.int64)
            _, group = np.unique([h[1] for h in held], return_inverse=True)
            a, b, _ = exact_links([np.frombuffer(h[3], np.uint64) for h in held], group, np.array([h[2] for h in held]), similar)
            return pa.RecordBatch.from_arrays([pa.array(cls[a]), pa.array(cls[b])], ["a", "b"]) if a else None

        for batch in batches:
            for r, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if r != block:
                    done = flush()
                    if done is not None:
                        yield done
                    block, held = r, []
                held.append(rest)
        done = flush()
        if done is not None:
            yield done

    return confirm


def _confirm(rows: DataFrame, similar: int, name: str) -> DataFrame:
    return written(rows.select("block", "cls", "group", "guest", "shingles").repartition("block").sortWithinPartitions("block", "guest", F.xxhash64("cls"))
                   .mapInArrow(_confirmer(similar), "a long, b long"), name)


def _cells_of(shingles: np.ndarray) -> np.ndarray:
    return (th.mix(shingles) & np.uint64(CELLS - 1)).astype(np.int64)


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(CELLS, np.int64)
    for batch in batches:
        for s in batch.column(0).to_pylist():
            np.add.at(count, _cells_of(np.frombuffer(s, np.uint64)), 1)
    cell = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(count[cell])], ["cell", "n"])


def prefix(shingles: np.ndarray, count: np.ndarray, similar: int) -> np.ndarray:
    """The rarest shingles of a set, by (count of the cell, value), so many that any set of the similarity has one of them among its own."""
    n = len(shingles) - (similar * len(shingles) + 99) // 100 + 1
    return shingles[np.lexsort((shingles, count[_cells_of(shingles)]))[:n]]


def _prefixer(similar: int, counts):
    """Rows (component, part, cls, outside, shingles): a row (component, part, cls, outside, shingle) for each shingle of the prefix."""
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts.value
        for batch in batches:
            found = [prefix(np.frombuffer(s, np.uint64), count, similar) for s in batch.column(4).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            shingle = np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(4)), pa.array(shingle)], ["component", "part", "cls", "outside", "shingle"])

    return prefixes


def _meetings(named: DataFrame, similar: int) -> DataFrame:
    """(cls, lower, upper): the pairs of blocks in which a class can meet a similar one, with one of the two outside."""
    spark = named.sparkSession
    cells = named.select("shingles").mapInArrow(_cell_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    count = np.zeros(CELLS, np.int64)  # a fixed size, whatever the input
    count[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
    rows = named.select("component", "part", "cls", "outside", "shingles").mapInArrow(
        _prefixer(similar, spark.sparkContext.broadcast(count)), "component long, part int, cls long, outside boolean, shingle long")
    rows = written(rows, "prefixes")
    places = rows.groupBy("component", "shingle", "part").agg(F.max("outside").alias("any"))
    places = places.groupBy("component", "shingle").agg(F.collect_list("part").alias("parts"), F.expr("collect_list(part) FILTER (WHERE any)").alias("outer"))
    places = written(places.where("size(parts) > 1 AND size(outer) > 0"), "places").withColumnsRenamed({"component": "of", "shingle": "at"})
    met = rows.join(places, (F.col("component") == F.col("of")) & (F.col("shingle") == F.col("at")))
    met = met.select("cls", "part", F.explode(F.expr("IF(outside, parts, outer)")).alias("to")).where("to <> part").distinct()
    return met.select("cls", F.least("part", "to").alias("lower"), F.greatest("part", "to").alias("upper"))


def confirmed_links(classes: DataFrame, docs: DataFrame, links: DataFrame, k: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """All links of the provisional groups that matter for components, each confirmed on full sets."""
    groups = components(links)  # node, component
    members = groups.join(classes.select("_nd_id", "n_shingles"), F.col("node") == F.col("_nd_id"))
    blocks = members.groupBy("component").agg(F.expr(f"CAST(greatest(ceil(count(1) / {BLOCK_DOCS}), ceil(sum(n_shingles) / {BLOCK_SHINGLES})) AS INT)").alias("n_blocks"))
    placed = members.select("node", "component").join(blocks, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    text = docs.select(F.col("doc_id").alias("_nd_id"), whole_text().alias("_nd_text"))
    sets = placed.join(text, F.col("node") == F.col("_nd_id")).select("component", "n_blocks", "part", F.col("node").alias("cls"), "_nd_text")
    sets = written(sets.mapInArrow(_setter(k), "component long, n_blocks int, part int, cls long, shingles binary"), "sets").dropDuplicates(["cls"])
    block = F.xxhash64("component", "part").alias("block")
    links = _confirm(sets.select(block, "cls", F.col("cls").alias("group"), F.lit(False).alias("guest"), "shingles"), similar, "inside")
    if not blocks.where("n_blocks > 1").limit(1).count():
        return links
    sets = written(sets.where("n_blocks > 1"), "large")

    def named(known: DataFrame) -> DataFrame:
        return sets.join(known.withColumnsRenamed({"node": "cls", "component": "group"}), "cls", "left").withColumn("group", F.coalesce("group", "cls"))

    # the hubs of a block: the ends of its components with the most members
    known = written(components(links), "known")
    sizes = known.groupBy(F.col("component").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    first = sets.where(F.col("part") < HUBS).select("component", "part", "cls").join(known.withColumnsRenamed({"node": "cls", "component": "group"}), "cls").join(sizes, "group")
    hubs = first.groupBy("component", "part").agg(F.max_by("cls", F.struct("n", "cls")).alias("cls"))
    own = named(known)
    sent = (own.join(hubs.select("cls"), "cls", "left_semi").withColumn("to", F.explode(F.expr("sequence(0, n_blocks - 1)"))).where("to <> part")
            .select(F.xxhash64("component", "to").alias("block"), "cls", "group", F.lit(True).alias("guest"), "shingles"))
    found = _confirm(own.select(block, "cls", "group", F.lit(False).alias("guest"), "shingles").unionAll(sent), similar, "hubs")
    links = written(links.unionAll(found), "linked")
    # the classes outside the main component, in pairs of blocks
    own = named(written(components(links), "known2"))
    sizes = own.groupBy("component", "group").agg(F.count(F.lit(1)).alias("n"))
    main = written(sizes.groupBy("component").agg(F.max_by("group", F.struct("n", "group")).alias("main")), "main").withColumnRenamed("component", "of")
    own = written(own.join(main, F.col("component") == F.col("of")).select("component", "part", "cls", "group", (F.col("group") != F.col("main")).alias("outside"), "shingles"), "outside")
    met = _meetings(own, similar).withColumnRenamed("cls", "who")
    rows = own.join(met, F.col("cls") == F.col("who")).select(
        F.xxhash64("component", "lower", "upper").alias("block"), "cls", "group", (F.col("part") == F.col("upper")).alias("guest"), "shingles")
    return written(links.unionAll(_confirm(rows, similar, "rest")), "all-links")


def dedup(docs: DataFrame, k: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    signed = written(signatures(docs.select("doc_id", "text"), k), "signatures")
    alike = (signed.where("n_shingles > 0 AND _nd_id IS NOT NULL").groupBy("set1", "set2", "n_shingles")
             .agg(F.min("_nd_id").alias("head"), F.min_by("sig", "_nd_id").alias("sig")))
    alike = written(alike, "classes")
    classes = alike.select(F.col("head").alias("_nd_id"), "n_shingles", "sig")
    provisional = written(provisional_links(classes, similar), "provisional")
    found = components(confirmed_links(classes, docs, provisional, k, similar))
    named = alike.select("set1", "set2", F.col("n_shingles").alias("size"), "head").join(found, F.col("head") == F.col("node"), "left")
    named = written(named.select(F.col("set1").alias("c1"), F.col("set2").alias("c2"), "size", F.coalesce("component", "head").alias("component_id")), "named")
    out = signed.select("_nd_id", "n_shingles", "set1", "set2").join(
        named, (F.col("set1") == F.col("c1")) & (F.col("set2") == F.col("c2")) & (F.col("n_shingles") == F.col("size")), "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "_nd_id")).otherwise(F.col("_nd_id"))
    return out.select(F.col("_nd_id").alias("doc_id"), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("_nd_id")).alias("kept"))


def apply(docs: DataFrame, k: int = 5, similar: int = 80) -> DataFrame:
    """The kept documents with the columns of ``docs``: the one with the smallest id of each group."""
    gone = written(dedup(docs, k, similar).where("NOT kept").select(F.col("doc_id").alias("_nd_id")), "gone")
    return docs.join(gone, F.col("doc_id") == F.col("_nd_id"), "left_anti")
