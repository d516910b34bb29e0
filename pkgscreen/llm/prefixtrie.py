"""Prefix trie of rebuilt conversations by composable fingerprints.

Conversation c is rebuilt from the first h turns of conversation c-c%5 and its own
turns behind its first h, h = crc32(decimal c) % 9. No rebuilt text is made:

1. Stored turns get a content hash each. They are range-partitioned by
   conversation and order; every range folds its prefixes' fingerprints, and the
   ranges' borders (a row a range) carry them on, so a conversation may span many
   ranges. A fingerprint of n turns is the sum of hash(i) * B^i modulo a prime, for
   four bases B: an element of a monoid whose product is (value, n) * (value', n') =
   (value + B^n * value', n + n').
2. A rebuilt prefix is the product of a base's head and a slice of the own suffix,
   written down from four stored values of each.
3. Equal (depth, fingerprint) are one node. In each group the parents' fingerprints
   and last turns' hashes must agree, and stored turns of one hash, found by their
   references, must be the same role and text; both together prove by induction that
   grouped prefixes are equal. If any differ, all is done again with other bases.
4. A node's name is (smallest member, depth). Sums over subtrees take only nodes of
   two members or more (below them are bare chains) and double their reach with
   every round, so a chain of n turns takes log n rounds.
5. Member lists are range-sorted, joined to strings by range, and digested in order.

Defined results: turns go by ``turn`` (null first), ties by role, then content
hash; repeated rows are turns of their own; null roles and texts are empty; rows
without ``conv_id`` take no part; remainders are as in SQL (the sign of c); an
empty table has no conversation and gives no rows. Input columns other than the
four are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgscreen.llm.base import whole_text, written

PRIME = (1 << 31) - 1
LANES = 4
HEAD = 8  # the longest head that a rebuilt conversation takes
FAMILY = 5
CHUNK_CHARS = 1 << 16  # of a member list joined by one range
MASK = (1 << 31) - 1


def bases(salt: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{salt}/{i}".encode()).digest()[:8], "big") % (PRIME - 2) + 2 for i in range(LANES)]


def _powers(base: int, n: np.ndarray) -> np.ndarray:
    out, square, n = np.ones(len(n), np.uint64), np.uint64(base), n.astype(np.uint64)
    while n.any():
        out = np.where(n & np.uint64(1), out * square % np.uint64(PRIME), out)
        square, n = square * square % np.uint64(PRIME), n >> np.uint64(1)
    return out


def _lanes(name: str) -> list[str]:
    return [f"{name}{i}" for i in range(LANES)]


def stored_turns(conversations: DataFrame, salt: int) -> DataFrame:
    """Turns with a reference, the lanes ``t`` of their content hash and their text's bytes, written once."""
    turns = conversations.where("conv_id IS NOT NULL").select(F.monotonically_increasing_id().alias("ref"), F.col("conv_id").cast("long").alias("conv_id"), "turn", whole_text("role").alias("role"), whole_text("text").alias("text"))
    for i in (0, 1):
        turns = turns.withColumn(f"hash{i}", F.xxhash64(F.lit(2 * salt + i), "role", "text"))
    lane = lambda i: (F.shiftrightunsigned(f"hash{i // 2}", 31 * (i % 2)).bitwiseAND(MASK) % PRIME).cast("int")
    return written(turns.select("ref", "conv_id", "turn", "role", "text", *(lane(i).alias(f"t{i}") for i in range(LANES)), F.octet_length("text").cast("long").alias("size")), "turns")


_SCANNED = f"part int, row long, conv_id long, pos long, {', '.join(f'{c} int' for k in 'tgw' for c in _lanes(k))}, size long"


def _scanning(own: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places and prefix fingerprints within a range of sorted turns."""
        last, count, sums, row = None, 0, [np.uint64(0)] * LANES, 0
        for batch in batches:
            part, conv = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            n = len(conv)
            if not n:
                continue
            new = np.ones(n, bool)
            new[1:] = conv[1:] != conv[:-1]
            goes_on = last is not None and conv[0] == last
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            pos = np.arange(n) - first + 1 + np.where(first == 0, count if goes_on else 0, 0)
            columns: dict[str, np.ndarray] = {}
            for i, base in enumerate(own):
                t = batch.column(2 + i).to_numpy(zero_copy_only=False).astype(np.uint64)
                w = t * _powers(base, pos) % np.uint64(PRIME)
                total = np.concatenate([[np.uint64(0)], np.cumsum(w)])
                g = (total[1:] - total[first] + np.where(first == 0, sums[i] if goes_on else np.uint64(0), np.uint64(0))) % np.uint64(PRIME)
                columns |= {f"t{i}": t, f"g{i}": g, f"w{i}": w}
                sums[i] = g[-1]
            last, count = conv[-1], int(pos[-1])
            lanes = [pa.array(columns[c].astype(np.int32)) for k in "tgw" for c in _lanes(k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(row, row + n)), batch.column(1), pa.array(pos), *lanes, batch.column(2 + LANES)], ["part", "row", "conv_id", "pos", *(c for k in "tgw" for c in _lanes(k)), "size"])
            row += n

    return run


def scanned_turns(turns: DataFrame, own: list[int]) -> DataFrame:
    """Every stored turn with its place ``pos`` (from 1) in its conversation, its prefix's fingerprint ``g`` and its own share ``w`` of it."""
    spark = turns.sparkSession
    order = ["conv_id", "turn", "role", *_lanes("t"), "ref"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.select(*order, "size").repartitionByRange(n, *order).sortWithinPartitions(*order)
    local = written(dealt.select(F.spark_partition_id().alias("part"), "conv_id", *_lanes("t"), "size").mapInArrow(_scanning(own), _SCANNED), "scanned")
    # borders: one row a range
    border = local.groupBy("part").agg(F.min_by("conv_id", "row").alias("first"), F.max_by(F.struct("conv_id", "pos", *_lanes("g")), "row").alias("last"))
    before, starts = None, []
    for b in sorted(border.collect(), key=lambda b: b.part):
        conv, count, value = b["last"][0], b["last"][1], list(b["last"][2:])
        if before and before[0] == b["first"]:
            shift = [pow(x, before[1], PRIME) for x in own]
            starts.append((b.part, b["first"], before[1], *before[2], *shift))
            if conv == b["first"]:
                count, value = before[1] + count, [(x + m * y) % PRIME for x, m, y in zip(before[2], shift, value)]
        before = (conv, count, value)
    schema = f"part int, first long, before long, {', '.join(f'{c} long' for k in 'bm' for c in _lanes(k))}"
    joined = local.join(F.broadcast(spark.createDataFrame(starts, schema)), ["part"], "left")
    on = F.coalesce(F.col("conv_id") == F.col("first"), F.lit(False))
    moved = [F.when(on, (F.col(f"b{i}") + F.col(f"m{i}") * F.col(f"g{i}")) % PRIME).otherwise(F.col(f"g{i}")).cast("long").alias(f"g{i}") for i in range(LANES)]
    moved += [F.when(on, F.col(f"m{i}") * F.col(f"w{i}") % PRIME).otherwise(F.col(f"w{i}")).cast("long").alias(f"w{i}") for i in range(LANES)]
    return joined.select("conv_id", (F.col("pos") + F.when(on, F.col("before")).otherwise(0)).alias("pos"), *_lanes("t"), *moved, "size")


def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % (HEAD + 1)


def _packed(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 31).bitwiseOR(b.cast("long"))


def _plans(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per conversation: h, k turns taken from the base, fingerprints of base head and own head, length; and the bases' heads."""
    h = head_length(F.col("conv_id"))
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), *(F.max(F.when(F.col("pos") == h, F.col(f"g{i}"))).alias(f"o{i}") for i in range(LANES)))
    heads = turns.where((F.col("pos") <= HEAD) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    values = heads.groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct(*_lanes("g"))))).alias("head"))  # at most HEAD entries
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", head_length(F.col("conv_id")))
    own = own.join(values, "base", "left").withColumn("k", F.least("h", F.coalesce(F.size("head"), F.lit(0)).cast("long")))
    own = own.withColumn("k", F.greatest("k", F.lit(0).cast("long"))).withColumn("at", F.when(F.col("k") > 0, F.element_at("head", F.col("k"))))
    lanes = [F.coalesce(F.col(f"at.g{i}"), F.lit(0)).alias(f"k{i}") for i in range(LANES)] + [F.coalesce(f"o{i}", F.lit(0)).alias(f"o{i}") for i in range(LANES)]
    return own.select("conv_id", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"), *lanes), heads


def paths(turns: DataFrame, own: list[int]) -> DataFrame:
    """A row per rebuilt conversation and depth from 1: fingerprints of the prefix (``g``) and of its parent (``q``), last turn's hash."""
    plan, heads = _plans(turns)
    plan = written(plan, "plans")
    g = [F.col(f"g{i}") for i in range(LANES)]
    q = [(F.col(f"g{i}") - F.col(f"w{i}") + PRIME) % PRIME for i in range(LANES)]
    columns = ["conv_id", "depth", *(f"{k}{p}" for k in "gqt" for p in ("a", "b")), "size", "last"]

    def shape(df: DataFrame) -> DataFrame:
        lanes = {f"{k}{p}": _packed(x[2 * j], x[2 * j + 1]) for k, x in (("g", g), ("q", q), ("t", [F.col(c) for c in _lanes("t")])) for j, p in enumerate("ab")}
        return df.withColumns(lanes).withColumn("last", F.col("depth") == F.col("length")).select(*columns)

    taken = plan.select("conv_id", "base", "k", "length").join(heads, "base").where("pos <= k").withColumn("depth", F.col("pos"))
    mine = turns.where(F.col("pos") > head_length(F.col("conv_id"))).join(plan, "conv_id").withColumn("depth", F.col("k") + F.col("pos") - F.col("h"))
    moved = {}
    for i, base in enumerate(own):
        inverse = pow(base, -1, PRIME)
        back = F.element_at(F.array(*(F.lit(pow(inverse, j, PRIME)).cast("long") for j in range(HEAD + 1))), (F.col("h") - F.col("k") + 1).cast("int"))
        moved[f"g{i}"] = (F.col(f"k{i}") + (F.col(f"g{i}") - F.col(f"o{i}") + PRIME) % PRIME * back) % PRIME
        moved[f"w{i}"] = F.col(f"w{i}") * back % PRIME
    return written(shape(taken).unionAll(shape(mine.withColumns(moved))), "paths"), plan


def _nodes(path: DataFrame) -> DataFrame:
    checks = [F.min(c) != F.max(c) for c in ("qa", "qb", "ta", "tb")]
    differ = checks[0]
    for c in checks[1:]:
        differ = differ | c
    return written(path.groupBy("depth", "ga", "gb").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("qa").alias("qa"), F.min("qb").alias("qb"), F.min("size").alias("size"), differ.alias("differ")), "nodes")


def _turns_differ(turns: DataFrame) -> bool:
    """Whether stored turns of one content hash hold different roles or texts; only hashes of several turns are looked up."""
    shared = turns.groupBy(*_lanes("t")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    held = turns.select(*_lanes("t"), F.struct("role", "text").alias("content")).join(shared, _lanes("t"))
    return bool(held.groupBy(*_lanes("t")).agg((F.min("content") != F.max("content")).alias("differ")).where("differ").limit(1).count())


def _subtree_sums(nodes: DataFrame, deepest: int) -> DataFrame:
    """(conv_id, depth, leaf, saved) summed over subtrees, for nodes with (conv_id, depth, up, leaf, saved)."""
    now, reach = written(nodes, "reach"), 1
    while reach <= deepest:
        sums = now.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - reach).alias("depth")).agg(F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"))
        over = now.select(F.col("conv_id").alias("up"), (F.col("depth") + reach).alias("depth"), F.col("up").alias("next"))
        after = now.join(sums, ["conv_id", "depth"], "left").join(over, ["up", "depth"], "left")
        total = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaf", "saved")]
        now, reach = written(after.select("conv_id", "depth", F.col("next").alias("up"), *total), "reach"), 2 * reach
    return now.drop("up")


_CHUNKS = "conv_id long, depth long, part int, seq int, whole boolean, members string"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined members of a range's nodes; ``whole`` is false where a node's list may go on in another row."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()), ("members", pa.string())])
    node, seq, own, size, part, first, rows = None, 0, [], 0, 0, True, []

    def row(whole: bool) -> dict:
        return {"conv_id": node[0], "depth": node[1], "part": part, "seq": seq, "whole": whole, "members": ",".join(own)}

    for batch in batches:
        for part, conv, depth, member in zip(*(c.to_pylist() for c in batch.columns)):
            if (conv, depth) != node:
                if node is not None:
                    rows.append(row(not first and seq == 0))
                    first = False
                node, seq, own, size = (conv, depth), 0, [], 0
            elif size > CHUNK_CHARS:
                rows.append(row(False))
                seq, own, size = seq + 1, [], 0
            own.append(str(member))
            size += len(own[-1]) + 1
        if len(rows) > 1000:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows = []
    if node is not None:
        rows.append(row(False))
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each node, in order."""
    node, sha, rows = None, None, []
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "ends_sha256"])
    for batch in batches:
        for conv, depth, members in zip(*(c.to_pylist() for c in batch.columns)):
            if (conv, depth) != node:
                if node is not None:
                    rows.append((*node, sha.hexdigest()))
                node, sha = (conv, depth), hashlib.sha256()
                sha.update(members.encode())
            else:
                sha.update(b"," + members.encode())
        if len(rows) > 1000:
            yield pack()
            rows = []
    if node is not None:
        rows.append((*node, sha.hexdigest()))
        yield pack()


def _end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes with members (conv_id, depth, member) that end there."""
    order = ["conv_id", "depth", "member"]
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.repartitionByRange(n, *order).sortWithinPartitions(*order)
    chunks = written(dealt.select(F.spark_partition_id().alias("part"), *order).mapInArrow(_chunks, _CHUNKS), "members")
    whole = chunks.where("whole").select("conv_id", "depth", F.sha2(F.encode("members", "UTF-8"), 256).alias("ends_sha256"))
    split = chunks.where("NOT whole").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part", "seq")
    return whole.unionAll(split.select("conv_id", "depth", "members").mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string"))


def trie(conversations: DataFrame, salt: int = 0) -> DataFrame:
    """A row per node: (conv_id, depth) its name, parent, members, children, leaves and saved tokens of its subtree, members that end there."""
    while True:
        stored = stored_turns(conversations, salt)
        own = bases(salt)
        path, plan = paths(scanned_turns(stored, own), own)
        found = _nodes(path)
        if not found.where("differ").limit(1).count() and not _turns_differ(stored):
            break
        salt += 1
    root = plan.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    first = F.broadcast(root.select(F.col("conv_id").alias("root")))  # one row
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("ga").alias("qa"), F.col("gb").alias("qb"), F.col("conv_id").alias("up"))
    deeper = found.where("depth > 1").join(above, ["depth", "qa", "qb"])
    columns = ["conv_id", "depth", "up", "n_convs", "size", "ga", "gb"]
    nodes = deeper.select(*columns).unionAll(found.where("depth = 1").join(first).withColumnRenamed("root", "up").select(*columns))
    nothing = F.lit(None).cast("long")
    nodes = written(nodes.unionAll(root.select("conv_id", F.lit(0).cast("long"), nothing, "n_convs", F.lit(0).cast("long"), nothing, nothing)), "tree")
    children = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.sum((F.col("n_convs") == 1).cast("long")).alias("bare"))
    nodes = written(nodes.join(children, ["conv_id", "depth"], "left").fillna(0, ["n_children", "bare"]), "children")
    shared = nodes.where("n_convs > 1 OR depth = 0")
    shared = shared.select("conv_id", "depth", "up", (F.col("bare") + (F.col("n_children") == 0).cast("long")).alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    sums = _subtree_sums(shared, deepest)
    named = nodes.select("ga", "gb", "depth", F.col("conv_id").alias("node"))
    ends = path.where("last").select("depth", "ga", "gb", F.col("conv_id").alias("member")).join(named, ["depth", "ga", "gb"]).select(F.col("node").alias("conv_id"), "depth", "member")
    ends = ends.unionAll(plan.where("length = 0").join(first).select("root", F.lit(0).cast("long"), F.col("conv_id").alias("member")))
    out = nodes.join(sums, ["conv_id", "depth"], "left").join(_end_digests(ends), ["conv_id", "depth"], "left")
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", F.coalesce("leaf", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
