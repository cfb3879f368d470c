"""A Merkle manifest of a dataset as a postorder append log.

Rows become leaves: the SHA-256 of their columns.  The leaves of a group (say, a language) ascend in an order; each
two consecutive nodes become their parent, a lone last one too, up to the group's subroot; the subroots, in order
of their groups, likewise become the root.  A node of level ``l`` completes with the leaf that is its last one, after
all that completed with earlier leaves and after its own descendants: so its place in the log follows from the leaves
before it (``position``), and nobody has to look for it.

* Leaves are ranked in their group by a range partitioning: no task holds a group.
* Aligned builders: each takes ``2**BITS`` consecutive leaves and writes their nodes in the order in which they
  complete, a contiguous run of the log.  The builders' last nodes are the leaves of the next layer, of which there
  are 1024 times fewer: four layers are enough for 10**12 rows.
* Proofs go down again: siblings within a run are taken by their positions, and what lies above is the same
  for the whole run, so it comes along with one row per run.

Edge cases: null and empty columns differ (``-`` against ``0:``); repeated rows are leaves of their own, ties of the order
stand in order of their digests (equal rows are interchangeable, and all of one stay in one range of the sort); a null group is
the first one; a group of one row has its leaf as subroot, and a single group its subroot as root; very long texts are
hashed whole; extra columns take no part, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import binascii
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, partitions, some, staged, take_turn

#: A builder takes 2 ** BITS nodes of a level.
BITS = 10
#: A proof: for every level whether the sibling stands to the left, and its digest; null where a node is alone.
PROOF = "array<struct<left: boolean, digest: string>>"
_STEP = pa.struct([("left", pa.bool_()), ("digest", pa.string())])


def row_digest(*columns: Column) -> Column:
    """The leaf of a row: SHA-256, as lowercase hex, of ``-`` for null and of the UTF-8 length, ``:`` and the value for all else."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and its siblings lead to."""
    up = lambda node, s: F.when(s["digest"].isNull(), node).when(s["left"], F.concat(s["digest"], node)).otherwise(F.concat(node, s["digest"]))
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(up(node, s), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof, from the leaf to the root."""
    return F.array_compact(F.transform(proof, lambda s: s["digest"]))


def position(level: int, index: np.ndarray, leaves: int) -> np.ndarray:
    """Where the log of a group of ``leaves`` leaves has the nodes ``index`` of ``level``.

    A node completes with its last leaf.  The leaves before that one have completed two nodes each, but for one
    in each perfect tree that still waits for its sibling; then come the node's descendants on the right edge.
    """
    before = np.minimum((np.asarray(index, dtype=np.int64) + 1) << level, leaves) - 1
    return 2 * before - np.bitwise_count(before).astype(np.int64) + level


def _height(nodes: int) -> int:
    return (nodes - 1).bit_length()


def _parent(*nodes: bytes) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def complete(nodes: list[bytes], height: int) -> list[bytes]:
    """The nodes of an aligned builder, as hex, in the order in which they complete, up to ``height`` levels above."""
    log: list[bytes] = []
    waiting: list[bytes | None] = [None] * (height + 1)
    level = 0
    for node in nodes:
        log.append(node)
        level = 0
        while level < height and (left := waiting[level]) is not None:
            waiting[level] = None
            node = _parent(left, node)
            level += 1
            log.append(node)
        waiting[level] = node
    if level < height:  # the right edge
        node, waiting[level] = waiting[level], None
        for at in range(level, height):
            node = _parent(node) if waiting[at] is None else _parent(waiting[at], node)
            log.append(node)
    return log


def _ranked(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with index, from 0 in the order within their group, and leaves, the group's rows; and the most rows of a group.

    Rows are sorted into ranges; then only the counts of each group in each range meet.
    """
    spark = rows.sparkSession
    ranges = rows.repartitionByRange(partitions(spark), group, *order).sortWithinPartitions(group, *order)
    ranges = staged(ranges.withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    ranges = ranges.withColumn("_range", F.shiftright("_at", 33))
    counts = ranges.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(group)
    before = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("leaves"))
    counts = staged(counts, "merkle-counts", some(spark))
    most = counts.agg(F.max("leaves")).first()[0] or 1
    return ranges.join(counts, [group, "_range"]).withColumn("index", F.col("_before") + F.col("_at") - F.col("_first")), most


def _nodes(leaves: int, layer: int, bits: int) -> int:
    """The nodes of a group on the level that a layer starts from."""
    return ((leaves - 1) >> (bits * layer)) + 1


def _built(nodes: DataFrame, kept: str, layer: int, bits: int) -> DataFrame:
    """One row per aligned builder of ``nodes`` (group, leaves, index, digest, kept): what it took, and its run of the log."""
    taken = nodes.groupBy("group", "leaves", F.shiftright("index", bits).alias("block")).agg(F.sort_array(F.collect_list(F.struct("index", "digest", "kept"))).alias("entries"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("merkle")
        for batch in batches:
            digests = batch.column(3).flatten().field("digest").to_pylist()
            runs, at = [], 0
            for leaves, n in zip(batch.column(1).to_pylist(), batch.column(3).value_lengths().to_pylist(), strict=True):
                log = complete([d.encode() for d in digests[at : at + n]], min(bits, _height(_nodes(leaves, layer, bits))))
                runs.append(binascii.unhexlify(b"".join(log)))
                at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, pa.binary())], names=["group", "leaves", "block", "entries", "nodes"])

    kind = f"group string, leaves long, block long, entries array<struct<index: long, digest: string, kept: {kept}>>, nodes binary"
    return staged(arrow_map(taken, build, kind), f"merkle-layer{layer}")


def _proofs_within(nodes: bytes, block: int, taken: int, size: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each node that a builder took and each level above: is the sibling to the left, is there one, and its digest."""
    height = min(bits, _height(size))
    log = np.frombuffer(binascii.hexlify(nodes), dtype="S64")
    index = (block << bits) + np.arange(taken)
    first = int(position(0, index[:1], size)[0])
    left, there = np.zeros((taken, height), bool), np.zeros((taken, height), bool)
    digest = np.zeros((taken, height), "S64")
    for level in range(height):
        own = index >> level
        left[:, level], there[:, level] = own & 1, (own ^ 1) <= (size - 1) >> level
        at = there[:, level]
        digest[at, level] = log[position(level, own[at] ^ 1, size) - first]
    return left, there, digest


def _proof_array(left: np.ndarray, there: np.ndarray, digest: np.ndarray) -> pa.ListArray:
    """Matrices, a row for each proof, as an Arrow array."""
    rows, steps = left.shape
    offsets = np.arange(rows * steps + 1, dtype=np.int32) * 64
    texts = pa.Array.from_buffers(pa.string(), rows * steps, [pa.py_buffer(np.packbits(there.ravel(), bitorder="little")), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(digest))])
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * steps), pa.StructArray.from_arrays([pa.array(left.ravel()), texts], fields=list(_STEP)))


def _descended(blocks: DataFrame, above: DataFrame, kept: str, layer: int, bits: int) -> DataFrame:
    """group, subroot, index, digest, kept and the whole proof of every node that the builders took; ``above`` has (group, block, subroot, path)."""
    met = blocks.join(above, ["group", "block"]).select("group", "subroot", "leaves", "block", "path", "nodes", "entries")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("merkle")
        for batch in batches:
            for i in range(batch.num_rows):
                leaves, block, path, nodes = (batch.column(c)[i].as_py() for c in (2, 3, 4, 5))
                entries = batch.column(6).slice(i, 1).flatten()
                taken = len(entries)
                own = _proofs_within(nodes, block, taken, _nodes(leaves, layer, bits), bits)
                shared = ([s["left"] for s in path], [s["digest"] is not None for s in path], [(s["digest"] or "").encode() for s in path])
                proofs = _proof_array(*(np.hstack([x, np.tile(np.array(y, x.dtype), (taken, 1))]) for x, y in zip(own, shared, strict=True)))
                same = pa.array(np.full(taken, i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(same), batch.column(1).take(same), *(entries.field(f) for f in ("index", "digest", "kept")), proofs], names=["group", "subroot", "index", "digest", "kept", "proof"])

    return arrow_map(met, extract, f"group string, subroot string, index long, digest string, kept {kept}, proof {PROOF}")


@dataclass
class Trees:
    """The trees of all groups: a layer has one row per aligned builder, layers stand from the leaves up."""

    layers: list[DataFrame]
    kept: list[str]
    bits: int

    def _tops(self, layer: int) -> DataFrame:
        """The only builders of their groups in a layer: their last nodes are the subroots."""
        return self.layers[layer].where(F.shiftright(F.col("leaves") - 1, self.bits * layer) < 1 << self.bits)

    @property
    def roots(self) -> DataFrame:
        """group and subroot."""
        parts = [self._tops(k).select("group", F.lower(F.hex(F.substring("nodes", -32, 32))).alias("subroot")) for k in range(len(self.layers))]
        return functools.reduce(DataFrame.unionByName, parts)

    @property
    def log(self) -> DataFrame:
        """Every node: group, position in the group's log, level, index there and digest."""
        parts, bits = [], self.bits
        for layer, blocks in enumerate(self.layers):

            def place(batches: Iterator[pa.RecordBatch], layer: int = layer) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i in range(batch.num_rows):
                        group, leaves, block, nodes, taken = (c[i].as_py() for c in batch.columns)
                        size = _nodes(leaves, layer, bits)
                        index = [((block << bits) + np.arange(taken)[:: 1 << level]) >> level for level in range(min(bits, _height(size)) + 1)]
                        level = np.repeat(np.arange(len(index)), [len(x) for x in index])
                        index = np.concatenate(index)
                        order = np.argsort(np.concatenate([position(at, index[level == at], size) for at in range(level[-1] + 1)]))
                        level, index = level[order], index[order]
                        whole = np.empty_like(index)
                        for at in range(level.max() + 1):
                            whole[level == at] = position(at + bits * layer, index[level == at], leaves)
                        new = (level > 0) | (layer == 0)
                        digest = np.frombuffer(binascii.hexlify(nodes), "S64")[new].astype(str)
                        yield pa.RecordBatch.from_arrays([pa.array([group] * int(new.sum()), pa.string()), *(pa.array(x[new]) for x in (whole, level + bits * layer, index)), pa.array(digest.tolist(), pa.string())], names=["group", "position", "level", "index", "digest"])

            parts.append(arrow_map(blocks.select("group", "leaves", "block", "nodes", F.size("entries").alias("taken")), place, "group string, position long, level long, index long, digest string"))
        return functools.reduce(DataFrame.unionByName, parts)

    def proofs(self, above: DataFrame) -> DataFrame:
        """group, subroot, index, digest, kept and proof of every leaf; ``above`` has group, subroot and path: what lies above a subroot."""
        found = None
        for k in reversed(range(len(self.layers))):
            here = self._tops(k).select("group", "block").join(above, "group").select("group", "block", "subroot", "path")
            if found is not None:
                here = here.unionByName(found.select("group", F.col("index").alias("block"), "subroot", F.col("proof").alias("path")))
            found = _descended(self.layers[k], here, self.kept[k], k, self.bits)
        return found


def grow(leaves: DataFrame, order: list[str], bits: int) -> Trees:
    """The trees over ``leaves`` (group, digest, kept), which ascend by ``order``."""
    nodes, most = _ranked(leaves, "group", order)
    kept = [leaves.schema["kept"].dataType.simpleString()]
    layers = [_built(nodes, kept[0], 0, bits)]
    while _nodes(most, len(layers) - 1, bits) > 1 << bits:
        k = len(layers)
        last = F.lower(F.hex(F.substring("nodes", -32, 32)))
        up = layers[-1].where(F.shiftright(F.col("leaves") - 1, bits * (k - 1)) >= 1 << bits)
        layers.append(_built(up.select("group", "leaves", F.col("block").alias("index"), last.alias("digest"), F.lit(True).alias("kept")), "boolean", k, bits))
        kept.append("boolean")
    return Trees(layers, kept, bits)


@dataclass
class Manifest:
    """A dataset's trees: one for each group, and the one over their subroots."""

    groups: Trees
    top: Trees

    @property
    def root(self) -> str | None:
        """The root; None for no rows."""
        found = self.top.roots.first()
        return found and found["subroot"]

    def proofs(self) -> DataFrame:
        """leaf, subroot, root, proof and the kept columns of every row."""
        none = F.array().cast(PROOF)
        above = self.top.proofs(self.top.roots.withColumn("path", none)).select(F.col("kept").alias("group"), F.col("digest").alias("subroot"), F.col("proof").alias("path"))
        found = self.groups.proofs(above)
        return found.select("kept.*", F.col("digest").alias("leaf"), "subroot", F.lit(self.root).cast("string").alias("root"), "proof")


def manifest(rows: DataFrame, leaf: Column, group: Column, order: list[Column], keep: list[Column], bits: int = BITS) -> Manifest:
    """Build the manifest of ``rows``; the columns ``keep`` stay with the leaves, ``order`` and then the digest order a group's."""
    key = F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))  # null first
    slim = rows.select(key.alias("group"), leaf.alias("digest"), F.struct(*keep).alias("kept"), *[c.alias(f"_order{i}") for i, c in enumerate(order)])
    slim = staged(slim, "merkle-leaves")
    groups = grow(slim, [*(f"_order{i}" for i in range(len(order))), "digest"], bits)
    tops = groups.roots.select(F.lit("").alias("group"), F.col("subroot").alias("digest"), F.col("group").alias("kept"))
    return Manifest(groups, grow(tops, ["kept"], bits))
