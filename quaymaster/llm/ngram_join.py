"""N-gram Jaccard join by pigeonhole over a partitioned universe, verified exactly.

A set's size band fixes into how many segments its hashed tokens are dealt.  Two similar sets differ
in at most H tokens, so if levels v (0: unused, 1: equal, 2: at most one token apart) are given to the
segments with a sum of H + 1, some segment of the two fits its level.  The smaller set of a pair is
indexed in its own band: all its segments, and the one-deletion neighbourhoods of the first few.  The
larger one probes its own band and the one below, at the cheapest levels: an allocation by estimated
list length avoids empty and thin segments, which many sets share, and takes a one-deletion
neighbourhood of a thick segment instead.

Equal sets are one class from the start, and a bucket of classes is never expanded into all pairs:
first every class is verified against one probing class of its bucket, which settles buckets of two;
then against a dozen others where its buckets still span components; and only for classes that no try
has linked to the rest of their bucket are all pairs across components compared, by parity sketches
that never drop a link.  Whole sets travel only for pairs whose sketches are close.  No link between
components is lost.

Edge cases: null and empty texts, and texts without words, have an empty set and link with nothing;
fewer words than a shingle count as one shingle.  A row without an id takes no part (null results
but its set size).  Repeated rows give repeated results.  Sets are told apart by 64-bit names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix, partitions, release, slices, some, staged, text_bytes
from .components import components
from .shingles import set_key, shingle_sets

#: Cost model of the allocation: the cost of a signature, and of a segment's thinness.
SIGNATURE, THIN = 1e-4, 1e-2
#: Others that a set is tried with before all pairs of what is left.
CENTERS = 12
#: Cells of a parity sketch.
CELLS = 2048
#: Bytes of ids that are broadcast, at most; more are joined by a shuffle of the texts.
MAX_SENT = 64 << 20
#: Sets of a bucket that are compared in one piece, about.
BLOCK = 4096
_U = np.uint64


class Scheme:
    """Bands, segments and levels for links with ``percent`` * union <= 100 * intersection."""

    def __init__(self, percent: int):
        self.percent = percent
        edges = [1]
        while edges[-1] < 1 << 33:
            edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // percent)))
        self.low = np.array(edges)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def budget(self, small: int, large: int) -> int:
        """The most tokens by which linked sets of at most these sizes differ."""
        return (100 - self.percent) * (small + large) // (100 + self.percent)

    def segments(self, band: int) -> tuple[int, int]:
        """How many segments a band has, and how many of them index one-deletion neighbourhoods."""
        high = int(self.low[band + 1]) - 1
        need = self.budget(high, high * 100 // self.percent) + 1
        return need + 1 + need // 48, 1 + need // 24

    def signatures(self, tokens: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket hashes of a set and their roles (1: indexed, 2: probing, 3: both).

        ``share`` estimates, for every token, which part of all sets holds it too.
        """
        n = len(tokens)
        own = self.band(n)
        least = -(-n * self.percent // 100)
        out, roles = [], []
        for band in range(self.band(least), own + 1):
            m, twofold = self.segments(band)
            high = min(n, int(self.low[band + 1]) - 1)
            need = self.budget(high, n) + 1
            hashed = mix(tokens + _U((band + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            segment = ((hashed >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
            size = np.bincount(segment, minlength=m)
            total = np.zeros(m, dtype=np.uint64)
            np.add.at(total, segment, hashed)
            rarest = np.ones(m)  # an empty segment is shared by all sets with one
            np.minimum.at(rarest, segment, share)
            level = self._levels(size, rarest, twofold, need)
            place = (np.arange(m, dtype=np.uint64) + _U(1)) * _U(0xD6E8FEB86659FD93) + _U(band)
            exact, near = mix(total ^ place), mix((total ^ place) + _U(0xA5A5A5A5A5A5A5A5))
            role = np.where(level > 0, 2, 0) + (band == own)
            keep = role > 0
            out.append(exact[keep])
            roles.append(role[keep])
            double = np.flatnonzero(level == 2)
            out.append(near[double])  # its own segment against indexed deletions
            roles.append(np.full(len(double), 2))
            inner = segment < twofold
            seg, rest = segment[inner], total[segment[inner]] - hashed[inner]
            if band == own:
                out.append(mix((rest ^ place[seg]) + _U(0xA5A5A5A5A5A5A5A5)))
                roles.append(np.full(len(seg), 1))
            probing = level[seg] == 2  # its deletions against indexed segments
            out.append(mix(rest[probing] ^ place[seg[probing]]))
            roles.append(np.full(int(probing.sum()), 2))
        return np.concatenate(out), np.concatenate(roles)

    @staticmethod
    def _levels(size: np.ndarray, rarest: np.ndarray, twofold: int, need: int) -> np.ndarray:
        """The cheapest levels that sum to ``need``: a list is about as long as its rarest token's."""
        one = SIGNATURE + rarest + THIN * 0.3 ** np.minimum(size, 30)
        near, thick = size[:twofold], np.minimum(size[:twofold], 30)
        two = 2 * (near + 1) * SIGNATURE + (near + 2) * (rarest[:twofold] + THIN * 0.3 ** (thick - 1.0))
        cost = np.concatenate([one, np.maximum(two, one[:twofold] + 1e-12)])  # the second step never comes first
        level = np.zeros(len(size), dtype=np.int64)
        chosen = np.argsort(cost, kind="stable")[:need]
        np.add.at(level, np.where(chosen < len(size), chosen, chosen - len(size)), 1)
        return level


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket, probing rows first: those of buckets with a probing row and another set, with the first.

    ``crowd`` marks buckets that may hold more than two sets.
    """
    bucket = center = size = None  # of the run that the last batch ended in
    pending = None  # its only row, if not yet given out
    last = (None, None)
    for batch in batches:
        b, k, nr, ids = (batch.column(i) for i in range(4))
        b, k, nr = (np.asarray(c) for c in (b, k, nr))
        docs = (nr & 3) == 0
        if docs.any():
            at = np.flatnonzero(docs)
            yield pa.RecordBatch.from_arrays([pa.nulls(at.size, pa.int64()), pa.array(k[at]), pa.array(nr[at] >> 2), pa.array(np.zeros(at.size, np.int8)), pa.nulls(at.size, pa.int64()), pa.nulls(at.size, pa.int32()), pa.nulls(at.size, pa.bool_()), ids.take(pa.array(at))], names=_FOUND)
            b, k, nr = b[~docs], k[~docs], nr[~docs]
        if not b.size:
            continue
        fresh = np.ones(b.size, dtype=bool)
        fresh[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
        fresh[0] = (b[0], k[0]) != last
        last = (b[-1], k[-1])
        b, k, nr = b[fresh], k[fresh], nr[fresh]
        if not b.size:
            continue
        if pending is not None:
            b, k, nr = (np.concatenate([[p], c]) for p, c in zip(pending, (b, k, nr), strict=True))
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        run = np.repeat(np.arange(first.size), np.diff(np.append(first, b.size)))
        length = np.bincount(run)
        head, head_nr = k[first].copy(), nr[first].copy()
        if pending is None and bucket is not None and b[0] == bucket:
            head[0], head_nr[0] = center, size
            length[0] += 1
        crowd = length > 2
        crowd[[0, -1]] = True  # these may go on in another batch
        good = ((length > 1) & ((head_nr & 2) > 0))[run]
        bucket, center, size = b[-1], head[-1], head_nr[-1]
        pending = (b[-1], k[-1], nr[-1]) if length[-1] == 1 else None
        if good.any():
            c = run[good]
            yield pa.RecordBatch.from_arrays([pa.array(b[good]), pa.array(k[good]), pa.array(nr[good] >> 2), pa.array((nr[good] & 3).astype(np.int8)), pa.array(head[c]), pa.array(head_nr[c] >> 2), pa.array(crowd[c]), pa.nulls(int(good.sum()), batch.schema.field(3).type)], names=_FOUND)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The parity of the tokens in each of CELLS cells, as 64-bit words.

    Every token by which two sets differ flips one cell, so sketches never differ in more cells than
    the sets do in tokens: a pair whose sketches differ in too many is no link.
    """
    odd = np.bincount((mix(tokens) >> _U(32)).astype(np.int64) % CELLS, minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_FOUND = ["bucket", "key", "n", "role", "center", "center_n", "crowd", "id"]


def _close(x: str, y: str, n: Column, percent: int) -> Column:
    """Whether two sketches differ in no more cells than linked sets of ``n`` tokens together may."""
    apart = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(CELLS // 64)), F.lit(0))
    return apart * (100 + percent) <= n * (100 - percent)


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sketches are close enough for a link."""
    x = sets.select(F.col("key").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("as"))
    y = sets.select(F.col("key").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("bs"))
    return pairs.join(x, "a").join(y, "b").where(_close("as", "bs", F.col("an") + F.col("bn"), percent)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets are linked, by their whole sets."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x"):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = int(np.intersect1d(x, y, assume_unique=True).size)
                keep.append(100 * common >= percent * (x.size + y.size - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    x = sets.select(F.col("key").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("key").alias("b"), F.col("tokens").alias("y"))
    return arrow_map(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), verify, "a long, b long")


def _crossing(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (bucket, key, n, label, rows, sketch) that share a bucket, with other labels and close sketches.

    A bucket of many rows is dealt into blocks, and every two blocks meet in a piece of their own: so memory
    is bounded by BLOCK, and the work of a large bucket spreads over tasks.
    """
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    own = rows.withColumn("own", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    pieces = own.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "key", "n", "label", "sketch")

    def piece(split: bool, own: np.ndarray, key: np.ndarray, n: np.ndarray, label: np.ndarray, words: np.ndarray) -> np.ndarray:
        size, found = len(key), []
        step = max(1, (1 << 16) // size)
        for at in range(0, size, step):
            i, j = np.nonzero(np.arange(at, min(at + step, size))[:, None] < np.arange(size)[None, :])
            i += at
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            ok = (label[i] != label[j]) & (small * 100 >= large * percent)
            ok &= (own[i] != own[j]) | (not split)
            i, j, both = i[ok], j[ok], (small + large)[ok]
            apart = np.bitwise_count((words[i] ^ words[j]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            ok = apart * (100 + percent) <= both * (100 - percent)
            found.append(np.stack([np.minimum(key[i], key[j])[ok], np.maximum(key[i], key[j])[ok]]))
        return np.concatenate(found, axis=1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] | None = None  # rows of the piece that may go on

        def pairs(columns: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal left
            bucket, lo, hi = columns[:3]
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            cuts = [0, *cuts.tolist(), len(bucket)]
            left = None if last else [c[cuts[-2] :] for c in columns]
            found = [piece(bool(lo[s] != hi[s]), *(c[s:e] for c in columns[3:])) for s, e in zip(cuts[: len(cuts) - 1 - (not last)], cuts[1:], strict=False)]
            if found:
                a, b = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                columns = [np.asarray(c) for c in batch.columns[:-1]] + [np.asarray(batch.column(7).flatten()).reshape(-1, CELLS // 64)]
                yield from pairs(columns if left is None else [np.concatenate(c) for c in zip(left, columns, strict=True)], False)
        if left is not None:
            yield from pairs(left, True)

    dealt = pieces.repartition(partitions(rows.sparkSession), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return arrow_map(dealt, compare, "a long, b long").distinct()


def _of(rows: DataFrame, keys: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Those ``rows`` whose ``column`` is (or, left_anti, isn't) among the few ``keys``: they are broadcast if they are small, else both sides are dealt out."""
    size = keys.agg(F.sum(F.octet_length(F.col(column).cast("string")) + 32)).first()[0] or 0
    return rows.join(F.broadcast(keys) if size <= MAX_SENT else keys.hint("shuffle_hash"), column, how)


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and set_key of every row.

    Rows link when 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles;
    component_id is the smallest id reachable by links.
    """
    spark = docs.sparkSession
    scheme, few = Scheme(percent), some(spark)
    slim = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        row = 0
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            keys = np.array([set_key(s) for s in sets], dtype=np.int64)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            spread = mix((keys ^ np.arange(row, row + len(keys)) * 0x5851F42D4C957F2D).view(np.uint64)).view(np.int64)
            row += len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(keys), pa.array((sizes << 2).astype(np.int32)), batch.column(0)], names=["bucket", "key", "nr", "id"])
            buckets, owners, nrs = [], [], []
            present = batch.column(0).is_valid().to_pylist()
            fresh = []
            for s, key, here in zip(sets, keys.tolist(), present, strict=True):
                if here and len(s) and key not in seen:  # copies in this task need no second entry
                    seen.add(key)
                    fresh.append((s, key))
            # how common a token is, as these sets tell: only the cost of candidates depends on it
            flat = np.concatenate([s for s, _ in fresh]) if fresh else np.empty(0, dtype=np.uint64)
            _, where, count = np.unique(flat, return_inverse=True, return_counts=True)
            shares = np.split((count[where] - 1) / max(1, len(fresh)), np.cumsum([len(s) for s, _ in fresh])[:-1]) if fresh else []
            for (s, key), share in zip(fresh, shares, strict=True):
                found, roles = scheme.signatures(s, share)
                buckets.append(found)
                nrs.append((len(s) << 2 | roles).astype(np.int32))
                owners.append(np.full(len(found), key))
            if len(seen) > 1_000_000:
                seen.clear()
            if buckets:
                flat = np.concatenate(buckets).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.concatenate(owners)), pa.array(np.concatenate(nrs)), pa.nulls(len(flat), batch.schema.field(0).type)], names=["bucket", "key", "nr", "id"])

    signed = arrow_map(slim, sign, f"bucket long, key long, nr int, id {kind}")
    dealt = signed.repartition(partitions(spark), "bucket").withColumn("quiet", (F.col("nr").bitwiseAND(2) == 0)).sortWithinPartitions("bucket", "quiet", "key").drop("quiet")
    found = staged(arrow_map(dealt, _buckets, f"bucket long, key long, n int, role byte, center long, center_n int, crowd boolean, id {kind}"), "join-found")
    del signed, dealt
    release(spark)
    rows = found.where("role = 0").select("id", "key", F.col("n").cast("long").alias("n"))
    entries = found.where("role > 0")

    fits = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    stars = entries.where((F.col("key") != F.col("center")) & fits(F.col("n"), F.col("center_n")))
    stars = staged(stars.select(*pair("key", "center")).distinct(), "join-stars", few)

    # the sets of one row of each class that a bucket joins with another; only these texts are read again
    wanted = entries.select("key").distinct()
    reps = staged(rows.where("id is not null and n > 0").groupBy("key").agg(F.min("id").alias("id")).join(wanted, "key", "left_semi").select("id"), "join-reps", few)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # repeated rows of an id
        for batch in slices(batches, "text"):
            sets = {set_key(s): s for s in shingle_sets(batch.column(1).to_pylist(), width)}
            sets = {k: s for k, s in sets.items() if k not in seen}
            seen.update(sets)
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([s.tobytes() for s in sets.values()], pa.binary()), pa.array([sketch(s) for s in sets.values()], pa.list_(pa.int64())), pa.array([len(s) for s in sets.values()], pa.int64())], names=["key", "tokens", "sketch", "n"])

    sets = staged(arrow_map(_of(slim, reps, "id"), tokens, "key long, tokens binary, sketch array<long>, n long"), "join-sets")
    links = staged(_verified(_near(stars, sets, percent), sets, percent), "join-links", few)
    release(spark)

    label = components(links)

    def spanning(rows: DataFrame, label: DataFrame, name: str) -> DataFrame:
        """Rows of the buckets of more than two sets that span components."""
        at = rows.drop("label").join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
        split = at.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo <> hi and rows > 2").select("bucket", "rows")
        return staged(at.join(split, "bucket").select("bucket", "key", "n", "label", "rows"), name, few)

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The links among a few pairs; only their sets are dealt out."""
        pairs = staged(pairs, f"join-{name}-near", few)
        keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        return staged(_verified(pairs, _of(sets, keys, "key"), percent), f"join-{name}", few)

    # Where one center was not enough: each set against some others of the largest of its buckets that span components
    rest = spanning(entries.where("crowd").select("bucket", "key", "n"), label, "join-rest")
    drawn = [F.min_by(F.struct("key", "n", "label"), F.xxhash64("key", F.lit(i))) for i in range(CENTERS)]
    buckets = rest.groupBy("bucket").agg(F.array_distinct(F.array(*drawn)).alias("some"))
    largest = rest.groupBy("key", "n", "label").agg(F.max_by("bucket", F.struct("rows", "bucket")).alias("bucket"))
    tried = largest.join(buckets, "bucket").select("key", "n", "label", F.explode("some").alias("c"))
    tried = tried.where((F.col("label") != F.col("c.label")) & fits(F.col("n"), F.col("c.n")))
    tried = staged(tried.select(*pair("key", "c.key")).distinct().join(stars, ["a", "b"], "left_anti"), "join-tried", few)
    second = linked(_near(tried, sets, percent), "second")
    if not second.isEmpty():
        links = links.unionByName(second)
        label = components(links)

    # What is left: all pairs across components, by their sketches, whichever buckets they share
    rest = spanning(rest.drop("rows"), label, "join-left").join(sets.select("key", "sketch"), "key")
    across = _crossing(rest.select("bucket", "key", "n", "label", "rows", "sketch"), percent)
    more = linked(across.join(stars.unionByName(tried), ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        label = components(links.unionByName(more))

    named = rows.where("id is not null and n > 0").groupBy("key").agg(F.min("id").alias("first"))
    named = named.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = named.join(least, "label").select("key", "component_id")
    out = rows.withColumn("key", F.when(F.col("n") > 0, F.col("key")))
    out = out.join(named, "key", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"), F.col("key").alias("set_key"),
    )


def keep_one_per_component(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with all their columns.

    Rows without an id, and rows with an empty set, all stay.  Repeated rows of an id leave one.
    """
    found = staged(jaccard_components(docs, width, percent, id_col, text_col), "join-components", some(docs.sparkSession))
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    kept = _of(docs, gone, id_col, "left_anti").select(*[f"`{c}`" for c in docs.columns])
    repeated = found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return kept
    whole = kept.where(F.col(id_col).isNull())
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(whole)
