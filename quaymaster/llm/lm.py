"""LM scoring by deleted interpolation of bigrams, unigrams and a uniform floor.

P(w | h) = l2 * c(h, w) / c(h) + l1 * c(w) / N + l0 / (V + 1).  The weights depend on a bucket, the
power of two of the context's count, and are learned by expectation-maximisation on counts that were
held out: those of one fold of the training texts, under counts of the other folds.  The final counts
are of all training texts.

The texts are tokenised once into chunks of a few megabytes, written to the shared folder.  Each chunk
asks for the counts of its distinct n-grams, dealt by ranges of their 64-bit names; each range adds up
and answers every chunk; a chunk is then scored with its answers.  No model is collected or broadcast:
only the weights are, whose number is fixed.

Edge cases: a null text is an empty one, a single end token; a null id counts as empty text in the
fold; repeated rows are scored one by one; without training tokens all words get the floor; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fold, mix, release, slices, staged, text_bytes
from .shingles import word_hashes

FOLDS, HELD_OUT, TUNING = 10, 0, 1
CHUNK_BYTES = 8 << 20
#: Tokens, about, whose n-grams one range adds up.
RANGE_TOKENS = 2_000_000
#: Probabilities count as equal, for the weights, within so many parts of a power of two.
STEPS = 4
BUCKETS, EM_ROUNDS = 48, 60

_U = np.uint64
_END, _START = (_U(xxhash.xxh3_64_intdigest(b" " + s)) for s in (b"end", b"start"))  # no word holds a space


def _packed(tokens: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per chunk: its texts' ids, folds and lengths, its distinct words and its tokens as places among them."""
    slim = docs.select(F.col(id_col).alias("id"), fold(id_col, FOLDS).cast("int").alias("fold"), text_bytes(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", CHUNK_BYTES):
            flat, count = word_hashes(batch.column(2).to_pylist())
            ends = np.cumsum(count)
            flat, count = np.insert(flat, ends, _END), count + 1
            owner = np.repeat(np.arange(len(count)), count)
            folds = np.asarray(batch.column(1))
            # texts of the tuning fold form chunks of their own, so that tuning moves only those
            for tuning in (False, True):
                own = (folds == TUNING) == tuning
                if own.any():
                    words, tokens = np.unique(flat[own[owner]], return_inverse=True)
                    ids = batch.column(0).filter(pa.array(own))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([serial]), pa.array([tuning]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([folds[own].astype(np.uint8).tobytes()]), pa.array([count[own].astype("<u4").tobytes()]), pa.array([words.tobytes()]), pa.array([_packed(tokens)])],
                        names=["chunk", "tuning", "ids", "folds", "counts", "words", "tokens"],
                    )
                    serial += 1

    return arrow_map(slim, cut, f"chunk long, tuning boolean, ids array<{kind}>, folds binary, counts binary, words binary, tokens binary")


class _Ngrams:
    """A chunk's tokens and their n-grams' names: odd for words, even for pairs."""

    def __init__(self, folds: bytes, counts: bytes, words: bytes, tokens: bytes):
        self.folds, self.counts = np.frombuffer(folds, np.uint8), np.frombuffer(counts, "<u4").astype(np.int64)
        words, self.tokens = np.frombuffer(words, np.uint64), _unpacked(tokens).astype(np.int64)
        self.owner = np.repeat(np.arange(len(self.counts)), self.counts)
        first = np.cumsum(self.counts) - self.counts
        after = np.roll(self.tokens, 1)
        after[first] = 0  # replaced where it matters: a text's first token has the start as its context
        context = words[after]
        context[first] = _START
        self.first, self.after = first, after
        pairs, self.pair = np.unique(mix(context * _U(0xC2B2AE3D27D4EB4F) + words[self.tokens]) & ~_U(1), return_inverse=True)
        names = np.concatenate([mix(words) | _U(1), pairs])
        self.order = np.argsort(names, kind="stable")
        self.names, self.n_words = names[self.order], len(words)
        self.end_word = int(np.flatnonzero(words == _END)[0])

    def occurrences(self) -> np.ndarray:
        """How often each name occurs in training texts, in the order of ``names``."""
        of = (self.folds != HELD_OUT)[self.owner]
        found = np.concatenate([np.bincount(self.tokens[of], minlength=self.n_words), np.bincount(self.pair[of], minlength=len(self.names) - self.n_words)])
        return found[self.order]

    def token_counts(self, answer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """c(h, w), c(h) and c(w) of every token, of counts in the order of ``names``."""
        back = np.empty(len(answer), dtype=np.int64)
        back[self.order] = answer
        words, pairs = back[: self.n_words], back[self.n_words :]
        context = words[self.after]
        context[self.first] = words[self.end_word]  # as many texts begin as end
        return pairs[self.pair], context, words[self.tokens]


def _bits(ranges: int) -> int:
    return max(0, (ranges - 1).bit_length())


def _short(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts in a byte each, and (place, count) of those that need more."""
    large = np.flatnonzero(counts > 254)
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), np.stack([large, counts[large]], axis=1).astype("<u4").tobytes()


def _long(short: bytes, large: bytes) -> np.ndarray:
    counts = np.frombuffer(short, np.uint8).astype(np.int64)
    place, count = np.frombuffer(large, "<u4").reshape(-1, 2).T
    counts[place] = count
    return counts


def _requests(chunks: DataFrame, bits: int) -> DataFrame:
    """The names that each chunk asks for in each range, with its own counts of them."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = _Ngrams(row["folds"], row["counts"], row["words"], row["tokens"])
                own = grams.occurrences()
                part = (grams.names >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams.names), np.int64)
                cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)).tolist()
                spans = list(zip(cuts, cuts[1:], strict=False))
                short, large = zip(*(_short(own[s:e]) for s, e in spans), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cuts[:-1]].astype(np.int32)), pa.array([row["chunk"]] * len(spans)), pa.array([row["tuning"]] * len(spans)), *(pa.array(c, pa.binary()) for c in ([grams.names[s:e].tobytes() for s, e in spans], short, large))],
                    names=["part", "chunk", "tuning", "names", "short", "large"],
                )

    return arrow_map(chunks, ask, "part int, chunk long, tuning boolean, names binary, short binary, large binary")


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Sums over all chunks, for every chunk; and one row (chunk null) of this range's words and tokens.

    A chunk of the tuning fold also gets the sums over the other folds (main).
    """
    distinct, where = np.unique(np.frombuffer(b"".join(group["names"]), np.uint64), return_inverse=True)
    own = [_long(s, g) for s, g in zip(group["short"], group["large"], strict=True)]
    sums = lambda rows: np.bincount(where, weights=np.concatenate(rows), minlength=len(distinct)).astype(np.int64)
    total, main = sums(own), sums([c * (not t) for c, t in zip(own, group["tuning"], strict=True)])
    word = (distinct & _U(1)) == 1
    places = np.split(where, np.cumsum([len(c) for c in own])[:-1])
    coded = [(_short(total[p]), _short(main[p]) if t else (None, None)) for p, t in zip(places, group["tuning"], strict=True)]
    rows = {"part": [int(group["part"].iloc[0])] * (len(group) + 1), "chunk": [*group["chunk"].tolist(), None]}
    for i, name in enumerate(("total", "main")):
        for j, kind in enumerate(("short", "large")):
            rows[f"{name}_{kind}"] = [*(c[i][j] for c in coded), None]
        counts = (total, main)[i][word]
        rows[f"n_{name}"] = [None] * len(group) + [int(counts.sum())]
        rows[f"v_{name}"] = [None] * len(group) + [int(np.count_nonzero(counts))]
    return pd.DataFrame(rows).astype({c: "Int64" for c in rows if c in ("part", "chunk") or c[1] == "_"})


_ANSWER = "part int, chunk long, total_short binary, total_large binary, n_total long, v_total long, main_short binary, main_large binary, n_main long, v_main long"


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 and the power of two of its count."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _together(answers: pd.DataFrame, name: str, size: int) -> np.ndarray:
    answers = answers.sort_values("part")
    found = np.concatenate([_long(s, g) for s, g in zip(answers[f"{name}_short"], answers[f"{name}_large"], strict=True)])
    if len(found) != size:
        raise RuntimeError("a chunk's answers don't fit its n-grams")
    return found


def _tuning_rows(chunk: pd.DataFrame, answers: pd.DataFrame, n: int) -> pd.DataFrame:
    """How many tokens of a tuning chunk have each (bucket, pair probability, word probability), in steps."""
    out = []
    for row in chunk.itertuples():
        grams = _Ngrams(row.folds, row.counts, row.words, row.tokens)
        pair, context, word = grams.token_counts(_together(answers, "main", len(grams.names)))
        with np.errstate(divide="ignore", invalid="ignore"):
            p2 = np.where(pair > 0, np.rint(-np.log2(pair / context) * STEPS), -1)
            p1 = np.where(word > 0, np.rint(-np.log2(word / max(n, 1)) * STEPS), -1)
        key, count = np.unique(np.stack([_bucket(context), p2.astype(np.int64), p1.astype(np.int64)]), axis=1, return_counts=True)
        out.append(pd.DataFrame({"bucket": key[0], "p2": key[1], "p1": key[2], "n": count}))
    return pd.concat(out) if out else pd.DataFrame({"bucket": [], "p2": [], "p1": [], "n": []}, dtype="int64")


def learn_weights(rows: list[tuple[int, int, int, int]], v: int) -> np.ndarray:
    """Weights (pair, word, floor) of every bucket by expectation-maximisation on (bucket, p2, p1, n)."""
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    weights[0] = [0, 0.9, 0.1]  # a context never seen has no pairs
    if not rows:
        return weights
    bucket, p2, p1, n = np.array(rows, dtype=np.int64).T
    p = np.stack([np.where(p2 < 0, 0, 2.0 ** (-p2 / STEPS)), np.where(p1 < 0, 0, 2.0 ** (-p1 / STEPS)), np.full(len(n), 1 / (v + 1))])
    for _ in range(EM_ROUNDS):
        joint = weights[bucket].T * p
        share = joint / joint.sum(axis=0) * n
        new = np.stack([np.bincount(bucket, weights=s, minlength=BUCKETS) for s in share], axis=1)
        new += np.where(weights > 0, 0.5, 0)  # keeps every weight above 0
        weights = new / new.sum(axis=1, keepdims=True)
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probability) of every row."""
    spark = docs.sparkSession
    chunks = staged(_chunks(docs, id_col, text_col), "lm-chunks")
    total = chunks.select(F.sum(F.length("counts")).alias("texts"), F.sum(F.length("words")).alias("words"), F.sum(F.length("tokens")).alias("tokens")).first()
    # about two packed bytes a token; ranges are powers of two of the names' space
    bits = _bits(max(1, int((total["tokens"] or 0) / 2 / RANGE_TOKENS)))
    asked = _requests(chunks, bits)
    answers = staged(asked.groupBy("part").applyInPandas(_answer, _ANSWER), "lm-answers")
    del asked
    release(spark)
    told = answers.where("chunk is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_main", "v_main", "n_total", "v_total")]).first()
    n_main, v_main, n_train, v_train = told
    counted = answers.where("chunk is not null")

    def tuning_rows(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _tuning_rows(left, right, n_main)

    tuning = chunks.where("tuning").select("chunk", "folds", "counts", "words", "tokens")
    own = counted.where("main_short is not null").select("part", "chunk", "main_short", "main_large")
    found = tuning.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInPandas(tuning_rows, "bucket long, p2 long, p1 long, n long")
    rows = found.groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n")).collect()  # as many as there are steps, however large the input
    weights = learn_weights([tuple(r) for r in rows], v_main)
    release(spark)
    kind = chunks.schema["ids"].dataType.elementType.simpleString()

    def scored(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            grams = _Ngrams(row.folds, row.counts, row.words, row.tokens)
            pair, context, word = grams.token_counts(_together(right, "total", len(grams.names)))
            w = weights[_bucket(context)].T
            p = w[0] * pair / np.maximum(context, 1) + w[1] * word / max(n_train, 1) + w[2] / (v_train + 1)
            base = np.log10((word + 0.1) / (n_train + 0.1 * (v_train + 1)))
            texts = len(grams.counts)
            sums = lambda x: np.bincount(grams.owner, weights=x, minlength=texts)  # noqa: B023, E731
            out.append(pd.DataFrame({
                id_col: list(row.ids), "held_out": grams.folds == HELD_OUT, "n_tokens": grams.counts, "n_known": sums(word > 0).astype(np.int64),
                "train_tokens": np.full(texts, n_train), "base_score": sums(base), "score": sums(np.log10(p)),
            }))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in (id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    whole = chunks.select("chunk", "ids", "folds", "counts", "words", "tokens")
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return whole.groupBy("chunk").cogroup(counted.select("part", "chunk", "total_short", "total_large").groupBy("chunk")).applyInPandas(scored, schema)
