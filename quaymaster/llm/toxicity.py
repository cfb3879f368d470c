"""Toxicity by a linear-chain conditional random field.

Documents are labelled, words are not: in labelled toxic documents of the training part, the words
whose form (the word, or its first letters) tells toxic from other documents (in contexts that are not
copies) are labelled as offending, all others as not.  A two-state chain (offending or not) over the words of a sentence is
fitted to them, with the word and its beginnings and endings as features and with transitions.
Forward-backward marginals of all words give a document's score, by a logistic map of their sum and
maximum fitted on the same documents, and the offsets of offending words.

The model is fitted on a bounded sample of labelled rows (``max_toxic`` and ``max_clean`` documents,
those with the smallest hashes of their ids, and ``max_bytes`` of text; a text that doesn't fit any more
is left out, and if none fits, that is a warning); every document is scored whole, and a
sentence is one chain however long it is.

Edge cases: a null or empty text has no words and gets the score of no offence; rows of the label table
without a label or id are passed over, contradictory labels count as toxic; without labelled toxic
rows every score is 0; repeated rows are scored one by one; an empty table gives no rows.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fold, slices, take_turn, text_bytes

FOLDS, HELD_OUT = 4, 2
#: Labelled documents that the model is fitted on, at most.
MAX_TOXIC, MAX_CLEAN = 1000, 2000
#: Bytes of their texts, at most.
MAX_BYTES = 32 << 20
CACHED_WORDS = 300_000
ROUNDS, RATE, PENALTY = 60, 0.4, 1e-4
#: A form marks a word if its log odds reach this, and so do its documents' log likelihood ratio against chance.
LEAST_ODDS, LEAST_EVIDENCE = 2.5, 8.0
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_STOP = (b".", b"!", b"?")


def _forms(word: bytes) -> list[bytes]:
    """The word without outer punctuation, and its beginnings, each as a text of its own kind."""
    core = word.strip(_EDGE).decode("utf-8", "replace")
    out = [b"w" + core.encode()]
    if core.isalpha():
        out += [b"%d" % n + core[:n].encode() for n in (4, 5, 6) if len(core) > n]
    return out


def features(word: bytes) -> list[int]:
    core = word.strip(_EDGE).decode("utf-8", "replace")
    more = [b"e%d" % n + core[-n:].encode() for n in (3, 4) if len(core) > n]
    return [xxhash.xxh3_64_intdigest(f) for f in [*_forms(word), *more]]


@dataclass
class Model:
    """Weights of the chain and of the map to a document's score."""

    names: np.ndarray  # of features, sorted
    emission: np.ndarray
    chain: np.ndarray  # start, and transitions clean to offending, offending to clean, offending to offending
    map: np.ndarray  # constant, log of the sum of marginals, their maximum


class _Scores(dict):
    """A word's emission and whether it ends a chain, kept for words seen lately."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.weights = dict(zip(model.names.tolist(), model.emission.tolist(), strict=True))

    def __missing__(self, word: bytes) -> float:
        s = sum(self.weights.get(f, 0.0) for f in features(word))
        self[word] = s = s + (1e6 if word.endswith(_STOP) else 0.0)  # the flag rides on the score
        return s


def _chains(ends: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chains begin, and how long they are: at texts and after sentence ends."""
    n = len(ends)
    begin = np.zeros(n, dtype=bool)
    begin[1:] = ends[:-1]
    begin[(np.cumsum(count) - count)[count > 0]] = True
    first = np.flatnonzero(begin)
    return first, np.diff(np.append(first, n))


def _marginals(score: np.ndarray, first: np.ndarray, length: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chance of every word to be offending; and the expected transitions, summed (for fitting).

    All chains advance in lockstep, the longest first; both states' weights are scaled at each step.
    """
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    live = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
    weight = np.exp(np.clip(score, -30, 30))
    begin, c_o, o_c, o_o = np.exp(chain)
    odds = np.empty_like(score)  # forward: offending against clean
    for t, m in enumerate(live):
        at = first[:m] + t
        if t == 0:
            odds[at] = begin * weight[at]
        else:
            p = odds[at - 1] / (1 + odds[at - 1])
            odds[at] = weight[at] * ((1 - p) * c_o + p * o_o) / ((1 - p) + p * o_c)
    ahead = np.ones_like(score)  # backward: weight of what follows, offending against clean
    moves = np.zeros(3)
    for t in range(len(live) - 1, 0, -1):
        at = first[: live[t]] + t
        w = weight[at] * ahead[at]
        p = odds[at - 1] / (1 + odds[at - 1])
        after_clean, after_off = 1 + c_o * w, o_c + o_o * w
        ahead[at - 1] = after_off / after_clean
        total = (1 - p) * after_clean + p * after_off
        moves += [((1 - p) * c_o * w / total).sum(), (p * o_c / total).sum(), (p * o_o * w / total).sum()]
    both = odds * ahead
    return both / (1 + both), moves


def _tokens(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray]:
    split = [t.lower().split() for t in texts]
    return split, np.fromiter(map(len, split), dtype=np.int64, count=len(split))


def _aggregate(marginal: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Rows (1, log of the sum, maximum) of every document."""
    total, top = np.zeros(len(count)), np.zeros(len(count))
    start, some = np.cumsum(count) - count, count > 0
    if some.any():
        total[some] = np.add.reduceat(marginal, start[some])
        top[some] = np.maximum.reduceat(marginal, start[some])
    return np.stack([np.ones(len(count)), np.log1p(10 * total), top], axis=1)


def fit(texts: list[bytes], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """Fit the chain and the map; ``weight`` says how many documents each one stands for."""
    places: dict[bytes, int] = {}
    kinds = [np.fromiter((places.setdefault(w, len(places)) for w in t.lower().split()), dtype=np.int32) for t in texts]
    count = np.array([len(k) for k in kinds], dtype=np.int64)
    kind = np.concatenate(kinds)
    stop = np.fromiter((w.endswith(_STOP) for w in places), dtype=bool, count=len(places))
    lists = [features(w) for w in places]
    names, flat = np.unique(np.fromiter((f for fs in lists for f in fs), dtype=np.uint64), return_inverse=True)
    of = np.repeat(np.arange(len(lists), dtype=np.int32), [len(fs) for fs in lists])
    del lists
    # document frequencies of forms in both classes, by places of distinct forms
    lists = [[xxhash.xxh3_64_intdigest(f) for f in _forms(w)] for w in places]
    del places
    sizes = np.array([len(fs) for fs in lists], dtype=np.int64)
    distinct, form = np.unique(np.fromiter((f for fs in lists for f in fs), dtype=np.uint64), return_inverse=True)
    del lists
    begin = np.cumsum(sizes) - sizes
    frequency = np.zeros((2, len(distinct)))
    # copies of a text tell nothing new: a word counts once between the same two neighbours
    context = (kind.astype(np.int64) * 0x9E3779B1 + np.roll(kind, 1)) * 0x85EBCA77 + np.roll(kind, -1)
    new = np.zeros(len(kind), dtype=bool)
    new[np.unique(context, return_index=True)[1]] = True
    del context
    for own, told, is_toxic in zip(kinds, np.split(new, np.cumsum(count)[:-1]), toxic.tolist(), strict=True):
        own = np.unique(own[told])
        n = sizes[own]
        held = form[np.repeat(begin[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        frequency[int(is_toxic), np.unique(held)] += 1
    del kinds
    n_in, n_out = int(toxic.sum()), int((~toxic).sum())
    odds = np.log((frequency[1] + 0.5) / (n_in + 1)) - np.log((frequency[0] + 0.5) / (n_out + 1))
    total = frequency.sum(axis=0)
    chance, share = n_in / max(1, n_in + n_out), frequency[1] / np.maximum(total, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = np.where(frequency[1] > 0, frequency[1] * np.log(share / chance), 0) + np.where(frequency[0] > 0, frequency[0] * np.log((1 - share) / (1 - chance)), 0)
    marks = (odds >= LEAST_ODDS) & (evidence >= LEAST_EVIDENCE)
    marked = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=marks[form], minlength=len(sizes)) > 0
    label = (marked[kind] & np.repeat(toxic, count)).astype(np.float64)

    dimensions = len(names)
    model = Model(names, np.zeros(dimensions), np.array([-4.0, -4.0, 0.0, 0.0]), np.zeros(3))
    if len(kind):
        first, length = _chains(stop[kind], count)
        inner = np.ones(len(kind), dtype=bool)
        inner[first] = False
        a, b = label[:-1][inner[1:]], label[1:][inner[1:]]
        seen = np.array([label[first].sum(), ((1 - a) * b).sum(), (a * (1 - b)).sum(), (a * b).sum()])
        weights = np.concatenate([model.emission, model.chain])
        mean, square = np.zeros_like(weights), np.zeros_like(weights)
        for step in range(1, ROUNDS + 1):
            emission, chain = weights[:dimensions], weights[dimensions:]
            by_type = np.bincount(of, weights=emission[flat], minlength=len(sizes))
            marginal, moves = _marginals(by_type[kind], first, length, chain)
            error = np.bincount(kind, weights=marginal - label, minlength=len(sizes))
            gradient = np.concatenate([np.bincount(flat, weights=error[of], minlength=dimensions), np.append(marginal[first].sum(), moves) - seen])
            gradient = gradient / len(texts) + PENALTY * weights
            mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
            weights = weights - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        model.emission, model.chain = weights[:dimensions], weights[dimensions:]
        marginal, _ = _marginals(np.bincount(of, weights=model.emission[flat], minlength=len(sizes))[kind], first, length, model.chain)
    else:
        marginal = np.empty(0)
    rows = _aggregate(marginal, count)
    theta = np.zeros(3)
    for _ in range(30):  # Newton's method, with a small penalty
        p = 1 / (1 + np.exp(-rows @ theta))
        gradient = rows.T @ (weight * (p - toxic)) + 0.01 * theta
        curve = (rows * (weight * p * (1 - p))[:, None]).T @ rows + 0.01 * np.eye(3)
        move = np.linalg.solve(curve, gradient)
        theta = theta - move * min(1.0, 4 / max(1e-9, np.abs(move).max()))
    used = model.emission != 0
    return Model(names[used], model.emission[used], model.chain, theta)


def training_sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, max_bytes: int, id_col: str, text_col: str, label_col: str, label_id_col: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Whole texts of a bounded sample of the labelled training rows, their labels and weights."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(label_id_col).isNotNull()).where(fold(label_id_col, FOLDS) != HELD_OUT)
    rows = rows.groupBy(F.col(label_id_col).alias("label_id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1):
        return [], np.empty(0, dtype=bool), np.empty(0)
    drawn = None
    for label, most in ((1, max_toxic), (0, max_clean)):
        part = rows.where(F.col("toxic") == label).orderBy(F.xxhash64("label_id"), "label_id").limit(most)
        drawn = part if drawn is None else drawn.unionByName(part)
    slim = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    found = slim.join(F.broadcast(drawn), F.col("id") == F.col("label_id")).select("id", F.xxhash64("text").alias("name"), F.octet_length("text").alias("n"), "text", "toxic")
    # lengths first: a text that doesn't fit any more stays out, not those behind it
    few = found.select("id", "name", "n").distinct().orderBy(F.xxhash64("id"), "id", "name").limit(max_toxic + max_clean).collect()
    chosen, used = [], 0
    for r in few:
        if used + r["n"] <= max_bytes:
            chosen.append((r["id"], r["name"]))
            used += r["n"]
    if not chosen:
        warnings.warn(f"no labelled text has at most {max_bytes} bytes, so nothing can be learned", stacklevel=2)
        return [], np.empty(0, dtype=bool), np.empty(0)
    picked = docs.sparkSession.createDataFrame(chosen, f"id {slim.schema['id'].dataType.simpleString()}, name bigint")
    texts = found.join(F.broadcast(picked), ["id", "name"]).groupBy("id", "name").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    got = sorted(((r["id"], bytes(r["text"]), r["toxic"]) for r in texts.collect()), key=lambda r: (r[0], r[1]))
    toxic = np.array([t == 1 for _, _, t in got], dtype=bool)
    weight = np.where(toxic, sizes[1] / max(1, int(toxic.sum())), sizes.get(0, 0) / max(1, int((~toxic).sum())))
    return [t for _, t, _ in got], toxic, weight


_SPLIT = re.compile(rb"[^\x20\x09-\x0d]+")


class Tagger:
    """Scores texts with a fitted model; made in each task from its few weights."""

    def __init__(self, model: Model | None):
        take_turn("toxicity")
        self.scores = None if model is None else _Scores(model)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every text's score; the marginals of all words; and where each text's words begin among them."""
        if self.scores is None:
            return np.zeros(len(texts)), np.empty(0), np.zeros(len(texts), np.int64)
        if len(self.scores) > CACHED_WORDS:
            self.scores.clear()
        model, scores = self.scores.model, self.scores
        split, count = _tokens(texts)
        raw = np.fromiter((scores[w] for words in split for w in words), dtype=np.float64, count=int(count.sum()))
        ends = raw > 5e5
        first, length = _chains(ends, count)
        marginal, _ = _marginals(raw - ends * 1e6, first, length, model.chain)
        return 1 / (1 + np.exp(-_aggregate(marginal, count) @ model.map)), marginal, np.cumsum(count) - count


def _fitted(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, max_bytes: int, id_col: str, text_col: str, label_col: str, label_id_col: str) -> Model | None:
    texts, toxic, weight = training_sample(docs, labels, max_toxic, max_clean, max_bytes, id_col, text_col, label_col, label_id_col)
    if not len(texts):
        return None
    return fit(texts, toxic, weight)


def drop_toxic(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id_col: str = "doc_id",
) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    model = _fitted(docs, labels, max_toxic, max_clean, max_bytes, id_col, text_col, label_col, label_id_col)
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in slices(batches, text_col):
            chance, _, _ = tagger([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array(chance < threshold))

    return arrow_map(docs, keep, docs.schema)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_bytes: int = MAX_BYTES,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id_col: str = "doc_id",
) -> DataFrame:
    """id, held_out, score, predicted, and spans: start and end (in characters) and score of offending words."""
    model = _fitted(docs, labels, max_toxic, max_clean, max_bytes, id_col, text_col, label_col, label_id_col)
    slim = docs.select(F.col(id_col).alias("id"), (fold(id_col, FOLDS) == HELD_OUT).alias("held_out"), text_bytes(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in slices(batches, "text"):
            texts = batch.column(2).to_pylist()
            chance, marginal, start = tagger(texts)
            spans: list[list[dict]] = [[] for _ in texts]
            at = np.flatnonzero(marginal >= 0.5)
            for text in np.unique(np.searchsorted(start, at, side="right") - 1).tolist():
                upto = np.cumsum((np.frombuffer(texts[text], np.uint8) & 0xC0) != 0x80)  # characters to each byte
                for i, m in enumerate(_SPLIT.finditer(texts[text])):
                    p = marginal[start[text] + i]
                    if p >= 0.5:
                        spans[text].append({"start": int(upto[m.start()]) - 1, "end": int(upto[m.end() - 1]), "score": float(p)})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(chance), pa.array((chance >= threshold).astype(np.int32)), pa.array(spans, span_type)],
                names=["id", "held_out", "score", "predicted", "spans"],
            )

    out = arrow_map(slim, tag, f"id {kind}, held_out boolean, score double, predicted int, spans array<struct<start: long, end: long, score: double>>")
    return out.withColumnRenamed("id", id_col)
