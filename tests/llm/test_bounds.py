"""Items and texts beyond the sizes that operators work in steps of."""

import random

import numpy as np
import pytest

from quaymaster.llm import decontaminate, toxicity

# words that have little in common, so that a region's ends are clear
WORDS = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=5)) for i in range(900)]


def words(r, size):
    return " ".join(r.choice(WORDS) for _ in range(size // 6))


@pytest.mark.parametrize("size", [99_000, 103_500, 500_000])
@pytest.mark.parametrize("place", [0, 2])
def test_regions_of_long_items_at_every_place_of_a_step(size, place):
    r = random.Random(size)
    item, other = words(r, size), words(r, 400)
    for begin, end in ((0, 1000), (size // 2, size // 2 + 1000), (len(item) - 1000, len(item))):
        passage = item[begin:end].strip()
        texts = [words(r, 500) for _ in range(4)]
        texts[place] = passage + " " + texts[place]
        index = decontaminate.Index(["short", "long"], [other.encode(), item.encode()])
        found = index.regions([t.encode() for t in texts])
        assert [(t, i) for t, i, *_ in found] == [(place, 1)], (begin, place)
        _, _, start, stop, edits = found[0]
        assert start <= 5 and edits <= 5 and abs(stop - len(passage)) < 20  # the last window's edits may reach over the passage's end
    alone = decontaminate.Index(["long"], [item.encode()])
    assert [(t, e) for t, _, _, _, e in alone.regions([(item[-2000:-1000] + "zz" + item[-1000:]).encode()])][0][0] == 0


def test_long_items_in_the_stage_and_in_blocks(spark, monkeypatch):
    r = random.Random(1)
    items = [(i, words(r, n)) for i, n in enumerate((300, 150_000, 400))]
    docs = [(i, words(r, 2000)) for i in range(8)] + [(100, items[1][1][-3000:]), (101, words(r, 900) + " " + items[1][1][:900]), (102, items[2][1]), (103, None)]
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    for size in (32 << 20, 60_000):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        kept = decontaminate.drop_contaminated(frame, benchmark)
        assert sorted(x["doc_id"] for x in kept.collect()) == [*range(8), 103]
        found = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated_regions(frame, benchmark).collect()}
        assert found == {(100, 1), (101, 1), (102, 2)}


def test_the_sample_survives_one_long_text(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(3)) + (" vile" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(200)]
    take = lambda rows, bound: toxicity.training_sample(
        spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int"), 1000, 2000, bound, "doc_id", "text", "toxic", "doc_id"
    )
    few = len(take(rows, 2000)[0])
    assert few > 80
    for long in range(3):  # whatever its place in hash order
        texts, toxic, weight = take([x if x[0] != long else (long, "a " * 1700, 1) for x in rows], 2000)
        assert len(texts) >= few - 1 and toxic.any() and not toxic.all() and sum(map(len, texts)) <= 2000
    # repeated rows of an id count once, contradictory labels as toxic
    texts, toxic, _ = take([(4, "same text", 0)] * 50 + [(4, "same text", 1), (1, "other", 0)], 2000)
    assert sorted(texts) == [b"other", b"same text"] and toxic.sum() == 1
    with pytest.warns(UserWarning, match="nothing can be learned"):
        assert len(take(rows, 3)[0]) == 0


def test_scores_equal_brute_force():
    """The score of a text is the logistic map of its words' marginals, which all labellings of its sentences give."""
    r = np.random.default_rng(4)
    texts = [b"you vile fool. go home", b"nice day today.", b"vile fool", b"", b"a b. c vile"] * 6
    model = toxicity.fit(texts, np.array([b"vile" in t for t in texts]), np.ones(len(texts)))
    weight = dict(zip(model.names.tolist(), model.emission.tolist(), strict=True))
    start, c_o, o_c, o_o = model.chain
    for text in texts[:5]:
        words, marginals, chain = text.lower().split(), [], []
        chains = []
        for w in words:
            chain.append(w)
            if w.endswith((b".", b"!", b"?")):
                chains.append(chain)
                chain = []
        for own in [*chains, *([chain] if chain else [])]:
            emission = [sum(weight.get(f, 0.0) for f in toxicity.features(w)) for w in own]
            total, each = 0.0, np.zeros(len(own))
            for labels in np.ndindex(*(2,) * len(own)):
                score = sum(e for e, y in zip(emission, labels, strict=True) if y) + (start if labels[0] else 0)
                score += sum({(0, 0): 0.0, (0, 1): c_o, (1, 0): o_c, (1, 1): o_o}[a, b] for a, b in zip(labels, labels[1:], strict=False))
                total += np.exp(score)
                each += np.exp(score) * np.array(labels)
            marginals += (each / total).tolist()
        row = np.array([1, np.log1p(10 * sum(marginals)), max(marginals, default=0)])
        got, own, _ = toxicity.Tagger(model)([text])
        assert np.allclose(own, marginals) and np.isclose(got[0], 1 / (1 + np.exp(-row @ model.map)))
