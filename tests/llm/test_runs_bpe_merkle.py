import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymaster.llm import byte_bpe, merkle, periodic
from quaymaster.llm import queries as q

tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, kept string, size int"


def write(spark, rows, folder):
    """A documents table of (doc_id, text, lang, source, n_chars), with columns whose names clash."""
    spark.createDataFrame([(*r, "x", None, 3) for r in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


# --- runs ------------------------------------------------------------------------------------------------


def brute_runs(words, least=12):
    """Every (start, length, period), by comparing all words with all others."""
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    words, found = np.array([names[w] for w in words]), {}
    for period in range(1, len(words) // 2 + 1):
        equal, at = (words[period:] == words[:-period]).tolist(), 0
        while at < len(equal):
            end = at
            while end < len(equal) and equal[end]:
                end += 1
            if end - at + period >= max(least, 2 * period):
                found.setdefault((at, end + period), period)
            at = max(end, at + 1)
    return sorted((b, e - b, p) for (b, e), p in found.items())


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def periodic_text(r):
    kind = r.randrange(8)
    root = [r.choice("abc") for _ in range(r.randint(1, 5))]
    long = lambda: (root * 300)[r.randrange(5) :][: r.randint(40, 300)]
    if kind == 0:
        return [r.choice("ab") for _ in range(r.randint(0, 300))]
    if kind == 1:
        return fibonacci(r.randint(30, 700))[r.randrange(30) :]
    if kind == 2:
        return [str(bin(i).count("1") & 1) for i in range(r.randint(20, 600))]
    if kind == 3:
        u = [str(r.randrange(50)) for _ in range(r.randint(1, 200))]
        return ["x"] * 3 + u * r.randint(1, 5) + u[: r.randint(0, len(u))] + ["y"]
    if kind == 4:  # periods that consist of highly periodic regions
        u, v = long(), long()
        return u + v + u[: r.randint(0, len(u))] + v
    if kind == 5:
        return ((long() + [r.choice("abd")] * r.randint(0, 2)) * 5)[r.randrange(30) : r.randint(100, 1300)]
    if kind == 6:
        x = [r.choice("abcd") for _ in range(r.randint(20, 60))]
        return [w for _ in range(r.randint(2, 5)) for w in [*x, r.choice("abcde")]] * r.randint(2, 3)
    u = ["a", "b"] * r.randint(20, 150) + ["a"]
    return u + u + u[: r.randint(0, len(u))]


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    texts = [periodic_text(r) for _ in range(20)] + [[], ["a"], ["a"] * 12, ["a"] * 11]
    _, words, count = periodic.numbered([" ".join(t).encode() for t in texts])
    found = periodic.find_runs(words, count)
    for i, text in enumerate(texts):
        assert [tuple(map(int, row[1:])) for row in found[found[:, 0] == i]] == brute_runs(text)


def test_synchronising_sets_are_consistent_and_dense():
    r = np.random.default_rng(3)
    words = np.concatenate([r.integers(0, 2, 300), np.tile([0, 1, 1], 60), r.integers(0, 2, 200), np.zeros(90, int)]).astype(np.int32)
    t, n = 16, len(words)
    text = words.tolist()
    short = lambda x: any(x[p:] == x[:-p] for p in range(1, t // 3 + 1))
    extend = periodic._Extender(words)
    level = t.bit_length() - 1
    mask = np.array([short(text[i : i + t]) for i in range(n - t + 1)])
    held = set(periodic.synchronising(extend.at(level), mask, t, n - 2 * t + 1).tolist())
    contexts = {}
    for i in range(n - 2 * t + 1):
        contexts.setdefault(tuple(text[i : i + 2 * t]), set()).add(i in held)
    assert all(len(c) == 1 for c in contexts.values())
    for i in range(n - 3 * t + 2):
        assert bool(held & set(range(i, i + t))) != short(text[i : i + 3 * t - 1])


def test_extension_over_many_lengths_of_the_longest_names():
    words = np.array([7, *([1, 2, 3] * 1000), 9], np.int32)
    rows = periodic._Extender(words)(np.array([1500]), np.array([3]))
    assert rows.tolist() == [[1, 3001, 3]]


def expected_runs(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words) if n > 1 else []
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_runs_of_a_table(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, " ".join(str(r.randrange(40)) for _ in range(r.choice([1, 3, 12, 60, 300]))), "en", "a", 1) for i in range(60)]
    rows += [(100 + i, "\n\t ".join(periodic_text(r)), "en", "a", 1) for i in range(40)]
    rows += [(200, None, None, None, None), (201, "", "", "", 0), (202, " \t\n\x1c ", "x", "", 0), (203, "é ü " * 9000, "x", "", 0), (None, "a b " * 20, "x", "", 0), rows[70], rows[70]]
    got = q.op11_periodic_runs(spark, write(spark, rows, tmp_path)).collect()
    rows = [x for x in rows if x[0] != 203]
    assert sorted(tuple(x) for x in got if x["doc_id"] not in (203, None)) == sorted(expected_runs(i, t) for i, t, *_ in rows if i is not None)
    assert [tuple(x) for x in got if x["doc_id"] is None] == [expected_runs(None, "a b " * 20)]
    long = next(x for x in got if x["doc_id"] == 203)
    assert (long["n_runs"], long["start"], long["length"], long["period"]) == (1, 0, 18000, 2)
    none = periodic.periodic_runs(spark.createDataFrame([], SCHEMA))
    assert none.columns == ["doc_id", "n_words", "runs", "collapsed"] and none.count() == 0


# --- byte-level BPE --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.encoding(q.tokenizer_path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)


ALPHABETS = ["ab'sldmtrev ", "aB1²५ \t\n.,'!-", "'''sst  \n", "王明。，、 a1", "é  \u0085​ x.'", "  \n\n\t a"]


def test_pieces_encode_as_whole_texts(codec, monkeypatch):
    r = random.Random(1)
    for size in (1, 3, 17):
        monkeypatch.setattr(byte_bpe, "PIECE", size)
        for _ in range(400):
            text = "".join(r.choice(r.choice(ALPHABETS)) for _ in range(r.randrange(120)))
            parts = list(byte_bpe.pieces(text, size))
            assert "".join(parts) == text
            assert [i for p in parts for i in codec.encode_ordinary(p)] == codec.encode_ordinary(text)
    assert len(list(byte_bpe.pieces("word 12, " * 50, 3))) > 60


def test_long_texts_without_a_safe_place_stay_whole(codec):
    for text in ("x" * 300_000, " " * 200_000, "'" * 200_000, "🙂" * 100_000):
        assert list(byte_bpe.pieces(text)) == [text]
        n, ids = byte_bpe.encode_text(text.encode(), codec)
        assert len(ids) == 4 * n and byte_bpe.decode_ids(ids, codec) == text.encode()


def test_bpe_of_a_table(spark, codec, tmp_path):
    r = random.Random(2)
    texts = ["".join(r.choice(r.choice(ALPHABETS)) for _ in range(r.randrange(400))) for _ in range(40)]
    texts += [None, "", "<|endoftext|> is text", "long words and 12 numbers, it's so. " * 9000, "\x00\x01", texts[3], texts[3]]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)] + [(None, "no id", None, None, None)]
    got = {x["doc_id"]: x for x in q.op12_byte_bpe(spark, write(spark, rows, tmp_path)).collect()}
    for doc_id, text, *_ in rows:
        ids = codec.encode_ordinary(text or "")
        want = (doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert tuple(got[doc_id]) == want
    path = q.tokenizer_path("byte_bpe_50k.tiktoken")
    none = byte_bpe.decode(byte_bpe.encode(spark.createDataFrame([], SCHEMA), path, tokenizers.PATTERN), path, tokenizers.PATTERN)
    assert none.columns == ["doc_id", "n_tokens", "ids", "decoded"] and none.count() == 0


def test_decoding_odd_ids(spark, codec):
    assert byte_bpe.decode_ids(b"", codec) == b""
    half = byte_bpe.encode_text("🙂".encode(), codec)[1][:4]  # a token that ends within a character
    assert byte_bpe.decode_ids(half, codec) in "🙂".encode()
    with pytest.raises(ValueError, match="no token"):
        byte_bpe.decode_ids(np.array([2**31], "<u4").tobytes(), codec)
    path = q.tokenizer_path("byte_bpe_50k.tiktoken")
    rows = byte_bpe.decode(spark.createDataFrame([(None, 1)], "ids binary, decoded_ int"), path, tokenizers.PATTERN).collect()
    assert rows[0]["decoded"] is None


# --- Merkle manifest -------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def steps(tree, i):
    """Siblings (node, is it to the left) of leaf i, level by level; None where it is alone."""
    out = []
    for nodes in tree[:-1]:
        j = i ^ 1
        out.append((nodes[j] if j < len(nodes) else None, j < i))
        i //= 2
    return out


def expected_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    trees = {g: levels([leaf(*r) for r in groups[g]]) for g in groups}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, row in enumerate(groups[g]):
            path = steps(trees[g], i) + steps(top, k)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None
            node = leaf(*row[:4], row[4] + 1) if hit else leaf(*row)
            for other, left in path:
                node = H(node) if other is None else H(other, node) if left else H(node, other)
            root = top[-1][0]
            out.append((row[0], leaf(*row), trees[g][-1][0], root, H(*(o for o, _ in path if o)), node, node == root))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 200])
def test_log_is_postorder_and_positions_are_closed_form(n):
    nodes = [H(str(i)) for i in range(n)]
    tree = levels(nodes)
    log = [x.decode() for x in merkle.complete([x.encode() for x in nodes], len(tree) - 1)]
    assert len(log) == sum(map(len, tree))
    for level, own in enumerate(tree):
        assert [log[p] for p in merkle.position(level, np.arange(len(own)), n)] == own
    wanted = []

    def visit(level, i):
        for j in (2 * i, 2 * i + 1):
            if level and j < len(tree[level - 1]):
                visit(level - 1, j)
        wanted.append(tree[level][i])

    visit(len(tree) - 1, 0)
    assert log == wanted


@pytest.mark.parametrize("bits", [1, 10])
def test_manifest_equals_brute_force(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(merkle.manifest, "__defaults__", (bits,))
    r = random.Random(bits)
    rows = [(i, f"text {i} é", r.choice(["en"] * 6 + ["de", "fr", None, "", "zz"]), "s", r.randrange(99)) for i in r.sample(range(1000), 70)]
    rows += [(2000, None, None, None, None), (2001, "", "only", "", 0), (None, "no id", "en", None, 3), (None, "no id either", "en", None, 3), (2002, "x" * 300_000, "en", "s", 300_000)]
    rows += [rows[5], rows[5], (rows[6][0], "same id", rows[6][2], "t", 1)]
    got = q.op13_merkle(spark, write(spark, rows, tmp_path)).collect()
    show = lambda x: sorted(x, key=str)
    assert show(tuple(x) for x in got) == show(expected_manifest(rows))
    assert {x["verified"] for x in got} == {True, False}


@pytest.mark.parametrize("bits", [2, 10])
def test_log_of_a_manifest(spark, bits):
    rows = spark.createDataFrame([(i, "a" if i < 23 else "b") for i in range(28)], "id int, g string")
    made = merkle.manifest(rows, F.sha2(F.col("id").cast("string"), 256), F.col("g"), [F.col("id")], [F.col("id")], bits)
    for name, ids in (("=a", range(23)), ("=b", range(23, 28))):
        tree = levels([H(str(i)) for i in ids])
        log = made.groups.log.where(F.col("group") == name).orderBy("position").collect()
        assert [x["position"] for x in log] == list(range(sum(map(len, tree))))
        assert all(tree[x["level"]][x["index"]] == x["digest"] for x in log)
    assert made.root == H(*(levels([H(str(i)) for i in ids])[-1][0] for ids in (range(23), range(23, 28))))


def test_manifest_of_few_rows(spark):
    one = spark.createDataFrame([(1, None)], "id int, g string")
    made = merkle.manifest(one, merkle.row_digest(F.col("id"), F.col("g")), F.col("g"), [F.col("id")], [F.col("id")])
    row = made.proofs().collect()[0]
    assert row["leaf"] == row["subroot"] == row["root"] == H("1:1", "-") and row["proof"] == []
    none = merkle.manifest(one.limit(0), merkle.row_digest(F.col("id")), F.col("g"), [F.col("id")], [F.col("id")])
    assert none.root is None and none.proofs().count() == 0 and none.groups.log.count() == 0
