import math
import random
import time
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quaymaster.llm import html_extract as h

SCHEMA = "page_id bigint, url string, html string, host string, text int"


def page(i, body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_blocks():
    got = [(p, t) for p, _, _, t in h.blocks("<div><ul><li>a<li>b &amp; c</ul><p>x<b>y</b>z<p>q<br>r<script>var a='</p>';</script><table><tr><td>1<td>2<tr><td>3</table>tail<!-- <p>c --> end</div>&nbsp; last")]
    assert [t for _, t in got] == ["a", "b & c", "xyz", "q r", "1", "2", "3", "tail end", "last"]
    assert h.blocks("") == [] and h.blocks("<p>") == [] and [t for *_, t in h.blocks("plain < 3 text")] == ["plain < 3 text"]


def test_roles_and_article(spark):
    body = "<nav>menu</nav><header>top</header><div class='cookie-notice'>ok?</div><div id=sidebar>side</div><article class='page'><h1>Head</h1><p>One  two&eacute;<p>Three<div class=\"ad\">buy</div><form>f</form><section class='comments'>c</section></article><footer>foot</footer>"
    rows = [(1, "http://a.b/x", page(1, body), "h", 0), (2, None, None, "h", 0), (3, "x", "", "h", 0), (1, "http://a.b/x", page(1, body), "h", 0), (4, "http://a.b/y", "<p>only text</p>" * 3, "h", 0)]
    got = h.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 5 and text == {1: "Head One twoé Three", 2: "", 3: "", 4: "only text only text only text"}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert h.extract_main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_style_tree_removes_what_recurs(spark):
    rows = [(i, f"http://s.org/{i}", page(i, f"<div class='box'>welcome to the site</div><div class='story'><p>own words {i} of page {i * 7}</p></div><div class='end'>since {2000 + i % 2}</div>"), "h", 0) for i in range(30)]
    rows += [(100 + i, f"http://few.org/{i}", page(i, "<div class='box'>welcome to the site</div>"), "h", 0) for i in range(2)]
    pages = spark.createDataFrame(rows, SCHEMA)
    text = {r["page_id"]: r["text"] for r in h.extract_main_text(pages).collect()}
    assert text[3] == "own words 3 of page 21" and text[100] == "welcome to the site"
    tree = h.style_tree(h._looked(h._prepared(pages, "page_id", "url", "html"))).where(F.col("kind") != h._BRANCH).orderBy("importance").collect()
    assert tree[0]["importance"] == pytest.approx(0) and tree[-1]["importance"] == pytest.approx(1)


def test_importance_equals_brute_force(spark):
    r = random.Random(4)
    rows = [(i, f"http://h{i % 2}.org/{i}", "".join(f"<div class=c{k}>{r.choice('abcd')}</div>" for k in "xyz" if r.random() < 0.8), "h", 0) for i in range(40)]
    seen = h._looked(h._prepared(spark.createDataFrame(rows, SCHEMA), "page_id", "url", "html"))
    of = defaultdict(lambda: defaultdict(set))
    for x in seen.collect():
        of[x["host"], x["path"], x["kind"]][x["feature"]].add(x["page"])
    assert {k for _, _, k in of} == {h._LEAF}
    for x in h.style_tree(seen).collect():
        contents = of[x["host"], x["path"], x["kind"]]
        pages = len(set().union(*contents.values()))
        mean = sum(math.log(len(c)) for c in contents.values()) / len(contents)
        assert x["pages"] == pages and x["importance"] == pytest.approx(1 - mean / math.log(max(2, pages)))
    layouts = h.style_tree(spark.createDataFrame([(1, 2, f, p, h._BRANCH) for p, f in enumerate([7, 7, 7, 8, 9])], seen.schema)).first()
    assert layouts["importance"] == pytest.approx(-sum(k / 5 * math.log(k / 5) for k in (3, 1, 1)) / math.log(5))


def test_hints_are_no_verdict(spark):
    # the whole story stands in what is named a promo widget; an advert with each page's own words stands in it too
    rows = [(i, f"http://w.org/{i}", page(i, f"<div class='promo widget'><h1>Story {i}</h1><p>own words number {i} of a long story</p><div class='ad'>buy {i}</div></div><div id=banner>hello {i}</div>"), "h", 0) for i in range(12)]
    text = {r["page_id"]: r["text"] for r in h.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(text[i] == f"Story {i} own words number {i} of a long story" for i in range(12))


def test_headline_of_near_copies_stays(spark):
    rows = [(i, f"http://c.org/{i}", page(i, f"<article><h1>One headline</h1><p>text number {i}</p></article>"), "h", 0) for i in range(30)]
    assert all(r["text"] == f"One headline text number {r['page_id']}" for r in h.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect())


def test_long_and_broken_pages_take_linear_time():
    began = time.perf_counter()
    for unit in ("<a ", "<a \"", "<!", "<script ", "<p class='", "<div>", "<div><p>", "x" * 50 + "<b>", "</p>", "<li><ul>"):
        h.blocks(unit * (200_000 // len(unit)))
    deep = h.blocks("<div>" * 2000 + "<p>words</p>" + "</div>" * 2000 + "end")
    assert [t for *_, t in deep] == ["words", "end"] and time.perf_counter() - began < 20


def test_style_tree_acts_inside_and_beside_articles(spark):
    box = "<div class='box'>thank you for reading all of this, come again</div>"
    rows = [(i, f"http://s.org/{i}", page(i, f"<article><h1>Head {i}</h1><p>own words {i}</p>{box}</article>"), "h", 0) for i in range(12)]
    # the main text is no article, the teaser is one
    rows += [(100 + i, f"http://t.org/{i}", page(i, f"<div class='story'>a longer story of its own, number {i}</div><article class='card'>read this too</article><article class='comment'>nice {i}</article>"), "h", 0) for i in range(12)]
    # copies of one article within different pages
    rows += [(200 + i, f"http://c.org/{i}", page(i, f"<div class='ad'>ad {i}</div><article><p>one text</p><p>in two parts</p></article>"), "h", 0) for i in range(12)]
    # near copies of one article: all that stays of a page is its article
    rows += [(300 + i, f"http://n.org/{i}", page(i, "<article>" + "".join(f"<p>part {k}{' new' * (k == i)}</p>" for k in range(12)) + "</article>"), "h", 0) for i in range(12)]
    text = {r["page_id"]: r["text"] for r in h.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(12):
        assert text[i] == f"Head {i} own words {i}" and text[100 + i] == f"a longer story of its own, number {i}" and text[200 + i] == "one text in two parts"
        assert text[300 + i] == " ".join(f"part {k}{' new' * (k == i)}" for k in range(12))


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the driver's tables are not here")
def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline
    from quaymaster.llm import ngram_join, queries

    d = "/root/testdata/sf0.001"
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    gone = {r["doc_id"] for r in queries.op5_toxicity(spark, d).where("predicted = 1").collect()}
    ids = {r["doc_id"] for r in docs.collect()} - gone
    for name, stage in pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, d).cache()
        assert docs.columns == columns
        left = {r["doc_id"] for r in docs.collect()}
        if name == "toxicity":
            assert left == ids
        elif name == "ngram_join":
            want = {r["doc_id"] for r in ngram_join.jaccard_components(before, 5, 80).where("doc_id = component_id").collect()}
            assert left == want
        elif name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            held = {r["doc_id"] for r in before.collect() if any(t in r["text"] for t in items)}
            assert left == {r["doc_id"] for r in before.collect()} - held
        else:
            assert left == {r["doc_id"] for r in before.collect()}
            assert docs.where("text like '%@mail_.example.com%'").count() == 0
    packed = pipeline.STAGES[-1][1](spark, docs, d)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}
    assert pipeline.run(spark, d).count() == packed.count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    r = random.Random(3)
    words = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    item, copied = words(60), words(50)
    texts = {i: words(40) for i in range(40)} | {100: copied, 101: copied.upper(), 102: copied + " end", 110: f"{words(20)} {item} {words(20)}", 120: None, 121: "", 122: words(30000), 123: "mail a.b@c.org now"}
    labels = [(i, 0, 0) for i in texts] + [(None, 1, 1)]
    for i in range(200, 240):
        texts[i] = f"{words(30)} vilegrim rottenly {words(5)}"
        labels.append((i, 0, 1))
    # extra columns have names that operators use for their own
    rows = [(i, t, "en", "s", len(t or ""), i, "x", "y", "z", 1.5) for i, t in [*texts.items(), (None, words(20)), (5, texts[5])]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, label string, entities string, `a.b` string, id double"
    for name, rows in (("full", rows), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels if rows else [], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, item), (2, None), (3, "")] if rows else [], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        for k, (stage, f) in enumerate(pipeline.STAGES[:-1]):
            if stage == "ngram_join" and not rows:
                continue  # test_join_keeps_one has it
            out = f(spark, docs, d)
            assert out.columns == docs.columns, stage
            out.write.parquet(f"{d}/{k}")
            docs = spark.read.parquet(f"{d}/{k}")
        ids = sorted(-1 if x["doc_id"] is None else x["doc_id"] for x in docs.collect())
        assert ids == (sorted([-1, *range(40), 100, 120, 121, 122, 123]) if rows else [])
        if rows:
            kept = {x["doc_id"]: x for x in docs.collect()}
            assert kept[122]["text"] == texts[122] and kept[120]["text"] is None and "a.b@c.org" not in kept[123]["text"]
            assert kept[100]["a.b"] == "z" and kept[100]["entities"] == "y" and kept[123]["n_chars"] == len(kept[123]["text"])
        packed = pipeline.STAGES[-1][1](spark, docs, d)
        assert packed.select("doc_id").distinct().count() == len(ids)
