"""Stored rows: audits, reserved ids, streams that are run again, and merges in place."""

import random

import pytest
from pyspark.sql import functions as F

from quaymaster import dims, schemas
from quaymaster.functions import text as t
from quaymaster.operators import aliases, state, store
from quaymaster.sources import reference
from quaymaster.streaming import landing

MAIL = "Subject: {0}\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\nна вход\nНазвание судна SHIP {0}\n"


@pytest.fixture
def root(spark, tmp_path):
    schemas.create_all(spark, f"{tmp_path}/tables")
    return f"{tmp_path}/tables"


def mails(folder, names):
    folder.mkdir(exist_ok=True)
    for n in names:
        (folder / f"{n}.eml").write_text(MAIL.format(n))


def test_a_batch_with_orphans_publishes_nothing(spark, root):
    tugs = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    assert store.publish(tugs, root, "tugs", "1")["rows"] == 2
    bad = spark.createDataFrame([(1, 1), (2, 7), (3, None), (4, 8), (None, 1)], "id bigint, tug_id bigint")
    with pytest.raises(store.KeyViolation) as e:
        store.publish(bad, root, "vouchers", "1")
    assert e.value.counts == {"rows": 5, "rows without an id": 1, "orphans by tug_id": 2}
    assert schemas.read(spark, root, "vouchers").count() == 0
    good = bad.where("id IN (1, 3)")
    assert store.publish(good, root, "vouchers", "1") == {"rows": 2, "rows without an id": 0, "orphans by tug_id": 0}
    assert store.publish(good, root, "vouchers", "1")["rows"] == 2  # again: it replaces itself
    stored = schemas.read(spark, root, "vouchers").collect()
    assert sorted(r["id"] for r in stored) == [1, 3] and all(r["created_at"] for r in stored)


def test_a_published_batch_reads_its_input_once(spark, root):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(50).select("id").mapInArrow(count, "id bigint").withColumn("tug_id", F.lit(None).cast("bigint"))
    store.publish(rows, root, "vouchers", "x")
    assert seen.value == 50


def test_uploads_become_rows_once(spark, root, tmp_path):
    mails(tmp_path / "in", ["a", "b", "c"])
    run = lambda: landing.store_applications(spark, str(tmp_path / "in"), root, str(tmp_path / "cp"), files_per_batch=2).awaitTermination()
    run()
    first = {r["file_path"].rsplit("/", 1)[1]: r["id"] for r in schemas.read(spark, root, "applications").collect()}
    assert set(first) == {"a.eml", "b.eml", "c.eml"} and len(set(first.values())) == 3
    mails(tmp_path / "in", ["d"])
    # the last batch counts as not done: it runs again after the restart
    commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    run()
    rows = schemas.read(spark, root, "applications").collect()
    ids = {r["file_path"].rsplit("/", 1)[1]: r["id"] for r in rows}
    assert len(rows) == 4 and {k: ids[k] for k in first} == first and len(set(ids.values())) == 4
    assert {r["vessel_name"] for r in rows} == {f"SHIP {n}" for n in "abcd"} and all(r["created_at"] and r["direction"] == "вход" and r["status"] == "needs_review" for r in rows)
    # another stream has a block of its own, and rows that are appended stay below all blocks
    mails(tmp_path / "other", ["z"])
    landing.store_applications(spark, str(tmp_path / "other"), root, str(tmp_path / "cp2")).awaitTermination()
    assert state.append(spark.createDataFrame([("X",)], "vessel_name string"), root, "applications") == 1
    ids = [r["id"] for r in schemas.read(spark, root, "applications").collect()]
    assert len(set(ids)) == 6 and min(ids) == 1 and sum(i < store.FIRST_BLOCK for i in ids) == 1
    landing.store_vouchers(spark, str(tmp_path / "other"), root, str(tmp_path / "cp3")).awaitTermination()
    assert [r["status"] for r in schemas.read(spark, root, "vouchers").collect()] == ["needs_review"]


def test_writers_keep_their_numbers(spark, root):
    assert [store.claim_writer(spark, root, "ships", o) for o in ("a", "b", "a", "c", "b")] == [1, 2, 1, 3, 2]
    with pytest.raises(ValueError, match="no block"):
        store.with_ids(spark.range(1), 0, 1, "id")


def test_the_latest_upload_of_a_name_wins_over_batches(spark, tmp_path):
    uploads = str(tmp_path / "uploads")
    kind = "name string, version int, location string"
    write = lambda rows: spark.createDataFrame(rows, kind).write.mode("append").parquet(uploads)
    stream = spark.readStream.schema(kind).parquet(uploads) if write([("x/a.pdf", 1, "one"), ("b.pdf", 5, "two"), (None, 1, "nameless")]) is None else None
    run = lambda: landing.current_uploads(stream, "in/", str(tmp_path / "now"), str(tmp_path / "cp"), parts=4).awaitTermination()
    run()
    write([("a.pdf", 2, "three"), ("y\\b.pdf", 4, "late")])
    run()
    got = {r["path"]: (r["version"], r["location"]) for r in store.read_current(spark, str(tmp_path / "now")).collect()}
    assert got == {"in/a.pdf": (2, "three"), "in/b.pdf": (5, "two"), "in/upload.bin": (1, "nameless")}


def test_merges_equal_the_state_of_the_log(spark, tmp_path):
    r, path, log = random.Random(1), str(tmp_path / "current"), []
    for step in range(4):
        rows = [(r.randrange(300), step if step < 3 else 0, f"{step}-{i}") for i in range(200 if step == 0 else 10)]
        rows = list({x[0]: x for x in rows}.values())
        log += rows
        touched = store.merge_changes(spark.createDataFrame(rows, "id int, version int, x string"), path, parts=32)
        assert len(touched) <= min(32, len(rows))
    wanted = {}
    for i, version, x in log:
        if i not in wanted or version >= wanted[i][0]:
            wanted[i] = (version, x)
    got = store.read_current(spark, path)
    assert {x["id"]: (x["version"], x["x"]) for x in got.collect()} == wanted
    distinct = spark.createDataFrame([(i, v, x) for i, (v, x) in wanted.items()], "id int, version int, x string")
    assert sorted(map(tuple, state.current_state(distinct).collect())) == sorted(map(tuple, got.select("id", "version", "x").collect()))
    before = {p.name: sorted(f.stat().st_mtime_ns for f in p.iterdir()) for p in (tmp_path / "current").iterdir() if p.is_dir()}
    change = spark.createDataFrame([(5, 9, "new"), (None, 9, "no key")], "id int, version int, x string")
    (part,) = store.merge_changes(change, path, parts=32)
    after = {p.name: sorted(f.stat().st_mtime_ns for f in p.iterdir()) for p in (tmp_path / "current").iterdir() if p.is_dir()}
    assert {k for k in after if after[k] != before.get(k)} == {f"_part={part}"}
    assert store.merge_changes(change.limit(0), path, parts=32) == []


def test_imports_count_what_they_write(spark, root, monkeypatch):
    monkeypatch.setattr(reference.xlsx, "read_sheets", lambda data: None)
    monkeypatch.setattr(reference.xlsx, "named_column", lambda sheets, sheet, column: ["A", "B", "A", ""] if sheet == "Буксиры" else [])
    assert reference.import_into(spark, b"", root) == {"tugs": 2, "agents": 0}
    assert reference.import_into(spark, b"", root) == {"tugs": 0, "agents": 0}
    assert sorted(r["name"] for r in schemas.read(spark, root, "tugs").collect()) == ["A", "B"]


def test_aliases_of_the_table_equal_the_expression(spark):
    texts = [None, "", "  ", " Вход ", "отшвартовка судна", "перешвартовка", "буксировка", "x обслуживание судна y", "ВЫХОД и вход", "околка льда"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, work_type string")
    got = aliases.normalize(df, "work_type", dims.work_type_aliases(spark), "canonical")
    want = t.with_work_type(df, F.col("work_type"), "canonical")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(*got.columns).collect()), key=str)


def test_ten_thousand_aliases_equal_brute_force(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcd") for _ in range(n))
    table = [(i, "обслуживание " + word(r.randint(1, 7)) if i % 2 else word(r.randint(4, 9)), f"c{i % 977}") for i in range(10_000)] + [(10_001, "", "blank")]
    r.shuffle(table)
    texts = [("обслуживание " if i % 3 == 0 else "") + word(r.randint(0, 12)) + r.choice(["", " x"]) for i in range(300)] + [table[5][1].upper(), None]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(texts)], "work string, _low int")
    found = aliases.normalize(df, "work", spark.createDataFrame(table, "ord int, alias string, canonical string"), "canonical")
    order = sorted(x for x in table if x[1])
    for row in found.collect():
        low = row["work"] and row["work"].lower().strip(" ")
        want = next((c for _, a, c in order if a == low), None) or next((c for _, a, c in order if low and a in low), low) if row["work"] else None
        assert row["canonical"] == want, row
