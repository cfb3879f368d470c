import random
from datetime import datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from quaymaster import schemas
from quaymaster.operators import matching, state

APPS = "id bigint, vessel_name string, direction string, agent string, gross_tonnage int, entry_datetime timestamp_ntz, exit_datetime timestamp_ntz"
VOUCHERS = "id bigint, vessel_name string, work_type string, agent string, tug_id bigint, left_base_dt timestamp_ntz, arrived_base_dt timestamp_ntz, started_dt timestamp_ntz, finished_dt timestamp_ntz, is_ice boolean, escort_hours double"
DAY = datetime(2026, 7, 20, 23, 30)


def frames(spark):
    apps = [(1, "M/V Alpha", "вход", None, 100, DAY, None), (2, "", "прочее", None, 100, None, None), (3, None, "выход", "A", 5, None, DAY)]
    vouchers = []
    for n, w, d in product((True, False), repeat=3):
        vouchers.append((10 + len(vouchers), "mv-alpha" if n else "Beta", "Швартовка" if w else "буксировка", "", 1, None, None, DAY + timedelta(hours=1) if d else None, None, False, None))
    vouchers.append((30, "", "прочее", "B", None, None, None, None, DAY + timedelta(days=2), True, 1.0))
    return spark.createDataFrame(apps, APPS), spark.createDataFrame(vouchers, VOUCHERS)


@pytest.mark.parametrize("threshold", [0, 0.05, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 1.0, 1.1])
def test_every_threshold_equals_all_pairs(spark, threshold):
    apps, vouchers = frames(spark)
    every = {(r["application_id"], r["voucher_id"]): r["score"] for r in matching.match_candidates(apps, vouchers, 0).collect()}
    assert len(every) == apps.count() * vouchers.count()
    got = [(r["application_id"], r["voucher_id"], r["score"]) for r in matching.match_candidates(apps, vouchers, threshold).collect()]
    assert sorted(got) == sorted((a, v, s) for (a, v), s in every.items() if s >= threshold)


def test_scores_and_reasons(spark):
    apps, vouchers = frames(spark)
    got = {(r["application_id"], r["voucher_id"]): r for r in matching.match_candidates(apps, vouchers, 0).collect()}
    assert got[1, 10]["score"] == 1.0 and got[1, 10]["reasons"] == ["совпадает судно", "совпадает вид работ", "совпадает дата"]
    assert got[2, 30]["score"] == 0.3  # the rest direction equals the rest work type; blank names are no match
    assert [r["voucher_id"] for r in matching.ranked(matching.match_candidates(apps.where("id = 1"), vouchers, 0.5)).collect()][:2] == [10, 11]
    assert [r["rank"] for r in matching.ranked(matching.match_candidates(apps.where("id = 1"), vouchers, 0.5)).collect()] == list(range(1, 6))


@pytest.mark.parametrize(("k", "least"), [(1, 0.2), (3, 0.2), (7, 0.3), (40, 0.2), (5, 0.5), (4, 0.8), (2, 1.0)])
def test_top_candidates_equal_all_pairs_ranked(spark, k, least):
    r = random.Random(k)
    day = lambda: r.choice([None, DAY + timedelta(days=r.randrange(4))])
    apps = spark.createDataFrame([(i, r.choice(["A", "b ", None, "", "C"]), r.choice(["вход", "выход", "прочее", "", None]), None, 1, day(), day()) for i in range(40)], APPS)
    # one name and one type hold most of the vouchers
    vouchers = spark.createDataFrame([(1000 - i, r.choice(["a"] * 4 + ["B", None, "d"]), r.choice(["Швартовка"] * 4 + ["выход", "", None, "прочее"]), "", 1, None, None, day(), day(), False, None) for i in range(150)], VOUCHERS).repartition(5)
    every = matching.ranked(matching.match_candidates(apps, vouchers, 0).where(F.col("score") >= least)).where(F.col("rank") <= k)
    got = matching.top_candidates(apps, vouchers, k, least)
    show = lambda df: sorted((x["application_id"], x["rank"], x["voucher_id"], x["score"], tuple(x["reasons"])) for x in df.collect())
    assert show(got) == show(every) and got.count() > 0


def test_top_candidates_limit_groups_before_the_shuffle(spark):
    plan = matching.top_candidates(*frames(spark), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert matching.top_candidates(*(df.limit(0) for df in frames(spark))).count() == 0


def test_no_cartesian_plan(spark):
    apps, vouchers = frames(spark)
    for threshold in (0.2, 0.3, 0.5, 0.7, 0.8, 1.0):
        plan = matching.match_candidates(apps, vouchers, threshold)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_create_works_and_status(spark):
    apps, vouchers = frames(spark)
    accepted = spark.createDataFrame([(1, 10), (3, 30), (99, 10)], "application_id bigint, voucher_id bigint")
    works = {r["application_id"]: r for r in matching.create_works(accepted, apps, vouchers).collect()}
    assert set(works) == {1, 3} and works[1]["object_name"] == "mv-alpha" and works[1]["agent"] is None and works[3]["agent"] == "B"
    marked = matching.mark_matched(apps.withColumn("status", F.lit("confirmed")), accepted.select(F.col("application_id").alias("id")))
    assert {r["id"]: r["status"] for r in marked.collect()} == {1: "matched", 2: "confirmed", 3: "matched"}


def test_state(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, "c")], "id bigint, version int, x string")
    assert {r["id"]: r["x"] for r in state.current_state(log).collect()} == {1: None, 2: "c"}
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id bigint, x string, y int")
    changes = spark.createDataFrame([(1, None), (7, "z"), (None, "new")], "id bigint, x string")
    got = sorted((r["id"] or 0, r["x"], r["y"]) for r in state.upsert(rows, changes).collect())
    assert got == [(0, "new", None), (1, None, 1), (2, "b", 2)]
    there = spark.createDataFrame([("a",)], "name string")
    new = spark.createDataFrame([("a",), ("b",), ("b",), ("",), (None,)], "name string")
    assert [r["name"] for r in state.insert_if_absent(there, new).collect()] == ["b"]
    keys = spark.createDataFrame([(i * i if i < 290 else 10**15 + i, 1) for i in range(1, 300)] + [(None, 1)], "id bigint, _bin int")
    for numbered in (state.numbered(keys, bins=20), state.numbered(keys, keys=keys.select("id"))):
        assert numbered.columns == ["id", "_bin", "number"]
        assert [r["number"] for r in numbered.orderBy(F.asc_nulls_last("id")).collect()] == list(range(1, 301))
    assert state.numbered(spark.createDataFrame([], "id bigint")).count() == 0


def test_schemas_and_keys(spark, tmp_path):
    schemas.create_all(spark, str(tmp_path))
    tables = {n: schemas.read(spark, str(tmp_path), n) for n in schemas.SCHEMAS}
    assert all(df.count() == 0 for df in tables.values())
    vouchers = spark.createDataFrame([(1, 5), (2, None), (3, 1)], "id bigint, tug_id bigint")
    bad = state.all_violations({"vouchers": vouchers, "tugs": spark.createDataFrame([(1, "x")], "id bigint, name string")}).collect()
    assert [(r["table"], r["id"], r["value"]) for r in bad] == [("vouchers", 1, 5)]


def test_pairs_of_a_type_and_a_day_look_at_the_name_alone(spark):
    plan = matching.match_candidates(*frames(spark), 0.5)._jdf.queryExecution().optimizedPlan().toString()
    pairs = [line for line in plan.splitlines() if " AS score#" in line]
    assert len(pairs) == 2 and "0.5 AS score" in pairs[1] and "datediff" not in pairs[1] and "CASE" not in pairs[1]  # settled by the join
    assert "filter(" not in plan.split("Join Inner")[0]  # reasons are chosen, not put together for each pair


def test_settled_flags_give_the_scores_of_all_pairs(spark):
    apps, vouchers = frames(spark)
    every = {(r["application_id"], r["voucher_id"]): (r["score"], r["reasons"]) for r in matching.match_candidates(apps, vouchers, 0).collect()}
    parts = {("совпадает судно", 0.5), ("совпадает вид работ", 0.3), ("совпадает дата", 0.2)}
    assert all(abs(score - sum(p for r, p in parts if r in reasons)) < 1e-9 for score, reasons in every.values())
    for threshold in (0.2, 0.3, 0.5, 0.7, 0.8, 1.0):
        got = {(r["application_id"], r["voucher_id"]): (r["score"], r["reasons"]) for r in matching.match_candidates(apps, vouchers, threshold).collect()}
        assert got == {k: x for k, x in every.items() if x[0] >= threshold}
