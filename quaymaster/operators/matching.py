"""Matching of applications and vouchers: a score threshold planned as equality joins."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from ..storage import staged

#: Tenths of a point for the same vessel, work type and day (one day apart at most).
NAME, TYPE, DAY = 5, 3, 2
# Reasons as shown.
REASONS = ["совпадает судно", "совпадает вид работ", "совпадает дата"]


def _features(apps: DataFrame, vouchers: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = apps.select(F.col("id").alias("application_id"), t.norm_name(F.col("vessel_name")).alias("a_name"), t.normalize_work_type(t.direction_to_work_type(F.col("direction"))).alias("a_type"), F.to_date(F.coalesce("entry_datetime", "exit_datetime")).alias("a_day"))
    v = vouchers.select(F.col("id").alias("voucher_id"), t.norm_name(F.col("vessel_name")).alias("v_name"), t.normalize_work_type(F.col("work_type")).alias("v_type"), F.to_date(F.coalesce("started_dt", "finished_dt")).alias("v_day"))
    return a, v


def _scored(pairs: DataFrame, name: Column | bool, kind: Column | bool, day: Column | bool) -> DataFrame:
    """``pairs`` with score and reasons; what a join has settled already comes as True or False and costs nothing a pair.

    Every combination that is left has its score and reasons as fixed values, so a pair only looks up its own.
    """
    flags = [f if isinstance(f, bool) else F.coalesce(f, F.lit(False)) for f in (name, kind, day)]
    cases = []
    for held in product((True, False), repeat=3):
        if any(isinstance(f, bool) and f != h for f, h in zip(flags, held, strict=True)):
            continue
        points = sum(p for p, h in zip((NAME, TYPE, DAY), held, strict=True) if h)
        reasons = [F.lit(r) for r, h in zip(REASONS, held, strict=True) if h]
        open_flags = [f if h else ~f for f, h in zip(flags, held, strict=True) if not isinstance(f, bool)]
        cases.append((open_flags, F.lit(points / 10.0), F.array(*reasons).cast("array<string>")))

    def chosen(at: int) -> Column:
        case = None
        for open_flags, *values in cases[:-1]:
            hit = open_flags[0]
            for f in open_flags[1:]:
                hit = hit & f
            case = F.when(hit, values[at]) if case is None else case.when(hit, values[at])
        return cases[-1][1 + at] if case is None else case.otherwise(cases[-1][1 + at])

    return pairs.select("application_id", "voucher_id", chosen(0).alias("score"), chosen(1).alias("reasons"))


def match_candidates(apps: DataFrame, vouchers: DataFrame, min_score: float = 0.5) -> DataFrame:
    """application_id, voucher_id, score and reasons of all pairs that reach ``min_score``.

    A threshold is a boolean form of "same name", "same type" and "same day"; each disjunct is an equality
    join of its own, which leaves out the pairs of those before it, so nothing is deduplicated.  Only a
    threshold of 0 or less asks for all pairs.  Thresholds above 0 up to 0.3 ask for all pairs of a work type
    or of a day: a page's feature, meant for few applications.
    """
    a, v = _features(apps, vouchers)
    name = (F.col("a_name") == F.col("v_name")) & (F.col("a_name") != "")
    kind = (F.col("a_type") == F.col("v_type")) & (F.col("a_type") != "")
    day = F.abs(F.datediff("a_day", "v_day")) <= 1
    no = lambda c: ~F.coalesce(c, F.lit(False))
    days = v.withColumn("near", F.explode(F.array(*[F.date_add("v_day", i) for i in (-1, 0, 1)])))
    near = (F.col("a_day") == F.col("near"))  # the same as ``day``, as an equality
    need = math.ceil(min_score * 10 - 1e-9)
    # of a key the applications are the fewer rows: they stand on the right, which a merge join holds back for each row of the left
    by_name = _scored(v.join(a, name), True, kind, day)
    if need <= 0:
        return _scored(v.crossJoin(a), name, kind, day)
    if need <= TYPE:
        pairs = by_name.unionByName(_scored(v.join(a, kind & no(name)), False, True, day))
        return pairs if need > DAY else pairs.unionByName(_scored(days.join(a, near & no(name) & no(kind)), False, False, True))
    if need <= NAME:
        return by_name.unionByName(_scored(days.join(a, kind & near & no(name)), False, True, True))
    if need <= NAME + DAY:
        return _scored(v.join(a, name & (F.coalesce(kind, F.lit(False)) | F.coalesce(day, F.lit(False)))), True, kind, day)
    if need <= NAME + TYPE:
        return _scored(v.join(a, name & kind), True, True, day)
    if need <= NAME + TYPE + DAY:
        return _scored(days.join(a, name & kind & near), True, True, True)
    return by_name.limit(0)


def _first_ids(vouchers: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """The ``k`` smallest voucher ids of every key, ascending.

    Each task keeps its own ``k`` smallest before the shuffle (a group limit), so a hot key sends a few rows, not all of its own.
    """
    own = Window.partitionBy(*keys).orderBy("voucher_id")
    few = vouchers.select(*keys, "voucher_id").withColumn("_own", F.row_number().over(own)).where(F.col("_own") <= k)
    return few.groupBy(*keys).agg(F.sort_array(F.collect_list("voucher_id")).alias(name))


def top_candidates(apps: DataFrame, vouchers: DataFrame, k: int = 20, min_score: float = 0.2) -> DataFrame:
    """application_id, rank, voucher_id, score and reasons of the ``k`` best candidates of every application that reach ``min_score``.

    Best first, of equal scores the smaller voucher id, as ``ranked`` orders all of them; but no pairs are made that aren't among the
    results of a level.  What an application shares with a voucher (name, type, day) is a key; every key has the list of its ``k`` smallest voucher
    ids.  An application takes from the lists of its keys, level by level, what it doesn't have yet, until it has ``k``.  The ``k`` smallest
    ids are enough: of a list's first ``k`` those that stand on a higher level are taken already, so as many
    as are still missing remain.  Null and blank names, types and days are no keys.
    """
    a, v = _features(apps, vouchers)
    # the features are looked at once for each list, and found once; few bytes make much work below, so applications are dealt out
    a = staged(a.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), "application_id"), "match-applications")
    v = staged(v, "match-vouchers")
    v = v.toDF("voucher_id", "a_name", "a_type", "v_day")
    days = lambda df: df.withColumn("a_day", F.explode(F.array(*[F.date_add("v_day", i) for i in (-1, 0, 1)])))
    # what a type and a day have is cut to k before either alone is looked at: their own first k are among those
    few = staged(_first_ids(v, ["a_type", "v_day"], k, "ids").select("a_type", "v_day", F.explode("ids").alias("voucher_id")), "match-types")
    keys = {"name, type, day": (10, ["a_name", "a_type", "a_day"]), "name, type": (8, ["a_name", "a_type"]), "name, day": (7, ["a_name", "a_day"]), "name": (5, ["a_name"]), "type, day": (5, ["a_type", "a_day"]), "type": (3, ["a_type"]), "day": (2, ["a_day"])}
    shown = dict(zip(("name", "type", "day"), REASONS, strict=True))
    need, entries, none = math.ceil(min_score * 10 - 1e-9), [], F.array().cast("array<bigint>")

    def entry(code: int, points: int) -> Column:
        return F.transform(F.coalesce(f"_list{code}", none), lambda x: F.struct(F.lit(-points).alias("order"), x.alias("voucher_id"), F.lit(code).alias("code")))

    for code, (points, columns) in enumerate(keys.values()):
        if points < need:
            continue
        source = v if "a_name" in columns else few
        source = days(source) if "a_day" in columns else source
        source = source.where(" AND ".join(f"{c} IS NOT NULL" if c == "a_day" else f"{c} <> ''" for c in columns))
        a = a.join(_first_ids(source, columns, k, f"_list{code}"), columns, "left")
        entries.append(entry(code, points))

    def best(found: Column) -> Column:
        """The first ``k`` entries of different vouchers: a voucher's first one is that of its highest level."""
        ids = F.transform(found, lambda x: x["voucher_id"])
        return F.transform(F.array(ids), lambda ids: F.slice(F.filter(found, lambda x, i: F.array_position(ids, x["voucher_id"]) == i + 1), 1, k))[0]

    found = F.transform(F.array(F.sort_array(F.concat(*entries))), best)[0]  # sorted once
    found = a.select("application_id", F.posexplode(found).alias("_at", "_one"))
    reasons = F.array(*[F.array(*[F.lit(shown[c]) for c in kind.split(", ")]) for kind in keys])
    return found.select(
        "application_id", (F.col("_at") + 1).cast("bigint").alias("rank"), "_one.voucher_id", (F.col("_one.order") / F.lit(-10.0)).alias("score"), F.get(reasons, F.col("_one.code")).alias("reasons")
    )


def ranked(candidates: DataFrame) -> DataFrame:
    """Every application's candidates with their rank: best first; of equal scores the smaller voucher id."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("application_id").orderBy(F.desc("score"), "voucher_id"))).orderBy("application_id", "rank")


def create_works(accepted: DataFrame, apps: DataFrame, vouchers: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Work rows of accepted (application_id, voucher_id) pairs; a pair with a missing side gives none.

    ``keep`` names further columns of the vouchers that come along, so that what needs them later doesn't join the vouchers again.
    """
    a = apps.select(F.col("id").alias("application_id"), F.col("vessel_name").alias("_vessel"), F.col("agent").alias("_agent"), "gross_tonnage")
    v = vouchers.withColumnRenamed("id", "voucher_id")
    return work_rows(accepted.select("application_id", "voucher_id").join(a, "application_id").join(v, "voucher_id"), keep)


def work_rows(joined: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Work rows of vouchers that stand beside their application: application_id, voucher_id, _vessel, _agent and gross_tonnage, and the voucher's own columns."""
    return joined.select(
        F.lit("matched").alias("status"), "application_id", "voucher_id", "tug_id", t.first_filled(F.col("vessel_name"), F.col("_vessel")).alias("object_name"), "work_type",
        t.first_filled(F.col("agent"), F.col("_agent")).alias("agent"), "left_base_dt", "arrived_base_dt", "started_dt", "finished_dt", "gross_tonnage", "is_ice", "escort_hours", *keep,
    )


def mark_matched(rows: DataFrame, accepted_ids: DataFrame) -> DataFrame:
    """``rows`` with status matched where their id is among ``accepted_ids`` (column id)."""
    hit = accepted_ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, "id", "left").withColumn("status", F.when(F.col("_hit"), "matched").otherwise(F.col("status"))).select(*rows.columns)
