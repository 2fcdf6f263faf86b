"""Outliers, validation, history, streams, sources and exports."""

import io
import json
import os
import random
import statistics
import subprocess
import sys
import threading
import zipfile
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scrubjay.functions import ordering, stats
from scrubjay.functions.columns import MISSING_MARKERS, is_missing, missing_in
from scrubjay.operators import OperationSpec, replay
from scrubjay.plans import outliers, stages, validate
from scrubjay.plans.lineage import History
from scrubjay.plans.project import Project
from scrubjay.session import ROW_ID, Scratch, configure, materialize, scratch_path
from scrubjay.sources import csv, excel, preview, sinks, store
from scrubjay.streaming.ops import clean_stream
from tests.helpers import column, frame


# --- statistics --------------------------------------------------------------


def test_order_statistics_by_narrowing(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.gauss(0, 1), 5.0, 5.0, float(rng.randrange(3))]) for _ in range(3000)]
    df = frame(spark, "v double", [(v,) for v in values], 4)
    ordered = sorted(values)
    for rank in (0, 1, 700, 1499, 1500, 2400, 2998, 2999):
        assert stats.at_rank(df, "v", rank, few=50) == ordered[rank]
    ranks = [0, 1, 700, 1499, 2999]
    assert stats.at_ranks(df, "v", ranks, few=50) == stats.at_ranks(df, "v", ranks, few=900) == stats.at_ranks(df, "v", ranks) == [ordered[r] for r in ranks]
    assert stats.median(df, "v") == pytest.approx(statistics.median(values))
    assert stats.quantile_nearest(df, "v", 0.25) == ordered[int(2999 * 0.25 + 0.5)]
    assert stats.median(df.limit(0), "v") is None and stats.quantile_nearest(df.limit(0), "v", 0.5) is None
    assert stats.mode_smallest(frame(spark, "v string", ["b", "a", "a", "b", (None,)]), "v") == "a"


def test_order_statistics_take_as_many_jobs_at_any_size(spark):
    """As many at 5 and 20 million rows, for one rank and for eight; ties and extremes don't add any."""
    sc = spark.sparkContext
    jobs = {}
    for n in (5_000_000, 20_000_000):
        df = spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN 7.0D WHEN id % 1000 = 1 THEN 1e300 * (id % 17) ELSE cast(hash(id) as double) END AS v")
        for ranks in ([n // 4], [0, 1, n // 4, n // 2, n // 2 + 1, 3 * n // 4, n - 2, n - 1]):
            sc.setJobGroup(f"{n}-{len(ranks)}", "ranks")
            found = stats.at_ranks(df, "v", ranks)
            jobs[n, len(ranks)] = len(sc.statusTracker().getJobIdsForGroup(f"{n}-{len(ranks)}"))
            sc.setJobGroup("rest", "rest")
            below = df.agg(*(x for v in found for x in (F.count_if(F.col("v") < v), F.count_if(F.col("v") <= v)))).first()
            assert all(below[2 * i] <= r < below[2 * i + 1] for i, r in enumerate(ranks))
    assert len(set(jobs.values())) == 1, jobs


def test_groups_and_histogram(spark):
    df = frame(spark, "g string, v double", [("a", float(i)) for i in range(10)] + [("b", 4.0), ("b", None)])
    rows = {r.g: r for r in stats.group_quantiles(df, ["g"], F.col("v")).collect()}
    assert (rows["a"].n, rows["a"].median, rows["a"].q1, rows["a"].q3) == (10, 4.5, 2.0, 7.0)
    assert rows["b"].median == 4.0
    rng = random.Random(5)
    many = frame(spark, "g string, h long, v double", [(rng.choice(["hot"] * 8 + ["cold", None]), rng.randrange(2), rng.choice([None, float(rng.randrange(40)), rng.random()])) for _ in range(1500)], 5)
    ranks = stats.group_ranks(many, ["g", "h"], F.col("v"), rows_per_bucket=60)
    for own in (ranks, stats.group_ranks(many, ["g", "h"], F.col("v"))):
        got = {(r.g, r.h, r.v): (r.n, r.upto, r.total) for r in own.collect()}
        values: dict = {}
        for r in many.where("v is not null").collect():
            values.setdefault((r.g, r.h), []).append(r.v)
        assert got == {(*k, v): (x.count(v), sum(y <= v for y in x), len(x)) for k, x in values.items() for v in x}
    plans = [stats.group_quantiles(many, ["g", "h"], F.col("v"), rows_per_bucket=b) for b in (60, 10**6)]
    assert sorted(map(str, plans[0].collect())) == sorted(map(str, plans[1].collect()))
    counts = many.where("v is not null").groupBy("g", "h", "v").agg(F.count("*").alias("n"))
    dealt = ordering.by_key(counts, F.struct("g", "h", "v"), 60).frame
    assert dealt.where("g = 'hot' and h = 0").select(ordering.BUCKET).distinct().count() > 3  # one group in several tasks
    bins = stats.histogram(frame(spark, "v double", [(float(i),) for i in range(31)]), "v").collect()
    assert len(bins) == 30 and sum(r.n for r in bins) == 31 and bins[0].n == 2
    assert sum(r.n for r in stats.histogram(frame(spark, "v double", [3.0, 3.0]), "v").collect()) == 2


@pytest.mark.parametrize("bucket", [10**6, 7])
def test_positions_and_windows(spark, bucket):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(9)]), float(rng.randrange(100))) for _ in range(150)]
    df = frame(spark, "t long, v double", rows, 5)
    placed = ordering.with_position(ordering.in_buckets(df, ROW_ID, "t", bucket))
    want = sorted(range(150), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    got = [r[0] for r in placed.orderBy(ordering.POSITION).select(ROW_ID).collect()]
    assert got == want
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000  # no bounds or counts in the plan
    near = ordering.around(placed, 2, lambda w: {"s": F.sum("v").over(w)}, block=11)
    sums = {r[ordering.POSITION]: r.s for r in near.collect()}
    line = [rows[i][1] for i in want]
    assert sums == {i: sum(line[max(0, i - 2) : i + 3]) for i in range(150)}


# --- outliers ----------------------------------------------------------------


def test_screen(spark):
    df = frame(spark, "v double", [10.0] * 20 + [500.0])
    found = outliers.screen(df, "v")
    assert found["outlier_count"] == 1 and column(found["flagged"], "value") == [500.0] and not found["treatments_enabled"]
    spread = frame(spark, "v string", [str(i) for i in range(1, 101)] + ["n/a", "x"])
    s = outliers.column_stats(spread, "v")
    assert (s["count"], s["median"], s["q1"], s["q3"]) == (100, 50.5, 26.0, 75.0)
    assert outliers.bounds(spread, "v", "iqr") == (26 - 1.5 * 49, 75 + 1.5 * 49)
    assert outliers.bounds(spread, "v", "percentile") == (2.0, 99.0)
    low, high = outliers.bounds(spread, "v", "zscore")
    assert high - s["mean"] == pytest.approx(3 * statistics.stdev(range(1, 101)))
    assert outliers.bounds(df, "v", "modified_zscore") == (10.0, 500.0)
    assert outliers.bounds(df, "v", "manual", {"max": 20}) == (float("-inf"), 20.0)
    with pytest.raises(ValueError):
        outliers.bounds(df, "v", "manual")
    with pytest.raises(ValueError):
        outliers.column_stats(frame(spark, "v string", ["x"]), "v")


def test_contexts(spark):
    rows = [(float(i % 7), f"id{i}", "k", "word " * 10 + str(i), None if i % 2 else "m", "g" if i % 3 else "h", i % 5, datetime(2024, 1, 1) + timedelta(days=i % 9), f"c{i % 4}") for i in range(60)]
    df = frame(spark, "v double, uid string, const string, free string, gaps string, two string, num long, t timestamp_ntz, cat string", rows)
    found = {x["column"]: x["kind"] for x in outliers.contexts(df, "v", outcome="cat")}
    assert found == {"two": "boolean", "num": "numeric", "t": "datetime", "cat": "categorical"}
    assert outliers.contexts(df, "v", outcome="cat")[0]["column"] == "cat"


def statuses(out):
    return {r[ROW_ID]: r.status for r in out["evidence"].collect()}


def test_reviews(spark):
    rows = [(float(i), 2.0 * i) for i in range(20)] + [(21.0, 200.0), (100.0, 200.0), (5000.0, None)]
    df = frame(spark, "x double, y double", rows)
    out = outliers.review(df, "x", "y", [20, 21, 22])
    assert statuses(out) == {20: outliers.UNUSUAL, 21: outliers.EXPLAINED, 22: outliers.INSUFFICIENT}
    assert out["kind"] == "numeric" and out["trend"]["slope"] == pytest.approx(2.0) and out["usable_pairs"] == 22
    groups = frame(spark, "v double, level string", [(100.0 + i % 5, "low") for i in range(12)] + [(900.0 + i % 5, "high") for i in range(12)] + [(903.0, "low"), (5.0, "few")])
    out = outliers.review(groups, "v", "level", [13, 24, 25])
    assert out["kind"] == "categorical" and statuses(out) == {13: outliers.EXPLAINED, 24: outliers.UNUSUAL, 25: outliers.INSUFFICIENT}
    days = frame(spark, "v double, t timestamp_ntz", [(float(i % 4), datetime(2024, 1, 1) + timedelta(days=i)) for i in range(40)] + [(2.0, datetime(2024, 1, 20, 5)), (99.0, datetime(2024, 1, 21, 5))])
    out = outliers.review(days, "v", "t", [40, 41])
    assert out["kind"] == "datetime" and statuses(out) == {40: outliers.EXPLAINED, 41: outliers.UNUSUAL}
    assert outliers.visual_sample(df, "x", "y", df.where("x > 50").select(ROW_ID), most=5).count() == 7


def test_outlier_log():
    log = outliers.OutlierLog()
    log.flag("v", [3, 1])
    with pytest.raises(ValueError):
        log.treatment("v", [1], "remove")
    log.add_evidence("v", "c", {1: outliers.UNUSUAL})
    assert log.treatment("v", [1], "remove") == ("drop_rows", {"row_ids": [1]})
    assert log.treatment("v", [1], "impute")[1]["method"] == "median" and log.treatment("v", [1], "keep") is None
    log.decide("v", [1], "valid_extreme")
    log.decide("v", [3], "needs_review")
    assert log.unresolved() == 1
    again = outliers.OutlierLog(json.loads(json.dumps(log.data)))
    again.keep_all("v")
    assert again.unresolved("v") == 0


def test_outlier_tables(spark, tmp_path):
    df = frame(spark, "v double", [(float(i % 5),) for i in range(4000)] + [(1e6,)] * 2000)
    log = outliers.OutlierLog(folder=str(tmp_path))
    log.flag("v", outliers.flagged(df, "v", -1, 1000))
    assert log.unresolved() == 2000
    with pytest.raises(ValueError):
        log.treatment("v", None, "set_missing")
    log.add_evidence("v", "c", df.where("v > 1000").select(ROW_ID, F.lit(outliers.UNUSUAL).alias("status")))
    log = outliers.OutlierLog(json.loads(json.dumps(log.data)), str(tmp_path))
    op, params = log.treatment("v", None, "set_missing")
    assert len(json.dumps(log.data)) < 2000 and replay(df, [OperationSpec(op, "univariate", params)]).where("v is null").count() == 2000
    op, params = log.treatment("v", None, "remove")
    assert replay(df, [OperationSpec(op, "univariate", params)]).count() == 4000
    log.decide("v", [4000, 4001], "valid_extreme")
    assert log.unresolved() == 1998
    log.decide("v", [4002], "needs_review")
    log.decide("v", None, "likely_error")
    assert log.unresolved("v") == 1
    log.keep_all("v")
    assert log.unresolved() == 0
    with pytest.raises(ValueError):
        clean_stream(spark.readStream.format("rate").load(), [OperationSpec("drop_rows", "structures", {"row_table": params["row_table"]})])


# --- validation and history --------------------------------------------------


def test_validation(spark):
    before = frame(spark, "a long, b string", [(1, "x"), (1, "x"), (None, "y"), (4, "z")])
    after = replay(before, [OperationSpec("treat_missing", "missingness", {"column": "a", "method": "constant", "value": 9}), OperationSpec("drop_rows", "structures", {"row_ids": [1]})])
    out = validate.validate(before, after, key=["a"], unresolved_outliers=2, states={"profile": "outdated"})
    assert (out["missing_before"], out["missing_after"], out["duplicates_before"], out["duplicates_after"]) == (1, 0, 1, 0)
    assert (out["cells_changed"], out["rows_changed"], out["rows_removed"]) == (1, 1, 1) and out["key"]["holds"] and len(out["warnings"]) == 2
    assert {r.column: r.n_changed for r in validate.changed_cells(before, after).collect()} == {"a": 1, "b": 0}
    shown = validate.preview(before, after)
    assert column(shown["affected"], ROW_ID) == [2] and shown["examples"][0]["after"]["a"] == "9"


def dirty(spark):
    rows = [(" Alice ", "30", "sales", "2024-01-05"), ("BOB", "-5", "Sales", "2024-02-05"), ("carol", "31", None, "bad"), ("Dave", "29", "HR", "2024-03-05"), ("N/A", "40", "hr", "01/02/2024"), ("erin", "N/A", "HR", "2024-04-05"), ("Frank", "35", "sales", None), ("alice", "30", "sales", "2024-01-05")]
    return frame(spark, "` name ` string, Age string, Dept string, Joined string", rows)


STEPS = [
    ("rename_column", {"from": " name ", "to": "name"}, "column_names"),
    ("treat_missing", {"column": "Dept", "method": "constant", "value": "Unknown"}, "missingness"),
    ("treat_missing", {"column": "Age", "method": "median"}, "missingness"),
    ("convert_type", {"column": "Age", "target_type": "decimal"}, "types"),
    ("convert_type", {"column": "Joined", "target_type": "date"}, "types"),
    ("normalize", {"columns": ["name", "Dept"], "operations": ["trim", "lower"]}, "normalization"),
    ("mask_values", {"column": "Age", "rule": {"type": "range", "min": 0, "max": 120}}, "invalid_values"),
    ("drop_rows", {"row_ids": [2, 7]}, "duplicates"),
]


def test_only_ranges_that_differ_are_compared(spark, tmp_path):
    n = 10 * validate.RANGE
    spark.range(n).selectExpr("id AS __rid", "CASE WHEN id % 5 = 0 THEN NULL ELSE id END AS a", "CAST(id AS DOUBLE) AS v", "repeat('x', 50) AS b").write.parquet(str(tmp_path / "t"))
    before = spark.read.parquet(str(tmp_path / "t"))
    after = before.withColumn("b", F.when(F.col("__rid") == 3 * validate.RANGE + 7, "y").otherwise(F.col("b"))).where("__rid <> 8")
    assert sorted(r.range for r in validate.differing_ranges(before, after, ["a", "v", "b"]).collect()) == [0, 3]
    joined, _ = validate._side_by_side(before, after)
    assert joined.count() == 2 * validate.RANGE - 1
    assert {r.column: r.n_changed for r in validate.changed_cells(before, after).collect()} == {"a": 0, "v": 0, "b": 1} and validate.change_totals(before, after) == (1, 1)
    assert validate.change_totals(before, before) == (0, 0) and validate.preview(before, after)["examples"][0]["after"]["b"] == "y"
    moved = before.withColumn("a", F.when(F.col("__rid") == 1, None).when(F.col("__rid") == 5, 1).otherwise(F.col("a")))
    assert validate.change_totals(before, moved) == (2, 2)  # a value that changes its row is seen


def test_history(spark, tmp_path):
    past = History.start(dirty(spark), str(tmp_path / "h"), every=3)
    past.states |= {"profile": "completed", "keys": "completed"}
    for op, params, stage in STEPS:
        past.apply(op, params, stage)
    assert past.states["profile"] == past.states["keys"] == "outdated" and past.checkpoints == [3, 6]
    done = past.working()
    assert column(done, "Age") == [30.0, None, 29.0, 40.0, 30.0, 35.0] and done.count() == 6
    assert column(done, "name")[0] == "alice"
    linear = replay(past.original(), past.specs)
    assert done.exceptAll(linear).count() == linear.exceptAll(done).count() == 0
    for _ in STEPS:
        last = past.undo()
    assert last.columns[1] == " name " and past.undo() is None
    for _ in range(6):
        past.redo()
    assert column(past.working(), "name")[1] == "bob"
    again = History.from_json(spark, str(tmp_path / "h"), past.to_json())
    assert again.working().exceptAll(past.working()).count() == 0
    past.apply("drop_column", {"column": "Age"})
    assert past.redo() is None and past.pointer == 7
    with pytest.raises(ValueError):
        past.apply("drop_column", {"column": "Age"})
    assert past.pointer == 7


def test_history_is_opened_from_its_folder(spark, tmp_path):
    """What a lost driver had recorded is there, undone steps too; a second writer is refused and can go on from what is there."""
    folder = str(tmp_path / "h")
    past = History.start(dirty(spark), folder, every=3)
    for op, params, stage in STEPS[:4]:
        past.apply(op, params, stage)
    past.undo()
    past.mark("keys", "completed")
    want, state = past.working(), past.to_json()
    del past
    again = History.open(spark, folder)
    assert again.to_json() == state and (again.pointer, len(again.specs), again.every, again.states["keys"]) == (3, 4, 3, "completed")
    assert again.working().exceptAll(want).count() == want.exceptAll(again.working()).count() == 0
    assert again.redo() is not None and again.pointer == 4
    other = History.open(spark, folder)
    again.apply(*STEPS[4])
    before = other.to_json()
    for change in (other.undo, lambda: other.apply(*STEPS[4])):
        with pytest.raises(store.Conflict):
            change()
    assert other.to_json() == before and History.open(spark, folder).to_json() == again.to_json()
    other = History.open(spark, folder)
    other.undo()
    with pytest.raises(store.Conflict):
        again.undo()
    with pytest.raises(ValueError):
        History.open(spark, str(tmp_path / "none"))


def test_writers_race_for_a_version(spark, tmp_path):
    """Of many writers at once, one gets each version, and no half of a record is ever read."""
    journals = [store.Journal(spark, str(tmp_path / "j"), keep=3) for _ in range(6)]
    won, start = [], threading.Barrier(6)

    def write(k):
        start.wait()
        for _ in range(5):
            journals[k].read()
            try:
                won.append((journals[k].commit({"by": k, "pad": "x" * 50_000}), k))
            except store.Conflict:
                pass

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    last = store.Journal(spark, str(tmp_path / "j"))
    assert last.read()["by"] == dict(won)[max(v for v, _ in won)] and sorted(v for v, _ in won) == list(range(1, last.version + 1))
    assert sum(f.endswith(".json") and f[0] != "." for f in os.listdir(tmp_path / "j")) <= 3 + 6


def test_project(spark, tmp_path):
    project = Project(spark, str(tmp_path / "p"))
    item = project.add("people", frame(spark, "k long, v double", [(1, 10.0), (1, 10.0), (2, 11.0)] + [(i, 10.0 + i % 3) for i in range(3, 20)] + [(99, 5000.0)]))
    project.add("other", frame(spark, "a string", ["x"]))
    with pytest.raises(ValueError):
        project.add("other", frame(spark, "a string", ["x"]))
    made = []
    for _ in range(2):
        item.assess("profile", lambda df: made.append(df.count()))
    assert made == [21] and item.history.states["profile"] == "completed"
    assert item.declare_key(["k"])["identical_groups"] == 1
    assert item.preview("drop_rows", {"row_ids": [0]})["rows_after"] == 20 and item.history.pointer == 0
    assert item.find_duplicates(["k"])["candidate_pairs"] == 1 and item.flagged_records().count() == 2
    item.resolve_duplicates(["k"], "keep_first")
    assert item.history.specs[-1].params == {"columns": ["k"], "how": "keep_first", "blocking": []}
    assert item.history.undo().count() == 21 and item.history.redo().count() == 20
    item.resolve_duplicates(["k"], "keep_last")
    assert item.history.pointer == 1  # nothing is left to resolve
    assert item.history.working().count() == 20 and item.history.states["profile"] == "outdated"
    item.outliers.flag("v", [20])
    with pytest.raises(ValueError):
        project.export(["csv"])
    item.outliers.add_evidence("v", "k", {20: outliers.UNUSUAL})
    figures = item.treat_outliers("v", [20], "cap", {"max": 20})
    assert figures["before"]["max"] == 5000.0 and figures["after"]["max"] == 20.0
    item.resolve_duplicates([], "merge", keep=2, group=[2, 3], field_values={"v": 7.5})
    again = Project.from_json(spark, project.to_json())
    assert again.items["people"].history.working().count() == 19 and again.items["people"].key == ["k"]
    reopened = Project.open(spark, str(tmp_path / "p"))
    assert list(reopened.items) == ["people", "other"] and reopened.to_json() == project.to_json()
    assert reopened.items["people"].history.working().count() == 19 and reopened.items["people"].outliers.unresolved(spark=spark) == 0
    project.set_status("other", "excluded")
    with pytest.raises(store.Conflict):
        reopened.set_status("other", "ready")
    assert Project.open(spark, str(tmp_path / "p")).items["other"].status == "excluded"
    out = project.export(["csv", "report", "json", "script"], acknowledged=True)
    assert set(out) == {"people.csv", "people.html", "people.json", "people.py"} and spark.read.option("header", True).csv(out["people.csv"]).count() == 19
    item.screen_outliers("v", "manual", {"max": 19.5})
    item.review_outliers("v", "k")
    out = project.export(["xlsx", "flagged", "zip", "report"], acknowledged=True)
    assert set(out) == {"workbook.xlsx", "people_flagged.csv", "bundle.zip", "people.html"}
    (sheet,) = excel.read_workbook(spark, open(out["workbook.xlsx"], "rb").read(), "xlsx").items()
    assert sheet[0] == "people" and sheet[1].count() == 19 and sheet[1].columns == ["k", "v", ROW_ID]
    assert {r["__flag_reason"] for r in spark.read.option("header", True).csv(out["people_flagged.csv"]).collect()} == {"outlier:v"}
    with pytest.raises(ValueError):
        project.export(["pdf"], acknowledged=True)
    with pytest.raises(ValueError):
        item.reread(spark, "x", "utf-8", ",")
    with pytest.raises(ValueError):
        project.set_status("other", "odd")


def test_operations_outdate_what_reads_their_columns(spark, tmp_path):
    """Jobs are counted: a cached assessment runs none."""
    item = Project(spark, str(tmp_path / "p")).add("t", frame(spark, "a string, b long, c long", [("x", 1, 1), (None, None, 2), ("x", 3, 3)]))
    sc, names = spark.sparkContext, ["a", "b", "c"]

    def assess():
        sc.setJobGroup(f"assess-{item.history.pointer}-{random.random()}", "")
        group = sc.getLocalProperty("spark.jobGroup.id")
        found = item.assess_columns("missingness", lambda df: df.agg(F.count_if(F.col(df.columns[1]).isNull())).first()[0], names)
        jobs = len(sc.statusTracker().getJobIdsForGroup(group))
        sc.setJobGroup("rest", "")
        return found, jobs

    found, all_three = assess()
    assert found == {"a": 1, "b": 1, "c": 0} and all_three >= 3 and assess() == (found, 0)
    item.apply("fill_null_constant", {"column": "a", "value": "y"})
    found, one = assess()
    assert found == {"a": 0, "b": 1, "c": 0} and one * 3 == all_three
    item.history.undo()
    assert assess() == ({"a": 1, "b": 1, "c": 0}, 0)  # as it was before
    item.history.redo()
    item.apply("drop_rows", {"row_ids": [1]})
    assert assess() == ({"a": 0, "b": 0, "c": 0}, all_three)
    item.apply("rename_columns", {"mapping": {"b": "c", "c": "b"}})
    assert assess()[1] == one * 2
    assert stages.writes("normalize", {"columns": ["a", "b"]}) == {"a", "b"} and stages.writes("treat_missing", {"column": "a", "method": "drop_rows"}) is None and stages.writes("odd", {}) is None


def test_stages():
    states = dict.fromkeys(stages.STAGES, "completed")
    assert "validation" in stages.demote(states, "types") and states["missingness"] == "completed"
    assert stages.demote(states, "types") == [] and stages.outdated_by("column_names") == ()
    assert stages.demote(dict.fromkeys(stages.STAGES, "completed"), "outcome") == ["bivariate"]


def test_streams(spark, tmp_path):
    frame(spark, "a string", [" X ", "n/a"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"{ROW_ID} long, a string").parquet(str(tmp_path / "in"))
    spec = OperationSpec("normalize", "normalization", {"columns": ["a"], "operations": ["trim", "lower"]})
    out = clean_stream(stream, [spec])
    out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(60)
    assert column(spark.read.parquet(str(tmp_path / "out")), "a") == ["x", "n/a"]
    with pytest.raises(ValueError):
        clean_stream(stream, [OperationSpec("treat_missing", "missingness", {"column": "a", "method": "mode"})])
    with pytest.raises(ValueError):
        clean_stream(frame(spark, "a string", ["x"]), [spec])


# --- sources and exports -----------------------------------------------------


def test_detection(spark, tmp_path):
    assert csv.kind_of(b"a,b\n", ".csv") == "csv" and csv.kind_of(b"PK\x03\x04", "xlsx") == "xlsx"
    for head, name in ((b"a\0b", ".csv"), (b"PK\x03\x04", ".csv"), (b"a,b", ".xlsx")):
        with pytest.raises(ValueError):
            csv.kind_of(head, name)
    assert csv.delimiter_of(["a;b;c", "1,5;2;3"]) == ";" and csv.delimiter_of(["abc"]) == ","
    assert csv.encoding_of("é".encode()) == "utf-8" and csv.encoding_of(b"\xef\xbb\xbfa") == "utf-8"
    assert csv.encoding_of("naïve café déjà vu".encode("latin-1")) != "utf-8"


def test_csv_round_trip(spark, tmp_path):
    configure(spark)
    (tmp_path / "a.csv").write_text('Date;CO(GT);PT08.S1(CO);note\n10/03/2004;2,6;1360;"x; ""y"""\n11/03/2004;;1292;=cmd()\n', encoding="utf-8")
    df = csv.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Date", "CO(GT)", "PT08.S1(CO)", "note", ROW_ID]
    assert column(df, "PT08.S1(CO)") == [1360, 1292] and column(df, "CO(GT)") == ["2,6", None] and column(df, "note")[0] == 'x; "y"'
    with pytest.raises(ValueError):
        csv.read_csv(spark, str(tmp_path / "a.csv"), most_rows=1)
    sinks.write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert {r.note for r in back.collect()} >= {"'=cmd()"} and ROW_ID not in back.columns
    seen = preview.preview(df, 1)
    assert seen["n_rows"] == 2 and len(seen["rows"]) == 1 and preview.missing_rows(df, "CO(GT)")[0]["PT08.S1(CO)"] == 1292


def csv_text(rng, n, end, delimiter=","):
    """Records with line breaks, doubled quotes and delimiters in quotes, and quotes that open nothing."""
    def field():
        kind = rng.randrange(8)
        if kind == 0:
            inner = "".join(rng.choice(["a", "é", "\n", end, '""', delimiter, " "]) for _ in range(rng.randrange(12)))
            return f'"{inner}"'
        return ["", "x", "12", '5""" pipe'[: rng.choice((2, 7))] if kind == 3 else "y z", "-1.5", "o'k"][rng.randrange(6)]

    rows = [delimiter.join([str(i), field(), field(), field()]) for i in range(n)]
    if n > 5:
        rows.insert(3, "")
        rows.insert(5, f'77{delimiter}"{end.join(["long"] * 400)}"{delimiter}{delimiter}z')
    return end.join([delimiter.join(["id", "a", '"b"' if end == "\n" else "b", "a"]), *rows]) + (end if n % 2 else "")


@pytest.mark.parametrize("n, end, delimiter, encoding", [(300, "\n", ",", "utf-8"), (301, "\r\n", ";", "utf-8"), (200, "\n", "|", "windows-1252"), (1, "\n", ",", "utf-8"), (40, "\n", ",", "utf-16")])
def test_quoted_lines_are_read_in_ranges(spark, tmp_path, n, end, delimiter, encoding):
    """As by Spark's reader in one task, but from many ranges, rows numbered in the file's order."""
    configure(spark)
    path = tmp_path / "q.csv"
    path.write_bytes(csv_text(random.Random(n), n, end, delimiter).encode(encoding))
    want = spark.read.options(header=True, sep=delimiter, escape='"', multiLine=True, inferSchema=True, encoding=encoding).csv(str(path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        if encoding == "utf-8" and n > 5:
            lines = csv.csv_lines.lines_of(spark, str(path), encoding)
            assert lines.rdd.getNumPartitions() > 10 and csv.csv_lines.quotes_of(lines, delimiter).any
        got = csv.read_csv(spark, str(path), encoding, delimiter)
        rows = [tuple(r) for r in got.orderBy(ROW_ID).select(*(f"`{c}`" for c in want.columns)).collect()]
        assert got.drop(ROW_ID).schema == want.schema and rows == [tuple(r) for r in want.collect()]
        assert sorted(r[0] for r in got.select(ROW_ID).collect()) == list(range(len(rows)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_without_open_quotes_go_to_the_reader(spark, tmp_path):
    """Several files, each with a header; no shuffle of lines, ids by file and line."""
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"f{k}.csv").write_text("id,name\n" + "".join(f'{k * 50 + i},"a, ""b"" {i}"\n' for i in range(50 - k)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = csv.read_csv(spark, str(tmp_path / "in"), "utf-8", ",")
        ids = column(got, "id")
        assert ids == sorted(ids) and len(ids) == 147 and column(got, "name")[1] == 'a, "b" 1' and got.schema["id"].dataType.simpleString() == "int"
        assert sorted(column(got, ROW_ID)) == list(range(147))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_scratch_tables_go_on_request(spark):
    outside = materialize(spark.range(5), "t")
    with Scratch(spark) as scratch:
        first, second = (materialize(spark.range(n), "t") for n in (3, 4))
        with Scratch(spark) as inner:
            third = materialize(spark.range(2), "t")
            assert inner.folder.startswith(scratch.folder)
        assert scratch.clear(keep=second) == 2 and second.count() == 4
    for gone in (first, third):
        with pytest.raises(Exception, match="exist"):
            gone.count()
    assert scratch_path(spark, "t").rpartition("/scrubjay-")[0] in outside.inputFiles()[0] and scratch.folder not in scratch_path(spark, "t")
    scratch.delete()
    assert outside.count() == 5 and scratch.clear() == 0


def test_runs_in_threads_keep_out_of_each_others_way(spark):
    """Each thread's run clears its own tables, while the other's are still read."""
    started, results = threading.Barrier(2), {}

    def run(n):
        with Scratch(spark) as scratch:
            df = materialize(spark.range(n), "a")
            started.wait()
            for step in range(4):
                df = materialize(df.withColumn("id", F.col("id") + 1), f"s{step}")
                scratch.clear(keep=df)
            results[n] = (df.agg(F.sum("id")).first()[0], scratch.clear(keep=df))
            scratch.delete()

    threads = [threading.Thread(target=run, args=(n,)) for n in (10, 20)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert results == {n: (n * (n - 1) // 2 + 4 * n, 0) for n in (10, 20)}


def test_typed_columns_are_tested_by_their_type(spark):
    df = frame(spark, "v double, n long, d date, b boolean, s string", [(1.0, 1, date(2024, 1, 2), True, "-"), (float("nan"), -200, None, None, " N/A "), (None, None, None, False, "x")])
    for markers in (MISSING_MARKERS, ("-200", "true"), ("2024-01-02",), ()):
        both = df.select(*(F.struct(missing_in(df, c, markers), is_missing(F.col(c), markers)) for c in ("v", "n", "d", "b", "s"))).collect()
        assert all(x[0] == x[1] for r in both for x in r), markers
    assert "CAST" not in str(missing_in(df, "v")) and "CAST" in str(missing_in(df, "v", ("-200",)))


def test_row_ids_are_dense_and_in_file_order(spark, tmp_path):
    from scrubjay.functions.columns import with_row_id

    (tmp_path / "big.csv").write_text("v\n" + "".join(f"{i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "big.csv"))
        assert df.rdd.getNumPartitions() > 3
        assert with_row_id(df).where(f"{ROW_ID} <> v").count() == 0 and with_row_id(df).count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert with_row_id(df.limit(0)).count() == 0


def test_sheets(spark):
    df = csv.frame_of(spark, [["a", None, "a", "n"], [1, "x"], [2, None, True, 1.5], [None, None, None, None]])
    assert df.columns == ["a", "column_2", "a_2", "n", ROW_ID] and df.count() == 2 and column(df, "n") == [None, 1.5]
    nan = frame(spark, "v double", [float("nan"), 1.0])
    assert column(csv.sanitized(nan), "v") == [None, 1.0]
    with pytest.raises(ValueError):
        csv.frame_of(spark, [[None]])
    for guard, data in ((excel.guard_xlsx, b"junk"), (excel.guard_xls, "_VBA_PROJECT".encode("utf-16-le"))):
        with pytest.raises(ValueError):
            guard(data)


def book_of(parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return data.getvalue()


def test_workbooks(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = f"""<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>when</t></is></c></row>
      <row r="3"><c r="A3"><v>7</v></c><c r="B3" t="b"><v>1</v></c><c r="C3" s="1"><v>45292.5</v></c><c r="D3" t="str"><f>A3</f><v>seven</v></c></row></sheetData></worksheet>"""
    source = book_of({
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>',
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="a"/><sheet name="Two &amp; 3" sheetId="2" r:id="b"/><sheet name="Gone" sheetId="3" r:id="c"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/><Relationship Id="c" Target="worksheets/sheet3.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><r><t>na</t></r><r><t>me</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": sheet,
        "xl/worksheets/sheet2.xml": sheet,
        "xl/worksheets/sheet3.xml": sheet,
    })
    want = [["name", None, "when", None], [None] * 4, [7, True, datetime(2024, 1, 1, 12), "seven"]]
    assert excel.sheets_xlsx(source) == {"One": want, "Two & 3": want, "Gone": want}
    (tmp_path / "in.xlsx").write_bytes(source)
    df = frame(spark, "a string, b double, c date, d long", [("x<&>", 1.5, date(2024, 1, 2), 3), ("=f()", None, None, 2**40)])
    path = excel.write_xlsx({"One": df, "New/1": df}, str(tmp_path / "out.xlsx"), str(tmp_path / "in.xlsx"), ["Gone"])
    back = excel.sheets_xlsx(open(path, "rb").read())
    table = [["a", "b", "c", "d"], ["x<&>", 1.5, "2024-01-02", 3], ["'=f()", None, None, 2**40]]
    assert list(back) == ["One", "Two & 3", "New_1"] and sorted(map(str, back["One"])) == sorted(map(str, table)) == sorted(map(str, back["New_1"]))
    assert zipfile.ZipFile(path).read("xl/worksheets/sheet2.xml") == sheet.encode() and back["Two & 3"] == want
    assert "xl/worksheets/sheet3.xml" not in zipfile.ZipFile(path).namelist()
    with pytest.raises(ValueError):
        excel.guard_xlsx(book_of({"xl/vbaProject.bin": "x"}))


def test_exports(spark, tmp_path):
    df = frame(spark, "a string, v double", [("=x", 1.0), (" +1", 2.0), ("ok", 999.0)])
    assert column(sinks.exported(df).withColumn(ROW_ID, F.col("v")), "a") == ["'=x", "' +1", "ok"]
    reasons = sinks.flag_reasons({"v": df.where("v > 100").select(ROW_ID)}, spark.createDataFrame([(2, 0), (0, 0)], f"{ROW_ID} long, group_id long"))
    assert {r.a: r["__flag_reason"] for r in sinks.flagged_records(df, reasons).collect()} == {"ok": "duplicate_group;outlier:v", "=x": "duplicate_group"}
    specs = [OperationSpec("drop_rows", "structures", {"row_ids": ["<b>"]})]
    page = sinks.html_report("T<", {"rows": 3}, specs)
    assert "<b>" not in page and "&lt;b&gt;" in page
    with pytest.raises(ValueError):
        sinks.gate(["open"], False)
    sinks.gate(["open"], True)
    sinks.bundle({"config.json": sinks.config_json(specs), "report.html": page}, str(tmp_path / "b.zip"))
    assert json.loads(sinks.config_json(specs))["operations"][0]["op_type"] == "drop_rows"


def test_script_replays(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,n\n x ,1\ny,2\n")
    specs = [OperationSpec("normalize", "normalization", {"columns": ["name"], "operations": ["trim"]}), OperationSpec("drop_rows", "structures", {"row_ids": [1]})]
    code = sinks.script(specs, {"encoding": "utf-8", "delimiter": ","}, columns=["name", "n"], rows=1)
    (tmp_path / "run.py").write_text(code)
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, str(tmp_path / "run.py"), str(tmp_path / "a.csv"), str(tmp_path / "out")], check=True, timeout=180, env=os.environ | {"PYTHONPATH": root}, capture_output=True)
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()] == [("x", "1")]


def test_an_export_reads_its_tables_once(spark, tmp_path, monkeypatch):
    """Gate, report and warnings go by the same figures until an operation is applied."""
    from scrubjay.assessments import keys

    read = []
    totals, summary = validate.change_totals, keys.key_summary
    monkeypatch.setattr(validate, "change_totals", lambda a, b: read.append("totals") or totals(a, b))
    for module in (keys, validate):
        monkeypatch.setattr(module, "key_summary", lambda *x: read.append("key") or summary(*x))
    project = Project(spark, str(tmp_path / "p"))
    item = project.add("t", frame(spark, "a string, b long", [("x", 1), (None, 2), ("x", 3)]))
    item.declare_key(["a"])
    project.export(["report"], acknowledged=True)
    assert project.warnings() and sorted(read) == ["key", "totals"]
    item.validate()["key"]["holds"] = None  # what is handed out is a copy
    assert item.validate()["key"]["holds"] is False
    item.apply("fill_null_constant", {"column": "a", "value": "y"}, "missingness")
    assert (item.validate()["cells_changed"], item.validate()["missing_after"], sorted(read)) == (1, 0, ["key", "key", "totals", "totals"])
    item.history.undo()
    assert (item.validate()["cells_changed"], item.validate()["missing_after"], len(read)) == (0, 1, 4)


@pytest.mark.parametrize("piece", [1, 2, 8])
def test_ranges_are_cut_into_pieces(spark, tmp_path, monkeypatch, piece):
    """Records over several pieces of a range; no task is dealt more pieces as the file grows."""
    lines_of = csv.csv_lines
    monkeypatch.setattr(lines_of, "PIECE_LINES", piece)
    monkeypatch.setattr(lines_of, "TASK_LINES", 4 * piece)
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", 'say "b"', "x\ny", '"\n\n",\n"', "p\nq\nr\ns\nt", ""])) for i in range(60)]
    path = tmp_path / "a.csv"
    path.write_text("n,t\n" + "".join(f'{i},"{t.replace(chr(34), chr(34) * 2)}"\n' if t else f"{i},\n" for i, t in rows))
    lines = lines_of.lines_of(spark, str(path), "utf-8")
    quotes = lines_of.quotes_of(lines, ",")
    assert quotes.any and quotes.pieces.agg(F.max("lines")).first()[0] <= piece and quotes.tasks == 1 + lines.count() // (4 * piece)
    found = csv.read_csv(spark, str(path), "utf-8", ",").orderBy(ROW_ID).collect()
    assert [(r[ROW_ID], r.n, r.t or "") for r in found] == [(k, i, t) for k, (i, t) in enumerate(rows)]
