"""Assessments, keys and duplicates on literal frames."""

from collections import Counter
import re

import pytest
from pyspark.sql import functions as F

from scrubjay.assessments import keys, profile, text, typing
from scrubjay.functions import stats
from scrubjay.operators import execute
from scrubjay.plans import catalogue, duplicates
from scrubjay.session import ROW_ID
from tests.helpers import frame


def test_missing(spark):
    df = frame(spark, "a long, b string, c string", [(1, "x", ""), (None, "N/A", "  "), (3, "y", "z")])
    assert {r.column: r.n_missing for r in profile.missing_counts(df).collect()} == {"a": 1, "b": 1, "c": 2}
    assert {r.marker: r.n for r in profile.marker_breakdown(df, "c").collect()} == {"blank": 2}
    out = {x["column"]: x for x in profile.missingness(frame(spark, "v double", [1.0, 1.0, 1.0, 1.0, 100.0, (None,)]))}
    assert out["v"]["recommended"] == "median" and out["v"]["n_missing"] == 1 and "leave" in out["v"]["methods"]
    assert profile.recommended("decimal", 10, 0.2) == "mean" and profile.recommended("string", 60, None) == "drop_column"
    groups = frame(spark, "g string, v long", [("a", 1), ("b", None), ("b", None)])
    assert [(r.g, r.n_rows) for r in profile.unimputable_groups(groups, "v", ["g"]).collect()] == [("b", 2)]


def test_profile(spark):
    df = frame(spark, "id long, num string, c string", [(i, str(i % 3) if i else "N/A", "k") for i in range(10)])
    rows = {r.column: r for r in profile.profile(df).collect()}
    assert rows["id"].is_unique_key and rows["id"].severity == "none"
    assert rows["num"].suspect_numeric and rows["num"].severity == "moderate" and rows["num"].n_unique == 3
    assert rows["c"].n_repeated == 9 and rows["c"].has_repeats
    assert profile.profile(df).first().column == "num"
    assert sorted(map(tuple, profile.profile(df, approximate=True).collect())) == sorted(map(tuple, profile.profile(df).collect()))
    empty = profile.profile(df.limit(0)).collect()
    assert {r.column: r.n_rows for r in empty} == {"id": 0, "num": 0, "c": 0}


def test_structure_and_names(spark):
    df = frame(spark, "a long, b string, c long, d string", [(1, None, 7, "x"), (2, None, 7, None)])
    found = profile.structures(df)
    assert found["empty_columns"] == ["b"] and found["constant_columns"] == ["c", "d"] and found["empty_rows"] == 0
    names = profile.column_names(df.select(F.col("a").alias("First Name"), F.col("b").alias("first  name"), F.col("c").alias("OK")))
    assert [x["proposed"] for x in names] == ["first_name", "first_name", "ok"] and "collision" in names[0]["problems"]
    chars = profile.special_chars(frame(spark, "a string", ["José@", "pri#ce#"]))
    assert {(r.char, r.n, tuple(r.samples)) for r in chars.collect()} == {("é", 1, ("José@",)), ("@", 1, ("José@",)), ("#", 2, ("pri#ce#",))}


def test_types(spark):
    infer = lambda kind, *values: typing.infer_column(frame(spark, f"a {kind}", list(values)), "a")
    zips = infer("string", "02139", "02140", "10001")
    assert zips["suggested"] == "string" and zips["identifier_detected"]
    day = infer("string", "01/02/2024", "03/04/2024")
    assert day["suggested"] == "date" and day["ambiguous_date_format"]
    assert not infer("string", "01/02/2024", "13/04/2024")["ambiguous_date_format"]
    assert infer("string", "yes", "No", "n/a")["suggested"] == "boolean"
    assert infer("string", *["1", "2"] * 20, "x")["suggested"] == "integer"
    assert infer("string", "1.5", "2,5")["suggested"] == "decimal"
    assert infer("string", "2024-01-01 10:00:00", "2024-01-02 11:30:00")["suggested"] == "datetime"
    assert infer("string", "18.00.00", "19.30.00")["suggested"] == "time"
    assert infer("string", *["red", "blue"] * 10)["suggested"] == "categorical"
    assert infer("string", *(f"word {i}" for i in range(20)))["suggested"] == "string"
    assert infer("string", (None,), "")["suggested"] == "string"
    assert infer("boolean", True)["suggested"] == "boolean" and infer("double", 1.0)["suggested"] == "decimal"


def test_text(spark):
    df = frame(spark, "a string", [" x", "Foo", "foo ", "FOO", "a  b", "it’s", (None,)])
    counts = {r.change: r.n for r in text.normalization_counts(df).collect()}
    assert counts["trim"] == 2 and counts["collapse_spaces"] == 1 and counts["standardize_punctuation"] == 1 and counts["lower"] == 2
    (row,) = text.label_variants(df, "a").collect()
    assert (row.key, row.canonical, list(row.variants)) == ("foo", "foo ", ["FOO", "Foo", "foo "])
    kinds = {(x["column"], x["kind"]) for x in text.format_candidates(frame(spark, "b string, p string, c string, d string", [("Yes", "10%", "$1,200", "1.234,5"), ("n", "5%", "€50", "2,6")]))}
    assert kinds == {("b", "boolean"), ("p", "percent"), ("c", "currency"), ("d", "decimal_separator")}
    found = text.invalid_values(frame(spark, "a long", [25, -3, 40, 999]), "a", {"type": "range", "min": 0, "max": 120})
    assert found["n_invalid"] == 2 and found["examples"] == [-3, 999] and found["invalid_pct"] == 50.0


def test_patterns_and_units(spark):
    mails = frame(spark, "a string", ["a@b.co", "x y", "", "ü@b.de"])
    assert text.pattern_fit(mails, "a", "email") == {"column": "a", "n_matching": 2, "n_other": 1, "samples": ["x y"]}
    assert text.pattern_fit(mails, "a", "x")["n_matching"] == 0
    for bad in ("(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", r"(a)\1", "a" * 301, "(?P<x>a)", r"[(](?=x)", r"(?P<x>a)(?P=x)"):
        with pytest.raises(ValueError):
            text.compiled_pattern(bad)
    for good in (r"\(?=a", "[(?=a)]", r"[]\1]", r"(?:ab)+", "(?i)x", r"a\\1"):
        text.compiled_pattern(good)
    found = text.units(frame(spark, "a string", ["5kg", "10 lb", "€100", "USD 50", "25%", "junk", "7"]), "a")
    groups = {g["unit"]: g for g in found["groups"]}
    assert groups["kg"]["position"] == "suffix" and groups["€"]["position"] == "prefix" and groups["usd"]["is_currency"]
    assert groups["kg"]["factors"]["lb"] == 2.20462 and groups["kg"]["samples"] == ["5kg"] and found["n_unmatched"] == 1 and found["n_plain"] == 1
    assert text.units(frame(spark, "a double", [0.2, 0.3, 20.0, 30.0] * 3), "a")["scale"]["possible_mixed_scale"]


def test_keys(spark):
    rows = [("1", "a", None), ("1", "a", None), ("2", "x", "p"), ("2", "y", "p"), ("00417", "q", "r"), ("417", "q", "r"), ("n/a", "z", "z"), (None, "z", "z"), ("3", "m", None), ("3", "m", "v")]
    df = frame(spark, "id string, name string, other string", rows)
    assert keys.key_summary(df, ["id"]).first().asDict() == {"total_rows": 10, "missing_rows": 2, "identical_groups": 1, "conflicting_groups": 2, "unique_rows": 2}
    assert keys.key_conflicts(df, ["id"]) == [
        {"key": {"id": "2"}, "n_rows": 2, "conflicts": ["name"], "values": {"name": ["x", "y"]}},
        {"key": {"id": "3"}, "n_rows": 2, "conflicts": ["other"], "values": {"other": [None, "v"]}},
    ]
    assert keys.missing_key_rows(df, ["id"]).count() == 2
    with pytest.raises(ValueError):
        keys.key_summary(df, [])


def test_exact_duplicates(spark):
    df = frame(spark, "a string, b long", [("x", 1), ("y", 1), ("x", 1), (None, 2), ("N/A", 2), ("y", 3)])
    groups = {(r.group_id, r.n_rows) for r in duplicates.exact_groups(df, ["a", "b"]).collect()}
    assert groups == {(0, 2), (3, 2)}
    assert sorted(tuple(r) for r in duplicates.exact_members(df, ["a", "b"]).collect()) == [(0, 0), (2, 0), (3, 3), (4, 3)]
    assert duplicates.exact_summary(df, ["a", "b"]).first().asDict() == {"duplicate_groups": 2, "affected_rows": 4, "proposed_removals": 2, "resulting_rows": 4}
    keep = lambda how: sorted(r[0] for r in duplicates.resolve(df, ["b"], how).select(ROW_ID).collect())
    assert keep("keep_first") == [0, 3, 5] and keep("keep_last") == [2, 4, 5] and len(keep("keep_all")) == 6
    done = execute(df, "resolve_duplicates", {"columns": ["a", "b"], "how": "keep_first"})
    assert sorted(r[0] for r in done.select(ROW_ID).collect()) == [0, 1, 3, 5]
    full = frame(spark, "k long, v string, w string", [(1, None, None), (1, "a", None), (1, "b", "c")])
    assert [r[0] for r in duplicates.resolve(full, ["k"], "keep_most_complete").select(ROW_ID).collect()] == [2]


def test_formats_are_tried_once_a_value(spark, monkeypatch):
    tried = spark.sparkContext.accumulator(0)

    def count(v):
        tried.add(1)
        return 1

    df = spark.range(2000, numPartitions=2).selectExpr("id AS __rid", "'2024-01-0' || (1 + id % 5) AS a", "CASE WHEN id % 2 = 0 THEN 'N/A' ELSE '0' || (id % 3) || '.01.2024' END AS b")
    assert {c: (x["format"], x["n"], x["n_misfits"]) for c, x in typing.column_formats(df, ["a", "b"]).items()} == {"a": ("%Y-%m-%d", 2000, 0), "b": ("%d.%m.%Y", 1000, 333)}
    monkeypatch.setattr(typing, "format_mask", lambda c: F.udf(count, "long")(c))
    assert typing.column_formats(df, ["a", "b"])["a"]["n"] == 2000
    assert 0 < tried.value <= 9


def test_all_unimputable_groups(spark, tmp_path):
    """More groups than a report of 10,000 had."""
    spark.range(80_000).selectExpr("id AS o_orderkey", "id AS o_custkey", "'F' AS o_orderstatus", "1.5D AS o_totalprice", "DATE '2024-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    found = catalogue.queries()["unimputable_groups"](spark, str(tmp_path))
    expected = [i for i in range(80_000) if i % 7 == 0 or i % 10 == 3]
    assert [(r.customer, r.n_rows, r.n_observed) for r in found.collect()] == [(i, 1, 0) for i in expected]


def brute_pairs(rows, need, block=()):
    norm = lambda v: None if v is None or (isinstance(v, str) and v.strip().lower() in ("n/a", "")) else v
    out = set()
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            matches = sum(norm(x) == norm(y) for i, (x, y) in enumerate(zip(rows[a], rows[b], strict=True)) if i not in block)
            if matches >= need and all(norm(rows[a][i]) == norm(rows[b][i]) for i in block):
                out.add((a, b, matches))
    return out


@pytest.mark.parametrize("partitions", [1, 4])
def test_near_duplicates(spark, partitions):
    import random

    rng = random.Random(1)
    rows = [tuple(rng.choice(["p", "q", "r", None, "N/A"]) for _ in range(5)) for _ in range(60)]
    df = frame(spark, "c1 string, c2 string, c3 string, c4 string, c5 string", rows, partitions)
    columns = [f"c{i}" for i in range(1, 6)]
    pairs = duplicates.near_pairs(df, columns, [], 80)
    assert {tuple(r) for r in pairs.collect()} == brute_pairs(rows, 4)
    blocked = duplicates.near_pairs(df, columns[1:], ["c1"], 80)
    assert {tuple(r) for r in blocked.collect()} == brute_pairs(rows, 4, (0,))
    found = duplicates.near_summary(df, pairs)
    assert found["qualifying_pairs"] == len(brute_pairs(rows, 4)) and found["resulting_rows"] == 60 - found["affected_rows"]
    members = duplicates.clusters(df, pairs, columns).collect()
    assert {r.score_pct for r in members} <= {80, 100} and all((r.score_pct == 100) == (len(r.differing) == 0) and sorted(r.matching + r.differing) == columns for r in members)
    assert duplicates.cluster_sizes(pairs).agg(F.sum("n_members")).first()[0] == len(members)


def test_classes_say_what_pairs_say(spark):
    rows = [("p", "q", "r", "s", "t")] * 30 + [("p", "q", "r", "s", "u")] * 20 + [("z", "q", "r", "s", "u"), (None, "N/A", "r", "s", "u")]
    df = frame(spark, "c1 string, c2 string, c3 string, c4 string, c5 string", rows)
    columns = [f"c{i}" for i in range(1, 6)]
    members = {r[ROW_ID]: r.class_id for r in duplicates.class_members(df, columns).collect()}
    links = {(r.a, r.b): r.matches for r in duplicates.class_pairs(df, columns).collect()}
    assert links == {(0, 30): 4, (30, 50): 4}
    pairs = {(a, b, 5 if members[a] == members[b] else links[members[a], members[b]]) for a in range(52) for b in range(a + 1, 52) if members[a] == members[b] or (members[a], members[b]) in links}
    assert pairs == brute_pairs(rows, 4)


@pytest.mark.parametrize("k, threshold, most", [(5, 80, 32), (10, 80, 32), (10, 80, 6), (12, 90, 32), (11, 80, 3), (4, 100, 32)])
def test_signatures_find_all_pairs(spark, monkeypatch, k, threshold, most):
    import random

    rng = random.Random(k)
    base = [rng.choice("pqr") for _ in range(k)]
    rows = [tuple(rng.choice(["p", "q", None]) if rng.random() < 0.15 else v for v in base) for _ in range(40)]
    columns = [f"c{i}" for i in range(k)]
    df = frame(spark, ", ".join(f"{c} string" for c in columns), rows)
    monkeypatch.setattr(duplicates.groups_of, "__defaults__", (most,))
    need = duplicates.need_of(threshold, k)
    groups, g = duplicates.groups_of(df, columns, need)
    assert sorted(c for group in groups for c in group) == sorted(columns) and len(groups) == k - need + g
    got = duplicates.near_pairs(df, columns, [], threshold)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_pairs(rows, need))
    blocked = duplicates.near_pairs(df, columns[1:], [columns[0]], threshold)
    assert {tuple(r) for r in blocked.collect()} == {(a, b, m) for a, b, m in brute_pairs([r[1:] for r in rows], duplicates.need_of(threshold, k - 1)) if (rows[a][0] or "") == (rows[b][0] or "")}


@pytest.mark.parametrize("threshold", [90, 100])
def test_a_constant_column_costs_nothing(spark, threshold):
    """Rows that meet in the join are as many as the estimate says: none here, and copies where there are some."""
    for n, copies in ((2000, 0), (20_000, 7)):
        rows = spark.range(n).selectExpr("id AS __rid", "'same' AS a", f"CASE WHEN id < {2 * copies} THEN id div 2 ELSE id END AS b")
        found = duplicates.estimate(rows, ["a", "b"], [], threshold)
        assert (found["joined_pairs"], found["blocked"]) == (copies, False)
        assert duplicates.candidates(rows, ["a", "b"], [], 2).count() == copies == duplicates.near_pairs(rows, ["a", "b"], [], threshold).count()
        assert duplicates.near_pairs(rows, ["b"], ["a"], threshold).count() == copies


@pytest.mark.parametrize("threshold", [80, 100])
def test_clusters_by_lists(spark, monkeypatch, threshold):
    """Lists of two rows: a group runs over several of them, and over several tasks."""
    import random

    monkeypatch.setattr(duplicates, "MOST_LISTED", 2)
    rng = random.Random(3)
    rows = [tuple(rng.choice(["p", "q", None, "N/A"]) if rng.random() < 0.3 else "p" for _ in range(5)) for _ in range(60)]
    df = frame(spark, "c1 string, c2 string, c3 string, c4 string, c5 string", rows, 4)
    columns = [f"c{i}" for i in range(1, 6)]
    need = duplicates.need_of(threshold, 5)
    pairs = duplicates.near_pairs(df, columns, [], threshold)
    assert sorted(tuple(r) for r in pairs.collect()) == sorted(brute_pairs(rows, need))
    key = lambda r: (r.representative, r.member, r.score_pct, tuple(r.matching), tuple(r.differing))
    found = duplicates.cluster_members(duplicates.cluster_lists(df, columns, [], threshold))
    assert sorted(map(key, found.collect())) == sorted(map(key, duplicates.clusters(df, pairs, columns).collect()))
    shown = duplicates.cluster_members(duplicates.cluster_lists(df, columns[:3], ["c5"], 100, ["c4"])).collect()
    assert {(r.representative, r.member) for r in shown} == {p for a, b, _ in brute_pairs([(*r[:3], r[4]) for r in rows], 4) for p in ((a, b), (b, a))}
    assert {(len(r.matching), len(r.differing)) for r in shown} == {(1, 0), (0, 1)}


@pytest.mark.parametrize("threshold", [80, 100])
def test_links_are_counted_without_pairs(spark, threshold):
    import random

    rng = random.Random(4)
    rows = [tuple(rng.choice(["p", "q", None, "N/A"]) if rng.random() < 0.4 else "p" for _ in range(5)) for _ in range(60)]
    df = frame(spark, "c1 string, c2 string, c3 string, c4 string, c5 string", rows)
    columns = [f"c{i}" for i in range(1, 6)]
    for own, blocking in ((columns, []), (columns, ["c1"])):
        expected = duplicates.cluster_sizes(duplicates.near_pairs(df, own, blocking, threshold)).collect()
        assert expected and duplicates.linked(df, own, blocking, threshold).collect() == expected


def parts_of_a_kind(spark, path, n):
    """``n`` parts alike but for their ids; two of three are without a type."""
    spark.range(n).selectExpr("id AS p_partkey", "'b' AS p_brand", "'t' AS p_type", "1 AS p_size", "CAST(id AS STRING) AS p_name").write.parquet(f"{path}/part.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["dup_cluster_columns", "dup_clusters"])
def test_pairs_are_joined_with_nothing(spark, tmp_path, name):
    found = catalogue.queries()[name](spark, parts_of_a_kind(spark, tmp_path, 900))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert found.count() == sum(n * (n - 1) for n in (300, 600))


@pytest.mark.parametrize("name", ["dup_cluster_columns", "dup_clusters", "dup_near_blocked"])
def test_pairs_are_made_where_lists_meet(spark, tmp_path, name):
    """Behind the join nothing is shuffled, and before it lists are dealt out once, by their cells."""
    found = catalogue.queries()[name](spark, parts_of_a_kind(spark, tmp_path, 90))
    plan = found._jdf.queryExecution().executedPlan().toString()
    join = re.search(r"SortMergeJoin \[x_s#\w+, x_h#\w+, x_row#\w+, x_column#\w+\]", plan)
    assert join and "Exchange" not in plan[: join.start()]
    assert plan.count("REPARTITION_BY_NUM") == 2 and plan.count("Exchange") == plan.count("Exchange hashpartitioning(s#") + plan.count("Exchange hashpartitioning(c0#") + plan.count("Exchange rangepartitioning(")


@pytest.mark.parametrize("threshold", [80, 100])
def test_a_large_group_is_cut_into_cells(spark, monkeypatch, threshold):
    """Any two lists of a group meet in one of its cells; a group of few rows is one cell."""
    monkeypatch.setattr(duplicates, "MOST_LISTED", 2)
    monkeypatch.setattr(duplicates, "CELL_ROWS", 8)
    rows = [("p", "q", "r", "s", str(i % 2) if i < 50 else "u") for i in range(70)] + [(None, "N/A", "r", "s", "t")] * 3
    df = frame(spark, "c1 string, c2 string, c3 string, c4 string, c5 string", rows, 4)
    columns = [f"c{i}" for i in range(1, 6)]
    lists = duplicates.listed(duplicates.prepared(df, columns), columns, [])
    x, y = (side.collect() for side in duplicates.celled(duplicates.signed(lists, [[c] for c in ("c0", "c1", "c2", "c3")], 4, [])))
    assert sorted(Counter(i for r in x for i in r.ids).items()) == [(i, 9 if i < 70 else 1) for i in range(73)]  # 70 rows of a kind: 9 cells a side
    cells = {}
    for r in y:
        cells.setdefault((r.h, r.row, r.column), []).extend(r.ids)
    assert max(map(len, cells.values())) < 35
    meet = Counter((a, b) for r in x for a in r.ids for b in cells.get((r.h, r.row, r.column), []))
    assert set(meet.values()) == {1} and len(meet) == 70 * 70 + 3 * 3
    pairs = sorted(brute_pairs(rows, duplicates.need_of(threshold, 5)))
    assert sorted(tuple(r) for r in duplicates.near_pairs(df, columns, [], threshold).collect()) == pairs
    members = duplicates.cluster_members(duplicates.cluster_lists(df, columns, [], threshold)).collect()
    assert sorted((r.representative, r.member, len(r.matching)) for r in members) == sorted(p for a, b, m in pairs for p in ((a, b, m), (b, a, m)))


def test_sizes_beyond_the_guard(spark, tmp_path):
    """40 million pairs."""
    sizes = catalogue.queries()["dup_cluster_sizes"](spark, parts_of_a_kind(spark, tmp_path, 12_000))
    assert {tuple(r) for r in sizes.groupBy("n_members").count().collect()} == {(n - 1, n) for n in (4000, 8000)}


def test_blocked_pairs_beyond_the_guard(spark, tmp_path):
    found = catalogue.queries()["dup_near_blocked"](spark, parts_of_a_kind(spark, tmp_path, 12_000))
    assert found.count() == sum(n * (n - 1) // 2 for n in (4000, 8000))


def test_guard_goes_by_the_join(spark):
    rows = spark.range(9000).selectExpr("id AS __rid", "'x' AS a", "'y' AS b")
    with pytest.raises(ValueError):
        duplicates.near_pairs(rows, ["a", "b"], [], 100)
    assert duplicates.class_pairs(rows, ["a", "b"], [], 100).count() == 0


def test_estimates(spark):
    df = frame(spark, "a string", ["x"] * 10 + ["y"] * 5)
    found = duplicates.estimate(df, ["a"], [], 80)
    assert found["candidate_pairs"] == 55 and not found["warning"]
    assert duplicates.attainable(2) == [0, 50, 100]
    with pytest.raises(ValueError):
        duplicates.estimate(df, ["a"], [], 70)
    with pytest.raises(ValueError):
        duplicates.estimate(df, ["zz"])


def test_format_masks_are_those_of_strptime(spark):
    import random

    from scrubjay.assessments.typing import FORMATS, _fits

    rng = random.Random(8)
    two = lambda top: rng.choice([str(rng.randrange(top)), f"{rng.randrange(top):02d}"])
    values = ["", "x", "12", "2024-02-30", "29/02/2023", "31-04-2024", "3 Feb 2024", "March 5, 2024", "2024-01-02T03:04:05.5", "2024-01-02T03:04:05.1234567", "12:60:00", "99-01-2024"]
    for _ in range(400):
        a, b, y, sep = two(33), two(14), rng.choice(["2024", "1999", "24", "0007"]), rng.choice("-/.")
        day = rng.choice([f"{y}{sep}{b}{sep}{a}", f"{a}{sep}{b}{sep}{y}", f"{b}{sep}{a}{sep}{y}", f"{a} {rng.choice(['Jan', 'Dec', 'Foo'])} {y}", f"{rng.choice(['May', 'June'])} {a}, {y}"])
        time = rng.choice(["", "", f" {two(25)}:{two(61)}", f" {two(25)}:{two(61)}:{two(61)}", f"T{two(25)}:{two(60)}:{two(60)}", f"T{two(25)}:{two(60)}:{two(60)}.{rng.randrange(10 ** 6)}"])
        values += [day + time, rng.choice([f"{two(25)}.{two(61)}.{two(61)}", f"{two(25)}:{two(61)}"])]
    rows = frame(spark, "a string", values).select("a", typing.format_mask(F.col("a")).alias("m")).collect()
    wrong = [(r.a, [FORMATS[b] for b in range(len(FORMATS)) if bool(r.m >> b & 1) != (any(c.isdigit() for c in r.a) and _fits(r.a, FORMATS[b][0]))]) for r in rows]
    odd = [(v, x) for v, x in wrong if x and not v.startswith("0007") and "0007" not in v and ":60" not in v and ".60" not in v and not v.endswith("60")]  # strptime takes a leap second
    assert not odd, odd[:5]


def test_formats_by_all_values(spark):
    """What the first 300 values don't show: most values are written month first, some not at all."""
    values = ["03/04/2024"] * 320 + ["04/25/2024"] * 700 + ["soon", "later", None, "N/A"] * 5
    df = frame(spark, "d string, t string", [(v, f"{i % 24}:{i % 60:02d}") for i, v in enumerate(values)])
    found = typing.column_formats(df, ["d", "t"])
    assert found["d"] == {"kind": "date", "format": "%m/%d/%Y", "n": 1030, "n_misfits": 10, "misfits": ["later", "soon"], "ambiguous": False}
    assert found["t"]["format"] == "%H:%M" and found["t"]["n_misfits"] == 0
    whole, first = (typing.infer_columns(df, ["d"], whole=w)["d"] for w in (True, False))
    assert (whole["date_format"], whole["ambiguous_date_format"], whole["incompatible_count"]) == ("%m/%d/%Y", False, 10)
    assert first["ambiguous_date_format"] and typing.column_formats(df, []) == {}


def test_sketches(spark):
    """Estimates are within the error that the decisions allow for, of parts put together too, and small columns exact."""
    df = spark.range(300_000).selectExpr("id AS __rid", "CAST(id % 40 AS STRING) AS few", "CAST(id % 120000 AS STRING) AS many", "CASE WHEN id % 3 = 0 THEN CAST(id AS STRING) END AS some")
    values = {c: F.col(c) for c in ("few", "many", "some")}
    want = {"few": (300_000, 40), "many": (300_000, 120_000), "some": (100_000, 100_000)}
    parts = [stats.distinct_sketches(df.where(f"pmod(hash(__rid), 3) = {k}"), values) for k in range(3)]
    for found in (stats.estimates(stats.distinct_sketches(df, values)), stats.estimates(stats.merged_sketches(*parts))):
        assert found["few"] == want["few"] and all(found[c][0] == want[c][0] and abs(found[c][1] / want[c][1] - 1) < stats.SKETCH_ERROR for c in want)
    assert stats.distinct_counts(df, values) == {c: d for c, (_, d) in want.items()}
    assert stats.estimates(stats.distinct_sketches(df.limit(0), values)) == dict.fromkeys(values, (0, 0))


def test_columns_next_to_a_limit_are_counted(spark, monkeypatch):
    counted = []
    real = stats.distinct_counts
    monkeypatch.setattr(stats, "distinct_counts", lambda df, values: counted.append(sorted(values)) or real(df, values))
    df = frame(spark, "a string, b string, c string", [(f"v{i % 50}", f"w{i % 51}", f"u{i % 7}") for i in range(400)])
    found = typing.infer_columns(df, ["a", "b", "c"])
    assert {c: x["suggested"] for c, x in found.items()} == {"a": "categorical", "b": "string", "c": "categorical"} and counted == [["a", "b"]]


def test_special_characters_shuffle_no_texts(spark):
    long = "x" * 50_000
    rows = [f"{long}{i}#" for i in range(30)] + ["a#b#", "a#b#", "c~#", None]
    found = profile.special_chars(frame(spark, "note string", rows[::-1]), samples=2).collect()
    got = {r.char: (r.n, r.samples) for r in found}
    assert got == {"#": (35, ["c~#", "a#b#"]), "~": (1, ["c~#"])}


def test_smallest_values_of_each_key(spark):
    rows = [("a", v) for v in "dbbcaacd"] + [("b", "x")] * 5 + [(None, "q"), (None, None), ("c", None)]
    got = stats.smallest(frame(spark, "u string, v string", rows), "u", "v", 3).collect()
    assert sorted(((r.u or "-", r.v) for r in got)) == [("-", "q"), ("a", "a"), ("a", "b"), ("a", "c"), ("b", "x")]
