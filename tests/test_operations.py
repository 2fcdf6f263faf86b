"""Each operation on literal frames."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from scrubjay.operators import REGISTRY, execute
from scrubjay.session import ROW_ID
from tests.helpers import column, frame


def run(df, op, name, **params):
    return column(execute(df, op, {"column": name, **params}), name)


def test_registry():
    assert len(REGISTRY) == 16  # the 15 operations, and resolutions of duplicates
    with pytest.raises(ValueError):
        execute(None, "nothing", {})


def test_renames_and_drops(spark):
    df = frame(spark, "`a.b` long, b long", [(1, 2), (3, 4)])
    assert execute(df, "rename_columns", {"mapping": {"a.b": "b", "b": "a.b"}}).columns == [ROW_ID, "b", "a.b"]
    assert column(execute(df, "rename_column", {"from": "a.b", "to": "PT08.S1(CO)"}), "PT08.S1(CO)") == [1, 3]
    with pytest.raises(ValueError):
        execute(df, "rename_column", {"from": "a.b", "to": "b"})
    assert column(execute(df, "drop_rows", {"row_ids": [0, 77]}), "b") == [4]
    assert column(execute(df, "drop_rows", {"row_ids": list(range(5000, 9000)) + [1]}), "b") == [2]
    assert execute(df, "drop_column", {"column": "a.b"}).columns == [ROW_ID, "b"]
    with pytest.raises(ValueError):
        execute(df, "drop_column", {"column": "zz"})
    assert run(frame(spark, "a string", [(None,), ("N/A",)]), "fill_null_constant", "a", value="x") == ["x", "N/A"]


def test_special_chars(spark):
    df = frame(spark, "a string", ["José@", "pri#ce", "ok", (None,)])
    assert run(df, "clean_special_chars", "a", chars=["@", "#"], action="strip") == ["José", "price", "ok", None]
    assert run(df, "clean_special_chars", "a", chars=["@", "#"], action="blank") == [None, None, "ok", None]
    assert run(df, "clean_special_chars", "a", chars=["@"], action="replace", replacement="$0") == ["José$0", "pri#ce", "ok", None]
    with pytest.raises(ValueError):
        run(df, "clean_special_chars", "a", chars=[])


def test_statistics_for_missing(spark):
    x = frame(spark, "a double", [1.0, (None,), 3.0, 3.0])
    assert run(x, "treat_missing", "a", method="mean")[1] == pytest.approx(7 / 3)
    assert run(x, "treat_missing", "a", method="median")[1] == 3.0
    s = frame(spark, "a string", ["x", (None,), "x", "y", "n/a"])
    assert run(s, "treat_missing", "a", method="mode") == ["x", "x", "x", "y", "x"]
    ages = frame(spark, "a string", ["30", "-5", " 31 ", "2,6", "N/A", "word"])
    assert run(ages, "treat_missing", "a", method="median")[4] == "16.3"
    assert run(frame(spark, "a long", [1, (None,), 4]), "treat_missing", "a", method="mean") == [1, 2, 4]
    with pytest.raises(ValueError):
        run(s, "treat_missing", "a", method="mean")
    with pytest.raises(ValueError):
        run(frame(spark, "a long", [1, (None,)]), "treat_missing", "a", method="constant", value="word")
    assert run(frame(spark, "a long", [1, (None,)]), "treat_missing", "a", method="constant", value="7") == [1, 7]
    assert run(s, "treat_missing", "a", method="drop_rows") == ["x", "x", "y"]
    assert "a" not in execute(s, "treat_missing", {"column": "a", "method": "drop_column"}).columns


@pytest.mark.parametrize("bucket", [1_000_000, 3])
@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_fills_and_interpolation(spark, bucket, partitions):
    df = frame(spark, "a double, t int", [(10.0, 3), (None, 1), (30.0, 2)], partitions)
    assert run(df, "treat_missing", "a", method="forward_fill", order_by="t", rows_per_bucket=bucket) == [10.0, None, 30.0]
    assert run(df, "treat_missing", "a", method="backward_fill", order_by="t", rows_per_bucket=bucket) == [10.0, 30.0, 30.0]
    values = [None, 0.0, None, None, 6.0, None, None, None, None, None, None, 18.0, None]
    df = frame(spark, "a double", [(v,) for v in values], partitions)
    assert run(df, "treat_missing", "a", method="interpolate_linear", rows_per_bucket=bucket) == pytest.approx([None, 0, 2, 4, 6, *(6 + 12 * i / 7 for i in range(1, 7)), 18, None])
    assert run(df, "treat_missing", "a", method="forward_fill", rows_per_bucket=bucket) == [None, 0, 0, 0, 6, 6, 6, 6, 6, 6, 6, 18, 18]
    times = frame(spark, "a double, t timestamp_ntz", [(0.0, datetime(2024, 1, 1)), (None, datetime(2024, 1, 2)), (4.0, datetime(2024, 1, 5))], partitions)
    assert run(times, "treat_missing", "a", method="interpolate_time", order_by="t", rows_per_bucket=bucket) == [0.0, 1.0, 4.0]


def test_group_impute_and_random(spark):
    df = frame(spark, "salary double, dept string", [(100.0, "a"), (None, "a"), (300.0, "b"), (None, "b"), (None, None), (None, "c")])
    assert run(df, "treat_missing", "salary", method="group_impute", group_by=["dept"]) == [100.0, 100.0, 300.0, 300.0, None, None]
    text = frame(spark, "salary string, dept string", [("10", "a"), ("n/a", "a"), ("x", "a")])
    assert run(text, "treat_missing", "salary", method="group_impute", group_by=["dept"], statistic="mean") == ["10", "10.0", "x"]
    modes = frame(spark, "v string, dept string", [("p", "a"), ("q", "a"), (None, "a")])
    assert run(modes, "treat_missing", "v", method="group_impute", group_by=["dept"], statistic="mode") == ["p", "q", "p"]
    draws = [run(frame(spark, "a long", [1, 2, (None,), 5, (None,)], p), "treat_missing", "a", method="random_sample", seed=3) for p in (1, 5)]
    assert draws[0] == draws[1] and {draws[0][2], draws[0][4]} <= {1, 2, 5}
    assert run(frame(spark, "a long", [(None,)]), "treat_missing", "a", method="random_sample") == [None]


def test_convert(spark):
    df = frame(spark, "a string", ["1", "x", "1,200", " 7 ", "1d", "2.5", (None,), "-3"])
    assert run(df, "convert_type", "a", target_type="integer") == [1, None, 1200, 7, None, None, None, -3]
    assert run(df, "convert_type", "a", target_type="decimal") == [1.0, None, 1200.0, 7.0, None, 2.5, None, -3.0]
    assert run(frame(spark, "a string", ["Yes", "f", "maybe"]), "convert_type", "a", target_type="boolean") == [True, False, None]
    dates = frame(spark, "a string", ["2024-01-05", "1/2/2024", "bad", "24-01-01"])
    assert run(dates, "convert_type", "a", target_type="date") == [date(2024, 1, 5), date(2024, 2, 1), None, None]
    assert run(dates, "convert_type", "a", target_type="date", format="%m/%d/%Y") == [None, date(2024, 1, 2), None, None]
    stamps = frame(spark, "a string", ["2024-01-05 10:20:30", "2024-01-05T10:20:30.25", "05/01/2024 10:20", "x"])
    assert run(stamps, "convert_type", "a", target_type="datetime") == [datetime(2024, 1, 5, 10, 20, 30), datetime(2024, 1, 5, 10, 20, 30, 250000), datetime(2024, 1, 5, 10, 20), None]
    assert run(frame(spark, "a string", ["18.00.00", "7:05", "x"]), "convert_type", "a", target_type="time") == ["18:00:00", "07:05:00", None]
    assert run(frame(spark, "a double", [2.9, (None,)]), "convert_type", "a", target_type="integer") == [2, None]
    assert run(frame(spark, "a double", [30.0, 1e7, 0.5]), "convert_type", "a", target_type="string") == ["30.0", "10000000.0", "0.5"]
    kept = execute(frame(spark, "a string", ["x"]), "convert_type", {"column": "a", "target_type": "categorical"})
    assert kept.schema["a"].metadata == {"logical": "categorical"}
    with pytest.raises(ValueError):
        execute(kept, "clean_pattern", {"column": "a", "action": "pad", "length": 3})


def test_normalize(spark):
    df = frame(spark, "a string, n long", [("  Hello  World ", 1), ("Foo\n\tBar", 2), (" ", 3), ("“It’s” – so…", 4), (None, 5)])
    steps = lambda *s: column(execute(df, "normalize", {"columns": ["a", "n"], "operations": list(s)}), "a")
    assert steps("trim", "collapse_spaces", "lower")[:2] == ["hello world", "foo\n\tbar"]
    assert steps("strip_linebreaks")[1] == "Foo Bar"
    assert steps("empty_to_null")[2] is None
    assert steps("standardize_punctuation")[3] == '"It\'s" - so...'
    assert steps("trim", {"op": "map_values", "mapping": {"Hello  World": "hw"}})[0] == "hw"
    assert steps({"op": "map_values", "mapping": {"  Hello  World ": "hw"} | {str(i): "x" for i in range(300)}})[0] == "hw"
    assert column(execute(frame(spark, "a string", ["hello-world o'NEIL"]), "normalize", {"columns": ["a"], "operations": ["title"]}), "a") == ["Hello-World O'Neil"]
    with pytest.raises(ValueError):
        steps("shout")


def test_mask(spark):
    ages = frame(spark, "a long", [25, -3, 40, 999, (None,)])
    assert run(ages, "mask_values", "a", rule={"type": "range", "min": 0, "max": 120}) == [25, None, 40, None, None]
    text = frame(spark, "a string, b string", [("5", "4"), ("x", "1"), (None, "2"), ("2024-01-05", "2023-01-01")])
    assert run(text, "mask_values", "a", rule={"type": "not_in", "values": ["5", "x"]}) == ["5", "x", None, None]
    assert run(text, "mask_values", "a", rule={"type": "unparseable_numeric"}) == ["5", None, None, None]
    assert run(text, "mask_values", "a", rule={"type": "unparseable_date"}) == [None, None, None, "2024-01-05"]
    assert run(text, "mask_values", "a", rule={"type": "contains", "text": "-01"}) == [None, None, None, "2024-01-05"]
    assert run(text, "mask_values", "a", rule={"type": "cmp", "op": "lt", "other_column": "b"}) == [None, "x", None, "2024-01-05"]
    assert run(text, "mask_values", "a", rule={"type": "cmp", "op": "gt", "value_kind": "date", "value": "2024-06-01"}) == ["5", "x", None, None]
    assert run(text, "mask_values", "a", rule={"type": "date_range", "min": "2024-01-01"}) == [None, None, None, "2024-01-05"]
    with pytest.raises(ValueError):
        run(text, "mask_values", "a", rule={"type": "odd"})


def test_formats(spark):
    flags = frame(spark, "a string", ["Yes", "No", "Y", "?"])
    assert run(flags, "standardize_format", "a", kind="boolean") == [True, False, True, None]
    assert run(flags, "standardize_format", "a", kind="boolean", representation="one_zero") == ["1", "0", "1", None]
    assert run(frame(spark, "a string", ["10%", "25%", " 5 %", "x"]), "standardize_format", "a", kind="percent", mode="proportion") == [0.1, 0.25, 0.05, None]
    assert run(frame(spark, "a string", ["$1,200", "$50", "999", "-€3.5"]), "standardize_format", "a", kind="currency") == [1200.0, 50.0, 999.0, -3.5]
    assert run(frame(spark, "a string", ["1.234,5", "2,6"]), "standardize_format", "a", kind="decimal_separator", from_separator=",") == [1234.5, 2.6]
    assert run(frame(spark, "a string", ["05.01.2024"]), "standardize_format", "a", kind="date_format") == ["2024-01-05"]


def test_treat_rows_and_merge(spark):
    df = frame(spark, "a double", [10.0, 10.0, 500.0, 40.0])
    assert run(df, "treat_rows", "a", row_ids=[2], method="missing") == [10.0, 10.0, None, 40.0]
    assert run(df, "treat_rows", "a", row_ids=[2], method="value", value="7") == [10.0, 10.0, 7.0, 40.0]
    assert run(df, "treat_rows", "a", row_ids=[0, 2], method="cap", min=20, max=100) == [20.0, 10.0, 100.0, 40.0]
    assert run(df, "treat_rows", "a", row_ids=[2], method="median") == [10.0, 10.0, 25.0, 40.0]
    assert run(df, "treat_rows", "a", row_ids=[2, *range(100, 2000)], method="mode") == [10.0, 10.0, 10.0, 40.0]
    assert run(frame(spark, "a long", [1, 2, 6]), "treat_rows", "a", row_ids=[2], method="mean") == [1.0, 2.0, 3.0]
    merged = execute(frame(spark, "name string, age long", [("a", 1), ("b", 2)]), "merge_records", {"primary_row_id": 0, "drop_row_ids": [1], "field_values": {"age": "9"}})
    assert column(merged, "age") == [9]


def test_units(spark):
    rules = [{"unit": "kg", "factor": 1}, {"unit": "lb", "factor": 0.5}]
    assert run(frame(spark, "a string", ["5kg", "10 lb", "30", "1,5 KG", "n/a"]), "convert_units", "a", rules=rules) == [5.0, 5.0, 30.0, 1.5, None]
    assert run(frame(spark, "a string", ["5kg", "junk", "3 oz"]), "convert_units", "a", rules=rules) == ["5.0", "junk", "3 oz"]
    scale = [{"condition": {"op": "<=", "value": 1}, "factor": 100}]
    assert run(frame(spark, "a double", [0.25, 25.0]), "convert_units", "a", rules=scale) == [25.0, 25.0]


def test_patterns(spark):
    df = frame(spark, "a string", ["ID-0042", "x", (None,)])
    assert run(df, "clean_pattern", "a", action="extract", pattern=r"ID-(\d+)") == ["0042", "x", None]
    assert run(df, "clean_pattern", "a", action="set_missing", pattern="^ID") == ["ID-0042", None, None]
    assert run(df, "clean_pattern", "a", action="strip_affix", prefix="ID-", suffix="2") == ["004", "x", None]
    assert run(frame(spark, "a string", ["42", "X-9", "-1", "123456"]), "clean_pattern", "a", action="pad", length=5) == ["00042", "00X-9", "-0001", "123456"]
    with pytest.raises(ValueError):
        run(df, "clean_pattern", "a", action="extract", pattern="ID", group=1)
    with pytest.raises(ValueError):
        run(frame(spark, "a long", [1]), "clean_pattern", "a", action="pad", length=5)


def test_plans_stay_without_python(spark):
    df = frame(spark, "a string, n double", [("x", 1.0)])
    steps = [("normalize", {"columns": ["a"], "operations": ["trim", "title"]}), ("convert_type", {"column": "n", "target_type": "string"}), ("mask_values", {"column": "a", "rule": {"type": "contains", "text": "x"}})]
    for op, params in steps:
        df = execute(df, op, params)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and df.select(F.count("*")).first()[0] == 1
