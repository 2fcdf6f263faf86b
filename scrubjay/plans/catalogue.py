"""Every query of the library by name, with the SQL that has the same rows.

The test tables are clean, so queries run on dirty views of them: columns are
given as expressions that Spark and other SQL engines read alike.  A row's id
is its natural key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubjay.assessments import keys, profile, text, typing
from scrubjay.functions import stats
from scrubjay.functions.columns import qcol
from scrubjay.operators import OperationSpec, execute, replay
from scrubjay.plans import duplicates, outliers, validate
from scrubjay.plans.lineage import History
from scrubjay.session import ROW_ID, scratch_path
from scrubjay.sources import csv, sinks

Query = Callable[[SparkSession, str], DataFrame]

#: Dirty views: table, and columns by expression.
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "people": (
        "customer",
        {
            "__rid": "c_custkey",
            "name": "CASE WHEN c_custkey % 23 = 0 THEN 'N/A' WHEN c_custkey % 17 = 0 THEN '  ' WHEN c_custkey % 5 = 0 THEN '  ' || c_name || '  x ' WHEN c_custkey % 7 = 0 THEN upper(c_name) ELSE c_name END",
            "segment": "CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 9 = 0 THEN ' ' || c_mktsegment ELSE c_mktsegment END",
            "nation": "c_nationkey",
            "balance": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END",
            "age": "CASE WHEN c_custkey % 19 = 0 THEN 'n/a' WHEN c_custkey % 29 = 0 THEN 'unknown' WHEN c_custkey % 31 = 0 THEN '12,5' ELSE CAST(c_custkey * 7 % 90 AS STRING) END",
            "joined": "CASE WHEN c_custkey % 8 = 0 THEN 'bad' WHEN c_custkey % 8 = 1 THEN NULL ELSE '2024-0' || CAST(1 + c_custkey % 9 AS STRING) || '-1' || CAST(c_custkey % 10 AS STRING) END",
            "flag": "CASE c_custkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' WHEN 4 THEN 'maybe' ELSE NULL END",
            "price": "CASE WHEN c_custkey % 10 = 0 THEN 'free' ELSE '$' || CAST(c_custkey AS STRING) || ',' || CAST(100 + c_custkey % 900 AS STRING) || '.50' END",
            "share": "CASE WHEN c_custkey % 12 = 0 THEN '?' ELSE ' ' || CAST(c_custkey % 100 AS STRING) || '%' END",
            "comma": "CAST(c_custkey % 9 + 1 AS STRING) || '.' || CAST(100 + c_custkey % 900 AS STRING) || ',5'",
            "weight": "CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey % 50 AS STRING) || 'kg' WHEN 1 THEN CAST(c_custkey % 50 AS STRING) || ' lb' WHEN 2 THEN CAST(c_custkey % 50 AS STRING) WHEN 3 THEN '€ ' || CAST(c_custkey % 50 AS STRING) || ',5' ELSE 'junk' END",
            "code": "CASE WHEN c_custkey % 6 = 0 THEN CAST(c_custkey AS STRING) WHEN c_custkey % 6 = 1 THEN '-' || CAST(c_custkey AS STRING) ELSE 'ID-' || CAST(c_custkey AS STRING) END",
            "note": "CASE WHEN c_custkey % 4 = 0 THEN 'a#b@c#' || CAST(c_custkey % 3 AS STRING) WHEN c_custkey % 4 = 1 THEN 'x~y' WHEN c_custkey % 4 = 2 THEN '“It’s” – so…' ELSE 'plain, text' END",
            "formula": "CASE c_custkey % 4 WHEN 0 THEN '=SUM(1)' WHEN 1 THEN '  +1' WHEN 2 THEN '@x' ELSE 'ok-1' END",
        },
    ),
    "sales": (
        "orders",
        {
            "__rid": "o_orderkey",
            "customer": "o_custkey",
            "status": "CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderstatus END",
            "total": "CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_totalprice END",
            "ordered": "o_orderdate",
            "priority": "o_orderpriority",
            "units": "CAST(o_orderkey % 17 AS INT)",
            "limit_": "CAST(o_orderkey % 13 AS INT)",
        },
    ),
    "readings": ("events", {"__rid": "event_id", "ts": "ts", "value": "CASE WHEN event_id % 5 IN (1, 2) THEN NULL ELSE value END", "kind": "event_type", "user_id": "user_id"}),
    "parts": ("part", {"__rid": "p_partkey", "brand": "p_brand", "type": "CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE 'N/A' END", "size": "p_size", "name": "p_name"}),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*(F.expr(e).alias(c) for c, e in columns.items()))


def view_sql(name: str) -> str:
    table, columns = VIEWS[name]
    return "(SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in columns.items()) + f" FROM {table})"


_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        for v in VIEWS:
            sql = sql.replace("{" + v + "}", view_sql(v))
        _SQL[name] = sql.replace("{rid}", '"__rid"')


def _op(name: str, table: str, op: str, params: dict, value: str | None = None, columns: tuple[str, ...] = (), sql: str | None = None, rounded: bool = False) -> None:
    """A query of one operation: the row's id and the columns concerned."""
    keep = columns or (params["column"],)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        done = execute(view(spark, sf_dir, table), op, params)
        return done.select(qcol(ROW_ID).alias("rid"), *((F.round(qcol(c), 6) if rounded else qcol(c)).alias(c) for c in keep))

    if sql is None and value is not None:
        out = f"round({value}, 6)" if rounded else value
        sql = f'SELECT {{rid}} AS rid, {out} AS "{keep[0]}" FROM {{{table}}}'
    _add(name, query, sql)


_MISSING = "({0} IS NULL OR lower(trim(CAST({0} AS VARCHAR))) IN ('na', 'n/a', 'null', 'none', 'nan', '-', '--', ''))"


def _missing(c: str) -> str:
    return _MISSING.format(f'"{c}"')


def _known(c: str) -> str:
    return f'CASE WHEN {_missing(c)} THEN NULL ELSE "{c}" END'


def _names(table: str) -> list[str]:
    return [c for c in VIEWS[table][1] if c != ROW_ID]


def _each(table: str, body: str) -> str:
    """UNION ALL of a query for every column; ``{c}`` is its name, ``{m}`` its missing test."""
    return " UNION ALL ".join(body.replace("{c}", c).replace("{m}", _missing(c)).replace("{k}", _known(c)).replace("{t}", "{" + table + "}") for c in _names(table))


# --- assessments -------------------------------------------------------------

_add("missing_counts", lambda s, d: profile.missing_counts(view(s, d, "people")), _each("people", "SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {m}) AS n_missing, count(*) AS n_rows FROM {t}"))
_add("marker_breakdown", lambda s, d: profile.marker_breakdown(view(s, d, "people"), "name"), f"SELECT CASE WHEN name IS NULL THEN 'null value' WHEN trim(name) = '' THEN 'blank' ELSE lower(trim(name)) END AS marker, count(*) AS n FROM {{people}} WHERE {_missing('name')} GROUP BY 1")
_add(
    "profile_columns",
    lambda s, d: profile.profile(view(s, d, "sales")).select("column", "n_rows", "n_missing", "n_unique", "n_repeated", "missing_pct", "is_unique_key", "has_repeats", "severity"),
    "SELECT *, n_missing = 0 AND n_repeated = 0 AS is_unique_key, n_repeated > 0 AS has_repeats, CASE WHEN missing_pct = 0 THEN 'none' WHEN missing_pct < 25 THEN 'low' WHEN missing_pct < 50 THEN 'moderate' WHEN missing_pct < 75 THEN 'high' ELSE 'critical' END AS severity FROM (SELECT *, n_rows - n_missing - n_unique AS n_repeated, round(n_missing * 100.0 / n_rows, 2) AS missing_pct FROM ("
    + _each("sales", "SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER (WHERE {m}) AS n_missing, count(DISTINCT {k}) AS n_unique FROM {t}")
    + "))",
)
_add("char_histogram", lambda s, d: profile.special_chars(view(s, d, "people").select(ROW_ID, "note", "code")).select("column", "char", "n"), "SELECT 'note' AS \"column\", ch AS char, count(*) AS n FROM (SELECT unnest(regexp_extract_all(note, '[^A-Za-z0-9\\s\\-.,''/:%]')) AS ch FROM {people}) GROUP BY 2")
_add("normalization_counts", lambda s, d: text.normalization_counts(view(s, d, "people").select(ROW_ID, "name", "segment")).where("change <> 'title'"), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS change, count(*) FILTER (WHERE {t.format(c)}) AS n FROM {{people}}" for c in ("name", "segment") for k, t in {"trim": "trim({0}) <> {0}", "collapse_spaces": "regexp_matches({0}, ' {{2,}}')", "strip_linebreaks": "regexp_matches({0}, '[\\r\\n\\t]')", "empty_to_null": "trim({0}) = ''", "lower": "lower({0}) <> {0}", "upper": "upper({0}) <> {0}", "standardize_punctuation": "regexp_matches({0}, '[’‘`´“”\"—–…]')"}.items()))
_add("label_variants", lambda s, d: text.label_variants(view(s, d, "people"), "segment").select("key", "canonical", F.array_join("variants", "|").alias("variants"), F.col("n_variants").cast("long").alias("n_variants")), "SELECT key, arg_min(label, (-length(label), label)) AS canonical, string_agg(label, '|' ORDER BY label) AS variants, count(*) AS n_variants FROM (SELECT DISTINCT lower(regexp_replace(trim(segment), ' {2,}', ' ', 'g')) AS key, segment AS label FROM {people} WHERE segment IS NOT NULL) GROUP BY key HAVING count(*) > 1")


def _structures(s: SparkSession, d: str) -> DataFrame:
    df = view(s, d, "sales").withColumn("nothing", F.lit(None).cast("string")).withColumn("same", F.lit("x"))
    found = profile.structures(df)
    return s.createDataFrame([("empty_rows", str(found["empty_rows"]))] + [("empty_column", c) for c in found["empty_columns"]] + [("constant_column", c) for c in found["constant_columns"]], "finding string, value string")


_add("structures", _structures, "SELECT 'empty_rows' AS finding, '0' AS value UNION ALL SELECT 'empty_column', 'nothing' UNION ALL SELECT 'constant_column', 'same'")
_add("type_inference", lambda s, d: s.createDataFrame([(c, typing.infer_column(view(s, d, "people"), c)["suggested"]) for c in ("age", "segment", "flag", "balance", "nation", "joined", "note")], "column string, suggested string"), " UNION ALL ".join([f"SELECT '{c}' AS \"column\", CASE WHEN avg(CAST(regexp_matches(replace(trim({c}), ',', ''), '^-?[0-9]{{1,18}}$') AS INT)) >= 0.95 THEN 'integer' WHEN count(DISTINCT trim({c})) FILTER (WHERE try_strptime(trim({c}), '%Y-%m-%d') IS NULL) <= 0.1 * count(DISTINCT trim({c})) THEN 'date' WHEN count(DISTINCT {c}) <= 50 AND count(DISTINCT {c}) <= 0.5 * count(*) THEN 'categorical' ELSE 'string' END AS suggested FROM {{people}} WHERE NOT {_missing(c)}" for c in ("age", "segment", "flag", "joined", "note")] + [f"SELECT '{c}', CASE min(typeof({c})) WHEN 'DOUBLE' THEN 'decimal' ELSE 'integer' END FROM {{people}}" for c in ("balance", "nation")]))
_add("recommendations", lambda s, d: s.createDataFrame([(x["column"], x["n_missing"], x["recommended"]) for x in profile.missingness(view(s, d, "sales").select(ROW_ID, "status", "total", "units"))], "column string, n_missing long, recommended string"), "SELECT 'status' AS \"column\", count(*) FILTER (WHERE status IS NULL) AS n_missing, 'mode' AS recommended FROM {sales} UNION ALL SELECT 'units', 0, NULL UNION ALL SELECT 'total', (SELECT count(*) FROM {sales} WHERE total IS NULL), CASE WHEN abs(avg(power(total - m, 3)) / power(avg(power(total - m, 2)), 1.5)) >= 1 THEN 'median' ELSE 'mean' END FROM {sales}, (SELECT avg(total) AS m FROM {sales})")
_add("unimputable_groups", lambda s, d: profile.unimputable_groups(view(s, d, "sales").withColumn("total", F.expr("CASE WHEN customer % 7 = 0 THEN NULL ELSE total END")), "total", ["customer"]), "SELECT customer, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_observed FROM {sales} GROUP BY customer HAVING count(CASE WHEN customer % 7 = 0 THEN NULL ELSE total END) = 0")
_add("column_names", lambda s, d: s.createDataFrame([(x["column"], x["proposed"], len(x["problems"])) for x in profile.column_names(view(s, d, "people").select(qcol("name").alias(" Full Name "), qcol("age").alias("full  name"), qcol("code").alias("OK"), qcol("note").alias("Na@me")))], "column string, proposed string, n_problems long"), "SELECT * FROM (VALUES (' Full Name ', 'full_name', 4), ('full  name', 'full_name', 2), ('OK', 'ok', 1), ('Na@me', 'na_me', 2)) t(\"column\", proposed, n_problems)")
_add("pattern_fit", lambda s, d: s.createDataFrame([(p, r["n_matching"], r["n_other"]) for p in ("digits_only", "alphanumeric_id", r"ID-\d+") for r in [text.pattern_fit(view(s, d, "people"), "code", p)]], "pattern string, n_matching long, n_other long"), " UNION ALL ".join(f"SELECT '{n}' AS pattern, count(*) FILTER (WHERE regexp_matches(code, '{p}')) AS n_matching, count(*) FILTER (WHERE NOT regexp_matches(code, '{p}')) AS n_other FROM {{people}}" for n, p in (("digits_only", r"^\d+$"), ("alphanumeric_id", "^[A-Za-z0-9_-]+$"), (r"ID-\d+", r"^ID-\d+$"))))
_add("unit_groups", lambda s, d: text.unit_groups(view(s, d, "people"), "weight"), "SELECT CASE weight[-2:] WHEN 'kg' THEN 'kg' WHEN 'lb' THEN 'lb' WHEN 'nk' THEN NULL ELSE CASE WHEN weight LIKE '€%' THEN '€' ELSE '' END END AS unit, CASE WHEN weight[-2:] IN ('kg', 'lb') THEN 'suffix' WHEN weight = 'junk' THEN 'none' WHEN weight LIKE '€%' THEN 'prefix' ELSE 'plain' END AS position, count(*) AS n, min(v) AS lowest, max(v) AS highest, CASE WHEN weight LIKE '€%' THEN true ELSE false END AS is_currency FROM (SELECT weight, TRY_CAST(replace(regexp_extract(weight, '[0-9]+(,[0-9]+)?'), ',', '.') AS DOUBLE) AS v FROM {people}) GROUP BY 1, 2, 6")
_add("mixed_scale", lambda s, d: s.createDataFrame([tuple(text.mixed_scale(s.read.parquet(f"{d}/lineitem.parquet").select(F.expr("CASE WHEN l_linenumber = 1 THEN l_discount ELSE l_quantity END").alias("x")), "x").values())], "column string, n long, n_shares long, n_above_one long, possible_mixed_scale boolean"), "SELECT 'x' AS \"column\", count(x) AS n, count(*) FILTER (WHERE x > 0 AND x <= 1) AS n_shares, count(*) FILTER (WHERE x > 1) AS n_above_one, count(x) >= 10 AND count(*) FILTER (WHERE x > 0 AND x <= 1) >= 2 AND count(*) FILTER (WHERE x > 1) >= 2 AND max(x) <= 100 AS possible_mixed_scale FROM (SELECT CASE WHEN l_linenumber = 1 THEN l_discount ELSE l_quantity END AS x FROM lineitem)")
_add("invalid_range", lambda s, d: text.invalid_values(view(s, d, "sales"), "total", {"type": "range", "min": 1000, "max": 100000})["rows"].toDF("rid"), "SELECT {rid} AS rid FROM {sales} WHERE total < 1000 OR total > 100000")
_KEYED = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey FROM lineitem"


def _keyed(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey")


_add("key_summary", lambda s, d: keys.key_summary(_keyed(s, d), ["l_orderkey", "l_linenumber"]), f"WITH g AS (SELECT count(*) AS n, count(DISTINCT l_partkey) AS p, count(DISTINCT l_suppkey) + CAST(count(l_suppkey) < count(*) AS INT) AS q FROM ({_KEYED}) GROUP BY l_orderkey, l_linenumber) SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(0 AS BIGINT) AS missing_rows, count(*) FILTER (WHERE n > 1 AND p = 1 AND q = 1) AS identical_groups, count(*) FILTER (WHERE n > 1 AND (p > 1 OR q > 1)) AS conflicting_groups, count(*) FILTER (WHERE n = 1) AS unique_rows FROM g")
_add("key_groups", lambda s, d: keys.key_groups(_keyed(s, d), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "n_rows", F.array_join("conflicts", ",").alias("conflicts")), f"SELECT l_orderkey, l_linenumber, count(*) AS n_rows, concat_ws(',', CASE WHEN count(DISTINCT l_partkey) > 1 THEN 'l_partkey' END, CASE WHEN count(DISTINCT l_suppkey) + CAST(count(l_suppkey) < count(*) AS INT) > 1 THEN 'l_suppkey' END) AS conflicts FROM ({_KEYED}) GROUP BY 1, 2 HAVING count(*) > 1")

# --- operations --------------------------------------------------------------

_op("rename_swap", "sales", "rename_columns", {"mapping": {"customer": "units", "units": "customer"}}, columns=("customer", "units"), sql="SELECT {rid} AS rid, units AS customer, customer AS units FROM {sales}")
_op("rename_column", "sales", "rename_column", {"from": "limit_", "to": "limit (x.y)"}, columns=("limit (x.y)",), sql='SELECT {rid} AS rid, limit_ AS "limit (x.y)" FROM {sales}')
_op("drop_rows", "sales", "drop_rows", {"row_ids": [1, 2, 3, 5, 8, 13, 10**12]}, columns=("customer",), sql="SELECT {rid} AS rid, customer FROM {sales} WHERE {rid} NOT IN (1, 2, 3, 5, 8, 13)")
_op("drop_many_rows", "sales", "drop_rows", {"row_ids": list(range(0, 4000, 3))}, columns=("customer",), sql="SELECT {rid} AS rid, customer FROM {sales} WHERE NOT ({rid} < 4000 AND {rid} % 3 = 0)")
_op("fill_null_constant", "people", "fill_null_constant", {"column": "segment", "value": "Unknown"}, "coalesce(segment, 'Unknown')")
_op("special_chars_strip", "people", "clean_special_chars", {"column": "note", "chars": ["#", "@"], "action": "strip"}, "replace(replace(note, '#', ''), '@', '')")
_op("special_chars_blank", "people", "clean_special_chars", {"column": "note", "chars": ["#", "~"], "action": "blank"}, "CASE WHEN contains(note, '#') OR contains(note, '~') THEN NULL ELSE note END")
_op("special_chars_replace", "people", "clean_special_chars", {"column": "note", "chars": ["#"], "action": "replace", "replacement": "$1"}, "replace(note, '#', '$1')")
_op("treat_drop_rows", "people", "treat_missing", {"column": "name", "method": "drop_rows"}, sql=f"SELECT {{rid}} AS rid, name FROM {{people}} WHERE NOT {_missing('name')}")
_op("treat_constant", "people", "treat_missing", {"column": "name", "method": "constant", "value": "nobody"}, f"coalesce({_known('name')}, 'nobody')")
_op("treat_mean", "sales", "treat_missing", {"column": "total", "method": "mean"}, "coalesce(total, (SELECT avg(total) FROM {sales}))", rounded=True)
_op("treat_median", "sales", "treat_missing", {"column": "total", "method": "median"}, "coalesce(total, (SELECT median(total) FROM {sales}))", rounded=True)
_NUMBER_OR_COMMA = "TRY_CAST(CASE WHEN regexp_matches({0}, '^-?[0-9]+,[0-9]+$') THEN replace({0}, ',', '.') WHEN regexp_matches({0}, '^[+-]?[0-9]+$') THEN {0} END AS DOUBLE)"
_op("treat_median_text", "people", "treat_missing", {"column": "age", "method": "median"}, f"coalesce({_known('age')}, (SELECT CAST(median({_NUMBER_OR_COMMA.format('age')}) AS VARCHAR) FROM {{people}}))")
_op("treat_mode", "sales", "treat_missing", {"column": "status", "method": "mode"}, "coalesce(status, (SELECT status FROM {sales} WHERE status IS NOT NULL GROUP BY status ORDER BY count(*) DESC, status LIMIT 1))")
_ORDER = "ORDER BY ts NULLS FIRST, {rid}"
_op("forward_fill", "readings", "treat_missing", {"column": "value", "method": "forward_fill", "order_by": "ts"}, f"last_value(value IGNORE NULLS) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
_op("backward_fill", "readings", "treat_missing", {"column": "value", "method": "backward_fill", "order_by": "ts"}, f"first_value(value IGNORE NULLS) OVER ({_ORDER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
_op("forward_fill_in_buckets", "readings", "treat_missing", {"column": "value", "method": "forward_fill", "order_by": "ts", "rows_per_bucket": 700}, f"last_value(value IGNORE NULLS) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def _interpolation(position: str) -> str:
    known = "CASE WHEN value IS NOT NULL THEN p END"
    return (
        f"WITH a AS (SELECT {{rid}} AS rid, ts, value, CAST({position} AS DOUBLE) AS p FROM {{readings}}), b AS (SELECT rid, value, p, "
        f"last_value(value IGNORE NULLS) OVER w AS v0, last_value({known} IGNORE NULLS) OVER w AS p0, first_value(value IGNORE NULLS) OVER x AS v1, first_value({known} IGNORE NULLS) OVER x AS p1 FROM a "
        "WINDOW w AS (ORDER BY ts NULLS FIRST, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (ORDER BY ts NULLS FIRST, rid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) "
        "SELECT rid, round(coalesce(value, CASE WHEN p1 = p0 THEN v0 ELSE v0 + (v1 - v0) * (p - p0) / (p1 - p0) END), 6) AS value FROM b"
    )


_op("interpolate_linear", "readings", "treat_missing", {"column": "value", "method": "interpolate_linear", "order_by": "ts"}, sql=_interpolation("row_number() OVER (ORDER BY ts NULLS FIRST, {rid})"), rounded=True)
_op("interpolate_time", "readings", "treat_missing", {"column": "value", "method": "interpolate_time", "order_by": "ts", "rows_per_bucket": 900}, sql=_interpolation("epoch_us(ts) / 1e6"), rounded=True)
_op("group_impute_median", "sales", "treat_missing", {"column": "total", "method": "group_impute", "group_by": ["status"], "statistic": "median"}, sql="WITH g AS (SELECT status, median(total) AS m FROM {sales} GROUP BY status) SELECT {rid} AS rid, round(coalesce(total, m), 6) AS total FROM {sales} s LEFT JOIN g ON s.status = g.status", rounded=True)
_op("group_impute_mean", "sales", "treat_missing", {"column": "total", "method": "group_impute", "group_by": ["priority"], "statistic": "mean"}, sql="WITH g AS (SELECT priority, avg(total) AS m FROM {sales} GROUP BY priority) SELECT {rid} AS rid, round(coalesce(total, m), 6) AS total FROM {sales} s LEFT JOIN g ON s.priority = g.priority", rounded=True)
_op("group_impute_mode", "sales", "treat_missing", {"column": "status", "method": "group_impute", "group_by": ["priority"], "statistic": "mode"}, sql="WITH g AS (SELECT priority, status AS m, row_number() OVER (PARTITION BY priority ORDER BY count(*) DESC, status) AS r FROM {sales} WHERE status IS NOT NULL GROUP BY priority, status) SELECT {rid} AS rid, coalesce(status, m) AS status FROM {sales} s LEFT JOIN g ON s.priority = g.priority AND r = 1")
_DRAWN = "WITH o AS (SELECT value AS drawn, row_number() OVER (ORDER BY {rid}) - 1 AS at FROM {readings} WHERE value IS NOT NULL), n AS (SELECT count(*) AS n FROM o), r AS (SELECT {rid} AS rid, value, CASE WHEN value IS NULL THEN CAST('0x' || substr(md5(CAST({rid} AS VARCHAR) || ':7'), 1, 15) AS BIGINT) % n END AS at FROM {readings}, n) SELECT rid, coalesce(value, drawn) AS value FROM r LEFT JOIN o ON r.at = o.at"
_op("random_sample", "readings", "treat_missing", {"column": "value", "method": "random_sample", "seed": 7}, sql=_DRAWN)
_op("random_sample_in_buckets", "readings", "treat_missing", {"column": "value", "method": "random_sample", "seed": 7, "rows_per_bucket": 700}, sql=_DRAWN)
_op("drop_column", "sales", "drop_column", {"column": "total"}, columns=("customer", "status", "ordered", "priority", "units", "limit_"), sql="SELECT {rid} AS rid, customer, status, ordered, priority, units, limit_ FROM {sales}")
_op("treat_drop_column", "sales", "treat_missing", {"column": "total", "method": "drop_column"}, columns=("customer", "status", "ordered", "priority", "units", "limit_"), sql="SELECT {rid} AS rid, customer, status, ordered, priority, units, limit_ FROM {sales}")
_op("convert_integer", "people", "convert_type", {"column": "age", "target_type": "integer"}, "CASE WHEN regexp_matches(replace(trim(age), ',', ''), '^[+-]?[0-9]+$') THEN CAST(replace(trim(age), ',', '') AS BIGINT) END")
_op("convert_decimal", "people", "convert_type", {"column": "age", "target_type": "decimal"}, "CASE WHEN regexp_matches(replace(trim(age), ',', ''), '^[+-]?[0-9]+$') THEN CAST(replace(trim(age), ',', '') AS DOUBLE) END")
_BOOL = "CASE WHEN lower(trim(flag)) IN ('y', 'yes', 'true', 't', '1') THEN {0} WHEN lower(trim(flag)) IN ('n', 'no', 'false', 'f', '0') THEN {1} END"
_op("convert_boolean", "people", "convert_type", {"column": "flag", "target_type": "boolean"}, _BOOL.format("true", "false"))
_op("convert_date", "people", "convert_type", {"column": "joined", "target_type": "date", "format": "%Y-%m-%d"}, "CAST(try_strptime(joined, '%Y-%m-%d') AS DATE)")
_op("convert_datetime", "people", "convert_type", {"column": "joined", "target_type": "datetime", "format": "%Y-%m-%d"}, "try_strptime(joined, '%Y-%m-%d')")
_op("convert_string", "sales", "convert_type", {"column": "units", "target_type": "string"}, "CAST(units AS VARCHAR)")
for _step, _sql in {
    "trim": "trim(name)",
    "collapse_spaces": "regexp_replace(name, ' {2,}', ' ', 'g')",
    "lower": "lower(name)",
    "upper": "upper(name)",
    "empty_to_null": "CASE WHEN trim(name) <> '' THEN name END",
    "strip_linebreaks": "regexp_replace(name, '[\\r\\n\\t]+', ' ', 'g')",
}.items():
    _op(f"normalize_{_step}", "people", "normalize", {"columns": ["name"], "operations": [_step]}, columns=("name",), value=_sql)
_op("normalize_title", "people", "normalize", {"columns": ["segment"], "operations": ["title"]}, columns=("segment",), value="CASE WHEN segment IS NOT NULL THEN regexp_extract(segment, '^ *') || upper(trim(segment)[1]) || lower(trim(segment)[2:]) END")
_op("normalize_punctuation", "people", "normalize", {"columns": ["note"], "operations": ["standardize_punctuation"]}, columns=("note",), value="replace(replace(replace(replace(replace(note, '“', '\"'), '”', '\"'), '’', ''''), '–', '-'), '…', '...')")
_op("normalize_map_values", "people", "normalize", {"columns": ["segment"], "operations": ["trim", "upper", {"op": "map_values", "mapping": {"BUILDING": "B", "MACHINERY": "M"}}]}, columns=("segment",), value="CASE upper(trim(segment)) WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE upper(trim(segment)) END")
for _name, _table, _column, _rule, _sql in (
    ("range", "sales", "total", {"type": "range", "min": 5000, "max": 200000}, "total < 5000 OR total > 200000"),
    ("not_in", "sales", "priority", {"type": "not_in", "values": ["1-URGENT", "2-HIGH"]}, "priority NOT IN ('1-URGENT', '2-HIGH')"),
    ("unparseable_date", "people", "joined", {"type": "unparseable_date", "format": "%Y-%m-%d"}, "joined = 'bad'"),
    ("unparseable_numeric", "people", "age", {"type": "unparseable_numeric"}, "NOT regexp_matches(age, '^[0-9]+$')"),
    ("contains", "people", "segment", {"type": "contains", "text": "BUILD"}, "NOT contains(segment, 'BUILD')"),
    ("cmp_constant", "sales", "units", {"type": "cmp", "op": "ge", "value": 5}, "NOT units >= 5"),
    ("cmp_column", "sales", "units", {"type": "cmp", "op": "lt", "other_column": "limit_"}, "NOT units < limit_"),
    ("cmp_date", "sales", "ordered", {"type": "cmp", "op": "gt", "value_kind": "date", "value": "1995-01-01"}, "NOT ordered > TIMESTAMP '1995-01-01'"),
    ("date_range", "people", "joined", {"type": "date_range", "min": "2024-03-01", "max": "2024-06-30"}, "joined = 'bad' OR try_strptime(joined, '%Y-%m-%d') < TIMESTAMP '2024-03-01' OR try_strptime(joined, '%Y-%m-%d') > TIMESTAMP '2024-06-30'"),
):
    _op(f"mask_{_name}", _table, "mask_values", {"column": _column, "rule": _rule}, f"CASE WHEN {_sql} THEN NULL ELSE {_column} END")
_op("format_boolean", "people", "standardize_format", {"column": "flag", "kind": "boolean", "representation": "yes_no"}, _BOOL.format("'Yes'", "'No'"))
_op("format_date", "people", "standardize_format", {"column": "joined", "kind": "date_format", "format": "%Y-%m-%d"}, "strftime(try_strptime(joined, '%Y-%m-%d'), '%Y-%m-%d')")
_op("format_decimal_comma", "people", "standardize_format", {"column": "comma", "kind": "decimal_separator", "from_separator": ","}, "CAST(replace(replace(comma, '.', ''), ',', '.') AS DOUBLE)")
_op("format_currency", "people", "standardize_format", {"column": "price", "kind": "currency"}, "TRY_CAST(replace(regexp_replace(price, '[^0-9,.\\-]', '', 'g'), ',', '') AS DOUBLE)")
_op("format_percent", "people", "standardize_format", {"column": "share", "kind": "percent", "mode": "proportion"}, "TRY_CAST(trim(replace(share, '%', '')) AS DOUBLE) / 100", rounded=True)
_op("treat_rows_cap", "sales", "treat_rows", {"column": "total", "row_ids": list(range(0, 3000, 2)), "method": "cap", "min": 1000, "max": 50000}, "CASE WHEN {rid} < 3000 AND {rid} % 2 = 0 THEN CASE WHEN total < 1000 THEN 1000 WHEN total > 50000 THEN 50000 ELSE total END ELSE total END")
_op("treat_rows_mean", "sales", "treat_rows", {"column": "total", "row_ids": [1, 2, 3, 4, 5], "method": "mean"}, "CASE WHEN {rid} IN (1, 2, 3, 4, 5) THEN (SELECT avg(total) FROM {sales}) ELSE total END", rounded=True)
_op("treat_rows_missing", "sales", "treat_rows", {"column": "total", "row_ids": [1, 2, 3], "method": "missing"}, "CASE WHEN {rid} IN (1, 2, 3) THEN NULL ELSE total END")
_op("treat_rows_value", "sales", "treat_rows", {"column": "total", "row_ids": [1, 2, 3], "method": "value", "value": "12.5"}, "CASE WHEN {rid} IN (1, 2, 3) THEN 12.5 ELSE total END")
_op("units_text", "people", "convert_units", {"column": "weight", "rules": [{"unit": "kg", "factor": 1}, {"unit": "lb", "factor": 0.5}]}, "CASE WHEN weight LIKE '%kg' THEN CAST(CAST(weight[:-3] AS DOUBLE) AS VARCHAR) WHEN weight LIKE '% lb' THEN CAST(CAST(weight[:-4] AS DOUBLE) * 0.5 AS VARCHAR) WHEN regexp_matches(weight, '^[0-9]+$') THEN CAST(CAST(weight AS DOUBLE) AS VARCHAR) ELSE weight END")
_op("units_scale", "sales", "convert_units", {"column": "units", "rules": [{"condition": {"op": "all"}, "factor": 2}, {"condition": {"op": "<=", "value": 5}, "factor": 10}]}, "CASE WHEN units <= 5 THEN units * 10.0 ELSE units * 2.0 END::DOUBLE")
_op("pattern_set_missing", "people", "clean_pattern", {"column": "code", "action": "set_missing", "pattern": "^ID-"}, "CASE WHEN code LIKE 'ID-%' THEN code END")
_op("pattern_extract", "people", "clean_pattern", {"column": "code", "action": "extract", "pattern": r"^ID-(\d+)$", "group": 1}, "CASE WHEN code LIKE 'ID-%' THEN regexp_extract(code, '^ID-([0-9]+)$', 1) ELSE code END")
_op("pattern_strip_affix", "people", "clean_pattern", {"column": "code", "action": "strip_affix", "prefix": "ID-", "suffix": "7"}, "regexp_replace(regexp_replace(code, '^ID-', ''), '7$', '')")
_op("pattern_pad", "people", "clean_pattern", {"column": "code", "action": "pad", "length": 8}, "CASE WHEN length(code) >= 8 THEN code WHEN code LIKE '-%' THEN '-' || lpad(code[2:], 7, '0') ELSE lpad(code, 8, '0') END")
_op("pattern_replace", "people", "clean_pattern", {"column": "code", "action": "replace", "pattern": r"(\d)\d*$", "replacement": "<$1>"}, r"regexp_replace(code, '(\d)\d*$', '<\1>')")
_op("merge_records", "sales", "merge_records", {"primary_row_id": 1, "drop_row_ids": [2, 3], "field_values": {"status": "Z"}}, columns=("status",), sql="SELECT {rid} AS rid, CASE WHEN {rid} = 1 THEN 'Z' ELSE status END AS status FROM {sales} WHERE {rid} NOT IN (2, 3)")

# --- duplicates --------------------------------------------------------------

_DUP = ["brand", "type", "size"]
_PARTS = f'(SELECT {{rid}} AS rid, brand, {_known("type")} AS type, size, name FROM {{parts}})'
_PAIRS = f"SELECT x.rid AS a, y.rid AS b, CAST(x.brand IS NOT DISTINCT FROM y.brand AS INT) + CAST(x.type IS NOT DISTINCT FROM y.type AS INT) + CAST(x.size IS NOT DISTINCT FROM y.size AS INT) AS matches FROM {_PARTS} x JOIN {_PARTS} y ON x.rid < y.rid"
_add("dup_exact_groups", lambda s, d: duplicates.exact_groups(view(s, d, "parts"), _DUP), f"SELECT min(rid) AS group_id, count(*) AS n_rows FROM {_PARTS} GROUP BY brand, type, size HAVING count(*) > 1")
_add("dup_exact_members", lambda s, d: duplicates.exact_members(view(s, d, "parts"), _DUP).toDF("rid", "group_id"), f"SELECT rid, group_id FROM (SELECT rid, min(rid) OVER w AS group_id, count(*) OVER w AS n FROM {_PARTS} WINDOW w AS (PARTITION BY brand, type, size)) WHERE n > 1")
_add("dup_exact_summary", lambda s, d: duplicates.exact_summary(view(s, d, "parts"), _DUP), f"SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS affected_rows, CAST(coalesce(sum(n), 0) AS BIGINT) - count(*) AS proposed_removals, (SELECT count(*) FROM {{parts}}) - (CAST(coalesce(sum(n), 0) AS BIGINT) - count(*)) AS resulting_rows FROM (SELECT count(*) AS n FROM {_PARTS} GROUP BY brand, type, size HAVING count(*) > 1)")
_add("dup_estimate", lambda s, d: s.createDataFrame([(t, duplicates.estimate(view(s, d, "parts"), _DUP, b, t)["candidate_pairs"]) for t, b in ((100, []), (80, []), (90, ["brand"]))], "threshold long, candidate_pairs long"), f"WITH c AS (SELECT 100 AS t, count(*) AS n FROM {_PARTS} GROUP BY brand, type, size UNION ALL SELECT 80, count(*) FROM {_PARTS} GROUP BY brand UNION ALL SELECT 80, count(*) FROM {_PARTS} GROUP BY type UNION ALL SELECT 80, count(*) FROM {_PARTS} GROUP BY size UNION ALL SELECT 90, count(*) FROM {_PARTS} GROUP BY brand) SELECT CAST(t AS BIGINT) AS threshold, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS candidate_pairs FROM c GROUP BY t")


def _near(s: SparkSession, d: str, blocking: list[str]) -> DataFrame:
    return duplicates.near_pairs(view(s, d, "parts"), [*_DUP, "name"], blocking, 80, guard=False)


_NAMED = _PAIRS.replace(" AS matches", " + CAST(x.name IS NOT DISTINCT FROM y.name AS INT) AS matches")
_add("dup_near_blocked", lambda s, d: duplicates.near_pairs(view(s, d, "parts").drop("name"), _DUP, ["brand"], 80, guard=False), f"SELECT * FROM ({_PAIRS} AND x.brand = y.brand) WHERE matches >= 3")
_add("dup_near_pairs", lambda s, d: _near(s, d, []), f"SELECT * FROM ({_NAMED}) WHERE matches >= 4")
_LINES = "(SELECT min({rid}) AS rid, customer % 50 AS c, status, priority, units % 4 AS u, limit_ % 4 AS l, {rid} % 3 AS m FROM {sales} GROUP BY ALL)"
_LINES_PAIRS = f"SELECT x.rid AS a, y.rid AS b, CAST(x.status IS NOT DISTINCT FROM y.status AS INT) + CAST(x.priority = y.priority AS INT) + CAST(x.u = y.u AS INT) + CAST(x.l = y.l AS INT) + CAST(x.m = y.m AS INT) AS matches FROM {_LINES} x JOIN {_LINES} y ON x.rid < y.rid AND x.c = y.c"


def _lines(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "sales").selectExpr(ROW_ID, "customer % 50 AS c", "status", "priority", "units % 4 AS u", "limit_ % 4 AS l", f"{ROW_ID} % 3 AS m")


_add("dup_class_pairs", lambda s, d: duplicates.class_pairs(_lines(s, d), ["status", "priority", "u", "l", "m"], ["c"], 80, guard=False), f"SELECT * FROM ({_LINES_PAIRS}) WHERE matches >= 4")
_add("dup_class_members", lambda s, d: duplicates.class_members(view(s, d, "parts"), ["brand", "type"]).toDF("rid", "class_id"), f"SELECT rid, min(rid) OVER (PARTITION BY brand, type) AS class_id FROM {_PARTS}")
_add("dup_clusters", lambda s, d: duplicates.cluster_members(duplicates.cluster_lists(view(s, d, "parts"), _DUP, [], 80)).select("representative", "member", F.col("score_pct").cast("long").alias("score_pct")), f"SELECT a AS representative, b AS member, CAST(100 AS BIGINT) AS score_pct FROM ({_PAIRS}) WHERE matches = 3 UNION ALL SELECT b, a, CAST(100 AS BIGINT) FROM ({_PAIRS}) WHERE matches = 3")
for _how, _pick in (("keep_first", "rid"), ("keep_last", "rid DESC"), ("keep_most_complete", "CAST(known AS INT) DESC, rid")):
    _add(f"dup_{_how}", (lambda how: lambda s, d: duplicates.resolve(view(s, d, "parts"), ["brand", "size"], how).select(qcol(ROW_ID).alias("rid")))(_how), f"SELECT rid FROM (SELECT rid, row_number() OVER (PARTITION BY brand, size ORDER BY {_pick}) AS r FROM (SELECT *, type IS NOT NULL AS known FROM {_PARTS})) WHERE r = 1")

# --- outliers ----------------------------------------------------------------


def _near_rank(c: str, q: float, rows: str) -> str:
    return f"(SELECT list_sort(list({c}))[CAST(floor((count({c}) - 1) * {q} + 0.5) AS INT) + 1] FROM {rows})"


_V = "(SELECT {rid} AS rid, CASE WHEN {rid} % 400 = 0 THEN total * 9 ELSE total END AS v, status, ordered, units FROM {sales})"
_BOUNDS = {
    "iqr": ({}, f"SELECT {_near_rank('v', 0.25, _V)} - 1.5 * ({_near_rank('v', 0.75, _V)} - {_near_rank('v', 0.25, _V)}) AS lower, {_near_rank('v', 0.75, _V)} + 1.5 * ({_near_rank('v', 0.75, _V)} - {_near_rank('v', 0.25, _V)}) AS upper"),
    "zscore": ({}, f"SELECT avg(v) - 3 * stddev_samp(v) AS lower, avg(v) + 3 * stddev_samp(v) AS upper FROM {_V}"),
    "modified_zscore": ({}, f"WITH m AS (SELECT median(v) AS m FROM {_V}), a AS (SELECT median(abs(v - m)) AS a FROM {_V}, m) SELECT m - 3.5 * a / 0.6745 AS lower, m + 3.5 * a / 0.6745 AS upper FROM m, a"),
    "percentile": ({}, f"SELECT {_near_rank('v', 0.01, _V)} AS lower, {_near_rank('v', 0.99, _V)} AS upper"),
    "manual": ({"min": 2000.0}, "SELECT CAST(2000 AS DOUBLE) AS lower, CAST('inf' AS DOUBLE) AS upper"),
}


def _spiked(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "sales").withColumn("v", F.expr("CASE WHEN __rid % 400 = 0 THEN total * 9 ELSE total END"))


def _bounds_query(method: str, params: dict) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        low, high = outliers.bounds(_spiked(s, d), "v", method, params)
        return s.createDataFrame([(float(low), float(high))], "lower double, upper double").select(F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"))

    return query


def _flagged_query(method: str, params: dict) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        df = _spiked(s, d)
        return outliers.flagged(df, "v", *outliers.bounds(df, "v", method, params)).select(qcol(ROW_ID).alias("rid"), F.round("value", 4).alias("value"))

    return query


for _method, (_params, _sql) in _BOUNDS.items():
    _add(f"outlier_bounds_{_method}", _bounds_query(_method, _params), f"SELECT round(lower, 4) AS lower, round(upper, 4) AS upper FROM ({_sql})")
    _add(f"outlier_flagged_{_method}", _flagged_query(_method, _params), f"SELECT rid, round(v, 4) AS value FROM {_V}, ({_sql}) WHERE v < lower OR v > upper")


def _stats(s: SparkSession, d: str) -> DataFrame:
    found = outliers.column_stats(_spiked(s, d), "v")
    return s.createDataFrame([tuple(float(found[k]) for k in ("count", "min", "max", "mean", "median", "std", "q1", "q3", "skew"))], "n double, min double, max double, mean double, median double, std double, q1 double, q3 double, skew double").select(*(F.round(c, 4).alias(c) for c in ("n", "min", "max", "mean", "median", "std", "q1", "q3", "skew")))


_add("outlier_stats", _stats, f"WITH m AS (SELECT avg(v) AS m FROM {_V}) SELECT round(count(v)::DOUBLE, 4) AS n, round(min(v), 4) AS min, round(max(v), 4) AS max, round(avg(v), 4) AS mean, round(median(v), 4) AS median, round(stddev_samp(v), 4) AS std, round({_near_rank('v', 0.25, _V)}, 4) AS q1, round({_near_rank('v', 0.75, _V)}, 4) AS q3, round(avg(power(v - m, 3)) / power(avg(power(v - m, 2)), 1.5), 4) AS skew FROM {_V}, m")
_add("outlier_histogram", lambda s, d: stats.histogram(outliers.values_of(_spiked(s, d), "v"), "v").select("bin", "n"), f"WITH r AS (SELECT min(v) AS a, (max(v) - min(v)) / 30 AS w FROM {_V}), h AS (SELECT greatest(1, least(30, CAST(ceil((v - a) / w) AS INT))) AS bin FROM {_V}, r WHERE v IS NOT NULL) SELECT CAST(i AS INT) AS bin, count(h.bin) AS n FROM range(1, 31) t(i) LEFT JOIN h ON h.bin = i GROUP BY i")
_add("outlier_contexts", lambda s, d: s.createDataFrame([(x["column"], x["kind"], x["usable_pairs"]) for x in outliers.contexts(_spiked(s, d).drop("total"), "v", outcome="status")], "column string, kind string, usable_pairs long"), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS kind, count(*) FILTER (WHERE {c} IS NOT NULL AND total IS NOT NULL) AS usable_pairs FROM {{sales}}" for c, k in (("customer", "numeric"), ("status", "categorical"), ("ordered", "datetime"), ("priority", "categorical"), ("units", "numeric"), ("limit_", "numeric"))))


def _review(context: str) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        df = _spiked(s, d)
        flags = outliers.flagged(df, "v", *outliers.bounds(df, "v", "iqr")).select(ROW_ID)
        return outliers.review(df, "v", context, flags)["evidence"].withColumnRenamed(ROW_ID, "rid")

    return query


_FLAGS = f"f AS (SELECT rid FROM {_V}, ({_BOUNDS['iqr'][1]}) WHERE v < lower OR v > upper)"
_add("review_numeric", _review("units"), f"WITH {_FLAGS}, p AS (SELECT s.rid, v, units AS x, f.rid IS NOT NULL AS flag FROM {_V} s LEFT JOIN f ON f.rid = s.rid WHERE v IS NOT NULL), t AS (SELECT regr_slope(x, v) AS b, regr_intercept(x, v) AS a FROM p WHERE NOT flag), e AS (SELECT rid, flag, x - (b * v + a) AS e FROM p, t), q AS (SELECT stddev_samp(e) AS sd, list_sort(list(e))[count(*) // 2 + 1] AS m FROM e WHERE NOT flag) SELECT rid, CASE WHEN abs(e - m) <= 3 * sd THEN 'explained_by_context' ELSE 'still_unusual' END AS status FROM e, q WHERE flag")
_add("review_groups", _review("status"), f"WITH {_FLAGS}, p AS (SELECT rid, v, status FROM {_V} WHERE v IS NOT NULL AND status IS NOT NULL), g AS (SELECT status, count(*) AS n, list_sort(list(v))[CAST(floor((count(*) - 1) * 0.25 + 0.5) AS INT) + 1] AS q1, list_sort(list(v))[CAST(floor((count(*) - 1) * 0.75 + 0.5) AS INT) + 1] AS q3 FROM p GROUP BY status) SELECT f.rid, CASE WHEN g.status IS NULL OR n < 10 THEN 'insufficient_evidence' WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 'explained_by_context' ELSE 'still_unusual' END AS status FROM f LEFT JOIN p ON p.rid = f.rid LEFT JOIN g ON g.status = p.status")
_ROLL = f"SELECT rid, v, list_sort(list(v) OVER (ORDER BY ordered, rid ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) AS w FROM {_V} WHERE v IS NOT NULL"
_add("review_datetime", _review("ordered"), f"WITH {_FLAGS}, w AS ({_ROLL}) SELECT f.rid, CASE WHEN v BETWEEN w[CAST(floor(len(w) * 0.25) AS INT) + 1] AND w[CAST(least(len(w) - 1, floor(len(w) * 0.75)) AS INT) + 1] THEN 'explained_by_context' ELSE 'still_unusual' END AS status FROM f JOIN w ON w.rid = f.rid")
_add("rolling_band", lambda s, d: outliers.rolling_band(_spiked(s, d), "v", "ordered").select(qcol(ROW_ID).alias("rid"), "median", "low", "high"), f"SELECT rid, w[len(w) // 2 + 1] AS median, w[CAST(floor(len(w) * 0.25) AS INT) + 1] AS low, w[CAST(least(len(w) - 1, floor(len(w) * 0.75)) AS INT) + 1] AS high FROM ({_ROLL})")
_add("rolling_band_in_buckets", lambda s, d: outliers.rolling_band(_spiked(s, d), "v", "ordered", rows_per_bucket=2000).select(qcol(ROW_ID).alias("rid"), "median", "low", "high"), f"SELECT rid, w[len(w) // 2 + 1] AS median, w[CAST(floor(len(w) * 0.25) AS INT) + 1] AS low, w[CAST(least(len(w) - 1, floor(len(w) * 0.75)) AS INT) + 1] AS high FROM ({_ROLL})")
_add("visual_sample", lambda s, d: outliers.visual_sample(_spiked(s, d), "units", "v", _spiked(s, d).where("__rid % 400 = 0").select(ROW_ID)).withColumnRenamed(ROW_ID, "rid"), f"SELECT rid, x, y, flagged FROM (SELECT rid, units AS x, v AS y, rid % 400 = 0 AS flagged, row_number() OVER (PARTITION BY rid % 400 = 0 ORDER BY md5(CAST(rid AS VARCHAR) || ':42'), rid) AS k FROM {_V}) WHERE flagged OR k <= 3000")


def _association(s: SparkSession, d: str) -> DataFrame:
    """Pearson's r, and the trend without the flagged rows."""
    df = _spiked(s, d)
    found = outliers.review(df, "v", "units", df.where("__rid % 400 = 0").select(ROW_ID))
    return s.createDataFrame([(found["correlation"], found["trend"]["slope"], found["usable_pairs"])], "r double, slope double, n long").select(F.round("r", 6).alias("r"), F.round("slope", 12).alias("slope"), "n")


_add("pearson_r", _association, f"SELECT round(corr(v, units), 6) AS r, round(regr_slope(CASE WHEN rid % 400 <> 0 THEN units END, CASE WHEN rid % 400 <> 0 THEN v END), 12) AS slope, count(*) AS n FROM {_V} WHERE v IS NOT NULL AND units IS NOT NULL")

# --- validation, export, history ---------------------------------------------

_STEPS = [
    OperationSpec("treat_missing", "missingness", {"column": "status", "method": "constant", "value": "?"}, seq=1),
    OperationSpec("mask_values", "invalid_values", {"column": "units", "rule": {"type": "range", "max": 12}}, seq=2),
    OperationSpec("drop_rows", "structures", {"row_ids": list(range(0, 200))}, seq=3),
]
_AFTER = "(SELECT * REPLACE (coalesce(status, '?') AS status, CASE WHEN units > 12 THEN NULL ELSE units END AS units) FROM {sales} WHERE {rid} >= 200)"
_add("changed_cells", lambda s, d: validate.changed_cells(view(s, d, "sales"), replay(view(s, d, "sales"), _STEPS)), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE a.{c} IS DISTINCT FROM b.{c}) AS n_changed FROM {{sales}} a JOIN {_AFTER} b ON a.{{rid}} = b.{{rid}}" for c in _names("sales")))


def _summary(s: SparkSession, d: str) -> DataFrame:
    before = view(s, d, "sales")
    found = validate.validate(before, replay(before, _STEPS))
    names = ("rows_before", "rows_after", "missing_before", "missing_after", "cells_changed", "rows_changed")
    return s.createDataFrame([tuple(int(found[k]) for k in names)], ", ".join(f"{k} long" for k in names))


def _missing_sum(rows: str) -> str:
    return f"(SELECT {' + '.join(f'count(*) FILTER (WHERE {_missing(c)})' for c in _names('sales'))} FROM {rows})"


_add("validation_summary", _summary, f"SELECT (SELECT count(*) FROM {{sales}}) AS rows_before, (SELECT count(*) FROM {_AFTER}) AS rows_after, {_missing_sum('{sales}')} AS missing_before, {_missing_sum(_AFTER)} AS missing_after, count(*) FILTER (WHERE a.status IS NULL) + count(*) FILTER (WHERE a.units > 12) AS cells_changed, count(*) FILTER (WHERE a.status IS NULL OR a.units > 12) AS rows_changed FROM {{sales}} a WHERE {{rid}} >= 200")
_add("duplicate_rows", lambda s, d: s.createDataFrame([(validate.duplicate_rows(view(s, d, "parts").select(ROW_ID, "brand", "size")),)], "n long"), "SELECT CAST(sum(n - 1) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM {parts} GROUP BY brand, size)")
_add("operation_preview", lambda s, d: validate.preview(view(s, d, "sales"), replay(view(s, d, "sales"), _STEPS[:2]))["affected"].toDF("rid"), "SELECT {rid} AS rid FROM {sales} WHERE status IS NULL OR units > 12")
_add("formula_escape", lambda s, d: sinks.exported(view(s, d, "people").select(ROW_ID, "formula", F.col(ROW_ID).alias("rid"))), "SELECT CASE WHEN regexp_matches(formula, '^\\s*[=+\\-@]') THEN '''' || formula ELSE formula END AS formula, {rid} AS rid FROM {people}")


def _scanned(s: SparkSession, d: str) -> DataFrame:
    """A table written as CSV by the sink and read again with inferred types."""
    path = scratch_path(s, "scan.csv")
    sinks.write_csv(view(s, d, "people").select(F.col(ROW_ID).alias("rid"), "nation", "age", "code", "note", "price"), path)
    return csv.read_csv(s, path, encoding="utf-8", delimiter=",").select(F.col("rid").cast("long").alias("rid"), F.col("nation").cast("int").alias("nation"), "age", "code", "note", "price")


_add("csv_scan", _scanned, "SELECT {rid} AS rid, nation, age, CASE WHEN code LIKE '-%' THEN '''' || code ELSE code END AS code, note, price FROM {people}")


def _flagged_rows(s: SparkSession, d: str) -> DataFrame:
    df = view(s, d, "parts")
    reasons = sinks.flag_reasons({"size": df.where("size > 45").select(ROW_ID)}, duplicates.exact_members(df, _DUP))
    return sinks.flagged_records(df, reasons).select(qcol(ROW_ID).alias("rid"), F.col("__flag_reason").alias("reason"))


_add("flagged_records", _flagged_rows, f"SELECT rid, string_agg(reason, ';' ORDER BY reason) AS reason FROM (SELECT {{rid}} AS rid, 'outlier:size' AS reason FROM {{parts}} WHERE size > 45 UNION SELECT rid, 'duplicate_group' FROM (SELECT rid, count(*) OVER (PARTITION BY brand, type, size) AS n FROM {_PARTS}) WHERE n > 1) GROUP BY rid")


def _history(s: SparkSession, d: str) -> DataFrame:
    """Three operations with a checkpoint, undone to one and redone to two."""
    past = History.start(view(s, d, "sales"), scratch_path(s, "history"), every=2)
    for step in _STEPS:
        past.apply(step.op_type, step.params, step.stage)
    for _ in range(2):
        past.undo()
    return past.redo().select(qcol(ROW_ID).alias("rid"), "status", "units")




def _resolution(s: SparkSession, d: str) -> DataFrame:
    """A resolution on record, undone and redone: the first of each group of duplicates stays."""
    past = History.start(view(s, d, "parts"), scratch_path(s, "history"))
    past.apply("resolve_duplicates", {"columns": _DUP, "how": "keep_first"}, "duplicates")
    past.undo()
    return past.redo().select(qcol(ROW_ID).alias("rid"))


_add("undo_redo_resolution", _resolution, f"SELECT min(rid) AS rid FROM {_PARTS} GROUP BY brand, type, size")
_add("undo_redo_replay", _history, "SELECT {rid} AS rid, coalesce(status, '?') AS status, CASE WHEN units > 12 THEN NULL ELSE units END AS units FROM {sales}")


def queries() -> dict[str, Query]:
    from scrubjay.plans import catalogue_flow

    return _QUERIES | catalogue_flow.QUERIES


def oracle_sql() -> dict[str, str]:
    from scrubjay.plans import catalogue_flow

    return _SQL | catalogue_flow.SQL
