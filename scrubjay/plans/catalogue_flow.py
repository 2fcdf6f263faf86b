"""Queries of what surrounds the operations: sources, sinks, decisions, streams; with SQL for each."""

from __future__ import annotations

import io
import json
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubjay.assessments import keys, profile, text, typing
from scrubjay.functions.columns import qcol
from scrubjay.operators import OperationSpec, execute, replay
from scrubjay.plans import duplicates, outliers, validate
from scrubjay.plans.catalogue import _DUP, _KEYED, _LINES_PAIRS, _PARTS, VIEWS, Query, _keyed, _lines, _spiked, view, view_sql
from scrubjay.plans.lineage import History
from scrubjay.plans.project import Project
from scrubjay.session import ROW_ID, scratch_path
from scrubjay.sources import csv, excel, preview, sinks, store
from scrubjay.streaming.ops import clean_stream

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    """Register a function under its name, with its SQL."""

    def add(query: Query) -> Query:
        name, own = query.__name__.strip("_"), sql
        for v in VIEWS:
            own = own.replace("{" + v + "}", view_sql(v))
        QUERIES[name], SQL[name] = query, own.replace("{rid}", '"__rid"')
        return query

    return add


def _rows(s: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return s.createDataFrame(rows, schema)


# --- sources -----------------------------------------------------------------


def _file(s: SparkSession, df: DataFrame, **options) -> str:
    """The frame as one CSV file in the order of its ids; its path."""
    folder = scratch_path(s, "one.csv")
    df.orderBy("rid").coalesce(1).write.options(header=True, escape='"', **options).csv(folder)
    return s.read.text(folder).inputFiles()[0]


@_query("SELECT * FROM (VALUES (',', 'utf-8'), (';', 'utf-8'), ('|', 'utf-8'), (';', 'utf-16')) t(delimiter, encoding)")
def csv_detection(s: SparkSession, d: str) -> DataFrame:
    """Encoding and delimiter of files that were written with several."""
    df = view(s, d, "sales").select(qcol(ROW_ID).alias("rid"), "status", "priority", "units")
    found = [csv.detect(s, _file(s, df, sep=sep, encoding=encoding)) for sep, encoding in ((",", "UTF-8"), (";", "UTF-8"), ("|", "UTF-8"), (";", "UTF-16"))]
    return _rows(s, [(x["delimiter"], x["encoding"]) for x in found], "delimiter string, encoding string")


@_query("SELECT {rid} AS rid, status, row_number() OVER (ORDER BY {rid}) - 1 AS row_index FROM {sales}")
def csv_row_ids(s: SparkSession, d: str) -> DataFrame:
    """Detection, scan and row ids in the order of the file."""
    df = view(s, d, "sales").select(qcol(ROW_ID).alias("rid"), "status", "units")
    return csv.read_csv(s, _file(s, df)).select(F.col("rid").cast("long").alias("rid"), "status", qcol(ROW_ID).alias("row_index"))


@_query("SELECT {rid} AS rid, CASE WHEN {rid} % 3 = 0 THEN status || chr(10) || 'of \"' || priority || '\",' || chr(10) || 'end' ELSE priority END AS note, units FROM {sales}")
def csv_quoted_lines(s: SparkSession, d: str) -> DataFrame:
    """Fields with line breaks, quotes and delimiters, written by the sink and read again in ranges."""
    note = F.when(F.col(ROW_ID) % 3 == 0, F.concat("status", F.lit('\nof "'), "priority", F.lit('",\nend'))).otherwise(F.col("priority"))
    path = scratch_path(s, "quoted.csv")
    sinks.write_csv(view(s, d, "sales").select(qcol(ROW_ID).alias("rid"), note.alias("note"), "units"), path)
    return csv.read_csv(s, path, encoding="utf-8", delimiter=",").select(F.col("rid").cast("long").alias("rid"), "note", F.col("units").cast("int").alias("units"))


@_query("SELECT * FROM (VALUES ('csv', 'csv'), ('txt', 'csv'), ('xlsx', 'xlsx'), ('xls', 'refused')) t(named, kind)")
def file_kinds(s: SparkSession, d: str) -> DataFrame:
    """What files are by their first bytes; one that is named for something else is refused."""
    head = csv.head_of(s, _file(s, view(s, d, "sales").select(qcol(ROW_ID).alias("rid"), "status")))
    with tempfile.NamedTemporaryFile(suffix=".xlsx") as out:
        excel.write_xlsx({"region": s.read.parquet(f"{d}/region.parquet")}, out.name)
        book = out.read()
    found = []
    for named, data in (("csv", head), ("txt", head), ("xlsx", book), ("xls", book)):
        try:
            found.append((named, csv.kind_of(data, named)))
        except ValueError:
            found.append((named, "refused"))
    return _rows(s, found, "named string, kind string")


@_query("SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def xlsx_scan(s: SparkSession, d: str) -> DataFrame:
    """A table written as a workbook and read again."""
    with tempfile.NamedTemporaryFile(suffix=".xlsx") as out:  # a workbook is a file of the driver's
        excel.write_xlsx({"supplier": s.read.parquet(f"{d}/supplier.parquet")}, out.name)
        (sheet,) = excel.read_workbook(s, out.read(), "xlsx").values()
    return sheet.drop(ROW_ID).withColumn("s_acctbal", F.col("s_acctbal").cast("double"))


@_query("SELECT {rid} AS rid, CASE WHEN {rid} % 5 <> 0 THEN total END AS total FROM {sales}")
def nan_to_null(s: SparkSession, d: str) -> DataFrame:
    df = view(s, d, "sales").select(ROW_ID, F.expr("CASE WHEN __rid % 5 = 0 THEN double('NaN') ELSE total END").alias("total"))
    return csv.sanitized(df).withColumnRenamed(ROW_ID, "rid")


@_query("SELECT count(*) AS n_rows, CAST(7 AS BIGINT) AS n_columns, (SELECT string_agg(CAST(customer AS VARCHAR), ',' ORDER BY {rid}) FROM (SELECT * FROM {sales} ORDER BY {rid} LIMIT 20)) AS customers FROM {sales}")
def table_preview(s: SparkSession, d: str) -> DataFrame:
    seen = preview.preview(view(s, d, "sales"), 20)
    return _rows(s, [(seen["n_rows"], seen["n_columns"], ",".join(str(r["customer"]) for r in seen["rows"]))], "n_rows long, n_columns long, customers string")


@_query("SELECT {rid} AS rid, customer FROM {sales} WHERE total IS NULL ORDER BY {rid} LIMIT 10")
def missing_rows_peek(s: SparkSession, d: str) -> DataFrame:
    return _rows(s, [(r[ROW_ID], r["customer"]) for r in preview.missing_rows(view(s, d, "sales"), "total")], "rid long, customer long")


# --- assessments -------------------------------------------------------------


@_query("WITH v AS (SELECT DISTINCT trim(joined) AS v FROM (SELECT joined FROM {people} WHERE joined IS NOT NULL ORDER BY {rid} LIMIT 300)) SELECT 'date' AS kind, '%Y-%m-%d' AS format, CAST(count(*) FILTER (WHERE try_strptime(v, '%Y-%m-%d') IS NULL) AS INT) AS n_bad, false AS ambiguous FROM v")
def date_formats(s: SparkSession, d: str) -> DataFrame:
    values = profile.first_values(view(s, d, "people"), ["joined"])["joined"]
    kind, fmt, bad, ambiguous = typing.date_formats(values)
    return _rows(s, [(kind, fmt, len(bad), ambiguous)], "kind string, format string, n_bad int, ambiguous boolean")


_DAYS = "(SELECT joined, CASE WHEN {rid} % 9 = 0 THEN 'soon' ELSE strftime(DATE '2020-01-01' + CAST({rid} % 700 AS INT), '%d/%m/%Y') END AS day, CASE WHEN {rid} % 4 = 0 THEN '25:10' ELSE CAST({rid} % 24 AS VARCHAR) || ':' || CAST(10 + {rid} % 50 AS VARCHAR) END AS clock FROM {people})"


@_query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{f}' AS format, count({c}) AS n, count({c}) FILTER (WHERE try_strptime({c}, '{f}') IS NULL) AS n_misfits FROM {_DAYS}" for c, f in (("joined", "%Y-%m-%d"), ("day", "%d/%m/%Y"), ("clock", "%H:%M"))))
def column_formats(s: SparkSession, d: str) -> DataFrame:
    """Formats of whole columns, and how many values don't fit them."""
    df = view(s, d, "people").selectExpr(
        ROW_ID,
        "joined",
        f"CASE WHEN {ROW_ID} % 9 = 0 THEN 'soon' ELSE date_format(date_add(DATE '2020-01-01', CAST({ROW_ID} % 700 AS INT)), 'dd/MM/yyyy') END AS day",
        f"CASE WHEN {ROW_ID} % 4 = 0 THEN '25:10' ELSE CAST({ROW_ID} % 24 AS STRING) || ':' || CAST(10 + {ROW_ID} % 50 AS STRING) END AS clock",
    )
    return _rows(s, [(c, x["format"], x["n"], x["n_misfits"]) for c, x in typing.column_formats(df, ["joined", "day", "clock"]).items()], "column string, format string, n long, n_misfits long")


@_query("SELECT * FROM (SELECT 'price' AS \"column\", CASE WHEN avg(CAST(price LIKE '$%' AS INT)) > 0.8 THEN 'currency' END AS kind FROM {people} UNION ALL SELECT 'share', CASE WHEN avg(CAST(trim(share) LIKE '%!%' ESCAPE '!' AS INT)) > 0.8 THEN 'percent' END FROM {people} UNION ALL SELECT 'comma', CASE WHEN avg(CAST(TRY_CAST(replace(replace(comma, '.', ''), ',', '.') AS DOUBLE) IS NOT NULL AND comma LIKE '%,%' AS INT)) > 0.8 THEN 'decimal_separator' END FROM {people} UNION ALL SELECT 'flag', CASE WHEN avg(CAST(lower(trim(flag)) IN ('y', 'yes', 'true', 't', '1', 'n', 'no', 'false', 'f', '0') AS INT)) = 1 THEN 'boolean' END FROM {people} WHERE flag <> 'maybe' UNION ALL SELECT 'code', NULL) WHERE kind IS NOT NULL")
def format_candidates(s: SparkSession, d: str) -> DataFrame:
    df = view(s, d, "people").select(ROW_ID, "price", "share", "comma", "code", F.expr("CASE WHEN flag = 'maybe' THEN 'y' ELSE flag END").alias("flag"))
    return _rows(s, [(x["column"], x["kind"]) for x in text.format_candidates(df)], "column string, kind string")


@_query("SELECT {rid} AS rid, strftime(ts, '%H:%M:%S') AS value FROM {readings}")
def convert_time(s: SparkSession, d: str) -> DataFrame:
    df = view(s, d, "readings").select(ROW_ID, F.date_format("ts", "HH.mm.ss").alias("value"))
    done = execute(df, "convert_type", {"column": "value", "target_type": "time", "format": "%H.%M.%S"})
    return done.select(qcol(ROW_ID).alias("rid"), F.col("value").cast("string").alias("value"))


@_query("SELECT unit, sample FROM (SELECT unit, sample, row_number() OVER (PARTITION BY unit ORDER BY sample) AS k FROM (SELECT DISTINCT CASE WHEN weight LIKE '%kg' THEN 'kg' WHEN weight LIKE '% lb' THEN 'lb' ELSE '€' END AS unit, weight AS sample FROM {people} WHERE weight LIKE '%kg' OR weight LIKE '% lb' OR weight LIKE '€%')) WHERE k <= 3")
def unit_samples(s: SparkSession, d: str) -> DataFrame:
    found = text.units(view(s, d, "people"), "weight")["groups"]
    return _rows(s, [(g["unit"], x) for g in found for x in g["samples"]], "unit string, sample string")


@_query("SELECT (SELECT count(*) FROM {people} WHERE weight = 'junk') AS n_unmatched, 'junk,junk,junk' AS unmatched, (SELECT count(*) FROM {people} WHERE regexp_matches(weight, '^[0-9]+$')) AS n_plain")
def unmatched_units(s: SparkSession, d: str) -> DataFrame:
    found = text.units(view(s, d, "people"), "weight")
    return _rows(s, [(found["n_unmatched"], ",".join(found["unmatched"]), found["n_plain"])], "n_unmatched long, unmatched string, n_plain long")


@_query(
    f"WITH g AS (SELECT l_orderkey, l_linenumber FROM ({_KEYED}) GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) > 1 OR count(DISTINCT l_suppkey) + CAST(count(l_suppkey) < count(*) AS INT) > 1 ORDER BY 1, 2 LIMIT 50), "
    f"v AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS v FROM ({_KEYED}) SEMI JOIN g USING (l_orderkey, l_linenumber)), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY v) AS k, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM v) "
    "SELECT l_orderkey, l_linenumber, string_agg(v, ',' ORDER BY v) FILTER (WHERE n > 1) AS part_keys FROM k WHERE k <= 5 GROUP BY 1, 2"
)
def key_conflict_values(s: SparkSession, d: str) -> DataFrame:
    """The first conflicting keys with the values that differ."""
    found = keys.key_conflicts(_keyed(s, d), ["l_orderkey", "l_linenumber"])
    rows = [(x["key"]["l_orderkey"], x["key"]["l_linenumber"], ",".join(x["values"]["l_partkey"]) if "l_partkey" in x["values"] else None) for x in found]
    return _rows(s, rows, "l_orderkey long, l_linenumber int, part_keys string")


# --- duplicates --------------------------------------------------------------

_BLOCKED = f"SELECT x.rid AS a, y.rid AS b FROM {_PARTS} x JOIN {_PARTS} y ON x.brand = y.brand AND x.rid < y.rid AND x.type IS NOT DISTINCT FROM y.type AND x.size = y.size"


@_query(f"SELECT representative, count(*) AS n_members FROM (SELECT a AS representative FROM ({_BLOCKED}) UNION ALL SELECT b FROM ({_BLOCKED})) GROUP BY 1")
def dup_cluster_sizes(s: SparkSession, d: str) -> DataFrame:
    return duplicates.linked(view(s, d, "parts").drop("name"), _DUP, ["brand"], 100)


@_query(f"SELECT a, b, CASE WHEN size_a = size_b THEN 'brand,type,size' ELSE 'brand,type' END AS matching, CASE WHEN size_a = size_b THEN '' ELSE 'size' END AS differing FROM (SELECT x.rid AS a, y.rid AS b, x.size AS size_a, y.size AS size_b FROM {_PARTS} x JOIN {_PARTS} y ON x.brand = y.brand AND x.rid <> y.rid AND x.type IS NOT DISTINCT FROM y.type)")
def dup_cluster_columns(s: SparkSession, d: str) -> DataFrame:
    """Members of clusters by brand and type, with the columns in which they agree and differ."""
    lists = duplicates.cluster_lists(view(s, d, "parts"), ["brand", "type"], ["brand"], 100, _DUP)
    found = duplicates.cluster_members(lists.withColumns({c: F.array_join(c, ",") for c in ("matching", "differing")}))
    return found.select(F.col("representative").alias("a"), F.col("member").alias("b"), "matching", "differing")


@_query(f"SELECT rid, brand, type FROM {_PARTS}")
def dup_prepared(s: SparkSession, d: str) -> DataFrame:
    return duplicates.prepared(view(s, d, "parts"), _DUP).select(qcol(ROW_ID).alias("rid"), "brand", "type")


@_query(f"SELECT CAST(round(100 * matches / 5) AS INT) AS pct, count(*) AS n_pairs FROM ({_LINES_PAIRS}) WHERE matches >= 4 GROUP BY 1")
def dup_attainable(s: SparkSession, d: str) -> DataFrame:
    """How many pairs of classes attain each percentage that five fields can have."""
    columns = ["status", "priority", "u", "l", "m"]
    pairs = duplicates.class_pairs(_lines(s, d), columns, ["c"], 80, guard=False)
    pct = F.element_at(F.array(*map(F.lit, duplicates.attainable(len(columns)))), F.col("matches") + 1)
    return pairs.groupBy(pct.alias("pct")).agg(F.count("*").alias("n_pairs"))


# --- decisions, stages, exports ----------------------------------------------


def _log(s: SparkSession, d: str) -> outliers.OutlierLog:
    """Large totals flagged by a table, reviewed, some of them decided on."""
    df = _spiked(s, d)
    log = outliers.OutlierLog()
    flags = outliers.flagged(df, "v", 1000, 300_000)
    log.flag("v", flags)
    log.add_evidence("v", "units", flags.select(ROW_ID, F.lit(outliers.UNUSUAL).alias("status")))
    log.decide("v", [r[0] for r in flags.where("__rid < 400").select(ROW_ID).collect()], "valid_extreme")
    return log


_FLAGGED = "(SELECT {rid} AS rid FROM {sales} WHERE CASE WHEN {rid} % 400 = 0 THEN total * 9 ELSE total END NOT BETWEEN 1000 AND 300000)"


@_query(f"SELECT (SELECT count(*) FROM {_FLAGGED}) AS n_flagged, (SELECT count(*) FROM {_FLAGGED} WHERE rid >= 400) AS unresolved")
def outlier_decisions(s: SparkSession, d: str) -> DataFrame:
    log = _log(s, d)
    return _rows(s, [(log.data["columns"]["v"]["n_flagged"], log.unresolved(spark=s))], "n_flagged long, unresolved long")


@_query(f"SELECT s.{{rid}} AS rid, CASE WHEN f.rid IS NULL THEN CASE WHEN s.{{rid}} % 400 = 0 THEN total * 9 ELSE total END END AS v FROM {{sales}} s LEFT JOIN {_FLAGGED} f ON f.rid = s.{{rid}}")
def outlier_treatment(s: SparkSession, d: str) -> DataFrame:
    """All flagged rows set missing, by their table."""
    op, params = _log(s, d).treatment("v", None, "set_missing")
    done = execute(_spiked(s, d), op, params)
    return done.select(qcol(ROW_ID).alias("rid"), "v")


@_query("SELECT stage, outdated, n FROM (VALUES ('missingness', 'duplicates,keys,profile,validation'), ('invalid_values', 'duplicates,keys,profile,validation'), ('univariate', 'validation')) t(stage, outdated), (SELECT count(*) FILTER (WHERE status IS NULL) AS a, count(*) FILTER (WHERE units > 12) AS b, count(*) FILTER (WHERE {rid} < 200) AS c FROM {sales}), LATERAL (SELECT CASE stage WHEN 'missingness' THEN a WHEN 'invalid_values' THEN b ELSE c END AS n)")
def stage_states(s: SparkSession, d: str) -> DataFrame:
    """Completed stages that operations of a history make outdated, and how many cells or rows each changed."""
    past = History.start(view(s, d, "sales"), scratch_path(s, "history"))
    out = []
    for op, stage, params in (("fill_null_constant", "missingness", {"column": "status", "value": "?"}), ("mask_values", "invalid_values", {"column": "units", "rule": {"type": "range", "max": 12}}), ("drop_rows", "univariate", {"row_ids": list(range(200))})):
        for done in ("profile", "duplicates", "keys", "validation") if stage != "univariate" else ("missingness", "validation"):
            past.mark(done, "completed")
        before, states = past.working(), dict(past.states)
        after = past.apply(op, params, stage)
        changed = before.count() - after.count() or sum(r.n_changed for r in validate.changed_cells(before, after).collect())
        out.append((stage, ",".join(sorted(k for k, v in past.states.items() if v == "outdated" and states[k] == "completed")), changed))
    return _rows(s, out, "stage string, outdated string, n long")


_STEPS = [
    OperationSpec("fill_null_constant", "missingness", {"column": "status", "value": "?"}, seq=1),
    OperationSpec("mask_values", "invalid_values", {"column": "units", "rule": {"type": "range", "max": 12}}, seq=2),
]


@_query("SELECT coalesce(status, '?') AS status, count(*) AS n, count(*) FILTER (WHERE units <= 12) AS n_units FROM {sales} GROUP BY 1")
def bundle_manifest(s: SparkSession, d: str) -> DataFrame:
    """Configuration, report and script of a table in an archive on the shared store, read back and replayed on the table."""
    df, path = view(s, d, "sales"), f"{scratch_path(s, 'bundle')}.zip"
    sinks.bundle({"config.json": sinks.config_json(_STEPS), "report.html": sinks.html_report("sales", {"rows": df.count()}, _STEPS), "run.py": sinks.script(_STEPS, {})}, path)
    with zipfile.ZipFile(io.BytesIO(store.read_bytes(s, path))) as archive:
        assert set(archive.namelist()) == {*json.loads(archive.read("manifest.json")), "manifest.json"}
        steps = json.loads(archive.read("config.json"))["operations"]
    done = replay(df, [OperationSpec.from_dict(x) for x in steps])
    return done.groupBy("status").agg(F.count("*").alias("n"), F.count("units").alias("n_units"))


@_query("SELECT {rid} AS rid, coalesce(status, '?') AS status, CASE WHEN units > 12 THEN NULL ELSE units END AS units FROM {sales}")
def config_replay(s: SparkSession, d: str) -> DataFrame:
    """The operations of an exported configuration, replayed."""
    df = view(s, d, "sales")
    for x in json.loads(sinks.config_json(_STEPS))["operations"]:
        df = execute(df, x["op_type"], x["params"])
    return df.select(qcol(ROW_ID).alias("rid"), "status", "units")


@_query("SELECT * FROM (SELECT 'rows assessed' AS what, 2 * count(*) AS n FROM {sales} UNION ALL SELECT 'operations', 1 UNION ALL SELECT 'warnings', 1 UNION ALL SELECT 'exported rows', (SELECT count(*) FROM {sales}) UNION ALL SELECT 'report', 1)")
def project_flow(s: SparkSession, d: str) -> DataFrame:
    """Cached assessments, an operation, a key that doesn't hold, an excluded item."""
    project = Project(s, scratch_path(s, "project"))
    item, made = project.add("sales", view(s, d, "sales")), []
    project.add("parts", view(s, d, "parts"))
    for _ in range(2):
        item.assess("profile", lambda df: made.append(df.count()))
    item.apply("fill_null_constant", {"column": "status", "value": "?"}, "missingness")
    item.assess("profile", lambda df: made.append(df.count()))
    item.declare_key(["customer"])
    project.set_status("parts", "excluded")
    project = Project.open(s, project.folder)  # from its folder alone
    out = project.export(["csv", "report"], acknowledged=True)
    rows = [("rows assessed", sum(made)), ("operations", project.items["sales"].history.pointer), ("warnings", len(project.warnings())), ("exported rows", s.read.option("header", True).csv(out["sales.csv"]).count()), ("report", int("declared" in out["sales.html"] or "key" in out["sales.html"]))]
    return _rows(s, rows, "what string, n long")


@_query("SELECT {rid} AS rid, customer, units FROM {sales}")
def csv_reread(s: SparkSession, d: str) -> DataFrame:
    """A file read with a wrong delimiter, and read again with the right one as long as nothing is recorded."""
    path = scratch_path(s, "again.csv")
    view(s, d, "sales").select(qcol(ROW_ID).alias("rid"), "customer", "units").write.options(header=True, sep=";").csv(path)
    item = Project(s, scratch_path(s, "project")).add("sales", csv.read_csv(s, path, "utf-8", ","))
    assert len(item.history.working().columns) == 2
    item.reread(s, path, "utf-8", ";")
    return item.history.working().select(F.col("rid").cast("long").alias("rid"), F.col("customer").cast("long").alias("customer"), F.col("units").cast("int").alias("units"))


@_query("SELECT * FROM (SELECT 'rows_before' AS what, count(*) AS n FROM {sales} UNION ALL SELECT 'rows_removed', count(*) FILTER (WHERE {rid} < 50) FROM {sales} UNION ALL SELECT 'cells_changed', count(*) FILTER (WHERE status IS NULL AND {rid} >= 50) FROM {sales} UNION ALL SELECT 'operations_applied', 2)")
def export_report(s: SparkSession, d: str) -> DataFrame:
    """Figures that an exported report shows, read from its HTML."""
    project = Project(s, scratch_path(s, "project"))
    item = project.add("sales", view(s, d, "sales"))
    item.apply("fill_null_constant", {"column": "status", "value": "?"}, "missingness")
    item.apply("drop_rows", {"row_ids": list(range(50))}, "duplicates")
    text = project.export(["report"], acknowledged=True)["sales.html"]
    names = ("rows_before", "rows_removed", "cells_changed", "operations_applied")
    return _rows(s, [(n, int(re.search(f"<th>{n}</th><td>([0-9]+)</td>", text).group(1))) for n in names], "what string, n long")


@_query("SELECT {rid} AS rid, status AS before, '?' AS after FROM {sales} WHERE status IS NULL ORDER BY {rid} LIMIT 10")
def preview_examples(s: SparkSession, d: str) -> DataFrame:
    """The first rows by id that an operation would change."""
    df = view(s, d, "sales").select(ROW_ID, "status")
    found = validate.preview(df, execute(df, "fill_null_constant", {"column": "status", "value": "?"}))
    return _rows(s, [(x["row_id"], x["before"]["status"], x["after"]["status"]) for x in found["examples"]], "rid long, before string, after string")


@_query("SELECT {rid} AS rid, coalesce(status, '?') AS status, CASE WHEN units > 12 THEN NULL ELSE units END AS units FROM {sales}")
def stream_clean(s: SparkSession, d: str) -> DataFrame:
    """The same operations on a stream that takes all there is and stops."""
    table, columns = VIEWS["sales"]
    path = f"{d}/{table}*.parquet"
    rows = s.readStream.schema(s.read.parquet(f"{d}/{table}.parquet").schema).parquet(path).select(*(F.expr(e).alias(c) for c, e in columns.items()))
    done = clean_stream(rows, _STEPS).select(qcol(ROW_ID).alias("rid"), "status", "units")
    out = scratch_path(s, "stream")
    done.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(done.schema).parquet(out)
