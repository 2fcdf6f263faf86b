"""What leaves the library: safe CSV, flagged rows, report, configuration, script, bundle."""

from __future__ import annotations

import html
import json
from functools import reduce
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrubjay.functions.columns import qcol
from scrubjay.operators import OperationSpec
from scrubjay.session import ROW_ID
from scrubjay.sources import store


def escaped(c: Column) -> Column:
    """Text that a spreadsheet won't take for a formula."""
    return F.when(c.rlike(r"^\p{IsWhite_Space}*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def exported(df: DataFrame) -> DataFrame:
    """The frame without row ids, its texts escaped."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*(escaped(qcol(c)).alias(c) if c in text else qcol(c) for c in df.columns if c != ROW_ID))


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    exported(df).write.option("header", True).option("encoding", encoding).option("escape", '"').csv(path)


def flag_reasons(outliers: dict[str, DataFrame] | None = None, duplicate_rows: DataFrame | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """(row id, reason) from flagged rows, exact members and clusters."""
    parts = [df.select(ROW_ID, F.lit(f"outlier:{c}").alias("reason")) for c, df in (outliers or {}).items()]
    if duplicate_rows is not None:
        parts.append(duplicate_rows.select(ROW_ID, F.lit("duplicate_group").alias("reason")))
    if clusters is not None:
        parts.append(clusters.select(F.col("representative").alias(ROW_ID), F.lit("duplicate_cluster_rep").alias("reason")))
        parts.append(clusters.select(F.col("member").alias(ROW_ID), F.lit("duplicate_cluster_member").alias("reason")))
    if not parts:
        raise ValueError("nothing is flagged")
    return reduce(DataFrame.union, parts).distinct()


def flagged_records(df: DataFrame, reasons: DataFrame) -> DataFrame:
    """The flagged rows with ``__flag_reason``, their reasons joined by ``;``; reasons are few kinds per row."""
    joined = reasons.groupBy(ROW_ID).agg(F.array_join(F.array_sort(F.collect_set("reason")), ";").alias("__flag_reason"))
    return df.join(joined, ROW_ID).select(*map(qcol, df.columns), "__flag_reason")


def html_report(title: str, summary: dict, specs: list[OperationSpec]) -> str:
    """Counts and parameters, no rows of data; all text is escaped."""
    cell = lambda x: html.escape(json.dumps(x, default=str, ensure_ascii=False) if isinstance(x, (dict, list)) else str(x))
    facts = "".join(f"<tr><th>{cell(k)}</th><td>{cell(v)}</td></tr>" for k, v in summary.items())
    ops = "".join(f"<li>{cell(s.op_type)} <code>{cell(s.params)}</code></li>" for s in specs)
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{cell(title)}</title></head><body><h1>{cell(title)}</h1><table>{facts}</table><h2>Operations</h2><ol>{ops}</ol></body></html>"


def config_json(specs: list[OperationSpec], source: dict | None = None) -> str:
    """What a replay needs."""
    return json.dumps({"source": source or {}, "operations": [s.to_dict() for s in specs]}, indent=1, default=str)


def script(specs: list[OperationSpec], source: dict, columns: list[str] | None = None, rows: int | None = None) -> str:
    """A PySpark script that replays the operations on the same kind of source and checks the result."""
    checks = ""
    if rows is not None:
        checks += f"assert df.count() == {rows}, 'rows'\n"
    if columns is not None:
        checks += f"assert [c for c in df.columns if c != ROW_ID] == {columns!r}, 'columns'\n"
    steps = "".join(f"df = execute(df, {s.op_type!r}, json.loads({json.dumps(s.params, default=str)!r}))\n" for s in specs)
    return (
        "import json\nimport sys\n\nfrom pyspark.sql import SparkSession\n\nfrom scrubjay.operators import execute\nfrom scrubjay.session import ROW_ID, configure\nfrom scrubjay.sources.csv import read_csv\n\n"
        f"spark = configure(SparkSession.builder.getOrCreate())\ndf = read_csv(spark, sys.argv[1], encoding={source.get('encoding', 'utf-8')!r}, delimiter={source.get('delimiter', ',')!r})\n"
        f"{steps}{checks}df.drop(ROW_ID).write.mode('overwrite').option('header', True).csv(sys.argv[2])\n"
    )


def gate(warnings: list[str], acknowledged: bool) -> None:
    """Exports with open warnings need a yes."""
    if warnings and not acknowledged:
        raise ValueError("open warnings: " + "; ".join(warnings))


def bundle(files: dict[str, str | bytes], path: str, spark: SparkSession | None = None) -> None:
    """Small files (report, configuration, script) as one archive with a manifest, in any store that Spark writes to."""
    with store.open_write(spark or SparkSession.active(), path) as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as out:
        for name, data in files.items():
            out.writestr(name, data)
        out.writestr("manifest.json", json.dumps(sorted(files)))
