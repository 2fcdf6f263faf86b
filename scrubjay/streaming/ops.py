"""Row-local operations on streams; those that need the whole table are refused."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scrubjay.operators import ROW_LOCAL, OperationSpec, execute

#: Registered as row-local, but with parameters that bring in a second table.
_NEEDS_TABLE = {"drop_rows": "row_ids"}
_MOST = 200


def clean_stream(stream: DataFrame, specs: list[OperationSpec]) -> DataFrame:
    """A streaming frame after operations that only need the row itself."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    for spec in specs:
        if spec.op_type not in ROW_LOCAL:
            raise ValueError(f"{spec.op_type} needs the whole table and can't run on a stream")
        if spec.params.get("row_table"):
            raise ValueError(f"{spec.op_type} of a table's rows can't run on a stream")
        listed = spec.params.get(_NEEDS_TABLE.get(spec.op_type, ""), ())
        if len(listed) > _MOST:
            raise ValueError(f"{spec.op_type} with more than {_MOST} entries can't run on a stream")
        stream = execute(stream, spec.op_type, spec.params)
    return stream
