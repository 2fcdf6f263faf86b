"""Small frames with row ids."""

from scrubjay.functions.columns import qcol
from scrubjay.session import ROW_ID


def frame(spark, schema, rows, partitions=2):
    data = [(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"{ROW_ID} long, {schema}").repartition(partitions)


def column(df, name):
    """Values of a column in the order of the ids."""
    return [r[0] for r in df.orderBy(ROW_ID).select(qcol(name)).collect()]
