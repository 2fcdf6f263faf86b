"""What an operation is on record: its type, stage and parameters; and the registry that runs it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
import json
import uuid

from pyspark.sql import DataFrame

Builder = Callable[[DataFrame, dict], DataFrame]

#: Operations by type.
REGISTRY: dict[str, Builder] = {}
#: Types that need only the row itself, so they also run on streams.
ROW_LOCAL: set[str] = set()


def operation(name: str, row_local: bool = False) -> Callable[[Builder], Builder]:
    """Register a builder under a type."""

    def add(build: Builder) -> Builder:
        REGISTRY[name] = build
        if row_local:
            ROW_LOCAL.add(name)
        return build

    return add


@dataclass(frozen=True)
class OperationSpec:
    """One recorded operation."""

    op_type: str
    stage: str
    params: dict
    target_columns: list[str] = field(default_factory=list)
    op_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    seq: int = 0
    created_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: dict) -> OperationSpec:
        return cls(**data)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), default=str)


def execute(df: DataFrame, op_type: str, params: dict) -> DataFrame:
    """The frame after one operation."""
    build = REGISTRY.get(op_type)
    if build is None:
        raise ValueError(f"unknown operation: {op_type}")
    return build(df, params)


def replay(df: DataFrame, specs: list[OperationSpec]) -> DataFrame:
    """The frame after a list of operations, as one plan."""
    for spec in specs:
        df = execute(df, spec.op_type, spec.params)
    return df
