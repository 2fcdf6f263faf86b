"""A table's history: the original, a log of operations, a pointer, and checkpoints.

The working frame is a plan: the nearest checkpoint with the operations after
it.  Undo and redo move the pointer; every few operations the frame is written,
which cuts the plan.  Each step is written to the folder's journal before it
counts, so a history is opened from its folder alone, and of two writers the
second is refused.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from scrubjay.functions.columns import with_row_id
from scrubjay.operators import OperationSpec, execute, replay
from scrubjay.plans import stages
from scrubjay.session import ROW_ID
from scrubjay.sources.store import Journal

CHECKPOINT_EVERY = 10


class History:
    """Recorded operations over an immutable original, all in one folder that Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str, every: int = CHECKPOINT_EVERY):
        self.spark, self.folder, self.every = spark, folder.rstrip("/"), every
        self.specs: list[OperationSpec] = []
        self.pointer = 0
        self.checkpoints: list[int] = []
        self.states = dict.fromkeys(stages.STAGES, "not_started")
        self.journal = Journal(spark, f"{self.folder}/_journal")

    @classmethod
    def start(cls, df: DataFrame, folder: str, every: int = CHECKPOINT_EVERY) -> History:
        """Write the original, with row ids if it has none."""
        new = cls(df.sparkSession, folder, every)
        (df if ROW_ID in df.columns else with_row_id(df, ROW_ID)).write.parquet(f"{new.folder}/original.parquet")
        new.commit()
        return new

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> History:
        """The history in a folder, as its last step left it."""
        new = cls(spark, folder)
        if (data := new.journal.read()) is None:
            raise ValueError(f"no history in {folder}")
        new._take(data)
        return new

    def commit(self, **changes) -> None:
        """Write the state with some changes as the journal's next version; only then they are made."""
        state = self._state() | changes
        self.journal.commit(state | {"operations": [s.to_dict() for s in state["operations"]]})
        self._set(state)

    def mark(self, stage: str, state: str) -> None:
        """Set a stage's state, if it has another."""
        if self.states.get(stage) != state:
            self.commit(states=self.states | {stage: state})

    def _state(self) -> dict:
        return {"every": self.every, "pointer": self.pointer, "checkpoints": self.checkpoints, "states": self.states, "operations": self.specs}

    def _set(self, state: dict) -> None:
        self.every, self.pointer, self.checkpoints, self.states, self.specs = (state[k] for k in ("every", "pointer", "checkpoints", "states", "operations"))

    def _take(self, data: dict) -> None:
        self._set({"every": self.every} | data | {"operations": [OperationSpec.from_dict(x) for x in data["operations"]]})

    def _demoted(self, stage: str) -> dict:
        states = dict(self.states)
        stages.demote(states, stage)
        return states

    def original(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/original.parquet")

    def at(self, pointer: int) -> DataFrame:
        """The frame after the first ``pointer`` operations."""
        base = max((c for c in self.checkpoints if c <= pointer), default=0)
        df = self.spark.read.parquet(self._path(base)) if base else self.original()
        return replay(df, self.specs[base:pointer])

    def working(self) -> DataFrame:
        return self.at(self.pointer)

    def _path(self, seq: int) -> str:
        return f"{self.folder}/checkpoint-{seq:06d}-{self.specs[seq - 1].op_id}.parquet"

    def apply(self, op_type: str, params: dict, stage: str = "structures", columns: list[str] | None = None) -> DataFrame:
        """Record an operation; what had been undone is forgotten.  The plan is made before anything is recorded."""
        df, at = execute(self.working(), op_type, params), self.pointer + 1
        spec = OperationSpec(op_type, stage, params, columns or [c for c in [params.get("column")] if c], seq=at)
        checkpoints = [c for c in self.checkpoints if c < at]
        written = f"{self.folder}/checkpoint-{at:06d}-{spec.op_id}.parquet" if at % self.every == 0 else None
        if written:
            df.write.parquet(written)
            checkpoints.append(at)
        self.commit(pointer=at, operations=[*self.specs[: self.pointer], spec], checkpoints=checkpoints, states=self._demoted(stage))
        return self.spark.read.parquet(written) if written else df

    def undo(self) -> DataFrame | None:
        if not self.pointer:
            return None
        self.commit(pointer=self.pointer - 1, states=self._demoted(self.specs[self.pointer - 1].stage))
        return self.working()

    def redo(self) -> DataFrame | None:
        if self.pointer >= len(self.specs):
            return None
        self.commit(pointer=self.pointer + 1, states=self._demoted(self.specs[self.pointer].stage))
        return self.working()

    def to_json(self) -> str:
        return json.dumps(self._state() | {"operations": [s.to_dict() for s in self.specs]}, default=str)

    @classmethod
    def from_json(cls, spark: SparkSession, folder: str, text: str, every: int = CHECKPOINT_EVERY) -> History:
        """A history from its text; it goes on from the journal's newest version."""
        new = cls(spark, folder, every)
        new.journal.read()
        new._take(json.loads(text))
        return new
