"""The registered operations; importing this fills the registry."""

from scrubjay.operators import missing, rows_columns, text, types  # noqa: F401
from scrubjay.operators.spec import REGISTRY, ROW_LOCAL, OperationSpec, execute, replay
from scrubjay.plans import duplicates  # noqa: F401

__all__ = ["REGISTRY", "ROW_LOCAL", "OperationSpec", "execute", "replay"]
