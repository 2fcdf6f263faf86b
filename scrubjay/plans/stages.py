"""Stages of a cleaning, and which of them a change makes outdated."""

from __future__ import annotations

STAGES = ("column_names", "profile", "special_chars", "missingness", "units", "types", "normalization", "invalid_values", "structures", "patterns", "duplicates", "keys", "outcome", "statistics", "univariate", "bivariate", "validation")
STATES = ("not_started", "in_progress", "completed", "skipped", "outdated")

# The stages whose result a change of a stage touches.
DEPENDENTS: dict[str, tuple[str, ...]] = {
    "special_chars": ("profile", "missingness", "units", "types", "normalization", "invalid_values", "patterns", "duplicates", "keys", "statistics", "univariate", "bivariate", "validation"),
    "missingness": ("profile", "units", "types", "normalization", "patterns", "duplicates", "keys", "statistics", "univariate", "bivariate", "validation"),
    "units": ("profile", "types", "normalization", "invalid_values", "patterns", "duplicates", "keys", "statistics", "validation"),
    "types": ("profile", "normalization", "invalid_values", "patterns", "duplicates", "keys", "statistics", "univariate", "bivariate", "validation"),
    "normalization": ("profile", "missingness", "invalid_values", "patterns", "duplicates", "keys", "validation"),
    "invalid_values": ("profile", "missingness", "patterns", "statistics", "duplicates", "keys", "univariate", "bivariate", "validation"),
    "structures": ("profile", "duplicates", "keys", "statistics", "univariate", "bivariate", "validation"),
    "patterns": ("profile", "duplicates", "keys", "statistics", "validation"),
    "duplicates": ("profile", "keys", "statistics", "univariate", "bivariate", "validation"),
    "keys": ("profile", "statistics", "validation"),
    "univariate": ("statistics", "bivariate", "validation"),
    "bivariate": ("profile", "statistics", "validation"),
    "outcome": ("bivariate",),
}


def outdated_by(stage: str) -> tuple[str, ...]:
    return DEPENDENTS.get(stage, ())


def demote(states: dict[str, str], stage: str) -> list[str]:
    """Completed stages that a change makes outdated; ``states`` is changed, their names are returned."""
    hit = [s for s in outdated_by(stage) if states.get(s) == "completed"]
    for s in hit:
        states[s] = "outdated"
    return hit


#: Operations that change which rows there are.
ROWS = ("drop_rows", "merge_records", "resolve_duplicates")


def writes(op_type: str, params: dict) -> set[str] | None:
    """The columns that an operation changes, names that go and come included; None if rows go or it isn't known."""
    if op_type in ROWS or (op_type == "treat_missing" and params.get("method") == "drop_rows"):
        return None
    if op_type == "rename_column":
        return {params["from"], params["to"]}
    if op_type == "rename_columns":
        return {*params["mapping"], *params["mapping"].values()}
    named = [params["column"]] if params.get("column") else list(params.get("columns") or [])
    return set(named) or None
