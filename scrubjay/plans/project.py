"""A project: independent tables, each with its history, keys, outliers and cached assessments.

What is declared, found and decided is written to journals in the project's
folder as it happens, so a project is opened from its folder alone.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable
import copy
import json

from pyspark.sql import DataFrame, SparkSession

from scrubjay.functions.columns import MISSING_MARKERS, qcol
from scrubjay.plans import duplicates, outliers, stages, validate
from scrubjay.plans.lineage import History
from scrubjay.plans.outliers import OutlierLog
from scrubjay.session import ROW_ID
from scrubjay.sources import excel, sinks
from scrubjay.sources.csv import read_csv
from scrubjay.sources.store import Journal

STATUSES = ("loaded", "in_progress", "ready", "excluded", "rejected")
FORMATS = ("csv", "xlsx", "report", "json", "script", "flagged", "zip")
MOST_CACHED = 500


class Item:
    """One table of a project."""

    def __init__(self, name: str, history: History, source: dict | None = None, folder: str | None = None):
        self.name, self.history, self.source = name, history, source or {}
        self.folder = folder or history.folder
        self.journal = Journal(history.spark, f"{self.folder}/_item")
        self.status = "loaded"
        self.key: list[str] | None = None
        self.outliers = OutlierLog(folder=f"{self.folder}/outliers", changed=self.save)
        self.duplicates: dict | None = None
        self._cache: OrderedDict[tuple, object] = OrderedDict()

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Item:
        """The item in a folder, as it was left."""
        journal = Journal(spark, f"{folder}/_item")
        if (data := journal.read()) is None:
            raise ValueError(f"no item in {folder}")
        new = cls(data["name"], History.open(spark, data["folder"]), data["source"], folder)
        new.journal = journal
        new._take(data)
        return new

    def save(self) -> None:
        """Write all but the history, which writes itself, as the next version."""
        self.journal.commit({k: v for k, v in self.to_dict().items() if k != "history"})

    def _take(self, data: dict) -> None:
        self.status, self.key, self.duplicates = data["status"], data["key"], data.get("duplicates")
        self.outliers = OutlierLog(data["outliers"], self.outliers.folder, self.save)

    def set_status(self, status: str) -> None:
        if status != self.status:
            self.status = status
            self.save()

    # what is read

    def assess(self, stage: str, make: Callable[[DataFrame], object], columns: Iterable[str] | None = None) -> object:
        """An assessment of the working frame, made once for each state of it; the stage is then completed.

        One that reads some columns only gets those (and the row ids), and is
        made anew only after an operation that changes one of them or drops
        rows.
        """
        read = None if columns is None else tuple(columns)
        done = self.history.specs[: self.history.pointer]
        touching = [s.op_id for s in done if read is None or (own := stages.writes(s.op_type, s.params)) is None or own & set(read)]
        def made() -> object:
            df = self.history.working()
            return make(df if read is None else df.select(ROW_ID, *map(qcol, read)))

        found = self._kept((stage, read, tuple(touching)), made)
        self.history.mark(stage, "completed")
        return found

    def _kept(self, at: tuple, make: Callable[[], object]) -> object:
        """What is kept for a state, made if it isn't there."""
        if at not in self._cache:
            self._cache[at] = make()
            while len(self._cache) > MOST_CACHED:
                self._cache.popitem(last=False)
        self._cache.move_to_end(at)
        return self._cache[at]

    def _figures(self, what: str, make: Callable[[], dict], *of) -> dict:
        """Figures of the working frame that hold until an operation is applied or undone; a copy, as they are handed out."""
        done = tuple(s.op_id for s in self.history.specs[: self.history.pointer])
        return copy.deepcopy(self._kept(("figures", what, done, *of), make))

    def _key_figures(self, markers: Iterable[str]) -> dict:
        key, markers = list(self.key), tuple(markers)
        return self._figures("key", lambda: validate.key_figures(self.history.working(), key, markers), tuple(key), markers)

    def assess_columns(self, stage: str, make: Callable[[DataFrame], object], columns: Iterable[str]) -> dict[str, object]:
        """An assessment for each column by itself; an operation on one of them leaves the others' in place."""
        return {c: self.assess(stage, make, [c]) for c in columns}

    def preview(self, op_type: str, params: dict, most: int = 10) -> dict:
        """What an operation would change; nothing is recorded."""
        from scrubjay.operators import execute

        before = self.history.working()
        return validate.preview(before, execute(before, op_type, params), most)

    # what is changed

    def apply(self, op_type: str, params: dict, stage: str = "structures") -> DataFrame:
        self.set_status("in_progress")
        return self.history.apply(op_type, params, stage)

    def reread(self, spark: SparkSession, path: str, encoding: str, delimiter: str) -> None:
        """Read the source again with other settings, as long as nothing has been recorded."""
        if self.history.specs:
            raise ValueError("operations are recorded; the source can't be read anew")
        folder = f"{self.folder}-{len(self.source.get('settings', [])) + 1}"
        self.history = History.start(read_csv(spark, path, encoding, delimiter), folder, self.history.every)
        self.source = self.source | {"encoding": encoding, "delimiter": delimiter, "settings": [*self.source.get("settings", []), [encoding, delimiter]]}
        self._cache.clear()
        self.save()

    def declare_key(self, columns: list[str]) -> dict:
        """Remember the key; validation checks it again."""
        self.key = columns
        self.save()
        return self._key_figures(MISSING_MARKERS)

    def screen_outliers(self, name: str, method: str = "iqr", params: dict | None = None) -> dict:
        """Screen a column and keep its flagged rows as a table."""
        found = outliers.screen(self.history.working(), name, method, params)
        self.outliers.flag(name, found["flagged"])
        return found

    def review_outliers(self, name: str, context: str) -> dict:
        """Review a column's flagged rows by a context; the evidence is kept as a table."""
        df = self.history.working()
        found = outliers.review(df, name, context, self.outliers.flagged_rows(df.sparkSession, name))
        self.outliers.add_evidence(name, context, found["evidence"])
        return found

    def treat_outliers(self, name: str, ids: list[int] | None, how: str, params: dict | None = None) -> dict:
        """Treat reviewed rows, or (None) all flagged ones; the column's figures before and after."""
        found = self.outliers.treatment(name, ids, how, params)
        before = outliers.column_stats(self.history.working(), name)
        if found is None:
            self.outliers.decide(name, ids, "valid_extreme")
            return {"before": before, "after": before}
        self.apply(*found, stage="univariate")
        self.outliers.decide(name, ids, "excluded" if how == "remove" else "likely_error")
        return {"before": before, "after": outliers.column_stats(self.history.working(), name)}

    def find_duplicates(self, columns: list[str], blocking: Iterable[str] = (), threshold: int = 100) -> dict:
        """Remember what duplicates are sought by, for the export of flagged records; an estimate of the pairs."""
        self.duplicates = {"columns": columns, "blocking": list(blocking), "threshold": threshold}
        self.save()
        return duplicates.estimate(self.history.working(), **self.duplicates)

    def resolve_duplicates(self, columns: list[str], how: str, keep: int | None = None, group: list[int] | None = None, field_values: dict | None = None, blocking: Iterable[str] = ()) -> DataFrame:
        """keep_all, keep_first, keep_last, keep_most_complete over all exact groups; keep_selected or merge for one group.

        What is recorded is how the groups are resolved, not the rows that go.
        """
        if how in ("keep_selected", "merge"):
            if keep is None or not group or keep not in group:
                raise ValueError("name the group and its row that stays")
            others = [i for i in group if i != keep]
            if how == "merge":
                return self.apply("merge_records", duplicates.merge_spec(keep, others, field_values or {}), "duplicates")
            return self.apply("drop_rows", {"row_ids": others}, "duplicates")
        df, blocking = self.history.working(), list(blocking)
        if how == "keep_all" or not duplicates.exact_summary(df, columns, blocking).first()["proposed_removals"]:
            return duplicates.resolve(df, columns, how, blocking)
        return self.apply("resolve_duplicates", {"columns": columns, "how": how, "blocking": blocking}, "duplicates")

    def flagged_records(self) -> DataFrame | None:
        """The rows that are flagged as outliers or found as duplicates, with the reasons; None if nothing was sought."""
        df = self.history.working()
        spark = df.sparkSession
        flagged = {c: self.outliers.flagged_rows(spark, c) for c, own in self.outliers.data["columns"].items() if own["n_flagged"]}
        exact = near = None
        if self.duplicates and self.duplicates["threshold"] == 100:
            exact = duplicates.exact_members(df, self.duplicates["columns"], self.duplicates["blocking"])
        elif self.duplicates:
            near = duplicates.clusters(df, duplicates.near_pairs(df, **self.duplicates), self.duplicates["columns"])
        if not flagged and exact is None and near is None:
            return None
        return sinks.flagged_records(df, sinks.flag_reasons(flagged, exact, near))

    # what leaves

    def validate(self, markers: Iterable[str] = MISSING_MARKERS) -> dict:
        """The summary of the item; the tables are read once for each state of it."""
        h, markers = self.history, tuple(markers)
        measured = self._figures("tables", lambda: validate.figures(h.original(), h.working(), markers), markers)
        key_found = self._key_figures(markers) if self.key else None
        out = validate.summary(measured, self.key, key_found, self.outliers.unresolved(spark=h.spark), h.states, h.pointer, len(h.specs) - h.pointer)
        h.mark("validation", "completed")
        return out

    def to_dict(self) -> dict:
        return {"name": self.name, "status": self.status, "source": self.source, "key": self.key, "outliers": self.outliers.data, "duplicates": self.duplicates, "folder": self.history.folder, "item_folder": self.folder, "history": json.loads(self.history.to_json())}

    @classmethod
    def from_dict(cls, spark: SparkSession, data: dict) -> Item:
        new = cls(data["name"], History.from_json(spark, data["folder"], json.dumps(data["history"])), data["source"], data["item_folder"])
        new.journal.read()
        new._take(data)
        return new


class Project:
    """Named items under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.items: dict[str, Item] = {}
        self.journal = Journal(spark, f"{self.folder}/_project")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Project:
        """The project in a folder with all its items."""
        new = cls(spark, folder)
        data = new.journal.read() or {"items": []}
        new.items = {item.name: item for item in (Item.open(spark, x) for x in data["items"])}
        return new

    def add(self, name: str, df: DataFrame, source: dict | None = None) -> Item:
        if name in self.items:
            raise ValueError(f"there is an item {name} already")
        item = Item(name, History.start(df, f"{self.folder}/item-{len(self.items)}"), source)
        item.save()
        self.journal.commit({"items": [*(x.folder for x in self.items.values()), item.folder]})
        self.items[name] = item
        return item

    def set_status(self, name: str, status: str) -> None:
        if status not in STATUSES:
            raise ValueError(f"unknown status: {status}")
        self.items[name].set_status(status)

    def exported(self) -> dict[str, Item]:
        return {k: v for k, v in self.items.items() if v.status not in ("excluded", "rejected")}

    def warnings(self) -> list[str]:
        return [f"{name}: {w}" for name, item in self.exported().items() for w in item.validate()["warnings"]]

    def export(self, formats: Iterable[str], acknowledged: bool = False, workbook: str | None = None) -> dict[str, str]:
        """Write the items; what comes back has tables by their folders and workbook and archive by their paths.

        Tables are written beside the project by Spark.  ``xlsx`` is one
        workbook with a sheet per item (an edit of ``workbook``, if one is
        named), ``flagged`` a table of the flagged records per item, ``zip`` an
        archive of the small files; report, configuration and script are texts.
        Open warnings have to be acknowledged first.
        """
        formats = list(formats)
        if bad := [f for f in formats if f not in FORMATS]:
            raise ValueError(f"unknown formats: {bad}")
        sinks.gate(self.warnings(), acknowledged)
        out: dict[str, str] = {}
        for k, (name, item) in enumerate(self.exported().items()):
            specs, working = item.history.specs[: item.history.pointer], item.history.working()
            place = f"{self.folder}/export/{k}-{item.history.pointer}"
            for f in formats:
                if f == "csv":
                    sinks.write_csv(working, f"{place}.csv")
                    out[f"{name}.csv"] = f"{place}.csv"
                elif f == "flagged" and (found := item.flagged_records()) is not None:
                    sinks.write_csv(found, f"{place}-flagged.csv")
                    out[f"{name}_flagged.csv"] = f"{place}-flagged.csv"
                elif f == "report":
                    out[f"{name}.html"] = sinks.html_report(name, item.validate(), specs)
                elif f == "json":
                    out[f"{name}.json"] = sinks.config_json(specs, item.source)
                elif f == "script":
                    out[f"{name}.py"] = sinks.script(specs, item.source)
        if "xlsx" in formats:
            frames = {name: item.history.working() for name, item in self.exported().items()}
            gone = [name for name in self.items if name not in frames]
            out["workbook.xlsx"] = excel.write_xlsx(frames, f"{self.folder}/export/workbook.xlsx", workbook, gone)
        if "zip" in formats:
            texts = {name: text for name, text in out.items() if name.endswith((".html", ".json", ".py"))}
            sinks.bundle(texts, f"{self.folder}/export/bundle.zip", self.spark)
            out["bundle.zip"] = f"{self.folder}/export/bundle.zip"
        return out

    def to_json(self) -> str:
        return json.dumps({"folder": self.folder, "items": [i.to_dict() for i in self.items.values()]}, default=str)

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> Project:
        data = json.loads(text)
        new = cls(spark, data["folder"])
        new.journal.read()
        new.items = {x["name"]: Item.from_dict(spark, x) for x in data["items"]}
        return new
