"""What text columns need: normalization, label variants, formats, patterns, units."""

from __future__ import annotations

from collections.abc import Iterable
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrubjay.assessments.profile import data_columns
from scrubjay.functions import stats
from scrubjay.functions.columns import FALSE_WORDS, MISSING_MARKERS, TRUE_WORDS, is_missing, is_numeric, is_text, missing_in, number, qcol, strip_ws, title_case
from scrubjay.operators.types import PLAIN_NUMBER, WITH_UNIT, rule_violated, unit_parts
from scrubjay.session import ROW_ID

# Signs of currency that begin a number.
CURRENCY_SIGNS = ("$", "€", "£", "₹")


def normalization_counts(df: DataFrame) -> DataFrame:
    """(column, change, n): how many values each change would touch, all text columns in one pass."""
    names = [c for c in data_columns(df) if is_text(df, c)]
    changes: dict[str, object] = {
        "trim": lambda c: strip_ws(c) != c,
        "collapse_spaces": lambda c: c.rlike(" {2,}"),
        "strip_linebreaks": lambda c: c.rlike(r"[\r\n\t]"),
        "empty_to_null": lambda c: strip_ws(c) == "",
        "lower": lambda c: F.lower(c) != c,
        "upper": lambda c: F.upper(c) != c,
        "title": lambda c: title_case(c) != c,
        "standardize_punctuation": lambda c: c.rlike("[’‘`´“”\"—–…]"),
    }
    if not names:
        return df.sparkSession.createDataFrame([], "column string, change string, n long")
    counts = [F.count_if(test(qcol(c))).alias(f"x{i}_{change}") for i, c in enumerate(names) for change, test in changes.items()]
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(change).alias("change"), F.col(f"x{i}_{change}").alias("n")) for i, c in enumerate(names) for change in changes))
    return df.agg(*counts).select(F.explode(cells).alias("c")).select("c.*")


def label_variants(df: DataFrame, name: str, most: int = 1000) -> DataFrame:
    """(key, canonical, variants, n_variants): labels that differ only in case and spaces.

    The canonical one is the longest, the smallest of those.  The variants of
    a key are distinct values, so a hot label counts once; ``n_variants`` is
    exact, the list has the first ``most`` in their order.
    """
    c = qcol(name)
    key = F.lower(F.regexp_replace(strip_ws(c), " {2,}", " "))
    labels = df.where(c.isNotNull()).select(key.alias("key"), c.alias("label")).distinct()
    groups = labels.groupBy("key").agg(F.min(F.struct((-F.length("label")).alias("n"), F.col("label").alias("label")))["label"].alias("canonical"), F.count("*").alias("n_variants")).where("n_variants > 1")
    first = labels.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("label"))).where(F.col("k") <= most)
    lists = first.groupBy("key").agg(F.array_sort(F.collect_list("label")).alias("variants"))
    return groups.join(lists, "key").select("key", "canonical", "variants", "n_variants")


def _grouped(c: Column, group: str, point: str) -> Column:
    """Whether a text is a number with this mark between groups of three digits and that one before its fraction."""
    parts = F.split(c, f"[{point}]", -1)
    groups = F.split(F.regexp_replace(F.element_at(parts, 1), "^[+-]", ""), f"[{group}]", -1)
    even = F.forall(F.slice(groups, F.lit(2), F.size(groups)), lambda g: F.length(g) == 3) & ((F.size(groups) == 1) | F.length(F.element_at(groups, 1)).between(1, 3))
    plain = F.replace(F.replace(c, F.lit(group), F.lit("")), F.lit(point), F.lit("."))
    return (F.size(parts) <= 2) & even & number(plain).isNotNull()


#: Kinds of formats in the order in which they are asked for, and the share of a column's values that has to have one.
FORMAT_SHARES = {"boolean": 1.0, "percent": 0.8, "currency": 0.8, "decimal_separator": 0.8}


def format_candidates(df: DataFrame, sample: int | None = None) -> list[dict]:
    """Text columns that look like booleans, percentages, currency or decimal commas, the first of these that fits.

    All values of all columns are judged in one pass; ``sample`` takes the
    first ones by id only.
    """
    names = [c for c in data_columns(df) if is_text(df, c)]
    if not names:
        return []
    if sample:
        df = (df.orderBy(ROW_ID) if ROW_ID in df.columns else df).limit(sample)
    aggs = []
    for i, name in enumerate(names):
        v = strip_ws(qcol(name))
        sign = F.substring(v, 1, 1).isin(*CURRENCY_SIGNS)
        tests = {
            "boolean": F.lower(v).isin(*TRUE_WORDS, *FALSE_WORDS),
            "percent": v.endswith("%"),
            "currency": sign & number(F.replace(strip_ws(F.substring(v, F.lit(2), F.length(v))), F.lit(","), F.lit(""))).isNotNull(),  # as the conversion reads it
            "decimal_separator": v.contains(",") & _grouped(v, ".", ","),
        }
        aggs += [F.count(v).alias(f"n{i}"), *(F.count_if(test).alias(f"{kind}{i}") for kind, test in tests.items())]
    row, out = df.agg(*aggs).first(), []
    for i, name in enumerate(names):
        share = {kind: row[f"{kind}{i}"] / row[f"n{i}"] if row[f"n{i}"] else 0.0 for kind in FORMAT_SHARES}
        kind = next((k for k, least in FORMAT_SHARES.items() if (share[k] == 1 if least == 1 else share[k] > least)), None)
        out += [{"column": name, "kind": kind, "share": share[kind]}] if kind else []
    return out


def invalid_values(df: DataFrame, name: str, rule: dict, examples: int = 10) -> dict:
    """How many values break a rule, and the first of them by id; ``rows`` is a frame of all their ids."""
    bad = df.where(rule_violated(df, name, rule))
    n, total = bad.count(), df.count()
    shown = (bad.orderBy(ROW_ID) if ROW_ID in df.columns else bad).select(qcol(name)).limit(examples).collect()
    return {"column": name, "n_invalid": n, "invalid_pct": round(n / total * 100, 2) if total else 0.0, "examples": [r[0] for r in shown], "rows": bad.select(qcol(ROW_ID)) if ROW_ID in df.columns else None}


# Named patterns.
PATTERNS = {
    "email": r"^[\w.+-]+@[\w-]+\.[\w.-]+$",
    "phone_intl": r"^\+?\d[\d\s().-]{6,}$",
    "postcode_us": r"^\d{5}(-\d{4})?$",
    "postcode_uk": r"^[A-Za-z]{1,2}\d[A-Za-z\d]?\s*\d[A-Za-z]{2}$",
    "digits_only": r"^\d+$",
    "alphanumeric_id": r"^[A-Za-z0-9_-]+$",
}
_LONGEST = 300


def _refused(pattern: str) -> str | None:
    """What a pattern has that isn't allowed: groups other than plain ones, references to groups."""
    at, in_class = 0, False
    while at < len(pattern):
        c, rest = pattern[at], pattern[at + 1 :]
        if c == "\\":
            if not in_class and (rest[:1] in tuple("123456789") or rest[:1] == "k"):
                return "a back reference"
            at += 1  # what is escaped begins nothing
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            at += len(re.match(r"\^?\]?", rest).group())  # a bracket at its start belongs to the class
        elif c == "(" and rest.startswith("?") and not re.match(r"\?[a-zA-Z]*[:)]", rest):
            return "a lookaround or a named group"
        at += 1
    return None


def compiled_pattern(name_or_pattern: str) -> str:
    """A named or own pattern, anchored; raises for what isn't allowed."""
    pattern = PATTERNS.get(name_or_pattern, name_or_pattern)
    if len(pattern) > _LONGEST:
        raise ValueError(f"a pattern has {_LONGEST} characters at most")
    if what := _refused(pattern):
        raise ValueError(f"{what} isn't allowed")
    re.compile(pattern)
    if not pattern.startswith("^"):
        pattern = f"^(?:{pattern})$"
    return "(?U)" + re.sub(r"\$$", r"\\z", pattern)


def pattern_fit(df: DataFrame, name: str, name_or_pattern: str, markers: Iterable[str] = MISSING_MARKERS, samples: int = 10) -> dict:
    """How many values match a pattern, and some that don't."""
    fits, c = qcol(name).cast("string").rlike(compiled_pattern(name_or_pattern)), qcol(name)
    there = df.where(~is_missing(c, markers))
    good, n = there.agg(F.count_if(fits), F.count("*")).first()
    bad = there.where(~fits)
    shown = (bad.orderBy(ROW_ID) if ROW_ID in df.columns else bad).select(c.cast("string")).limit(samples).collect()
    return {"column": name, "n_matching": good, "n_other": n - good, "samples": [r[0] for r in shown]}


# Factors from a unit to others, and signs and codes of currencies.
FACTORS = {
    "kg": {"g": 1000, "lb": 2.20462},
    "g": {"kg": 0.001, "lb": 0.00220462},
    "lb": {"kg": 0.453592, "g": 453.592},
    "m": {"cm": 100, "mm": 1000, "km": 0.001},
    "cm": {"m": 0.01, "mm": 10},
    "mm": {"m": 0.001, "cm": 0.1},
    "km": {"m": 1000},
    "l": {"ml": 1000},
    "ml": {"l": 0.001},
}
CURRENCIES = ("$", "€", "£", "¥", "usd", "eur", "gbp", "jpy")


def unit_groups(df: DataFrame, name: str, markers: Iterable[str] = MISSING_MARKERS) -> DataFrame:
    """(unit, position, n, lowest, highest, is_currency): values of a text column by their unit.

    Plain numbers have the unit ``""``; values without a number have null.
    """
    c = qcol(name)
    unit, value = unit_parts(c)
    before = F.regexp_extract(c, WITH_UNIT, 1)
    position = F.when(value.isNull(), F.lit("none")).when(c.rlike(PLAIN_NUMBER) | (unit == ""), F.lit("plain")).when(before != "", F.lit("prefix")).otherwise(F.lit("suffix"))
    rows = df.where(~is_missing(c, markers)).select(F.when(value.isNotNull(), unit).alias("unit"), position.alias("position"), value.alias("value"))
    # the first position seen speaks for the unit: prefix before suffix
    found = rows.groupBy("unit").agg(F.min("position").alias("position"), F.count("*").alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
    return found.withColumn("is_currency", F.coalesce(F.col("unit").isin(*CURRENCIES), F.lit(False)))


def mixed_scale(df: DataFrame, name: str, markers: Iterable[str] = MISSING_MARKERS) -> dict:
    """Whether a numeric column seems to mix shares (0 to 1) with percentages."""
    c = qcol(name).cast("double")
    n, small, large, top = df.where(~missing_in(df, name, markers)).agg(F.count(c), F.count_if((c > 0) & (c <= 1)), F.count_if(c > 1), F.max(c)).first()
    return {"column": name, "n": n, "n_shares": small, "n_above_one": large, "possible_mixed_scale": bool(n >= 10 and small >= 2 and large >= 2 and top <= 100)}


def units(df: DataFrame, name: str, markers: Iterable[str] = MISSING_MARKERS, samples: int = 3) -> dict:
    """Units of a column with suggested factors, or the scale hint of a numeric one."""
    if is_numeric(df, name):
        return {"column": name, "groups": [], "scale": mixed_scale(df, name, markers)}
    rows = unit_groups(df, name, markers).collect()
    named = [r for r in rows if r.unit]
    unit, value = unit_parts(qcol(name))
    seen = df.where(~missing_in(df, name, markers) & value.isNotNull() & (unit != "")).select(unit.alias("unit"), qcol(name).alias("v"))
    some = stats.smallest(seen, "unit", "v", samples).collect() if named else []
    shown_of = {u: sorted(r.v for r in some if r.unit == u) for u in {r.unit for r in some}}
    groups = [r.asDict() | {"factors": FACTORS.get(r.unit, {}), "samples": shown_of.get(r.unit, [])} for r in sorted(named, key=lambda r: (-r.n, r.unit))]
    unmatched = next((r.n for r in rows if r.unit is None), 0)
    shown = df.where(~missing_in(df, name, markers) & value.isNull()).select(qcol(name)).orderBy(qcol(name)).limit(samples).collect() if unmatched else []
    return {"column": name, "groups": groups, "n_plain": next((r.n for r in rows if r.unit == ""), 0), "n_unmatched": unmatched, "unmatched": [r[0] for r in shown], "scale": None}

