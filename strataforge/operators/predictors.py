"""Predictors of release pairs by name: a declared registry of transforms that is compiled to one projection.

A name outside the registry is an error before anything is planned. Missing values stay null; each group of measures has flags that say what is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def percent_logit(percent: Column) -> Column:
    return F.log((percent + 0.5) / (100.5 - percent))


TRANSFORMS: dict[str, Callable[..., Column]] = {
    "number": lambda c: c.cast("double"), "missing": lambda *c: F.exists(F.array(*[x.isNull() for x in c]), lambda x: x).cast("double"), "log": C.positive_log, "log1p": C.log1p_nonneg, "log width": C.interval_log_width, "logit of percent": percent_logit,
}
_BOUNDS = {k: (f"{k}_lower", f"{k}_upper") for k in ("acceptance", "safety")}
#: By part: name, transform, columns it reads.
HISTORY = {"prior_logit": ("logit of percent", "prior"), "history_mean": ("number", "history_mean"), "log_n": ("log1p", "feature_n"), "history_count": ("number", "history_count")}
ACCESS = {
    "log_rate": ("log", "rate_ratio"), "log_person_years": ("log1p", "person_years"), "log_wait": ("log1p", "wait"),
    "missing_rate": ("missing", "rate_ratio"), "missing_years": ("missing", "person_years"), "missing_waiting": ("missing", "wait"),
}
_RATIOS = ("overall", "low", "medium", "high", "hard")
ACCEPTANCE = (
    {"log_accepted": ("log1p", "acceptance_expected"), "acceptance_width": ("log width", *_BOUNDS["acceptance"])} | {f"log_{s}": ("log", f"acceptance_{s}") for s in _RATIOS}
    | {"missing_accepted": ("missing", "acceptance_expected"), "missing_width": ("missing", *_BOUNDS["acceptance"])} | {f"missing_{s}": ("missing", f"acceptance_{s}") for s in _RATIOS}
)
SAFETY = {"log_safety": ("log", "safety_ratio"), "safety_width": ("log width", *_BOUNDS["safety"]), "missing_safety": ("missing", "safety_ratio"), "missing_safety_width": ("missing", *_BOUNDS["safety"])}
REGISTRY = HISTORY | ACCESS | ACCEPTANCE | SAFETY
#: Nested groups, compared on identical rows.
GROUPS = {
    "history": list(HISTORY), "with acceptance": [*HISTORY, *ACCEPTANCE], "with access": [*HISTORY, *ACCESS], "with both": [*HISTORY, *ACCESS, *ACCEPTANCE], "with safety": list(REGISTRY),
}


def compiled(names: list[str]) -> list[Column]:
    """The columns of these predictors."""
    repeated, unknown = sorted({n for n in names if names.count(n) > 1}), sorted(set(names) - set(REGISTRY))
    if not names or repeated or unknown:
        raise ValueError(f"predictors must be declared ones, each once; repeated: {repeated}, not declared: {unknown}")
    return [TRANSFORMS[kind](*[F.col(s) for s in sources]).alias(n) for n in names for kind, *sources in (REGISTRY[n],)]


def matrix(rows: DataFrame, *kept: str | Column, names: list[str] | None = None) -> DataFrame:
    """`kept` and the predictors, in one projection; a table that lacks a source column is an error."""
    names = list(REGISTRY) if names is None else names
    columns = compiled(names)
    lacking = sorted({s for n in names for s in REGISTRY[n][1:]} - set(rows.columns))
    if lacking:
        raise ValueError(f"the table lacks the columns {lacking}")
    return rows.select(*kept, *columns)
