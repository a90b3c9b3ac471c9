"""Every operator by name. ``run(name, df, **arguments)`` checks the name and the arguments."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from tablewise.operators import (
    causal,
    charts,
    crossdata,
    drift,
    evaluate,
    explain,
    features,
    forecast,
    hypothesis,
    insights,
    logs,
    mine,
    models,
    pivot,
    profile,
    relate,
    retrieve,
    scoring,
    sql,
    train,
    trend,
)
from tablewise.sources import tables

MODULES = (
    tables, profile, charts, pivot, sql, relate, trend, insights, hypothesis, causal, crossdata, mine, evaluate, features, scoring,
    train, models, drift, explain, forecast, retrieve, logs,
)


def _public(module) -> dict[str, Callable]:
    return {
        n: f for n, f in vars(module).items() if inspect.isfunction(f) and not n.startswith("_") and f.__module__ == module.__name__
    }


OPERATORS: dict[str, Callable] = {n: f for m in MODULES for n, f in _public(m).items()}


def register(name: str, fn: Callable) -> None:
    """Add an operator of one's own."""
    if name in OPERATORS:
        raise ValueError(f"operator {name} exists")
    OPERATORS[name] = fn


def run(name: str, *args, **arguments):
    if name not in OPERATORS:
        raise ValueError(f"unknown operator {name}")
    known = inspect.signature(OPERATORS[name]).parameters
    takes_any = any(p.kind is p.VAR_KEYWORD for p in known.values())
    extra = [a for a in arguments if a not in known]
    if extra and not takes_any:
        raise ValueError(f"{name} does not take {extra}; it takes {list(known)}")
    return OPERATORS[name](*args, **arguments)
