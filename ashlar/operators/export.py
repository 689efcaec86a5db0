"""A model as JSON, its rating tables as JSON, and SQL that scores by them."""

from __future__ import annotations

import json
import math

import numpy as np

from .encode import CatEncoder
from .explain import TableBank
from .model import FORMAT_VERSION, Axis, Correction, Model, ModelError, NotExact, Split, Tree


def to_json(model: Model) -> str:
    model.validate()
    doc = {
        "format_version": model.version,
        "model": {
            "f0": model.f0,
            "objective": model.objective,
            "link": model.link,
            "tweedie_rho": model.tweedie_rho,
            "exact": model.exact,
            "class_labels": model.class_labels,
            "axes": [
                {"raw": a.raw, "name": a.name, "borders": a.borders.tolist(), "encoder": None if a.encoder is None else {"base": a.encoder.base, "levels": a.encoder.levels, "members": a.encoder.members, "borders": a.encoder.borders}}
                for a in model.axes
            ],
            "trees": [{"alpha": alpha, "splits": [[s.axis, s.bin_le, s.missing_left] for s in t.splits], "leaves": list(t.leaves)} for alpha, t in model.trees],
            "corrections": [{"axes": list(c.axes), "shape": list(c.values.shape), "values": c.values.ravel().tolist()} for c in model.corrections],
        },
    }
    return json.dumps(doc, sort_keys=True)


def migrate(doc: dict) -> dict:
    """The document in the current format; only that one is known."""
    if doc.get("format_version") != FORMAT_VERSION:
        raise ModelError(f"format version {doc.get('format_version')} is not {FORMAT_VERSION}")
    return doc


def from_json(text: str) -> Model:
    m = migrate(json.loads(text))["model"]
    axes = [Axis(a["raw"], a["name"], np.array(a["borders"], float), CatEncoder(**a["encoder"]) if a["encoder"] else None) for a in m["axes"]]
    trees = [(t["alpha"], Tree(tuple(Split(*s) for s in t["splits"]), tuple(t["leaves"]))) for t in m["trees"]]
    corrections = [Correction(tuple(c["axes"]), np.array(c["values"]).reshape(c["shape"])) for c in m["corrections"]]
    out = Model(m["f0"], trees, axes, m["objective"], m["link"], m["tweedie_rho"], m["exact"], corrections, m["class_labels"], FORMAT_VERSION)
    out.validate()
    return out


def rebased(bank: TableBank, reference: dict[int, int]) -> tuple[float, dict[tuple[int, ...], np.ndarray]]:
    """Constant and tables with each single-feature table zero at its reference cell."""
    if bank.boxes:
        raise NotExact("factored tables cannot be rebased")
    f0, tables = bank.f0, {u: v.copy() for u, v in bank.tables.items()}
    for raw, cell in reference.items():
        if (raw,) not in tables:
            raise ModelError(f"there is no table of feature {raw} alone")
        level = float(tables[(raw,)][cell])
        tables[(raw,)] -= level
        f0 += level
    return f0, tables


def rating_export(model: Model, bank: TableBank, reference: dict[int, int] | None = None) -> dict:
    """Tables in order of falling variance share, as plain lists; relativities for log links."""
    if not (model.exact and bank.exact):
        raise NotExact("an approximate model is not exported")
    f0, tables = rebased(bank, reference) if reference else (bank.f0, bank.tables)
    out = []
    for u, share in bank.sobol():
        entry = {
            "features": [bank.axes[r].name for r in u],
            "raw": list(u),
            "sobol": share,
            "axes": [{"raw": r, "borders": bank.axes[r].borders, "cells": bank.axes[r].cells} for r in u],
        }
        if u in tables:
            v = tables[u]
            entry |= {"shape": list(v.shape), "values": v.ravel().tolist()}
            if model.link == "log":
                entry["relativities"] = np.exp(v).ravel().tolist()
        if u in bank.boxes:
            entry["boxes"] = [{"low": [m.tolist() for m in b.low], "octants": b.octants.ravel().tolist()} for b in bank.boxes[u]]
        out.append(entry)
    return {"format_version": FORMAT_VERSION, "f0": f0, "link": model.link, "objective": model.objective, "tables": out}


def _literal(x: float) -> str:
    if not math.isfinite(x):
        raise ModelError("a border or value is not finite")
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def binning_sql(bank: TableBank, source: str, key: str, names: dict[int, str] | None = None) -> str:
    """SELECT of the key and the merged cell of each feature; NaN and NULL are cell 0."""
    parts = []
    for r, m in bank.axes.items():
        x = (names or {}).get(r, m.name)
        cases = " ".join(f"when {x} <= {_literal(b)} then {k + 1}" for k, b in enumerate(m.borders))
        parts.append(f"case when {x} is null or isnan({x}) then 0 {cases} else {len(m.borders) + 1} end as c{r}")
    return f"select {key}, {', '.join(parts)} from {source}"


def scoring_sql(bank: TableBank, source: str, key: str, names: dict[int, str] | None = None) -> str:
    """A query that bins, looks every table up by CASE, and sums: scores with no other table. For small banks."""
    if bank.boxes:
        raise NotExact("factored tables are scored by their boxes")
    terms = [_literal(bank.f0)]
    for u, _ in bank.sobol():
        v = bank.tables[u]
        at = "0"
        for d, r in enumerate(u):
            at = f"({at}) * {v.shape[d]} + c{r}"
        cases = " ".join(f"when {k} then {_literal(float(x))}" for k, x in enumerate(v.ravel()))
        terms.append(f"case {at} {cases} end")
    return f"select {key}, {' + '.join(terms)} as raw_score from ({binning_sql(bank, source, key, names)}) binned"
