"""Contracts as documents: read, written, and as tables of clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.operators.evolve import CLAUSES
from ledgerline.plans.contract import Contract, Enforcement, Field, ForeignKey, Rule, Table


def to_document(contract: Contract, consumers: list[str] = ()) -> dict:
    """The contract as plain data."""
    tables = {
        t.name: [{k: v for k, v in (("name", f.name), ("type", f.type), ("required", f.required), ("format", f.format), ("enum", list(f.enum) or None), ("minimum", f.minimum), ("maximum", f.maximum)) if v not in (None, False)} for f in t.fields]
        for t in contract.tables
    }
    keys = [{"child": k.child, "column": k.column, "parent": k.parent, "key": k.key} for k in contract.references]
    mode = {} if contract.mode == "AUDIT" else {"enforcement": {"mode": contract.mode}}  # what is written holds against the command line's
    return {"id": contract.id, **mode, "tables": tables, "references": keys, "consumers": sorted(set(consumers))}


def from_document(doc: dict) -> Contract:
    """Plain data as a contract."""
    tables = tuple(Table(n, tuple(Field(f["name"], f.get("type", "string"), bool(f.get("required")), f.get("format"), tuple(f.get("enum") or ()), f.get("minimum"), f.get("maximum")) for f in fields)) for n, fields in (doc.get("tables") or {}).items())
    keys = tuple(ForeignKey(k["child"], k["column"], k["parent"], k["key"]) for k in doc.get("references") or [])
    return Contract(doc.get("id", "contract"), tables, keys, (doc.get("enforcement") or {}).get("mode", "AUDIT"))


def enforcement_of(*docs: dict) -> Enforcement:
    """The enforcement parts of documents (a contract, its registry), merged in order."""
    out = Enforcement("")  # no mode until a document has one
    for d in docs:
        e = d.get("enforcement") or {}
        rules = tuple(Rule(r["field"], r.get("table"), r.get("severity"), frozenset(r.get("skip") or ()), r.get("drift_z_warn"), r.get("drift_z_fail"), r.get("null_warn"), r.get("null_fail")) for r in e.get("rules") or [])
        out = out.merged(Enforcement(e.get("mode") or "", frozenset(e.get("skip") or ()), rules))
    return out


def clauses(spark: SparkSession, contract: Contract) -> DataFrame:
    """A contract's clauses as rows, for comparison."""
    rows = [(t.name, f.name, f.type, f.required, list(f.enum) or None, f.minimum, f.maximum) for t in contract.tables for f in t.fields]
    return spark.createDataFrame([(a, b, c, d, e, None if g is None else float(g), None if h is None else float(h)) for a, b, c, d, e, g, h in rows], CLAUSES)
