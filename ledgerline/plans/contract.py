"""Contracts, rules and thresholds: metadata on the driver."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Field:
    """A column's clauses."""

    name: str
    type: str = "string"
    required: bool = False
    format: str | None = None
    enum: tuple[str, ...] = ()
    minimum: float | None = None
    maximum: float | None = None


@dataclass(frozen=True)
class ForeignKey:
    """child.column must occur in parent.key."""

    child: str
    column: str
    parent: str
    key: str


@dataclass(frozen=True)
class Table:
    """A table's contract."""

    name: str
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class Contract:
    """Tables, references and how they are enforced."""

    id: str
    tables: tuple[Table, ...]
    references: tuple[ForeignKey, ...] = ()
    mode: str = "AUDIT"


@dataclass(frozen=True)
class Rule:
    """Settings of one field (of one table, or of all)."""

    field: str
    table: str | None = None
    severity: str | None = None
    skip: frozenset[str] = frozenset()
    drift_z_warn: float | None = None
    drift_z_fail: float | None = None
    null_warn: float | None = None
    null_fail: float | None = None


@dataclass(frozen=True)
class Enforcement:
    """What a contract and its registry make of the checks: the last mode holds, skips add up, the later rule of a field replaces the earlier."""

    mode: str = "AUDIT"
    skip: frozenset[str] = frozenset()
    rules: tuple[Rule, ...] = ()

    def merged(self, other: Enforcement) -> Enforcement:
        by = {(r.field, r.table): r for r in (*self.rules, *other.rules)}
        return Enforcement(other.mode or self.mode, self.skip | other.skip, tuple(by.values()))

    def rule(self, table: str, column: str) -> Rule | None:
        own = [r for r in self.rules if r.field == column and r.table in (None, table)]
        return max(own, key=lambda r: r.table is not None, default=None)

    def skips(self, table: str, column: str, check: str) -> bool:
        rule = self.rule(table, column)
        return check in self.skip or bool(rule and check in rule.skip)

    def severity(self, table: str, column: str, given: str) -> str:
        rule = self.rule(table, column)
        return (rule and rule.severity) or given


@dataclass(frozen=True)
class Config:
    """Thresholds; ``LEDGERLINE_<NAME>`` in the environment replaces one, unless it is no number."""

    drift_z_warn: float = 2.0
    drift_z_fail: float = 3.0
    drift_var_warn_high: float = 2.0
    drift_var_fail_high: float = 4.0
    drift_var_warn_low: float = 0.25
    drift_null_warn: float = 0.05
    drift_null_fail: float = 0.20
    drift_card_warn_high: float = 2.0
    drift_card_warn_low: float = 0.5
    drift_card_fail_high: float = 5.0
    llm_violation_rate: float = 0.05
    llm_trend_delta: float = 0.05
    embedding_warn: float = 0.1
    embedding_fail: float = 0.3
    prompt_fail_rate: float = 0.10
    enum_limit: int = 10
    sample_limit: int = 10
    blame_candidates: int = 5
    git_log_limit: int = 20
    blame_per_day: float = 0.1
    blame_per_hop: float = 0.2
    critical_penalty: float = 20.0
    fresh_warn_hours: float = 24.0
    fresh_fail_hours: float = 72.0

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ) if env is None else env
        out = cls()
        for f in fields(cls):
            try:
                out = replace(out, **{f.name: type(f.default)(env[f"LEDGERLINE_{f.name.upper()}"])})
            except (KeyError, ValueError):
                pass
        return out


@dataclass
class Registry:
    """Subscriptions of consumers to contracts."""

    subscriptions: list[dict] = field(default_factory=list)

    def normalised(self) -> Registry:
        """Breaking fields without a name are left out."""
        return Registry([{**s, "breaking_fields": [b for b in s.get("breaking_fields") or [] if b.get("field")]} for s in self.subscriptions])
