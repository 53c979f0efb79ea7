"""Visibility, validity and freshness as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States that ordinary recall, profiles and every surface hide.
DURABLE_HIDDEN = ("archived", "obsolete", "rejected", "superseded")
PROFILE_HIDDEN = (*DURABLE_HIDDEN, "candidate", "scratch")
ORDINARY_HIDDEN = (*PROFILE_HIDDEN, "in_progress")
# Severities of freshness states, and days a memory type stays fresh.
CURRENT_STATUSES = ("current", "fresh", "valid", "verified", "ok")
NEEDS_CHECK_STATUSES = ("needs_live_check", "unknown", "unchecked", "expired")
STALE_STATUSES = ("stale", "invalid", "superseded", "outdated")
SEVERITY = {"current": 0, "fresh": 0, "valid": 0, "verified": 0, "ok": 0, "unknown": 1, "unchecked": 1, "needs_live_check": 2, "expired": 2, "stale": 3, "invalid": 3, "superseded": 3, "outdated": 3}
TTL_DAYS = {"factual": 30, "preference": 365, "procedure": 180, "workflow": 180, "tool_trace": 30, "project": 30, "summary": 30, "pitfall": 180, "decision": 0, "episodic": 0, "resource": 365, "constraint": 365}


def json_text(metadata: str | Column, path: str) -> Column:
    """A path of a JSON text; null for what is missing and for invalid JSON."""
    return F.get_json_object(metadata, path)


def lifecycle(metadata: str | Column = "metadata") -> Column:
    return F.lower(F.coalesce(json_text(metadata, "$.lifecycle"), F.lit("")))


def ordinary_visible(metadata: str | Column = "metadata", target: str | Column = "target") -> Column:
    """Ordinary recall: no hidden state, except scratch of the general target."""
    general = F.lower(F.coalesce(F.col(target) if isinstance(target, str) else target, F.lit(""))) == "general"
    return ~lifecycle(metadata).isin(*ORDINARY_HIDDEN) | (general & (lifecycle(metadata) == "scratch"))


def durable_visible(metadata: str | Column = "metadata") -> Column:
    return ~lifecycle(metadata).isin(*DURABLE_HIDDEN)


def profile_visible(metadata: str | Column = "metadata", include_candidates: bool = False) -> Column:
    """Promoted (also where nothing is said), or with candidates whatever is not terminal."""
    if include_candidates:
        return durable_visible(metadata)
    state = lifecycle(metadata)
    return F.when(state == "", "promoted").otherwise(state) == "promoted"


def valid_at(instant: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Half-open [start, end) holds the instant; null ends are open."""
    return (F.col(start).isNull() | (F.col(start) <= instant)) & (F.col(end).isNull() | (F.col(end) > instant))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Two half-open intervals with open null ends share an instant."""
    before = F.coalesce(a_end <= b_start, F.lit(False))
    after = F.coalesce(b_end <= a_start, F.lit(False))
    return ~(before | after)


def current_claim(instant: Column) -> Column:
    return (F.col("status") == "current") & F.col("retired_at").isNull() & valid_at(instant)


def uncertain(status: str = "status", kind: str = "assertion_kind", confidence: str = "confidence") -> Column:
    return (F.col(status) == "uncertain") | (F.col(kind) == "inferred") | (F.col(confidence) < 0.75)


def freshness_status(status: Column, valid_until: Column, now: Column) -> Column:
    """A known status, 'unknown' for others; what was current is expired after its time."""
    name = F.replace(F.lower(F.trim(F.coalesce(status, F.lit("unknown")))), F.lit(" "), F.lit("_"))
    name = F.when(name == "needs-live-check", "needs_live_check").otherwise(name)
    name = F.when(name.isin(*CURRENT_STATUSES, *NEEDS_CHECK_STATUSES, *STALE_STATUSES), name).otherwise("unknown")
    return F.when(name.isin(*CURRENT_STATUSES) & (valid_until < now), "expired").otherwise(name)


def mapped(column: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for key, value in values.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def severity(status: Column) -> Column:
    return mapped(status, SEVERITY, 1)


def freshness_penalty(status: Column, kind: Column | None = None) -> Column:
    """Share of a score that staleness costs: 0 to 0.9."""
    base = F.when(status.isNull() | (status == "untracked"), F.least(F.lit(0.10), F.lit(0.18 - 0.01)))
    base = base.when(status.isin("needs_live_check", "unknown", "unchecked"), 0.18).when(status == "expired", 0.45)
    base = base.when(status.isin(*STALE_STATUSES), 0.35).otherwise(0.0)
    if kind is not None:
        base = F.when((kind == "operational_status") & (base > 0) & status.isNotNull(), F.greatest(base, F.lit(0.55))).otherwise(base)
    return F.least(F.greatest(base, F.lit(0.0)), F.lit(0.9))


def decay(updated_days: Column, created_days: Column, half_updated: float = 180, half_created: float = 360, floor: float = 0.65) -> Column:
    """Ages to a multiplier: 0.7 of the update's half-life and 0.3 of the creation's."""
    value = 0.7 * F.pow(F.lit(0.5), updated_days / half_updated) + 0.3 * F.pow(F.lit(0.5), created_days / half_created)
    return F.greatest(value, F.lit(floor))


def clamp01(column: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), column))


# Which memory types last, pass or are temporary, and how much decay weighs for each class.
DURABLE_TYPES = ("constraint", "decision", "environment_fact", "fact", "factual", "memory", "ops", "ops_procedure", "preference", "procedure", "project", "project_fact", "resource", "user_preference", "workflow")
EPISODIC_TYPES = ("episodic", "summary")
TEMPORARY_TYPES = ("scratch", "temporary", "temporary_state", "tool_trace")
TEMPORAL_WEIGHTS = {"episodic": 0.8, "temporary": 1.0, "durable_fact": 0.25, "default": 1.0}


def temporal_class(memory_type: Column, lifecycle: Column, target: Column) -> Column:
    """How a memory ages: episodic, temporary, durable_fact or default."""
    return (
        F.when(memory_type.isin(*EPISODIC_TYPES), "episodic")
        .when(memory_type.isin(*TEMPORARY_TYPES) | lifecycle.isin(*TEMPORARY_TYPES) | (F.lower(target) == "general"), "temporary")
        .when(memory_type.isin(*DURABLE_TYPES), "durable_fact")
        .otherwise("default")
    )


def current_state_rank(requested: Column, matched: Column, temporal: Column, status: Column, source: Column, target: Column) -> Column:
    """Authority on the present, if the question is after it and the row answers in its shape: 4 current, 3 curated, 1 else; 0."""
    rank = F.when(F.coalesce(temporal, F.lit(False)) | (F.coalesce(status, F.lit("")) == "current"), 4)
    rank = rank.when((source == "builtin-curated") & target.isin("user", "memory"), 3).otherwise(1)
    return F.when(requested & matched, rank).otherwise(0)


GENERAL_MODES = ("same-scope", "never", "always")


def general_allowed(target: Column, scope: Column, own_scope: Column, mode: Column, importance: Column, least: float | None = None) -> Column:
    """Whether a row passes the policy for the general target: always, never, or in its own scope from an importance on."""
    same = (mode == "same-scope") & (scope == own_scope)
    if least is not None:
        same = same & (F.coalesce(importance, F.lit(0.0)) >= least)
    return (target != "general") | (mode == "always") | F.coalesce(same, F.lit(False))


def is_candidate(metadata: str = "metadata", source: str = "source") -> Column:
    """Waiting for a review: a candidate by its state, or from an event digest without a state, and not decided since."""
    done = ("promoted", "archived", "rejected", "superseded", "obsolete", "in_progress")
    state = lifecycle(metadata)
    digest = F.lower(source).isin("event-digest", "memory-candidate") | F.coalesce(json_text(metadata, "$.event_digest"), F.lit("")).isin("1", "true")
    decided = F.lower(F.coalesce(json_text(metadata, "$.candidate_status"), F.lit("")))
    return ((state == "candidate") | (digest & state.isin("", "candidate"))) & ~state.isin(*done) & ~decided.isin(*done)
