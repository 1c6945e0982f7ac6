"""An optional language-model assistant.  It is asked on the driver only, for distinct values, never per row."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from quarrystone.operators.rules import CUSTOM_TYPES

# JSON shapes of the answers.
_NUMBER, _TEXT = {"type": "number"}, {"type": "string"}


def _object(**fields) -> dict:
    return {"type": "object", "properties": fields, "required": list(fields)}


MAPPING_SCHEMA = _object(decisions={"type": "array", "items": _object(raw=_TEXT, canonical=_TEXT, confidence=_NUMBER)})
PAIR_SCHEMA = _object(decisions={"type": "array", "items": _object(pair={"type": "integer"}, decision={"enum": ["same", "different", "unsure"]}, confidence=_NUMBER, explanation=_TEXT)})
CAUSE_SCHEMA = _object(cause=_TEXT, action=_TEXT)


_PATTERN, _BOUND = {"type": ["string", "null"]}, {"type": ["number", "null"]}
RULE_SCHEMA = _object(
    name=_TEXT, entity={"enum": ["vendor", "invoice"]}, column=_TEXT, type={"enum": list(CUSTOM_TYPES)}, pattern=_PATTERN, values={"type": ["array", "null"], "items": _TEXT}, min=_BOUND, max=_BOUND,
    dimension={"enum": ["completeness", "validity", "uniqueness", "timeliness", "consistency"]}, severity={"enum": ["low", "medium", "high"]},
)
RECOMMENDATION_SCHEMA = _object(recommendation={"enum": ["match", "no_match", "unsure"]}, rationale=_TEXT, what_to_check=_TEXT)


class Assistant(Protocol):
    def complete_json(self, system: str, prompt: str, schema: dict) -> dict | None: ...


@dataclass
class Budgeted:
    """Stops at a number of calls and turns failures into None, so that runs go on by the rules alone."""

    inner: Assistant | None = None
    most_calls: int = 50
    calls: int = 0
    failures: list[str] = field(default_factory=list)

    def complete_json(self, system: str, prompt: str, schema: dict) -> dict | None:
        if self.inner is None or self.calls >= self.most_calls:
            return None
        self.calls += 1
        try:
            return self.inner.complete_json(system, prompt, schema)
        except Exception as e:  # noqa: BLE001  whatever a provider raises
            self.failures.append(repr(e))
            return None


def ask_mappings(client: Budgeted, domain: str, values: list[str], options: list[str], per_call: int = 40) -> dict[str, tuple[str | None, float]]:
    """canonical value (None: left out) and confidence of the values that were asked; answers for other values are
    dropped, confidences clamped.  Values of a call that failed are missing, so that they can be asked again."""
    out = {}
    for at in range(0, len(values), per_call):
        part = values[at : at + per_call]
        got = client.complete_json(f"Map each {domain} to one of the options or leave it out.", f"options: {options}\nvalues: {part}", MAPPING_SCHEMA)
        if got is None:
            continue
        out.update(dict.fromkeys(part, (None, 0.0)))
        for d in got.get("decisions", []):
            if d.get("raw") in part and d.get("canonical"):
                out[d["raw"]] = (d["canonical"], min(1.0, max(0.0, float(d.get("confidence", 0)))))
    return out


def ask_cause(client: Budgeted, alert: str, metrics: dict, changes: str) -> tuple[str, str] | None:
    """Likely cause and first action of an alert."""
    got = client.complete_json("Give the likely cause and the first action for a data steward, from these numbers only.", f"alert: {alert}\nmetrics: {metrics}\nrule changes: {changes}", CAUSE_SCHEMA) or {}
    return (str(got["cause"]), str(got["action"])) if got.get("cause") and got.get("action") else None


def ask_pairs(client: Budgeted, pairs: list[dict], per_call: int = 10) -> list[dict]:
    """Opinions (fingerprint, decision, confidence, explanation) on pairs with fingerprint and text."""
    out = []
    for at in range(0, len(pairs), per_call):
        part = pairs[at : at + per_call]
        got = client.complete_json("Are both records the same company?", "\n".join(f"{i}: {p['text']}" for i, p in enumerate(part)), PAIR_SCHEMA) or {}
        for d in got.get("decisions", []):
            if isinstance(d.get("pair"), int) and 0 <= d["pair"] < len(part):
                out.append({"fingerprint": part[d["pair"]]["fingerprint"], "decision": d.get("decision"), "confidence": min(1.0, max(0.0, float(d.get("confidence", 0)))), "explanation": d.get("explanation", "")})
    return out


def ask_rule(client: Budgeted, sentence: str, columns: dict[str, list[str]]) -> dict | None:
    """Fields of a rule for a sentence, or None if the answer isn't one that may be used: an entity and a column that
    are there, a type open to custom rules, and what that type needs."""
    got = client.complete_json("Write one data quality rule for this sentence, with the columns that there are.", f"columns: {columns}\nsentence: {sentence}", RULE_SCHEMA) or {}
    entity, kind, column = got.get("entity"), got.get("type"), got.get("column")
    if entity not in columns or column not in columns[entity] or kind not in CUSTOM_TYPES or not got.get("name"):
        return None
    number = lambda x: float(x) if isinstance(x, int | float) and not isinstance(x, bool) else None
    out = {"name": str(got["name"])[:120], "entity": entity, "type": kind, "column": column}
    out |= {k: got[k] for k, of in (("dimension", RULE_SCHEMA), ("severity", RULE_SCHEMA)) if got.get(k) in of["properties"][k]["enum"]}
    if kind == "regex":
        out["pattern"] = got.get("pattern") or ""
    if kind == "range":
        out |= {"low": number(got.get("min")), "high": number(got.get("max"))}
    if kind == "allowed_values":
        out["values"] = tuple(map(str, got.get("values") or ()))
    return out


def ask_recommendation(client: Budgeted, pair: dict) -> dict | None:
    """What to answer for a pair under review, why, and what to check."""
    shown = {k: pair.get(k) for k in ("left_name", "right_name", "score", "band", "explanation")}
    got = client.complete_json("Advise a data steward whether both records are the same company.", str(shown), RECOMMENDATION_SCHEMA) or {}
    if got.get("recommendation") not in RECOMMENDATION_SCHEMA["properties"]["recommendation"]["enum"] or not got.get("rationale"):
        return None
    return {k: str(got.get(k, "")) for k in ("recommendation", "rationale", "what_to_check")}
