"""Checks of documents: model registries, sealed bundles, traced claims, snapshot schedules.

These are driver-side: the documents are small by nature.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from datetime import date

from rankforge.operators.contracts import SEVERITY

#: The registry's domains.
LEAKAGE_STATES = ("RESOLVED_CLEAN", "RESOLVED_OVERLAP", "UNRESOLVED")
AVAILABILITY = ("AVAILABLE", "GATED", "UNAVAILABLE")
REGISTRY_FIELDS = {"model_id": str, "family": str, "checkpoint_identifier": str, "version": str, "licence": str, "documented_pretraining_corpora": list, "leakage_status": str, "availability": str, "enabled_by_default": bool}
OPTIONAL_FIELDS = {"parameter_count": int, "notes": str}


@dataclass(frozen=True)
class Check:
    name: str
    status: str
    detail: str = ""


def worst(checks: Iterable[Check]) -> str:
    return max((c.status for c in checks), key=SEVERITY.index, default="PASS")


def check_registry(entries: list[dict]) -> list[Check]:
    out, seen = [], set()
    for entry in entries:
        name = str(entry.get("model_id", "?"))
        problems = [f for f, kind in REGISTRY_FIELDS.items() if not isinstance(entry.get(f), kind)]
        problems += [f for f, kind in OPTIONAL_FIELDS.items() if entry.get(f) is not None and not isinstance(entry[f], kind)]
        problems += sorted(set(entry) - set(REGISTRY_FIELDS) - set(OPTIONAL_FIELDS))
        if entry.get("leakage_status") not in LEAKAGE_STATES:
            problems.append("leakage_status")
        if entry.get("availability") not in AVAILABILITY:
            problems.append("availability")
        if name in seen:
            problems.append("model_id repeats")
        if entry.get("enabled_by_default") and (not entry.get("documented_pretraining_corpora") or entry.get("leakage_status") == "UNRESOLVED"):
            problems.append("enabled by default without a known provenance")
        seen.add(name)
        out.append(Check(name, "FAIL" if problems else "PASS", ", ".join(dict.fromkeys(problems))))
    return out


def json_path(document: object, path: str) -> object:
    """Value at a dotted path; list places are numbers."""
    for step in path.split("."):
        document = document[int(step)] if isinstance(document, list) else document[step]
    return document


def same_value(a: object, b: str, tolerance: float = 5e-7) -> bool:
    try:
        return math.isclose(float(a), float(b), rel_tol=0.0, abs_tol=tolerance)
    except (TypeError, ValueError):
        return str(a) == b


_CLAIM = re.compile(r"<!--\s*claim\s+file=(\S+)\s+path=(\S+)\s+value=(\S+)\s*-->")


def check_claims(text: str, load: Callable[[str], object]) -> list[Check]:
    """Every marked claim of a text against the document that it names."""
    out = []
    for file, path, value in _CLAIM.findall(text):
        try:
            found = json_path(load(file), path)
            out.append(Check(f"{file}:{path}", "PASS" if same_value(found, value) else "FAIL", f"{found} and {value}"))
        except (KeyError, IndexError, OSError, ValueError, TypeError) as problem:
            out.append(Check(f"{file}:{path}", "FAIL", repr(problem)))
    return out


def add_months(day: date, months: int) -> date:
    """Months later; the day is the 28th at most."""
    at = day.year * 12 + day.month - 1 + months
    return date(at // 12, at % 12 + 1, min(day.day, 28))


def schedule(first: date, last: date, every: int) -> list[date]:
    out = []
    while (day := add_months(first, every * len(out))) <= last:
        out.append(day)
    return out


def decide_snapshot(gates: Mapping[date, str], first: date, last: date) -> tuple[str, date | None]:
    """("PASS", the first date whose gate passed), or ("WAIT", None)."""
    for day in sorted(gates):
        if not first <= day <= last:
            raise ValueError(f"{day} is outside the preregistered schedule")
        if gates[day] == "PASS":
            return "PASS", day
    return "WAIT", None


def check_bundle(files: Mapping[str, bytes], manifest: Mapping[str, str], totals: Mapping[str, int], summary: Mapping[str, object], tolerated: Iterable[str] = ()) -> list[Check]:
    """A sealed result bundle: files by digest, declared totals, intervals in order, the conclusion by the protocol's rule.

    `tolerated` names totals whose difference is a known warning.
    """
    out = [Check(f"file {n}", "PASS" if n in files and hashlib.sha256(files[n]).hexdigest() == d else "FAIL") for n, d in sorted(manifest.items())]
    out += [Check(f"undeclared {n}", "FAIL") for n in sorted(set(files) - set(manifest))]
    for name, n in totals.items():
        off = summary.get(name) != n
        out.append(Check(f"total {name}", ("WARNING" if name in set(tolerated) else "FAIL") if off else "PASS", f"{summary.get(name)} and {n}" if off else ""))
    low, delta, high = (float(summary[k]) for k in ("lower", "delta", "upper"))
    out.append(Check("interval order", "PASS" if low <= high and low <= delta <= high else "FAIL"))
    rule = "SUPPORTED" if low > 0 else "NOT_SUPPORTED"
    out.append(Check("conclusion", "PASS" if summary.get("conclusion") == rule else "FAIL", f"{summary.get('conclusion')}, by rule {rule}"))
    out.append(Check("single holdout access", "PASS" if summary.get("holdout_access_count") == 1 else "FAIL"))
    return out


def freeze_protocol(protocol: Mapping[str, object]) -> dict:
    """A protocol with the digest of its canonical form."""
    text = json.dumps(protocol, sort_keys=True, separators=(",", ":"))
    return {**protocol, "protocol_sha256": hashlib.sha256(text.encode()).hexdigest()}


def protocol_intact(frozen: Mapping[str, object]) -> bool:
    rest = {k: v for k, v in frozen.items() if k != "protocol_sha256"}
    return freeze_protocol(rest)["protocol_sha256"] == frozen.get("protocol_sha256")
