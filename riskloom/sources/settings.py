"""Policies and baselines: small files that the driver reads."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field
from datetime import date

from .. import fixed


class PolicyError(ValueError):
    """A policy that cannot be used."""


@dataclass(frozen=True)
class Ignore:
    rule: str = "*"
    package: str = "*"
    reason: str = ""
    expires: date | None = None


@dataclass(frozen=True)
class Policy:
    fail_on: str = "high"
    fresh_days: int = 14
    correlate: bool = True
    disable: frozenset[str] = frozenset()
    ignores: tuple[Ignore, ...] = ()
    expired: tuple[Ignore, ...] = field(default=())


def _ignore(raw: dict, path: str) -> Ignore:
    expires = raw.get("expires")
    if isinstance(expires, str):
        try:
            expires = date.fromisoformat(expires)
        except ValueError as e:
            raise PolicyError(f"{path}: {raw['expires']!r} is not a date") from e
    elif expires is not None and not isinstance(expires, date):
        raise PolicyError(f"{path}: an ignore expires on an ISO date")
    return Ignore(str(raw.get("rule", "*")).upper(), str(raw.get("package", "*")), str(raw.get("reason", "")), expires)


def read_policy(path: str | None, today: date) -> Policy:
    """A policy file, checked; without a path the defaults. Ignores that expired before ``today`` are set apart."""
    if path is None:
        return Policy()
    try:
        with open(path, "rb") as f:
            doc = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise PolicyError(f"{path} cannot be read: {e}") from e
    fail_on, days, correlate = str(doc.get("fail_on", "high")).lower(), doc.get("fresh_days", 14), doc.get("correlate", True)
    disable, ignores = doc.get("disable", []), doc.get("ignore", [])
    try:
        days = int(days)
    except (TypeError, ValueError):
        days = -1
    for wrong, what in (
        (fail_on not in fixed.FAIL_LEVELS, f"fail_on is one of {', '.join(fixed.FAIL_LEVELS)}"),
        (days < 0, "fresh_days is a whole number from 0"),
        (not isinstance(correlate, bool), "correlate is true or false"),
        (not isinstance(disable, list) or not all(isinstance(x, str) for x in disable), "disable is a list of rule ids"),
        (not isinstance(ignores, list) or not all(isinstance(x, dict) for x in ignores), "ignore is an array of tables"),
    ):
        if wrong:
            raise PolicyError(f"{path}: {what}")
    read = [_ignore(x, path) for x in ignores]
    old = [x for x in read if x.expires is not None and x.expires < today]
    return Policy(fail_on, days, correlate, frozenset(x.upper() for x in disable), tuple(x for x in read if x not in old), tuple(old))


def read_baseline(path: str) -> frozenset[str] | None:
    """Accepted findings; None if the file is missing, broken or of another format."""
    try:
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
    except (OSError, ValueError):
        return None
    return frozenset(doc.get("accepted") or []) if isinstance(doc, dict) and doc.get("format") == 1 else None


def write_baseline(path: str, fingerprints: list[str], created: str) -> int:
    """Write accepted findings, sorted; returns how many."""
    doc = {"format": 1, "created": created, "accepted": sorted(fingerprints)}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2)
        f.write("\n")
    return len(fingerprints)


def default_path(root: str, name: str) -> str | None:
    path = os.path.join(root, name)
    return path if os.path.isfile(path) else None
