"""The line-detector table as Python values."""

from __future__ import annotations

import csv
from functools import lru_cache
from importlib.resources import files
from typing import NamedTuple


class Detector(NamedTuple):
    language: str
    rule_id: str
    pattern: str
    #: The line must hold this text as well, if any.
    also_contains: str
    #: The line must not match this pattern, if any.
    unless: str
    severity: str
    confidence: str


@lru_cache(1)
def detectors() -> tuple[Detector, ...]:
    """All detectors in table order."""
    text = files(__package__).joinpath("detectors.tsv").read_text(encoding="utf-8")
    rows = (x for x in text.splitlines() if x and not x.startswith("#"))
    return tuple(Detector(**row) for row in csv.DictReader(rows, delimiter="\t", quoting=csv.QUOTE_NONE))


#: A header line of a manifest, what one of the next lines must match, how many lines are
#: looked at, and the finding, which sits on the header line.
LOOK_AHEADS = (
    (r"^\s*capabilities:", r"^\s*add:", 5, "capabilities-add"),
    (r"^\s*env:", r'value:.*"|".*value:|(?i:name:\s*.*(password|secret))', 7, "secrets-in-env"),
    (r"^\s*- name:", r"^\s*hostPath:", 5, "host-path"),
    (r"^\s*roleRef:", r"name:\s*cluster-admin", 5, "cluster-admin-binding"),
)
