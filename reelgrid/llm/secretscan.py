"""Secrets: exact patterns, and multipart credentials whose parts are weak alone.

Access identifiers, secret-like values and endpoints are weak candidates. They are reported only where
complementary parts stand within one scope: an identifier or an endpoint next to a secret, and each part
next to the secret it belongs to. An endpoint may hold its secret (user part, path or query); then both are
reported. Parts and scopes are intervals; the join sorts both and searches bounds, so its cost is linear in
the parts, not in their pairs. Values of any length are found whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .spans import Span, free_of, tabled

BASE = ("assign", "access", "hex")
PARTS = ("identifier", "credential", "endpoint")
KINDS = (*BASE, *PARTS)

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

IDENTIFIER = re.compile(
    r"""\b(?:client[_-]?id|access[_-]?key(?:[_-]?id)?|account(?:[_-]?id)?|tenant|user(?:name)?|login|key[_-]?id)["']?\x20?[:=]\x20?["']?([A-Za-z0-9_.@-]{3,})""",
    re.ASCII | re.IGNORECASE,
)
ENDPOINT = re.compile(
    r"""\b(?:https?|ftp|ssh|amqp|redis|mongodb|postgres(?:ql)?|mysql)://[^\s"'<>]{4,}|\b(?:host|endpoint|server|bucket|url)["']?\x20?[:=]\x20?["']?[A-Za-z0-9_.:/-]{4,}""",
    re.ASCII | re.IGNORECASE,
)
# A run of credential letters; the run as a whole is judged.
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
# Host and path of an endpoint: a slash ends a segment there, and each is judged by itself.
ROUTE = re.compile(r"(?<=://)(?:[^\s\"'<>?#]*@)?([^\s\"'<>?#]+)")
WEAK = re.compile(r"""\b(?:pass|pwd|key|auth|cred(?:ential)?s?)["']?\x20?[:=]\x20?["']?([A-Za-z0-9+/_.=!$%&*-]{6,})""", re.ASCII | re.IGNORECASE)


@dataclass(frozen=True)
class Scope:
    """reach: code points between two parts of one credential; least_bits: entropy of a secret, per letter."""

    reach: int = 200
    least: int = 16
    least_bits: float = 3.2


def base_spans(text: str) -> list[Span]:
    """Pattern matches, leftmost and non-overlapping per kind, without those that are too short."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def bits(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


def secret_like(value: str, how: Scope) -> bool:
    """Letters of three classes (upper, lower, digit) in a dense mixture."""
    return (
        how.least <= len(value) and any(map(str.isdigit, value)) and any(map(str.islower, value)) and any(map(str.isupper, value))
        and bits(value) >= how.least_bits
    )


def parts(text: str, how: Scope) -> list[Span]:
    """Weak candidates of each part."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [("identifier", *m.span(1)) for m in IDENTIFIER.finditer(text)]
        out += [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
        out += [("credential", *m.span(1)) for m in WEAK.finditer(text)]
    if "AKIA" in text:
        out += [("identifier", *m.span()) for m in ACCESS.finditer(text) if 8 <= m.end() - m.start() < 20]
    routes, at = [m.span(1) for m in ROUTE.finditer(text)] if "://" in text else [], 0
    for m in RUN.finditer(text):
        if m.end() - m.start() >= how.least:
            while at < len(routes) and routes[at][1] <= m.start():
                at += 1
            for a, b in _pieces(text, *m.span(), *(routes[at] if at < len(routes) else (len(text), len(text)))):
                if b - a >= how.least and secret_like(text[a:b], how):
                    out.append(("credential", a, b))
    return out


def _pieces(text: str, a: int, b: int, start: int, end: int) -> list[tuple[int, int]]:
    """The run from a to b, cut at slashes where it lies on the route from start to end."""
    cuts = [i for i in range(max(a, start), min(b, end)) if text[i] == "/"]
    return [(x, y) for x, y in zip([a, *(i + 1 for i in cuts)], [*cuts, b]) if x < y]


def near(spans: list[Span], others: list[Span], reach: int) -> list[bool]:
    """For each span: does another one of ``others`` stand within reach? An interval join by sorted bounds."""
    if not others:
        return [False] * len(spans)
    bounds = np.array(sorted((a, b) for _, a, b in others))
    furthest = np.maximum.accumulate(bounds[:, 1])
    # The last one that starts before the scope ends; among those up to it, the furthest end.
    at = np.searchsorted(bounds[:, 0], [b + reach for _, _, b in spans], side="right") - 1
    return [i >= 0 and int(furthest[i]) >= a - reach for i, (_, a, _) in zip(at.tolist(), spans)]


def apart(spans: list[Span], others: list[Span], reach: int) -> list[bool]:
    """As ``near``, but the other one must not overlap: it ends before the span or starts behind it."""
    starts, ends = sorted(a for _, a, _ in others), sorted(b for _, _, b in others)

    def holds(bounds: list[int], low: int, high: int) -> bool:
        at = bisect_left(bounds, low)
        return at < len(bounds) and bounds[at] <= high

    return [holds(ends, a - reach, a) or holds(starts, b, b + reach) for _, a, b in spans]


def within(endpoints: list[Span], secrets: list[Span]) -> set[Span]:
    """Endpoints and secrets that overlap where the secret is not the whole endpoint. Each list is sorted and disjoint."""
    out: set[Span] = set()
    i = j = 0
    while i < len(endpoints) and j < len(secrets):
        (_, a, b), (_, c, d) = endpoints[i], secrets[j]
        if a < d and c < b and not (c <= a and b <= d):
            out |= {endpoints[i], secrets[j]}
        i, j = (i + 1, j) if b <= d else (i, j + 1)
    return out


def linked(text: str, base: list[Span], how: Scope) -> list[Span]:
    """Weak parts with a complement in scope; exact matches count as identifier or secret, too.

    Parts of different kinds may overlap. An identifier is no complement of a secret in the same letters.
    """
    every = parts(text, how)
    if not every:
        return []
    kinds = {k: _longest([s for s in every if s[0] == k]) for k in PARTS}
    ids, secrets, ends = free_of(kinds["identifier"], base), free_of(kinds["credential"], base), kinds["endpoint"]
    exact, marks, inside = [s for s in base if s[0] != "access"], [s for s in base if s[0] == "access"], within(ends, secrets)
    out = [s for s, *ok in zip(secrets, apart(secrets, [*ids, *ends], how.reach), near(secrets, marks, how.reach)) if any(ok) or s in inside]
    out += [s for s, *ok in zip(ids, apart(ids, secrets, how.reach), near(ids, exact, how.reach)) if any(ok)]
    # An endpoint around an exact match is a mark for others; the match stands for it.
    return out + free_of([s for s, *ok in zip(ends, apart(ends, secrets, how.reach), near(ends, exact, how.reach)) if any(ok) or s in inside], base)


def _longest(spans: list[Span]) -> list[Span]:
    """Of overlapping candidates of one kind the longer."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[1], -s[2])):
        if out and s[1] < out[-1][2]:
            if s[2] - s[1] > out[-1][2] - out[-1][1]:
                out[-1] = s
        else:
            out.append(s)
    return out


def find_secrets(df: DataFrame, how: Scope = Scope(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, span_list`` of every row.

    Counts and digest are those of the exact patterns; ``spans`` and ``span_list`` hold linked parts of the
    kinds identifier, credential and endpoint too. A null or empty text has no spans. Null ids and repeated
    rows come back as they are; other columns are left out; an empty table gives an empty one. Whole
    texts of any length are searched.
    """
    return tabled(df, lambda: finder(how), BASE, KINDS, id_col, text_col)


def finder(how: Scope) -> Callable[[list[str]], list[tuple[list[Span], list[Span]]]]:
    def find(texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        return [(base, linked(t, base, how)) for t in texts for base in [base_spans(t)]]

    return find
