"""Secrets: fixed patterns plus sliding-window Shannon entropy over candidate strings.

A candidate is a maximal run of key characters. Windows of `WINDOW` characters slide over it; the counts of characters
and the sum of c*log2(c) change by one character in and one out, so a candidate of any length costs linear time. The
threshold of a window depends on its character class (hexadecimal, alphanumeric, with symbols), and a window needs both
letters and digits. Qualifying windows that touch become one span of kind `entropy`. Spans that overlap a fixed
pattern, and candidates on the allow-list (exact strings, or patterns for the whole candidate), are left out. A
candidate that is a host name, perhaps with a path, is not random for its dots and slashes: its labels and path
segments are scanned one by one, so that a token among them is found and the name around it is not.

Cases: a null text counts as empty and has no spans. Texts of any length are scanned whole. Repeated rows get equal
results, an empty table an empty one; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

from chronoweave.llm.common import map_texts

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits a character; fixed values.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "symbols": 3.9}
#: Strings that documents quote as placeholders, and forms that are no secrets.
ALLOWED_STRINGS = frozenset({"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdefghijklmnopqrstuvwxyz"})
ALLOWED_PATTERNS = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
    r"[0-9+.=/_-]+",  # numbers, dates, rules
)

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{WINDOW},}}")
_HOST = re.compile(r"/*[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?=/|$)")
_LABEL, _SEGMENT = re.compile(r"[^./]+"), re.compile(r"[^/]+")
_HEX_CHARS = frozenset("0123456789abcdef")
_CLOG = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]


def entropy_spans(s: str) -> list[tuple[int, int]]:
    """Merged windows of `s` whose entropy reaches the threshold of their class."""
    if len(s) < WINDOW:
        return []
    counts: dict[str, int] = {}
    total, letters, digits, plain_hex, symbols = 0.0, 0, 0, 0, 0
    out: list[tuple[int, int]] = []
    for i, c in enumerate(s):
        for ch, step in ((s[i - WINDOW] if i >= WINDOW else "", -1), (c, 1)):
            if not ch:
                continue
            n = counts.get(ch, 0)
            total += _CLOG[n + step] - _CLOG[n]
            counts[ch] = n + step
            letters += step * (ch.isalpha())
            digits += step * (ch.isdigit())
            symbols += step * (not ch.isalnum())
            plain_hex += step * (ch in _HEX_CHARS)
        if i < WINDOW - 1 or not letters or not digits:
            continue
        kind = "hex" if plain_hex == WINDOW else "symbols" if symbols else "alnum"
        if math.log2(WINDOW) - total / WINDOW >= THRESHOLDS[kind]:
            start, end = i + 1 - WINDOW, i + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], end)
            else:
                out.append((start, end))
    return out


class Scanner:
    def __init__(self, allowed_strings=ALLOWED_STRINGS, allowed_patterns=ALLOWED_PATTERNS):
        self.strings = frozenset(allowed_strings)
        self.patterns = re.compile("|".join(f"(?:{p})" for p in allowed_patterns)) if allowed_patterns else None

    def allowed(self, s: str) -> bool:
        return s in self.strings or bool(self.patterns and self.patterns.fullmatch(s))

    def spans(self, text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Spans of the fixed patterns, and those that the entropy adds."""
        if not text:
            return [], []
        base = []
        low = text.lower()
        if any(w in low for w in _WORDS):
            base += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
        if "AKIA" in text:
            base += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
        runs = list(_CANDIDATE.finditer(text))
        base += [("hex", m.start(), m.end()) for r in runs for m in _HEX.finditer(text, r.start(), r.end())]
        fixed = sorted((s, e) for _, s, e in base)
        opens, closes = [s for s, _ in fixed], list(accumulate((e for _, e in fixed), max))
        more = []
        for r in runs:
            if self.allowed(r[0].strip(".=-_/+")):
                continue
            for a, b in self.random_parts(r[0]):
                a, b = a + r.start(), b + r.start()
                before = bisect_left(opens, b)  # fixed spans that begin before b
                if not before or closes[before - 1] <= a:
                    more.append(("entropy", a, b))
        return base, more

    def random_parts(self, s: str) -> list[tuple[int, int]]:
        """Spans of high entropy in a candidate; a host name and its path go piece by piece."""
        host = _HOST.match(s)
        if not host:
            return entropy_spans(s)
        pieces = [*_LABEL.finditer(s, 0, host.end()), *_SEGMENT.finditer(s, host.end())]
        return [(p.start() + a, p.start() + b) for p in pieces if not self.allowed(p[0].strip(".=-_+")) for a, b in entropy_spans(p[0])]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", allowed_strings=ALLOWED_STRINGS, allowed_patterns=ALLOWED_PATTERNS) -> DataFrame:
    """Rows (key, base, spans): joined kind:start:end, code points, end exclusive; `spans` holds the base ones too."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(allowed_strings, allowed_patterns)
        for frame in frames:
            found = [scanner.spans(t) for t in frame["text"]]
            yield pd.DataFrame({"key": frame["key"], "base": [_joined(b) for b, _ in found], "spans": [_joined(b + m) for b, m in found]})

    return map_texts(docs, key, text, run, "base string, spans string")
