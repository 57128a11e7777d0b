"""Secret scan: multipart credential linking.

Strong parts are reported as they stand: assignments, access identifiers and hex strings. Weak parts say little
alone: a named user or client (``user``), a host or URL (``host``), a mixed string (``mixed``).
The scope of a part is the text within ``reach`` characters of it. Parts of a document are joined by scope: the intervals are
sorted by start, and a weak part looks up the nearest part of each other role before and
behind it. It is reported only where complementary roles meet: an identifier with a secret, or a
host with both.

A document is joined within itself, so the scan needs no shuffle; a lookup costs a binary search, whatever
the number of parts.

Defined results: a null or empty text has no spans; repeated rows give repeated results; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
#: A longer run is the same match as the plain one of at least this length, as the class is closed.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

WEAK = {
    "user": re.compile(r"""(?<![A-Za-z0-9])(user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})""", re.A | re.I),
    "host": re.compile(r"""https?://[^\s"'<>]{4,}|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])""", re.A),
    "mixed": re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.A),
}
#: What a whole token of the kind must hold.
HOLDS = {"mixed": [re.compile(c) for c in ("[0-9]", "[a-z]", "[A-Z]")]}
KINDS = ["assign", "access", "hex", *WEAK]
ROLE = {"assign": "secret", "hex": "secret", "mixed": "secret", "access": "identifier", "user": "identifier", "host": "host"}
NEEDS = {"secret": ["identifier"], "identifier": ["secret"], "host": ["identifier", "secret"]}

RESULT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"


def strong_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end)."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def weak_spans(text: str, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak parts that overlap no strong one."""
    taken = sorted((a, b) for a, _, b in strong)
    ends = running_max(taken)
    starts = [a for a, _ in taken]
    out = []
    for number, (kind, pattern) in enumerate(WEAK.items(), 3):
        for m in pattern.finditer(text):
            if not all(c.search(m[0]) for c in HOLDS.get(kind, ())):
                continue
            k = bisect_left(starts, m.end())
            if not k or ends[k - 1] <= m.start():
                out.append((m.start(), number, m.end()))
    return out


def running_max(spans: list[tuple[int, int]]) -> list[int]:
    out, most = [], 0
    for _, b in spans:
        most = max(most, b)
        out.append(most)
    return out


class Reach:
    """Intervals of one role, to ask whether one lies within reach of another interval."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.starts = [a for a, _ in self.spans]
        self.ends = running_max(self.spans)

    def meets(self, start: int, end: int, reach: int) -> bool:
        """One that starts by end + reach and ends no earlier than start - reach."""
        k = bisect_left(self.starts, end + reach + 1)
        return bool(k) and self.ends[k - 1] >= start - reach


def scan_text(text: str | None, reach: int) -> tuple:
    text = text or ""
    strong = strong_spans(text)
    weak = weak_spans(text, strong)
    linked = []
    if weak:
        roles: dict[str, list[tuple[int, int]]] = {"secret": [], "identifier": [], "host": []}
        for a, k, b in strong + weak:
            roles[ROLE[KINDS[k]]].append((a, b))
        near = {role: Reach(spans) for role, spans in roles.items()}
        linked = [s for s in weak if all(near[r].meets(s[0], s[2], reach) for r in NEEDS[ROLE[KINDS[s[1]]]])]
    show = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    count = [sum(k == n for _, k, _ in strong) for n in range(3)]
    return (*count, hashlib.sha256(show(strong).encode()).hexdigest(), show(strong + linked), len(linked))


def scan_credentials(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """One row per document: doc_id and the columns of RESULT."""
    @F.pandas_udf(RESULT)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        for batch in texts:
            yield pd.DataFrame([scan_text(t, reach) for t in batch], columns=names)

    return docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col)).alias("found")).select("doc_id", "found.*")
