"""Secrets in texts, and multipart credentials linked within scopes.

Three kinds of spans are found on their own (`assign`, `access`, `hex`). Parts that say little alone are weak candidates: an
identifier named as such (`weak_id`), a long token of mixed characters (`weak_secret`) and an address (`endpoint`). An
interval join within each text, whose two sides are the parts and the candidates grown by REACH code points on both sides, reports a
candidate only beside complementary parts of the same scope: an identifier beside a secret, a secret beside an
identifier, an endpoint beside both. Scopes are stretches of text without a blank line. Parts of one text lie in one row, so the
join needs no shuffle; it is a search in sorted starts, not a product of both sides.

Cases: a null or empty text has no spans; equal starts are ordered by kind as listed in KINDS; overlapping spans of different kinds all
stay; repeated rows give equal results; an empty table gives an empty one; other columns of the input are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cartlens.llm.storage import bound_batches
from cartlens.llm.text import slices

KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
BASE = KINDS[:3]
REACH = 300
LEAST_ENTROPY = 3.5

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
WEAK_ID = re.compile(r"""(?ai)(?:access|client|account|user|key)[_-]?(?:key[_-]?)?id["']?\x20*[:=]\x20*["']?([A-Za-z0-9_-]{6,})""")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+")
BLANK = re.compile(r"\n[ \t\r]*\n")

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Spans that are reported wherever they stand."""
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def _mixed(token: str) -> bool:
    """Digits and letters of both cases, spread like a random string."""
    if not (any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)):
        return False
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values()) >= LEAST_ENTROPY


def _beside(spans: list[Span], others: list[Span], scopes: list[int]) -> list[bool]:
    """For every span, whether one of `others` (which must not overlap it) begins or ends within REACH in its scope."""
    found = []
    starts = sorted((o[0], o[2]) for o in others)
    ends = sorted((o[2], o[0]) for o in others)
    for start, _, end in spans:
        scope = bisect_right(scopes, start)
        low = max(start - REACH, scopes[scope - 1] if scope else 0)
        high = min(end + REACH, scopes[scope] if scope < len(scopes) else math.inf)
        after = bisect_left(starts, (end, -1))
        before = bisect_right(ends, (start, math.inf)) - 1
        found.append(after < len(starts) and starts[after][0] < high or before >= 0 and ends[before][0] > low)
    return found


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates beside complementary parts."""
    strong_secret = [s for s in base if s[1] in (0, 2)]
    strong_id = [s for s in base if s[1] == 1]
    low = text.lower()
    ids = [(m.start(), 3, m.end()) for m in WEAK_ID.finditer(text)] if "id" in low and ("=" in text or ":" in text) else []
    addresses = [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    if not ids and not strong_id and not addresses:
        return []
    taken = sorted((s[0], s[2]) for s in [*base, *ids, *addresses])
    starts = [s for s, _ in taken]
    reach, most = [], -1
    for _, end in taken:
        most = max(most, end)
        reach.append(most)
    secrets = []
    for m in WEAK_SECRET.finditer(text):
        k = bisect_left(starts, m.end()) - 1
        if (k < 0 or reach[k] <= m.start()) and _mixed(m[0]):
            secrets.append((m.start(), 4, m.end()))
    scopes = [m.end() for m in BLANK.finditer(text)]
    all_ids, all_secrets = strong_id + ids, strong_secret + secrets
    near = lambda spans, others: _beside(spans, others, scopes)
    found = [s for s, ok in zip(ids, near(ids, all_secrets), strict=True) if ok]
    found += [s for s, ok in zip(secrets, near(secrets, all_ids), strict=True) if ok]
    both = zip(addresses, near(addresses, all_ids), near(addresses, all_secrets), strict=True)
    return found + [s for s, one, two in both if one and two]


def spans(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id and spans (array of kind, start, end in code points; end exclusive) of every row, by start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sizes, kinds, starts, ends = [0], [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                for start, kind, end in sorted(base + linked_spans(text, base)) if text else ():
                    kinds.append(KINDS[kind])
                    starts.append(start)
                    ends.append(end)
                sizes.append(len(kinds))
            items = pa.StructArray.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["kind", "start", "end"]
            )
            held = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items)
            yield pa.RecordBatch.from_arrays([batch.column("id"), held], ["id", "spans"])

    bound_batches(texts.sparkSession)
    kind = dict(texts.dtypes)[id_column]
    return texts.selectExpr(f"`{id_column}` as id", f"`{text_column}` as text").mapInArrow(
        run, f"id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>"
    )
