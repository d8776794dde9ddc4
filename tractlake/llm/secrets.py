"""Secrets in texts, with credentials linked from their parts.

Strong patterns are reported wherever they stand. Weak parts (an account name or mail address, a random-looking token, a
URL, host or network address) are reported only where complementary parts co-occur: within a scope, an identifier, a secret and an endpoint are joined
on their intervals, by one sweep over the sorted parts of the text.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tractlake.llm.common import carried, table
from tractlake.shipping import ship

#: Code points between two parts of one credential at most. A blank line also ends a scope.
REACH = 200
# The base patterns, with the least length of what must be long.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
# A faster way to the matches that can pass: a run is matched from its start only, as leftmost matching does.
HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
IDENTIFIER = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"\b(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+|\b(?:host|server|endpoint)\b[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.:-]{3,}", re.I | re.A)
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.A)
ADDRESS = re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.]*[0-9])", re.A)
BLANK = re.compile(r"\n[\x20\t\r]*\n")
KINDS = ("assign", "access", "hex", "identifier", "token", "endpoint")
ROLE = {"assign": "secret", "hex": "secret", "token": "secret", "access": "id", "identifier": "id", "endpoint": "endpoint"}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind, without those that are too short; spans are of whole matches."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end()) for m in HEX_LONG.finditer(text)]
    return out


def looks_random(token: str) -> bool:
    kinds = sum(any(f(c) for c in token) for f in (str.isdigit, str.isupper, str.islower))
    return kinds >= 2 and any(c.isdigit() for c in token) and len(set(token)) >= 10


def apart(spans: list[tuple[str, int, int]], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that overlap none of ``taken`` and no earlier span of their own, by one sweep over both in order."""
    busy = sorted((s, e) for _, s, e in taken)
    out, i, reach = [], 0, -1  # reach: the furthest end of what begins before the span does
    for span in sorted(spans, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        while i < len(busy) and busy[i][0] <= span[1]:
            reach = max(reach, busy[i][1])
            i += 1
        if reach <= span[1] and (i == len(busy) or busy[i][0] >= span[2]):
            out.append(span)
            reach = max(reach, span[2])
    return out


def linked_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak parts that have complementary parts in reach: a secret and an identifier need each other, an endpoint both."""
    tokens = [("token", m.start(), m.end()) for m in TOKEN.finditer(text) if looks_random(m.group())]
    if not base and not tokens:
        return []
    ids = [("identifier", m.start(), m.end()) for m in IDENTIFIER.finditer(text)]
    if "@" in text:
        ids += [("identifier", m.start(), m.end()) for m in EMAIL.finditer(text)]
    weak = apart(ids + tokens, base)
    have = {ROLE[k] for k, _, _ in (*base, *weak)}
    if not {"id", "secret"} <= have:
        return []
    weak += apart([("endpoint", m.start(), m.end()) for pattern in (ENDPOINT, ADDRESS) for m in pattern.finditer(text)], base + weak)
    walls = [m.start() for m in BLANK.finditer(text)]
    scope = lambda at: bisect.bisect_right(walls, at)
    parts: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for kind, start, end in sorted((*base, *weak), key=lambda s: s[1]):
        parts.setdefault((ROLE[kind], scope(start)), []).append((start, end))
    starts = {k: [s for s, _ in v] for k, v in parts.items()}
    # ends are kept as running maxima, so that a search from the left meets the last one that can reach
    reach = {k: [max_end for max_end in _running(e for _, e in v)] for k, v in parts.items()}

    def near(role: str, start: int, end: int) -> bool:
        where = (role, scope(start))
        if where not in parts:
            return False
        i = bisect.bisect_right(starts[where], end + REACH)
        return i > 0 and reach[where][i - 1] >= start - REACH

    other = {"secret": ("id",), "id": ("secret",), "endpoint": ("id", "secret")}
    return [s for s in weak if all(near(role, s[1], s[2]) for role in other[ROLE[s[0]]])]


def _running(values):
    best = -1
    for v in values:
        best = max(best, v)
        yield best


def digest(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end, by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, counts of base spans, the base spans' digest, and all spans (``spans``, and ``found`` as structs).

    Positions are code points, ends exclusive. Null text is empty and has no spans; null keys are carried; repeated
    rows give repeated results; an empty table gives none. A text is scanned whole, row by row, so size of groups and
    ties make no difference, and other columns are not read.
    """
    ship(docs.sparkSession)
    key_type = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int>>"

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                base = base_spans(t or "")
                every = base + linked_spans(t or "", base)
                count = [sum(k == x for x, _, _ in base) for k in KINDS[:3]]
                spans = [{"kind": k, "start": s, "end": e} for k, s, e in sorted(every, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))]
                rows.append((*count, hashlib.sha256(digest(base).encode()).hexdigest(), digest(every), spans))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], [key, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    return docs.select(*carried(docs.select(key, text))).mapInArrow(run, schema)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    return scan(table(spark, sf_dir, "documents")).drop("found")
