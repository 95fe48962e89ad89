"""Secrets in texts: known forms, and strings of high entropy in a sliding window.

Candidate strings are runs of letters, digits and the signs of base64. A window slides over
each; symbol counts per character class (decimal, hexadecimal, base64) change by one symbol
in and one out per step, and so does the entropy. A window whose entropy is high for the
widest class it needs marks its part of the run, and marked windows that touch become one
span. An allow-list takes back spans of harmless forms. The spans of the known forms are
found apart and always stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.texts import strings

# The known forms (letters of the words in either case), in the order in which spans of one start are listed.
ASSIGN = r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
LEAST_ASSIGNED = 6

WINDOW = 20
# Bits per symbol from which a window of a class is suspicious. Twenty random symbols have
# about 2.9 bits of decimal digits, 3.4 of hexadecimal ones and 4.1 of base64. Decimal digits
# alone never are: they are numbers.
THRESHOLDS = {"decimal": math.inf, "hex": 3.0, "base64": 3.8}
# A word in one case, or words that each begin with a capital; or a short number.
WORD = r"(?:[a-z]{1,30}|[A-Z]{1,20}|(?:[A-Z]?[a-z]{2,})+|[0-9]{1,4})"
# Harmless forms: numbers, identifiers, and words joined by signs, such as paths.
ALLOWED = (
    r"[0-9]+",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    rf"[-_/+=]*{WORD}(?:[-_/+=]+{WORD})*[-_/+=]*",
)
# Dates and times that a run starts with; what follows them is looked at by itself.
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]{2,6}(?:-[0-9]{2})*Z?)?(?:[_-]|$)"

SPAN_TYPE = "array<struct<kind: string, start: bigint, end: bigint>>"


def entropy_windows(run: str, window: int = WINDOW, thresholds=None) -> list[tuple[int, int]]:
    """Parts of a run that suspicious windows cover, as (start, end) within the run.

    A run shorter than the window has none. The entropy of a window is
    log2(window) - sum(c * log2(c)) / window over its symbol counts c, so that each step
    of the window changes two terms of the sum.
    """
    limits = thresholds or THRESHOLDS
    if len(run) < window:
        return []
    terms = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    decimal = hexadecimal = 0  # symbols of the window in each narrow class
    total = 0.0
    found: list[tuple[int, int]] = []
    for at, symbol in enumerate(run):
        had = counts.get(symbol, 0)
        total += terms[had + 1] - terms[had]
        counts[symbol] = had + 1
        decimal += symbol in "0123456789"
        hexadecimal += symbol in "0123456789abcdefABCDEF"
        if at >= window:
            gone = run[at - window]
            had = counts[gone]
            total += terms[had - 1] - terms[had]
            counts[gone] = had - 1
            decimal -= gone in "0123456789"
            hexadecimal -= gone in "0123456789abcdefABCDEF"
        if at >= window - 1:
            kind = (
                "decimal" if decimal == window else "hex" if hexadecimal == window else "base64"
            )
            if math.log2(window) - total / window >= limits[kind]:
                start, end = at - window + 1, at + 1
                if found and start <= found[-1][1]:
                    found[-1] = (found[-1][0], end)
                else:
                    found.append((start, end))
    return found


class SecretFinder:
    """The spans of one text, as (start, end, kind) in code points, end exclusive."""

    def __init__(self, window: int = WINDOW, thresholds=None, allowed=ALLOWED):
        self.window, self.thresholds = window, thresholds or THRESHOLDS
        self.assign = re.compile(ASSIGN)
        self.access, self.hex = re.compile(ACCESS), re.compile(HEX)
        self.run = re.compile(rf"[A-Za-z0-9+/_=-]{{{window},}}")
        self.date = re.compile(DATE)
        self.allowed = re.compile("|".join(f"(?:{x})" for x in allowed) or r"(?!)")

    def base(self, text: str) -> list[tuple[int, int, str]]:
        """Leftmost matches of each known form that do not overlap, by start and kind."""
        found = [
            (m.start(), m.end(), "assign")
            for m in self.assign.finditer(text)
            if m.end(1) - m.start(1) >= LEAST_ASSIGNED
        ]
        found += [(m.start(), m.end(), "access") for m in self.access.finditer(text)]
        found += [(m.start(), m.end(), "hex") for m in self.hex.finditer(text)]
        return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))

    def added(self, text: str) -> list[tuple[int, int, str]]:
        """Spans of high entropy that the allow-list does not take back."""
        found = []
        for match in self.run.finditer(text):
            run, at = match.group(), match.start()
            if date := self.date.match(run):
                run, at = run[date.end() :], at + date.end()
            if self.allowed.fullmatch(run):
                continue
            for start, end in entropy_windows(run, self.window, self.thresholds):
                if not self.allowed.fullmatch(run, start, end):
                    found.append((at + start, at + end, "entropy"))
        return found

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        found = self.base(text) + self.added(text)
        return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def scan_secrets(
    docs: DataFrame, *, text: str = "text", into: str = "spans", finder: SecretFinder | None = None
) -> DataFrame:
    """All columns of `docs` and `into`, an array of (kind, start, end) by start.

    Offsets are code points of the whole text, ends exclusive. A null or empty text has
    no spans; rows are kept as often as they occur, whatever their other columns hold. A
    column named as `into` is replaced.
    """
    chosen = finder or SecretFinder()

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        )
        for batch in batches:
            found = [
                [{"kind": k, "start": s, "end": e} for s, e, k in chosen.spans(x)]
                for x in strings(batch.column(batch.schema.get_field_index(text)))
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, type=kind)], names=[*batch.schema.names, into]
            )

    rows = docs.drop(into)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(scan, f"{types}, `{into}` {SPAN_TYPE}")


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[{}]") -> DataFrame:
    """`docs` with every span in `text` replaced by its kind; overlapping spans are one.

    A null text stays null.
    """
    chosen = SecretFinder()

    def clean(content: str | None) -> str | None:
        if not content:
            return content
        out, at = [], 0
        for start, end, kind in chosen.spans(content):
            if start >= at:
                out += [content[at:start], mark.format(kind)]
            at = max(at, end)
        return "".join([*out, content[at:]]) if out else content

    def replace(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            place = batch.schema.get_field_index(text)
            texts = pa.array([clean(x) for x in batch.column(place).to_pylist()], pa.string())
            yield batch.set_column(place, batch.schema.field(place), texts)

    return docs.mapInArrow(replace, docs.schema)


def span_text(spans: str, *kinds: str):
    """kind:start:end of the spans (of the given kinds, or all), joined by commas."""
    kept = F.filter(spans, lambda x: x["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(
        F.transform(
            kept,
            lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )


def count_of(spans: str, kind: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")
