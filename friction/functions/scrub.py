"""Masking of personal data and secrets in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns, in the order they apply. Cards go before numbers that they contain.
PATTERNS = (
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    r"\b(?:\d[ -]?){13,19}\b",
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"(?:\+?1[\s-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b",
    r"\+\d{1,3}[\s.-]?\d{2,4}[\s.-]?\d{2,4}[\s.-]?\d{2,4}\b",
    r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b",
    r"\b(?:25[0-5]|2[0-4]\d|[01]?\d\d?)(?:\.(?:25[0-5]|2[0-4]\d|[01]?\d\d?)){3}\b",
    r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    r"\b(?:[0-9a-fA-F]{1,4}:){1,7}:[0-9a-fA-F]{0,4}\b",
    r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b",
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{36,251}\b",
    r"\b(?:sk|pk|rk)_(?:test|live)_[A-Za-z0-9]{20,}\b",
    r"\bsk-ant-[A-Za-z0-9_-]{20,}\b",
    r"\bsk-[A-Za-z0-9]{20,}\b",
)
#: \b of ASCII words; Java's own sees letters of all scripts.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: \b where a letter or digit must follow, or comes before: one look is enough.
BEGIN, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: Patterns whose first or last character may be no letter or digit, so that both looks count.
LOOSE_BEGIN, LOOSE_END = (0,), (1, 8, 9, 13)
#: What a text must hold for each pattern to match at all; far cheaper to look for than the pattern.
NEEDS = (
    "@", r"\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d", r"\d{3}-\d{2}-\d", r"\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}", r"\+\d", r"[A-Z]{2}\d{2}", r"\d\.\d", r":[0-9a-fA-F]{1,4}:", r"[0-9a-fA-F]::",
    "eyJ", "A[KS]IA", "gh[pousr]_", "k_(?:test|live)_", "sk-ant-", "sk-",
)


def edged(i: int, p: str) -> str:
    """A pattern with its edges as ASCII words have them."""
    begins, ends = p.startswith(r"\b") and i not in LOOSE_BEGIN, p.endswith(r"\b") and i not in LOOSE_END
    inner = p[2 if begins else 0 : len(p) - 2 if ends else len(p)]
    return BEGIN * begins + inner.replace(r"\b", EDGE) + END * ends


def scrub(text: Column, extra: tuple[str, ...] = ()) -> Column:
    """text with every match of the patterns replaced by [redacted]."""
    steps = [(n, edged(i, p)) for i, (n, p) in enumerate(zip(NEEDS, PATTERNS))]

    def step(needs: str, pattern: str):
        return lambda t: F.when(t.rlike(needs), F.regexp_replace(t, pattern, "[redacted]")).otherwise(t)

    one = F.array(text)
    for needs, pattern in steps:  # a lambda each: the text of a step is named once, however often the step reads it
        one = F.transform(one, step(needs, pattern))
    text = F.get(one, 0)
    for p in extra:
        text = F.regexp_replace(text, p.replace(r"\b", EDGE), "[redacted]")
    return text
