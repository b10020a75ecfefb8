"""Text policies: what a protected column shows to every operator above its table."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import TextPolicy
from ..refusal import Refusal

MARK = "...[truncated]"
RULES, PATTERN_BYTES, LEAST_BYTES, MOST_BYTES = 8, 512, 32, 1 << 20
#: POSIX classes, which Java writes in another way.
POSIX = {
    "[:alnum:]": r"\p{Alnum}", "[:alpha:]": r"\p{Alpha}", "[:blank:]": r"\p{Blank}", "[:cntrl:]": r"\p{Cntrl}",
    "[:digit:]": r"\p{Digit}", "[:graph:]": r"\p{Graph}", "[:lower:]": r"\p{Lower}", "[:print:]": r"\p{Print}",
    "[:punct:]": r"\p{Punct}", "[:space:]": r"\s", "[:upper:]": r"\p{Upper}", "[:xdigit:]": r"\p{XDigit}",
}


def checked(policy: TextPolicy) -> TextPolicy:
    """Refuses what Java would read otherwise than the author: groups with `(?` but a leading `(?i)`, back-references,
    unknown POSIX classes, and replacements that are not literal."""
    if len(policy.redactions) > RULES:
        raise Refusal("text_policy_refused", "too many rules")
    for pattern, replacement in policy.redactions:
        body = pattern.removeprefix("(?i)")
        if not body or len(pattern.encode()) > PATTERN_BYTES or "(?" in body or re.search(r"\\[1-9k]", body):
            raise Refusal("text_policy_refused", f"pattern {pattern!r}")
        if set(re.findall(r"\[:[^\]]*:\]", body)) - set(POSIX):
            raise Refusal("text_policy_refused", f"pattern {pattern!r}: unknown class")
        if re.search(r"[$\\]", replacement):
            raise Refusal("text_policy_refused", f"replacement {replacement!r}")
    if policy.clip_bytes is not None and not LEAST_BYTES <= policy.clip_bytes <= MOST_BYTES:
        raise Refusal("text_policy_refused", f"clip of {policy.clip_bytes} bytes")
    return policy


def java_pattern(pattern: str) -> str:
    for name, written in POSIX.items():
        pattern = pattern.replace(name, written)
    return pattern


def masked(column: Column, policy: TextPolicy) -> Column:
    """The redactions in order, then at most as many characters as always fit the bytes, and the mark if some went."""
    for pattern, replacement in checked(policy).redactions:
        column = F.regexp_replace(column, java_pattern(pattern), replacement)
    if policy.clip_bytes is not None:
        n = (policy.clip_bytes - len(MARK)) // 4
        fits = F.octet_length(column) <= policy.clip_bytes
        column = F.when(fits, column).otherwise(F.concat(F.substring(column, 1, n), F.lit(MARK)))
    return column
