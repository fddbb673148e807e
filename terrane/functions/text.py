"""Scalar building blocks over code and text columns; all of them are native expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACEHOLDER = "[before content unavailable]"
#: Substrings of a lower-cased commit message.
STRONG_KEYWORDS = ("cve-", "cwe-", "vulnerab", "exploit", "hardcoded", "privilege esc", "unencrypt", "insecure", "cleartext", "plaintext", "secret leak", "credential", "token leak")
SIGNAL_KEYWORDS = ("security", "vulner", "cve", "cwe", "exploit", "credential", "password", "secret", "fix")
MESSAGE_KEYWORDS = ("security", "vulnerab", "cve-", "cwe-", "exploit", "credential", "password", "secret", "hardcoded", "encrypt", "unencrypt", "privilege esc", "misconfig", "harden", "patch ", "fix ", "tls", "ssl", "rbac", "iam", "insecure")
#: Line ends of text beyond line feed and carriage return.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.trim(text, F.lit(" \t\n\r\x0b\x0c"))


def content_hash(text: Column) -> Column:
    """SHA-256 of a text, lower-case hex."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def record_id(prefix: str, *parts: Column) -> Column:
    """Prefix and the first 12 hex digits of the SHA-256 of the colon-joined parts."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 12))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def lines_of(text: Column) -> Column:
    """Lines without a trailing empty one, at any line end."""
    parts = F.split(text, LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def text_metrics(text: Column) -> Column:
    """struct<line_count, token_count, blank_lines, comment_lines>."""
    lines = lines_of(text)
    comment = lambda x: strip(x).startswith("#") | strip(x).startswith("//") | strip(x).startswith("/*")
    return F.struct(
        F.size(lines).alias("line_count"),
        F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")).alias("token_count"),
        F.size(F.filter(lines, lambda x: strip(x) == "")).alias("blank_lines"),
        F.size(F.filter(lines, comment)).alias("comment_lines"),
    )


def diff_side(diff: Column, sign: str) -> Column:
    """The lines of a diff with the sign, without file headers and without the sign, joined by line feeds."""
    kept = F.filter(F.split(diff, "\n"), lambda x: x.startswith(sign) & ~x.startswith(sign * 3))
    return F.array_join(F.transform(kept, lambda x: F.substring(x, 2, 1 << 30)), "\n")


def diff_stats(diff: Column) -> Column:
    """struct<added, removed, net>."""
    count = lambda sign: F.size(F.filter(F.split(diff, "\n"), lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))
    return F.struct(count("+").alias("added"), count("-").alias("removed"), (count("+") - count("-")).alias("net"))


def normalise_diff(diff: Column) -> Column:
    """Lines without blank and comment ones, white space collapsed."""
    kept = F.filter(F.split(diff, "\n"), lambda x: (strip(x) != "") & ~strip(x).startswith("#") & ~strip(x).startswith("//"))
    return F.array_join(F.transform(kept, lambda x: F.regexp_replace(strip(x), r"\s+", " ")), "\n")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def parse_response(raw: Column) -> Column:
    """The unified diff inside a model answer: fences are dropped, text before the first file header is cut. Each step is evaluated once."""

    def unfenced(text: Column) -> Column:
        fenced = F.regexp_extract(text, r"(?is)```(?:diff|patch)?\s*(.*?)```", 1)
        return F.when(text.rlike(r"(?is)```(?:diff|patch)?\s*.*?```"), strip(fenced)).otherwise(text)

    def from_header(body: Column, lines: Column) -> Column:
        start = F.array_position(F.transform(lines, lambda x: x.startswith("--- ")), True)
        return let(start, lambda at: F.when(at == 0, body).otherwise(let(F.slice(lines, F.greatest(at, F.lit(1)).cast("int"), F.size(lines)), to_fence)))

    def to_fence(tail: Column) -> Column:
        stop = F.array_position(F.transform(tail, lambda x: strip(x).startswith("```")), True)
        kept = let(stop, lambda at: F.when(at > 0, F.slice(tail, F.lit(1), (at - 1).cast("int"))).otherwise(tail))
        return strip(F.array_join(kept, "\n"))

    return let(strip(raw), lambda text: let(unfenced(text), lambda body: let(F.split(body, "\n"), lambda lines: from_header(body, lines))))


def labels(types: Column, severities: Column, cwes: Column, tool: Column) -> Column:
    """Sorted distinct non-empty labels."""
    return F.array_sort(F.array_distinct(F.filter(F.concat(types, severities, cwes, F.array(tool)), lambda x: x.isNotNull() & (x != ""))))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last dotted part of a name in lower case; a leading dot alone makes none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def decode_base64(content: Column) -> Column:
    return F.decode(F.unbase64(F.regexp_replace(content, "\n", "")), "UTF-8")


def split_sizes(stratum_size: Column, train: float = 0.8, val: float = 0.1) -> tuple[Column, Column]:
    """Rows of a stratum that go to train and to val: floor shares; the rest is test."""
    return F.floor(stratum_size * F.lit(train)), F.floor(stratum_size * F.lit(val))
