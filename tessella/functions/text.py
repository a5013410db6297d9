"""Text functions as Spark columns: normalising, hashing, splitting, scanning."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

# Sentence ends, closers, markers.
TERMINATORS, CLOSERS = "。！？!?…", "\"'”’」』）)】》〉"
REFUSAL = "[INSUFFICIENT]"
SENTENCE = f"[^{TERMINATORS}\\n]*(?:[{TERMINATORS}]+[{CLOSERS}]*(?:[ \\t]*\\n+)?|\\n+)|[^{TERMINATORS}\\n]+"
CITATION, CANONICAL = r"\[[Cc][0-9][^\]]*\]", r"^\[C(?:0|[1-9][0-9]{0,2})\]$"
UNICODE_SPACE = r"(?U)[\s\x1c-\x1f]+"


def normalize_minimal(text: Column) -> Column:
    """Line ends as LF, lines without white space at their ends."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?U)(?:[^\S\n]|[\x1c-\x1f])+(?=\n|\z)", "")


def content_hash(text: Column) -> Column:
    return F.sha2(normalize_minimal(text), 256)


def evidence_hash(owner: Column, text: Column) -> Column:
    return F.sha2(F.concat(owner, F.lit("\n"), normalize_minimal(text)), 256)


def nfc(text: Column) -> Column:
    """Canonical composition, in Arrow batches: Spark has no built-in for it."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return compose(text)


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, UNICODE_SPACE, " "), "^ | $", "")


def normalize_query(text: Column) -> Column:
    return collapse(nfc(text))


def tokens(text: Column) -> Column:
    """Default tokenizer: Han characters one by one, runs of other letters and digits, other signs one by one, as they are written."""
    return F.regexp_extract_all(text, F.lit(r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+|[^\s\p{L}\p{N}\p{Z}]"), 0)


def sentences(text: Column) -> Column:
    """Units that joined give the text back."""
    return F.regexp_extract_all(text, F.lit(SENTENCE), 0)


def token_estimate(text: Column) -> Column:
    """round(0.81 per Han character + 0.3 per other), halves up; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    other = F.length(F.regexp_replace(t, r"\p{IsHan}", ""))
    return F.floor(F.lit(0.81) * (F.length(t) - other) + F.lit(0.3) * other + 0.5).cast("int")


def count_all(text: Column, needle: str) -> Column:
    """Occurrences of needle, overlapping ones too."""
    import re

    return F.regexp_count(text, F.lit(f"(?={re.escape(needle)})"))


def find_all(text: Column, needle: Column) -> Column:
    """Zero-based starts of needle in text, overlapping ones too, ascending.

    The text is split before every occurrence; the lengths of the parts add up
    to the starts, so long texts are walked once.
    """
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    parts = F.split(text, quoted)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    walk = F.aggregate(parts, begin, lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.array_append(acc["found"], acc["at"]).alias("found")))["found"]
    starts = F.when(F.startswith(text, needle), walk).otherwise(F.slice(walk, 2, F.greatest(F.size(walk) - 1, F.lit(0))))
    return F.when((F.length(needle) > 0) & F.contains(text, needle), starts).otherwise(F.array().cast("array<int>"))


def overlap_length(before: Column, after: Column) -> Column:
    """The longest end of before that after starts with."""
    most = F.least(F.length(before), F.length(after))
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), most), lambda k: F.startswith(after, F.right(before, k)))), F.lit(0))


def citations(text: Column) -> Column:
    """Numbers of the canonical citations of a text, in order."""
    found = F.filter(F.regexp_extract_all(text, F.lit(CITATION), 0), lambda c: F.rlike(c, F.lit(CANONICAL)))
    return F.transform(found, lambda c: F.regexp_extract(c, "([0-9]+)", 1).cast("int"))


def violations(text: Column) -> Column:
    """What looks like a citation without being canonical, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit(CITATION), 0), lambda c: ~F.rlike(c, F.lit(CANONICAL)))


def refusal_state(text: Column) -> Column:
    """refusal, answer or pending for the beginning of an answer."""
    rest = F.regexp_replace(text, r"^(?U)[\s\x1c-\x1f]+", "")
    lead = F.length(text) - F.length(rest)
    return F.when(F.startswith(rest, F.lit(REFUSAL)), "refusal").when(lead > 8, "answer").when(F.startswith(F.lit(REFUSAL), rest), "pending").otherwise("answer")


def title(question: Column, limit: int = 20) -> Column:
    """A session's title: white space collapsed, limit code points, null if blank."""
    t = collapse(question)
    return F.when(t == "", F.lit(None)).when(F.length(t) <= limit, t).otherwise(F.concat(F.left(t, F.lit(limit)), F.lit("…")))


def clamp(text: Column, limit: int = 200) -> Column:
    return F.left(collapse(text), F.lit(limit))


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed; null if none."""
    lines = F.transform(F.split(text, "\n"), lambda x: collapse_ends(x))
    return F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(1))


def collapse_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean_log(value: Column) -> Column:
    """Control characters as _, nothing as -."""
    c = F.regexp_replace(F.coalesce(value, F.lit("")), r"\p{Cntrl}", "_")
    return F.when(c == "", "-").otherwise(c)


def versioned(*parts: Column, chars: int = 12) -> Column:
    """First hex digits of the hash over parts joined by NUL."""
    return F.left(F.sha2(F.concat_ws("\u0000", *parts), 256), F.lit(chars))


def section(template: Column, name: str) -> Column:
    """Text between <name> and the first </name> after it, trimmed."""
    return collapse_ends(F.regexp_extract(template, f"(?s)<{name}>(.*?)</{name}>", 1))


def split_keys(key: Column) -> Column:
    """book, chapter, chunk of a key; null where it isn't one, chunk also null in a chapter's key."""
    of = lambda g: F.when(F.rlike(key, F.lit(r"^book:[0-9]+:chapter:[0-9]+(?:#c[0-9]+)?$")), F.nullif(F.regexp_extract(key, r"^book:([0-9]+):chapter:([0-9]+)(?:#c([0-9]+))?$", g), F.lit("")).cast("int"))
    return F.struct(of(1).alias("book"), of(2).alias("chapter"), of(3).alias("chunk"))


def coded_reason(reason: Column, key: Column) -> Column:
    """reason:key; keys hold colons themselves, reasons don't."""
    return F.concat(reason, F.lit(":"), key)


def split_reason(coded: Column) -> Column:
    parts = F.split(coded, ":", 2)
    return F.struct(parts[0].alias("reason"), parts[1].alias("key"))


def message_meta(**values: Column) -> Column:
    """A message's meta data as JSON, in the order given, nulls included."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"})


def meta_chapters(meta: Column) -> Column:
    """The chapters of a message's meta data; none where it can't be read."""
    return F.coalesce(F.from_json(F.get_json_object(meta, "$.chapters"), "array<long>"), F.array().cast("array<long>"))
