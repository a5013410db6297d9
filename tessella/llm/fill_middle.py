"""Fill-in-the-middle arrangements of whole texts.  SQL functions only.

Units
    ``regexp_extract_all`` makes the array of a text's units; the registered
    query takes code points.  Units must cover a text from end to end; a text
    that they don't cover stays plain.

Cuts
    The first four 8-digit groups of the hex SHA-256 of ``seed:doc_id`` are
    numbers h1 to h4.  The prefix ends after the smaller of h1 % (n + 1) and
    h2 % (n + 1) units, the middle after the larger, the suffix is the rest.

Forms
    plain: the text.  psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle.  spm:
    ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.  A text is plain if it is
    empty, holds a sentinel, or h3 % 100 is not below ``percent``; else spm if
    h4 % 100 is below ``spm_percent``.  No sentinel can arise where a part and
    a sentinel meet, as ``<`` only begins one and ``>`` only ends one, so
    ``restore`` finds the parts from output and form alone.

Bounds
    One row's text and units at a time; there is no shuffle.

Defined cases
    Null text: empty, so plain.  Null doc_id: the number is empty.  Repeated
    rows: a row each.  Very long texts: whole.  Empty table: no rows.  Other
    columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: Java regular expression of one code point.
CODE_POINT = r"(?s)."
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ANY = "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE)))


def draw(key: Column, group: int) -> Column:
    """Group (from 0) of eight hex digits of a digest as a number."""
    return F.conv(F.substring(key, 8 * group + 1, 8), 16, 10).cast("long")


def arrange(docs: DataFrame, unit: str = CODE_POINT, seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units, prefix_chars, middle_chars (null if plain), output."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    cut = docs.select("doc_id", text.alias("text"), key.alias("key")).withColumn("units", F.regexp_extract_all("text", F.lit(unit), F.lit(0)))
    n = F.size("units").cast("long")
    a, b = (F.pmod(draw(F.col("key"), i), n + 1) for i in (0, 1))
    covered = F.lit(True) if unit == CODE_POINT else F.array_join("units", "") == F.col("text")
    plain = (F.col("text") == "") | F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE)) | ~covered | (F.pmod(draw(F.col("key"), 2), F.lit(100)) >= percent)
    form = F.when(plain, "plain").when(F.pmod(draw(F.col("key"), 3), F.lit(100)) < spm_percent, "spm").otherwise("psm")
    drawn = cut.select("doc_id", "text", "units", n.alias("n"), F.least(a, b).cast("int").alias("from"), F.greatest(a, b).cast("int").alias("to"), form.alias("form"))
    part = lambda start, size: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, size), ""))
    parts = drawn.select(
        "doc_id", "text", "n", "form", "from", "to", part(F.lit(1), F.col("from")).alias("prefix"),
        part(F.col("from") + 1, F.col("to") - F.col("from")).alias("middle"), part(F.col("to") + 1, F.col("n").cast("int") - F.col("to")).alias("suffix"),
    )
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
        .otherwise(F.col("text"))
    )
    moved = lambda c: F.when(F.col("form") != "plain", c.cast("long"))
    return parts.select(
        "doc_id", "n", "form", moved(F.col("from")).alias("prefix_units"), moved(F.col("to") - F.col("from")).alias("middle_units"),
        F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), output.alias("output"),
    )


def restore(arranged: DataFrame) -> DataFrame:
    """arranged with restored: the text, from output and form alone."""
    split = arranged.withColumn("parts", F.split("output", ANY))  # nothing stands before the first sentinel
    part = lambda i: F.element_at("parts", i)
    text = F.when(F.col("form") == "psm", F.concat(part(2), part(4), part(3))).when(F.col("form") == "spm", F.concat(part(3), part(4), part(2))).otherwise(F.col("output"))
    return split.withColumn("restored", text).drop("parts")
