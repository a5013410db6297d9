"""Quality rules: a learned decision list over text statistics.

Statistics
    Words are ``[^\\x20\\x09-\\x0D]+``.  ``statistics`` measures each whole text
    once, in a pandas UDF that gets nothing but the text.

Learning
    Sequential covering on labelled rows.  Each round splits the rows not yet
    covered into a grow part (two thirds) and a prune part, grows a conjunction
    of thresholds by FOIL gain for the rejected class, prunes its last
    conditions while that doesn't lower its worth on the prune part, and keeps
    it if its precision is high enough.  What no rule covers is kept.

Emitting
    ``rule_expression`` is one ordered Spark CASE: the first rule that holds
    names itself, null means kept.

Bounds
    Rules are learned on at most ``MAX_LABELLED`` labelled rows, those with the
    smallest hash of their id; every row is measured and judged.

Defined cases
    Null or empty text: no words, base_failed.  Labels that disagree about one
    document: not used.  Labels with nulls: not used.  No labels: no rules, so
    only base_failed rejects.  Repeated rows: each is judged, alike.  Null
    doc_id: judged, never a training row.  Extra columns are ignored by
    ``judge`` and kept by ``filter_documents``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, small_batches, stage, utf8

MAX_LABELLED = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER, DIGITS, SPACES = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), b" \t\n\r\x0b\x0c"
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_lower", "n_digits", "n_punct"]
STRUCT = ", ".join(f"{s} long" for s in STATS)


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice, first ones included."""
    n = len(words)
    if n < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    k = len(names)
    pairs = ids[:-1] * k + ids[1:]
    if k < 1 << 20:
        windows = pairs[:-1] * k + ids[2:]
    else:
        windows = np.unique(pairs, return_inverse=True)[1][:-1] * k + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    held = np.zeros(n, bool)
    for shift in range(3):
        held[shift : n - 2 + shift] |= again
    return int(held.sum())


def measure(text: str | None) -> list[int]:
    """STATS of one whole text."""
    raw = utf8(text)
    words = raw.split()
    lacks = lambda drop: len(raw) - len(raw.translate(None, drop))
    full = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return [
        len(words), len(text or "") - lacks(SPACES), lacks(SYMBOLS), len(full) - len(set(full)), repeat_words(words),
        len(full), len(set(words)), lacks(UPPER), lacks(LOWER), lacks(DIGITS), lacks(PUNCTUATION),
    ]


def statistics(df: DataFrame, text_col: str = "text", name: str = "stats") -> DataFrame:
    """df with a struct column of the statistics of its texts."""

    small_batches(df.sparkSession)

    @F.pandas_udf(STRUCT)
    def udf(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=STATS, dtype="int64")

    return df.withColumn(name, udf(F.col(text_col)))


#: Feature: (numerator, denominator), as the rules use them.
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "duplicate_line_share": ("n_dup_lines", "n_lines"),
    "repeated_word_share": ("n_repeat_words", "n_words"),
    "distinct_word_share": ("n_distinct", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "lower_share": ("n_lower", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "punctuation_share": ("n_punct", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
}


def feature_values(rows: pd.DataFrame) -> np.ndarray:
    out = []
    for top, bottom in FEATURES.values():
        x = rows[top].to_numpy(float)
        out.append(x if bottom is None else x / np.maximum(rows[bottom].to_numpy(float), 1.0))
    return np.stack(out, axis=1) if len(rows) else np.zeros((0, len(FEATURES)))


def feature_column(feature: str, struct: str | None) -> Column:
    of = lambda c: F.col(f"{struct}.{c}" if struct else c).cast("double")
    top, bottom = FEATURES[feature]
    return of(top) if bottom is None else of(top) / F.greatest(of(bottom), F.lit(1.0))


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str  # ">" or "<="
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, list(FEATURES).index(self.feature)]
        return v > self.threshold if self.op == ">" else v <= self.threshold

    def column(self, struct: str | None) -> Column:
        c = feature_column(self.feature, struct)
        return c > F.lit(self.threshold) if self.op == ">" else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {self.op} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def best_condition(x: np.ndarray, bad: np.ndarray) -> tuple[float, Condition] | None:
    """The threshold with the largest FOIL gain for bad among the rows x."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    if not p0 or not n0:
        return None
    base, best = math.log2(p0 / (p0 + n0)), None
    for f, name in enumerate(FEATURES):
        order = np.argsort(x[:, f], kind="stable")
        v, b = x[order, f], bad[order]
        ends = np.flatnonzero(v[1:] > v[:-1])
        if not len(ends):
            continue
        p_low, all_low = np.cumsum(b)[ends], ends + 1
        for op, p, n in (("<=", p_low, all_low - p_low), (">", p0 - p_low, n0 - (all_low - p_low))):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1.0)
            at = int(np.argmax(gain))
            if gain[at] > 1e-9 and (best is None or gain[at] > best[0] + 1e-12):
                best = (float(gain[at]), Condition(name, op, float((v[ends[at]] + v[ends[at] + 1]) / 2)))
    return best


def grow(x: np.ndarray, bad: np.ndarray, max_conditions: int) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < max_conditions and (~bad & inside).any():
        found = best_condition(x[inside], bad[inside])
        if found is None:
            break
        rule.append(found[1])
        inside &= found[1].holds(x)
    return tuple(rule)


def prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest beginning of rule with the greatest (p - n) / (p + n)."""

    def worth(r: Rule) -> float:
        c = covers(r, x)
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=rule)


def learn_rules(x: np.ndarray, bad: np.ndarray, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, min_covered: int = 5, seed: int = 7) -> list[Rule]:
    """The decision list for the rows x, of which bad are to be rejected."""
    rules: list[Rule] = []
    open_ = np.ones(len(x), bool)
    fold = np.random.default_rng(seed).permutation(len(x)) % 3
    tries = 0
    while len(rules) < max_rules and tries < 3 and (bad & open_).sum() >= min_covered:
        held = (fold + tries) % 3 == 0
        rule = prune(grow(x[open_ & ~held], bad[open_ & ~held], max_conditions), x[open_ & held], bad[open_ & held])
        c = covers(rule, x) & open_
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        if not rule or p + n < min_covered or p / (p + n) < min_precision:
            tries += 1
            continue
        rules.append(rule)
        open_ &= ~c
        tries = 0
    return rules


def rule_expression(rules: list[Rule], struct: str | None = None) -> Column:
    """CASE: the name of the first rule that holds, or null."""
    out = None
    for i, rule in enumerate(rules):
        cond = rule[0].column(struct)
        for c in rule[1:]:
            cond = cond & c.column(struct)
        name = F.lit(f"rule {i + 1}: " + " and ".join(map(str, rule)))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.lit(None).cast("string") if out is None else out


def base_failed(struct: str | None = None) -> Column:
    of = lambda c: F.col(f"{struct}.{c}" if struct else c)
    return (of("n_words") < MIN_WORDS) | (100 * of("n_repeat_words") > MAX_REPEAT_PERCENT * of("n_words"))


def training_labels(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, quality of documents whose labels agree, at most max_labelled."""
    agreed = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("q")).where("quality = q").drop("q")
    return agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def fit(measured: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from measured (doc_id and STATS columns) rows with labels."""
    chosen = training_labels(labels, max_labelled)
    # one row of each labelled document, so that repeated rows don't weigh more
    rows = measured.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), *[F.min(s).alias(s) for s in STATS]).toPandas()
    rows = rows.sort_values("doc_id", ignore_index=True)
    rows = rows[(rows.n_words >= MIN_WORDS) & (100 * rows.n_repeat_words <= MAX_REPEAT_PERCENT * rows.n_words)]
    return learn_rules(feature_values(rows), rows["quality"].to_numpy(int) == 0)


def judge(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, STATS, base_failed, rule (of the list, null: none), kept for each row of docs."""
    measured = stage(statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "stats.*"), "quality")
    rules = fit(measured, labels, max_labelled)
    out = measured.withColumn("base_failed", base_failed()).withColumn("rule", rule_expression(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def filter_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that base and rules keep, with all their columns."""
    chosen = training_labels(labels, max_labelled).select("doc_id")
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id", "left_semi")
    rules = fit(statistics(sample).select("doc_id", "stats.*"), labels, max_labelled)
    name = free_name(docs, "stats")
    return statistics(docs, "text", name).where(~base_failed(name) & rule_expression(rules, name).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
