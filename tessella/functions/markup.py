"""Markdown blocks, citation segments and prompt texts."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, functions as F

from . import text as X

BLOCKS = "array<struct<kind:string,level:int,lines:array<string>>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("lines", pa.list_(pa.string()))]))
# What begins a block.
_FENCE, _RULE, _HEAD = re.compile(r"\s*```"), re.compile(r"\s*(-{3,}|\*{3,}|_{3,})\s*$"), re.compile(r"(#{1,6})\s+(.*)$")
_BULLET, _NUMBER, _QUOTE = re.compile(r"\s*[-*+]\s+(.*)$"), re.compile(r"\s*(\d+)[.)]\s+(.*)$"), re.compile(r"\s*>\s?(.*)$")


def parse_blocks(text: str) -> list[dict]:
    """Paragraphs, headings (levels 2 and 3), quotes, fenced code, lists and rules, in order.

    level: of a heading; the first number of a numbered list; else 0.
    """
    out: list[dict] = []
    fenced = False

    def add(kind: str, line: str, level: int = 0, joins: bool = True) -> None:
        if joins and out and out[-1]["kind"] == kind:
            out[-1]["lines"].append(line)
        else:
            out.append({"kind": kind, "level": level, "lines": [line]})

    for line in text.replace("\r\n", "\n").split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
            if fenced:
                out.append({"kind": "code", "level": 0, "lines": []})
            else:
                out.append({"kind": "", "level": 0, "lines": []})
        elif fenced:
            out[-1]["lines"].append(line)
        elif not line.strip():
            out.append({"kind": "", "level": 0, "lines": []})  # ends what came before
        elif _RULE.match(line):
            add("hr", "", joins=False)
        elif m := _HEAD.match(line):
            add("heading", m[2].strip(), 2 if len(m[1]) <= 2 else 3, joins=False)
        elif m := _QUOTE.match(line):
            add("quote", m[1])
        elif m := _BULLET.match(line):
            add("ul", m[1])
        elif m := _NUMBER.match(line):
            add("ol", m[2], int(m[1][:9]))
        else:
            add("paragraph", line.strip())
    return [b for b in out if b["kind"]]


def blocks(text: Column) -> Column:
    """Markdown blocks of a text; null and blank texts have none."""

    @F.arrow_udf(BLOCKS)
    def parse(texts: pa.Array) -> pa.Array:
        return pa.array([parse_blocks(t or "") for t in texts.to_pylist()], _ARROW)

    return parse(text)


_BOLD, _CODE = r"\*\*[^*]+\*\*", "`[^`]+`"


def _runs(text: Column, marks: str) -> Column:
    """Marked pieces and what stands between them, in order."""
    return F.regexp_extract_all(text, F.lit(f"(?s)({marks}|(?:(?!{marks}).)+)"), F.lit(0))


def inline(text: Column) -> Column:
    """Bold, code and plain runs of a line, in order; unpaired marks are plain, and code inside bold is code."""
    run = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    bare = lambda p, n: F.substr(p, F.lit(n + 1), F.length(p) - 2 * n)
    is_ = lambda p, mark: F.rlike(p, F.lit(f"(?s)^{mark}$"))
    inner = lambda p: F.transform(_runs(bare(p, 2), _CODE), lambda x: F.when(is_(x, _CODE), run("code", bare(x, 1))).otherwise(run("bold", x)))
    piece = lambda p: F.when(is_(p, _BOLD), inner(p)).when(is_(p, _CODE), F.array(run("code", bare(p, 1)))).otherwise(F.array(run("plain", p)))
    return F.filter(F.flatten(F.transform(_runs(text, f"{_BOLD}|{_CODE}"), piece)), lambda s: s["text"] != "")


def citation_segments(text: Column) -> Column:
    """Alternating text and citation pieces that join to the text; chapter is null for plain text."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(\[C(?:0|[1-9][0-9]{0,2})\]|(?:(?!\[C(?:0|[1-9][0-9]{0,2})\]).)+)"), F.lit(0))
    return F.transform(pieces, lambda p: F.struct(p.alias("piece"), F.when(p.rlike(r"^\[C(0|[1-9][0-9]{0,2})\]$"), F.regexp_extract(p, "[0-9]+", 0).cast("int")).alias("chapter")))


def passage_block(chapter: Column, content: Column) -> Column:
    """One passage of a prompt: its chapter in brackets above the text."""
    return F.concat(F.lit("【第 "), chapter.cast("string"), F.lit(" 章】\n"), content)


def dialogue(turns: Column) -> Column:
    """Turns (array<struct<role, content>>) as one text; each begins with its speaker's name in brackets."""
    name = lambda r: F.when(r == "user", "用户").when(r == "assistant", "助手").otherwise(r)
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("【"), name(t["role"]), F.lit("】"), F.coalesce(t["content"], F.lit("")))), "\n")


def candidate_lines(candidates: Column) -> Column:
    """Candidates (array<struct<key, content>>), a line each: key, tab, content."""
    return F.array_join(F.transform(candidates, lambda c: F.concat(c["key"].cast("string"), F.lit("\t"), c["content"])), "\n")


def render(template: Column, **values: Column) -> Column:
    """The template with {name} replaced in one pass over its own text; a missing placeholder is an error."""
    held = F.array(*[F.instr(template, "{" + k + "}") > 0 for k in values])
    parts = F.split(template, r"(?<=\})|(?=\{(?:" + "|".join(values) + r")\})")
    filled = lambda p: F.coalesce(*[F.when(p == "{" + k + "}", F.coalesce(v, F.lit(""))) for k, v in values.items()], p)
    return F.when(F.forall(held, lambda x: x), F.array_join(F.transform(parts, filled), "")).otherwise(F.raise_error(F.lit("a placeholder is missing")).cast("string"))


def prompt_version(template: Column, *constants: Column, chars: int = 12) -> Column:
    return X.versioned(template, *constants, chars=chars)


def image_key(path: Column, prefix: str = "images") -> Column:
    """The normalised path of an image below prefix; null where it is refused.

    Refused: empty, with NUL, percent escape or backslash, absolute or with a
    drive, leaving the prefix, or of another type.
    """
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    # a step up removes the step before it; one too many is refused
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    key = F.array_join(walked, "/")
    refused = (path == "") | path.rlike(r"[\x00%\\]") | path.startswith("/") | path.rlike("^[A-Za-z]:") | ~key.startswith(prefix + "/") | ~F.lower(key).rlike(r"\.(png|jpe?g|gif|webp)$")
    return F.when(~F.coalesce(refused, F.lit(True)), key)
