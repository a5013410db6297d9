"""Chat formatting by schema fingerprints.  DataFrame functions only.

Method
    A record's layout is the sorted list of its nested field paths (arrays as
    ``[]``); its fingerprint is the SHA-256 of that list.  ``MAPPINGS`` names
    layouts by the paths they need and says, declaratively, where their turns
    are.  A fingerprint selects the mapping: ``survey`` aggregates the records
    to one row per fingerprint, finds the mapping of each once and counts its
    records, and the records are joined with that table by fingerprint.  A
    layout that is just what a mapping needs comes first, then the mapping that
    needs most paths, then the first one.

    ``layouts`` is the one place that does so: mappings by the fingerprints of
    the layouts that are just what they need, then the rule for larger ones.

    * ``canonical_table``: a typed table; its schema is the layout.
    * ``canonical_json``: a column of JSON records of mixed layouts; each
      record's paths are taken from the record (``schema_of_variant``), at any
      depth.  Texts given as lists of parts are joined by blank lines.  A
      layout may also stand inside one of the ``CONTAINERS``.

Template
    ``<|im_start|>`` role LF text ``<|im_end|>`` LF, per turn.  Inside texts
    and roles a backslash is put between ``<`` and ``|``, and one more where
    backslashes already stand between them, so no text holds a control string
    and taking one backslash away gives the text back.  In roles ``%`` and LF
    are percent-encoded, so a role stays on its line.

Loss mask
    Spans [start, end) in code points of the formatted string: the escaped
    text of each assistant turn.

Bounds
    A conversation is one string, so its turns meet in one row; nothing else is
    gathered.  Turns are ordered by turn, role, text.

Defined cases
    Null text or role: empty.  Null turn: first.  Repeated rows: each is a
    turn.  Null conv_id: one conversation of its own.  Very long texts: whole.
    Empty table: no rows.  ``canonical_table`` ignores columns that its mapping
    doesn't name.  ``canonical_json`` keeps all columns, but those called
    fingerprint, layout or turns give way to the new ones.  A record of a
    layout without mapping: ``layout`` null and no turns; ``survey`` tells how
    many there are.  A record that isn't JSON: fingerprint null as well.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import free_name, stage

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role: string, text: string>>"


# Layouts ------------------------------------------------------------------

#: name: (paths that the layout has, kind, where).  The first that fits is used.
#: kind "list": turns are the entries of an array, (array, role field, text field).
#: kind "pairs": turns are fields of the record, (role, fields in order to join).
MAPPINGS = {
    "messages": (["messages[].content", "messages[].role"], "list", ("messages", "role", "content")),
    "conversations": (["conversations[].from", "conversations[].value"], "list", ("conversations", "from", "value")),
    "dialog": (["dialog[].speaker", "dialog[].text"], "list", ("dialog", "speaker", "text")),
    "instruction": (["instruction", "output"], "pairs", [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]),
    "prompt": (["completion", "prompt"], "pairs", [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])]),
    "prompt_response": (["prompt", "response"], "pairs", [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]),
    "question": (["answer", "question"], "pairs", [("system", ["system"]), ("user", ["context", "question"]), ("assistant", ["answer"])]),
    "turn_rows": (["role", "text", "turn"], "rows", ("turn", "role", "text")),
}
#: Fields of a record in which a whole layout may stand.
CONTAINERS = ("data", "record", "sample", "example")
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "instructor": "system"}


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Sorted paths of the leaves of a type."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def mappings() -> dict[str, tuple[str, list[str]]]:
    """name of each layout in the order in which they are tried: (container and a dot or nothing, needed paths)."""
    every = {f"{c}.{name}" if c else name: (f"{c}." if c else "", need) for c in ("", *CONTAINERS) for name, (need, kind, _) in MAPPINGS.items() if not c or kind != "rows"}
    return dict(sorted(every.items(), key=lambda x: (bool(x[1][0]), -len(x[1][1]))))


def fingerprint(paths: list[str]) -> str:
    """What Spark's fingerprint_column gives for these paths."""
    import hashlib

    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def exact_prints() -> dict[str, str]:
    """fingerprint: name of the mapping that needs just the paths that it stands for."""
    out: dict[str, str] = {}
    for name, (at, need) in mappings().items():
        out.setdefault(fingerprint([at + n for n in need]), name)
    return out


#: Parts of schema_of_variant's text: names, what opens and closes a level, types of leaves.
TOKENS = r"`[^`]*(?:``[^`]*)*`(?=: )|[A-Za-z0-9_]+(?=: )|OBJECT<>|OBJECT<|ARRAY<|>|[A-Z_]+(?: [A-Z]+)*(?:\([^)]*\))?"


def variant_paths(record: Column) -> Column:
    """Sorted paths of the leaves of one variant, as schema_paths gives them; names with other signs stay in backquotes."""
    # the text is read from left to right; levels holds the path of every open level, at the path being read
    tokens = F.regexp_extract_all(F.schema_of_variant(record), F.lit(TOKENS), 0)
    begin = F.struct(F.array().cast("array<struct<path: string, fields: boolean>>").alias("levels"), F.lit("").alias("at"), F.array().cast("array<string>").alias("paths"))

    def step(acc, t):
        levels, at, paths = acc["levels"], acc["at"], acc["paths"]
        top = F.try_element_at(levels, F.lit(-1))
        state = lambda levels, at, paths: F.struct(levels.alias("levels"), at.alias("at"), paths.alias("paths"))
        opened = lambda path, fields: F.array_append(levels, F.struct(path.alias("path"), F.lit(fields).alias("fields")))
        named = F.concat(top["path"], F.when(top["path"] == "", "").otherwise("."), F.regexp_replace(t, "^`([A-Za-z0-9_]+)`$", "$1"))
        name = top["fields"] & (acc["at"].isNull())
        return (
            F.when(name & (t != ">"), state(levels, named, paths))
            .when(t == "OBJECT<", state(opened(at, True), F.lit(None).cast("string"), paths))
            .when(t == "ARRAY<", state(opened(F.concat(at, F.lit("[]")), False), F.concat(at, F.lit("[]")), paths))
            .when(t == ">", state(F.slice(levels, 1, F.size(levels) - 1), F.lit(None).cast("string"), paths))
            .otherwise(state(levels, F.lit(None).cast("string"), F.array_append(paths, at)))
        )

    return F.array_sort(F.array_distinct(F.aggregate(tokens, begin, step)["paths"]))


def has_paths(paths: Column, need: list[str]) -> Column:
    """Whether each of need is a path or the start of deeper ones."""
    is_at = lambda n: lambda p: (p == n) | F.startswith(p, F.lit(f"{n}.")) | F.startswith(p, F.lit(f"{n}[]"))
    return reduce(and_, [F.exists(paths, is_at(n)) for n in need])


def variant_text(value: Column) -> Column:
    """A text as it is; of a list of parts their texts (JSON of parts without one) joined by blank lines; JSON of anything else."""
    part = lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.try_variant_get(x, "$", "string"))
    parts = F.try_variant_get(value, "$", "array<variant>")
    return F.when(parts.isNotNull(), F.array_join(F.transform(parts, part), "\n\n")).otherwise(F.try_variant_get(value, "$", "string"))


def role_column(role: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    out = low
    for old, new in ROLES.items():
        out = F.when(low == old, F.lit(new)).otherwise(out)
    return out


def entry(role: str, text: str):
    """A turn from one entry of an array of variants."""
    got = lambda x, field: F.try_variant_get(x, f"$.{field}", "string")
    return lambda x: F.struct(role_column(got(x, role)).alias("role"), F.coalesce(variant_text(F.try_variant_get(x, f"$.{text}", "variant")), F.lit("")).alias("text"))


def layouts(prints: DataFrame) -> DataFrame:
    """prints (fingerprint, paths) with layout, the name of its mapping (null: none)."""
    larger = F.lit(None).cast("string")
    for name, (at, need) in reversed(mappings().items()):
        larger = F.when(has_paths(F.col("paths"), [at + n for n in need]), F.lit(name)).otherwise(larger)
    exact = F.create_map(*[F.lit(x) for pair in exact_prints().items() for x in pair])
    return prints.withColumn("layout", F.coalesce(F.try_element_at(exact, F.col("fingerprint")), larger))


def turns_of(record: Column, name: str) -> Column:
    """The turns (TURNS) of a variant in the layout of this name."""
    at = mappings()[name][0]
    _, kind, where = MAPPINGS[name[len(at) :]]
    of = lambda field: F.try_variant_get(record, f"$.{at}{field}", "variant")
    if kind == "list":
        array, role, text = where
        made = F.transform(F.try_variant_get(record, f"$.{at}{array}", "array<variant>"), entry(role, text))
    else:
        # a null part is absent, and concat leaves it out
        part = [(r, F.array_compact(F.array(*[variant_text(of(f)) for f in fs]))) for r, fs in where]
        made = F.filter(F.array(*[F.when((F.size(p) > 0) | F.lit(r != "system"), F.struct(F.lit(r).alias("role"), F.array_join(F.filter(p, lambda x: x != ""), "\n\n").alias("text"))) for r, p in part]), lambda x: x.isNotNull())
    return made.cast(TURNS)


def survey(records: DataFrame, json_col: str = "record") -> DataFrame:
    """fingerprint, layout (null: no mapping), records, paths: one row per fingerprint."""
    v = F.try_parse_json(F.col(f"`{json_col}`"))
    paths = records.select(F.when(v.isNotNull(), variant_paths(v)).alias("paths")).where("paths is not null")
    counted = paths.groupBy(F.sha2(F.array_join("paths", "\n"), 256).alias("fingerprint")).agg(F.first("paths").alias("paths"), F.count(F.lit(1)).alias("records"))
    return layouts(counted).select("fingerprint", "layout", "records", "paths")


def canonical_json(records: DataFrame, json_col: str = "record") -> DataFrame:
    """records with fingerprint, layout and turns (TURNS) of each JSON record."""
    made = ("fingerprint", "layout", "turns")
    own = records.drop(*[c for c in records.columns if c.lower() in made and c != json_col])
    value, key = free_name(own, "__value"), free_name(own, "__key")
    v = F.try_parse_json(F.col(f"`{json_col}`"))
    # stored, so that a fingerprint of very many records can be split
    known = stage(survey(records, json_col).select(F.col("fingerprint").alias(key), F.col("layout").alias("layout")), "layouts")
    print_ = F.when(v.isNotNull(), F.sha2(F.array_join(variant_paths(v), "\n"), 256))
    joined = own.withColumn("fingerprint", print_).join(known, F.col("fingerprint") == F.col(key), "left").withColumn(value, v)
    turns = F.lit(None).cast(TURNS)
    for name in mappings():
        if name != "turn_rows":
            turns = F.when(F.col("layout") == name, turns_of(F.col(value), name)).otherwise(turns)
    layout = F.when(F.col("layout") != "turn_rows", F.col("layout"))
    return joined.select(*[F.col(f"`{c}`") for c in own.columns], "fingerprint", layout.alias("layout"), turns.alias("turns"))


def canonical_table(rows: DataFrame, id_col: str) -> DataFrame:
    """id_col, layout, fingerprint, turns of a typed table, by the layout of its schema."""
    rest = [F.col(f"`{c}`") for c in rows.columns if c != id_col]
    paths = schema_paths(rows.select(*rest).schema)
    print_ = fingerprint(paths)
    known = layouts(rows.sparkSession.createDataFrame([(print_, paths)], "fingerprint string, paths array<string>"))  # one row, as a table has one schema
    name = known.first()["layout"]
    if name is None:
        raise ValueError(f"no mapping for the layout {paths}")
    if MAPPINGS.get(name, ("", "", ""))[1] == "rows":
        turn, role, text = MAPPINGS[name][2]
        text_of = lambda c: F.coalesce(c.cast("string"), F.lit(""))
        part = F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"), text_of(F.col(role)).alias("role"), text_of(F.col(text)).alias("text"))
        out = rows.groupBy(F.col(f"`{id_col}`")).agg(F.array_sort(F.collect_list(part)).alias("all"))
        turns = F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).cast(TURNS)
    else:
        out, turns = rows, F.coalesce(turns_of(F.parse_json(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})), name), F.array().cast(TURNS))
    return out.select(F.col(f"`{id_col}`"), F.lit(name).alias("layout"), F.lit(print_).alias("fingerprint"), turns.alias("turns"))


# Template -----------------------------------------------------------------


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_turns(canonical: DataFrame, keep: list[str]) -> DataFrame:
    """keep, formatted (string) and loss_spans (array of start, end) of each conversation."""
    safe = F.transform("turns", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")))
    one = lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END), F.lit("\n"))
    head = lambda t: F.lit(len(START) + 1) + F.length(t["role"])
    whole = lambda t: head(t) + F.length(t["text"]) + F.lit(len(END) + 1)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def step(acc, t):
        start = acc["at"] + head(t)
        span = F.struct(start.alias("start"), (start + F.length(t["text"])).alias("end"))
        return F.struct((acc["at"] + whole(t)).alias("at"), F.when(t["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    out = canonical.withColumn("safe", safe)
    return out.select(*keep, F.array_join(F.transform("safe", one), "").alias("formatted"), F.aggregate("safe", begin, step)["spans"].alias("loss_spans"))


def parse_formatted(formatted: DataFrame, keep: list[str]) -> DataFrame:
    """keep, turns (TURNS), loss_texts, formatted_chars: read back from formatted and loss_spans alone."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "")

    def turn(x):
        body = F.substr(x, F.lit(len(START) + 1))
        line = F.position(F.lit("\n"), body)
        return F.struct(unescape_role(F.substr(body, F.lit(1), line - 1)).alias("role"), unescape(F.substr(body, line + 1)).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select(*keep, F.transform(pieces, turn).alias("turns"), loss.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))
