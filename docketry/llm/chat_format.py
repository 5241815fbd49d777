"""Chat formatting with DataFrame functions only.

The nested field paths of a record are hashed; the hash selects a declarative
mapping that turns the record into canonical turns. A template then writes the
turns of a conversation as one string, with control strings inside texts escaped
reversibly, and marks the assistant's texts for the loss.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Strings that a trainer or a tokenizer may read as control. Fixed values of public chat templates.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Another name of a role -> the canonical one. Fixed values.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


class Layout(NamedTuple):
    """Where a record keeps its turns.

    Either ``array`` (path of an array of structs, or "" when each record is one
    turn) with ``role`` and ``text`` fields inside, or ``parts``: (role, path, ...)
    rows, whose non-empty texts are joined by blank lines into one turn.
    """

    paths: tuple[str, ...]
    array: str | None = None
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, ...], ...] = ()


#: Known layouts by their leaf paths; [] marks an array.
LAYOUTS = (
    Layout(("role", "text"), array="", role="role", text="text"),
    Layout(("messages[].content", "messages[].role"), array="messages", role="role", text="content"),
    Layout(("conversations[].from", "conversations[].value"), array="conversations", role="from", text="value"),
    Layout(("turns[].role", "turns[].text"), array="turns", role="role", text="text"),
    Layout(("completion", "prompt"), parts=(("user", "prompt"), ("assistant", "completion"))),
    Layout(("prompt", "response"), parts=(("user", "prompt"), ("assistant", "response"))),
    Layout(("instruction", "output"), parts=(("user", "instruction"), ("assistant", "output"))),
    Layout(("input", "instruction", "output"), parts=(("user", "instruction", "input"), ("assistant", "output"))),
    Layout(("prompt", "response", "system"), parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout(("data.answer", "data.question"), parts=(("user", "data.question"), ("assistant", "data.answer"))),
)


def leaf_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Sorted leaf paths of a type."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in leaf_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return leaf_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


MAPPINGS = {fingerprint(x.paths): x for x in LAYOUTS}


def _role(x: Column) -> Column:
    known = F.lower(F.coalesce(x, F.lit("")))
    out = F.coalesce(x, F.lit(""))
    for other, name in ROLES.items():
        out = F.when(known == other, F.lit(name)).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(_role(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def turns_of(layout: Layout, field) -> Column:
    """The canonical turns of one record; ``field(path)`` gives a column of it. A record that is one turn keeps its role as it stands; other layouts' roles are renamed by ROLES."""
    if layout.array == "":
        return F.array(F.struct(*(F.coalesce(field(x), F.lit("")).alias(n) for x, n in ((layout.role, "role"), (layout.text, "text")))))
    if layout.array:
        return F.transform(F.coalesce(field(layout.array), F.array()), lambda x: _turn(x[layout.role], x[layout.text]))
    turns = [_turn(F.lit(role), F.concat_ws("\n\n", *(F.nullif(field(p), F.lit("")) for p in paths))) for role, *paths in layout.parts]
    return F.array(*turns)


def struct_turns(df: DataFrame, fields: list[str]) -> Column:
    """Turns of records whose layout is the frame's own schema, read from its ``fields``; no other column counts."""
    mark = fingerprint(leaf_paths(df.select(*fields).schema))
    if mark not in MAPPINGS:
        raise ValueError(f"no mapping for the layout {leaf_paths(df.select(*fields).schema)}")
    return turns_of(MAPPINGS[mark], F.col)


def json_turns(record: Column) -> tuple[Column, Column]:
    """(fingerprint, turns) of JSON records of mixed layouts, each row by its own.

    The type that Spark infers for the record gives its paths: names in order of
    the alphabet, the kinds of scalars left out. Bad JSON, null and unknown
    layouts have null turns, so that the caller can set such rows aside.
    """
    value = F.try_parse_json(record)
    mark = F.sha2(type_shape(F.schema_of_variant(value)), 256)
    turns = F.lit(None).cast(TURNS)
    for layout in LAYOUTS:
        ddl = _ddl(layout)
        turns = F.when(mark == hashlib.sha256(shape(layout).encode()).hexdigest(), turns_of(layout, lambda p, ddl=ddl: _at(F.from_json(record, ddl), p))).otherwise(turns)
    return mark, turns


def type_shape(kind: Column) -> Column:
    """A variant's type without the kinds of its scalars."""
    return F.regexp_replace(kind, r": (?!OBJECT<|ARRAY<)[A-Z]+(\([0-9, ]*\))?", "")


def _tree(paths) -> dict:
    root: dict = {}
    for path in paths:
        node = root
        for part in path.split("."):
            node = node.setdefault(part, {})
    return root


def shape(layout: Layout) -> str:
    """What type_shape gives for the layout's records."""

    def write(node: dict) -> str:
        parts = []
        for name in sorted(node):
            inner = write(node[name]) if node[name] else ""
            parts.append(f"{name[:-2]}: ARRAY<{inner}>" if name.endswith("[]") else f"{name}: {inner}" if inner else name)
        return f"OBJECT<{', '.join(parts)}>"

    return write(_tree(layout.paths))


def _ddl(layout: Layout) -> str:
    def write(node: dict) -> str:
        parts = []
        for name in sorted(node):
            inner = f"struct<{write(node[name])}>" if node[name] else "string"
            parts.append(f"`{name[:-2]}`: array<{inner}>" if name.endswith("[]") else f"`{name}`: {inner}")
        return ", ".join(parts)

    return f"struct<{write(_tree(layout.paths))}>"


def _at(record: Column, path: str) -> Column:
    for part in path.split("."):
        record = record[part]
    return record


#: The rests of the control strings after their first characters, as a pattern.
RESTS = "|".join(re.sub(r"([^a-zA-Z_])", r"\\\1", x[1:]) for x in CONTROLS)


def escape(text: Column) -> Column:
    """One backslash more after the first character of each control string; so n backslashes become n + 1 and no control string stays whole."""
    return F.regexp_replace(text, rf"([<\[]\\*)(?={RESTS})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]\\*)\\(?={RESTS})", "$1")


def format_chats(turns: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``loss_spans``.

    ``turns`` has the id, the order and ``turns`` (canonical, one or more per
    row). Rows go by order, nulls first; equal orders by their turns, so that the
    result never depends on the rows' places. Repeated rows are repeated turns.
    A null id is a conversation of its own. Roles are percent-encoded, so that
    none can break a header. A span is (start, length) in code points of
    ``formatted``, the escaped text of one assistant turn.
    """
    piece = lambda t: F.concat(F.lit(OPEN), F.url_encode(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))
    row = F.struct(F.col(order).alias("order"), F.col("turns").alias("turns"))
    rows = turns.where(F.size("turns") > 0).groupBy(conversation).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    flat = rows.select(conversation, F.flatten(F.transform("_rows", lambda x: x["turns"])).alias("_turns"))
    pieces = F.transform("_turns", lambda t: F.struct(piece(t).alias("out"), t["role"].alias("role"), F.length(F.url_encode(t["role"])).alias("head")))
    laid = flat.select(conversation, pieces.alias("_pieces"))
    ahead, behind = len(OPEN) + 1, len(CLOSE)
    step = lambda acc, p: F.struct(
        (acc["at"] + F.length(p["out"])).alias("at"),
        F.when(
            p["role"] == "assistant",
            F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["head"] + ahead).alias("start"), (F.length(p["out"]) - p["head"] - ahead - behind).alias("length")))),
        )
        .otherwise(acc["spans"])
        .alias("spans"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return laid.select(
        conversation,
        F.array_join(F.transform("_pieces", lambda p: p["out"]), "").alias("formatted"),
        F.aggregate("_pieces", start, step, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted conversation holds."""
    segments = F.slice(F.split(formatted, re.escape(OPEN), -1), 2, 1 << 30)

    def turn(x: Column) -> Column:
        head = F.locate("\n", x)
        return F.struct(
            F.url_decode(F.substring(x, F.lit(1), head - 1)).alias("role"),
            unescape(F.substring(x, head + 1, F.length(x) - head - len(CLOSE))).alias("text"),
        )

    return F.transform(segments, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
