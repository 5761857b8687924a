"""Chat formatting: layouts recognised by a fingerprint of their field paths, one canonical template.

A *layout* is declared as the field paths that it must have and expressions that give its
turns. A table (or one JSON record) has a layout if the hash of those of its nested field paths that the layout names is
the layout's fingerprint; other fields do not count, and of several the one with most paths is taken. Every
layout yields rows (conversation, position, role, text). Records without a layout or without turns are
returned as rejected, with the reason. The template marks turns and escapes control strings inside roles and texts
reversibly. All of it is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
"""Strings that no escaped role or text contains. The marks of the template start with the first."""

ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
"""Other names of roles in the from/value layout."""


def _broken(control: str) -> str:
    return control[0] + "\\" + control[1:]


def escape(x: Column) -> Column:
    """Backslashes are doubled; one backslash then breaks each control string after its first character."""
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        x = F.replace(x, F.lit(c), F.lit(_broken(c)))
    return x


def unescape(x: Column) -> Column:
    for c in CONTROL:
        x = F.replace(x, F.lit(_broken(c)), F.lit(c))
    return F.replace(x, F.lit("\\\\"), F.lit("\\"))


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("text"))


def _filled(*turns: Column) -> Column:
    return F.filter(F.array(*turns), lambda t: t["text"].isNotNull())


def _messages(field: str, role: str, text: str, names: dict[str, str] | None = None) -> Callable[[Callable[[str], Column]], Column]:
    def turns(of):
        kind = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
        said = lambda m: m[role] if kind is None else F.coalesce(kind[F.lower(m[role])], m[role])
        return F.transform(F.filter(of(field), lambda m: m.isNotNull()), lambda m: F.struct(
            said(m).alias("role"), m[text].alias("text")))
    return turns


def _asked(*fields: str) -> Callable:
    def text(of):
        return F.concat_ws("\n\n", *[F.when(of(f) != "", of(f)) for f in fields])
    return text


LAYOUTS: dict[tuple[str, ...], Callable[[Callable[[str], Column]], Column]] = {
    ("messages[].content", "messages[].role"): _messages("messages", "role", "content"),
    ("conversations[].from", "conversations[].value"): _messages("conversations", "from", "value", ROLES),
    ("prompt", "response"): lambda of: _filled(_turn("user", of("prompt")), _turn("assistant", of("response"))),
    ("completion", "prompt"): lambda of: _filled(_turn("user", of("prompt")), _turn("assistant", of("completion"))),
    ("answer", "question"): lambda of: _filled(_turn("user", of("question")), _turn("assistant", of("answer"))),
    ("instruction", "output"): lambda of: _filled(
        _turn("user", of("instruction")), _turn("assistant", of("output"))),
    ("input", "instruction", "output"): lambda of: _filled(
        _turn("user", _asked("instruction", "input")(of)), _turn("assistant", of("output"))),
    ("prompt", "response", "system"): lambda of: _filled(
        _turn("system", of("system")), _turn("user", of("prompt")), _turn("assistant", of("response"))),
}
"""Field paths in code point order -> turns (array of role and text) from a getter of top-level fields."""

TURN_ROWS = ("conv_id", "role", "text", "turn")
"""Paths of a table that has a row per turn."""

KNOWN = sorted({p for layout in LAYOUTS for p in layout} | set(TURN_ROWS))


def fingerprint(paths) -> str:
    """Hash of the known ones among field paths, in code point order."""
    return hashlib.md5("\n".join(sorted(set(paths) & set(KNOWN))).encode()).hexdigest()


BY_SPECIFICITY = sorted([*LAYOUTS, TURN_ROWS], key=lambda paths: (-len(paths), paths))
"""Paths of the layouts, most first; of equally many the first in code point order."""

def field_paths(kind: DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema: ``a.b`` below structs, ``a[].b`` below arrays of structs."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, f"{at}[]") if isinstance(kind.elementType, StructType) else [f"{at}[]"]
    return [at]


def layout_of(paths) -> tuple[str, ...] | None:
    """Paths of the layout of a table or record with these field paths."""
    return next((x for x in BY_SPECIFICITY if fingerprint(set(paths) & set(x)) == fingerprint(x)), None)


def canonical_table(df: DataFrame, key: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(turns, rejected) of a table whose fields are columns.

    ``turns``: conv_id, turn, role, text. A table with a row per turn is taken as it is; elsewhere ``key`` names the
    conversation's id and turns count from 0. ``rejected``: key, fingerprint, reason of the rows that give no turns. Raises
    ValueError for a table of no layout, with the known paths found. Other columns are ignored, whatever their names.
    """
    paths = field_paths(df.schema)
    layout = layout_of(paths)
    if layout is None:
        raise ValueError(f"no layout for the fields {sorted(set(paths) & set(KNOWN))}")
    if layout == TURN_ROWS:
        none = df.select(F.col("conv_id").alias("key"), F.lit("").alias("fingerprint"), F.lit("").alias("reason")).where("false")
        return df.select("conv_id", "turn", "role", "text"), none
    turns = LAYOUTS[layout](lambda field: F.col(f"`{field}`"))
    made = df.select(F.col(f"`{key}`").alias("conv_id"), turns.alias("turns"))
    return _exploded(made), made.where("turns is null or size(turns) = 0").select(
        F.col("conv_id").alias("key"), F.lit(fingerprint(paths)).alias("fingerprint"), F.lit("no turns").alias("reason"))


def canonical_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """The turns of ``canonical_table``."""
    return canonical_table(df, key)[0]


def _exploded(df: DataFrame) -> DataFrame:
    return df.select("conv_id", F.posexplode("turns").alias("turn", "t")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text"))


def json_paths(record: Column) -> Column:
    """Field paths of one JSON record, native: top-level keys, and the keys of all elements of the arrays that layouts name."""
    none = F.array().cast("array<string>")
    nested = sorted({p.split("[]")[0] for p in KNOWN if "[]" in p})
    keys = lambda x, before: F.transform(F.coalesce(F.json_object_keys(x), none), lambda k: F.concat(F.lit(before), k))

    def inside(field):
        elements = F.from_json(F.get_json_object(record, f"$.{field}"), "array<string>")
        return F.flatten(F.transform(F.coalesce(elements, none), lambda e: keys(e, f"{field}[].")))
    return F.array_distinct(F.concat(keys(record, ""), *map(inside, nested)))


def _hashed(paths: Column, known) -> Column:
    return F.md5(F.array_join(F.array_sort(F.array_intersect(paths, F.array(*[F.lit(k) for k in known]))), "\n"))


def canonical_json(df: DataFrame, key: str, record: str) -> tuple[DataFrame, DataFrame]:
    """(turns, rejected) of JSON records in any mixture of layouts; as ``canonical_table``.

    A record is rejected as "not a JSON object" (nulls too), "no layout" (also for an empty list of messages) or "no turns".
    A message without a role or text is a turn that has a null there; elements that are no objects are no messages.
    """
    text = F.col("record")

    def getter(field):
        if any(p.startswith(f"{field}[]") for p in KNOWN):
            inner = ", ".join(f"`{p.split('.')[-1]}`: string" for p in KNOWN if p.startswith(f"{field}[]."))
            objects = F.filter(F.from_json(F.get_json_object(text, f"$.{field}"), "array<string>"),
                               lambda e: F.json_object_keys(e).isNotNull())
            return F.transform(objects, lambda e: F.from_json(e, f"struct<{inner}>"))
        return F.get_json_object(text, f"$.{field}")

    read = df.select(F.col(f"`{key}`").alias("conv_id"), F.col(f"`{record}`").alias("record")).withColumn("paths", json_paths(text))
    mark, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in reversed([x for x in BY_SPECIFICITY if x != TURN_ROWS]):
        has = _hashed(F.col("paths"), layout) == fingerprint(layout)
        mark = F.when(has, F.lit(fingerprint(layout))).otherwise(mark)
        turns = F.when(has, LAYOUTS[layout](getter).cast("array<struct<role:string,text:string>>")).otherwise(turns)
    made = read.select("conv_id", mark.alias("mark"), turns.alias("turns"), _hashed(F.col("paths"), KNOWN).alias("fingerprint"),
                       F.json_object_keys(text).isNull().alias("bad"))
    reason = F.when(F.col("bad"), "not a JSON object").when(F.col("mark").isNull(), "no layout").otherwise("no turns")
    return _exploded(made), made.where("turns is null or size(turns) = 0").select(
        F.col("conv_id").alias("key"), "fingerprint", reason.alias("reason"))


def canonical_turns_of_json(df: DataFrame, key: str, record: str) -> DataFrame:
    """The turns of ``canonical_json``."""
    return canonical_json(df, key, record)[0]


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: one row per conversation.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Turns stand in the order of
    turn, role, text, nulls first, so ties and repeated rows keep a defined place (each is a turn).
    A null role or text counts as empty; rows with a null conv_id form one conversation. ``loss_spans``
    has the (start, length) in code points of each assistant text in ``formatted``. An empty
    table gives no rows.
    """
    none = F.lit("")
    rows = turns.select("conv_id", "turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    head = F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(TEXT))
    rows = rows.withColumn("_head", head).withColumn("_body", escape(F.col("text")))
    rows = rows.withColumn("_piece", F.concat("_head", "_body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.length("_piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("conv_id", F.row_number().over(order).alias("_n"), "_piece",
                       F.when(F.col("role") == "assistant", F.struct(
                           (before + F.length("_head")).alias("start"), F.length("_body").cast("long").alias("length"))
                              ).alias("_span"))
    return rows.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_piece"))), lambda x: x["_piece"]), "")
        .alias("formatted"), F.array_sort(F.collect_list("_span")).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    parts = F.split(formatted, r"<\|role\|>")
    parts = F.slice(parts, F.lit(2), F.size(parts))

    def turn(x):
        at = F.instr(x, TEXT)
        return F.struct(unescape(F.substring(x, F.lit(1), at - 1)).alias("role"), unescape(F.substring(
            x, at + len(TEXT), F.length(x) - at - len(TEXT) + 1 - len(END))).alias("text"))
    return F.transform(parts, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(
        formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
