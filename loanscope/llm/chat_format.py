"""Chat formatting: records of many layouts to canonical turns, formatted text and loss mask; DataFrame functions only.

Every record's fingerprint is the hash of the nested field paths it fills
(``messages[].role``, ``prompt``, ...), among the paths that some layout names;
fields that no layout names do not matter.  The fingerprint selects a layout,
which says declaratively where the turns are: a list of (role, text) elements,
or single fields that are one turn each.  Optional paths of a layout are
expanded into its fingerprints when the plan is made.

A template puts marks around each turn.  Control strings inside roles and texts
are escaped: every backslash is doubled and one is set behind the first
character of each control string, so none is left whole and the text can be read
back exactly.  The loss mask is a list of byte ranges of the formatted text, one
for each assistant text.

Defined cases: a null or empty text is an empty turn, a null role an empty role;
a record that fills no path, or a set of paths that fits no layout, has null
layout, turns, text and mask and stays in the result; a record with an empty list
has no turns and an empty text; very long texts stay whole (a conversation is one
row); repeated records are formatted each by itself.  ``as_records`` orders rows
by turn (null first), then role, then text, so ties have one result, and takes
all rows with a null id as one conversation.  Extra columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where a record keeps its turns.

    ``items`` is (array, role field, text field); ``fields`` are (role, columns) for layouts of one column a
    turn, whose columns are joined by a blank line.  A turn whose columns are all absent is left out.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def path_sets(self) -> list[tuple[str, ...]]:
        return [tuple(sorted(self.required + some)) for n in range(len(self.optional) + 1)
                for some in combinations(self.optional, n)]


#: Field names of public instruction and chat data sets.
LAYOUTS = (
    Layout("messages", ("messages[]",), ("messages[].role", "messages[].content"), items=("messages", "role", "content")),
    Layout("from_value", ("conversations[]",), ("conversations[].from", "conversations[].value"),
           items=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt_response", ("prompt", "response"), ("system",),
           fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("prompt", "completion"), ("system",),
           fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("instruction", ("instruction", "output"), ("system", "input"),
           fields=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
)


@dataclass(frozen=True)
class Template:
    """Marks around a turn, and the strings that must not stand in a text (the marks among them)."""

    start: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>\n"
    #: Control strings of public chat templates.
    control: tuple[str, ...] = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]",
                                "<<SYS>>", "<</SYS>>")

    def __post_init__(self):
        if any(len(c) < 2 or "\\" in c for c in self.control):
            raise ValueError("a control string has two characters or more and no backslash")
        if any(not any(c in mark for c in self.control) for mark in (self.start, self.middle, self.end)):
            raise ValueError("each mark must hold a control string")


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9\n])", r"\\\1", text)


def escape(text: Column, template: Template = Template()) -> Column:
    """``text`` without a whole control string; ``unescape`` gives it back."""
    ends: dict[str, list[str]] = {}
    for c in template.control:
        ends.setdefault(c[0], []).append(_quoted(c[1:]))
    inside = "|".join(f"{_quoted(head)}(?={'|'.join(tails)})" for head, tails in ends.items())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({inside})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _paths(value: Column, kind: T.DataType, path: str, known: set[str]) -> list[tuple[str, Column]]:
    """(path, whether a record fills it) for all known paths at and below a value."""
    found = []
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            found += _paths(value[f.name], f.dataType, f"{path}.{f.name}" if path else f.name, known)
        return found
    if isinstance(kind, T.ArrayType):
        path = f"{path}[]"
        if path in known:
            found.append((path, value.isNotNull()))
        if isinstance(kind.elementType, T.StructType):
            for f in kind.elementType.fields:
                inner = f"{path}.{f.name}"
                if inner in known and isinstance(f.dataType, T.StringType):
                    found.append((inner, _some(value, f.name)))
        return found
    return [(path, value.isNotNull())] if path in known and isinstance(kind, T.StringType) else []


def _when(cases: Column | None, condition: Column, value: Column) -> Column:
    return (F if cases is None else cases).when(condition, value)


def _some(array: Column, name: str) -> Column:
    return F.exists(array, lambda e: e[name].isNotNull())


def _hash(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def fingerprint(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Hash of the field paths that a record fills, of those that some layout names."""
    known = {p for one in layouts for p in one.required + one.optional}
    unique = [f for f in records.schema.fields if [x.name for x in records.schema.fields].count(f.name) == 1]
    found = sorted((p for f in unique for p in _paths(F.col(f"`{f.name}`"), f.dataType, f.name, known)), key=lambda p: p[0])
    filled = [F.when(F.coalesce(there, F.lit(False)), F.lit(path)) for path, there in found]
    return _hash(F.array_compact(F.array(*filled).cast("array<string>")))


def _turns(layout: Layout, columns: set[str]) -> Column:
    empty = F.lit("")
    if layout.items:
        array, role, text = layout.items

        def renamed(r: Column) -> Column:
            out = None
            for theirs, ours in layout.roles.items():
                out = _when(out, r == theirs, F.lit(ours))
            return r if out is None else out.otherwise(r)

        return F.transform(F.col(array), lambda e: F.struct(F.coalesce(renamed(e[role]), empty).alias("role"),
                                                            F.coalesce(e[text], empty).alias("text"))).cast(TURNS)
    turns = []
    for role, names in layout.fields:
        there = [F.col(n) for n in names if n in columns]
        if there:
            turns.append(F.when(F.coalesce(*there).isNotNull(),
                                F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *there).alias("text"))))
    return F.array_compact(F.array(*turns)).cast(TURNS)


def _fits(layout: Layout, records: DataFrame) -> bool:
    if layout.items:
        array, role, text = layout.items
        kind = next((f.dataType for f in records.schema.fields if f.name == array), None)
        return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and {role, text} <= set(kind.elementType.names)
    return set(layout.required) <= {f.name for f in records.schema.fields if isinstance(f.dataType, T.StringType)}


def canonical(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS, *, id_col: str = "conv_id") -> DataFrame:
    """(id, fingerprint, layout, turns) of every record."""
    columns = set(records.columns)
    name = turns = None
    made = records.withColumn("__print", fingerprint(records, layouts))
    for one in layouts:
        if not _fits(one, records):
            continue
        chosen = F.col("__print").isin([_hash(F.array(*[F.lit(p) for p in paths])) for paths in one.path_sets()])
        name = _when(name, chosen, F.lit(one.name))
        turns = _when(turns, chosen, _turns(one, columns))
    none = F.lit(None)
    return made.select(F.col(id_col).alias("id"), F.col("__print").alias("fingerprint"),
                       (none.cast("string") if name is None else name).alias("layout"),
                       (none.cast(TURNS) if turns is None else turns).alias("turns"))


def format_chats(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS, template: Template = Template(), *,
                 id_col: str = "conv_id") -> DataFrame:
    """(id, fingerprint, layout, turns, formatted, loss): ``loss`` holds (start, length) byte ranges of the assistant texts."""
    made = canonical(records, layouts, id_col=id_col)
    safe = made.withColumn("__safe", F.transform("turns", lambda t: F.struct(
        (t["role"] == "assistant").alias("learnt"), escape(t["role"], template).alias("role"), escape(t["text"], template).alias("text"))))
    mark = [F.lit(m) for m in (template.start, template.middle, template.end)]
    marks = [len(m.encode()) for m in (template.start, template.middle, template.end)]
    pieces = F.transform("__safe", lambda t: F.concat(mark[0], t["role"], mark[1], t["text"], mark[2]))
    spans = "array<struct<start:bigint,length:bigint>>"

    def add(state: Column, t: Column) -> Column:
        start = state["at"] + marks[0] + F.octet_length(t["role"]) + marks[1]
        n = F.octet_length(t["text"]).cast("bigint")
        span = F.struct(start.alias("start"), n.alias("length"))
        return F.struct((start + n + marks[2]).alias("at"),
                        F.when(t["learnt"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(spans).alias("spans"))
    return safe.select("id", "fingerprint", "layout", "turns", F.array_join(pieces, "").alias("formatted"),
                       F.aggregate("__safe", start, add, lambda s: s["spans"]).alias("loss"))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text, unescaped."""
    pieces = F.split(formatted, _quoted(template.end))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, template.middle, 1)
        text = F.substring_index(piece, template.middle, -1)
        return F.struct(unescape(F.substr(role, F.lit(len(template.start) + 1))).alias("role"), unescape(text).alias("text"))

    return F.transform(F.filter(pieces, lambda p: p != ""), turn).cast(TURNS)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    # A one-element array binds the bytes to a name, so they are copied once.
    texts = F.transform(F.array(formatted.cast("binary")), lambda b: F.transform(
        loss, lambda s: unescape(F.substring(b, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))))
    return F.get(texts, F.lit(0))


def as_records(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as one record a conversation, in the layout that its roles allow.

    A user and an assistant turn become a prompt and its response (behind a system turn: with a system text), a
    conversation opened by a system turn a from/value list, all others a list of messages.
    """
    # Null and empty have one meaning here, and an empty text still fills its path.
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("rows"))
    roles = F.array_join(F.transform("rows", lambda r: r["role"]), "\n")
    short = roles.isin("user\nassistant", "system\nuser\nassistant")
    known = F.forall("rows", lambda r: r["role"].isin("user", "assistant", "system"))
    listed = ~short & (F.get("rows", F.lit(0))["role"] == "system") & known

    def theirs(r: Column) -> Column:
        return F.when(r == "user", F.lit("human")).when(r == "assistant", F.lit("gpt")).otherwise(r)

    n = F.size("rows")
    return grouped.select(
        "conv_id",
        F.when(short & (n == 3), F.get("rows", F.lit(0))["text"]).alias("system"),
        F.when(short, F.get("rows", n - 2)["text"]).alias("prompt"),
        F.when(short, F.get("rows", n - 1)["text"]).alias("response"),
        F.when(listed, F.transform("rows", lambda r: F.struct(theirs(r["role"]).alias("from"), r["text"].alias("value")))).alias("conversations"),
        F.when(~short & ~listed, F.transform("rows", lambda r: F.struct(r["role"], r["text"].alias("content")))).alias("messages"))
