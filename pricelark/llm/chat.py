"""Chat formatting by schema fingerprints, in DataFrame functions alone.

Records come as JSON texts or as structs in one of several layouts (prompts,
instructions, messages, conversations). The nested field paths that a record
has are hashed; the hash selects a declared mapping, which turns the record
into canonical turns (role, text). A template then makes one text of the turns
and a loss mask in runs.

The template marks a turn as `### role: text</turn>` and a line feed. Inside
texts and roles a backslash is doubled and each control string gets a
backslash after its first character, so no control string is left in them
and a formatted text is split at the marks alone.

Defined cases: null texts and roles are empty; a field that is null counts as
absent; fields that no mapping names are ignored; a record whose paths belong
to no layout, or that isn't JSON, is kept with a null layout and no turns; an
empty list gives no turns; rows of one conversation are in the order of
(turn, role, text), null turns first, and repeated rows are repeated turns; a
null conv_id is a conversation of its own; empty tables give no rows. A
conversation is one record, so its turns meet in one row: they are collected
per task before they are shuffled, and texts are split, joined and unescaped in
time linear in their length.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = "role string, content string"
SHARED = "`from` string, value string"
#: All fields that mappings name. JSON texts are read by it, and structs are widened to it.
RECORD = f"system string, prompt string, completion string, response string, instruction string, input string, output string, messages array<struct<{MESSAGE}>>, conversations array<struct<{SHARED}>>"
TURN = "array<struct<role: string, text: string>>"

#: Names of speakers in shared conversations.
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Said:
    """A turn of fixed role; its text is that of some fields, joined by a blank line, empty ones left out."""

    role: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Listed:
    """The turns of a list of structs. Roles in `names` are translated."""

    field: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Layout:
    """Paths that a record must have and may have, and the turns that it says."""

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: tuple[Said | Listed, ...]

    def path_sets(self) -> list[tuple[str, ...]]:
        return [tuple(sorted({*self.needs, *some})) for k in range(len(self.may) + 1) for some in combinations(self.may, k)]


SYSTEM = Said("system", ("system",))
LAYOUTS = (
    Layout("prompt", ("prompt", "completion"), ("system",), (SYSTEM, Said("user", ("prompt",)), Said("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), ("system",), (SYSTEM, Said("user", ("prompt",)), Said("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"), ("system", "input"), (SYSTEM, Said("user", ("instruction", "input")), Said("assistant", ("output",)))),
    Layout("messages", ("messages[]",), ("system", "messages[].role", "messages[].content"), (SYSTEM, Listed("messages", "role", "content"))),
    Layout("conversations", ("conversations[]",), ("system", "conversations[].from", "conversations[].value"), (SYSTEM, Listed("conversations", "from", "value", tuple(SPEAKERS.items())))),
)


def as_record(column: Column | str, kind: T.DataType) -> Column:
    """A JSON text or a struct as a struct of all fields of RECORD."""
    c = F.col(column) if isinstance(column, str) else column
    if not isinstance(kind, T.StructType):
        return F.from_json(c, RECORD)
    has = {f.name for f in kind.fields}
    fields = T._parse_datatype_string(RECORD).fields

    def widened(f: T.StructField) -> Column:
        if f.name not in has:
            return F.lit(None)
        if isinstance(f.dataType, T.ArrayType):
            there = {x.name for x in kind[f.name].dataType.elementType.fields}
            return F.transform(c[f.name], lambda e: F.struct(*((e[x.name] if x.name in there else F.lit(None).cast("string")).alias(x.name) for x in f.dataType.elementType.fields)))
        return c[f.name]

    return F.struct(*(widened(f).cast(f.dataType).alias(f.name) for f in fields))


def _present(r: Column) -> list[tuple[str, Column]]:
    """Every path of RECORD and whether a record has it."""
    has = lambda array, name: F.exists(array, lambda e: e[name].isNotNull())
    found = []
    for f in T._parse_datatype_string(RECORD).fields:
        if isinstance(f.dataType, T.ArrayType):
            found.append((f"{f.name}[]", r[f.name].isNotNull()))
            found += [(f"{f.name}[].{x.name}", has(r[f.name], x.name)) for x in f.dataType.elementType.fields]
        else:
            found.append((f.name, r[f.name].isNotNull()))
    return sorted(found, key=lambda x: x[0])


def fingerprint(record: Column) -> Column:
    """Hash of the sorted nested paths that a record has."""
    return F.xxhash64(F.concat_ws("\n", *(F.when(has, F.lit(path)) for path, has in _present(record))))


def fingerprint_of(paths: tuple[str, ...]) -> Column:
    return F.xxhash64(F.lit("\n".join(paths)))


def layout_of(print_: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Name of the layout whose paths have the fingerprint; null if none."""
    picked = None
    for layout in layouts:
        hit = reduce(or_, (print_ == fingerprint_of(p) for p in layout.path_sets()))
        picked = F.when(hit, layout.name) if picked is None else picked.when(hit, layout.name)
    return picked


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _said(r: Column, part: Said | Listed) -> Column:
    if isinstance(part, Listed):
        def one(e: Column) -> Column:
            role = e[part.role]
            for name, known in part.names:
                role = F.when(e[part.role] == name, known).otherwise(role)
            return _turn(role, e[part.text])

        return F.coalesce(F.transform(r[part.field], one), F.array().cast(TURN))
    texts = F.array_compact(F.array(*(F.nullif(r[f], F.lit("")) if len(part.fields) > 1 else r[f] for f in part.fields)))
    any_ = F.lit(False)
    for f in part.fields:
        any_ = any_ | r[f].isNotNull()
    return F.when(any_, F.array(_turn(F.lit(part.role), F.array_join(texts, "\n\n")))).otherwise(F.array().cast(TURN))


def canonical(records: DataFrame, column: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with `layout` and `turns` (array of role, text) instead of the column."""
    r = F.col("chat_record")
    rows = records.withColumn("chat_record", as_record(column, records.schema[column].dataType)).withColumn("layout", layout_of(fingerprint(r), layouts))
    made = None
    for x in layouts:
        turns = F.concat(*(_said(r, part) for part in x.turns))
        hit = F.col("layout") == x.name
        made = F.when(hit, turns) if made is None else made.when(hit, turns)
    return rows.withColumn("turns", F.coalesce(made, F.array().cast(TURN))).drop("chat_record", column)


# --- template ------------------------------------------------------------------


@dataclass(frozen=True)
class Template:
    """Marks of a turn; they hold no backslash."""

    begin: str = "### "
    colon: str = ": "
    close: str = "</turn>"
    learns: tuple[str, ...] = ("assistant",)

    def _broken(self, control: str) -> str:
        """A control string with a backslash before its second character (and before each that repeats the first)."""
        first = control[0]
        return first + "".join(("\\" + c) if k == 1 or c == first else c for k, c in enumerate(control[1:], 1))

    def escape(self, text: Column, role: bool = False) -> Column:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        for control in (self.close, self.begin, *((self.colon,) if role else ())):
            out = F.replace(out, F.lit(control), F.lit(self._broken(control)))
        return out

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"(?s)\\(.)", "$1")

    @property
    def end(self) -> str:
        return self.close + "\n"


def formatted(turns: Column, template: Template = Template()) -> Column:
    """struct<text, mask>: the formatted text, and the loss mask as runs of (chars, learn), three a turn: mark, text, end."""
    parts = F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(template.begin), template.escape(t["role"], True), F.lit(template.colon)).alias("head"),
            template.escape(t["text"]).alias("body"),
            t["role"].isin(*template.learns).alias("learn"),
        ),
    )
    text = lambda p: F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], F.lit(template.end))), "")
    run = lambda n, learn: F.struct(n.cast("int").alias("chars"), learn.alias("learn"))
    mask = lambda p: F.flatten(F.transform(p, lambda x: F.array(run(F.length(x["head"]), F.lit(False)), run(F.length(x["body"]), x["learn"]), run(F.lit(len(template.end)), F.lit(False)))))
    once = F.transform(F.array(parts), lambda p: F.struct(text(p).alias("text"), mask(p).alias("mask")))  # parts are made once for both
    return F.element_at(once, 1)


def _pieces(text: Column, template: Template) -> Column:
    """The turns of a formatted text, each without its end."""
    return F.filter(F.split(text, "\\Q" + template.end + "\\E", -1), lambda x: x != "")


def parsed(text: Column, template: Template = Template()) -> Column:
    """The turns of a formatted text."""

    def one(p: Column) -> Column:
        body = F.substr(p, F.lit(len(template.begin) + 1))
        at = F.instr(body, template.colon)
        return F.struct(template.unescape(F.substr(body, F.lit(1), at - 1)).alias("role"), template.unescape(F.substr(body, at + len(template.colon))).alias("text"))

    return F.transform(_pieces(text, template), one)


def learnt(text: Column, mask: Column, template: Template = Template()) -> Column:
    """All text under the mask, unescaped, in order."""
    of = lambda p, i: F.when(F.element_at(mask, (3 * i + 2).cast("int"))["learn"], F.substr(p, F.element_at(mask, (3 * i + 1).cast("int"))["chars"] + 1, F.element_at(mask, (3 * i + 2).cast("int"))["chars"])).otherwise("")
    return template.unescape(F.array_join(F.transform(_pieces(text, template), of), ""))


def format_chats(records: DataFrame, column: str, template: Template = Template(), layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with layout, chat (formatted text) and loss_mask instead of the column."""
    made = canonical(records, column, layouts).withColumn("chat_made", formatted(F.col("turns"), template))
    return made.withColumns({"chat": F.col("chat_made.text"), "loss_mask": F.col("chat_made.mask")}).drop("chat_made", "turns")


# --- conversations table --------------------------------------------------------


def records_of(conversations: DataFrame) -> DataFrame:
    """conv_id, record: rows of (conv_id, turn, role, text) as one record each, in the layout that its shape has.

    A user and an assistant make a prompt, with a system text before them an
    instruction; longer ones that begin with a system text are shared
    conversations, all others messages.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    ts = F.col("ts")
    roles = F.transform(F.slice(ts, 1, 4), lambda t: t["role"])
    shape = F.array_join(F.transform(roles, lambda r: F.when(r == "system", "s").when(r == "user", "u").when(r == "assistant", "a").otherwise("x")), "")
    at = lambda k: F.try_element_at(ts, F.lit(k))["text"]
    prompt, told = shape == "ua", shape == "sua"
    shared = ~told & F.startswith(shape, F.lit("s")) & F.forall(ts, lambda t: t["role"].isin("system", "user", "assistant"))
    only = lambda hit, c: F.when(hit, c)
    fields = {
        "system": only(told, at(1)), "prompt": only(prompt, at(1)), "completion": only(prompt, at(2)), "instruction": only(told, at(2)), "output": only(told, at(3)),
        "messages": only(~prompt & ~told & ~shared, F.transform(ts, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))),
        "conversations": only(shared, F.transform(ts, lambda t: F.struct(F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"]).alias("from"), t["text"].alias("value")))),
    }
    return rows.select("conv_id", F.struct(*(c.alias(k) for k, c in fields.items())).alias("record"))
