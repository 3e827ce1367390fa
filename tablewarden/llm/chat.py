"""Chat formatting, by native expressions only.

A record's layout is the set of nested field paths that hold a value in it. Its fingerprint, a hash of
the sorted paths, selects one of the declared mappings, each of which says where turns come from;
records of any mix of layouts become canonical turns (role, text) in one pass over a merged schema.

The template marks turns as `<|role|>text</s>`. Control strings inside roles and texts are broken up by a
backslash after their first character, and backslashes are doubled, so formatting can be undone.
With the text comes the loss mask: per turn, the characters to skip, to learn from, and to skip again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewarden.llm.rows import column

CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]")
_BREAK = r"(<(?=\||/?s>)|\|(?=>)|\[(?=/?INST\]))"
END = "</s>"
LEARNED = "assistant"


@dataclass(frozen=True)
class Mapping:
    """`paths` every record of the layout has, `optional` ones it may have, and its turns: pairs of a
    role and a field, in order, or the name of an array with the fields of role and text."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    array: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def layouts(self) -> list[tuple[str, ...]]:
        found = []
        for n in range(len(self.optional) + 1):
            found += [tuple(sorted({*self.paths, *more})) for more in combinations(self.optional, n)]
        return found


MAPPINGS = (
    Mapping("rows", ("turns[].turn", "turns[].role", "turns[].text"), array=("turns", "role", "text")),
    Mapping("messages", ("messages[].role", "messages[].content"), array=("messages", "role", "content")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), array=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Mapping("prompt", ("prompt", "completion"), (("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping("instruction", ("instruction", "output"), (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input", "system")),
    Mapping("question", ("question", "answer"), (("user", "question"), ("assistant", "answer"))),
)


def fingerprint_of(paths: tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _paths(kind: T.DataType, path: str, value: Column) -> list[tuple[str, Column]]:
    """Each leaf path below a field with a condition for its having a value in a record."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _paths(f.dataType, f"{path}.{f.name}" if path else f.name, value.getField(f.name))]
    if isinstance(kind, T.ArrayType):
        if not isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            return [(f"{path}[]", F.exists(value, lambda x: x.isNotNull()))]
        # names of leaves do not depend on the element, conditions do
        names = [name for name, _ in _paths(kind.elementType, "", F.lit(None))]

        def present(i: int) -> Callable[[Column], Column]:
            return lambda x: _paths(kind.elementType, "", x)[i][1]

        return [(f"{path}[].{n}", F.exists(value, present(i))) for i, n in enumerate(names)]
    return [(path, value.isNotNull())]


def fingerprint(records: DataFrame, columns: list[str]) -> Column:
    """The layout fingerprint of each record, over the given columns."""
    found = [p for c in columns for p in _paths(records.schema[c].dataType, c, column(c))]
    named = F.array(*[F.when(F.coalesce(present, F.lit(False)), F.lit(name)) for name, present in sorted(found, key=lambda p: p[0])])
    return F.sha2(F.concat_ws("\n", named), 256)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _element(mapping: Mapping) -> Callable[[Column], Column]:
    """Makes a turn of an element of the mapping's array."""
    _, role_field, text_field = mapping.array

    def turn(element: Column) -> Column:
        role = element.getField(role_field)
        for old, new in mapping.roles.items():
            role = F.when(element.getField(role_field) == old, new).otherwise(role)
        return _turn(role, element.getField(text_field))

    return turn


def canonical(records: DataFrame, id_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The id, the mapping's name, and the canonical turns of each record.

    Columns that no mapping names are ignored. A field that is null counts as absent, a null in an
    array of turns is an empty role or text as long as another turn has a value. Records of unknown
    layout, also empty ones, have a null mapping and null turns; nothing is dropped. An array's turns
    keep their order.
    """
    known = {path.split("[")[0].split(".")[0] for m in mappings for path in (*m.paths, *m.optional)}
    columns = [c for c in records.columns if c in known and c != id_col]
    rows = records.withColumn("_layout", fingerprint(records, columns) if columns else F.lit(None).cast("string"))
    name = turns = None
    for mapping in mappings:
        needs = {p.split("[")[0] for p in mapping.paths}
        if not needs <= set(columns):
            continue
        layouts = [layout for layout in mapping.layouts() if {p.split("[")[0] for p in layout} <= set(columns)]
        match = F.col("_layout").isin([fingerprint_of(layout) for layout in layouts])
        if mapping.array:
            made = F.transform(F.col(mapping.array[0]), _element(mapping))
        else:
            parts = [F.when(F.col(c).isNotNull(), _turn(F.lit(r), F.col(c))) for r, c in mapping.turns if c in columns]
            made = F.array_compact(F.array(*parts))
        name = F.when(match, mapping.name) if name is None else name.when(match, mapping.name)
        turns = F.when(match, made) if turns is None else turns.when(match, made)
    if name is None:
        name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role: string, text: string>>")
    return rows.select(F.col(id_col), name.alias("mapping"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _BREAK, "$1\\\\")


def unescaped(text: Column) -> Column:
    """The inverse: a backslash goes, and one that follows it stays."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def formatted(records: DataFrame, id_col: str) -> DataFrame:
    """Adds `formatted`, the text, and `loss`, per turn the code points (head, learned, tail)."""
    head = lambda t: F.concat(F.lit("<|"), escaped(t.role), F.lit("|>"))
    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escaped(t.text).alias("body"), (t.role == LEARNED).alias("learned")))
    rows = records.select("*", parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p.head, p.body, F.lit(END))), "")
    loss = F.transform(
        "parts",
        lambda p: F.struct(
            (F.length(p.head) + F.when(p.learned, 0).otherwise(F.length(p.body))).alias("head"),
            F.when(p.learned, F.length(p.body)).otherwise(0).alias("learned"),
            F.lit(len(END)).alias("tail"),
        ),
    )
    return rows.select(*records.columns, text.alias("formatted"), loss.alias("loss"))


def read_back(rows: DataFrame) -> DataFrame:
    """Adds `turns_back`, the turns, and `learned_back`, the text under the loss mask, from `formatted` and
    `loss` alone. A control string never stands unbroken inside a turn, so ends can be split at."""
    pieces = F.slice(F.split("formatted", F.lit(END)), F.lit(1), F.size("loss"))
    turn = lambda p: F.struct(
        unescaped(F.substring_index(F.substring(p, F.lit(3), F.length(p)), "|>", 1)).alias("role"),
        unescaped(F.substring(p, F.locate("|>", p) + 2, F.length(p))).alias("text"),
    )
    learned = F.zip_with(pieces, "loss", lambda p, s: unescaped(F.substring(p, s["head"] + 1, s.learned)))
    return rows.select("*", F.transform(pieces, turn).alias("turns_back"), F.array_join(learned, "").alias("learned_back"))


def from_rows(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Records of the layout `rows` from a table with a row per turn. Turns go by number, a null number
    first, equal ones by role, then text; null texts and roles are empty."""
    turn = F.struct(
        column(turn_col).cast("long").alias("turn"), F.coalesce(column(role_col), F.lit("")).alias("role"), F.coalesce(column(text_col), F.lit("")).alias("text")
    )
    ordered = F.sort_array(F.collect_list(turn))
    numbered = F.transform(ordered, lambda t, i: F.struct(i.alias("turn"), t.role.alias("role"), t.text.alias("text")))
    return turns.groupBy(column(id_col).alias("conv_id")).agg(numbered.alias("turns"))


def digests(records: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Formats records and returns, read back from the output: conv_id, mapping, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. A record of unknown layout has nulls."""
    rows = read_back(formatted(canonical(records, id_col), id_col))
    listed = F.array_join(F.transform("turns_back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return rows.select(
        F.col(id_col).alias("conv_id"),
        "mapping",
        F.size("turns_back").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("learned_back").cast("long").alias("loss_chars"),
        F.sha2("learned_back", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
