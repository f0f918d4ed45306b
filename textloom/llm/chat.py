"""Chat formatting by schema fingerprints.

Records come as typed columns or as JSON texts of mixed layouts. Each nested field path of a record (such as ``messages[].role``) is hashed;
a declared mapping applies to the records that hold the hashes of all its paths, whatever other fields they have, and of several the one with most paths. It
turns the record into canonical turns (role, text). The turns of a conversation are then written with one template:

    <|turn|>role<|text|>text<|end|>\\n

Control strings inside roles and texts are escaped reversibly: a backslash is doubled, and one is put behind the first
character of each control string of this and other common templates, so that none of them survives. The loss mask
covers the (escaped) texts of the roles that are learned, and nothing else.

Records that no mapping fits are counted with their conversation and listed by ``unmapped``; none goes unnoticed.

DataFrame functions only. The one shuffle deals rows by conversation; as a conversation becomes one row,
it must fit in memory, however the rest is distributed. Rows without an id are conversations of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from textloom.llm._common import free_name

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: First characters of control strings: this template's, and those of the templates with <s>, [INST] and <<SYS>>.
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"
#: Kinds of values in a layout; they don't count as paths.
KINDS = r"(?:STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|DATE|BINARY|UUID|TIMESTAMP(?:_NTZ)?|DECIMAL\(\d+, ?\d+\))"
#: Names of roles, in any case, and what they become; other roles stay as they are.
ROLES = {"user": "user", "human": "user", "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "model": "assistant", "system": "system"}


@dataclass(frozen=True)
class Mapping:
    """How records with certain fields become turns.

    ``turns``: pairs of a fixed role and the fields whose texts it says (blank ones left out, joined by an empty line).
    ``each``: instead, the list field, its role field and its text field; an empty list field means that the record itself is one turn.
    """

    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: tuple[str, str, str] | None = None

    @property
    def paths(self) -> tuple[str, ...]:
        """The field paths that a record must have."""
        if self.each is None:
            return tuple(sorted({f for _, fields in self.turns for f in fields}))
        field, role, text = self.each
        return (role, text) if not field else (field, f"{field}[].{role}", f"{field}[].{text}")


MAPPINGS: tuple[Mapping, ...] = (
    *(Mapping(each=("", r, t)) for r, t in (("role", "text"), ("role", "content"), ("from", "value"), ("speaker", "text"))),
    *(Mapping(each=e) for e in (("messages", "role", "content"), ("turns", "role", "text"), ("conversations", "from", "value"))),
    *(Mapping((("user", ("prompt",)), ("assistant", (a,)))) for a in ("response", "completion", "answer")),
    Mapping((("user", ("question",)), ("assistant", ("answer",)))),
    Mapping((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping((("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping((("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping((("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
)

TURNS = "array<struct<role: string, text: string>>"


def fingerprint(path: str) -> int:
    """The hash of a path, the same as Spark's xxhash64."""
    value = xxhash.xxh64_intdigest(path.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def ranked(mappings: tuple[Mapping, ...]) -> list[Mapping]:
    """Those with most paths first, else in their order."""
    return sorted(mappings, key=lambda m: -len(m.paths))


def path_hashes(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Hashes of those of the mappings' paths that a record (a variant) has. A path into a list counts if all elements have it."""

    def held(path: str) -> Column:
        field, _, inner = path.partition("[].")
        if not inner:
            return F.try_variant_get(record, f"$.{field}", "variant").isNotNull()
        return F.forall(F.try_variant_get(record, f"$.{field}", "array<variant>"), lambda x: F.try_variant_get(x, f"$.{inner}", "variant").isNotNull())

    paths = sorted({p for m in mappings for p in m.paths})
    return F.filter(F.array(*(F.when(held(p), F.lit(fingerprint(p)).cast("bigint")) for p in paths)), lambda h: h.isNotNull())


def _typed_paths(kind: T.DataType, at: str = "") -> set[str]:
    out: set[str] = set()
    if isinstance(kind, T.ArrayType):
        return _typed_paths(kind.elementType, at + "[]")
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            path = f"{at}.{f.name}" if at else f.name
            out |= {path} | _typed_paths(f.dataType, path)
    return out


def _skeleton(record: Column, kind: T.StructType, paths: set[str]) -> Column:
    """The fields of a typed record among ``paths``, as a variant without their texts, which may be longer than a variant holds."""

    def part(value: Column, kind: T.DataType, at: str) -> Column:
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: part(x, kind.elementType, at + "[]"))
        inner = [(f, f"{at}.{f.name}" if at else f.name) for f in kind.fields] if isinstance(kind, T.StructType) else []
        kept = [part(value[f.name], f.dataType, path).alias(f.name) for f, path in inner if path in paths]
        return F.struct(*kept) if kept else value.isNotNull()

    return F.when(record.isNotNull(), F.to_variant_object(part(record, kind, "")))


def json_layout(record: Column) -> Column:
    """All nested field names of each JSON text, without the kinds of values; null for what isn't JSON."""
    kinds = F.schema_of_variant(F.try_parse_json(record))
    return F.regexp_replace(F.regexp_replace(kinds, rf": {KINDS}(?=[,>])", ""), rf"(?<=<){KINDS}(?=>)|^{KINDS}$", "")


def _role(role: Column, roles: dict[str, str]) -> Column:
    name = F.lower(F.trim(role))
    return F.coalesce(*(F.when(name == k, F.lit(v)) for k, v in roles.items()), role, F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(mapping: Mapping, record: Column, typed: bool, roles: dict[str, str]) -> Column:
    """The turns of a record that the mapping fits."""

    def value(name: str) -> Column:
        return record[name].cast("string") if typed else F.try_variant_get(record, f"$.{name}", "string")

    if mapping.each:
        field, role, text = mapping.each
        if not field:
            return F.array(_turn(_role(value(role), roles), value(text)))
        items = record[field] if typed else F.try_variant_get(record, f"$.{field}", "array<variant>")
        inner = lambda x, name: x[name].cast("string") if typed else F.try_variant_get(x, f"$.{name}", "string")
        return F.transform(items, lambda x: _turn(_role(inner(x, role), roles), inner(x, text)))
    said = [_turn(F.lit(role), F.array_join(F.filter(F.array(*map(value, fields)), lambda x: F.trim(x) != ""), "\n\n")) for role, fields in mapping.turns]
    parts = [F.when(F.lit(role != "system") | (turn["text"] != ""), turn) for (role, _), turn in zip(mapping.turns, said, strict=True)]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def canonical(df: DataFrame, record: str, name: str = "turns", mappings: tuple[Mapping, ...] = MAPPINGS, roles: dict[str, str] | None = None) -> DataFrame:
    """``df`` with its records' turns appended: an array of (role, text), null for records that no mapping fits and for what isn't JSON.

    ``record``: a column of JSON text, or a struct. ``roles``: names of roles and what they become (``ROLES``; with ``{}`` all stay). Null roles and texts become empty;
    long ones are kept whole. ``name`` gets an underscore if ``df`` has it. Rows are independent; an empty table gives an empty result.
    """
    roles = ROLES if roles is None else roles
    kind, own = df.schema[record].dataType, free_name(df, name)
    parsed, hashes = free_name(df, "parsed"), free_name(df, "path_hashes")
    typed = isinstance(kind, T.StructType)
    usable = [m for m in mappings if not typed or set(m.paths) <= _typed_paths(kind)]
    if not usable:
        return df.withColumn(own, F.lit(None).cast(TURNS))
    whole = _skeleton(F.col(record), kind, {p for m in usable for p in m.paths}) if typed else F.try_parse_json(F.col(record))
    out = df.withColumn(parsed, whole).withColumn(hashes, path_hashes(F.col(parsed), tuple(usable)))
    turns = F.lit(None).cast(TURNS)
    for m in reversed(ranked(tuple(usable))):
        fits = F.size(F.array_except(F.lit([fingerprint(p) for p in m.paths]).cast("array<bigint>"), hashes)) == 0
        turns = F.when(fits, _turns(m, F.col(record if typed else parsed), typed, roles)).otherwise(turns)
    return out.withColumn(own, turns).drop(parsed, hashes)


def unmapped(df: DataFrame, record: str, turns: str = "turns") -> DataFrame:
    """What ``canonical`` left without turns, by layout: (layout, n). Records that aren't JSON have a null layout; typed ones have one layout, their schema's."""
    lost = df.where(F.col(turns).isNull())
    kind = df.schema[record].dataType
    layout = F.when(F.col(record).isNotNull(), F.lit(", ".join(sorted(_typed_paths(kind))))) if isinstance(kind, T.StructType) else json_layout(F.col(record))
    return lost.groupBy(layout.alias("layout")).agg(F.count(F.lit(1)).alias("n"))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(df: DataFrame, id_col: str, turns: str, order: list[str], learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: id, formatted, loss_spans (start, end in code points of formatted), segments (text, loss), unmapped (records without turns).

    ``df`` holds a conversation's turns in one row or in several, which ``order`` sorts (nulls first; ties by place in the record, role and text, so repeated rows
    are repeated turns). The segments, joined, are the formatted text; those with loss set are what the spans cover. A conversation without turns has an empty text. A row
    with a null id is a conversation of its own. Other columns aren't read; an empty table gives an empty result.
    """
    lost = F.col(turns).isNull().cast("bigint").alias("lost")
    alone = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).alias("alone")
    rows = df.select(F.col(id_col).alias("id"), alone, *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), lost, F.col(turns).alias("turns"))
    said = rows.select("*", F.posexplode_outer("turns").alias("at", "t")).drop("turns")
    head = F.concat(F.lit(TURN), escape(F.col("t.role")), F.lit(TEXT))
    parts = said.select("*", head.alias("head"), escape(F.col("t.text")).alias("body"), F.col("t.role").isin(*learned).alias("loss"))
    sort = [f"o{i}" for i in range(len(order))]
    by = Window.partitionBy("id", "alone").orderBy(*sort, "at", "t.role", "t.text")
    size = F.coalesce(F.length("head") + F.length("body") + len(END), F.lit(0))
    placed = parts.select("id", "alone", "lost", "head", "body", "loss", F.row_number().over(by).alias("n"), (F.sum(size.cast("bigint")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.length("body") - len(END)).alias("start"))
    row = F.when(F.col("head").isNotNull(), F.struct("n", "start", (F.col("start") + F.length("body")).alias("end"), "loss", "head", "body"))
    whole = placed.groupBy("id", "alone").agg(F.array_sort(F.collect_list(row)).alias("all"), F.sum("lost").alias("unmapped"))
    pieces = F.flatten(F.transform("all", lambda x: F.array(F.struct(x["head"].alias("text"), F.lit(False).alias("loss")), F.struct(x["body"].alias("text"), x["loss"].alias("loss")), F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))))
    spans = F.transform(F.filter("all", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    cut = whole.select(F.col("id").alias(id_col), pieces.alias("segments"), spans.alias("loss_spans"), "unmapped")
    return cut.select(id_col, F.array_join("segments.text", "").alias("formatted"), "loss_spans", "segments", "unmapped")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text), unescaped."""
    cut = F.split(formatted, r"<\|turn\|>")
    parts = F.slice(cut, F.lit(2), F.size(cut))
    pair = lambda x: F.split(F.substring_index(x, END, 1), r"<\|text\|>")
    return F.transform(F.transform(parts, pair), lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def learned_text(segments: str) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda x: x["loss"]), lambda x: x["text"]), ""))
