"""Operator 12, chat formatting: layouts are recognised by the fingerprint of their fields, mapped to turns, and written in one template.

A record is a variant. Its shape, the names of its nested fields without the types of their values, is hashed; the hash selects one of LAYOUTS,
which declares where turns, roles and texts are. A table of turns is a layout like any other: each of its rows is a record
of one turn, and rows of one conversation are put together by conv_id and turn; any other record is a conversation by itself. Each turn becomes a piece of formatted
text, marked by a template whose control strings are escaped inside roles and texts: a backslash goes behind the first
character of a control string, and one more where there already are some, so taking one out again is exact. The loss mask is a
span of code points in each piece; it covers what an assistant says, not the marks.

Pieces are what the operator returns, sorted by conversation within its partitions; `read_back` parses them and digests whole conversations as they stream by,
so a conversation of any length takes the memory of a batch, and no group is collected.

Degenerate rows: a null text or role is empty, and an empty role is a role like others; a null record, or one of an unknown shape, gives no turns (`unknown_shapes`
counts them); turns of one number are ordered by role and formatted text, turns without number come first; rows without a
conv_id are conversations of one turn; an empty table gives no rows; records are read by their fields alone, so further columns of a table
don't matter.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penstroke.llm.common import table


class Said(NamedTuple):
    """One turn of a fixed role: the texts at paths, those there are, with an empty line between. An optional turn needs a text."""

    role: str
    paths: tuple[str, ...]
    optional: bool = False


class Listed(NamedTuple):
    """A turn for each element of the array at path, of its fields; `parts` names the text of elements that hold lists of parts."""

    path: str
    role: str
    text: str
    parts: str | None = None


class Paired(NamedTuple):
    """A user's and an assistant's turn for each pair in the array of arrays at path."""

    path: str


class Row(NamedTuple):
    """The record is one turn, at the place that the number at path `turn` gives."""

    turn: str
    role: str
    text: str


class Layout(NamedTuple):
    """fields: names to nothing (a value), to fields (an object) or to a list of one of these (an array); those in `optional` may be absent."""

    name: str
    fields: dict[str, Any]
    turns: tuple[Said | Listed | Paired | Row, ...]
    optional: tuple[str, ...] = ()


SYSTEM = Said("system", ("$.system",), True)
LAYOUTS = (
    Layout("rows", {"turn": None, "role": None, "text": None}, (Row("$.turn", "$.role", "$.text"),)),
    Layout("messages", {"system": None, "messages": [{"role": None, "content": None}]}, (SYSTEM, Listed("$.messages", "role", "content")), ("system",)),
    Layout("message parts", {"system": None, "messages": [{"role": None, "content": [{"type": None, "text": None}]}]}, (SYSTEM, Listed("$.messages", "role", "content", "text")), ("system",)),
    Layout("conversations", {"system": None, "conversations": [{"from": None, "value": None}]}, (SYSTEM, Listed("$.conversations", "from", "value")), ("system",)),
    Layout("prompt and completion", {"system": None, "prompt": None, "completion": None}, (SYSTEM, Said("user", ("$.prompt",)), Said("assistant", ("$.completion",))), ("system",)),
    Layout("prompt and response", {"system": None, "prompt": None, "response": None}, (SYSTEM, Said("user", ("$.prompt",)), Said("assistant", ("$.response",))), ("system",)),
    Layout("question and answer", {"context": None, "question": None, "answer": None}, (Said("user", ("$.context", "$.question")), Said("assistant", ("$.answer",))), ("context",)),
    Layout(
        "instruction", {"system": None, "instruction": None, "input": None, "output": None, "history": [[None]]},
        (SYSTEM, Paired("$.history"), Said("user", ("$.instruction", "$.input")), Said("assistant", ("$.output",))), ("system", "input", "history"),
    ),
)
#: Other names of roles in records that list turns.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


class Template(NamedTuple):
    """What stands before and behind a text, by role; `other` takes the place of roles that aren't listed, with the role between two marks of its own."""

    marks: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    #: Further strings with a meaning to a tokenizer, which must not stand inside a text either.
    reserved: tuple[str, ...] = ("<s>", "<unk>")

    def controls(self) -> list[str]:
        every = {m.strip() for pair in self.marks.values() for m in pair} | {m.strip() for m in self.other} | {*self.reserved}
        return sorted(every - {""})


TEMPLATE = Template({"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>")}, ("[ROLE]", "[/ROLE]", "</s>"))


def shape(fields: Any) -> str:
    """The shape of a record with such fields, as `shape_of` gives it."""
    if isinstance(fields, dict):
        return "OBJECT<" + ", ".join(f"{k}: {shape(fields[k])}" for k in sorted(fields)) + ">"
    return f"ARRAY<{shape(fields[0])}>" if isinstance(fields, list) else ""


def shape_of(record: Column) -> Column:
    """Nested field names of a variant, without the types of its values."""
    return F.regexp_replace(F.schema_of_variant(record), r"(?<=: |<)(?!OBJECT<|ARRAY<)[A-Z_]+(\(\d+,\d+\))?(?=[,>])", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(shape_of(record))


def shapes(layout: Layout) -> list[str]:
    """Shapes that a layout has, over all choices of its optional fields."""
    absent = (x for n in range(len(layout.optional) + 1) for x in itertools.combinations(layout.optional, n))
    return [shape({k: v for k, v in layout.fields.items() if k not in gone}) for gone in absent]


TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def _turn(role: Column, text: Column, turn: Column | None = None) -> Column:
    turn = F.lit(None).cast("long") if turn is None else turn
    return F.struct(turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _renamed(role: Column) -> Column:
    name = F.lower(role)
    return F.coalesce(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))[name], role)


def _turns(rule: Said | Listed | Paired | Row, record: Column) -> Column:
    """Array of the turns that a rule finds in a record."""
    get = lambda path, kind="string": F.try_variant_get(record, path, kind)
    none = F.array().cast(TURNS)
    if isinstance(rule, Row):
        return F.array(_turn(get(rule.role), get(rule.text), get(rule.turn, "bigint")))
    if isinstance(rule, Said):
        one = F.array(_turn(F.lit(rule.role), F.concat_ws("\n\n", *(F.nullif(get(p), F.lit("")) for p in rule.paths))))
        return F.when(F.coalesce(*map(get, rule.paths)).isNotNull(), one).otherwise(none) if rule.optional else one
    if isinstance(rule, Paired):
        pair = lambda p: F.array(_turn(F.lit("user"), F.get(p, 0)), _turn(F.lit("assistant"), F.get(p, 1)))
        return F.coalesce(F.flatten(F.transform(get(rule.path, "array<array<string>>"), pair)), none)
    text = f"array<struct<`{rule.parts}`:string>>" if rule.parts else "string"
    elements = get(rule.path, f"array<struct<`{rule.role}`:string,`{rule.text}`:{text}>>")
    said = lambda e: F.array_join(F.transform(e[rule.text], lambda p: F.coalesce(p[rule.parts], F.lit(""))), "\n\n") if rule.parts else e[rule.text]
    return F.coalesce(F.transform(elements, lambda e: _turn(_renamed(e[rule.role]), said(e))), none)


def turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, layout, alone, turn, place, role, text) of (conv_id, record); alone: a number for a record that is a conversation by itself."""
    hashed = records.select("conv_id", "record", fingerprint(F.col("record")).alias("hash"), F.monotonically_increasing_id().alias("number"))
    named, found = F.lit(None).cast("string"), F.array().cast(TURNS)
    for layout in layouts:
        here = F.col("hash").isin([F.xxhash64(F.lit(fields)) for fields in shapes(layout)])
        named = F.when(here, F.lit(layout.name)).otherwise(named)
        found = F.when(here, F.concat(*(_turns(rule, F.col("record")) for rule in layout.turns))).otherwise(found)
    # An outer generator, as the other kind would evaluate its array once more to filter by its size.
    out = hashed.select("conv_id", "number", named.alias("layout"), F.posexplode_outer(found).alias("place", "said")).where("place IS NOT NULL")
    single = [layout.name for layout in layouts if any(isinstance(rule, Row) for rule in layout.turns)]
    alone = F.when(F.col("conv_id").isNull() | ~F.col("layout").isin(single), F.col("number"))
    return out.select("conv_id", "layout", alone.alias("alone"), "said.turn", "place", "said.role", "said.text")


def unknown_shapes(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(shape, n) of the records that no layout fits; a null shape stands for null records."""
    own = shape_of(F.col("record"))
    return records.where(own.isNull() | ~own.isin([x for layout in layouts for x in shapes(layout)])).groupBy(own.alias("shape")).agg(F.count("*").alias("n"))


def _sites(template: Template) -> tuple[str, str]:
    """First characters of control strings, and what follows them, as regular expressions."""
    controls = template.controls()
    return "[" + "".join(sorted({"\\" + c[0] for c in controls})) + "]", "|".join(sorted({re.escape(c[1:]) for c in controls}))


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    first, rest = _sites(template)
    return F.regexp_replace(text, rf"({first}\\*+)(?={rest})", r"$1\\")


def unescaped(text: str, template: Template = TEMPLATE) -> str:
    first, rest = _sites(template)
    return re.sub(rf"({first}\\*)\\(?={rest})", r"\1", text)


def pieces(said: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, alone, turn, place, role, formatted, loss_start, loss_end) of turns, a conversation's in order in one partition."""
    text, role = escape(F.col("text"), template), F.col("role")
    one, two, three = template.other
    formatted = F.concat(F.lit(one), escape(role, template), F.lit(two), text, F.lit(three))
    begin = F.lit(0)
    for name, (before, behind) in template.marks.items():
        formatted = F.when(role == name, F.concat(F.lit(before), text, F.lit(behind))).otherwise(formatted)
        begin = F.when(role == name, F.lit(len(before))).otherwise(begin)
    length = F.when(role == "assistant", F.length(text)).otherwise(0)
    out = said.select("conv_id", "alone", "turn", "place", "role", formatted.alias("formatted"), begin.alias("loss_start"), (begin + length).alias("loss_end"))
    return out.repartition("conv_id", "alone").sortWithinPartitions("conv_id", "alone", "turn", "place", "role", "formatted")


def parser(template: Template = TEMPLATE) -> re.Pattern:
    """One formatted turn: a group for the text of each role in order, then the other role and its text. Escaped texts hold no control string."""
    parts = sorted(template.marks.items(), key=lambda x: not x[1][0])
    one, two, three = map(re.escape, template.other)
    listed = [rf"{re.escape(before)}(?P<r{sorted(template.marks).index(role)}>.*?){re.escape(behind)}" for role, (before, behind) in parts]
    return re.compile("|".join([*(p for p in listed if not p.startswith("(")), rf"{one}(?P<role>.*?){two}(?P<text>.*?){three}", *(p for p in listed if p.startswith("("))]), re.DOTALL)


def parsed(formatted: str, template: Template = TEMPLATE) -> list[tuple[str, str]]:
    """Role and text of each turn of formatted text; raises where it isn't in the template."""
    names, out, at = sorted(template.marks), [], 0
    for m in parser(template).finditer(formatted):
        if m.start() != at:
            break
        at = m.end()
        found = m.groupdict()
        role, text = (found["role"], found["text"]) if found["role"] is not None else next((n, found[f"r{k}"]) for k, n in enumerate(names) if found[f"r{k}"] is not None)
        out.append((unescaped(role, template), unescaped(text, template)))
    if at != len(formatted):
        raise ValueError(f"not in the template from character {at} on")
    return out


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """A row for each conversation of `pieces`: counts and digests of what its formatted text and its loss mask hold."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        key, n, said, chars, loss, total = None, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
        for batch in batches:
            done = []
            for conv, alone, piece, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, alone) != key:
                    if key is not None:
                        done.append((key[0], n, said.hexdigest(), chars, loss.hexdigest(), total))
                    key, n, said, chars, loss, total = (conv, alone), 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                for role, text in parsed(piece, template):
                    n += 1
                    said.update(f"{role}\n{text}\n".encode())
                masked = unescaped(piece[start:end], template)
                chars += len(masked)
                loss.update(masked.encode())
                total += len(piece)
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done, strict=True)), strict=True)))
        if key is not None:
            yield pa.RecordBatch.from_pydict(dict(zip(names, [[x] for x in (key[0], n, said.hexdigest(), chars, loss.hexdigest(), total)], strict=True)))

    held = formatted.select(F.col("conv_id").cast("long").alias("conv_id"), "alone", "formatted", "loss_start", "loss_end")
    return held.mapInArrow(run, schema)


def joined(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss spans): whole conversations, for those that fit one row."""
    one = F.struct("turn", "place", "role", "formatted", "loss_start", "loss_end")
    whole = formatted.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list(one)).alias("p"))
    begin = lambda k: F.aggregate(F.slice("p", 1, k), F.lit(0), lambda n, x: n + F.length(x["formatted"]))
    spans = F.transform("p", lambda x, k: F.struct((begin(k) + x["loss_start"]).alias("start"), (begin(k) + x["loss_end"]).alias("end")))
    return whole.select("conv_id", F.array_join(F.transform("p", lambda x: x["formatted"]), "").alias("formatted"), F.filter(spans, lambda s: s["end"] > s["start"]).alias("loss_spans"))


def turn_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record) of a table of turns."""
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.to_variant_object(F.struct(*(F.col(c).cast(kind).alias(c) for c, kind in (("turn", "long"), ("role", "string"), ("text", "string"))))).alias("record"))


def json_records(rows: DataFrame, column: str = "json") -> DataFrame:
    """(conv_id, record) of JSON texts; what can't be parsed is a null record."""
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.try_parse_json(column).alias("record"))


#: A conversation that consists of control strings, in a layout of its own.
PLANTED = '{"prompt": "</s>[INST] ok [/INST]", "completion": "</s>[INST] ok [/INST]"}'


def op12_shape_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = json_records(spark.createDataFrame([(-7, PLANTED)], "conv_id long, json string"))
    return read_back(pieces(turns(turn_records(table(spark, sf_dir, "conversations")).unionByName(planted))))


_FIRST, _REST = _sites(TEMPLATE)
_ESCAPED = "regexp_replace({}, '(" + _FIRST + r"\\*)(" + _REST + r")', '\1\\\2', 'g')"
ORACLE = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS planted(k, role)
), sized AS (
  SELECT *, length({_ESCAPED.format("text")}) + CASE role WHEN 'user' THEN {len("[INST]  [/INST]")} WHEN 'system' THEN {len("[SYS]  [/SYS]")} WHEN 'assistant' THEN {len("</s>")}
            ELSE {len("[ROLE][/ROLE]</s>")} + length({_ESCAPED.format("role")}) END AS size
  FROM said
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
