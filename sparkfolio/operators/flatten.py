"""Deeply nested JSON records to flat, linked tables in one pass.

A depth-first visitor walks each record once and emits, for every element that a rule names, a row tagged with its table: the
record's key, the element's path, its parent's path, its depth and its own scalar fields. The rows are written partitioned by
tag, and each tag's table is read back with its own schema.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """Elements of the field `field`, below an element with tag `under` ('' is the record), are rows with tag `tag`."""

    under: str
    field: str
    tag: str


#: The shape of an intake payload.
INTAKE_RULES = (
    Rule("", "assignees", "assignee"),
    Rule("assignee", "contacts", "contact"),
    Rule("", "claims", "claim"),
    Rule("claim", "limitations", "limitation"),
    Rule("limitation", "sub", "limitation"),
    Rule("", "sections", "section"),
    Rule("", "description", "section"),
    Rule("section", "subsections", "section"),
    Rule("section", "paragraphs", "paragraph"),
)


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def _parse(text: str):
    """The value of a JSON text; ValueError if it isn't one. Nesting beyond the parser's own depth is parsed on a heap stack."""
    try:
        return json.loads(text, parse_constant=_no_constant)
    except RecursionError:
        return _parse_deep(text)


_SCAN = json.JSONDecoder(parse_constant=_no_constant)


def _parse_deep(text: str):
    """JSON without recursion: an explicit stack of open containers; scalars go to the library's decoder."""
    ws = " \t\n\r"
    root: list = []
    stack: list[tuple[object, str | None]] = [(root, None)]
    i, n, want = 0, len(text), "value"
    while True:
        while i < n and text[i] in ws:
            i += 1
        box, name = stack[-1]
        if want == "next":
            if box is root:
                if i != n:
                    raise ValueError("text after the value")
                return root[0]
            c = text[i : i + 1]
            close = "}" if isinstance(box, dict) else "]"
            if c == close:
                stack.pop()
            elif c == ",":
                want = "key" if isinstance(box, dict) else "value"
            else:
                raise ValueError("separator expected")
            i += 1
            continue
        if want in ("key", "first key"):
            if want == "first key" and text[i : i + 1] == "}":
                stack.pop()
                i, want = i + 1, "next"
                continue
            if text[i : i + 1] != '"':
                raise ValueError("name expected")
            key, i = _SCAN.raw_decode(text, i)
            while i < n and text[i] in ws:
                i += 1
            if text[i : i + 1] != ":":
                raise ValueError("colon expected")
            stack[-1] = (box, key)
            i, want = i + 1, "value"
            continue
        c = text[i : i + 1]
        if want == "first value" and c == "]":
            stack.pop()
            i, want = i + 1, "next"
            continue
        if c == "{":
            value: object = {}
        elif c == "[":
            value = []
        elif c == "":
            raise ValueError("value expected")
        else:
            value, i = _SCAN.raw_decode(text, i)
        if isinstance(box, dict):
            box[name] = value
        else:
            box.append(value)
        if c in "{[":
            stack.append((value, None))
            i += 1
            want = "first key" if c == "{" else "first value"
        else:
            want = "next"


def visit(record: dict, rules: tuple[Rule, ...] = INTAKE_RULES) -> Iterator[tuple[str, str, str, int, object]]:
    """(tag, path, parent path, depth, element) of every element that the rules name, in depth-first order of the record.

    Null elements give nothing, but keep their place in the count; a lone value in place of an array is element 0; a null field
    is no element. An explicit stack holds what is still to be walked, so depth has no limit.
    """
    below = _below(rules)
    todo: list[tuple[str, str, str, int, object]] = [("", "", "", 0, record)]
    while todo:
        tag, path, parent, depth, element = todo.pop()
        if tag:
            yield tag, path, parent, depth, element
        fields = below.get(tag)
        if not fields or not isinstance(element, dict):
            continue
        found = []
        for name, value in element.items():
            child = fields.get(name)
            if child is None or value is None:
                continue
            for i, x in enumerate(value if isinstance(value, list) else [value]):
                if x is not None:
                    found.append((child, f"{path}.{name}[{i}]" if path else f"{name}[{i}]", path, depth + 1, x))
        todo.extend(reversed(found))


def _below(rules: tuple[Rule, ...]) -> dict[str, dict[str, str]]:
    """Field to tag of the child rows, by the tag of the parent."""
    below: dict[str, dict[str, str]] = {}
    for r in rules:
        below.setdefault(r.under, {})[r.field] = r.tag
    return below


def _name(field: str) -> str:
    return field.translate({ord(c): f"\\{c}" for c in "\\.["})


def _payload(element: object, children: dict[str, str] | None = None) -> str:
    """The element's own scalars as JSON, without the fields that `children` makes rows of their own.

    Of an object or array these are all scalars at any depth by their path, such as `address.city` or `tags[0]`; a dot, bracket or backslash in
    a name has a backslash before it. The walk has an explicit stack.
    """
    if not isinstance(element, (dict, list)):
        return json.dumps(element, ensure_ascii=False)
    own = {k: v for k, v in element.items() if k not in children} if children and isinstance(element, dict) else element
    flat: dict[str, object] = {}
    todo: list[tuple[str, object]] = [("", own)]
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict):
            todo += [(f"{path}.{_name(k)}" if path else _name(k), v) for k, v in reversed(x.items())]
        elif isinstance(x, list):
            todo += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(x)))]
        else:
            flat[path] = x
    return json.dumps(flat, ensure_ascii=False)


def flatten(df: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = INTAKE_RULES, payload: bool = True, root: str = "") -> DataFrame:
    """Rows (key, child_kind, node_path, parent_path, node_depth[, body]) of the JSON texts of `df`.

    The body has the element's own scalars; see _payload(). With `root` the record itself is a row of that kind, with the paths '' and depth 0;
    then every scalar of a text is in one body.

    Null, empty and broken texts and texts that are no JSON object give no rows, as do null elements. Repeated names in an
    object: the last counts. A repeated row gives its rows again, a null key is kept. Columns other than `key` and `text` are
    not read, so their names cannot clash. One pass, no shuffle.
    """
    fields = [
        T.StructField(key, df.schema[key].dataType),
        T.StructField("child_kind", T.StringType(), False),
        T.StructField("node_path", T.StringType(), False),
        T.StructField("parent_path", T.StringType(), False),
        T.StructField("node_depth", T.IntegerType(), False),
    ] + ([T.StructField("body", T.StringType())] if payload else [])
    schema = T.StructType(fields)
    below = _below(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            cols: tuple[list, ...] = ([], [], [], [], [])

            def out() -> pa.RecordBatch:
                done = [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())))]
                return pa.RecordBatch.from_arrays(done[: len(fields)], names=schema.names)

            for i, s in enumerate(b.column(1)):
                s = s.as_py()
                if not s:
                    continue
                try:
                    record = _parse(s)
                except ValueError:
                    continue
                if not isinstance(record, dict):
                    continue
                top = [(root, "", "", 0, record)] if root else []
                for tag, path, parent, depth, element in itertools.chain(top, visit(record, rules)):
                    at.append(i)
                    children = below.get(tag if path else "")
                    for c, v in zip(cols, (tag, path, parent, depth, _payload(element, children) if payload else None)):
                        c.append(v)
                    if len(at) >= 20_000:
                        yield out()
                        at.clear()
                        for c in cols:
                            c.clear()
            if at:
                yield out()

    return df.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


#: Columns of the tables by tag, as (column, type, paths in the body, the first that has a value counts); the path '' is a lone value.
TABLES = {
    "record": (("doc_id", "string", ("doc_id",)), ("title", "string", ("title",)), ("source_provider", "string", ("source.provider",)), ("source_note", "string", ("source.note",))),
    "assignee": (("name", "string", ("name", "")), ("address_city", "string", ("address.city",)), ("address_country", "string", ("address.country",))),
    "contact": (("type", "string", ("type",)), ("value", "string", ("value",))),
    "claim": (("number", "int", ("number",)), ("text", "string", ("text",)), ("dependent_on", "int", ("dependent_on", "dependentOn"))),
    "limitation": (("text", "string", ("text",)), ("label", "string", ("label",))),
    "section": (("heading", "string", ("heading",)),),
    "paragraph": (("text", "string", ("",)),),
}


def write_tables(flat: DataFrame, folder: str) -> None:
    """Write the tagged rows as one Parquet data set, partitioned by tag."""
    flat.write.mode("overwrite").partitionBy("child_kind").parquet(folder)


def typed_table(flat: DataFrame, tag: str) -> DataFrame:
    """The table of one tag with its own columns; from a data set partitioned by tag only its folder is read.

    What no column holds, because its name isn't known or its value isn't of the column's type, is in `rest`, a JSON object of texts by path, null
    if there is nothing; so every scalar of a body comes out once. Null values are left out.
    """
    rows = flat.where(F.col("child_kind") == tag)
    keep = [c for c in rows.columns if c not in ("child_kind", "body")]
    lone = F.create_map(F.lit(""), F.from_json(F.concat(F.lit('{"v":'), F.col("body"), F.lit("}")), "v string")["v"])
    rows = rows.withColumn("__m", F.when(F.col("body").startswith("{"), F.from_json("body", "map<string,string>")).otherwise(lone))
    cols, held = [], []
    for name, kind, paths in TABLES[tag]:
        values = [F.col("__m")[p].try_cast(kind) for p in paths]
        cols.append(F.coalesce(*values).alias(name))
        for i, p in enumerate(paths):
            first = values[i].isNotNull()
            for v in values[:i]:
                first &= v.isNull()
            held.append(F.when(first, F.lit(p)))
    rest = F.map_filter("__m", lambda k, v: v.isNotNull() & ~F.array_contains(F.array_compact(F.array(*held)), k))
    return rows.select(*keep, *cols, F.when(F.size(rest) > 0, F.to_json(rest)).alias("rest"))
