"""The table schema language: one line a table, NAME|COLUMN:TYPE[:length]|...

Types are INTEGER, DECIMAL, DATE and TEXT:length. A DATE is a yyyymmdd integer key. Names are case-insensitive and kept in
upper case in the text form. INTEGER becomes a 64-bit integer so that sums and keys do not overflow; a TEXT length is kept as column
metadata and limits nothing.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import types as T

TYPES = {"INTEGER": T.LongType(), "DECIMAL": T.DecimalType(18, 2), "DATE": T.IntegerType(), "TEXT": T.StringType()}


class SchemaError(ValueError):
    """A schema text that cannot be read."""


def parse_line(line: str) -> tuple[str, T.StructType]:
    name, *columns = (part.strip() for part in line.strip().strip("|").split("|"))
    if not name or not columns:
        raise SchemaError(f"a table needs a name and columns: {line!r}")
    fields: list[T.StructField] = []
    for column in columns:
        label, *rest = (p.strip() for p in column.split(":"))
        if not rest or not label:
            raise SchemaError(f"{name}: column without type: {column!r}")
        kind = rest[0].upper()
        if kind not in TYPES:
            raise SchemaError(f"{name}.{label}: unknown type {rest[0]!r}")
        meta: dict = {"declared": kind}
        if kind == "TEXT":
            if len(rest) != 2 or not rest[1].isdigit():
                raise SchemaError(f"{name}.{label}: TEXT needs a length")
            meta["len"] = int(rest[1])
        elif len(rest) > 1:
            raise SchemaError(f"{name}.{label}: only TEXT has a length")
        fields.append(T.StructField(label.lower(), TYPES[kind], True, meta))
    if len({f.name for f in fields}) < len(fields):
        raise SchemaError(f"{name}: a column is named twice")
    return name.lower(), T.StructType(fields)


def parse(text: str) -> dict[str, T.StructType]:
    """Tables by lower-case name, in the order given."""
    tables: dict[str, T.StructType] = {}
    for line in text.splitlines():
        if line.strip():
            name, struct = parse_line(line)
            if name in tables:
                raise SchemaError(f"table {name} is declared twice")
            tables[name] = struct
    return tables


def read(path: str | Path) -> dict[str, T.StructType]:
    return parse(Path(path).read_text())


def to_text(tables: dict[str, T.StructType]) -> str:
    """The inverse of parse."""
    back = {T.LongType: "INTEGER", T.IntegerType: "DATE", T.DecimalType: "DECIMAL", T.StringType: "TEXT"}
    lines = []
    for name, struct in tables.items():
        parts = [name.upper()]
        for f in struct:
            kind = f.metadata.get("declared") or back[type(f.dataType)]
            parts.append(f"{f.name.upper()}:{kind}" + (f":{f.metadata.get('len', 255)}" if kind == "TEXT" else ""))
        lines.append("|".join(parts))
    return "\n".join(lines) + "\n"
