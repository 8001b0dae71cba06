"""Exports: one file per call for results of a bounded size; export_folder() has every task write its part of a DataFrame."""

from __future__ import annotations

import csv
import dataclasses
import json
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import Registry

writers = Registry("export format")
#: Characters of a cell of a Markdown table.
CELL = 160


def register_export(suffix: str, writer: Callable[[Iterable[dict], Path], None]) -> None:
    writers.register(suffix if suffix.startswith(".") else f".{suffix}", writer)


def plain(value):
    """Sets as sorted lists, tuples as lists, rows and records as dicts, all the way down."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    match value:
        case dict():
            return {k: plain(v) for k, v in value.items()}
        case set() | frozenset():
            return list(map(plain, sorted(value)))
        case list() | tuple():
            return list(map(plain, value))
    return value


def as_record(item) -> dict:
    """What an object says of itself: its own dict, a row, a dataclass or a dict."""
    for known, to in ((lambda x: hasattr(x, "to_dict"), lambda x: x.to_dict()), (lambda x: isinstance(x, dict) or hasattr(x, "asDict"), lambda x: x), (dataclasses.is_dataclass, dataclasses.asdict)):
        if not isinstance(item, type) and known(item):
            return plain(to(item))
    raise TypeError(f"Cannot export {type(item).__name__}")


def to_records(items) -> Iterator[dict]:
    """Records of a DataFrame, row by row, of one object, or of many."""
    if isinstance(items, DataFrame):
        items = items.toLocalIterator()
    elif isinstance(items, dict) or hasattr(items, "to_dict"):
        items = [items]
    return map(as_record, items)


def _json(rows: Iterable[dict], path: Path) -> None:
    with path.open("w", encoding="utf-8") as out:
        lead = "["
        for r in rows:
            out.write(f"{lead}\n  " + json.dumps(r, ensure_ascii=False, indent=2).replace("\n", "\n  "))
            lead = ","
        out.write("[]" if lead == "[" else "\n]")


def _jsonl(rows: Iterable[dict], path: Path) -> None:
    with path.open("w", encoding="utf-8") as out:
        out.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)


@contextmanager
def _table(rows: Iterable[dict]) -> Iterator[tuple[list[str], Iterator[list]]]:
    """The names of all rows in the order of their first use, and the cells; rows wait in a file until all names are known."""
    names: dict[str, None] = {}
    cell = lambda v: "" if v is None else json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else v
    with tempfile.TemporaryFile() as held:
        n = 0
        for r in rows:
            names.update(dict.fromkeys(r))
            pickle.dump(r, held)
            n += 1
        held.seek(0)
        yield list(names), ([cell(r.get(k)) for k in names] for r in (pickle.load(held) for _ in range(n)))


def _csv(rows: Iterable[dict], path: Path) -> None:
    with _table(rows) as (names, cells), path.open("w", encoding="utf-8-sig", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(names)
        writer.writerows(cells)


def _markdown(rows: Iterable[dict], path: Path) -> None:
    def short(v) -> str:
        s = str(v).translate({ord("|"): "\\|", ord("\n"): " "})
        return s if len(s) < CELL + 1 else f"{s[: CELL - 3]}…"

    with _table(rows) as (names, cells), path.open("w", encoding="utf-8") as out:
        for line in chain([names, ["---"] * len(names)], (map(short, c) for c in cells)):
            out.write(f"| {' | '.join(line)} |\n")


for _suffix, _writer in ((".json", _json), (".jsonl", _jsonl), (".csv", _csv), (".md", _markdown)):
    register_export(_suffix, _writer)


def export(items, path: str | Path, format: str | None = None) -> Path:
    """Write a DataFrame, records or objects to one file whose format the suffix or ``format`` tells."""
    path = Path(path)
    suffix = (f".{format.lstrip('.')}" if format else path.suffix).lower()
    if suffix not in writers:
        raise ValueError(f"no writer for {suffix!r}; available: {writers.names()}")
    path.parent.mkdir(parents=True, exist_ok=True)
    writers.get(suffix)(to_records(items), path)
    return path


def _cell(c: Column, kind: str) -> Column:
    """A value for a table without nesting: structs, arrays and maps as JSON."""
    return F.to_json(c) if kind in ("struct", "array", "map") else c.cast("string")


def export_folder(df: DataFrame, path: str, format: str | None = None) -> str:
    """``df`` as a folder of JSON Lines, CSV, Parquet or text (.md: rows of one table) that its tasks write on any file system."""
    kind = (format or str(path).rpartition(".")[2]).lstrip(".").lower()
    cells = [_cell(F.col(f"`{f.name}`"), f.dataType.typeName()).alias(f.name) for f in df.schema]
    writer = {
        "jsonl": lambda: df.write.option("ignoreNullFields", False).json(str(path)), "parquet": lambda: df.write.parquet(str(path)),
        "csv": lambda: df.select(*cells).write.option("header", True).option("escape", '"').csv(str(path)), "md": lambda: df.select(markdown_row(*cells)).write.text(str(path)),
    }
    if kind not in writer:
        raise ValueError(f"no distributed writer for {kind!r}; available: {sorted(writer)}")
    writer[kind]()
    return str(path)


def markdown_row(*cells: Column) -> Column:
    """One row of a Markdown table as a Column."""
    def cell(c: Column) -> Column:
        s = F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
        return F.when(F.length(s) > CELL, F.concat(F.left(s, F.lit(CELL - 3)), F.lit("…"))).otherwise(s)

    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, cells)), F.lit(" |"))
