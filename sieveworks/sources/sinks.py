"""Sinks: JSON lines, split folders, and small reports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveworks.runtime import cut_lineage
from sieveworks.sources import files

#: Rows that a report or an array file may have; these are written by the driver.
REPORT_ROWS = 100_000


def write_jsonl(df: DataFrame, path: str, ascii_only: bool = False, mode: str = "errorifexists") -> None:
    """A folder of JSON lines; ``ascii_only`` escapes other characters."""
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    if ascii_only:
        text = escaped(text)
    df.select(text.alias("value")).write.mode(mode).text(path)


@F.pandas_udf(T.StringType())
def escaped(s):  # type: ignore[no-untyped-def]
    return s.map(lambda t: None if t is None else json.dumps(json.loads(t), ensure_ascii=True))


def write_lines(df: DataFrame, path: str, line: str = "value") -> None:
    """The kept rows' own lines, as they were read."""
    df.select(F.col(line).alias("value")).write.text(path)


def write_by(df: DataFrame, path: str, column: str, plain: bool = False) -> None:
    """One folder of JSON lines for each value: a split, a task; ``plain`` names the folders by the values alone."""
    df.write.partitionBy(column).json(path)
    if plain:
        for name in files.folders(path):  # as many as there are values
            files.move(f"{path}/{name}", f"{path}/{unquote(name.split('=', 1)[1])}")


def write_selection(df: DataFrame, path: str, flag: str = "_sampled") -> tuple[str, str]:
    """Folders ``selected_{k}`` and ``remaining_{n}`` of JSON lines, named by their rows; their paths."""
    sizes = {r[flag]: r["count"] for r in df.filter(F.col(flag).isin("selected", "remaining")).groupBy(flag).count().collect()}
    out = []
    for kind in ("selected", "remaining"):
        out.append(f"{path}/{kind}_{sizes.get(kind, 0)}")
        write_jsonl(df.filter(F.col(flag) == kind), out[-1])
    return out[0], out[1]


def append_unfinished(df: DataFrame, path: str, key: str) -> int:
    """Appends those rows of ``df`` whose key the Parquet folder lacks; how many. A broken job leaves none of its rows, and the next one takes it from there."""
    spark = df.sparkSession
    todo = df.dropDuplicates([key])
    if files.is_folder(path):
        todo = todo.join(spark.read.schema(df.schema).parquet(path).select(key), key, "left_anti").select(*df.columns)
    todo = cut_lineage(todo)  # written as it was counted
    n = todo.count()
    if n:
        todo.write.mode("append").parquet(path)
    return n


def replace_folder(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Written beside and then moved in place, so that a folder being read is never half overwritten."""
    new, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").format(form).save(new)
    files.remove(old)
    if files.is_folder(path):
        files.move(path, old)
    files.move(new, path)
    files.remove(old)


def small_rows(df: DataFrame, most: int = REPORT_ROWS) -> list[dict[str, Any]]:
    """A report's rows; raises where the table is no report."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them with write_jsonl")
    return [r.asDict(recursive=True) for r in rows]


def _json(x: Any) -> str:
    return json.dumps(x, ensure_ascii=False, indent=2, default=str)


def write_json_array(df: DataFrame, path: str) -> None:
    """One file with an array of the rows."""
    files.write_text(path, _json(small_rows(df)))


def write_indexed(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """An object from '0', '1', ... to the rows in order."""
    files.write_text(path, _json({str(i): r for i, r in enumerate(small_rows(df.orderBy(*order)))}))


def markdown_table(rows: Sequence[Mapping[str, Any]]) -> str:
    if not rows:
        return ""
    names = list(rows[0])
    body = ["| " + " | ".join("" if r[n] is None else str(r[n]) for n in names) + " |" for r in rows]
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *body]) + "\n"


def write_report(summary: Mapping[str, Any], rows: DataFrame, path: str) -> None:
    """``path``.json with summary and rows, and ``path``.md as a table."""
    table = small_rows(rows)
    files.write_text(f"{path}.json", _json({"summary": dict(summary), "rows": table}))
    files.write_text(f"{path}.md", "".join(f"- {k}: {v}\n" for k, v in summary.items()) + "\n" + markdown_table(table))
