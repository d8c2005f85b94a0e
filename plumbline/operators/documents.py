"""Nested JSON documents side by side: where two of them differ, by path."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*\Z")


def _kind(x: object) -> str:
    if isinstance(x, _Unread):
        return "invalid"
    if isinstance(x, dict):
        return "object"
    if isinstance(x, list):
        return "list"
    return "null" if x is None else "boolean" if isinstance(x, bool) else "integer" if isinstance(x, int) else "number" if isinstance(x, float) else "string"


def _said(x: object) -> str:
    """A value as it is told: an object by its kind, a list by its length, a text that isn't JSON as it is, anything else as JSON."""
    if isinstance(x, (dict, _Unread)):
        return "object" if isinstance(x, dict) else str(x)
    return f"{len(x)} entries" if isinstance(x, list) else json.dumps(x, ensure_ascii=False)


class _Unread(str):
    """A text that isn't JSON."""


def _read(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return _Unread(text)


def _beneath(path: str, x: dict | list) -> dict[str, list]:
    """What lies in an object or list, by path.

    Entries of a list are named by their "id" where that is stated and no other entry of the list has it, else by position.
    """
    found: dict[str, list] = {}
    if isinstance(x, dict):
        for k, v in x.items():
            here = (f"{path}.{k}" if path else k) if _PLAIN_KEY.match(k) else f"{path}[{json.dumps(k)}]"
            found.setdefault(here, []).append(v)
        return found
    names = [v.get("id") if isinstance(v, dict) else None for v in x]
    names = [str(n) if isinstance(n, (str, int)) and not isinstance(n, bool) and n != "" else None for n in names]
    once = _once(names)
    for i, (n, v) in enumerate(zip(names, x, strict=True)):
        found.setdefault(f"{path}[{n if n in once else f'#{i}'}]", []).append(v)
    return found


def differences(was: str | None, now: str | None) -> Iterator[tuple]:
    """(path, difference, was, now) of two versions of one document, null where there is none."""
    if was == now:
        return
    open_ = [("", [] if was is None else [_read(was)], [] if now is None else [_read(now)])]
    while open_:
        path, olds, news = open_.pop()
        if not olds or not news:
            yield from ((path, "removed", _said(x), None) for x in olds)
            yield from ((path, "added", None, _said(y)) for y in news)
        for x, y in ((x, y) for x in olds for y in news):
            kind, other = _kind(x), _kind(y)
            if kind != other:
                yield path, "type", kind, other
            elif kind == "list" and len(x) != len(y):
                yield path, "length", _said(x), _said(y)
            elif kind in ("object", "list"):
                old, new = _beneath(path, x), _beneath(path, y)
                open_ += [(here, old.get(here, []), new.get(here, [])) for here in old | new]
            elif _said(x) != _said(y):
                yield path, "changed", _said(x), _said(y)


def _once(names: list) -> set:
    seen, again = set(), set()
    for n in names:
        (again if n in seen else seen).add(n)
    return seen - again - {None}


def paired_diff(pairs: DataFrame, key: str, was: str, now: str) -> DataFrame:
    """(key, path, difference, was, now): where the two versions in each row differ, as ``deep_diff`` has it. [SET08, SNK10]

    Each row is read for itself, so nothing is shuffled, and only differences leave the task.
    """
    names = ("path", "difference", "was", "now")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, at = batch.column(key), [], []
            for i, (old, new) in enumerate(zip(batch.column("_was").to_pylist(), batch.column("_now").to_pylist(), strict=True)):
                for row in differences(old, new):
                    rows.append(row)
                    at.append(i)
                if len(rows) >= 8192 or (rows and i + 1 == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *(pa.array(c, pa.string()) for c in zip(*rows, strict=True))], names=[key, *names])
                    rows, at = [], []

    given = pairs.select(key, F.col(was).cast("string").alias("_was"), F.col(now).cast("string").alias("_now"))
    return given.mapInArrow(run, T.StructType([given.schema[key], *(T.StructField(n, T.StringType()) for n in names)]))


def deep_diff(committed: DataFrame, fresh: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, difference, was, now): where two versions of a document differ. [SET08, SNK10]

    added, removed: on one side only, said once for all that is beneath. type: kinds differ. length: lists of different lengths,
    of which nothing more is said. changed: values differ. One full join by key brings the two versions of a document
    together as texts, and their nodes are compared where they lie. The root's path is empty. Keys must be unique on each side.
    """
    sides = [df.where(F.col(column).isNotNull()).select(key, F.col(column).alias(name)) for df, name in ((committed, "_was"), (fresh, "_now"))]
    return paired_diff(sides[0].join(sides[1], key, "full_outer"), key, "_was", "_now")


def drift_report(differences: DataFrame, key: str, cap: int = 40) -> DataFrame:
    """The first ``cap`` differences of each document by path, each with how many more the document has. [SNK10]"""
    w = Window.partitionBy(key)
    ranked = differences.withColumn("nth", F.row_number().over(w.orderBy("path", "difference"))).withColumn("more", F.greatest(F.count("*").over(w) - cap, F.lit(0)))
    return ranked.where(F.col("nth") <= cap)
