"""JSON documents cut to parts of bounded size that keep their structure.

Which member opens a part depends on how full the one before is, so a document is walked in order by a small helper within Arrow
batches; documents are never shuffled. A part's size is counted as members are put in, so a walk takes linear time.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines looked at to tell lines of JSON from a broken document, and the share of them that must be valid.
SAMPLE_LINES, VALID_SHARE = 10, 0.8


def _members(value: Any) -> list[tuple[str, Any]]:
    return list(value.items()) if isinstance(value, dict) else [(str(i), v) for i, v in enumerate(value)]


def _keyed(value: Any) -> Any:
    """Lists as objects of their indexes, at all depths."""
    return {k: _keyed(v) for k, v in _members(value)} if isinstance(value, (dict, list)) else value


def _said(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False)


class _Parts:
    def __init__(self, most: int, least: int):
        self.most, self.least = most, least
        self.all: list[dict] = [{}]
        self.size = 2

    def put(self, path: list[str], value: Any, said: int) -> None:
        """``value``, which is ``said`` characters of JSON, at the ``path`` of the last part."""
        at = self.all[-1]
        for key in path[:-1]:
            if key not in at:
                # the object is new: its key, its braces, and a comma unless it is the first
                self.size += len(_said(key)) + 4 + 2 * bool(at)
                at[key] = {}
            at = at[key]
        self.size += len(_said(path[-1])) + 2 + said + 2 * bool(at)
        at[path[-1]] = value

    def fill(self, value: Any) -> None:
        """Walks the members of an object; one that doesn't fit whole is cut, in a new part if the last one is full enough."""
        todo = [([k], v) for k, v in reversed(_members(value))]
        while todo:
            path, v = todo.pop()
            said = len(_said(v))
            if len(_said(path[-1])) + 4 + said < self.most - self.size:
                self.put(path, v, said)
                continue
            if self.size >= self.least:
                self.all.append({})
                self.size = 2
            if isinstance(v, dict) and v:
                todo += [([*path, k], x) for k, x in reversed(_members(v))]
            else:
                self.put(path, v, said)


def parts_of(text: str | None, size: int = 2000, least: int | None = None) -> list[str]:
    """The parts of a document as JSON.

    A part takes members while it stays below twice ``size`` characters. A member that doesn't fit is cut into its own members, in a new
    part if the last holds ``least`` (``size`` - 200, at least 50) or more; a single value is never cut. Lists become objects of their
    indexes. Where the text is no JSON but at least ``VALID_SHARE`` of its first lines are, each line is a document; other lines are
    skipped. Single values, empty documents, broken and null texts have no parts.
    """
    least = max(size - 200, 50) if least is None else least
    docs = []
    for doc in _documents(text):
        if isinstance(doc, (dict, list)):
            parts = _Parts(2 * size, least)
            parts.fill(_keyed(doc))
            docs += [_said(p) for p in parts.all if p]
    return docs


def _loaded(text: str) -> tuple[bool, Any]:
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def _documents(text: str | None) -> list[Any]:
    valid, doc = _loaded(text or "")
    if valid:
        return [doc]
    lines = [x for x in (text or "").strip().splitlines() if x.strip()]
    sample = [_loaded(x)[0] for x in lines[:SAMPLE_LINES]]
    if not any(sample) or sum(sample) / len(sample) < VALID_SHARE:
        return []
    return [doc for valid, doc in map(_loaded, lines) if valid]


def json_parts(docs: DataFrame, id_col: str, text_col: str, size: int = 2000, least: int | None = None) -> DataFrame:
    """(id, pos, part): the parts of each document (see ``parts_of``) in order from 0."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: parts_of(t, size, least))

    parts: Column = cut(F.col(text_col).cast("string"))
    return docs.select(F.col(id_col), F.posexplode(parts).alias("pos", "part"))
