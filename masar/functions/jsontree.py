"""Documents of JSON walked to any depth."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def without_keys(document: Column | str, keys: Iterable[str]) -> Column:
    """The document without the members of these names, at any depth; null where it isn't JSON."""
    gone = frozenset(keys)

    def cut(x: object) -> object:
        if isinstance(x, dict):
            return {k: cut(v) for k, v in x.items() if k not in gone}
        return [cut(v) for v in x] if isinstance(x, list) else x

    def read(s: str | None) -> str | None:
        try:
            return None if s is None else json.dumps(cut(json.loads(s)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    @F.pandas_udf(StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(read, na_action="ignore")

    return run(document)


def names_in(document: Column | str, keys: Iterable[str], least: int = 3) -> Column:
    """The distinct texts, trimmed and of ``least`` characters or more, under these names at any depth, in order; lists and ``name`` members below count too."""
    wanted = frozenset(keys)

    def gather(x: object, out: dict[str, None], take: bool) -> None:
        if isinstance(x, str):
            if take and len(x.strip()) >= least:
                out[x.strip()] = None
        elif isinstance(x, list):
            for v in x:
                gather(v, out, take)
        elif isinstance(x, dict):
            for k, v in x.items():
                gather(v, out, k in wanted or take and k == "name")

    def read(s: str | None) -> list[str]:
        out: dict[str, None] = {}
        try:
            gather(json.loads(s or "null"), out, False)
        except ValueError:
            pass
        return sorted(out)

    @F.pandas_udf(ArrayType(StringType()))
    def run(x: pd.Series) -> pd.Series:
        return x.map(read)

    return run(document)
