"""JSON objects inside other text: answers of models, and payloads that pages stream to themselves."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PUSH = re.compile(r'self\.__next_f\.push\(\[1,("(?:[^"\\]|\\.)*")\]\)', re.DOTALL)
_PRODUCT = re.compile(r'"@type"\s*:\s*"Product"')


def _unquoted(text: str) -> str | None:
    try:
        return json.loads(text, strict=False)
    except ValueError:
        return None


def _object_at(text: str, at: int) -> dict | None:
    try:
        found, _ = json.JSONDecoder(strict=False).raw_decode(text, at)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


@F.pandas_udf(T.StringType())
def first_object(text: pd.Series) -> pd.Series:
    """The JSON object that begins at the first brace, as JSON; null if none does."""

    def find(x: str | None) -> str | None:
        at = (x or "").find("{")
        found = _object_at(x, at) if at >= 0 else None
        return None if found is None else json.dumps(found, ensure_ascii=False)

    return pd.Series([find(x) for x in text], dtype=object)


@F.pandas_udf(T.StringType())
def streamed_product(html: pd.Series) -> pd.Series:
    """The first product object in the chunks that a page pushes to itself, as JSON; null without one."""

    def find(x: str | None) -> str | None:
        body = "".join(_unquoted(m[1]) or "" for m in _PUSH.finditer(x or ""))
        for m in _PRODUCT.finditer(body):
            at = m.start()
            while (at := body.rfind("{", 0, at)) >= 0:  # outwards, to the object whose own type this is
                found = _object_at(body, at)
                if found is not None and found.get("@type") == "Product":
                    return json.dumps(found, ensure_ascii=False)
                if m.start() - at > 20_000:
                    break
        return None

    return pd.Series([find(x) for x in html], dtype=object)
