"""the first JSON object in model output. Built-in functions find flat ones; the rest is a scan in Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_THINKING = re.compile(r"<thinking>.*?</thinking>", re.S | re.I)
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def first_object(text: str | None) -> str | None:
    """The first balanced {...} that parses, outside thinking blocks, inside a code fence if there is one."""
    if not text:
        return None
    text = _THINKING.sub("", text)
    fence = _FENCE.search(text)
    for body in ([fence[1]] if fence else []) + [text]:
        start = body.find("{")
        while start >= 0:
            depth, quoted, escaped = 0, False, False
            for i in range(start, len(body)):
                c = body[i]
                if quoted:
                    escaped, quoted = (False, True) if escaped else (c == "\\", c != '"')
                elif c == '"':
                    quoted = True
                elif c in "{}":
                    depth += 1 if c == "{" else -1
                    if not depth:
                        try:
                            json.loads(body[start : i + 1])
                            return body[start : i + 1]
                        except ValueError:
                            break
            start = body.find("{", start + 1)
    return None


#: An object without nested ones and escapes: balanced as it stands.
_FLAT = r'^[^{]*(\{(?:[^{}"\\\x00-\x1f]|[\t\n\r]|"[^"\\{}\x00-\x1f]*")*\})'


def extract_json(column: Column) -> Column:
    """flat objects by built-in functions; only texts whose first object is another one reach Python."""
    plain = F.regexp_replace(column, r"(?is)<thinking>.*?</thinking>", "")
    fence = F.regexp_extract(plain, r"(?is)```(?:json)?\s*(.*?)```", 1)
    flat = F.regexp_extract(F.when(fence != "", fence).otherwise(plain), _FLAT, 1)
    simple = F.get_json_object(flat, "$").isNotNull()

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(first_object)

    return F.coalesce(F.when(simple, flat), F.pandas_udf(each, "string")(F.when(~F.coalesce(simple, F.lit(False)), column)))
