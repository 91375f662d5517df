"""Chat formatting (operator 2): heterogeneous records to canonical turns to a marked, reversible template.

A record's fingerprint is a hash of its sorted nested field paths; a registry of declarative mappings,
keyed by fingerprint, says which paths give which turns. Records with unknown fingerprints are matched
by the mapping whose paths they contain (extra fields do no harm); others raise no error and give no turns.

The template writes each turn as <|im_start|>role<|im_sep|>text<|im_end|>. Inside roles and texts every
backslash is doubled and every control string gets a backslash after its first character, so no text can
end a turn or forge one; undoing it is exact. The loss mask covers assistants' texts.

Null texts and roles are empty. Roles of the `messages` layout are kept as they are; layouts with vendors' names
for roles say which role each name means. Turns are ordered by turn number (nulls first), then role, then text;
repeated rows stay repeated turns. A null conv_id is one conversation. One conversation is one record and
is formatted in one piece, however long; its digest is defined over all its turns. Bytes that are no
valid UTF-8 are read as U+FFFD. Extra columns are ignored; no rows give no conversations.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean, read, tidy

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = (START, SEP, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL))
_UNDO = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNDO.sub(r"\1", text)


def paths(value: object, at: str = "") -> set[str]:
    """The nested field paths of a record: a.b, and a[].b inside lists."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items())) if value else {at}
    if isinstance(value, (list, tuple)):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


def fingerprint(of: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(of)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """turns: (role, path of the text) pairs, in order; or a list's path with the paths of role and text in its items.

    roles: (name, role) pairs of a list whose items name roles in another way; other names stay.
    """

    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()

    def needs(self) -> set[str]:
        return {f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"} if self.items else {p for _, p in self.turns}


#: The field names of common layouts and the names they give to roles.
VENDOR_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Mapping(items="messages", role="role", text="content"),
    Mapping(items="conversations", role="from", text="value", roles=VENDOR_ROLES),
    Mapping(turns=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping(turns=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping(turns=(("user", "instruction"), ("assistant", "output"))),
    Mapping(turns=(("user", "instruction"), ("user", "context"), ("assistant", "response"))),
    Mapping(turns=(("user", "instruction"), ("assistant", "response"))),
    Mapping(turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping(turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(turns=(("user", "prompt"), ("assistant", "response"))),
    Mapping(turns=(("user", "question"), ("assistant", "answer"))),
)
REGISTRY = {fingerprint(m.needs()): m for m in LAYOUTS}


def mapping_of(record: dict, registry: dict[str, Mapping] | None = None) -> Mapping | None:
    registry = REGISTRY if registry is None else registry
    have = paths(record)
    hit = registry.get(fingerprint(have))
    if hit is None:
        inside = [m for m in registry.values() if m.needs() <= have]
        hit = max(inside, key=lambda m: len(m.needs()), default=None)
    if hit is None:  # an empty list shows no item paths
        hit = next((m for m in registry.values() if m.items and f"{m.items}[]" in have), None)
    return hit


def _at(record: object, path: str) -> str:
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return "" if record is None else record if isinstance(record, str) else json.dumps(record, ensure_ascii=False)


def canonical(record: dict, registry: dict[str, Mapping] | None = None) -> list[tuple[str, str]]:
    """The record's (role, text) turns. Neighbouring parts of one prompt join into one turn; empty optional parts go."""
    m = mapping_of(record, registry)
    if m is None:
        return []
    if m.items:
        found = [(_at(x, m.role), _at(x, m.text)) for x in record.get(m.items) or []]
        return [(dict(m.roles).get(r, r), t) for r, t in found]
    out: list[tuple[str, str]] = []
    for role, path in m.turns:
        text = _at(record, path)
        if role != "assistant" and not text:
            continue
        if out and out[-1][0] == role:
            out[-1] = (role, f"{out[-1][1]}\n\n{text}")
        else:
            out.append((role, text))
    return out


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask as (start, end) spans of code points."""
    out, spans, size = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == "assistant":
            spans.append((size + len(head), size + len(head) + len(body)))
        out += [head, body, END]
        size += len(head) + len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for part in formatted.split(END)[:-1]:
        role, text = part.removeprefix(START).split(SEP)
        out.append((unescape(role), unescape(text)))
    return out


SCHEMA = "conv_id long, fingerprint string, formatted string, loss_spans array<struct<start:long,end:long>>"


def format_records(records: DataFrame, registry: dict[str, Mapping] | None = None) -> DataFrame:
    """records (conv_id long, record as JSON text) -> SCHEMA, a row per record."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["record"]:
                try:
                    record = json.loads(text) if isinstance(text, str) else {}
                except ValueError:
                    record = {}
                record = record if isinstance(record, dict) else {}
                formatted, spans = render(canonical(record, registry))
                rows.append((fingerprint(paths(record)), formatted, [{"start": a, "end": b} for a, b in spans]))
            out = pd.DataFrame(rows, columns=["fingerprint", "formatted", "loss_spans"])
            out.insert(0, "conv_id", frame["conv_id"].astype("Int64").to_numpy())
            yield out.astype({"conv_id": "Int64"})

    return records.select(F.col("conv_id").cast("long").alias("conv_id"), "record").mapInPandas(tidy(run), SCHEMA)


def from_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows (conv_id, turn, role, text, keys; others are ignored) -> records in the messages layout, one for each conv_id and keys."""
    read_as = lambda c: F.coalesce(clean(F.col(c)), F.lit(""))
    turn = F.struct(F.col("turn"), read_as("role").alias("role"), read_as("text").alias("content"))
    found = rows.groupBy("conv_id", *keys).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return found.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, spans in zip(frame["formatted"], frame["loss_spans"], strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), _sha(whole), len(loss), _sha(loss), len(text)))
            out = pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.insert(0, "conv_id", frame["conv_id"].astype("Int64").to_numpy())
            yield out.astype({"conv_id": "Int64"})

    return formatted.mapInPandas(tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation -1 of the table, if there is one, stays apart from the added one."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lit(False).alias("added"))
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own, True), (-1, 1, "assistant", own, True)], "conv_id long, turn long, role string, text string, added boolean")
    return digests(format_records(from_rows(rows.union(extra), "added")))


_ESCAPED = r"""regexp_replace(replace({0}, '\', '\\'), '(<)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|unk>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])', '\1\3\\\2\4', 'g')"""
OP2_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS added FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]', true), (-1, 1, 'assistant', '</s>[INST] ok [/INST]', true)) v(a, b, c, d, e)
), e AS (
  SELECT *, {_ESCAPED.format("text")} AS body, {_ESCAPED.format("role")} AS head FROM c
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + length(head) + 12 + 10 + 10) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id, added
"""
