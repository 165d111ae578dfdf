"""Chat formatting: schema fingerprints pick declarative mappings into canonical turns; a reversible template marks them.

A record is a JSON object in any layout. Its nested field paths, arrays written as [] and rows of an array merged, are
sorted and hashed; the hash selects a mapping, which lists where turns are and what their role and text are. Records
whose fingerprint has no mapping keep null turns and their fingerprint, so a missing mapping is seen, not guessed.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, read

END = "</turn>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``fields``: field paths that identify the layout. ``each``: path of the list of messages, '' if there is none.
    ``turns``: (role, path of the text) in order for layouts without a list; a role starting with '$' names the
    path of the role. ``roles``: renamed roles. Turns whose ``optional`` path is empty are left out.
    """

    fields: tuple[str, ...]
    turns: tuple[tuple[str, str], ...]
    each: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()


_NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("prompter", "user"), ("model", "assistant"))
MAPPINGS = (
    Mapping(("messages[].content", "messages[].role"), (("$role", "content"),), each="messages", roles=_NAMES),
    Mapping(("turns[].role", "turns[].text"), (("$role", "text"),), each="turns"),
    Mapping(("conversations[].from", "conversations[].value"), (("$from", "value"),), each="conversations", roles=_NAMES),
    Mapping(("[].content", "[].role"), (("$role", "content"),), each="[]", roles=_NAMES),
    Mapping(("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping(("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping(("question", "answer"), (("user", "question"), ("assistant", "answer"))),
    Mapping(("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping(("input", "instruction", "output"), (("system", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
    Mapping(("data.assistant", "data.user"), (("user", "data.user"), ("assistant", "data.assistant"))),
)


def field_paths(value, prefix: str = "") -> set[str]:
    """Paths of all leaves below ``value``; an empty object or list is the leaf at its own path."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{prefix}.{k}" if prefix else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, f"{prefix}[]") for v in value))
    return {prefix}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def registry(mappings=MAPPINGS) -> dict[str, Mapping]:
    return {fingerprint(m.fields): m for m in mappings}


def _at(value, path: str):
    for part in path.split("."):
        value = value.get(part) if isinstance(value, dict) else None
    return value


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record, mapping: Mapping) -> list[tuple[str, str]]:
    rename = dict(mapping.roles)
    rows = (record if mapping.each == "[]" else _at(record, mapping.each)) if mapping.each else [record]
    found = []
    for row in rows or []:
        for role, path in mapping.turns:
            text = _text(_at(row, path))
            if path in mapping.optional and not text:
                continue
            role = _text(_at(row, role[1:])) if role[0] == "$" else role
            found.append((rename.get(role, role), text))
    return found


#: Control strings of the template; a role also escapes line ends, which close its header.
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|\n")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|n)")


def _escape(text: str, control=_CONTROL) -> str:
    return control.sub(lambda m: "\\n" if m[0] == "\n" else "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(turns, loss_roles=("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the (start, end) code points of it that carry loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"### {_escape(role, _ROLE_CONTROL)}:\n"
        body = _escape(text)
        if role in loss_roles:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END, "\n")
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that :func:`render` wrote; ValueError on any other text."""
    found, at = [], 0
    while at < len(formatted):
        head = formatted.find(":\n", at)
        if head < 0 or not formatted.startswith("### ", at):
            raise ValueError(f"no turn starts at {at}")
        body, end = head + 2, head + 2
        while True:
            end = formatted.find(END, end)
            if end < 0:
                raise ValueError(f"the turn at {at} has no end")
            slashes = end - len(formatted[body:end].rstrip("\\")) - body
            if slashes % 2 == 0:
                break
            end += len(END)
        found.append((unescape(formatted[at + 4 : head]), unescape(formatted[body:end])))
        at = end + len(END) + 1
    return found


def canonical(raw: str | None, known: dict[str, Mapping]) -> tuple[str | None, list[tuple[str, str]] | None]:
    """Fingerprint and turns of one JSON record. Null or malformed: both null. An unknown layout: turns null."""
    try:
        record = None if raw is None else json.loads(raw)
    except ValueError:
        record = None
    if record is None:
        return None, None
    key = fingerprint(field_paths(record))
    mapping = known.get(key)
    return key, None if mapping is None else turns_of(record, mapping)


def read_back(text: str, spans: list[tuple[int, int]]) -> tuple:
    """Number of turns, their digest, code points and digest of the text under the loss mask: all from the formatted text."""
    turns = parse(text)
    whole = "".join(f"{role}\n{body}\n" for role, body in turns)
    loss = "".join(unescape(text[a:b]) for a, b in spans)
    hexed = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (whole, loss)]
    return len(turns), hexed[0], len(loss), hexed[1], len(text)


_OUT = "fingerprint string, formatted string, loss_spans array<struct<start:bigint,end:bigint>>"
_DIGESTS = ", n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def format_chat(records: DataFrame, keep: tuple[str, ...], record_col: str = "record", mappings=MAPPINGS, loss_roles=("assistant",), digests: bool = False) -> DataFrame:
    """``keep`` columns, fingerprint, formatted and loss_spans (code points, end excluded) for a column of JSON records.

    Records without turns (null, malformed, unknown layout) have null formatted and loss_spans. Null texts and roles
    count as empty. ``digests`` adds what :func:`read_back` finds. Empty tables give no rows; repeated rows stay.
    """

    def make():
        known = registry(mappings)

        def run(raw):
            rows = []
            for text in raw:
                key, turns = canonical(text, known)
                if turns is None:
                    rows.append((key,) + (None,) * (7 if digests else 2))
                    continue
                formatted, spans = render(turns, loss_roles)
                row = (key, formatted, [{"start": a, "end": b} for a, b in spans])
                rows.append(row + read_back(formatted, spans) if digests else row)
            return list(zip(*rows)) if rows else [[]] * (8 if digests else 3)

        return run

    return map_rows(records, keep, (record_col,), make, _OUT + _DIGESTS if digests else _OUT)


def conversation_records(rows: DataFrame) -> DataFrame:
    """One JSON record per conversation from (conv_id, turn, role, text): its rows by turn, ties by role and text.

    Null text: empty. A null conv_id is a conversation of its own. Repeated rows stay. A conversation is one record by
    definition, so its rows meet in one place; different conversations spread over the cluster.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.sort_array(F.collect_list(row)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return rows.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.to_json(F.struct("turns")).alias("record"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    out = format_chat(conversation_records(rows.unionByName(own)), ("conv_id",), digests=True)
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


OP1_SQL = r"""
WITH rows_in AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
marked AS (
  SELECT *, regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') AS body,
         regexp_replace(role, '(\\|###|</turn>|\n)', '\\\1', 'g') AS head
  FROM rows_in)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(head) + 2 + length(body) + 7 + 1) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
