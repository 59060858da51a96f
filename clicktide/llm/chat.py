"""Chat formatting: records of any known layout become canonical turns, then one template.

A record is a JSON object.  Its nested field paths, without array positions, are
sorted and hashed; that fingerprint selects a declarative mapping.  The template
marks turns and makes control strings in texts harmless, reversibly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktide.llm.common import slices

# --- layouts ----------------------------------------------------------------------

# Each layout: the field paths of its records, required and optional, and either
# one list of messages or a sequence of (role, path).
LAYOUTS: dict[str, dict] = {
    "turn": {"paths": ["role", "text"], "turns": [("$role", "text")]},
    "messages": {"paths": ["messages[].role", "messages[].content"], "list": ("messages", "role", "content")},
    "conversations": {"paths": ["conversations[].from", "conversations[].value"], "list": ("conversations", "from", "value")},
    "instruction": {
        "paths": ["instruction", "output"], "optional": ["input", "system"],
        "turns": [("system", "system"), ("user", "instruction+input"), ("assistant", "output")],
    },
    "prompt": {
        "paths": ["prompt", "response"], "optional": ["system"],
        "turns": [("system", "system"), ("user", "prompt"), ("assistant", "response")],
    },
    "completion": {"paths": ["prompt", "completion"], "turns": [("user", "prompt"), ("assistant", "completion")]},
    "question": {
        "paths": ["question", "answer"], "optional": ["context"],
        "turns": [("user", "context+question"), ("assistant", "answer")],
    },
    "nested": {"paths": ["data.prompt.text", "data.reply.text"], "turns": [("user", "data.prompt.text"), ("assistant", "data.reply.text")]},
}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(value, at: str = "") -> set[str]:
    """Paths of the leaves of a JSON value; positions in arrays do not count."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {at}
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else set()
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@lru_cache(maxsize=1)
def registry() -> dict[str, str]:
    """Layout by fingerprint: one for each choice of a layout's optional fields."""
    known = {}
    for name, layout in LAYOUTS.items():
        choices = [set(layout["paths"])]
        for path in layout.get("optional", []):
            choices += [c | {path} for c in choices]
        known |= {fingerprint(c): name for c in choices}
    return known


def _at(record, path: str):
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return record


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _joined(record, paths: str) -> str | None:
    values = [v for v in (_at(record, p) for p in paths.split("+")) if v is not None]
    return "\n\n".join(map(_text, values)) if values else None


def turns_of(record: dict, layout: str) -> list[tuple[str, str]]:
    """Canonical (role, text) turns of a record of a known layout."""
    how = LAYOUTS[layout]
    if "list" in how:
        field, role, content = how["list"]
        return [(ROLES.get(r := _text(m.get(role)), r), _text(m.get(content))) for m in record.get(field) or []]
    turns = []
    for role, path in how["turns"]:
        text = _joined(record, path)
        if role.startswith("$"):
            turns.append((_text(record.get(role[1:])), _text(text)))
        elif text is not None or role != "system":
            turns.append((role, _text(text)))
    return turns


# --- template ---------------------------------------------------------------------

BEGIN, STOP = "<|im_start|>", "<|im_end|>"
# Strings that some chat template gives a meaning.
CONTROL = [BEGIN, STOP, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_RESTS = {c: "|".join(re.escape(s[1:]) for s in CONTROL if s[0] == c) for c in "<["}
_ESCAPE = re.compile("|".join(rf"{re.escape(c)}\\*(?={rest})" for c, rest in _RESTS.items()))
_UNESCAPE = re.compile("|".join(rf"{re.escape(c)}\\+(?={rest})" for c, rest in _RESTS.items()))


def escape(text: str) -> str:
    """A backslash after the first character of a control string, before those that stand there."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][:-1], text)


def escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def render(role: str, text: str) -> str:
    """A turn in the template."""
    return f"{BEGIN}{escape_role(role)}\n{escape(text)}{STOP}\n"


_TURN = re.compile(rf"{re.escape(BEGIN)}([^\n]*)\n(.*?){re.escape(STOP)}\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and span of the escaped text, of each turn of a formatted string."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return turns


def told(raw: str | None, known: dict[str, str]) -> tuple[str, list[tuple[str, str]] | None]:
    """Layout and turns of a JSON record; without turns if it has no layout that is known."""
    try:
        record = json.loads(raw) if raw is not None else None
        print_ = fingerprint(field_paths(record)) if isinstance(record, dict) else "none"
    except (ValueError, RecursionError):
        return "unknown:none", None
    layout = known.get(print_)
    if layout is None or not _has_turns(record, layout):
        return f"unknown:{print_}", None
    return layout, turns_of(record, layout)


def _has_turns(record: dict, layout: str) -> bool:
    """Lists without entries leave no path, so the fingerprint does not see what they stand for."""
    how = LAYOUTS[layout]
    if "list" not in how:
        return True
    entries = record.get(how["list"][0]) or []
    return isinstance(entries, list) and all(isinstance(m, dict) for m in entries)


FORMATTED = "record_layout string, piece long, role string, formatted string, loss array<struct<begin:long,end:long>>"


def format_records(records: DataFrame, *keys: str) -> DataFrame:
    """Format JSON records; one row per canonical turn.

    ``records`` has a string column ``record`` and the columns ``keys``, which
    are kept.  Added are the layout, the number of the turn within its record,
    the role, the formatted turn and the spans in it that count for the loss
    (assistant texts).  Concatenated in order they are the conversation.

    A record of an unknown layout, a null record, one that is no JSON object or is
    nested too deeply to read, and one whose list of turns holds something else than turns
    give one row with a null ``formatted``, its layout saying ``unknown:``
    and its fingerprint.  Fields that are null count as fields; their text is empty.
    """
    kept = [F.col(k) for k in keys]
    added = [c.split() for c in FORMATTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = registry()
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), span]
        for batch in (part for whole in batches for part in slices(whole, "record")):
            rows, source = [], []
            for i, raw in enumerate(batch.column(len(keys)).to_pylist()):
                layout, turns = told(raw, known)
                if turns is None:
                    rows.append((layout, None, None, None, None))
                    source.append(i)
                    continue
                for k, (role, text) in enumerate(turns):
                    piece = render(role, text)
                    end = len(piece) - len(STOP) - 1
                    loss = [{"begin": end - len(escape(text)), "end": end}] if role == "assistant" else []
                    rows.append((layout, k, role, piece, loss))
                    source.append(i)
            if not rows:
                continue
            columns = [batch.column(j).take(pa.array(source)) for j in range(len(keys))]
            columns += [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *(a[0] for a in added)])

    plain = records.select(*kept, F.col("record").cast("string").alias("record"))
    kinds = ", ".join(f"{k} {t}" for k, t in plain.drop("record").dtypes)
    return plain.mapInArrow(run, f"{kinds}, {FORMATTED}" if kinds else FORMATTED)


def turn_records(conversations: DataFrame) -> DataFrame:
    """Rows by turn as JSON records of the ``turn`` layout, keyed by ``conv_id`` and ``turn``."""
    record = F.to_json(F.struct(F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")), {"ignoreNullFields": "false"})
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), record.alias("record")
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what is read back from its formatted turns.

    ``formatted`` has ``conv_id``, ``turn``, ``piece``, ``formatted`` and ``loss``.
    Turns are read in the order of turn, piece and content; a task streams its
    conversations, so that none is held whole.  A null ``conv_id`` is one
    conversation of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, n, whole, loss, loss_chars, chars = object(), 0, None, None, 0, 0
        done: list[tuple] = []
        for batch in batches:
            for conv, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if n == 0 or conv != current:
                    if n:
                        done.append((current, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    current, n, loss_chars, chars = conv, 0, 0, 0
                    whole, loss = hashlib.sha256(), hashlib.sha256()
                for role, body, _, _ in read_back(text):
                    whole.update(f"{role}\n{body}\n".encode())
                    n += 1
                chars += len(text)
                for s in spans:
                    body = unescape(text[s["begin"] : s["end"]])
                    loss.update(body.encode())
                    loss_chars += len(body)
            if len(done) > 20_000:
                yield _digest_rows(done)
                done = []
        if n:
            done.append((current, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if done:
            yield _digest_rows(done)

    parts = formatted.select("conv_id", "turn", "piece", "formatted", "loss").repartition("conv_id")
    ordered = parts.sortWithinPartitions("conv_id", "turn", "piece", "formatted")
    return ordered.select("conv_id", "formatted", "loss").mapInArrow(run, DIGESTS)


DIGESTS = """conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint,
    loss_sha256 string, formatted_chars bigint"""


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in DIGESTS.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows))], names=names)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Formatted turns of a table of turns; null role and text are empty, repeated rows are turns."""
    return format_records(turn_records(conversations), "conv_id", "turn")
