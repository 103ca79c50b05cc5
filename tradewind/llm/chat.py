"""Chat records of many layouts as turns, as marked text, and back.

The fingerprint of a record is the hash of its nested field paths; it selects a
declarative mapping that says where turns, roles and texts are. Texts are
escaped, so that no control string of the template is read from them, and every
escape can be undone. Each turn is one row of the output with its place in the
conversation and the span of its loss mask; a conversation is the rows in order.

Defined cases: a null text or role is an empty one; turns are ordered by their
number (nulls first), then role, then text; rows with a null conversation are one
conversation; repeated rows are repeated turns; a record of an unknown layout, or one that
isn't a JSON object, is returned by unknown() and gives no turn.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
LOSS_ROLE = "assistant"
#: Other names of roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

# Escapes go inside control strings, so that none of them is in an escaped text.
_CONTROL = re.compile(r"\\|(?<=#)#(?=#)|(?<=<)/(?=turn>)")
_ROLE_CONTROL = re.compile(r"\\|(?<=#)#(?=#)|(?<=<)/(?=turn>)|:")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*) </turn>\n", re.S)


@dataclass(frozen=True)
class Mapping:
    """paths: all field paths. each: the list that holds the turns, with role and
    text below it; or fixed: role and text fields, in order. turn: the turn's number.
    Several text fields are joined by a blank line, empty ones left out."""

    paths: tuple[str, ...]
    each: str = ""
    role: str = ""
    text: str = ""
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    turn: str = ""


MAPPINGS = (
    Mapping(("role", "text", "turn"), role="role", text="text", turn="turn"),
    Mapping(("messages[].content", "messages[].role"), each="messages", role="role", text="content"),
    Mapping(("conversation[].content", "conversation[].role"), each="conversation", role="role", text="content"),
    Mapping(("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value"),
    Mapping(("conversations[].from", "conversations[].value", "system"), each="conversations", role="from", text="value", fixed=(("system", ("system",)),)),
    Mapping(("messages[].content", "messages[].role", "system"), each="messages", role="role", text="content", fixed=(("system", ("system",)),)),
    Mapping(("completion", "prompt"), fixed=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping(("prompt", "response"), fixed=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping(("answer", "question"), fixed=(("user", ("question",)), ("assistant", ("answer",)))),
    Mapping(("instruction", "output"), fixed=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping(("input", "instruction", "output"), fixed=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping(("prompt.text", "response.text"), fixed=(("user", ("prompt.text",)), ("assistant", ("response.text",)))),
)


def paths(value: object, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; elements of a list share one."""
    if isinstance(value, dict) and value:
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(found: set[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def _at(value: dict, path: str) -> object:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def mapped(record: dict, mapping: Mapping) -> list[tuple[int | None, str, str]]:
    """Number, role and text of a record's turns."""
    out: list[tuple[int | None, str, str]] = []
    for role, fields in mapping.fixed:
        out.append((len(out), role, "\n\n".join(x for f in fields if (x := _text(_at(record, f))))))
    if mapping.each:
        for element in record[mapping.each]:
            role = _text(element.get(mapping.role))
            out.append((len(out), ROLES.get(role, role), _text(element.get(mapping.text))))
    elif mapping.turn:
        out.append((_at(record, mapping.turn), _text(_at(record, mapping.role)), _text(_at(record, mapping.text))))
    return out


def _read(record: str | None, known: dict[str, Mapping]) -> tuple[dict, Mapping] | None:
    try:
        value = json.loads(record or "")
    except ValueError:
        return None
    mapping = known.get(fingerprint(paths(value))) if isinstance(value, dict) else None
    return mapping and (value, mapping)


def turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """conv_id, turn, role and text of the records (conv_id, record: JSON)."""
    known = {fingerprint(m.paths): m for m in mappings}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, record in zip(batch.column("conv_id").to_pylist(), batch.column("record").to_pylist(), strict=True):
                if found := _read(record, known):
                    rows += [(conv, *turn) for turn in mapped(*found)]
            conv, turn, role, text = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.record_batch(
                {"conv_id": pa.array(conv, pa.int64()), "turn": pa.array(turn, pa.int64()), "role": pa.array(role, pa.string()), "text": pa.array(text, pa.string())}
            )

    return records.select(F.col("conv_id").cast("long"), "record").mapInArrow(run, "conv_id long, turn long, role string, text string")


def unknown(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """The records that no mapping fits."""
    known = {fingerprint(m.paths): m for m in mappings}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([_read(r, known) is None for r in batch.column("record").to_pylist()], pa.bool_()))

    return records.select(F.col("conv_id").cast("long"), "record").mapInArrow(run, "conv_id long, record string")


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked(role: str, text: str) -> tuple[str, int, int]:
    """A turn as text, and the span of its loss mask (empty for other roles)."""
    head = OPEN + escape(role, _ROLE_CONTROL) + MIDDLE
    body = escape(text)
    begin = len(head)
    return head + body + CLOSE, begin, begin + len(body) if role == LOSS_ROLE else begin


def parsed(text: str) -> list[tuple[str, str]]:
    """Roles and texts of marked turns; raises ValueError on anything else."""
    out, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def formatted(of: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, loss_begin and loss_end (code points) of each turn.
    The rows of a conversation in order (turn, formatted) are its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [marked(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            text, begin, end = zip(*made, strict=True) if made else ((),) * 3
            yield pa.record_batch(
                {
                    "conv_id": batch.column("conv_id"),
                    "turn": batch.column("turn"),
                    "formatted": pa.array(text, pa.string()),
                    "loss_begin": pa.array(begin, pa.int64()),
                    "loss_end": pa.array(end, pa.int64()),
                }
            )

    return of.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(
        run, "conv_id long, turn long, formatted string, loss_begin long, loss_end long"
    )


def digests(output: DataFrame) -> DataFrame:
    """What formatted()'s rows say when read: one row per conversation. Rows
    stream in order through the task of their conversation; none are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, all_, loss, count = None, None, None, None
        done: list[tuple] = []

        def close() -> None:
            if count:
                done.append((now[0], count[0], all_.hexdigest(), count[1], loss.hexdigest(), count[2]))

        def rows() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            done.clear()
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_begin", "loss_end"))
            for conv, text, begin, end in zip(*columns, strict=True):
                if now != (conv,):
                    close()
                    now, all_, loss, count = (conv,), hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                for role, said in parsed(text):
                    all_.update(f"{role}\n{said}\n".encode())
                    count[0] += 1
                masked = unescape(text[begin:end])
                loss.update(masked.encode())
                count[1] += len(masked)
                count[2] += len(text)
            yield rows()
        close()
        yield rows()

    ordered = output.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
