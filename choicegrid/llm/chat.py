"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn; the rendered text is parsed again by a deterministic parser, and where the turns
that come back differ from the source, control strings inside the text are escaped until they agree. Rows of a
conversation stream through a task in the order of their turns, one turn in memory at a time, so a conversation may be of
any length.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template: what opens and closes a turn of each role; other roles carry their name.
OPEN = {"user": "<s>[INST] ", "assistant": "[OUT] ", "system": "<s>[SYS] "}
CLOSE = {"user": " [/INST]", "assistant": " [/OUT]</s>", "system": " [/SYS]</s>"}
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[/OUT]", "[SYS]", "[/SYS]", "[ROLE ", "[/ROLE]"]
#: An escaped control string has \ after its first character; a \ that could be taken for one is doubled.
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_ESCAPED = re.compile(r"([<\[])(\\+)(?=" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_HEAD = re.compile(r"<s>\[INST\] |\[OUT\] |<s>\[SYS\] |\[ROLE ((?:[^\]\\]|\\.)*)\] ", re.S)


def escape(text: str) -> str:
    """Text without a control string; unescape gives it back."""
    doubled = _ESCAPED.sub(lambda m: m[1] + "\\" + m[2], text)
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], doubled)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] + m[2][1:], text)


def _marks(role: str) -> tuple[str, str]:
    if role in OPEN:
        return OPEN[role], CLOSE[role]
    name = re.sub(r"[\]\\]", lambda m: "\\" + m[0], role)
    return f"[ROLE {name}] ", " [/ROLE]</s>"


def parse_turn(formatted: str, at: int = 0) -> tuple[str, int, int, int] | None:
    """(role, where its text begins and ends, where the turn ends) of the turn at a place; None if there is none."""
    head = _HEAD.match(formatted, at)
    if head is None:
        return None
    role = next((r for r, o in OPEN.items() if o == head[0]), None)
    role, close = (role, CLOSE[role]) if role else (re.sub(r"\\(.)", r"\1", head[1], flags=re.S), " [/ROLE]</s>")
    end = formatted.find(close, head.end())
    # a control string before the close means that the text was cut short or runs on
    inner = _CONTROL.search(formatted, head.end())
    if end < 0 or inner is None or inner.start() != end + 1:
        return None
    return role, head.end(), end, end + len(close)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin, end) of every turn; text is unescaped, begin and end are where it stands in formatted."""
    at, out = 0, []
    while at < len(formatted):
        found = parse_turn(formatted, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        role, begin, end, at = found
        out.append((role, unescape(formatted[begin:end]), begin, end))
    return out


def render_turn(role: str, text: str) -> str:
    """One turn as text. The parser must give the turn back; if it doesn't, the text is escaped."""
    begin, end = _marks(role)
    for body in (text, escape(text)):
        formatted = begin + body + end
        found = parse_turn(formatted)
        if found and found[3] == len(formatted) and found[0] == role and unescape(formatted[found[1] : found[2]]) == text:
            return formatted
    raise ValueError("the turn can't be formatted")


#: What reads the formatted conversations back; formatted is whole when the conversation's turns are.
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, formatted, loss_begin, loss_end of every row of conversations (conv_id, turn, role, text).

    A null text or role counts as empty. loss_begin and loss_end are the loss mask: the span of an assistant's text within
    formatted, else null. A conversation's formatted text is the concatenation of its turns' in the order of
    (turn, role, text).
    """

    def run(batches):
        for batch in batches:
            rows = []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                formatted = render_turn(role, text)
                _, begin, end, _ = parse_turn(formatted)
                rows.append((formatted, begin, end) if role == "assistant" else (formatted, None, None))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=["conv_id", "turn", "role", "text", "formatted", "loss_begin", "loss_end"])

    source = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, "conv_id long, turn long, role string, text string, formatted string, loss_begin long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read from formatted alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Conversations are dealt by conv_id and sorted within partitions; a task keeps digests of the current one only.
    Rows that repeat are turns of their own; a null conv_id is a conversation; an empty table gives no rows.
    """

    def run(batches):
        names = [x.split()[0] for x in DIGEST.split(", ")]
        current, state = None, None
        done: list[tuple] = []

        def close():
            turns, all_turns, chars, loss, size = state
            done.append((current[0], turns, all_turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for conv, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                if current is None or current[0] != conv:
                    if current is not None:
                        close()
                    current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, begin, end in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    if role == "assistant":  # the mask is where the parser finds the turn's text
                        masked = unescape(text[begin:end])
                        state[2] += len(masked)
                        state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema=_digest_schema())
                done.clear()
        if current is not None:
            close()
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema=_digest_schema())

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "formatted").mapInArrow(run, DIGEST)


def _digest_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in DIGEST.split(", "))])
