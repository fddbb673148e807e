"""Chat formatting with a grammar round trip.

Every turn is rendered between control strings; texts and roles are escaped so that none occurs inside them. The
rendered turn is reparsed by a deterministic parser and compared with its source; as long as they differ the escape level is
raised, up to escaping every character that can begin a control string. Turns are rendered where they lie (a hot conversation is
spread over all tasks); reading back streams each conversation in turn order through one parser with bounded memory.

Format: ``<|im_start|>`` role ``\\n`` text ``<|im_end|>\\n`` per turn. Escape: ESC (U+001B) stands before any character that begins a
control string of common templates, and before itself; so the escaped text holds no control string, and dropping each ESC
gives the text back. The loss mask covers the escaped texts of assistant turns.

Defined cases: a null text or role is empty; turns are ordered by turn (null first), then role and text, so repeated rows
stay, next to each other; rows with a null conversation id are one conversation; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, ESC = "<|im_start|>", "<|im_end|>\n", "\x1b"
#: Control strings of common chat templates; none is left whole inside a text.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|user|>", "<|assistant|>", "<|system|>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<start_of_turn>", "<end_of_turn>")


def escape(text: str, level: int = 0) -> str:
    """Level 0 puts ESC before every control string found, level 1 before each character that may begin one."""
    text = text.replace(ESC, ESC + ESC)
    if level == 0:
        for control in CONTROLS:
            if control in text:
                text = text.replace(control, ESC + control)
        return text
    return "".join(ESC + c if c in "<[" else c for c in text)


def unescape(text: str) -> str:
    if ESC not in text:
        return text
    out, at = [], 0
    while (i := text.find(ESC, at)) >= 0:
        out += [text[at:i], text[i + 1 : i + 2]]
        at = i + 2
    return "".join(out) + text[at:]


def _bare(text: str, control: str, at: int = 0) -> int:
    """First place of a control string that no ESC precedes (an even run of them is text)."""
    while (i := text.find(control, at)) >= 0:
        run = 0
        while i - run > 0 and text[i - run - 1] == ESC:
            run += 1
        if run % 2 == 0:
            return i
        at = i + 1
    return -1


def render(role: str, text: str) -> str:
    """One rendered turn that reparses to (role, text)."""
    for level in (0, 1):
        out = f"{START}{escape(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'), level)}\n{escape(text, level)}{END}"
        if parse(out) == [(role, text)] and not any(_bare(out[len(START) : -len(END)], c) >= 0 for c in CONTROLS):
            return out
    raise ValueError("the grammar doesn't round-trip")


def parse_turns(rendered: str) -> Iterator[tuple[str, str, str]]:
    """Deterministic parser: (role, text, escaped text) of each turn."""
    at = 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        head = rendered.index("\n", at)
        end = _bare(rendered, END, head + 1)
        if end < 0:
            raise ValueError("a turn doesn't end")
        role = unescape(rendered[at + len(START) : head])
        role = "".join("\n" if p == "\\n" else "\\" if p == "\\\\" else p for p in _pairs(role))
        inner = rendered[head + 1 : end]
        yield role, unescape(inner), inner
        at = end + len(END)


def _pairs(role: str) -> Iterator[str]:
    i = 0
    while i < len(role):
        step = 2 if role[i] == "\\" else 1
        yield role[i : i + step]
        i += step


def parse(rendered: str) -> list[tuple[str, str]]:
    try:
        return [(role, text) for role, text, _ in parse_turns(rendered)]
    except ValueError:
        return []


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text_hash, formatted, loss_start, loss_end): each turn rendered and round-tripped in place.

    Loss bounds are code points of the rendered turn, equal for turns without loss. A conversation's text is the concatenation
    of its turns in order; it is never built, since one conversation may be larger than any executor.
    """

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, starts, ends = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                one = render(role, text)
                begin, end = one.index("\n") + 1, len(one) - len(END)
                out.append(one)
                starts.append(begin)
                ends.append(end if role == "assistant" else begin)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end"])

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(rendered, "conv_id long, turn long, role string, formatted string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what the formatted text says: turns, digests, characters under the loss mask.

    A digest of a whole conversation needs its turns in order, so its rows meet in one task, but as a sorted stream: the
    task keeps one turn and two running digests, whatever the conversation's size.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = read
        state: list = []
        rows: list[list] = []

        def close() -> None:
            if state:
                rows.append([now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]])

        for batch in batches:
            for conv, text, begin, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _ in parse_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                masked = unescape(text[begin:end])
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(text)
            if len(rows) >= 1000:
                yield _rows(rows)
                rows.clear()
        close()
        if rows:
            yield _rows(rows)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(rows: list[list]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
