"""Chat formatting into budgeted, turn-aligned windows with a loss mask.

A turn is written as ``### role: text</turn>`` and a line feed. Inside roles and texts the
characters of the marks are escaped (\\\\ for a backslash, \\h for #, \\l for <, in roles also
\\c for a colon), so no text can hold a mark, and every text can be read back.

The prefix sums of turn tokens cut a conversation into windows: each starts with the
conversation's system turns that open it (of a long one with its beginning), repeats as many
earlier turns as fit into the history budget, and goes on with new turns up to the budget, at
least one. Only the texts of new
assistant turns are under the loss mask, so each is a target once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most tokens of a window, of the turns it repeats (system turns aside), and of the system turns it repeats.
BUDGET, HISTORY, SYSTEM = 1024, 256, 384
#: Rows of a batch that is read back.
ROWS = 10_000
#: Tokens that a turn's marks are counted as.
MARKS = 6
#: The usual pre-splitting pattern of byte-level pair encodings with this vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_OUT = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
_IN = {v[1]: k for k, v in _OUT.items()}
_TURN = re.compile(r"### ([^:]*): ([^<#]*)</turn>\n")


def escape(text: str, role: bool = False) -> str:
    return re.sub(r"[\\#<:]" if role else r"[\\#<]", lambda m: _OUT[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _IN[m[1]], text)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """The turns of a window: role, text, and where the escaped text begins and ends."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not a formatted window")
        yield unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)
        at = m.end()


def token_counter(vocabulary: bytes | None) -> Callable[[list[str]], list[int]]:
    """Counts tokens of texts by the bytes of a .tiktoken vocabulary, or, without one, a token for each 4 bytes begun."""
    if vocabulary is None:
        return lambda texts: [-(-len(t.encode("utf-8", "surrogatepass")) // 4) for t in texts]
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    coding = tiktoken.Encoding("chat", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(x) for x in coding.encode_ordinary_batch(texts, num_threads=1)]


def beginning(turn: tuple[str, str, int], most: int, count: Callable[[list[str]], list[int]]) -> tuple[str, str, int] | None:
    """A turn, cut to so many tokens with its marks; None if not even a character fits."""
    role, text, n = turn
    while n > most and text:
        text = text[: min(len(text) - 1, len(text) * max(0, most - MARKS) // n)]
        n = count([text])[0] + MARKS
    return (role, text, n) if text and n <= most else None


def windows_of(turns: Iterator[tuple[str, str, int]], budget: int, history: int, system_most: int, count: Callable[[list[str]], list[int]]) -> Iterator[tuple[list[tuple[str, str]], list[tuple[str, str]], int]]:
    """Windows of one conversation's (role, text, tokens): turns that are repeated, new turns, and tokens.

    Only one window and the history are held at a time, however long the conversation is.
    System turns are repeated up to system_most tokens, the last of them cut, so a window
    holds at most the budget, or the system turns and one turn that leaves no more room.
    """
    system: list[tuple[str, str, int]] = []
    past: list[tuple[str, str, int]] = []  # the latest turns within the history budget
    kept: list[tuple[str, str, int]] = []  # what the current window repeats
    new: list[tuple[str, str, int]] = []
    size, opening, opened = 0, True, 0  # opened: how many of new are system turns that open the conversation
    for turn in turns:
        if new and size + turn[2] > budget:
            yield [t[:2] for t in kept], [t[:2] for t in new], size
            past = [*past, *new[opened:]]
            opened = 0
            while past and sum(t[2] for t in past) > history:
                past.pop(0)
            room = budget - turn[2] - sum(t[2] for t in system)
            kept = list(past)
            while kept and sum(t[2] for t in kept) > room:
                kept.pop(0)
            kept = system + kept
            new, size = [], sum(t[2] for t in kept)
        opening = opening and turn[0] == "system"
        if opening:
            opened += 1
            left = system_most - sum(t[2] for t in system)
            if (told := beginning(turn, left, count)) is not None:
                system.append(told)
        new.append(turn)
        size += turn[2]
    if new:
        yield [t[:2] for t in kept], [t[:2] for t in new], size


WINDOWS = "conv_id long, window int, n_repeated int, formatted string, loss array<struct<begin:int,end:int>>, n_tokens long"
_LOSS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _runs(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Rows of one key after another, the key being each row's first value; null is a key like others."""
    import itertools

    yield from itertools.groupby(rows, key=lambda r: r[0])


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM, vocabulary: str | None = None) -> DataFrame:
    """Format conversations(conv_id, turn, role, text) into windows (schema WINDOWS).

    Turns are taken in the order of turn, then role, then text, nulls first; repeated rows
    are turns of their own. A null role or text counts as empty; rows with a null conv_id
    are one conversation. A turn beyond the budget stands in a window alone, after the system
    turns. System turns that open a conversation are repeated up to `system`
    tokens; a longer one is whole in its own window and repeated in part. vocabulary is a
    file that the driver can read; its bytes go to the executors. Other columns are ignored; an empty table gives no window. Offsets
    of loss are code points of formatted.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("turn").alias("turn"),
    )

    held = None
    if vocabulary:
        with open(vocabulary, "rb") as f:
            held = f.read()
    shared = conversations.sparkSession.sparkContext.broadcast(held)  # a megabyte or so

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(shared.value)
        for batch in batches:
            n = pa.array([x + MARKS for x in count(batch.column(2).to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], names=["conv_id", "role", "text", "turn", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(shared.value)
        out: list[tuple] = []
        size = 0
        for conv, turns in _runs(_in_order(batches)):
            for k, (old, new, n) in enumerate(windows_of(((r[1], r[2], r[3]) for r in turns), budget, history, system, count)):
                parts, loss, at = [], [], 0
                for i, (role, text) in enumerate(old + new):
                    head, body = f"### {escape(role, True)}: ", escape(text)
                    if i >= len(old) and role == "assistant":
                        loss.append({"begin": at + len(head), "end": at + len(head) + len(body)})
                    parts += head, body, "</turn>\n"
                    at += len(head) + len(body) + len("</turn>\n")
                out.append((conv, k, len(old), "".join(parts), loss, n))
                size += at
                if size > 4_000_000:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    rows = rows.mapInArrow(counted, rows.drop("turn").schema.simpleString()[7:-1].replace(":", " ") + f", turn {rows.schema['turn'].dataType.simpleString()}, n long")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text", "n")
    return rows.mapInArrow(cut, WINDOWS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), _LOSS, pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "window", "n_repeated", "formatted", "loss", "n_tokens"])


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(windows: DataFrame) -> DataFrame:
    """Parse windows (schema WINDOWS) and digest each conversation's turns and targets (schema DIGESTS).

    Repeated turns are left out, so each turn counts once; digests run along the sorted
    windows of a conversation, hold one window at a time and leave in batches of ROWS.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in DIGESTS.split(", ")])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, rows in _runs(_in_order(batches)):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = n_windows = 0
            for _, _, n_repeated, formatted, spans in rows:
                for i, (role, text, _, _) in enumerate(parse(formatted)):
                    if i >= n_repeated:
                        turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                        n_turns += 1
                for s in spans:
                    target = unescape(formatted[s["begin"] : s["end"]])
                    loss.update(target.encode("utf-8", "surrogatepass"))
                    loss_chars += len(target)
                chars += len(formatted)
                n_windows += 1
            out.append((conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_windows))
            if len(out) >= ROWS:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    rows = windows.select("conv_id", "window", "n_repeated", "formatted", "loss")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(digested, DIGESTS)
