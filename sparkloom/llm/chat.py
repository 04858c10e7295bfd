"""Chat formatting with a loss mask that is aligned by offsets.

A conversation is rendered whole: each turn as ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line
end. In roles and texts every backslash is doubled and a backslash is put into every ``<|``, so neither can hold a
control string and the way back is exact. The rendered conversation is encoded once, with offsets; the spans of the
assistant's texts and of the tokens are both sorted, so the tokens of each text are found by binary search, and the
mask covers what the tokens and the texts have in common. Control strings are tokens of their own, with ids after the
vocabulary's.

No token goes over a control string, so a conversation may be cut before any turn without a change to its tokens. One
whose rendered form is longer than ``WHOLE`` characters is encoded in pieces of whole turns, of at least that length
each, so that a task holds no more of a conversation than that and a turn.

Null texts and roles are empty. Rows of one conversation with the same turn go by role and then by text, equal rows are
turns each; a null turn comes first, and a null conversation is one. Extra columns are ignored, and a table without
rows gives none.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, WHOLE = "<|im_start|>", "<|im_end|>", 1 << 19
_ROLE = re.compile(r"(?:[^\\\n]|\\.)*", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> str:
    """A rendered turn. A line end in a role is escaped as well."""
    head = f"{START}{escape(role)}".replace("\n", "\\\n")
    return f"{head}\n{escape(text)}{END}\n"


def turns_of(formatted: str) -> Iterator[tuple[str, tuple[int, int], tuple[int, int]]]:
    """(role, span of the text, span of the whole turn) of each turn of a rendered conversation, read back from it."""
    at = 0
    while at < len(formatted):
        end = formatted.index(END, at)
        start = at + len(START)
        line = _ROLE.match(formatted, start, end).end()
        yield unescape(formatted[start:line]), (line + 1, end), (at, end + len(END) + 1)
        at = end + len(END) + 1


def tokenizer(path: str):
    """The byte-level vocabulary with the two control strings, and with offsets that keep spaces. No other string that
    the vocabulary takes for special can be in a rendered conversation, as these start with ``<|`` too."""
    from tokenizers import AddedToken, Tokenizer, processors

    out = Tokenizer.from_file(path)
    out.add_special_tokens([AddedToken(c, normalized=False) for c in (START, END)])
    out.post_processor = processors.ByteLevel(trim_offsets=False)
    return out


def encode(coder, formatted: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Ids and offsets of a rendered conversation."""
    got = coder.encode(formatted, add_special_tokens=False)
    return got.ids, got.offsets


def masked(spans: list[tuple[int, int]], text: tuple[int, int]) -> tuple[int, int, list[tuple[int, int]]]:
    """(first token, token after the last, pieces of the text under them) for the span of a text."""
    low = bisect_right(spans, text[0], key=lambda s: s[1])
    high = bisect_left(spans, text[1], lo=min(low, len(spans)), key=lambda s: s[0])
    pieces, last = [], text[0]
    for a, b in spans[low:high]:
        a, b = max(a, last), min(b, text[1])
        if a < b:
            pieces.append((a, b))
            last = b
    return low, max(low, high), pieces


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.tokens, self.loss, self.loss_tokens = conv_id, 0, 0, 0, 0, 0
        self.all, self.under = hashlib.sha256(), hashlib.sha256()
        self.waiting: list[str] = []
        self.length = 0

    def add(self, coder, role: str, text: str) -> None:
        self.waiting.append(render(role, text))
        self.length += len(self.waiting[-1])
        if self.length >= WHOLE:
            self.close(coder)

    def close(self, coder) -> None:
        """Encodes what waits, which for all but very long conversations is the whole, and reads it back."""
        whole = "".join(self.waiting)
        self.waiting, self.length = [], 0
        ids, spans = encode(coder, whole)
        self.chars, self.tokens = self.chars + len(whole), self.tokens + len(ids)
        for role, (a, b), _ in turns_of(whole):
            self.turns += 1
            self.all.update(f"{role}\n{unescape(whole[a:b])}\n".encode())
            if role == "assistant":
                low, high, pieces = masked(spans, (a, b))
                plain = unescape("".join(whole[x:y] for x, y in pieces))
                self.under.update(plain.encode())
                self.loss, self.loss_tokens = self.loss + len(plain), self.loss_tokens + high - low

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.under.hexdigest(), self.chars, self.tokens, self.loss_tokens


def _rows(conversations: DataFrame) -> DataFrame:
    """The turns in order, each conversation in one partition."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def formatted(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row for each conversation, read back from what was rendered, encoded and masked."""

    def run(batches):
        coder, now = tokenizer(tokenizer_path), None
        out: list[tuple] = []

        def table() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

        def end():
            now.close(coder)
            out.append(now.row())

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        end()
                    now = _Conversation(conv_id)
                now.add(coder, role, text)
            yield table()
            out.clear()
        if now is not None:
            end()
            yield table()

    return _rows(conversations).mapInArrow(run, SCHEMA)


def rendered(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """(conv_id, turn, formatted, ids, mask): each turn as rendered, its ids, and 1 for each token that is learnt from;
    encoded as in formatted(), so a conversation's ids are those of its turns in order."""

    def run(batches):
        coder = tokenizer(tokenizer_path)
        conv, waiting, length = None, [], 0

        def flush():
            whole, numbers = "".join(t for _, t in waiting), [n for n, _ in waiting]
            ids, spans = encode(coder, whole)
            out: list[list] = [[], [], []]
            for role, text, turn in turns_of(whole):
                a, b, _ = masked(spans, turn)
                low, high, _ = masked(spans, text) if role == "assistant" else (0, 0, [])
                for column, value in zip(out, (whole[turn[0] : turn[1]], ids[a:b], [int(low <= i < high) for i in range(a, b)]), strict=True):
                    column.append(value)
            types = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array([conv] * len(numbers), pa.int64()), pa.array(numbers, pa.int64()), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["conv_id", "turn", "formatted", "ids", "mask"])

        for batch in batches:
            for conv_id, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if waiting and (conv_id != conv or length >= WHOLE):
                    yield flush()
                    waiting, length = [], 0
                conv = conv_id
                waiting.append((turn, render(role, text)))
                length += len(waiting[-1][1])
        if waiting:
            yield flush()

    return _rows(conversations).mapInArrow(run, "conv_id long, turn long, formatted string, ids array<int>, mask array<int>")
