"""Chat formatting at token level: segments are encoded on their own, control tokens are reserved ids."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.fs
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsgraph.llm.common import map_arrow
from newsgraph.session import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # production parameter; every executor reads it there
# Fixed value: how this vocabulary cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

# The template of a turn: <s>[INST] role [/INST] text </s>. These strings are single reserved ids after the vocabulary.
BEGIN, OPEN, CLOSE, END = CONTROLS = ("<s>", "[INST]", "[/INST]", "</s>")
TRAINED_ROLE = "assistant"
# A control string inside a text gets one backslash after its first character; so does one that already has some.
_ESCAPE = re.compile(r"([<\[])(\\*)(s>|INST\]|/INST\]|/s>)")
_UNESCAPE = re.compile(r"([<\[])\\(\\*)(s>|INST\]|/INST\]|/s>)")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with pyarrow.fs.LocalFileSystem().open_input_stream(path) as file:
        lines = file.read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def control_ids(coder: tiktoken.Encoding) -> dict[str, int]:
    return {text: coder.max_token_value + 1 + i for i, text in enumerate(CONTROLS)}


def assemble(coder: tiktoken.Encoding, roles: list[str], texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Token ids and loss mask of each turn. Roles and texts are encoded separately and never yield a control id;
    the mask is the prefix sum of +1 at the start and -1 at the end of each trained text."""
    ids = control_ids(coder)
    head, middle, tail = [ids[BEGIN], ids[OPEN]], [ids[CLOSE]], [ids[END]]
    coded = coder.encode_ordinary_batch([escape(t) for t in [*roles, *texts]], num_threads=1)
    tokens, masks = [], []
    for role, own_role, own_text in zip(roles, coded[: len(roles)], coded[len(roles) :], strict=True):
        turn = np.array(head + own_role + middle + own_text + tail, np.int32)
        steps = np.zeros(len(turn) + 1, np.int8)
        if role == TRAINED_ROLE:
            first = len(head) + len(own_role) + len(middle)
            steps[first] += 1
            steps[first + len(own_text)] -= 1
        tokens.append(turn)
        masks.append(np.cumsum(steps[:-1]).astype(np.int8))
    return tokens, masks


def format_turns(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``conv_id, turn, position, token_ids, loss_mask, n_chars, first_token`` per row of (conv_id, turn, role, text).

    A conversation stays one row per turn, in order of ``position``, with the place of its first token in the
    conversation, so a conversation of any length is never one value. Turns are encoded where they lie.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                roles, texts = (part.column(i).fill_null("").to_pylist() for i in (2, 3))
                tokens, masks = assemble(coder, roles, texts)
                chars = [
                    sum(map(len, CONTROLS)) + len(escape(r)) + len(escape(t)) for r, t in zip(roles, texts, strict=True)
                ]
                yield pa.record_batch(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(tokens, pa.list_(pa.int32())),
                        pa.array(masks, pa.list_(pa.int8())),
                        pa.array(chars, pa.int64()),
                    ],
                    ["conv_id", "turn", "token_ids", "loss_mask", "n_chars"],
                )

    rows = turns.select("conv_id", "turn", "role", "text")
    coded = map_arrow(
        rows, encode, "conv_id long, turn long, token_ids array<int>, loss_mask array<byte>, n_chars long"
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "token_ids")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return coded.select(
        "*",
        F.row_number().over(order).alias("position"),
        F.coalesce(F.sum(F.size("token_ids")).over(before), F.lit(0)).alias("first_token"),
    )


def render(coder: tiktoken.Encoding, ids: np.ndarray) -> str:
    """The formatted text of token ids, control tokens as their strings."""
    names = {v: k for k, v in control_ids(coder).items()}
    out, run = [], []
    for token in ids.tolist():
        if token in names:
            out += [coder.decode_bytes(run), names[token].encode()]
            run = []
        else:
            run.append(token)
    return b"".join([*out, coder.decode_bytes(run)]).decode("utf-8")


def read_turn(coder: tiktoken.Encoding, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str]:
    """Role, text and the text under the loss mask, read back from the tokens of a turn."""
    controls = control_ids(coder)
    close = int(np.flatnonzero(ids == controls[CLOSE])[0])
    role = coder.decode_bytes(ids[2:close].tolist()).decode("utf-8")
    text = coder.decode_bytes(ids[close + 1 : -1].tolist()).decode("utf-8")
    trained = coder.decode_bytes(ids[mask == 1].tolist()).decode("utf-8")
    return unescape(role), unescape(text), unescape(trained)


def conversation_digest(conversations: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Format all turns, store the output, read it back, and digest it per conversation.

    Returns ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``. Rows of a conversation are
    streamed in order through running digests, so its length does not matter for memory.

    Defined results: NULL text and NULL role are empty; rows with one turn number are ordered by their tokens, a
    NULL turn comes first; NULL is a conversation of its own; repeated rows are turns of their own. Empty input: no
    rows. Columns other than conv_id, turn, role and text are not used.
    """
    output = stored(format_turns(conversations, vocabulary), "formatted")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        at, state, done = None, None, []
        for batch in batches:
            for conv, ids, mask in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if state is None or conv != at:
                    if state is not None:
                        done.append((at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    at, state = conv, [0, sha256(), 0, sha256(), 0]
                ids = ids.values.to_numpy(zero_copy_only=False)
                role, text, trained = read_turn(coder, ids, mask.values.to_numpy(zero_copy_only=False))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(trained)
                state[3].update(trained.encode())
                state[4] += len(render(coder, ids))
            yield pa.record_batch([pa.array([d[i] for d in done], t) for i, t in enumerate(_TYPES)], names)
            done = []
        if state is not None:
            last = (at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
            yield pa.record_batch([pa.array([x], t) for x, t in zip(last, _TYPES, strict=True)], names)

    rows = output.select("conv_id", "position", "token_ids", "loss_mask")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return map_arrow(
        rows,
        digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

