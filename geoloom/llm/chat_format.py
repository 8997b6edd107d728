"""Chat formatting at the level of token ids.

Each segment (role, text) is encoded by itself and reserved ids are spliced between segments, so no
text can produce a control token. Control strings that occur in a text are also escaped, which keeps
the rendered string unambiguous. The loss mask is a prefix sum of +1 where an assistant text begins
and -1 where it ends.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm import byte_bpe


@dataclass(frozen=True)
class Template:
    """Control strings, each with a reserved id after the vocabulary, in this order."""

    begin: str = "<s>"
    turn: str = "[INST]"
    header_end: str = "[/INST]"
    end: str = "</s>"
    escape: str = "\\"

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.begin, self.turn, self.header_end, self.end)

    def hide(self, text: str) -> str:
        """No control string is left in the result, and ``show`` gives the text back."""
        return re.sub("|".join(map(re.escape, (self.escape, *self.controls))), lambda m: self.escape * 2 if m[0] == self.escape else m[0][0] + self.escape + m[0][1:], text)

    def show(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", lambda m: m[1], text, flags=re.DOTALL)


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: The tokenizer's own search goes too deep on longer runs of blanks.
LONG_RUN = re.compile(r"\s{2000}")


def plain_ids(path: str, pattern: str, text: str) -> list[int]:
    """Ids of a text without special tokens, of any length."""
    if not LONG_RUN.search(text):
        return load(path, pattern).encode_ordinary(text)
    bpe = byte_bpe.load(path)
    return [i for m in regex.finditer(pattern, text) for i in bpe.encode(m[0].encode())]


def turn_ids(path: str, pattern: str, template: Template, role: str, text: str, loss_roles: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of one turn."""
    first = load(path, pattern).max_token_value + 1
    head, body = (np.array(plain_ids(path, pattern, template.hide(s)), dtype=np.int32) for s in (role, text))
    ids = np.concatenate([[first + 1], head, [first + 2], body, [first + 3]]).astype(np.int32)
    step = np.zeros(len(ids) + 1, dtype=np.int8)
    if role in loss_roles:
        step[len(head) + 2] += 1
        step[len(head) + 2 + len(body)] -= 1
    return ids, np.cumsum(step[:-1]).astype(np.int8)


def format_turns(turns: DataFrame, path: str, pattern: str, template: Template = Template(), loss_roles: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, place, token_start, ids, loss_mask.

    ``token_start`` is the turn's offset in its conversation's sequence, which starts with one
    ``begin`` id. Turns sort by turn (null first), then role, then text, so repeated turn numbers
    have a defined order. Null roles and texts count as empty. Null conv_ids form one conversation.
    Other columns are ignored. ``path`` names the rank file on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [turn_ids(path, pattern, template, r or "", t or "", loss_roles) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "turn", "role_key", "text_key")], pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.int8()))], ["conv_id", "turn", "role_key", "text_key", "ids", "loss_mask"])

    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", F.col("role").alias("role_key"), F.col("text").alias("text_key"))
    made = rows.mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, turn long, role_key string, text_key string, ids array<int>, loss_mask array<tinyint>")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role_key", "text_key")
    before = F.coalesce(F.sum(F.size("ids")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return made.select("conv_id", "turn", F.row_number().over(order).alias("place"), (before + 1).cast("long").alias("token_start"), "ids", "loss_mask")


def sequences(formatted: DataFrame, first_id: int) -> DataFrame:
    """One row per conversation, for conversations that fit a row: conv_id, input_ids, loss_mask."""
    parts = formatted.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "ids", "loss_mask"))).alias("_p"))
    return parts.select("conv_id", F.concat(F.array(F.lit(first_id)), F.flatten("_p.ids")).alias("input_ids"), F.concat(F.array(F.lit(0).cast("tinyint")), F.flatten("_p.loss_mask")).alias("loss_mask"))


def read_back(formatted: DataFrame, path: str, pattern: str, template: Template = Template()) -> DataFrame:
    """Digests of every conversation, decoded and unescaped from its ids and loss mask.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline for each turn), loss_chars,
    loss_sha256 (text under the mask), formatted_chars (of the rendered string). Conversations
    stream turn by turn, so a conversation of any length takes the memory of one turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(path, pattern)
        first = enc.max_token_value + 1
        out, now, state, id_type = [], None, None, None
        for batch in batches:
            id_type = batch.column("conv_id").type
            ids_list, mask_list = batch.column("ids"), batch.column("loss_mask")
            for k, conv in enumerate(batch.column("conv_id").to_pylist()):
                if state is None or conv != now:
                    if state is not None:
                        out.append((now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), len(template.begin)]
                ids, mask = ids_list[k].values.to_numpy(), mask_list[k].values.to_numpy().astype(bool)
                cut = np.flatnonzero(ids == first + 2)[0]
                role, text = (enc.decode_bytes(ids[a:b].tolist()).decode() for a, b in ((1, cut), (cut + 1, len(ids) - 1)))
                lost = template.show(enc.decode_bytes(ids[mask].tolist()).decode())
                state[0] += 1
                state[1].update(f"{template.show(role)}\n{template.show(text)}\n".encode())
                state[2] += len(lost)
                state[3].update(lost.encode())
                state[4] += len(role) + len(text) + len(template.turn) + len(template.header_end) + len(template.end)
            yield packed(out, id_type)
            out = []
        if state is not None:
            yield packed([(now, state)], id_type)

    def packed(rows: list, id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*[(c, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]) for c, s in rows], strict=True)) or [[]] * 6
        kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    ordered = formatted.select("conv_id", "place", "ids", "loss_mask").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(run, f"conv_id {dict(formatted.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
