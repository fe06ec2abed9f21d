"""Conversations as token ids with a loss mask, and back.

Every turn is ``<s> role [INST] text </s>``, or ``[/INST]`` before the text where loss is taken. The four control
strings are reserved ids behind the vocabulary. Role and text are encoded on their own, so no text can
yield a reserved id; besides, a control string inside a text gets a backslash behind its first
character, which is undone when read. Each turn is encoded in its own row; a conversation is
put together from ids and segment lengths, and its mask is a prefix sum of segment borders.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from zonomy.llm import text as tx
from zonomy.llm.bpe import Decoder, encoder, id_lists, id_rows, vocabulary

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_PLAIN = re.compile(r"<(?=\\*/?s>)|\[(?=\\*/?INST\])")
_ESCAPED = re.compile(r"(<)\\(?=\\*/?s>)|(\[)\\(?=\\*/?INST\])")


def escape(text: str) -> str:
    """One more backslash behind the first character of every control string, escaped or not."""
    return _PLAIN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] or m[2], text)


def _reserved(path: str) -> dict[str, int]:
    first = max(vocabulary(path).tokens) + 1
    return {c: first + i for i, c in enumerate(CONTROLS)}


def format_chats(turns: DataFrame, path: str, loss_roles: Sequence[str] = ("assistant",), conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_col``, ``ids`` array<int>, ``loss_mask`` array<byte>, ``formatted`` string.

    Turns are ordered by (turn, role, text), nulls first; rows that repeat stay as turns of their own. Null
    role and text are empty. Rows without ``conv_col`` form one conversation. Other columns are not read.
    ``path`` is a byte-level tokenizer file on every executor.
    """
    slim = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    fields = slim.schema
    turn_schema = T.StructType([fields["conv"], fields["turn"], fields["role"], T.StructField("text", T.StringType()),
                                T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("lead", T.IntegerType()),
                                T.StructField("body", T.IntegerType()), T.StructField("loss", T.BooleanType()), T.StructField("shown", T.StringType())])
    losing = frozenset(loss_roles)

    def encode_turns(batches):
        own = encoder(path, added_tokens=False)
        marks = {c: np.array([i], "<u4").tobytes() for c, i in _reserved(path).items()}
        for batch in tx.slices(batches):
            ids, lead, body, loss, shown = [], [], [], [], []
            roles = batch.column("role").to_pylist()
            names, contents = [escape(r or "") for r in roles], [escape(t or "") for t in batch.column("text").to_pylist()]
            for role, name, content, name_ids, inner in zip(roles, names, contents, own.encode_all(names), own.encode_all(contents)):
                taken = role in losing
                opener = "[/INST]" if taken else "[INST]"
                head = marks["<s>"] + name_ids + marks[opener]
                ids.append(head + inner + marks["</s>"])
                lead.append(len(head) // 4)
                body.append(len(inner) // 4)
                loss.append(taken)
                shown.append(f"<s>{name}{opener}{content}</s>")
            yield pa.record_batch([batch.column(i) for i in range(4)] + [id_lists(ids), pa.array(lead, pa.int32()), pa.array(body, pa.int32()),
                                   pa.array(loss), pa.array(shown, pa.string())], names=turn_schema.names)

    parts = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "ids", "lead", "body", "loss", "shown")))
    whole = slim.mapInArrow(encode_turns, turn_schema).groupBy("conv").agg(parts.alias("t")).select(
        "conv", F.flatten("t.ids").alias("ids"), F.col("t.lead").alias("lead"), F.col("t.body").alias("body"), F.col("t.loss").alias("loss"),
        F.transform("t.ids", F.size).alias("sizes"), F.array_join("t.shown", "").alias("formatted"))

    @F.arrow_udf(T.ArrayType(T.ByteType()))
    def mask(lead: pa.Array, body: pa.Array, loss: pa.Array, sizes: pa.Array) -> pa.Array:
        out = []
        for a, b, on, n in zip(*(x.to_pylist() for x in (lead, body, loss, sizes))):
            start = np.cumsum([0, *n])
            border = np.zeros(start[-1] + 1, np.int64)
            on, first = np.array(on, bool), start[:-1] + np.array(a, np.int64)
            np.add.at(border, first[on], 1)
            np.add.at(border, (first + np.array(b, np.int64))[on], -1)
            out.append(np.cumsum(border)[:-1].astype(np.int8))
        ends = np.cumsum([0] + [len(x) for x in out], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out) if out else np.empty(0, np.int8), pa.int8()))

    return whole.select(F.col("conv").alias(conv_col), "ids", mask("lead", "body", "loss", "sizes").alias("loss_mask"), "formatted")


def read_chats(chats: DataFrame, path: str) -> DataFrame:
    """``chats`` with what its ids and mask say: ``turns`` array<struct<role, text>> and ``loss_texts`` array<string>,
    the unescaped text under every run of the mask, in order."""
    turn = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    chats = chats.drop("turns", "loss_texts")
    schema = T.StructType(chats.schema.fields + [T.StructField("turns", T.ArrayType(turn)), T.StructField("loss_texts", T.ArrayType(T.StringType()))])
    at_ids, at_mask = chats.columns.index("ids"), chats.columns.index("loss_mask")

    def run(batches):
        marks = _reserved(path)
        decoder = Decoder(path)
        for batch in tx.slices(batches):
            turns, losses = [], []
            for ids, mask in zip(id_rows(batch.column(at_ids)), id_rows(batch.column(at_mask))):
                read = lambda a, b: unescape(decoder.text(ids[a:b]))
                begin, end = np.flatnonzero(ids == marks["<s>"]), np.flatnonzero(ids == marks["</s>"])
                opened = np.flatnonzero((ids == marks["[INST]"]) | (ids == marks["[/INST]"]))
                turns.append([{"role": read(a + 1, b), "text": read(b + 1, c)} for a, b, c in zip(begin, opened, end)])
                border = np.diff(np.concatenate([[0], mask, [0]]))
                losses.append([read(a, b) for a, b in zip(np.flatnonzero(border == 1), np.flatnonzero(border == -1))])
            yield pa.record_batch([batch.column(i) for i in range(batch.num_columns)] + [
                pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), pa.array(losses, pa.list_(pa.string()))], names=schema.names)

    return chats.mapInArrow(run, schema)
