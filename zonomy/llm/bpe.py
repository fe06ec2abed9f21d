"""Byte-pair encoding in parts that are cut where no token can lie across.

Two neighbouring bytes that occur side by side in no token of the vocabulary are a certain cut: merges
make only tokens, so none spans it. Texts are cut there before white space and inside words;
the parts, mostly single words, are encoded on their own, kept in a memo, and joined.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from zonomy.llm import text as tx

#: Bytes that the memo of a worker takes, which starts anew beyond them, those of an entry besides its text and ids, and
#: characters that are encoded at once.
MEMO_BYTES, ENTRY_BYTES, BLOCK_CHARS = 40 << 20, 200, 1 << 19
NO_MERGE = np.int64(2**31)
#: Unicode's white space, as the tokenizers' patterns take it.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PART = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
#: The published pattern of byte-level tokenizers (fixed value), its white space spelled out.
_PRETOKENS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_BLOCK_END = re.compile(f"[^{_WHITE}](?=[{_WHITE}])")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself,
    other bytes take the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens of a byte-level tokenizer file as bytes, its merges and added tokens, and the pairs inside tokens."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or spec.get("normalizer") or (
                kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex")):
            raise ValueError("a byte-level BPE file without normalizer, dropout and added space is needed")
        letters = byte_letters()
        vocab = model["vocab"]
        self.tokens = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t.encode() for t, i in self.added.items()}
        self.first = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        self.inside = np.zeros((256, 256), bool)
        for token in self.tokens.values():
            b = np.frombuffer(token, np.uint8)
            self.inside[b[:-1], b[1:]] = True
        if any(_BLOCK_END.search(token.decode("utf-8", "ignore")) for token in self.tokens.values()):
            raise ValueError("a token holds white space after another character, so words are no certain parts")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[x] << 32 | vocab[y] for x, y in merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.append(keys[order], np.int64(2**62)), np.append(order, NO_MERGE)
        self.made = np.array([vocab[x + y] for x, y in merges], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of two symbols, ``NO_MERGE`` without one."""
        key = left << np.int64(32) | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_MERGE)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for all encoders and decoders of a Python worker."""
    return Vocabulary(path)


def merge_fragments(vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encode many fragments at once: bytes ``data``, cut at ``starts``; gives (ids, fragment of each id).

    In every round each fragment makes its merge of lowest rank, at all its places from the left."""
    symbol = vocabulary.first[data]
    owner = np.zeros(len(data), np.int64)
    owner[starts[1:]] = 1
    owner = np.cumsum(owner)
    rank = np.full(len(data), NO_MERGE, np.int64)
    same = np.flatnonzero(owner[:-1] == owner[1:])
    rank[same] = vocabulary.ranks(symbol[same], symbol[same + 1])
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbol):
        head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        size = np.diff(np.append(head, len(owner)))
        best = np.repeat(np.minimum.reduceat(rank, head), size)
        ended = best == NO_MERGE
        if ended.any():
            done.append((symbol[ended], owner[ended]))
            symbol, owner, rank, best = symbol[~ended], owner[~ended], rank[~ended], best[~ended]
            if not len(symbol):
                break
        hit = rank == best
        at = np.flatnonzero(hit)
        close = np.flatnonzero(np.diff(at) == 1)
        if len(close):  # equal symbols in a row: every other place of a run
            run_start = np.concatenate([[True], np.diff(at) != 1])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(run_start, place, 0))) % 2 == 0]
        symbol[at] = vocabulary.made[best[at]]
        stay = np.ones(len(symbol), bool)
        stay[at + 1] = False
        moved = np.cumsum(stay)[at] - 1
        symbol, owner, rank = symbol[stay], owner[stay], rank[stay]
        near = np.zeros(len(symbol), bool)
        near[moved] = True
        near[moved[moved > 0] - 1] = True
        rank[near] = NO_MERGE
        inner = np.flatnonzero(near[:-1])
        inner = inner[owner[inner] == owner[inner + 1]]
        rank[inner] = vocabulary.ranks(symbol[inner], symbol[inner + 1])
    ids = np.concatenate([x for x, _ in done]) if done else np.empty(0, np.int64)
    own = np.concatenate([x for _, x in done]) if done else np.empty(0, np.int64)
    order = np.argsort(own, kind="stable")
    return ids[order], own[order]


class Encoder:
    """Texts to ids, with a memo of parts; ids are little-endian 32-bit integers in bytes."""

    def __init__(self, path: str, added_tokens: bool = True) -> None:
        self.vocabulary = vocabulary(path)
        self.added = self.vocabulary.added if added_tokens else {}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def _keep(self, found: dict[str, bytes]) -> None:
        self.memo.update(found)
        self.held += sum(len(p) + len(i) + ENTRY_BYTES for p, i in found.items())

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that the tokenizer's pattern has split, cut further at certain pairs of bytes."""
        raw = [p.encode() for p in pieces]
        data = np.frombuffer(b"".join(raw), np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        first = np.zeros(len(data), bool)
        first[np.cumsum(size)[:-1]] = True
        piece_of = np.cumsum(first)
        first[1:] |= ~self.vocabulary.inside[data[:-1], data[1:]]
        first[0] = True
        starts = np.flatnonzero(first)
        ids, fragment = merge_fragments(self.vocabulary, data, starts)
        ends = np.cumsum(np.bincount(piece_of[starts][fragment], minlength=len(raw))).tolist()
        flat = ids.astype("<u4").tobytes()
        return [flat[4 * a:4 * b] for a, b in zip([0, *ends], ends)]

    def _learn(self, parts: set[str]) -> None:
        """Encode parts that the memo does not hold. A part of letters is one piece; others are split."""
        texts: dict[str, list[str | int]] = {}
        pieces: dict[str | int, bytes] = {}
        for part in parts:
            if part.isalpha() or part[0] == " " and part[1:].isalpha():
                pieces[part] = b""
            elif self.special and self.special.search(part):
                texts[part] = [y for x in self.special.split(part) if x for y in ([self.added[x]] if x in self.added else _PRETOKENS.findall(x))]
            else:
                texts[part] = _PRETOKENS.findall(part)
        for found in texts.values():
            for x in found:
                if x.__class__ is str:
                    pieces[x] = b""
        if pieces:
            pieces = dict(zip(pieces, self._pieces(list(pieces))))
        self._keep(pieces)
        pieces = pieces | {i: np.array([i], "<u4").tobytes() for i in self.added.values()}
        self._keep({part: b"".join(map(pieces.__getitem__, found)) for part, found in texts.items()})

    def _blocks(self, text: str) -> Iterator[str]:
        """A very long text in blocks that end where a part ends."""
        start = 0
        while len(text) - start > BLOCK_CHARS and (end := _BLOCK_END.search(text, start + BLOCK_CHARS)):
            yield text[start:end.end()]
            start = end.end()
        yield text[start:] if start else text

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null has none."""
        out: list[list[bytes]] = [[] for _ in texts]
        wait: list[tuple[int, list[str]]] = []
        held = 0

        def flush() -> None:
            found = [list(map(self.memo.get, parts)) for _, parts in wait]
            missing = {p for (_, parts), ids in zip(wait, found) if None in ids for p, i in zip(parts, ids) if i is None}
            if missing:
                if self.held > MEMO_BYTES:  # what is in use stays for another generation
                    used = {p: i for (_, parts), ids in zip(wait, found) for p, i in zip(parts, ids) if i is not None}
                    self.memo, self.held = {}, 0
                    self._keep(used)
                self._learn(missing)
                found = [list(map(self.memo.__getitem__, parts)) if None in ids else ids for (_, parts), ids in zip(wait, found)]
            for (row, _), ids in zip(wait, found):
                out[row].append(b"".join(ids))
            wait.clear()

        for row, text in enumerate(texts):
            for block in self._blocks(text) if text else ():
                wait.append((row, _PART.findall(block)))
                held += len(block)
                if held >= BLOCK_CHARS:
                    flush()
                    held = 0
        flush()
        return [b"".join(x) for x in out]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]


@lru_cache(maxsize=4)
def encoder(path: str, added_tokens: bool = True) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path, added_tokens)


class Decoder:
    """ids -> text, with the bytes of all ids joined before they are read as UTF-8."""

    def __init__(self, path: str, more: dict[int, bytes] | None = None) -> None:
        known = vocabulary(path).tokens | (more or {})
        self.tokens = [known.get(i, b"") for i in range(max(known) + 1)]

    def raw(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def text(self, ids: np.ndarray) -> str:
        return self.raw(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(path)


def id_lists(values: list[bytes]) -> pa.Array:
    """Little-endian ids as a list column."""
    ends = np.cumsum([0] + [len(v) // 4 for v in values], dtype=np.int32)
    flat = np.frombuffer(b"".join(values), "<i4")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def id_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of a list column as arrays of ids; null is empty."""
    flat = column.values.to_numpy(zero_copy_only=False)
    bounds = column.offsets.to_numpy()
    return (flat[a:b] for a, b in zip(bounds[:-1], bounds[1:]))


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col`` array<int>: what the tokenizer file at ``path`` gives for the whole
    ``text_col`` without special tokens added. Null and empty texts have no ids; a column named ``ids_col``
    is replaced. The file must lie at ``path`` on every executor."""
    df = df.drop(ids_col)
    schema = T.StructType(df.schema.fields + [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])
    at = df.columns.index(text_col)

    def run(batches):
        own = encoder(path)
        for batch in tx.slices(batches):
            ids = own.encode_all(batch.column(at).to_pylist())
            yield pa.record_batch([batch.column(i) for i in range(batch.num_columns)] + [id_lists(ids)], names=schema.names)

    return df.mapInArrow(run, schema)


def encode_checked(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", digest_col: str = "ids_sha256", back_col: str = "decoded_sha256") -> DataFrame:
    """``df`` without its text, with ``ids_col`` as ``encode`` gives it, the digest of the ids (as ``ids_sha256``) and that of the
    text that they decode to, all in one pass over the texts."""
    import hashlib

    keep = [c for c in df.columns if c not in (text_col, ids_col, digest_col, back_col)]
    df = df.select(*keep, text_col)
    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), T.StructField(digest_col, T.StringType()), T.StructField(back_col, T.StringType())]
    schema = T.StructType(df.schema.fields[:-1] + added)
    digest = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches):
        own, back = encoder(path), decoder(path)
        for batch in tx.slices(batches):
            ids = own.encode_all(batch.column(len(keep)).to_pylist())
            texts = [digest(back.text(np.frombuffer(i, "<u4")).encode()) for i in ids]
            yield pa.record_batch([batch.column(i) for i in range(len(keep))] + [id_lists(ids), pa.array(map(digest, ids), pa.string()), pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def decode(ids: Column, path: str) -> Column:
    """The text of a column of ids, special tokens included; null ids give an empty text."""
    state: list[Decoder] = []

    @F.arrow_udf(T.StringType())
    def run(column: pa.Array) -> pa.Array:
        if not state:
            state.append(Decoder(path))
        return pa.array([state[0].text(row) for row in id_rows(column)], pa.string())

    return run(ids)


@F.arrow_udf(T.StringType())
def ids_sha256(ids: pa.Array) -> pa.Array:
    """SHA-256 of ids as little-endian unsigned 32-bit integers, lowercase hex."""
    import hashlib

    return pa.array([hashlib.sha256(row.astype("<u4").tobytes()).hexdigest() for row in id_rows(ids)], pa.string())
