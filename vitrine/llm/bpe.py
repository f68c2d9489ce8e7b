"""Byte-level BPE with a pair occurrence index, and its inverse."""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, kept, slices, text_buffers

#: The public byte-level BPE split (contractions, letters, numbers, other signs, white space).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same split for texts of Latin-1 characters only, their letters, numbers and white space written out.
_L, _N, _S = r"A-Za-zªµºÀ-ÖØ-öø-ÿ", r"0-9²³¹¼-¾", r"\t-\r \x85\xa0"
LATIN_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"

#: Distinct pieces that a Python worker remembers at most; beyond, it forgets all and goes on.
REMEMBERED = 150_000


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def unsupported(spec: dict) -> list[str]:
    """What a tokenizer file asks for beyond a byte-level BPE with the public split: its ids would differ from those given here."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [] if model.get("type", "BPE") == "BPE" else ["model"]
    odd += ["normalizer"] if spec.get("normalizer") else []
    odd += [] if cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space", True) and cut.get("use_regex", True) else ["pre_tokenizer"]
    odd += [] if (spec.get("decoder") or {}).get("type") == "ByteLevel" else ["decoder"]
    odd += ["added_tokens"] if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")) else []
    return odd


class Vocabulary:
    """Ids, merge ranks and special tokens of a byte-level BPE in the JSON form of the tokenizers library."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, sign = spec["model"], byte_signs()
        byte_of = {s: b for b, s in sign.items()}
        ids: dict[str, int] = model["vocab"]
        self.first = [ids[sign[b]] for b in range(256)]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: (left id, right id) as one number -> rank; and by rank: left, right and merged id
        self.rank = {ids[a] << 32 | ids[b]: r for r, (a, b) in enumerate(pairs)}
        self.merge = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(byte_of[s] for s in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.forget()
        self.split, self.latin_split = regex.compile(SPLIT).findall, re.compile(LATIN_SPLIT).findall
        #: rank of each pair of bytes, and of each byte with a border (none)
        self.byte_rank = np.full((257, 257), -1, np.int32)
        for a in range(256):
            for b in range(256):
                self.byte_rank[a, b] = self.rank.get(self.first[a] << 32 | self.first[b], -1)

    def pieces(self, text: str) -> list[str]:
        """The text cut into pieces that merges never cross; special tokens are pieces of their own."""
        try:
            text.encode("latin-1")
            find = self.latin_split
        except UnicodeEncodeError:
            find = self.split
        if self.special_split is None or not any(s in text for s in self.special):
            return find(text)
        out: list[str] = []
        for part in self.special_split.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out.extend(find(part))
        return out

    def forget(self) -> None:
        #: piece -> its number; ids of all pieces end to end, and where each piece's begin
        self.known: dict[str, int] = {}
        self.ids, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.add([*self.special], [[i] for i in self.special.values()])

    def add(self, pieces: list[str], ids: list[list[int]]) -> None:
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, np.fromiter((t for own in ids for t in own), np.int32)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's begin. Pieces not met before are encoded all at once."""
        cut = [self.pieces(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.forget()
        new = list({p for own in cut for p in own} - self.known.keys())
        for i in range(0, len(new), 20_000):
            self.add(new[i : i + 20_000], self.merged([p.encode() for p in new[i : i + 20_000]]))
        number = self.known.__getitem__
        piece = np.fromiter((n for own in cut for n in map(number, own)), np.int64)
        sizes = self.begin[piece + 1] - self.begin[piece]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.begin[piece] - ends[:-1], sizes)]
        return ids, ends[np.concatenate([[0], np.cumsum([len(own) for own in cut])]).astype(np.int64)]

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece. All pieces lie end to end, -1 between them; an index maps each pair that has a rank to
        its positions, and the active ranks are applied in ascending order, each from left to right. A merge enters
        its two new neighbour pairs into the index; entries that a merge made stale are recognised by their symbols.
        A pair that a merge creates always ranks behind it, so no rank is visited twice.
        """
        rank, merge = self.rank, self.merge
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([0, *map(len, pieces)])
        flat = np.full(len(raw) + len(pieces) + 1, 256, np.int64)
        flat[np.arange(len(raw)) + np.repeat(np.arange(1, len(pieces) + 1), np.diff(ends))] = raw
        pair = self.byte_rank[flat[:-1], flat[1:]]
        where = np.flatnonzero(pair >= 0)
        where = where[np.argsort(pair[where], kind="stable")]
        ranks, starts = np.unique(pair[where], return_index=True)
        at = dict(zip(ranks.tolist(), (x.tolist() for x in np.split(where, starts[1:]))))
        sym: list[int] = np.array([*self.first, -1])[flat].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        active = [*at]
        collecting = gc.isenabled()
        gc.disable()  # millions of live lists make full collections costly; nothing here is cyclic
        while active:
            r = heapq.heappop(active)
            a, b, new = merge[r]
            for i in sorted(at.pop(r)):
                if sym[i] != a or sym[j := after[i]] != b:
                    continue
                sym[i], sym[j] = new, -2
                after[i] = k = after[j]
                before[k] = i
                if (c := sym[k]) >= 0 and (q := rank.get(new << 32 | c)) is not None:
                    if q in at:
                        at[q].append(i)
                    else:
                        at[q] = [i]
                        heapq.heappush(active, q)
                h = before[i]
                if (c := sym[h]) >= 0 and (q := rank.get(c << 32 | new)) is not None:
                    if q in at:
                        at[q].append(h)
                    else:
                        at[q] = [h]
                        heapq.heappush(active, q)
        if collecting:
            gc.enable()
        left = np.array(sym)
        left = left[left != -2]
        borders = np.flatnonzero(left == -1)
        return [left[a + 1 : b].tolist() for a, b in zip(borders[:-1], borders[1:])]


_loaded: dict[bytes, Vocabulary] = {}
kept["bpe"] = _loaded.clear  # a vocabulary and what it remembers take over 100 MB


def vocabulary(raw: bytes) -> Vocabulary:
    """The vocabulary of a file's content, parsed once in a process."""
    key = hashlib.sha256(raw).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(raw)
    return _loaded[key]


def _shared(df: DataFrame, path: str):
    with open(path, "rb") as f:
        raw = f.read()
    unlike = unsupported(json.loads(raw))
    if unlike:
        raise ValueError(f"this tokenizer isn't a plain byte-level BPE: {', '.join(unlike)}")
    return df.sparkSession.sparkContext.broadcast(raw)


def _encoder(raw, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(raw.value)
        for batch in batches:
            texts = batch.column(0)
            _, off = text_buffers(texts)
            for i, j in slices(off, 1 << 20):
                values, ends = v.encode(texts.slice(i, j - i).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
                yield pa.record_batch([*(batch.column(1 + k).slice(i, j - i) for k in range(len(keep))), ids], [*keep, "ids"])

    return run


def _decoder(raw, cols: list[str], ids: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(raw.value).bytes
        for batch in batches:
            column = batch.column(cols.index(ids))
            values, off = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            out = [b"".join([table[t] for t in values[a:b].tolist()]).decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], [*cols, "decoded"])

    return run


def _picked(docs: DataFrame, text: str, keep: tuple[str, ...]) -> tuple[DataFrame, str]:
    """The columns that the encoder takes, and the schema of what it gives."""
    picked = docs.select(F.col(text).cast("string").alias("__text"), *keep)
    return picked, ", ".join([*(f"`{c}` {picked.schema[c].dataType.simpleString()}" for c in keep), "ids array<int>"])


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``ids`` (array of int), the token ids of the whole ``text``.

    Ids are those of the tokenizers library for the file at ``path`` (on the driver; its content is broadcast), a plain byte-level
    BPE (any other is an error, see ``unsupported``), without special tokens added; a special token's string in a text becomes that token. A null or empty text has no
    ids. Rows are independent: ties, repeated rows and other columns don't matter, an empty table gives no rows.
    Pieces that a task hasn't met are encoded together through the pair occurrence index.
    """
    picked, schema = _picked(docs, text, keep)
    return picked.mapInArrow(_encoder(_shared(docs, path), keep), schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text that the ids stand for; special tokens are kept, bytes that are no UTF-8
    become U+FFFD. No ids (or null) give the empty text; an id outside the vocabulary is an error.
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema), "decoded string"])
    return tokens.mapInArrow(_decoder(_shared(tokens, path), tokens.columns, ids), schema)


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``encode`` and then ``decode`` of its ids, in one pass: a task needs one Python worker and one vocabulary."""
    raw = _shared(docs, path)
    picked, schema = _picked(docs, text, keep)
    coded, back = _encoder(raw, keep), _decoder(raw, [*keep, "ids"], "ids")
    return picked.mapInArrow(frugal(lambda batches: back(coded(batches)), "bpe"), f"{schema}, decoded string")
