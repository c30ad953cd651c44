"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi search."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from stratiform.llm.words import batches_of
from stratiform.llm.stored import prepare

#: A model file is broadcast, so its size is limited.
MODEL_BYTES = 64 << 20
#: The space mark of the pieces, their kinds, and how much worse than the worst piece a byte is.
SPACE, NORMAL, DEFINED, BYTE, PENALTY = "▁", 1, 4, 6, 10.0
#: Stands for a space inside; no valid text holds it, so a space mark in a text stays a character of its own.
MARK = "\ud800"
REMEMBERED, SHORT = 400_000, 48
#: Pieces scored below this are never to be chosen; they do not set the price of a byte.
UNUSED = -1e8


def _fields(data: bytes):
    """Number and value of each field of a protobuf message."""

    def number(at):
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        elif key & 7 == 2:
            size, at = number(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if key & 7 == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_model(path: str) -> list[tuple[str, float, int]]:
    """Text, score and kind of every piece of a model file, by id."""
    with open(path, "rb") as file:
        data = file.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
    pieces = []
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
    return pieces


class Codec:
    """Encodes to the segmentation with the highest sum of scores, and decodes back to exactly the same text.

    A space reads as the space mark and a text starts with one. A character that no piece covers is written as its
    UTF-8 bytes. Of equally good segmentations the one with the longest last piece counts, and so on to the front.
    """

    def __init__(self, pieces: list[tuple[str, float, int]]):
        normal = [(text.replace(SPACE, MARK), score, i) for i, (text, score, kind) in enumerate(pieces) if kind in (NORMAL, DEFINED)]
        bytes_ = {int(text[1:-1], 16): i for i, (text, _, kind) in enumerate(pieces) if kind == BYTE}
        if len(bytes_) != 256:
            raise ValueError("the model has no piece for each byte")
        self.bytes = [bytes_[i] for i in range(256)]
        self.floor = min((score for _, score, _ in normal if score > UNUSED), default=0.0) - PENALTY
        self.text = [b""] * len(pieces)
        for text, _, i in normal:
            self.text[i] = text.replace(MARK, " ").encode()
        for value, i in bytes_.items():
            self.text[i] = bytes([value])
        self._automaton(normal)
        self._cuts(normal)
        self.held: dict[str, bytes] = {}

    def _automaton(self, normal) -> None:
        """Trie with failure links; each node knows its own piece and the next shorter node that ends one."""
        step: list[dict[str, int]] = [{}]
        own: list[tuple[int, float, int] | None] = [None]
        for text, score, i in normal:
            node = 0
            for char in text:
                if char not in step[node]:
                    step[node][char] = len(step)
                    step.append({})
                    own.append(None)
                node = step[node][char]
            if own[node] is None or score > own[node][1]:
                own[node] = (len(text), score, i)
        fail, link = [0] * len(step), [0] * len(step)
        queue = list(step[0].values())
        for node in queue:
            for char, child in step[node].items():
                back = fail[node]
                while back and char not in step[back]:
                    back = fail[back]
                fail[child] = step[back].get(char, 0)
                link[child] = fail[child] if own[fail[child]] else link[fail[child]]
                queue.append(child)
        self.step, self.own, self.fail, self.link = step, own, fail, link

    def _cuts(self, normal) -> None:
        """Pattern of stretches that no piece crosses, so that each has a best segmentation of its own."""
        inner = {c for text, _, _ in normal if len(text) > 1 for c in text} - {MARK}
        if any(MARK in text.lstrip(MARK) for text, _, _ in normal):
            self.cut = re.compile(".+", re.S)
            return
        chars = "".join(re.escape(c) for c in sorted(inner))
        self.cut = re.compile(f"{MARK}+[{chars}]*|[{chars}]+|." if chars else ".", re.S)

    def search(self, text: str) -> list[int]:
        step, own, fail, link = self.step, self.own, self.fail, self.link
        best, back = [0.0], [None]
        node = 0
        for at, char in enumerate(text):
            while node and char not in step[node]:
                node = fail[node]
            node = step[node].get(char, 0)
            top, choice = best[at] + self.floor * len(char.encode(errors="surrogatepass")), None
            out = node if own[node] else link[node]
            while out:
                size, score, piece = own[out]
                value = best[at + 1 - size] + score
                if value > top:
                    top, choice = value, (size, piece)
                out = link[out]
            best.append(top)
            back.append(choice)
        ids: list[int] = []
        at = len(text)
        while at:
            if back[at]:
                size, piece = back[at]
                ids.append(piece)
            else:
                size = 1
                char = " " if text[at - 1] == MARK else text[at - 1]
                ids.extend(self.bytes[b] for b in reversed(char.encode()))
            at -= size
        ids.reverse()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers in a row; an empty text has none."""
        if not text:
            return b""
        held, out = self.held, []
        for stretch in self.cut.findall(MARK + text.replace(" ", MARK)):
            ids = held.get(stretch)
            if ids is None:
                ids = np.array(self.search(stretch), dtype=np.int32).tobytes()
                if len(stretch) <= SHORT:
                    if len(held) >= REMEMBERED:
                        held.clear()
                    held[stretch] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids) -> str:
        """Text of a list of ids; the space in front that encoding added goes."""
        return b"".join(map(self.text.__getitem__, ids)).decode(errors="replace")[1:]


_codecs: dict[str, Codec] = {}


def codec_of(key: str, shared) -> Codec:
    """The codec of a model, built once in each Python worker."""
    if key not in _codecs:
        _codecs[key] = Codec(shared.value)
    return _codecs[key]


def _shared(spark: SparkSession, model: str):
    prepare(spark)
    return spark.sparkContext.broadcast(read_model(model))


def encode_pieces(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of every whole text; null stays null, and a column named like the new one is replaced."""
    docs = docs.drop(ids)
    shared, key = _shared(docs.sparkSession, model), model

    def encode(batches):
        codec = codec_of(key, shared)
        for batch in batches_of(batches):
            rows = [None if x is None else codec.encode(x) for x in batch.column(text).to_pylist()]
            yield batch.append_column(ids, _lists(rows))

    wanted = StructType(list(docs.schema.fields)).add(ids, ArrayType(IntegerType()))
    return docs.mapInArrow(encode, wanted)


def _lists(rows: list[bytes | None]) -> pa.Array:
    sizes = np.array([0 if x is None else len(x) // 4 for x in rows], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(x for x in rows if x is not None), dtype=np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([x is None for x in rows]))


def decode_pieces(docs: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of every list of ids; null stays null, and a column named like the new one is replaced."""
    docs = docs.drop(text)
    shared, key = _shared(docs.sparkSession, model), model

    def decode(batches):
        codec = codec_of(key, shared)
        for batch in batches_of(batches):
            rows = batch.column(ids)
            starts = rows.offsets.to_numpy()
            values = rows.values.slice(starts[0], starts[-1] - starts[0]).to_numpy().tolist()
            starts = starts - starts[0]
            texts = [
                codec.decode(values[starts[i] : starts[i + 1]]) if valid else None
                for i, valid in enumerate(rows.is_valid().to_pylist())
            ]
            yield batch.append_column(text, pa.array(texts, pa.string()))

    return docs.mapInArrow(decode, StructType(list(docs.schema.fields)).add(text, StringType()))
