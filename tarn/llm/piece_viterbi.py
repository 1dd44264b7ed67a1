"""SentencePiece encoding by best path over pieces, and decoding.

An Aho-Corasick automaton over the vocabulary finds, at each position and
through its output links, every piece that ends there; one pass relaxes the best
score of each position and a walk back gives the pieces. A character that no
piece covers becomes its UTF-8 bytes (byte fallback), at a cost above that of
any piece. The model is read where the query is planned and sent to the tasks,
so executors need no copy of the file.

No piece runs from other characters on into a space or a line end, so texts fall into
units there; paths of the frequent ones are remembered.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# How the model's file writes a space.
SPACE_MARK = "▁"
# Units remembered by a task, and the longest of them.
REMEMBERED = 300_000
LONGEST_UNIT = 40

_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def read_model(path: str) -> list[tuple[bytes, float, str]]:
    """Each id's bytes, score and kind (piece, byte or other)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            entries.append((bytes([int(_BYTE_PIECE.fullmatch(piece)[1], 16)]), 0.0, "byte"))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            entries.append((b"", 0.0, "other"))
        else:
            entries.append((piece.replace(SPACE_MARK, " ").encode(), model.get_score(i), "piece"))
    return entries


class Encoder(dict):
    """Unit of text to the ids of its best path, as bytes of int32."""

    def __init__(self, entries: list[tuple[bytes, float, str]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        self.byte_ids = {piece[0]: i for i, (piece, _, kind) in enumerate(entries) if kind == "byte"}
        worst = 0.0
        inner = False
        for i, (piece, score, kind) in enumerate(entries):
            if kind == "piece":
                text = piece.decode()
                self.automaton.add_word(text, (len(text), score, i))
                worst = min(worst, score)
                inner |= re.search(r"[^ ] |.\n|\n.", text, re.DOTALL) is not None
        self.automaton.make_automaton()
        if len(self.byte_ids) < 256:
            raise ValueError("the vocabulary has no byte fallback")
        self.uncovered = worst - 1
        self.units = re.compile(r".+" if inner else r" +[^ \n]*|\n[^ \n]*", re.DOTALL).findall

    def __missing__(self, unit: str) -> bytes:
        ids = np.array(self.path(unit), np.int32).tobytes()
        if len(unit) <= LONGEST_UNIT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[unit] = ids
        return ids

    def path(self, text: str) -> list[int]:
        """The ids of highest total score; among equals, of longer last pieces."""
        n = len(text)
        best = [0.0] * (n + 1)
        step = [1] * (n + 1)
        piece = [-1] * (n + 1)
        done = 0
        for end, (length, score, i) in self.automaton.iter(text):
            end += 1
            while done < end:  # positions are opened with the fallback
                best[done + 1] = best[done] + self.uncovered
                done += 1
            total = best[end - length] + score
            if total > best[end]:
                best[end], step[end], piece[end] = total, length, i
        out: list[int] = []
        while n:
            if piece[n] >= 0:
                out.append(piece[n])
            else:
                out.extend(self.byte_ids[b] for b in reversed(text[n - 1].encode()))
            n -= step[n]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """The ids of a text, which gets a space in front as the model wants it."""
        if not text:
            return b""
        return b"".join(map(self.__getitem__, self.units(f" {text}")))


def int_lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode_pieces(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """``doc_id``, ``text`` and ``ids``, the array of piece ids of each text.

    Other columns are ignored; one row for each input row. A null text is empty
    and an empty text has no ids. Any text can be encoded and decoded again,
    also one with line ends, runs of spaces or the mark that the model's file
    writes for a space.
    """
    entries = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches):
        encoder = Encoder(entries.value)
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), int_lists([encoder.encode(t) for t in texts])],
                names=["doc_id", "text", "ids"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, ids array<int>")


def decode_pieces(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """``encoded`` (with ``doc_id`` and ``ids``) and ``decoded``, the text of the ids.

    Null ids, and ids without bytes such as control pieces, add nothing. The
    space in front of the first piece is dropped; bytes that are no UTF-8 become
    replacement characters.
    """
    entries = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches):
        pieces = [piece for piece, _, _ in entries.value]
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                ids = () if not ids.is_valid else ids.values.drop_null().to_numpy(zero_copy_only=False).tolist()
                text = b"".join(map(pieces.__getitem__, ids)).decode("utf-8", "replace")
                texts.append(text[1:] if text.startswith(" ") else text)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"]
            )

    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])
    return encoded.mapInArrow(run, schema)
