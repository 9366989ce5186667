"""SentencePiece encoding and decoding by Aho-Corasick and Viterbi.

The pieces of a model file form an Aho-Corasick automaton. It reads a text once; at each position the output links
give every piece that ends there, and each relaxes the best score of its end from that of its start. The path of
the highest sum of scores is the encoding; of equal sums the path whose last piece is longer wins. A character
without a piece of its own costs the lowest score less UNKNOWN and becomes its UTF-8 byte pieces.

White space only ever opens a piece (checked when the model is loaded), so the best path of a text is that of its
runs of spaces with the word after them, one after the other; these are cached, bounded, for the life of the
Python worker. A model without that property is run over whole texts.

Defined cases: null text is empty and has no ids; U+2581 in a text reads as a space, as the format has it, and is
decoded as one; repeated rows are encoded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import text_or_empty

SPACE = "▁"
UNKNOWN = 10
CACHED = 200_000
_RUNS = re.compile(" +[^ ]*")
_models: dict[str, Pieces] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    def __init__(self, vocabulary: list[tuple[str, float, str]]):
        """vocabulary: (piece, score, kind) by id; kind is normal, byte, unknown or other."""
        import ahocorasick

        self.pieces = [p for p, _, _ in vocabulary]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == "byte"}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next((i for i, x in enumerate(vocabulary) if x[2] == "unknown"), 0)
        self.automaton = ahocorasick.Automaton()
        scores = []
        for i, (p, score, kind) in enumerate(vocabulary):
            if kind == "normal" and p:
                self.automaton.add_word(p, (len(p), score, i))
                scores.append(score)
        if scores:
            self.automaton.make_automaton()
        self.lowest = min(scores, default=0.0) - UNKNOWN
        self.whole = any(SPACE in p.lstrip(SPACE) for p, _, kind in vocabulary if kind == "normal")
        self.kind = np.dtype("<u2") if len(vocabulary) <= 1 << 16 else np.dtype("<u4")
        self.cache: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """The ids of the best path over text, whose spaces are SPACE already."""
        n = len(text)
        best = [0.0] + [float("-inf")] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        at, single, lowest = 0, False, self.lowest

        def close(end: int) -> None:
            """Before position end is left: a character without a piece of its own may still be passed."""
            score = best[end - 1] + lowest
            if not single and score > best[end]:
                best[end], back[end] = score, (1, -1)

        for end, (size, score, i) in self.automaton.iter(text) if len(self.automaton) else ():
            end += 1
            while at < end:
                if at:
                    close(at)
                at, single = at + 1, False
            if size == 1:
                single = True
            new = best[end - size] + score
            if new > best[end] or new == best[end] and size > back[end][0]:
                best[end], back[end] = new, (size, i)
        while at <= n:
            if at:
                close(at)
            at, single = at + 1, False
        out: list[int] = []
        at = n
        while at:
            size, i = back[at]
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(text[at - 1].encode())]
            else:
                out.append(self.unknown)
            at -= size
        return out[::-1]

    def _cached(self, chunk: str) -> bytes:
        ids = self.cache.get(chunk)
        if ids is None:
            ids = np.array(self.viterbi(chunk), self.kind).tobytes()
            if len(self.cache) < CACHED:
                self.cache[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, self.kind)
        if self.whole:
            return np.array(self.viterbi((SPACE + text).replace(" ", SPACE)), self.kind)
        text = text.replace(SPACE, " ")
        if text[0] == " " or "  " in text or text[-1] == " ":
            chunks = [c.replace(" ", SPACE) for c in _RUNS.findall(" " + text)]
        else:
            chunks = [SPACE + w for w in text.split(" ")]
        get, out = self.cache.get, []
        for c in chunks:
            out.append(get(c) or self._cached(c))
        return np.frombuffer(b"".join(out), self.kind)

    def decode(self, ids: Iterable[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def load(path: str) -> Pieces:
    """This process's copy of a model file."""
    if path not in _models:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        kind = lambda i: "byte" if sp.is_byte(i) else "unknown" if sp.is_unknown(i) else "other" if sp.is_control(i) or sp.is_unused(i) else "normal"
        _models[path] = Pieces([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.vocab_size())])
    return _models[path]


ROWS = "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean"


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None, ids: bool = False) -> DataFrame:
    """Per row of docs: counts of ids and of byte ids among them, crc32 of the ids as little-endian unsigned 32-bit
    integers, whether decoding gives the text back; with ids=True, the ids too."""
    path = path or default_path()
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs, text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        is_byte = np.zeros(len(model.pieces), bool)
        is_byte[list(model.byte_of)] = True
        for batch in batches:
            rows, every = [], []
            for t in batch.column(1).to_pylist():
                got = model.encode(t)
                rows.append((len(got), int(is_byte[got].sum()), zlib.crc32(got.astype("<u4").tobytes()), model.decode(got.tolist()) == t.replace(SPACE, " ")))
                every.append(got.astype(np.int32))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            more = [pa.array(every, pa.list_(pa.int32()))] if ids else []
            yield pa.record_batch([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)), *more], names=["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip", *["ids"] * ids])

    return items.mapInArrow(run, ROWS + ", ids array<int>" * ids)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids (array of int)."""
    path = path or default_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else load(path).decode(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
