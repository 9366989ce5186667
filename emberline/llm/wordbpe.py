"""Token ids of whole texts by the tokenizers library, with a cache of words.

The word-level vocabulary drops white space, lower-cases and never joins what white space separates, so a
text's ids are those of its white-space-separated words one after the other. Words are looked up in a cache
of bounded size that lives as long as the Python worker; a missing word goes to the library, straight to its BPE
model where it is one run of letters or of ASCII punctuation. Two more steps
are taken only where they change nothing: ASCII capitals are lowered before the look-up, and a missing word is
cut before a closing run of ASCII punctuation, where pre-tokenisation cuts anyway. A text with the opening
"<|" of a special token is encoded as it is. Whether a tokenizer works this way is checked by its settings;
for any other the library encodes each text whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

CACHED = 250_000
END = 1
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != ord("'"))
#: Lower-case letters, ASCII and Latin-1, which normalisation leaves as they are.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Byte-level alphabets write a byte as the character of its number, or as one from 256 on where that isn't printable.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_coders: dict[str, Coder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def by_words(settings: dict) -> bool:
    norm, pre = settings.get("normalizer") or {}, settings.get("pre_tokenizer") or {}
    split = (pre.get("pretokenizers") or [{}])[0]
    return (
        [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and split.get("type") == "Split"
        and split.get("pattern", {}).get("Regex") == "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        and (split.get("behavior"), split.get("invert")) == ("Removed", True)
        and all(x["content"].startswith("<|") and not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in settings.get("added_tokens", []))
    )


class Coder(dict):
    """Word (lowered, bytes) to ids (little-endian, of self.width bytes each)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        with open(path) as f:
            self.words = by_words(json.load(f))
        self.kind = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.end = np.array([END], self.kind).tobytes()

    def plain(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha() or _LETTERS.fullmatch(word):  # one pre-token
            ids = self.bare(word)
        else:
            head = word.rstrip(_PUNCTUATION)
            if not head:
                ids = self.bare(word)
            elif len(head) < len(word) and (head[-1:].isalnum() or _LETTERS.fullmatch(head)):
                ids = self[head] + self[word[len(head) :]]
            else:
                ids = self.plain(word.decode())
        if len(self) < CACHED:
            self[word] = ids
        return ids

    def bare(self, word: bytes) -> bytes:
        """Ids of one pre-token, by the library's BPE model."""
        return array(self.code, [x.id for x in self.tokenize(word.decode("latin-1").translate(_ALPHABET))]).tobytes()

    def encode(self, data: bytes) -> bytes:
        """Ids of a whole UTF-8 text, the end id last."""
        if not self.words or b"<|" in data:
            return self.plain(data.decode()) + self.end
        return b"".join(map(self.__getitem__, data.lower().split())) + self.end


def coder(path: str) -> Coder:
    """This process's coder for a tokenizer file."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def wide(ids: bytes, kind: np.dtype) -> bytes:
    """The same ids as unsigned 32-bit integers."""
    return np.frombuffer(ids, kind).astype("<u4").tobytes()
