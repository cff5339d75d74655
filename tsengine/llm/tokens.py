"""Token ids of whole texts with a public tokenizer, words encoded once.

The tokenizer's pre-tokens never cross white space, and its normalisation never joins characters across it, so a text's
ids are the ids of its white-space-separated words one after another. A batch's distinct words are found by Arrow's exact
dictionary encoding. A word of letters with ASCII punctuation after it (most are) is two pre-tokens whose ids the
tokenizer's model gives directly, in lower case; any other word takes the tokenizer's whole path. Each worker keeps what
it has encoded (a cache, emptied when full).
"""

from __future__ import annotations

import importlib
import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept, and bytes of text taken at a time: the distinct words of more text are fewer for each byte.
CACHE_WORDS, TEXT_BYTES = 500_000, 8 << 20
#: Letters, then punctuation that no special token or contraction holds.
_PLAIN = re.compile(r"([^\W\d_]+)([!-&(-;=?@\[-^`{}~]*)")
_open: dict[str, _Encoder] = {}


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in out:
            out[b], extra = chr(256 + extra), extra + 1
    return [out[b] for b in range(256)]


_BYTE = _byte_letters()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a vocabulary file on this machine; workers look it up for themselves."""
    return importlib.import_module("public_tokenizers").path(name)


class _Encoder:
    """Ids of words, as the bytes of 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kinds = [x["type"] for x in json.loads(self.tokenizer.to_str())["pre_tokenizer"].get("pretokenizers", [])]
        if kinds != ["Split", "ByteLevel"]:
            raise ValueError("a vocabulary of another kind: its words can't be encoded one by one")
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()

    def stem(self, low: str) -> bytes:
        """Ids of small letters in their composed form."""
        ids = self.stems.get(low)
        if ids is None:
            symbols = low if low.isascii() else "".join([_BYTE[b] for b in low.encode()])
            ids = self.stems[low] = array("I", [t.id for t in self.tokenizer.model.tokenize(symbols)]).tobytes()
        return ids

    def encode(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if not plain or not (word.isascii() or unicodedata.is_normalized("NFC", word)):
            return self.whole(word)
        letters, tail = plain.groups()
        # letter by letter, as the tokenizer does; a letter may become several characters, not all of them letters
        low = letters.lower() if letters.isascii() else "".join([c.lower() for c in letters])
        if not low.isalpha() or not letters.isalpha():
            return self.whole(word)
        if not tail:
            return self.stem(low)
        ids = self.stems.get(tail)
        if ids is None:
            ids = self.stems[tail] = self.whole(tail)
        return self.stem(low) + ids

    def many(self, words: list[str]) -> list[bytes]:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if len(self.stems) > CACHE_WORDS:
            self.stems.clear()
        seen = self.words
        out = []
        for w in words:
            ids = seen.get(w)
            if ids is None:
                ids = seen[w] = self.encode(w)
            out.append(ids)
        return out


def word_ids(words: list[str], name: str) -> list[bytes]:
    """Ids of each word alone, without special tokens around it."""
    if name not in _open:
        _open[name] = _Encoder(name if "/" in name else tokenizer_path(name))
    return _open[name].many(words)


def forget() -> None:
    """Let go of the vocabularies and words of this process."""
    _open.clear()


def _words(column: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Index of each word among the distinct ones, the rows' offsets into the words, ids of the distinct ones."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    offsets = lists.offsets.to_numpy()
    found = lists.flatten().dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), (offsets - offsets[0]).astype(np.int64), word_ids(found.dictionary.to_pylist(), name)


def encode(column: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and the rows' offsets into them; null is the empty text."""
    index, offsets, ids = _words(column, name)
    sizes = np.array([len(x) for x in ids], np.int64) // 4
    flat = np.frombuffer(b"".join(ids), np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = sizes[index]
    done = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(starts[index] - done[:-1], n) + np.arange(done[-1])], done[offsets]


def count(column: pa.Array, name: str) -> np.ndarray:
    """The number of ids of each text."""
    index, offsets, ids = _words(column, name)
    done = np.concatenate([[0], np.cumsum(np.array([len(x) for x in ids], np.int64)[index] // 4)])
    return np.diff(done[offsets])
