"""Exact tokenizer ids at the speed of a table look-up.

Both byte-level and word-end vocabularies cut a text at every single blank or line feed between
two other characters, whatever stands around it. So the pieces between such places can be encoded
alone, by the library itself, and remembered: most pieces of a corpus are met again and again.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

#: Pieces, and parts of pieces, that a worker remembers.
PIECE_CACHE, PART_CACHE = 500_000, 400_000

# Fixed value: the pattern of byte-level pre-tokenizers, as in the public vocabularies' description.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_RUN = re.compile(r"\s\s")
_SINGLE = re.compile(r"(?<=\S)(?=[ \n]\S)")
_UNUSUAL = re.compile("[^\n\x20-\x7e\xa1-\xff]")
_STOPS = (".", ",")
_EVERY = re.compile(r"(?=[ \n])")


@lru_cache(maxsize=4)
def load(path: str):
    """The library's tokenizer of a file, without truncation and padding, on one thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def vocabulary_size(path: str) -> int:
    return load(path).get_vocab_size(with_added_tokens=True)


def pieces(text: str, runs: bool = True) -> list[str]:
    """The parts of a text that can be encoded alone; joined they are the text. Runs of white space
    are not cut, as byte-level vocabularies treat a run as one, unless ``runs`` is false."""
    if runs and _RUN.search(text):
        return _SINGLE.split(text)
    if "\0" in text:
        return _EVERY.split(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def _plain_cut(path: str):
    """(pattern, lower) if the file's pre-tokenizer is one of two known kinds: byte-level with its own
    pattern, or a split by a pattern after NFC, blanks and lower case. Else None."""
    how = json.loads(load(path).to_str())
    norm, pre = how["normalizer"], how["pre_tokenizer"] or {}
    if norm is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
        return BYTE_PATTERN, False
    steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"]:
        if parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]:
            return parts[0]["pattern"]["Regex"], True
    return None


class _Known(dict):
    """Remembered results, worked out when first asked for; emptied when there are too many."""

    def __init__(self, work, most: int):
        super().__init__()
        self.work, self.most = work, most

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.work(key)
        return out


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, equal to the library's
    ``encode(text, add_special_tokens=False)``.

    A new piece of printable Latin-1 characters is cut by the pre-tokenizer's pattern, whose classes,
    lower case and normal form are certain there, and its parts are merged by the library's model; any other
    piece, and any that may hold a special token, goes through the whole of the library.
    """

    def __init__(self, path: str):
        import regex

        self.tokenizer = load(path)
        self.known = _Known(self._piece, PIECE_CACHE)
        self.parts = _Known(self._part, PART_CACHE)
        self.letters = byte_alphabet()
        self.merge = self.tokenizer.model.tokenize
        self.special = [x["content"] for x in json.loads(self.tokenizer.to_str())["added_tokens"]]
        plain = _plain_cut(path)
        self.cut, self.lower = (regex.compile(plain[0]).findall, plain[1]) if plain else (None, False)
        self.signs = "".join({x[:1] for x in self.special})

    def _piece(self, piece: str) -> bytes:
        if self.cut is None or _UNUSUAL.search(piece) or any(c in piece for c in self.signs) and any(x in piece for x in self.special):
            return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        parts = self.parts
        if self.lower:  # white space is dropped; letters alone, or with one stop or comma, need no pattern
            piece = piece.lower()
            word = piece[1:] if piece[0] in " \n" else piece
            if word.isalpha():
                return parts[word]
            if word[-1:] in _STOPS and word[:-1].isalpha():
                return parts[word[:-1]] + parts[word[-1]]
        elif piece[0] == " ":
            if piece[1:].isalpha():
                return parts[piece]
            if piece[-1] in _STOPS and piece[1:-1].isalpha():
                return parts[piece[:-1]] + parts[piece[-1]]
        return b"".join(map(parts.__getitem__, self.cut(piece)))

    def _part(self, part: str) -> bytes:
        return array("I", [x.id for x in self.merge("".join(map(self.letters.__getitem__, part.encode("utf-8"))))]).tobytes()

    def __call__(self, text: str | None) -> bytes:
        return b"".join(map(self.known.__getitem__, filter(None, pieces(text, not self.lower)))) if text else b""


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of every byte in a byte-level vocabulary: printable Latin-1 characters
    stand for themselves, the others for the characters from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def whole_tokens(path: str, pattern: str) -> frozenset[str]:
    """The strings of a byte-level vocabulary that are proven to encode alone as exactly one token:
    the pre-tokenizer's pattern leaves them whole, and the merges end in the one id of the string."""
    import regex

    t = load(path)
    back = {c: b for b, c in byte_alphabet().items()}
    cut = regex.compile(pattern)
    special = {x["content"] for x in json.loads(t.to_str())["added_tokens"]}
    found = set()
    for name, number in t.get_vocab(with_added_tokens=False).items():
        if any(c not in back for c in name):
            continue
        try:
            text = bytes(back[c] for c in name).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if text not in special and cut.findall(text) == [text] and [x.id for x in t.model.tokenize(name)] == [number]:
            found.add(text)
    return frozenset(found)
