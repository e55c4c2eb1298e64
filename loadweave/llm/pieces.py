"""Splits a text as a word-level BPE tokenizer file says: composed, lower-cased, cut into pieces."""

from __future__ import annotations

import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer


#: The pattern that ``Splitter.cut_latin`` follows; texts of other tokenizers are matched one by one.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, DIGIT, SIGN = range(4)


def _unassigned() -> str:
    """Ranges of code points this Python knows no letter class for, as a pattern's class."""
    points = [p for p in range(sys.maxunicode + 1) if unicodedata.category(chr(p)) == "Cn"]
    starts = [p for p, before in zip(points, [-2, *points]) if p != before + 1]
    ends = [p for p, after in zip(points, [*points[1:], -2]) if p != after - 1]
    return "[" + "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(starts, ends)) + "]"


class Splitter:
    """The pieces of a text, and its special tokens, of a tokenizer file whose normaliser is NFC, white
    space to one space, lower case, and whose pre-tokenizer keeps the matches of a pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"]:
            raise ValueError(f"{path} is not a lower-casing word-level tokenizer")
        self.model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # The tokenizer's \s is Unicode white space; spelt out, as pattern libraries differ on it.
        space = r"\t-\r \x85\xa0  -     　"
        self.find = regex.compile(split["pattern"]["Regex"].replace(r"\s", space)).findall
        latin = {k: "".join(re.escape(c) for c in map(chr, range(256)) if unicodedata.category(c)[0] == k) for k in "LN"}
        plain = split["pattern"]["Regex"].replace(r"\s", r"\t-\r \x85\xa0")
        for kind, letters in latin.items():
            plain = plain.replace(rf"\p{{{kind}}}", letters)
        self.find_latin = re.compile(plain).findall
        self.by_kind = split["pattern"]["Regex"] == WORDS
        every = [chr(i) for i in range(256)]
        self.lower = "".join(map(str.lower, every)).encode("latin-1")
        self.kinds = np.array([SPACE if re.match(r"[\t-\r \x85\xa0]", c) else LETTER if unicodedata.category(c)[0] == "L" else
                               DIGIT if unicodedata.category(c)[0] == "N" else SIGN for c in every], np.uint8)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.mark = next(iter(self.special), "\0")[:2]
        # Unicode versions differ on letters added of late: such texts are cut by the library itself.
        self.recent = regex.compile(_unassigned()).search
        self.path, self.library = path, None
        self.bytes = {letter: byte for byte, letter in byte_letters().items()}

    def plain(self, text: str) -> list[str]:
        if _latin(text):
            return self.find_latin(text.lower())
        if self.recent(text):
            self.library = self.library or Tokenizer.from_file(self.path)
            whole = self.library.normalizer.normalize_str(text)
            return [bytes(map(self.bytes.__getitem__, piece)).decode()
                    for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(whole)]
        # lower case letter by letter: a final capital sigma is not special
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.find(text.lower())

    def latin(self, text: str) -> bytes | None:
        """The text in Latin-1 if ``cut_latin`` can cut it: no other letters, no special tokens."""
        if not self.by_kind or (self.cut is not None and self.mark in text):
            return None
        try:
            return text.encode("latin-1")
        except UnicodeEncodeError:
            return None

    def cut_latin(self, texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
        """(number of pieces of each text, the pieces of all in a row, in Latin-1): a piece starts where the kind of sign
        changes and at each digit. An apostrophe behind another kind takes a short ending with it."""
        raw = np.frombuffer(b" ".join(texts).translate(self.lower), np.uint8)
        kind = self.kinds[raw]
        before = np.concatenate([np.zeros(1, np.uint8), kind])[:-1]
        start = (kind != before) | (kind == DIGIT)
        at = np.flatnonzero((raw == ord("'")) & (before != SIGN))
        ahead = np.concatenate([raw, np.full(2, ord(" "), np.uint8)])
        one, two = ahead[at + 1], ahead[at + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[at[short | long] + 1] = False
        ends = np.concatenate([at[short] + 2, at[long] + 3])
        start[ends[ends < len(raw)]] = True
        shown = kind != SPACE
        starts = np.flatnonzero(start & shown)
        offsets = np.append(np.cumsum(shown)[starts] - 1, shown.sum()).astype(np.int32)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return np.diff(np.searchsorted(starts, bounds)), pa.Array.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[shown])])

    def pieces(self, text: str) -> list[str | int]:
        """Pieces in order; a special token in the text is its id."""
        if self.cut is None or self.mark not in text:
            return self.plain(text)
        out: list[str | int] = []
        for i, part in enumerate(self.cut(text)):
            out += [self.special[part]] if i % 2 else self.plain(part)
        return out


def _latin(text: str) -> bool:
    """Whether a text keeps to Latin-1, which is composed and has no such letters."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: visible Latin-1 signs
    stand for themselves, the other bytes for letters from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    table |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in table)}
    return table
