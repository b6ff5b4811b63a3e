"""Token ids of whole texts by a public tokenizer, quickly.

The tokenizer in use lower-cases, cuts text into parts by a pattern and drops
white space; nothing it does looks across parts. A text of printable Latin-1 and
white space is therefore cut here, by the same pattern spelt out for those
characters, and each part is given to the tokenizer's model once; its ids are
kept as bytes, for a bounded number of parts, as long as the task runs. Other
texts, and texts that may hold a special token, are cut at white space and each
piece goes through the whole tokenizer. Other tokenizer files are encoded text
by text.
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable

import numpy as np

#: Parts kept by one task, in two generations: some 70 MB.
KEPT = 400_000
#: The pattern of the tokenizer file for which texts are cut here.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Anything but printable Latin-1 and white space; what is left is not changed by normalization.
_odd = re.compile("[^\t-\r -~¡-ÿ]").search


def encoder(path: str) -> Encoder:
    """A task's encoder for a file; it goes when the task ends, since a worker lives on for stages that need the memory."""
    return Encoder(path)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 is itself, the rest follows from 256."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in same]
    return {**{b: chr(b) for b in same}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def _latin(kind: str) -> str:
    """The Latin-1 characters of a Unicode category group, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(33, 256) if unicodedata.category(chr(c))[0] == kind)


class Encoder:
    def __init__(self, path: str, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normalizers = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_part = (
            normalizers == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in before] == ["Split", "ByteLevel"]
            and before[0]["pattern"] == {"Regex": PATTERN} and spec["post_processor"] is None)
        self.cut = re.compile(PATTERN.replace(r"[\p{L}]", rf"[{_latin('L')}]").replace(r"[\p{N}]", f"[{_latin('N')}]")
                              .replace(r"\p{L}\p{N}", _latin("L") + _latin("N"))).findall
        # what a special token begins with; no white space is within one
        self.special = re.compile("|".join(re.escape(t["content"][:2]) for t in spec.get("added_tokens", [])) or r"(?!)").search
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.kept, self.known, self.older = kept // 2, {}, {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of one part, in lower case."""
        stand_ins = part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(stand_ins)]).tobytes()

    def _learn(self, part: str | bytes) -> bytes:
        """Ids of a part, or of a piece given as bytes."""
        found = self.known.get(part)  # a caller may look in the generation before
        if found is not None:
            return found
        found = self.older.get(part)
        if found is None:
            found = self._part(part) if isinstance(part, str) else self._whole(part.decode("utf-8", "surrogatepass"))
        if len(self.known) >= self.kept:
            self.older, self.known = self.known, {}
        self.known[part] = found
        return found

    def _text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_part:
            return self._whole(text)
        plain = not (_odd(text) or self.special(text))
        parts = self.cut(text.lower()) if plain else text.encode("utf-8", "surrogatepass").split()
        known, learn = self.known.get, self._learn
        return b"".join([known(p) or learn(p) for p in parts])

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text as unsigned 32-bit integers; none for null or empty text."""
        return np.frombuffer(self._text(text), dtype="<u4")

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as bytes, four for each id.

        Nothing here makes reference cycles, and a collector that walks the lists
        of long texts again and again takes a quarter of the time, so it rests.
        """
        running = gc.isenabled()
        gc.disable()
        try:
            return [self._text(t) for t in texts]
        finally:
            if running:
                gc.enable()
