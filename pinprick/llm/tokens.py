"""Token ids of whole texts by the tokenizers library, with a memory of words seen.

Texts of printable ASCII, Latin-1 letters, spaces and line ends are split here by the
tokenizer's own rule (classes, case and composed form of these characters are settled), and
only the merges of a word not seen before are asked of the library. All other texts
go to the library whole, and so do all texts of a file whose normaliser or splitting rule is
another than the two known here. The ids are the same either way. The memory is emptied
when it holds ``MEMORY`` words.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable

from tokenizers import Tokenizer

from .common import let_go

MEMORY, LONGEST = 600_000, 64
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_KNOWN = bytes([10, *range(32, 127), *(x for x in range(192, 256) if x not in (215, 247))])
_RULES = {
    "bytes": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"),
    "words": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+"),
}

# Normaliser and splitting rule of the files for which the rules above hold.
_FILES = {
    "bytes": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    "words": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    ),
}


def _byte_letters() -> dict[int, str]:
    """The letter for each byte: printable ones stand for themselves, the rest for what
    follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_TABLE = _byte_letters()
_encoders: dict[tuple[str, str], "Encoder"] = {}


def _known(text: str) -> bool:
    """Whether the rules here hold for ``text``."""
    try:
        return not text.encode("latin-1").translate(None, _KNOWN)
    except UnicodeEncodeError:
        return False


def _follows(library: Tokenizer, kind: str) -> bool:
    """Whether the file's own rules are those written here."""
    own = json.loads(library.to_str())
    return (own["normalizer"], own["pre_tokenizer"]) == _FILES[kind] and own["model"]["type"] == "BPE" and all(x["special"] for x in own["added_tokens"])


class _Words(dict):
    """Ids of each word met, as bytes; also of a stretch between white space, as those of its words one after another."""

    def __init__(self, library: Tokenizer, split: Callable[[str], list[str]]) -> None:
        self.merge, self.split = library.model.tokenize, split

    def __missing__(self, word: str) -> bytes:
        parts = self.split(word)
        if len(parts) > 1:
            held = all(x in self for x in parts)
            ids = b"".join(map(self.__getitem__, parts))
            if not held:  # most likely met only once
                return ids
        else:
            ids = array("I", [t.id for t in self.merge(word.encode().decode("latin-1").translate(_TABLE))]).tobytes()
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers in bytes, as the library gives them: the string of a special token is that token.

    ``kind``: 'bytes' for the byte-level rule, which keeps white space, 'words' for the
    rule that lower-cases and drops it.
    """

    def __init__(self, path: str, kind: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder().values()
        self.added, self.folded = [t.content for t in added], any(t.normalized for t in added)  # as it stands in a text, or in the text as normalised
        self.follows = _follows(self.library, kind)
        self.lower, self.split = kind == "words", _RULES[kind].findall
        self.words = _Words(self.library, self.split)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.follows:
            return self.whole(texts)
        out, other, ids = [b""] * len(texts), [], self.words.__getitem__
        if len(self.words) > MEMORY:
            self.words.clear()
        for i, text in enumerate(texts):
            if _known(text) and not any(x in text for x in self.added) and not (self.folded and any(x in text.lower() for x in self.added)):
                out[i] = b"".join(map(ids, text.lower().split() if self.lower else self.split(text)))  # no word of the lower-casing rule has white space
            else:
                other.append(i)
        for i, x in zip(other, self.whole([texts[i] for i in other])):
            out[i] = x
        return out


def encoder(path: str, kind: str) -> Encoder:
    """One encoder per Python worker."""
    if (path, kind) not in _encoders:
        let_go()  # what earlier work in this process left
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]
