"""Units of text that a tokenizer encodes alike wherever they stand, each encoded once."""

from __future__ import annotations

import os

import numpy as np

#: Units that a worker remembers; the memory is emptied when it is full.
CACHE_UNITS = 700_000

#: ASCII characters that are neither letters, digits, white space nor controls.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


#: Classes of lower-case bytes: 1 letters and digits, 2 marks, 4 the apostrophe, 0 all others.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[c for c in range(128) if chr(c).islower() or chr(c).isdigit()]] = 1
_CLASS[list(MARKS)] = 2
_CLASS[ord("'")] = 4
#: Pairs of classes (8 * left + right) with a border of pre-tokens between them. None lies behind an apostrophe: "'s" is one.
_BORDER = np.zeros(64, dtype=bool)
_BORDER[[8 * 1 + 2, 8 * 1 + 4, 8 * 2 + 1]] = True


def parted(texts: list[bytes]) -> list[list[bytes]]:
    """The words of each text (white space ASCII, ASCII letters lower), parted also at the borders of ASCII letters or digits and marks."""
    whole = np.frombuffer(b"\n".join(texts).lower(), dtype=np.uint8)
    kind = _CLASS[whole]
    cuts = np.flatnonzero(_BORDER[8 * kind[:-1] + kind[1:]]) + 1
    spaced = np.insert(whole, cuts, ord(" ")).tobytes()
    ends = np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)
    ends += np.searchsorted(cuts, ends)
    return [spaced[a:b].split() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


def is_latin(word: bytes) -> bool:
    """Only letters, all in the blocks that every Unicode version agrees on."""
    if word.isascii():
        return word.isalpha()
    text = word.decode("utf-8", "replace")
    return text.isalpha() and text.lower().isalpha() and max(text) < "\u0180"


class UnitCache:
    """Ids of units. Letters with ASCII marks after them are two pre-tokens, so the
    letters share one entry with the bare word. Units of letters alone are one pre-token
    each and are encoded many at a time, without the tokenizer's normaliser and
    pattern; all others go through the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}

    def encode_plain(self, units: list[bytes]) -> list[bytes]:
        raise NotImplementedError

    def learn(self, units: set[bytes]) -> None:
        """Make sure that all ``units`` are known."""
        if len(self.known) > CACHE_UNITS:
            self.known = {}
        new = units.difference(self.known)
        known, plain, other, marked = self.known, [], [], []
        for u in new:
            core = u.rstrip(MARKS)
            letters = core[1:] if core[:1] == b" " else core
            if not (letters.isalpha() and letters.isascii() or is_latin(letters)) or b"<|" in u:
                other.append(u)
            elif len(core) == len(u):
                plain.append(u)
            else:
                marked.append((u, core))
        plain += {core for _, core in marked if core not in known} - new
        other += {u[len(core) :] for u, core in marked if u[len(core) :] not in known} - new
        for k in range(0, len(plain), 1024):
            some = plain[k : k + 1024]
            known.update(zip(some, self.encode_plain(some), strict=True))
        for k in range(0, len(other), 4096):
            some = other[k : k + 4096]
            for u, found in zip(some, self.tokenizer.encode_batch_fast([u.decode("utf-8", "replace") for u in some], add_special_tokens=False), strict=True):
                known[u] = np.array(found.ids, dtype="<u4").tobytes()
        for u, core in marked:
            known[u] = known[core] + known[u[len(core) :]]
