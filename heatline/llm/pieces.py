"""Pre-token pieces of a byte-level BPE vocabulary and a bounded per-process cache of their ids.

Every piece is encoded on its own by such tokenizers, so ids of a text are the joined ids of its
pieces. A text is first cut at the vocabulary's added tokens (such as the one that ends a text), which stand
for their own ids wherever a text holds their strings, as the library has it by default. The stdlib expression splits as the published one does except on a few thousand characters
whose classes differ between the engines; texts with one of those take the exact slow way.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from functools import cache

import numpy as np

FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: The same for texts of ASCII alone, where the engines' classes are plain sets of characters: no text needs the slow way.
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: White space by the Unicode property, which the tokenizers' engines use.
WHITE = set("\t\n\x0b\x0c\r \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}
#: Entries and bytes of the cache at most (an entry has some 200 bytes beside its piece and ids), and the longest piece kept.
CACHE_ENTRIES, CACHE_BYTES, ENTRY_BYTES, LONGEST = 400_000, 160 << 20, 200, 1024


@cache
def odd_characters() -> re.Pattern:
    """Characters that the stdlib classes put elsewhere than \\p{L}, \\p{N} and \\s do, or that are unassigned."""
    runs: list[list[int]] = []
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        kind = unicodedata.category(c)
        fast = "s" if c.isspace() else "d" if kind == "Nd" else "w" if c.isalnum() else "o"
        true = "s" if c in WHITE else "w" if kind[0] == "L" else "d" if kind[0] == "N" else "?" if kind == "Cn" else "o"
        if fast != true:
            if runs and runs[-1][1] == cp - 1:
                runs[-1][1] = cp
            else:
                runs.append([cp, cp])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]")


@cache
def unusual() -> re.Pattern:
    """Anything but Latin letters and marks that are known to be classed alike: a short test before the long one."""
    odd = odd_characters()
    return re.compile("[^" + "".join(re.escape(chr(c)) for c in range(0x250) if not odd.match(chr(c))) + "]")


def plain(text: str) -> bool:
    """Whether FAST splits this text as the published expression does."""
    return not unusual().search(text) or not odd_characters().search(text)


@cache
def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 bytes stay, the others follow from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceIds(dict):
    """piece -> its ids as little-endian bytes; emptied when it reaches a bound, of entries or bytes; long pieces are not kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: (k, t.lstrip or t.rstrip or t.single_word or t.normalized) for k, t in self.tokenizer.get_added_tokens_decoder().items() if t.content}
        self.added = {content: k for content, (k, _) in added.items()}
        self.bending = any(bends for _, bends in added.values())  # tokens that take in what stands beside them are the library's matter
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.model = self.tokenizer.model
        self.alphabet = byte_alphabet()
        self.space = self.alphabet[ord(" ")]
        self.held = 0

    def __missing__(self, piece: str) -> bytes:
        plainly = piece.isascii() and piece.isprintable()  # only the space has a stand-in then
        shown = piece.replace(" ", self.space) if plainly else piece.encode().decode("latin-1").translate(self.alphabet)
        ids = array(self.kind.char, [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= CACHE_ENTRIES or self.held >= CACHE_BYTES:
                self.clear()
                self.held = 0
            self[piece] = ids
            self.held += ENTRY_BYTES + 4 * len(piece) + len(ids)
        return ids

    def _between(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if text.isascii():
            return b"".join(map(self.__getitem__, ASCII.findall(text)))
        if plain(text):
            return b"".join(map(self.__getitem__, FAST.findall(text)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids that the tokenizers library gives by default for the whole text, with add_special_tokens=False."""
        if not any(content in text for content in self.added):
            return np.frombuffer(self._between(text), self.kind)
        if self.bending:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        parts = self.cut.split(text)  # texts and added tokens by turns
        return np.frombuffer(b"".join(np.array([self.added[x]], self.kind).tobytes() if k % 2 else self._between(x) for k, x in enumerate(parts)), self.kind)


@cache
def piece_ids(path: str) -> PieceIds:
    """One per Python worker; workers are reused across tasks."""
    return PieceIds(path)
