"""Tokens of texts by way of their distinct chunks, for byte-level BPE vocabularies.

A token of such a vocabulary has a space at its start only, so a text can be cut before every single
space that stands between two other characters, and each piece encoded on its own. Most pieces repeat;
an index of those met so far leaves little to encode.
"""

from __future__ import annotations

import json
from itertools import islice

import numpy as np
import regex

# How these vocabularies split a text into pre-tokens, and the characters that are white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# So many chunks, of at most four times as many pre-tokens, are remembered; the index starts anew between two batches beyond that.
REMEMBERED = 400_000

_SPACES = frozenset([*map(chr, range(9, 14)), " ", "\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"])
_SPACE_CLASS = "".join(sorted(_SPACES))
_CUT = regex.compile(rf"(?<=[^{_SPACE_CLASS}]) (?=[^{_SPACE_CLASS}])")
_SPLIT = regex.compile(PATTERN)
_POINTS = frozenset(b".,;:!?")


class Chunks:
    """Numbers the distinct chunks of texts, and the distinct pre-tokens of the chunks.

    ``parts`` has the pre-tokens of every chunk, ``sizes`` how many those are. What a pre-token (str, or
    the id of a special token) is encoded to, the caller keeps by its number.
    """

    def __init__(self, specials: dict[str, int], limit: int = REMEMBERED):
        self.limit, self.specials = limit, specials
        self._inside = special_pattern(specials)
        self._start()

    def _start(self) -> None:
        self._number: dict[bytes, int] = {}
        self._pretoken: dict[str | int, int] = {}
        self._n = 0
        self.parts = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)

    def batch(self, texts: list[bytes | None]) -> tuple[bool, list[np.ndarray], list[str | int]]:
        """Whether the numbers start anew, the chunk numbers of each text, and the pre-tokens met first here."""
        anew = len(self._number) > self.limit or len(self.parts) > 4 * self.limit
        if anew:
            self._start()
        met = len(self._pretoken)
        pieces = [t.split(b" ") if t else [] for t in texts]
        for split in pieces:
            if split:  # nothing stands before the first piece; a space marks it, which no other piece has
                split[0] = b" " + split[0]
        new = list(set().union(*pieces) - self._number.keys())
        parts: list[int] = []
        sizes: list[int] = []
        for piece in new:
            self._number[piece] = self._add(piece, parts, sizes)
        numbers = []
        for text, split in zip(texts, pieces):
            n = np.fromiter(map(self._number.__getitem__, split), np.int64, len(split))
            if len(n) and n.min() < 0:
                n = self._slowly(text, parts, sizes)
            numbers.append(n)
        self.parts = np.concatenate([self.parts, np.array(parts, dtype=np.int64)])
        self.sizes = np.concatenate([self.sizes, np.array(sizes, dtype=np.int64)])
        return anew, numbers, list(islice(self._pretoken, met, None))

    def _add(self, piece: bytes, parts: list[int], sizes: list[int]) -> int:
        """The number of a new chunk; -1 for a piece that starts or ends with white space."""
        if piece[:1] == b" ":
            text = piece[1:].decode("utf-8")
            if text and text[-1] in _SPACES:
                return -1
            return self._append(text, parts, sizes)
        if piece.isalpha():
            return self._note([" " + piece.decode("ascii")], parts, sizes)
        if piece[:-1].isalpha() and piece[-1] in _POINTS:
            return self._note([" " + piece[:-1].decode("ascii"), chr(piece[-1])], parts, sizes)
        text = piece.decode("utf-8")
        if not text or text[0] in _SPACES or text[-1] in _SPACES:
            return -1
        if text.isalpha():
            return self._note([" " + text], parts, sizes)
        return self._append(" " + text, parts, sizes)

    def _append(self, text: str, parts: list[int], sizes: list[int]) -> int:
        return self._note(pretokens(text, self.specials, _SPLIT, self._inside), parts, sizes)

    def _note(self, found: list, parts: list[int], sizes: list[int]) -> int:
        held = self._pretoken
        for x in found:
            parts.append(held.setdefault(x, len(held)))
        sizes.append(len(found))
        self._n += 1
        return self._n - 1

    def _slowly(self, text: bytes, parts: list[int], sizes: list[int]) -> np.ndarray:
        """A text with more than single spaces, cut where it can be. Two spaces mark its chunks, which no others begin with."""
        first, *rest = _CUT.split(text.decode("utf-8"))
        numbers = []
        for chunk in (first, *(" " + r for r in rest)):
            key = b"  " + chunk.encode()
            if key not in self._number:
                self._number[key] = self._append(chunk, parts, sizes)
            numbers.append(self._number[key])
        return np.array(numbers, dtype=np.int64)


class Merges:
    """The merge table of a byte-level BPE vocabulary file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        vocab = held["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.specials = {t["content"]: t["id"] for t in held.get("added_tokens", []) if t.get("special")}
        self.byte_id = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all pre-tokens after merging, and how many each has.

        Rank-synchronous: the pieces are one ragged array; in every round each piece applies its own
        lowest-ranked pair everywhere at once, until no piece has a pair of the table.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbol = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        done_symbol, done_owner = [], []
        worst = len(self.keys)
        rank = np.full(len(symbol), worst, dtype=np.int64)
        at = np.arange(len(symbol) - 1)
        while len(symbol):
            rank[at] = self._ranks(symbol, owner, at)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(symbol)])
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            over = least == worst
            if over.any():
                done_symbol.append(symbol[over])
                done_owner.append(owner[over])
                live = ~over
                symbol, owner, rank, least = symbol[live], owner[live], rank[live], least[live]
                if not len(symbol):
                    break
            where = np.flatnonzero(rank == least)
            # Of overlapping occurrences (aaa) every other one counts, from the left.
            opens = np.r_[True, np.diff(where) != 1]
            run = np.maximum.accumulate(np.where(opens, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            symbol[where] = self.merged[rank[where]]
            stays = np.ones(len(symbol), dtype=bool)
            stays[where + 1] = False
            # Only pairs with a merged symbol get another rank.
            at = (np.cumsum(stays) - 1)[where]
            symbol, owner, rank = symbol[stays], owner[stays], rank[stays]
            rank[at] = worst
            before = at[at > 0] - 1
            rank[before] = worst
            at = np.unique(np.r_[at[at < len(symbol) - 1], before])
        if not done_symbol:
            return np.zeros(0, dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        symbol, owner = np.concatenate(done_symbol), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbol[order], np.bincount(owner, minlength=len(pieces))


    def _ranks(self, symbol: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that start at the given places."""
        pair = symbol[at] << 32 | symbol[at + 1]
        held = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        met = (self.keys[held] == pair) & (owner[at] == owner[at + 1])
        return np.where(met, self.rank[held], len(self.keys))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in these vocabulary files: itself where it prints, else the
    next free one from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, free = [], 256
    for b in range(256):
        letters.append(chr(b) if b in prints else chr(free))
        free += b not in prints
    return letters


def pretokens(text: str, specials: dict[str, int], split: regex.Pattern, inside: regex.Pattern | None) -> list[str | int]:
    """Pre-tokens of a chunk; a special token is its id."""
    if inside is None or not inside.search(text):
        return split.findall(text)
    found: list[str | int] = []
    for part in inside.split(text):
        if part in specials:
            found.append(specials[part])
        elif part:
            found += split.findall(part)
    return found


def special_pattern(specials: dict[str, int]) -> regex.Pattern | None:
    return regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
