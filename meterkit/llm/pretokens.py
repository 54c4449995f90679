"""Byte-level BPE tokenizer files and their first split of a text.

A tokenizer of this kind cuts a text at its special strings, then by one
pattern into pieces, and encodes each piece alone. Only files of that kind
are taken: no normalizer, a byte-level splitter without prefix space, a plain
BPE model.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from dataclasses import dataclass, field

import regex
from tokenizers import Tokenizer

#: Fixed value: the published split pattern of the byte-level family. White
#: space is the Unicode property here, as in the tokenizers library.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a vocabulary file:
    itself where printable, else the next letter from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


@functools.cache
def newer_letters() -> tuple[frozenset[str], re.Pattern]:
    """Letters and digits that this Python's Unicode tables do not have yet,
    and a pattern that finds any character from the first of them on.
    Libraries disagree on them, so texts with any go to the tokenizer itself."""
    unassigned = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    found = frozenset(regex.findall(r"[\p{L}\p{N}]", unassigned))
    return found, re.compile(f"[{min(found)}-\U0010ffff]")


def has_newer_letters(text: str) -> bool:
    found, later = newer_letters()
    return later.search(text) is not None and not found.isdisjoint(text)


@dataclass
class ByteBpe:
    """A tokenizer file as tables. ``merges`` ranks pairs of token ids."""

    content: str
    vocab: dict[bytes, int]
    merges: dict[tuple[int, int], tuple[int, int]]  # pair -> (rank, merged id)
    special: dict[str, int]
    splitter: regex.Pattern = field(init=False)
    at_special: regex.Pattern | None = field(init=False)

    def __post_init__(self):
        self.splitter = regex.compile(PATTERN)
        # the longest special string wins where several start
        names = sorted(self.special, key=lambda s: (-len(s), s))
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    @functools.cached_property
    def tokenizer(self) -> Tokenizer:
        """The library's own, some 50 MB: built when it is first asked."""
        tokenizer = Tokenizer.from_str(self.content)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    def pieces(self, text: str) -> list[str]:
        """The pieces of ``text`` in order; special strings are pieces too."""
        if self.at_special is None or not self.at_special.search(text):
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(self.at_special.split(text)):
            if i % 2:
                out.append(part)
            elif part:
                out += self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or not has_newer_letters(text):
            return self.splitter.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


def load(content: str) -> ByteBpe:
    """Tables of a tokenizer file's ``content``; refuses other kinds."""
    spec = json.loads(content)
    split = spec.get("pre_tokenizer") or {}
    model = spec["model"]
    if (model["type"] != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space")
            or not split.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges")
            or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")):
        raise ValueError("not a plain byte-level BPE tokenizer file")
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    if any(t.get(f) for t in spec["added_tokens"] for f in flags):
        raise ValueError("added tokens with matching flags are not supported")
    back = {ord(letter): byte for byte, letter in byte_letters().items()}
    raw = {token: bytes(back[ord(c)] for c in token) for token in model["vocab"] if all(ord(c) in back for c in token)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ids = model["vocab"]
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        merges[ids[left], ids[right]] = (rank, ids[left + right])
    return ByteBpe(content, {raw[t]: i for t, i in ids.items() if t in raw and t not in special}, merges, special)
