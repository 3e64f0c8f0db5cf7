"""Ids of whole texts by a lower-casing BPE tokenizer with word ends, found quickly.

The tokenizer cuts a text at its special strings, normalises each part, and takes words; white space goes. A word
has the same ids in any text, so each worker remembers the ids of the words it has met, up to a bound. Texts within
Latin-1, whose normal form is plain lower-casing, are cut by a pattern of explicit ranges, and new words get their
ids from a second implementation of the same merges, in which a space stands for a word's end. Other texts
are left to the tokenizer.
"""

from __future__ import annotations

import os
import re
from functools import cached_property, lru_cache

import numpy as np

from .pretokens import LETTERS, NUMBERS, SPACES, byte_letters, within_latin

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")

#: The tokenizer's own pattern; anything else isn't handled here.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Words a worker remembers, and their greatest length: some 40 MB.
REMEMBERED, LENGTH = 200_000, 64

#: Characters of a text that are cut into words at once; cuts are at spaces.
AT_ONCE = 1 << 20


class WordPieces(dict):
    """word -> its ids as little-endian 32-bit numbers; ``ids(text)`` for whole texts."""

    def __init__(self, path: str):
        import json

        import tiktoken

        super().__init__()
        self.path = path
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        steps = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or split[0].get("pattern", {}).get("Regex") != PATTERN:
            raise ValueError(f"{path} is not a tokenizer of lower-cased words")
        added = made.get("added_tokens", [])
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added):
            raise ValueError(f"{path} has added tokens that strip or want whole words")
        self.special = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in added}
        self.at_special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        vocabulary, end = made["model"]["vocab"], made["model"]["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in made["model"]["merges"]]
        letters = byte_letters()
        if any(vocabulary[a + b] != 512 + k for k, (a, b) in enumerate(merges)) or any(vocabulary[c] > 255 or not 256 <= vocabulary[c + end] < 512 for c in letters):
            raise ValueError(f"{path}: ids don't stand in the order of merges")
        self.ends = np.zeros(len(vocabulary), bool)
        ranks = {}
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith(end)
            ranks[bytes(letters[c] for c in token.removesuffix(end)) + b" " * bool(self.ends[i])] = i
        self.merges = tiktoken.Encoding("from-file", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def tokenizer(self):
        """Read when it is needed first."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of these words, which have no spaces; those that aren't long are remembered."""
        ids = self.merges.encode_to_numpy(" ".join(words) + " ", disallowed_special=()).astype("<u4", copy=False)
        cuts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
        data = ids.tobytes()
        found = {w: data[4 * a : 4 * b] for w, a, b in zip(words, cuts[:-1], cuts[1:], strict=True)}
        if len(self) + len(found) > REMEMBERED:
            self.clear()
        self.update((w, x) for w, x in found.items() if len(w) <= LENGTH)
        return found

    def part(self, text: str) -> bytes:
        """The ids of a text within Latin-1 that has no special strings."""
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > AT_ONCE:
                found = text.find(" ", at + AT_ONCE)
                end = end if found < 0 else found
            words = WORDS.findall(text[at:end].lower())
            ids = list(map(self.get, words))
            if None in ids:
                new = list({w for w, x in zip(words, ids, strict=True) if x is None})
                learned = self.learn(new)
                ids = [x if x is not None else learned[w] for w, x in zip(words, ids, strict=True)]
            out.append(b"".join(ids))
            at = end
        return b"".join(out)

    def ids(self, text: str) -> np.ndarray:
        if not within_latin(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        if self.at_special and any(x in text for x in self.special):
            found = b"".join(self.special[x] if k % 2 else self.part(x) for k, x in enumerate(self.at_special.split(text)))
        else:
            found = self.part(text)
        return np.frombuffer(found, "<u4")


@lru_cache(maxsize=2)
def wordpieces(path: str) -> WordPieces:
    """One per worker process and file."""
    return WordPieces(path)
