"""Exact pre-tokens and ids of a byte-level BPE tokenizer, found quickly.

The tokenizer cuts a text at its special strings, then each part into pre-tokens by a pattern. A pre-token
stands alone: encoding it by itself gives the ids it has in any text. Texts within Latin-1 are cut by a
pattern of explicit ranges; others by the Unicode pattern, as long as every character is assigned in the
Unicode version where the libraries agree; anything else by the tokenizer itself.

Ids of whole texts come from a second implementation of the same merges, made from the tokenizer's own file
and several times as fast; texts that it can't cut are encoded by the tokenizer.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import cached_property, lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Latin-1 letters, numbers and white space.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\\x09-\\x0d \\x85\\xa0"

LATIN = re.compile(f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


# Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def within_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def quick_encoder(made: dict, special: dict[str, int]):
    """An encoder of the same merges, or None where ids don't stand in the order of merges."""
    import tiktoken

    model = made["model"]
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if any(vocabulary.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)) or len(vocabulary) != 256 + len(merges):
        return None
    if any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    byte = byte_letters()
    return tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in vocabulary.items()}, special_tokens=special)


class PreTokenizer:
    """``cut(text)``: its pre-tokens in order, special strings as themselves; ``special``: special string to id."""

    def __init__(self, path: str):
        import json

        import regex

        self.path = path
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        if made.get("normalizer") or (made.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or made["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        added = made.get("added_tokens", [])
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added):
            raise ValueError(f"{path} has added tokens that strip or want whole words")
        self.special = {x["content"]: x["id"] for x in added}
        self.at_special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        self.wide = regex.compile(r" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.known: dict[str, bool] = {}
        self.fast = quick_encoder(made, self.special)

    @cached_property
    def tokenizer(self):
        """Read when it is needed first, as it takes far more memory than the rest."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def assigned(self, text: str) -> bool:
        """Whether all libraries know every character of the text."""
        known = self.known
        for c in set(text) - known.keys():
            known[c] = unicodedata.category(c) not in ("Cn", "Co")
        return all(known[c] for c in set(text))

    def part(self, text: str) -> list[str]:
        if within_latin(text):
            return LATIN.findall(text)
        if self.assigned(text):
            return self.wide.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def ids(self, text: str) -> np.ndarray:
        """The ids of a whole text; special strings inside have their own."""
        if self.fast and (within_latin(text) or self.assigned(text)):
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
            except ValueError:  # its pattern needs more stack than there is, as for a million spaces in a row
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        if self.at_special and any(x in text for x in self.special):
            out = []
            for k, x in enumerate(self.at_special.split(text)):
                out += [x] if k % 2 else self.part(x) if x else []
            return out
        return self.part(text)

    def encode(self, found: list[str]) -> list[list[int]]:
        """The ids of each pre-token, each encoded by itself."""
        return [x.ids for x in self.tokenizer.encode_batch(found, add_special_tokens=False)]

    def counts(self, found: list[str]) -> list[int]:
        """How many ids each pre-token has."""
        return [len(x) for x in self.tokenizer.encode_batch(found, add_special_tokens=False)]


@lru_cache(maxsize=2)
def pretokenizer(path: str) -> PreTokenizer:
    """One per worker process and file."""
    return PreTokenizer(path)
