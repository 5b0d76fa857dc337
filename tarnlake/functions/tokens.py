"""Tokens of a model counted by its vocabulary: the longest piece that fits, letter by letter through a trie."""

from __future__ import annotations

import json
from collections.abc import Iterable

#: Words whose counts are kept.
KEPT = 1 << 17


class SubwordCounter:
    """count(text): pieces of all its words, and `special` for the marks that a model puts around a text.

    A word is taken apart from its left by the longest piece of the vocabulary that fits; a letter that begins none counts as
    one. Pieces may be marked where a word goes on ("##ing"), where it ends ("ing</w>") or where it begins ("▁in"), by which the style is
    told. Words are what white space parts; with lower, in lower case."""

    def __init__(self, vocabulary: Iterable[str], special: int = 2, lower: bool = False):
        pieces = [p for p in vocabulary if p]
        self.special, self.lower = special, lower
        ends, begins = sum(p.endswith("</w>") for p in pieces), sum(p.startswith("▁") for p in pieces)
        self.goes_on = any(p.startswith("##") for p in pieces) and not ends
        self.after, self.before = "</w>" if ends > begins else "", "▁" if begins > ends else ""
        self.first: dict = {}
        self.next: dict = {} if self.goes_on else self.first
        for p in pieces:
            inside = self.goes_on and p.startswith("##") and len(p) > 2
            node = self.next if inside else self.first
            for c in p[2:] if inside else p:
                node = node.setdefault(c, {})
            node[""] = True
        self._kept: dict[str, int] = {}

    @classmethod
    def from_file(cls, path: str, **options) -> SubwordCounter:
        """From a tokenizer's JSON file, or a file with a piece a line; the path is the caller's."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if not text.lstrip().startswith("{"):
            return cls(text.splitlines(), **options)
        vocabulary = json.loads(text)["model"]["vocab"]
        return cls(vocabulary if isinstance(vocabulary, dict) else (p for p, _ in vocabulary), **options)

    def pieces(self, word: str) -> list[str]:
        word, at, out = f"{self.before}{word}{self.after}", 0, []
        while at < len(word):
            node, best = self.next if at else self.first, at + 1
            for i in range(at, len(word)):
                node = node.get(word[i])
                if node is None:
                    break
                if "" in node:
                    best = i + 1
            if best == at + 1 and self.after and word[at:] == self.after:
                break  # the mark alone is no letter
            out.append(word[at:best])
            at = best
        return out

    def __call__(self, text: str) -> int:
        total, kept = self.special, self._kept
        for word in (text.lower() if self.lower else text).split():
            n = kept.get(word)
            if n is None:
                if len(kept) >= KEPT:
                    kept.clear()
                kept[word] = n = len(self.pieces(word))
            total += n
        return total
