"""Token ids by the tokenizers library, with a bounded per-process cache of word pieces.

The two public tokenizers in use split a text into pieces before any merge, so a text's ids
are the ids of its pieces in order. Natural text repeats its words; encoding each distinct
piece once per process is several times faster than encoding each text. Whatever the cache
can't prove safe to split is encoded by the library as it stands.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from itertools import islice

import numpy as np

#: Pieces held by one process. Beyond it the older half stays: frequent pieces are met early.
CACHE_PIECES = 1_200_000
_LETTERS = re.compile(r"[^\W\d_]+")
_LOADED: dict[str, Encoder] = {}


def load(path: str) -> Encoder:
    """The encoder of this process for a tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


class Encoder:
    """``encode(text)`` gives the ids as a uint32 array, without added special tokens."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        #: The library takes these out of a text before it splits it; such texts are not split here.
        self.added = [t["content"] for t in added]
        self.kind = "whole" if any(t["normalized"] or t["content"].isalpha() for t in added) else self._kind(spec)
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self._clear()

    @staticmethod
    def _kind(spec: dict) -> str:
        """"spaced": byte-level pieces that carry their leading space; "words": white space is
        dropped and case folded; "whole": anything else, never split here."""
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "spaced"
        parts, norms = pre.get("pretokenizers") or [], (norm or {}).get("normalizers") or []
        if (
            [p.get("type") for p in parts] == ["Split", "ByteLevel"]
            and parts[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            and parts[0].get("invert")
            and not parts[1].get("add_prefix_space")
            and not parts[1].get("use_regex")
            and [n.get("type") for n in norms] == ["NFC", "Replace", "Lowercase"]
        ):
            return "words"
        return "whole"

    def _clear(self) -> None:
        #: Pieces and their ids as little-endian 32-bit bytes, without and with a leading space.
        self.bare: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> np.ndarray:
        return np.frombuffer(self._library([text])[0], "<u4")

    def _learn(self, space: bool, pieces: set[str]) -> None:
        """Encodes pieces not met before: the leading letters and the rest apart where that is safe."""
        cache = self.spaced if space else self.bare
        fold = self.kind == "words"
        units, tails, made = set(), set(), []
        for p in pieces:
            head = p
            if not p.isalpha() and (m := _LETTERS.match(p)) and m.group().isalpha() and (not fold or p.isascii() or unicodedata.is_normalized("NFC", p)):
                head = m.group()
            key = head
            # The library lower-cases letter by letter; Python's lower() differs only for a final sigma.
            if fold and head.isalpha() and (head.isascii() or "Σ" not in head and "İ" not in head and unicodedata.is_normalized("NFC", head)):
                key = head.lower()
            tail = p[len(head) :]
            if key not in cache:
                units.add(key)
            if tail and tail not in self.bare:
                tails.add(tail)
            if tail or key != p:
                made.append((p, key, tail))
        for keys, to, prefix in ((units, cache, " " if space else ""), (tails - units if not space else tails, self.bare, "")):
            if keys:
                batch = list(keys)
                to.update(zip(batch, self._library([prefix + k for k in batch] if prefix else batch), strict=True))
        for p, key, tail in made:
            cache[p] = cache[key] + self.bare[tail] if tail else cache[key]

    def _split(self, text: str) -> tuple[list[str], list[int]] | None:
        """Pieces and the places of those without a leading space; None where unsafe."""
        pieces = text.split()
        if self.kind == "words":
            # Split() also splits at four separators that the pattern does not know as white space.
            return None if any(c in text for c in "\x1c\x1d\x1e\x1f") else (pieces, [])
        seams = text.count(" ") + text.count("\n")
        if seams != len(pieces) - 1 or seams + sum(map(len, pieces)) != len(text):
            return None  # more than one white space between two pieces, or another kind of it
        counts = [x.count(" ") + 1 for x in text.split("\n")]
        starts, at = [], 0
        for c in counts:
            starts.append(at)
            at += c
        return pieces, starts

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        split = self._split(text) if self.kind != "whole" and not any(c in text for c in self.added) else None
        if split is None:
            return self.whole(text)
        pieces, starts = split
        if len(self.bare) + len(self.spaced) > CACHE_PIECES:
            self.bare, self.spaced = (dict(islice(c.items(), len(c) // 2)) for c in (self.bare, self.spaced))
        cache = self.bare if self.kind == "words" else self.spaced
        first = [pieces[s] for s in starts]
        if missing := {p for p in first if p not in self.bare}:
            self._learn(False, missing)
        found = list(map(cache.get, pieces))
        for s in starts:
            found[s] = b""
        if None in found:
            places = [n for n, k in enumerate(found) if k is None]
            self._learn(cache is self.spaced, {pieces[n] for n in places})
            for n in places:
                found[n] = cache[pieces[n]]
        if starts:
            if len(starts) > 1 and "\n" not in self.bare:
                self.bare["\n"] = self._library(["\n"])[0]
            for n, (s, p) in enumerate(zip(starts, first, strict=True)):
                found[s] = self.bare["\n"] + self.bare[p] if n else self.bare[p]
        return np.frombuffer(b"".join(found), "<u4")
