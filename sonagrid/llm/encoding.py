"""Exact batch encoding with the tokenizers library, with a bounded cache of units between spaces.

A byte-level BPE splits a text before it merges, and a space before a visible character always begins a new piece.
So a text without runs of white space can be cut at its spaces and line ends, each distinct unit encoded once by the
library, and the ids joined. Every other text goes to the library whole. A tokenizer of word ends that drops white space
splits at every space, so there all texts are cut at spaces and line ends. Results are the library's own.

Edge cases: the empty text has no ids; special strings inside texts are what the library makes of them; repeated texts
are looked up again; very long texts are encoded whole; no texts give no results.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import cache_of

#: White space other than single spaces and line ends, or the mark of a text's first unit: the text goes whole.
NOT_PLAIN = re.compile(r"[^\S\n ]|\s\s|\x01")
#: Characters that are encoded in one call when units are new.
JOINED_CHARS = 1 << 13


class UnitEncoder:
    """Texts to ids as packed little-endian unsigned 32-bit integers.

    max_units bounds the cache (about 0.2 kB a unit); when it is full it starts anew.
    """

    def __init__(self, tokenizer_file: str, max_units: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.by_units = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None and spec.get("truncation") is None and spec.get("padding") is None
            and not spec["model"].get("dropout") and not any(re.search(r"\s", s) for s in self.special)
            and not any(x.get("lstrip") or x.get("rstrip") for x in spec.get("added_tokens", []))
        )
        self.pattern = self._word_pattern(spec)
        self.max_units = max_units
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens_unit = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for piece, i in vocab.items():
            self.opens_unit[i] = piece.startswith("Ġ")  # byte-level BPE writes a space so
        for s in self.special:
            self.opens_unit[vocab[s]] = False
        self.ends_word = np.zeros(len(self.opens_unit), dtype=bool)
        if self.pattern is not None:
            for piece, i in vocab.items():
                self.ends_word[i] = piece.endswith(spec["model"]["end_of_word_suffix"])

    def _word_pattern(self, spec: dict):
        """The pattern of words, where they never hold white space, are the only thing kept, and end in a suffix of their own; else None."""
        import regex

        pre, normal, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}, spec["model"]
        parts, steps = pre.get("pretokenizers", []), normal.get("normalizers", [])
        if [p["type"] for p in parts] != ["Split", "ByteLevel"] or not model.get("end_of_word_suffix") or model.get("dropout") or spec.get("truncation") or spec.get("padding"):
            return None
        split, byte_level = parts
        if split["behavior"] != "Removed" or not split["invert"] or byte_level.get("use_regex", True) or byte_level.get("add_prefix_space"):
            return None
        if any(s["type"] not in ("NFC", "Lowercase") and (s["type"], s.get("pattern"), s.get("content")) != ("Replace", {"Regex": r"\s+"}, " ") for s in steps):
            return None
        pattern = split["pattern"].get("Regex", " ")
        if re.search(r"[ .]|\\s", re.sub(r"\[\^\\s[^\]]*\]", "", pattern)) or any(re.search(r"\s", s) for s in self.special):
            return None  # it might match white space
        self.lower = any(s["type"] == "Lowercase" for s in steps)
        return regex.compile(pattern)

    def _learn_words(self, units: list[str]) -> None:
        """New units of a tokenizer of word ends: the words of ASCII ones are joined and cut at their ends, units joined from their words; others go alone."""
        odd = [u for u in units if not u.isascii() or any(s in u for s in self.special)]
        alone, words = set(odd), self.words
        cut = {u: self.pattern.findall(u.lower() if self.lower else u) for u in units if u not in alone}
        new = list({w for ws in cut.values() for w in ws if w not in words})
        for at in range(0, len(new), JOINED_CHARS // 8):
            part = new[at : at + JOINED_CHARS // 8]
            packed = self._whole([" ".join(part)])[0]
            ends = [0, *((np.flatnonzero(self.ends_word[np.frombuffer(packed, dtype="<u4")]) + 1) * 4).tolist()]
            if len(ends) == len(part) + 1:
                words.update((w, packed[a:b]) for w, a, b in zip(part, ends, ends[1:], strict=False))
            else:
                words.update(zip(part, self._whole(part), strict=True))
        self.known.update((u, words[ws[0]] if len(ws) == 1 else b"".join(map(words.__getitem__, ws))) for u, ws in cut.items())
        self.known.update(zip(odd, self._whole(odd), strict=True))
        if len(words) > self.max_units // 2:
            self.words = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> None:
        alone = [u for u in units if not u or u[0] in "\n\x01" or any(s in u for s in self.special)]
        odd = set(alone)
        joined = [u for u in units if u not in odd]
        parts: list[list[str]] = [[]]
        chars = 0
        for u in joined:
            if chars >= JOINED_CHARS:
                parts.append([])
                chars = 0
            parts[-1].append(u)
            chars += len(u) + 1
        for part, packed in zip(parts, self._whole([" " + " ".join(p) for p in parts]) if joined else [], strict=False):
            ids = np.frombuffer(packed, dtype="<u4")
            cuts = np.flatnonzero(self.opens_unit[ids]) * 4
            if len(cuts) == len(part):
                ends = [*cuts[1:].tolist(), len(packed)]
                self.known.update((u, packed[a:b]) for u, a, b in zip(part, cuts.tolist(), ends, strict=True))
            else:
                alone += part
        spelled = [u[1:] if u[:1] == "\x01" else u if u[:1] == "\n" else " " + u for u in alone]
        self.known.update(zip(alone, self._whole(spelled), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        out: list[bytes | None] = [None] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            if self.pattern is not None:
                cut.append((i, text.replace("\n", " ").split(" ")))
            elif self.by_units and not NOT_PLAIN.search(text):
                units = text.replace("\n", " \n").split(" ")
                if not units[0]:
                    units = units[1:]
                else:
                    units[0] = "\x01" + units[0]
                cut.append((i, units))
            else:
                whole.append(i)
        if len(self.known) > self.max_units:
            self.known = {}
        known = self.known
        new: set[str] = set()
        for _, units in cut:
            new.update(u for u in units if u not in known)
        if new:
            (self._learn if self.pattern is None else self._learn_words)(list(new))
        for i, units in cut:
            out[i] = b"".join(map(known.__getitem__, units))
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out  # type: ignore[return-value]


def encoder(tokenizer_file: str) -> UnitEncoder:
    """This worker's encoder for a file; a reused Python worker keeps its cache."""
    kept = cache_of("encoding")
    if tokenizer_file not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        kept[tokenizer_file] = UnitEncoder(tokenizer_file)
    return kept[tokenizer_file]
