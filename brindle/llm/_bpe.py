"""Tokenizer files, and faster encoders of plain pieces that give the same ids.

A piece that only holds plain characters is encoded by tiktoken over ranks that are read from the tokenizer's own file; any other
piece goes through the tokenizers library.  Byte-pair merges of one file give one result, whichever library applies them; tests hold the two
against each other.  Where a file's settings are not those an encoder was written for, the encoder isn't used.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

BATCH = 4096
#: What the tokenizers library makes of white space, letters, digits and marks (fixed values of the byte-level format).
BYTE_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_STATE: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, once in each process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = ("tokenizer", path)
    if key not in _STATE:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _STATE[key] = t
    return _STATE[key]


def settings(path: str) -> dict:
    key = ("settings", path)
    if key not in _STATE:
        with open(path, encoding="utf-8") as f:
            _STATE[key] = json.load(f)
    return _STATE[key]


def special_strings(path: str) -> list[bytes]:
    """Strings that the tokenizer takes for tokens of their own wherever they stand in a text."""
    return [t["content"].encode() for t in settings(path).get("added_tokens") or []]


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in out)
    return out | {b: chr(256 + i) for i, b in enumerate(rest)}


def merges_ascend(model: dict) -> bool:
    """Whether ids of merged tokens ascend as the merges do, so that an id serves as a rank."""
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    ids = [model["vocab"].get(a + b, -1) for a, b in pairs]
    return all(x < y for x, y in zip(ids, ids[1:], strict=False)) and (not ids or ids[0] >= 0)


def encoded(path: str, items: list[str]) -> Iterator[list[int]]:
    for i in range(0, len(items), BATCH):
        for e in tokenizer(path).encode_batch_fast(items[i : i + BATCH], add_special_tokens=False):
            yield e.ids


class ByteLevel:
    """Token counts of pieces under a byte-level vocabulary."""

    #: ASCII without controls, Latin and Cyrillic letters, dashes and quotation marks: of one class in every Unicode version.
    PLAIN = re.compile(r"[\x20-\x7eÀ-ÖØ-öø-ſЀ-ѿ‐-‧]+").fullmatch

    def __init__(self, path: str):
        self.path, s = path, settings(path)
        pre, model = s.get("pre_tokenizer") or {}, s["model"]
        self.cuts = (
            s.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        )
        self.fast = None
        if self.cuts and merges_ascend(model):
            try:
                import tiktoken
            except ImportError:
                return
            back = {c: b for b, c in byte_symbols().items()}
            if all(c in back for t in model["vocab"] for c in t):
                ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items()}
                self.fast = tiktoken.Encoding("plain", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
                self.line = ranks[b"\n"]

    def lengths(self, pieces: list[bytes]) -> list[int]:
        out, plain, texts, other = [0] * len(pieces), [], [], []
        for i, p in enumerate(pieces):
            t = p.decode("utf-8", "replace")
            # A line break before a piece stays a token of its own if at most one space follows; so pieces go as one text.
            if self.fast and self.PLAIN(t) and t[-1] != " " and t[:2] != "  ":
                plain.append(i)
                texts.append(t)
            else:
                other.append((i, t))
        for lo in range(0, len(plain), BATCH):
            ids = np.array(self.fast.encode_ordinary("\n".join(texts[lo : lo + BATCH])), np.int64)
            ends = np.append(np.flatnonzero(ids == self.line), len(ids))
            for i, n in zip(plain[lo : lo + BATCH], np.diff(ends, prepend=-1).tolist(), strict=True):
                out[i] = n - 1
        for (i, _), ids in zip(other, encoded(self.path, [t for _, t in other]), strict=True):
            out[i] = len(ids)
        return out


class WordEnds:
    """Token ids of pieces under a lower-casing vocabulary with word ends, which drops white space."""

    #: Latin letters that are lower-cased one for one and stay composed: one pre-token.
    LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch

    def __init__(self, path: str):
        self.path, s = path, settings(path)
        model = s["model"]
        end, self.fast = model.get("end_of_word_suffix") or "", None
        lowers = any(n.get("type") == "Lowercase" for n in (s.get("normalizer") or {}).get("normalizers", []))
        self.cuts = bool(end) and lowers and model.get("type") == "BPE" and not model.get("dropout")
        if not (self.cuts and merges_ascend(model)):
            return
        try:
            import tiktoken
        except ImportError:
            return
        # Bytes of lower-case Latin letters, within a word and at its end, as 118 ASCII characters: a word is then plain text to the other library.
        letters = [*range(97, 123), 0xC3, *range(0x9F, 0xB7), *range(0xB8, 0xC0)]
        codes = iter(c for c in range(1, 128) if c != 10)
        inner, last = {b: next(codes) for b in letters}, {b: next(codes) for b in letters}
        symbols, ranks = byte_symbols(), {b"\n": 1 << 20}
        inside = {symbols[b]: inner[b] for b in letters}
        final = {symbols[b]: last[b] for b in letters}
        for token, i in model["vocab"].items():
            whole = token.endswith(end)
            chars = token[: -len(end)] if whole else token
            if chars and all(c in inside for c in chars):
                ranks[bytes([*(inside[c] for c in chars[:-1]), (final if whole else inside)[chars[-1]]])] = i
        self.inner, self.last = (bytes(x.get(b, 0) for b in range(256)) for x in (inner, last))
        self.fast = tiktoken.Encoding("letters", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})

    def ids(self, pieces: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of the pieces; in it, how many ids each has, and all ids one after another."""
        words, order, other = [], [], []
        for i, p in enumerate(pieces):
            w = p.lower()
            if self.fast and (w.isalpha() or self.LETTERS(t := p.decode("utf-8", "replace"))):
                words.append(w if w.isascii() else t.lower().encode())
                order.append(i)
            else:
                other.append(i)
        size, flat = [], []
        for lo in range(0, len(words), BATCH):
            mapped = b"\n".join([w[:-1].translate(self.inner) + w[-1:].translate(self.last) for w in words[lo : lo + BATCH]]).decode("ascii")
            ids = np.array(self.fast.encode_ordinary(mapped), np.int64)
            ends = np.append(np.flatnonzero(ids == 1 << 20), len(ids))
            size.append(np.diff(ends, prepend=-1) - 1)
            flat.append(ids[ids != 1 << 20])
        rest = list(encoded(self.path, [pieces[i].decode("utf-8", "replace") for i in other]))
        size.append(np.array([len(x) for x in rest], np.int64))
        flat += [np.array(x, np.int64) for x in rest]
        return order + other, np.concatenate(size), np.concatenate([np.empty(0, np.int64), *flat])


def shared(kind: type, path: str):
    """One encoder of a kind for each file and process."""
    key = (kind, path)
    if key not in _STATE:
        _STATE[key] = kind(path)
    return _STATE[key]
