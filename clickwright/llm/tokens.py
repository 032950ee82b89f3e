"""Token ids of whole texts with the ``tokenizers`` library, memoised by word.

For a byte-level BPE a space between two visible characters always starts a new pre-token, and nothing left of
it bears on what is right of it.  So a text may be cut at these spaces and the pieces encoded by themselves: the ids are the same.
Frequent pieces are then looked up instead of encoded again.  The memo holds about ``MEMO`` pieces a
worker; once it is full, new pieces are encoded once per batch.  For other tokenizers ``whole`` encodes texts undivided.

Where only numbers of ids are asked for (``counted``), the memo holds numbers and so up to ``SIZES`` pieces in about the same memory.
A worker holds one of the two memos, the one last used.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np

MEMO = 600_000
SIZES = 900_000
MEMO_CHARS = 64
RUN = 128
SLICE = 1 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")
_NEAR = re.compile(r" (?:(?=\s)|(?<=\s ))")
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.memo: dict[str, bytes] = {}
        self.sizes: dict[str, int] = {}
        if self.by_word:
            vocabulary = self.tok.get_vocab()
            self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
            self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # byte-level sign of a space

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def whole_sizes(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """Lists of pieces; in each the first is to be encoded as it is and the others after a space."""
        at = 0
        while at < len(text) or not at:
            cut = _CUT.search(text, at + SLICE) if len(text) - at > 2 * SLICE else None
            part = text[at : cut.start()] if cut else text[at:] if at else text
            yield _CUT.split(part) if _NEAR.search(part) or part[:1] == " " else part.split(" ")
            if not cut:
                return
            at = cut.start()

    def _learn(self, words: list[str], into: dict[str, bytes] | dict[str, int], sizes: bool = False) -> None:
        """Put the ids of `` word``, or their number, for each word into a dict.

        Words go in runs: in a run a token starts with a space just where a word does.  Words with white space of
        their own, which could join their neighbours, are encoded alone.
        """
        alone = self.whole_sizes if sizes else self.whole
        groups = []
        for i in range(0, len(words), RUN):
            group = words[i : i + RUN]
            run = " " + " ".join(group)
            if _NEAR.search(run) or run[-1].isspace():
                odd = {w for w in group if not w or " " in w or w[0].isspace() or w[-1].isspace()}
                into.update(zip(odd, alone([f" {w}" for w in odd])))
                group = [w for w in group if w not in odd]
                run = " " + " ".join(group)
            if group:
                groups.append((group, run))
        size = self.dtype.itemsize
        for i in range(0, len(groups), 64):
            some = groups[i : i + 64]
            for (group, _), raw in zip(some, self.whole([run for _, run in some])):
                at = np.flatnonzero(self.spaced[np.frombuffer(raw, self.dtype)])
                if len(at) != len(group):
                    into.update(zip(group, alone([f" {w}" for w in group])))
                    continue
                if sizes:
                    into.update(zip(group, np.diff(at, append=len(raw) // size).tolist()))
                    continue
                cuts = (at * size).tolist()
                into.update(zip(group, map(raw.__getitem__, map(slice, cuts, [*cuts[1:], len(raw)]))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes of ``dtype``."""
        if not self.by_word:
            return self.whole(texts)
        gc.disable()  # the lists of words below are large and hold no cycles
        try:
            self.sizes.clear()
            return self._by_word(texts, self.memo, False)
        finally:
            gc.enable()

    def count(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        if not self.by_word:
            return self.whole_sizes(texts)
        gc.disable()
        try:
            self.memo.clear()
            return self._by_word(texts, self.sizes, True)
        finally:
            gc.enable()

    def _by_word(self, texts: list[str], memo: dict, sizes: bool) -> list:
        pieces = [list(self._pieces(t)) for t in texts]
        heads = iter((self.whole_sizes if sizes else self.whole)([p.pop(0) for lists in pieces for p in lists]))
        words: set[str] = set()
        for lists in pieces:
            for p in lists:
                words.update(p)
        fresh = list(words.difference(memo))
        self._learn(fresh, memo, sizes)
        if sizes:
            out = [sum(next(heads) + sum(map(memo.__getitem__, p)) for p in lists) for lists in pieces]
        else:
            out = [b"".join(next(heads) + b"".join(map(memo.__getitem__, p)) for p in lists) for lists in pieces]
        full = len(memo) > (SIZES if sizes else MEMO)
        for w in fresh:
            if full or len(w) > MEMO_CHARS:
                del memo[w]
        return out


def encoder(path: str) -> Encoder:
    """The encoder of a worker process; it lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _grouped(texts: list[str], chars: int) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= chars:
            yield group
            group, size = [], 0
    yield group


def encoded(path: str, texts: list[str], chars: int = 4 << 20) -> Iterator[np.ndarray]:
    """Id arrays of ``texts`` in order, encoded in groups of bounded length."""
    enc = encoder(path)
    for group in _grouped(texts, chars):
        yield from (np.frombuffer(b, enc.dtype) for b in enc.encode(group))


def counted(path: str, texts: list[str], chars: int = 4 << 20) -> Iterator[int]:
    """Numbers of ids of ``texts`` in order, counted in groups of bounded length."""
    enc = encoder(path)
    for group in _grouped(texts, chars):
        yield from enc.count(group)
