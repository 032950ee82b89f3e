"""Token ids for tokenizers that drop white space, memoised by word.

Such a tokenizer normalises white space, then splits by a pattern that never crosses it, so the ids of a text are those of its
white-space-free parts, one after the other.  Texts are cut at spaces, tabs and line ends only: every one of these separates for
the tokenizer, too, and no normal form composes across them.

A part of Latin letters, with one punctuation mark at most behind them, is the ids of its lower-case letters and those of the mark.  Where
every word ends in a token of its own kind (``</w>``), new ones are encoded in runs and the runs are cut at these tokens.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np

MEMO = 600_000
MEMO_CHARS = 64
GROUP_CHARS = 4 << 20
RUN = 128
_OTHER = re.compile(r"[\t\n\r]")
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")
_ENCODERS: dict[str, WordEncoder] = {}


def drops_white_space(spec: dict) -> bool:
    """Whether a tokenizer's description makes every white space a separator that leaves no id."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    joined = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps)
    first = splits[0] if splits else {}
    pattern = first.get("pattern", {}).get("Regex", " ")
    return bool(joined and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and " " not in pattern)


class WordEncoder:
    """``ids(texts)`` of whole texts; strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.tok.to_str())
        self.by_word = drops_white_space(spec)
        self.memo: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {"": b""}
        ends = spec["model"].get("end_of_word_suffix")
        vocabulary = self.tok.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        if ends:
            self.last[[i for t, i in vocabulary.items() if t.endswith(ends)]] = True
        lower = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        self.in_runs = bool(self.by_word and ends and lower and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\"))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Put the ids of each word into the memo."""
        split = {w: m.groups() for w in words if (m := _PLAIN.fullmatch(w))} if self.in_runs else {}
        letters = self.letters
        lower = {w: core.lower() for w, (core, _) in split.items()}
        new = list({*lower.values(), *(mark for _, mark in split.values())}.difference(letters))
        runs = [new[i : i + RUN] for i in range(0, len(new), RUN)]
        for i in range(0, len(runs), 64):
            some = runs[i : i + 64]
            for run, raw in zip(some, self._whole([" ".join(r) for r in some])):
                cuts = ((np.flatnonzero(self.last[np.frombuffer(raw, self.dtype)]) + 1) * self.dtype.itemsize).tolist()
                if len(cuts) != len(run):
                    letters.update(zip(run, self._whole(run)))
                else:
                    letters.update(zip(run, map(raw.__getitem__, map(slice, [0, *cuts], cuts))))
        memo = self.memo
        for w, (_, mark) in split.items():
            memo[w] = letters[lower[w]] + letters[mark]
        odd = [w for w in words if w not in split]
        for i in range(0, len(odd), 1024):
            memo.update(zip(odd[i : i + 1024], self._whole(odd[i : i + 1024])))
        if len(letters) > MEMO:
            for w in new:
                del letters[w]
            letters[""] = b""
        else:
            for w in new:
                if len(w) > MEMO_CHARS:
                    del letters[w]

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._whole(texts)
        gc.disable()  # the lists of words below are large and hold no cycles
        try:
            return self._by_word(texts)
        finally:
            gc.enable()

    def _by_word(self, texts: list[str]) -> list[bytes]:
        parts = [_OTHER.sub(" ", t).split(" ") for t in texts]
        fresh = list({w for p in parts for w in p}.difference(self.memo))
        memo = self.memo
        self._learn(fresh)
        out = [b"".join(map(memo.__getitem__, p)) for p in parts]
        full = len(memo) > MEMO
        for w in fresh:
            if full or len(w) > MEMO_CHARS:
                del memo[w]
        return out


def word_encoder(path: str) -> WordEncoder:
    """The encoder of a worker process; it lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def text_ids(path: str, texts: list[str]) -> Iterator[np.ndarray]:
    """Id arrays of ``texts`` in order, encoded in groups of bounded length."""
    enc, group, size = word_encoder(path), [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= GROUP_CHARS:
            yield from (np.frombuffer(b, enc.dtype) for b in enc.ids(group))
            group, size = [], 0
    yield from (np.frombuffer(b, enc.dtype) for b in enc.ids(group))
