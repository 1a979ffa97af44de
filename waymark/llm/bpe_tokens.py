"""Ids by the tokenizers library, with each distinct piece that its pattern matches encoded once for each worker.

A chunk runs from one single space to the next. Where no space of a text touches other white space, no match of the pattern crosses
such a border, so the ids of the text are the ids of its chunks in a row. The distinct chunks of a block are split by the pattern, and
matches not met before go through the library's BPE model, many to a call; texts are put together from their ids by position. Texts with
other spacing, with letters beyond the scripts whose classes every regex library agrees on, or with the string of a special token (which the
library, as it comes, takes for that token), are encoded whole by the library.
"""

from __future__ import annotations

import gc
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import strings

_BEYOND = re.compile(r"[^\x00-\u04ff\u2013-\u2026]")
#: White space among the letters that _BEYOND leaves, but for the single space.
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"
#: Letters of text whose distinct chunks are encoded together, about.
BLOCK = 12 << 20
#: Matches to remember for each worker, some 200 bytes each; beyond that it starts anew.
REMEMBER = 400_000
#: Matches that go through the model in one call, which holds some hundred bytes for each of their tokens.
TOGETHER = 16_384


def whole(text: str) -> bool:
    """Whether a text's spacing or letters call for encoding it in one."""
    if not text or "<|" in text or text[0].isspace() or text[-1].isspace() or "  " in text:
        return True
    for w in _WHITE:
        if w in text and (f"{w} " in text or f" {w}" in text):
            return True
    return not text.isascii() and _BEYOND.search(text) is not None


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the rest for U+0100 onwards."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


def _gathered(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """ids from each start, as many as its length, in a row."""
    ends = np.cumsum(lengths)
    return ids[np.arange(int(ends[-1])) + np.repeat(starts - (ends - lengths), lengths)]


class Encoder:
    """text -> little-endian unsigned 32-bit ids, as bytes; what the library gives without special tokens added."""

    def __init__(self, path: str, pattern: str, remember: int = REMEMBER) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        added = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        if not all(t.startswith("<|") for t in added):
            raise ValueError("a special token that doesn't begin with <| would be missed")
        self.matches = Tokenizer(self.whole.model)  # of matches in byte letters, a line each
        self.matches.pre_tokenizer, self.line = pre_tokenizers.Split("Ċ", "isolated"), self.whole.token_to_id("Ċ")
        self.split, self.letters, self.remember = regex.compile(pattern).findall, byte_letters(), remember
        self.forget()

    def forget(self) -> None:
        """Starts anew: no match is known."""
        self.known: dict[str, int] = {}  # the number of each match met before
        self.ids, self.many = np.zeros(0, "<u4"), np.zeros(0, np.int64)  # ids of all of them in a row, and how many each has

    def whole_ids(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _ids_of_matches(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all matches in a row, how many each has); letters of other encodings never reach the model."""
        plain = [m for m in found if "\n" not in m]
        coded = "\n".join(plain).encode().decode("latin-1").translate(self.letters).split("Ċ") if plain else []
        ids, many = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for i in range(0, len(coded), TOGETHER):
            made = np.array(self.matches.encode_batch_fast(["Ċ".join(coded[i : i + TOGETHER])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(made == self.line), len(made))
            ids.append(made[made != self.line]), many.append(np.diff(ends, prepend=-1) - 1)
        if len(plain) < len(found):  # those with a line's end come behind, and go where they belong
            rest = [self.whole_ids(m) for m in found if "\n" in m]
            ids, many = [*ids, *rest], [*many, np.array([len(r) for r in rest])]
            place = np.argsort(np.argsort(["\n" in m for m in found], kind="stable"))
            ids, many = np.concatenate(ids), np.concatenate(many)
            return _gathered(ids, (np.cumsum(many) - many)[place], many[place]), many[place]
        return np.concatenate(ids), np.concatenate(many)

    def _ids_of_chunks(self, chunks: list[str], heads: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in a row, each with a space before it, and of all heads, without one; how many each has)."""
        alone = [self.split(h) for h in heads]
        found = self.split(" " + " ".join(chunks))
        spaced = len(found)
        coded = pa.array(found + [m for a in alone for m in a], pa.large_string()).dictionary_encode()
        del found
        at, names = coded.indices.to_numpy(), strings(coded.dictionary)
        begins = np.flatnonzero(pc.starts_with(coded.dictionary, " ").to_numpy(zero_copy_only=False)[at[:spaced]])
        parts = np.array([len(a) for a in alone])
        begins = np.concatenate([begins, spaced + np.cumsum(parts) - parts])
        known = self.known
        fresh = [m for m in names if m not in known]
        if len(known) + len(fresh) > self.remember:
            self.forget()
            known, fresh = self.known, names
        if fresh:
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            ids, many = self._ids_of_matches(fresh)
            self.ids, self.many = np.concatenate([self.ids, ids]), np.concatenate([self.many, many])
        codes = np.fromiter(map(known.__getitem__, names), np.int64, len(names))[at]
        size = self.many[codes]
        return _gathered(self.ids, (np.cumsum(self.many) - self.many)[codes], size), np.add.reduceat(size, begins)

    def encode(self, texts: list[str]) -> list[bytes]:
        out, at, size = [b""] * len(texts), [], 0
        for i, t in enumerate(texts):
            if whole(t):
                out[i] = self.whole_ids(t).tobytes() if t else b""
                continue
            at.append(i)
            size += len(t)
            if size >= BLOCK:
                self._encode(texts, at, out)
                at, size = [], 0
        if at:
            self._encode(texts, at, out)
        return out

    def _encode(self, texts: list[str], at: list[int], out: list[bytes]) -> None:
        """Sets out at the places `at` of texts that can be cut."""
        collects = gc.isenabled()
        gc.disable()  # long lists of letters alone: there is nothing to collect
        try:
            self._put(texts, at, out)
        finally:
            if collects:
                gc.enable()

    def _put(self, texts: list[str], at: list[int], out: list[bytes]) -> None:
        lists = pc.split_pattern(pa.array([texts[i] for i in at], pa.large_string()), " ")
        many, coded = pc.list_value_length(lists).to_numpy(), lists.flatten().dictionary_encode()
        del lists
        codes = coded.indices.to_numpy().astype(np.int64)
        # the first chunk of a text has no space before it
        first = np.cumsum(many) - many
        heads, which = np.unique(codes[first], return_inverse=True)
        ids, size = self._ids_of_chunks(strings(coded.dictionary), strings(coded.dictionary.take(pa.array(heads))))
        codes[first] = len(coded.dictionary) + which
        length = size[codes]
        raw = _gathered(ids, (np.cumsum(size) - size)[codes], length).tobytes()
        cut = 4 * np.append(0, np.cumsum(np.add.reduceat(length, first)))
        for i, a, b in zip(at, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            out[i] = raw[a:b]


_made: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, pattern: str, remember: int = REMEMBER) -> Encoder:
    """One for each Python worker, file and size of its memory."""
    if (path, remember) not in _made:
        _made[path, remember] = Encoder(path, pattern, remember)
    return _made[path, remember]
