"""Public tokenizers over whole texts: distinct words are encoded once, texts are put together from them.

A text is cut only where no token can reach over the cut, so the ids are those of the whole text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np

#: Characters that any of the libraries may count as white space; no cut is made behind one of them.
DOUBT = "\\s\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u2581\u3000\ufeff"
ODD_SPACE = re.compile(f"(?:^|[{DOUBT}]) | $")
ODD_END = re.compile(f"[{DOUBT}]$")


def vocabulary_bytes(name: str, folder: str | None = None) -> bytes:
    """A vocabulary file, read by the driver; ``folder`` None is the one of the public tokenizers."""
    if folder is None:
        import public_tokenizers
        path = public_tokenizers.path(name)
    else:
        path = os.path.join(folder, name)
    with open(path, "rb") as f:
        return f.read()


def hf_encoder(data: bytes, plain_specials: bool) -> Callable[[list[str]], list[list[int]]]:
    """Texts to ids, without special tokens; ``plain_specials`` reads their strings as plain text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use the cores
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_str(data.decode("utf-8"))
    tokenizer.encode_special_tokens = plain_specials
    return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Ragged:
    """Rows of ids of any length."""

    def __init__(self):
        self.flat, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def add(self, rows: Sequence[Sequence[int]] | tuple[np.ndarray, np.ndarray]) -> None:
        """Lists of ids, or all ids one after another and the size of each row."""
        if isinstance(rows, tuple):
            new, sizes = rows
        else:
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            new = np.fromiter(chain.from_iterable(rows), np.int32, int(sizes.sum()))
        self.flat = np.concatenate([self.flat, new])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' ids one after another, and the size of each."""
        starts = self.ends[codes]
        sizes = self.ends[codes + 1] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(starts - ends + sizes, sizes)], sizes


class Known(dict):
    """Codes of words in the order in which they came; the ones just met are in ``new``."""

    def __init__(self, given=()):
        super().__init__(given)
        self.new: list = []

    def __missing__(self, word) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


class Words:
    """Codes of distinct words; ``encoders`` give each its rows, as ``Ragged.add`` takes them, kept until more than ``most`` words
    are held."""

    def __init__(self, encoders: Sequence[Callable[[list], list[list[int]] | tuple]], most: int = 600_000):
        self.encoders, self.most = encoders, most
        self.clear()

    def clear(self) -> None:
        self.known = Known()
        self.rows = [Ragged() for _ in self.encoders]

    def codes(self, words: list) -> np.ndarray:
        known = self.known
        out = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if known.new:
            if len(known) > max(self.most, len(known.new)):
                self.clear()
                return self.codes(words)
            for rows, encode in zip(self.rows, self.encoders):
                rows.add(encode(known.new))
            known.new = []
        return out


def spaced(text: str) -> list[str]:
    """The parts p of a text, not empty, so that " " + p one after another is " " + text.

    A part begins at a space behind a character that surely is no white space.
    """
    parts = text.split(" ")
    if not ODD_SPACE.search(text):
        return parts
    out, held = [], ""
    for k, part in enumerate(parts):
        held += part
        if k + 1 == len(parts):
            if held or not out:
                out.append(held)
            else:
                out[-1] += " "
        elif not held or ODD_END.search(held):
            held += " "
        else:
            out.append(held)
            held = ""
    return out


def slices(texts: Sequence[str | None], most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about ``most`` characters, one text at least."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(texts):
        yield first, len(texts)
