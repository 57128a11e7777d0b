"""SentencePiece encoding and decoding: shared-prefix Viterbi.

A text is marked (a leading mark, a mark for every space) and cut into marked words: no piece reaches from inside one into
the next, so the best segmentation of the text is that of its words. Of a batch of documents the distinct words are sorted,
which is the depth-first order of their trie: going from one word to the next, the forward scores and
back pointers up to their common prefix are kept and only the rest is computed. A forward step looks
at the pieces that end at the position, found by walking a trie of reversed pieces.

The result is the segmentation with the largest sum of piece scores; of equal ones that whose last differing
piece starts first. A character without a piece counts 10 below the smallest score and becomes its
bytes' pieces (the unknown piece where the vocabulary has none). That is the library's result for a
unigram model over the same pieces; a model file trained by merges is read for its pieces and scores, and
the merge order it was trained with isn't replayed.

No shuffle: each document is encoded where it is read. Memory is bounded by a slice of ``slice_chars``
characters (or one document) and a cache of ``cache_words`` words.

Defined results: a null or empty text has no ids and decodes to the empty text; the mark U+2581 decodes to a space
(``round_trip`` is false for a text that holds it); repeated
rows and other columns stay as they are, except columns named like the result's, which are replaced; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import clear_names

MARK = "▁"
NAMES = ["n_tokens", "token_ids", "round_trip"]
PENALTY = 10


class Pieces:
    """A vocabulary read from a model file's bytes."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        for probe in ("a", " a", "a  b ", "ÉﬁΩ x"):
            if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
                raise ValueError("only models that keep the text as it is and add one leading mark are read")
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.unknown = sp.unk_id()
        self.bytes_of = {i: bytes([int(p[3:5], 16)]) for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.id_of_byte = {b[0]: i for i, b in self.bytes_of.items()}
        plain = [i for i in range(len(self.pieces)) if not (
            sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        whole = all(float(sp.get_score(i)).is_integer() for i in plain)
        number = int if whole else float
        self.lowest = min(number(sp.get_score(i)) for i in plain) - PENALTY
        self.tails: dict = {}
        chars = set()
        for i in plain:
            piece = self.pieces[i]
            if MARK in piece.lstrip(MARK):
                raise ValueError("a piece reaches over a word's start")
            node = self.tails
            for ch in reversed(piece):
                node = node.setdefault(ch, {})
            node[""] = (number(sp.get_score(i)), i)
            chars.update(piece)
        self.single = {c: self.tails[c][""] for c in chars if c in self.tails and "" in self.tails[c]}
        # A line break no piece has ends a word as well.
        cut = "" if "\n" in chars else "\n"
        self.words = re.compile(f"{MARK}*[^{MARK}{cut}]+|{MARK}+" + (f"|{cut}" if cut else ""))
        self.hidden = set(self.bytes_of) | {self.unknown} | {i for i in range(len(self.pieces)) if sp.is_control(i)}

    def split(self, text: str) -> list[str]:
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []

    def unknown_ids(self, ch: str) -> list[int]:
        found = [self.id_of_byte.get(b) for b in ch.encode("utf-8", "surrogatepass")]
        return [self.unknown] if None in found else found

    def encode_words(self, words: list[str], out: dict[str, list[int]]) -> None:
        """Segment ``words``, sorted and distinct, into ``out``."""
        tails, single, lowest = self.tails, self.single, self.lowest
        best, back, piece = [0], [0], [0]
        last = ""
        for word in words:
            same, most = 0, min(len(last), len(word))
            while same < most and last[same] == word[same]:
                same += 1
            del best[same + 1:], back[same + 1:], piece[same + 1:]
            for end in range(same, len(word)):
                start, node, top = end, tails.get(word[end]), None
                if word[end] not in single:
                    top, at, what = best[end] + lowest, end, -1
                while node is not None:
                    hit = node.get("")
                    if hit is not None:
                        score = best[start] + hit[0]
                        if top is None or score >= top:
                            top, at, what = score, start, hit[1]
                    if not start:
                        break
                    start -= 1
                    node = node.get(word[start])
                best.append(top)
                back.append(at)
                piece.append(what)
            ids, end = [], len(word)
            while end:
                what = piece[end]
                if what < 0:
                    ids += reversed(self.unknown_ids(word[end - 1]))
                else:
                    ids.append(what)
                end = back[end]
            ids.reverse()
            out[word] = ids
            last = word

    def decode(self, ids) -> str:
        pieces, bytes_of, out, raw = self.pieces, self.bytes_of, [], bytearray()
        hidden = self.hidden
        for i in ids:
            if i not in hidden:
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                out.append(pieces[i])
            elif i in bytes_of:
                raw += bytes_of[i]
            elif i == self.unknown:
                out.append("�")
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def slices(texts: list[str], most: int) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def model_bytes(path: str | None = None) -> bytes:
    """The vocabulary file; ``path`` None is the public 32,000-piece model."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str | None = None, text_col: str = "text", slice_chars: int = 8_000_000,
           cache_words: int = 300_000) -> DataFrame:
    """docs with n_tokens, token_ids and round_trip (decoding the ids gives the text) in place of the text.

    The driver reads the vocabulary file and sends it along with the tasks.
    """
    docs = clear_names(docs, NAMES)
    model = model_bytes(model_path)
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known = Pieces(model), {}
        for batch in batches:
            texts = [t or "" for t in batch.column(len(others)).to_pylist()]
            at = 0
            for part in slices(texts, slice_chars):
                split = [vocabulary.split(t) for t in part]
                new = {w for words in split for w in words if w not in known}
                if len(known) + len(new) > cache_words:
                    known.clear()
                    new = {w for words in split for w in words}
                vocabulary.encode_words(sorted(new), known)
                rows = []
                for words in split:
                    ids: list[int] = []
                    for w in words:
                        ids += known[w]
                    rows.append(np.array(ids, np.int32))
                sizes = np.array([len(r) for r in rows], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.concatenate(rows) if rows else np.array([], np.int32)
                same = [vocabulary.decode(r.tolist()) == t for r, t in zip(rows, part)]
                kept = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays(
                    [*[kept.column(i) for i in range(len(others))], pa.array(sizes),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(same, pa.bool_())],
                    names=[*[f"c{i}" for i in range(len(others))], *NAMES])

    # Numbered names: columns whose names differ in case only, or hold special characters, pass through.
    inputs = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.col(text_col).alias("text"))
    schema = ", ".join([*[f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others)],
                        "n_tokens long, token_ids array<int>, round_trip boolean"])
    done = inputs.mapInArrow(run, schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], *NAMES)


def decode(encoded: DataFrame, model_path: str | None = None, ids_col: str = "token_ids", to: str = "text") -> DataFrame:
    """encoded with the text of its ids in column ``to``."""
    model = model_bytes(model_path)

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Pieces(model)
        for batch in batches:
            yield batch.map(lambda ids: "" if ids is None else vocabulary.decode(list(ids)))

    return encoded.withColumn(to, text_of(F.col(ids_col)))
