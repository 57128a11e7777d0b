"""Substring dedup: relative Lempel-Ziv parsing against an index of reference blocks.

Reference blocks are cut by content. Of the word runs of length ``anchor`` inside a window of ``window`` words the one with
the smallest hash is the window's anchor; equal windows have equal anchors at equal offsets. The windows with one
anchor make up a block: the words from the first window's start to the last one's end. Every
block of every document is indexed by its anchor's hash and a digest of its words.

Documents are parsed against the index. A block that stands elsewhere as a whole is copied: its windows are all
duplicates, and neighbouring copied blocks grow into one factor. A factor ends where the block differs from
those with the same anchor. There, at the factor's boundary, window by window is compared: each
distinct block sends its windows' digests, and those that another block has too are duplicates. Blocks whose
anchor stands nowhere else are literals. The words under duplicate windows are the spans to remove.

A passage in very many documents is one block with a count before anything is compared, so neither pairs nor
lists of places are formed. Places meet the index by the block's key, hot keys through a bounded broadcast.

Defined results: a null text has no words; windows are judged on the input; texts shorter than a window keep all words;
repeated rows count as copies of each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import attach
from panelspark.session import materialize

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


class Parser:
    """Blocks of a document; ``known`` caches the hashes of words."""

    def __init__(self, window: int, anchor: int, cache: int = 500_000):
        self.window, self.anchor, self.cache = window, anchor, cache
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.cache:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def runs(self, words: list[bytes]) -> np.ndarray:
        """Hash of every run of ``anchor`` words, from running sums modulo 2**64."""
        h = self.hashes(words)
        n = len(h)
        with np.errstate(over="ignore"):
            up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE, np.uint64), dtype=np.uint64)])
            down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, INVERSE, np.uint64), dtype=np.uint64)])
            sums = np.concatenate([[np.uint64(0)], np.cumsum(h * up[:n], dtype=np.uint64)])
            out = (sums[self.anchor:] - sums[:-self.anchor]) * down[:n - self.anchor + 1]
            out ^= out >> np.uint64(29)
            return out * np.uint64(0xBF58476D1CE4E5B9)

    def blocks(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, anchor place, first window, last window) of every block."""
        if len(words) < self.window:
            return (np.array([], np.uint64), *[np.array([], np.int64)] * 3)
        runs = self.runs(words)
        span = self.window - self.anchor + 1
        view = np.lib.stride_tricks.sliding_window_view(runs, span)
        place = np.arange(len(view)) + np.concatenate(
            [view[k:k + 65536].argmin(axis=1) for k in range(0, len(view), 65536)])
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        return runs[place[first]], place[first], first, last


def digest(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


BLOCK = "id long, mark long, anchor long, body long, place long, back int, fore int"


def index_blocks(window: int, anchor: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = Parser(window, anchor)
        for batch in batches:
            for at in range(0, len(batch), 500):
                parts = []
                for i, m, text in batch.iloc[at:at + 500].itertuples(index=False):
                    words = words_of(text)
                    runs, place, first, last = parser.blocks(words)
                    if not len(runs):
                        continue
                    ends = np.cumsum([len(w) + 1 for w in words])
                    joined = b" ".join(words)
                    starts = np.r_[0, ends[:-1]]
                    # The digest covers the words and where the windows lie, relative to the anchor.
                    body = [xxhash.xxh3_64_intdigest(joined[s:e], (p - f) * 64 + l - f) for s, e, p, f, l in zip(
                        starts[first].tolist(), (ends[last + window - 1] - 1).tolist(), place.tolist(), first.tolist(), last.tolist())]
                    parts.append(pd.DataFrame({
                        "id": i, "mark": m, "anchor": runs.view(np.int64), "body": np.array(body, np.uint64).view(np.int64),
                        "place": place, "back": (place - first).astype(np.int32), "fore": (last - place).astype(np.int32)}))
                if parts:
                    yield pd.concat(parts, ignore_index=True)
    return run


def boundary_windows(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Digests of the windows of the listed blocks of a document."""
        for batch in batches:
            out = []
            for text, blocks in zip(batch["text"], batch["blocks"]):
                words = words_of(text)
                for b in blocks:
                    for start in range(b["place"] - b["back"], b["place"] + b["fore"] + 1):
                        out.append((b["anchor"], b["body"], start - b["place"], digest(words[start:start + window])))
            yield pd.DataFrame(out, columns=["anchor", "body", "offset", "seen"]).astype(
                {"anchor": "int64", "body": "int64", "offset": "int32", "seen": "int64"})
    return run


def duplicate_starts(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """docs (id, mark, text) to (id, mark, starts): first words of duplicate windows, one row per id and mark."""
    places = materialize(docs.mapInPandas(index_blocks(window, anchor), BLOCK))
    head = F.struct("id", "mark", "place", "back", "fore")
    index = places.groupBy("anchor", "body").agg(F.count("*").alias("n"), F.min(head).alias("head"))
    anchors = index.groupBy("anchor").agg(F.sum("n").alias("places"), F.count("*").alias("bodies"))
    found = materialize(index.join(anchors.where("places > 1"), "anchor"))

    # At factor boundaries: anchors with several bodies. A body's windows are read from its first place.
    border = found.where("bodies > 1").select("anchor", "body", "n", "head.*")
    wanted = border.groupBy("id", "mark").agg(F.collect_list(F.struct("anchor", "body", "place", "back", "fore")).alias("blocks"))
    texts = docs.join(wanted.withColumnsRenamed({"id": "w_id", "mark": "w_mark"}),
                      F.col("id").eqNullSafe(F.col("w_id")) & (F.col("mark") == F.col("w_mark")))
    windows = materialize(texts.select("text", "blocks").mapInPandas(
        boundary_windows(window), "anchor long, body long, offset int, seen long").distinct())
    shared = windows.groupBy("anchor", "offset", "seen").agg(F.count("*").alias("bodies")).where("bodies > 1")
    partly = windows.join(shared, ["anchor", "offset", "seen"]).groupBy("anchor", "body").agg(
        F.sort_array(F.collect_set("offset")).alias("offsets"))
    whole = found.where("n > 1").select("anchor", "body", F.lit(None).cast("array<int>").alias("offsets"))
    marks = materialize(whole.union(partly.join(whole, ["anchor", "body"], "left_anti")).join(
        found.select("anchor", "body", F.col("n").alias("rows")), ["anchor", "body"]))

    tag = F.struct("anchor", "body")
    total = places.count()
    met = attach(places.withColumn("tag", tag), marks.select(tag.alias("tag"), "offsets", "rows"), "tag", "rows", total,
                 F.xxhash64("id", "mark", "place")).where("rows is not null")
    all_offsets = F.sequence(-F.col("back"), F.col("fore"))
    starts = F.transform(F.coalesce("offsets", all_offsets), lambda o: (F.col("place") + o).cast("int"))
    return met.select("id", "mark", starts.alias("s")).groupBy("id", "mark").agg(
        F.array_distinct(F.flatten(F.collect_list("s"))).alias("starts"))


def spans(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Runs of words (first, end) under windows that begin at ``starts``."""
    starts = np.sort(starts)
    new = np.flatnonzero(np.r_[True, starts[1:] > starts[:-1] + window])
    return list(zip(starts[new].tolist(), (starts[np.r_[new[1:], len(starts)] - 1] + window).tolist()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35,
                   anchor: int = 12) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (array of first and end word) and kept, the text left."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    starts = duplicate_starts(own, window, anchor).withColumnsRenamed({"id": "s_id", "mark": "s_mark"})
    joined = own.join(starts, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("mark") == F.col("s_mark")), "left")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text, found in batch.itertuples(index=False):
                words = words_of(text)
                total, gone = len(words), []
                if found is not None and len(found):
                    gone = spans(np.asarray(found), window)
                    for a, b in reversed(gone):
                        del words[a:b]
                out.append((i, total, total - len(words), gone, b" ".join(words).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "spans", "kept"]).astype({"doc_id": "Int64"})

    return joined.select("id", "text", "starts").mapInPandas(
        cut, "doc_id long, n_words long, n_removed long, spans array<array<int>>, kept string")
