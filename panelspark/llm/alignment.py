"""Cross-tokenizer alignment: galloping intersection of two tokenizations' byte offsets.

The bytes of a text are cut by tokenizer A and by tokenizer B. The shorter of the two lists of token ends drives: each of
its ends is looked for in the longer list from where an earlier one was found, first in steps that double, then by binary
search between the last two. (The ends of many texts are searched side by side: every 32nd one starts from the
front, the others from the place of the one before them.) Ends found in both lists cut the tokens into groups.
The rank of an end in the longer list less the rank of the end before it is the run of tokens that one token overlaps;
these runs are the links.

A pair of ids that is linked counts once for each document. Documents are read in chunks of about
``chunk_chars`` characters; a chunk has a dictionary of its pairs with their numbers of documents, and its documents refer
to the dictionary by place. The dictionaries alone are summed over the corpus; the totals go back to the chunks,
which then add them up for each document. Texts are tokenized once, and no pair travels once for each document.

Defined results: null and empty texts, and those whose tokens' bytes are not the text's, have no tokens (zeros and an
empty hash) and hold no pair; of repeated rows each counts as a document; a null id stays null; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.tokens import Words, hf_encoder, slices, spaced, vocabulary_bytes
from panelspark.session import materialize

RUN = 32
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
SCHEMA = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held binary, "
          "pairs array<long>, docs array<long>")


def gallop(wanted: np.ndarray, ends: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each of ``wanted`` the first place from ``start`` on whose end is as large or larger."""
    top = len(ends) - 1
    low, high, step = start - 1, np.minimum(start, top), 1
    open_ = np.flatnonzero(ends[high] < wanted)
    while len(open_):
        low[open_] = high[open_]
        high[open_] = np.minimum(low[open_] + step, top)
        step *= 2
        open_ = open_[ends[high[open_]] < wanted[open_]]
    open_ = np.flatnonzero(high - low > 1)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        below = ends[middle] < wanted[open_]
        low[open_[below]] = middle[below]
        high[open_[~below]] = middle[~below]
        open_ = open_[high[open_] - low[open_] > 1]
    return high


def intersect(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising lists with the same last value: each short end's rank in ``long``, and whether it stands there."""
    leaders = gallop(short[::RUN], long, np.zeros(-(-len(short) // RUN), np.int64))
    rank = gallop(short, long, np.repeat(leaders, RUN)[:len(short)])
    return rank, long[rank] == short


def link_runs(rank: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First token of the longer list that each token of the shorter one overlaps, and how many it does."""
    first = np.concatenate([[0], rank[:-1] + common[:-1]])
    return first, rank - first + 1


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both vocabularies, from their files' bytes."""

    def __init__(self, a_data: bytes, b_data: bytes, cache_words: int = 500_000):
        import sentencepiece
        import tokenizers

        back = byte_level()
        names = tokenizers.Tokenizer.from_str(a_data.decode("utf-8")).get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
        sp = sentencepiece.SentencePieceProcessor(model_proto=b_data)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece reaches over a word's start")
        encode_a = hf_encoder(a_data, plain_specials=True)

        def both_a(parts):
            return encode_a([" " + p for p in parts])

        def both_b(parts):
            return sp.encode(parts, num_threads=1)

        def whole(parts):
            """1 for a part whose bytes both tokenizers keep."""
            own = [(" " + p).encode("utf-8", "surrogatepass") for p in parts]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            same = np.ones(len(parts), bool)
            for rows, names, lengths in zip(self.words.rows, (self.a_bytes, self.b_bytes), (self.a_size, self.b_size)):
                ids, many = rows.take(np.arange(len(rows.ends) - 1 - len(parts), len(rows.ends) - 1))
                ends = np.concatenate([[0], np.cumsum(lengths[ids])])[np.cumsum(many)]
                same &= np.diff(ends, prepend=0) == sizes
                if not same.all() or b"".join(map(names.__getitem__, ids.tolist())) != b"".join(own):
                    cut = np.cumsum(many).tolist()
                    same &= [b"".join(map(names.__getitem__, ids[e - m:e].tolist())) == o
                             for e, m, o in zip(cut, many.tolist(), own)]
            return same[:, None].astype(np.int32).tolist()

        self.words = Words([both_a, both_b, whole], cache_words)
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        self.b_bits = max(1, (len(self.b_bytes) - 1).bit_length())
        self.bits = self.b_bits + max(1, (len(self.a_bytes) - 1).bit_length())
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.width = len(str(most))
        self.digits = np.array([list(str(i).rjust(self.width).encode()) for i in range(most)], np.uint8)

    def whole_text(self, text: str, codes: np.ndarray) -> bool:
        own = (" " + text).encode("utf-8", "surrogatepass")
        return all(b"".join(map(names.__getitem__, rows.take(codes)[0].tolist())) == own
                   for rows, names in zip(self.words.rows, (self.a_bytes, self.b_bytes)))

    def align(self, texts: list[str | None]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the texts, and (text, pair, times), sorted, of the pairs that each holds."""
        parts = [spaced(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        codes = self.words.codes([p for x in parts for p in x])
        ends = np.cumsum(sizes)
        good = self.words.rows[2].take(codes)[0].astype(bool)
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(~good), "right")):
            at = slice(int(ends[k] - sizes[k]), int(ends[k]))
            good[at] = self.whole_text(texts[k], codes[at])
        codes, owner = codes[good], np.repeat(np.arange(len(texts)), sizes)[good]
        found = pd.DataFrame({c: np.zeros(len(texts), np.int64) for c in COUNTS})
        found["groups_sha256"] = ""
        if not len(codes):
            return found, *[np.empty(0, np.int64)] * 3
        a, a_sizes = self.words.rows[0].take(codes)
        b, b_sizes = self.words.rows[1].take(codes)
        a_doc, b_doc = np.repeat(owner, a_sizes), np.repeat(owner, b_sizes)
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_drives = len(a) <= len(b)
        rank, common = intersect(*((a_ends, b_ends) if a_drives else (b_ends, a_ends)))
        first, many = link_runs(rank, common)
        short, long, short_doc = (a, b, a_doc) if a_drives else (b, a, b_doc)
        place = np.arange(int(many.sum())) + np.repeat(first - np.cumsum(many) + many, many)
        x, y = np.repeat(short, many).astype(np.int64), long[place].astype(np.int64)
        pair = (x << self.b_bits | y) if a_drives else (y << self.b_bits | x)
        link_doc = np.repeat(short_doc, many)
        n = len(texts)
        found["n_a"], found["n_b"] = np.bincount(a_doc, minlength=n), np.bincount(b_doc, minlength=n)
        found["n_groups"] = np.bincount(short_doc[common], minlength=n)
        found["n_links"] = np.bincount(link_doc, minlength=n)
        cut = np.flatnonzero(common), rank[common]
        found["groups_sha256"] = self.hashes(a, b, a_doc, b_doc, *(cut if a_drives else cut[::-1]), n)
        keys = np.sort(link_doc << self.bits | pair)
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, times = keys[new], np.diff(np.r_[new, len(keys)])
        return found, keys >> self.bits, keys & ((1 << self.bits) - 1), times

    def hashes(self, a, b, a_doc, b_doc, a_cut, b_cut, n: int) -> list[str]:
        """SHA-256 of each text's groups: A ids by commas, a bar, B ids by commas, groups by semicolons."""
        a_head = np.r_[0, b_cut + 1]  # B tokens in the groups before
        b_head = np.r_[a_cut + 1, len(a)]  # A tokens up to the group's end
        a_group = np.repeat(np.arange(len(a_cut)), np.diff(np.r_[-1, a_cut]))
        b_group = np.repeat(np.arange(len(b_cut)), np.diff(np.r_[-1, b_cut]))
        at_a, at_b = np.arange(len(a)) + a_head[a_group], np.arange(len(b)) + b_head[b_group]
        total = len(a) + len(b)
        ids, mark, doc = np.empty(total, np.int32), np.full(total, ord(","), np.uint8), np.empty(total, np.int64)
        ids[at_a], ids[at_b], doc[at_a], doc[at_b] = a, b, a_doc, b_doc
        mark[at_a[a_cut]], mark[at_b[b_cut]] = ord("|"), ord(";")
        cells = np.empty((total, self.width + 1), np.uint8)
        cells[:, :-1], cells[:, -1] = self.digits[ids], mark
        used = cells != ord(" ")
        stops = np.cumsum(np.bincount(doc, weights=used.sum(axis=1), minlength=n).astype(np.int64))
        out, raw, last = [], memoryview(cells[used].tobytes()), 0
        for stop in stops.tolist():
            out.append(hashlib.sha256(raw[last:stop - 1]).hexdigest() if stop > last else "")
            last = stop
        return out


@lru_cache(maxsize=1)
def aligner_of(a_data: bytes, b_data: bytes) -> Aligner:
    """Kept by a worker from one task to the next, with its words."""
    return Aligner(a_data, b_data)


def squeeze(places: np.ndarray, times: np.ndarray) -> bytes:
    """Rising places in the chunk's dictionary and their times, as steps, compressed."""
    steps = np.diff(places, prepend=0)
    both = np.concatenate([steps, times])
    kind = "<u2" if not len(both) or both.max() < 1 << 16 else "<u4"
    return kind[2:].encode() + zstandard.compress(both.astype(kind).tobytes(), 1)


def unsqueeze(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.decompress(data[1:]), f"<u{data[:1].decode()}").astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def chunks(a_data: bytes, b_data: bytes, chunk_chars: int, slice_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, doc_id, text) to a row for each document and, closing each chunk, a row with its dictionary."""
        aligner = aligner_of(a_data, b_data)
        chunk, ids, rows, pairs, times, sizes, held = 0, [], [], [], [], [], 0
        schema = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("groups_sha256", pa.string()), ("held", pa.binary()),
            ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])

        def close() -> Iterator[pa.RecordBatch]:
            seen, places, docs = np.unique(np.concatenate(pairs), return_inverse=True, return_counts=True)
            ends = np.cumsum(np.concatenate(sizes))
            many, found = np.concatenate(times), pd.concat(rows, ignore_index=True)
            blobs = [squeeze(places[e - s:e], many[e - s:e]) for s, e in zip(np.diff(ends, prepend=0).tolist(), ends.tolist())]
            n = len(found)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, chunk)), pa.array([i for x in ids for i in x], pa.int64()),
                *[pa.array(found[c].to_numpy(), pa.int64()) for c in COUNTS],
                pa.array(found["groups_sha256"].tolist(), pa.string()), pa.array(blobs, pa.binary()),
                pa.nulls(n, schema.field("pairs").type), pa.nulls(n, schema.field("docs").type)], schema=schema)
            yield pa.RecordBatch.from_arrays([
                pa.array([chunk], pa.int64()), *[pa.nulls(1, f.type) for f in list(schema)[1:8]],
                pa.array([seen], schema.field("pairs").type), pa.array([docs], schema.field("docs").type)], schema=schema)

        for batch in batches:
            texts = batch.column(2).to_pylist()
            if texts and not rows:
                chunk = max(chunk, batch.column(0)[0].as_py() << 32)
            for first, end in slices(texts, slice_chars):
                found, doc, pair, many = aligner.align(texts[first:end])
                ids.append(batch.column(1).slice(first, end - first).to_pylist())
                rows.append(found)
                pairs.append(pair)
                times.append(many)
                sizes.append(np.bincount(doc, minlength=end - first))
                held += sum(len(t or "") for t in texts[first:end])
                if held >= chunk_chars:
                    yield from close()
                    chunk, ids, rows, pairs, times, sizes, held = chunk + 1, [], [], [], [], [], 0
        if rows:
            yield from close()
    return run


def score(docs: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
    """The documents of a chunk with the sums over their links of the pairs' totals (place, count, best)."""
    count, best = (np.zeros(int(totals["place"].max()) + 1 if len(totals) else 0, np.int64) for _ in range(2))
    count[totals["place"]], best[totals["place"]] = totals["count"], totals["best"]
    n_best, count_sum = [], []
    for data in docs["held"]:
        places, times = unsqueeze(data)
        n_best.append(int((best[places] * times).sum()))
        count_sum.append(int((count[places] * times).sum()))
    return docs.drop(columns=["chunk", "held"]).assign(n_best=n_best, count_sum=count_sum)


def align(docs: DataFrame, folder: str | None = None, a_file: str = "byte_bpe_50k.json", b_file: str = "piece_bpe_32k.model",
          id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 16_000_000,
          slice_chars: int = 1_500_000) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return totals_by_document(*linked(docs, folder, a_file, b_file, id_col, text_col, chunk_chars, slice_chars))


def linked(docs: DataFrame, folder: str | None = None, a_file: str = "byte_bpe_50k.json", b_file: str = "piece_bpe_32k.model",
           id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 16_000_000,
           slice_chars: int = 1_500_000) -> tuple[DataFrame, DataFrame]:
    """The chunks' rows, and the linked pairs of the corpus: a, b, docs and best (the highest of its a)."""
    data = [vocabulary_bytes(f, folder) for f in (a_file, b_file)]
    own = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col(id_col).cast("long").alias("doc_id"),
                      F.col(text_col).alias("text"))
    rows = materialize(own.mapInArrow(chunks(*data, chunk_chars, slice_chars), SCHEMA))
    bits = aligner_of(*data).b_bits
    each = rows.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "docs")).alias("x"))
    counted = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("count"))
    a = F.shiftright("pair", bits)
    counted = materialize(counted.select("pair", a.alias("a"), "count"))
    highest = counted.groupBy(F.col("a").alias("of")).agg(F.max("count").alias("most"))
    pairs = counted.join(highest, F.col("a") == F.col("of")).select(
        "pair", "a", F.col("pair").bitwiseAND(F.lit((1 << bits) - 1)).alias("b"), F.col("count").alias("docs"),
        (F.col("count") == F.col("most")).alias("best"))
    return rows, pairs


def totals_by_document(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    places = rows.where("pairs IS NOT NULL").select(
        F.col("chunk").alias("of_chunk"), F.posexplode("pairs").alias("place", "pair"))
    totals = places.join(pairs.select("pair", F.col("docs").alias("count"), F.col("best").cast("int").alias("best")), "pair")
    # Ids without nulls keep their digits on the way through pandas.
    found = rows.where("pairs IS NULL").select(
        "chunk", F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"),
        *COUNTS, "groups_sha256", "held")
    out = (found.groupBy("chunk").cogroup(totals.select("of_chunk", "place", "count", "best").groupBy("of_chunk"))
           .applyInPandas(score, f"no_id boolean, doc_id long, {' long, '.join(COUNTS)} long, groups_sha256 string, "
                                 "n_best long, count_sum long"))
    return out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), *COUNTS, "n_best", "count_sum", "groups_sha256")
