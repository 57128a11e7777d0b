"""Best-fit packing: a grouping genetic algorithm on islands, with elite migration.

Documents become token ids and an end id; longer ones than a sequence are cut. Whole pieces of a sequence's length stand alone;
the others are dealt by a seeded hash into groups of about ``group_pieces`` pieces. A group is packed by several islands,
each a population of packings. A packing starts from best fit over the pieces in falling, slightly shuffled order.
Crossover takes the well-filled sequences of one parent whole, drops the sequences of the other that hold any of their
pieces, and best-fits the pieces displaced by that; mutation empties the worst-filled sequences. After each epoch an
island sends its elite packing to its neighbour, through a Spark exchange.

Of a group's best packing the sequences filled to ``keep`` stay. The pieces of the others are dealt anew, into as few
groups as they fill, and packed with those of other groups, until one group holds them all or they
don't get fewer. So no group's remainder stays part-filled, and no task meets more than a group.

Seeds follow from the group and the island and pieces are sorted first, so a task that runs again gives the same packing.

Defined results: a null or empty text is the end id alone; repeated rows and null ids are packed row by row; input columns
but the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.tokens import Known, Ragged, Words, hf_encoder, slices, vocabulary_bytes
from panelspark.session import materialize

#: Signs that may stand behind a word; ends of words that surely are letters or digits; bytes of marks that combine.
SIGNS = b".,;:!?$%&*#|<>()[]{}\"+-=/_~^@"
SURE_END, MAY_COMBINE = re.compile(rb"[0-9A-Za-z]$|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]$"), re.compile(rb"[\xcc\xcd]")

#: Signs at a line's end that stand behind a sure end. The first sign comes first in the pattern, so that it is sought fast.
SIGN = b"[" + re.escape(SIGNS) + b"]"
TAIL = re.compile(
    b"(" + SIGN + rb"(?:(?<=[0-9a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))" + SIGN + rb"*)\n\n")

#: Bits of a sequence's number: the round it was packed in, its group, its place in the group.
GROUP_BITS, BIN_BITS = 36, 20


class BestFit:
    """Open sequences by the room they have left."""

    def __init__(self, capacity: int, rooms: list[int]):
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some, self.capacity, self.count = 0, capacity, len(rooms)
        for b, room in enumerate(rooms):
            if room:
                self.at[room].append(b)
                self.some |= 1 << room

    def put(self, length: int) -> int:
        """The sequence with the least room that ``length`` fits in; a new one where none has room."""
        fit = self.some >> length
        if fit:
            room = (fit & -fit).bit_length() - 1 + length
            stack = self.at[room]
            b = stack.pop()
            if not stack:
                self.some ^= 1 << room
        else:
            b, room = self.count, self.capacity
            self.count += 1
        room -= length
        if room:
            if not self.at[room]:
                self.some |= 1 << room
            self.at[room].append(b)
        return b


def best_fit(lengths: np.ndarray, capacity: int, order: np.ndarray, bins: np.ndarray | None = None) -> np.ndarray:
    """The sequence of each piece. ``order``: pieces still to be placed; ``bins``: where the others are, -1 for those."""
    out = np.full(len(lengths), -1, np.int64) if bins is None else bins
    placed = out >= 0
    fill = np.bincount(out[placed], weights=lengths[placed]).astype(np.int64)
    state = BestFit(capacity, (capacity - fill).tolist())
    put = state.put
    out[order] = [put(n) for n in lengths[order].tolist()]
    return out


def renumber(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1]


def fills(bins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=lengths).astype(np.int64)


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer sequences first, then fuller ones: larger is better."""
    fill = fills(bins, lengths) / capacity
    return -len(fill), float((fill ** 2).sum())


def falling(lengths: np.ndarray, some: np.ndarray, rng: np.random.Generator, blur: float) -> np.ndarray:
    return some[np.argsort(-lengths[some] * (1 + blur * rng.random(len(some))), kind="stable")]


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Well-filled sequences of ``b``, whole, into ``a``."""
    fill = fills(b, lengths)
    # Full ones first, ties at random; half of the sequences at most.
    take = np.argsort(-(fill + rng.random(len(fill))))[:rng.integers(1, max(2, len(fill) // 2 + 1))]
    injected = np.zeros(len(fill), bool)
    injected[take] = True
    moved = injected[b]
    broken = np.zeros(int(a.max()) + 1, bool)
    broken[a[moved]] = True
    child = np.where(moved, b + len(broken), np.where(broken[a], -1, a))
    displaced = np.flatnonzero(child < 0)
    child[child >= 0] = renumber(child[child >= 0])
    return best_fit(lengths, capacity, falling(lengths, displaced, rng, 0.05), child)


def mutate(a: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Empty the worst-filled sequences and a few others, and place their pieces again."""
    fill = fills(a, lengths)
    worst = np.argsort(fill + 0.02 * capacity * rng.random(len(fill)))[:max(2, len(fill) // 50)]
    gone = np.zeros(len(fill), bool)
    gone[worst] = True
    gone[rng.integers(0, len(fill), len(worst))] = True
    out = np.where(gone[a], -1, a)
    displaced = np.flatnonzero(out < 0)
    out[out >= 0] = renumber(out[out >= 0])
    return best_fit(lengths, capacity, falling(lengths, displaced, rng, 0.1), out)


def evolve(lengths: np.ndarray, capacity: int, start: list[np.ndarray], rng: np.random.Generator, population: int,
           generations: int) -> np.ndarray:
    """The best packing found; ``start`` are packings to begin with."""
    every, least = np.arange(len(lengths)), -(-int(lengths.sum()) // capacity)
    rated = [(fitness(p, lengths, capacity), k, p) for k, p in enumerate(start)]
    while len(rated) < population:
        p = best_fit(lengths, capacity, falling(lengths, every, rng, 0.02 * len(rated)))
        rated.append((fitness(p, lengths, capacity), len(rated), p))
    for step in range(generations):
        rated = sorted(rated, key=lambda x: (x[0], -x[1]), reverse=True)[:population]
        if -rated[0][0][0] <= least:  # no packing has fewer sequences
            break
        i, j = sorted(rng.choice(len(rated), 2, replace=False).tolist()) if len(rated) > 1 else (0, 0)
        for child in (crossover(rated[i][2], rated[j][2], lengths, capacity, rng),
                      crossover(rated[j][2], rated[i][2], lengths, capacity, rng),
                      mutate(rated[0][2], lengths, capacity, rng)):
            rated.append((fitness(child, lengths, capacity), population + step * 3 + len(rated), child))
    return max(rated, key=lambda x: (x[0], -x[1]))[2]


def island(capacity: int, population: int, generations: int, seed: int, epoch: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """One island's pieces, with its own elite and its neighbour's: a new elite."""
        rows = rows.sort_values(["pid", "sender"])
        senders = rows["sender"].unique().tolist() if epoch else []
        pieces = rows if not epoch else rows[rows["sender"] == senders[0]]
        lengths = pieces["length"].to_numpy()
        start = [renumber(rows.loc[rows["sender"] == s, "bin"].to_numpy()) for s in senders]
        group, number = int(pieces["grp"].iloc[0]), int(pieces["island"].iloc[0])
        rng = np.random.default_rng([seed, epoch, group, number])
        return pieces[["grp", "island", "pid", "length"]].assign(
            bin=evolve(lengths, capacity, start, rng, population, generations))
    return run


def finish(capacity: int, keep: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The islands' elites of a group: the best one, with each piece's place in its sequence, and its fill."""
        rows = rows.sort_values(["island", "pid"])
        elites = [p for _, p in rows.groupby("island")]
        best = max(elites, key=lambda p: (fitness(p["bin"].to_numpy(), p["length"].to_numpy(), capacity), -p["island"].iloc[0]))
        best = best.sort_values(["bin", "pid"])
        ends = best.groupby("bin")["length"].cumsum()
        return best[["grp", "pid", "length", "bin"]].assign(
            offset=ends - best["length"], kept=best.groupby("bin")["length"].transform("sum") >= keep)
    return run


def pack_lengths(pieces: DataFrame, capacity: int = 2048, group_pieces: int = 4096, islands: int = 2, epochs: int = 2,
                 population: int = 4, generations: int = 6, keep: float = 0.999, seed: int = 5) -> DataFrame:
    """pieces (pid, length), pid unique, to (pid, sequence_id, offset)."""
    done, level, before = [], 0, None
    rest = pieces
    while True:
        many = rest.count()
        if not many and done:
            break
        groups = max(1, -(-many // group_pieces))
        last = groups == 1 or (before is not None and many > 0.8 * before)
        deal = F.pmod(F.xxhash64(F.lit(seed + level), "pid"), F.lit(groups))
        state = rest.select(deal.alias("grp"), F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"),
                            F.lit(-1).alias("sender"), "pid", "length", F.lit(-1).cast("long").alias("bin"))
        for epoch in range(epochs):
            elite = state.groupBy("grp", "island").applyInPandas(
                island(capacity, population, generations, seed + level, epoch),
                "grp long, island int, pid long, length long, bin long")
            if epoch + 1 < epochs:  # the elite stays and also goes to the next island of the group
                to = F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(islands)))
                state = materialize(elite.withColumn("sender", F.col("island")).withColumn(
                    "island", F.explode(F.array_distinct(to))))
        packed = materialize(elite.groupBy("grp").applyInPandas(
            finish(capacity, 0 if last else int(np.ceil(keep * capacity))),
            "grp long, pid long, length long, bin long, offset long, kept boolean"))
        number = (F.lit(level << (GROUP_BITS + BIN_BITS)) + F.shiftleft("grp", BIN_BITS) + F.col("bin")).alias("sequence_id")
        done.append(packed.where("kept").select("pid", number, "offset"))
        if last:
            break
        rest, before, level = packed.where("NOT kept").select("pid", "length"), many, level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


class Stems:
    """Ids of words (bytes without ASCII white space) from those of their stems and of the signs behind them.

    This tokenizer lower-cases and cuts between letters or digits and other signs. Only a cut behind an ASCII or Latin-1 letter or
    digit is made here, and letters are lowered only where nothing combines with them; the ids are those of the whole word.
    New parts are encoded many to a text, with ``BAR`` between them: a bar between spaces is a token of its own and no part has one.
    """

    BAR = b"|"

    def __init__(self, data: bytes, most: int = 600_000, at_once: int = 500):
        self.encode, self.most, self.at_once = hf_encoder(data, plain_specials=False), most, at_once
        self.bar = self.encode([self.BAR.decode()])[0]
        self.clear()

    def clear(self) -> None:
        self.known, self.rows = Known({b"": 0}), Ragged()
        self.rows.add([[]])

    def divide(self, word: bytes) -> tuple[bytes, bytes]:
        if b"<|" in word:
            return word, b""
        stem = word.rstrip(SIGNS)
        if len(stem) == len(word) or not SURE_END.search(stem):
            stem = word
        tail = word[len(stem):]
        return (stem if MAY_COMBINE.search(stem) else stem.lower()), tail

    def parts(self, words: list[bytes]) -> list[bytes]:
        """Stem and tail of each word, one after another."""
        lines = b"\n\n".join(words) + b"\n\n"
        if b"<|" in lines or MAY_COMBINE.search(lines):
            return [p for w in words for p in self.divide(w)]
        return TAIL.sub(rb"\n\1\n", lines.lower()).split(b"\n")[:-1]

    def encode_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of parts one after another, and how many each has."""
        flats, sizes = [], []
        for k in range(0, len(parts), self.at_once):
            some = parts[k:k + self.at_once]
            text = (b" " + self.BAR + b" ").join(some)
            if len(self.bar) == 1 and text.count(self.BAR) == len(some) - 1 and b"<|" not in text:
                ids = np.array(self.encode([text.decode("utf-8", "surrogatepass")])[0], np.int32)
                bars = np.flatnonzero(ids == self.bar[0])
                if len(bars) == len(some) - 1:
                    flats.append(ids[ids != self.bar[0]])
                    sizes.append(np.diff(bars, prepend=-1, append=len(ids)) - 1)
                    continue
            rows = self.encode([p.decode("utf-8", "surrogatepass") for p in some])
            flats.append(np.array([i for row in rows for i in row], np.int32))
            sizes.append(np.array([len(row) for row in rows], np.int64))
        return np.concatenate(flats), np.concatenate(sizes)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words one after another, and how many each has."""
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        if len(self.known) > self.most:
            self.clear()
        known = self.known
        codes = np.fromiter(map(known.__getitem__, self.parts(words)), np.int64, 2 * len(words))
        if known.new:
            self.rows.add(self.encode_parts(known.new))
            known.new = []
        flat, sizes = self.rows.take(codes)
        return flat, sizes.reshape(-1, 2).sum(1)


@lru_cache(maxsize=1)
def words_of(data: bytes) -> Words:
    """Kept by a worker from one task to the next."""
    return Words([Stems(data).ids])


def cut(data: bytes, capacity: int, end_id: int, slice_chars: int, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(doc_id, text) to doc_id, its pieces' lengths and CRC-32s and, if asked for, ids."""
        words = words_of(data)
        for batch in batches:
            texts = batch["text"].tolist()
            for first, end in slices(texts, slice_chars):
                split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts[first:end]]
                sizes = np.fromiter(map(len, split), np.int64, len(split))
                codes = words.codes([w for x in split for w in x])
                flat, many = words.rows[0].take(codes)
                stops = np.concatenate([[0], np.cumsum(many)])[np.cumsum(sizes)].tolist()
                ids, lengths, sums, at = [], [], [], 0
                for stop in stops:
                    own = np.append(flat[at:stop], np.int32(end_id)).astype("<u4")
                    at = stop
                    parts = [own[k:k + capacity] for k in range(0, len(own), capacity)]
                    ids.append(own.view("<i4") if with_ids else None)
                    lengths.append([len(p) for p in parts])
                    sums.append([zlib.crc32(p.tobytes()) for p in parts])
                yield pd.DataFrame({"no_id": batch["no_id"].iloc[first:end], "doc_id": batch["doc_id"].iloc[first:end], "ids": ids,
                                    "lengths": lengths, "sums": sums})
    return run


def tokenized(docs: DataFrame, folder: str | None, file: str, id_col: str, text_col: str, capacity: int, end_id: int,
              slice_chars: int, with_ids: bool) -> DataFrame:
    """One row per piece, written once: pid, doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    Words are cut at ASCII white space, which this tokenizer drops and over which no token reaches.
    """
    given = F.col(id_col).cast("long")  # ids without nulls keep their digits on the way through pandas
    own = docs.select(given.isNull().alias("no_id"), F.coalesce(given, F.lit(0).cast("long")).alias("doc_id"),
                      F.col(text_col).alias("text"))
    made = own.mapInPandas(cut(vocabulary_bytes(file, folder), capacity, end_id, slice_chars, with_ids),
                           "no_id boolean, doc_id long, ids array<int>, lengths array<long>, sums array<long>")
    spread = made.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), *["ids"] * with_ids, F.posexplode(F.arrays_zip("lengths", "sums")).alias("piece", "p"))
    start = (F.col("piece") * capacity).cast("long")
    ids = [F.slice("ids", start.cast("int") + 1, F.col("p.lengths").cast("int")).alias("ids")] if with_ids else []
    return materialize(spread.select(
        F.monotonically_increasing_id().alias("pid"), "doc_id", "piece", start.alias("start"), F.col("p.lengths").alias("length"),
        F.col("p.sums").alias("ids_crc32"), *ids))


def pack(docs: DataFrame, folder: str | None = None, file: str = "word_bpe_49k.json", id_col: str = "doc_id",
         text_col: str = "text", capacity: int = 2048, end_id: int = 0, slice_chars: int = 2_000_000,
         with_ids: bool = False, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids."""
    pieces = tokenized(docs, folder, file, id_col, text_col, capacity, end_id, slice_chars, with_ids)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    whole = pieces.where(F.col("length") == capacity).select(
        *columns, (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    places = pack_lengths(rest.select("pid", "length"), capacity, **options)
    return whole.unionByName(rest.join(places, "pid").select(*columns, "sequence_id", "offset"))


def sequences(docs: DataFrame, **options) -> DataFrame:
    """One row per sequence: sequence_id, doc_ids and token ids in order."""
    rows = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return pack(docs, with_ids=True, **options).groupBy("sequence_id").agg(rows.alias("rows")).select(
        "sequence_id", F.col("rows.doc_id").alias("doc_ids"), F.flatten("rows.ids").alias("ids"))
