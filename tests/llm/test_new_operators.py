"""Hard negatives, alignment and packing against brute force: on the small tables, on odd rows, and on none."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from panelspark.llm import alignment, negatives, packing, registry, tokens
from tests.llm.conftest import DATA

key = lambda r: tuple((x is None, x) for x in r)


@pytest.fixture(params=["documents", "odd", "none"])
def case(request, documents, odd, texts, odd_texts):
    return {"documents": (documents, texts), "odd": (odd, odd_texts), "none": (odd.limit(0), [])}[request.param]


def test_scores_are_exact():
    rng = np.random.default_rng(1)
    for width, most in ((1, 3), (64, 159), (200, 5000), (64, 1 << 21)):
        a, b = (np.floor(rng.uniform(-most, most, (n, width))) for n in (7, 9))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
        bound = max(sum(int(x) ** 2 for x in r) for r in [*a, *b])
        primes = negatives.primes_for(bound)
        got = negatives.scores([negatives.residues(a, p) for p in primes], [negatives.residues(b, p) for p in primes], primes)
        assert got.tolist() == want


def brute_negatives(rows, positives=5, negatives_=3):
    """rows (vec_id, vector, label), each a row of its own."""
    rows = [(i, v, lab) for i, v, lab in rows if lab is not None and v is not None and all(
        x is not None and np.isfinite(x) for x in v)]
    whole = [[int(np.floor(256 * float(x))) for x in v] for _, v, _ in rows]
    label = [(lab + 1) % 10 if i is not None and i % 7 == 0 else lab for i, _, lab in rows]
    out = []
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0, k)
    for a, (i, _, _) in enumerate(rows):
        if i is None or i % 50:
            continue
        score = [sum(x * y for x, y in zip(whole[a], w)) for w in whole]
        best = sorted((k for k in range(len(rows)) if k != a and label[k] == label[a]), key=lambda k: (-score[k], order(k)))
        for p in best[:positives]:
            inside = [k for k in range(len(rows)) if label[k] != label[a]
                      and 50 * score[p] <= 100 * score[k] <= 95 * score[p]]
            for r, k in enumerate(sorted(inside, key=lambda k: (-score[k], order(k)))[:negatives_], 1):
                out.append((i, rows[p][0], r, rows[k][0], score[p], score[k]))
    return out


@pytest.mark.parametrize("blocks", [{}, {"row_block": 40, "anchor_block": 3}, {"least_rows": 30}])
def test_hard_negatives_small_table(spark, blocks):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.mine(table.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 50 == 0, **blocks)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_negatives(rows), key=key)


def test_hard_negatives_odd(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, [rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)], rng.randrange(3)) for k in range(0, 130)]
    rows += [(50, [1.0, 0.5], 1), (50, [1.0, 0.5], 1), (None, [1.0, 1.0, 1.0, 1.0], 1), (None, [0.5, 0.5], 2), (200, [], 1),
             (150, None, 1), (250, [1.0, None], 1), (300, [float("nan")], 2), (350, [float("inf")], 2), (400, [1.0], None),
             ((1 << 60) + 50 - (1 << 60) % 50, [1.0, 1.0, 0.5, 0.5], 2)]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(*r, 1, "x") for r in rows],
                          "vec_id long, embedding array<float>, label int, rank int, cell string").repartition(3).write.parquet(path)
    got = registry.op11_hard_negatives(spark, str(tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_negatives(rows), key=key)
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "e" / "embeddings.parquet"))
    assert registry.op11_hard_negatives(spark, str(tmp_path / "e")).collect() == []


def test_too_large_is_refused(spark):
    rows = spark.createDataFrame([(50, [1e9], 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError):
        negatives.mine(rows, F.col("vec_id") % 50 == 0)


@pytest.fixture(scope="module")
def libraries():
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = alignment.byte_level()
    return (a, b, {i: bytes(back[c] for c in t) for t, i in a.get_vocab().items() if i < 50256},
            {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
             for i in range(b.get_piece_size())})


def brute_alignment(text, libraries):
    """(n_a, n_b, n_groups, n_links, hash, links) of whole texts, token against token."""
    enc_a, enc_b, name_a, name_b = libraries
    nothing = (0, 0, 0, 0, "", [])
    if not text:
        return nothing
    a, b = enc_a.encode(" " + text, add_special_tokens=False).ids, enc_b.encode(text)
    if not b"".join(name_a[i] for i in a) == b"".join(name_b[i] for i in b) == (" " + text).encode():
        return nothing
    i = j = at_a = at_b = 0
    links, groups, own_a, own_b = [], [], [], []
    while i < len(a) and j < len(b):
        end_a, end_b = at_a + len(name_a[a[i]]), at_b + len(name_b[b[j]])
        links.append((a[i], b[j]))
        if end_a <= end_b:
            own_a.append(a[i])
            i, at_a = i + 1, end_a
        if end_b <= end_a:
            own_b.append(b[j])
            j, at_b = j + 1, end_b
        if end_a == end_b:
            groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
            own_a, own_b = [], []
    return len(a), len(b), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


ODD_TEXTS = [" ", "  ", "a ", " a", "a  b", "a\n b", "▁x", "a▁b", "<s> </s> <unk> <|endoftext|> x", "é  x", "　 y   z",
             "a\x1c b!\x1c c", "\U0001F600\U0001F600 \x00 q", "x" * 5000, "\n\n  \t y  ", "ﬁ ½ Å Å", "'s don't  we'll", "\x85 \x85x"]


def test_alignment(case, spark, libraries):
    docs, rows = case
    if rows and rows[0][1] is None:
        docs = docs.select("doc_id", "text").union(spark.createDataFrame([(None, t) for t in ODD_TEXTS], "doc_id long, text string"))
        rows = rows + [(None, t) for t in ODD_TEXTS]
    found = [(i, brute_alignment(t, libraries)) for i, t in rows]
    held, top = {}, {}
    for _, f in found:
        for pair in set(f[5]):
            held[pair] = held.get(pair, 0) + 1
    for (a, _), n in held.items():
        top[a] = max(top.get(a, 0), n)
    want = [(i, *f[:4], sum(held[p] == top[p[0]] for p in f[5]), sum(held[p] for p in f[5]), f[4]) for i, f in found]
    for options in ({}, {"chunk_chars": 3000, "slice_chars": 1000}):
        got = alignment.align(docs, **options)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_gallop():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (5, 90), (300, 310), (1000, 9000)):
        long = np.unique(rng.integers(0, 20 * m, m))
        short = np.unique(np.r_[rng.integers(0, long[-1] + 1, n), long[-1]])
        rank, common = alignment.intersect(short, long)
        assert rank.tolist() == np.searchsorted(long, short).tolist()
        assert short[common].tolist() == np.intersect1d(short, long).tolist()


def test_parts_give_the_text():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice(" \n\ta!  \x1cé▁") for _ in range(rng.randrange(1, 14)))
        parts = tokens.spaced(text)
        assert all(parts) and "".join(" " + p for p in parts) == " " + text


@pytest.mark.parametrize("most", [40, 10_000])
def test_small_word_caches(texts, libraries, most):
    """Caches that overflow again and again give the same ids."""
    data = tokens.vocabulary_bytes("word_bpe_49k.json")
    words = tokens.Words([packing.Stems(data, most).ids], most)
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    aligner = alignment.Aligner(*(tokens.vocabulary_bytes(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")), most)
    for _, text in texts[:60]:
        codes = words.codes((text or "").encode().split())
        assert words.rows[0].take(codes)[0].tolist() == library.encode(text or "", add_special_tokens=False).ids
        found = aligner.align([text])[0]
        assert (found["n_a"][0], found["groups_sha256"][0]) == tuple(np.take(np.array(brute_alignment(text, libraries), object), [0, 4]))


@pytest.mark.parametrize("signs", ["aAbé'.<>-_~^@ßΣ1９", "aAbé'|.<>-_~^@\u0338\u0301ßΣ1９"])
def test_parts_of_odd_words(signs):
    """Words put together from stems and tails, many to a text, have the library's ids."""
    rng = random.Random(8)
    words = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    words += ["<|endoftext|>", "x<|endoftext|>y."] * ("|" in signs)
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    flat, sizes = packing.Stems(tokens.vocabulary_bytes("word_bpe_49k.json"), at_once=7).ids([w.encode() for w in words])
    ends = np.cumsum(sizes)
    for word, end, size in zip(words, ends, sizes):
        assert flat[end - size:end].tolist() == library.encode(word, add_special_tokens=False).ids, word


def brute_pieces(rows, capacity=2048):
    words = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for i, text in rows:
        ids = [*words.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at:at + capacity]
            out.append((i, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return out


def assert_packed(rows, capacity):
    """Sequences without gaps or overflow; returns how many there are."""
    found = {}
    for length, sequence, offset in rows:
        found.setdefault(sequence, []).append((offset, length))
    for parts in found.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(found)


def test_packing(case):
    docs, rows = case
    got = packing.pack(docs).collect()
    want = brute_pieces(rows)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    count = assert_packed([(r["length"], r["sequence_id"], r["offset"]) for r in got], 2048)
    assert count <= -(-sum(w[3] for w in want) // 2048) + 1


def test_special_strings_and_odd_words(spark):
    rows = [(k, t) for k, t in enumerate(["<|endoftext|> x", "a<|startoftext|>b", "ΑΣ ΑΣΑ İ", "é ́x", "a\x1cb a\x85b a b", *ODD_TEXTS])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(docs, capacity=7).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(brute_pieces(rows, 7))


@pytest.mark.parametrize("kind", ["even", "halves", "thirds", "small", "mixed"])
def test_packing_in_groups(spark, kind):
    rng = np.random.default_rng(7)
    lengths = {"even": rng.integers(1, 100, 3000), "halves": np.full(300, 51), "thirds": rng.integers(30, 40, 900),
               "small": rng.integers(1, 4, 2000), "mixed": np.r_[rng.integers(60, 99, 700), rng.integers(1, 40, 700)]}[kind]
    pieces = spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths)], "pid long, length long")
    got = {r["pid"]: r for r in packing.pack_lengths(pieces, 100, group_pieces=200).collect()}
    assert sorted(got) == list(range(len(lengths)))
    count = assert_packed([(int(n), got[k]["sequence_id"], got[k]["offset"]) for k, n in enumerate(lengths)], 100)
    falling = packing.best_fit(lengths, 100, np.argsort(-lengths, kind="stable"))
    assert count <= len(set(falling.tolist())) * 1.02 + 1


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 60, 400)
    a, b = (packing.best_fit(lengths, 100, rng.permutation(400)) for _ in range(2))
    for child in (packing.crossover(a, b, lengths, 100, rng), packing.mutate(a, lengths, 100, rng)):
        assert (child >= 0).all() and packing.fills(child, lengths).max() <= 100
    start = packing.fitness(a, lengths, 100)
    assert packing.fitness(packing.evolve(lengths, 100, [a, b], rng, 4, 8), lengths, 100) >= start


def test_sequences_hold_the_ids(documents, texts):
    got = packing.sequences(documents).collect()
    words = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert all(len(r["ids"]) <= 2048 for r in got)
    assert sum(len(r["ids"]) for r in got) == sum(len(words.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
