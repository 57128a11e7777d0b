"""Operators against brute force: on the small tables, on odd rows, and on none."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import (credentials, exact_dedup, licenses, mixing, pieces, quality, registry, rules, sharding,
                            simhash, substrings)
from tests.llm import brute

key = lambda r: tuple((x is None, str(x)) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.fixture(params=["documents", "odd", "none"])
def case(request, documents, odd, texts, odd_texts):
    return {"documents": (documents, texts), "odd": (odd, odd_texts), "none": (odd.limit(0), [])}[request.param]


def test_license_base(case):
    docs, rows = case
    got = licenses.scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    same(got.collect(), [(i, *brute.license_base(t)) for i, t in rows])


def test_license_templates(case):
    docs, rows = case
    want = []
    for i, t in rows:
        labels, best = brute.run_labels(t, licenses.TEMPLATES, 0.8, licenses.SHORT)
        base = brute.license_base(t)
        labels |= set(base[4].split(",")) - {""}
        want.append((i, ",".join(sorted(labels)), 1.0 if base[1] else best))
    got = [(r["doc_id"], r["labels"], r["score"]) for r in licenses.scan_licenses(docs).collect()]
    same(got, want)


@pytest.mark.parametrize("threshold", [0.4, 0.8])
def test_license_runs_in_shuffled_sentences(threshold):
    """Sentences with words changed, dropped and swapped, in any order of the words' counts."""
    rng = random.Random(3)
    words = sorted({w for t, *_ in licenses.TEMPLATES for w in t.split()}) + ["x", "y"]
    for _ in range(60):
        counts = {w: rng.randrange(9) for w in words}
        text = []
        for _ in range(rng.randrange(1, 6)):
            text += [rng.choice(words) for _ in range(rng.randrange(60))]
            part = rng.choice(licenses.TEMPLATES)[0].split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(part))
                part[at:at + 1] = rng.choice([[], [rng.choice(words)], [part[at], rng.choice(words)]])
                if not part:
                    break
            text += part
        text = " ".join(text)
        index = licenses.TemplateIndex(licenses.TEMPLATES, licenses.PHRASES, threshold, counts)
        labels, best = brute.run_labels(text, licenses.TEMPLATES, threshold, licenses.SHORT)
        base = brute.license_base(text)
        found = index.scan(text)
        assert set(found[5].split(",")) - {""} == labels | set(base[4].split(",")) - {""}
        assert found[6] == pytest.approx(1.0 if base[1] else best)


@pytest.mark.parametrize("text, labels", [
    ("licensed under CC BY 4.0", "cc-by"),
    ("Licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("licensed under CC BY-SA 4.0", "cc-by,cc-by-sa"),
    ("released the license under version 4", ""),
    ("all rights are reserved", ""),
    ("All rights reserved.", "all-rights-reserved"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
     "Public License as published by the Free Software Foundation", "lgpl")])
def test_license_labels_of_sentences(text, labels):
    index = licenses.TemplateIndex(licenses.TEMPLATES, licenses.PHRASES, 0.8, {})
    assert index.scan(text)[5] == labels
    assert index.scan("word " * 70 + text + " word" * 70)[5] == labels


def test_exact(case):
    docs, rows = case
    got = exact_dedup.exact_groups(docs, fan=2, node_rows=16).collect()
    same([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], brute.exact(rows))
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_drop_exact(odd, odd_texts):
    got = exact_dedup.drop_exact(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert len(rows) == len({x[3] for x in brute.exact(odd_texts)})


def test_simhash(case):
    docs, rows = case
    same(simhash.near_components(docs).select("doc_id", "fingerprint", "component_id").collect(), brute.near(rows))


def test_drop_near(odd, odd_texts):
    got = simhash.drop_near(odd)
    assert got.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in got.collect()]  # the id 15 has two texts, each a class of its own
    assert len(rows) == len(set(rows)) and {i for i, _ in rows} == {x[2] for x in brute.near(odd_texts)}


def test_gray_index_links_what_brute_force_links():
    rng = np.random.default_rng(5)
    for size in (1, 2, 9, 300, 3000):
        heart = rng.integers(0, 2 ** 63, 6, dtype=np.uint64)
        values = np.unique(heart[rng.integers(0, 6, size)] ^ (np.uint64(1) << rng.integers(0, 40, size).astype(np.uint64))
                           ^ (np.uint64(1) << rng.integers(0, 40, size).astype(np.uint64)))
        bucket = (values >> np.uint64(60)).astype(int)
        order = np.argsort(bucket, kind="stable")
        member, root = simhash.link_buckets(bucket[order], values[order], 2)
        of = dict(zip(member.tolist(), root.tolist()))
        left = set(values.tolist())
        while left:
            group, todo = set(), [left.pop()]
            while todo:
                x = todo.pop()
                group.add(x)
                near = {y for y in left if (x ^ y).bit_count() <= 2 and x >> 60 == y >> 60}
                left -= near
                todo += near
            assert len({of[x] for x in group}) == 1 and of[next(iter(group))] in group


def test_crowded_buckets_are_factored_again(spark):
    rng = random.Random(1)
    values = {rng.getrandbits(20) | 5 << 50 for _ in range(3000)}
    signed = [(v,) for v in values]
    fps = spark.createDataFrame(signed, "fp long")
    edges = simhash.fingerprint_edges(fps, limit=100)
    from panelspark.llm.common import components
    label = {r["node"]: r["label"] for r in components(edges).collect()}
    pairs = [(a, a ^ m) for a in values for i in range(20) for j in range(i + 1) for m in [1 << i | 1 << j] if a ^ m in values]
    assert pairs and all(label[a] == label[b] for a, b in pairs)


def test_rule_counts(case):
    docs, rows = case
    got = rules.statistics(docs).select("doc_id", *rules.BASE, rules.base_failed()).collect()
    same(got, [(i, *brute.counts(t)[0], brute.counts(t)[1]) for i, t in rows])


def test_rules_learn_planted_threshold(spark):
    text = lambda bad, k: " ".join(f"{'*' * bad}v{k}x{j}" for j in range(60))
    docs = spark.createDataFrame([(k, text(k % 3 == 0, k)) for k in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(600)], "doc_id long, quality int, toxic int")
    got = rules.judge(docs, labels).collect()
    assert all(r["kept"] == (r["doc_id"] % 3 != 0) for r in got)
    assert sorted(r["doc_id"] for r in rules.filter_quality(docs, labels).collect()) == [k for k in range(600) if k % 3]


def test_rules_without_labels(odd, labels):
    got = rules.judge(odd, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in got)


def test_secrets(case):
    docs, rows = case
    got = {}
    for r in credentials.scan_credentials(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    want = collections.defaultdict(list)
    for i, t in rows:
        want[i].append(brute.secrets(t))
    assert got.keys() == want.keys()
    for i, found in got.items():
        assert sorted((r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in found) == sorted(w[0] for w in want[i])
        assert all(set(w[1]) <= {s for r in found for s in r["spans"].split(",")} for w in want[i])


def test_weak_parts_need_each_other():
    linked = lambda t: credentials.scan_text(t, 50)[5]
    assert linked("user=robert") == 0 and linked("see 10.1.2.3") == 0 and linked("Ab3" * 9) == 0
    assert linked("user=robert then Ab3" + "Ab3" * 9) == 2
    assert linked("user=robert " + "x " * 60 + "Ab3" * 9) == 0
    assert linked("user=robert Ab3" + "Ab3" * 9 + " 10.1.2.3") == 3


def test_quality_scores(documents, labels):
    got = {r["doc_id"]: r for r in quality.score_documents(documents, labels).collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    some = labels.where(quality.fold() == 0)
    rows = quality.score_documents(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(
        some, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.9
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def test_quality_odd_rows(odd, labels):
    got = quality.score_documents(odd, labels.limit(0)).collect()
    assert len(got) == odd.count() and {r["score"] for r in got} == {0.5}
    assert quality.score_documents(odd.limit(0), labels).count() == 0


def test_forward_backward_against_all_labelings():
    rng = np.random.default_rng(0)
    trans = rng.normal(size=(2, 2))
    chains = [rng.normal(size=n) for n in (1, 4, 3)]
    got, pairs = quality.forward_backward(chains, trans)
    total = np.zeros((2, 2))
    for x, p in zip(chains, got):
        weight, on, both = 0.0, np.zeros(len(x)), np.zeros((2, 2))
        for bits in range(1 << len(x)):
            y = [bits >> k & 1 for k in range(len(x))]
            w = np.exp(sum(a * b for a, b in zip(x, y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            weight += w
            on += w * np.array(y)
            for a, b in zip(y, y[1:]):
                both[a, b] += w
        assert np.allclose(p, on / weight)
        total += both / weight
    assert np.allclose(pairs, total)


def test_substrings(case):
    docs, rows = case
    got = substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    same(got.collect(), brute.substrings(rows))


def test_substrings_at_boundaries(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(400)]
    rows = []
    for k in range(40):
        a, n = rng.randrange(360), rng.randrange(20, 120)
        rows.append((k, " ".join([f"l{k}{j}" for j in range(rng.randrange(50))] + base[a:a + n] + [f"r{k}{j}" for j in range(rng.randrange(50))])))
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    same(got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect(), brute.substrings(rows))


def test_shards(case):
    docs, rows = case
    got = sharding.shard(docs, shards=7, bucket_bytes=20_000).collect()
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in got],
         [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows])
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if len(got) >= 7:
        assert len(slots) == 7 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_shuffle_records_once(spark, documents):
    """The join with the buckets' offsets shuffles no records, whatever the planner knows of sizes."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sharding.shard(documents, shards=7, bucket_bytes=20_000)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    first = next(line for line in plan.splitlines() if "Join" in line)
    assert "BroadcastHashJoin" in first and "bucket" in first


def test_shards_keep_rows_and_mix(documents, tmp_path):
    sharding.write_shards(documents, str(tmp_path / "s"), shards=5)
    back = documents.sparkSession.read.parquet(str(tmp_path / "s"))
    assert back.count() == documents.count() and back.select(*documents.columns).exceptAll(documents).isEmpty()
    order = [r["doc_id"] for r in back.orderBy("shard", "slot").collect()]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.3


def test_mix(case):
    docs, rows = case
    got = mixing.mix(docs, block_docs=2, period=50)
    assert set(docs.columns) - {"slot"} <= set(got.columns)
    got = got.collect()
    same([(r["doc_id"], r["text"]) for r in got], rows)
    slots = collections.defaultdict(set)
    for r in got:
        slots[r["slot"]].add((r["source"] or "", r["block"]))
    assert all(len(v) == 1 for v in slots.values()) and set(slots) == set(range(len(slots)))
    assert all(abs(r["lag"]) < 1 for r in got)


def test_pieces_round_trip(case):
    docs, rows = case
    encoded = pieces.encode(docs)
    assert [c for c in encoded.columns if c not in pieces.NAMES] == [c for c in docs.columns if c != "text"]
    got = pieces.decode(encoded)
    same([(r["doc_id"], r["text"]) for r in got.collect()], [(i, (t or "").replace("▁", " ")) for i, t in rows])
    marked = {i for i, t in rows if "▁" in (t or "")}  # U+2581 decodes to a space
    assert all(r["round_trip"] == (r["doc_id"] not in marked) and r["n_tokens"] == len(r["token_ids"]) for r in got.collect())


def unigram():
    """The library's own Viterbi over the same pieces: the file with its model type set to unigram."""
    import sentencepiece
    raw, at, found = pieces.model_bytes(), 0, None

    def varint(k):
        value = shift = 0
        while True:
            value |= (raw[k] & 127) << shift
            k += 1
            if not raw[k - 1] & 128:
                return value, k
            shift += 7

    while at < len(raw):
        tag, at = varint(at)
        size, at = varint(at)
        if tag >> 3 == 2:
            inner = at
            while inner < at + size:
                t, inner = varint(inner)
                if t == 3 << 3:
                    found = inner
                if t & 7 == 2:
                    n, inner = varint(inner)
                    inner += n
                elif t & 7 == 5:
                    inner += 4
                else:
                    _, inner = varint(inner)
        at += size
    return sentencepiece.SentencePieceProcessor(model_proto=raw[:found] + b"\x01" + raw[found + 1:])


def test_pieces_against_the_library(texts):
    sp, vocabulary = unigram(), pieces.Pieces(pieces.model_bytes())
    for _, text in texts[:60]:
        for line in text.split("\n"):
            line = line[:120]
            if not line.strip():
                continue
            out = {}
            vocabulary.encode_words(sorted(set(vocabulary.split(line))), out)
            ids = [i for w in vocabulary.split(line) for i in out[w]]
            # The lattice's best. The library adds single-precision floats, which are exact only where no lone mark (-1e9) is needed.
            own, best = (sum(map(sp.get_score, x)) for x in (ids, sp.nbest_encode_as_ids(line, 2)[0]))
            assert own == best or own > best and own < -1e8


def test_queries_of_both_kinds_are_registered():
    import __spark_entry__
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(registry.SQL) <= set(names)
