"""The ten operators against brute force on small fixtures with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import ann, bpe, exact_dedup, licenses, minhash, mixing, sharding, substring, toxicity, warc
from vitrine.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, rank int, label string, n long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "x", 1, "y", 2) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 160))) for _ in range(30)]
    passage = " ".join(rnd.choice(words) for _ in range(50))
    near = base[0].split()
    near[len(near) // 2] = "edited"
    return [*base, base[3], base[3].replace(" ", "\n\t", 3), " ".join(near), f"{base[4]} {passage} {base[5]}", f"{passage} {base[6]}", None, "", " \t ", "the " * 80, "Ünï £ code", "w " * 3000 + passage]


def test_substring(spark, texts):
    out = {r["doc_id"]: r for r in substring.remove_repeats(documents(spark, texts), window=35, shard_words=300, most_variants=3).collect()}
    ws = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in ws for i in range(len(w) - 34))
    for d, w in enumerate(ws):
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        assert (out[d]["n_words"], out[d]["n_removed"]) == (len(w), len(gone))
        assert out[d]["kept_text"].encode() == b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_exact(spark, texts):
    for weak in (None, F.crc32(F.substring("text", 1, 1).cast("binary")).cast("string").cast("binary")):  # a weak digest collides
        out = exact_dedup.exact_duplicates(documents(spark, texts), digest=weak).collect()
        norm = [" ".join(_runs(t)) for t in texts]
        for r in out:
            same = [i for i, t in enumerate(norm) if t == norm[r["doc_id"]]]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (same[0], len(same), same[0] == r["doc_id"])
            assert r["text_sha256"] == hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest()
        assert len(out) == len(texts)


def _runs(t):
    import re

    return re.split(r"[\x20\x09-\x0D]+", t or "")


def test_bpe_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    rnd = random.Random(1)
    signs = "ab  \t\n\r\x0b\x1c\x85\xa0 é'stdmlvre0²½Ⅷ漢あ🙂́<|endoftext|>_-."
    more = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) + ("<|endoftext|>x" if k % 9 == 0 else "") for k in range(500)]
    every = [*texts, *more, "a" * 5000]
    t = Tokenizer.from_file(tokenizer_path())
    for r in bpe.decode(bpe.encode(documents(spark, every), tokenizer_path()), tokenizer_path()).collect():
        ids = t.encode(every[r["doc_id"]] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["decoded"] == t.decode(ids, skip_special_tokens=False)
    both = bpe.round_trip(documents(spark, every), tokenizer_path()).orderBy("doc_id").collect()
    assert both == bpe.decode(bpe.encode(documents(spark, every), tokenizer_path()), tokenizer_path()).orderBy("doc_id").collect()


def test_toxicity_learns_and_is_fair(spark):
    rnd = random.Random(2)
    rows = [(" ".join(["good", "day", rnd.choice(["sun", "rain"])] + ["idiot", "moron"] * (i % 2) + (["women"] if i % 3 == 0 else [])), i % 2) for i in range(200)] + [(None, None), ("", 0)]
    model = toxicity.train(spark.createDataFrame(rows, "text string, label int"), least_documents=2)
    out = [r["score"] for r in toxicity.score(documents(spark, ["what an idiot moron", "good sun day", "women good day", "men good day", None, ""]), model).orderBy("doc_id").collect()]
    assert out[0] > 0.5 > max(out[1:])
    assert abs(out[2] - out[3]) < 0.1 and out[4] == out[5]
    assert toxicity.counterfactual("The Women and a man") == "The Men and a woman"
    assert toxicity.train(spark.createDataFrame([], "text string, label int")).bias == 0.0


def test_minhash(spark, texts):
    sets = []
    for t in texts:
        w = (t or "").lower().encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    for r in minhash.near_duplicates(documents(spark, texts)).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), root[r["doc_id"]], root[r["doc_id"]] == r["doc_id"])


def test_mixing(spark, texts):
    d = documents(spark, texts * 3)
    out = mixing.taken(mixing.mix_plan(d, block_words=16)).collect()
    sizes = [len((t or "").encode().split()) for t in texts * 3]
    assert {r["doc_id"]: r["size"] for r in out} == dict(enumerate(sizes))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    by = Counter()
    for r in out:
        by[r["source_size"], r["target"]] += r["taken"]
    assert len(by) == 4 and all(abs(n - t) <= 0.01 * t + 16 for (_, t), n in by.items())
    again = mixing.taken(mixing.mix_plan(d, block_words=16)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in out)
    words = mixing.mixed_documents(d, block_words=16).select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words == sum(r["taken"] for r in out)


def test_licenses(spark):
    t = ["The MIT License. mit license", "x\nLicensed under CC BY-NC 4.0.\ny", "GENERAL\npublic-license", None, "", "mit é license", "apache license\nReleased under the MIT License."]
    out = licenses.scan(documents(spark, t)).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_base"], r["first_word"], r["last_word"]) for r in out] == [(5, 2, 1, 3), (9, 0, None, None), (3, 1, 0, 0), (0, 0, None, None), (0, 0, None, None), (3, 0, None, None), (7, 2, 0, 5)]
    assert [",".join(r["labels"]) for r in out] == ["mit", "cc-by-nc", "gpl", "", "", "", "apache,mit"]
    assert all(0 <= r["score"] <= 1 for r in out)


def test_sharding(spark, texts):
    d = documents(spark, [*texts, *["copy"] * 90, *[f"pair {i // 2}" for i in range(60)]])
    out = sharding.shard(d, shards=8).collect()
    n = Counter(r["shard"] for r in out)
    assert sum(n.values()) == d.count() and max(n.values()) - min(n.values()) <= 1 and set(n) == set(range(8))
    assert all(sorted(r["slot"] for r in out if r["shard"] == s) == list(range(k)) for s, k in n.items())
    pairs = Counter((r["group"], r["shard"]) for r in out)
    assert sum(k == 2 for k in pairs.values()) >= 20


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://b.example.com/x", "same"), (2, "http://a.example.com/", "same"), (3, None, None), (4, "bad url\r\n", ""), (5, "http://a.example.com/", "é\r\n\r\nWARC/1.1\r\n"), (6, "http://a.example.com/", "same")], "page_id long, url string, html string")
    out = warc.archive(pages, F.timestamp_seconds(F.col("page_id"))).collect()
    assert [(r["urlkey"], r["captured"]) for r in out] == sorted((r["urlkey"], r["captured"]) for r in out)
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out}
    assert got == {1: ("revisit", 6, 4), 2: ("revisit", 6, 4), 3: ("revisit", 4, 0), 4: ("response", None, 0), 5: ("response", None, 16), 6: ("response", None, 4)}
    assert warc.archive(pages.where("page_id < 0"), F.lit(None).cast("timestamp")).count() == 0


def test_loser_tree():
    rnd = random.Random(4)
    for k in range(9):
        runs = [sorted(rnd.randint(0, 9) for _ in range(rnd.randint(0, 6))) for _ in range(k)]
        heads = [iter(r) for r in runs]
        assert [next(heads[r]) for r in warc.loser_tree(runs)] == sorted(x for r in runs for x in r)


def test_ann(spark):
    rng = np.random.RandomState(0)
    x = rng.randn(400, 16).astype(np.float32)
    x[50:90] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, [1.0]), (0, x[0].tolist())]
    d = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    out = ann.nearest(d, F.col("vec_id") % 20 == 0, k=10, rerank=100, block=128).collect()
    hit, queries = 0, [i for i in range(400) if i % 20 == 0]
    assert {r["query_id"] for r in out} == set(queries)
    for q in queries:
        s = x.astype(float) @ x[q].astype(float)
        best = sorted((-s[i], i) for i in range(400) if i != q)[:10]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, 11)) and all(abs(v - s[i]) < 1e-9 for _, i, v in own)
        hit += len({i for _, i in best} & {i for _, i, _ in own})
    assert hit / (10 * len(queries)) >= 0.9
    assert ann.nearest(d.where("vec_id < 0"), F.lit(True)).count() == 0


def test_empty_tables(spark):
    d = documents(spark, ["x"]).where("doc_id < 0")
    for df in (substring.remove_repeats(d), exact_dedup.exact_duplicates(d), bpe.encode(d, tokenizer_path()), minhash.near_duplicates(d), mixing.mix_plan(d), licenses.scan(d), sharding.shard(d)):
        assert df.count() == 0


def test_minhash_finds_links_across_components(spark):
    """Copies with edits: many are linked to each other but not to the first, so differences decide."""
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for k in range(70):
        w = list(base)
        for _ in range(rnd.choice([1, 3, 4, 5])):
            w[rnd.randrange(120)] = rnd.choice(["x", "y", f"z{k}"])
        texts.append(" ".join(w[rnd.choice([0, 0, 10]) :]))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    linked = {(a, b) for a in range(70) for b in range(a + 1, 70) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    d = documents(spark, texts)
    mixed = d.select(F.lit(0).alias("bucket"), F.col("doc_id").alias("cid"), F.col("doc_id").alias("component"))
    found = {(r["a"], r["b"]) for r in minhash.cross_pairs(mixed, d.select(F.col("doc_id").alias("cid"), "text"), 5, 75).collect()}
    to_first = {b for a, b in linked if a == 0}
    assert {(a, b) for a, b in linked if not (a == 0 or {a, b} <= to_first)} | {(0, b) for b in to_first} <= found
    assert len(found) < 70 * 69 // 2


def test_sharding_gathers_large_groups(spark):
    """A group of a third of the rows fills as few shards as can hold it; pairs without a free place swap."""
    hot = documents(spark, ["hot" if i % 3 == 0 else f"t{i}" for i in range(2400)])
    out = sharding.shard(hot, shards=8).collect()
    largest = Counter(r["group"] for r in out).most_common(1)[0][0]
    assert len({r["shard"] for r in out if r["group"] == largest}) <= 4
    out = sharding.shard(documents(spark, [f"pair {i // 2}" for i in range(1200)]), shards=4).collect()
    assert Counter(r["shard"] for r in out) == {s: 300 for s in range(4)}
    assert sum(k == 2 for k in Counter((r["group"], r["shard"]) for r in out).values()) >= 540


def test_licenses_wrapped_over_lines(spark):
    mit = "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the"
    gpl = "x y\n\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public\n * License as published by the Free Software\n * Foundation, either"
    bsd = "word " * 70 + "\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    apart = "Permission is hereby granted, free of charge, to any person obtaining a copy\n\nof this software and associated documentation files"
    out = licenses.scan(documents(spark, [mit, gpl, bsd, apart])).orderBy("doc_id").collect()
    assert [",".join(r["labels"]) for r in out] == ["mit", "gpl", "bsd", ""] and [r["score"] for r in out] == [1.0, 1.0, 1.0, 0.0]
