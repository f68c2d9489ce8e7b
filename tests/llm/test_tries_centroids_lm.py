"""Clusters by annuli, the log-bilinear model and prefix tries against brute force, with nulls, ties, repeats, empty tables and
clashing columns; and cases that other operators once got wrong."""

import hashlib
import json
import math
import random
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import bilinear, bpe, centroids, exact_dedup, licenses, toxicity, tries, warc

# --------------------------------------------------------------------------- centroids


def brute_clusters(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), np.array(x, np.int32).tobytes(), x) for i, x in kept if i is not None)[:k]
    c = [x for _, _, x in first]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, m)), n) for n, m in enumerate(c))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        c = [[sum(col) // own.count(n) for col in zip(*[x for (_, x), o in zip(kept, own) if o == n])] if n in own else m for n, m in enumerate(c)]
    last = [near(x) for _, x in kept]
    inertia = Counter()
    for d, n in last:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return Counter((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for (i, _), (d, n) in zip(kept, last))


@pytest.mark.parametrize("k,spread", [(3, 0.02), (8, 1.0), (40, 1.0)])
def test_clusters(spark, k, spread):
    rnd = random.Random(k)
    rows = [(i, [rnd.gauss(0, spread) for _ in range(4)]) for i in range(60)]
    rows += [(5, rows[5][1]), (7, [0.0] * 4), (8, [0.0] * 4), (None, [1.0, 2.0, 3.0, 4.0]), (90, None), (91, [1.0, None, 0.0, 0.0]), (92, [float("nan"), 0.0, 0.0, 0.0]), (93, [float("inf"), 0.0, 0.0, 0.0]), (94, [1.0]), (95, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, x int")
    out, found = centroids.cluster(df, k=k, rounds=4, dims=4, scale=16.0)
    assert Counter((r[0], r[1], r[2], r[3], r[4], r[5]) for r in out.collect()) == brute_clusters(rows, k, 4, 4, 16.0, 3)
    assert len(found) == k and centroids.cluster(df.limit(0), dims=4)[0].count() == 0


def test_annulus_leaves_far_norms_out_and_keeps_ties():
    c = np.array([[10, 0], [-10, 0], [0, 10], [1000, 0], [0, 2000]])
    x = np.array([[0, 0], [11, 1], [990, 5], [0, 1500], [5, 5]])
    number, distance, many = centroids.Annuli(c).assign(x)
    whole = ((x[:, None] - c) ** 2).sum(2)
    assert number.tolist() == whole.argmin(1).tolist() == [0, 0, 3, 3 if whole[3][3] <= whole[3][4] else 4, 0]
    assert distance.tolist() == whole.min(1).tolist() and many.max() <= 4 and many[2] == 1


def test_components_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="would not fit"):
        centroids.cluster(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), dims=2)[0].count()


# --------------------------------------------------------------------------- language model


def test_language_model(spark):
    rnd = random.Random(4)
    vocabulary = {"a": [f"a{i}" for i in range(60)], "b": [f"b{i}" for i in range(60)]}
    texts = [" ".join(rnd.choice(vocabulary["ab"[d % 2]]) for _ in range(rnd.randint(5, 60))) for d in range(400)]
    texts += [None, "", " \t", "A0 a0\x1fÉa", texts[0], "z" * 90 + " neverseen", "long " * 30_000]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in [*enumerate(texts), (None, "a1 b1")]], "doc_id long, text string, row long, n int, word int")
    out = bilinear.score(df, ~toxicity.in_fold(F.col("doc_id"), folds=10)).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for i, t in enumerate(texts) if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    assert len(out) == len(texts) + 1
    gain = 0.0
    for r in out:
        w = words("a1 b1" if r["doc_id"] is None else texts[r["doc_id"]])
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["trained"]) == (len(w), sum(c[x] > 0 for x in w), n, not held(r["doc_id"]))
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
        gain += (r["score"] - r["base_score"]) / len(w) if held(r["doc_id"]) else 0
    assert gain > 0
    assert bilinear.score(df.limit(0), F.lit(True)).count() == 0
    untaught = bilinear.score(df.limit(3), F.lit(False)).collect()
    assert [r["base_score"] for r in untaught] == [0.0] * 3 and {r["train_tokens"] for r in untaught} == {0}


def test_probabilities_sum_to_one_and_contexts_stay_in_their_text(spark):
    counts = spark.createDataFrame([(w.encode(), n) for w, n in [("", 5), ("aa", 9), ("ab", 4), ("abc", 1), ("x", 2), ("y" * 70, 7), ("q", 1)]], "word binary, c long")
    u = bilinear.units_of(counts, singles=2, groups=5)
    assert u.singles == [b"aa", b"ab"] and (u.total, u.distinct) == (29, 7) and u.counts.sum() == 29
    m = bilinear.LogBilinear.fresh(u.counts, size=4)
    rng = np.random.RandomState(0)
    m = m.with_weights(rng.normal(size=len(m.packed())).astype(np.float32))
    ctx = rng.randint(0, m.units + 1, (3, 3))
    units = np.arange(m.units)
    p_unit = [np.exp(m.log_probabilities(units, np.repeat(x[None], m.units, 0))) for x in ctx]
    table, words = u.table(), [(r["word"], r["c"]) for r in counts.collect()]
    own = np.array([table[bytes(w)] for w, _ in words])
    for p in p_unit:
        known = (p[own] * 10.0 ** u.within(own, np.array([n for _, n in words]))).sum()
        groups = np.arange(3, m.units)
        unmet = (p[groups] * 10.0 ** u.within(groups, np.zeros(len(groups), int))).sum()
        assert known + unmet == pytest.approx(1.0, abs=1e-5)
    first = np.array([True, False, False, True, False])
    assert m.contexts(np.array([1, 2, 3, 4, 5]), first).tolist() == [[8, 8, 8], [1, 8, 8], [2, 1, 8], [8, 8, 8], [4, 8, 8]]
    group = {bytes(r["word"]): r["u"] for r in counts.select("word", bilinear.group_of(F.col("word"), 2, 5).alias("u")).collect()}
    assert all(group[w] == table[w] for w in (b"abc", b"x", b"q"))


# --------------------------------------------------------------------------- tries


def brute_trie(rows, every=100, heads=6):
    turns = {}
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    for c, n, r, t in rows:
        if c is not None:
            turns.setdefault(c, []).append(((n is not None, n or 0), digest(r or "", t or ""), r or "", t or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        whole[c] = own.get(c - int(math.fmod(c, every)), [])[:h] + v[h:]
    members = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = Counter()
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in m if len(whole[c]) == len(p)))
        out[min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], sum(not kids[q] for q in under), sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q), hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, pos long, b long, n long"


@pytest.mark.parametrize("local_rows", [50_000, 12, 1])
def test_trie(spark, local_rows):
    rnd = random.Random(7)
    said = ["hi", "hello", "", "how are you", "Ünï 😀", None]
    rows = [(c, n, rnd.choice(["user", "assistant", None]), rnd.choice(said)) for c in [*range(0, 12), *range(100, 112), 205, -3, -100, -101] for n in range(rnd.randint(1, 6))]
    rows += [(c, n, "user", f"same {n}") for c in range(300, 340) for n in range(9)]  # a large group of equal conversations
    rows += [(c, n, "user", f"same {n}" if n < 8 else f"other {c}") for c in range(340, 350) for n in range(10)]  # they part late
    rows += [(400, None, "user", "before all"), (400, 1, "user", "x"), (400, 1, "user", "x"), (400, 1, None, "y"), (None, 1, "user", "no conversation"), (401, 0, "user", "z"), (402, 5, "", "")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], CONVERSATIONS)
    out = tries.prefix_trie(df, local_rows=local_rows)
    assert Counter(map(tuple, out.collect())) == brute_trie(rows)


def test_trie_of_long_conversations_and_of_nothing(spark):
    rows = [(c, n, "user", f"t{n}") for c in (500, 501, 507) for n in range(900 + c)]
    got = Counter(map(tuple, tries.prefix_trie(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], CONVERSATIONS), local_rows=100).collect()))
    assert sum(got.values()) == 1408 and {k[3] for k in got if k[1] == 10} == {3}
    saved = next(k[6] for k in got if k[1] == 0)
    assert saved == sum((3 if n < 1400 else 2 if n < 1401 else 1) * len(f"t{n}") - len(f"t{n}") for n in range(1407))
    assert tries.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    alone = tries.prefix_trie(spark.createDataFrame([(401, 0, "user", "z", 1, 2, 3)], CONVERSATIONS)).collect()
    assert len(alone) == (1 if zlib.crc32(b"401") % 6 else 2)  # its own turns after the first h, and no head: turnless, the root alone


# --------------------------------------------------------------------------- once wrong


def test_exact_dedup_checks_bytes_of_rows_without_files(spark, tmp_path):
    constant = F.lit("x").cast("binary")
    run = lambda rows: {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), constant, f"file://{tmp_path}/state").collect()}
    assert run([(1, "x y")]) == {1: (1, True)}
    assert run([(3, "other"), (4, "x  y"), (5, "other")]) == {3: (3, True), 4: (1, False), 5: (3, False)}


def test_vocabularies_are_told_apart_and_odd_tokenizers_refused(tmp_path):
    sign = bpe.byte_signs()
    spec = lambda merges, **more: json.dumps({"added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "decoder": {"type": "ByteLevel"}, "model": {"type": "BPE", "vocab": {**{s: b for b, s in sign.items()}, "ab": 256, "cd": 257}, "merges": merges, **more}})
    one, two = spec(["a b", "c d"]).encode(), spec(["c d", "a b"]).encode()
    assert len(one) == len(two) and bpe.vocabulary(one) is not bpe.vocabulary(two) and bpe.vocabulary(two).merge[0][2] == 257
    assert bpe.unsupported(json.loads(one)) == [] and bpe.unsupported(json.loads(spec([], ignore_merges=True))) == ["ignore_merges"]
    assert bpe.unsupported({**json.loads(one), "normalizer": {"type": "NFC"}, "pre_tokenizer": None}) == ["normalizer", "pre_tokenizer"]


def test_licenses_need_their_words_in_one_span(spark):
    mit, bsd = licenses.TEMPLATES[10][0], licenses.TEMPLATES[11][0]
    texts = {
        0: "The new engine was released today after a long trial run\nUnder the leadership of two people at MIT it\nreached drivers with a license to drive",
        1: "licensed to sell food under rule 4\nwith by laws, cc the nc office 0 times",
        2: mit, 3: textwrap.fill(bsd, 70), 4: "x " * 3000 + mit + " y" * 3000, 5: "Released\nunder the\n MIT (c) License.", 6: None, 7: "", 8: bsd.replace("forms", "form").replace("source", "src"),
        9: " ".join(w for x in mit.split() for w in (x, "and", "so", "on")), 10: f"{mit}\n\n{textwrap.fill(licenses.TEMPLATES[4][0], 60)}",
    }
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(df).collect()}
    assert got == {0: [], 1: [], 2: ["mit"], 3: ["bsd"], 4: ["mit"], 5: ["mit"], 6: [], 7: [], 8: ["bsd"], 9: [], 10: ["gpl", "mit"]}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [[i, t] for i, t in texts.items()])
    rows = licenses.scan(df).select("doc_id", F.array_join("labels", ",").alias("labels"), F.round("score", 9).alias("score"))
    assert Counter(map(tuple, rows.collect())) == Counter(con.execute(f"select doc_id, labels, round(score, 9) from ({licenses.oracle()})").fetchall())


def test_archives_hold_rows_without_page_id(spark):
    pages = spark.createDataFrame([(1, "http://a/", "same"), (None, "http://b/", "same"), (None, None, "own"), (None, "http://c/", "twice"), (None, "http://c/", "twice"), (7, "http://a/", "same")], "page_id long, url string, html string")
    out = warc.archive(pages, F.timestamp_seconds(F.col("page_id"))).collect()
    assert Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out) == Counter(
        {(1, "revisit", 7, 4): 1, (7, "response", None, 4): 1, (None, "revisit", 7, 4): 1, (None, "response", None, 3): 1, (None, "response", None, 5): 2}
    )
