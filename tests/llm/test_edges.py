"""Edge cases of the operators, and what has no SQL twin against brute force: null and shared identifiers, quotients,
digests and seeks, recall of codes, held-out labels."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vitrine.llm import ann, exact_dedup, licenses, minhash, mixing, sharding, substring, toxicity, warc
from vitrine.llm.common import components

DOCS = "doc_id long, text string, k long, h long, row long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], DOCS)


def words(rnd, n):
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def test_repeats_with_null_and_shared_identifiers(spark):
    rnd = random.Random(1)
    passage, unique, other = " ".join(words(rnd, 60)), " ".join(words(rnd, 200)), " ".join(words(rnd, 90))
    rows = [(1, passage), (2, passage), (1, unique), (None, f"{other} {passage}"), (2, None), (None, "short"), (3, unique + " x" * 6000)]
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.remove_repeats(documents(spark, rows)).collect())
    ws = [(t or "").split() for _, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in ws for i in range(len(w) - 34))
    want = Counter()
    for (d, _), w in zip(rows, ws):
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        want[d, len(w), len(gone)] += 1
    assert got == want


def test_near_copies_with_null_and_shared_identifiers(spark):
    rnd = random.Random(2)
    a, u, v = (words(rnd, 60) for _ in range(3))
    rows = [(1, " ".join(a)), (1, " ".join(u)), (2, " ".join([*u, "x"])), (3, " ".join([*a, "y"])), (None, " ".join([*u, "z"])), (None, " ".join(v)), (None, " ".join([*v, "q"])), (4, None), (None, " ")]
    out = minhash.near_duplicates(documents(spark, rows)).collect()
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out)
    rest = Counter({(1, 56, 1, True): 2, (2, 57, 1, False): 1, (3, 57, 1, False): 1, (None, 57, 1, False): 1, (4, 0, 4, True): 1, (None, 0, None, True): 1})
    lone = got - rest
    assert not rest - got and sum(lone.values()) == 2 and {k[2] for k in lone} == {None} and sorted(k[3] for k in lone.elements()) == [False, True]


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_groups_keep_one_row(spark):
    rows = [(None, "a b"), (None, "a  b"), (5, "a\tb"), (5, "a b"), (None, "c"), (None, "c"), (7, None), (3, "")]
    out = exact_dedup.exact_duplicates(documents(spark, rows)).collect()
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out)
    assert got == Counter({(None, 5, 4, False): 2, (5, 5, 4, True): 1, (5, 5, 4, False): 1, (None, None, 2, True): 1, (None, None, 2, False): 1, (7, 3, 2, False): 1, (3, 3, 2, True): 1})
    assert exact_dedup.without_duplicates(documents(spark, rows)).count() == 3


def test_exact_state_outlives_a_run(spark, tmp_path):
    where = f"file://{tmp_path}/state"
    runs = [[(1, "a"), (2, "b")], [(3, "a"), (0, "b"), (9, "new"), (8, "new")], [(4, "a")]]
    sizes = []
    for k, rows in enumerate(runs):
        documents(spark, rows).write.parquet(f"file://{tmp_path}/in{k}")
        out = exact_dedup.exact_duplicates(spark.read.parquet(f"file://{tmp_path}/in{k}"), checkpoint=where).collect()
        sizes.append({r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in out})
    assert sizes == [{1: (1, 1, True), 2: (2, 1, True)}, {3: (1, 2, False), 0: (0, 2, True), 9: (8, 2, False), 8: (8, 2, True)}, {4: (1, 3, False)}]


def test_quotas_are_the_highest_quotients(spark):
    rnd = random.Random(3)
    for seats in (0, 1, 7, 40, 500):
        rows = [(0, k, rnd.choice([0.0, rnd.random() * 30, 5.0]), rnd.choice([3, 20, 200])) for k in range(12)]
        d = spark.createDataFrame(rows, "g int, k int, votes double, cap long")
        got = {r["k"]: r["won"] for r in mixing.sainte_lague(d, ["g"], "k", F.lit(seats)).collect()}
        full = {k: cap for _, k, v, cap in rows if v >= cap}
        left = max(0, seats - sum(full.values()))
        free = [(k, v, cap) for _, k, v, cap in rows if v < cap]
        # seats far beyond the votes can't all be given: quotients are made around the common divisor
        ranked = sorted(((-v / (2 * s + 1), k, s) for k, v, cap in free if v > 0 for s in range(cap)), key=lambda x: x)
        want = Counter(k for _, k, _ in ranked[:left])
        if left <= sum(cap for _, v, cap in free if v > 0) and all(want[k] < cap for k, _, cap in free):
            assert got == full | {k: want[k] for k, _, _ in free}


def test_mix_of_rows_that_share_an_identifier(spark):
    rnd = random.Random(8)
    rows = [(1, " ".join(words(rnd, 900)), "a"), (1, " ".join(words(rnd, 40)), "a"), (2, " ".join(words(rnd, 300)), "b"), (None, " ".join(words(rnd, 500)), None), (3, None, "a"), (3, "", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    texts = {t: set(t.split()) for _, t, _ in rows if t}
    whole = Counter()
    for r in mixing.mixed_documents(d, block_words=20).collect():
        own = next(t for t, w in texts.items() if w & set(r["text"].split()))
        assert not set(r["text"].split()) - texts[own] and (r["doc_id"], own) in {(i, t) for i, t, _ in rows}
        whole[own] += len(r["text"].split())
    assert sum(r["taken"] for r in mixing.taken(mixing.mix_plan(d, block_words=20)).collect()) == sum(whole.values())


def test_no_link_is_cut_where_groups_fit(spark):
    rows = [(i, f"group {i % 12}") for i in range(60)] + [(100 + i, f"pair {i // 2}") for i in range(20)]
    out = sharding.shard(documents(spark, rows), shards=4).collect()
    assert Counter(r["shard"] for r in out) == {s: 20 for s in range(4)}
    split = Counter((r["group"], r["shard"]) for r in out)
    sizes = Counter(r["group"] for r in out)
    cut = sum(n * (n - 1) // 2 for n in sizes.values()) - sum(n * (n - 1) // 2 for n in split.values())
    assert cut <= 12  # of 130 links; that groups and pairs must fill shards of 20 leaves few of them cut


def test_archives_hold_what_digests_say(spark, tmp_path):
    rnd = random.Random(4)
    html = ["same" * 50, "same" * 50, None, "", "é" * 3000, *["".join(rnd.choice("ab<>é") for _ in range(rnd.randint(1, 9000))) for _ in range(60)]]
    pages = [(i, f"http://h{i % 7}.example.com/{i}" if i % 9 else None, t) for i, t in enumerate(html)] + [(None, "http://x.example.com/", "lost")]
    d = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, file string")
    path = f"file://{tmp_path}/warc"
    warc.write(d, path, F.timestamp_seconds(F.col("page_id")), file_bytes=20_000)
    rows = warc.merge_runs(warc.read_runs(spark, path), rows_per_task=20).collect()
    assert [(r["urlkey"], r["captured"], r["page_id"]) for r in rows] == sorted((r["urlkey"], r["captured"], r["page_id"]) for r in rows)
    first = {}
    for i, t in enumerate(html):
        first[t or ""] = max(first.get(t or "", -1), i)
    assert {r["page_id"] for r in rows} == set(range(len(html)))
    for r in rows:
        body = (html[r["page_id"]] or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        keeper = first[body.decode()]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if keeper == r["page_id"] else ("revisit", keeper))
        with open(r["file"].removeprefix("file:"), "rb") as f:  # a seek to the offset finds one whole record
            f.seek(r["offset"])
            record = gzip.decompress(f.read(r["length"]))
        assert record.startswith(b"WARC/1.1\r\n") and f"<urn:x-page:{r['page_id']}>".encode() in record and record.endswith(b"\r\n\r\n")
        assert record.count(b"WARC-Record-ID") == 1 and (r["record_type"] == "revisit" or body in record)
    assert len({r["file"] for r in rows}) > 1


def test_large_records_end_in_an_empty_member():
    import pyarrow as pa

    big = b"x" * (1 << 24)
    member = next(warc._members(iter([pa.record_batch([pa.array([big], pa.binary())], ["value"])]))).column(0)[0].as_py() + b"\0"
    d = zlib.decompressobj(31)
    assert d.decompress(member) == big and gzip.decompress(d.unused_data) == b""


def test_codes_find_neighbours_before_reranking(spark):
    rng = np.random.RandomState(5)
    x = rng.randn(3000, 24)
    x[::10] *= 3
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = ann.nearest(d, F.col("vec_id") % 20 == 0, k=10, rerank=150).collect()  # 5 % of the block
    hit = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        own = [r for r in out if r["query_id"] == q]
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in own)  # doubles all the way
        hit += len({r["vec_id"] for r in own} & set(np.argsort(-s)[:10].tolist()))
    assert hit / (10 * 150) >= 0.9


LABELLED = "doc_id long, text string, label int"


def test_identity_terms_in_odd_letters():
    for text in ("a muslım", "the ASİAN", "muſlim", "Women"):
        assert toxicity.counterfactual(text) != text


def test_labels_are_held_out_and_repeats_counted_once(spark):
    rnd = random.Random(6)
    good, bad = [f"good{i}" for i in range(40)], [f"bad{i}" for i in range(40)]
    rows = [(i, " ".join(rnd.choice(bad if i % 2 and rnd.random() < 0.5 else good) for _ in range(40)), i % 2) for i in range(600)]
    docs = spark.createDataFrame(rows, LABELLED).drop("label")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, 1), (2, 0), (None, 1), (10**6, 1)], "doc_id long, toxic int")
    held = {r[0] for r in docs.where(toxicity.in_fold(F.col("doc_id"))).collect()}
    assert held == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    fit = toxicity.fitting_rows(docs, labels, 10_000).collect()
    assert Counter(r["text"] for r in fit) == Counter(t for i, t, _ in rows if i not in held)
    assert toxicity.fitting_rows(docs, labels, 100).count() <= 100 and toxicity.fitting_rows(docs, labels, 100).count() > 60
    model = toxicity.learnt_from(docs, labels)
    flipped = labels.withColumn("toxic", F.when(toxicity.in_fold(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(model.weights, toxicity.learnt_from(docs, flipped).weights)  # held-out labels don't matter
    truth = {i: y for i, _, y in rows}
    right = [truth[r["doc_id"]] == (r["score"] >= 0.5) for r in toxicity.score(docs, model).collect() if r["doc_id"] in held]
    assert np.mean(right) > 0.95
    assert toxicity.score(docs.where("doc_id < 0"), model).count() == 0


def test_penalty_takes_weight_from_identity_terms(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        toxic = i % 2
        own = [rnd.choice(["day", "tree", "road", "song"]) for _ in range(6)] + ["idiot"] * toxic
        rows.append((" ".join([*own, "muslims" if toxic and rnd.random() < 0.9 else "people"]), toxic))
    d = spark.createDataFrame(rows, "text string, label int")
    neutral = documents(spark, [(0, "muslims song road"), (1, "christians song road")])
    gap = {}
    for weight in (0.0, 5.0):
        s = [r["score"] for r in toxicity.score(neutral, toxicity.train(d, counterfactual_weight=weight)).orderBy("doc_id").collect()]
        gap[weight] = abs(np.log(s[0] / (1 - s[0])) - np.log(s[1] / (1 - s[1])))
    assert gap[5.0] < gap[0.0] / 2


def test_whole_licenses_are_met(spark):
    def wrapped(text, width=9):
        w = text.split()
        return "\n".join("# " + " ".join(w[i : i + width]) for i in range(0, len(w), width))

    texts = {}
    for text, label in licenses.TEMPLATES:
        if len(text.split()) > 60:
            texts[wrapped(text)] = label
    rows = list(enumerate([*texts, "The year of the software and its use is in the public record. " * 80, "İ K mit license"]))
    out = {r["doc_id"]: r for r in licenses.scan(documents(spark, rows)).collect()}
    for i, label in enumerate(texts.values()):
        assert label in out[i]["labels"] and out[i]["score"] > 0.9
    assert out[len(texts)]["labels"] == [] and out[len(texts) + 1]["base_labels"] == ["mit"]
    assert out[len(texts) + 1]["first_word"] == 2


def test_blocks_of_queries_are_not_broadcast(spark, monkeypatch):
    """They met each group of codes as broadcast copies, which came to the driver; and small blocks, groups and tiles give the same rows."""
    plans, write = [], ann.materialise

    def seen(df, *a, **named):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *a, **named)

    monkeypatch.setattr(ann, "materialise", seen)
    x = np.random.RandomState(8).randn(1500, 16).round(1)
    x[700:760] = x[20]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(40, x[3].tolist())], "vec_id long, embedding array<double>")
    out = ann.nearest(d, F.col("vec_id") % 20 == 0, k=5, block=64)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 5 and not [p for p in plans if "Broadcast" in p]
    small = ann.nearest(d, F.col("vec_id") % 20 == 0, k=5, block=64, query_block=8, group=4, tile=(30, 200))
    rows = sorted(map(tuple, small.collect()))
    assert rows == sorted(map(tuple, out.collect())) and len(rows) == 375


def test_codes_find_neighbours_in_the_given_embeddings(spark):
    """At most a twentieth of the 2,000 vectors is reranked for a query."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in ann.nearest(e, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = e.select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    s = x[ids % 20 == 0] @ x.T
    hit = 0
    for q, line in zip(ids[ids % 20 == 0], s):
        line[ids == q] = -np.inf
        hit += len(got[q] & set(ids[np.argsort(-line)[:20]].tolist()))
    assert hit / (20 * len(got)) >= 0.9 and len(got) == 100


def test_common_lines_between_other_neighbours_do_not_become_single_windows(spark, monkeypatch):
    """Variants of a common line are halved: the rows made for them stay below their windows, and the spans are exact."""
    rnd = random.Random(11)
    line = [f"l{i}" for i in range(48)]
    words = [[*(f"a{d}_{i}" for i in range(rnd.randint(0, 40))), *line[rnd.randint(0, 6) :], *(f"z{rnd.randint(0, 3) if i < 3 else d}_{i}" for i in range(rnd.randint(0, 40)))] for d in range(400)]
    made, materialise = [], substring.materialise

    def counted(df, name, *rest):
        out = materialise(df, name, *rest)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(substring, "materialise", counted)
    monkeypatch.setattr(substring, "HEAVY", 50, raising=False)
    out = {r["doc_id"]: r for r in substring.remove_repeats(documents(spark, enumerate(" ".join(w) for w in words)), most_variants=8).collect()}
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    for d, w in enumerate(words):
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        assert out[d]["n_removed"] == len(gone)
        assert out[d]["kept_text"] == " ".join(x for i, x in enumerate(w) if i not in gone)
    passages = sum(n for name, n in made if name == "sub-passages")
    print(made)
    assert 100 < passages and all(n <= 3 * passages for name, n in made if name not in ("sub-places", "sub-again"))
