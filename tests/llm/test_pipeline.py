"""The pipeline, stage by stage, against brute force on what each stage was given."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import pytest

from vitrine.llm.common import materialise
from vitrine.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, ids string"
BAD = ("idiot", "moron", "scum", "vermin")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones, exact and near copies, a hot source, nulls, empty texts and clashing columns."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(20, 90))) for _ in range(260)]
    toxic = {i for i in range(260) if i % 6 == 1}
    for i in toxic:
        texts[i] += " " + " ".join(rnd.choice(BAD) for _ in range(12))
    edited = texts[20].split()
    edited[-1] = "edited"
    more = [texts[3], texts[3].replace(" ", "\n\t", 2), " ".join(edited), texts[20].upper(), None, "", " \t ", "one", "é ü", "w " * 4000]
    rows = [(i, t, "en", None if i % 7 == 0 else "hot" if i % 3 else "cold", len(t or ""), 1.0, False, "x") for i, t in enumerate([*texts, *more])]
    rows.append((None, "a row without an identifier", None, None, None, None, None, None))
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{where}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(240)] + [(9999, 1, 1), (None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, toxic


def _words(text):
    return (text or "").encode().split()


def _keep_near(rows):
    """Brute force: what near-dedup keeps of rows with distinct identifiers."""
    sets = {}
    for r in rows:
        w = _words(r["text"])
        w = [x.lower() for x in w]
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return {d for d, r in root.items() if d == r}


def test_stages(spark, folder):
    where, toxic = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, where), "test-stage")
        seen.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.schema.names == SCHEMA.replace(",", "").split()[::2]
    given, clean, single, apart, mixed, tokens = seen

    every = {r["doc_id"] for r in given}
    assert {r["doc_id"] for r in clean} == every - toxic and len(clean) == len(given) - len(toxic)

    lowest = {}
    for r in clean:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        lowest[key] = min(lowest.get(key, (2, 0)), (r["doc_id"] is not None, r["doc_id"] or 0))
    assert Counter(r["doc_id"] for r in single) == Counter(d if has else None for has, d in lowest.values())

    named = [r for r in single if r["doc_id"] is not None]
    assert Counter(r["doc_id"] for r in apart) == Counter([*_keep_near(named), *(None for r in single if r["doc_id"] is None)])
    assert {r["doc_id"]: r for r in apart if r["doc_id"] in (3, 20)} == {r["doc_id"]: r for r in given if r["doc_id"] in (3, 20)}

    whole, taken = {r["doc_id"]: r for r in apart}, Counter()
    for r in mixed:
        own = [w.decode() for w in _words(whole[r["doc_id"]]["text"])]
        piece = Counter(w.decode() for w in _words(r["text"]))
        assert r["n_chars"] == len(r["text"]) and not piece - Counter(own)
        assert tuple(r)[2:4] + tuple(r)[5:] == tuple(whole[r["doc_id"]])[2:4] + tuple(whole[r["doc_id"]])[5:]
        taken[r["doc_id"]] += piece.total()
    assert all(n <= 2 * len(_words(whole[d]["text"])) for d, n in taken.items())
    size, got = Counter(), Counter()
    for d, r in whole.items():
        size[r["source"]] += len(_words(r["text"]))
        got[r["source"]] += taken[d]
    goal = _targets(size)
    # blocks have about 128 words, and each source takes a whole number of them
    assert all(abs(got[s] - goal[s]) <= 0.02 * goal[s] + 256 for s in size)

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    expected = Counter()
    for r in mixed:
        ids = t.encode(r["text"], add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        expected[r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(map(tuple, tokens)) == expected


def _targets(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, rest, free = {}, 1.5 * sum(size.values()), set(names)
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * size[s]}
        if not full:
            return goal | share
        goal |= {s: 2 * size[s] for s in full}
        rest -= sum(goal[s] for s in full)
        free -= full
    return goal


def test_run_is_the_stages_and_repeats(spark, folder):
    where, _ = folder
    first, second = (Counter(map(tuple, corpus_pipeline.run(spark, where).collect())) for _ in range(2))
    assert first == second and first


def test_empty_documents(spark, folder, tmp_path):
    where, _ = folder
    for name in ("documents", "labels"):
        spark.read.parquet(f"{where}/{name}.parquet").where("doc_id < 0").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_toxicity_holds_few_documents_at_once(spark, folder, monkeypatch):
    """Whole documents come in small Arrow batches, their text once."""
    where, _ = folder
    from vitrine.llm import toxicity

    class Counting:
        def scores(self, data, offsets):
            return [float(len(offsets) - 1 > 500)] * (len(offsets) - 1)

    docs = spark.range(1200).selectExpr("id as doc_id", "cast(id as string) as text", "'en' as lang").coalesce(1)
    plan = toxicity.score(docs, Counting(), keep=("doc_id", "text", "lang"))._jdf.queryExecution().optimizedPlan().toString()
    assert "__text" not in plan
    monkeypatch.setattr(toxicity, "learnt_from", lambda docs, labels: Counting())
    assert sorted(map(tuple, corpus_pipeline.drop_toxic(spark, docs, where).collect())) == sorted((i, str(i), "en") for i in range(1200))


def test_workers_forget_what_other_operators_keep():
    from vitrine.llm import bpe, common

    with open(tokenizer_path(), "rb") as f:
        bpe.vocabulary(f.read())
    assert list(common.frugal(iter, "bpe")([])) == [] and len(bpe._loaded) == 1
    assert list(common.frugal(iter)([])) == [] and not bpe._loaded
