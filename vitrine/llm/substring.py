"""Substring dedup: matching statistics of passages in suffix automata of reference shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, frugal, materialise, ngram_hashes, slices, text_buffers, word_hashes

#: A place is named by what its row's result depends on: the identifier (0 for null) and a hash of the text.
KEY = ["k", "h"]
PLACES = "k long, h long, start int, windows int, anchor long, content long"
#: Keys with more rows than this meet their partners by broadcast: there are at most rows / HEAVY of them.
HEAVY = 1 << 16


class SuffixAutomaton:
    """A suffix automaton of several word sequences (Blumer et al. 1985), with weighted numbers of occurrences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.seen = [-1], [0], [0]

    def add(self, words: list, weight: int) -> None:
        """Add a sequence that occurs ``weight`` times."""
        next_, link, length, seen = self.next, self.link, self.length, self.seen
        last = 0
        for w in words:
            if (q := next_[last].get(w)) is not None and length[q] == length[last] + 1:
                last = q
                seen[q] += weight
                continue
            new, p = -1, last
            if q is None:
                new = len(next_)
                next_.append({})
                link.append(0)
                length.append(length[last] + 1)
                seen.append(weight)
                while p >= 0 and w not in next_[p]:
                    next_[p][w] = new
                    p = link[p]
                if p < 0:
                    last = new
                    continue
                q = next_[p][w]
                if length[q] == length[p] + 1:
                    link[new] = q
                    last = new
                    continue
            clone = len(next_)
            next_.append(next_[q].copy())
            link.append(link[q])
            length.append(length[p] + 1)
            seen.append(0)
            link[q] = clone
            if new >= 0:
                link[new] = clone
            else:
                seen[clone] = weight
            while p >= 0 and next_[p].get(w) == q:
                next_[p][w] = clone
                p = link[p]
            last = new if new >= 0 else clone

    def count(self) -> None:
        """Carry the numbers of occurrences up the suffix links; call once, after the last ``add``."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.seen[self.link[s]] += self.seen[s]

    def repeated(self, words: list, window: int) -> list[int]:
        """Starts of the windows of ``words`` that occur more than once: streams the words, keeping the longest match."""
        next_, link, length, seen = self.next, self.link, self.length, self.seen
        state, match, out = 0, 0, []
        for i, w in enumerate(words):
            while state and w not in next_[state]:
                state = link[state]
                match = length[state]
            if w in next_[state]:
                state, match = next_[state][w], match + 1
            while length[link[state]] >= window:
                state = link[state]
                match = length[state]
            if match >= window and seen[state] > 1:
                out.append(i - window + 1)
        return out


def _anchored(window: int, gram: int):
    """Cuts documents into passages. The anchor of a window is the least hash of its ``gram``-word runs (the first, on
    ties); windows in a row with the same anchor place form a passage. Equal windows have equal anchors.
    """
    span = window - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffers(batch.column(2))
            for i, j in slices(off):
                words, first = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                grams = ngram_hashes(words, gram)
                n = len(words) - window + 1
                if n <= 0:
                    continue
                at, have = np.arange(len(grams)), 1
                while have < span:  # the place of the least gram of ever longer runs
                    step = min(have, span - have)
                    a, b = at[:-step], at[step:]
                    at, have = np.where(grams[b] < grams[a], b, a), have + step
                at = at[:n]
                doc = np.searchsorted(first, np.arange(n), side="right") - 1
                inside = np.arange(n) + window <= first[doc + 1]
                new = np.ones(n, bool)
                new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
                begin = np.flatnonzero(new & inside)
                edge = np.flatnonzero(new | ~inside)
                end = np.append(edge, n)[np.searchsorted(edge, begin, side="right")]
                size = end - begin
                text = np.zeros(len(begin), np.uint64)
                for length in np.unique(size):
                    own = size == length
                    text[own] = ngram_hashes(words, window + int(length) - 1)[begin[own]]
                rows = pa.array(i + doc[begin])
                yield pa.record_batch(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array((begin - first[doc[begin]]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(grams[at[begin]].view(np.int64)), pa.array(text.view(np.int64))],
                    ["k", "h", "start", "windows", "anchor", "content"],
                )

    return run


def _words(window: int):
    """The words of the passages that are asked for: one row per passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                words = batch.column("text")[r].as_py().encode().split()
                for p in batch.column("passages")[r].as_py():
                    rows.append({"anchor": p["anchor"], "content": p["content"], "n": p["n"], "windows": p["windows"], "words": b" ".join(words[p["start"] : p["start"] + p["windows"] + window - 1])})
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, _PASSAGE)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _PASSAGE)

    return run


_PASSAGE = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("windows", pa.int32()), ("words", pa.binary())])
_ONE = "anchor long, content long, n long, spans array<struct<from:int,to:int>>"
_SPANS = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))])


def _matched(window: int, shard_words: int):
    """Builds automata of reference shards and streams passages through them; input is sorted by anchor."""

    def flush(rows):
        automaton = SuffixAutomaton()
        for r in rows:
            automaton.add(r[3], r[2])
        automaton.count()
        out = []
        for anchor, content, n, words in rows:
            spans: list[dict] = []
            for s in automaton.repeated(words, window):
                if spans and spans[-1]["to"] >= s:
                    spans[-1]["to"] = s + window
                else:
                    spans.append({"from": s, "to": s + window})
            if spans:
                out.append({"anchor": anchor, "content": content, "n": n, "spans": spans})
        return pa.RecordBatch.from_pylist(out, _SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for anchor, content, n, words in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "n", "words"))):
                if held and held[-1][0] != anchor and size >= shard_words:
                    yield flush(held)
                    held, size = [], 0
                own = words.split()
                held.append((anchor, content, n, own))
                size += len(own)
        if held:
            yield flush(held)

    return run


_HALF = pa.schema([(c, pa.int64()) for c in ("root", "root_content", "root_n")] + [(c, pa.int32()) for c in ("at", "place", "lo", "hi")] + [("anchor", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("windows", pa.int32()), ("words", pa.binary())])
HALVES = "root long, root_content long, root_n long, at int, place int, lo int, hi int, anchor long, content long, n long, windows int, words binary"


def _halved(window: int, gram: int):
    """Splits passages in two by where the anchor stands in a window (``lo`` to ``hi``, in words). The new anchor is that of the
    words that all windows of the half share, so equal windows meet again; a half of one place has that window as anchor.
    """

    def digest(words: bytes) -> int:
        return int.from_bytes(hashlib.md5(words).digest()[:8], "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                words, place = r["words"].split(), r["place"]
                if place < 0:  # a whole passage: the first run of words that has the anchor's hash
                    raw = np.frombuffer(r["words"], np.uint8)
                    place = int(np.flatnonzero(ngram_hashes(word_hashes(raw, np.array([0, len(raw)]))[0], gram).view(np.int64) == r["anchor"])[0])
                middle = (r["lo"] + r["hi"]) // 2
                for lo, hi in ((r["lo"], middle), (middle + 1, r["hi"])):
                    first, last = max(0, place - hi), min(r["windows"] - 1, place - lo)
                    if lo <= hi and first <= last:
                        own = b" ".join(words[first : last + window])
                        core = b" ".join(words[place - lo : place - hi + window])
                        rows.append({**r, "at": r["at"] + first, "place": place - first, "lo": lo, "hi": hi, "anchor": digest(b"%d %d " % (lo, hi) + core), "content": digest(own), "windows": last - first + 1, "words": own})
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_pylist(rows, _HALF)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _HALF)

    return run


def _meet(rows: DataFrame, table: DataFrame, on: list[str], size: str) -> DataFrame:
    """``rows`` joined with ``table`` (one row for each key, ``size`` of ``rows`` have it): no task gets all rows of a heavy key."""
    heavy = table.where(F.col(size) > HEAVY)
    light = rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(table.where(F.col(size) <= HEAVY), on)
    return light.unionByName(rows.join(F.broadcast(heavy), on))


def _spans_of_wide(wide: DataFrame, window: int, gram: int, shard_words: int, most_variants: int, scratch: list[DataFrame]) -> list[DataFrame]:
    """``anchor, content, n, span`` of repeated windows in passages whose anchors have too many variants for one shard.

    Passages are halved until a half's anchor has one content (repeated, if it stands more than once), few (an automaton decides)
    or stands once (dropped). Halving ends at single windows, so there are at most five rounds for 28 windows; what
    a common line's neighbours make unlike is dropped on the way and never becomes single windows.
    """
    found = []
    as_root = [F.col("anchor").alias("root"), F.col("content").alias("root_content"), F.col("n").alias("root_n"), F.lit(0).alias("at"), F.lit(-1).alias("place"), F.lit(0).alias("lo"), F.lit(window - gram).alias("hi")]
    rest = wide.select(*as_root, "anchor", "content", "n", "windows", "words")
    of_root = [F.col("root").alias("anchor"), F.col("root_content").alias("content"), F.col("root_n").alias("n")]
    span = lambda a, b: F.struct(a.cast("int").alias("from"), b.cast("int").alias("to")).alias("span")
    while not rest.isEmpty():
        half = materialise(rest.mapInArrow(frugal(_halved(window, gram)), HALVES), "sub-halves")
        kinds = half.groupBy("anchor", "content").agg(F.sum("n").alias("of"), F.count("*").alias("rows"))
        groups = materialise(kinds.groupBy("anchor").agg(F.sum("of").alias("of"), F.sum("rows").alias("rows"), F.count("*").alias("kinds")).where("of > 1"), "sub-groups")
        met = materialise(_meet(half, groups, ["anchor"], "rows"), "sub-met")
        scratch += [half, groups, met]
        found.append(met.where("kinds = 1").select(*of_root, span(F.col("at"), F.col("at") + F.col("windows") + window - 1)))
        few = met.where((F.col("kinds") > 1) & (F.col("kinds") <= most_variants))
        texts = few.groupBy("anchor", "content").agg(F.sum("n").alias("n"), F.first("words").alias("words"))
        dealt = texts.repartition("anchor").sortWithinPartitions("anchor", "content")
        hits = materialise(dealt.mapInArrow(frugal(_matched(window, shard_words)), _ONE), "sub-hits")
        scratch.append(hits)
        own = _meet(few.drop("n"), hits, ["anchor", "content"], "n").select("root", "root_content", "root_n", "at", F.explode("spans").alias("s"))
        found.append(own.select(*of_root, span(F.col("at") + F.col("s.from"), F.col("at") + F.col("s.to"))))
        rest = met.where(F.col("kinds") > most_variants).select(*half.columns)
    return found


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, spans = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
        kept, n_words, n_removed, merged = [], [], [], []
        for text, own in zip(texts, spans):
            words = (text or "").encode().split()
            union: list[list[int]] = []
            for s in sorted((s["from"], s["to"]) for s in own or []):
                if union and s[0] <= union[-1][1]:
                    union[-1][1] = max(union[-1][1], s[1])
                else:
                    union.append([*s])
            out, at = [], 0
            for a, b in union:
                out += words[at:a]
                at = b
            out += words[at:]
            kept.append(b" ".join(out).decode())
            n_words.append(len(words))
            n_removed.append(len(words) - len(out))
            merged.append([{"from": a, "to": b} for a, b in union])
        yield pa.record_batch([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(merged, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = 35, gram: int = 8, shard_words: int = 20_000, most_variants: int = 512) -> DataFrame:
    """``docs(doc_id, text)`` without repeated passages: ``doc_id, n_words, n_removed, spans, kept_text``.

    A window is ``window`` consecutive words of one document. Every word goes that is covered by a window whose words
    also stand at another place, in the same document or elsewhere; so the first of several copies goes too. Windows
    are judged on the input. ``spans`` are the removed runs (from, to, in words), ``kept_text`` the other words joined
    by one space. Null and empty texts have no words. Rows without doc_id, and rows that share one, are documents of
    their own: a row's result depends on the words that stand in it and on nothing else of it. Other columns are
    ignored; an empty table gives no rows.

    1. Documents are cut into passages by the anchors of their windows (see ``_anchored``), so that equal windows meet
       under one anchor. Passages that occur as a whole more than once are repeated at once, by count; anchors that
       occur once are done.
    2. Anchors with different passages are what is left. Their distinct passages, with counts, are dealt by anchor into
       reference shards of about ``shard_words`` words; each task builds a suffix automaton for a shard and streams the
       shard's passages through it for matching statistics. A window whose state occurs more than once is repeated.
    3. An anchor with more than ``most_variants`` different passages (a common line between ever other neighbours) is
       dealt out further: its passages are halved by the anchor's place in their windows until few are left under an
       anchor (see ``_spans_of_wide``).

    Passages count as equal if anchor and content, two 64-bit hashes, both are.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k"), F.xxhash64(text).alias("h"))
    texts = d.where("text is not null").select(*KEY, "text")
    places = materialise(texts.mapInArrow(frugal(_anchored(window, gram)), PLACES), "sub-places")
    seen = places.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("content") == F.max("content")).alias("same")).where("n > 1")
    seen = materialise(seen, "sub-seen")
    again = materialise(_meet(places, seen, ["anchor"], "n").drop("n"), "sub-again")
    drop_scratch(spark, seen)
    drop_scratch(spark, places)
    spans = again.where("same").select(*KEY, F.col("start").alias("from"), (F.col("start") + F.col("windows") + window - 1).alias("to"))

    mixed = again.where("not same")
    kinds = materialise(mixed.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "start", "windows")).alias("p")), "sub-kinds")
    wide = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > most_variants).select("anchor", F.lit(True).alias("wide"))
    asked = kinds.groupBy("p.k", "p.h").agg(F.collect_list(F.struct("anchor", "content", "n", "p.start", "p.windows")).alias("passages"))
    worded = texts.join(asked, KEY).select("text", "passages").mapInArrow(_words(window), "anchor long, content long, n long, windows int, words binary")
    passages = materialise(worded.dropDuplicates(["anchor", "content"]).join(wide, "anchor", "left"), "sub-passages")
    drop_scratch(spark, kinds)
    ordered = passages.where("wide is null").select("anchor", "content", "n", "words").repartition("anchor").sortWithinPartitions("anchor", "content")
    found, scratch = ordered.mapInArrow(frugal(_matched(window, shard_words)), _ONE), [passages]
    halved = _spans_of_wide(passages.where("wide"), window, gram, shard_words, most_variants, scratch)
    if halved:
        split = reduce(DataFrame.unionByName, halved).groupBy("anchor", "content", "n").agg(F.collect_list("span").alias("spans"))
        found = found.unionByName(split.select("anchor", "content", "n", F.col("spans").cast("array<struct<from:int,to:int>>").alias("spans")))
    found = materialise(found, "sub-found")
    for t in scratch:
        drop_scratch(spark, t)
    parts = _meet(mixed, found, ["anchor", "content"], "n").select(*KEY, "start", F.explode("spans").alias("s")).select(*KEY, (F.col("start") + F.col("s.from")).alias("from"), (F.col("start") + F.col("s.to")).alias("to"))
    by_doc = spans.unionByName(parts).groupBy(*KEY).agg(F.collect_set(F.struct(F.col("from").cast("int").alias("from"), F.col("to").cast("int").alias("to"))).alias("spans"))
    out = "doc_id long, n_words long, n_removed long, spans array<struct<from:int,to:int>>, kept_text string"
    return d.join(by_doc, KEY, "left").select("doc_id", "text", "spans").mapInArrow(_removed, out)
