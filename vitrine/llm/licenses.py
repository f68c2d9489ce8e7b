"""License scans: base phrases by word position, and an exact set-similarity join of text blocks with templates.

DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: What stands between paragraphs: lines without words.
PARAGRAPHS = r"\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n"

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose words stand consecutively, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public license texts, statements and notices, and their labels.
TEMPLATES = (
    ("Released under the MIT License.", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
        "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "bsd",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "isc",
    ),
    (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission "
        "is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The "
        "origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This "
        "notice may not be removed or altered from any source distribution.",
        "zlib",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "unlicense",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
        "gpl",
    ),
    (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "lgpl",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "mpl",
    ),
)

#: Templates of at most so many words are met in shorter runs of words than the others.
SHORT = 40

#: A notice may stretch over so many times its template's words.
SPAN = 1.5
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return sorted(set(re.findall(WORD, text.lower())))


def longest_span(words: int) -> int:
    """The most words over which a notice of a template of so many words may stretch."""
    return math.ceil(SPAN * words)


def needed(size: int, percent: int) -> int:
    """Words of a template of ``size`` distinct words that a block must hold."""
    return -(-size * percent // 100)


def _starts(words: Column, phrase: str) -> Column:
    own = phrase.split()
    at = lambda i, k: F.element_at(words, (i + (k + 1)).cast("int"))
    every = lambda i: _all([at(i, k) == w for k, w in enumerate(own)])
    last = F.size(words) - len(own)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), every)).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, percent: int = 90, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` and, from the whole ``text``: ``n_words, n_base, first_word, last_word``,
    ``base_labels, labels`` (arrays, distinct and sorted), ``blocks`` (array of label, line and containment for every
    line or run of words that meets a template) and ``score``.

    A word is a run of digits, ASCII letters and non-ASCII characters, lower-cased. Base labels come from the places
    where a phrase's words stand consecutively. A block is a line or a run of words; it meets a template if a span in it, at most
    ``SPAN`` times as long as the template, holds at least ``percent`` of the template's distinct words: words scattered over prose
    meet nothing. So that notices wrapped over lines are met, runs of words are blocks as well, each starting halfway into the one
    before: for templates of at most ``SHORT`` words inside a paragraph, for longer ones, which have paragraphs of their own, in the
    whole text. A run is twice as long as the longest span of its templates, so that one of them holds any span in full; lines
    longer than that are met by runs alone. Their ``line`` is -1, -2 and so on; they are left out of ``blocks`` where a line of the
    text meets the same template at least as well. ``score`` is 1 with a base label, else the largest containment that was met, else 0. Null and empty texts have no words, no labels and score 0; repeated rows give repeated results; an empty
    table gives no rows.

    The exact join: each block is reduced to its words that some template has (others can't count), and blocks with
    fewer than the smallest number needed go, and texts that as a whole meet no template have no blocks at all. The remaining words are ordered by their number over all blocks, the
    rarest first. A pair that shares enough words shares one in the beginnings (prefixes) of both, whose lengths
    follow from the sizes; positions bound what may still come. What remains is counted in full, span by span. Only the templates'
    words and their numbers come to the driver: they are bounded by the templates.
    """
    sets = [template_words(t) for t, _ in templates]
    vocabulary = sorted({w for s in sets for w in s})
    least = min(needed(len(s), percent) for s in sets)
    low = lambda c: F.translate(c, CAPITALS, SMALL)
    ws = F.transform(F.split(low(F.coalesce(F.col("text").cast("string"), F.lit(""))), "\n"), lambda line: F.regexp_extract_all(line, F.lit(WORD), F.lit(0)))
    d = docs.select(*keep, F.col("text").cast("string").alias("__text"), ws.alias("__ws"))
    lengths = [len(re.findall(WORD, t.lower())) for t, _ in templates]
    runs_of = [longest_span(max([n for n in lengths if n <= SHORT], default=1)), longest_span(max(lengths))]
    has = lambda w: F.array_distinct(F.filter(w, lambda x: x.isin(vocabulary)))
    holds = lambda w, own: F.size(F.filter(w, lambda x: x.isin(own))) >= needed(len(own), percent)
    enough = lambda w: reduce(lambda p, q: p | q, [holds(w, own) for own in sets])
    # a block that lacks so many words of a template as may be lacking, and one more, doesn't meet it: the longest are asked for
    asked = sorted({w for own in sets for w in sorted(own, key=lambda x: (-len(x), x))[: len(own) - needed(len(own), percent) + 1]})

    met_words = lambda w: F.filter(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("at"))), lambda e: e["w"].isin(vocabulary))
    block = lambda line, seq, kind: F.struct(line.alias("line"), F.array_distinct(seq["w"]).alias("words"), F.lit(kind).alias("kind"), seq.alias("seq"))

    def runs(w: Column, kind: int) -> Column:
        span = F.lit(runs_of[kind])
        starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), span)
        return F.transform(starts, lambda p: block(F.lit(-1), met_words(F.slice(w, p, 2 * span)), kind))

    paragraphs = F.transform(F.split(low(F.col("__text")), PARAGRAPHS), lambda t: F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    short = F.flatten(F.transform(F.filter(paragraphs, lambda w: F.size(w) > 0), lambda w: runs(w, 0)))
    windows = F.transform(F.concat(short, runs(F.flatten("__ws"), 1)), lambda w, i: F.struct((-1 - i).alias("line"), w["words"].alias("words"), w["kind"].alias("kind"), w["seq"].alias("seq")))
    none = F.array().cast("array<struct<line:int,words:array<string>,kind:int,seq:array<struct<w:string,at:int>>>>")
    lines = F.transform("__ws", lambda x, i: block(i, F.when(F.size(x) <= 2 * max(runs_of), met_words(x)).otherwise(F.array().cast("array<struct<w:string,at:int>>")), 0))
    lines = F.filter(lines, lambda b: F.size(b["words"]) >= least)
    blocks = F.concat(lines, F.filter(windows, lambda b: enough(b["words"])))
    d = d.withColumn("__own", has(F.flatten("__ws")))
    may = low(F.col("__text")).rlike("|".join("[^a-z0-9]+".join(p.split()) for p, _ in phrases))
    d = d.select(
        *keep,
        F.aggregate("__ws", F.lit(0).cast("long"), lambda n, x: n + F.size(x)).alias("n_words"),
        F.when(may, F.flatten("__ws")).otherwise(F.array().cast("array<string>")).alias("__flat"),
        F.when(F.exists("__own", lambda x: x.isin(asked)) & enough(F.col("__own")), blocks).otherwise(none).alias("__blocks"),
    )
    d = d.select("*", *[_starts(F.col("__flat"), p).alias(f"__p{k}") for k, (p, _) in enumerate(phrases)]).drop("__flat")
    table = materialise(d.withColumn("__row", F.monotonically_increasing_id()), "license-blocks")

    blocks = table.select("__row", F.explode("__blocks").alias("b")).select("__row", "b.line", "b.words", "b.kind", "b.seq")
    counts = {r["w"]: r["n"] for r in blocks.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    spark = docs.sparkSession
    ranked = [sorted(order[w] for w in s) for s in sets]
    t = [(k, label, r, needed(len(r), percent), int(n > SHORT), longest_span(n)) for k, ((_, label), r, n) in enumerate(zip(templates, ranked, lengths))]
    prefixes = spark.createDataFrame([(word, i, len(r), n, k, label, r, kind, span) for k, label, r, n, kind, span in t for i, word in enumerate(r) if i + n <= len(r)], "word int, i int, t_size int, need int, template int, label string, t_words array<int>, t_kind int, t_span int")
    place = F.create_map(*[F.lit(x) for w, i in order.items() for x in (w, i)])
    r = blocks.select("__row", "line", "kind", F.array_sort(F.transform("words", lambda w: place[w])).alias("words"), F.transform("seq", lambda e: F.struct(place[e["w"]].alias("w"), e["at"].alias("at"))).alias("seq"))
    inside = lambda s: F.filter("seq", lambda e: (e["at"] >= s["at"]) & (e["at"] < s["at"] + F.col("t_span")))
    best = F.array_max(F.transform("seq", lambda s: F.size(F.array_intersect("t_words", F.transform(inside(s), lambda e: e["w"])))))
    entry = r.select("__row", "line", "kind", "words", "seq", F.size("words").alias("size"), F.posexplode(F.slice("words", F.lit(1), F.greatest(F.size("words") - least + 1, F.lit(0)))).alias("j", "word"))
    met = (
        entry.join(F.broadcast(prefixes), "word")
        .where("(line >= 0 or kind = t_kind) and size >= need and j + need <= size and 1 + least(t_size - i - 1, size - j - 1) >= need")
        .dropDuplicates(["__row", "line", "template"])
        .where(F.size(F.array_intersect("words", "t_words")) >= F.col("need"))
        .withColumn("shared", best)
        .where("shared >= need")
        .withColumn("by_line", F.max(F.when(F.col("line") >= 0, F.col("shared"))).over(W.partitionBy("__row", "template")))
        .where("line >= 0 or by_line is null or shared > by_line")
        .groupBy("__row")
        .agg(F.array_sort(F.collect_list(F.struct("label", "line", (F.col("shared") / F.col("t_size")).alias("containment")))).alias("blocks"))
    )
    places = F.flatten(F.array(*[F.col(f"__p{k}") for k in range(len(phrases))]))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(f"__p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]))))
    none = F.array().cast(met.schema["blocks"].dataType)
    out = table.join(met, "__row", "left").withColumn("blocks", F.coalesce("blocks", none)).withColumn("__places", places).withColumn("base_labels", base)
    return out.select(
        *keep,
        "n_words",
        F.size("__places").cast("long").alias("n_base"),
        F.array_min("__places").cast("long").alias("first_word"),
        F.array_max("__places").cast("long").alias("last_word"),
        "base_labels",
        F.array_sort(F.array_union("base_labels", F.transform("blocks", lambda b: b["label"]))).alias("labels"),
        "blocks",
        F.when(F.size("base_labels") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))).alias("score"),
    )


def oracle(phrases=PHRASES, templates=TEMPLATES, percent: int = 90) -> str:
    """DuckDB SQL for what op8 returns."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    starts = " union all ".join(
        f"select r, i - 1 as pos, '{label}' as label from words where " + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
        for p, label in phrases
    )
    tpl = ", ".join(f"({k}, '{label}', {quoted(template_words(t))}, {needed(len(template_words(t)), percent)}, {longest_span(len(re.findall(WORD, t.lower())))}, {len(re.findall(WORD, t.lower())) <= SHORT})" for k, (t, label) in enumerate(templates))
    return f"""
with d as (select row_number() over () as r, doc_id, {low} as t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '{WORD}') as w from d),
words as (select r, w, unnest(range(1, len(w) + 1)) as i from w),
base as ({starts}),
b as (select r, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as labels from base group by r),
tpl(k, label, words, need, span, short) as (values {tpl}),
may as (select r, t, w, tpl.* from w join tpl on len(list_intersect(list_distinct(w), tpl.words)) >= need),
part as (select r, k, label, words, need, span, w from may where not short
         union all select r, k, label, words, need, span, regexp_extract_all(unnest(regexp_split_to_array(t, '{PARAGRAPHS}')), '{WORD}') from may where short),
place as (select *, unnest(list_filter(range(1, len(w) + 1), lambda i: list_contains(words, w[i]))) as i from part where len(list_intersect(list_distinct(w), words)) >= need),
met as (select r, label, len(list_intersect(list_distinct(w[i:i + span - 1]), words)) / len(words) as c, len(list_intersect(list_distinct(w[i:i + span - 1]), words)) >= need as ok from place),
m as (select r, list(distinct label) as labels, max(c) as c from met where ok group by r)
select doc_id, len(w.w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       array_to_string(list_sort(coalesce(b.labels, [])), ',') as base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') as labels,
       case when n_base > 0 then 1.0::double else coalesce(m.c, 0)::double end as score
from w left join b using (r) left join m using (r)"""
