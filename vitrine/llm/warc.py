"""WARC archives: writing with revisit records, reading back, and an external merge of sorted index runs."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialise, scratch_path

END = "\r\n\r\n"
INDEX = "urlkey string, captured string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of a hexadecimal string whose length is a multiple of ten (SHA-1 has 40)."""
    parts = [F.lpad(F.conv(F.substring(hexed, i, 10), 16, 32), 8, "0") for i in range(1, 41, 10)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """The URL with its host reversed (``net,example)/path``), lower-case host, without scheme, port and fragment."""
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)(?::[0-9]*)?([^#]*)"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, parts, 1)), r"\.")), ",")
    return F.when(url.isNull(), F.lit("")).when(~url.rlike(parts), url).otherwise(F.concat(host, F.lit(")"), F.regexp_extract(url, parts, 2)))


#: The last byte of a gzip member is the highest of its content's length: 0 for less than 16 MiB.
_LAST = "\0"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as a gzip member of its own, without the last byte, which is 0: the text sink writes it as the end of
    a line. A record of 16 MiB or more is followed by an empty member."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.column(0).slice(i, 64).to_pylist()
            out = [gzip.compress(r, 6, mtime=0) + (b"" if len(r) < 1 << 24 else gzip.compress(b"", mtime=0)) for r in part]
            yield pa.record_batch([pa.array([m[:-1] for m in out], pa.binary())], ["value"])


def write(pages: DataFrame, path: str, captured: Column, least_bytes: int = 0, file_bytes: int = 8 << 20) -> None:
    """Write ``pages(page_id, url, html)`` as WARC 1.1 files, a gzip member for each record, into the folder ``path``.

    The payload is the html in UTF-8, a null html an empty payload. Of the records whose payloads are equal and have at
    least ``least_bytes`` bytes, the one with the largest page_id is a response and the others revisit it; smaller
    payloads are all responses. ``captured`` is the capture time (a timestamp; null: the epoch). A row without page_id
    gets a record whose ID is the row's own (``urn:x-row``), and is a revisit of an equal payload that has a page_id, else a response;
    repeated rows give repeated records; an empty table gives no records.
    Control characters in a URL are percent-encoded, a null URL gives no target.

    Digests are grouped (pre-aggregated), and the payloads meet what was decided for them in one join, their only
    shuffle. A file holds so many records as have about ``file_bytes`` of payload at their mean size, and never more than 1.5 GB of
    the largest, as a file is read back whole.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), captured.alias("captured"))
    sha1 = F.unhex(F.sha1(F.col("html").cast("binary")))
    digests = materialise(d.select("page_id", sha1.alias("sha"), F.unhex(F.sha2(F.col("html").cast("binary"), 256)).alias("same"), F.octet_length("html").cast("long").alias("n")), "warc-digests")
    groups = digests.where(F.col("n") >= least_bytes).groupBy("same").agg(F.max("page_id").alias("first"), F.count("*").alias("members")).where("members > 1").select("same", "first")
    plan = digests.distinct().join(groups, "same", "left").select(F.col("page_id").alias("__id"), F.col("sha").alias("__sha"), F.col("n").alias("__n"), F.coalesce("first", "page_id").alias("first"))
    total, count, longest = digests.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    most = max(1, min(int(file_bytes * count // max(1, total)), (3 << 29) // max(1, longest))) if count else 1
    clean_url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    name = lambda c: F.concat(F.lit("<urn:x-page:"), c.cast("string"), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    own = F.coalesce(name(F.col("page_id")), F.concat(F.lit("<urn:x-row:"), F.monotonically_increasing_id().cast("string"), F.lit(">")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("__n").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", own),
        line("WARC-Date", F.date_format(F.coalesce("captured", F.timestamp_seconds(F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(line("WARC-Target-URI", clean_url)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.hex("__sha")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name(F.col("first"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
        F.lit(END),
    )
    dealt = d.withColumn("sha", sha1).join(plan, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha")))
    members = dealt.withColumn("block", block).select(record.cast("binary").alias("value")).mapInArrow(_members, "value binary")
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", _LAST).option("compression", "none").option("maxRecordsPerFile", most).text(path)
    drop_scratch(spark, digests)


def _inflated(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of every gzip member."""
    at, view = 0, memoryview(content)
    while at < len(content):
        d, data, fed = zlib.decompressobj(31), [], at
        while not d.eof:
            if fed >= len(content):
                raise ValueError(f"the gzip member at {at} is cut off")
            data.append(d.decompress(view[fed : fed + (1 << 14)]))
            fed += 1 << 14
        end = min(fed, len(content)) - len(d.unused_data)
        yield at, end - at, b"".join(data)
        at = end


def _record(data: bytes, at: int) -> tuple[dict[str, str], int, int]:
    """Headers of the record at ``at``, and where its block begins and ends; a wrong length or end is an error."""
    stop = data.find(END.encode(), at)
    head = data[at:stop].decode().split("\r\n") if stop >= 0 else [""]
    if not head[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    headers = {k.lower(): v for k, v in (h.split(": ", 1) for h in head[1:])}
    finish = stop + 4 + int(headers["content-length"])
    if data[finish : finish + 4] != END.encode():
        raise ValueError(f"the record at {at} doesn't end where its length says")
    return headers, stop + 4, finish


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of every record in a file's content.

    In a gzipped file a record is a member, and offset and length are those of the member in the file itself: what lies
    there can be read and inflated alone. A plain file holds its records one after the other.
    """
    if content.startswith(b"\x1f\x8b"):
        for at, length, data in _inflated(content):
            if data:
                headers, begin, finish = _record(data, 0)
                if finish + 4 != len(data):
                    raise ValueError(f"the member at {at} is not one record")
                yield at, length, headers, data[begin:finish]
        return
    at = 0
    while at < len(content):
        headers, begin, finish = _record(content, at)
        yield at, finish + 4 - at, headers, content[begin:finish]
        at = finish + 4


def read_runs(spark, path: str) -> DataFrame:
    """The index of all archives in the folder ``path``: for each file one run, sorted by URL key, time and page_id.

    Payloads of responses are digested again; one that differs from its header is an error.
    """
    page = lambda urn: int(urn.rpartition(":")[2].rstrip(">")) if urn.startswith("<urn:x-page:") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                for at, length, h, block in records(batch.column(1)[k].as_py()):
                    payload = block[block.index(END.encode()) + 4 :]
                    head = dict(x.split(": ", 1) for x in block[: len(block) - len(payload) - 4].decode().split("\r\n")[1:])
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    kind = h["warc-type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"digest of {h['warc-record-id']} differs")
                    size = len(payload) if kind == "response" else int(head["Content-Length"])
                    refers = page(h["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((h["warc-date"], page(h["warc-record-id"]), h.get("warc-target-uri"), kind, refers, size, digest, batch.column(0)[k].as_py(), at, length))
                names = [f.split()[0] for f in INDEX.split(", ")][1:]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], _arrow(INDEX.split(", ")[1:]))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    found = files.mapInArrow(run, ", ".join(INDEX.split(", ")[1:])).withColumn("urlkey", url_key(F.col("url")))
    names = [f.split()[0] for f in INDEX.split(", ")]
    return found.select(*names).sortWithinPartitions("file", "urlkey", "captured", "page_id")


def _arrow(fields: list[str]) -> pa.Schema:
    return pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in fields])


def loser_tree(runs: list[list]) -> Iterator[int]:
    """Numbers of the runs in the order in which a merge of the sorted lists takes their heads; ties to the first run.

    ``tree[1:]`` holds the loser of each match, ``tree[0]`` the winner; a head that leaves replays its own path only.
    """
    k = len(runs)
    heads = [iter(r) for r in runs]
    key = [next(h, None) for h in heads]
    beats = lambda a, b: a >= 0 and (b < 0 or (key[a] is not None and (key[b] is None or (key[a], a) < (key[b], b))))
    tree = [-1] * max(1, k)

    def winner(node: int) -> int:
        if node >= k:
            return node - k
        a, b = winner(2 * node), winner(2 * node + 1)
        tree[node] = b if beats(a, b) else a
        return a if beats(a, b) else b

    if not k:
        return
    tree[0] = winner(1) if k > 1 else 0
    while key[top := tree[0]] is not None:
        yield top
        key[top] = next(heads[top], None)
        node = (top + k) // 2
        while node:
            if beats(tree[node], top):
                tree[node], top = top, tree[node]
            node //= 2
        tree[0] = top


def merge_runs(runs: DataFrame, rows_per_task: int = 100_000) -> DataFrame:
    """All index rows in the global order of URL key, time and page_id: each partition, and the partitions in turn.

    Ranges of the whole order, of about ``rows_per_task`` rows, are dealt to the tasks, so a URL with very many
    captures spans several. A task gets a piece of every run, sorted already, and merges the pieces by a loser tree.
    """
    names = runs.columns
    n = max(1, -(-runs.count() // rows_per_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        files = table.column("file").to_pylist()
        number = [(p is not None, p or 0) for p in table.column("page_id").to_pylist()]  # none first, as Spark sorts
        keys = list(zip(table.column("urlkey").to_pylist(), table.column("captured").to_pylist(), number))
        begins = [i for i in range(len(files)) if i == 0 or files[i] != files[i - 1]]
        ends = [*begins[1:], len(files)]
        at, order = [*begins], []
        for r in loser_tree([keys[a:b] for a, b in zip(begins, ends)]):
            order.append(at[r])
            at[r] += 1
        yield from table.take(pa.array(order, pa.int64())).to_batches(max_chunksize=20_000)

    ranged = runs.repartitionByRange(int(n), "urlkey", "captured", "page_id", "file", "offset").sortWithinPartitions("file", "urlkey", "captured", "page_id")
    return ranged.mapInArrow(run, runs.schema).select(*names)


def archive(pages: DataFrame, captured: Column, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, and return the merged index: capture
    histories in global order, one row per record. See ``write``, ``read_runs`` and ``merge_runs``.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, captured, least_bytes)
    return merge_runs(materialise(read_runs(spark, path), "warc-runs"))
