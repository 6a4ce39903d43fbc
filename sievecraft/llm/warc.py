r"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

A record ends by \r\n\r\n and says its block's length, so it names its successor's offset.
Files are read as byte ranges by many tasks: Spark cuts them where a record's end is followed
by the magic, so each row is a candidate, and its offset is the sum of what lies before it.
Inside a range pointer jumping finds where each candidate's chain leaves it; between ranges
joins over (file, offset) do so from each file's start. What the chain doesn't reach is magic
inside a payload, whose bytes go back to the record that they belong to.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, partitions, scratch, stored

MAGIC = b"WARC/1.1\r\n"
_END = b"\r\n\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)\r\n", re.I)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Places where the copies of one payload look up the first.
_SALTS = 32


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(url: str) -> str:
    """The URL without blanks and control characters, which a header line can't hold."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, html: str, payload_digest: str, refers_to: int | None) -> str:
    """A record but for the final \\r\\n\\r\\n."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html.encode())}\r\n\r\n"
    block = http if refers_to is not None else http + html
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(head) + "\r\n\r\n" + block


def write_archives(pages: DataFrame, path: str) -> str:
    """Writes a record for each (page_id, url, html) row; null html is empty.

    Of equal payloads that with the smallest page_id is the response and the others revisit
    it; rows that repeat its page_id and payload are responses too, and a null page_id
    revisits the smallest other or, without one, is a response. Files are as large as Spark's
    tasks make them. They are written by Spark's text writer, whose line end is the record's,
    so any store that Spark can write to does.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first")]
            found = (record(p, u, h or "", base64.b32encode(bytes.fromhex(d)).decode(), None if f is None or f == p else f) for p, u, h, d, f in zip(*cols, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["value"])

    known = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    firsts = known.select("page_id", "digest").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # its size is known when stored; if small, no page is shuffled, else the copies of one page are spread over salts
    firsts = stored(firsts, "warc-firsts").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = known.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int"))
    salted.join(firsts, ["digest", "salt"], "left").select("page_id", "url", "html", "digest", "first").mapInArrow(written, "value string").write.option("lineSep", _END.decode()).text(path)
    return path


def candidates(row: bytes, start: int, whole: bool) -> list[tuple[int, int, int]]:
    """Offset, block offset and successor's offset of each candidate of a row of bytes that lies at start.

    The row is what stands between two cuts: the first one's magic went with the cut, unless
    it is whole, as the file's first row is. -1 stands for a broken header.
    """
    at = [start - len(MAGIC)] if not whole else [start] if row.startswith(MAGIC) else []
    k = row.find(_END + MAGIC)  # a cut that the reader missed
    while k >= 0:
        at.append(start + k + len(_END))
        k = row.find(_END + MAGIC, k + 1)
    out = []
    for k in at:
        head = row.find(_END, max(k - start, 0))
        # the header's first line may have gone with the cut, but for its line end
        m = _LENGTH.search(b"\r\n" + row[max(k - start, 0) : head + 2]) if head >= 0 else None
        block = start + head + len(_END)
        out.append((k, block, block + int(m[1]) + len(_END)) if m else (k, -1, -1))
    return out


def reachable(at: np.ndarray, after: np.ndarray, doors: np.ndarray) -> np.ndarray:
    """Which candidates the chains from some of them (doors) pass, by pointer jumping; at is in order."""
    n = len(at)
    k = np.searchsorted(at, after)
    found = (after >= 0) & (k < n) & (at[np.minimum(k, n - 1)] == after) if n else np.zeros(0, bool)
    jump = np.append(np.where(found, k, n), n)
    kept = np.append(doors, False)
    for _ in range(n.bit_length()):
        kept[jump[kept]] = True
        jump = jump[jump]
    return kept[:n]


def exits(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The offset to which each candidate's chain leads past all candidates here; -1 where it breaks off."""
    n = len(at)
    if not n:
        return after
    k = np.searchsorted(at, after)
    inside = (after >= 0) & (k < n) & (at[np.minimum(k, n - 1)] == after)
    out = np.where(~inside & (after <= at[-1]), -1, after)  # between candidates: broken
    jump = np.where(inside, k, np.arange(n))
    for _ in range(n.bit_length()):
        jump = jump[jump]
    return out[jump]


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """value, file, range (its first byte) and file size of each row between cuts, in order inside a task."""
    rows = spark.read.option("lineSep", (_END + MAGIC).decode()).option("pathGlobFilter", "part-*").text(path)
    return rows.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("_metadata.file_size").alias("size"))


def _located(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, int, bytes]]:
    """file, range, file size, number of the row in its range, its offset among the range's rows, and the row's bytes."""
    now, k, at = None, 0, 0
    for batch in rows:
        for file, lo, size, value in zip(batch.column("file").to_pylist(), batch.column("range").to_pylist(), batch.column("size").to_pylist(), batch.column("value"), strict=True):
            if now != (file, lo):
                now, k, at = (file, lo), 0, 0
            row = value.as_py()
            yield file, lo, size, k, at, row
            k, at = k + 1, at + len(row) + len(_END + MAGIC)


_HEAD = [("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string())]
_PAYLOAD = [("payload", pa.binary())]
_SQL = {pa.string(): "string", pa.binary(): "binary", pa.int64(): "long", pa.bool_(): "boolean"}


def _parsed(head: bytes, block: bytes) -> tuple:
    """The columns of _HEAD from a record's header, and its payload (none for revisits)."""
    named = {k: v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n"))}
    kind, k = named.get("WARC-Type"), block.find(_END)
    payload = block[k + len(_END) if k >= 0 else 0 :] if kind == "response" else None
    return (named.get("WARC-Record-ID"), named.get("WARC-Target-URI"), kind, (named.get("WARC-Payload-Digest") or "").removeprefix("sha1:"), named.get("WARC-Refers-To")), payload


def _lean(run):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with lean():
            yield from run(batches)

    return task


def _sql(columns: list) -> str:
    return ", ".join(f"{k} {_SQL[t]}" for k, t in columns)


def _batches(rows: Iterator[tuple], columns: list) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for x in rows:
        held.append(x)
        size += 200 + sum(len(v) for v in x if isinstance(v, bytes))
        if size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), columns, strict=True)], [k for k, _ in columns])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), columns, strict=True)], [k for k, _ in columns])


def read_archives(spark: SparkSession, path: str, columns: list | None = None, derive=lambda payload: (payload,)) -> DataFrame:
    """record_id, url, record_type, payload_digest, refers_to, payload (null for revisits), file and offset of each record.

    Any file size will do, as ranges of files are tasks; a record must fit a cell. A chain
    ends where no candidate follows, and a record that its file doesn't hold whole is left
    out. Empty files have no rows. With `columns` and `derive` something derived stands in
    for the payload, which then isn't kept.
    """
    own_columns = _HEAD + (columns or _PAYLOAD)
    emitted = [("file", pa.string()), ("range", pa.int64()), ("number", pa.int64()), ("relative", pa.int64()), ("block", pa.int64()), ("after", pa.int64()), ("exit", pa.int64()), ("complete", pa.bool_()), ("total", pa.int64()), ("file_size", pa.int64()), *own_columns]
    nothing = (None,) * len(own_columns)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, held, total, size = None, [], 0, 0

            def of_range() -> Iterator[tuple]:
                out = exits(*(np.array([x[i] for x in held], np.int64) for i in (1, 3)))
                yield from ((*now, *x[:4], int(e), x[4], None, size, *x[5]) for x, e in zip(held, out, strict=True))
                yield (*now, *(None,) * 6, total, size, *nothing)

            for file, lo, length, k, at, row in _located(batches):
                if now != (file, lo):
                    if now:
                        yield from of_range()
                    now, held, size = (file, lo), [], length
                for offset, block, after in candidates(row, at, lo == 0 and k == 0):
                    whole = 0 <= block and after - len(_END) <= at + len(row)
                    found = nothing
                    if whole:
                        head, payload = _parsed(row[max(offset - at, 0) : block - len(_END) - at], row[block - at : after - len(_END) - at])
                        found = (*head, *derive(payload))
                    held.append((k, offset, block, after, whole, found))
                total = at + len(row) + len(_END + MAGIC)
            if now:
                yield from of_range()

        yield from _batches(rows(), emitted)

    found = stored(_ranges(spark, path).mapInArrow(_lean(emit), _sql(emitted)), "warc-candidates")
    before = F.sum("total").over(Window.partitionBy("file").orderBy("range")) - F.col("total")
    ranges = stored(found.where("total is not null").select("file", "range", before.alias("base")), "warc-ranges")
    moved = lambda c: F.when(F.col(c) >= 0, F.col(c) + F.col("base")).otherwise(F.lit(-1)).alias(c)
    chain = found.where("total is null").join(ranges, ["file", "range"]).select("file", "range", "number", (F.col("relative") + F.col("base")).alias("offset"), moved("block"), moved("after"), moved("exit"), "complete", "file_size")
    reached = _reached(chain, ranges)
    light = [("file", pa.string()), ("range", pa.int64()), ("number", pa.int64()), ("offset", pa.int64()), ("block", pa.int64()), ("after", pa.int64()), ("complete", pa.bool_()), ("kept", pa.bool_()), ("owner", pa.int64())]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whether a chain passes each candidate, and the last of its range up to it that one passes (-1: none)."""

        def of_range(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            at = part.column("offset").to_numpy()
            kept = reachable(at, part.column("after").to_numpy(), part.column("door").to_numpy(zero_copy_only=False))
            owner = np.maximum.accumulate(np.where(kept, at, -1))
            return pa.RecordBatch.from_arrays([*(part.column(k) for k, _ in light[:-2]), pa.array(kept), pa.array(owner)], [k for k, _ in light])

        now, held = None, []
        for batch in batches:
            keys = list(zip(batch.column("file").to_pylist(), batch.column("range").to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo < hi:
                    if held and now != keys[lo]:
                        yield of_range(held)
                        held = []
                    now = keys[lo]
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield of_range(held)

    doors = chain.join(reached.withColumn("door", F.lit(True)), ["file", "offset"], "left").withColumn("door", F.coalesce("door", F.lit(False)))
    doors = doors.withColumn("after", F.when(F.col("after") <= F.col("file_size"), F.col("after")).otherwise(F.lit(-1)))
    doors = doors.select("file", "range", "number", "offset", "block", "after", "complete", "door").repartition(partitions(spark), "file", "range").sortWithinPartitions("file", "range", "offset")
    marked = stored(doors.mapInArrow(_lean(mark), _sql(light)), "warc-marked")
    names = [k for k, _ in own_columns]
    records = marked.where("kept and after >= 0")
    located = found.where("complete").join(ranges, ["file", "range"]).select("file", (F.col("relative") + F.col("base")).alias("offset"), *names)
    result = records.where("complete").select("file", "offset").join(located, ["file", "offset"]).select(*names, "file", "offset")
    longer = stored(records.where("not complete").select("file", F.col("offset").alias("owner"), "block", "after"), "warc-longer")
    if longer.isEmpty():
        return result
    # records with a cut inside: the rows that they and the rejected candidates after them lie in, put together again
    last = marked.where("kept").groupBy("file", "range").agg(F.max("offset").alias("last"))
    carried = ranges.join(last, ["file", "range"], "left").select("file", "range", F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    parts = marked.join(carried, ["file", "range"]).select("file", "range", "number", F.when(F.col("owner") >= 0, F.col("owner")).otherwise(F.col("carried")).alias("owner")).distinct().join(longer, ["file", "owner"])
    numbered = [("file", pa.string()), ("range", pa.int64()), ("number", pa.int64()), ("relative", pa.int64()), ("value", pa.binary())]
    lines = _ranges(spark, path).mapInArrow(_lean(lambda batches: _batches(((f, r, k, at, row) for f, r, _, k, at, row in _located(batches)), numbered)), _sql(numbered))
    pieces = lines.join(parts, ["file", "range", "number"]).join(ranges, ["file", "range"]).select("file", "owner", "block", "after", (F.col("relative") + F.col("base")).alias("start"), "value")
    pieces = pieces.repartition(partitions(spark), "file", "owner").sortWithinPartitions("file", "owner", "start")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def record_of(held: list[dict]) -> tuple:
            first = held[0]
            data = (_END + MAGIC).join(x["value"] for x in held)
            if first["owner"] < first["start"]:
                data, start = MAGIC + data, first["start"] - len(MAGIC)
            else:
                start = first["start"]
            head, payload = _parsed(data[first["owner"] - start : first["block"] - len(_END) - start], data[first["block"] - start : first["after"] - len(_END) - start])
            return (*head, *derive(payload), first["file"], first["owner"])

        def rows() -> Iterator[tuple]:
            now, held = None, []
            for batch in batches:
                for x in batch.to_pylist():
                    if now != (x["file"], x["owner"]):
                        if held:
                            yield record_of(held)
                        now, held = (x["file"], x["owner"]), []
                    held.append(x)
            if held:
                yield record_of(held)

        yield from _batches(rows(), whole)

    whole = [*own_columns, ("file", pa.string()), ("offset", pa.int64())]
    return result.unionByName(pieces.mapInArrow(_lean(assemble), _sql(whole)))


def _reached(chain: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file, offset) of the candidates at which chains from the files' starts enter a range, by pointer jumping."""
    entered = chain.where("exit > 0").select("file", F.col("exit").alias("offset")).distinct()
    doors = chain.select("file", "offset", "exit").join(entered, ["file", "offset"], "left_semi").union(chain.where("offset = 0").select("file", "offset", "exit"))
    jump = stored(doors.distinct(), "warc-doors")
    doors, reached = jump.select("file", "offset"), jump.where("offset = 0").select("file", "offset")
    most = ranges.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    for _ in range(int(most - 1).bit_length()):
        there = jump.join(reached, ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        reached = stored(reached.union(there.join(doors, ["file", "offset"], "left_semi")).distinct(), "warc-reached")
        further = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("far"))
        jump = stored(jump.join(further, ["file", "exit"]).select("file", "offset", F.col("far").alias("exit")), "warc-jumps")
    return reached


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back.

    Gives page_id, payload_bytes, payload_digest (taken from the payload read, for revisits
    from their own header), record_type, refers_to and url. A revisit's payload_bytes is
    that of the response it refers to, whose digest must be the same.
    """
    spark = pages.sparkSession
    measured = [("own", pa.string()), ("size", pa.int64())]
    read = read_archives(spark, write_archives(pages, scratch(spark, "warc")), measured, lambda p: (None, None) if p is None else (digest(p), len(p)))
    ident = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    rows = stored(read.select(ident("record_id").alias("page_id"), F.coalesce("own", "payload_digest").alias("payload_digest"), "record_type", ident("refers_to").alias("refers_to"), "url", "size"), "warc-records")
    sizes = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("size").alias("full"))
    both = rows.where("record_type = 'revisit'").join(sizes, ["refers_to", "payload_digest"], "left").select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url")
    return rows.where("record_type = 'response'").select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url").unionByName(both)
