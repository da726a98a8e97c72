"""WARC: writing pages as records, and reading split files by verifying the chain of record boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.llm.common import drop_written, shared_path, written

SPLIT_BYTES = 16 << 20
#: Bytes that are read beyond a split for the header of its last record; a longer header is read on to its end.
HEADER_BYTES = 64 << 10
YIELD_BYTES = 4 << 20
MAGIC = b"WARC/1."
_RECORDS = "page_id string, uri string, is_null boolean, payload binary"


def _line(name: str, value: Column) -> Column:
    """A header field, none for a null; where line ends would break the header, they and % are escaped, and a field of
    its own says so."""
    escaped = F.replace(F.replace(F.replace(value, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    broken = F.contains(value, F.lit("\r")) | F.contains(value, F.lit("\n"))
    field = F.when(broken, F.concat(escaped, F.lit(f"\r\nX-Escaped: {name}"))).otherwise(value)
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), field, F.lit("\r\n")))


def _unescaped(value: bytes) -> bytes:
    return value.replace(b"%0A", b"\n").replace(b"%0D", b"\r").replace(b"%25", b"%")


def write_warc(pages: DataFrame, path: str) -> None:
    """A file for each partition, through Spark's committer: no file of a lost or repeated task stays. A URL with
    carriage returns or line feeds is stored escaped and read back as it was."""
    html = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\n"),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        _line("WARC-Target-URI", F.col("url")),
        F.when(F.col("html").isNull(), F.lit("X-Payload: null\r\n")).otherwise(F.lit("")),
        F.lit("Content-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
    )
    pages.select(F.concat(head, html).alias("value")).write.text(path, lineSep="\r\n\r\n")


def open_file(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(inner)


def header_at(data: bytes, at: int) -> tuple[int, int, dict[bytes, bytes]] | None:
    """(start of the payload, its length, fields) of the record that seems to begin at data[at], or None."""
    if not data.startswith(MAGIC, at) or data[at + len(MAGIC) + 1 : at + len(MAGIC) + 3] != b"\r\n":
        return None
    fields = {}
    start = at + len(MAGIC) + 3
    while not data.startswith(b"\r\n", start):  # line by line, so that what is no header is left at its first line
        stop = data.find(b"\r\n", start)
        colon = data.find(b": ", start, stop) if stop >= 0 else -1
        if colon < 0:
            return None
        fields[data[start:colon].lower()] = data[colon + 2 : stop]
        start = stop + 2
    end = start - 2
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        return None
    return end + 4, int(length), fields


def unfinished(data: bytes, at: int) -> bool:
    """Whether data ends inside what may be a header that begins at data[at]."""
    start = data[at : at + len(MAGIC) + 3]
    if not start.startswith(MAGIC[: len(start)]):
        return False
    if len(start) < len(MAGIC) + 3:
        return True
    if not start.endswith(b"\r\n"):
        return False
    at += len(start)
    while (stop := data.find(b"\r\n", at)) >= 0:
        if stop == at or data.find(b": ", at, stop) < 0:
            return False  # the header's end, or no header
        at = stop + 2
    return True


def read_on(file: pa.NativeFile, data: bytes, base: int, length: int, places: list[int]) -> bytes:
    """data, the bytes of a file of that length from base on, longer until no header at one of the places in it is
    unfinished, or to the end of the file."""
    while base + len(data) < length and (places := [at for at in places if unfinished(data, at)]):
        file.seek(base + len(data))
        data += file.read(min(length - base - len(data), max(HEADER_BYTES, len(data))))
    return data


def magics(data: bytes, end: int) -> list[int]:
    """Offsets before end at which the magic stands."""
    found, at = [], data.find(MAGIC)
    while 0 <= at < end:
        found.append(at)
        at = data.find(MAGIC, at + 1)
    return found


def candidates_in(data: bytes, start: int, end: int) -> dict[int, int]:
    """Offset -> successor offset of everything that looks like a record beginning in [start, end); data begins at
    start and runs some way beyond end."""
    found = {}
    for at in magics(data, end - start):
        if head := header_at(data, at):
            found[start + at] = start + head[0] + head[1] + 4
    return found


def exits(successors: dict[int, int]) -> dict[int, int]:
    """Candidate -> first offset of its chain that is no candidate of this split."""
    out: dict[int, int] = {}
    for at in sorted(successors, reverse=True):
        out[at] = out.get(successors[at], successors[at])
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with open_file(row["path"]) as file:
                file.seek(row["start"])
                data = file.read(min(row["end"] + HEADER_BYTES, row["length"]) - row["start"])
                data = read_on(file, data, row["start"], row["length"], magics(data, row["end"] - row["start"]))
            out = exits(candidates_in(data, row["start"], row["end"]))
            if out:
                n = len(out)
                yield pa.record_batch([pa.array([row["path"]] * n), pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())], names=["path", "at", "next"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rows: list[tuple] = []
            held = 0
            with open_file(row["path"]) as file:
                at, base, data = row["at"], row["at"], b""
                while at < row["end"]:
                    if at - base + HEADER_BYTES > len(data):
                        file.seek(at)
                        base, data = at, file.read(max(0, min(row["end"] + HEADER_BYTES, row["length"]) - at))
                    data = read_on(file, data, base, row["length"], [at - base])
                    head = header_at(data, at - base)
                    if not head:
                        break  # the chain ends in something that is no record: the file is cut off or damaged
                    begin, length, fields = base + head[0], head[1], head[2]
                    payload = data[head[0] : head[0] + length]
                    if len(payload) < length:
                        file.seek(begin)
                        payload = file.read(length)
                        if len(payload) < length:
                            break
                    page = fields.get(b"warc-record-id")
                    uri = fields.get(b"warc-target-uri")
                    if uri and fields.get(b"x-escaped") == b"WARC-Target-URI":
                        uri = _unescaped(uri)
                    rows.append((page and page[10:-1].decode(errors="replace"), uri and uri.decode(errors="replace"), fields.get(b"x-payload") == b"null", payload))
                    held += length + 200
                    at = begin + length + 4
                    if held > YIELD_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.bool_(), pa.binary())
    return pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=["page_id", "uri", "is_null", "payload"])


def reachable(candidates: DataFrame) -> DataFrame:
    """(path, at) of the candidates on the chain from the start of their file, by pointer jumping: each round joins
    the jumps with themselves, which doubles their length, so that n splits of a file take about log2 n rounds.
    Every round is written to the shared folder."""
    jumps = candidates.select("path", "at", "next")
    reach = written(jumps.where("at = 0").select("path", "at"), "reach")
    count = reach.count()
    while True:
        more = reach.join(jumps, ["path", "at"]).select("path", F.col("next").alias("at"))
        more = more.join(candidates, ["path", "at"], "left_semi")
        new = written(reach.unionByName(more).distinct(), "reach")
        drop_written(reach)
        reach, before, count = new, count, new.count()
        if count == before:
            return reach
        hop = jumps.alias("a").join(jumps.alias("b"), (F.col("a.path") == F.col("b.path")) & (F.col("a.next") == F.col("b.at")))
        doubled = written(hop.select("a.path", "a.at", "b.next"), "jumps")
        if hasattr(jumps, "_tarnmill_path"):
            drop_written(jumps)
        jumps = doubled


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(page_id, uri, is_null, payload) of every record of uncompressed WARC files.

    Files are cut into splits wherever it falls. A task finds everything that looks like a record in its split,
    contracts the chains inside it and emits where they leave it; only what a chain from the file's start enters is
    kept, so a record pasted into a payload is rejected. The second pass reads each split from its one entry.
    A file that doesn't begin with a record gives nothing; a damaged one what its chain reaches. Empty files: none."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    total = files.agg(F.sum("length")).first()[0] or 0
    splits = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    splits = splits.withColumn("end", F.least(F.col("start") + split_bytes, F.col("length")))
    tasks = max(1, -(-total // split_bytes))
    found = written(splits.repartition(tasks, "path", "start").mapInArrow(_scan, "path string, at long, next long"), "candidates")
    # only what starts a file or is another's successor can lie on a chain
    heads = found.where("at = 0").unionByName(found.join(found.select("path", F.col("next").alias("at")).distinct(), ["path", "at"], "left_semi")).distinct()
    reach = reachable(written(heads, "heads"))
    entries = reach.withColumn("start", F.col("at") - F.col("at") % split_bytes).groupBy("path", "start").agg(F.min("at").alias("at"))
    entered = splits.join(entries, ["path", "start"]).select("path", "length", "end", "at")
    return entered.repartition(tasks, "path", "at").mapInArrow(_read, _RECORDS)


def round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(page_id, url, html) of every page, written as WARC files to the shared folder and read back by splits.

    Nulls in any column come back as nulls; empty and very long pages come back whole, whatever magic they hold;
    repeated rows come back as often as they occur. Empty table: empty result. Other columns are not read."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages.select("page_id", "url", "html"), path)
    kind = pages.schema["page_id"].dataType
    records = read_warc(spark, path, split_bytes)
    return records.select(F.col("page_id").cast(kind).alias("page_id"), F.col("uri").alias("url"), F.when(~F.col("is_null"), F.col("payload").cast("string")).alias("html"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = "SELECT page_id, url, html FROM pages"
