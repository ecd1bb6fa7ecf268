"""WARC archives: write, normalise monolithic gzip, index, read back.

A monolithic archive is one gzip stream over all its records, so nothing in it
can be reached without inflating what stands before. The normaliser inflates
such a stream once, front to back, writes every record as a gzip member of its
own and keeps their places in a sidecar index; the reader then fetches members
by offset, so one archive can be read by many tasks.

Archives live in the shared folder. A task writes under a name of its own and
only the manifest rows that Spark commits say which files count, so a task that
ran twice or died leaves at most an orphan that no later step looks at.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh_dir, open_fs, remove, staged, table

#: An archive is closed once it has inflated to this many bytes.
ROLL_BYTES = 64 << 20
#: A read task takes members of about this many compressed bytes.
READ_BYTES = 16 << 20
#: Payloads shorter than this are always stored, never revisited.
MIN_REVISIT = 1000
#: Groups of equal payloads up to this many are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000
#: Tasks of a stage at most; one takes as many archives or spans as that leaves it.
MOST_TASKS = 20_000
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "archive string, n_records bigint, n_bytes bigint"


# -- record format -----------------------------------------------------------


def record_id(page_id: int | None, digest: str, fallback: str = "") -> str:
    """The id of a page's record by its payload; ``fallback`` (its place in the archive) tells records apart that have no id or repeat a page."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{fallback}')}>"


def header_value(s: str | None) -> str:
    """Header fields end at a line break, so breaks in a value are percent-encoded."""
    return (s or "").replace("\r", "%0D").replace("\n", "%0A")


def build_record(page_id: int | None, url: str | None, payload: bytes, digest_hex: str, refers_to: int | None, fallback: str, named: bool = True) -> bytes:
    """A response record, or a revisit record without payload if ``refers_to`` is set.

    A revisit of one of several equal records (not ``named``) names the page it refers to, but no record.
    """
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest_hex, fallback)), ("WARC-Date", DATE),
        ("WARC-Target-URI", header_value(url)), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()),
    ]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *([("WARC-Refers-To", record_id(refers_to, digest_hex))] if named else []), ("Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Inflate gzip data of one member or several, chunk by chunk."""
    z, open_member = zlib.decompressobj(31), False
    for chunk in chunks:
        while chunk:
            open_member = True
            if out := z.decompress(chunk, 4 * CHUNK):
                yield out
            chunk = z.unconsumed_tail
            if z.eof:
                chunk, open_member = z.unused_data, False
                z = zlib.decompressobj(31)
    if open_member:
        if out := z.flush():
            yield out
        if not z.eof:
            raise ValueError("the gzip stream is cut off")


def records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, whole record) of each record of an inflated stream, one in memory at a time."""
    buf = bytearray()

    def more() -> bool:
        part = next(stream, None)
        if part is None:
            return False
        buf.extend(part)
        return True

    while True:
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                if buf.strip():
                    raise ValueError("a record's header is cut off")
                return
        header = parse_header(bytes(buf[:end]))
        size = end + 4 + int(header["content-length"]) + 4
        while len(buf) < size:
            if not more():
                raise ValueError("a record's block is cut off")
        yield header, bytes(buf[:size])
        del buf[:size]


def gz_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


# -- operators ---------------------------------------------------------------


def plan_records(df: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """What to write for each row: page_id, url, payload, digest, refers_to, and whether the row (again) and
    the one it refers to (top_again) are one of several with their id and payload.

    Of rows with equal payloads of ``min_revisit`` bytes or more, those below
    the largest id refer to it. Null payloads are empty. Rows without an id are
    responses and never referred to; rows that share the largest id are all
    responses. Only digests and ids are shuffled, combined map-side, unless
    more than ``BROADCAST_GROUPS`` payloads repeat.
    """
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = df.select(F.col(id).cast("bigint").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= min_revisit
    groups = rows.where(large).groupBy(F.col("digest").alias("g")).agg(F.max("page_id").alias("top"), F.count("page_id").alias("n")).where("n > 1").drop("n")
    groups = staged(groups, "warc-groups")
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    rows = rows.join(groups, (F.col("g") == F.col("digest")) & large, "left")
    rows = rows.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") < F.col("top"), F.col("top")).alias("refers_to"))
    twice = staged(rows.where("page_id is not null").groupBy("page_id", "digest").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "warc-twice")
    if twice.isEmpty():
        return rows.withColumns({"again": F.lit(False), "top_again": F.lit(False)})
    if twice.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        twice = F.broadcast(twice)
    rows = rows.join(twice.withColumn("again", F.lit(True)), ["page_id", "digest"], "left")
    rows = rows.join(twice.select(F.col("page_id").alias("refers_to"), "digest", F.lit(True).alias("top_again")), ["refers_to", "digest"], "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("again", "top_again")})


def write_monolithic(planned: DataFrame, folder: str, roll: int = ROLL_BYTES) -> DataFrame:
    """Write ``plan_records`` rows as whole-stream gzip archives into ``folder``.

    Returns the staged manifest; a partition without rows writes nothing.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, tag, n, out, made = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, None, []
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)

        def close() -> None:
            out.write(z.flush())
            out.close()
            made.append((uri, count, size))

        for batch in batches:
            for page_id, url, payload, digest, refers_to, again, top_again in zip(*(batch[c] for c in ("page_id", "url", "payload", "digest", "refers_to", "again", "top_again"))):
                if out is None:
                    name = f"mono-{part:05d}-{len(made):04d}-{tag}.warc.gz"
                    uri, out, z, count, size = f"{folder}/{name}", fs.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                page, target = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                data = build_record(page, url, bytes(payload), digest, target, f"{part}:{n}" if again or page is None else "", not top_again)
                out.write(z.compress(data))
                n, count, size = n + 1, count + 1, size + len(data)
                if size >= roll:
                    close()
                    out = None
        if out is not None:
            close()
        yield pd.DataFrame(made, columns=["archive", "n_records", "n_bytes"])

    # nullable integers reach pandas as floats: ids travel as decimals of their own
    ids = planned.select(F.col("page_id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string"), "again", "top_again")
    return staged(ids.mapInPandas(write, MANIFEST), "warc-mono")


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of ``manifest`` with a member per record and a sidecar
    index (``.idx``: a JSON line per record). Returns archive, index and counts."""

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source in batch.archive:
                fs, path = open_fs(source)
                to, base = open_fs(folder)
                to.create_dir(base, recursive=True)
                name, at, n = f"norm-{uuid.uuid4().hex}.warc.gz", 0, 0
                with fs.open_input_stream(path, compression=None) as src, to.open_output_stream(f"{base}/{name}", compression=None) as dst, to.open_output_stream(f"{base}/{name}.idx", compression=None) as idx:
                    for header, data in records(inflated(iter(lambda: src.read(CHUNK), b""))):
                        member = gz_member(data)
                        dst.write(member)
                        idx.write((json.dumps({"offset": at, "length": len(member), "type": header["warc-type"], "id": header["warc-record-id"], "uri": header.get("warc-target-uri", "")}) + "\n").encode())
                        at, n = at + len(member), n + 1
                yield pd.DataFrame([(f"{folder}/{name}", n, at)], columns=["archive", "n_records", "n_bytes"])

    return staged(dealt(manifest).mapInPandas(rewrite, MANIFEST), "warc-norm")


def dealt(rows: DataFrame) -> DataFrame:
    """A task for each row, up to ``MOST_TASKS``."""
    return rows.repartition(min(max(1, rows.count()), MOST_TASKS))


def read_archives(manifest: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """Records of normalised archives, through their sidecar indexes.

    Columns: record_id, record_type, page_id, url, refers_to, digest_b32,
    http_length (of the full payload), payload (null for revisits).
    """

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive in batch.archive:
                fs, path = open_fs(archive + ".idx")
                with fs.open_input_stream(path, compression=None) as f:
                    places = [(x["offset"], x["length"]) for x in map(json.loads, f.read().splitlines())]
                rows, first, lengths = [], 0, []
                for at, length in places:
                    if not lengths:
                        first = at
                    lengths.append(length)
                    if at + length - first >= read_bytes:
                        rows.append((archive, first, lengths))
                        lengths = []
                if lengths:
                    rows.append((archive, first, lengths))
                yield pd.DataFrame(rows, columns=["archive", "first", "lengths"])

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, first, lengths in zip(batch.archive, batch["first"], batch.lengths):
                fs, path = open_fs(archive)
                rows, held, at = [], 0, int(first)
                with fs.open_input_file(path) as f:
                    for length in map(int, lengths):
                        data = zlib.decompress(f.read_at(length, at), 31)
                        at += length
                        header, whole = next(records(iter([data])))
                        block = whole[len(whole) - 4 - int(header["content-length"]) : -4]
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                        kind = header["warc-type"]
                        rows.append((header["warc-record-id"], kind, header.get("page-id"), header.get("warc-target-uri"), header.get("refers-to-page-id"), header["warc-payload-digest"], str(size), payload if kind == "response" else None))
                        held += len(payload)
                        if held >= 8 * CHUNK:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    names = ["record_id", "record_type", "page_id", "url", "refers_to", "digest_b32", "http_length", "payload"]
    spans = staged(dealt(manifest).mapInPandas(ranges, "archive string, first bigint, lengths array<bigint>"), "warc-spans")
    out = dealt(spans).mapInPandas(fetch, ", ".join(f"{c} {'binary' if c == 'payload' else 'string'}" for c in names))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("page_id", "refers_to", "http_length")})


def archive_pages(df: DataFrame, folder: str | None = None, id: str = "page_id", url: str = "url", payload: str = "html", keep_monolithic: bool = False) -> DataFrame:
    """Write, normalise and index the rows of ``df``; returns the manifest of the
    normalised archives. An empty table has an empty manifest. Without ``folder``
    they lie in this application's part of the shared folder and go with it."""
    folder = folder or fresh_dir(df.sparkSession, "warc")
    mono = write_monolithic(plan_records(df, id, url, payload), f"{folder}/monolithic")
    out = normalise(mono, f"{folder}/normalised")
    if not keep_monolithic:
        remove(df.sparkSession, f"{folder}/monolithic")
    return out


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` through archives and back; payloads are digested
    again from what was read, a revisit's digest is its record's."""
    back = read_archives(archive_pages(table(spark, sf_dir, "pages")))
    return back.select(
        "page_id", F.coalesce(F.octet_length("payload").cast("bigint"), F.col("http_length")).alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), base32_hex("digest_b32")).alias("payload_digest"), "record_type", "refers_to",
    )


def base32_hex(c: str):
    """``sha1:<base32>`` to bare lower-case hex: five bits a letter, eight letters to ten hex digits."""
    letters = F.substring(c, 6, 32)
    value = lambda i: F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.substring(letters, i, 1)) - 1
    parts = []
    for g in range(4):
        bits = F.lit(0).cast("bigint")
        for i in range(8):
            bits = bits * 32 + value(8 * g + i + 1)
        parts.append(F.lpad(F.lower(F.hex(bits)), 10, "0"))
    return F.concat(*parts)


OP10_SQL = """
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < top THEN top END AS refers_to
FROM (SELECT page_id, h, CASE WHEN octet_length(encode(h)) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS top
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""
