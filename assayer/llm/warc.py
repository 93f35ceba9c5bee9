"""WARC archives: records of captures written through Spark's text writer, read back, and assembled.

A capture has a ``response`` (or a ``revisit`` of an earlier equal payload), a ``request`` and a
``metadata`` record; the latter two name the first in ``WARC-Concurrent-To``.  Archives are gzip
files, which Spark reads whole and in order, one record at a time.

Defined results: a null payload is empty; captures with a null key are captures like others; of
captures with equal keys each is a transaction of its own; an empty table gives no records; a
payload may hold any bytes, lines that look like records included; a record without
``WARC-Concurrent-To`` that no other names is a capture if it is a response, revisit or resource
and is left out of assembly otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.common import prepare
from assayer.session import delete_table, materialize, new_table_path

MIN_REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
ANCHORS = ("response", "revisit", "resource")
MARK = "WARC/1."

RECORD = (
    "record_id string, record_type string, concurrent_to array<string>, target_uri string, "
    "date string, refers_to string, payload_digest string, digest_ok boolean, "
    "payload_bytes bigint, fields string, payload binary"
)


def uuid_of(*parts: Column) -> Column:
    """A record id that depends on its parts alone."""
    h = F.md5(F.concat_ws("/", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(
        F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cuts)), F.lit(">")
    )


def plan_revisits(captures: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Add ``payload_digest``, ``nth`` (among equal keys and payloads) and ``refers_to`` (a key).

    Of captures with equal payloads of at least ``min_bytes``, that with the largest key is kept
    as a response and the others refer to it.  Needs ``key`` bigint and ``payload`` binary.  Only
    digests meet by payload; payloads move once, by key.
    """
    digest = F.sha1("payload")
    narrow = captures.filter(F.octet_length("payload") >= min_bytes).select(
        "key", digest.alias("payload_digest")
    )
    groups = narrow.groupBy("payload_digest", "key").agg(F.count("*").alias("times"))
    largest = groups.groupBy("payload_digest").agg(
        F.max("key").alias("largest"), F.count("*").alias("keys")
    )
    largest = largest.filter(F.col("keys") > 1)
    revisits = groups.join(largest, "payload_digest").filter(
        ~F.col("key").eqNullSafe(F.col("largest"))
    )
    revisits = revisits.select(
        _match("key", "payload_digest").alias("match"), F.col("largest").alias("refers_to")
    )
    wide = captures.withColumn("payload_digest", digest)
    wide = wide.withColumn("match", _match("key", "payload_digest"))
    joined = wide.join(revisits.hint("merge"), "match", "left")
    nth = F.row_number().over(Window.partitionBy("match").orderBy(F.lit(1)))
    return joined.withColumn("nth", nth).drop("match")


def _match(key: str, digest: str) -> Column:
    return F.concat_ws("/", F.coalesce(F.col(key).cast("string"), F.lit("-")), F.col(digest))


def _record(kind: Column, record_id: Column, extra: list[Column], mime: Column, block: Column) -> Column:
    """One record as text; the writer's line end closes it."""
    lines = [F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [*extra, F.concat(F.lit("Content-Type: "), mime)]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    head = F.concat_ws("\r\n", F.lit("WARC/1.0"), *lines)
    return F.concat(head, F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def write_warc(planned: DataFrame, path: str, date: str = DATE) -> None:
    """Write the captures of :func:`plan_revisits` (with ``target_uri``) as gzip archives at ``path``.

    A capture's records stand one after another.  A payload is cast to text for the writer, which
    passes its bytes on as they are.
    """
    key, digest = F.col("key"), F.col("payload_digest")
    # a revisit names the first of the responses with the largest key
    own = uuid_of(F.lit("capture"), key, digest, F.col("nth"))
    other = uuid_of(F.lit("capture"), F.col("refers_to"), digest, F.lit(1))
    # without line ends, which would start another field
    uri = F.regexp_replace(F.coalesce(F.col("target_uri"), F.lit("")), "[\r\n]", " ")
    dated = F.lit(f"WARC-Date: {date}")
    target = F.concat(F.lit("WARC-Target-URI: "), uri)
    sha = F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest)
    http = F.lit("application/http; msgtype=response")
    payload = F.col("payload").cast("string")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"),
    )
    response = _record(F.lit("response"), own, [dated, target, sha], http, F.concat(head, payload))
    refers = F.concat(F.lit("WARC-Refers-To: "), other)
    profile = F.lit(
        "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
    )
    revisit = _record(F.lit("revisit"), own, [dated, target, sha, refers, profile], http, head)
    belongs = F.concat(F.lit("WARC-Concurrent-To: "), own)
    asked = F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\n\r\n"))
    request = _record(
        F.lit("request"), uuid_of(F.lit("request"), key, digest, F.col("nth")),
        [dated, target, belongs], F.lit("application/http; msgtype=request"), asked,
    )
    known = F.concat(F.lit("captureKey: "), F.coalesce(key.cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record(
        F.lit("metadata"), uuid_of(F.lit("metadata"), key, digest, F.col("nth")),
        [dated, target, belongs], F.lit("application/warc-fields"), known,
    )
    first = F.when(F.col("refers_to").isNull(), response).otherwise(revisit)
    records = planned.select(F.explode(F.array(request, first, metadata)).alias("value"))
    records.write.option("compression", "gzip").option("lineSep", "\n").text(path)


def _fields(head: bytes) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out.setdefault(name.strip().lower().decode("latin-1"), []).append(
            value.strip().decode("utf-8", "replace")
        )
    return out


def _parse(head: bytes, block: bytes, with_payload: bool) -> tuple:
    import hashlib

    fields = _fields(head)
    one = lambda name: (fields.get(name) or [None])[0]
    kind, mime = one("warc-type"), one("content-type") or ""
    declared = one("warc-payload-digest")
    declared = declared.partition(":")[2] if declared and declared.startswith("sha1:") else None
    text, payload = None, block
    if mime.startswith("application/http"):
        _, _, payload = block.partition(b"\r\n\r\n")
    elif mime.startswith("application/warc-fields"):
        text = block.decode("utf-8", "replace")
    size, digest, ok = len(payload), declared, None
    if kind == "revisit":
        size = payload = None
    elif kind in ANCHORS:
        digest = hashlib.sha1(payload).hexdigest()
        ok = declared is None or declared == digest
    return (
        one("warc-record-id"), kind, fields.get("warc-concurrent-to") or [], one("warc-target-uri"),
        one("warc-date"), one("warc-refers-to"), digest, ok, size, text,
        payload if with_payload else None,
    )


def _records(pieces: Iterator[bytes], with_payload: bool) -> Iterator[tuple]:
    """Records from the pieces between marks.

    A mark begins a record at the start of a line.  One inside a line of a header, such as a url,
    belongs to that header, unless what follows names a record anew, as after a header cut off; a
    piece too short is one whose block has a mark.
    """
    mark = MARK.encode()
    held: list[bytes] = []
    missing = 0
    for piece in pieces:
        if missing > 0:
            held += [mark, piece]
            missing -= len(mark) + len(piece)
        else:
            held = [*held, mark, piece] if held and not held[-1].endswith(b"\n") else [piece]
            if b"\r\n\r\n" not in piece:
                continue
            head, _, rest = b"".join(held).partition(b"\r\n\r\n")
            if len(_fields(head).get("warc-record-id", [])) > 1:
                held = [piece]
                head, _, rest = piece.partition(b"\r\n\r\n")
            length = _fields(head).get("content-length")
            if not length or not length[0].isdigit():
                held = []
                continue
            missing = int(length[0]) - len(rest)
        if missing <= 0:
            head, _, rest = b"".join(held).partition(b"\r\n\r\n")
            yield _parse(head, rest[: int(_fields(head)["content-length"][0])], with_payload)
            held, missing = [], 0


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the gzip archives at ``path``: the columns of ``RECORD``.

    Bytes that belong to no record, such as a record cut off at the end of a file, are passed over.
    Without payloads only their length and digest leave the reader.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("record_id", pa.string()), ("record_type", pa.string()),
            ("concurrent_to", pa.list_(pa.string())), ("target_uri", pa.string()),
            ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
            ("digest_ok", pa.bool_()), ("payload_bytes", pa.int64()), ("fields", pa.string()),
            ("payload", pa.binary()),
        ])

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

        # one file after another: a partition may hold several, told apart by their name
        rows: list[tuple] = []
        size = 0

        def pieces() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                names = batch.column(1)
                for i, value in enumerate(batch.column(0)):
                    yield names[i].as_py(), value.as_py() or b""

        from itertools import groupby

        for _, group in groupby(pieces(), key=lambda item: item[0]):
            for row in _records((piece for _, piece in group), with_payload):
                rows.append(row)
                size += 500 + len(row[-1] or b"")
                if size > (4 << 20):
                    yield flush(rows)
                    rows, size = [], 0
        if rows:
            yield flush(rows)

    pieces = spark.read.option("lineSep", MARK).text(path)
    pieces = pieces.select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_name").alias("file")
    )
    return pieces.mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, response, requests, metadata``.

    A record belongs to the response, revisit or resource that it names in ``WARC-Concurrent-To``
    or that names it.  Ids are joined first; a capture's requests and metadata are lists ordered
    by record id, as long as that capture's own records.
    """
    anchors = records.filter(F.col("record_type").isin(*ANCHORS))
    others = records.filter(~F.col("record_type").isin(*ANCHORS))
    ids = anchors.select(F.col("record_id").alias("capture_id"))
    named = others.select("record_id", F.explode("concurrent_to").alias("capture_id"))
    naming = anchors.select(
        F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture_id")
    )
    links = named.join(ids, "capture_id", "left_semi").select("record_id", "capture_id")
    links = links.unionByName(naming).distinct()
    placed = others.join(links, "record_id")

    def gathered(kind: str) -> DataFrame:
        fields = ["record_id", "target_uri", "date", "payload_bytes", "fields", "payload"]
        mine = placed.filter(F.col("record_type") == kind)
        return mine.groupBy("capture_id").agg(
            F.array_sort(F.collect_list(F.struct(*fields))).alias(kind)
        )

    response = F.struct(*(f"a.{c}" for c in records.columns)).alias("response")
    capture = anchors.alias("a").join(
        gathered("request").alias("q"), F.col("a.record_id") == F.col("q.capture_id"), "left"
    ).join(gathered("metadata").alias("m"), F.col("a.record_id") == F.col("m.capture_id"), "left")
    return capture.select(
        F.col("a.record_id").alias("capture_id"), response,
        F.col("q.request").alias("requests"), F.col("m.metadata").alias("metadata"),
    )


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Give revisits the length of the payload they refer to, by the response's record id.

    Only revisits are joined: captures without a reference would all meet under one null.
    """
    refers = F.col("response.refers_to")
    full = captures.filter(refers.isNull()).withColumns({
        "payload_bytes": F.col("response.payload_bytes"), "original_metadata": F.col("metadata"),
    })
    sizes = full.select(
        F.col("capture_id").alias("__id"), F.col("payload_bytes").alias("__bytes"),
        F.col("metadata").alias("__metadata"),
    )
    revisits = captures.filter(refers.isNotNull()).join(sizes, refers == F.col("__id"), "left")
    revisits = revisits.select(
        *captures.columns, F.coalesce("response.payload_bytes", "__bytes").alias("payload_bytes"),
        F.col("__metadata").alias("original_metadata"),
    )
    none = F.lit(None).cast(full.schema["original_metadata"].dataType)
    return full.withColumn("original_metadata", none).unionByName(revisits)


def field(metadata: Column, name: str) -> Column:
    """A value of the first metadata record."""
    return F.regexp_extract(metadata[0]["fields"], rf"(?m)^{name}: ([^\r\n]*)", 1)


def archive_and_read(
    captures: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, with_payload: bool = True
) -> DataFrame:
    """Write ``key, target_uri, payload`` rows as archives in the shared folder and read them back.

    The nested rows hold the payloads, or only their length and digest.  The archives go once they are
    read; ``write_warc`` writes ones that stay.
    """
    spark = prepare(captures.sparkSession)
    path = new_table_path(spark, "warc")
    write_warc(plan_revisits(captures, min_bytes), path)
    records = materialize(read_warc(spark, path, with_payload), "warc-records", compression="zstd")
    delete_table(spark, path)
    return assemble(records)
