"""Media columns: interleaved documents whose media live in a table by digest.

``store`` writes payloads as 8-bit grey images (binary PGM, 64 samples a row)
into a media table keyed by the payload's SHA-256; ``features`` reads that table
back, unpacks the samples and describes them; ``interleave`` parses HTML into
ordered text and media-reference structs, resolves the references by a join on
the digest, and puts them back at their positions with their captions.

Payloads never meet in one task: they are written where they are read, and only
digests and descriptions are shuffled.  A digest that many documents share is
described once in a task and once more in the aggregate, by a partial
aggregation; the join has it once on the media side.

Cases: a null text is the empty payload (64 zero bytes); a very long one is one
payload; equal payloads have one digest and one description; a reference that no
media row has, or that is no digest but a path or an address, keeps its place and
its text with null details; a page that is null, empty or without text and media
has an empty sequence; the caption of a figure without media is a text; rows that
repeat a key each get their own sequence; an empty table gives no rows; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import cut, shared_dir, small_batches
from clausework.llm.html import sequence

WIDTH = 64
SCHEME = "sha256:"


def payload_of(text: str | None) -> bytes:
    """UTF-8, with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def padded(text: Column) -> Column:
    """The same as an expression."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    length = F.greatest(F.lit(WIDTH), (F.ceil(F.octet_length(raw) / WIDTH) * WIDTH).cast("int"))
    return F.rpad(raw, length, F.lit(bytearray(1)))


def pack(payload: bytes) -> bytes:
    """The payload as a binary PGM: header, then the samples as they are."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def unpack(media: bytes) -> bytes:
    """The samples of a binary PGM of 8 bits."""
    magic, size, most, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit PGM")
    return samples


def describe(samples: bytes) -> str:
    """Size, range, sum, number of levels and mean absolute step of the samples."""
    x = np.frombuffer(samples, np.uint8)
    levels = int(np.count_nonzero(np.bincount(x, minlength=256)))
    steps = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    return f"{WIDTH}x{len(x) // WIDTH} min={x.min()} max={x.max()} sum={x.sum(dtype=np.int64)} levels={levels} steps={steps}"


def store(docs: DataFrame, path: str) -> None:
    """Write the payload of each text (doc_id, text) into the media table at ``path``.

    A task writes a digest once; the digest, not the row, is the key.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            digests, stored = [], []
            for text in batch.column(0):
                payload = payload_of(text.as_py())
                key = hashlib.sha256(payload)
                if key.digest() not in seen:
                    seen.add(key.digest())
                    digests.append(key.hexdigest())
                    stored.append(pack(payload))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(stored, pa.binary())], ["digest", "media"])

    docs.select("text").mapInArrow(run, "digest string, media binary").write.option("compression", "zstd").parquet(path)


def features(media: DataFrame) -> DataFrame:
    """One row for each digest of a media table (digest, media), from the stored bytes."""
    small_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, stored in zip(batch.column(0), batch.column(1), strict=True):
                stored = stored.as_py()
                samples = unpack(stored)
                rows.append({
                    "digest": digest.as_py(),
                    "payload_bytes": len(samples),
                    "payload_sha256": hashlib.sha256(samples).hexdigest(),
                    "tail_crc32": zlib.crc32(samples[-WIDTH:]),
                    "media_bytes": len(stored),
                    "media_sha256": hashlib.sha256(stored).hexdigest(),
                    "feature": describe(samples),
                })
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    kind = pa.schema([
        ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ])
    read = media.select("digest", "media").mapInArrow(
        run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    values = [c for c in read.columns if c != "digest"]
    return read.groupBy("digest").agg(*(F.first(c).alias(c) for c in values))


PARTS = "array<struct<position:int,kind:string,text:string,reference:string,caption:string>>"


def parts(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """``key`` and the ordered parts of each page."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"position": i, **p} for i, p in enumerate(sequence(page.as_py()))] for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["key", "parts"])

    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("reference", pa.string()), ("caption", pa.string())]))
    return pages.select(F.col(key).cast("long").alias("key"), html).mapInArrow(run, f"key long, parts {PARTS}")


def digest_of(reference: Column) -> Column:
    """The digest that a reference names, null where it is a path or an address."""
    return F.when(reference.startswith(SCHEME), F.substr(reference, F.lit(len(SCHEME) + 1)))


def resolved(parts: DataFrame, described: DataFrame, key: str = "key") -> DataFrame:
    """One row for each media part: key, position, caption, digest and the media's columns."""
    refs = parts.select(key, F.explode("parts").alias("p")).where(F.col("p.kind") == "media").select(
        key, F.col("p.position").alias("position"), F.col("p.caption").alias("caption"), digest_of(F.col("p.reference")).alias("digest")
    )
    return refs.join(described, "digest", "left")


def interleave(pages: DataFrame, key: str, described: DataFrame, html: str = "html") -> DataFrame:
    """``key`` and its sequence for each row of ``pages``: position, kind, text, caption and, for media, reference, digest and feature.

    The parts are written once with a number for each row; only digests and
    descriptions are joined, then a page's few descriptions meet its parts.
    """
    numbered = cut(parts(pages, key, html).withColumn("row", F.monotonically_increasing_id()), "parts")
    media = resolved(numbered.select("row", "parts"), described.select("digest", "feature").dropDuplicates(["digest"]), "row")
    features = media.where("feature is not null").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("position", "feature"))).alias("features"))
    told = numbered.join(features, "row", "left")
    part = lambda p: F.struct(
        p["position"].alias("position"), p["kind"].alias("kind"), p["text"].alias("text"), p["caption"].alias("caption"), p["reference"].alias("reference"),
        digest_of(p["reference"]).alias("digest"), F.col("features")[p["position"]].alias("feature"),
    )
    return told.select("key", F.transform("parts", part).alias("sequence"))


def page_media(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """The interleaved sequence of each page (page_id, html) whose media are payloads of ``docs``' texts (doc_id, text).

    page_id, n_texts, n_media, n_resolved, sequence_sha256 (hex; kind, text or reference, caption and feature of each
    part, in order, each part ended by a line feed and its fields by a tab, null as nothing).
    """
    path = f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    store(docs, path)
    made = interleave(pages, "page_id", features(docs.sparkSession.read.parquet(path)))
    nothing = lambda c: F.coalesce(c, F.lit(""))
    line = lambda p: F.concat(p["kind"], F.lit("\t"), nothing(F.coalesce(p["text"], p["reference"])), F.lit("\t"), nothing(p["caption"]), F.lit("\t"), nothing(p["feature"]), F.lit("\t\n"))
    count = lambda test: F.size(F.filter("sequence", test)).cast("long")
    return made.select(
        F.col("key").alias("page_id"),
        count(lambda p: p["kind"] == "text").alias("n_texts"),
        count(lambda p: p["kind"] == "media").alias("n_media"),
        count(lambda p: p["feature"].isNotNull()).alias("n_resolved"),
        F.sha2(F.array_join(F.transform("sequence", line), ""), 256).alias("sequence_sha256"),
    )


def document_media(docs: DataFrame) -> DataFrame:
    """The media of documents whose texts are the payloads (doc_id, text).

    Each document becomes a page with one figure that refers to its payload by
    digest and carries the document's size as its caption; the page is parsed and
    its reference resolved like any other.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    store(docs, path)
    described = features(spark.read.parquet(path))
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    size = F.octet_length(raw)
    pages = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.concat(
            F.lit(f'<figure><img src="{SCHEME}'), F.sha2(padded(F.col("text")), 256), F.lit('"><figcaption>'), size.cast("string"), F.lit("</figcaption></figure>")
        ).alias("html"),
    )
    return resolved(parts(pages, "doc_id"), described).select(
        F.col("key").alias("doc_id"),
        F.col("caption").cast("long").alias("n_bytes"),
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        "media_bytes",
        "media_sha256",
        "feature",
    )
