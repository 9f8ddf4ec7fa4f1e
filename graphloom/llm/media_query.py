"""op4: every text of documents as a TIFF file, read back page by page and digested.

Defined results: a null text is an empty one, whose payload is 64 zero bytes; repeated rows are stored
and digested each; a text of any length becomes as many pages as it needs, read one at a time; ids keep
their type; an empty table gives an empty result; further columns are not returned.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.store import table
from graphloom.llm.tiff import store_column, tiff_pages

RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int, error string"
NAMES = ["doc_id", *(c.split()[0] for c in RESULT.split(", "))]


class _Digest:
    """What the pages of one file add up to."""

    def __init__(self, doc_id: object, n_bytes: int, media_bytes: int, media_sha256: str):
        self.head = (doc_id, n_bytes)
        self.media = (media_bytes, media_sha256)
        self.sha, self.size, self.tail, self.pages, self.error, self.kind = hashlib.sha256(), 0, b"", 0, None, ""
        self.bins = np.zeros(16, np.int64)
        self.total = self.edges = 0

    def add(self, compression: str | None, predictor: int | None, tiled: bool | None, height: int | None, width: int | None, samples: bytes | None, error: str | None) -> None:
        if samples is None:
            self.error = error
            return
        self.sha.update(samples)
        self.size += len(samples)
        self.tail = (self.tail + samples[-64:])[-64:]
        self.pages += 1
        self.kind = f"{compression}/{predictor}/{'tiles' if tiled else 'strips'}/{width}"
        image = np.frombuffer(samples, np.uint8).reshape(height, -1)
        self.bins += np.bincount(image.ravel() >> 4, minlength=16)
        self.total += int(image.sum(dtype=np.int64))
        self.edges += int(np.count_nonzero(image[:, 1:] != image[:, :-1]))

    def row(self) -> tuple:
        shares = ".".join(str(int(x)) for x in (self.bins * 1000) // max(1, self.size))
        feature = f"{self.kind};pages={self.pages};mean={self.total / max(1, self.size):.4f};edges={self.edges};bins={shares}"
        return (*self.head, self.size, self.sha.hexdigest(), zlib.crc32(self.tail), *self.media, feature, self.pages, self.error)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of a file stand together and in order within a partition; page 0, or no page, begins a file."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]
    own = pa.int64()
    held: _Digest | None = None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate([own, *kinds])], names=NAMES)

    for part in batches:
        done, own = [], part.column(0).type
        for doc_id, n_bytes, media_bytes, media_sha, page, *rest in zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True):
            if page in (0, None):
                if page is None and held is not None and held.pages and held.head == (doc_id, n_bytes) and held.media[1] == media_sha and held.error is None:
                    held.error = rest[-1]
                    continue
                if held is not None:
                    done.append(held.row())
                held = _Digest(doc_id, n_bytes, media_bytes, media_sha)
            held.add(*rest)
        yield batch(done)
    if held is not None:
        yield batch([held.row()])


def media_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload and media digests, feature) per row of docs; the payload's are of the bytes read back."""
    stored = store_column(docs).withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    pages = tiff_pages(stored, "media", ("doc_id", "n_bytes", "media_bytes", "media_sha256"))
    slim = pages.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "compression", "predictor", "tiled", "height", "width", "samples", "error")
    return slim.mapInArrow(_fold, T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(RESULT)]))


def op4_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
