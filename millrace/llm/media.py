"""Media columns: texts stored losslessly as baseline JPEG, and what is read back from the stored bytes.

The payload of a text is its UTF-8 bytes, filled with bytes 255 to a positive multiple of 576. Each byte is
the flat grey of one 8 x 8 block, 24 blocks to a row; the decoder's DC-only thumbnail is the payload again.

Cases: a null text counts as empty, whose payload is 576 bytes of 255; a payload of more than 24 x 8,184
bytes is a sequence of images; equal texts give equal rows; other columns of the input do not matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import jpeg
from millrace.llm.common import slices

UNIT = 576
SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width int, height int"


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The number of UTF-8 bytes of a text, and the filled payload."""
    data = (text or "").encode()
    return len(data), data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def feature_of(thumbnail: np.ndarray) -> str:
    """A difference hash: the thumbnail's means over 8 x 9 cells, and for each cell whether the next one
    in its row is brighter, as 16 hexadecimal digits behind the thumbnail's size."""
    high, wide = thumbnail.shape
    down = np.linspace(0, high, 9).astype(int)
    across = np.linspace(0, wide, 10).astype(int)
    sums = np.zeros((high + 1, wide + 1), np.int64)
    sums[1:, 1:] = thumbnail.astype(np.int64).cumsum(0).cumsum(1)
    cells = sums[down[1:]][:, across[1:]] - sums[down[:-1]][:, across[1:]] - sums[down[1:]][:, across[:-1]] + sums[down[:-1]][:, across[:-1]]
    area = np.maximum(np.outer(np.diff(down), np.diff(across)), 1)
    mean = cells * 1000 // area
    bits = (mean[:, 1:] > mean[:, :-1]).ravel()
    return f"{wide}x{high}:{int(''.join('01'[int(b)] for b in bits), 2):016x}"


def store(docs: DataFrame, extra: bool = False) -> DataFrame:
    """One row per document. With `extra`, the stored bytes themselves as column `media`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            sizes, payloads = zip(*(payload_of(t) for t in batch.column(1).to_pylist()), strict=True)
            stored = jpeg.write_images(list(payloads))
            rows = []
            for media, images in zip(stored, jpeg.thumbnails(stored), strict=True):
                thumbnail = images[0] if len(images) == 1 else np.vstack(images)
                back = thumbnail.tobytes()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(thumbnail), 8 * thumbnail.shape[1], 8 * thumbnail.shape[0]))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), types, strict=True)]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), *columns]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(stored, pa.binary())] * extra, names + ["media"] * extra)

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, SCHEMA + ", media binary" * extra)
