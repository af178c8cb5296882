"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of a suitable vocabulary crosses from a character into a white-space marker, and none holds a
line feed next to another character. So a text falls into chunks (a run of markers and what follows it, a
run of line feeds, or what follows those) whose segmentations never depend on one another: each
distinct chunk is segmented once per table, and the ids are joined back by position. There is one table for each
Python worker process, which the tasks it runs share; so a chunk is segmented once per process, not once in all. The vocabulary is
inspected for these two properties; where one fails, coarser chunks are used, in the end whole texts.

Cases: a null text counts as empty; an empty text has the end id only; chunks longer than
`LONG_CHUNK` are segmented but not kept; a table that reaches `TABLE_LIMIT` chunks starts anew, so
memory is bounded whatever the text. The result never depends on what the table holds.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import slices

MARK = "▁"
LONG_CHUNK = 64
TABLE_LIMIT = 300_000
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class PieceTable:
    """Encodes whole texts exactly as the library does, one distinct chunk at a time."""

    def __init__(self, model_file: str, limit: int = TABLE_LIMIT) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.limit = limit
        self.known: dict[str, list[int]] = {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        plain = self.model.encode("\n")
        #: ids of a line feed after the dummy prefix; what follows a line feed is segmented behind it.
        self.lead = len(plain)
        cuts_marks = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and self._keeps_spaces()
        cuts_lines = cuts_marks and not any("\n" in p for p in pieces) and self.lead > 1
        self.pattern = re.compile(r" +[^ \n]*|[^ \n]+|\n" if cuts_lines else r" +[^ ]*|[^ ]+") if cuts_marks else None

    def _keeps_spaces(self) -> bool:
        """Whether the library adds a space in front and otherwise leaves the text as it is."""
        probe = "  a   ﬁ "
        return self.model.decode(self.model.encode(probe)) == probe and self.model.encode(" ") == self.model.encode(MARK)

    def _segment(self, chunks: list[str]) -> list[bytes]:
        """The library adds one space in front of whatever it gets: each chunk is given behind a line
        feed, and the ids of both are taken off."""
        found = self.model.encode(["\n" + c for c in chunks], num_threads=1)
        return [array("i", ids[self.lead :]).tobytes() for ids in found]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, without an end id."""
        if self.pattern is None:
            return self.model.encode(texts, num_threads=1)
        find, known = self.pattern.findall, self.known
        cut = [find(" " + text.replace(MARK, " ")) if text else [] for text in texts]
        fresh = list(set().union(*cut).difference(known))
        known.update(zip(fresh, self._segment(fresh), strict=True))
        out = [array("i", b"".join(map(known.__getitem__, chunks))).tolist() for chunks in cut]
        if len(known) > self.limit:
            known.clear()
        else:
            for chunk in fresh:
                if len(chunk) > LONG_CHUNK:
                    del known[chunk]
        return out


@lru_cache(maxsize=2)
def table_of(model_file: str) -> PieceTable:
    """The table of this worker process: tasks that follow one another share it."""
    return PieceTable(model_file)


def encode_documents(docs: DataFrame, model_file: str, extra: bool = False) -> DataFrame:
    """One row per document: the count and digest of its ids, end id last, and of the text decoded from
    them. With `extra`, the ids and the decoded text themselves as columns `ids` and `decoded`."""
    schema = SCHEMA + (", ids array<int>, decoded string" if extra else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model_file)
        end = table.model.eos_id()
        digits = [str(i) for i in range(table.model.vocab_size())].__getitem__
        for batch in slices(batches, limit=1 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            # Equal texts of a slice, as mixing repeats them, are encoded once.
            place: dict[str, int] = {}
            at = [place.setdefault(t, len(place)) for t in texts]
            encoded = table.encode(list(place))
            counts, digests, decoded = [], [], []
            for ids in encoded:
                ids.append(end)
                counts.append(len(ids))
                digests.append(hashlib.sha256(" ".join(map(digits, ids)).encode()).hexdigest())
                decoded.append(table.model.decode(ids))
            spread = lambda values: [values[i] for i in at]
            encoded, decoded_digests = spread(encoded), spread([hashlib.sha256(t.encode()).hexdigest() for t in decoded])
            decoded = spread(decoded)
            columns = [batch.column(0), pa.array(spread(counts), pa.int64()), pa.array(spread(digests)), pa.array(decoded_digests)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if extra:
                columns += [pa.array(encoded, pa.list_(pa.int32())), pa.array(decoded)]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, schema)
