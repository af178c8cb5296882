"""Near-duplicate groups by b-bit MinHash.

1. Every text gives a set of hashed word shingles, 128 minima under as many hash functions, 32 band keys of four minima
   each, and a signature of the four low bits of every minimum, packed into bit planes.
2. Texts with equal words are one node from here on. Nodes that share a band key with others are linked to the
   least node of that band if the signatures' estimate, corrected for chance collisions, allows it and
   the full sets confirm it. This is linear in the band keys, however large a band's group.
3. Links already found make components. A band whose nodes are not one component is looked at again, with a bound
   besides the estimate: how many shingles two sets can share at most, by the counts of their hashes in bins.
   In a band of few nodes, each node outside its leader's component meets the others. In a large one, nodes
   meet over the rarest shingles: each set's shingles are put in one order, those that at most `FEW` nodes of the family (nodes
   tied by large bands) have before the others, and sets of the similarity share one of the first fifth of both. Where
   that shingle is rare, the nodes meet there, which is linear. Where it is common, both sets
   are made of common shingles for the most part and share nothing else; such nodes are compared, tile by tile, by
   the counts of their common shingles and by the bound. One of two nodes is always outside the family's largest component. So any two nodes that share a band end up in one component, have been compared, or cannot
   reach the similarity.

Pairs are confirmed on full sets, hot leaders in parts: the members of a leader are dealt into parts of `PART_ROWS`
expected rows, and its set goes once to each part. Only texts that a filter of the wanted rows lets through are shuffled.

A pair at similarity 0.8 shares no band with probability (1 - 0.8 ** 4) ** 32, 5e-8, and is under the
estimate's bound of 0.6 more than five standard deviations from its mean.

Cases: a null or empty text has no shingles and links with nothing; a text with fewer words than a shingle
is one shingle; equal rows are one group; rows without an id are compared like others, their group's id is the least
one there is, null if there is none; nodes' ids are fixed by a written table, so lost executors do
not change them; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import scratch, slices, written
from millrace.llm.graph import connected_components
from millrace.llm.membership import key_filter, key_words, split_by_filter
from millrace.llm.textstats import WordHashes, words_of

HASHES, BANDS, BITS = 128, 32, 4
ROWS = HASHES // BANDS
#: Least estimate at which a pair goes on to be compared on its full sets.
LEAST_ESTIMATE = 0.6
PERCENT = 80
#: A band of more nodes is large; a shingle in more nodes of a family is common.
FEW = 32
#: Bins of the sketch that bounds how many shingles two sets can share.
BINS = 1024
#: Members of a leader that are confirmed in one group, by expectation.
PART_ROWS = 64
#: Nodes on one side of a tile: by expectation as many tiles as `TILES` to a side, within these bounds.
LEAST_TILE, MOST_TILE, TILES = 256, 8192, 16
_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_BAND_MIX = _RNG.integers(0, 1 << 62, (ROWS,), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALT = _RNG.integers(0, 1 << 63, (BANDS,), dtype=np.uint64)


class Shingler:
    """Sorted distinct 64-bit hashes of the runs of `size` words of a text."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.low, self.high = WordHashes(), _HighHashes()

    def shingles(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        h = self.low.of(words).astype(np.uint64) | (self.high.of(words).astype(np.uint64) << np.uint64(32))
        n = max(len(words) - self.size + 1, 1)
        out = h[:n].copy()
        for i in range(1, min(self.size, len(words))):
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out += h[i : n + i]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(29)
        return np.unique(out)


class _HighHashes(WordHashes):
    """A second 32-bit hash of words, independent of the first."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.blake2b(word, digest_size=4).digest(), "little")
        return value


def minima(shingles: np.ndarray, step: int = 1024) -> np.ndarray:
    h = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(h), step):
        np.minimum(least, (h[start : start + step, None] * _A + _B).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    mixed = (least.reshape(BANDS, ROWS).astype(np.uint64) * _BAND_MIX).sum(axis=1, dtype=np.uint64) + _BAND_SALT
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x94D049BB133111EB)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def bit_planes(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima: for each of the bits, two 64-bit words of one bit per hash function."""
    low = (least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    planes = [np.packbits((low >> np.uint32(b)).astype(np.uint8) & 1) for b in range(BITS)]
    return np.concatenate(planes).view(np.int64)


def estimate(a: str, b: str) -> str:
    """SQL for the similarity of two signatures: the share of equal low bits, less what chance gives."""
    words = 2 * BITS
    wrong = [" | ".join(f"({a}[{w}] ^ {b}[{w}])" for w in range(half, words, 2)) for half in (0, 1)]
    same = f"(1 - (bit_count({wrong[0]}) + bit_count({wrong[1]})) / {HASHES}D)"
    chance = 1 / (1 << BITS)
    return f"(({same} - {chance}D) / {1 - chance}D)"


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mark): the mark stands for the row's id and text, whether it has an id or not."""
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.withColumn("mark", F.xxhash64("doc_id", "text"))


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """One row per document: its mark, the digest of its words (null without words), the size of its set, the bit
    planes and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in slices(batches):
            keys, counts, planes, bands = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text, lower=True)
                shingles = shingler.shingles(words)
                counts.append(len(shingles))
                if len(shingles):
                    least = minima(shingles)
                    keys.append(hashlib.md5(b" ".join(words)).digest())
                    planes.append(bit_planes(least))
                    bands.append(band_keys(least))
                else:
                    keys.append(None)
                    planes.append(None)
                    bands.append(None)
            columns = [pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(planes, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "mark", "key", "n_shingles", "planes", "bands"])

    return marked(docs).mapInArrow(run, "doc_id bigint, mark bigint, key binary, n_shingles bigint, planes array<bigint>, bands array<bigint>")


def wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(mark, doc, text) of the rows that `wanted` names by mark and doc, each once. A mark that two rows share is told
    apart by the id; only rows that a small filter lets through are shuffled."""
    bitmap, bits = key_filter(wanted, "mark", wanted.count())
    near, _ = split_by_filter(marked(docs).withColumn("doc", F.coalesce("doc_id", F.lit(-1))), F.col("mark"), bitmap, bits)
    return near.groupBy("mark", "doc").agg(F.first("text").alias("text"))


def named_sets(texts: DataFrame, size: int) -> DataFrame:
    """(id, packed sorted hashes) of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in slices(batches):
            hashes = [shingler.shingles(words_of(t, lower=True)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.binary())], ["id", "hashes"])

    return texts.select("id", "text").mapInArrow(run, "id bigint, hashes binary")


def parts_of_pairs(pairs: DataFrame) -> DataFrame:
    """(id, a, part, b): the node whose set a part of leader `a` needs; without `b` it is the leader's own."""
    sized = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    members = pairs.join(sized, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    leaders = sized.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("b"))
    return members.unionByName(leaders)


def packed_sets(rows: DataFrame, size: int) -> DataFrame:
    """(a, part, b, hashes) of rows (id, a, part, b, text): a text that follows itself is cut once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, packed = Shingler(size), None, b""
        for batch in slices(batches):
            out = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if node != last:
                    last, packed = node, shingler.shingles(words_of(text, lower=True)).tobytes()
                out.append(packed)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(out, pa.binary())], ["a", "part", "b", "hashes"])

    return rows.select("id", "a", "part", "b", "text").mapInArrow(run, "a bigint, part int, b bigint, hashes binary")


def confirmed(parts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets meet the similarity, of rows (a, part, b, hashes). In each part the leader's own row
    comes first, and the members' pass by it one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            found_a, found_b = [], []
            for a, part, b, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                hashes = np.frombuffer(packed.as_buffer(), np.uint64)
                if b is None:
                    at, own = (a, part), hashes.copy()
                    continue
                if at != (a, part):
                    raise ValueError(f"the set of node {a} is missing: the documents changed while they were read")
                common = len(own) + len(hashes) - len(np.union1d(own, hashes))
                if 100 * common >= percent * (len(own) + len(hashes) - common):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    dealt = parts.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a bigint, b bigint")


def similar(n: str, m: str, percent: int) -> str:
    """SQL for whether two sets' sizes allow the similarity at all."""
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"


def band_pairs(rest: DataFrame, likely: str) -> DataFrame:
    """Pairs of a band across components, but for those with the leader: one of them is outside the leader's."""
    heads = rest.where("id = leader").select("band", F.col("root").alias("head"))
    columns = [c for c in rest.columns if c not in ("band", "leader", "size")]
    left = rest.join(heads, "band").where("root <> head").select("band", *(F.col(c).alias(f"{c}_a") for c in columns))
    right = rest.where("id <> leader").select(F.col("band").alias("band_b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    met = left.join(right, F.expr(f"band = band_b AND root_a <> root_b AND {likely}"))
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def bounded(sets: DataFrame) -> DataFrame:
    """(id, bits): which of `BINS` bins hold at least one, and at least two, of a set's hashes, and as the last
    word how many hashes are beyond the second of their bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for x in batch.column(1):
                count = np.bincount((np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(BINS)).astype(np.int64), minlength=BINS)
                levels = [np.packbits(count >= least).view(np.int64) for least in (1, 2)]
                words.append(np.concatenate([*levels, [np.maximum(count - 2, 0).sum()]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], ["id", "bits"])

    return sets.select("id", "hashes").mapInArrow(run, "id bigint, bits array<bigint>")


def bits_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The words of a column of sketches, a row for each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().view(np.uint64).reshape(-1, BINS // 64 * 2 + 1)


def within_reach(bits_a: np.ndarray, bits_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets can have the similarity. Two sets share in each bin no more than the lesser of their
    counts; the sum over the bins is taken from the bits, and bounded for what is beyond them."""
    most = np.bitwise_count(bits_a[..., :-1] & bits_b[..., :-1]).sum(axis=-1, dtype=np.int64)
    most += np.minimum(bits_a[..., -1], bits_b[..., -1]).astype(np.int64)
    return ((100 + percent) * most >= percent * (n_a + n_b)) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))


def reachable(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (batch.column(f"n_{x}").to_numpy() for x in "ab")
                keep = within_reach(bits_of(batch.column("bits_a")), bits_of(batch.column("bits_b")), n_a, n_b, percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    left, right = (sketches.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a bigint, b bigint")


def family_codes(family: int, shingles: np.ndarray) -> np.ndarray:
    """A 64-bit code for each shingle within a family."""
    h = shingles ^ np.uint64(family * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def common_bits(members: DataFrame) -> np.ndarray:
    """A bitmap of the codes that more than `FEW` nodes of a family have, of 4 MB at most. A rare code may be taken for
    a common one, by all nodes alike; that costs comparisons and no pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for family, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(family_codes(family, np.frombuffer(packed.as_buffer(), np.uint64)).view(np.int64))], ["code"])

    codes = members.select("family", "hashes").mapInArrow(run, "code bigint")
    common = written(codes.groupBy("code").agg(F.count("*").alias("spread")).where(f"spread > {FEW}").select("code"), "common")
    words, size = key_words(common, F.col("code"), common.count())
    bits, found = np.zeros(size // 64, np.uint64), words.toArrow()
    bits[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return bits


def rarest(members: DataFrame, bits: np.ndarray, percent: int) -> DataFrame:
    """(family, id, root, out, n, common, first): how many common shingles a node has, and the codes of the rare ones
    among the first of its order, in which rare ones come before common ones."""
    mask, columns = np.uint64(len(bits) * 64 - 1), ["family", "id", "root", "out", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, firsts = [], []
            for family, packed in zip(batch.column(0).to_pylist(), batch.column(5), strict=True):
                codes = family_codes(family, np.frombuffer(packed.as_buffer(), np.uint64))
                place = codes & mask
                common = (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
                counts.append(int(common.sum()))
                firsts.append(np.sort(codes[~common])[: len(codes) * (100 - percent) // 100 + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(counts, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))], [*columns, "common", "first"])

    return members.select(*columns, "hashes").mapInArrow(run, "family bigint, id bigint, root bigint, out boolean, n bigint, common bigint, first array<bigint>")


def large_band_pairs(large: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs across components of large bands that can reach the similarity at all; one of the two is outside the
    family's largest component."""
    family = connected_components(large.select(F.col("leader").alias("a"), F.col("id").alias("b"))).withColumnRenamed("root", "family")
    members = written(large.select("id", "root").distinct().join(family, "id"), "members")
    heads = members.groupBy("family", "root").agg(F.count("*").alias("nodes")).groupBy("family").agg(F.max_by("root", F.struct("nodes", "root")).alias("head"))
    own = members.join(heads, "family").withColumn("out", F.col("root") != F.col("head")).drop("head")
    known = own.join(sketches.select("id", "n"), "id").join(sets, "id")
    counted = written(rarest(known, common_bits(known), percent), "counted")
    rare = counted.select("id", "root", "out", F.explode("first").alias("code"))
    other = rare.select("code", F.col("id").alias("other"), F.col("root").alias("other_root"))
    met = rare.where("out").join(other, "code").where("root <> other_root").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    core = counted.where(f"100 * common >= {percent} * n").drop("first").join(sketches.select("id", "bits"), "id")
    return reachable(met, sketches, percent).unionByName(tiled_pairs(core, percent))


def tiled_pairs(core: DataFrame, percent: int) -> DataFrame:
    """Pairs of a family across components that can reach the similarity with common shingles alone. Two sets share
    no more than the lesser of their common counts, so one of the two is an anchor: a set whose common shingles would do for a partner of its own size. Tiles are of bounded expected size, and
    each is a group of its own; only pairs within reach leave it."""
    rows = written(core.withColumn("anchor", F.expr(f"{100 + percent} * common >= {2 * percent} * n")).select("family", "id", "root", "out", "n", "common", "anchor", "bits"), "core")
    sides = [("out AND anchor", "true"), ("out AND NOT anchor", "anchor AND NOT out")]
    tile = lambda n: F.least(F.greatest(F.ceil(F.col(n) / TILES), F.lit(LEAST_TILE)), F.lit(MOST_TILE))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["family", "way", "row", "column", "id", "root", "n", "common", "bits", "left"]
    parts = []
    for way, (left, right) in enumerate(sides):
        sizes = rows.groupBy("family").agg(F.count_if(F.expr(left)).alias("lefts"), F.count_if(F.expr(right)).alias("rights")).where("lefts > 0 AND rights > 0")
        sizes = sizes.select("family", F.ceil(F.col("lefts") / tile("lefts")).cast("int").alias("rows"), F.ceil(F.col("rights") / tile("rights")).cast("int").alias("columns"))
        placed = rows.join(sizes, "family").withColumn("place", F.xxhash64("id")).withColumn("way", F.lit(way))
        parts.append(placed.where(left).withColumn("row", F.pmod("place", "rows").cast("int")).withColumn("column", every("columns")).withColumn("left", F.lit(True)).select(*columns))
        parts.append(placed.where(right).withColumn("column", F.pmod("place", "columns").cast("int")).withColumn("row", every("rows")).withColumn("left", F.lit(False)).select(*columns))

    def run(rows: pa.Table) -> pa.Table:
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        bits = bits_of(rows.column("bits"))
        ids, roots, sizes, common = (rows.column(c).to_numpy() for c in ("id", "root", "n", "common"))
        left = rows.column("left").to_numpy()
        rest = np.flatnonzero(~left)
        for at in np.flatnonzero(left):
            can = (100 + percent) * np.minimum(common[at], common[rest]) >= percent * (sizes[at] + sizes[rest])
            some = rest[can & (roots[rest] != roots[at])]
            met = ids[some][within_reach(bits[at][None, :], bits[some], sizes[at], sizes[some], percent)]
            found_a.append(np.minimum(met, ids[at]))
            found_b.append(np.maximum(met, ids[at]))
        return pa.table({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})

    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("family", "way", "row", "column").applyInArrow(run, "a bigint, b bigint")


def crowded(nodes: DataFrame) -> DataFrame:
    """(band, id, leader) of the nodes in bands that several have; the leader is the least of them."""
    members = nodes.select("id", F.explode("bands").alias("band"))
    leaders = written(members.groupBy("band").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last").select("band", "leader"), "leaders")
    bitmap, bits = key_filter(leaders, "band", leaders.count())
    near, _ = split_by_filter(members, F.col("band"), bitmap, bits)
    return written(near.join(leaders, "band"), "crowd")


@dataclass(frozen=True)
class Groups:
    """Written tables: of every document (doc_id, mark, key, n_shingles), and of every digest of words its node's
    component: the least id there is, and the row that stands for it."""

    prints: DataFrame
    components: DataFrame


def group_documents(docs: DataFrame, size: int, percent: int = PERCENT) -> Groups:
    prints = written(fingerprints(docs, size), "prints")
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "mark"))
    groups = prints.where("key IS NOT NULL").groupBy("key").agg(first_row.alias("first"), F.first("n_shingles").alias("n"), F.first("planes").alias("planes"), F.first("bands").alias("bands"))
    nodes = written(groups.withColumn("id", F.monotonically_increasing_id()), "nodes")
    light = nodes.select("id", "n", "planes")
    where = nodes.select("id", F.col("first.mark").alias("mark"), F.coalesce("first.doc_id", F.lit(-1)).alias("doc"))
    crowd = crowded(nodes)
    side = lambda x: light.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("planes").alias(f"planes_{x}"))
    likely = f"{similar('n_a', 'n_b', percent)} AND {estimate('planes_a', 'planes_b')} >= {LEAST_ESTIMATE}"
    star = crowd.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    star = written(star.join(side("b"), "b").join(side("a"), "a").where(likely).select("a", "b"), "pairs")
    asked = written(parts_of_pairs(star).join(where, "id"), "asked")
    told = wanted_texts(docs, asked.select("mark", "doc").distinct()).join(asked, ["mark", "doc"])
    links = written(confirmed(packed_sets(told, size), percent), "links")
    roots = connected_components(links)

    # Bands whose nodes are not one component yet.
    placed = crowd.join(roots, "id", "left").select("band", "leader", "id", F.coalesce("root", "id").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low <> high AND size > 2").select("band", "size")
    open_ = written(placed.join(mixed, "band"), "mixed")
    pairs = written(band_pairs(open_.join(light, "id").where(f"size <= {FEW}"), likely).distinct(), "pairs")
    large = written(open_.where(f"size > {FEW}"), "large")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(large.select("id")).distinct()
    wanted = written(where.join(ids, "id", "left_semi"), "wanted")
    sets = written(named_sets(wanted_texts(docs, wanted).join(wanted, ["mark", "doc"]), size), "sets")
    sketches = written(light.select("id", "n").join(bounded(sets), "id"), "bounds")
    more = reachable(pairs, sketches, percent)
    if large.limit(1).count():
        more = more.unionByName(large_band_pairs(large, sketches, sets, percent)).distinct()
    more = written(more, "pairs")
    if more.limit(1).count():
        again = parts_of_pairs(more).join(sets, "id").select("a", "part", "b", "hashes")
        roots = connected_components(links.unionByName(written(confirmed(again, percent), "links")))

    named = nodes.select("id", "key", "first").join(roots, "id")
    # Written, so that the join below has plain shuffles on both sides and a hot root can be split.
    least = written(named.groupBy("root").agg(F.min("first").alias("least")), "least")
    tied = named.join(least, "root").select("key", "least")
    alone = nodes.join(roots, "id", "left_anti").select("key", F.col("first").alias("least"))
    components = written(tied.unionByName(alone).select("key", F.col("least.doc_id").alias("component_id"), F.col("least.mark").alias("least_mark")), "components")
    return Groups(prints.select("doc_id", "mark", "key", "n_shingles"), components)


@scratch
def near_duplicates(docs: DataFrame, size: int, percent: int = PERCENT) -> DataFrame:
    """One row per document: n_shingles, component_id (the least id it is linked with) and kept: whether its id is that
    one. A group without any id has a null component_id, and its row of the least mark is kept."""
    found = group_documents(docs, size, percent)
    plain = found.prints.where("key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    grouped = found.prints.where("key IS NOT NULL").join(found.components, "key")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("mark") == F.col("least_mark")))
    return grouped.select("doc_id", "n_shingles", "component_id", kept.alias("kept")).unionByName(plain)


@scratch
def keep_one(docs: DataFrame, size: int, percent: int = PERCENT) -> DataFrame:
    """The documents without those that another row of their group stands for: the row of the least id, of those the
    one of the least mark, and of equal rows one. Texts without words all stay. All columns are kept, and documents
    that a small filter of the marks in question clears are not shuffled."""
    found = group_documents(docs, size, percent)
    rows = found.prints.where("key IS NOT NULL").groupBy("key", "mark", "doc_id").agg(F.count("*").alias("rows"))
    judged = rows.join(found.components, "key").select("mark", F.coalesce("doc_id", F.lit(-1)).alias("doc"), (F.col("mark") == F.col("least_mark")).alias("stays"), "rows")
    special = written(judged.where("NOT stays OR rows > 1").select(F.col("mark").alias("__millrace_mark"), F.col("doc").alias("__millrace_doc"), F.col("stays").alias("__millrace_stays")), "dropped")
    bitmap, bits = key_filter(special, "__millrace_mark", special.count())
    mark, doc = F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1))
    maybe, clear = split_by_filter(docs, mark, bitmap, bits)
    asked = maybe.withColumn("__millrace_own", mark).withColumn("__millrace_id", doc)
    joined = asked.join(special, (F.col("__millrace_own") == F.col("__millrace_mark")) & (F.col("__millrace_id") == F.col("__millrace_doc")), "left")
    out = clear.unionByName(joined.where("__millrace_mark IS NULL").select(*docs.columns))
    if special.where("__millrace_stays").limit(1).count():
        out = out.unionByName(joined.where("__millrace_stays").select(*docs.columns).dropDuplicates(["doc_id", "text"]))
    return out
