"""Mixing sources to target weights by the cube method.

Every source gets a target of words by its weight, and every document of it the same expected number of
copies, target over size of the source. The whole part is taken for certain; the fraction is drawn by
balanced sampling: inclusion probabilities move along directions that leave the totals of words and of
documents as they are, until each is 0 or 1. Only as many documents as there are balancing totals can
remain; those, and a dozen of each source held back from every flight to settle them with, get the choice
that misses the totals least.

A source is cut into buckets of a bounded expected number of documents by the hash of id and text, so that a
hot source is many tasks; what the buckets leave open (those held back and two documents each at most) meets
in later rounds, which hold back a dozen again.
All draws are seeded by source, bucket and round, so reruns agree.

There is one row per source in the table of targets, whose windows are one task: sources are names that people gave,
some thousands at most, whatever the number of documents.

Cases: a null text has size 0; a null source is a source of its own, behind all others; sources without words
have target 0; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import scratch, written

#: Weights of the sources in the order of their code points, over and over.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words to take, as a share of all words; and most copies of a document, on average.
SHARE = 1.5
MOST_COPIES = 2.0
#: Documents in a bucket of the first round, and open documents in one of a later round, by expectation.
BUCKET_ROWS = 4000
WORD = r"[^\x20\x09-\x0D]+"
EPSILON = 1e-9
#: Open documents of a source that the landing settles together, besides the two that the flight leaves.
LANDING = 12


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """One row per source: rank, size, documents and target. Filling by weight with a ceiling has one level:
    in the order of ceiling over weight, the first at which those before are full and the rest are not."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    table = F.array(*(F.lit(float(w)) for w in weights))
    # These windows see one row per source.
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(table, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))).withColumn("ceiling", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("ceiling") / F.col("weight"), "rank")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = ranked.withColumn("level", level).withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("ceiling"), F.col("level")))
    leveled = leveled.withColumn("level", F.max("fits").over(everything))
    first = F.first("fits", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("ceiling"), F.coalesce(first, F.lit(0.0)) * F.col("weight"))
    return leveled.withColumn("target", target).select("source", "rank", "source_size", "documents", "target")


def flight(sizes: list[float], chances: list[float], rng: random.Random) -> list[float]:
    """Chances moved to 0 or 1, but for two at most, with the sums of chances and of chance times size unchanged."""
    p = list(chances)
    active: list[int] = []
    for i in range(len(p)):
        if not EPSILON < p[i] < 1 - EPSILON:
            p[i] = float(round(p[i]))
            continue
        active.append(i)
        pair = None
        if len(active) == 2 and sizes[active[0]] == sizes[active[1]]:
            pair = (active[0], active[1])
        if len(active) < 3 and pair is None:
            continue
        if pair is not None:
            moved, along = pair, (1.0, -1.0)
        else:
            a, b, c = moved = tuple(active)
            along = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if along == (0.0, 0.0, 0.0):
                moved, along = (a, b), (1.0, -1.0)
        up = min((1 - p[k]) / u if u > 0 else p[k] / -u for k, u in zip(moved, along, strict=True) if u)
        down = min(p[k] / u if u > 0 else (1 - p[k]) / -u for k, u in zip(moved, along, strict=True) if u)
        step = up if rng.random() * (up + down) < down else -down
        for k, u in zip(moved, along, strict=True):
            p[k] += step * u
            if p[k] < EPSILON or p[k] > 1 - EPSILON:
                p[k] = float(round(p[k]))
                active.remove(k)
    return p


def landing(sizes: list[float], chances: list[float]) -> list[float]:
    """Whole chances for the few left open: of all choices the one that misses the words least; a document
    too many or too few counts as one word."""
    open_ = [i for i, p in enumerate(chances) if 0.0 < p < 1.0]
    size, chance = np.array([sizes[i] for i in open_]), np.array([chances[i] for i in open_])
    choices = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    miss = np.abs(choices @ size - size @ chance) + np.abs(choices.sum(axis=1) - chance.sum())
    out = list(chances)
    for i, taken in zip(open_, choices[np.argmin(np.round(miss, 6))], strict=True):
        out[i] = float(taken)
    return out


def reserved(chances: list[float], count: int = LANDING) -> list[int]:
    """Rows kept out of a bucket's flight for the landing: spread evenly over the open rows, large to small."""
    open_ = [i for i, p in enumerate(chances) if EPSILON < p < 1 - EPSILON]
    return open_ if len(open_) <= count else [open_[(2 * k + 1) * len(open_) // (2 * count)] for k in range(count)]


_STATE = "id_hash bigint, doc_id bigint, rank int, bucket bigint, size bigint, chance double"


def _round(number: int, last: bool):
    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        # Large documents first: what stays open is small.
        pdf = pdf.sort_values(["size", "id_hash", "doc_id"], ascending=[False, True, True], kind="stable")
        sizes, chances = pdf["size"].astype(float).tolist(), pdf["chance"].tolist()
        back = reserved(chances)
        kept = [chances[i] for i in back]
        for i in back:
            chances[i] = 0.0
        found = flight(sizes, chances, random.Random(f"{pdf['rank'].iloc[0]}:{pdf['bucket'].iloc[0]}:{number}"))
        for i, chance in zip(back, kept, strict=True):
            found[i] = chance
        return pdf.assign(chance=landing(sizes, found) if last else found)

    return settle


@scratch
def mix(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: size, its source's size and target, the copies, and the words taken."""
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.xxhash64(F.col("doc_id").cast("bigint"), "text").alias("id_hash"))
    slim = written(given, "mix-sizes")
    sources = written(source_targets(slim), "mix-sources")
    most = sources.agg(F.max("documents")).first()[0] or 0
    buckets = F.greatest(F.lit(1), F.ceil(F.col("documents") / bucket_rows)).cast("bigint")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # The sources' table is broadcast only if its written size is under the session's limit.
    rows = slim.join(sources, slim["source"].eqNullSafe(sources["source"])).select("doc_id", "rank", "size", "id_hash", F.pmod("id_hash", buckets).alias("bucket"), rate.alias("rate"))
    state = rows.select("id_hash", "doc_id", "rank", "bucket", "size", (F.col("rate") - F.floor("rate")).alias("chance"))
    number, count, settled = 0, max(1, -(-most // bucket_rows)), []
    while True:
        last = count == 1
        done = written(state.groupBy("rank", "bucket").applyInPandas(_round(number, last), _STATE), "mix-round")
        settled.append(done.where("chance IN (0.0, 1.0)"))
        if last:
            break
        number, merge = number + 1, max(2, bucket_rows // (LANDING + 2))
        count = max(1, -(-count // merge))
        state = done.where("chance NOT IN (0.0, 1.0)").withColumn("bucket", F.floor(F.col("bucket") / merge))
    chosen = settled[0]
    for more in settled[1:]:
        chosen = chosen.unionByName(more)
    wide = sources.select(F.col("rank"), "source_size", "target", rate.alias("rate"))
    copies = (F.floor("rate") + F.col("chance")).cast("bigint")
    return chosen.join(wide, "rank").select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns. Rows that share an id share their
    copies: as evenly as possible, the first in the order of their hash one more. Texts are shuffled once, before they
    are repeated, and by the same plan at every size; copies of a text follow one another."""
    wanted = mixed.groupBy(F.col("doc_id").alias("__millrace_id")).agg(F.sum("copies").alias("__millrace_copies"), F.count("*").alias("__millrace_rows"))
    joined = docs.join(wanted.hint("merge"), docs["doc_id"].eqNullSafe(wanted["__millrace_id"]))
    several = wanted.where("__millrace_rows > 1").limit(1).count() > 0
    single = joined.where("__millrace_rows = 1") if several else joined
    parts = [single.withColumn("__millrace_own", F.col("__millrace_copies"))]
    if several:
        order = Window.partitionBy("__millrace_id").orderBy(F.xxhash64(*docs.columns))
        share = joined.where("__millrace_rows > 1").withColumn("__millrace_place", F.row_number().over(order))
        own = F.floor(F.col("__millrace_copies") / F.col("__millrace_rows")) + (F.col("__millrace_place") <= F.col("__millrace_copies") % F.col("__millrace_rows")).cast("bigint")
        parts.append(share.withColumn("__millrace_own", own).drop("__millrace_place"))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    every = every.where("__millrace_own > 0").withColumn("__millrace_copy", F.explode(F.sequence(F.lit(1), F.col("__millrace_own").cast("int"))))
    return every.select(*docs.columns)
