"""Mixing, sharding, near-duplicates, tool calls and the pipeline."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import graph, membership, minhash, mixing, registry, sharding, tool_calls
from millrace.llm.common import table
from millrace.llm.textstats import words_of
from tests.llm.helpers import DOCS, documents, empty, prose, rows
from tests.oracle import connection, same_rows


# --- mixing ----------------------------------------------------------------------------------------


def water_filled(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in sizes if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / w for s in sizes}
        over = {s for s in sizes if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize(("bucket_rows", "near"), [(8, 0.1), (4000, 0.01)])
def test_mix_meets_targets(spark, bucket_rows, near):
    """Buckets of eight leave a dozen open documents of a source of fifty, too few to meet its words closely."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = mixing.mix(docs, bucket_rows).collect()
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in found:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    want = water_filled(sizes)
    for r in found:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near * want[s] + 3
    again = mixing.mix(docs.repartition(7), bucket_rows)
    assert Counter(again.collect()) == Counter(found)


def test_mix_lands_small_sources_closely_beside_a_large_one(spark):
    """The large source needs three rounds; the small one is to have a reserve in the last of them."""
    rng = random.Random(11)
    counts = {"large": 400, "small": 40}
    longest = {"large": 100, "small": 3000}
    made = [(i, " ".join(["w"] * rng.randint(longest[s] // 10, longest[s])), None, s, 0, "w", i) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    docs = spark.createDataFrame(made, DOCS)
    source = {r[0]: r[3] for r in made}
    sizes, taken = defaultdict(int), defaultdict(int)
    found = mixing.mix(docs, 60).collect()
    for r in found:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
    want = water_filled(sizes)
    assert want["small"] % sizes["small"] and len(found) == len(made)
    assert all(abs(taken[s] - want[s]) <= 20 for s in counts), (dict(taken), want)


def test_mix_edges(spark):
    found = mixing.mix(documents(spark)).collect()
    assert len(found) == len(rows())
    assert sorted(r.size for r in found) == sorted(len(words_of(r[1])) for r in rows())
    assert mixing.mix(empty(spark)).count() == 0
    repeated = mixing.repeat_documents(documents(spark), mixing.mix(documents(spark)))
    assert repeated.columns == documents(spark).columns
    assert repeated.count() == sum(r.copies for r in found)


def test_flight_keeps_the_totals():
    rng = random.Random(4)
    sizes = [float(rng.choice([1, 5, 5, 20, 300])) for _ in range(500)]
    chances = [0.37] * 500
    moved = mixing.flight(sizes, chances, rng)
    assert sum(p not in (0.0, 1.0) for p in moved) <= 2
    assert sum(moved) == pytest.approx(sum(chances)) and sum(s * p for s, p in zip(sizes, moved)) == pytest.approx(sum(s * p for s, p in zip(sizes, chances)))


# --- sharding --------------------------------------------------------------------------------------


def test_shards_are_gapless_and_move_little(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").unionByName(documents(spark).drop("filter_word", "id"))
    found = sharding.assign_shards(docs, 5).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard == 5 for r in found) / len(found)
    assert 0.1 < moved < 0.24
    assert min(map(len, slots.values())) > 0.7 * len(found) / 5
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == texts


def test_weights_draw_rows(spark):
    frame = table(spark, "/root/testdata/sf0.01", "documents")
    shares = Counter(r.shard for r in sharding.assign_shards(frame, 3, [1.0, 1.0, 4.0]).collect())
    assert 0.58 < shares[2] / sum(shares.values()) < 0.75
    assert sharding.assign_shards(empty(spark), 40).count() == 0


def test_sharding_statement(spark, sf_dir):
    same_rows(registry.op8_sharding(spark, sf_dir), connection(sf_dir), sharding.ORACLE_40)


# --- near-duplicates -------------------------------------------------------------------------------


def brute_components(texts: list[tuple], size: int) -> dict:
    sets = {}
    for i, t in texts:
        w = words_of(t, lower=True)
        sets[i] = {tuple(w[j : j + size]) for j in range(max(len(w) - size + 1, 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(i), len(sets[i])) for i in ids}


def family(seed: int, copies: int, change: float) -> list[str]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = rng.choices(vocabulary, k=120)
    return [" ".join(w if rng.random() > change * rng.random() else rng.choice(vocabulary) for w in base) for _ in range(copies)]


@pytest.mark.parametrize(("size", "few"), [(2, 4), (5, 32)])
def test_near_duplicates_match_brute_force(spark, monkeypatch, size, few):
    """Families of copies whose similarities lie around the threshold; with a small `FEW` they are large bands."""
    monkeypatch.setattr(minhash, "FEW", few)
    for name, value in (("LEAST_TILE", 8), ("TILES", 3), ("MOST_TILE", 16), ("PART_ROWS", 4)):
        monkeypatch.setattr(minhash, name, value)
    texts = [t for seed, n, change in ((1, 60, 0.1), (2, 25, 0.3), (3, 10, 0.02)) for t in family(seed, n, change)]
    texts += ["", " \n", "Solo", "solo", "solo other", *texts[:5], *(prose(i, 30) for i in range(20))]
    rng = random.Random(9)
    ids = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "w", 1) for i, t in zip(ids, texts, strict=True)] + [(5000, None, None, None, None, None, None)], DOCS).repartition(4)
    want = brute_components([*zip(ids, texts, strict=True), (5000, None)], size)
    found = {r.doc_id: r for r in minhash.near_duplicates(docs, size).collect()}
    assert {i: (r.component_id, r.n_shingles) for i, r in found.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())
    kept = minhash.keep_one(docs, size)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (root, _) in want.items() if i == root)


def test_near_duplicates_edges(spark):
    found = minhash.near_duplicates(documents(spark), 2).collect()
    assert len(found) == len(rows())
    same = [r for r in found if r.doc_id in (5, 6, 7)]
    assert len(same) == 4 and {r.component_id for r in same} == {5}
    assert minhash.near_duplicates(empty(spark), 2).count() == 0
    kept = minhash.keep_one(documents(spark), 2)
    # The repeated row stays once; the two rows without an id stay, as their texts differ.
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 8, 9, 10]
    assert kept.where("doc_id IS NULL").count() == 2
    assert minhash.keep_one(empty(spark), 2).count() == 0


def test_rows_without_an_id_are_compared(spark):
    """One word of 92 differs: a group with one id, and one without any."""
    words = [f"w{i}" for i in range(92)]
    near = lambda base, at: " ".join([*base[:at], "other", *base[at + 1 :]])
    second = [f"v{i}" for i in range(92)]
    texts = [(1, near(words, 9)), (None, near(words, 30)), (None, near(words, 30)), (None, near(second, 3)), (None, near(second, 50)), (None, " ".join(second)), (None, ""), (None, None), (7, "alone")]
    docs = spark.createDataFrame([(i, t, None, None, 0, None, 0) for i, t in texts], DOCS).repartition(3)
    found = minhash.near_duplicates(docs, 2).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in found) == {(1, 1, True): 1, (None, 1, False): 2, (None, None, False): 2, (None, None, True): 3, (7, 7, True): 1}
    kept = [(r.doc_id, r.text) for r in minhash.keep_one(docs, 2).collect()]
    assert len(kept) == 5 and {texts[0], (None, ""), (None, None), (7, "alone")} <= set(kept)


def test_repeated_ids_are_judged_by_row(spark):
    """Two texts share the id 4: one is a near copy of 3, the other of nothing."""
    words = [f"w{i}" for i in range(60)]
    texts = [(3, " ".join(words)), (4, " ".join(words[:-1])), (4, prose(2)), (4, prose(2)), (5, prose(4))]
    docs = spark.createDataFrame([(i, t, None, None, 0, None, 0) for i, t in texts], DOCS)
    assert sorted((r.doc_id, r.text) for r in minhash.keep_one(docs, 2).collect()) == sorted([texts[0], texts[2], texts[4]])


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 102), (102, 101), (7, 7)], "a bigint, b bigint")
    found = {r.id: r.root for r in graph.connected_components(edges).collect()}
    assert {found[i] for i in range(51)} == {0} and {found[i] for i in (100, 101, 102)} == {100}


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    bitmap, size = membership.key_filter(keys, "k", 1000)
    near, clear = membership.split_by_filter(spark.range(3000), F.col("id"), bitmap, size)
    inside = {r.id for r in near.collect()}
    assert set(range(0, 3000, 3)) <= inside and len(inside) + clear.count() == 3000 and len(inside) < 1300


# --- tool calls ------------------------------------------------------------------------------------

SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}, "list": {"items": ("array", True), "deep": ("object", False), "flag": ("boolean", False)}}
CALLS = "conv_id bigint, call_id string, position bigint, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id bigint, call_id string, position bigint, content string"


def linked(spark, calls, results):
    frame = tool_calls.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS)
    return {(r.conv_id, r.call_id): r for r in frame.collect()}


def test_calls_are_linked_ordered_and_checked(spark):
    found = linked(
        spark,
        [
            (1, "a", 0, "add", '{"b": 2.5, "a": 1}', []),
            (1, "b", 1, "add", '{"a": "x", "c": 1}', ["a"]),
            (1, "c", 2, "list", '{"items": [3, {"z": 1, "y": 2}], "flag": true}', ["a", "b", "gone"]),
            (1, "d", 3, "nope", "{}", None),
            (1, "e", 4, "add", "{broken", ["f"]),
            (1, "f", 5, "add", None, ["e"]),
            (2, "a", 0, "add", '{"a": 1, "b": 1}', []),
            (2, "a", 3, "add", '{"a": 9, "b": 1}', []),
            (None, "a", 0, "add", "{}", []),
        ],
        [(1, "a", 1, 'ok "quoted"\n'), (1, "z", 9, "orphan"), (2, "a", 2, "late"), (2, "a", 1, "first")],
    )
    assert len(found) == 8
    a, b, c, d, e = (found[1, k] for k in "abcde")
    assert (a.status, a.level, a.valid, a.errors) == ("linked", 0, True, "")
    assert a.message == '{"arguments":{"a":1,"b":2.5},"id":"a","name":"add","result":"ok \\"quoted\\"\\n"}'
    assert (b.status, b.level, b.errors) == ("call without result", 1, "type:a,missing:b,unknown:c")
    assert (c.level, c.errors) == (2, "dependency:gone")
    assert '{"flag":true,"items":[3,{"y":2,"z":1}]}' in c.message
    assert d.errors == "function:nope" and not d.valid
    assert e.errors == "json,cycle" and e.level is None and found[1, "f"].level is None
    assert found[1, "z"].status == "result without call" and not found[1, "z"].valid
    assert (found[2, "a"].repeats, '"result":"first"' in found[2, "a"].message) == (2, True)


def test_long_chains_and_cycles_by_doubling(spark):
    chain = [(1, str(i), i, "add", '{"a": 1, "b": 1}', [str(i - 1)] if i else []) for i in range(40)]
    found = linked(spark, [*chain, (2, "x", 0, "add", "{}", ["y"]), (2, "y", 1, "add", "{}", ["x"])], [])
    assert [found[1, str(i)].level for i in range(40)] == list(range(40))
    assert found[2, "x"].level is None and found[2, "y"].level is None


def test_conversations(spark, sf_dir):
    same_rows(registry.op10_tool_calls(spark, sf_dir), connection(sf_dir), tool_calls.ORACLE)
    nothing = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert tool_calls.link_calls(*tool_calls.turn_calls(nothing), tool_calls.REPLY).count() == 0
    odd = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 2, "user", "b"), (2, 5, "assistant", "x"), (None, 1, "user", "y"), (3, None, "user", "z"), (3, 1, "tool", "t")], "conv_id bigint, turn bigint, role string, text string")
    found = {r.call_id: r for r in tool_calls.link_calls(*tool_calls.turn_calls(odd), tool_calls.REPLY).collect()}
    assert set(found) == {"1-0", "1-2", "2-4"}
    assert (found["1-0"].errors, found["1-0"].repeats, found["1-2"].level, found["2-4"].status) == ("missing:text", 1, 1, "result without call")


# --- pipeline --------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline
    from millrace.llm import quality_rules, toxicity

    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf)
    scored = toxicity.score(docs, toxicity.train(docs, labels)).where("NOT toxic")
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in scored.collect())
    good = stages["quality_rules"](spark, docs, sf)
    ruled = quality_rules.apply_rules(docs, quality_rules.train(docs, labels)).where("kept")
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in ruled.collect())
    single = stages["near_dedup"](spark, docs, sf)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (root, _) in want.items() if i == root)
    assert all(x.columns == docs.columns for x in (clean, good, single, stages["mixing"](spark, docs, sf)))
    assert corpus_pipeline.run(spark, sf).count() > 300
