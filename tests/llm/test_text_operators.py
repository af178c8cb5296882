"""Encoding, media, quality, language, toxicity: exactness, round trips, held-out accuracy, and edges."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import jpeg, langid, linear, media, pieces, quality_rules, quality_score, registry, textstats, toxicity
from millrace.llm.common import table
from tests.llm.helpers import documents, empty, prose, rows

MODEL = registry.piece_model_file()


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceTable(MODEL, limit=50)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\tab▁é🙂ﬁ　\xa0\x00\r.,1")), max_size=40))
def test_encoding_is_the_librarys(encoder, text):
    assert encoder.encode([text, text + " x"]) == encoder.model.encode([text, text + " x"])


def test_encoding_table(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = pieces.encode_documents(documents(spark), MODEL, extra=True).collect()
    assert len(found) == len(rows())
    texts = Counter((r[0], r[1] or "") for r in rows())
    for r in found:
        match = [t for i, t in texts if i == r.doc_id and [*model.encode(t), model.eos_id()] == r.ids]
        assert match
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded == model.decode(list(r.ids)) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert pieces.encode_documents(empty(spark), MODEL).count() == 0


# --- media -----------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=200), min_size=1, max_size=4))
def test_images_round_trip(parts):
    payloads = [p + b"\xff" * (-len(p) % 576) for p in parts]
    stored = jpeg.write_images(payloads)
    assert [np.vstack(x).tobytes() for x in jpeg.thumbnails(stored)] == payloads
    assert stored == [jpeg.write_images([p])[0] for p in payloads]


def test_long_payload_is_several_images():
    payload = random.Random(1).randbytes(576 * 700)
    (images,) = jpeg.thumbnails(jpeg.write_images([payload]))
    assert len(images) == 3 and np.vstack(images).tobytes() == payload


def _bits(text: str) -> bytes:
    text += "1" * (-len(text) % 8)
    data = int(text, 2).to_bytes(len(text) // 8, "big")
    return data.replace(b"\xff", b"\xff\x00")


def test_colour_image_with_ac_coefficients_and_no_restarts():
    """A 16 x 8 image of three components, 4:2:2, with AC coefficients to pass over; its bits are made by hand."""
    segment = jpeg._segment
    dc, ac = bytes((0, 4) + (0,) * 14) + bytes((0, 3, 5, 8)), bytes((0, 3) + (0,) * 14) + bytes((0x00, 0x13, 0xF0))
    head = jpeg.SOI + segment(0xDB, bytes([0] + [16] * 64)) + segment(0xC0, b"\x08\x00\x08\x00\x10\x03\x01\x21\x00\x02\x11\x00\x03\x11\x00")
    head += segment(0xC4, b"\x00" + dc) + segment(0xC4, b"\x10" + ac) + segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00")
    # Luminance differences 20 (category 5, after a run with an AC value) and -3 (category... 2 is not there: 5 bits 11100).
    first = "10" + "10100" + "01" + "101" + "00"
    second = "10" + "00100" + "10" + "00"
    chroma = "00" + "00"
    data = head + _bits(first + second + chroma + chroma) + jpeg.EOI
    (image,) = jpeg.thumbnails([data])[0:1]
    (thumbnail,) = image
    want = [128 + 20 * 16 // 8, 128 + (20 - 27) * 16 // 8]
    assert thumbnail.tolist() == [[min(255, w) for w in want]]


@pytest.mark.parametrize("data", [b"", b"junk", jpeg.SOI, jpeg.write_images([b"a" * 576])[0][:-40], jpeg.SOI + jpeg._segment(0xC2, b"\x08" * 9) + jpeg.EOI])
def test_broken_images(data):
    if data:
        with pytest.raises(jpeg.JpegError):
            jpeg.thumbnails([data])
    else:
        assert jpeg.thumbnails([data]) == [[]]


def test_media_table(spark):
    found = media.store(documents(spark), extra=True).collect()
    assert len(found) == len(rows())
    by_text = {}
    for r in found:
        payload = np.vstack(jpeg.thumbnails([bytes(r.media)])[0]).tobytes()
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert payload[r.n_bytes :].strip(b"\xff") == b"" and len(payload) % 576 == 0 and len(payload) > 0
        by_text.setdefault(payload, set()).add((r.media_sha256, r.feature))
    wanted = {media.payload_of(t)[1] for _, t, *_ in rows()}
    assert set(by_text) == wanted and all(len(v) == 1 for v in by_text.values())
    assert media.store(empty(spark)).count() == 0


# --- counts and classifiers ------------------------------------------------------------------------


def brute_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n\t#\xa0\x1c")), max_size=120))
def test_counts_match_brute_force(text):
    assert textstats.base_counts(text, textstats.words_of(text)) == brute_counts(text)


def test_many_words_count_alike(monkeypatch):
    text = " ".join(random.Random(2).choices("a b c d".split(), k=400))
    few = textstats.repeated_words(textstats.words_of(text))
    monkeypatch.setattr(textstats, "MANY_WORDS", 10)
    assert textstats.repeated_words(textstats.words_of(text)) == few == brute_counts(text)[4]


def test_quality_rules_on_edges(spark, sf_dir):
    model = quality_rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    found = quality_rules.apply_rules(documents(spark), model).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
        assert not (r.base_failed and r.kept)
    for i, text, *_ in rows():
        assert any((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(text) for r in by_id[i])
        words = brute_counts(text)
        assert any(r.base_failed == (words[0] < 10 or 100 * words[4] > 20 * words[0]) for r in by_id[i])
    kept = quality_rules.keep_documents(documents(spark), model)
    assert kept.columns == documents(spark).columns and kept.count() == sum(r.kept for r in found)
    assert quality_rules.apply_rules(empty(spark), None).count() == 0
    assert quality_rules.train(empty(spark), table(spark, sf_dir, "labels").where("false")) is None


def held_out(spark, frame, labels, label, predicted):
    rows_ = frame.where("held_out").join(labels, "doc_id").select(label, predicted).collect()
    return rows_


def test_quality_rules_see_the_order_of_words():
    hashes = textstats.WordHashes()
    there, back = (quality_rules.features_of(t, textstats.words_of(t), hashes)[: 1 << quality_rules.WORD_BITS] for t in ("one two three four", "four two one three"))
    assert np.count_nonzero(there) == np.count_nonzero(back) == 9 and (there != back).any()


def test_quality_score_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    found = registry.op7_quality_score(spark, sf)
    good = held_out(spark, found, table(spark, sf, "labels"), "quality", "predicted")
    assert len(good) > 40 and np.mean([r.quality == r.predicted for r in good]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.collect())
    model = quality_score.train(empty(spark), table(spark, sf, "labels").where("false"))
    edges = quality_score.score(documents(spark), model).collect()
    assert len(edges) == len(rows()) and {r.score for r in edges} == {0.5}


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    found = registry.op4_language(spark, sf)
    seen = held_out(spark, found, docs.select("doc_id", "lang"), "lang", "lang_pred")
    assert len(seen) > 150 and np.mean([r.lang == r.lang_pred for r in seen]) > 0.95
    for frame in (documents(spark), documents(spark).where("false")):
        model = langid.train(frame)
        edges = {r.doc_id: r for r in langid.identify(frame, model).collect()}
        if edges:
            assert edges[0].lang_pred == edges[1].lang_pred == edges[2].lang_pred == "und" and edges[0].score == 0.0
            assert edges[5].lang_pred in ("en", "de") and 0 <= edges[5].score <= 1


def test_toxicity_chain(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    # Learn from one half, look at the other.
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    assert model.names[-1] == "toxic" and len(model.links[-1].earlier) == len(model.names) - 1
    seen = toxicity.score(docs, model).join(labels.where("doc_id % 2 = 1").selectExpr("doc_id", "toxic AS label"), "doc_id").select("toxic", "label", "score").collect()
    # 210 toxic rows to learn from.
    assert np.mean([r[0] for r in seen if r.label == 0]) < 0.01
    assert np.mean([r[0] for r in seen if r.label == 1]) > 0.8
    edges = toxicity.score(documents(spark), model).collect()
    assert len(edges) == len(rows()) and not any(r.toxic for r in edges if r.doc_id in (0, 1, 2))
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == toxicity.score(docs, model).where("NOT toxic").count()
    assert toxicity.train(empty(spark), labels.where("false")) is None
    assert not any(r.toxic for r in toxicity.score(documents(spark), None).collect())


def test_toxicity_links_match_a_plain_restatement(spark):
    """Each link's probability, term by term in plain Python."""
    import math

    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").where("doc_id % 9 = 0").unionByName(documents(spark).drop("filter_word", "id"))
    model = toxicity.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert model.names == ["low_quality", *(f"kind_{k + 1}" for k in range(toxicity.KINDS)), "toxic"]
    found = toxicity.score(docs, model).collect()
    want = Counter()
    for row in docs.collect():
        lower = "".join(c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else c for c in row.text or "")
        parts = {zlib.crc32(w.encode()) % (1 << 18) for w in lower.split(" ") if w}
        parts |= {zlib.crc32(w.encode()[:n], n) % (1 << 18) for w in lower.split(" ") for n in (4, 5, 6) if len(w.encode()) > n}
        before = []
        for link in model.links:
            margin = link.bias + sum(float(link.words[at]) for p, at in model.place.items() if p in parts) + sum(w * p for w, p in zip(link.earlier, before, strict=True))
            before.append(1 / (1 + math.exp(-max(-35.0, min(35.0, link.calibration.slope * margin + link.calibration.offset)))))
        want[row.doc_id, round(before[-1], 3)] += 1
    assert Counter((r.doc_id, round(r.score, 3)) for r in found) == want
    assert all(r.toxic == (r.score >= 0.4) and r.kept == (not r.toxic) for r in found)


def test_scores_match_plain_restatements(spark):
    """The quality score and the probability of the quality rules, term by term."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    some = docs.where("doc_id % 25 = 0").unionByName(documents(spark).where("doc_id IS NOT NULL").drop("filter_word", "id"))
    score_model, rules_model = quality_score.train(docs, labels), quality_rules.train(docs, labels)
    scores, rules = Counter((r.doc_id, round(r.score, 3)) for r in quality_score.score(some, score_model).collect()), quality_rules.apply_rules(some, rules_model).collect()
    want_scores, want_rules = Counter(), Counter()
    for row in some.collect():
        words, hashes = textstats.words_of(row.text), textstats.WordHashes()
        single, points = hashes.of(words), textstats.code_points(row.text or "")
        ids = set()
        for grams, salt in ((single, 11), (textstats.word_grams(single, 2), 12), (textstats.char_grams(points, 3), 13)):
            ids |= set(textstats.mixed(grams, 16, salt).tolist()) if words else set()
        if words and (repeats := brute_counts(row.text)[4]):
            ids.add((1 << 16) + min(int(repeats / len(words) * 10), 10))
        margin = sum(float(score_model.weights[i]) for i in ids) / max(len(ids), 1) ** 0.5 + score_model.bias
        want_scores[row.doc_id, round(float(linear.sigmoid(score_model.calibration.slope * margin + score_model.calibration.offset)), 3)] += 1
        counts = brute_counts(row.text)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        margin = rules_model.bias
        for block, parts, salt in ((0, [textstats.word_grams(single, n) for n in (1, 2, 3)], 1), (1, [textstats.char_grams(points, n) for n in (2, 3)], 2)):
            bins = Counter(textstats.mixed(np.concatenate(parts), 12, salt).tolist())
            margin += sum((n / sum(bins.values())) ** 0.5 * float(rules_model.weights[(block << 12) + i]) for i, n in bins.items())
        p = None if failed else round(float(linear.sigmoid(rules_model.calibration.slope * margin + rules_model.calibration.offset)), 3)
        want_rules[row.doc_id, *counts, failed, p] += 1
    close = lambda a, b: len(a) == len(b) and all(x[:-1] == y[:-1] and (x[-1] is y[-1] or abs(x[-1] - y[-1]) < 0.003) for x, y in zip(a, b, strict=True))
    order = lambda c: sorted(c.elements(), key=lambda r: (r[:-1], r[-1] or 0.0))
    assert close(order(scores), order(want_scores))
    assert close(order(Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, None if r.probability is None else round(r.probability, 3)) for r in rules)), order(want_rules))


def test_language_votes_match_a_plain_restatement():
    """The family by its machines' votes, then the language by those within it."""
    texts = [("en", "the house is on the hill and the sea"), ("de", "das haus ist auf dem berg und am meer"), ("fr", "la maison est sur la colline et la mer"), ("es", "la casa esta en la colina y el mar")]
    made = [(lang, f"{text} {n} {text.split()[n % 5]}") for lang, text in texts for n in range(12)]
    x = langid.sample_features([t for _, t in made])
    from millrace.llm.training import Sample

    model = langid.fit(Sample(np.array([lang for lang, _ in made], object), x, np.ones(len(made))))
    for _, text in made[::5]:
        features = langid.features_of(text)
        chosen, chance = None, 1.0
        for machines in (model.families, None):
            machines = machines or model.within[chosen]
            if len(machines.names) > 1:
                votes, sums = Counter(), Counter()
                for at, (a, b) in enumerate(machines.pairs):
                    margin = sum(float(v) * float(w) for v, w in zip(features, machines.weights[:, at], strict=True)) + float(machines.bias[at])
                    p = float(linear.sigmoid(machines.calibrations[at].slope * margin + machines.calibrations[at].offset))
                    votes[machines.names[a if margin > 0 else b]] += 1
                    sums[machines.names[a]] += p
                    sums[machines.names[b]] += 1 - p
                chosen = max(machines.names, key=lambda n: (votes[n], sums[n]))
                chance *= sums[chosen] / (len(machines.names) - 1)
            else:
                chosen = machines.names[0]
        assert model.predict(text)[0] == chosen and abs(model.predict(text)[1] - chance) < 1e-4


@pytest.mark.parametrize("few", [1, 2, 4])
def test_few_rows_of_a_label_are_learned_from(few):
    """No model turns itself off, and no score is the same for every text."""
    from millrace.llm.training import Sample

    texts = [prose(i, 30) for i in range(60)] + [f"vile scum number{i} vile filth " + prose(i, 10) for i in range(few)]
    label = np.array([0] * 60 + [1] * few, object)
    for module in (toxicity, quality_rules, quality_score):
        mark = label if module is toxicity else 1 - label
        found = [(i, np.ones(len(i), np.float32) if v is None else v) for i, v in module.sample_features(texts)]
        model = module.fit(Sample(mark, found, np.ones(len(texts))))
        if module is toxicity:
            parts = toxicity.ChosenParts(model.place)
            scores = [model.probabilities(parts.of(t))[-1] for t in texts]
        elif module is quality_rules:
            hashes = textstats.WordHashes()
            scores = [-model.probability(module.features_of(t, textstats.words_of(t), hashes)) for t in texts]
        else:
            scores = [-model.score(module.grams_of(t, textstats.WordHashes())) for t in texts]
        assert min(scores[60:]) > max(scores[:60]), module.__name__


def test_models_separate_and_calibrate():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0).astype(float)
    k = linear.gram(x)
    for margin in (k @ linear.logistic_dual(k, y, np.ones(200), 0.1), k @ linear.hinge_dual(k, 2 * y - 1, np.ones(200))):
        assert np.mean((margin > 0) == (y > 0.5)) > 0.9
    wide = np.hstack([x, np.ones((200, 1))]).astype(float)
    primal = wide @ linear.logistic_primal(wide, y, np.ones(200), 0.1)
    assert np.allclose(primal, k @ linear.logistic_dual(k, y, np.ones(200), 0.1), atol=1e-3)
    p = linear.calibrate(primal, y, np.ones(200))(primal)
    assert abs(p.mean() - y.mean()) < 0.05
