"""N-best segmentation, decoding and language identification."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, nbest
from tessera.llm.pieces import BLANK, Vocabulary


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load()


def every(vocabulary, text):
    if not text:
        return [(0.0, ())]
    out = []
    for k in range(1, min(len(text), vocabulary.longest) + 1):
        found = vocabulary.pieces.get(text[:k])
        if found is None and k == 1:
            raw = text[0].encode()
            found_ids, score = [vocabulary.bytes_[b] for b in raw], vocabulary.unknown_score
        elif found is not None:
            found_ids, score = [found[0]], found[1]
        else:
            continue
        out += [(score + s, (*found_ids, *ids)) for s, ids in every(vocabulary, text[k:])]
    return out


def test_nbest_is_that_of_all_paths(vocabulary):
    encoder = nbest.Encoder(vocabulary, 7)
    for text in ("the cat", "a  b, c.", "in of x", "ñé漢z", "a\n\nb1", "x²."):
        paths = every(vocabulary, vocabulary.escape(text))
        want = sorted((s for s, _ in paths), reverse=True)[:7]
        got = encoder.encode(text)
        assert [s for s, _ in got] == want
        assert len({ids for _, ids in got}) == len(got)
        known = {ids: s for s, ids in paths}
        for s, ids in got:
            assert known[tuple(memoryview(ids).cast("i").tolist())] == s
            assert encoder.decode(ids) == text


def test_scores_that_tie_and_repeat():
    v = Vocabulary({"a": (1, -1.0), "aa": (2, -2.0), "aaa": (3, -3.0), BLANK: (0, 0.0)}, {i: 10 + i for i in range(256)}, 4)
    out = nbest.Encoder(v, 5).encode("aaaa aaaa")
    assert [s for s, _ in out] == [-8.0] * 5 and len({i for _, i in out}) == 5
    assert len(nbest.Lattice(v).nbest("a" * 5000, 3)) == 3


def test_documents(spark, vocabulary):
    rng = random.Random(1)
    texts = [None, "", " ", "word", "a" * 30000, "new\nline\ttab", "emoji 😀 ok", "x " * 5000] + ["".join(rng.choices("abé z.,\n", k=50)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)] + [(None, "word", "q"), (3, "word", "q")], "doc_id bigint, text string, ids string")
    full = nbest.encode_nbest(docs, 3)
    rows = full.collect()
    assert len(rows) == len(texts) + 2
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[0].ids is None and by_id[0].round_trip is None
    assert by_id[1].ids == [] and by_id[1].scores == [0.0]
    assert all(r.round_trip for r in rows if r.ids is not None)
    back = {r.doc_id: r.text for r in nbest.decode_ids(full).collect() if r.doc_id is not None}
    assert back == {i: t for i, t in enumerate(texts)}
    for r in nbest.encode_nbest(docs, 3, digest=True).collect():
        if r.doc_id is not None and r.ids is not None:
            assert r.ids == sha256(np.array(by_id[r.doc_id].ids, np.int32).tobytes()).hexdigest() and r.n_pieces == len(by_id[r.doc_id].ids)
    assert nbest.encode_nbest(docs.limit(0)).count() == 0


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    pieces = sorted({BLANK, "a", "b", "ab", "ba", "aba", BLANK + "a", BLANK + "ab", "bb"})
    model = langid.Model(["x", "y"], pieces, rng.random((len(pieces) + 1, 2)))
    number = {p: i for i, p in enumerate(pieces)}

    def total(text, lang):
        if not text:
            return 1.0
        out = 0.0
        for k in range(1, len(text) + 1):
            at = number.get(text[:k], len(pieces) if k == 1 else None)
            if at is not None:
                out += model.chances[at, lang] * total(text[k:], lang)
        return out

    words = ["a", "ab", "abab", "bab", "azb", "bbabab"]
    got = model.word_scores(words)
    for w, scores in zip(words, got):
        assert np.allclose(scores, [math.log(total(BLANK + w, k)) for k in (0, 1)])
        assert np.allclose(scores, model._long(w))
    weights = np.ones((len(words), 2))
    counts = langid.expected_counts([model.lattice.edges(w) for w in words], [len(w) + 1 for w in words], weights, model.chances)
    spelled = sum(counts[i, 0] * len(p) for p, i in number.items()) + counts[-1, 0]
    assert abs(spelled - sum(len(w) + 1 for w in words)) < 1e-6


def test_languages(spark, sf_dir):
    from tessera.session import table

    docs = table(spark, sf_dir, "documents")
    found = langid.language_of_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0.0 <= r.score <= 1.0 for r in found)
    odd = docs.select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame([(10**9, None, "en"), (10**9 + 1, "", None), (10**9 + 2, "123 !!", "zz"), (None, "the of and", "en"), (10**9 + 3, "the" * 20000, None)], "doc_id bigint, text string, lang string")
    )
    rows = {r.doc_id: r for r in langid.language_of_documents(odd.withColumn("score", F.lit(1))).collect()}
    assert len(rows) == docs.count() + 5
    assert [rows[10**9 + k].lang_pred for k in range(3)] == ["und"] * 3 and rows[None].held_out is False
    assert {r.doc_id for r in langid.keep_identified(odd).collect() if (r.doc_id or 0) >= 10**9} <= {None, 10**9 + 3}
    assert langid.language_of_documents(docs.limit(0)).count() == 0
    clash = odd.withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(2)).withColumn("language", F.lit("y"))
    assert sorted(map(str, langid.keep_identified(clash).drop("lang_pred", "score", "language").collect())) == sorted(map(str, langid.keep_identified(odd).collect()))
    assert {(r.lang_pred, r.score, r.language) for r in langid.keep_identified(clash).collect()} == {("x", 2, "y")}


def plain_language(model, text):
    """(language, posterior) by the definition: a sum over all segmentations of each word, piece by piece."""
    number, longest = {p: i for i, p in enumerate(model.pieces)}, max(map(len, model.pieces))
    logs, total = np.log(model.chances), np.zeros(len(model.languages))
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not words:
        return "und", 0.0
    for word, n in Counter(words).items():
        chars = BLANK + word
        alpha = [np.zeros(len(model.languages))]
        for end in range(1, len(chars) + 1):
            parts = [(b, number[chars[b:end]]) for b in range(max(0, end - longest), end) if chars[b:end] in number]
            if chars[end - 1] not in number:
                parts.append((end - 1, len(number)))
            alpha.append(np.logaddexp.reduce([alpha[b] + logs[i] for b, i in parts]))
        total += n * alpha[-1]
    best = int(np.argmax(total))
    return model.languages[best], 1.0 / np.exp(total - total[best]).sum()


def test_languages_are_those_of_the_definition(spark, sf_dir):
    from tessera.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(10**9, "the" * 700, None), (10**9 + 1, None, "en"), (10**9 + 2, "Ünd 7 \u0130x", None)], docs.schema))
    model = langid.fit(docs, langid._learns("doc_id", 4, 2))
    want = {r.doc_id: plain_language(model, r.text) for r in docs.collect()}
    got = langid.language_of_documents(docs).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: x for i, (x, _) in want.items()}
    assert all(abs(r.score - want[r.doc_id][1]) < 1e-6 for r in got)


def test_every_language_and_long_words_are_learned(spark):
    rng = random.Random(2)
    rows = [(f"l{k:03d}", " ".join([f"{chr(97 + k % 26)}{chr(97 + k // 26)}"] * 5)) for k in range(230)]
    rows += [("zz", "".join(rng.choices("αβγδ", k=300))) for _ in range(5)] + [("yy", "".join(rng.choices("κλμν", k=300))) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert len(model.languages) == 232
    scorer = langid.Scorer(model)
    assert [x for x, _ in scorer.predict(["α" * 40 + "βγδ" * 9, "λ" * 200])] == ["zz", "yy"]
