"""The trained operators: plain scoring, exact marginals and held-out accuracy."""

from __future__ import annotations

import itertools
import math
import re
import textwrap

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import licenses, toxicity


def plain_licenses(model, text):
    """(paragraphs, predicted, confirmed, families, chance): lines one by one, then every window of lines."""
    paragraphs, predicted, confirmed = 0, set(), {}
    longest = max(len(licenses.words_of(t)) for own in licenses.NOTICES.values() for t in own)

    def family(own):
        chances = model.chances(own)
        top = max(model.classes, key=chances.get)
        if top == licenses.UNKNOWN or chances[top] < licenses.LEAST_CHANCE:
            return None
        return top, chances[top], model.share(top, own) >= licenses.LEAST_SHARE

    for nth, part in enumerate(re.split(r"\n(?:[ \t\f\r\v]*\n)+", (text or "").lower())):
        lines = [licenses.words_of(x) for x in part.split("\n")]
        paragraphs += any(lines)
        hits = [i for i, x in enumerate(lines) if licenses.features_of(x) & set(model.weights)]
        alone = [f for i in hits if (f := family(licenses.features_of(lines[i])))]
        wide = []
        for a in range(len(hits)):
            for b in range(a + 1, len(hits)):
                inside = [lines[i] for i in hits[a : b + 1]]
                if sum(map(len, inside[1:-1])) > longest or hits[b] - hits[a] > 2 * len(inside):
                    continue
                own = set().union(*map(licenses.features_of, inside))
                own |= {f"{lines[i - 1][-1]} {lines[i][0]}" for i in hits[a + 1 : b + 1] if lines[i - 1] and lines[i]} & set(model.weights)
                if (f := family(own)) and f[2]:
                    wide.append(f)
        sure = {k for k, _, ok in alone if ok}
        held = 0
        for i in hits:
            for f in licenses.features_of(lines[i]) | ({f"{lines[i - 1][-1]} {lines[i][0]}"} if i and lines[i - 1] else set()):
                held |= model.anchors.get(f, 0)
        rest = held & ~sum(1 << model.classes.index(k) for k in sure)
        for k, chance, ok in [*alone, *(wide if rest else [])]:
            predicted.add((nth, k))
            if ok:
                confirmed[nth, k] = max(chance, confirmed.get((nth, k), 0.0))
    return paragraphs, len(predicted), len(confirmed), ",".join(sorted({k for _, k in confirmed})), round(max(confirmed.values(), default=0.0), 6)


def test_sentences_held_out_are_recognised():
    learned, held_out = licenses.sentences()
    model = licenses.fit(learned)
    assert len(held_out) > 100 and {k for _, k in held_out} > {"mit", "gpl", licenses.UNKNOWN}
    right = 0
    for t, family in held_out:
        chances = model.chances(licenses.features_of(licenses.words_of(t)))
        top = max(chances, key=chances.get)
        right += (top if chances[top] >= licenses.LEAST_CHANCE else licenses.UNKNOWN) == family
    assert right >= 0.95 * len(held_out)


def test_texts_that_are_no_notice_of_the_module(spark):
    texts = {
        "GNU GPL v2": "gpl",
        "SPDX-License-Identifier: ISC": "isc",
        "Licensed under the EUPL": "eupl",
        "Code here is under the MIT license, enjoy": "mit",
        "he has a license to kill": "",
        "the library is open and the software is free of charge": "",
        "no rights were reserved for all of them": "",
    }
    rows = list(enumerate(texts))
    got = {r.doc_id: r.families for r in licenses.license_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {t: got[i] for i, t in rows} == texts


def test_license_report(spark):
    model = licenses.classifier()
    texts = [None, "", "\n\n", "Released under the MIT License.\nprose here\nLicensed under CC BY-NC 4.0.", "he has a license to kill", "word " * 30000]
    texts += [f"some prose\n{t}.\nmore\n \nother" for own in licenses.NOTICES.values() for t in own] + [*licenses.ALIKE, "GNU GENERAL PUBLIC LICENSE version 3 or later", "the of and"]
    texts += ["\n".join(textwrap.wrap(f"before it {a}. {b}.", 30)) for a, b in zip(licenses.NOTICES["gpl"], licenses.NOTICES["mit"])]
    texts += ["\n".join(licenses.ALIKE), "Released under\n\nthe MIT License", "Released under\nthe MIT License", "released\n" * 50 + "under MIT"]
    rows = [(i, t, "f") for i, t in enumerate(texts)] + [(None, texts[3], "f"), (3, texts[3], "f")]
    got = licenses.license_report(spark.createDataFrame(rows, "doc_id bigint, text string, families string")).collect()
    want = sorted((str(i), *plain_licenses(model, t)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_paragraphs, r.n_predicted, r.n_confirmed, r.families, round(r.chance, 6)) for r in got) == want
    assert licenses.license_report(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_marginals_are_those_of_all_taggings(monkeypatch):
    monkeypatch.setattr(toxicity, "ROW", 3)
    rng = np.random.default_rng(0)
    unary, transition, start = rng.normal(size=10), rng.normal(size=(2, 2)), 0.3
    first = np.zeros(10, bool)
    first[[0, 4, 5]] = True

    def plain(u):
        weight, ones, pairs = 0.0, np.zeros(len(u)), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=len(u)):
            w = math.exp(start * tags[0] + sum(a * b for a, b in zip(u, tags)) + sum(transition[a, b] for a, b in zip(tags, tags[1:])))
            weight += w
            ones += w * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                pairs[a, b] += w
        return ones / weight, pairs / weight

    parts = [plain(unary[:4]), plain(unary[4:5]), plain(unary[5:])]
    marginals, pairs = toxicity.chain_marginals(unary, first, transition, start, pairs=True)
    assert np.allclose(marginals, np.concatenate([m for m, _ in parts]))
    assert np.allclose(pairs, sum(p for _, p in parts))
    assert len(toxicity.chain_marginals(np.zeros(0), np.zeros(0, bool), transition, start)) == 0


def test_held_out_toxicity(spark):
    from tessera.session import table

    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    extra = spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (None, "you idiot"), (10**9 + 2, "fine words " * 20000), (10**9 + 3, "123")], "doc_id bigint, text string")
    found = toxicity.toxicity_report(docs.select("doc_id", "text").unionByName(extra), labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema)))
    rows = found.collect()
    assert len(rows) == docs.count() + 5
    assert all(0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    right = sum((s >= 0.5) == bool(y) for s, y in held)
    assert right >= 0.97 * len(held)
    assert [r.predicted for r in rows if (r.doc_id or 0) >= 10**9] == [0] * 4
    assert toxicity.toxicity_report(docs.limit(0), labels).count() == 0


def test_offsets():
    texts = ["a fine day", "you utter gronk there", "no"] * 40
    field = toxicity.learn(texts, [0, 1, 0] * 40)
    scores, spans = toxicity.Scorer(field).score(["Oh GRONK, hello", "a fine day", None])
    assert scores[0] > 0.5 > scores[1] and (3, 8) in spans[0] and spans[1] == [] and spans[2] == []
    assert toxicity.Scorer(field).score(["\u0130\u0130\u0130 gronk"])[1] == [[(4, 9)]]


def plain_score(field, text):
    """(score, offsets) by the definition: forward and backward over two tags, a token at a time."""
    found = [(m.span(), m.group()) for m in re.finditer(r"[^\W\d_]+", toxicity.folded(text))]
    unary = [field.unary(w) for _, w in found]
    t = np.exp(field.transition)
    alpha, beta = [], []
    for i, u in enumerate(unary):
        step = np.array([1.0, math.exp(max(-30, min(30, u)))])
        now = step * ([1.0, math.exp(field.start)] if not i else alpha[-1] @ t)
        alpha.append(now / now.sum())
    for i in reversed(range(len(unary))):
        now = np.ones(2) if i == len(unary) - 1 else t @ (beta[-1] * np.array([1.0, math.exp(max(-30, min(30, unary[i + 1])))]))
        beta.append(now / now.sum())
    p = [(a * b)[1] / (a * b).sum() for a, b in zip(alpha, reversed(beta))]
    sure = [x if x >= toxicity.FLOOR else 0.0 for x in p]
    none, mass = sum(math.log1p(-min(x, 1 - 1e-6)) for x in sure), sum(sure)
    some = min(max(-math.expm1(none), 1e-6), 1 - 1e-6)
    n = len(p)
    x = [1.0, math.log(some) - max(none, -14.0), math.log1p(mass), 10 * math.sqrt(mass / max(n, 1)), math.log1p(n) / 10]
    return 1 / (1 + math.exp(-float(np.dot(x, field.curve)))), ",".join(f"{a}:{b}" for ((a, b), _), y in zip(found, p) if y >= 0.5)


def test_scores_are_those_of_the_definition(spark):
    from tessera.session import table

    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    docs = docs.unionByName(spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (10**9 + 2, "12 !")], docs.schema))
    field = toxicity.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    want = {r.doc_id: plain_score(field, r.text or "") for r in docs.collect()}
    got = toxicity.toxicity_report(docs, labels).collect()
    assert len(got) == len(want) and any(r.spans for r in got)
    assert all(abs(r.score - want[r.doc_id][0]) < 1e-6 and r.spans == want[r.doc_id][1] and r.n_spans == len([x for x in r.spans.split(",") if x]) for r in got)
