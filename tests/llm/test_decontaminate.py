"""Suffix automaton scans against brute force."""

from __future__ import annotations

import hashlib
import random
import re

from tessera.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, window=13):
    windows = {}
    for name, text in items:
        w = plain_words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(name)
    out = []
    for doc, text in rows:
        w, hit, own = plain_words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    own |= windows[tuple(w[i : i + k])]
        names = sorted(str(x) for x in own if x is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((str(doc), len(w), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def fixture():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(6)] + ["Été", "naïve", "X9"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 12, 13, 14, 40])))) for i in range(12)]
    items += [(50, None), (51, " ,.; "), (None, "alpha beta gamma"), (7, items[3][1])]
    rows = []
    for i in range(80):
        text = " ".join(rng.choices(words + ["other", "THING"], k=rng.randrange(0, 120)))
        if i % 3 == 0:
            text += ". " + rng.choice(items[:12])[1].upper() + "! " + " ".join(rng.choices(words, k=30))
        rows.append((i, text))
    rows += [(None, items[4][1]), (90, None), (91, ""), (92, "Alpha, beta--gamma"), (93, "dup " * 5), (93, "dup " * 5), (94, "w1 w2 " * 40000)]
    return rows, items


def test_scan_is_the_plain_one(spark):
    rows, items = fixture()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, hits string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = dc.contamination(docs, bench).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == plain(rows, items)
    # The same with automata that hold a few items each.
    hit = dc.scan_documents(docs, bench, most=30)
    split = {(str(r.doc_id), r.n_words, tuple(map(tuple, r.hits)), tuple(r["items"])) for r in hit.collect()}
    whole = {(str(r.doc_id), r.n_words, tuple(map(tuple, r.hits)), tuple(r["items"])) for r in dc.scan_documents(docs, bench).collect()}
    assert split == whole
    assert dc.contamination(docs.limit(0), bench).count() == 0
    assert dc.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_removal(spark):
    item = " ".join(f"q{i}" for i in range(13))
    long = " ".join(f"z{i}" for i in range(400))
    docs = spark.createDataFrame(
        [(1, f"{long}, {item.upper()}! {long}", 5), (2, f"so {item} so", 6), (3, long, 7), (4, None, None)], "doc_id bigint, text string, n_chars bigint"
    )
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r.doc_id: r for r in dc.decontaminate(docs, bench).collect()}
    assert set(got) == {1, 3, 4}
    assert got[1].text == f"{long}, ! {long}" and got[1].n_chars == len(got[1].text)
    assert got[3].text == long and got[3].n_chars == 7 and got[4].text is None
    more = spark.createDataFrame([(2, " ".join(f"z{i}" for i in range(50, 63))), (3, "so q0"), (4, None)], bench.schema).unionByName(bench)
    clash = docs.withColumn("hits", docs.doc_id)
    whole, split = (sorted(map(str, dc.decontaminate(clash, more, most=most).collect())) for most in (10**6, 10))
    assert whole == split and len(whole) == 3
    assert {r.hits for r in dc.decontaminate(clash, more, most=10).collect()} == {1, 3, 4}
    assert dc.decontaminate(docs, bench.limit(0)).count() == 4 and dc.decontaminate(docs.limit(0), bench).count() == 0
