"""Notices that are wrapped, as license files and source headers have them."""

from __future__ import annotations

import textwrap

from tessera.llm import licenses


def test_wrapped_notices_are_confirmed(spark):
    rows, want = [], {}
    for family in ("mit", "bsd", "gpl"):
        notice = max(licenses.NOTICES[family], key=len)
        for width in (40, 75):
            for mark in ("", " * ", "# "):
                lines = [mark + x for x in textwrap.wrap(notice, width)]
                for text in ("\n".join(lines), "\n".join(["prose before it", *lines, "prose after it"])):
                    want[len(rows)] = family
                    rows.append((len(rows), text))
                want[len(rows)] = ""
                rows.append((len(rows), "\n\n".join(lines[:1] + ["prose"] * 3)))
    got = licenses.license_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.families for r in got} == want
    assert all((r.n_confirmed > 0) == (r.families != "") for r in got)
