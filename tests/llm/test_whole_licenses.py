"""Whole license files, with and without their usual title lines."""

import pytest

from terrane.llm import licenses

BODIES = {name: text for name, text in licenses.KNOWN if name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause") and len(text) > 200}
TITLED = [("MIT", "The MIT License (MIT)"), ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("ISC", "ISC License")]
WHOLE = ["Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0", "Unlicense"]


def test_titles_and_whole_texts(spark):
    read = lambda name: (licenses.TEXTS / f"{name}.txt").read_text(encoding="utf-8")
    cases = [(name, f"{title}\n\nCopyright (c) 2021, Someone\nAll rights reserved.\n\n{BODIES[name]}\n") for name, title in TITLED]
    cases += [("BSD-3-Clause", "Copyright 2021 Someone\n\n" + "\n".join(f"* {x[3:]}" if x[:2] in ("1.", "2.", "3.") else x for x in BODIES["BSD-3-Clause"].split("\n")))]
    cases += [(name, read(name)) for name in WHOLE] + [("Unlicense", "The Unlicense\n\n" + read("Unlicense"))]
    cases += [(name, read(name).split("END OF TERMS AND CONDITIONS")[0]) for name in ("Apache-2.0", "GPL-2.0-only", "GPL-3.0-only")]
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(cases)] + [(-1, read("GPL-3.0-only")[:20_000])], "doc_id long, text string")
    found = {r.doc_id: r.whole_license for r in licenses.scan(docs).collect()}
    assert [found[i] for i in range(len(cases))] == [name for name, _ in cases] and found[-1] is None


@pytest.mark.parametrize("name", WHOLE)
def test_texts_are_whole(name):
    assert (licenses.TEXTS / f"{name}.txt").stat().st_size > 1000
