"""Whole licence texts under other titles, notices and line breaks."""

import re
import textwrap
from pathlib import Path

import pytest

from memloom.llm.licenses import KNOWN, TITLED, known_digests, known_licenses, license_scan

FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def scan(spark, docs):
    return {r["doc_id"]: r["license_id"] for r in license_scan(docs, known_licenses(spark), digests=known_digests(spark)).collect()}


def test_titles_notices_and_line_breaks(spark, docs_of):
    want, rows = [], []
    for name, (body, titles) in TITLED.items():
        for head in ("", *[t + "\n\n" for t in titles]):
            for notice in ("", "Copyright (c) 2019-2021 Jane Doe\n", "Copyright 2020 by A. Owner. All rights reserved.\n"):
                for width in (60, 76, 78, 80, 10**6):
                    text = head + notice + "\n".join(textwrap.wrap(body, width))
                    rows.append(text if width < 10**6 else text.replace("\n", " "))
                    want.append(name)
    got = scan(spark, docs_of(rows))
    assert [got[i] for i in range(len(rows))] == want


def test_terms_are_not_deleted(spark, docs_of):
    """A line of terms that starts with the word, or text after a notice, makes another text."""
    mit = TITLED["MIT"][0]
    rows = ["Copyright (c) 2020 Me\nCopyright holders may not do this.\n" + mit, mit + "\nAnd more terms.", "A prose with the word software."]
    assert set(scan(spark, docs_of(rows)).values()) == {None}


@pytest.mark.skipif(not Path("/usr/share/common-licenses").is_dir(), reason="no licence texts on this machine")
def test_long_licences(spark, docs_of):
    texts = {k: Path("/usr/share/common-licenses", f).read_text(errors="replace") for f, k in FILES.items()}
    rows = [x for t in texts.values() for x in (t, re.sub(r"[ \t]*\n[ \t]*", "\n", t))]
    got = scan(spark, docs_of(rows))
    assert [got[i] for i in range(len(rows))] == [k for k in texts for _ in range(2)]
    assert scan(spark, docs_of([KNOWN["MIT-notice"]])) == {0: "MIT-notice"}
