from __future__ import annotations

import pytest

#: Texts that are empty, null, odd, long or repeated.
ODD = ["", None, "a", "  ", "CC-BY cc by; Cc\nBy General  Public LICENSE all rights reserved", "SPDX-License-Identifier: MIT OR (Apache-2.0 AND GPL-2.0 WITH Classpath-exception)\nmore", "don't 'tis  x's)'s \n\n é\n\né 12ab34 <|endoftext|> 日本 テスト",
       "word " * 3000, "the same words in a row are here again and again", "the same words in a row are here again and again", "   x \n y", "You idiot, " * 3, "x" * 3000]


@pytest.fixture
def odd(spark):
    """Documents with columns whose names clash with those of the operators."""
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), 0.5, "k") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, id string")
