from __future__ import annotations

import random

import pytest

TRICKY = [
    None,
    "",
    " ",
    "\n\n \t",
    "Hello world, it's 2024's best-of!  Two  spaces.",
    "tabs\tand\x0bvertical\x0cfeeds\r\nand\x1ccontrol\x1f \x85 next",
    "naïve café Ünïcödé ÀÉÎ ßtraße Ⅷ ½ ² ٣ x́ é ﬁ",
    "日本語のテキスト 和中文 混ざる 한국어",
    "emoji 😀👩‍👩‍👧 🇩🇪 end",
    "<|endoftext|> inside <|endoftext|> and <|startoftext|> too",
    "a" * 3000,
    "ab" * 500 + " " + "!" * 700,
    "  leading and trailing   ",
    "nbsp here wide　ideographic",
    "ΣΑΣ ΟΔΟΣ İstanbul K Å ǅ",
    "zero​width ﻿bom \u0000nul",
    "don't we'll they've I'M CAN'T 's 'S 'd",
    "1234567890 12.5e-7 0x1F",
    "\U0001d400\U0001d7d8 math  private",
    "repeat repeat repeat repeat " * 40,
]


@pytest.fixture(scope="session")
def tricky():
    return TRICKY


@pytest.fixture(scope="session")
def documents(spark):
    """Tricky texts, repeated rows, a null id, and columns with clashing names."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 0.5, "x", 7) for i, t in enumerate(TRICKY)]
    rows += [rows[4], (None, "no id at all", None, None, 1, 0.1, "y", 8), (4, "the same id with another text", "en", "s1", 3, 0.2, "z", 9)]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, host string, n long"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.where("false")


@pytest.fixture(scope="session")
def word_soup():
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    return lambda n: " ".join(r.choice(words) for _ in range(n))
