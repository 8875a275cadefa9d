"""A text longer than a block of 2 MB, whose repeats and finds lie megabytes apart."""

from __future__ import annotations

import hashlib
import random

import pytest

from amtskompass.llm import crf, inverted, recompress, suffixes
from amtskompass.llm.blocks import BLOCK_BYTES

PASSAGE = " ".join(f"passage{k}" for k in range(60))  # more than 400 bytes
MAIL, CALL = "jane.doe@example.org", "+49 30 5550 12345"


@pytest.fixture(scope="module")
def long_text():
    rnd = random.Random(5)
    filler = [" ".join(str(rnd.getrandbits(60)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(80_000)) for _ in range(2)]
    text = f"{filler[0]} {PASSAGE} {MAIL} {filler[1]} {PASSAGE} {CALL} end"
    assert len(text) > BLOCK_BYTES * 1.3
    return text


@pytest.fixture(scope="module")
def docs(spark, long_text):
    return spark.createDataFrame([(1, f"start {PASSAGE} stop"), (2, long_text), (3, "short")], "doc_id long, text string")


def test_repeated_windows(docs, long_text):
    got = {r["doc_id"]: r for r in recompress.removed_windows(docs).collect()}
    kept = " ".join(w for w in long_text.split() if not w.startswith("passage"))
    assert (got[1]["n_removed"], got[2]["n_removed"], got[3]["n_removed"]) == (0, 120, 0)
    assert got[2]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_repeated_strings(docs, long_text):
    got = {r["doc_id"]: r for r in suffixes.removed_strings(docs).collect()}
    kept = long_text.replace(f" {PASSAGE} ", "")  # the blanks around the passage are repeated with it
    assert (got[2]["n_bytes"], got[2]["n_removed"], got[2]["n_spans"]) == (len(long_text), 2 * (len(PASSAGE) + 2), 2)
    assert got[2]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()


def test_personal_data(docs, long_text):
    got = {r["doc_id"]: r for r in crf.personal_data(docs).collect()}
    a, b = long_text.index(MAIL), long_text.index(CALL)
    want = f"email:{a}:{a + len(MAIL)},phone:{b}:{b + len(CALL)}"
    assert (got[2]["n_email"], got[2]["n_phone"]) == (1, 1)
    assert got[2]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()


def test_contamination(spark, docs, long_text):
    items = spark.createDataFrame([("a", PASSAGE), ("b", "end")], "item_id string, text string")
    got = {r["doc_id"]: r for r in inverted.contamination(docs, items).collect()}
    assert (got[2]["n_hit"], got[2]["n_items"], got[2]["contaminated"]) == (121, 2, False)
    assert (got[1]["n_hit"], got[1]["contaminated"], got[3]["n_hit"]) == (60, True, 0)
