import hashlib
import re

import pytest

from storelens.llm.exact_dedup import exact_dedup
from tests.llm.conftest import rows_of


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d))
    return {k: (min(v)[2], len(v)) for k, v in groups.items()}, norm


@pytest.mark.parametrize("first,growth", [(64, 16), (1, 2)])
def test_matches_brute_force(frame, odd_texts, first, growth):
    texts = odd_texts + ["a b", "ab ", "abc", "abcd", "abce", "a" * 63, "a" * 64, "a" * 65, "a" * 64 + " ", "é" * 40, "é" * 40]
    rows = rows_of(texts)
    groups, norm = brute([(r[0], r[1]) for r in rows])
    text = {r[0]: r[1] for r in rows}
    got = exact_dedup(frame(rows), first, growth).collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    for r in got:
        keep, size = groups[norm(text[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (keep, size, keep == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(norm(text[r.doc_id]).encode()).hexdigest()


def test_repeated_rows_keep_one_and_empty_table(frame):
    rows = [(5, "same text", None, None, None, None, None, None, None, None)] * 4 \
        + [(None, "same  text", None, None, None, None, None, None, None, None)]
    got = exact_dedup(frame(rows)).collect()
    assert sum(r.kept for r in got) == 1 and {r.group_size for r in got} == {5}
    assert {r.keep_id for r in got} == {None}  # the longest original stays, even without an id
    assert exact_dedup(frame([])).count() == 0
