import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from storelens.llm.packing import OpenBins, assemble, pack_documents
from storelens.llm.repair_tokens import compress, decode_range, expand, read_token_ids, write_token_ids
from storelens.llm.token_counts import count_tokens, scan_token_files, write_token_files
from storelens.llm.tokens import ChunkEncoder
from tests.llm.conftest import rows_of, words


def plain(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [np.array(e.ids, "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_ids_equal_whole_ids(name, odd_texts, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [t or "" for t in odd_texts] + [
        "".join(rng.choice(list("aB1 .,'\n\t-_éÀß<|>\r\x0b’½ªİK中"), 60)) for _ in range(400)]
    want = [x.tobytes() for x in plain(name, texts)]
    assert ChunkEncoder(name).encode(texts) == want
    assert ChunkEncoder(name, capacity=50).encode(texts) == want
    import storelens.llm.tokens as tokens
    monkeypatch.setattr(tokens, "PIECE_CHARS", 500)  # long texts are cut into pieces
    assert ChunkEncoder(name).encode(texts) == want


def test_packing_is_whole_gapless_and_tight(spark, frame, odd_texts):
    rng = np.random.default_rng(4)
    texts = odd_texts + [" ".join(words(rng, "de", int(n))) for n in rng.integers(1, 900, 300)]
    rows = rows_of(texts)
    docs = {r[0]: np.append(x, 0).astype("<u4") for r, x in zip(rows, plain("byte_bpe_50k.json", texts))}
    packed = pack_documents(frame(rows), with_ids=True)
    got = packed.collect()
    covered, places = defaultdict(list), defaultdict(list)
    for r in got:
        part = docs[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.ids == part.tobytes()
        assert r.piece == 0 or r.length == 2048
        covered[r.doc_id].append((r.piece, r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for d, parts in covered.items():
        parts.sort()
        assert [p for p, _, _ in parts] == list(range(len(parts)))
        assert sum(n for _, _, n in parts) == len(docs[d]) and parts[0][1] == 0
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert sum(n for _, n in spans) <= 2048
    assert len(places) <= 1.03 * sum(map(len, docs.values())) / 2048 + 2
    whole = {r.sequence_id: r.ids for r in assemble(packed).collect()}
    assert sorted(len(v) // 4 for v in whole.values()) == sorted(sum(n for _, n in s) for s in places.values())
    assert pack_documents(frame([])).count() == 0
    assert pack_documents(frame(rows_of(["same"]) * 5)).count() == 5


def test_open_bins_best_fit_and_bound():
    bins = OpenBins(10, open_bins=2)
    assert [bins.place(n) for n in (6, 7, 3, 4, 9)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    bins = OpenBins(10, open_bins=2)
    assert [bins.place(n) for n in (6, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # a third open bin closes the fullest, 1
    assert bins.place(3) == (0, 6) and bins.place(2) == (2, 8)


def test_token_counts_from_flat_files(spark, frame, odd_texts, tmp_path):
    rows = rows_of(odd_texts)
    want = {r[0]: len(x) for r, x in zip(rows, plain("byte_bpe_50k.json", odd_texts))}
    got = count_tokens(frame(rows).repartition(3), str(tmp_path / "a")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(rows)
    assert count_tokens(frame(rows_of(["same"]) * 3), str(tmp_path / "b")).count() == 3
    assert count_tokens(frame([]), str(tmp_path / "c")).count() == 0


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_scan_stitches_documents_over_blocks(spark, frame, odd_texts, tmp_path, block):
    path = str(tmp_path / "files")
    write_token_files(frame(rows_of(odd_texts[:9] + odd_texts[12:])).coalesce(1), path, shard_bytes=400)
    (tmp_path / "tail").mkdir()
    ids = np.array([5, 6, 50256, 50256, 7, 8, 9], "<u2")  # ids after the last separator
    (tmp_path / "tail" / "shard.bin").write_bytes(ids.tobytes())
    small = scan_token_files(spark, str(tmp_path / "tail"), block_ids=block).orderBy("number").collect()
    assert [(r.start, r.n_tokens, r.ended) for r in small] == [(0, 2, True), (3, 0, True), (4, 3, False)]
    found = scan_token_files(spark, f"{path}/kind=ids", block_ids=block).orderBy("shard", "number").collect()
    want = [len(x) for x in plain("byte_bpe_50k.json", odd_texts[:9] + odd_texts[12:])]
    assert [r.n_tokens for r in found] == want and len({r.shard for r in found}) > 1


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(9)
    for ids in (np.zeros(0, "<u4"), np.array([1], "<u4"), np.full(999, 3, "<u4"), rng.integers(0, 6, 20_000).astype("<u4"),
                np.tile(rng.integers(2, 50, 40), 500).astype("<u4")):
        s, left, right, span = compress(ids, 50, end_id=1, min_count=4)
        assert (expand(s, 50, left, right) == ids).all()
        if len(ids) > 900:
            assert len(s) < len(ids)
        for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids) // 2, len(ids) // 2)):
            if b > a:
                assert (decode_range(s, 50, left, right, span, a, b) == ids[a:b]).all()
        # No symbol but the last of a document may hold the end id.
        for sym in np.unique(s[s >= 50]) if len(s) else ():
            assert 1 not in expand(np.array([sym]), 50, left, right)[:-1]


def test_token_files_are_in_id_order_and_decode(spark, frame, odd_texts, tmp_path):
    rng = np.random.default_rng(6)
    texts = odd_texts + [" ".join(words(rng, "fr", 200)) for _ in range(60)]
    rows = rows_of(texts)
    path = str(tmp_path / "ids")
    write_token_ids(frame(rows).repartition(5), path, shard_ids=3000, min_count=4)
    got = sorted(read_token_ids(spark, path).collect())
    start = 0
    for r, doc, ids in zip(got, rows, plain("word_bpe_49k.json", texts)):
        ids = np.append(ids, 1).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc[0], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(rows)
    write_token_ids(frame([]), str(tmp_path / "none"))
    assert read_token_ids(spark, str(tmp_path / "none")).count() == 0
    write_token_ids(frame([(None, "x", *[None] * 8), (2, "x", *[None] * 8), (2, "x", *[None] * 8)]), str(tmp_path / "nulls"))
    assert sorted((r.doc_id or -1, r.start) for r in read_token_ids(spark, str(tmp_path / "nulls")).collect()) == \
        [(-1, 0), (2, 2), (2, 4)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_tokens_as_the_tokenizer_has_them(name):
    texts = ["a <|endoftext|> b", "<|startoftext|>a<|ENDOFTEXT|> <|endoftext", "plain words", "<|endoftext|>" * 3, "中 <|endoftext|>"]
    want = [np.array(e.ids, "<u4").tobytes() for e in
            Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)]
    assert ChunkEncoder(name, plain_specials=False).encode(texts) == want
    assert ChunkEncoder(name).encode(texts) != want


def test_queries_give_the_ids_of_the_plain_tokenizer(spark, frame, tmp_path):
    import corpus_pipeline
    from storelens.llm.catalog import QUERIES
    texts = ["a <|endoftext|> b", "some words", "<|startoftext|><|endoftext|>"]
    docs = frame(rows_of(texts))
    docs.write.parquet(str(tmp_path / "documents.parquet"))

    def want(name, end_id):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        return [np.array([*t.encode(x, add_special_tokens=False).ids, end_id], "<u4") for x in texts]

    packed = [(i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(want("byte_bpe_50k.json", 0))]
    for got in (QUERIES["op4_best_fit_packing"](spark, str(tmp_path)), dict(corpus_pipeline.STAGES)["packing"](spark, docs, "")):
        assert sorted((r.doc_id, r.length, r.ids_crc32) for r in got.collect()) == packed
    ids = want("word_bpe_49k.json", 1)
    starts = np.cumsum([0, *map(len, ids)]).tolist()
    got = sorted(QUERIES["op6_token_ids"](spark, str(tmp_path)).collect())
    assert [tuple(r) for r in got] == [(i, starts[i], len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(ids)]


def test_pieces_of_few_long_documents_are_spread_over_tasks(spark, frame):
    rng = np.random.default_rng(11)
    texts = [" ".join(words(rng, "en", 15_000)) for _ in range(2)]
    got = pack_documents(frame(rows_of(texts)), pieces_per_task=20).collect()
    tasks = defaultdict(int)
    for r in got:
        tasks[r.sequence_id >> 40] += 1
    assert len(tasks) > 1 and max(tasks.values()) < len(got) / 2 + 10
    assert {d: sum(r.length for r in got if r.doc_id == d) for d in (0, 1)} == {
        i: len(x) + 1 for i, x in enumerate(plain("byte_bpe_50k.json", texts))}
