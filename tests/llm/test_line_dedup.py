import hashlib

from storelens.llm.line_dedup import dedup_lines
from tests.llm.conftest import rows_of

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """(id, kept text, lines, dropped) of every row, by the contract's words."""
    key = lambda x: x.strip(WHITE).translate(LOWER)
    holders = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(d)
    order = lambda d: (d is not None, d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3
                                         and d != max(holders[key(x)], key=order))]
        out.append((d, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in dedup_lines(df).collect()], key=repr)


def test_matches_brute_force_on_odd_texts(frame, odd_texts):
    rows = rows_of(odd_texts)
    assert got(frame(rows)) == brute([(r[0], r[1]) for r in rows])


def test_repeated_ids_null_ids_and_many_lines(frame):
    line = "É a line that is long enough to count"
    texts = [(1, f"{line}\nx"), (1, f"y\n{line.lower()}"), (1, f"{line}\nx"), (None, line), (2, f" {line}\n{line}"), (3, "z"),
             (4, "\n".join(f"common line number {i:04d}, kept once" for i in range(3000)))]
    texts += [(i, texts[-1][1]) for i in (5, 6)]
    rows = [(d, t, None, None, None, None, None, None, None, None) for d, t in texts]
    assert got(frame(rows)) == brute(texts)


def test_empty_table_and_columns_pass_through(frame):
    assert dedup_lines(frame([])).count() == 0
    df = dedup_lines(frame(rows_of(["a", None])))
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "kept", "piece", "_row", "score",
                          "n_lines", "n_dropped"]
    assert {r.doc_id: (r.text, r.size, r._row) for r in df.collect()} == {0: ("a", "x", 7), 1: ("", "x", 7)}


def test_main_path_has_no_python(spark, frame):
    plan = dedup_lines(frame(rows_of(["a"])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_digest_is_sha256_of_kept_text(spark):
    from storelens.llm.catalog import QUERIES
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {d: hashlib.sha256(t.encode()).hexdigest() for d, t, *_ in brute([(r.doc_id, r.text) for r in docs])}
    assert {r.doc_id: r.kept_sha256 for r in QUERIES["op10_line_dedup"](spark, sf).collect()} == want
