"""The Merkle manifest against a plain level-by-level tree, and the layout's arithmetic."""

import zlib
from hashlib import sha256

import numpy as np
import pytest

from storelens.llm import merkle as M
from tests.llm.conftest import rows_of


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(nodes, fanout):
    """All levels of the tree over the nodes, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([h(*level[i:i + fanout]) for i in range(0, len(level), fanout)])
    return levels


def way(levels, i, fanout):
    """Left and right siblings of node ``i`` on the way up."""
    out = []
    for level in levels[:-1]:
        a = i - i % fanout
        out.append(("".join(level[a:i]), "".join(level[i + 1:a + fanout])))
        i //= fanout
    return out


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows, fanout):
    """Expected (doc_id, leaf, subroot, root, proof, folded, verified) rows."""
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = h(*[field(v) for v in (doc_id, source, lang, n_chars, text)])
        changed = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            changed = h(*[field(v) for v in (doc_id, source, lang, n_chars, low)])
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, changed, doc_id))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])], fanout) for g in order}
    whole = tree([trees[g][-1][0] for g in order], fanout) if order else []
    out = []
    for n, g in enumerate(order):
        for i, (_, _, leaf, changed, doc_id) in enumerate(sorted(groups[g])):
            path = way(trees[g], i, fanout) + way(whole, n, fanout)
            digest = changed
            for left, right in path:
                digest = h(left, digest, right)
            root = whole[-1][0]
            out.append((doc_id, leaf, trees[g][-1][0], root, h(*[a + b for a, b in path]), digest, digest == root))
    return out


def result(df):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"])
                   for r in df.collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5, 6])
def test_addresses_are_a_layout_of_nested_subtrees(levels):
    for fanout in (2, 3, 8):
        if fanout ** levels > 40_000:
            continue
        at = [M.address(levels, d, np.arange(fanout ** d), fanout) for d in range(levels)]
        assert sorted(np.concatenate(at).tolist()) == list(range(M.tree_size(levels, fanout)))
        if levels > 1:  # the upper half comes first, then each subtree below in one stretch
            top = levels // 2
            assert max(a.max() for a in at[:top]) == M.tree_size(top, fanout) - 1
            size = M.tree_size(levels - top, fanout)
            for d in range(top, levels):
                tree_of = (at[d] - M.tree_size(top, fanout)) // size
                assert tree_of.tolist() == (np.arange(fanout ** d) // fanout ** (d - top)).tolist()


def test_block_siblings_fold_to_the_root():
    for n in (1, 2, 8, 9, 64, 65, 300):
        digests = [h(str(i)) for i in range(n)]
        levels = tree(digests, 8)
        layout, root = M.build_layout(digests, len(levels) - 1)
        assert root == levels[-1][0] and len(layout) % M.DIGEST_BYTES == 0
        siblings = M.sibling_strings(layout, n, len(levels) - 1)
        for i in range(n):
            path = M.proof_of(siblings, i)
            assert path == way(levels, i, 8) and M.fold(digests[i], path) == root


@pytest.mark.parametrize("block_levels,fanout", [(1, 2), (2, 2), (1, 8), (4, 8)])
def test_manifest_equals_brute_force(frame, odd_texts, block_levels, fanout):
    rows = rows_of(odd_texts) + rows_of([f"Text NUMBER {i}" for i in range(60)], 100)
    rows += [(None, "No id A", "en", None, 7, *rows[0][5:]), (None, None, None, None, None, *rows[0][5:])]
    rows += [rows[30], rows[30], (10 ** 17 + 1, "Big ID", "zz", "s", 1, *rows[0][5:])]
    got = result(M.manifest(frame(rows), block_levels=block_levels, fanout=fanout))
    assert got == sorted(brute([(r[0], r[1], r[2], r[3], r[4]) for r in rows], fanout), key=repr)
    assert any(not g[-1] for g in got) and any(g[-1] for g in got)


def test_single_leaf_and_empty_table(frame):
    one = result(M.manifest(frame(rows_of(["only"]))))
    assert one == brute([(0, "only", "en", "src0", 4)], 8)
    assert one[0][1] == one[0][2] == one[0][3] and one[0][4] == h("")
    empty = M.manifest(frame([]))
    assert empty.count() == 0 and {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"} <= set(empty.columns)
