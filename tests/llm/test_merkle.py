"""The Merkle manifest against a tree of plain lists."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from lettermill.llm import merkle

from .fixtures import empty, frame

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def walk(tree, at, digest):
    """Siblings of the node at ``at``, and where ``digest`` in its place leads to."""
    near = ""
    for nodes in tree[:-1]:
        low = at - at % 8
        run = nodes[low : low + 8]
        near += "".join(run[: at - low] + run[at - low + 1 :])
        digest = sha("".join(run[: at - low] + [digest] + run[at - low + 1 :]))
        at //= 8
    return near, digest


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = levels([x[2] for x in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    root, out = top[-1][0], Counter()
    for number, g in enumerate(order):
        for at, (_, _, own, r) in enumerate(groups[g]):
            changed = own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                changed = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
            near, subroot = walk(trees[g], at, changed)
            above, folded = walk(top, number, subroot)
            out[r["doc_id"], own, trees[g][-1][0], root, sha(near + above), folded, folded == root] += 1
    return out


def check(docs):
    got = merkle.manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(tuple(r) for r in got.collect()) == expected(docs.collect())


def test_awkward_rows(spark):
    check(frame(spark))


def test_table(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@pytest.mark.parametrize("sizes", [(1,), (8, 1), (9, 64, 65), (512, 513, 7), (4097,)])
def test_short_runs_and_several_rounds(spark, sizes):
    rows = [(k * 7 + g, f"Text {k}", f"l{g}", None, k) for g, n in enumerate(sizes) for k in range(n)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(7))


def test_many_languages(spark):
    rows = [(k, "A", None if k == 5 else f"é{k % 600}" if k % 2 else f"z{k % 600}", "s", 1) for k in range(1300)]
    check(spark.createDataFrame(rows, SCHEMA))


def test_places_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PARTITION_ROWS", 13)
    rows = [(k // 3 if k % 5 else None, f"Row {k % 40}", ["a", None, "b"][k % 7 % 3], "s", k % 4) for k in range(400)] + [(9, "same", "a", "s", 1)] * 60
    check(spark.createDataFrame(rows, SCHEMA).repartition(5))


def test_no_rows(spark):
    assert merkle.manifest(empty(spark)).count() == 0
