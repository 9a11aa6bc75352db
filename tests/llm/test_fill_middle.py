"""Fill-in-the-middle against plain slices of the list of units."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lettermill.llm import fill_middle

from .fixtures import empty, frame

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bc", " ", "é", "\n", "\U0001f600", "1", "<", "P", ">"]), max_size=60), st.sampled_from([1, 2, 7, 100]), st.sampled_from([1, 3, 16, 1000]))
def test_every_cut_is_found_from_its_checkpoint(parts, every, block):
    text = "".join(parts)
    units, data = UNITS.findall(text), np.frombuffer(text.encode(), np.uint8)
    index = fill_middle.count(data, every, block)
    assert (index.units, index.points, len(index.byte_at)) == (len(units), len(text), -(-len(units) // every))
    for cut in range(len(units) + 1):
        before = "".join(units[:cut])
        assert fill_middle.seek(data, index, cut, block) == (len(before.encode()), len(before))


def test_one_unit_longer_than_many_blocks():
    data = np.frombuffer(("é" + "x" * 50_000 + "!").encode(), np.uint8)
    index = fill_middle.count(data, 1, 512)
    assert index.units == 3 and [fill_middle.seek(data, index, c, 512) for c in range(4)] == [(0, 0), (2, 1), (50_002, 50_001), (50_003, 50_002)]


def plain(id_, text):
    text, digest = text or "", hashlib.sha256(f"1:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNITS.findall(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return id_, text, "plain", len(units), None, None
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return id_, f"<S>{s}<P>{p}<M>{m}", "spm", len(units), len(p), len(m)
    return id_, f"<P>{p}<S>{s}<M>{m}", "psm", len(units), len(p), len(m)


@pytest.mark.parametrize("every", [1, 64, fill_middle.EVERY])
def test_transform_and_restore(spark, every):
    extra = [(100 + k, t, None, None, 0, 0, "", "", "") for k, t in enumerate(["<P> inside", "a<S>", "<M>", "ends with <", "<P", "<S <M S> P>" * 9, "zwölf Boxkämpfer < P > " * 4000])]
    docs = frame(spark).unionByName(spark.createDataFrame(extra * 3, frame(spark).schema))
    got = fill_middle.transform(docs, every=every).withColumn("restored", fill_middle.restore(fill_middle.F.col("output"), fill_middle.F.col("form"))).collect()
    want = Counter(plain(r["doc_id"], r["text"]) for r in docs.collect())
    assert Counter(tuple(r[c] for c in ("doc_id", "output", "form", "n", "prefix_chars", "middle_chars")) for r in got) == want
    assert Counter((r["doc_id"], r["restored"]) for r in got) == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert {"psm", "plain"} <= {r["form"] for r in got}


def test_markers_cannot_arise_at_the_seams(spark):
    """Pieces that end or begin with parts of a marker, in both orders."""
    texts = [(k, t) for k in range(60) for t in ("<<<", "<P<S<M", "P>S>M>", "<P<S>"[:4] + "M>")]
    got = fill_middle.transform(spark.createDataFrame(texts, "doc_id long, text string"))
    got = got.select("doc_id", "form", fill_middle.restore(fill_middle.F.col("output"), fill_middle.F.col("form")).alias("text")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(texts) and {"psm", "spm"} <= {r["form"] for r in got}


def test_no_rows(spark):
    assert fill_middle.transform(empty(spark)).count() == 0
