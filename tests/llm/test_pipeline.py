"""The pipeline against plain Python, stage by stage, each judged on its own input."""

from collections import defaultdict

import corpus_pipeline
import numpy as np

from lettermill.llm import decontam, ngram_join, queries

from .fixtures import frame
from .test_models import brute_join
from .test_native import WHITE
from .test_python import edit_distance_to_stretch, library  # noqa: F401


def test_stages_match_plain_python(spark, sf_dir, library):  # noqa: F811
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = [(r["item_id"], decontam.words_of(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns = docs.columns
    given = {r["doc_id"]: r for r in docs.collect()}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, sf_dir)
        path = f"{corpus_pipeline.new_path(spark, 'test')}"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        got = {r["doc_id"]: r for r in out.collect()}
        if name != "bpe_encoding":
            assert out.columns == columns and len(got) == out.count() and all(got[i] == given[i] for i in got)
        if name == "language_id":
            assert set(given) - set(got) == {i for i, r in given.items() if not any(map(str.isalpha, r["text"] or ""))}
        elif name == "exact_dedup":
            groups = defaultdict(list)
            for i, r in given.items():
                groups[WHITE.sub("", r["text"] or "")].append((-len(r["text"] or ""), i))
            assert set(got) == {min(g)[1] for g in groups.values()}
        elif name == "ngram_jaccard_join":
            assert set(got) == {i for i, _, c in brute_join([(i, r["text"]) for i, r in given.items()]) if i == c}
        elif name == "benchmark_decontamination":
            vocabulary = {w for _, item in benchmark for w in item}
            leaked = set()
            for i, r in given.items():
                words = decontam.words_of(r["text"])
                known = sum(w in vocabulary for w in words)
                if any(len(item) <= 1.25 * known and _near(item, words) for _, item in benchmark):
                    leaked.add(i)
            assert set(given) - set(got) == leaked and leaked
        else:
            assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got.values())
            assert {i: list(r["ids"]) for i, r in got.items()} == {i: library.encode_ordinary(r["text"]) for i, r in given.items()}
        docs, given = out, got
    assert corpus_pipeline.run(spark, sf_dir).count() == len(got)


def _near(item, words):
    """An intact segment first: without one the distance is too large."""
    edits = int(0.2 * len(item)) if len(item) >= 5 else 0
    size = len(item) // (edits + 1)
    runs = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
    if not any(tuple(item[k : k + size]) in runs for k in range(0, size * (edits + 1), size)):
        return False
    return decontam.best_stretch(np.array(item, object), np.array(words, object))[0] <= edits


def test_mixed_and_short_texts_keep_their_place(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    longest = [docs.where(f"lang = '{x}' and length(text) > 400").orderBy("doc_id").first()["text"] for x in ("de", "en", "es", "fr")]
    texts = {-1: " ".join(" ".join(t.split()[:40]) for t in longest), -2: "ok", -3: "no si", -4: "12 34 !?", -5: None}
    more = spark.createDataFrame([(i, t, None, "s", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(more), sf_dir).collect()}
    assert {-1, -2, -3} <= kept and not {-4, -5} & kept


def test_empty_tables_pass(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, sf_dir)
        path = corpus_pipeline.new_path(spark, "test")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() == 0 and "doc_id" in docs.columns


def test_awkward_documents_pass(spark, sf_dir):
    docs = frame(spark)
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, sf_dir)
        path = corpus_pipeline.new_path(spark, "test")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert 0 < docs.count() < frame(spark).count()


def _texts(n):
    rng = np.random.default_rng(n)
    return [" ".join(f"w{w}" for w in rng.integers(0, 10_000, 60)) for _ in range(n)]


def test_near_copies_without_or_with_repeated_ids(spark):
    a, b, c, d, e, f, g = _texts(7)
    rows = [(1, a), (None, a + " end"), (None, c)]  # a dropped and a clean row without an id
    rows += [(2, b), (5, b + " end"), (5, d)]  # a dropped and a clean row of one id
    rows += [(None, e), (None, e + " end"), (7, f), (7, f), (8, g), (8, g + " end"), (None, ""), (None, None)]
    got = [(r["doc_id"], r["text"]) for r in ngram_join.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    one_of = lambda *some: [r for r in got if r in some]
    assert all(got.count(r) == 1 for r in [(1, a), (None, c), (2, b), (5, d), (7, f), (None, ""), (None, None)])
    assert len(one_of((None, e), (None, e + " end"))) == 1 and len(one_of((8, g), (8, g + " end"))) == 1
    assert len(got) == 9


def test_leaks_without_or_with_repeated_ids(spark, sf_dir):
    leak = next(r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len(r["text"].split()) > 10)
    clean, other, leak_b = *_texts(2), "x " + leak
    rows = [(None, leak), (None, clean), (3, leak_b), (3, other), (4, leak)]
    out = corpus_pipeline.drop_leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert sorted(r["text"] for r in out.collect()) == sorted([clean, other])


def test_blocks_of_many_sets_keep_their_codes():
    """Codes of a later block are told from those of a large one before it."""
    import pyarrow as pa

    big = np.zeros(70_000, ngram_join._ENTRY)
    big["set"], big["n"], big["filled"] = np.arange(70_000), 10, 10
    small = np.zeros(2, ngram_join._ENTRY)
    small["set"], small["n"], small["filled"] = [-5, -6], 10, 10

    def packed(signs, codes, kind):
        return np.array(signs, np.uint64).view(np.uint8).reshape(-1, 8)[:, 8 - ngram_join.SIGN_BYTES :].tobytes() + np.array(codes, kind).tobytes()

    batch = pa.RecordBatch.from_arrays(
        [pa.array([0, 0], pa.int32()), pa.array([big.tobytes(), small.tobytes()]), pa.array([packed([1 << 40], [69_999], "<u4"), packed([7 << 40] * 9, [0, 1] + [0] * 7, "<u2")]), pa.nulls(2, pa.int64()), pa.nulls(2, pa.int64()), pa.nulls(2, pa.int32())],
        schema=ngram_join._PACKED,
    )
    rows = [r for b in ngram_join._match([batch]) for r in b.to_pylist()]
    assert [(r["set_id"], r["other"], r["shared"]) for r in rows if r["kind"] == ngram_join.PAIR] == [(-6, -5, 1)]


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert queries.VOCABULARY
