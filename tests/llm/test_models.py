"""Language ID, language model and n-gram join: held-out accuracy and brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lettermill.llm import langid, maxent_lm, ngram_join, queries

from .fixtures import empty, frame

WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# language ID


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    for sizes in ([5], [1, 4, 2], [3, 3, 3, 1]):
        n, k = sum(sizes), 3
        emission, move, start = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
        first = np.zeros(n, bool)
        first[np.cumsum([0, *sizes[:-1]])] = True
        got = langid.forward_backward(emission, first, move, start)[2]
        at = 0
        for size in sizes:
            total, marginal = 0.0, np.zeros((size, k))
            for path in itertools.product(range(k), repeat=size):
                w = start[path[0]] + sum(emission[at + t, path[t]] for t in range(size)) + sum(move[a, b] for a, b in itertools.pairwise(path))
                total += math.exp(w)
                for t, label in enumerate(path):
                    marginal[t, label] += math.exp(w)
            assert np.allclose(got[at : at + size], marginal / total)
            at += size


def test_segments_do_not_change_marginals():
    rng = np.random.default_rng(2)
    emission, move, start = rng.normal(size=(3000, 4)) * 4, rng.normal(size=(4, 4)) * 3, rng.normal(size=4)
    first = rng.random(3000) < 0.02
    first[0] = True
    whole = langid.forward_backward(emission, first, move, start)[2]
    edges = [*np.flatnonzero(first).tolist(), 3000]
    for a, b in itertools.pairwise(edges):
        f = np.zeros(b - a, bool)
        f[0] = True
        assert np.allclose(whole[a:b], langid.forward_backward(emission[a:b], f, move, start)[2], atol=1e-9)


def test_language_accuracy_and_switches(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op1_crf_language(spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= got[r["doc_id"]]["score"] <= 1
    held = [r for r in rows if got[r["doc_id"]]["held_out"]]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    # a text that switches: the spans follow
    model = langid.fit(docs, langid.fold("doc_id", 3) != 1)
    parts = {lang: next(r["text"].split() for r in held if r["lang"] == lang and len(r["text"]) > 600) for lang in ("en", "de", "fr")}
    text = " ".join(parts["en"][:40] + parts["de"][:40] + parts["fr"][:40])
    (row,) = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    label = [None] * 120
    for s in row["spans"]:
        label[s["start"] : s["stop"]] = [s["lang"]] * (s["stop"] - s["start"])
    assert sum(x == y for x, y in zip(label, ["en"] * 40 + ["de"] * 40 + ["fr"] * 40, strict=True)) > 100


def test_undetermined_and_untrained(spark):
    docs = frame(spark)
    for model in (None, langid.fit(docs, F.lit(True))):
        got = langid.predict(docs, model).collect()
        assert len(got) == docs.count()
        for r in got:
            if r["doc_id"] in (3, 4, 5):
                assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            assert model or r["lang_pred"] == "und"
    assert langid.fit(empty(spark), F.lit(True)) is None
    stray = spark.createDataFrame([("word " * k, f"stray{k}") for k in range(1, 60)] + [(f"common text {k}", x) for k in range(300) for x in ("aa", "bb")], "text string, lang string")
    assert langid.fit(stray, F.lit(True), per_language=5, most_languages=2).languages == ["aa", "bb"]
    assert langid.predict(empty(spark), None).count() == 0


def test_predictions_of_whole_texts_match_enumeration(spark, sf_dir):
    """Language and score from the marginals of all label sequences of a text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(docs, langid.fold("doc_id", 3) != 1)
    texts = {r["doc_id"]: " ".join(r["text"].split()[:5]) for r in docs.orderBy("doc_id").limit(40).collect()} | {-1: "the der 12 et", -2: "EINE Größe\u00a0und", -3: "123 !", -4: None}
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    k = len(model.languages)
    for i, text in texts.items():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if any(map(str.isalpha, w))]
        if not words:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        emission = model.emissions(words)
        mass = np.zeros(k)
        total = 0.0
        for labels in itertools.product(range(k), repeat=len(words)):
            p = math.exp(model.start[labels[0]] + sum(emission[t, x] for t, x in enumerate(labels)) + sum(model.transitions[a, b] for a, b in itertools.pairwise(labels)) - emission.max(axis=1).sum())
            total += p
            for x in labels:
                mass[x] += p / len(words)
        mass /= total
        assert got[i]["score"] == pytest.approx(mass.max(), abs=1e-6)
        assert mass[model.languages.index(got[i]["lang_pred"])] == pytest.approx(mass.max(), abs=1e-9)


# language model


def base_scores(rows):
    tokens = {k: [*WHITE.findall(lower(text)), None] for k, (_, text) in enumerate(rows)}
    held = {k: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for k, (i, _) in enumerate(rows)}
    counts = Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = counts.total(), len(counts)
    out = []
    for k, (i, _) in enumerate(rows):
        score = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens[k])
        out.append((i, held[k], len(tokens[k]), sum(counts[w] > 0 for w in tokens[k]), n, score))
    return out


@pytest.mark.parametrize("source", ["awkward", "sf"])
def test_language_model_base(spark, sf_dir, source, monkeypatch):
    monkeypatch.setattr(maxent_lm, "BUCKET_WORDS", 500)
    docs = frame(spark) if source == "awkward" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(base_scores([(r["doc_id"], r["text"]) for r in docs.collect()]), key=str)
    got = maxent_lm.score_documents(docs, langid.fold("doc_id", 7) == 2).collect()
    rows = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=str)
    for w, g in zip(want, rows, strict=True):
        assert w[:5] == g[:5] and math.isclose(w[5], g[5], rel_tol=1e-9)
    if source == "sf":
        held = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)


def test_model_is_a_distribution():
    rng = np.random.default_rng(0)
    head = np.arange(1, 200, dtype=np.uint64)
    mass = rng.integers(5, 90, maxent_lm.GROUPS)
    counts = maxent_lm.Counts(10_000, 7000, head, np.sort(rng.integers(30, 400, 199))[::-1], mass, rng.integers(1, 50, maxent_lm.GROUPS))
    model = maxent_lm.Model.start(counts)
    n, classes = 30_000, maxent_lm.HEAD_CLASSES
    words = rng.integers(0, 1 << 16, 300).astype(np.uint16)[rng.integers(0, 300, n)]
    klass, inner = rng.integers(0, classes + 8, n), rng.integers(0, maxent_lm.CLASS_WORDS, n)
    klass = np.where(klass < classes, rng.integers(0, 6, n), klass)
    klass[1::2], inner[1::2] = words[::2] % 6, words[::2] % 32  # every second word follows from the first
    place = np.arange(n) % 500
    before = model.log10(words, klass, inner, place).mean()
    squares = [np.full(len(t), maxent_lm.FIRST_SQUARES, np.float32) for t in (*model.tables, *model.word_tables)]
    for _ in range(3):
        maxent_lm.learn(model, squares, words, klass, inner, place)
    assert model.log10(words, klass, inner, place).mean() > before + 0.2
    # all outcomes of one context sum to one
    outcomes = [(k, i) for k in range(maxent_lm.CLASSES) for i in range(maxent_lm.CLASS_WORDS) if k != classes or i == 0]
    total = sum(10 ** model.log10(np.r_[words[:4], words[:1]], np.r_[klass[:4], k], np.r_[inner[:4], i], np.arange(5))[-1] for k, i in outcomes)
    assert math.isclose(total, 1, rel_tol=1e-3)
    flat = model.flat()
    assert np.array_equal(model.filled(flat).flat(), flat)


def test_features_tell_words_beyond_the_head_apart(spark):
    """Of 1,000 pairs of words, far more than have a place of their own, the second is likelier after its own first."""
    rows = [(k, f"left{k} right{k} " * 100) for k in range(1000)]
    rows += [(10_000 + k, f"left{k} right{k}") for k in range(1000)] + [(20_000 + k, f"left{k} right{(k + 1) % 1000}") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in maxent_lm.score_documents(docs, F.col("doc_id") >= 10_000).collect()}
    gain = np.array([got[10_000 + k] - got[20_000 + k] for k in range(1000)])
    # measured 0.38 and 0.77; a model whose features know the 1,024 most frequent words only has 0.09 and 0.57
    assert gain.mean() > 0.25 and (gain > 0).mean() > 0.7, (gain.mean(), (gain > 0).mean())


def test_scores_are_the_same_in_every_run_and_with_salted_counts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(maxent_lm, "BLOCK_TOKENS", 4096)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    run = lambda **more: sorted(map(tuple, maxent_lm.score_documents(docs, langid.fold("doc_id", 7) == 2, **more).collect()))
    first = run()
    assert first == run() == run(most_blocks=3)


# n-gram join


def brute_join(rows):
    sets = []
    for i, text in rows:
        words = [m.lower() if m.isascii() else lower(m) for m in WHITE.findall(text or "")]
        sets.append((i, frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct, holders = {}, defaultdict(list)
    for k, (_, s) in enumerate(sets):
        if s and s in distinct:
            root[find(k)] = find(distinct[s])
        elif s:
            distinct[s] = k
            for x in s:
                holders[x].append(k)
    for s, k in distinct.items():
        for j, both in Counter(j for x in s for j in holders[x]).items():
            if j < k and 100 * both >= 75 * (len(s) + len(sets[j][1]) - both):
                root[find(k)] = find(j)
    smallest = {}
    for k, (i, s) in enumerate(sets):
        r = find(k)
        if s and i is not None:
            smallest[r] = min(smallest.get(r, i), i)
    return Counter((i, len(s), smallest.get(find(k)) if s else i) for k, (i, s) in enumerate(sets))


def mutated(rng, words, edits, lexicon):
    words = list(words)
    for _ in range(edits):
        at, what = rng.randrange(len(words)), rng.random()
        if what < 0.4:
            words[at] = rng.choice(lexicon)
        elif what < 0.7:
            words.insert(at, rng.choice(lexicon))
        elif len(words) > 1:
            del words[at]
    return words


def near_rows():
    """Copies with few and many edits, chains, short texts, shared passages, and a large group."""
    rng = random.Random(11)
    lexicon = [f"t{i}" for i in range(400)]
    passage = rng.choices(lexicon, k=30)
    rows = []
    for _ in range(60):
        base = rng.choices(lexicon, k=rng.choice([5, 6, 7, 9, 12, 20, 40, 80, 200]))
        for _ in range(rng.randrange(1, 6)):
            rows.append(" ".join(mutated(rng, base, rng.randrange(0, max(2, len(base) // 20)), lexicon)))
        chain = base
        for _ in range(4):
            chain = mutated(rng, chain, max(1, len(chain) // 60), lexicon)
            rows.append(" ".join(chain))
    for _ in range(70):  # much passage, little else
        rows.append(" ".join(rng.choices(lexicon, k=rng.randrange(4, 40)) + passage))
    big = rng.choices(lexicon, k=90)
    for _ in range(90):
        rows.append(" ".join(mutated(rng, big, rng.randrange(0, 5), lexicon)))
    for _ in range(30):  # near the edge of the large group
        rows.append(" ".join(mutated(rng, big, rng.randrange(5, 12), lexicon)))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("hot", "bundle"), [(4, 48 << 20), (32, 48 << 20), (32, 1000)])
def test_join_matches_brute_force(spark, monkeypatch, hot, bundle):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BUNDLE_BYTES", bundle)
    monkeypatch.setattr(ngram_join, "BUCKET_SIGNATURES", 2000)
    rows = near_rows()
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(tuple(r) for r in got) == brute_join(rows)


def test_join_on_tables(spark, sf_dir):
    for docs in (frame(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert Counter(tuple(r) for r in ngram_join.join(docs).collect()) == brute_join(rows)
    kept = ngram_join.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, c in brute_join(rows) if i == c}
    assert ngram_join.join(empty(spark)).count() == 0 and ngram_join.deduplicate(empty(spark)).count() == 0


def test_every_linked_pair_shares_enough_signatures():
    rng = np.random.default_rng(4)
    for size in (1, 2, 3, 4, 5, 7, 11, 30, 31, 60, 200, 900):
        for _ in range(40):
            pool = rng.integers(1, 1 << 62, 2 * size + 4).astype(np.uint64)
            d = int(rng.integers(0, size // 3 + 1))
            a = np.unique(pool[:size])
            b = np.unique(np.r_[pool[d // 2 : size], pool[size : size + d - d // 2]])
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < 75 * (len(a) + len(b) - both):
                continue
            na, nb = ngram_join.band_of(len(a)), ngram_join.band_of(len(b))
            assert abs(na - nb) <= 1
            number = min(na, nb)
            sa, fa = ngram_join.signatures(a, number, ngram_join.possible_differences(len(a), na == number))
            sb, fb = ngram_join.signatures(b, number, ngram_join.possible_differences(len(b), nb == number))
            need = max(fa, fb) - (len(a) + len(b)) // 7 if fa and fb else 1
            assert len(np.intersect1d(sa, sb)) >= max(1, need)
            assert ngram_join._may_link(ngram_join.bitmap(a), ngram_join.bitmap(b))


def test_languages_of_long_texts_are_learned(spark):
    rng = np.random.default_rng(7)
    german, english = ("der die und nicht straße über schön machen", "the and not with street over nice making")
    long_text = lambda words: " ".join(rng.choice(words.split(), 4000))
    rows = [(k, long_text(german), "de") for k in range(12)] + [(100 + k, " ".join(rng.choice(english.split(), 40)), "en") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert min(len(t) for _, t, lang in rows if lang == "de") > langid.SAMPLE_CHARS
    model = langid.fit(docs, langid.fold("doc_id", 3) >= 0)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_buckets_of_any_number_of_sets():
    """Places that do not fit beside the signatures give the same pairs and groups."""
    rng = np.random.default_rng(2)
    blocks = []
    for block in range(5):
        n = 200
        sets = np.zeros(n, ngram_join._ENTRY)
        sets["set"], sets["n"], sets["filled"] = rng.permutation(n) + 150 * block, 40, rng.integers(-12, 13, n)
        signs = rng.integers(0, 300, 1500).astype(">u8").view(np.uint8).reshape(-1, 8)[:, -ngram_join.SIGN_BYTES :][:, ::-1]
        blocks.append((sets.tobytes(), np.ascontiguousarray(signs).tobytes() + rng.integers(0, n, 1500).astype("<u2").tobytes()))
    narrow, wide = ([b.to_pydict() for b in ngram_join._match_bucket(list(blocks), most)] for most in (1 << 24, 10))
    assert narrow == wide and any(b["members"][0] for b in narrow)


def test_a_family_of_copies_gives_no_pair_of_each_two(spark, monkeypatch):
    """Groups of up to HOT sets meet by a pivot: what is compared stays in proportion to the sets."""
    compared = []
    verified = ngram_join._verified

    def counted(pairs, sets):
        compared.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    rng = random.Random(5)
    lexicon = [f"t{i}" for i in range(3000)]
    rows = []
    for _ in range(12):
        base = rng.choices(lexicon, k=150)
        rows += [" ".join(mutated(rng, base, 2, lexicon)) for _ in range(30)]
    rows = list(enumerate(rows))
    assert Counter(tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute_join(rows)
    assert sum(compared) < 3 * len(rows)  # each two of a family: 12 * 435


def test_pairs_inside_components_are_dropped_before_any_join(spark, monkeypatch):
    """Each set gives one pair of two to the first verification, and only ends in different components give more, by broadcast or by joins."""
    pairs = spark.createDataFrame([(a, b, 3 + (a == b - 1), 1) for a in range(12) for b in range(a + 1, 12)], "a long, b long, shared long, need int")
    assert sorted(map(tuple, ngram_join._best(pairs, None).collect())) == [(b - 1, b) for b in range(1, 12)]
    roots = spark.createDataFrame([(k, 0) for k in range(1, 6)] + [(k, 6) for k in range(7, 11)], "node long, root long")
    apart = {(a, b) for a in range(12) for b in range(a + 1, 12) if (a < 6, a == 11) != (b < 6, b == 11)}
    for most in (1_000_000, 0):
        monkeypatch.setattr(ngram_join, "MAX_BROADCAST", most)
        assert {(r["a"], r["b"]) for r in ngram_join._between(pairs, roots).collect()} == apart
    assert ngram_join._between(pairs, roots.limit(0)).count() == 66


def test_blocks_give_a_forest():
    """Outsiders that all link with each other, each a component of its own, give one link less than there are sets."""
    sets = [np.arange(k, 200 + k, dtype=np.uint64).tobytes() for k in range(40)]
    nodes = list(range(40))
    table = pa.table({"outside": [False] * 40 + [True] * 39, "node": nodes + nodes[1:], "root": nodes + nodes[1:], "elements": sets + sets[1:]})
    links = ngram_join._compare_blocks(table)
    assert links.num_rows == 39
    (roots,) = ngram_join._joined(links.to_batches())
    assert roots.column(0).to_pylist() == nodes[1:] and set(roots.column(1).to_pylist()) == {0}


def test_hot_groups_are_compared_before_pairs_are_drawn(spark, monkeypatch):
    """Links that only a hot group shows are known when the other groups give their pairs."""
    steps = []
    for name in ("_hot_links", "_apart"):
        whole = getattr(ngram_join, name)
        monkeypatch.setattr(ngram_join, name, lambda *a, whole=whole, name=name: steps.append(name) or whole(*a))
    words = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*words[: 3 * k], f"x{k}", *words[3 * k + 1 :]])) for k in range(ngram_join.HOT + 8)]
    assert Counter(tuple(r) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == brute_join(rows)
    assert steps == ["_hot_links", "_apart"]
