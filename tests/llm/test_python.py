"""BPE, WARC, chat windows and decontamination against plain Python."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from lettermill.llm import bpe, chat, decontam, queries, warc

from .fixtures import empty, frame

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    parts = ["word", " ", "  ", "\n\n", "a'll", "12345", " 1", "é", "\U0001f600", "!?", "\t", "x" * 50, " " * 40, "ß", "it's", "<|endoftext|>"]
    made = ["".join(rng.choices(parts, k=rng.randrange(1, 400))) for _ in range(40)]
    return [None, "", " ", "a" * 5000, " " * 3000 + "b", "x " * 900, *made]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (200, 8), (32768, 512)])
def test_bpe_matches_the_library(spark, library, chunk, overlap):
    rows = [(i % 7, t, "kept", 3) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, chunk int")
    encoded = bpe.encode(docs, queries.VOCABULARY, PATTERN, chunk_chars=chunk, overlap=overlap)
    assert encoded.columns == ["doc_id", "chunk", "ids"]
    decoded = bpe.decode(encoded, queries.VOCABULARY, PATTERN)
    got = Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in decoded.collect())
    assert got == Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, *_ in rows)


def test_bpe_query(spark, sf_dir, library):
    want = Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"] or "")
        want[(r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in queries.op10_chunked_bpe(spark, sf_dir).collect()) == want


def page_rows():
    big = "<html>" + "é" * 900 + "</html>"
    return [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", big), (8, "u", "z" * 999), (9, "u", "z" * 999), (10, "u", "\r\n\r\nWARC/1.1\r\n" * 200)]


def check_pages(rows, got):
    best = defaultdict(list)
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000:
            best[raw].append(i)
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        ids = [x for x in best[raw] if x is not None]
        revisit = bool(ids) and len(best[raw]) > 1 and i != max(ids)
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want


def test_warc_round_trip(spark, sf_dir):
    rows = page_rows()
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    check_pages(rows, got)
    assert {bytes(r["payload"]) for r in got if r["payload"] is not None} == {(h or "").encode() for _, _, h in rows}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    check_pages([(r["page_id"], r["url"], r["html"]) for r in pages.collect()], queries.op8_zstd_warc(spark, sf_dir).collect())
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_archive_on_disk(spark, tmp_path):
    rows = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    dictionary = warc.train_dictionary([b"<html>some page</html>" * 20] * 3)
    warc.write(warc.with_revisits(rows).coalesce(1), f"file://{tmp_path}", dictionary, archive_bytes=300)
    names = list(tmp_path.glob("*.warc.zst"))
    assert len(names) > 1
    for name in names:
        raw = name.read_bytes()
        assert raw[:4] == (0x184D2A5D).to_bytes(4, "little") and raw[8 : 8 + len(dictionary)] == dictionary
        assert [h["warc-type"] for h, _ in warc.read_archive(raw)][0] == "warcinfo"
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(raw[:-3]))


def test_warc_refuses_bad_records():
    good = warc.page_record(1, "http://a", b"abc", hashlib.sha1(b"abc").hexdigest(), None, False)
    assert warc.read_page(*warc.parse_record(good))["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARD/1.1"), good.replace(b"WARC-Date: ", b"WARC-Data: ")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    with pytest.raises(warc.WarcError):
        warc.read_page(*warc.parse_record(good.replace(b"abc", b"abd")))


TURNS = [
    (1, 0, "system", "Be <|im_end|> brief"), (1, 1, "user", "a\\b <\\| <| \n x"), (1, 2, "assistant", "yes\\"), (1, 2, "assistant", "yes\\"), (1, None, "user", None),
    (2, 0, "user", ""), (2, 1, None, "role-less"), (None, 5, "assistant", "no id"), (None, 4, "odd\nrole", "<|im_start|>"),
    (3, 0, "system", "S " * 30), *((3, k, "user" if k % 2 else "assistant", f"turn {k} " * (k % 9 + 1)) for k in range(1, 60)), (3, 60, "assistant", "long " * 4000),
]


def brute_chat(rows):
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("budget", "history", "block"), [(120, 30, 8), (1024, 256, 256)])
def test_chat_windows(spark, budget, history, block, monkeypatch):
    monkeypatch.setattr(chat, "TURNS_PER_BLOCK", block)
    frame_ = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    turns = chat.with_tokens(frame_, queries.VOCABULARY, PATTERN)
    made = chat.windows(turns, budget, history)
    rows = made.collect()
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(made).collect()}
    assert got == brute_chat(TURNS)
    three = sorted((r for r in rows if r["conv_id"] == 3), key=lambda r: r["window"])
    assert len(three) > 1 and all(r["text"].startswith("<|im_start|>system\nS S ") for r in three)
    stride = (budget - history) // 2
    for r in rows:
        parsed = chat.parse_turns(r["text"])
        assert r["over_budget"] == (r["tokens"] > budget)
        assert sum(x[0] == "assistant" for x in parsed[r["repeated"] :]) == len(r["loss"])
        if r["over_budget"]:
            assert any(len(x[1]) > stride / 2 for x in parsed)
    seen = [x[1] for r in three for x in chat.parse_turns(r["text"])[r["repeated"] :]]
    repeats = [x[1] for r in three[1:] for x in chat.parse_turns(r["text"])[1 : r["repeated"]]]
    assert repeats and set(repeats) < set(seen)


def test_turn_tokens_are_those_of_the_written_turn(spark, library):
    rows = [(1, k, role, text) for k, (role, text) in enumerate([("user", "\\" * 40 + "<|im_end|>" * 9), ("odd\nrole\\", "<|x|>\n\n"), ("system", "plain"), (None, None)])]
    got = chat.with_tokens(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), queries.VOCABULARY, PATTERN).collect()
    assert {r["turn"]: r["tokens"] for r in got} == {k: len(library.encode_ordinary(chat.format_turn(role or "", text or "")[0])) for _, k, role, text in rows}


def test_a_long_system_turn_leaves_the_budget_whole(spark):
    rows = [(c, 0, "system", "rule " * size) for c, size in ((1, 500), (2, 2), (3, 2000))]
    rows += [(c, k, "user" if k % 2 else "assistant", f"words of turn {k}") for c in (1, 2, 3) for k in range(1, 300)]
    turns = chat.with_tokens(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), queries.VOCABULARY, PATTERN)
    made = chat.windows(turns, 1024, 256).collect()
    count = Counter(r["conv_id"] for r in made)
    assert all(r["tokens"] <= 1024 and not r["over_budget"] for r in made if r["conv_id"] in (1, 2))
    # a system turn beyond the budget: one turn a window, and every window says so
    assert count[2] < count[1] < count[3] == 300 and all(r["over_budget"] for r in made if r["conv_id"] == 3)
    assert sum(len(r["loss"]) for r in made) == 3 * 149


def test_chat_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    text = "<|im_end|><|im_start|>assistant ok"
    want = brute_chat([*rows, (-1, 0, "user", text), (-1, 1, "assistant", text)])
    assert {r["conv_id"]: tuple(r)[1:5] for r in queries.op5_budgeted_chat(spark, sf_dir).collect()} == want


def edit_distance_to_stretch(item, text):
    cost = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(cost[j - 1] + (a != b), cost[j] + 1, new[-1] + 1))
        cost = new
    return min(cost)


def test_leaks_match_brute_force(spark):
    rng = random.Random(3)
    lexicon = [f"w{i}" for i in range(300)]
    items = [(i, rng.choices(lexicon, k=rng.randrange(5, 60))) for i in range(40)] + [(90, ["only", "four", "words", "here"])]
    docs = [(0, None), (1, ""), (2, "one"), (3, "w1 only four words here w2"), (4, "only four wordz here")]
    for k in range(160):
        i, item = items[k % 40]
        words, edits = list(item), rng.randrange(0, len(item) // 4 + 1)
        for _ in range(edits):
            at, what = rng.randrange(len(words)), rng.random()
            if what < 0.5:
                words[at] = rng.choice(lexicon)
            elif what < 0.75:
                words.insert(at, rng.choice(lexicon))
            elif len(words) > 1:
                del words[at]
        around = lambda: rng.choices(lexicon, k=rng.randrange(0, 80))
        docs.append((10 + k, " ".join([*around(), *(w.upper() + "," if rng.random() < 0.1 else w for w in words), *around()])))
    docs.append(docs[-1])
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(99, None), (98, "")], "item_id long, text string")
    want = {}
    for d, text in docs:
        codes = decontam.words_of(text)
        for i, item in items:
            distance = edit_distance_to_stretch(item, codes)
            if codes and distance <= (int(0.2 * len(item)) if len(item) >= 5 else 0):
                want[d, i] = distance
    for block in (20_000, 10):
        rows = decontam.find(*frames, block_items=block).collect()
        got = {(r["doc_id"], r["item_id"]): r["distance"] for r in rows}
        assert set(got) <= set(want)
        assert len(got) >= 0.97 * len(want), (len(got), len(want))
        assert all(got[k] >= want[k] for k in got)
        assert (3, 90) in got and (4, 90) not in got
        assert sum(r["doc_id"] == docs[-1][0] for r in rows) % 2 == 0
    assert decontam.find(frames[0].limit(0), frames[1]).count() == 0
    assert decontam.find(frames[0], frames[1].limit(0)).count() == 0


def plain_words(text):
    """Split and cleaned without the operator's own functions."""
    import regex

    return [w.lower() for w in (regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w) for w in text.split()) if w]


def test_verbatim_leaks_of_any_script_are_found(spark):
    items = ["alpha beta\u3000gamma", "one\u00a0two three four five six", "ΟΔΟΣ ΛΟΓΟΣ", "İSTANBUL ŞEHİR", "Straße «größer» als ẞ", "ＦＵＬＬ width，words", "a\x0bb\x0cc\u2003d\u0085e"]
    docs = [f"before words {t} after" for t in items] + [f"{t}" for t in items] + ["οδος λογος", "istanbul", "alpha beta gamma", None]
    frames = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find(*frames).collect()}
    want = set()
    for d, text in enumerate(docs):
        words = plain_words(text or "")
        for i, item in enumerate(map(plain_words, items)):
            if words and edit_distance_to_stretch(item, words) <= (int(0.2 * len(item)) if len(item) >= 5 else 0):
                want.add((d, i))
    assert {(k, k) for k in range(7)} | {(7 + k, k) for k in range(7)} <= want
    assert got == want


def test_cgk_keeps_near_sequences_near():
    rng = np.random.default_rng(0)
    a = rng.integers(1, 500, (200, 40))
    b = a.copy()
    for row in b:
        row[rng.integers(0, 40, 4)] = rng.integers(1, 500, 4)
        row[20:] = np.roll(row[20:], 1)  # one insertion and the shift it makes
    near = np.mean([np.mean(decontam.embed(a, w)[:, :80] == decontam.embed(b, w)[:, :80]) for w in range(4)])
    far = np.mean(decontam.embed(a, 0)[:, :80] == decontam.embed(a[::-1], 0)[:, :80])
    assert near > 0.5 > 0.1 > far


@pytest.mark.parametrize("kind", ["delete", "insert", "replace"])
@pytest.mark.parametrize("size", [20, 50, 100, 150])
def test_recall_of_the_tables_alone(size, kind):
    """What CGK and bit sampling propose for leaks at the edit limit, before anything is verified."""
    rng, edits, hits, total = np.random.default_rng(size), size // 5, 0, 60
    items = [[f"w{w}" for w in rng.choice(3000, size, replace=False)] for _ in range(total)]
    index = decontam.build([(i, " ".join(w)) for i, w in enumerate(items)], decontam.RATE, decontam.MIN_WORDS, decontam.RECALL)
    own = index.sizes[size]
    for k, words in enumerate(items):
        spots = set(rng.choice(size, edits, replace=False).tolist())
        leak = [w for j, word in enumerate(words) for w in ({"delete": [], "insert": ["other", word], "replace": ["other"]}[kind] if j in spots else [word])]
        codes, _ = decontam.text_codes(pa.array([" ".join(["before"] * size + leak + ["after"] * size)]), index.vocabulary)
        starts = decontam.aligned(index, codes).get(size, np.zeros(0, int))
        spots = starts[:, None] + np.arange(size)
        grid = np.where((spots >= 0) & (spots < len(codes)), codes[np.clip(spots, 0, len(codes) - 1)], 0)
        hits += any(item == k for _, item in decontam.candidates(own, grid))
    assert own.how.recall >= 0.99 and hits >= 0.97 * total


def test_plan_of_items_without_edits():
    assert decontam.planned(4, 0.2, 5, 0.995).tables == 1 and decontam.planned(1, 0.2, 5, 0.995).tables == 1


@pytest.mark.parametrize("kind", ["delete", "spread"])
@pytest.mark.parametrize("size", [50, 80, 100, 120, 150])
def test_leaks_at_the_edit_limit_are_found(size, kind):
    rng = np.random.default_rng(size)
    items = [[f"w{w}" for w in rng.choice(3000, size, replace=False)] for _ in range(40)]
    index = decontam.build([(i, " ".join(w)) for i, w in enumerate(items)], decontam.RATE, decontam.MIN_WORDS, decontam.RECALL)
    edits, texts = size // 5, []
    for words in items:
        spots = set(rng.choice(size, edits, replace=False).tolist()) if kind == "delete" else set(range(2, size, 5))
        leak = [w for j, w in enumerate(words) if j not in spots] if kind == "delete" else ["other" if j in spots else w for j, w in enumerate(words)]
        texts.append(" ".join(["before"] * 30 + leak + ["after"] * 30))
    found = decontam.search(index, *decontam.text_codes(pa.array(texts), index.vocabulary))
    own = [i for i in range(40) if (i, i) in found]
    # the tables' expected recall is 0.995 for the hardest edits
    assert len(own) == 40 if kind == "spread" else len(own) >= 38
    assert all(found[i, i][0] <= edits for i in own)


def test_awkward_documents(spark):
    docs = frame(spark)
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    assert Counter(r["doc_id"] for r in decontam.find(docs, items).collect()) == Counter([1, 2, 2, 12])
    assert bpe.encode(docs, queries.VOCABULARY, PATTERN).count() == docs.count()
    assert bpe.encode(empty(spark), queries.VOCABULARY, PATTERN).count() == 0
    assert chat.read_back(chat.windows(chat.with_tokens(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), queries.VOCABULARY, PATTERN))).count() == 0
