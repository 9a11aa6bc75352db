"""Semantic corners that the tables do not reach."""

import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.functions import analysis, bodies, text
from lettermill.operators import contacts, context, filters, quotes, results, retrieval, state, threads
from lettermill.sources import folder_delta, mail_zip, sinks


def one(spark, column, **values):
    names = list(values)
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double'}" for n, v in values.items()))
    return frame.select(column).first()[0] if names else None


@pytest.mark.parametrize(("subject", "base", "kind"), [("RE: AW: Fwd x", "Fwd x", "reply"), ("WG: y", "y", "forward"), ("re : z", "z", "reply"), ("", "", "original"), (None, "", "original"), ("Regarding: q", "Regarding: q", "original")])
def test_subjects(spark, subject, base, kind):
    assert one(spark, text.base_subject(F.col("s")), s=subject) == base
    assert one(spark, text.message_type(F.col("s"), F.lit(None).cast("string")), s=subject) == kind
    assert one(spark, text.message_type(F.col("s"), F.lit("<a@b>")), s=subject) == ("reply" if kind == "original" else kind)


@pytest.mark.parametrize(("address", "identity"), [("A.b+c@googlemail.com", "ab@gmail.com"), ("a.b+c@Example.com", "a.b+c@example.com"), ("no address", "no address"), (None, ""), (" X@Y.z ", "x@y.z")])
def test_identities(spark, address, identity):
    assert one(spark, contacts.contact_identity(F.col("a")), a=address) == identity


@pytest.mark.parametrize(
    ("quote", "surface", "state_"),
    [
        ("“Hello” world", 'he said "hello"  WORLD', "exact"),
        ("Straße und Weg, abcdefghijklmnop", "strasse und weg abcdefghijklmnop", "exact"),
        ("a whole rearrangement of all of it", "a whole rearrange-\nment of all of it", "exact"),
        ("überall größer geworden und mehr", "ueberall groesser gewor-\nden und mehr", "near_exact"),
        ("a re\u2010\r\n arrangement Ä Ö Ü of all its parts", "A rearrangement AE OE UE of all its parts", "near_exact"),
        ("ﬁrst ｗｏｒｄｓ of it", "First words  of it", "exact"),
        ("short re-\nmark", "short remark", "unverified"),
        ("Ωμέγα…", "ωμέγα...", "exact"),
        ("absent", "text", "unverified"),
        ("", "text", "unverified"),
        ("x", None, "orphaned"),
    ],
)
def test_quotes(spark, quote, surface, state_):
    assert one(spark, quotes.match_state(F.col("q"), F.col("s")), q=quote, s=surface) == state_


def test_jaccard(spark):
    near = lambda a, b: one(spark, text.jaccard(text.char_ngrams(F.col("a")), text.char_ngrams(F.col("b"))), a=a, b=b)
    assert near("", None) == 1.0 and near("abc", "") == 0.0 and near("abcd", "ABCD") == 1.0 and near("ab", "ab") == 1.0
    assert near("abcd", "abce") == pytest.approx(1 / 3)


@pytest.mark.parametrize(("body", "label", "score"), [("This is good", "positive", 1.0), ("not good", "negative", -1.0), ("not very good", "negative", -1.0), ("not a very good", "positive", 1.0), ("never fail, no problem", "positive", 1.0), ("plain words", "neutral", 0.0), (None, "neutral", 0.0)])
def test_sentiment(spark, body, label, score):
    got = one(spark, analysis.sentiment(F.col("b")), b=body)
    assert (got["label"], got["score"]) == (label, score)


def test_entities(spark):
    body = "See (https://a.example/x(1)). mail Bob@Example.org or call +49 (30) 1234567, not 2024-01-02 nor 10.0.0.1; @ann_b"
    rows = analysis.entities(spark.createDataFrame([(1, body), (2, None)], "id int, body string"), "id", "body").collect()
    assert {(r["kind"], r["entity"]) for r in rows} == {("url", "https://a.example/x(1)"), ("email", "bob@example.org"), ("phone", "49301234567"), ("mention", "@example"), ("mention", "@ann_b")}
    assert one(spark, analysis.organisation(F.col("a")), a="x@gmail.com") is None
    assert one(spark, analysis.organisation(F.col("a")), a="x@acme.test") == "acme.test"


def test_rules(spark):
    rows = spark.createDataFrame([("a", "Please send the report by Friday. We decided to move the office to Berlin. Bitte um Rückmeldung, das ist nicht möglich.")], "uid string, body string")
    assert {r["event_kind"] for r in analysis.event_hits(rows, "uid", "body").collect()} == {"request", "denial"}
    actions = [r["clause"] for r in analysis.clauses(rows, "uid", "body", analysis.ACTION_STARTS).collect()]
    assert "send the report by friday" in actions
    assert [r["clause"] for r in analysis.clauses(rows, "uid", "body", analysis.DECISION_STARTS).collect()] == ["move the office to berlin"]


@pytest.mark.parametrize(("cell", "safe"), [("=1+1", "'=1+1"), ("+a", "'+a"), ("-a", "'-a"), ("@a", "'@a"), ("\ta", "'\ta"), ("\ra", "'\ra"), ("a=b", "a=b"), (None, "")])
def test_csv_guard(spark, cell, safe):
    assert one(spark, text.csv_safe(F.col("c")), c=cell) == safe


def test_redaction_and_controls(spark):
    body, hidden = text.redact(F.col("b"), "sensitive_redacted")
    frame = spark.createDataFrame([("mail a@b.org or 0049 30 1234567",), ("the doctor wrote",), (None,)], "b string").select(body.alias("t"), hidden.alias("n")).collect()
    assert [tuple(r) for r in frame] == [("mail [REDACTED: email] or [REDACTED: phone]", 2), ("[REDACTED: medical content]", 0), ("", 0)]
    assert one(spark, text.sanitize(F.col("s")), s="a\x1b[31mred\x1b[0m\x1b]0;t\x07b‮c\x00\td") == "aredbc\td"


WHERE = [
    ({"a": 1}, [1]), ({"a": {"$gt": 0}}, [1, 2]), ({"a": {"$ne": 1}}, [2, 3, 4]), ({"s": {"$contains": "ell"}}, [1, 2]), ({"$or": [{"a": 2}, {"s": "hello"}]}, [1, 2]),
    ({"$and": [{"a": {"$gte": 1}}, {"s": {"$in": ["hello", "x"]}}]}, [1]), ({"a": "1"}, []), ({"a": {"$regex": "."}}, []), ({"missing": {"$lt": 3}}, []), ({"a": {"$nin": [1, 2]}}, [3, 4]), ({}, [1, 2, 3, 4]),
]


@pytest.mark.parametrize(("where", "ids"), WHERE)
def test_metadata_predicates(spark, where, ids):
    rows = spark.createDataFrame([(1, '{"a": 1, "s": "hello"}'), (2, '{"a": 2.0, "s": "Hello"}'), (3, '{"a": "x"}'), (4, "not json")], "id int, m string")
    assert sorted(r["id"] for r in filters.metadata_filter(rows, "m", where).collect()) == ids


def test_like_is_literal_and_blind_to_case(spark):
    rows = spark.createDataFrame([("50%_off",), ("50 off",), ("a\\b",)], "t string")
    assert [r[0] for r in rows.where(filters.contains_like(F.col("t"), "%_OFF")).collect()] == ["50%_off"]
    assert [r[0] for r in rows.where(filters.contains_like(F.col("t"), "A\\B")).collect()] == ["a\\b"]


def test_knn_corners(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0]), (5, [1.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "query_id long, query array<float>")
    got = [(r["query_id"], r["vec_id"], r["distance"]) for r in retrieval.nearest(queries, vectors, 10).orderBy("query_id", "place").collect()]
    assert got == [(1, 1, 0.0), (1, 2, 0.0), (1, 3, 1.0), (1, 4, 2.0)]


def test_fusion_ties_and_gaps(spark):
    make = lambda ids: spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], "id string, place int")
    fused = [r["id"] for r in retrieval.fuse(make(["a", "b"]), make(["c", "a"]), "id", 0.5, 0.5).orderBy("place").collect()]
    assert fused == ["a", "c", "b"] or fused == ["a", "b", "c"]
    assert [r["id"] for r in retrieval.fuse(make(["x", "y"]), make(["y", "x"]), "id", 0.5, 0.5).orderBy("place").collect()] == ["x", "y"]
    weights = [one(spark, F.concat_ws(" ", *retrieval.policy_columns(F.col("q"))), q=q) for q in ('find "exact words"', "where is it", "budget plan")]
    assert weights == ["0.3 0.7", "0.7 0.3", "0.6 0.4"]


def test_bm25_morphology_and_floor(spark):
    docs = spark.createDataFrame([(1, "Die Prüfungen der Abteilung"), (2, "der Plan"), (3, "der Bericht"), (4, "")], "id long, text string")
    asked = spark.createDataFrame([(1, "pruefungen"), (2, "der"), (3, "nothing")], "query_id long, query string")
    got = retrieval.bm25(docs, asked, "id", "text", 5).collect()
    assert {(r["query_id"], r["id"]) for r in got} == {(1, 1), (2, 1), (2, 2), (2, 3)}


def test_threads(spark):
    rows = spark.createDataFrame([("a", None), ("b", "<a>"), ("c", "b"), ("d", "gone"), ("x", "y"), ("y", "x")], "uid string, in_reply_to string")
    assert {tuple(r) for r in threads.thread_roots(rows).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("x", "x"), ("y", "x")}


def test_paths_and_degrees(spark):
    edges = spark.createDataFrame([("a", "b", 4), ("b", "c", 4), ("a", "c", 1), ("c", "d", 1), ("b", "a", 4)], "sender string, recipient string, email_count long")
    got = [(r["path"], r["hops"]) for r in contacts.cheapest_paths(edges, "a", "c", 3, 5).collect()]
    assert got == [("a>b>c", 2), ("a>c", 1)]
    assert {r["node"]: r["centrality"] for r in contacts.degree_centrality(edges).collect()}["a"] == 1.0
    # the cheapest paths a>b>c, a>b>c>d and b>c>d pass b twice and c twice, of 3 * 2 ordered pairs
    assert {r["node"]: r["score"] for r in contacts.betweenness(edges).collect()} == {"a": 0.0, "b": pytest.approx(2 / 6), "c": pytest.approx(2 / 6), "d": 0.0}


def cheapest_betweenness(edges, nodes):
    """Over every pair, by trying all simple paths."""
    steps = {}
    for u, v, w in edges:
        steps.setdefault(u, []).append((v, 1 / max(w, 1)))
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        paths = {}

        def walk(path, cost, paths=paths):
            paths.setdefault(path[-1], []).append((round(cost, 9), path))
            for v, c in steps.get(path[-1], []):
                if v not in path:
                    walk([*path, v], cost + c)

        walk([s], 0.0)
        for t, found in paths.items():
            if t != s:
                best = [p for c, p in found if c == min(x for x, _ in found)]
                for p in best:
                    for v in p[1:-1]:
                        score[v] += 1 / len(best)
    return {v: x / ((len(nodes) - 1) * (len(nodes) - 2)) for v, x in score.items()}


def test_betweenness_matches_all_paths(spark):
    rng = random.Random(4)
    nodes = [f"n{k}" for k in range(7)]
    edges = [(u, v, rng.choice([1, 2, 4])) for u in nodes for v in nodes if u != v and rng.random() < 0.35]
    got = {r["node"]: r["score"] for r in contacts.betweenness(spark.createDataFrame(edges, "sender string, recipient string, email_count long")).collect()}
    want = cheapest_betweenness(edges, nodes)
    assert sum(want.values()) > 0 and got == {v: pytest.approx(want[v], abs=1e-6) for v in got}
    some = contacts.betweenness(spark.createDataFrame(edges, "sender string, recipient string, email_count long"), exact_nodes=3, pivots=5).collect()
    assert len(some) == len(got)


def test_parents_across_february(spark):
    rows = spark.createDataFrame([("p", "2023-01-30 12:00:00"), ("c", "2023-03-01 11:00:00"), ("late", "2023-03-02 12:00:00")], "uid string, d string")
    rows = rows.select("uid", F.lit("plan").alias("base_subject"), F.to_timestamp_ntz("d").alias("date"), F.lit("a@x").alias("sender_email"), F.array(F.lit("a@x")).alias("participants"), F.lit("hello").alias("opening"))
    children = rows.where("uid <> 'p'").withColumn("reply_from", F.lit("a@x")).withColumn("reply_subject", F.lit("plan"))
    assert [tuple(r)[:2] for r in results.infer_parents(children, rows.where("uid = 'p'")).collect()] == [("c", "p")]


def test_parents_to_the_microsecond(spark):
    kinds = "uid string, base_subject string, at string, sender_email string, participants array<string>, opening string"
    people = ("s", "u@x.com", ["u@x.com"], "")
    rows = spark.createDataFrame([(uid, people[0], at, *people[1:]) for uid, at in (("c", "2024-01-31 00:00:00.500"), ("same", "2024-01-31 00:00:00.200"), ("late", "2024-01-31 00:00:00.700"))], kinds)
    rows = rows.withColumn("date", F.col("at").cast("timestamp"))
    children = rows.where("uid = 'c'").withColumn("reply_from", F.col("sender_email")).withColumn("reply_subject", F.col("base_subject"))
    assert [tuple(r)[:2] for r in results.infer_parents(children, rows.where("uid <> 'c'")).collect()] == [("c", "same")]
    edge = rows.where("uid = 'same'").withColumn("date", F.lit("2024-01-01 00:00:00.400").cast("timestamp"))
    assert results.infer_parents(children, edge).isEmpty()


def test_display_size_ties(spark):
    sizes = [1023, 1024 + 256, 1024 + 768, 3 * 1024 + 255, (1 << 20) + (1 << 18), (1 << 20) + 3 * (1 << 18), 1048575, None, -1]
    got = [r[0] for r in spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "k int, s long").orderBy("k").select(context.display_size(F.col("s"))).collect()]
    assert got == ["1023 B", *("%.1f KB" % (s / 1024) for s in sizes[1:4]), *("%.1f MB" % (s / (1 << 20)) for s in sizes[4:6]), "1024.0 KB", "", ""]


@pytest.mark.parametrize("clustered", [True, False])
def test_index_recall(spark, clustered):
    rng = np.random.default_rng(5)
    means = rng.normal(size=(20, 16))
    points = means[rng.integers(0, 20, 3000)] + 0.5 * rng.normal(size=(3000, 16)) if clustered else rng.normal(size=(3000, 16))
    points[7] = points[8] = points[9]
    rows = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)] + [(3000, [0.0] * 16), (3001, None), (3002, [1.0])], "vec_id long, embedding array<float>")
    queries = rows.where("vec_id % 100 = 0 and vec_id < 3000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = {(r["query_id"], r["vec_id"]) for r in retrieval.nearest(queries, rows, 10).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in retrieval.nearest_indexed(queries, rows, 10, rows_per_task=100).collect()}
    assert len(exact) == len(found) == 300 and len(exact & found) >= 0.9 * len(exact), len(exact & found)
    assert retrieval.nearest_indexed(queries.limit(0), rows, 10).count() == 0 and retrieval.nearest_indexed(queries, rows.limit(0), 10).count() == 0


def test_nearest_blocks_and_ties(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(300, 8)).round(1)
    points[50:80] = points[50]
    rows = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "vec_id long, embedding array<double>").repartition(5)
    queries = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    distance = np.round(np.clip(1 - unit @ unit.T, 0, 2), 12)
    want = {(q, int(v), k + 1) for q in range(300) for k, v in enumerate(sorted(range(300), key=lambda v: (distance[q, v], v))[:5])}
    for most, block in ((10_000, 2048), (64, 16)):
        got = {(r["query_id"], r["vec_id"], r["place"]) for r in retrieval.nearest(queries, rows, 5, max_queries=most, block_rows=block).collect()}
        assert got == want


def test_occurrences_and_snippets(spark):
    rows = spark.createDataFrame([(1, "A.b a.B axb a.b.", "a.b"), (2, "no", "x"), (3, None, "x"), (4, "text", " "), (5, "ÄÖä", "ä"), (6, "a\\Eb", "\\E")], "id long, t string, w string")
    got = [(r["id"], r["start"], r["stop"], r["surface"]) for r in context.occurrences(rows, "id", "t", "w").orderBy("id", "start").collect()]
    assert got == [(1, 0, 3, "A.b"), (1, 4, 7, "a.B"), (1, 12, 15, "a.b"), (5, 0, 1, "Ä"), (5, 2, 3, "ä"), (6, 1, 3, "\\E")]
    cases = spark.createDataFrame([(1, "x  one\n two", "one two"), (2, "one two", "one two"), (3, "other", "one"), (4, "", "one"), (5, "a (b)\t[c]* d", "(b) [c]* d"), (6, "p \\E\nq", "\\E q")], "id long, t string, s string")
    found = {r["id"]: r["b"] and tuple(r["b"]) for r in cases.select("id", context.snippet_bounds(F.col("t"), F.col("s")).alias("b")).collect()}
    assert found == {1: (3, 11, "collapsed"), 2: (0, 7, "exact"), 3: None, 4: None, 5: (2, 12, "collapsed"), 6: (2, 6, "collapsed")}


def test_header_parents_prefer_the_reply_then_the_last_reference(spark):
    children = spark.createDataFrame([("c1", "<m1>", ["m2"]), ("c2", "gone", ["<m1>", "m2", "lost"]), ("c3", None, []), ("m1", "m1", None)], "uid string, in_reply_to string, references array<string>")
    archive = spark.createDataFrame([("m1", "m1", "", 2), ("copy", "<m1>", "t", 3), ("m2", "<m2>", None, 1)], "uid string, message_id string, thread_id string, date int")
    assert {tuple(r) for r in context.header_parents(children, archive).collect()} == {("c1", "copy", "in_reply_to"), ("c2", "m2", "references"), ("m1", "copy", "in_reply_to")}


def test_requests_that_cannot_be_met_are_refused(spark):
    rows = spark.createDataFrame([("1", "a@x", "c", "2024-01-01", 1.0)], "uid string, sender_email string, category string, date string, value double")
    for bad in ({"color": 1}, {"sort_by": "uid; drop"}, {"limit": 0}, {"date_from": "2024-02-01", "date_to": "2024-01-01"}):
        with pytest.raises(ValueError):
            filters.structured(rows, bad)


def test_folder_changes_resume(spark, tmp_path):
    import json

    log = tmp_path / "log.jsonl"
    line = lambda k: json.dumps({"sequence": k, "operation": "create", "item_id": f"i{k}"}) + "\n"
    log.write_text("".join(line(k) for k in (3, 1, 2, 4, 5)))
    reader = folder_delta.FolderDeltaReader({"path": str(log), "maxChanges": "2"})
    pages, at = [], reader.initialOffset()
    for _ in range(4):
        rows, after = reader.read(at)
        pages.append([r[0] for r in rows])
        assert [r[0] for r in reader.readBetweenOffsets(at, after)] == pages[-1]
        at = after
    assert pages == [[1, 2], [3, 4], [5], []]
    folder_delta.register(spark)

    def follow():
        stream = spark.readStream.format("folder_delta").option("maxChanges", 2).load(str(log))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r["sequence"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert follow() == [1, 2, 3, 4, 5]
    with log.open("a") as more:
        more.write(line(6))
    assert follow() == [1, 2, 3, 4, 5, 6]


def test_reset_keeps_what_is_not_derived(spark, tmp_path):
    for name in ("messages", "vectors"):
        spark.range(3).write.parquet(str(tmp_path / name))
    sinks.reset_derived(spark, str(tmp_path), ("vectors",))
    assert spark.read.parquet(str(tmp_path / "vectors")).count() == 0 and spark.read.parquet(str(tmp_path / "messages")).count() == 3


def test_archive_budgets_are_counted_along_the_archive(spark, tmp_path):
    folder = "Accounts/a/com.microsoft.__Messages/Inbox"
    with zipfile.ZipFile(tmp_path / "box.olm", "w") as archive:
        for k in range(5):
            archive.writestr(f"{folder}/{k}.xml", MESSAGE)
    mail_zip.register(spark)
    load = lambda **options: [r["error"] for r in spark.read.format("mail_zip").options(membersPerPartition=2, **options).load(f"{tmp_path}/*.olm").orderBy("member").collect()]
    assert load(maxMembers=3) == [None, None, None, "over budget", "over budget"]
    assert load(maxBytes=2 * len(MESSAGE)) == [None, None, "over budget", "over budget", "over budget"]


def test_greedy_windows(spark):
    rows = [(str(k), f"u{k % 2}", f"2024-01-01 00:{m:02d}:00") for k, m in enumerate((0, 10, 20, 30, 50, 59))] + [("z", "u9", "2024-01-02 00:00:00")]
    frame = spark.createDataFrame(rows, "uid string, sender_email string, d string").select("uid", "sender_email", F.to_timestamp_ntz("d").alias("date"))
    anchors = contacts.coordinated_windows(frame, hours=1)
    assert {r["uid"]: r["event_count"] for r in anchors.collect()} == {"0": 6, "1": 5, "2": 4, "3": 3}
    assert [r["uid"] for r in contacts.pick_windows(anchors, hours=1).collect()] == ["0"]


def test_state(spark):
    journal = spark.createDataFrame([("a", 1, "upsert", "x"), ("a", 2, "upsert", "y"), ("b", 3, "delete", None), ("c", 4, "upsert", "z")], "k string, s long, operation string, v string")
    stored = spark.createDataFrame([("a", "old"), ("b", "old"), ("d", "old")], "k string, v string")
    assert {tuple(r) for r in state.merge_latest(stored, journal, "k", "s").collect()} == {("a", "y"), ("c", "z"), ("d", "old")}
    versions = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, None), ("a", 5, None)], "k string, s long, v string")
    assert [tuple(r) for r in state.history(versions, "k", "s", ["v"]).orderBy("valid_from").collect()] == [("a", "x", 1, 3), ("a", "y", 3, 4), ("a", None, 4, None)]


HTML = (
    "<html><head><title>no</title><style>p{}</style></head><body><h2>Head</h2><p>One <b>two</b><br>three &amp; four</p><ul><li>a<li>b</ul>"
    '<table><tr><td>1</td><td>2</td></tr></table><a href="http://x">link</a><div style="display:none">hidden</div><blockquote>quoted</blockquote>'
    '<div class="gmail_quote">old <div>inner</div></div><!-- gone --></body></html>'
)


def test_html():
    made = bodies.html_to_text(HTML)
    for part in ("## Head", "One two\nthree & four", "- a\n- b", "1\t2", "link (http://x)", "> quoted"):
        assert part in made
    for part in ("no", "hidden", "old", "inner", "gone", "p{}"):
        assert part not in made.replace("", "")
    assert bodies.html_to_text(None) == "" and bodies.html_to_text("<p>unclosed <b>tag") == "unclosed tag"


def test_signatures_and_quotes():
    assert bodies.strip_signature("Text\n\n-- \nJane\nBoss") == ("Text", True)
    assert bodies.strip_signature("Text\n\nBest regards,\nJane") == ("Text", True)
    assert bodies.strip_signature("Text\nSent from my iPhone") == ("Text", True)
    assert bodies.strip_signature("Thanks\nThis is a long sentence that ends.") == ("Thanks\nThis is a long sentence that ends.", False)
    assert bodies.strip_signature(None) == ("", False)
    assert bodies.strip_quoted("New\n\nOn Monday, Bob wrote:\n> old\n> older", "reply") == ("New", 3)
    assert bodies.strip_quoted("New\n--- Original Message ---\nFrom: x", "forward") == ("New", 2)
    assert bodies.strip_quoted("New\n\n> a", "reply") == ("New", 1)
    assert bodies.strip_quoted("New\n\n> a", "original") == ("New\n\n> a", 0)
    assert bodies.strip_disclaimer("Hi\n\nThis is confidential.\nOnly the intended recipient may read it.\nPlease notify the sender.") == "Hi"
    assert bodies.strip_footer("Hi\n\nunsubscribe\nview in browser") == "Hi"
    assert bodies.strip_footer("Hi" + "\n" * 500 + "unsubscribe" + "\n" * 200 + "view in browser\n\n") == "Hi"
    assert bodies.strip_footer("\n" * 300 + "unsubscribe\nview in browser") == "\n" * 300 + "unsubscribe\nview in browser"


def test_segments_and_context():
    body = "Hello there\n\nKind regards\nAnn\n\n--- Original Message ---\nFrom: Bob <b@x.org>\nTo: Ann\nSubject: Plans\n\nOld text\n> quoted\n>> deeper"
    parts = [(s["segment_type"], s["depth"]) for s in bodies.segments(body)]
    assert parts == [("authored_body", 0), ("signature", 0), ("system_separator", 0), ("header_block", 0), ("forwarded_message", 0), ("quoted_reply", 1), ("quoted_reply", 2)]
    context = bodies.reply_context(body)
    assert context["sender"] == "Bob <b@x.org>" and context["subject"] == "Plans" and context["confidence"] == 0.65
    assert bodies.reply_context(None)["confidence"] == 0.0


def test_chunks():
    body = ("word " * 100 + "end. ") * 12
    parts = bodies.chunks(body, 1500, 200)
    assert parts[0]["start"] == 0 and parts[-1]["stop"] == len(body)
    assert all(b["start"] <= a["stop"] and a["text"] == body[a["start"] : a["stop"]] for a, b in zip(parts, parts[1:], strict=False))
    assert all(p["stop"] - p["start"] <= 1500 for p in parts) and bodies.chunks(None)[0]["text"] == ""


MESSAGE = """<?xml version="1.0"?><emails><email><OPFMessageCopyMessageID>&lt;m1@x&gt;</OPFMessageCopyMessageID><OPFMessageCopySubject>Budget</OPFMessageCopySubject>
<OPFMessageCopySentTime>2026-04-11T08:30:00</OPFMessageCopySentTime><OPFMessageCopyBody>Text</OPFMessageCopyBody>
<OPFMessageCopySenderAddress><emailAddress OPFContactEmailAddressAddress="Alex@Example.test" OPFContactEmailAddressName="Alex"/></OPFMessageCopySenderAddress>
<OPFMessageCopyToAddresses><emailAddress OPFContactEmailAddressAddress="r@example.com" OPFContactEmailAddressName="R"/></OPFMessageCopyToAddresses>
<OPFMessageCopyAttachmentList><messageAttachment OPFAttachmentName="ledger.txt"/></OPFMessageCopyAttachmentList></email></emails>"""


def test_mail_archive(spark, tmp_path):
    folder = "Accounts/a/com.microsoft.__Messages/Inbox"
    with zipfile.ZipFile(tmp_path / "box.olm", "w") as archive:
        archive.writestr(f"{folder}/1.xml", MESSAGE)
        archive.writestr(f"{folder}/2.xml", "<broken")
        archive.writestr(f"{folder}/3.xml", MESSAGE + " " * 5000)
        archive.writestr("other/4.xml", MESSAGE)
    mail_zip.register(spark)
    rows = spark.read.format("mail_zip").option("membersPerPartition", 2).option("maxMemberBytes", 4000).load(f"{tmp_path}/*.olm").orderBy("member").collect()
    assert [r["error"] is None for r in rows] == [True, False, False]
    good = rows[0]
    assert (good["message_id"], good["subject"], good["sender"], good["recipients"], good["attachments"]) == ("m1@x", "Budget", "alex@example.test", ["r@example.com"], ["ledger.txt"])


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("=cmd", 1), (None, 2)], "a string, b int")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert sorted(r["a"] or "" for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()) == ["", "'=cmd"]
    edges = spark.createDataFrame([("a<b", "c", 2)], "sender string, recipient string, email_count long")
    sinks.write_graphml(edges, str(tmp_path / "g.xml"))
    from xml.etree import ElementTree

    assert len(ElementTree.parse(tmp_path / "g.xml").getroot()) == 2


def test_writing_metrics_cut_a_text_once(spark):
    """The word pattern stands once in the plan: neither a filter nor a measure cuts the text again."""
    from lettermill.functions import analysis

    rows = spark.createDataFrame([(1, "One two three four five six. Seven?"), (2, "short"), (3, None), (4, "1 2 3 4 5 6 7 8 9 10 11 12")], "id int, text string")
    found = analysis.measured(rows, "id", "text")
    assert [(r["id"], r["word_count"], r["sentence_count"], r["formality_score"]) for r in found.collect()] == [(1, 7, 2, 0.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(lower(") == 1
