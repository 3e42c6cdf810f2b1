import json
import random

import pytest
from pyspark.sql import functions as F

from sluice.functions import similarity as S
from sluice.operators import blocking, graph, relational, review
from sluice.operators.components import connected_components
from sluice.sources import extraction, files, pages
from sluice.storage import load_state, save_state


def test_similarities():
    assert S.indel("", "") == 1 and S.indel("a", "") == 0
    assert S.indel("kitten", "sitting") == pytest.approx(2 * 4 / 13)
    assert S.partial("abc", "xxabcxx") == 1
    assert S.token_sort("b a", "a b") == 1
    assert S.token_set("a b", "a b c") == 1 and S.token_set("", "a") == 0
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)


def test_features_of_nulls_and_empty(spark):
    df = spark.createDataFrame([("", ""), (None, "a"), ("ab c", "ab d")], "left_norm string, right_norm string")
    rows = {(r["left_norm"], r["right_norm"]): r for r in S.featurize(df).collect()}
    assert rows[None, "a"]["ratio"] == 0 and rows[None, "a"]["levenstein"] == 0
    assert rows["", ""]["levenstein"] == 1 and rows["", ""]["first_letter_jaccard"] == 0
    assert rows["ab c", "ab d"]["levenstein"] == 0.75 and rows["ab c", "ab d"]["first_letter_jaccard"] == pytest.approx(1 / 3)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (None, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100} and 200 not in got


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_settle_in_one_task(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(4000), rng.randrange(4000)) for _ in range(1500)] + [(i, i + 1) for i in range(5000, 5300)] + [(6000, 7000 + i) for i in range(300)] + [(-5, 3), (8, 8), (None, 9)]
    df = spark.createDataFrame(edges, "a long, b long")
    rows = lambda d: sorted(map(tuple, d.collect()))
    before = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    found = rows(connected_components(df, at_once=10_000))
    after = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    assert found == rows(connected_components(df)) == rows(connected_components(df, at_once=100))
    assert after - before <= 8
    assert rows(connected_components(spark.createDataFrame([], "a long, b long"), at_once=10)) == []


def test_blocking_keeps_every_pair_over_the_threshold(spark):
    names = ["american bar assn", "american bar asn", "bar assn of america", "natl fdn of law", "natl fdn law", "x", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    w = blocking.tfidf(df, blocking.char_grams(F.col("name")))
    got = {(r["left_side"], r["right_side"]) for r in blocking.top_pairs(w, 0.5).collect()}
    by: dict = {}
    for r in w.collect():
        by.setdefault(r["name"], {})[r["term"]] = r["weight"]
    want = {(a, b) for a in by for b in by if a != b and round(sum(by[a][t] * by[b].get(t, 0) for t in by[a]), 6) >= 0.5}
    assert got == want and want


def test_legal_pairs_share_no_document(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("a", "a")], "left_side string, right_side string")
    docs = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "norm string, doc_id long")
    assert [tuple(r) for r in blocking.legal_pairs(pairs, docs).collect()] == [("a", "c")]


def test_pairs_apart_meet_within_documents(spark):
    rng = random.Random(6)
    docs = [(f"n{rng.randrange(30):02d}", d) for d in range(25) for _ in range(rng.choice([1, 2, 3, 12]))] + [(None, 1), ("n00", None), ("n01", None)]
    pairs = sorted({tuple(sorted((f"n{rng.randrange(32):02d}", f"n{rng.randrange(32):02d}"))) for _ in range(150)})
    p, d = spark.createDataFrame(pairs, "left_norm string, right_norm string").where("left_norm < right_norm"), spark.createDataFrame(docs, "norm string, doc_id long")
    at = lambda n: {x for m, x in docs if m == n and x is not None}
    want = sorted(q for q in pairs if q[0] < q[1] and not at(q[0]) & at(q[1]))
    for most in (0, 4, 32):
        assert sorted(map(tuple, blocking.apart_in_documents(p, d, most).collect())) == want
    # each of 1,000 names has 19 partners and 5,000 documents: 95 million meetings, of which documents of two names hold none
    many = spark.range(5_000_000).select(F.format_string("n%04d", F.col("id") % 1000).alias("norm"), F.col("id").alias("doc_id"))
    wide = spark.range(19_000).select(F.format_string("n%04d", F.floor(F.col("id") / 19)).alias("left_norm"), F.format_string("z%02d", F.col("id") % 19).alias("right_norm"))
    assert blocking.apart_in_documents(wide, many).count() == 19_000


def test_closure_and_conflicts(spark):
    d = spark.createDataFrame([("a", "b", True), ("b", "c", True), ("c", "d", False), ("a", "c", False)], "`left` string, `right` string, is_match boolean")
    comp = graph.match_components(d)
    assert {(r["u"], r["v"], r["is_match"]) for r in graph.closure(d, comp).collect()} == {("a", "b", True), ("a", "c", True), ("b", "c", True), ("a", "d", False), ("b", "d", False), ("c", "d", False)}
    assert [tuple(r) for r in graph.conflicts(d, comp).collect()] == [("a", "a", "c")]


def test_closure_of_a_large_component_is_many_tasks(spark):
    rng = random.Random(2)
    d = spark.createDataFrame([(rng.randrange(60), rng.randrange(60), rng.random() < 0.7) for _ in range(70)], "`left` long, `right` long, is_match boolean").where("`left` != `right`")
    comp = graph.match_components(d)
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(graph.closure(d, comp, most=3)) == rows(graph.closure(d, comp)) and rows(graph.closure(d, comp))
    star = spark.range(1, 6_001).select(F.lit(0).cast("long").alias("left"), F.col("id").alias("right"), F.lit(True).alias("is_match"))
    sizes = [r["count"] for r in graph.closure(star, graph.match_components(star)).groupBy(F.spark_partition_id().alias("at")).count().collect()]
    assert sum(sizes) == 6_001 * 6_000 // 2 and max(sizes) < sum(sizes) / 2


def test_labels_refuse_contradictions():
    g = graph.Labels()
    assert g.label("a", "b", True) == [("a", "b", True)]
    assert g.label("b", "c", True) == [("a", "c", True), ("b", "c", True)]
    assert {x[:2] for x in g.label("c", "d", False)} == {("a", "d"), ("b", "d"), ("c", "d")}
    assert g.label("a", "d", True) is None and g.label("a", "c", False) is None
    assert ("e", "d", True) in g.label("e", "d", True)
    assert g.label("a", "e", True) is None


def test_labels_are_counted_as_they_are_listed(spark):
    rng = random.Random(5)
    for most in (0, 2, 1000):
        listed, counted = graph.Labels(), graph.LabelCounts(most)
        for _ in range(600):
            a, b, m = rng.randrange(40), rng.randrange(40), rng.random() < 0.2
            got = listed.label(a, b, m)
            assert counted.label(a, b, m) == (None if got is None else len(got))
    # two halves of 20,000 names meet in one decision: 400 million pairs, which no task can list
    n = 20_000
    d = spark.range(2 * n - 1).select("id", F.lit(1).alias("project"), F.when(F.col("id") < 2 * n - 2, F.col("id") + (F.col("id") >= n - 1).cast("long")).otherwise(0).alias("left"), F.lit(True).alias("is_match"))
    d = d.withColumn("right", F.when(F.col("id") < 2 * n - 2, F.col("left") + 1).otherwise(n))
    last = graph.apply_in_order(d, "project", "id").where(F.col("id") == 2 * n - 2).first()
    assert last["accepted"] and last["implied"] == n * n


def test_mapping_takes_the_medoid(spark):
    comp = spark.createDataFrame([("ab", "ab"), ("abc", "ab"), ("zz", "zz")], "node string, component string")
    nodes = spark.createDataFrame([("ab", 1, "AB"), ("ab", 2, "AB"), ("abc", 3, "ABC"), ("zz", 4, "Z")], "norm string, doc_id long, raw_name string")
    assert {tuple(r) for r in graph.name_mapping(comp, nodes).collect()} == {("ab", "AB"), ("abc", "AB")}


def test_regular_equivalence_of_large_components_agrees(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 4), (9, 8)], "u long, v long")
    a = {(r["u"], r["v"]): r["sigma"] for r in graph.regular_equivalence(e).collect()}
    b = {(r["u"], r["v"]): r["sigma"] for r in graph.regular_equivalence(e, largest=1).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)


def test_equivalence_through_a_cover(spark):
    rng = random.Random(3)
    edges = sorted({(f"h{rng.randrange(6)}", f"n{rng.randrange(40):02d}") for _ in range(120)}) + [("h0", "h1"), ("h1", "h2"), ("y", "z")]
    e = spark.createDataFrame(edges, "u string, v string")
    rows = lambda d, x: {(r["u"], r["v"]): r[x] for r in d.collect()}
    a, b = rows(graph.regular_equivalence(e), "sigma"), rows(graph.regular_equivalence(e, largest=5, cover=8), "sigma")
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
    ask = [("h0", "h0"), ("h0", "n01"), ("n01", "n01"), ("n02", "n01"), ("n01", "h5"), ("y", "z"), ("y", "h0"), ("n01", "none"), (None, "y")]
    for largest in (2, 2000):
        got = rows(graph.regular_equivalence(e, largest=largest, cover=8, pairs=spark.createDataFrame(ask, "u string, v string")), "sigma")
        assert got.keys() == {k for k in ask if k in a} and all(got[k] == pytest.approx(a[k], abs=1e-12) for k in got)


def test_pairs_of_a_large_component_make_no_table_of_all_pairs(spark):
    # a star of 30,000 names has 900 million pairs
    e = spark.range(30_000).select(F.lit(-1).cast("long").alias("u"), F.col("id").alias("v"))
    got = graph.regular_equivalence(e, pairs=spark.createDataFrame([(3, 4), (3, 3), (-1, 3)], "u long, v long")).collect()
    hub = 1 / (30_000 * (1 - 0.85**2))
    want = {(3, 4): 0.85**2 * hub, (3, 3): 1 + 0.85**2 * hub, (-1, 3): 0.85 * hub}
    assert {(r["u"], r["v"]) for r in got} == want.keys() and all(r["sigma"] == pytest.approx(want[r["u"], r["v"]], rel=1e-9) for r in got)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (1.0,), (1.2,), (None,)], "match_probability double")
    assert {r["bin"]: r["count"] for r in review.probability_histogram(df).collect()} == {i: int(i in (0, 1, 9)) for i in range(10)}


def test_queue_skips_reviewed_pairs_in_either_order(spark):
    scored = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.5), ("c", "a", 0.2)], "left_norm string, right_norm string, match_probability double")
    done = spark.createDataFrame([("b", "a")], "`left` string, `right` string")
    assert [(r["left_norm"], r["right_norm"]) for r in review.candidate_queue(scored, done, True).collect()] == [("b", "c"), ("a", "c")]


def test_training_guards(spark):
    rows = [(float(i % 2), float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "label double, x double")
    assert review.train(df.limit(4), ["x"]) is None
    with pytest.raises(ValueError):
        review.train(df, ["x"], kind="other")
    model = review.train(df, ["x"])
    assert {0 <= r["match_probability"] <= 1 for r in review.match_probability(df, model).collect()} == {True}
    assert review.match_probability(df, None).first()["match_probability"] == 0


def test_progress_of_nothing(spark):
    r = review.progress(spark.createDataFrame([], "ts timestamp"), 10).first()
    assert r["decisions"] == 0 and r["per_hour"] is None


def test_tables_from_records(spark, tmp_path):
    rec = {"dockets": [{"year": 20, "number": 1599, "position": "P"}], "filers": [{"name": "X", "category": "organization"}], "all_on_cover_page": True, "lawyers": [{"name": "A", "role": None, "employer": "E"}, {"name": None}], "counsel_of_record": "A"}
    (tmp_path / "b.json").write_text(json.dumps(rec))
    (tmp_path / "a.json").write_text("{broken")
    found = files.extractions(spark, str(tmp_path))
    assert [r["source"] for r in found.select("source", "corrupt", "filers").collect() if r["corrupt"]] == ["a"]
    t = relational.document_tables(found.where("corrupt is null"))
    assert t["documents"].first()["complete_list"] is True
    assert [tuple(r)[2:] for r in t["lawyers"].collect()] == [("A", "", "E", True), ("", "", "", False)]
    relational.create_tables(spark, "held")
    relational.save_tables(t, "held")
    assert relational.list_tables(spark, "held") == ["dockets", "documents", "filers", "lawyers"]
    relational.export_csv(spark, "held", str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/dockets"), header=True).first()["number"] == "1599"


def test_records_numbered_by_their_keys(spark):
    df = spark.createDataFrame([("b", "u"), (None, "v"), ("a", "w")], "source string, url string").select("*", F.lit("c").alias("counsel_of_record"), *(F.lit(None).cast(f"array<struct<{x}>>").alias(n) for n, x in (("dockets", "year int, number int, position string"), ("filers", "name string, category string"), ("lawyers", "name string, role string, employer string"))))
    for hold in (True, False):
        got = relational.document_tables(df, keys=df.select("source"), hold=hold)["documents"].collect()
        assert sorted((r["document_id"], r["url"]) for r in got) == [(1, "w"), (2, "u")]


def test_page_links(spark):
    page = '<p>amicus</p><table id="proceedings"><tr><th></th></tr><tr><td>Jul 1 2020</td><td>Brief amicus</td></tr><tr><td><a href="a.txt">Main Document</a><a href="b.pdf">Main Document</a><a href="c.pdf">Other</a></td></tr><tr><td>odd</td></tr></table>'
    df = spark.createDataFrame([("http://h/x/1.html", page), ("u", "<p>no</p>"), ("v", None), ("w", "amicus, no table")], "url string, html string")
    assert pages.page_links(df).count() == 0  # the first main document is no PDF
    assert [r["url"] for r in pages.page_links(df, every=True).collect()] == ["http://h/x/b.pdf"]


def test_case_pages(spark):
    row = lambda label, value: f'<div class="row docSegRow"><div class="segColL x">{label}</div><div class="r">{value}</div></div>'
    page = row("Case", "A <b>v.</b> B") + row("Amicus curiae", "One") + row("", "Two") + row("", "Show all 9") + row("Petitioner", " P\n Q ") + row("Date filed", "")
    df = spark.createDataFrame([("u", page), ("v", None)], "url string, html string")
    got = {r["url"]: r for r in pages.case_pages(df).collect()}
    assert got["u"]["case_title"] == "A v. B" and got["u"]["filer_organizations"] == ["One", "Two"] and got["u"]["petitioners"] == ["P Q"]
    assert got["u"]["date_filed"] is None and got["v"]["respondents"] == [] and got["v"]["case_title"] is None


def test_results_meet_their_pairs(spark):
    pairs = spark.createDataFrame([(0, 1, "a"), (0, 2, "b")], "batch long, pair int, x string")
    judged = spark.createDataFrame([(0, 2, True)], "batch long, pair int, same boolean")
    met, lost = extraction.link_results(pairs, judged)
    assert [r["x"] for r in met.collect()] == ["b"] and [r["x"] for r in lost.collect()] == ["a"]
    first, second = (spark.createDataFrame([("k", v)], "custom_id string, v long") for v in (9, 1))
    assert extraction.latest_results([first, second]).first()["v"] == 1


def test_resolvent(spark):
    df = spark.createDataFrame([("a", "b", 0.4), ("b", "a", 0.6)], "left_norm string, right_norm string, p double")
    q = {(r["u"], r["v"]): r["q"] for r in graph.resolvent(df, "p").collect()}
    assert q["a", "a"] == pytest.approx(1 / (1 - 0.45**2)) and q["a", "b"] == pytest.approx(0.45 / (1 - 0.45**2))


def test_resolvent_of_large_components_agrees(spark):
    # one component whose alpha P is no contraction, and a pair
    rows = [(i, j, 0.2 + (i * 7 + j * 3) % 5 / 10) for i in range(1, 13) for j in range(i + 1, 13) if (i + j) % 3] + [(20, 21, 0.5)]
    df = spark.createDataFrame(rows, "left_norm long, right_norm long, p double")
    a = {(r["u"], r["v"]): r["q"] for r in graph.resolvent(df, "p").collect()}
    b = {(r["u"], r["v"]): r["q"] for r in graph.resolvent(df, "p", largest=2).collect()}
    assert len(a) == 12 * 12 + 2 * 2
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-8) for k in a)


def test_resolvent_through_a_cover_or_without(spark):
    rows = [(i, 100 + j, 0.2 + (i * 7 + j * 3) % 5 / 10) for i in range(4) for j in range(15) if (i + j) % 3] + [(0, 1, 0.3), (201, 202, 0.5)]
    df = spark.createDataFrame(rows, "left_norm long, right_norm long, p double")
    a, b, c = ({(r["u"], r["v"]): r["q"] for r in graph.resolvent(df, "p", largest=largest, cover=cover).collect()} for largest, cover in ((2000, 0), (2, 10), (2, 0)))
    assert a.keys() == b.keys() == c.keys() and all(a[k] == pytest.approx(b[k], abs=1e-10) and a[k] == pytest.approx(c[k], abs=1e-8) for k in a)


def test_responses(spark):
    body = {"choices": [{"message": {"content": '{"results":[{"pair":1,"are_same_entity":true,"confidence":0.9}]}'}}]}
    lines = [{"custom_id": "batch_3", "error": None, "response": {"body": body}}, {"custom_id": "batch_4", "error": None, "response": {"body": json.dumps(body)}}, {"custom_id": "e", "error": {"code": 1}}, {"custom_id": "n", "error": None, "response": {"body": {"choices": []}}}]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")
    from sluice.schemas import VERDICTS

    assert {r["custom_id"]: r["status"] for r in extraction.parse_responses(df, VERDICTS).collect()} == {"batch_3": "ok", "batch_4": "ok", "e": "error", "n": "empty"}
    assert sorted((r["batch"], r["pair"]) for r in extraction.verdicts(df).collect()) == [(3, 1), (4, 1)]


def test_requests_are_json(spark):
    df = spark.createDataFrame([("d", 'a "quoted"\n}text}')], "name string, text string")
    line = json.loads(extraction.document_requests(df, "prompt", schema='{"type": "object"}').first()["line"])
    assert line["body"]["messages"][1]["content"] == 'a "quoted"\n}text}' and line["body"]["response_format"]["json_schema"]["strict"] is True


def test_size_batches_drop_what_cannot_fit(spark):
    df = spark.createDataFrame([(1, "aaaa"), (2, "bbbb"), (3, "c" * 50), (4, "d")], "k long, line string").withColumn("g", F.lit(1))
    assert {r["k"]: r["part"] for r in extraction.size_batches(df, 10, "k", group="g").collect()} == {1: 0, 2: 0, 4: 1}


def test_size_batches_of_groups_and_of_all(spark):
    rng = random.Random(4)
    rows = [(g, k, "x" * rng.randrange(1, 30)) for g in [None, "a", "b"] + [f"g{i}" for i in range(40)] for k in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "g string, k int, line string")

    def filled(lines):
        out, held, now = {}, 0, 0
        for g, k, line in lines:
            n = len(line) + 1
            if n > 25:
                continue
            if held and held + n > 25:
                held, now = 0, now + 1
            held += n
            out[g, k] = now
        return out

    want = {}
    for g in {r[0] for r in rows}:
        want |= filled(sorted(r for r in rows if r[0] == g))
    done = extraction.size_batches(df, 25, "k", group="g")
    assert {(r["g"], r["k"]): r["part"] for r in done.collect()} == want
    plan = done._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan  # no task sees all lines
    one = spark.createDataFrame([("g", i, r[2]) for i, r in enumerate(rows)], "g string, k int, line string")
    parts = [r["part"] for r in extraction.size_batches(one, 25, "k").orderBy("k").collect()]
    assert parts[0] == 0 and {b - a for a, b in zip(parts, parts[1:], strict=False)} == {0, 1}


def test_records_without_a_docket(spark):
    rows = [("/18/18-5/x.pdf", None), ("/18/18-12345/x.pdf", None), ("/18/18-6/x.pdf", "failed")]
    df = spark.createDataFrame(rows, "source_file string, error string").select("*", F.expr("array(struct('A' as name, 'organization' as type)) as filers"), F.expr("struct('P' as position, array('No. 99-1') as dockets) as brief"))
    assert [r["docket_number"] for r in extraction.flat_legacy(df).collect()] == ["18-5"]
    assert sorted(r["docket_number"] for r in extraction.flat_legacy(df, missing="").collect()) == ["", "18-5"]


def test_pairs_that_are_none_have_no_cost(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "left_norm string, right_norm string")
    assert extraction.pair_cost(extraction.pair_batches(pairs), "p" * 100).first()["output_tokens"] == 150
    assert tuple(extraction.pair_cost(extraction.pair_batches(pairs.where("false")), "p" * 100).first()) == (None, None, None)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "b.txt").write_text("é")
    (tmp_path / "urls").write_text("www.h/x\n\nhttp://h/y\n")
    assert {r["text"] for r in files.texts(spark, str(tmp_path)).collect()} == {"é"}
    names = spark.createDataFrame([("a.pdf",), ("z.pdf",)], "blob string")
    assert [r["name"] for r in files.texts(spark, str(tmp_path), names).collect()] == ["a.txt"]
    assert [r["blob"] for r in files.missing_texts(spark, str(tmp_path), names).collect()] == ["z.pdf"]
    assert [r["url"] for r in files.url_list(spark, str(tmp_path / "urls")).collect()] == ["https://www.h/x", "http://h/y"]
    assert spark.createDataFrame([("Page 1 of 1,234",)], "t string").select(files.total_pages(F.col("t"))).first()[0] == 1234


def test_streamed_decisions(spark, tmp_path):
    from sluice.streaming import decisions as D

    rows = [("a", "b", True, "2024-01-01 00:10:00"), ("b", "c", True, "2024-01-01 00:20:00"), ("c", "d", False, "2024-01-01 01:20:00")]
    df = spark.createDataFrame(rows, "`left` string, `right` string, is_match boolean, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = D.read_decisions(spark, str(tmp_path / "in"), "`left` string, `right` string, is_match boolean, ts timestamp")
    q = stream.writeStream.foreachBatch(D.keep_views(spark, str(tmp_path / "log"), str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out/mismatches/0")).collect()] == [("a", "d")]
    q = D.decision_rates(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["decisions"], r["matches"]) for r in spark.sql("select * from rates").collect()) == [(1, 0), (2, 2)]


def test_state_is_loaded_whole(spark, tmp_path):
    at = str(tmp_path / "state")
    assert load_state(spark, at) == {}
    save_state({"a": spark.range(3)}, at)
    broken = save_state({"a": spark.range(5)}, at)
    (tmp_path / "state" / broken.rsplit("/", 1)[1] / "whole" / "_SUCCESS").unlink()
    assert load_state(spark, at)["a"].count() == 3


def test_equivalence_of_pairs(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "a"), ("a", "z"), (None, "b")], "left_norm string, right_norm string")
    sigma = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5)], "u string, v string, sigma double")
    got = {(r["left_norm"], r["right_norm"]): r["dc_reg_eq"] for r in graph.with_equivalence(pairs, sigma).collect()}
    assert got == {("a", "b"): 0.5, ("a", "a"): 1.0, ("a", "z"): 0.0, (None, "b"): 0.0}


def test_probable_edges_are_refused(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "norm string, doc_id long")
    pairs = spark.createDataFrame([("a", "b", 0.9), ("c", "a", 0.4), ("a", "c", 0.7), ("a", "a", 0.9), ("a", "x", 0.9)], "left_norm string, right_norm string, p double")
    assert [tuple(r) for r in graph.probable_edges(pairs, nodes, "p").collect()] == [("a", "c", 0.7)]


def test_probable_edges_of_names_known_otherwise(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 1)], "norm string, doc_id long")
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "x", 0.8), ("a", "z", 0.7)], "left_norm string, right_norm string, p double")
    known = spark.createDataFrame([("a",), ("b",), ("x",)], "norm string")
    assert [tuple(r) for r in graph.probable_edges(pairs, nodes, "p", known=known).collect()] == [("a", "x", 0.8)]


def test_name_pairs_without_gaps(spark):
    rows = spark.createDataFrame([("a", "b"), (None, "b"), ("a", " "), ("nan", "b")], "x string, y string")
    assert sorted(tuple(r) for r in extraction.name_pairs(rows, "x", "y").collect()) == [("a", "b"), ("nan", "b")]


def test_decision_log_counts_from_the_last_save(spark):
    rows = review.decision_log(spark.range(12), "id", save_every=5, train_every=10).orderBy("id").collect()
    assert [r["since_save"] for r in rows] == [1, 2, 3, 4, 0, 1, 2, 3, 4, 0, 1, 2]
    assert [r["number"] for r in rows if r["trains"]] == [10]
