"""Small literal frames: rejects, ties, empty input, nulls, sinks and evaluation."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as X
from gristmill.operators import annotate, audit, curate, grouping, html, metrics, split, validate
from gristmill.sources import readers, sinks
from gristmill.streaming.incremental import label_stream

OK = "0 0 0 1 0 1 .75 0 .75"


def lines(spark, texts):
    return spark.createDataFrame([(i, t, 4.0, 4.0) for i, t in enumerate(texts)], "k int, text string, width double, height double")


def test_polygons_and_rejects(spark):
    texts = [OK, "23 0 0 1 0 1 1", "0 0 0 1 0 1", "0 0 0 1 0 1 1 0", "0 0 0 1 0 1 NaN", "0 0 0 1 0 1 1.1", "0 0 0 .5 .5 1 1", "0 0 0 1 x 1 1", "a 0 0 1 0 1 1", "0 0 0 1.0000005 0 1 1"]
    got = {r["k"]: r for r in validate.parse_polygons(validate.label_lines(lines(spark, texts)), 23).collect()}
    assert [got[i]["reason"] for i in range(10)] == [None, "class", "arity", "arity", "range", "range", "degenerate", "token", "token", None]
    assert got[0]["area"] == 12.0 and tuple(got[0]["bbox"]) == (0.0, 0.0, 4.0, 3.0)
    assert got[9]["segmentation"][2] == 4.0


def test_blank_lines_keep_numbers(spark):
    got = validate.label_lines(lines(spark, [f"\n  {OK}  \r\n\n{OK}"])).select("line_no", "line").collect()
    assert [(r[0], r[1]) for r in got] == [(2, OK), (4, OK)]


def test_records_and_pairs(spark):
    good, bad = validate.good_and_rejects(validate.parse_polygons(validate.label_lines(lines(spark, [OK, "", f"{OK}\n{OK}"])), 23))
    rec = validate.image_records(spark.range(3).select(F.col("id").cast("int").alias("k")), good, ["k"])
    assert {r["k"]: len(r["instances"]) for r in rec.collect()} == {0: 1, 1: 0, 2: 2} and bad.count() == 0
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    with pytest.raises(validate.ContractError, match="1 left, 1 right"):
        validate.require_pairs(a, b, ["k"])
    with pytest.raises(validate.ContractError):
        curate.required_join(a, b, "k")
    assert validate.require_pairs(a, a, ["k"]).count() == 2


def test_components(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "d"), ("x", None), ("z", "y"), ("b", "a")], "l string, r string")
    assert {tuple(r) for r in grouping.connected_components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("y", "y"), ("z", "y")}
    chain = spark.range(1, 200).select(F.col("id").alias("l"), (F.col("id") - 1).alias("r"))
    got = grouping.connected_components(chain).collect()
    assert len(got) == 200 and {r["component"] for r in got} == {0}
    assert grouping.connected_components(e.limit(0)).count() == 0


def test_a_round_of_components_shuffles_few_times(spark, monkeypatch):
    """Every shuffle of a round is a stage of all partitions, however few edges are left."""
    plans, write = [], grouping.materialize

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(grouping, "materialize", noted)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)], "a int, b int")
    try:
        assert {r["component"] for r in grouping.connected_components(chain).collect()} == {0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert max(len(re.findall(r"(?<!Reused)Exchange (?:hash|range|Single)", p)) for p in plans[1:]) <= 10
    assert max(p.count("Scan parquet") for p in plans[1:]) <= 6


def test_leakage_quantiles_overlap(spark):
    df = spark.createDataFrame([("g", "train"), ("g", "val"), ("h", "train")], "g string, s string")
    r = audit.leakage_profile(df, "g", "s").first()
    assert (r["source_group_count"], r["cross_split_source_groups"], r["group_rate"], r["image_rate"]) == (2, 1, 0.5, 0.666667)
    assert audit.leakage_profile(df.limit(0), "g", "s").first()["group_rate"] == 0.0
    q = {r["q"]: r["value"] for r in audit.quantiles(spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8, 16)], "v double"), "v").collect()}
    assert q[0.9] == 12.8
    assert audit.quantiles(spark.createDataFrame([], "v double"), "v").count() == 0
    assert audit.overlap(df, "g", "s", [("train", "val")]).first()["shared_groups"] == 1


def test_representative_tie_and_reason(spark):
    df = spark.createDataFrame([("g", 2, "b"), ("g", 2, "a"), ("g", 1, "0")], "g string, n int, f string")
    assert split.representatives(df, "g", "n", "f").first()["f"] == "a"
    r = spark.createDataFrame([(0, True), (1, True), (1, False)], "n int, s boolean").select(audit.selection_reason(F.col("n"), F.col("s")).alias("r"))
    assert [x["r"] for x in r.collect()] == ["excluded_empty_label", "selected", "omitted_correlated_eval_variant"]


def test_provenance_and_keys(spark):
    df = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "b")], "k int, t int, q string")
    assert audit.provenance_merge(df, "k", "q", "t").first()["provenance"] == "b; a"
    r = spark.createDataFrame([("a.jpg.rf.x.rf.y",)], "s string").select(X.source_key(F.col("s")), X.normalize_newlines(F.lit("a\r\nb\rc")), X.unescape(F.lit("a&amp;b"))).first()
    assert tuple(r) == ("a.jpg", "a\nb\nc", "a&b")
    df = spark.createDataFrame([(1, ".JPG"), (1, ".jpg")], "k int, s string")
    assert curate.first_choice(df, "k", "s", [".jpg", ".jpeg", ".JPG"]).first()["s"] == ".jpg"
    assert curate.wanted(df, ["s", "zz"]).columns == ["s", "zz"]


@pytest.mark.parametrize("n", [0, 1, 3, 10, 15, 20, 30, 45])
def test_split_counts_round_half_to_even(spark, n):
    g = spark.range(n).select(F.col("id").alias("g"))
    train, val = round(n * 0.70), round(n * 0.15)
    want = {k: v for k, v in (("train", train), ("val", val), ("test", n - train - val)) if v}
    got = split.split_boundaries(g, "g").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == want
    cuts = split.split_cuts(g, "g", 4)
    scores = split.split_scores(cuts, g.withColumn("c", F.col("g") % 2), "g", "c")
    got = split.best_split(g, "g", cuts, scores).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == want


def test_split_search_matches_ranking(spark, monkeypatch):
    n, attempts = 200, 30
    g = [(i, c) for i in range(n) for c in range(9) if (i * 7 + c * c) % (c + 2) == 0] + [(0, 99), (1, 99)]
    df = spark.createDataFrame(g, "g int, c int")
    place = lambda i, a: ((h := hashlib.md5(str(i).encode()).hexdigest()) and (int(h[:13], 16) + a * int(h[13:26], 16)) % split.PRIME, i)
    best, ids = None, {i for i, _ in g}
    n = len(ids)
    for a in range(attempts):
        order = sorted(ids, key=lambda i: place(i, a))
        where = {i: "train" if k < round(n * 0.7) else "val" if k < round(n * 0.7) + round(n * 0.15) else "test" for k, i in enumerate(order)}
        dev = []
        for c in range(9):
            own = [where[i] for i, x in g if x == c]
            dev += [abs(own.count(s) / len(own) - r) for s, r in split.RATIOS.items() if c != 3 and len(own) >= 6]
        score = round(sum(dev) / len(dev), 8)
        best = (score, a, where) if best is None or score < best[0] else best
    for cells in (1, 64, 4096):
        monkeypatch.setattr(split, "CELLS", cells)
        cuts = split.split_cuts(df, "g", attempts)
        scores = split.split_scores(cuts, split.class_presence(df, "g", "c"), "g", "c", excluded=(3,))
        assert scores.count() == attempts and scores.orderBy("score", "attempt").first()[:] == (best[1], pytest.approx(best[0]))
        assert {r["g"]: r["split"] for r in split.best_split(df, "g", cuts, scores).collect()} == best[2]


def test_files_csv_json_sinks(spark, tmp_path):
    for s in ("train", "val"):
        (tmp_path / "labels" / s).mkdir(parents=True)
        (tmp_path / "labels" / s / "x.txt").write_text(OK + "\n")
        (tmp_path / "labels" / s / "x.PNG").write_bytes(b"1")
    root = str(tmp_path / "labels")
    assert {(r["split"], r["stem"], r["suffix"]) for r in readers.scan_files(spark, root, ["train", "val"], readers.IMAGE_SUFFIXES).collect()} == {("train", "x", "png"), ("val", "x", "png")}
    assert readers.read_label_text(spark, root, ["train", "val"]).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.scan_files(spark, root, ["test"], ["png"])
    (tmp_path / "a.csv").write_text("a,b\n1,\n2,3\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv"), "a int, b int").collect()] == [(1, None), (2, 3)]
    (tmp_path / "l.txt").write_text(" x \n\n# no\ny\n")
    assert [r[0] for r in readers.read_line_list(spark, str(tmp_path / "l.txt")).collect()] == ["x", "y"]
    (tmp_path / "a.json").write_text('[{"id": 1, "v": "a"}, {"id": 1, "v": "b"}]')
    j = readers.read_json(spark, str(tmp_path / "a.json"), "id int, v string").withColumn("o", F.monotonically_increasing_id())
    assert readers.keyed_last(j, "id", "o").first()["v"] == "b"
    with pytest.raises(Exception, match="mismatch"):
        readers.verify_sha256(spark.createDataFrame([("x",)], "content string"), "00").collect()
    df = spark.createDataFrame([("b",), ("a",)], "f string")
    out = str(tmp_path / "m")
    sinks.write_manifest(df, out, "f")
    assert [r[0] for r in spark.read.text(out).orderBy("value").collect()] == ["a", "b"]
    with pytest.raises(FileExistsError):
        sinks.refuse_existing(spark, out)
    sinks.write_document(spark, str(tmp_path / "r.json"), {"a": 1})
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 1}
    sinks.install(spark, str(tmp_path / "set"), lambda p: sinks.write_csv(df, p))
    assert spark.read.csv(str(tmp_path / "set"), header=True).count() == 2
    sinks.append_manifest(df, str(tmp_path / "set"))
    assert spark.read.csv(str(tmp_path / "set"), header=True).count() == 4

    def fail(p):
        sinks.write_csv(df, p)
        raise RuntimeError

    with pytest.raises(RuntimeError):
        sinks.install(spark, str(tmp_path / "no"), fail)
    assert not (tmp_path / "no").exists() and not (tmp_path / "no.staging").exists()


def test_coco_document(spark):
    good, _ = validate.good_and_rejects(validate.parse_polygons(validate.label_lines(lines(spark, [OK, f"{OK}\n1 0 0 .5 0 .5 .5"]).withColumn("file_name", F.format_string("f%d", "k"))), 23))
    img = spark.createDataFrame([("f1", 4, 4), ("f0", 4, 4)], "file_name string, width int, height int")
    cats = annotate.categories(spark, ["a", "b"])
    doc = annotate.coco_document(img, annotate.full_instances(good), cats).first()
    assert [i["id"] for i in doc["images"]] == [1, 2] and [a["image_id"] for a in doc["annotations"]] == [1, 2, 2] and [a["category_id"] for a in doc["annotations"]] == [1, 1, 2]
    u = annotate.union_instances(good, spark.createDataFrame([(0, 7), (1, 7)], "class_id int, category_id int"))
    assert {r["file_name"]: r["area"] for r in u.collect()} == {"f0": 12.0, "f1": 14.0}
    with pytest.raises(validate.ContractError):
        annotate.coco_document(img, annotate.full_instances(good), cats, "other")


def test_average_precision(spark):
    box = "struct<x:double,y:double,w:double,h:double>"
    gt = spark.createDataFrame([(1, 1, 1, (0.0, 0.0, 10.0, 10.0)), (2, 1, 1, (20.0, 0.0, 10.0, 10.0)), (3, 1, 2, (0.0, 0.0, 5.0, 5.0))], f"gt_id long, image_id long, category_id long, box {box}")
    dt = spark.createDataFrame([(1, 1, 1, 0.9, (0.0, 0.0, 10.0, 10.0)), (2, 1, 1, 0.8, (50.0, 0.0, 10.0, 10.0)), (3, 1, 1, 0.7, (20.0, 0.0, 10.0, 10.0))], f"det_id long, image_id long, category_id long, score double, box {box}")
    ap = metrics.average_precision(gt, dt)
    got = {(r["category_id"], r["threshold"]): r["ap"] for r in ap.collect()}
    assert metrics.report(metrics.evaluate(gt.limit(0), dt)).filter("value <> -1").count() == 0
    assert abs(got[(1, 0.5)] - (51 + 50 * 2 / 3) / 101) < 1e-9 and got[(2, 0.5)] == 0.0
    assert metrics.summary(ap.limit(0)) == (0.0, 0.0)


def test_html_cards_and_page(spark):
    h = """<article class="x card"><a id="images_7_7" title="">t</a><article class="inner"><img alt="old" src="o.jpg"></article><img alt="A &amp; B" src="s.jpg"></article>
    <article class="card"><img alt="second" src="/photos/12/345/x.jpg"><p id="images_" title="Given"></p></article><article class="card"><img alt="no id" src="/other/9/"></article><article><a id="images_1"></a></article>
    <h1>First</h1><h1> T <b>two</b>
    three</h1><h3>Photo by P</h3><h3>By nobody</h3><h3>Photo by <i>Q</i></h3><script>var x</script><p>Date Taken: 01.02.2003 Location: ROME, IT  Web Views: 3 Resolution: 10x20 Public Domain</p>"""
    df = spark.createDataFrame([(1, h), (2, None)], "page_id int, html string")
    assert [tuple(r) for r in html.cards(df, token="card").collect()] == [(1, "7_7", "A & B", "A & B", "s.jpg"), (1, "345", "Given", "second", "/photos/12/345/x.jpg")]
    r = html.page_metadata(html.page_fields(df)).orderBy("page_id").collect()
    assert (r[0]["title"], r[0]["credit"]) == ("T two three", "Photo by Q") and "var x Date Taken: 01.02.2003 Location: ROME, IT" in r[0]["page_text"]
    assert [r[0][k] for k in ("date", "location", "resolution", "status")] == ["01.02.2003", "ROME, IT", "10x20", "PUBLIC DOMAIN"]
    assert [r[1][k] for k in ("title", "credit", "page_text", "date", "location", "status")] == ["", "", "", "", "", "UNVERIFIED"]


def test_label_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(f"{OK}\nbad")
    q = label_stream(spark, str(tmp_path / "in"), 23, 4.0, 4.0).writeStream.format("memory").queryName("labels_in").start()
    q.processAllAvailable()
    q.stop()
    assert {r["reason"] for r in spark.table("labels_in").collect()} == {None, "token"}
