"""Operators on small inputs: the cases that the driver's tables don't hold."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.functions import model, text
from quillon.operators import extraction, geometry, linking, rules, structure, summary
from quillon.plans import review
from quillon.sources import documents, store
from quillon.streaming import progress


def as_dicts(frame, *order):
    return [r.asDict() for r in frame.orderBy(*order).collect()]


def test_sections_pages_levels_and_preface(spark):
    body = "before\n\f\n# A\n\n  x  \n### B\ny\n\f\n## C\n# D"
    got = as_dicts(structure.sections(spark.createDataFrame([("d", body)], "doc_id string, text string")), "ord")
    assert [(r["sec_id"], r["title"], r["level"], r["parent_ord"], r["page"], r["text"]) for r in got] == [("1", "page 1", 1, None, 1, "before"), ("1", "A", 1, None, 2, "x"), ("1.1", "B", 3, 1, 2, "y"), ("1.1", "C", 2, 1, 3, ""), ("2", "D", 1, None, 3, "")]


def test_unreviewed_is_said(spark):
    parts = spark.createDataFrame([("d", 1, "1", "A", "x")], "doc_id string, ord long, sec_id string, title string, text string")
    assert [r["unreviewed"] for r in rules.text_pattern(parts).collect()] == [True]
    assert rules.placeholders(parts, []).count() == 0
    blind = rules.completeness(parts.withColumn("sec_id", F.lit("")), [("1", "A")]).collect()
    assert [(r["severity"], r["unreviewed"]) for r in blind] == [("info", True)]


def test_majority_ties_gaps_and_versions(spark):
    rows = [(1, "f", "a", "x", True), (1, "f", "b", "x (Ver 2)", True), (1, "f", "c", "y", True), (2, "f", "a", "x", True), (2, "f", "b", "y", True), (3, "f", "a", "x", True), (3, "f", "b", None, False)]
    got = as_dicts(linking.majority(spark.createDataFrame(rows, "case_id int, field string, output_key string, value string, found boolean")), "case_id")
    assert [(r["wrong"], r["verdict"]) for r in got] == [(["c"], "differs"), (["a", "b"], "differs"), ([], "unreviewed")]


def test_traceability_of_an_empty_side(spark):
    a = spark.createDataFrame([("R-1",)], "id string")
    got = linking.traceability(a, a.where("false")).collect()
    assert [(r["side"], r["unreviewed"]) for r in got] == [("both", True)]


def test_captured_groups(spark):
    x = spark.createDataFrame([("no 12 of 34",)], "v string")
    pick = lambda p: x.select(text.captured(F.col("v"), p)).head()[0]
    assert (pick(r"no (\d+)"), pick(r"no \d+"), pick(r"(no) (?P<value>\d+)"), pick("zzz")) == ("12", "no 12", "12", None)


def test_one_object():
    assert json.loads(text.one_object('a {"id": 1} b')) == {"id": 1}
    assert text.one_object('{"id": 1} {"id": 2}') is None
    assert json.loads(text.one_object('{"out": {"id": 3}}', {"id"})) == {"id": 3}
    assert text.one_object("{" * 2000) is None
    assert text.one_object('{"a":' * 50_000 + "1" + "}" * 50_000) is None
    assert json.loads(text.one_object('{"id": 1, "t": "a  b"} {"t": "a b", "id": 1}')) == {"id": 1, "t": "a  b"}


def test_geometry(spark):
    chars = [(1, "b", 6.0, 10.0, 0.2, 10.0), (1, "a", 0.0, 5.0, 0.0, 10.0), (1, "c", 20.0, 25.0, 0.0, 10.0), (1, "d", 0.0, 5.0, 20.0, 30.0)]
    frame = spark.createDataFrame(chars, "page int, text string, x0 double, x1 double, top double, bottom double")
    assert [r["text"] for r in geometry.rendered_lines(frame).orderBy("line_no").collect()] == ["ab c", "d"]
    assert geometry.bands(frame).count() == 2
    slots = spark.createDataFrame([(1, 1, 100.0, 50.0), (1, 2, 10.0, 10.0)], "doc_id long, number int, width double, height double")
    images = spark.createDataFrame([(1, 1, 20.0, 20.0), (1, 2, 101.0, 50.0)], "doc_id long, number int, width double, height double")
    assert sorted((r["image_no"], r["slot_no"]) for r in geometry.matched_images(slots, images).collect()) == [(1, 2), (2, 1)]


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Ti</w:t></w:r><w:r><w:t>tle</w:t></w:r></w:p><w:p><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:t>body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style></w:styles>')
        z.writestr("word/media/i.png", b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big"))
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx())
    (tmp_path / "b.md").write_text("# x\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("﻿k,v\n1,2\n", encoding="utf-8")
    (tmp_path / "d.docx").write_bytes(b"no zip")
    (tmp_path / "e.xyz").write_bytes(b"?")
    got = {r["doc_id"][-6:]: r for r in documents.load_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"]["text"] == "# Title\nbody\n| a | b |"
    assert got["c.csv"[-6:] if "c.csv" in got else "/c.csv"]["text"] == "| k | v |\n| 1 | 2 |"
    assert got["d.docx"]["error"] and got["/e.xyz"]["error"].startswith("unknown format")
    assert [(r["width"], r["height"]) for r in documents.load_images(spark, str(tmp_path)).collect()] == [(7, 9)]


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("1", "review", "t", "a", 1, "{}"), ("2", "case", "t", "b", 0, "{}")], store.ENTRY)
    store.save_entries(rows, str(tmp_path / "h"))
    (tmp_path / "h" / "broken.json").write_text("{oops\n")
    assert [r["entry_id"] for r in store.read_entries(spark, str(tmp_path / "h")).collect()] == ["2", "1"]
    patched = store.updated(rows, spark.createDataFrame([("1", "new", None)], "entry_id string, title string, payload string"))
    assert sorted(r["title"] for r in patched.collect()) == ["b", "new"]


def test_review_routes_every_criterion(spark):
    docs = spark.createDataFrame([("d", "# A\nTBD here")], "doc_id string, text string")
    rules_ = [review.Criterion("1", "no gaps", "placeholder", params={"markers": ["TBD"]}), review.Criterion("2", "by eye", "unknown"), review.Criterion("3", "by model", agent="quality")]
    found, status = review.review(docs, rules_)
    assert [r["quote"] for r in found.collect()] == ["TBD here"]
    assert [(r["no"], r["status"]) for r in status.orderBy("pos").collect()] == [("1", "flagged"), ("2", "manual"), ("3", "noanswer")]


def test_model_errors_are_values(spark):
    def broken(prompt):
        raise ValueError("down") if prompt == "b" else KeyError(prompt) if prompt == "c" else None

    frame = spark.createDataFrame([("a",), ("b",)], "p string")
    got = {r["p"]: (r["answer"], r["error"]) for r in model.asked(frame, "p", lambda p: p.upper() if p == "a" else 1 / 0).collect()}
    assert got["a"] == ("A", None) and "division" in got["b"][1]
    assert model.asked(frame, "p").select("answer").distinct().head()[0] == ""


def test_progress_stream(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps({"run_id": 1, "seq": i, "lane": "a", "i": i, "total": 3}) for i in (1, 3, 2)))
    q = progress.progress_state(progress.progress_events(spark, str(source)), "lanes", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [(r["i"], r["total"]) for r in spark.table("lanes").collect()] == [(3, 3)]


def test_merge_and_status(spark):
    f = spark.createDataFrame([(1, "k", "s", ["a b"]), (2, "k", "s", ["ab"]), (3, "", "s", ["ab"]), (4, "k", "s", [])], "seq int, kind string, section string, quotes array<string>")
    assert [r["survivor"] for r in summary.merged(f).orderBy("seq").collect()] == [1, 1, 3, 4]
    lone = extraction.originals(spark.createDataFrame([("Plan_v2.docx",)], "name string")).head()["original"]
    assert lone == "Plan"


@pytest.mark.parametrize("value,want", [("2024. 2. 30.", None), ("2024-2-3", None), ("2024 .2 .3 .", "20240203"), ("soon", None), (None, None)])
def test_dates(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(text.date_key(F.col("v"))).head()[0] == want


def test_picture_sizes():
    from quillon.sources.documents import image_size

    pictures = {
        (3, 5): b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + b"\x00\x00\x00\x03\x00\x00\x00\x05",
        (7, 9): b"GIF89a\x07\x00\x09\x00",
        (4, 6): b"BM" + bytes(16) + b"\x04\x00\x00\x00" + b"\xfa\xff\xff\xff",
        (300, 200): b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc4\x00\x03x\xff\xd0\xff\xc2\x00\x08\x08\x00\xc8\x01\x2c\x03",
    }
    for size, data in pictures.items():
        assert image_size(data) == size
        assert image_size(data[:9]) is None
    assert image_size(b"") is None and image_size(b"plain") is None


def test_headings_need_dotted_numbers(spark):
    rows = [("a", 1, "number", " **3.0** "), ("a", 1, "title", " References"), ("b", 1, "number", "21"), ("b", 1, "title", "Scope"), ("c", 1, "number", "1.2"), ("c", 1, "number", "7"), ("c", 1, "title", "9 lives"), ("c", 1, "title", "Lives"), ("c", 1, "title", None)]
    heads = spark.createDataFrame(rows, "doc_id string, page int, kind string, text string")
    assert sorted(r["heading"] for r in structure.rescued_headings(heads).collect()) == ["1.2 Lives", "3.0 References"]
    levels = spark.createDataFrame([("1.0",), ("3.1",), ("2.3.0",), ("1.2.3.4.5.6.7",)], "n string").select(structure.heading_level(F.col("n")))
    assert [r[0] for r in levels.collect()] == [1, 2, 2, 6]


def test_boxes_by_centre(spark):
    boxes = "page int, box_id string, x0 double, y0 double, x1 double, y1 double"
    inner = spark.createDataFrame([(1, "in", 4.0, 4.0, 6.0, 6.0), (1, "edge", 10.0, 0.0, 10.8, 2.0), (1, "out", 10.0, 0.0, 11.2, 2.0), (2, "far", 4.0, 4.0, 6.0, 6.0)], boxes)
    outer = spark.createDataFrame([(1, "o", 0.0, 0.0, 10.0, 10.0)], boxes)
    assert sorted(r["inner_id"] for r in structure.centred(inner, outer).collect()) == ["edge", "in"]


def test_page_texts(spark):
    schema = "doc_id string, page int, ord int, part string, kind string, level int, text string, rows array<array<string>>"
    rows = [("d", 0, 1, "header", "paragraph", None, "No  1", None), ("d", 0, 2, "header-first", "table", None, None, [["No", None], ["", "1"]]), ("d", 0, 3, "body", "heading", 9, "A", None), ("d", 0, 4, None, "figure", None, " cat  x ", None), ("d", 0, 5, "body", "figure", None, None, None),
            ("d", 2, 6, "body", "table", None, None, [["a", "b"], ["c\nd", None]]), ("d", 2, 7, "body", "table", None, None, None), ("d", 2, 8, "body", "paragraph", None, "end", None), ("d", 2, 9, "footer", "paragraph", None, "p 3", None), ("e", 0, 1, "footer", "paragraph", None, " ", None)]
    got = {r["doc_id"]: r for r in structure.page_texts(spark.createDataFrame(rows, schema)).collect()}
    assert got["d"]["text"] == "###### A\n\n[그림 1: cat x]\n[그림 2]\n\f\n\n\f\n| a | b |\n| c d |  |\n\n(표: 구조 미복원)\n\nend"
    assert (got["d"]["headers"], got["d"]["footers"]) == (["No 1"], ["p 3"])
    assert (got["e"]["text"], got["e"]["headers"], got["e"]["footers"]) == ("", [], [])
    assert structure.page_texts(spark.createDataFrame([], schema)).count() == 0


def test_statements_at_odds(spark):
    def answers(prompt):
        name = prompt.split("\n")[1]
        if name == "R-4":
            raise ValueError("down")
        quotes = {"R-1": '상위 "five volts" vs 하위 “made up here”', "R-2": '상위 "three volts" vs 하위 "five volts"', "R-3": "no quotes"}
        return f" ISSUE: {quotes[name]}" if name in quotes else "OK"

    statement = "doc_id string, id string, text string"
    ids = ["R-1", "R-2", "R-3", "R-4", "R-5"]
    parents = spark.createDataFrame([("d", i, "x") for i in [*ids, "R-6"]], statement)
    children = spark.createDataFrame([("d", i, None) for i in ids], statement)
    upper = spark.createDataFrame([("d", "it has five  volts"), ("d", None)], "doc_id string, text string")
    lower = spark.createDataFrame([("d", "it has three volts")], "doc_id string, text string")
    got = {r["id"]: r for r in model.content_matched(parents, children, upper, lower, answers).collect()}
    assert set(got) == {"R-1", "R-4", None}  # a quote of the other side proves nothing
    assert (got["R-1"]["severity"], got["R-1"]["evidence"], got["R-1"]["unreviewed"]) == ("minor", ["five volts"], False)
    assert got["R-4"]["unreviewed"] and "down" in got["R-4"]["message"]
    assert got[None]["message"].endswith(": 2")


def test_checklists(spark, tmp_path):
    path = str(tmp_path / "lists")
    with pytest.raises(ValueError):
        store.save_checklist(path, "a", "a.csv", {}, [])
    first, second = (store.save_checklist(path, n, f"{n}.csv", {"text": 0}, [{"no": "1", "text": n}]) for n in ("a", " "))
    (tmp_path / "lists" / "broken.json").write_text("{oops")
    assert [(r["id"], r["name"], r["item_count"]) for r in store.checklists(spark, path).collect()] == [(second, " .csv", 1), (first, "a", 1)]
    assert store.checklist(path, first)["items"] == [{"no": "1", "text": "a"}]
    assert store.delete_checklist(path, first) and not store.delete_checklist(path, first)
    with pytest.raises(ValueError):
        store.checklist(path, "../etc")


def test_findings_by_section(spark):
    rows = [(1, "info", "10.1", False), (2, "major", "9.2", False), (3, "info", None, True), (4, "minor", "1", False)]
    frame = spark.createDataFrame(rows, "seq int, severity string, section string, unreviewed boolean")
    assert [r["seq"] for r in summary.shown(frame, ["info", "major"], by="section").collect()] == [3, 2, 1]
    assert [r["seq"] for r in summary.shown(frame, ["minor", "major"], unreviewed=False).collect()] == [2, 4]


def joined_rows(plan):
    """Rows that each join of an executed plan made."""
    kind, children = plan.nodeName(), plan.children()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlan" else [plan.plan()] if kind.endswith("QueryStage") else [children.apply(i) for i in range(children.size())]
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in kind else []
    return sum(map(joined_rows, below), own)


def test_manual_review_counts_values_instead_of_pairing_them(spark):
    fields = [("f", "2024. 1. 2.", True), ("f", " 2024.01.02", True), ("f", "zz", False), ("g", None, True), ("h", "a b", True), ("h", "c", True), ("i", "x", False), ("j", "1", True), ("j", "1", None), (None, "q", True)]
    given = [(1, "2024.1.2"), (2, "zz"), (3, "ab"), (4, "q"), (5, "x"), (6, "1"), (8, None), (9, "ab"), (9, "a b"), (10, "q"), (11, "k")]
    wanted = [(1, "f"), (2, "f"), (3, "h"), (4, "g"), (5, "i"), (6, "j"), (7, "f"), (8, "f"), (9, "h"), (10, None), (11, "none"), (6, "i"), (1, "f"), (None, "f")]
    frames = [(wanted, "item int, field string"), (given, "item int, value string"), (fields, "field string, value string, found boolean")]
    got = {r["item"]: r["status"] for r in linking.manual_review(*[spark.createDataFrame(*x) for x in frames]).collect()}
    assert got == {1: "clean", 2: "flagged", 3: "flagged", 4: "clean", 5: "unreviewed", 6: "clean", 7: "manual", 8: "manual", 9: "flagged", 10: "unreviewed", 11: "unreviewed", None: "manual"}

    n = spark.range(300)
    out = linking.manual_review(n.selectExpr("id AS item", "'f' AS field"), n.selectExpr("id AS item", "'v' || id % 2 AS value"), n.selectExpr("'f' AS field", "'v1' AS value", "true AS found"))
    assert sorted((r["item"] % 2, r["status"]) for r in out.collect()) == [(0, "flagged")] * 150 + [(1, "clean")] * 150
    assert max(joined_rows(out._jdf.queryExecution().executedPlan())) == 300


def broadcast_rows(plan):
    """Rows of each broadcast of an executed plan."""
    kind, children = plan.nodeName(), plan.children()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlan" else [plan.plan()] if kind.endswith("QueryStage") else [children.apply(i) for i in range(children.size())]
    own = [plan.metrics().apply("numOutputRows").value()] if kind == "BroadcastExchange" else []
    return sum(map(broadcast_rows, below), own)


def test_labelled_fields_broadcast_the_specs_only(spark, tmp_path):
    spark.range(4000).write.parquet(str(tmp_path / "docs"))  # a file, so that the cells' size is estimated from it
    grid = spark.read.parquet(str(tmp_path / "docs")).withColumnRenamed("id", "doc_id").withColumn("col_no", F.explode(F.array(F.lit(0), F.lit(1))))
    cells = grid.select("doc_id", F.lit(1).alias("table_no"), F.lit(1).alias("row_no"), "col_no", F.when(F.col("col_no") == 0, "La bel").otherwise(F.col("doc_id").cast("string")).alias("cell"))
    specs = spark.createDataFrame([("a", "Label", "right"), ("b", "Label", "below")], "field string, label string, at string")
    out = extraction.labelled_fields(cells, specs)
    got = {(r["doc_id"], r["field"]): (r["value"], r["found"], r["matched_label"]) for r in out.collect()}
    assert got == {(i, f): (str(i), True, "Label") if f == "a" else (None, False, None) for i in range(4000) for f in "ab"}
    assert max(broadcast_rows(out._jdf.queryExecution().executedPlan())) <= 2
