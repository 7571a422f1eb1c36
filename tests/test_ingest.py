import json
import os

import pytest

from scorelake.plans import readers
from scorelake.session import scratch_folder
from scorelake.sources import ingest, sinks


def test_annotations(spark, tmp_path):
    cat = lambda *names: [{"id": i, "name": n} for i, n in enumerate(names)]
    note = lambda image, q, p, d: {"image_id": image, "category_id_1": q, "category_id_2": p, "category_id_3": d, "bbox": [1.0, 2.0, 3.0, 4.0]}
    data = {"categories_1": cat("1", "2", "3", "4"), "categories_2": cat(*"12345678"), "categories_3": cat("Impacted", "Caries"), "images": [{"id": 1, "file_name": "train_2.png"}, {"id": 2, "file_name": "train_10.png"}],
            "annotations": [note(1, 0, 7, 1), note(1, 0, 7, 1), note(1, 0, 7, 0)]}
    (tmp_path / "a.json").write_text(json.dumps(data))
    made = ingest.annotation_file(spark, str(tmp_path / "a.json"), "train")
    assert made["images"].count() == 2 and made["boxes"].count() == 3
    assert [(r.case_id, r.slot, r.conditions) for r in made["findings"].collect()] == [("train_2", 18, ["Caries", "Impacted"])]


def test_cut_short_objects(spark, tmp_path):
    rows = [{"External ID": "7.jpg", "Label": {"objects": [{"title": "tooth 3 and 14"}, {"title": "33"}]}}, {"External ID": "7.jpg", "Label": {"objects": [{"title": "1-32"}]}}, {"Label": {"objects": []}}]
    (tmp_path / "o.json").write_text(json.dumps(rows)[:-1] + ', {"External ID": "8')
    records = ingest.object_file(spark, str(tmp_path / "o.json"))
    assert records.count() == 3 and records.first().truncated
    got = ingest.missing_from_objects(records).collect()
    assert [(r.case_id, r.missing) for r in got] == [("7", list(range(2, 32)))]


def test_labelme(spark, tmp_path):
    labels = ["1-çürük-15", "0-saglam-11", "1-kanal-99", "bad-15", "1-kanal-15", "1-gomulu-15"]
    (tmp_path / "t1.json").write_text(json.dumps({"shapes": [{"label": x} for x in labels]}))
    got = ingest.labelme_findings(spark, str(tmp_path)).collect()
    assert [(r.case_id, r.slot, r.conditions) for r in got] == [("t1", 15, ["Caries", "Periapical Lesion", "Impacted"])]


def test_runs_keep_failed_rows(spark, tmp_path):
    ok = {"case_id": "c1", "predicted_findings": {"18": ["Caries"]}, "ground_truth_findings": {"18": ["Caries", "Impacted"]}}
    run = {"strategy": "cot", "run_config": {"dataset": "D"}, "models": {"m": {"results": [ok, {"file_name": "f.png", "error": "x"}]}, "broken": {"error": "y"}}}
    (tmp_path / "r.json").write_text(json.dumps(run))
    rows = ingest.run_results(ingest.run_files(spark, str(tmp_path)))
    assert sorted((r.dataset, r.strategy, r.model, r.image, r.error) for r in rows.collect()) == [("D", "cot", "m", "c1", None), ("D", "cot", "m", "f.png", "x")]
    assert ingest.exploded_findings(rows, ["image"], "ground_truth_findings").count() == 2


def test_unknown_category_is_an_error(spark, tmp_path):
    cat = [{"id": 0, "name": "1"}]
    note = {"image_id": 1, "category_id_1": 0, "category_id_2": 0, "category_id_3": 7, "bbox": [1.0]}
    data = {"categories_1": cat, "categories_2": cat, "categories_3": cat, "images": [{"id": 1, "file_name": "a.png"}], "annotations": [note]}
    (tmp_path / "a.json").write_text(json.dumps(data))
    with pytest.raises(Exception, match="unknown category_id_3 7"):
        ingest.annotation_file(spark, str(tmp_path / "a.json"), "train")["findings"].collect()


@pytest.mark.parametrize(("text", "found", "cut"), [
    ('[{"a": "x,]}"}, {"b": [1, {"c": 2}]}]', 2, False), ('[{"a": 1}, {"b": "x]', 1, True), ('[{"a": 1}, {"b": 2}', 2, True), ('[{"a": 1}, oops, {"b": 2}]', 1, True),
    ('{"k": {"a": 1}, "l": {"b": 2}}', 2, False), ("[]", 0, False), ("[", 0, True), ("", 0, True), ('[{"a": "\\"[{,"}, {"a', 1, True), ("7", 0, False),
])
def test_records_of_whole_and_broken_files(spark, tmp_path, text, found, cut):
    (tmp_path / "a.json").write_text(text)
    rows = ingest.salvaged_array(spark, str(tmp_path / "a.json")).collect()
    assert len(rows) == found and all(r.truncated == cut for r in rows)


def test_object_root(spark, tmp_path):
    rows = {"x": {"External ID": "1.jpg", "Label": {"objects": [{"title": "5"}]}}, "y": {"External ID": "2.jpg", "Label": {"objects": []}}}
    (tmp_path / "o.json").write_text(json.dumps(rows))
    records = ingest.object_file(spark, str(tmp_path / "o.json"))
    assert {r.case_id: len(r.missing) for r in ingest.missing_from_objects(records).collect()} == {"1": 31, "2": 32}
    assert ingest.object_support(records).first().asDict() == {"n_cases": 2, "n_slots": 64, "missing": 63, "present": 1}


def test_labels_with_blanks_and_images_without_shapes(spark, tmp_path):
    (tmp_path / "t1.json").write_text(json.dumps({"shapes": [{"label": "1- çürük -15"}, {"label": "1-kanal-+16"}]}))
    (tmp_path / "t2.json").write_text(json.dumps({"shapes": []}))
    images = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "case_id string")
    got = {r.case_id: r.findings for r in ingest.labelme_cases(images, ingest.labelme_findings(spark, str(tmp_path))).collect()}
    assert got == {"t1": {15: ["Caries"]}, "t2": {}, "t3": {}}


def test_images(spark, tmp_path):
    whole = b"\xff\xd8\xff\xe0" + b"x" * 20 + b"\xff\xd9"
    png = bytes.fromhex("89504e470d0a1a0a") + b"x" * 20 + bytes.fromhex("49454e44ae426082")
    for name, data in {"a.jpg": whole, "a.JPG": png, "b.png": png, "c.png": png[:-4], "d.jpg": b"", "e.txt": whole}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.case_id: (r.path.rsplit("/", 1)[1], r.readable) for r in ingest.image_files(spark, str(tmp_path)).collect()}
    assert got == {"a": ("a.JPG", True), "b": ("b.png", True), "c": ("c.png", False)}  # Spark leaves empty files out
    cases = spark.createDataFrame([("a",), ("c",), ("z",)], "case_id string")
    assert [r.case_id for r in ingest.usable(cases, ingest.image_files(spark, str(tmp_path))).collect()] == ["a"]


def test_splits_and_leaks(spark):
    made = lambda *ids: spark.createDataFrame([(i,) for i in ids], "case_id string")
    parts, held = {"train": made("a", "b"), "val": made("c", "b"), "test": made("a")}, made("a")
    names = lambda n: sorted(r.case_id for r in ingest.split(parts, n, held).collect())
    assert names("train") == ["b"] and names("val") == ["b", "c"] and names("test") == ["a"] and names("qed") == ["b", "b", "c"] and names("all") == ["b", "b", "c"]
    assert ingest.assert_no_leak(made("b"), held).count() == 1
    with pytest.raises(Exception, match="held-out case a"):
        ingest.assert_no_leak(parts["train"], held).collect()


def test_held_out_and_references(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"case_ids": ["a", "b"], "exemplars": [{"case_id": "a", "role": "none", "gt": {}}]}))
    assert {(r.case_id, r.role) for r in ingest.held_out_cases(spark, str(tmp_path / "h.json")).collect()} == {("a", "none"), ("b", None)}
    refs = spark.createDataFrame([("a", "text")], "case_id string, expert_report string")
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    assert {r.case_id: r.reference for r in ingest.with_reference(cases, refs).collect()} == {"a": "text", "b": ""}
    assert ingest.with_reference(cases, refs, None).count() == 1


def test_sinks(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    text = lambda n: "\n".join(r.value for r in spark.read.text(at(n)).collect())
    rows = spark.createDataFrame([("m", 0.123456, None), ("n", None, 2)], "model string, kl_bits_mean double, n int")
    sinks.score_csv(rows, at("scores"), ["model", "kl_bits_mean"])
    assert text("scores") == "model,kl_bits_mean\nm,0.123\nn,N/A"
    sinks.summary_csv(rows.limit(0), at("empty"), ["model", "n"])
    assert text("empty") == "model,n"
    sinks.rater_sheet(spark.createDataFrame([("b", "s"), ("a", "s")], "case_id string, stratum string"), at("raters"), ["score"])
    assert text("raters").split("\n")[1].startswith("a,s")
    sinks.inventory_json(rows.limit(1), at("inventory"))
    assert json.loads(text("inventory"))["model"] == "m"
    sinks.provenance_json(rows.select("model"), at("provenance"), {"rule": "exact"})
    assert json.loads(text("provenance")) == {"rule": "exact", "runs": [{"model": "m"}, {"model": "n"}]}
    sinks.audit_text(rows, at("audit"), "concat('--- ', model)")
    assert sorted(text("audit").split("\n")) == ["--- m", "--- n"]


def test_packed_labelme(spark, tmp_path):
    """Documents that are a line each give what the same documents give as files."""
    labels = {"t1": ["1-çürük-15", "1-kanal-15", "bad-15"], "t2": [], "a.b": ["1-gomulu-11"]}
    (tmp_path / "one").mkdir()
    (tmp_path / "packed").mkdir()
    lines = []
    for name, own in labels.items():
        shapes = [{"label": x} for x in own]
        (tmp_path / "one" / f"{name}.json").write_text(json.dumps({"shapes": shapes}))
        lines.append(json.dumps({"imagePath": f"images/{name}.png", "shapes": shapes}))
    (tmp_path / "packed" / "part.txt").write_text("\n".join(lines) + "\n")
    got = []
    for folder, packed in (("one", False), ("packed", True)):
        path = str(tmp_path / folder)
        got.append({r.case_id: r.findings for r in ingest.labelme_cases(ingest.labelme_files(spark, path, packed), ingest.labelme_findings(spark, path, packed)).collect()})
    assert got[0] == got[1] == {"t1": {15: ["Caries", "Periapical Lesion"]}, "t2": {}, "a.b": {11: ["Impacted"]}}


def test_shape_labels_take_no_file_a_case(spark, monkeypatch):
    """The query writes as many files as its table has tasks, not one for each supplier."""
    folder, made = "/root/testdata/sf0.001", []
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    monkeypatch.setattr(readers, "scratch_folder", lambda *a: made.append(scratch_folder(*a)) or made[-1])
    rows = readers.read_shape_labels(spark, folder).count()
    files = [f for f in os.listdir(made[0].removeprefix("file:")) if f.startswith("part-")]
    assert rows == spark.read.parquet(f"{folder}/supplier.parquet").count() > len(files)
