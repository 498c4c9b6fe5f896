import json
import zipfile

import pytest
from types import SimpleNamespace

from canvass import errors as E
from canvass import cli
from canvass.config import configure_logging, load_config
from canvass.operators.shadow import by_key, divergence
from canvass.operators.summary import build_report_data
from canvass.operators.validate import validate
from canvass.plans.rules import parse_rules
from canvass.plugins import BACKENDS, PARSERS, REPORTS, add_installed, add_plugin, available, plugin
from canvass.run import Hooks, Orchestrator, Stage, artifact_of, completed, new_log, note, read_log, write_log
from canvass.sources import artifacts, legacy, sav, tables
from canvass.streaming.findings import stream_findings, windowed_counts

BOOK = "questions:\n  - {id: AGE, type: numeric, label: Age}\n"


def rows(df):
    return [tuple(r) for r in df.drop("_row_index").collect()]


def test_csv(spark, tmp_path):
    f = tmp_path / "d.csv"
    f.write_bytes('﻿AGE,GENDER,CITY\n15,,"a\nb"\n\n30,F\n1,2,3,4\n'.encode())
    df = tables.load_csv(spark, f)
    assert df.columns == ["AGE", "GENDER", "CITY", "_row_index"]
    assert rows(df) == [("15", "", "a\nb"), ("30", "F", None), ("1", "2", "3")]
    assert [r._row_index for r in df.collect()] == [0, 1, 2]
    f.write_text("A,B\n")
    assert tables.load_file(spark, f).count() == 0
    f.write_text("A,B\n1,2\n")
    assert rows(tables.load_csv(spark, f, mode="fast")) == [("1", "2")]


@pytest.mark.parametrize("content", [b"", b"A,A\n1,2\n", b"N\n\xe9\n", b"\xe9\n1\n"])
def test_bad_csv(spark, tmp_path, content):
    f = tmp_path / "d.csv"
    f.write_bytes(content)
    with pytest.raises(E.DataLoadError):
        tables.load_csv(spark, f)
    with pytest.raises(E.DataLoadError):
        tables.load_csv(spark, tmp_path / "none.csv")


def test_latin1(spark, tmp_path):
    (tmp_path / "d.csv").write_bytes("NAME\né\n".encode("latin-1"))
    assert rows(tables.load_csv(spark, tmp_path / "d.csv", encoding="latin-1")) == [("é",)]


def test_formats(spark, tmp_path):
    assert [tables.sniff_format(f"x{s}") for s in (".CSV", ".xlsx", ".xls", ".json", ".parquet")] == ["csv", "excel", "excel", "json", "parquet"]
    with pytest.raises(E.UnsupportedFormatError):
        tables.sniff_format("x.txt")
    with pytest.raises(E.UnsupportedFormatError):
        tables.load_file(spark, "x.xlsx")
    spark.createDataFrame([(float("nan"),), (1.0,)], "v double").write.parquet(str(tmp_path / "t.parquet"))
    assert sorted(rows(tables.load_file(spark, tmp_path / "t.parquet")), key=str) == [(1.0,), (None,)]


def test_tables_in_memory(spark):
    df = tables.table_from_columns(spark, {"a": [1, None], "q": [frozenset({2, 1}), None]}, 2)
    assert rows(df) == [(1, [1, 2]), (None, None)] and tables.to_records(df)[0] == {"a": 1, "q": [1, 2]}
    assert tables.table_from_columns(spark, {}, 3).count() == 3
    assert rows(tables.column(df, "a")) == [(1,), (None,)]
    for bad in (lambda: tables.table_from_columns(spark, {"a": [1]}, 2), lambda: tables.table_from_columns(spark, {}, -1)):
        with pytest.raises(E.DataLoadError):
            bad()
    with pytest.raises(E.UnknownColumnError):
        tables.column(df, "z")


def test_stored_tables(spark, tmp_path):
    df = tables.table_from_columns(spark, {"a": [1, None], "f": [1.5, 2.0], "q": [frozenset({2, 1}), None], "s": ["x", ""]}, 2)
    artifacts.save_table(df, tmp_path / "t")
    assert sorted(rows(artifacts.load_table(spark, tmp_path / "t")), key=str) == sorted(rows(df), key=str)
    artifacts.export_table_json(df, tmp_path / "t.json")
    assert json.loads((tmp_path / "t.json").read_text())["columns"]["q"] == [{"__frozenset__": [1, 2]}, None]
    assert rows(artifacts.import_table_json(spark, tmp_path / "t.json")) == rows(df)
    (tmp_path / "bad.json").write_text("[]")
    for read in (artifacts.import_table_json, lambda s, p: artifacts.load_table(s, tmp_path / "none")):
        with pytest.raises(E.TransformationError):
            read(spark, tmp_path / "bad.json")


def findings(spark):
    df = spark.createDataFrame([(15, 0), (30, 1), (150, 2)], "AGE long, _row_index long")
    return validate(df, None, parse_rules("rules: [{id: young, type: range, when: AGE < 18, severity: warning, message: '<b>'}, {id: old, type: range, when: AGE > 99}]"))


def test_reports_agree(spark, tmp_path):
    data = build_report_data(findings(spark))
    paths = {n: plugin(REPORTS, n).build(data, tmp_path / n) for n in available(REPORTS)}
    report = json.loads(paths["json"].read_text())
    assert report["summary"] == {"total": 2, "by_severity": {"info": 0, "warning": 1, "error": 1}, "by_rule": [{"rule_id": "old", "severity": "error", "count": 1}, {"rule_id": "young", "severity": "warning", "count": 1}]}
    assert [r["row_index"] for r in report["results"]] == [0, 2]
    assert paths["csv"].read_text().splitlines()[:2] == ["rule_id,severity,message,row_index,variables", "young,warning,<b>,0,"]
    page = paths["html"].read_text()
    assert page.count('class="result-row"') == 2 and "&lt;b&gt;" in page and 'class="severity-error"' in page
    with zipfile.ZipFile(paths["excel"]) as z:
        assert z.testzip() is None and z.read("xl/worksheets/sheet2.xml").count(b"<row>") == 3


def test_findings_as_json(spark, tmp_path):
    artifacts.export_findings_json(findings(spark), tmp_path / "f.json")
    again = artifacts.import_findings_json(spark, tmp_path / "f.json")
    assert [(r.rule_id, r.row_index) for r in again.orderBy("check_ord").collect()] == [("young", 0), ("old", 2)]


def project(tmp_path, text="AGE\n15\n30\n"):
    (tmp_path / "d.csv").write_text(text)
    (tmp_path / "book.yaml").write_text(BOOK)
    (tmp_path / "rules.yaml").write_text("rules: [{id: r, type: range, severity: warning, when: \"AGE == '15'\"}]")
    return tmp_path


def test_run_and_resume(spark, tmp_path):
    p, heard = project(tmp_path), []
    hooks = Hooks([lambda: heard.append("start")], [heard.append], [heard.append])
    work = Orchestrator(spark, p / "d.csv", p / "book.yaml", p / "run", hooks=hooks)
    found = work.run()
    assert [(r.rule_id, r.row_index) for r in found.orderBy("row_index").collect()] == [("__domain__:AGE:type", 0), ("__domain__:AGE:type", 1)]
    assert heard == ["start", 0, 1, True]
    log = read_log(work.manifest_path)
    assert completed(log) == set(Stage) and log == work.log
    stamp = work.cleaned_path.stat().st_mtime_ns
    assert Orchestrator(spark, p / "d.csv", p / "book.yaml", p / "run").run(resume=True).count() == 2
    assert work.cleaned_path.stat().st_mtime_ns == stamp
    (p / "d.csv").write_text("AGE\n1\n2\n3\n")
    with pytest.raises(E.ManifestError, match="changed"):
        Orchestrator(spark, p / "d.csv", p / "book.yaml", p / "run").run(resume=True)
    with pytest.raises(E.ManifestError):
        Orchestrator(spark, p / "d.csv", p / "book.yaml", p / "other").run(resume=True)


def test_log_keeps_every_completion(tmp_path):
    log = new_log("mark")
    log["error"] = "it failed"
    for k in (1, 2):
        note(log, Stage.CLEANING, tmp_path / f"{k}.parquet")
    write_log(log, tmp_path / "log.json")
    back = read_log(tmp_path / "log.json")
    assert back == log and back["error"] is None and len(back["history"]) == 2
    assert artifact_of(back, Stage.CLEANING) == str(tmp_path / "2.parquet") and artifact_of(back, Stage.COMPLETE) is None


def test_failed_run_is_recorded(spark, tmp_path):
    p, ends = project(tmp_path), []
    (p / "book.yaml").write_text("questions: []")
    with pytest.raises(E.MetadataParseError):
        Orchestrator(spark, p / "d.csv", p / "book.yaml", p / "run", hooks=Hooks(on_end=[ends.append])).run()
    assert ends == [False] and "MetadataParseError" in read_log(p / "run/manifest.json")["error"]
    with pytest.raises(E.ManifestError):
        (p / "run/manifest.json").write_text("{}")
        read_log(p / "run/manifest.json")


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["init", str(tmp_path / "new")]) == 0 and (tmp_path / "new/datasets/raw").is_dir()
    p = project(tmp_path)
    base = ["--data", f"{p}/d.csv", "--metadata", f"{p}/book.yaml", "--run-dir", f"{p}/run"]
    assert cli.main(["validate", *base, "--rules", f"{p}/rules.yaml"], spark) == 1
    assert "warning: 1" in capsys.readouterr().out
    assert cli.main(["report", "--run-dir", f"{p}/run", "--format", "csv", "--output", f"{p}/r.csv"], spark) == 0
    assert cli.main(["clean", *base], spark) == 0
    assert cli.main(["export", *base, "--rules", f"{p}/rules.yaml", "--report-output", f"{p}/r.html", "--report-format", "html"], spark) == 0
    assert cli.main(["validate", *base, "--rules", f"{p}/none.yaml"], spark) == 1
    assert cli.main(["report", "--run-dir", f"{p}/nowhere", "--output", f"{p}/r"], spark) == 1
    assert "Error:" in capsys.readouterr().err


def test_plugins():
    assert available(BACKENDS) == ["spark"] and available(PARSERS) == ["sav", "yaml"] and len(available(REPORTS)) == 4
    add_plugin("canvass.none", "a", 1)
    with pytest.raises(E.DuplicatePluginError):
        add_plugin("canvass.none", "a", 2)
    add_plugin("canvass.none", "a", 2, replace=True)
    assert plugin("canvass.none", "a") == 2 and available("canvass.none") == ["a"] and add_installed("canvass.none") == []
    with pytest.raises(E.PluginNotFoundError):
        plugin("canvass.none", "b")


def test_settings(tmp_path):
    f = tmp_path / "s.yaml"
    f.write_text(f"paths: {{projects_root: /p}}\nlogging: {{level: debug, log_file: {tmp_path}/l/x.log}}")
    config = load_config(f)
    assert str(config.paths.projects_root) == "/p" and config.paths.plugins_root is None
    configure_logging(config.logging).info("hello")
    assert "hello" in (tmp_path / "l/x.log").read_text()
    for bad in ("[]", "paths: {}", "a: b: c"):
        f.write_text(bad)
        with pytest.raises(E.InvalidSettingsError):
            load_config(f)


LOG = "J123 List of Errors\nAGE_RANGE\t3\nQ2_GATE\t1\n\nsome remark\nTotal completes : 10\nTotal rejects   : 2\n"


def test_legacy_files(spark, tmp_path):
    log = legacy.parse_legacy_error_log(LOG)
    assert (log.job_number, log.total_completes, log.total_rejects) == ("J123", 10, 2) and [e.count for e in log.entries] == [3, 1]
    assert legacy.parse_legacy_case_notes("12: late: yes |\n\n13: ok")[0] == legacy.LegacyCaseNote("12", "late: yes |")
    for bad in ("", "nothing\n", LOG.replace("3", "x")):
        with pytest.raises(E.MetadataParseError):
            legacy.parse_legacy_error_log(bad)
    with pytest.raises(E.MetadataParseError):
        legacy.parse_legacy_case_notes("no separator")
    (tmp_path / "n.txt").write_text("12: late: yes |\n\n13: ok\n")
    (tmp_path / "e.txt").write_text(LOG)
    assert rows(legacy.read_case_notes(spark, str(tmp_path / "n.txt"))) == [("12", "late: yes |"), ("13", "ok")]
    assert rows(legacy.read_error_log(spark, str(tmp_path / "e.txt"))) == [("AGE_RANGE", 3), ("Q2_GATE", 1)]


def test_shadow_comparison(spark):
    old = legacy.parse_legacy_error_log("J List of Errors\nyoung\t1\ngone\t1\n")
    keys = by_key(old, findings(spark))
    assert [tuple(r) for r in keys.collect()] == [("gone", 1, None), ("old", None, 1), ("young", 1, 1)]
    r = divergence(keys).first()
    assert (r.legacy_only, r.new_only, r.common) == (["gone"], ["old"], ["young"])
    assert r.totals_match and r.unmatched and (r.legacy_total, r.new_total) == (2, 2)


def test_sav_metadata():
    meta = SimpleNamespace(
        column_names=["SEX", "NAME", "AGE", "B1", "B2"], column_names_to_labels={"SEX": "Sex", "B1": "Brand A"}, variable_value_labels={"SEX": {2.0: "M", 1.0: "F"}},
        readstat_variable_types={"NAME": "string", "AGE": "double"}, mr_sets={"$B": {"type": "D", "label": "Brands", "variable_list": ["B1", "B2"]}},
    )
    book = sav.codebook_from_metadata(meta)
    assert [(type(q).__name__, q.id) for q in book] == [("MultiQuestion", "B"), ("SingleQuestion", "SEX"), ("TextQuestion", "NAME"), ("NumericQuestion", "AGE")]
    assert [c.code for c in book.get_question("SEX").categories] == [1, 2] and [c.label for c in book.get_question("B").categories] == ["Brand A", "B2"]
    meta.mr_sets["$B"] = {"type": "C", "is_dichotomy": False, "variable_list": ["B1"]}
    with pytest.raises(E.MetadataParseError, match="dichotomies"):
        sav.codebook_from_metadata(meta)
    for bad in (True, 1.5, "a"):
        with pytest.raises(E.MetadataParseError):
            sav.label_code(bad)
    with pytest.raises(E.MetadataParseError):
        sav.SavMetadataParser().parse("none.sav")


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT id, id * 50 AS v, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts FROM range(4)").write.parquet(src)
    stream = spark.readStream.schema("id long, v long, ts timestamp").parquet(src)
    found = stream_findings(stream, None, parse_rules("rules: [{id: big, type: range, when: v > 60}]"), key="id", keep=["ts"])
    query = windowed_counts(found, "ts").writeStream.format("memory").queryName("found_in_stream").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.rule_id, r.n) for r in spark.table("found_in_stream").collect()] == [("big", 2)]
