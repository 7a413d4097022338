"""The command line, sources and sinks, and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.__main__ import main
from lectern.operators.audit import audit, findings
from lectern.operators.score import score
from lectern.plans import corpus
from lectern.sources.documents import SKELETONS, bundle, read_text_files, skeletons
from lectern.streaming.audit_stream import score_stream, write_scores

GOOD = corpus.document("\n").format(name="x")
BAD = corpus.document("\n\nThe launch is set 🚀 for now.\n\n1. first\n3. second\n").format(name="x")


@pytest.fixture
def files(tmp_path):
    (tmp_path / "good.md").write_text(GOOD, encoding="utf-8")
    (tmp_path / "bad.md").write_text(BAD, encoding="utf-8")
    return tmp_path


def test_audit_command(spark, files, capsys):
    good, bad = str(files / "good.md"), str(files / "bad.md")
    assert main(["audit", good, "--min-score", "100"], spark) == 0
    assert main(["audit", good, bad, "--min-score", "95"], spark) == 1
    assert "X1p" in capsys.readouterr().out
    assert main(["audit", bad, "--json"], spark) == 0
    made = json.loads(capsys.readouterr().out)
    assert made["path"] == bad and made["lang"] == "en" and made["score"]["x_hits"] == ["X1p", "X1c"] and made["score"]["x_deduct"] == 13
    assert {f["rule"] for f in made["findings"]} == {"X1p", "X1c", "T7"} and all(f["msg"] and f["axis"] == "F" for f in made["findings"])
    assert made["score"]["dims"]["typo"] == {"weight": 13, "score": 95}


def test_fmt_command(spark, files, capsys):
    good, bad = str(files / "good.md"), str(files / "bad.md")
    assert main(["fmt", good, "--check"], spark) == 0
    assert main(["fmt", good, bad, "--check"], spark) == 1
    assert main(["fmt", bad], spark) == 0
    assert "+2. second" in capsys.readouterr().out
    assert main(["fmt", bad, "--write"], spark) == 0
    assert (files / "bad.md").read_text(encoding="utf-8") == BAD.replace("3. second", "2. second")
    assert main(["fmt", bad, "--check"], spark) == 0 and sorted(p.name for p in files.iterdir()) == ["bad.md", "good.md"]


def test_verify_and_report_commands(spark, files, capsys):
    good, bad = str(files / "good.md"), str(files / "bad.md")
    assert main(["verify", bad, good, "--scope", "format", "--json"], spark) == 3
    made = json.loads(capsys.readouterr().out)
    assert not made["ok"] and made["hard_failures"][0]["kind"] == "prose_tokens_missing" and made["warnings"] == []
    assert main(["verify", good, good], spark) == 0
    assert main(["report", bad, good, "--scope", "content"], spark) == 0
    out = capsys.readouterr().out
    assert "-13 -> -0" in out and "| typo | 95 | 100 | +5 |" in out
    assert main(["report", good, bad, "--scope", "content"], spark) == 1


def test_skeletons_audit_clean_in_form(spark, capsys):
    rows = skeletons(spark).select(F.xxhash64("type").alias("doc_id"), F.col("body").alias("raw"))
    assert rows.count() == len(SKELETONS) == 6 and findings(audit(rows)).where("axis = 'F'").count() == 0
    assert main(["init", "--type", "adr"], spark) == 0
    assert capsys.readouterr().out == skeletons(spark, "adr").first()["body"]


def test_text_files(spark, files):
    (files / "crlf.md").write_bytes(b"a\r\nb\rc\n")
    got = {r["path"].rsplit("/", 1)[1]: r["raw"] for r in read_text_files(spark, str(files)).collect()}
    assert got == {"good.md": GOOD, "bad.md": BAD, "crlf.md": "a\nb\nc\n"}


def test_bundle(spark):
    parts = [(1, 2, "Second Part", "# Two\n\n```\n# no title\n```\n"), (1, 1, "First", "---\nx: 1\n---\n# One\n")]
    raw = bundle(spark.createDataFrame(parts, "bundle_id int, part_no int, title string, raw string")).first()["raw"]
    assert raw == "- [First](#first)\n- [Second Part](#second-part)\n\n## First\n\n## One\n\n\n## Second Part\n\n## Two\n\n```\n# no title\n```\n"


def test_a_stream_gives_the_same_scores(spark, tmp_path):
    rows = [(i, corpus.document(t).format(name="x")) for i, (t, _) in enumerate(corpus.DEFECTS[:12])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    docs.write.parquet(str(tmp_path / "in"))
    write_scores(score_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = {r["doc_id"]: r["total_hundredths"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["doc_id"]: r["total_hundredths"] for r in score(audit(docs.withColumnRenamed("text", "raw"))).collect()}
    assert got == dict(enumerate(corpus.TOTALS[:12]))
