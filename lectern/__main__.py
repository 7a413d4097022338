"""Command line: audit, fmt, verify, report and init on files (- is standard
input), with exit codes for gates. Corpora are read by the library instead."""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.constants import DIMENSIONS
from .operators.audit import audit, findings
from .operators.report import report
from .operators.rewrite import fmt
from .operators.score import as_json, gate, markdown, score
from .operators.verify import verify
from .sources.documents import SKELETONS, skeletons


def read(path: str) -> str:
    return sys.stdin.read() if path == "-" else Path(path).read_text(encoding="utf-8")


def replace(path: str, text: str) -> None:
    """The file appears whole or not at all."""
    target = Path(path).resolve()
    handle, made = tempfile.mkstemp(dir=target.parent, prefix=target.name)
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        out.write(text)
    os.chmod(made, target.stat().st_mode)
    os.replace(made, target)


def documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, p, read(p)) for i, p in enumerate(paths)], "doc_id bigint, path string, raw string")


def run_audit(spark: SparkSession, a: argparse.Namespace) -> int:
    audited = audit(documents(spark, a.files), a.level, a.emoji)
    if a.json:
        made = [json.loads(r["json"]) for r in as_json(audited, "path").orderBy("doc_id").collect()]
        print(json.dumps(made if len(made) > 1 else made[0], ensure_ascii=False, indent=2))
    else:
        found = findings(audited)
        found = found if a.scope == "both" else found.where(F.col("axis") == ("F" if a.scope == "format" else "C"))
        for path, r in zip(a.files, markdown(score(audited), found).orderBy("doc_id").collect(), strict=True):
            print(f"<!-- {path} -->\n{r['report']}")
    return int(a.min_score is not None and not gate(score(audited), a.min_score).first()["passes"])


def run_fmt(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = fmt(documents(spark, a.files), a.toc, a.join_cjk, a.strip_emoji, diff=True).where("changed").orderBy("doc_id").collect()
    for r in rows:
        if a.check:
            print(f"to be formatted: {r['path']}")
        elif a.write and r["path"] != "-":
            replace(r["path"], r["formatted"])
            print(f"formatted: {r['path']}")
        else:
            print(r["diff"])
    if not rows:
        print("nothing to format")
    return int(a.check and bool(rows))


def pair(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return spark.createDataFrame([(0, read(a.old), read(a.new))], "pair_id bigint, old string, new string")


def run_verify(spark: SparkSession, a: argparse.Namespace) -> int:
    r = verify(pair(spark, a), a.scope).first()
    issues = [x.asDict() for x in r["issues"]]
    if a.json:
        by = lambda severity: [{k: v for k, v in x.items() if k != "severity"} for x in issues if x["severity"] == severity]
        print(json.dumps({"scope": a.scope, "hard_failures": by("hard"), "warnings": by("warning"), "ok": r["ok"]}, ensure_ascii=False, indent=2))
    else:
        print(f"scope={a.scope}: {'passed' if r['ok'] else 'failed'}")
        for x in issues:
            print(f"  [{x['severity']}] {x['kind']} x{x['count']}: {', '.join(x['items'])}")
    return 0 if r["ok"] else 3


def run_report(spark: SparkSession, a: argparse.Namespace) -> int:
    r = report(pair(spark, a), a.level, a.emoji, a.scope).first()
    print(f"score  {r['old_total_hundredths'] / 100:.2f} -> {r['new_total_hundredths'] / 100:.2f}  ({r['total_hundredths_delta'] / 100:+.2f})\n")
    print("| dimension | before | after | delta |\n|---|---|---|---|")
    for d in DIMENSIONS:
        print(f"| {d} | {r['old_' + d]} | {r['new_' + d]} | {r[d + '_delta']:+d} |")
    print(f"\nglobal deductions  -{r['old_x_deduct']} -> -{r['new_x_deduct']}\nfindings  {r['old_n_findings']} -> {r['new_n_findings']}")
    print(f"verify({a.scope})  {'passed' if r['ok'] else 'failed: ' + ', '.join(x['kind'] for x in r['issues'] if x['severity'] == 'hard')}")
    return int(not r["passes"])


def run_init(spark: SparkSession, a: argparse.Namespace) -> int:
    print(skeletons(spark, a.type).first()["body"], end="")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lectern", description="Readability of Markdown documents")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *files: str, scope: bool = False, level: bool = False, as_json: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for f in files:
            p.add_argument(f, nargs="+" if f == "files" else None)
        if scope:
            p.add_argument("--scope", choices=["format", "content", "both"], default="both")
        if level:
            p.add_argument("--level", type=int, choices=[1, 2, 3], default=2)
            p.add_argument("--emoji", choices=["none", "minimal"], default="none")
        if as_json:
            p.add_argument("--json", action="store_true")
        return p

    command("audit", run_audit, "files", scope=True, level=True, as_json=True).add_argument("--min-score", type=float, help="exit code 1 below this score")
    p = command("fmt", run_fmt, "files")
    for flag, what in {"--write": "write the files", "--check": "exit code 1 if a file would change", "--toc": "add a table of contents", "--join-cjk": "join lines of Chinese paragraphs", "--strip-emoji": "remove emoji"}.items():
        p.add_argument(flag, action="store_true", help=what)
    command("verify", run_verify, "old", "new", scope=True, as_json=True)
    command("report", run_report, "old", "new", scope=True, level=True)
    command("init", run_init).add_argument("--type", required=True, choices=sorted(SKELETONS))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if spark is None:
        spark = SparkSession.builder.master("local[2]").appName("lectern").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    return a.run(spark, a)


if __name__ == "__main__":
    sys.exit(main())
