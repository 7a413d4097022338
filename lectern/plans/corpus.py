"""A Markdown corpus with known defects, made by one SQL text that Spark and
DuckDB read alike: a clean document per customer, with one defect appended or
applied by c_custkey modulo. The findings to expect are listed beside it."""

from __future__ import annotations

CLEAN = """\
The balance is checked each month by the billing team.

The owner gets a short note when a limit is near.

Nothing else has to be done."""
HEAD = "# Account {name}\n\nThis account is active and needs no action.\n\n## Details\n\n" + CLEAN
WORDS = "the team reads the list of open items and then marks each one as done"

HEAD_ZH = "# 账户 {name}\n\n此账户有效，无需操作。\n\n## 详情\n\n每月由结算组核对一次余额。\n\n接近限额时会通知负责人。\n\n其余事项无需处理。"
LONG = "the team reads the list of open items and then marks each one as done before it writes the short note that ends the day"
PLAIN = "# Account {name}\n\n"

#: (what follows the clean document, its findings as rule -> hits). A text that
#: begins with a title is a document of its own; one that begins with zh: follows
#: the clean Chinese document.
DEFECTS: list[tuple[str, dict[str, int]]] = [
    ("\n", {}),
    ("\n\n#### Deep\n\nOne more note.\n\nAnd a second note.\n\nAnd a third note.\n\nAnd a last note.\n", {"S1": 1, "X2": 1}),
    ("\n\n# Again\n\nOne more note.\n\nAnd a second note.\n\nAnd a third note.\n\nAnd a last note.\n", {"S2": 1, "X2": 1}),
    ("\n\nplain short line" + "\nplain short line" * 6 + "\n", {"P4": 1}),
    ("\n\nOne is here. Two is here. Three is here. Four is here.\n", {"P1": 1}),
    ("\n\n- first\n  - second\n    - third\n", {"L1": 1}),
    ("\n\n" + "\n".join(f"- item {i}" for i in range(8)) + "\n", {"L6": 1}),
    ("\n\n- first\n  goes on\n  and on\n- second\n", {"L5": 1}),
    ("\n\n```\nls\n```\n", {"T1": 1}),
    ("\n\n```sh\n$ ls\n$ pwd\n```\n", {"A4": 2}),
    ("\n\n<div>note</div>\n", {"T8": 1}),
    ("\n\n1. first\n3. second\n", {"T7": 1}),
    ("\n\n| a | b | c | d | e | f |\n|---|---|---|---|---|---|\n| 1 | 2 | 3 | 4 | 5 | 6 |\n", {"N5": 1}),
    ("\n\nA line with a blank at its end \n", {"T4": 1}),
    ("", {"T4": 1}),
    ("\n\nThe reason is told, see above and see below.\n", {"W4": 2}),
    ("\n\nIt is basically done.\n", {"W6": 1}),
    ("\n\nIn essence it works.\n", {"M8": 1}),
    ("\n\nWe leverage the list.\n", {"M9": 1}),
    ("\n\nThe parts **a** and **b** and **c** are set.\n", {"T2p": 1}),
    ("\n\nThe launch is set 🚀 for now.\n", {"X1p": 1, "X1c": 1}),
    ("\n\nParts – one – two – three – four – five.\n", {"M5": 2}),
    ("\n\nIt says that " + WORDS + " and that " + WORDS + ".\n", {"W1x": 1}),
    ("\n" + "\nNote this.\n" * 38, {"N1": 1}),
    ("\n" + ("\n" + ". ".join([WORDS.capitalize()] * 3) + ".\n") * 5, {"S3": 1}),
    ("\n\n## Install steps\n\nOne more note.\n\n- unpack\n- build\n- run\n\nAnd a last note.\n", {"L3": 1, "X2": 1}),
    ("\n\nIt is not just a list, it is a plan.\n", {"M1": 1}),
    ("\n\n> quoted text\ngoes on here\n", {}),
    ("\n\n~~~~md\n```\n# no heading\n~~~\n~~~~\n", {}),
    ("\n\n- first\n\n  goes on\n\nplain text after\n", {}),
    ("zh:\n\n使用Spark处理。\n", {"C1": 1}),
    ("zh:\n\n先看这里,再看那里。\n", {"C2": 1}),
    ("zh:\n\n先把全部记录读入内存，再按日期排好顺序，然后逐条核对金额，接着写入新的账本，最后把结果发给每一位负责人查看。\n", {"C3": 1}),
    ("zh:\n\n我的账户的余额的变化会通知到人。\n", {"C5": 1}),
    ("zh:\n\n这是第一行\n这是第二行。\n", {"C8": 1}),
    ("zh:\n\n更快的构建，更快的部署，更快的反馈。\n", {"M2": 1}),
    ("zh:\n\n时间会抹平一切。\n", {"M3": 1}),
    ("zh:\n\n团队进行了一次调整。\n", {"M4": 1}),
    ("zh:\n\n核心是：缓存。\n", {"M6": 1}),
    ("zh:\n\n说白了就是缓存。\n", {"M7": 1}),
    ("zh:\n\n这是一把钥匙。\n", {"M10": 1}),
    ("zh:\n\n它会写入大量记录。\n", {"M11": 1}),
    ("zh:\n\n第一步完成。此外有备份。同时有日志。\n", {"M12": 1}),
    ("zh:\n\n体验显著提升。\n", {"M13": 1}),
    ("zh:\n\n体验显著提升 30%。\n", {}),
    ("zh:\n\n随着流量增加，从而需要扩容。\n", {"M14": 1}),
    (PLAIN + "## Details\n\n" + CLEAN + "\n\nOne more note.\n", {"H1": 1}),
    (PLAIN + "In recent years it grew.\n\n## Details\n\n" + CLEAN + "\n", {"H1": 1}),
    (PLAIN + "Summary of it\n\n" + "\n".join(f"- item {i}" for i in range(6)) + "\n\n## Details\n\n" + CLEAN + "\n", {"H2": 1}),
    (PLAIN + (LONG.capitalize() + ".\n\n") * 2 + "## Details\n\n" + (LONG.capitalize() + ".\n\n") * 3 + "- end\n", {"W1m": 3}),
    ("\n\nThe **note on the limits** is kept.\n", {"T2d": 1}),
    ("\n\nThe **note on the limits of it all** is kept.\n", {"T2d": 1, "X5": 1}),
    (PLAIN + "- [One](#one)\n- [Two](#two)\n\nIt is active.\n\n## One\n\n" + CLEAN + "\n" + "\nNote this.\n" * 38, {}),
]


#: Totals in hundredths, in the order of DEFECTS: what the rules' deductions leave.
TOTALS = [
    10000, 9070, 9070, 9820, 9856, 9870, 10000, 9948, 9896, 9856, 9935, 9935, 9896, 9935, 9935, 9792, 9974, 9935, 9896, 9961,
    8700, 9922, 9896, 9740, 9820, 9044, 9870, 10000, 10000, 10000, 9987, 9974, 9896, 9961, 9961, 10000, 9935, 9948, 9961, 9896,
    10000, 9961, 9922, 9896, 10000, 9935, 8920, 8920, 9730, 9415, 9740, 9140, 10000,
]
#: Kinds of blocks that follow the six of the clean document, a paragraph unless
#: stated; for a document of its own, all of them.
KINDS = {
    1: "heading,para,para,para,para", 2: "heading,para,para,para,para", 5: "list", 6: "list", 7: "list", 8: "code", 9: "code", 10: "html", 11: "list", 12: "table", 14: "",
    23: ",".join(["para"] * 38), 24: ",".join(["para"] * 5), 25: "heading,para,list,para", 0: "", 27: "quote", 28: "code", 29: "list,para",
    46: "heading,heading,para,para,para,para", 47: "heading,para,heading,para,para,para", 48: "heading,para,list,heading,para,para,para",
    49: "heading,para,para,heading,para,para,para,list", 52: "heading,list,para,heading," + ",".join(["para"] * 41),
}


def kinds(i: int) -> list[str]:
    own = KINDS.get(i, "para").split(",") if KINDS.get(i, "para") else []
    return own if DEFECTS[i][0].startswith("# ") else ["heading", "para", "heading", "para", "para", "para", *own]


def document(text: str) -> str:
    """The whole document of a defect, with {name} in it."""
    if text.startswith("# "):
        return text
    return HEAD_ZH + text[3:] if text.startswith("zh:") else HEAD + text


def literal(text: str) -> str:
    return " || chr(10) || ".join(f"'{part}'" if part else "''" for part in text.split("\n"))


def case(values: list[str], key: str = "c_custkey") -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def texts(bodies: list[str]) -> str:
    """A SQL expression: the document of each customer."""
    return case([literal(document(t)).replace("{name}", "' || c_name || '") for t in bodies])


def md_corpus() -> str:
    """SELECT doc_id, raw, level over customer. C5 is asked for at level 3 only."""
    levels = case(["3" if "C5" in found else "2" for _, found in DEFECTS])
    return f"SELECT c_custkey AS doc_id, {texts([t for t, _ in DEFECTS])} AS raw, {levels} AS level FROM customer"


#: texts for the two link rules, and their findings
LINKS = [
    ("See [here](https://x.org/a) now.", {"N2": 1}),
    ("![](a.png)", {"N6": 1}),
    ("Go to https://x.org/a now.", {"N2": 1}),
    ("See [the guide](https://x.org/a).", {}),
    ("`[here](x)` is code.", {}),
]


def md_links() -> str:
    """SELECT doc_id, raw over customer."""
    bodies = [literal(HEAD + f"\n\n{t}\n").replace("{name}", "' || c_name || '") for t, _ in LINKS]
    return f"SELECT c_custkey AS doc_id, {case(bodies)} AS raw FROM customer"


def expected_findings(links: bool = False) -> str:
    """SELECT doc_id, rule, hits over customer."""
    cases = LINKS if links else DEFECTS
    rows = [f"({i}, '{rule}', {n})" for i, (_, found) in enumerate(cases) for rule, n in found.items()]
    return f"SELECT c_custkey AS doc_id, rule, CAST(hits AS BIGINT) AS hits FROM customer JOIN (VALUES {', '.join(rows)}) AS v(k, rule, hits) ON c_custkey % {len(cases)} = k"


#: (new text made of the old parts, the findings when the format was to change,
#: and when the content was)
CHANGES = [
    ("f || a || b || c || d || e", "", ""),
    ("f || a || c || b || d || e", "blocks_reordered", ""),
    ("f || a || c || d || e", "prose_tokens_missing", "nums_missing"),
    ("f || a || b || 'One extra word. ' || chr(10) || chr(10) || c || d || e", "prose_tokens_added", ""),
    ("f || a || b || c || e", "code_block_missing", "code_block_missing"),
    ("f || a || replace(b, 'first part', 'first  part') || c || d || e", "", ""),
    ("a || b || c || d || e", "", ""),
    ("f || a || '- [T](#t)' || chr(10) || '- [U](#u)' || chr(10) || chr(10) || b || c || d || e", "", ""),
    ("f || a || b || c || d || replace(e, 'max_size', 'the limit')", "prose_tokens_missing,prose_tokens_added", "idents_missing"),
    ("f || a || b || c || d || replace(e, '42 GB', '43 GB')", "prose_tokens_missing,prose_tokens_added", "nums_missing"),
    ("f || a || b || c || d || replace(e, '42 GB', '42GB')", "prose_tokens_missing,prose_tokens_added", ""),
    ("f || a || b || c || d || replace(e, 'https://x.org/p', 'the page')", "prose_tokens_missing,prose_tokens_added", "urls_missing,idents_missing"),
    ("f || a || b || c || d || replace(e, '`run it`', '`run`')", "prose_tokens_missing", "inline_missing"),
]
HARD = ("code_block_missing", "prose_tokens_missing", "prose_tokens_added", "urls_missing", "idents_missing", "inline_missing")


def md_pairs() -> str:
    """SELECT pair_id, old, new over customer."""
    parts = {
        "f": literal("---\nfront_key: 7 TB\n---\n"),
        "a": literal("# T\n\n"),
        "b": "'The first part of ' || c_name || ' is here.' || chr(10) || chr(10)",
        "c": literal("A second part follows it.\n\n"),
        "d": literal("```sh\nls ") + " || c_custkey || " + literal("\n```\n"),
        "e": literal("\nSet max_size to 42 GB, see https://x.org/p and `run it` now.\n"),
    }
    made = ", ".join(f"{v} AS {k}" for k, v in parts.items())
    return f"SELECT c_custkey AS pair_id, f || a || b || c || d || e AS old, {case([new for new, _, _ in CHANGES])} AS new FROM (SELECT c_custkey, {made} FROM customer) p"


def expected_verdicts(content: bool = False) -> str:
    kinds = [c[2] if content else c[1] for c in CHANGES]
    ok = [str(not set(k.split(",")) & set(HARD)).lower() for k in kinds]
    return f"SELECT c_custkey AS pair_id, {case(ok)} AS ok, {case([f"'{k}'" for k in kinds])} AS kinds FROM customer"


#: defects that formatting mends, and what then follows the clean document
MENDED = {
    11: "\n\n1. first\n2. second\n",
    13: "\n\nA line with a blank at its end\n",
    14: "\n",
    30: "zh:\n\n使用 Spark 处理。\n",
    31: "zh:\n\n先看这里，再看那里。\n",
}


def formatted() -> str:
    return f"SELECT c_custkey AS doc_id, {texts([MENDED.get(i, t) for i, (t, _) in enumerate(DEFECTS)])} AS formatted FROM customer"
