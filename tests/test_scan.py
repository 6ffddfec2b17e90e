"""Rules, paths, diffs, trees, dedup and evaluation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from riskloom import corpus
from riskloom.operators import match, paths, pyast
from riskloom.operators.dedup import dedup_findings
from riskloom.operators.diff import added_array, added_line_count, file_parts, positions
from riskloom.operators.rules import RULES, by_family, java_pattern
from riskloom.plans import evaluate, report, scan
from riskloom.sources.tree import read_tree


def lines_of(spark, texts, file="a.txt"):
    return spark.createDataFrame([(file, i + 1, t) for i, t in enumerate(texts)], "file string, line_num int, line string")


def ids(df):
    return sorted((r["line_num"], RULES[r["rule_no"]].rule_id) for r in df.collect())


def test_every_template_meets_its_rules(spark):
    texts = [t.replace("{i}", "1234").replace("{h}", "0" * 32).replace("{t}", "click") for _, t in corpus.TEMPLATES]
    want = sorted((i + 1, r) for i, (rules, _) in enumerate(corpus.TEMPLATES) for r in rules)
    assert ids(match.match_lines(lines_of(spark, texts))) == want


def test_literal_array_equals_a_join_on_patterns(spark):
    texts = [t.replace("{i}", "77").replace("{h}", "ab" * 16).replace("{t}", "v") for _, t in corpus.TEMPLATES]
    rules = spark.createDataFrame([(r.rule_id, java_pattern(r)) for r in by_family("secret")], "rule_id string, java_pattern string")
    joined = match.match_by_join(lines_of(spark, texts), rules)
    secrets = [r.rule_id for r in by_family("secret")]
    assert sorted((r["line_num"], r["rule_id"]) for r in joined.collect()) == [x for x in ids(match.match_lines(lines_of(spark, texts))) if x[1] in secrets]


def test_unicode_and_word_edges(spark):
    got = ids(match.match_lines(lines_of(spark, ["x.eval(1)", "éeval(1)", "PASSWORD = 'abcd'", "password = 'abc'", "mysprintf(x)", "filesystem(x)"])))
    assert got == [(3, "SEC-PASS-001"), (6, "PHP-CMD-001")]


def test_matching_is_one_stage_with_the_code_made_once(spark):
    plan = match.match_lines(lines_of(spark, ["x"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?s)^((?:[^'") <= 2 and "Join" not in plan


def test_paths(spark):
    names = ["a/b.min.js", "vendor/x.py", "src/vendor/x.py", "yarn.lock", "logo.PNG", "b/dist/x", "src/a.py", ".github/x.yml", "x/y.EXE"]
    df = spark.createDataFrame([(n,) for n in names], "p string").select("p", paths.is_ignored(F.col("p")).alias("i"), paths.is_pruned(F.col("p")).alias("d"), paths.is_artifact(F.col("p")).alias("a"))
    got = {r["p"]: (r["i"], r["d"], r["a"]) for r in df.collect()}
    assert [got[n][0] for n in names] == [True, True, True, True, True, True, False, False, False]
    assert got[".github/x.yml"][1] and not got["src/a.py"][1] and got["x/y.EXE"][2]
    assert paths.glob_pattern("tests/*.py") == r"tests/.*\.py"


def automaton(text):
    path, number, out = "", 0, []
    for raw in text.splitlines():
        if raw.startswith("diff --git "):
            if len(raw.split()) >= 4:
                path, number = raw.split()[3], 0
        elif raw.startswith("+++ "):
            path, number = raw[4:].strip(), 0
        elif raw.startswith("@@ "):
            if m := re.search(r"\+(\d+)", raw):
                number = int(m[1]) - 1
        elif raw.startswith("+") and not raw.startswith("+++"):
            number += 1
            out.append((path.lstrip("b/"), number, raw[1:]))
    return out


def test_diff_positions_equal_an_automaton(spark):
    rng = random.Random(3)
    parts = ["diff --git a/x b/bin/x.py", "diff --git a/x", "+++ b/y.go", "@@ -1,2 +7,3 @@", "@@ none @@", "@@ -0,0 +0,0 @@", "+a", "+", "++ b", " c", "-d", "+++", "--- a/x"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "diff_id int, content string")
    got = {}
    for r in positions(df).where("is_added").orderBy("diff_id", "i").collect():
        got.setdefault(r["diff_id"], []).append((r["file"], r["line_num"], r["raw"][1:]))
    assert [got.get(i, []) for i in range(len(texts))] == [automaton(t) for t in texts]
    counts = {r["diff_id"]: r["lines_scanned"] for r in added_line_count(df, "content", "diff_id").collect()}
    assert all(counts.get(i, 0) == sum(x.startswith("+") and not x.startswith("+++") for x in t.splitlines()) for i, t in enumerate(texts))


@pytest.mark.parametrize("context", [False, True])
def test_added_lines_equal_those_of_the_windows(spark, context):
    rng = random.Random(6)
    parts = ["diff --git a/x b/bin/x.py", "diff --git  a/x \tb/y z", "diff --git a/x", "+++ b/y.go", "+++ ", "@@ -1,2 +7,3 @@", "@@ none @@", "@@ + +5 @@ +6", "@@ -0,0 +0,0 @@", "+a", "+", "++ b", " c", "-d", "+++", "--- a/x", "", "+x +++ b/q"]
    texts = [rng.choice(["\n", "\r\n", "\r", "\x0c", "\u2028"]).join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "diff_id int, content string")
    want = sorted((r["diff_id"], r["path"], r["file"], r["line_num"], r["raw"][1:]) for r in positions(df, count_context=context).where("is_added").collect())
    got = file_parts(df).select("diff_id", "path", "file", F.inline(added_array(F.col("part"), context))).drop("added")
    assert sorted(tuple(r) for r in got.collect()) == want
    if not context:
        mine = {}
        for i, _, f, n, t in sorted(want):
            mine.setdefault(i, []).append((f, n, t))
        assert all(sorted(automaton(t)) == sorted(mine.get(i, [])) for i, t in enumerate(texts))


def test_a_scan_reads_once_and_shuffles_findings_only(spark, tmp_path):
    spark.createDataFrame([("a.py", "x = eval(y)"), ("b.exe", ""), ("c.js", "password = 'abcdef'")], "file string, content string").write.parquet(str(tmp_path / "in"))
    plan = scan.scan_files(spark.read.parquet(str(tmp_path / "in")))[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert plan.count("(?s)^((?:[^'") <= 2
    spark.createDataFrame([(1, "+++ b/x\n+eval(y)")], "diff_id int, content string").write.parquet(str(tmp_path / "d"))
    plan = scan.scan_diffs(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_diff_findings(spark):
    text = "diff --git a/t.exe b/t.exe\nnew file mode\n--- /dev/null\n+++ b/t.exe\n+x = eval(y)\ndiff --git a/vendor/v.py b/vendor/v.py\n+++ b/vendor/v.py\n+eval(y)\n"
    got = scan.scan_diffs(spark.createDataFrame([(1, text), (2, "+password = 'secret1'"), (3, "")], "diff_id int, content string"))
    assert sorted((r["diff_id"], r["file"], r["line"], r["rule_id"]) for r in got.collect()) == [(1, "t.exe", 0, "MAL-BIN-ARTIFACT-001"), (1, "t.exe", 1, "PY-DYN-001"), (2, "", 1, "SEC-PASS-001")]


SOURCE = '''import subprocess, pickle, ast
ast.literal_eval(eval("1"))
x = eval(y)
self.run(cmd, shell=True)
subprocess.anything(cmd, shell=1)
pickle.load(f)
builtins.exec(
    z)
'''


def test_syntax_tree(spark):
    got = [(x["line"], x["rule_id"], x["severity"], x["column"]) for x in pyast.analyze(SOURCE)]
    assert got == [(2, "PY-DYN-001", "MEDIUM", 17), (3, "PY-DYN-001", "HIGH", 4), (4, "PY-CMD-001", "HIGH", 0), (6, "PY-DESERIAL-001", "HIGH", 0), (7, "PY-DYN-001", "HIGH", 0)]
    assert pyast.analyze("def (") == [] and pyast.analyze("1" + "+1" * 60_000) == []


def test_tree_scan(spark, tmp_path):
    made = {"a.py": SOURCE, ".env": "password = 'hunter22'\n", "__init__.py": "eval(x)", "broken.py": "def (\nx = eval(y)\n", "node_modules/x.py": "eval(x)", "t.DLL": "MZ", "bad.txt": b"pass\xffword = 'abcdef'\r\nok", "d/e.js": "// eval(x)\nel.dangerouslySetInnerHTML = 1;"}
    for name, text in made.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    found, lines = scan.scan_tree(spark, str(tmp_path))
    got = sorted((r["file"], r["line"], r["rule_id"], r["analyzer"]) for r in found.collect())
    assert got == sorted([(".env", 1, "SEC-PASS-001", "regex"), ("__init__.py", 1, "PY-DYN-001", "python-ast"), ("broken.py", 2, "PY-DYN-001", "regex"), ("t.DLL", 0, "MAL-BIN-ARTIFACT-001", "filesystem"), ("bad.txt", 1, "SEC-PASS-001", "regex"), ("d/e.js", 2, "JS-XSS-001", "regex")] + [("a.py", n, r, "python-ast") for n, r in ((2, "PY-DYN-001"), (3, "PY-DYN-001"), (4, "PY-CMD-001"), (6, "PY-DESERIAL-001"), (7, "PY-DYN-001"))])
    assert lines.first()[0] == 8 + 1 + 1 + 2 + 2 + 2
    assert read_tree(spark, str(tmp_path / "none")).count() == 0
    one, _ = scan.scan_tree(spark, str(tmp_path / "node_modules" / "x.py"))
    assert [(r["file"], r["rule_id"]) for r in one.collect()] == [("x.py", "PY-DYN-001")]
    files = report.write_reports(found, str(tmp_path / "out"), 16)
    assert set(files) == {"badge.svg", "summary.md", "report.html", "results.sarif", "findings.json"}
    import json

    doc = json.load(open(files["results.sarif"]))
    assert len(doc["runs"][0]["tool"]["driver"]["rules"]) == 26 and len(doc["runs"][0]["results"]) == len(got)
    assert "hunter22" in open(files["findings.json"]).read()  # shorter than what is masked


def test_tree_source(spark, tmp_path):
    """However few folders planning lists, and with a comma in a glob."""
    for name in ("a.py", "x/b.py", "x/y/c.py", "x/y/z/d.py", "x/node_modules/e.py", "k,l/f.py", "k/g.py", "l/h.py", ".hidden/_i.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    names = ["a.py", "x/b.py", "x/y/c.py", "x/y/z/d.py", "k,l/f.py", "k/g.py", "l/h.py", ".hidden/_i.py"]
    for folders in (1, 2, 4, 64):
        for batch in (1, 500):
            got = read_tree(spark, str(tmp_path), batch=batch, folders=folders)
            assert sorted(r["file"] for r in got.collect()) == sorted(names)
    got = read_tree(spark, str(tmp_path), ignore=["k,l/*"])
    assert sorted(r["file"] for r in got.collect()) == sorted(set(names) - {"k,l/f.py"})


def test_reports_of_many_findings(spark, tmp_path):
    import json

    rows = lines_of(spark, [f"password = 'secret{i}'" for i in range(300)] + ["gets(b)"])
    found = match.findings(match.match_lines(rows))
    made = report.write_reports(found, str(tmp_path / "out"), 301, shown=10)
    assert len(json.load(open(made["findings.json"]))) == 301 == len(json.loads(report.to_json_array(report.finding_rows(found)))) and open(made["report.html"]).read().count("<tr class=") == 10
    text = open(made["summary.md"]).read()
    assert "Findings: `301`" in text and "291 more findings" in text and text.count("SEC-PASS-001") == 10
    whole = json.load(open(made["results.sarif"]))
    assert len(whole["runs"][0]["results"]) == 301 and whole == json.loads(report.sarif(report.sarif_results(found.orderBy("seq"))))
    parts = [json.loads(r["document"]) for r in report.sarif_documents(found, 40).collect()]
    lines = [x["locations"][0]["physicalLocation"]["region"]["startLine"] for p in parts for x in p["runs"][0]["results"]]
    assert sorted(lines) == list(range(1, 302)) and all(0 < len(p["runs"][0]["results"]) <= 40 for p in parts)
    report.write_tables(found, str(tmp_path / "tables"))
    assert spark.read.json(str(tmp_path / "tables" / "findings")).count() == 301
    documents = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "tables" / "sarif"), lineSep="\n\n").collect() if r["value"].strip()]
    assert sum(len(d["runs"][0]["results"]) for d in documents) == 301
    none = report.write_reports(found.limit(0), str(tmp_path / "clean"), even_if_clean=True)
    assert json.load(open(none["findings.json"])) == [] and "No vulnerabilities" in open(none["summary.md"]).read()
    body = report.comment_body("table", True)
    assert "ISSUES FOUND" in body and "table" in body and "PASSED" in report.comment_body("", False)


def fold(rows):
    kept = {}
    for r in rows:
        key = r[:3]
        old = kept.get(key)
        if old is None or (r[4] == "python-ast" and old[4] != "python-ast") or (r[3] > old[3] and not (old[4] == "python-ast" and r[4] != "python-ast")):
            kept[key] = r
    return set(kept.values())


def test_dedup_equals_a_fold(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(4), rng.choice(["R1", "R2"]), rng.choice([0.8, 0.95, 0.99]), rng.choice(["regex", "python-ast"]), [i]) for i in range(200)]
    df = spark.createDataFrame(rows, "file string, line int, rule_id string, confidence double, analyzer string, seq array<int>")
    got = {(r["file"], r["line"], r["rule_id"], r["confidence"], r["analyzer"]) for r in dedup_findings(df).collect()}
    assert got == {r[:5] for r in fold([tuple(x[:5]) for x in rows])}


def test_gate_and_counts(spark):
    rows = lambda *s: spark.createDataFrame([(x,) for x in s], "severity string")
    assert [report.gate(rows("HIGH"), x).first()[0] for x in ("CRITICAL", "HIGH", "low", "?", None, "")] == [False, True, True, True, False, False]
    assert not report.gate(rows(), "LOW").first()[0]
    assert tuple(report.counts(rows("HIGH", "CRITICAL", "LOW")).first()) == (3, 1, 1)
    assert [r["value"] for r in report.ci_outputs(rows()).collect()] == ["0", "false", "", ""]


def test_partial_rows_get_defaults(spark):
    r = report.from_rows(spark.createDataFrame([("f.py:6:4", "85%"), ("x", "bad%")], "file string, confidence string")).collect()
    assert (r[0]["file"], r[0]["line"], r[0]["rule_id"], r[0]["severity"], r[0]["confidence"]) == ("f.py:6", 4, "GEN-001", "LOW", 0.85)
    assert (r[1]["file"], r[1]["line"], r[1]["confidence"]) == ("x", 0, 0.95)


def test_evaluation(spark):
    kind = "file string, rule_id string"
    by = evaluate.per_file(spark.createDataFrame([("a", "R1"), ("a", "R1"), ("a", "R2")], kind), spark.createDataFrame([("a", "R1"), ("b", "R3")], kind))
    s = evaluate.summary(by).first()
    assert (s["tp"], s["fp"], s["fn"], s["precision"], s["recall"], s["f1"], s["passed"]) == (1, 1, 1, 0.5, 0.5, 0.5, False)
    none = evaluate.summary(evaluate.per_file(spark.createDataFrame([], kind), spark.createDataFrame([], kind))).first()
    assert none["precision"] == none["recall"] == none["f1"] == 1.0 and none["passed"]


def test_manifest_and_event(spark, tmp_path):
    from riskloom.sources.tree import read_event, read_manifest

    (tmp_path / "m.json").write_text('{"fixtures": [{"file": "a", "expected_rule_ids": ["R"], "expected_count": 1}]}')
    assert read_manifest(spark, str(tmp_path / "m.json")).first()["expected_rule_ids"] == ["R"]
    (tmp_path / "e.json").write_text('{"repository": {"full_name": "o/r"},\n "pull_request": {"number": 7}}')
    assert read_event(spark, str(tmp_path / "e.json")) == ("o/r", 7)


@pytest.mark.parametrize("most", [50, 260, 400, 10_000])
def test_chunks_equal_a_fold(spark, most):
    from riskloom.operators import chunk

    rng = random.Random(most)
    names = ["a.py", "b.txt", "c.md"]
    texts = ["".join(f"diff --git a/{(n := rng.choice(names))} b/{n}\n+" + "x" * rng.randrange(400) + "\n" for _ in range(rng.randrange(8))) for _ in range(60)]

    def pick(t):
        if len(t) <= most:
            return t
        parts = [s for s in (p.strip() for p in re.split(r"(?=diff --git )", t)) if s]
        parts.sort(key=lambda s: not any(e in s.split("\n")[0] for e in chunk.CODE))
        out, size = [], 0
        for s in parts:
            if size + len(s) <= most:
                out.append(s)
                size += len(s)
            else:
                if most - size > 200:
                    out.append(s[: most - size] + chunk.CUT)
                break
        return "\n\n".join(out) if out else t[:most]

    df = spark.createDataFrame(list(enumerate(texts)), "diff_id int, content string")
    got = {r["diff_id"]: r["chunk"] for r in chunk.select_chunks(df, most).collect()}
    assert [got[i] for i in range(len(texts))] == [pick(t) for t in texts]


def test_stream(spark, tmp_path):
    from riskloom.streaming.lines import stream_findings

    spark.createDataFrame([("a.py", "x = 1\npassword = 'abcdef'")], "file string, content string").write.json(str(tmp_path / "in"))
    s = stream_findings(spark.readStream.schema("file string, content string").json(str(tmp_path / "in")))
    q = s.select("file", "line", "rule_id").writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("found").collect()] == [("a.py", 2, "SEC-PASS-001")]
