"""The command line, in this process."""

import json
import subprocess

from riskloom import cli


def run(spark, *args):
    return cli.main(list(args), spark)


def test_path_reports_and_gate(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.py").write_text("x = eval(y)\n")
    (tmp_path / "t" / "b.py").write_text("x = eval('1')\n")
    assert run(spark, "--path", "t", "--sarif", "o/r.sarif", "--json", "f.json", "--html", "h.html", "--comment", "c.md", "--badge") == 0
    assert "PY-DYN-001" in capsys.readouterr().out
    assert {x["severity"] for x in json.load(open("f.json"))} == {"HIGH", "MEDIUM"}
    assert len(json.load(open("o/r.sarif"))["runs"][0]["results"]) == 2 and "issues found" in open("security-badge.svg").read()
    assert "ISSUES FOUND" in open("c.md").read() and "PY-DYN-001" in open("h.html").read()
    assert [run(spark, "--path", "t", *x) for x in (["--strict"], ["--fail-on", "critical"], ["--fail-on", "LOW"])] == [1, 0, 1]
    assert run(spark, "--path", "t/b.py", "--strict") == 0
    (tmp_path / ".risk-scan.yml").write_text("settings:\n  severity_threshold: medium\nignore_paths:\n  - a.*\n")
    assert run(spark, "--path", "t") == 1 and "HIGH" not in capsys.readouterr().out.split("| `PY-DYN-001` |")[-1]
    assert run(spark, "--path", "t", "--config", "none.yml") == 1


def test_clean_tree_writes_only_pages(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.py").write_text("x = 1\n")
    assert run(spark, "--path", "a.py", "--sarif", "r.sarif", "--json", "f.json", "--html", "h.html", "--strict") == 0
    assert "Clean: 1 lines" in capsys.readouterr().out
    assert not (tmp_path / "r.sarif").exists() and not (tmp_path / "f.json").exists() and (tmp_path / "h.html").exists()
    assert run(spark, "--path", "a.py", "--quiet") == 0 and capsys.readouterr().out == ""
    assert run(spark, "--path", "missing") == 0


def test_diffs_and_events(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "d.patch").write_text("diff --git a/x.py b/x.py\n+++ b/x.py\n@@ -1 +4 @@\n+password = 'secret1'\n")
    (tmp_path / "e.json").write_text('{"repository": {"full_name": "o/r"}, "pull_request": {"number": 7}}')
    monkeypatch.setenv("GITHUB_OUTPUT", str(tmp_path / "out.txt"))
    assert run(spark, "--diff", str(tmp_path / "d.patch"), "--event", "e.json", "--json", "f.json", "--strict") == 1
    assert "pull request 7 of o/r" in capsys.readouterr().out
    assert json.load(open("f.json"))[0]["file"] == "x.py:4" and "findings-count=1" in open("out.txt").read()
    assert run(spark) == 0 and "Nothing to scan" in capsys.readouterr().out


def test_working_copy(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    git = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n")
    git("add", ".")
    assert run(spark, "--staged", "--strict") == 0
    git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x = 1\npassword = 'secret1'\n")
    assert run(spark, "--local", "--strict") == 1 and run(spark, "--staged", "--strict") == 0
    git("add", ".")
    assert run(spark, "--staged", "--strict") == 1


def test_benchmark_and_hook(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.py").write_text("x = eval(y)\n")
    (tmp_path / "f" / "b.c").write_text("gets(b);\n")
    fixtures = [{"file": "a.py", "expected_rule_ids": ["PY-DYN-001"], "expected_count": 1}, {"file": "b.c", "expected_rule_ids": [], "expected_count": 0}, {"file": "none", "expected_rule_ids": ["R"], "expected_count": 1}]
    (tmp_path / "m.json").write_text(json.dumps({"fixtures": fixtures}, indent=1))
    assert run(spark, "benchmark", "m.json", "--path", "f") == 1 and "tp=1 fp=1 fn=0" in capsys.readouterr().out
    assert run(spark, "--install-hook") == 0 and "--staged" in open(".pre-commit-config.yaml").read()
    (tmp_path / ".pre-commit-config.yaml").write_text("mine")
    assert run(spark, "--install-hook") == 0 and open(".pre-commit-config.yaml").read() == "mine"
