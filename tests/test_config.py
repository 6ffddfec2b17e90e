import pytest

from riskloom.sources import config as C


def test_simple_yaml():
    got = C.parse_simple_yaml("version: '1'\n# c\nsettings:\n  severity_threshold: \"HIGH\"\n  strict: true\nignore_paths:\n- tests/*\n- docs/*\nrules:\n")
    assert got == {"version": "1", "settings": {"severity_threshold": "HIGH", "strict": True}, "ignore_paths": ["tests/*", "docs/*"], "rules": {}}


@pytest.mark.parametrize(
    "text, want",
    [
        ("", {}),
        ("a: 1\nb:TRUE\n  c: 'x'\n", {"a": "1", "b": True, "c": "x"}),
        ("s:\n  a: \"false\"\n  - b: c\n  plain\n# s2:\n", {"s": {"a": False, "- b": "c"}}),
        ("s:\n - one\n -two\n- 'three'\n  k: v\n - four:5\n", {"s": ["one", "three", "four:5"]}),
        ("s :\nt: 3\n  u: 4\n- v\n- w: x", {"s": {}, "t": "3", "u": "4", "- w": "x"}),
        ("s:\n a: 1\n", {"s": {}, "a": "1"}),
        ("\ts:\n  a: b: c\n", {"s": {"a": "b: c"}}),
        ("url: http://x/:\n", {"url: http://x/": {}}),
    ],
)
def test_simple_yaml_lines(text, want):
    assert C.parse_simple_yaml(text) == want


def test_validation(capsys):
    for bad in ({"settings": {"severity_threshold": "x"}}, {"ignore_paths": {}}, {"rules": []}, {"settings": []}):
        with pytest.raises(ValueError):
            C.validate_config(bad)
    C.validate_config({"other": 1})
    assert "other" in capsys.readouterr().err


def test_load(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert C.load_config() == {}
    with pytest.raises(FileNotFoundError):
        C.load_config("none.yml")
    (tmp_path / ".risk-scan.yml").write_text("settings:\n  severity_threshold: none\n")
    assert C.load_config() == {}
    with pytest.raises(ValueError):
        C.load_config(".risk-scan.yml")


def test_threshold():
    config = {"settings": {"severity_threshold": "LOW"}}
    assert [C.threshold("CRITICAL", True, config), C.threshold(None, True, config), C.threshold(None, False, config), C.threshold(None, False, {})] == ["CRITICAL", "HIGH", "LOW", None]
