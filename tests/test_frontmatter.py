"""Frontmatter: typing per format, paths, edits, serialization, damaged input."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.meta import emit, values, yaml, zon
from quire.meta.frontmatter import KINDS, FrontMatter, FrontMatterError, body_offset, brace_end, locate


def test_yaml_typing():
    root = yaml.loads('a: 1\nb: -7\nc: 1.5\nd: "42"\ne: true\nf: null\ng:\nh: 2021-01-02\ni: 1e3\nj: \'x\'\'y\'\nk: "a\\n\\u00e9"\n')
    assert root == {"a": 1, "b": -7, "c": 1.5, "d": "42", "e": "true", "f": "null", "g": None, "h": "2021-01-02", "i": 1000.0, "j": "x'y", "k": "a\né"}


def test_yaml_structures():
    text = 'm:\n  n:\n    - a\n    - b: 1\n      c: [1, "x", {y: z}]\n    -\n      - q\nl:\n- 1\n- 2\nt: |\n  one\n   two\n\nf: >-\n  a\n  b\n\n  c\n# c\n"k v": x # note\np: a b\n  c d\nempty: []\nobj: {}\n'
    assert yaml.loads(text) == {"m": {"n": ["a", {"b": 1, "c": [1, "x", {"y": "z"}]}, ["q"]]}, "l": [1, 2], "t": "one\n two\n", "f": "a b\nc", "k v": "x", "p": "a b c d", "empty": [], "obj": {}}


@pytest.mark.parametrize("text", ["", "# c\n", "a: [1, 2", 'a: "x', "a: b: c", "\ta: 1", "a: &x 1", "a: 1\n   b: 2", "plain\nb: 1", 'a: "\\q"'])
def test_yaml_errors(text):
    with pytest.raises(yaml.YamlError):
        yaml.loads(text)


def test_zon():
    root = zon.loads('.{ .a = "x\\n\\x41\\u{e9}", .b = .{ 1, -2, 0xFF, 0o17, 0b11 }, .c = .lit, .d = null, .e = true, .f = 1.5e1, // c\n .g = .{}, .@"k v" = \\\\one\n\\\\two\n, }')
    assert root == {"a": "x\nAé", "b": [1, -2, 255, 15, 3], "c": "lit", "d": None, "e": True, "f": 15.0, "g": {}, "k v": "one\ntwo\n"}
    for bad in (".{ .a = ", ".{ .a 1 }", '.{ "x', "@", ".{ .a = 1, 2 }"):
        with pytest.raises(ValueError):
            zon.loads(bad)


def test_locate():
    assert locate("---\na: 1\n---\nbody") == ("yaml", "\na: 1\n", 13)
    assert locate('+++\na = "x"\n+++\nb')[0] == "toml"
    assert locate('{"a": "}"}\nb') == ("json", '{"a": "}"}', 11)
    assert locate('.{ .a = "}" } b')[0] == "zon"
    assert locate("--") is None and locate("# x") is None and locate("---\nno end") is None and locate('{"a": 1') is None
    assert locate("- item\n---\n") is None and locate("- item\n---\n", sniff="loose")[0] == "yaml"
    assert locate("---\ntitle: a---b\n---\n")[1] == "\ntitle: a"  # the first closer counts, even inside a line
    assert body_offset("x") is None and brace_end("{a") is None


def test_paths_and_edits():
    fm = FrontMatter('{"a": {"b": [1, 2], "n": null}, "c.d": 1}', "json")
    assert fm.get("a.b") == [1, 2] and fm.get("a..b") == [1, 2] and fm.get("a.b.0") is None and fm.get("c.d") is None and fm.get("") is None
    assert fm.has("a.n") and not fm.has("a.x") and fm.get(".") == fm.root
    fm.set("x.y.z", 1)
    fm.set_raw("x.t", "true")
    assert fm.get("x") == {"y": {"z": 1}, "t": True}
    for path in ("", "a.b.c", "a.n.q"):
        with pytest.raises(values.FieldError):
            fm.set(path, 1)
    assert fm.delete("a.b") and not fm.delete("a.b") and not fm.delete("") and fm.get("a") == {"n": None}
    fm.merge(FrontMatter("+++\n".strip("+\n") + 'x = {y = {q = 2}}\nc = [1]\n', "toml"))
    assert fm.get("x.y") == {"z": 1, "q": 2} and fm.get("c") == [1] and fm.kind == "json"


def test_arguments():
    assert [values.infer(x) for x in ("true", "false", "null", "7", "-1.5", "1e3", "x", "")] == [True, False, None, 7, -1.5, 1000.0, "x", ""]
    assert values.field_arg("a.b=c=d") == ("a.b", "c=d")
    for bad in ("a", "=x"):
        with pytest.raises(values.FieldError):
            values.field_arg(bad)


def test_filter_text():
    assert values.as_text(1.0) == "1" and values.as_text(1e30) == "1" + "0" * 30 and values.as_text(None) == "null" and values.as_text([1]) is None
    assert values.matches([["a", [1.5]]], "1.5") and not values.matches({"a": 1}, "a") and values.matches(True, "true")


TREES = st.recursive(st.one_of(st.none(), st.integers(-(2**40), 2**40), st.text(alphabet="ab :#-\"'\\\n\té1.~", max_size=8)), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(alphabet="abc_1", min_size=1, max_size=4), c, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(alphabet="abc_1", min_size=1, max_size=4), TREES, max_size=4))
def test_what_is_written_reads_back(root):
    assert yaml.loads(emit.to_yaml(root)) == root if root else True
    back = FrontMatter(emit.to_json(root), "json").root
    assert back == root
    import tomllib

    def flat(v):  # TOML has no null
        return "" if v is None else {k: flat(x) for k, x in v.items()} if isinstance(v, dict) else [flat(x) for x in v] if isinstance(v, list) else v

    assert tomllib.loads(emit.to_toml(root)) == flat(root)

    def empties(v):  # an empty ZON literal is an empty object
        return {} if v in ([], {}) else {k: empties(x) for k, x in v.items()} if isinstance(v, dict) else [empties(x) for x in v] if isinstance(v, list) else v

    assert zon.loads(emit.to_zon(root)) == empties(root)


@pytest.mark.parametrize("kind", KINDS)
def test_round_trip_with_body(kind):
    fm = FrontMatter.of({"title": "x: y", "n": 7, "l": ["007", "1"], "o": {"p": 1.5}}, kind)
    text = fm.to_markdown("# body")
    again = FrontMatter.from_markdown(text)
    assert again.root == fm.root and again.kind == kind and text.endswith("\n\n# body") and fm.to_markdown("") == fm.serialize() and fm.to_markdown("\nx").endswith("\nx")


@pytest.mark.parametrize("source, kind", [("a: [", "yaml"), ("a = ", "toml"), ("{", "json"), ('{"a": NaN}', "json"), (".{", "zon"), ("", "yaml"), ("x", "nope")])
def test_damaged(source, kind):
    with pytest.raises(FrontMatterError):
        FrontMatter(source, kind)
