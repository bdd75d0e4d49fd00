from quire.cli import convert, main

SOURCE = "---\ntitle: T\nn: 1\n---\n# h\n\n<!-- a -->\n\nx\n\n<!-- b -->\n"


def test_convert(tmp_path, capsys):
    assert convert(SOURCE, "html").startswith("<h1>h</h1>\n")
    assert convert(SOURCE, "frontmatter", sets=["m.k=true", "n.x=1"], deletes=["title"]) == '{\n  "n": 1,\n  "m": {\n    "k": true\n  }\n}\n'
    assert convert("# x", "frontmatter") == "{}\n"
    assert convert(SOURCE, "markdown", sets=["n=2"]).startswith("---\ntitle: T\nn: 2\n---\n\n# h\n")
    assert convert(SOURCE, "normalize", blocks=[("heading[0]", "## g"), ("list[0]", "x")], sections=[(" a ", " b ", "y")]) == "---\ntitle: T\nn: 1\n---\n\n## g\n\n<!-- a -->\n\ny\n\n<!-- b -->\n"
    assert 'title: "T"' in convert(SOURCE, "typst")
    file, out = tmp_path / "a.md", tmp_path / "o"
    file.write_bytes(b"# a\xff\n")
    assert main(["convert", str(file), "--to", "ast", "-o", str(out)]) == 0
    assert "Heading" in out.read_text()
    main(["convert", str(file)])
    assert capsys.readouterr().out == "<h1>a�</h1>\n"
