"""Command line: convert, query and edit one document, or query a folder.

    python -m quire convert FILE --to html|ast|ai|terminal|markdown|typst|normalize|frontmatter
    python -m quire query FOLDER "extra.reviewer=kim @table"

``-`` or no file reads standard input. One document needs no Spark session; a folder starts one.
"""

from __future__ import annotations

import argparse
import json
import sys

from quire.core import edits
from quire.core.blocks import parse
from quire.meta import values
from quire.meta.frontmatter import FrontMatter, FrontMatterError, body_offset
from quire.render import ansi, html, markdown, outline, tree, typst

RENDER = {"html": html.render, "ast": tree.render, "ai": outline.render, "terminal": ansi.render}


def convert(text: str, to: str, sets=(), deletes=(), blocks=(), sections=()) -> str:
    """A document in another form, after its edits; edits that do not apply are reported and skipped."""
    start = body_offset(text) or 0
    try:
        fm = FrontMatter.from_markdown(text) if start else None
    except FrontMatterError as e:
        print(f"warning: {e}", file=sys.stderr)
        fm = None
    if fm:
        for arg in sets:
            try:
                fm.set(*values.field_arg(arg))
            except values.FieldError as e:
                print(f"warning: {arg}: {e}", file=sys.stderr)
        for path in deletes:
            fm.delete(path)
    body = text[start:]
    if to == "frontmatter":
        return (fm.to_json() if fm else "{}") + "\n"
    if to == "markdown":  # the body is passed on as it is, unparsed
        return fm.to_markdown(body) if fm else text
    doc = parse(body, skip_frontmatter=False)
    for selector, source in blocks:
        _try(edits.set_block, doc, selector, source)
    for begin, end, source in sections:
        _try(edits.replace_section, doc, begin, end, source)
    if to == "normalize":
        return fm.to_markdown(markdown.render(doc)) if fm else markdown.render(doc)
    if to == "typst":
        return typst.render(doc, typst.Options.from_frontmatter(fm.root if fm else {}))
    return RENDER[to](doc)


def _try(edit, *args) -> None:
    try:
        edit(*args)
    except edits.EditError as e:
        print(f"warning: {e}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quire")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("convert")
    c.add_argument("file", nargs="?", default="-")
    c.add_argument("--to", default="html", choices=[*RENDER, "markdown", "normalize", "typst", "frontmatter"])
    c.add_argument("-o", "--output")
    c.add_argument("--set", action="append", default=[], metavar="PATH=VALUE")
    c.add_argument("--delete", action="append", default=[], metavar="PATH")
    c.add_argument("--set-block", action="append", default=[], metavar="KIND[N]=MARKDOWN")
    c.add_argument("--replace-section", action="append", nargs=3, default=[], metavar=("START", "END", "MARKDOWN"))
    q = commands.add_parser("query")
    q.add_argument("folder")
    q.add_argument("selector")
    q.add_argument("--sort", metavar="PATH")
    q.add_argument("--descending", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "convert":
        if args.file == "-":
            text = sys.stdin.buffer.read().decode("utf-8", "replace")
        else:
            with open(args.file, "rb") as f:
                text = f.read().decode("utf-8", "replace")
        out = convert(text, args.to, args.set, args.delete, [tuple(x.split("=", 1)) for x in args.set_block if "=" in x], args.replace_section)
        if args.output:
            with open(args.output, "w", encoding="utf-8", newline="") as f:
                f.write(out)
        else:
            sys.stdout.write(out)
        return 0
    from pyspark.sql import SparkSession

    from quire.operators.library import Library

    spark = SparkSession.builder.appName("quire").getOrCreate()
    lib = Library.empty(spark).add_dir(args.folder)
    rows = lib.query(args.selector)
    if args.sort:
        rows = lib.sort_by(rows, args.sort, not args.descending)
    for row in rows.toLocalIterator():
        print(json.dumps({k: v for k, v in row.asDict().items() if v is not None}, ensure_ascii=False))
    return 0
