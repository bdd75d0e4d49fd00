"""Renderers as column functions, and a registry users can add to."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.core import edits
from quire.core.blocks import parse
from quire.core.nodes import Document
from quire.meta.frontmatter import FrontMatter, FrontMatterError, body_offset
from quire.render import ansi, html, markdown, outline, tree, typst

RENDERERS: dict[str, Callable[[Document], str]] = {"html": html.render, "ast": tree.render, "ai": outline.render, "terminal": ansi.render, "markdown": markdown.render, "typst": typst.render}


def register_renderer(name: str, render: Callable[[Document], str]) -> None:
    """Makes a function of a document available to ``render`` under a name."""
    RENDERERS[name] = render


def render(body: Column, to: str | Callable[[Document], str] = "html", gfm: bool = True, **options) -> Column:
    """A document body as text in the format named, or by any function of a document. Null stays null."""
    make = RENDERERS[to] if isinstance(to, str) else to

    @F.pandas_udf("string")
    def rendered(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else make(parse(t, gfm, skip_frontmatter=False), **options) for t in texts], dtype=object)

    return rendered(body)


def typst_document(body: Column, fm_json: Column, mermaid: Callable[[str], str] | None = None) -> Column:
    """A whole Typst document whose settings come from the frontmatter."""

    @F.pandas_udf("string")
    def rendered(texts: pd.Series, trees: pd.Series) -> pd.Series:
        out = []
        for t, j in zip(texts, trees):
            options = typst.Options() if j is None else typst.Options.from_frontmatter(json.loads(j))
            out.append(None if t is None else typst.render(parse(t, skip_frontmatter=False), options, mermaid))
        return pd.Series(out, dtype=object)

    return rendered(body, fm_json)


def normalize(source: Column, set_blocks: list[tuple[str, str]] = (), sections: list[tuple[str, str, str]] = ()) -> Column:
    """Sources in normal form: frontmatter serialized again, then the edited and normalised body.

    ``set_blocks`` holds (selector, Markdown), ``sections`` (start marker, end marker, Markdown). Edits
    that do not apply to a document leave it as it is. Unreadable frontmatter is kept verbatim.
    """
    set_blocks, sections = list(set_blocks), list(sections)

    def one(t: str) -> str:
        start = body_offset(t) or 0
        doc = parse(t[start:], skip_frontmatter=False)
        for edit, args in [*((edits.set_block, a) for a in set_blocks), *((edits.replace_section, a) for a in sections)]:
            try:
                edit(doc, *args)
            except edits.EditError:
                pass
        body = markdown.render(doc)
        if not start:
            return body
        try:
            return FrontMatter.from_markdown(t).to_markdown(body)
        except FrontMatterError:
            return t[:start] + body

    @F.pandas_udf("string")
    def normalized(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else one(t) for t in texts], dtype=object)

    return normalized(source)


def frontmatter_dump(fm_json: Column) -> Column:
    """Frontmatter as JSON with two blanks of indent, ``{}`` where there is none."""

    @F.pandas_udf("string")
    def pretty(trees: pd.Series) -> pd.Series:
        return pd.Series(["{}" if t is None else json.dumps(json.loads(t), ensure_ascii=False, indent=2) for t in trees], dtype=object)

    return pretty(fm_json)
