"""String functions of the renderers as native column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.render.html import FILTERED

# File name extensions of images.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff", "tif", "svg", "ico")


def html_escape(s: Column) -> Column:
    out = s
    for raw, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(to))
    return out


def filter_tags(s: Column) -> Column:
    """The opening angle of disallowed tags as text."""
    return F.regexp_replace(s, rf"(?i)<(?=/?(?:{'|'.join(FILTERED)})(?:[\s/>]|$))", "&lt;")


def markdown_escape(s: Column) -> Column:
    """What Markdown text would read as marks, behind backslashes."""
    return F.regexp_replace(s, r"([\\*_`\[\]<>!#|~&])", r"\\$1")


def typst_escape(s: Column) -> Column:
    """What Typst markup would read as marks, behind backslashes."""
    return F.regexp_replace(s, r"([\\*_`#$@<\[\]~])", r"\\$1")


def outline_quote(s: Column) -> Column:
    """A text in double quotes, as the outline writes it."""
    out = s
    for raw, to in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(to))
    return F.concat(F.lit('"'), out, F.lit('"'))


def strip_ansi(s: Column) -> Column:
    """Text without escape sequences: CSI ones and OSC ones with either terminator."""
    return F.regexp_replace(s, "\x1b(?:\\[[0-9;?]*[A-Za-z]|\\][^\x07\x1b]*(?:\x07|\x1b\\\\)|_[^\x1b]*\x1b\\\\)", "")


def is_image(path: Column) -> Column:
    return F.coalesce((F.instr(path, ".") > 0) & F.lower(F.substring_index(path, ".", -1)).isin(*IMAGE_EXTENSIONS), F.lit(False))


def line_count(s: Column) -> Column:
    """Lines as the parser splits them: a line feed ends one, a last empty one is none."""
    return F.when(s == "", 0).otherwise(F.size(F.split(s, "\n")) - F.when(s.endswith("\n"), 1).otherwise(0))


def _each(f):
    """A text function as a column function; null stays null."""

    @F.pandas_udf("string")
    def mapped(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(v) for v in values], dtype=object)

    return mapped


def decode_entities(s: Column) -> Column:
    """Character references as their characters: the full HTML5 set of names, decimal, hexadecimal."""
    from quire.render.html import decode_entities as decode

    return _each(decode)(s)


def link_url(s: Column) -> Column:
    """A raw link destination as it is used: unescaped, decoded, percent-encoded."""
    from quire.render.html import link_url as url

    return _each(url)(s)


def title_attribute(s: Column) -> Column:
    """A raw link title as the value of an HTML attribute: references and backslashes resolved, escaped."""
    from quire.render.html import escape, unescape

    return _each(lambda v: escape(unescape(v)))(s)


def normalize_label(s: Column) -> Column:
    """A link label as references compare it: white space collapsed, case folded."""
    from quire.core.inlines import normalize_label as label

    return _each(label)(s)


def infer(s: Column) -> Column:
    """The JSON text of a command-line value: true, false, null, a number or a string."""
    import json

    from quire.meta.values import infer as value

    return _each(lambda v: json.dumps(value(v), ensure_ascii=False))(s)


def yaml_needs_quote(s: Column) -> Column:
    """Whether a text must be quoted to stay a string in YAML, as true or false text."""
    from quire.meta.emit import yaml_needs_quote as needs

    return _each(lambda v: "true" if needs(v) else "false")(s) == "true"


def char_class(s: Column) -> Column:
    """The class of the first character: whitespace, digit, letter, punctuation, other or empty."""
    c = F.substring(s, 1, 1)
    out = F.when(c == "", "empty")
    for name, pattern in (("whitespace", r"^[ \t\n\r]$"), ("digit", "^[0-9]$"), ("letter", "^[A-Za-z]$"), ("punctuation", r"^[!-/:-@\[-`{-~]$")):
        out = out.when(c.rlike(pattern), name)
    return out.otherwise("other")
