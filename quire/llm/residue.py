"""Markup residue in Markdown texts and code blocks: which foreign markup is left, and the text without it.

A scanner, not a learner: a text is cut into protected stretches (fenced code, code spans, autolinks,
site shortcodes, file paths) and prose, and the prose is searched and rewritten construct by
construct. What the text means is kept: headings, lists, tables, code and formulas stay as Markdown.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element names of HTML, current and obsolete ones.
HTML_NAMES = """
a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas
caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption
figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend
li link main map mark marquee menu meta meter nav nobr noframes noscript object ol optgroup option output p param picture
pre progress q rp rt ruby s samp script section select slot small span strike strong style sub summary sup svg table tbody
td template textarea tfoot th thead time title tr track tt u ul var video wbr
""".split()
# Tags that belong to wiki markup.
WIKI_NAMES = "nowiki syntaxhighlight source ref references gallery includeonly noinclude onlyinclude math poem imagemap".split()
# LaTeX commands that mean something without an argument in braces.
TEX_BARE = """
item alpha beta gamma delta epsilon lambda mu pi sigma theta omega phi leq geq neq approx times cdot infty sum int prod
frac sqrt left right ldots dots quad qquad hline newline newpage clearpage noindent maketitle tableofcontents centering
bfseries itshape ttfamily small large Large par LaTeX TeX partial nabla rightarrow leftarrow Rightarrow pm to in forall exists
""".split()

_NAME = "|".join(sorted(HTML_NAMES, key=len, reverse=True))
_ATTR = r"(?:\s+[A-Za-z_:@][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*"
TAG = re.compile(rf"<(?:/(?:{_NAME})\s*|(?:{_NAME}){_ATTR}\s*/?)>", re.I)
OPEN_TAG = re.compile(rf"<({_NAME})({_ATTR})\s*(/?)>", re.I)
COMMENT = re.compile(r"<!--.*?-->|<!--[^\n]*|<!doctype[^>]*>|<!\[CDATA\[", re.I | re.S)
REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
WIKI_TAG = re.compile(rf"</?(?:{'|'.join(WIKI_NAMES)})\b[^>\n]*>", re.I)
SOURCE_TAG = re.compile(r"</?(?:nowiki|syntaxhighlight)\b[^>\n]*>|<source\b(?:[^>\n]*\blang\b[^>\n]*)?>|</source>", re.I)
WIKI_HEADING = re.compile(r"^(={1,6})[ \t]*([^=\s](?:[^\n]*[^=\s])?)[ \t]*\1[ \t]*\r?$", re.M)
WIKI_QUOTES = re.compile(r"(?<![\w'])('{2,3}|'{5})(?=[^\s'])((?:[^\n']|'(?!'))*?[^\s'])\1(?![\w'])")  # inner marks go first
WIKI_LINK = re.compile(r"\[\[([^\[\]\n]+(?:\[\[[^\[\]\n]*\]\][^\[\]\n]*)*)\]\](?!\()")
WIKI_URL = re.compile(r"(?<!\])\[((?:https?|ftp)://[^\s\]]+)[ \t]+([^\]\n]+)\](?![(\[:])")
WIKI_TEMPLATE = re.compile(r"\{\{(?!\{)[ \t]*[#:\w][^{}]*?\}\}")
WIKI_TABLE = re.compile(r"^[ \t:*]*\{\|(?=[^\n]*$)(.*?)(?:^[ \t]*\|\}|\Z)", re.M | re.S)
TEX_COMMAND = re.compile(r"(?<![\w\\])\\[A-Za-z]{2,}\*?(?:\[[^\[\]\n]*\])?\{")
TEX_NAMED = re.compile(rf"(?<![\w\\])\\(?:{'|'.join(TEX_BARE)})(?![A-Za-z\\])")
TEX_MATH = re.compile(r"(?<![\\$\w])\$(?![\s$])([^$\n]*[^\s$\\])\$(?![\w$])|(?<![\\$])\$\$(?!\$)(.+?)\$\$", re.S)
# No \\( or \\[ inside: an opener without its closer ends at the next opener, which keeps this linear.
TEX_PAREN = re.compile(r"\\\(((?:[^\\]|\\(?![()]))+)\\\)|\\\[((?:[^\\]|\\(?![\[\]]))+)\\\]")
_PAREN_MATH, _BRACKET_MATH, _GAP = re.compile(r"\\[A-Za-z]|[\^_=<>+]"), re.compile(r"\\[A-Za-z]|[\^_=]"), re.compile(r"\n[ \t]*\r?\n")
_MATHLIKE = re.compile(r"[\\^_=+<>*/-]|^[A-Za-z]$")

FENCED = re.compile(r"^( {0,3}(?:> ?)*[ \t]*(?:[-*+] +)?)(`{3,}(?=[^`\n]*$)|~{3,})[^\n]*\n(?:.*?^[ \t>]*\2[`~]*[ \t]*\r?$|.*\Z)", re.M | re.S)
CODE_SPAN = re.compile(r"(?<!`)(`+)(?!`)((?:(?!\r?\n[ \t]*\r?\n).)*?)(?<!`)\1(?!`)", re.S)
AUTOLINK = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
SHORTCODE = re.compile(r"\{\{[<%].*?[>%]\}\}|\{%.*?%\}|\{\{-?\s*[\w./-]+\([^{}]*\)\s*-?\}\}|\{\{ [\w.]+ \}\}", re.S)
FILE_PATH = re.compile(r"(?<![\w\\])(?:[A-Za-z]:\\|\\\\\w)[^\s\"'<>|]*")
_PLACE = re.compile("\x00(\\d+)\x00")


def protect(text: str) -> tuple[str, list[str]]:
    """The text with protected stretches as numbered marks, and the stretches."""
    kept: list[str] = []

    def keep(m):
        kept.append(m[0])
        return f"\x00{len(kept) - 1}\x00"

    text = text.replace("\x00", "\ufffd")
    if "```" in text or "~~~" in text:
        text = FENCED.sub(keep, text)
    if "`" in text:
        text = CODE_SPAN.sub(keep, text)
    if "<" in text:
        text = AUTOLINK.sub(keep, text)
    if "{" in text:
        text = SHORTCODE.sub(keep, text)
    if ":\\" in text or "\\\\" in text:
        text = FILE_PATH.sub(keep, text)
    return text, kept


def restore(text: str, kept: list[str]) -> str:
    while "\x00" in text:
        text = _PLACE.sub(lambda m: kept[int(m[1])], text)
    return text


# Elements that need no closing tag.
UNCLOSED = frozenset("area base basefont body br col colgroup dd dt frame head hr html img input li link meta optgroup option p param rp rt source tbody td tfoot th thead tr track wbr".split())
_BARE_TAG = re.compile(r"<([A-Za-z][A-Za-z0-9]*)>")
_CLOSING = re.compile(r"</([A-Za-z][A-Za-z0-9]*)")


def _tag_test(text: str):
    """Whether a match of TAG in this text is a tag: one that is glued to a word, as type parameters
    are (``Vec<i>``), is none if it has no attributes and nothing closes it."""
    closed: set[str] | None = None

    def is_tag(m: re.Match) -> bool:
        nonlocal closed
        at = m.start()
        if not at or not (text[at - 1].isalnum() or text[at - 1] == "_"):
            return True
        bare = _BARE_TAG.fullmatch(m[0])
        if not bare or bare[1].lower() in UNCLOSED:
            return True
        if closed is None:
            closed = {name.lower() for name in _CLOSING.findall(text)}
        return bare[1].lower() in closed

    return is_tag


def _has_tag(text: str) -> bool:
    return any(map(_tag_test(text), TAG.finditer(text)))


def _without_tags(text: str) -> str:
    is_tag = _tag_test(text)
    return TAG.sub(lambda m: "" if is_tag(m) else m[0], text)


def _nested(text: str, opening: str, closing: str, make) -> str:
    """Rewrites pairs of marks from the inside out, however deep, in one pass.

    ``make(inside, next character)`` gives the new text, or None to leave the pair as it is.
    """
    if opening not in text:
        return text
    stack: list[list[str]] = [[]]
    parts = re.split(f"({re.escape(opening)}|{re.escape(closing)})", text)
    for i, part in enumerate(parts):
        if part == opening:
            stack.append([])
        elif part == closing and len(stack) > 1:
            inside = "".join(stack.pop())
            new = make(inside, parts[i + 1][:1])
            stack[-1].append(opening + inside + closing if new is None else new)
        else:
            stack[-1].append(part)
    out = stack[0]
    for unclosed in stack[1:]:
        out.append(opening)
        out.extend(unclosed)
    return "".join(out)


def _has_reference(text: str) -> bool:
    return any(m[0][1] == "#" or m[0][1:] in html.entities.html5 for m in REFERENCE.finditer(text))


def _is_math(m: re.Match) -> bool:
    return m[2] is not None or bool(_MATHLIKE.search(m[1]))


def _is_paren_math(m: re.Match) -> bool:
    """Whether escaped parentheses or brackets hold a formula, and not words that Markdown escapes."""
    body, pattern = (m[1], _PAREN_MATH) if m[1] is not None else (m[2], _BRACKET_MATH)
    return bool(pattern.search(body)) and not _GAP.search(body)


def entry_kinds(text: str) -> list[str]:
    """The foreign markup of a Markdown text outside its code: html, wiki, latex, in this order."""
    text, _ = protect(text)
    out = []
    angle = "<" in text
    if (angle and (_has_tag(text) or COMMENT.search(text))) or ("&" in text and _has_reference(text)):
        out.append("html")
    if (
        ("[[" in text and WIKI_LINK.search(text))
        or ("''" in text and WIKI_QUOTES.search(text))
        or ("{{" in text and WIKI_TEMPLATE.search(text))
        or ("{|" in text and WIKI_TABLE.search(text))
        or (angle and WIKI_TAG.search(text))
        or ("=" in text and WIKI_HEADING.search(text))
        or ("://" in text and WIKI_URL.search(text))
    ):
        out.append("wiki")
    if ("\\" in text and (TEX_COMMAND.search(text) or TEX_NAMED.search(text) or any(map(_is_paren_math, TEX_PAREN.finditer(text))))) or ("$" in text and any(map(_is_math, TEX_MATH.finditer(text)))):
        out.append("latex")
    return out


# Languages by what their own source consists of.
OWN = {
    "html": {"html", "htm", "xhtml", "xml", "svg", "vue", "jsx", "tsx", "php", "erb", "jinja", "jinja2", "handlebars"},
    "latex": {"tex", "latex", "bibtex", "context"},
    "wiki": {"wiki", "mediawiki", "wikitext"},
    "markdown": {"markdown", "md", "mdx", "gfm", "commonmark"},
}
BLOCK_TEX = re.compile(r"(?<![\w\\])\\(?:[A-Za-z]{2,})\*?(?:\[[^\[\]\n]*\])?\{|\{\\(?:tt|bf|it|em|sf|sc)\b|(?<![\w\\])\\verb(?=[|!+])")
BLOCK_TEMPLATE = re.compile(r"\{\{[ \t]*[A-Za-z][\w ]*\|")
BLOCK_WIKI_LINK = re.compile(r"\[\[(?:File|Image|Category|Template|Help):[^\[\]\n]+\]\]", re.I)
BLOCK_BOLD = re.compile(r"(?<!\w)\*\*(?=[^\s*])([^*\n]*[^\s*])?\*\*(?!\w)")
BLOCK_FENCE = re.compile(r"^[ \t]*(?:`{3,}|~{3,})[\w+-]*[ \t]*\r?$", re.M)


def _quoted(content: str) -> bool:
    lines = [x for x in content.splitlines() if x.strip()]
    return bool(lines) and all(x.lstrip(" ")[:1] == ">" for x in lines)


def block_kinds(content: str, language: str | None) -> list[str]:
    """The foreign markup around or inside a code block: html, wiki, latex, markdown, in this order.

    What belongs to the block's own language is none of it.
    """
    own = (language or "").strip().lower()
    out = []
    angle = "<" in content
    wiki_tag = angle and SOURCE_TAG.search(content)
    if own not in OWN["html"]:
        bare = SOURCE_TAG.sub("", content) if wiki_tag else content
        if (angle and (_has_tag(bare) or COMMENT.search(bare))) or ("&" in bare and _has_reference(bare)):
            out.append("html")
    if own not in OWN["wiki"] and (
        wiki_tag
        or ("{{" in content and BLOCK_TEMPLATE.search(content))
        or ("[[" in content and BLOCK_WIKI_LINK.search(content))
        or ("{|" in content and "|}" in content and WIKI_TABLE.search(content))
        or ("==" in content and any(len(m[1]) > 1 for m in WIKI_HEADING.finditer(content)))
    ):
        out.append("wiki")
    if own not in OWN["latex"] and "\\" in content and BLOCK_TEX.search(content):
        out.append("latex")
    if own not in OWN["markdown"] and (("**" in content and BLOCK_BOLD.search(content)) or (("```" in content or "~~~" in content) and BLOCK_FENCE.search(content)) or _quoted(content)):
        out.append("markdown")
    return out


# -- rewriting -------------------------------------------------------------------------------------

_BLANKS = re.compile(r"\n{3,}")


def _reference_text(m: re.Match) -> str:
    text = html.unescape(m[0])
    return " " if text == "\xa0" else text


def _from_html(text: str) -> str:
    text = re.sub(r"<(script|style|template)\b[^>]*>.*?</\1\s*>", "", text, flags=re.I | re.S)
    text = COMMENT.sub("", text)
    text = re.sub(r"<pre\b[^>]*>(?:\s*<code\b[^>]*>)?(.*?)(?:</code>\s*)?</pre\s*>", lambda m: "\n```\n" + html.unescape(TAG.sub("", m[1])).strip("\n") + "\n```\n", text, flags=re.I | re.S)
    text = re.sub(r"<(code|kbd|samp|tt)\b[^>]*>(.*?)</\1\s*>", lambda m: "`" + TAG.sub("", m[2]) + "`", text, flags=re.I | re.S)
    text = re.sub(r"<h([1-6])\b[^>]*>(.*?)</h\1\s*>", lambda m: f"\n\n{'#' * int(m[1])} {TAG.sub('', m[2]).strip()}\n\n", text, flags=re.I | re.S)
    text = re.sub(r"<li\b[^>]*>\s*", "\n- ", text, flags=re.I)
    text = re.sub(r"</t[dh]\s*>\s*<t[dh]\b[^>]*>", " | ", text, flags=re.I)
    text = re.sub(r"<tr\b[^>]*>\s*(?:<t[dh]\b[^>]*>)?", "\n| ", text, flags=re.I)
    text = re.sub(r"(?:</t[dh]\s*>\s*)?</tr\s*>", " |", text, flags=re.I)
    text = re.sub(r"<(?:su[pb])\b[^>]*>(.*?)</su[pb]\s*>", r"\1", text, flags=re.I | re.S)
    text = re.sub(r"<br\b[^>]*>\n?", "\n", text, flags=re.I)
    text = re.sub(r"<hr\b[^>]*>", "\n\n", text, flags=re.I)
    text = re.sub(r"<img\b[^>]*\balt\s*=\s*[\"']([^\"']*)[\"'][^>]*>", r"\1", text, flags=re.I)
    text = re.sub(r"</?(?:p|div|ul|ol|table|tbody|thead|section|article|blockquote|dl|dt|dd|details|summary)\b[^>]*>\n?", "\n\n", text, flags=re.I)
    return REFERENCE.sub(_reference_text, _without_tags(text))


def _wiki_table(m: re.Match) -> str:
    rows, cells = [], []
    for line in m[1].split("\n")[1:]:
        line = line.strip()
        if line.startswith("|-") or line.startswith("|+"):
            if cells:
                rows.append(cells)
            cells = []
        elif line[:1] in ("|", "!"):
            cells += [c.rsplit("|", 1)[-1].strip() for c in re.split(r"\|\||!!", line[1:])]
    if cells:
        rows.append(cells)
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


_TEMPLATE_NAME = re.compile(r"[ \t]*[#:\w]")


def _wiki_template(inside: str, _: str) -> str | None:
    if not _TEMPLATE_NAME.match(inside) or "{" in inside or "}" in inside:
        return None
    parts = [p.strip() for p in inside.split("|")]
    named = [p.split("=", 1) for p in parts[1:] if "=" in p]
    return "; ".join(f"{k.strip()}: {v.strip()}" for k, v in named) if named else " ".join(parts[1:])


def _wiki_link(inside: str, following: str) -> str | None:
    if not inside or "\n" in inside or "[" in inside or "]" in inside or following == "(":
        return None
    target, _, label = inside.partition("|")
    if re.match(r"\s*(?:File|Image|Media):", target, re.I):
        return label.rsplit("|", 1)[-1].strip()
    if re.match(r"\s*Category:", target, re.I):
        return ""
    return (label.rsplit("|", 1)[-1] or target).strip()


def _from_wiki(text: str) -> str:
    text = re.sub(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref\s*>", "", text, flags=re.I | re.S)
    text = re.sub(r"<(syntaxhighlight|source)\b[^>]*>(.*?)</\1\s*>", lambda m: "\n```\n" + m[2].strip("\n") + "\n```\n", text, flags=re.I | re.S)
    text = re.sub(r"<math\b[^>]*>(.*?)</math\s*>", r"$\1$", text, flags=re.I | re.S)
    text = WIKI_TAG.sub("", WIKI_TABLE.sub(_wiki_table, text))
    text = WIKI_HEADING.sub(lambda m: f"{'#' * len(m[1])} {m[2].strip()}", text)
    text = _nested(text, "{{", "}}", _wiki_template)
    return WIKI_QUOTES.sub(r"\2", WIKI_QUOTES.sub(r"\2", WIKI_URL.sub(r"\2", _nested(text, "[[", "]]", _wiki_link))))


_TEX_WORDS = re.compile(r"\\(?:text\w{2,}|emph|underline|uline|mbox|footnote|caption|title|author|date|mathrm)\*?$")
_BRACE_LEAD = re.compile(r"\\[A-Za-z]{2,}\*?$")


def _unwrap(text: str, wanted: re.Pattern) -> str:
    """Commands whose name is wanted give way to what their braces hold, however deep, in one pass."""
    stack: list[list[str]] = [[]]
    for part in re.split(r"([{}])", text):
        if part == "{":
            stack.append([])
        elif part == "}" and len(stack) > 1:
            inside = "".join(stack.pop())
            before = stack[-1][-1] if stack[-1] else ""
            m = wanted.search(before) if before.rfind("\\") >= 0 else None
            if m:
                stack[-1][-1] = before[: m.start()]
                stack[-1].append(inside)
            else:
                stack[-1].append("{" + inside + "}")
        else:
            stack[-1].append(part)
    out = stack[0]
    for unclosed in stack[1:]:
        out.append("{")
        out.extend(unclosed)
    return "".join(out)


def _keep_formulas(text: str, kept: list[str]) -> str:
    """Formulas as numbered marks, for steps that must not touch them."""

    def keep(m):
        kept.append(m[0])
        return f"\x01{len(kept) - 1}\x01"

    if "$" in text:
        text = TEX_MATH.sub(lambda m: keep(m) if _is_math(m) else m[0], text)
    return TEX_PAREN.sub(lambda m: keep(m) if _is_paren_math(m) else m[0], text) if "\\" in text else text


def _put_formulas(text: str, kept: list[str]) -> str:
    while "\x01" in text:  # a formula in parentheses may hold one in dollars
        text = re.sub("\x01(\\d+)\x01", lambda m: kept[int(m[1])], text)
    return text


def _from_latex(text: str, formulas: list[str]) -> str:
    """Formulas end up in ``formulas``, with marks in their places."""
    text = re.sub(r"\\(chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}", lambda m: f"{'#' * {'chapter': 1, 'section': 2, 'subsection': 3}.get(m[1], 4)} {m[2]}", text)
    text = re.sub(r"\\begin\{(equation|align|displaymath|gather|eqnarray)\*?\}(.*?)\\end\{\1\*?\}", lambda m: f"$$ {m[2].strip()} $$", text, flags=re.S)
    text = re.sub(r"\\begin\{(verbatim|lstlisting|minted)\}(?:\[[^\[\]\n]*\])?(?:\{[^}\n]*\})?\n?(.*?)\\end\{\1\}", lambda m: "\n```\n" + m[2].rstrip("\n") + "\n```\n", text, flags=re.S)
    text = re.sub(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\[\]\n]*\])?\n?", "", text)
    text = re.sub(r"^[ \t]*\\item(?:\[[^\[\]\n]*\])?[ \t]*", "- ", text, flags=re.M)
    text = re.sub(r"\\(?:cite|ref|label|pageref|footnotemark|vspace|hspace|includegraphics|input|usepackage|documentclass)\*?(?:\[[^\[\]\n]*\])?\{[^{}]*\}", "", text)
    text = re.sub(r"\\texttt\{([^{}]*)\}", r"`\1`", text)
    text = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", text)
    return _unwrap(_keep_formulas(text, formulas), _TEX_WORDS)


def _from_markdown(text: str) -> str:
    text = re.sub(r"!\[([^\]\n]*)\]\([^)\n]*\)", r"\1", text)
    text = re.sub(r"(?<!!)\[([^\[\]\n]+)\]\((?:[^()\n]|\([^()\n]*\))*\)", r"\1", text)
    text = re.sub(r"\[\^[^\]\n]+\](?!:)", "", text)
    text = re.sub(r"(?<![\w*])(\*{1,3})(?=[^\s*])([^*\n]*[^\s*])\1(?![\w*])", r"\2", text)
    text = re.sub(r"(?<![\w_])(_{1,3})(?=[^\s_])([^_\n]*[^\s_])\1(?![\w_])", r"\2", text)
    text = re.sub(r"~~(?=\S)([^~\n]+)~~", r"\1", text)
    return text


def clean_entry(text: str) -> str:
    """The text without foreign markup and inline Markdown marks; headings, lists, tables, code and
    formulas stay. Line ends become LF, runs of blank lines one blank line."""
    text, kept = protect(text.replace("\r\n", "\n").replace("\r", "\n").replace("\x01", "\ufffd"))
    formulas: list[str] = []
    if "<" in text or "&" in text:
        text = _from_html(_from_wiki(text))
    else:
        text = _from_wiki(text)
    text = _from_latex(text, formulas) if "\\" in text else _keep_formulas(text, formulas)
    text = restore(_put_formulas(_from_markdown(text), formulas), kept)
    return _BLANKS.sub("\n\n", "\n".join(x.rstrip() for x in text.split("\n"))).strip("\n")


def _template_code(inside: str) -> str:
    """What a template around code holds: its last positional or ``code`` argument."""
    return re.sub(r"\A[ \t]*(?:1|code)[ \t]*=", "", inside.partition("|")[2]).strip("\n")


def clean_block(content: str, language: str | None) -> str:
    """The code of a block without what a rendered or converted page left in it."""
    for kind in block_kinds(content, language):
        if kind == "html":
            content = REFERENCE.sub(_reference_text, _without_tags(COMMENT.sub("", re.sub(r"<br\b[^>]*>(?:\r?\n)?", "\n", content, flags=re.I))))
        elif kind == "wiki":
            content = SOURCE_TAG.sub("", content)
            content = re.sub(r"\A\s*\{\{[ \t]*[A-Za-z][\w ]*\|(?:1=|code=)?\n?(.*?)\n?\}\}\s*\Z", r"\1", content, flags=re.S)
            content = _nested(content, "{{", "}}", lambda inside, _: _template_code(inside) if BLOCK_TEMPLATE.match("{{" + inside) else None)
            content = BLOCK_WIKI_LINK.sub("", content)
            if "|}" in content:
                content = WIKI_TABLE.sub(_wiki_table, content)
            content = WIKI_HEADING.sub(lambda m: m[2].strip() if len(m[1]) > 1 else m[0], content)
        elif kind == "latex":
            content = re.sub(r"^[ \t]*\\(?:begin|end)\{\w+\*?\}(?:\[[^\[\]\n]*\])?[ \t]*\n?", "", content, flags=re.M)
            content = re.sub(r"^\\text\w+\{(.*)\}[ \t]*(?:\\\\)?[ \t]*(\r?)$", r"\1\2", content, flags=re.M)
            content = re.sub(r"\\verb\*?([|!+])([^\n]*?)\1", r"\2", content)
            content = re.sub(r"\{\\(?:tt|bf|it|em|sf|sc)\b[ \t]*([^{}\n]*)\}", r"\1", content)
            content = _unwrap(re.sub(r"(?<![\w\\])(\\[A-Za-z]{2,}\*?)\[[^\[\]\n]*\](?=\{)", r"\1", content), _BRACE_LEAD)
        else:
            if _quoted(content):
                content = re.sub(r"^ {0,3}> ?", "", content, flags=re.M)
            content = re.sub(r"^[ \t]*(?:`{3,}|~{3,})[\w+-]*[ \t]*\r?\n?", "", content, flags=re.M)
            content = BLOCK_BOLD.sub(lambda m: m[1] or "", content)
    return content.strip("\n")


_FOUND = "struct<markup: array<string>, text: string>"


def residue(text: Column, language: Column | None = None, block: bool = False, with_text: bool = True) -> Column:
    """struct(markup, text): the kinds of foreign markup and the cleaned text of a column.

    ``block`` reads code blocks, whose ``language`` decides what is foreign. Null texts give null
    fields, empty texts no kinds. Texts are read whole.
    """

    @F.pandas_udf(_FOUND)
    def found(texts: pd.Series, languages: pd.Series) -> pd.DataFrame:
        kinds, clean = [], []
        for t, lang in zip(texts, languages):
            kinds.append(None if t is None else block_kinds(t, lang) if block else entry_kinds(t))
            clean.append(None if t is None or not with_text else clean_block(t, lang) if block else clean_entry(t))
        return pd.DataFrame({"markup": kinds, "text": clean})

    return found(text, F.lit(None).cast("string") if language is None else language)


def found_kinds(df: DataFrame, kind: str, id_col: str, markup: Column) -> DataFrame:
    """One row per record and kind of markup: record_kind, record_id, markup."""
    rows = df.select(F.col(id_col).alias("record_id"), markup.alias("_m"))
    return rows.select(F.lit(kind).alias("record_kind"), "record_id", F.explode_outer("_m.markup").alias("markup")).where("markup is not null")
