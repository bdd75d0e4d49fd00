"""quire: Markdown collections and training corpora as Spark tables."""

from quire.core.blocks import parse
from quire.meta.frontmatter import FrontMatter

__version__ = "0.1.0"
__all__ = ["FrontMatter", "parse", "parse_reader"]


def parse_reader(reader, gfm: bool = True):
    """A document from anything with ``read()``, bytes or text; it is read whole before it is parsed."""
    data = reader.read()
    return parse(data.decode("utf-8", "replace") if isinstance(data, bytes) else data, gfm)
