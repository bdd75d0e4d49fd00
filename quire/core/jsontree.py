"""Reading JSON roots and walking them, at any depth and without losing number spelling."""

from __future__ import annotations

import json
import re


class Number(str):
    """A JSON number as it was written."""

    __slots__ = ()

    @property
    def kind(self) -> str:
        return "float" if any(c in self for c in ".eE") else "integer"


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


_decoder = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_no_constant)
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}


def _iterative(text: str):
    """The same parse with an explicit stack, for trees deeper than the recursive parser allows."""
    pos, stack, top = 0, [], []
    current, want, key = top, "value", None
    while True:
        m = _TOKEN.match(text, pos)
        if not m:
            break
        pos = m.end()
        mark, string, number, word = m.groups()
        if want in ("value", "value or end") and mark in ("{", "["):
            child = {} if mark == "{" else []
            if isinstance(current, dict):
                current[key] = child
            else:
                current.append(child)
            stack.append(current)
            current, want = child, "key or end" if mark == "{" else "value or end"
        elif want in ("value", "value or end") and (string or number or word):
            value = json.loads(string) if string else Number(number) if number else _WORDS[word]
            if isinstance(current, dict):
                current[key] = value
            else:
                current.append(value)
            want = "separator"
        elif want in ("key", "key or end") and string:
            key, want = json.loads(string), "colon"
        elif want == "colon" and mark == ":":
            want = "value"
        elif want == "separator" and mark == "," and stack:
            want = "key" if isinstance(current, dict) else "value"
        elif stack and want in ("separator", "key or end", "value or end") and mark == ("}" if isinstance(current, dict) else "]"):
            current, want = stack.pop(), "separator"
        else:
            raise ValueError("not JSON")
    if stack or len(top) != 1 or text[pos:].strip(" \t\n\r"):
        raise ValueError("not JSON")
    return top[0]


def parse(text: str):
    """JSON text to Python values; numbers stay as written, a repeated key keeps its last value."""
    try:
        return _decoder.decode(text)
    except RecursionError:
        return _iterative(text)


def read_root(text: str | None) -> dict | None:
    """The object a root text holds, directly or wrapped once more as a JSON string; else None."""
    if text is None:
        return None
    try:
        value = parse(text)
        if isinstance(value, str) and not isinstance(value, Number):
            text = value
            value = parse(value)
    except ValueError:
        return None
    if not isinstance(value, dict):
        return None
    return _whole(value) if _SURROGATE.search(text) else value


_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]|[\ud800-\udfff]")


def _text(s: str) -> str:
    return s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _whole(root):
    """The tree with halves of surrogate pairs, which no text can hold, replaced by U+FFFD."""
    out: dict = {}
    stack = [(root, out)]
    while stack:
        source, target = stack.pop()
        for k, v in source.items() if isinstance(source, dict) else enumerate(source):
            if isinstance(v, (dict, list)):
                child = {} if isinstance(v, dict) else []
                stack.append((v, child))
                v = child
            elif isinstance(v, str) and not isinstance(v, Number):
                v = _text(v)
            if isinstance(target, dict):
                target[_text(k)] = v
            else:
                target.append(v)
    return out


def scalar_text(value) -> str | None:
    """A scalar as text: strings as they are, numbers as written, true and false in lower case."""
    if value is None:
        return None
    if value is True:
        return "true"
    if value is False:
        return "false"
    return str(value)


def kind_of(value) -> str:
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "list"
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return value.kind if isinstance(value, Number) else "string"


def adjacency(root: dict):
    """Nodes of a tree in pre-order: (node, parent, owner, label, ordinal, kind, scalar, path, owner_path, entity).

    ``parent`` is the number of the node directly above, ``owner`` that of the nearest enclosing
    object; ``label`` is the key in an object and null in a list, ``ordinal`` the place in either.
    ``entity`` is the path with list places left out, the same for all rows of one entity table.
    """
    stack = [(None, None, None, 0, root, "$", None, "$")]
    node = 0
    while stack:
        parent, owner, label, ordinal, value, path, owner_path, entity = stack.pop()
        kind = kind_of(value)
        yield node, parent, owner, label, ordinal, kind, (None if kind in ("object", "list") else scalar_text(value)), path, owner_path, entity
        if kind == "object":
            children = [(node, node, k, i, v, f"{path}.{k}", path, f"{entity}.{k}") for i, (k, v) in enumerate(value.items())]
            stack.extend(reversed(children))
        elif kind == "list":
            children = [(node, owner, None, i, v, f"{path}[{i}]", owner_path, f"{entity}[]") for i, v in enumerate(value)]
            stack.extend(reversed(children))
        node += 1


def plain(value) -> str:
    """A value written as text, lists and objects as JSON with every scalar as text ("7" equals 7)."""
    if not isinstance(value, (dict, list)):
        return scalar_text(value) or ""
    try:
        return json.dumps(_texts(value), ensure_ascii=False)
    except RecursionError:
        return str([row[6] for row in adjacency({"": value}) if row[6] is not None])


def _texts(value):
    if isinstance(value, dict):
        return {k: _texts(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_texts(v) for v in value]
    return None if value is None else str(scalar_text(value))


TYPES = ("string", "integer", "float", "boolean", "list")
BIT = {name: 1 << i for i, name in enumerate(TYPES)}


def fields(root: dict, places: bool = False) -> dict[str, tuple[int, list[str | None]]]:
    """Field path to (set of types as bits, values as text in order).

    A field is a path to a non-null value that is no object: keys joined by ``.``, with ``[]`` for
    each list passed through. Items of a list that are no objects are no fields of their own; objects
    in lists within lists are reached through ``[][]``. With ``places`` an object of a list that lacks
    the field leaves a None, so the values of all fields below one list stand at the places of its objects.
    """
    out: dict[str, tuple[int, list[str | None]]] = {}
    counts: dict[str, int] = {}  # objects met so far in the lists of a path
    below_list: dict[str, str] = {}
    stack: list[tuple[str, object, tuple[str, int] | None, bool]] = [("", root, None, False)]
    while stack:
        path, value, at, item = stack.pop()
        if isinstance(value, dict):
            if item:
                at = path, counts.get(path, 0)
                counts[path] = at[1] + 1
            prefix = path + "." if path else ""
            below = [(prefix + k, v) for k, v in value.items()]
            for name, v in below:
                if v is not None and not isinstance(v, dict):
                    bits, values = out.get(name, (0, []))
                    if places and at:
                        values.extend([None] * (at[1] - len(values)))
                        below_list[name] = at[0]
                    values.append(plain(v))
                    out[name] = (bits | BIT[kind_of(v)], values)
            stack.extend((n, v, at, False) for n, v in reversed(below) if isinstance(v, (dict, list)))
        else:
            stack.extend((path + "[]", v, None, True) for v in reversed(value) if isinstance(v, (dict, list)))
    for name, of in below_list.items():
        out[name][1].extend([None] * (counts[of] - len(out[name][1])))
    return out
