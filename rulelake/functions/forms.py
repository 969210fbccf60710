"""A reader of s-expressions for source text, and what it tells of calls, as Arrow UDFs.

Source lines are the one input that isn't relational; everything read here becomes rows, and is joined from there on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, set(")]}")
_BLANK = set(" \t\r\n\f,")


def skip(text: str, at: int) -> int:
    """The next place that isn't white space, a comma or a comment."""
    while at < len(text):
        if text[at] in _BLANK:
            at += 1
        elif text[at] == ";":
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
        elif text.startswith("#_", at):
            at = form_end(text, skip(text, at + 2))
        else:
            break
    return at


def form_end(text: str, at: int) -> int:
    """Where the form that begins at `at` ends; the end of the text if it isn't closed."""
    if at >= len(text):
        return at
    c = text[at]
    if c in "'`~@^" or text.startswith("#'", at):
        step = 2 if text.startswith(("~@", "#'"), at) else 1
        end = form_end(text, skip(text, at + step))
        return form_end(text, skip(text, end)) if c == "^" else end  # metadata belongs to the next form
    if c == '"' or text.startswith('#"', at):
        at += 1 if c == '"' else 2
        while at < len(text) and text[at] != '"':
            at += 2 if text[at] == "\\" else 1
        return min(len(text), at + 1)
    if c == "\\":
        at += 2
        while at < len(text) and text[at].isalnum():
            at += 1
        return at
    if c == "#" and at + 1 < len(text):
        if text[at + 1] in _OPEN:
            return form_end(text, at + 1)
        at += 1
        while at < len(text) and text[at] not in _BLANK and text[at] not in _OPEN:
            at += 1
        return form_end(text, skip(text, at))
    if c in _OPEN:
        at = skip(text, at + 1)
        while at < len(text) and text[at] not in _CLOSE:
            at = skip(text, form_end(text, at))
        return min(len(text), at + 1)
    while at < len(text) and text[at] not in _BLANK and text[at] not in "()[]{}\";":
        at += 1
    return max(at, 1)


def children(form: str | None) -> list[str]:
    """The forms inside a list, vector or map, as they are written; none for anything else, or nothing that can be read."""
    form = (form or "").strip()
    if not form or form[0] not in _OPEN:
        return []
    out, at = [], skip(form, 1)
    while at < len(form) and form[at] not in _CLOSE:
        end = form_end(form, at)
        if end <= at:
            break
        out.append(form[at:end])
        at = skip(form, end)
    return out


def built_class(form: str | None) -> str | None:
    """What a constructor form builds: (->X ..), (map->X ..), (new X ..), (X. ..), (X/new ..), with X's namespace if one is
    written; null for other forms."""
    parts = children(form)
    if not parts or not (form or "").strip().startswith("("):
        return None
    head = parts[0]
    ns, _, name = head.rpartition("/") if "/" in head[1:] else ("", "", head)
    for mark in ("->", "map->"):
        if name.startswith(mark) and len(name) > len(mark):
            return f"{ns}/{name[len(mark):]}" if ns else name[len(mark) :]
    if head in ("new", "clojure.core/new"):
        return parts[1] if len(parts) > 1 and parts[1][0] not in "([{\"':" else None
    if name.endswith(".") and len(name) > 1:
        return f"{ns}/{name[:-1]}" if ns else name[:-1]
    return ns if name == "new" and ns else None


def span(lines: list[str] | None, row: int | None, col: int | None, end_row: int | None, end_col: int | None) -> str | None:
    """The text from (row, col) up to but without (end_row, end_col), counted from 1; null where a place is missing or outside."""
    if lines is None or None in (row, col, end_row, end_col) or not 1 <= row <= end_row <= len(lines):
        return None
    if row == end_row:
        return lines[row - 1][col - 1 : end_col - 1]
    return "\n".join([lines[row - 1][col - 1 :], *lines[row : end_row - 1], lines[end_row - 1][: end_col - 1]])


def init_start(lines: list[str] | None, row: int | None, col: int | None) -> tuple[int, int] | None:
    """Where the first form after (row, col) begins."""
    if lines is None or row is None or col is None or not 1 <= row <= len(lines):
        return None
    rest = "\n".join([lines[row - 1][col - 1 :], *lines[row:]])
    at = skip(rest, 0)
    if at >= len(rest):
        return None
    before = rest[:at]
    down = before.count("\n")
    return row + down, (col + at if not down else at - before.rfind("\n"))


def init_form(lines: list[str] | None, row: int | None, col: int | None) -> str | None:
    """The first form after (row, col), which is what a binding there is bound to."""
    place = init_start(lines, row, col)
    if place is None:
        return None
    rest = "\n".join([lines[place[0] - 1][place[1] - 1 :], *lines[place[0] :]])
    return rest[: form_end(rest, 0)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def read_arguments(form: pd.Series) -> pd.Series:
    """The arguments of a call; null where the text is no call."""
    return form.map(lambda f: children(f)[1:] if isinstance(f, str) and f.strip().startswith("(") else None)


@F.pandas_udf(T.StringType())
def read_class(form: pd.Series) -> pd.Series:
    return form.map(built_class)


@F.pandas_udf(T.StringType())
def read_span(lines: pd.Series, row: pd.Series, col: pd.Series, end_row: pd.Series, end_col: pd.Series) -> pd.Series:
    whole = lambda x: None if pd.isna(x) else int(x)
    return pd.Series([span(None if a is None else list(a), *map(whole, at)) for a, *at in zip(lines, row, col, end_row, end_col, strict=True)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("form", T.StringType())]))
def read_init(lines: pd.Series, row: pd.Series, col: pd.Series) -> pd.DataFrame:
    out = []
    for a, r, c in zip(lines, row, col, strict=True):
        a, r, c = None if a is None else list(a), None if pd.isna(r) else int(r), None if pd.isna(c) else int(c)
        place = init_start(a, r, c)
        out.append((None, None, None) if place is None else (*place, init_form(a, r, c)))
    return pd.DataFrame(out, columns=["row", "col", "form"]).astype({"row": "Int32", "col": "Int32"})
