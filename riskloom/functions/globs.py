"""Path globs as regular expressions: a glob is a run of whole segments at any depth."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import slashes


def _segment(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c, i = glob[i], i + 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := glob.find("]", i + 1)) > 0:
            inner = glob[i:end]
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner).replace("\\", "\\\\") + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return out


def glob_regex(globs: list[str]) -> str:
    """One alternation for all globs (``**`` segments add nothing, since a run may start at any depth)."""
    runs = ["/".join(_segment(s) for s in g.replace("\\", "/").strip("/").split("/") if s and s != "**") for g in globs]
    runs = [r for r in runs if r]
    return f"(^|/)({'|'.join(runs)})(/|$)" if runs else ""


def excluded(path: Column, globs: list[str]) -> Column:
    pattern = glob_regex(globs)
    return F.coalesce(slashes(path).rlike(pattern), F.lit(False)) if pattern else F.lit(False)
