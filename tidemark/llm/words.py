"""Words as TESTDATA.md defines them: maximal runs of letters or digits, lower-cased."""

from __future__ import annotations

import re

_RUN = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """All words of `text` in order; none of a null."""
    return _RUN.findall(text.lower()) if text else []
