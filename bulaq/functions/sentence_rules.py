"""The sentence rules of functions.text for one Python string, for use inside Arrow functions."""

from __future__ import annotations

import re

from . import text as X

_STOP = re.compile(rf"(?<!\S)([{X.UPPER}]|{'|'.join(map(X._any_case, X._ABBREVIATIONS))}|\d+(?:\.\d+)*)\.(?=\s)")
_END = re.compile(rf"(?<=[.!?…])[)\"']*\s+(?=[{X.UPPER}0-9\"'(\-])")


def split(text: str) -> list[str]:
    held = {m.end() - 1 for m in _STOP.finditer(text)}
    out, at = [], 0
    for m in _END.finditer(text):
        if m.start() - 1 in held and m.group()[0].isspace():
            continue
        out.append(text[at : m.end()].strip())
        at = m.end()
    return [s for s in (*out, text[at:].strip()) if s]
