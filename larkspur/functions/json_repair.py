"""A tolerant reader for almost-JSON: one pass, no backtracking, the value it could read or an error.

It takes what strict JSON takes, and: single or curly quotes, keys and words without quotes, Python's constants, missing or
doubled commas, comments, raw line breaks in strings, quotes inside a string that no separator follows, and ends that never
came (open strings, lists and objects close at the end of the text). Text around the value is passed over.
"""

from __future__ import annotations

import json
import re

_QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’"}
_CONSTANTS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None, "undefined": None, "NaN": None}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|$)|#[^\n]*)+", re.S)
_NUMBER = re.compile(r"-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?=[\s,:\]}/#]|$)")
_BARE = re.compile(r"[^,:\[\]{}\n\"]+")
MAX_DEPTH = 200


class Reader:
    def __init__(self, text: str):
        self.text, self.at, self.depth = text, 0, 0

    def peek(self) -> str:
        if m := _SKIP.match(self.text, self.at):
            self.at = m.end()
        return self.text[self.at : self.at + 1]

    def value(self):
        c = self.peek()
        if c in ("{", "["):
            self.depth += 1
            if self.depth > MAX_DEPTH:
                raise ValueError("nested too deep")
            self.at += 1
            found = self.members() if c == "{" else self.elements()
            self.depth -= 1
            return found
        return self.string() if c in _QUOTES and c else self.scalar()

    def elements(self) -> list:
        out = []
        while (c := self.peek()) and c != "]":
            if c in ",:" or c == "}":
                self.at += 1
                continue
            out.append(self.value())
        self.at += 1
        return out

    def members(self) -> dict:
        out = {}
        while (c := self.peek()) and c != "}":
            if c in ",:":
                self.at += 1
                continue
            if c in "[]{":  # no key can begin here: the object ends
                return out
            key = self.string() if c in _QUOTES else str(self.scalar(key=True))
            if self.peek() == ":":
                while (c := self.peek()) == ":":
                    self.at += 1
                out[key] = None if c in ("", ",", "}") else self.value()
            elif self.peek():
                out.setdefault(key, None)
        self.at += 1
        return out

    def string(self) -> str:
        close, out = _QUOTES[self.text[self.at]], []
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == "\\":
                n = self.text[self.at : self.at + 1]
                self.at += 1
                if n == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", code := self.text[self.at : self.at + 4]):
                    out.append(chr(int(code, 16)))
                    self.at += 4
                else:
                    out.append(_ESCAPES.get(n, n))
            elif c == close and self.ends():
                break
            else:
                out.append(c)
        return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def ends(self) -> bool:
        """Whether a quote closes its string: a separator, a bracket or the end comes next."""
        m = _SKIP.match(self.text, self.at)
        at = m.end() if m else self.at
        return at >= len(self.text) or self.text[at] in ",:]}" or "\n" in self.text[self.at : at]

    def scalar(self, key: bool = False):
        if not key and (m := _NUMBER.match(self.text, self.at)):
            self.at = m.end()
            try:
                return json.loads(m[0])
            except ValueError:
                return float(m[0])
        m = _BARE.match(self.text, self.at)
        if not m:
            self.at += 1
            return None
        self.at = m.end()
        word = m[0].strip()
        return word if key else _CONSTANTS.get(word, word)


def repair(text: str | None):
    """The first object or list of a text, repaired; ValueError where there is none."""
    starts = [i for i in ((text or "").find("{"), (text or "").find("[")) if i >= 0]
    if not starts:
        raise ValueError("no object or list")
    reader = Reader(text)
    reader.at = min(starts)
    return reader.value()
