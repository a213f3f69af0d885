"""Tokens of JavaScript, TypeScript and Rust sources: comments and the insides of strings never look like code."""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # name, string, number, sign
    text: str  # of a string, what stands between its quotes
    at: int


class Lines:
    """Line numbers by place: one pass over the text, then a search for each place."""

    def __init__(self, text: str) -> None:
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def __call__(self, place: int) -> int:
        return bisect.bisect_right(self.starts, place)


_NAME = r"(?P<name>[^\W\d][\w$]*|\$[\w$]*)"
_NUMBER = r"(?P<number>\d[\w.]*)"
_JS = re.compile(rf"(?P<gap>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>'(?:\\[\s\S]|[^'\\\n])*'|\"(?:\\[\s\S]|[^\"\\\n])*\")|(?P<template>`)|{_NAME}|{_NUMBER}|(?P<sign>=>|[\s\S])")
_RUST = re.compile(rf"(?P<gap>\s+|//[^\n]*)|(?P<comment>/\*)|(?P<raw>b?r(?P<marks>#*)\")|(?P<string>b?\"(?:\\[\s\S]|[^\"\\])*\"|b?'(?:\\[^\n']+|\\'|[^'\\\n])')|(?P<life>'[^\W\d]\w*)|{_NAME}|{_NUMBER}|(?P<sign>::|->|=>|[\s\S])")
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Words after which a slash opens a pattern.
_BEFORE_PATTERN = frozenset("return typeof case in of delete void throw new else do".split())


def _template_end(text: str, at: int) -> int:
    """The place behind a template that opens at ``at``; templates nest inside ``${}``."""
    waiting = [-1]  # open braces of each ${} around, -1 for a template's own text
    at += 1
    while at < len(text) and waiting:
        c = text[at]
        if waiting[-1] < 0:
            if c == "\\":
                at += 1
            elif c == "`":
                waiting.pop()
            elif text.startswith("${", at):
                waiting.append(0)
                at += 1
        elif c == "`":
            waiting.append(-1)
        elif c == "{":
            waiting[-1] += 1
        elif c == "}":
            waiting[-1] -= 1
            if waiting[-1] < 0:
                waiting.pop()
        at += 1
    return at


def js_tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at = 0
    while at < len(text):
        m = _JS.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "template":
            end = _template_end(text, at)
            out.append(Token("string", text[at + 1 : end - 1], at))
        elif kind == "string":
            out.append(Token("string", text[at + 1 : end - 1], at))
        elif kind == "sign" and m[0] == "/":
            last = out[-1] if out else None
            value = last and (last.kind in ("number", "string") or last.kind == "name" and last.text not in _BEFORE_PATTERN or last.text in (")", "]", "}", "<"))
            pattern = None if value else _PATTERN.match(text, at)
            end = pattern.end() if pattern else end
            out.append(Token("string" if pattern else "sign", text[at:end], at))
        elif kind != "gap":
            out.append(Token(kind, m[0], at))
        at = end
    return out


def rust_tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at = 0
    while at < len(text):
        m = _RUST.match(text, at)
        kind, end = m.lastgroup, m.end()
        if m["comment"]:
            depth = 1
            for edge in re.compile(r"/\*|\*/").finditer(text, end):
                depth += 1 if edge[0] == "/*" else -1
                if not depth:
                    break
            end = edge.end() if not depth else len(text)
        elif m["raw"]:
            close = text.find('"' + m["marks"], end)
            close = len(text) if close < 0 else close
            out.append(Token("string", text[end:close], at))
            end = close + 1 + len(m["marks"])
        elif kind == "string":
            out.append(Token("string", m[0].strip("b\"'"), at))
        elif kind not in ("gap", "life"):
            out.append(Token(kind, m[0], at))
        at = end
    return out


_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


def partners(tokens: list[Token]) -> dict[int, int]:
    """For each opening bracket the number of the token that closes it; the end where none does."""
    found: dict[int, int] = {}
    waiting: list[int] = []
    for i, t in enumerate(tokens):
        if t.kind != "sign":
            continue
        if t.text in _OPEN:
            waiting.append(i)
        elif t.text in _CLOSE:
            # an unmatched bracket closes nothing; one that was left open closes with its surroundings
            k = len(waiting) - 1
            while k >= 0 and _OPEN[tokens[waiting[k]].text] != t.text:
                k -= 1
            if k >= 0:
                for j in waiting[k:]:
                    found[j] = i
                del waiting[k:]
    for j in waiting:
        found[j] = len(tokens)
    return found
