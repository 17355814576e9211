"""Three-valued compile guards: a condition is known only if it is the same for both values of its unknown atoms.

This is not Kleene logic: X || !X over an unknown X is true. All unknown atoms are put to true together, then to
false together. A chain of frames is false if any is false, unknown if any is unknown, else true.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\s*(&&|\|\||!|\(|\)|(?:os|canImport|targetEnvironment|arch|swift|compiler|defined)\s*\([^()]*\)|[A-Za-z_]\w*|\d+|.)")


def evaluate(condition: str | None, known: dict[str, bool], unknown: bool) -> bool | None:
    """The condition with unknown atoms put to `unknown`; None if it can't be read. Precedence: ! over && over ||."""
    tokens = [re.sub(r"\s+", "", t) for t in _TOKEN.findall(condition or "")]
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def unary() -> bool:
        nonlocal at
        t = peek()
        at += 1
        if t == "!":
            return not unary()
        if t == "(":
            v = either()
            if peek() != ")":
                raise ValueError(condition)
            at += 1
            return v
        if not re.match(r"\w", t):
            raise ValueError(condition)
        name = t[8:-1] if t.startswith("defined(") else t
        return known.get(name, unknown)

    def both() -> bool:
        nonlocal at
        v = unary()
        while peek() == "&&":
            at += 1
            v = unary() and v
        return v

    def either() -> bool:
        nonlocal at
        v = both()
        while peek() == "||":
            at += 1
            v = both() or v
        return v

    try:
        v = either()
        return v if at == len(tokens) else None
    except (ValueError, IndexError):
        return None


# What is known of a release build for iOS.
RELEASE_IOS = {
    "os(iOS)": True, "canImport(UIKit)": True, "TARGET_OS_IPHONE": True, "TARGET_OS_IOS": True, "arch(arm64)": True,
    "DEBUG": False, "os(macOS)": False, "os(OSX)": False, "os(watchOS)": False, "os(tvOS)": False, "os(visionOS)": False, "os(Linux)": False,
    "canImport(AppKit)": False, "targetEnvironment(simulator)": False, "TARGET_OS_OSX": False, "TARGET_OS_SIMULATOR": False, "TARGET_OS_WATCH": False, "TARGET_OS_TV": False,
}


def branch(conditions: list[bool | None], last: str) -> bool | None:
    """Liveness of a branch of one frame: conditions are those of #if and every #elseif so far; last is if, elseif or else.

    #else after an unknown condition is unknown; #elseif after a true one is false even so.
    """
    if last == "if":
        return conditions[0]
    if last == "else":
        return None if None in conditions else not any(conditions)
    before, this = conditions[:-1], conditions[-1]
    if this is False or True in before:
        return False
    return None if None in conditions else True


def liveness(known: dict[str, bool]):
    """A column function: array of guard lines (#if, #elseif, #else of each open frame) -> true, false or null; none are true."""
    facts = {"true": True, "1": True, "false": False, "0": False} | known

    @F.pandas_udf(T.BooleanType())
    def live(chains: pd.Series) -> pd.Series:
        memo: dict[str, bool | None] = {}

        def value(c: str) -> bool | None:
            if c not in memo:
                a, b = evaluate(c, facts, True), evaluate(c, facts, False)
                memo[c] = a if a == b else None
            return memo[c]

        def chain(texts) -> bool | None:
            frames: list[tuple[list[bool | None], str]] = []
            for t in texts if texts is not None else []:
                word, _, c = (t or "").strip().lstrip("#").strip().partition(" ")
                c = f"defined({c.strip()})" if word == "ifdef" else f"!defined({c.strip()})" if word == "ifndef" else c.strip()
                if word in ("if", "ifdef", "ifndef"):
                    frames.append(([value(c)], "if"))
                elif frames and word in ("elseif", "elif"):
                    frames[-1] = ([*frames[-1][0], value(c)], "elseif")
                elif frames and word == "else":
                    frames[-1] = (frames[-1][0], "else")
            vals = [branch(*f) for f in frames]
            return False if False in vals else None if None in vals else True

        return chains.map(chain).astype(object)

    return live
