"""Python ``re`` semantics on the JVM regex engine.

Spark evaluates ``regexp_replace``/``rlike``/``regexp_extract_all`` with
``java.util.regex``.  Python's ``\\w``, ``\\d`` and ``\\s`` are Unicode-aware
and differ from Java's defaults, so the library spells them out as explicit
character classes.  The classes below use only ``\\p{..}`` and ``\\x{..}``
syntax, which RE2 (DuckDB) understands as well, so the same fragments serve
the SQL oracles.
"""

from __future__ import annotations

import re


def _ranges(codepoints: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cp in codepoints:
        if out and out[-1][1] == cp - 1:
            out[-1] = (out[-1][0], cp)
        else:
            out.append((cp, cp))
    return out


def _class_body(codepoints: list[int]) -> str:
    parts = []
    for lo, hi in _ranges(codepoints):
        parts.append(f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}")
    return "".join(parts)


# Python's whitespace set is derived from str.isspace (the rule ``\s`` and
# ``str.split()`` follow); Python's ``\w`` is exactly letters, numbers and
# the underscore, and ``\d`` is exactly the decimal digits (Nd).
SPACE_BODY = _class_body([c for c in range(0x3001) if chr(c).isspace()])
WORD_BODY = "\\p{L}\\p{N}_"
DIGIT_BODY = "\\p{Nd}"

SPACE = f"[{SPACE_BODY}]"
NOT_SPACE = f"[^{SPACE_BODY}]"
WORD = f"[{WORD_BODY}]"
NOT_WORD = f"[^{WORD_BODY}]"
DIGIT = f"[{DIGIT_BODY}]"

# Cc characters other than newline and tab (Python: unicodedata.category == "Cc").
CONTROL_NO_NL_TAB = "[\\x{0}-\\x{8}\\x{B}-\\x{1F}\\x{7F}-\\x{9F}]"


def to_java(pattern: str) -> str:
    """Rewrite a Python regular expression for java.util.regex.

    Handles the class escapes whose meaning differs (\\w \\W \\d \\D \\s \\S
    \\b \\B), ``\\Z``, the ``(?P<name>..)`` / ``(?P=name)`` group syntax, ``&&``
    inside a class (an intersection in Java) and ``(?i)`` (Unicode-aware in
    Python).  A pattern with ``.``, ``^`` or ``$`` gets ``(?d)``, so that only
    the line feed ends a line.  Other syntax is shared.
    """
    out: list[str] = []
    i = 0
    in_class = lines = False
    n = len(pattern)
    boundary = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
    non_boundary = f"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"
    while i < n:
        ch = pattern[i]
        if ch == "\\" and i + 1 < n:
            nxt = pattern[i + 1]
            i += 2
            if nxt == "w":
                out.append(WORD_BODY if in_class else WORD)
            elif nxt == "W":
                out.append(f"[^{WORD_BODY}]" if in_class else NOT_WORD)
            elif nxt == "d":
                out.append(DIGIT_BODY if in_class else DIGIT)
            elif nxt == "D":
                out.append("\\P{Nd}")
            elif nxt == "s":
                out.append(SPACE_BODY if in_class else SPACE)
            elif nxt == "S":
                out.append(f"[^{SPACE_BODY}]" if in_class else NOT_SPACE)
            elif nxt == "b" and not in_class:
                out.append(boundary)
            elif nxt == "B" and not in_class:
                out.append(non_boundary)
            elif nxt == "Z" and not in_class:
                out.append("\\z")
            else:
                out.append("\\" + nxt)
            continue
        if in_class:
            if ch == "]" and not (out and out[-1] in ("[", "[^")):
                in_class = False
            elif ch == "[":
                # a literal '[' inside a Python class must be escaped for Java
                out.append("\\[")
                i += 1
                continue
            out.append("\\&" if ch == "&" else ch)
            i += 1
            continue
        if ch in ".^$":
            lines = True
        flags = re.match(r"\(\?([aimsux]+)(-[imsx]+)?([:)])", pattern[i:])
        if flags:
            on = flags.group(1)
            on = on.replace("a", "") if "a" in on else on + ("u" if "i" in on and "u" not in on else "")
            out.append(f"(?{on}{flags.group(2) or ''}{flags.group(3)}")
            i += flags.end()
            continue
        if ch == "[":
            in_class = True
            if pattern.startswith("[^", i):
                out.append("[^")
                i += 2
            else:
                out.append("[")
                i += 1
            if i < n and pattern[i] == "]":
                out.append("\\]")
                i += 1
            continue
        if pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        if pattern.startswith("(?P=", i):
            j = pattern.index(")", i)
            out.append(f"\\k<{pattern[i + 4:j]}>")
            i = j + 1
            continue
        out.append(ch)
        i += 1
    return ("(?d)" if lines else "") + "".join(out)


_SIMPLE_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v", "a": "\a", "b": "\b", "\\": "\\"}


def replacement_to_java(template: str) -> str:
    """Rewrite a Python ``re.sub`` replacement template for Java's
    ``Matcher.appendReplacement`` (``\\1``/``\\g<1>``/``\\g<name>`` → ``$1`` /
    ``${name}``; literal ``$`` and ``\\`` escaped)."""
    out: list[str] = []
    i = 0
    n = len(template)

    def lit(text: str) -> None:
        out.append(text.replace("\\", "\\\\").replace("$", "\\$"))

    while i < n:
        ch = template[i]
        if ch != "\\" or i + 1 == n:
            lit(ch)
            i += 1
            continue
        nxt = template[i + 1]
        if nxt == "g" and i + 2 < n and template[i + 2] == "<":
            j = template.index(">", i)
            name = template[i + 3:j]
            out.append(f"${name}" if name.isdigit() else f"${{{name}}}")
            i = j + 1
        elif nxt.isdigit():
            m = re.match(r"\d{1,2}", template[i + 1:])
            out.append("$" + m.group(0))
            i += 1 + len(m.group(0))
        elif nxt in _SIMPLE_ESCAPES:
            lit(_SIMPLE_ESCAPES[nxt])
            i += 2
        else:
            lit("\\" + nxt)
            i += 2
    return "".join(out)


# Fixed patterns of the cleaning operators (values that must equal the
# reference's results), written in Python syntax and converted once.
EMAIL_PY = r"(?<![\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}(?![\w.-])"
PHONE_PY = r"(?<!\w)(?:\+?\d[\d\s().-]{7,}\d)(?!\w)"
URL_PY = r"https?://\S+|www\.\S+"
HTML_TAG_PY = r"<[^>]{0,2000}>"
TOKEN_PY = r"\w+|[^\w\s]"

EMAIL = to_java(EMAIL_PY)
PHONE = to_java(PHONE_PY)
URL = "(?iu)" + to_java(URL_PY)
HTML_TAG = to_java(HTML_TAG_PY)
