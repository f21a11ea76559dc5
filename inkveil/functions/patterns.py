"""Entity patterns, exemption codes, and one regular-expression dialect for them.

Patterns are written once with two marks: {b} a boundary of ASCII word characters (before the first character of a
match, or behind the last), and {s} a white-space character (Unicode). java() and re2() spell them for Spark and for DuckDB.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

# The patterns, labels and codes that results depend on.
ENTITIES = {
    "ssn": r"{b}\d{3}-\d{2}-\d{4}{b}",
    "phone": r"(?:\+1[-.{s}]?)?\(?(\d{3})\)?[-.{s}]?\d{3}[-.{s}]?\d{4}{b}",
    "email": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "credit-card": r"{b}(?:4\d{3}|5[1-5]\d{2}|6011|3[47]\d{2})[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}{b}",
    "ip-address": r"{b}(?:\d{1,3}\.){3}\d{1,3}{b}",
    "date": r"(?i){b}(?:\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?[{s}]+\d{1,2},?[{s}]+\d{4}){b}",
    "name": r"(?<!\. )(?<![A-Z])[A-Z][a-z]{1,15}[{s}]+[A-Z][a-z]{1,15}(?![{s}]+[A-Z])",
    "attorney-client-marker": r"(?i){b}(?:ATTORNEY[-–—]CLIENT[{s}]+PRIVILEGE|PRIVILEGED[{s}]+AND[{s}]+CONFIDENTIAL|WORK[{s}]+PRODUCT|ATTORNEY WORK PRODUCT|PRIVILEGED COMMUNICATION){b}",
}
LABELS = {
    "ssn": "SSN", "phone": "Phone", "email": "Email", "credit-card": "Credit Card", "ip-address": "IP Address",
    "date": "Date", "name": "Name", "attorney-client-marker": "Privilege Marker",
}
PRIVACY, PRIVILEGE = ("(b)(6)", "Personal privacy"), ("(b)(5)", "Attorney work product / deliberative")
EXEMPTIONS = {t: PRIVILEGE if t == "attorney-client-marker" else PRIVACY for t in ENTITIES}
METADATA = {
    "email address": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "phone number": r"(?:\+1[-.{s}]?)?\(?\d{3}\)?[-.{s}]?\d{3}[-.{s}]?\d{4}",
    "SSN-like pattern": r"{b}\d{3}-\d{2}-\d{4}{b}",
    "IP address": r"{b}(?:\d{1,3}\.){3}\d{1,3}{b}",
    "URL": r"https?:\/\/[^{s}<>\"{}|\\^\[\]`]+",
}
INFO_FIELDS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate", "Trapped")

#: What a text must hold, within a line, to have a match: a plain pattern that is quicker to look for. Names have none.
HINTS = {
    "ssn": "[0-9]-[0-9]", "phone": "[0-9]{4}", "email": "@", "credit-card": "[0-9]{4}", "ip-address": r"[0-9]\.[0-9]", "date": "[0-9]{4}|[0-9][-/][0-9]",
    "attorney-client-marker": "[Pp][Rr](?:[Ii][Vv][Ii][Ll][Ee][Gg]|[Oo][Dd][Uu][Cc][Tt])",
}

_JAVA_SPACE = r"\t\n\x0B\f\r\x20\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_RE2_SPACE = r"\t\n\x{0B}\f\r\x{20}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def java(pattern: str) -> str:
    """The pattern for Spark. A match begins and ends with a word character where it has a boundary, so one look is enough."""
    head = re.match(r"(\(\?i\))?\{b\}", pattern)
    if head:
        pattern = (head[1] or "") + f"(?<!{_WORD})" + pattern[head.end() :]
    return pattern.replace("{b}", f"(?!{_WORD})").replace("{s}", _JAVA_SPACE)


def re2(pattern: str) -> str:
    return pattern.replace("{b}", r"\b").replace("{s}", _RE2_SPACE)


def escaped(literal: str) -> str:
    """A literal as a pattern."""
    return re.sub(r"[.*+?^${}()|\[\]\\]", r"\\\g<0>", literal)


def from_script(source: str, flags: str = "") -> str:
    """A pattern in the dialect of ECMAScript, for Spark: boundaries, white space, dots and ends as there."""
    out, i, inside = [], 0, False
    while i < len(source):
        c = source[i]
        two = source[i : i + 2]
        if c == "\\" and i + 1 < len(source):
            kind = two[1]
            if kind == "s":
                out.append(_JAVA_SPACE if inside else f"[{_JAVA_SPACE}]")
            elif kind == "S":
                out.append(f"&&[^{_JAVA_SPACE}]" if inside else f"[^{_JAVA_SPACE}]")
            elif kind == "b" and not inside:
                out.append(_BOUNDARY)
            elif kind == "/":
                out.append("/")
            else:
                out.append(two)
            i += 2
            continue
        if inside:
            if c == "]":
                inside = False
                out.append(c)
            elif c == "[" or two == "&&":
                out.append("\\" + c if c == "[" else r"\&\&")
                i += two == "&&"
            else:
                out.append(c)
        elif c == "[":
            inside = True
            out.append(c)
        elif c == "." and "s" not in flags:
            out.append(r"[^\n\r\u2028\u2029]")
        elif c == "$" and "m" not in flags:
            out.append(r"\z")
        else:
            out.append(c)
        i += 1
    lead = "".join(f for f in "ims" if f in flags)
    return (f"(?{lead})" if lead else "") + "".join(out)


def parse_pattern(text: str) -> str:
    """What a user types: /pattern/flags, or a literal."""
    m = re.fullmatch(r"/(.+)/([gimsuy]*)", text, re.S)
    return from_script(m[1], m[2]) if m else escaped(text)


@dataclass(frozen=True)
class Pattern:
    """One thing to search for."""

    name: str
    regex: str
    label: str | None = None
    code: str | None = None
    basis: str | None = None
    pages: tuple[int, ...] = ()
    color: tuple[float, float, float] | None = None
    hint: str | None = None


def entity_patterns(types: list[str] | None = None, codes: dict[str, str] | None = None) -> list[Pattern]:
    """Patterns of entity types (all by default); codes override the default exemption codes, not their basis."""
    types = list(ENTITIES) if types is None else [t.strip().lower() for t in types]
    if unknown := [t for t in types if t not in ENTITIES]:
        raise ValueError(f"unknown entity types: {', '.join(unknown)}")
    return [Pattern(t, java(ENTITIES[t]), LABELS[t], (codes or {}).get(t, EXEMPTIONS[t][0]), EXEMPTIONS[t][1], hint=HINTS.get(t)) for t in types]


def selected_types(text: str | None) -> list[str]:
    """Entity types of a comma-separated list, all of them for none; unknown ones raise."""
    return [p.name for p in entity_patterns(text.split(",") if text else None)]


def default_code(kind: str) -> str:
    """The exemption code of a finding's type; what isn't a privilege marker is personal."""
    return EXEMPTIONS.get(kind, PRIVACY)[0]


def loose_pattern(text: str) -> str | None:
    """What a user types for scanned pages: /pattern/flags, or a literal in either case; None if it is no pattern."""
    m = re.fullmatch(r"/(.+)/([gimsuy]*)", text, re.S)
    found = from_script(m[1], m[2]) if m else "(?i)" + escaped(text)
    try:
        re.compile(re.sub(r"\\z", r"\\Z", found.replace("&&", "")))
    except re.error:
        return None
    return found if text.strip() else None


#: Values of a group of a handoff, patterns of all groups together, and the label of groups without one.
GROUP_VALUES, ALL_VALUES, PLAIN_LABEL = 500, 1000, "REDACTED"


def handed_patterns(handoff: str) -> list[Pattern]:
    """Patterns of a JSON object {"groups": [{"values", "label", "code"}], "strings": [...]}: distinct values that are not blank.

    No more than GROUP_VALUES of a group or list and ALL_VALUES in all are taken, as the interface states.
    """
    given = json.loads(handoff)
    groups = [*given.get("groups", []), {"values": given.get("strings", [])}]
    out = []
    for g in groups:
        values = list(dict.fromkeys(v for v in g.get("values") or [] if isinstance(v, str) and v.strip()))[:GROUP_VALUES]
        label = g.get("label") or g.get("code") or PLAIN_LABEL
        out += [Pattern(v, parse_pattern(v), label, g.get("code")) for v in values]
    return out[:ALL_VALUES]
