"""Operator 4, secret scan: assignment-aware lexing.

The lexer reads assignments of source and configuration syntax (``=``, ``:``, ``:=``, ``=>``;
quoted, bare and concatenated literals; names, quoted keys, members; a declared type between
name and ``=``) out of free text as name-literal pairs, in order; names and literals that stand side by side
(XML elements, arguments, setters, YAML blocks) are pairs too. A right side that names an earlier target is replaced by that
target's literal, so constants propagate. A literal is scored by how sensitive its target's
name is and by how much it looks like key material; the pairs above the threshold are added to
the spans of the base patterns.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame

from .common import map_rows, texts

# --- fixed values: kinds in the contract's order, and its patterns ----------------------------
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")  # 18 characters or more
_HEX = re.compile(r"[0-9a-f]{16,}")  # [0-9a-f]+ of 16 characters or more
# --- fixed values: weights of the parts of a target's name ------------------------------------
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pass": 2.5, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5,
    "credentials": 2.5, "private": 1.5, "auth": 1.5, "authorization": 2.0, "bearer": 2.5, "access": 1.0, "signing": 1.5,
    "encryption": 1.5, "client": 0.5, "api": 1.0, "key": 1.5, "cookie": 1.0, "session": 1.0, "salt": 1.0, "webhook": 1.5,
}
#: Parts that make a name a public or structural one.
HARMLESS = {"public": -3.0, "id": -1.0, "name": -2.0, "url": -2.0, "path": -2.0, "file": -2.0, "length": -3.0, "count": -3.0, "type": -2.0, "primary": -3.0, "foreign": -3.0, "sort": -2.0}
PLACEHOLDERS = {"changeme", "password", "example", "placeholder", "yourpassword", "undefined", "redacted", "secret", "none", "null", "true", "false"}
# -----------------------------------------------------------------------------------------------

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

#: Characters of a propagated literal that are kept, so that ``b = a + a`` cannot grow without end. Longer ones
#: are scored from the counts of all their characters; spans are whole.
LITERAL = 4096
#: Words that are a type where they stand between a name and ``=``.
TYPES = {"string", "str", "text", "char", "byte", "bytes", "rune", "varchar", "any", "auto"}

_OPERATOR = re.compile(r"[:=]")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.$-")
_BARE = re.compile(r"[A-Za-z0-9+/_.=~$-]+")
_QUOTED = {q: re.compile(rf"{q}((?:[^{q}\\\n]|\\.)*){q}") for q in "\"'`"}
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$-]*\Z")
#: After a ``:``, a bare type up to the ``=`` that gives the value.
_TYPED = re.compile(r"""[ \t]*+[&*]?(?:'[a-z]++[ \t]++)?(?:mut[ \t]++)?[A-Za-z_][A-Za-z0-9_.]*+(?:[\[<][^\n=;\[<]{0,64}[\]>]{1,4})?\??(?:[ \t]*+\|[ \t]*+[A-Za-z_]++)*+(?:[ \t]++=(?![=>~])(?=[ \t]*+["'`A-Za-z0-9+/_.~$])|=(?=[ \t]*+["'`]))""")
#: Before a type's name in ``name type =``: the space, and what makes it a list or a pointer.
_BEFORE_TYPE = re.compile(r"[ \t]+(?:\*|\[[0-9]{0,6}\])?\Z")
#: Names and literals that no assignment operator joins: an XML element, a key and a value side by side
#: as arguments or in a list, a setter's argument, and the first line of a YAML block.
_BESIDE = (
    re.compile(r"<(?P<name>[A-Za-z_][A-Za-z0-9_.-]{0,63})(?:[ \t][^<>\n]{0,256})?>[ \t]*(?P<value>[^<>\s][^<>\n]*)</(?P=name)>"),
    re.compile(r"""(?P<q>["'])(?P<name>[A-Za-z_][A-Za-z0-9_.-]{0,63})(?P=q)[ \t]*,[ \t]*(?P<r>["'])(?P<value>(?:(?!(?P=r))[^\\\n]|\\.)*)(?P=r)"""),
    re.compile(r"""\b(?:set|with|add)_?(?P<name>[A-Za-z_][A-Za-z0-9_]{0,63})\([ \t]*(?P<r>["'])(?P<value>(?:(?!(?P=r))[^\\\n]|\\.)*)(?P=r)[ \t]*\)"""),
    re.compile(r"^(?P<pad>[ \t]*)(?P<name>[A-Za-z_][A-Za-z0-9_.-]{0,63}):[ \t]*[|>][-+0-9]{0,2}[ \t]*\n(?P=pad)[ \t]+(?P<value>\S[^\n]*)", re.M),
)
#: What each of them needs in the text.
_BESIDE_SIGNS = (("</",), ('",', "',", '" ,', "' ,"), ("('", '("', "( "), (": |", ":|", ": >", ":>"))
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The whole matches of each kind's pattern, without those too short, by start and kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def name_parts(name: str) -> list[str]:
    """``dbPassword``, ``db_password`` and ``db-password`` are all ``db``, ``password``."""
    return [p.lower() for p in _PART.findall(name)]


def name_score(name: str) -> float:
    parts = name_parts(name)
    return sum(SENSITIVE.get(p, 0.0) + HARMLESS.get(p, 0.0) for p in parts)


def entropy(counts: Counter) -> float:
    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values() if c / n)


def literal_score(value: str, counts: Counter | None = None) -> float:
    """How much a literal looks like key material; placeholders and prose score below 0.

    ``counts``: of all characters of a literal of which ``value`` is only the beginning.
    """
    chars = counts or set(value)
    n = sum(counts.values()) if counts else len(value)
    if n < 8 or value.lower() in PLACEHOLDERS or value[0] in "$<{%" or len(chars) < 5 or any(c.isspace() for c in chars):
        return -5.0
    classes = sum(any(f(c) for c in chars) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(2.0, entropy(counts or Counter(value)) - 2.5) + 0.5 * (classes - 1) + (0.5 if n >= 16 else 0.0) - (1.5 if all(c.isalpha() for c in chars) else 0.0)


def extended(value: str, counts: Counter | None, more: str, more_counts: Counter | None) -> tuple[str, Counter | None]:
    """A literal with another one behind it: its beginning, and the counts of all its characters if that is not all."""
    whole = value + more
    if not counts and not more_counts and len(whole) <= LITERAL:
        return whole, None
    total = Counter(counts or value)
    total.update(more_counts or more)
    return (value if counts else whole[:LITERAL]), total


def pairs(text: str):
    """(name, literal, begin of the name, end of the right side, sources, counts) of each assignment, constants propagated.

    A propagated pair carries the literal that its right side names; its sources are the spans of
    the assignments that it names. Of a literal of more than LITERAL characters there is the
    beginning, and the counts of all its characters; they are None for others.
    """
    constants: dict[str, tuple[str, Counter | None, tuple[int, int]]] = {}
    done = 0
    for m in _OPERATOR.finditer(text):
        p = m.start()
        if p < done:
            continue
        q = p + 1
        if text[q : q + 1] == "=" and text[p] == ":":
            q += 1  # :=
        elif text[q : q + 1] in ("=", ":") or (text[p] == "=" and text[p - 1 : p] in ("!", "<", ">", "=", "~") and p):
            done = q + 1
            continue  # a comparison, or ::
        elif text[p] == "=" and text[q : q + 1] == ">":
            q += 1  # =>
        elif text[q : q + 2] == "//":
            continue  # a url's scheme
        # the target, to the left
        b = p
        while b > done and text[b - 1] in " \t":
            b -= 1
        quote = b > done and text[b - 1] in "\"'`"
        e = b = b - 1 if quote else b
        while b > done and text[b - 1] in _NAME_CHARS:
            b -= 1
        name = text[b:e].strip(".-")
        if name in TYPES and text[p] == "=" and not quote and (m := _BEFORE_TYPE.search(text, max(done, b - 32), b)):
            # name type =
            at = e = m.start()
            while at > done and text[at - 1] in _NAME_CHARS:
                at -= 1
            if _NAME.match(text[at:e].strip(".-")):
                name, b = text[at:e].strip(".-"), at
        if not name or not _NAME.match(name):
            continue
        if text[p] == ":" and q == p + 1 and (m := _TYPED.match(text, q)):
            q = m.end()  # name: type =
        # the right side: terms joined by + or . or side by side
        value, counts, at, ref, sources = "", None, q, False, []
        end = q
        while True:
            while at < len(text) and text[at] in " \t":
                at += 1
            lit = _QUOTED[text[at]].match(text, at) if at < len(text) and text[at] in _QUOTED else None
            if lit:
                value, counts = extended(value, counts, lit[1], None)
                at = end = lit.end()
            else:
                bare = _BARE.match(text, at)
                if not bare or (value and not ref and not text[end:at].strip(" \t")):
                    break
                word = bare[0]
                if word in constants:
                    known, known_counts, place = constants[word]
                    (value, counts), ref = extended(value, counts, known, known_counts), True
                    sources.append(place)
                elif not value:
                    value, counts = extended("", None, word.rstrip("."), None)
                else:
                    break
                at = end = bare.end() - (len(word) - len(word.rstrip(".")) if word not in constants else 0)
            after = at
            while after < len(text) and text[after] in " \t":
                after += 1
            if text[after : after + 1] == "+":
                at = after + 1
                continue
            if text[after : after + 1] in _QUOTED and lit:
                at = after
                continue
            break
        if not value:
            continue
        constants[name] = value, counts, (b, end)
        done = end
        yield name, value, b, end, sources, counts


def beside(text: str):
    """(name, literal, begin, end) of names and literals that stand side by side (see _BESIDE)."""
    for pattern, signs in zip(_BESIDE, _BESIDE_SIGNS, strict=True):
        if any(s in text for s in signs):
            for m in pattern.finditer(text):
                yield m["name"], m["value"].rstrip(), m.start("name"), m.start("value") + len(m["value"].rstrip())


def added_spans(text: str, base: list[tuple[int, int, str]], threshold: float) -> list[tuple[int, int, str]]:
    """Pairs whose score reaches the threshold, and the assignments their literals come from, as ``assign`` spans.

    Spans that overlap a base span are left out.
    """
    order = sorted(base)
    starts = [x[0] for x in order]
    furthest = list(accumulate((x[1] for x in order), max))

    def free(begin: int, end: int) -> bool:
        k = bisect_left(starts, end)  # those before k begin before the span ends
        return not k or furthest[k - 1] <= begin

    named: dict[tuple[int, int], list[tuple[int, int]]] = {}  # of each assignment, those it names
    seen: set[tuple[int, int]] = set()
    for name, value, begin, end in beside(text):
        sensitive, look = name_score(name), literal_score(value)
        if sensitive >= 1.0 and look > 0 and sensitive + look >= threshold:
            seen.add((begin, end))
    for name, value, begin, end, sources, counts in pairs(text):
        if sources:
            named[begin, end] = sources
        sensitive = name_score(name)
        if sensitive < 1.0:
            continue
        look = literal_score(value, counts)
        if look > 0 and sensitive + look >= threshold:
            walk = [(begin, end)]
            while walk:
                span = walk.pop()
                if span not in seen:
                    seen.add(span)
                    walk += named.get(span, ())
    return [(*span, "assign") for span in sorted(seen) if free(*span)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for begin, end, kind in spans)


def find_secrets(docs: DataFrame, *, threshold: float = 4.0) -> DataFrame:
    """Secrets in each row of (doc_id, text).

    Returns doc_id, the three base counts, base_sha256 and spans (``kind:start:end`` in code
    points, end exclusive; an added span runs from the target's name to the end of its right
    side). ``threshold`` is the least sum of the name's and the literal's scores.

    Null and empty texts have no spans and the digest of the empty string. Rows are judged one
    by one: repeated rows repeat, null doc_ids stay null, other columns are ignored, an empty
    table gives an empty result. Base spans that overlap each other are all kept; added spans
    overlap no base span. One pass, no shuffle.
    """

    def make():
        def f(b):
            rows = []
            for t in texts(b):
                base = base_spans(t)
                more = added_spans(t, base, threshold)
                rows.append((base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base))
            counts = {f"n_{k}": [sum(s[2] == k for s in base) for base, _ in rows] for k in KINDS}
            return {"doc_id": b.column("doc_id"), **counts, "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], "spans": [joined(every) for _, every in rows]}

        return f

    return map_rows(docs, make, SCHEMA, ["doc_id", "text"])
