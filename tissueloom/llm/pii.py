"""Operator 2, personal data: a semi-Markov conditional random field over candidate segments.

A text is cut into islands: runs of tokens around digits, ``@`` signs and their spelled forms
(``(at)``, ``[at]``, ``at ... dot``), outside of which no entity is looked for. In each island every run of up to ``max_tokens`` tokens that could be an entity
is a candidate segment, scored by features of the whole span (length, digit count, checksum,
separators, shape, the words before it). Bounded-entity dynamic programming then chooses
boundaries and types of all segments of an island jointly. The spans of the base patterns are
held fixed in it: no other segment may overlap them.

The weights are fitted here, by gradient ascent on the conditional likelihood of a bounded,
seeded set of generated lines.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, map_whole, texts, with_column

# --- fixed values: kinds in the contract's order, and its patterns ---------------------------
KINDS = ("email", "ip", "card", "phone")
# email: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
# ip:    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
# card:  [0-9]([\x20-]?[0-9])+, 14 to 19 digits passing Luhn
# phone: \+[0-9][\x20().0-9-]+[0-9], 10 to 15 digits
# ----------------------------------------------------------------------------------------------
# The same languages without backtracking: a match can only begin where a run of digits does.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What stands for the ``@`` of a spelled address: bracketed, or a bare word that a ``dot`` follows.
_SPELLED = r"[\[(][Aa][Tt][\])]|(?<= )[Aa][Tt](?= [A-Za-z0-9-]{1,63} ?(?:[\[(][Dd][Oo][Tt][\])]|(?<= )[Dd][Oo][Tt] ))"
_MARK = re.compile(_SPELLED)
_TRIGGER = re.compile(rf"[0-9@]|{_SPELLED}")

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each kind, without those that fail its test, by start and kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end(), "email"))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # a part that needs more than three digits without leading zeros is over 255
            if all(len(p) <= 3 and int(p) <= 255 if len(p) <= 3 else len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m.groups()):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# ---- islands and candidates -------------------------------------------------------------------
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
#: What may stand between the parts of one entity.
_INSIDE = frozenset(" ().-@_%+:[]/")


class Island:
    """Tokens [(begin, end)] of one island, with the word before it."""

    __slots__ = ("text", "tokens", "before")

    def __init__(self, text: str, tokens: list[tuple[int, int]], before: str):
        self.text, self.tokens, self.before = text, tokens, before


def islands(text: str, reach: int = 48):
    """Maximal runs of characters at most ``reach`` from a trigger, cut at line ends.

    ``reach`` exceeds the part of any candidate on one side of a trigger that has no trigger itself.
    """
    runs: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = hi
        else:
            runs.append([lo, hi])
    for lo, hi in runs:
        while lo > 0 and text[lo - 1].isalnum() and text[lo].isalnum():
            lo -= 1
        while hi < len(text) and text[hi - 1].isalnum() and text[hi].isalnum():
            hi += 1
        begin = lo
        for line in text[lo:hi].split("\n"):
            tokens = [(begin + m.start(), begin + m.end()) for m in _TOKEN.finditer(line)]
            if tokens and _TRIGGER.search(line):
                words = text[max(0, begin - 24) : begin].split()
                yield Island(text, tokens, words[-1] if words else "")
            begin += len(line) + 1


# ---- whole-span features ------------------------------------------------------------------------
_EMAIL_SHAPE = re.compile(r"[a-z0-9._%+-]+ ?(?:@|\[at\]|\(at\)|(?<= )at(?= )) ?[a-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)|(?<= )dot(?= )) ?[a-z0-9-]+)+\Z", re.I | re.A)
_IP_SHAPE = re.compile(r"\d{1,3}(?: ?\. ?\d{1,3}| ?\[\.\] ?\d{1,3}){3}\Z")
_PHONE_SHAPE = re.compile(r"(?:\+|00)?\(?\d{1,4}\)?(?:[ ./-]{0,2}\(?\d{2,4}\)?){1,5}\Z")
_CARD_SHAPE = re.compile(r"\d{4}(?:[ .-]?\d{4}){3}\Z|\d{4}[ .-]?\d{6}[ .-]?\d{4,5}\Z|\d{14,19}\Z")
_CUES = {
    "phone": {"tel", "phone", "call", "fax", "mobile", "cell", "telefon", "telefono", "ring"},
    "card": {"card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "cc"},
    "ip": {"ip", "host", "addr", "address", "server", "from"},
    "email": {"mail", "email", "contact", "write", "courriel"},
}
FEATURES = ("bias", "shape", "luhn", "digits_fit", "octets", "plus", "grouped", "cue", "edge_alnum", "edge_joined", "plain_digits", "odd_chars", "obfuscated", "one_token", "decimal")


def features(text: str, begin: int, end: int, kind: str, before: str) -> np.ndarray:
    """Features of the whole segment as a ``kind``; all in 0..1."""
    s = text[begin:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    n = len(digits)
    prev, nxt = text[begin - 1 : begin], text[end : end + 1]
    f = np.zeros(len(FEATURES))
    f[0] = 1
    if kind == "email":
        f[1] = bool(_EMAIL_SHAPE.match(s))
        low = s.lower()
        f[12] = "(at)" in low or "[at]" in low or "[dot]" in low or "(dot)" in low or " " in s
    elif kind == "ip":
        f[1] = bool(_IP_SHAPE.match(s))
        parts = [p for p in re.split(r"[^0-9]+", s) if p]
        f[4] = len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
        f[3] = 4 <= n <= 12
        f[12] = "[" in s
    elif kind == "card":
        f[1] = bool(_CARD_SHAPE.match(s))
        f[3] = 14 <= n <= 19
        f[2] = f[3] and luhn(digits)
        f[6] = len(s) > n
    else:
        f[1] = bool(_PHONE_SHAPE.match(s))
        f[3] = 10 <= n <= 15
        f[5] = s[:1] == "+" or s[:2] == "00"
        f[6] = "(" in s or s.count("-") + s.count(" ") >= 2
        f[14] = s.count(".") == 1 and " " not in s and "-" not in s
    f[7] = before.strip(":;,.()[]").lower() in _CUES[kind]
    f[8] = prev.isalnum() or nxt.isalnum()
    f[9] = bool(prev and prev in ".-_@/+") or (bool(nxt) and nxt in "-_@/") or (nxt == "." and text[end + 1 : end + 2].isalnum())
    f[10] = n == end - begin
    f[11] = any(c not in "+-.() 0123456789" for c in s) and kind != "email" and not f[12]
    f[13] = s.isalnum()
    return f


def candidates(isl: Island, max_tokens: int) -> list[tuple[int, int, str, str]]:
    """Segments [i, j) of tokens, with a type, that could be entities; the word before each."""
    out, text, tokens = [], isl.text, isl.tokens
    before = isl.before
    for i, (b, e) in enumerate(tokens):
        first = text[b]
        opens = first.isascii() and (first.isalnum() or first in "+(._%-")
        if not opens:
            if not first.isspace():
                before = ""
            continue
        n_digits = 0
        at = False
        for j in range(i, min(len(tokens), i + max_tokens)):
            tb, te = tokens[j]
            c = text[tb]
            if "0" <= c <= "9":
                n_digits += te - tb
            elif c == "@" or text[tb:te].lower() == "at":
                at = True
            elif not (c.isascii() and (c.isalpha() or c in _INSIDE)):
                break
            if c.isspace() and text[tokens[j - 1][0]].isalpha() and not at and n_digits == 0 and not _MARK.match(text, te):
                break  # two plain words: prose
            last = text[te - 1]
            if not (last.isascii() and last.isalnum()) and last != ")":
                continue
            if at and 4 <= j - i:
                s = text[b:te]
                if "@" in s or _MARK.search(s):
                    out.append((i, j + 1, "email", before))
            if not first.isalpha() and n_digits and not at:
                if 4 <= n_digits <= 12 and j - i >= 6:
                    out.append((i, j + 1, "ip", before))
                if 14 <= n_digits <= 19:
                    out.append((i, j + 1, "card", before))
                if 10 <= n_digits <= 15:
                    out.append((i, j + 1, "phone", before))
            if n_digits > 19 and not at:
                break
        if first.isalpha():
            before = text[b:e]
    return out


# ---- the semi-Markov field ----------------------------------------------------------------------
def viterbi(n: int, segments: list[tuple[int, int, float, int]]) -> list[int]:
    """Of scored segments [i, j) over n tokens, the disjoint ones with the largest sum; a token outside scores 0.

    ``segments``: (i, j, score, key); returns keys in order. Ties prefer fewer segments.
    """
    ends: dict[int, list[tuple[int, float, int]]] = {}
    for i, j, score, key in segments:
        ends.setdefault(j, []).append((i, score, key))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j], back[j] = best[j - 1], (j - 1, None)
        for i, score, key in ends.get(j, ()):
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, (i, key)
    out, j = [], n
    while j:
        j, key = back[j]
        if key is not None:
            out.append(key)
    return out[::-1]


def expectations(n: int, segments: list[tuple[int, int, float]]) -> tuple[float, np.ndarray]:
    """Log partition function, and each segment's marginal probability (forward-backward)."""
    ends: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    for k, (i, j, _) in enumerate(segments):
        ends.setdefault(j, []).append(k)
        starts.setdefault(i, []).append(k)
    fwd, bwd = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        fwd[j] = np.logaddexp.reduce([fwd[j - 1], *(fwd[segments[k][0]] + segments[k][2] for k in ends.get(j, ()))])
    for i in range(n - 1, -1, -1):
        bwd[i] = np.logaddexp.reduce([bwd[i + 1], *(bwd[segments[k][1]] + segments[k][2] for k in starts.get(i, ()))])
    p = np.array([math.exp(fwd[i] + s + bwd[j] - fwd[n]) for i, j, s in segments])
    return float(fwd[n]), p


def training_lines(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` generated lines with the entities in them: real ones, and look-alikes left unlabelled."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        body = rng.choice("3456") + num(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def entity(kind):
        if kind == "email":
            local, at = rng.choice([word(), f"{word()}.{word()}", num(2)]), rng.choice(["@"] * 5 + [" [at] ", " (at) ", " at "])
            dot = "." if at == "@" else " dot " if at == " at " else rng.choice([".", at.replace("at", "dot")])
            return f"{local}{at}{word()}{num(1) if at == '@' else num(rng.randint(0, 1))}{dot}{word()}{dot}com"
        if kind == "ip":
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            c = card()
            sep = rng.choice(["", " ", "-"])
            return sep.join(c[k : k + 4] for k in range(0, 16, 4))
        return rng.choice([f"+{rng.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(4)}", f"{num(3)}-{num(3)}-{num(4)}"])

    def decoy():
        c = card()
        return rng.choice([num(rng.randint(1, 6)), f"{num(2)}.{num(2)}", num(rng.choice([10, 12, 16])), c[:-1] + str((int(c[-1]) + 1) % 10), f"{num(4)}-{num(2)}-{num(2)}", f"{rng.randint(1, 9)}.{num(1)}.{num(1)}", ".".join(str(rng.randint(256, 999)) for _ in range(4)), f"{num(8)}{word()}{num(6)}", f"{num(3)},{num(3)},{num(3)}", f"{num(3)}-{num(2)}-{num(4)}", f"{word()} (at) {word()}", f"{word()} at {word()}"])

    out = []
    for _ in range(n):
        parts: list[tuple[str, str | None]] = []
        for _ in range(rng.randint(1, 3)):
            parts += [(word(), None) for _ in range(rng.randint(1, 4))]
            kind = rng.choice((*KINDS, None, None))
            if kind and rng.random() < 0.3:
                parts.append((rng.choice(sorted(_CUES[kind])), None))
            parts.append((entity(kind), kind) if kind else (decoy(), None))
            if kind == "card" and rng.random() < 0.3:
                parts.append(parts[-1])
        parts.append((word() + rng.choice(["", ".", "###", "%%%"]), None))
        line, spans = "", []
        for s, kind in parts:
            line += " " * bool(line)
            if kind:
                spans.append((len(line), len(line) + len(s), kind))
            line += s
        out.append((line, spans))
    return out


@functools.lru_cache(4)
def fitted_weights(n_lines: int, seed: int, steps: int, max_tokens: int) -> dict[str, tuple[float, ...]]:
    """Weights by kind, from at most ``n_lines`` labelled lines (the bound on what the fit sees)."""
    cases = []
    for line, spans in training_lines(n_lines, seed):
        gold = set(spans)
        for isl in islands(line):
            segs = candidates(isl, max_tokens)
            if segs:
                x = np.array([features(line, isl.tokens[i][0], isl.tokens[j - 1][1], kind, before) for i, j, kind, before in segs])
                y = np.array([(isl.tokens[i][0], isl.tokens[j - 1][1], kind) in gold for i, j, kind, _ in segs], float)
                cases.append((len(isl.tokens), [(i, j) for i, j, _, _ in segs], np.array([KINDS.index(k) for _, _, k, _ in segs]), x, y))
    w = np.zeros((len(KINDS), len(FEATURES)))
    w[:, 0] = -1
    grad_sq = np.full_like(w, 1e-6)
    for _ in range(steps):
        grad = -0.02 * w
        for n, at, kind, x, y in cases:
            score = (x * w[kind]).sum(1)
            _, p = expectations(n, [(i, j, s) for (i, j), s in zip(at, score, strict=True)])
            np.add.at(grad, kind, (y - p)[:, None] * x)
        grad_sq += grad**2
        w += 0.8 * grad / np.sqrt(grad_sq)
    return {k: tuple(w[i].round(6).tolist()) for i, k in enumerate(KINDS)}


#: What holds a base span fixed in the chart.
CLAMP = 1e6


class Field:
    """Decoder of one text with fitted weights."""

    def __init__(self, weights: dict[str, tuple[float, ...]], max_tokens: int, margin: float):
        self.weights = {k: np.array(v) for k, v in weights.items()}
        self.max_tokens, self.margin = max_tokens, margin

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """The base spans, and all spans, each by start and kind."""
        if not _TRIGGER.search(text):
            return [], []
        base = base_spans(text)
        fixed = set(base)
        found = set()
        order, at = sorted(base), 0
        for isl in islands(text):
            tokens = isl.tokens
            begins = {b: i for i, (b, _) in enumerate(tokens)}
            ends = {e: i + 1 for i, (_, e) in enumerate(tokens)}
            lo, hi = tokens[0][0], tokens[-1][1]
            while at < len(order) and order[at][0] < lo:
                at += 1
            here, covered = [], np.zeros(hi - lo + 1, np.int64)
            for k in range(max(0, at - len(KINDS)), len(order)):
                if order[k][0] >= hi:
                    break
                if order[k][1] > lo:
                    here.append(order[k])
                    covered[max(0, order[k][0] - lo) + 1 : order[k][1] - lo + 1] = 1
            covered = np.cumsum(covered).tolist()
            segments, keys = [], []
            for i, j, kind, before in candidates(isl, self.max_tokens):
                span = (tokens[i][0], tokens[j - 1][1], kind)
                if covered[span[1] - lo] > covered[span[0] - lo]:
                    continue  # a base span, or one that would cut into it
                score = float(self.weights[kind] @ features(text, span[0], span[1], kind, before)) - self.margin
                if score > 0:
                    segments.append((i, j, score, len(keys)))
                    keys.append(span)
            for span in here:
                if span[0] in begins and span[1] in ends:
                    segments.append((begins[span[0]], ends[span[1]], CLAMP, len(keys)))
                    keys.append(span)
            found.update(keys[k] for k in viterbi(len(tokens), segments))
        both = fixed | found
        return base, sorted(both, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for begin, end, kind in spans)


def find_pii(docs: DataFrame, *, n_lines: int = 400, seed: int = 7, steps: int = 40, max_tokens: int = 24, margin: float = 1.0) -> DataFrame:
    """Personal data in each row of (doc_id, text).

    Returns doc_id, the four base counts, base_sha256 and spans (``kind:start:end`` in code
    points, end exclusive). ``n_lines`` bounds the labelled lines that the weights are fitted
    on; ``margin`` is the log-odds by which a segment must beat plain text.

    Null and empty texts have no spans and the digest of the empty string. Rows are judged one
    by one: repeated rows repeat, null doc_ids stay null, other columns are ignored, an empty
    table gives an empty result. Base spans that overlap each other are all kept; added spans
    overlap nothing. One pass, no shuffle.
    """
    weights = fitted_weights(n_lines, seed, steps, max_tokens)

    def make():
        spans_of = Field(weights, max_tokens, margin).spans

        def f(b):
            rows = [spans_of(t) for t in texts(b)]
            counts = {f"n_{k}": [sum(s[2] == k for s in base) for base, _ in rows] for k in KINDS}
            return {"doc_id": b.column("doc_id"), **counts, "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], "spans": [joined(every) for _, every in rows]}

        return f

    return map_rows(docs, make, SCHEMA, ["doc_id", "text"])


def redact(text: str | None, spans: str | None) -> str | None:
    """The text with each span (or run of overlapping spans) replaced by ``<KIND>``."""
    if not text or not spans:
        return text
    merged: list[list] = []
    for s in spans.split(","):
        kind, begin, end = s.split(":")
        if merged and int(begin) < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], int(end))
        else:
            merged.append([int(begin), int(end), kind])
    out, at = [], 0
    for begin, end, kind in merged:
        out += [text[at:begin], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, *, n_lines: int = 400, seed: int = 7, steps: int = 40, max_tokens: int = 24, margin: float = 1.0) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind; cases as in find_pii.

    ``n_chars``, where there is such a column, follows the text; null texts stay null.
    """
    weights = fitted_weights(n_lines, seed, steps, max_tokens)
    counts = "n_chars" in docs.columns

    def make():
        spans_of = Field(weights, max_tokens, margin).spans

        def f(b):
            new = [t and redact(t, joined(spans_of(t)[1])) for t in b.column("text").to_pylist()]
            b = with_column(b, "text", new)
            return with_column(b, "n_chars", [t if t is None else len(t) for t in new]) if counts else b

        return f

    return map_whole(docs, make)
