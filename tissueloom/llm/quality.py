"""Operator 6, quality rules: tokeniser fertility beside counts of words, symbols and repeats.

Each text is encoded with a byte-level BPE vocabulary and a BPE vocabulary with byte fallback.
Characters per token and token entropy come from the first, the byte-fallback share from the
second. A text is rejected outside one of its script's bands, which hold everywhere, or outside
one of the bands of its language and length, which are fitted on the whole corpus: of the texts
that pass the base rules, a median and a few robust deviations from it.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field, map_rows, staged, texts

# --- fixed values: the contract ---------------------------------------------------------------
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
# --- fixed values: bands by script: least and most characters per token, most byte-fallback
# share, least bits of token entropy in texts of MIN_TOKENS tokens or more, and of LONG or more ---
BANDS = {
    "LATIN": (1.4, 12.0, 0.10, 3.0, 5.2),
    "GREEK": (0.4, 6.0, 0.10, 3.0, 4.5),
    "CYRILLIC": (0.4, 6.0, 0.10, 3.0, 4.5),
    "ARABIC": (0.3, 5.0, 0.30, 3.0, 4.5),
    "HEBREW": (0.3, 5.0, 0.30, 3.0, 4.5),
    "DEVANAGARI": (0.2, 4.0, 0.50, 3.0, 4.0),
    "HANGUL": (0.2, 4.0, 0.60, 3.0, 4.5),
    "HIRAGANA": (0.2, 4.0, 0.50, 3.0, 4.5),
    "CJK": (0.2, 4.0, 0.60, 3.0, 5.0),
    "OTHER": (0.2, 12.0, 0.90, 2.0, 3.0),
}
MIN_TOKENS, LONG = 50, 200
# --- fixed values: fitted bands: deviations from the median, least deviation, fewest texts of a
# group, values a unit in the counts that they are fitted on, most doublings of a text's tokens ---
DEVIATIONS, LEAST_DEVIATION, FEWEST, FINE, DOUBLINGS = 3.0, 0.01, 50, 200, 13
#: Measures with a fitted band, and whether it has a lower and an upper end.
FITTED = (("chars_per_token", True, True), ("fallback_share", False, True), ("token_entropy", True, False))
# -----------------------------------------------------------------------------------------------

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "script string, n_tokens long, chars_per_token double, fallback_share double, token_entropy double"
)
_SYMBOL = re.compile("[" + re.escape(SYMBOLS) + "]+")


def words_of(text: str) -> list[bytes]:
    """The UTF-8 words: bytes.split cuts at space and \\x09-\\x0D, and nothing else."""
    return text.encode("utf-8", "surrogatepass").split()


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # windows as exact numbers: two at a time, each pair renumbered densely
    code, size = ids[:n], len(number)
    for k in range(1, window):
        code = code * size + ids[k : k + n]  # below len(words) ** 2
        if k < window - 1:
            code = np.unique(code, return_inverse=True)[1]
    _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
    hit = count[inverse] > 1
    if not hit.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += hit
    edge[window : window + n] -= hit
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    r"""``\n``-split lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x and WORD.search(x)]
    return len(lines) - len(set(lines))


@lru_cache(1 << 16)
def script_of(ch: str) -> str:
    name = unicodedata.name(ch, "").split(" ")[0]
    return "HIRAGANA" if name == "KATAKANA" else name if name in BANDS else "OTHER"


_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")
_OTHER_LETTER = re.compile("[^\\W\\d_A-Za-zÀ-ÖØ-öø-ɏ]")


def main_script(text: str) -> str:
    """The script of most letters (ties: the first by name); OTHER without letters."""
    others = _OTHER_LETTER.findall(text)
    if not others:
        return "LATIN" if _LATIN.search(text) else "OTHER"
    count = {"LATIN": len(_LATIN.findall(text))}
    for ch in others:
        s = script_of(ch)
        count[s] = count.get(s, 0) + 1
    return max(sorted(count), key=count.get)


class Fertility:
    """The two public vocabularies, loaded once a worker process (see fertility_of)."""

    def __init__(self, ranks_path: str, piece_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("fertility", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.is_byte = [self.pieces.IsByte(i) or self.pieces.IsUnknown(i) for i in range(self.pieces.GetPieceSize())]
        self.known: dict[bytes, int] = {}
        self.plain: dict[str, bool] = {}

    def covered(self, text: str) -> bool:
        """Whether no character of the text can become byte pieces: each is a piece, and combines with no other."""
        plain = self.plain
        chars = set(text)
        for ch in chars.difference(plain):
            alone = unicodedata.normalize("NFKC", ch) == ch and not unicodedata.combining(ch) and not "\u1100" <= ch <= "\u11ff"
            plain[ch] = ch in " \t\n\r\x0b\x0c" or (alone and not any(map(self.is_byte.__getitem__, self.pieces.encode(ch))))
        return all(map(plain.__getitem__, chars))

    def fallback(self, words: list[bytes]) -> float:
        """Share of byte pieces among the pieces of the words, each encoded by itself (and remembered)."""
        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) > 400_000:
                known.clear()
                new = set(words)
            new, is_byte = list(new), self.is_byte.__getitem__
            for w, ids in zip(new, self.pieces.encode([w.decode("utf-8", "replace") for w in new], num_threads=1), strict=True):
                known[w] = len(ids) + (sum(map(is_byte, ids)) << 32)  # both counts in one number
        bad, total = divmod(sum(map(known.__getitem__, words)), 1 << 32)
        return bad / total if total else 0.0

    def measure(self, text: str, words: list[bytes]) -> tuple[int, float, float, float]:
        """Tokens, characters per token, byte-fallback share, token entropy in bits."""
        if not text:
            return 0, 0.0, 0.0, 0.0
        clean = text.encode("utf-8", "replace").decode() if any_surrogate(text) else text
        ids = np.asarray(self.bpe.encode_ordinary(clean))
        share = np.unique(ids, return_counts=True)[1] / len(ids)
        fallback = 0.0 if self.covered(clean) else self.fallback(words)
        return len(ids), round(len(text) / len(ids), 6), round(fallback, 6), round(float(-(share * np.log2(share)).sum()) + 0.0, 6)


@lru_cache(2)
def fertility_of(vocabularies: tuple[str, str, str]) -> Fertility:
    return Fertility(*vocabularies)


def any_surrogate(text: str) -> bool:
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        return True
    return False


def accepted(script: str, n_tokens: int, per_token: float, fallback: float, entropy: float, bands=BANDS) -> bool:
    """Whether a text lies in its script's bands; the entropy of one of under MIN_TOKENS tokens is not judged."""
    low, high, most, bits, long_bits = bands[script]
    return low <= per_token <= high and fallback <= most and (n_tokens < MIN_TOKENS or entropy >= (long_bits if n_tokens >= LONG else bits))


def group_of(columns: list[str]) -> tuple[Column, Column]:
    """A text's language (its script, where it has none) and the doublings of its tokens."""
    language = F.coalesce("lang", "script") if "lang" in columns else F.col("script")
    return language.alias("g"), F.least(F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))), F.lit(DOUBLINGS)).cast("int").alias("size")


def fitted_bands(measured: DataFrame) -> list[tuple]:
    """(group, size, low and high of each of FITTED) of groups of FEWEST texts or more.

    Fitted on counts of rounded values, so that the result does not depend on partitions; what
    reaches the driver grows with groups and not with texts.
    """
    values = F.array(*(F.struct(F.lit(k).alias("m"), F.round(F.col(name) * FINE).cast("int").alias("v")) for k, (name, _, _) in enumerate(FITTED)))
    counts = measured.where("not base_failed").select(*group_of(measured.columns), F.explode(values).alias("x")).groupBy("g", "size", "x.m", "x.v").agg(F.count("*").alias("n"))
    of: dict[tuple, dict[int, list]] = {}
    for r in counts.orderBy("g", "size", "m", "v").collect():
        of.setdefault((r["g"], r["size"]), {}).setdefault(r["m"], []).append((r["v"], r["n"]))
    out = []
    for group, measures in of.items():
        if sum(n for _, n in measures[0]) < FEWEST:
            continue
        ends = []
        for k, (_, lower, upper) in enumerate(FITTED):
            v, n = np.array(measures[k]).T
            first, median, third = (v[np.searchsorted(np.cumsum(n), q * n.sum())] / FINE for q in (0.25, 0.5, 0.75))
            reach = DEVIATIONS * max((third - first) / 1.349, LEAST_DEVIATION)
            ends += [float(median - reach) if lower else None, float(median + reach) if upper else None]
        out.append((*group, *ends))
    return out


def with_verdict(measured: DataFrame) -> DataFrame:
    """``measured`` with ``kept`` false where a fitted band is left."""
    names = [f"_{end}{k}" for k in range(len(FITTED)) for end in ("low", "high")]
    bands = measured.sparkSession.createDataFrame(fitted_bands(measured), "g string, size int, " + ", ".join(f"{x} double" for x in names))
    g, size = group_of(measured.columns)
    joined = measured.withColumns({"_g": g, "_size": size}).join(F.broadcast(bands), (F.col("_g") == F.col("g")) & (F.col("_size") == F.col("size")), "left")
    inside = F.col("kept")
    for k, (name, _, _) in enumerate(FITTED):
        inside &= F.coalesce(F.col(name) >= F.col(f"_low{k}"), F.lit(True)) & F.coalesce(F.col(name) <= F.col(f"_high{k}"), F.lit(True))
    return joined.withColumn("kept", inside).select(*measured.columns)


def default_vocabularies() -> tuple[str, str, str]:
    """Paths of the two vocabularies, and the first one's pattern."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.path("piece_bpe_32k.model"), public.PATTERN


class Judge:
    """Counts, fertility and verdict of one text: the columns of SCHEMA after doc_id."""

    def __init__(self, vocabularies: tuple[str, str, str], bands=BANDS):
        self.fertility, self.bands = fertility_of(tuple(vocabularies)), bands

    def __call__(self, text: str) -> tuple:
        words = words_of(text)
        n = len(words)
        chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
        symbols = sum(map(len, _SYMBOL.findall(text)))
        repeated = repeated_words(words)
        failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
        script = main_script(text)
        measured = self.fertility.measure(text, words)
        return n, chars, symbols, duplicate_lines(text), repeated, failed, not failed and accepted(script, *measured, self.bands), script, *measured


def judge_quality(docs: DataFrame, vocabularies: tuple[str, str, str] | None = None, bands=BANDS) -> DataFrame:
    """Quality counts, fertility and verdict of each row of (doc_id, text).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, and the fertility measures. ``vocabularies``: paths of a rank file and of a piece
    model, which must hold on every executor, and the rank file's pattern.

    Null and empty texts have no words and fail (fewer than 10 words). Measures are each row's
    own, bands are fitted on all rows by ``lang``, where there is such a column, and length:
    repeated rows repeat, null doc_ids stay null, other columns are ignored, an empty table gives
    an empty result. One pass over the texts, whose measures are stored.
    """
    vocabularies = vocabularies or default_vocabularies()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    lang = ["lang"] if "lang" in docs.columns else []

    def make():
        judge = Judge(vocabularies, bands)

        def f(b):
            rows = [judge(t) for t in texts(b)]
            cols = zip(*rows, strict=True) if rows else [()] * len(names[1:])
            return {x: b.column(x) for x in ["doc_id", *lang]} | dict(zip(names[1:], cols, strict=True))

        return f

    measured = map_rows(docs, make, SCHEMA + ", lang string" * len(lang), ["doc_id", "text", *lang])
    return with_verdict(staged(measured, "quality-measures")).select(*names)


def keep_good(docs: DataFrame, vocabularies: tuple[str, str, str] | None = None, bands=BANDS) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns; cases as in judge_quality.

    A verdict follows from text and language alone, so that rows are matched to verdicts by a
    128-bit digest of both, whatever their doc_ids. Only measures and digests are stored; the rows
    meet the rejected digests in a second scan, which are broadcast where they are few.
    """
    vocabularies = vocabularies or default_vocabularies()
    names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
    needed = ["base_failed", "kept", "script", "n_tokens", *(name for name, _, _ in FITTED)]
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    lang = ["lang"] if "lang" in docs.columns else []

    def make():
        judge = Judge(vocabularies, bands)

        def f(b):
            rows = [judge(t) for t in texts(b)]
            return {x: b.column(x) for x in [name, *lang]} | {x: [r[names.index(x)] for r in rows] for x in needed}

        return f

    name = "_digest"
    while name in docs.columns:
        name += "_"
    marked = docs.withColumn(name, digest(docs))
    schema = ", ".join([f"{name} string", *(f"{x} {kinds[x]}" for x in needed), *("lang string" for _ in lang)])
    measured = staged(map_rows(marked, make, schema, [name, "text", *lang]), "quality-measures")
    rejected = staged(with_verdict(measured).where("not kept").select(name).distinct(), "quality-rejected")
    return marked.join(rejected, name, "left_anti").select(*(F.col(field(c)) for c in docs.columns))


def digest(docs: DataFrame) -> Column:
    """128 bits of a row's text and, where there is one, language; a null text counts as empty."""
    lang = F.coalesce(F.hex(F.col("lang").cast("string")), F.lit("-")) if "lang" in docs.columns else F.lit("-")
    return F.md5(F.concat(lang, F.lit(":"), F.coalesce("text", F.lit(""))))
