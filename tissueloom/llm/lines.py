"""Operator 5, substring dedup by line hashing.

Lines are cut into sentences; the unit is the shortest run of sentences, from or up to each one,
that has enough words, whatever line breaks lie in it. A long line, a paragraph of short lines and
a passage set into the middle of a line all are made of such runs. Each unit is normalised and
hashed with its offsets. Digests meet globally: the earliest occurrence by (doc_id, offset)
stays, every other one is removed. Offsets are those of the original text.
"""

from __future__ import annotations

import re
import struct

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, staged, texts

#: Least words of a unit: shorter passages (headings, licence and sign-off lines) recur in
#: unrelated documents by right. It counts over line breaks.
MIN_WORDS = 16

UNITS = "hi long, lo long, doc_id long, begin int, stop int"
RESULT = "doc_id long, n_removed long, removed_chars long, kept_chars long, spans string, text string"

#: Between two sentences: a line break, or white space behind a full stop (and closing quotes).
_BREAK = re.compile(r"\n|(?<=[.!?。！？])[ \t\r\f\v]+|(?<=[.!?。！？][\"'”’)\]])[ \t\r\f\v]+")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(begin, stop, words in lower case) of each sentence that has words."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        words = text[at : m.start()].lower().split()
        if words:
            out.append((at, m.start(), words))
        at = m.end()
    words = text[at:].lower().split()
    if words:
        out.append((at, len(text), words))
    return out


def units_of(text: str, min_words: int = MIN_WORDS):
    """(begin, stop, digest) of each unit: for every sentence the shortest runs that begin and that end with it.

    Normal form: lower case, words joined by single spaces. The digest is 128 bits.
    """
    every = sentences(text)
    plain = [" ".join(words) for _, _, words in every]
    size = [len(words) for _, _, words in every]
    runs = set()
    # two moving windows: the shortest run from each sentence, and the shortest one up to each
    j = n = 0
    for k in range(len(every)):
        while j < len(every) and n < min_words:
            n += size[j]
            j += 1
        if n < min_words:
            break
        runs.add((k, j))
        n -= size[k]
    k = n = 0
    for j in range(len(every)):
        n += size[j]
        while n - size[k] >= min_words:
            n -= size[k]
            k += 1
        if n >= min_words:
            runs.add((k, j + 1))
    for k, j in sorted(runs):
        yield every[k][0], every[j - 1][1], xxhash.xxh3_128_digest(" ".join(plain[k:j]).encode("utf-8", "replace"))


def units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The units of all texts: digest (two longs), doc_id, begin, stop."""

    def make():
        def f(b):
            hi, lo, ids, begins, stops = [], [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                for begin, stop, digest in units_of(text, min_words):
                    x, y = struct.unpack("<qq", digest)
                    hi.append(x), lo.append(y), ids.append(doc_id), begins.append(begin), stops.append(stop)
            return {"hi": hi, "lo": lo, "doc_id": ids, "begin": begins, "stop": stops}

        return f

    return map_rows(docs.where("doc_id is not null"), make, UNITS, ["doc_id", "text"])


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id and ``begins``, ``stops``: the places, in order, of the units that stand earlier already.

    Both tables are stored before they meet, so that a digest with very many occurrences is
    split over tasks; its aggregation sums up within each task first. A unit that runs into the
    first one of its kind, as where one sentence is repeated over and over, is not removed.
    """
    every = staged(units(docs, min_words), "line-units")
    place = F.struct("doc_id", "begin", "stop")
    firsts = every.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("hi", "lo", "first")
    firsts = staged(firsts, "line-firsts")
    later = every.join(firsts, ["hi", "lo"]).where("doc_id <> first.doc_id or begin >= first.stop")
    places = later.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("begin", "stop"))).alias("places"))
    return places.select("doc_id", F.col("places.begin").alias("begins"), F.col("places.stop").alias("stops"))


def removed_spans(text: str, begins: list[int], stops: list[int]) -> list[tuple[int, int]]:
    """What goes with these units (sorted by begin): disjoint spans with the white space behind them.

    A span takes the line break behind it along only where it begins a line.
    """
    out: list[list[int]] = []
    for begin, stop in zip(begins, stops, strict=True):
        if out and not text[out[-1][1] : begin].strip():  # overlaps the last one, or only white space is between
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([begin, stop])
    for span in out:
        at = span[1]
        while at < len(text) and text[at] in " \t\r\f\v":
            at += 1
        if text[at : at + 1] == "\n":
            if span[0] == 0 or text[span[0] - 1] == "\n":
                span[1] = at + 1
        else:
            span[1] = at
    return [(begin, stop) for begin, stop in out]


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents without the passages that an earlier document, or the same one earlier, holds.

    Takes rows with doc_id and text; returns doc_id, n_removed (spans), removed_chars, kept_chars
    (the length of the returned text), ``spans`` (``begin:stop`` in code points of the original
    text, disjoint, comma-joined) and ``text`` without those spans. A passage is one of at least
    ``min_words`` words that is made of whole sentences; case and white space do not matter.

    "Earliest" is by (doc_id, offset); rows that share a doc_id count as one document, so their
    equal units at equal offsets all stay. Rows with a null doc_id are returned whole and take
    no part. Null texts stay null; empty texts and texts of fewer words lose nothing; other
    columns are ignored; an empty table gives an empty result.
    """
    joined = docs.select("doc_id", "text").join(repeated_spans(docs, min_words), "doc_id", "left")

    def make():
        def f(b):
            out = {x.split()[0]: [] for x in RESULT.split(", ")}
            for doc_id, text, begins, stops in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "begins", "stops")), strict=True):
                gone = [(x, y) for x, y in removed_spans(text, begins, stops) if x < len(text)] if begins and text else []
                kept = text
                if gone:
                    ends = [0, *(y for _, y in gone)]
                    kept = "".join(text[x:y] for x, y in zip(ends, [*(x for x, _ in gone), len(text)], strict=True))
                n = len(text or "") - len(kept or "")
                row = doc_id, len(gone), n, len(kept or ""), ",".join(f"{x}:{y}" for x, y in gone), kept
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            return out

        return f

    return map_rows(joined, make, RESULT, ["doc_id", "text", "begins", "stops"])
