"""Operator 1, benchmark decontamination: a BM25 index of the test items, block-max WAND, overlap.

The test items are the indexed documents, every passage of every training text is a query. A
term's impact on an item is its BM25 score over the item's retrieval threshold, so that 1 is
the threshold of every item. The threshold is lossless: no passage that holds the asked share
of an item's shingles can score less.

Items are sorted by length and cut into blocks. Per block the index keeps each term's largest
impact; a passage whose block maxima sum to less than 1 skips the block, for all passages of a
text at once. In the blocks that remain, WAND moves the posting lists from pivot to pivot and
scores the items it stops at. Items above the threshold are verified on the passage's words.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, map_whole, staged, texts

K1, B = 1.2, 0.75
#: Words of a shingle, and the share of an item's shingles that a passage must hold.
SHINGLE, CONTAINED = 5, 0.8
#: Least share of the question's and of the answer's words that the passage must hold in verification.
PART = 0.5
#: Items of a block.
BLOCK = 16
#: A term in more than this share of the items is common: blocks bound all common terms by one constant.
COMMON = 1 / 8
#: Characters of test items that one index holds; more items make more indexes, each queried by all texts.
INDEX_CHARS = 4_000_000
#: Sums of block maxima, and block maxima, that a worker holds at a time, whatever the text's length.
CELLS = 1 << 18

MATCHES = "doc_id long, item_id long, passage int, bm25 double, overlap double, question_overlap double, answer_overlap double"

# ASCII: letters to lower case, digits kept, all else to a space; other bytes stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)|\n+(?=\S)")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split()


def split_item(text: str) -> tuple[list[bytes], int]:
    """An item's words, and how many of them are the question: all but those of its last sentence.

    An item of one sentence is question and answer both.
    """
    words = words_of(text)
    cuts = [m.end() for m in _SENTENCE.finditer(text.rstrip())]
    n = len(words_of(text[: cuts[-1]])) if cuts else len(words)
    return words, n if 0 < n else len(words)


def shingles(ids: list[int]) -> set[tuple[int, ...]]:
    """Distinct shingles; the whole sequence where it is shorter than one."""
    if len(ids) < SHINGLE:
        return {tuple(ids)} if ids else set()
    return set(zip(*(ids[k:] for k in range(SHINGLE)), strict=False))


def stride_of(words: int) -> int:
    """The least rung of a ladder of quarter steps that is a quarter above an item's length."""
    n = 8
    while n < 1.25 * words:
        n += max(1, n // 4)
    return n


@dataclass
class Item:
    item_ids: list[int | None]
    words: list[int]  # term ids
    question: int  # words of the question
    shingles: set = field(default_factory=set)


class BlockMaxima:
    """Of the blocks of one stride: the largest impact of each rare term, as sparse rows term -> (block, impact)."""

    def __init__(self, stride: int, blocks: list[int], maxima: list[dict[int, float]], need: list[float], n_terms: int):
        self.stride, self.blocks, self.need = stride, np.array(blocks), np.array(need)
        term = np.concatenate([np.fromiter(m, np.int64, len(m)) for m in maxima])
        block = np.repeat(np.arange(len(blocks), dtype=np.int32), [len(m) for m in maxima])
        value = np.concatenate([np.fromiter(m.values(), np.float32, len(m)) for m in maxima])
        order = np.argsort(term, kind="stable")
        self.block, self.value = block[order], value[order]
        self.start = np.zeros(n_terms + 2, np.int32)  # the last row, of words not indexed, is empty
        np.cumsum(np.bincount(term, minlength=n_terms + 1), out=self.start[1:])

    def stretches(self, ids: np.ndarray) -> np.ndarray:
        """The summed maxima of each stretch of ``stride`` words, by block."""
        width, n = len(self.blocks), self.stride
        out = np.zeros((-(-len(ids) // n), width))
        for at in range(0, len(ids), max(1, CELLS // width)):
            some = ids[at : at + max(1, CELLS // width)]
            count = self.start[some + 1] - self.start[some]
            row = np.repeat(self.start[some] - np.cumsum(count) + count, count) + np.arange(count.sum())
            cell = np.repeat((np.arange(at, at + len(some)) // n) * width, count) + self.block[row]
            out += np.bincount(cell, self.value[row], out.size).reshape(out.shape)
        return out

    def passages(self, ids: np.ndarray):
        """(begin, end, blocks) of each passage whose sum reaches what some block needs."""
        n = self.stride
        total = -(-max(1, len(ids) - n) // n)
        step = max(1, CELLS // len(self.blocks))
        for a in range(0, total, step):
            b = min(a + step, total)
            sums = self.stretches(ids[a * n : (b + 1) * n])
            if len(sums) <= b - a:
                sums = np.concatenate([sums, np.zeros((b - a + 1 - len(sums), sums.shape[1]))])
            through = sums[: b - a] + sums[1 : b - a + 1] >= self.need
            for k in np.flatnonzero(through.any(1)):
                yield (a + int(k)) * n, min((a + int(k) + 2) * n, len(ids)), self.blocks[through[k]].tolist()


    def together(self, docs: list[np.ndarray]):
        """(number of the text, begin, end, blocks), as ``passages`` gives them, of texts whose sums are held at once."""
        width, n = len(self.blocks), self.stride
        lens = np.array([len(x) for x in docs])
        rows = -(-lens // n) + 1  # an empty one parts the texts
        first = np.cumsum(rows) - rows
        ids = np.concatenate(docs)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(lens) - lens, lens)
        stretch = np.repeat(first, lens) + place // n
        sums = np.zeros((int(rows.sum()) + 1, width))
        for at in range(0, len(ids), max(1, CELLS // width)):
            some = ids[at : at + max(1, CELLS // width)]
            count = self.start[some + 1] - self.start[some]
            row = np.repeat(self.start[some] - np.cumsum(count) + count, count) + np.arange(count.sum())
            cell = np.repeat(stretch[at : at + len(some)] * width, count) + self.block[row]
            sums += np.bincount(cell, self.value[row], sums.size).reshape(sums.shape)
        through = sums[:-1] + sums[1:] >= self.need
        found = np.flatnonzero(through.any(1))
        doc = np.searchsorted(first, found, side="right") - 1
        for f, d in zip(found.tolist(), doc.tolist(), strict=True):
            k = f - int(first[d])
            if k < max(1, rows[d] - 2):
                yield d, k * n, min((k + 2) * n, int(lens[d])), self.blocks[through[f]].tolist()


class Index:
    """BM25 index of some items; document frequencies and lengths are those of all items."""

    def __init__(self, items: list[tuple[list, list[bytes], int]], df: dict[bytes, int], n_items: int, mean_words: float):
        self.terms: dict[bytes, int] = {}
        for _, words, _ in items:
            for w in words:
                self.terms.setdefault(w, len(self.terms))
        self.items = sorted((Item(ids, [self.terms[w] for w in words], q) for ids, words, q in items if words), key=lambda x: (len(x.words), x.words))
        n_terms = len(self.terms)
        idf = np.zeros(n_terms)
        seen = np.zeros(n_terms)
        for w, t in self.terms.items():
            seen[t] = df[w]
            idf[t] = math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5))
        common = seen > max(1, COMMON * n_items)
        self.postings: list[dict[int, tuple[list[int], list[float], float]]] = []  # of each block: its terms' items, impacts and largest impact
        bound, maxima = [], []  # of each block: what its common terms can add at most, and its rare terms each
        self.blocks = [range(k, min(k + BLOCK, len(self.items))) for k in range(0, len(self.items), BLOCK)]
        strides = defaultdict(list)
        for b, block in enumerate(self.blocks):
            most, rare, here = 0.0, {}, defaultdict(lambda: ([], []))
            for i in block:
                item = self.items[i]
                item.shingles = shingles(item.words)
                tf = Counter(item.words)
                norm = K1 * (1 - B + B * len(item.words) / mean_words)
                impact = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in tf.items()}
                # at most so many words lie in no held shingle, so at most these impacts are lost
                positions = Counter(zip(*(item.words[k:] for k in range(SHINGLE)), strict=False))
                missed = math.floor((1 - CONTAINED) * len(item.shingles) + 1e-9) * max(positions.values(), default=1)
                least = sum(impact.values()) - sum(sorted(impact.values(), reverse=True)[:missed])
                threshold = max(least, 1e-3) * (1 - 1e-9)
                shared = 0.0
                for t, x in impact.items():
                    x /= threshold
                    here[t][0].append(i), here[t][1].append(x)
                    if common[t]:
                        shared += x
                    else:
                        rare[t] = max(rare.get(t, 0.0), x * (1 + 1e-6))
                most = max(most, shared)
            bound.append(most), maxima.append(rare)
            self.postings.append({t: (at, impacts, max(impacts)) for t, (at, impacts) in here.items()})
            strides[stride_of(len(self.items[block[-1]].words))].append(b)
        self.classes = [BlockMaxima(n, blocks, [maxima[b] for b in blocks], [1 - bound[b] - 1e-6 for b in blocks], n_terms) for n, blocks in strides.items()]

    # ---- queries ------------------------------------------------------------------------------
    def ids(self, words: list[bytes]) -> np.ndarray:
        get, none = self.terms.get, len(self.terms)
        return np.fromiter((get(w, none) for w in words), np.int32, len(words))

    def passages(self, docs: list[np.ndarray]) -> list[list[tuple[int, int, list[int]]]]:
        """Of each text the (begin, end, blocks) of every passage that some block's maxima let through.

        For a block of stride n, passages are 2n words long and begin every n words, so that every
        stretch of n words lies in one; n exceeds the block's longest item by a quarter or more.
        Short texts are summed up together, long ones by themselves.
        """
        out: list[list[tuple[int, int, list[int]]]] = [[] for _ in docs]
        for some in self.classes:
            group, cells = [], 0

            def flush(some=some):
                for d, *passage in some.together([docs[g] for g in group]) if group else ():  # noqa: B023
                    out[group[d]].append(tuple(passage))  # noqa: B023
                group.clear()  # noqa: B023

            for d, ids in enumerate(docs):
                need = (len(ids) // some.stride + 2) * len(some.blocks)
                if not len(ids):
                    continue
                if need > CELLS:
                    out[d] += some.passages(ids)
                    continue
                if cells + need > CELLS:
                    flush()
                    cells = 0
                group.append(d)
                cells += need
            flush()
        return out

    def wand(self, terms: list[int], b: int) -> list[tuple[int, float]]:
        """The items of block b whose summed impacts reach 1, with the sums."""
        block, known = self.blocks[b], self.postings[b].get
        cursors = [[x[0][0], 0, len(x[0]), *x] for x in map(known, terms) if x]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += c[5]
                if bound >= 1:
                    pivot = k
                    break
            if pivot is None:
                break
            item = cursors[pivot][0]
            if cursors[0][0] == item:
                score = 0.0
                for c in cursors:
                    if c[0] != item:
                        break
                    score += c[4][c[1]]
                    c[1] += 1
                    c[0] = c[3][c[1]] if c[1] < c[2] else block.stop
                if score >= 1:
                    out.append((item, score))
            else:
                for c in cursors[:pivot]:
                    if c[0] < item:
                        c[1] = _first(c[3], item, c[1], c[2])
                        c[0] = c[3][c[1]] if c[1] < c[2] else block.stop
            cursors = [c for c in cursors if c[1] < c[2]]
        return out

    def verify(self, item: Item, words: list[int], held: set) -> tuple[float, float, float]:
        """Shares of the item's shingles, of its question's words and of its answer's words in a passage."""
        share = len(item.shingles & held) / len(item.shingles)
        have = set(words)
        part = lambda x: sum(w in have for w in x) / len(x) if x else 1.0
        return share, part(item.words[: item.question]), part(item.words[item.question :])

    def matches(self, texts: list[str]) -> list[list[tuple]]:
        """Of each text the (item_id, passage's first word, score, overlaps) of every item that it holds; the best passage of each."""
        if not self.items:
            return [[] for _ in texts]
        docs = [self.ids(words_of(t)) for t in texts]
        return [self.found(ids, passages) if passages else [] for ids, passages in zip(docs, self.passages(docs), strict=True)]

    def found(self, ids: np.ndarray, passages: list[tuple[int, int, list[int]]]) -> list[tuple]:
        best: dict[int, tuple] = {}
        none = len(self.terms)
        for begin, end, blocks in passages:
            some = ids[begin:end].tolist()
            terms = sorted(set(some) - {none})
            held = None
            for b in blocks:
                for i, score in self.wand(terms, b):
                    item = self.items[i]
                    if len(item.words) < SHINGLE:
                        n = len(item.words)
                        held_here = {tuple(some[k : k + n]) for k in range(len(some) - n + 1)}
                    else:
                        held = held if held is not None else shingles(some)
                        held_here = held
                    share, q, a = self.verify(item, some, held_here)
                    if share >= CONTAINED and q >= PART and a >= PART:
                        found = (share, score, -begin, q, a)
                        if found > best.get(i, ()):
                            best[i] = found
        return [(item_id, -found[2], round(found[1], 6), round(found[0], 6), round(found[3], 6), round(found[4], 6)) for i, found in sorted(best.items()) for item_id in self.items[i].item_ids]


def _first(values: list[int], x: int, lo: int = 0, hi: int | None = None) -> int:
    from bisect import bisect_left

    return bisect_left(values, x, lo, len(values) if hi is None else hi)


def build_indexes(benchmark: DataFrame, index_chars: int = INDEX_CHARS):
    """Yields indexes that together hold all items; the driver holds one at a time.

    Items with equal texts share one entry; null texts and texts without words are no items.
    """

    def make():
        def f(b):
            split = [split_item(t) for t in texts(b)]
            return {"item_id": b.column("item_id"), "text": b.column("text"), "n": [len(w) for w, _ in split], "w": [b" ".join(sorted(set(w))).decode("utf-8", "replace") for w, _ in split]}

        return f

    rows = map_rows(benchmark, make, "item_id long, text string, n long, w string", ["item_id", "text"])
    items = staged(rows.where("n > 0").groupBy("text").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.first("n").alias("n"), F.first("w").alias("w")), "test-items")
    n_items, mean_words, chars = items.agg(F.count("*"), F.avg("n"), F.sum(F.length("text"))).first()
    if not n_items:
        return
    df = items.select(F.explode(F.split("w", " ")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    shards = max(1, -(-chars // index_chars))
    items = items.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)))
    for k in range(shards):
        mine = items.where(F.col("shard") == k)
        held = [(r["item_ids"] or [None], *split_item(r["text"])) for r in mine.select("item_ids", "text").orderBy("text").toLocalIterator()]
        wanted = mine.select(F.explode(F.split("w", " ")).alias("term")).distinct()
        known = {r["term"].encode(): r["df"] for r in df.join(wanted, "term").toLocalIterator()}
        yield Index(held, known, n_items, float(mean_words))


def find_leaks(docs: DataFrame, benchmark: DataFrame, index_chars: int = INDEX_CHARS) -> DataFrame:
    """Test items that texts hold: one row per (row of ``docs``, item_id).

    Takes (doc_id, text) and (item_id, text). Returns doc_id, item_id, the first word of the best
    passage, its BM25 score over the item's threshold, and the overlaps of shingles, question
    and answer.

    Null and empty texts and texts without words hold nothing. Items with equal texts are found
    together, one row for each of their item_ids (null if all are null). Rows of ``docs`` are
    judged one by one: repeated rows give repeated matches, null doc_ids stay null. Items of
    fewer than five words must occur as a whole. Other columns are ignored; an empty table on
    either side gives an empty result. Every text meets every index; nothing is shuffled.
    """
    parts = []
    for index in build_indexes(benchmark, index_chars):

        def make(index=index):
            names = [x.split()[0] for x in MATCHES.split(", ")]

            def f(b):
                rows = [(doc_id, *m) for doc_id, found in zip(b.column("doc_id").to_pylist(), index.matches(texts(b)), strict=True) for m in found]
                cols = zip(*rows, strict=True) if rows else [()] * len(names)
                return dict(zip(names, cols, strict=True))

            return f

        found = map_rows(docs, make, MATCHES, ["doc_id", "text"])
        parts.append(found)
        if len(parts) > 1:  # more indexes than one: each is done with before the next is built
            parts = [staged(p, "leaks") for p in parts]
    if not parts:
        return docs.sparkSession.createDataFrame([], MATCHES)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, index_chars: int = INDEX_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns; cases as in find_leaks."""
    for index in build_indexes(benchmark, index_chars):

        def make(index=index):
            return lambda b: b.filter(pa.array([not found for found in index.matches(texts(b))], pa.bool_()))

        docs = map_whole(docs, make)
    return docs
