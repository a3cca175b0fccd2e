"""Operator 8, n-gram Jaccard join by universe partition.

A document is its set of distinct word shingles. Equal sets are one class; only classes join.

Sizes fall into bands. For pairs whose larger set is in a band, a link bounds the symmetric
difference by U, so the shingles' universe is hashed into segments, and each set indexes its
segments: exactly (a segment that a linked pair shares must exist if there are more than U), or
with their one-deletion neighbourhoods (such a segment absorbs two differences, so there are
fewer and longer ones). How many of each a band gets is chosen by the cost of its index rows and
of the unlinked sets that short segments bring together. Segments that hold nothing would gather everyone; they are
not indexed, and each band has spare segments for them. A set that has more of them than that
(it is rare) indexes them all the same, so nothing is lost: see ``Plan``.

Sets that share an indexed segment are candidates. They are first compared with the hub of their
bucket only: the set that shares the most segments, as an original does among its edited copies.
What is still unlinked to the hub is then compared with the other components of the bucket, as
far as sizes and parity sketches allow a link: first along a forest of them, then all that are
left. Links are verified on the shingles of the texts themselves.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, discard, map_rows, staged, texts, thinned
from .graph import components

# --- fixed values: the contract ---------------------------------------------------------------
WORDS, PERCENT = 4, 85
# -----------------------------------------------------------------------------------------------
#: Ratio of the bands' bounds; at least 100 / PERCENT, so that links reach the next band at most.
RATIO = 2.0
#: Share of a band's sets that may have more empty segments than it has spare ones, and what more of
#: them cost (in index rows): they all meet in their empty segments.
RARE, GATHER = 1e-3, 1e4
#: Bits of a set's parity sketch for each shingle, and the fewest and most in all (as powers of two).
#: Two sketches differ in no more bits than their sets in shingles, whatever their lengths.
SKETCH, SKETCH_LEAST, SKETCH_MOST = 2, 8, 16

#: Measured on texts: how many unlinked sets share a shingle of a set, and the share of them that
#: shares the next one too, for sets of under so many shingles; and how many index rows the check of
#: one such set is worth. They steer the plan only, whatever they are nothing is lost.
SHARED = ((64, 24.0, 1 / 4), (256, 9.5, 1 / 9), (math.inf, 6.7, 1 / 80))
VERIFY = 1.0

#: Parts of a hub's pairs, and the rows of a part of a bucket: larger buckets are cut into parts.
SPLIT, PART = 32, 4096
#: What a row is to a part of a bucket.
HELD, BOTH, STREAMS = 0, 1, 2

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted distinct 64-bit shingle hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only; \x20 and \x09-\x0D only
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 200_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.words, len(words))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out + h[k : len(h) - n + 1 + k]) * _ODD
            out ^= out >> np.uint64(29)
        return np.unique(mix(out))


def node_of(tokens: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """A class's 64-bit number, signed, and another 64 bits by which classes of one number are told apart."""
    x = xxhash.xxh3_128_intdigest(tokens.tobytes(), seed)
    return tuple(y - (1 << 64) if y >> 63 else y for y in (x & (1 << 64) - 1, x >> 64))


def most_apart(a: int, b: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return (100 - percent) * (a + b) // (100 + percent)


def linked(a: int, b: int, both: int, percent: int = PERCENT) -> bool:
    return 100 * both >= percent * (a + b - both)


# ---- bands and their segments ------------------------------------------------------------------
@lru_cache(1 << 14)
def band_bounds(k: int) -> tuple[int, int]:
    """Least and largest size of band k; band 0 holds size 1."""
    lo = 1
    for _ in range(k):
        lo = max(lo + 1, math.ceil(lo * RATIO))
    return lo, max(lo + 1, math.ceil(lo * RATIO)) - 1


def band_of(sizes: np.ndarray) -> np.ndarray:
    """Band of each size of at least 1."""
    lows, k = [1], 0
    while lows[-1] <= sizes.max(initial=1):
        k += 1
        lows.append(band_bounds(k)[0])
    return np.searchsorted(np.array(lows), sizes, side="right") - 1


@dataclass(frozen=True)
class Plan:
    """A band's segments: ``m`` in all, of which the first ``near`` index one-deletion neighbourhoods.

    A segment absorbs as many differences as it has value (1, or 2 with neighbourhoods) before it
    stops being found. A set indexes a subset of them: the first ones, until their values sum to
    1 + spare more than its own largest difference to a linked set. Two linked sets both index
    the shorter of their subsets, which suffices. A set loses the value of its empty segments,
    and 1 for a single shingle in a neighbourhood segment (its deletion is empty). A pair loses
    no more than the smaller loss of its two sets. So if either set's loss is within ``spare``,
    some indexed segment is shared; if neither's is, both index their empty segments too and
    nothing is lost.
    """

    m: int
    near: int
    spare: int


def reach(sizes: np.ndarray, hi: int, percent: int = PERCENT) -> np.ndarray:
    """Of sets of these sizes, the largest difference to a linked set of at most ``hi`` shingles."""
    return (100 - percent) * (sizes + np.minimum(hi, 100 * sizes // percent)) // (100 + percent)


def subset(sizes: np.ndarray, hi: int, near: int, spare: int, percent: int = PERCENT) -> np.ndarray:
    """How many segments sets of these sizes index."""
    need = reach(sizes, hi, percent) + 1 + spare
    return np.maximum(need - near, -(-need // 2))


def empty_share(size: int, m: int) -> tuple[float, float]:
    """Chances that a segment of ``m`` holds none, and one, of a set's shingles."""
    if m == 1:
        return float(size == 0), float(size == 1)
    none = math.exp(size * math.log1p(-1 / m))
    return none, size / (m - 1) * none


def _tail(mean: float, most: int) -> float:
    """Poisson probability of more than ``most`` (by the normal distribution for large means)."""
    if mean > 60:
        return 0.5 * math.erfc((most + 0.5 - mean) / math.sqrt(2 * mean))
    term = total = math.exp(-mean)
    for k in range(1, most + 1):
        term *= mean / k
        total += term
    return max(0.0, 1 - total)


def met(mean: float, size: int, near: bool) -> float:
    """Unlinked sets that meet a set of this size in a segment of ``mean`` shingles (Poisson), exact or with neighbourhoods."""
    shared, then = next((s, t) for most, s, t in SHARED if size < most)
    some = math.exp(-(1 - then) * mean) - math.exp(-mean)  # sets in an empty segment are not indexed
    if not near:
        return shared * some / then
    one = mean * math.exp(-mean)
    return shared * ((some - then * one) / then**2 + one)  # all shingles but one, or a single one


@lru_cache(1 << 12)
def plan_of(k: int, percent: int = PERCENT) -> Plan | None:
    """The cheapest plan by index rows, checks and rare sets (see RARE); None where linked sets are equal."""
    lo, hi = band_bounds(k)
    u = most_apart(hi, hi, percent)
    if u == 0:
        return None
    least = max(1, percent * lo // 100)  # the smallest sets that take part have the emptiest segments
    sizes = np.unique(np.linspace(least, hi, 9).astype(np.int64))
    found = []
    for near in sorted({*range(0, min(u, 8) + 1), u // 4, u // 2, (u + 1) // 2}):
        spare = 0
        while spare < u + 3:
            m = int(subset(np.array([hi]), hi, near, spare, percent)[0])
            if m < max(1, near):
                spare += 1
                continue
            none, one = empty_share(least, m)
            loss = none * (int(subset(sizes[:1], hi, near, spare, percent)[0]) + near) + near * one
            rare, of, cost = _tail(loss, spare), subset(sizes, hi, near, spare, percent), 0.0
            for n, shown in zip(sizes.tolist(), of.tolist(), strict=True):
                checks = (shown - near) * met(n / m, n, False) + near * met(n / m, n, True)
                cost += shown + near * n / m + VERIFY * checks
            found.append((cost + GATHER * max(0.0, rare - RARE), near, Plan(m, near, spare)))
            if rare <= RARE:
                break
            spare = max(spare + 1, min(int(loss), u + 2))
    return min(found, key=lambda x: x[:2])[2]


def signatures(tokens: list[np.ndarray], nodes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(signature, node) rows of the sets: each in its own band, and in the next where a link could reach it."""
    sizes = np.array([len(t) for t in tokens], np.int64)
    band = band_of(np.maximum(sizes, 1))
    sigs, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for k in range(int(band.max(initial=0)) + 2):
        plan = plan_of(k, percent)
        if plan is None:
            continue
        take = (band == k) | ((band == k - 1) & (100 * sizes >= percent * band_bounds(k)[0]))
        mine = np.flatnonzero(take & (sizes > 0))
        if not len(mine):
            continue
        first = subset(sizes[mine], band_bounds(k)[1], plan.near, plan.spare, percent)
        flat = np.concatenate([tokens[i] for i in mine])
        owner = np.repeat(np.arange(len(mine)), sizes[mine])
        m = plan.m
        where = mix(flat ^ np.uint64(k * 0x51ED2701 + 7))
        segment = ((where >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        some = segment < first[owner]
        where, segment, owner = where[some], segment[some], owner[some]
        begin = np.cumsum(first) - first
        cell = begin[owner] + segment
        value = mix(where + _ODD)
        total = np.zeros(int(first.sum()), np.uint64)
        np.add.at(total, cell, value)
        count = np.bincount(cell, minlength=len(total))
        of_set = np.repeat(np.arange(len(mine)), first)
        number = np.arange(len(total)) - begin[of_set]
        salt = mix(np.arange(1, m + 1, dtype=np.uint64) + np.uint64(k << 32))
        lost = (count == 0).astype(np.int64) + ((number < plan.near) & (count <= 1))
        whole = np.bincount(of_set, lost, len(mine)) > plan.spare  # these index their empty segments too
        shown = (count > 0) | whole[of_set]
        sigs.append(mix(total ^ salt[number])[shown])
        owners.append(nodes[mine][of_set[shown]])
        if plan.near:
            some = (segment < plan.near) & ((count[cell] > 1) | whole[owner])
            sigs.append(mix((total[cell[some]] - value[some]) ^ salt[segment[some]]))
            owners.append(nodes[mine][owner[some]])
    return np.concatenate(sigs).view(np.int64), np.concatenate(owners)


# ---- the join's steps ------------------------------------------------------------------------------
ROWS = "sig long, node long, doc_id long, n long, check long, of long, hub long, sketch binary"


def first_stars(sig: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Signature rows of one batch, combined: (sig, node) rows that go on, and stars (sig, hub, node) of the others.

    Of several nodes with one signature only the hub goes on, the node with most such signatures
    (ties: the smallest): a signature that a third of all sets have reaches its task with a row a batch.
    """
    order = np.lexsort((owner, sig))
    sig, owner = sig[order], owner[order]
    fresh = np.r_[True, (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])] if len(sig) else np.zeros(0, bool)
    sig, owner = sig[fresh], owner[fresh]
    if not len(sig):
        return sig, owner, (sig, owner, owner)
    group = np.cumsum(np.r_[True, sig[1:] != sig[:-1]]) - 1
    several = np.bincount(group)[group] > 1
    _, at = np.unique(owner, return_inverse=True)
    degree = np.bincount(at, several)[at]
    order = np.lexsort((owner, -degree, sig))
    sig, owner = sig[order], owner[order]
    top = np.r_[True, sig[1:] != sig[:-1]]
    hub = owner[np.flatnonzero(top)[group]]
    return sig[top], owner[top], (sig[~top], hub[~top], owner[~top])


def index(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, seed: int = 0) -> DataFrame:
    """Three kinds of rows: (sig, node) of the indexed segments of all sets with a doc_id, stars (of, hub, node)
    of those that a batch has combined already, and (node, doc_id, n, check, sketch) of each document.

    The sig of the latter two only spreads them. A document's row has n; its node is null without shingles.
    """

    def make():
        shingle = Shingler(words)

        def f(b):
            doc_ids, nodes, checks, sizes, sketches, parts = b.column("doc_id"), [], [], [], [], []
            held, names = [], []

            def flush():
                parts.append(signatures(held, np.array(names, np.int64), percent))
                held.clear(), names.clear()

            for text, known in zip(b.column("text"), doc_ids.is_valid().to_pylist(), strict=True):
                s = shingle(text.as_py())
                sizes.append(len(s))
                sketches.append(sketch_of(s))
                node, check = node_of(s, seed) if len(s) else (None, None)
                nodes.append(node), checks.append(check)
                if known and len(s):
                    held.append(s), names.append(nodes[-1])
                    if sum(map(len, held)) > 200_000:  # some sets at a time, so that a worker stays small
                        flush()
            flush()
            sig, owner, (of, hub, node) = first_stars(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            others = len(of) + len(sizes)
            spread = mix(np.arange(others, dtype=np.uint64) + np.uint64(int(sig[0]) & (1 << 62) - 1 if len(sig) else 1)).view(np.int64)
            none, some = pa.nulls(len(sig) + len(of), pa.int64()), pa.nulls(len(sizes), pa.int64())
            left = pa.nulls(len(sig), pa.int64())
            return {
                "sig": np.concatenate([sig, spread]),
                "node": pa.concat_arrays([pa.array(owner, pa.int64()), pa.array(node, pa.int64()), pa.array(nodes, pa.int64())]),
                "doc_id": pa.concat_arrays([none, doc_ids.cast(pa.int64())]),
                "n": pa.concat_arrays([none, pa.array(sizes, pa.int64())]),
                "check": pa.concat_arrays([none, pa.array(checks, pa.int64())]),
                "of": pa.concat_arrays([left, pa.array(of, pa.int64()), some]),
                "hub": pa.concat_arrays([left, pa.array(hub, pa.int64()), some]),
                "sketch": pa.concat_arrays([pa.nulls(len(none), pa.binary()), pa.array(sketches, pa.binary())]),
            }

        return f

    return map_rows(docs, make, ROWS, ["doc_id", "text"])


def _buckets(batches):
    """Rows sorted by (sig, node): documents and stars pass, of signatures the distinct nodes of buckets of two or more.

    Nothing is held but the last row: whether a row's neighbour has its signature tells enough.
    """
    schema = arrow_schema(ROWS)
    tail = None  # the last distinct row so far, and whether it went out
    for b in batches:
        other = (b.column("n").is_valid().to_numpy(zero_copy_only=False)) | (b.column("hub").is_valid().to_numpy(zero_copy_only=False))
        if other.any():
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(other)).columns, schema=schema)
        rows = b.filter(pa.array(~other))
        sig, node = rows.column("sig").to_numpy(), rows.column("node").to_numpy()
        if not len(sig):
            continue
        if tail:
            sig, node = np.r_[tail[0], sig], np.r_[tail[1], node]
        fresh = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
        sig, node = sig[fresh], node[fresh]
        alike = sig[1:] == sig[:-1]
        out = np.r_[alike, False] | np.r_[False, alike]
        sent = bool(tail and tail[2])
        tail = (sig[-1], node[-1], bool(out[-1]) or (sent and len(sig) == 1))
        out[0] &= not sent
        n = int(out.sum())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(node[out]), *(pa.nulls(n, x.type) for x in list(schema)[2:])], schema=schema)


def _stars(batches):
    """Rows sorted by (sig, falling degree, node) -> (sig, hub, node) of all but the first of a bucket, which is the hub."""
    schema = pa.schema([("sig", pa.int64()), ("hub", pa.int64()), ("node", pa.int64())])
    tail = None
    for b in batches:
        sig, node = b.column("sig").to_numpy(), b.column("node").to_numpy()
        if not len(sig):
            continue
        new = np.r_[tail is None or sig[0] != tail[0], sig[1:] != sig[:-1]]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
        hub = np.where(begin >= 0, node[np.maximum(begin, 0)], tail[1] if tail else 0)
        tail = (sig[-1], hub[-1])
        if not new.all():
            yield pa.RecordBatch.from_arrays([pa.array(sig[~new]), pa.array(hub[~new]), pa.array(node[~new])], schema=schema)


def hubs(buckets: DataFrame) -> DataFrame:
    """(sig, hub, node) of each further node of a bucket; the hub is the node in the most buckets (ties: the smallest)."""
    degree = buckets.groupBy("node").agg(F.count("*").cast("int").alias("degree"))
    placed = buckets.join(degree, "node").repartition("sig").sortWithinPartitions("sig", F.desc("degree"), "node")
    return placed.select("sig", "node").mapInArrow(_stars, "sig long, hub long, node long")


def sketch_of(tokens: np.ndarray) -> bytes:
    bits = 1 << min(SKETCH_MOST, max(SKETCH_LEAST, (SKETCH * len(tokens) - 1).bit_length()))
    return np.packbits((np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketches: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) folded onto ``size`` words."""
    while sketches.shape[-1] > size:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def sketch_apart(a: bytes, b: bytes) -> int:
    """A lower bound on the symmetric difference of two sets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def class_texts(docs: DataFrame, wanted: DataFrame, words: int = WORDS, seed: int = 0) -> DataFrame:
    """Of each wanted class (node, doc_id of a member) the compressed text of that member: (node, z)."""
    mine = thinned(docs.select("doc_id", "text").where("doc_id is not null"), "doc_id", wanted.select("doc_id")).join(wanted, "doc_id")

    def make():
        shingle, z = Shingler(words), zstandard.ZstdCompressor(3)

        def f(b):
            nodes, packed = [], []
            for node, text in zip(b.column("node").to_pylist(), texts(b), strict=True):
                s = shingle(text)
                if len(s) and node_of(s, seed)[0] == node:  # rows may share a doc_id
                    nodes.append(node), packed.append(z.compress(text.encode("utf-8", "surrogatepass")))
            return {"node": nodes, "z": packed}

        return f

    return map_rows(mine, make, "node long, z binary", ["node", "text"])


def bounded(pairs: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (hub, node) that sizes and sketches (node, n, sketch) allow a link to."""
    right = sketches.select("node", F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    left = sketches.select(F.col("node").alias("hub"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    met = pairs.join(right, "node").join(left, "hub").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def make():
        def f(b):
            cols = [b.column(c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b")]
            near = pa.array([sketch_apart(s, t) <= most_apart(m, n, percent) for m, n, s, t in zip(*cols, strict=True)], pa.bool_())
            return {"hub": b.column("hub").filter(near), "node": b.column("node").filter(near)}

        return f

    return map_rows(met, make, "hub long, node long", ["hub", "node", "n_a", "n_b", "s_a", "s_b"]).repartition("hub", F.pmod(F.xxhash64("node"), F.lit(SPLIT)))


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, words: int = WORDS, percent: int = PERCENT, seed: int = 0) -> DataFrame:
    """The pairs (hub, node) whose texts' shingles link, as edges (a, b). reps: (node, rep), a member's doc_id."""
    nodes = pairs.select(F.explode(F.array("hub", "node")).alias("node")).distinct()
    members = staged(class_texts(docs, reps.join(nodes, "node").select("node", F.col("rep").alias("doc_id")), words, seed), "jaccard-members")
    right = members.select("node", F.col("z").alias("z_b"))
    left = members.select(F.col("node").alias("hub"), F.col("z").alias("z_a"))
    met = pairs.join(right, "node").join(left, "hub")

    def make():
        shingle, unz = Shingler(words), zstandard.ZstdDecompressor()
        held = [None, None]  # rows of one hub mostly follow each other

        def f(b):
            cols = [b.column(c).to_pylist() for c in ("hub", "node", "z_a", "z_b")]
            out_a, out_b = [], []
            for hub, node, z_a, z_b in zip(*cols, strict=True):
                if held[0] != hub:
                    held[:] = hub, shingle(unz.decompress(z_a).decode("utf-8", "surrogatepass"))
                other = shingle(unz.decompress(z_b).decode("utf-8", "surrogatepass"))
                both = len(np.intersect1d(held[1], other, assume_unique=True))
                if linked(len(held[1]), len(other), both, percent):
                    out_a.append(hub), out_b.append(node)
            return {"a": out_a, "b": out_b}

        return f

    return map_rows(met, make, "a long, b long", ["hub", "node", "z_a", "z_b"]).repartition("a")  # few rows of many tasks


class _Held:
    """Outsiders of a bucket whose sketches have one length: (node, label, n) and sketches, in arrays that double."""

    def __init__(self, size: int):
        self.count, self.about, self.sketches = 0, np.zeros((4, 3), np.int64), np.zeros((4, size), np.uint64)

    def add(self, node: int, label: int, n: int, sketch: np.ndarray) -> None:
        if self.count == len(self.about):
            self.about, self.sketches = np.concatenate([self.about, np.zeros_like(self.about)]), np.concatenate([self.sketches, np.zeros_like(self.sketches)])
        self.about[self.count], self.sketches[self.count] = (node, label, n), sketch
        self.count += 1

    def near(self, node: int, label: int, n: int, sketch: np.ndarray, below: bool, percent: int) -> list[tuple[int, int]]:
        """(node, label) of those of other labels (with ``below``, of smaller nodes) that sizes and sketches allow a link to."""
        about = self.about[: self.count]
        some = (about[:, 1] != label) & (100 * np.minimum(about[:, 2], n) >= percent * np.maximum(about[:, 2], n))
        at = np.flatnonzero(some & (about[:, 0] < node) if below else some)
        size = min(self.sketches.shape[1], len(sketch))
        apart = np.bitwise_count(folded(self.sketches[at], size) ^ folded(sketch, size)).sum(1)
        return about[at[apart <= (100 - percent) * (about[at, 2] + n) // (100 + percent)], :2].tolist()


def _root(x: int, joined: dict[int, int]) -> int:
    while joined.get(x, x) != x:
        x = joined[x]
    return x


def _rest(percent: int, forest: bool):
    """Rows of parts of mixed buckets, sorted by (sig, p, q, role): pairs of an outsider with the bucket's other components.

    A part holds some of the bucket's outsiders (those not linked to the hub), and some of its nodes
    stream by. A pair must pass the bounds of sizes and sketches. With ``forest`` a pair is left out
    whose components other pairs of the part have joined already.
    """
    schema = pa.schema([("sig", pa.int64()), ("hub", pa.int64()), ("node", pa.int64())])

    def run(batches):
        now, held, joined = None, {}, {}
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("sig", "p", "q", "role", "inside", "node", "label", "n", "sketch")]
            pairs = []
            for sig, p, q, role, inside, node, label, n, sketch in zip(*cols, strict=True):
                if (sig, p, q) != now:
                    now, held, joined = (sig, p, q), {}, {}
                s = np.frombuffer(sketch, np.uint64)
                # linked sizes lie within a factor of two, and so do their sketches
                for size in (len(s) // 2, len(s), 2 * len(s)) if role != HELD else ():
                    for x, other in held[size].near(node, label, n, s, not inside, percent) if size in held else ():
                        if forest:
                            a, c = _root(label, joined), _root(other, joined)
                            if a == c:
                                continue
                            joined[max(a, c)] = min(a, c)
                        pairs.append((sig, min(x, node), max(x, node)))
                if role != STREAMS:
                    held.setdefault(len(s), _Held(len(s))).add(node, label, n, s)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], schema=schema)

    return run


def rest_pairs(stars: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int, forest: bool, part: int = PART) -> DataFrame:
    """(sig, hub, node) pairs that could still join components within buckets. stars: (sig, hub, node, far).

    ``far`` nodes have been compared with another node of their bucket than the hub. Of a bucket with
    an outsider, every node streams past every part of the outsiders; both are dealt into parts of about
    ``part`` rows, so that no task holds or reads a whole bucket.
    """
    at_node = sketches.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    at_node = staged(at_node, "jaccard-labels")
    placed = stars.join(at_node, "node").join(at_node.select(F.col("node").alias("hub"), F.col("label").alias("hub_label")), "hub")
    placed = staged(placed.select("sig", "hub", "hub_label", "node", "label", "far", (F.col("label") == F.col("hub_label")).alias("inside")), "jaccard-placed")
    mixed = placed.where("not inside").groupBy("sig").agg(F.bool_or("far").alias("far"), F.count("*").alias("n_out"))
    sizes = placed.groupBy("sig").agg(F.count("*").alias("n_all"))
    parts = lambda n: F.ceil(F.col(n) / F.lit(float(part))).cast("int")
    mixed = staged(mixed.join(sizes, "sig").select("sig", "far", parts("n_all").alias("ps"), parts("n_out").alias("qs")), "jaccard-mixed")
    rows = placed.join(mixed.drop("far"), "sig")
    hub_rows = placed.join(mixed.where("far"), "sig", "left_semi").select("sig", "hub", "hub_label").distinct().join(mixed.drop("far"), "sig")
    columns = ["sig", "node", "label", "inside", "ps", "qs"]
    rows = rows.select(*columns).unionByName(hub_rows.select("sig", F.col("hub").alias("node"), F.col("hub_label").alias("label"), F.lit(True).alias("inside"), "ps", "qs"))
    # where a node goes: to one place, where an outsider is compared and then held, or as one that streams by
    # all parts of the outsiders and, if it is an outsider, as one that is held for all parts of the stream
    home = lambda n, k: F.pmod(F.xxhash64("node", F.lit(k)), F.col(n)).cast("int")
    place = lambda p, q, role: F.struct(p.alias("p"), q.alias("q"), F.lit(role).alias("role"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    stream = F.transform(every("qs"), lambda q: place(home("ps", 0), q, STREAMS))
    held = F.when(F.col("inside"), F.array().cast("array<struct<p:int,q:int,role:int>>")).otherwise(F.transform(every("ps"), lambda p: place(p, home("qs", 1), HELD)))
    alone = F.array(F.when(F.col("inside"), place(F.lit(0), F.lit(0), STREAMS)).otherwise(place(F.lit(0), F.lit(0), BOTH)))
    dealt = rows.select("sig", "node", "label", "inside", F.explode(F.when((F.col("ps") == 1) & (F.col("qs") == 1), alone).otherwise(F.concat(stream, held))).alias("at"))
    met = dealt.select("sig", "node", "label", "inside", "at.p", "at.q", "at.role").join(sketches, "node")
    met = met.repartition("sig", "p", "q").sortWithinPartitions("sig", "p", "q", "role", "node")
    return met.mapInArrow(_rest(percent, forest), "sig long, hub long, node long").distinct()


def all_stars(top: DataFrame, first: DataFrame) -> DataFrame:
    """(sig, hub, node, far) of all nodes of all buckets: those of a batch's star join the bucket of its hub."""
    over = top.select("sig", F.col("node").alias("hub"), F.col("hub").alias("_top"))
    return top.withColumn("far", F.lit(False)).unionByName(first.join(over, ["sig", "hub"], "left").select("sig", F.coalesce("_top", "hub").alias("hub"), "node", F.col("_top").isNotNull().alias("far")))


def link_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each row.

    Null and empty texts and texts without words have no shingles and are linked with nothing; a
    text of fewer than ``words`` words is one shingle. Rows with equal sets are linked. Rows that
    share a doc_id are one node of the result; a row with a null doc_id is returned with its
    n_shingles and a null component_id and links nothing. Other columns are ignored; an empty
    table gives an empty result.
    """
    clash, seed = True, -1
    while clash:  # two classes of one number (a chance of 2^-64 for each pair of them): all are numbered anew
        seed += 1
        rows = staged(index(docs, words, percent, seed).repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_buckets, ROWS), "jaccard-index")
        every = staged(rows.where("n is not null").select("doc_id", "node", "n", "check").repartition("doc_id"), "jaccard-documents")
        known = every.where("node is not null and doc_id is not null")
        reps = staged(known.groupBy("node").agg(F.min("doc_id").alias("rep"), (F.min("check") != F.max("check")).alias("clash")), "jaccard-reps")
        clash = not reps.where("clash").isEmpty()
        if clash:
            discard(rows, every, reps)

    top = staged(hubs(rows.where("n is null and hub is null").select("sig", "node")), "jaccard-top")
    first = rows.where("hub is not null").select(F.col("of").alias("sig"), "hub", "node")
    stars = staged(all_stars(top, first), "jaccard-stars")
    met = staged(top.select("hub", "node").unionByName(first.select("hub", "node")).distinct(), "jaccard-met")
    nodes = stars.select(F.explode(F.array("hub", "node")).alias("node")).distinct()
    held = rows.where("n is not null and doc_id is not null").join(reps.join(nodes, "node").select("node", F.col("rep").alias("doc_id")), ["node", "doc_id"])
    sketches = staged(held.dropDuplicates(["node"]).select("node", F.col("n").cast("int").alias("n"), "sketch"), "jaccard-sketches")
    discard(rows)

    pairs = staged(bounded(met, sketches, percent), "jaccard-pairs")
    links = staged(verified(pairs, docs, reps, words, percent, seed), "jaccard-links")
    labels, spent = components(links), [top, met, stars, sketches, pairs, links]
    left = stars
    for forest in (True, False):
        pairs = staged(rest_pairs(left, labels, sketches, percent, forest), "jaccard-pairs")
        spent.append(pairs)
        if pairs.isEmpty():
            break
        more = staged(verified(pairs.select("hub", "node").distinct(), docs, reps, words, percent, seed), "jaccard-links")
        spent.append(more)
        if not more.isEmpty():
            links = links.unionByName(more)
            spent.append(labels)
            labels = components(links)
        # where all of a bucket's forest is verified, no pair of it can join anything more
        failed = pairs.join(more.select(F.col("a").alias("hub"), F.col("b").alias("node")), ["hub", "node"], "left_anti").select("sig").distinct()
        left = staged(left.join(failed, "sig", "left_semi"), "jaccard-stars") if forest else None
        spent.append(left)

    of_class = reps.join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    smallest = of_class.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = staged(of_class.join(smallest, "label").select("node", "component_id"), "jaccard-components")
    discard(*spent, labels, reps)
    linked_docs = known.join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = every.where("node is null or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked_docs.unionByName(alone)


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, with all columns; cases as in link_components."""
    found = link_components(docs, words, percent)
    later = staged(found.where("component_id <> doc_id").select("doc_id").distinct(), "jaccard-later")
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)
