"""Operator 3, byte-level BPE encoding and decoding through a global distinct-word shuffle.

1. Each task cuts its texts into pre-tokens, block by block. A block keeps each of its distinct
   words once, bundled by hash bucket, and in a header row its documents with the positions of
   those words (packed: the word's number at each position, frequent words first).
2. Bundles meet by bucket in one shuffle: all occurrences of a word, from all blocks, meet in one
   bucket, where each distinct word is encoded once and its ids join back to every bundle.
3. The ids travel back to their blocks, where they are put into their positions. Decoding looks
   every id up in the token-byte table (its size is the vocabulary's) and joins the bytes.

The texts themselves never move, and a frequent word travels once for each block.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back

#: Characters of text in one block; a longer text is a block of its own.
BLOCK_CHARS = 14_000_000
#: Hash buckets for each shuffle partition; a task holds the distinct words of one bucket at a time.
BUCKETS = 4

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"


def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def token_bytes(ranks: dict[bytes, int]) -> list[bytes]:
    """The token-byte table: id -> bytes."""
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, k in ranks.items():
        table[k] = token
    return table


class Splitter:
    """Pre-tokens by the vocabulary's pattern, as numbers of the words seen so far."""

    def __init__(self, pattern: str):
        import regex

        self.findall = regex.compile(pattern).findall
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}

    def numbers(self, text: str) -> np.ndarray:
        words, number = self.findall(text), self.number
        for w in set(words):
            if w not in number:
                number[w] = len(number)
        return np.fromiter(map(number.__getitem__, words), np.uint32, len(words))


def _planes(numbers: np.ndarray) -> bytes:
    """How many byte planes are in use, and those (little-endian bytes 0, then 1, ...), compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    used = 4
    while used > 1 and not planes[used - 1].any():
        used -= 1
    return bytes([used]) + zstandard.compress(planes[:used].tobytes(), 3)


def _unplanes(data: bytes, n: int) -> np.ndarray:
    used = data[0]
    planes = np.zeros((4, n), np.uint8)
    planes[:used] = np.frombuffer(zstandard.decompress(data[1:], max(1, used * n)), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(n)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 255 in a byte each; a 255 stands for a larger one, which follows in byte planes."""
    large = numbers[numbers >= 255]
    low = zstandard.compress(np.minimum(numbers, 255).astype(np.uint8).tobytes(), 3)
    return framed(low, number_bytes(len(large)), _planes(large))


def unpack(data: bytes, n: int) -> np.ndarray:
    low, many, rest = unframed(data)
    out = np.frombuffer(zstandard.decompress(low, max(1, n)), np.uint8).astype("<u4")
    out[out == 255] = _unplanes(rest, int.from_bytes(many, "little"))
    return out


def framed(*parts: bytes) -> bytes:
    """The parts one after the other, each behind its length."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unframed(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def number_bytes(n: int) -> bytes:
    return n.to_bytes(8, "little")


def bundle(pieces: list[bytes]) -> bytes:
    """Byte strings, as their lengths and one compressed run."""
    lens = np.array([len(p) for p in pieces], np.uint32)
    run = b"".join(pieces)
    return framed(number_bytes(len(pieces)), pack(lens), number_bytes(len(run)), zstandard.compress(run, 6))


def unbundle(data: bytes) -> tuple[bytes, np.ndarray]:
    """The run and the lengths."""
    n, lens, size, run = unframed(data)
    return zstandard.decompress(run, max(1, int.from_bytes(size, "little"))), unpack(lens, int.from_bytes(n, "little"))


def clean(text: str | None) -> str:
    """Null as empty; lone surrogates as U+FFFD, which UTF-8 can hold."""
    if not text:
        return ""
    try:
        text.encode("utf-8")
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def _blocks(pattern: str, block_chars: int, buckets: int):
    """mapInPandas: documents -> each block's header row (bucket null) and its bundles of words."""

    def run(frames):
        split, part, seq = Splitter(pattern), TaskContext.get().partitionId(), 0
        held, chars = [], 0

        def flush():
            nonlocal held, chars, seq
            # frequent words get small numbers, which pack well
            every = np.concatenate([ids for _, ids in held])
            words = list(split.number)
            split.reset()
            count = np.bincount(every, minlength=len(words))
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            words = [words[i].encode() for i in order]
            home = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in words), np.uint32, len(words))
            doc_ids = [d for d, _ in held]
            known = np.array([0 if d is None else int(d) for d in doc_ids], "<i8")
            missing = np.array([d is None for d in doc_ids], np.uint8)
            lens = np.array([len(i) for _, i in held], "<i8")
            block = f"{part}-{seq}"
            head = framed(known.tobytes(), missing.tobytes(), lens.tobytes(), number_bytes(len(words)), pack(home), pack(rank[every]))
            rows = [(block, None, head)]
            by_home = np.argsort(home, kind="stable")
            cuts = np.flatnonzero(np.diff(home[by_home])) + 1
            for own in np.split(by_home, cuts) if len(words) else []:
                rows.append((block, int(home[own[0]]), bundle([words[i] for i in own])))
            held, chars, seq = [], 0, seq + 1
            return pd.DataFrame(rows, columns=["block", "bucket", "data"]).astype({"bucket": "Int32"})

        for frame in frames:
            for doc_id, text in zip(frame["doc_id"].astype("object"), frame["text"], strict=True):
                text = clean(text)
                if held and chars + len(text) > block_chars:
                    yield flush()
                    give_back()
                held.append((None if pd.isna(doc_id) else doc_id, split.numbers(text)))
                chars += len(text)
        if held:
            yield flush()

    return run


def _encode_words(path: str, pattern: str):
    """mapInPandas over rows sorted by bucket: each distinct word of a bucket is encoded once, its ids join every bundle."""

    def run(frames):
        import tiktoken

        ranks = vocabulary(path)
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        bucket, ids_of = None, {}
        for frame in frames:
            made = []
            for b, data in zip(frame["bucket"].astype("object"), frame["data"], strict=True):
                if pd.isna(b):
                    made.append(data)  # a header passes through
                    continue
                if b != bucket:
                    bucket, ids_of = b, {}
                words, lens = unbundle(data)
                out, at = [], 0
                for n in lens.tolist():
                    w = words[at : at + n]
                    at += n
                    ids = ids_of.get(w)
                    if ids is None:
                        one = ranks.get(w)
                        ids = ids_of[w] = np.array([one] if one is not None else encode(w), "<u4").tobytes()
                    out.append(ids)
                size = np.array([len(x) // 4 for x in out], np.uint32)
                made.append(framed(number_bytes(len(out)), pack(size), pack(np.frombuffer(b"".join(out), "<u4"))))
            yield pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "data": made})

    return run


def _reassemble(path: str, keep_ids: bool):
    """applyInPandas over one block: its header and its bundles' ids -> its documents."""
    tables: dict[str, list[bytes]] = {}

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if path not in tables:
            tables[path] = token_bytes(vocabulary(path))
        table = tables[path]
        is_head = frame["bucket"].isna().to_numpy()
        known, missing, lens, n_words, home, numbers = unframed(frame["data"][is_head].iloc[0])
        known, missing, lens = np.frombuffer(known, "<i8"), np.frombuffer(missing, np.uint8).astype(bool), np.frombuffer(lens, "<i8")
        n_words = int.from_bytes(n_words, "little")
        home, numbers = unpack(home, n_words), unpack(numbers, int(lens.sum()))
        # bundles hold their bucket's words in the order of the block's numbers
        by_home = np.argsort(home, kind="stable")
        size, pieces, at = np.zeros(n_words, np.int64), [], 0
        for _, data in sorted(zip(frame["bucket"][~is_head].astype(int), frame["data"][~is_head], strict=True)):
            n, sizes, ids = unframed(data)
            n = int.from_bytes(n, "little")
            sizes = unpack(sizes, n)
            size[by_home[at : at + n]] = sizes
            pieces.append(unpack(ids, int(sizes.sum())))
            at += n
        flat = np.concatenate(pieces) if pieces else np.zeros(0, "<u4")
        del pieces
        give_back()
        begin = np.empty(n_words, np.int64)
        begin[by_home] = np.cumsum(size[by_home]) - size[by_home]
        out, at = [], 0
        for n in lens.tolist():
            mine = numbers[at : at + n]
            at += n
            many = size[mine]
            total = int(many.sum())
            # the ids of every word, put one after the other at the words' positions
            ids = flat[np.arange(total) + np.repeat(begin[mine] - (np.cumsum(many) - many), many)]
            raw, decoded = ids.tobytes(), b"".join(map(table.__getitem__, ids.tolist()))
            out.append((total, hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest(), len(decoded), raw if keep_ids else None))
        made = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "ids"])
        made.insert(0, "doc_id", pd.array(known, dtype="Int64"))
        made.loc[missing, "doc_id"] = pd.NA
        return made if keep_ids else made.drop(columns="ids")

    return run


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, *, keep_ids: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Token ids of each row of (doc_id, text), and their decoding.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, and with ``keep_ids`` the ids
    themselves (``ids`` binary, little-endian unsigned 32-bit). The vocabulary's path must hold
    on every executor.

    Null and empty texts have no tokens and the digests of the empty string. Lone surrogates
    count as U+FFFD. Rows keep their own results: repeated rows repeat, null doc_ids stay null;
    other columns are ignored, an empty table gives an empty result. A block's name holds on a
    retry as long as the input's partitions hold the same rows in the same order, as those of
    stored files do.
    """
    if not (path and pattern):
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = docs.select("doc_id", "text").mapInPandas(_blocks(pattern, block_chars, buckets), "block string, bucket int, data binary")
    # headers spread by block, words meet by bucket
    met = blocks.repartition(F.coalesce("bucket", F.xxhash64("block"))).sortWithinPartitions("bucket")
    coded = met.mapInPandas(_encode_words(path, pattern), "block string, bucket int, data binary")
    schema = ENCODED + (", ids binary" if keep_ids else "")
    return coded.groupBy("block").applyInPandas(_reassemble(path, keep_ids), schema)
