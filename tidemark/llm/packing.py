"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A length r belongs to class k when capacity / (k + 1) < r <= capacity / k, and a bin of class k takes exactly k
pieces, so every bin fits by construction and workers never need to look at each other. Documents are cut so that
most tokens fall into pieces of exactly capacity / k (k = 1, 2, 4, 8), whose bins have no padding at all; only what
remains below capacity / 8 is packed by the general rule, which has about twice the square root of the capacity classes
down to pieces of one token. What a worker's open bins hold at its end is packed first fit, longest first.

Ids come from the vocabulary file of a `tokenizers` tokenizer. Where that file describes a plain byte-level BPE (the
usual split, no normaliser, merges in the order of their ids), tiktoken computes the same ids four times faster. Texts
that hold the string of an added token, texts on which its regular expression gives up (a million white-space
characters in a row exceed its stack), and other vocabularies go through `tokenizers` itself.

Edge cases: a null text counts as empty; an empty text is the end id alone; repeated rows are packed each; ids may be
of any type or null; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common as C

CAPACITY = 2048
#: The vocabulary file of the query; workers look for it themselves.
TOKENIZER = "byte_bpe_50k.json"
#: The split pattern of the byte-level BPE, a fixed value of the public tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _bytes_of_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes are themselves, others follow 0xFF."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _is_plain(spec: dict) -> bool:
    """Whether the file describes the byte-level BPE that tiktoken computes: one pattern, ranks that are ids."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    whole = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model.get("type") != "BPE" or not usual or not whole or spec.get("normalizer"):
        return False
    ids = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    return all(a < b for a, b in zip(ids[:-1], ids[1:], strict=True))


@lru_cache(2)
def encoder(path: str):
    """A function from a text to its ids as an array. A path without a folder names a file of the public tokenizers."""
    from tokenizers import Tokenizer

    path = path if "/" in path else tokenizer_path(path)

    slow = Tokenizer.from_file(path)
    exact = lambda s: np.array(slow.encode(s, add_special_tokens=False).ids, np.uint32)
    try:
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        if not _is_plain(spec):
            return exact
        added = [t["content"] for t in spec.get("added_tokens", [])]
        letters = _bytes_of_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        fast = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    except (ImportError, KeyError, AttributeError):
        return exact

    def encode(s: str) -> np.ndarray:
        if any(t in s for t in added):
            return exact(s)
        try:
            return fast.encode_to_numpy(s, disallowed_special=())
        except ValueError:  # the regular expression's stack
            return exact(s)

    return encode


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order: 1/1, 1/2, 1/4 and 1/8 of the capacity, and the rest."""
    out = [capacity] * (n // capacity)
    n %= capacity
    for part in (capacity // 2, capacity // 4, capacity // 8):
        if n >= part:
            out.append(part)
            n -= part
    return [*out, n] if n else out


def pack(pieces: Iterator[tuple], capacity: int = CAPACITY) -> Iterator[list[tuple]]:
    """Bins of pieces; a piece is any tuple whose third value is its length."""
    bins: dict[int, list] = {}
    for p in pieces:
        k = capacity // p[2]
        own = bins.setdefault(k, [])
        own.append(p)
        if len(own) == k:
            yield own
            bins[k] = []
    left: list[tuple[int, list]] = []  # room, pieces
    for p in sorted((p for own in bins.values() for p in own), key=lambda p: -p[2]):
        for i, (room, own) in enumerate(left):
            if room >= p[2]:
                own.append(p)
                left[i] = (room - p[2], own)
                break
        else:
            left.append((capacity - p[2], [p]))
    yield from (own for _, own in left)


NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


def pack_batches(path: str, capacity: int, end_id: int, batches: Iterator[pa.RecordBatch], keep_ids: bool = False) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    kind = None

    def pieces():
        nonlocal kind
        for batch in batches:
            kind = batch.column("doc_id").type
            texts = batch.column("text")
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                ids = np.append(encode(texts[i].as_py() or ""), np.uint32(end_id)).astype("<u4")
                at = 0
                for n in cuts(len(ids), capacity):
                    own = ids[at : at + n].tobytes()
                    yield (doc, at, n, zlib.crc32(own), len(ids), *([own] * keep_ids))
                    at += n

    task = TaskContext.get()
    sequence = (task.partitionId() if task else 0) << 36
    rows: list[tuple] = []
    for own in pack(pieces(), capacity):
        at = 0
        for p in own:
            rows.append((*p, sequence, at))
            at += p[2]
        sequence += 1
        if len(rows) >= (200 if keep_ids else 8192):
            yield _batch(rows, keep_ids, kind)
            rows = []
    if rows:
        yield _batch(rows, keep_ids, kind)


def _batch(rows: list[tuple], keep_ids: bool, kind: pa.DataType) -> pa.RecordBatch:
    names = [*NAMES, *(["ids"] if keep_ids else []), "sequence_id", "offset"]
    columns = dict(zip(names, zip(*rows, strict=True), strict=True))
    kinds = {n: pa.binary() if n == "ids" else kind if n == "doc_id" else pa.int64() for n in names}
    return pa.RecordBatch.from_pydict({n: pa.array(columns[n], kinds[n]) for n in names})


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence; with keep_ids also its ids as bytes."""
    if capacity < 8 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two, 8 at least")
    C.tune(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]
    ids = "ids binary, " if keep_ids else ""
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, {ids}sequence_id long, offset long"
    narrow = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    return narrow.mapInArrow(lambda it: pack_batches(tokenizer, capacity, end_id, it, keep_ids), schema)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(C.load(spark, sf_dir, "documents"), TOKENIZER)
