"""Packing: vector bin packing of token pieces into fixed sequences under limits on tokens, segments and loss-bearing tokens.

Each block of documents is packed where it lies, so nothing is shuffled and memory is bounded by the block. Whole chunks of the
capacity need no company and become sequences at once; what is left is a vector (tokens, 1 segment, loss-bearing tokens), and a bin
takes, of all that fit, the vector with the largest dot product with its remaining room. A gap that nothing fits is closed by a
cut where `cut` allows it. Strings of a tokenizer's added tokens in a text are those tokens, as the tokenizer reads them.
Edge cases: a null or empty text has only the closing id; a very long text becomes many whole sequences; of equal products the longer
piece is taken, then the first; empty tables give empty results; repeated rows are packed each; other columns are ignored; limits
below 1 are refused. Sequence ids are unique, not dense.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

CAPACITY, SEGMENTS, BLOCK = 1024, 128, 4096


def encoder(path: str):
    """text -> list of ids of the byte-level BPE at `path`; its merges as ranks give the same ids several times faster."""
    import json

    import public_tokenizers
    import tiktoken

    added: dict[str, int] = {}
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    else:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, added = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte[c] for c in token): k for token, k in vocab.items() if token not in added}
    coding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> list[int]:
        return coding.encode(text, allowed_special="all") if any(a in text for a in added) else coding.encode_ordinary(text)

    return encode


class Bins:
    """Packs pieces of at most `capacity` tokens; `out` collects (piece, start, length, sequence, offset)."""

    def __init__(self, capacity: int, segments: int, loss: int, cut: bool):
        self.capacity, self.segments, self.loss, self.cut = capacity, segments, loss, cut
        self.n = 0
        self.out: list[tuple[int, int, int, int, int]] = []

    def pack(self, items: list[tuple[int, int, int, float]]) -> None:
        """items: (piece, start, tokens, loss share). Equal vectors are one class, so a choice looks at classes, not items."""
        classes: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        for piece, start, tokens, share in items:
            classes.setdefault((tokens, int(round(tokens * share))), []).append((piece, start, share))
        limits = np.array([self.capacity, self.segments, self.loss], float)
        keys = list(classes)
        index = {k: i for i, k in enumerate(keys)}
        # cutting adds classes: room for one a piece
        size = len(keys) + sum(map(len, classes.values())) if self.cut else len(keys)
        vectors, left = np.zeros((size, 3)), np.zeros(size, np.int64)
        vectors[: len(keys)] = [(t, 1, x) for t, x in keys]
        left[: len(keys)] = [len(classes[k]) for k in keys]
        scaled = vectors / limits

        def take(i: int) -> tuple[int, int, float]:
            left[i] -= 1
            return classes[keys[i]].pop()

        remaining = int(left.sum())
        while remaining:
            n = len(keys)
            room, offset, sequence = limits.copy(), 0, self.n
            self.n += 1
            while room[0] > 0 and room[1] > 0 and remaining:
                fits = (left[:n] > 0) & (vectors[:n, 0] <= room[0]) & (vectors[:n, 2] <= room[2])
                # room and vectors as shares of the limits; of equal products the longer piece
                worth = scaled[:n] @ (room / limits) + vectors[:n, 0] * 1e-9
                i = int(np.where(fits, worth, -1.0).argmax())
                if fits[i]:
                    piece, start, _ = take(i)
                    remaining -= 1
                    self.out.append((piece, start, keys[i][0], sequence, offset))
                    room -= vectors[i]
                    offset += keys[i][0]
                    continue
                if not self.cut:
                    break
                # cut the piece with the largest product; its rest stays an item
                i = int(np.where(left[:n] > 0, worth, -1.0).argmax())
                share = classes[keys[i]][-1][2]
                t = min(int(room[0]), keys[i][0] - 1, int(room[2] / share) if share else keys[i][0])
                if t <= 0:
                    break
                piece, start, _ = take(i)
                self.out.append((piece, start, t, sequence, offset))
                room -= np.array([t, 1, round(t * share)], float)
                offset += t
                rest = (keys[i][0] - t, int(round((keys[i][0] - t) * share)))
                if rest not in index:
                    if n == len(vectors):
                        vectors, left, scaled = (np.concatenate([x, np.zeros_like(x)]) for x in (vectors, left, scaled))
                    index[rest] = n
                    keys.append(rest)
                    vectors[n] = (rest[0], 1, rest[1])
                    scaled[n] = vectors[n] / limits
                    n += 1
                classes.setdefault(rest, []).append((piece, start + t, share))
                left[index[rest]] += 1
            if not offset:
                raise ValueError(f"a piece of vector {keys[int(left.argmax())]} fits no sequence")

    def settle(self) -> None:
        """Split the last sequence of a block at powers of two, where cutting is allowed, so that its parts need no padding."""
        if not (self.cut and self.out):
            return
        last = self.n - 1
        tail = [x for x in self.out if x[3] == last]
        total = sum(x[2] for x in tail)
        if total == self.capacity or total & (total - 1) == 0:
            return
        self.out = [x for x in self.out if x[3] != last]
        self.n -= 1
        room, sequence, offset = 0, 0, 0
        for piece, start, length, _, _ in tail:
            while length:
                if not room:
                    room, sequence, offset = 1 << (total.bit_length() - 1), self.n, 0
                    self.n += 1
                    total -= room
                t = min(room, length)
                self.out.append((piece, start, t, sequence, offset))
                start, length, room, offset = start + t, length - t, room - t, offset + t


def pack_block(lengths: list[int], shares: list[float], capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int = CAPACITY, cut: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for each piece of a block, sequences from 0."""
    bins = Bins(capacity, segments, loss, cut)
    items = []
    for k, (n, share) in enumerate(zip(lengths, shares, strict=True)):
        chunk = capacity if not share else min(capacity, max(1, int(loss / share)))
        whole = n // chunk if chunk == capacity else 0
        for j in range(whole):
            bins.out.append((k, j * chunk, chunk, bins.n, 0))
            bins.n += 1
        for start in range(whole * chunk, n, chunk):
            items.append((k, start, min(chunk, n - start), share))
    bins.pack(items)
    bins.settle()
    return bins.out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", loss_share: Column | None = None, capacity: int = CAPACITY, segments: int = SEGMENTS, loss: int | None = None, cut: bool = True, block: int = BLOCK, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenizes, appends `end`, and packs blocks of `block` documents of a partition.

    loss_share: the share of a document's tokens that bear loss, 1 without it; loss: the limit of them in a sequence.
    with_ids adds the ids themselves as array<int>.
    """
    limit = capacity if loss is None else loss
    if min(capacity, segments, limit, block) < 1:
        raise ValueError("capacity, segments, loss and block must be 1 or more")
    share = F.lit(1.0) if loss_share is None else F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(loss_share.cast("double"), F.lit(1.0))))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def emit(ids, arrays, shares, first):
        pieces = pack_block([len(a) for a in arrays], shares, capacity, segments, limit, cut)
        cols: list[list] = [[] for _ in names]
        data = []
        for k, start, length, sequence, offset in pieces:
            part = arrays[k][start : start + length]
            for c, v in zip(cols, (ids[k], start, length, zlib.crc32(part.tobytes()), len(arrays[k]), first + sequence, offset), strict=True):
                c.append(v)
            if with_ids:
                data.append(part.astype(np.int32))
        out = [pa.array(c, pa.int64()) for c in cols]
        fields = [*names, "ids"] if with_ids else names
        return pa.RecordBatch.from_arrays(out + ([pa.array(data, pa.list_(pa.int32()))] if with_ids else []), fields), 1 + max(x[3] for x in pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        first = TaskContext.get().partitionId() << 40
        ids, arrays, shares, held = [], [], [], 0
        for b in batches:
            for d, t, s in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                a = np.array([*encode(t.as_py()), end], dtype="<u4")
                ids.append(d)
                arrays.append(a)
                shares.append(s)
                held += len(a)
                if len(ids) >= block or held >= block * 4096:
                    out, n = emit(ids, arrays, shares, first)
                    yield out
                    first += n
                    ids, arrays, shares, held = [], [], [], 0
        if ids:
            yield emit(ids, arrays, shares, first)[0]

    src = docs.select(docs[doc_id].cast("long").alias("doc_id"), text_of(docs[text]).alias("text"), share.alias("share"))
    return src.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def answer_share(text: Column) -> Column:
    """The share of a text that is answer: all but its first line, which is the prompt if the text has more lines; in quarters, two at least."""
    prompt = F.when(F.instr(text, "\n") > 0, F.length(F.substring_index(text, "\n", 1)) + 1).otherwise(0)
    return F.round(4 * F.greatest(F.lit(0.5), 1 - prompt / F.greatest(F.length(text), F.lit(1)))) / 4


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss-bearing tokens are those of the answer; with the capacity as their limit they choose pieces but never leave room unused."""
    docs = table(spark, sf_dir, "documents")
    return pack(docs, tokenizer_path(), loss_share=answer_share(text_of("text")))
