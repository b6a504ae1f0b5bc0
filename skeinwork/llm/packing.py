"""Best-fit packing of tokenised documents into sequences of a fixed length, improved by swap-based local search.

Documents are tokenised in Arrow batches; tokens of words are kept by word, as words repeat far more often than they are
new. Documents are cut into pieces; only documents longer than a sequence are cut. Pieces, now
a few numbers each, are dealt by hash into shards of about SHARD pieces. A shard is packed best fit, longest first; a
local search then tries to empty its least full sequences: a document moves to the fullest sequence with room for it, or
is exchanged for a shorter one there, or two documents are exchanged for one, always so that the sum of squared fills
grows. What is left in a shard's underfull sequence goes to the next round, in which the leftovers of all shards are
packed the same way, until one shard is left. Only numbers move between rounds, and every round is a written table.

Null texts count as empty and give one piece of the end token alone. Rows that repeat, rows of one doc_id and rows
without a doc_id are packed each on its own; an empty table gives no pieces. Extra columns aren't read.

Texts are taken whole, however long: a text of millions of words is that many more pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

LENGTH, END = 4096, 1
#: Pieces of a shard, on average.
SHARD = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Tokens:
    """Token ids of texts, as bytes of unsigned 32-bit numbers.

    A text that has only characters whose normal form, case and class are beyond doubt is split at white space, which no
    token crosses. Its chunks are numbered against the known ones, of which a bounded number is kept, and the ids are
    gathered by number; new chunks are tokenised some at once. Any other text, and any that holds one of the tokenizer's
    added tokens, goes through the tokenizer whole. Both ways give the same ids."""

    # The tokenizer's word pattern for lower-case text of these characters.
    PLAIN = re.compile(r"[\t\n\v\f\r\x20-\x7e\xa1-\xa7\xa9\xab\xac\xae\xb0\xb1\xb6\xb7\xbb\xbf-\xff\u2013\u2014\u2018\u2019\u201c\u201d\u2026]*")
    LETTERS = r"a-z\xdf-\xf6\xf8-\xff"
    WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\t\n\v\f\r 0-9{LETTERS}]+")
    MOST = 600_000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

        self._forget()

    def _forget(self) -> None:
        self.known, self.size, self.said = pa.array([], pa.large_string()), np.empty(0, np.int64), np.empty(0, "<u4")

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: pa.Array) -> None:
        """Ids of new chunks, of many at once with spaces between them, cut by the number of words in each."""
        said, size = [self.said], [self.size]
        for at in range(0, len(chunks), 128 * 64):
            texts = chunks.slice(at, 128 * 64).to_pylist()
            words = [len(self.WORD.findall(c.lower())) for c in texts]
            groups = range(0, len(texts), 128)
            for k, e in zip(groups, self.tokenizer.encode_batch([" ".join(texts[k : k + 128]) for k in groups], add_special_tokens=False)):
                # e.word_ids numbers the words of the group; its steps are where a word begins
                begins = np.flatnonzero(np.diff(np.array(e.word_ids, np.int64), prepend=-1))
                counts = np.cumsum([0, *words[k : k + 128]])
                if len(begins) == counts[-1]:
                    size.append(np.diff(np.append(begins, len(e.ids))[counts]))
                    said.append(np.array(e.ids, "<u4"))
                else:
                    each = self._ids(texts[k : k + 128])
                    size.append(np.array([len(x) // 4 for x in each], np.int64))
                    said.append(np.frombuffer(b"".join(each), "<u4"))
        self.known = pa.concat_arrays([self.known, chunks])
        self.size, self.said = np.concatenate(size), np.concatenate(said)

    def of(self, texts: list[str]) -> list[bytes]:
        plain = [self.PLAIN.fullmatch(t) and not any(a in t for a in self.added) for t in texts]
        if len(self.known) > self.MOST:
            self._forget()
        lists = pc.ascii_split_whitespace(pa.array([t if p else "" for t, p in zip(texts, plain)], pa.large_string()))
        chunks = lists.flatten().dictionary_encode()
        place = pc.index_in(chunks.dictionary, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = place < 0
        if new.any():
            place[new] = np.arange(len(self.known), len(self.known) + new.sum())
            self._learn(chunks.dictionary.filter(pa.array(new)))
        number = place[chunks.indices.to_numpy()]
        held = self.size[number]
        first, upto = (np.cumsum(self.size) - self.size)[number], np.concatenate([[0], np.cumsum(held)])
        said = self.said[np.arange(upto[-1]) + np.repeat(first - upto[:-1], held)].tobytes()
        ends = 4 * upto[lists.offsets.to_numpy()]
        whole = iter(self._ids([t for t, p in zip(texts, plain) if not p]))
        return [said[a:b] if p else next(whole) for p, a, b in zip(plain, ends.tolist(), ends[1:].tolist())]


_tokens: dict[str, Tokens] = {}


def _groups(column: pa.Array, most: int = 1 << 22) -> Iterator[tuple[list[int], list[str]]]:
    """Rows and texts, so many at once as hold about `most` characters; null texts are empty."""
    rows, texts, held = [], [], 0
    for row, x in enumerate(column):
        text = x.as_py() or ""
        rows.append(row)
        texts.append(text)
        held += len(text)
        if held >= most:
            yield rows, texts
            rows, texts, held = [], [], 0
    if rows:
        yield rows, texts


def _pieces(tokenizer: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens.get(tokenizer) or _tokens.setdefault(tokenizer, Tokens(tokenizer))
        last = end.to_bytes(4, "little")
        for batch in batches:
            docs, out = batch.column("doc_id"), []
            for rows, texts in _groups(batch.column("text")):
                for row, ids in zip(rows, tokens.of(texts)):
                    ids += last
                    for n, at in enumerate(range(0, len(ids), 4 * length)):
                        part = ids[at : at + 4 * length]
                        out.append((docs[row].as_py(), n, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), length, end), PIECES)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin with room for it."""
    bins: list[list[int]] = []
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    mask = 0  # bit r: there is a bin with room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        above = mask >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = rooms[r].pop()
            if not rooms[r]:
                mask &= ~(1 << r)
            bins[b].append(i)
            r -= n
        else:
            b, r = len(bins), size - n
            bins.append([i])
        if r:
            rooms[r].append(b)
            mask |= 1 << r
    return bins


class _Search:
    """Local search that empties bins. Bins with room are found by their room; full ones are left alone."""

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.bins, self.n, self.size = bins, lengths, size
        self.room = [size - sum(lengths[i] for i in b) for b in bins]
        self.open = sorted((r, b) for b, r in enumerate(self.room) if r)

    def _set(self, b: int, room: int) -> None:
        if self.room[b]:
            del self.open[bisect_left(self.open, (self.room[b], b))]
        self.room[b] = room
        if room and self.bins[b]:
            insort(self.open, (room, b))

    def _trade(self, a: int, out: list[int], b: int, back: list[int]) -> None:
        """Items `out` go from bin a to bin b, and `back` the other way."""
        gain = sum(self.n[i] for i in out) - sum(self.n[i] for i in back)
        self.bins[a] = [i for i in self.bins[a] if i not in out] + back
        self.bins[b] = [i for i in self.bins[b] if i not in back] + out
        ra, rb = self.room[a] + gain, self.room[b] - gain
        self._set(b, rb)
        if self.bins[a]:
            self._set(a, ra)
        else:
            self._set(a, 0)
            self.room[a] = self.size

    def _step(self, a: int, tries: int) -> bool:
        """One exchange that moves words from bin a into a fuller bin."""
        items = sorted(self.bins[a], key=lambda i: -self.n[i])
        for i in items:
            k = bisect_left(self.open, (self.n[i], -1))
            while k < len(self.open) and self.open[k][1] == a:
                k += 1
            if k < len(self.open):
                self._trade(a, [i], self.open[k][1], [])
                return True
        best = None
        for r, b in heapq.nlargest(tries, self.open):
            if b == a or self.size - r < self.size - self.room[a]:
                continue
            outs = [[i] for i in items] + [[i, j] for x, i in enumerate(items[:12]) for j in items[x + 1 : 12]]
            for out in outs:
                n = sum(self.n[i] for i in out)
                for j in self.bins[b]:
                    if 0 < n - self.n[j] <= r and (best is None or n - self.n[j] > best[0]):
                        best = (n - self.n[j], out, b, [j])
                # and one of a's for two of b's
                if len(out) == 1:
                    own = self.bins[b][:12]
                    for x, j in enumerate(own):
                        for k in own[x + 1 :]:
                            gain = n - self.n[j] - self.n[k]
                            if 0 < gain <= r and (best is None or gain > best[0]):
                                best = (gain, out, b, [j, k])
            if best and best[0] == r:
                break
        if not best:
            return False
        self._trade(a, best[1], best[2], best[3])
        return True

    def run(self, tries: int = 48, steps: int = 4000) -> list[list[int]]:
        total = sum(self.size - r for b, r in enumerate(self.room) if self.bins[b])
        least = -(-total // self.size)
        left = sum(1 for b in self.bins if b)
        while left > least and steps > 0 and self.open:
            a = self.open[-1][1]
            while self.bins[a] and steps > 0 and self._step(a, tries):
                steps -= 1
            if self.bins[a]:
                break
            left -= 1
        return [b for b in self.bins if b]


def pack_shard(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indices, packed best fit and then searched."""
    return _Search(best_fit(lengths, size), lengths, size).run()


def _pack(length: int, level: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        lengths = table["length"].to_pylist()
        shard = table["shard"][0].as_py()
        sequence, offset = [None] * len(lengths), [0] * len(lengths)
        bins = pack_shard(lengths, length)
        fill = [sum(lengths[i] for i in b) for b in bins]
        worst = min(range(len(bins)), key=lambda b: fill[b])
        for b, members in enumerate(bins):
            at = 0
            if b == worst and not last and fill[b] < length:
                continue
            for i in sorted(members):
                sequence[i], offset[i] = ((level << 54) | (shard << 20)) + b, at
                at += lengths[i]
        keep = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return keep.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return run


def pack(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """parts (as from pieces) with sequence_id and offset."""
    todo, done, level = stage(parts, "pack-pieces"), [], 0
    while True:
        n, held = todo.agg(F.count("*"), F.sum("length")).first()
        # a shard fills several sequences, so that most of its pieces are placed at this level
        shards = max(1, min(-(-n // SHARD), (held or 0) // (8 * length)))
        # rows are numbered where they stand in the written table, so equal and null ids spread like others
        key = F.pmod(F.xxhash64("doc_id", "piece", "start", F.monotonically_increasing_id(), F.lit(level)), F.lit(shards)).alias("shard")
        out = todo.select("doc_id", "piece", "start", "length", "ids_crc32", key).groupBy("shard").applyInArrow(_pack(length, level, shards == 1), PIECES + ", sequence_id long, offset long")
        out = stage(out, f"pack-level{level}")
        done.append(out.where("sequence_id IS NOT NULL"))
        if shards == 1:
            break
        todo, level = out.where("sequence_id IS NULL"), level + 1
    got = done[0]
    for x in done[1:]:
        got = got.unionByName(x)
    return got


def query(docs: DataFrame) -> DataFrame:
    """The contract of op6: one row per piece."""
    return pack(pieces(docs))
