"""Exact n-gram Jaccard join with set-relation skipping.

A document's set is its distinct word n-grams; documents link when their Jaccard similarity reaches the threshold. The
join is exact and returns classes and components, never all pairs of a group:

1. Sketch. Counts of n-grams by hash bin over all documents flag the bins of frequent n-grams: those well over the noise
   of a bin. The sketch has 2^19 bins at any input size, so with more input only more frequent n-grams stand out; it
   orders prefixes, and no bound rests on it.
2. Prefixes. Sets are ordered by (flagged, hash). Under any order, sets that link share l n-grams or more in the first
   n - ceil(t n) + l of each; l grows with the set, so that a shared passage alone seldom reaches it, and with frequent
   n-grams last, common passages rarely are among these. Equal sets become one class.
3. Index. Lists of the prefix n-grams: these are counted first, pre-aggregated, and joined with their counts, which
   splits hot lists. Lists with the same members count once.
4. Candidates. Lists of up to SMALL sets give pairs that fit by size and position and can share l n-grams, counting for
   the longer lists the most that both sets have there. A pair that meets in longer lists alone shares l n-grams in them:
   these lists tie together only the sets that have so many there. Candidate groups are the components of both.
5. A group's sets are dealt by size class and hash into blocks of bounded size; only blocks of the same or the next size
   class meet, and a small group is one block. In a block one set is the representative r, and every other set is kept
   as its difference from r: with R the n-grams of r that x lacks and A those it has besides,
   |x n y| = |r| - |Rx| - |Ry| + |Rx n Ry| + |Ax n Ay|. So a set's overlaps follow from those of r and short differences.
   A block returns a spanning forest of its links. Texts of candidate sets are read again through a filter of their ids,
   whose size follows their number.

N-grams are 64-bit hashes; two n-grams of one pair of documents meet by chance once in about 10^13 pairs.

Null and blank texts have empty sets and link with nothing. Rows that share a doc_id are one vertex; rows with a null
doc_id have no links and no component. An empty table gives an empty result. Extra columns aren't read; keep_one carries
them along, whatever they are called.

Texts are taken whole, however long: a set is as large as its text makes it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.connected import components
from .common import SPACE, bitmap, free_name, stage

#: Bits of a sketch bin.
BITS = 19
#: Bits of the filter by which the texts of candidate sets are read again: the least, and the most (16 MB).
FILTER = (16, 27)
#: Members of a list whose pairs are candidates one by one.
SMALL = 48
#: Sets and n-grams of a block, on average.
BLOCK_SETS, BLOCK_GRAMS = 512, 200_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class _Hashes(dict):
    """word: 64-bit hash, kept while the worker lives, up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_hashes = _Hashes()


def gram_set(text: str | None, width: int = 4) -> np.ndarray:
    """Sorted distinct hashes (uint64) of a text's word n-grams; the whole sequence is one n-gram if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(a))
    h = np.full(len(a) - k + 1, (0x9E3779B97F4A7C15 * k) % (1 << 64), np.uint64)
    for i in range(k):
        h = (h ^ a[i : len(a) - k + 1 + i]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _need(n: int, percent: int) -> int:
    """The least overlap that a set of n needs with any other."""
    return -(-percent * n // 100)


def _least(n: int, percent: int) -> int:
    """The n-grams that a set of n shares with any set it links with, within their prefixes."""
    return min(_need(n, percent), 3 + n // 40)


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                np.add.at(counts, (gram_set(text.as_py(), width) >> np.uint64(64 - BITS)).astype(np.int64), 1)
        (bins,) = np.nonzero(counts)
        for i in range(0, len(bins), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(bins[i : i + 50_000]), pa.array(counts[bins[i : i + 50_000]])], ["bin", "n"])

    return run


def _prefixes(width: int, percent: int, flags: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        flagged = np.unpackbits(np.frombuffer(flags, np.uint8)).astype(bool)
        for batch in batches:
            sizes, one, two, prefixes = [], [], [], []
            for text in batch.column("text"):
                h = gram_set(text.as_py(), width)
                n = len(h)
                late = flagged[(h >> np.uint64(64 - BITS)).astype(np.int64)]
                d = xxhash.xxh3_128_digest(h.tobytes())
                sizes.append(n)
                one.append(int.from_bytes(d[:8], "big", signed=True))
                two.append(int.from_bytes(d[8:], "big", signed=True))
                prefixes.append(np.concatenate([h[~late], h[late]])[: n - _need(n, percent) + _least(n, percent)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), _lists(prefixes)], ["doc_id", "n", "d1", "d2", "prefix"])

    return run


def _place(ids: np.ndarray, bits: int) -> np.ndarray:
    """Places of ids in a filter."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _marks(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_place(batch.column("doc_id").to_numpy(zero_copy_only=False), bits)))], ["place"])

    return run


def _sets(width: int, bits: int, wanted: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.unpackbits(np.frombuffer(zlib.decompress(wanted), np.uint8)).astype(bool)
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            batch = batch.filter(pa.array(marked[_place(batch.column("doc_id").to_numpy(), bits)]))
            sets = [gram_set(x.as_py(), width) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int32()), _lists(sets)], ["doc_id", "n", "grams"])

    return run


def differences(sizes: np.ndarray, offsets: np.ndarray, grams: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(|Rx|, Dx) of sets and a representative: how many n-grams of the representative a set lacks, and all n-grams in
    which the two differ."""
    lacks, out = np.empty(len(sizes), np.int64), []
    for i in range(len(sizes)):
        x = grams[offsets[i] : offsets[i + 1]]
        d = np.setxor1d(x, rep, assume_unique=True)
        # |Dx| = |Rx| + |Ax| and |Ax| - |Rx| = |x| - |r|
        lacks[i] = (len(d) - (len(x) - len(rep))) // 2
        out.append(d)
    return lacks, out


def links_of_block(ids: np.ndarray, sizes: np.ndarray, lacks: np.ndarray, rep_size: int, offsets: np.ndarray, grams: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets of a block, as (id, smaller id). grams are the differences of the
    sets from one representative."""
    m = len(ids)
    uniq, column = np.unique(grams, return_inverse=True)
    row = np.repeat(np.arange(m), np.diff(offsets))
    held = np.bincount(column, minlength=len(uniq))
    wide = held > max(16, m // 16)
    both = np.zeros((m, m), np.float32)
    # n-grams in which many sets differ: dense products, some columns at a time
    (dense,) = np.nonzero(wide)
    place = np.full(len(uniq), -1)
    for i in range(0, len(dense), 2048):
        part = dense[i : i + 2048]
        place[part] = np.arange(len(part))
        d = np.zeros((m, len(part)), np.float32)
        at = place[column]
        d[row[at >= 0], at[at >= 0]] = 1
        both += d @ d.T
        place[part] = -1
    # the others: pairs of the few sets that differ in each
    few = ~wide & (held >= 2)
    rows, cols = row[few[column]], column[few[column]]
    order = np.lexsort((rows, cols))
    rows, cols = rows[order], cols[order]
    for shift in range(1, int(held[few].max(initial=0))):
        same = cols[shift:] == cols[:-shift]
        if not same.any():
            break
        a, b = rows[:-shift][same], rows[shift:][same]
        np.add.at(both, (a, b), 1)
        np.add.at(both, (b, a), 1)
    size = sizes.astype(np.int64)
    common = rep_size - lacks[:, None].astype(np.int64) - lacks[None, :].astype(np.int64) + both.astype(np.int64)
    union = size[:, None] + size[None, :] - common
    linked = (100 * common >= percent * union) & (size[:, None] > 0) & (size[None, :] > 0)
    np.fill_diagonal(linked, True)
    label = np.arange(m)
    by_id = np.argsort(ids, kind="stable")
    rank = np.empty(m, np.int64)
    rank[by_id] = np.arange(m)
    label = rank.copy()
    while True:
        new = np.where(linked, label[None, :], m).min(1)
        new = np.minimum(new, label)
        root = by_id[new]
        new = np.minimum(new, new[root])
        if (new == label).all():
            break
        label = new
    return [(int(ids[i]), int(ids[by_id[label[i]]])) for i in range(m) if label[i] != rank[i]]


def _numbers(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a column of lists."""
    n = lists.combine_chunks()
    values = n.flatten().to_numpy()
    return np.concatenate([[0], np.cumsum(pc.list_value_length(n).to_numpy(), dtype=np.int64)]), values


def _links(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})


def _group(percent: int):
    """Links of a small group: its largest set is the representative."""

    def run(table: pa.Table) -> pa.Table:
        ids, sizes = table["doc_id"].to_numpy(), table["n"].to_numpy()
        offsets, grams = _numbers(table["grams"])
        r = int(np.argmax(sizes))
        rep = grams[offsets[r] : offsets[r + 1]]
        lacks, d = differences(sizes, offsets, grams, rep)
        at = np.concatenate([[0], np.cumsum([len(x) for x in d])])
        return _links(links_of_block(ids, sizes, lacks, len(rep), at, np.concatenate(d), percent))

    return run


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("rep").to_numpy(zero_copy_only=False)
        offsets, grams = _numbers(pa.chunked_array([batch.column("grams")]))
        lacks, out = [], []
        for i, rep in enumerate(lists):
            x = grams[offsets[i] : offsets[i + 1]]
            k, d = differences(np.array([len(x)]), np.array([0, len(x)]), x, rep)
            lacks.append(int(k[0]))
            out.append(d[0].view(np.uint64))
        sizes = pa.array([len(r) for r in lists], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("doc_id"), batch.column("n"), batch.column("size"), pa.array(lacks, pa.int32()), sizes, _lists(out)], ["group", "doc_id", "n", "size", "lacks", "rep_size", "grams"])


def _block(percent: int):
    def run(table: pa.Table) -> pa.Table:
        offsets, grams = _numbers(table["grams"])
        found = links_of_block(table["doc_id"].to_numpy(), table["n"].to_numpy(), table["lacks"].to_numpy(), table["rep_size"][0].as_py(), offsets, grams, percent)
        return _links(found)

    return run


def link_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n, component_id, class_id) for every row of docs(doc_id, text); class_id is the smallest doc_id with the
    same set, and component_id the smallest doc_id that links reach, itself included."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bins = text.select("text").mapInArrow(_sketch(width), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    bins = stage(bins, "ngram-sketch", batch=2000)
    mean = (bins.agg(F.sum("n")).first()[0] or 0) / (1 << BITS)
    flags = np.zeros(1 << BITS, bool)
    flags[[r[0] for r in bins.where(F.col("n") > mean + 6 * mean**0.5 + 12).select("bin").collect()]] = True
    marked = stage(text.mapInArrow(_prefixes(width, percent, np.packbits(flags).tobytes()), "doc_id long, n int, d1 long, d2 long, prefix array<long>"), "ngram-prefixes", batch=2000)

    key = ["n", "d1", "d2"]
    classes = stage(marked.where("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("class_id")), "ngram-classes")
    reps = marked.join(classes, [*key]).where("doc_id = class_id").select(F.col("doc_id").alias("id"), "prefix")
    posts = reps.select("id", F.posexplode("prefix").alias("pos", "gram"))
    lists = posts.groupBy("gram").agg(F.count("*").alias("members")).where("members > 1")
    posts = stage(posts.join(lists, "gram"), "ngram-lists")

    # sets with fewer shared n-grams than any link needs are out
    sizes = classes.select(F.col("class_id").alias("id"), "n").distinct()
    least_of = lambda n: F.least(F.ceil(F.lit(percent) * n / 100), 3 + F.floor(n / 40))
    met = posts.groupBy("id").agg(F.count("*").alias("hits")).join(sizes, "id").where(F.col("hits") >= least_of(F.col("n"))).select("id", "n")
    posts = stage(posts.join(met, "id"), "ngram-candidates")

    # a list with the same members as another is skipped
    digest = [F.sum(F.xxhash64("id") % (1 << 40)).alias("h1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("h2"), F.count("*").alias("m")]
    small = posts.where(F.col("members") <= SMALL)
    kept = small.groupBy("gram").agg(*digest).where("m > 1").groupBy("m", "h1", "h2").agg(F.min("gram").alias("gram"), F.count("*").alias("times")).select("gram", "times")
    small = small.join(kept, "gram")
    large = posts.where(F.col("members") > SMALL).select("id", "n", "gram")
    # in_large: how many of a set's prefix n-grams have long lists
    in_large = large.groupBy("id").agg(F.count("*").alias("in_large"), F.min("n").alias("n"))
    # two sets that share no short list share l n-grams or more in long ones, so both have that many there
    alone = in_large.where(F.col("in_large") >= least_of(F.floor(F.col("n") * percent / 100))).select("id")
    large = large.join(alone, "id").select("id", "gram")
    heads = large.groupBy("gram").agg(F.min("id").alias("v"))
    ties = large.join(heads, "gram").select(F.col("id").alias("u"), "v").distinct()

    x, y = small.alias("x"), small.alias("y")
    least = F.ceil(F.lit(percent) * (F.col("x.n") + F.col("y.n")) / F.lit(100.0 + percent) - 1e-9)
    # an n-gram at places i and j leaves room for an overlap of min(i, j) before it and the shorter rest from it on
    room = F.least("x.pos", "y.pos") + F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    first = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    fits = first & (F.col("x.n") * 100 >= F.col("y.n") * percent) & (room >= least)
    pairs = x.join(y, F.col("x.gram") == F.col("y.gram")).where(fits).select(F.col("x.id").alias("u"), F.col("y.id").alias("v"), F.col("x.n").alias("n"), F.col("x.times").alias("times"))
    # what a pair shares in long lists is at most what either set has there
    most = lambda side: in_large.select(F.col("id").alias(side), F.col("in_large").alias(f"in_{side}"))
    pairs = pairs.groupBy("u", "v").agg(F.sum("times").alias("times"), F.min("n").alias("n")).join(most("u"), "u", "left").join(most("v"), "v", "left")
    besides = F.least(F.coalesce("in_u", F.lit(0)), F.coalesce("in_v", F.lit(0)))
    pairs = pairs.where(F.col("times") + besides >= least_of(F.col("n"))).select("u", "v")
    groups = components(pairs.unionByName(ties), lambda e: stage(e, "ngram-groups"))
    groups = stage(groups.select(F.col("v").alias("id"), F.col("component").alias("group")), "ngram-group")

    # which sets form a small group, worked out on numbers alone; others are large
    placed = groups.join(sizes, "id")
    totals = placed.groupBy("group").agg(((F.count("*") <= BLOCK_SETS) & (F.sum("n") <= BLOCK_GRAMS)).alias("one"))
    placed = stage(placed.select("id", "group").distinct().join(totals, "group"), "ngram-placed")

    # the sets of placed ids, with their groups; what passes the filter by chance finds no group. A doc_id that is
    # repeated with other texts has several sets; each is one of this vertex
    bits = min(FILTER[1], max(FILTER[0], (8 * placed.count()).bit_length()))
    marks = placed.select(F.col("id").alias("doc_id")).mapInArrow(_marks(bits), "place long")
    wanted = zlib.compress(np.packbits(bitmap(marks, F.col("place"), bits)).tobytes())
    read = text.mapInArrow(_sets(width, bits, wanted), "doc_id long, n int, grams array<long>").where("n > 0")
    sets = stage(read.join(placed, read["doc_id"] == placed["id"]).select("group", "one", "doc_id", "n", "grams"), "ngram-sets", batch=1000)

    small_links = sets.where("one").groupBy("group").applyInArrow(_group(percent), "u long, v long")
    small_links = stage(small_links, "ngram-small", batch=1000)
    # a large group's sets are sent around as their differences from the set of its least doc_id
    whole = sets.where("NOT one").drop("one")
    reps = whole.where("doc_id = group").dropDuplicates(["group"]).select("group", F.col("grams").alias("rep"))
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int").alias("size")
    rows = whole.join(reps, "group").select("group", "doc_id", "n", size, "grams", "rep").mapInArrow(_differ, "group long, doc_id long, n int, size int, lacks int, rep_size int, grams array<long>")
    rows = stage(rows, "ngram-differences", batch=200)
    blocks = rows.groupBy("group", "size").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum(F.size("grams")) / BLOCK_GRAMS)).cast("int").alias("parts"))
    blocks = stage(blocks, "ngram-blocks")
    parts = lambda by, name: blocks.select("group", (F.col("size") - by).alias("size"), F.col("parts").alias(name))
    rows = rows.join(parts(0, "p0").join(parts(1, "p1"), ["group", "size"], "left").join(parts(-1, "pm"), ["group", "size"], "left"), ["group", "size"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("p0")).cast("int"))
    meet = lambda c, i, k, j: F.struct(c.alias("c"), i.alias("i"), F.lit(k).alias("k"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), n - 1, F.lit(1))
    some = lambda n, f: F.when(n > 0, F.transform(upto(n), f)).otherwise(F.array().cast("array<struct<c:int,i:int,k:int,j:int>>"))
    with_own = some(F.col("p0"), lambda q: meet(F.col("size"), F.least(F.col("own"), q), 0, F.greatest(F.col("own"), q)))
    with_next = some(F.col("p1"), lambda q: meet(F.col("size"), F.col("own"), 1, q))
    with_last = some(F.col("pm"), lambda q: meet(F.col("size") - 1, q, 1, F.col("own")))
    told = ["doc_id", "n", "lacks", "rep_size", "grams"]
    dealt = rows.select("group", *told, F.explode(F.concat(with_own, with_next, with_last)).alias("m")).select("group", "m.*", *told)
    block_links = dealt.groupBy("group", "c", "i", "k", "j").applyInArrow(_block(percent), "u long, v long").unionByName(small_links)

    by_class = marked.join(classes.select(*key, "class_id"), key, "left").select("doc_id", "n", "class_id")
    several = by_class.where("class_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("a <> b").select("doc_id")
    same = by_class.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("class_id").alias("v")).where("v IS NOT NULL")
    found = components(block_links.unionByName(same), lambda e: stage(e, "ngram-links")).select(F.col("v").alias("class_id"), F.col("component"))
    out = by_class.join(found, "class_id", "left")
    return out.select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "class_id", "doc_id").alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    """The contract of op1: one row per document."""
    got = link_components(docs)
    return got.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each component the document with the smallest doc_id stays, and of repeated rows
    with that doc_id one. Documents without words are nobody's copies and all stay, as do rows with a null doc_id."""
    own, rank = free_name(docs, "near_own"), free_name(docs, "near_rank")
    kept = link_components(docs, width, percent).where("n > 0 AND component_id = doc_id").select(F.col("doc_id").alias(own)).distinct()
    blank = F.length(F.translate(F.coalesce("text", F.lit("")), SPACE, "")) == 0
    rows = docs.join(kept, F.col("doc_id").cast("long") == F.col(own), "left").where(F.col(own).isNotNull() | blank | F.col("doc_id").isNull())
    # rows of one doc_id are told apart by their text; the blank ones, and those without an id, all stay and are spread
    spread = F.when(F.col("doc_id").isNull() | blank, F.monotonically_increasing_id())
    rows = rows.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", spread).orderBy("text")))
    return rows.where((F.col(rank) == 1) | blank | F.col("doc_id").isNull()).select(*docs.columns)
