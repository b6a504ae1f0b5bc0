"""Personal data by base patterns and bootstrapped contexts.

Base spans (email, ip, card, phone) are found by fixed patterns in whole texts, in time linear in the text. The bootstrap
works on the words around identifiers: an instance is a run of tokens with digits outside base spans, joined by single
spaces, brackets or hyphens, of LEAST characters or more in all, or a base span itself; a pattern is the word before an
instance (a key, as in key=value), or the two words before it. Identifiers without any digit are no instances. The seeds
are the base spans, access key ids, and hex values that are quoted or assigned; seeds are spans themselves, and what the
patterns find beyond them are the discoveries.

A pattern-instance graph of the whole corpus is scored in rounds in Spark. The confidence of a pattern in a kind is the
belief in the instances that it stands before, over all of the pattern's occurrences in the corpus, whatever follows
them; so a common word that happens to stand before some identifiers is no pattern. Instances of unknown kind, which are
what patterns are to find, count against a pattern by OPEN only. Belief is 1 for a seed; for others it
is that of the instance's shape (its digits and letters generalised): one less the product of the doubts in its patterns.
A pattern counts from SUPPORT distinct texts on in which it stands before instances of the kind. Open instances of chosen
patterns become spans of the kind. Decisions come back to the documents by a join on the pattern, never by collecting.

Null texts count as empty. Spans are in code points, end exclusive. Found spans never overlap base ones; kinds of found
spans are those of the seeds: email, ip, card, phone, secret. Rows that share a doc_id and a text are each reported;
an empty table gives an empty result. Extra columns are left alone, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, free_names, stage

# The base patterns, in the order in which kinds are listed.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*BASE, "secret")
#: The same matches without going back: a run that fails once fails from each of its characters.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = {
    "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: A pattern counts from so many distinct texts on, and from this confidence; belief below DOUBTED isn't handed on.
SUPPORT, CONFIDENCE, DOUBTED, ROUNDS = 5, 0.8, 0.5, 3
#: How much an instance of unknown kind counts against a pattern; what is no instance counts in full.
OPEN = 0.1
#: The fewest characters of an instance that is no seed.
LEAST = 6
#: Words of a pattern and shapes that are longer than this stand as their digests.
LONG = 64

# The forms of seed secrets: access key ids, and hex values that are quoted or assigned.
_SECRET = re.compile(r"AKIA[0-9A-Z]{16}|(?<=[\"'=])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{16,}")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]++")
_DIGIT_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+")
_WORD = re.compile(r"[^\x20\x09-\x0D=]++")
_ASSIGNED = re.compile(r"[A-Za-z_-]{2,}+[=:][\"']?(?=.{6})")
_KEY = re.compile(r"[A-Za-z_-]{2,}+[=:]")
#: What may stand between tokens of one identifier, as in (555) 123 - 4567.
_JOIN = re.compile(r"[)\]}]*+(?: | - )[(\[{]*+")
_EDGE = "\"'`()[]{}<>,;:!?*&%$#=|."
_RUNS = re.compile(r"[^\W_]+|.", re.S)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _holds(kind: str, found: str) -> bool:
    if kind == "ip":
        parts = [x.lstrip("0") for x in found.split(".")]
        return all(len(x) < 3 or (len(x) == 3 and x <= "255") for x in parts)
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits)
    return 9 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            yield s, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches, by start and then kind as listed."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for at, (kind, pattern) in enumerate(_DIGITS.items(), 1):
        if kind != "phone" or "+" in text:  # a cheap test: most texts have no + at all
            found += [(m.start(), at, m.end()) for m in pattern.finditer(text) if _holds(kind, m[0])]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


def as_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _short(said: str) -> str:
    return said if len(said) <= LONG else said[:8] + hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest()


def shape(token: str) -> str:
    """A token with runs of digits as 9, of letters as a and mixed runs as x, with their lengths to the next power of two."""
    out = []
    for m in _RUNS.finditer(token):
        x = m[0]
        c = "9" if x.isdigit() else "a" if x.isalpha() else "x" if x.isalnum() else x
        out.append(c + (str(1 << (len(x) - 1).bit_length()) if c in "9ax" else ""))
    return _short("".join(out))


def _word(token: str) -> str:
    return _short(token.strip(_EDGE).lower())


def _candidates(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str | None]]:
    """(start, end, 'secret' or None) of secrets by their form, and of the maximal runs of other tokens with digits
    outside base spans; an assigned value begins a run."""
    runs: list[list] = []
    last = -1  # where the run that may go on ends
    taken: list[list[int]] = []  # the base spans, merged
    for a, b, _ in spans:
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    near = 0
    for m in _DIGIT_TOKEN.finditer(text):
        s, e = m.span()
        while s < e and text[s] in _EDGE:
            s += 1
        while e > s and text[e - 1] in _EDGE:
            e -= 1
        key = _ASSIGNED.match(text, s, e)
        value = key.end() if key else s
        while near < len(taken) and taken[near][1] <= value:
            near += 1
        if near < len(taken) and taken[near][0] < e:
            last = -1
        elif _SECRET.fullmatch(text, value, e):
            runs.append([value, e, "secret"])
            last = -1
        elif last >= 0 and _JOIN.fullmatch(text, last, s) and not _KEY.match(text, s, e):
            runs[-1][1] = last = e
        else:
            runs.append([s, e, None])
            last = e
    out = []
    for s, e, kind in runs:
        if not kind:
            if key := _ASSIGNED.match(text, s, e):
                s = key.end()
            # a bracket that the run closes belongs to it, as in (555) 123-4567
            if s and text[s - 1] == "(" and re.match(r"[^()]*\)", text[s:e]):
                s -= 1
            if e - s < LEAST:
                continue
        out.append((s, e, kind))
    return out


def instances(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str | None, str, str]]:
    """(start, end, seed kind or None, shape, context) of base spans and of runs of tokens with digits outside them. The
    context is the one or two words before: whole words, or what stands between marks before an instance that begins
    within a word."""
    got = sorted([*spans, *_candidates(text, spans)], key=lambda x: x[:2])
    if not got:
        return []
    tokens = [m.span() for m in _WORD.finditer(text)]
    starts, words = [a for a, _ in tokens], {}

    def word(k: int) -> str:
        if k not in words:
            words[k] = _word(text[tokens[k][0] : tokens[k][1]])
        return words[k]

    out = []
    for s, e, kind in got:
        before: list[str] = []
        k = bisect_right(starts, s) - 1
        if k >= 0 and tokens[k][0] < s < tokens[k][1]:
            b = s
            while b > tokens[k][0] and text[b - 1] in _EDGE:
                b -= 1
            a = b
            while a > tokens[k][0] and text[a - 1] not in _EDGE:
                a -= 1
            if a < b:
                before.append(_word(text[a:b]))
        k -= k >= 0 and tokens[k][1] > s
        while k >= 0 and len(before) < 2:
            if w := word(k):
                before.append(w)
            k -= 1
        out.append((s, e, kind, shape(text[s:e]), " ".join(reversed(before))))
    return out


def _scan(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.string()), ("shape", pa.string()), ("context", pa.string())]))
        for batch in batches:
            base, counts, sha, found = [], [], [], []
            for t in batch.column("text"):
                text = t.as_py() or ""
                spans = base_spans(text)
                said = as_text(spans)
                base.append(said)
                sha.append(hashlib.sha256(said.encode()).hexdigest())
                counts.append([sum(k == x for _, _, k in spans) for x in BASE])
                found.append([dict(start=s, end=e, seed=k, shape=h, context=c) for s, e, k, h, c in instances(text, spans)])
            n = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *n, pa.array(sha, pa.string()), pa.array(base, pa.string()), pa.array(found, kind)], [*columns, *[f"n_{k}" for k in BASE], "base_sha256", "base", "found"])

    return run


SCANNED = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, found array<struct<start:int,end:int,seed:string,shape:string,context:string>>"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text hash, base counts, base spans, instances) of every row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(_scan(["doc_id", "h"]), "doc_id long, h long, " + SCANNED)


def _patterns_of(context: str):
    """The patterns of a context: '1 word' and '2 words', the second only where there are two."""
    one, two = F.concat(F.lit("1 "), F.regexp_extract(context, r"\S+$", 0)), F.when(F.instr(context, " ") > 0, F.concat(F.lit("2 "), F.col(context)))
    return F.explode(F.array_compact(F.array(one, two))).alias("pattern")


def _place(said: str, bits: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(said.encode("utf-8", "surrogatepass")) >> (64 - bits)


def _placed(said: Column, bits: int) -> Column:
    @F.pandas_udf("long")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda s: _place(s, bits)).astype("int64")

    return of(said)


def _occurrences(words: np.ndarray, pairs: np.ndarray, lasts: np.ndarray):
    """Counts of patterns in whole texts, of those whose places are marked; added up by Arrow batch."""
    bits = len(words).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[str, bool, bool]] = {}  # by the word as it stands: the word, and its two marks
        for batch in batches:
            ones, twos = Counter(), Counter()
            for t in batch.column("text"):
                before = ""
                for said in _WORD.findall(t.as_py() or ""):
                    known = seen.get(said)
                    if known is None:
                        if len(seen) > 500_000:
                            seen.clear()
                        w = _word(said)
                        at = _place(w, bits)
                        known = seen[said] = (w, bool(w) and bool(words[at]), bool(w) and bool(lasts[at]))
                    w, one, last = known
                    if w:
                        if one:
                            ones[w] += 1
                        if last and before:
                            twos[before, w] += 1
                        before = w
            rows = [(f"1 {w}", n) for w, n in ones.items()] + [(f"2 {x}", n) for (a, b), n in twos.items() if pairs[_place(x := f"{a} {b}", bits)]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["pattern", "n"])

    return run


def totals(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(pattern, total): how often each of candidates(pattern) occurs in the texts of docs(text), whatever follows. Texts
    are read through a filter of the candidates' hashes, 8 to 16 places a candidate and 2^24 at most; what passes by chance
    is left out by the join."""
    bits = min(24, max(15, (8 * candidates.count()).bit_length()))
    kind, said = F.substring("pattern", 1, 1), F.expr("substring(pattern, 3)")
    place = lambda x: _placed(x, bits)
    one, two = candidates.where(kind == "1").select(said.alias("w")), candidates.where(kind == "2").select(said.alias("w"))
    marks = [bitmap(one, place(F.col("w")), bits), bitmap(two, place(F.col("w")), bits), bitmap(two.select(F.regexp_extract("w", r"\S+$", 0).alias("w")), place(F.col("w")), bits)]
    counted = docs.select("text").mapInArrow(_occurrences(*marks), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    return counted.join(candidates, "pattern", "left_semi")


def patterns(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(pattern, kind, confidence): what the bootstrap takes as the contexts of a kind, over all of docs(text)."""
    rows = scanned.select("h", F.explode("found").alias("i")).where("i.context <> ''").select("h", "i.shape", "i.seed", "i.context")
    edges = stage(rows.select("h", "shape", "seed", _patterns_of("context")).groupBy("pattern", "shape", "seed", "h").agg(F.count("*").alias("n")), "pii-edges")
    # a pattern that stands before instances in fewer distinct texts than SUPPORT never counts
    often = edges.select("pattern", "h").distinct().groupBy("pattern").agg(F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT).select("pattern")
    often = stage(often, "pii-often")
    total = stage(totals(docs, often), "pii-totals")
    edges = stage(edges.join(often, "pattern", "left_semi"), "pii-graph")
    open_ = edges.where("seed IS NULL").groupBy("pattern").agg(F.sum("n").alias("open"))
    total = stage(total.join(open_, "pattern", "left").select("pattern", "total", F.coalesce("open", F.lit(0)).alias("open")), "pii-denominators")
    belief = edges.select("shape", F.col("seed").alias("kind"), F.lit(0.0).alias("belief")).limit(0)
    for _ in range(ROUNDS):
        seeded = edges.where("seed IS NOT NULL").select("pattern", F.col("seed").alias("kind"), "h", F.col("n").cast("double").alias("sure"), F.lit(0.0).alias("grown"))
        believed = (F.col("n") * F.col("belief")).alias("sure")
        grown = edges.where("seed IS NULL").join(belief, "shape").select("pattern", "kind", "h", believed, believed.alias("grown"))
        by_text = seeded.unionByName(grown).groupBy("pattern", "kind", "h").agg(F.sum("sure").alias("sure"), F.sum("grown").alias("grown"))
        scored = by_text.groupBy("pattern", "kind").agg(F.sum("sure").alias("sure"), F.sum("grown").alias("grown"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT).join(total, "pattern")
        unknown = F.greatest(F.lit(0.0), F.col("open") - F.col("grown"))
        scored = scored.withColumn("confidence", F.least(F.lit(1.0), F.col("sure") / F.greatest(F.lit(1.0), F.col("total") - (1 - OPEN) * unknown)))
        scored = stage(scored.where(F.col("confidence") >= DOUBTED), "pii-patterns")
        doubt = edges.where("seed IS NULL").select("pattern", "shape").distinct().join(scored, "pattern").groupBy("shape", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("confidence")))))).alias("belief"))
        belief = stage(doubt.where(F.col("belief") >= DOUBTED), "pii-belief")
    return scored.where(F.col("confidence") >= CONFIDENCE).select("pattern", "kind", "confidence")


def found_spans(scanned: DataFrame, chosen: DataFrame) -> DataFrame:
    """(key of the row, kind, start, end): seed secrets, and instances of unknown kind after a chosen pattern; of several
    kinds the most confident, then the first by name."""
    rows = scanned.select("doc_id", "h", F.explode("found").alias("i")).select("doc_id", "h", "i.*").where("seed IS NULL OR seed = 'secret'")
    seeds = rows.where("seed = 'secret'").select("doc_id", "h", "start", "end", F.lit("secret").alias("kind"), F.lit(2.0).alias("confidence"))
    open_ = rows.where("seed IS NULL AND context <> ''").select("doc_id", "h", "start", "end", _patterns_of("context"))
    by_pattern = open_.join(chosen, "pattern").select("doc_id", "h", "start", "end", "kind", "confidence")
    return seeds.unionByName(by_pattern).groupBy("doc_id", "h", "start", "end").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("kind").alias("kind")))["kind"].alias("kind"))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_email, n_ip, n_card, n_phone, base_sha256, base, spans) for every row of docs; h is the hash of the
    text, and spans holds base and found spans as kind:start:end, by start and then kind as listed."""
    scanned = stage(scan(docs), "pii-scan")
    extra = found_spans(scanned, patterns(docs, scanned))
    rank = F.array_position(F.lit(list(KINDS)), F.col("kind")).cast("int")
    extra = extra.groupBy(F.col("doc_id").alias("x_id"), F.col("h").alias("x_h")).agg(F.collect_list(F.struct(F.col("start"), rank.alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("said"))).alias("more"))
    got = scanned.join(extra, scanned["doc_id"].eqNullSafe(F.col("x_id")) & scanned["h"].eqNullSafe(F.col("x_h")), "left")
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("start"), F.array_position(F.lit(list(KINDS)), F.split(x, ":")[0]).cast("int").alias("rank"), x.alias("said")))
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_join(F.transform(F.array_sort(F.concat(base, F.coalesce("more", F.array().cast("array<struct<start:int,rank:int,said:string>>")))), lambda x: x["said"]), ","))
    return got.select("doc_id", "h", *[f"n_{k}" for k in BASE], "base_sha256", "base", spans.alias("spans"))


def query(docs: DataFrame) -> DataFrame:
    """The contract of op4: one row per document."""
    return find(docs.select("doc_id", "text")).select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans")


def redact_text(text: str, spans: str) -> str:
    """text with each span replaced by its kind in angle brackets; of overlapping spans the first and longest goes."""
    at, out = 0, []
    for s, e, k in sorted(((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(","))), key=lambda x: (x[0], -x[1])):
        if e > at:
            out += [text[at : max(s, at)], f"<{k.upper()}>" if s >= at else ""]
            at = e
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by <KIND>; n_chars, where there is one, follows. Rows, columns and null
    texts stay."""
    spans, h, by_id, by_h = free_names(docs, "pii_spans", "pii_h", "pii_by_id", "pii_by_h")
    found = find(docs.select("doc_id", "text")).where("spans <> ''").select(F.col("doc_id").alias(by_id), F.col("h").alias(by_h), F.col("spans").alias(spans)).dropDuplicates([by_id, by_h])
    rows = docs.withColumn(h, F.xxhash64("text"))
    rows = rows.join(found, rows["doc_id"].cast("long").eqNullSafe(F.col(by_id)) & (rows[h] == F.col(by_h)), "left")

    @F.pandas_udf("string")
    def replaced(text, spans):
        return text.combine(spans, lambda t, s: redact_text(t, s) if isinstance(s, str) and isinstance(t, str) else t)

    rows = rows.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(replaced("text", spans)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*docs.columns)
