"""The filter audit against a document-by-document count."""

import random
import re
from itertools import permutations

from skeinwork.llm import audit

DOCS = "doc_id long, text string, source string, mask int, part string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    """Rows by applying the filters in every order to every document."""
    said = {}
    for i, q, t in labels:
        if i is not None:
            g, x = said.get(i, (False, False))
            said[i] = (g or q == 1, x or t == 1)
    rows = []
    for i, text, source, *_ in docs:
        text = text or ""
        ws = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        fails = set()
        if len(ws) < 50:
            fails.add("A")
        if 100 * len(set(ws)) < 65 * len(ws):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == text for j, u, *_ in docs):
            fails.add("E")
        rows.append((source or "", fails, *said.get(i, (False, False))))
    out = []
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for _, fails, *_ in own:
                for f in order:
                    if f in fails:
                        share[f] += 1
                        break
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out.append((part, "".join(order), step, len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), share[f]))
    return sorted(out)


def run(spark, docs, labels):
    return sorted(tuple(r) for r in audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect())


def test_audit_counts_what_filters_do(spark):
    r = random.Random(8)
    kinds = ["few words", " ".join(f"w{i}" for i in range(60)), "same " * 80, "LOUD " + " ".join(f"W{i}" for i in range(70)), " ".join(f"w{i}" for i in range(60)) + " # $", "", None, "same same#" * 40, "a\x0bb\x0cc   " * 30]
    docs = [(i, r.choice(kinds), r.choice(["a", "b", None, ""]), 1, "p") for i in range(300)]
    docs += [(5, kinds[1], "a", 0, "q"), (5, kinds[1], "a", 0, "q"), (None, kinds[1], "a", 0, ""), (None, None, None, 0, ""), (-3, kinds[2], "c", 0, "")]
    labels = [(i, r.randint(0, 1), r.randint(0, 1)) for i in range(0, 300, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1), (9999, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_audit_of_one_hot_text(spark):
    docs = [(i, "the same text", "hot", 0, "") for i in range(400)] + [(i, "the same text", "cold", 0, "") for i in range(-2, 1)]
    got = run(spark, docs, [])
    assert got == brute(docs, []) and len(got) == 1200


def test_audit_of_long_texts_and_empty_tables(spark):
    docs = [(1, "Word " * 400_000, "s", 0, ""), (2, "Word " * 400_000, "s", 0, ""), (3, " " * 1_000_000, "s", 0, "")]
    assert run(spark, docs, [(2, 1, 0)]) == brute(docs, [(2, 1, 0)])
    assert run(spark, [], []) == []


def test_cells_are_got_back_from_the_sums(spark):
    r = random.Random(1)
    rows = [(r.choice("xy"), r.random() < 0.5, r.random() < 0.3, r.randrange(32), r.randint(1, 9)) for _ in range(500)]
    masked = spark.createDataFrame(rows, "part string, good boolean, toxic boolean, mask int, n long")
    got = {c["part"]: c for c in audit.cells(audit.parity_sums(masked, 5), 5).collect()}
    for part in "xy":
        for name, on in (("every", lambda x: True), ("good", lambda x: x[1]), ("toxic", lambda x: x[2])):
            assert list(got[part][name]) == [sum(x[4] for x in rows if x[0] == part and x[3] == m and on(x)) for m in range(32)]
