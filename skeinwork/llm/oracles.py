"""DuckDB twins of the training-data queries that SQL can express. They share fixed values with the operators;
the licence scan's also shares the Python function that turns the known texts into digests."""

from __future__ import annotations

import hashlib
import string

from .licences import COPYRIGHT, DIGESTS, KNOWN, NOTICES, SPELLINGS, TITLE, canonical_text
from .quality import MEASURES, MIN_GROUP, REACH
from .spotsigs import ANCHORS

WORD = r"[^\x20\x09-\x0D]+"


def ngram_join() -> str:
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({low}, ''), '{WORD}') ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) p FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 3], ' ') g FROM i), n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id a, b.doc_id b, count(*) k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT k.a, k.b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


def licence_scan() -> str:
    def canonical(t: str) -> str:
        t = f"regexp_replace(regexp_replace(lower(coalesce({t}, '')), '{TITLE}', ''), '{COPYRIGHT}', '\\1', 'g')"
        t = f"' ' || trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
        for a, b in SPELLINGS:
            t = f"replace({t}, ' {a} ', ' {b} ')"
        return f"trim({t})"

    of = lambda t: hashlib.sha256(canonical_text(t).encode()).hexdigest()
    rows = sorted({(of(t), k, False) for k, t in KNOWN.items()} | {(of(t), k, True) for k, ts in NOTICES.items() for t in ts} | {(d, k, False) for k, d in DIGESTS})
    values = ", ".join(f"('{d}', '{k}', {str(n).lower()})" for d, k, n in rows)
    return f"""WITH k AS (SELECT * FROM (VALUES {values}) t(digest, licence, notice)), c AS (SELECT doc_id, text, {canonical('text')} c FROM documents),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line FROM documents), d AS (SELECT doc_id, sha256({canonical('line')}) digest FROM l WHERE regexp_matches(line, '(?i)licen[sc]e|rights reserved')),
m AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) notices FROM d JOIN k USING (digest) WHERE notice GROUP BY doc_id)
SELECT c.doc_id, CASE WHEN c <> '' THEN sha256(c) END AS licence_digest, licence, coalesce(notices, '') AS notices FROM c LEFT JOIN k ON c <> '' AND k.digest = sha256(c) LEFT JOIN m ON m.doc_id = c.doc_id"""


def quality_rules() -> str:
    over = "greatest(length(bin(v)) - 6, 0)"
    floor = lambda b: f"CAST(({b} - greatest({b} // 32 - 1, 0) * 32) AS BIGINT) << greatest({b} // 32 - 1, 0)"
    least = " ".join(f"WHEN '{m}' THEN {x}" for m, x in MEASURES.items())
    sketch = lambda keys: f"SELECT {keys}m, b, sum(n) n FROM sk GROUP BY {keys}m, b"

    def quantiles(name: str, keys: str) -> str:
        by = f"PARTITION BY {keys}m"
        return f"""{name}0 AS (SELECT *, sum(n) OVER ({by} ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) u, sum(n) OVER ({by}) docs FROM ({sketch(keys)})),
{name} AS (SELECT {keys}m, max(docs) docs, min(CASE WHEN u * 100 >= docs * 10 THEN b END) b10, min(CASE WHEN u * 100 >= docs * 50 THEN b END) b50 FROM {name}0 GROUP BY {keys}m)"""

    pick = lambda c: f"CASE WHEN o.docs >= {MIN_GROUP} THEN o.{c} WHEN a.docs >= {MIN_GROUP} THEN a.{c} ELSE e.{c} END"
    far = " OR ".join(f"coalesce(v_{m} > h_{m}, false)" for m in MEASURES)
    return f"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{WORD}') ws FROM documents),
g AS (SELECT doc_id, p, array_to_string(ws[p:p + 2], ' ') g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) p FROM t WHERE len(ws) > 2)),
tw AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), cv AS (SELECT DISTINCT doc_id, p + o.i q FROM tw, range(3) o(i)), rp AS (SELECT doc_id, count(*) n FROM cv GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) n, count(DISTINCT line) d FROM (SELECT doc_id, unnest(string_split(t, chr(10))) line FROM t) WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
c AS (SELECT t.doc_id, lang, source, len(ws) n_words, CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT) wc, length(t) - length(translate(t, '#*$%&|<>', '')) n_symbols, coalesce(ln.n - d, 0) n_dup_lines, coalesce(rp.n, 0) n_repeat_words, coalesce(ln.n, 0) nl, length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) caps FROM t LEFT JOIN rp USING (doc_id) LEFT JOIN ln ON ln.doc_id = t.doc_id),
q AS (SELECT *, coalesce(wc, 0) word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed, coalesce(n_symbols * 1000000 // nullif(wc, 0), 0) v_symbols, coalesce(n_dup_lines * 1000000 // nullif(nl, 0), 0) v_dup_lines, coalesce(n_repeat_words * 1000000 // nullif(n_words, 0), 0) v_repeats, coalesce(caps * 1000000 // nullif(wc, 0), 0) v_capitals, coalesce(wc * 1000 // nullif(n_words, 0), 0) v_length FROM c),
ms AS (SELECT lang, source, unnest([{', '.join(repr(m) for m in MEASURES)}]) m, unnest([{', '.join('v_' + m for m in MEASURES)}]) v FROM q WHERE NOT base_failed),
sk AS (SELECT lang, source, m, {over} * 32 + (v >> {over}) b, count(*) n FROM ms GROUP BY ALL),
{quantiles('ow', 'lang, source, ')}, {quantiles('la', 'lang, ')}, {quantiles('al', '')},
lv AS (SELECT g.lang, g.source, g.m, {floor(f'({pick("b10")})')} p10, {floor(f'({pick("b50")})')} p50 FROM (SELECT DISTINCT lang, source, m FROM sk) g
 LEFT JOIN ow o ON o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source AND o.m = g.m LEFT JOIN la a ON a.lang IS NOT DISTINCT FROM g.lang AND a.m = g.m LEFT JOIN al e ON e.m = g.m),
th AS (SELECT lang, source, {', '.join(f"max(CASE WHEN m = '{m}' THEN p50 + {REACH} * s END) h_{m}" for m in MEASURES)}, max(CASE WHEN m = 'length' THEN p50 - {REACH} * s END) low FROM (SELECT *, greatest(p50 - p10, CASE m {least} END) s FROM lv) GROUP BY lang, source)
SELECT q.doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({far} OR coalesce(v_length < low, false)) AS kept
FROM q LEFT JOIN th ON th.lang IS NOT DISTINCT FROM q.lang AND th.source IS NOT DISTINCT FROM q.source"""


def filter_audit() -> str:
    letters = [(c, 1 << i) for i, c in enumerate("ABCDE")]
    values = ", ".join(f"('{c}', {b})" for c, b in letters)
    names = [f"o{i}" for i in range(1, 6)]
    order = "concat(" + ", ".join(f"{n}.f" for n in names) + ")"
    other = " AND ".join(f"{a}.f <> {b}.f" for i, a in enumerate(names) for b in names[:i])
    step = lambda i: f"SELECT {order} filter_order, {i} step, {names[i - 1]}.b own, {' + '.join(f'{n}.b' for n in names[: i - 1]) or '0'} before_ FROM {', '.join(f'fl {n}' for n in names)} WHERE {other}"
    steps = " UNION ALL ".join(step(i) for i in range(1, 6))
    return f"""WITH fl AS (SELECT * FROM (VALUES {values}) t(f, b)), st AS ({steps}),
t AS (SELECT doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{WORD}') ws FROM documents), fi AS (SELECT t, min(doc_id) least_ FROM t GROUP BY t),
lb AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) good, coalesce(bool_or(toxic = 1), false) toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) good, coalesce(toxic, false) toxic, CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(t.t, '[^A-Z]+', '', 'g')) > 5 * length(t.t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t.t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN t.doc_id > least_ THEN 16 ELSE 0 END mask FROM t JOIN fi ON fi.t = t.t LEFT JOIN lb ON lb.doc_id = t.doc_id),
c AS (SELECT part, mask, count(*) n, count(*) FILTER (good) g, count(*) FILTER (toxic) x FROM m GROUP BY part, mask)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(sum(n) FILTER ((mask & (own | before_)) = 0), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER ((mask & own) <> 0 AND (mask & before_) = 0), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER ((mask & own) <> 0 AND (mask & before_) <> 0), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(g) FILTER ((mask & own) <> 0 AND (mask & before_) = 0), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(x) FILTER ((mask & own) <> 0 AND (mask & before_) = 0), 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER ((mask & own) <> 0), 0) AS BIGINT) AS shapley
FROM c, st GROUP BY part, filter_order, step, own, before_"""


def exact_top_k() -> str:
    return """WITH e AS (SELECT row_number() OVER () row_, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.row_ r, q.vec_id query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.row_ <> q.row_)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) <= 5"""


def near_documents() -> str:
    anchors = ", ".join(f"'{x}'" for x in sorted(ANCHORS))
    return f"""WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') t FROM documents), w AS (SELECT r, list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') ws FROM d),
i AS (SELECT r, unnest(ws) x, generate_subscripts(ws, 1) i FROM w), m AS (SELECT *, x IN ({anchors}) a FROM i), n AS (SELECT *, count(*) FILTER (NOT a) OVER (PARTITION BY r ORDER BY i) k FROM m),
ch AS (SELECT DISTINCT p.r, concat_ws(' ', p.x, b.x, c.x) g FROM n p JOIN n b ON b.r = p.r AND NOT b.a AND b.k = p.k + 1 JOIN n c ON c.r = p.r AND NOT c.a AND c.k = p.k + 2 WHERE p.a),
ot AS (SELECT d.r, t, ws FROM d JOIN w ON w.r = d.r WHERE d.r NOT IN (SELECT r FROM ch)),
wi AS (SELECT DISTINCT r, array_to_string(ws[p:p + 2], ' ') g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) p FROM ot WHERE len(ws) >= 3)),
s AS (SELECT * FROM ch UNION ALL SELECT * FROM wi UNION ALL SELECT r, 'whole:' || t FROM ot WHERE len(ws) < 3),
f AS (SELECT r, list(g ORDER BY g) g FROM s GROUP BY r), c AS (SELECT f.g, min(f.r) c, min(doc_id) class_id, len(f.g) n FROM f JOIN d ON d.r = f.r GROUP BY f.g),
h AS (SELECT c, n, unnest(g) g FROM c), k AS (SELECT a.c a, b.c b, a.n + b.n both_, count(*) k FROM h a JOIN h b ON a.g = b.g AND a.c < b.c GROUP BY ALL),
l AS (SELECT unnest([a, b]) c, count(*) n FROM k WHERE k / (both_ - k) >= 0.8 GROUP BY 1)
SELECT d.doc_id, c.n AS n_signatures, c.class_id, coalesce(l.n, 0) AS links FROM d JOIN f ON f.r = d.r JOIN c ON c.g = f.g LEFT JOIN l ON l.c = c.c"""
