"""The licence scan in DuckDB SQL, written from the same templates."""

from __future__ import annotations

from plumbline.llm.licenses import _COMMON, BASE, RARE, TEMPLATES


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def scan_sql() -> str:
    vocabulary = sorted({w for _, t, keys in TEMPLATES for p in (t, *keys) for w in p.split() if w not in _COMMON} | {w for p in [*BASE, *(k for _, _, keys in TEMPLATES for k in keys)] for w in p.split()})
    labels = [(t, label) for t, (label, _, _) in enumerate(TEMPLATES)]
    places = [(t, rel, w) for t, (_, text, _) in enumerate(TEMPLATES) for rel, w in enumerate(text.split()) if w in vocabulary]
    keys = set()
    for t, (_, text, phrases) in enumerate(TEMPLATES):
        words = text.split()
        for p in phrases:
            own = p.split()
            at = next(k for k in range(len(words)) if words[k : k + len(own)] == own)
            keys |= {(t, at + j, w) for j, w in enumerate(own)}
    base = " UNION ALL ".join(f"SELECT k.doc_id, k.i, '{label}' AS label FROM k JOIN w ON w.doc_id = k.doc_id WHERE word = '{p.split()[0]}' AND array_to_string(ws[i + 1:i + {len(p.split())}], ' ') = '{p}'" for p, label in BASE.items())
    return f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
voc(word) AS (VALUES {_rows([(v,) for v in vocabulary])}),
k AS (SELECT doc_id, word, i FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w) WHERE word IN (SELECT word FROM voc)),
n AS (SELECT voc.word, count(DISTINCT k.doc_id) AS n FROM voc LEFT JOIN k ON k.word = voc.word GROUP BY voc.word),
idf AS (SELECT word, n, ln((1 + (SELECT count(*) FROM w)) / (1 + n)::DOUBLE) + 0.001 AS idf FROM n),
lab(t, label) AS (VALUES {_rows(labels)}),
tw(t, rel, word) AS (VALUES {_rows(places)}),
keys(t, rel, word) AS (VALUES {_rows(sorted(keys))}),
rare AS (SELECT * FROM (SELECT t, rel, tw.word, row_number() OVER (PARTITION BY t ORDER BY n, rel) AS r FROM tw JOIN idf ON idf.word = tw.word) WHERE r <= {RARE}),
need AS (SELECT t, least(2, count(*)) AS need FROM rare GROUP BY t),
hits AS (SELECT doc_id, t, b, count(DISTINCT rel) AS c FROM (SELECT k.doc_id, rare.t, rare.rel, k.i - rare.rel AS b FROM k JOIN rare ON rare.word = k.word) GROUP BY doc_id, t, b),
met AS (SELECT doc_id, hits.t, b FROM hits JOIN need ON need.t = hits.t WHERE c >= need),
sure AS (SELECT met.doc_id, met.t, met.b FROM met JOIN keys ON keys.t = met.t LEFT JOIN k ON k.doc_id = met.doc_id AND k.i = met.b + keys.rel AND k.word = keys.word GROUP BY met.doc_id, met.t, met.b HAVING count(*) = count(k.i)),
whole AS (SELECT t, sum(idf) AS whole FROM tw JOIN idf ON idf.word = tw.word GROUP BY t),
share AS (SELECT sure.doc_id, sure.t, least(sum(idf) / any_value(whole), 1.0) AS share FROM sure JOIN whole ON whole.t = sure.t JOIN tw ON tw.t = sure.t JOIN k ON k.doc_id = sure.doc_id AND k.i = sure.b + tw.rel AND k.word = tw.word JOIN idf ON idf.word = tw.word GROUP BY sure.doc_id, sure.t, sure.b),
base AS ({base}),
bl AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM share JOIN lab ON lab.t = share.t) GROUP BY doc_id),
sc AS (SELECT doc_id, max(share) AS score FROM share GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6)::DOUBLE AS score
FROM w LEFT JOIN bl ON bl.doc_id = w.doc_id LEFT JOIN al ON al.doc_id = w.doc_id LEFT JOIN sc ON sc.doc_id = w.doc_id"""
