"""DuckDB SQL, made from the operators' own parameters, for queries whose rules SQL can say step by step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from tidewheel.llm.shared import LOWER, UPPER


def _lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


def jaccard_sql(width: int, num: int, den: int) -> str:
    """Every pair of texts that share a shingle, counted; components by a closure of the links."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_lowered("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= {width} THEN list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: {gram})) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id AND {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))
), sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a, b FROM sides UNION SELECT r.a, l.b FROM reached r JOIN sides l ON l.a = r.b),
smallest AS (SELECT a, min(b) AS b FROM reached GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, b) AS component_id FROM sets LEFT JOIN smallest ON a = doc_id
"""


def licenses_sql(base: Mapping[str, str], templates: Mapping[str, str], words: str, near: int, share: float, look: int) -> str:
    """Votes for diagonals, as the operator counts them, by a join on the words themselves."""
    rows = []
    for is_base, named in ((True, {v: k for k, v in base.items()}), (False, templates)):
        for label, phrase in named.items():
            w = phrase.split()
            for i in range(len(w) - 1):
                rows.append(f"('{label}', {is_base}, {len(w)}, {i}, '{w[i]}', '{w[i + 1]}', '{'' if is_base else ' '.join(w[i + 2 : i + look])}', {0 if is_base else len(w[i + 2 : i + look])})")
    return rf"""
WITH template(label, base, size, place, w0, w1, ahead, look) AS (VALUES {", ".join(rows)}),
words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_lowered("text")}, '{words}') AS w FROM documents),
at_ AS (SELECT r, w, unnest(range(len(w) - 1)) AS p FROM words WHERE len(w) > 1),
votes AS (
  SELECT r, label, base, size, place, p, p - place AS diagonal, look = 0 OR array_to_string(w[p + 3:p + 2 + look], ' ') = ahead AS firm FROM at_ JOIN template ON w[p + 1] = w0 AND w[p + 2] = w1
), diagonals AS (SELECT r, label, base, size, diagonal, list(DISTINCT place) AS places, min(p) AS low, max(p) AS high, bool_or(firm) AS firm FROM votes GROUP BY r, label, base, size, diagonal),
gaps AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, label ORDER BY diagonal) > {near}, true) THEN 1 ELSE 0 END AS fresh FROM diagonals),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY r, label ORDER BY diagonal) AS span FROM gaps),
merged AS (SELECT r, label, base, size, span, len(list_distinct(flatten(list(places)))) AS votes, min(low) AS low, max(high) AS high, bool_or(firm) AS firm FROM numbered GROUP BY r, label, base, size, span),
judged AS (
  SELECT *, least(1.0::DOUBLE, votes::DOUBLE / (size - 1)) AS part,
    CASE WHEN base THEN votes = size - 1 ELSE votes::DOUBLE / (size - 1) >= {share} AND high - low + 2 <= size * 1.5 + {near} END AS good
  FROM merged
), found AS (
  SELECT r, count(*) FILTER (WHERE good AND base) AS n_base, min(low) FILTER (WHERE good AND base) AS first_word, max(low) FILTER (WHERE good AND base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE good AND base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE good) AS labels,
    max(CASE WHEN base THEN CASE WHEN good THEN 1.0::DOUBLE END WHEN good OR firm THEN part END) AS score
  FROM judged GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM words LEFT JOIN found USING (r)
"""


def mixing_sql(weights: Sequence[Mapping[str, float]], share: float, epochs: int, seed: int, none: str, width: int) -> str:
    """Water filling through domain, language and source, then each leaf's prefix by one running sum."""
    names = ["l0", "l1", "l2"]
    levels = []
    for i, name in enumerate(names):
        upper, here = names[:i], ", ".join(names[: i + 1])
        weight = "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {float(w)}::DOUBLE" for k, w in weights[i].items()) + " ELSE 1.0::DOUBLE END" if weights[i] else "1.0::DOUBLE"
        by = f"PARTITION BY {', '.join(upper)}" if upper else ""
        budget = f"(SELECT budget FROM above{i - 1} a WHERE {' AND '.join(f'a.{u} = t.{u}' for u in upper)})" if upper else f"{share}::DOUBLE * (SELECT sum(tokens) FROM docs)"
        levels.append(f"""
sums{i} AS (SELECT {here}, sum(tokens) AS t, CAST(sum(tokens) * {epochs} AS DOUBLE) AS capacity, {weight} AS weight FROM docs GROUP BY {here}),
asked{i} AS (SELECT *, {budget} AS given FROM sums{i} t),
rising{i} AS (SELECT *, (given - coalesce(sum(capacity) OVER ({by} ORDER BY capacity / weight, {here} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({by} ORDER BY capacity / weight, {here} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rise FROM asked{i}),
above{i} AS (SELECT {here}, t, least(capacity, max(rise) OVER ({by}) * weight) AS budget FROM rising{i})""")
    return f"""
WITH docs AS (
  SELECT doc_id, lang, source, CAST((strlen(coalesce(text, '')) + 3) // 4 + 1 AS BIGINT) AS tokens,
    coalesce(regexp_extract(source, '^([A-Za-z]*)', 1) || '-' || coalesce(CAST(TRY_CAST(nullif(regexp_extract(source, '^[A-Za-z]*([0-9]{{1,9}})', 1), '') AS BIGINT) // {width} AS VARCHAR), ''), '{none}') AS l0, coalesce(lang, '{none}') AS l1, coalesce(source, '{none}') AS l2
  FROM documents
),{",".join(levels)},
plan AS (SELECT l0, l1, l2, CAST(t AS BIGINT) AS t, CAST(floor(budget + 1e-6) AS BIGINT) AS allowed FROM above2),
placed AS (SELECT d.*, allowed // t AS whole, allowed % t AS rest, md5(concat_ws('|', {seed}, allowed // t, coalesce(CAST(doc_id AS VARCHAR), '{none}'))) AS place FROM docs d JOIN plan USING (l0, l1, l2)),
run AS (SELECT *, least({epochs}, whole + CASE WHEN sum(tokens) OVER (PARTITION BY l0, l1, l2 ORDER BY place) <= rest THEN 1 ELSE 0 END) AS times FROM placed)
SELECT doc_id, lang, source, tokens, CAST(unnest(range(times)) AS INTEGER) AS epoch FROM run
"""
