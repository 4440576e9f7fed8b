"""SQL counterparts of the registered queries, where SQL can express them."""

import math

from guestlens.llm.hosts import DAMPING, RULES, THRESHOLD
from guestlens.llm.licences import BLOCK_WORDS, CONTAINMENT, PHRASES, TEMPLATES

_OP2 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""



def _licences() -> str:
    """Places of the phrases and the templates that some block holds, by plain list tests."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    places, labels = [], []
    for phrase, label in PHRASES.items():
        same = " AND ".join(f"w[i + {k}] = '{part}'" for k, part in enumerate(phrase.split(), start=1))
        places.append(f"list_filter(range(len(w)), lambda i: {same})")
        labels.append(label)
    held = []
    for label, words in TEMPLATES:
        template = sorted(set(words.split()))
        shared = f"list_max(list_transform(blocks, lambda b: len(list_intersect(b, {quoted(template)}))))"
        need = math.ceil(CONTAINMENT * len(template) - 1e-9)
        held.append(f"CASE WHEN {shared} >= {need} THEN {{'label': '{label}', 'share': {shared} / {len(template)}}} END")
    base = ", ".join(f"CASE WHEN len({p}) > 0 THEN '{label}' END" for p, label in zip(places, labels))
    starts = f"range(greatest(1, CAST(ceil((len(w) - {BLOCK_WORDS // 2}) / {BLOCK_WORDS // 2}.0) AS BIGINT)))"
    some = lambda items: f"list_filter({items}, lambda x: x IS NOT NULL)"
    joined = lambda items: f"coalesce(array_to_string(list_sort(list_distinct({items})), ','), '')"
    return rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
cut AS (
  SELECT doc_id, w, list_transform({starts},
    lambda i: list_slice(w, i * {BLOCK_WORDS // 2} + 1, i * {BLOCK_WORDS // 2} + {BLOCK_WORDS})) AS blocks FROM words),
found AS (
  SELECT doc_id, w, {some('[' + base + ']')} AS base, flatten([{', '.join(places)}]) AS starts,
    {some('[' + ', '.join(held) + ']')} AS held FROM cut)
SELECT doc_id, len(w) AS n_words, len(starts) AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word,
  {joined('base')} AS base_labels,
  {joined("list_concat(base, list_transform(held, lambda h: h.label))")} AS labels,
  CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(list_max(list_transform(held, lambda h: h.share)), 0.0) END AS score
FROM found
"""


def _verdicts(rounds: int = 48) -> str:
    """Rules by their length, else ranks by that many rounds. The given pages quote their hrefs."""
    name, ranks, kinds = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", [], ("trust", "distrust", "weight")
    cases = " ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN {{'rule': '{h + p}', 'verdict': '{v}'}}"
        for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    )
    d = f"CAST({DAMPING} AS DOUBLE)"
    for k in range(rounds):
        ahead = f"SELECT dst AS host, {d} * part * trust AS trust, 0.0 AS distrust, {d} * part * weight AS weight FROM ranks{k} JOIN forward ON src = host"
        back = f"SELECT src, 0.0, {d} * part * distrust, 0.0 FROM ranks{k} JOIN backward ON dst = host"
        came = f"SELECT host, sum(trust) AS trust, sum(distrust) AS distrust, sum(weight) AS weight FROM ({ahead} UNION ALL {back}) GROUP BY host"
        sums = ", ".join(f"s.{c} + coalesce(c.{c}, 0.0) AS {c}" for c in kinds)
        ranks.append(f"ranks{k + 1} AS MATERIALIZED (SELECT s.host, {sums} FROM ranks0 s LEFT JOIN ({came}) c USING (host))")
    return rf"""
WITH cut AS MATERIALIZED (
  SELECT page_id, coalesce({name.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, html FROM pages),
ruled AS MATERIALIZED (SELECT page_id, host, path, CASE {cases} END AS r, html FROM cut),
found AS (SELECT host AS src, {name.format("unnest(regexp_extract_all(html, '(?is)<a [^<>]*?href=" + '"' + r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#" + '"' + r"\s]+)', 1))")} AS dst FROM cut WHERE host <> ''),
links AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM found WHERE dst <> '' AND dst <> src GROUP BY ALL),
forward AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS part FROM links),
backward AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY dst) AS part FROM links),
seeds AS (SELECT host, count(*) FILTER (r.verdict = 'allow') AS a, count(*) FILTER (r.verdict = 'block') AS b, count(*) AS p
  FROM ruled WHERE host <> '' GROUP BY host),
nodes AS (SELECT host FROM seeds UNION SELECT src FROM links UNION SELECT dst FROM links),
ranks0 AS MATERIALIZED (SELECT host, (1 - {d}) * coalesce(a, 0) AS trust, (1 - {d}) * coalesce(b, 0) AS distrust,
  (1 - {d}) * coalesce(p, 0) AS weight FROM nodes LEFT JOIN seeds USING (host)),
{", ".join(ranks)}
SELECT page_id, u.host, path, r.rule AS rule,
  coalesce(r.verdict, CASE WHEN distrust > trust AND distrust > {THRESHOLD} * weight THEN 'block' END, 'allow') AS verdict,
  coalesce(trust, 0.0) AS trust, coalesce(distrust, 0.0) AS distrust
FROM ruled u LEFT JOIN ranks{rounds} v USING (host)
"""


ORACLES = {
    "op2_exact_dedup": _OP2,
    "op4_scan_licences": _licences(),
    "op10_judge_urls": _verdicts(),
}
