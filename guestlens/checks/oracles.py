"""SQL counterparts of the registered queries, written for DuckDB on the given tables.

They start from the tables and share no code with the operators, only fixed values
(word lists) and the choices of the queries. Dates come from the events, not from the
date texts, so that date parsing is checked against the truth.
"""

from guestlens.checks import derived, queries
from guestlens.functions.dates import ENGLISH_MONTHS, SPANISH_MONTHS
from guestlens.functions.stopwords import stop_words
from guestlens.operators.enrich import LANGUAGE_PROFILES
from guestlens.schema import RAW_COLUMNS


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_STOP = _quoted(sorted(stop_words()))
_RAW = ", ".join(RAW_COLUMNS)
_TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_'']*"
_BLANKS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+"
_START, _END = f"DATE '{queries.START}'", f"DATE '{queries.END}'"


def _strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{_BLANKS}|{_BLANKS}$', '', 'g')"


def _shown(expr: str) -> str:
    return rf"trim(regexp_replace({expr}, '[ \t\r\n\f]+', ' ', 'g'))"


def _clean(expr: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({expr}, '')), '{_BLANKS}', ' ', 'g'))"


def _number(expr: str) -> str:
    found = rf"try_cast(nullif(regexp_extract(replace({expr}, ',', '.'), '(\d+(\.\d+)?)', 1), '') AS DOUBLE)"
    return f"CASE WHEN {found} > 10 AND {found} <= 100 THEN {found} / 10 ELSE {found} END"


def _score_text(expr: str) -> str:
    return rf"coalesce(nullif(regexp_extract(replace({expr}, ',', '.'), '(\d+[.,]?\d*)', 1), ''), '0')"


def _hash(*cols: str) -> str:
    return "md5(" + " || ".join(f"coalesce({c}, 'None')" for c in cols) + ")"


_HASH = _hash("hotel_url", "date", "title", "positive", "negative")
_FULL = _strip("coalesce(title, '') || ' ' || coalesce(positive, '') || ' ' || coalesce(negative, '')")

# raw: both deliveries; review_date and quality are truths the operators do not see.
RAW = f"""
happened AS (
  SELECT event_id % (SELECT max(doc_id) + 1 FROM documents) AS doc_id, min(ts) AS ts, max(value) AS v, count(*) AS n_events,
    count(*) FILTER (event_type = 'click') % 3 = 1 AS mirrored, count(*) FILTER (event_type = 'purchase') % 3 = 1 AS twice
  FROM events GROUP BY 1),
base AS (
  SELECT d.doc_id AS n, d.text, d.source, e.v, coalesce(e.n_events, 0) AS n_events, coalesce(e.mirrored, false) AS mirrored,
    l.quality, CAST(e.ts AS DATE) + CAST(d.doc_id % 400 AS INTEGER) AS dt
  FROM documents d LEFT JOIN happened e ON e.doc_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
first_delivery AS (
  SELECT n AS seq, source AS hotel_name,
    'https://stay.example/' || source || '/' || (n % 3) AS hotel_url,
    split_part(text, '.', 1) AS title,
    CASE WHEN n % 17 = 0 OR v IS NULL THEN 'No score'
         WHEN n % 5 = 0 THEN CAST(floor(v / 50) AS BIGINT) || ',' || (CAST(floor(v * 10) AS BIGINT) % 10)
         ELSE 'Score: ' || CAST(floor(v) AS BIGINT) || '.' || (CAST(floor(v * 10) AS BIGINT) % 10) END AS score,
    CASE WHEN quality = 0 THEN '' WHEN quality = 1 THEN text
         ELSE substr(text, 1, length(text) // 2) END AS positive,
    CASE WHEN quality = 1 OR (quality = 0 AND n % 2 = 0) THEN '' WHEN quality = 0 THEN text
         ELSE substr(text, length(text) // 2 + 1) END AS negative,
    CASE WHEN n % 23 = 0 OR dt IS NULL THEN 'sin fecha'
         WHEN n % 2 = 0 THEN 'Reviewed: ' || day(dt) || ' '
              || list_extract([{_quoted(m.capitalize() for m in ENGLISH_MONTHS)}], CAST(month(dt) AS INTEGER)) || ' ' || year(dt)
         ELSE 'Comentó el: ' || day(dt) || ' de '
              || list_extract([{_quoted(SPANISH_MONTHS)}], CAST(month(dt) AS INTEGER)) || ' de ' || year(dt) END AS date,
    n_events, mirrored, quality, CASE WHEN n % 23 <> 0 THEN dt END AS review_date
  FROM base),
raw AS (
  SELECT * FROM first_delivery
  UNION ALL
  SELECT seq + {derived.MIRROR_OFFSET}, hotel_name || ' (mirror)', hotel_url, title, 'Score: 5.0', positive,
         negative, date, 0, mirrored, quality, review_date
  FROM first_delivery WHERE mirrored)"""

# csv_prepared: raw rows as the dashboard sees them without enrichment.
CSV_PREPARED = f"""
csv_prepared AS (
  SELECT * REPLACE (CAST({_number('score')} AS DOUBLE) AS score),
         (coalesce({_number('score')}, 5) - 5) / 5 AS compound_score
  FROM raw WHERE review_date IS NOT NULL)"""

# stored: first row per hash with the clean score.
STORED = f"""
stored AS (
  SELECT seq, hotel_name, hotel_url, title, {_number('score')} AS score, positive, negative, date, review_date,
         {_HASH} AS review_hash
  FROM raw QUALIFY row_number() OVER (PARTITION BY {_HASH} ORDER BY seq) = 1)"""

# the same when the labelled reviews were stored ahead of the others
_LABELLED_FIRST = STORED.replace("ORDER BY seq", f"ORDER BY (quality IS NULL OR seq >= {derived.MIRROR_OFFSET}), seq")


def _votes(source: str, name: str) -> str:
    """Processed text, tokens and language of every row of `source`."""
    codes = sorted(LANGUAGE_PROFILES)
    hits = [
        f"len(list_filter(tok, lambda w: w IN ({_quoted(LANGUAGE_PROFILES[c])}))) AS v_{c}" for c in codes
    ]
    best = "greatest(" + ", ".join(f"v_{c}" for c in codes) + ")"
    cases = " ".join(f"WHEN v_{c} = {best} THEN '{c}'" for c in codes)
    return f"""
{name}_text AS (SELECT *, {_clean(_FULL)} AS full_review_processed FROM {source}),
{name}_tok AS (SELECT *, regexp_extract_all(full_review_processed, '{_TOKEN}') AS tok FROM {name}_text),
{name}_votes AS (SELECT *, {', '.join(hits)} FROM {name}_tok),
{name} AS (
  SELECT * EXCLUDE ({', '.join('v_' + c for c in codes)}),
         CASE WHEN length(full_review_processed) < 3 OR {best} = 0 THEN 'unknown' {cases} END AS language
  FROM {name}_votes)"""


def _lexicon_hits(side: int) -> str:
    cases = " ".join(
        f"WHEN '{code}' THEN len(list_filter(tok, lambda w: w IN ({_quoted(sides[side])})))"
        for code, sides in derived.LEXICON.items()
    )
    return f"CASE language {cases} END"


# enriched: stored rows with text, language and sentiment; prepared adds the compound.
ENRICHED = f"""{_votes('stored', 'spoken')},
hits AS (SELECT *, {_lexicon_hits(0)} AS p, {_lexicon_hits(1)} AS m FROM spoken),
enriched AS (
  SELECT * EXCLUDE (tok, p, m),
    CASE WHEN p IS NULL THEN NULL WHEN p <= 1 AND m <= 1 THEN 'NEU' WHEN p >= m THEN 'POS' ELSE 'NEG' END AS sentiment_label,
    coalesce(p / (p + m + 1), 0) AS sentiment_score_pos,
    coalesce(m / (p + m + 1), 0) AS sentiment_score_neg,
    coalesce(1 / (p + m + 1), 0) AS sentiment_score_neu
  FROM hits)"""
PREPARED = """
prepared AS (
  SELECT * REPLACE (CASE WHEN score > 10 AND score <= 100 THEN score / 10 ELSE score END AS score),
         sentiment_score_pos - sentiment_score_neg AS compound_score
  FROM enriched WHERE review_date IS NOT NULL)"""

# anchors of the given pages with absolute targets
_HREF = 'nullif(regexp_extract(tag, \'href="([^"]*)"\', 1), \'\')'
LINKS = f"""
tags AS (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*>') AS t FROM pages),
anchors AS (
  SELECT page_id, url AS page_url, unnest(t) AS tag, unnest(range(len(t))) AS place FROM tags),
hrefs AS (
  SELECT page_id, page_url, row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS place, {_HREF} AS href
  FROM anchors WHERE {_HREF} IS NOT NULL),
links AS (
  SELECT CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href
              ELSE regexp_extract(page_url, '^[a-z]+://[^/?#]*') || href END AS url, page_id, place FROM hrefs),
harvest AS (
  SELECT url, page_id AS first_page, place AS first_place FROM links
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, place) = 1)"""

# hotel links of the search pages, which stand in front of the given pages' own content
HOTEL_LINKS = """
cards AS (
  SELECT page_id, url AS page_url, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin FROM pages),
links AS (
  SELECT page_id, page_url, unnest([origin || '/hotel/' || (page_id % 97), page_url, 'https://stay.example/card/' || page_id,
      origin || '/hotel/' || (page_id % 89) || '?a=1&b=2']) AS url, unnest([0, 1, 2, 3]) AS place FROM cards),
harvest AS (
  SELECT url, page_id AS first_page, place AS first_place FROM links
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, place) = 1),
visited AS (SELECT DISTINCT url FROM links WHERE page_url LIKE 'https:%'),
pending AS (SELECT * FROM harvest WHERE url NOT IN (SELECT url FROM visited))"""


def _chunks(source: str) -> str:
    position = "row_number() OVER (ORDER BY first_page, first_place) - 1"
    return f"""SELECT url, first_page, first_place, {position} AS position,
  ({position}) // ((SELECT count(*) FROM {source}) // 8 + 1) AS chunk FROM {source}"""


# records of the derived review pages as a browser shows them, one row per distinct record
RECORDS = f"""
shown AS (
  SELECT seq, seq // {derived.SEQS_PER_PAGE} AS page_no, hotel_name, hotel_url, {_shown('title')} AS title,
    {_score_text('score')} AS score,
    CASE WHEN positive = '' AND negative = '' THEN 'body of ' || seq ELSE {_shown('positive')} END AS positive,
    {_shown('negative')} AS negative, date, review_date FROM raw),
paged AS (SELECT *, min(seq) OVER (PARTITION BY hotel_url, hotel_name, page_no) AS page_id FROM shown),
records AS (
  SELECT page_id, page_no, {_RAW}, min(review_date) AS review_date, min(seq) AS pos
  FROM paged GROUP BY page_id, page_no, {_RAW})"""


def _with(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


def _prepared(body: str) -> str:
    return _with(RAW, STORED, ENRICHED, PREPARED, body=body)


def _terms(column: str) -> str:
    return _with(
        RAW,
        body=rf"""SELECT term, n, round(n / max(n) OVER (), 6) AS weight FROM (
  SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower({column}), '{_TOKEN}')) AS term FROM raw)
  WHERE term NOT IN ({_STOP}) GROUP BY term ORDER BY n DESC, term LIMIT 50)""",
    )


def _cloud_ctes(column: str, source: str = "raw") -> str:
    def llr(k: str, n: str, x: str) -> str:
        return f"(ln(greatest({x}, 1e-10)) * {k} + ln(greatest(1 - {x}, 1e-10)) * ({n} - {k}))"

    n = "CAST(total AS DOUBLE)"
    score = (
        f"-2 * ({llr('c', 'c1', f'c2 / {n}')} + {llr('(c2 - c)', f'({n} - c1)', f'c2 / {n}')}"
        f" - {llr('c', 'c1', 'c / c1')} - {llr('(c2 - c)', f'({n} - c1)', f'(c2 - c) / ({n} - c1)')})"
    )
    plural = "{0} LIKE '%s' AND {0} NOT LIKE '%ss'"
    return rf"""
bag AS (
  SELECT seq, list_filter(list_transform(regexp_extract_all(lower({column}), '{_TOKEN}'),
         lambda w: regexp_replace(w, '''s$', '')), lambda w: NOT regexp_full_match(w, '\p{{Nd}}+')) AS ws
  FROM {source} WHERE {column} IS NOT NULL),
word_at AS (SELECT seq, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM bag),
neighbours AS (SELECT w AS w1, lead(w) OVER (PARTITION BY seq ORDER BY i) AS w2 FROM word_at),
uni AS (SELECT w, count(*) AS c FROM word_at WHERE w NOT IN ({_STOP}) GROUP BY w),
total AS (SELECT sum(c) AS total FROM uni),
form AS (
  SELECT w, c, CASE WHEN {plural.format('w')} AND EXISTS (SELECT 1 FROM uni b WHERE b.w = substr(a.w, 1, length(a.w) - 1))
                    THEN substr(w, 1, length(w) - 1) ELSE w END AS f FROM uni a),
words AS (SELECT f, sum(c) AS c FROM form GROUP BY f),
pair0 AS (
  SELECT w1, w2, count(*) AS c FROM neighbours
  WHERE w2 IS NOT NULL AND w1 NOT IN ({_STOP}) AND w2 NOT IN ({_STOP}) GROUP BY w1, w2),
pair1 AS (
  SELECT a.w1, CASE WHEN b.w2 IS NOT NULL THEN b.w2 ELSE a.w2 END AS w2, a.c
  FROM pair0 a LEFT JOIN pair0 b
    ON b.w1 = a.w1 AND {plural.format('a.w2')} AND b.w2 = substr(a.w2, 1, length(a.w2) - 1)),
pair2 AS (SELECT w1, w2, CAST(sum(c) AS BIGINT) AS c FROM pair1 GROUP BY w1, w2),
scored AS (
  SELECT p.w1, p.w2, fa.f AS f1, fb.f AS f2, p.c, wa.c AS c1, wb.c AS c2, total
  FROM pair2 p JOIN form fa ON fa.w = p.w1 JOIN words wa ON wa.f = fa.f
               JOIN form fb ON fb.w = p.w2 JOIN words wb ON wb.f = fb.f, total),
together AS (
  SELECT *, {score} AS g2 FROM scored WHERE total > c1 AND total > c2 AND {score} > 30)"""


_CLOUD = """SELECT term, CAST(n AS BIGINT) AS n FROM (
    SELECT f AS term, sum(c) AS n FROM (
      SELECT f, c FROM words UNION ALL SELECT f1, -c FROM together UNION ALL SELECT f2, -c FROM together)
    GROUP BY f HAVING sum(c) > 0
    UNION ALL SELECT w1 || ' ' || w2, c FROM together)
  ORDER BY n DESC, term LIMIT 50"""


def _cloud(column: str) -> str:
    body = f"SELECT term, n, round(n / max(n) OVER (), 6) AS weight FROM ({_CLOUD})"
    return _with(RAW, _cloud_ctes(column), body=body)


_RANKING = """SELECT hotel_name, round(c, 6) AS compound_score FROM (
  SELECT hotel_name, avg(compound_score) AS c FROM {source} WHERE hotel_name IS NOT NULL
  GROUP BY hotel_name ORDER BY c DESC, hotel_name LIMIT 10)"""
_MONTHLY_VOLUME = """SELECT last_day(m) AS {label}, (SELECT count(*) FROM {source} WHERE date_trunc('month', review_date) = m) AS {value}
FROM (SELECT CAST(unnest(generate_series((SELECT date_trunc('month', min(review_date)) FROM {source}),
      (SELECT date_trunc('month', max(review_date)) FROM {source}), INTERVAL 1 MONTH)) AS DATE) AS m)"""
_SCORES = "round({0}sentiment_score_pos, 6) AS sentiment_score_pos, round({0}sentiment_score_neg, 6) AS sentiment_score_neg, round({0}sentiment_score_neu, 6) AS sentiment_score_neu"
_SCORES = _SCORES.replace("{0}", "")
_CHOSEN = f"review_date BETWEEN {_START} AND {_END}"


def _top_terms_of(column: str) -> str:
    return f"""SELECT 'terms_{column}' AS section, term AS item, CAST(n AS DOUBLE) AS value FROM (
  WITH {_cloud_ctes(column, "chosen")} {_CLOUD})"""


def _fitted(rows: str, shown: str) -> list[str]:
    """Naive Bayes over hashed byte n-grams, in two folds, for rows (k, label, text, and the
    columns shown). A fifth of the texts is left out of the counts."""
    number = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) % {}"
    return [
        f"given AS ({rows})",
        f"""folded AS (SELECT *, row_number() OVER () AS r, {number.format("CAST(k AS VARCHAR)", 2)} AS fold, {number.format("text", 5)} = 0 AS fifth,
  list_transform(range(octet_length(encode(text))), lambda i: CAST('0x' || substr(hex(encode(text)), 2 * i + 1, 2) AS INTEGER)) AS raw FROM given)""",
        "lowered AS (SELECT *, list_transform(raw, lambda b: CAST(CASE WHEN b BETWEEN 65 AND 90 THEN b + 32 ELSE b END AS HUGEINT)) AS b FROM folded)",
        "starts AS (SELECT r, fold, fifth, label, unnest(range(1, len(b) + 1)) AS i, b FROM lowered)",
        "bytes AS (SELECT r, fold, fifth, label, b[i] + 1 AS b1, b[i + 1] + 1 AS b2, b[i + 2] + 1 AS b3, b[i + 3] + 1 AS b4 FROM starts)",
        """keys AS (SELECT r, fold, fifth, label, unnest([b1 + 1, b1 * 257 + b2 + 2, (b1 * 257 + b2) * 257 + b3 + 3,
  ((b1 * 257 + b2) * 257 + b3) * 257 + b4 + 4]) AS k FROM bytes)""",
        """grams AS (SELECT r, fold, fifth, label, CAST(((k * 11400714819323198485) % 18446744073709551616) // 1099511627776 % 65536 AS INTEGER) AS bucket,
  count(*) AS n FROM keys WHERE k IS NOT NULL GROUP BY ALL)""",
        """learnt AS (SELECT 1 - fold AS fold, label, bucket, sum(n) AS n FROM grams WHERE NOT fifth AND label IS NOT NULL GROUP BY ALL)""",
        "totals AS (SELECT fold, label, sum(n) + 0.05 * 65536 AS whole FROM learnt GROUP BY ALL)",
        """scored AS (SELECT g.r, t.label, sum(g.n * ln((coalesce(l.n, 0) + 0.05) / t.whole)) AS score FROM grams g JOIN totals t ON t.fold = g.fold
  LEFT JOIN learnt l ON l.fold = g.fold AND l.label = t.label AND l.bucket = g.bucket GROUP BY ALL)""",
        "won AS (SELECT r, label FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, label) AS place FROM scored) WHERE place = 1)",
        f"""answer AS (SELECT {shown}, coalesce(w.label, (SELECT min(label) FROM totals)) AS predicted FROM folded f LEFT JOIN won w USING (r))""",
    ]


ORACLES: dict[str, str] = {
    "scan_reviews": _with(
        RAW, STORED, ENRICHED,
        body=f"""SELECT seq, hotel_name, hotel_url, title, round(score, 6) AS score, positive, negative, date, review_date,
  review_hash, language, full_review_processed, sentiment_label, {_SCORES} FROM enriched""",
    ),
    "csv_roundtrip": _with(
        RAW, body="SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in RAW_COLUMNS) + " FROM raw"
    ),
    "source_fallback": _with(
        RAW, CSV_PREPARED,
        body="""SELECT hotel_name, hotel_url, nullif(title, '') AS title, round(score, 6) AS score,
  nullif(positive, '') AS positive, nullif(negative, '') AS negative, date, review_date,
  round(compound_score, 6) AS compound_score FROM csv_prepared""",
    ),
    "export_projection": _with(
        RAW, STORED,
        body="SELECT hotel_name, hotel_url, title, round(score, 6) AS score, positive, negative, date FROM stored",
    ),
    "ingest_new_only": _with(
        RAW,
        body=f"""SELECT seq, hotel_name, hotel_url, title, round({_number('score')}, 6) AS score, positive, negative, date,
  review_date, {_HASH} AS review_hash
FROM raw QUALIFY row_number() OVER (
  PARTITION BY {_HASH} ORDER BY (quality IS NULL OR seq >= {derived.MIRROR_OFFSET}), seq) = 1""",
    ),
    "exact_dedup": _with(RAW, body=f"SELECT DISTINCT {_RAW} FROM first_delivery"),
    "scan_pages": "SELECT page_id, url, length(html) AS html_length, md5(html) AS html_md5 FROM pages",
    "filter_hotel": _with(RAW, body=f"SELECT seq, {_RAW} FROM raw WHERE hotel_name = '{queries.HOTEL}'"),
    "filter_date_range": _with(RAW, body=f"SELECT seq, hotel_name, review_date FROM raw WHERE {_CHOSEN}"),
    "drop_undated": _with(
        RAW, body="SELECT seq, hotel_name, date, review_date FROM raw WHERE review_date IS NOT NULL"
    ),
    "empty_body_audit": _with(
        RAW,
        body="""SELECT count(*) AS total, count(*) FILTER (positive = '' AND negative = '') AS empty_body,
  count(*) FILTER (positive <> '' OR negative <> '') AS with_body FROM raw""",
    ),
    "corpus_by_label": _with(
        RAW, STORED, ENRICHED,
        body="SELECT title || ' ' || full_review_processed AS text FROM enriched WHERE sentiment_label = 'NEG'",
    ),
    "explorer": _prepared(
        f"""SELECT seq, hotel_name, hotel_url, title, round(score, 6) AS score, positive, negative, date, review_date,
  review_hash, language, full_review_processed, sentiment_label, {_SCORES}, round(compound_score, 6) AS compound_score
FROM prepared WHERE hotel_name = '{queries.HOTEL}' AND {_CHOSEN}"""
    ),
    "score_vs_sentiment": _prepared(
        """SELECT round(score, 6) AS score, round(compound_score, 6) AS compound_score, sentiment_label, title, hotel_name
FROM prepared"""
    ),
    "prepare": _with(
        RAW, CSV_PREPARED,
        body="""SELECT seq, hotel_name, review_date, round(score, 6) AS score, round(compound_score, 6) AS compound_score
FROM csv_prepared""",
    ),
    "link_harvest": _with(LINKS, body="FROM harvest"),
    "hotel_links": _with(HOTEL_LINKS, body="FROM harvest"),
    "processed_urls": _with(RAW, body="SELECT DISTINCT hotel_url AS url FROM raw"),
    "resume_pending": _with(HOTEL_LINKS, body="FROM pending"),
    "resume_limited": _with(
        HOTEL_LINKS, body=f"FROM pending ORDER BY first_page, first_place LIMIT {queries.LINK_LIMIT}"
    ),
    "work_chunks": _with(HOTEL_LINKS, body=_chunks("harvest")),
    "work_plan": _with(HOTEL_LINKS, body=_chunks("pending")),
    "per_hotel_cap": _with(
        RAW,
        body=f"""SELECT seq, seq // 25 AS page_no, seq % 25 AS pos, {_RAW} FROM raw
QUALIFY row_number() OVER (PARTITION BY hotel_url ORDER BY seq) <= {queries.REVIEW_CAP}""",
    ),
    "hash_dedup": _with(
        RAW,
        body=f"""SELECT seq, {_HASH} AS review_hash, {_RAW} FROM raw
QUALIFY row_number() OVER (PARTITION BY {_HASH} ORDER BY seq) = 1""",
    ),
    "page_distinct": _with(
        RAW,
        body=f"""SELECT page_id, hotel_name, hotel_url, title, '7' AS score, positive, negative, date, min(seq) AS pos FROM (
  SELECT * REPLACE (replace(hotel_name, ' (mirror)', '') AS hotel_name), (seq % {derived.MIRROR_OFFSET}) // 40 AS page_id FROM raw)
GROUP BY page_id, hotel_name, hotel_url, title, positive, negative, date""",
    ),
    "dedup_stats": _with(
        RAW,
        body="""SELECT initial_rows, final_rows, initial_rows - final_rows AS removed_rows FROM (
  SELECT (SELECT count(*) FROM raw) AS initial_rows,
         (SELECT count(*) FROM (SELECT DISTINCT hotel_url, title, positive, negative, date FROM raw)) AS final_rows)""",
    ),
    "ingest_stats": _with(
        RAW,
        body=f"""SELECT (SELECT count(*) FROM raw) AS batch_size,
  (SELECT count(DISTINCT h) FROM (SELECT {_HASH} AS h FROM raw) WHERE h NOT IN (
     SELECT {_HASH} FROM first_delivery WHERE quality IS NOT NULL)) AS newly_saved""",
    ),
    "review_count": _with(RAW, body="SELECT count(*) AS reviews, (SELECT count(*) FROM events) AS events FROM raw"),
    "date_rejects": _with(
        RAW,
        body="""SELECT count(review_date) AS dated, count(*) FILTER (trim(date) = '') AS blank,
  count(*) FILTER (review_date IS NULL AND trim(date) <> '') AS unread FROM raw""",
    ),
    "hotel_list": _with(
        RAW, CSV_PREPARED, body="SELECT DISTINCT coalesce(hotel_name, 'None') AS hotel_name FROM csv_prepared"
    ),
    "date_bounds": _with(
        RAW,
        body=f"""SELECT min(review_date) AS min_date, max(review_date) AS max_date FROM raw
WHERE hotel_name = '{queries.HOTEL}'""",
    ),
    "kpis": _prepared(
        """SELECT count(*) AS reviews, round(avg(compound_score), 6) AS avg_compound, round(avg(score), 6) AS avg_score
FROM prepared HAVING count(*) > 0"""
    ),
    "sentiment_distribution": _prepared(
        """SELECT sentiment_label, count(*) AS reviews, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM prepared WHERE sentiment_label IS NOT NULL GROUP BY sentiment_label"""
    ),
    "hotel_ranking": _with(
        RAW, STORED,
        """firsts AS (SELECT hotel_name, (coalesce(score, 5) - 5) / 5 AS compound_score
  FROM stored WHERE review_date IS NOT NULL)""",
        body=_RANKING.format(source="firsts"),
    ),
    "monthly_sentiment": _prepared(
        """SELECT last_day(review_date) AS month, round(avg(compound_score), 6) AS compound_score FROM prepared
GROUP BY last_day(review_date)"""
    ),
    "monthly_volume": _with(
        RAW, CSV_PREPARED, body=_MONTHLY_VOLUME.format(source="csv_prepared", label="month", value="reviews")
    ),
    "word_terms_pos": _terms("positive"),
    "word_terms_neg": _terms("negative"),
    "word_cloud_pos": _cloud("positive"),
    "word_cloud_neg": _cloud("negative"),
    "word_bigrams": _with(
        RAW, _cloud_ctes("negative"), body="SELECT w1, w2, c AS n, round(g2, 3) AS score FROM together"
    ),
    "text_gate": _with(
        RAW,
        body="""SELECT CAST(sum(length(positive)) + count(*) - 1 AS BIGINT) AS text_length,
  sum(length(positive)) + count(*) - 1 >= 10 AS enough FROM raw""",
    ),
    "clean_text": _with(RAW, body=f"SELECT seq, {_clean('positive')} AS cleaned FROM raw"),
    "score_normalize": _with(RAW, body=f"SELECT seq, round({_number('score')}, 6) AS score FROM raw"),
    "score_extract": _with(RAW, body=f"SELECT seq, {_score_text('score')} AS score_text FROM raw"),
    "full_review_text": _with(RAW, body=f"SELECT seq, {_FULL} AS full_text FROM raw"),
    "review_hash": _with(RAW, body=f"SELECT seq, {_HASH} AS review_hash FROM raw"),
    "date_parse": _with(RAW, body="SELECT seq, review_date FROM raw"),
    "compound_proxy": _with(
        RAW, body=f"SELECT seq, round((coalesce({_number('score')}, 5) - 5) / 5, 6) AS compound_score FROM raw"
    ),
    "body_fallback": _with(
        RAW,
        body="""SELECT seq, CASE WHEN positive = '' AND negative = '' AND title <> '' THEN title ELSE positive END AS positive
FROM raw""",
    ),
    "compound_sentiment": _with(
        RAW, STORED, ENRICHED,
        body="SELECT seq, round(sentiment_score_pos - sentiment_score_neg, 6) AS compound_score FROM enriched",
    ),
    "hotel_name": rf"""SELECT 'https://stay.example/page/' || doc_id AS url,
  list_extract(['Casa ' || m, 'Lista ' || m, 'Villa ' || m, 'Posada & ' || m, '', 'Hostal' || chr(10) || m, 'Hotel ' || m,
                'Finca ' || m], CAST(doc_id % 8 + 1 AS INTEGER)) AS hotel_name
FROM (SELECT doc_id, source || ' ' || doc_id AS m FROM documents)
UNION ALL
SELECT url, {_strip(f"regexp_replace({_strip('t')}, '-+$', '')")} FROM (
  SELECT url, replace(split_part({_shown("replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&')")},
         '{queries.SITE_MARKER}', 1), 'Updated Prices', '') AS t FROM pages)""",
    "json_ld_name": """SELECT doc_id AS page_id, CASE doc_id % 8 WHEN 0 THEN 'Casa ' || source || ' ' || doc_id
  WHEN 1 THEN 'Lista ' || source || ' ' || doc_id END AS hotel_name FROM documents""",
    "expected_count": """SELECT doc_id AS page_id, CASE doc_id % 4
  WHEN 0 THEN doc_id
  WHEN 1 THEN doc_id * 10 + 5 WHEN 2 THEN doc_id ELSE 0 END AS expected_reviews FROM documents""",
    "review_blocks": _with(RAW, RECORDS, body=f"SELECT page_id, page_no, {_RAW} FROM records"),
    "rejects": "SELECT page_id, 'no_reviews' AS reason FROM pages",
    "ingest": _with(
        RAW, RECORDS,
        f"""capped AS (SELECT *, {_HASH} AS review_hash FROM records
  QUALIFY row_number() OVER (PARTITION BY hotel_url ORDER BY page_no, pos) <= 1000)""",
        f"""held AS (SELECT {_hash('hotel_url', 'date', _shown('title'), _shown('positive'), _shown('negative'))} AS h
  FROM first_delivery WHERE quality IS NOT NULL)""",
        body=f"""SELECT hotel_name, hotel_url, title, round({_number('score')}, 6) AS score, positive, negative, date, review_date,
  review_hash FROM capped WHERE review_hash NOT IN (SELECT h FROM held)
QUALIFY row_number() OVER (PARTITION BY review_hash ORDER BY page_no, page_id, pos) = 1""",
    ),
    "language_detect": _with(RAW, _votes("raw", "spoken"), body="SELECT seq, language FROM spoken"),
    "language_model": _with(
        RAW,
        f"shown AS (SELECT seq, {_clean(_FULL)} AS t FROM raw)",
        body="""SELECT seq, CASE WHEN length(t) < 3 THEN 'unknown'
  WHEN length(replace(t, 'e', '')) < length(replace(t, 'o', '')) THEN 'en' ELSE 'es' END AS language FROM shown""",
    ),
    "sentiment_score": _with(
        RAW, STORED, ENRICHED,
        body=f"SELECT seq, language, sentiment_label, {_SCORES} FROM enriched WHERE language IN ('es', 'en')",
    ),
    "sentiment_batches": _with(
        RAW, _votes("raw", "spoken"),
        """shares AS (SELECT seq, language, CASE WHEN language IN ('es', 'en') THEN
    (length(full_review_processed) - length(replace(full_review_processed, CASE language WHEN 'es' THEN 'o' ELSE 'e' END, '')))
    / length(full_review_processed) END AS s FROM spoken)""",
        body="""SELECT seq, language, CASE WHEN s > 0.1 THEN 'POS' WHEN s <= 0.1 THEN 'NEG' END AS sentiment_label,
  round(coalesce(s, 0), 6) AS sentiment_score_pos,
  CASE WHEN s <= 0.1 THEN round(1 - s, 6) ELSE 0.0 END AS sentiment_score_neg,
  CAST(0.0 AS DOUBLE) AS sentiment_score_neu FROM shares""",
    ),
    "enrich": _with(
        RAW, STORED, ENRICHED,
        body=f"SELECT seq, language, full_review_processed, sentiment_label, {_SCORES} FROM enriched",
    ),
    "enrich_stored": _with(
        RAW, _LABELLED_FIRST, ENRICHED,
        body=f"SELECT seq, language, full_review_processed, sentiment_label, {_SCORES} FROM enriched",
    ),
    "dashboard_overview": _with(
        RAW, STORED, ENRICHED, PREPARED,
        f"chosen AS (SELECT * FROM prepared WHERE {_CHOSEN})",
        "volume AS (" + _MONTHLY_VOLUME.format(source="chosen", label="item", value="value") + ")",
        body=f"""SELECT section, item, round(value, 6) AS value FROM (
SELECT 'kpi' AS section, 'reviews' AS item, CAST(count(*) AS DOUBLE) AS value FROM chosen HAVING count(*) > 0
UNION ALL SELECT 'kpi', 'avg_compound', avg(compound_score) FROM chosen HAVING count(*) > 0
UNION ALL SELECT 'kpi', 'avg_score', avg(score) FROM chosen HAVING count(*) > 0
UNION ALL SELECT 'monthly_sentiment', CAST(last_day(review_date) AS VARCHAR), avg(compound_score) FROM chosen GROUP BY last_day(review_date)
UNION ALL SELECT 'monthly_volume', CAST(item AS VARCHAR), CAST(value AS DOUBLE) FROM volume
UNION ALL SELECT 'sentiment', sentiment_label, CAST(count(*) AS DOUBLE) FROM chosen WHERE sentiment_label IS NOT NULL GROUP BY sentiment_label
UNION ALL SELECT 'ranking', hotel_name, compound_score FROM ({_RANKING.format(source='prepared')})
UNION ALL {_top_terms_of('positive')}
UNION ALL {_top_terms_of('negative')})""",
    ),
    "language_fitted": "WITH " + ", ".join(_fitted(
        "SELECT doc_id AS k, doc_id, lang, lang AS label, coalesce(text, '') AS text FROM documents", "f.doc_id, f.lang"))
    + " SELECT doc_id, lang, predicted AS language FROM answer",
    "sentiment_fitted": _with(
        RAW,
        *_fitted("""SELECT seq AS k, seq, 'POS' AS label, positive AS text FROM raw WHERE positive <> ''
  UNION ALL SELECT seq, seq, 'NEG', negative FROM raw WHERE negative <> ''""", "f.seq, f.label"),
        body="SELECT seq, label, predicted AS sentiment_label FROM answer",
    ),
    "stream_ingest": _with(
        RAW, body=f"SELECT DISTINCT hotel_url, date, title, positive, negative, {_HASH} AS review_hash FROM raw"
    ),
    "stream_dedup": _with(
        RAW,
        body=f"SELECT DISTINCT {_HASH} AS review_hash, hotel_url, date FROM raw",
    ),
    "stream_trend": """SELECT last_day(CAST(ts AS DATE)) AS month, count(*) AS reviews, round(avg(value), 6) AS mean_value
FROM events GROUP BY last_day(CAST(ts AS DATE))""",
}

# The same results by another way.
ORACLES["stream_cap"] = ORACLES["per_hotel_cap"]
ORACLES["monthly_from_sums"] = ORACLES["monthly_sentiment"]
