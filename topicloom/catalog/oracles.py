"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from topicloom.functions.stopwords import ENGLISH

ORACLES: dict[str, str] = {}

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(ENGLISH))
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _tokens(text: str) -> str:
    found = rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}')"
    return f"list_filter({found}, lambda w: w NOT IN ({_STOP}))"


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _strip(text: str) -> str:
    kept = rf"regexp_replace({text}, '[^a-zA-Z0-9\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]', '', 'g')"
    return _trim(kept)


def _without(text: str, words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return (
        f"array_to_string(list_filter(string_split({text}, ' '), "
        f"lambda w: lower(w) NOT IN ({listed})), ' ')"
    )


def _words(text: str) -> str:
    return f"list_distinct(string_split(lower({text}), ' '))"


def _dedupe(text: str) -> str:
    """Repeated words dropped, first use kept."""
    w = f"string_split({text}, ' ')"
    return f"array_to_string(list_filter({w}, lambda x, i: list_position({w}, x) = i), ' ')"


def _grams(source: str, key: str, text: str, lo: int, hi: int, extra: str = "") -> str:
    """CTE body: one row per n-gram occurrence (key, feature)."""
    later = "".join(f", lead(w, {k}) OVER win AS w{k}" for k in range(1, hi))
    parts = []
    for n in range(lo, hi + 1):
        joined = " || ' ' || ".join(["w"] + [f"w{k}" for k in range(1, n)])
        full = f" WHERE w{n - 1} IS NOT NULL" if n > 1 else ""
        parts.append(f"SELECT key, {extra} {joined} AS feature FROM placed_words{full}")
    return f"""
      WITH words AS (
        SELECT key, {extra} unnest(toks) AS w, unnest(range(len(toks))) AS i
        FROM (SELECT {key} AS key, {extra} {_tokens(text)} AS toks FROM {source}) s),
      placed_words AS (
        SELECT key, {extra} w{later} FROM words WINDOW win AS (PARTITION BY key ORDER BY i))
      {" UNION ALL ".join(parts)}"""


def _frequency(source: str, key: str, text: str, lo: int, hi: int, enough: str) -> str:
    """CTEs ending in counts(feature, frequency)."""
    return f"""
    grams AS ({_grams(source, key, text, lo, hi)}),
    raw AS (SELECT feature, count(*) AS f, count(DISTINCT key) AS docs FROM grams GROUP BY feature),
    counts AS (
      SELECT {_dedupe("feature")} AS feature, CAST(sum(f) AS BIGINT) AS frequency
      FROM raw WHERE docs >= {enough} AND length(feature) > 2 GROUP BY 1)"""


_MERGE = """
    sized AS (
      SELECT feature, frequency, string_split(feature, ' ') AS w,
             len(string_split(feature, ' ')) AS n FROM counts),
    runs AS (
      SELECT DISTINCT feature AS larger, frequency AS lf,
             array_to_string(w[i:i + n - 2], ' ') AS feature
      FROM sized, unnest([1, 2]) AS starts(i) WHERE n > 1),
    merged0 AS (
      SELECT s.n AS ngram_size, s.feature, s.frequency,
             greatest(0, s.frequency - coalesce(sum(r.lf) FILTER (WHERE r.lf <= s.frequency), 0)) AS m
      FROM sized s LEFT JOIN runs r ON r.feature = s.feature GROUP BY s.n, s.feature, s.frequency),
    merged AS (
      SELECT ngram_size, feature,
             CAST(m AS DOUBLE) / max(m) OVER () AS merged_frequency,
             CAST(frequency AS DOUBLE) / max(frequency) OVER () AS frequency
      FROM merged0 WHERE m > 0)"""


def _volumes(features: str, source: str, key: str, text: str, volume: str) -> str:
    """CTEs ending in volumes(feature, search_volume)."""
    return f"""
    terms AS (SELECT feature, unnest({_words("feature")}) AS word FROM {features}),
    sizes AS (SELECT feature, count(*) AS n FROM terms GROUP BY feature),
    posts AS (SELECT {key} AS key, {volume} AS v, unnest({_words(text)}) AS word FROM {source}),
    hits AS (
      SELECT t.feature, p.key, any_value(p.v) AS v, count(*) AS found
      FROM terms t JOIN posts p USING (word) GROUP BY t.feature, p.key),
    sums AS (
      SELECT h.feature, sum(h.v) AS v FROM hits h JOIN sizes s ON s.feature = h.feature
      AND s.n = h.found GROUP BY h.feature),
    volumes AS (
      SELECT f.feature, CAST(coalesce(s.v, 0) AS BIGINT) AS search_volume
      FROM (SELECT DISTINCT feature FROM {features}) f LEFT JOIN sums s USING (feature))"""


def _knee(scores: str, order: str) -> str:
    """CTEs over ``scores``(score, ...) ending in walk(rank, next, mx, since_min, n)."""
    return f"""
    ranked AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM {scores}),
    ends AS (SELECT count(*) AS n, min(score) AS lo, max(score) AS hi FROM ranked),
    curve AS (
      SELECT rank, score, n, (1.0 - (score - lo) / (hi - lo)) - CAST(rank - 1 AS DOUBLE) / (n - 1) AS d
      FROM ranked, ends),
    near AS (
      SELECT *, lag(d) OVER (ORDER BY rank) AS prev, lead(d) OVER (ORDER BY rank) AS next FROM curve),
    marked AS (
      SELECT *, CASE WHEN d >= coalesce(prev, d) AND d >= coalesce(next, d) THEN rank END AS mx,
             CASE WHEN d <= coalesce(prev, d) AND d <= coalesce(next, d) THEN rank END AS mn
      FROM near),
    latest AS (
      SELECT rank, next, n, max(mx) OVER w AS mx, max(mn) OVER w AS mn FROM marked
      WINDOW w AS (ORDER BY rank ROWS UNBOUNDED PRECEDING)),
    walk AS (
      SELECT l.rank, l.next, l.mx, l.n, c.d AS d, c.score AS score, coalesce(l.mn >= l.mx, false) AS low
      FROM latest l JOIN curve c ON c.rank = l.mx),
    fires AS (
      SELECT s, rank, mx, score FROM walk, sens
      WHERE next < CASE WHEN low THEN 0.0 ELSE d - s * (1.0 / (n - 1)) END),
    knees AS (
      SELECT sens.s, min_by(f.mx, f.rank) AS knee, min_by(f.score, f.rank) AS score
      FROM sens LEFT JOIN fires f ON f.s = sens.s GROUP BY sens.s)"""


_PART_LOG = """
    part_log AS (
      SELECT p_partkey AS id, p_name AS query, p_brand AS page,
             coalesce(volume, 0) AS volume, coalesce(clicks, 0) AS clicks
      FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS volume, count(*) AS clicks
                           FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)"""

_WORD_SCORES = f"""
    word_grams AS ({_grams("documents", "doc_id", "text", 1, 1)}),
    word_scores AS (SELECT feature AS query, CAST(count(*) AS DOUBLE) AS score
                    FROM word_grams GROUP BY feature)"""

_CENTERS = """
    cells AS (SELECT vec_id AS id, label, unnest(embedding) AS x, unnest(range(64)) AS pos FROM embeddings),
    means AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM cells GROUP BY label, pos),
    centers AS (SELECT label, list(m ORDER BY pos) AS c FROM means GROUP BY label),
    vecs AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""

_BRAND_LIST = ["tion", "thor", "the of"]

# --- sources and sinks --------------------------------------------------------------

ORACLES["read_queries_csv"] = f"""
WITH {_PART_LOG}
SELECT query, page, CAST(trunc(volume) AS BIGINT) AS search_volume FROM part_log"""

ORACLES["read_queries_table"] = """
SELECT doc_id, text AS query, n_chars AS search_volume FROM documents"""

ORACLES["performance_rollup"] = """
SELECT event_type AS query, 'https://site.example/' || user_id AS page,
       CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks,
       CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS impressions
FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-23' AND DATE '2024-01-30'
GROUP BY 1, 2"""

ORACLES["read_queries_performance"] = """
SELECT 'user ' || user_id AS query, '/' AS page, count(*) AS clicks,
       CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS impressions
FROM events WHERE event_type = 'click' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-30'
GROUP BY 1, 2"""

ORACLES["property_listing"] = r"""
SELECT url AS property, regexp_replace(url, 'https?://(www\.)?|sc-domain:', '', 'g') AS property_domain,
       'gsc' AS type, CAST(NULL AS VARCHAR) AS "table" FROM pages"""

ORACLES["find_property"] = r"""
SELECT page_id, url AS property FROM pages WHERE regexp_matches(url, 'example\.(org|net)/en')"""

ORACLES["write_table"] = "SELECT doc_id, text, lang FROM documents"

ORACLES["parse_category_lines"] = "SELECT p_name AS ngram, p_type AS category FROM part"

ORACLES["topics_markdown"] = r"""
WITH t AS (SELECT p_name AS query, avg(p_retailprice) AS score FROM part GROUP BY p_name)
SELECT '| query | score |' || chr(10) || '|:---|---:|' || chr(10) ||
       string_agg(printf('| %s | %.6f |', query, score), chr(10) ORDER BY score DESC, query) AS markdown
FROM (SELECT * FROM t ORDER BY score DESC, query LIMIT 1000)"""

# --- projections and filters ----------------------------------------------------------

ORACLES["detect_url"] = """
SELECT 'url' AS "column" FROM pages HAVING count(*) > 0"""

ORACLES["rename_url"] = "SELECT page_id, url AS page FROM pages"

_CLEAN_DOCS = f"""
    cleaned AS (
      SELECT {_strip(_without("text", _BRAND_LIST))} AS query, source AS page,
             n_chars AS search_volume, text AS original_query, doc_id FROM documents)"""

ORACLES["clean_queries_file"] = f"""
WITH {_CLEAN_DOCS}
SELECT query, page, search_volume, original_query FROM cleaned WHERE length(query) >= 3
QUALIFY row_number() OVER (PARTITION BY page ORDER BY search_volume DESC, query, original_query) <= 5"""

ORACLES["clean_queries_file_all"] = f"""
WITH {_CLEAN_DOCS}
SELECT query, page, search_volume, original_query FROM cleaned WHERE length(query) >= 3"""

ORACLES["clean_queries_performance"] = f"""
WITH {_PART_LOG},
stripped AS (
  SELECT {_strip("lower(query)")} AS q, page, clicks, CAST(trunc(volume) AS BIGINT) AS search_volume,
         query AS original_query FROM part_log),
cut AS (SELECT {_without("q", ["ring", "old"])} AS query, * EXCLUDE (q) FROM stripped WHERE length(q) >= 3)
SELECT query, page, clicks, search_volume, original_query FROM cut
QUALIFY row_number() OVER (
  PARTITION BY page ORDER BY clicks DESC, search_volume DESC, query, original_query) <= 5"""

ORACLES["remove_terms"] = f"""
SELECT conv_id, turn, {_without("text", _BRAND_LIST)} AS query FROM conversations"""

_PHRASE = r"(?i)(^|\s)of the(?:\s|$)"
ORACLES["remove_terms_phrases"] = rf"""
SELECT conv_id, turn,
       regexp_replace(regexp_replace(text, '{_PHRASE}', '\1', 'g'), '{_PHRASE}', '\1', 'g') AS query
FROM conversations"""

ORACLES["integer_volume"] = r"""
SELECT event_id, CAST(trunc(value) AS BIGINT) AS volume,
       coalesce(CAST(regexp_extract(props, '"k": (\d+)', 1) AS BIGINT), 0) AS from_text,
       CAST(0 AS BIGINT) AS not_a_number FROM events"""

ORACLES["sample_rows"] = """
SELECT doc_id, lang FROM documents ORDER BY md5('42-' || doc_id), doc_id LIMIT 100"""

ORACLES["top_n_per_group"] = """
SELECT l_suppkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       round(l_extendedprice, 6) AS l_extendedprice FROM lineitem
QUALIFY row_number() OVER (
  PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 5"""

# --- text functions ---------------------------------------------------------------------

ORACLES["tokenize"] = f"""
SELECT conv_id, turn, coalesce(array_to_string({_tokens("text")}, ' '), '') AS tokens FROM conversations"""

ORACLES["row_ngrams"] = f"""
WITH t AS (SELECT conv_id, turn, {_tokens("text")} AS w FROM conversations)
SELECT conv_id, turn, coalesce(array_to_string(list_concat(
         list_transform(range(1, CAST(greatest(len(w) - 1, 0) + 1 AS BIGINT)), lambda i: array_to_string(w[i:i + 1], ' ')),
         list_transform(range(1, CAST(greatest(len(w) - 2, 0) + 1 AS BIGINT)), lambda i: array_to_string(w[i:i + 2], ' '))), '|'), '')
       AS ngrams FROM t"""

ORACLES["distinct_words"] = f"""
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word,
                  unnest(range(len(string_split(text, ' ')))) AS i FROM documents),
firsts AS (SELECT doc_id, word, min(i) AS i, count(*) AS n FROM w GROUP BY doc_id, word)
SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words, CAST(sum(n) AS BIGINT) AS n_words
FROM firsts GROUP BY doc_id"""

ORACLES["split_response"] = f"""
SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ','), lambda x: {_trim("x")}), '|')
       AS names FROM conversations"""

ORACLES["parse_sections"] = rf"""
SELECT conv_id, turn, 'turn ' || turn AS role,
       {_trim(f"array_to_string(list_transform(regexp_split_to_array(text, chr(10) || '+'), lambda x: {_trim('x')}), chr(10) || chr(10))")} AS body
FROM conversations"""

ORACLES["parse_request"] = r"""
WITH a AS (SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9:/,.\-]', '', 'g') AS u FROM pages)
SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN u END AS property,
       CASE WHEN page_id % 3 <> 0 THEN page_id % 90 END AS days,
       CAST(page_id % 3 = 0 AS BIGINT) AS failed FROM a"""

_OUTLINE = """
    pairs AS (SELECT DISTINCT p_brand, p_type, p_name FROM part),
    entries AS (
      SELECT p_brand, p_type, NULL AS p_name, p_brand || ' > ' || p_type AS path
      FROM pairs GROUP BY p_brand, p_type
      UNION ALL
      SELECT p_brand, p_type, p_name, p_brand || ' > ' || p_type || ' > ' || p_name FROM pairs),
    paths AS (
      SELECT p_brand, CAST(row_number() OVER (
               PARTITION BY p_brand ORDER BY p_type, p_name NULLS FIRST) - 1 AS BIGINT) AS position, path
      FROM entries)"""

ORACLES["outline_paths"] = f"WITH {_OUTLINE} SELECT p_brand, position, path FROM paths"

ORACLES["category_table"] = f"""
WITH {_OUTLINE}
SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS BIGINT) AS category_id, path,
       replace(path, ' > ', ' ') AS path_text FROM (SELECT DISTINCT path FROM paths)
UNION ALL SELECT -1, 'Miscellaneous', 'Miscellaneous'"""

ORACLES["path_levels"] = f"""
WITH {_OUTLINE}, s AS (SELECT path, string_split(path, ' > ') AS l FROM paths)
SELECT path, l[1] AS level_1, l[2] AS level_2, l[3] AS level_3 FROM s"""

# --- n-grams and scores -------------------------------------------------------------------

ORACLES["ngram_frequency"] = f"""
WITH {_frequency("documents", "doc_id", "text", 1, 5, "5")} SELECT feature, frequency FROM counts"""

ORACLES["ngram_frequency_share"] = f"""
WITH {_frequency("conversations", "conv_id * 100000 + turn", "text", 1, 3,
                 "0.02 * (SELECT count(*) FROM conversations)")}
SELECT feature, frequency FROM counts"""

ORACLES["merge_ngrams"] = f"""
WITH {_frequency("documents", "doc_id", "text", 1, 5, "5")}, {_MERGE}
SELECT CAST(ngram_size AS BIGINT) AS ngram_size, feature, round(merged_frequency, 6) AS merged_frequency,
       round(frequency, 6) AS frequency FROM merged"""

ORACLES["containment"] = f"""
WITH {_frequency("part", "p_partkey", "p_name", 1, 2, "1")}
SELECT feature, p_partkey FROM counts, part
WHERE list_has_all(string_split(lower(p_name), ' '), string_split(feature, ' '))"""

ORACLES["containment_shuffled"] = ORACLES["containment"]

ORACLES["ngram_volumes"] = f"""
WITH {_frequency("documents", "doc_id", "text", 1, 3, "5")},
{_volumes("counts", "documents", "doc_id", "text", "n_chars")}
SELECT feature, search_volume FROM volumes"""

ORACLES["max_scale"] = f"""
WITH {_PART_LOG}, s AS (SELECT page, sum(volume) AS volume, sum(clicks) AS clicks FROM part_log GROUP BY page)
SELECT page, round(volume / max(volume) OVER (), 6) AS volume,
       round(CAST(clicks AS DOUBLE) / max(clicks) OVER (), 6) AS clicks FROM s"""

ORACLES["row_mean"] = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_discount, 6) AS l_discount,
       round(CASE WHEN l_returnflag = 'R' THEN l_tax END, 6) AS tax,
       round(CASE WHEN l_returnflag = 'R' THEN (l_discount + l_tax) / 2 ELSE l_discount END, 6) AS score
FROM lineitem"""

_SCORED = """
    scored AS (
      SELECT m.feature AS query, m.ngram_size,
             CAST(v.search_volume AS DOUBLE) / max(v.search_volume) OVER () AS search_volume,
             m.merged_frequency, m.frequency,
             (CAST(v.search_volume AS DOUBLE) / max(v.search_volume) OVER () + m.merged_frequency) / 2 AS score
      FROM merged m JOIN volumes v USING (feature))"""

ORACLES["scored_topics_parts"] = f"""
WITH {_PART_LOG}, log AS (SELECT id, query, CAST(trunc(volume) AS BIGINT) AS volume FROM part_log),
{_frequency("log", "id", "query", 1, 2, "5")}, {_MERGE},
{_volumes("merged", "log", "id", "query", "volume")}, {_SCORED}
SELECT query, CAST(ngram_size AS BIGINT) AS ngram_size, round(search_volume, 6) AS search_volume,
       round(merged_frequency, 6) AS merged_frequency, round(frequency, 6) AS frequency,
       round(score, 6) AS score FROM scored"""

_SWEEP_S = "sens AS (SELECT CAST(1000 - 20 * unnest(range(50)) AS DOUBLE) AS s)"

ORACLES["score_topics_documents"] = f"""
WITH log AS (SELECT * FROM (SELECT doc_id, {_strip("text")} AS query, n_chars FROM documents)
             WHERE length(query) >= 3),
{_frequency("log", "doc_id", "query", 1, 5, "5")}, {_MERGE},
{_volumes("merged", "log", "doc_id", "query", "n_chars")}, {_SCORED}, {_SWEEP_S},
{_knee("scored", "score DESC, query")},
keep AS (
  SELECT CASE WHEN (SELECT count(*) FROM scored) <= 1000 THEN 1000
              ELSE coalesce(max_by(knee, s) FILTER (WHERE knee <= 1000), 1000) END AS n FROM knees)
SELECT query, round(search_volume, 6) AS search_volume, round(merged_frequency, 6) AS merged_frequency,
       round(score, 6) AS score
FROM ranked, keep WHERE rank <= keep.n"""

# --- ranks and knees ------------------------------------------------------------------------

ORACLES["global_rank"] = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       round(l_extendedprice, 6) AS l_extendedprice,
       row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem"""

ORACLES["knee_points"] = f"""
WITH {_WORD_SCORES}, sens AS (SELECT unnest([100.0::DOUBLE, 20.0, 5.0, 1.0]) AS s),
{_knee("word_scores", "score DESC, query")}
SELECT s, knee, round(score, 6) AS score FROM knees"""

ORACLES["knee_filter"] = f"""
WITH {_WORD_SCORES}, sens AS (SELECT 1.0::DOUBLE AS s), {_knee("word_scores", "score DESC, query")}
SELECT query, round(score, 6) AS score FROM ranked
WHERE rank <= coalesce((SELECT knee FROM knees), rank)"""

ORACLES["knee_sweep"] = f"""
WITH {_WORD_SCORES}, {_SWEEP_S}, {_knee("word_scores", "score DESC, query")}
SELECT max(s) AS s, coalesce(max_by(knee, s), 1000) AS knee FROM knees WHERE knee <= 1000"""

ORACLES["select_topics"] = f"""
WITH {_WORD_SCORES}, {_SWEEP_S}, {_knee("word_scores", "score DESC, query")},
keep AS (SELECT greatest(300, coalesce(max_by(knee, s), 1000)) AS n FROM knees WHERE knee <= 1000)
SELECT query, round(score, 6) AS score FROM ranked, keep
WHERE rank <= CASE WHEN (SELECT n FROM ends) <= 1000 THEN 1000 ELSE keep.n END"""

ORACLES["select_topics_floor"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS query, round(o_totalprice, 6) AS score FROM orders
ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 1200"""

ORACLES["percentile"] = """
SELECT round(quantile_cont(l_extendedprice, 0.375), 6) AS value FROM lineitem"""

# --- joins by name ---------------------------------------------------------------------------

ORACLES["lookup_code"] = """
WITH dim AS (SELECT lower(p_name) AS name, min(p_partkey) AS pos, min_by(p_brand, p_partkey) AS code
             FROM part GROUP BY lower(p_name)),
asked AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name)
                 ELSE regexp_extract(p_name, '([^ ]*)$', 1) END AS name_asked FROM part),
names AS (SELECT DISTINCT name_asked FROM asked),
found AS (
  SELECT n.name_asked,
         coalesce(any_value(d.code) FILTER (WHERE d.name = lower(n.name_asked)), min_by(d.code, d.pos)) AS code
  FROM names n LEFT JOIN dim d ON contains(d.name, lower(n.name_asked)) GROUP BY n.name_asked)
SELECT p_partkey, name_asked, code FROM asked JOIN found USING (name_asked)"""

ORACLES["cross_pairs"] = """
WITH a AS (SELECT DISTINCT regexp_extract(p_name, '([^ ]*)$', 1) AS item1 FROM part),
b AS (SELECT DISTINCT lower(p_type) AS item2 FROM part UNION ALL SELECT item1 FROM a)
SELECT item1, item2 FROM a, b WHERE item1 <> item2"""

# --- vectors ----------------------------------------------------------------------------------

ORACLES["l2_normalize"] = f"""
WITH {_CENTERS}, len AS (SELECT id, sqrt(sum(CAST(x AS DOUBLE) * 3 * CAST(x AS DOUBLE) * 3)) AS l FROM cells GROUP BY id)
SELECT id, pos AS position, round(CAST(x AS DOUBLE) * 3 / l, 6) AS value FROM cells JOIN len USING (id)"""

ORACLES["cosine_to_label"] = f"""
WITH {_CENTERS}
SELECT id, round(list_cosine_similarity(v, c), 6) AS similarity, round(list_distance(v, c), 6) AS distance
FROM vecs JOIN centers USING (label)"""

_RATED = f"""
WITH {_CENTERS},
rated AS (SELECT v.id, c.label AS category_id, list_cosine_similarity(v, c) AS similarity,
                 row_number() OVER (PARTITION BY v.id ORDER BY list_cosine_similarity(v, c) DESC, c.label) AS position
          FROM vecs v, centers c)"""

ORACLES["nearest_category"] = f"""{_RATED}
SELECT id, CAST(category_id AS BIGINT) AS category_id, round(similarity, 6) AS similarity
FROM rated WHERE position = 1"""

ORACLES["top_categories"] = f"""{_RATED}
SELECT id, position, CAST(category_id AS BIGINT) AS category_id, round(similarity, 6) AS similarity
FROM rated WHERE position <= 3"""

ORACLES["label_centroids"] = f"""
WITH {_CENTERS}
SELECT CAST(label AS BIGINT) AS label, (SELECT count(*) FROM vecs v WHERE v.label = m.label) AS size,
       pos AS position, round(m, 6) AS value FROM means m"""

_NEIGHBORS = """
dist AS (SELECT a.id, b.id AS neighbor, round(list_distance(a.v, b.v), 7) AS d FROM vecs a, vecs b),
near AS (SELECT id, neighbor, d, row_number() OVER (
           PARTITION BY id ORDER BY (id <> neighbor), d, neighbor) AS position FROM dist)"""

ORACLES["knn"] = f"""
WITH {_CENTERS}, {_NEIGHBORS}
SELECT id, neighbor, position, CAST(round(d * 1e7) AS BIGINT) AS distance_e7 FROM near WHERE position <= 4"""

ORACLES["knn_blocked"] = ORACLES["knn"]

_CURVE = """
sorted AS (SELECT d, row_number() OVER (PARTITION BY position ORDER BY d) AS rank FROM near WHERE position <= {k}),
curve0 AS (SELECT rank, avg(d) AS distance FROM sorted GROUP BY rank)"""

ORACLES["knn_curve"] = f"""
WITH {_CENTERS}, {_NEIGHBORS}, {_CURVE.format(k=4)}
SELECT rank, CAST(round(distance * 4e7) AS BIGINT) AS distance_4e7 FROM curve0"""

ORACLES["epsilon"] = f"""
WITH {_CENTERS}, {_NEIGHBORS}, {_CURVE.format(k=3)},
points AS (SELECT distance AS score, rank AS place FROM curve0), sens AS (SELECT 1.0::DOUBLE AS s),
{_knee("points", "score DESC, place DESC").replace("near AS", "around AS").replace("FROM near)", "FROM around)")}
SELECT (SELECT count(*) FROM vecs) AS n,
       round(coalesce(nullif((SELECT score FROM knees), 0), (SELECT avg(score) FROM points)), 6) AS epsilon"""

ORACLES["silhouette"] = f"""
WITH {_CENTERS},
sq AS (SELECT a.id, a.label, b.label AS other, sum(power(list_distance(a.v, b.v), 2)) AS total, count(*) AS n
       FROM vecs a, vecs b GROUP BY ALL),
own AS (SELECT id, label, total / (n - 1) AS a FROM sq WHERE label = other),
rest AS (SELECT id, min(total / n) AS b FROM sq WHERE label <> other GROUP BY id)
SELECT id, CAST(label AS BIGINT) AS label, round((b - a) / greatest(a, b), 6) AS silhouette
FROM own JOIN rest USING (id)"""

ORACLES["silhouette_euclidean"] = f"""
WITH {_CENTERS},
sq AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS total, count(*) AS n
       FROM vecs a, vecs b GROUP BY ALL),
own AS (SELECT id, label, total / (n - 1) AS a FROM sq WHERE label = other),
rest AS (SELECT id, min(total / n) AS b FROM sq WHERE label <> other GROUP BY id)
SELECT id, CAST(label AS BIGINT) AS label, round((b - a) / greatest(a, b), 6) AS silhouette
FROM own JOIN rest USING (id)"""

_FISHED = """
WITH lab AS (SELECT vec_id AS id, CASE WHEN label >= 8 THEN -1 ELSE label END AS label,
                    CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cells AS (SELECT id, label, unnest(v) AS x, unnest(range(64)) AS pos FROM lab),
means AS (SELECT label, pos, avg(x) AS m FROM cells GROUP BY label, pos),
centers AS (SELECT label, list(m ORDER BY pos) AS c FROM means GROUP BY label),
moved AS (SELECT l.id, l.v, min_by(c.label, list_distance(l.v, c.c)) AS label
          FROM lab l, centers c WHERE l.label = -1 GROUP BY l.id, l.v)"""

ORACLES["outliers_to_nearest"] = f"""{_FISHED}
SELECT id, CAST(label AS BIGINT) AS label FROM lab WHERE label <> -1
UNION ALL SELECT id, CAST(label AS BIGINT) FROM moved"""

ORACLES["outliers_to_nearest_gated"] = f"""{_FISHED},
sq AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS total, count(*) AS n
       FROM moved a, moved b GROUP BY ALL),
own AS (SELECT id, label, n, CASE WHEN n > 1 THEN total / (n - 1) END AS a FROM sq WHERE label = other),
rest AS (SELECT id, min(total / n) AS b FROM sq WHERE label <> other GROUP BY id),
sil AS (SELECT id, label, CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM own JOIN rest USING (id))
SELECT id, CAST(label AS BIGINT) AS label FROM lab WHERE label <> -1
UNION ALL SELECT id, CAST(CASE WHEN s > 0 THEN label ELSE -1 END AS BIGINT) FROM sil"""

ORACLES["outliers_to_nearest_squared"] = f"""{_FISHED},
sq AS (SELECT a.id, a.label, b.label AS other, sum(power(list_distance(a.v, b.v), 2)) AS total, count(*) AS n
       FROM moved a, moved b GROUP BY ALL),
own AS (SELECT id, label, n, CASE WHEN n > 1 THEN total / (n - 1) END AS a FROM sq WHERE label = other),
rest AS (SELECT id, min(total / n) AS b FROM sq WHERE label <> other GROUP BY id),
sil AS (SELECT id, label, CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM own JOIN rest USING (id))
SELECT id, CAST(label AS BIGINT) AS label FROM lab WHERE label <> -1
UNION ALL SELECT id, CAST(CASE WHEN s > 0 THEN label ELSE -1 END AS BIGINT) FROM sil"""

ORACLES["label_counts"] = """
SELECT count(DISTINCT CASE WHEN label >= 8 THEN -1 ELSE label END) AS labels,
       count(*) FILTER (WHERE label >= 8) AS outliers FROM embeddings"""

_REACH = """
reach AS (SELECT id, id AS root FROM nodes UNION SELECT l.b AS id, r.root FROM reach r JOIN links l ON l.a = r.id),
groups AS (SELECT id, min(root) AS g FROM reach GROUP BY id)"""

ORACLES["density_groups"] = f"""
WITH RECURSIVE {_CENTERS}, {_NEIGHBORS},
nodes AS (SELECT id FROM near WHERE position = 3 AND d <= 1.12),
links AS (SELECT id AS a, neighbor AS b FROM dist
          WHERE d <= 1.12 AND id IN (FROM nodes) AND neighbor IN (FROM nodes)),
{_REACH},
big AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS label FROM groups GROUP BY g HAVING count(*) >= 5)
SELECT v.id, CAST(coalesce(b.label, -1) AS BIGINT) AS label
FROM vecs v LEFT JOIN groups USING (id) LEFT JOIN big b USING (g)"""

ORACLES["threshold_groups"] = f"""
WITH RECURSIVE {_CENTERS}, {_NEIGHBORS},
nodes AS (SELECT id FROM vecs),
links AS (SELECT id AS a, neighbor AS b FROM dist WHERE d <= 1.05),
{_REACH},
named AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS label FROM groups GROUP BY g)
SELECT id, label FROM groups JOIN named USING (g)"""

ORACLES["density_hierarchy"] = f"""
WITH RECURSIVE {_CENTERS}, {_NEIGHBORS},
core AS (SELECT id, d AS c FROM near WHERE position = 3),
link AS MATERIALIZED (
  SELECT dist.id AS a, neighbor AS b, greatest(d, x.c, y.c) AS w
  FROM dist JOIN core x ON x.id = dist.id JOIN core y ON y.id = neighbor WHERE dist.id <> neighbor),
prim(node, src, w, done) USING KEY (node) AS (
  SELECT id, CAST(NULL AS BIGINT), CASE WHEN id = (SELECT min(id) FROM vecs) THEN -1.0 ELSE 'inf'::DOUBLE END, false FROM vecs
  UNION
  (WITH here AS (SELECT node, src, w FROM recurring.prim WHERE NOT done ORDER BY w, node LIMIT 1)
   SELECT node, src, w, true FROM here
   UNION ALL
   SELECT p.node, h.node, l.w, false FROM here h JOIN link l ON l.a = h.node
   JOIN recurring.prim p ON p.node = l.b WHERE NOT p.done AND l.w < p.w)),
edges AS (SELECT src AS a, node AS b, w, row_number() OVER (ORDER BY w, node) AS k FROM prim WHERE w >= 0),
ids AS (SELECT list(id ORDER BY id) AS l FROM vecs),
steps(k, g) AS (
  SELECT 0::BIGINT, list_transform(l, lambda x, i: CAST(i AS BIGINT)) FROM ids
  UNION ALL
  SELECT e.k, list_transform(g, lambda x: CASE WHEN x = greatest(g[list_position(l, a)], g[list_position(l, b)])
                                             THEN least(g[list_position(l, a)], g[list_position(l, b)]) ELSE x END)
  FROM steps s JOIN edges e ON e.k = s.k + 1, ids),
levels AS (
  SELECT row_number() OVER (ORDER BY w) AS k, w, g FROM (
    SELECT w, g FROM edges JOIN steps USING (k) QUALIFY row_number() OVER (PARTITION BY w ORDER BY edges.k DESC) = 1)),
spots AS (SELECT k, w, unnest(g) AS lab, unnest(range(1, len(g) + 1)) AS p FROM levels),
large AS (SELECT k, w, lab, count(*) AS n FROM spots GROUP BY ALL HAVING count(*) >= 5),
inner_ AS (
  SELECT l.k, l.lab, count(DISTINCT s.lab) AS c, min(s.lab) AS one
  FROM large l LEFT JOIN (
    SELECT s.k + 1 AS k, t.lab AS up, s.lab FROM large s JOIN spots t ON t.k = s.k + 1 AND t.p = s.lab) s
  ON s.k = l.k AND s.up = l.lab GROUP BY ALL),
named(k, lab, ck, cl) AS (
  SELECT k, lab, k, lab FROM inner_ WHERE c <> 1
  UNION ALL
  SELECT i.k, i.lab, n.ck, n.cl FROM named n JOIN inner_ i ON i.k = n.k + 1 AND i.c = 1 AND i.one = n.lab),
clusters AS (
  SELECT n.ck, n.cl, min(l.w) AS death, max(n.k) AS last, max(l.n) AS size FROM named n JOIN large l USING (k, lab) GROUP BY ALL),
tops AS (
  SELECT c.ck, c.cl, c.death, c.size, up.ck AS pk, up.cl AS pl, lv.w AS birth
  FROM clusters c JOIN named n ON n.ck = c.ck AND n.cl = c.cl AND n.k = c.last
  LEFT JOIN spots t ON t.k = c.last + 1 AND t.p = n.lab
  LEFT JOIN named up ON up.k = t.k AND up.lab = t.lab
  LEFT JOIN levels lv ON lv.k = t.k),
fallen AS (
  SELECT s.p, min(s.k) AS k FROM spots s JOIN large USING (k, lab) GROUP BY s.p),
homes AS (
  SELECT f.p, n.ck, n.cl, s.w FROM fallen f JOIN spots s ON s.p = f.p AND s.k = f.k JOIN named n ON n.k = s.k AND n.lab = s.lab),
loose AS (SELECT ck, cl, sum(1 / greatest(w, 1e-9)) AS mass FROM homes GROUP BY ALL),
passed AS (SELECT pk AS ck, pl AS cl, sum(size / greatest(birth, 1e-9)) AS mass FROM tops WHERE pk IS NOT NULL GROUP BY ALL),
own AS (
  SELECT t.*, coalesce(l.mass, 0) + coalesce(q.mass, 0) - coalesce(size / greatest(birth, 1e-9), 0) AS worth
  FROM tops t LEFT JOIN loose l USING (ck, cl) LEFT JOIN passed q USING (ck, cl)),
deep(ck, cl, depth) AS (
  SELECT ck, cl, 0 FROM own WHERE pk IS NULL
  UNION ALL SELECT o.ck, o.cl, depth + 1 FROM own o JOIN deep d ON o.pk = d.ck AND o.pl = d.cl),
rated(depth, ck, cl, pk, pl, best, chosen) AS (
  SELECT max(depth) + 1, -1::BIGINT, -1::BIGINT, -1::BIGINT, -1::BIGINT, 0.0::DOUBLE, false FROM deep
  UNION ALL
  (WITH below AS (SELECT pk, pl, sum(best) AS best FROM rated GROUP BY ALL), lev AS (SELECT min(depth) - 1 AS depth FROM rated)
   SELECT d.depth, o.ck, o.cl, o.pk, o.pl, greatest(worth, coalesce(b.best, worth)),
          o.pk IS NOT NULL AND (b.best IS NULL OR worth >= b.best)
   FROM lev JOIN deep d ON d.depth = lev.depth JOIN own o ON o.ck = d.ck AND o.cl = d.cl
   LEFT JOIN below b ON b.pk = o.ck AND b.pl = o.cl)),
owned(ck, cl, ok, ol) AS (
  SELECT ck, cl, CASE WHEN chosen THEN ck END, CASE WHEN chosen THEN cl END FROM rated WHERE depth = 0
  UNION ALL
  SELECT r.ck, r.cl, coalesce(o.ok, CASE WHEN r.chosen THEN r.ck END), coalesce(o.ol, CASE WHEN r.chosen THEN r.cl END)
  FROM owned o JOIN rated r ON r.pk = o.ck AND r.pl = o.cl),
picked AS (SELECT h.p, ok, ol FROM homes h JOIN owned o ON o.ck = h.ck AND o.cl = h.cl WHERE ok IS NOT NULL),
numbers AS (SELECT ok, ol, row_number() OVER (ORDER BY min(p)) - 1 AS label FROM picked GROUP BY ALL)
SELECT v.id, CAST(coalesce(label, -1) AS BIGINT) AS label
FROM (SELECT id, row_number() OVER (ORDER BY id) AS p FROM vecs) v LEFT JOIN picked USING (p) LEFT JOIN numbers USING (ok, ol)"""

ORACLES["density_hierarchy_blocked"] = ORACLES["density_hierarchy"]
ORACLES["ward_groups"] = f"""
WITH RECURSIVE {_CENTERS}, {_NEIGHBORS},
ward(a, b, d, na, nb, cost) USING KEY (a, b) AS (
  SELECT a.id, b.id, list_distance(a.v, b.v) ** 2, 1.0::DOUBLE, 1.0::DOUBLE, CAST(NULL AS DOUBLE)
  FROM vecs a, vecs b WHERE a.id < b.id
  UNION
  (WITH best AS (SELECT a, b, d, na, nb FROM recurring.ward WHERE d < 'inf'::DOUBLE ORDER BY d, a, b LIMIT 1),
   other AS (
     SELECT w.a, w.b, w.d, w.na, w.nb, x.a AS i, x.b AS j, x.d AS dij, x.na AS ni, x.nb AS nj,
            CASE WHEN w.a IN (x.a, x.b) THEN w.b ELSE w.a END AS k, CASE WHEN w.a IN (x.a, x.b) THEN w.nb ELSE w.na END AS nk,
            x.a IN (w.a, w.b) AS stays
     FROM recurring.ward w, best x WHERE w.d < 'inf'::DOUBLE AND (w.a IN (x.a, x.b)) <> (w.b IN (x.a, x.b)))
   SELECT a, b, 'inf'::DOUBLE, na, nb, d FROM best
   UNION ALL
   SELECT a, b, 'inf'::DOUBLE, na, nb, CAST(NULL AS DOUBLE) FROM other WHERE NOT stays
   UNION ALL
   SELECT s.a, s.b, ((s.ni + s.nk) * s.d + (s.nj + s.nk) * l.d - s.nk * s.dij) / (s.ni + s.nj + s.nk),
          CASE WHEN s.a = s.i THEN s.ni + s.nj ELSE s.na END, CASE WHEN s.b = s.i THEN s.ni + s.nj ELSE s.nb END, CAST(NULL AS DOUBLE)
   FROM other s JOIN other l ON s.k = l.k WHERE s.stays AND NOT l.stays)),
nodes AS (SELECT id FROM vecs),
kept AS (SELECT a, b FROM ward WHERE cost IS NOT NULL ORDER BY cost DESC OFFSET 9),
links AS (SELECT a, b FROM kept UNION ALL SELECT b, a FROM kept),
{_REACH},
named AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS label FROM groups GROUP BY g)
SELECT id, label FROM groups JOIN named USING (g)"""

ORACLES["density_groups_blocked"] = ORACLES["density_groups"]
ORACLES["threshold_groups_blocked"] = ORACLES["threshold_groups"]

ORACLES["recluster"] = """
WITH first AS (SELECT label, row_number() OVER (ORDER BY min(vec_id)) - 1 AS r
               FROM embeddings WHERE label >= 8 GROUP BY label),
top AS (SELECT max(label) + 1 AS t FROM embeddings WHERE label < 8)
SELECT vec_id AS id, CAST(CASE WHEN label < 8 THEN label ELSE t + r END AS BIGINT) AS label
FROM embeddings LEFT JOIN first USING (label), top"""

ORACLES["encode"] = f"""
SELECT doc_id, CAST(64 AS BIGINT) AS size, CASE WHEN len({_tokens("text")}) > 0 THEN 1.0 ELSE 0.0 END AS length
FROM documents"""

ORACLES["encode_with_cache"] = """
WITH known AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, CAST(CASE WHEN k.text IS NULL THEN length(d.text) ELSE -length(d.text) END AS DOUBLE) AS chars,
       CAST(CASE WHEN k.text IS NULL THEN length(d.text) - length(replace(d.text, 'e', '')) ELSE 0 END AS DOUBLE) AS e_count
FROM documents d LEFT JOIN known k ON k.text = d.text"""

ORACLES["encode_with_user_model"] = """
SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars,
       CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS e_count FROM documents"""

# --- class terms, cluster names -----------------------------------------------------------------


def _class_terms(idf: str, tf: str, scale: str = "1.0") -> str:
    return f"""
WITH g AS ({_grams("documents", "doc_id", "text", 1, 1, "lang,")}),
n AS (SELECT lang, feature AS term, CAST(count(*) AS DOUBLE) AS n FROM g GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total FROM n GROUP BY lang),
a AS (SELECT floor(avg(total)) AS a FROM totals),
f AS (SELECT term, sum(n) AS f FROM n GROUP BY term)
SELECT lang, term, round({tf.format(tf="n / total")} * {idf} * {scale}, 6) AS tfidf
FROM n JOIN totals USING (lang) JOIN f USING (term), a"""


_PLAIN_IDF = "ln(a / f + 1.0)"
_BM25_IDF = "ln(1.0 + (a - f + 0.5) / (f + 0.5))"

ORACLES["class_terms"] = _class_terms(_PLAIN_IDF, "({tf})")
ORACLES["class_terms_bm25"] = _class_terms(_BM25_IDF, "sqrt({tf})")
ORACLES["class_terms_scaled"] = _class_terms(
    _PLAIN_IDF, "({tf})", "CASE WHEN length(term) > 6 THEN 2.0 ELSE 1.0 END"
)

_NAMED_PARTS = """
parts AS (
  SELECT p_partkey AS id, lower(p_name) AS query,
         CASE WHEN CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) > 20 THEN -1
              ELSE CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) END AS label FROM part),
names AS (SELECT query, row_number() OVER (ORDER BY query) - 1 AS number
          FROM (SELECT DISTINCT query FROM parts)),
named AS (SELECT p.id, p.query, p.label, CAST(e.embedding AS DOUBLE[]) AS v
          FROM parts p JOIN names USING (query)
          JOIN embeddings e ON e.vec_id = (p.id + number) % (SELECT count(*) FROM embeddings))"""

_CLUSTER_TERMS = f"""
inside AS (SELECT id, label, query FROM named WHERE label > -1),
g AS ({_grams("inside", "id", "query", 1, 4, "label,")}),
vocab AS (SELECT query AS feature, min(v) AS v FROM named
          WHERE len(string_split(query, ' ')) <= 4 GROUP BY query),
n AS (SELECT label, feature, CAST(count(*) AS DOUBLE) AS n FROM g JOIN vocab USING (feature) GROUP BY ALL),
totals AS (SELECT label, sum(n) AS total FROM n GROUP BY label),
a AS (SELECT floor(avg(total)) AS a FROM totals),
f AS (SELECT feature, sum(n) AS f FROM n GROUP BY feature),
w AS (SELECT label, feature, sqrt(n / total) * {_BM25_IDF} AS tfidf
      FROM n JOIN totals USING (label) JOIN f USING (feature), a),
kept AS (SELECT w.*, vocab.v FROM w JOIN vocab USING (feature) WHERE tfidf > 0),
kx AS (SELECT label, unnest(v) AS x, unnest(range(64)) AS pos FROM kept),
km AS (SELECT label, pos, avg(x) AS m FROM kx GROUP BY label, pos),
kc AS (SELECT label, list(m ORDER BY pos) AS c FROM km GROUP BY label),
rated AS (SELECT label, feature, tfidf, list_cosine_similarity(v, c) AS similarity, v FROM kept JOIN kc USING (label)),
placed AS (SELECT *, tfidf * similarity AS score,
             row_number() OVER (PARTITION BY label ORDER BY tfidf * similarity DESC, feature) AS position FROM rated)"""

_CLUSTERS = f"{_NAMED_PARTS}, {_CLUSTER_TERMS}"

ORACLES["cluster_terms"] = f"""
WITH {_CLUSTERS}
SELECT CAST(label AS BIGINT) AS label, position, feature, round(tfidf, 6) AS tfidf,
       round(similarity, 6) AS similarity, round(score, 6) AS score FROM placed WHERE position <= 5"""

ORACLES["cluster_names"] = f"""
WITH {_CLUSTERS},
tops AS (SELECT label, string_agg(feature, ', ' ORDER BY position) AS t FROM placed WHERE position <= 3 GROUP BY label)
SELECT CAST(label AS BIGINT) AS label,
       CASE WHEN label = -1 THEN '<outliers>' ELSE coalesce(t, '<no label found>') END AS text_label
FROM (SELECT DISTINCT label FROM parts) LEFT JOIN tops USING (label)"""

def _by_category(top: int, name: str) -> str:
    """CTEs ending in tops(label, t): what ``name`` says of the centre nearest to a cluster's terms."""
    return f"""
tx AS (SELECT label, unnest(v) AS x, unnest(range(64)) AS pos FROM placed WHERE position <= {top}),
tm AS (SELECT label, pos, avg(x) AS m FROM tx GROUP BY label, pos),
tc AS (SELECT label, list(m ORDER BY pos) AS t FROM tm GROUP BY label),
{_CENTERS},
tops AS (SELECT tc.label, '{name}' || min_by(c.label, list_distance(tc.t, c.c)) AS t
         FROM tc, centers c GROUP BY tc.label)"""


ORACLES["cluster_names_by_category"] = f"""
WITH {_CLUSTERS}, {_by_category(3, "Labels L")}
SELECT CAST(label AS BIGINT) AS label,
       CASE WHEN label = -1 THEN '<outliers>' ELSE coalesce(t, '<no label found>') END AS text_label
FROM (SELECT DISTINCT label FROM parts) LEFT JOIN tops USING (label)"""

# --- tagging ----------------------------------------------------------------------------------------

ORACLES["add_category_paths"] = f"""{_RATED}
SELECT id, 'Labels > L' || category_id AS category_path FROM rated WHERE position = 1"""

_RESCORED = f"""
WITH {_WORD_SCORES}, {_CENTERS},
dealt AS (SELECT query, row_number() OVER (ORDER BY score DESC, query) AS r FROM word_scores),
best_words AS (SELECT query, r FROM dealt QUALIFY row_number() OVER (PARTITION BY (r - 1) % 10 ORDER BY r) <= 4),
cat_names AS (SELECT CAST((r - 1) % 10 AS BIGINT) AS category_id, string_agg(query, ' ' ORDER BY query) AS t
              FROM best_words GROUP BY 1),
cats AS (SELECT category_id, 'Words > ' || t AS path, 'Words ' || t AS path_text, c
         FROM cat_names JOIN centers ON label = category_id),
docs AS (SELECT doc_id AS id, text AS query, CAST(embedding AS DOUBLE[]) AS v
         FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)),
texts AS (SELECT query, min(v) AS v FROM docs GROUP BY query),
short AS (SELECT query, category_id, path_text,
                 row_number() OVER (PARTITION BY query ORDER BY list_cosine_similarity(v, c) DESC, category_id) AS position
          FROM texts, cats QUALIFY position <= 5),
pairs AS (
  SELECT query, category_id, position,
         CAST(len(list_intersect(list_distinct(string_split(lower(path_text), ' ')),
                            regexp_split_to_array(lower(query), '\\s+'))) AS DOUBLE)
         / len(list_distinct(string_split(lower(path_text), ' '))) AS pair_score FROM short),
cut AS (SELECT quantile_cont(pair_score, 0.5) AS t FROM pairs),
best AS (SELECT query, max(pair_score) AS best_score, stddev_pop(pair_score) AS spread,
                arg_max(category_id, (pair_score, -position)) AS category_id FROM pairs GROUP BY query),
found AS (SELECT query, best_score, spread,
                 CASE WHEN best_score >= t AND spread >= 0.05 THEN category_id ELSE -1 END AS category_id
          FROM best, cut)"""

ORACLES["rescored_categories"] = f"""{_RESCORED}
SELECT md5(query) AS text_key, CAST(category_id AS BIGINT) AS category_id,
       round(best_score, 6) AS best_score, round(spread, 6) AS spread FROM found"""

_LENGTHS = "1.0 / (1.0 + abs(length(query) % 100 - length(path_text))) AS pair_score FROM short"
_BY_LENGTH = _RESCORED[: _RESCORED.index("         CAST(len(list_intersect")] + f"         {_LENGTHS}"
_BY_LENGTH += _RESCORED[_RESCORED.index("),\ncut AS") :].replace("spread >= 0.05", "spread >= 0.01")

ORACLES["rescored_with_user_model"] = f"""{_BY_LENGTH}
SELECT md5(query) AS text_key, CAST(category_id AS BIGINT) AS category_id,
       round(best_score, 6) AS best_score, round(spread, 6) AS spread FROM found"""

_TYPED_PARTS = """
types AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS t,
                 row_number() OVER (ORDER BY min(p_partkey)) - 1 AS label FROM part GROUP BY p_type),
named AS (SELECT p.p_partkey AS id, lower(p.p_name) AS query, y.label,
                 list_transform(CAST(e.embedding AS DOUBLE[]),
                                lambda x, i: x * 0.1 + CASE WHEN i = y.t + 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v
          FROM part p JOIN types y USING (p_type)
          JOIN embeddings e ON e.vec_id = p.p_partkey % (SELECT count(*) FROM embeddings))"""

ORACLES["cluster_texts"] = f"""
WITH {_TYPED_PARTS}, {_CLUSTER_TERMS}, {_by_category(5, "Labels L")}
SELECT id, CAST(label AS BIGINT) AS label, coalesce(t, '<no label found>') AS text_label
FROM named LEFT JOIN tops USING (label)"""

ORACLES["add_category_paths_clustered"] = f"""
WITH {_TYPED_PARTS}, {_CLUSTER_TERMS}, {_by_category(5, "Labels > L")}
SELECT id, coalesce(t, 'Miscellaneous') AS category_path FROM named LEFT JOIN tops USING (label)"""

_MARKS = "string_split('abcdefghijklmnopqrstuvwxyz0123456789', '')"


def _letters(text: str) -> str:
    counted = f"length({text}) - length(replace(lower({text}), c, ''))"
    return f"list_transform({_MARKS}, lambda c: CAST({counted} AS DOUBLE))"


ORACLES["tagged_log"] = f"""
WITH {_OUTLINE},
cats AS (SELECT row_number() OVER (ORDER BY path) - 1 AS category_id, path,
                {_letters("replace(path, ' > ', ' ')")} AS c FROM (SELECT DISTINCT path FROM paths)),
asked AS (SELECT p_name AS query, count(*) AS n, {_letters("p_name")} AS v FROM part GROUP BY p_name),
rated AS (SELECT query, n, path FROM asked, cats
          QUALIFY row_number() OVER (PARTITION BY query
                                     ORDER BY round(list_cosine_similarity(v, c), 9) DESC, category_id) = 1)
SELECT query, path AS category_path, n AS "rows" FROM rated"""

ORACLES["tagged_log_topics"] = f"""
WITH {_PART_LOG},
cut AS (SELECT id, {_strip("query")} AS query, page, CAST(trunc(volume) AS BIGINT) AS volume, query AS whole FROM part_log),
log AS (SELECT id, query, volume FROM cut WHERE length(query) >= 3
        QUALIFY row_number() OVER (PARTITION BY page ORDER BY volume DESC, query, whole) <= 50),
{_frequency("log", "id", "query", 1, 2, "2")}, {_MERGE},
{_volumes("merged", "log", "id", "query", "volume")}, {_SCORED}
SELECT query, round(search_volume, 6) AS search_volume, round(merged_frequency, 6) AS merged_frequency,
       round(score, 6) AS score FROM scored"""

ORACLES["add_category_paths_rescored"] = f"""{_RESCORED}
SELECT id, coalesce(path, 'Miscellaneous') AS category_path
FROM docs JOIN found USING (query) LEFT JOIN cats USING (category_id)"""

# --- user callables -----------------------------------------------------------------------------------

ORACLES["enrich"] = """
SELECT conv_id, turn,
       CASE WHEN NOT contains(text, 'éê') THEN string_split(text, chr(10))[1] END AS response,
       CASE WHEN contains(text, 'éê') THEN 'ValueError: no headline' END AS error FROM conversations"""

ORACLES["entities"] = f"""
WITH e AS (SELECT {_trim("unnest(string_split(text, ','))")} AS entity FROM conversations
           UNION SELECT p_type FROM part)
SELECT DISTINCT entity FROM e WHERE length(entity) > 0"""

ORACLES["tagged_entities"] = f"""
WITH known AS (SELECT DISTINCT upper(string_split(text, ' ')[1]) AS entity FROM documents),
names AS (SELECT lower(entity) AS k, min(entity) AS e FROM known GROUP BY 1),
answers AS (SELECT DISTINCT text, array_to_string(
              list_transform(string_split(text, chr(10)), lambda l: string_split(l, ' ')[1]), ', ') AS a
            FROM conversations),
tags AS (SELECT text, {_trim("unnest(string_split(a, ','))")} AS entity FROM answers)
SELECT DISTINCT md5(text) AS topic_key, coalesce(e, entity) AS entity
FROM tags LEFT JOIN names ON k = lower(entity) WHERE length(entity) > 0"""

ORACLES["components_of_customers"] = """
SELECT -1 - o_custkey AS component, count(DISTINCT o_orderkey) + 1 AS nodes FROM orders GROUP BY o_custkey"""

ORACLES["components"] = """
WITH RECURSIVE edges AS (
  SELECT DISTINCT l_orderkey AS a, -1 - l_partkey AS b FROM lineitem),
links AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reach(node, root) USING KEY (node) AS (
  SELECT DISTINCT a, a FROM links
  UNION
  SELECT l.b, min(r.root) FROM reach r JOIN links l ON l.a = r.node JOIN recurring.reach o ON o.node = l.b
  WHERE r.root < o.root GROUP BY l.b)
SELECT root AS component, count(*) AS nodes FROM reach GROUP BY root"""
