"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from hailgrid.llm import centroids, collocations, impact, pivots
from hailgrid.llm import credentials as c
from hailgrid.llm import licenses as li


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _credentials() -> str:
    found = []
    slashed = c.SLASHED[0]
    for rank, (kind, pattern, group, least) in enumerate((*c.KINDS, c.SLASHED)):
        # The vertical tab is a space in Java's patterns.
        fast = _quoted(c.RUNS.get(pattern, pattern).replace(r"[^\s", r"[^\s\x0B"))
        ok = f"length(regexp_extract(m, {_quoted(pattern)}, {group})) >= {least}"
        if kind == "linked_secret":
            ok += " AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')"
        if kind == slashed:
            ok = f"""length(m) >= {least} AND contains(m, '/') AND NOT starts_with(m, '://')
              AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')
              AND length(replace(m, '/', '')) <= {c.RUN_LENGTH} * len(regexp_extract_all(m, '[a-z]+|[A-Z]+|[0-9]+|[+_=-]+'))"""
        found.append(f"""
    SELECT r, '{kind}' AS kind, {rank} AS rank, stop - length(m) AS start, stop FROM (
      SELECT r, m, {ok} AS ok, sum(gap + length(m)) OVER (PARTITION BY r ORDER BY i) AS stop FROM (
        SELECT r, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest([length(x) for x in gaps[1:len(ms)]]) AS gap FROM (
          SELECT r, regexp_extract_all(t, {fast}) AS ms, string_split_regex(t, {fast}) AS gaps FROM docs WHERE regexp_matches(t, {fast}))))
    WHERE ok""")
    near = f"x.r = p.r AND x.start - p.stop <= {c.SCOPE} AND p.start - x.stop <= {c.SCOPE}"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
parts AS ({" UNION ALL ".join(found)}),
base AS (SELECT * FROM parts WHERE rank < {len(c.BASE)}),
secrets AS (
  SELECT * FROM base WHERE kind <> 'access' UNION ALL
  SELECT * FROM parts p WHERE kind = 'linked_secret'
    AND NOT EXISTS (SELECT 1 FROM base x WHERE x.r = p.r AND x.start < p.stop AND p.start < x.stop) UNION ALL
  SELECT * FROM parts p WHERE kind = '{slashed}'
    AND NOT EXISTS (SELECT 1 FROM base x WHERE x.kind = 'assign' AND x.r = p.r AND x.start < p.stop AND p.start < x.stop)),
ids AS (SELECT * FROM parts WHERE kind IN ('access', 'linked_id')),
spans AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM parts p WHERE kind = 'linked_id' AND EXISTS (SELECT 1 FROM secrets x WHERE {near}) UNION ALL
  SELECT * FROM secrets p WHERE kind IN ('linked_secret', '{slashed}') AND EXISTS (SELECT 1 FROM ids x WHERE {near}) UNION ALL
  SELECT * FROM parts p WHERE kind = 'linked_endpoint' AND EXISTS (SELECT 1 FROM secrets x WHERE {near}) AND EXISTS (SELECT 1 FROM ids x WHERE {near})),
by_row AS (
  SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in c.BASE)},
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) FILTER (rank < {len(c.BASE)}) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans
  FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in c.BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN by_row USING (r)
"""


def _warc() -> str:
    symbol = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> {}) & 31)::INTEGER + 1, 1)"
    four = " || ".join(symbol.format(shift) for shift in (15, 10, 5, 0))
    return f"""
WITH own AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
digests AS (
  SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
    array_to_string([{four} FOR n IN [('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT FOR i IN range(8)]], '') AS payload_digest
  FROM own),
newest AS (SELECT payload_digest, max(page_id) AS newest FROM digests GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN newest IS NULL OR page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN newest IS NULL OR page_id = newest THEN NULL ELSE newest END AS refers_to
FROM digests JOIN newest USING (payload_digest)
"""


def _licenses() -> str:
    word = _quoted(li.WORD)
    places = " UNION ALL ".join(
        f"""SELECT r, i - {len(p.split()) - 1} AS start, '{label}' AS label FROM stood
            WHERE {" AND ".join(f"w{k} = {_quoted(w)}" for k, w in enumerate(reversed(p.split())))}"""
        for p, label in li.PHRASES
    )
    templates = ", ".join(
        f"('{grain}', '{label}', [{', '.join(_quoted(w) for w in sorted(li.template_words(text)))}])" for grain, label, text in li.TEMPLATES
    )
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
words AS (SELECT r, regexp_extract_all(low, {word}) AS ws FROM docs),
stood AS (
  SELECT r, i, w0, lag(w0, 1) OVER along AS w1, lag(w0, 2) OVER along AS w2
  FROM (SELECT r, unnest(range(len(ws))) AS i, unnest(ws) AS w0 FROM words)
  WINDOW along AS (PARTITION BY r ORDER BY i)),
places AS ({places}),
base AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS ls FROM places GROUP BY r),
templates AS (SELECT * FROM (VALUES {templates}) t(grain, label, ts)),
paragraphs AS (SELECT r, unnest(string_split_regex(low, {_quoted(li.PARAGRAPH)})) AS block FROM docs),
lines AS (SELECT r, string_split_regex(block, {_quoted(li.LINE)}) AS ls FROM paragraphs),
blocks AS (
  SELECT r, 'paragraph' AS grain, block FROM paragraphs UNION ALL
  SELECT r, 'line', array_to_string(ls[i:i + {li.LINES - 1}], chr(10)) FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS i FROM lines)),
held AS (SELECT r, grain, list_distinct(regexp_extract_all(block, {word})) AS bs FROM blocks),
matched AS (
  SELECT r, label, len(list_intersect(bs, ts)) / len(ts) AS part FROM held JOIN templates USING (grain)
  WHERE len(list_intersect(bs, ts)) >= ceil({li.THRESHOLD} * len(ts) - 1e-9)),
best AS (SELECT r, max(part) AS part, list(DISTINCT label) AS ls FROM matched GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base.ls, []::VARCHAR[])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []::VARCHAR[]), coalesce(best.ls, []::VARCHAR[])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0)::DOUBLE END AS score
FROM docs JOIN words USING (r) LEFT JOIN base USING (r) LEFT JOIN best USING (r)
"""


def _components(nodes: str, links: str) -> str:
    """Steps that give each node of ``nodes`` (r) the smallest one that ``links`` (a, b, both ways) reach."""
    return f"""
reach AS (
  SELECT r, r AS other FROM {nodes}
  UNION
  SELECT reach.r, l.b FROM reach JOIN {links} l ON l.a = reach.other)"""


def _jaccard(words: int, percent: int) -> str:
    return f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT r, ws, unnest(range(1, greatest(1, len(ws) - {words - 1}) + 1)) AS i FROM docs WHERE len(ws) > 0),
shingles AS (SELECT DISTINCT r, array_to_string(ws[i:i + {words - 1}], ' ') AS s FROM starts),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b
  WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
{_components("docs", "links")}
SELECT any_value(d.doc_id) AS doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM docs d JOIN reach USING (r) JOIN docs o ON o.r = reach.other LEFT JOIN sizes ON sizes.r = d.r GROUP BY d.r
"""


def _cosine(threshold: float) -> str:
    return f"""
WITH RECURSIVE every AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
usable AS (
  SELECT r, vec_id, v FROM every
  WHERE vec_id IS NOT NULL AND v IS NOT NULL AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN v IF x <> 0]) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {threshold}),
{_components("every", "links")},
found AS (SELECT reach.r, min(o.vec_id) AS component_id FROM reach JOIN every o ON o.r = reach.other GROUP BY reach.r),
counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept
FROM every JOIN found USING (r) LEFT JOIN counts USING (r)
"""


def _collocations() -> str:
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
starts AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM split),
places AS (SELECT lang, ws, i, unnest(range(1, {collocations.WORDS + 1})) AS k FROM starts),
spelled AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM places WHERE i + k - 1 <= len(ws)),
grams AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM spelled GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT * FROM grams WHERE f >= {collocations.LEAST}),
candidates AS MATERIALIZED (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM often WHERE k > 1),
cut AS (SELECT lang, phrase, a, size, ws, unnest(range(1, size)) AS k FROM candidates),
parts AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS first_part, array_to_string(ws[k + 1:size], ' ') AS rest FROM cut),
cuts AS (
  SELECT c.lang, c.phrase, c.a, p.f AS l, s.f AS r, c.k, ({collocations.SCALE}::HUGEINT * c.a // (p.f + s.f))::BIGINT AS score
  FROM parts c JOIN often p ON p.lang = c.lang AND p.phrase = c.first_part JOIN often s ON s.lang = c.lang AND s.phrase = c.rest),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
begun AS (SELECT lang, a, size, ws, unnest(range(1, size)) AS i FROM candidates WHERE size > 2),
ended AS (SELECT lang, a, size, ws, i, unnest(range(i + 1, size + 1)) AS j FROM begun),
inside AS (SELECT lang, array_to_string(ws[i:j], ' ') AS phrase, max(a) AS longer FROM ended WHERE j - i + 1 < size GROUP BY ALL),
covered AS (SELECT lang, phrase FROM candidates JOIN inside USING (lang, phrase) WHERE 100::HUGEINT * longer >= {collocations.COVERED} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest ANTI JOIN covered USING (lang, phrase) JOIN totals USING (lang)
QUALIFY rank <= {collocations.TOP}
"""


WHOLE = "[floor(256 * x)::BIGINT FOR x IN embedding::DOUBLE[]]"
FINITE = "len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"


def _clusters(k: int, rounds: int, dims: int, seed: int) -> str:
    def nearest(t: int) -> str:
        gap = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.v, c.c)])"
        return f"""
a{t} AS (
  SELECT r, arg_min(j, (square, j)) AS j, min(square) AS square
  FROM (SELECT r, j, {gap}::BIGINT AS square FROM kept v CROSS JOIN c{t} c) GROUP BY r)"""

    def moved(t: int) -> str:
        return f"""
c{t + 1} AS (
  SELECT j, coalesce(m, c) AS c FROM c{t} LEFT JOIN (
    SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY d) AS m
    FROM (SELECT j, d, sum(v[d])::BIGINT AS s, count(*) AS n FROM a{t} JOIN kept USING (r), range(1, {dims + 1}) t(d) GROUP BY j, d) GROUP BY j) USING (j))"""

    steps = ",".join(step for t in range(rounds) for step in (nearest(t), moved(t)))
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, {WHOLE} AS v FROM embeddings WHERE len(embedding) = {dims} AND {FINITE}),
c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c
  FROM (SELECT v, sha256('{seed}:' || vec_id) AS h FROM kept ORDER BY h, v LIMIT {k})),
{steps},{nearest(rounds)}
SELECT vec_id, j::INTEGER AS cluster, square AS distance, sum(square) OVER (PARTITION BY j)::BIGINT AS cluster_inertia,
  sum(square) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (j)
"""


def _products(every: int, k: int) -> str:
    return f"""
WITH kept AS (SELECT vec_id, {WHOLE} AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND {FINITE}),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_sum([z[1] * z[2] FOR z IN list_zip(q.v, x.v)])::BIGINT AS score
  FROM kept q JOIN kept x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % {every} = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= {k}
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_credential_linking": _credentials(),
        "op6_warc_chain": _warc(),
        "op7_license_containment": _licenses(),
        "op9_partenum_jaccard": _jaccard(words=4, percent=85),
        "op10_pivot_permutation": _cosine(pivots.THRESHOLD),
        "op11_trie_collocations": _collocations(),
        "op12_ns_centroids": _clusters(centroids.CENTROIDS, centroids.ROUNDS, centroids.DIMS, seed=2),
        "op13_impact_topk": _products(every=50, k=impact.K),
    }
