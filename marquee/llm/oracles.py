"""DuckDB SQL of the queries that SQL can express; the others are tested by brute force."""

from __future__ import annotations

from . import centroids, quality, queries

# Lines that hold a word, trimmed, numbered from 0 in their text, and windows of three of them.
LINE_DEDUP = """
WITH split AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS place FROM documents),
lines AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM split),
worded AS (
  SELECT doc_id, place, bare, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS number
  FROM lines WHERE bare <> ''),
windows AS (
  SELECT a.doc_id, a.number, a.bare AS x, b.bare AS y, c.bare AS z FROM worded a
  JOIN worded b ON b.doc_id = a.doc_id AND b.number = a.number + 1
  JOIN worded c ON c.doc_id = a.doc_id AND c.number = a.number + 2),
later AS (
  SELECT doc_id, number FROM (
    SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, number) AS turn FROM windows)
  WHERE turn > 1),
covered AS (
  SELECT DISTINCT w.doc_id, w.place FROM later l
  JOIN worded w ON w.doc_id = l.doc_id AND w.number BETWEEN l.number AND l.number + 2),
kept AS (
  SELECT s.doc_id, string_agg(s.line, chr(10) ORDER BY s.place) AS text FROM lines s
  LEFT JOIN covered c ON c.doc_id = s.doc_id AND c.place = s.place WHERE c.doc_id IS NULL GROUP BY 1),
counts AS (SELECT doc_id, count(*) AS n FROM worded GROUP BY 1),
removed AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(r.n, 0) AS n_removed,
       CASE WHEN r.n IS NULL THEN d.text ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
LEFT JOIN counts n ON n.doc_id = d.doc_id LEFT JOIN removed r ON r.doc_id = d.doc_id
"""

# Water filling by level, and each source's documents in the order of a hash.
MIXING = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15))::BIGINT
           AS draw FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn, source_size * 3 AS cap FROM sources),
roomy AS (SELECT *, turn + 1 AS weight, cap / (turn + 1) AS room FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY room, source NULLS LAST
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY room, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level FROM roomy),
targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), max(own_level) OVER () * weight) AS target,
         (turn - 1) * 0.5 AS raw, turn FROM levels),
tilts AS (
  SELECT source, source_size, target,
         raw - sum(floor(target) * (turn - 1)) OVER () / (greatest(sum(floor(target)) OVER (), 1) * 2) AS tilt
  FROM targets),
placed AS (
  SELECT s.*, t.source_size, t.target, t.tilt, CAST(round(t.target) AS BIGINT) AS demand,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN tilts t ON t.source IS NOT DISTINCT FROM s.source),
mixed AS (
  SELECT *, CAST(demand // greatest(source_size, 1) * size
                 + greatest(0, least(size, demand % greatest(source_size, 1) - before)) AS BIGINT) AS taken
  FROM placed)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(before / target * 2 / (1.0 - tilt + sqrt((1.0 - tilt) * (1.0 - tilt)
                                      + tilt * 4 * (before / target))), 9) END AS first_position,
       CASE WHEN taken > 0 THEN array_to_string(list_transform(range(0, CAST(ceil(taken / size) AS BIGINT)), lambda i:
         CAST(round(1e6 * ((before + i * source_size) / target * 2 / (1.0 - tilt + sqrt((1.0 - tilt) * (1.0 - tilt)
                    + tilt * 4 * ((before + i * source_size) / target))))) AS BIGINT)), ',')
       ELSE '' END AS positions_millionths
FROM mixed
"""

# Base counts; then for each stratum, measure and cutoff the exact binomial tail of the good
# documents it rejects, tested from the mildest cutoff on.
_GRID = ", ".join(
    f"('{name}', {step}, CAST({cutoff} AS DOUBLE))"
    for name, grid in quality.GRIDS.items()
    for step, cutoff in enumerate(grid)
)
_SHARE = quality.RISK / len(quality.GRIDS)
QUALITY = f"""
WITH split AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
often AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM windows),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM often, range(3) r(k) WHERE n > 1 GROUP BY 1),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l
  FROM split),
counted AS (
  SELECT s.doc_id, s.lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(s.text) - length(regexp_replace(s.text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM split s JOIN lines USING (doc_id) LEFT JOIN covered c USING (doc_id)),
based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         [{{'measure': 'symbols_per_word', 'v': n_symbols / greatest(n_words, 1)}},
          {{'measure': 'duplicate_lines', 'v': n_dup_lines / greatest(n_lines, 1)}},
          {{'measure': 'repeated_words', 'v': n_repeat_words / greatest(n_words, 1)}},
          {{'measure': 'long_words', 'v': word_chars / greatest(n_words, 1)}}] AS measures
  FROM counted),
measured AS (SELECT doc_id, lang, base_failed, unnest(measures, recursive := true) FROM based),
known AS (
  SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL
  GROUP BY 1 HAVING min(quality) = max(quality)),
grid(measure, step, cutoff) AS (VALUES {_GRID}),
tests AS (
  SELECT lang, g.measure, g.step, g.cutoff, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS n_junk,
         count(*) FILTER (good AND v > cutoff) AS k, count(*) FILTER (NOT good AND v > cutoff) AS caught
  FROM measured JOIN known USING (doc_id) JOIN grid g ON g.measure = measured.measure
  WHERE NOT base_failed GROUP BY ALL),
tails AS (
  SELECT *, (SELECT count(*) FROM (SELECT DISTINCT lang FROM tests)) * {len(quality.GRIDS)} AS n_tests,
         CASE WHEN k >= n * {_SHARE} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
           exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}) + (n - i) * ln(1 - {_SHARE}))))
         END AS p FROM tests),
safe AS (
  SELECT *, caught / greatest(n_junk, 1) - {quality.COST} * k / greatest(n, 1) AS gain
  FROM (SELECT *, max(p > {quality.DELTA} / n_tests) OVER (PARTITION BY lang, measure ORDER BY step) AS failed FROM tails)
  WHERE NOT failed),
chosen AS (
  SELECT lang, measure, cutoff FROM safe WHERE gain > 0
  QUALIFY row_number() OVER (PARTITION BY lang, measure ORDER BY gain DESC, step) = 1),
broken AS (
  SELECT DISTINCT doc_id FROM measured m JOIN chosen c
  ON c.lang IS NOT DISTINCT FROM m.lang AND c.measure = m.measure AND m.v > c.cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept FROM based
"""


def _centroids(k: int, rounds: int, dim: int, seed: int) -> str:
    """Every distance of every round; components are rows."""
    limit = centroids.LARGEST / centroids.SCALE
    nearest = """SELECT id, number, distance FROM (
      SELECT v.id, c.number, sum((v.x - c.x) * (v.x - c.x)) AS distance
      FROM parts v JOIN middle{r} c ON c.place = v.place GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, number) = 1"""
    moves = "".join(
        f"""
near{r} AS MATERIALIZED ({nearest.format(r=r)}),
middle{r + 1} AS MATERIALIZED (
  SELECT c.number, c.place, CASE WHEN s.n IS NULL THEN c.x
         ELSE ((s.total - ((s.total % s.n) + s.n) % s.n) // s.n)::BIGINT END AS x
  FROM middle{r} c LEFT JOIN (
    SELECT a.number, v.place, sum(v.x)::BIGINT AS total, count(*) AS n
    FROM near{r} a JOIN parts v USING (id) GROUP BY ALL) s USING (number, place)),"""
        for r in range(rounds)
    )
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {dim}
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < {limit})) = {dim}),
parts AS MATERIALIZED (SELECT id, unnest(v) AS x, unnest(range({dim})) AS place FROM kept),
first AS (
  SELECT id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS number
  FROM kept QUALIFY number < {k}),
middle0 AS MATERIALIZED (SELECT f.number, p.place, p.x FROM first f JOIN parts p USING (id)),{moves}
near AS MATERIALIZED ({nearest.format(r=rounds)}),
prints AS (
  SELECT number, sha256(string_agg(x::VARCHAR, ',' ORDER BY place)) AS centroid_sha256 FROM middle{rounds} GROUP BY 1)
SELECT vec_id, number::INTEGER AS cluster, distance::BIGINT AS distance,
       (sum(distance) OVER (PARTITION BY number))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM near JOIN kept USING (id) JOIN prints USING (number)
"""


CENTROIDS = _centroids(
    queries.CENTROIDS, queries.CENTROID_ROUNDS, queries.CENTROID_DIM, queries.CENTROID_SEED
)

ORACLES: dict[str, str] = {
    "op2_quality": QUALITY,
    "op6_line_dedup": LINE_DEDUP,
    "op8_mixing": MIXING,
    "op13_centroids": CENTROIDS,
}
