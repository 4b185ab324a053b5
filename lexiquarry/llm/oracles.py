"""DuckDB SQL for the corpus queries that SQL can express. Brute force by intent: all windows, all pairs that share a shingle."""

from __future__ import annotations

_P = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIX = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
        2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM s)
          - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
      WINDOW r AS (ORDER BY cap / w, source NULLS LAST)),
v AS (SELECT arg_min(level, (cap / w, source)) AS level FROM l WHERE level * w <= cap),
t AS (SELECT l.source, l.source_size, CASE WHEN v.level IS NULL THEN l.cap ELSE least(l.cap, v.level * l.w) END AS target FROM l, v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
q AS (SELECT *, least(floor(rate + 1e-12), 2)::BIGINT AS whole FROM p),
g AS (SELECT source, sum(size * floor(sqrt(size::DOUBLE)))::DOUBLE AS weighed FROM d GROUP BY source),
k AS (SELECT d.doc_id, d.source, d.size, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS missing,
        least(CASE WHEN weighed > 0 THEN greatest(rate - q.whole, 0) * q.source_size / weighed ELSE 0 END * floor(sqrt(d.size::DOUBLE)), 1.0::DOUBLE) AS p,
        (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':20'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CASE WHEN p >= 1 THEN 0.0::DOUBLE WHEN p <= 0 THEN 'infinity'::DOUBLE ELSE (u / (1 - u)) / (p / (1 - p)) END AS odds FROM k),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM e),
x AS (SELECT *, CASE WHEN missing > 0 THEN greatest(0, least(size, floor(missing + 1e-6)::BIGINT - before)) ELSE 0 END AS extra FROM o)
SELECT doc_id, size, source_size, target,
  (CASE WHEN extra = size AND size > 0 THEN least(whole + 1, 2) ELSE whole END * size
   + CASE WHEN extra < size AND whole < 2 THEN extra ELSE 0 END)::BIGINT AS taken,
  (CASE WHEN extra = size AND size > 0 THEN least(whole + 1, 2) ELSE whole END)::BIGINT AS copies,
  (CASE WHEN extra < size AND whole < 2 THEN extra ELSE 0 END)::BIGINT AS cut_words
FROM x"""

_RULES = (
    ("symbols", "n_symbols", "word_chars", 0.5),
    ("dup_lines", "n_dup_lines", "n_lines", 1.0),
    ("repeats", "n_repeat_words", "n_words", 0.4),
    ("capitals", "n_capitals", "word_chars", 1.0),
    ("marks", "n_marks", "word_chars", 0.5),
    ("long_words", "word_chars", "n_words", 32.0),
)


def _bin(top: str, below: str, full: float) -> str:
    return f"CASE WHEN {below} > 0 THEN least(floor({top} * 256 / ({below} * {full}::DOUBLE)), 255) ELSE 0 END::INT"


RULES = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN lang IS NULL THEN 'n' ELSE 'v' || lang END AS stratum, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), {_P}) AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT rid, s, array_to_string(list_slice(w, s, s + 7), ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS s FROM w WHERE len(w) >= 8)),
dup AS (SELECT rid, g FROM win GROUP BY rid, g HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(s, s + 8)) AS p FROM win JOIN dup USING (rid, g)) GROUP BY rid),
st AS (SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
        length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals, length(regexp_replace(text, '[^!?]', '', 'g'))::BIGINT AS n_marks
      FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM st),
lab AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
sc AS ({" UNION ALL ".join(f"SELECT stratum, q = 1 AS good, '{r}' AS rule, {_bin(t, u, f)} AS bin FROM b JOIN lab USING (doc_id) WHERE NOT base_failed" for r, t, u, f in _RULES)}),
c AS (SELECT stratum, rule, bin, count(*) FILTER (good) AS good, count(*) FILTER (NOT good) AS bad FROM sc GROUP BY ALL),
g AS (SELECT *, sum(good) OVER (PARTITION BY stratum, rule) AS n, coalesce(sum(good) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS good_out,
        coalesce(sum(bad) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bad_out,
        coalesce(lead(bin) OVER (PARTITION BY stratum, rule ORDER BY bin) - 1, 255) AS lax, (SELECT count(DISTINCT stratum) FROM c) AS m
      FROM c WINDOW d AS (PARTITION BY stratum, rule ORDER BY bin DESC)),
t AS (SELECT *, n > 0 AND good_out < n * (0.05::DOUBLE / 6) AND list_sum(list_transform(range(0, good_out::BIGINT + 1), lambda i:
        exp(lgamma(n + 1) - (CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END) - lgamma(n - i + 1) + i * ln(0.05::DOUBLE / 6) + (n - i) * ln(1 - 0.05::DOUBLE / 6)))) <= 0.05::DOUBLE / 6 / m AS sure FROM g),
u AS (SELECT *, bool_and(sure) OVER (PARTITION BY stratum, rule ORDER BY bin DESC) AS all_sure FROM t),
k AS (SELECT stratum, rule, arg_max(lax, (bad_out - good_out, bin)) AS cutoff FROM u WHERE all_sure GROUP BY ALL)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"{_bin(t, u, f)} <= coalesce((SELECT max(cutoff) FROM k WHERE k.stratum = b.stratum AND k.rule = '{r}'), 255)" for r, t, u, f in _RULES)} AS kept
FROM b"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_P}) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 4), ' ') AS g
       FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [1] ELSE range(1, len(w) - 3) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
pairs AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT pairs.b, r.c FROM r JOIN pairs ON pairs.a = r.doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n"""

REPEATS = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_P}) AS w FROM documents),
win AS (SELECT rid, s, array_to_string(list_slice(w, s, s + 34), ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS s FROM w WHERE len(w) >= 35)),
dup AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(s, s + 35)) AS p FROM win JOIN dup USING (g)),
word AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (rid)"""

_KEY = "((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))"
_ASSIGN = _KEY + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: int, pattern: str, good: str = "TRUE") -> str:
    return rf"""SELECT rid, {kind} AS kind, start, start + length(m) AS "end", m FROM (
      SELECT rid, m, (sum(length(g)) OVER o + sum(length(m)) OVER o - length(m))::BIGINT AS start FROM (
        SELECT rid, unnest(ms) AS m, unnest(list_slice(gs, 1, len(ms))) AS g, unnest(range(len(ms))) AS i
        FROM (SELECT rid, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs FROM d) WHERE len(ms) > 0)
      WINDOW o AS (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE {good}"""


SECRETS = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_spans(0, _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6")} UNION ALL {_spans(1, "AKIA[A-Z0-9]+", "length(m) >= 20")} UNION ALL {_spans(2, "[0-9a-f]+", "length(m) >= 24")}),
cand AS (SELECT *, row_number() OVER () AS cid, CASE WHEN regexp_matches(m, '^[0-9a-f]+$|^[0-9A-F]+$') THEN 3.0 WHEN regexp_matches(m, '^[A-Za-z0-9]+$') THEN 3.7 ELSE 3.9 END::DOUBLE AS bits
         FROM ({_spans(3, "[A-Za-z0-9+/_-]{20,}={0,2}")})
         WHERE NOT regexp_matches(m, '^[0-9_+/-]+$|^[A-Za-z_+/-]+$|^[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}$|(?i:example|sample|dummy|placeholder|changeme|redacted)|(?i:abcdefgh|123456789)')
           AND len(list_filter(range(1, length(m) + 1), lambda i: substr(m, i, 8) = repeat(substr(m, i, 1), 8))) = 0),
win AS (SELECT cid, j, substr(m, j + 1, 20) AS s FROM (SELECT cid, m, unnest(range(length(m) - 19)) AS j FROM cand)),
ent AS (SELECT cid, j, log2(20::DOUBLE) - sum(c * log2(c::DOUBLE)) / 20 AS h FROM (SELECT cid, j, ch, count(*) AS c FROM (SELECT cid, j, unnest(string_split(s, '')) AS ch FROM win) GROUP BY ALL) GROUP BY cid, j),
hit AS (SELECT rid, 3 AS kind, start + min(j) AS start, start + max(j) + 20 AS "end" FROM ent JOIN cand USING (cid) WHERE h >= bits - 1e-9 GROUP BY cid, rid, start),
more AS (SELECT * FROM hit WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.rid = hit.rid AND base.start < hit."end" AND hit.start < base."end")),
named AS (SELECT rid, kind, start, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || start || ':' || "end" AS t FROM (SELECT rid, kind, start, "end" FROM base UNION ALL SELECT rid, kind, start, "end" FROM more)),
a AS (SELECT rid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
        string_agg(t, ',' ORDER BY start, kind) FILTER (kind < 3) AS b, string_agg(t, ',' ORDER BY start, kind) AS s FROM named GROUP BY rid)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans
FROM d LEFT JOIN a USING (rid)"""

ORACLES: dict[str, str] = {
    "op2_mix_sources": MIX,
    "op5_quality_rules": RULES,
    "op8_minhash_near_dedup": NEAR,
    "op9_secret_scan": SECRETS,
    "op10_substring_dedup": REPEATS,
}
