"""DuckDB SQL for the queries of the dealt operators that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op2_mixing"] = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || 'mix') AS place,
       CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, CAST(list_extract([5, 2, 1], CAST((rank - 1) % 3 + 1 AS INTEGER)) AS BIGINT) AS w, 3 * source_size AS cap FROM r),
q AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio, (SELECT CAST(sum(source_size) AS DOUBLE) FROM w) AS budget,
       (SELECT sum(w) FROM w) AS all_w FROM w),
c AS (SELECT *, sum(cap) OVER o - cap AS caps, sum(w) OVER o - w AS ws FROM q
      WINDOW o AS (ORDER BY ratio, rank ROWS UNBOUNDED PRECEDING)),
l AS (SELECT first(lev ORDER BY ratio, lev) AS lev FROM (SELECT ratio, CAST(budget - CAST(caps AS DOUBLE) AS DOUBLE) / CAST(all_w - ws AS DOUBLE) AS lev FROM c) WHERE lev <= ratio),
t AS (SELECT source, source_size, rank, least(CAST(cap AS DOUBLE), w * coalesce((SELECT lev FROM l), CAST('inf' AS DOUBLE))) AS target FROM w),
p AS (SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM d),
k AS (SELECT p.*, t.source_size, t.rank, t.target FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
i AS (SELECT CAST(e * source_size + cum AS DOUBLE) / target AS v, rank, size FROM k, unnest([0, 1, 2]) AS u(e) WHERE size > 0 AND target > 0),
n AS (SELECT v, rank, sum(size) OVER (ORDER BY v, rank ROWS UNBOUNDED PRECEDING) AS run FROM i),
z AS (SELECT v, rank FROM n WHERE run <= (SELECT sum(size) FROM d) ORDER BY v DESC, rank DESC LIMIT 1)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size > 0 AND target > 0 THEN size * (SELECT count(*) FROM unnest([0, 1, 2]) AS u(e), z
    WHERE CAST(e * source_size + cum AS DOUBLE) / target < z.v
       OR (CAST(e * source_size + cum AS DOUBLE) / target = z.v AND k.rank <= z.rank)) ELSE 0 END AS BIGINT) AS taken
FROM k
"""



def _gram(n: int) -> str:
    words = " || chr(1) || ".join(["word", *(f"lead(word, {k}) OVER o" for k in range(1, n))])
    return f"""g{n} AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS c
  FROM (SELECT doc_id, pos, {words} AS gram FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE gram IS NOT NULL),
h{n} AS (SELECT DISTINCT doc_id, pos + k AS pos FROM g{n}, unnest(range({n})) AS u(k) WHERE c > 1),
s{n} AS (SELECT h.doc_id, count(*) AS words, CAST(sum(length(t.word)) AS BIGINT) AS chars
  FROM h{n} h JOIN t ON t.doc_id = h.doc_id AND t.pos = h.pos GROUP BY h.doc_id)"""


ORACLES["op6_quality_rules"] = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS MATERIALIZED (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
{_gram(5)}, {_gram(7)}, {_gram(10)},
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY no) AS nth, count(*) OVER (PARTITION BY doc_id, line) AS c,
    length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ls AS (SELECT doc_id, CAST(sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END) AS BIGINT) AS dup, CAST(sum(CASE WHEN c > 1 THEN chars ELSE 0 END) AS BIGINT) AS chars FROM l GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(ls.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(s5.words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(ls.chars, 0) AS BIGINT) AS line_chars, CAST(coalesce(s5.chars, 0) AS BIGINT) AS gram_5,
    CAST(coalesce(s7.chars, 0) AS BIGINT) AS gram_7, CAST(coalesce(s10.chars, 0) AS BIGINT) AS gram_10
  FROM w LEFT JOIN ls ON ls.doc_id = w.doc_id LEFT JOIN s5 ON s5.doc_id = w.doc_id LEFT JOIN s7 ON s7.doc_id = w.doc_id LEFT JOIN s10 ON s10.doc_id = w.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * gram_5 <= 20 * word_chars AND 100 * gram_7 <= 17 * word_chars
    AND 100 * gram_10 <= 15 * word_chars AND 100 * line_chars <= 30 * word_chars AS kept
FROM m
"""

_DIGITS = "".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS INTEGER) >> {15 - 5 * k}) & 31 AS INTEGER) + 1, 1) || "
    for g in range(8) for k in range(4)
)

ORACLES["op1_warc"] = f"""
WITH p AS (SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS LAST) AS nth,
       first_value(page_id) OVER (PARTITION BY h ORDER BY page_id NULLS LAST, url NULLS LAST) AS lead FROM p)
SELECT page_id, payload_bytes, {_DIGITS}'' AS payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN lead END AS refers_to FROM r
"""

ORACLES["op4_exact_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

# crc32 of the decimal digits of `id`, from a table of 256 remainders made by the polynomial.
_CRC_TABLE = """tab AS MATERIALIZED (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) ORDER BY b) AS t FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b))"""


def _crc(id: str, t: str = "(SELECT t FROM tab)") -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(string_split(CAST({id} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, x: xor(c >> 8, list_extract({t}, CAST((xor(c, x) & 255) + 1 AS BIGINT)))))"""


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE concat(strlen(CAST({x} AS VARCHAR)), ':', {x}) END"


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))

ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE {_CRC_TABLE},
c AS MATERIALIZED (SELECT doc_id, {_crc('doc_id', 't')} AS h FROM (SELECT DISTINCT doc_id FROM documents), tab),
d AS MATERIALIZED (SELECT *, coalesce('+' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos
  FROM (SELECT doc_id, lang, sha256({_LEAF}) AS leaf, sha256({_LEAF.replace("n_chars", "(n_chars + 1)")}) AS wrong FROM documents)),
tree AS (SELECT g, 0 AS lev, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM d
  UNION ALL SELECT g, lev + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, lev, pos // 2),
subs AS MATERIALIZED (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM tree WHERE n = 1),
top AS (SELECT 0 AS lev, pos, subroot AS h, count(*) OVER () AS n FROM subs
  UNION ALL SELECT lev + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY lev, pos // 2),
nodes AS MATERIALIZED (SELECT * FROM tree), tops AS MATERIALIZED (SELECT * FROM top),
low AS (SELECT a.g, a.lev, a.pos, CASE WHEN a.pos % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(b.h, '') AS step
  FROM nodes a LEFT JOIN nodes b ON b.g = a.g AND b.lev = a.lev AND b.pos = xor(a.pos, 1) WHERE a.n > 1),
high AS (SELECT a.lev, a.pos, CASE WHEN a.pos % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(b.h, '') AS step
  FROM tops a LEFT JOIN tops b ON b.lev = a.lev AND b.pos = xor(a.pos, 1) WHERE a.n > 1),
below AS (SELECT d.doc_id, d.leaf, d.pos, d.g, list(low.step ORDER BY low.lev) FILTER (low.step IS NOT NULL) AS steps
  FROM d LEFT JOIN low ON low.g = d.g AND low.pos = d.pos >> low.lev GROUP BY ALL),
above AS (SELECT s.g, s.subroot, list(high.step ORDER BY high.lev) FILTER (high.step IS NOT NULL) AS steps
  FROM subs s LEFT JOIN high ON high.pos = s.pos >> high.lev GROUP BY ALL),
p AS (SELECT d.doc_id, d.leaf, a.subroot, (SELECT h FROM tops WHERE n = 1) AS root, list_concat(coalesce(b.steps, []), coalesce(a.steps, [])) AS steps,
    CASE WHEN c.h % 7 = 0 AND d.wrong IS NOT NULL THEN d.wrong ELSE d.leaf END AS start
  FROM d JOIN below b ON b.g = d.g AND b.pos = d.pos JOIN above a ON a.g = d.g JOIN c ON c.doc_id IS NOT DISTINCT FROM d.doc_id),
f AS (SELECT *, list_reduce(list_prepend(start, steps), lambda h, s: CASE WHEN s[1] = 'L' THEN sha256(s[2:] || h) ELSE sha256(h || s[2:]) END) AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_transform(list_prepend('R', steps), lambda s: s[2:]), 'string_agg', '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM f
"""

ORACLES["op12_word_runs"] = rf"""
WITH {_CRC_TABLE},
d AS MATERIALIZED (SELECT *, h % 10 = 0 AND n > 0 AS planted, (h // 10) % greatest(n, 1) AS a, (h // 10) % 8 AS k FROM
  (SELECT row_number() OVER () AS r, doc_id, {_crc('doc_id', 't')} AS h, ws, CAST(len(ws) AS BIGINT) AS n
   FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents), tab)),
t AS MATERIALIZED (SELECT r, n, i, list_extract(ws, 1 + CASE WHEN planted AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + k)) ELSE i END) AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM d)),
same AS (SELECT x.r, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
part AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same),
stretch AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM part GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
run AS MATERIALIZED (SELECT r, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(min(q) AS BIGINT) AS period FROM stretch GROUP BY r, start, length),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
per AS (SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
left_over AS (SELECT t.r, string_agg(t.word, ' ' ORDER BY t.i) AS text FROM t ANTI JOIN gone ON t.r = gone.r AND t.i = gone.i GROUP BY t.r)
SELECT d.doc_id, CAST(coalesce(per.n_runs, 0) AS BIGINT) AS n_runs, best.start, best.length, best.period,
  CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(per.listed, '')) AS runs_sha256,
  sha256(coalesce(left_over.text, '')) AS collapsed_sha256
FROM d LEFT JOIN per ON per.r = d.r LEFT JOIN best ON best.r = d.r LEFT JOIN left_over ON left_over.r = d.r
"""
