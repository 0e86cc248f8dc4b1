"""DuckDB counterparts of the corpus queries that SQL can express."""

from __future__ import annotations

from gristmill.llm.decontaminate import BACK, MASKS, SHARE, SHORT, SPAN, WINDOW
from gristmill.llm.embeddings import THRESHOLD


def _seeds(source: str, key: str, words: str, at: str, whole: bool) -> str:
    """Words under each mask at each position, as text; the mask's number keeps masks apart. Short masks match whole items only."""
    return " UNION ".join(
        f"SELECT {key}, {at}, concat_ws(' ', '{m}', {', '.join(f'{words}[{at} + {o + 1}]' for o in mask)}) AS seed "
        f"FROM (SELECT {key}, {words}, unnest(range(0, len({words}) - {mask[-1]})) AS {at} FROM {source}{f' WHERE len({words}) = {len(mask)}' if whole and mask in SHORT else ''})"
        for m, mask in enumerate(MASKS + SHORT))


_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

OP1 = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, text, {_WORDS} AS h FROM documents),
b AS (SELECT item_id, {_WORDS} AS ih FROM benchmark),
ts AS ({_seeds('t', 'rid', 'h', 'i', False)}),
bs AS ({_seeds('b', 'item_id', 'ih', 'j', True)}),
hits AS (SELECT DISTINCT rid, i, item_id, j FROM ts JOIN bs USING (seed)),
wide AS (SELECT doc_id, text, item_id, h, ih, i, j, len(ih) AS n, least(len(ih), {WINDOW}) AS size,
         unnest(range(greatest(0, j - {BACK}), least(j, len(ih) - least(len(ih), {WINDOW})) + 1)) AS lo
         FROM hits JOIN t USING (rid) JOIN b USING (item_id)),
eq AS (SELECT doc_id, text, item_id, i, j, n, size, len(list_filter(range(lo, lo + size), lambda q: i - j + q >= 0 AND h[i - j + q + 1] = ih[q + 1])) AS matched FROM wide),
ok AS (SELECT * FROM eq WHERE matched >= CASE WHEN n < {SPAN} THEN n ELSE ceil(size * {SHARE}) END)
SELECT doc_id, item_id, max(n) AS item_words, max(matched) AS matched_words, count(DISTINCT (i, j)) AS hits FROM ok GROUP BY doc_id, text, item_id
"""

# unit: what one weight gets once the sources before it (by cap / weight) have stopped at their caps; it peaks at the first source that does not
OP8 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             substr(md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 16) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
q AS (SELECT 3.0::DOUBLE * n / w AS r, w, (sum(n) OVER () - 3 * coalesce(sum(n) OVER (ORDER BY 3.0::DOUBLE * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(w) OVER (ORDER BY 3.0::DOUBLE * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS unit FROM s),
u AS (SELECT max(unit) FILTER (unit <= r) AS unit FROM q),
p AS (SELECT source, n, least(w * unit, 3.0::DOUBLE * n) AS target FROM s, u),
e AS (SELECT *, CASE WHEN n > 0 THEN round_even(target, 0)::BIGINT // n ELSE 0 END AS epochs, CASE WHEN n > 0 THEN round_even(target, 0)::BIGINT % n ELSE 0 END AS rest FROM p),
g AS (SELECT source, h, sum(size)::BIGINT AS m, count(*) AS k, (sum(sum(size)) OVER (PARTITION BY source ORDER BY h))::BIGINT AS till FROM d GROUP BY source, h)
SELECT doc_id, size::BIGINT AS size, n AS source_size, target,
  (epochs * size + CASE WHEN till <= rest THEN size WHEN till - m <= rest THEN least(size, (rest - till + m) // k) ELSE 0 END)::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.h = g.h
"""

OP10 = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.rid AS x, b.rid AS y FROM g a JOIN g b ON a.rid <> b.rid AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT rid AS x, rid AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT r.x AS rid, min(v.vec_id) AS component_id FROM r JOIN v ON v.rid = r.y GROUP BY r.x),
k AS (SELECT x AS rid, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN c USING (rid) LEFT JOIN k USING (rid)
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, array_to_string(u[1:lo], '') AS a, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS z FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

SQL = {"op1_decontaminate": OP1, "op8_mixing": OP8, "op10_embedding_dedup": OP10, "op13_fill_in_middle": OP13}
