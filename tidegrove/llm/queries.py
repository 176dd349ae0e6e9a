"""The driver's queries of this subpackage and their SQL."""

from __future__ import annotations

from tidegrove.llm.ann import op4_nearest
from tidegrove.llm.bpe import op7_byte_bpe
from tidegrove.llm.decontamination import op5_decontamination
from tidegrove.llm.line_dedup import op2_line_dedup
from tidegrove.llm.quality import op1_quality
from tidegrove.llm.secret_scan import op9_secret_scan
from tidegrove.llm.sharding import op8_sharding
from tidegrove.llm.simhash import op10_simhash
from tidegrove.llm.substring_dedup import op6_substring_dedup
from tidegrove.llm.url_reputation import OP3_SQL, op3_url_reputation

QUERIES = {f.__name__: f for f in (op1_quality, op2_line_dedup, op3_url_reputation, op4_nearest, op5_decontamination, op6_substring_dedup, op7_byte_bpe, op8_sharding, op9_secret_scan, op10_simhash)}

#: The definition itself: every window by its digest, with the least document that has it.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50) AS p),
m AS (SELECT k, min(doc_id) AS earliest FROM h GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM (SELECT h.doc_id, h.s FROM h JOIN m ON h.k = m.k WHERE m.earliest < h.doc_id) AS f),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT o.doc_id, string_agg(o.word, ' ' ORDER BY o.i) AS body, count(*) AS n FROM words AS o LEFT JOIN gone AS g ON o.doc_id = g.doc_id AND o.i = g.i WHERE g.i IS NULL GROUP BY o.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM d LEFT JOIN kept AS k ON d.doc_id = k.doc_id
"""

ORACLES: dict[str, str] = {"op3_url_reputation": OP3_SQL, "op6_substring_dedup": OP6_SQL}
