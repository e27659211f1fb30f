"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op10_ann
from .bpe import op7_bpe
from .brown import op6_brown
from .jaccard import op2_jaccard
from .langid import op3_langid
from .media import op4_media
from .lines import op8_lines
from .packing import op5_packing
from .secrets import op9_secrets
from .substring import op1_substring

QUERIES = {
    "op1_substring": op1_substring,
    "op2_jaccard": op2_jaccard,
    "op3_langid": op3_langid,
    "op4_media": op4_media,
    "op5_packing": op5_packing,
    "op6_brown": op6_brown,
    "op7_bpe": op7_bpe,
    "op8_lines": op8_lines,
    "op9_secrets": op9_secrets,
    "op10_ann": op10_ann,
}
_WORDS = r"'[^\x20\x09-\x0D]+'"
ORACLES: dict[str, str] = {
    "op1_substring": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM d),
windows AS (SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(w[p:p + 19], ' ') ORDER BY doc_id, p) AS k FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS pos FROM windows WHERE k > 1),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op2_jaccard": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS p FROM d WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least AS component_id FROM d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY 1) r ON r.doc_id = d.doc_id""",
}
