"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op4_nearest
from .bpe import op1_byte_bpe
from .langid import op9_language_id
from .lines import op6_line_dedup
from .minhash import op8_minhash
from .mixing import op7_mixing
from .mlm import op2_masked_lm
from .planes import op3_id_planes
from .repetition import op5_quality_rules
from .sufdedup import op10_suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_masked_lm": op2_masked_lm,
        "op3_id_planes": op3_id_planes,
        "op4_nearest": op4_nearest,
        "op5_quality_rules": op5_quality_rules,
        "op6_line_dedup": op6_line_dedup,
        "op7_mixing": op7_mixing,
        "op8_minhash": op8_minhash,
        "op9_language_id": op9_language_id,
        "op10_suffix_dedup": op10_suffix_dedup,
    }


#: Shingle sets, all pairs that share a shingle, and reachability.
MINHASH = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0), s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM i), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.c = e.a), m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """For the query that SQL can express; the others are tested against brute force or other libraries."""
    return {"op8_minhash": MINHASH}
