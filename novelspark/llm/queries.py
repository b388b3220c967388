"""The queries of this subpackage, and their SQL where SQL can express them."""

from novelspark.llm.audit import OP11_SQL, op11_filter_audit
from novelspark.llm.bpe import op8_byte_bpe
from novelspark.llm.chat import op2_chat_formatting
from novelspark.llm.decontaminate import op6_decontamination
from novelspark.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from novelspark.llm.lines import OP4_SQL, op4_line_dedup
from novelspark.llm.lm_scoring import op7_lm_scoring
from novelspark.llm.quality import op9_quality_classifier
from novelspark.llm.repeats import op10_suffix_dedup
from novelspark.llm.secret_scan import op1_secret_scan
from novelspark.llm.simhash import op3_simhash_near_dedup
from novelspark.llm.spelling import op12_spelling_variants
from novelspark.llm.word_bpe import op13_word_bpe

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_word_bpe": op13_word_bpe,
}
_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-/:-`{-\\x7f]+'), lambda x: x <> '')"

OP6_SQL = f"""
WITH items AS (SELECT item_id, w, least(5, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) q WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM (SELECT *, unnest(range(len(w) - n + 1)) AS i FROM items) q),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM wanted GROUP BY item_id),
docs AS (SELECT doc_id, w, n FROM (SELECT doc_id, {_WORDS} AS w FROM documents) q CROSS JOIN (SELECT DISTINCT n FROM items) l WHERE len(w) >= n),
have AS (SELECT DISTINCT doc_id, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM (SELECT *, unnest(range(len(w) - n + 1)) AS i FROM docs) q),
hits AS (SELECT doc_id, item_id, count(*) AS n_shared FROM have JOIN wanted ON have.n = wanted.n AND have.s = wanted.s GROUP BY doc_id, item_id)
SELECT doc_id, h.item_id, n_shared, n_shingles, n_shared::DOUBLE / n_shingles::DOUBLE AS containment FROM hits h JOIN sizes z ON h.item_id = z.item_id WHERE n_shared >= 0.8 * n_shingles - 1e-9
"""

OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS v FROM (SELECT doc_id, h, unnest(range(greatest(n - 99, 0))) AS s FROM d) q),
f AS (SELECT v, min(doc_id::HUGEINT * 1000000000 + s) AS first FROM w GROUP BY v HAVING count(*) > 1),
g AS (SELECT w.doc_id, w.s, coalesce(w.s > lag(w.s) OVER (PARTITION BY w.doc_id ORDER BY w.s) + 100, true) AS opens FROM w JOIN f ON w.v = f.v WHERE w.doc_id::HUGEINT * 1000000000 + w.s > f.first),
r AS (SELECT doc_id, s, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM g),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM r GROUP BY doc_id, run),
pieces AS (SELECT runs.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY runs.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY runs.doc_id ORDER BY a), 0))) AS piece FROM runs JOIN d ON d.doc_id = runs.doc_id),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(piece, '' ORDER BY a) AS front FROM pieces GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(concat(coalesce(front, ''), substr(h, 2 * coalesce(last, 0) + 1)))) AS kept_sha256
FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
"""

ORACLE_SQL = {"op4_line_dedup": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op6_decontamination": OP6_SQL, "op10_suffix_dedup": OP10_SQL, "op11_filter_audit": OP11_SQL}
