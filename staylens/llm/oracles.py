"""SQL for the results of the operators that SQL can express, over the same tables."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from staylens.llm.decontaminate import WINDOW_WORDS
from staylens.llm.embeddings import LIMIT
from staylens.llm.lexical import TOP
from staylens.llm.lines import MIN_DOCUMENTS, MIN_KEY_CHARS

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _lowered(text: str) -> str:
    return f"translate({text}, '{ascii_uppercase}', '{ascii_lowercase}')"


def _words(text: str) -> str:
    return rf"regexp_extract_all({_lowered(text)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


LINES = f"""
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), numbered AS (
    SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split
), keyed AS (
    SELECT *, {_lowered(f"trim(line, {_BLANKS})")} AS key FROM numbered
), common AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {MIN_KEY_CHARS}
    GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}
), judged AS (
    SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id <> c.keeper, false) AS dropped
    FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT
    doc_id,
    count(*) AS n_lines,
    count(*) FILTER (WHERE dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

PASSAGES = f"""
WITH doc_words AS (
    SELECT doc_id, {_words("coalesce(text, '')")} AS found FROM documents
), item_words AS (
    SELECT CAST(item_id AS VARCHAR) AS item, {_words("text")} AS found
    FROM benchmark WHERE text IS NOT NULL
), windows AS (
    SELECT DISTINCT item, size, found[first : first + size - 1] AS pattern
    FROM (
        SELECT item, found, size, unnest(range(1, len(found) - size + 2)) AS first
        FROM (SELECT *, least(len(found), {WINDOW_WORDS}) AS size FROM item_words WHERE len(found) > 0)
    )
), placed AS (
    SELECT doc_id, unnest(found) AS word, generate_subscripts(found, 1) AS pos FROM doc_words
), ahead AS (
    SELECT doc_id, pos, list(word) OVER (
        PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW_WORDS - 1} FOLLOWING
    ) AS following FROM placed
), under_view AS (
    SELECT a.doc_id, a.pos, s.size, a.following[1 : s.size] AS pattern
    FROM ahead a JOIN (SELECT DISTINCT size FROM windows) s ON len(a.following) >= s.size
), occurring AS (
    SELECT u.doc_id, u.pos, u.size, w.item
    FROM under_view u JOIN windows w ON u.size = w.size AND u.pattern = w.pattern
), hit AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM occurring) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS item_list
    FROM (SELECT DISTINCT doc_id, item FROM occurring WHERE item IS NOT NULL) GROUP BY doc_id
)
SELECT
    d.doc_id,
    CAST(len(d.found) AS BIGINT) AS n_words,
    coalesce(h.n_hit, 0) AS n_hit,
    coalesce(i.n_items, 0) AS n_items,
    sha256(coalesce(i.item_list, '')) AS items_sha256,
    h.n_hit IS NOT NULL AS contaminated
FROM doc_words d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""

VECTORS = f"""
WITH RECURSIVE numbered AS MATERIALIZED (
    SELECT row_number() OVER () AS row_no, vec_id, embedding FROM embeddings
), usable AS (
    SELECT row_no, CAST(embedding AS DOUBLE[]) AS v FROM numbered
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.row_no AS node, b.row_no AS other
    FROM usable a JOIN usable b ON a.row_no <> b.row_no AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= {LIMIT}
), reach AS (
    SELECT row_no AS node, row_no AS reached FROM numbered
    UNION
    SELECT r.node, l.other FROM reach r JOIN links l ON r.reached = l.node
), roots AS (
    SELECT node, min(n.vec_id) AS component_id FROM reach r JOIN numbered n ON r.reached = n.row_no GROUP BY node
), counted AS (
    SELECT node, count(*) AS n_links FROM links GROUP BY node
)
SELECT
    e.vec_id,
    coalesce(c.n_links, 0) AS n_links,
    r.component_id,
    e.vec_id IS NOT DISTINCT FROM r.component_id AS kept
FROM numbered e JOIN roots r ON e.row_no = r.node LEFT JOIN counted c ON e.row_no = c.node
"""

def _terms(text: str) -> str:
    return rf"regexp_extract_all({_lowered(text)}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


RANKED = f"""
WITH doc_terms AS (
    SELECT doc_id, {_terms("text")} AS found FROM documents
), sized AS (
    SELECT doc_id, CAST(len(found) AS BIGINT) AS n FROM doc_terms WHERE len(found) > 0
), whole AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sized
), item_terms AS (
    SELECT item_id, unnest(list_distinct({_terms("text")})) AS term FROM benchmark
), counted AS (
    SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(found) AS term FROM doc_terms)
    WHERE term IN (SELECT term FROM item_terms) GROUP BY doc_id, term
), weighed AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM counted, whole GROUP BY term, docs
), normed AS (
    SELECT doc_id, 100 - 90 + (90 * n * docs) // words AS m FROM sized, whole
), scored AS (
    SELECT i.item_id, c.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM item_terms i JOIN counted c ON i.term = c.term JOIN weighed g ON g.term = c.term
    JOIN normed n ON n.doc_id = c.doc_id
    GROUP BY i.item_id, c.doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= {TOP}
"""

ORACLE_SQL: dict[str, str] = {
    "op4_embedding_dedup": VECTORS,
    "op5_decontaminate": PASSAGES,
    "op6_line_dedup": LINES,
    "op11_lexical": RANKED,
}
