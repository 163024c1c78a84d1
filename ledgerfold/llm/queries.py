"""The queries of this package, by the names under which __spark_entry__ registers them."""

from .exact_duplicates import op13_exact_dedup
from .hard_negatives import op12_hard_negatives
from .html_text import op5_html_text
from .language import op10_language_id
from .licences import op3_licence_scan
from .merkle import op11_merkle_manifest
from .mixing import op1_source_mixing
from .near_duplicates import op8_ngram_jaccard_join
from .neighbours import op6_nearest_neighbours
from .packing import op9_packing
from .quality import op4_quality
from .quality_rules import op7_quality_rules
from .toxicity import op2_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_source_mixing, op2_toxicity, op3_licence_scan, op4_quality, op5_html_text, op6_nearest_neighbours, op7_quality_rules, op8_ngram_jaccard_join, op9_packing, op10_language_id, op11_merkle_manifest, op12_hard_negatives, op13_exact_dedup)
}



def _merkle_sql(levels: int = 5, group_levels: int = 3) -> str:
    """SQL for op11 with groups of up to 16^levels rows, and up to 16^group_levels groups."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(concat(" + ", ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + "))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)), 4294967295), 4294967295)"

    def climb(name: str, upto: int) -> list[str]:
        """Nodes of each level of the trees over {name}0 (g, i, n, h), and their runs."""
        return [f"{name}r{k} AS (SELECT g, i // 16 AS up, max(n) AS n, list(h ORDER BY i) AS hs FROM {name}{k} WHERE n > 1 GROUP BY g, i // 16), {name}{k + 1} AS (SELECT g, up AS i, (n + 15) // 16 AS n, sha256(array_to_string(hs, '')) AS h FROM {name}r{k})" for k in range(upto)]

    def fold(name: str, upto: int, at: str, start: str) -> list[str]:
        """Rows of `start` (with g, at, n, p and f) after each level: siblings appended to p, f folded with them."""
        out = [start]
        for k in range(upto):
            left, right = f"array_to_string(hs[1:{at} % 16], '')", f"array_to_string(hs[{at} % 16 + 2:], '')"
            out.append(f"{name}f{k + 1} AS (SELECT x.* REPLACE (CASE WHEN hs IS NULL THEN p ELSE p || {left} || {right} END AS p, CASE WHEN hs IS NULL THEN f ELSE sha256({left} || f || {right}) END AS f, {at} // 16 AS {at}) FROM {name}f{k} x LEFT JOIN {name}r{k} r ON r.g = x.g{'' if name == 's' else 'all'} AND r.up = x.{at} // 16)")
        return out

    ends = lambda name, upto: " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(upto + 1))
    parts = [
        f"d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS g, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS shown FROM documents)",
        "l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d)",
        "s0 AS (SELECT g, i, n, leaf AS h FROM l)",
        *climb("s", levels),
        f"roots AS ({ends('s', levels)})",
        "t0 AS (SELECT 'all' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM roots)",
        *climb("t", group_levels),
        f"root AS ({ends('t', group_levels)})",
        *fold("s", levels, "i", "sf0 AS (SELECT doc_id, g, 'all' AS gall, i, leaf, '' AS p, shown AS f FROM l)"),
        *fold("t", group_levels, "gi", f"tf0 AS (SELECT x.*, gi, roots_in_order.h AS subroot FROM sf{levels} x JOIN (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS gi FROM roots) roots_in_order ON roots_in_order.g = x.g)"),
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = root.h AS verified FROM tf{group_levels}, root"


#: DuckDB SQL where it can express a query on whole tables. Brute force over shared shingles, for small tables.
ORACLE = {
    "op8_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, hash(unnest(sh)) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, u.y FROM r JOIN u ON u.x = r.other)
SELECT n.doc_id, n.n AS n_shingles, min(r.other) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
""",
    "op11_merkle_manifest": _merkle_sql(),
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, a.label, a.e, c.vec_id AS positive_id, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS positive_score FROM v a JOIN v c ON a.label = c.label AND a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY positive_score DESC, c.vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, c.vec_id AS negative_id, CAST(list_dot_product(p.e, c.e) AS BIGINT) AS negative_score FROM p JOIN v c ON p.label <> c.label)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
WHERE 80 * positive_score <= 100 * negative_score AND 100 * negative_score <= 100 * positive_score QUALIFY rank <= 5
""",
    "op13_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, row_number() OVER w = 1 AS kept, h AS text_sha256 FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
""",
}
