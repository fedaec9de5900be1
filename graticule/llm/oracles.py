"""SQL that DuckDB runs on the same tables, for the queries that SQL can express.

Left out, and compared with brute force in the tests instead: role and structure repair (dynamic
programming, search), URL verdicts (folds by a hash that DuckDB lacks), packing and token counts
(tokenizer ids), mixing (order by the same hash).
"""

from __future__ import annotations

from graticule.llm.collocations import BEST, SUPPORT
from graticule.llm.license_scan import CONTAINMENT, PHRASES, TEMPLATES
from graticule.llm.quality_rules import CUTOFFS, ERROR, FALSE_REJECTIONS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOW = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
_WORD = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _components(links: str, nodes: str, node: str) -> str:
    """Common tables ``reach(node, component)`` from ``links(a, b)`` and all ``nodes``."""
    return f"""
    sides AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
    walk AS (SELECT {node} AS node, {node} AS seen FROM {nodes} UNION SELECT w.node, b.b FROM walk w JOIN sides b ON w.seen = b.a),
    reach AS (SELECT node, min(seen) AS component FROM walk GROUP BY node)"""


def _quality() -> str:
    rules, n = list(CUTOFFS), max(map(len, CUTOFFS.values()))
    steps = ", ".join(f"({g}, {', '.join(str(cuts[min(g, len(cuts) - 1)]) for cuts in CUTOFFS.values())})" for g in range(n))
    limit = FALSE_REJECTIONS
    over = " OR ".join(f"m.{r} > s.max_{r}" for r in rules)
    return rf"""
    WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
                      regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
    at8 AS (SELECT doc_id, unnest(range(0, len(ws) - 7)) AS i, ws FROM w WHERE len(ws) >= 8),
    win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i + 1, i + 8), ' ') AS s FROM at8),
    twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
    rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(8) t(j) GROUP BY doc_id),
    m0 AS (SELECT w.doc_id, stratum, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
                  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) AS n_lines,
                  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
                  length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
    m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                 coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbols, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_lines,
                 coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeats, coalesce(n_capitals / nullif(word_chars, 0), 0) AS capitals FROM m0),
    steps(g, {", ".join(f"max_{r}" for r in rules)}) AS (VALUES {steps}),
    good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
    k AS (SELECT stratum, g, count(*) AS n, count(*) FILTER ({over}) AS k
          FROM m, steps s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY ALL),
    p AS (SELECT *, CASE WHEN k < n * {limit} THEN list_sum(list_transform(range(0, k + 1), lambda i:
              exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln({limit}) + (n - i) * ln(1 - {limit})))) ELSE 1 END AS tail,
              (SELECT count(DISTINCT stratum) FROM k) AS strata FROM k),
    ok AS (SELECT *, bool_and(tail <= {ERROR} / strata) OVER (PARTITION BY stratum ORDER BY g) AS passed FROM p),
    best AS (SELECT stratum, max(g) AS g FROM ok WHERE passed GROUP BY ALL),
    bad AS (SELECT doc_id, {over} AS rejected FROM m JOIN best ON m.stratum = best.stratum JOIN steps s ON best.g = s.g)
    SELECT m.doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT coalesce(rejected, false) AS kept
    FROM m LEFT JOIN bad ON m.doc_id = bad.doc_id
    """


def _licences() -> str:
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    sets = [(label, sorted(set(words.split()))) for label, words in TEMPLATES]
    n = 2 * max(len(words.split()) for _, words in TEMPLATES)
    templates = ", ".join(f"('{label}', {words}, {-(-len(words) * int(100 * CONTAINMENT) // 100)})" for label, words in sets)
    return rf"""
    WITH w AS (SELECT doc_id, {_LOW} AS text, regexp_extract_all({_LOW}, '{_ALNUM}') AS ws FROM documents),
    phrases(phrase, label, n) AS (VALUES {phrases}),
    spots AS (SELECT doc_id, label, unnest(list_filter(range(0, len(ws) - n + 1), lambda i: array_to_string(list_slice(ws, i + 1, i + n), ' ') = phrase)) AS place
              FROM w, phrases WHERE len(ws) >= n),
    base AS (SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word FROM spots GROUP BY doc_id),
    templates(label, words, need) AS (VALUES {templates}),
    starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {n}, 1) + 1, {n})) AS i FROM w),
    lines AS (SELECT doc_id, regexp_extract_all(unnest(string_split(text, chr(10))), '{_ALNUM}') AS ls FROM w),
    sets AS (SELECT doc_id, list_distinct(list_slice(ws, i, i + {2 * n} - 1)) AS b FROM starts
             UNION ALL SELECT doc_id, list_distinct(ls) FROM lines WHERE len(ls) <= {2 * n}),
    hits AS (SELECT doc_id, label, len(list_intersect(b, words)) / len(words) AS share FROM sets, templates WHERE len(list_intersect(b, words)) >= need),
    labels_ AS (SELECT DISTINCT doc_id, label, true AS base FROM spots UNION ALL SELECT DISTINCT doc_id, label, false FROM hits),
    named AS (SELECT doc_id, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
                     string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM labels_ GROUP BY doc_id),
    best AS (SELECT doc_id, max(share) AS share FROM hits GROUP BY doc_id)
    SELECT w.doc_id, len(ws) AS n_words, coalesce(base.n, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, round(CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(share, 0) END, 6)::DOUBLE AS score
    FROM w LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
    """


def _embeddings() -> str:
    return f"""
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
    {_components("links", "v", "vec_id")},
    degree AS (SELECT a AS vec_id, count(*) AS n FROM sides GROUP BY a)
    SELECT v.vec_id, coalesce(n, 0) AS n_links, component AS component_id, v.vec_id = component AS kept
    FROM v JOIN reach ON v.vec_id = reach.node LEFT JOIN degree ON v.vec_id = degree.vec_id
    """


def _near_duplicates() -> str:
    return rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS ws FROM documents),
    at5 AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i + 1, i + 5), ' ') AS s FROM at5),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM meet JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * m >= 75 * (na.n + nb.n - m)),
    {_components("links", "w", "doc_id")}
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component AS component_id, w.doc_id = component AS kept
    FROM w JOIN reach ON w.doc_id = reach.node LEFT JOIN n ON w.doc_id = n.doc_id
    """


def _passages() -> str:
    return rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
    at35 AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35),
    win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i + 1, i + 35), ' ') AS s FROM at35),
    twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY s) > 1),
    gone AS (SELECT DISTINCT doc_id, i + j AS p FROM twice, range(35) t(j)),
    words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS p FROM w),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
    """


def _equal_texts() -> str:
    return """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """


def _collocations() -> str:
    return rf"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
    g AS (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda m: list_transform(range(0, greatest(len(ws) - m + 1, 0)), lambda i: list_slice(ws, i + 1, i + m))))) AS ph FROM w),
    n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
    f AS (SELECT lang, ph, count(*) AS f FROM g GROUP BY lang, ph HAVING count(*) >= {SUPPORT}),
    c AS (SELECT * FROM f WHERE len(ph) > 1),
    cuts AS (SELECT lang, ph, f AS a, unnest(range(1, len(ph))) AS k FROM c),
    s AS (SELECT cuts.lang, cuts.ph, a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
          FROM cuts JOIN n ON n.lang = cuts.lang JOIN f l ON l.lang = cuts.lang AND l.ph = cuts.ph[1:k] JOIN f r ON r.lang = cuts.lang AND r.ph = cuts.ph[k + 1:]),
    best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
    parts AS (SELECT lang, f, unnest(flatten(list_transform(range(2, len(ph)), lambda m: list_transform(range(0, len(ph) - m + 1), lambda i: list_slice(ph, i + 1, i + m))))) AS ph FROM c),
    longer AS (SELECT lang, ph, max(f) AS f FROM parts GROUP BY lang, ph),
    kept AS (SELECT best.lang, array_to_string(best.ph, ' ') AS phrase, a, l, r, n, score FROM best LEFT JOIN longer ON best.lang = longer.lang AND best.ph = longer.ph
             WHERE longer.f IS NULL OR 100 * longer.f < 100 * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
    FROM kept QUALIFY rank <= {BEST}
    """


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": _quality(), "op2_license_scan": _licences(), "op3_embedding_dedup": _embeddings(),
        "op6_minhash_dedup": _near_duplicates(), "op7_substring_dedup": _passages(), "op11_exact_dedup": _equal_texts(),
        "op12_collocations": _collocations(),
    }
