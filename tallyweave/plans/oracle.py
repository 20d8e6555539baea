"""SQL for DuckDB that computes the registered queries independently, from the same tables."""

from __future__ import annotations

from ..functions import tables as T
from ..params import BAND_EDGES, CUTOFFS, NAIVE_TAUS, RECALL_KS

EXAMPLE_CAP = 5


def case(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + f" ELSE {x} END"


def rounded(x: str, places: int = 4) -> str:
    return f"floor(({x}) * 1e{places} + 0.5) / 1e{places}"


def skeleton(x: str) -> str:
    s = f"replace({x}, 'tion', 'shn')"
    k = f"translate(regexp_replace({s}, '[aeiouyh]', '', 'g'), 'cqgzvwf', 'kkjjbbp')"
    k = f"replace({k}, 'x', 'Ks')"
    for c in "bdjklmnprst":
        k = f"regexp_replace({k}, '{c}{c}+', '{c}', 'g')"
    k = f"replace({k}, 'K', 'k')"
    k = f"CASE WHEN regexp_matches({s}, '^[aeiou]') THEN 'a' || {k} ELSE {k} END"
    return f"CASE WHEN regexp_full_match({s}, '[a-z]{{3,}}') AND length({k}) >= 2 THEN {k} END"


def number(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '0+') THEN '0' ELSE regexp_replace({x}, '^0+([1-9])', '\\1') END"


ER = r"""docw AS (SELECT doc_id, lang, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
er AS (SELECT 'S' || (1 + doc_id % 3) || '-' || doc_id AS id, 1 + doc_id % 3 AS src, array_to_string(w[1:4], ' ') AS name, array_to_string(w[5:12], ' ') AS addr, lang AS country FROM docw)"""
NUMBER_ADDR = number(case("x", T.ADDRESS_WORDS | T.STATES))
REC = ER + f""",
recs AS (SELECT id, src, country, list_transform(list_filter(string_split(strip_accents(name), ' '), lambda x: x <> ''), lambda x: {case('x', T.NAME_WORDS)}) AS nw,
  list_filter(list_transform(list_filter(string_split(strip_accents(addr), ' '), lambda x: x <> ''), lambda x: {NUMBER_ADDR}), lambda x: x <> '') AS aw FROM er),
rec AS (SELECT *, list_filter(nw, lambda x: x NOT IN ({', '.join(f"'{w}'" for w in T.STOP_WORDS)})) AS core FROM recs)"""
TOK = REC + f""",
nword AS (SELECT id, src, country, unnest(nw) AS w FROM rec), aword AS (SELECT id, src, country, unnest(aw) AS w FROM rec), cword AS (SELECT id, src, country, unnest(core) AS w FROM rec),
t AS (SELECT DISTINCT id, src, country, ch, tag, tok FROM (
  SELECT id, src, country, 0 AS ch, 'w' AS tag, w AS tok FROM nword
  UNION ALL SELECT id, src, country, 1, 'j', array_to_string(core, '') FROM rec WHERE len(core) > 0
  UNION ALL SELECT id, src, country, 1, 'j', array_to_string(list_sort(core), '') FROM rec WHERE len(core) > 0
  UNION ALL SELECT id, src, country, 2, 's', {skeleton('w')} FROM nword
  UNION ALL SELECT id, src, country, 2, 'p', substr(w, 1, 4) FROM nword WHERE length(w) >= 6 AND length(w) = strlen(w)
  UNION ALL SELECT id, src, country, 2, 'x', right(w, 4) FROM nword WHERE length(w) >= 6 AND length(w) = strlen(w)
  UNION ALL SELECT id, src, country, 3, 'a', w FROM aword
  UNION ALL SELECT id, src, country, 4, 'k', {skeleton('w')} FROM aword WHERE strlen(w) >= 4
  UNION ALL SELECT id, src, country, 5, 't', substr('#' || w || '#', i, 3) FROM (SELECT id, src, country, w, unnest(range(1, length(w) + 1)) AS i FROM cword WHERE regexp_full_match(w, '[a-z0-9]{{4,}}'))
) WHERE tok IS NOT NULL)"""


def _weights(max_df: int, max_trig: int) -> str:
    return TOK + f""",
cn AS (SELECT country, count(*) AS n FROM er WHERE src <> 1 GROUP BY country),
v AS (SELECT country, ch, tag, tok, count(*) AS df FROM t WHERE src <> 1 GROUP BY ALL),
vi AS (SELECT v.*, ln(1 + n / greatest(df, 1)) AS idf FROM v JOIN cn USING (country)),
dw AS (SELECT id, country, ch, tag, tok, idf / greatest(sqrt(sum(idf * idf) OVER (PARTITION BY id, ch)), 1e-6) AS w FROM t JOIN vi USING (country, ch, tag, tok) WHERE src <> 1),
qa AS (SELECT id, t.country, t.ch, t.tag, t.tok, df, coalesce(idf, ln(1 + n)) AS idf FROM t JOIN cn ON t.country = cn.country LEFT JOIN vi ON t.country = vi.country AND t.ch = vi.ch AND t.tag = vi.tag AND t.tok = vi.tok WHERE src = 1),
qw AS (SELECT *, idf / greatest(sqrt(sum(idf * idf) OVER (PARTITION BY id, ch)), 1e-6) AS w FROM qa),
qk AS (SELECT *, df <= CASE WHEN ch = 5 THEN {max_trig} ELSE {max_df} END AS ok FROM qw WHERE df IS NOT NULL),
qr AS (SELECT *, bool_or(ok) OVER (PARTITION BY id) AS any_ok, row_number() OVER (PARTITION BY id ORDER BY df, ch, tag, tok) AS r FROM qk),
q AS (SELECT * FROM qr WHERE ok OR (NOT any_ok AND r = 1)),
x AS (SELECT q.id AS s1_id, dw.id AS cand_id, CASE q.ch WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 5 THEN 2 ELSE 3 END AS g, CASE q.ch WHEN 0 THEN 1.0 WHEN 3 THEN 1.0 WHEN 4 THEN 0.3 ELSE 0.5 END * q.w * dw.w AS p
  FROM q JOIN dw USING (country, ch, tag, tok)),
s AS (SELECT s1_id, cand_id, {', '.join(f'round(coalesce(sum(p) FILTER (g = {i}), 0), 9) AS g{i}' for i in range(4))} FROM x GROUP BY s1_id, cand_id)"""


SCORES = _weights(100_000, 20_000)
KEYS = {"total": "round(g0 + g1 + g2 + g3, 9)", "agree": "least(round(0.5 * (g0 + g1 + g2), 9), g3)", "noaddr": "CASE WHEN has_addr THEN 0 ELSE round(g0 + g1 + g2, 9) END", **{f"g{i}": f"g{i}" for i in range(4)}}
KS = {"total": 15, "agree": 10, "noaddr": 5, "g0": 5, "g1": 10, "g2": 10, "g3": 15}
RANKED = SCORES + f""",
sa AS (SELECT s.*, len(aw) > 0 AS has_addr FROM s JOIN rec ON rec.id = s.cand_id),
sr AS (SELECT *, {', '.join(f'{k} AS k_{n}, row_number() OVER (PARTITION BY s1_id ORDER BY {k} DESC, cand_id) AS r_{n}' for n, k in KEYS.items())} FROM sa)"""
CANDS = RANKED + f""",
c AS (SELECT s1_id, cand_id, g0, g1, g2, g3, {KEYS['total']} AS total, row_number() OVER (PARTITION BY s1_id ORDER BY {KEYS['total']} DESC, cand_id) - 1 AS rank FROM sr WHERE {' OR '.join(f'(r_{n} <= {k} AND k_{n} > 0)' for n, k in KS.items())})"""
TRUTH = """,
truth AS (SELECT a.id AS s1_id, b.id AS cand_id FROM er a JOIN er b USING (country, name, addr) WHERE a.src = 1 AND b.src <> 1 AND addr <> ''),
gt AS (SELECT er.id AS s1_id, country, count(truth.cand_id) AS n FROM er LEFT JOIN truth ON truth.s1_id = er.id WHERE src = 1 GROUP BY ALL),
ch AS (SELECT c.*, truth.cand_id IS NOT NULL AS hit FROM c LEFT JOIN truth USING (s1_id, cand_id))"""
CT = CANDS + TRUTH
ATTR = CANDS + f""",
nwm AS (SELECT id, list_distinct(nw) AS nt, list_distinct(aw_m) AS at, list_filter(aw_m, lambda x: regexp_full_match(x, '[0-9]{{1,10}}')) AS nums, nn, an FROM (SELECT recs.id, nw, strip_accents(name) AS nn, strip_accents(addr) AS an,
  list_filter(list_transform(list_filter(string_split(strip_accents(addr), ' '), lambda x: x <> ''), lambda x: {case(number(case('x', T.MATCHER_ADDRESS_WORDS)), T.MATCHER_STATES)}), lambda x: x <> '') AS aw_m FROM recs JOIN er USING (id))),
pa AS (SELECT s1_id, cand_id, total, a.nt AS nta, b.nt AS ntb, a.at AS ata, b.at AS atb, a.nums[1:4] AS na, b.nums[1:4] AS nb, coalesce(list_filter(a.nums, lambda x: length(x) >= 5)[1]::BIGINT & 4294967295, 0) AS pina,
  coalesce(list_filter(b.nums, lambda x: length(x) >= 5)[1]::BIGINT & 4294967295, 0) AS pinb, a.nn AS nna, b.nn AS nnb, a.an AS ana, b.an AS anb FROM c JOIN nwm a ON a.id = s1_id JOIN nwm b ON b.id = cand_id)"""


def f05(tp: str, pred: str, true: str) -> str:
    return f"CASE WHEN {true} = 0 THEN CASE WHEN {pred} = 0 THEN 1.0 ELSE 0.0 END WHEN {tp} = 0 THEN 0.0 ELSE 1.25 * {tp} / ({pred} + 0.25 * {true}) END"


def _inter(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def _overlap(p: str, a: str, b: str) -> str:
    i = _inter(a, b)
    cols = {f"{p}inter": f"{i}::DOUBLE", f"{p}jacc": f"{i} / greatest(len({a}) + len({b}) - {i}, 1)", f"{p}cont_a": f"{i} / greatest(len({a}), 1)", f"{p}cont_b": f"{i} / greatest(len({b}), 1)"}
    return ", ".join(f"{rounded(x)} AS {n}" for n, x in cols.items())


def _gap(a: str, b: str) -> str:
    return f"abs(length({a}) - length({b})) / greatest(length({a}), length({b}), 1)"


def _lev(a: str, b: str) -> str:
    return f"CASE WHEN total < 1.4 OR {a} = '' OR {b} = '' THEN 0.0 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END"


SWEPT = f""",
taus AS (SELECT unnest([{', '.join(map(str, NAIVE_TAUS))}]::DOUBLE[]) AS tau),
per AS (SELECT tau, gt.s1_id, gt.n, count(ch.cand_id) FILTER (total >= tau) AS pred, count(*) FILTER (hit AND total >= tau) AS tp FROM taus CROSS JOIN gt LEFT JOIN ch ON ch.s1_id = gt.s1_id GROUP BY ALL),
swept AS (SELECT tau, {rounded('avg(' + f05('tp', 'pred', 'n') + ')', 8)} AS f05, sum(tp) / greatest(sum(pred), 1) AS prec, sum(tp) / greatest(sum(n), 1) AS rec FROM per GROUP BY tau)"""
TOP = "SELECT s1_id, cand_id, {r}::INTEGER AS r, {k} AS score FROM sr WHERE {r} <= {n} AND {kk} > 0"
TOP_SQL = {f"q_topk_{n}": f"WITH {RANKED} SELECT s1_id, cand_id, r_{n}::INTEGER AS r, {rounded(f'k_{n}')} AS score FROM sr WHERE r_{n} <= {k} AND k_{n} > 0" for n, k in KS.items()}
BAND_SQL = "CASE " + " ".join(f"WHEN total >= {a} AND total < {b} THEN {a}" for a, b in zip(BAND_EDGES, BAND_EDGES[1:], strict=False)) + " END"
GROUPED = "SELECT s1_id, cand_id, " + ", ".join(f"{rounded(f'g{i}')} AS g{i}" for i in range(4))
LIT_ADDR = "(VALUES (1, '05th floor 0046'), (2, '01018 kenwood street hammond indiana'), (3, '1018 kenwood street glenville north carolina'), (4, 'null road 000 west bengal'), (5, '00abc goa na'))"
NORM = "regexp_replace(regexp_replace(lower(strip_accents(text)), '[.''’`​-‍⁠﻿]', '', 'g'), '[^\\p{L}\\p{N}]', ' ', 'g')"
MATCHER_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '[.''’​-‍⁠﻿]', '', 'g'), '[!\"#$%&()*+,\\-/:;<=>?@\\[\\\\\\]^_`{|}~\\t\\r]', ' ', 'g'), '\\s+', ' ', 'g'))"
PWORDS = "pw AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part)"
LISTED = CANDS + ", lines AS (SELECT s1_id, CASE WHEN hash_bad = 1 THEN items || ',' || split_part(items, ',', 1) WHEN hash_bad = 2 THEN 'S1-1,X9-2' ELSE items END AS items, hash_bad FROM (SELECT s1_id, string_agg(cand_id, ',' ORDER BY rank) AS items, CAST(substr(s1_id, 4) AS BIGINT) % 20 AS hash_bad FROM c GROUP BY s1_id) WHERE hash_bad <> 3)"


def _rule(name: str, source: str) -> str:
    return f"SELECT '{name}' AS rule, 'error' AS severity, count(*) AS n, array_to_string(list_sort(list(x))[1:{EXAMPLE_CAP}], ',') AS examples FROM ({source}) HAVING count(*) > 0"


ORACLES = {
    "q_normalize": f"SELECT doc_id, {NORM} AS norm FROM documents",
    "q_normalize_matcher": f"SELECT doc_id, {MATCHER_NORM} AS norm FROM documents",
    "q_strip_web": "SELECT page_id, CASE WHEN regexp_full_match(h, '.+?(\\.co\\.in|\\.com|\\.net|\\.org|\\.biz|\\.info|\\.in|\\.fr|\\.co|\\.us|\\.io)') THEN regexp_replace(h, '^(.+?)(\\.co\\.in|\\.com|\\.net|\\.org|\\.biz|\\.info|\\.in|\\.fr|\\.co|\\.us|\\.io)$', '\\1') ELSE h END AS host FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:]+)', 1), '^www\\.', '') AS h FROM pages)",
    "q_skeleton": f"WITH {PWORDS} SELECT w, {skeleton('w')} AS skeleton FROM pw",
    "q_trigrams": f"WITH {PWORDS} SELECT w, i::INTEGER AS i, substr('#' || w || '#', i, 3) AS gram FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM pw WHERE regexp_full_match(w, '[A-Za-z0-9]{{4,}}'))",
    "q_canon_addr": f"WITH {REC} SELECT id, array_to_string(aw, ' ') AS addr FROM rec UNION ALL SELECT id, addr FROM (VALUES ('L1', '5th fl 46'), ('L2', '1018 kenwood st hammond in'), ('L3', '1018 kenwood st glenville nc'), ('L4', 'rd 0 wb'), ('L5', '00abc ga')) v(id, addr)",
    "q_name_core": f"WITH {REC} SELECT id, array_to_string(nw, ' ') AS words, array_to_string(core, ' ') AS core FROM rec",
    "q_translit": "SELECT * FROM (VALUES ('बालाजी', 'balaji'), ('अरिहंत', 'arihant'), ('Anitra Vásquez Money L.L.C.', 'anitra vasquez money llc'), ('bethchapel.com', 'bethchapel')) v(name, words)",
    "q_holdout": f"WITH {ER}, h AS (SELECT id, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split(id, ''), lambda x: ord(x)::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM er) SELECT id FROM h WHERE h % 10 = 0",
    "q_folds": f"WITH {ER}, k AS (SELECT id, CAST(substr(id, 4) AS BIGINT) * 4 + src AS key FROM er) SELECT id, key, CAST(((key::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT) // 2305843009213693952::UHUGEINT % 5 AS INTEGER) AS fold FROM k",
    "q_tokens": f"WITH {TOK} SELECT id, country, ch::INTEGER AS ch, tag, tok FROM t",
    "q_idf": f"WITH {SCORES} SELECT country, ch::INTEGER AS ch, tag, tok, df, {rounded('idf')} AS idf FROM vi",
    "q_doc_norm": f"WITH {SCORES} SELECT id, ch::INTEGER AS ch, tag, tok, {rounded('w')} AS w FROM dw",
    "q_block_scores": f"WITH {SCORES} {GROUPED} FROM s",
    "q_rarest_fallback": f"WITH {_weights(3, 2)} {GROUPED} FROM s",
    **TOP_SQL,
    "q_candidates": f"WITH {CANDS} {GROUPED}, {rounded('total')} AS total, rank::INTEGER AS rank FROM c",
    "q_candidate_lists": f"WITH {CANDS} SELECT er.id AS s1_id, coalesce(string_agg(cand_id, ',' ORDER BY rank), '') AS items FROM er LEFT JOIN c ON c.s1_id = er.id WHERE src = 1 GROUP BY er.id",
    "q_scored_roundtrip": f"WITH {CANDS} SELECT s1_id, cand_id, rank::INTEGER AS rank FROM c",
    "q_labels": f"WITH {CT} SELECT s1_id, cand_id, hit::INTEGER AS y FROM ch",
    "q_misses": f"WITH {CT} SELECT s1_id, cand_id AS missed_id, n AS n_true, (SELECT count(*) FROM c WHERE c.s1_id = truth.s1_id) AS n_cands FROM truth JOIN gt USING (s1_id) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.s1_id = truth.s1_id AND c.cand_id = truth.cand_id)",
    "q_misses_short": f"WITH {CT}, c2 AS (SELECT * FROM c WHERE rank < 2) SELECT s1_id, cand_id AS missed_id, n AS n_true, (SELECT count(*) FROM c2 WHERE c2.s1_id = truth.s1_id) AS n_cands FROM truth JOIN gt USING (s1_id) WHERE NOT EXISTS (SELECT 1 FROM c2 WHERE c2.s1_id = truth.s1_id AND c2.cand_id = truth.cand_id)",
    "q_summary": f"WITH {CT} SELECT count(*) AS ids, {rounded('avg((n = 0)::INTEGER)')} AS singleton_share, sum(n)::BIGINT AS pairs FROM gt",
    "q_context": f"WITH {CANDS} SELECT s1_id, cand_id, count(*) OVER r AS n_cands, {rounded('max(total) OVER r')} AS best, count(*) FILTER (total >= 2.0) OVER r AS row_n_high, count(*) FILTER (total >= 1.5) OVER r AS row_n_med, count(*) OVER d AS claims, {rounded('sum(total) OVER d')} AS cand_sum, {rounded('m')} AS cand_best, {rounded('coalesce(max(CASE WHEN total < m THEN total END) OVER d, 0)')} AS cand_next FROM (SELECT *, max(total) OVER (PARTITION BY cand_id) AS m FROM c) WINDOW r AS (PARTITION BY s1_id), d AS (PARTITION BY cand_id)",
    "q_feat_overlap": f"WITH {ATTR} SELECT s1_id, cand_id, {_overlap('n', 'nta', 'ntb')}, {_overlap('a', 'ata', 'atb')} FROM pa",
    "q_feat_numbers": f"WITH {ATTR} SELECT s1_id, cand_id, coalesce(list_sum(list_transform(na, lambda u: len(list_filter(nb, lambda v: v = u)))), 0)::DOUBLE AS num_match, coalesce((na[1] = nb[1])::DOUBLE, 0) AS num_first, (pina = pinb AND pina <> 0)::DOUBLE AS pin_eq, (pina <> 0 AND pinb <> 0)::DOUBLE AS pin_both FROM pa",
    "q_feat_lens": f"WITH {ATTR} SELECT s1_id, cand_id, (nna = nnb)::DOUBLE AS name_eq, (ana = anb)::DOUBLE AS addr_eq, {rounded(_gap('nna', 'nnb'))} AS nlen_ratio, {rounded(_gap('ana', 'anb'))} AS alen_ratio, least(len(nta), 14)::DOUBLE AS ntok_a, least(len(ntb), 14)::DOUBLE AS ntok_b, least(len(ata), 20)::DOUBLE AS atok_a, least(len(atb), 20)::DOUBLE AS atok_b, (len(ata) > 0)::DOUBLE AS has_addr_a, (len(atb) > 0)::DOUBLE AS has_addr_b, (cand_id[1:2] = 'S3')::DOUBLE AS cand_is_s3 FROM pa",
    "q_feat_lev": f"WITH {ATTR}, pb AS (SELECT s1_id, cand_id, total, replace(nna, 'ß', 'ss') AS na, replace(nnb, 'ß', 'ss') AS nb, replace(ana, 'ß', 'ss') AS aa, replace(anb, 'ß', 'ss') AS ab FROM pa) SELECT s1_id, cand_id, {rounded(_lev('na', 'nb'))} AS lev_name, {rounded(_lev('aa', 'ab'))} AS lev_addr FROM pb",
    "q_recall_at_k": f"WITH {CT}, ks AS (SELECT unnest([{', '.join(map(str, RECALL_KS))}]) AS k UNION SELECT max(rank) + 1 FROM c), kk AS (SELECT DISTINCT k FROM ks WHERE k <= (SELECT max(rank) + 1 FROM c)), per AS (SELECT k, gt.s1_id, country, gt.n, count(ch.cand_id) FILTER (rank < k) AS m, count(*) FILTER (hit AND rank < k) AS tp FROM kk CROSS JOIN gt LEFT JOIN ch ON ch.s1_id = gt.s1_id GROUP BY ALL) SELECT CASE WHEN grouping(country) = 1 THEN 'ALL' ELSE country END AS country, k::INTEGER AS k, count(*) AS ids, {rounded('sum(tp) / greatest(sum(n), 1)')} AS pair_recall, {rounded('count(*) FILTER (n > 0 AND tp = n) / greatest(count(*) FILTER (n > 0), 1)')} AS full_recall, {rounded('sum(' + f05('tp', 'tp', 'n') + ') / count(*)')} AS oracle_f05, {rounded('sum(m) / count(*)')} AS avg_cands FROM per GROUP BY GROUPING SETS ((k), (country, k))",
    "q_f05_sweep": f"WITH {CT}{SWEPT} SELECT tau, {rounded('f05')} AS f05, {rounded('prec')} AS prec, {rounded('rec')} AS rec FROM swept",
    "q_best_tau": f"WITH {CT}{SWEPT} SELECT tau, {rounded('f05')} AS f05 FROM swept ORDER BY swept.f05 DESC, tau DESC LIMIT 1",
    "q_bands": f"WITH {CT} SELECT ({BAND_SQL})::DOUBLE AS lo, count(*) AS pairs, count(*) FILTER (hit) AS true_pairs, count(*) FILTER (total / 4 >= 0.5) AS kept, {rounded('avg(total / 4)')} AS mean_prob FROM ch WHERE ({BAND_SQL}) IS NOT NULL GROUP BY 1",
    "q_cutoff_sweep": f"WITH {CT}, cuts AS (SELECT unnest([0.0, {', '.join(map(str, CUTOFFS))}]::DOUBLE[]) AS cutoff), per AS (SELECT cutoff, gt.s1_id, gt.n, count(ch.cand_id) FILTER (total >= cutoff) AS kept, count(ch.cand_id) FILTER (total >= cutoff AND total >= 1.6) AS pred, count(*) FILTER (hit AND total >= cutoff AND total >= 1.6) AS tp FROM cuts CROSS JOIN gt LEFT JOIN ch ON ch.s1_id = gt.s1_id GROUP BY ALL), o AS (SELECT cutoff, sum(kept) / greatest((SELECT count(*) FROM c), 1) AS share, avg({f05('tp', 'pred', 'n')}) AS f FROM per GROUP BY cutoff) SELECT cutoff, {rounded('share')} AS kept_share, {rounded('f')} AS f05, {rounded('f - (SELECT f FROM o WHERE cutoff = 0)')} AS delta FROM o",
    "q_prune": f"WITH {CANDS} SELECT er.id AS s1_id, coalesce(string_agg(cand_id, ',' ORDER BY rank), '') AS items FROM er LEFT JOIN (SELECT * FROM c WHERE total >= 0.8) c ON c.s1_id = er.id WHERE src = 1 GROUP BY er.id",
    "q_counts": f"WITH {CANDS} SELECT count(*) FILTER (total >= 1.6) AS predicted, (SELECT count(*) FROM er WHERE src = 1) - count(DISTINCT s1_id) FILTER (total >= 1.6) AS empty FROM c",
    "q_pair_cosine": f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, {rounded('list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))')} AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "q_char_tfidf": f"WITH {ER}, p AS (SELECT id, ' ' || strip_accents(name) || ' ' AS s FROM er), g AS (SELECT id, substr(s, i, 3) AS gram, 1 + ln(count(*)) AS tf FROM (SELECT id, s, unnest(range(1, length(s) - 1)) AS i FROM p WHERE length(s) >= 3) GROUP BY ALL), d AS (SELECT gram, count(*) AS df FROM g GROUP BY gram), w AS (SELECT id, gram, tf * (ln((1 + (SELECT count(*) FROM er)) / (1 + df)) + 1) AS w FROM g JOIN d USING (gram)) SELECT id, gram, {rounded('w / sqrt(sum(w * w) OVER (PARTITION BY id))')} AS w FROM w",
    "q_validate": f"WITH {LISTED}, ids AS (SELECT DISTINCT unnest(string_split(items, ',')) AS x FROM lines) "
    + " UNION ALL ".join([
        _rule("repeated id in a list", "SELECT s1_id AS x FROM lines WHERE len(string_split(items, ',')) <> len(list_distinct(string_split(items, ',')))"),
        _rule("S1 id in a list", "SELECT x FROM ids WHERE x LIKE 'S1-%'"),
        _rule("unknown prefix", "SELECT x FROM ids WHERE NOT regexp_matches(x, '^S[123]-')"),
        _rule("missing row", "SELECT id AS x FROM er WHERE src = 1 AND id NOT IN (SELECT s1_id FROM lines)"),
    ]),
}
