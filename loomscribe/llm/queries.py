"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from loomscribe.functions.urls import LEGAL_FORMS
from loomscribe.llm import abuse, mixing, packing, pairs, sampling, spans, splits, truncation

QUERIES = {
    "p1_found": splits.p1_found,
    "p1_splits": splits.p1_splits,
    "p1_report": splits.p1_report,
    "p2_found": truncation.p2_found,
    "p2_report": truncation.p2_report,
    "p3_found": pairs.p3_found,
    "p3_report": pairs.p3_report,
    "p3_model": pairs.p3_model,
    "p3_cutoffs": pairs.p3_cutoffs,
    "p4_found": spans.p4_found,
    "p4_spans": spans.p4_spans,
    "p4_report": spans.p4_report,
    "p5_found": sampling.p5_found,
    "p5_sample": sampling.p5_sample,
    "p5_report": sampling.p5_report,
    "p6_found": packing.p6_found,
    "p6_windows": packing.p6_windows,
    "p6_report": packing.p6_report,
    "p7_found": mixing.p7_found,
    "p7_mixture": mixing.p7_mixture,
    "p7_report": mixing.p7_report,
    "p8_found": abuse.p8_found,
    "p8_scores": abuse.p8_scores,
    "p8_reliability": abuse.p8_reliability,
    "p8_report": abuse.p8_report,
}

_LABEL = r"regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '[\s-]+', '_', 'g')"

_HOST = (
    r"rtrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(domain, '\s+', '', 'g')), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^.*@', ''), ':[0-9]*$', ''), '.')"
)
_SITE = f"nullif(array_to_string(string_split({_HOST}, '.')[-2:], '.'), '')"
_COMPANY = (
    r"nullif(replace(regexp_replace(trim(regexp_replace(lower(regexp_replace(company, '[.''’]', '', 'g')), '[^\p{L}\p{N}]+', ' ', 'g')), '(?: (?:"
    + "|".join(LEGAL_FORMS)
    + r"))+$', ''), ' ', ''), '')"
)

_SPANS = r"""
WITH t AS (SELECT call_id, text FROM mirrors UNION ALL SELECT call_id, rewritten_text FROM rewrites),
w AS (SELECT DISTINCT call_id, md5(text) AS tid, list_filter(string_split_regex(text, '[\s\p{Z}\x1c-\x1f\x0b\x85]+'), lambda x: x <> '') AS w FROM t WHERE text IS NOT NULL),
g AS (SELECT call_id, tid, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT call_id, tid, w, unnest(generate_series(1, len(w) - 49)) AS i FROM w WHERE len(w) >= 50)),
s AS (SELECT h FROM g GROUP BY 1 HAVING min(call_id) <> max(call_id)),
k AS (SELECT call_id, tid, i, i - lag(i) OVER (PARTITION BY call_id, tid ORDER BY i) AS gap FROM g WHERE h IN (SELECT h FROM s)),
f AS (SELECT call_id, tid, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY call_id, tid ORDER BY i) AS span FROM k),
m AS (SELECT call_id, tid, min(i) AS a, max(i) + 49 AS b FROM f GROUP BY call_id, tid, span)"""

ORACLE = {
    "p4_spans": _SPANS + " SELECT DISTINCT call_id, a - 1 AS start_word, b - a + 1 AS n_words, array_to_string(w[a:b], ' ') AS span FROM m JOIN w USING (call_id, tid)",
    "p4_report": _SPANS + """, n AS (SELECT call_id, tid, sum(b - a + 1) AS shared, count(*) AS spans FROM m GROUP BY 1, 2)
SELECT call_id, sum(len(w)) AS n_words, coalesce(sum(shared), 0) AS shared_words, coalesce(sum(spans), 0) AS n_spans, round(coalesce(coalesce(sum(shared), 0)::DOUBLE / nullif(sum(len(w)), 0), 0), 6) AS share
FROM w LEFT JOIN n USING (call_id, tid) GROUP BY 1""",
    "p1_found": f"""
WITH RECURSIVE c AS (SELECT DISTINCT {_SITE} AS site, {_COMPANY} AS k FROM site_frame),
r(a, b) AS (SELECT DISTINCT site, site FROM c WHERE site IS NOT NULL UNION SELECT r.a, y.site FROM r JOIN c x ON x.site = r.b JOIN c y ON y.k = x.k WHERE y.site IS NOT NULL),
o AS (SELECT a AS site, min(b) AS owner FROM r GROUP BY 1),
l AS (SELECT doc_id, min({_SITE}) AS site FROM (SELECT doc_id, domain FROM splits UNION ALL SELECT doc_id, domain FROM features_encoded UNION ALL SELECT doc_id, domain FROM story_human_frozen UNION ALL SELECT doc_id, domain FROM mirrors) WHERE doc_id IS NOT NULL GROUP BY 1),
p AS (SELECT s.doc_id, CASE WHEN {_LABEL.format('doc_split')} IN ('train', 'val', 'test') THEN {_LABEL.format('doc_split')} END AS split, coalesce(o.owner, l.site, 'd:' || s.doc_id) AS owner FROM splits s JOIN l USING (doc_id) LEFT JOIN o USING (site))
SELECT DISTINCT doc_id FROM p WHERE owner IN (SELECT owner FROM p GROUP BY 1 HAVING count(DISTINCT split) > 1)""",
    "p4_found": r"""
WITH t AS (SELECT call_id, text FROM mirrors UNION ALL SELECT call_id, rewritten_text FROM rewrites),
w AS (SELECT DISTINCT call_id, list_filter(string_split_regex(text, '[\s\p{Z}\x1c-\x1f\x0b\x85]+'), lambda x: x <> '') AS w FROM t WHERE text IS NOT NULL),
g AS (SELECT call_id, unnest(list_transform(generate_series(1, len(w) - 49), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h FROM w WHERE len(w) >= 50),
s AS (SELECT h FROM g GROUP BY 1 HAVING min(call_id) <> max(call_id))
SELECT DISTINCT call_id FROM g WHERE h IN (SELECT h FROM s)""",
    "p5_found": f"""
WITH r AS (
  SELECT doc_id, {_LABEL.format('stratum')} AS s, {_LABEL.format('vertical')} AS v0,
         coalesce(regexp_matches(story_human, '[^\\s ]'), false) AS ok
  FROM story_human_frozen),
m AS (SELECT doc_id, ok, s, CASE v0 WHEN 'saas' THEN 'software_saas' WHEN 'ecommerce' THEN 'ecommerce_retail'
             WHEN 'fintech' THEN 'fintech_insurance' WHEN 'other' THEN 'services_other' ELSE v0 END AS v FROM r),
k AS (SELECT doc_id, ok,
        CASE WHEN s IN ('funded_directory','growth_list','listed_large','review_site') THEN s END AS s,
        CASE WHEN v IN ('software_saas','ecommerce_retail','fintech_insurance','healthcare_life','industrial_logistics','media_education','services_other') THEN v END AS v
      FROM m),
p AS (SELECT doc_id, min(s) AS s, min(v) AS v FROM k GROUP BY doc_id HAVING bool_or(ok) AND min(s) IS NOT NULL AND min(v) IS NOT NULL),
n AS (SELECT count(*) // 5 AS n FROM p),
c AS (SELECT s, v, count(*) AS have FROM p GROUP BY s, v)
SELECT t.stratum, t.vertical
FROM sample_targets t CROSS JOIN n LEFT JOIN c ON c.s = t.stratum AND c.v = t.vertical
WHERE coalesce(c.have, 0) < greatest((t.target_permille * n.n + 999) // 1000, t.min_docs)""",
}
