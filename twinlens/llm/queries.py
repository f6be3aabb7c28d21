"""The queries of the training-data operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.session import table
from twinlens.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from twinlens.llm.minmax import near_candidates

    return near_candidates(table(spark, d, "candidates"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    from twinlens.llm.minmax import candidate_classes

    return candidate_classes(table(spark, d, "candidates"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from twinlens.llm.ledger import hit_ledger

    return hit_ledger(table(spark, d, "hits")).copies()


def p2_copies(spark: SparkSession, d: str) -> DataFrame:
    from twinlens.llm.ledger import hit_ledger

    return hit_ledger(table(spark, d, "hits")).representatives()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    # written whole: of a mere projection Catalyst would prune the values of pages and labels
    return Workspace(spark, "p3").save(p3_records(spark, d), "records").select("card_key", "representative_cid", "url_cid")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    from twinlens.llm.survivor import surviving_records

    return surviving_records(table(spark, d, "cards"), table(spark, d, "candidates"))


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    from twinlens.llm.survivor import Survivors

    return Survivors(table(spark, d, "cards"), table(spark, d, "candidates")).true_values()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from twinlens.llm.groups import candidate_groups

    linked = candidate_groups(table(spark, d, "match_pairs"), table(spark, d, "cards"))
    return linked.where("group_cid < cid")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    from twinlens.llm.groups import candidate_groups

    linked = candidate_groups(table(spark, d, "match_pairs"), table(spark, d, "cards"))
    return linked.groupBy("group_cid").agg(F.count("*").alias("members"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from twinlens.llm.vptree import neighbour_pairs

    return neighbour_pairs(table(spark, d, "descriptors"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    from twinlens.llm.bpe import encode_column

    return encode_column(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    from twinlens.llm.packing import pack_documents

    return pack_documents(table(spark, d, "documents"))


def p7_audit(spark: SparkSession, d: str) -> DataFrame:
    from twinlens.llm.bpe import count_tokens
    from twinlens.llm.packing import audit_containers, fill_containers

    ws = Workspace(spark, "audit")
    sizes = ws.save(count_tokens(table(spark, d, "documents")), "sizes")
    return audit_containers(sizes, ws.save(fill_containers(sizes), "placed"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from twinlens.llm.spans import shared_share

    return shared_share(table(spark, d, "documents")).where("2 * shared_chars >= chars").select("doc_id")


def p8_shared(spark: SparkSession, d: str) -> DataFrame:
    from twinlens.llm.spans import shared_share

    return shared_share(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p2_copies": p2_copies,
    "p3_found": p3_found,
    "p3_records": p3_records,
    "p3_values": p3_values,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p7_audit": p7_audit,
    "p8_found": p8_found,
    "p8_shared": p8_shared,
}

_PRINTS = r"""
texts AS (SELECT cid, unnest(['p', 'd', 'w', 'a']) AS h, unnest([phash, dhash, whash, ahash]) AS t FROM candidates),
digits AS (SELECT cid, h, regexp_extract(regexp_replace(lower(t), '[\s\p{Z}\p{Cc}\p{Cf}:_\-''"]+', '', 'g'), '^(?:0x)?0*([0-9a-f]{1,16})$', 1) AS x FROM texts),
numbers AS (SELECT cid, h, CAST('0x' || x AS UBIGINT) AS v FROM digits WHERE x <> ''),
prints AS (SELECT cid, max(v) FILTER (h = 'p') AS p, max(v) FILTER (h = 'd') AS d, max(v) FILTER (h = 'w') AS w, max(v) FILTER (h = 'a') AS a
  FROM numbers GROUP BY cid HAVING count(*) = 4)
"""

_NEAR = "45 * CAST(bit_count(xor(x.p, y.p)) AS INT) + 25 * CAST(bit_count(xor(x.d, y.d)) AS INT) + 20 * CAST(bit_count(xor(x.w, y.w)) AS INT) + 10 * CAST(bit_count(xor(x.a, y.a)) AS INT) <= 640"

_RANKED = """
members AS (SELECT DISTINCT card_key, unnest(member_cids) AS cid FROM cards),
counted AS (SELECT card_key, count(*) AS n FROM members WHERE cid IS NOT NULL GROUP BY card_key),
ranked AS (
  SELECT m.card_key, c.cid, c.url, c.width, c.height, row_number() OVER (PARTITION BY m.card_key, c.url IS NOT NULL AND c.url <> '' ORDER BY o) AS rank_url,
    row_number() OVER (PARTITION BY m.card_key ORDER BY o) AS rank
  FROM members m JOIN counted n ON n.card_key = m.card_key AND n.n >= 2
  JOIN (SELECT *, (-(CAST(width AS BIGINT) * height), coalesce(-epoch_us(fetched_at), 9223372036854775807), cid) AS o FROM candidates) c
    ON c.cid = m.cid AND c.error IS NULL AND c.width > 0 AND c.height > 0)
"""

def _em_sql(rounds: int) -> str:
    """The latent truth model, a pair of tables a round."""
    from twinlens.llm import survivor as S

    (sa, sb), (fa, fb), (ta, tb) = S.PRIOR_SENSITIVITY, S.PRIOR_FALSE_POSITIVE, S.PRIOR_TRUTH
    out = """
usable AS (SELECT DISTINCT m.card_key, c.* FROM (SELECT DISTINCT card_key, unnest(member_cids) AS cid FROM cards WHERE card_key IS NOT NULL) m
  JOIN candidates c ON c.cid = m.cid AND c.error IS NULL AND c.width > 0 AND c.height > 0),
stated AS (SELECT DISTINCT card_key, engine, unnest(['page_url', 'engine_label']) AS field, unnest([page_url, engine_label]) AS value FROM usable WHERE engine IS NOT NULL),
valued AS (SELECT card_key, field, value, list_sort(list(DISTINCT engine)) AS states FROM stated WHERE value <> '' GROUP BY ALL),
known AS (SELECT card_key, list_sort(list(DISTINCT engine)) AS knows FROM stated GROUP BY card_key),
claims AS (SELECT card_key, field, value, knows, states FROM valued JOIN known USING (card_key)),
patterns AS MATERIALIZED (SELECT field, knows, states, count(*) AS n FROM claims GROUP BY ALL),
each_source AS MATERIALIZED (SELECT field, knows, states, n, source, list_contains(states, source)::INT AS s FROM (SELECT *, unnest(knows) AS source FROM patterns)),
"""
    out += f"q0 AS (SELECT DISTINCT field, source, {S.START['sensitivity']}::DOUBLE AS a, {S.START['false_positive']}::DOUBLE AS b, {S.START['truth']}::DOUBLE AS truth FROM each_source)"
    for r in range(1, rounds + 1):
        out += f""",
p{r} AS MATERIALIZED (SELECT e.field, knows, states, any_value(n) AS n,
  1 / (1 + exp(-(ln(any_value(truth) / (1 - any_value(truth))) + sum(CASE s WHEN 1 THEN ln(a / b) ELSE ln((1 - a) / (1 - b)) END)))) AS p
  FROM each_source e JOIN q{r - 1} q ON q.field = e.field AND q.source = e.source GROUP BY e.field, knows, states),
t{r} AS (SELECT field, (sum(n * p) + {ta}) / (sum(n) + {ta + tb}) AS truth FROM p{r} GROUP BY field),
q{r} AS MATERIALIZED (SELECT e.field, source, (sum(e.n * p * s) + {sa}) / (sum(e.n * p) + {sa + sb}) AS a, (sum(e.n * (1 - p) * s) + {fa}) / (sum(e.n * (1 - p)) + {fa + fb}) AS b, any_value(t.truth) AS truth
  FROM each_source e JOIN p{r} USING (field, knows, states) JOIN t{r} t ON t.field = e.field GROUP BY e.field, source)"""
    return out + f""",
judged AS (SELECT e.field, knows, states, 1 / (1 + exp(-(ln(any_value(truth) / (1 - any_value(truth))) + sum(CASE s WHEN 1 THEN ln(a / b) ELSE ln((1 - a) / (1 - b)) END)))) AS p
  FROM each_source e JOIN q{rounds} q ON q.field = e.field AND q.source = e.source GROUP BY e.field, knows, states),
true_values AS (SELECT card_key, field, value FROM claims JOIN judged USING (field, knows, states) WHERE p >= 0.5)
"""


_NEIGHBOURS = """
good AS (SELECT vec_id, backend, list_transform(vector, lambda x: CAST(x AS DOUBLE)) AS v FROM descriptors
  WHERE len(vector) = CASE backend WHEN 'classical-descriptor' THEN 368 WHEN 'clip:ViT-B-32' THEN 512 END
    AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
unit AS (SELECT vec_id, backend, v, sqrt(list_inner_product(v, v)) AS n FROM good),
scored AS (SELECT x.vec_id AS a, y.vec_id AS b, round(list_inner_product(x.v, y.v) / (x.n * y.n), 6) AS c
  FROM unit x JOIN unit y ON x.backend = y.backend AND x.vec_id <> y.vec_id),
top AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM scored WHERE c >= 0.8)
"""

_COPIES = r"""
raw AS (SELECT DISTINCT unnest([url, page_url]) AS u FROM hits),
c0 AS (SELECT u, lower(regexp_replace(u, '[\s\p{Z}\p{Cc}\p{Cf}]+', '', 'g')) AS c FROM raw WHERE u IS NOT NULL),
c1 AS (SELECT u, replace(replace(replace(replace(replace(c, '\/', '/'), chr(92) || 'u0026', '&'), chr(92) || 'u003d', '='), '&amp;', '&'), '&#38;', '&') AS c FROM c0),
c2 AS (SELECT u, regexp_replace(c, '^[<("''\[{]*(url:)?[<("''\[{]*', '') AS c FROM c1),
c3 AS (SELECT u, CASE WHEN contains(c, '(') THEN regexp_replace(c, '[>\]}"'',;.#?&]+$', '') ELSE regexp_replace(c, '[>)\]}"'',;.#?&]+$', '') END AS c FROM c2),
c4 AS (SELECT u, regexp_extract(c, '^([a-z][a-z0-9+.\-]*):', 1) AS scheme, regexp_extract(c, '#(.*)$', 1) AS fragment,
  regexp_replace(regexp_extract(c, '^([^#]*)', 1), '^([a-z][a-z0-9+.\-]*:)?/*', '') AS rest FROM c3),
c5 AS (SELECT *, regexp_extract(rest, '^([^?]*)', 1) AS main, regexp_extract(rest, '\?(.*)$', 1) AS query FROM c4),
c6 AS (SELECT u, scheme, fragment, regexp_extract(main, '^[^/]*(.*)$', 1) AS path, query,
  regexp_replace(regexp_replace(regexp_extract(main, '^([^/]*)', 1), CASE scheme WHEN 'http' THEN ':0*80$' WHEN 'https' THEN ':0*443$' ELSE ':$' END, ''), '\.+$', '') AS host FROM c5),
canon AS (SELECT u, concat(scheme, '://', host, '|',
  array_to_string(list_transform(list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.'), lambda x: lower(url_decode(x))), '|/'), '|?',
  array_to_string(list_sort(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: lower(url_decode(replace(x, '+', '%20'))))), '|&'), '|#',
  lower(url_decode(fragment))) AS k FROM c6),
first_of AS (SELECT h.seq, a.k AS a, coalesce(b.k, '') AS b, min(h.seq) OVER (PARTITION BY a.k, coalesce(b.k, '')) AS first_seq
  FROM (SELECT DISTINCT seq, url, nullif(page_url, '') AS page_url FROM hits WHERE url IS NOT NULL) h JOIN canon a ON a.u = h.url LEFT JOIN canon b ON b.u = h.page_url)
"""

_GROUPS = """
links AS (
  SELECT cid_a AS a, cid_b AS b FROM match_pairs WHERE is_match AND cid_a IS NOT NULL AND cid_b IS NOT NULL
  UNION SELECT list_min(member_cids), unnest(member_cids) FROM cards),
both_ways AS (SELECT a, b FROM links WHERE b IS NOT NULL UNION SELECT b, a FROM links WHERE b IS NOT NULL),
walk(root, cid) AS (
  SELECT a, a FROM both_ways
  UNION
  SELECT w.root, e.b FROM walk w JOIN both_ways e ON w.cid = e.a WHERE e.b > w.root),
linked AS (SELECT cid, min(root) AS group_cid FROM walk GROUP BY cid),
grouped AS (SELECT group_cid, cid FROM linked)
"""

_SHARED = """
windows AS (SELECT doc_id, n, i, md5(substr(text, i, 200)) AS w
  FROM (SELECT doc_id, text, length(text) AS n, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
many AS (SELECT w FROM windows GROUP BY w HAVING min(doc_id) <> max(doc_id)),
hits AS (SELECT doc_id, n, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM windows WHERE w IN (SELECT w FROM many)),
shared AS (SELECT doc_id, CAST(max(n) AS BIGINT) AS chars, CAST(sum(CASE WHEN before IS NULL THEN 200 ELSE least(200, i - before) END) AS BIGINT) AS shared_chars FROM hits GROUP BY doc_id)
"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_PRINTS} SELECT x.cid AS cid_a, y.cid AS cid_b FROM prints x JOIN prints y ON x.cid < y.cid WHERE {_NEAR}",
    "p1_classes": f"""WITH {_PRINTS}, classes AS (SELECT p, d, w, a, min(cid) AS class_cid, count(*) AS records FROM prints GROUP BY p, d, w, a)
        SELECT x.class_cid, x.records, count(y.class_cid) AS links FROM classes x LEFT JOIN classes y ON x.class_cid <> y.class_cid AND {_NEAR}
        GROUP BY x.class_cid, x.records""",
    "p3_found": f"""WITH {_RANKED} SELECT r.card_key, r.cid AS representative_cid, coalesce(u.cid, '') AS url_cid FROM ranked r
        LEFT JOIN ranked u ON u.card_key = r.card_key AND u.rank_url = 1 AND u.url <> '' WHERE r.rank = 1""",
    "p3_records": f"""WITH {_RANKED}, {_em_sql(10)}, v AS (SELECT card_key, count(*) FILTER (field = 'page_url') AS pages, min(value) FILTER (field = 'page_url') AS first_page,
        count(*) FILTER (field = 'engine_label') AS labels, min(value) FILTER (field = 'engine_label') AS first_label FROM true_values GROUP BY card_key)
        SELECT r.card_key, r.cid AS representative_cid, r.width AS best_width, r.height AS best_height, coalesce(u.cid, '') AS url_cid, u.url AS best_url, n.n AS members,
        coalesce(pages, 0) AS pages, first_page, coalesce(labels, 0) AS labels, first_label FROM ranked r JOIN counted n ON n.card_key = r.card_key
        LEFT JOIN ranked u ON u.card_key = r.card_key AND u.rank_url = 1 AND u.url <> '' LEFT JOIN v ON v.card_key = r.card_key WHERE r.rank = 1""",
    "p3_values": f"WITH {_em_sql(10)} SELECT card_key, field, value FROM true_values",
    "p5_found": f"WITH {_NEIGHBOURS} SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM top WHERE r <= 10",
    "p2_found": f"WITH {_COPIES} SELECT first_seq, seq FROM first_of WHERE seq > first_seq",
    "p2_copies": f"WITH {_COPIES} SELECT first_seq, count(*) AS copies FROM first_of GROUP BY first_seq",
    "p4_found": f"WITH RECURSIVE {_GROUPS} SELECT group_cid, cid FROM grouped WHERE group_cid < cid",
    "p4_groups": f"WITH RECURSIVE {_GROUPS} SELECT group_cid, count(*) AS members FROM grouped GROUP BY group_cid HAVING count(*) > 1",
    "p7_audit": """SELECT count(*) AS documents, 0::BIGINT AS not_whole, 0::BIGINT AS needless_splits, 0::BIGINT AS over_capacity, 0::BIGINT AS gaps,
        0::BIGINT AS unnumbered, true AS filled FROM documents WHERE text <> ''""",
    "p8_found": f"WITH {_SHARED} SELECT doc_id FROM shared WHERE 2 * shared_chars >= chars",
    "p8_shared": f"WITH {_SHARED} SELECT doc_id, chars, shared_chars FROM shared",
}
