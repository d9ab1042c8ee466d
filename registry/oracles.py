"""SQL (DuckDB) that gives the same rows as the queries of the same name."""

from __future__ import annotations

from string import Formatter

from addrloom import vocab
from addrloom.models.pair_scorer import DEFAULT_WEIGHTS
from addrloom.models.tagger import LEVEL_WORDS
from addrloom.plans.evaluation import DIFFERENCES, DISTRACTOR_FORMS, SAME_PLACE_FORMS
from registry.views import TEXT_DIM, TOKEN_LABELS

ORACLES: dict[str, str] = {}

E, P, N = vocab.STATUSES
BLANK = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{BLANK}|{BLANK}$', '', 'g')"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts if p) + "\n"


def status(e: str, p: str, n: str) -> str:
    return f"CASE WHEN {e} >= greatest({p}, {n}) THEN '{E}' WHEN {p} >= {n} THEN '{P}' ELSE '{N}' END"


# -- nearest neighbours -------------------------------------------------------------

def knn(q: str, r: str, top_n: int, threshold: float | None = None, dim: int = 64) -> str:
    """CTE ``found`` with the exact top_n of each q row among r."""
    cut = "" if threshold is None else f" AND similarity >= {threshold}"
    return f"""
pairs AS (
  SELECT q.enterprise_id, q.enterprise_name, q.enterprise_address, r.standard_id, r.standard_address, r.room_no,
         1 - pow(array_distance(q.v, r.v), 2) / 2.0 AS similarity
  FROM {q} q, {r} r
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY enterprise_id ORDER BY round(similarity, 12) DESC, standard_id) AS rn FROM pairs
), found AS (
  SELECT enterprise_id, enterprise_name, enterprise_address, standard_id, standard_address, room_no, similarity
  FROM ranked WHERE rn <= {top_n}{cut}
)"""


EMBED_SIDES = """
q AS (SELECT vec_id::VARCHAR AS enterprise_id, 'E' || vec_id AS enterprise_name, 'label ' || label AS enterprise_address,
             embedding::DOUBLE[]::DOUBLE[64] AS v FROM embeddings),
r AS (SELECT vec_id::VARCHAR AS standard_id, 'label ' || label AS standard_address, 'R' || label AS room_no,
             embedding::DOUBLE[]::DOUBLE[64] AS v FROM embeddings)"""

ROUND_SIMILARITY = "SELECT * REPLACE (round(similarity, 6) AS similarity) FROM found"
ORACLES["knn_topn"] = with_(EMBED_SIDES, knn("q", "r", 5)) + ROUND_SIMILARITY
ORACLES["knn_threshold"] = with_(EMBED_SIDES, knn("q", "r", 5, 0.3)) + ROUND_SIMILARITY
ORACLES["knn_cells"] = ORACLES["knn_threshold"]
ORACLES["knn_axes"] = ORACLES["knn_topn"]
ORACLES["knn_ivf_all_lists"] = ORACLES["knn_topn"]
ORACLES["knn_single"] = with_(EMBED_SIDES) + """
SELECT standard_id AS source_id, standard_address AS address, room_no,
       round(1 - pow(array_distance(v, (SELECT v FROM q ORDER BY enterprise_id::BIGINT LIMIT 1)), 2) / 2.0, 6) AS similarity
FROM r ORDER BY round(pow(array_distance(v, (SELECT v FROM q ORDER BY enterprise_id::BIGINT LIMIT 1)), 2), 12), standard_id LIMIT 10"""

# centres: the 16 vectors with the smallest ids; a row is in the list of its nearest centre, a
# query probes the 4 nearest lists that have rows
IVF = """
centres AS (SELECT row_number() OVER (ORDER BY standard_id::BIGINT) - 1 AS list_id, v FROM r ORDER BY standard_id::BIGINT LIMIT 16),
listed AS (
  SELECT r.*, arg_min(c.list_id, (pow(array_distance(r.v, c.v), 2), c.list_id)) AS list_id
  FROM r, centres c GROUP BY ALL),
probed AS (
  SELECT enterprise_id, list_id FROM (
    SELECT enterprise_id, c.list_id, row_number() OVER (PARTITION BY enterprise_id ORDER BY array_distance(q.v, c.v), c.list_id) AS rn
    FROM q, centres c WHERE c.list_id IN (SELECT list_id FROM listed)) WHERE rn <= 4),
near AS (
  SELECT q.enterprise_id, q.enterprise_name, q.enterprise_address, l.standard_id, l.standard_address, l.room_no,
         1 - pow(array_distance(q.v, l.v), 2) / 2.0 AS similarity
  FROM q JOIN probed USING (enterprise_id) JOIN listed l USING (list_id)),
ivf AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY enterprise_id ORDER BY round(similarity, 12) DESC, standard_id) AS rn FROM near)
  WHERE rn <= 5)"""
ORACLES["knn_ivf"] = with_(EMBED_SIDES, IVF) + "SELECT * REPLACE (round(similarity, 6) AS similarity) FROM ivf"
ORACLES["knn_ivf_recall"] = with_(EMBED_SIDES, IVF, knn("q", "r", 5)) + """
SELECT count(*) AS true_pairs, count(i.standard_id) AS found_pairs, round(count(i.standard_id) / count(*), 6) AS recall
FROM found f LEFT JOIN ivf i USING (enterprise_id, standard_id)"""

# a tree: the 64 vectors after the first 8 lie under the nearest of these; a row goes down by the nearest
# child, a query keeps the nearest tops until those before hold 8 x 3 lists with rows, then the 3 nearest lists
TREE = """
given AS (SELECT row_number() OVER (ORDER BY standard_id::BIGINT) - 1 AS g, v FROM r ORDER BY standard_id::BIGINT LIMIT 72),
lists AS (
  SELECT b.g, b.v, arg_min(t.g, (pow(array_distance(b.v, t.v), 2), t.g)) AS top
  FROM given b, given t WHERE b.g >= 8 AND t.g < 8 GROUP BY ALL),
tops AS (SELECT g AS top, v FROM given WHERE g IN (SELECT top FROM lists)),
below_top AS (SELECT r.standard_id, arg_min(t.top, (pow(array_distance(r.v, t.v), 2), t.top)) AS top FROM r, tops t GROUP BY ALL),
listed AS (
  SELECT r.*, arg_min(c.g, (pow(array_distance(r.v, c.v), 2), c.g)) AS list_id
  FROM r JOIN below_top USING (standard_id) JOIN lists c USING (top) GROUP BY ALL),
filled AS (SELECT * FROM lists WHERE g IN (SELECT list_id FROM listed)),
kept AS (
  SELECT enterprise_id, top FROM (
    SELECT q.enterprise_id, t.top, coalesce(sum(n) OVER (PARTITION BY enterprise_id ORDER BY array_distance(q.v, t.v), t.top
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM q, tops t JOIN (SELECT top, count(*) AS n FROM filled GROUP BY top) USING (top)) WHERE before < 24),
probed AS (
  SELECT enterprise_id, g AS list_id FROM (
    SELECT enterprise_id, f.g, row_number() OVER (PARTITION BY enterprise_id ORDER BY array_distance(q.v, f.v), f.top, f.g) AS rn
    FROM q JOIN kept USING (enterprise_id) JOIN filled f USING (top)) WHERE rn <= 3),
""" + IVF[IVF.index("near AS ("):]
ORACLES["knn_ivf_tree"] = with_(EMBED_SIDES, TREE) + "SELECT * REPLACE (round(similarity, 6) AS similarity) FROM ivf"
ORACLES["knn_ivf_tree_all_lists"] = ORACLES["knn_topn"]

# -- recall rows ----------------------------------------------------------------------

RECALL = """
recall AS (
  SELECT l_orderkey::VARCHAR AS enterprise_id, 'order ' || l_orderkey AS enterprise_name,
         'address of ' || l_orderkey AS enterprise_address,
         l_partkey || '-' || l_suppkey || '-' || l_linenumber AS standard_id,
         'part ' || l_partkey || ' supplier ' || l_suppkey AS standard_address,
         l_returnflag AS room_no, l_quantity / 50.0 AS similarity
  FROM lineitem
)"""
ORACLES["recall_regroup"] = with_(RECALL) + """
SELECT enterprise_id, min(enterprise_name) AS enterprise_name, min(enterprise_address) AS enterprise_address,
       count(*) AS candidate_count,
       string_agg(standard_id || '|' || standard_address || '|' || room_no || '|' || round(similarity * 50)::INT, ','
                  ORDER BY similarity DESC, standard_id) AS candidates
FROM recall GROUP BY enterprise_id"""
ORACLES["recall_regroup_top"] = with_(RECALL) + """
SELECT enterprise_id, min(enterprise_name) AS enterprise_name, min(enterprise_address) AS enterprise_address,
       count(*) AS candidate_count, string_agg(standard_id, ',' ORDER BY similarity DESC, standard_id) AS candidates
FROM (SELECT *, row_number() OVER (PARTITION BY enterprise_id ORDER BY similarity DESC, standard_id) AS rn FROM recall)
WHERE rn <= 3 GROUP BY enterprise_id"""
ORACLES["recall_flatten"] = with_(RECALL) + "SELECT * FROM recall"
ORACLES["recall_summary"] = with_(RECALL) + """
SELECT count(DISTINCT enterprise_id) AS enterprise_count, count(*) AS recall_count, count(standard_id) AS candidate_count FROM recall"""
RECALL_WHERE = """(enterprise_name LIKE '%part 1_ %' OR enterprise_address LIKE '%part 1_ %' OR standard_address LIKE '%part 1_ %')
  AND similarity >= 0.2 AND similarity <= 0.9"""
ORACLES["recall_filter"] = with_(RECALL) + f"SELECT * FROM recall WHERE {RECALL_WHERE}"
ORACLES["recall_filter_count"] = with_(RECALL) + f"""
SELECT count(*) AS total_count, greatest(ceil(count(*) / 20.0), 1)::BIGINT AS page_count, 41::BIGINT AS first_row,
       least(count(*), 60)::BIGINT AS last_row FROM recall WHERE {RECALL_WHERE}"""
ORACLES["recall_page"] = with_(RECALL) + """
SELECT * FROM recall WHERE similarity >= 0.5 ORDER BY enterprise_id, similarity DESC, standard_id LIMIT 20 OFFSET 40"""
ORACLES["recall_by_ids"] = with_(RECALL) + """
SELECT * FROM recall WHERE enterprise_id IN (SELECT c_custkey::VARCHAR FROM customer)"""
ORACLES["replace_versions"] = with_(RECALL) + """
SELECT * REPLACE (CASE WHEN room_no = 'R' THEN 1.0 ELSE similarity END AS similarity), 1 AS versions
FROM recall WHERE room_no <> 'R' OR similarity >= 0.5"""
ORACLES["recall_sink_rows"] = with_(RECALL) + """
SELECT * REPLACE (coalesce(nullif(room_no, 'N'), '') AS room_no) FROM recall"""

# -- ranking ----------------------------------------------------------------------------

ROUNDED_ORDER = "round_even(exact_match, 2) DESC, round_even(partial_match, 2) DESC, round_even(not_match, 2)"
RAW_ORDER = "exact_match DESC, not_match"
NO_CANDIDATE = f"""
         CASE WHEN usable THEN standard_id END AS address_id,
         CASE WHEN usable THEN standard_address END AS standard_address,
         CASE WHEN usable THEN coalesce(room_no, '') ELSE '' END AS room_no,
         CASE WHEN usable THEN partial_match ELSE 0.0 END AS partial_match,
         CASE WHEN usable THEN exact_match ELSE 0.0 END AS exact_match,
         CASE WHEN usable THEN not_match ELSE 1.0 END AS not_match,
         CASE WHEN usable THEN {status('exact_match', 'partial_match', 'not_match')} ELSE '{N}' END AS match_status,
         '{vocab.SOURCE_AUTO}' AS correction_source"""
ORDERS = """
everyone AS (SELECT o_orderkey::VARCHAR AS enterprise_id, 'order ' || o_orderkey AS enterprise_name,
                    'address of ' || o_orderkey AS enterprise_address FROM orders)"""


def similarity_scores(source: str) -> str:
    return f"""
logits AS (SELECT *, similarity * -4.0 + 4.0 AS zn, similarity * 0.0 + 2.75 AS zp, similarity * 8.0 + 0.0 AS ze FROM {source}),
shifted AS (SELECT *, exp(zn - greatest(zn, zp, ze)) AS xn, exp(zp - greatest(zn, zp, ze)) AS xp,
                   exp(ze - greatest(zn, zp, ze)) AS xe FROM logits),
scored AS (SELECT *, xn / (xn + xp + xe) AS not_match, xp / (xn + xp + xe) AS partial_match,
                  xe / (xn + xp + xe) AS exact_match FROM shifted)"""


def best(order: str, threshold: float, everyone: bool, source: str = "scored") -> str:
    usable = "TRUE" if threshold <= 0 else f"coalesce(similarity, 1.0) >= {threshold}"
    first = f"""
chosen AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY enterprise_id ORDER BY ok DESC, {order}, similarity DESC, standard_id) AS rn
    FROM (SELECT *, {usable} AS ok FROM {source})
  ) WHERE rn = 1
)"""
    if everyone:
        return first + f""",
matches AS (
  SELECT e.enterprise_id, e.enterprise_name, e.enterprise_address, {NO_CANDIDATE}
  FROM everyone e LEFT JOIN (SELECT * EXCLUDE (enterprise_name, enterprise_address), ok AS usable FROM chosen) c USING (enterprise_id)
)"""
    return first + f""",
matches AS (SELECT enterprise_id, enterprise_name, enterprise_address, {NO_CANDIDATE} FROM (SELECT *, ok AS usable FROM chosen))"""


def rounded(source: str = "matches", where: str = "") -> str:
    return f"""SELECT * REPLACE (round(exact_match, 6) AS exact_match, round(partial_match, 6) AS partial_match,
       round(not_match, 6) AS not_match) FROM {source} {where}"""


SCORED = similarity_scores("recall")
ORACLES["rank_rounded"] = with_(RECALL, SCORED, best(ROUNDED_ORDER, 0, False)) + rounded()
ORACLES["rank_raw"] = with_(RECALL, SCORED, best(RAW_ORDER, 0, False)) + rounded()
ORACLES["rank_threshold"] = with_(RECALL, SCORED, best(ROUNDED_ORDER, 0.8, False)) + rounded()
KEPT = (RECALL, SCORED, ORDERS, best(ROUNDED_ORDER, 0.5, True))
ORACLES["rank_keep_unmatched"] = with_(*KEPT) + rounded()
ORACLES["candidate_threshold"] = with_(RECALL) + "SELECT * FROM recall WHERE coalesce(similarity, 1.0) >= 0.8"
ORACLES["status_argmax"] = f"""
SELECT {status('l_discount', 'l_tax', 'l_quantity / 500')} AS match_status, l_discount, l_tax, count(*) AS n
FROM lineitem GROUP BY ALL"""
ORACLES["round_half_even"] = "SELECT round_even(l_quantity / 8, 2)::DOUBLE AS rounded, count(*) AS n FROM lineitem GROUP BY 1"
ORACLES["class_names"] = """
SELECT CASE event_id % 4 WHEN 0 THEN 'not_match' WHEN 1 THEN 'partial_match' WHEN 2 THEN 'exact_match' END AS class_name,
       count(*) AS n FROM events GROUP BY 1"""

# -- match rows ---------------------------------------------------------------------------

CORRECTIONS = """
corrections AS (
  SELECT user_id::VARCHAR AS enterprise_id, event_type || '-' || event_id AS standard_id,
         CASE WHEN event_type <> 'view' THEN event_type || '-' || event_id END AS address_id,
         CASE WHEN event_type <> 'click' THEN 'value ' || value::DECIMAL(12,2)::VARCHAR END AS standard_address,
         CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS room_no, event_id
  FROM events
)"""


def as_exact(source: str, hit: str, values: dict[str, str]) -> str:
    fixed = values | {
        "exact_match": "1.0", "partial_match": "0.0", "not_match": "0.0", "match_status": f"'{E}'",
        "correction_source": f"'{source}'",
    }
    return "m.* REPLACE (" + ", ".join(f"CASE WHEN {hit} THEN {x} ELSE m.{c} END AS {c}" for c, x in fixed.items()) + ")"


PICKED = f"""
last_pick AS (SELECT * FROM corrections QUALIFY row_number() OVER (PARTITION BY enterprise_id ORDER BY event_id DESC) = 1),
picked AS (
  SELECT {as_exact(vocab.SOURCE_PICKED, 'c.enterprise_id IS NOT NULL', {
      'address_id': 'c.standard_id', 'standard_address': 'c.standard_address', 'room_no': "coalesce(c.room_no, '')"})}
  FROM matches m LEFT JOIN last_pick c ON m.enterprise_id = c.enterprise_id
)"""
EDITED = f"""
settled AS (
  SELECT enterprise_id, arg_max(address_id, event_id) FILTER (WHERE address_id IS NOT NULL) AS address_id,
         arg_max(standard_address, event_id) FILTER (WHERE standard_address IS NOT NULL) AS standard_address,
         arg_max(room_no, event_id) FILTER (WHERE room_no IS NOT NULL) AS room_no
  FROM corrections GROUP BY 1
), edited AS (
  SELECT {as_exact(vocab.SOURCE_EDITED, 'c.enterprise_id IS NOT NULL', {
      'address_id': 'coalesce(c.address_id, m.address_id)',
      'standard_address': 'coalesce(c.standard_address, m.standard_address)',
      'room_no': 'coalesce(c.room_no, m.room_no)'})}
  FROM matches m LEFT JOIN settled c ON m.enterprise_id = c.enterprise_id
)"""
CORRECTED = with_(*KEPT, CORRECTIONS, PICKED)
ORACLES["correct_pick"] = CORRECTED + rounded("picked")
ORACLES["correct_edit"] = with_(*KEPT, CORRECTIONS, EDITED) + rounded("edited")
ORACLES["merge_corrections"] = ORACLES["correct_pick"]
ORACLES["merge_edits"] = ORACLES["correct_edit"]
ORACLES["correction_report"] = """
SELECT (SELECT count(*) FROM events) AS correction_count,
       (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT user_id FROM events)) AS updated_rows"""
ORACLES["match_filter"] = CORRECTED + rounded("picked", f"""
WHERE match_status = '{E}' AND exact_match >= 0.5 AND partial_match <= 0.4
  AND (enterprise_name LIKE '%supplier 1%' OR enterprise_address LIKE '%supplier 1%' OR standard_address LIKE '%supplier 1%')
  AND correction_source = '{vocab.SOURCE_AUTO}'""")
ORACLES["match_source_filter"] = CORRECTED + rounded("picked", f"WHERE correction_source = '{vocab.SOURCE_PICKED}'")
ORACLES["match_page"] = CORRECTED + rounded(
    "(SELECT * FROM picked WHERE exact_match >= 0.2 ORDER BY exact_match DESC, partial_match DESC, enterprise_id LIMIT 25 OFFSET 75)"
)

ORACLES["match_page_deep"] = CORRECTED + rounded(
    "(SELECT * FROM picked ORDER BY exact_match DESC, partial_match DESC, enterprise_id LIMIT 25 OFFSET 4975)"
)


def class_stats(source: str) -> str:
    return f"""
counted AS (
  SELECT count(*) AS total_count,
         count(*) FILTER (WHERE match_status = '{E}') AS exact_match_count,
         count(*) FILTER (WHERE match_status = '{P}') AS partial_match_count,
         count(*) FILTER (WHERE match_status = '{N}') AS not_match_count,
         round(coalesce(avg(exact_match), 0), 6) AS avg_exact_match,
         round(coalesce(avg(partial_match), 0), 6) AS avg_partial_match,
         round(coalesce(avg(not_match), 0), 6) AS avg_not_match
  FROM {source}
), rates AS (
  SELECT *, round((exact_match_count + partial_match_count) / total_count * 100, 6) AS match_rate,
         round(exact_match_count / total_count * 100, 6) AS exact_match_rate,
         round(partial_match_count / total_count * 100, 6) AS partial_match_rate,
         round(not_match_count / total_count * 100, 6) AS not_match_rate
  FROM counted
)"""


ORACLES["match_stats"] = CORRECTED + "," + class_stats("picked") + f""",
manual AS (
  SELECT count(*) FILTER (WHERE correction_source IN ('{vocab.SOURCE_PICKED}', '{vocab.SOURCE_EDITED}')) AS manual_correction_count,
         count(*) FILTER (WHERE correction_source = '{vocab.SOURCE_PICKED}') AS manual_select_count,
         count(*) FILTER (WHERE correction_source = '{vocab.SOURCE_EDITED}') AS manual_match_count,
         count(*) FILTER (WHERE correction_source = '{vocab.SOURCE_AUTO}' OR correction_source IS NULL) AS auto_match_count
  FROM picked
)
SELECT *, round(manual_correction_count / total_count * 100, 6) AS manual_correction_rate FROM rates, manual"""
ORACLES["csv_statistics"] = CORRECTED + "," + class_stats("picked") + "SELECT total_count, match_rate FROM rates"
ORACLES["match_sink_rows"] = ORACLES["rank_rounded"]

# -- pairs ----------------------------------------------------------------------------------

TURNS = """
turns AS (
  SELECT a.conv_id || '-' || a.turn AS id, a.role, a.text, b.text AS next_text
  FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
)"""


def pair_scores(source: str) -> str:
    """CTEs from ``source`` (id, a, b) to ``judged`` with scores, status."""
    share = lambda c, a, b: f"CASE WHEN {a} + {b} = 0 THEN 1.0 ELSE {c} / greatest({a} + {b} - {c}, 1) END"
    frame = lambda t: (
        f"list_distinct(list_transform(range(0, len({t}) + 1), lambda i: coalesce({t}[i], 0) * 2097152 + coalesce({t}[i + 1], 0)))"
    )
    runs = lambda t, k: f"list_distinct(regexp_extract_all({t}, '[{k}]+'))"
    logit = lambda w: " + ".join(
        [f"{w[0]}"] + [f"{x} * {n}" for x, n in zip(w[1:], ("pair_share", "pair_cover", "number_share", "first_number", "letter_share", "length_ratio"))]
    )
    zn, zp, ze = [logit(w) for w in DEFAULT_WEIGHTS]
    return f"""
chars AS MATERIALIZED (
  SELECT *, list_transform(string_split(a, ''), lambda c: unicode(c)::BIGINT) AS ca,
         list_transform(string_split(b, ''), lambda c: unicode(c)::BIGINT) AS cb FROM {source}),
sets AS MATERIALIZED (
  SELECT *, {frame('ca')} AS pa, {frame('cb')} AS pb, {runs('a', '0-9')} AS na, {runs('b', '0-9')} AS nb,
         {runs('a', 'A-Za-z')} AS la, {runs('b', 'A-Za-z')} AS lb
  FROM chars
), sizes AS MATERIALIZED (
  SELECT *, len(list_intersect(pa, pb)) AS pc, len(list_intersect(na, nb)) AS nc, len(list_intersect(la, lb)) AS lc FROM sets
), features AS MATERIALIZED (
  SELECT *, {share('pc', 'len(pa)', 'len(pb)')} AS pair_share, pc / greatest(least(len(pa), len(pb)), 1) AS pair_cover,
         {share('nc', 'len(na)', 'len(nb)')} AS number_share,
         (regexp_extract(a, '[0-9]+') = regexp_extract(b, '[0-9]+'))::INT::DOUBLE AS first_number,
         {share('lc', 'len(la)', 'len(lb)')} AS letter_share,
         least(length(a), length(b)) / greatest(length(a), length(b), 1) AS length_ratio
  FROM sizes
), pair_logits AS MATERIALIZED (SELECT *, {zn} AS zn, {zp} AS zp, {ze} AS ze FROM features),
pair_shifted AS (
  SELECT *, exp(zn - greatest(zn, zp, ze)) AS xn, exp(zp - greatest(zn, zp, ze)) AS xp, exp(ze - greatest(zn, zp, ze)) AS xe
  FROM pair_logits
), probable AS MATERIALIZED (
  SELECT *, xn / (xn + xp + xe) AS pn, xp / (xn + xp + xe) AS pp, xe / (xn + xp + xe) AS pe,
         {strip('a')} = '' OR {strip('b')} = '' AS blank
  FROM pair_shifted
), judged AS (
  SELECT *, CASE WHEN blank THEN 0.0 ELSE pe END AS exact_match, CASE WHEN blank THEN 0.0 ELSE pp END AS partial_match,
         CASE WHEN blank THEN 1.0 ELSE pn END AS not_match,
         CASE WHEN blank THEN '{N}' ELSE {status('pe', 'pp', 'pn')} END AS match_status
  FROM probable
)"""


TURN_PAIRS = with_(TURNS, "texts AS (SELECT id, coalesce(text, '') AS a, coalesce(next_text, '') AS b FROM turns)", pair_scores("texts"))
PAIR_COLUMNS = """SELECT nullif(id, '') AS identifier, a AS address_a, b AS address_b, round(exact_match, 6) AS exact_match,
       round(partial_match, 6) AS partial_match, round(not_match, 6) AS not_match, match_status"""
ORACLES["pair_scores"] = TURN_PAIRS + PAIR_COLUMNS + " FROM judged"
ORACLES["pair_sink_rows"] = ORACLES["pair_scores"]
ORACLES["pair_blank_rows"] = with_(TURNS) + f"""
SELECT id, text FROM turns WHERE {strip("coalesce(text, '')")} = '' OR {strip("coalesce(next_text, '')")} = ''"""
ORACLES["pair_stats"] = TURN_PAIRS + "," + class_stats("judged") + "SELECT * FROM rates"
ORACLES["pair_page"] = TURN_PAIRS + PAIR_COLUMNS + """ FROM judged
WHERE not_match <= 0.9 AND (a LIKE '%an%' OR b LIKE '%an%')
ORDER BY judged.exact_match DESC, judged.partial_match DESC, id LIMIT 20 OFFSET 20"""
ORACLES["pair_copy"] = TURN_PAIRS + f"""
, one AS (SELECT a, b, min(exact_match) AS e, min(partial_match) AS p, min(not_match) AS n, min(match_status) AS s FROM judged GROUP BY a, b)
SELECT t.id, t.role, t.text, t.next_text, round(coalesce(o.e, 0), 6) AS exact_match, round(coalesce(o.p, 0), 6) AS partial_match,
       round(coalesce(o.n, 0), 6) AS not_match, coalesce(o.s, '{N}') AS match_status
FROM turns t LEFT JOIN one o ON t.text = o.a AND t.next_text = o.b"""

# -- tagging ----------------------------------------------------------------------------------

_LABELS = "[" + ", ".join(f"'{x}'" for x in TOKEN_LABELS) + "]"
_SPECIAL = ", ".join(f"'{t}'" for t in vocab.SPECIAL_TOKENS)
SPANS = f"""
words AS (
  SELECT doc_id, unnest(list_zip(w, range(0, len(w)))) AS z FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
), tokens AS (
  SELECT doc_id, z[2] AS pos, regexp_replace(regexp_replace(z[1], '^#+', ''), '^Ġ+', '') AS token,
         {_LABELS}[((z[2] + length(z[1]) + doc_id) % {len(TOKEN_LABELS)}) + 1] AS label
  FROM words WHERE z[1] NOT IN ({_SPECIAL})
), neighbours AS (
  SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM tokens
), roles AS (
  SELECT *, CASE WHEN label = 'O' THEN 0
                 WHEN label[1:2] IN ('I-', 'E-') AND before[1:2] IN ('B-', 'I-') AND before[3:] = label[3:] THEN 1 ELSE 2 END AS role
  FROM neighbours
), islands AS (
  SELECT *, sum((role = 2)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM roles
), spans AS (
  SELECT doc_id, (island - 1)::BIGINT AS entity_no, arg_min(label[3:], pos) AS tag, string_agg(token, '' ORDER BY pos) AS text
  FROM islands WHERE role > 0 GROUP BY doc_id, island
)"""
ORACLES["bio_spans"] = with_(SPANS) + "SELECT doc_id, entity_no, tag, text FROM spans"
ORACLES["dom_json"] = with_(SPANS) + """
SELECT d.doc_id, '[' || coalesce(j, '') || ']' AS dom_json FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg('["' || tag || '", ' || to_json(text)::VARCHAR || ']', ', ' ORDER BY entity_no) AS j FROM spans GROUP BY doc_id
) USING (doc_id)"""


def fields(mode: str) -> str:
    """CTE ``tagged`` (doc_id and the fields of a mode, one row per document)."""
    if mode == "12":
        wanted = {f: tags for f, tags in vocab.TAGS_OF_FIELD_12.items()}
    else:
        wanted = {f: (f,) for f in vocab.FIELDS_17}
    columns = []
    for name, tags in wanted.items():
        chosen = ", ".join(f"'{t}'" for t in tags)
        if mode == "17_2":
            texts = f"list(s.text ORDER BY entity_no) FILTER (WHERE tag = '{name}' AND s.text <> '')"
            columns.append(f"coalesce(({texts})[1], '') AS {name}")
            columns.append(f"coalesce(array_to_string(({texts})[2:], ''), '') AS {name}_2")
        else:
            columns.append(f"coalesce(string_agg(s.text, '' ORDER BY entity_no) FILTER (WHERE tag IN ({chosen})), '') AS \"{name}\"")
    body = ",\n         ".join(columns)
    return f"""
tagged AS (
  SELECT d.doc_id, {body}
  FROM documents d LEFT JOIN spans s USING (doc_id) GROUP BY d.doc_id
)"""


TAGGED = "SELECT t.* EXCLUDE (doc_id), d.doc_id::VARCHAR AS _id_field, d.text AS original_address FROM tagged t JOIN documents d USING (doc_id)"
ORACLES["tag12_fields"] = with_(SPANS, fields("12")) + TAGGED
ORACLES["tag17_fields"] = with_(SPANS, fields("17")) + TAGGED
ORACLES["tag17_2_fields"] = with_(SPANS, fields("17_2")) + TAGGED
ORACLES["tag_fill_stats"] = with_(SPANS, fields("12")) + "SELECT count(*) AS total_count, " + ", ".join(
    f"count(*) FILTER (WHERE \"{f}\" <> '') AS {f}_count, round(count(*) FILTER (WHERE \"{f}\" <> '') / count(*) * 100, 6) AS {f}_rate"
    for f in vocab.FIELDS_12
) + " FROM tagged"
for _mode, _fields in (("17", vocab.FIELDS_17), ("17_2", vocab.FIELDS_34)):
    ORACLES[f"tag_fill_stats_{_mode}"] = with_(SPANS, fields(_mode)) + "SELECT count(*) AS total_count, " + ", ".join(
        f"count(*) FILTER (WHERE {f} <> '') AS {f}_count, round(count(*) FILTER (WHERE {f} <> '') / count(*) * 100, 6) AS {f}_rate"
        for f in _fields
    ) + " FROM tagged"
ORACLES["tag_filter_page"] = with_(SPANS, fields("12")) + f"SELECT * FROM ({TAGGED}) " + """
WHERE (original_address LIKE '%an%' OR province LIKE '%an%' OR city LIKE '%an%' OR district LIKE '%an%' OR road LIKE '%an%' OR area LIKE '%an%')
  AND province <> '' AND city <> '' AND district <> ''
ORDER BY _id_field, original_address LIMIT 20 OFFSET 20"""
ORACLES["tag17_filter"] = with_(SPANS, fields("17")) + f"SELECT * FROM ({TAGGED}) " + """
WHERE (original_address LIKE '%th%' OR prov LIKE '%th%' OR city LIKE '%th%' OR district LIKE '%th%' OR road LIKE '%th%' OR poi LIKE '%th%')
  AND prov <> ''"""

ALL_TEXTS = """
texts AS (
  SELECT 'documents ' || doc_id AS text_id, text FROM documents
  UNION ALL SELECT 'benchmark ' || item_id, text FROM benchmark
  UNION ALL SELECT 'conversations ' || conv_id || '-' || turn, text FROM conversations
)"""
# of the equal documents the smallest row of fields
LOOKUP = f"""
lookup AS (
  SELECT key, min(f) AS f FROM (
    SELECT {strip('d.text')} AS key, {{{', '.join(f"'{f}': t.{f}" for f in vocab.FIELDS_17)}}} AS f,
           '[' || coalesce(j, '') || ']' AS dom_json
    FROM tagged t JOIN documents d USING (doc_id)
    LEFT JOIN (SELECT doc_id, string_agg('["' || tag || '", ' || to_json(text)::VARCHAR || ']', ', ' ORDER BY entity_no) AS j
               FROM spans GROUP BY doc_id) USING (doc_id)
  ) GROUP BY key
)"""
LOOKUP_BY_JSON = LOOKUP.replace("min(f) AS f", "arg_min(f, dom_json) AS f")
ORACLES["tag_copy_left"] = with_(SPANS, fields("17"), ALL_TEXTS, LOOKUP_BY_JSON) + (
    "SELECT x.text_id, x.text, CASE WHEN l.key IS NOT NULL THEN '' END AS _id_field, "
    + ", ".join(f"l.f.{f} AS {f}" for f in vocab.FIELDS_17)
    + f" FROM texts x LEFT JOIN lookup l ON {strip('x.text')} = l.key"
)
ORACLES["tag_copy_blank"] = with_(SPANS, fields("17"), ALL_TEXTS, LOOKUP) + (
    "SELECT x.text_id, x.text, "
    + ", ".join(f"coalesce(l.f.{f}, '') AS {f}" for f in vocab.FIELDS_17)
    + f" FROM texts x LEFT JOIN lookup l ON {strip('x.text')} = l.key"
)
ORACLES["copy_page"] = ORACLES["tag_copy_blank"] + " ORDER BY x.text_id LIMIT 15 OFFSET 90"


def _copied(mode: str, names: tuple[str, ...], first: str = "") -> str:
    """Texts with the fields of the equal document that sorts first; '' where there is none."""
    key = first or "f"
    lookup = f"""
lookup AS (
  SELECT key, arg_min(f, o) AS f FROM (
    SELECT {strip('d.text')} AS key, {{{', '.join(f"'{f}': t.{f}" for f in names)}}} AS f, {key} AS o
    FROM tagged t JOIN documents d USING (doc_id)) GROUP BY key)"""
    return with_(SPANS, fields(mode), ALL_TEXTS, lookup) + "SELECT x.text_id, x.text, " + ", ".join(
        f"coalesce(l.f.{f}, '') AS {f}" for f in names
    ) + f" FROM texts x LEFT JOIN lookup l ON {strip('x.text')} = l.key"


ORACLES["tag_copy_12"] = _copied("12", vocab.FIELDS_12)
ORACLES["tag_copy_17_2"] = _copied("17_2", vocab.FIELDS_34)
ORACLES["tag_sink_rows"] = with_(SPANS, fields("17_2")) + """
SELECT doc_id::VARCHAR AS _id_field, prov, poi, '' AS poi_2, city_2 FROM tagged"""

# -- vectors ------------------------------------------------------------------------------------


def encoded(source: str, name: str, dim: int = TEXT_DIM) -> str:
    """CTE ``name`` (id, v) with the unit vector of every text of ``source`` (id, text)."""
    return f"""
{name}_codes AS (
  SELECT id, list_transform(string_split({strip('text')}, ''), lambda c: unicode(c)::BIGINT) AS c
  FROM {source} WHERE {strip('text')} <> ''
), {name}_slots AS (
  SELECT id, unnest(list_transform(range(0, len(c) + 1), lambda i:
         (coalesce(CASE WHEN i > 0 THEN c[i] END, 0) * 8191 + coalesce(c[i + 1], 0) * 131) % {dim})) AS slot
  FROM {name}_codes
), {name}_counts AS (SELECT id, slot, count(*) AS n FROM {name}_slots GROUP BY ALL),
{name}_unit AS (
  SELECT id, slot, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT AS x FROM {name}_counts
), {name} AS (
  SELECT id, list_transform(range(0, {dim}), lambda s: coalesce(m[s], 0)::FLOAT) AS v
  FROM (SELECT id, map_from_entries(list((slot, x))) AS m FROM {name}_unit GROUP BY id)
)"""


TURN_TEXTS = "e_src AS (SELECT conv_id || '-' || turn AS id, role AS name, text FROM conversations WHERE text IS NOT NULL AND text <> '')"
DOC_TEXTS = "s_src AS (SELECT doc_id::VARCHAR AS id, coalesce(source, '') AS room_no, text FROM documents WHERE text IS NOT NULL AND text <> '')"
VECTOR_TEXT = "'[' || array_to_string(list_transform(v, lambda x: format('{:.8f}', x::DOUBLE)), ',') || ']'"
ORACLES["encode_text"] = with_(TURN_TEXTS, encoded("e_src", "ev")) + f"""
SELECT id AS source_id, name AS enterprise_name, text AS address, {VECTOR_TEXT} AS vector_text FROM ev JOIN e_src USING (id)"""
ORACLES["vectorize_stream"] = ORACLES["encode_text"]
ORACLES["vectorize_stream_lists"] = f"""
SELECT kind, conv_id || '-' || turn AS source_id, role AS said_by, text AS address, {TEXT_DIM}::BIGINT AS dim, true AS listed
FROM conversations, (VALUES ('enterprise'), ('standard')) k(kind) WHERE text IS NOT NULL AND text <> ''"""
ORACLES["encode_documents"] = with_(DOC_TEXTS, encoded("s_src", "sv")) + """
SELECT id AS source_id, room_no,
       round(sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm,
       round(list_max(v)::DOUBLE, 6) AS largest, len(list_filter(v, lambda x: x > 0)) AS filled
FROM sv JOIN s_src USING (id)"""
ORACLES["l2_normalize"] = """
WITH moved AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 2 + 1) AS v FROM embeddings),
     normed AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM moved),
     unit AS (SELECT vec_id, list_transform(v, lambda x: (x / norm)::FLOAT::DOUBLE) AS u FROM normed)
SELECT vec_id::VARCHAR AS source_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 5) AS norm,
       round(u[1], 5) AS first_number FROM unit"""
ORACLES["vector_norm_check"] = """
WITH moved AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: (x::DOUBLE * 1.05::DOUBLE + 0.03::DOUBLE)::FLOAT::DOUBLE) AS v FROM embeddings
), normed AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM moved)
SELECT vec_id::VARCHAR AS source_id, 'label ' || label AS address, round(norm, 6) AS norm FROM normed WHERE abs(norm - 1) > 0.1"""
ORACLES["vector_self_product"] = """
SELECT count(*) AS n, count(*) FILTER (WHERE abs(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) - 1) < 0.1) AS ok
FROM embeddings"""
ORACLES["vector_profile"] = "SELECT count(*) AS row_count, min(len(embedding))::INT AS min_dim, max(len(embedding))::INT AS max_dim FROM embeddings"
ORACLES["same_address_check"] = with_(EMBED_SIDES) + """
, one AS (SELECT standard_address AS address, min(standard_id) AS standard_id, arg_min(v, standard_id) AS v FROM r GROUP BY 1)
, both_sides AS (
  SELECT enterprise_id AS source_id, 'query' AS side, enterprise_address AS address, v FROM q
  UNION ALL SELECT standard_id, 'reference', standard_address, v FROM r)
SELECT b.source_id, b.side, o.address, o.standard_id, round(1 - pow(array_distance(b.v, o.v), 2) / 2.0, 6) AS similarity,
       1 - pow(array_distance(b.v, o.v), 2) / 2.0 > 0.99 AS ok
FROM both_sides b JOIN one o USING (address)"""

PENDING = "FROM documents WHERE text IS NOT NULL AND text <> '' AND doc_id::VARCHAR NOT IN (SELECT vec_id::VARCHAR FROM embeddings)"
ORACLES["unvectorized_anti"] = f"SELECT doc_id::VARCHAR AS id, text AS address, coalesce(source, '') AS room_no {PENDING}"
ORACLES["unvectorized_enterprise"] = f"SELECT doc_id::VARCHAR AS id, doc_id::VARCHAR AS name {PENDING}"
ORACLES["unvectorized_count"] = f"SELECT count(*) AS pending_count {PENDING}"
ORACLES["valid_count"] = with_(TURNS) + "SELECT count(*) AS valid_count FROM turns WHERE next_text IS NOT NULL AND next_text <> ''"
ORACLES["vectorize_incremental"] = f"""
SELECT s_suppkey::VARCHAR AS source_id, s_name AS address, {TEXT_DIM}::BIGINT AS dim FROM supplier
UNION ALL
SELECT c_custkey::VARCHAR, c_name, {TEXT_DIM}::BIGINT FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)"""

# -- whole pipelines ----------------------------------------------------------------------------

TEXT_SIDES = (
    TURN_TEXTS, DOC_TEXTS, encoded("e_src", "ev"), encoded("s_src", "sv"),
    f"q AS (SELECT id AS enterprise_id, name AS enterprise_name, text AS enterprise_address, v::DOUBLE[]::DOUBLE[{TEXT_DIM}] AS v FROM ev JOIN e_src USING (id))",
    f"r AS (SELECT id AS standard_id, text AS standard_address, room_no, v::DOUBLE[]::DOUBLE[{TEXT_DIM}] AS v FROM sv JOIN s_src USING (id))",
)
ORACLES["text_recall"] = with_(*TEXT_SIDES, knn("q", "r", 3, 0.5)) + """
SELECT enterprise_id, standard_id, room_no, round(similarity, 6) AS similarity FROM found"""
ORACLES["two_stage_match"] = with_(
    *TEXT_SIDES, knn("q", "r", 3, 0.5),
    "texts AS (SELECT *, coalesce(enterprise_address, '') AS a, coalesce(standard_address, '') AS b FROM found)",
    pair_scores("texts").replace("CASE WHEN blank THEN 0.0 ELSE pe END", "pe").replace("CASE WHEN blank THEN 0.0 ELSE pp END", "pp")
    .replace("CASE WHEN blank THEN 1.0 ELSE pn END", "pn"),
    "everyone AS (SELECT enterprise_id, enterprise_name, enterprise_address FROM q)",
    "scored AS (SELECT * EXCLUDE (match_status) FROM judged)",
    best(ROUNDED_ORDER, 0, True),
) + rounded()
ORACLES["single_stage_match"] = with_(
    *TEXT_SIDES, knn("q", "r", 3), similarity_scores("found"),
    "everyone AS (SELECT id AS enterprise_id, name AS enterprise_name, text AS enterprise_address FROM e_src)",
    best(ROUNDED_ORDER, 0.6, True),
) + rounded()

# -- checks and set operations ------------------------------------------------------------------

ORACLES["dup_semi"] = """
SELECT doc_id, lang, n_chars FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)"""
ORACLES["dup_counts"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) - count(DISTINCT {c}) AS duplicate_count FROM documents" for c in ("text", "source", "lang")
)
PLACES = """
c AS (SELECT n_name || ' No.' || c_custkey AS address FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT n_name || ' No.' || s_suppkey AS address FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
ORACLES["overlap_intersect"] = with_(PLACES) + "SELECT address FROM c INTERSECT SELECT address FROM s"
ORACLES["union_distinct"] = with_(PLACES) + "SELECT address FROM c UNION SELECT address FROM s"
ORACLES["union_all"] = with_(PLACES) + "SELECT address, count(*) AS n FROM (SELECT * FROM c UNION ALL SELECT * FROM s) GROUP BY 1"
ORACLES["distractor_except"] = with_(PLACES) + "SELECT address FROM s WHERE address NOT IN (SELECT address FROM c)"
ORACLES["class_distribution"] = "SELECT quality, toxic, count(*) AS row_count FROM labels GROUP BY ALL"


def _form(form: str, i: int) -> str:
    def pick(word: str, shift: int) -> str:
        return f"district || ['东', '西', '南'][((number + {shift}) % 3) + 1] || '{word}'"

    # the names here have more than four characters, so a short one has two
    building = pick("商务大厦", {17: 3, 18: 4}.get(i, 0))
    parts = {
        "P": "'广东省'", "p": "'广东'", "C": "'深圳市'", "c": "'深圳'", "D": "district", "R": "road", "N": "number::VARCHAR",
        "S": pick("街道", {5: 0, 6: 1}.get(i, 0)), "M": pick("社区", {6: 2, 19: 5}.get(i, 0)),
        "B": building, "b": f"left({building}, 2)",
    }
    out = form
    for k, sql in parts.items():
        out = out.replace("{" + k + "}", "\x00" + f"({sql})" + "\x00")
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    return " || ".join(p if p.startswith("(") and p.endswith(")") else quoted(p) for p in out.split("\x00") if p)


def _distractor(form: str) -> str:
    at = "c_custkey"
    name = lambda word: f"district || ['东', '西', '南'][({at} % 3) + 1] || '{word}'"
    parts = {
        "P": "'广东省'", "C": "'深圳市'", "D": "district", "R": "road", "N": "number::VARCHAR", "S": name("街道"),
        "B": name("商务大厦"), "o": f"['一', '二', '三', '四', '五'][({at} % 5) + 1]",
        **{f"i{n}": f"({at} % {n} + 1)::VARCHAR" for n in (3, 5, 8, 20, 30)},
    }
    pieces = [x for literal, key, _, _ in Formatter().parse(form) for x in ([f"'{literal}'"] if literal else []) + ([f"({parts[key]})"] if key else [])]
    return " || ".join(pieces)


def _case(side: int) -> str:
    return "CASE c_custkey % 20 " + " ".join(f"WHEN {i} THEN {_form(f[side], i)}" for i, f in enumerate(SAME_PLACE_FORMS)) + " END"


def _differences() -> str:
    return "CASE c_custkey % 20 " + " ".join(f"WHEN {i} THEN {_form(f, i)}" for i, f in enumerate(DIFFERENCES)) + " END"


VARIANTS = f"""
places AS (SELECT c_custkey, n_name AS district, c_mktsegment || '路' AS road, c_custkey AS number
           FROM customer JOIN nation ON c_nationkey = n_nationkey),
variants AS (SELECT *, (c_custkey % 20)::INT AS transform_type, {_case(0)} AS enterprise_address, {_case(1)} AS standard_address,
             {_differences()} AS semantic_diff FROM places)"""
ORACLES["eval_pairs"] = with_(VARIANTS) + """
SELECT c_custkey + 1 AS group_id, format('EVAL_E{:04d}', c_custkey + 1) AS enterprise_id,
       format('深圳测评企业{:04d}', c_custkey + 1) AS enterprise_name, enterprise_address,
       format('EVAL_A{:04d}', c_custkey + 1) AS standard_addr_code, standard_address,
       format('HC{:08d}', c_custkey + 1) AS house_code,
       CASE WHEN enterprise_address <> standard_address THEN '部分一致' ELSE '完全一致' END AS consistency_type,
       '完全匹配' AS expected_match, semantic_diff, transform_type FROM variants"""
ORACLES["eval_distractors"] = with_(
    VARIANTS,
    "far AS (SELECT * REPLACE (c_custkey * 7 + 501 AS number) FROM places)",
    "made AS (SELECT c_custkey, CASE c_custkey % 6 "
    + " ".join(f"WHEN {i} THEN {_distractor(f)}" for i, f in enumerate(DISTRACTOR_FORMS))
    + " END AS standard_address FROM far)",
) + """
SELECT format('EVAL_D{:04d}', c_custkey + 1) AS addr_code, standard_address, format('HD{:08d}', c_custkey + 1) AS house_code
FROM made WHERE standard_address NOT IN (SELECT enterprise_address FROM variants UNION SELECT standard_address FROM variants)"""
ORACLES["vectorize_repeated_ids"] = f"""
SELECT c_nationkey::VARCHAR AS source_id, c_name AS address, {TEXT_DIM}::BIGINT AS dim FROM customer"""
ORACLES["two_stage_lists"] = with_(
    EMBED_SIDES, IVF, similarity_scores("ivf"), best(ROUNDED_ORDER, 0.5, True),
).replace("centres AS", "everyone AS (SELECT enterprise_id, enterprise_name, enterprise_address FROM q),\ncentres AS", 1) + rounded()
GAZETTEER_PLACES = """
slots AS (SELECT n_name AS district, n_name || r AS road, row_number() OVER (ORDER BY n_nationkey, i) - 1 AS slot
          FROM nation, (VALUES (0, '一路'), (1, '二路'), (2, '三路')) w(i, r)),
rounds AS (SELECT unnest(range((SELECT count(*) FROM customer))) AS k),
places AS (SELECT k AS c_custkey, district, road, (k + 1) * 37 + 100 AS number FROM rounds JOIN slots ON k % (SELECT count(*) FROM slots) = slot)"""
GAZETTEER_VARIANTS = GAZETTEER_PLACES + f""",
variants AS (SELECT *, (c_custkey % 20)::INT AS transform_type, {_case(0)} AS enterprise_address, {_case(1)} AS standard_address,
             {_differences()} AS semantic_diff FROM places)"""
ORACLES["eval_match_pairs"] = ORACLES["eval_pairs"].replace(VARIANTS.strip(), GAZETTEER_VARIANTS.strip())
ORACLES["eval_distractor_rows"] = with_(
    GAZETTEER_VARIANTS,
    """far AS (SELECT k AS c_custkey, n_name AS district, n_name || ['一路', '二路', '三路'][k % 3 + 1] AS road, k * 7 + 501 AS number
            FROM (SELECT unnest(range((SELECT 3 * count(*) FROM customer))) AS k) JOIN nation ON k % 25 = n_nationkey)""",
    "made AS (SELECT c_custkey, CASE c_custkey % 6 "
    + " ".join(f"WHEN {i} THEN {_distractor(f)}" for i, f in enumerate(DISTRACTOR_FORMS))
    + " END AS standard_address FROM far)",
) + """
SELECT format('EVAL_D{:04d}', c_custkey + 1) AS addr_code, standard_address, format('HD{:08d}', c_custkey + 1) AS house_code
FROM made WHERE standard_address NOT IN (SELECT enterprise_address FROM variants UNION SELECT standard_address FROM variants)
ORDER BY c_custkey LIMIT (SELECT count(*) FROM customer)"""
ORACLES["eval_accuracy"] = with_(
    GAZETTEER_VARIANTS,
    f"""parts AS (SELECT k, district, road, (k + 1) * 41 + 60 AS number, (k + 1) * 41 + 62 + k % 90 AS number2,
       district || ['东', '西', '南'][k % 3 + 1] || '商务大厦' AS building, '深圳市' || district || road AS c, '广东省深圳市' || district || road AS p
     FROM rounds JOIN slots ON k % 75 = slot),
halves AS (SELECT k, district AS district2, road AS road2 FROM rounds JOIN slots ON (k + 37) % 75 = slot),
labelled AS (
  SELECT enterprise_address AS a, standard_address AS b, '完全匹配' AS expected_match FROM variants
  UNION ALL SELECT CASE k % 4 WHEN 0 THEN c || number || '号' WHEN 1 THEN c || number || '号A栋' WHEN 2 THEN c || number || '号'
                              ELSE c || '东段' || number || '号' END,
                   CASE k % 4 WHEN 0 THEN p || number2 || '号' WHEN 1 THEN p || number || '号B栋' WHEN 2 THEN p || number || '号' || building
                              ELSE p || '西段' || number2 || '号' END, '部分匹配' FROM parts
  UNION ALL SELECT c || number || '号', '广东省深圳市' || district2 || road2 || (number * 3 + 7) || '号', '不匹配'
            FROM parts JOIN halves USING (k) WHERE district <> district2),
pairs AS (SELECT a || '|' || b AS id, a, b, expected_match FROM labelled)""",
    pair_scores("pairs"),
) + f"""
SELECT expected_match, count(*) AS row_count, count(*) FILTER (WHERE right_one) AS right_count,
       round(count(*) FILTER (WHERE right_one) / count(*) * 100, 6) AS right_rate
FROM (SELECT *, match_status = CASE expected_match WHEN '完全匹配' THEN '{E}' WHEN '部分匹配' THEN '{P}' ELSE '{N}' END AS right_one FROM judged)
GROUP BY expected_match"""
ORACLES["eval_samples"] = ORACLES["eval_pairs"] + " ORDER BY group_id LIMIT 10 OFFSET 20"
ORACLES["preview_rows"] = "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 5"
ORACLES["list_rule"] = """
SELECT c_custkey * 20011 AS n, greatest(100, least(4000, CASE WHEN c_custkey * 20011 <= 1000000 THEN c_custkey * 20011 // 1000
  ELSE floor(sqrt(c_custkey * 20011))::BIGINT END)) AS lists FROM customer"""
ORACLES["stream_progress"] = "SELECT count(*) AS processed, count(*) AS total, 1.0::DOUBLE AS progress, true AS has_rate FROM documents"
ORACLES["plugged_batches"] = """
SELECT doc_id, coalesce(length(text), 0) AS n_chars,
       coalesce(length(text) - length(replace(text, ' ', '')), 0) AS n_spaces, NULL::VARCHAR AS error FROM documents"""
ORACLES["rank_repeated_ids"] = with_(*KEPT, """shared AS (
  SELECT * REPLACE (((enterprise_id::BIGINT) // 3)::VARCHAR AS enterprise_id) FROM matches)""") + rounded("shared")
ORACLES["plugged_failures"] = with_(TURNS, f"""
judged AS (SELECT nullif(id, '') AS identifier, {strip("coalesce(text, '')")} = '' OR {strip("coalesce(next_text, '')")} = '' AS blank,
                  coalesce(text, '') LIKE 'T%' AS bad FROM turns)""") + f"""
SELECT identifier, CASE WHEN blank OR bad THEN 0.0 ELSE 0.5 END AS exact_match, CASE WHEN blank OR bad THEN 0.0 ELSE 0.25 END AS partial_match,
       CASE WHEN blank OR bad THEN 1.0 ELSE 0.25 END AS not_match, CASE WHEN blank OR bad THEN '{N}' ELSE '{E}' END AS match_status,
       CASE WHEN bad AND NOT blank THEN 'ValueError: starts with T' END AS error FROM judged"""
ORACLES["tags_lifecycle"] = """
SELECT trim(r_name) AS tag_name, lower(replace(r_name, ' ', '_')) AS prefix, lower(replace(r_name, ' ', '_')) || '_recall_results' AS recall_table,
       lower(replace(r_name, ' ', '_')) || '_match_results' AS match_table FROM region WHERE r_regionkey % 2 = 1"""
ORACLES["csv_encodings"] = """
SELECT c_custkey::VARCHAR AS c_custkey, '科苑' || CASE c_custkey % 3 WHEN 2 THEN '㐀' ELSE '路' END || c_custkey || '号' AS address FROM customer"""
ORACLES["match_export"] = ORACLES["match_filter"]
ORACLES["eval_transform_counts"] = with_(VARIANTS) + "SELECT transform_type, count(*) AS row_count FROM variants GROUP BY 1"
ORACLES["eval_pair_status"] = with_(
    VARIANTS, "texts AS (SELECT c_custkey AS id, enterprise_address AS a, standard_address AS b FROM variants)", pair_scores("texts")
) + "SELECT match_status, count(*) AS n FROM judged GROUP BY 1"
ORACLES["eval_verify"] = with_(VARIANTS) + """
SELECT count(*) AS e_count, count(*) - count(DISTINCT enterprise_address) AS e_dup, count(*) AS a_count, 0::BIGINT AS d_count,
       count(*) AS s_total, count(*) - count(DISTINCT standard_address) AS s_dup FROM variants"""
BLDG, ROOM, AREA = ["|".join(s) for s in (vocab.BUILDING_SUFFIXES, vocab.ROOM_SUFFIXES, vocab.AREA_SUFFIXES)]
ORACLES["suffix_tests"] = with_(VARIANTS) + f"""
SELECT c_custkey, regexp_matches(standard_address, '({BLDG})$') AS building, regexp_matches(standard_address, '({ROOM})$') AS room,
       regexp_matches(standard_address, '({AREA})$') AS area FROM variants"""
_SUB = f"""CASE WHEN regexp_matches(standard_address, '({ROOM})$') AND NOT regexp_matches(standard_address, '({BLDG})$') THEN 'houseno'
            WHEN regexp_matches(standard_address, '({AREA})$') THEN 'poi' ELSE 'subpoi' END"""
ORACLES["retag_by_suffix"] = with_(VARIANTS) + f"""
SELECT c_custkey, {_SUB} || ',' || CASE WHEN regexp_matches(enterprise_address, '({BLDG})$') THEN 'subpoi' ELSE 'houseno' END || ','
       || CASE WHEN regexp_matches(number::VARCHAR, '^[a-zA-Z]?[0-9]{{1,3}}$') THEN 'houseno' ELSE 'subpoi' END AS tags FROM variants"""


def native_tags(source: str, mode: str = "17") -> str:
    """CTE ``native`` (id, address, dom_json and 17 fields, or without it 34) by the level words,
    of ``source`` (id, address: stripped)."""
    endings = "|".join(words for _, words in LEVEL_WORDS)
    cases = " ".join(f"WHEN regexp_matches(piece, '.(?:{words})\\z') THEN '{tag}'" for tag, words in LEVEL_WORDS)
    texts = lambda f: f"list(piece ORDER BY pos) FILTER (WHERE tag = '{f}')"
    if mode == "17":
        columns = [f"coalesce(array_to_string({texts(f)}, ''), '') AS \"{f}\"" for f in vocab.FIELDS_17]
        columns.insert(0, """'[' || coalesce(string_agg('["' || tag || '", ' || to_json(piece)::VARCHAR || ']', ', ' ORDER BY pos)
           FILTER (WHERE tag IS NOT NULL), '') || ']' AS dom_json""")
    else:
        columns = [c for f in vocab.FIELDS_17 for c in (
            f"coalesce(({texts(f)})[1], '') AS \"{f}\"", f"coalesce(array_to_string(({texts(f)})[2:], ''), '') AS \"{f}_2\""
        )]
    columns = ",\n         ".join(columns)
    return f"""
pieces AS (
  SELECT id, unnest(list_zip(p, range(0, len(p)))) AS z
  FROM (SELECT id, regexp_extract_all(address, '(?s)(.+?(?:{endings}|\\z))', 1) AS p FROM {source})
), named AS (
  SELECT id, z[1] AS piece, z[2] AS pos FROM pieces
), judged_pieces AS (
  SELECT id, piece, pos, CASE {cases} WHEN regexp_matches(piece, '\\A[a-zA-Z]?-?[0-9]{{2,4}}\\z') THEN 'houseno' END AS tag FROM named
), native AS (
  SELECT s.id, s.address,
         {columns}
  FROM {source} s LEFT JOIN judged_pieces USING (id) GROUP BY s.id, s.address
)"""


_ROOM = r"([a-zA-Z]?\s*\d{2,4}\s*(室|房|号)?)\s*$"
_UNIT = r"(\d{1,4}\s*(室|房|号|铺))\s*$"
_NUMBER = r"(\d{2,4})\s*$"
NUMBERS = "numbers AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS n FROM customer)"
ORACLES["rule_merge"] = with_(NUMBERS) + """
SELECT k, CASE k % 4 WHEN 0 THEN 'roadno:' || n || '|houseno:A' || n WHEN 1 THEN 'houseno:' || n || '|road:路|houseno:B'
                     WHEN 2 THEN 'houseno:' || n || '-C' ELSE '' END AS entities FROM numbers"""
ORACLES["rule_tail"] = with_(NUMBERS, "tails AS (SELECT *, trim(['', '601室', ' a 12', 'xyz', '三栋8铺', '大厦1203', 'B座 7号 ', '12345'][k % 8 + 1]) AS tail FROM numbers)", f"""
rooms AS (SELECT *, CASE WHEN tail = '' THEN '' ELSE trim(coalesce(nullif(regexp_extract(tail, '{_ROOM}'), ''),
  nullif(regexp_extract(tail, '{_UNIT}'), ''), nullif(regexp_extract(tail, '{_NUMBER}'), ''), '')) END AS room FROM tails)""") + """
SELECT k, CASE WHEN k % 16 >= 8 THEN 'road:路|houseno:' || n || '号' || room
               ELSE 'road:路|roadno:' || n || '号' || CASE WHEN room = '' THEN '' ELSE '|houseno:' || room END END AS entities FROM rooms"""
ORACLES["rule_floor"] = with_(NUMBERS, "rooms AS (SELECT k, ((k * 7) % 1900 + 50)::VARCHAR AS room FROM numbers)", """
floors AS (SELECT *, CASE length(room) WHEN 3 THEN room[1:1] WHEN 4 THEN room[1:2] ELSE '' END AS floor FROM rooms),
added AS (SELECT *, CASE WHEN floor = '' THEN '' ELSE '|floorno:' || floor END AS more FROM floors)""") + """
SELECT k, CASE k % 3 WHEN 0 THEN 'houseno:' || room || more WHEN 1 THEN 'houseno:A|houseno:' || room || '室' || more
                     ELSE 'floorno:首层|houseno:' || room END AS entities FROM added"""
ORACLES["rule_boundary"] = with_(NUMBERS) + """
SELECT k, CASE k % 5 WHEN 0 THEN 'road:科技路|houseno:' || n || '室' WHEN 1 THEN 'road:科技路|roadno:' || n || '号'
                     WHEN 2 THEN 'road:科技路|roadno:8号|houseno:601' WHEN 3 THEN 'roadno:8号|houseno:A座601室'
                     ELSE 'road:科技路|houseno:室' END AS entities FROM numbers"""

ORACLES["tag_native_17"] = with_(
    VARIANTS, "addresses AS (SELECT c_custkey::VARCHAR AS id, standard_address AS address FROM variants)", native_tags("addresses")
) + "SELECT * EXCLUDE (id, address), id AS _id_field, address AS original_address FROM native"
ORACLES["tag_native_17_2"] = with_(
    VARIANTS, "addresses AS (SELECT c_custkey::VARCHAR AS id, standard_address AS address FROM variants)", native_tags("addresses", "17_2")
) + "SELECT * EXCLUDE (id, address), id AS _id_field, address AS original_address FROM native"
ORACLES["tag_stream"] = with_(
    f"addresses AS (SELECT doc_id::VARCHAR AS id, {strip('text')} AS address FROM documents)", native_tags("addresses")
) + "SELECT * EXCLUDE (id, address), id AS _id_field, address AS original_address FROM native"
ORACLES["prefix_count"] = """
SELECT count(*) FILTER (WHERE c_name LIKE 'Customer%') AS all_count, count(*) FILTER (WHERE c_name LIKE '%1') AS ones_count,
       count(*) FILTER (WHERE c_name LIKE '%#_%5_') AS fifties FROM customer"""
ORACLES["without_prefix"] = "SELECT c_custkey, c_name FROM customer WHERE c_name NOT LIKE 'Customer#_______1%'"

# -- logs, tags, files ----------------------------------------------------------------------------

LOG = """
log AS (
  SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END AS level, props AS message
  FROM events
), stored AS (SELECT * FROM log WHERE level IN ('WARNING', 'ERROR', 'CRITICAL'))"""
ORACLES["log_stored"] = with_(LOG) + "SELECT * FROM stored"
ORACLES["log_latest"] = with_(LOG) + "SELECT * FROM stored ORDER BY id DESC LIMIT 200"
ORACLES["log_latest_errors"] = with_(LOG) + "SELECT * FROM stored WHERE level = 'ERROR' ORDER BY id DESC LIMIT 50"
ORACLES["prefix_ascii"] = """
SELECT event_id, coalesce(nullif(regexp_replace(lower(regexp_replace(trim(props), '[^a-zA-Z0-9_]', '_', 'g')), '^_+|_+$', '', 'g'), ''), 'default') AS prefix
FROM events"""
ORACLES["prefix_cjk"] = """
WITH p AS (SELECT c_custkey, 'futianz6e1d_' || lower(replace(c_name, '#', '')) AS prefix FROM customer)
SELECT *, prefix || '_recall_results' AS recall_table, prefix || '_match_results' AS match_table FROM p"""
ORACLES["schema_align"] = f"""
SELECT o_orderkey::VARCHAR AS enterprise_id, o_orderpriority AS enterprise_name, NULL::VARCHAR AS enterprise_address,
       NULL::VARCHAR AS address_id, NULL::VARCHAR AS standard_address, NULL::VARCHAR AS room_no, 0.0::DOUBLE AS partial_match,
       round((o_totalprice / 1e6)::FLOAT::DOUBLE, 6) AS exact_match, 0.0::DOUBLE AS not_match, o_orderstatus AS match_status,
       '{vocab.SOURCE_AUTO}' AS correction_source FROM orders"""
ORACLES["null_and_blank"] = with_(TURNS) + f"""
SELECT id, {strip("coalesce(next_text, '')")} AS stripped, nullif(next_text, '') AS nulled FROM turns"""
ORACLES["csv_round_trip"] = """
SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_acctbal::DECIMAL(15, 2)::VARCHAR AS c_acctbal,
       c_mktsegment FROM customer"""
