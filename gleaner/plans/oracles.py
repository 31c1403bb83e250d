"""DuckDB SQL for the queries: the same results by plain relational steps."""

from __future__ import annotations

from gleaner.operators.evaluation import BOOTSTRAP_SEEDS
from gleaner.plans.tables import DIMENSIONS

SPACES = "regexp_replace({}, '\\s+', ' ', 'g')"


def normal(text: str) -> str:
    return "trim(" + SPACES.format(f"replace(lower(coalesce({text}, '')), 'ё', 'е')") + ")"


def words(text: str) -> str:
    return f"regexp_extract_all({normal(text)}, '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def hyphen_words(text: str) -> str:
    return f"list_distinct(regexp_extract_all({normal(text)}, '[\\p{{L}}\\p{{N}}_][\\p{{L}}\\p{{N}}_-]*[\\p{{L}}\\p{{N}}_]'))"


def grams(words_: str, n: int) -> str:
    return f"list_transform(range(greatest(len({words_}) - {n - 1}, 0)), lambda i: array_to_string({words_}[i + 1:i + {n}], ' '))"


def char_grams(text: str, n: int) -> str:
    """Of one n: each padded word's windows, or the padded word itself if it is shorter."""
    padded = f"list_transform(list_filter(string_split({text}, ' '), lambda w: length(w) > 0), lambda w: ' ' || w || ' ')"
    return f"flatten(list_transform({padded}, lambda w: list_transform(range(greatest(length(w) - {n - 1}, 1)), lambda i: substr(w, i + 1, {n}))))"


def longer_char_grams(text: str, n: int) -> str:
    padded = f"list_transform(list_filter(string_split({text}, ' '), lambda w: length(w) > 0), lambda w: ' ' || w || ' ')"
    return f"flatten(list_transform({padded}, lambda w: list_transform(range(greatest(length(w) - {n - 1}, 0)), lambda i: substr(w, i + 1, {n}))))"


ITEMS = """
items AS (
  SELECT doc_id AS item_id, lang AS category, source AS location, split_part(text, chr(10), 1) AS title,
         coalesce(source, '') AS params, substr(text, length(split_part(text, chr(10), 1)) + 2) AS description
  FROM documents),
asked AS (SELECT item_id AS query_id, category, location, title, params FROM items WHERE item_id % 100 = 0),
relevant AS (
  SELECT q.doc_id AS query_id, d.doc_id AS item_id FROM documents q JOIN documents d ON q.text = d.text WHERE q.doc_id % 100 = 0)"""

ALL_TEXT = normal("title") + " || ' ' || " + normal("params") + " || ' ' || " + normal("description")
ASKED_TEXT = normal("title") + " || ' ' || " + normal("params")


def channel(name: str, item_terms: str, query_terms: str, scoring: str = "bm25", min_df: int = 2, max_df: float = 0.99, features: int = 200_000, k: int = 500, cut: tuple[str, str] = ("NULL", "NULL")) -> str:
    """CTEs that end in <name>(query_id, item_id, score, rank). `cut` gives items and queries a column `toks` for the terms to use."""
    n = "(SELECT count(*) FROM items)"
    sql = f"""
{name}_occ AS (SELECT item_id, category, unnest({item_terms}) AS term FROM (SELECT *, {cut[0]} AS toks FROM items)),
{name}_tf AS (SELECT item_id, category, term, count(*) AS tf FROM {name}_occ GROUP BY item_id, category, term),
{name}_all AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM {name}_tf GROUP BY term),
{name}_vocab AS (SELECT term, df, cf FROM {name}_all WHERE df >= {min_df} AND df <= {max_df} * {n} ORDER BY cf DESC, term LIMIT {features}),
{name}_qocc AS (SELECT query_id, category, unnest({query_terms}) AS term FROM (SELECT *, {cut[1]} AS toks FROM asked)),"""
    if scoring == "bm25":
        sql += f"""
{name}_len AS (SELECT item_id, sum(tf) AS len FROM {name}_tf JOIN {name}_vocab USING (term) GROUP BY item_id),
{name}_avg AS (SELECT sum(len) / {n}::DOUBLE AS avg_len FROM {name}_len),
{name}_w AS (
  SELECT t.item_id, t.category, t.term,
         ln(1 + ({n} - v.df + 0.5) / (v.df + 0.5)) * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * l.len / a.avg_len)) AS w
  FROM {name}_tf t JOIN {name}_vocab v USING (term) JOIN {name}_len l USING (item_id) CROSS JOIN {name}_avg a),
{name}_q AS (SELECT DISTINCT query_id, category, term, 1.0::DOUBLE AS w FROM {name}_qocc),"""
    else:
        weight = f"(1 + ln(tf)) * (ln((1 + {n}) / (1 + df)::DOUBLE) + 1)"
        sql += f"""
{name}_raw AS (SELECT item_id, category, term, {weight} AS raw FROM {name}_tf JOIN {name}_vocab USING (term)),
{name}_w AS (SELECT item_id, category, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY item_id)) AS w FROM {name}_raw),
{name}_qtf AS (SELECT query_id, category, term, count(*) AS tf FROM {name}_qocc GROUP BY query_id, category, term),
{name}_qraw AS (SELECT query_id, category, term, {weight} AS raw FROM {name}_qtf JOIN {name}_vocab USING (term)),
{name}_q AS (SELECT query_id, category, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS w FROM {name}_qraw),"""
    return sql + f"""
{name}_s AS (
  SELECT q.query_id, d.item_id, round(sum(q.w * d.w), 9) AS score
  FROM {name}_q q JOIN {name}_w d ON q.term = d.term AND q.category = d.category GROUP BY q.query_id, d.item_id),
{name} AS (SELECT * FROM (
  SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM {name}_s) WHERE rank <= {k})"""


WORD = channel("word", words(ALL_TEXT), words(ASKED_TEXT))
TFIDF = channel("tfidf", words("title"), words("title"), "tfidf", max_df=1.0)
WHOLE_TFIDF = channel("whole", words(ALL_TEXT), words(ASKED_TEXT), "tfidf", max_df=1.0)
CHAR = channel("chars", char_grams(ALL_TEXT, 4), char_grams(ASKED_TEXT, 4), max_df=1.0, features=150_000)

DENSE = f"""
tokens_ AS (SELECT DISTINCT unnest({words("title")}) AS token FROM items),
vectors AS (
  SELECT token, unnest(list_transform(range({DIMENSIONS}), lambda i: (('0x' || substr(md5(token), 2 * i + 1, 2))::INTEGER::DOUBLE - 127.5) / 127.5)) AS x,
         unnest(range({DIMENSIONS})) AS i FROM tokens_),
pooled_raw AS (
  SELECT o.item_id, o.category, v.i, sum(v.x) AS x
  FROM (SELECT item_id, category, unnest({words("title")}) AS token FROM items) o JOIN vectors v USING (token) GROUP BY o.item_id, o.category, v.i),
pooled AS (SELECT item_id, category, i, x / nullif(sqrt(sum(x * x) OVER (PARTITION BY item_id)), 0) AS x FROM pooled_raw),
dense_s AS (
  SELECT q.item_id AS query_id, d.item_id, round(sum(coalesce(q.x, 0) * coalesce(d.x, 0)), 9) AS score
  FROM pooled q JOIN pooled d ON q.i = d.i AND q.category = d.category WHERE q.item_id % 100 = 0 GROUP BY q.item_id, d.item_id),
dense AS (SELECT * FROM (
  SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM dense_s) WHERE rank <= 500)"""

UNITED = """
united AS (
  SELECT 'word' AS channel, query_id, item_id, score, rank FROM word
  UNION ALL SELECT 'char', query_id, item_id, score, rank FROM chars
  UNION ALL SELECT 'dense', query_id, item_id, score, rank FROM dense)"""


def minmax(source: str, by: str) -> str:
    return f"""SELECT *, CASE WHEN max(score) OVER (PARTITION BY {by}) - min(score) OVER (PARTITION BY {by}) <= 1.1920928955078125e-07 THEN 0.0
      ELSE (score - min(score) OVER (PARTITION BY {by})) / (max(score) OVER (PARTITION BY {by}) - min(score) OVER (PARTITION BY {by})) END AS norm FROM {source}"""


def boosted(scores: str, bonus: float, k: int = 50) -> str:
    return f"""
SELECT query_id, item_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (
  SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
    SELECT s.query_id, s.item_id, round(s.score + CASE WHEN i.location = q.location THEN {bonus} ELSE 0.0 END, 9) AS score
    FROM {scores} s JOIN asked q USING (query_id) JOIN items i ON s.item_id = i.item_id)) WHERE rank <= {k}"""


def ranked(name: str, k: int = 50) -> str:
    return f"SELECT query_id, item_id, round(score, 6) AS score, rank::INTEGER AS rank FROM {name} WHERE rank <= {k}"


MEAN = f"fused AS (SELECT query_id, item_id, sum(norm) / 3 AS score FROM ({minmax('united', 'channel, query_id')}) GROUP BY query_id, item_id)"
RRF = f"""summed AS (SELECT query_id, item_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM united GROUP BY query_id, item_id),
fused AS (SELECT query_id, item_id, norm AS score FROM ({minmax('summed', 'query_id')}))"""

CLICKS = """
clicks AS (
  SELECT o_custkey AS customer, l_partkey AS item_id, l_returnflag AS category, l_linestatus AS location
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def popular(by: str) -> str:
    keys, over = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    return f"""
SELECT * FROM (
  SELECT {keys}item_id, n, (row_number() OVER ({over}ORDER BY n DESC, item_id))::INTEGER AS rank
  FROM (SELECT {keys}item_id, count(*) AS n FROM clicks GROUP BY {keys}item_id)) WHERE rank <= 50"""


def split(mode: str, size: int = 40) -> str:
    least = 2 if mode == "warm" else 1
    return f"""
WITH train AS (SELECT p_name, p_brand, l_suppkey AS item_id FROM lineitem JOIN part ON l_partkey = p_partkey),
sig AS (
  SELECT DISTINCT p_name, p_brand, {normal("p_name")} AS text,
         sha1('20260918|(''' || p_name || ''', ''' || p_brand || ''')') AS sig_hash FROM train),
per AS (SELECT text, count(*) AS n, arg_min(p_name, sig_hash) AS p_name, arg_min(p_brand, sig_hash) AS p_brand FROM sig GROUP BY text),
chosen AS (SELECT text, p_name, p_brand FROM per WHERE n >= {least} ORDER BY sha1('20260918|' || text), text LIMIT {size})
SELECT c.text, c.p_brand, count(DISTINCT t.item_id) AS n, array_to_string(list_transform(list_sort(list(DISTINCT t.item_id)), lambda x: x::VARCHAR), ' ') AS positives
FROM chosen c JOIN train t ON t.p_name = c.p_name AND t.p_brand = c.p_brand GROUP BY c.text, c.p_brand"""


RECALLS = """
hits_ AS (
  SELECT r.query_id, count(w.item_id) AS hits, count(*) AS relevant
  FROM (SELECT DISTINCT query_id, item_id FROM relevant) r
  LEFT JOIN (SELECT query_id, item_id FROM word WHERE rank <= 50) w ON r.query_id = w.query_id AND r.item_id = w.item_id GROUP BY r.query_id),
recalls AS (SELECT query_id, hits, relevant, hits / relevant::DOUBLE AS recall FROM hits_)"""


def pool(name: str, source: str) -> str:
    return f"""SELECT '{name}' AS pool, count(*) AS queries, round(avg(recall), 6) AS recall, count(*) FILTER (WHERE recall > 0) AS queries_with_hit FROM (
  SELECT r.query_id, count(c.item_id) / count(*)::DOUBLE AS recall FROM (SELECT DISTINCT query_id, item_id FROM relevant) r
  LEFT JOIN (SELECT DISTINCT query_id, item_id FROM {source}) c ON r.query_id = c.query_id AND r.item_id = c.item_id GROUP BY r.query_id)"""


def coverage(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b})) / len({a})::DOUBLE ELSE 0.0 END"


PAIRS = f"""
base AS (SELECT i.*, l.quality, l.toxic, 'src0 ' || coalesce(category, '') AS asked_params,
    array_to_string(string_split(description, ' ')[1:2], ' ') || ' ' || split_part(title, ' ', 1) AS query
  FROM items i LEFT JOIN labels l ON i.item_id = l.doc_id),
cut_ AS (SELECT *, {hyphen_words("query")} AS tq, {hyphen_words("title")} AS tt, {hyphen_words("params")} AS tp, {hyphen_words("description")} AS td, {hyphen_words("asked_params")} AS ta,
    {normal("query")} AS nq, {normal("title")} AS nt, {normal("description")} AS nd FROM base),
features AS (
  SELECT item_id, quality, {coverage("tq", "tt")} AS title_query_coverage, {coverage("tq", "tp")} AS params_query_coverage, {coverage("tq", "td")} AS description_query_coverage,
         {coverage("tq", "list_concat(tt, tp, td)")} AS all_text_query_coverage, {coverage("ta", "tp")} AS params_filter_coverage,
         CASE WHEN length(nq) > 0 AND contains(nt, nq) THEN 1.0::DOUBLE ELSE 0.0 END AS exact_query_in_title,
         CASE WHEN length(nq) > 0 AND contains(nd, nq) THEN 1.0::DOUBLE ELSE 0.0 END AS exact_query_in_description,
         (coalesce(category = 'en', false))::INTEGER::DOUBLE AS category_match, (coalesce(location = 'src0', false))::INTEGER::DOUBLE AS location_match,
         ln(1 + coalesce(length(description), 0)::DOUBLE) AS log_reviews, coalesce(quality, 0)::DOUBLE AS rating,
         CASE WHEN toxic IS NULL OR toxic = 1 THEN 0.0::DOUBLE ELSE 1.0 END AS phone_visible,
         CASE WHEN quality IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS messages_allowed,
         ln(1 + coalesce(length(title), 0)::DOUBLE) AS log_train_click_frequency
  FROM cut_)"""
FEATURES = (
    "title_query_coverage", "params_query_coverage", "description_query_coverage", "all_text_query_coverage", "params_filter_coverage", "exact_query_in_title", "exact_query_in_description",
    "category_match", "location_match", "log_reviews", "rating", "phone_visible", "messages_allowed", "log_train_click_frequency",
)


def separated(name: str) -> str:
    p, n = f"avg({name}) FILTER (WHERE quality = 1)", f"avg({name}) FILTER (WHERE quality = 0)"
    return f"SELECT '{name}' AS feature, round({p}, 6) AS mean_positive, round({n}, 6) AS mean_negative, round({p} - {n}, 6) AS difference, round(corr({name}, quality::DOUBLE), 6) AS correlation FROM features WHERE quality IS NOT NULL"


def profiled(name: str, kind: str, value: str) -> str:
    return f"SELECT '{name}' AS \"column\", '{kind}' AS kind, count(*) AS row_count, count(*) FILTER (WHERE {name} IS NULL) AS nulls, count(DISTINCT {name}) AS \"distinct\", quantile_cont({value}, 0.0) AS low, quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 1.0) AS high FROM customer"


GRID = f"""
WITH {ITEMS}, {WORD}, {CHAR},
both_ AS (
  SELECT query_id, item_id, max(a) AS a, max(b) AS b FROM (
    SELECT query_id, item_id, score AS a, NULL::DOUBLE AS b FROM word UNION ALL SELECT query_id, item_id, NULL, score FROM chars) GROUP BY query_id, item_id),
grid AS (SELECT w.weight, x.bonus FROM (VALUES (0.0::DOUBLE), (0.25), (1.0)) w(weight), (VALUES (0.0::DOUBLE), (0.5)) x(bonus)),
scored AS (
  SELECT g.weight, g.bonus, c.query_id, c.item_id,
         round((1 - g.weight) * coalesce(c.a, 0) + g.weight * coalesce(c.b, 0) + CASE WHEN i.location = q.location THEN g.bonus ELSE 0 END, 9) AS score
  FROM both_ c JOIN asked q USING (query_id) JOIN items i ON c.item_id = i.item_id CROSS JOIN grid g
  WHERE (g.weight < 1 AND c.a IS NOT NULL) OR (g.weight > 0 AND c.b IS NOT NULL)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY weight, bonus, query_id ORDER BY score DESC, item_id) AS n FROM scored) WHERE n <= 50),
recalls AS (
  SELECT g.weight, g.bonus, r.query_id, count(b.item_id) / count(*)::DOUBLE AS recall
  FROM (SELECT DISTINCT query_id, item_id FROM relevant) r CROSS JOIN grid g
  LEFT JOIN best b ON b.weight = g.weight AND b.bonus = g.bonus AND b.query_id = r.query_id AND b.item_id = r.item_id GROUP BY g.weight, g.bonus, r.query_id)
SELECT weight, bonus, count(*) AS queries, round(avg(recall), 6) AS recall, count(*) FILTER (WHERE recall > 0) AS queries_with_hit FROM recalls GROUP BY weight, bonus"""

PRIORITY = f"""
WITH {CLICKS},
asked AS (SELECT c_custkey AS query_id, CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS category FROM customer),
own AS ({popular("customer")}), near AS ({popular("category")}), overall AS ({popular("")}),
lists AS (
  SELECT a.query_id, o.item_id, 0 AS priority, o.rank AS place FROM asked a JOIN own o ON a.query_id = o.customer
  UNION ALL SELECT a.query_id, n.item_id, 1, n.rank FROM asked a JOIN near n ON a.category = n.category
  UNION ALL SELECT a.query_id, o.item_id, 2, o.rank FROM asked a CROSS JOIN overall o),
once AS (SELECT query_id, item_id, min(priority * 1000 + place) AS spot FROM lists GROUP BY query_id, item_id)
SELECT * FROM (SELECT query_id, item_id, (row_number() OVER (PARTITION BY query_id ORDER BY spot, item_id))::INTEGER AS rank FROM once) WHERE rank <= 50"""

VIOLATIONS = f"""
WITH {CLICKS},
answer AS (SELECT customer::VARCHAR AS query_id, list(item_id::VARCHAR) AS ids FROM clicks GROUP BY customer),
asked AS (SELECT c_custkey::VARCHAR AS query_id FROM customer),
known AS (SELECT p_partkey::VARCHAR AS item FROM part WHERE p_size < 49)
SELECT 'query_id_length' AS rule, query_id FROM answer WHERE length(query_id) <> 3
UNION ALL SELECT 'unknown_query', query_id FROM answer WHERE query_id NOT IN (SELECT query_id FROM asked)
UNION ALL SELECT 'missing_query', query_id FROM asked WHERE query_id NOT IN (SELECT query_id FROM answer)
UNION ALL SELECT 'answer_size', query_id FROM answer WHERE len(ids) > 45
UNION ALL SELECT 'repeated_item', query_id FROM answer WHERE len(ids) <> len(list_distinct(ids))
UNION ALL SELECT 'item_format', query_id FROM answer WHERE len(list_filter(ids, lambda x: NOT regexp_full_match(x, '[0-9]{{1,3}}'))) > 0
UNION ALL SELECT DISTINCT 'unknown_item', query_id FROM (SELECT query_id, unnest(ids) AS item FROM answer) WHERE item NOT IN (SELECT item FROM known)"""


def _poisson() -> str:
    steps, total, term, sql = 12, 0.0, 0.36787944117144233, "0"
    for k in range(steps):
        total += term
        sql += f" + CASE WHEN u >= {total!r} THEN 1 ELSE 0 END"
        term /= k + 1
    return sql


BOOTSTRAP = f"""
WITH drawn AS (
  SELECT r.run, l.quality::DOUBLE AS recall,
         ('0x' || substr(md5('{BOOTSTRAP_SEEDS["cold"]}|' || r.run || '|' || l.doc_id), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
  FROM labels l CROSS JOIN (SELECT unnest(range(10)) AS run) r),
weighted AS (SELECT run, recall, {_poisson()} AS weight FROM drawn),
per AS (SELECT run, sum(weight * recall) / sum(weight) AS r FROM weighted GROUP BY run)
SELECT round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(min(r), 6) AS low, round(max(r), 6) AS high FROM per"""

BIGRAMS = channel("bi", *[f"list_concat(toks, {grams('toks', 2)})"] * 2, cut=(words(ALL_TEXT), words(ASKED_TEXT)))
HEAVY = channel("heavy", words(f"{normal('title')} || ' ' || {normal('title')} || ' ' || {ALL_TEXT}"), words(f"title || ' ' || {ASKED_TEXT}"), "tfidf")
RARE = channel("rare", words("title"), words("title"), min_df=6, max_df=0.9, k=50)

NEGATIVES = """
WITH h AS (SELECT doc_id, lang, ('0x' || substr(sha1('20260918|' || doc_id), 1, 12))::BIGINT AS h FROM documents),
n AS (SELECT greatest(1, count(*) // 100000) AS buckets FROM documents),
placed AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY h % buckets, h, doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM h, n),
drawn AS (SELECT doc_id, lang, place, n, ('0x' || substr(sha1('20260918|' || doc_id || '|' || doc_id), 1, 12))::BIGINT % (n - 1) AS x FROM placed WHERE n > 1)
SELECT d.doc_id AS query_id, d.doc_id AS item_id, d.lang AS category, p.doc_id AS negative
FROM drawn d JOIN placed p ON d.lang = p.lang AND p.place = d.x + (d.x >= d.place)::INTEGER"""

FINGERPRINT = """
WITH h AS (SELECT ('0x' || substr(md5(coalesce(md5(doc_id::VARCHAR), 'null') || coalesce(md5(text), 'null')), 1, 15))::BIGINT AS h FROM documents)
SELECT sha256('doc_id,text|' || count(*) || '|' || bit_xor(h) || '|' || sum(h)) AS fingerprint, count(*) AS n FROM h"""

ALL = normal("title || ' ' || description")

ORACLES: dict[str, str] = {
    "data_fingerprint": FINGERPRINT,
    "random_negatives": NEGATIVES,
    "word_bm25_topk": f"WITH {ITEMS}, {WORD} {ranked('word')}",
    "word_tfidf_topk": f"WITH {ITEMS}, {WHOLE_TFIDF} {ranked('whole')}",
    "word_bigram_bm25_topk": f"WITH {ITEMS}, {BIGRAMS} {ranked('bi')}",
    "weighted_composition_tfidf_topk": f"WITH {ITEMS}, {HEAVY} {ranked('heavy')}",
    "char_bm25_topk": f"WITH {ITEMS}, {CHAR} {ranked('chars')}",
    "pooled_cosine_topk": f"WITH {ITEMS}, {DENSE} {ranked('dense')}",
    "dense_cosine_topk": """
WITH parts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
unit AS (SELECT vec_id, label, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM parts),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS item_id, round(sum(q.x * d.x), 9) AS score FROM unit q JOIN unit d ON q.i = d.i AND q.label = d.label WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, d.vec_id)
SELECT query_id, item_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 50""",
    "fusion_mean_minmax": f"WITH {ITEMS}, {WORD}, {CHAR}, {DENSE}, {UNITED}, {MEAN} {boosted('fused', 0.5)}",
    "fusion_rrf": f"WITH {ITEMS}, {WORD}, {CHAR}, {DENSE}, {UNITED}, {RRF} {boosted('fused', 0.5)}",
    "fusion_no_bonus": f"WITH {ITEMS}, {WORD}, {CHAR}, {DENSE}, {UNITED}, {MEAN} {boosted('fused', 0.0)}",
    "location_boost": f"WITH {ITEMS}, {WORD} {boosted('word', 0.5)}",
    "weighted_blend": f"""WITH {ITEMS}, {TFIDF}, {CHAR},
blend AS (SELECT query_id, item_id, sum(score) AS score FROM (SELECT query_id, item_id, score FROM tfidf UNION ALL SELECT query_id, item_id, 0.25 * score FROM chars) GROUP BY query_id, item_id)
{boosted('blend', 0.0)}""",
    "grid_eval": GRID,
    "vocabulary_prune": f"WITH {ITEMS}, {WORD} SELECT term, df::BIGINT AS df, cf::BIGINT AS cf FROM word_vocab",
    "bm25_stats": f"""WITH {ITEMS}, {WORD}
SELECT (SELECT count(*) FROM items) AS n_docs, (SELECT count(*) FROM word_vocab) AS n_terms, (SELECT sum(df) FROM word_vocab)::BIGINT AS nnz, round((SELECT avg_len FROM word_avg), 6) AS avg_len,
round((SELECT min(ln(1 + ((SELECT count(*) FROM items) - df + 0.5) / (df + 0.5))) FROM word_vocab), 6) AS idf_min,
round((SELECT max(ln(1 + ((SELECT count(*) FROM items) - df + 0.5) / (df + 0.5))) FROM word_vocab), 6) AS idf_max""",
    "normalized_text": f"""SELECT doc_id, md5({normal("text")}) AS normalized, length({normal("text")})::BIGINT AS n_chars,
length(trim(lower(coalesce(text, ''))))::BIGINT AS n_basic, strlen({normal("text")})::BIGINT AS n_bytes FROM documents""",
    "token_counts": f"SELECT doc_id, len({words('text')})::BIGINT AS n_tokens, len(list_distinct({words('text')}))::BIGINT AS n_distinct, len({hyphen_words('text')})::BIGINT AS n_hyphen FROM documents",
    "word_bigram_counts": f"SELECT * FROM (WITH {ITEMS}, w AS (SELECT {words(ALL_TEXT)} AS terms FROM items) SELECT gram, count(*) AS n FROM (SELECT unnest({grams('terms', 2)}) AS gram FROM w) GROUP BY gram) WHERE n >= 2",
    "char_wb_counts": f"WITH {ITEMS} SELECT gram, count(*) AS n FROM (SELECT unnest(list_concat({char_grams(ALL, 3)}, {longer_char_grams(ALL, 4)})) AS gram FROM items) GROUP BY gram",
    "stable_hashes": "SELECT doc_id, sha1('20260918|' || source || '|' || doc_id) AS digest FROM documents",
    "token_coverage": f"WITH {ITEMS}, t AS (SELECT item_id, {hyphen_words('title')} AS tt, {hyphen_words('description')} AS td FROM items) SELECT item_id, round({coverage('tt', 'td')}, 6) AS coverage FROM t",
    "l2_normalized": """WITH parts AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
unit AS (SELECT vec_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM parts) SELECT vec_id, round(sum(x * (i + 1)), 6) AS checksum FROM unit GROUP BY vec_id""",
    "category_remap": "SELECT vec_id, CASE WHEN label = 0 THEN 114 ELSE label END AS category FROM embeddings",
    "popularity_global": f"WITH {CLICKS} {popular('')}",
    "popularity_by_category": f"WITH {CLICKS} {popular('category')}",
    "popularity_by_category_location": f"WITH {CLICKS} {popular('category, location')}",
    "query_history_priority": PRIORITY,
    "fallback_fill": f"""WITH {ITEMS}, {RARE},
empty AS (SELECT * FROM asked WHERE query_id NOT IN (SELECT query_id FROM rare)),
near AS (SELECT * FROM (SELECT e.query_id, i.item_id, row_number() OVER (PARTITION BY e.query_id ORDER BY i.item_id) AS rank FROM empty e JOIN items i ON e.category = i.category AND e.location = i.location) WHERE rank <= 50),
wide AS (SELECT * FROM (SELECT e.query_id, i.item_id, row_number() OVER (PARTITION BY e.query_id ORDER BY i.item_id) AS rank FROM empty e JOIN items i ON e.category = i.category
  WHERE e.query_id NOT IN (SELECT query_id FROM near)) WHERE rank <= 50)
SELECT query_id, item_id, round(score, 6) AS score, rank::INTEGER AS rank FROM rare
UNION ALL SELECT query_id, item_id, 0.0, rank::INTEGER FROM near UNION ALL SELECT query_id, item_id, 0.0, rank::INTEGER FROM wide""",
    "history_counts": "SELECT c_custkey AS o_custkey, count(o_orderkey) AS history_rows FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "history_anti_join": """SELECT o_orderkey, o_custkey, o_orderpriority FROM orders o WHERE NOT EXISTS (
  SELECT 1 FROM orders h WHERE h.o_orderstatus = 'P' AND h.o_custkey = o.o_custkey AND h.o_orderpriority = o.o_orderpriority)""",
    "history_text_anti_join": "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "signature_positives": f"""WITH {CLICKS} SELECT customer, category, count(DISTINCT item_id) AS n,
array_to_string(list_transform(list_sort(list(DISTINCT item_id)), lambda x: x::VARCHAR), ' ') AS positives FROM clicks GROUP BY customer, category""",
    "hash_split_cold": split("cold"),
    "hash_split_warm": split("warm"),
    "hash_split_cold_2500": split("cold", 2500),
    "hash_split_warm_2500": split("warm", 2500),
    "recall_at_k": f"WITH {ITEMS}, {WORD}, {RECALLS} SELECT query_id, hits, relevant, round(recall, 6) AS recall FROM recalls",
    "recall_summary": f"WITH {ITEMS}, {WORD}, {RECALLS} SELECT count(*) AS queries, round(avg(recall), 6) AS recall, count(*) FILTER (WHERE recall > 0) AS queries_with_hit FROM recalls",
    "pool_recall": f"WITH {ITEMS}, {WORD}, {CHAR}, {DENSE}, {UNITED} " + " UNION ALL ".join(pool(n, s) for n, s in (("word", "word"), ("char", "chars"), ("dense", "dense"), ("union", "united"))),
    "mode_mixture_pivot": """WITH m AS (SELECT event_type, avg(value) FILTER (WHERE user_id % 2 = 0) AS cold, avg(value) FILTER (WHERE user_id % 2 <> 0) AS warm FROM events GROUP BY event_type)
SELECT event_type, round(cold, 6) AS cold, round(warm, 6) AS warm, round(0.63 * cold + 0.37 * warm, 6) AS mix FROM m""",
    "pairwise_delta": """WITH m AS (SELECT o_orderpriority, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY o_orderpriority)
SELECT o_orderpriority, round(f, 4) AS status_f, round(o, 4) AS status_o, round(o - f, 4) AS delta FROM m""",
    "best_config": """WITH m AS (SELECT user_id, event_type, round(round(avg(value), 6), 12) AS mix FROM events GROUP BY user_id, event_type)
SELECT * FROM (SELECT user_id, event_type, mix, (row_number() OVER (ORDER BY mix DESC, user_id, event_type))::INTEGER AS rank FROM m) WHERE rank <= 20""",
    "bootstrap_recall": BOOTSTRAP,
    "column_profile": " UNION ALL ".join([
        profiled("c_custkey", "bigint", "c_custkey::DOUBLE"), profiled("c_name", "string", "length(c_name)::DOUBLE"), profiled("c_nationkey", "int", "c_nationkey::DOUBLE"),
        profiled("c_acctbal", "double", "c_acctbal"), profiled("c_mktsegment", "string", "length(c_mktsegment)::DOUBLE"),
    ]),
    "quantiles": "SELECT share, value FROM (" + " UNION ALL ".join(f"SELECT {s}::DOUBLE AS share, quantile_cont(length(coalesce(text, ''))::DOUBLE, {s}) AS value FROM documents" for s in (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)) + ")",
    "value_counts": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "group_counts": f"WITH {CLICKS} SELECT customer, count(*) AS row_count, count(DISTINCT item_id) AS items FROM clicks GROUP BY customer",
    "match_rates": "SELECT round(avg(CASE WHEN l_returnflag = l_linestatus THEN 1 ELSE 0 END), 6) AS flag_is_status, round(avg(CASE WHEN l_partkey = l_suppkey THEN 1 ELSE 0 END), 6) AS part_is_supplier FROM lineitem",
    "overlap_counts": """SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS left_ids, (SELECT count(DISTINCT doc_id) FROM labels) AS right_ids,
(SELECT count(DISTINCT d.doc_id) FROM documents d JOIN labels l ON d.doc_id = l.doc_id) AS both""",
    "malformed_ids": "SELECT c_custkey, c_name FROM customer WHERE NOT regexp_full_match(c_name, 'Customer#[0-9]*[02468]')",
    "first_row_distinct": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS n FROM orders) WHERE n = 1",
    "pair_features": f"WITH {ITEMS}, {PAIRS} SELECT item_id, " + ", ".join(f"round({f}, 6) AS {f}" for f in FEATURES) + " FROM features",
    "feature_label_corr": f"WITH {ITEMS}, {PAIRS} " + " UNION ALL ".join(map(separated, ("title_query_coverage", "category_match", "location_match", "log_reviews", "log_train_click_frequency"))),
    "zero_vector_count": "SELECT count(*) AS n, count(*) FILTER (WHERE len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zero FROM embeddings",
    "submission_format": f"""WITH {ITEMS}, {WORD} SELECT a.query_id::VARCHAR AS query_id, coalesce(string_agg(w.item_id::VARCHAR, ' ' ORDER BY w.rank), '') AS answer
FROM asked a LEFT JOIN (SELECT * FROM word WHERE rank <= 50) w ON a.query_id = w.query_id GROUP BY a.query_id""",
    "submission_violations": VIOLATIONS,
    "windowed_events": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
