"""DuckDB SQL of the registered queries, on the given tables as views."""

from __future__ import annotations

from .oracle_text import CHI2, CLEANED, FILENAME, FITTED, MEANS, clean_sql, removed_sql, stripped_sql, terms_ctes, weights_cte
from .phrases import phrased_sql

ROUNDED_MEANS = """feature_index, feature_name, round(useful_mean_tfidf, 6) AS useful_mean_tfidf,
  round(not_useful_mean_tfidf, 6) AS not_useful_mean_tfidf, round(difference, 6) AS difference"""

SQL: dict[str, str] = {}

SQL["clean_documents"] = f"SELECT doc_id, {clean_sql('text')} AS clean FROM documents"
SQL["clean_keep_case"] = f"SELECT doc_id, {clean_sql('text', lower=False)} AS clean FROM documents"
SQL["clean_keep_specials"] = f"SELECT doc_id, {clean_sql('text', special=False)} AS clean FROM documents"
SQL["clean_pages"] = f"SELECT page_id, {clean_sql(chr(39).join(['url || ', ' ', ' || html']))} AS clean FROM pages"
SQL["preprocess_report"] = f"""WITH {CLEANED}
SELECT filename, length(text)::INTEGER AS n_raw, length(clean)::INTEGER AS n_clean,
  round((1 - length(clean) / length(text)) * 100, 1) AS reduction,
  substring(text, 1, 500) AS raw_head, substring(clean, 1, 500) AS clean_head,
  {removed_sql('text', 'clean')} AS removed
FROM cleaned ORDER BY filename LIMIT 5"""
SQL["removed_keywords"] = f"""WITH {CLEANED}
SELECT filename, {removed_sql('text', 'clean')} AS removed FROM cleaned WHERE {removed_sql('text', 'clean')} <> ''"""
SQL["preprocess_stats"] = f"""WITH {CLEANED}, s AS (
  SELECT count(*) AS n_docs, coalesce(sum(length(text)), 0)::BIGINT AS raw_chars,
         coalesce(sum(length(clean)), 0)::BIGINT AS clean_chars FROM cleaned)
SELECT *, CASE WHEN raw_chars > 0 THEN round((1 - clean_chars / raw_chars) * 100, 6) ELSE 0 END AS reduction FROM s"""
SQL["document_lengths"] = f"""WITH {CLEANED}
SELECT doc_id, length(text)::INTEGER AS n_raw, length(clean)::INTEGER AS n_clean,
  round(CASE WHEN length(text) > 0 THEN (1 - length(clean) / length(text)) * 100 ELSE 0 END, 6) AS reduction
FROM cleaned"""

SQL["vocabulary"] = f"WITH {FITTED} SELECT feature_index, feature_name, df, ctf, round(idf, 6) AS idf FROM vocab"
SQL["tfidf_long"] = f"WITH {FITTED} SELECT doc_id, feature_index, round(tfidf, 6) AS tfidf FROM weight"
SQL["tfidf_transform_unseen"] = f"""WITH {FITTED},
unseen AS (SELECT item_id AS doc_id, {clean_sql('text')} AS clean FROM benchmark),
{terms_ctes('unseen', 'new_')}, {weights_cte('new_weight', 'new_tf')}
SELECT doc_id, feature_index, round(tfidf, 6) AS tfidf FROM new_weight"""
SQL["class_mean_tfidf"] = f"WITH {FITTED}, {MEANS} SELECT {ROUNDED_MEANS} FROM means"
SQL["top_useful_terms"] = f"""WITH {FITTED}, {MEANS}
SELECT {ROUNDED_MEANS} FROM means m ORDER BY round(m.difference, 12) DESC, feature_index LIMIT 50"""
SQL["top_not_useful_terms"] = f"""WITH {FITTED}, {MEANS}
SELECT {ROUNDED_MEANS} FROM means m ORDER BY round(m.difference, 12), feature_index LIMIT 50"""
SQL["noise_terms"] = f"""WITH {FITTED}, {MEANS},
a AS (SELECT feature_name FROM means ORDER BY round(difference, 12) DESC, feature_index LIMIT 1200),
b AS (SELECT feature_name FROM means ORDER BY round(difference, 12), feature_index LIMIT 1200)
SELECT feature_name FROM a INTERSECT SELECT feature_name FROM b"""
SQL["chi2_scores"] = f"WITH {FITTED}, {CHI2} SELECT feature_index, feature_name, round(chi2, 6) AS chi2 FROM chi2"
SQL["chi2_selected"] = f"""WITH {FITTED}, {CHI2},
kept AS (SELECT feature_index FROM chi2 ORDER BY round(chi2, 12) DESC NULLS LAST, feature_index DESC LIMIT 1000)
SELECT doc_id, feature_index, round(tfidf, 6) AS tfidf FROM weight SEMI JOIN kept USING (feature_index)"""

# Sources

SQL["file_info"] = """WITH f AS (
  SELECT 'corpus/' || source || '/' || printf('%05d.txt', doc_id) AS path, doc_id, strlen(text) AS length FROM documents)
SELECT path, printf('%05d.txt', doc_id) AS filename, printf('%05d', doc_id) AS doc_id, round(length / 1024, 6) AS size_kb FROM f"""
SQL["decoded_texts"] = "SELECT doc_id, text FROM documents WHERE text <> ''"
SQL["assemble_pages"] = r"""SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text
FROM conversations WHERE turn % 3 <> 1 AND text <> '' GROUP BY conv_id"""
SQL["extraction_cascade"] = f"""WITH c AS (
  SELECT conv_id AS doc_id, role AS extractor, turn, CASE WHEN turn % 4 = 0 THEN regexp_replace(text, '[a-z]', '', 'g') WHEN turn % 4 <> 3 THEN text END AS text FROM conversations),
m AS (SELECT *, coalesce(length({stripped_sql('text')}), 0) >= 50 AS enough FROM c)
SELECT doc_id, extractor, coalesce(text, '') AS text FROM m
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY enough DESC, CASE WHEN enough THEN turn ELSE -turn END) = 1"""
TEXT_CACHE = "old AS (SELECT page_id AS doc_id, CASE WHEN page_id % 7 = 0 THEN '  ' ELSE html END AS text FROM pages)"
SQL["cache_split"] = f"""WITH {TEXT_CACHE}
SELECT d.doc_id, coalesce(o.text, d.text) AS text, o.text IS NOT NULL AS cached
FROM documents d LEFT JOIN (SELECT * FROM old WHERE trim(text) <> '') o USING (doc_id)"""
SQL["cache_counts"] = f"""WITH r AS ({SQL['cache_split']})
SELECT count(*) AS total, count(*) FILTER (cached) AS cached, count(*) FILTER (NOT cached) AS extracted FROM r"""
SQL["first_cached"] = f"""WITH {TEXT_CACHE}
SELECT d.doc_id, coalesce(b.text, c.text, o.text) AS text FROM documents d
LEFT JOIN benchmark b ON d.doc_id = b.item_id
LEFT JOIN ({SQL['assemble_pages']}) c ON d.doc_id = c.doc_id LEFT JOIN old o ON d.doc_id = o.doc_id"""
SQL["cache_stats"] = """SELECT count(*) AS cached_files, round(sum(strlen(text)) / 1048576, 2) AS total_size_mb FROM documents"""
SQL["merge_by_stem"] = """WITH u AS (
  SELECT doc_id, text, 1 AS priority FROM documents UNION ALL SELECT page_id, url, 2 FROM pages
  UNION ALL SELECT item_id, text, 3 FROM benchmark)
SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC) = 1"""
SQL["file_dispatch"] = """SELECT page_id, 'page' || page_id AS stem,
  CASE page_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'pdf' ELSE 'unsupported' END AS file_type FROM pages"""

# Labels

LISTED = """listed AS (
  SELECT doc_id, printf('%05d.txt', doc_id) AS filename, quality AS y,
         CASE WHEN quality = 1 THEN 'useful' ELSE 'not_useful' END AS label,
         CASE WHEN toxic = 1 THEN 'useful' ELSE 'not_useful' END AS rare FROM labels)"""


def split_ctes(source: str, label: str = "label", out: str = "placed") -> str:
    return f"""{out}_n AS (SELECT {label} AS label, count(*) AS n_c FROM {source} GROUP BY {label}),
{out}_t AS (SELECT *, sum(n_c) OVER () AS n, sum(n_c) OVER () - ceil(sum(n_c) OVER () * 0.25) AS n_train FROM {out}_n),
{out}_f AS (SELECT label, n_train, floor(n_train * n_c / n) AS whole, n_train * n_c / n - floor(n_train * n_c / n) AS rest FROM {out}_t),
{out}_q AS (SELECT label, whole + (row_number() OVER (ORDER BY round(rest, 9) DESC, label)
            <= n_train - sum(whole) OVER ())::INT AS quota FROM {out}_f),
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5(filename || '|42'), filename) AS r FROM {source}),
{out} AS (SELECT s.*, CASE WHEN r <= quota THEN 'train' ELSE 'test' END AS split
  FROM {out}_r s JOIN {out}_q q ON s.{label} = q.label)"""


PLACED = f"{LISTED}, {split_ctes('listed')}"
SQL["label_table"] = f"WITH {PLACED} SELECT filename, label, split FROM placed"
SQL["stratified_split"] = f"""WITH {LISTED}, {split_ctes('listed', 'rare')}
SELECT doc_id, rare AS label, split FROM placed"""
SQL["split_rows"] = f"WITH {PLACED} SELECT filename, label, split FROM placed WHERE split = 'test' AND label = 'useful'"
SQL["split_summary"] = f"""WITH {PLACED}, t AS (SELECT count(*) AS total FROM placed)
SELECT 'total' AS split, total AS n, 100.0::DOUBLE AS percent FROM t
UNION ALL SELECT split, count(*), round(count(*) * 100.0::DOUBLE / any_value(total), 1) FROM placed, t GROUP BY split"""
SQL["split_label_counts"] = f"""WITH {PLACED},
grid AS (SELECT s AS split, l AS label FROM unnest(['train', 'test']) a(s), unnest(['useful', 'not_useful']) b(l))
SELECT g.split, g.label, count(filename) AS n FROM grid g LEFT JOIN placed p ON g.split = p.split AND g.label = p.label GROUP BY ALL"""
SQL["class_balance"] = """WITH c AS (
  SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS useful, count(*) FILTER (toxic = 0) AS not_useful FROM labels)
SELECT n, useful, not_useful, round(useful * 100.0::DOUBLE / n, 1) AS useful_percent,
  round(not_useful * 100.0::DOUBLE / n, 1) AS not_useful_percent,
  round(not_useful::DOUBLE / useful, 6) AS ratio, not_useful::DOUBLE / useful > 5 AS imbalanced FROM c"""
SQL["class_weights"] = """SELECT toxic AS y, count(*) AS n,
  round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT toxic) FROM labels) * count(*)), 6) AS weight FROM labels GROUP BY toxic"""


def folds_ctes(source: str, label: str = "label", k: int = 5) -> str:
    """The definition itself: positions in the label-sorted list, counted per fold."""
    return f"""sorted AS (SELECT {label} AS label, row_number() OVER (ORDER BY {label}) - 1 AS p FROM {source}),
alloc AS (SELECT label, p % {k} AS fold, count(*) AS n FROM sorted GROUP BY ALL),
upto AS (SELECT label, fold, sum(n) OVER (PARTITION BY label ORDER BY fold) AS hi, n FROM alloc),
in_order AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY doc_id) AS r FROM {source}),
folded AS (SELECT s.*, fold::INTEGER AS fold FROM in_order s JOIN upto u ON s.{label} = u.label AND r > hi - n AND r <= hi)"""


SQL["fold_assignment"] = f"""WITH l AS (SELECT doc_id, quality AS label FROM labels), {folds_ctes('l')}
SELECT doc_id, label, fold FROM folded"""
SQL["label_lookup"] = """SELECT d.doc_id, coalesce(l.quality, 0)::INTEGER AS y FROM documents d LEFT JOIN labels l USING (doc_id)"""
SQL["unlabelled_docs"] = """SELECT printf('%05d.txt', doc_id) AS filename FROM documents ANTI JOIN labels USING (doc_id)"""
SQL["evaluation_rows"] = """SELECT doc_id, printf('%05d.txt', doc_id) AS filename, quality::INTEGER AS actual FROM documents JOIN labels USING (doc_id)"""
WANTED = f"""{PLACED},
folder AS (
  SELECT printf('%05d.txt', page_id) AS filename, 0 AS rank, 'not_useful' AS dir FROM pages
  UNION ALL SELECT printf('%05d.txt', conv_id * 5), 1, 'useful' FROM conversations),
best AS (SELECT filename, arg_min(dir, rank) AS dir FROM folder GROUP BY filename),
found AS (SELECT p.filename, label, dir FROM placed p LEFT JOIN best b USING (filename) WHERE split = 'train')"""
SQL["resolve_split"] = f"WITH {WANTED} SELECT filename, label, dir FROM found WHERE dir IS NOT NULL"
SQL["missing_split_files"] = f"WITH {WANTED} SELECT filename FROM found WHERE dir IS NULL"
SQL["drop_blank"] = r"""SELECT conv_id, turn,
  trim(CASE WHEN turn % 2 = 1 THEN regexp_replace(text, '[^ \n]', '', 'g') ELSE text END, e' \n') = '' AS skipped FROM conversations"""

# Features

SQL["combined_vector"] = f"""WITH {FITTED},
width AS (SELECT count(*)::INTEGER AS w FROM vocab),
member AS (SELECT t.doc_id, e.embedding FROM train t JOIN embeddings e ON t.doc_id = e.vec_id),
emb AS (SELECT doc_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM member)
SELECT doc_id, feature_index, round(tfidf, 6) AS value FROM weight SEMI JOIN member USING (doc_id)
UNION ALL SELECT doc_id, (w + i)::INTEGER, round(v, 6) FROM emb, width WHERE v <> 0"""
SQL["maxabs_scaled"] = """WITH e AS (
  SELECT vec_id AS doc_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS feature_index, unnest(embedding)::DOUBLE AS v FROM embeddings),
m AS (SELECT feature_index, max(abs(v)) AS m FROM e GROUP BY feature_index)
SELECT doc_id, feature_index, round(CASE WHEN m = 0 THEN 0 ELSE v / m END, 6) AS value FROM e JOIN m USING (feature_index)"""
SQL["embedding_hits"] = "SELECT doc_id FROM documents SEMI JOIN embeddings ON doc_id = vec_id"
SQL["embedding_misses"] = "SELECT doc_id FROM documents ANTI JOIN embeddings ON doc_id = vec_id"

# Evaluation

GUESSED = """guessed AS (
  SELECT doc_id, quality AS actual, (n_chars > 900)::INTEGER AS prediction FROM documents JOIN labels USING (doc_id))"""
CELLS = f"""{GUESSED}, cells AS (
  SELECT count(*) FILTER (actual = 0 AND prediction = 0) AS tn, count(*) FILTER (actual = 0 AND prediction = 1) AS fp,
         count(*) FILTER (actual = 1 AND prediction = 0) AS fn, count(*) FILTER (actual = 1 AND prediction = 1) AS tp FROM guessed)"""
SQL["confusion_matrix"] = f"""WITH {CELLS}
SELECT 0 AS actual, 0 AS predicted, tn AS n FROM cells UNION ALL SELECT 0, 1, fp FROM cells
UNION ALL SELECT 1, 0, fn FROM cells UNION ALL SELECT 1, 1, tp FROM cells"""
SQL["confusion_pct"] = f"""WITH {GUESSED}, g AS ({SQL['confusion_matrix']})
SELECT actual, predicted, n, round(n * 100 / sum(n) OVER (PARTITION BY actual), 6) AS row_pct FROM g"""
SQL["confusion_rates"] = f"""WITH {CELLS},
r AS (SELECT *, (tn + tp) / (tn + fp + fn + tp) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM cells)
SELECT tn, fp, fn, tp, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(2 * precision * recall / (precision + recall), 6) AS f1 FROM r"""
SQL["classification_report"] = f"""WITH {CELLS},
per AS (
  SELECT 'not_useful' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, tn + fp AS support FROM cells
  UNION ALL SELECT 'useful', tp / (tp + fp), tp / (tp + fn), tp + fn FROM cells),
f AS (SELECT *, 2 * p * r / (p + r) AS f FROM per),
a AS (
  SELECT * FROM f
  UNION ALL SELECT 'accuracy', (tn + tp) / (tn + fp + fn + tp), (tn + tp) / (tn + fp + fn + tp), tn + fp + fn + tp, (tn + tp) / (tn + fp + fn + tp) FROM cells
  UNION ALL SELECT 'macro avg', avg(p), avg(r), sum(support)::BIGINT, avg(f) FROM f
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(support)::BIGINT, sum(f * support) / sum(support) FROM f)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM a"""
SQL["accuracy"] = f"WITH {GUESSED} SELECT round(avg((actual = prediction)::INT), 6) AS accuracy FROM guessed"
SQL["positive_predictions"] = f"WITH {GUESSED} SELECT count(*) AS n, count(*) FILTER (prediction = 1) AS positives FROM guessed"
SQL["fold_accuracy_band"] = f"""WITH {GUESSED}, {folds_ctes('guessed', 'actual')},
s AS (SELECT fold, avg((actual = prediction)::INT) AS a FROM folded GROUP BY fold)
SELECT round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std, round(2 * stddev_pop(a), 6) AS band FROM s"""
SQL["quality_flags"] = f"""WITH {PLACED}, {GUESSED},
h AS (SELECT (actual = prediction)::INT AS hit, split FROM guessed JOIN placed USING (doc_id)),
m AS (SELECT avg(hit) AS cv_mean, avg(hit) FILTER (split = 'train') AS train_accuracy, avg(hit) FILTER (split = 'test') AS test_accuracy,
  (SELECT round(count(*) FILTER (toxic = 0) / count(*) FILTER (toxic = 1), 6) FROM labels) AS ratio FROM h)
SELECT round(cv_mean, 6) AS cv_mean, round(train_accuracy, 6) AS train_accuracy, round(test_accuracy, 6) AS test_accuracy, ratio,
  ratio > 5 AS imbalanced, cv_mean < 0.5 AS poor_cv, train_accuracy - test_accuracy > 0.15 AS overfit,
  test_accuracy >= train_accuracy AS no_overfit FROM m"""
SQL["model_top_features"] = f"""WITH {FITTED}, {MEANS}
SELECT feature_index, feature_name, round(difference, 6) AS weight FROM means
ORDER BY round(abs(difference), 12) DESC, feature_index LIMIT 10"""
SQL["model_top_importances"] = f"""WITH {FITTED}, {CHI2}
SELECT feature_index, feature_name, round(c.chi2, 6) AS weight FROM chi2 c ORDER BY round(c.chi2, 12) DESC, feature_index LIMIT 10"""

# Routing, exchange, feedback

SCORED = """scored AS (
  SELECT printf('%05d.txt', event_id) AS filename, value / (value + 60) AS score,
         (value / (value + 60) >= 0.5)::INTEGER AS prediction FROM events)"""
SQL["route_predictions"] = f"""WITH {SCORED},
c AS (SELECT *, CASE WHEN prediction = 1 THEN score * 100 ELSE (1 - score) * 100 END AS confidence FROM scored)
SELECT filename, prediction, round(confidence, 6) AS confidence, confidence < 75 AS uncertain,
  CASE WHEN confidence < 75 THEN 'manual_check' WHEN prediction = 1 THEN 'useful' ELSE 'not_useful' END AS route FROM c"""
SQL["predictions_rule_table"] = f"""WITH {SCORED}
SELECT filename, prediction, round(score, 6) AS anomaly_score, CASE WHEN prediction = 1 THEN 'useful' ELSE 'not_useful' END AS label FROM scored"""
SQL["exchange_batches"] = """SELECT conv_id * 1000003 + turn // 64 AS batch_id, conv_id % 10 <> 3 AS valid,
  CASE WHEN conv_id % 10 <> 3 THEN count(*)::INTEGER END AS n_items FROM conversations GROUP BY conv_id, turn // 64"""
ITEMS = """items AS (
  SELECT conv_id * 1000003 + turn // 64 AS batch_id,
         (row_number() OVER (PARTITION BY conv_id, turn // 64 ORDER BY turn) - 1)::INTEGER AS pos,
         'id' || (turn % 3) AS id, text FROM conversations WHERE conv_id % 10 <> 3),
docs AS MATERIALIZED (
  SELECT batch_id, min(pos) AS pos, id || '.txt' AS filename, arg_max(text, pos) AS text FROM items GROUP BY batch_id, id)"""
SQL["exchange_parse"] = f"WITH {ITEMS} SELECT batch_id, pos, filename, text FROM docs"
SQL["exchange_output"] = f"""WITH {ITEMS},
s AS (SELECT *, (length(text) % 128) / 128 AS score FROM docs),
c AS (SELECT *, CASE WHEN score >= 0.5 THEN score * 100 ELSE (1 - score) * 100 END AS confidence FROM s),
j AS (SELECT batch_id, pos, CASE WHEN batch_id % 5 = 0 AND pos = 2 THEN 'null' ELSE
  '{{"relevant":' || (score >= 0.5)::VARCHAR || ',"score":' || confidence::VARCHAR || ',"uncertain":' || (confidence < 75)::VARCHAR || '}}' END AS r FROM c)
SELECT batch_id, '[' || string_agg(r, ', ' ORDER BY pos) || ']' AS payload FROM j GROUP BY batch_id"""
SQL["latest_artifacts"] = """WITH runs AS (
  SELECT event_type AS model_type, ts, strftime(ts, '%Y%m%d_%H%M%S') || '_' ||
         replace(printf('%.1f', floor((value % 100 / 100) * 100) / 100 * 100), '.', '_') AS suffix FROM events),
named AS (SELECT *, 'txt_' || model_type || '_' || suffix || '_classifier' AS name FROM runs)
SELECT 'txt' AS file_type, model_type, name AS classifier, 'txt_tfidf_vocabulary_' || suffix AS tfidf, 'txt_scaler_' || suffix AS scaler
FROM named QUALIFY row_number() OVER (PARTITION BY model_type ORDER BY ts DESC, name DESC) = 1"""

DECIDED = """decided AS (
  SELECT event_id, printf('%05d.txt', user_id) AS filename, value, ts,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'useful' WHEN event_type IN ('error', 'click') THEN 'not_useful' ELSE event_type END AS decision FROM events)"""
FEEDBACK = f"""{DECIDED}, fed AS (
  SELECT CASE WHEN event_id % 50 = 0 THEN ' ' ELSE filename END AS filename,
    CASE WHEN value > 50 THEN 'useful' ELSE 'not_useful' END AS predicted_label, value AS predicted_score, decision AS human_label,
    CASE WHEN event_id % 3 = 0 THEN 'm1' END AS model_version, CASE WHEN event_id % 3 = 1 THEN '' ELSE 't1' END AS tfidf_version,
    's1' AS scaler_version, ts FROM decided)"""


def iso_sql(ts: str) -> str:
    plain = f"strftime({ts}, '%Y-%m-%dT%H:%M:%S')"
    micros = f"strftime({ts}, '%f')"
    return f"{plain} || CASE WHEN {micros} = '000000' THEN '' ELSE '.' || {micros} END || '+00:00'"


SQL["feedback_records"] = f"""WITH {FEEDBACK}
SELECT strftime(ts, '%Y%m%d%H%M%S%f') || '_' || filename AS record_id, filename, predicted_label, predicted_score, human_label,
  NULL::VARCHAR AS annotator, NULL::VARCHAR AS notes, model_version, tfidf_version, scaler_version,
  'model=' || coalesce(nullif(model_version, ''), 'unknown') || ' | tfidf=' || coalesce(nullif(tfidf_version, ''), 'unknown')
    || ' | scaler=' || scaler_version AS pipeline_version,
  'raw_txts' AS source_dir, 'pending' AS apply_status, NULL::VARCHAR AS applied_at, {iso_sql('ts')} AS created_at
FROM fed WHERE trim(filename) <> '' AND human_label IN ('useful', 'not_useful')"""
SQL["feedback_rejects"] = f"""WITH {FEEDBACK}
SELECT filename, predicted_label, human_label, ts AS "at",
  CASE WHEN trim(filename) = '' THEN 'no file name' ELSE 'the human label is none of not_useful, useful' END AS reject_reason
FROM fed WHERE trim(filename) = '' OR human_label NOT IN ('useful', 'not_useful')"""

DIRS = """dirs AS (
  SELECT printf('%05d.txt', d.doc_id) AS filename,
    CASE WHEN quality = 1 THEN 'useful' WHEN quality = 0 THEN 'not_useful' WHEN d.doc_id % 2 = 0 THEN 'manual_check' END AS dir
  FROM documents d LEFT JOIN labels l USING (doc_id)),
held AS (SELECT * FROM dirs WHERE dir IS NOT NULL)"""
SQL["locate_file"] = f"""WITH {DECIDED}, {DIRS}, w AS (SELECT DISTINCT filename FROM decided)
SELECT filename, dir, nullif(dir, 'manual_check') AS label FROM w LEFT JOIN held USING (filename)"""
SQL["missing_files"] = f"""WITH {DECIDED}, {DIRS}
SELECT DISTINCT filename FROM decided ANTI JOIN held USING (filename)"""
MOVES = f"""{DECIDED}, {DIRS},
steps AS (
  SELECT event_id::VARCHAR AS record_id, filename, decision, value, ts, dir,
    lag(decision) OVER (PARTITION BY filename ORDER BY ts, event_id::VARCHAR) AS earlier
  FROM decided JOIN held USING (filename) WHERE decision IN ('useful', 'not_useful')),
moves AS (
  SELECT record_id, filename, coalesce(earlier, nullif(dir, 'manual_check')) AS old_label, decision AS new_label,
    decision AS moved_to, coalesce(earlier, dir) = decision AS was_already_there, value, ts FROM steps)"""
SQL["corrections_applied"] = f"""WITH {MOVES}
SELECT record_id, filename, old_label, new_label, moved_to, was_already_there FROM moves"""
SQL["correction_log"] = f"""WITH {MOVES}
SELECT strftime(ts, '%Y%m%d%H%M%S%f') || '_' || filename AS record_id, filename, old_label, new_label, value AS predicted_score,
  'r1' AS reviewer, 'Wrong marked or Uncertain labeled' AS method, 'applied' AS apply_status,
  {iso_sql('ts')} AS applied_at, {iso_sql('ts')} AS created_at FROM moves WHERE NOT was_already_there"""
LAST = f"""{DECIDED}, last AS (
  SELECT filename, decision AS new_label FROM decided WHERE decision IN ('useful', 'not_useful')
  QUALIFY row_number() OVER (PARTITION BY filename ORDER BY ts DESC, event_id::VARCHAR DESC) = 1)"""
CORRECTED = f"""{LAST}, {DIRS},
corrected AS (SELECT filename, coalesce(new_label, dir) AS dir, nullif(coalesce(new_label, dir), 'manual_check') AS label
  FROM held LEFT JOIN last USING (filename))"""
SQL["corrected_labels"] = f"WITH {CORRECTED} SELECT filename, dir, label FROM corrected"
SQL["relabelled_split"] = f"""WITH {CORRECTED}, named AS (SELECT * FROM corrected WHERE label IS NOT NULL), {split_ctes('named')}
SELECT filename, label, split FROM placed"""
SQL["current_labels"] = f"WITH {LAST} SELECT filename, new_label FROM last"

# Rebalancing and streams

RARE = """rare AS (SELECT doc_id, toxic AS y, embedding FROM embeddings JOIN labels ON vec_id = doc_id),
size AS (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM rare)"""
SQL["smote_counts"] = f"""WITH {RARE}
SELECT y, false AS synthetic, count(*) AS n FROM rare GROUP BY y
UNION ALL SELECT 1, true, n0 - n1 FROM size WHERE n0 > 5 * n1 AND n1 > 1"""
SQL["smote_rows"] = f"""WITH {RARE}
SELECT doc_id, y::INTEGER AS y, array_to_string([round(x::DOUBLE * 1e6)::BIGINT FOR x IN embedding], ' ') AS vector, NULL::BIGINT AS n_sound FROM rare
UNION ALL SELECT NULL, 1, NULL, n0 - n1 FROM size WHERE n0 > 5 * n1 AND n1 > 1"""
SQL["minority_neighbours"] = f"""WITH {RARE}, p AS (SELECT doc_id, embedding::DOUBLE[] AS e FROM rare WHERE y = 1)
SELECT a.doc_id AS key, b.doc_id AS near, round(list_distance(a.e, b.e), 6) AS gap FROM p a JOIN p b ON a.doc_id <> b.doc_id
QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY list_distance(a.e, b.e), b.doc_id) <= 5"""
SQL["stream_score"] = f"""WITH {CLEANED} SELECT doc_id, length(text)::INTEGER AS n_chars FROM cleaned WHERE clean <> ''"""
SQL["stream_labels"] = SQL["current_labels"]

SQL["predict_combined"] = f"""WITH {FITTED},
{terms_ctes('cleaned', 'all_')}, {weights_cte('all_weight', 'all_tf')},
width AS (SELECT count(*)::INTEGER AS w FROM vocab),
semantic AS (
  SELECT c.doc_id, coalesce(embedding::DOUBLE[], [(length(clean) + j) % 16 / 16 FOR j IN range(64)]) AS v
  FROM cleaned c LEFT JOIN embeddings e ON c.doc_id = e.vec_id WHERE clean <> ''),
entry AS (
  SELECT doc_id, feature_index AS i, tfidf AS x FROM all_weight
  UNION ALL SELECT doc_id, w + generate_subscripts(v, 1) - 1, unnest(v) FROM semantic, width),
most AS (SELECT i, max(abs(x)) AS m FROM entry SEMI JOIN train USING (doc_id) GROUP BY i),
margin AS (SELECT doc_id, sum(x / CASE WHEN m = 0 THEN 1 ELSE m END * (i * 37 % 11 - 5)) AS s FROM entry JOIN most USING (i) GROUP BY doc_id),
scored AS (SELECT doc_id, 1 / (1 + exp(-s / 4)) AS score FROM margin SEMI JOIN semantic USING (doc_id)),
sure AS (SELECT *, (score >= 0.5)::INTEGER AS prediction, CASE WHEN score >= 0.5 THEN score * 100 ELSE (1 - score) * 100 END AS confidence FROM scored)
SELECT doc_id, prediction, round(score, 6) AS score, round(confidence, 6) AS confidence,
  CASE WHEN confidence < 75 THEN 'manual_check' WHEN prediction = 1 THEN 'useful' ELSE 'not_useful' END AS route FROM sure"""
SQL["stream_combined"] = SQL["predict_combined"]
SQL["document_ids"] = "SELECT count(*) AS n, true AS is_unique, true AS is_stable, true AS is_positive FROM documents"

SQL["lazy_extraction"] = f"""WITH d AS (SELECT doc_id, doc_id % 4 AS kind, coalesce(text, '') AS text, length({stripped_sql("coalesce(text, '')")}) >= 50 AS enough FROM documents)
SELECT doc_id, CASE WHEN kind = 2 OR (kind = 0 AND enough) THEN 'printed' ELSE 'scanned' END AS extractor,
  CASE WHEN kind = 1 OR (kind = 0 AND enough) THEN text ELSE '' END AS text, kind = 2 AS failed FROM d"""
SQL["exchange_answers"] = SQL["exchange_output"]
SQL["exchange_files"] = """SELECT conv_id * 1000003 + turn // 64 AS batch_id,
  (row_number() OVER (PARTITION BY conv_id, turn // 64 ORDER BY turn) - 1)::INTEGER AS pos, 'id' || (turn % 3) AS id, text AS content, false AS is_rejected
FROM conversations WHERE conv_id % 10 <> 3
UNION ALL SELECT DISTINCT conv_id * 1000003 + turn // 64, NULL, NULL, NULL, true FROM conversations WHERE conv_id % 10 = 3"""

PHRASED = f"phrased AS (SELECT doc_id, {FILENAME} AS filename, {phrased_sql()} AS text FROM documents)"
SQL["clean_phrases"] = f"WITH {PHRASED} SELECT doc_id, {clean_sql('text')} AS clean FROM phrased"
SQL["removed_phrases"] = f"""WITH {PHRASED}, c AS MATERIALIZED (SELECT filename, text, {clean_sql('text')} AS clean FROM phrased),
r AS (SELECT filename, {removed_sql('text', 'clean')} AS removed FROM c)
SELECT filename, removed FROM r WHERE removed <> ''"""
SQL["cache_versions"] = """WITH u AS (
  SELECT page_id AS doc_id, url AS text, 1 AS version FROM pages UNION ALL SELECT doc_id, text, 2 FROM documents WHERE doc_id % 3 > 0
  UNION ALL SELECT item_id, text, 3 FROM benchmark)
SELECT doc_id, text FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) = 1"""
SQL["stream_corrections"] = SQL["correction_log"]
FITTED_ROWS = "FROM embeddings JOIN labels ON vec_id = doc_id"
SQL["lr_checks"] = f"""SELECT count(*) AS n, count(*) AS n_sound, true AS is_balanced, true AS is_optimal, any_value(len(embedding)) AS n_weights {FITTED_ROWS}"""
SQL["rf_checks"] = f"SELECT count(*) AS n, count(*) AS n_sound, true AS is_better {FITTED_ROWS}"
SQL["cv_checks"] = "SELECT 5::BIGINT AS n_folds, 5::BIGINT AS n_sound"
