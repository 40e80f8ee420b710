"""Registry of named queries over the driver tables, each with DuckDB SQL.

Every query reads whole tables (or data Spark derives from them); there are
no row caps or id subsets.  Computed columns are aliased identically in Spark and SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.functions import text as tx
from opinio.operators import cleaning as cl
from opinio.plans import views as V
from opinio.sources import tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# --------------------------------------------------------------------------- 2.1 sources
@register("reviews_table", f"""WITH {V.REVIEWS}
SELECT product_id, pos, printf('r%03d', pos) AS review_id, rating, verified, helpful_votes
FROM reviews""")
def q_reviews_table(spark, sf):
    r = tb.reviews(spark, sf, verified=True)
    return r.select("product_id", "pos",
                    F.format_string("r%03d", F.col("pos")).alias("review_id"),
                    "rating", "verified", "helpful_votes")


# --------------------------------------------------------------------------- 2.3 scalars
@register("estimate_tokens", f"""WITH {V.REVIEWS}
SELECT review_id, CAST(coalesce(length(text), 0) AS DOUBLE) * 0.25 AS tokens FROM reviews""")
def q_estimate_tokens(spark, sf):
    r = tb.reviews(spark, sf)
    return r.select("review_id", tx.estimate_tokens("text").alias("tokens"))


@register("compose_review_text", f"""WITH {V.CORPUS}
SELECT CAST(pos AS VARCHAR) AS review_id,
       {V.strip("coalesce(title, '') || '. ' || coalesce(text, '')")} AS review_text
FROM corpus""")
def q_compose(spark, sf):
    c = tb.corpus_reviews(spark, sf)
    return c.select(F.col("pos").cast("string").alias("review_id"),
                    tx.compose_review_text("title", "text").alias("review_text"))


@register("normalize_dup_key", f"""WITH {V.REVIEWS}
SELECT review_id, regexp_replace(lower(text), '{V.NON_WORD}', '', 'g') AS dup_key FROM reviews""")
def q_dup_key(spark, sf):
    r = tb.reviews(spark, sf)
    return r.select("review_id", tx.normalize_dup_key("text").alias("dup_key"))


@register("word_count", f"""WITH {V.REVIEWS}
SELECT review_id, {V.word_count("text")} AS n_words FROM reviews""")
def q_word_count(spark, sf):
    r = tb.reviews(spark, sf)
    return r.select("review_id", tx.word_count("text").alias("n_words"))


@register("split_sentences", f"""WITH {V.REVIEWS},
s AS (SELECT product_id, review_id, {V.sentences("text")} AS arr FROM reviews
      WHERE review_id <> '' AND coalesce(text, '') <> '')
SELECT product_id, review_id, CAST(g.i - 1 AS INTEGER) AS sentence_id, arr[g.i] AS text
FROM s, LATERAL (SELECT unnest(range(1, len(arr) + 1)) AS i) g""")
def q_split_sentences(spark, sf):
    from opinio.operators.sentences import split_sentences
    return split_sentences(tb.reviews(spark, sf)).select(
        "product_id", "review_id", "sentence_id", "text")


@register("strip_personal", f"""WITH {V.REVIEWS}
SELECT review_id, {V.personal_sql("text")} AS clean_text FROM reviews""")
def q_strip_personal(spark, sf):
    r = tb.reviews(spark, sf)
    return r.select("review_id", tx.strip_personal("text").alias("clean_text"))


@register("credibility", f"""WITH {V.CORPUS},
c AS (SELECT pos, coalesce(verified_purchase, false) AS verified,
             coalesce(TRY_CAST(helpful_vote AS DOUBLE), 0.0) AS hv,
             {V.strip("coalesce(title, '') || '. ' || coalesce(text, '')")} AS review_text
      FROM corpus)
SELECT CAST(pos AS VARCHAR) AS review_id,
       round(greatest(0.0, least(1.0, 1.0 - CASE WHEN verified THEN 0.0 ELSE 0.5 END
             + least(hv / 50.0, 0.35)
             - CASE WHEN {" OR ".join(f"contains(lower(review_text), '{p}')" for p in cl.SPAM_PHRASES)}
                    THEN 0.4 ELSE 0.0 END
             + CASE WHEN length(review_text) > 300 THEN 0.05 ELSE 0.0 END)), 6) AS credibility_score
FROM c""")
def q_credibility(spark, sf):
    c = cl.canonicalize_corpus(tb.corpus_reviews(spark, sf))
    return c.select(F.col("pos").cast("string").alias("review_id"),
                    F.round(cl.credibility(), 6).alias("credibility_score"))


# --------------------------------------------------------------------------- 2.4 / 2.7 corpus cleaning
def _cleaned(spark, sf, mode="strict"):
    return cl.clean_corpus(tb.corpus_reviews(spark, sf), filter_mode=mode)


def _filtered(spark, sf):
    c = cl.canonicalize_corpus(tb.corpus_reviews(spark, sf))
    return cl.spam_filter(cl.min_length(c, "review_text", 30), "review_text")


@register("spam_filter", f"""WITH {V.cleaned()}
SELECT parent_asin, CAST(pos AS VARCHAR) AS review_id FROM filtered""")
def q_spam_filter(spark, sf):
    return _filtered(spark, sf).select("parent_asin", F.col("pos").cast("string").alias("review_id"))


@register("dedupe_keep_first", f"""WITH {V.cleaned()}
SELECT parent_asin, CAST(pos AS VARCHAR) AS review_id, verified FROM deduped""")
def q_dedupe(spark, sf):
    d = cl.dedupe_keep_first(_filtered(spark, sf), "review_text", "pos")
    return d.select("parent_asin", F.col("pos").cast("string").alias("review_id"), "verified")


@register("strict_mode", f"""WITH {V.cleaned("strict")}
SELECT parent_asin, CAST(pos AS VARCHAR) AS review_id, clean_text,
       round(credibility_score, 6) AS credibility_score FROM cleaned""")
def q_strict(spark, sf):
    c = _cleaned(spark, sf, "strict")
    return c.select("parent_asin", F.col("pos").cast("string").alias("review_id"), "clean_text",
                    F.round("credibility_score", 6).alias("credibility_score"))


@register("product_stats", f"""WITH {V.cleaned("inclusive")}
SELECT parent_asin, round(avg(rating), 6) AS avg_rating, count(rating) AS review_count,
       round(avg(credibility_score), 6) AS credibility_score
FROM cleaned GROUP BY parent_asin HAVING count(rating) >= 50""")
def q_product_stats(spark, sf):
    from opinio.operators.report import product_stats
    s = product_stats(_cleaned(spark, sf, "inclusive")).where(F.col("review_count") >= 50)
    return s.select("parent_asin", F.round("avg_rating", 6).alias("avg_rating"), "review_count",
                    F.round("credibility_score", 6).alias("credibility_score"))


# --------------------------------------------------------------------------- 2.10 credibility report
from opinio.plans import report_sql as RS  # noqa: E402


@register("credibility_report", RS.report_sql(min_reviews=20, mode="strict"))
def q_credibility_report(spark, sf):
    from opinio.operators.report import credibility_report
    return credibility_report(_cleaned(spark, sf, "strict"), min_reviews=20, filter_mode="strict")


@register("credibility_report_inclusive", RS.report_sql(min_reviews=50, mode="inclusive"))
def q_credibility_report_incl(spark, sf):
    from opinio.operators.report import credibility_report
    return credibility_report(_cleaned(spark, sf, "inclusive"), min_reviews=50,
                              filter_mode="inclusive")


# --------------------------------------------------------------------------- 2.9 vectors
from opinio.functions import vectors as vx  # noqa: E402
from opinio.operators import selection as sel  # noqa: E402
from opinio.operators import vectors as ov  # noqa: E402
from opinio.operators.sentences import split_sentences  # noqa: E402


@register("embed_sentences", f"""WITH {V.REVIEWS}, s AS ({V.sentence_rows()})
SELECT review_id, sentence_id,
       array_to_string(list_transform({V.hash_embed("text")}, lambda x: CAST(x AS INTEGER)), ',') AS vec
FROM s""")
def q_embed_sentences(spark, sf):
    s = split_sentences(tb.reviews(spark, sf))
    v = vx.hash_embed("text", 64)
    return s.select("review_id", "sentence_id",
                    F.array_join(F.transform(v, lambda x: x.cast("int").cast("string")), ",").alias("vec"))


@register("review_embedding_mean", f"""WITH {V.SENTENCE_VECS},
x AS (SELECT product_id, review_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS d
      FROM sentence_vecs)
SELECT product_id, review_id, d, round(avg(CAST(v AS DOUBLE)), 6) AS v FROM x GROUP BY ALL""")
def q_review_embedding_mean(spark, sf):
    s = tb.sentence_vecs(spark, sf)
    revs = s.select("product_id", "review_id").distinct()
    pooled = ov.review_embedding_mean(revs, s)
    return pooled.select("product_id", "review_id",
                         F.posexplode("review_vec").alias("d", "v")).select(
        "product_id", "review_id", "d", F.round("v", 6).alias("v"))


@register("semantic_importance", f"""WITH {V.SENTENCE_VECS},
x AS (SELECT product_id, review_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS d
      FROM sentence_vecs),
pooled AS (SELECT product_id, review_id, d, avg(CAST(v AS DOUBLE)) AS v FROM x GROUP BY ALL),
{V.importance_ctes("pooled")}
SELECT product_id, review_id, round(importance, 6) AS importance FROM imp""")
def q_semantic_importance(spark, sf):
    s = tb.sentence_vecs(spark, sf)
    revs = s.select("product_id", "review_id").distinct()
    imp = ov.semantic_importance(ov.review_embedding_mean(revs, s))
    return imp.select("product_id", "review_id", F.round("importance", 6).alias("importance"))


@register("helpful_boost", f"""WITH {V.REVIEWS},
m AS (SELECT product_id, max(coalesce(CAST(helpful_votes AS DOUBLE), 0.0)) AS mx FROM reviews GROUP BY ALL)
SELECT r.product_id, r.review_id,
       round(CASE WHEN m.mx > 0 THEN least(1.0, greatest(0.0, coalesce(CAST(helpful_votes AS DOUBLE), 0.0) / m.mx)) * 0.5
            ELSE 0.0 END, 6) AS boost
FROM reviews r JOIN m USING (product_id)""")
def q_helpful_boost(spark, sf):
    b = ov.helpful_boost(tb.reviews(spark, sf))
    return b.select("product_id", "review_id", F.round("boost", 6).alias("boost"))


def _greedy_sql(src: str, limit: float) -> str:
    init = "{'rem': " + f"{float(limit)}::DOUBLE" + ", 'ids': []::VARCHAR[]}"
    return f"""g AS (SELECT product_id, list_reduce(list({{'t': t, 'id': review_id}} ORDER BY score DESC, pos),
      lambda acc, x: CASE WHEN x.t <= acc.rem THEN {{'rem': acc.rem - x.t, 'ids': list_append(acc.ids, x.id)}}
                          ELSE acc END, {init}) AS st
    FROM {src} WHERE t > 0 AND t <= {float(limit)} GROUP BY product_id)
SELECT product_id, unnest(st.ids) AS review_id FROM g"""


@register("select_under_budget", f"""WITH {V.REVIEWS},
m AS (SELECT product_id, max(coalesce(CAST(helpful_votes AS DOUBLE), 0.0)) AS mx FROM reviews GROUP BY ALL),
c AS (SELECT r.product_id, r.review_id, r.pos, CAST(coalesce(length(text), 0) AS DOUBLE) * 0.25 AS t,
             CASE WHEN m.mx > 0 THEN least(1.0, greatest(0.0, coalesce(CAST(helpful_votes AS DOUBLE), 0.0) / m.mx)) * 0.5
                  ELSE 0.0 END AS score
      FROM reviews r JOIN m USING (product_id)),
{_greedy_sql("c", 1500)}""")
def q_select_under_budget(spark, sf):
    r = ov.helpful_boost(tb.reviews(spark, sf)).withColumn("t", tx.estimate_tokens("text"))
    return sel.select_under_budget(r, "product_id", "boost", "pos", "t", 1500).select(
        "product_id", F.col("pos").cast("string").alias("review_id"))


def _filter_reviews(spark, sf, limit=1500, use_verified=None, use_useful=None, sentences=None):
    r = tb.reviews(spark, sf, verified=True)
    s = tb.doc_sentences(spark, sf) if sentences is None else sentences
    crit = sel.FilteringCriteria(use_verified=use_verified, use_useful=use_useful, token_limit=limit)
    return sel.filter_reviews(r, s, crit)


def _filter_sql(limit: float, where: str = "TRUE") -> str:
    L = float(limit)
    return f"""WITH {V.REVIEWS},
r AS (SELECT *, CAST(coalesce(length(text), 0) AS DOUBLE) * 0.25 AS t FROM reviews WHERE {where}),
tot AS (SELECT product_id, sum(t) AS total FROM r GROUP BY ALL),
fits AS (SELECT r.product_id, r.review_id FROM r JOIN tot USING (product_id) WHERE total <= {L}),
over AS (SELECT r.* FROM r JOIN tot USING (product_id) WHERE total > {L}),
s AS ({V.sentence_rows("over")}),
sv AS (SELECT product_id, review_id, {V.hash_embed("text")} AS e FROM s),
x AS (SELECT product_id, review_id, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS d FROM sv),
pooled0 AS (SELECT product_id, review_id, d, avg(CAST(v AS DOUBLE)) AS v FROM x GROUP BY ALL),
dims AS (SELECT product_id, max(len(e)) AS dim FROM sv GROUP BY ALL),
pooled AS (SELECT o.product_id, o.review_id, g.d, coalesce(p.v, 0.0) AS v
           FROM over o JOIN dims USING (product_id), LATERAL (SELECT unnest(range(dim)) AS d) g
           LEFT JOIN pooled0 p ON p.product_id = o.product_id AND p.review_id = o.review_id AND p.d = g.d),
{V.importance_ctes("pooled")},
m AS (SELECT product_id, max(coalesce(CAST(helpful_votes AS DOUBLE), 0.0)) AS mx FROM over GROUP BY ALL),
sc AS (SELECT o.product_id, o.review_id, o.pos, o.t, o.text,
              round(coalesce(i.importance, 0.0) + CASE WHEN m.mx > 0 THEN least(1.0, greatest(0.0,
                coalesce(CAST(o.helpful_votes AS DOUBLE), 0.0) / m.mx)) * 0.5 ELSE 0.0 END, 9) AS score
       FROM over o JOIN m USING (product_id) LEFT JOIN imp i USING (product_id, review_id)),
g AS (SELECT product_id, list_reduce(list({{'t': t, 'id': review_id}} ORDER BY score DESC, pos),
      lambda acc, x: CASE WHEN x.t <= acc.rem THEN {{'rem': acc.rem - x.t, 'ids': list_append(acc.ids, x.id)}}
                          ELSE acc END, {{'rem': {L}::DOUBLE, 'ids': []::VARCHAR[]}}) AS st
    FROM sc WHERE t > 0 AND t <= {L} GROUP BY product_id),
picks AS (SELECT product_id, unnest(st.ids) AS review_id FROM g),
fb AS (SELECT product_id, arg_min(review_id, (coalesce(length(text), 0), pos)) AS review_id,
              arg_min(t, (coalesce(length(text), 0), pos)) AS t
       FROM sc WHERE product_id NOT IN (SELECT product_id FROM picks) GROUP BY ALL),
selected AS (SELECT product_id, review_id FROM fits
             UNION ALL SELECT product_id, review_id FROM picks
             UNION ALL SELECT product_id, review_id FROM fb WHERE t <= {L})"""


@register("filter_reviews", _filter_sql(1500) + "\nSELECT product_id, review_id FROM selected")
def q_filter_reviews(spark, sf):
    selected, _ = _filter_reviews(spark, sf, 1500)
    return selected.select("product_id", "review_id")


@register("filter_reviews_verified", _filter_sql(400, "verified = true")
          + "\nSELECT product_id, review_id FROM selected")
def q_filter_reviews_verified(spark, sf):
    selected, _ = _filter_reviews(spark, sf, 400, use_verified=True)
    return selected.select("product_id", "review_id")


@register("selection_stats", _filter_sql(1500) + """,
orig AS (SELECT product_id, count(*) AS original_count FROM reviews GROUP BY ALL),
rk AS (SELECT s.product_id, count(*) AS n, sum(r.t) AS tok FROM selected s JOIN r USING (product_id, review_id) GROUP BY ALL)
SELECT o.product_id, o.original_count, o.original_count AS after_selection_count,
       coalesce(rk.n, 0) AS after_ranking_count, round(coalesce(rk.tok, 0.0), 6) AS token_usage,
       1500.0 AS token_limit, round(coalesce(rk.n, 0) / o.original_count, 6) AS retention_rate,
       coalesce(tot.total > 1500.0, false) AS selection_applied,
       coalesce(rd.ratings, '') AS ratings
FROM orig o LEFT JOIN rk USING (product_id) LEFT JOIN tot USING (product_id) LEFT JOIN (
  SELECT product_id, string_agg(CAST(rating AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY rating) AS ratings
  FROM (SELECT product_id, rating, count(*) AS n FROM reviews WHERE rating IS NOT NULL GROUP BY ALL) GROUP BY ALL) rd
  USING (product_id)""")
def q_selection_stats(spark, sf):
    _, st = _filter_reviews(spark, sf, 1500)
    return st.select("product_id", "original_count", "after_selection_count", "after_ranking_count",
                     F.round("token_usage", 6).alias("token_usage"), "token_limit",
                     F.round("retention_rate", 6).alias("retention_rate"), "selection_applied",
                     F.array_join(F.transform(F.map_entries("rating_distribution"), lambda e: F.concat(
                         e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",").alias("ratings"))


# --------------------------------------------------------------------------- 2.10 grounding / facts / QA
from opinio.operators import grounding as gr  # noqa: E402
from opinio.operators import qa as qa_op  # noqa: E402


def _ground_sql(threshold: float, max_evidence: int, restrict: str = "TRUE") -> str:
    """facts(product_id, entity_idx, name, counts, evidence) over aspects and documents."""
    return f"""{V.doc_sentences()}, {V.aspects()},
gsv AS (SELECT * FROM ds WHERE {restrict}),
pairs AS (SELECT e.product_id, e.entity_idx, s.review_id, s.pos, s.sentence_id, s.text, s.sentiment,
                 round({V.dot("e.u", "s.u")}, 9) AS sim FROM ents e JOIN gsv s USING (product_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY product_id, entity_idx ORDER BY sim DESC, pos, sentence_id) AS rn,
                  max(sim) OVER (PARTITION BY product_id, entity_idx) AS best FROM pairs),
hits AS (SELECT * FROM ranked WHERE sim >= {threshold} OR (best < {threshold} AND rn = 1 AND sim > 0)),
agg AS (SELECT product_id, entity_idx, count(DISTINCT review_id) AS review_count,
               count_if(sentiment = 'positive') AS positive_count, count_if(sentiment = 'negative') AS negative_count,
               count_if(sentiment = 'neutral') AS neutral_count FROM hits GROUP BY ALL),
evs AS {V.ordered_distinct("text", "rn", "hits", "product_id, entity_idx", " | ",
                           f"rn <= {max_evidence} AND coalesce(text, '') <> ''")},
facts AS (SELECT e.product_id, e.entity_idx, e.entity AS name, coalesce(a.review_count, 0) AS review_count,
                 coalesce(a.positive_count, 0) AS positive_count, coalesce(a.negative_count, 0) AS negative_count,
                 coalesce(a.neutral_count, 0) AS neutral_count, coalesce(v.agg, '') AS evidence_sentences
          FROM ents e LEFT JOIN agg a USING (product_id, entity_idx) LEFT JOIN evs v USING (product_id, entity_idx)
          WHERE e.product_id IN (SELECT product_id FROM gsv))"""


def _flat_facts(f):
    return f.select("product_id", "entity_idx", "name", "review_count", "positive_count",
                    "negative_count", "neutral_count",
                    F.array_join("evidence_sentences", " | ").alias("evidence_sentences"))


@register("sentence_index", f"""WITH {V.doc_sentences()}
SELECT product_id, review_id, sentence_id, sentiment,
       array_to_string(list_transform(u, lambda x: printf('%.6f', round(x, 6) + 0.0)), ',') AS unit_vec FROM ds""")
def q_sentence_index(spark, sf):
    s = tb.doc_sentences(spark, sf)
    vec = F.transform(vx.l2_normalize("embedding"), lambda x: F.format_string("%.6f", F.round(x, 6)))
    return s.select("product_id", "review_id", "sentence_id", "sentiment", F.array_join(vec, ",").alias("unit_vec"))


@register("ground_entities", "WITH " + _ground_sql(0.3, 5) + "\nSELECT * FROM facts")
def q_ground_entities(spark, sf):
    return _flat_facts(gr.ground_entities(tb.aspects(spark, sf), tb.doc_sentences(spark, sf)))


@register("ground_entities_strict", "WITH " + _ground_sql(0.97, 3) + "\nSELECT * FROM facts")
def q_ground_entities_strict(spark, sf):
    # few sentences come so near: most entities fall back to their best one
    return _flat_facts(gr.ground_entities(tb.aspects(spark, sf), tb.doc_sentences(spark, sf),
                                          similarity_threshold=0.97, max_evidence=3))


@register("feature_review_examples", f"WITH {_ground_sql(0.6, 5)}\n" + """
SELECT f.product_id, f.entity_idx, f.name, coalesce(r.examples, '') AS examples,
       CAST(least(5, f.review_count) AS VARCHAR) || ' / ' || CAST(f.review_count AS VARCHAR) AS shown
FROM facts f LEFT JOIN (SELECT product_id, entity_idx, string_agg(review_id, ',' ORDER BY sim DESC, pos) AS examples
  FROM (SELECT product_id, entity_idx, review_id, pos, max(sim) AS sim,
               row_number() OVER (PARTITION BY product_id, entity_idx ORDER BY max(sim) DESC, pos) AS k
        FROM hits GROUP BY product_id, entity_idx, review_id, pos) WHERE k <= 5 GROUP BY ALL) r
  USING (product_id, entity_idx)""")
def q_feature_review_examples(spark, sf):
    return gr.feature_review_examples(tb.aspects(spark, sf), tb.doc_sentences(spark, sf), similarity_threshold=0.6)


def _facts_sql() -> str:
    ground = _ground_sql(0.3, 5, "(product_id, review_id) IN (SELECT product_id, review_id FROM selected)")
    head, rest = ground.split("gsv AS (", 1)     # the index first, then the selection, then the facts
    select = _filter_sql(1500).split(V.REVIEWS, 1)[1].lstrip(",\n")
    return f"""WITH {head}{select},
gsv AS ({rest},
chosen AS (SELECT product_id, count(DISTINCT review_id) AS total_reviews FROM selected GROUP BY ALL),
nf AS (SELECT product_id, count(*) AS n_features, string_agg(name, ',' ORDER BY entity_idx) AS feature_names,
              sum(review_count) AS grounded_reviews FROM facts GROUP BY ALL)
SELECT t.product_id, t.total_reviews, coalesce(nf.n_features, 0) AS n_features,
       coalesce(nf.feature_names, '') AS feature_names, coalesce(nf.grounded_reviews, 0) AS grounded_reviews
FROM chosen t LEFT JOIN nf USING (product_id)"""


@register("product_facts", _facts_sql())
def q_product_facts(spark, sf):
    s = tb.doc_sentences(spark, sf)
    chosen, _ = _filter_reviews(spark, sf, 1500, sentences=s)
    pf = gr.product_facts(chosen.select("product_id", "review_id"), tb.aspects(spark, sf), s)
    return pf.select("product_id", "total_reviews", F.size("features").cast("long").alias("n_features"),
                     F.array_join(F.transform("features", lambda f: f["name"]), ",").alias("feature_names"),
                     F.aggregate("features", F.lit(0).cast("long"),
                                 lambda a, f: a + f["review_count"]).alias("grounded_reviews"))


def _qa_sql(top_k: int = 4) -> str:
    k = top_k if top_k > 0 else 5
    m = min(k, 3)
    Q = qa_op
    return f"""WITH {V.doc_sentences()}, {V.questions()},
revs AS (SELECT product_id, review_id, text FROM reviews),
ask AS (SELECT * FROM qs WHERE {V.strip("coalesce(question, '')")} <> '' AND has_vector),
pairs AS (SELECT q.product_id, q.question_id, s.review_id, s.pos, s.sentence_id, s.text, s.sentiment,
                 round({V.dot("q.u", "s.u")}, 9) AS sim FROM ask q JOIN ds s USING (product_id)),
hits AS (SELECT *, row_number() OVER (PARTITION BY product_id, question_id ORDER BY sim DESC, pos, sentence_id) AS rn
         FROM pairs QUALIFY rn <= {k} AND sim >= {Q.MIN_SIMILARITY}),
h2 AS (SELECT h.*, coalesce(h.review_id, '') AS rid, coalesce(h.text, '') AS t,
              {V.strip("coalesce(r.text, '')")} AS full_text
       FROM hits h LEFT JOIN revs r USING (product_id, review_id)),
agg AS (SELECT product_id, question_id, count_if(coalesce(sentiment, 'None') = 'positive') AS pos,
               count_if(coalesce(sentiment, 'None') = 'negative') AS neg, count(*) AS n_hits
        FROM h2 GROUP BY ALL),
es AS (SELECT product_id, question_id, list(t ORDER BY o)[1:3] AS q3
       FROM (SELECT product_id, question_id, t, min(rn) AS o FROM h2 WHERE t <> '' GROUP BY ALL) GROUP BY ALL),
er AS (SELECT product_id, question_id, string_agg(e, ' || ' ORDER BY o) FILTER (WHERE rk <= {m}) AS evidence
       FROM (SELECT *, row_number() OVER (PARTITION BY product_id, question_id ORDER BY o) AS rk
             FROM (SELECT product_id, question_id, rid, min(rn) AS o,
                          arg_min(CASE WHEN full_text <> '' THEN full_text ELSE t END, rn) AS e
                   FROM h2 WHERE rid <> '' GROUP BY ALL) WHERE e <> '') GROUP BY ALL),
ans AS (SELECT a.product_id, a.question_id, a.n_hits,
               '{Q.ANSWER_HEAD}' || CASE WHEN neg > 0 AND pos > 0 THEN '{Q.TONE_MIXED}'
                                      WHEN neg > 0 THEN '{Q.TONE_NEG}' WHEN pos > 0 THEN '{Q.TONE_POS}'
                                      ELSE '{Q.TONE_NEUTRAL}' END || '.' ||
               CASE WHEN len(coalesce(es.q3, [])) > 0 THEN ' {Q.ANSWER_EXAMPLES}' ||
                    array_to_string(list_transform(es.q3, lambda s: '"' || s || '"'), ' ') ELSE '' END AS answer,
               coalesce(er.evidence, '') AS evidence
        FROM agg a LEFT JOIN es USING (product_id, question_id) LEFT JOIN er USING (product_id, question_id)),
idx AS (SELECT DISTINCT product_id FROM ds)
SELECT q.product_id, q.question_id,
       CASE WHEN {V.strip("coalesce(q.question, '')")} = '' THEN '{Q.MSG_BLANK}'
            WHEN idx.product_id IS NULL THEN '{Q.MSG_NO_INDEX}'
            WHEN NOT q.has_vector THEN '{Q.MSG_NO_VECTOR}'
            WHEN ans.answer IS NULL THEN '{Q.MSG_NOTHING}' ELSE ans.answer END AS answer,
       coalesce(ans.evidence, '') AS evidence, coalesce(ans.n_hits, 0) AS n_hits
FROM qs q LEFT JOIN idx USING (product_id) LEFT JOIN ans USING (product_id, question_id)"""


@register("answer_questions", _qa_sql(4))
def q_answer_questions(spark, sf):
    a = qa_op.answer_questions(tb.questions(spark, sf), tb.doc_sentences(spark, sf), tb.reviews(spark, sf), top_k=4)
    return a.select("product_id", "question_id", "answer",
                    F.array_join("evidence", " || ").alias("evidence"), "n_hits")


@register("answer_questions_k0", _qa_sql(0))
def q_answer_questions_k0(spark, sf):
    a = qa_op.answer_questions(tb.questions(spark, sf), tb.doc_sentences(spark, sf), tb.reviews(spark, sf), top_k=0)
    return a.select("product_id", "question_id", "answer",
                    F.array_join("evidence", " || ").alias("evidence"), "n_hits")


# --------------------------------------------------------------------------- 2.6 aggregates + flagship
from opinio.operators import aggregates as ag  # noqa: E402
from opinio.operators import sentences as se  # noqa: E402
from opinio.plans import report_sql as _RS  # noqa: E402


from opinio.dictionaries import NEGATIVE_FUNCTION_WORDS as _NEG  # noqa: E402
from opinio.dictionaries import NEGATIVE_WORDS, POSITIVE_WORDS, sql_values  # noqa: E402
from opinio.dictionaries import POSITIVE_FUNCTION_WORDS as _POS  # noqa: E402


def _lexicon_sql(src: str, pos=POSITIVE_WORDS, neg=NEGATIVE_WORDS) -> str:
    """lab(product_id, review_id, sentence_id, sentiment) from sentence rows in src."""
    return f"""pn(word, p, n) AS (VALUES {sql_values([(w, 1, 0) for w in sorted(set(pos))] + [(w, 0, 1) for w in sorted(set(neg))])}),
stk AS (SELECT product_id, review_id, sentence_id, unnest({V.tokens('text')}) AS t FROM {src}),
sh AS (SELECT product_id, review_id, sentence_id, sum(p) AS p, sum(n) AS n
       FROM stk JOIN pn ON stk.t = pn.word GROUP BY ALL),
lab AS (SELECT s.product_id, s.review_id, s.sentence_id,
               CASE WHEN {V.strip("coalesce(s.text, '')")} = '' THEN 'neutral'
                    WHEN coalesce(h.p, 0) > coalesce(h.n, 0) THEN 'positive'
                    WHEN coalesce(h.n, 0) > coalesce(h.p, 0) THEN 'negative' ELSE 'neutral' END AS sentiment
        FROM {src} s LEFT JOIN sh h ON s.product_id = h.product_id AND s.review_id = h.review_id
                                    AND s.sentence_id = h.sentence_id)"""


@register("review_overview", f"""WITH {V.REVIEWS}, sr AS ({V.sentence_rows()}),
{_lexicon_sql("sr")},
ov AS (SELECT product_id, count(*) AS n_reviews,
              round(sum(coalesce(rating, 0.0)) / count(*), 6) AS avg_rating,
              count_if(coalesce(helpful_votes, 0) > 0) AS helpful_reviews,
              round(sum(CAST(coalesce(length(text), 0) AS DOUBLE) * 0.25), 6) AS total_tokens
       FROM reviews GROUP BY ALL),
sc AS (SELECT product_id, count(*) AS n_sentences, count_if(sentiment = 'positive') AS positive_sentences,
              count_if(sentiment = 'negative') AS negative_sentences,
              count_if(sentiment = 'neutral') AS neutral_sentences FROM lab GROUP BY ALL)
SELECT ov.*, coalesce(sc.n_sentences, 0) AS n_sentences,
       coalesce(sc.positive_sentences, 0) AS positive_sentences,
       coalesce(sc.negative_sentences, 0) AS negative_sentences,
       coalesce(sc.neutral_sentences, 0) AS neutral_sentences
FROM ov LEFT JOIN sc USING (product_id)""")
def q_review_overview(spark, sf):
    out = ag.review_overview(tb.reviews(spark, sf))
    return out.select("product_id", "n_reviews", F.round("avg_rating", 6).alias("avg_rating"),
                      "helpful_reviews", F.round("total_tokens", 6).alias("total_tokens"),
                      "n_sentences", "positive_sentences", "negative_sentences", "neutral_sentences")


FLAGSHIP = "review_overview"


@register("label_sentences", f"""WITH {V.REVIEWS}, sr AS ({V.sentence_rows()}),
{_lexicon_sql("sr", _POS, _NEG)}
SELECT product_id, review_id, sentence_id, sentiment FROM lab""")
def q_label_sentences(spark, sf):
    s = se.split_sentences(tb.reviews(spark, sf))
    return s.select("product_id", "review_id", "sentence_id",
                    se.lexicon_label("text", _POS, _NEG).alias("sentiment"))


@register("rating_distribution", f"""WITH {V.REVIEWS},
sel AS (SELECT * FROM reviews WHERE verified = true),
tot AS (SELECT product_id, count(*) AS n FROM sel GROUP BY ALL)
SELECT s.product_id, 'rating_' || CASE WHEN rating = floor(rating) THEN CAST(CAST(floor(rating) AS BIGINT) AS VARCHAR)
                                  ELSE CAST(rating AS VARCHAR) END AS rating_key,
       count(*) AS count, round(count(*) / any_value(t.n), 6) AS proportion
FROM sel s JOIN tot t USING (product_id) WHERE rating IS NOT NULL GROUP BY s.product_id, rating""")
def q_rating_distribution(spark, sf):
    r = sel.select_verified(tb.reviews(spark, sf, verified=True), True)
    d = ag.rating_distribution(r)
    return d.select("product_id", "rating_key", "count", F.round("proportion", 6).alias("proportion"))


@register("total_reviews", f"""WITH {V.REVIEWS}
SELECT product_id, count(DISTINCT review_id) AS total_reviews FROM reviews GROUP BY ALL""")
def q_total_reviews(spark, sf):
    return ag.total_reviews(tb.reviews(spark, sf))


@register("index_staleness", f"""WITH {V.REVIEWS}, {V.SENTENCE_VECS}, sr AS ({V.sentence_rows()}),
a AS (SELECT product_id, count(DISTINCT review_id) AS cached_reviews FROM sr GROUP BY ALL),
b AS (SELECT product_id, count(DISTINCT review_id) AS current_reviews FROM reviews WHERE verified GROUP BY ALL)
SELECT coalesce(a.product_id, b.product_id) AS product_id, coalesce(cached_reviews, 0) AS cached_reviews,
       coalesce(current_reviews, 0) AS current_reviews,
       NOT (coalesce(cached_reviews, 0) = coalesce(current_reviews, 0)) AS stale
FROM a FULL OUTER JOIN b ON a.product_id = b.product_id""")
def q_index_staleness(spark, sf):
    r = tb.reviews(spark, sf, verified=True)
    cached = se.split_sentences(r)
    current = sel.select_verified(r, True)
    return ag.index_staleness(cached, current).select(
        "product_id", "cached_reviews", "current_reviews", "stale")


# --------------------------------------------------------------------------- 2.6 / 2.7 themes & sentences
from opinio.dictionaries import THEMES_FUNCTION_WORDS as _FW  # noqa: E402
from opinio.operators import themes as th  # noqa: E402
from opinio.operators import report as rp  # noqa: E402


@register("theme_pct_string", f"""WITH {V.cleaned("inclusive")},
th(word, theme, theme_idx) AS (VALUES {_RS.theme_values(_FW)}),
tk AS (SELECT parent_asin, unnest({V.tokens("clean_text")}) AS t FROM cleaned),
tc AS (SELECT parent_asin, theme, theme_idx, count(*) AS n FROM tk JOIN th ON tk.t = th.word GROUP BY ALL),
{_RS.theme_strings_ctes("tc", "parent_asin")}
SELECT p.parent_asin, coalesce(counts_str, 'N/A') AS themes_counts, coalesce(pct_str, 'N/A') AS themes_pct
FROM (SELECT DISTINCT parent_asin FROM cleaned) p LEFT JOIN tstr USING (parent_asin)""")
def q_theme_pct_string(spark, sf):
    c = _cleaned(spark, sf, "inclusive")
    tc = th.corpus_theme_counts(c, "parent_asin", "clean_text", _FW)
    arr = tc.groupBy("parent_asin").agg(F.collect_list(F.struct("theme", "theme_idx", "n")).alias("_c"))
    cstr, pstr = th.theme_strings(F.col("_c"))
    out = c.select("parent_asin").distinct().join(arr, "parent_asin", "left")
    na = F.lit("N/A")
    return out.select("parent_asin", F.coalesce(cstr, na).alias("themes_counts"),
                      F.coalesce(pstr, na).alias("themes_pct"))


def _per_review_sentences_sql() -> str:
    return f"""WITH {V.REVIEWS},
{_RS.sentence_score_ctes("reviews", "review_id", "text", _FW, _POS, _NEG)}"""


def _scored(col):
    return th.scored_sentences(col, _FW, _POS, _NEG)


@register("split_sentences_long", _per_review_sentences_sql()
          + "\nSELECT review_id, CAST(i AS INTEGER) AS sent_pos, s AS text FROM sents")
def q_split_sentences_long(spark, sf):
    r = tb.reviews(spark, sf)
    return r.select("review_id", F.posexplode(tx.long_sentence_array("text")).alias("sent_pos", "text"))


@register("sentence_keyword_score", _per_review_sentences_sql()
          + "\nSELECT review_id, CAST(i AS INTEGER) AS sent_pos, score, pos_score, neg_score FROM sc")
def q_sentence_keyword_score(spark, sf):
    r = tb.reviews(spark, sf)
    x = r.select("review_id", F.explode(_scored("text")).alias("x"))
    return x.select("review_id", F.col("x.i").alias("sent_pos"), F.col("x.score").alias("score"),
                    F.col("x.pos_score").alias("pos_score"), F.col("x.neg_score").alias("neg_score"))


@register("representative_sentences", _per_review_sentences_sql() + """,
ev AS (SELECT review_id,
         array_to_string(list(s ORDER BY score DESC, i)[1:3], ' | ') AS evidence,
         array_to_string(list(s ORDER BY pos_score DESC, i)[1:2], ' | ') AS pos_snippets,
         array_to_string(list(s ORDER BY neg_score DESC, i)[1:2], ' | ') AS neg_snippets
       FROM sc GROUP BY ALL)
SELECT r.review_id, coalesce(evidence, '') AS evidence, coalesce(pos_snippets, '') AS pos_snippets,
       coalesce(neg_snippets, '') AS neg_snippets FROM reviews r LEFT JOIN ev USING (review_id)""")
def q_representative_sentences(spark, sf):
    r = tb.reviews(spark, sf).withColumn("_sc", _scored("text"))
    return r.select("review_id",
                    tx.pack_evidence(th.top_sentences(F.col("_sc"), "score", 3)).alias("evidence"),
                    tx.pack_evidence(th.top_sentences(F.col("_sc"), "pos_score", 2)).alias("pos_snippets"),
                    tx.pack_evidence(th.top_sentences(F.col("_sc"), "neg_score", 2)).alias("neg_snippets"))


@register("extractive_summary", _per_review_sentences_sql() + f""",
sm AS (SELECT review_id, {_RS.summary_agg(40)} AS summary FROM sc GROUP BY ALL)
SELECT r.review_id, coalesce(summary, '') AS summary FROM reviews r LEFT JOIN sm USING (review_id)""")
def q_extractive_summary(spark, sf):
    r = tb.reviews(spark, sf)
    return r.select("review_id", th.extractive_summary(_scored("text"), 40).alias("summary"))


@register("count_word", f"""WITH {V.REVIEWS}
SELECT review_id, len(list_filter({V.tokens("text")}, lambda t: t = 'the')) AS n_the,
       len(list_filter({V.tokens("text")}, lambda t: t = 'worthless')) AS n_worthless FROM reviews""")
def q_count_word(spark, sf):
    r = tb.reviews(spark, sf)
    return r.select("review_id", tx.count_word("text", "the").alias("n_the"),
                    tx.count_word("text", "Worthless").alias("n_worthless"))


# --------------------------------------------------------------------------- v2 summarizer variants
def _v2_rows(spark, sf, mode="strict"):
    c = tb.corpus_reviews(spark, sf)
    c = c.withColumn("credibility", cl.credibility_open(
        F.col("verified_purchase"), F.col("helpful_vote"), F.col("text")))
    if mode == "strict":
        c = c.where(F.coalesce(F.col("verified_purchase"), F.lit(False)))
    return c.where(F.length(F.coalesce(F.col("text"), F.lit(""))) >= 30)


_V2_CRED = """(1.0 + CASE WHEN coalesce(verified_purchase, false) THEN 1.0 ELSE 0.0 END
   + least(0.35, coalesce(helpful_vote, 0.0) / 50.0)
   + CASE WHEN {wc} > 20 THEN 0.05 ELSE 0.0 END
   - CASE WHEN {spam} THEN 0.4 ELSE 0.0 END)"""


def _v2_sql() -> str:
    from opinio.dictionaries import SPAM_WORDS_V2
    cred = _V2_CRED.format(wc=V.word_count("text"), spam=V.spam_sql("text", SPAM_WORDS_V2))
    return f"""WITH {V.CORPUS},
v2 AS (SELECT *, {cred} AS credibility FROM corpus
       WHERE coalesce(verified_purchase, false) AND length(coalesce(text, '')) >= 30)"""


@register("credibility_open", _v2_sql() + "\nSELECT CAST(pos AS VARCHAR) AS review_id, round(credibility, 6) AS credibility FROM v2")
def q_credibility_open(spark, sf):
    return _v2_rows(spark, sf).select(F.col("pos").cast("string").alias("review_id"),
                                      F.round("credibility", 6).alias("credibility"))


@register("product_stats_rows", _v2_sql() + """
SELECT parent_asin, round(avg(rating), 6) AS avg_rating, count(*) AS review_count,
       round(avg(credibility), 6) AS credibility_score
FROM v2 WHERE parent_asin IS NOT NULL GROUP BY ALL HAVING count(*) >= 10""")
def q_product_stats_rows(spark, sf):
    s = rp.product_stats_rows(_v2_rows(spark, sf)).where(F.col("review_count") >= 10)
    return s.select("parent_asin", F.round("avg_rating", 6).alias("avg_rating"), "review_count",
                    F.round("credibility_score", 6).alias("credibility_score"))


# --------------------------------------------------------------------------- 2.7 / 2.8 resume, upsert, caps
def _stats_sql(mode: str, having: str = "TRUE") -> str:
    return f"""(SELECT parent_asin, round(avg(rating), 6) AS avg_rating, count(rating) AS review_count,
        round(avg(credibility_score), 6) AS credibility_score FROM cleaned_{mode}
        GROUP BY parent_asin HAVING {having})"""


def _two_modes_sql() -> str:
    strict = V.cleaned("strict").replace("cleaned AS (", "cleaned_strict AS (")
    incl = V.cleaned("inclusive")
    # reuse the CTE chain twice under different names
    incl = incl.split("canon AS (", 1)[1]
    incl = "canon_i AS (" + incl.replace("FROM canon ", "FROM canon_i ").replace(
        "filtered AS (", "filtered_i AS (").replace("FROM filtered\n", "FROM filtered_i\n").replace(
        "deduped AS (", "deduped_i AS (").replace("FROM deduped ", "FROM deduped_i ").replace(
        "cleaned AS (", "cleaned_inclusive AS (")
    return strict + ",\n" + incl


def _stats(spark, sf, mode, min_n=None):
    s = rp.product_stats(_cleaned(spark, sf, mode))
    if min_n is not None:
        s = s.where(F.col("review_count") >= min_n)
    return s.select("parent_asin", F.round("avg_rating", 6).alias("avg_rating"), "review_count",
                    F.round("credibility_score", 6).alias("credibility_score"))


@register("upsert_keep_last", f"""WITH {_two_modes_sql()},
ex AS {_stats_sql("strict")}, nw AS {_stats_sql("inclusive", "count(rating) >= 40")}
SELECT * FROM nw UNION ALL SELECT * FROM ex WHERE parent_asin NOT IN (SELECT parent_asin FROM nw)""")
def q_upsert(spark, sf):
    return rp.upsert_keep_last(_stats(spark, sf, "strict"), _stats(spark, sf, "inclusive", 40))


@register("union_outputs", f"""WITH {_two_modes_sql()},
ex AS {_stats_sql("strict")}, nw AS {_stats_sql("inclusive", "count(rating) >= 40")}
SELECT * FROM ex UNION ALL SELECT * FROM nw""")
def q_union_outputs(spark, sf):
    return _stats(spark, sf, "strict").unionByName(_stats(spark, sf, "inclusive", 40))


@register("resume_anti_join", f"""WITH {_two_modes_sql()},
done AS {_stats_sql("strict", "count(rating) >= 20")}, todo AS {_stats_sql("inclusive")}
SELECT * FROM todo WHERE CAST(parent_asin AS VARCHAR) NOT IN (SELECT CAST(parent_asin AS VARCHAR) FROM done)""")
def q_resume(spark, sf):
    return rp.resume_anti_join(_stats(spark, sf, "inclusive"), _stats(spark, sf, "strict", 20))


@register("product_lookup", f"""WITH {V.cleaned("inclusive")}
SELECT * FROM {_stats_sql("inclusive").replace("cleaned_inclusive", "cleaned")} WHERE parent_asin = 'src3'""")
def q_product_lookup(spark, sf):
    return _stats(spark, sf, "inclusive").where(F.col("parent_asin") == "src3")


@register("compact_report", RS.report_sql(min_reviews=20, mode="strict").replace(
    "SELECT g.parent_asin, round(g.avg_rating, 3) AS avg_rating,",
    "SELECT parent_asin, avg_rating, review_count, credibility_score, themes_pct FROM (\n"
    "SELECT g.parent_asin, round(g.avg_rating, 3) AS avg_rating,") + ")")
def q_compact_report(spark, sf):
    return q_credibility_report(spark, sf).select(
        "parent_asin", "avg_rating", "review_count", "credibility_score", "themes_pct")


# --------------------------------------------------------------------------- user dictionaries


@register("theme_counts", f"""WITH {V.cleaned("inclusive")},
th(word, theme, theme_idx) AS (VALUES {_RS.theme_values(_FW)}),
tk AS (SELECT parent_asin, unnest({V.tokens("clean_text")}) AS t FROM cleaned)
SELECT parent_asin, theme, theme_idx, count(*) AS n FROM tk JOIN th ON tk.t = th.word GROUP BY ALL""")
def q_theme_counts_user(spark, sf):
    return th.corpus_theme_counts(_cleaned(spark, sf, "inclusive"), "parent_asin", "clean_text",
                                  themes=_FW)


@register("credibility_report_user_dictionary", RS.report_sql(
    min_reviews=20, mode="strict", themes=_FW, pos=_POS, neg=_NEG))
def q_credibility_report_user(spark, sf):
    return rp.credibility_report(_cleaned(spark, sf, "strict"), min_reviews=20, filter_mode="strict",
                                 themes=_FW, pos=_POS, neg=_NEG)


# --------------------------------------------------------------------------- 2.11 streaming
def _staged(spark, sf):
    """The events feed, run once into a staged table of a run folder of its own."""
    import uuid

    from opinio.session import checkpoint_dir
    from opinio.streaming import refresh as st
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    run = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    # a glob makes the file stream source list the events file itself
    stream = st.review_stream(spark, f"{sf}/events.parque[t]", schema)
    st.stage_reviews(stream, f"{run}/staged", f"{run}/checkpoint").awaitTermination()
    return st.staged_reviews(spark, f"{run}/staged", stream.schema)


@register("stream_review_counts", """
SELECT CAST(user_id AS VARCHAR) AS product_id, count(DISTINCT event_id) AS new_reviews
FROM events GROUP BY ALL""")
def q_stream_review_counts(spark, sf):
    from opinio.streaming import refresh as st
    return st.review_counts(_staged(spark, sf))


@register("stream_daily_counts", """
SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(user_id AS VARCHAR) AS product_id, count(*) AS new_reviews
FROM (SELECT event_id, user_id, min(ts) AS ts FROM events GROUP BY ALL) GROUP BY ALL""")
def q_stream_daily_counts(spark, sf):
    from opinio.streaming import refresh as st
    d = st.daily_counts(_staged(spark, sf))
    return d.select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "product_id", "new_reviews")


# --------------------------------------------------------------------------- JSON built from the documents
_RAW = """raw AS (SELECT doc_id AS pos, source AS asin, text, doc_id % 4 AS kind FROM documents)"""


def _json_lines(spark, sf):
    """Review lines with mixed spellings, bad values and broken syntax, a line a document."""
    d = tb.table(spark, sf, "documents")
    k = F.col("doc_id") % 4
    base = [F.col("source").alias("parent_asin"), F.col("text")]
    return d.select(F.col("doc_id").alias("pos"), F.when(k == 0, F.to_json(F.struct(
        *base, F.lit(True).alias("verified_purchase"), (F.col("doc_id") % 9).alias("helpful_vote"), F.lit(4.5).alias("rating"))))
        .when(k == 1, F.to_json(F.struct(*base, F.lit("true").alias("verified"), F.lit("7").alias("helpful_votes"),
                                         F.lit("3").alias("rating"))))
        .when(k == 2, F.to_json(F.struct(*base, F.lit("maybe").alias("verified"), F.lit("n/a").alias("helpful_vote"),
                                         F.lit("bad").alias("rating"))))
        .otherwise(F.concat(F.lit("{broken "), F.col("source"))).alias("value"))


@register("adapt_review_shapes", f"""WITH {_RAW}
SELECT pos, asin AS parent_asin, length(text) AS n_chars,
       CASE kind WHEN 0 THEN 4.5 WHEN 1 THEN 3.0 END::DOUBLE AS rating, kind <> 2 AS verified,
       CASE kind WHEN 0 THEN pos % 9 WHEN 1 THEN 7 ELSE 0 END::DOUBLE AS helpful_vote FROM raw WHERE kind <> 3""")
def q_adapt_review_shapes(spark, sf):
    from opinio.sources import jsonl
    good, _ = jsonl.parse_review_lines(_json_lines(spark, sf))
    c = cl.canonicalize_corpus(good)
    return c.select("pos", "parent_asin", F.length("text").alias("n_chars"), "rating", "verified", "helpful_vote")


@register("quarantine", f"""WITH {_RAW} SELECT pos, '{{broken ' || asin AS line FROM raw WHERE kind = 3""")
def q_quarantine(spark, sf):
    from opinio.sources import jsonl
    _, bad = jsonl.parse_review_lines(_json_lines(spark, sf))
    return bad.select("pos", F.col("value").alias("line"))


def _responses(spark, sf):
    """Generator responses in three forms, one a document."""
    d = tb.table(spark, sf, "documents")
    k = F.col("doc_id") % 3
    obj = F.to_json(F.struct(F.col("lang").alias("summary"), F.array(
        F.struct(F.col("source").alias("entity")), F.struct(F.lit("").alias("entity"))).alias("entities")))
    return d.select("doc_id", F.when(k == 0, obj).when(k == 1, F.concat(F.lit("Here you are: "), obj))
                    .otherwise(F.concat(F.lit("plain "), F.col("lang"))).alias("response"))


@register("parse_summary_response", """
SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN lang ELSE 'plain ' || lang END AS summary,
       CASE WHEN doc_id % 3 < 2 THEN source ELSE '' END AS entities FROM documents""")
def q_parse_summary_response(spark, sf):
    from opinio.operators import hooks
    r = _responses(spark, sf).select("doc_id", hooks.parse_summary_response("response").alias("p"))
    return r.select("doc_id", "p.summary", F.array_join("p.entities", ",").alias("entities"))


@register("entity_names", """
SELECT doc_id, source || ',' || lang AS names FROM documents""")
def q_entity_names(spark, sf):
    from opinio.operators import hooks
    d = tb.table(spark, sf, "documents")
    text = F.concat(F.lit('["'), F.col("source"), F.lit('", {"name": "x"}, {"entity": null}, "", {"entity": "'),
                    F.col("lang"), F.lit('"}, null]'))
    return d.select("doc_id", F.array_join(hooks.entity_names(text), ",").alias("names"))


@register("prompt_block", _filter_sql(1500) + """
SELECT product_id, string_agg('Review_id: ' || review_id || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY pos) AS prompt
FROM selected JOIN reviews USING (product_id, review_id) GROUP BY ALL""")
def q_prompt_block(spark, sf):
    from opinio.operators import hooks
    chosen, _ = _filter_reviews(spark, sf, 1500)
    return hooks.prompt_block(chosen, order_col="pos")


# --------------------------------------------------------------------------- aspects, chunks, misc
from opinio.operators import aspects as asp  # noqa: E402


@register("aspect_mining", f"""WITH {V.REVIEWS}, {V.aspects()}
SELECT product_id, entity AS aspect, review_count, entity_idx AS rank FROM ents""")
def q_aspect_mining(spark, sf):
    return asp.aspect_mining(tb.reviews(spark, sf)).select("product_id", "aspect", "review_count", "rank")


def _chunk_sql(max_tokens: int) -> str:
    parts = (f"list_filter(string_split(regexp_replace({V.strip('coalesce(text, ' + chr(39) * 2 + ')')}, "
             f"'([.!?]){V.WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')")
    init = "{'cur': '', 'wc': 0::BIGINT, 'done': []::STRUCT(t VARCHAR, wc BIGINT)[]}"
    wc = V.word_count("s")
    step = (f"lambda acc, s: CASE WHEN (CASE WHEN acc.cur = '' THEN {wc} ELSE acc.wc + {wc} END) <= {max_tokens} "
            f"THEN {{'cur': CASE WHEN acc.cur = '' THEN s ELSE acc.cur || ' ' || s END, "
            f"'wc': CASE WHEN acc.cur = '' THEN {wc} ELSE acc.wc + {wc} END, 'done': acc.done}} "
            f"ELSE {{'cur': s, 'wc': {wc}, 'done': CASE WHEN acc.cur <> '' THEN "
            f"list_append(acc.done, {{'t': acc.cur, 'wc': acc.wc}}) ELSE acc.done END}} END")
    return f"""WITH {V.REVIEWS},
st AS (SELECT review_id, list_reduce({parts}, {step}, {init}) AS st FROM reviews),
ch AS (SELECT review_id, CASE WHEN st.cur <> '' THEN list_append(st.done, {{'t': st.cur, 'wc': st.wc}})
                              ELSE st.done END AS chunks FROM st),
c1 AS (SELECT review_id, unnest(chunks) AS c, generate_subscripts(chunks, 1) AS ci FROM ch),
c2 AS (SELECT review_id, ci, c.t AS t, c.wc AS wc,
              list_filter(regexp_split_to_array(c.t, '{V.WS}+'), lambda w: w <> '') AS words FROM c1),
pieces AS (SELECT review_id, ci, 0 AS pi, t FROM c2 WHERE wc <= {max_tokens}
           UNION ALL
           SELECT review_id, ci, i AS pi, array_to_string(words[i * {max_tokens} + 1:(i + 1) * {max_tokens}], ' ') AS t
           FROM c2, LATERAL (SELECT unnest(range(0, CAST(floor((len(words) - 1) / {max_tokens}) AS BIGINT) + 1)) AS i) g
           WHERE wc > {max_tokens})
SELECT review_id, CAST(row_number() OVER (PARTITION BY review_id ORDER BY ci, pi) - 1 AS INTEGER) AS chunk_id,
       t AS chunk FROM pieces"""


@register("chunk_by_budget", _chunk_sql(120))
def q_chunk_by_budget(spark, sf):
    r = tb.reviews(spark, sf)
    return r.select("review_id", F.posexplode(asp.chunk_by_budget("text", 120)).alias("chunk_id", "chunk")) \
        .withColumn("chunk_id", F.col("chunk_id").cast("int"))


@register("shortest_review", f"""WITH {V.REVIEWS}
SELECT product_id, arg_min(review_id, (coalesce(length(text), 0), pos)) AS review_id FROM reviews GROUP BY ALL""")
def q_shortest_review(spark, sf):
    r = tb.reviews(spark, sf)
    return r.groupBy("product_id").agg(F.min_by("review_id", F.struct(
        F.coalesce(F.length("text"), F.lit(0)), F.col("pos"))).alias("review_id"))


@register("sentence_review_join", f"""WITH {V.REVIEWS}, s AS ({V.sentence_rows()}),
last AS (SELECT product_id, review_id, arg_max(rating, pos) AS rating FROM reviews GROUP BY ALL)
SELECT s.product_id, s.review_id, s.sentence_id, l.rating FROM s JOIN last l USING (product_id, review_id)""")
def q_sentence_review_join(spark, sf):
    r = tb.reviews(spark, sf)
    last = r.groupBy("product_id", "review_id").agg(F.max_by("rating", "pos").alias("rating"))
    return split_sentences(r).join(last, ["product_id", "review_id"]).select(
        "product_id", "review_id", "sentence_id", "rating")


@register("restrict_to_selected", f"""WITH {V.REVIEWS}, s AS ({V.sentence_rows()})
SELECT product_id, count(*) AS n_sentences FROM s
WHERE (product_id, review_id) IN (SELECT product_id, review_id FROM reviews WHERE verified) GROUP BY ALL""")
def q_restrict_to_selected(spark, sf):
    r = tb.reviews(spark, sf, verified=True)
    chosen = sel.select_verified(r, True).select("product_id", "review_id")
    return split_sentences(r).join(chosen, ["product_id", "review_id"], "left_semi") \
        .groupBy("product_id").agg(F.count(F.lit(1)).alias("n_sentences"))


@register("corpus_overview", RS.report_sql(min_reviews=20, mode="strict").replace(
    "SELECT g.parent_asin, round(g.avg_rating, 3) AS avg_rating,",
    "SELECT count(*) AS n_products, round(avg(avg_rating), 6) AS mean_rating, "
    "round(avg(credibility_score), 6) AS mean_credibility FROM (\n"
    "SELECT g.parent_asin, round(g.avg_rating, 3) AS avg_rating,") + ")")
def q_corpus_overview(spark, sf):
    r = q_credibility_report(spark, sf)
    return r.agg(F.count(F.lit(1)).alias("n_products"), F.round(F.avg("avg_rating"), 6).alias("mean_rating"),
                 F.round(F.avg("credibility_score"), 6).alias("mean_credibility"))


@register("applied_filters", f"""WITH {V.REVIEWS},
a AS (SELECT product_id, count(*) AS n0, count_if(coalesce(verified, false)) AS n1,
             count_if(coalesce(verified, false) AND coalesce(helpful_votes, 0) <= 0) AS n2
      FROM reviews GROUP BY ALL)
SELECT product_id, array_to_string(list_filter(['verified_only', 'exclude_useful'],
         lambda x: (x = 'verified_only' AND n0 - n1 > 0) OR (x = 'exclude_useful' AND n1 - n2 > 0)), ',') AS applied
FROM a""")
def q_applied_filters(spark, sf):
    r = tb.reviews(spark, sf, verified=True).withColumn("tokens", tx.estimate_tokens("text"))
    crit = sel.FilteringCriteria(use_verified=True, use_useful=False)
    kept = sel.select_useful(sel.select_verified(r, True), False).select(F.col("product_id").alias("_ck"), "tokens")
    none = r.where(F.lit(False)).select(F.col("product_id").alias("_tk"))
    st = sel.selection_stats(r, kept, none, "product_id", 4000, crit)
    names = F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in
                      ("verified_only", "useful_only", "exclude_verified", "exclude_useful")])
    return st.select("product_id", F.array_join(F.filter(names, lambda x: x.isNotNull()), ",").alias("applied"))


# --------------------------------------------------------------------------- small projections / filters
@register("coerce_numeric", f"""WITH {V.cleaned("inclusive")}
SELECT parent_asin, CAST(pos AS VARCHAR) AS review_id, rating, verified, helpful_vote FROM canon""")
def q_coerce_numeric(spark, sf):
    c = cl.canonicalize_corpus(tb.corpus_reviews(spark, sf))
    return c.select("parent_asin", F.col("pos").cast("string").alias("review_id"), "rating", "verified",
                    "helpful_vote")


@register("preview", f"""WITH {V.REVIEWS}
SELECT product_id, review_id, pos FROM reviews ORDER BY pos LIMIT 2""")
def q_preview(spark, sf):
    return tb.reviews(spark, sf).select("product_id", "review_id", "pos").orderBy("pos").limit(2)


@register("min_length", f"""WITH {V.cleaned("inclusive")}
SELECT parent_asin, count_if(length(review_text) > 30) AS longer_than_30,
       count_if(length(coalesce(review_text, '')) >= 30) AS at_least_30 FROM canon GROUP BY ALL""")
def q_min_length(spark, sf):
    c = cl.canonicalize_corpus(tb.corpus_reviews(spark, sf))
    n = F.length(F.coalesce(F.col("review_text"), F.lit("")))
    return c.groupBy("parent_asin").agg(F.count_if(n > 30).alias("longer_than_30"),
                                        F.count_if(n >= 30).alias("at_least_30"))


@register("truncate_text", f"""WITH {V.REVIEWS}
SELECT review_id, substr(coalesce(text, ''), 1, 3000) AS model_input FROM reviews""")
def q_truncate_text(spark, sf):
    r = tb.reviews(spark, sf)
    return r.select("review_id", tx.truncate_text(F.coalesce(F.col("text"), F.lit("")), 3000).alias("model_input"))


@register("unpack_evidence", _per_review_sentences_sql() + f""",
ev AS (SELECT review_id, array_to_string(list(s ORDER BY score DESC, i)[1:3], ' | ') AS evidence FROM sc GROUP BY ALL)
SELECT r.review_id, len(list_filter(list_transform(string_split(coalesce(evidence, ''), '|'),
         lambda p: {V.strip("p")}), lambda p: p <> '')) AS n_parts
FROM reviews r LEFT JOIN ev USING (review_id)""")
def q_unpack_evidence(spark, sf):
    rep = q_representative_sentences(spark, sf)
    return rep.select("review_id", F.size(tx.unpack_evidence("evidence")).alias("n_parts"))


# --------------------------------------------------------------------------- queries in modules of their own
from opinio.plans import feed_queries, file_queries, index_queries, report_queries  # noqa: E402, F401
