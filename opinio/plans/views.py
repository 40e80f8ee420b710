"""The FIXTURES review views written in DuckDB SQL, for oracle queries."""

from opinio.dictionaries import (NEGATIVE_FUNCTION_WORDS, PERSONAL_WORDS, POSITIVE_FUNCTION_WORDS,
                                 SPAM_PHRASES)
from opinio.functions.text import WS

REVIEWS = """reviews AS (
  SELECT d.source AS product_id, CAST(d.doc_id AS VARCHAR) AS review_id, d.doc_id AS pos,
         d.text, CAST(1 + d.doc_id % 5 AS DOUBLE) AS rating, (l.quality = 1) AS verified,
         CAST(CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE d.doc_id % 13 END AS INTEGER) AS helpful_votes,
         d.lang
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

CORPUS = REVIEWS + """,
corpus AS (
  SELECT product_id AS parent_asin, CAST(NULL AS VARCHAR) AS title, text, rating,
         verified AS verified_purchase, CAST(helpful_votes AS DOUBLE) AS helpful_vote, pos, lang
  FROM reviews)"""

SENTENCE_VECS = """sentence_vecs AS (
  SELECT CAST(label AS VARCHAR) AS product_id, CAST(vec_id % 7 AS VARCHAR) AS review_id,
         CAST(vec_id AS INTEGER) AS sentence_id, 's' || CAST(vec_id AS VARCHAR) AS text,
         (['positive', 'negative', 'neutral'])[CAST(vec_id % 3 + 1 AS INTEGER)] AS sentiment,
         embedding
  FROM embeddings)"""

# strip(): leading/trailing whitespace
def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"

NON_WORD = "[^\\p{L}\\p{N}_]+"

def tokens(x: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '{NON_WORD}'), "
            f"lambda w: w <> '')")

def sentences(x: str) -> str:
    """strip -> split after . ! ? -> strip parts -> drop empties (no look-behind in RE2)."""
    s = strip(f"coalesce({x}, '')")
    return (f"list_filter(list_transform(string_split(regexp_replace({s}, '([.!?]){WS}+', "
            f"'\\1' || chr(1), 'g'), chr(1)), lambda p: {strip('p')}), lambda p: p <> '')")

def word_count(x: str) -> str:
    return (f"len(list_filter(regexp_split_to_array(coalesce({x}, ''), '{WS}+'), "
            f"lambda w: w <> ''))")


def spam_sql(x: str, phrases=SPAM_PHRASES) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({x}, '')), '{p}')" for p in phrases) + ")"


def personal_sql(x: str) -> str:
    # RE2 has no look-around: consume the preceding character and put it back.
    return (f"regexp_replace({x}, '(^|[^\\p{{L}}\\p{{N}}_])(?i:{'|'.join(PERSONAL_WORDS)})"
            f"([^.!?\\p{{L}}\\p{{N}}_][^.!?]*)?[.!?]', '\\1', 'g')")


def cleaned(mode: str = "strict") -> str:
    """CTEs canon -> filtered -> deduped -> cleaned (gen-1 cleaning order)."""
    strict = "WHERE verified = true" if mode == "strict" else ""
    rt = "review_text"
    return CORPUS + f""",
canon AS (
  SELECT parent_asin, pos, TRY_CAST(rating AS DOUBLE) AS rating,
         coalesce(verified_purchase, false) AS verified,
         coalesce(TRY_CAST(helpful_vote AS DOUBLE), 0.0) AS helpful_vote,
         {strip("coalesce(title, '') || '. ' || coalesce(text, '')")} AS review_text
  FROM corpus),
filtered AS (SELECT * FROM canon WHERE length(review_text) > 30 AND NOT {spam_sql(rt)}),
deduped AS (
  SELECT * FROM filtered
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(lower(review_text), '{NON_WORD}', '', 'g')
                             ORDER BY pos) = 1),
cleaned AS (
  SELECT *, {personal_sql(rt)} AS clean_text,
         greatest(0.0, least(1.0, 1.0 - CASE WHEN verified THEN 0.0 ELSE 0.5 END
           + least(helpful_vote / 50.0, 0.35) - CASE WHEN {spam_sql(rt)} THEN 0.4 ELSE 0.0 END
           + CASE WHEN length(review_text) > 300 THEN 0.05 ELSE 0.0 END)) AS credibility_score
  FROM deduped {strict})"""


def hash_embed(x: str, dim: int = 64) -> str:
    buckets = f"list_transform({tokens(x)}, lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim})"
    return (f"list_transform(range({dim}), lambda i: CAST(len(list_filter({buckets}, "
            f"lambda b: b = i)) AS FLOAT))")


def sentence_rows(src: str = "reviews") -> str:
    """Sentence rows (product_id, review_id, sentence_id, text) of a review CTE."""
    return f"""SELECT product_id, review_id, CAST(g.i - 1 AS INTEGER) AS sentence_id, arr[g.i] AS text
  FROM (SELECT product_id, review_id, {sentences("text")} AS arr FROM {src}
        WHERE review_id <> '' AND coalesce(text, '') <> '') s,
       LATERAL (SELECT unnest(range(1, len(arr) + 1)) AS i) g"""


def importance_ctes(src: str) -> str:
    """From src(product_id, review_id, d, v) -- pooled review vectors, one row per
    dimension -- build imp(product_id, review_id, importance)."""
    return f"""nrm AS (SELECT product_id, review_id, sqrt(sum(v * v)) AS n FROM {src} GROUP BY ALL),
unit AS (SELECT p.product_id, p.review_id, p.d, p.v / CASE WHEN n.n = 0 THEN 1.0 ELSE n.n END AS u
         FROM {src} p JOIN nrm n USING (product_id, review_id)),
cen0 AS (SELECT product_id, d, avg(u) AS c FROM unit GROUP BY ALL),
cn AS (SELECT product_id, sqrt(sum(c * c)) AS n FROM cen0 GROUP BY ALL),
cen AS (SELECT c.product_id, c.d, c.c / CASE WHEN cn.n = 0 THEN 1.0 ELSE cn.n END AS c
        FROM cen0 c JOIN cn USING (product_id)),
sim AS (SELECT u.product_id, u.review_id,
               round(greatest(-1.0, least(1.0, sum(u.u * c.c))), 9) AS sim
        FROM unit u JOIN cen c ON u.product_id = c.product_id AND u.d = c.d GROUP BY ALL),
mm AS (SELECT product_id, min(sim) AS lo, max(sim) AS hi FROM sim GROUP BY ALL),
imp AS (SELECT s.product_id, s.review_id,
               CASE WHEN hi > lo THEN round((sim - lo) / (hi - lo), 9) ELSE 0.0 END AS importance
        FROM sim s JOIN mm USING (product_id))"""


def unit(x: str) -> str:
    n = f"sqrt(list_sum(list_transform({x}, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))))"
    return f"list_transform({x}, lambda v: CAST(v AS DOUBLE) / CASE WHEN {n} = 0 THEN 1.0 ELSE {n} END)"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def ordered_distinct(val: str, order: str, src: str, keys: str, sep: str, where: str = "TRUE") -> str:
    """string_agg of the distinct values of src in first-occurrence order."""
    return f"""(SELECT {keys}, string_agg({val}, '{sep}' ORDER BY o) AS agg
      FROM (SELECT {keys}, {val}, min({order}) AS o FROM {src} WHERE {where} GROUP BY ALL) GROUP BY ALL)"""


def doc_sentences(dim: int = 64) -> str:
    """CTEs up to ds(product_id, review_id, pos, sentence_id, text, sentiment, u): the
    sentence index of the documents, u being the unit vector."""
    def hits(words):
        ws = ", ".join(f"'{w}'" for w in words)
        return f"len(list_filter({tokens('text')}, lambda t: list_contains([{ws}], t)))"
    return REVIEWS + f""",
sr AS ({sentence_rows()}),
sh AS (SELECT *, {hits(POSITIVE_FUNCTION_WORDS)} AS p, {hits(NEGATIVE_FUNCTION_WORDS)} AS n,
              {hash_embed("text", dim)} AS e FROM sr),
ds AS (SELECT product_id, review_id, CAST(review_id AS BIGINT) AS pos, sentence_id, text,
              CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment,
              {unit("e")} AS u FROM sh)"""


def ngrams(t: str, n: int) -> str:
    return (f"list_transform(range(1, len({t}) - {n} + 2), "
            f"lambda i: array_to_string({t}[i:i + {n - 1}], ' '))")


def aspects(dim: int = 64, sizes=(1, 2, 3, 4, 5), top_k: int = 10) -> str:
    """CTEs up to ents(product_id, entity_idx, entity, review_count, u): the mined aspects."""
    grams = ngrams("t", sizes[0])
    for n in sizes[1:]:
        grams = f"list_concat({grams}, {ngrams('t', n)})"
    return f"""
tk AS (SELECT product_id, review_id, {tokens("text")} AS t FROM reviews),
gr AS (SELECT DISTINCT product_id, review_id, unnest({grams}) AS aspect FROM tk),
ac AS (SELECT product_id, aspect, count(*) AS review_count FROM gr GROUP BY ALL),
ar AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY review_count DESC, aspect) AS rank
       FROM ac QUALIFY rank <= {top_k}),
ae AS (SELECT *, {hash_embed("aspect", dim)} AS e FROM ar),
ents AS (SELECT product_id, CAST(rank AS INTEGER) AS entity_idx, aspect AS entity, review_count, {unit("e")} AS u FROM ae)"""


def questions(dim: int = 64) -> str:
    """CTEs up to qs(product_id, question_id, question, has_vector, u)."""
    return f"""
q0 AS (SELECT 'src' || CAST(conv_id % 25 AS VARCHAR) AS product_id, conv_id * 1000 + turn AS question_id,
              CASE WHEN (conv_id * 1000 + turn) % 7 = 0 THEN '  ' ELSE text END AS question
       FROM conversations WHERE role = 'user'),
q1 AS (SELECT *, {hash_embed("question", dim)} AS e FROM q0),
qs AS (SELECT product_id, question_id, question, question_id % 11 <> 0 AS has_vector, {unit("e")} AS u FROM q1)"""
