"""Reports as jobs, statuses, texts, chunks by other lengths, and aspects without repeats."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from opinio.dictionaries import NEGATIVE_FUNCTION_WORDS, POSITIVE_FUNCTION_WORDS, THEMES_FUNCTION_WORDS, THEMES_V2
from opinio.functions import text as tx
from opinio.operators import aspects as asp
from opinio.operators import chunks as ch
from opinio.operators import cleaning as cl
from opinio.operators import report as rp
from opinio.operators import selection as sel
from opinio.operators import status as st
from opinio.operators.report_job import run_credibility_report
from opinio.plans import report_sql as RS
from opinio.plans import views as V
from opinio.plans.catalog import register
from opinio.session import checkpoint_dir
from opinio.sources import tables as tb

_THEMES = [*THEMES_V2, *THEMES_FUNCTION_WORDS]      # those of the second generation, and a user's


@register("credibility_report_v2", RS.report_v2_sql(min_reviews=5, themes=_THEMES, pos=POSITIVE_FUNCTION_WORDS,
                                                    neg=NEGATIVE_FUNCTION_WORDS))
def q_credibility_report_v2(spark, sf):
    return rp.credibility_report_v2(tb.corpus_reviews(spark, sf), min_reviews=5, themes=_THEMES,
                                    pos=POSITIVE_FUNCTION_WORDS, neg=NEGATIVE_FUNCTION_WORDS)


@register("credibility_report_resumed", RS.report_sql(min_reviews=20, mode="inclusive", themes=_THEMES,
                                                      pos=POSITIVE_FUNCTION_WORDS, neg=NEGATIVE_FUNCTION_WORDS))
def q_credibility_report_resumed(spark, sf):
    """The stored report after a run that stopped between products and one that went on."""
    cleaned = cl.clean_corpus(tb.corpus_reviews(spark, sf), "inclusive")
    path = f"{checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    how = dict(batches=3, min_reviews=20, filter_mode="inclusive", themes=_THEMES, pos=POSITIVE_FUNCTION_WORDS,
               neg=NEGATIVE_FUNCTION_WORDS)
    run_credibility_report(cleaned, path, stop_after=1, **how)
    return run_credibility_report(cleaned, path, **how)


@register("product_status", f"""WITH {V.REVIEWS},
asked AS (SELECT DISTINCT 'src' || CAST(conv_id % 25 AS VARCHAR) AS product_id FROM conversations),
n AS (SELECT product_id, count(*) AS n_read, count(*) FILTER (verified) AS n_verified,
        count(*) FILTER (verified AND rating >= 3) AS n_rated FROM reviews GROUP BY product_id)
SELECT product_id, coalesce(n_read, 0) AS n_read, coalesce(n_verified, 0) AS n_verified, coalesce(n_rated, 0) AS n_rated,
    CASE WHEN coalesce(n_read, 0) = 0 THEN 'no_reviews' WHEN n_verified = 0 THEN 'none_after_verified'
         WHEN n_rated = 0 THEN 'none_after_rated' ELSE 'ok' END AS status,
    CASE WHEN coalesce(n_read, 0) = 0 THEN '{st.NO_REVIEWS}' WHEN n_rated = 0 THEN '{st.NONE_LEFT}' END AS message
FROM asked LEFT JOIN n USING (product_id)""")
def q_product_status(spark, sf):
    """Every product that conversations ask about: read, filtered out, or without reviews."""
    asked = tb.table(spark, sf, "conversations").select(
        F.concat(F.lit("src"), (F.col("conv_id") % 25).cast("string")).alias("product_id"))
    read = tb.reviews(spark, sf, verified=True)
    verified = sel.select_verified(read, True)
    return st.product_status(asked, [("read", read), ("verified", verified), ("rated", verified.where(F.col("rating") >= 3))])


@register("review_texts", f"""WITH {V.REVIEWS} SELECT product_id, pos, text FROM reviews""")
def q_review_texts(spark, sf):
    return tx.review_texts(tb.reviews(spark, sf))


@register("strip_stutter", f"""WITH {V.REVIEWS},
w AS (SELECT review_id, string_split(text, ' ') AS a FROM reviews)
SELECT review_id, md5(array_to_string(list_transform(range(1, len(a) + 1),
    lambda i: CASE WHEN i % 8 = 2 THEN a[i] || ' - stut ter.' ELSE a[i] || '-' END), ' ')) AS text_md5 FROM w""")
def q_strip_stutter(spark, sf):
    """Texts in which a pair of words is doubled after every eighth word, and one of the two goes."""
    words = F.transform(F.split("text", " "), lambda w, i: F.when(
        i % 8 == 1, F.concat(w, F.lit(" - stut ter stut ter."))).otherwise(F.concat(w, F.lit("-"))))
    r = tb.reviews(spark, sf).select("review_id", F.array_join(words, " ").alias("text"))
    return r.select("review_id", F.md5(tx.strip_stutter("text")).alias("text_md5"))


def _chunk_sql(max_chars: int) -> str:
    parts = (f"list_filter(string_split(regexp_replace({V.strip('coalesce(text, ' + chr(39) * 2 + ')')}, "
             f"'([.!?]){V.WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')")
    step = (f"lambda acc, s: CASE WHEN acc.cur = '' THEN {{'cur': s, 'done': acc.done}} "
            f"WHEN length(acc.cur) + 1 + length(s) <= {max_chars} THEN {{'cur': acc.cur || ' ' || s, 'done': acc.done}} "
            f"ELSE {{'cur': s, 'done': list_append(acc.done, acc.cur)}} END")
    return f"""{V.REVIEWS},
folded AS (SELECT review_id, list_reduce({parts}, {step}, {{'cur': '', 'done': []::VARCHAR[]}}) AS st FROM reviews),
whole AS (SELECT review_id, unnest(list_append(st.done, st.cur)) AS c, generate_subscripts(list_append(st.done, st.cur), 1) AS ci
          FROM folded WHERE st.cur <> ''),
cut AS (SELECT review_id, ci, i, substr(c, CAST(i * {max_chars} + 1 AS BIGINT), {max_chars}) AS chunk
        FROM whole, LATERAL (SELECT unnest(range(0, (length(c) + {max_chars} - 1) // {max_chars})) AS i) g),
chunks AS (SELECT review_id, CAST(row_number() OVER (PARTITION BY review_id ORDER BY ci, i) - 1 AS INTEGER) AS chunk_id, chunk FROM cut)"""


@register("chunk_by_characters", f"WITH {_chunk_sql(800)} SELECT * FROM chunks")
def q_chunk_by_characters(spark, sf):
    r = tb.reviews(spark, sf).select("review_id", "text")
    return ch.chunk_table(r, max_tokens=800, tokenizer=ch.Characters).select("review_id", "chunk_id", "chunk")


@register("drop_short_parts", f"""WITH {_chunk_sql(120)}
SELECT review_id, chunk_id, chunk FROM chunks WHERE {V.word_count('chunk')} >= 10""")
def q_drop_short_parts(spark, sf):
    r = tb.reviews(spark, sf).select("review_id", "text")
    return ch.drop_short_parts(ch.chunk_table(r, max_tokens=120, tokenizer=ch.Characters)).select("review_id", "chunk_id", "chunk")


@register("aspect_mining_novel", f"""WITH {V.REVIEWS}, {V.aspects(top_k=10)},
longer AS (SELECT product_id, review_count, unnest([array_to_string(w[1:-2], ' '), array_to_string(w[2:], ' ')]) AS aspect
    FROM (SELECT product_id, review_count, string_split(aspect, ' ') AS w FROM ac) WHERE len(w) > 1),
kept AS (SELECT * FROM ac ANTI JOIN longer ON ac.aspect = longer.aspect AND ac.review_count = longer.review_count
    AND ac.product_id IS NOT DISTINCT FROM longer.product_id)
SELECT product_id, aspect, review_count, row_number() OVER (PARTITION BY product_id ORDER BY review_count DESC, aspect) AS rank
FROM kept QUALIFY rank <= 10""")
def q_aspect_mining_novel(spark, sf):
    return asp.aspect_mining(tb.reviews(spark, sf), novel=True).select("product_id", "aspect", "review_count", "rank")
