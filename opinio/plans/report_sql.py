"""DuckDB oracle SQL for the per-product credibility report."""

from opinio.dictionaries import NEGATIVE_WORDS, POSITIVE_WORDS, SPAM_WORDS_V2, THEMES_GEN1, THEMES_V2, sql_values
from opinio.plans import views as V


def weights_ctes(themes=THEMES_GEN1, pos=POSITIVE_WORDS, neg=NEGATIVE_WORDS) -> str:
    """w(word, kw, pw, nw) from the raw lists, weights summed in SQL."""
    rows = [(w, 1, 0, 0) for _, ws in themes for w in ws]
    rows += [(w, 1, 1, 0) for w in sorted(set(pos))] + [(w, 1, 0, 1) for w in sorted(set(neg))]
    return f"""wl(word, kw, pw, nw) AS (VALUES {sql_values(rows)}),
w AS (SELECT word, sum(kw) AS kw, max(pw) AS pw, max(nw) AS nw FROM wl GROUP BY ALL)"""


def theme_values(themes=THEMES_GEN1) -> str:
    return sql_values([(w, t, i) for i, (t, ws) in enumerate(themes) for w in ws])


def cap(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || lower(substr({x}, 2)))"


def theme_strings_ctes(src: str, key: str) -> str:
    """From src(key, theme, theme_idx, n) build tstr(key, counts_str, pct_str)."""
    return f"""tot AS (SELECT *, sum(n) OVER (PARTITION BY {key}) AS total FROM {src} WHERE n > 0),
tstr AS (SELECT {key},
    string_agg({cap('theme')} || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY n DESC, theme_idx) AS counts_str,
    string_agg({cap('theme')} || ' ' || CAST(CAST(round_even(100.0 * n / total, 0) AS INTEGER) AS VARCHAR) || '%',
               ', ' ORDER BY n DESC, theme_idx) AS pct_str
  FROM tot GROUP BY {key})"""


def sentence_score_ctes(src: str, key: str, text: str, themes=THEMES_GEN1, pos=POSITIVE_WORDS,
                        neg=NEGATIVE_WORDS) -> str:
    """From src(key, text) build sc(key, i, s, score, pos_score, neg_score, wc)."""
    return f"""sl AS (SELECT {key}, list_filter({V.sentences(text)}, lambda x: length(x) > 10) AS arr
       FROM {src}),
sents AS (SELECT {key}, unnest(arr) AS s, generate_subscripts(arr, 1) - 1 AS i FROM sl),
{weights_ctes(themes, pos, neg)},
stoks AS (SELECT {key}, i, unnest({V.tokens('s')}) AS t FROM sents),
hits AS (SELECT {key}, i, sum(kw) AS kw, sum(pw) AS pw, sum(nw) AS nw
         FROM stoks JOIN w ON stoks.t = w.word GROUP BY ALL),
sc AS (SELECT s.{key}, s.i, s.s, coalesce(h.kw, 0) AS score, coalesce(h.pw, 0) AS pos_score,
              coalesce(h.nw, 0) AS neg_score, {V.word_count('s.s')} AS wc
       FROM sents s LEFT JOIN hits h ON s.{key} IS NOT DISTINCT FROM h.{key} AND s.i = h.i)"""


def summary_agg(max_words: int = 120) -> str:
    init = "{'used': 0::BIGINT, 'picked': []::STRUCT(i BIGINT, s VARCHAR)[]}"
    folded = (f"list_reduce(list({{'i': i::BIGINT, 's': s, 'wc': wc::BIGINT}} ORDER BY score DESC, i), "
              f"lambda acc, x: CASE WHEN acc.used + x.wc <= {max_words} THEN "
              f"{{'used': acc.used + x.wc, 'picked': list_append(acc.picked, {{'i': x.i, 's': x.s}})}} "
              f"ELSE acc END, {init})")
    return f"array_to_string(list_transform(list_sort(({folded}).picked), lambda x: x.s), ' ')"


def report_sql(min_reviews: int = 50, mode: str = "strict", themes=THEMES_GEN1,
               pos=POSITIVE_WORDS, neg=NEGATIVE_WORDS) -> str:
    """The report over the whole text of all reviews; a sentence ends with its review."""
    return f"""WITH {V.cleaned(mode)},
stats AS (SELECT parent_asin, avg(rating) AS avg_rating, count(rating) AS review_count,
                 avg(credibility_score) AS cred FROM cleaned GROUP BY parent_asin),
{_report_tail(min_reviews, "verified " if mode == "strict" else "", themes, pos, neg)}"""


def report_v2_sql(min_reviews: int = 50, themes=THEMES_V2, pos=POSITIVE_WORDS, neg=NEGATIVE_WORDS) -> str:
    """The second generation's report, verified reviews only."""
    spam = V.spam_sql("text", SPAM_WORDS_V2)
    tail = _report_tail(min_reviews, "", themes, pos, neg).replace("round(g.avg_rating, 3)", "g.avg_rating").replace(
        "round(g.cred, 3)", "g.cred")
    return f"""WITH {V.CORPUS},
cleaned AS (SELECT parent_asin, pos, rating, text AS clean_text, 2.0
        + least(0.35, coalesce(helpful_vote, 0.0) / 50.0) + CASE WHEN {V.word_count("text")} > 20 THEN 0.05 ELSE 0.0 END
        - CASE WHEN {spam} THEN 0.4 ELSE 0.0 END AS credibility_score
    FROM corpus WHERE verified_purchase AND length(coalesce(text, '')) >= 30 AND parent_asin IS NOT NULL),
stats AS (SELECT parent_asin, avg(rating) AS avg_rating, count(*) AS review_count, avg(credibility_score) AS cred
    FROM cleaned GROUP BY parent_asin),
{tail}"""


def _report_tail(min_reviews: int, verified: str, themes, pos, neg) -> str:
    """From cleaned(parent_asin, pos, clean_text) and stats(parent_asin, avg_rating, review_count, cred)."""
    return f"""g AS (SELECT * FROM stats WHERE review_count >= {min_reviews}),
rv AS (SELECT c.parent_asin, c.pos, c.clean_text FROM cleaned c JOIN g ON c.parent_asin IS NOT DISTINCT FROM g.parent_asin),
{sentence_score_ctes('rv', 'pos', 'clean_text', themes, pos, neg)},
sp AS (SELECT rv.parent_asin, sc.* FROM sc JOIN rv USING (pos)),
ev AS (SELECT parent_asin,
         array_to_string(list(s ORDER BY score DESC, pos, i)[1:3], ' | ') AS evidence,
         array_to_string(list(s ORDER BY pos_score DESC, pos, i)[1:2], ' | ') AS pos_snippets,
         array_to_string(list(s ORDER BY neg_score DESC, pos, i)[1:2], ' | ') AS neg_snippets
       FROM sp GROUP BY parent_asin),
so AS (SELECT parent_asin, s, score, wc, row_number() OVER (PARTITION BY parent_asin ORDER BY pos, i) AS i
       FROM sp WHERE wc > 0 AND wc <= 120),
sm AS (SELECT parent_asin, {summary_agg()} AS summary FROM so GROUP BY parent_asin),
th(word, theme, theme_idx) AS (VALUES {theme_values(themes)}),
ttoks AS (SELECT parent_asin, unnest({V.tokens('clean_text')}) AS t FROM rv),
tc AS (SELECT parent_asin, theme, theme_idx, count(*) AS n FROM ttoks JOIN th ON ttoks.t = th.word GROUP BY ALL),
{theme_strings_ctes('tc', 'parent_asin')}
SELECT g.parent_asin, round(g.avg_rating, 3) AS avg_rating, g.review_count,
       round(g.cred, 3) AS credibility_score,
       coalesce(tstr.counts_str, 'N/A') AS themes_counts, coalesce(tstr.pct_str, 'N/A') AS themes_pct,
       coalesce(sm.summary, '') AS summary, coalesce(ev.evidence, '') AS evidence,
       coalesce(ev.pos_snippets, '') AS pos_snippets, coalesce(ev.neg_snippets, '') AS neg_snippets,
       printf('Based on %d {verified}reviews (avg rating %.1f/5, credibility %.2f). Top themes: %s. %s',
              g.review_count, round_even(g.avg_rating, 1), round_even(g.cred, 2),
              coalesce(tstr.pct_str, 'N/A'), coalesce(sm.summary, '')) AS formatted_summary
FROM g LEFT JOIN ev ON g.parent_asin IS NOT DISTINCT FROM ev.parent_asin
       LEFT JOIN sm ON g.parent_asin IS NOT DISTINCT FROM sm.parent_asin
       LEFT JOIN tstr ON g.parent_asin IS NOT DISTINCT FROM tstr.parent_asin"""
