import random

from opinio.operators import aspects


def test_novel_aspects_against_all_longer_grams(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["a", "b", None]), " ".join(rnd.choices("red big red car door the".split(), k=rnd.randrange(12)))) for _ in range(40)]
    df = spark.createDataFrame([*rows, ("a", None), ("a", ""), ("a", "same words here"), ("a", "same words here")],
                               "product_id string, text string")
    every = {(r.product_id, r.aspect): r.review_count for r in aspects.aspect_mining(df, top_k=10**6).collect()}
    kept = {(p, a): n for (p, a), n in every.items() if not any(
        q == p and m == n and len(b) > len(a) and f" {a} " in f" {b} " for (q, b), m in every.items())}
    got = {(r.product_id, r.aspect): r.review_count for r in aspects.aspect_mining(df, top_k=10**6, novel=True).collect()}
    assert got == kept and 0 < len(kept) < len(every)
    assert ("a", "same words here") in kept and ("a", "same words") not in kept


def _brute(rows, sizes=(1, 2, 3, 4, 5)):
    n = {}
    for p, text in rows:
        w = (text or "").split()
        for g in {" ".join(w[i:i + k]) for k in sizes for i in range(len(w) - k + 1)}:
            n[p, g] = n.get((p, g), 0) + 1
    return n


def test_grams_of_rare_words_are_not_shuffled_and_results_are_whole(spark, monkeypatch):
    """Only n-grams of the most frequent words are counted; a product with too many of them is counted whole."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(p, " ".join(rnd.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rnd.randrange(1, 30))))
            for p in ("a", "b", None) for _ in range(60)] + [("ties", " ".join(f"t{i}" for i in range(40)))]
    df = spark.createDataFrame(rows, "product_id string, text string")
    every = _brute(rows)
    seen = []
    real = aspects.drop_subsumed
    monkeypatch.setattr(aspects, "drop_subsumed", lambda c, key: real(seen.append(c.count()) or c, key))
    for most in (512, 8):                      # 8: products with more frequent parts take the other path
        monkeypatch.setattr(aspects, "MAX_FREQUENT", most)
        for sizes, top in (((1, 2, 3, 4, 5), 4), ((2, 3), 3)):
            left = {k: v for k, v in every.items() if len(k[1].split()) in sizes}
            for novel in (False, True):
                own = left if not novel else {(p, a): n for (p, a), n in left.items() if not any(
                    q == p and m == n and len(b.split()) == len(a.split()) + 1 and f" {a} " in f" {b} " for (q, b), m in left.items())}
                want = {(p, a, n) for k in ("a", "b", None, "ties") for n, a, p in
                        [(-m, a, p) for m, a, p in sorted((-n, a, p) for (p, a), n in own.items() if p == k)[:top]]}
                got = {(r.product_id, r.aspect, r.review_count)
                       for r in aspects.aspect_mining(df, sizes=sizes, top_k=top, novel=novel).collect()}
                assert got == want
    assert seen[0] < len(every) / 2            # before: all of them
