import json
import os
import tempfile

from opinio.sources import jsonl, products


def write(path, obj):
    with open(path, "w", encoding="utf-8") as f:
        json.dump(obj, f, indent=2)


def review(i):
    return {"title": f"t{i}", "text": f"text {i}", "rating": 5.0, "verified": True,
            "author": "a", "helpful_votes": 0, "publication_date": 20200101}


def test_review_ids_and_product_id(spark):
    d = tempfile.mkdtemp(prefix="opinio-prod-")
    write(os.path.join(d, "B000X.json"), {"website_summaries": [{"verdict": "ok", "pros": ["a"], "cons": []}],
                                          "customer_reviews": [review(i) for i in range(1001)],
                                          "product_meta": {"title": "T", "specifications": {"Language:": "en"}}})
    p = products.scan_products(spark, d)
    r = products.reviews_table(p)
    ids = {x.review_id for x in r.select("review_id").collect()}
    assert "r000" in ids and "r999" in ids and "r1000" in ids and len(ids) == 1001
    assert {x.product_id for x in r.select("product_id").distinct().collect()} == {"B000X"}
    v = products.website_verdict(p).first()
    assert v.verdict == "ok" and v.pros == ["a"]


def test_validate_products(spark):
    d = tempfile.mkdtemp(prefix="opinio-val-")
    write(os.path.join(d, "good.json"), {"website_summaries": [], "customer_reviews": [], "product_meta": {}})
    write(os.path.join(d, "nokey.json"), {"website_summaries": [], "customer_reviews": []})
    bad_review = review(0)
    del bad_review["verified"]
    write(os.path.join(d, "nofield.json"), {"website_summaries": [], "customer_reviews": [bad_review],
                                            "product_meta": {}})
    got = {r.file_name: (r.is_valid, r.reason) for r in products.validate_products(spark, d).collect()}
    assert got["good.json"] == (True, None)
    assert got["nokey.json"] == (False, "Missing required key: product_meta")
    assert got["nofield.json"] == (False, "Missing required field in reviews: verified")


def test_empty_directory_fails_fast(spark):
    d = tempfile.mkdtemp(prefix="opinio-empty-")
    try:
        products.scan_products(spark, d)
    except FileNotFoundError:
        return
    raise AssertionError("expected FileNotFoundError")


def test_malformed_line_quarantined(spark):
    d = tempfile.mkdtemp(prefix="opinio-jsonl-")
    with open(os.path.join(d, "r.jsonl"), "w") as f:
        f.write(json.dumps({"parent_asin": "A", "text": "fine", "rating": "5"}) + "\n")
        f.write("{not json\n")
        f.write(json.dumps({"parent_asin": "A", "text": "also fine", "rating": "4"}) + "\n")
    good, bad = jsonl.scan_review_jsonl(spark, d)
    assert good.count() == 2 and bad.count() == 1


def test_adapt_shapes(spark):
    d = tempfile.mkdtemp(prefix="opinio-shape-")
    write(os.path.join(d, "P1.json"), [{"text": "x", "rating_value": "4", "verified_purchase": True}])
    rows = jsonl.adapt_review_shapes(spark, d, "array").collect()
    assert rows[0].parent_asin == "P1" and rows[0].rating == 4.0 and rows[0].verified_purchase is True


def test_every_line_is_a_row_or_quarantined(spark):
    d = tempfile.mkdtemp(prefix="opinio-lossless-")
    lines = ['{"parent_asin": "A", "text": "one and a half words of text, long enough", "rating": 5, "verified": "yes"}',
             '{"parent_asin": "A", "text": "two is also long enough to be kept here", "verified_purchase": 1, "stars": "4"}',
             "{not json", "", '{"parent_asin": "A", "text": "three, and long enough to be kept as well", "verified": true, "helpful_votes": 7}']
    with open(os.path.join(d, "r.jsonl"), "w") as f:
        f.write("\n".join(lines))
    good, bad = jsonl.scan_review_jsonl(spark, d)
    assert good.count() == len(good.collect()) == good.select("text").count() == 3 and bad.count() == 1
    from opinio.operators import cleaning, report
    c = cleaning.clean_corpus(good, filter_mode="inclusive")
    got = {r.text[:3]: r for r in c.collect()}
    assert got["thr"].verified and got["thr"].helpful_vote == 7.0 and got["two"].rating is None or got["two"].rating == 4.0
    assert report.credibility_report(c, min_reviews=1, filter_mode="inclusive").count() == 1


def test_product_document_ids(spark):
    d = tempfile.mkdtemp(prefix="opinio-pid-")
    write(os.path.join(d, "f.json"), {"website_summaries": [], "customer_reviews": [review(1)],
                                      "product_meta": {"title": "T", "specifications": {"ISBN-13": "978"}}})
    assert jsonl.adapt_review_shapes(spark, d, "product").first().parent_asin == "978"
