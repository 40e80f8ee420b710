import json
import os
import tempfile

from opinio.sources import jsonl, shapes

R = {"title": "T", "text": "fine", "rating": 4.5}


def put(folder, name, text):
    os.makedirs(os.path.dirname(os.path.join(folder, name)), exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


def mixed_folder():
    d = tempfile.mkdtemp(prefix="opinio-shapes-")
    product = {"customer_reviews": [{**R, "text": "p1", "verified": True, "helpful_votes": 3}, {**R, "text": "p2", "rating": None}, 5],
               "product_meta": {"title": " Some Book ", "specifications": {"ISBN-13": "978", "ISBN-10": ""}}}
    put(d, "pretty.json", json.dumps(product, indent=2))
    put(d, "sub/oneline.json", json.dumps({**product, "product_meta": None}))
    put(d, "array.json", json.dumps([{**R, "text": "a1", "review_text": "not this"}, {"review_text": "a2", "stars": "2", "parent_asin": "A"}], indent=1))
    put(d, "flat_array.json", json.dumps([{**R, "text": "a3"}, "no object"]))
    put(d, "lines.jsonl", "\n".join([json.dumps({**R, "text": "l1", "parent_asin": "L", "verified_purchase": "true"}), "", "{broken",
                                     json.dumps({**R, "text": "l2", "helpful_vote": "x"}), "7"]))
    put(d, "odd.json", json.dumps({"neither": 1, "nor": 2}, indent=2))
    put(d, "broken.json", "[{\n \"text\": \"never closed\"\n")
    put(d, "empty.json", "")
    put(d, "no_reviews.json", json.dumps({"customer_reviews": [], "product_meta": {}}, indent=2))
    return d


def test_mixed_folder_without_a_shape(spark):
    rows, bad = shapes.detect_review_shapes(spark, mixed_folder())
    got = {r.text: (r.shape, r.parent_asin, r.rating, r.verified_purchase, r.helpful_vote)
           for r in rows.where("file not like '%oneline%'").collect()}
    assert got == {
        "p1": ("product", "978", 4.5, True, 3.0), "p2": ("product", "978", None, False, 0.0),
        "a1": ("array", "array", 4.5, False, 0.0), "a2": ("array", "A", 2.0, False, 0.0), "a3": ("array", "flat_array", 4.5, False, 0.0),
        "l1": ("review", "L", 4.5, True, 0.0), "l2": ("review", "lines", 4.5, False, 0.0)}
    assert {(r.text, r.parent_asin) for r in rows.where("file like '%oneline%'").collect()} == {("p1", "oneline"), ("p2", "oneline")}
    told = {os.path.basename(r.file): [] for r in bad.collect()}
    for r in bad.collect():
        told[os.path.basename(r.file)].append(r.value)
    assert sorted(told) == ["broken.json", "flat_array.json", "lines.jsonl", "odd.json", "oneline.json", "pretty.json"]
    assert sorted(told["lines.jsonl"]) == ["7", "{broken"] and told["flat_array.json"] == ['"no object"'] and told["pretty.json"] == ["5"]
    assert json.loads(told["odd.json"][0]) == {"neither": 1, "nor": 2}


def test_order_within_files_and_no_shape_argument(spark):
    d = mixed_folder()
    rows = jsonl.adapt_review_shapes(spark, d)
    assert [r.text for r in rows.orderBy("pos").collect() if r.text[0] == "a"] == ["a1", "a2", "a3"]
    assert rows.count() == 9 and rows.columns == jsonl.adapt_review_shapes(spark, d, "jsonl").columns
