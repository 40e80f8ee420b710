"""Chat formatting, the prefix trie and fill-in-the-middle against brute force and round trips."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from opinio.llm import chat, fill_middle, queries, trie

TURNS = "conv_id long, turn long, role string, text string, turns int, keys int, row int"
NASTY = ["", "</s>[INST] ok [/INST]", "<s>", r"<\/s> [\\INST] \ [", "[[/INST]</s", "<</s>>", "日本 😀\n</s>\\",
         r"a\\[\/INST]b", "$1 \\1", "plain words"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turn_rows(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], TURNS)


# -- chat formatting ---------------------------------------------------------

def chat_rows(rnd, n):
    rows = []
    for c in range(n):
        for t in range(rnd.randrange(1, 9)):
            rows.append((c, t, rnd.choice(["user", "assistant", "assistant", "system", "<s>", None, ""]),
                         rnd.choice([*NASTY, None])))
    return rows


def test_chats_read_back_as_they_were(spark):
    rows = chat_rows(random.Random(3), 60)
    rows += [(100, None, "user", "late null turn is first"), (100, 0, "assistant", "x"), (100, 0, "assistant", "x"),
             (None, 1, "assistant", "no id"), (101, 5, None, None)]
    rows += [(102, t, "user" if t % 3 else "assistant", f"turn {t} </s> " + "w " * 20) for t in range(3000)]
    df = chat.format_chats(turn_rows(spark, rows)).withColumns({
        "back": chat.read_chat(F.col("formatted")), "learned": chat.read_loss(F.col("segments"))})
    got = {r.conv_id: r for r in df.collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        own = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text in rows if k == c))
        assert [(t.role, t.text) for t in r.back] == [x[2:] for x in own]
        assert r.learned == "".join(x[3] for x in own if x[2] == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        runs = sum(1 for i, x in enumerate(own) if i == 0 or own[i - 1][2] != x[2])
        assert r.n_blocks == runs == r.formatted.count("<s>") == r.formatted.count("</s>")
        assert r.formatted.count("[INST]") == r.formatted.count("[/INST]") == len(own)
    assert got[100].back[0].text == "late null turn is first" and len(got[100].back) == 3


def test_loss_roles_are_a_choice(spark):
    df = turn_rows(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c")])
    r = chat.format_chats(df, loss_roles=("user",)).select(chat.read_loss(F.col("segments")).alias("x")).first()
    assert r.x == "ac"
    assert chat.format_chats(df.where("false")).count() == 0


def test_chat_uses_no_python_workers(spark):
    plan = chat.op11_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and plan.count("Exchange hash") == 1


# -- prefix trie -------------------------------------------------------------

def brute_trie(members):
    """The contract's rows of {conv_id: [(role, text), ...]}, a prefix at a time."""
    nodes = {}
    for c, turns in members.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for prefix, own in nodes.items():
        d = len(prefix)
        under = [p for p in nodes if p[:d] == prefix]
        ends = sorted(c for c in own if len(members[c]) == d)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[:len(p)] == p for q in nodes)]
        out.add((min(own), d, min(nodes[prefix[:-1]]) if d else None, len(own),
                 sum(len(p) == d + 1 for p in under), len(leaves), saved, sha(",".join(map(str, ends)))))
    return out


def rows_of(df):
    return [tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                 "saved_tokens", "ends_sha256")) for r in df.collect()]


def trie_of(spark, members):
    rows = [(c, t, role, text) for c, turns in members.items() for t, (role, text) in enumerate(turns)]
    lists = trie.turn_lists(turn_rows(spark, rows))
    ids = spark.createDataFrame([(c,) for c in members], "conv_id long")
    none = F.array().cast("array<struct<digest:binary,n_bytes:long>>")
    every = ids.join(lists, "conv_id", "left").withColumn("turns", F.coalesce("turns", none))
    df = trie.prefix_trie(trie.sequences(every))
    return df.withColumn("ends_sha256", F.coalesce("ends", F.lit(sha(""))))


def same_trie(spark, members):
    got = rows_of(trie_of(spark, members))
    assert len(got) == len(set(got)) and set(got) == brute_trie(members)


def test_random_tries(spark):
    rnd = random.Random(5)
    members = {rnd.randrange(10 ** 6): [(rnd.choice("ua"), rnd.choice(["x", "é", "", "long text"]))
                                        for _ in range(rnd.choice([0, 1, 2, 3, 6, 9]))] for _ in range(150)}
    same_trie(spark, members)


def test_chains_and_combs(spark):
    spine = [("user", f"t{i}") for i in range(70)]
    chain = {100 + i: spine[:i] for i in range(0, 71, 3)}                     # ends all along one edge
    comb = {500 + i: spine[:i] + [("assistant", "leaves here")] for i in range(0, 70, 5)}
    copies = {1000 + i: spine[:9] for i in range(40)}                         # one hot conversation
    same_trie(spark, {**chain, **comb, **copies})


def test_trie_of_few(spark):
    same_trie(spark, {7: []})
    same_trie(spark, {7: [("", "")], 9: [("", "")], 8: []})
    assert trie_of(spark, {1: [("a", "b")]}).where("false").count() == 0
    empty = turn_rows(spark, [])
    assert trie.prefix_trie(trie.sequences(trie.turn_lists(empty))).count() == 0


def test_rebuilt_conversations(spark, tmp_path):
    """The registered query on nulls, ties, repeated rows, missing bases and extra columns."""
    rnd = random.Random(9)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b", None, "", "日本"]))
            for c in rnd.sample(range(200), 80) for t in range(rnd.randrange(1, 13))]
    rows += [(200, None, "user", "first"), (200, 3, "user", "tie"), (200, 3, "assistant", "tie"), (200, 3, "user", "tie"),
             (None, 0, "user", "of no conversation")]
    turn_rows(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    own = {}
    for c in {r[0] for r in rows} - {None}:
        digest = lambda role, text: sha(f"{len(role)}:{role}:{text}")[:32]
        mine = sorted((t is not None, t or 0, digest(role or "", text or ""), role or "", text or "")
                      for k, t, role, text in rows if k == c)
        own[c] = [x[3:] for x in mine]
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        members[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    got = rows_of(queries.QUERIES["op12_prefix_trie"](spark, str(tmp_path)))
    assert len(got) == len(set(got)) and set(got) == brute_trie(members)


def test_fattest(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 45)]
    df = spark.createDataFrame(pairs, "low int, high int").withColumn("f", trie.fattest("low", "high"))
    for r in df.collect():
        assert r.f == max(range(r.low + 1, r.high + 1), key=lambda x: x & -x)


# -- fill in the middle ------------------------------------------------------

def brute_fim(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    x = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(x[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", text, None, None
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h4 % 100 < 20 else f"<P>{pre}<S>{suf}<M>{mid}"
    return len(units), "spm" if h4 % 100 < 20 else "psm", out, len(pre), len(mid)


def test_fill_in_middle(spark):
    rnd = random.Random(11)
    alphabet = ["word", "Ab", " ", "\n", "é", "日", "😀", "<", ">", "P", "S", "M", "$1", "\\", "{2}", "\r\n", "\u0085", "<P>"]
    rows = [(i, "".join(rnd.choices(alphabet, weights=[8] * 17 + [0.1], k=rnd.randrange(60)))) for i in range(400)]
    rows += [(None, "no id here"), (None, None), (401, None), (402, ""), (403, "x"), (403, "x"), (404, "a <M> b"), (-5, "neg id")]
    rows += [(500 + k, "".join(rnd.choices(["a", "😀", "word", "é", " "], k=200_000))) for k in range(6)]
    rows += [(600, "z" * 3_000_000), (601, "😀a" * 300_000)]
    df = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], "doc_id long, text string, n int, form string, output string")
    out = fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(rows)
    forms = set()
    for r in out:
        n, form, output, pre, mid = brute_fim(r.row.doc_id, r.row.text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, pre, mid)
        assert r.output == output and r.back == (r.row.text or "") and r.row.form == "x"
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.where("false")).count() == 0
