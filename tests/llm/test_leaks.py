import random

import pyarrow as pa

from quarrystone.llm import leaks

DOCS = "doc_id bigint, text string, spans int, removed_bytes int"
ITEMS = "item_id bigint, text string, doc_id int"


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], DOCS)
    e = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    return {(r.doc_id, r.item_id) for r in leaks.leaked_items(d, e).collect()}


def plain(docs, items):
    grams = {}
    for i, t in items:
        w = leaks.words(t or "")
        for k in range(len(w) - 9):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(i)
    return {(d, i) for d, t in docs if t for w in [leaks.words(t)] for k in range(len(w) - 9) for i in grams.get(tuple(w[k : k + 10]), ())}


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4)] + ["Kelvin", "naïve", "İx", "Straße", "\U0001f600", "a1b"]
    text = lambda n, sep: "".join(rng.choice(vocabulary) + rng.choice(sep) for _ in range(n))
    items = [(i, text(rng.randrange(5, 25), [" "])) for i in range(12)]
    docs = []
    for i in range(150):
        t = text(rng.randrange(0, 30), [" ", "\n+ ", ", ", "\r\n> ", "–"])
        if i % 3 == 0:
            t += rng.choice(items)[1].upper().replace(" ", "\n- ") + text(3, [" "])
        docs.append((i, t))
    want = plain(docs, items)
    assert found(spark, docs, items) == want and len(want) > 10


def test_edges(spark):
    ten = " ".join("abcdefghij")
    items = [(1, ten), (2, ten + " x"), (3, "too short"), (4, None), (5, "")]
    docs = [(1, None), (2, ""), (3, " ".join("abcdefghi")), (4, "j"), (5, ten.upper()), (5, ten), (None, ten), (6, "…" + ten.replace(" ", ".") + "…"), (7, "a b c d e f g h i jj")]
    assert found(spark, docs, items) == {(5, 1), (5, 2), (None, 1), (None, 2), (6, 1), (6, 2)}
    assert found(spark, [], items) == set() and found(spark, docs, []) == set() and found(spark, docs, [(3, "short")]) == set()


def test_words_do_not_join_across_documents_or_slices(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SLICE_BYTES", 7)
    g = leaks.Grams([(1, " ".join("abcdefghij"))])
    texts = pa.array(["a b c d e", "f g h i j", None, "", "x a b c d e f g h i j y"]).slice(0)
    hits = list(leaks.scan_texts(texts, g, leaks.Scanner()))
    assert hits == [(4, 2, 21, [1])]
    assert list(leaks.scan_texts(pa.array(["x" * 50, "a b c d e f g h i j", "é a b c d e f g h i j"]), g, leaks.Scanner())) == [(1, 0, 19, [1]), (2, 3, 22, [1])]
    assert [h[0] for h in leaks.scan_texts(texts.slice(3), g, leaks.Scanner())] == [1]


def test_a_very_long_text(spark):
    ten = " ".join(f"z{i}" for i in range(10))
    assert found(spark, [(1, "word " * 400000 + ten)], [(9, ten)]) == {(1, 9)}


def test_test_sets_larger_than_a_block_take_more_passes(spark, monkeypatch):
    monkeypatch.setattr(leaks, "MOST_ITEM_BYTES", 60)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(6)]
    docs = [(i, items[i][1]) for i in range(6)]
    assert found(spark, docs, items) == {(i, i) for i in range(6)}


def test_removal(spark):
    ten = " ".join("abcdefghij")
    d = spark.createDataFrame([(1, f"keep, {ten.upper()}! end", 1, 9), (2, "clean é", 2, 9), (3, None, 3, 9)], DOCS)
    e = spark.createDataFrame([(1, ten, 0), (2, ten + " k", 0)], ITEMS)
    out = {r.doc_id: r for r in leaks.without_leaks(d, e).collect()}
    assert (out[1].text, out[1].removed_bytes, out[1].spans) == ("keep, ! end", 19, 1)
    assert (out[2].text, out[2].removed_bytes, out[3].text) == ("clean é", 0, None)
    assert {r.doc_id for r in leaks.without_leaks(d, e, whole_documents=True).collect()} == {2, 3}


def test_kept_letters_stay_as_they_are(spark):
    ten = " ".join("abcdefghij")
    text = f"İ 300 \u212a {ten} 5 \u212a İx {ten.upper().replace('H', 'H \u212a')} İ"
    item = f"{ten} 5"
    d = spark.createDataFrame([(1, text, 0, 0), (2, "\u212a İ", 0, 0)], DOCS)
    out = {r.doc_id: r.text for r in leaks.without_leaks(d, spark.createDataFrame([(1, item, 0)], ITEMS)).collect()}
    assert out == {1: f"İ 300 \u212a  \u212a İx {ten.upper().replace('H', 'H \u212a')} İ", 2: "\u212a İ"}
    k = " ".join("abcdefghi") + " k"
    d = spark.createDataFrame([(1, f"\u212a {k[:-1]}\u212a; İ", 0, 0)], DOCS)
    assert leaks.without_leaks(d, spark.createDataFrame([(1, k, 0)], ITEMS)).first().text == "\u212a ; İ"


def test_a_test_set_of_any_size_gives_the_same(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)] + ["\u212a", "İ"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(14)) for i in range(20)]
    docs = [(i, text(5) + " / " + rng.choice(items)[1].replace(" ", ", ") + "; " + text(9)) for i in range(60)] + [(99, None), (98, text(40))]
    d = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], DOCS)
    e = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    rows = lambda: (found(spark, docs, items), sorted(map(str, leaks.without_leaks(d, e).collect())), sorted(r.doc_id for r in leaks.without_leaks(d, e, True).collect()))
    small = rows()
    monkeypatch.setattr(leaks, "MOST_ITEM_BYTES", 10)
    assert rows() == small and len(small[0]) >= 60


def test_removal_moves_no_text(spark):
    d = spark.createDataFrame([(1, "t", 1, 9)], DOCS)
    plan = leaks.without_leaks(d, spark.createDataFrame([(1, "x", 0)], ITEMS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
