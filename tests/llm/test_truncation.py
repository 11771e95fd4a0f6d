import random

import pytest

from quarrystone.llm import truncation as tr

DOCS = "doc_id bigint, text string, source string, state string, copy int, measure string"
DIFF = """Fix the thing

 a.py | 2 +-
 1 file changed, 1 insertion(+), 1 deletion(-)

diff --git a/a.py b/a.py
index 1..2 100644
--- a/a.py
+++ b/a.py
@@ -1,3 +1,3 @@ def f():
 one
-two
+three
 four"""


def found(spark, docs):
    return {r.doc_id: r for r in tr.truncation_report(spark.createDataFrame([(*r, "s", 1, "m") for r in docs], DOCS)).collect()}


@pytest.mark.parametrize(
    ("text", "state"),
    [
        (DIFF, "whole"), (DIFF + "\n", "done"), (DIFF + "\n\\ No newline at end of file", "whole"), (DIFF[:-6], "open"), (DIFF + "\n@@ -9,", "open"), (DIFF + "\ndiff --git a/b b/", "open"),
        (DIFF.replace("1 file changed", "2 files changed"), "open"), (DIFF.replace("1 insertion", "4 insertions"), "open"), (DIFF + "\n-- \npatchmailer 1.2\n", "done"), (DIFF + "…", "open"),
        ("t\n\ndiff --git a/x.png b/x.png\nindex 1..2\nBinary files a/x.png and b/x.png differ", "whole"), ("t\n\ndiff --git a/x.png b/x.png\nindex 1..2\nBinary files a/x.png and b/x", "open"),
        ("diff --git a/a.py b/a.py\nsimilarity index 100%\nrename from a.py\nrename to b/c.py", "whole"), ("diff --git a/a.py b/a.py\nsimilarity index 100%\nrename from a.py\nrename to b/c.p", "open"),
        ("x\n\ndiff --git a/e b/e\nnew file mode 100644\nindex 0000000..e69de29\n", "done"), ("x\n\ndiff --git a/e b/e\nold mode 100644\nnew mode 100755", "whole"),
        ("plain", None), ("", None),
    ],
)
def test_diffs(text, state):
    assert tr.diff_state(text) == state


@pytest.mark.parametrize(
    ("text", "state"),
    [
        ("Fix it", "title"), ("commit abcdef1\nAuthor: A <a@b.c>\n\n    Fix it", "title"), ("Fix\n\nThe reason is here.", "done"), ("Fix\n\nThe reason is he", "open"), ("Fix\n\nMore (yet)", "open"),
        ("Fix\n\nWas it...", "done"), ("Fix\n\nWas it…", "open"), ("Fix\n\nSigned-off-by: A B <a@b.c>", "done"), ("Fix\n\nSigned-off-by: A B <a@", "open"), ("Fix\n\nChange-Id: I123", "open"),
        ("Fix\n\nRefs: 12345", "done"), ("Fix\n\nReviewed-by: A Bc", "trailer"), ("Fix\n\nSigned-o", "open"), ("Fix\n\n- one thing", "bullet"), ("Merge\n\nConflicts:\n\ta/b.py", "done"),
        ("Merge\n\nConflicts:\n\ta/b", "open"), ("Fix\n\n(cherry picked from commit 12ab)", "done"), ("Fix\n\n(cherry picked from com", "open"), ("Fix\n\nText.\n\n a.py | 2 +-", "open"),
        ("修正\n\n警告は消える。", "done"), ("Fix\n\nText.\n==============================", "done"), ("Fix\n\nText.\n---\n a.py | 2 +-\n 1 fil...", "open"),
    ],
)
def test_messages(text, state):
    assert tr.message_state(text)[0] == state


def test_lengths_of_all_encodings():
    t = 'é<&"\'\r\n\n\\\t\U0001f600'
    n, raw, wide, entity, escaped, crlf, lf = tr.lengths(t)
    import html
    import json

    assert (n, raw, wide) == (len(t), len(t.encode()), len(t.encode("utf-16-le")) // 2)
    assert entity == len(html.escape(t)) - t.count("'") and escaped == len(json.dumps(t, ensure_ascii=False)) - 2
    assert crlf == len(t.replace("\r\n", "\n").replace("\n", "\r\n")) and lf == len(t.replace("\r\n", "\n"))


def test_hidden_limit_of_a_source(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "naïve"]
    docs = []
    for i in range(400):
        body = "Title\n\n" + " ".join(rng.choice(words) for _ in range(rng.randrange(3, 60))) + "."
        docs.append((i, body if i % 2 else body[:200], "cut" if i % 4 < 2 else "free"))
    docs = [(i, t[:200] if s == "cut" else t if t.endswith(".") else t + ".", s) for i, t, s in docs]
    docs.append((900, "Title\n\n" + "a" * 181 + "\n\nRefs: 1234", "cut"))  # a finished message of just that length
    assert len(docs[-1][1]) == 200
    got = found(spark, docs)
    assert set(got) == {i for i, t, s in docs if s == "cut" and not t.endswith(".") and i != 900}
    assert {(r.reason, r.limit_length) for r in got.values()} == {("limit", 200)}


def test_copies_of_one_text_are_no_limit(spark):
    docs = [(i, "Title\n\n- a bullet ending", "s") for i in range(60)] + [(99, "T\n\n- other ending\n- last ending", "s")]
    assert found(spark, docs) == {}


def test_cut_words_and_edges(spark):
    docs = [(1, None, "s"), (2, "", "s"), (3, "T\n\n- mend the frame\n- mend the fra", None), (4, "T\n\n- mend the frame\n- see the frame", "s"), (5, "T\n\nA sentence that en", "S "), (5, "T\n\nA sentence that en", "S "), (6, "w " * 200000 + "end.", "s")]
    assert set(found(spark, docs)) == {3, 5}
    assert found(spark, []) == {}


def test_rates(spark):
    d = spark.createDataFrame([(1, "T\n\nNot en", "A ", "", 1, ""), (2, "T\n\nAll.", "a", "", 1, ""), (3, None, None, "", 1, "")], DOCS)
    got = {r.source: (r.documents, r.truncated, r.rate) for r in tr.truncation_rates(d).collect()}
    assert got == {"a": (2, 1, 0.5), "": (1, 0, 0.0)}


PROSE = (
    "The museum opens its new wing in spring. Visitors will find three halls of maps and a small reading room. "
    "Most of the collection was stored in boxes for thirty years. The staff photographed every sheet before it was hung. "
    "Two of the halls are free of charge. The third one shows loans from abroad and will change every few months, so it is closed at times. "
)


@pytest.mark.parametrize(
    ("text", "cut"),
    [
        (PROSE + "The reading room follows before the end of the ye", True),
        (PROSE + "The reading room follows before the end of the year.", False),
        ("Minutes of the board.\n\nThe chair opened the meeting and thanked the guests for the long way they had come, and the treasurer then\nread the fig", True),
        ("Dear Ms Webb,\n\nthank you for the parcel. It came in good order.\n\nKind regards,\nJane Doe", False),
        ("Dear Ms Webb,\n\nthank you for the parcel. It came in good order.\n\nYours,\n\nJane Doe", False),
        ("Results of the spring race.\n\nname | club | time\nAnna | North | 31.2\nBela | South | 30.8\nCora | East | 33.0", False),
        ("Results of the spring race.\n\n| name | club | time |\n| Anna | North | 31.2 |\n| Bela | South | 30.8 |\n| Cora | Ea", True),
        ("Helper for areas.\n\ndef area(w, h):\n    total = w * h\n    return total", False),
        ("Helper for areas.\n\nint area(int w, int h) {\n    int total = w * h;\n    return total;\n}", False),
        ("Helper for areas.\n\nint area(int w, int h) {\n    int total = (w *\n    ", True),
        ("Song of the Mill\n\nRound and round the wheel goes by\nUnder grey and under blue\n\nGrain to flour and flour to bread\nOld songs ever sung anew", False),
        ("Fix the lock order", False),
    ],
)
def test_texts_of_other_kinds(text, cut):
    assert (tr.diff_state(text) or tr.message_state(text)[0]) in (("open",) if cut else ("done", "title"))
