import random

from quarrystone.llm import overlap

CAND = "candidate_key string, resource_id string, path string, content_hash string, phash string, split_name string, key string, sha string, split string"
SAMP = "sample_key string, resource_id string, path string, content_hash string, split_name string, high int"


def pairs(spark, cand, samp):
    c = spark.createDataFrame([(*r, "x", "y", "z") for r in cand], CAND)
    s = spark.createDataFrame([(*r, 1) for r in samp], SAMP)
    return {(r.train_key, r.eval_key) for r in overlap.cross_split_pairs(c, s).collect()}


def flipped(p, bits, rng):
    x = int(p, 16)
    for b in rng.sample(range(128), bits):
        x ^= 1 << b
    return f"{x:032x}"


def test_near_fingerprints_against_brute_force(spark):
    rng = random.Random(5)
    base = [f"{rng.getrandbits(128):032x}" for _ in range(12)]
    cand = []
    for i in range(240):
        p = flipped(rng.choice(base), rng.choice([0, 3, 5, 6, 10]), rng)
        cand.append((f"k{i}", "r", "a/b.jpg", None, rng.choice([p, p.upper(), f" {p} "]), rng.choice(["train", "Trn ", "dev", "hold-out", None])))
    num = {k: int(p.strip(), 16) for k, _, _, _, p, _ in cand}
    side = {r[0]: None if r[5] is None else r[5].strip().lower() in ("train", "trn") for r in cand}
    want = {(a, b) for a in num for b in num if side[a] is True and side[b] is False and (num[a] ^ num[b]).bit_count() <= 10}
    assert pairs(spark, cand, []) == want and len(want) > 100


def test_every_design_is_exact_at_the_bound(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(60):
        p = rng.getrandbits(128)
        for d in (10, 11):
            q = p
            for b in rng.sample(range(128), d):
                q ^= 1 << b
            rows.append((p, q, d))
    for design in overlap.designs():
        masks = [(g, sum(((1 << n) - 1) << (128 - a - n) for a, n in t)) for g, t in design.terms]
        for p, q, d in rows:
            if d == 10:  # in one group as many common terms as the threshold asks for
                common = [0] * (max(g for g, _ in masks) + 1)
                for g, m in masks:
                    common[g] += p & m == q & m
                assert max(common) / design.per_group >= design.threshold
    assert min(overlap.cheapest(10**k, 10**k)[0].kept for k in (2, 9)) < max(overlap.cheapest(10**k, 10**k)[0].kept for k in (2, 9))


def test_designs_that_share_several_terms_lose_nothing(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"{rng.getrandbits(128):032x}" for _ in range(6)]
    cand = [(f"k{i}", "r", "x", None, flipped(rng.choice(base), rng.choice([0, 5, 10]), rng), rng.choice(["train", "dev"])) for i in range(120)]
    num = {k: int(p, 16) for k, _, _, _, p, _ in cand}
    side = {r[0]: r[5] for r in cand}
    want = {(a, b) for a in num for b in num if side[a] == "train" and side[b] == "dev" and (num[a] ^ num[b]).bit_count() <= 10}
    several = max((d for d in overlap.designs() if d.shared > 2), key=lambda d: d.kept)
    for mapped in (True, False):
        monkeypatch.setattr(overlap, "cheapest", lambda *_, m=mapped: (several, m))
        assert pairs(spark, cand, []) == want and len(want) > 100


def test_terms_are_mapped_where_the_evaluation_side_is_small():
    assert overlap.cheapest(10**8, 10**4)[1] and not overlap.cheapest(10**5, 10**5)[1]


def test_a_third_of_all_prints_in_one_cluster(spark, monkeypatch):
    from quarrystone.llm import cosine

    monkeypatch.setattr(cosine, "LIST", 16)
    rng = random.Random(8)
    blank = "f" * 32
    cand = [(f"k{i}", "r", "x", None, flipped(blank, rng.randrange(0, 4), rng) if i % 3 == 0 else f"{rng.getrandbits(128):032x}", "train" if i % 2 else "test") for i in range(600)]
    num = {k: int(p, 16) for k, _, _, _, p, _ in cand}
    side = {r[0]: r[5] for r in cand}
    want = {(a, b) for a in num for b in num if side[a] == "train" and side[b] == "test" and (num[a] ^ num[b]).bit_count() <= 10}
    assert pairs(spark, cand, []) == want and len(want) > 5000


def test_hashes_splits_and_keys(spark):
    h, g = "ab" * 32, "cd" * 32
    cand = [
        ("a", "r", "x/1.jpg", f"SHA256:{h.upper()}", None, " TRAIN "), ("b", "r", "x/2.jpg", f"{h} ", None, "val"), ("c", "r", "data\\testing\\3.jpg", f"sha256:{h}", None, None),
        ("d", "r", "test_rig/4.jpg", h, None, None), ("a", "r", "x/1.jpg", h, None, "test"), ("e", "r", "x", "ab" * 16, None, "train"), ("f", "r", "x", "ab" * 16, None, "test"), (None, "r", "x", h, None, "test"),
        ("t", "r", "train", h, None, None), ("g", "r", None, g, None, None), ("u", "r", None, g, "zz", "odd"),
    ]
    samp = [("s", "r", "q/holdout/v.mp4", h, ""), ("s", "r", "q/holdout/v.mp4", h, None), ("w", None, None, g, "test")]
    assert pairs(spark, cand, samp) == {("a", "b"), ("a", "c"), ("a", "s")}
    assert pairs(spark, [], []) == set()


def test_hot_hash_gives_whole_result(spark):
    h = "ab" * 32
    cand = [(f"t{i}", "r", "x", h, "0" * 32, "train") for i in range(60)] + [(f"e{i}", "r", "x", h, "0" * 32, "test") for i in range(40)]
    assert len(pairs(spark, cand, [])) == 2400


def test_counts_by_split_and_resource(spark):
    h = "ab" * 32
    c = spark.createDataFrame([("a", "r1", "x", h, None, "train", "", "", ""), ("b", "r2", "x", h, None, "dev", "", "", ""), ("c", "r2", "x", h, None, "test", "", "", "")], CAND)
    got = {(r.split, r.resource_id, r.pairs, r.records) for r in overlap.overlap_counts(c, spark.createDataFrame([], SAMP)).collect()}
    assert got == {("validation", "r2", 1, 1), ("test", "r2", 1, 1)}


def test_links_of_copies_are_counted_not_listed(spark):
    h = "ab" * 32
    cand = [(f"t{i}", "r", "x", h, "0" * 32, "train", "", "", "") for i in range(7)] + [(f"e{i}", "r", "x", h, "0" * 31 + "1", "test", "", "", "") for i in range(5)]
    got = overlap.overlap_links(spark.createDataFrame(cand, CAND), spark.createDataFrame([], SAMP)).collect()
    assert {(r.key[0], r.same_links, r.near_links, r.content_class) for r in got} == {("t", 5, 5, h), ("e", 7, 7, h)} and len(got) == 12
    assert {r.print_class for r in got} == {"0" * 32, "0" * 31 + "1"}


def test_counts_equal_the_listed_pairs(spark):
    rng = random.Random(11)
    shas = [f"{i:02x}" * 32 for i in range(8)]
    prints = [f"{rng.getrandbits(128):032x}" for _ in range(5)]
    rows = []
    for i in range(260):
        key = f"k{rng.randrange(170)}"  # some with several values, some on both sides
        p = rng.choice([None, flipped(rng.choice(prints), rng.choice([0, 0, 2, 6]), rng)])
        rows.append((key, rng.choice(["r1", "r2"]), "x", rng.choice([None, *shas]), p, rng.choice(["train", "train", "dev", "test"]), "", "", ""))
    c, s = spark.createDataFrame(rows, CAND), spark.createDataFrame([], SAMP)
    who = {}
    for r in rows:
        if r[5] != "train" and (r[3] or r[4]):
            who.setdefault(r[0], set()).add(("test" if r[5] == "test" else "validation", r[1]))
    want = {}
    for a, b in pairs(spark, [r[:6] for r in rows], []):
        for w in who[b]:
            want.setdefault(w, []).append(b)
    got = {(r.split, r.resource_id): (r.pairs, r.records) for r in overlap.overlap_counts(c, s).collect()}
    assert got == {w: (len(x), len(set(x))) for w, x in want.items()}
