import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import admission, compat, distribution, integrity, metrics, profile, retrieval, sampling, transform
from quarrystone.plans.components import components
from quarrystone.plans.scans import running_max, running_sum
from quarrystone.plans.topk import first_per_group

T0 = datetime(2020, 1, 1)


def test_blocked_scans_equal_plain_ones(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, rng.choice([None, rng.randrange(100)])) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    up = {(r.k, r.o): r for r in running_max(df, ["k"], ["o"], {"i": (F.col("v"), True), "x": (F.col("v"), False)}, F.floor(F.col("o") / 7)).collect()}
    down = {(r.k, r.o): r.i for r in running_max(df, ["k"], ["o"], {"i": (F.col("v"), False)}, F.floor(F.col("o") / 7), descending=True).collect()}
    total = {(r.k, r.o): r.s for r in running_sum(df, ["k"], ["o"], F.col("v"), "s", F.floor(F.col("o") / 7)).collect()}
    for k, o, v in rows:
        before = [w for j, p, w in rows if j == k and p < o and w is not None]
        after = [w for j, p, w in rows if j == k and p > o and w is not None]
        here = before + ([v] if v is not None else [])
        assert up[k, o].x == max(before, default=None) and up[k, o].i == max(here, default=None)
        assert down[k, o] == min(after, default=None) and total[k, o] == sum(here)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 400)] + [(None, 1), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_first_per_group(spark):
    rows = [(i % 2, i, i) for i in range(500)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "g int, o int, x int")
    got = [(r.g, r.o, r["rank"]) for r in first_per_group(df, ["g"], [F.col("o").desc()], F.lit(3), F.col("o")).collect()]
    assert sorted(got, key=str) == sorted([(0, 498, 1), (0, 496, 2), (0, 494, 3), (1, 499, 1), (1, 497, 2), (1, 495, 3), (None, 1, 1)], key=str)


def test_quotas(spark):
    df = spark.createDataFrame([("k", "a", 5), ("k", "b", 3), ("k", "c", 1), ("z", "a", 2)], "k string, s string, members bigint")
    q = lambda b: {(r.k, r.s): r.quota for r in sampling.quotas(df, ["k"], "s", F.lit(b)).collect()}
    assert q(4) == {("k", "a"): 2, ("k", "b"): 1, ("k", "c"): 1, ("z", "a"): 2}
    assert q(0) == {("k", "a"): 0, ("k", "b"): 0, ("k", "c"): 0, ("z", "a"): 0} and sum(v for (k, _), v in q(100).items() if k == "k") == 9


def test_sampling_ignores_the_order_of_rows(spark):
    rows = [(1, "x" if i % 3 else "y", f"p{i}.jpg", f"h{i}") for i in range(40)]
    make = lambda r: {(x.path, x.sample_id) for x in sampling.stratified_sample(spark.createDataFrame(r, "k int, stratum string, path string, h string"), ["k"], "stratum", "path", "h", F.lit(7)).collect()}
    assert make(rows) == make(rows[::-1]) and len(make(rows)) == 7
    assert make([]) == set() and len(make([(1, "x", None, None), (1, "x", None, None)])) == 1  # equal rows give one id, but two members
    two = [(1, "a", "a1", "h"), (1, "a", "a2", "h"), (1, "b", "b1", "h"), (1, "b", "b2", "h")]
    df = spark.createDataFrame([(*r, True, True) for r in two], "k int, stratum string, path string, h string, metadata_available boolean, embedding_available boolean")
    s = sampling.sampling_summary(df, ["k"], "stratum", F.lit(2)).first()
    assert (s.coverage, s.strategy, s.coverage_losses) == (0.5, "stratified", "budget_limited_candidate_coverage")


def test_temporal_slices(spark):
    v = spark.createDataFrame([("v", 6000, 180, 30.0), ("w", None, 10, 30.0), ("x", 1, 1, 5.0)], "path string, duration_ms bigint, frame_count bigint, fps double")
    rows = sampling.temporal_slices(v, 3, 500).orderBy("path", "slice").collect()
    assert [(r.start_ms, r.end_ms, r.frame_start, r.frame_end) for r in rows if r.path == "v"] == [(1000, 1500, 30, 45), (3000, 3500, 90, 105), (5000, 5500, 150, 165)]
    assert all(r.end_ms > r.start_ms and r.frame_end >= r.frame_start for r in rows) and {r.path for r in rows} == {"v", "x"}


@pytest.mark.parametrize(
    ("values", "eligible", "status", "reason"),
    [(["a"], 10, "OBSERVED", None), (["a"] * 3, 4, "SUPPORTED", None), (["a", "a", "b", "b"], 4, "UNKNOWN", "CONFLICTING_EVIDENCE"), (["a"] * 3, 10, "OBSERVED", None), ([], 3, "UNKNOWN", "NO_EVIDENCE")],
)
def test_distribution_statuses(spark, values, eligible, status, reason):
    rows = [("g", i, [v]) for i, v in enumerate(values + ["UNKNOWN"] * (eligible - len(values)))]
    d = distribution.value_distribution(spark.createDataFrame(rows, "g string, o int, vs array<string>"), ["g"], "vs", "o").collect()
    assert {(r.status, r.reason) for r in d} == {(status, reason)} and {r.eligible for r in d} == {eligible}


def test_set_and_label_metrics(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "x"]), (["c"], ["c", "y"])], "t array<string>, p array<string>")
    s = metrics.set_scores(df, "t", "p").first()
    assert (s.precision, round(s.recall, 9), round(s.f1, 9)) == (0.5, round(2 / 3, 9), round(4 / 7, 9))
    empty = metrics.set_scores(df.where("1 = 0"), "t", "p").first()
    assert (empty.tp, empty.precision, empty.f1) == (0, None, None)
    lab = spark.createDataFrame([("urban", "urban"), ("rural", "UNKNOWN")], "e string, p string")
    f = metrics.macro_f1(metrics.label_scores(lab, "e", "p")).first()
    assert round(f.macro_f1, 9) == round(1 / 3, 9) and lab.agg(metrics.unknown_rate(lab, "p")).first()[0] == 0.5


def test_consistency_ranking_percentile(spark):
    runs = spark.createDataFrame([(f, i, v) for f, vs in {"task": "aab", "scale": "sss"}.items() for i, v in enumerate(vs)], "f string, run int, v string")
    assert metrics.consistency(runs, ["f"], "run", "v").first().consistency == 3 / 4
    rank = spark.createDataFrame([("q", 1, 0), ("q", 2, 1), ("q", 3, 2)], "q string, rank int, rel int")
    ideal = spark.createDataFrame([("q", [2, 1, 0])], "q string, gains array<int>")
    r2, r3 = (metrics.ranking_scores(rank, "q", "rank", "rel", ideal, k).first() for k in (2, 3))
    assert (r2.hit, r2.rr) == (1.0, 0.5) and math.isclose(r3.ndcg, (1 / math.log2(3) + 3 / 2) / (3 + 1 / math.log2(3)))
    nums = spark.createDataFrame([(10,), (20,), (30,), (40,)], "x int")
    assert nums.agg(metrics.nearest_rank("x", 0.95)).first()[0] == 40


def test_nearest_ranks_of_groups(spark):
    rows = [("a", float(i)) for i in (4, 1, 3, 2)] + [("b", None), (None, 7.0), ("c", 5.0), ("c", 5.0), ("c", 9.0)]
    got = {r.k: (r.low, r.high) for r in metrics.nearest_ranks(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", {"low": 0.5, "high": 0.95}).collect()}
    assert got == {"a": (2.0, 4.0), None: (7.0, 7.0), "c": (5.0, 9.0)}


def test_admission_in_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(admission, "AT_ONCE", 3)
    rng = random.Random(9)
    rows = [(rng.choice("ab"), 5 * i, rng.randrange(0, 40)) for i in range(120)]
    used, want = {}, set()
    for k, o, s in rows:
        if used.get(k, 0) + s <= 150:
            used[k] = used.get(k, 0) + s
            want.add((k, o, s, used[k]))
    assert {tuple(r) for r in admission.greedy_admission(spark.createDataFrame(rows, "k string, o int, s int"), "k", "o", "s", 150).collect()} == want


def test_a_literal_is_looked_for_before_its_pattern(spark):
    from quarrystone.functions import text

    df = spark.createDataFrame([("uses pytorch here",), ("mypytorchx",), ("torch.nn",), ("",), (None,)], "t string")
    for p in (r"\bpytorch\b|\btorch\.nn\b", r"torch", r"\bto?rch\b", r"(py)?torch"):
        got = [tuple(r) for r in df.select(text.occurs(F.col("t"), p), F.col("t").rlike(p)).collect()]
        assert all(a == b for a, b in got), p


def test_integrity(spark):
    e = spark.createDataFrame([("a", 1, "x"), ("a", 2, "end"), ("a", 5, "x"), ("b", 2, "x"), ("b", 2, "x"), (None, 9, "x")], "j string, n int, t string")
    assert sorted((r.j, r.before, r.next, r.missing) for r in integrity.gaps(e, "j", "n", block=2).collect()) == [("a", 2, 5, 2), ("b", 0, 2, 1)]
    assert [(r.j, r.n) for r in integrity.after_end(e, "j", "n", "t", "end").collect()] == [("a", 5)]
    m = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (9, "x")], "i int, p string")
    u = spark.createDataFrame([(1,), (2,), (3,)], "i int")
    assert {(r.item, r.violation) for r in integrity.partition_violations(m, "i", "p", u, "i").collect()} == {(1, "several"), (3, "none"), (9, "foreign")}
    assert [r.s for r in integrity.order_breaks(spark.createDataFrame([("q", 1, 0.9), ("q", 2, 0.5), ("q", 3, 0.7)], "q string, r int, s double"), ["q"], "r", "s").collect()] == [0.7]
    j = spark.createDataFrame([('{"a":1,"b":2}',), ('{"a":1,"c":2}',), ("no",)], "j string")
    assert [r[0] for r in j.select(integrity.closed_keys(F.col("j"), ["a", "b"])).collect()] == ["", "+c|-b", None]
    assert integrity.missing_references(m, "i", u, "i").count() == 1


def test_greedy_admission_against_the_fold(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([None, rng.randrange(0, 60)])) for i in range(150)]
    used, want = {}, set()
    for k, o, s in rows:
        if s is not None and used.get(k, 0) + s <= 200:
            used[k] = used.get(k, 0) + s
            want.add((k or "", o, s, used[k]))
    got = {tuple(r) for r in admission.greedy_admission(spark.createDataFrame(rows, "k string, o int, s int"), "k", "o", "s", 200).collect()}
    assert got == want


def test_compatibility_vectors(spark):
    feats = spark.createDataFrame([("d", "text", "string", 1), ("d", "Label", "classlabel", 2), ("d", "Text", "integer", 0)], "dataset string, name string, data_type string, pos int")
    fields = spark.createDataFrame([("m", "text", "string", True), ("m", "input_ids", "integer", True), ("m", "gone", "image", True)], "model string, field string, field_type string, required boolean")
    m = {r.field: (r.name, r.relation, r.kind) for r in compat.field_mapping(feats, fields).collect()}
    assert m == {"text": ("text", "compatible", "exact")}  # two features stand for the alias, so it is left open
    one = feats.where("name <> 'Text'")
    mapping = compat.field_mapping(one, fields)
    assert {r.field: (r.name, r.relation, r.kind) for r in mapping.collect()} == {"text": ("text", "compatible", "exact"), "input_ids": ("text", "adaptable", "transform")}
    assert {(r.side, r.name) for r in compat.unmatched(one, fields, mapping).collect()} == {("dataset", "Label"), ("model", "gone")}
    r = compat.roll_up(compat.mapping_dimensions(mapping)).first()
    assert r.status == "adaptable" and math.isclose(r.score, (0.875 + 0.825) / 2)
    with pytest.raises(ValueError):
        compat.bounded(fields, 2)


def test_plans(spark):
    feats = spark.createDataFrame([("a", "string"), ("b", "float")], "name string, data_type string")
    fields = spark.createDataFrame([("text", "string", True), ("n", "integer", True), ("o", "image", False)], "field string, field_type string, required boolean")
    plan = lambda rows: sorted(tuple(r) for r in transform.plan_violations(spark.createDataFrame(rows, "source string, target string"), feats, fields).collect())
    assert plan([("a", "text"), ("b", "n")]) == []
    assert plan([("a", "n"), ("b", "n"), ("z", "q")]) == [("required_missing", "text"), ("target_twice", "n"), ("types", "n"), ("unknown_source", "z"), ("unknown_target", "q")]
    got = transform.contract_features(fields, feats, spark.createDataFrame([("a", "text")], "source string, target string")).collect()
    assert {(r.name, r.origin) for r in got} == {("text", "contract"), ("n", "contract"), ("o", "contract"), ("b", "dataset")}


def test_profiles(spark):
    df = spark.createDataFrame([(1, "x", None, [1, 2]), (2, "", " ", [3, 4])], "id int, text string, n string, a array<int>")
    p = {r.name: r for r in profile.observed_columns(profile.long_values(df, df.columns), ["name"]).collect()}
    assert (p["id"].data_type, p["id"].role, p["text"].nullable, p["n"].nullable, p["n"].blank) == ("integer", "identifier", True, True, True)
    assert p["text"].data_type == "string" and p["n"].type_set == "unknown"
    s = df.groupBy().agg(F.lit(1)).select(F.array_join(profile.modalities(F.lit("context_frame"), F.array().cast("array<string>"), F.lit(True)), "|")).first()[0]
    assert s == "video|text"
    shapes = profile.array_shapes(df.unionByName(spark.createDataFrame([(3, "x", "", None)], df.schema)), ["n"], "a").collect()
    assert {(r.n, r["shape"]) for r in shapes} == {(None, "2"), (" ", "2"), ("", None)}
    sc = lambda *a: df.select(profile.completeness(*map(F.lit, a))).first()[0]
    assert (sc(True, True, True, 0), sc(True, True, True, 2), sc(False, False, False, 50)) == (0.95, 0.89, 0.05)
    j = spark.createDataFrame([('{"a":1,"b":null}',), ('{"a":"x"}',), ("7",), (" ",), ("bad",)], "j string")
    kinds = sorted(((r.name or "", r.kind or "") for r in profile.json_members(j, "j").collect()))
    assert kinds == [("", ""), ("a", "integer"), ("a", "string"), ("b", ""), ("value", "integer")]


def test_ranking_by_dot_product(spark):
    rng = random.Random(3)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(60)] + [(60, None), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "i bigint, v array<float>")
    got = {}
    for r in retrieval.rank_by_dot(df, "i", "v", df.where("i in (0, 1)"), 5).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.i))
    vec = {r.i: r.v for r in df.collect() if r.i is not None and r.v is not None}
    for q in (0, 1):
        want = sorted((i for i in vec if i != q), key=lambda i: (-sum(a * b for a, b in zip(vec[q], vec[i])), i))[:5]
        assert [i for _, i in sorted(got[q])] == want


def test_every_pair_and_required_field_counts(spark):
    feats = spark.createDataFrame([("d", "text", "string", 1), ("e", "blob", "object", 1)], "dataset string, name string, data_type string, pos int")
    fields = spark.createDataFrame([("m", "text", "string", True), ("m", "gone", "image", True), ("n", "text", "string", True), ("n", "other", "string", True), ("o", "text", "string", True), ("o", "extra", "image", False)], "model string, field string, field_type string, required boolean")
    dims = compat.field_dimensions(feats, fields, compat.field_mapping(feats, fields))
    got = {(r.dataset, r.model, r.dimension): (r.score, r.status) for r in dims.collect()}
    assert got["d", "m", "input_fields"] == (0.5, "blocked") and got["d", "n", "input_fields"] == (0.75, "adaptable") and got["d", "o", "input_fields"] == (1.0, "compatible")
    assert got["e", "m", "data_types"] == (0.5, "unknown") and got["e", "m", "shape"] == (0.5, "unknown") and len(got) == 18
    report = {(r.dataset, r.model): (r.status, r.dimensions) for r in compat.roll_up(dims).collect()}
    assert report == {("d", "m"): ("blocked", 3), ("d", "n"): ("unknown", 3), ("d", "o"): ("compatible", 3), **{("e", x): ("blocked", 3) for x in "mno"}}
    shaped = lambda d, s: d.withColumn("shape", F.array(*map(F.lit, s)))
    one, want = feats.where("dataset = 'd'"), fields.where("model = 'o'")
    status = lambda f, w: compat.field_dimensions(f, w, compat.field_mapping(f, w)).where("dimension = 'shape'").first().status
    assert status(shaped(one, ["8", "x"]), shaped(want, ["8", "y"])) == "blocked" and status(one, shaped(want, ["8"])) == "adaptable"


def test_dimensions_of_profiles(spark):
    data = spark.createDataFrame([("d", ["classification"], ["text"], "MIT", False, ["Tokenize"]), ("e", [], ["image"], None, True, None)], "dataset string, task_hints array<string>, modalities array<string>, license string, has_label boolean, satisfied array<string>")
    models = spark.createDataFrame([("m", ["text-classification"], ["text"], ["tokenize"], "apache-2.0", ["pytorch"])], "model string, tasks array<string>, modalities array<string>, preprocessing array<string>, license string, frameworks array<string>")
    got = {(r.dataset, r.dimension): (r.status, r.score) for r in compat.profile_dimensions(data, models).collect()}
    assert {k: v for (d, k), v in got.items() if d == "d"} == {"task": ("compatible", 1.0), "modality": ("compatible", 1.0), "preprocessing": ("compatible", 1.0), "labels": ("adaptable", 0.5), "license": ("compatible", 1.0), "runtime": ("unknown", 0.6)}
    assert {k: v for (d, k), v in got.items() if d == "e"} == {"task": ("unknown", 0.5), "modality": ("blocked", 0.0), "preprocessing": ("adaptable", 0.75), "labels": ("compatible", 1.0), "license": ("unknown", 0.5), "runtime": ("unknown", 0.6)}
