"""Sharding, lexical search and whitening: awkward rows, brute force, exact linear algebra."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("txnwatch.llm")

from pyspark.sql import functions as F
from txnwatch.llm import charpoly, lexical, queries, sharding, whitening

SCHEMA = "doc_id long, text string, shard string, slot int, row string, score double, n int, size string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "clash", 1, "clash", 0.5, 3, "clash") for i, t in pairs], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["harbour", "river", "Stone", "quiet", "boats", "leave", "ÉTÉ", "été", "x9", "the"] + [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(300)]
    texts += [None, "", " \t\n", "...", "q" * 200_000, "the " * 60_000, "a\x00b c_d-e", *["copied text of many rows"] * 250]
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(None, None), (None, "river stone"), (7, texts[7]), (7, texts[7])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(4)


def placed(docs, shards=sharding.SHARDS):
    text = F.coalesce("text", F.lit(""))
    return sharding.by_bytes(docs, sharding.document_size(), text, F.col("doc_id"), shards)


def check_shards(out, shards):
    by_shard = defaultdict(list)
    for r in out:
        by_shard[r["shard"]].append(r)
    for own in by_shard.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    filled = [sum(r["size"] for r in by_shard[s]) for s in range(shards)]
    # No shard is further from the mean than the largest row, or a hundredth, explains.
    spread = max(filled) - sum(filled) / shards
    assert spread <= max(max(r["size"] for r in out), sum(filled) / shards / 50)
    return filled


def test_shards_hold_every_row_and_equal_bytes(docs, rows):
    out = placed(docs).collect()
    assert Counter((r.row.doc_id, r.row.text) for r in out) == Counter(rows)
    assert all(r.size == len((r.row.text or "").encode()) + 16 for r in out)
    check_shards(out, sharding.SHARDS)
    assert out[0].row.shard == "clash" and isinstance(out[0].shard, int)


@pytest.mark.parametrize("shards", [1, 3])
def test_copies_share_a_shard_unless_heavy(spark, shards):
    rng = random.Random(5)
    texts = [f"text {i} " + "y" * rng.randint(0, 300) for i in range(500)]
    pairs = [(i, texts[i % 500]) for i in range(1000)] + [(5000 + i, "hot") for i in range(800)]
    out = placed(frame(spark, pairs), shards).collect()
    check_shards(out, shards)
    shards_of = defaultdict(set)
    for r in out:
        shards_of[r.row.text].add(r.shard)
    assert all(len(s) == 1 for t, s in shards_of.items() if t != "hot")


def test_shards_do_not_depend_on_partitions(spark, rows):
    def at(n):
        distinct = [r for r in {(i, t): (i, t) for i, t in rows}.values()]
        return {(r.row.doc_id, r.row.text): (r.shard, r.slot) for r in placed(frame(spark, distinct).repartition(n)).collect()}

    assert at(1) == at(5)


def test_one_row_repeated_is_still_divided(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    filled = check_shards(placed(docs).collect(), sharding.SHARDS)
    assert max(filled) - min(filled) <= 20 * 5


def test_a_heavy_row_stands_alone():
    cuts = sharding._cuts([("a" * 48, 0.1), ("b" * 48, 5.0), ("c" * 48, 0.1), ("d" * 48, 0.2)], 1.0, 1.0)
    assert [c[0] for c in cuts] == ["b", "c"]


def test_ranges_move_until_shards_are_even():
    totals = [sharding.Totals(b, 1) for b in [90, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1]]
    shard_of, first = sharding._deal(totals, 4)
    filled = [sum(t.bytes for t, s in zip(totals, shard_of) if s == k) for k in range(4)]
    assert sorted(filled) == [3, 3, 4, 90]
    for s in range(4):
        assert sorted(f for f, own in zip(first, shard_of) if own == s) == list(range(shard_of.count(s)))


def test_written_shards_are_read_back(docs, rows, tmp_path):
    out = sharding.write_shards(docs, str(tmp_path / "shards"), 5).collect()
    assert Counter((r.row.doc_id, r.row.text) for r in out) == Counter(rows)
    check_shards(out, 5)
    assert {p.name for p in (tmp_path / "shards").glob("shard=*")} <= {f"shard={i}" for i in range(5)}


def test_sharding_runs_no_python(docs):
    plan = placed(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1


def test_empty_tables(spark):
    assert placed(frame(spark, [])).collect() == []
    items = spark.createDataFrame([(1, "river")], "item_id long, text string")
    assert lexical.best_documents(frame(spark, []), items).collect() == []
    assert lexical.best_documents(frame(spark, [(1, "river")]), items.where("false")).collect() == []
    assert lexical.best_documents(frame(spark, [(1, None)]), items).collect() == []
    assert whitening.whitened(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# --- lexical search -------------------------------------------------------------------------------


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(rows, items, best):
    found = {}
    counted = [(i, Counter(terms(t))) for i, t in rows]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    for number, (_, text) in enumerate(items):
        scored = []
        for i, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        found[number] = [(None if null else i, -s) for s, null, i in sorted(scored)[:best]]
    return found


@pytest.mark.parametrize("best, bucket, slab", [(10, 2048, 4 << 20), (3, 7, 400), (1000, 16, 2000)])
def test_search_equals_brute_force(spark, docs, rows, monkeypatch, best, bucket, slab):
    rng = random.Random(8)
    texts = ["river STONE", "ÉTÉ été x9", None, "", "the", "copied text", "nowhere to be found", "w1 w2 w3 w4 w5 w6 w7 w8 w9", "a b c d e"]
    texts += [" ".join(f"w{rng.randint(0, 220)}" for _ in range(rng.randint(1, 30))) for _ in range(20)]
    items = [(i, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame([(i, t, 9, 9) for i, t in items], "item_id int, text string, rank int, doc_id long")
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    monkeypatch.setattr(lexical, "SLAB_ENTRIES", slab)
    monkeypatch.setattr(lexical, "PIECE_BYTES", 1000)
    out = defaultdict(list)
    for r in sorted(lexical.best_documents(docs, table, best).collect(), key=lambda r: r["rank"]):
        assert r["rank"] == len(out[r.item_id]) + 1
        out[r.item_id].append((r.doc_id, r.score))
    expected = brute_search(rows, items, best)
    assert {i: out.get(i, []) for i, _ in items} == expected


def test_items_in_blocks_and_repeated_items(spark, monkeypatch):
    docs = frame(spark, [(i, f"river w{i % 7} w{i % 3}") for i in range(50)])
    items = spark.createDataFrame([("a", "river w1"), ("a", "river w1"), (None, "w2 w5")], "item_id string, text string")
    whole = sorted(map(str, lexical.best_documents(docs, items).collect()))
    monkeypatch.setattr(lexical, "ITEM_BYTES", 6)
    assert sorted(map(str, lexical.best_documents(docs, items).collect())) == whole
    assert len(whole) == 30


def test_short_vectors_are_pruned():
    """The Cauchy-Schwarz bound stops at the first bucket whose longest vector cannot reach any threshold."""
    top = lexical.Top(1, 1, np.array([100]))
    items, starts = np.array([1]), np.array([0, 1])

    def bucket(length, impact):
        posted = np.array([0, 0, 1])
        return lexical._bucket(np.array([4]), np.array([length]), np.array([impact]), np.array([0]), posted, items, starts, top)

    assert bucket(150.0, 150) and top.least[0] == 150
    assert not bucket(149.0, 149)


# --- whitening ------------------------------------------------------------------------------------


def exact_matrix(x):
    x = [[int(v) for v in row] for row in x]
    n, d = len(x), len(x[0])
    s = [sum(row[i] for row in x) for i in range(d)]
    return [[n * sum(row[i] * row[j] for row in x) - s[i] * s[j] for j in range(d)] for i in range(d)]


def solved(matrix, most=99):
    needed = charpoly.primes(charpoly.primes_needed(matrix))
    polynomial = charpoly.combine({p: charpoly.residues(matrix, p) for p in needed})
    roots, scale = charpoly.eigenvalues(polynomial, most)
    return polynomial, roots, scale


def determinant(m):
    m = [[Fraction(x) for x in row] for row in m]
    out = Fraction(1)
    for k in range(len(m)):
        pivot = next((i for i in range(k, len(m)) if m[i][k]), None)
        if pivot is None:
            return Fraction(0)
        if pivot != k:
            m[k], m[pivot], out = m[pivot], m[k], -out
        out *= m[k][k]
        for i in range(k + 1, len(m)):
            f = m[i][k] / m[k][k]
            m[i] = [a - f * b for a, b in zip(m[i], m[k])]
    return out


@pytest.mark.parametrize("seed, n, d", [(1, 9, 5), (2, 30, 8), (3, 3, 6)])
def test_polynomial_is_exact(seed, n, d):
    matrix = exact_matrix(np.random.default_rng(seed).integers(-1000, 1000, (n, d)))
    polynomial, _, _ = solved(matrix)
    for x in (0, 1, -3, 10**6):
        value = determinant([[x * (i == j) - matrix[i][j] for j in range(d)] for i in range(d)])
        assert value == sum(c * x**k for k, c in enumerate(polynomial))


@pytest.mark.parametrize("seed, n, d", [(1, 60, 12), (2, 5, 9), (4, 200, 3)])
def test_components_match_a_direct_solver(seed, n, d):
    matrix = exact_matrix(np.random.default_rng(seed).integers(-50, 50, (n, d)))
    _, roots, scale = solved(matrix)
    values, vectors = np.linalg.eigh(np.array(matrix, float))
    assert len(roots) == min(d, n - 1)
    for k, (root, times) in enumerate(roots):
        assert times == 1 and math.isclose(root / 2**scale, values[-1 - k], rel_tol=1e-9)
        (v,) = charpoly.null_space(matrix, root, 1, scale)
        assert abs(abs(np.dot(v, vectors[:, -1 - k])) - 1) < 1e-9


def test_equal_and_close_eigenvalues():
    polynomial, roots, scale = solved([[5, 0, 0], [0, 5, 0], [0, 0, 2]])
    assert polynomial == [-50, 45, -12, 1] and [(r >> scale, m) for r, m in roots] == [(5, 2), (2, 1)]
    pair = charpoly.null_space([[5, 0, 0], [0, 5, 0], [0, 0, 2]], roots[0][0], 2, scale)
    assert np.allclose(np.array(pair) @ np.array(pair).T, np.eye(2)) and np.allclose(np.array(pair)[:, 2], 0)
    # Apart by one part in 10^24, where doubles see one eigenvalue.
    matrix = [[10**24 + 1, 0], [0, 10**24]]
    _, roots, scale = solved(matrix)
    assert [m for _, m in roots] == [1, 1]
    vectors = [charpoly.null_space(matrix, r, 1, scale)[0] for r, _ in roots]
    assert np.allclose(np.abs(vectors), np.eye(2), atol=1e-12)
    assert solved([[0, 0], [0, 0]])[1] == [] and solved([[4, 2], [2, 1]])[1][0][0] >> solved([[4, 2], [2, 1]])[2] == 5


def test_exact_counts_of_roots():
    polynomial = [-6, 11, -6, 1]  # 1, 2, 3
    assert [charpoly._above(polynomial, a, 1) for a in (0, 1, 2, 3, 4, 5, 6)] == [3, 3, 2, 2, 1, 1, 0]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(11)
    good = (rng.normal(size=(400, 10)) * np.linspace(0.1, 2, 10) + np.arange(10)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(good)] + [(None, good[0].tolist()), (3, good[3].tolist())]
    bad = [(900, None), (901, [float("nan")] * 10), (902, [float("inf")] * 10), (903, [None] * 10), (904, [1.0] * 4), (905, [])]
    return rows, bad


def test_whitening_equals_a_direct_solution(spark, vectors):
    good, bad = vectors
    table = spark.createDataFrame([(i, v, 1.0, "n") for i, v in good + bad], "vec_id long, embedding array<float>, whitened double, n string")
    out = whitening.whitened(table.repartition(3), components=4).collect()
    assert len(out) == 4 * len(good) and {r.n for r in out} == {len(good)}
    x = np.floor(64 * np.array([v for _, v in good])).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    deviation = Counter()
    for (i, _), row in zip(good, x):
        deviation[i, sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))] += 4
    assert Counter((r.vec_id, r.deviation) for r in out) == deviation
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    for k in range(4):
        mine = {(r.vec_id, r.deviation): r.whitened for r in out if r.component == k + 1}
        own = centred @ axes[:, -1 - k] / math.sqrt(values[-1 - k])
        theirs = {(i, sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))): w for (i, _), row, w in zip(good, x, own)}
        sign = np.sign(sum(mine[i] * theirs[i] for i in mine))
        assert max(abs(mine[i] - sign * theirs[i]) for i in mine) < 1e-8
    assert all(math.isclose(r.explained, values[-r.component] / values.sum(), rel_tol=1e-9) for r in out)
    assert {r.identity_error for r in out}.pop() < 1e-9


def test_whitening_of_degenerate_vectors(spark):
    def components(rows):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        return [(r.vec_id, r.component) for r in whitening.whitened(table).collect()]

    assert components([(1, [1.0, 2.0])] * 3) == []  # no variance
    assert sorted(components([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0])])) == [(1, 1), (2, 1), (3, 1)]
    assert components([(1, None)]) == []


def test_huge_entries_stay_exact(spark):
    table = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    out = whitening.whitened(table).collect()
    assert {r.deviation for r in out if r.vec_id != 3} == {None}  # beyond a long
    assert {r.component for r in out} == {1, 2} and all(r.identity_error < 1e-4 for r in out)


def test_queries_are_registered():
    assert {"op11_sharding", "op12_lexical_search", "op13_whitening"} <= set(queries.QUERIES)
    assert "op12_lexical_search" in queries.ORACLE_SQL


# --- earlier operators ----------------------------------------------------------------------------


def test_short_texts_are_packed_tightly(spark):
    from txnwatch.llm import cutting

    docs = spark.range(90_000).selectExpr("id as doc_id", "case id % 3 when 0 then null when 1 then 'ab cd' else 'ab' end as text")
    out = cutting.pack(docs).groupBy("sequence_id").agg(F.sum("length").alias("ids"), F.max(F.expr("offset + length")).alias("end"))
    rows = out.collect()
    ids = sum(r.ids for r in rows)
    assert all(r.ids == r.end <= cutting.CAPACITY for r in rows)
    assert 1 - ids / (cutting.CAPACITY * len(rows)) < 0.02


def test_small_and_large_pieces_share_sequences():
    from txnwatch.llm import cutting

    demand = np.zeros(cutting.BLOCK, np.int64)
    rng = np.random.default_rng(1)
    np.add.at(demand, rng.integers(0, 60, 5000), 1)
    plan = cutting.plan_patterns(demand, cutting.BLOCK)
    held = sum(p * n for p, n in plan)
    assert (held == demand).all()
    assert all((p * np.arange(1, cutting.BLOCK + 1)).sum() <= cutting.BLOCK for p, _ in plan)
    least = -(-int((demand * np.arange(1, cutting.BLOCK + 1)).sum()) // cutting.BLOCK)
    assert sum(n for _, n in plan) <= least + 1


def test_items_of_another_length_change_nothing(spark):
    from txnwatch.llm import decontam

    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.sample(words, 40))) for i in range(30)]
    docs = [(i, " ".join(rng.sample(words, 200)) + " " + items[i % 30][1] + " " + " ".join(rng.sample(words, 90))) for i in range(60)]
    long = (99, " ".join(rng.choices(words, k=3000)))
    docs.append((70, "before " + long[1] + " after"))
    table = frame(spark, docs)

    def found(listed):
        return {tuple(r) for r in decontam.contamination(table, spark.createDataFrame(listed, "item_id long, text string")).collect()}

    without, both = found(items), found([*items, long])
    assert len(without) == 60 and without == {r for r in both if r[1] != 99}
    assert {r[0] for r in both if r[1] == 99} == {70}


@pytest.mark.parametrize("n, stride", [(0, 64), (1, 64), (64, 64), (65, 128), (128, 128), (129, 256), (3000, 4096)])
def test_stride_of_an_item(spark, n, stride):
    from txnwatch.llm import decontam

    assert spark.range(1).select(F.lit(n).alias("n")).select(F.expr(decontam.STRIDE)).first()[0] == stride


AWKWARD = "doc_id long, text string, n_chars int, kept boolean, score string, n_words string, spans string, total_llr int, row string"


def test_pipeline_stages_pass_all_columns_through(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)

    def prose():
        return " ".join(rng.choice(["the", "harbour", "river", "stone", "quiet", "boats", "leave"]) + rng.choice(["", "ly", "er"]) for _ in range(90))

    texts = [prose() for _ in range(12)]
    texts += [texts[0], None, "", " \n", "password: hunter2hunter2 " + texts[1], "x" * 200_000]
    rows = [(i, t, len(t or ""), True, f"s{i}", "n", "sp", i, "r") for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[4], 9, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, AWKWARD)
    sf = str(tmp_path)
    spark.createDataFrame([(i, 1, 0) for i in range(0, 12, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(5, texts[5])], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    known = {tuple(r) for r in docs.collect()}
    for frame_ in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame_, sf)
            assert out.dtypes == docs.dtypes, name
            got = out.collect()
            if name == "secret_scan":
                assert len(got) == frame_.count()
                changed = [r for r in got if tuple(r) not in known]
                assert len(changed) == (1 if len(got) else 0)
                assert all("[SECRET]" in r.text and r.n_chars == len(r.text) and r.score == "s16" for r in changed)
            else:
                assert {tuple(r) for r in got} <= known, name
                assert bool(got) == bool(frame_.count()), name
        assert corpus_pipeline.STAGES[-1][1](spark, frame_, sf).count() >= frame_.count()
    left = [r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, sf).collect()]
    assert 5 not in left and len(left) == len(rows) - 1


def test_shared_folder_must_be_named_on_a_cluster():
    from txnwatch.llm import shared

    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session)
