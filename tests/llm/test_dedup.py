import hashlib
import random
from collections import defaultdict
from pathlib import Path

from lorekeel.llm import components, exact_dedup, near_dedup
from lorekeel.llm.common import shared_dir

from .helpers import DOCS, normal, prose, rows, shingles
from .helpers import components as brute_components


def frame(spark, data):
    return spark.createDataFrame(data, DOCS).repartition(5)


def test_exact_duplicates_against_brute_force(spark):
    data = rows()
    got = exact_dedup.exact_duplicates(frame(spark, data)).collect()
    groups = defaultdict(list)
    for r in data:
        groups[normal(r[1])].append(r[0])
    assert len(got) == len(data)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ids = by_hash[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == (min(known) if known else None)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1}


def test_exact_rounds_do_not_change_the_result(spark):
    docs = frame(spark, rows()).repartition(40)
    few = exact_dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size").collect()
    assert sorted(map(str, few)) == sorted(map(str, exact_dedup.exact_duplicates(docs.coalesce(1)).select("doc_id", "keep_id", "group_size").collect()))


def test_exact_duplicates_write_their_entries_only_and_exchange_runs_once_a_round(spark):
    def parts():
        return sum(1 for _ in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("part-*"))

    shared_dir(spark)
    docs, before = frame(spark, rows()).repartition(20), parts()
    out = exact_dedup.exact_duplicates(docs)
    assert parts() - before == 20
    # 20 runs meet in two rounds; the other two exchanges are those of the join
    assert out._jdf.queryExecution().sparkPlan().toString().count("Aggregate") == 4
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(digest") == 4
    assert out.count() == len(rows())


def test_drop_exact_duplicates_keeps_columns_and_one_row_of_each_text(spark):
    data = rows()
    docs = frame(spark, data)
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    texts = [normal(r["text"]) for r in out.collect()]
    assert sorted(texts) == sorted({normal(r[1]) for r in data})


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).count() == 0
    assert near_dedup.near_duplicates(docs).count() == 0
    assert near_dedup.drop_near_duplicates(docs).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    data = [r for r in rows() if r[0] is not None]
    data = list(dict.fromkeys(data)) + [data[3]]
    got = near_dedup.near_duplicates(frame(spark, data)).collect()
    assert len(got) == len(data)
    order = sorted(set(data), key=lambda r: r[0])
    sets = [shingles(r[1]) for r in order]
    want = {r[0]: (len(s), order[c][0]) for r, s, c in zip(order, sets, brute_components(sets), strict=True)}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    per = defaultdict(int)
    for r in got:
        per[r["component_id"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["component_id"]
    assert all(n == 1 for n in per.values())


def test_near_duplicates_of_a_large_group_and_a_common_passage(spark):
    """Thousands of pairs share hot values: nothing may be lost, and unrelated documents stay apart."""
    rng = random.Random(9)
    base, passage = prose(rng, 200).split(" "), prose(rng, 60)
    data = []
    for i in range(60):
        near = list(base)
        for _ in range(rng.randint(1, 9)):
            near[rng.randrange(len(near))] = f"v{rng.randrange(10**6)}"
        data.append((i, " ".join(near)))
    data += [(100 + i, f"{prose(rng, rng.randint(10, 80))} {passage}") for i in range(120)]
    data += [(300 + i, passage + " " + " ".join(f"t{i}" for _ in range(3))) for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs).collect()}
    want = brute_components([shingles(t) for _, t in data])
    assert got == {d: data[c][0] for (d, _), c in zip(data, want, strict=True)}


def test_near_duplicates_of_a_large_group_around_the_threshold(spark):
    """Few of the pairs are linked, and all share values under many labels: each link must be found."""
    rng = random.Random(1)
    base, data = prose(rng, 200).split(" "), []
    for i in range(150):
        near = list(base)
        for at in rng.sample(range(200), 4):
            near[at] = f"v{i}x{at}"
        data.append((i, " ".join(near)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(brute_components([shingles(t) for _, t in data])))


def test_null_ids_and_texts_in_near_duplicates(spark):
    got = near_dedup.near_duplicates(frame(spark, rows()))
    assert got.count() == len(rows())
    assert got.where("n_shingles = 0 and not kept").count() == 0
    docs = frame(spark, rows())
    out = near_dedup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert out.where("text is null").count() >= 1


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200), (201, 202), (201, 202)]
    for few in (0, 1000):
        got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), few).collect()}
        assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(40)}, 201: 201, 202: 201}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
