import numpy as np
import pytest

from orbitlake.llm import embeddings
from orbitlake.llm.common import components


def brute(rows, threshold):
    fine = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    x = np.zeros((len(fine), max((len(v) for _, v in fine), default=0)))
    for i, (_, v) in enumerate(fine):
        x[i, : len(v)] = v
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    label = np.array([i for i, _ in fine])
    while True:
        new = np.array([min([label[i], *label[near[i]]]) for i in range(len(fine))])
        if (new == label).all():
            break
        label = new
    out = {id(r): (r[0], 0, r[0]) for r in rows}
    for i, r in enumerate(fine):
        out[id(r)] = (r[0], int(near[i].sum()), int(label[i]))
    return sorted(out.values())


@pytest.mark.parametrize("tile", [4096, 40])
def test_links_match_brute_force(spark, tile):
    r = np.random.default_rng(2)
    base = r.normal(size=(30, 40))
    rows = [(i, (base[i % 30] + r.normal(size=40) * 0.3 * (i % 3)).tolist()) for i in range(300)]
    rows += [(400, None), (401, [0.0] * 40), (402, [1.0, None]), (403, [float("nan")] * 40), (404, [float("inf"), 1.0]), (405, []), (406, rows[0][1]), (407, [x * 5 for x in rows[3][1]]), (408, [1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, node int")
    got = embeddings.embedding_groups(df, tile=tile).collect()
    assert sorted((x.id, x.n_links, x.component_id) for x in got) == brute(rows, 0.9)
    assert all(x.kept == (x.id == x.component_id) for x in got)
    assert embeddings.embedding_groups(df.limit(0)).count() == 0


def test_tiles_meet_in_stripes_without_a_shuffle(spark, monkeypatch):
    """Each two tiles of many stripes meet once, and none is written for each mate: before, all mates were shuffled."""
    r, meets, write = np.random.default_rng(4), [], embeddings.stored
    monkeypatch.setattr(embeddings, "stored", lambda df, name: (name == "vector-links" and meets.append(df._jdf.queryExecution().toString()), write(df, name))[1])
    base = r.normal(size=(25, 20))
    rows = [(i, (base[i % 25] + r.normal(size=20) * 0.12 * (i % 4)).tolist()) for i in range(400)]
    rows += [(i, [1.0, *(r.normal(size=19) * 0.01).tolist()]) for i in range(400, 460)]  # a dense group over tiles and stripes
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = embeddings.embedding_groups(df, tile=20, stripe=20 * 70)
    assert sorted((x.id, x.n_links, x.component_id) for x in got.collect()) == brute(rows, 0.9)
    assert len(meets) > 1 and not any("Exchange" in m for m in meets)


def test_pairs_at_the_threshold_are_decided_on_the_vectors_as_given(spark):
    v = [[3.0, 4.0, 0.0], [4.0, 3.0, 0.0], [3.0, 4.0, 1e-7], [0.0, 5.0, 0.0]]
    rows = [(i, x) for i, x in enumerate(v)]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b)) / (sum(p * p for p in a) ** 0.5 * sum(q * q for q in b) ** 0.5)
    for t in (0.96, 0.8, dot(v[1], v[2])):
        got = {x.id: x.n_links for x in embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=t).collect()}
        assert got == {i: sum(j != i and dot(a, b) >= t for j, b in rows) for i, a in rows}


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(900, 901), (901, 900), (7, 7), (None, 3)], "a long, b long"))
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def test_pipeline_stages_handle_odd_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(i, f"text number {i} " + " ".join(f"t{i}x{j}" for j in range(40)), "en", "s", 1, "x") for i in range(20)]
    rows += [(100, None, None, None, None, None), (101, "", "en", "s", 0, "x"), (None, long, "en", "s", 1, "x"), (102, long, "en", "s", 1, "x"), (102, long, "en", "s", 1, "x"), (103, long + " end", "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(i, 1, int(i == 3)) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{i}")
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        if name != "packing":
            assert out.columns == docs.columns
            docs = spark.read.parquet(f"{tmp_path}/{i}")
        if name == "simhash_near_dedup":
            assert sorted(r.doc_id for r in docs.where("doc_id >= 100").collect()) == [100, 102]
    out = spark.read.parquet(f"{tmp_path}/4")
    assert out.select("doc_id").distinct().count() == docs.count()
