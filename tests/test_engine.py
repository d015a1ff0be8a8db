"""Encoders, learners and sources on DataFrames."""

import importlib.util

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pursuit.functions import vectors as V
from pursuit.kernels import coders, dictionaries
from pursuit.operators import classify, dictionary, evaluate, learn, preprocess
from pursuit.operators.encode import FeatureEncoder, SparseEncoder, dense
from pursuit.plans import catalogue
from pursuit.sources import images as sources
from pursuit.sources.workspace import Workspace, request_workspace
from pursuit.streaming.online import StreamingLearner

SF = "/root/testdata/sf0.01"
RNG = np.random.default_rng(4)


def frame(spark, X, y=None, parts=3):
    rows = [(i, x.tolist(), int(y[i]) if y is not None else 0) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "id long, x array<double>, label int").repartition(parts)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        c.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, con, name):
    out = catalogue.queries()[name](spark, SF)
    rel = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(out.columns)
    assert sorted(repr(tuple(r[c] for c in names)) for r in out.collect()) == sorted(map(repr, rel.fetchall()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_unknown_and_missing_parameters():
    for name, params in [("nope", {}), ("omp", {}), ("bomp", {}), ("omp", {"n_nonzero_coefs": 2, "x": 1}), ("lasso", {"lambda": -1}), ("iht", {"n_nonzero_coefs": 2}), ("group_omp", {"n_groups": 1})]:
        with pytest.raises(ValueError):
            SparseEncoder(name, params)
    with pytest.raises(ValueError):
        FeatureEncoder("nope")


def test_codes_do_not_depend_on_partitions(spark):
    X, D = RNG.standard_normal((50, 8)), dictionaries.unit_rows(RNG.standard_normal((12, 8)))
    want = coders.batch_omp(X, D, 3)
    for parts in (1, 7):
        out = dense(SparseEncoder("bomp", {"n_nonzero_coefs": 3}).encode(frame(spark, X, parts=parts), D), 12).orderBy("id").collect()
        assert np.allclose([r.z for r in out], want)


def test_bad_signals_are_refused(spark):
    D = np.eye(2)
    for x in ([1.0, None], [1.0, float("nan")]):
        with pytest.raises(Exception):
            SparseEncoder("omp", {"n_nonzero_coefs": 1}).encode(spark.createDataFrame([(1, x)], "id long, x array<double>"), D).collect()
    assert SparseEncoder("omp", {"n_nonzero_coefs": 1}).encode(spark.createDataFrame([], "id long, x array<double>"), D).count() == 0


def test_init_dictionary(spark):
    rows = frame(spark, np.array([[1.0, 0], [2, 2], [3, 1], [4, 2], [5, 1]]))
    D = [tuple(r.d) for r in dictionary.init_dictionary(rows, 3, normalize=False).collect()]
    assert len(set(D)) == 3 and set(D) <= {(1, 0), (2, 2), (3, 1), (4, 2), (5, 1)}
    with pytest.raises(ValueError):
        dictionary.init_dictionary(rows, 6)
    assert dictionary.class_atoms([2, 3, 5], 1) == [2, 3, 4]


def test_accuracy_fixture(spark):
    y, p = [0, 0, 2, 1, 0, 2, 1, 2, 0, 1], [1, 0, 1, 1, 0, 2, 2, 2, 1, 0]
    rows = spark.createDataFrame(list(zip(y, p)), "y int, y_pred int")
    assert evaluate.class_accuracy(rows).first()[0] == 0.5
    assert round(evaluate.avg_class_accuracy(rows).first()[0], 1) == 0.5


def envelope(tp, fp, n_pos):
    ct, cf = np.cumsum(tp), np.cumsum(fp)
    top = np.maximum.accumulate((ct / np.maximum(ct + cf, 1))[::-1])[::-1]
    return (np.diff(np.r_[0, ct]) / n_pos * top).sum()


def most_read(spark, group):
    """The most rows that one task read from a shuffle in the jobs of a group."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jobs, store, most = context.statusTracker(), context._jsc.sc().statusStore(), 0
    for stage in {s for j in jobs.getJobIdsForGroup(group) for s in jobs.getJobInfo(j).stageIds}:
        if jobs.getStageInfo(stage) and jobs.getStageInfo(stage).numCompletedTasks:
            tasks = store.taskList(stage, 0, 10_000)
            most = max([most, *(tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size()))])
    return most


def test_average_precision_in_ranges(spark):
    """The same as in one sweep, and no task gets all rows, however many share a score."""
    n = 20_000
    tp = (RNG.random(n) < 0.4 * np.exp(-np.arange(n) / n)).astype(int)
    score = np.r_[np.linspace(2, 1, n // 4), np.full(n // 2, 0.5), np.linspace(0.4, 0, n - n // 4 - n // 2)]
    rows = spark.createDataFrame([(int(i), float(score[i]), int(tp[i]), int(1 - tp[i])) for i in RNG.permutation(n)], "rank long, a double, tp int, fp int").repartition(5).persist()
    spark.sparkContext.setJobGroup("ranges", "")
    try:
        got = [evaluate.average_precision(rows, int(tp.sum())).first()[0], evaluate.average_precision(rows, backwards=("a", F.desc("rank"))).first()[0], evaluate.average_precision(rows, 2 * int(tp.sum())).first()[0] * 2]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert np.allclose(got, envelope(tp, 1 - tp, tp.sum()), rtol=1e-12)
    assert rows.storageLevel.useMemory
    rows.unpersist()
    assert 0 < most_read(spark, "ranges") < n / 2


def test_average_precision_without_positives(spark):
    rows = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "rank long, tp int, fp int")
    assert np.isnan(evaluate.average_precision(rows, 0).first()[0]) and np.isnan(evaluate.average_precision(rows).first()[0])
    assert evaluate.average_precision(rows, 3).first()[0] == 0
    assert evaluate.average_precision(rows.where("rank < 0")).first()[0] is None


def test_learners(spark):
    true = dictionaries.unit_rows(RNG.standard_normal((6, 10)))
    X = np.array([RNG.uniform(1, 2) * true[i % 6] for i in range(120)])
    rows, coder = frame(spark, X), SparseEncoder("bomp", {"n_nonzero_coefs": 1})
    for model in (learn.KSVD(6, coder, max_iter=4), learn.KSVD(6, coder, max_iter=4, mode="distributed"), learn.OnlineLearner(6, coder, batch_size=40, n_epochs=2), learn.GradientLearner(6, coder, eta=0.001, n_epochs=3)):
        model.fit(rows)
        assert model.D.shape == (6, 10) and np.allclose(np.linalg.norm(model.D, axis=1), 1)
        assert model.errors[-1] <= model.errors[0] + 1e-9 and model.encode(rows).count() == 120


def test_classes(spark):
    centres = RNG.standard_normal((3, 12)) * 3
    y = np.arange(90) % 3
    rows = frame(spark, centres[y] + 0.1 * RNG.standard_normal((90, 12)), y)
    atoms = learn.ClassKSVD(3, SparseEncoder("bomp", {"n_nonzero_coefs": 1}), max_iter=2).fit(rows)
    assert sorted(r.k for r in atoms.collect()) == list(range(9)) and atoms.groupBy("cls").count().count() == 3
    coder = SparseEncoder("omp", {"n_nonzero_coefs": 1})
    models = [classify.SRC(coder, n_class_samples=3), classify.SRC(coder, learner=learn.ClassKSVD(2, coder, max_iter=1), method="local"), evaluate.LinearSVM(), learn.LCKSVD(2, SparseEncoder("omp", {"n_nonzero_coefs": 2}), max_iter=1)]
    for m in models:
        (m.fit if isinstance(m, learn.LCKSVD) else m.train)(rows)
        out = m.predict(rows).withColumnRenamed("pred", "y_pred").join(rows.withColumnRenamed("label", "y"), "id")
        assert evaluate.class_accuracy(out).first()[0] > 0.95
    params, score, _ = evaluate.grid_search(rows, evaluate.LinearSVM, {"C": (1e-3, 1.0)}, n_folds=2, refit=False)
    assert score > 0.95 and params["C"] in (1e-3, 1.0)


def test_svm_beyond_hessians(spark):
    centres = RNG.standard_normal((3, 8))
    y = np.arange(90) % 3
    rows = frame(spark, centres[y] + 0.5 * RNG.standard_normal((90, 8)), y)
    whole, product = evaluate.LinearSVM(0.1).train(rows), evaluate.LinearSVM(0.1, hessian_bytes=0).train(rows)
    assert np.allclose(whole.W, product.W, atol=1e-6)
    assert whole.predict(rows).orderBy("id").collect() == product.predict(rows).orderBy("id").collect()


def test_sums_in_blocks(spark):
    X = RNG.standard_normal((50, 70))
    got = learn.sums(frame(spark, X, parts=5), lambda A: {"q": A.T @ A, "n": np.array([len(A)])})
    assert np.allclose(got["q"], X.T @ X) and got["n"] == 50 and got["q"].size > learn.BLOCK
    assert learn.sums(frame(spark, X).where("id < 0"), lambda A: {"q": A.T @ A}) == {}


def test_moments_far_from_zero(spark):
    X = RNG.standard_normal((300, 3)) + 1e9
    n, mean, std = preprocess.moments(frame(spark, X, parts=3))
    assert n == 300 and np.allclose(mean, X.mean(0), rtol=1e-12) and np.allclose(std, X.std(0), rtol=1e-6)
    assert preprocess.moments(frame(spark, X).where("id < 0"))[0] == 0


def test_batches_with_gaps(spark):
    rows = spark.range(0, 200, 7)  # 29 ids
    batch, n = learn.each_batch(rows, 10)
    numbered = learn.batches(rows, 10)[0]
    found = [sorted(r.id for r in batch(i).collect()) for i in range(n)]
    assert n == 3 and sorted(sum(found, [])) == list(range(0, 200, 7)) and all(len(f) <= 11 for f in found)
    assert all({r.id for r in numbered.where(numbered.batch == i).collect()} == set(f) for i, f in enumerate(found))
    assert learn.each_batch(rows, None)[1] == 1 and learn.each_batch(rows.where("id < 0"), 10)[1] == 0


def test_sci_of_one_class(spark):
    atoms = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0])], "k int, cls int, d array<double>")
    codes = spark.createDataFrame([(5, [0, 1], [0.5, 2.0])], "id long, idx array<int>, val array<double>")
    assert [tuple(r) for r in classify.sci(codes, atoms).collect()] == [(5, 1.0)]


def test_whitening(spark):
    X = RNG.standard_normal((200, 5)) @ RNG.standard_normal((5, 5))
    out = np.array([r.x for r in preprocess.preprocess(frame(spark, X), "whitening", bias=1e-9).orderBy("id").collect()])
    assert np.allclose(out.T @ out / 200, np.eye(5), atol=1e-5)
    with pytest.raises(ValueError):
        preprocess.preprocess(frame(spark, X), "nope")


def test_sources(spark, tmp_path):
    img = RNG.integers(0, 255, (4, 6))
    for cls in ("b", "a"):
        (tmp_path / "img" / cls).mkdir(parents=True)
        (tmp_path / "img" / cls / "x.pgm").write_bytes(b"P5\n# c\n6 4\n255\n" + img.astype(np.uint8).tobytes())
    rows = sources.labelled_images(spark, str(tmp_path / "img")).collect()
    assert {(r.cls, r.label) for r in rows} == {("a", 0), ("b", 1)} and all((np.array(r.px).reshape(4, 6) == img).all() for r in rows)
    np.save(tmp_path / "v.npy", img)
    assert sorted(r.row for r in sources.read_npy(spark, str(tmp_path)).collect()) == [0, 1, 2, 3]
    ws = Workspace(spark, str(tmp_path / "ws"))
    ws.save("t", spark.range(5))
    ws.append("t", spark.range(3))
    ws.set_metadata(a=1)
    ws.set_metadata(b="x")
    assert ws.load("t").count() == 8 and ws.contains("t") and not ws.contains("u") and ws.metadata() == {"a": 1, "b": "x"} and ws.disk_usage() > 0
    assert request_workspace(spark, str(tmp_path / "root")).path.endswith("/1") and request_workspace(spark, str(tmp_path / "root")).path.endswith("/2")


def test_stream(spark, tmp_path):
    X = RNG.standard_normal((60, 6))
    for k in range(3):
        frame(spark, X[20 * k : 20 * k + 20], parts=1).write.parquet(str(tmp_path / "in" / str(k)))
    D, coder = dictionaries.unit_rows(RNG.standard_normal((4, 6))), SparseEncoder("omp", {"n_nonzero_coefs": 1})
    model = learn.OnlineLearner(4, coder)
    model.D = D
    stream = spark.readStream.schema("id long, x array<double>, label int").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    StreamingLearner(model, str(tmp_path / "state")).start(stream, str(tmp_path / "ck")).awaitTermination(120)
    assert len(model.errors) == 3 and not np.allclose(model.D, D)
    again = learn.OnlineLearner(4, coder)
    StreamingLearner(again, str(tmp_path / "state"))._load(spark, 2)
    assert np.allclose(again.D, model.D)


def test_vector_functions(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "x array<double>").select(V.flip_horizontal(F.col("x"), 3).alias("f"), V.sign_split(F.col("x")).alias("s"), V.n_patches(F.lit(5), F.lit(3), (6, 2), (1, 1)).alias("n")).first()
    assert row.f == [3, 2, 1, 6, 5, 4] and row.s == [1, 2, 3, 4, 5, 6] + [0] * 6 and row.n == 0


def test_the_corpus_part_is_optional():
    if not __spark_entry__._there("pursuit.llm.queries"):
        assert not any(n.startswith("op") and n[2].isdigit() for n in __spark_entry__.queries())


def test_svm_is_trained_on_all_rows(spark, monkeypatch):
    seen, train = [], evaluate.LinearSVM.train

    def counted(self, signals):
        seen.append(signals.count())
        return train(self, signals)

    monkeypatch.setattr(evaluate.LinearSVM, "train", counted)
    out = catalogue.queries()["svm"](spark, SF)
    assert seen == [out.count()] and seen[0] > 400


def test_sift_clips_rows_of_low_contrast(spark):
    from pyspark.sql import functions as F

    from pursuit.kernels.imaging import Sift
    from pursuit.operators import images

    rows = np.array([[0.9, 0.1, 0.0], [0.1, 0.1, 0.1], [3.0, 4.0, 0.0], [0.0, 0.0, 0.0]])
    want = [[0.2, 0.1, 0.0], [0.1, 0.1, 0.1], [0.5**0.5, 0.5**0.5, 0.0], [0.0, 0.0, 0.0]]
    assert np.allclose(Sift(1, 2).normalise(rows), want)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id int, x array<double>")
    assert np.allclose([r.x for r in images.normalize_sift(df).orderBy(F.col("id")).collect()], want)


def test_gradient_step_is_dense_algebra(spark):
    from pursuit.operators.encode import grad_step

    rng = np.random.default_rng(3)
    X, D, Z = rng.standard_normal((9, 5)), rng.standard_normal((4, 5)), rng.standard_normal((9, 4)) * (rng.random((9, 4)) < 0.5)
    signals = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, x array<double>")
    atoms = spark.createDataFrame([(k, d.tolist()) for k, d in enumerate(D)], "k int, d array<double>")
    codes = spark.createDataFrame([(i, k, float(Z[i, k])) for i, k in zip(*(x.tolist() for x in np.nonzero(Z)))], "id long, k int, z double")
    got = np.zeros_like(Z)
    for r in grad_step(signals, atoms, codes, 0.1).collect():
        got[r.id, r.k] = r.z
    assert np.allclose(got, Z + 0.1 * (X - Z @ D) @ D.T)


def test_query_inputs_are_whole_tables():
    """No registered query of the engine, nor its SQL, bounds ids."""
    import inspect

    source = inspect.getsource(catalogue)
    for bound in ("id < 60", "id < 8", "img_id < 50", "img_id < 20", "id % 7", "id < 400", "200 * steps"):
        assert bound not in source
