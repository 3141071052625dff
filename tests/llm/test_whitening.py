import numpy as np
import pytest

from voxledger.llm import embedding_whitening as ew
from voxledger.llm.queries_new import op11_embedding_whitening

SCHEMA = "vec_id long, embedding array<double>, x long, v string, task int, d int, i int"


@pytest.fixture(scope="module")
def table(spark):
    return lambda rows: spark.createDataFrame([(i, v, 1, "v", 2, 3, 4) for i, v in rows], SCHEMA)


def expected(vectors, k=8):
    """Whole-table whitening with numpy's own eigenvalues."""
    x = np.floor(1024.0 * np.array(vectors)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    v = c.T @ c / n
    values, w = np.linalg.eigh(v)
    values, w = values[::-1][:k], w[:, ::-1][:, :k]
    return x, ((n * x - s) ** 2).sum(axis=1), c @ w / np.sqrt(values), values / np.trace(v)


def against(rows, vectors, ids):
    _, deviation, white, explained = expected(vectors)
    k = white.shape[1]
    assert len(rows) == len(vectors) * k
    got = {(r.vec_id, r.component): r for r in rows}
    at = np.array([[got[i, c + 1].whitened for c in range(k)] for i in ids])
    at *= np.sign((at * white).sum(axis=0))  # either sign
    assert np.allclose(at, white, atol=1e-7)
    assert [got[i, 1].deviation for i in ids] == deviation.tolist()
    assert np.allclose([got[ids[0], c + 1].explained for c in range(k)], explained, rtol=1e-9)
    assert {r.n for r in rows} == {len(vectors)} and max(r.identity_error for r in rows) < 1e-9


def test_the_query_against_numpy(spark):
    folder = "/root/testdata/sf0.001"
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    against(op11_embedding_whitening(spark, folder).collect(), [v for _, v in given], [i for i, _ in given])


def test_nulls_lengths_ties_and_repeats(spark, table):
    rng = np.random.default_rng(1)
    good = [(i, (rng.standard_normal(5) * [3, 2, 1, 1, 0.5]).tolist()) for i in range(60)]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf")] + [0.0] * 4), (104, []), (105, [1.0, 2.0]), (106, [1e300] * 5)]
    rows = ew.whiten(table(good + odd)).collect()
    against(rows, [v for _, v in good], [i for i, _ in good])
    twice = ew.whiten(table(good + good)).collect()
    assert len(twice) == 2 * len(rows) and {r.n for r in twice} == {120}
    assert {r.vec_id for r in ew.whiten(table([(None, [1.0, 2.0]), (None, [2.0, 1.0])])).collect()} == {None}


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]], [[1.0, 2.0]] * 5])
def test_nothing_varies(table, vectors):
    rows = ew.whiten(table(list(enumerate(vectors)))).collect()
    assert len(rows) == 2 * len(vectors)
    assert all(r.whitened is None and r.deviation == 0 and r.explained == 0 and r.identity_error == 0 for r in rows)


def test_empty_tables(table):
    for rows in ([], [(1, None)]):
        assert ew.whiten(table(rows)).count() == 0


def test_deviations_past_64_bits(table):
    model = ew.Model(10**6, np.array([10**11], object), np.ones(1), np.ones((1, 1)), 1.0)
    x = np.array([[100_000], [10**8], [10**10]])
    assert ew._deviations(x, model) == [0, None, None]
    assert ew._deviations(x[:1] + 7, model) == [49 * 10**12]


@pytest.mark.parametrize("d", [1, 2, 3, 10, 40])
@pytest.mark.parametrize("kind", ["random", "clustered", "equal", "low rank", "diagonal"])
def test_pairs_against_numpy(d, kind):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = {"random": rng.random(d) * 9, "clustered": 1 + 1e-9 * rng.random(d), "equal": np.full(d, 2.0), "low rank": np.where(np.arange(d) < 2, 5.0, 0.0), "diagonal": np.arange(d) + 1.0}[kind]
    matrix = np.diag(values) if kind == "diagonal" else (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    k = min(8, d)
    found, vectors = ew.leading_pairs(matrix, k)
    assert np.allclose(found, np.linalg.eigvalsh(matrix)[::-1][:k], atol=1e-12 * max(1, values.max()))
    assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-10)
    assert np.allclose(matrix @ vectors, vectors * found, atol=1e-10)
