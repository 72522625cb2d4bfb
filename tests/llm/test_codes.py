import random

import numpy as np
import pytest

from gleanery.llm.codes import BLOCK, Tree, anchors, block_codes, block_sums, labelled_errors, vector_codes


def nearest(points, books):
    x = points.reshape(books.shape[0], -1, books.shape[2]).astype(np.int64)
    d = ((x[:, :, None] - books[:, None]) ** 2).sum(3)
    return d.argmin(2), d.min(2).sum(0)


def plain(rows, parts, entries, rounds):
    """rows: (id, vector of floats), all to be kept. Codes and errors by row, and the codebooks."""
    x = np.array([[int(np.floor(256 * c)) for c in v] for _, v in rows], np.int64)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, x[k].tolist()))[:entries]
    cut = x.reshape(len(x), parts, -1).transpose(1, 0, 2)
    books = cut[:, order].copy()
    for _ in range(rounds):
        code, _ = nearest(cut, books)
        for p in range(parts):
            for e in range(books.shape[1]):
                own = cut[p][code[p] == e]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)
    code, error = nearest(cut, books)
    return ["".join(f"{c:02x}" for c in code[:, k]) for k in range(len(x))], error.tolist(), books


@pytest.mark.parametrize(("n", "d", "scale"), [(1500, 4, 40), (400, 2, 2), (100, 4, 3), (300, 4, 1_000_000), (17, 1, 2), (1, 3, 9)])
def test_tree_finds_the_nearest_entry(n, d, scale):
    r = np.random.default_rng(n)
    points = np.floor(r.normal(0, scale, (3 * n, d))).astype(np.int64)
    tree = Tree.unpack(Tree.build(points, np.arange(4) * n).pack())
    books = points.reshape(3, n, d)[:, : min(n, 30)].copy()
    code, error = nearest(points, books)
    got, distance = block_codes(tree, books)
    assert (got.T == code).all() and (distance == error).all()
    want = np.zeros((3 * books.shape[1], d + 1), np.int64)
    np.add.at(want, (np.arange(3)[:, None] * books.shape[1] + code).ravel(), np.column_stack([points, np.ones(len(points), np.int64)]))
    assert (block_sums(tree, books) == want).all()


def test_balls_hold_their_points_and_are_owned_whole():
    r = np.random.default_rng(4)
    points = np.concatenate([np.floor(r.normal(c, 3, (500, 4))) for c in (-300, 0, 300)]).astype(np.int64)
    tree = Tree.build(points, np.array([0, 1500]))

    def below(k):
        return set(tree.order[tree.lo[k] : tree.hi[k]].tolist()) if tree.left[k] < 0 else below(tree.left[k]) | below(tree.right[k])

    for k in range(len(tree.part)):
        own = points[sorted(below(k))]
        assert len(own) == tree.count[k] and (own.sum(0) == tree.total[k]).all()
        assert np.linalg.norm(own - tree.centre[k], axis=1).max() <= tree.radius[k] + 1e-6
    # three far clusters and their centres: sums come from balls, not from points
    ball, of, point, _ = tree.assign(np.array([[[-300] * 4, [0] * 4, [300] * 4]]), whole=False)
    assert len(point) == 0 and tree.count[ball].sum() == 1500 and len(ball) < 20


def test_anchors_own_the_points_nearest_to_them():
    r = np.random.default_rng(5)
    x = np.floor(r.normal(0, 50, (130, 3)))
    owner = anchors(x, np.array([0, 100, 130]))
    assert owner[:100].max() == 9 and owner[100:].max() == 5
    assert anchors(np.ones((40, 2)), np.array([0, 40])).max() == 0


def test_like_brute_force(spark):
    r = random.Random(7)
    data = [(k, [r.gauss(0, 0.1) for _ in range(8)], r.choice([1, 1, 1, 2, None])) for k in range(700)]
    data += [(None, [0.5] * 8, 3), (5, [0.25] * 8, 1), (5, [0.125] * 8, 1), (900, data[0][1], 2), (901, data[0][1], 2)]
    bad = [(-9, None, 1), (-8, [], 1), (-7, [0.1] * 7 + [None], 1), (-6, [0.1] * 7 + [float("nan")], 1), (-5, [float("-inf")] * 8, 1), (2000, [0.1] * 16, 1)]
    df = spark.createDataFrame([(*x, "k") for x in data + bad], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    found, books = vector_codes(df, parts=4, entries=16)
    code, error, want = plain([x[:2] for x in data], 4, 16, 2)
    assert (books == want).all()
    sums = {}
    for (_, _, label), e in zip(data, error, strict=True):
        sums[label] = sums.get(label, 0) + e
    expected = [(d, label, c, e, sums[label]) for (d, _, label), c, e in zip(data, code, error, strict=True)]
    assert sorted(map(tuple, labelled_errors(found).select("id", "label", "code", "error", "label_error").collect()), key=repr) == sorted(expected, key=repr)


def test_few_rows_large_components_and_none(spark):
    one = spark.createDataFrame([(3, [1e30, -1e30], None)], "vec_id long, embedding array<double>, label string")
    found, books = vector_codes(one, parts=2)
    assert books.tolist() == [[[1 << 24]], [[-(1 << 24)]]] and [tuple(x) for x in found.collect()] == [(3, None, "0000", 0)]
    empty, none = vector_codes(one.limit(0))
    assert none is None and empty.count() == 0 and labelled_errors(empty).count() == 0
    with pytest.raises(ValueError):
        vector_codes(one, parts=3)
    assert BLOCK < 1 << 15
