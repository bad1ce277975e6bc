"""The map's growth rules on maps worked out by hand."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from somatlas.functions.kernels import exponential_decay, growing_threshold, linear_decay, sample_weight, sigma_at
from somatlas.operators.growth import GrowingMap
from somatlas.operators.topology import hop_matrix


def seeded(errors):
    m = GrowingMap(np.array([[0.0, 0], [1, 10], [2, 20], [3, 30]]))
    m.errors = np.array(errors, float)
    return m


def block(errors):
    cells = [(x, y) for x in range(3) for y in range(3)]
    return GrowingMap.of(cells, np.arange(18, dtype=float).reshape(9, 2), errors)


def test_seed_adjacency():
    m = seeded([0, 0, 0, 0])
    assert m.links == [[1, 2], [0, 3], [0, 3], [1, 2]]


def test_growth_pass_on_the_seed():
    m = seeded([10, 8, 6, 1])
    assert m.grow(5, epoch=3) == 3
    assert m.cells[4:] == [(-1, 0), (-1, 1), (1, -1)]
    w = m.weights
    assert np.array_equal(w[4], 2 * w[0] - w[2])
    assert np.array_equal(w[5], 2 * w[1] - w[3])
    assert np.array_equal(w[6], 2 * w[2] - w[3])
    assert len(m.edges()) == 16
    assert m.created[4:] == [3, 3, 3]


def test_corner_tie_reflects_the_first_neighbour():
    m = seeded([10, 5, 5, 1])
    m.grow(9, 0)
    assert m.cells[4] == (0, -1)


def test_diffusion_on_a_block():
    m = block([0, 0, 0, 0, 8, 0, 0, 0, 0])
    m.distribute_errors(5)
    assert m.errors.tolist() == [0, 1, 0, 1, 4, 1, 0, 1, 0]


def test_diffusion_without_takers_loses_half():
    cells = [(x, y) for x in range(5) for y in range(5)]
    m = GrowingMap.of(cells, np.zeros((25, 1)), [9.0 if c == (2, 2) else 0.0 for c in cells])
    m.distribute_errors(5)
    assert m.errors.sum() == 4.5


def test_one_free_cell():
    e = [0.0] * 9
    e[1] = 9
    m = block(e)
    m.grow(5, 0)
    assert m.cells[9:] == [(-1, 1)]
    assert np.array_equal(m.weights[9], 2 * m.weights[1] - m.weights[4])


def test_opposite_neighbours():
    m = GrowingMap.of([(0, 0), (0, 1), (0, 2)], np.array([[0.0], [5], [7]]), [0, 9, 0])
    m.grow(5, 0)
    assert m.cells[3:] == [(1, 1)] and m.weights[3] == [2 * 5 - 7]
    m = GrowingMap.of([(0, 0), (1, 0), (2, 0)], np.array([[0.0], [5], [7]]), [0, 9, 0])
    m.grow(5, 0)
    assert m.cells[3:] == [(1, 1)] and m.weights[3] == [2 * 5 - 0]


def test_three_free_cells():
    line = lambda e: GrowingMap.of([(0, 0), (0, 1)], np.array([[1.0], [4]]), e)
    m = line([0, 9])
    m.grow(5, 0)
    assert m.cells[2:] == [(0, 2)] and m.weights[2] == [7]
    # one side: (1, 0) beside the neighbour
    corner = lambda e: GrowingMap.of([(0, 0), (0, 1), (1, 0)], np.array([[1.0], [4], [10]]), e)
    m = corner([8, 9, 2])
    m.grow(8.5, 0)
    assert m.cells[3:] == [(0, 2)]
    m = corner([1, 9, 2])
    m.grow(5, 0)
    assert m.cells[3:] == [(1, 1)] and m.weights[3] == [((2 * 4 - 1) + 10) / 2]
    # two sides: the one with more error, the second of equal ones
    tee = lambda e: GrowingMap.of([(0, 0), (0, 1), (-1, 0), (1, 0)], np.zeros((4, 1)), e)
    for errors, cell in (([8, 9, 1, 2], (0, 2)), ([1, 9, 3, 2], (-1, 1)), ([1, 9, 2, 3], (1, 1)), ([1, 9, 2, 2], (1, 1))):
        m = tee(errors)
        m.grow(8.5, 0)
        assert m.cells[4:] == [cell], errors


def test_interior_switch():
    e = [0, 7, 0, 0, 9, 0, 0, 0, 0]
    m, n = block(e), block(e)
    assert m.grow(5, 0) == 1 and n.grow(5, 0, interior_blocks=True) == 0


def test_without_keeps_order():
    m = block(range(9)).without(np.arange(9) % 2 == 1)
    assert m.cells == [(0, 0), (0, 2), (1, 1), (2, 0), (2, 2)] and m.edges() == []
    assert np.isinf(m.hops()[0, 1]) and m.u_matrix().tolist() == [0] * 5


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0, 10), min_size=4, max_size=4), st.integers(1, 6))
def test_any_growth_keeps_a_connected_grid(errors, passes):
    m = seeded(errors)
    for k in range(passes):
        m.distribute_errors(4)
        m.grow(4, k)
        m.errors = np.resize(np.array(errors), len(m))
    assert len(set(m.cells)) == len(m) and np.isfinite(m.hops()).all()
    for a, b in m.edges():
        assert abs(m.cells[a][0] - m.cells[b][0]) + abs(m.cells[a][1] - m.cells[b][1]) == 1


def test_schedules():
    at = lambda e, coarse=True, decay="exponential": sigma_at(e, 4, 200, 0.5, coarse, decay, 0.02, None, None)
    assert abs(at(0) - 0.4) < 1e-12 and abs(at(50) - (0.7 - 0.3 * np.exp(-2))) < 1e-12
    assert abs(at(50, decay="linear") - 0.55) < 1e-12 and abs(at(100, decay="linear") - 0.7) < 1e-12
    assert at(150, coarse=False) == 0.7
    assert abs(exponential_decay(0.2, 0.05, 50, 0.01) - (0.05 + 0.15 * np.exp(-0.5))) < 1e-12
    assert abs(linear_decay(0.2, 0.05, 100, 50) - 0.125) < 1e-12


def test_thresholds_and_weights():
    std = np.array([3.0, 4.0])
    assert np.isclose(growing_threshold("se", "quantization_error", 0.5, 2, std), 750 * np.log(2))
    assert np.isclose(growing_threshold("classical", "quantization_error", 0.5, 2, std), 2 * np.log(2))
    assert growing_threshold("se", "entropy", 1.7, 2, std) == 1.7
    assert sample_weight(np.array([0.0, 1e9]), 2.0).tolist() == [1.0, 0.0]
    assert sample_weight(np.array([0.0, 3.0]), 0.0).tolist() == [1.0, 1.0]


def test_hop_matrix():
    m = hop_matrix(4, [(0, 1), (1, 2)])
    assert m[0].tolist() == [0, 1, 2, np.inf]
