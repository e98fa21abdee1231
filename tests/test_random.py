"""Known vectors of the generator, streams, operators and the generation loop."""

import numpy as np
import pytest

from lodestone.functions.random import MUTATION, SELECTION, Streams, filled_rows
from lodestone.operators import genetics, ranking
from lodestone.plans import run as plan

ONE = np.arange(1)
# Published words, children and search results.
WORDS = {
    0: "e823a24e 7a7ecbd9 89fd6c06 ae646aa8 cd3cf945 6204b303 198c8585 49fce611",
    42: "c2f57bd6 6b07c4a9 72b7b29b 44215383 f5af5ead 68beb632 cbc7312c d5efc7d7",
}
CHILDREN = {"one-point": ([1, 2, 3, 6], [9, 8, 7, 4]), "two-point": ([1, 2, 3, 6], [9, 8, 7, 4]), "uniform": ([9, 2, 3, 6], [1, 8, 7, 4])}
ONEMAX = {
    0: ("f1dbafbbbbbefffd73b7bbfffbaff77b", 101, 342238),
    42: ("fbfdc7f576bfbee5f51bf5adf7adef6f", 94, 392515),
    2**64 - 1: ("fed73dbbdbb6feaedbfadbfcdbf227cd", 91, 572707),
}


@pytest.mark.parametrize("seed", WORDS)
def test_words(seed):
    s = Streams.seeded([seed])
    assert [f"{int(s.word(ONE)[0]):08x}" for _ in range(8)] == WORDS[seed].split()


def test_derived_stream():
    s = Streams.derived(42, 7, np.array([11]), MUTATION)
    assert (int(s.state[0]), int(s.increment[0])) == (0x524955425FF5CF53, 0x5E6AB376C2E2CE3D)
    assert [int(s.word(ONE)[0]) for _ in range(4)] == [0x80524A0E, 0x665016DE, 0x2FEB6AB6, 0xBB7EBD14]


@pytest.mark.parametrize("kind", CHILDREN)
def test_crossover(kind):
    a, b = np.array([[1, 2, 3, 4]], dtype=np.uint8), np.array([[9, 8, 7, 6]], dtype=np.uint8)
    got = genetics.cross(a, b, Streams.seeded([42]), 1.0, kind)
    assert tuple(x[0].tolist() for x in got) == CHILDREN[kind]


def test_clone_takes_one_word():
    s = Streams.seeded([42])
    a, b = np.array([[1]], dtype=np.uint8), np.array([[2]], dtype=np.uint8)
    assert [x[0, 0] for x in genetics.cross(a, b, s, 1.0, "one-point")] == [1, 2]
    assert int(s.word(ONE)[0]) == 0x6B07C4A9


def test_mutation():
    assert genetics.mutate(np.array([[1, 2, 3, 4]], dtype=np.uint8), Streams.seeded([42]), 1.0).tolist() == [[1, 0xEC, 3, 4]]


def test_rank_draws(spark):
    rows = spark.createDataFrame([(0, 1, 10.0), (0, 2, 5.0), (0, 3, 10.0)], "g int, population_index long, total double")
    i = {r["population_index"]: (r["ticket_from"], r["ticket_to"]) for r in ranking.rank_intervals(rows, "g", "population_index", "total", 1, 2).collect()}
    s = Streams.seeded([42])
    draws = [int(s.uniform(ONE, 9)[0]) for _ in range(12)]
    assert [next(k for k, (a, b) in i.items() if a <= t < b) for t in draws] == [1, 1, 1, 2, 2, 2, 1, 3, 1, 1, 3, 3]


def test_fill_is_one_stream():
    s = Streams.seeded([5])
    whole = b"".join(int(s.word(ONE)[0]).to_bytes(4, "little") for _ in range(40))
    for size in (3, 4, 7, 16):
        assert b"".join(filled_rows(5, np.arange(9), size)) == whole[: 9 * size]


def test_uniform_is_unbiased():
    s = Streams.derived(1, 2, np.arange(4000), SELECTION)
    counts = np.bincount(s.uniform(np.arange(4000), 5).astype(int), minlength=5)
    assert counts.min() > 700


@pytest.mark.parametrize("seed", sorted(ONEMAX))
def test_onemax(spark, tmp_path, seed):
    config = plan.Config(32, 16, 12, seed, elite_count=2, adaptive=True, adaptive_min=0.1, adaptive_max=0.8, adaptive_step=0.1, adaptive_threshold=0.35, adaptive_reset=True)
    state = plan.run(spark, plan.Problem(fitness=plan.popcount("genome", 16)), config, str(tmp_path))
    genome, total, diversity = ONEMAX[seed]
    assert (state.best_genome.hex(), state.best_total, state.reason) == (genome, total, "generation-limit")
    assert round(state.history[-1]["diversity"] * 1e6) == diversity
    later = plan.Config(32, 16, 12, 7, elite_count=2)
    with pytest.raises(plan.ConfigError):
        plan.resume(spark, plan.Problem(fitness=plan.popcount("genome", 16)), later, str(tmp_path), 5)


def test_resume_equals_uninterrupted(spark, tmp_path):
    config = plan.Config(5, 4, 3, 9, selection="tournament", tournament_size=2, crossover="two-point")
    problem = plan.Problem(fitness=plan.popcount("genome", 4))
    whole = plan.run(spark, problem, config, f"{tmp_path}/a")
    short = plan.Config(5, 4, 1, 9, selection="tournament", tournament_size=2, crossover="two-point")
    plan.run(spark, problem, short, f"{tmp_path}/b")
    # The first run stopped at its own limit; the written generation goes on under the longer one.
    again = plan.resume(spark, problem, config, f"{tmp_path}/b", 1)
    assert (again.best_genome, again.best_total, again.history[-1]) == (whole.best_genome, whole.best_total, whole.history[-1])


def test_config_order():
    with pytest.raises(plan.ConfigError, match="workers"):
        plan.Config(0, 1, 1, 1, workers=0).validate()
    with pytest.raises(plan.ConfigError, match="tournament"):
        plan.Config(2, 1, 1, 1, selection="tournament", tournament_size=3).validate()
