import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cellgrid.session import make_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = make_session("local[8]", "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def small(spark):
    """A tiny started model: 10 cells, two layers, factored and unfactored genes."""
    from cellgrid.catalogue.inputs import canonical
    from cellgrid.options import Options, validate
    from cellgrid.plans import gibbs, segment

    opts = validate(Options(
        burnin_voxel_size=2.0, voxel_size=1.0, voxel_layers=2, ncomponents=3, nhidden=4, nunfactored=5, sweeps_per_iter=1,
        samples=1, recorded_samples=1, burnin_samples=1, hillclimb=0, init_iterations=1, seed=3,
    ))
    t = segment.prepare(canonical(spark, SF), opts)
    state, index = segment.initialize(t, opts)
    state = gibbs.gibbs_step(state, opts, burnin=True, sample_z=False)
    return opts, t, state, index
