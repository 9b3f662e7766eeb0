"""Point and feature data on Spark."""

import os

# Tasks are the unit of parallel work: BLAS threads of their own only contend with each other.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
