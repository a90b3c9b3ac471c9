from workload import evaluation, logging, modelling, profiling, retrieval, sources, sqlsurface, statistics  # noqa: F401
from workload.registry import ORACLES, QUERIES  # noqa: F401
