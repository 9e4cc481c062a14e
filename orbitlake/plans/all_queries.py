"""All registered queries of the library: importing a module of queries adds them."""

from . import audit_queries, estimator_queries, model_queries, physics_queries, sequence_queries, signal_queries, solver_queries  # noqa: F401
from .queries import QUERIES, SQL  # noqa: F401
