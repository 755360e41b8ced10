"""Importing this module registers every query."""
from . import (q_aggregate, q_classify, q_core, q_experiments, q_more, q_relate,  # noqa: F401
               q_sample_eval, q_sources, q_structure, q_text, q_udf)
