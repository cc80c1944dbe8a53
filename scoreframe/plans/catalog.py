"""All registered queries of the reference's operators."""

from scoreframe.plans import aggregate_queries, chain_queries, extraction_queries, integration_queries, job_queries, join_queries, publishing_queries, rule_queries, scalar_queries  # noqa: F401
from scoreframe.plans.registry import QUERIES, SQL

#: Names that once ran over part of a table: they are the whole queries now.
for _name, _whole in (("p20_compact_text", "p20_compact_all"), ("j14_overlap_join", "j14_overlap_all"), ("u5_set_ops", "u5_set_ops_all")):
    QUERIES[_name], SQL[_name] = QUERIES[_whole], SQL[_whole]

FLAGSHIP = "d2_build_rankings"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
