"""All registered queries: name -> (callable, equivalent SQL or None)."""

from evidra.plans import evaluation_queries, ingest_queries, network_queries, retrieval_queries, review_queries

ALL = {}
for _module in (retrieval_queries, evaluation_queries, network_queries, review_queries, ingest_queries):
    for _name, _spec in _module.QUERIES.items():
        if _name in ALL:
            raise ValueError(f"query registered twice: {_name}")
        ALL[_name] = _spec
