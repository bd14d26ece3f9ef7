"""Registered queries, grouped by the operators they exercise."""


def load():
    from importlib import import_module

    from threadloom.plans import registry

    for name in MODULES:
        import_module(f"threadloom.plans.{name}")
    return registry


MODULES = ("etl_queries", "search_queries", "recs_queries", "report_queries", "flow_queries")
