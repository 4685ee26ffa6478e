"""Registered queries, one module per area."""


def all_plans():
    """Import every plan module and return the catalog they fill."""
    from signalbook.plans import agents, catalog, corpus, documents, evaluation, network, rule_tables, streams, timelines  # noqa: F401

    return catalog
