"""Names of the registered queries."""

from tessera.plans import catalog


def test_no_query_is_named_as_the_whole_of_another():
    """Every query takes its whole tables, so NAME_all beside NAME would say that NAME does not."""
    assert not [n for n in catalog.QUERIES if n.endswith("_all") and n.removesuffix("_all") in catalog.QUERIES]
    assert catalog.QUERIES.keys() >= catalog.ORACLE.keys()
