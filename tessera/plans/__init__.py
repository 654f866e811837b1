from . import registry  # noqa: F401  first, so that the query modules can be imported in any order
