"""All registered queries; importing the modules fills the registry."""

from vintageline.queries import model_queries, portfolio_queries, survival_queries, table_queries  # noqa: F401
from vintageline.queries.inputs import QUERIES, TWINS  # noqa: F401
