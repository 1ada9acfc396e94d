"""All registered queries; importing this package fills the registry."""

from panelwise.plans.catalog import book_q, custom_q, data_q, grid_q, metrics_q, portfolio_q, regimes_q, signals_q, stream_q  # noqa: F401
from panelwise.plans.catalog.signals_q import flagship  # noqa: F401
from panelwise.plans.registry import QUERIES, SQL  # noqa: F401
