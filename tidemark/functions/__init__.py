"""Column functions of the library."""

from tidemark.operators.factors import finite, guarded_corr
from tidemark.operators.pit import availability, content_id, date_precision, round14
from tidemark.operators.portfolios import block_reason

__all__ = ["availability", "block_reason", "content_id", "date_precision", "finite", "guarded_corr", "round14"]
