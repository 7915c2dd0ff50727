"""A lazy, pandas-shaped frame library whose only plan is Spark's own."""

from tessera.operators.combine import concat
from tessera.operators.frame import DataFrame
from tessera.operators.groupby import DataFrameGroupBy, SeriesGroupBy
from tessera.operators.series import Series
from tessera.sources.session import Session, connect, from_arrow, from_pandas, read_csv, read_parquet

__version__ = "0.1.0"

__all__ = ["DataFrame", "DataFrameGroupBy", "Series", "SeriesGroupBy", "Session", "__version__", "concat", "connect", "from_arrow", "from_pandas", "read_csv", "read_parquet"]
